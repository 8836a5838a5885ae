"""The registered queries of this subpackage, and the SQL that some of them must agree with."""

from __future__ import annotations

import functools
import io
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    alignment,
    bpe,
    embedding_dedup,
    exact_dedup,
    language_id,
    lexical,
    license_texts,
    licenses,
    mixing,
    ngram_join,
    quality_rules,
    sharding,
    token_files,
    toxicity,
)
from millrace.llm.store import written
from millrace.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The vocabulary file of the queries; operators take the text of any such file.
VOCABULARY = "word_bpe_49k.json"
#: The two files that ``op12_token_alignment`` aligns.
BYTE_VOCABULARY, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Rows that a Python worker is handed at a time. Texts are long, and memory goes by batches.
BATCH_ROWS = 1000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the library importable in the executors' Python, as ``--py-files`` would, and
    keep the batches that go there small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted((root / "millrace").rglob("*")):
            if source.suffix in (".py", ".txt"):
                archive.write(source, source.relative_to(root))
    # Spark's file server hands the archive to the executors; the folder is the driver's own.
    path = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace_code.zip"
    path.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        @functools.wraps(function)
        def shipped(spark: SparkSession, directory: str) -> DataFrame:
            ship(spark)
            return function(spark, directory)

        QUERIES[function.__name__] = shipped
        if sql:
            ORACLE[function.__name__] = sql
        return shipped

    return register


def vocabulary_text(path: str | None = None) -> str:
    return Path(path or public_tokenizers.path(VOCABULARY)).read_text(encoding="utf-8")


def remainder(column: str, of: int):
    """The CRC-32 of a column as text, modulo ``of``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


@query(
    """
    WITH RECURSIVE
    vectors AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    usable AS (
        SELECT r, v FROM vectors
        WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
          AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (
        SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.r <> b.r AND len(a.v) = len(b.v)
        WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
    reached(r, top) AS (
        SELECT r, vec_id FROM vectors UNION
        SELECT l.b, x.top FROM reached x JOIN links l ON l.a = x.r),
    tops AS (SELECT r, min(top) AS component_id FROM reached GROUP BY r),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id IS NULL OR coalesce(vec_id = component_id, false) AS kept
    FROM vectors JOIN tops USING (r) LEFT JOIN counts ON a = r
    """
)
def op1_embedding_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return embedding_dedup.near_duplicates(tables.read(spark, directory, "embeddings"))


@query(
    r"""
    WITH RECURSIVE
    docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    words AS (SELECT r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM docs),
    shingles AS (
        SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS s
        FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
    sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
    shared AS (
        SELECT a.r AS a, b.r AS b, count(*) AS n
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b
        WHERE 5 * shared.n >= 4 * (x.n + y.n - shared.n)),
    reached(r, top) AS (
        SELECT r, doc_id FROM docs UNION
        SELECT l.b, x.top FROM reached x JOIN links l ON l.a = x.r),
    tops AS (SELECT r, min(top) AS class_id FROM reached GROUP BY r),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_links, class_id, class_id IS NULL OR coalesce(doc_id = class_id, false) AS kept
    FROM docs JOIN tops USING (r) LEFT JOIN counts ON a = r
    """
)
def op2_ngram_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.similar_documents(tables.read(spark, directory, "documents"))


@query()
def op3_language_id(spark: SparkSession, directory: str) -> DataFrame:
    docs = tables.read(spark, directory, "documents")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = language_id.learn(docs, ~held)
    found = language_id.predict(model, docs.select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query()
def op4_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    return licenses.scan(tables.read(spark, directory, "documents"), licenses.merged(licenses.TEMPLATES, license_texts.ALL), short=True)


@query()
def op5_token_files(spark: SparkSession, directory: str) -> DataFrame:
    files = token_files.write_files(tables.read(spark, directory, "documents"), vocabulary_text())
    return token_files.read_files(files).withColumnRenamed("id", "doc_id")


@query()
def op6_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs, labels = (tables.read(spark, directory, t) for t in ("documents", "labels"))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = toxicity.train(docs, labels, ~held)
    found = toxicity.score(model, docs.select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


@query(
    r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    lined AS (
        SELECT *, row_number() OVER (
            PARTITION BY source
            ORDER BY CASE WHEN size > 0 THEN floor(log2(size::DOUBLE) * 16)::INT ELSE -1 END, h, size, doc_id NULLS FIRST) AS place
        FROM sized),
    sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM sources),
    told AS (
        SELECT *, row_number() OVER w AS nth,
               sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
               sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
        FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
    levels AS (SELECT nth AS first_nth, rest AS level_rest, sharing AS level_sharing FROM told WHERE rest * weight <= cap * sharing ORDER BY nth LIMIT 1),
    goals AS (
        SELECT source, source_size,
               CASE WHEN nth >= first_nth THEN (level_rest * weight)::DOUBLE / level_sharing::DOUBLE ELSE cap::DOUBLE END AS target
        FROM told LEFT JOIN levels ON true),
    rated AS (
        SELECT l.*, g.source_size, g.target, g.target / g.source_size::DOUBLE AS rate,
               ('0x' || substr(md5('mix/' || coalesce(l.source, '')), 1, 5))::INT::DOUBLE / 1048576 AS start
        FROM lined l JOIN goals g ON l.source IS NOT DISTINCT FROM g.source),
    taken AS (
        SELECT *, CASE WHEN source_size > 0
            THEN least(floor(start + place * rate) - floor(start + (place - 1) * rate), 3) ELSE 0 END::BIGINT AS copies FROM rated)
    SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
    """
)
def op7_source_mixing(spark: SparkSession, directory: str) -> DataFrame:
    mixed = mixing.mix(tables.read(spark, directory, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def _best_shard(shards: int) -> str:
    drawn = f"list_transform(range({shards}), lambda i: md5(coalesce(doc_id::VARCHAR, '') || ':' || i)[1:13])"
    return f"(list_position({drawn}, list_max({drawn})) - 1)::INT"


def _crc32_table() -> list[int]:
    """What a byte does to a CRC-32: eight shifts, each with the polynomial if a bit falls out."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


# DuckDB has no CRC-32, so the sum over bytes is written out.
@query(
    f"""
    WITH bytes AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS digits FROM documents),
    summed AS (
        SELECT doc_id, text, xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(range(1, length(digits)::BIGINT, 2), lambda i: ('0x' || digits[i:i+1])::BIGINT)),
            lambda c, b: xor(c >> 8, {_crc32_table()}[(xor(c, b) & 255) + 1]::BIGINT))) AS text_crc32
        FROM bytes),
    dealt AS (
        SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law,
               {_best_shard(16)} AS shard, {_best_shard(17)} AS grown_shard FROM summed)
    SELECT *, row_number() OVER (
        PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
    FROM dealt
    """
)
def op8_rendezvous_shards(spark: SparkSession, directory: str) -> DataFrame:
    return sharding.assign(tables.read(spark, directory, "documents"))


@query()
def op9_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    docs, labels = (tables.read(spark, directory, t) for t in ("documents", "labels"))
    measured = written(quality_rules.with_statistics(docs.select("doc_id", "text"), keep=["doc_id"]), "statistics")
    judged = quality_rules.judge(measured, quality_rules.learn(measured, labels))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        "doc_id",
        *(F.col(f"__{c}").alias(c) for c in base),
        F.col("__base_failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
        F.col("__rule").alias("rule"),
    )


@query()
def op10_bpe(spark: SparkSession, directory: str) -> DataFrame:
    docs = tables.read(spark, directory, "documents").select("doc_id", "text")
    found = bpe.encode_digests(docs, vocabulary_text(), keep=["doc_id"])
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query(
    """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
)
def op11_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup.exact_duplicates(tables.read(spark, directory, "documents"))


@query()
def op12_token_alignment(spark: SparkSession, directory: str) -> DataFrame:
    model = Path(public_tokenizers.path(PIECE_MODEL)).read_bytes()
    return alignment.align(tables.read(spark, directory, "documents"), vocabulary_text(public_tokenizers.path(BYTE_VOCABULARY)), model)


def _terms_of(table: str, name: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {name}, unnest(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table}"


@query(
    f"""
    WITH
    docs AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
    items AS (SELECT row_number() OVER () AS item_row, item_id, text FROM benchmark),
    words AS ({_terms_of("docs", "row_id")}),
    asked AS (SELECT item_row, term, count(*) AS times FROM ({_terms_of("items", "item_row")}) GROUP BY 1, 2),
    lengths AS (SELECT row_id, count(*) AS n FROM words GROUP BY 1),
    corpus AS (SELECT count(*) AS documents, sum(n)::BIGINT AS terms FROM lengths),
    postings AS (SELECT row_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
    weights AS (
        SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM postings, corpus GROUP BY term, documents),
    sized AS (SELECT row_id, 75 + (25 * n * documents) // terms AS m FROM lengths, corpus),
    scored AS (
        SELECT item_row, row_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
        FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sized USING (row_id) GROUP BY 1, 2),
    ranked AS (
        SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS rank
        FROM scored JOIN items USING (item_row) JOIN docs USING (row_id) WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """
)
def op13_ranked_search(spark: SparkSession, directory: str) -> DataFrame:
    return lexical.search(tables.read(spark, directory, "documents"), tables.read(spark, directory, "benchmark"))
