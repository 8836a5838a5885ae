from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment
from millrace.llm.queries import BYTE_VOCABULARY, PIECE_MODEL, vocabulary_text
from tests.llm.helpers import SMALL, docs

RULES = vocabulary_text(public_tokenizers.path(BYTE_VOCABULARY))
MODEL = Path(public_tokenizers.path(PIECE_MODEL)).read_bytes()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_str(RULES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def entries(libraries):
    a, b = libraries
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def of_a(i):
        return bytes(back[c] for c in a.id_to_token(i))

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return of_a, of_b


def grouped(libraries, text):
    """The groups of a text, each with the ids of both, by whole texts and plain loops."""
    a, b = libraries
    of_a, of_b = entries(libraries)
    if not text:
        return []
    left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    if b"".join(map(of_a, left)) != raw or b"".join(map(of_b, right)) != raw:
        return []
    ends = [defaultdict(int), defaultdict(int)]
    for side, ids, of in ((0, left, of_a), (1, right, of_b)):
        at = 0
        for n, i in enumerate(ids):
            at += len(of(i))
            ends[side][at] = n + 1
    out, i, j = [], 0, 0
    for at in sorted(set(ends[0]) & set(ends[1])):
        out.append((left[i : ends[0][at]], right[j : ends[1][at]]))
        i, j = ends[0][at], ends[1][at]
    return out


def expected(libraries, rows):
    texts = [(r[0], grouped(libraries, r[1])) for r in rows]
    counts = Counter(p for _, own in texts for p in {(x, y) for a, b in own for x in a for y in b})
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = Counter()
    for name, own in texts:
        links = [(x, y) for a, b in own for x in a for y in b]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out[
            name,
            sum(len(a) for a, _ in own),
            sum(len(b) for _, b in own),
            len(own),
            len(links),
            sum(counts[p] == highest[p[0]] for p in links),
            sum(counts[p] for p in links),
            hashlib.sha256(written.encode()).hexdigest() if own else "",
        ] += 1
    return out


def found(frame):
    assert frame.columns == COLUMNS
    return Counter(tuple(r) for r in frame.collect())


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\nb \n c", "<|endoftext|> <s> </s> <unk> <0x41>", "▁", "a ▁b", "a▁ b", "déjà  vu été", "é a",
    "x\x00y", "﻿a b", "don't I'LL 're", "😀 ok 😀😀", "　 a\xa0 b", "aaaa" * 500, "ｆｕｌｌ ﬁ", "tab\t a", "١٢٣ 四五 六", "a\r\n b", "́ a",
    "0123456789" * 30, " ".join(["the cat"] * 50), "x" * 3000 + " y", "é a", "a \x1c b", "trailing\n", "A  ", "\n a",
]


def test_odd_texts(spark, libraries):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "a  b"), (3, "the cat")]
    assert found(alignment.align(docs(spark, rows), RULES, MODEL)) == expected(libraries, rows)


def test_random_texts(spark, libraries):
    rng = random.Random(3)
    letters = "abe  \n.,'<>|1é▁中́   😀T"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    assert found(alignment.align(docs(spark, rows), RULES, MODEL)) == expected(libraries, rows)


@pytest.mark.parametrize("most", [0, 50, 1_000_000])
def test_given_texts_with_any_table_of_pairs(spark, libraries, monkeypatch, most):
    monkeypatch.setattr(alignment, "TABLE_PAIRS", most)
    monkeypatch.setattr(alignment, "COUNTED_PAIRS", 1_000_000 if most else 500)
    monkeypatch.setattr(alignment, "REMEMBERED", 100_000 if most else 10)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]  # a text counts as often as it occurs
    assert found(alignment.align(docs(spark, rows), RULES, MODEL)) == expected(libraries, rows)


def test_wide_groups_are_reduced_to_their_ids(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "_WIDE", 2)
    rows = [(i, t) for i, t in enumerate(ODD)]
    assert found(alignment.align(docs(spark, rows), RULES, MODEL)) == expected(libraries, rows)


def test_empty_table_and_other_columns(spark, libraries):
    assert found(alignment.align(docs(spark, []), RULES, MODEL)) == Counter()
    rows = docs(spark, [(1, "one two"), (2, None)])
    for name in ("key", "copies", "pairs", "times", "pair", "docs", "n_a", "best", "a"):
        rows = rows.withColumn(name, F.lit("own"))
    assert found(alignment.align(rows, RULES, MODEL)) == expected(libraries, [(1, "one two"), (2, None)])


def test_texts_are_shuffled_once_and_aligned_once(spark):
    rows = docs(spark, [(i, "the same text") for i in range(50)])
    assert found(alignment.align(rows, RULES, MODEL)).total() == 50
    batch = pa.RecordBatch.from_pydict({"key": [b"k"], "copies": [50], "text": [b"the same text"]})
    (row,) = alignment._aligned(alignment.Aligner(RULES, MODEL), batch).to_pylist()
    counted = pa.Table.from_batches(alignment._count_pairs([pa.RecordBatch.from_pylist([row])]))
    assert set(counted["docs"].to_pylist()) == {50}


def test_limits_change_nothing_within_a_task(libraries, monkeypatch):
    texts = [t.encode() for t in ODD if t] + [b"one text more, and the cat"] * 3
    batch = pa.RecordBatch.from_pydict({"key": [bytes([i]) for i in range(len(texts))], "copies": [1] * len(texts), "text": texts})
    own = alignment.Aligner(RULES, MODEL)
    whole = alignment._aligned(own, batch)
    counts = pa.Table.from_batches(alignment._count_pairs([whole])).sort_by("pair")
    monkeypatch.setattr(alignment, "_WIDE", 2)
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    monkeypatch.setattr(alignment, "_TOGETHER", 2)
    monkeypatch.setattr(alignment, "COUNTED_PAIRS", 10)
    parts = [alignment._aligned(own, batch.slice(i, 2)) for i in range(0, batch.num_rows, 2)]
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches([whole]).to_pylist()
    several = pa.Table.from_batches(alignment._count_pairs(parts))
    assert len(several) > len(counts)
    assert several.group_by("pair").aggregate([("docs", "sum")]).sort_by("pair")["docs_sum"].to_pylist() == counts["docs"].to_pylist()
