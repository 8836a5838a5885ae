from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import mixing, quality_rules, toxicity
from millrace.llm.queries import vocabulary_text
from tests.llm.helpers import SMALL
from tests.llm.test_ngram_join import expected as near_duplicates
from tests.llm.test_quality_rules import plain


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, written and read as a run does."""
    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet").cache(), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        seen.append((name, docs, out))
        docs = out
    return seen


def test_stages_are_these_in_this_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "quality rules", "n-gram Jaccard join", "mixing sources", "BPE encoding"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count()


def test_toxic_documents_go(spark, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scored = toxicity.score(toxicity.train(before, labels), before).filter("predicted = 0")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in scored.collect())


def test_poor_documents_go(spark, stages):
    _, before, after = stages[1]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rules = quality_rules.learn(quality_rules.with_statistics(before), labels)
    judged = quality_rules.judge(quality_rules.with_statistics(before), rules).filter("__kept")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in judged.collect())
    for r in after.collect():
        found = plain(r.text)
        assert found["n_words"] >= 50 and 100 * found["n_repeat_words"] <= 50 * found["n_words"]


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    stay = [i for i, _, _, kept in near_duplicates(rows).elements() if kept]
    assert sorted(r.doc_id for r in after.collect()) == sorted(stay)


def test_sources_are_mixed(stages):
    _, before, after = stages[3]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == copies


def test_what_is_left_is_encoded(spark, stages):
    _, before, after = stages[4]
    library = Tokenizer.from_str(vocabulary_text())

    def digest(text):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded))

    expected = sorted((r.doc_id, *digest(r.text)) for r in before.collect())
    assert sorted(tuple(r) for r in after.collect()) == expected
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted(tuple(r) for r in whole.collect()) == expected


def test_stages_take_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    for rows in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, SMALL).count() in (0, 2)
