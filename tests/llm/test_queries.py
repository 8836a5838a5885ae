from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from millrace.llm import queries
from tests.conftest import assert_same, oracle
from tests.llm.helpers import SMALL


def test_each_operator_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), oracle(SMALL).sql(queries.ORACLE[name]))


COLUMNS = {
    "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_license_scan": ["doc_id", "license", "start_word", "n_words", "containment", "license_id", "best"],
    "op5_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"],
    "op10_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_returns_its_columns_for_every_document(spark, name):
    frame = queries.QUERIES[name](spark, SMALL)
    assert frame.columns == COLUMNS[name]
    ids = [r.doc_id for r in frame.select("doc_id").collect()]
    if name != "op4_license_scan":
        assert sorted(ids) == [r[0] for r in oracle(SMALL).sql("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
