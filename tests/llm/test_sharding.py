from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import sharding
from tests.llm.helpers import docs


def best(key, weights):
    scores = []
    for i, w in enumerate(weights):
        if w > 0:
            digits = int(hashlib.md5(f"{'' if key is None else key}:{i}".encode()).hexdigest()[:13], 16)
            scores.append((math.log((digits + 0.5) / 2**52) / w, -i))
    return -max(scores)[1]


ROWS = [(i, "text " * (i % 5) + "é") for i in range(700)] + [(701, None), (702, ""), (None, "x"), (3, "again"), (3, "again")]


def test_shards_slots_and_digests(spark):
    found = sharding.assign(docs(spark, ROWS)).collect()
    assert len(found) == len(ROWS)
    texts = defaultdict(list)
    for i, text in ROWS:
        texts[i].append((len((text or "").encode()) + 1, zlib.crc32((text or "").encode())))
    told = defaultdict(list)
    slots = defaultdict(list)
    for r in found:
        told[r.doc_id].append((r.size, r.text_crc32))
        assert r.shard == best(r.doc_id, [1] * 16) and r.grown_shard == best(r.doc_id, [1] * 17) and r.law == "key"
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert {k: sorted(v) for k, v in told.items()} == {k: sorted(v) for k, v in texts.items()}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))


def test_weights_share_the_keys(spark):
    weights = [1.0, 3.0, 0.0, 2.0]
    keys = spark.range(6000).select(sharding.shard_of(F.col("id"), weights).alias("s"))
    counts = Counter(r.s for r in keys.collect())
    assert set(counts) == {0, 1, 3}
    assert [counts[k] / 6000 for k in (0, 1, 3)] == pytest.approx([1 / 6, 3 / 6, 2 / 6], abs=0.03)


def test_a_heavier_shard_only_gains(spark):
    rows = spark.range(2000).select(
        sharding.shard_of(F.col("id"), [1.0, 1.0, 1.0]).alias("a"), sharding.shard_of(F.col("id"), [1.0, 2.0, 1.0]).alias("b")
    )
    assert rows.filter("a <> b AND b <> 1").count() == 0 < rows.filter("a <> b").count()


def test_no_documents_and_no_weights(spark):
    assert sharding.assign(docs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="weight"):
        sharding.assign(docs(spark, []), weights=[0.0])


def test_files_per_shard(spark, tmp_path):
    frame = docs(spark, ROWS)
    sharding.write_shards(frame, str(tmp_path / "out"), weights=[1.0] * 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS)
    assert all(r.shard == best(r.doc_id, [1] * 4) for r in back.collect())


def test_no_python_in_the_plan(spark):
    plan = sharding.assign(docs(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
