from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from millrace.llm import embedding_dedup
from tests.llm.helpers import groups

SCHEMA = "vec_id long, embedding array<float>, label int, n string, rep string, `group` string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "n", "rep", "group") for i, v in rows], SCHEMA).repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def expected(rows, threshold=0.9):
    import numpy as np

    own = {r: np.array(v, np.float32).astype(np.float64) for r, (_, v) in enumerate(rows) if usable(v)}
    links = []
    for a in own:
        for b in own:
            if a < b and len(own[a]) == len(own[b]):
                if own[a] @ own[b] / math.sqrt((own[a] @ own[a]) * (own[b] @ own[b])) >= threshold:
                    links.append((a, b))
    top = groups(range(len(rows)), links)
    counts = Counter(x for link in links for x in link)
    out = Counter()
    for r, (name, _) in enumerate(rows):
        least = min((rows[x][0] for x in top if top[x] == top[r] and rows[x][0] is not None), default=None)
        out[name, counts[r], least, least is None or name == least] += 1
    return out


def found(frame, **how):
    rows = embedding_dedup.near_duplicates(frame, **how).collect()
    assert list(rows[0].asDict()) == ["vec_id", "n_links", "component_id", "kept"] if rows else True
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows)


def clustered(seed=5):
    rng = random.Random(seed)
    rows, i = [], 0
    for size in (1, 1, 1, 2, 3, 8, 40):
        centre = [rng.gauss(0, 1) for _ in range(16)]
        for _ in range(size):
            rows.append((i, [x + rng.gauss(0, 0.12) for x in centre]))
            i += 1
    rows += [(i + k, rows[20][1]) for k in range(5)]  # exact copies
    rows += [(i + 5, [2.5 * x for x in rows[3][1]])]  # the same direction
    return rows


def test_equals_all_pairs(spark):
    rows = clustered()
    assert found(table(spark, rows)) == expected(rows)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 3)
    rows = clustered(6)
    assert found(table(spark, rows)) == expected(rows)


def test_odd_vectors_have_no_links(spark):
    good = [1.0, 2.0, 3.0]
    rows = [
        (1, good), (2, good), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, float("nan"), 3.0]),
        (8, [1.0, float("inf"), 3.0]), (9, None), (10, [0.0, 0.0, 0.0]), (11, [1.0, 2.0]), (12, [1.0, 2.0, 3.0, 0.0]),
    ]
    assert found(table(spark, rows)) == expected(rows)


def test_repeated_and_missing_ids(spark):
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (None, [1.0, 0.0]), (None, None), (3, None), (3, None),
        (None, [-1.0, 0.0]), (None, [-1.0, 0.0]), (4, [0.7, -0.7]),
    ]
    assert found(table(spark, rows)) == expected(rows)


def test_empty_table(spark):
    assert found(table(spark, [])) == Counter()


def test_measured_recall_of_pairs_right_above_the_threshold(spark):
    """Pairs met in the tables themselves, among vectors that fill many buckets of many tables."""
    import numpy as np

    rng, n, width = np.random.default_rng(3), 2000, 32
    centres = rng.standard_normal((n, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    across = rng.standard_normal((n, width))
    across -= (across * centres).sum(axis=1, keepdims=True) * centres
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    beside = 0.901 * centres + math.sqrt(1 - 0.901**2) * across
    planes, tables = embedding_dedup.table_shape(2 * n, 0.9, 0.9999)
    assert planes >= 8 and tables >= 20
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([centres, beside]))]
    links = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table(spark, rows)).collect()}
    own = np.array([v for _, v in rows], np.float32).astype(np.float64)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    true = ((own @ own.T) >= 0.9).sum() - len(own)
    assert true >= 2 * n and 0.999 * true <= sum(links.values()) <= true


@pytest.mark.parametrize("n", [10, 10_000, 10**9])
def test_tables_meet_the_recall(n):
    planes, tables = embedding_dedup.table_shape(n, 0.9, 0.9999)
    meet = (1 - math.acos(0.9) / math.pi) ** planes
    assert 1 - (1 - meet) ** tables >= 0.9999
