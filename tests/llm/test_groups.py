from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import batches
from millrace.llm.groups import components, trees
from tests.llm.helpers import groups


def found(spark, links):
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.component for r in rows}


@pytest.mark.parametrize(
    "links",
    [
        [(i, i + 1) for i in range(40)],  # a long path
        [(0, i) for i in range(1, 200)],  # one node with all links
        [(100, i) for i in range(60)] + [(i, i + 1) for i in range(200, 230)] + [(5, 229)],
        [(random.Random(3).randint(0, 10**9) % (i + 7), i) for i in range(150)],
    ],
)
def test_components_equal_a_search(spark, links):
    expected = groups({x for a, b in links if a != b for x in (a, b)}, links)
    assert found(spark, links) == expected


def test_components_leave_out_nulls_and_loops_and_take_repeats(spark):
    assert found(spark, [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None)]) == {1: 1, 2: 1}


def test_components_of_nothing(spark):
    assert found(spark, []) == {}


@pytest.mark.parametrize("share", [0.0, 0.02, 0.1, 1.0])
def test_trees_connect_what_is_linked(share):
    own = np.random.default_rng(4).random((60, 60)) < share
    linked = own | own.T
    np.fill_diagonal(linked, False)
    hung, tops = trees(linked)
    expected = groups(range(60), list(zip(*np.nonzero(linked))))
    assert dict(zip(hung.tolist(), tops.tolist())) == {x: t for x, t in expected.items() if x != t}


def test_groups_come_whole_out_of_any_batches():
    rng = random.Random(1)
    keys = sorted((rng.randint(0, 20), rng.randint(0, 1)) for _ in range(200))
    table = pa.RecordBatch.from_pydict({"a": [k[0] for k in keys], "b": [k[1] for k in keys]})
    for size in (1, 3, 7, 200):
        cut = [table.slice(i, size) for i in range(0, 200, size)]
        seen = []
        for batch, bounds in batches.whole_groups([*cut, table.slice(0, 0)], ["a", "b"]):
            rows = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
            for s, e in zip(bounds[:-1], bounds[1:]):
                assert len(set(rows[s:e])) == 1
                seen.append((rows[s], e - s))
        assert [k for k, n in seen for _ in range(n)] == keys
        assert len(seen) == len(set(keys))
