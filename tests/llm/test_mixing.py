from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing
from tests.llm.helpers import docs, words


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    weights = [40, 5, 3, 1, 1]
    names = ["big", "mid", "low", "tiny", None]
    rows = []
    for i in range(n):
        source = rng.choices(names, weights)[0]
        rows.append((i, " ".join("w" * rng.randint(0, 30) + "x" for _ in range(int(rng.lognormvariate(2, 1)))), "xx", source))
    return rows


def goals(sizes, weights=(1, 2, 3), most=3):
    """Share, stop what is above, share what is left again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_sources, out = sum(sizes.values()), set(order), {}
    while open_sources:
        shared = sum(weight[s] for s in open_sources)
        above = {s for s in open_sources if left * weight[s] > most * sizes[s] * shared}
        if not above:
            out |= {s: left * weight[s] / shared for s in open_sources}
            break
        out |= {s: most * sizes[s] for s in above}
        left -= sum(most * sizes[s] for s in above)
        open_sources -= above
    return out


def sizes_of(rows):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(words(text))
    return sizes


def test_targets_and_copies(spark):
    rows = corpus()
    found = {r.doc_id: r for r in mixing.mix(docs(spark, rows)).collect()}
    sizes = sizes_of(rows)
    target = goals(sizes)
    assert any(target[s] == 3 * sizes[s] for s in target) and any(target[s] < sizes[s] for s in target)
    taken, largest = defaultdict(int), defaultdict(int)
    for i, text, _, source in rows:
        r = found[i]
        assert r.size == len(words(text)) and r.source_size == sizes[source]
        assert r.target == pytest.approx(target[source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        rate = target[source] / sizes[source]
        assert int(rate) <= r.copies <= int(rate) + 1
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    for s in target:
        assert abs(taken[s] - target[s]) <= max(2 * largest[s], 0.02 * target[s])


def test_reruns_agree_however_rows_are_dealt(spark):
    rows = corpus(2, 300)
    one, two = ({r.doc_id: r.copies for r in mixing.mix(docs(spark, x, p)).collect()} for x, p in ((rows, 1), (rows[::-1], 7)))
    assert one == two


def test_odd_rows(spark):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (None, "x y", None, "b"), (None, "x y", None, "b"), (3, "x", None, None), (3, "x", None, None), (4, "", None, "c")]
    found = mixing.mix(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    assert {r.source: r.source_size for r in found} == {"a": 0, "b": 4, None: 2, "c": 0}
    assert all(r.target == 0 and r.copies == 0 for r in found if r.source in ("a", "c"))
    # Both sources that have words share all six of them, by their weights 2 and 1.
    assert {r.source: r.target for r in found if r.source_size} == {"b": 4.0, None: 2.0}
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, None, None)])).first().copies == 0


def test_weights_and_seed_are_parameters(spark):
    rows = corpus(3, 400)
    found = mixing.mix(docs(spark, rows), weights=(5, 1), most=2, seed="other").collect()
    target = goals(sizes_of(rows), (5, 1), 2)
    assert all(r.target == pytest.approx(target[r.source]) and r.copies <= 2 for r in found)


def test_emits_each_document_as_often_as_it_is_taken(spark):
    rows = corpus(4, 300)
    frame = docs(spark, rows)
    copies = {r.doc_id: r.copies for r in mixing.mix(frame).collect() if r.copies}
    out = mixing.emit(frame)
    assert out.columns == frame.columns
    assert Counter(r.doc_id for r in out.collect()) == copies
    assert out.filter(F.col("size") != "own size").count() == 0


def test_no_python_in_the_plan(spark):
    plan = mixing.emit(docs(spark, corpus(5, 50)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
