from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ngram_join
from tests.llm.helpers import docs, groups, invented, sentence, words


def shingles(text, width=5):
    own = words(text)
    return {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()


def classes(rows, num=4, den=5):
    """The links of each row, and the rows of its class, by row number."""
    sets = [shingles(text) for _, text, *_ in rows]
    links = [
        (a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num
    ]
    top = groups(range(len(rows)), links)
    counts = Counter(x for link in links for x in link)
    return [(counts[r], [x for x in top if top[x] == top[r]]) for r in range(len(rows))]


def expected(rows, num=4, den=5):
    out = Counter()
    for (name, *_), (links, own) in zip(rows, classes(rows, num, den)):
        least = min((rows[x][0] for x in own if rows[x][0] is not None), default=None)
        out[name, links, least, least is None or name == least] += 1
    return out


def found(frame, **how):
    return Counter((r.doc_id, r.n_links, r.class_id, r.kept) for r in ngram_join.similar_documents(frame, **how).collect())


def corpus(seed=2):
    rng, vocabulary = random.Random(seed), invented(seed)
    rows, i = [], 0
    passage = sentence(rng, vocabulary, 60)
    for size in (1, 1, 2, 3, 12, 40):
        base = sentence(rng, vocabulary, 150).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((i, " ".join(own)))
            i += 1
    for _ in range(30):  # documents that share a passage only
        rows.append((i, sentence(rng, vocabulary, 60) + " " + passage + " " + sentence(rng, vocabulary, 60)))
        i += 1
    rows += [(i + k, rows[9][1]) for k in range(6)]
    rows.append((i + 6, "  \n".join(words(rows[9][1]))))  # the same words
    return rows


def test_equals_all_pairs(spark):
    rows = corpus()
    assert found(docs(spark, rows)) == expected(rows)


def test_split_buckets_and_blocks_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = corpus(3)
    assert found(docs(spark, rows)) == expected(rows)


def test_measured_recall_where_buckets_are_split(spark, monkeypatch):
    """Pairs right above the threshold, in documents that crowd the buckets by a passage."""
    monkeypatch.setattr(ngram_join, "SMALL", 8)
    rng, vocabulary = random.Random(8), invented(8)
    passage, rows = sentence(rng, vocabulary, 40), []
    for i in range(150):
        own = sentence(rng, vocabulary, 100).split()
        other = list(own)
        for at in range(3):  # each changed word changes five of the 138 shingles
            other[10 + 30 * at] = "changed"
        rows += [(2 * i, passage + " " + " ".join(own)), (2 * i + 1, passage + " " + " ".join(other))]
    sets = [shingles(text) for _, text in rows]
    assert all(0.8 <= len(a & b) / len(a | b) <= 0.82 for a, b in zip(sets[::2], sets[1::2]))
    links = sum(r.n_links for r in ngram_join.similar_documents(docs(spark, rows)).collect())
    assert 0.99 * 300 <= links <= 300


def test_crowded_group_over_several_blocks(spark):
    """Every two classes of one group are linked, within a block and across blocks."""
    rng, n = random.Random(9), 3 * ngram_join.BLOCK
    base = invented(9, 60)
    rows = [(i, " ".join([*base[:30], f"x{i}", *base[30:], f"y{i}"])) for i in range(n)]
    rng.shuffle(rows)
    got = ngram_join.similar_documents(docs(spark, rows)).collect()
    sets = [shingles(text) for _, text in rows[:2]]
    linked = len(sets[0] & sets[1]) * 5 >= len(sets[0] | sets[1]) * 4
    assert {(r.n_links, r.class_id) for r in got} == ({(n - 1, 0)} if linked else {(0, r.class_id) for r in got})
    assert linked


@pytest.mark.parametrize("columns", [3, 2048])
def test_linked_sets_of_two_sides(monkeypatch, columns):
    monkeypatch.setattr(ngram_join, "COLUMNS", columns)
    rng = random.Random(1)
    sets = [np.unique(np.array([rng.randint(0, 12) for _ in range(rng.randint(1, 14))], np.uint64)) for _ in range(40)]
    sets += [np.array([999], np.uint64), np.array([2**64 - 1], np.uint64)]

    def plain(a, b):
        a, b = set(a.tolist()), set(b.tolist())
        return len(a & b) * 5 >= len(a | b) * 3

    for left, right in [(sets, sets), (sets[:15], sets[15:]), (sets[:1], sets[1:2]), (sets[:1], sets[1:]), (sets[-1:], sets[:4]), (sets[:2], sets[:2])]:
        got, expected = ngram_join._linked(left, right, Fraction(3, 5)), np.array([[plain(a, b) for b in right] for a in left])
        if left is right:
            np.fill_diagonal(got, True)
        assert (got == expected).all()
    assert ngram_join._linked(two := sets[:2], two, Fraction(3, 5))[0, 1] == plain(*two)


def test_short_empty_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, "one two"), (2, "one  two\n"), (3, "two one"), (4, ""), (5, ""), (6, None), (7, " \t"), (8, "a b c d e"), (9, "a b c d e f"),
        (10, "a b c d e"), (11, long), (12, long + " end"), (13, long[:60_000]),
    ]
    assert found(docs(spark, rows)) == expected(rows)


CLASHING = ("id", "__id", "h", "h2", "key", "row", "told", "stays", "stay_id", "__at", "__maybe", "__gone", "__several", "__word", "__bits", "__place", "component", "n")
TEXT = "a b c d e f g h"
REPEATED = [
    (1, TEXT), (5, TEXT), (1, "q r s t u v"), (6, "q r s t u v"), (2, "alone in the world of words"), (2, TEXT), (None, TEXT), (None, None), (None, None),
    (None, "only without an id, twice"), (None, "only without an id, twice"), (3, ""), (3, ""), (4, "x y z"), (4, "x y z"),
]


def test_repeated_and_missing_ids(spark):
    assert found(docs(spark, REPEATED)) == expected(REPEATED)


def test_no_row_goes_for_its_id_alone(spark):
    """One row of each class stays, the one with the least id, and all rows of other texts."""
    frame = docs(spark, REPEATED)
    for name in CLASHING:
        frame = frame.withColumn(name, F.lit("own"))
    kept = ngram_join.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == sorted(
        [(1, TEXT), (1, "q r s t u v"), (2, "alone in the world of words"), (0, ""), (0, ""), (0, "only without an id, twice"), (3, ""), (3, ""), (4, "x y z")]
    )
    assert kept.filter(" OR ".join(f"`{c}` <> 'own'" for c in CLASHING)).count() == 0


def test_empty_table(spark):
    assert found(docs(spark, [])) == Counter()


@pytest.mark.parametrize("depth", [1, 3])
def test_runs_meet_the_recall(depth):
    together = 1.0
    import math

    for _ in range(depth):
        together = 1 - math.exp(-together)
    assert 1 - (1 - together) ** ngram_join.runs_for(0.999, depth) >= 0.999


def test_one_of_each_group_stays_with_all_columns(spark):
    rows = corpus(4) + [(0, corpus(4)[0][1])]
    frame = docs(spark, rows)
    kept = ngram_join.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    stay = {min(rows[x][0] for x in own) for _, own in classes(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(stay)
    assert kept.filter(F.col("size") != "own size").count() == 0
