from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import quality_rules as Q
from tests.llm.helpers import SMALL, docs, invented, labels, sentence, words


def plain(text):
    text = text or ""
    own = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    runs = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    covered = {i + k for i in range(len(own) - 2) if runs[tuple(own[i : i + 3])] > 1 for k in range(3)}
    return {
        "n_words": len(own), "word_chars": sum(map(len, own)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text), "n_digits": sum("0" <= c <= "9" for c in text), "n_distinct": len(set(own)),
    }


def measured(spark, rows):
    return Q.with_statistics(docs(spark, rows)).select("doc_id", *(f"__{n}" for n in Q.STATISTICS)).collect()


def test_statistics_of_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts = dict(rows)
    for r in measured(spark, rows):
        assert {k: r[f"__{k}"] for k in plain("")} == plain(texts[r.doc_id])


ODD = [
    None, "", " \n\t", "one", "a b c", "a b c a b c", "a a a a", "x y z\nx y z\n\nx y z", "l\r\nl\n l\nl", "é\x0bü\x1c| <b>\n" * 3,
    "# " * 70_000, "a\xa0b a\xa0b a\xa0b", "A!! B?? 12", "\n\n", "last line\nlast line", "ab c a bc",
]


def test_statistics_of_odd_texts(spark):
    found = {r.doc_id: r for r in measured(spark, list(enumerate(ODD)))}
    for i, text in enumerate(ODD):
        assert {k: found[i][f"__{k}"] for k in plain("")} == plain(text), text and text[:40]
    assert found[12]["__n_marks"] == 2


def corpus(seed=1, n=700):
    rng, vocabulary = random.Random(seed), invented(7)
    rows, marks = [], []
    for i in range(n):
        kind = rng.choice(["good"] * 4 + ["symbols", "lines"])
        text = sentence(rng, vocabulary, rng.randint(60, 150))
        if kind == "symbols":
            text = " ".join(w + rng.choice(["", "###", "$$"]) for w in text.split())
        if kind == "lines":
            text += "\n" + "\n".join([sentence(rng, vocabulary, 7)] * 3 + [sentence(rng, vocabulary, 60)])
        rows.append((i, text))
        marks.append((i, int(kind == "good")))
    return rows, marks


def test_learned_list_judges_unseen_documents(spark):
    rows, marks = corpus()
    rules = Q.learn(Q.with_statistics(docs(spark, rows)), labels(spark, marks, "quality"))
    assert 2 <= len(rules.rules) <= 6
    rows, marks = corpus(2)
    truth = dict(marks)
    judged = Q.judge(Q.with_statistics(docs(spark, rows)), rules).collect()
    assert not any(r["__base_failed"] for r in judged)
    assert all(r["__kept"] == (r["__rule"] == 0) for r in judged)
    assert np.mean([r["__kept"] == bool(truth[r.doc_id]) for r in judged]) > 0.97


def test_first_covering_rule_is_named(spark):
    rules = Q.DecisionList(((Q.Condition("words", True, 100.0),), (Q.Condition("words", True, 3.0), Q.Condition("symbol_ratio", False, 0.5))))
    rows = [(1, "a " * 120), (2, "a b c"), (3, "# # # #"), (4, "a"), (5, None)]
    judged = Q.judge(Q.with_statistics(docs(spark, rows)), rules).collect()
    assert {r.doc_id: r["__rule"] for r in judged} == {1: 1, 2: 2, 3: 0, 4: 0, 5: 0}
    # The expression covers what the conditions cover in numpy, where the rules are learned.
    assert [str(c) for c in rules.rules[1]] == ["words >= 3.0", "symbol_ratio < 0.5"]


@pytest.mark.parametrize("marks", [[], [(1, 1), (2, 1)], [(1, 0), (2, 0)], [(1, None), (None, 0)]])
def test_nothing_to_learn_keeps_everything_but_base_failures(spark, marks):
    rows = [(i, sentence(random.Random(i), invented(1), 80)) for i in range(5)] + [(9, "too short"), (10, None), (11, "a b c " * 40)]
    frame = docs(spark, rows)
    kept = Q.drop_poor(frame, labels(spark, marks, "quality"))
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(5))


def test_base_rules_at_their_limits(spark):
    distinct = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(distinct[:50])), (2, " ".join(distinct[:49])), (3, " ".join(distinct[:30] + ["a", "b", "c"] * 10)), (4, " ".join(distinct[:30] + ["a", "b", "c"] * 11))]
    judged = {r.doc_id: r["__base_failed"] for r in Q.judge(Q.with_statistics(docs(spark, rows)), Q.DecisionList(())).collect()}
    assert judged == {1: False, 2: True, 3: False, 4: True}


def test_covering_is_precise_and_stops():
    rng = np.random.default_rng(1)
    values = rng.random((600, len(Q.FEATURES)))
    bad = (values[:, 1] > 0.8) | ((values[:, 2] > 0.7) & (values[:, 3] < 0.3))
    rules = Q.cover(values[:400], bad[:400], values[400:], bad[400:])
    covered = np.zeros(len(values), bool)
    for rule in rules:
        covered |= Q._covers(rule, values)
    assert (covered == bad).mean() > 0.9
    assert Q.cover(values[:400], rng.random(400) < 0.1, values[400:], rng.random(200) < 0.1) == []


def test_filter_and_no_documents(spark):
    rows, marks = corpus()
    frame = docs(spark, rows + [(None, None), (None, rows[0][1])])
    kept = Q.drop_poor(frame, labels(spark, marks, "quality"))
    stay = {r.doc_id for r in kept.collect()}
    good = {i for i, m in marks if m}
    assert len(good & stay) > 0.99 * len(good) and len(stay - good) < 0.05 * len(rows)
    assert Q.drop_poor(docs(spark, []), labels(spark, marks, "quality")).count() == 0
