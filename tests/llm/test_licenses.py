from __future__ import annotations

import random
import re
from fractions import Fraction

import pyarrow as pa
import pytest

from millrace.llm import license_texts, licenses
from tests.llm.helpers import docs, invented, sentence


def tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def plain(text, templates, width=5, share=Fraction(4, 5)):
    """The same windows, all of them compared."""
    own = tokens(text)
    runs = [tuple(own[i : i + width]) for i in range(len(own) - width + 1)]
    out = []
    for length in licenses.prepare(templates, width, share, 0.9999):
        for name in length.names:
            words = tokens(templates[name])
            known = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
            merged = []
            for s in range(0, len(runs), length.block):
                inside = [i for i in range(s, min(s + 3 * length.block, len(runs))) if runs[i] in known]
                held = len({runs[i] for i in inside})
                if held >= share * len(known):
                    place = [inside[0], inside[-1] + width, held / len(known)]
                    if merged and place[0] <= merged[-1][1]:
                        merged[-1] = [merged[-1][0], max(merged[-1][1], place[1]), max(merged[-1][2], place[2])]
                    else:
                        merged.append(place)
            out += [(name, s, e - s, c) for s, e, c in merged]
    return sorted(out)


def found(frame, **how):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.license, r.start_word, r.n_words, r.containment) for r in licenses.scan(frame, **how).collect())


def test_equals_all_windows(spark):
    rng, vocabulary = random.Random(4), invented(4)
    names = sorted(licenses.TEMPLATES)
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 3)):
            parts.append(sentence(rng, vocabulary, rng.randint(0, 120)))
            notice = licenses.TEMPLATES[rng.choice(names)].split()
            for _ in range(rng.randint(0, 2)):
                notice[rng.randrange(len(notice))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                notice.insert(rng.randrange(len(notice)), rng.choice(vocabulary))
            parts.append(" ".join(notice))
        rows.append((i, "\n".join([*parts, sentence(rng, vocabulary, rng.randint(0, 90))])))
    expected = sorted((i, *m) for i, text in rows for m in plain(text, licenses.TEMPLATES))
    result = found(docs(spark, rows))
    assert [r[:4] for r in result] == [e[:4] for e in expected]
    assert [r[4] for r in result] == pytest.approx([e[4] for e in expected])
    assert len(result) > 40


def test_each_notice_is_found_whatever_its_case_and_punctuation(spark):
    rows = [(i, "before it\n" + text.upper().replace(",", " -- ") + " after") for i, (_, text) in enumerate(sorted(licenses.TEMPLATES.items()))]
    result = found(docs(spark, rows))
    assert {(i, name) for i, name, *_ in result} >= set(enumerate(sorted(licenses.TEMPLATES)))


def test_odd_texts(spark):
    notice = "Released under the MIT License."
    long = "word " * 60_000 + notice + " word" * 60_000
    rows = [(1, None), (2, ""), (3, "MIT License"), (4, notice), (4, notice), (None, notice), (5, long)]
    assert [r[:3] for r in found(docs(spark, rows), templates={"MIT line": notice})] == [
        (-1, "MIT line", 0), (4, "MIT line", 0), (4, "MIT line", 0), (5, "MIT line", 60_000),
    ]
    assert found(docs(spark, [])) == []


def test_templates_are_a_parameter(spark):
    with pytest.raises(ValueError, match="fewer"):
        licenses.scan(docs(spark, []), {"short": "two words"})
    assert found(docs(spark, [(1, "x all rights reserved by us y")]), templates={"own": "All rights reserved by us"}) == [(1, "own", 1, 5, 1.0)]


@pytest.mark.parametrize("shortest, block", [(1, 1), (8, 8), (40, 32)])
def test_bands_make_it_sure(shortest, block):
    share = Fraction(4, 5)
    bands = licenses.bands_for(shortest, block, share, 0.9999)
    held = -(-shortest * share.numerator // share.denominator)
    assert 1 - (1 - held / (3 * block + shortest - held)) ** bands >= 0.9999


def test_short_templates_are_one_shingle_of_all_their_words(spark):
    rows = [(1, "was released under the MIT License today"), (2, "under the\nMIT"), (3, "licence under"), (4, "MIT License, then under the mit license.")]
    own = {"line": ("under the MIT License", "licence")}
    assert found(docs(spark, rows), templates=own, short=True) == [(1, "line", 2, 4, 1.0), (3, "line", 0, 1, 1.0), (4, "line", 3, 4, 1.0)]


def test_the_declared_list_knows_the_usual_families(spark):
    lines = {
        "MIT line": "It is distributed under the MIT licence, as is.", "CC-BY line": "Licensed under CC BY 4.0.",
        "CC-BY-SA line": "This work is available under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "LGPL line": "Published under the GNU Lesser General Public License.", "AGPL line": "Made available under the AGPLv3",
        "GPL line": "Use is subject to the terms of the GNU General Public License, version 2", "EPL line": "under the EPL 2.0",
    }
    wholes = {name: "before it " + text + " after it" for name, text in license_texts.TEXTS.items()}
    conditions = {"BSD third condition": license_texts._BSD_THIRD.replace("the copyright holder", "Some Firm"), "BSD-2-Clause": license_texts.HEADERS["BSD-2-Clause"]}
    wanted = list((lines | wholes | conditions).items())
    rows = [(i, text) for i, (_, text) in enumerate(wanted)]
    every = licenses.merged(licenses.TEMPLATES, license_texts.ALL)
    result = {(i, name) for i, name, *_ in found(docs(spark, rows), templates=every, short=True)}
    assert result >= {(i, name) for i, (name, _) in enumerate(wanted)}
    plain_rows = [(1, "the MIT professors went under the bridge"), (2, "a general public, under a license of its own")]
    assert found(docs(spark, plain_rows), templates=every, short=True) == []


CONFUSED = {
    "BSD-3-Clause": license_texts.HEADERS["BSD-3-Clause"], "BSD-2-Clause": license_texts.HEADERS["BSD-2-Clause"],
    "GFDL-1.2": license_texts.TEXTS["GFDL-1.2 text"], "GFDL-1.3": license_texts.TEXTS["GFDL-1.3 text"],
    "LGPL-2.0": license_texts.TEXTS["LGPL-2.0 text"], "LGPL-2.1": license_texts.TEXTS["LGPL-2.1 text"],
    "GPL-3.0": license_texts.HEADERS["GPL-3.0 header"], "GPL-2.0": license_texts.HEADERS["GPL-2.0 header"],
    "AGPL-3.0": license_texts.HEADERS["AGPL-3.0"], "MIT": license_texts.HEADERS["MIT text"], "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
}


def test_the_best_match_names_the_license(spark):
    rows = [(i, f"before it {text} after it") for i, text in enumerate(CONFUSED.values())]
    every = licenses.merged(licenses.TEMPLATES, license_texts.ALL)
    result = licenses.scan(docs(spark, rows), templates=every, short=True).collect()
    whole = {}
    for r in result:
        if r.best and r.n_words > whole.get(r.doc_id, (0, None))[0]:
            whole[r.doc_id] = r.n_words, r.license_id
    assert [whole[i][1] for i in range(len(rows))] == list(CONFUSED)
    assert sum(not r.best for r in result) >= 10


def test_best_is_chosen_among_overlapping_matches_of_a_family_alone():
    matches = [
        (0, "GPL-2.0 text", 0, 100, 0.9), (0, "GPL-3.0 text", 50, 100, 0.95), (0, "MIT", 60, 10, 0.8), (0, "LGPL line", 160, 4, 1.0),
        (1, "GPL-2.0 text", 0, 100, 0.9), (1, "MIT", 5, 10, 1.0), (1, "MIT text", 0, 30, 1.0), (1, "MIT warranty", 30, 5, 0.8),
    ]
    assert licenses.best_of_families(matches) == [False, True, True, True, True, False, True, True]
    assert licenses.best_of_families([]) == []


def test_names_of_two_lists_must_differ():
    with pytest.raises(ValueError, match="share the names"):
        licenses.merged({"a": "x"}, {"b": "y", "a": "z"})


def test_marks_leave_out_no_match(spark):
    """The whole list over texts full of licenses and over plain ones, against all windows."""
    rng, vocabulary = random.Random(9), invented(9)
    whole = {n: t for n, t in (license_texts.HEADERS | license_texts.TEXTS).items() if isinstance(t, str)}
    some = {n: whole[n] for n in ("GPL-1.0 text", "Artistic-1.0 text", "BSD-2-Clause", "BSD-3-Clause", "BSD warranty", "MIT text", "MIT warranty")}
    rows = [(0, " ".join(some.values())), (1, sentence(rng, vocabulary, 3000))]
    for i, text in enumerate(some.values()):
        changed = [w if rng.random() > 0.02 else rng.choice(vocabulary) for w in text.split()]
        rows.append((2 + i, " ".join([sentence(rng, vocabulary, 50), *changed])))
    expected = sorted((i, *m) for i, text in rows for m in plain(text, some))
    result = found(docs(spark, rows), templates=some)
    assert [r[:4] for r in result] == [e[:4] for e in expected]
    assert len(result) > 10
