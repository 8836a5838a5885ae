from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe
from millrace.llm.queries import vocabulary_text
from tests.llm.helpers import SMALL, docs


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(vocabulary_text())


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(vocabulary_text())


def encoded(vocab, texts):
    encoder = bpe.Encoder(vocab)
    pieces = [t.encode().split() for t in texts]
    encoder.learn(pieces)
    return [tuple(x.decode() for x in encoder.encode(p)) for p in pieces]


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


ALPHABET = "abcdeinrst AEIS'.,!?09 \t\n\r\x0b\x0c\x1c\x85\xa0éÉüßñσςΣİı你ﬁ́̀😀<|>_-#\x00½Ⅷ"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=60))
def test_any_text_is_encoded_as_the_library_does(vocab, library, text):
    assert encoded(vocab, [text]) == [expected(library, text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeinrsth"), min_size=1, max_size=24), max_size=8))
def test_words_that_share_prefixes(vocab, library, words):
    text = " ".join(words)
    assert encoded(vocab, [text]) == [expected(library, text)]


ODD = [
    "", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "x<|endoftext|>Y <|startoftext|>", "<|endoftext", "don't I'LL 're",
    "ΑΣ ΑΣΑ Σ", "x" * 3000, "İstanbul", " ", "a b", "\x1c", "é",
]


def test_odd_texts(vocab, library):
    assert encoded(vocab, ODD) == [expected(library, t) for t in ODD]


def test_forgetting_changes_nothing(vocab, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(vocab)
    for text in ["one two three four", "two five six seven", "one two <|endoftext|>", "three", "one two three four"]:
        pieces = text.encode().split()
        encoder.learn([pieces])
        assert tuple(x.decode() for x in encoder.encode(pieces)) == expected(library, text)


def test_vocabularies_that_the_method_does_not_suit_are_refused():
    rules = json.loads(vocabulary_text())
    rules["model"]["merges"] = [["a", "b"], ["ab", "c"], ["b", "c"], ["a", "bc"]]
    with pytest.raises(ValueError, match="two merges"):
        bpe.Vocabulary(json.dumps(rules))
    rules["model"]["merges"] = [["ab", "c"], ["a", "b"]]
    bpe.Vocabulary(json.dumps(rules | {"model": rules["model"] | {"merges": [["a", "b"], ["ab", "c"]]}}))


def test_table_is_encoded_whole(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate([None, *ODD])] + [(1, rows[1][1]), (None, "no id")]
    out = bpe.encode(docs(spark, rows), vocabulary_text())
    assert out.columns[:4] == ["doc_id", "text", "lang", "source"]
    found = sorted((str(r.doc_id), r.text or "", " ".join(map(str, r.ids)), r.decoded) for r in out.collect())
    assert found == sorted((str(i), t or "", *expected(library, t)) for i, t in rows)
    digests = bpe.encode_digests(docs(spark, rows), vocabulary_text()).collect()
    for r in digests:
        ids, decoded = expected(library, r.text)
        assert r.n_tokens == len(ids.split())
        assert r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(docs(spark, []), vocabulary_text()).count() == 0
