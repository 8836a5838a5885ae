from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import token_files
from millrace.llm.queries import vocabulary_text
from tests.llm.helpers import SMALL, docs


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(vocabulary_text())


def expected(library, rows):
    """Documents in ascending order of ids, nulls first, each with its start."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def found(frame):
    files = token_files.write_files(frame, vocabulary_text())
    rows = token_files.read_files(files).collect()
    return sorted(((r.id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1]), files


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packing_is_undone_by_unpacking(width, data):
    ids = data.draw(st.lists(st.integers(0, (1 << width) - 1), max_size=300))
    packed = token_files.pack(np.array(ids, np.uint32), width)
    assert len(packed) == -(-len(ids) * width // 64)
    assert token_files.unpack(packed, len(ids), width).tolist() == ids


def test_fewest_bits():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65537)] == [1, 1, 2, 8, 9, 16, 17]


@pytest.mark.parametrize("block", [64, 100, 4096])
def test_file_is_read_back_in_any_order(block):
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 700, 0, 5000)]
    writer = token_files.Writer(13, block)
    for k, ids in enumerate(texts):
        writer.add(None if k == 3 else k, ids)
    out = io.BytesIO()
    assert writer.write(out) == sum(map(len, texts))
    assert len(out.getvalue()) < sum(map(len, texts)) * 13 / 8 + 8 * len(texts) * 4 + 16 * (sum(map(len, texts)) // block + 5) + 200
    reader = token_files.Reader(io.BytesIO(out.getvalue()))
    for k in rng.permutation(len(texts)).tolist():
        assert reader.document(k).tolist() == texts[k].tolist()
    whole = np.concatenate(texts)
    for s, e in ((0, len(whole)), (130, 131), (63, 1000), (5, 5)):
        assert reader.slice(s, e).tolist() == whole[s:e].tolist()
    told = list(reader.documents())
    assert [n for n, _ in told] == [0, 1, 2, None, 4, 5, 6, 7]
    assert [x.tolist() for _, x in told] == [x.tolist() for x in texts]


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="bits"):
        token_files.Writer(4).add(1, np.array([16], np.uint32))
    with pytest.raises(ValueError, match="not a file"):
        token_files.Reader(io.BytesIO(b"something else, and long enough"))


def test_round_trip(spark, conf, library):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    result, files = found(docs(spark, rows))
    assert result == expected(library, rows)
    assert files.count() > 1  # several ranges


def test_odd_documents(spark, library):
    rows = [
        (5, None), (3, ""), (-2, " \n\t"), (9, "<|endoftext|>x<|startoftext|>"), (7, " Ünï ΑΣ\x1c!"), (8, "word " * 30_000), (None, "nameless"),
    ]
    result, _ = found(docs(spark, rows))
    assert result == expected(library, rows)


def test_repeated_ids_and_no_documents(spark, library):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, "d e f")]
    result, _ = found(docs(spark, rows))
    assert sorted(r[:1] + r[2:] for r in result) == sorted(e[:1] + e[2:] for e in expected(library, rows))
    assert [r[1] for r in result] == [0, *np.cumsum([r[2] for r in result]).tolist()[:-1]]
    assert found(docs(spark, []))[0] == []


def test_blocks_are_written_as_they_fill(spark, library, monkeypatch):
    out = io.BytesIO()
    writer = token_files.Writer(16, 64, out)
    for k in range(3000):
        writer.add(k, np.full(50, k, np.uint32))
    assert len(out.getvalue()) > 3000 * 50 * 2 - 2 * 64 * 65 and writer.waiting < 64 * 64 and not writer.packed
    assert writer.write() == 150_000
    reader = token_files.Reader(io.BytesIO(out.getvalue()))
    assert reader.document(2999).tolist() == [2999] * 50
    with pytest.raises(ValueError, match="to its end"):
        token_files.Reader(io.BytesIO(out.getvalue()[:-1000]))


def test_long_ranges_make_several_files_and_pieces_are_learned_again(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 100)
    monkeypatch.setattr(token_files, "REMEMBERED", 5)
    monkeypatch.setattr(token_files, "_PIECE", 200)
    rows = [(i, f"some words {i} <|endoftext|> Ünï {i % 3} <|startoftext|>a " * (i % 5)) for i in range(200)]
    result, files = found(docs(spark, rows).coalesce(1))
    assert result == expected(library, rows)
    assert files.count() > 20


LETTERS = "ab AE'.!09\t\x0b\x1c\x85\xa0éÉßςΣİﬁ\u0301\u3000<|>\x00"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(LETTERS), max_size=40), min_size=1, max_size=6))
def test_any_texts_are_encoded_as_the_library_does(library, texts):
    ids, bounds = token_files._encoder(vocabulary_text(), 1).encode(pa.array(texts))
    assert [ids[s:e].tolist() for s, e in zip(bounds, bounds[1:])] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_plain_words_are_encoded_without_marks(monkeypatch):
    encoder = token_files._Encoder(vocabulary_text(), 1)
    marked = []
    together = encoder._together
    monkeypatch.setattr(encoder, "_together", lambda pieces: marked.extend(pieces) or together(pieces))
    texts = ["Some wörds, ÉTÉ naïve ÿ ß don't éa 12 a÷b a×b İx ﬁn a­b </w> x</w>y", None, "", "straße zzzzqqqqxxxx it's 'll ähm <|endoftext|", "ab cd ab cd"]
    ids, bounds = encoder.encode(pa.array(texts))
    library = Tokenizer.from_str(vocabulary_text())
    for text, start, end in zip(texts, bounds, bounds[1:]):
        assert ids[start:end].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 1]
    assert marked and not any(p.decode().isalpha() and p.decode().isascii() for p in marked)
