"""Byte-pair encoding by a traversal of a trie of words.

In byte-pair encoding the last token of a prefix of a word is determined: it is the one
token ending there whose left neighbour, the last token of the prefix before it, does not
merge with it. So a word's state after each symbol is one token, and words that begin alike
go through the same states. Distinct words are put into a trie, which is walked depth first;
each node gets its last token from those of its ancestors, once for all words below it. A
word's encoding is read off backwards along its path.

Vocabulary files are those of the ``tokenizers`` library with a BPE model whose words end
in a suffix, Unicode NFC and lower case as normalisers, and byte-level symbols.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textscan

#: Encodings of words that a task remembers; beyond that it
#: forgets those that it has not met lately.
REMEMBERED = 100_000
#: Texts are encoded together up to this many bytes, as one trie.
_PIECE = 2 << 20

_NEVER = 1 << 60


class Splitter:
    """The rules of a vocabulary file by which texts become words and special tokens."""

    def __init__(self, rules: dict):
        model = rules["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self._specials = regex.compile("|".join(regex.escape(t) for t in self.special) or r"(?!)")
        steps = rules["pre_tokenizer"]["pretokenizers"]
        # Where the file says \s, the library means Unicode's white space.
        self._words = regex.compile(steps[0]["pattern"]["Regex"].replace(r"^\s", r"^\p{White_Space}"))

    def split(self, piece: bytes) -> list[str]:
        """The special tokens and words of a piece of text that has no ASCII white space."""
        if piece.isalpha():  # ASCII letters alone are one word
            return [piece.lower().decode()]
        chunk, out, at = piece.decode(), [], 0
        for found in self._specials.finditer(chunk):
            out += self._plain(chunk[at : found.start()])
            out.append(found.group())
            at = found.end()
        return out + self._plain(chunk[at:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # Lower case goes by single letters; a capital sigma does not look at its place.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self._words.findall(text.lower())


class Vocabulary(Splitter):
    """Tokens and merges of a vocabulary file."""

    def __init__(self, text: str):
        rules = json.loads(text)
        super().__init__(rules)
        model = rules["model"]
        self.made: dict[str, tuple[str, str]] = {}
        self.rank: dict[tuple[str, str], int] = {}
        self.born: dict[str, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[left, right] = rank
            if left + right in self.born:
                raise ValueError(f"two merges make {left + right!r}; the last token of a prefix would not be determined")
            if max(self.born.get(left, -1), self.born.get(right, -1)) >= rank:
                raise ValueError(f"merge {rank} comes before those of its parts")
            self.made[left + right], self.born[left + right] = (left, right), rank
        self._begins = {t[:i] for t in self.ids for i in range(1, len(t) + 1)}
        self._ends: dict[str, tuple[str, tuple[str, ...]]] = {}
        self._closes: dict[str, tuple[str, ...]] = {}
        self._right: dict[str, list[tuple[str, int]]] = {}
        self._left: dict[str, list[tuple[str, int]]] = {}
        self._apart: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The tokens at one edge of ``token`` while it is built, smallest first, each with
        the rank of the merge that takes it up."""
        known = self._right if side else self._left
        if token not in known:
            inner = self.made.get(token)
            known[token] = [(token, _NEVER)]
            if inner:
                below = self._edge(inner[side], side)
                known[token] = [*below[:-1], (inner[side], self.born[token]), (token, _NEVER)]
        return known[token]

    def forget(self, most: int = 200_000) -> None:
        """Empty what was remembered of pairs and endings where it has grown beyond ``most``."""
        for known in (self._apart, self._ends, self._closes):
            if len(known) > most:
                known.clear()

    def apart(self, left: str, right: str, until: int = _NEVER) -> bool:
        """Whether ``left`` and ``right`` side by side are built without a merge across
        their border of a rank below ``until``. Merges happen by rank, and from left to right
        within a rank."""
        if until == _NEVER and (known := self._apart.get((left, right))) is not None:
            return known
        ends, begins = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (a, a_goes), (b, b_goes) = ends[i], begins[j]
            across = self.rank.get((a, b), _NEVER)
            if across < until and across < a_goes and across <= b_goes:
                good = False
                break
            if a_goes == b_goes == _NEVER:
                good = True
                break
            if a_goes <= b_goes:
                i += 1
            else:
                j += 1
        if until == _NEVER:
            self._apart[left, right] = good
        return good

    def stands(self, token: str) -> bool:
        """Whether the symbols of ``token`` alone are merged into just this token."""
        if token not in self._whole:
            inner = self.made.get(token)
            self._whole[token] = not inner or (
                self.stands(inner[0]) and self.stands(inner[1]) and self.apart(*inner, until=self.born[token])
            )
        return self._whole[token]

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[str, ...]]:
        """The tokens of each distinct word, by one depth-first walk through their trie.

        The trie is kept flat: in sorted order a word's path is the one of the word before
        up to where they part, and the states of that stretch are still at hand.
        """
        out: dict[str, tuple[str, ...]] = {}
        last: list[str] = []  # the last token of each prefix on the path from the root
        tails: list[str] = []  # and the longest end of it that begins a token
        suffix, ends, closes = len(self.suffix), self._ends, self._closes
        before = ""
        for path, word in sorted([(_symbols(word), word) for word in words]):
            size = len(path)
            depth, shared = 0, min(len(last), size - 1)
            while depth < shared and path[depth] == before[depth]:
                depth += 1
            del last[depth:], tails[depth:]
            tail = tails[-1] if depth else ""
            for symbol in path[depth : size - 1]:
                text = tail + symbol
                tail, ending = ends.get(text) or self._ending(text)
                depth += 1
                last.append(self._fitting(ending, last, depth))
                tails.append(tail)
            text = tail + path[-1]
            token = self._fitting(closes.get(text) or self._closing(text), last, size + suffix)
            tokens, left = [token], size + suffix - len(token)
            while left:
                token = last[left - 1]
                tokens.append(token)
                left -= len(token)
            tokens.reverse()
            out[word] = tuple(tokens)
            before = path
        return out

    def _ending(self, text: str) -> tuple[str, tuple[str, ...]]:
        """The longest end of ``text`` that begins a token, and the tokens that it ends in."""
        tail = text
        while tail not in self._begins:
            tail = tail[1:]
        known = self._ends[text] = tail, tuple(t for i in range(len(tail)) if (t := tail[i:]) in self.ids and self.stands(t))
        return known

    def _closing(self, text: str) -> tuple[str, ...]:
        """The tokens that ``text`` ends in if it ends a word."""
        whole = text + self.suffix
        known = self._closes[text] = tuple(t for i in range(len(text)) if (t := whole[i:]) in self.ids and self.stands(t))
        return known

    def _fitting(self, ending: tuple[str, ...], last: list[str], length: int) -> str:
        """Which of the tokens that a prefix of ``length`` letters ends in is its last one:
        the longest that does not merge with what comes before."""
        apart = self._apart
        for token in ending:
            before = length - len(token)
            if not before:
                return token
            pair = last[before - 1], token
            good = apart.get(pair)
            if good or (good is None and self.apart(*pair)):
                return token
        raise ValueError("the vocabulary lacks a symbol")


@cache
def _byte_names() -> dict[int, str]:
    """Byte-level symbols: printable Latin-1 bytes stand for themselves, the others for the
    code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def _symbols(word: str) -> str:
    if word.isascii() and word.isprintable():
        return word
    return word.encode().decode("latin-1").translate(_byte_names())


Encoded = tuple[bytes, bytes]


class Encoder:
    """Encodes texts with a memory of the pieces and words it has seen. Pieces are what ASCII
    white space separates; nothing in the vocabulary's rules looks beyond it. What is known
    of a piece or word are its ids and its tokens, each joined by a space."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.pieces: dict[bytes, Encoded] = {}
        self.words: dict[str, Encoded] = {t: (str(i).encode(), t.encode()) for t, i in vocab.special.items()}
        self._older: tuple[dict, dict] = {}, {}
        self._special = dict(self.words)
        self._blank = False  # whether a piece without a word was seen

    def learn(self, texts: list[list[bytes]]) -> None:
        """Make the encodings of all these pieces known."""
        if len(self.pieces) > REMEMBERED:  # what is seen again outlives the change
            self._older = self.pieces, self.words
            self.pieces, self.words = {}, dict(self._special)
        pieces, words, (old_pieces, old_words) = self.pieces, self.words, self._older
        self.vocab.forget()
        fresh: set[bytes] = set().union(*texts)
        fresh.difference_update(pieces)
        again = [p for p in fresh if p in old_pieces]
        pieces.update((p, old_pieces[p]) for p in again)
        fresh.difference_update(again)
        split = {piece: self.vocab.split(piece) for piece in fresh}
        unknown = {w for own in split.values() for w in own if w not in words}
        again = [w for w in unknown if w in old_words]
        words.update((w, old_words[w]) for w in again)
        unknown.difference_update(again)
        ids = self.vocab.ids
        for word, tokens in self.vocab.encode_words(unknown).items():
            words[word] = " ".join([str(ids[t]) for t in tokens]).encode(), " ".join(tokens).encode()
        for piece, own in split.items():
            if len(own) == 1:
                pieces[piece] = words[own[0]]
            else:
                found = [words[w] for w in own]
                self._blank = self._blank or not found
                pieces[piece] = b" ".join([x for x, _ in found]), b" ".join([x for _, x in found])

    def encode(self, pieces: list[bytes]) -> Encoded:
        """The ids of a text's pieces, and the tokens that they decode to."""
        found = map(self.pieces.__getitem__, pieces)
        if self._blank:
            found = filter(lambda x: x[0], found)
        ids, tokens = [*zip(*found)] or ((), ())
        return b" ".join(ids), b" ".join(tokens)


def encode(rows: DataFrame, vocabulary_text: str, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``ids array<int>`` and ``decoded string`` to rows, which keep all columns, or those
    of ``keep``; columns of these names are replaced.

    Special tokens in a text are encoded as such and none are added. Decoding joins tokens
    by a space, as the library does for a file without a decoder. Whole texts are encoded;
    a null or empty text, or one of white space, has no ids and decodes to the empty string.
    """
    return _mapped(rows, vocabulary_text, text_col, keep, {"ids": "array<int>", "decoded": "string"}, _whole)


def encode_digests(
    rows: DataFrame, vocabulary_text: str, text_col: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """As ``encode``, but adds ``n_tokens long``, and the SHA-256 of the ids (decimal, joined
    by a space) and of the decoded text: ``ids_sha256`` and ``decoded_sha256``."""
    return _mapped(
        rows, vocabulary_text, text_col, keep, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, _digests
    )


def _whole(found: list[tuple[bytes, bytes]]) -> list[pa.Array]:
    ids = [[int(x) for x in a.split()] for a, _ in found]
    return [pa.array(ids, pa.list_(pa.int32())), pa.array([b.decode() for _, b in found], pa.string())]


def _digests(found: list[tuple[bytes, bytes]]) -> list[pa.Array]:
    return [
        pa.array([a.count(b" ") + bool(a) for a, _ in found], pa.int64()),
        *(pa.array([hashlib.sha256(x[k]).hexdigest() for x in found], pa.string()) for k in (0, 1)),
    ]


def _mapped(
    rows: DataFrame, vocabulary_text: str, text_col: str, keep: Sequence[str] | None, added: dict[str, str], results
) -> DataFrame:
    columns, names = [c for c in (rows.columns if keep is None else keep) if c not in added], list(added)
    schema = rows.select(*columns).withColumns({n: F.lit(None).cast(t) for n, t in added.items()}).schema
    shipped = rows.sparkSession.sparkContext.broadcast(vocabulary_text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(shipped.value))  # goes with the task; workers live on
        for whole in parts:
            for batch in textscan.pieces(whole, text_col, _PIECE):
                texts = [(x or b"").split() for x in textscan.texts_of(batch, text_col).cast(pa.binary()).to_pylist()]
                encoder.learn(texts)
                found = [encoder.encode(x) for x in texts]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *results(found)], [*columns, *names])

    return rows.mapInArrow(run, schema)
