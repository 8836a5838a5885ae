"""Token ids in files of fixed-width bit-packed blocks.

A file holds the ids of a run of documents. Each id takes the fewest bits that the
vocabulary's largest id needs, and ids are packed into blocks of 4,096 with an offset each,
so a reader can fetch any stretch of ids by seeking to its blocks and unpack them with a few
numpy operations per block. Blocks are written as they fill; what tells where they are comes
after them. Layout, all numbers little-endian:

    8 bytes    the mark "MRIDPK02"
    2 x u64    bits per id, ids per block
    blocks     packed from the lowest bit on, each padded to whole 64-bit words
    i64 + u8   each document's id, and whether it is null (two arrays)
    u64        where each document's ids start, and their number (documents + 1 numbers)
    u64        where each block starts in the file, and their end (blocks + 1 numbers)
    4 x u64    documents, ids, blocks, and where the documents' ids are in the file
    8 bytes    the mark again
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace import workspace
from millrace.llm import textscan
from millrace.llm.store import written

MARK = b"MRIDPK02"
BLOCK_IDS = 4096
#: Ids of a file; a range of documents with more of them makes several files.
FILE_IDS = 1 << 28
#: Pieces of text whose ids a Python worker remembers; beyond that it forgets those that it
#: has not met lately.
REMEMBERED = 500_000
_PIECE = 4 << 20
#: Blocks that are packed together, and pieces that the library encodes in one call.
_TOGETHER, _PIECES = 64, 2000
_HEADER, _TAIL = ("width", "block"), ("docs", "ids", "blocks", "footer")


def bits_for(vocabulary_size: int) -> int:
    """The fewest bits that hold every id below ``vocabulary_size``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids as 64-bit words, ``width`` bits each. Every 64 ids fill ``width`` words, so the
    64 places of such a group are packed for all groups at once."""
    groups = -(-len(ids) // 64)
    padded = np.zeros((groups, 64), np.uint64)
    padded.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, width), np.uint64)
    for place in range(64):
        word, shift = divmod(place * width, 64)
        words[:, word] |= padded[:, place] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= padded[:, place] >> np.uint64(64 - shift)
    return words.reshape(-1)[: -(-len(ids) * width // 64)]


def unpack(words: np.ndarray, count: int, width: int) -> np.ndarray:
    """The first ``count`` ids of packed words."""
    groups = -(-count // 64)
    whole = np.zeros(groups * width, np.uint64)
    whole[: min(len(words), len(whole))] = words[: len(whole)]
    whole = whole.reshape(groups, width)
    mask = np.uint64((1 << width) - 1)
    ids = np.empty((groups, 64), np.uint64)
    for place in range(64):
        word, shift = divmod(place * width, 64)
        value = whole[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (whole[:, word + 1] << np.uint64(64 - shift))
        ids[:, place] = value & mask
    return ids.reshape(-1)[:count].astype(np.uint32)


class Writer:
    """Packs documents one after the other into one file. Given an open stream, it writes
    blocks there as they fill and holds up to ``_TOGETHER`` blocks of ids, and some numbers
    for each document and block; without one, packed blocks wait for ``write``."""

    def __init__(self, width: int, block: int = BLOCK_IDS, out=None):
        self.width, self.block = width, block
        self.names: list[int | None] = []
        self.lengths: list[int] = []
        self.ids = 0
        self.sizes: list[int] = []  # bytes of each block
        self.packed: list[np.ndarray] = []
        self.open: list[np.ndarray] = []
        self.waiting = 0
        self.out = None
        if out is not None:
            self._begin(out)

    def _begin(self, out) -> None:
        self.out = out
        out.write(MARK + np.array([self.width, self.block], "<u8").tobytes())
        for block in self.packed:
            out.write(block.astype("<u8").tobytes())
        self.packed = []

    def add(self, name: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"id {int(ids.max())} needs more than {self.width} bits")
        self.names.append(name)
        self.lengths.append(len(ids))
        self.open.append(ids)
        self.ids += len(ids)
        self.waiting += len(ids)
        if self.waiting >= _TOGETHER * self.block:
            self._pack()

    def _pack(self, last: bool = False) -> None:
        ids = np.concatenate([*self.open, np.zeros(0, np.uint32)])
        whole = len(ids) // self.block * self.block
        if self.block % 64:
            blocks = [pack(ids[s : s + self.block], self.width) for s in range(0, whole, self.block)]
        else:  # such blocks end with a word, so all are packed in one go
            blocks = list(pack(ids[:whole], self.width).reshape(-1, self.block * self.width // 64))
        rest = ids[whole:].copy()
        if last and len(rest):
            blocks.append(pack(rest, self.width))
            rest = rest[:0]
        self.sizes += [len(b) * 8 for b in blocks]
        if self.out is None:
            self.packed += blocks
        else:
            for block in blocks:
                self.out.write(block.astype("<u8").tobytes())
        self.open, self.waiting = [rest], len(rest)

    def write(self, out=None) -> int:
        """Write what is left to the stream, or the whole file to ``out``; the number of ids."""
        self._pack(last=True)
        if self.out is None:
            self._begin(out)
        out = self.out
        starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype("<u8")
        offsets = (len(MARK) + 8 * len(_HEADER) + np.concatenate([[0], np.cumsum(self.sizes)])).astype("<u8")
        out.write(np.array([n or 0 for n in self.names], "<i8").tobytes())
        out.write(np.array([n is None for n in self.names], np.uint8).tobytes())
        out.write(starts.tobytes())
        out.write(offsets.tobytes())
        out.write(np.array([len(self.names), starts[-1], len(self.sizes), offsets[-1]], "<u8").tobytes() + MARK)
        return int(starts[-1])


class Reader:
    """Random access to the ids of one file, which ``source`` has open."""

    def __init__(self, source):
        self.source = source
        if source.read(len(MARK)) != MARK:
            raise ValueError("not a file of packed token ids")
        for name, value in zip(_HEADER, self._numbers(len(_HEADER), "<u8").tolist()):
            setattr(self, name, value)
        source.seek(-(8 * len(_TAIL) + len(MARK)), 2)
        for name, value in zip(_TAIL, self._numbers(len(_TAIL), "<u8").tolist()):
            setattr(self, name, value)
        if source.read(len(MARK)) != MARK:
            raise ValueError("the file of packed token ids was not written to its end")
        source.seek(self.footer)
        self.names = self._numbers(self.docs, "<i8")
        self.nameless = self._numbers(self.docs, "u1").astype(bool)
        self.starts = self._numbers(self.docs + 1, "<u8").astype(np.int64)
        self.offsets = self._numbers(self.blocks + 1, "<u8").astype(np.int64)

    def _numbers(self, count: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.source.read(count * np.dtype(kind).itemsize), kind)

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``, out of their blocks alone."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        words = np.frombuffer(self.source.read(int(self.offsets[last + 1] - self.offsets[first])), "<u8")
        if self.block % 64 == 0:
            held = min((last + 1) * self.block, self.ids) - first * self.block
            return unpack(words, held, self.width)[start - first * self.block : end - first * self.block]
        parts = []
        for k in range(first, last + 1):
            at = slice(*((self.offsets[k : k + 2] - self.offsets[first]) // 8).tolist())
            parts.append(unpack(words[at], min(self.block, self.ids - k * self.block), self.width))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, reading some blocks at a time."""
        at, held = 0, np.zeros(0, np.uint32)
        step = 64 * self.block
        for k in range(self.docs):
            start, end = int(self.starts[k]), int(self.starts[k + 1])
            while at + len(held) < end:
                held, at = held[start - at :], start
                held = np.concatenate([held, self.slice(at + len(held), min(at + len(held) + step, self.ids))])
            yield (None if self.nameless[k] else int(self.names[k])), held[start - at : end - at]


def write_files(
    docs: DataFrame,
    tokenizer_text: str,
    folder: str | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every document, append ``end_id``, and write files in ascending order of ids.

    Returns the table of files: ``file_no, path, docs, ids``, in the order of the documents.
    ``folder`` is a place that all executors share, by default below the shared folder.

    * Files are ranges of ids, as many as Spark makes of the sort, or more where a range has
      over ``FILE_IDS`` token ids; rows that repeat an id come in the order of their texts'
      hash and may be spread over files. Null ids come first.
    * Whole texts are encoded, without special tokens; a null text counts as empty and has
      the end id alone. Other columns are not looked at. An empty table makes no files.
    * A task writes its file under a name of its own and moves it into place, and the table
      lists files of finished tasks only, so a task that is run again does no harm.
    """
    spark = docs.sparkSession
    folder = folder or workspace.fresh_path(spark, "token-files")
    shipped = spark.sparkContext.broadcast((tokenizer_text, folder, end_id))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").drop("tie")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, where, end = shipped.value
        encoder = _encoder(text, end)
        file = None
        number = TaskContext.get().partitionId() << 20
        for whole in parts:
            for batch in textscan.pieces(whole, "text", _PIECE):
                ids, bounds = encoder.encode(batch.column("text"))
                for name, s, e in zip(batch.column("id").to_pylist(), bounds, bounds[1:]):
                    if file and file.writer.ids >= FILE_IDS:
                        yield file.finish()
                        file, number = None, number + 1
                    file = file or _File(where, number, encoder.width)
                    file.writer.add(name, ids[s:e])
        if file:
            yield file.finish()

    return written(ranged.mapInArrow(run, "file_no long, path string, docs long, ids long"), "token-file-list")


class _File:
    """A file that is being written under a name of its own."""

    def __init__(self, folder: str, number: int, width: int):
        self.place, self.root = _filesystem(folder)
        self.place.create_dir(self.root, recursive=True)
        self.folder, self.number = folder, number
        self.name = f"part-{number:012d}-{uuid.uuid4().hex[:12]}.ids"
        self.out = self.place.open_output_stream(f"{self.root}/.{self.name}")
        self.writer = Writer(width, out=self.out)

    def finish(self) -> pa.RecordBatch:
        """Move the file into place; its row in the table of files."""
        count = self.writer.write()
        self.out.close()
        self.place.move(f"{self.root}/.{self.name}", f"{self.root}/{self.name}")
        return pa.RecordBatch.from_pylist(
            [{"file_no": self.number, "path": f"{self.folder}/{self.name}", "docs": len(self.writer.names), "ids": count}],
            pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]),
        )


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def read_files(files: DataFrame) -> DataFrame:
    """One row per document of a table of files: ``id``, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids_crc32`` (of its ids as unsigned 32-bit numbers)."""
    # One row per file: the table is small, whatever the files hold.
    before = F.coalesce(F.sum("ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The rows are few but each stands for a file, so they are not to be merged into one task.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = files.withColumn("before", before.cast("long")).repartition(tasks, "path")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path, so_far in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                place, name = _filesystem(path)
                with place.open_input_file(name) as source:
                    reader = Reader(source)
                    sums = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader.documents()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.names, pa.int64(), mask=reader.nameless),
                            pa.array(reader.starts[:-1] + so_far, pa.int64()),
                            pa.array(np.diff(reader.starts), pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        ["id", "start", "n_tokens", "ids_crc32"],
                    )

    return placed.select("path", "before").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


#: Kinds of bytes: a letter, a digit, other ASCII signs, an apostrophe, a byte beyond ASCII.
_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _BEYOND = range(5)
_KIND = np.array(
    [_BEYOND if i >= 128 else _LETTER if chr(i).isalpha() else _DIGIT if chr(i).isdigit() else _APOSTROPHE if i == 39 else _SIGN for i in range(256)],
    np.uint8,
)
#: Whether a word ends between two kinds of bytes, whatever stands around them.
_ENDS = np.zeros((5, 5), bool)
_ENDS[[_LETTER, _SIGN], [_SIGN, _LETTER]] = True
_ENDS[_DIGIT, [_LETTER, _DIGIT, _SIGN, _APOSTROPHE]] = True
_ENDS[[_LETTER, _SIGN, _APOSTROPHE], _DIGIT] = True
_ENDS = _ENDS.reshape(-1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Fixed value: the split that allows these ends.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Lower-case letters that no normaliser changes and no neighbour of theirs joins: one word.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


class _Encoder:
    """The library's encodings of pieces of text, each encoded once as long as it is known.

    Pieces are what ASCII white space separates; the vocabulary's rules do not look beyond
    it. Where these split letters, single digits and signs from each other and lower the
    case, which is read from the file, pieces are cut there too, and lowered first, so that
    fewer of them differ. A batch that holds the text of a special token is cut at white
    space alone. The library encodes many pieces in one call, with a special token between
    them that tells where each ends. Pieces of plain letters are a word each, whose last token
    says so by its suffix; these need no such mark, and neither normalisers nor the split. The
    ids of a batch are then put together by one look-up.
    """

    def __init__(self, text: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        known = self.library.get_vocab(with_added_tokens=True)
        self.width = bits_for(1 + max(known.values()))
        rules = json.loads(text)
        self.special = {t["content"].encode(): t["id"] for t in rules["added_tokens"] if t["special"]}
        self.finely = _SPLIT in json.dumps(rules["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\") and "Lowercase" in json.dumps(rules["normalizer"])
        suffix = rules["model"].get("end_of_word_suffix")
        self.words = _word_library(text) if self.finely and suffix and '"ByteLevel"' in json.dumps(rules["pre_tokenizer"]) else None
        self.last = np.zeros(1 + max(known.values()), bool)
        self.last[[i for token, i in known.items() if suffix and token.endswith(suffix)]] = True
        #: The end of a document is a piece too.
        self.known: dict[bytes | None, int] = {None: 0}
        self.ids = pa.array([np.array([end_id], "<u4").tobytes()], pa.large_binary())
        self.met = np.ones(1, bool)  # since something was forgotten

    def _forget(self) -> None:
        """Keep what was met since the last time; where that is most of it, nothing."""
        keep = np.flatnonzero(self.met)
        keep = keep if 2 * len(keep) <= REMEMBERED else keep[:1]
        names = list(self.known)
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.ids = self.ids.take(pa.array(keep))
        self.met = np.zeros(len(keep), bool)

    def _learn(self, plain: list[bytes], others: list[bytes], special: bool) -> None:
        """Make the encodings of these different pieces known, none of which is yet: first
        those of plain words, then the others."""
        parts = [self._plainly(plain[s : s + _PIECES]) for s in range(0, len(plain), _PIECES)]
        if special or not self.special:
            found = [self._ids(p.decode()) for p in others]
            parts += [(ids, np.array([len(ids)])) for ids in found]
        else:
            parts += [self._together(others[s : s + _PIECES]) for s in range(0, len(others), _PIECES)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [])
        bounds = 4 * np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        raw = np.ascontiguousarray(ids, "<u4").tobytes()
        pieces = plain + others
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        self.ids = pa.concat_arrays([self.ids, own])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _plainly(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_together`` for pieces of plain letters alone."""
        found = np.array(self.words.encode_batch_fast([b" ".join(pieces).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[found])
        if len(ends) != len(pieces):
            raise ValueError("the library finds other words than the vocabulary's rules say")
        return found, np.diff(np.concatenate([[-1], ends]))

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that hold no special token, and the number of each piece's."""
        mark, number = next(iter(self.special.items()))
        found = self._ids((b" " + mark + b" ").join(pieces).decode())
        marks = np.flatnonzero(found == number)
        if len(marks) != len(pieces) - 1:
            raise ValueError("the library finds other special tokens than the vocabulary's file says")
        return np.delete(found, marks), np.diff(np.concatenate([[-1], marks, [len(found)]])) - 1

    def _pieces(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, bool]:
        """The pieces of all texts, where each text's end, and whether special tokens may be there."""
        data, bounds = textscan.utf8(texts)
        raw = data.tobytes()
        special = any(t in raw for t in self.special)
        word = ~textscan.SPACE[data]
        before = np.concatenate([[0], np.cumsum(word)])  # places when white space is left out
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = word[1:] & ~word[:-1]
        if self.finely and not special:
            kind = _KIND[data]
            begins[1:-1] |= word[1:] & _ENDS[kind[:-1] * np.uint8(5) + kind[1:]]
            data = _LOWER[data]
        begins[bounds] = True
        starts = np.flatnonzero(begins[:-1])
        cuts = np.concatenate([before[starts], before[-1:]])
        cuts = cuts[np.concatenate([[True], cuts[1:] != cuts[:-1]])]  # white space alone leaves no piece
        count = max(len(cuts) - 1, 0)
        kept = pa.py_buffer(np.ascontiguousarray(data[word]))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(cuts.astype(np.int64)), kept])
        return found.dictionary_encode(), np.searchsorted(cuts[:count], before[bounds[1:]]), special

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts, one after the other and each with the end id, and their bounds."""
        coded, ends, special = self._pieces(texts)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) > REMEMBERED:
            self._forget()
        number = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        fresh = np.flatnonzero(number < 0)
        plain = np.zeros(len(fresh), bool)
        if self.words and not special:
            plain[:] = [p.isalpha() or _PLAIN.fullmatch(p.decode()) is not None for p in pieces[fresh]]
        fresh = np.concatenate([fresh[plain], fresh[~plain]])
        cut = int(plain.sum())
        number[fresh] = np.arange(len(self.known), len(self.known) + len(fresh))
        self._learn(pieces[fresh[:cut]].tolist(), pieces[fresh[cut:]].tolist(), special)
        self.met = np.concatenate([self.met, np.zeros(len(self.known) - len(self.met), bool)])
        self.met[number], self.met[0] = True, True
        units = np.insert(number[coded.indices.to_numpy()], ends, 0)
        found, after = textscan.utf8(self.ids.take(pa.array(units)))
        bounds = np.concatenate([[0], after[ends + np.arange(1, len(ends) + 1)] // 4])
        return np.frombuffer(found, "<u4"), bounds.tolist()


def _word_library(text: str):
    """The library with the vocabulary of the file, for lower-case words that spaces separate."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    library = Tokenizer.from_str(text)
    library.no_truncation()
    library.no_padding()
    library.normalizer = normalizers.Sequence([])
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return library


_encoders: dict[tuple[str, int], _Encoder] = {}


def _encoder(text: str, end_id: int) -> _Encoder:
    """The worker's own encoder: what it has learned serves the next task too."""
    if (text, end_id) not in _encoders:
        _encoders.clear()
        _encoders[text, end_id] = _Encoder(text, end_id)
    return _encoders[text, end_id]
