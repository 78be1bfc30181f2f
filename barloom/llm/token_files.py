"""Token files: the ids of many documents one after the other, with Elias-Fano coded boundaries and document ids.

A file holds, in this order: all ids as little-endian 16-bit integers (32-bit, if the vocabulary needs them); the end of each document within
the file; the document ids less the smallest, both Elias-Fano coded; a trailer of fixed size that says where each is. Ids are written as they
come, so neither a file nor a long document has to fit into memory; files are closed at a document's end once they are large enough.

Documents are dealt out by ranges of their ids and sorted, so file follows file in ascending order. Each task writes files under names of its
own, and only the names that successful tasks return are ever read: what a lost or repeated task has left is ignored. Files go through
pyarrow's file systems, so the folder may be in any store they know; it must be shared by all executors.

Texts are encoded by the given tokenizer. With byte-level BPE, whose tokens never reach from one word to the next, texts are cut into words and each
different one is encoded once while it is remembered; otherwise whole texts are.

Cases: a null text is empty and has the end id alone. Documents without id come first; repeated ids follow each other, ordered by their text. Ids must be
integers. A very long text is cut into blocks of pieces, where it may be cut. An empty table gives no files and no rows. Columns other than the named ones are
not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.elias_fano import EliasFano
from barloom.llm.lineage import checkpointed, shared_folder
from barloom.llm.tokens import chunks

MAGIC = b"IDSEF001"
#: magic, bytes of an id, documents, ids, documents without id, smallest id, bytes of both coded sequences
_TRAILER = struct.Struct("<BQQQqQQ8s")
FILE_IDS = 1 << 25
BLOCK_PIECES, CHUNK_BYTES = 3 << 19, 6 << 20
CACHED_PIECES = 400_000
MANIFEST = "path string, task long, seq long, n_docs long, n_ids long"


class Encoder:
    """Ids of texts by a tokenizer of the ``tokenizers`` library, given as the text of its file."""

    def __init__(self, config: str, whole: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.cuts = not whole and cuts_in_pieces(json.loads(config))
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known: dict[bytes, int] = {}
        self.flat, self.n, self.blocks_seen = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _forget(self) -> None:
        """Keeps of the known pieces those that stood in two blocks or more. Of each: its number, how many ids it has and in how many blocks it stood; the ids, piece by piece."""
        kept = [p for p, i in self.known.items() if self.blocks_seen[i] > 1] if len(self.known) else []
        if len(kept) > CACHED_PIECES // 2:
            kept = []
        at = np.fromiter(map(self.known.__getitem__, kept), dtype=np.int64, count=len(kept))
        self.flat, self.n, self.blocks_seen = self._ids(at).values.to_numpy(), self.n[at], self.blocks_seen[at] - 1
        self.known = dict(zip(kept, range(len(kept)), strict=True))

    def _ids(self, at: np.ndarray) -> pa.ListArray:
        """The ids of pieces by their numbers."""
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.n)), pa.int32()), pa.array(self.flat)).take(pa.array(at))

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For blocks of pieces: their ids, and how many each text has in the block, from the first to the last text."""
        if not self.cuts:
            for i in range(len(offsets) - 1):
                (ids,) = self._encode([data[offsets[i] : offsets[i + 1]].tobytes()])
                n = np.zeros(len(offsets) - 1, dtype=np.int64)
                n[i] = len(ids)
                yield np.array(ids, dtype=np.uint32), n
            return
        start = pieces(data, offsets)
        for at in range(0, len(start), BLOCK_PIECES):
            own = start[at : at + BLOCK_PIECES]
            end = start[at + BLOCK_PIECES] if at + BLOCK_PIECES < len(start) else len(data)
            bounds = np.append(own, end) - own[0]
            spread = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data[own[0] : end].tobytes())]).dictionary_encode()
            piece = self._numbers(spread.dictionary.to_pylist())
            self.blocks_seen[piece] += 1
            found = self._ids(piece).take(spread.indices)
            ends = found.offsets.to_numpy()  # of each piece in the block, after its first
            inside = np.searchsorted(own, offsets)  # pieces before each text
            yield found.values.to_numpy(), np.diff(ends[inside])

    def _numbers(self, wanted: list[bytes]) -> np.ndarray:
        """The numbers of different pieces; unknown ones are encoded, all plain ones as lines of one text."""
        known = self.known
        fresh = [p for p in wanted if p not in known]
        if len(known) + len(fresh) > CACHED_PIECES:
            self._forget()
            known = self.known
            fresh = [p for p in wanted if p not in known]
        plain = [p for p in fresh if not (p[1:] if p[0] == 32 and len(p) > 1 else p).translate(None, PLAIN)]
        if len(plain) > 1:
            ids, end = np.array(self._encode([b"\n".join(plain)])[0], dtype=np.uint32), self._encode([b"\n"])[0]
            cut = np.flatnonzero(ids == end[0])
            if len(end) == 1 and len(cut) == len(plain) - 1:
                self._learn(plain, np.delete(ids, cut), np.diff(cut, prepend=-1, append=len(ids)) - 1)
                fresh = [p for p in fresh if p not in known]
        if fresh:
            found = self._encode(fresh)
            self._learn(fresh, np.array([i for ids in found for i in ids], dtype=np.uint32), np.array([len(ids) for ids in found], dtype=np.int64))
        return np.fromiter(map(self.known.__getitem__, wanted), dtype=np.int64, count=len(wanted))

    def _learn(self, found: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        self.known.update(zip(found, range(len(self.n), len(self.n) + len(found)), strict=True))
        self.n, self.flat = np.concatenate([self.n, n.astype(np.int32)]), np.concatenate([self.flat, ids])
        self.blocks_seen = np.concatenate([self.blocks_seen, np.zeros(len(found), dtype=np.int32)])


def cuts_in_pieces(config: dict) -> bool:
    """Whether texts may be encoded in ``pieces``: byte-level BPE with its own pattern, nothing that joins or trims."""
    pre, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
    plain = all(ADDED.fullmatch(t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] for t in config.get("added_tokens") or ())
    return not config.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type") == "BPE" and not model.get("dropout") and plain


#: Added tokens that pieces leave whole, see ``pieces``.
ADDED = re.compile(r"<\|[a-z]+\|>")
#: Bytes of pieces that may be encoded as lines of one text, but for a blank at the beginning: none that could belong to another blank.
PLAIN = bytes([*range(0x21, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xE0), *range(0xE4, 0xF5)])
#: Kinds of bytes: visible for certain at a word's end and at its beginning; letters; digits; marks but for the apostrophe and what added tokens hold.
_LAST, _FIRST, _LETTER, _DIGIT, _MARK = (np.zeros(256, dtype=bool) for _ in range(5))
_LAST[33:127] = _FIRST[33:127] = _MARK[33:127] = True
_LAST[0x80:0xC0] = True
_LAST[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False  # may end a blank beyond ASCII
_FIRST[0xC3:0xF5] = True
_FIRST[[0xE1, 0xE2, 0xE3]] = False  # may begin one
_LETTER[65:91] = _LETTER[97:123] = _DIGIT[48:58] = True
_MARK[_LETTER | _DIGIT] = False
_MARK[list(b"'<|>")] = False


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of the texts begin; empty texts have none.

    Byte-level BPE first parts a text into contractions, runs of letters, of digits and of other marks, each with at most one blank before it, and runs
    of blanks, of which the last goes with what follows. So no token reaches over these places: before a single blank or a line end between
    visible characters, after such a line end, and between letters, digits and marks (letters of Latin-1 included, apostrophes not). That holds at a text's edges too, whatever the texts beside it are.
    """
    n = len(data)
    begins = np.zeros(n + 1, dtype=bool)
    if n > 2:
        left, here, right = data[:-2], data[1:-1], data[2:]
        after, line, before = _LAST[left], here == 10, _FIRST[right]
        begins[1 : n - 1] = after & (((here == 32) & before) | line)
        begins[2:n] |= after & line & before
        latin = np.zeros(n, dtype=bool)  # last bytes of Latin-1's letters
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter, digit, mark = _LETTER[data] | latin, _DIGIT[data], _MARK[data]
        letter_next = _LETTER[data]
        letter_next[:-1] |= latin[1:]
        begins[1:n] |= (letter[:-1] & (digit | mark)[1:]) | (digit[:-1] & (letter_next | mark)[1:]) | (mark[:-1] & (letter_next | digit)[1:])
    begins[offsets] = True
    return np.flatnonzero(begins[:n])


@lru_cache(maxsize=2)
def _encoder(config: str) -> Encoder:
    return Encoder(config)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's address with its store, as pyarrow reads it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    address = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{address[5:]}" if address.startswith("file:/") and not address.startswith("file://") else address


class Writer:
    """Writes documents to files of one folder, about ``file_ids`` ids in each."""

    def __init__(self, folder: str, task: int, width: int, file_ids: int):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.task, self.width, self.file_ids, self.seq = task, np.dtype(f"<u{width}"), file_ids, 0
        self.out, self.done = None, []

    def _open(self) -> None:
        self.path = f"{self.folder}/ids-{self.task:06d}-{self.seq:06d}-{uuid.uuid4().hex}.bin"
        self.out, self.n, self.ends, self.keys, self.none = self.store.open_output_stream(self.path), 0, [], [], 0

    def add(self, ids: np.ndarray) -> None:
        if self.out is None:
            self._open()
        self.out.write(ids.astype(self.width).tobytes())
        self.n += len(ids)

    def end(self, key: int | None) -> None:
        """The document is over."""
        self.ends.append(self.n)
        self.none += key is None
        if key is not None:
            self.keys.append(key)
        if self.n >= self.file_ids:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        least = self.keys[0] if self.keys else 0
        ends, keys = EliasFano.of(np.array(self.ends, dtype=np.uint64)).to_bytes(), EliasFano.of(np.array([k - least for k in self.keys], dtype=np.uint64)).to_bytes()
        self.out.write(ends + keys + _TRAILER.pack(self.width.itemsize, len(self.ends), self.n, self.none, least, len(ends), len(keys), MAGIC))
        self.out.close()
        self.done.append((self.path.rpartition("/")[2], self.task, self.seq, len(self.ends), self.n))
        self.out, self.seq = None, self.seq + 1


class TokenFile:
    """A written file: ``document(i)`` reads the ids of one document, and nothing else of the ids."""

    def __init__(self, folder: str, name: str):
        store, root = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        size = self.file.size()
        width, self.n, self.n_ids, self.none, self.least, ends, keys, magic = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no token file")
        self.width = np.dtype(f"<u{width}")
        tail = self.file.read_at(ends + keys, size - _TRAILER.size - ends - keys)
        self.ends, self.keys = EliasFano.from_bytes(tail[:ends]), EliasFano.from_bytes(tail[ends:])

    def ids(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((last - first) * self.width.itemsize, first * self.width.itemsize), dtype=self.width)

    def offset(self, i: int) -> int:
        """Where document i begins, in ids."""
        return self.ends.select(i - 1) if i else 0

    def key(self, i: int) -> int | None:
        return None if i < self.none else self.least + self.keys.select(i - self.none)

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.offset(i), self.ends.select(i))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """id, start and ids of each document, read from the first to the last; several small documents at once."""
        ends = self.ends.values().astype(np.int64).tolist()
        keys = [None] * self.none + [self.least + k for k in self.keys.values().tolist()]
        at = 0
        while at < self.n:
            first, to = ends[at - 1] if at else 0, at + 1
            while to < self.n and ends[to] - first <= 1 << 20:
                to += 1
            ids = self.ids(first, ends[to - 1])
            for i in range(at, to):
                start = ends[i - 1] if i else 0
                yield keys[i], start, ids[start - first : ends[i] - first]
            at = to


def write(docs: DataFrame, tokenizer: str | Path, end_id: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> tuple[DataFrame, str]:
    """Writes the files; returns a row for each (path, task, seq, n_docs, n_ids; tasks and seqs in order of ids) and the folder's address.

    tokenizer: the path of a file of the ``tokenizers`` library on the driver; its text, a few megabytes, is sent to the tasks.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"document ids are integers, not {kind}")
    config = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    address = qualified(spark, folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            encoder = _encoder(config.value)
            if out is None:
                out = Writer(address, TaskContext.get().partitionId(), 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4, file_ids)
            _append(out, encoder.blocks(data, offsets), batch.column(0).to_pylist(), end_id)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out.done, strict=True), (pa.string(), *[pa.int64()] * 4), strict=True)], names=["path", "task", "seq", "n_docs", "n_ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return checkpointed(dealt.mapInArrow(run, MANIFEST)), address


def _append(out: Writer, blocks: Iterable[tuple[np.ndarray, np.ndarray]], keys: list[int | None], end_id: int) -> None:
    """Adds the documents of a chunk, whose ids come in blocks, each with an end id."""
    at, last = 0, np.array([end_id], dtype=np.uint32)

    def finish(to: int) -> None:
        nonlocal at
        while at < to:
            out.add(last)
            out.end(keys[at])
            at += 1

    for ids, n in blocks:
        begin = 0
        for i in np.flatnonzero(n).tolist():
            finish(i)
            out.add(ids[begin : begin + n[i]])
            begin += int(n[i])
    finish(len(keys))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, in any order: one pass over the files, a file to a task at a time.

    What stands before each file is a running sum over the manifest, which has a row for some 64 MB of ids.
    """
    before = F.sum("n_ids").over(Window.orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("before")).repartition(max(1, manifest.count()))  # a number, so that few bytes don't end up in few tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(key, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, start, ids in TokenFile(folder, path).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of token files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
