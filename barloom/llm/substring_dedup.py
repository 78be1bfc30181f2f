"""Exact substring deduplication: every byte covered by a ``width``-byte string that also starts earlier goes.

Not by merging shard Burrows-Wheeler transforms, as planned: the README says why, with figures. Each string of ``width`` bytes has an
anchor, the place of the least hash among its ``gram``-byte grams, the leftmost of equal ones, which depends on the string alone. Consecutive strings with
one anchor form a run. Runs alike in all their bytes, aligned at their anchors, are compared first: all strings of
all but the first are repeats. Only where an anchor's gram stands in runs that differ are the strings of each
first run compared one by one. Equal strings have equal anchors, so no repeat is missed, and no suffixes are sorted.

Runs are compared by 128 bits, their anchor's hash and their own, strings by 96 bits. Each map task drops repeats within its own batches before anything is shuffled, so a passage that
many documents share sends one row for each batch. Only the texts of documents that need it are shuffled.

Cases: null texts are empty; texts shorter than ``width`` stay whole; a null id is after all others. Each row is a document of its own:
rows are numbered in the order of their ids, rows with one id in the order of their texts' hashes, so of repeated rows the first stays and the others go. Ids may be of any type that
can be ordered. Empty tables give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.lineage import forget, numbered, stored
from barloom.llm.tokens import BASE, BASE2, U, chunks, enough_powers, mix64, window_least

WIDTH, GRAM, PARTS = 100, 32, 2


class Hashed:
    """Hashes of any byte ranges of some texts."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data)
        self.total = np.zeros(n + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * enough_powers(n, base), out=self.total[1:])
        self.back = enough_powers(n + 1, pow(base, -1, 1 << 64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        return mix64((self.total[k:] - self.total[:n]) * self.back[:n]) if n > 0 else np.zeros(0, dtype=U)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64(((self.total[end] - self.total[start]) * self.back[start]) ^ (end - start).astype(U))


def _runs(hashed: Hashed, offsets: np.ndarray, width: int, gram: int, bits: int = 64) -> tuple[np.ndarray, ...]:
    """Of all runs of strings with one anchor: the anchor's hash and place, the first and the last start, the text."""
    grams = hashed.grams(gram) >> U(64 - bits)
    if len(grams) < width - gram + 1:
        return tuple(np.zeros(0, dtype=t) for t in (U, np.int64, np.int64, np.int64, np.int64))
    _, least = window_least(grams, width - gram + 1)
    start = np.arange(len(least))
    text = np.searchsorted(offsets, start, side="right") - 1
    start = start[start + width <= offsets[text + 1]]
    place = least[start].astype(np.int64)
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(start) != 1)) + 1
    first = np.concatenate([[0], cut]) if len(start) else cut
    last = np.concatenate([cut, [len(start)]]) - 1 if len(start) else cut
    place = place[first]
    return grams[place], place, start[first], start[last], text[start[first]]


def _firsts(groups: tuple[np.ndarray, np.ndarray], ids: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For rows of one batch: whether each is the first by id and start of those equal in both columns of ``groups``."""
    a, b = groups
    out = np.zeros(len(a), dtype=bool)
    if len(a):
        order = np.lexsort((spans, ids, b, a))
        a, b = a[order], b[order]
        out[order] = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return out


def _pack(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 32) | (n.astype(np.int64) << 16)


def _run_finder(width: int, gram: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (id, text): (anchor, run, id, span, repeat). span: start and number of strings; repeat: known as one already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for piece, data, offsets in chunks(iter([batch]), "text"):
                hashed = Hashed(data)
                mark, place, low, high, text = _runs(hashed, offsets, width, gram, bits)
                whole = mix64(hashed.ranges(low, high + width) ^ ((place - low).astype(U) * U(BASE)) ^ mark)
                ids = piece.column(0).to_numpy()
                parts.append((mark.view(np.int64), whole.view(np.int64), ids[text], _pack(low - offsets[text], high - low + 1)))
            if not parts:
                continue
            mark, whole, ids, spans = (np.concatenate([p[i] for p in parts]) for i in range(4))
            first = _firsts((mark, whole), ids, spans)
            mark = np.where(first, mark, mix64(spans.view(U) ^ ids.view(U)).view(np.int64))  # known repeats travel alone
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mark, whole, ids, spans, ~first)], names=["anchor", "run", "id", "span", "repeat"])

    return run


def _string_finder(width: int, part: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (id, spans, text): the strings of these spans: (string, id, span, repeat). span: start and 32 bits more of the string's hash. Only strings of one part, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for piece, data, offsets in chunks(iter([batch]), "text"):
                lists = piece.column(1)
                spans = lists.flatten().to_numpy()
                text = np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy())
                n = (spans >> 16) & 0xFFFF
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                text, start = np.repeat(text, n), np.repeat(spans >> 32, n) + step
                ids = piece.column(0).to_numpy()
                at = start + offsets[text]
                string = Hashed(data).ranges(at, at + width)
                own = string % U(parts) == U(part)
                string, text, start, at = string[own], text[own], start[own], at[own]
                more = (Hashed(data, BASE2).ranges(at, at + width) >> U(32)).astype(np.int64)
                found.append((string.view(np.int64), ids[text], (start << 32) | more))
            if not found:
                continue
            string, ids, spans = (np.concatenate([f[i] for f in found]) for i in range(3))
            first = _firsts((string, spans & 0xFFFFFFFF), ids, spans)
            string = np.where(first, string, mix64(spans.view(U) ^ ids.view(U)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (string, ids, spans, ~first)], names=["string", "id", "span", "repeat"])

    return run


def _covered(spans: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the strings of the spans (start and number)."""
    start = np.sort(spans)
    low, high = start >> 32, (start >> 32) + ((start >> 16) & 0xFFFF) - 1 + width
    reach = np.maximum.accumulate(high)
    cut = np.flatnonzero(low[1:] > reach[:-1]) + 1
    return list(zip(low[np.concatenate([[0], cut])].tolist(), reach[np.concatenate([cut - 1, [len(low) - 1]])].tolist(), strict=True))


def _remover(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (key, spans, text): (key, n_bytes, removed ranges, kept bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for piece, data, offsets in chunks(iter([batch]), "text"):
                removed, kept = [], []
                lists = piece.column(1)
                for i in range(piece.num_rows):
                    own = data[offsets[i] : offsets[i + 1]].tobytes()
                    spans = lists[i].values
                    ranges = _covered(spans.to_numpy(), width) if spans is not None and len(spans) else []
                    ends = [0, *(e for _, e in ranges)]
                    kept.append(b"".join(own[a:b] for a, b in zip(ends, [*(s for s, _ in ranges), len(own)], strict=True)))
                    removed.append([{"start": s, "end": e} for s, e in ranges])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["key", "n_bytes", "removed", "kept"])

    return run


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, parts: int = PARTS, hash_bits: int = 64) -> DataFrame:
    """Per document: id, n_bytes, removed (array of start, end in bytes), kept (the bytes that stay).

    parts: in how many passes single strings are compared, each with its share of them, by hash. hash_bits: of the hashes that choose anchors; any number gives the same result.
    """
    if not 1 <= gram <= width < 1 << 15 or not 1 <= hash_bits <= 64:
        raise ValueError("gram must not exceed width, nor width 32767; hash_bits lie between 1 and 64")
    keyed = docs.select(F.col(doc_id).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = numbered(keyed.withColumn("__hash", F.xxhash64("text")), F.col("key").asc_nulls_last(), "__hash").withColumnRenamed("row", "id")
    forget()
    texts = keyed.select("id", "text")
    runs = texts.mapInArrow(_run_finder(width, gram, hash_bits), "anchor long, run long, id long, span long, repeat boolean")
    start = F.shiftright("span", 32)
    first_of = lambda c: F.first(c).over(Window.partitionBy("anchor", "run").orderBy("id", "span"))
    whole = Window.partitionBy("anchor").orderBy("run").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    judged = runs.withColumns({"first_id": first_of("id"), "first_start": F.shiftright(first_of("span"), 32), "differs": F.first("run").over(whole) != F.last("run").over(whole)})
    later = F.col("repeat") | (F.col("id") != F.col("first_id")) | (start != F.col("first_start"))
    judged = judged.select("id", "span", later.alias("repeat"), "differs").where("repeat or differs")
    judged = stored(judged)
    del runs
    forget()

    spans_of = lambda df: df.groupBy("id").agg(F.collect_list("span").alias("spans"))
    first_of = lambda c: F.first(c).over(Window.partitionBy("string", "more").orderBy("id", "span"))
    one = F.shiftleft(start, 32).bitwiseOR(F.lit(1 << 16).cast("long")).alias("span")
    again = judged.where("repeat").select("id", "span")
    for part in range(parts):  # so that shuffle files of one part are there at a time
        asked = spans_of(judged.where("not repeat")).join(texts, "id").select("id", "spans", "text")
        strings = asked.mapInArrow(_string_finder(width, part, parts), "string long, id long, span long, repeat boolean").repartition("string")
        strings = strings.withColumn("more", F.col("span").bitwiseAND(F.lit(0xFFFFFFFF))).withColumns({"first_id": first_of("id"), "first_start": F.shiftright(first_of("span"), 32)})
        again = again.unionByName(stored(strings.where(F.col("repeat") | (F.col("id") != F.col("first_id")) | (start != F.col("first_start"))).select("id", one)))
        del strings, asked
        forget()
    repeats = spans_of(again)
    marked = keyed.join(repeats, "id", "left").select("key", "spans", "text")
    kind = marked.schema["key"].dataType.simpleString()
    return marked.mapInArrow(_remover(width), f"key {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def kept_digests(found: DataFrame) -> DataFrame:
    """The result of ``without_repeats`` with the kept bytes' SHA-256 in place of the bytes."""
    return found.select("key", "n_bytes", "removed", F.sha2("kept", 256).alias("sha256"))


def lengths(removed: Column) -> Column:
    return F.aggregate(removed, F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
