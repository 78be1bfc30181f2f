"""Benchmark decontamination by winnowing.

Of each ``window`` consecutive words the least hash of their k-grams is selected; a selected k-gram, with where it stands, is a fingerprint,
one for all windows that select it. Fingerprints of
documents that no benchmark has fall away in a bitmap of fixed size; the rest are joined with the
benchmark's and each hit is extended word for word to both sides, as far as a window around it can reach. It counts if ``window`` words or more agree. Whole hashes are
compared, the leftmost of equal ones is taken: what a window selects depends on its words alone, so no shared span of that length is missed.

Cases: a null or empty text, or one without words, has no words and no hits. An item of fewer than
``window`` words is one passage, known by the hash of all its words; an item without words or without id takes no part. Equal hashes inside a window go to the first. Repeated documents
each get their row; repeated items count once. Very long texts are read whole. Empty tables give no
rows, or rows without hits. Columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.bitmap import BITS, bitmap_array
from barloom.llm.lineage import checkpointed, stored
from barloom.llm.tokens import ALNUM, U, Words, chunks, cut_words, mix64, window_least

FOUND = "array<struct<start:long,n:long,mark:long,before:array<string>,words:array<string>>>"
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("mark", pa.int64()), ("before", pa.list_(pa.string())), ("words", pa.list_(pa.string()))]))
#: Benchmark fingerprints up to which they are sent to every task; more are joined by shuffling.
SENT = 100_000


def _selected(words: Words, window: int, k: int, long: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the k-grams that any window of these texts selects: the least hash, the leftmost of equal ones. Which is selected depends on the window alone."""
    grams, at = words.grams(k)
    n = len(words.start) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    dense = np.zeros(len(words.start), dtype=U)
    dense[at] = grams >> U(64 - bits)
    _, least = window_least(dense[: n + window - k], window - k + 1)
    start = np.flatnonzero((words.text[:n] == words.text[window - 1 : window - 1 + n]) & long[words.text[:n]])
    place = np.unique(least[start]).astype(np.int64)
    return place, dense[place]


def _whole(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all passages of n words, for short items."""
    grams, at = words.grams(n)
    return at, mix64(grams ^ U(n))


def _finder(window: int, k: int, bitmap: np.ndarray | None, lengths: list[int], bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (key, text): (key, n_words, found). Without a bitmap all fingerprints of items, else those of documents that are in it.

    found: n is 0 for a selected k-gram, ``words`` are then its words and the ``window - k`` after it, ``before`` those before it, nearest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "text"):
            words = cut_words(data, offsets, ALNUM)
            counts = words.counts
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for n in [0, *(lengths if bitmap is not None else range(1, window))]:
                start, mark = _whole(words, n) if n else _selected(words, window, k, counts >= window, bits)
                if bitmap is not None:
                    hit = bitmap[(mark & U(len(bitmap) - 1)).astype(np.int64)]
                else:
                    hit = counts[words.text[start]] == n if n else np.ones(len(start), dtype=bool)
                for at, m in zip(start[hit].tolist(), mark[hit].view(np.int64).tolist(), strict=True):
                    text = int(words.text[at])
                    low, high = (at, at + n) if n else (max(int(words.first[text]), at - window + k), min(int(words.first[text + 1]), at + window))
                    around = words.strings(low, high - low).split(" ")
                    rows[text].append({"start": at - int(words.first[text]), "n": n, "mark": m, "before": around[: at - low][::-1], "words": around[at - low :]})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(rows, _FOUND)], names=["key", "n_words", "found"])

    return run


def benchmark_passages(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10, k: int = 5, hash_bits: int = 64) -> DataFrame:
    """The distinct fingerprints of a benchmark with what stands around them: mark, n, item_before, item_words, items (sorted distinct item ids)."""
    found = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("key"), F.col(text).cast("string").alias("text"))
    kind = found.schema["key"].dataType.simpleString()
    found = found.mapInArrow(_finder(window, k, None, [], hash_bits), f"key {kind}, n_words long, found {FOUND}")
    found = found.select("key", F.inline("found")).withColumnsRenamed({"before": "item_before", "words": "item_words"})
    return found.groupBy("mark", "n", "item_before", "item_words").agg(F.sort_array(F.collect_set("key")).alias("items"))


def _agreeing(a: str, b: str) -> Column:
    """How many words two lists have in common from their first on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("long"))


def contamination(
    docs: DataFrame, items: DataFrame, doc_key: Column | str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, bitmap_bits: int = BITS, sent: int = SENT, hash_bits: int = 64
) -> DataFrame:
    """For each document: key, n_words, n_hit (words inside benchmark passages), items (sorted distinct ids).

    ``hash_bits``: of the hashes that choose fingerprints; results are the same for any number, but fewer meet in vain the more there are.
    """
    if not 1 <= k <= window or not 1 <= hash_bits <= 64:
        raise ValueError("k must lie between 1 and window, hash_bits between 1 and 64")
    passages = stored(benchmark_passages(items, item_id, item_text, window, k, hash_bits))
    lengths = sorted(r["n"] for r in passages.where(F.col("n") > 0).select("n").distinct().collect())
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_array(passages, "mark", bitmap_bits))
    key = F.col(doc_key) if isinstance(doc_key, str) else doc_key

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _finder(window, k, bitmap.value, lengths, hash_bits)(batches)

    texts = docs.select(F.struct(key.alias("id"), F.monotonically_increasing_id().alias("row")).alias("key"), F.col(doc_text).cast("string").alias("text"))
    kind = texts.schema["key"].dataType.simpleString()
    rows = checkpointed(texts.mapInArrow(find, f"key {kind}, n_words long, found {FOUND}"))
    found = rows.where(F.size("found") > 0).select(F.col("key.row").alias("row"), F.inline("found"))
    met = found.join(F.broadcast(passages) if passages.count() <= sent else passages, ["mark", "n"])
    met = met.withColumns({"left": F.when(F.col("n") == 0, _agreeing("before", "item_before")).otherwise(0), "right": _agreeing("words", "item_words")})
    reached = F.when(F.col("n") == 0, (F.col("right") >= k) & (F.col("left") + F.col("right") >= window)).otherwise(F.col("right") == F.col("n"))
    hits = met.where(reached).select("row", (F.col("start") - F.col("left")).alias("start"), (F.col("left") + F.col("right")).alias("n"), "items")
    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, F.lit(0))))
    per_row = hits.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    none = F.expr(f"cast(array() as {passages.schema['items'].dataType.simpleString()})")
    return (
        rows.select(F.col("key.id").alias("key"), F.col("key.row").alias("row"), "n_words")
        .join(per_row, "row", "left")
        .select("key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    )


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark passage occurs, with all their columns. Rows with equal id and text share their fate."""
    marked = docs.withColumns({"__id": F.col(doc_id), "__hash": F.xxhash64(text)})
    found = contamination(marked, items, F.struct("__id", "__hash"), text, **options)
    hit = found.where(F.col("n_hit") > 0).select(F.col("key.__id").alias("__hit_id"), F.col("key.__hash").alias("__hit_hash")).distinct()
    same = marked["__id"].eqNullSafe(hit["__hit_id"]) & (marked["__hash"] == hit["__hit_hash"])
    return marked.join(hit, same, "left_anti").drop("__id", "__hash")
