"""Quality by importance resampling: hashed n-gram models of wanted, raw and unwanted text, and Gumbel top-k.

Words, words with their punctuation and pairs of the latter are hashed into three tables of ``buckets`` counts each. One generative
model is counted over all documents, one over documents labelled good and not toxic, one over those labelled toxic. The
logarithm of the first two's ratio, n-gram by n-gram, gives the mean over a document's words and pairs (is it text
like the wanted?); single words that wanted text lacks, or that toxic text has many times as often, are summed as strong evidence against it.
A bucket is strong evidence if a Poisson count as far off as seen is all but impossible; that keeps rare words
from counting.

Both figures get a limit from labelled documents that the models were not fitted on. A document's log-weight is the smaller of two log ratios: the
sum over its n-grams of the log ratio less the limit, and the evidence less its limit. Gumbel noise is added and the
top k are kept; the target size k is the number of documents whose log-weight is 0 or more. So documents near the limits are drawn
by weight, and clear cases are safe: the noise is below -2.7 once in a million times.

The number of buckets follows the corpus: ``VOCABULARY`` times the root of its words, as vocabularies grow, and at least ``LEAST_BUCKETS``; the
tables are what reaches driver and tasks, some 100 bytes a bucket. The labels used are bounded by
``max_labels``, chosen by hash; counts, scores and the choice cover all documents.

Cases: null texts and texts without words have log-weight 50 and stay. Without usable labels everything stays. Labels with
nulls are unused, of contradicting ones the worst counts. Equal keys go by id, then text; repeated
rows get the same scores, each a rank of its own. Very long texts are read whole. Empty tables give no rows. Extra columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.lineage import checkpointed
from barloom.llm.mixing import global_rank
from barloom.llm.tokens import ALNUM, SPACED, U, chunks, cut_words, mix64

LEAST_BUCKETS, VOCABULARY, WORD_BYTES = 1 << 17, 32, 6
MAX_LABELS = 20_000
#: Evidence: natural logarithm of how unlikely the count is, and the least ratio that counts as strong.
UNLIKELY, STRONG = 12.0, 1.5
#: Log-weight of what nothing speaks against.
SAFE = 50.0


@dataclass
class Limits:
    mean: float = -np.inf
    against: float = -np.inf


def _features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of the three kinds of n-grams, and where each text's begin."""
    plain, spaced = cut_words(data, offsets, ALNUM), cut_words(data, offsets, SPACED)
    single = spaced.hashes()
    pairs, at = spaced.grams(2, single)
    mask = U(buckets - 1)
    found = [(plain.hashes() & mask).astype(np.int64), (mix64(single) & mask).astype(np.int64) + buckets, (pairs & mask).astype(np.int64) + 2 * buckets]
    return found, [plain.first, spaced.first, np.searchsorted(spaced.text[at], np.arange(len(offsets)))]


def _counter(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (model: 1 wanted, 2 toxic, else 0; text): how often each bucket occurs in all, in wanted and in toxic texts, once for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, 3 * buckets), dtype=np.int64)
        for batch, data, offsets in chunks(batches, "text"):
            model = batch.column(0).to_numpy()
            for found, first in zip(*_features(data, offsets, buckets), strict=True):
                np.add.at(counts[0], found, 1)
                for m in (1, 2):
                    if (model == m).any():
                        np.add.at(counts[m], found[np.repeat(model == m, np.diff(first))], 1)
        seen = np.flatnonzero(counts[0])
        for at in range(0, len(seen), 50_000):
            part = seen[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c[part]) for c in counts)], names=["bucket", "raw", "target", "toxic"])

    return run


def _unlikely(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """How unlikely a Poisson count as far off as this is: a bound of its negative logarithm."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(seen > 0, seen * np.log(seen / expected), 0.0) - (seen - expected)


def log_ratio(raw: np.ndarray, target: np.ndarray, toxic: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Log of target over raw probability by bucket, add-one smoothed, and the strong evidence against (0 or negative) of each single word."""
    ratio = np.zeros(3 * buckets, dtype=np.float32)
    for k in range(3):
        part = slice(k * buckets, (k + 1) * buckets)
        expected = raw[part] * (target[part].sum() / max(1, raw[part].sum()))
        ratio[part] = np.log((target[part] + 1) / (expected + 1))
    one = slice(0, buckets)
    expected = raw[one] * (target[one].sum() / max(1, raw[one].sum()))
    lacking = np.where((target[one] < expected) & (_unlikely(target[one], expected) >= UNLIKELY), ratio[one] + STRONG, 0.0)
    expected = (target[one] + 1) * (toxic[one].sum() / max(1, target[one].sum()))
    telling = np.where((toxic[one] > expected) & (_unlikely(toxic[one], expected) >= UNLIKELY), STRONG - np.log((toxic[one] + 1) / (expected + 1)), 0.0)
    return ratio, np.minimum(0.0, np.minimum(lacking, telling)).astype(np.float32)


def _scorer(model, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, against = model.value
        for batch, data, offsets in chunks(batches, "text"):
            found, firsts = _features(data, offsets, buckets)
            sums = []
            for values, f, first in ((against, found[0], firsts[0]), (ratio, found[1], firsts[1]), (ratio, found[2], firsts[2])):
                total = np.zeros(len(f) + 1)
                np.cumsum(values[f], dtype=np.float64, out=total[1:])
                sums.append(total[first[1:]] - total[first[:-1]])
            n = np.diff(firsts[1]) + np.diff(firsts[2])
            mean = (sums[1] + sums[2]) / np.maximum(1, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean), pa.array(np.minimum(0.0, sums[0].round(9))), pa.array(n)], names=["key", "mean", "against", "grams"])

    return run


def _limit(good: np.ndarray, bad: np.ndarray, most_lost: float) -> float:
    """The limit that best separates bad from good values, among those that lose at most that share of the good; values from the limit on stay."""
    if not len(good) or not len(bad):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    edges = np.unique(np.concatenate([good, bad]))
    cuts = (edges[1:] + edges[:-1]) / 2
    lost, caught = np.searchsorted(good, cuts) / len(good), np.searchsorted(bad, cuts) / len(bad)
    fit = np.where(lost <= most_lost, caught - lost, -1.0)
    if not len(cuts) or fit.max() <= 0.05:
        return -np.inf
    best = np.flatnonzero(fit >= fit.max() - 1e-12)
    return float(cuts[best[len(best) // 2]])


def gumbel(*parts: Column) -> Column:
    """Standard Gumbel noise from a hash: the same for the same parts."""
    unit = (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def buckets_for(docs: DataFrame, text: str) -> int:
    """A power of two that follows the root of the corpus' words."""
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("double"))).first()[0] or 0.0
    return max(LEAST_BUCKETS, 1 << math.ceil(math.log2(max(1.0, VOCABULARY * math.sqrt(size / WORD_BYTES)))))


def importance(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None, max_labels: int = MAX_LABELS, most_lost: float = 0.01, seed: int = 29) -> DataFrame:
    """Per document: id, text_hash, mean, against, grams, log_weight, key (log-weight with noise), rank, kept.

    labels: doc_id, quality (1 is good), toxic (1 is toxic). buckets: as many as the corpus needs, if not given.
    """
    spark = docs.sparkSession
    buckets = buckets or buckets_for(docs, text)
    usable = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(max_labels)
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0)
    held_out = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(4)) == 0
    chosen = checkpointed(chosen.select(F.col("doc_id").alias("__labelled"), label.alias("label"), held_out.alias("held_out")))
    marked = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("text_hash")).join(F.broadcast(chosen), F.col("id") == F.col("__labelled"), "left")
    model = F.coalesce(F.when(~F.col("held_out"), F.col("label")), F.lit(0)).alias("model")
    counts = marked.select(model, "text").mapInArrow(_counter(buckets), "bucket long, raw long, target long, toxic long").groupBy("bucket").agg(*(F.sum(c) for c in ("raw", "target", "toxic")))
    table = counts.toArrow()  # at most three tables of buckets
    filled = np.zeros((3, 3 * buckets), dtype=np.float64)
    for row, column in zip(filled, table.columns[1:], strict=True):
        row[table.column(0).to_numpy()] = column.to_numpy()
    del table
    model = spark.sparkContext.broadcast(log_ratio(*filled, buckets))
    del filled
    pa.default_memory_pool().release_unused()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scorer(model, buckets)(batches)

    keyed = marked.select(F.struct("id", "text_hash", F.when(F.col("held_out"), F.col("label")).alias("label")).alias("key"), "text")
    kind = keyed.schema["key"].dataType.simpleString()
    scored = checkpointed(keyed.mapInArrow(score, f"key {kind}, mean double, against double, grams long").select("key.*", "mean", "against", "grams"))
    # one row for each label held out; of documents with one id the worst counts
    known = scored.where("label is not null").groupBy("id").agg(F.first("label").alias("label"), F.min("mean").alias("mean"), F.min("against").alias("against")).toPandas()
    good, poor, toxic = (known[known.label == k] for k in (1, 0, 2))
    limits = Limits(_limit(good["mean"].to_numpy(), poor["mean"].to_numpy(), most_lost), _limit(good["against"].to_numpy(), toxic["against"].to_numpy(), most_lost))
    ratios = [F.col("grams") * (F.col("mean") - limits.mean)] if np.isfinite(limits.mean) else []
    ratios += [F.col("against") - limits.against] if np.isfinite(limits.against) else []
    weight = F.when(F.col("grams") == 0, SAFE).otherwise(F.least(F.lit(SAFE), F.lit(SAFE), *ratios))
    weighed = scored.withColumn("log_weight", weight).withColumn("key", F.col("log_weight") + gumbel(F.lit(seed), F.col("id"), F.col("text_hash")))
    size = weighed.agg(F.count("*").alias("n"), F.count(F.when(F.col("log_weight") >= 0, 1)).alias("k")).first()
    ranked = global_rank(weighed.drop("label"), [F.desc("key"), F.col("id"), F.col("text_hash")], "rank", size["n"])
    return ranked.withColumn("kept", F.col("rank") <= size["k"])


def resampled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are kept, with all their columns. Rows with equal id and text share their fate."""
    gone = importance(docs, labels, doc_id, text, **options).where("not kept").select(F.struct("id", F.col("text_hash").alias("hash")).alias("__key")).distinct()
    return docs.withColumn("__key", F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))).join(gone, "__key", "left_anti").drop("__key")
