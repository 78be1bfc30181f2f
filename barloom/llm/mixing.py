"""Mixing sources to target weights by weighted fair queueing.

The documents of a source queue in a shuffled order that depends only on their ids, texts' sizes and a
seed, and queue up again for each further epoch. The virtual finish time of a copy is the words queued in its source so far,
its own included, divided by the source's target. All copies are sorted by finish time over the whole
cluster and taken until the budget is used up.

Cases: null texts have size 0. A null source is a source of its own, after all others. Documents of size
0 are never taken. Equal finish times go by shuffled order and id; rows alike in all of these count
one after the other. An empty table gives an empty mix. Extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.lineage import checkpointed

ROWS_PER_RANGE = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def running_total(df: DataFrame, order: Sequence[Column], value: str, name: str, rows: int) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one in the global ``order``.

    Range partitions are summed on their own, then each begins where the one before ends: no task sees
    more than one range, and only one sum for each range meets the others.
    """
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_PER_RANGE + 1)
    parts = checkpointed(df.repartitionByRange(ranges, *order).withColumn("__part", F.spark_partition_id()))
    sums = parts.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each range
    starts = sums.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("__inside", inside).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__inside")).drop("__part", "__inside", "__start")


def global_rank(df: DataFrame, order: Sequence[Column], name: str, rows: int) -> DataFrame:
    """Adds the row number, from 1, in the global ``order``."""
    return running_total(df.withColumn("__one", F.lit(1)), order, "__one", name, rows).drop("__one")


def fair_targets(sources: DataFrame, budget: float, epochs: int) -> DataFrame:
    """Adds target: ``budget`` shared by weight, no source above ``epochs`` times its size.

    sources: size, weight. Each step finds the sources whose share exceeds their limit and shares the
    rest among the others, until none is above; only sums reach the driver.
    """
    limit = F.col("size").cast("double") * epochs
    level = None
    while True:
        full = F.lit(False) if level is None else limit <= F.col("weight") * level
        got = sources.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("used"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).cast("double").alias("weight"), F.count(F.when(full, 1)).alias("full")
        ).first()
        above = got["full"]
        if level is not None and above == seen:
            break
        if not got["weight"]:
            level = float("inf")
            break
        seen, level = above, max(0.0, budget - got["used"]) / got["weight"]
    target = limit if level == float("inf") else F.when(limit <= F.col("weight") * level, limit).otherwise(F.col("weight") * level)
    return sources.withColumn("target", target)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 17) -> DataFrame:
    """Per document: id, source, text_hash, size, source_size, target, copies (epochs that the mix takes), taken (words).

    The n-th source by code point has weight ``weights[n % len(weights)]``; the budget is ``share`` times
    all words.
    """
    sizes = docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = checkpointed(sizes)
    per_source = checkpointed(sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    total = per_source.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.count("*").alias("sources")).first()
    ranked = global_rank(per_source, [F.col("source").asc_nulls_last()], "rank", total["sources"])
    shares = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(shares, ((F.col("rank") - 1) % len(weights)).cast("int")))
    sources = fair_targets(checkpointed(ranked), share * total["words"], epochs)
    sources = running_total(sources, [F.col("rank")], "size", "upto", total["sources"]).select(F.col("source").alias("__source"), F.col("size").alias("source_size"), "target", (F.col("upto") - F.col("size")).alias("from"), "rank")
    sources = checkpointed(sources)
    budget = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    rows = sizes.withColumn("shuffled", F.xxhash64(F.lit(seed), F.col("id"), F.col("text_hash")))
    small = total["sources"] <= 10_000
    rows = rows.join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    queued = running_total(rows, [F.col("rank"), F.col("shuffled"), F.col("id"), F.col("text_hash")], "size", "queue", total["docs"]).withColumn("queue", F.col("queue") - F.col("from"))
    queued = checkpointed(queued)
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    copies = queued.where((F.col("size") > 0) & (F.col("target") > 0)).select("rank", "queue", "size", "source_size", "target", epoch)
    copies = copies.select(((F.col("epoch") * F.col("source_size") + F.col("queue")) / F.col("target")).alias("finish"), "rank", "queue", "size")
    order = [F.col("finish"), F.col("rank"), F.col("queue")]
    taken = running_total(copies, order, "size", "total", total["docs"] * epochs)
    last = taken.where(F.col("total") <= budget).agg(F.max(F.struct("finish", "rank", "queue")).alias("last")).first()["last"]
    if last is None:
        times = F.lit(0)
    else:
        at = lambda e: (e * F.col("source_size") + F.col("queue")) / F.col("target")
        until = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["rank"]).alias("rank"), F.lit(last["queue"]).alias("queue"))
        within = [F.when(F.struct(at(F.lit(e)).alias("finish"), F.col("rank"), F.col("queue")) <= until, 1).otherwise(0) for e in range(epochs)]
        times = F.when((F.col("size") > 0) & (F.col("target") > 0), sum(within[1:], within[0])).otherwise(0)
    out = queued.withColumn("copies", times.cast("int"))
    return out.select("id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, with all their columns. Rows with equal id, source and text share their copies evenly."""
    key = lambda i, s, h: F.struct(i.alias("id"), s.alias("source"), h.alias("hash"))
    plan = mix(docs, doc_id, text, source, **options).groupBy(key(F.col("id"), F.col("source"), F.col("text_hash")).alias("__key")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    marked = docs.withColumn("__key", key(F.col(doc_id), F.col(source).cast("string"), F.xxhash64(text))).join(plan.where("__copies > 0"), "__key")
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(1)))
    times = F.expr("cast(__copies div __rows as int)") + (F.col("__nth") <= F.col("__copies") % F.col("__rows")).cast("int")
    return marked.withColumn("__nth", nth).withColumn("__copy", F.explode(F.sequence(F.lit(0), times))).where("__copy > 0").select(*docs.columns)
