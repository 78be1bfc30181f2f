"""How the filters of a corpus interact: survivors of every subset of filters, and what each step of every order removes.

Each document gets a mask with a bit for each filter that it fails. Documents are counted by part and mask; the subset-zeta
transform turns these counts into sums over all submasks, so the survivors of a set of filters are the sum at the set's complement. A step
of an order is the difference between two neighbouring sets; the same holds for counts of labelled documents.

Cases: a null text is empty, a null part is the empty string. A filter whose condition is null isn't failed. Repeated documents
each count. Labels that occur several times for a document count once; documents or labels without id match nothing. A document without id has no
smaller id before it, and is before none. Very long texts are read whole. An empty table has no parts, so no rows. Only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.lineage import checkpointed, forget, stored

#: Filters up to which all orders are listed: 720 orders of 6 steps for each part.
MOST_FILTERS = 6


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII blanks."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def masked(docs: DataFrame, filters: Mapping[str, Column], part: str = "lang", doc_id: str = "doc_id", text: str = "text", repeats: str | None = None) -> DataFrame:
    """doc_id, part, mask. filters: failure conditions by name, on ``text`` and ``words`` (its words), bit 0 first.

    ``repeats`` names one more filter, the last bit: the same text stands at a smaller id, wherever in the table.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    mask = sum(bits, F.lit(0)).cast("int").alias("mask")
    if repeats is None:
        return stored(rows.select("doc_id", "part", mask))
    own = stored(rows.select("doc_id", "part", mask, F.unhex(F.sha2("text", 256)).alias("digest")))
    # partial minima shrink a group of copies before the shuffle; kept, they meet plain rows in a join that may be split where a group is large
    first = stored(own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    out = stored(own.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(later, 1 << len(filters)).otherwise(0)).alias("mask")))
    forget(own, first)
    return out


def mask_counts(masks: DataFrame, labels: DataFrame, marks: Mapping[str, Column], label_id: str = "doc_id") -> DataFrame:
    """part, mask, n and a count for each of ``marks``, conditions on the columns of ``labels``: documents of which a label meets it."""
    held = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(f"is_{m}") for m, c in marks.items()))
    rows = masks.join(held, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.count_if(F.col(f"is_{m}")).alias(m) for m in marks))


def _with_bit(counts: Column, bit: int) -> Column:
    """One pass of the zeta transform: what stands at the masks without the bit is added to those with it."""
    return F.transform(counts, lambda x, at: F.when(at.bitwiseAND(F.lit(bit)) != 0, x + F.get(counts, at - bit)).otherwise(x))


def survivors(counts: DataFrame, n_filters: int, values: Sequence[str]) -> DataFrame:
    """For each part, an array by subset of filters (bits as in the masks) for each of ``values``: what is left after those filters, in ``left_<value>``; ``at_<value>``: the counts themselves."""
    size = 1 << n_filters
    dense = lambda v: F.aggregate(F.collect_list(F.struct("mask", v)), F.array_repeat(F.lit(0).cast("long"), size), lambda acc, x: F.transform(acc, lambda a, at: F.when(at == x["mask"], a + x[v]).otherwise(a)))
    out = counts.groupBy("part").agg(*(dense(v).alias(f"at_{v}") for v in values))
    out = out.withColumns({f"sum_{v}": F.col(f"at_{v}") for v in values})
    for i in range(n_filters):  # a projection for each bit, so that expressions don't nest
        out = out.withColumns({f"sum_{v}": _with_bit(F.col(f"sum_{v}"), 1 << i) for v in values})
    # what survives a set has failed within its complement, so the sums are read backwards
    return out.select("part", *(f"at_{v}" for v in values), *(F.reverse(f"sum_{v}").alias(f"left_{v}") for v in values))


def steps(counts: DataFrame, names: str, marks: Sequence[str]) -> DataFrame:
    """Of each part, order and step: what ``audit`` returns. counts: part, mask, n and ``marks``."""
    n, factorial = len(names), [1]
    for i in range(n):
        factorial.append(factorial[-1] * (i + 1))
    left = survivors(counts, n, ["n", *marks])
    orders = F.array(*(F.lit("".join(p)) for p in permutations(names)))
    rows = left.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit_of = F.create_map(*(x for i, name in enumerate(names) for x in (F.lit(name), F.lit(1 << i))))
    chosen = F.transform(F.sequence(F.lit(1), F.col("step")), lambda i: F.element_at(bit_of, F.substring(F.col("filter_order"), i, F.lit(1))))
    rows = rows.withColumn("chosen", chosen).withColumn("bit", F.element_at("chosen", -1)).withColumn("after", F.aggregate("chosen", F.lit(0), lambda a, x: a + x)).withColumn("before", F.col("after") - F.col("bit"))
    at = lambda array, place: F.get(F.col(array), place)
    gone = lambda v: at(f"left_{v}", F.col("before")) - at(f"left_{v}", F.col("after"))
    failing = at("left_n", F.lit(0)) - at("left_n", F.col("bit"))
    # in how many orders a set stands just before a filter: those of the set times those of the rest
    weights = F.array(*(F.lit(factorial[s.bit_count()] * factorial[max(0, n - 1 - s.bit_count())]) for s in range(1 << n)))
    others = F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    share = F.aggregate(others, F.lit(0).cast("long"), lambda a, s: a + F.get(weights, s) * (at("left_n", s) - at("left_n", s + F.col("bit"))))
    return rows.select(
        "part", "filter_order", "step", at("left_n", F.col("after")).alias("kept"), gone("n").alias("removed"), (failing - gone("n")).alias("redundant"), at("at_n", F.col("bit")).alias("unique_fails"),
        *(gone(m).alias(f"{m}_lost") for m in marks), share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], marks: Mapping[str, Column], repeats: str | None = None, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant (failing the step's filter, gone before), unique_fails
    (failing that filter only), <mark>_lost (removed here, of those with a mark) and shapley (removed by the step's filter, summed over all orders).

    Names of filters are single characters; an order is their concatenation.
    """
    names = "".join([*filters, *([repeats] if repeats else [])])
    if not names or len(set(names)) < len(filters) + bool(repeats) or len(names) != len(filters) + bool(repeats):
        raise ValueError("filters have different names of one character")
    if len(names) > MOST_FILTERS:
        raise ValueError(f"all orders are listed, so at most {MOST_FILTERS} filters")
    masks = masked(docs, filters, part, doc_id, text, repeats)
    counts = checkpointed(mask_counts(masks, labels, marks))
    forget(masks)
    return steps(counts, names, list(marks))
