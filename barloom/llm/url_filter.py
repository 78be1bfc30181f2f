"""URL filter: host and path rules, then a ratio of character language models. Spark expressions only.

Two smoothed variable-order Markov models give the probability of each character after up to ``order - 1`` others, one
learned from accepted URLs, one from rejected. Witten-Bell smoothing mixes each context with the next shorter one; a context never
seen leaves everything to the shorter. The score of a URL is the difference of both log-likelihoods for each
character. The threshold is where accepted and rejected URLs, taken as two normal distributions of scores, are told apart equally well.

Probabilities are computed once for each distinct n-gram, each order from the one below, and joined with the n-grams of the
distinct URLs. Frequent n-grams are skewed join keys, which adaptive execution splits.

Cases: a null URL has empty host and path, no rule and no score, and is blocked. Without accepted or
without rejected URLs all scores are 0, and every other URL passes. Repeated URLs count once in the models and each get their
row. Empty tables give no rows. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.lineage import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAD, STOP = "\u0002", "\u0003"
ORDER = 5
ALPHABET = 256


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict. rules: ('example.org/es/', 'block'): a host with its subdomains, and how the path begins."""
    named: Column | None = None
    verdict: Column | None = None
    for rule, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, begins = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + begins))
        named = F.when(fits, rule) if named is None else named.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    if named is None or verdict is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return named, verdict


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """One row for each character of each URL: it and the order - 1 characters before."""
    padded = F.concat(F.lit(PAD * (order - 1)), F.translate("url", UPPER, LOWER), F.lit(STOP))
    rows = urls.withColumn("__padded", padded)
    at = F.sequence(F.lit(1), F.length("__padded") - (order - 1))
    return rows.withColumn("gram", F.explode(F.transform(at, lambda i: F.substring(F.col("__padded"), i, F.lit(order))))).drop("__padded", "url")


def _tail(column: str, n: int) -> Column:
    return F.substring(F.col(column), F.length(column) - (n - 1), F.lit(n))


def log_ratios(wanted: DataFrame, learned: DataFrame, order: int) -> DataFrame:
    """gram, ratio: for each distinct gram of ``wanted``, log P(accepted) - log P(rejected) of its last character.

    learned: gram, yes, no (how often it was seen in accepted and rejected URLs).
    """
    below: DataFrame | None = None
    for k in range(1, order + 1):
        grams = wanted.select(_tail("gram", k).alias("gram")).distinct()
        counts = learned.groupBy(_tail("gram", k).alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        begin = F.substring(F.col("gram"), F.lit(1), F.lit(k - 1))
        contexts = counts.groupBy(begin.alias("context")).agg(
            F.sum("yes").alias("n_yes"), F.sum("no").alias("n_no"), F.count(F.when(F.col("yes") > 0, 1)).alias("t_yes"), F.count(F.when(F.col("no") > 0, 1)).alias("t_no")
        )
        rows = grams.join(counts, "gram", "left").withColumn("context", begin)
        # the one context of order 1 is a single row
        rows = rows.join(F.broadcast(contexts) if k == 1 else contexts, "context", "left")
        if below is None:
            rows = rows.withColumns({"b_yes": F.lit(1.0 / ALPHABET), "b_no": F.lit(1.0 / ALPHABET)})
        else:
            rows = rows.withColumn("shorter", _tail("gram", k - 1)).join(below.select(F.col("gram").alias("shorter"), F.col("p_yes").alias("b_yes"), F.col("p_no").alias("b_no")), "shorter")

        def smooth(side: str) -> Column:
            seen, kinds = F.col(f"n_{side}"), F.col(f"t_{side}")
            mixed = (F.coalesce(F.col(side), F.lit(0)) + kinds * F.col(f"b_{side}")) / F.nullif(seen + kinds, F.lit(0))
            return F.coalesce(mixed, F.col(f"b_{side}")).alias(f"p_{side}")

        below = checkpointed(rows.select("gram", smooth("yes"), smooth("no")))
    return below.select("gram", (F.log("p_yes") - F.log("p_no")).alias("ratio"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", accepted: DataFrame | None = None, rejected: DataFrame | None = None, order: int = ORDER) -> DataFrame:
    """Adds host, path, rule, score, threshold and verdict (allow or block); columns of ``pages`` with these names are replaced, the url's own too.

    accepted, rejected: tables of one column ``url`` to learn from. By default the models learn from the pages whose verdict a rule
    decides, all of them.
    """
    named, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("__url", F.col(url)).drop("host", "path", "rule", "score", "threshold", "verdict")
    url = "__url"
    judged = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))}).withColumns({"rule": named, "__ruled": verdict})
    if accepted is None or rejected is None:
        labelled = judged.where(F.col(url).isNotNull() & F.col("__ruled").isNotNull()).select(F.col(url).alias("url"), (F.col("__ruled") == "allow").cast("int").alias("yes"), (F.col("__ruled") == "block").cast("int").alias("no"))
    else:
        labelled = accepted.select("url", F.lit(1).alias("yes"), F.lit(0).alias("no")).unionByName(rejected.select("url", F.lit(0).alias("yes"), F.lit(1).alias("no")))
    labelled = labelled.where(F.col("url").isNotNull()).groupBy("url").agg(F.max("yes").alias("yes"), F.max("no").alias("no"))
    urls = judged.where(F.col(url).isNotNull()).select(F.col(url).alias("url"), F.lit(0).alias("yes"), F.lit(0).alias("no")).unionByName(labelled)
    urls = checkpointed(urls.groupBy("url").agg(F.max("yes").alias("yes"), F.max("no").alias("no")))
    positions = _grams(urls.withColumn("digest", F.unhex(F.md5("url"))), order)
    grams = checkpointed(positions.groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    ratios = log_ratios(grams, grams.where("yes > 0 or no > 0"), order)
    scored = positions.join(ratios, "gram").groupBy("digest").agg(F.avg("ratio").alias("score"), F.max("yes").alias("yes"), F.max("no").alias("no"))
    scored = checkpointed(scored)
    known = scored.agg(
        *(f(F.when(F.col(side) > 0, F.col("score"))).alias(f"{name}_{side}") for side in ("yes", "no") for name, f in (("mean", F.avg), ("sd", F.stddev_pop)))
    ).first()
    both = known["mean_yes"] is not None and known["mean_no"] is not None
    spread = (known["sd_yes"] + known["sd_no"]) if both else 0.0
    threshold = 0.0 if not both else (known["mean_yes"] + known["mean_no"]) / 2 if spread == 0 else (known["mean_yes"] * known["sd_no"] + known["mean_no"] * known["sd_yes"]) / spread
    scores = scored.select(F.col("digest").alias("__digest"), (F.col("score") if both else F.lit(0.0)).alias("score"))
    out = judged.withColumn("__digest", F.unhex(F.md5(F.col(url)))).join(scores, "__digest", "left").withColumn("threshold", F.lit(float(threshold)))
    method = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return out.withColumn("verdict", F.coalesce("__ruled", method)).drop("__digest", "__ruled", "__url")
