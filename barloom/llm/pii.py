r"""Personal data by patterns, checksums and context, with Spark expressions only.

Patterns propose spans. Validators confirm them: Luhn for cards, modulo 97 for bank accounts (IBAN), 255 as the
largest part of an address, the number of digits of phones. Words near a span adjust its score. The four base kinds
(email, ip, card, phone) stay whatever their score; of the other kinds (iban, national id) those with
``threshold`` or more.

Everything is local to a row: gaps and matches of one pattern alternate, so positions are running sums of
their lengths, and nothing is shuffled. The patterns begin only where a run of their characters begins and never give
back what they took, which finds the same spans without backtracking over long runs.

Cases: a null text is empty and has no spans; repeated rows each get their spans; very long texts are searched
whole; empty tables give no rows. Positions count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUM_BLOCK = 256
CONTEXT = 40
KINDS = ("email", "ip", "card", "phone", "iban", "nid")
BASE_KINDS = 4
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "nid": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text needs to hold for a pattern to be worth trying.
HINTS = {"email": "@", "ip": ".", "phone": "+", "nid": "-"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "nid": 0.3}
WORDS = {
    "email": "mail|contact|write|reply",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|master|credit|debit|pay",
    "phone": "phone|call|tel|fax|mobile|dial",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "nid": "ssn|social|security|national|passport",
}


def running_sums(values: Column) -> Column:
    """Sums before each entry and, last, of all. In blocks, so that long arrays are not copied once for each entry."""
    zero = F.array(F.lit(0).cast("long"))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / SUM_BLOCK).cast("int") - 1)), lambda b: F.aggregate(F.slice(values, b * SUM_BLOCK + 1, SUM_BLOCK), zero, grow))
    starts = F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), zero, grow)
    inner = F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda b, s: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + s))
    return F.concat(F.flatten(inner), F.slice(starts, -1, 1))


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits has a valid check digit."""
    turned = F.reverse(digits)
    value = lambda i: F.substring(turned, i, F.lit(1)).cast("int")
    each = lambda acc, i: acc + F.when(i % 2 == 1, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), F.lit(0), each) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces passes ISO 7064 modulo 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))

    def each(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, acc * 100 + code - 55).otherwise(acc * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(account))), F.lit(0), each) == 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(bare) <= 3) & (F.when(F.length(bare) <= 3, bare).cast("int") <= 255)


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small),
    "card": _card,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": lambda m: F.when(F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34), mod97(F.replace(m, F.lit(" "), F.lit("")))).otherwise(F.lit(False)),
    "nid": lambda m: ~F.substring(m, F.lit(1), F.lit(3)).isin("000", "666") & (F.substring(m, F.lit(1), F.lit(1)) != "9") & (F.substring(m, F.lit(5), F.lit(2)) != "00") & (F.substring(m, F.lit(8), F.lit(4)) != "0000"),
}


def _spans(df: DataFrame, text: str, kind: str) -> DataFrame:
    """Adds the column ``kind``: array of (start, order, kind, end, score, match) of the confirmed matches."""
    pattern, order = PATTERNS[kind], KINDS.index(kind)
    none = F.expr("cast(array() as array<string>)")
    hinted = F.contains(F.col(text), F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
    df = df.withColumn("__m", F.when(hinted, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split(text, pattern)).otherwise(none))
    steps = F.zip_with("__g", F.transform("__m", F.length), lambda g, m: F.length(g).cast("long") + F.coalesce(m, F.lit(0)))
    df = df.withColumn("__n", steps)
    df = df.withColumn("__s", F.when(F.size("__m") > 0, running_sums(F.col("__n"))).otherwise(F.expr("cast(array() as array<bigint>)")))

    def one(match: Column, i: Column) -> Column:
        end = F.get("__s", i + 1)
        near = F.lower(F.concat(F.right(F.get("__g", i), F.lit(CONTEXT)), F.lit(" "), F.left(F.get("__g", i + 1), F.lit(CONTEXT))))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(rf"\b(?:{WORDS[kind]})"), 0.3).otherwise(0.0)
        return F.struct((end - F.length(match)).alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), end.alias("end"), score.alias("score"), VALID[kind](match).alias("valid"), match.alias("match"))

    found = F.filter(F.transform("__m", one), lambda s: s["valid"])
    return df.withColumn(kind, F.transform(found, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "order", "kind", "end", "score", "match"))))).drop("__m", "__g", "__n", "__s")


def personal_data(docs: DataFrame, text: str = "text", threshold: float = 0.5, as_name: str = "spans") -> DataFrame:
    """Adds ``as_name``: array of (start, order, kind, end, score, match), sorted, of all spans found in ``text``. Other columns stay, but for one of that name."""
    if set(KINDS) & {c.lower() for c in docs.columns}:  # columns named like the kinds are put aside
        inner = docs.select(F.struct(*docs.columns).alias("__kept"), F.col(text).alias("__own"))
        found = personal_data(inner, "__own", threshold, "__found")
        return found.select(*(F.col("__kept")[c].alias(c) for c in docs.columns if c != as_name), F.col("__found").alias(as_name))
    for kind in KINDS:
        docs = _spans(docs, text, kind)
    sure = [F.col(k) if i < BASE_KINDS else F.filter(F.col(k), lambda s: s["score"] >= threshold) for i, k in enumerate(KINDS)]
    return docs.withColumn(as_name, F.sort_array(F.concat(*sure))).drop(*KINDS)


def redacted(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, overlapping spans by the first's. All columns stay; a null text stays null."""
    columns = docs.columns
    inner = docs.select(F.struct(*columns).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    found = personal_data(inner, "__text", threshold, "__spans")

    def grow(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.when(fresh, F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("from"), (s["start"] - acc["at"]).alias("n"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark"))))).otherwise(acc["parts"]).alias("parts"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    start = F.struct(F.expr("cast(array() as array<struct<from:bigint,n:bigint,mark:string>>)").alias("parts"), F.lit(0).cast("long").alias("at"))
    found = found.withColumn("__cut", F.aggregate("__spans", start, grow))
    pieces = F.transform("__cut.parts", lambda p: F.concat(F.substring(F.col("__text"), (p["from"] + 1).cast("int"), p["n"].cast("int")), p["mark"]))
    whole = F.concat(F.array_join(pieces, ""), F.substring(F.col("__text"), (F.col("__cut.at") + 1).cast("int"), F.lit(2147483647)))
    clean = F.when(F.size("__spans") > 0, whole).otherwise(F.col("__row")[text])
    return found.select(*(clean.alias(c) if c == text else F.col("__row")[c].alias(c) for c in columns))
