"""The queries of this subpackage, with the parameters they are meant to run with, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chat, contamination, filter_audit, minhash, mixing, neighbours, passages, pii, quality, substring_dedup, token_files, url_filter, vector_codes
from barloom.llm.lineage import checkpointed


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").cast("long").alias("vec_id"), "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, epochs=2)
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.near_passages(_table(spark, sf_dir, "documents"), words=50, shingle=5, percent=80)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return found.select(F.col("key").alias("doc_id"), "n_words", covered.alias("n_repeated"), F.size("spans").cast("long").alias("n_spans"), "spans", F.col("partners").alias("partner_ids"), F.col("component").alias("component_id"), F.col("members").alias("n_members"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, k=5)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.kept_digests(substring_dedup.without_repeats(_table(spark, sf_dir, "documents"), width=100))
    return found.select(
        F.col("key").alias("doc_id"), "n_bytes", substring_dedup.lengths(F.col("removed")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.col("sha256").alias("kept_sha256")
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))


URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = pii.personal_data(texts, threshold=0.5).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["order"] < pii.BASE_KINDS)
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in pii.KINDS[: pii.BASE_KINDS]]
    return found.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "mean", "against", "grams", "log_weight", "key", "rank", "kept")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns.unionByName(extra)).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, text = F.col("words"), F.col("text")
    filters = {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 3,
        "D": text.rlike("[#$%&*|]"),
    }
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), filters, marks, repeats="E")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest, folder = token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    found = checkpointed(token_files.read(manifest, folder))
    token_files.delete(spark, folder)
    return found


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return coded.select(F.col("id").alias("vec_id"), vector_codes.hex_code(F.col("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT row, i, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM (SELECT row, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT DISTINCT row, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.words = bw.words),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row),
listed AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN listed USING (row)
"""


OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT row, md5(array_to_string(w[i : i + 3], ' ')) AS g FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
p AS (SELECT a.row AS a, b.row AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.row < b.row GROUP BY a.row, b.row),
e AS (SELECT a, b FROM p JOIN n na ON na.row = a JOIN n nb ON nb.row = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT row AS a, row AS b FROM d UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
least AS (SELECT reach.a AS row, min(d.doc_id) AS component_id FROM reach JOIN d ON d.row = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (row) JOIN least USING (row)
"""


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_n, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS role_n FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i), '')) AS loss_sha256,
  CAST(sum(text_n + CASE WHEN before = role THEN 8 ELSE role_n + 16 + CASE WHEN i > 1 THEN 7 ELSE 0 END END) + 7 AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(w) < 200) AS a, (100 * len(list_distinct(w)) < 50 * len(w)) AS b, (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
c AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
  count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
t AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[1 : step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN translate(fails, before || own, '') = fails THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, own) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN translate(fails, before, '') <> fails AND contains(fails, own) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, own) THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, own) THEN toxic ELSE 0 END) AS toxic_lost
FROM c, t GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every distance to every entry, with three common table expressions for each round."""
    ctes = [
        f"v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS ints FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(embedding) > 0)",
        f"p AS MATERIALIZED (SELECT row, part, ints[part * (len(ints) // {parts}) + 1 : (part + 1) * (len(ints) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part))",
        f"b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x AS c FROM p WHERE row <= {entries})",
    ]
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        ctes.append(f"a{k} AS MATERIALIZED (SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT row, p.part, entry, {far} AS d FROM p JOIN b{k} USING (part)) GROUP BY ALL)")
        if k < rounds:
            floor = "CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END"
            ctes.append(f"s{k} AS (SELECT part, entry, list(CAST({floor} AS BIGINT) ORDER BY place) AS c FROM (SELECT part, entry, place, sum(z) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS z, unnest(range(len(x))) AS place FROM a{k} JOIN p USING (row, part)) GROUP BY ALL) GROUP BY ALL)")
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN s{k} USING (part, entry))")
    return (
        "WITH " + ",\n".join(ctes) + f""",
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT row, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (row), books"""
    )


def _op5_sql(order: int = 5, alphabet: int = 256) -> str:
    """The same rules, models and threshold, with one pair of common table expressions for each order."""
    fits = []
    for rule, what in sorted(URL_RULES, key=lambda r: (-len(r[0]), r[0])):
        at, _, begins = rule.partition("/")
        fits.append((f"(host = '{at}' OR suffix(host, '.{at}')) AND prefix(path, '/{begins}')", rule, what))
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    parts = [
        rf"""h AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages)""",
        f"r AS (SELECT *, {case(1)} AS rule, {case(2)} AS ruled FROM h)",
        "u AS (SELECT url, max(CAST(coalesce(ruled = 'allow', false) AS INT)) AS yes, max(CAST(coalesce(ruled = 'block', false) AS INT)) AS no FROM r WHERE url IS NOT NULL GROUP BY url)",
        f"s AS (SELECT *, repeat(chr(2), {order - 1}) || translate(url, '{_UPPER}', '{_LOWER}') || chr(3) AS padded FROM u)",
        f"p AS (SELECT url, yes, no, substr(padded, i, {order}) AS gram FROM (SELECT *, unnest(range(1, length(padded) - {order - 1} + 1)) AS i FROM s))",
        "g AS (SELECT gram, sum(yes) AS yes, sum(no) AS no FROM p GROUP BY gram)",
    ]
    for k in range(1, order + 1):
        below = f"JOIN p{k - 1} AS b ON b.gram = right(w.gram, {k - 1})" if k > 1 else f"CROSS JOIN (SELECT 1.0::DOUBLE / {alphabet} AS p_yes, 1.0::DOUBLE / {alphabet} AS p_no) AS b"
        smooth = lambda side: f"coalesce((coalesce(c.{side}, 0) + t_{side} * b.p_{side}) / nullif(n_{side} + t_{side}, 0), b.p_{side}) AS p_{side}"
        parts += [
            f"c{k} AS (SELECT right(gram, {k}) AS gram, CAST(sum(yes) AS DOUBLE) AS yes, CAST(sum(no) AS DOUBLE) AS no FROM g WHERE yes > 0 OR no > 0 GROUP BY 1)",
            f"x{k} AS (SELECT left(gram, {k - 1}) AS context, sum(yes) AS n_yes, sum(no) AS n_no, count(*) FILTER (yes > 0) AS t_yes, count(*) FILTER (no > 0) AS t_no FROM c{k} GROUP BY 1)",
            f"p{k} AS (SELECT w.gram, {smooth('yes')}, {smooth('no')} FROM (SELECT DISTINCT right(gram, {k}) AS gram FROM g) AS w LEFT JOIN c{k} AS c ON c.gram = w.gram LEFT JOIN x{k} AS x ON x.context = left(w.gram, {k - 1}) {below})",
        ]
    parts += [
        f"scored AS (SELECT url, max(yes) AS yes, max(no) AS no, avg(ln(p_yes) - ln(p_no)) AS score FROM p JOIN p{order} USING (gram) GROUP BY url)",
        "k AS (SELECT avg(score) FILTER (yes > 0) AS ma, stddev_pop(score) FILTER (yes > 0) AS sa, avg(score) FILTER (no > 0) AS mr, stddev_pop(score) FILTER (no > 0) AS sr FROM scored)",
    ]
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= (ma * sr + mr * sa) / (sa + sr) THEN 'allow' ELSE 'block' END) AS verdict, score FROM r LEFT JOIN scored USING (url) CROSS JOIN k"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_neighbours": op1_neighbours, "op2_mixing": op2_mixing, "op3_passages": op3_passages, "op4_decontamination": op4_decontamination, "op5_url_filter": op5_url_filter, "op6_pii": op6_pii, "op7_substring_dedup": op7_substring_dedup, "op8_minhash": op8_minhash, "op9_quality": op9_quality, "op10_chat": op10_chat, "op11_filter_audit": op11_filter_audit, "op12_token_files": op12_token_files, "op13_vector_codes": op13_vector_codes}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op5_url_filter": _op5_sql(), "op8_minhash": OP8_SQL, "op10_chat": OP10_SQL, "op11_filter_audit": OP11_SQL, "op13_vector_codes": _op13_sql()}
