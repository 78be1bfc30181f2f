"""The training-data queries on small tables: against SQL, brute force and round trips, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.llm import chat, contamination, minhash, mixing, neighbours, passages, pii, quality, substring_dedup, url_filter
from barloom.llm.components import connected_components
from barloom.llm.tokens import window_least

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, kind=SPACED):
    return kind.findall((text or "").translate(UPPER))


def documents(spark, texts, source=lambda i: "ab"[i % 2]):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", ["op4_decontamination", "op5_url_filter", "op8_minhash", "op10_chat"])
def test_queries_agree_with_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    key = got.columns[0]
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c], want[c], atol=1e-9)
        else:
            assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_neighbours_recall_and_exact_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    vectors, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    got = defaultdict(list)
    for r in entry.queries()["op1_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(got) == sorted(asked)
    found = 0
    at = {v: i for i, v in enumerate(ids.tolist())}
    for q in asked:
        scores = vectors @ vectors[at[q]]
        best = sorted((x for x in ids.tolist() if x != q), key=lambda x: (-scores[at[x]], x))[:20]
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        found += len({v for _, v, _ in got[q]} & set(best))
        for _, v, score in got[q]:
            assert math.isclose(score, scores[at[v]], rel_tol=1e-9, abs_tol=1e-12)
    assert found >= 0.9 * 20 * len(asked)


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    same = rng.normal(size=6).tolist()
    data = [(i, rng.normal(size=6).tolist(), 0) for i in range(1, 40)] + [(100 + i, same, 0) for i in range(25)] + [(200, None, 0), (201, [0.0] * 6, 0), (202, [float("nan")] + [1.0] * 5, 0), (203, [None] + [1.0] * 5, 0), (204, [float("inf")] * 6, 0), (205, [1.0], 0), (None, same, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, id int")
    got = neighbours.nearest(df, F.col("id") % 20 == 0, k=20).collect()
    assert {r["query_id"] for r in got} == {20, 100, 120} and not {r["id"] for r in got} & {200, 201, 202, 203, 204, 205}
    own = [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 100]
    best = {r["query_id"]: r["score"] for r in got if r["rank"] == 1}
    assert len(own) == 20 and 100 not in own and own[:3] == [101, 102, 103] or best[100] > np.dot(same, same)
    assert neighbours.nearest(df.where("vec_id = 20"), F.col("id") % 20 == 0, k=3).count() == 0
    assert neighbours.nearest(df.where("false"), F.col("id") % 20 == 0, k=3).count() == 0


@pytest.mark.parametrize("size", [1e-9, 1.0, 1e9])
def test_neighbours_that_share_an_id(spark, size):
    """Twin rows, alike or not, are candidates of each other; components beyond half precision keep their order."""
    rng = np.random.default_rng(9)
    a, b, c = ((rng.normal(size=4) * size).tolist() for _ in range(3))
    data = [(20, a), (20, a), (20, b), (40, c), (7, a), (8, b), (9, c)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("id") % 20 == 0, k=10).collect():
        got[r["query_id"], r["rank"]].append((r["id"], r["score"]))
    want = defaultdict(list)
    for i, (q, v) in enumerate(data):
        if q % 20 == 0:
            others = sorted(((float(np.dot(v, w)), x) for j, (x, w) in enumerate(data) if j != i), key=lambda t: (-t[0], t[1]))
            for rank, (score, x) in enumerate(others, 1):
                want[q, rank].append((x, score))
    assert set(got) == set(want)
    for key in want:
        found, due = sorted(got[key]), sorted(want[key])
        assert [x for x, _ in found] == [x for x, _ in due], key
        np.testing.assert_allclose([s for _, s in found], [s for _, s in due], rtol=1e-9)


def test_mix_meets_its_targets_and_reruns_agree(spark, rows):
    got = {r["doc_id"]: r for r in entry.queries()["op2_mixing"](spark, SF).collect()}
    again = {r["doc_id"]: r["taken"] for r in entry.queries()["op2_mixing"](spark, SF).collect()}
    assert {k: v["taken"] for k, v in got.items()} == again
    sizes, source = {r["doc_id"]: len(words(r["text"])) for r in rows}, {r["doc_id"]: r["source"] for r in rows}
    per = Counter()
    for d, n in sizes.items():
        per[source[d]] += n
    order = sorted((s for s in per if s is not None)) + [None] * (None in per)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, budget = {}, set(order), 1.5 * sum(per.values())
    while True:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * per[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * per[s] for s in full}
        budget -= sum(2 * per[s] for s in full)
        open_ -= full
        if not open_:
            break
    taken = Counter()
    for d, r in got.items():
        assert r["size"] == sizes[d] and r["source_size"] == per[source[d]] and math.isclose(r["target"], target[source[d]], rel_tol=1e-9) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[d]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * max(n for d, n in sizes.items() if source[d] == s) + 1


def test_mix_of_odd_rows(spark):
    df = documents(spark, [None, "", "a b", "a b", "c " * 50, "d"], lambda i: None if i == 5 else "x").withColumn("size", F.lit("mine"))
    out = mixing.mixed(df, weights=(1,), share=1.0, epochs=1)
    assert out.columns == df.columns and out.count() >= 3
    assert mixing.mix(df.where("false")).count() == 0


def brute_passages(texts, t, k, percent):
    toks = [[tuple(w[i : i + k]) for i in range(len(w) - k + 1)] for w in map(words, texts)]
    wins = [(d, a, frozenset(x[a : a + t])) for d, x in enumerate(toks) for a in range(len(x) - t + 1)]
    holds = defaultdict(list)
    for i, (_, _, s) in enumerate(wins):
        for g in s:
            holds[g].append(i)
    covered = [set() for _ in texts]
    for i, (d, a, s) in enumerate(wins):
        shared = Counter(j for g in s for j in holds[g])
        for j, n in shared.items():
            e, b, other = wins[j]
            if (e != d or abs(a - b) >= t) and 100 * n >= percent * (len(s) + len(other) - n):
                covered[d] |= set(range(a, a + t + k - 1))
                break
    return covered


def test_passages_by_brute_force(spark):
    rng = random.Random(5)
    make = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    shared, texts = [make(60), make(75), make(120)], []
    for _ in range(40):
        d = make(rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            p = list(rng.choice(shared))
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                p[rng.randrange(len(p))] = f"x{rng.randrange(10**6)}"
            at = rng.randrange(len(d) + 1)
            d = d[:at] + p + d[at:]
        texts.append(" ".join(d))
    texts += [*texts[:4], None, "", "a b c", "la " * 300]
    want = brute_passages(texts, 46, 5, 80)
    df = documents(spark, texts).withColumn("spans", F.lit(1)).withColumn("tokens", F.lit(2))
    got = {r["key"]: r for r in passages.near_passages(df).collect()}
    assert len(got) == len(texts)
    missed = total = 0
    for i, c in enumerate(want):
        own = {p for s in got[i]["spans"] for p in range(s["start"], s["end"])}
        assert own <= c and got[i]["n_words"] == len(words(texts[i])) and bool(own) == bool(got[i]["partners"])
        missed, total = missed + len(c - own), total + len(c)
    assert total > 1000 and missed <= 0.02 * total
    assert passages.near_passages(df.where("false")).count() == 0


def test_similar_windows_by_definition():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x = rng.integers(0, 60, 70).astype(np.uint64)
        y = np.concatenate([rng.integers(0, 60, 10).astype(np.uint64), x[5:50], rng.integers(0, 60, 5).astype(np.uint64)])
        y[rng.integers(0, len(y), 4)] = 99
        want = set()
        for a in range(len(x) - 19):
            s = set(x[a : a + 20].tolist())
            if any(len(s & o) >= 0.8 * len(s | o) for o in (set(y[b : b + 20].tolist()) for b in range(len(y) - 19))):
                want |= set(range(a, a + 20))
        assert {p for a, b in passages.similar_windows(x, y, 20, 80) for p in range(a, b)} == want


def test_all_windows_at_once():
    rng = np.random.default_rng(6)
    for k in range(40):
        x = rng.permutation(4000)[:90].astype(np.uint64)
        y = np.concatenate([rng.permutation(4000)[: rng.integers(0, 30)].astype(np.uint64) + np.uint64(5000), x[rng.integers(0, 20) : 70], rng.permutation(4000)[:30].astype(np.uint64) + np.uint64(9000)])
        y[rng.integers(0, len(y), 3)] = 99_999 + k
        if k % 4 == 0:
            y[3] = y[5]
        shift = None if k % 3 else 7
        assert passages.similar_both(x, y, 20, 80, shift) == (passages.similar_windows(x, y, 20, 80, shift), passages.similar_windows(y, x, 20, 80, None if shift is None else -shift))


def test_compact_windows_hold_every_subsequence_once():
    rng = np.random.default_rng(2)
    order = rng.permutation(60).astype(np.uint64)
    bounds, text = np.array([0, 25, 28, 60]), np.repeat([0, 1, 2], [25, 3, 32])
    packed = (order << np.uint64(6)) | np.arange(60, dtype=np.uint64)
    seen = Counter((a, b) for c, lo, hi in zip(*passages.compact_windows(packed, bounds, text, 4), strict=True) for a in range(lo, c + 1) for b in range(max(c, a + 3), hi + 1))
    assert set(seen.values()) == {1} and set(seen) == {(a, b) for lo, hi in ((0, 25), (28, 60)) for a in range(lo, hi) for b in range(a + 3, hi)}


def test_decontamination_of_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = documents(spark, [f"x {item} y", item.upper(), "one two", None, "", "zero", "x" * 200_000 + " one two"]).withColumn("item_id", F.lit(9)).withColumn("words", F.lit("k"))
    items = spark.createDataFrame([(1, item), (2, "one two"), (3, None), (None, "zero"), (4, ""), (1, item)], "item_id long, text string")
    got = {r["key"]: r for r in contamination.contamination(docs, items).collect()}
    assert (got[0]["n_hit"], got[0]["items"], got[1]["n_hit"], got[2]["n_hit"], got[2]["items"], got[6]["n_hit"]) == (12, [1], 12, 2, [2], 2)
    assert got[3]["n_words"] == got[4]["n_words"] == got[5]["n_hit"] == 0
    assert {r["doc_id"] for r in contamination.decontaminated(docs, items).collect()} == {3, 4, 5}
    assert contamination.contamination(docs.where("false"), items).count() == 0 and contamination.decontaminated(docs, items.where("false")).count() == 7


def test_decontamination_extends_hits(spark):
    """Few words, so that k-grams repeat and fingerprints tie: hits and items by brute force, with the benchmark sent or shuffled."""
    rng = random.Random(21)
    make = lambda n: [rng.choice("abc") for _ in range(n)]
    items = [make(rng.choice([0, 3, 6, 9, 12, 30])) for _ in range(25)]
    texts = []
    for _ in range(60):
        w = make(rng.randrange(0, 25))
        if rng.random() < 0.5:
            source = rng.choice(items)
            at = rng.randrange(len(source) + 1)
            w += source[at : at + rng.randrange(4, 16)] + make(5)
        texts.append(w)
    docs = documents(spark, [" ".join(t) for t in texts])
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    for sent, bits in ((0, 64), (1000, 64), (1000, 2), (1000, 1)):  # two bits and one: most windows have several least hashes
        got = {r["key"]: r for r in contamination.contamination(docs, table, window=8, k=3, sent=sent, hash_bits=bits).collect()}
        for i, w in enumerate(texts):
            hit, names = set(), set()
            for name, item in enumerate(items):
                n = min(8, len(item))
                windows = {tuple(item[j : j + n]) for j in range(len(item) - n + 1)} if n else set()
                for a in range(len(w) - n + 1):
                    if tuple(w[a : a + n]) in windows:
                        hit |= set(range(a, a + n))
                        names.add(name)
            assert (got[i]["n_hit"], got[i]["items"]) == (len(hit), sorted(names)), i


def test_selection_does_not_depend_on_what_is_around(spark):
    """An item at the end of texts that fill chunks of their own; two of its k-grams' hashes agree in many high bits."""
    item = "w9571x w10050x w8783x w5489x w13456x w15666x w9056x w4604x w11089x w428x"
    long = " ".join(f"v{i % 99991}" for i in range(2_200_000))
    docs = documents(spark, [item, f"{long} {item}", f"{item} {long}", long])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["key"]: (r["n_words"], r["n_hit"]) for r in contamination.contamination(docs, items).collect()}
    assert got == {0: (10, 10), 1: (2_200_010, 10), 2: (2_200_010, 10), 3: (2_200_000, 0)}


@pytest.mark.parametrize("w", [1, 2, 3, 5, 8, 69])
def test_window_least_is_the_leftmost(w):
    values = np.random.default_rng(w).integers(0, 4, 200).astype(np.uint64)
    least, place = window_least(values, w)
    assert place.tolist() == [i + values[i : i + w].tolist().index(min(values[i : i + w])) for i in range(201 - w)]
    assert least.tolist() == values[place].tolist()
    assert not len(window_least(values[:1], w + 1)[0])


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_personal_data_by_regular_expressions(spark, rows):
    got = {r["doc_id"]: r for r in entry.queries()["op6_pii"](spark, SF).collect()}
    assert len(got) == len(rows)
    found = 0
    for r in rows:
        want = base_spans(r["text"] or "")
        found += len(want)
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        counts = Counter(k for _, _, k, _ in want)
        assert all(got[r["doc_id"]][f"n_{k}"] == counts[k] for k, _ in BASE)
        assert set(filter(None, listed.split(","))) <= set(got[r["doc_id"]]["spans"].split(","))
    assert found > 20


def test_personal_data_of_odd_texts(spark):
    texts = [None, "", "a@b.c", "naïve é +49 (30) 123456-78 x", "4111 1111 1111 1111 and 4111111111111112", "1.2.3.4 256.1.1.1 01.02.03.004", "IBAN DE89 3704 0044 0532 0130 00", "a" * 300_000 + " x@y.zz", "@" * 1000, "a@b@c.d e@f..g"]
    df = documents(spark, texts).withColumn("spans", F.lit(1))
    got = {r["doc_id"]: r for r in pii.personal_data(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], s["order"], s["kind"], s["end"]) for s in got[i]["spans"] if s["order"] < 4] == base_spans(t or ""), t
    assert [s["kind"] for s in got[6]["spans"]] == ["iban"] or "iban" in [s["kind"] for s in got[6]["spans"]]
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert clean[0] is None and clean[2] == "[EMAIL]" and clean[3] == "naïve é [PHONE] x" and "4111 1111" not in clean[4]
    assert pii.redacted(df.where("false")).count() == 0


def test_clashing_columns_of_urls_and_personal_data(spark):
    texts = spark.createDataFrame([(1, "a@b.co 4111 1111 1111 1111", "mine", 5), (2, None, "x", None)], "doc_id long, text string, email string, Card int")
    got = {r["doc_id"]: r for r in pii.personal_data(texts, threshold=0.5).collect()}
    assert (got[1]["email"], got[1]["Card"], got[2]["email"]) == ("mine", 5, "x") and [s["kind"] for s in got[1]["spans"]] == ["email", "card"]
    assert {r["email"] for r in pii.redacted(texts).collect()} == {"mine", "x"}
    assert pii.personal_data(texts.select("doc_id", F.col("text").alias("email")), "email").columns == ["doc_id", "email", "spans"]
    rules = (("org/", "allow"), ("example.org/es/", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
    urls = ["http://example.org/en/a", "http://example.org/en/a", "http://x.example.org/es/b", "https://shop.com/fr/1", "https://shop.com/de/1", "http://unknown.net/fr/1", None, "http://example.org/en/" + "long/" * 20_000]
    pages = spark.createDataFrame([(i, u, "s", 1, "h", "r", "t", "v") for i, u in enumerate(urls)], "page_id long, path string, score string, other int, host string, rule string, threshold string, verdict string")
    found = url_filter.filter_urls(pages, rules, url="path")
    assert found.columns == ["page_id", "other", "host", "path", "rule", "score", "threshold", "verdict"]
    got = {r["page_id"]: r.asDict() for r in found.collect()}
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 4, 7)] == ["allow", "allow", "block", "allow", "block", "allow"] and got[0] | {"page_id": 1} == got[1]
    assert (got[2]["host"], got[2]["path"], got[2]["rule"], got[6]["host"]) == ("x.example.org", "/es/b", "example.org/es/", "") and got[3]["score"] > got[4]["score"]


def test_urls(spark):
    urls = ["http://a.org/x", "https://Example.ORG/es/page?q", "http://example.org/en/1x", "http://m.com/fr/", "http://com/de/1", None, "nothing", "://h", "http://x.net/p", "http://bücher.net/é\n#f"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    from barloom.llm.queries import URL_RULES

    got = {r["page_id"]: r for r in url_filter.filter_urls(df, URL_RULES).collect()}
    assert len(got) == len(urls)
    assert [(got[i]["host"], got[i]["rule"], got[i]["verdict"]) for i in range(5)] == [("a.org", "org/", "allow"), ("example.org", "example.org/es/", "block"), ("example.org", "example.org/en/1", "block"), ("m.com", "com/fr/", "allow"), ("com", "com/de/", "block")]
    assert got[5]["host"] == got[6]["host"] == got[5]["path"] == "" and got[5]["verdict"] == "block" and got[7]["host"] == "h" and got[9]["path"] == "/é\n"
    assert url_filter.filter_urls(df.where("false"), URL_RULES).count() == 0


def brute_removed(texts, width):
    seen, out = {}, []
    for i, t in enumerate(texts):
        data, gone = (t or "").encode(), set()
        for a in range(len(data) - width + 1):
            s = data[a : a + width]
            if s in seen:
                gone |= set(range(a, a + width))
            else:
                seen[s] = (i, a)
        out.append((data, gone))
    return out


def test_substrings_by_brute_force(spark, rows):
    rng = random.Random(3)
    line = "".join(rng.choice("abcdef é") for _ in range(150))
    texts = [line + "x" * 30 + line, None, "", "z" * 400, line[20:] + "unlike", "short", line, line] + [r["text"] for r in rows if len(r["text"] or "") < 3000][:60]
    df = documents(spark, texts).withColumn("id", F.lit(0)).withColumn("span", F.lit(0))
    got = {r["key"]: r for r in substring_dedup.kept_digests(substring_dedup.without_repeats(df, width=100)).collect()}
    for i, (data, gone) in enumerate(brute_removed(texts, 100)):
        kept = bytes(b for p, b in enumerate(data) if p not in gone)
        assert got[i]["n_bytes"] == len(data) and got[i]["sha256"] == hashlib.sha256(kept).hexdigest(), i
        assert sum(r["end"] - r["start"] for r in got[i]["removed"]) == len(gone)
    assert substring_dedup.without_repeats(df.where("false")).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 64])
def test_substrings_whose_anchors_tie(spark, bits):
    """Few letters and few bits of hash: many places in a string hold its least hash."""
    rng = random.Random(bits)
    make = lambda n: "".join(rng.choice("ab") for _ in range(n))
    shared = [make(40) for _ in range(6)] + ["ab" * 30, "a" * 70]
    texts = [make(rng.randrange(0, 30)) + rng.choice(shared) + make(rng.randrange(0, 20)) + rng.choice(shared) for _ in range(60)]
    got = {r["key"]: r for r in substring_dedup.without_repeats(documents(spark, texts), width=24, gram=5, hash_bits=bits).collect()}
    for i, (data, gone) in enumerate(brute_removed(texts, 24)):
        assert bytes(got[i]["kept"]) == bytes(b for p, b in enumerate(data) if p not in gone), i


def test_substrings_after_a_text_that_fills_a_chunk(spark):
    """A repeat is found whatever stands before it, and however long that is."""
    rng = np.random.default_rng(5)
    repeat = bytes(rng.integers(97, 123, 100, dtype=np.uint8)).decode()
    filler = bytes(rng.integers(97, 123, 17_000_000, dtype=np.uint8)).decode()
    df = documents(spark, [repeat, filler[:1000] + repeat, filler + repeat])
    got = {r["key"]: [tuple(x) for x in r["removed"]] for r in substring_dedup.without_repeats(df).select("key", "removed").collect()}
    assert got[0] == [] and got[1] == [(1000, 1100)] and (17_000_000, 17_000_100) in got[2] and (0, 1000) in got[2]


@pytest.mark.parametrize("kind", ["null", "one", "string"])
def test_substrings_of_odd_ids(spark, kind):
    """3000 texts without ids, with one, or with strings as ids: each row is a document, earlier ones keep what they share."""
    rng = random.Random(11)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(130)) for _ in range(40)]
    rows = []
    for n in range(3000):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 60)))
        rows.append(({"null": None, "one": 7, "string": f"d{n:05d}"}[kind], own + (rng.choice(shared) if n % 5 == 0 else "".join(rng.choice("ijklm") for _ in range(110)))))
    table = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'string' else 'long'}, text string").repartition(5)
    got = substring_dedup.without_repeats(table).collect()
    assert len(got) == 3000
    shared_texts = {s.encode() for s in shared if any(t.endswith(s) for _, t in rows)}
    kept = [bytes(r["kept"]) for r in got]
    assert all(sum(k.count(s) for k in kept) == 1 for s in shared_texts)
    assert sum(len(r["removed"]) for r in got) == 600 - len(shared_texts)
    if kind == "string":
        firsts = {}
        for i, t in sorted(rows):
            firsts.setdefault(t[-130:], i)
        want = {i for i, t in rows if t[-130:] in shared and firsts[t[-130:]] != i}
        assert {r["key"] for r in got if r["removed"]} == want


def test_near_duplicates_in_one_large_family(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(40)] = f"v{rng.randrange(30)}"
        texts.append(" ".join(t))
    texts += [None, "", "a b", "a B", "a  b"]
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set() for w in map(words, texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = documents(spark, texts).withColumn("node", F.lit(1)).withColumn("bucket", F.lit(2))
    got = {r["key"]: r for r in minhash.near_duplicates(df).collect()}
    assert {i: got[i]["component"] for i in range(len(texts))} == {i: find(i) for i in range(len(texts))}
    assert all(got[i]["n_shingles"] == len(sets[i]) for i in range(len(texts)))
    kept = minhash.deduplicated(df)
    assert {r["doc_id"] for r in kept.collect()} == {find(i) for i in range(len(texts))} and kept.columns == df.columns
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(51), 0) | dict.fromkeys((100, 101, 200), 100)


def test_quality_on_held_out_labels(spark):
    rng = random.Random(2)
    good, bad, toxic = ([f"{k}{i}" for i in range(400)] for k in "gbt")
    texts, labels = [], []
    for i in range(1200):
        kind = i % 3
        base = [rng.choice(good if kind != 1 else bad) for _ in range(80)]
        if kind == 2:
            for _ in range(20):
                base[rng.randrange(80)] = rng.choice(toxic[:10])
        texts.append(" ".join(base))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    texts += [None, "", "?!"]
    labels += [(None, 1, 0), (0, None, 1)]
    df = documents(spark, texts)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.resampled(df, table).collect()}
    want = {i for i in range(1200) if i % 3 == 0}
    assert len(want - kept) <= 0.03 * len(want) and len((kept & set(range(1200))) - want) <= 0.05 * 800 and {1200, 1201} <= kept
    assert kept == {r["doc_id"] for r in quality.resampled(df.repartition(7), table).collect()}
    assert quality.resampled(df, table.where("false")).count() == len(texts) and quality.resampled(df.where("false"), table).count() == 0


def test_importance_by_brute_force(spark):
    """Counts, ratios, weights, noise and ranks, one n-gram at a time."""
    rng = random.Random(12)
    vocabulary = {0: [f"p{i}" for i in range(60)], 1: [f"g{i}" for i in range(200)], 2: [f"g{i}" for i in range(150)] + ["scum", "scum!"] * 10}
    texts = [" ".join(rng.choices(vocabulary[i % 3] + vocabulary[1], k=rng.randrange(1, 90))) for i in range(400)] + [None, "", "...", "g1 " * 3000] + ["g1 g2 g3"] * 3
    labels = {i: (int(i % 3 != 0), int(i % 3 == 2)) for i in range(0, 400, 2)}
    df = documents(spark, texts).withColumn("key", F.lit("x")).withColumn("rank", F.lit(0))
    table = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()], "doc_id long, quality int, toxic int")
    buckets = 1 << 12
    got = {r["id"]: r for r in quality.importance(df, table, buckets=buckets).collect()}
    held = {r["doc_id"] for r in table.where(F.pmod(F.xxhash64(F.lit(30), F.col("doc_id")), F.lit(4)) == 0).collect()}
    grams = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        found, _ = quality._features(data, np.array([0, len(data)]), buckets)
        grams.append([f.tolist() for f in found])
    counts = [Counter(), Counter(), Counter()]
    for i, g in enumerate(grams):
        model = 2 if labels.get(i, (0, 0))[1] else labels.get(i, (0, 0))[0]
        for m in {0, model if i in labels and i not in held else 0}:
            counts[m].update(x for kind in g for x in kind)
    total = [[sum(n for x, n in c.items() if x // buckets == k) for k in range(3)] for c in counts]
    ratio = lambda x: math.log((counts[1][x] + 1) / (counts[0][x] * total[1][x // buckets] / total[0][x // buckets] + 1))
    for i, (plain, spaced, pairs) in enumerate(grams):
        own = [ratio(x) for x in spaced + pairs]
        assert got[i]["grams"] == len(own) and abs(got[i]["mean"] - (sum(own) / len(own) if own else 0)) < 1e-4
        assert got[i]["against"] <= 0 and (got[i]["against"] < 0 or not any(x.startswith("scum") for x in (texts[i] or "").split()))
    rows = sorted(got.values(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(texts) + 1)) and all(a["key"] >= b["key"] for a, b in zip(rows, rows[1:], strict=False))
    assert sum(r["kept"] for r in rows) == sum(r["log_weight"] >= 0 for r in rows) and all(r["kept"] == (r["rank"] <= sum(x["kept"] for x in rows)) for r in rows)
    noise = [r["key"] - r["log_weight"] for r in rows]
    assert -3.5 < min(noise) and abs(np.mean(noise) - 0.5772) < 0.2  # standard Gumbel
    assert all(got[i]["kept"] and got[i]["log_weight"] == quality.SAFE for i in (400, 401))
    limits = {round(r["mean"] - r["log_weight"] / r["grams"], 5) for r in rows if r["grams"] and r["log_weight"] < -3 and r["against"] == 0}
    assert len(limits) == 1  # the sum of log ratios less one limit for each n-gram


def test_chats_come_back_whole(spark):
    rng, alphabet = random.Random(1), ["\\", "<|", "|>", "<\\|", "<|end|>", "é", "\n", "### ", "a", ""]
    data = [(c, rng.choice([None, 0, 1, 2, 2]), rng.choice(["user", "assistant", "<|x", None]), rng.choice([None, "".join(rng.choices(alphabet, k=6))]), 1) for c in range(60) for _ in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string, pieces int")
    got = chat.format_conversations(df).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss"))
    for r in got.collect():
        own = sorted((x for x in data if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert chat.format_conversations(df.where("false")).count() == 0


def test_native_queries_run_no_python(spark):
    for name in ("op5_url_filter", "op6_pii", "op10_chat"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
