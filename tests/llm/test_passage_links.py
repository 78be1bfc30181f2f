"""Links between passages: none may be lost to a group's leader, to how rows fall into batches, or to part of a cell being settled."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from test_text_queries import documents, words

from barloom.llm import passages


def brute_components(texts, t, k, percent):
    toks = [[tuple(w[i : i + k]) for i in range(len(w) - k + 1)] for w in map(words, texts)]
    wins = [{frozenset(x[a : a + t]) for a in range(len(x) - t + 1)} for x in toks]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] and texts[j] and any(100 * len(x & y) >= percent * len(x | y) for x in wins[i] for y in wins[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if c == high else c for c in label]
    return label


def test_links_by_brute_force(spark):
    """Families that drift word by word: their ends aren't similar, so each link between neighbours matters."""
    rng = random.Random(8)
    make = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = []
    for family in range(4):
        p = make(58)
        for step in range(7):
            texts.append(" ".join(make(rng.randrange(5, 20)) + p + make(rng.randrange(5, 20))))
            p = list(p)
            p[(step * 17 + family) % len(p)] = f"x{rng.randrange(10**6)}"
    rng.shuffle(texts)
    texts += [texts[0], None, " ".join(make(60))]
    want = brute_components(texts, 46, 5, 80)
    for parts in (1, 7):
        got = {r["key"]: r for r in passages.near_passages(documents(spark, texts).repartition(parts)).collect()}
        assert [got[i]["component"] for i in range(len(texts))] == want
        assert [got[i]["members"] for i in range(len(texts))] == [want.count(c) for c in want]


def told(cells, cuts, held):
    """What the pairer says of cells (key, content, doc, low) that come in batches of these sizes."""
    batches, at = [], 0
    for n in cuts:
        key, content, doc, low = (np.array([c[i] for c in cells[at : at + n]], np.int64) for i in range(4))
        batches.append(pa.RecordBatch.from_arrays([pa.array(x) for x in (key, content, doc, passages.pack(low, low + 60))], names=["key", "content", "doc", "span"]))
        at += n
    return [r for b in passages._pairer(46, iter(batches), held) for r in b.to_pylist()]


def test_members_do_not_depend_on_batches():
    """Three contents of one key, in whatever batches, are three members of its group; equal ones elsewhere are covered; the commonest leads."""
    cells = [(5, 1, 10, 3), (5, 2, 11, 3), (5, 3, 12, 3), (5, 3, 13, 3), (6, 1, 10, 3)]
    for cuts in ([5], [1, 4], [2, 3], [3, 2], [1, 1, 1, 1, 1]):
        rows = told(cells, cuts, 1 << 18)
        assert {(r["group"], r["doc"]) for r in rows if r["group"]} == {(5, 10), (5, 11), (5, 12)}
        assert {(r["doc"], r["pdoc"]) for r in rows if not r["group"] and r["pspan"] is None} == {(13, 12), (12, 13)}
        assert {(r["doc"], r["pdoc"]) for r in rows if r["pspan"] is not None} == {(10, 12), (11, 12)}


def test_a_large_group_keeps_every_member():
    """Of a group that is larger than what is held, each content still meets a leader, and all are members."""
    cells = [(5, c, 100 + c, 3) for c in range(40)] + [(5, 40, 200 + d, 3) for d in range(9)] + [(6, 1, 300, 3), (6, 1, 301, 3)]
    rows = told(cells, [4] * 12 + [3], 6)
    assert {r["doc"] for r in rows if r["group"] == 5} >= {*range(100, 140), 200}
    paired = {d for r in rows if r["pspan"] is not None for d in (r["doc"], r["pdoc"])}
    assert paired >= {*range(100, 140), 200}
    assert {r["doc"] for r in rows if not r["group"] and r["pspan"] is None} == {*range(200, 209), 300, 301}


def test_similar_windows_have_a_rare_token_in_common():
    """Prefixes of any two similar windows meet, also of windows of few distinct tokens; equal sets of tokens, and only those, are named alike."""
    rng = np.random.default_rng(9)
    t, base = 12, np.arange(40)
    docs = []
    for d in range(30):
        x = base.copy()
        x[rng.integers(0, 40, rng.integers(0, 4))] = 100 * d + np.arange(1000, 1000 + 40)[:1] + rng.integers(0, 3)
        if d % 3 == 0:
            x[20:32] = x[20]
        docs.append(x.astype(np.uint64))
    tokens, counts = np.unique(np.concatenate([np.unique(x) for x in docs]), return_counts=True)
    windows, held, named = [], {}, {}
    for d, x in enumerate(docs):
        elsewhere = np.unique(np.concatenate([y for e, y in enumerate(docs) if e != d]))
        n, u = passages._distinct_counts(x, t), passages.unshared(x, t, elsewhere)
        values = np.unique(x)
        starts = np.arange(len(n))
        token, first, last, _ = passages.prefixes(x, starts, starts % 2, counts[np.searchsorted(tokens, values)], values, t, 80)
        sums = passages._window_sums(passages.mix64(x), t, passages._close_repeats(x, t))
        for a in range(len(x) - t + 1):
            own = set(x[a : a + t].tolist())
            outside = set(elsewhere.tolist()) | set(x[:a].tolist()) | set(x[a + t :].tolist())
            assert (n[a], u[a]) == (len(own), len(own - outside))
            windows.append((d, a, own))
            held[d, a] = set(token[(first <= a) & (a <= last)].tolist())
            assert named.setdefault(int(sums[a]), own) == own
    assert len(named) == len({frozenset(w[2]) for w in windows})
    pairs = [(w, v) for w in windows[::7] for v in windows[::5] if w[0] != v[0] and 5 * len(w[2] & v[2]) >= 4 * len(w[2] | v[2])]
    assert len(pairs) > 50
    assert all(held[w[:2]] & held[v[:2]] for w, v in pairs)


def test_ids_may_be_null_repeat_or_be_strings(spark):
    rng = random.Random(3)
    shared = " ".join(f"w{rng.randrange(4000)}" for _ in range(60))
    ids = ["b", None, "a", "a", None, "c"]
    table = spark.createDataFrame([(i, shared if n < 4 else " ".join(f"v{rng.randrange(4000)}" for _ in range(60))) for n, i in enumerate(ids)], "doc_id string, text string")
    got = sorted((r["key"] or "", r["component"] or "", r["members"], len(r["spans"])) for r in passages.near_passages(table).collect())
    assert got == sorted([("b", "a", 4, 1), ("", "a", 4, 1), ("a", "a", 4, 1), ("a", "a", 4, 1), ("", "", 1, 0), ("c", "c", 1, 0)])


def test_sketches_never_rule_out_similar_windows():
    """What two runs' sketches say they lack of each other is never more than any two of their windows do; a range's bits are its tokens' bits."""
    rng = np.random.default_rng(11)
    t, bits = 12, lambda a: [int(v).bit_count() for v in a]
    x = rng.integers(0, 30, 400).astype(np.uint64)
    first = rng.integers(0, 300, 200)
    last = first + rng.integers(0, 20, 200)
    every, some = passages.sketches(x, last, np.maximum(last, first + t)), passages.sketches(x, first, last + t)
    single = {int(v): passages.sketches(np.array([v]), np.array([0]), np.array([1]))[0] for v in np.unique(x)}
    for i in range(0, 200, 3):
        for held, a, b in ((every, last[i], first[i] + t), (some, first[i], last[i] + t)):
            assert held[i].tolist() == np.bitwise_or.reduce([single[int(v)] for v in x[a:b]] or [np.zeros(2, np.uint64)]).tolist()
        for j in range(1, 200, 7):
            told = sum(bits(every[i] & ~some[j]) + bits(every[j] & ~some[i]))
            for a in range(first[i], last[i] + 1, 4):
                for b in range(first[j], last[j] + 1, 4):
                    assert told <= len(set(x[a : a + t].tolist()) ^ set(x[b : b + t].tolist()))


def test_a_common_rare_token_does_not_pair_all_its_windows(spark):
    """Variants of one text, each with a word of every eight replaced: they have tokens in common, but no two are similar, and few pairs are compared."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(f"x{rng.randrange(10**9)}" if (i + d) % 8 == 0 else w for i, w in enumerate(base)) for d in range(60)]
    rows = []
    for d, text in enumerate(texts):
        w = words(text)
        grams = np.array([hash(tuple(w[i : i + 5])) & (2**64 - 1) for i in range(56)], np.uint64)
        rows.append((d, *passages.sketches(grams, np.array([10]), np.array([46])).view(np.int64)[0].tolist(), *passages.sketches(grams, np.array([0]), np.array([56])).view(np.int64)[0].tolist()))
    a = spark.createDataFrame(rows, "doc long, all0 long, all1 long, any0 long, any1 long")
    b = a.select(*(a[c].alias(f"p{c}") for c in a.columns))
    near = a.join(b, a.doc % 8 != b.pdoc % 8).where(passages.apart_at_least("", "p") <= 10).count()
    assert near <= 0.05 * 60 * 60
    got = passages.near_passages(documents(spark, texts)).collect()
    assert [r["members"] for r in got] == [brute_components(texts, 46, 5, 80).count(c) for c in brute_components(texts, 46, 5, 80)]


def told_stretches(rows, cuts):
    batches, at = [], 0
    for n in cuts:
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[at : at + n]], pa.int64()) for c in range(4)], names=["doc", "low", "high", "partner"]))
        at += n
    return [tuple(r.values()) for b in passages._stretches(iter(batches)) for r in b.to_pylist()]


def test_stretches_do_not_depend_on_batches():
    """Ranges that touch are one row, with the least partner of each range, however they come."""
    rows = sorted([(1, 0, 46, 9), (1, 0, 46, 5), (1, 3, 49, 7), (1, 49, 95, 5), (1, 200, 246, 2), (2, 0, 46, 1), (3, 5, 60, 1), (3, 10, 20, 4)])
    want = [(1, 0, 95, [5, 7]), (1, 200, 246, [2]), (2, 0, 46, [1]), (3, 5, 60, [1, 4])]
    for cuts in ([8], [1] * 8, [0, 3, 5], [5, 1, 2]):
        assert told_stretches(rows, cuts) == want
