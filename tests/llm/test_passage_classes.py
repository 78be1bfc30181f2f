"""What stands for others in the search of passages, and what is ruled out before it, loses nothing."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from test_passage_links import brute_components
from test_text_queries import brute_passages, documents, words

from barloom.llm import passages


def test_pieces_hold_every_window_that_has_a_similar_one():
    rng = np.random.default_rng(21)
    t, base = 12, np.arange(30)
    docs = []
    for d in range(25):
        x = np.concatenate([1000 + 100 * d + np.arange(15), base, 5000 + 100 * d + np.arange(15)])
        x[15 + rng.integers(0, 30, rng.integers(0, 4))] = 9000 + d
        docs.append(x.astype(np.uint64))
    tokens, bounds = np.concatenate(docs), np.cumsum([0, *map(len, docs)])
    times = Counter(tokens.tolist())
    first, end = passages.live_pieces(tokens, bounds, np.array([times[v] > 1 for v in tokens.tolist()]), t, 80)
    windows = [(d, a, frozenset(x[a : a + t].tolist())) for d, x in enumerate(docs) for a in range(len(x) - t + 1)]
    similar = [w for w in windows if any((v[0] != w[0] or abs(v[1] - w[1]) >= t) and 5 * len(w[2] & v[2]) >= 4 * len(w[2] | v[2]) for v in windows)]
    assert len(similar) > 100 and (end - first).sum() < 0.7 * len(tokens)
    assert all(((first <= bounds[d] + a) & (end >= bounds[d] + a + t)).any() for d, a, _ in similar)


def test_windows_of_one_name_are_similar_and_stand_for_each_other():
    """Near copies with one word replaced at the same place have one name each; windows of one name differ only in tokens nobody else has."""
    t, base = 46, np.arange(60)
    docs = [np.where((base >= 20) & (base < 25), 1000 * (d + 1) + base, base).astype(np.uint64) for d in range(40)]
    named = {}
    for x in docs:
        n = passages._window_counts(len(x), t, passages._close_repeats(x, t))
        one, two = passages.window_names(x, n, base.astype(np.uint64), passages._close_repeats(x, t), t, 80)
        for a in range(len(n)):
            named.setdefault((int(one[a]), int(two[a])), []).append(frozenset(x[a : a + t].tolist()))
    assert len(named) == len(docs[0]) - t + 1
    for sets in named.values():
        assert len({frozenset(v for v in s if v < 1000) for s in sets}) == 1
        assert all(5 * len(sets[0] & s) >= 4 * len(sets[0] | s) for s in sets)


def test_windows_that_none_can_resemble_are_left_out():
    """Of 46 tokens six that stand nowhere else are too many, unless a token stands in a window of fewer different ones."""
    x = np.arange(46, dtype=np.uint64)
    for u, least, want in ((5, 46, True), (6, 46, False), (6, 44, True), (9, 38, False), (9, 37, True), (10, 10, False)):
        shared = pa.StructArray.from_arrays([pa.array(range(u, 46), pa.int64()), pa.array([2] * (46 - u)), pa.array([least] + [46] * (45 - u), pa.int64())], names=["token", "docs", "least"])
        assert passages.may_resemble(x, np.array([46]), np.array([u]), shared, 46, 80).tolist() == [want], (u, least)


def test_classes_by_brute_force(spark):
    """Copies in other surroundings, twice in one text, with a word replaced at one place, and a bridge between two families."""
    rng = random.Random(31)
    make = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    p, q = make(58), make(58)
    texts = [" ".join(make(rng.randrange(5, 40)) + p + make(rng.randrange(5, 40))) for _ in range(5)]
    texts += [" ".join(make(9) + p[:25] + [f"x{i}"] + p[26:] + make(9)) for i in range(5)]
    texts += [" ".join(make(9) + q + make(30) + q), " ".join(q), " ".join(make(20) + q), " ".join(make(60) + p[:52] + make(4) + q[3:])]
    texts += [" ".join(make(80)), *[" ".join(make(70))] * 3, None, " ".join(p[:30] + make(40))]
    got = {r["key"]: r for r in passages.near_passages(documents(spark, texts)).collect()}
    want = brute_components(texts, 46, 5, 80)
    covered = brute_passages(texts, 46, 5, 80)
    # a text that repeats a passage is linked to itself alone by that
    assert [got[i]["component"] for i in range(len(texts))] == want
    assert [got[i]["members"] for i in range(len(texts))] == [want.count(c) for c in want]
    for i, text in enumerate(texts):
        own = {w for s in got[i]["spans"] for w in range(s["start"], s["end"])}
        assert own == covered[i] and got[i]["n_words"] == len(words(text)) and bool(own) == bool(got[i]["partners"]), i
