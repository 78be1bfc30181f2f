"""Every stage of the corpus pipeline on its own input, against brute force."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, kind=SPACED):
    return re.findall(kind, (text or "").translate(UPPER))


def duplicates(texts):
    """The least id of each document's group."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in texts.items()}
    holds, root = {}, {i: i for i in texts}
    for i, s in sets.items():
        for g in s:
            holds.setdefault(g, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(k for g in s for k in holds[g] if k < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, stages = docs.columns, {}, dict(pipeline.STAGES)
    assert list(stages) == ["quality", "dedup", "decontamination", "pii", "mixing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        rows = out.collect()
        kept[name] = {r["doc_id"]: r for r in rows}
        if name == "quality":
            labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in before}
            good = {i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
            # some fifteen held-out labels set the limits at this scale; test_quality_on_held_out_labels has more
            assert len(good - set(kept[name])) <= 0.1 * len(good) and set(kept[name]) <= set(before)
        elif name == "dedup":
            assert set(kept[name]) == set(duplicates({i: r["text"] for i, r in before.items()}).values())
        elif name == "decontamination":
            items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := words(r["text"], ALNUM))]
            passages = {tuple(w[j : j + 10]) for w in items for j in range(max(1, len(w) - 9))}
            sizes = {len(p) for p in passages}
            hit = {i for i, r in before.items() if any(tuple(w[j : j + n]) in passages for w in [words(r["text"], ALNUM)] for n in sizes for j in range(len(w) - n + 1))}
            assert set(kept[name]) == set(before) - hit
        elif name == "pii":
            assert set(kept[name]) == set(before)
            for i, r in kept[name].items():
                old = before[i]["text"]
                assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
                assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r["text"] or "")
                if r["text"] != old:  # what is left stands in the old text, in order
                    at = 0
                    for piece in re.split(r"\[(?:EMAIL|IP|CARD|PHONE|IBAN|NID)\]", r["text"]):
                        at = old.index(piece, at) + len(piece)
        else:
            sizes, taken = Counter(), Counter()
            for r in before.values():
                sizes[r["source"]] += len(words(r["text"]))
            for r in rows:
                taken[r["source"]] += len(words(r["text"]))
            assert len(rows) == len(kept[name]) and sum(taken.values()) <= 0.8 * sum(sizes.values())
            assert all(taken[s] <= sizes[s] for s in sizes)
        assert rows, name
        docs, before = spark.createDataFrame(rows, out.schema), kept[name]
    assert sorted(r["doc_id"] for r in pipeline.run(spark, SF).collect()) == sorted(kept["mixing"])
