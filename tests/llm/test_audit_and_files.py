"""Filter audit, token files and vector codes: against SQL, plain loops and round trips, and on odd input."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from barloom.llm import filter_audit, token_files, vector_codes
from barloom.llm.elias_fano import EliasFano

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_vector_codes"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_token_files_query_agrees_with_the_tokenizer(spark):
    tokenizer, start, want = Tokenizer.from_file(BPE), 0, []
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, entry.queries()["op12_token_files"](spark, SF).collect())) == want


# --- filter audit ---


def plain_audit(docs, labels, names, fails, first):
    """fails: of a text, the names of the filters it fails; first: the name of the filter for repeated texts, or None."""
    least = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            least[t or ""].append(i)
    rows = []
    for i, t, p in docs:
        own = set(fails(t or ""))
        if first and i is not None and min(least[t or ""]) < i:
            own.add(first)
        got = [x for x in labels if i is not None and x[0] == i]
        rows.append((p or "", own, any(q == 1 for _, q, _ in got), any(x == 1 for _, _, x in got)))
    out = {}
    for part in {p for p, *_ in rows}:
        mine, shapley = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations(names)):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_the_loop_on_odd_rows(spark):
    docs = [
        (1, "a b c", "en"), (2, "a b c", "en"), (2, "a b c", "de"), (2, "a b c", "en"), (None, "a b c", "en"), (3, None, None), (4, "", "en"), (5, "ABC $", ""), (6, "x " * 3000, "en"), (7, "x " * 3000, "fr"),
        (8, " Ä\U0001f600 Q", "en"), (9, "a\tb\r\nc d", "fr"), (10, "A%", "de"), (1, "A%", "en"), (None, None, "en"), (0, "A%", "en"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (10, 0, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"mask": F.lit("x"), "part": F.lit(1), "n": F.lit(2), "words": F.lit(0)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"mask": F.lit("x"), "part": F.lit(1), "text": F.lit("x")})
    words, text = F.col("words"), F.col("text")
    filters = {"S": F.size(words) < 3, "U": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 3, "D": text.rlike("[$%]"), "N": F.lit(None).cast("boolean")}
    got = filter_audit.audit(df, marks, filters, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, repeats="R").collect()

    def fails(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return [n for n, bad in (("S", len(w) < 3), ("U", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", re.search("[$%]", t))) if bad]

    want = plain_audit(docs, labels, "SUDNR", fails, "R")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want
    for p in {k[0] for k in want}:  # every order removes the same documents in the end, and shares add up to all orders
        last = {want[k][0] for k in want if k[0] == p and k[2] == 5}
        assert len(last) == 1
        total = sum(1 for d in docs if (d[2] or "") == p)
        assert sum({k[1][k[2] - 1]: v[-1] for k, v in want.items() if k[0] == p}.values()) == 120 * (total - last.pop())
    assert filter_audit.audit(df.where("false"), marks, filters, {"good": F.col("quality") == 1}).count() == 0
    one = filter_audit.audit(df, marks.where("false"), {"S": F.size(words) < 3}, {"good": F.col("quality") == 1}).where("part = 'fr'").collect()
    assert [tuple(r) for r in one] == [("fr", "S", 1, 2, 0, 0, 0, 0, 0)]
    with pytest.raises(ValueError):
        filter_audit.audit(df, marks, {}, {})
    with pytest.raises(ValueError):
        filter_audit.audit(df, marks, {"R": F.lit(True)}, {}, repeats="R")


# --- token files ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=700), st.sampled_from([1, 1 << 20, 1 << 63]))
def test_elias_fano_round_trip(values, squeeze):
    values = sorted(v // squeeze if squeeze > 1 else v for v in values)
    kept = EliasFano.from_bytes(EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes())
    assert kept.values().tolist() == values
    assert [kept.select(i) for i in range(len(values))] == values
    for i in (-1, len(values)):
        with pytest.raises(IndexError):
            kept.select(i)


def test_elias_fano_is_small_and_refuses_falling_values():
    ends = np.cumsum(np.random.default_rng(4).integers(1, 2000, 100_000)).astype(np.uint64)
    size = len(EliasFano.of(ends).to_bytes())
    assert size * 8 / len(ends) < 2.2 + np.log2(float(ends[-1]) / len(ends))  # two bits a value over the logarithm of the gap
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1], dtype=np.uint64))


ODD = ["", " ", "  ", "a", " a", "a ", "a b", "a  b", "a b", "a  b", "a  b", "a　 b", "a 　b", "a  b", "a  b", "a\u0085 b", "don't 've 's it 's", "x\n y", "x \ny", "é é", "中 文 中", "1 2 !! ?? a1 1a", "\U0001f600 \U0001f600 x", "<|endoftext|> a<|endoftext|> b", "a\x00 b", "\t\t \t x", "a" * 5000, "w9571x w10050x " * 50]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1'.,s !\n\t 　 \u0085é中\U0001f600<|>")), max_size=30), max_size=6))
def test_encoding_in_pieces_is_encoding_whole(texts):
    check_pieces(texts)


ENCODERS = []


def check_pieces(texts):
    if not ENCODERS:
        ENCODERS.extend([token_files.Encoder(open(BPE, encoding="utf-8").read()), Tokenizer.from_file(BPE)])
    pieced, whole = ENCODERS
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = [[] for _ in texts]
    for ids, n in pieced.blocks(np.frombuffer(b"".join(data), dtype=np.uint8), offsets):
        at = 0
        for i, k in enumerate(n.tolist()):
            got[i] += ids[at : at + k].tolist()
            at += k
        assert at == len(ids)
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoding_in_pieces_of_odd_texts(monkeypatch):
    check_pieces(ODD)
    assert ENCODERS[0].cuts
    monkeypatch.setattr(token_files, "BLOCK_PIECES", 3)  # a text lies in many blocks
    monkeypatch.setattr(token_files, "CACHED_PIECES", 5)
    check_pieces(ODD)
    check_pieces(["a b c d e f g h", "", "i j"])
    assert not token_files.cuts_in_pieces({"pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "BPE"}})
    assert not token_files.cuts_in_pieces({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}, "model": {"type": "BPE"}})


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_files_of_odd_documents(spark, name):
    path = public_tokenizers.path(name)
    docs = [(i - 5, t) for i, t in enumerate(ODD)] + [(None, "null id"), (None, None), (3, "again"), (3, "again"), (3, "other"), (2**62, None), (-(2**62), "far apart"), (7000, "long one " * 60_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit("x"), "path": F.lit(0), "task": F.lit("y")})
    manifest, folder = token_files.write(df, path, end_id=2, file_ids=300)
    files = manifest.orderBy("task", "seq").collect()
    assert len(files) > 3 and sum(f["n_docs"] for f in files) == len(docs)
    tokenizer, seen, start = Tokenizer.from_file(path), [], 0
    encode = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    rows = {}
    for f in files:
        file = token_files.TokenFile(folder, f["path"])
        for i, (key, at, ids) in enumerate(file.documents()):
            assert key == file.key(i) and at == file.offset(i) and file.document(i).tolist() == ids.tolist()
            seen.append((key, tuple(ids.tolist())))
            rows[start + at] = (key, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += f["n_ids"]
    keys = [k for k, _ in seen]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:])
    assert Counter(seen) == Counter((k, tuple(encode(t))) for k, t in docs)
    assert sorted(tuple(r) for r in token_files.read(manifest, folder).where("doc_id is not null").collect()) == sorted(r for r in rows.values() if r[0] is not None)
    token_files.delete(spark, folder)
    empty, folder = token_files.write(df.where("false"), path, end_id=2)
    assert empty.count() == 0 and token_files.read(empty, folder).count() == 0
    with pytest.raises(ValueError):
        token_files.write(df.select(F.col("text").alias("doc_id"), "text"), path, end_id=2)


# --- vector codes ---


def plain_codes(rows, parts, entries, rounds, scale, limit=1 << 40):
    """rows: kept (id, vector, label) in any order."""
    ints = [(i, [int(np.floor(max(-limit, min(limit, float(x) * scale)))) for x in v], lab) for i, v, lab in rows]
    width = len(ints[0][1]) // parts
    first = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(r[1], p)) for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        found = [[best(v, p)[1] for p in range(parts)] for _, v, _ in ints]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(ints, found, strict=True) if f[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    coded = [[best(v, p) for p in range(parts)] for _, v, _ in ints]
    error = [sum(d for d, _ in c) for c in coded]
    label = defaultdict(int)
    for (_, _, lab), e in zip(ints, error, strict=True):
        label[lab] += e
    most = (1 << 63) - 1
    return sorted(((i, tuple(e for _, e in c), min(err, most), min(label[lab], most)) for (i, _, lab), c, err in zip(ints, coded, error, strict=True)), key=str), books


def found_codes(df, **options):
    coded, books = vector_codes.compress(df, **options)
    return sorted(((r["id"], tuple(r["codes"]), r["error"], r["label_error"]) for r in coded.collect()), key=str), books.tolist()


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    kept = [(i, rng.normal(size=8).tolist(), i % 3 if i % 4 else None) for i in range(-3, 60)]
    kept += [(100 + i, [0.25] * 8, 7) for i in range(40)] + [(4, rng.normal(size=8).tolist(), 1), (4, kept[0][1], 1), (None, [9.0] * 8, None), (200, [0.0] * 8, 0), (201, [-1e-9] * 8, 0)]
    dropped = [(300, None, 1), (301, [], 1), (302, [None] + [1.0] * 7, 1), (303, [nan] + [1.0] * 7, 1), (304, [inf] * 8, 1), (305, [1.0] * 16, 1), (None, None, None)]
    df = spark.createDataFrame(kept + dropped, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit("x"), "ints": F.lit(1), "error": F.lit(2), "codes": F.lit(3), "__label": F.lit(4)})
    for parts, entries in ((2, 5), (8, 3), (1, 16)):
        assert found_codes(df, parts=parts, entries=entries, rounds=3) == plain_codes(kept, parts, entries, 3, 4096)
    few = [r for r in kept if r[0] in (4, 5, 6)]
    assert found_codes(df.where("vec_id in (4, 5, 6)"), parts=4, entries=16, rounds=2) == plain_codes(few, 4, 16, 2, 4096)
    assert found_codes(df.where("false")) == ([], [[]] * 8)
    with pytest.raises(ValueError):
        vector_codes.compress(df, parts=3)


def test_codes_of_huge_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    huge = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 14)).tolist(), i % 2) for i in range(80)] + [(90, [3e300, -3e300, 1.0, 0.0], 0)]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>, label int")
    assert found_codes(df, parts=2, entries=6, rounds=2, scale=4096) == plain_codes(huge, 2, 6, 2, 4096)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 20), st.sampled_from([1, 2, 3, 4, 6, 8, 12, 16]), st.sampled_from([1, 3, 100, 10**6, 10**8]))
def test_bounds_never_lose_the_nearest(seed, k, width, spread):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-spread, spread + 1, (k, width))
    x = np.concatenate([rng.integers(-spread, spread + 1, (30, width)), entries, (entries + rng.integers(-1, 2, entries.shape))])
    code, distance = vector_codes.nearest(x, entries)
    want = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    assert code.tolist() == [min(range(k), key=lambda e: (row[e], e)) for row in want] and distance.tolist() == [min(row) for row in want]


def test_bounds_rule_out_most_entries():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(16, 8)) * 4096
    x = np.floor(centres[rng.integers(0, 16, 5000)] + rng.normal(size=(5000, 8)) * 400).astype(np.int64)
    counts = {}
    vector_codes.nearest(x, np.floor(centres).astype(np.int64), counts)
    assert counts["measured"] < 0.2 * counts["pairs"]


def test_digest_of_codebooks():
    assert vector_codes.digest(np.array([[[1, -2], [3, 4]]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()
