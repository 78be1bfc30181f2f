"""Compression of vectors to codes: each part of a vector becomes the number of its nearest entry in that part's codebook.

All arithmetic is on integers. Entries are ruled out by lower bounds from coarse to fine: a part is cut into blocks, and the
distance of two parts is at least that of their block means, weighted by block length, plus the square of the difference of
their residuals' norms. Whatever no bound rules out gets its exact distance, so codes are those of a full search.

Codebooks follow Lloyd's rounds: each is one pass over the vectors with the codebook, which has a fixed size, beside every task; tasks add up
their own parts, so that a few sums for each entry are shuffled and fetched.

Cases: vectors that are null, empty or hold null or non-finite components are dropped. So are vectors of another length than the first
kept one's, and a length that doesn't divide into the parts is an error. Components are clipped at plus and minus 2 ** 40 after
scaling; up to there all is exact, and an error beyond the range of a long is given as the largest long. Ties go to the lower entry. Of repeated ids the vector that
sorts first is the first; rows without id come last among the starting entries. Repeated rows each get their row. With fewer vectors than entries the codebook is shorter.
An empty table gives no rows. Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.lineage import forget, stored

LIMIT = 1 << 40
#: Components from which on squared distances don't fit into 64 bits; Python's integers take over there.
WIDE = 1 << 28
MOST = (1 << 63) - 1
BLOCK_ROWS = 4096


def finite(vector: Column) -> Column:
    """Whether all components are there and finite, and there is one."""
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    bound = float(LIMIT)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), x.cast("double") * scale))))


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1)


class Bounds:
    """Lower bounds of squared distances to the entries of one codebook, from block means and residual norms."""

    def __init__(self, entries: np.ndarray):
        width = entries.shape[1]
        self.levels = [n for n in (1, 2, 4, 8, 16) if n < width and width % n == 0]
        self.norm = _squares(entries.astype(float))
        self.means = [self.of(entries, n) for n in self.levels]

    @staticmethod
    def of(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block means times the root of their length, and the norm of what is left."""
        x = x.astype(float)
        length = x.shape[1] // blocks
        means = x.reshape(len(x), blocks, length).sum(axis=2) / np.sqrt(length)
        return means, np.sqrt(np.maximum(0.0, _squares(x) - _squares(means)))

    def below(self, level: int, x: np.ndarray, entry: np.ndarray, means: np.ndarray, rest: np.ndarray, norm: np.ndarray, row: np.ndarray) -> np.ndarray:
        """For pairs of rows of x and entries: a number that no exact distance is below, rounding errors included."""
        m, r = self.means[level]
        bound = _squares(means[row] - m[entry]) + (rest[row] - r[entry]) ** 2
        # the norm of a residual is the root of a difference, good to the root of the squares' rounding error
        size = norm[row] + self.norm[entry]
        return bound - 1e-6 * size - 1.0


def nearest(x: np.ndarray, entries: np.ndarray, counts: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of x, ties to the lower one, and the exact squared distance. ``counts``: gets how many pairs the bounds left."""
    n, k = len(x), len(entries)
    wide = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0))) >= WIDE
    exact = (lambda a, b: _squares((a - b).astype(object))) if wide else (lambda a, b: _squares(a - b))
    bounds = Bounds(entries)
    norm = _squares(x.astype(float))
    least, best = None, None
    row, entry = np.divmod(np.arange(n * k), k)
    for level, blocks in enumerate(bounds.levels):
        means, rest = bounds.of(x, blocks)
        below = bounds.below(level, x, entry, means, rest, norm, row)
        if least is None:
            # the entry that looks nearest is measured first: no other counts whose bound is beyond it
            best = below.reshape(n, k).argmin(axis=1)
            least = exact(x, entries[best])
        keep = below <= least[row].astype(float) * (1 + 1e-12)
        row, entry = row[keep], entry[keep]
    if counts is not None:
        counts |= {"pairs": counts.get("pairs", 0) + n * k, "measured": counts.get("measured", 0) + len(row)}
    distance = exact(x[row], entries[entry])
    # survivors are in order of row and entry, and every row has its nearest among them
    order = np.lexsort((entry, distance, row)) if not wide else np.array(sorted(range(len(row)), key=lambda i: (row[i], distance[i], entry[i])), dtype=np.int64)
    first = order[np.searchsorted(row[order], np.arange(n))] if n else order
    return entry[first], distance[first]


def _vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, width)


def _rounded(sums: list[int], count: int) -> list[int]:
    return [int(s) // count for s in sums]


def train(vectors: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd's rounds. vectors: ``ints``; codebooks: part, entry, position. Only sums for each part and entry come to the driver."""
    parts, entries, width = codebooks.shape
    context = vectors.sparkSession.sparkContext
    names = [f"s{i}" for i in range(width)]
    for _ in range(rounds):
        sent = context.broadcast(codebooks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value  # noqa: B023
            sums, counts = np.zeros(books.shape, dtype=object), np.zeros(books.shape[:2], dtype=np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    x = _vectors(batch.slice(at, BLOCK_ROWS), "ints", parts * width).reshape(-1, parts, width)
                    for p in range(parts):
                        code, _ = nearest(x[:, p], books[p])
                        counts[p] += np.bincount(code, minlength=entries)
                        own = np.zeros((entries, width), dtype=np.int64)  # blocks of 4096 components below 2 ** 40 stay below 2 ** 52
                        np.add.at(own, code, x[:, p])
                        sums[p] += own.astype(object)
            part, entry = np.nonzero(counts)
            if len(part):
                columns = [pa.array([str(v) for v in sums[part, entry, i]]) for i in range(width)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()), *columns], names=["part", "entry", "n", *names])

        found = vectors.select("ints").mapInArrow(run, f"part int, entry int, n long, {', '.join(f'{s} string' for s in names)}")
        total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in names))
        codebooks = codebooks.copy()
        for row in total.collect():
            codebooks[row["part"], row["entry"]] = _rounded([row[s] for s in names], row["n"])
        sent.destroy()
    return codebooks


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """id, label, codes (an entry for each part), error, label_error; and the codebooks, by part and entry.

    ``error``: squared distances to the entries, summed over the parts; ``label_error``: its sum over the label's rows.
    """
    if min(parts, entries) < 1 or rounds < 0:
        raise ValueError("parts and entries are at least 1, rounds at least 0")
    kept = rows.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(finite(F.col("v")))
    start = kept.select("id", integers(F.col("v"), scale).alias("ints")).orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
    length = len(start[0]["ints"]) if start else parts
    if length % parts:
        raise ValueError(f"vectors of {length} components don't divide into {parts} parts")
    width = length // parts
    vectors = stored(kept.where(F.size("v") == length).select("id", "label", integers(F.col("v"), scale).alias("ints")))
    first = np.array([r["ints"] for r in start if len(r["ints"]) == length], dtype=np.int64).reshape(-1, parts, width)
    codebooks = train(vectors, np.ascontiguousarray(first.transpose(1, 0, 2)), rounds) if len(first) else first.reshape(parts, 0, width)
    sent = rows.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                x = _vectors(batch, "ints", parts * width).reshape(-1, parts, width)
                found = [nearest(x[:, p], books[p]) for p in range(parts)]
                error = sum(d.astype(object) for _, d in found)
                codes = np.stack([c for c, _ in found], axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts), pa.int32()), pa.array(codes.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, pa.array([min(int(e), MOST) for e in error], pa.int64())], names=["id", "label", "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    coded = stored(vectors.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long"))
    forget(vectors)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(total.alias("label_error"))
    # adaptive execution splits the join where one label has most rows
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select("id", "label", "codes", "error", "label_error"), codebooks


def hex_code(codes: Column) -> Column:
    """Two hex digits for each entry, in the order of the parts."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for x in codebooks.ravel()).encode()).hexdigest()
