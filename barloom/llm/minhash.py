"""Near-duplicate documents by circulant MinHash.

Two permutations make all coordinates of a signature: the first places every shingle hash on a ring of 2**32, the
second, shifted round the ring by one more step for each coordinate, orders the places; a coordinate is
the least. Bands of coordinates give candidates. Documents with equal shingle sets are one class from the start, so
only classes are compared, first each with one leader of its band bucket. What stays unconnected inside a
bucket is then compared in blocks, each class with each of another component, so no link inside a bucket is
lost. Every link is confirmed on the full shingle sets.

At a similarity of 0.8 a pair shares none of the 38 bands of 5 coordinates with a probability of 3e-7, and
fails the estimate from 192 one-bit coordinates with one of about 1e-8.

Cases: null texts and texts without words have the empty set and link with nothing; fewer words than a
shingle are one shingle; repeated rows form one class; a null id is the largest of its class and component;
empty tables give no rows. Very long texts are read whole. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.bitmap import bitmap_parts, in_bitmap
from barloom.llm.components import connected_components
from barloom.llm.lineage import checkpointed, forget, stored
from barloom.llm.tokens import SPACED, U, Words, chunks, cut_words, mix64

COORDINATES, BANDS, ROWS = 192, 38, 5
#: Differing bits of 192 that a candidate may have: 19 are expected at a similarity of 0.8.
MOST_BITS = 45
#: Members of a block in which sketches, or texts, are compared each with each.
BLOCK, TEXT_BLOCK = 512, 128
U32 = np.uint32


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each, and where each text's begin."""
    hashes = words.hashes()
    grams, at = words.grams(k, hashes)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    bounds = np.searchsorted(words.text[at], np.arange(len(counts) + 1))
    sets = [np.unique(grams[bounds[i] : bounds[i + 1]]) for i in range(len(counts))]
    for i in short.tolist():
        own = hashes[words.first[i] : words.first[i + 1]]
        acc = np.array([len(own)], dtype=U)
        for j in range(len(own)):
            acc = mix64(acc * U(3) + own[j : j + 1])
        sets[i] = acc
    starts = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=starts[1:])
    return np.concatenate(sets) if sets else np.zeros(0, dtype=U), starts


def circulant_signatures(shingles: np.ndarray, starts: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """One row of coordinates for each non-empty set."""
    starts = starts[:-1][np.diff(starts) > 0]
    place = (mix64(shingles ^ U(0x5851F42D4C957F2D)) >> U(32)).astype(U32)
    out = np.empty((len(starts), coordinates), dtype=U32)
    if not len(starts):
        return out
    ring, high = np.empty_like(place), np.empty_like(place)
    for j in range(coordinates):
        np.add(place, U32(j * 0x9E3779B1 & 0xFFFFFFFF), out=ring)  # the shift, then a bijection of the ring
        ring *= U32(0x85EBCA6B)
        np.right_shift(ring, U32(15), out=high)
        ring ^= high
        ring *= U32(0xC2B2AE35)
        np.right_shift(ring, U32(16), out=high)
        ring ^= high
        out[:, j] = np.minimum.reduceat(ring, starts)
    return out


def _band_hashes(signatures: np.ndarray) -> np.ndarray:
    acc = np.zeros((len(signatures), BANDS), dtype=U)
    cut = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS).astype(U)
    for j in range(ROWS):
        acc = mix64(acc * U(31) + cut[:, :, j] + U(1))
    return mix64(acc ^ (np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15))[None, :])


def _signer(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "text"):
            shingles, starts = shingle_sets(cut_words(data, offsets, SPACED), k)
            sizes = np.diff(starts)
            full = sizes > 0
            signed = circulant_signatures(shingles, starts)
            bits = np.packbits((signed & 1).astype(bool), axis=1, bitorder="little").view(np.int64).reshape(len(signed), 3)
            sums = [np.add.reduceat(mix64(shingles ^ U(seed)), starts[:-1][full]).view(np.int64) if full.any() else np.zeros(0, np.int64) for seed in (1, 2)]
            wide = lambda x: pa.array(np.where(full, np.pad(x, (0, 1))[np.minimum(np.cumsum(full) - 1, len(x))], 0), pa.int64())
            ends = np.zeros(len(full) + 1, dtype=np.int32)
            np.cumsum(full * BANDS, out=ends[1:])
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(_band_hashes(signed).view(np.int64).ravel()))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), *(wide(s) for s in sums), *(wide(bits[:, i]) for i in range(3)), bands]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_shingles", "set1", "set2", "bits1", "bits2", "bits3", "bands"])

    return run


def _verifier(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (a, b, text): the pairs whose full sets are similar. text: both texts, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keep = np.zeros(batch.num_rows, dtype=bool)
            done = 0
            left = chunks(iter([batch.select([2])]), batch.schema.names[2])
            right = chunks(iter([batch.select([3])]), batch.schema.names[3])
            rights: list[np.ndarray] = []
            lefts: list[np.ndarray] = []
            for side, sets in ((left, lefts), (right, rights)):
                for _, data, offsets in side:
                    shingles, starts = shingle_sets(cut_words(data, offsets, SPACED), k)
                    sets += np.split(shingles, starts[1:-1])
            for x, y in zip(lefts, rights, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[done] = 100 * both >= percent * (len(x) + len(y) - both) and len(x) > 0
                done += 1
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])

    return run


def in_blocks(members: DataFrame, group: str, size: int, columns: list[str]) -> DataFrame:
    """rows (array of block, node and ``columns``): each two members of a group (node, members: the group's size) meet in one row, which has those of two blocks at most."""
    members = members.withColumn("blocks", F.ceil(F.col("members") / size).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return members.groupBy(group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(F.collect_list(F.struct("block", "node", *columns)).alias("rows")).select("rows")


def _roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: the least number of each one's component."""
    labels = np.arange(len(linked))
    while True:
        low = np.minimum(labels, np.where(linked, labels[None, :], len(labels)).min(axis=1, initial=len(labels)))
        low = low[low]
        if (low == labels).all():
            return labels
        labels = low


def _stars(groups: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """For nodes and the matrix of their links: one edge to the component's least node for each other node."""
    for nodes, linked in groups:
        root = nodes[_roots(linked)]
        if (root != nodes).any():
            yield pa.RecordBatch.from_arrays([pa.array(nodes[root != nodes]), pa.array(root[root != nodes])], names=["a", "b"])


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The members of each block pair as a struct array, sorted by node."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows = batch.column(0)[i].values
            yield rows.take(pa.array(np.argsort(rows.field("node").to_numpy(), kind="stable")))


def _cross(rows: pa.Array) -> np.ndarray:
    """Which two members belong to different components."""
    component = rows.field("component").to_numpy()
    return component[:, None] != component[None, :]


def _close_roots(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows in _sorted_rows(batches):
            sketch = rows.field("sketch")
            n = sketch.field("n").to_numpy()
            differ = np.zeros((len(n), len(n)), dtype=np.uint16)
            for c in ("bits1", "bits2", "bits3"):
                bits = sketch.field(c).to_numpy().view(U)
                differ += np.bitwise_count(bits[:, None] ^ bits[None, :])
            sized = n[:, None] * 100 >= n[None, :] * percent
            yield rows.field("node").to_numpy(), _cross(rows) & sized & sized.T & (differ <= MOST_BITS)

    return lambda batches: _stars(groups(batches))


def shared_counts(sets: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """How many elements each two sets share."""
    every, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = times[inverse] > 1
    place = (np.cumsum(times > 1) - 1)[inverse[several]]
    owner = owner[several]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.diag(np.array([len(s) for s in sets], dtype=np.float64))
    total = int(place[-1]) + 1 if len(place) else 0
    for at in range(0, total, columns):
        low, high = np.searchsorted(place, [at, at + columns])
        part = np.zeros((len(sets), min(columns, total - at)), dtype=np.float32)
        part[owner[low:high], place[low:high] - at] = 1
        got = part @ part.T
        np.fill_diagonal(got, 0)
        out += got
    return out


def _linked_roots(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows in _sorted_rows(batches):
            sets: list[np.ndarray] = []
            for _, data, offsets in chunks(iter([pa.RecordBatch.from_arrays([rows.field("text")], names=["text"])]), "text"):
                shingles, starts = shingle_sets(cut_words(data, offsets, SPACED), k)
                sets += np.split(shingles, starts[1:-1])
            both = shared_counts(sets)
            n = np.diag(both)
            yield rows.field("node").to_numpy(), _cross(rows) & (100 * both >= percent * (n[:, None] + n[None, :] - both))

    return lambda batches: _stars(groups(batches))


def _close(percent: int) -> Column:
    """Whether the sketches x and y (n, bits1, bits2, bits3) of two sets allow a similarity of ``percent``."""
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in ("bits1", "bits2", "bits3")), F.lit(0))
    return (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent) & (differ <= MOST_BITS)


def near_duplicates(docs: DataFrame, key: Column | str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 80) -> DataFrame:
    """Per document: key, n_shingles, component (the least key reachable over links, its own included).

    Documents are linked if ``100 * shared shingles >= percent * all shingles`` of both. ``percent`` below 80 would
    need other bands and is refused.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 80 % or more")
    key = F.col(key) if isinstance(key, str) else key
    texts = docs.select(key.alias("id"), F.xxhash64(text).alias("hash"), F.col(text).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    keyed = texts.select(F.struct("id", "hash", F.monotonically_increasing_id().alias("row")).alias("key"), "text")
    signed = keyed.mapInArrow(_signer(shingle), f"key struct<id:{kind},hash:long,row:long>, n_shingles long, set1 long, set2 long, bits1 long, bits2 long, bits3 long, bands array<long>")
    signed = stored(signed.select("key.*", "n_shingles", "set1", "set2", "bits1", "bits2", "bits3", "bands"))

    same = ["n_shingles", "set1", "set2"]
    classes = signed.where("n_shingles > 0").groupBy(*same).agg(
        F.min("row").alias("node"), F.min("id").alias("least_id"), F.min(F.struct("id", "hash")).alias("text_of"), *(F.first(c).alias(c) for c in ("bits1", "bits2", "bits3", "bands"))
    )
    classes = stored(classes)
    sketches = classes.select("node", F.struct(F.col("n_shingles").alias("n"), "bits1", "bits2", "bits3").alias("sketch"))
    banded = classes.select(F.explode("bands").alias("bucket"), "node")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("leader")).where("members > 1")
    shared = stored(banded.join(buckets.drop("members"), "bucket"))
    pairs = shared.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and sketches allow a link."""
        x, y = sketches.withColumnsRenamed({"node": "a", "sketch": "x"}), sketches.withColumnsRenamed({"node": "b", "sketch": "y"})
        return pairs.join(x, "a").join(y, "b").where(_close(percent)).select("a", "b")

    def fetched_texts(needed: DataFrame) -> DataFrame:
        """node, text of the classes in ``needed`` (node, text_of)."""
        wanted = bitmap_parts(needed.select(F.col("text_of.hash").alias("hash")), "hash")
        found = in_bitmap(texts, F.col("hash"), wanted).select(F.struct("id", "hash").alias("text_of"), "text")
        return found.join(needed.select("node", "text_of"), "text_of").groupBy("node").agg(F.first("text").alias("text"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among the pairs, on the texts of both classes."""
        pairs = checkpointed(pairs)
        needed = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "text_of"), "node"))
        fetched = stored(fetched_texts(needed))
        both = pairs.join(fetched.withColumnsRenamed({"node": "a", "text": "left"}), "a").join(fetched.withColumnsRenamed({"node": "b", "text": "right"}), "b")
        links = checkpointed(both.select("a", "b", "left", "right").mapInArrow(_verifier(shingle, percent), "a long, b long"))
        del both
        forget(fetched)
        return links

    links = confirmed(alike(pairs))
    found = checkpointed(connected_components(links))

    # What shares a bucket with a class of another component: first sketches, then texts, both in blocks.
    placed = shared.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    open_buckets = placed.groupBy("bucket").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    members = placed.join(open_buckets.select("bucket", "members"), "bucket").join(sketches, "node")
    near = in_blocks(members, "bucket", BLOCK, ["component", "sketch"]).mapInArrow(_close_roots(percent), "a long, b long").distinct()
    near = checkpointed(near)
    clusters = connected_components(near).withColumnRenamed("component", "cluster")
    clusters = checkpointed(clusters.join(classes.select("node", "text_of"), "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    sized = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("members")), "cluster")
    more = in_blocks(sized.join(fetched_texts(clusters), "node"), "cluster", TEXT_BLOCK, ["component", "text"])
    more = checkpointed(more.mapInArrow(_linked_roots(shingle, percent), "a long, b long").distinct())
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))
    linked = classes.select(*same, "node", "least_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = checkpointed(linked)
    del placed, open_buckets, members, near, clusters, sized, pairs
    forget(shared, classes)
    least = linked.groupBy("component").agg(F.min("least_id").alias("__least"))
    ids = linked.join(least, "component").select(*same, "__least")
    out = signed.select("id", *same).join(ids, same, "left")
    return out.select(F.col("id").alias("key"), "n_shingles", F.coalesce("__least", "id").alias("component"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id, with all its columns. Of rows with equal id and text one stays."""
    found = near_duplicates(docs, F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash")), text, **options)
    keep = found.where(F.col("key") == F.col("component")).select(F.col("key").alias("__key")).distinct()
    marked = docs.withColumn("__key", F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash")))
    return marked.join(keep, "__key").dropDuplicates(["__key"]).drop("__key")
