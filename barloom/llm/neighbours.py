"""Approximate nearest neighbours by inner product: NN-descent builds a graph, greedy search walks it.

Vectors that are equal are one node. Each node begins with random neighbours. In each round the neighbours of a node, in
both directions, meet: joins bring their vectors together by the node they have in common, pairs with a new member
are scored, and each keeps its best. Rounds go on until few lists change. A search keeps a beam of the best nodes
found, expands the best ones not yet expanded by a join with the graph, and stops after ``hops`` rounds. Graph and beam use
half precision, scaled so that the largest component fits; the last candidates are scored in double precision on the original vectors.

Reverse lists are sampled (``reverse`` expected for each node), as is usual for NN-descent; the index holds every row.

Cases: vectors that are null, zero, of another length than most, or with null or non-finite components take no
part, nor do null ids. Rows with equal vectors are all found; equal scores go by id; repeated ids are rows of their own, as queries and as
candidates of each other. Fewer than k candidates give shorter lists; no candidates none. Empty tables give no rows.
Columns other than id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.lineage import checkpointed, forget, stored
from barloom.llm.mixing import global_rank

SALTS = 64


def valid_vectors(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """id, vector (array of double) of the rows that take part."""
    rows = rows.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(fine)
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (size["n"] if size else 0))


def _scale(rows: DataFrame, vector: str = "vector") -> float:
    """A power of two that brings the largest component to between 1 and 2, so that none is beyond half precision; orders stay the same."""
    largest = rows.agg(F.max(F.aggregate(vector, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x))))).first()[0]
    return 2.0 ** (1 - math.frexp(largest)[1]) if largest else 1.0


def _half(vector: str, scale: float) -> Column:
    return F.transform(vector, lambda x: (x * scale).cast("float")).alias("half")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, array of float) to (node, packed): half precision."""
    for batch in batches:
        if batch.num_rows:
            values = batch.column(1).flatten().to_numpy().astype(np.float16).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in values], pa.binary())], names=["node", "packed"])


def _unpack(column: pa.Array) -> np.ndarray:
    """One row of single precision for each packed vector."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.float16)
    return flat.astype(np.float32).reshape(len(column), -1)


def _lists(keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """(node, ids, scores), without empty lists."""
    some = counts > 0
    offsets = np.zeros(int(some.sum()) + 1, dtype=np.int32)
    np.cumsum(counts[some], out=offsets[1:])
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (ids.astype(np.int64), scores.astype(np.float32))]
    return pa.RecordBatch.from_arrays([pa.array(keys[some].astype(np.int64)), *lists], names=["node", "ids", "scores"])


def _meet(most: int):
    """For batches of (center, members): what each member learns, at most ``most`` of each meeting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            members = batch.column(1)
            fields = members.flatten()
            ends = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])
            ids, least, new = (fields.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            vectors = _unpack(fields.field(3))
            keys, counts, found, scores = [], [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = ids[a:b]
                score = vectors[a:b] @ vectors[a:b].T
                good = (score > least[a:b, None]) & (new[a:b, None] | new[None, a:b]) & (own[:, None] != own[None, :])
                if not good.any():
                    continue
                score = np.where(good, score, -np.inf)
                if b - a > most:
                    best = np.argpartition(-score, most - 1, axis=1)[:, :most]
                    score = np.take_along_axis(score, best, axis=1)
                else:
                    best = np.broadcast_to(np.arange(b - a), score.shape)
                keep = score > -np.inf
                keys.append(own)
                counts.append(keep.sum(axis=1))
                found.append(own[best[keep]])
                scores.append(score[keep])
            if keys:
                yield _lists(np.concatenate(keys), np.concatenate(counts), np.concatenate(found), np.concatenate(scores))

    return run


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the distinct ids, best first."""
    order = np.argsort(-scores, kind="stable")
    _, first = np.unique(ids[order], return_index=True)  # an id's best score
    order = order[np.sort(first)[:k]]
    return ids[order], scores[order]


def _merge(k: int):
    """For batches of (node, own ids, own scores, lists of ids, lists of scores): the k best, which are new, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            nested = [(c.flatten().flatten().to_numpy(), np.concatenate([[0], np.cumsum(c.flatten().value_lengths().to_numpy())])[np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())])]) for c in (batch.column(3), batch.column(4))]
            own = [(c.flatten().to_numpy(), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())])) for c in (batch.column(1), batch.column(2))]
            for i in range(batch.num_rows):
                mine, mine_scores = (x[at[i] : at[i + 1]] for x, at in own)
                theirs, their_scores = (x[at[i] : at[i + 1]] for x, at in nested)
                ids, scores = _best(np.concatenate([mine, theirs]), np.concatenate([mine_scores, their_scores]), k)
                new = ~np.isin(ids, mine)
                rows[0].append(ids)
                rows[1].append(scores.astype(np.float32))
                rows[2].append(new)
                rows[3].append(int(new.sum()))
            kinds = (pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, t) for r, t in zip(rows, kinds, strict=True))], names=["node", "ids", "scores", "new", "changes"])

    return run


def _start(k: int, nodes: int, seed: int):
    """For batches of (node): k random other nodes, all new; their scores count as lowest, so whatever is found replaces them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores, new = [], [], []
            for node in batch.column(0).to_pylist():
                other = np.unique(np.random.default_rng((seed, node)).integers(0, nodes, k))
                other = other[other != node]
                ids.append(other)
                scores.append(np.full(len(other), -3e38, dtype=np.float32))
                new.append(np.ones(len(other), dtype=bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float32())), pa.array(new, pa.list_(pa.bool_()))], names=["node", "ids", "scores", "new"])

    return run


GRAPH = "node long, ids array<long>, scores array<float>, new array<boolean>"


def neighbour_graph(packed: DataFrame, nodes: int, k: int = 30, reverse: int = 20, learn: int = 10, rounds: int = 10, enough: float = 0.02, seed: int = 11) -> DataFrame:
    """node, ids, scores: the k nearest nodes found for each node. packed: node (0 to nodes - 1), packed."""
    graph = checkpointed(packed.select("node").mapInArrow(_start(k, nodes, seed), GRAPH))
    for turn in range(rounds):
        links = graph.select("node", F.explode(F.arrays_zip("ids", "new")).alias("x")).select("node", F.col("x.ids").alias("other"), F.col("x.new").alias("new"))
        popular = links.groupBy("other").agg(F.count("*").alias("n"))
        chance = (F.pmod(F.xxhash64(F.lit(seed + turn), "node", "other"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
        back = links.join(popular, "other").where(chance * F.col("n") < reverse).select(F.col("other").alias("center"), F.col("node").alias("member"), "new")
        meetings = links.select(F.col("node").alias("center"), F.col("other").alias("member"), "new").unionByName(back).groupBy("center", "member").agg(F.max("new").alias("new"))
        least = graph.select(F.col("node").alias("member"), F.when(F.size("ids") >= k, F.element_at("scores", -1)).otherwise(F.lit(-3e38).cast("float")).alias("least"))
        known = packed.withColumnRenamed("node", "member").join(least, "member")
        groups = meetings.join(known, "member").groupBy("center").agg(F.collect_list(F.struct("member", "least", "new", "packed")).alias("members"))
        learned = groups.mapInArrow(_meet(learn), "node long, ids array<long>, scores array<float>")
        gathered = learned.groupBy("node").agg(F.collect_list("ids").alias("more"), F.collect_list("scores").alias("more_scores"))
        none = "cast(array() as array<array<{}>>)"
        merged = graph.select("node", "ids", "scores").join(gathered, "node", "left").select("node", "ids", "scores", F.coalesce("more", F.expr(none.format("bigint"))).alias("more"), F.coalesce("more_scores", F.expr(none.format("float"))).alias("more_scores"))
        merged = checkpointed(merged.mapInArrow(_merge(k), f"{GRAPH}, changes long"))
        changes = merged.agg(F.coalesce(F.sum("changes"), F.lit(0))).first()[0]
        graph = merged.drop("changes")
        del links, popular, back, meetings, known, groups, learned, gathered, merged
        forget()
        if changes <= enough * nodes * k:
            break
    return graph.select("node", "ids", "scores")


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For batches of (query, its packed vector, its least score, neighbours): the better neighbours with their scores."""
    for batch in batches:
        if not batch.num_rows:
            continue
        queries, least = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        asked = _unpack(batch.column(1))
        lists = batch.column(3)
        fields = lists.flatten()
        lengths = lists.value_lengths().to_numpy()
        ids = fields.field(0).to_numpy()
        row = np.repeat(np.arange(batch.num_rows), lengths)
        score = np.einsum("ij,ij->i", _unpack(fields.field(1)), asked[row])
        keep = score > least[row]
        yield _lists(queries, np.bincount(row[keep], minlength=batch.num_rows), ids[keep], score[keep])


def _advance(beam: int):
    """For batches of (query, beam ids, scores, expanded, lists of ids, of scores): the new beam."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for row in batch.to_pylist():
                ids = np.concatenate([np.array(row["ids"], dtype=np.int64), *(np.array(x, dtype=np.int64) for x in row["more"])])
                scores = np.concatenate([np.array(row["scores"], dtype=np.float32), *(np.array(x, dtype=np.float32) for x in row["more_scores"])])
                done = np.array([i for i, e in zip(row["ids"], row["expanded"], strict=True) if e], dtype=np.int64)
                ids, scores = _best(ids, scores, beam)
                out[0].append(ids)
                out[1].append(scores)
                out[2].append(np.isin(ids, done))
            kinds = (pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["query", "ids", "scores", "expanded"])

    return run


def greedy_search(graph: DataFrame, packed: DataFrame, queries: DataFrame, nodes: int, beam: int = 128, width: int = 24, hops: int = 5, entries: int = 16) -> DataFrame:
    """query, ids, scores: the best nodes found. queries: query (long), packed, at (a node to begin at, or null)."""
    forward = graph.select("node", F.explode("ids").alias("other"))
    both = forward.unionByName(forward.select(F.col("other").alias("node"), F.col("node").alias("other")))
    popular = forward.groupBy("other").agg(F.count("*").alias("n")).withColumnRenamed("other", "node")
    # a node's own list, and of those that list it about as many
    size = F.greatest(F.lit(1), F.size("ids"))
    own = graph.select("node", size.alias("k")).join(popular, "node", "left")
    chance = (F.pmod(F.xxhash64("node", "other"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    back = forward.select(F.col("other").alias("node"), F.col("node").alias("other")).join(own, "node").where(chance * F.col("n") < F.col("k")).select("node", "other")
    both = forward.unionByName(back).distinct()
    around = both.join(packed.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.collect_list(F.struct("other", "packed")).alias("around"))
    around = checkpointed(around)
    queries = checkpointed(queries)
    starts = F.array_distinct(F.filter(F.concat(F.array("at"), F.transform(F.sequence(F.lit(1), F.lit(entries)), lambda i: F.pmod(F.xxhash64(i), F.lit(nodes)))), lambda x: x.isNotNull()))
    none = F.expr("cast(array() as array<float>)")
    state = queries.select("query", starts.alias("ids")).withColumn("scores", F.transform("ids", lambda _: F.lit(-2e38).cast("float"))).withColumn("expanded", F.transform("ids", lambda _: F.lit(False)))
    for _ in range(hops):
        open_nodes = F.slice(F.filter(F.arrays_zip("ids", "expanded"), lambda x: ~x["expanded"]), 1, width)
        state = state.withColumn("now", F.transform(open_nodes, lambda x: x["ids"])).withColumn("least", F.when(F.size("ids") >= beam, F.element_at("scores", -1)).otherwise(F.lit(-1e38).cast("float")))
        state = checkpointed(state)
        asked = state.select("query", "least", F.explode("now").alias("node")).join(queries.select("query", "packed"), "query")
        found = asked.join(around, "node").select("query", "packed", "least", "around").mapInArrow(_expand, "node long, ids array<long>, scores array<float>")
        found = found.groupBy(F.col("node").alias("query")).agg(F.collect_list("ids").alias("more"), F.collect_list("scores").alias("more_scores"))
        marked = state.withColumn("expanded", F.zip_with("ids", "expanded", lambda i, e: e | F.array_contains("now", i))).select("query", "ids", "scores", "expanded")
        empty = "cast(array() as array<array<{}>>)"
        state = marked.join(found, "query", "left").select("query", "ids", "scores", "expanded", F.coalesce("more", F.expr(empty.format("bigint"))).alias("more"), F.coalesce("more_scores", F.expr(empty.format("float"))).alias("more_scores"))
        state = state.mapInArrow(_advance(beam), "query long, ids array<long>, scores array<float>, expanded array<boolean>")
    return checkpointed(state.select("query", "ids", "scores"))


def inner_product(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def nearest(rows: DataFrame, queries: Column, row_id: str = "vec_id", vector: str = "embedding", k: int = 20, finalists: int = 48, **options) -> DataFrame:
    """query_id, rank, id, score: the k nearest other rows of each row for which ``queries`` holds (an expression over ``id``)."""
    rows = stored(valid_vectors(rows, row_id, vector))
    # the k + 1 least ids of each vector are all that one list can show
    first = F.row_number().over(Window.partitionBy("vector", "salt").orderBy("id"))
    again = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS))).withColumn("nth", first).where(F.col("nth") <= k + 1).withColumn("nth", again).where(F.col("nth") <= k + 1)
    distinct = checkpointed(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members")))
    count = distinct.count()
    index = stored(global_rank(distinct, [F.col("members")[0], F.col("vector")], "node", count).withColumn("node", F.col("node").cast("long") - 1))
    packed = checkpointed(index.select("node", _half("vector", _scale(index))).mapInArrow(_pack, "node long, packed binary"))
    graph_options = {n: options.pop(n) for n in ("reverse", "learn", "rounds", "enough", "seed") if n in options}
    graph = neighbour_graph(packed, count, **({"k": options.pop("degree")} if "degree" in options else {}), **graph_options)
    asked = rows.where(queries).select(F.col("id").alias("query_id"), "vector").join(index.select("vector", "node"), "vector").select("query_id", "node")
    asked = checkpointed(asked)
    wanted = asked.select("node").distinct().join(packed, "node").select(F.col("node").alias("query"), "packed", F.col("node").alias("at"))
    found = greedy_search(graph, packed, wanted, count, **options)
    last = found.select("query", F.explode(F.slice("ids", 1, finalists)).alias("node"))
    exact = last.join(index.select(F.col("node").alias("query"), F.col("vector").alias("asked")), "query").join(index, "node")
    scored = exact.select("query", (F.col("node") == F.col("query")).alias("same"), F.explode("members").alias("id"), inner_product("asked", "vector").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    lists = scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score", "same"))).alias("found"))
    # the query itself goes, once: rows that share its id, or all of it, stay
    itself = F.array_position(F.transform("found", lambda x: x["same"] & (x["id"] == F.col("query_id"))), True)
    own = asked.join(lists, asked["node"] == lists["query"]).withColumn("itself", itself).select("query_id", F.slice(F.filter("found", lambda x, i: i + 1 != F.col("itself")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
