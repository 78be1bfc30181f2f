"""Near-duplicate passages by compact windows.

A token is a shingle of ``shingle`` words, a passage is ``words`` consecutive words. Under each of the hash functions a Cartesian
tree over a text's token hashes gives its compact windows: all subsequences inside (left, right) that hold the least token at
the centre share that min-hash. Windows of two functions are joined by their intervals inside each text; each cell of
the join stands for all passages with the same two min-hashes. Cells of ``bands`` pairs of functions are grouped over the
corpus, ``at_once`` bands at a time, and cells of equal tokens are covered and linked at once. Of the different contents of a group
the commonest is the leader; the others are compared with its surroundings, token by token.

What is left is found by prefixes, not by comparing all with all. It is the windows of members that are not covered yet, or whose group has
documents of several components, unless tokens that no other document of any group has rule out that another is similar. Windows
with the same set of tokens are one; each goes by its rarest tokens, of which two similar windows have one in common, whatever else they hold.
Pairs that meet on such a token are dropped in the join if bits of their tokens show that they differ in too many.

A passage counts if at another place, without overlap, a passage of as many words has at least ``percent`` % of all distinct tokens of both in
common, confirmed on the tokens themselves, or on 128 bits of hash where both cells are equal. Passages that are equal share all cells. At a similarity of 0.8 a pair shares none of 5
bands with a probability of 0.6 %, at 0.9 of 0.03 %.

All this is done on few texts. Tokens are counted over the corpus; windows with too many that occur once are similar to nothing, and go. What is left of
texts are pieces; those that differ only in such tokens are one class, of which one is searched and all its members get what it finds.

Map tasks join equal cells inside each of their batches and pass on one of them, so a passage that a third
of all documents share sends one row for each batch and wording. Pieces are cut to the passages in question before they are shuffled.

Cases: null texts and texts of fewer than ``words`` words have no passages; each row is a document of its own, whatever its id, so ids may
be null, repeat, or be strings; the component of documents that all lack an id is null; empty tables give no
rows. Very long texts are read whole. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.bitmap import bitmap_parts, in_bitmap
from barloom.llm.components import connected_components
from barloom.llm.lineage import checkpointed, forget, numbered, stored
from barloom.llm.tokens import BASE, BASE2, CHUNK_BYTES, SPACED, U, Words, chunks, cut_words, enough_powers, mix64, text_bytes

WORDS, SHINGLE, BANDS, AT_ONCE = 50, 5, 5, 3
#: Bits below a span's length: how many documents of a batch have its content.
TIMES = 16
#: Marks rows that carry what is covered already.
COVER = np.int64(-(1 << 63))
#: Rows of one group that are held at a time; its leader stays.
HELD = 1 << 18


def pack(low: np.ndarray, high: np.ndarray, times: np.ndarray | int = 1) -> np.ndarray:
    """Tokens low..high - 1 of a document and how many have them, in one number that orders by place."""
    return (low.astype(np.int64) << 36) | ((high - low).astype(np.int64) << TIMES) | np.minimum(times, 0xFFFF)


def unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = (span >> 36) & 0x7FFFFFF
    return low, low + ((span >> TIMES) & 0xFFFFF)


def tokens_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of all texts one after the other, and where each text's begin."""
    grams, at = words.grams(k)
    return grams, np.searchsorted(words.text[at], np.arange(len(words.first)))


Chunks = Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]


def text_chunks(k: int, batches: Iterator[pa.RecordBatch]) -> Chunks:
    """Pieces of batches with a column ``text``, the tokens of all their texts, and where each text's begin."""
    for piece, data, offsets in chunks(batches, "text"):
        yield piece, *tokens_of(cut_words(data, offsets, SPACED), k)


def token_chunks(batches: Iterator[pa.RecordBatch]) -> Chunks:
    """The same for batches whose column ``tokens`` has the tokens as bytes."""
    for piece, data, offsets in chunks(batches, "tokens"):
        yield piece, data.view(U), offsets >> 3


def compact_windows(order: np.ndarray, bounds: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, first and last place of each compact window of ``least`` tokens or more.

    order: different numbers, by which tokens are compared; text: of each token. The tree is built over the tokens that
    are least in some passage; its edges, from each to the nearest smaller one on either side, are followed for all at once.
    """
    n = len(order)
    if n < least:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    values, size = order, 1
    while size * 2 <= least:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if size < least:
        values = np.minimum(values[: len(values) - (least - size)], values[least - size :])
    inside = text[: n - least + 1] == text[least - 1 :]
    mask = U((1 << int(n).bit_length()) - 1)
    least_somewhere = np.zeros(n, dtype=bool)
    least_somewhere[(values[inside] & mask).astype(np.int64)] = True
    centre = np.flatnonzero(least_somewhere)
    low = order[centre]
    own = text[centre]
    ends = []
    for step in (-1, 1):
        near = np.arange(len(centre)) + step
        open_ = np.arange(len(centre))
        while len(open_):
            at = near[open_]
            valid = (at >= 0) & (at < len(centre))
            open_, at = open_[valid], at[valid]
            further = (own[at] == own[open_]) & (low[at] > low[open_])
            open_ = open_[further]
            near[open_] = near[near[open_]]
        place = np.where((near >= 0) & (near < len(centre)), centre[np.clip(near, 0, max(0, len(centre) - 1))], -1 if step < 0 else n)
        ends.append(place)
    first = np.maximum(ends[0] + 1, bounds[own])
    last = np.minimum(ends[1] - 1, bounds[own + 1] - 1)
    return centre, first, last


def cells(tokens: np.ndarray, bounds: np.ndarray, least: int, bands: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first token, end and content hash of each cell; places count over all texts."""
    n = len(tokens)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    mask = U((1 << int(n).bit_length()) - 1)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(tokens * enough_powers(n, BASE), out=total[1:])
    back = enough_powers(n + 1, pow(BASE, -1, 1 << 64))
    found = []
    for band in bands:
        (c1, l1, r1), (c2, l2, r2) = (compact_windows((mix64(tokens ^ mix64(np.array([2 * band + i + 1], dtype=U))) & ~mask) | np.arange(n, dtype=U), bounds, text, least) for i in (0, 1))
        low, high = np.searchsorted(c2, c1 - least + 1), np.searchsorted(c2, c1 + least - 1, side="right")
        times = high - low
        i = np.repeat(np.arange(len(c1)), times)
        j = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + low[i]
        left, right = np.minimum(c1[i], c2[j]), np.maximum(c1[i], c2[j])
        first = np.maximum(np.maximum(l1[i], l2[j]), right - least + 1)
        last = np.minimum(left, np.minimum(r1[i], r2[j]) - least + 1)
        ok = (first <= last) & (text[left] == text[right])
        i, j, first, end = i[ok], j[ok], first[ok], last[ok] + least
        key = mix64(mix64(tokens[c1[i]] + U(band)) * U(3) + tokens[c2[j]])
        found.append((key, first, end, mix64(((total[end] - total[first]) * back[first]) ^ (end - first).astype(U))))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where any of these columns differs from the row before."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def contents(key: np.ndarray, content: np.ndarray, doc: np.ndarray, span: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows in the order of key, content, doc and span: members, documents of each member's content, rows covered by an equal one, and whose.

    Equal cells of different documents, or of one without overlap, cover each other. A member is the first of its content, or lacks an equal one.
    """
    if not len(key):
        return np.zeros(0, dtype=bool), span, np.zeros(0, dtype=bool), doc
    run_begins = _begins(key, content)
    first = np.flatnonzero(run_begins)
    run = np.cumsum(run_begins) - 1
    last = np.concatenate([first[1:], [len(key)]]) - 1
    several = (doc[last] != doc[first])[run]
    low = unpack(span)[0]
    tied = ~run_begins & (several | (low - low[first][run] >= t))
    covered = tied | (run_begins & np.logical_or.reduceat(tied, first)[run])
    times = np.add.reduceat(span & 0xFFFF, first)
    one, other = doc[first][run], doc[last][run]
    return ~tied, np.where(run_begins, times[run], 1), covered, np.where(doc != one, one, other)


def joined(doc: np.ndarray, partner: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of one document and partner that touch, as one."""
    order = np.lexsort((low, partner, doc))
    doc, partner, low, high = (x[order] for x in (doc, partner, low, high))
    cut = _begins(doc, partner)
    reach = np.maximum.accumulate((np.cumsum(cut) << 32) | high) & 0xFFFFFFFF
    cut[1:] |= low[1:] > reach[:-1]
    at = np.flatnonzero(cut)
    return doc[at], partner[at], low[at], np.maximum.reduceat(high, at) if len(at) else high


#: Of a token's 64 bits: those left out when tokens are counted, and how many of the rest name the bucket.
UNUSED, BUCKETED = 20, 12


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """values[ends[i]:ends[i + 1]] as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows one after the other with the same number in this column."""
    at = np.flatnonzero(_begins(batch.column(column).to_numpy())).tolist()
    for a, b in zip(at, [*at[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


_PRINTS = "bucket int, chunk long, prints binary"


def _prints(read: Callable[[Iterator[pa.RecordBatch]], Chunks], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For batches of (chunk, doc, what is read): the first bits of each chunk's distinct tokens, by bucket."""
    for batch in batches:
        for part in _runs(batch, 0):
            tokens = np.concatenate([t for _, t, _ in read(iter([part]))])
            values = np.unique(tokens >> U(UNUSED))
            bucket = (values >> U(32)).astype(np.int32)
            first = np.flatnonzero(_begins(bucket))
            blobs = _binaries(values.astype(np.uint32), np.append(first, len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(np.full(len(first), part.column(0)[0].as_py())), blobs], names=["bucket", "chunk", "prints"])


def _met_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of these prints, in order of bucket: those that several chunks have. The last bucket of a batch waits for the next."""
    kept: pa.RecordBatch | None = None

    def told(rows: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(rows.column(2))
        values, ends = data.view(np.uint32), offsets >> 2
        bucket = rows.column(0).to_numpy()
        whole = (np.repeat(bucket, np.diff(ends)).astype(U) << U(32)) | values
        order = np.argsort(whole)
        begins = _begins(whole[order])
        again = ~begins
        again[:-1] |= ~begins[1:]
        several = np.zeros(len(values), dtype=bool)
        several[order[again]] = True
        ends = np.concatenate([[0], np.cumsum(several)])[ends]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), _binaries(values[several], ends)], names=["bucket", "chunk", "prints"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if kept is not None:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        last = int(np.searchsorted(batch.column(0).to_numpy(), batch.column(0)[batch.num_rows - 1].as_py()))
        kept = batch.slice(last)
        if last:
            yield told(batch.slice(0, last))
    if kept is not None:
        yield told(kept)


_PIECES = "doc long, low long, one long, two long, tokens binary"


def live_pieces(tokens: np.ndarray, bounds: np.ndarray, several: np.ndarray, t: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and end of each range covered by windows of t tokens of which no more occur nowhere else than a similar window may lack."""
    n = len(tokens) - t + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    total = np.concatenate([[0], np.cumsum(~several)])
    at = np.flatnonzero((text[:n] == text[t - 1 :]) & (100 * (t - total[t:] + total[:-t]) >= percent * t))
    cut = _begins(text[at])
    cut[1:] |= np.diff(at) > t
    first = np.flatnonzero(cut)
    return at[first], at[np.append(first[1:], len(at)) - 1] + t if len(first) else at


def _live(read: Callable[[Iterator[pa.RecordBatch]], Chunks], t: int, percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a chunk's rows (chunk, doc, what is read) and its prints found in other chunks: the pieces that may be similar to something.

    Tokens found nowhere else are odd, all others even. one, two: 128 bits of the even tokens and the places of the odd ones.
    """

    def run(rows: pa.Table, met: pa.Table) -> pa.Table:
        doc, parts = rows.column(1).to_numpy(), list(read(iter(rows.combine_chunks().to_batches())))
        tokens = np.concatenate([np.zeros(0, dtype=U), *(p[1] for p in parts)])
        bounds = np.cumsum(np.concatenate([[0], *(np.diff(p[2]) for p in parts)])).astype(np.int64)
        prints = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32))]
        for batch in met.to_batches():
            data, offsets = text_bytes(batch.column(2))
            prints.append((np.repeat(batch.column(0).to_numpy(), np.diff(offsets) >> 2), data.view(np.uint32)))
        elsewhere = (np.concatenate([p[0] for p in prints]).astype(U) << U(32)) | np.concatenate([p[1] for p in prints])
        values, inverse, times = np.unique(tokens >> U(UNUSED), return_inverse=True, return_counts=True)
        several = ((times > 1) | np.isin(values, elsewhere))[inverse]
        first, end = live_pieces(tokens, bounds, several, t, percent)
        tokens = (tokens & ~U(1)) | (~several).astype(U)
        shown = np.where(several, tokens, U(0))
        back = enough_powers(len(tokens) + 1, pow(BASE, -1, 1 << 64))
        names = []
        for seed in (U(0), U(BASE2)):
            total = np.zeros(len(tokens) + 1, dtype=U)
            np.cumsum(mix64(shown ^ seed) * enough_powers(len(tokens), BASE), out=total[1:])
            names.append(mix64(((total[end] - total[first]) * back[first]) ^ (end - first).astype(U)).view(np.int64))
        text = np.searchsorted(bounds, first, side="right") - 1
        blobs = _binaries(tokens[np.repeat(first - np.cumsum(end - first) + (end - first), end - first) + np.arange((end - first).sum())], np.concatenate([[0], np.cumsum(end - first)]))
        return pa.Table.from_arrays([pa.array(doc[text]), pa.array(first - bounds[text]), *(pa.array(c) for c in names), blobs], names=["doc", "low", "one", "two", "tokens"])

    return run


def _twins(t: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For batches of (node, tokens): what of a piece has a similar passage in another that has other tokens in place of the odd ones."""
    for piece, tokens, bounds in token_chunks(batches):
        out: list[tuple[int, int, int]] = []
        for i, node in enumerate(piece.column(0).to_pylist()):
            x = tokens[bounds[i] : bounds[i + 1]]
            out += [(node, a, b) for a, b in similar_both(x, np.where(x & U(1) > 0, x ^ U(BASE2 - 1), x), t, percent)[0]]
        columns = np.array(out, dtype=np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(columns[:, i]) for i in range(3)], names=["node", "low", "high"])


_CELL = "key long, content long, doc long, span long"


def _cell_finder(t: int, bands: range) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (doc, tokens): the members of each key among some of them, and what equal cells there cover (content is the partner then)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "tokens", 8 * CHUNK_BYTES):
            parts = []
            for piece, tokens, bounds in token_chunks(iter([batch])):
                key, first, end, content = cells(tokens, bounds, t, bands)
                text = np.searchsorted(bounds, first, side="right") - 1
                parts.append((key.view(np.int64), content.view(np.int64), piece.column(0).to_numpy()[text], pack(first - bounds[text], end - bounds[text])))
            if not parts:
                continue
            rows = [np.concatenate([p[i] for p in parts]) for i in range(4)]
            parts.clear()
            order = np.argsort(rows[0])
            begins = _begins(rows[0][order])
            again = ~begins
            again[:-1] |= ~begins[1:]
            single, order = order[~again], order[again]
            single, order = np.sort(single), order[np.lexsort([r[order] for r in rows[::-1]])]
            key, content, doc, span = (r[order] for r in rows)
            member, times, covered, partner = contents(key, content, doc, span, t)
            low, high = unpack(span)
            docs, partners, lows, highs = joined(doc[covered], partner[covered], low[covered], high[covered])
            alone = mix64(docs.view(U) ^ mix64(lows.view(U))).view(np.int64)  # dealt out evenly
            members = (key[member], content[member], doc[member], pack(low[member], high[member], times[member]))
            columns = zip((r[single] for r in rows), members, (alone, partners, docs, pack(lows, highs) | COVER), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["key", "content", "doc", "span"])

    return run


_PAIR = "group long, doc long, span long, pdoc long, pspan long"


def _pairs(group: np.ndarray | None, doc: np.ndarray, span: np.ndarray, pdoc: np.ndarray | None = None, pspan: np.ndarray | None = None) -> pa.RecordBatch:
    columns = [pa.nulls(len(doc), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (group, doc, span, pdoc, pspan)]
    return pa.RecordBatch.from_arrays(columns, names=["group", "doc", "span", "pdoc", "pspan"])


def _pairer(t: int, batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """For cells in order of key, content, doc and span: what is covered by equal cells (without pspan), each member with its group's leader, and the members of groups of three or more (with group).

    The last group of a batch waits for the next; of a very large one only the leader and the last content's first row wait.
    """
    kept = [np.zeros(0, dtype=np.int64) for _ in range(4)]

    def told(rows: list[np.ndarray], large: bool) -> Iterator[pa.RecordBatch]:
        key, content, doc, span = rows
        member, times, covered, partner = contents(key, content, doc, span, t)
        yield _pairs(None, doc[covered], span[covered], partner[covered])
        at = np.flatnonzero(member)
        first = np.flatnonzero(_begins(key[at]))
        size = np.diff(np.concatenate([first, [len(at)]]))
        rank = (times[at] << 32) | (0xFFFFFFFF - np.arange(len(at)))
        leader = np.repeat(0xFFFFFFFF - (np.maximum.reduceat(rank, first) & 0xFFFFFFFF), size)
        a, b = at[leader != np.arange(len(at))], at[leader[leader != np.arange(len(at))]]
        low, high = unpack(span)
        apart = (doc[a] != doc[b]) | (np.maximum(high[a] - low[b], high[b] - low[a]) >= 2 * t)
        yield _pairs(None, doc[a[apart]], span[a[apart]], doc[b[apart]], span[b[apart]])
        crowd = at[np.repeat((size > 2) | large, size)]
        yield _pairs(key[crowd], doc[crowd], span[crowd])
        if large:
            rows_kept = np.unique([at[leader[0]], np.flatnonzero(_begins(content))[-1]])
            counts = span[rows_kept] & ~np.int64(0xFFFF) | np.minimum(np.where(member, times, 1)[rows_kept], 0xFFFF)
            kept[:] = [key[rows_kept], content[rows_kept], doc[rows_kept], counts]

    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(4)]
        known = rows[3] < 0
        if known.any():
            yield _pairs(None, rows[2][known], rows[3][known] & ~COVER, rows[1][known])
        rows = [np.concatenate([h, r[~known]]) for h, r in zip(kept, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = int(np.flatnonzero(_begins(rows[0]))[-1])
        kept[:] = [r[last:] for r in rows]
        if last:
            yield from told([r[:last] for r in rows], False)
        if len(kept[0]) > held:
            yield from told(list(kept), True)
    if len(kept[0]):
        yield from told(list(kept), False)


def _stretcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs of spans in order of doc, pdoc, bucket (of their distance) and span: those that overlap or touch at about one distance, as one."""
    for batch in batches:
        doc, span, pdoc, pspan, bucket = (batch.column(i).to_numpy() for i in range(5))
        if not len(doc):
            continue
        (low, high), (plow, phigh) = unpack(span), unpack(pspan)
        cut = _begins(doc, pdoc, bucket)
        reach = np.maximum.accumulate((np.cumsum(cut) << 32) | high) & 0xFFFFFFFF
        cut[1:] |= low[1:] > reach[:-1]
        cut |= np.arange(len(cut)) % 4096 == 0  # so that no stretch outgrows a span
        at = np.flatnonzero(cut)
        x, y = pack(low[at], np.maximum.reduceat(high, at)), pack(np.minimum.reduceat(plow, at), np.maximum.reduceat(phigh, at))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[at], x, pdoc[at], y)], names=["doc", "span", "pdoc", "pspan"])


def _distinct_counts(x: np.ndarray, t: int, marked: np.ndarray | None = None) -> np.ndarray:
    """Of each window of t tokens: how many distinct ones it has, among the marked."""
    weight = np.ones(len(x), dtype=np.int64) if marked is None else marked.astype(np.int64)
    order = np.argsort(x, kind="stable")
    again = np.flatnonzero(x[order][1:] == x[order][:-1])
    q, j = order[again], order[again + 1]
    close = (j - q < t) & (weight[j] > 0)
    total = np.concatenate([[0], np.cumsum(weight)])
    counts = total[t:] - total[:-t]
    if close.any():  # an occurrence that has one before it in the window doesn't count
        extra = np.zeros(len(counts) + 1, dtype=np.int64)
        np.add.at(extra, np.maximum(0, j[close] - t + 1), 1)
        np.add.at(extra, np.minimum(len(counts), q[close] + 1), -1)
        counts = counts - np.cumsum(extra)[:-1]
    return counts


def similar_windows(x: np.ndarray, y: np.ndarray, t: int, percent: int, shift: int | None = None) -> list[tuple[int, int]]:
    """The token ranges of x covered by windows of t tokens that have a similar window of t tokens in y.

    shift: where x begins in y's text, counted from y's first token, if they are of one text: windows that overlap don't count then.
    """
    if len(x) < t or len(y) < t:
        return []
    nx, ny = _distinct_counts(x, t), _distinct_counts(y, t)
    within, starts = _distinct_counts(x, t, np.isin(x, y)), np.arange(len(ny))

    def similar(a: int) -> bool:
        if 100 * within[a] < percent * nx[a]:
            return False
        both = _distinct_counts(y, t, np.isin(y, x[a : a + t]))
        enough = 100 * both >= percent * (nx[a] + ny - both)
        return bool((enough if shift is None else enough & (np.abs(starts - a - shift) >= t)).any())

    out: list[list[int]] = []
    a, last = 0, len(x) - t
    while a <= last:
        if not similar(a):
            ahead = np.flatnonzero(100 * within[a + 1 :] >= percent * nx[a + 1 :])
            if not len(ahead):
                break
            a += 1 + int(ahead[0])
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = a + t
        else:
            out.append([a, a + t])
        # all between two similar windows that touch is covered; else the last similar one before the gap counts
        to = min(a + t, last)
        while to > a and not similar(to):
            to -= 1
        if to == a:
            a = a + t + 1
        else:
            a = to
            if to == last:
                out[-1][1] = a + t
                break
    return [(a, b) for a, b in out]


def _covered(similar: np.ndarray, t: int) -> list[tuple[int, int]]:
    """The ranges covered by windows of t tokens, given which are similar."""
    at = np.flatnonzero(similar)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > t)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + t).tolist(), strict=True))


def _close_repeats(codes: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a code occurs again within t places, and where it did before."""
    order = np.argsort(codes, kind="stable")
    again = np.flatnonzero(codes[order][1:] == codes[order][:-1])
    before, at = order[again], order[again + 1]
    close = at - before < t
    return at[close], before[close]


def _window_counts(n: int, t: int, repeats: tuple[np.ndarray, np.ndarray], mark: np.ndarray | None = None) -> np.ndarray:
    """Of each window of t of n places: how many different codes it has, among the marked."""
    at, before = repeats
    if mark is None:
        counts = np.full(n - t + 1, t, dtype=np.int64)
    else:
        total = np.concatenate([[0], np.cumsum(mark)])
        counts = total[t:] - total[:-t]
        at, before = at[mark[at]], before[mark[at]]
    if len(at):
        extra = np.zeros(len(counts) + 1, dtype=np.int64)
        np.add.at(extra, np.maximum(0, at - t + 1), 1)
        np.add.at(extra, np.minimum(len(counts), before + 1), -1)
        counts -= np.cumsum(extra)[:-1]
    return counts


def _presence(codes: np.ndarray, n: int, t: int) -> np.ndarray:
    """Which of n codes each window of t places holds; -1 is none of them."""
    total = np.zeros((len(codes) + 1, n), dtype=np.int32)
    at = np.flatnonzero(codes >= 0)
    total[at + 1, codes[at]] = 1
    np.cumsum(total, axis=0, out=total)
    return (total[t:] > total[:-t]).astype(np.float32)


#: Windows of either side that are compared at a time.
TILE = 256


def similar_both(x: np.ndarray, y: np.ndarray, t: int, percent: int, shift: int | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """``similar_windows`` of x in y and of y in x, by multiplying what tokens their windows hold. Windows that share too few tokens with all of the other side are left out."""
    if len(x) < t or len(y) < t:
        return [], []
    values, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
    cx, cy = codes[: len(x)], codes[len(x) :]
    in_x, in_y = np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=bool)
    in_x[cx] = in_y[cy] = True
    both = in_x & in_y
    common = int(both.sum())
    if not common or (in_x.sum() == len(x) and in_y.sum() == len(y) and (100 + percent) * common < 2 * percent * t):
        return [], []
    rx, ry = _close_repeats(cx, t), _close_repeats(cy, t)
    nx, ny = _window_counts(len(x), t, rx), _window_counts(len(y), t, ry)
    wx, wy = _window_counts(len(x), t, rx, both[cx]), _window_counts(len(y), t, ry, both[cy])
    live_x, live_y = np.flatnonzero((100 + percent) * wx >= percent * (nx + ny.min())), np.flatnonzero((100 + percent) * wy >= percent * (ny + nx.min()))
    of_x, of_y = np.zeros(len(nx), dtype=bool), np.zeros(len(ny), dtype=bool)
    _along_diagonals(cx, cy, nx, ny, rx[0], t, percent, shift, of_x, of_y)
    # what isn't settled on either side meets all of the other
    open_x = live_x[~of_x[live_x]]
    _compare(cx, cy, nx, ny, wy, ry, open_x, live_y, len(values), t, percent, shift, of_x, of_y)
    open_y = live_y[~of_y[live_y]]
    _compare(cx, cy, nx, ny, wy, ry, np.setdiff1d(live_x, open_x, assume_unique=True), open_y, len(values), t, percent, shift, of_x, of_y)
    return _covered(of_x, t), _covered(of_y, t)


#: Distances between two passages' places at which windows are compared place by place.
DIAGONALS = 3


def _along_diagonals(cx: np.ndarray, cy: np.ndarray, nx: np.ndarray, ny: np.ndarray, again: np.ndarray, t: int, percent: int, shift: int | None, of_x: np.ndarray, of_y: np.ndarray) -> None:
    """Marks windows of x and y that already are similar by what they hold at equal distances, at the commonest distances of equal codes.

    again: places of x whose code also stands within t places before. They don't count, so no code counts twice and what is marked is right.
    """
    size = max(int(cx.max()), int(cy.max())) + 1
    place = np.full(size, -1)
    place[cy[::-1]] = np.arange(len(cy) - 1, -1, -1)
    found = place[cx]
    at = np.flatnonzero(found >= 0)
    times = np.bincount(found[at] - at + len(cx))
    counted = np.ones(len(cx), dtype=bool)
    counted[again] = False
    for _ in range(DIAGONALS):
        d = int(times.argmax())
        if (100 + percent) * times[d] < percent * (int(nx.min()) + int(ny.min())):
            break
        times[d] = 0
        d -= len(cx)
        if shift is not None and abs(d - shift) < t:
            continue
        a, b = max(0, -d), min(len(cx), len(cy) - d)
        if b - a < t:
            continue
        total = np.concatenate([[0], np.cumsum((cx[a:b] == cy[a + d : b + d]) & counted[a:b])])
        enough = (100 + percent) * (total[t:] - total[:-t]) >= percent * (nx[a : b - t + 1] + ny[a + d : b + d - t + 1])
        of_x[a : b - t + 1] |= enough
        of_y[a + d : b + d - t + 1] |= enough


def _compare(cx: np.ndarray, cy: np.ndarray, nx: np.ndarray, ny: np.ndarray, wy: np.ndarray, ry: tuple[np.ndarray, np.ndarray], live_x: np.ndarray, live_y: np.ndarray, size: int, t: int, percent: int, shift: int | None, of_x: np.ndarray, of_y: np.ndarray) -> None:
    """Marks the windows of x and of y that are similar to one at the other side's places, tile by tile."""
    if not len(live_y):
        return
    for rows in _tiles(live_x):
        a, b = int(rows[0]), int(rows[-1]) + 1
        held = np.zeros(size, dtype=bool)
        held[cx[a : b + t - 1]] = True
        near = _window_counts(len(cy), t, ry, held[cy]) if len(live_y) > TILE else wy
        for columns in _tiles(live_y[(100 + percent) * near[live_y] >= percent * (ny[live_y] + nx[a:b].min())]):
            c, d = int(columns[0]), int(columns[-1]) + 1
            common = np.unique(cy[c : d + t - 1])
            common = common[held[common]]
            place = np.full(size, -1)
            place[common] = np.arange(len(common))
            shared = _presence(place[cx[a : b + t - 1]], len(common), t) @ _presence(place[cy[c : d + t - 1]], len(common), t).T
            enough = (100 + percent) * shared >= percent * (nx[a:b, None] + ny[None, c:d])
            if shift is not None:
                enough &= np.abs(np.arange(c, d)[None, :] - np.arange(a, b)[:, None] - shift) >= t
            of_x[a:b] |= enough.any(axis=1)
            of_y[c:d] |= enough.any(axis=0)


def _tiles(at: np.ndarray) -> Iterator[np.ndarray]:
    """Stretches of places that span ``TILE`` at most, without long gaps."""
    if len(at):
        cut = np.flatnonzero((np.diff(at) > TILE) | (np.diff(at // TILE) != 0)) + 1
        yield from np.split(at, cut)


def _slicer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For batches of (doc, spans, tokens): the tokens of each span, as bytes."""
    for piece, tokens, bounds in token_chunks(batches):
        lists = piece.column(1)
        own = np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy())
        spans = lists.flatten().to_numpy()
        low, high = unpack(spans)
        start, end = np.minimum(bounds[own] + low, bounds[own + 1]), np.minimum(bounds[own] + high, bounds[own + 1])
        doc = piece.column(0).to_numpy()[own]
        for at in range(0, len(spans), 4096):
            parts = [tokens[a:b].tobytes() for a, b in zip(start[at : at + 4096].tolist(), end[at : at + 4096].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[at : at + 4096]), pa.array(spans[at : at + 4096]), pa.array(parts, pa.binary())], names=["doc", "span", "tokens"])


_FOUND = "doc long, low long, high long, partner long"


def _verifier(t: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (doc, span, pdoc, pspan, x, y): what of one passage's surroundings has a similar passage in the other's, and the other way round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            doc, span, pdoc, pspan = (batch.column(i).to_numpy() for i in range(4))
            low, plow = unpack(span)[0].tolist(), unpack(pspan)[0].tolist()
            for i, (a, b, x, y) in enumerate(zip(doc.tolist(), pdoc.tolist(), batch.column(4), batch.column(5), strict=True)):
                of_x, of_y = similar_both(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), t, percent, low[i] - plow[i] if a == b else None)
                out += [(a, low[i] + start, low[i] + end, b) for start, end in of_x]
                out += [(b, plow[i] + start, plow[i] + end, a) for start, end in of_y]
            columns = np.array(out, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(columns[:, i]) for i in range(4)], names=["doc", "low", "high", "partner"])

    return run


def _window_least(values: np.ndarray, t: int) -> np.ndarray:
    """The least of each t consecutive values."""
    size = 1
    while size * 2 <= t:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (t - size)], values[t - size :]) if size < t else values


def _member_tokens(t: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (doc, spans, tokens): the distinct tokens of all spans together, and how few distinct ones a window of the spans with each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, tokens, bounds in token_chunks(batches):
            docs, found, least = piece.column(0).to_numpy(), [], []
            for i in range(piece.num_rows):
                x = tokens[bounds[i] : bounds[i + 1]]
                low, high = unpack(piece.column(1)[i].values.to_numpy())
                n = _window_counts(len(x), t, _close_repeats(x, t))
                n[~_marked(len(n), low, high - t + 1)] = t
                near = _window_least(np.concatenate([np.full(t - 1, t), n, np.full(t - 1, t)]), t)
                at = np.flatnonzero(_marked(len(x), low, high))
                order = at[np.argsort(x[at], kind="stable")]
                first = np.flatnonzero(_begins(x[order]))
                found.append(x[order[first]])
                least.append(np.minimum.reduceat(near[order], first) if len(first) else near[:0])
            columns = [np.repeat(docs, [len(f) for f in found]), np.concatenate(found).view(np.int64), np.concatenate(least)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "token", "least"])

    return run


def unshared(x: np.ndarray, t: int, elsewhere: np.ndarray) -> np.ndarray:
    """Of each window of t tokens: how many distinct ones are neither ``elsewhere`` nor outside the window."""
    values, first, inverse = np.unique(x, return_index=True, return_inverse=True)
    last = np.zeros(len(values), dtype=np.int64)
    last[inverse] = np.arange(len(x))
    own = ~np.isin(values, elsewhere) & (last - first < t)
    n = len(x) - t + 1
    out = np.zeros(n + 1, dtype=np.int64)
    np.add.at(out, np.clip(last[own] - t + 1, 0, n), 1)
    np.add.at(out, np.minimum(first[own] + 1, n), -1)
    return np.cumsum(out)[:-1]


def _window_sums(values: np.ndarray, t: int, repeats: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each window of t places: the sum, modulo 2^64, of the values in it, equal codes counted once."""
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values, out=total[1:])
    sums = total[t:] - total[:-t]
    at, before = repeats
    if len(at):
        extra = np.zeros(len(sums) + 1, dtype=U)
        np.add.at(extra, np.maximum(0, at - t + 1), values[at])
        np.subtract.at(extra, np.minimum(len(sums), before + 1), values[at])
        sums -= np.cumsum(extra, dtype=U)[:-1]
    return sums


def _marked(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of these ranges."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    return np.cumsum(change)[:-1] > 0


#: What a window asks for: nothing, similar ones in other components, any similar one.
NOTHING, LINKS, COVERAGE = 0, 1, 2
_SETS = "one long, two long, doc long, component long, low long, high long, asks int"


def may_resemble(x: np.ndarray, n: np.ndarray, u: np.ndarray, shared: pa.StructArray | None, t: int, percent: int) -> np.ndarray:
    """Which windows of n tokens, u of them unshared, may be similar to another one.

    That has (n - u) (100 + percent) / percent - n tokens at most, so some token of the window must be in one with so few, here or elsewhere.
    """
    counts = np.minimum(_window_least(np.concatenate([np.full(t - 1, t), n, np.full(t - 1, t)]), t), t)
    values, inverse = np.unique(x, return_inverse=True)
    least = np.full(len(values), t)
    np.minimum.at(least, inverse, counts)
    if shared is not None:
        at = np.searchsorted(values, shared.field("token").to_numpy().view(U))
        least[at] = np.minimum(least[at], shared.field("least").to_numpy())
    return (100 * (n - u) >= percent * n) & ((n - u) * (100 + percent) >= percent * (n + _window_least(least[inverse], t)))


def window_names(x: np.ndarray, n: np.ndarray, elsewhere: np.ndarray, repeats: tuple[np.ndarray, np.ndarray], t: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of n tokens; windows of one name are similar to each other, and to the same others.

    They have the same set of tokens, but for as many that stand nowhere else if the rest is enough to be similar.
    """
    values, inverse, times = np.unique(x, return_inverse=True, return_counts=True)
    alone = ((times == 1) & ~np.isin(values, elsewhere))[inverse]
    total = np.concatenate([[0], np.cumsum(alone)])
    u = total[t:] - total[:-t]
    enough, out = 100 * (n - u) >= percent * (n + u), []
    for seed in (U(0), U(BASE)):
        mixed = mix64(x ^ seed)
        rest = _window_sums(np.where(alone, U(0), mixed), t, repeats)
        out.append(np.where(enough & (u > 0), mix64(rest + mix64(u.astype(U))), _window_sums(mixed, t, repeats)).view(np.int64))
    return out[0], out[1]


def _window_sets(t: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (doc, component, members, have, shared, tokens): the members' windows that going by their unshared tokens may resemble another.

    Each row is a run of windows (low: the first one's start, high: the last one's end) of one name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, tokens, bounds in token_chunks(batches):
            docs, components = piece.column(0).to_numpy(), piece.column(1).to_numpy()
            parts: list[list[np.ndarray]] = []
            for i in range(piece.num_rows):
                x = tokens[bounds[i] : bounds[i + 1]]
                members, have, shared = (piece.column(c)[i].values for c in (2, 3, 4))
                low, high = unpack(members.field("span").to_numpy())
                mixed = members.field("mixed").to_numpy(zero_copy_only=False).astype(bool)
                windows = len(x) - t + 1
                repeats = _close_repeats(x, t)
                n = _window_counts(len(x), t, repeats)
                u = unshared(x, t, np.zeros(0, dtype=U) if shared is None else shared.field("token").to_numpy().view(U))
                covered = np.zeros(len(x), dtype=bool) if have is None else _marked(len(x), have.field("low").to_numpy(), have.field("high").to_numpy())
                total = np.concatenate([[0], np.cumsum(covered)])
                asks = np.where(_marked(windows, low[mixed], high[mixed] - t + 1), LINKS, NOTHING)
                asks[total[t:] - total[:-t] < t] = COVERAGE
                at = np.flatnonzero(_marked(windows, low, high - t + 1) & may_resemble(x, n, u, shared, t, percent))
                if not len(at):
                    continue
                one, two = window_names(x, n, np.zeros(0, dtype=U) if shared is None else shared.field("token").to_numpy().view(U), repeats, t, percent)
                one, two = one[at], two[at]
                begins = _begins(one, two, asks[at], at - np.arange(len(at)))
                first = np.flatnonzero(begins)
                last = np.concatenate([first[1:], [len(at)]]) - 1
                m = len(first)
                parts.append([one[first], two[first], np.full(m, docs[i]), np.full(m, components[i]), at[first], at[last] + t, asks[at][first]])
            if parts:
                columns = [np.concatenate([p[c] for p in parts]) for c in range(7)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.int32())], names=["one", "two", "doc", "component", "low", "high", "asks"])

    return run


def prefixes(x: np.ndarray, low: np.ndarray, asks: np.ndarray, docs: np.ndarray, values: np.ndarray, t: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token, first start, last start and asks: runs of the windows of x at ``low`` that have the token among their rarest.

    values: x's distinct tokens in order; docs: in how many documents each is. Of two windows of which ``percent`` % of all
    tokens are common, each has a common token among its rarest n - ceil(percent * n / 100) + 1 of n. Tokens found nowhere else are left out.
    """
    code = np.searchsorted(values, x)
    order = np.lexsort((values, docs))
    rank = np.empty(len(values), dtype=np.int32)
    rank[order] = np.arange(len(values), dtype=np.int32)
    useful = ((docs > 1) | (np.bincount(code, minlength=len(values)) > 1))[order]
    views, found = np.lib.stride_tricks.sliding_window_view(rank[code], t), []
    for a in range(0, len(low), 1 << 12):
        held = np.sort(views[low[a : a + (1 << 12)]], axis=1)
        place = np.cumsum(np.concatenate([np.ones((len(held), 1), dtype=bool), held[:, 1:] != held[:, :-1]], axis=1), axis=1)
        n = place[:, -1:]
        rare = (place <= n - (percent * n + 99) // 100 + 1) & useful[held]
        rare[:, 1:] &= place[:, 1:] != place[:, :-1]
        row, column = np.nonzero(rare)
        found.append((held[row, column], low[a + row], asks[a + row]))
    ranks, starts, asked = (np.concatenate([f[i] for f in found]) for i in range(3))
    by = np.lexsort((starts, asked, ranks))
    ranks, starts, asked = ranks[by], starts[by], asked[by]
    begins = _begins(ranks, asked)
    begins[1:] |= np.diff(starts >> 3) != 0  # all windows of a run have most tokens in common
    first = np.flatnonzero(begins)
    last = np.concatenate([first[1:], [len(ranks)]]) - 1
    return values[order][ranks[first]], starts[first], starts[last] if len(first) else starts, asked[first]


#: 128 bits of the tokens that all windows of a run hold, and of those that any holds.
SKETCHES = ("all0", "all1", "any0", "any1")
#: The same by other bits: two sketches seldom are wrong about the same pair.
SEEDS = {"": U(0), "again_": U(BASE2)}
_NAMES = [f"{seed}{name}" for seed in SEEDS for name in SKETCHES]
_RARE = "token long, doc long, component long, span long, asks int, alone long, " + ", ".join(f"{name} long" for name in _NAMES)


def sketches(tokens: np.ndarray, first: np.ndarray, end: np.ndarray, alone: np.ndarray | None = None) -> np.ndarray:
    """Two numbers for each range first..end - 1 of the tokens: a bit set for each token in it that isn't ``alone``. Empty ranges have none."""
    bit = mix64(tokens) >> U(57)
    level = np.zeros((len(tokens), 2), dtype=U)
    level[np.arange(len(tokens)), (bit >> U(6)).astype(np.int64)] = U(1) << (bit & U(63))
    if alone is not None:
        level[alone] = U(0)
    out, size = np.zeros((len(first), 2), dtype=U), 1
    length = end - first
    while True:
        now = np.flatnonzero((length >= size) & (length < 2 * size))
        out[now] = level[first[now]] | level[end[now] - size]
        if not (length >= 2 * size).any():
            return out
        level = level[:-size] | level[size:]
        size *= 2


def apart_at_least(one: str, other: str) -> Column:
    """Tokens that any window of a run lacks of any window of another run, counted on both sides: never more than there are."""
    lacking = [F.bit_count(F.col(f"{a}all{i}").bitwiseAND(F.bitwise_not(f"{b}any{i}"))) for a, b in ((one, other), (other, one)) for i in (0, 1)]
    return lacking[0] + lacking[1] + lacking[2] + lacking[3]


def _rare_tokens(t: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (doc, component, windows, shared, tokens): the rare tokens of these windows, and the spans of those that have them.

    alone: tokens that all windows of a run hold and that stand nowhere else. Sketches leave such tokens out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, tokens, bounds in token_chunks(batches):
            parts: list[list[np.ndarray]] = []
            alone = np.zeros(len(tokens), dtype=bool)
            for i in range(piece.num_rows):
                x = tokens[bounds[i] : bounds[i + 1]]
                windows, shared = piece.column(2)[i].values, piece.column(3)[i].values
                values, inverse, times = np.unique(x, return_inverse=True, return_counts=True)
                docs = np.ones(len(values), dtype=np.int64)
                if shared is not None:
                    docs[np.searchsorted(values, shared.field("token").to_numpy().view(U))] = shared.field("docs").to_numpy()
                alone[bounds[i] : bounds[i + 1]] = ((docs == 1) & (times == 1))[inverse]
                token, first, last, asks = prefixes(x, windows.field("low").to_numpy(), windows.field("asks").to_numpy(), docs, values, t, percent)
                m = len(token)
                parts.append([token.view(np.int64), np.full(m, piece.column(0)[i].as_py()), np.full(m, piece.column(1)[i].as_py()), first, last, np.full(m, bounds[i]), asks])
            token, doc, component, first, last, base, asks = (np.concatenate([p[c] for p in parts]) for c in range(7))
            every = base + last, np.maximum(base + last, base + first + t)
            held = np.hstack([sketches(tokens ^ seed, *r, alone) for seed in SEEDS.values() for r in (every, (base + first, base + last + t))]).view(np.int64)
            total = np.concatenate([[0], np.cumsum(alone)])
            columns = [token, doc, component, pack(first, last + t)]
            ends = [total[every[1]] - total[every[0]], *(np.ascontiguousarray(c) for c in held.T)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(asks, pa.int32()), *(pa.array(c) for c in ends)], names=["token", "doc", "component", "span", "asks", "alone", *_NAMES])

    return run


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For batches of (id, text): the same with the number of words, and of the piece of about ``CHUNK_BYTES`` that each is in, counted by task."""
    for part, (piece, data, offsets) in enumerate(chunks(batches, "text")):
        inside = SPACED[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < len(data)]
        begins[at] = inside[at]
        total = np.concatenate([[0], np.cumsum(begins)])
        columns = [piece.column(0), piece.column(1), pa.array(total[offsets[1:]] - total[offsets[:-1]]), pa.array(np.full(piece.num_rows, part))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n_words", "part"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ranges in order of doc, low, high and partner: those that touch as one, with the least partner of each range. A document's rows wait for its last."""
    kept = [np.zeros(0, dtype=np.int64) for _ in range(4)]

    def told(doc: np.ndarray, low: np.ndarray, high: np.ndarray, partner: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(_begins(doc, low, high))
        doc, low, high, partner = doc[at], low[at], high[at], partner[at]
        cut = _begins(doc)
        reach = np.maximum.accumulate((np.cumsum(cut) << 32) | high) & 0xFFFFFFFF
        cut[1:] |= low[1:] > reach[:-1]
        first = np.flatnonzero(cut)
        run = np.cumsum(cut) - 1
        by = np.lexsort((partner, run))
        own = by[np.flatnonzero(_begins(run[by], partner[by]))]
        ends = np.concatenate([[0], np.cumsum(np.bincount(run[own], minlength=len(first)))])
        partners = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(partner[own]))
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(low[first]), pa.array(np.maximum.reduceat(high, first)), partners], names=["doc", "low", "high", "partners"])

    for batch in batches:
        rows = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(kept)]
        if not len(rows[0]):
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        kept = [r[last:] for r in rows]
        if last:
            yield told(*(r[:last] for r in rows))
    if len(kept[0]):
        yield told(*kept)


def _spans_merged(words: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (key, n_words, found, component, members): (key, n_words, spans in words, partners, component, members)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for found in batch.column(2).to_pylist():
                ranges: list[list[int]] = []
                for r in sorted(found or (), key=lambda r: r["low"]):
                    start, end = r["low"], r["high"] + k - 1
                    if ranges and start <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], end)
                    else:
                        ranges.append([start, end])
                spans.append([{"start": a, "end": b} for a, b in ranges])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), batch.column(3), batch.column(4), batch.column(5)], names=["key", "n_words", "spans", "partners", "component", "members"])

    return run


@dataclass
class Level:
    """Pieces that differ in more than the tokens that only they have, one row for each, and where they are.

    nodes: node, tokens, doc and other (two that have it), times; members: node, doc, low; twins: node, low, high, what of them is similar among their own members.
    """

    nodes: DataFrame
    members: DataFrame
    twins: DataFrame


def condensed(rows: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Chunks], t: int, percent: int) -> Level:
    """The pieces of these rows (chunk, doc, what is read) that may be similar to something, as far as tokens that occur once tell.

    A window that has too many such tokens is similar to no other, whatever else there is. Of pieces that differ in such tokens only, each is similar to
    whatever any other of them is; so one stands for all, and whether they are similar among themselves is seen from it alone.
    """
    asked = rows.mapInArrow(partial(_prints, read), _PRINTS)
    met = stored(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met_prints, _PRINTS).where("length(prints) > 0"))
    del asked
    forget()
    pieces = stored(rows.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(_live(read, t, percent), _PIECES))
    forget(met)
    place = F.struct("doc", "low")
    classes = pieces.groupBy("one", "two").agg(F.min(place).alias("first"), F.max("doc").alias("other"), F.count("*").alias("times"))
    firsts = classes.select(F.col("first.doc").alias("doc"), F.col("first.low").alias("low"), "other", "times")
    nodes = numbered(pieces.join(firsts, ["doc", "low"])).withColumnRenamed("row", "node")
    members = stored(pieces.select("one", "two", "doc", "low").join(nodes.select("one", "two", "node"), ["one", "two"]).select("node", "doc", "low"))
    twins = stored(nodes.where("times > 1").select("node", "tokens").mapInArrow(partial(_twins, t, percent), "node long, low long, high long"))
    del classes, firsts
    forget(pieces)
    return Level(nodes, members, twins)


def _low(span: Column) -> Column:
    return F.shiftright(span, 36)


def _high(span: Column) -> Column:
    return _low(span) + F.shiftright(span, TIMES).bitwiseAND(F.lit(0xFFFFF))


def _packed(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 36).bitwiseOR(F.shiftleft(b - a, TIMES)).bitwiseOR(F.lit(1).cast("long"))


def _similar(texts: DataFrame, known: DataFrame, component_of: Callable[[DataFrame], DataFrame], t: int, percent: int, bands: int, at_once: int) -> tuple[DataFrame, DataFrame]:
    """For texts (doc, tokens): doc, low, high, partners of stretches covered by similar passages elsewhere; links a, b between them.

    known: doc, low, high that is covered already. component_of: makes doc, component of such links; what is in no row is a component of its own.
    """
    rounds = []
    for first in range(0, bands, at_once):
        found = texts.mapInArrow(_cell_finder(t, range(first, min(bands, first + at_once))), _CELL)
        dealt = found.repartition("key").sortWithinPartitions("key", "content", "doc", "span")
        rounds.append(stored(dealt.mapInArrow(partial(_pairer, t), _PAIR)))
        del found, dealt
        forget()
    pairs = rounds[0]
    for more in rounds[1:]:
        pairs = pairs.unionByName(more)

    def with_tokens(wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` (one for each doc) with their tokens, of which others are left out before anything is shuffled."""
        marks = bitmap_parts(wanted.select(F.xxhash64("doc").alias("mark")), "mark")
        return wanted.join(in_bitmap(texts, F.xxhash64("doc"), marks), "doc")

    def verified(unlike: DataFrame) -> DataFrame:
        """doc, low, high, partner: what similar windows cover on either side of these pairs (doc, span, pdoc, pspan), around pspan too."""
        bucketed = unlike.withColumn("bucket", F.shiftright(_low(F.col("pspan")) - _low(F.col("span")) + 32, 6))
        asked = bucketed.repartition("doc", "pdoc").sortWithinPartitions("doc", "pdoc", "bucket", "span").select("doc", "span", "pdoc", "pspan", "bucket")
        asked = asked.mapInArrow(_stretcher, "doc long, span long, pdoc long, pspan long")
        # one of few ranges, so that a leader isn't cut anew for each of its pairs
        wide = _packed(F.shiftleft(F.shiftright(F.greatest(F.lit(0), _low(F.col("pspan")) - t + 1), 5), 5), F.shiftleft(F.shiftright(_high(F.col("pspan")) + t + 30, 5), 5))
        asked = stored(asked.withColumn("pspan", wide))
        spans = asked.select("doc", "span").unionByName(asked.select(F.col("pdoc").alias("doc"), F.col("pspan").alias("span"))).distinct()
        slices = stored(with_tokens(spans.groupBy("doc").agg(F.collect_list("span").alias("spans"))).mapInArrow(_slicer, "doc long, span long, tokens binary"))
        both = asked.join(slices.withColumnRenamed("tokens", "x"), ["doc", "span"]).join(slices.select(F.col("doc").alias("pdoc"), F.col("span").alias("pspan"), F.col("tokens").alias("y")), ["pdoc", "pspan"])
        out = stored(both.select("doc", "span", "pdoc", "pspan", "x", "y").mapInArrow(_verifier(t, percent), _FOUND))
        del both, spans
        forget(asked, slices)
        return out

    # a popular passage has one row in the end; links are taken before
    stretched = lambda df: df.select("doc", "low", "high", "partner").repartition("doc").sortWithinPartitions("doc", "low", "high", "partner").mapInArrow(_stretches, "doc long, low long, high long, partners array<long>")
    links_of = lambda df: df.where("doc <> partner").select(F.greatest("doc", "partner").alias("a"), F.least("doc", "partner").alias("b")).distinct()
    equal = pairs.where("group is null and pspan is null").select("doc", _low(F.col("span")).alias("low"), _high(F.col("span")).alias("high"), F.col("pdoc").alias("partner"))
    similar = verified(pairs.where("pspan is not null").select("doc", "span", "pdoc", "pspan"))
    covered = stored(stretched(equal.unionByName(similar)))
    links = stored(links_of(equal.unionByName(similar)))
    component = component_of(links)
    del equal
    forget(similar)

    # Windows of members of groups of three or more that aren't covered yet, or whose group has documents of several components.
    # Groups of covered members of one component have nothing to ask.
    members = pairs.where("group is not null").select("group", "doc", "span").distinct()
    have = covered.select("doc", "low", "high").unionByName(known).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("have"))
    named = component.join(have, "doc", "full")
    within = F.exists("have", lambda r: (r["low"] <= _low(F.col("span"))) & (r["high"] >= _high(F.col("span"))))
    tagged = stored(members.join(named, "doc", "left").select("group", "doc", "span", F.coalesce("component", "doc").alias("component"), (~F.coalesce(within, F.lit(False))).alias("open")))
    mixed = tagged.groupBy("group").agg((F.min("component") != F.max("component")).alias("mixed"), F.max("open").alias("any")).where("mixed or any").select("group", "mixed")
    per_doc = stored(tagged.join(mixed, "group").groupBy("doc", "component", "span").agg(F.max("mixed").alias("mixed")).groupBy("doc", "component").agg(F.collect_list(F.struct("span", "mixed")).alias("members")))
    tokens = stored(with_tokens(per_doc.select("doc", F.col("members.span").alias("spans"))).mapInArrow(_member_tokens(t), "doc long, token long, least long"))
    several = tokens.groupBy("token").agg(F.count("*").alias("docs"), F.min("least").alias("least")).where("docs > 1")
    shared = tokens.select("doc", "token").join(several, "token").groupBy("doc").agg(F.collect_list(F.struct("token", "docs", "least")).alias("shared"))
    full = stored(with_tokens(per_doc.join(have, "doc", "left").join(shared, "doc", "left")).select("doc", "component", "members", "have", "shared", "tokens"))
    del members, tagged, mixed, several, shared, have
    forget(per_doc, tokens, *rounds)

    # Windows of one name cover each other; one of each name goes on, and asks for all.
    sets = stored(full.mapInArrow(_window_sets(t, percent), _SETS))
    first = F.min(F.struct("doc", "low", "component")).alias("first")
    sizes = [F.max("doc").alias("last"), F.min("low").alias("least"), F.max("high").alias("most"), F.max("asks").alias("asks")]
    classes = stored(sets.groupBy("one", "two").agg(first, *sizes).withColumn("several", (F.col("first.doc") != F.col("last")) | (F.col("most") - F.col("least") >= 2 * t)))
    alike = sets.join(classes.where("several").select("one", "two", F.col("first.doc").alias("head"), "last"), ["one", "two"])
    alike = stored(alike.where("asks > 0").select("doc", "low", "high", F.when(F.col("doc") == F.col("head"), F.col("last")).otherwise(F.col("head")).alias("partner")))
    asks = F.when(F.col("several"), F.least(F.col("asks"), F.lit(LINKS))).otherwise(F.col("asks"))
    wanted = classes.select(F.col("first.doc").alias("doc"), F.col("first.low").alias("low"), asks.alias("asks")).groupBy("doc").agg(F.collect_list(F.struct("low", "asks")).alias("windows"))
    rare = stored(wanted.join(full, "doc").select("doc", "component", "windows", "shared", "tokens").mapInArrow(_rare_tokens(t, percent), _RARE))
    asking = rare.where("asks > 0")
    offers = in_bitmap(rare, F.col("token"), bitmap_parts(asking.select("token"), "token"))
    offers = offers.select("token", F.col("doc").alias("pdoc"), F.col("component").alias("other"), F.col("span").alias("pspan"), F.col("asks").alias("pasks"), F.col("alone").alias("palone"), *(F.col(name).alias(f"p{name}") for name in _NAMES))
    met = asking.join(offers, "token")
    elsewhere = (F.col("doc") != F.col("pdoc")) | (F.greatest(_high(F.col("span")) - _low(F.col("pspan")), _high(F.col("pspan")) - _low(F.col("span"))) >= 2 * t)
    wants = (F.col("asks") == COVERAGE) | (F.col("component") != F.col("other"))
    once = (F.col("pasks") < F.col("asks")) | ((F.col("pasks") == F.col("asks")) & (F.struct("doc", "span") <= F.struct("pdoc", "pspan")))
    near = F.col("alone") + F.col("palone") + F.greatest(*(apart_at_least(seed, f"p{seed}") for seed in SEEDS)) <= 2 * t * (100 - percent) // (100 + percent)
    met = met.where(elsewhere & wants & once & near).select("doc", "span", "pdoc", "pspan").distinct()
    more = alike.unionByName(verified(met))
    del asking, offers, met, wanted
    forget(full, sets, classes, rare)
    return covered.unionByName(stretched(more)), links.unionByName(links_of(more))


def near_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, shingle: int = SHINGLE, percent: int = 80, bands: int = BANDS, at_once: int = AT_ONCE) -> DataFrame:
    """Per document: key, n_words, spans (start, end in words: maximal runs covered by near-duplicate passages), partners, component, members.

    partners: ids of documents in which such passages were found, one for each stretch at least. component: the least id reachable over
    links, its own included; two documents are linked if a passage of one is similar to one of the other. members: how many
    documents are in the component. A popular passage links all its texts without a row for each two of them.
    """
    if not 1 <= shingle < words or words - shingle + 1 > 255:
        raise ValueError("a passage must be longer than a shingle, and have 255 shingles at most")
    t = words - shingle + 1
    named = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    rows = numbered(named.mapInArrow(_word_counter, f"id {kind}, text string, n_words long, part long"))
    chunk = F.shiftleft(F.shiftright("row", 33), 24).bitwiseOR(F.col("part"))
    outer = condensed(rows.where(F.col("n_words") >= words).select(chunk.alias("chunk"), F.col("row").alias("doc"), "text"), partial(text_chunks, shingle), t, percent)
    ids = stored(rows.select(F.col("row").alias("doc"), "id", "n_words"))
    forget(rows)
    # Once more: what only members of one class have is nothing that classes have in common.
    inner = condensed(outer.nodes.select(F.shiftright("node", 10).alias("chunk"), F.col("node").alias("doc"), "tokens"), token_chunks, t, percent)

    def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """node, component: documents are 3 x row, classes 3 x node + 1 and + 2, of the outer and the inner level. known: the same for some of the links."""
        linked = links.select(F.explode(F.array("a", "b")).alias("node")).unionByName(inner.twins.select("node")).distinct()
        among = inner.members.join(linked, "node").select("node", "doc")
        reached = among.select(F.col("doc").alias("node")).unionByName(outer.twins.select("node")).distinct()
        over = outer.members.join(reached, "node").select("node", "doc")
        edges = [links.select(F.col("a") * 3 + 2, F.col("b") * 3 + 2), among.select(F.col("node") * 3 + 2, F.col("doc") * 3 + 1), over.select(F.col("node") * 3 + 1, F.col("doc") * 3)]
        joined = edges[0].union(edges[1]).union(edges[2]).toDF("a", "b")
        if known is None:
            return checkpointed(connected_components(joined))
        for end in ("a", "b"):  # what is known to hang together is one node
            joined = joined.join(known.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        fresh = checkpointed(connected_components(joined.where("a <> b").distinct()))
        moved = known.join(fresh.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return checkpointed(moved.unionByName(fresh.join(known, "node", "left_anti")))

    before: list[DataFrame] = []

    def component_of(links: DataFrame) -> DataFrame:
        before.append(components(links))
        return before[0].where("node % 3 = 2").select(F.expr("(node - 2) div 3").alias("doc"), "component")

    found, links = _similar(inner.nodes.select(F.col("node").alias("doc"), "tokens"), inner.twins.withColumnRenamed("node", "doc"), component_of, t, percent, bands, at_once)
    found, links = stored(found), stored(links)
    component = components(links, before[0])

    def upward(level: Level, ranges: DataFrame, partners: DataFrame) -> tuple[DataFrame, DataFrame]:
        """From a level's classes (doc, low, high; doc, partner) to what they stand for, their own twins included."""
        one = F.when(F.col("doc") == F.col("first"), F.col("other")).otherwise(F.col("first"))
        heads = level.nodes.select("node", F.col("doc").alias("first"), "other")
        ranges = ranges.unionByName(level.twins.withColumnRenamed("node", "doc")).withColumnsRenamed({"doc": "node", "low": "from", "high": "to"})
        ranges = level.members.join(ranges, "node").select("doc", (F.col("low") + F.col("from")).alias("low"), (F.col("low") + F.col("to")).alias("high"))
        partners = partners.withColumnRenamed("doc", "node").join(heads.select(F.col("node").alias("partner"), "first"), "partner").select("node", F.col("first").alias("partner"))
        own = level.members.join(heads.join(level.twins.select("node").distinct(), "node"), "node").select("doc", one.alias("partner"))
        return ranges, level.members.join(partners.distinct(), "node").select("doc", "partner").unionByName(own).distinct()

    covered = found.select("doc", "low", "high"), found.select("doc", F.explode("partners").alias("partner")).distinct()
    ranges, partners = upward(outer, *upward(inner, *covered))
    least = component.where("node % 3 = 0").select(F.expr("node div 3").alias("doc"), "component")
    sized = least.join(ids, "doc").groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("members"))
    component = least.join(sized, "component").select("doc", "least", "members")
    ranges = ranges.distinct().groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("found"))
    partners = partners.join(ids.select(F.col("doc").alias("partner"), F.col("id").alias("pid")), "partner").groupBy("doc").agg(F.sort_array(F.collect_set("pid")).alias("partners"))
    none = F.expr(f"cast(array() as array<{kind}>)")
    marked = ids.join(ranges, "doc", "left").join(partners, "doc", "left").join(component, "doc", "left")
    marked = marked.select(F.col("id").alias("key"), "n_words", "found", F.coalesce("partners", none).alias("partners"), F.coalesce("least", "id").alias("component"), F.coalesce("members", F.lit(1).cast("long")).alias("members"))
    return marked.mapInArrow(_spans_merged(words, shingle), f"key {kind}, n_words long, spans array<struct<start:long,end:long>>, partners array<{kind}>, component {kind}, members long")
