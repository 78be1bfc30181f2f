"""Feature plans over blocks of a series, so that one long series is worked on by all cores.

A series is cut into blocks of rows. Each block brings the rows before and after it that the plan's windows reach, so windows
need no other block. Recurrences are parallel prefixes: every block says in a few numbers what it does to any state (an average fades the old
one by a factor and adds its own; a stop stays or ends in one of few places), these are combined along the series in one small pass, and
each block is finished from the state before it. Results are those of ``Columns.add_to``, up to the rounding of sums.

Each depth of recurrences keeps its table in the shared folder, and reads it twice: for the summaries and to finish. What windows over sessions give is
made for all rows of a session at once and joined back by row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import sql as s
from barloom.functions.recurrences import KEYS, ORDER, Recurrence, Running
from barloom.operators.buckets import SPAN, ranked
from barloom.plans.frame import WORD, Columns
from barloom.sources.shared import kept

ROWS = 1 << 14
ROW, BLOCK = "__row", "__block"
WITHIN = f"PARTITION BY symbol, timeframe, {BLOCK} ORDER BY {ROW}"
_SIDE = r"(UNBOUNDED PRECEDING|CURRENT ROW|\d+ PRECEDING|\d+ FOLLOWING)"
_FRAME = re.compile(rf"OVER \({re.escape(s.SERIES)} ROWS BETWEEN {_SIDE} AND {_SIDE}\)")
_LAG = re.compile(rf"lag\(\w+, (\d+)\) OVER \({re.escape(s.SERIES)}\)")
_NUMBER = f"row_number() OVER ({s.SERIES})"
_RUNNING = re.compile(rf"(sum|max|min|last_value)\((\w+)\)(?: IGNORE NULLS)? {re.escape(s.frame(None))}")
_KINDS = {"sum": Running.SUM, "max": Running.MAX, "min": Running.MIN, "last_value": Running.LAST}


@dataclass
class Step:
    """A column or the outputs of a recurrence: what makes it, in which round and projection, and how many rows before and after a row it needs."""

    names: tuple[str, ...]
    text: str = ""
    scan: Recurrence | None = None
    like: str = ""  # the column whose type a running value has
    depth: int = 0
    turn: int = 0
    back: int = 0
    ahead: int = 0

    @property
    def whole(self) -> bool:
        """Whether its windows are neither the series' own nor bounded."""
        return not self.scan and " OVER (" in _LAG.sub("", _FRAME.sub("", self.text.replace(_NUMBER, "")))


def _reach(text: str) -> tuple[int, int]:
    """Rows before and after a row that a text's windows read."""
    back, ahead = max((int(k) for k in _LAG.findall(text)), default=0), 0
    for sides in _FRAME.findall(text):
        if sides[0].startswith("UNBOUNDED"):
            raise ValueError(f"a window from the series' start stands inside another expression: {text}")
        for side in sides:
            n, _, way = side.partition(" ")
            back, ahead = (max(back, int(n)) if way == "PRECEDING" else back), (max(ahead, int(n)) if way == "FOLLOWING" else ahead)
    return back, ahead


def steps(b: Columns, outputs: Iterable[str]) -> dict[str, Step]:
    """What the outputs need, in an order in which each finds its inputs, by name."""
    found: dict[str, Step] = {}
    for x in sorted(b.wanted(outputs), key=lambda x: tuple(map(int, x.split("_")[1:]))):
        if x in found:
            continue
        node = b.nodes[x]
        step = Step(node.names, node.text, node.scan)
        if running := _RUNNING.fullmatch(node.text):
            step = Step(node.names, scan=Running((running[2],), (float(_KINDS[running[1]]),)), like=running[2] if running[1] != "sum" else "")
        below = [found[y] for y in (step.scan.inputs if step.scan else WORD.findall(step.text)) if y in found]
        apart = step.scan is not None or step.whole
        own = (step.scan.reach or 0, 0) if step.scan else (0, 0) if apart else _reach(step.text)
        step.depth = max((y.depth for y in below), default=0) + apart
        step.turn = 0 if apart else max((y.turn + 1 for y in below if y.depth == step.depth and not (y.scan or y.whole)), default=0)
        step.back, step.ahead = own[0] + max((y.back for y in below), default=0), own[1] + max((y.ahead for y in below), default=0)
        found |= dict.fromkeys(step.names, step)
    return found


def _inputs(table: pa.Table, names: Iterable[str]) -> list[np.ndarray]:
    return [table.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False) for x in names]


def _first(block: int, rows: int, reach: int, back: int) -> int:
    """The first row of a block at which columns that look ``back`` rows back are right, where the block brings ``reach`` rows."""
    return max(0, block * rows - reach + back)


def _outputs(table: pa.Table, step: Step, before: int, outs: Iterable[np.ndarray]) -> pa.Table:
    """The table with a recurrence's outputs, null in the rows ``before`` those it has run over."""
    for name, out in zip(step.names, outs, strict=True):
        table = table.append_column(name, pa.array(np.concatenate([np.full(before, np.nan), out]), pa.float64(), from_pandas=True))
    return table


def typed(df: DataFrame, found: list[Step]) -> DataFrame:
    """Running values with the types of what they run over."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    like = {x.names[0]: kinds[x.like] for x in found if x.like}
    return df.selectExpr(*(f"CAST({n} AS {like[n]}) AS {n}" if n in like else f"`{n}`" for n in df.columns))


def scanned(df: DataFrame, found: list[Step], starts: list[int], rows: int, reach: int) -> DataFrame:
    """``df``, blocks of rows, with the outputs of these recurrences. starts: how far the inputs of each look back."""
    scans = [x.scan for x in found]

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(ROW)
        block, at, parts = key[2].as_py(), table.column(ROW).to_numpy(), []
        for scan, back in zip(scans, starts, strict=True):
            own = slice(*np.searchsorted(at, [_first(block, rows, reach, back), _first(block + 1, rows, reach, back)]))
            parts.append([] if scan.reach is not None or own.start == own.stop else [float(v) for v in scan.summary(*(x[own] for x in _inputs(table, scan.inputs)))])
        return pa.table({**_series(key), BLOCK: pa.array([block], pa.int64()), "parts": pa.array([parts], pa.list_(pa.list_(pa.float64())))})

    def combined(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(BLOCK)
        states, out = [None] * len(scans), []
        for parts in table.column("parts").to_pylist():
            out.append([scan.packed(state) for scan, state in zip(scans, states, strict=True)])
            states = [scan.after(state, part) if part else state for scan, state, part in zip(scans, states, parts, strict=True)]
        return pa.table({**_series(key, len(out)), BLOCK: table.column(BLOCK), "states": pa.array(out, pa.list_(pa.list_(pa.float64())))})

    def finished(key: tuple, table: pa.Table, states: pa.Table) -> pa.Table:
        table = table.sort_by(ROW)
        block, at = key[2].as_py(), table.column(ROW).to_numpy()
        for step, scan, back, state in zip(found, scans, starts, states.column("states").to_pylist()[0], strict=True):
            start = 0 if scan.reach is not None else int(np.searchsorted(at, _first(block, rows, reach, back)))
            table = _outputs(table, step, start, scan.run(scan.unpacked(state), *(x[start:] for x in _inputs(table, scan.inputs)))[0])
        return table

    keys = [*KEYS, BLOCK]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    needed = dict.fromkeys([*keys, ROW, *(x for scan in scans for x in scan.inputs)])
    parts = df.select(*needed).groupBy(*keys).applyInArrow(summed, f"{head}, parts array<array<double>>")
    states = kept(parts.groupBy(*KEYS).applyInArrow(combined, f"{head}, states array<array<double>>"))
    names = [n for x in found for n in x.names]
    return typed(df.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInArrow(finished, ", ".join([*(f"`{n}` {k}" for n, k in kinds.items()), *(f"{n} double" for n in names)])), found)


def _series(key: tuple, n: int = 1) -> dict[str, pa.Array]:
    return {k: pa.array([v.as_py()] * n, v.type) for k, v in zip(KEYS, key, strict=False)}


def reaches(found: dict[str, Step], outputs: dict[str, str]) -> tuple[int, int]:
    """Rows before and after a row that the outputs need."""
    back = ahead = 0
    for text in outputs.values():
        own, below = _reach(text), [found[x] for x in WORD.findall(text) if x in found]
        back, ahead = max(back, own[0] + max((x.back for x in below), default=0)), max(ahead, own[1] + max((x.ahead for x in below), default=0))
    return back, ahead


def run(df: DataFrame, found: dict[str, Step], outputs: dict[str, str], keep: list[str], scan: Callable[[DataFrame, int, list[Step], list[int]], DataFrame], whole: Callable[[DataFrame, list[Step]], DataFrame]) -> DataFrame:
    """Depth by depth, on blocks of rows: first what needs more than the block, by ``scan`` (with the depth and how far each one's inputs look back) and ``whole``, then projections. All rows of the blocks, with ``keep`` and the outputs."""
    plan = list({id(x): x for x in found.values()}.values())
    for depth in range(1 + max((x.depth for x in plan), default=0)):
        now = [x for x in plan if x.depth == depth]
        later = " ".join([*outputs.values(), *(x.text or " ".join(x.scan.inputs) for x in plan if x.depth > depth)])
        needed = {*keep, *re.findall(r"\w+", later)}
        for_now = needed | {w for x in now for w in re.findall(r"\w+", x.text or " ".join(x.scan.inputs))}
        if any(x.scan or x.whole for x in now):
            df = kept(df.select(*(c for c in df.columns if c in for_now)))
        if scans := [x for x in now if x.scan]:
            df = scan(df, depth, scans, [max((found[y].back for y in x.scan.inputs if y in found), default=0) for x in scans])
        if wholes := [x for x in now if x.whole]:
            df = whole(df, wholes)
        for turn in range(1 + max((x.turn for x in now), default=0)):
            texts = {x.names[0]: x.text for x in now if x.turn == turn and not (x.scan or x.whole)}
            if texts:
                df = df.selectExpr("*", *(f"{_here(text)} AS {name}" for name, text in texts.items()))
        df = df.select(*(c for c in df.columns if c in needed))
    return df.selectExpr(*(f"`{c}`" for c in keep), *(f"{_here(text)} AS `{x}`" for x, text in outputs.items()))


def add_to(b: Columns, bars: DataFrame, outputs: dict[str, str], keep: Iterable[str] | None = None, rows: int = ROWS, span: str = SPAN) -> DataFrame:
    """As ``Columns.add_to``, by blocks of ``rows`` rows. Bars of a series have different times."""
    if rows < 1:
        raise ValueError("a block has a row at least")
    keep = list(dict.fromkeys([*KEYS, ORDER, *(bars.columns if keep is None else keep)]))
    found = steps(b, outputs.values())
    reach, ahead = reaches(found, outputs)
    own = f"{ROW} div {rows} = {BLOCK}"

    def scan(df: DataFrame, _: int, scans: list[Step], starts: list[int]) -> DataFrame:
        return scanned(df, scans, starts, rows, reach)

    def whole(df: DataFrame, wholes: list[Step]) -> DataFrame:
        texts = df.where(own).selectExpr(*(f"{k} AS __{k}" for k in KEYS), f"{ROW} AS __at", *(f"{x.text} AS {x.names[0]}" for x in wholes))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS]
        return df.join(texts, [*same, F.col(ROW) == F.col("__at")], "left").drop("__at", *(f"__{k}" for k in KEYS))

    copies = f"explode(sequence(greatest(0, {ROW} - {ahead}) div {rows}, ({ROW} + {reach}) div {rows}))"
    df = ranked(bars, KEYS, ORDER, ROW, span).selectExpr("*", f"{copies} AS {BLOCK}")
    return run(df, found, outputs, [*keep, ROW, BLOCK], scan, whole).where(own).drop(ROW, BLOCK)


def _here(text: str) -> str:
    return text.replace(_NUMBER, f"CAST({ROW} + 1 AS INT)").replace(s.SERIES, WITHIN)
