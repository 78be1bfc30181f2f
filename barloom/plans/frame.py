"""Columns over ordered series, recorded as SQL text and recurrences, shared by all who ask for the same ones.

``Columns`` hands out a name for each expression. ``add_to`` adds what the wanted columns need to a table of bars,
in as few rounds as their depth allows: projections and windows of one depth together, then one pass for all
recurrences of that depth. Columns that no later step reads are dropped on the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from barloom.functions import sql as s
from barloom.functions.recurrences import KEYS, ORDER, Recurrence, Smoothed, Weighted, scan_series

WORD = re.compile(r"\bc+_\d+(?:_\d)?\b")


@dataclass
class Node:
    text: str = ""
    scan: Recurrence | None = None
    names: tuple[str, ...] = ()
    level: tuple[int, int] = (0, 0)


@dataclass
class Columns:
    nodes: dict[str, Node] = field(default_factory=dict)
    known: dict[object, tuple[str, ...]] = field(default_factory=dict)
    prefix: str = "c_"

    def apart_from(self, taken: Iterable[str]) -> None:
        """Gives the columns to come names that none of these can be."""
        while any(name.lower().startswith(self.prefix) for name in taken):
            self.prefix = f"c{self.prefix}"

    def _deps(self, node: Node) -> list[str]:
        return [x for x in (node.scan.inputs if node.scan else WORD.findall(node.text)) if x in self.nodes]

    def let(self, text: str) -> str:
        """The name of the column with this value; a name is returned as it is."""
        if re.fullmatch(r"\w+", text):
            return text
        if text not in self.known:
            node = Node(text, names=(name := f"{self.prefix}{len(self.known)}",))
            below = [self.nodes[x].level for x in self._deps(node)]
            depth = max((r for r, _ in below), default=0)
            node.level = depth, max((k + 1 for r, k in below if r == depth), default=0)
            self.nodes[name], self.known[text] = node, (name,)
        return self.known[text][0]

    def scan(self, kind: type[Recurrence], inputs: Iterable[str], *params: float) -> tuple[str, ...]:
        scan = kind(tuple(self.let(f"CAST({x} AS DOUBLE)") for x in inputs), tuple(params))
        key = (kind, scan.inputs, scan.params)
        if key not in self.known:
            names = tuple(f"{self.prefix}{len(self.known)}_{i}" for i in range(kind.outputs))
            node = Node(scan=scan, names=names, level=(max(self.nodes[x].level[0] for x in scan.inputs) + 1, 0))
            self.nodes |= dict.fromkeys(names, node)
            self.known[key] = names
        return self.known[key]

    # Values of other rows.
    def lag(self, x: str, k: int = 1) -> str:
        if k < 0:
            raise ValueError("a shift must not be negative: it would look ahead")
        return self.let(f"lag({self.let(x)}, {k}) OVER ({s.SERIES})") if k else self.let(x)

    def over(self, agg: str, x: str, n: int, least: int = 1) -> str:
        """agg over the last n rows, null until all have a value. agg has {} for the column."""
        if n < least:
            raise ValueError(f"a window of {n} rows is too short")
        return self.let(s.full(agg, self.let(x), n))

    def so_far(self, agg: str, x: str) -> str:
        return self.let(f"{agg.format(self.let(x))} {s.frame(None)}")

    def forward(self, x: str) -> str:
        """The last value that isn't null."""
        return self.let(f"last_value({self.let(x)}) IGNORE NULLS {s.frame(None)}")

    # Smoothing.
    def smoothed(self, x: str, a: float) -> str:
        return self.scan(Smoothed, [x], a)[0]

    def ewm(self, x: str, span: int, counted: bool = False) -> str:
        """The mean with weights that fall by age, for features; ``counted``: nulls make values older too."""
        if span < 1:
            raise ValueError("a span is at least 1")
        return self.scan(Weighted, [x], 2 / (span + 1), float(counted))[0]

    def wanted(self, outputs: Iterable[str]) -> set[str]:
        todo, seen = WORD.findall(" ".join(outputs)), set()
        while todo:
            if (x := todo.pop()) in self.nodes and x not in seen:
                node = self.nodes[x]
                seen |= set(node.names)
                todo += self._deps(node)
        return seen

    def rounds(self, outputs: dict[str, str]) -> list[tuple[list[dict[str, str]], dict[tuple[str, ...], Recurrence]]]:
        """Per depth: the projections one after the other, then the recurrences that lead to the next depth."""
        wanted = self.wanted(outputs.values())
        depths = 1 + max((self.nodes[x].level[0] for x in wanted), default=0)
        lets: list[dict[int, dict[str, str]]] = [{} for _ in range(depths)]
        scans: list[dict[tuple[str, ...], Recurrence]] = [{} for _ in range(depths)]
        for x in sorted(wanted, key=lambda x: int(x.split("_")[1])):
            node = self.nodes[x]
            if node.scan:
                scans[node.level[0] - 1][node.names] = node.scan
            else:
                lets[node.level[0]].setdefault(node.level[1], {})[x] = node.text
        return [([k for _, k in sorted(a.items())], b) for a, b in zip(lets, scans, strict=True)]

    def add_to(self, bars: DataFrame, outputs: dict[str, str], keep: Iterable[str] | None = None) -> DataFrame:
        """The series columns, those in ``keep`` (None: all of ``bars``) and the outputs, by name."""
        keep = [*KEYS, ORDER, *(bars.columns if keep is None else keep)]
        keep = list(dict.fromkeys(keep))
        rounds = self.rounds(outputs)
        later = [" ".join([*outputs.values(), *(t for lets, _ in rounds[i + 1 :] for step in lets for t in step.values()), *(x for _, sc in rounds[i + 1 :] for r in sc.values() for x in r.inputs)]) for i in range(len(rounds))]
        df = bars
        for (lets, scans), after in zip(rounds, later, strict=True):
            for step in lets:
                df = df.selectExpr("*", *(f"{text} AS {x}" for x, text in step.items()))
            if scans:
                inputs = {x for r in scans.values() for x in r.inputs}
                words = set(re.findall(r"\w+", after)) | inputs
                df = scan_series(df.select(*(c for c in df.columns if c in keep or c in words)), scans)
        return df.selectExpr(*(f"`{c}`" for c in keep), *(f"{text} AS `{x}`" for x, text in outputs.items()))

    def sql(self, bars: str, outputs: dict[str, str], keep: Iterable[str] = ()) -> str:
        """The same as one recursive query over ``bars``, for an engine that has no Spark."""
        parts, last = [f"s0 AS ({bars})"], "s0"
        for i, (lets, scans) in enumerate(self.rounds(outputs)):
            for j, step in enumerate(lets):
                parts.append(f"l{i}_{j} AS (SELECT *, {', '.join(f'{t} AS {x}' for x, t in step.items())} FROM {last})")
                last = f"l{i}_{j}"
            if not scans:
                continue
            states, values = {}, []
            for names, scan in scans.items():
                own, outs = scan.sql(f"z{names[0]}_")
                states |= own
                values += [f"{o} AS {n}" for n, o in zip(names, outs, strict=True)]
            on = "n.symbol = p.symbol AND n.timeframe = p.timeframe AND n.nr = p.nr + 1"
            parts.append(f"n{i} AS MATERIALIZED (SELECT *, row_number() OVER ({s.SERIES}) AS nr FROM {last})")
            parts.append(f"e{i} AS (SELECT n.symbol, n.timeframe, n.nr, {', '.join(f'CAST({a} AS DOUBLE) AS {x}' for x, (a, _) in states.items())} FROM n{i} AS n WHERE nr = 1 UNION ALL SELECT n.symbol, n.timeframe, n.nr, {', '.join(f'CAST({b} AS DOUBLE)' for _, b in states.values())} FROM e{i} AS p JOIN n{i} AS n ON {on})")
            parts.append(f"s{i + 1} AS (SELECT n.* EXCLUDE (nr), {', '.join(values)} FROM n{i} AS n JOIN e{i} AS e USING (symbol, timeframe, nr))")
            last = f"s{i + 1}"
        query = f"WITH RECURSIVE {', '.join(parts)} SELECT {', '.join([*KEYS, ORDER, *keep, *(f'{t} AS {x}' for x, t in outputs.items())])} FROM {last}"
        return re.sub(r"last_value\((\w+)\) IGNORE NULLS", r"last_value(\1 IGNORE NULLS)", query)
