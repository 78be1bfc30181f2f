"""Feature plans: which indicators a wide table has, with which parameters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.recurrences import KEYS, ORDER
from barloom.operators.buckets import ranked
from barloom.operators.indicators import INDICATORS
from barloom.plans import blocks
from barloom.plans.frame import Columns

BARS = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class FeaturePlan:
    """entries: id and indicator; params: by indicator, and by id where they differ."""

    entries: tuple[tuple[str, str], ...]
    params: dict[str, dict] = field(default_factory=dict)
    timeframes: tuple[str, ...] = ()
    warmup_bars: int = 0

    def __post_init__(self):
        if unknown := [i for _, i in self.entries if i not in INDICATORS]:
            raise ValueError(f"unknown indicators: {', '.join(unknown)}")

    def params_of(self, entry: str, indicator: str):
        return INDICATORS[indicator].params(self.params.get(indicator, {}) | self.params.get(entry, {}))


def load_plan(path: str | Path) -> FeaturePlan:
    """Reads a plan: ``meta_features_plan`` (id, indicator), ``indicator_default_params``, ``timeframes``, ``phase1_window.warmup_bars``."""
    import yaml

    return plan_from(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def plan_from(config: dict) -> FeaturePlan:
    entries = tuple((str(e["id"]), str(e["indicator"])) for e in config.get("meta_features_plan") or ())
    if len({e for e, _ in entries}) < len(entries):
        raise ValueError("ids in meta_features_plan must differ")
    params = dict(config.get("indicator_default_params") or {}) | {str(e["id"]): e["params"] for e in config.get("meta_features_plan") or () if e.get("params")}
    return FeaturePlan(entries, params, tuple(config.get("timeframes") or ()), int((config.get("phase1_window") or {}).get("warmup_bars", 0)))


def single(indicator: str, **params) -> FeaturePlan:
    return FeaturePlan(((indicator, indicator),), {indicator: params})


def columns_of(plan: FeaturePlan, raw: bool = True, features: bool = True, taken: Iterable[str] = ()) -> tuple[Columns, dict[str, str]]:
    """All columns of a plan by name: raw values as <id>__<value>, features under their own names, with the id before them where ids and indicators differ."""
    b, out = Columns(), {}
    b.apart_from(taken)
    for entry, name in plan.entries:
        ind, p = INDICATORS[name], plan.params_of(entry, name)
        h = {k: b.let(v) for k, v in ind.raw(b, p).items()}
        if raw:
            out |= {f"{entry.lower()}__{k.lower()}": v for k, v in h.items()}
        if features:
            several = sum(i == name for _, i in plan.entries) > 1
            out |= {f"{entry.lower()}__{k}" if several else k: v for k, v in ind.features(b, h, p).items()}
    return b, out


def rounded(x: str, digits: int = 6) -> str:
    """For comparisons between engines; large values, which have few digits left behind the point, are rounded whole."""
    return f"CASE WHEN abs({x}) < 1e6 THEN round({x}, {digits}) ELSE round({x}, 0) END"


def feature_table(bars: DataFrame, plan: FeaturePlan, raw: bool = True, features: bool = True, keep: Iterable[str] | None = None, digits: int | None = None, block_rows: int | None = None) -> DataFrame:
    """The bars' keys, the columns in ``keep`` (None: all) and the plan's columns. Only what the plan asks for is computed.

    ``digits``: all of the plan's columns become doubles, rounded, for comparisons between engines. ``block_rows``: series are cut into blocks of so many rows
    and worked on in parallel, see ``plans.blocks``; otherwise each series is one task at a time.

    Filters on time belong after this, or on a range widened by the warm-up: windows need the rows before.
    """
    b, out = columns_of(plan, raw, features, tuple(bars.columns))
    keep = bars.columns if keep is None else list(keep)
    if plan.warmup_bars:  # counted before the plan, which then runs once
        bars, keep = ranked(bars, KEYS, ORDER, "__nth"), [*keep, "__nth"]
    for entry, name in plan.entries:
        if INDICATORS[name].tables:
            bars = INDICATORS[name].tables(bars, plan.params_of(entry, name))
    df = b.add_to(bars, out, keep) if block_rows is None else blocks.add_to(b, bars, out, keep, block_rows)
    if digits is not None:
        df = df.selectExpr(*(f"{rounded(f'CAST(`{c}` AS DOUBLE)', digits)} AS `{c}`" if c in out else f"`{c}`" for c in df.columns))
    return df.where(F.col("__nth") >= plan.warmup_bars).drop("__nth") if plan.warmup_bars else df


def without_constants(df: DataFrame, marker: str = "feat_") -> DataFrame:
    """Drops features that have no value or only one, found in one pass. The columns then depend on the data."""
    names = [c for c in df.columns if marker in c]
    if not names:
        return df
    got = df.agg(*(F.min(c).alias(f"{c}__min") for c in names), *(F.max(c).alias(f"{c}__max") for c in names)).first()
    return df.drop(*(c for c in names if got[f"{c}__min"] is None or got[f"{c}__min"] == got[f"{c}__max"]))


def feature_sql(bars: str, plan: FeaturePlan, raw: bool = True, features: bool = True, digits: int = 6) -> str:
    """The same table as one SQL query over ``bars``, for engines other than Spark. Doubles are rounded."""
    if any(INDICATORS[name].tables for _, name in plan.entries):
        raise NotImplementedError("session profiles and factors need more than one query over bars")
    b, out = columns_of(plan, raw, features)
    inner = b.sql(bars, out)
    names = ", ".join(f"{rounded(f'CAST({k} AS DOUBLE)', digits)} AS {k}" for k in out)
    return f"SELECT {', '.join([*KEYS, ORDER])}, {names} FROM ({inner}) AS t"
