"""The whole feature panel: a registry of groups, the panel they make, and slices of it.

A symbol group takes bars and gives them back with columns of its own; a panel
group takes the panel and the other tables.  Groups name the tables they need; a
group whose tables are not there is left out, and so is a user's group that
can't be planned, with a warning.  All symbol groups share one partitioning by
symbol.  Panel groups that say which columns they read work on rows of those
alone, beside the bars, one group after the other.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import asof, pit
from ..operators.shared import parts_of, written
from . import features, panel_features, series

KEY = ["symbol", "bar_date"]
Tables = Mapping[str, DataFrame]


class Group(NamedTuple):
    kind: str
    name: str
    compute: Callable[[DataFrame, Tables], DataFrame]
    needs: tuple[str, ...] = ()
    reads: tuple[str, ...] | None = None
    strict: bool = False
    before: Callable[[DataFrame], DataFrame] | None = None
    by: str | None = None
    form: str = "rows"


@dataclass
class Registry:
    """Groups by kind (``symbol`` or ``panel``) and name, in the order they were first registered."""

    groups: dict[tuple[str, str], Group] = field(default_factory=dict)

    def register(
        self, kind: str, name: str, compute: Callable[[DataFrame, Tables], DataFrame], needs: tuple[str, ...] = (), *, reads: tuple[str, ...] | None = None, strict: bool = False,
        before: Callable[[DataFrame], DataFrame] | None = None, by: str | None = None, form: str = "rows",
    ) -> None:
        """Add a group; one of the same kind and name is replaced in its place.

        ``reads`` are the columns, beside those of the bars, that a panel group
        works on; without it the group gets the whole panel.  An error of a
        ``strict`` group is an error of the panel.

        A symbol group with ``before``, its windows over the bars alone, goes
        row by row otherwise.  ``by`` is the column that rows of a panel group
        that reads named columns are dealt out by, and stay so.  Its ``form`` is
        ``rows``, the panel with more columns; ``dates``, a table with one row a
        date to be broadcast; or ``row``, more columns of each row from that row alone.
        """
        if kind not in ("symbol", "panel"):
            raise ValueError("a group is of kind symbol or panel")
        if form not in ("rows", "dates", "row"):
            raise ValueError("a group's form is rows, dates or row")
        self.groups[kind, name] = Group(kind, name, compute, tuple(needs), None if reads is None else tuple(reads), strict, before, by, form)

    def remove(self, kind: str, name: str) -> None:
        self.groups.pop((kind, name), None)

    def names(self) -> list[tuple[str, str]]:
        return list(self.groups)

    def active(self, kind: str, tables: Tables) -> list[Group]:
        """Groups of a kind whose tables are all there."""
        return [g for g in self.groups.values() if g.kind == kind and all(t in tables for t in g.needs)]


def pandas_group(by_symbol: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> Callable[[DataFrame, Tables], DataFrame]:
    """A symbol group from a user's pandas function of one symbol's bars in order of date, which adds ``columns`` (doubles)."""
    def compute(bars: DataFrame, _: Tables) -> DataFrame:
        given = bars.drop(*columns)
        schema = T.StructType([*given.schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns)])
        names = schema.names
        out = given.groupBy("symbol").applyInPandas(lambda pdf: by_symbol(pdf.sort_values("bar_date").reset_index(drop=True))[names], schema)
        return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})

    return compute


def date_group(by_date: Callable[[pa.Table], dict], columns: dict[str, str]) -> Callable[[DataFrame, Tables], DataFrame]:
    """A panel group from a user's function of one date's rows, an Arrow table in order of symbol.

    It gives an array for each of ``columns`` (name -> SQL type), as long as the
    table.  Dates run in tasks of their own; each has at most a row a symbol.
    Other columns, and null dates, pass through as they are.
    """
    def compute(panel: DataFrame, _: Tables) -> DataFrame:
        given = panel.drop(*columns)
        schema = T.StructType([*given.schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items())).fields])
        names = list(columns)

        def one(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("symbol")
            made = by_date(rows)
            for n in names:
                x = made[n]
                rows = rows.append_column(n, x if isinstance(x, pa.Array | pa.ChunkedArray) else pa.array(x))
            return rows

        return given.groupBy("bar_date").applyInArrow(one, schema)

    return compute


def _funds(tables: Tables) -> DataFrame:
    """The bars of the benchmarks that symbols have."""
    named = tables["benchmarks"].select(F.col("benchmark").alias("symbol")).distinct()
    return tables["benchmark_bars"].join(named, "symbol", "left_semi")


#: Tables of the library's groups that are dealt out by symbol as the panel is.
BY_SYMBOL = ("sectors", "benchmarks", "announcements", "filings", "fundamentals")


def default_registry() -> Registry:
    """All groups of this library.

    Tables of panel groups: ``macro`` (macro_date, series, value), ``sectors``
    (symbol, sector), ``benchmarks`` (symbol, benchmark) with the bars of the
    benchmarks as ``benchmark_bars``, ``announcements``, ``filings``, ``fundamentals``.
    """
    reg, p = Registry(), panel_features
    for name in features.GROUPS:
        by_row, windows = features.BY_ROW.get(name, lambda b: b), features.WINDOWS.get(name, lambda b: b)
        reg.register("symbol", name, lambda b, _, by_row=by_row: by_row(b), strict=True, before=windows)

    def panel(name, compute, needs=(), reads=(), **more):
        reg.register("panel", name, compute, needs, reads=reads, strict=True, **more)

    # what ranks within dates read first, then those, then what stays with its symbol
    panel("sec_fundamentals_v2", lambda x, t: asof.fundamentals_ttm(x, t["fundamentals"]), ("fundamentals",), by="symbol")
    panel("cross_sectional", lambda x, _: p.cross_sectional(x), reads=tuple(p.RANKED.values()), by="bar_date")
    panel("sec_fundamentals_v2_ranks", lambda x, _: asof.fundamentals_ranks(x), ("fundamentals",), tuple(asof.TTM), by="bar_date")
    panel("sector_residual", lambda x, t: p.sector_residual(x, t["benchmarks"], p.etf_features(_funds(t))), ("benchmarks", "benchmark_bars"), tuple(p.RESIDUALS.values()), by="symbol")
    panel("earnings", lambda x, t: asof.earnings_features(x, t["announcements"]), ("announcements",), by="symbol")
    panel("sec_events", lambda x, t: asof.filing_features(x, t["filings"]), ("filings",), by="symbol")
    panel("sec_fundamentals", lambda x, t: asof.fundamentals_annual(x, t["fundamentals"]), ("fundamentals",), by="symbol")
    panel("sector", lambda x, t: p.sector_flags(x, t["sectors"]), ("sectors",), by="symbol")
    panel("regime", lambda x, _: p.regime_by_date(x), reads=("price__log_return_1d", "price__log_return_20d"), form="dates")
    panel("macro", lambda x, t: p.macro_features(t["macro"], p.SERIES), ("macro",), form="dates")
    panel("interactions", lambda x, _: p.interactions(x), reads=tuple(c for pair in p.PAIRS.values() for c in pair), form="row")
    return reg


def feature_columns(panel: DataFrame) -> list[str]:
    """Columns named ``group__feature``."""
    return [c for c in panel.columns if "__" in c]


def _with_group(rows: DataFrame, group: Group, tables: Tables) -> DataFrame:
    try:
        made = group.compute(rows, tables)
        return rows.join(F.broadcast(made), "bar_date", "left") if group.form == "dates" else made  # a row a date: bounded by the calendar
    except Exception as error:  # the panel comes out whatever a user's group does
        if group.strict:
            raise
        warnings.warn(f"group {group.kind}/{group.name} left out: {error}", stacklevel=3)
        return rows


def _with_groups(rows: DataFrame, groups: list[Group], tables: Tables) -> DataFrame:
    for group in groups:
        rows = _with_group(rows, group, tables)
    return rows


Pass = Callable[[DataFrame, list[str]], DataFrame]
PACKED = "_of_"


def _packed(rows: DataFrame, columns: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``columns`` in one struct, which the windows to come copy as a whole."""
    rest = [c for c in rows.columns if c not in columns and c not in drop]
    name = f"{PACKED}{sum(c.startswith(PACKED) for c in rest)}"
    return rows.select(*rest, *([F.struct(*columns).alias(name)] if columns else []))


def _unpacked(rows: DataFrame) -> DataFrame:
    packed = {f.name: f.dataType.names for f in rows.schema if f.name.startswith(PACKED)}
    return rows.select(*[c for c in rows.columns if c not in packed], *[F.col(f"{p}.`{c}`") for p, names in packed.items() for c in names])


def _of_symbols(rows: DataFrame, groups: list[Group], tables: Tables, passing: Pass, only: set[str] | None = None) -> DataFrame:
    """``rows``, bars dealt out by symbol, with the columns of symbol groups that have ``before``, or with those of ``only``.

    All windows come first, where the rows lie; then the pass, from which on
    everything goes row by row.  For a few columns the pass makes no others.
    """
    kept, made = rows.columns, set(feature_columns(_unpacked(rows)))
    wanted = [g for g in groups if only is None or any(c.split("__")[0] == g.name for c in only)]
    for g in wanted:
        had, rows = rows.columns, g.before(rows)
        rows = rows if only is not None else _packed(rows, [c for c in rows.columns if c not in had])
    late = None if only is None else [c for c in only if c not in rows.columns]
    wanted = [g for g in wanted if late is None or any(c.split("__")[0] == g.name for c in late)]
    want = features.passed([g.name for g in wanted])
    if only is not None:
        names = {n for g in wanted for c in late if c.split("__")[0] == g.name for n in features.ALONE.get(c, features.NEEDS.get(g.name, []))}
        rows = rows.select(*[c for c in rows.columns if c in kept or c in only or "__" not in c])
        rows = passing(rows, sorted(names)) if names else rows
        rows = rows.withColumns({n: F.lit(None).cast("double") for n in want if n not in names})
    else:
        rows = _unpacked(rows) if passing is series.sequential else rows
        rows = _unpacked(passing(rows, want) if want else rows)
        kept = [c for c in kept if c in rows.columns] + [c for c in rows.columns if c in made]
    rows = _with_groups(rows, wanted, tables)
    return rows.select(*kept, *[c for c in feature_columns(rows) if c not in kept and (only is None or c in only)])


def _along(rows: DataFrame, dealt: str | None, groups: list[Group], tables: Tables, parts: int, bars: list[str], given: set[str], still: set[str] = frozenset()) -> tuple[DataFrame, str | None]:
    """``rows`` with the columns of panel groups, and what they are dealt out by.

    They are exchanged only where a group wants them dealt out by another column
    than the one before it.  What no later group reads (``still``: those after
    these) is packed, or left out if it is one of the columns ``given`` to read.
    """
    for i, g in enumerate(groups):
        if g.by is not None and g.by != dealt:
            rows = rows.repartition(parts, g.by)
        rows, dealt = _with_group(rows, g, tables), g.by
        later = still.union(*(x.reads for x in groups[i + 1 :]))
        done = [c for c in feature_columns(rows) if c not in bars and c not in later]
        rows = _packed(rows, [c for c in done if c not in given], tuple(c for c in done if c in given))
    return rows, dealt


def _made_before(groups: list[Group]) -> list[Group]:
    """The groups that make rows, and of the other forms those whose columns they read."""
    early = [g for g in groups if g.form == "rows"]
    while True:
        read = {c.split("__")[0] for g in early for c in g.reads}
        more = [g for g in groups if g in early or g.name in read]
        if more == early:
            return early
        early = more


def build_panel(bars: DataFrame, tables: Tables | None = None, *, registry: Registry | None = None, membership: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """``bars`` (one row per symbol and date) with the features of all active groups, null outside membership if it is given.

    Panel groups that name the columns they read come first, in order of
    registration, on rows of the bars and those columns, of the panel and of
    groups before; the others are packed.  These rows, never the panel, are exchanged: by
    symbol, by date for ranks within dates, and by symbol again.  Where they
    lie then the windows of all symbol groups are added, the ordered pass takes
    each symbol as it is, and the rest goes row by row: symbol groups, tables by
    date, and groups of the form ``row``.  ``cut`` (writing a table and
    reading it back) comes after the bars alone.  A series longer than a block
    of the pass is split, for which all rows with their windows are written.

    With a user's symbol groups the panel of those is cut instead, and what
    panel groups make is joined to it.  Rows without symbol or date get nothing
    from panel groups of named columns.  Other panel groups use the panel more
    than once: there is a ``cut`` before them.
    """
    tables, registry = tables or {}, registry or default_registry()
    of_symbols, of_panel = registry.active("symbol", tables), registry.active("panel", tables)
    narrow, rest = [g for g in of_panel if g.reads is not None], [g for g in of_panel if g.reads is None]
    own = bool(narrow) and all(g.before is not None for g in of_symbols)
    inside = own and membership is not None and not rest
    if own:
        out = cut(bars)
    else:
        of_symbols = [g if g.before is None else g._replace(compute=lambda b, t, g=g: g.compute(g.before(b), t)) for g in of_symbols]
        out = _with_groups(features.prepared(bars, {g.name for g in of_symbols}), of_symbols, tables)
        out = out.select(*bars.columns, *feature_columns(out))
        out = cut(out) if of_panel else out
    if narrow:
        # rows get wide where they lie: half as many a task as elsewhere
        base, parts, theirs = out, parts_of(out, 100_000), set() if own else set(feature_columns(out))
        passing = series.sequential if own and series.longest(out) > series.SIZE else series.in_place
        dealt = {n: t.repartition(parts, "symbol") if n in BY_SYMBOL else t for n, t in tables.items()}
        early = _made_before(narrow)
        late = [g for g in narrow if g not in early]
        reads = {c for g in early for c in g.reads}

        def reading(rows: DataFrame, columns: set[str]) -> DataFrame:
            return _of_symbols(rows, of_symbols, dealt, passing, columns) if own else rows.select(*bars.columns, *[c for c in feature_columns(base) if c in columns])

        def by_date(g: Group) -> Group:
            return g if g.form != "dates" else g._replace(compute=lambda _, t: g.compute(reading(base.repartition(parts, "symbol"), set(g.reads)), t))

        # groups that read nothing but bars, if they are first, go before the pass
        first = next((i for i, g in enumerate(early) if g.reads), len(early))
        rows, at = base.repartition(parts, "symbol"), "symbol"
        if own:
            rows, at = _along(rows, at, early[:first], dealt, parts, bars.columns, set(), reads)
            early = early[first:]
            want = reads - set(rows.columns)
            read, at = (reading(rows, want), None) if want else (rows, at)
            given = set(read.columns) - set(rows.columns)
        else:
            read = reading(rows, reads)
            given = set(read.columns)
        rows, at = _along(read, at, [by_date(g) for g in early], dealt, parts, bars.columns, given)
        if own:
            rows = rows if at == "symbol" else rows.repartition(parts, "symbol")
            rows = pit.flag_members(rows, membership.repartition(parts, "symbol"), "_in") if inside else rows
            made = set(_unpacked(rows).columns)
            out = _of_symbols(rows, of_symbols, tables, passing)
            theirs = set(feature_columns(out)) - made
        else:
            out = out.join(_unpacked(rows).drop(*[c for c in bars.columns if c not in KEY]), KEY, "left")
        out = _with_groups(out, [by_date(g) for g in late], dealt)
        keyed = F.col("symbol").isNotNull() & F.col("bar_date").isNotNull()
        out = out.withColumns({c: F.when(keyed, F.col(c)) for c in feature_columns(out) if c not in theirs})
        if rest:
            out = cut(out)
    out = _with_groups(out, rest, tables)
    found = feature_columns(out)
    if membership is None:
        return out.select(*bars.columns, *found)
    if not inside:
        return pit.mask_non_members(out.select(*bars.columns, *found), membership, found)
    return out.select(*bars.columns, *[F.when(F.col("_in"), F.col(c)).alias(c) for c in found])


def inference_slice(panel: DataFrame, membership: DataFrame, universe: str, as_of, columns: list[str]) -> DataFrame:
    """The rows of one date's members, with ``columns`` in the model's order; a column the panel has not is null."""
    members = pit.members_on(membership, universe, as_of).select("symbol").distinct()
    rows = panel.filter(F.col("bar_date") == F.lit(as_of).cast("date")).join(members, "symbol", "left_semi")
    have = set(panel.columns)
    return rows.select(*KEY, *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in columns])


def batch_slice(panel: DataFrame, membership: DataFrame, days: DataFrame, columns: list[str]) -> DataFrame:
    """The same for all dates of ``days`` (bar_date) from one panel: members of any universe on each date."""
    rows = panel.join(days.select("bar_date").distinct(), "bar_date", "left_semi")
    return pit.flag_members(rows, membership).filter("in_universe").select(*KEY, *columns)
