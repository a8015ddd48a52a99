"""Restriction of the sample, in order: missing values, degrees and components, singletons, separation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import graph
from ridgeline.plans.cache import cut

REASONS = ("missing", "min_degree", "disconnected", "leave_one_out", "singleton", "separation")


def usable(df: DataFrame, keys: list[str], values: list[str]) -> Column:
    """Every key is there (NaN counts as missing), every value is finite."""
    tests = [graph.present(df, k) for k in keys]
    tests += [F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(F.col(v)) < float("inf")) for v in values]
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def semi(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are among those of cells."""
    return rows.join(cells.select(*keys).distinct(), keys, "left_semi")


def drop_singletons(cells: DataFrame, dims: list[str]) -> DataFrame:
    """Cells (dims, n) without levels of one row, of any dimension, until none is left. A round looks at all dimensions in one job."""
    while True:
        lone = {d: cells.groupBy(F.col(d).alias("lone")).agg(F.sum("n").alias("r")).filter("r = 1").select("lone") for d in dims}
        found = reduce(DataFrame.unionAll, [t.groupBy(F.lit(d).alias("d")).agg(F.count("*").alias("c")) for d, t in lone.items()]).collect()
        if not found:
            return cells
        for d in {r["d"] for r in found}:
            cells = cells.join(lone[d].select(F.col("lone").alias(d)), d, "left_anti")
        cells = cut(cells)
        if len(dims) == 1:
            return cells


def separated(rows: DataFrame, dims: list[str], y: str, family: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows without levels that fit perfectly: all zero (Poisson, one sweep), all alike (binary, until none is left); and the cells that went."""
    gone = None
    while True:
        changed = False
        for d in dims:
            flat = F.col("hi") == 0 if family == "poisson" else F.col("lo") == F.col("hi")
            bad = cut(rows.groupBy(d).agg(F.min(y).alias("lo"), F.max(y).alias("hi")).filter(flat).select(d))
            if bad.limit(1).count():
                part = rows.join(bad, d, "left_semi").select(*dims, F.lit("separation").alias("gone")).distinct()
                gone = part if gone is None else gone.union(part)
                rows, changed = cut(rows.join(bad, d, "left_anti")), True
        if family == "poisson" or not changed:
            return rows, gone


def restrict(rows: DataFrame, dims: list[str], connected: str | None = None, connected_fe: tuple[int, int] = (0, 1), min_degree: tuple[int, int] | None = None, fixef_rm: str = "singleton", n: int | None = None) -> tuple[DataFrame, dict[str, int], DataFrame | None]:
    """The rows that stay, how many went for each reason, and the cells that went (dims, gone). Works on cells of levels, not on rows; rows follow by a semi-join. n: the number of rows, if known."""
    if not dims or (fixef_rm != "singleton" and not connected and not min_degree):
        return rows, {}, None
    cells = cut(rows.groupBy(*dims).agg(F.count("*").alias("n")))
    size = lambda c: c.agg(F.sum("n")).first()[0] or 0
    lost, now, gone, before = {}, size(cells) if n is None else n, None, cells
    whole = now

    def note(reason: str) -> None:
        nonlocal now, gone, before
        if cells is before:
            lost[reason] = 0
            return
        lost[reason], now = now - (new := size(cells)), new
        if lost[reason]:
            part = before.join(cells, dims, "left_anti").select(*dims, F.lit(reason).alias("gone"))
            gone = part if gone is None else gone.union(part)
        before = cells

    if len(dims) > 1 and (connected or min_degree):
        a, b = (dims[i] for i in connected_fe)
        pair = lambda: cells.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sum("n").alias("n"))
        keep = lambda p: cut(cells.join(p.select(F.col("a").alias(a), F.col("b").alias(b)), [a, b], "left_semi"))
        if min_degree and max(min_degree) > 1:
            cells = keep(graph.peel(cut(pair()), tuple(min_degree)))
            note("min_degree")
        if connected == "leave_one_out":
            cells = keep(graph.leave_one_out_pairs(cut(pair())))
            note("leave_one_out")
        elif connected:
            cells = keep(graph.largest_component(cut(pair())))
            note("disconnected")
    if fixef_rm == "singleton":
        cells = drop_singletons(cells, dims)
        note("singleton")
    return (rows if now == whole else semi(rows, cells, dims)), lost, gone
