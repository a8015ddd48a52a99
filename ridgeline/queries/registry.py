"""Registration of queries and what they share."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with SQL for the same rows if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, rows: dict | pd.DataFrame, digits: int = 4) -> DataFrame:
    """A small result as a DataFrame; numbers are rounded, so that sums in another order give the same rows."""
    rows = pd.DataFrame(rows)
    for c in rows.select_dtypes("float"):
        rows[c] = rows[c].round(digits) + 0.0
    return spark.createDataFrame(rows)


def regression_sql(rows: str, terms: list[str], variances: dict[str, tuple[str, str]], digits: int = 4, extra: str = "") -> str:
    """SQL of a least-squares regression of y on one or two columns x1, x2 of rows (with weight w and clusters c, c2).

    variances: output column -> (kind, factor); kinds are iid, hetero, freq (frequency weights), cluster and two_way; factors use n, g, g2, sw and rss.
    """
    two = len(terms) == 2
    solve = (
        "a22 / d AS i11, -a12 / d AS i12, a11 / d AS i22, (a22 * q1 - a12 * q2) / d AS b1, (a11 * q2 - a12 * q1) / d AS b2 FROM (SELECT *, a11 * a22 - a12 * a12 AS d FROM m)"
        if two
        else "1 / a11 AS i11, 0.0::DOUBLE AS i12, 0.0::DOUBLE AS i22, q1 / a11 AS b1, 0.0::DOUBLE AS b2 FROM m"
    )
    meat = lambda name, cols: f"{name} AS (SELECT sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22 FROM (SELECT sum(w * e * x1) AS s1, sum(w * e * x2) AS s2 FROM e GROUP BY {cols}))"
    of = lambda m, j: f"(i1{j} * i1{j} * {m}.m11 + 2 * i1{j} * i{j}2 * {m}.m12 + i{j}2 * i{j}2 * {m}.m22)" if j == 1 else f"(i12 * i12 * {m}.m11 + 2 * i12 * i22 * {m}.m12 + i22 * i22 * {m}.m22)"
    used = {kind for kind, _ in variances.values()}
    ctes = []
    if "cluster" in used or "two_way" in used:
        ctes.append(meat("k1", "c"))
    if "two_way" in used:
        ctes += [meat("k2", "c2"), meat("k12", "c, c2")]
    value = {
        "iid": lambda j: f"i{j}{j}",
        "hetero": lambda j: of("h", j),
        "freq": lambda j: of("f", j),
        "cluster": lambda j: of("k1", j),
        "two_way": lambda j: f"({of('k1', j)} + {of('k2', j)} - {of('k12', j)})",
    }
    tables = ["b", "rss", "h", "f"] + [t for t in ("k1", "k2", "k12") if any(c.startswith(t + " ") for c in ctes)]
    out = [f"SELECT '{t}' AS term, round(b{j}, {digits}) AS estimate" + "".join(f", round(sqrt({factor} * {value[kind](j)}), {digits}) AS {c}" for c, (kind, factor) in variances.items()) + extra + f" FROM {', '.join(tables)}" for j, t in enumerate(terms, 1)]
    return f"""
WITH r AS ({rows}),
m AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT c)::DOUBLE AS g, count(DISTINCT c2)::DOUBLE AS g2, sum(w)::DOUBLE AS sw, sum(w * x1 * x1) AS a11, sum(w * x1 * x2) AS a12, sum(w * x2 * x2) AS a22, sum(w * x1 * y) AS q1, sum(w * x2 * y) AS q2, sum(w * y * y) AS yy FROM r),
b AS (SELECT *, {solve}),
e AS (SELECT r.*, y - b1 * x1 - b2 * x2 AS e FROM r, b),
rss AS (SELECT sum(w * e * e) AS rss FROM e),
h AS (SELECT sum(w * w * e * e * x1 * x1) AS m11, sum(w * w * e * e * x1 * x2) AS m12, sum(w * w * e * e * x2 * x2) AS m22 FROM e),
f AS (SELECT sum(w * e * e * x1 * x1) AS m11, sum(w * e * e * x1 * x2) AS m12, sum(w * e * e * x2 * x2) AS m22 FROM e){''.join(', ' + c for c in ctes)}
{' UNION ALL '.join(out)}
"""


def within_sql(y: str, xs: list[str], group: str, source: str, c2: str = "0") -> str:
    """Rows of regression_sql with a fixed effect taken out by its means, without groups of one row."""
    cols = ", ".join(f"({x})::DOUBLE AS x{j}" for j, x in enumerate(xs, 1))
    two = len(xs) == 2
    return f"""
SELECT y - avg(y) OVER p AS y, x1 - avg(x1) OVER p AS x1, {'x2 - avg(x2) OVER p' if two else '0.0::DOUBLE'} AS x2, 1.0::DOUBLE AS w, c, c2
FROM (SELECT ({y})::DOUBLE AS y, {cols}, {group} AS c, {c2} AS c2 FROM {source} QUALIFY count(*) OVER (PARTITION BY {group}) > 1) WINDOW p AS (PARTITION BY c)"""
