"""Absorption of fixed effects: one dimension by group means (or group regressions on slopes), the others by a reduced system.

The largest dimension g is taken out of each variable by grouped sums. The others' levels then solve S G = D'W M V, where M takes out g.
S is never built: S P = D'W M D P is worked out from the cells of levels (their sums of weights), for a block of vectors at a time, by
conjugate gradients with S's diagonal. Cells come to the driver while they are few; beyond that they stay a table, and each product is a
job over it. Vectors have an entry for each level of the smaller dimensions and live on the driver; their size is checked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.plans.cache import cut, discard

MOST_LEVELS, MOST_CELLS = 5_000_000, 3_000_000
FEW_GROUPS = 10_000  # groups up to which their means go to all tasks, so that rows stay where they are
FEW_LEVELS = 200  # levels up to which S is multiplied out over a table of cells, once for all right-hand sides


def collected(df: DataFrame) -> pd.DataFrame:
    """A small table on the driver, by Arrow whatever the session's settings."""
    return df.toArrow().to_pandas()


def uploaded(spark, columns: dict[str, np.ndarray]) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.table({c: pa.array(np.ascontiguousarray(v)) for c, v in columns.items()}))


@dataclass
class Effects:
    """Level effects of the dimensions that were solved for: dim -> (levels, array of levels by variables)."""

    variables: list[str]
    tables: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    iterations: int = 0


def conjugate_gradients(product, diagonal: np.ndarray, b: np.ndarray, tol: float = 1e-10, most: int = 5000) -> tuple[np.ndarray, int]:
    """Solves S x = b for each column, by products S p and the diagonal as preconditioner."""
    inv = np.where(diagonal > 1e-12 * max(diagonal.max(initial=0), 1e-300), 1 / np.where(diagonal == 0, 1, diagonal), 0)[:, None]
    x, r = np.zeros_like(b), b.copy()
    norm = np.linalg.norm(b, axis=0)
    z = inv * r
    p, rz, it = z.copy(), (r * z).sum(axis=0), 0
    while it < most and (np.linalg.norm(r, axis=0) > tol * np.maximum(norm, 1e-300)).any():
        q = product(p)
        pq = (p * q).sum(axis=0)
        a = np.where(pq > 0, rz / np.where(pq > 0, pq, 1), 0)
        x += a * p
        r -= a * q
        z = inv * r
        new = (r * z).sum(axis=0)
        p = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0) * p
        rz, it = new, it + 1
    return x, it


class Cells:
    """Cells of levels in arrays. g: codes of the group; codes: for each other dimension, positions among all n levels of these dimensions; sums[q]: of the
    weights (q = 0) and of weights times the basis; norms[q]: per group, of the weights and of weights times the basis squared."""

    def __init__(self, g: np.ndarray, codes: list[np.ndarray], n: int, sums: list[np.ndarray], norms: list[np.ndarray]):
        self.g, self.codes, self.n, self.sums, self.norms = g, codes, n, sums, norms
        self.groups = len(norms[0])

    def by_level(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for c in self.codes:
            out += np.bincount(c, v, self.n)
        return out

    def without_groups(self, moments: list[np.ndarray]) -> np.ndarray:
        """D'W M v of a variable with sums moments[q] over each cell: of w v, and of w basis v."""
        left = moments[0].copy()
        for own, norm, m in zip(self.sums, self.norms, moments, strict=True):
            total = np.bincount(self.g, m, self.groups)
            left -= own * np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)[self.g]
        return self.by_level(left)

    def product(self, p: np.ndarray) -> np.ndarray:
        out = np.empty_like(p)
        for j in range(p.shape[1]):
            v = sum(p[c, j] for c in self.codes)
            out[:, j] = self.without_groups([s * v for s in self.sums])
        return out

    def diagonal(self) -> np.ndarray:
        out = self.by_level(self.sums[0])
        for c in self.codes:
            pair, at = np.unique(self.g * np.int64(self.n) + c, return_inverse=True)
            g, i = pair // self.n, pair % self.n
            for s, norm in zip(self.sums, self.norms, strict=True):
                u = np.bincount(at, s, len(pair))
                out -= np.bincount(i, np.divide(u * u, norm[g], out=np.zeros(len(g)), where=norm[g] > 0), self.n)
        return out


class CellTable:
    """The same over a table of cells (g, i0.., n0.., tot0..), for more cells than the driver takes: each product is a job, which gets the vectors as a table."""

    def __init__(self, cells: DataFrame, dims: int, q: int, n: int):
        self.cells, self.dims, self.q, self.n = cells, dims, q, n

    def without_groups(self, rows: DataFrame, moments: list[list]) -> np.ndarray:
        """moments[q][j]: the sums of variable j as columns of rows."""
        k = len(moments[0])
        means = rows.groupBy(F.col("g").alias("__g")).agg(*[F.sum(moments[q][j]).alias(f"t{q}_{j}") for q in range(self.q) for j in range(k)])
        left = lambda j: moments[0][j] - sum((F.when(F.col(f"tot{q}") > 0, F.col(f"n{q}") * F.col(f"t{q}_{j}") / F.col(f"tot{q}")).otherwise(0.0) for q in range(self.q)), F.lit(0.0))
        own = rows.join(means, F.col("g") == F.col("__g")).select(F.explode(F.array(*[f"i{d}" for d in range(self.dims)])).alias("i"), *[left(j).alias(f"x{j}") for j in range(k)])
        t = collected(own.groupBy("i").agg(*[F.sum(f"x{j}").alias(f"x{j}") for j in range(k)]))
        out = np.zeros((self.n, k))
        out[t["i"].to_numpy()] = t[[f"x{j}" for j in range(k)]].to_numpy()
        return out

    def product(self, p: np.ndarray) -> np.ndarray:
        k, rows = p.shape[1], self.cells
        table = uploaded(self.cells.sparkSession, {"__i": np.arange(self.n)} | {f"p{j}": p[:, j] for j in range(k)})
        for d in range(self.dims):
            t = table.select("__i", *[F.col(f"p{j}").alias(f"p{d}_{j}") for j in range(k)])
            rows = rows.join(t, F.col(f"i{d}") == F.col("__i")).drop("__i")
        v = [sum((F.col(f"p{d}_{j}") for d in range(1, self.dims)), F.col(f"p0_{j}")) for j in range(k)]
        return self.without_groups(rows, [[F.col(f"n{q}") * x for x in v] for q in range(self.q)])

    def diagonal(self) -> np.ndarray:
        pairs = self.cells.select("g", F.explode(F.array(*[f"i{d}" for d in range(self.dims)])).alias("i"), *[f"{x}{q}" for q in range(self.q) for x in ("n", "tot")])
        u = pairs.groupBy("g", "i").agg(*[F.sum(f"n{q}").alias(f"n{q}") for q in range(self.q)], *[F.first(f"tot{q}").alias(f"tot{q}") for q in range(self.q)])
        own = F.col("n0") - sum((F.when(F.col(f"tot{q}") > 0, F.col(f"n{q}") ** 2 / F.col(f"tot{q}")).otherwise(0.0) for q in range(self.q)), F.lit(0.0))
        t = collected(u.groupBy("i").agg(F.sum(own).alias("x")))
        out = np.zeros(self.n)
        out[t["i"].to_numpy()] = t["x"].to_numpy()
        return out


class Absorber:
    """rows: a DataFrame with the level columns dims; w: weight column or None; slopes: columns that vary by level of dims[0]."""

    def __init__(self, rows: DataFrame, dims: list[str], w: str | None = None, slopes: tuple[str, ...] = (), most_cells: int | None = None):
        self.dims, self.w, self.slopes, self.most_cells = dims, w, tuple(slopes), MOST_CELLS if most_cells is None else most_cells
        self.weight = F.col(w) if w else F.lit(1.0)
        self.rows, self.basis, self.few = rows, [], None
        if dims and slopes:
            self.orthogonalise()

    def orthogonalise(self) -> None:
        """Slope variables free of the group's mean and of each other, one by one; a spread of rounding size counts as none."""
        g = self.dims[0]
        rows = self.rows
        for j, t in enumerate(self.slopes):
            name = f"__t{j}"
            x, raw = self.within(rows.withColumn(name, F.col(t)), [name], self.basis), F.sum(self.weight * F.col(t) ** 2)
            norm = x.groupBy(g).agg(F.sum(self.weight * F.col(name) ** 2).alias("__n"), raw.alias("__r"))
            norm = norm.select(F.col(g).alias("__g"), (F.col("__n") > 1e-12 * F.greatest(F.col("__r"), F.lit(1e-300))).alias("__ok"))
            rows = x.join(norm, F.col(g) == F.col("__g")).withColumn(name, F.when(F.col("__ok"), F.col(name)).otherwise(0.0)).drop("__g", "__ok")
            rows = cut(rows)
            self.basis = [*self.basis, name]
        self.rows = rows

    def within(self, rows: DataFrame, names: list[str], basis: list[str] | None = None) -> DataFrame:
        """Columns names less their regression on the group and on the basis; partial sums first, so a large group is no burden."""
        basis = self.basis if basis is None else basis
        if not self.dims or not names:
            return rows
        g, w = self.dims[0], self.weight
        sums = [F.sum(w).alias("__w")] + [F.sum(w * F.col(b) ** 2).alias(f"__q{j}") for j, b in enumerate(basis)]
        sums += [F.sum(w * F.col(v)).alias(f"__m{i}") for i, v in enumerate(names)]
        sums += [F.sum(w * F.col(b) * F.col(v)).alias(f"__c{j}_{i}") for j, b in enumerate(basis) for i, v in enumerate(names)]
        means = rows.groupBy(F.col(g).alias("__g")).agg(*sums)
        if self.few_groups():
            means = F.broadcast(means)  # else rows are dealt by a few groups, each to one task
        fit = lambda i: sum((F.when(F.col(f"__q{j}") > 0, F.col(f"__c{j}_{i}") / F.col(f"__q{j}")).otherwise(0.0) * F.col(b) for j, b in enumerate(basis)), F.col(f"__m{i}") / F.col("__w"))
        out = rows.join(means, F.col(g) == F.col("__g"))
        return out.select(*[c for c in rows.columns if c not in names], *[(F.col(v) - fit(i)).alias(v) for i, v in enumerate(names)])

    def few_groups(self) -> bool:
        if self.few is None:
            self.few = self.rows.agg(F.approx_count_distinct(self.dims[0])).first()[0] <= FEW_GROUPS
        return self.few

    def index(self, rows: DataFrame) -> dict[str, np.ndarray]:
        """Sorted levels of each dimension that is solved for."""
        out = {}
        for d in self.dims[1:]:
            levels = collected(rows.select(d).distinct().limit(MOST_LEVELS + 1))[d].to_numpy()
            if len(levels) > MOST_LEVELS:
                raise ValueError(f"{d} has more than {MOST_LEVELS} levels: only the largest dimension may")
            out[d] = np.sort(levels)
        return out

    def moments(self, names: list[str]) -> list:
        """Sums over cells that the right-hand sides of variables are made of: s<q>_<j>."""
        b = [F.lit(1.0), *[F.col(x) for x in self.basis]]
        return [F.sum(self.weight * x * F.col(v)).alias(f"s{q}_{j}") for q, x in enumerate(b) for j, v in enumerate(names)]

    def cells_of(self, rows: DataFrame, names: list[str]) -> DataFrame:
        q = [F.sum(self.weight).alias("n0"), *[F.sum(self.weight * F.col(b)).alias(f"n{j + 1}") for j, b in enumerate(self.basis)]]
        return rows.groupBy(*self.dims).agg(*q, *self.moments(names))

    def system(self, names: list[str]) -> np.ndarray | None:
        """Sets up products with S; the right-hand sides of the variables, if cells came to the driver (for which one pass over the rows does)."""
        rows, g, k = self.rows, self.dims[0], len(self.basis) + 1
        cells = cut(self.cells_of(rows, names))
        local = cells.count() <= self.most_cells
        few = collected(cells) if local else None
        if local:
            self.levels = {d: np.unique(few[d].to_numpy()) for d in self.dims[1:]}
            if any(len(v) > MOST_LEVELS for v in self.levels.values()):
                raise ValueError(f"more than {MOST_LEVELS} levels: only the largest dimension may")
        else:
            self.levels = self.index(cells)
        self.offset, self.n = {}, 0
        for d, levels in self.levels.items():
            self.offset[d] = self.n
            self.n += len(levels)
        norms = lambda: rows.groupBy(F.col(g).alias("__g")).agg(*[F.sum(self.weight * F.col(b) ** 2).alias(f"tot{j + 1}") for j, b in enumerate(self.basis)])
        if local:
            groups, code = np.unique(few[g].to_numpy(), return_inverse=True)
            total = [np.bincount(code, few["n0"], len(groups))]
            if self.basis:
                t = collected(norms()).sort_values("__g")
                total += [t[f"tot{j}"].to_numpy() for j in range(1, k)]
            codes = [self.offset[d] + np.searchsorted(levels, few[d].to_numpy()) for d, levels in self.levels.items()]
            self.local = len(few)
            self.s = Cells(code, codes, self.n, [few[f"n{q}"].to_numpy() for q in range(k)], total)
            out = np.stack([self.s.without_groups([few[f"s{q}_{j}"].to_numpy() for q in range(k)]) for j in range(len(names))], axis=1) if names else None
            discard(cells)
        else:
            coded, spark = cells, rows.sparkSession
            for i, (d, levels) in enumerate(self.levels.items()):
                t = uploaded(spark, {"__l": levels, f"i{i}": np.arange(self.offset[d], self.offset[d] + len(levels))})
                coded = coded.join(t, F.col(d) == F.col("__l")).drop("__l")
            tot = coded.groupBy(F.col(g).alias("__g")).agg(F.sum("n0").alias("tot0"))
            tot = tot.join(norms(), "__g") if self.basis else tot
            self.local = 0
            self.s = CellTable(cut(coded.withColumnRenamed(g, "g").join(tot, F.col("g") == F.col("__g")).drop("__g", *self.dims[1:])), len(self.levels), k, self.n)
            out = self.s.without_groups(self.s.cells, [[F.col(f"s{q}_{j}") for j in range(len(names))] for q in range(k)]) if names else None
        self.diagonal = self.s.diagonal()
        self.product = self.s.product
        if not local and self.n <= FEW_LEVELS:
            dense = np.concatenate([self.s.product(np.eye(self.n)[:, j : j + 50]) for j in range(0, self.n, 50)], axis=1)
            self.product = lambda p: dense @ p
        return out

    def right_side(self, rows: DataFrame, names: list[str]) -> np.ndarray:
        """D'W M V: sums by level of each solved dimension of the variables less their groups."""
        if isinstance(self.s, CellTable) or self.local * len(names) > 8 * self.most_cells:  # the sums of all columns over cells would be too many for the driver
            m = cut(self.within(rows.select(*dict.fromkeys([*self.dims, *([self.w] if self.w else []), *self.basis, *names])), names))
            out = np.zeros((self.n, len(names)))
            for d, levels in self.levels.items():
                t = collected(m.groupBy(d).agg(*[F.sum(self.weight * F.col(v)).alias(f"s{i}") for i, v in enumerate(names)]))
                out[self.offset[d] + np.searchsorted(levels, t[d].to_numpy())] = t[[f"s{i}" for i in range(len(names))]].to_numpy()
            discard(m)
            return out
        few, k = collected(self.cells_of(rows, names)), len(self.basis) + 1
        groups, code = np.unique(few[self.dims[0]].to_numpy(), return_inverse=True)
        if len(groups) != self.s.groups:
            raise ValueError("the rows have other groups than the fit")
        codes = [self.offset[d] + np.searchsorted(levels, few[d].to_numpy()) for d, levels in self.levels.items()]
        own = Cells(code, codes, self.n, [few[f"n{q}"].to_numpy() for q in range(k)], self.s.norms)
        return np.stack([own.without_groups([few[f"s{q}_{j}"].to_numpy() for q in range(k)]) for j in range(len(names))], axis=1)

    def solve(self, b: np.ndarray, tol: float = 1e-10) -> tuple[np.ndarray, int]:
        return conjugate_gradients(self.product, self.diagonal, b, tol)

    def residualise(self, rows: DataFrame, names: list[str], tol: float = 1e-10) -> tuple[DataFrame, Effects]:
        """The columns names less all fixed effects; other columns stay."""
        effects = Effects(names)
        if len(self.dims) > 1:
            if not hasattr(self, "s"):
                fresh, self.rows = self.rows, rows
                right = self.system(names)
                self.rows = fresh
            else:
                right = self.right_side(rows, names)
            gamma, effects.iterations = self.solve(right, tol)
            for d, levels in self.levels.items():
                own = gamma[self.offset[d] : self.offset[d] + len(levels)]
                effects.tables[d] = levels, own
                t = uploaded(rows.sparkSession, {"__l": levels} | {f"__e{i}": own[:, i] for i in range(len(names))})
                keep = [c for c in rows.columns if c not in names]
                rows = rows.join(t, F.col(d) == F.col("__l")).select(*keep, *[(F.col(v) - F.col(f"__e{i}")).alias(v) for i, v in enumerate(names)])
        return self.within(rows, names), effects


NARROW = 12  # columns up to which cross-products are sums of their own; more are multiplied in blocks of rows


def gram(rows: DataFrame, names: list[str], w: str | None, extra: list | None = None) -> tuple[np.ndarray, list]:
    """Weighted cross-products of the columns, and further aggregates, in one pass (a second one for the aggregates of wide designs)."""
    weight = F.col(w) if w else F.lit(1.0)
    k, more = len(names), [e.alias(f"e{n}") for n, e in enumerate(extra or [])]
    if k > NARROW:
        return blocks(rows.select(*[F.col(n).alias(f"x{i}") for i, n in enumerate(names)], weight.alias("w")), k), list(rows.agg(*more).first()) if more else []
    at = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(weight * F.col(names[i]) * F.col(names[j])) for i, j in at]
    row = rows.agg(*[s.alias(f"s{n}") for n, s in enumerate(sums)], *more).first()
    a = np.zeros((k, k))
    for n, (i, j) in enumerate(at):
        a[i, j] = a[j, i] = row[n] or 0.0
    return a, list(row[len(at) :])


def blocks(rows: DataFrame, k: int, fan: int = 32) -> np.ndarray:
    """X'WX of columns x0.. and w: a task multiplies its rows' batches; `fan` tasks add the matrices up, so that the driver gets few."""
    def multiply(batches):
        import pyarrow as pa

        total = np.zeros((k, k))
        for t in batches:
            x = np.stack([t[f"x{i}"].to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
            total += x.T @ (x * t["w"].to_numpy(zero_copy_only=False)[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches):
        import pyarrow as pa

        total, some = np.zeros(k * k), False
        for t in batches:
            for m in t["m"].to_pylist():
                total, some = total + np.frombuffer(m), True
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()] if some else [], pa.binary())], names=["m"])

    out = rows.mapInArrow(multiply, "m binary").repartition(fan).mapInArrow(add, "m binary")
    return sum((np.frombuffer(r["m"]) for r in out.collect()), np.zeros(k * k)).reshape(k, k)
