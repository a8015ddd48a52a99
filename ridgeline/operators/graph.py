"""Connectedness of two sets of levels that rows tie together."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ridgeline.plans.cache import cut, discard
from ridgeline.plans.ranges import numbered_by
from ridgeline.sources import source

MOST_PAIRS, MOST_SMALL = 20_000_000, 500_000


def distinct_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): pairs of levels and their rows; rows with a missing level belong to none."""
    ok = present(rows, a) & present(rows, b)
    return rows.filter(ok).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def present(df: DataFrame, name: str):
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) if dict(df.dtypes)[name] in ("double", "float") else c.isNotNull()


def small_labels(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Levels of a and the smallest level that each reaches, if there are few pairs."""
    few = pairs.select("a", "b").limit(most + 1).toArrow().to_pandas()
    if len(few) > most:
        return None
    (a, a_names), (b, b_names) = (_codes(few[c]) for c in ("a", "b"))
    return a_names, a_names[min_labels(a, b, len(a_names), len(b_names))]


def named(pairs: DataFrame, names: np.ndarray, labels: np.ndarray) -> DataFrame:
    kind = pairs.schema["a"].dataType
    return pairs.sparkSession.createDataFrame(list(zip(names.tolist(), labels.tolist(), strict=True)), StructType([StructField("a", kind), StructField("component", kind)]))


def counted_components(pairs: DataFrame, most: int = MOST_SMALL) -> tuple[int, DataFrame]:
    """How many components pairs make, and the pairs with theirs: a plan while they are few, a table otherwise."""
    few = small_labels(pairs, most)
    if few is not None:
        return len(np.unique(few[1])), pairs.join(named(pairs, *few), "a")
    labelled = cut(label_pairs(pairs, 0))
    return labelled.select("component").distinct().count(), labelled


def label_pairs(pairs: DataFrame, most: int = MOST_SMALL) -> DataFrame:
    """Adds component to pairs: the smallest level of a that the pair's levels reach.

    Up to `most` pairs are labelled on the driver. With more, labels pass from a to b and back by the minimum, and each label of a then takes the label that its own label has, which
    shortens paths by half each round. Each round is an aggregation on each side; hubs are summed before they are sent.
    """
    few = small_labels(pairs, most)
    if few is not None:
        return pairs.join(named(pairs, *few), "a")
    labels = cut(pairs.select("a").distinct().withColumn("label", F.col("a")))
    while True:
        over = pairs.join(labels, "a").groupBy("b").agg(F.min("label").alias("m"))
        back = pairs.join(over, "b").groupBy("a").agg(F.min("m").alias("m"))
        step = labels.join(back, "a").select("a", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = step.select(F.col("a").alias("label"), F.col("label").alias("next"))
        step = cut(step.join(jump, "label").select("a", "old", F.least("label", "next").alias("label")))
        moved = step.filter("old <> label").limit(1).count()
        labels = step.select("a", "label")
        if not moved:
            return pairs.join(labels, "a").withColumnRenamed("label", "component")


def min_labels(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """The smallest code of a that each code of a reaches through pairs."""
    label = np.arange(na)
    while True:
        over = np.full(nb, na)
        np.minimum.at(over, b, label[a])
        new = label.copy()
        np.minimum.at(new, a, over[b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def peel(pairs: DataFrame, degrees: tuple[int, int]) -> DataFrame:
    """The largest set of pairs in which each a has degrees[0] distinct partners, and each b degrees[1]. A round is one job: it takes out the levels that fall
    short on either side, writes what is left, and is the last if that is all. Degrees are summed before they are sent, so that a hub is no burden."""
    left, n = pairs, None
    while True:
        now = left
        for side, k in zip(("a", "b"), degrees, strict=True):
            if k > 1:
                now = now.join(left.groupBy(F.col(side).alias("short")).agg(F.count("*").alias("d")).filter(F.col("d") < k).select(F.col("short").alias(side)), side, "left_anti")
        now = cut(now.select(*pairs.columns))
        before, n = (left.count() if n is None else n), now.count()  # counts of tables come from their footers
        if left is not pairs:
            discard(left)
        left = now
        if n == before:
            return left


def ties(batches):
    """Of rows (a, its list of distinct b) those that decide which a's hold b's together: rows that join what the ones before left apart (a first forest), and of the
    others those that do so among themselves (a second one), so twice as many as there are b's at most.

    What a row that goes would join, the second forest joins, and no row of the first is in it: without any one row, b's hang together among the rows that
    stay just as among all. So parts may be handled each for itself, in any order, and what stays of them again."""
    number, parents = {}, [np.empty(0, np.int64), np.empty(0, np.int64)]
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        coded = lists.flatten().dictionary_encode()
        own = np.array([number.setdefault(x, len(number)) for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        start = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        kept = []
        for i, parent in enumerate(parents):
            parents[i] = np.concatenate([parent, np.arange(len(parent), len(number))])
        apart = np.zeros(batch.num_rows, bool)
        for parent in parents:
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]
            apart |= np.minimum.reduceat(parent[own], start[:-1]) < np.maximum.reduceat(parent[own], start[:-1])
        for r in np.flatnonzero(apart).tolist():  # the others join nothing any more
            for parent in parents:
                roots = {_root(parent, x) for x in own[start[r] : start[r + 1]].tolist()}
                if len(roots) > 1:
                    parent[list(roots)] = min(roots)
                    kept.append(r)
                    break
        if kept:
            yield batch.take(kept)


def _root(parent: np.ndarray, x: int) -> int:
    while (up := int(parent[x])) != x:
        parent[x] = x = int(parent[up])
    return x


def deciding(pairs: DataFrame, fan: int = 8) -> DataFrame:
    """The pairs of a's that decide which a disconnects the graph, found in parts, then in `fan` of them: the number of levels of b bounds what comes out, not that of pairs."""
    kind = StructType([StructField("a", pairs.schema["a"].dataType), StructField("b", ArrayType(pairs.schema["b"].dataType))])

    lists = pairs.groupBy("a").agg(F.collect_list("b").alias("b"))
    return lists.mapInArrow(ties, kind).repartition(fan).mapInArrow(ties, kind).select("a", F.explode("b").alias("b"))


def cut_vertices(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Of a bipartite graph's nodes (a first, then b), which ones disconnect it: depth-first search without recursion."""
    n = na + nb
    u, v = np.concatenate([a, b + na]), np.concatenate([b + na, a])
    order = np.argsort(u, kind="stable")
    start = np.searchsorted(u[order], np.arange(n + 1)).tolist()
    to = v[order].tolist()
    seen, low, is_cut = [-1] * n, [0] * n, np.zeros(n, bool)
    clock = 0
    for root in range(n):
        if seen[root] >= 0 or start[root] == start[root + 1]:
            continue
        stack, at, children = [(root, -1)], {root: start[root]}, 0
        seen[root] = low[root] = clock
        clock += 1
        while stack:
            x, up = stack[-1]
            if at[x] < start[x + 1]:
                y = to[at[x]]
                at[x] += 1
                if seen[y] < 0:
                    seen[y] = low[y] = clock
                    clock += 1
                    at[y] = start[y]
                    stack.append((y, x))
                    children += x == root
                elif y != up:
                    low[x] = min(low[x], seen[y])
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[x])
                    if p != root and low[x] >= seen[p]:
                        is_cut[p] = True
        is_cut[root] = children > 1
    return is_cut


def largest_component(pairs: DataFrame, by: str = "n") -> DataFrame:
    """Pairs of the component with most rows (by="n") or most levels of a or b; ties: the smallest level of a."""
    labelled = cut(label_pairs(pairs))
    first = component_sizes(labelled).orderBy(F.desc(SIZES[by]), "component").limit(1).select("component")
    return labelled.join(first, "component", "left_semi").select("a", "b", "n")


SIZES = {"n": "n", "a": "a_levels", "b": "b_levels"}


def component_sizes(labelled: DataFrame) -> DataFrame:
    """component, n, a_levels, b_levels."""
    return labelled.groupBy("component").agg(F.sum("n").alias("n"), F.countDistinct("a").alias("a_levels"), F.countDistinct("b").alias("b_levels"))


def ranked(labelled: DataFrame, by: str = "n") -> DataFrame:
    """component, n, a_levels, b_levels, rank: one row for each component."""
    size, key = component_sizes(labelled), SIZES[by]
    return numbered_by(size, [F.desc(key), F.col("component")], "rank")


def leave_one_out_pairs(pairs: DataFrame) -> DataFrame:
    """The largest component that stays connected when any one level of a is taken out: a's with one row and a's that are cut vertices go, again and again.

    An a with one partner is never a cut vertex, and of those with more (movers) only the few that decide come to the driver, MOST_PAIRS of their pairs at most.
    """
    pairs = cut(largest_component(pairs))
    while True:
        rows = pairs.groupBy("a").agg(F.sum("n").alias("r"), F.count("*").alias("d"))
        kept = pairs.join(rows.filter("r > 1").select("a"), "a", "left_semi")
        kept = cut(largest_component(kept))
        movers = deciding(kept.join(rows.filter("d > 1").select("a"), "a", "left_semi").select("a", "b")).limit(MOST_PAIRS + 1).toArrow().to_pandas()
        if len(movers) > MOST_PAIRS:
            raise ValueError(f"more than {MOST_PAIRS} pairs decide: cut vertices are found on the driver")
        (a, a_names), (b, b_names) = (_codes(movers[c]) for c in ("a", "b"))
        bad = a_names[cut_vertices(a, b, len(a_names), len(b_names))[: len(a_names)]]
        before = pairs.count()
        if len(bad):
            gone = kept.sparkSession.createDataFrame([(x,) for x in bad.tolist()], kept.select("a").schema)
            kept = cut(largest_component(kept.join(gone, "a", "left_anti")))
        if kept.count() == before:
            return kept
        pairs = kept


def _codes(values) -> tuple[np.ndarray, np.ndarray]:
    names, codes = np.unique(np.asarray(values), return_inverse=True)
    return codes, names


@dataclass
class ConnectedComponents:
    """Components of the graph of two dimensions' levels, numbered from 0 by size; pairs: levels a, b, their rows n and their component's smallest a."""

    data: DataFrame
    fe: tuple[str, str]
    pairs: DataFrame
    rank_by: str = "n"

    def numbered(self) -> DataFrame:
        return self.pairs.join(ranked(self.pairs, self.rank_by).select("component", (F.col("rank") - 1).alias("__c")), "component").select("a", "b", "n", F.col("__c").alias("component"))

    def sizes(self) -> DataFrame:
        """component, rows and the number of levels of each dimension."""
        r = ranked(self.pairs, self.rank_by)
        return r.select((F.col("rank") - 1).alias("component"), F.col("n").alias("rows"), F.col("a_levels").alias(self.fe[0]), F.col("b_levels").alias(self.fe[1]))

    @property
    def n_components(self) -> int:
        return self.pairs.select("component").distinct().count()

    def levels(self, name: str) -> DataFrame:
        """Levels of a dimension and their component."""
        side = "ab"[self.fe.index(name)]
        return self.numbered().select(F.col(side).alias(name), "component").distinct()

    def _on(self, df: DataFrame):
        a, b = (effect(f).level for f in self.fe)
        return (a == F.col("__a")) & (b == F.col("__b"))

    def label(self, data=None) -> DataFrame:
        """The data with component (null for rows in none) and in_largest."""
        df = self.data if data is None else source(data)
        p = self.numbered().select(F.col("a").alias("__a"), F.col("b").alias("__b"), "component")
        return df.join(p, self._on(df), "left").drop("__a", "__b").withColumn("in_largest", F.coalesce(F.col("component") == 0, F.lit(False)))

    def largest(self, data=None) -> DataFrame:
        """Rows of the largest component."""
        df = self.data if data is None else source(data)
        first = self.numbered().filter("component = 0").select(F.col("a").alias("__a"), F.col("b").alias("__b"))
        return df.join(first, self._on(df), "left_semi")

    def summary(self) -> str:
        top = self.sizes().orderBy("component").limit(2).collect()
        lines = [f"connected components of {self.fe[0]} x {self.fe[1]}: {self.n_components}"]
        lines += [f"  {'largest' if not r['component'] else 'next largest'}: {r['rows']} rows, {r[self.fe[0]]} {self.fe[0]}, {r[self.fe[1]]} {self.fe[1]}" for r in top]
        return "\n".join(lines)


def effect(name: str):
    from ridgeline.functions.formula import fixed_effect

    return fixed_effect(name)


def connected_components(data, fe, min_degree=(1, 1), leave_one_out: bool = False, rank_by: str = "rows") -> ConnectedComponents:
    """Components of two dimensions' levels ("a + b^c", or both names), after peeling to min_degree and, if asked, to the leave-one-out connected set.

    Ranked by rows, or by the levels of the dimension that rank_by names; ties go to the smallest level of the first."""
    df = source(data)
    fe = tuple(effect(f).name for f in (fe.split("+") if isinstance(fe, str) else fe))
    degrees = (min_degree, min_degree) if isinstance(min_degree, int) else tuple(min_degree)
    rows = df.select(*[effect(f).level.alias(side) for f, side in zip(fe, "ab", strict=True)])
    pairs = cut(distinct_pairs(rows, "a", "b"))
    if max(degrees) > 1:
        pairs = peel(pairs, degrees)
    if leave_one_out:
        pairs = leave_one_out_pairs(pairs)
    return ConnectedComponents(df, fe, cut(label_pairs(pairs)), "n" if rank_by == "rows" else "ab"[fe.index(rank_by)])
