"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import by_bytes, cut, shared, table

QUERIES, BINS, CHUNK, SCALE = 4096, 1024, 1024, 256


def whole(vectors, scale: int = SCALE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of an Arrow list column: rows that take part by number of components, as {length: (rows, matrix)}; components become floor(scale * x)."""
    import pyarrow as pa

    vectors = vectors.cast(pa.list_(pa.float64())) if not pa.types.is_large_list(vectors.type) else vectors
    size = np.diff(np.asarray(vectors.offsets)) if len(vectors) else np.empty(0, np.int64)
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float)  # nulls become NaN
    valid = np.asarray(vectors.is_valid())
    size = np.where(valid, size, 0)
    start = np.cumsum(size) - size
    out = {}
    for n in np.unique(size[valid]):
        rows = np.flatnonzero(valid & (size == n))
        m = x[start[rows][:, None] + np.arange(n)[None, :]] if n else np.empty((len(rows), 0))
        good = np.isfinite(m).all(axis=1)
        out[int(n)] = rows[good], np.floor(m[good] * scale)
    return out


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: through doubles where all sums stay below 2^53, else in 64-bit integers."""
    top = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if top < 2**53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def scored(batches: Iterator, block: dict[int, tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of queries, candidate ids, scores, and which of them are the query's own rows: for all pairs of like length, chunk by chunk."""
    for batch in batches:
        ids = np.asarray(batch["id"].to_pylist(), object)
        for n, (rows, m) in whole(batch["vector"]).items():
            if n not in block:
                continue
            at, own, q = block[n]
            for i in range(0, len(rows), CHUNK):
                part = ids[rows[i : i + CHUNK]]
                num = np.array([x if x is not None else np.iinfo(np.int64).min for x in part], np.int64)
                yield at, num, product(q, m[i : i + CHUNK]), own[:, None] == num[None, :]


def histogram(batches: Iterator, block: dict, lo: np.ndarray, width: np.ndarray, need: np.ndarray, bins: int) -> Iterator:
    """(q, bin, n): counts of this partition's scores in [lo, lo + width * bins), from the top until need is met; what is above counts as bin = bins."""
    import pyarrow as pa

    total = np.zeros((len(lo), bins + 1), np.int64)
    for at, _, s, own in scored(batches, block):
        b = (s - lo[at][:, None]) // width[at][:, None]
        use = ~own & (b >= 0)
        flat = np.arange(len(at))[:, None] * (bins + 1) + np.minimum(b, bins)
        total[at] += np.bincount(flat[use], minlength=len(at) * (bins + 1)).reshape(len(at), bins + 1)
    above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
    q, b = np.nonzero((total > 0) & (above < need[:, None]))
    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(total[q, b], pa.int64())], names=["q", "bin", "n"])


def hits(batches: Iterator, block: dict, least: np.ndarray, k: int) -> Iterator:
    """(q, vec_id, score) of this partition's scores of at least `least`; among those equal to it, the k smallest ids."""
    import pyarrow as pa

    q_, id_, s_ = [], [], []

    def trimmed():
        q, i, s = (np.concatenate(x) for x in (q_, id_, s_))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < k], i[rank < k], s[rank < k]

    for at, ids, s, own in scored(batches, block):
        a, b = np.nonzero((s >= least[at][:, None]) & ~own)
        q_.append(at[a]), id_.append(ids[b]), s_.append(s[a, b])
        if len(q_) >= 64:
            (q_[:], id_[:], s_[:]) = ([x] for x in trimmed())
    if q_:
        q, i, s = trimmed()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["q", "vec_id", "score"])


def block_of(rows: list) -> dict[int, tuple]:
    import pyarrow as pa

    ids = np.array([r["id"] for r in rows], np.int64)
    return {n: (at, ids[at], m) for n, (at, m) in whole(pa.array([r["vector"] for r in rows], pa.list_(pa.float64()))).items() if len(at)}


def select_block(rows: DataFrame, block: dict, n: int, k: int, bins: int = BINS) -> DataFrame:
    """(q, vec_id, score): for each query of a block, its k best, by narrowing a window of scores around the kth value."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(block)
    top = {m: float(np.abs(q).max(initial=0)) for m, (_, _, q) in block.items()}

    def bounds(batches):
        import pyarrow as pa

        most = 0.0
        for batch in batches:
            for m, (_, x) in whole(batch["vector"]).items():
                most = max(most, np.abs(x).max(initial=0) * m * top.get(m, 0))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    most = rows.mapInArrow(bounds, "most double").agg(F.max("most")).first()[0] or 0.0
    if most >= 2.0**61:
        raise ValueError("inner products of these vectors may not fit 64-bit integers")
    span = int(most) + 1
    lo, width = np.full(n, -span, np.int64), np.full(n, -(-(2 * span + 1) // bins), np.int64)
    need = np.full(n, k, np.int64)
    while True:
        pass_ = lo.copy(), width.copy(), need.copy()
        counts = rows.mapInArrow(lambda b, p=pass_: histogram(b, sent.value, *p, bins), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        # at most one row for each query of the block: the bin in which its kth value lies, and what is above it
        found = counts.withColumn("upto", F.sum("n").over(down)).filter((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select("q", "bin").collect()
        q, b = np.array([r["q"] for r in found], np.int64), np.array([r["bin"] for r in found], np.int64)
        fewer = np.setdiff1d(np.arange(n), q)  # queries with fewer than k candidates: all are taken
        lo[q] += b * width[q]
        width[fewer] = 1
        if (width <= 1).all():
            break
        width = np.maximum(1, -(-width // bins))
    least = lo.copy()
    return rows.mapInArrow(lambda b: hits(b, sent.value, least, k), "q int, vec_id long, score long")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries, the k rows of vectors with the largest integer inner product.

    Every component x counts as floor(256 * x). Rows of the query's own id are left out. Ties go to smaller ids; rows that repeat count
    singly. Vectors that are null, or hold null or non-finite components, take no part; vectors of different length have no
    product; queries with fewer candidates return all; null query ids are left out, null candidate ids come out as the smallest number. No rows in, none out.
    Vectors whose products might pass 2^61 are refused.

    Queries are taken in blocks of about `block` rows, which bounds what is broadcast, each against all rows. A block
    scores every row in a few passes. The first finds the span of scores; each next one counts scores in `BINS` bins
    of a window about the kth value, sends a partition's top bins alone, adds them up and narrows each query's window to one bin, until
    it is one score wide. The last pass keeps scores from that value up; of those equal to it, each partition keeps its k smallest ids.
    """
    spark = vectors.sparkSession
    by_bytes(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    asked = cut(queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector")).filter("id IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    n = asked.count()
    parts = -(-n // block)
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    for p in range(parts):
        held = asked.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == p).orderBy("row").collect()
        ids = [r["id"] for r in held]
        found = select_block(rows, block_of(held), len(held), k)
        best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), "q int, query_id long")  # a block's rows
        found = found.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score")
        found.write.mode("append").parquet(path)  # a block's results are few; a plan of all blocks would grow with the queries
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(path) if n else spark.createDataFrame([], schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_topk(rows, rows.filter(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
