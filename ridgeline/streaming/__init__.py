"""Regressions kept up to date over streams, by Structured Streaming."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.plans.cache import shared


class StreamingRegression:
    """Cross-products of y and x over everything a stream has brought: each micro-batch is one aggregation and adds one small matrix.

    A batch that is delivered again, after a failure, takes the place of its first delivery. Rows with a missing value are left out.
    """

    def __init__(self, y: str, x: list[str]):
        self.y, self.x = y, x
        self.parts: dict[int, np.ndarray] = {}

    def add(self, rows: DataFrame, batch: int) -> None:
        names = [self.y, "Intercept", *self.x]
        cols = {n: F.lit(1.0) if n == "Intercept" else F.col(n).cast("double") for n in names}
        at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        sums = rows.dropna(subset=[self.y, *self.x]).agg(*[F.sum(cols[names[i]] * cols[names[j]]).alias(f"s{k}") for k, (i, j) in enumerate(at)]).first()
        a = np.zeros((len(names), len(names)))
        for k, (i, j) in enumerate(at):
            a[i, j] = a[j, i] = sums[k] or 0.0
        self.parts[batch] = a

    def follow(self, spark: SparkSession, path: str, schema: T.StructType, checkpoint: str | None = None, available_now: bool = True):
        """Reads Parquet files as they come; with available_now, those that are there, and returns. A path may name one file."""
        import uuid

        folder, _, name = path.rstrip("/").rpartition("/")
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
        stream = stream.parquet(f"{folder}/{name}*")
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint or f"{shared(spark)}/stream-{uuid.uuid4().hex}")
        q = (writer.trigger(availableNow=True) if available_now else writer).start()
        if available_now:
            q.awaitTermination()
        return q

    @property
    def n(self) -> float:
        return sum(a[1, 1] for a in self.parts.values())

    def coefficients(self) -> dict[str, float]:
        a = sum(self.parts.values())
        return dict(zip(["Intercept", *self.x], np.linalg.solve(a[1:, 1:], a[1:, 0]).tolist(), strict=True))
