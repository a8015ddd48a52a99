import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def panel():
    """Workers, firms and years with effects; a missing value, a singleton and an island."""
    rng = np.random.default_rng(3)
    n = 600
    d = pd.DataFrame({"w": rng.integers(0, 60, n), "f": rng.integers(0, 15, n), "yr": rng.integers(2000, 2006, n), "x": rng.normal(size=n), "x2": rng.normal(size=n), "z1": rng.normal(size=n), "z2": rng.normal(size=n), "wt": rng.uniform(0.5, 2, n), "occ": rng.choice(["k0", "k1", "k2"], n), "cl": rng.integers(0, 20, n)})
    d["e"] = d.z1 + 0.5 * d.z2 + rng.normal(size=n)
    d["y"] = 1 + d.x * 0.5 - d.x2 + 0.3 * d.e + rng.normal(size=60)[d.w] + rng.normal(size=15)[d.f] + rng.normal(size=n)
    d["yb"] = (d.x + 0.5 * rng.normal(size=60)[d.w] + rng.logistic(size=n) > 0).astype(int)
    d["yp"] = rng.poisson(np.exp(0.3 * d.x + 0.3 * rng.normal(size=60)[d.w]))
    d.loc[3, "x"] = np.nan
    d.loc[4, "w"] = 999
    return d
