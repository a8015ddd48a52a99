import math

import numpy as np
import pytest

from ridgeline.llm import mixing, topk

NAN = float("nan")


def brute(rows, asked, k):
    whole = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows if whole(v)}
    out = []
    for i in asked:
        if i in q:
            own = sorted(((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i and len(v) == len(q[i])))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(own, 1)]
    return sorted(out)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(30)] + [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [NAN, 0.0, 0.0, 0.0]), (303, [1.0, 2.0]), (304, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    asked = [0, 50, 100, 200, 300, 303]
    for block in (4096, 2):
        got = topk.exact_topk(df, df.filter(df.vec_id.isin(asked)), block=block).collect()
        exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
        assert sorted(tuple(r) for r in got) == brute(exact, asked, 5)


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_topk(df, df).count() == 0


def docs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(rng.integers(1, 60, 300), rng.choice(["a", "b", "c", None], 300, p=[0.6, 0.1, 0.2, 0.1])))]
    rows += [(300, None, "a"), (301, "", "d"), (302, " \t\n", "d"), (303, "long " * 5000, "b"), (0, rows[0][1], rows[0][2])]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size long, target long"), rows


def levels(size, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by repeated sharing out of what is over."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, free = share * sum(size.values()), {s: 0.0 for s in names}, list(names)
    while free and left > 1e-9:
        give, nxt = left / sum(w[s] for s in free), []
        left = 0.0
        for s in free:
            target[s] += give * w[s]
            if target[s] > most * size[s]:
                left += target[s] - most * size[s]
                target[s] = most * size[s]
            else:
                nxt.append(s)
        free = nxt
    return target


def test_mixing_meets_targets(spark):
    df, rows = docs(spark)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df).collect()))
    source = {i: s for i, _, s in rows}
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    target = levels(size)
    for s in size:
        own = [r for r in got if source[r.doc_id] == s]
        assert all(r.target == pytest.approx(target[s]) and r.source_size == size[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max((r.size for r in own), default=0) * 1.01 + 1e-6
    assert all(r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (300, 301, 302)} == {0}
    out = mixing.mixture(df)
    assert out.columns == df.columns and out.filter("doc_id = 303").count() == next(r.copies for r in got if r.doc_id == 303)


def test_mixing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(df).count() == 0 and mixing.mixture(df).count() == 0
