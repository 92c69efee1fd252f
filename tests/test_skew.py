"""Helpers for hot keys against brute force, with blocks so small that every edge is crossed."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import hidden_states as h
from scoreloom.operators import sampling as sa
from scoreloom.operators import vector_sets as vs
from scoreloom.operators.skew import dense_index, lower_median, with_neighbours


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    keys = rng.sample(range(10_000), 400)
    return pd.DataFrame({"g": ["hot" if i % 3 else f"g{i % 7}" for i in range(400)], "k": keys, "x": [rng.random() for _ in keys]})


def test_dense_index(spark, rows):
    got = dense_index(spark.createDataFrame(rows), ["g"], "k", block=16).toPandas()
    want = rows.assign(idx=rows.groupby("g")["k"].rank().astype(int) - 1)
    assert dict(zip(got.k, got.idx)) == dict(zip(want.k, want.idx))
    whole = dense_index(spark.createDataFrame(rows), [], "k", block=1).toPandas()
    assert list(whole.sort_values("k").idx) == list(range(400))


def test_neighbours(spark, rows):
    df = dense_index(spark.createDataFrame(rows), ["g"], "k", block=64)
    got = with_neighbours(df, ["g"], "idx", before={"p": "x"}, after={"n": "x"}, block=5).toPandas().sort_values(["g", "k"])
    want = rows.sort_values(["g", "k"])
    np.testing.assert_allclose(got.p, want.groupby("g").x.shift(1))
    np.testing.assert_allclose(got.n, want.groupby("g").x.shift(-1))


def test_lower_median(spark, rows):
    got = lower_median(spark.createDataFrame(rows), ["g"], "x", per_octave=2).toPandas().set_index("g")["median"]
    want = rows.groupby("g").x.apply(lambda s: sorted(s)[(len(s) - 1) // 2])
    assert got.to_dict() == want.to_dict()


def test_sample_rows(spark, rows):
    df = spark.createDataFrame(rows)
    for n in (0, 1, 137, 400, 900):
        a = {r.k for r in sa.sample_rows(df, "k", n, 3).collect()}
        assert len(a) == min(n, 400)
        assert a == {r.k for r in sa.sample_rows(df.repartition(5), "k", n, 3).collect()}
    assert {r.k for r in sa.sample_rows(df, "k", 50, 3).collect()} != {r.k for r in sa.sample_rows(df, "k", 50, 4).collect()}


def test_pair_sample_is_distinct_and_even(spark):
    subjects = spark.range(4000).withColumnRenamed("id", "s")
    people = spark.range(8).withColumnRenamed("id", "position").withColumn("p", F.col("position"))
    pairs = sa.pair_sample(subjects, people, F.lit(8), 3, 1, "s").toPandas()
    assert (pairs.groupby("s").p.nunique() == 3).all() and len(pairs) == 12_000
    assert pairs.p.value_counts().between(1350, 1650).all()
    many = sa.pair_sample(subjects.limit(50), people, F.lit(8), 20, 1, "s").toPandas()
    assert (many.groupby("s").size() == 20).all()


def test_steps(spark):
    names, states = ["a", "b", "c"], ["x", "y", "z", "w"]
    draw = sa.steps_without_replacement(names, states, 1, "d", F.col("id"), fixed={"b": "x reversed"}, suffix=" reversed")
    for r in spark.range(200).select(draw.alias("d")).collect():
        base = [s.state.removesuffix(" reversed") for s in r.d]
        assert [s.step for s in r.d] == names and r.d[1].state == "x reversed" and len(set(base)) == 3
    with pytest.raises(ValueError):
        sa.steps_without_replacement(names, ["x"], 1, "d", F.col("id"))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 5))
    x[7] = x[3] + 1e-7
    x[9] = x[3]
    return pd.DataFrame({"g": [0 if i % 3 else i % 5 for i in range(60)], "k": range(60), "v": list(x)})


def frame(spark, vectors):
    return spark.createDataFrame([(int(r.g), int(r.k), [float(c) for c in r.v]) for r in vectors.itertuples()], "g int, k int, v array<double>")


@pytest.mark.parametrize("metric", ["chord", "cosine", "dot"])
def test_distance_summary(spark, vectors, metric):
    df = frame(spark, vectors)
    got = vs.distance_summary(df, df, "g", "k", "v", metric, block_rows=7, skip_self=True).toPandas().set_index("k")
    for r in vectors.itertuples():
        others = np.array([o.v for o in vectors.itertuples() if o.g == r.g and o.k != r.k])
        if len(others) == 0:
            assert r.k not in got.index
            continue
        d = {"chord": np.linalg.norm(others - r.v, axis=1), "dot": others @ r.v,
             "cosine": 1 - others @ r.v / np.linalg.norm(others, axis=1) / np.linalg.norm(r.v)}[metric]
        np.testing.assert_allclose(got.loc[r.k, ["n", "least", "mean", "most"]].astype(float), [len(d), d.min(), d.mean(), d.max()], rtol=1e-9, atol=1e-12)


def test_pair_moments_and_volume(spark, vectors):
    df = frame(spark, vectors)
    got = vs.pair_moments(df, ["g"], "v").toPandas().set_index("g")
    volumes = vs.semantic_volume(df, "g", "k", "v").toPandas().set_index("g")
    import math
    for g, part in vectors.groupby("g"):
        x = np.stack(part.v)
        i, j = np.triu_indices(len(x), 1)
        dots = (x @ x.T)[i, j]
        np.testing.assert_allclose(got.loc[g, ["n_pairs", "mean_dot", "sd_dot", "mean_squared_chord"]].astype(float),
                                   [len(dots), dots.mean(), dots.std(), ((x[i] - x[j]) ** 2).sum(1).mean()], rtol=1e-9)
        s = np.linalg.svd(x[1:] - x[0], compute_uv=False)
        np.testing.assert_allclose(volumes.loc[g, "volume"], s.prod() / math.factorial(len(x) - 1), rtol=1e-6)


def test_rsa(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((2, 12, 4)), rng.standard_normal((12, 3))
    pooled = spark.createDataFrame([(t, l, a[l, t].tolist()) for l in range(2) for t in range(12)], "text_id long, layer int, pooled array<double>")
    emb = spark.createDataFrame([(t, b[t].tolist()) for t in range(12)], "text_id long, embedding array<double>")
    got = {r.layer: r.r for r in h.rsa(pooled, emb).collect()}
    iu = np.triu_indices(12, 1)
    for l in range(2):
        n = a[l] / np.linalg.norm(a[l], axis=1, keepdims=True)
        np.testing.assert_allclose(got[l], np.corrcoef((n @ n.T)[iu], (b @ b.T)[iu])[0, 1], rtol=1e-9)


def test_tangent_basis(spark, vectors):
    df = frame(spark, vectors)
    for r in vs.tangent_bases(df, "k", "v").collect():
        x, basis = np.array(vectors.v[r.k]), np.array(r.basis)
        np.testing.assert_allclose(basis @ basis.T, np.eye(4), atol=1e-12)
        np.testing.assert_allclose(basis @ x, 0, atol=1e-9)


def test_tasks_of_a_split(spark):
    from scoreloom.operators.skew import balanced
    cores, scan = spark.sparkContext.defaultParallelism, spark.range(0, 1000, 1, 2 * spark.sparkContext.defaultParallelism)
    assert balanced(scan).rdd.getNumPartitions() == 2 * cores
    assert balanced(scan, finer=4).rdd.getNumPartitions() == 8 * cores and balanced(scan, finer=4).count() == 1000
