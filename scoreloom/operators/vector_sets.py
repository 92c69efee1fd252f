"""Measures over sets of vectors.

The distances of a set are quadratic in it.  Three exact ways avoid writing all pairs down: a list of
wanted pairs, summaries per vector computed block by block, and sums over pairs obtained from the
matrix of cross moments, which has the size of the dimension and not of the set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.values import fence, let
from scoreloom.functions.vectors import METRICS, dot, geodesic, norm, normalize, tangent
from scoreloom.operators.skew import hash_block

BLOCK_ROWS = 2048
MOMENT_BYTES = 64 << 20  # of matrices that a task holds at a time


def distances_to(df: DataFrame, vector: str, reference: Column, key: str) -> DataFrame:
    """Angle of every vector to one reference vector (a literal or a scalar subquery), nearest first."""
    held = fence(df.withColumn("__r", reference), ["__r"])
    return held.withColumn("distance", geodesic(F.col(vector), F.col("__r"))).drop("__r").orderBy("distance", key)


def pair_distances(vectors: DataFrame, pairs: DataFrame, keys: Sequence[str], vector: str, metrics: Sequence[str]) -> DataFrame:
    """The wanted entries of the distance matrix.

    ``pairs`` names both ends as ``<key>_a`` and ``<key>_b``; both ends are found by equality.
    """
    end = lambda side: vectors.select(*[F.col(k).alias(f"{k}_{side}") for k in keys], F.col(vector).alias(f"__{side}"))
    joined = pairs.join(end("a"), [f"{k}_a" for k in keys]).join(end("b"), [f"{k}_b" for k in keys])
    return (joined.withColumns({m: METRICS[m](F.col("__a"), F.col("__b")) for m in metrics}).drop("__a", "__b"))


def band_pairs(index: DataFrame, group: Sequence[str], idx: str, width: int) -> DataFrame:
    """Pairs of a member and its next ``width`` followers: a band of the distance matrix."""
    ends = index.select(*[F.col(g) for g in group], F.col(idx).alias(f"{idx}_a"), F.explode(F.sequence(F.lit(1), F.lit(width))).alias("__step"))
    return ends.select(*[F.col(g).alias(f"{g}_a") for g in group], *[F.col(g).alias(f"{g}_b") for g in group], f"{idx}_a",
                       (F.col(f"{idx}_a") + F.col("__step")).alias(f"{idx}_b"))


def distance_summary(left: DataFrame, right: DataFrame, group: str, key: str, vector: str, metric: str = "chord",
                     block_rows: int = BLOCK_ROWS, skip_self: bool = False) -> DataFrame:
    """For every left vector: count, least, mean and greatest distance to all right vectors of its group.

    Exact.  Both sides of a group are cut into blocks of about ``block_rows`` by a hash; each pair of
    blocks meets in one task, which keeps only sums, so no pair leaves a task and a group that holds
    a third of all rows spreads over as many tasks as it has pairs of blocks.
    """
    def cut(df, name):
        n = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("long").alias(f"__{name}"))
        return df.select(group, key, vector).join(n, group), n

    l, l_blocks = cut(left, "ln")
    r, r_blocks = cut(right, "rn")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    lb = (l.join(r_blocks, group).withColumn("__lb", hash_block(key, blocks=F.col("__ln"))).withColumn("__rb", spread("__rn"))
          .select(group, "__lb", "__rb", key, vector))
    rb = (r.join(l_blocks, group).withColumn("__rb", hash_block(key, blocks=F.col("__rn"))).withColumn("__lb", spread("__ln"))
          # new names, so that a set can be compared with itself
          .select(F.col(group).alias("__g"), F.col("__lb").alias("__l"), F.col("__rb").alias("__r"), F.col(key).alias("__k"), F.col(vector).alias("__v")))
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}

    def meet(keys, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({group: [], key: [], "n": [], "least": [], "total": [], "most": []})
        x, y = np.stack(a[vector].to_numpy()).astype(float), np.stack(b["__v"].to_numpy()).astype(float)
        gram = x @ y.T
        if metric == "chord":
            d = chords(x, y)
        elif metric == "arc":
            d = np.arccos(np.clip(gram, -1.0, 1.0))
        elif metric == "dot":
            d = gram
        else:
            d = 1.0 - gram / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
        use = np.ones(d.shape, bool)
        if skip_self:
            use = a[key].to_numpy()[:, None] != b["__k"].to_numpy()[None, :]
        return pd.DataFrame({group: a[group].to_numpy(), key: a[key].to_numpy(), "n": use.sum(1),
                             "least": np.where(use, d, np.inf).min(1), "total": np.where(use, d, 0.0).sum(1),
                             "most": np.where(use, d, -np.inf).max(1)})

    parts = (lb.groupBy(group, "__lb", "__rb").cogroup(rb.groupBy("__g", "__l", "__r")).applyInPandas(
        meet, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, n long, least double, total double, most double"))
    return (parts.where("n > 0").groupBy(group, key).agg(F.sum("n").alias("n"), F.min("least").alias("least"),
                                                         (F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("most")))


def chords(x: np.ndarray, y: np.ndarray, block: int = 2048) -> np.ndarray:
    """All distances of two small sets of vectors."""
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0.0))
    # the short form loses digits between close vectors: those are measured directly
    near = np.argwhere(d < 1e-3)
    for some in np.array_split(near, 1 + len(near) // block):
        d[some[:, 0], some[:, 1]] = np.linalg.norm(x[some[:, 0]] - y[some[:, 1]], axis=1)
    return d


def nearest_distances(left: DataFrame, right: DataFrame, group: str, key: str, vector: str, pivots: int = 64, block_rows: int = BLOCK_ROWS, skip_self: bool = False) -> DataFrame:
    """``group, key, least``: the distance of every left vector to the nearest right vector of its group, exactly.

    Right vectors lie in cells around ``pivots`` sampled vectors; a cell knows its radius.  A left vector is first compared with the cell of its
    own pivot, which bounds its distance.  By the triangle inequality a cell whose pivot is farther than that and the radius together holds
    nothing nearer, so a vector travels only to the cells that are left: few, where vectors lie in clusters.  Cells and their visitors are cut into
    blocks, and each pair of blocks meets in one task.  Left vectors of a group without right ones give no row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    some = right.where(F.col(vector).isNotNull()).select(key, vector).orderBy(F.xxhash64(key), key).limit(pivots).collect()
    if not some:
        return left.select(group, key, F.lit(None).cast("double").alias("least")).limit(0)
    points = np.array([list(r[vector]) for r in some], float)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                far = chords(np.stack(frame[vector].to_numpy()).astype(float), points)
                yield pd.DataFrame({"g": frame[group], "k": frame[key], "v": frame[vector], "cell": far.argmin(axis=1).astype(np.int32), "far": list(far)})

    schema = f"g {kinds[group]}, k {kinds[key]}, v array<double>, cell int, far array<double>"
    cells = lambda df: df.where(F.col(vector).isNotNull()).select(group, key, F.col(vector).cast("array<double>").alias(vector)).mapInPandas(placed, schema)
    l, r = cells(left), cells(right)
    radii = (r.groupBy("g", "cell").agg(F.max(F.element_at("far", F.col("cell") + 1)).alias("radius")).groupBy("g")
             .agg(F.collect_list(F.struct("cell", "radius")).alias("cells")))  # at most one entry a pivot

    def visit(visitors: DataFrame) -> DataFrame:
        """Least distance of visitors (g, k, v, cell) to the members of the cell."""
        parts = lambda df, name: df.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias(name))
        sizes = parts(r, "rn").join(parts(visitors, "ln"), ["g", "cell"])
        home = lambda of: F.pmod(F.xxhash64("k"), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        a = visitors.join(sizes, ["g", "cell"]).withColumn("lb", home("ln")).withColumn("rb", every("rn")).select("g", "cell", "lb", "rb", "k", "v")
        b = r.join(sizes, ["g", "cell"]).withColumn("rb", home("rn")).withColumn("lb", every("ln")).select(
            *[F.col(c).alias(f"r_{c}") for c in ("g", "cell", "lb", "rb", "k", "v")])

        def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                return pd.DataFrame({"g": [], "k": [], "least": []})
            d = chords(np.stack(x["v"].to_numpy()), np.stack(y["r_v"].to_numpy()))
            if skip_self:
                d[x["k"].to_numpy()[:, None] == y["r_k"].to_numpy()[None, :]] = np.inf
            return pd.DataFrame({"g": x["g"].to_numpy(), "k": x["k"].to_numpy(), "least": d.min(axis=1)})

        met = a.groupBy("g", "cell", "lb", "rb").cogroup(b.groupBy("r_g", "r_cell", "r_lb", "r_rb")).applyInPandas(meet, f"g {kinds[group]}, k {kinds[key]}, least double")
        return met.where("least < double('infinity')").groupBy("g", "k").agg(F.min("least").alias("least"))

    at_home = visit(l.select("g", "k", "v", "cell"))
    known = l.join(at_home.withColumnRenamed("least", "bound"), ["g", "k"], "left").join(radii, "g")
    within = F.filter("cells", lambda c: (c["cell"] != F.col("cell")) & (F.element_at("far", c["cell"] + 1) - c["radius"] <= F.coalesce("bound", F.lit(float("inf"))) + 1e-9))
    farther = visit(known.select("g", "k", "v", F.explode(F.transform(within, lambda c: c["cell"])).alias("cell")))
    return at_home.unionByName(farther).groupBy("g", "k").agg(F.min("least").alias("least")).select(F.col("g").alias(group), F.col("k").alias(key), "least")


def cross_moments(df: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """Sum over each group of v v^T, as rows (group, i, j, value).

    Every task adds its own rows up first and sends one matrix per group; with many groups it sends what it has whenever the
    matrices reach ``MOMENT_BYTES``, and starts anew.
    """
    keys = list(group)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        held = 0

        def sent() -> Iterator[pd.DataFrame]:
            for k, m in sums.items():
                yield pd.DataFrame({**{c: [v] for c, v in zip(keys, k)}, "m": [m.ravel()], "d": [m.shape[0]]})
            sums.clear()

        for frame in frames:
            for k, part in (frame.groupby(keys, sort=False) if keys else [((), frame)]):
                x = np.stack(part[vector].to_numpy()).astype(float)
                if k in sums:
                    sums[k] += x.T @ x
                else:
                    sums[k] = x.T @ x
                    held += sums[k].nbytes
                if held > MOMENT_BYTES:
                    yield from sent()
                    held = 0
        yield from sent()

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["m array<double>", "d int"])
    cells = df.select(*keys, vector).mapInPandas(partial, schema).select(*keys, "d", F.posexplode("m").alias("__p", "__v"))
    return (cells.groupBy(*keys, "d", "__p").agg(F.sum("__v").alias("value"))
            .select(*keys, F.floor(F.col("__p") / F.col("d")).cast("int").alias("i"), (F.col("__p") % F.col("d")).cast("int").alias("j"), "value"))


def pair_moments(df: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """Mean and spread of the dot products over all pairs of each group, and the mean squared chord.

    The sum of (x_i . x_j)^2 over all i, j is the squared size of the matrix of moments, so no pair is formed.
    """
    both = F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0)))
    own = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(dot(F.col(vector), F.col(vector))).alias("d1"),
                                 F.sum(F.pow(dot(F.col(vector), F.col(vector)), 2)).alias("d2"), F.max(F.size(vector)).alias("d"))
    m = cross_moments(df.select(*group, both.alias("__v")), group, "__v").join(own.select(*group, "d"), list(group))
    sums = m.groupBy(*group).agg(
        F.sum(F.when((F.col("i") < F.col("d")) & (F.col("j") == F.col("d")), F.col("value") * F.col("value"))).alias("s1"),
        F.sum(F.when((F.col("i") < F.col("d")) & (F.col("j") < F.col("d")), F.col("value") * F.col("value"))).alias("s2"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = (F.col("s1") - F.col("d1")) / 2 / F.col("pairs")
    square = (F.col("s2") - F.col("d2")) / 2 / F.col("pairs")
    return (own.join(sums, list(group)).where("n > 1").withColumn("pairs", pairs)
            .select(*group, "n", F.col("pairs").cast("long").alias("n_pairs"), mean.alias("mean_dot"),
                    F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("sd_dot"),
                    # |x - y|^2 = |x|^2 + |y|^2 - 2 x.y
                    (2 * F.col("d1") / F.col("n") - 2 * mean).alias("mean_squared_chord")))


def reduced_rows(df: DataFrame, group: str, vector: str, kind: str) -> DataFrame:
    """Fewer rows with the same sums of products: of each group's vectors in a task the triangular factor of a QR factorisation.

    A task holds one factor of at most d rows a group and folds arriving vectors into it; with many groups it sends what it has whenever
    they reach ``MOMENT_BYTES``.  Nothing is squared, so small directions keep their digits.
    """
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, list[np.ndarray]] = {}
        size = 0

        def factor(parts: list[np.ndarray]) -> np.ndarray:
            x = parts[0] if len(parts) == 1 else np.vstack(parts)
            return np.linalg.qr(x, mode="r") if len(x) > x.shape[1] else x

        def sent() -> Iterator[pd.DataFrame]:
            for name, parts in held.items():
                rows = factor(parts)
                for at in range(0, len(rows), 256):
                    yield pd.DataFrame({group: [name] * len(rows[at:at + 256]), vector: list(rows[at:at + 256])})
            held.clear()

        for frame in frames:
            for name, part in frame.groupby(group, sort=False, dropna=False):
                x = np.stack(part[vector].to_numpy()).astype(float)
                parts = held.setdefault(name, [])
                parts.append(x)
                size += x.nbytes
                if sum(map(len, parts)) > 4 * x.shape[1]:
                    size -= sum(p.nbytes for p in parts)
                    parts[:] = [factor(parts)]
                    size += parts[0].nbytes
            if size > MOMENT_BYTES:
                yield from sent()
                size = 0
        yield from sent()

    return df.select(group, vector).mapInPandas(fold, f"`{group}` {kind}, `{vector}` array<double>")


def semantic_volume(df: DataFrame, group: str, key: str, vector: str, fan_in: int = 16) -> DataFrame:
    """``n``, ``volume`` and ``log_volume`` of the simplex of each group's vectors, from the singular values of (x_i - x_0).

    x_0 is the vector of the lowest key.  The singular values come from a tree of QR factors: every task reduces its rows of a group to
    a factor, ``fan_in`` parts of each group reduce the factors of the tasks, and one task those of the parts.  Groups of any size,
    smaller or larger than the dimension, go the same way.  With more vectors than dimensions the product is over all d singular values.
    """
    kind = dict(df.dtypes)[group]
    first = df.groupBy(group).agg(F.min_by(vector, key).alias("__x0"), F.count(F.lit(1)).cast("long").alias("n"))
    moved = df.join(first.select(group, "__x0"), group).select(group, F.zip_with(vector, "__x0", lambda a, b: a.cast("double") - b.cast("double")).alias("__v"))
    factors = reduced_rows(moved, group, "__v", kind).withColumn("__part", F.spark_partition_id() % fan_in)
    factors = reduced_rows(factors.repartition(group, "__part"), group, "__v", kind)

    def measured(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["__v"].to_numpy()).astype(float)
        n, d = int(pdf["n"].iloc[0]), x.shape[1]
        values = np.zeros(min(n - 1, d))
        found = np.linalg.svd(x, compute_uv=False)[:len(values)]
        values[:len(found)] = found
        log = float(np.log(values).sum() - math.lgamma(n)) if n > 1 and (values > 0).all() else -math.inf
        return pd.DataFrame({group: pdf[group].iloc[:1], "n": [n], "volume": [math.exp(log)], "log_volume": [log]})

    # at most fan_in * d rows a group
    return (factors.join(first.select(group, "n"), group).groupBy(group)
            .applyInPandas(measured, f"`{group}` {kind}, n long, volume double, log_volume double"))


def tangent_bases(df: DataFrame, key: str, vector: str, keep: Sequence[str] = ()) -> DataFrame:
    """An orthonormal basis of the tangent space at every vector: ``basis`` has d-1 arrays of d numbers.  A basis is d times as large as its vector, so
    join what else is needed before, and ``keep`` it.

    The reflection that takes the vector to the first axis takes the other axes to such a basis: its rows are
    e_i - 2 w_i w / |w|^2 with w = x + sign(x_0) |x| e_0.  A zero vector has no tangent space and gets the axes 1 to d-1.
    """
    def mirrored(x: Column) -> Column:
        w = F.transform(x, lambda v, j: F.when(j == 0, v + F.when(v < 0, -norm(x)).otherwise(norm(x))).otherwise(v))
        return let(w, lambda w: F.struct(w.alias("w"), dot(w, w).alias("square")))

    def rows(p: Column) -> Column:
        w, factor = p["w"], F.when(p["square"] > 0, 2.0 / p["square"]).otherwise(0.0)
        return let(factor, lambda f: F.transform(F.slice(w, F.lit(2), F.size(w)), lambda wi, i: let(f * wi, lambda scale: F.transform(
            w, lambda wj, j: F.when(j == i + 1, 1.0 - scale * wj).otherwise(-scale * wj)))))

    return df.select(key, *keep, let(mirrored(F.col(vector).cast("array<double>")), rows).alias("basis"))


def vector_sums(df: DataFrame, keys: Sequence[str], vector: str, squares: bool = False) -> DataFrame:
    """``keys, n, mean`` and with ``squares`` ``m2`` (sum of squared distances from the mean), arrays as long as the vectors, of each key.

    Vectors are added up in Arrow batches: a task sends one array a key (and again, when its keys reach ``MOMENT_BYTES``), and what
    different tasks sent is merged after the shuffle.  So the rows that travel depend on keys and tasks, not on the dimension.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["n long", "mean array<double>"] + (["m2 array<double>"] if squares else []))

    def combined(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        if not squares:
            return n, a[1] + (b[1] - a[1]) * (b[0] / n), None
        apart = b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart * apart * (a[0] * b[0] / n)

    def rows(held: dict) -> pd.DataFrame:
        out = {c: [k[i] for k in held] for i, c in enumerate(keys)} | {"n": [v[0] for v in held.values()], "mean": [v[1] for v in held.values()]}
        return pd.DataFrame(out | ({"m2": [v[2] for v in held.values()]} if squares else {}), dtype=object)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        size = 0
        for frame in frames:
            for name, value in of_vectors(frame):
                if name in held:
                    held[name] = combined(held[name], value)
                else:
                    held[name] = value
                    size += value[1].nbytes * (1 + squares)
            if size > MOMENT_BYTES:
                yield rows(held)
                held, size = {}, 0
        if held:
            yield rows(held)

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # sorted by key: when a key begins, those before it are whole
        name, value = None, None
        for frame in frames:
            done: dict[tuple, tuple] = {}
            for own, more in of_partials(frame):
                if own == name:
                    value = combined(value, more)
                else:
                    if name is not None:
                        done[name] = value
                    name, value = own, more
            if done:
                yield rows(done)
        if name is not None:
            yield rows({name: value})

    def named(frame: pd.DataFrame) -> tuple[np.ndarray, list[tuple]]:
        """A number for the key of each row, and the keys."""
        plain = frame[keys].astype(object).where(frame[keys].notna(), None)
        numbers: dict[tuple, int] = {}
        codes = np.array([numbers.setdefault(k, len(numbers)) for k in zip(*[plain[c] for c in keys])], np.int64) if keys else np.zeros(len(frame), np.int64)
        return codes, list(numbers) if keys else [()]

    def of_vectors(frame: pd.DataFrame) -> Iterator[tuple]:
        if not len(frame):
            return
        codes, names = named(frame)
        order = np.argsort(codes, kind="stable")
        x = np.stack(frame[vector].to_numpy()).astype(float)[order]
        starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
        n = np.diff(np.r_[starts, len(x)])
        means = np.add.reduceat(x, starts, axis=0) / n[:, None]
        m2 = np.add.reduceat((x - np.repeat(means, n, axis=0)) ** 2, starts, axis=0) if squares else [None] * len(n)
        for i, code in enumerate(codes[order][starts]):
            yield names[code], (int(n[i]), means[i], m2[i])

    def of_partials(frame: pd.DataFrame) -> Iterator[tuple]:
        codes, names = named(frame) if len(frame) else (np.zeros(0, np.int64), [])
        for i, code in enumerate(codes):
            yield names[code], (int(frame["n"].iloc[i]), np.asarray(frame["mean"].iloc[i], float), np.asarray(frame["m2"].iloc[i], float) if squares else None)

    partial = df.select(*keys, vector).where(F.col(vector).isNotNull()).mapInPandas(summed, schema)
    met = partial.repartition(*keys).sortWithinPartitions(*keys) if keys else partial.repartition(1)
    return met.mapInPandas(merged, schema)


def spread(df: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """Variance and mean of every dimension over the vectors of a group."""
    per = vector_sums(df, group, vector, squares=True)
    return (per.select(*group, "n", F.posexplode(F.arrays_zip("mean", "m2")).alias("dim", "__x"))
            .select(*group, "dim", F.when(F.col("n") > 1, F.col("__x.m2") / (F.col("n") - 1)).alias("variance"), F.col("__x.mean").alias("mean")))


def constraint_audit(df: DataFrame, position: str = "position", velocity: str = "velocity", acceleration: str = "acceleration") -> DataFrame:
    """Largest departures from unit length and from tangency."""
    x = F.col(position)
    return df.agg(F.max(F.abs(norm(x) - 1.0)).alias("position_unit_norm"), F.max(F.abs(dot(F.col(velocity), x))).alias("velocity_tangency"),
                  F.max(F.abs(dot(F.col(acceleration), x))).alias("acceleration_tangency"))


def enforce_constraints(df: DataFrame, position: str = "position", velocity: str = "velocity", acceleration: str = "acceleration") -> DataFrame:
    """Positions on the sphere, velocities and accelerations tangent to it."""
    df = df.withColumn(position, normalize(F.col(position)))
    return df.withColumns({c: tangent(F.col(position), F.col(c)) for c in (velocity, acceleration)})
