"""Vectors as array columns: distances and the geometry of the unit sphere.

Inputs may be arrays of float; sums run in double.  Everything is an expression inside the JVM.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.running import flat, nested
from scoreloom.functions.values import let

NEAR_ZERO = 1e-10


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(u: Column, v: Column) -> Column:
    return total(F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def scale(v: Column, by: Column) -> Column:
    return let(by, lambda k: F.transform(v, lambda x: x.cast("double") * k))


def add(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a.cast("double") + b.cast("double"))


def subtract(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a.cast("double") - b.cast("double"))


def mix(u: Column, a: Column, v: Column, b: Column) -> Column:
    """a u + b v, with the factors evaluated once."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda k: F.zip_with(
        u, v, lambda x, y: k["a"] * x.cast("double") + k["b"] * y.cast("double")))


def _or_one(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(x)


def normalize(v: Column) -> Column:
    """v / |v|; the zero vector stays as it is."""
    return let(_or_one(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def chord(u: Column, v: Column) -> Column:
    return norm(subtract(u, v))


def arc(u: Column, v: Column) -> Column:
    """Angle between unit vectors (they are not normalised here)."""
    return F.acos(clamp(dot(u, v)))


def cosine_distance(u: Column, v: Column) -> Column:
    return 1.0 - dot(u, v) / (norm(u) * norm(v))


def geodesic(u: Column, v: Column) -> Column:
    """Angle between vectors of any length; a zero vector counts as length 1."""
    return F.acos(clamp(dot(u, v) / _or_one(norm(u) * norm(v))))


METRICS = {"chord": chord, "arc": arc, "cosine": cosine_distance, "l2": chord, "dot": dot, "geodesic": geodesic}


def tangent(x: Column, v: Column) -> Column:
    """The part of v that is tangent to the sphere at x."""
    return mix(v, F.lit(1.0), x, -dot(v, x))


def exp_map(x: Column, v: Column) -> Column:
    """From x along the great circle in direction v."""
    return let(F.struct(x.alias("x"), v.alias("v"), norm(v).alias("n")), lambda p: mix(
        p["x"], F.cos(p["n"]), p["v"], F.sin(p["n"]) / _or_one(p["n"])))


def log_map(x: Column, y: Column) -> Column:
    """Tangent at x that points to y; close to zero at y = x and also at the antipode."""
    def point(p):
        bend = F.sin(F.acos(p["c"]))
        k = F.when(F.abs(bend) < NEAR_ZERO, 1.0).otherwise(F.acos(p["c"]) / bend)
        return let(k, lambda f: mix(p["y"], f, p["x"], -f * p["c"]))
    return let(F.struct(x.alias("x"), y.alias("y"), clamp(dot(x, y)).alias("c")), point)


def parallel_transport(x: Column, y: Column, v: Column) -> Column:
    """Carry the tangent v from x to y along the great circle between them."""
    return let(F.struct(normalize(log_map(x, y)).alias("there"), normalize(log_map(y, x)).alias("back"), v.alias("v")), lambda p: let(
        dot(p["v"], p["there"]), lambda k: F.zip_with(p["v"], add(p["there"], p["back"]), lambda a, b: a.cast("double") - k * b)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def to_spherical(x: pa.Array) -> pa.Array:
    """d-1 angles of a unit vector: all in [0, pi] but the last, which is in [0, 2 pi).

    An angle needs the length of the tail that begins at its coordinate; all tails are one running sum from the back.
    """
    values, edges = flat(x, np.float64)
    out = np.zeros(len(values))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        v = values[lo:hi]
        tails = np.sqrt(np.cumsum((v * v)[::-1]))[::-1]
        out[lo:hi] = np.arccos(np.clip(v / np.where(tails > 0, tails, 1.0), -1.0, 1.0))
        if hi - lo > 1 and v[-1] < 0:
            out[hi - 2] = 2 * math.pi - out[hi - 2]
    short = np.maximum(np.diff(edges) - 1, 0)
    kept = np.ones(len(values), bool)
    kept[edges[1:][np.diff(edges) > 0] - 1] = False
    return nested(x, out[kept], np.r_[0, np.cumsum(short)], pa.float64())


def _sine_products(angles: np.ndarray) -> np.ndarray:
    """1, sin a1, sin a1 sin a2, ... : one entry per coordinate."""
    return np.r_[1.0, np.cumprod(np.sin(angles))]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def from_spherical(angles: pa.Array) -> pa.Array:
    """Unit vector with the given angles."""
    values, edges = flat(angles, np.float64)
    rows = [_sine_products(values[lo:hi]) * np.r_[np.cos(values[lo:hi]), 1.0] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return nested(angles, np.concatenate(rows) if rows else np.zeros(0), edges + np.arange(len(edges)), pa.float64())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def angular_to_tangent(angles: pa.Array, rates: pa.Array) -> pa.Array:
    """Ambient velocity of a point whose angles change at the given rates.

    Uses the exact derivative: coordinate i moves by -sin(a_i) P_i w_i from its own angle and by
    x_i cot(a_k) w_k from each earlier one, P being the product of the earlier sines.
    """
    (turns, edges), (speeds, _) = flat(angles, np.float64), flat(rates, np.float64)
    rows = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        a, w = turns[lo:hi], speeds[lo:hi]
        sines, products = np.sin(a), _sine_products(a)
        x = products * np.r_[np.cos(a), 1.0]
        earlier = np.r_[0.0, np.cumsum(np.cos(a) / np.where(sines == 0, 1.0, sines) * w)]
        v = products * np.r_[-sines * w, 0.0] + x * earlier
        rows.append(v - (v @ x) * x)
    return nested(angles, np.concatenate(rows) if rows else np.zeros(0), edges + np.arange(len(edges)), pa.float64())


def kinetic_energy(v: Column) -> Column:
    return 0.5 * dot(v, v)


def softmax_top(logits: Column, k: int) -> Column:
    """array<struct<token_id, probability>>: the k most likely entries, ties to the lower id."""
    def rank(p):
        ranked = F.array_sort(F.transform(p["v"], lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                              lambda a, b: F.when(a["x"] > b["x"], -1).when(a["x"] < b["x"], 1).otherwise(a["i"] - b["i"]))
        weight = total(F.transform(p["v"], lambda x: F.exp(x - p["top"])))
        return let(weight, lambda z: F.transform(F.slice(ranked, 1, k), lambda e: F.struct(
            e["i"].alias("token_id"), (F.exp(e["x"] - p["top"]) / z).alias("probability"))))
    return let(F.struct(doubles(logits).alias("v"), F.array_max(doubles(logits)).alias("top")), rank)
