"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact distances.

Each of several tables cuts a few random projections of the vectors into intervals; a bucket is one interval of each.  A query visits the
buckets of a table in the order of the estimated chance that a neighbour lies there, until the chances add up to a wanted
share.  Every row is in every table.  A visited bucket is compared as a whole, by exact inner products, and gives the query its best rows
of it, so no pair of query and candidate is ever a row of Spark.

The largest inner product is the least distance once rows are scaled by the largest length R and get the coordinate
sqrt(1 - |x|^2 / R^2), and queries are scaled to length 1 and get 0.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import cut
from scoreloom.operators.skew import top_per_group

SPAN = 64  # interval numbers are kept in [-SPAN, SPAN)


@dataclass(frozen=True)
class Hashing:
    """Parameters of the tables.  ``near`` is the distance (of scaled vectors) for which chances are estimated."""

    tables: int = 6
    functions: int = 2
    width: float = 1.0
    near: float = 1.25
    success: float = 0.5
    seed: int = 9

    def planes(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(self.tables, dims, self.functions)), rng.uniform(0, self.width, (self.tables, 1, self.functions))

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Projections in units of intervals, of shape (tables, vectors, functions)."""
        planes, shifts = self.planes(vectors.shape[1])
        return (np.einsum("nd,tdf->tnf", vectors, planes) + shifts) / self.width

    def key(self, intervals: np.ndarray) -> np.ndarray:
        """One number for the intervals of a bucket."""
        held = np.clip(intervals, -SPAN, SPAN - 1).astype(np.int64) + SPAN
        return held @ (np.int64(2 * SPAN) ** np.arange(self.functions, dtype=np.int64))

    def probes(self, place: np.ndarray) -> np.ndarray:
        """Buckets of one table for a query at ``place``, likeliest first, until the wanted share is reached."""
        home, spread = np.floor(place), self.near / self.width
        reach = max(1, math.ceil(3 * spread))
        steps = np.arange(-reach, reach + 1)
        low = (home[:, None] + steps[None, :] - place[:, None]) / spread
        bell = np.vectorize(lambda x: 0.5 * math.erf(x / math.sqrt(2)))
        chance = bell(low + 1 / spread) - bell(low)
        grid = np.array(list(itertools.product(range(len(steps)), repeat=self.functions)))
        share = np.prod([chance[f, grid[:, f]] for f in range(self.functions)], axis=0)
        order = np.argsort(-share, kind="stable")
        many = int(np.searchsorted(np.cumsum(share[order]), self.success)) + 1
        return np.unique(self.key(home[None, :] + steps[grid[order[:many]]]))


def usable(rows: DataFrame, identity: str, vector: str) -> DataFrame:
    """Identity and vector (double) of rows that take part: an identity, no null or non-finite component, not zero, the commonest number of dimensions."""
    v = F.col(vector).cast("array<double>")
    fine = rows.where(F.col(identity).isNotNull() & F.col(vector).isNotNull()).select(F.col(identity).alias("id"), v.alias("v")).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return fine.where(F.size("v") == (sizes[0].n if sizes else 0))


def pack(vectors: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(vectors)]


def best_of_cell(members: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best members for each query of a cell, ties to the smaller id; scores are exact sums, equal for equal vectors."""
    out: dict[str, list] = {"query_id": [], "ids": [], "scores": []}
    if len(members) and len(queries):
        ids = members["id"].to_numpy(np.int64)
        vectors = np.frombuffer(b"".join(members["v"]), np.float64).reshape(len(ids), -1)
        asked = np.frombuffer(b"".join(queries["v"]), np.float64).reshape(len(queries), -1)
        own = queries["id"].to_numpy(np.int64)
        for at in range(0, len(own), 256):
            rough = asked[at:at + 256] @ vectors.T
            rough[ids[None, :] == own[at:at + 256, None]] = -np.inf
            if len(ids) > k:
                floor = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
            else:
                floor = np.full(len(rough), -np.inf)
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
            for i, row in enumerate(rough):
                near = np.flatnonzero((row >= floor[i] - slack[i]) & (row > -np.inf))
                scores = (vectors[near] * asked[at + i]).sum(axis=1)
                first = np.lexsort((ids[near], -scores))[:k]
                out["query_id"].append(own[at + i])
                out["ids"].append(ids[near][first])
                out["scores"].append(scores[first])
    return pd.DataFrame(out)


def nearest(rows: DataFrame, identity: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, hashing: Hashing = Hashing(),
            cell: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each row whose id is divisible by ``every``, nearest first.

    Buckets with more than ``cell`` rows, or asked by more than ``cell`` queries, are cut into cells, and each part of the rows meets
    each part of the queries.  A query that found fewer than k rows though there are more is compared with all rows, in
    the same cells.  Rows that ``usable`` leaves out take no part; repeated ids are one candidate, with their best score; an
    empty table gives no rows.
    """
    spark = rows.sparkSession
    index = cut(usable(rows, identity, vector))
    facts = index.agg(F.count_distinct("id").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("r")).first()
    scale = facts.r or 1.0

    def tabled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = np.array(batch["v"].tolist(), np.float64).reshape(len(batch), -1)
            if not len(v):
                continue
            x = v / scale
            rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1, keepdims=True)))
            keys = hashing.key(np.floor(hashing.places(np.hstack([x, rest]))))
            for t in range(hashing.tables):
                yield pd.DataFrame({"t": t, "bucket": keys[t], "id": batch["id"], "v": pack(v)})

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = np.array(batch["v"].tolist(), np.float64).reshape(len(batch), -1)
            if not len(v):
                continue
            places = hashing.places(np.hstack([v / np.sqrt((v * v).sum(axis=1, keepdims=True)), np.zeros((len(v), 1))]))
            for i, (own, body) in enumerate(zip(batch["id"], pack(v), strict=True)):
                for t in range(hashing.tables):
                    yield pd.DataFrame({"t": t, "bucket": hashing.probes(places[t, i]), "id": own, "v": body})

    asked = index.where(F.col("id") % every == 0)
    schema, keys = "t int, bucket bigint, id bigint, v binary", ["t", "bucket", "mp", "qp"]
    members, queries = index.mapInPandas(tabled, schema), asked.mapInPandas(probed, schema)

    def search(queries: DataFrame, members: DataFrame) -> DataFrame:
        count = lambda df, name: df.groupBy("t", "bucket").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / cell)).cast("int").alias(name))
        parts = count(members, "nm").join(count(queries, "nq"), ["t", "bucket"])
        part = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
        spread = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        left = members.join(parts, ["t", "bucket"]).select("t", "bucket", "id", "v", part("nm").alias("mp"), spread("nq").alias("qp"))
        right = queries.join(parts, ["t", "bucket"]).select("t", "bucket", "id", "v", part("nq").alias("qp"), spread("nm").alias("mp"))
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            lambda m, q: best_of_cell(m, q, k), "query_id bigint, ids array<bigint>, scores array<double>")
        pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).groupBy("query_id", F.col("x.ids").alias("vec_id")).agg(
            F.max("x.scores").alias("score"))
        return top_per_group(pairs, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "score")

    found = cut(search(queries, members))
    need = min(k, facts.n - 1)
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
    short = cut(asked.select("id", "v").join(full, asked["id"] == full["query_id"], "left_anti"))
    if need < 1 or short.isEmpty():
        return found
    # the buckets of one table hold every row once; their number is bounded by the intervals a table has
    one = members.where("t = 0")
    everywhere = spark.createDataFrame([(r.bucket,) for r in one.select("bucket").distinct().collect()], "bucket bigint")
    packed = short.mapInPandas(lambda batches: (pd.DataFrame({"id": b["id"], "v": pack(np.array(b["v"].tolist(), np.float64))}) for b in batches if len(b)), "id bigint, v binary")
    buckets = F.array(*[F.lit(r.bucket) for r in everywhere.collect()])
    rest = search(packed.select(F.lit(0).alias("t"), F.explode(buckets).alias("bucket"), "id", "v"), one)
    return found.join(short.select("id"), found["query_id"] == short["id"], "left_anti").unionByName(rest)
