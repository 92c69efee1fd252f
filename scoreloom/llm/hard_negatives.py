"""Hard negatives of anchors, by angles to reference directions.

Every row keeps its length and its angles to a few reference directions.  The triangle inequality on the sphere bounds the angle between an anchor and
a row from both sides: it is at least |a - b| and at most min(a + b, 2 pi - a - b) for their angles a and b to any one direction.  The
cosines of these bounds times both lengths, widened by more than any rounding, bound the integer score.  Rows are stored in cells of
one nearest direction and, in a task, sorted by angle, so the rows that can reach a wanted window of scores are a stretch found by
bisection; the other directions thin it out, and only the rest is scored, in whole numbers.

An anchor does not meet a cell at all where the cell's own ranges of angles keep every row of it outside the window.  Cells and their anchors are cut into
parts of bounded size, and every part of the rows meets every part of the anchors, so a hot cell or label is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import cut
from scoreloom.operators.skew import top_per_group

#: Angles are kept as 32-bit floats, off by less than 3e-7; this is what they may be off by, together with an arc cosine's own error.
SLACK = 2e-6
#: Squared lengths up to which a product of two lengths stays a whole 64-bit number.
LONGEST = float(1 << 62)
#: Products of lengths below which every partial sum is exact in a double.
EXACT = float(1 << 52)


@dataclass(frozen=True)
class Plan:
    """``directions`` sampled rows serve as reference directions; ``part`` rows or anchors at most meet in one task."""

    directions: int = 32
    part: int = 8192
    positives: int = 5
    negatives: int = 5
    scale: int = 256
    low: int = 80
    high: int = 100


def whole_rows(rows: DataFrame, plan: Plan, identity: str, vector: str, label: str) -> DataFrame:
    """``id, label, v`` (array<long>): rows that take part, scaled to whole components."""
    v = F.col(vector).cast("array<double>")
    fine = (rows.where(F.col(identity).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
            .select(F.col(identity).cast("long").alias("id"), F.col(label).alias("label"), v.alias("x"))
            .where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))
    short = F.aggregate("x", F.lit(0.0), lambda a, x: a + (F.abs(x) * plan.scale + 1) * (F.abs(x) * plan.scale + 1)) < LONGEST
    return fine.where(short).select("id", "label", F.transform("x", lambda x: F.floor(x * plan.scale).cast("long")).alias("v"))


def one_row_per_id(rows: DataFrame) -> DataFrame:
    """Of rows that repeat an id the one with the least label, then the least vector."""
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


class Directions:
    """Reference directions for vectors of one size; vectors of other sizes have none and share one cell."""

    def __init__(self, vectors: np.ndarray) -> None:
        length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)) if vectors.size else np.ones((len(vectors), 1))
        self.units = vectors[(length > 0)[:, 0]] / length[length > 0][:, None] if len(vectors) else vectors
        self.dims = vectors.shape[1]

    @classmethod
    def sampled(cls, rows: DataFrame, count: int) -> Directions:
        sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
        dims = sizes[0].n if sizes else 0
        some = rows.where((F.size("v") == dims) & F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(count).select("v").collect()
        return cls(np.array([r.v for r in some], np.float64).reshape(len(some), dims))

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        """Angles (rows x directions) of whole vectors; a zero vector, whose scores are all 0, gets right angles."""
        if vectors.shape[1] != self.dims or not len(self.units):
            return np.zeros((len(vectors), 0))
        x = vectors.astype(np.float64)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.arccos(np.clip(x @ self.units.T / np.where(length > 0, length, 1), -1, 1))

    def home(self, angles: np.ndarray) -> np.ndarray:
        return angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(angles), np.int64)


def unpack(column: pd.Series, kind: type) -> np.ndarray:
    """Vectors of equal size, or angles, from their bytes."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1) if len(column) and len(column.iloc[0]) else np.zeros((len(column), 0), kind)


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return np.sqrt((x * x).sum(axis=1))


class Cell:
    """Rows of a part, with their angles sorted for each direction."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.ids, self.labels = rows["id"].to_numpy(np.int64), rows["label"].to_numpy()
        self.vectors, self.angles = unpack(rows["v"], np.int64), unpack(rows["angles"], np.float32).astype(np.float64)
        self.length = lengths_of(self.vectors)
        self.longest = float(self.length.max(initial=0))
        self.floats = self.vectors.astype(np.float64)
        self.order = np.argsort(self.angles, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.angles, self.order, axis=0)

    def window(self, angles: np.ndarray, length: float, low: float, high: float) -> np.ndarray:
        """Places of all rows whose score with an anchor can lie in [low, high]."""
        if not len(angles):
            return np.arange(len(self.ids))
        reach = length * self.longest
        if low > reach + 1:
            return np.zeros(0, np.int64)
        places = None
        if reach > 0 and low > 0:
            # lengths are at most the longest, so a row this far off in angle scores below ``low``
            far = np.arccos(min(1.0, max(-1.0, (low - 1) / reach))) + SLACK
            spans = [(np.searchsorted(self.sorted[:, r], a - far, "left"), np.searchsorted(self.sorted[:, r], a + far, "right"), r) for r, a in enumerate(angles)]
            left, right, r = min(spans, key=lambda s: s[1] - s[0])
            places = self.order[left:right, r]
        else:
            places = np.arange(len(self.ids))
        if not len(places):
            return places
        theirs = self.angles[places]
        least = np.maximum(np.abs(theirs - angles).max(axis=1) - SLACK, 0)
        both = theirs + angles
        most = np.minimum(np.minimum(both, 2 * np.pi - both).min(axis=1) + SLACK, np.pi)
        product = length * self.length[places]
        wide = 1 + 1e-9 * product
        return places[(product * np.cos(least) + wide >= low) & (product * np.cos(most) - wide <= high)]

    def scores(self, places: np.ndarray, vector: np.ndarray, length: float) -> np.ndarray:
        """Whole inner products; by floating point only where every partial sum is exact."""
        if length * self.longest < EXACT:
            return (self.floats[places] @ vector.astype(np.float64)).astype(np.int64)
        return self.vectors[places] @ vector


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, in order."""
    if len(ids) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def best_positives(members: pd.DataFrame, anchors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k first rows of a part for each anchor of the same label; what is scored first sets a floor for the rest."""
    out: dict[str, list] = {"anchor": [], "ids": [], "scores": []}
    if len(members) and len(anchors):
        cell = Cell(members)
        vectors, angles = unpack(anchors["v"], np.int64), unpack(anchors["angles"], np.float32).astype(np.float64)
        for own, vector, turned, length in zip(anchors["id"], vectors, angles, lengths_of(vectors), strict=True):
            floor = -np.inf
            if len(turned) and len(cell.ids) > 8 * k:
                r = int(turned.argmin())
                at = np.searchsorted(cell.sorted[:, r], turned[r])
                some = cell.order[max(0, at - 2 * k):at + 2 * k + 1, r]
                some = some[cell.ids[some] != own]
                if len(some) >= k:
                    floor = float(np.sort(cell.scores(some, vector, length))[-k])
            places = cell.window(turned, length, floor, np.inf)
            places = places[cell.ids[places] != own]
            scores = cell.scores(places, vector, length)
            kept = first(cell.ids[places], scores, k)
            out["anchor"].append(own)
            out["ids"].append(cell.ids[places][kept])
            out["scores"].append(scores[kept])
    return pd.DataFrame(out, dtype=object)  # also right for no rows


def best_negatives(members: pd.DataFrame, anchors: pd.DataFrame, plan: Plan) -> pd.DataFrame:
    """For each anchor and positive the first rows of a part of another label whose score lies in the positive's window."""
    out: dict[str, list] = {"anchor": [], "positive": [], "positive_score": [], "ids": [], "scores": []}
    if len(members) and len(anchors):
        cell = Cell(members)
        vectors, angles = unpack(anchors["v"], np.int64), unpack(anchors["angles"], np.float32).astype(np.float64)
        for own, label, positives, wanted, vector, turned, length in zip(
                anchors["id"], anchors["label"], anchors["positives"], anchors["wanted"], vectors, angles, lengths_of(vectors), strict=True):
            low, high = min(wanted) * plan.low / plan.high - 1, max(wanted) + 1
            places = cell.window(turned, length, low, high)
            places = places[cell.labels[places] != label]
            scores, ids = cell.scores(places, vector, length), cell.ids[places]
            for positive, score in zip(positives, wanted, strict=True):
                fits = np.flatnonzero((scores >= -(-plan.low * int(score) // plan.high)) & (scores <= score))
                kept = fits[first(ids[fits], scores[fits], plan.negatives)]
                if len(kept):
                    for name, value in zip(out, (own, positive, score, ids[kept], scores[kept]), strict=True):
                        out[name].append(value)
    return pd.DataFrame(out, dtype=object)  # also right for no rows


def parted(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Number of parts of at most about ``size`` rows for each key."""
    return rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))


def meet(members: DataFrame, anchors: DataFrame, keys: list[str], plan: Plan) -> tuple:
    """Rows and anchors of equal keys, grouped so that each part of one meets each part of the other."""
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # they may come from the same rows
    parts = parted(members, keys, plan.part, "nm").join(parted(anchors, keys, plan.part, "na"), keys)
    part = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = members.join(parts, keys).withColumn("mp", part("nm")).withColumn("ap", spread("na")).drop("nm", "na")
    right = anchors.join(parts, keys).withColumn("ap", part("na")).withColumn("mp", spread("nm")).drop("nm", "na")
    return left.groupBy(*keys, "mp", "ap").cogroup(right.groupBy(*keys, "mp", "ap"))


def hard_negatives(rows: DataFrame, anchor: Column, plan: Plan = Plan(), identity: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows for which ``anchor`` (on ``id``) holds.

    Scores are inner products of ``floor(scale * x)``.  An anchor's positives are its first rows of the same label, a positive's
    negatives the first rows of other labels that score from ``low`` % of it up to it.  Rows with a null id, label or vector, or a null or non-finite
    component take no part, nor do rows so long (about 2^31 after scaling) that a score could leave 64 bits.  Of rows that repeat an id the one of
    least label and then vector counts.  Vectors of different sizes have no score.  An empty vector scores 0.  Empty tables give no rows; other columns
    are not read.
    """
    base = cut(one_row_per_id(whole_rows(rows, plan, identity, vector, label)))
    directions = Directions.sampled(base, plan.directions)
    kind = base.schema["label"].dataType.simpleString()

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len).to_numpy()
            for size in np.unique(sizes):
                some = batch[sizes == size]
                vectors = np.array(some["v"].tolist(), np.int64).reshape(len(some), size)
                angles = directions.angles(vectors)
                yield pd.DataFrame({"id": some["id"].to_numpy(), "label": some["label"].to_numpy(), "dims": size, "cell": directions.home(angles), "v": [v.tobytes() for v in vectors],
                                    "angles": [a.tobytes() for a in angles.astype(np.float32)]})

    index = cut(base.mapInPandas(placed, f"id bigint, label {kind}, dims int, cell int, v binary, angles binary"))
    asked = index.where(anchor)
    positives = (meet(index.drop("cell"), asked.drop("cell"), ["dims", "label"], plan)
                 .applyInPandas(lambda m, a: best_positives(m, a, plan.positives), "anchor bigint, ids array<bigint>, scores array<bigint>")
                 .select("anchor", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("anchor", F.col("x.ids").alias("positive"), F.col("x.scores").alias("score")))
    chosen = cut(top_per_group(positives, ["anchor"], [F.desc("score"), F.asc("positive")], plan.positives).where("score >= 0"))  # below 0 the window is empty
    wanted = chosen.groupBy("anchor").agg(F.collect_list(F.struct("positive", "score")).alias("x")).select(
        F.col("anchor").alias("id"), F.col("x.positive").alias("positives"), F.col("x.score").alias("wanted"))
    ranges = cell_ranges(index, directions.dims, len(directions.units))

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (_, anchors) in batch.groupby("dims"):
                angles = unpack(anchors["angles"], np.float32).astype(np.float64)
                if not angles.shape[1]:
                    yield anchors.assign(cell=0)
                    continue
                lengths, low = lengths_of(unpack(anchors["v"], np.int64)), np.array([min(w) for w in anchors["wanted"]]) * plan.low / plan.high - 1
                for cell, (longest, least, most) in ranges.items():
                    apart = np.maximum(np.maximum(least - angles, angles - most).max(axis=1) - SLACK, 0)
                    product = lengths * longest
                    near = product * np.where(apart < np.pi / 2, np.cos(apart), 0) + 1 + 1e-9 * product >= low
                    if near.any():
                        yield anchors[near].assign(cell=cell)

    travelling = asked.drop("cell").join(wanted, "id")
    arriving = cut(travelling.mapInPandas(reached, f"id bigint, label {kind}, dims int, v binary, angles binary, positives array<bigint>, wanted array<bigint>, cell int"))
    found = meet(index, arriving, ["dims", "cell"], plan).applyInPandas(
        lambda m, a: best_negatives(m, a, plan), "anchor bigint, positive bigint, positive_score bigint, ids array<bigint>, scores array<bigint>")
    pairs = found.select("anchor", "positive", "positive_score", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("x.ids").alias("negative_id"), "positive_score", F.col("x.scores").alias("negative_score"))
    return top_per_group(pairs, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.asc("negative_id")], plan.negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def cell_ranges(index: DataFrame, dims: int, directions: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Longest row and least and greatest angle to each direction of every cell of the directions' size; as many cells as directions at most."""
    if not directions:
        return {}

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, rows in batch.groupby("cell"):
                angles = unpack(rows["angles"], np.float32).astype(np.float64)
                yield pd.DataFrame({"cell": cell, "r": range(directions), "longest": lengths_of(unpack(rows["v"], np.int64)).max(), "least": angles.min(axis=0), "most": angles.max(axis=0)})

    per = index.where(F.col("dims") == dims).select("cell", "v", "angles").mapInPandas(summed, "cell int, r int, longest double, least double, most double")
    rows = per.groupBy("cell", "r").agg(F.max("longest").alias("longest"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
    cells: dict[int, dict] = {}
    for r in rows:
        cells.setdefault(r["cell"], {})[r["r"]] = r
    return {cell: (by[0]["longest"], np.array([by[i]["least"] for i in range(directions)]), np.array([by[i]["most"] for i in range(directions)])) for cell, by in cells.items()}
