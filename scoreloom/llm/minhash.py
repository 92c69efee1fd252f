"""Near duplicates by b-bit MinHash: bands give candidates, bit counts an estimate, full sets the confirmation.

Texts with equal sets of shingles form a class, and one row a class goes on.  Bands of minima put classes into buckets.  First every
member of a bucket is held against the bucket's least member: the low bits of their minima, packed into words, give a similarity
corrected for chance agreement; pairs far below the threshold go, the others are confirmed on full sets, and confirmed
links join classes to components.  Buckets whose members are then still in several components are compared as a whole, in cells of
bounded size; a cell reports only links that join two components.  So links of all pairs that share a band are found or implied,
and no list of all pairs of a bucket is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import cut
from scoreloom.llm.components import components
from scoreloom.llm.words import mixed, word_hashes

SHINGLES = 256  # shingles times functions that are hashed together stay in a core's cache


@dataclass(frozen=True)
class Plan:
    """Words in a shingle, bands and minima in a band, bits kept of a minimum, least similarity in percent, and how far below it (as a share) estimates may lie."""

    shingle: int = 5
    bands: int = 32
    rows: int = 5
    bits: int = 2
    percent: int = 80
    slack: float = 0.2
    seed: int = 4

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        many = self.bands * self.rows
        return rng.integers(0, 1 << 63, many, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, many, dtype=np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the shingles: runs of ``size`` words in lower case A-Z, the whole of a shorter text, none without words."""
    ids = word_hashes(text)
    if not len(ids):
        return ids
    width = min(size, len(ids))
    h = np.full(len(ids) - width + 1, width, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i:len(ids) - width + 1 + i]
        h ^= h >> np.uint64(29)
    return np.unique(mixed(h))


def sketch(h: np.ndarray, plan: Plan, odd: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of a non-empty set."""
    low = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), SHINGLES):
        np.minimum(low, ((h[None, at:at + SHINGLES] ^ salt[:, None]) * odd[:, None]).min(axis=1), out=low)
    keys = np.zeros(plan.bands, np.uint64)
    for column in low.reshape(plan.bands, plan.rows).T:
        keys = mixed(keys * np.uint64(31) + column)
    lanes = 64 // plan.bits
    kept = np.zeros(-(-len(low) // lanes) * lanes, np.uint64)
    kept[:len(low)] = mixed(low) & np.uint64((1 << plan.bits) - 1)
    packed = (kept.reshape(-1, lanes) << (np.arange(lanes, dtype=np.uint64) * np.uint64(plan.bits))).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def signatures(docs: DataFrame, plan: Plan, text: str, identity: str) -> DataFrame:
    """``id, n, class, keys, bits`` of each document; class, keys and bits are null for a text without words."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odd, salt = plan.functions()
        for batch in batches:
            n, name, keys, bits = [], [], [], []
            for body in batch["text"]:
                h = shingle_set(body, plan.shingle)
                n.append(len(h))
                if len(h):
                    name.append(xxhash.xxh3_128_digest(h.tobytes()))
                    k, b = sketch(h, plan, odd, salt)
                    keys.append(k), bits.append(b)
                else:
                    name.append(None), keys.append(None), bits.append(None)
            yield pd.DataFrame({"id": batch["id"], "n": n, "class": name, "keys": keys, "bits": bits})

    return docs.select(F.col(identity).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(
        work, "id bigint, n bigint, class binary, keys array<bigint>, bits array<bigint>")


def lanes_apart(a: Column, b: Column, plan: Plan) -> Column:
    """Number of minima whose kept bits differ."""
    ones = sum(1 << i for i in range(0, 64, plan.bits))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    words = -(-plan.bands * plan.rows // (64 // plan.bits))
    total = F.lit(0)
    for i in range(words):
        x = F.get(a, i).bitwiseXOR(F.get(b, i))
        for k in range(1, plan.bits):
            x = x.bitwiseOR(F.shiftrightunsigned(F.get(a, i).bitwiseXOR(F.get(b, i)), k))
        total = total + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return total


def estimate(apart, plan: Plan):
    """Similarity from the number of minima that differ: agreement by chance, 2^-bits, taken off."""
    chance = 2.0 ** -plan.bits
    return (1 - apart / float(plan.bands * plan.rows) - chance) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether intersection and union of two sorted sets reach the threshold."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``u``, ``v``) whose full sets reach the threshold."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch.loc[keep, ["u", "v"]]

    a, b = sets.select(F.col("id").alias("u"), F.col("set").alias("a")), sets.select(F.col("id").alias("v"), F.col("set").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInPandas(work, "u bigint, v bigint")


def joining_links(left: pd.DataFrame, right: pd.DataFrame | None, plan: Plan) -> pd.DataFrame:
    """Confirmed links inside a cell (``right`` None) or across two, only as many as join different components.

    A pair is looked at in the first band that it shares, so once however many buckets hold both.
    """
    cells = left if right is None else pd.concat([left, right], ignore_index=True)
    ids, where = cells["id"].to_numpy(np.int64), cells["component"].to_numpy(np.int64)
    bits = np.array(cells["bits"].tolist(), np.int64).view(np.uint64)
    keys, band = np.array(cells["keys"].tolist(), np.int64), int(cells["band"].iloc[0])
    sets = [np.frombuffer(s, np.uint64) for s in cells["set"]]
    above = {c: c for c in where.tolist()}

    def top(c):
        while above[c] != c:
            above[c] = c = above[above[c]]
        return c

    ones = np.uint64(sum(1 << i for i in range(0, 64, plan.bits)))
    out, start = [], 0 if right is None else len(left)
    for i in range(len(ids) if right is None else len(left)):
        j0 = max(i + 1, start)
        x = bits[j0:] ^ bits[i]
        y = x.copy()
        for k in range(1, plan.bits):
            y |= x >> np.uint64(k)
        near = estimate(np.bitwise_count(y & ones).sum(axis=1), plan)
        wanted = np.flatnonzero((near >= plan.percent / 100 - plan.slack) & (where[j0:] != where[i]))
        if len(wanted) and band:
            wanted = wanted[~(keys[j0 + wanted, :band] == keys[i, :band]).any(axis=1)]
        for j in wanted:
            if (a := top(where[i])) != (b := top(where[j0 + j])) and similar(sets[i], sets[j0 + j], plan.percent):
                above[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j0 + j]))
    return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), text: str = "text", identity: str = "doc_id", cell: int = 1024) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row: components of all links of similarity ``plan.percent`` or more.

    ``component_id`` is the least id reachable, ``kept`` says whether that is the row's own.  A text that is null or has no words links
    with nothing; so does a row with a null id, whose component is null and which is kept.  Repeated rows give
    repeated results; an empty table gives none.  Other columns are not read.  A link is missed only if all bands differ: at the
    threshold, with 32 bands of 5, three in a million.
    """
    signed = cut(signatures(docs, plan, text, identity))
    classes = cut(signed.where("id is not null and n > 0").groupBy("class").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("bits").alias("bits")))
    banded = classes.select("id", F.posexplode("keys").alias("band", "key"))
    buckets = cut(banded.groupBy("band", "key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("many")).where("many > 1"))
    members = cut(banded.join(buckets, ["band", "key"]).select("band", "key", "pivot", "id", "many"))
    bits = cut(classes.join(members.select("id").distinct(), "id").select("id", "bits", "keys"))

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, body in zip(batch["id"], batch["text"], strict=True):
                yield pd.DataFrame({"id": [i], "set": [shingle_set(body, plan.shingle).tobytes()]})

    texts = docs.select(F.col(identity).cast("long").alias("id"), F.col(text).alias("text"))
    sets = cut(texts.join(bits.select("id"), "id", "left_semi").mapInPandas(full, "id bigint, set binary").groupBy("id").agg(F.max("set").alias("set")))
    pairs = members.where("pivot <> id").select(F.col("pivot").alias("u"), F.col("id").alias("v")).distinct()
    close = (pairs.join(bits.select(F.col("id").alias("u"), F.col("bits").alias("p")), "u").join(bits.select(F.col("id").alias("v"), F.col("bits").alias("q")), "v")
             .where(estimate(lanes_apart(F.col("p"), F.col("q"), plan), plan) >= plan.percent / 100 - plan.slack).select("u", "v"))
    links = cut(confirmed(close, sets, plan.percent))
    joined = cut(components(links))
    labelled = members.join(joined, "id", "left").select("band", "key", "id", "many", F.coalesce("component", "id").alias("component"))
    split = labelled.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band", "key")
    open_buckets = cut(labelled.join(split, ["band", "key"]))
    if not open_buckets.isEmpty():
        parts = F.ceil(F.col("many") / cell).cast("int")
        part = open_buckets.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        # cell (x, y) with x <= y: the members of part x against those of part y
        cells = part.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
            F.least(F.col("part"), o).alias("x"), F.greatest(F.col("part"), o).alias("y")))))
        fed = cells.select("band", "key", "at.x", "at.y", (F.col("part") == F.col("at.x")).alias("first"), "id", "component").join(bits, "id").join(sets, "id")

        def compare(one: pd.DataFrame) -> pd.DataFrame:
            if one["x"].iloc[0] == one["y"].iloc[0]:
                return joining_links(one, None, plan)
            return joining_links(one[one["first"]], one[~one["first"]], plan)

        more = cut(fed.groupBy("band", "key", "x", "y").applyInPandas(compare, "u bigint, v bigint"))
        joined = cut(components(links.union(more)))
    named = (classes.select("class", F.col("id").alias("rep")).join(joined.withColumnRenamed("id", "rep"), "rep", "left")
             .select(F.col("class").alias("c2"), F.coalesce("component", "rep").alias("least")))
    placed = signed.select("id", "n", "class").join(named, F.col("class") == F.col("c2"), "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("least", "id"))
    return placed.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
