"""Sampled splitters: size-weighted samples of a key give quantile boundaries, boundaries give ranges, overfull ranges are subdivided.

No row is ever sorted together with a whole range that is overfull: ranges above a number of rows or of bytes are cut into pieces by a hash, of the
key as long as no key is overfull itself, else of the row's identity and of its number among equal rows.  Sizes are added up along
ranges, pieces and rows, each level inside the one above it, so no window holds more than a piece, or the pieces of a range.

Shards are runs of that order.  A key that is small goes whole to the shard of its middle, the rows of a large key each to theirs.  Rows that are
themselves large against a shard, a bounded number of them, are dealt first, the largest first to the emptiest shard, and the others fill
what room is left.
"""

from __future__ import annotations

import heapq
import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import cut

LEVEL = 32  # boundaries are found in two looks at LEVEL values each


def splitters(rows: DataFrame, key: str, size: str, identity: list[str], samples: int = 16_384) -> list:
    """LEVEL * LEVEL - 1 quantile boundaries of the key, each row drawn as often as its size asks for (``samples`` draws expected).

    A row of size s is drawn floor(s * samples / total) times and once more with the probability of the rest; the draw is a hash of
    the key and the identity, so reruns agree.  The sample's size is bounded by 2 * samples whatever the table.
    """
    total = rows.agg(F.sum(size)).first()[0]
    if not total:
        return []
    wanted = F.col(size) * (samples / total)
    chance = F.pmod(F.xxhash64(F.lit(7), key, *identity), F.lit(1 << 52)) / F.lit(float(1 << 52))
    times = (F.floor(wanted) + (chance < wanted - F.floor(wanted)).cast("long")).cast("int")
    drawn = rows.where(F.col(key).isNotNull()).select(key, times.alias("__times")).where("__times > 0").groupBy(key).agg(F.sum("__times").alias("__times"))
    found = sorted((r[0], r[1]) for r in drawn.collect())  # at most 2 * samples rows
    many, out, seen = sum(n for _, n in found), [], 0
    for value, n in found:
        seen += n
        out += [value] * (seen * LEVEL * LEVEL // many - len(out))
    return out[:LEVEL * LEVEL - 1]


def range_of(key: str, bounds: list) -> F.Column:
    """Number of boundaries below the key: the range that holds it. Null keys go to range 0."""
    if not bounds:
        return F.lit(0)
    padded = bounds + [bounds[-1]] * (LEVEL * LEVEL - 1 - len(bounds))
    k, below = F.col(key), lambda marks: F.size(F.filter(marks, lambda b: b < F.col(key)))
    coarse = F.array(*[F.lit(padded[i]) for i in range(LEVEL - 1, LEVEL * LEVEL - 1, LEVEL)])
    fine = F.array(*[F.array(*[F.lit(b) for b in padded[i * LEVEL:(i + 1) * LEVEL - 1]]) for i in range(LEVEL)])
    first = below(coarse)
    return F.when(k.isNull(), 0).otherwise(first * LEVEL + below(F.get(fine, first))).cast("int")


def numbered_copies(rows: DataFrame, chunk: int = 4096) -> DataFrame:
    """The rows with ``__copy``, their number among equal rows.

    Equal rows are counted, combined before the shuffle, and written out again in chunks that any task may take.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__many"))
    chunks = counted.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__many") - 1) / chunk))))
    spread = chunks.repartition(*names, "__chunk")
    upto = F.least(F.col("__many"), (F.col("__chunk") + 1) * chunk) - 1
    return spread.withColumn("__copy", F.explode(F.sequence(F.col("__chunk") * chunk, upto))).drop("__many", "__chunk")


def dealt_first(rows: list, target: float, shards: int) -> tuple[list[int], list[int]]:
    """Shards of large rows (key, size), in their order, and the sizes that each shard got: the largest unit goes to the emptiest shard.

    Rows of one key are one unit as long as they fill at most a 16th of a shard.
    """
    units: dict = {}
    for at, (key, size) in enumerate(rows):
        units.setdefault(key, []).append((at, size))
    whole = lambda own: sum(s for _, s in own) <= target / 16
    parts = [own for group in units.values() for own in ([group] if whole(group) else [[one] for one in group])]
    parts.sort(key=lambda own: (-sum(s for _, s in own), own[0][0]))
    place, heap = [0] * len(rows), [(0, s) for s in range(shards)]
    filled = [0] * shards
    for own in parts:
        _, shard = heapq.heappop(heap)
        for at, size in own:
            place[at] = shard
            filled[shard] += size
        heapq.heappush(heap, (filled[shard], shard))
    return place, filled


def rooms(filled: list[int], total: float) -> list[float]:
    """Where the room of each shard ends, on the scale of all sizes that are still to be dealt: shards are filled to one level."""
    rest, level = total - sum(filled), 0.0
    order = sorted(filled)
    for i in range(len(order)):
        level = (rest + sum(order[:i + 1])) / (i + 1)
        if i + 1 == len(order) or level <= order[i + 1]:
            break
    room = [max(0.0, level - f) for f in filled]
    scale = rest / sum(room) if sum(room) else 0.0
    return list(itertools.accumulate(r * scale for r in room))


def range_shards(rows: DataFrame, shards: int, key: str, size: str, identity: list[str], piece_rows: int = 20_000, fine: int = 128) -> DataFrame:
    """The rows with ``shard`` (0 to shards - 1, sizes near equal) and ``slot`` (gapless from 0 in its shard).

    Rows of one key lie side by side and share a shard, unless together they exceed a ``fine``-th of a shard's size.  Any column may be null;
    an empty table stays empty; equal rows are interchangeable, and reruns agree whatever the partitions.  Columns ``shard`` and ``slot`` are replaced.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    facts = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    whole, target = facts.b, facts.b / shards
    most = max(1.0, target / fine)  # rows above it are at most shards * fine
    copies = numbered_copies(rows.select(*kept))
    ranged = cut(copies.withColumn("__range", range_of(key, splitters(rows, key, size, identity))))
    line = Window.orderBy(key, F.desc(size), *identity, "__copy")
    large = ranged.where(F.col(size) > most).withColumn("__at", F.row_number().over(line) - 1)
    place, filled = dealt_first([(r[0], r[1]) for r in large.orderBy("__at").select(key, size).collect()], target, shards)
    array = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    large = large.withColumn("shard", F.get(array(place, "int"), F.col("__at").cast("int")))
    of_shard = Window.partitionBy("shard").orderBy("__at")
    large = large.withColumn("slot", (F.row_number().over(of_shard) - 1).cast("long")).select(*kept, "shard", "slot")
    taken = [place.count(s) for s in range(shards)]

    small = ranged.where(F.col(size) <= most)
    fill = {r[0]: max(1, -(-r[1] // piece_rows), math.ceil(r[2] / most / 16)) for r in small.groupBy("__range").agg(F.count(F.lit(1)), F.sum(size)).collect()}
    pieces_of = F.get(F.array(*[F.lit(fill.get(i, 1)) for i in range(LEVEL * LEVEL)]), F.col("__range"))  # at most LEVEL * LEVEL ranges
    # a hash of the key first: a range of several keys is cut between keys as long as no single key is overfull
    heavy = (small.groupBy("__range", key).agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__b")).where((F.col("__n") > piece_rows) | (F.col("__b") > most))
             .select(F.col("__range").alias("__r2"), F.col(key).alias("__heavy"), F.lit(True).alias("__is")))
    marked = small.join(heavy, (F.col("__range") == F.col("__r2")) & F.col(key).eqNullSafe(F.col("__heavy")), "left").withColumn("__is", F.coalesce("__is", F.lit(False)))
    by = F.when(F.col("__is"), F.xxhash64(key, *identity, size, "__copy")).otherwise(F.xxhash64(F.lit(3), key))
    placed = marked.withColumn("__piece", F.pmod(by, pieces_of).cast("long")).drop("__r2", "__heavy")
    upto = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda total: F.coalesce(total, F.lit(0))

    def bases(counted: DataFrame, amount: str, name: str, group: list[str]) -> DataFrame:
        """The amount in front of each piece of its group: ranges first, at most LEVEL * LEVEL of them, then the pieces of a range."""
        ranges = counted.groupBy(*group, "__range").agg(F.sum(amount).alias("__t"))
        ranges = ranges.select(*group, "__range", zero(F.sum("__t").over(upto(Window.partitionBy(*(group or [F.lit(0)])).orderBy("__range")))).alias("__r"))
        inside = counted.withColumn("__i", zero(F.sum(amount).over(upto(Window.partitionBy(*group, "__range").orderBy("__piece")))))
        return inside.join(ranges, [*group, "__range"]).select(*group, "__range", "__piece", (F.col("__r") + F.col("__i")).alias(name))

    sizes = placed.groupBy("__range", "__piece").agg(F.sum(size).alias("__b"))
    line = Window.partitionBy("__range", "__piece").orderBy(F.col("__is").cast("int"), key, *identity, size, "__copy")
    keys = Window.partitionBy("__range", "__piece", "__is", key)
    walked = placed.withColumn("__before", zero(F.sum(size).over(upto(line)))).join(bases(sizes, "__b", "__start", []), ["__range", "__piece"])
    # a small key counts as one at its middle, so its rows stay together
    alone = F.col("__before") + F.col(size) / 2
    together = F.min("__before").over(keys) + F.sum(size).over(keys) / 2
    middle = F.col("__start") + F.when(F.col("__is"), alone).otherwise(together)
    ends = array(rooms(filled, whole), "double")
    dealt = walked.withColumn("__middle", middle).withColumn("shard", F.least(F.size(F.filter(ends, lambda e: e <= F.col("__middle"))), F.lit(shards - 1)).cast("int"))
    counts = dealt.groupBy("shard", "__range", "__piece").agg(F.count(F.lit(1)).alias("__n"))
    here = Window.partitionBy("shard", "__range", "__piece").orderBy(F.col("__is").cast("int"), key, *identity, size, "__copy")
    ranked = dealt.withColumn("__here", F.row_number().over(here) - 1).join(bases(counts, "__n", "__base", ["shard"]), ["shard", "__range", "__piece"])
    slot = F.get(array(taken, "long"), F.col("shard")) + F.col("__base") + F.col("__here")
    return large.unionByName(ranked.select(*kept, "shard", slot.cast("long").alias("slot")))


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", identity: str = "doc_id") -> DataFrame:
    """Identity, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``law`` (bytes), ``shard``, ``slot`` and ``grown_shard`` (null) of each document.

    The key is a hash of the text, so copies lie together.  Null and empty texts have size 1 and checksum 0.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = cut(docs.select(identity, (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
                             F.xxhash64(t).alias("__key")))
    return (range_shards(narrow, shards, "__key", "size", [identity])
            .select(identity, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
