"""Helpers that keep one hot key from landing in one task.

A key may hold a third of all rows.  Plain aggregates are safe because Spark combines them before
the shuffle; ordered work (row numbers, neighbours, all-to-all comparisons) is not, and goes
through the functions here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def dense_index(df: DataFrame, group: Sequence[str], order: str, name: str = "idx", block: int = BLOCK) -> DataFrame:
    """Number the rows of each group 0, 1, 2 ... by the integer column ``order`` (unique in its group).

    The order axis is cut into blocks, so rows are sorted inside blocks of at most ``block`` rows, and
    only the counters of blocks are accumulated, again in stretches.  Equal to
    ``row_number() over (partition by group order by order) - 1`` without a task per group.
    """
    cut = df.withColumn("__block", F.floor(F.col(order) / F.lit(block)).cast("long"))
    keys = [*group, "__block"]
    starts = _starts(cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), list(group))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return (cut.withColumn("__local", local).join(starts, keys)
            .withColumn(name, (F.col("__before") + F.col("__local")).cast("long"))
            .drop("__block", "__local", "__before"))


def _starts(counts: DataFrame, group: list[str]) -> DataFrame:
    """Rows before each block of its group, in two levels: inside stretches of blocks, then over stretches."""
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    wide = counts.withColumn("__stretch", F.floor(F.col("__block") / F.lit(BLOCK)).cast("long"))
    inside = up_to(Window.partitionBy(*group, "__stretch").orderBy("__block"))
    over = up_to(Window.partitionBy(*(group or [F.lit(0)])).orderBy("__stretch"))
    totals = (wide.groupBy(*group, "__stretch").agg(F.sum("__n").alias("__t"))
              .select(*group, "__stretch", F.coalesce(F.sum("__t").over(over), F.lit(0)).alias("__base")))
    return (wide.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(totals, [*group, "__stretch"])
            .select(*group, "__block", (F.col("__base") + F.col("__in")).alias("__before")))


def totals_before(counts: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """``key`` and the sum ``name`` of ``n`` over all smaller keys, for different whole numbers from anywhere in 64 bits.

    Sums are accumulated digit by digit of 16 bits, so no window holds over 65,536 rows however sparse the keys are.
    """
    ordered = F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order is the order of the signed keys
    digits = [f"__digit{i}" for i in range(4)]
    level = counts.select(key, F.col(n).alias("__sum"), *[F.shiftrightunsigned(ordered, 48 - 16 * i).bitwiseAND(F.lit(65535)).alias(d) for i, d in enumerate(digits)])
    out, parts = level.select(key, *digits), []
    for depth in (4, 3, 2, 1):
        own, above = digits[:depth], digits[:depth - 1]
        level = level.groupBy(*own).agg(F.sum("__sum").alias("__sum"))
        along = Window.partitionBy(*(above or [F.lit(0)])).orderBy(own[-1]).rowsBetween(Window.unboundedPreceding, -1)
        parts.append(f"__before{depth}")
        out = out.join(level.select(*own, F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias(parts[-1])), own)
    return out.select(key, sum((F.col(p) for p in parts[1:]), F.col(parts[0])).cast("long").alias(name))


def with_neighbours(df: DataFrame, group: Sequence[str], idx: str, before: dict[str, str] | None = None,
                    after: dict[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """``lag``/``lead`` along a dense integer index, for groups of any size.

    ``before``/``after`` map new column -> source column.  The index axis is cut into blocks and the
    rows at the block edges are copied into the next block, so every window holds at most
    ``block + 2`` rows whatever the size of its group, and there is a single shuffle.
    """
    before, after = before or {}, after or {}
    here = F.floor(F.col(idx) / F.lit(block)).cast("long")
    at = F.col(idx) % F.lit(block)
    homes = F.filter(F.array(
        F.struct(here.alias("b"), F.lit(True).alias("own")),
        F.when((at == block - 1) & F.lit(bool(before)), F.struct((here + 1).alias("b"), F.lit(False).alias("own"))),
        F.when((at == 0) & F.lit(bool(after)), F.struct((here - 1).alias("b"), F.lit(False).alias("own"))),
    ), lambda h: h.isNotNull())
    spread = df.withColumn("__home", F.explode(homes))
    window = Window.partitionBy(*[F.col(g) for g in group], F.col("__home.b")).orderBy(idx)
    for new, source in before.items():
        spread = spread.withColumn(new, F.lag(source).over(window))
    for new, source in after.items():
        spread = spread.withColumn(new, F.lead(source).over(window))
    return spread.where("__home.own").drop("__home")


def balanced(scan: DataFrame, finer: int = 1) -> DataFrame:
    """A scan with at least one partition per core, for costly work inside rows.

    A table of one small file would keep a single core busy.  Tables with enough splits, which is any
    large one, are returned as they are, without a shuffle.  Where rows are narrow and work on each is
    long, a split is hours of work; ``finer`` makes so many tasks of each, however large the table.
    """
    cores, splits = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    return scan.repartition(max(cores, splits * finer)) if splits < cores or finer > 1 else scan


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    Spark turns a filter on ``row_number() <= k`` into a group limit before the shuffle, so at most
    ``k`` rows per group and task travel.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def hash_block(*cols: Column | str, blocks: Column | int) -> Column:
    """A stable block number in ``[0, blocks)`` that spreads the rows of a group evenly."""
    n = F.lit(blocks) if isinstance(blocks, int) else blocks
    return F.pmod(F.xxhash64(*cols), n).cast("long")


def order_statistics(df: DataFrame, group: Sequence[str], value: str, ranks: Column, levels: int = 4, cells: int = 4096) -> DataFrame:
    """``group, n, rank, value``: the values at the wanted ranks (0-based, an array computed from the column ``n``) of each group, exactly.

    Equal values are one counter from the start.  Each level cuts the stretch of values that holds a wanted rank into ``cells`` cells of
    equal width and keeps only those that still hold one, for all ranks and groups at once; of values of one magnitude a cell holds after four levels of 4,096 a
    handful of neighbouring doubles, and only these are ordered.  Every level reads ``df`` again, so give it a stored table.  No window holds more than the cells of a stretch.  Null values have no rank.
    """
    group = list(group)
    g = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    renamed = lambda rows, *more: rows.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], *more)
    values = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    sizes = values.groupBy(*group).agg(F.sum("__c").cast("long").alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    wanted = sizes.select(*group, "n", "__lo", "__hi", F.lit(0).cast("long").alias("__before"), F.explode(F.array_distinct(ranks.cast("array<bigint>"))).alias("rank"))
    wanted = wanted.where((F.col("rank") >= 0) & (F.col("rank") < F.col("n")))
    for _ in range(levels):
        # different stretches only: ranks that lie in one share its counters
        stretches = renamed(wanted.select(*group, "__lo", "__hi", "__before").distinct(), "__lo", "__hi", "__before")
        near = values.join(stretches, [*g, F.col("__v").between(F.col("__lo"), F.col("__hi"))] if g else F.col("__v").between(F.col("__lo"), F.col("__hi")))
        width = F.col("__hi") - F.col("__lo")
        cell = F.when(width > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / width * cells), F.lit(cells - 1))).otherwise(0)
        keys = [*[f"__g{i}" for i in range(len(group))], "__lo", "__hi", "__before"]
        counted = near.withColumn("__cell", cell.cast("long")).groupBy(*keys, "__cell").agg(F.sum("__c").alias("__n"), F.min("__v").alias("__first"), F.max("__v").alias("__last"))
        upto = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("__start", F.col("__before") + F.coalesce(F.sum("__n").over(upto), F.lit(0)))
        placed = placed.select(*[c for c in keys if c.startswith("__g")], F.col("__lo").alias("__l"), F.col("__hi").alias("__h"), "__first", "__last", "__start", "__n")
        inside = (F.col("__lo") == F.col("__l")) & (F.col("__hi") == F.col("__h")) & (F.col("rank") >= F.col("__start")) & (F.col("rank") < F.col("__start") + F.col("__n"))
        held = wanted.join(placed, [*g, inside] if g else inside)
        wanted = held.select(*group, "n", F.col("__first").alias("__lo"), F.col("__last").alias("__hi"), F.col("__start").alias("__before"), "rank")
    ends = renamed(wanted.select(*group, "__lo", "__hi", "__before").distinct(), "__lo", "__hi", "__before")
    last = values.join(ends, [*g, F.col("__v").between(F.col("__lo"), F.col("__hi"))] if g else F.col("__v").between(F.col("__lo"), F.col("__hi")))
    keys = [*[f"__g{i}" for i in range(len(group))], "__lo", "__hi", "__before"]
    along = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ordered = last.withColumn("__start", F.col("__before") + F.coalesce(F.sum("__c").over(along), F.lit(0))).select(
        *[c for c in keys if c.startswith("__g")], F.col("__lo").alias("__l"), F.col("__hi").alias("__h"), F.col("__v").alias("value"), "__start", "__c")
    inside = (F.col("__lo") == F.col("__l")) & (F.col("__hi") == F.col("__h")) & (F.col("rank") >= F.col("__start")) & (F.col("rank") < F.col("__start") + F.col("__c"))
    return wanted.join(ordered, [*g, inside] if g else inside).select(*group, "n", "rank", "value")


def lower_median(df: DataFrame, group: Sequence[str], value: str, name: str = "median", per_octave: int = 4096) -> DataFrame:
    """The lower middle of the values (at least 0) of each group, exactly.

    Values fall into fine logarithmic buckets.  Counters of buckets find the one that holds the
    middle, and only its different values are ordered, so a large group is neither sorted nor held as a whole.
    """
    v = F.col(value)
    cut = df.where(v.isNotNull()).select(*group, value, F.when(v > 0, F.floor(F.log2(v) * per_octave)).otherwise(-(1 << 40)).cast("long").alias("__bucket"))
    counts = cut.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*group).orderBy("__bucket")
    before = F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("__n").over(Window.partitionBy(*group))
    placed = counts.select(*group, "__bucket", "__n", before.alias("__before"), F.floor((whole + 1) / 2).cast("long").alias("__middle"))
    holding = placed.where((F.col("__before") < F.col("__middle")) & (F.col("__middle") <= F.col("__before") + F.col("__n")))
    near = cut.join(holding.drop("__n"), [*group, "__bucket"])
    # equal values are one counter, so a value that very many rows share is one row here
    values = near.groupBy(*group, "__bucket", "__before", "__middle", value).agg(F.count(F.lit(1)).alias("__equal"))
    upto = F.col("__before") + F.sum("__equal").over(Window.partitionBy(*group, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return (values.withColumn("__upto", upto).where((F.col("__upto") - F.col("__equal") < F.col("__middle")) & (F.col("__middle") <= F.col("__upto")))
            .select(*group, F.col(value).alias(name)))
