"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums to token budgets, whole epochs first.

A document with quality weight w gets the key E / w, E exponential from a hash of seed and identity; ascending keys are a
weighted sample without replacement of every size.  A source whose target is e + f times its size takes every document e times
and of the order by key the prefix that comes nearest to the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.draws import draw_number
from scoreloom.llm.common import cut, n_words_of

WEIGHTS = (5, 2, 1)
SEED = 20


def quality_weight(text: Column) -> Column:
    """Share of characters that are not symbols of markup or menus, at least 0.05; 0.05 for null and empty texts."""
    n = F.length(text)
    clean = F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(clean.cast("double"), n.cast("double")), F.lit(0.05)))


def source_targets(sizes: DataFrame, source: str, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """``source_size`` and ``target`` of every source, from one row a source with its ``source_size``.

    Sources by code point, null last, get the weights in turn.  Targets share the sum of all sizes; a target stops at ``epochs``
    times its source's size and the excess is shared again by weight until none is above.  That ends at one level for
    all sources below their limit: in order of limit / weight, a source is at its limit as long as its limit is below the level
    that the sources from it on would share.  Sources of size 0 get 0.
    """
    turn = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    given = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")).cast("long"))
    limit = F.col("source_size") * epochs
    by_limit = Window.orderBy((limit / F.col("__w")).asc(), F.col(source).asc_nulls_last())
    before, all_rows = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    weight = F.sum("__w").over(all_rows) - F.coalesce(F.sum("__w").over(before), F.lit(0))
    level = given.withColumn("__level", left.cast("double") / weight)
    free = limit >= F.col("__level") * F.col("__w")
    shared = F.first(F.when(free, F.col("__level")), ignorenulls=True).over(all_rows)
    # all limits together are epochs times the sum, so some source is always free
    return (level.withColumn("__shared", shared)
            .select(source, "source_size", F.least(limit.cast("double"), F.col("__shared") * F.col("__w")).alias("target")))


def mix(rows: DataFrame, source: str, size: str, quality: str, identity: str, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3,
        seed: int = SEED, block: int = 2048) -> DataFrame:
    """The rows with ``source_size``, ``target``, ``copies`` (0 to ``epochs``) and ``taken`` (size times copies).

    A source of any size is sorted in blocks of about ``block`` rows along its keys; only sums of blocks are accumulated over the
    source.  Rows without size are taken as often as the whole epochs.  Equal keys are ordered by identity, then size; rows equal
    in all three are interchangeable.  An empty table stays empty; other columns pass, but for the added names.
    """
    kept = [c for c in rows.columns if c not in ("source_size", "target", "copies", "taken")]
    u = (draw_number(seed, "mix", F.col(identity), F.col(size)).cast("double") + 0.5) / float(1 << 60)
    keyed = rows.select(*kept, F.col(source).alias("__s"), (-F.log(u) / F.greatest(F.col(quality), F.lit(1e-9))).alias("__key"))
    totals = keyed.groupBy("__s").agg(F.sum(size).cast("long").alias("source_size"), F.count(F.lit(1)).alias("__n"),
                                      F.avg(F.greatest(F.col(quality), F.lit(1e-9))).alias("__q"))
    targets = source_targets(totals.select("__s", "source_size"), "__s", weights, epochs)
    known = (totals.drop("source_size").withColumnRenamed("__s", "__s1")
             .join(targets.withColumnRenamed("__s", "__s2"), F.col("__s1").eqNullSafe(F.col("__s2"))).drop("__s2"))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    known = known.withColumn("__epochs", whole).withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size"))
    blocks = F.ceil(F.col("__n") / block)
    placed = (keyed.join(known, F.col("__s").eqNullSafe(F.col("__s1")))
              .withColumn("__block", F.least(blocks - 1, F.floor((1 - F.exp(-F.col("__key") * F.col("__q"))) * blocks)).cast("long"))
              .drop("__s1", "__n", "__q"))
    sums = placed.groupBy("__s", "__block").agg(F.sum(size).alias("__b"))
    along = Window.partitionBy("__s").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("__s").alias("__s3"), F.col("__block").alias("__b3"), F.coalesce(F.sum("__b").over(along), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__s", "__block").orderBy("__key", identity, size).rowsBetween(Window.unboundedPreceding, -1)
    summed = (placed.withColumn("__in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
              .join(starts, F.col("__s").eqNullSafe(F.col("__s3")) & (F.col("__block") == F.col("__b3"))))
    chosen = (F.col(size) > 0) & (F.col("__start") + F.col("__in") + F.col(size) / 2 <= F.col("__rest"))
    return (summed.withColumn("copies", (F.col("__epochs") + chosen.cast("int")).cast("int"))
            .select(*kept, "source_size", "target", "copies", (F.col(size) * F.col("copies")).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", identity: str = "doc_id", **options) -> DataFrame:
    """Identity, source, ``size`` (words; null text: 0), and what ``mix`` adds, one row for each document."""
    narrow = cut(docs.select(identity, source, n_words_of(F.col(text)).alias("size"), quality_weight(F.col(text)).alias("__quality")))
    return mix(narrow, source, "size", "__quality", identity, **options).drop("__quality")
