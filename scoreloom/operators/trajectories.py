"""Ordered sequences of vectors: (seq_id, idx, vector) with idx = 0, 1, 2 ... in each sequence.

Neighbours come from blocks of the index with copied edges, so a sequence may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.vectors import chord, kinetic_energy, log_map, subtract
from scoreloom.operators.skew import with_neighbours
from scoreloom.operators.vector_sets import pair_distances


def _filled(like: Column, value: float) -> Column:
    return F.transform(like, lambda _: F.lit(value).cast("double"))


def shift(df: DataFrame, seq: str, idx: str, vector: str, fill: float = float("nan"), name: str = "previous") -> DataFrame:
    """Adds the previous vector of the sequence; the first gets ``fill`` in every dimension."""
    near = with_neighbours(df, [seq], idx, before={name: vector})
    return near.withColumn(name, F.coalesce(F.col(name).cast("array<double>"), _filled(F.col(vector), fill)))


def backward_difference(df: DataFrame, seq: str, idx: str, vector: str, name: str = "difference") -> DataFrame:
    """This vector minus the one before; zeros for the first."""
    near = with_neighbours(df, [seq], idx, before={"__p": vector})
    return near.withColumn(name, subtract(F.col(vector), F.coalesce("__p", vector))).drop("__p")


def forward_difference(df: DataFrame, seq: str, idx: str, vector: str, fill: float = float("nan"), name: str = "difference") -> DataFrame:
    """The next vector minus this one; ``fill`` for the last.  Unequal dimensions are an error."""
    near = with_neighbours(df, [seq], idx, after={"__n": vector})
    unequal = F.col("__n").isNotNull() & (F.size("__n") != F.size(vector))
    difference = F.when(unequal, F.raise_error(F.lit("vectors of one sequence differ in dimension")).cast("array<double>")).when(
        F.col("__n").isNull(), _filled(F.col(vector), fill)).otherwise(subtract(F.col("__n"), F.col(vector)))
    return near.withColumn(name, difference).drop("__n")


def step_sizes(df: DataFrame, seq: str, idx: str, vector: str) -> DataFrame:
    """(seq, idx, step): distance to the next vector, NULL for the last."""
    near = with_neighbours(df.select(seq, idx, vector), [seq], idx, after={"__n": vector})
    return near.select(seq, idx, F.when(F.col("__n").isNotNull(), chord(F.col("__n"), F.col(vector))).alias("step"))


def step_summary(df: DataFrame, seq: str, idx: str, vector: str) -> DataFrame:
    """Mean and largest step of each sequence; NULL for a sequence of one."""
    return (step_sizes(df, seq, idx, vector).groupBy(seq)
            .agg(F.count(F.lit(1)).alias("n"), F.avg("step").alias("mean_step"), F.max("step").alias("max_step")))


def largest_jump(df: DataFrame, seq: str, idx: str, vector: str) -> DataFrame:
    """Where each sequence makes its largest step; the first of equal ones."""
    at = F.max(F.struct(F.col("step"), (-F.col(idx)).alias("back")))
    return (step_sizes(df, seq, idx, vector).where("step is not null").groupBy(seq).agg(at.alias("m"))
            .select(seq, (-F.col("m.back")).alias("idx_from"), (1 - F.col("m.back")).alias("idx_to"), F.col("m.step").alias("step")))


def top_dimensions(differences: DataFrame, vector: str, k: int = 20) -> DataFrame:
    """Dimensions by their summed difference, largest first.  NaN marks a missing neighbour and is left out."""
    cells = differences.select(F.posexplode(vector).alias("dim", "x")).where(~F.isnan("x"))
    return cells.groupBy("dim").agg(F.sum("x").alias("total")).orderBy(F.desc("total"), "dim").limit(k)


def kinematics(df: DataFrame, seq: str, idx: str, vector: str, spherical: bool = False) -> DataFrame:
    """Adds velocity (first difference), acceleration (second difference) and energy of a sequence.

    With ``spherical`` the velocity is the tangent that leads from the previous position to this one.
    """
    near = with_neighbours(df, [seq], idx, before={"__p": vector})
    move = log_map(F.col("__p"), F.col(vector)) if spherical else subtract(F.col(vector), F.col("__p"))
    moved = near.withColumn("velocity", F.when(F.col("__p").isNotNull(), move)).drop("__p")
    again = with_neighbours(moved, [seq], idx, before={"__v": "velocity"})
    return (again.withColumn("acceleration", F.when(F.col("__v").isNotNull(), subtract(F.col("velocity"), F.col("__v"))))
            .withColumn("energy", kinetic_energy(F.col("velocity"))).drop("__v"))


def stack_states(spark: SparkSession, path: str, schema: T.StructType | str, dt: float = 1.0, number: str = r"(\d+)[^/\d]*/[^/]*$", kind: str = "parquet") -> DataFrame:
    """One table of the states of many steps, each a folder or file with its number in its name: the state of step i is taken at time i dt.

    It is one scan: the step comes from the name of the file a row is read from, so the plan does not grow with the number of steps.
    """
    step = F.regexp_extract(F.col("_metadata.file_path"), number, 1).cast("int")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").format(kind).load(path).select("*", step.alias("t_index")).withColumn("time", F.col("t_index") * F.lit(dt))


def with_times(df: DataFrame, t_index: str, dt: float, start: float = 0.0) -> DataFrame:
    return df.withColumn("time", F.lit(start) + F.col(t_index) * F.lit(dt))


def state_at(trajectory: DataFrame, t_index: int) -> DataFrame:
    return trajectory.where(F.col("t_index") == t_index)


def trajectory_pairs(trajectory: DataFrame, pairs: DataFrame, t_index: str, particle: str, vector: str) -> DataFrame:
    """Angle between the particles of the wanted pairs at every time.

    ``pairs`` holds (t_index_a, t_index_b, particle_a, particle_b) with equal times.
    """
    return pair_distances(trajectory, pairs, [t_index, particle], vector, ["arc"])
