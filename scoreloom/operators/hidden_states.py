"""Per-layer, per-token vectors: (text_id, layer, pos, state)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.vectors import cosine_distance, dot, norm, normalize, softmax_top, subtract
from scoreloom.operators.skew import lower_median, with_neighbours
from scoreloom.operators.vector_sets import cross_moments, spread, vector_sums

CELL = ["text_id", "layer"]


def mean_pool(states: DataFrame, keys: Sequence[str] = CELL, vector: str = "state", name: str = "pooled") -> DataFrame:
    """Mean over tokens per text and layer."""
    return vector_sums(states, keys, vector).select(*keys, F.col("mean").alias(name))


def content_pool(states: DataFrame, keys: Sequence[str] = CELL, vector: str = "state", name: str = "pooled") -> DataFrame:
    """Mean over tokens without the first, which is kept only where it is the only one."""
    # both means of a key are one array a task; the second is dropped where there is content
    parts = vector_sums(states.withColumn("__content", F.col("pos") > 0), [*keys, "__content"], vector)
    return parts.groupBy(*keys).agg(F.max_by("mean", "__content").alias(name))


def last_token(states: DataFrame, keys: Sequence[str] = CELL, vector: str = "state", name: str = "last") -> DataFrame:
    return states.groupBy(*keys).agg(F.max_by(vector, "pos").alias(name))


def select_layer(states: DataFrame, layer: int, n_layers: int) -> DataFrame:
    """One layer by number; negative numbers count from the last."""
    return states.where(F.col("layer") == layer % n_layers)


def norm_profile(states: DataFrame) -> DataFrame:
    """Length of the states per layer: mean over tokens, and of the last token."""
    sized = states.select(*CELL, "pos", norm(F.col("state")).alias("size"))
    return sized.groupBy(*CELL).agg(F.avg("size").alias("mean_norm"), F.max_by("size", "pos").alias("last_norm"))


def sink_ratio(states: DataFrame) -> DataFrame:
    """Length of the first token's state against the lower median of the others."""
    sized = states.select(*CELL, "pos", norm(F.col("state")).alias("size"))
    first = sized.where("pos = 0").select(*CELL, F.col("size").alias("first"))
    middle = lower_median(sized.where("pos > 0"), CELL, "size", "middle")
    return first.join(middle, CELL, "left").withColumn("ratio", F.col("first") / F.col("middle"))


def cosine_by_layer(pooled: DataFrame, reference_text: int, vector: str = "pooled") -> DataFrame:
    """Cosine similarity of every text to a reference text, layer by layer."""
    reference = pooled.where(F.col("text_id") == reference_text).select("layer", F.col(vector).alias("__r"))
    return (pooled.where(F.col("text_id") != reference_text).join(reference, "layer")
            .select("text_id", "layer", (1.0 - cosine_distance(F.col(vector), F.col("__r"))).alias("cosine")))


def rsa(pooled: DataFrame, embeddings: DataFrame, vector: str = "pooled", embedding: str = "embedding") -> DataFrame:
    """Pearson r per layer between the similarities of all pairs of texts in two representations.

    With z = (a, b, 1) the matrix sum of z z^T holds sum a a^T, sum b b^T, sum a b^T, sum a, sum b and
    n; the sums of s, t, s^2, t^2 and s t over all pairs are squared sizes of its blocks, less the
    pairs of a text with itself.  No pair is formed, and texts are read once.
    """
    both = (pooled.select("text_id", "layer", normalize(F.col(vector)).alias("a"))
            .join(embeddings.select("text_id", F.col(embedding).cast("array<double>").alias("b")), "text_id"))
    s, t = dot(F.col("a"), F.col("a")), dot(F.col("b"), F.col("b"))
    own = both.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("a")).alias("da"), F.max(F.size("b")).alias("db"),
                                    F.sum(s).alias("os"), F.sum(t).alias("ot"), F.sum(s * s).alias("oss"), F.sum(t * t).alias("ott"), F.sum(s * t).alias("ost"))
    z = both.select("layer", F.concat("a", "b", F.array(F.lit(1.0))).alias("z"))
    m = cross_moments(z, ["layer"], "z").join(own.select("layer", "da", "db"), "layer")
    i, j, da, dab = F.col("i"), F.col("j"), F.col("da"), F.col("da") + F.col("db")
    square = F.col("value") * F.col("value")
    block = lambda rows, columns: F.sum(F.when(rows & columns, square))
    in_a, in_b, one = lambda c: c < da, lambda c: (c >= da) & (c < dab), lambda c: c == dab
    sums = m.groupBy("layer").agg(block(in_a(i), one(j)).alias("s"), block(in_b(i), one(j)).alias("t"), block(in_a(i), in_a(j)).alias("ss"),
                                  block(in_b(i), in_b(j)).alias("tt"), block(in_a(i), in_b(j)).alias("st"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = lambda whole, self: (F.col(whole) - F.col(self)) / 2 / pairs
    ms, mt = mean("s", "os"), mean("t", "ot")
    r = (mean("st", "ost") - ms * mt) / F.sqrt((mean("ss", "oss") - ms * ms) * (mean("tt", "ott") - mt * mt))
    return own.join(sums, "layer").where("n > 1").select("layer", pairs.cast("long").alias("n_pairs"), r.alias("r"))


def best_layer(correlations: DataFrame) -> DataFrame:
    """The layer with the largest r, the lowest of equal ones."""
    return (correlations.where(~F.isnan("r")).agg(F.max(F.struct("r", (-F.col("layer")).alias("back"))).alias("m"))
            .select((-F.col("m.back")).alias("layer"), F.col("m.r").alias("r")))


def layer_deltas(pooled: DataFrame, vector: str = "pooled", name: str = "delta") -> DataFrame:
    """Next layer minus this one; the last layer has none."""
    near = with_neighbours(pooled, ["text_id"], "layer", after={"__n": vector})
    return near.where(F.col("__n").isNotNull()).withColumn(name, subtract(F.col("__n"), F.col(vector))).drop("__n")


def variance_by_cell(vectors: DataFrame, vector: str) -> DataFrame:
    """Variance and mean over texts of every (layer, dimension)."""
    return spread(vectors, ["layer"], vector)


def rank_cells(cells: DataFrame, k: int) -> DataFrame:
    return cells.orderBy(F.desc("variance"), "layer", "dim").limit(k)


def next_tokens(df: DataFrame, key: str, logits: str, k: int = 5) -> DataFrame:
    """The k most likely next tokens and their probabilities, best first."""
    return df.select(key, F.posexplode(softmax_top(F.col(logits), k)).alias("rank", "t")).select(key, "rank", "t.*")


def new_token_states(states: DataFrame) -> DataFrame:
    """State of the last position of every generation step and layer."""
    return states.groupBy("text_id", "step", "layer").agg(F.max_by("state", "pos").alias("state"))
