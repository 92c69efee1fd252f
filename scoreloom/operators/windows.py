"""Texts into tokens, windows and sentences.

Windows are built from pieces (white space and the token after it), so the original text of a window
is the concatenation of its pieces: linear in the text, inside the JVM, and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.running import greedy_breaks, piece_ends
from scoreloom.functions.text import sentences, strip, words
from scoreloom.functions.values import fence, let
from scoreloom.operators.skew import dense_index, totals_before

PIECE, TOKEN = r"(?U)(\s*\S+)", r"(?U)\S+"


def token_spans(text: Column) -> Column:
    """White-space tokens with their character offsets: struct of the arrays token, start, end.

    A text is cut into pieces of white space and a token; running sums of their lengths are the ends.
    """
    whole = F.coalesce(text, F.lit(""))
    tokens, ends = F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)), piece_ends(pieces(whole))
    return F.struct(tokens.alias("token"), F.zip_with(ends, tokens, lambda e, t: e - F.length(t)).alias("start"), ends.alias("end"))


def tokenize(df: DataFrame, key: str, text: str, spans: Callable[[Column], Column] = token_spans, extremes: bool = False) -> DataFrame:
    """One row per token.  Another tokenizer is any function to the same struct of arrays.

    With ``extremes`` two columns more, ``least`` and ``greatest``: whether no token of the row's text comes before, or behind, this one in order.
    """
    s = F.col("__s")
    ends = {"__least": F.array_min(s["token"]), "__greatest": F.array_max(s["token"])} if extremes else {}
    token = F.col("__t")["token"]
    # what is selected beside a generator is computed anew for each of its rows, so the ends come before it
    return (fence(df.select(key, spans(F.col(text)).alias("__s")), ["__s"]).withColumns(ends)
            .select(key, *ends, F.posexplode(F.arrays_zip(s["token"], s["start"], s["end"])).alias("pos", "__t"))
            .select(key, "pos", token.alias("token"), F.col("__t")["start"].alias("start"), F.col("__t")["end"].alias("end"),
                    *[(token == F.col(n)).alias(n[2:]) for n in ends]))


def token_totals(tokens: DataFrame, key: str) -> DataFrame:
    """``key, n_tokens, starts, ends, first_token, last_token`` of the rows of ``tokenize``; least and greatest token by their bytes.

    ``tokens`` has the columns that ``extremes`` adds.  A least or greatest text in an aggregate makes Spark sort all its rows first.  So only the least and
    the greatest token of a text get through as texts, as keys of counters, which are hashed; least and greatest are taken of the few rows that are left.
    """
    extreme = F.when(F.col("least") | F.col("greatest"), F.col("token"))
    counted = tokens.groupBy(key, extreme.alias("__extreme")).agg(F.count(F.lit(1)).alias("__n"), F.sum("start").alias("__starts"), F.sum("end").alias("__ends"))
    return counted.groupBy(key).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_tokens"), F.sum("__starts").alias("starts"), F.sum("__ends").alias("ends"),
                                    F.min("__extreme").alias("first_token"), F.max("__extreme").alias("last_token"))


def build_vocab(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every different token with an id in first-seen order (by integer ``key``, then position).

    Repeats collapse before the shuffle; ids come from counters of keys and blocks of positions, not from one global sort.
    Keys may be any 64-bit numbers and texts of any length; rows without a key take no part.
    """
    seen = (df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("__key"), F.posexplode(words(F.col(text))).alias("pos", "token"))
            .groupBy("token").agg(F.min(F.struct("__key", "pos")).alias("__at"), F.count(F.lit(1)).alias("n"))
            .select("token", "n", "__at.*"))
    before = totals_before(seen.groupBy("__key").agg(F.count(F.lit(1)).alias("__new")), "__key", "__new", "__before")
    return (dense_index(seen, ["__key"], "pos", "__inside").join(before, "__key")
            .select("token", "n", (F.col("__before") + F.col("__inside")).alias("token_id")))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))


def _starts(n: Column, span: int, stride: int) -> Column:
    """Indices at which full windows begin."""
    empty = F.array().cast("array<int>")
    return F.when(n >= span, F.sequence(F.lit(0), n - span, F.lit(stride))).otherwise(empty)


def token_windows(tokens: Column, size: int, stride: int | None = None, dilation: int = 1) -> Column:
    """Full windows over an array, as arrays of their elements."""
    span = dilation * (size - 1) + 1
    taps = F.array(*[F.lit(j * dilation) for j in range(size)])
    return F.transform(_starts(F.size(tokens), span, stride or size), lambda s: F.transform(
        taps, lambda j: F.element_at(tokens, s + j + 1)))


def window_texts(parts: Column, size: int, stride: int | None = None, dilation: int = 1, drop_last: bool = True) -> Column:
    """The original text of each window, and with ``drop_last=False`` of what is left over."""
    stride, span = stride or size, dilation * (size - 1) + 1
    n = F.size(parts)
    starts = _starts(n, span, stride)
    out = F.transform(starts, lambda s: strip(F.array_join(F.slice(parts, s + 1, F.lit(span)), "")))
    if drop_last:
        return out
    rest = F.size(starts) * stride
    return F.concat(out, F.when(rest < n, F.array(strip(F.array_join(F.slice(parts, rest + 1, n), "")))).otherwise(
        F.array().cast("array<string>")))


def char_breaks(text: Column, limit: int) -> Column:
    """Token indices at which greedy groups of at most ``limit`` characters begin; a longer token stands alone.  A column, not for lambdas."""
    return greedy_breaks(pieces(text), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lit(limit))


def char_window_texts(parts: Column, breaks: Column) -> Column:
    """The text of each group, from the pieces of a text and its ``char_breaks``."""
    ends = F.concat(F.slice(breaks, F.lit(2), F.size(parts) + 1), F.array(F.size(parts)))
    return F.zip_with(breaks, ends, lambda b, e: strip(F.array_join(F.slice(parts, b + 1, e - b), "")))


def multi_scale(df: DataFrame, key: str, text: str, token_sizes: Sequence[int] = (), char_limits: Sequence[int] = ()) -> DataFrame:
    """Windows at several scales: (key, scale, window_index, text)."""
    p = F.col("__pieces")
    breaks = {n: char_breaks(F.col(text), n).alias(f"__breaks{n}") for n in char_limits}
    cut = fence(df.select(key, pieces(F.col(text)).alias("__pieces"), *breaks.values()), ["__pieces", *[f"__breaks{n}" for n in breaks]])
    scales = [F.struct(F.lit(f"tok_len_{n}").alias("scale"), window_texts(p, n, drop_last=False).alias("windows")) for n in token_sizes]
    scales += [F.struct(F.lit(f"char_len_{n}").alias("scale"), char_window_texts(p, F.col(f"__breaks{n}")).alias("windows")) for n in char_limits]
    return (cut.where(F.size("__pieces") > 0).select(key, F.explode(F.array(*scales)).alias("__s"))
            .select(key, "__s.scale", F.posexplode("__s.windows").alias("window_index", "text")))


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(sentences(F.col(text))).alias("sentence_index", "sentence"))


def word_windows(text: Column, size: int = 25, stride: int = 15) -> Column:
    """Overlapping windows of words; a shorter text is one window, blank text one empty window."""
    def cut(w):
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)), F.lit(stride))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))
    return let(words(text), cut)


def prefixes(text: Column) -> Column:
    """Token 1, tokens 1-2, ... 1-n.  The output is quadratic in the text: meant for short texts."""
    return let(words(text), lambda w: F.transform(w, lambda _, i: F.array_join(F.slice(w, F.lit(1), i + 1), " ")))


def item_sentences(*fields: Column) -> Column:
    """Sentences of a record: its non-blank texts and lists of texts, split after . ! ? and space."""
    texts = F.filter(F.transform(F.flatten(F.array(*fields)), strip), lambda x: x != "")
    joined = F.array_join(texts, "\n")
    parts = F.filter(F.transform(F.split(joined, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).when(joined != "", F.array(joined)).otherwise(parts)


def embed_chunks(df: DataFrame, keys: Sequence[str], chunk: str, load: Callable[[], Callable[[list[str]], list]],
                 batch_size: int = 256) -> DataFrame:
    """Vectors for chunks of all documents, pooled into batches.

    ``load`` runs once per task and returns the model: a function from a list of texts to vectors.
    The keys stay with the chunk, so documents are regrouped by key, not by arrival.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            vectors = []
            for i in range(0, len(frame), batch_size):
                vectors += [[float(x) for x in v] for v in model(frame[chunk].iloc[i:i + batch_size].tolist())]
            yield frame.assign(embedding=vectors)

    narrow = df.select(*keys, chunk)
    return narrow.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema) + ", embedding array<double>")


def embed_documents(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list]], splitter: Callable[[Column], Column] | None = sentences,
                    batch_size: int = 256) -> DataFrame:
    """``key, chunks, embeddings``: the chunks of every document and a vector for each, in order.

    ``splitter`` is any function from a text to an array of chunks; without one a document is one chunk.  Chunks of all documents share the
    model's batches.  Documents without chunks have empty arrays.
    """
    chunks = splitter(F.col(text)) if splitter is not None else F.array(F.col(text))
    own = fence(df.select(key, chunks.alias("chunks")), ["chunks"])
    vectors = embed_chunks(own.select(key, F.posexplode("chunks").alias("chunk_index", "chunk")), [key, "chunk_index"], "chunk", load, batch_size)
    whole = vectors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "embedding"))).alias("__v"))  # the chunks of one document
    joined = own.join(whole, key, "left")
    return joined.select(key, "chunks", F.coalesce(F.transform("__v", lambda x: x["embedding"]), F.array().cast("array<array<double>>")).alias("embeddings"))


MENTIONS = "struct<clusters:array<struct<id:string,mentions:array<struct<text:string,start:int,end:int>>>>>"


def cluster_mentions(df: DataFrame, key: str, text: str, answer: str) -> DataFrame:
    """Mention rows of a coreference answer, and whether the offsets really point at the mention."""
    return (df.select(key, text, F.explode(F.from_json(answer, MENTIONS)["clusters"]).alias("c"))
            .select(key, text, F.col("c.id").alias("cluster"), F.posexplode("c.mentions").alias("mention_index", "m"))
            .select(key, "cluster", "mention_index", F.col("m.text").alias("mention"), F.col("m.start").alias("start"), F.col("m.end").alias("end"),
                    (F.substring(text, F.col("m.start") + 1, F.col("m.end") - F.col("m.start")) == F.col("m.text")).alias("in_place")))
