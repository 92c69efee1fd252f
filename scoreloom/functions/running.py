"""Running values along the arrays of a row, as Arrow kernels.

A fold over an array can only keep its partial results by copying them at each step.  These pass the arrays of a batch to numpy as one flat
vector, so the work is linear in the elements however long an array is.

They are columns of a frame, not for lambdas.  Their arguments hold no lambda either: Spark tells equal Python columns apart by their arguments, and
does so unreliably where those hold lambda variables.  Compute such arguments first and pass them through ``functions.values.fence``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(lists: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All elements behind each other (null elements as 0), and where each row's begin, with the end."""
    return lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(kind), edges_of(lists)


def edges_of(lists: pa.Array) -> np.ndarray:
    return np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)


def nested(lists: pa.Array, values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of values; null where ``lists`` is."""
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind), mask=lists.is_null() if lists.null_count else None)


def sizes_of(texts: pa.Array) -> np.ndarray:
    return pc.utf8_length(texts.flatten()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def piece_ends(pieces: pa.Array) -> pa.Array:
    """Where each of the pieces of a text ends, in characters from the first piece on."""
    edges = edges_of(pieces)
    total = np.r_[0, np.cumsum(sizes_of(pieces))]
    return nested(pieces, total[1:] - np.repeat(total[edges[:-1]], np.diff(edges)), edges, pa.int32())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def greedy_breaks(pieces: pa.Array, tokens: pa.Array, limit: pa.Array) -> pa.Array:
    """Where greedy groups of pieces begin, each piece being white space and a token: groups of at most ``limit`` characters.

    A group is measured from the start of its first token to the end of its last; a longer token stands alone.  Each group's end is found by
    bisection over the running ends.
    """
    edges, sizes, own = edges_of(pieces), sizes_of(pieces), sizes_of(tokens)
    out, ends_at = [], [0]
    for lo, hi, most in zip(edges[:-1], edges[1:], limit.to_pylist(), strict=True):
        ends = np.cumsum(sizes[lo:hi])
        at = 0
        while at < hi - lo:
            out.append(at)
            at = max(at + 1, int(np.searchsorted(ends, ends[at] - own[lo + at] + most, "right")))
        ends_at.append(len(out))
    return nested(pieces, np.array(out, np.int32), np.array(ends_at, np.int64), pa.int32())


@F.arrow_udf(T.ArrayType(T.StringType()))
def cuttings(texts: pa.Array, starts: pa.Array, size: pa.Array) -> pa.Array:
    """Of each of the 0-based places of a text the ``size`` characters from there on, fewer at its end; a text is read once, not up to each place."""
    return pa.array([None if text is None or places is None else [None if at is None else text[at:at + n] for at in places]
                     for text, places, n in zip(texts.to_pylist(), starts.to_pylist(), size.to_pylist(), strict=True)], pa.list_(pa.string()))
