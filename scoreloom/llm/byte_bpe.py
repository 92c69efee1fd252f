"""Byte-level BPE by backtracking over longest matches.

Bytes are read as Latin-1 characters, so an Aho-Corasick automaton over the vocabulary finds every token that starts at every
position.  A sequence of tokens is what the merges give exactly when every two neighbours are (merging their bytes alone gives just
these two back), and the merges' sequence of a text extends that of its prefixes.  So the encoder takes the longest token, steps
down to shorter ones where the neighbours don't agree, and steps back where none is left; a position that failed once is never
tried again, which keeps the work linear.  Agreement of two tokens is found by undoing their merges in order and is remembered.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from scoreloom.llm.common import quoted

LONGEST_KEPT = 48  # longer pieces of text are encoded each time they occur
BYTES = 4 << 20  # of ids that leave a task together
MOST_KEPT = 200_000  # pieces and pairs remembered in a task before it starts anew


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 text and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """Encoder and decoder for one table of ranks; tokens are numbered by rank, and a smaller rank merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.bytes = {b: ranks[bytes([b])] for b in range(256) if bytes([b]) in ranks}
        self.lengths = [len(self.tokens.get(rank, b"")) for rank in range(max(ranks.values()) + 1)]
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.agreed: dict[tuple[int, int], bool] = {}

    def split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a token that no merge makes."""
        if rank not in self.halves:
            parts = self._merged(self.tokens[rank], below=rank)
            self.halves[rank] = tuple(parts) if len(parts) == 2 else None
        return self.halves[rank]

    def _merged(self, piece: bytes, below: int) -> list[int]:
        """Plain merging with the ranks under ``below``: used once a token, on the token's own few bytes."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], below))
            if self.ranks.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def agree(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens: no merge across their border comes first."""
        found = self.agreed.get((left, right))
        if found is None:
            if len(self.agreed) >= MOST_KEPT:
                self.agreed.clear()
            found = self.agreed[left, right] = self._agree(left, right)
        return found

    def _agree(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges, over and over.  ``until`` is the rank of the merge undone last: before it,
        # the two tokens at the border stood side by side, and an earlier merge of these two would have joined them.
        until, last_left = len(self.tokens) + 1, True
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            # of two equal ranks the left one merges first: undoing a left merge leaves the border pair later than it
            if joined is not None and (joined < until or joined == until and not last_left):
                return False
            ends = [(self.split(left) and left, True), (self.split(right) and right, False)]
            made = [(rank, is_left) for rank, is_left in ends if rank is not None]
            if not made:
                return True
            until, last_left = max(made, key=lambda x: (x[0], not x[1]))
            if last_left:
                left = self.split(left)[1]
            else:
                right = self.split(right)[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one piece, as the merges give them.

        A position is reached by one sequence of agreeing tokens at most, so its choices are used up once and need no copy.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, lengths, agreed = len(piece), self.lengths, self.agreed
        choices = [[self.bytes[b]] for b in piece]  # tokens from each position, short ones first, to pop the longest
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            choices[end - lengths[rank] + 1].append(rank)
        dead, out, path, at, last = set(), [], [], 0, -1
        while at < n:
            left = choices[at]
            while left:
                rank = left.pop()
                to = at + lengths[rank]
                if to in dead:
                    continue
                if last >= 0:
                    fits = agreed.get((last, rank))
                    if not (self.agree(last, rank) if fits is None else fits):
                        continue
                path.append(at)
                out.append(rank)
                at, last = to, rank
                break
            else:
                if not path:
                    raise ValueError("no sequence of tokens agrees: these ranks are not those of merges")
                dead.add(at)
                at = path.pop()
                out.pop()
                last = out[-1] if out else -1
        return out

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


class Pieces(dict):
    """Ids of pieces of text as bytes of 32-bit integers, made when first asked for."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe, self.before = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = array("I", self.bpe.encode_piece(piece.encode())).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:  # the pieces before these stay at hand, so common ones come back without work
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> tuple[Callable[[str], bytes], Callable[[bytes], bytes]]:
    """Text to the bytes of its ids (little-endian, 32 bits each), and back to the text's bytes; kept by a process for its next task."""
    cut, known = regex.compile(pattern).findall, Pieces(ByteBpe(read_ranks(ranks_path)))
    token = known.bpe.tokens.__getitem__
    swap = sys.byteorder != "little"

    def encode(text: str) -> bytes:
        ids = b"".join(map(known.__getitem__, cut(text)))
        return np.frombuffer(ids, ">u4").astype("<u4").tobytes() if swap else ids

    return encode, lambda ids: b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))


def with_ids(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", digests_only: bool = False, keep_text: bool = True) -> DataFrame:
    """The documents' columns with ``ids`` (array) and ``n_tokens``; or, with ``digests_only``, without text and ids but with
    ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, the digest of the decoded bytes.  ``keep_text=False`` leaves the text out.

    A null text counts as empty: no ids.  Every row gives one row, whatever repeats; columns of the added names are replaced, all
    others pass through as they are.  Rows leave a task whenever their ids reach ``BYTES``, so a long text waits for no others.
    The rank file must lie at the same path on every machine.
    """
    kinds = {"n_tokens": LongType(), **({"ids_sha256": StringType(), "decoded_sha256": StringType()} if digests_only else {"ids": ArrayType(IntegerType())})}
    kept = [c for c in docs.columns if c not in kinds and (c != text or keep_text and not digests_only)]
    place = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*kept, text]))}  # a name may be any text
    schema = StructType([*[StructField(place[c], docs.schema[c].dataType) for c in kept], *[StructField(c, kind) for c, kind in kinds.items()]])

    def finished(rows: pa.RecordBatch, ids: list[bytes], digests: list[tuple[str, str]]) -> pa.RecordBatch:
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        made = {"n_tokens": pa.array(sizes)}
        if digests_only:
            made["ids_sha256"], made["decoded_sha256"] = (pa.array(x, pa.string()) for x in zip(*digests))
        else:
            made["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], sizes.cumsum()]).astype(np.int32), np.frombuffer(b"".join(ids), "<i4"))
        return pa.RecordBatch.from_arrays([*[rows.column(place[c]) for c in kept], *[made[c] for c in kinds]], names=schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = coder(ranks_path, pattern)
        for batch in batches:
            first, held, ids, digests = 0, 0, [], []
            for row, body in enumerate(batch.column(place[text])):
                body = body.as_py()
                made = encode(body) if body is not None else b""
                if digests_only:
                    digests.append((hashlib.sha256(made).hexdigest(), hashlib.sha256(decode(made)).hexdigest()))
                ids.append(made)
                held += len(made)
                if held >= BYTES or row + 1 == batch.num_rows:
                    yield finished(batch.slice(first, len(ids)), ids, digests)
                    first, held, ids, digests = row + 1, 0, [], []

    return docs.select(*[F.col(quoted(c)).alias(p) for c, p in place.items()]).mapInArrow(work, schema).toDF(*kept, *kinds)
