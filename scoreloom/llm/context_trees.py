"""Scoring texts with a context-tree mixture over bytes.

A byte is eight binary decisions.  For every context of up to ``depth`` bytes and every decision the training texts give two counts, and
the Krichevsky-Trofimov estimator a probability for them.  A node mixes, half and half, its own estimate and the product of those
of its longer contexts; seen from the training texts, a node's own estimate then has the weight ``stop``, and the probability of the next bit is
the chain of these weights along the context.  So every depth speaks, and no depth is chosen.

How it is spread: blocks of documents (hashed, about ``block`` bytes) list the different runs of depth + 1 bytes that they hold, with their counts in training
texts.  The lists meet by the last two bytes of context, so a task has whole subtrees; only sums over the subtrees, for the
256 contexts of one byte, pass the driver (at most 65,536 rows).  The probability of every run goes back to the blocks that asked, and a
block scores its texts.  Words are counted for a plain word model in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import stored, text_bytes
from scoreloom.llm.words import word_hashes

END, START = 0xFF, 0xFE  # bytes that UTF-8 never has: the end of a text, and what stands before it
END_WORD = np.uint64(0)  # the key of the end of a text among words
HALF = math.log(0.5)


@dataclass(frozen=True)
class Plan:
    """Bytes of context, bytes of text in a block, bytes handled at a time inside a block, and the pseudo-count of the word model."""

    depth: int = 5
    block: int = 16 << 20
    chunk: int = 2 << 20
    pseudo: float = 0.1


def log_gamma_table(size: int) -> np.ndarray:
    """Logarithms of gamma at 1/2, 1, 3/2, ... : entry n is that of n / 2."""
    out = np.zeros(2 * size + 2)
    out[1] = 0.5 * math.log(math.pi)
    steps = np.log(np.arange(1, 2 * size) / 2)
    out[3::2] = out[1] + np.cumsum(steps[0::2])[:len(out[3::2])]
    out[4::2] = np.cumsum(steps[1::2])[:len(out[4::2])]
    return out


TABLE = log_gamma_table(4096)


def log_gamma(halves: np.ndarray) -> np.ndarray:
    """Logarithm of gamma at n / 2 for whole n > 0: a table, and Stirling's series beyond it."""
    n = halves.astype(np.int64)
    x = np.maximum(halves, 8) / 2.0
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)
    return np.where(n < len(TABLE) - 1, TABLE[np.minimum(n, len(TABLE) - 2)], large)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(2 * a + 1) + log_gamma(2 * b + 1) - math.log(math.pi) - log_gamma(2 * (a + b) + 2)


def body_of(text: str | None) -> bytes:
    """The coded bytes of a text: lower case A-Z, and its end."""
    return (text.encode().lower() if text is not None else b"") + bytes([END])


def runs_of(bodies: list[bytes], depth: int) -> np.ndarray:
    """A key for each byte of the texts, in order: the bytes before it, the nearest highest, and itself."""
    pad = bytes([START]) * depth
    joined = np.frombuffer(b"".join([part for body in bodies for part in (pad, body)]), np.uint8)
    real = np.flatnonzero(joined[depth:] != START) + depth
    key = joined[real].astype(np.uint64)
    for back in range(1, depth + 1):
        key |= joined[real - back].astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
    return key


def chunks(texts: list, size: int) -> Iterator[range]:
    """Consecutive ranges of texts of about ``size`` bytes together; a longer text has one of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        many = len(text) if text is not None else 0
        if held and held + many > size:
            yield range(start, i)
            start, held = i, 0
        held += many
    if len(texts) > start:
        yield range(start, len(texts))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and how many of each are marked."""
    own, many = np.unique(keys[train], return_counts=True)
    rest = np.unique(keys[~train])
    return merged([(own, many), (rest, np.zeros(len(rest), np.int64))])


class Lookup:
    """Values of known keys: a table four times as large as the keys, a taken place leads to the next one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        owner = np.full(1 << bits, -1, np.int64)
        place, left = self.place(keys), np.arange(len(keys))
        while len(left):
            free = left[owner[place[left]] < 0]
            owner[place[free]] = free
            left = left[owner[place[left]] != left]
            place[left] = (place[left] + 1) & self.mask
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, values.dtype)
        self.keys[place], self.values[place] = keys, values

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all known."""
        place = self.place(keys)
        left = np.flatnonzero(self.keys[place] != keys)
        while len(left):
            place[left] = (place[left] + 1) & self.mask
            left = left[self.keys[place[left]] != keys[left]]
        return self.values[place]


def packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).tobytes())


def unpacked(body: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(body: bytes) -> np.ndarray:
    return np.cumsum(unpacked(body, np.uint64), dtype=np.uint64)


def words_in(text: str | None) -> np.ndarray:
    """Keys of a text's words in lower case A-Z, and of its end."""
    return np.append(np.maximum(word_hashes(text), np.uint64(1)), END_WORD)


def block_lists(texts: list, train: np.ndarray, plan: Plan) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Different runs and words of a block with their counts in its training texts."""
    found: dict[str, list] = {"run": [], "word": []}
    for part in chunks(texts, plan.chunk):
        bodies = [body_of(texts[i]) for i in part]
        marks = np.repeat(train[part.start:part.stop], [len(b) for b in bodies])
        found["run"].append(counted(runs_of(bodies, plan.depth), marks))
        words = [words_in(texts[i]) for i in part]
        found["word"].append(counted(np.concatenate(words), np.repeat(train[part.start:part.stop], [len(w) for w in words])))
    return {kind: merged(parts) for kind, parts in found.items()}


def subtree_of(keys: np.ndarray, kind: str, depth: int, parts: int) -> np.ndarray:
    """The part of the keys: for runs by the two nearest bytes of context, for words by the key."""
    own = keys >> np.uint64(8 * (depth - 1)) if kind == "run" else keys
    return ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)


class Subtrees:
    """Counts, mixtures and weights of all contexts of two bytes and more of one part."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.depth, self.keys = depth, keys
        self.symbols, self.up, self.nodes = {}, {}, {}
        level, many = keys, counts
        for d in range(depth, 1, -1):
            if d < depth:  # the same runs with one byte of context less
                level, up = np.unique((level >> np.uint64(16) << np.uint64(8)) | (level & np.uint64(255)), return_inverse=True)
                self.up[d + 1], many = up, np.bincount(up, many, len(level))
            self.symbols[d] = (level & np.uint64(255)).astype(np.int64)
            for k in range(8):
                node = np.cumsum(np.diff(level >> np.uint64(8 - k), prepend=level[:1] >> np.uint64(8 - k)) != 0)
                one = (self.symbols[d] >> (7 - k)) & 1
                size = int(node[-1]) + 1
                a, b = np.bincount(node, many * (1 - one), size), np.bincount(node, many * one, size)
                own = log_kt(a, b)
                if d == depth:
                    mixed, stop = own, np.ones(size)
                else:
                    below, _, _, weight, _ = self.nodes[d + 1, k]
                    first = np.flatnonzero(np.diff(below, prepend=-1))  # a run of each longer context's node
                    longer = np.bincount(node[self.up[d + 1][first]], weight, size)
                    mixed = HALF + np.logaddexp(own, longer)
                    stop = np.exp(HALF + own - mixed)
                self.nodes[d, k] = node, a, b, mixed, stop
            self.top = level

    def sums(self) -> pd.DataFrame:
        """Counts and products of the contexts of two bytes, summed over the second byte: ``c`` (byte before), ``node``, ``a``, ``b``, ``longer``."""
        out = []
        for k in range(8):
            node, a, b, mixed, _ = self.nodes[2, k]
            first = np.flatnonzero(np.diff(node, prepend=-1))
            near = (self.top[first] >> np.uint64(16)).astype(np.int64)
            place = near * 256 + ((1 << k) | (self.symbols[2][first] >> (8 - k)))
            which, where = np.unique(place, return_inverse=True)
            total = lambda x: np.bincount(where, x, len(which))
            out.append(pd.DataFrame({"c": which // 256, "node": which % 256, "a": total(a).astype(np.int64), "b": total(b).astype(np.int64), "longer": total(mixed)}))
        return pd.concat(out)

    def log10(self, shallow: Shallow) -> np.ndarray:
        """log10 of the probability of every run's last byte after the bytes before it."""
        out = np.zeros(len(self.keys))
        near, symbol = (self.keys >> np.uint64(8 * self.depth)).astype(np.int64), self.symbols[self.depth]
        for k in range(8):
            one, gram, p = (symbol >> (7 - k)) & 1, np.arange(len(self.keys)), None
            for d in range(self.depth, 1, -1):
                node, a, b, _, stop = self.nodes[d, k]
                at = node[gram]
                own = (np.where(one, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1)
                p = own if p is None else stop[at] * own + (1 - stop[at]) * p
                if d > 2:
                    gram = self.up[d][gram]
            out += np.log10(shallow.mix((1 << k) | (symbol >> (8 - k)), near, one, p))
        return out


class Shallow:
    """The contexts of one byte and of none, from the sums of all parts: 257 tables of 256 nodes."""

    def __init__(self, sums: list):
        self.a, self.b, longer = np.zeros((257, 256)), np.zeros((257, 256)), np.zeros((257, 256))
        for c, node, a, b, product in sums:
            self.a[c, node], self.b[c, node], longer[c, node] = a, b, product
        self.a[256], self.b[256] = self.a[:256].sum(axis=0), self.b[:256].sum(axis=0)
        own = log_kt(self.a, self.b)
        mixed = HALF + np.logaddexp(own, longer)
        longer[256] = mixed[:256].sum(axis=0)
        mixed[256] = HALF + np.logaddexp(own[256], longer[256])
        self.stop = np.exp(HALF + own - mixed)

    def mix(self, node: np.ndarray, near: np.ndarray, one: np.ndarray, p: np.ndarray) -> np.ndarray:
        for context in (near, 256):
            a, b, stop = self.a[context, node], self.b[context, node], self.stop[context, node]
            p = stop * (np.where(one, b, a) + 0.5) / (a + b + 1) + (1 - stop) * p
        return p


def score_block(texts: list, replies: pd.DataFrame, parts: int, plan: Plan, n_words: int, n_kinds: int) -> pd.DataFrame:
    """Scores of a block's texts from the answers for its runs and words."""
    answers = {}
    for kind, number in (("run", np.float32), ("word", np.int64)):
        own = replies[replies["kind"] == kind]
        keys = np.concatenate([unpack_keys(k) for k in own["keys"]])
        answers[kind] = Lookup(keys, np.concatenate([unpacked(v, number) for v in own["values"]]))
    out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
    for part in chunks(texts, plan.chunk):
        bodies = [body_of(texts[i]) for i in part]
        each = answers["run"](runs_of(bodies, plan.depth)).astype(np.float64)
        out["score"] += np.add.reduceat(each, np.cumsum([0, *[len(b) for b in bodies]])[:-1]).tolist()
        words = [words_in(texts[i]) for i in part]
        starts = np.cumsum([0, *[len(w) for w in words]])[:-1]
        c = answers["word"](np.concatenate(words))
        base = np.log10((c + plan.pseudo) / (n_words + plan.pseudo * (n_kinds + 1)))
        out["n_tokens"] += [len(w) for w in words]
        out["n_known"] += np.add.reduceat((c > 0).astype(np.int64), starts).tolist()
        out["base_score"] += np.add.reduceat(base, starts).tolist()
    return pd.DataFrame(out)


def held_out(identity: Column, parts: int = 10, part: int = 0) -> Column:
    """Whether the identity, as text, has a checksum that keeps it out of training; false for a null identity."""
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % parts == part, F.lit(False))


def score_texts(docs: DataFrame, plan: Plan = Plan(), text: str = "text", identity: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``, one row for each row.

    ``score``: log10 of the probability that the mixture gives the text, in lower case A-Z and with its end.  ``base_score``: the sum over words and
    the end of log10 of (count + 0.1) / (all + 0.1 * (kinds + 1)), counts in the training texts.  A null text counts as empty: its end is
    its one token.  Rows with a null id train.  Repeated rows count each time.  With no training rows all
    counts are 0.  An empty table gives no rows.  Words are told apart by 64-bit hashes.  Other columns are not read.
    """
    parts = max(1, -(-text_bytes(docs, text) // plan.block))
    own = docs.select(F.col(identity).alias("doc_id"), held_out(F.col(identity)).alias("held_out"), F.col(text).alias("text"),
                      F.pmod(F.xxhash64(F.col(identity), F.col(text)), F.lit(parts)).alias("block"))
    as_list = lambda column: [t if isinstance(t, str) else None for t in column]

    def ask(block: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for kind, (keys, counts) in block_lists(as_list(block["text"]), ~block["held_out"].to_numpy(bool), plan).items():
            part = subtree_of(keys, kind, plan.depth, parts)
            order = np.argsort(part, kind="stable")
            for own_keys, own_counts, name in zip(*[np.split(x[order], np.flatnonzero(np.diff(part[order])) + 1) for x in (keys, counts, part)], strict=True):
                rows.append((block["block"].iloc[0], kind, int(name[0]), pack_keys(own_keys), packed(own_counts)))
        return pd.DataFrame(rows, columns=["block", "kind", "part", "keys", "counts"])

    asked = stored(own.select("block", "held_out", "text").groupBy("block").applyInPandas(ask, "block bigint, kind string, part bigint, keys binary, counts binary"), "context-runs")

    def met(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return merged([(unpack_keys(k), unpacked(c, np.int64)) for k, c in zip(rows["keys"], rows["counts"], strict=True)])

    runs, words = asked.where("kind = 'run'"), asked.where("kind = 'word'")
    sums = runs.groupBy("part").applyInPandas(lambda rows: Subtrees(*met(rows), plan.depth).sums(), "c bigint, node bigint, a bigint, b bigint, longer double")
    shallow = Shallow(sums.groupBy("c", "node").agg(F.sum("a"), F.sum("b"), F.sum("longer")).collect())  # at most 256 * 255 rows

    def kinds(rows: pd.DataFrame) -> pd.DataFrame:
        counts = met(rows)[1]
        return pd.DataFrame({"n": [int(counts.sum())], "v": [int((counts > 0).sum())]})

    total = words.groupBy("part").applyInPandas(kinds, "n bigint, v bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = met(rows)
        run = rows["kind"].iloc[0] == "run"
        values = Subtrees(keys, counts, plan.depth).log10(shallow).astype(np.float32) if run else counts
        out = rows[["block", "kind", "keys"]].copy()
        out["values"] = [packed(values[np.searchsorted(keys, unpack_keys(k))]) for k in rows["keys"]]
        return out

    replies = asked.groupBy("kind", "part").applyInPandas(answer, "block bigint, kind string, keys binary, values binary")

    def score(block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "score"])
        texts = as_list(block["text"])
        found = score_block(texts, replies, parts, plan, total[0], total[1])
        found.insert(0, "n_bytes", [len(body_of(t)) - 1 for t in texts])
        found.insert(0, "held_out", block["held_out"].to_numpy())
        found.insert(0, "doc_id", block["doc_id"].to_numpy())
        return found

    id_type = docs.schema[identity].dataType.simpleString()
    scored = own.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        score, f"doc_id {id_type}, held_out boolean, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total[0]).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
                         (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
