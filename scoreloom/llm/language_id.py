"""Language identification with a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in segments of fixed length.  One recurrent layer reads each segment forwards and one backwards; every
byte gets a distribution over the languages from both states, and a document's distribution is the mean over all its bytes.  The
network is trained in numpy by backpropagation through time on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import quoted
from scoreloom.operators.skew import top_per_group

SEGMENT = 192  # bytes read from a zero state
ROWS = 2048  # segments that go through the network together
LETTER = regex.compile(r"\p{L}")
UNDECIDED = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Direction:
    """Weights of one gated layer: input table (a row a byte, for update, reset and new state), recurrent weights of the same three."""

    table: np.ndarray
    gates: np.ndarray
    new: np.ndarray

    def states(self, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step, for byte numbers of shape (length, rows)."""
        h_size = self.new.shape[0]
        h = np.zeros((steps.shape[1], h_size), np.float32)
        out = np.empty((*steps.shape, h_size), np.float32)
        for t, symbols in enumerate(steps):
            x = self.table[symbols]
            zr = sigmoid(x[:, :2 * h_size] + h @ self.gates)
            z, r = zr[:, :h_size], zr[:, h_size:]
            n = np.tanh(x[:, 2 * h_size:] + (r * h) @ self.new)
            if keep is not None:
                keep.append((h, z, r, n))
            h = out[t] = n + z * (h - n)
        return out

    def gradient(self, steps: np.ndarray, keep: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of table, gates and new, given those of the states: backpropagation through time."""
        d_table, d_gates, d_new = np.zeros_like(self.table), np.zeros_like(self.gates), np.zeros_like(self.new)
        d_h = np.zeros_like(d_out[0])
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, n = keep[t]
            d_h = d_h + d_out[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_rh = d_n @ self.new.T
            d_zr = np.concatenate([d_h * (h - n) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
            d_new += (r * h).T @ d_n
            d_gates += h.T @ d_zr
            np.add.at(d_table, steps[t], np.concatenate([d_zr, d_n], axis=1))
            d_h = d_h * z + d_rh * r + d_zr @ self.gates.T
        return [d_table, d_gates, d_new]


@dataclass
class Network:
    """Both directions and the output weights over the languages."""

    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        layer = lambda: Direction(rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32), rng.normal(0, hidden ** -0.5, (hidden, 2 * hidden)).astype(np.float32),
                                  rng.normal(0, hidden ** -0.5, (hidden, hidden)).astype(np.float32))
        return cls(languages, layer(), layer(), rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def positions(self, steps: np.ndarray) -> np.ndarray:
        """Distribution over the languages at every position, for byte numbers (256: no byte) of shape (length, rows)."""
        both = np.concatenate([self.ahead.states(steps), self.back.states(steps[::-1])[::-1]], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=2, keepdims=True)

    def train_step(self, steps: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all real positions, and the gradients in the order of ``weights``."""
        kept: tuple[list, list] = ([], [])
        hf, hb = self.ahead.states(steps, kept[0]), self.back.states(steps[::-1], kept[1])
        both = np.concatenate([hf, hb[::-1]], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        real = (steps < 256).astype(np.float32)
        many = max(1.0, float(real.sum()))
        rows = np.arange(len(labels))
        loss = float(-(np.log(p[:, rows, labels] + 1e-9) * real).sum() / many)
        p[:, rows, labels] -= 1
        p *= real[:, :, None] / many
        d_both = p @ self.out.T
        h = self.ahead.new.shape[0]
        gradients = [*self.ahead.gradient(steps, kept[0], d_both[:, :, :h]), *self.back.gradient(steps[::-1], kept[1], d_both[::-1, :, h:]),
                     np.tensordot(both, p, ([0, 1], [0, 1])), p.sum(axis=(0, 1))]
        return loss, gradients

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.gates, self.ahead.new, self.back.table, self.back.gates, self.back.new, self.out, self.bias]


def as_steps(texts: list[bytes], length: int) -> np.ndarray:
    """Byte numbers of texts of at most ``length`` bytes as (length, rows), filled up with 256."""
    out = np.full((len(texts), length), 256, np.int64)
    for row, body in zip(out, texts, strict=True):
        row[:len(body)] = np.frombuffer(body, np.uint8)
    return np.ascontiguousarray(out.T)


def train(texts: list[bytes], languages: list[str], hidden: int = 8, rounds: int = 600, rows: int = 128, length: int = 96, rate: float = 0.02, seed: int = 7) -> Network:
    """A network for labelled texts: Adam over random pieces of ``length`` bytes, languages drawn evenly."""
    names = sorted(set(languages))
    net, rng = Network.fresh(names, hidden, seed), np.random.default_rng(seed)
    pools = [[t for t, own in zip(texts, languages, strict=True) if own == name and t] or [b" "] for name in names]
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        labels = rng.integers(0, len(names), rows)
        bodies = []
        for label in labels:
            body = pools[label][rng.integers(len(pools[label]))]
            at = rng.integers(0, max(1, len(body) - length + 1))
            bodies.append(body[at:at + length])
        _, gradients = net.train_step(as_steps(bodies, length), labels)
        pace = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for w, g, a, b in zip(weights, gradients, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= pace * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return net


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its pooled probability for each text; ``und`` and 0 without a letter.

    Segments of all texts fill batches of ROWS rows; a batch's probabilities are added to their documents at once, so memory doesn't
    grow with a text.  Segments of fewer bytes are filled up with a symbol that counts for nothing.
    """
    sums, counts = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    owners: list[int] = []
    bodies: list[bytes] = []

    def flush() -> None:
        steps = as_steps(bodies, max(map(len, bodies)))
        p = net.positions(steps)
        real = steps < 256
        np.add.at(sums, owners, (p * real[:, :, None]).sum(axis=0))
        np.add.at(counts, owners, real.sum(axis=0))
        owners.clear(), bodies.clear()

    lettered = [text is not None and LETTER.search(text) is not None for text in texts]
    for i, text in enumerate(texts):
        body = text.encode() if lettered[i] else b""
        for at in range(0, len(body), SEGMENT):
            owners.append(i)
            bodies.append(body[at:at + SEGMENT])
            if len(bodies) == ROWS:
                flush()
    if bodies:
        flush()
    pooled = sums / np.maximum(counts, 1)[:, None]
    best = pooled.argmax(axis=1)
    return ([net.languages[b] if ok else UNDECIDED for b, ok in zip(best, lettered, strict=True)],
            [min(1.0, float(pooled[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, lettered, strict=True))])


def held_out(identity: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether the identity, as text, has a checksum that keeps it out of training; false for a null identity."""
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, text: str, label: str, identity: str, each: int = 250, size: int = 2048) -> DataFrame:
    """At most ``each`` labelled documents of every language, and of each at most ``size`` characters from a place drawn by hash."""
    at = F.pmod(F.xxhash64(F.lit(3), identity), F.greatest(F.length(text) - size, F.lit(1))).cast("int") + 1
    known = docs.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("label"), F.substring(F.col(text), at, F.lit(size)).alias("body"),
                                                                             F.xxhash64(F.lit(1), identity, label).alias("order"))
    return top_per_group(known, ["label"], [F.col("order"), F.col("body")], each).select("label", "body")


def identify(docs: DataFrame, text: str = "text", label: str = "lang", identity: str = "doc_id", **options) -> DataFrame:
    """The documents' columns but text and label, with ``held_out``, ``lang_pred`` and ``score``, one row for each document.

    Trained on a bounded sample (``labelled_sample``) of the documents not held out; label, source and identity are no inputs of a
    prediction.  Texts that are null or have no letter get ``und`` and 0, as do all texts where no document is labelled.
    Columns of the added names are replaced.
    """
    added = ["held_out", "lang_pred", "score"]
    kept = [c for c in docs.columns if c not in (*added, text, label)]
    sample = labelled_sample(docs.where(~held_out(F.col(identity))), text, label, identity).collect()  # bounded: 250 pieces a language
    sample = sorted((r.label, r.body) for r in sample)
    net = train([body.encode() for _, body in sample], [name for name, _ in sample], **options) if sample else None
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)]  # a name may be any text

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.drop(columns=["__text"])
            texts = [t if isinstance(t, str) else None for t in batch["__text"]]
            out["lang_pred"], out["score"] = predict(net, texts) if net else ([UNDECIDED] * len(out), [0.0] * len(out))
            yield out

    asked = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)], held_out(F.col(identity)).alias("held_out"), F.col(text).alias("__text"))
    return asked.mapInPandas(work, ", ".join([*fields, "held_out boolean", "lang_pred string", "score double"])).toDF(*kept, *added)
