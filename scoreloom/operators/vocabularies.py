"""Mentions of a vocabulary that is a table: texts and aliases of any number, joined by equality.

Texts and aliases are cut into tokens, runs of word characters or single other characters.  An alias stands in a text where the same characters
stand from the beginning of one token to the end of another.  Texts are dealt out once, in chunks; of the runs of tokens of a chunk only different hashes meet
the aliases, and a chunk gets back the aliases that may stand in it, so what travels does not grow with how often something is
said.  Characters decide: a hash only tells what to compare.  Of the aliases at a place the longest counts, and mentions
do not overlap, the first from the left winning, as one pattern of all aliases would have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.text import fold, strip

TOKEN = r"(?U)[\w']+|[^\w'\s]"
WORD, WHITE = 1, 2  # kinds of characters
CHUNK = 1 << 22  # characters of texts that get their aliases together, about
BATCH = 1 << 19  # characters that are hashed at once
BASE = 0x9E3779B97F4A7C15 | 1


@cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its kind as in ``TOKEN``, and its lower case (a final sigma is a sigma)."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for found in regex.finditer(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}']+", every):
        kind[ord(every[found.start()]):ord(every[found.end() - 1]) + 1] = WORD
    kind[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    for c in regex.findall(r"\p{Changes_When_Lowercased}", every):
        lower[ord(c)] = ord(c.lower()[0])
    lower[ord("ς")] = ord("σ")
    return kind, lower


def powers(base: int, many: int) -> np.ndarray:
    out = np.full(many, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@cache
def usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(BASE, 2 * BATCH), powers(pow(BASE, -1, 1 << 64), 2 * BATCH)


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the folded runs of code points from ``starts`` to ``ends``: polynomials, from sums over the whole."""
    codes = characters()[1][points]
    at = np.arange(len(codes) + 1)
    two = (codes == 0xDF) | (points == 0x130)  # ß is ss, and the i with a dot an i and a dot
    if two.any():
        at = np.r_[0, np.cumsum(1 + two)]
        seconds = np.where(points[two] == 0x130, 0x307, ord("s"))
        codes = np.where(codes == 0xDF, ord("s"), codes)
        codes = np.repeat(codes, 1 + two)
        codes[at[1:][two] - 1] = seconds
    many = len(codes)
    up, down = usual_powers() if many < 2 * BATCH else (powers(BASE, many + 1), powers(pow(BASE, -1, 1 << 64), many + 1))
    total = np.zeros(many + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:many], out=total[1:])
    x = (total[at[ends]] - total[at[starts]]) * down[at[starts]]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def joined_texts(texts: list[str | None]) -> tuple[str, np.ndarray]:
    """Texts behind each other, a space behind each, and where each begins."""
    texts = ["" if t is None else t for t in texts]
    return " ".join([*texts, ""]), np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)


def stretches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of ``BATCH`` characters together, or of one text."""
    lo = held = 0
    for i, t in enumerate(texts):
        size = len(t or "") + 1
        if i > lo and held + size > BATCH:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(texts):
        yield lo, len(texts)


def runs_of_tokens(texts: list[str | None], counts: list[int]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, where each begins, and of each run of as many tokens as aliases have: text, start, end, hash.

    A run begins at a token that no word is glued to, and no word goes on behind it.
    """
    whole, begins = joined_texts(texts)
    points = code_points(whole)
    kind = characters()[0][points]
    word, alone = kind == WORD, kind == 0
    first, last = np.flatnonzero(alone | word & ~np.r_[False, word[:-1]]), np.flatnonzero(alone | word & ~np.r_[word[1:], False]) + 1
    own = np.searchsorted(begins, first, side="right") - 1
    open_start = ~np.r_[False, (last[:-1] == first[1:]) & word[first[:-1]]][:len(first)]
    open_end = ~word[np.minimum(last, len(points) - 1)]
    starts, ends, texts_of = [], [], []
    for n in counts:
        i = np.flatnonzero(open_start[:len(first) - n + 1] & open_end[n - 1:] & (own[:len(first) - n + 1] == own[n - 1:])) if n <= len(first) else np.zeros(0, np.int64)
        starts.append(first[i]), ends.append(last[i + n - 1]), texts_of.append(own[i])
    start, end, text = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, texts_of))
    return whole, begins, text, start, end, run_hashes(points, start, end)


def bits_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes % np.uint64(bits), (hashes >> np.uint64(32) ^ hashes << np.uint64(29)) % np.uint64(bits)


def hashed(spelled: DataFrame) -> DataFrame:
    """The aliases with the hash of their spelling as ``__hash``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__spelling").to_pylist()
            out = []
            for lo, hi in stretches(texts):
                whole, begins = joined_texts(texts[lo:hi])
                out.append(run_hashes(code_points(whole), begins[:-1], begins[1:] - 1))
            yield batch.append_column("__hash", pa.array(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)))

    return spelled.mapInArrow(work, T.StructType([*spelled.schema.fields, T.StructField("__hash", T.LongType())]))


def filter_of(hashes: DataFrame, bits: int) -> dict[int, bytes]:
    """Which of so many bits the hashes set, in 64 parts.  It only saves work: what it lets pass by chance finds no alias."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for bit in bits_of(batch.column("__hash").to_numpy(zero_copy_only=False).view(np.uint64), bits):
                np.bitwise_or.at(own, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        set_parts = [(i, pa.compress(x.tobytes(), "lz4", asbytes=True)) for i, x in enumerate(own.reshape(64, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in set_parts], pa.int32()), pa.array([x for _, x in set_parts], pa.binary())], ["part", "body"])

    def either(rows: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce([np.frombuffer(pa.decompress(x, bits >> 9, "lz4", asbytes=True), np.uint8) for x in rows["body"]])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "body": [pa.compress(whole.tobytes(), "lz4", asbytes=True)]})

    got = hashes.select("__hash").mapInArrow(work, "part int, body binary").groupBy("part").applyInPandas(either, "part int, body binary").collect()
    return {r.part: bytes(r.body) for r in got}


def apart(group: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of the spans of each group, in order of their starts, stay when each must begin behind the last that stayed."""
    if not len(first):
        return np.zeros(0, np.int64)
    number = np.cumsum(np.r_[0, group[1:] != group[:-1]]).astype(np.int64) << 32
    reach = np.maximum.accumulate(number + last)
    free = np.r_[True, number[1:] + first[1:] >= reach[:-1]]  # behind all before them; the others are walked from the last such one on
    stays = free.copy()
    met = np.flatnonzero(~free)
    until = 0
    for i, lo, hi, before in zip(met.tolist(), first[met].tolist(), last[met].tolist(), free[met - 1].tolist(), strict=True):
        if before:
            until = int(last[i - 1])
        if lo >= until:
            stays[i], until = True, hi
    return np.flatnonzero(stays)


def written_runs(whole: str, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The runs of a text from ``start`` to ``end`` (characters), copied at once."""
    body = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
    if len(body) != len(whole):
        at = np.r_[np.flatnonzero((body & 0xC0) != 0x80), len(body)]
        start, end = at[start], at[end]
    edges = np.r_[0, np.cumsum(end - start)]
    flat = body[np.arange(edges[-1]) + np.repeat(start - edges[:-1], end - start)]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(flat))


def table_mentions(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, alias: str = "alias", value: str = "value", overlaps: bool = False) -> DataFrame:
    """``key, value, alias, position, length``: every mention of an alias in a text, with 0-based character positions.

    Case does not count.  An alias that several values have stands for the least of them; blank aliases name nothing.  Texts of one key count as one: of
    mentions that begin at the same place, or overlap, one is given.
    With ``overlaps`` the longest alias at each place is given even where another mention covers the place.  A filter of the aliases' hashes, 32 bits an alias and 16 MB at most, goes
    through the driver; the aliases themselves meet the hashes of the texts' runs of tokens by equality, and Spark broadcasts a vocabulary by its measured size only.
    """
    spark = texts.sparkSession
    spelled = (vocabulary.select(fold(strip(F.col(alias))).alias("__spelling"), F.col(value).alias("value")).where("__spelling <> ''")
               .groupBy("__spelling").agg(F.min("value").alias("value")))
    spelled = hashed(spelled).withColumn("__tokens", F.regexp_count("__spelling", F.lit(TOKEN))).persist()  # read for the filter and for the join
    told = spelled.agg(F.count(F.lit(1)), F.coalesce(F.array_sort(F.collect_set("__tokens")), F.array().cast("array<int>"))).first()
    counts = [n for n in told[1] if n]
    bits = 1 << min(max(32 * told[0], 1 << 16).bit_length(), 27)
    wanted = spark.sparkContext.broadcast(filter_of(spelled, bits))
    size = texts.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(parts, -(-size // CHUNK))
    dealt = (texts.select(F.pmod(F.xxhash64(F.col(key)), F.lit(chunks)).alias("__chunk"), F.col(key).alias("__key"), F.col(text).alias("__text"))
             .repartition(parts, "__chunk"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.zeros((64, bits >> 9), np.uint8)
        for part, body in wanted.value.items():
            passes[part] = np.frombuffer(pa.decompress(body, bits >> 9, "lz4", asbytes=True), np.uint8)
        passes = passes.reshape(-1)
        held: dict[int, np.ndarray] = {}

        def frame() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(held), np.int64), [len(x) for x in held.values()])),
                                               pa.array(np.concatenate(list(held.values())).view(np.int64))], ["__chunk", "__asked"])
        for batch in batches:
            bodies, chunk = batch.column("__text").to_pylist(), batch.column("__chunk").to_numpy(zero_copy_only=False)
            for lo, hi in stretches(bodies):
                _, _, own, _, _, h = runs_of_tokens(bodies[lo:hi], counts)
                for nth in range(2):
                    bit = bits_of(h, bits)[nth]
                    near = np.flatnonzero(passes[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                    h, own = h[near], own[near]
                of = chunk[lo:hi][own]
                for c in np.unique(chunk[lo:hi]).tolist():
                    held[c] = np.unique(np.r_[held.get(c, np.zeros(0, np.uint64)), pd.unique(h[of == c])])
            if sum(map(len, held.values())) > 1 << 21:
                yield frame()
                held.clear()
        if held:
            yield frame()

    may_stand = dealt.mapInArrow(asked, "__chunk long, __asked long")
    hits = (may_stand.join(spelled.select("__hash", "__spelling", "value"), F.col("__asked") == F.col("__hash"))
            .select(F.col("__chunk").alias("__of"), "__spelling", "value"))
    out = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("value", spelled.schema["value"].dataType), T.StructField("alias", T.StringType()),
                        T.StructField("position", T.IntegerType()), T.StructField("length", T.IntegerType())])

    def stand(left: pa.Table, right: pa.Table) -> pa.Table:
        bodies, keys, values = left.column("__text").to_pylist(), left.column("__key").combine_chunks(), right.column("value").combine_chunks()
        spellings = right.column("__spelling").combine_chunks()
        numbers = {spelling: i for i, spelling in enumerate(spellings.to_pylist())}
        group = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy(zero_copy_only=False) if len(left) else np.zeros(0, np.int64)
        several = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)  # rows whose key others have too
        whole, begins = joined_texts(list(numbers))
        own = np.array(list(numbers.values()), np.int64)
        hashes, first = np.unique(run_hashes(code_points(whole), begins[:-1], begins[1:] - 1), return_index=True)
        passes = np.zeros(1 << 22, bool)
        passes[(hashes >> np.uint64(42)).astype(np.int64)] = True

        def exact(whole: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            """The alias of each run, by its characters; -1 without one."""
            number_of: dict[str, int] = {}  # as it is written
            out = []
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                said = whole[a:b]
                n = number_of.get(said)
                if n is None:
                    n = number_of[said] = numbers.get(said.lower().replace("ß", "ss"), -1)
                out.append(n)
            return np.array(out, np.int64)

        def chosen(whole: str, text: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
            """Of runs in any order the longest at each place, and of those what does not overlap."""
            order = np.lexsort((-end, start))
            order = order[np.r_[True, np.diff(start[order]) > 0][:len(order)]]
            text, start, end, number = text[order], start[order], end[order], number[order]
            if overlaps:
                return [text, start, end, number]
            stays = apart(text, start, end)
            return [text[stays], start[stays], end[stays], number[stays]]

        parts: list[pa.Table] = []

        def give(row: np.ndarray, at: np.ndarray, size: np.ndarray, number: np.ndarray, written: pa.Array) -> None:
            parts.append(pa.Table.from_arrays([keys.take(pa.array(row)), values.take(pa.array(number)), written, pa.array(at, pa.int32()), pa.array(size, pa.int32())], schema=shape))

        shape = pa.schema([(key, keys.type), ("value", values.type), ("alias", pa.string()), ("position", pa.int32()), ("length", pa.int32())])
        shared: list[tuple] = []
        for lo, hi in stretches(bodies) if numbers else ():
            whole, begins, text, start, end, h = runs_of_tokens(bodies[lo:hi], counts)
            near = np.flatnonzero(passes[(h >> np.uint64(42)).astype(np.int64)])
            place = np.minimum(np.searchsorted(hashes, h[near]), len(hashes) - 1)
            same = hashes[place] == h[near]
            near, number = near[same], own[first[place[same]]]
            text, start, end = text[near], start[near], end[near]
            alone = ~several[lo + text]
            if not alone.all():
                n = exact(whole, start[~alone], end[~alone])
                shared += [(group[lo + t], a - begins[t], b - a, i, lo + t) for t, a, b, i in zip(text[~alone].tolist(), start[~alone].tolist(), end[~alone].tolist(), n.tolist(), strict=True) if i >= 0]
                text, start, end, number = text[alone], start[alone], end[alone], number[alone]
            one = chosen(whole, text, start, end, number)
            written = written_runs(whole, one[1], one[2])
            # the hash told what to compare; where that is not an alias after all, characters decide from the start
            wrong = np.flatnonzero(~pc.equal(pc.utf8_lower(written), spellings.take(pa.array(one[3]))).to_numpy(zero_copy_only=False))
            if len(wrong) and (exact(whole, one[1][wrong], one[2][wrong]) != one[3][wrong]).any():
                number = exact(whole, start, end)
                stands = number >= 0
                one = chosen(whole, text[stands], start[stands], end[stands], number[stands])
                written = written_runs(whole, one[1], one[2])
            give(lo + one[0], one[1] - begins[one[0]], one[2] - one[1], one[3], written)
        if shared:  # texts of one key count as one: the longest at a place first, then the least value, and what is written as its value is
            rank = pc.rank(values, null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)

            def place_of(m: tuple) -> tuple:
                said = bodies[m[4]][m[1]:m[1] + m[2]]
                return m[0], m[1], -m[2], rank[m[3]], said != str(values[m[3]].as_py()), said
            shared.sort(key=place_of)
            of, at, size, number, row = (np.array(x, np.int64) for x in zip(*shared, strict=True))
            stays = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1])])
            stays = stays if overlaps else stays[apart(of[stays], at[stays], (at + size)[stays])]
            row, at, size, number = row[stays], at[stays], size[stays], number[stays]
            give(row, at, size, number, pa.array([bodies[r][a:a + n] for r, a, n in zip(row.tolist(), at.tolist(), size.tolist(), strict=True)], pa.string()))
        return pa.concat_tables(parts) if parts else shape.empty_table()

    return dealt.groupBy("__chunk").cogroup(hits.groupBy("__of")).applyInArrow(stand, out)
