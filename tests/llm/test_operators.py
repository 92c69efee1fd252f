"""The operators for training text on small tables: odd rows, skew, and plain versions of what SQL cannot say."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import context_trees, language_id, line_rules, minhash, mixing, neighbours, passages, sharding, url_lists, words
from scoreloom.llm.common import cut
from scoreloom.llm.components import components

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_words string, score string, component_id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and blank texts, repeats, a long text, and columns whose names clash with results."""
    long = " ".join(f"w{i % 997} x{i}" for i in range(30_000))
    rows = [(None, None, None, None), (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, "One two", None, "a"), (4, "One two", None, "a"),
            (5, long, "en", "b"), (6, long + " tail", "de", "b"), (None, long, "de", "b"), (7, "é 你好 \x00 fin.", "fr", "")]
    return cut(spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], ODD))


def test_all_take_odd_rows(spark, odd):
    import corpus_pipeline

    for docs in (odd, odd.limit(0), odd.where("text is null")):
        n = docs.count()
        assert context_trees.score_texts(docs).count() == n
        assert sharding.shard_documents(docs).count() == n
        assert minhash.near_duplicates(docs).count() == n
        assert mixing.mix_documents(docs).count() == n
        assert line_rules.judge_lines(docs).count() == n
        assert language_id.identify(docs, rounds=5).count() == n
        passages.shared_passages(docs).count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SF)
            assert kept.columns == docs.columns and kept.count() >= 0
    got = {r.doc_id: r for r in minhash.near_duplicates(odd).withColumnRenamed("id", "doc_id").where("doc_id is not null").collect()}
    assert got[1].n_shingles == 0 and got[1].kept and got[6].component_id == 5 and not got[6].kept and got[4].n_shingles == 1


def test_all_take_clashing_names(spark, odd):
    """Columns called like those that operators add or use inside, and a name with a dot."""
    import corpus_pipeline

    names = ["lines", "id", "copies", "a.b", "kept", "shard", "size", "u", "v", "n", "b", "__row", "__text", "clean_text", "words", "target", "n_chars"]
    docs = cut(odd.select("*", *[F.lit("clash").alias(c) if c != "n_chars" else F.lit(7).alias(c) for c in names]))
    n = docs.count()
    for made in (context_trees.score_texts(docs), sharding.shard_documents(docs), minhash.near_duplicates(docs), mixing.mix_documents(docs), line_rules.judge_lines(docs),
                 language_id.identify(docs.select("doc_id", "text", "lang", "`a.b`", "copies"), rounds=5)):
        assert made.count() == n
    passages.shared_passages(docs).count()
    assert set(line_rules.judge_lines(docs).columns) >= {"lines", "a.b", "id", "__row", "clean_text"}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and {r["lines"] for r in kept.collect()} <= {"clash"}
    assert corpus_pipeline.tokens(spark, docs, SF).count() == n
    import public_tokenizers
    from scoreloom.llm import byte_bpe
    coded = byte_bpe.with_ids(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {"a.b", "text", "ids"} < set(coded.columns) and coded.where("ids is not null").count() == n


def test_context_trees_against_plain_counts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abab aba.", "abba", "", "b", "Abab aba.", None, "zz", "ab", "abab", "ba ab ab", "ab b a", "abb"] * 3)], "doc_id long, text string")
    plan = context_trees.Plan(depth=3)
    got = {r.doc_id: r for r in context_trees.score_texts(docs, plan).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts, tokens = defaultdict(lambda: [0, 0]), Counter()
    coded = {i: b"\xfe" * 3 + (t or "").encode().lower() + b"\xff" for i, t in rows}
    for i, t in rows:
        if not held[i]:
            tokens.update([*(t or "").encode().lower().split(), b""])
            for p in range(3, len(coded[i])):
                for d, k in itertools.product(range(4), range(8)):
                    counts[coded[i][p - d:p], (1 << k) | (coded[i][p] >> (8 - k))][(coded[i][p] >> (7 - k)) & 1] += 1
    kt = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - 2 * math.lgamma(.5) - math.lgamma(a + b + 1)
    nodes = defaultdict(list)
    for context, node in counts:
        if context:
            nodes[context[1:], node].append(context)

    def weight(context, node):
        own = kt(*counts[context, node])
        return own if len(context) == 3 else math.log(.5) + np.logaddexp(own, sum(weight(c, node) for c in nodes[context, node]))

    def bit(history, d, node, one):
        a, b = counts.get((history[len(history) - d:], node), (0, 0))
        own = ((b if one else a) + .5) / (a + b + 1)
        if d == 3:
            return own
        context = history[len(history) - d:]
        stop = math.exp(math.log(.5) + kt(a, b) - weight(context, node)) if (context, node) in counts else .5
        return stop * own + (1 - stop) * bit(history, d + 1, node, one)

    total, kinds = sum(tokens.values()), len(tokens)
    for i, t in rows:
        want = sum(math.log10(bit(coded[i][:p], 0, (1 << k) | (coded[i][p] >> (8 - k)), (coded[i][p] >> (7 - k)) & 1)) for p in range(3, len(coded[i])) for k in range(8))
        own = [*(t or "").encode().lower().split(), b""]
        assert abs(got[i].score - want) < 1e-4 * max(1, -want) and got[i].held_out == held[i]
        assert got[i].n_tokens == len(own) and got[i].n_known == sum(tokens[w] > 0 for w in own) and got[i].train_tokens == total
        assert abs(got[i].base_score - sum(math.log10((tokens[w] + .1) / (total + .1 * (kinds + 1))) for w in own)) < 1e-9


def test_context_trees_beat_words_on_held_out(spark):
    got = context_trees.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_language_is_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs.select("doc_id", "text", "lang")).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert language_id.predict(language_id.Network.fresh(["a", "b"], 4, 1), [None, "", "12 !?"]) == (["und"] * 3, [0.0] * 3)


def test_gradient_through_time():
    net = language_id.Network.fresh(["a", "b"], 3, 1)
    steps, labels = language_id.as_steps([b"abcab", b"xy"], 5), np.array([0, 1])
    _, gradients = net.train_step(steps, labels)
    for weight, gradient in zip(net.weights(), gradients, strict=True):
        place = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        kept = weight[place]
        around = []
        for move in (0.01, -0.01):
            weight[place] = kept + move
            around.append(net.train_step(steps, labels)[0])
        weight[place] = kept
        assert abs((around[0] - around[1]) / 0.02 - gradient[place]) < 5e-3


def test_neighbours_against_all(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).normal(size=(300, 16)))]
    rows += [(i, rows[3][1]) for i in range(300, 420)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0] * 3), (None, rows[0][1])]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    known = {i: np.array(v) for i, v in rows[:420]}
    hits = 0
    for q in (i for i in known if i % 20 == 0):
        want = sorted(((-float((known[q] * v).sum()), i) for i, v in known.items() if i != q))[:20]
        assert len(got[q]) == 20 and all(abs(s - float((known[q] * known[i]).sum())) < 1e-12 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in got[q]} & {i for _, i in want})
    assert set(got) == {i for i in known if i % 20 == 0} and hits >= 0.9 * 20 * len(got)
    few = neighbours.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")).collect()
    assert [r.vec_id for r in few] and {r.vec_id for r in few} == {1, 2, 3}
    assert neighbours.nearest(spark.createDataFrame(rows[:0], "vec_id long, embedding array<double>")).count() == 0


def test_hot_copies_and_chains(spark):
    """A third of all rows are copies, a third near copies of each other that only hang together in a chain."""
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join(f"c{j}" for j in range(i, i + 60)) for i in range(60)]
    texts = [" ".join(base)] * 60 + chain + [f"other {i} " + " ".join(f"o{i}x{j}" for j in range(20)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in minhash.near_duplicates(docs, cell=16).collect()}
    assert {got[i] for i in range(60)} == {0} and {got[i] for i in range(60, 120)} == {60} and all(got[i] == i for i in range(120, 180))
    assert components(spark.createDataFrame([(1, 2), (3, 2), (5, 5), (9, 8), (8, None)], "u long, v long")).where("component = 1").count() == 3


def test_passages(spark):
    rng = np.random.default_rng(2)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10 ** 9, n)]
    shared, fuzzy = prose(70), prose(120)
    changed = list(fuzzy)
    changed[40] = "other"
    del changed[80]
    texts = [prose(100) + shared + prose(50), prose(30) + shared + prose(30), shared, prose(10) + fuzzy, changed + prose(20), prose(300), prose(20) + shared[:30] + prose(20)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.shared_passages(docs).collect()}
    assert set(got) == {1, 2, 4} and (got[1].start_word, got[1].end_word, got[1].first_doc_id, got[1].first_start_word) == (30, 100, 0, 100)
    assert (got[2].start_word, got[2].end_word) == (0, 70) and (got[4].start_word, got[4].end_word, got[4].first_doc_id) == (0, 119, 3)
    left = {r.doc_id: r.text for r in passages.drop_repeats(docs).collect()}
    assert set(left) == {0, 1, 3, 4, 5, 6} and left[1] == " ".join(texts[1][:30] + texts[1][100:]) and left[5] == " ".join(texts[5])


def test_passages_apart_are_not_bridged(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10 ** 9, n)]
    one, two, long, tail = prose(60), prose(60), prose(200), prose(200)
    texts = [prose(20) + one + prose(100) + two + prose(20), prose(30) + one + prose(100) + two + prose(30), prose(10) + one + prose(40) + two,
             prose(40) + one + two, prose(15) + long + prose(700) + tail, prose(25) + long + prose(600) + tail + prose(9)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in passages.shared_passages(docs).collect())
    assert got == [(1, 30, 90), (1, 190, 250), (2, 10, 70), (2, 110, 170), (3, 40, 160), (5, 25, 225), (5, 825, 1025)]
    # two parts too short by themselves are one passage at 80 % of equal words, and a bad part takes nothing from a good one
    plan = passages.Chaining()
    assert passages.stretches([(0, 0, 40), (60, 60, 40)], plan) == [(0, 100, 0, 100, 0.8)]
    assert passages.stretches([(0, 0, 60), (80, 60, 4), (104, 84, 4)], plan) == [(0, 60, 0, 60, 1.0), (80, 84, 60, 64, 1.0), (104, 108, 84, 88, 1.0)]


def test_passages_of_one_line_said_again(spark):
    rng = np.random.default_rng(4)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10 ** 9, n)]
    line, same = prose(12), prose(1)
    texts = [prose(40) + line * 30 + prose(40), prose(30) + (line * 31)[5:365] + prose(20), prose(50) + same * 300 + prose(7), prose(5) + same * 200 + prose(8)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in passages.shared_passages(docs).collect())
    assert got == [(1, 30, 390, 0), (3, 5, 205, 2)]


@pytest.mark.parametrize("step, size", [(1, 7), (2, 7), (4, 7), (1, 20), (2, 30), (4, 40)])
def test_passages_whose_pieces_stand_in_earlier_documents(spark, step, size):
    rng = np.random.default_rng(9)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10 ** 9, n)]
    shared = prose(120)
    pieces = [shared[i:i + size] + prose(9) for i in range(0, 120 - size + 1, step)]
    rng.shuffle(pieces)
    texts = [sum(pieces, []), prose(30) + shared + prose(30), prose(12) + shared + prose(40), sum(pieces[::-1], []), prose(5) + shared]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.start_word, r.end_word) for r in passages.shared_passages(docs).collect() if r.doc_id in (2, 4)}
    assert got == {2: (12, 132), 4: (5, 125)}


def test_passages_of_changed_words(spark):
    rng = np.random.default_rng(6)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10 ** 9, n)]
    every = lambda words, n: [prose(1)[0] if i % n == n - 1 else w for i, w in enumerate(words)]
    eighth, fifth, ends = prose(1000), prose(300), prose(100)
    added = ends[:8] + prose(1) + ends[8:92] + prose(1) + ends[92:]
    texts = [prose(9) + eighth + prose(30), prose(20) + fifth + prose(20), prose(30) + ends + prose(30),
             prose(12) + every(eighth, 8) + prose(5), prose(40) + every(fifth, 5) + prose(4), prose(25) + added + prose(25)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in passages.shared_passages(docs).collect())
    assert got == [(3, 12, 1011), (4, 40, 339), (5, 25, 127)]
    assert passages.extension(ends[:30], ends[:6] + ["x"] + ends[6:30]) == [(0, 0, 6), (6, 7, 24)] and passages.extension(ends, prose(90)) == []


@pytest.mark.parametrize("few, lines", [(64, 0), (64, 30), (1, 0), (4, 30)])
def test_passages_whose_seeds_all_stand_first_elsewhere(spark, few, lines):
    rng = np.random.default_rng(12)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10 ** 9, n)]
    # runs of seven words, each in earlier documents of its own (or in many, as a common line), are one passage of two later documents with other words between
    runs = [prose(7) for _ in range(9)]
    spread = lambda n: sum((run + prose(n) for run in runs), [])
    pieces = [prose(20) + run + prose(20 + i) for i in range(1 + lines) for run in runs]
    texts = [*pieces, prose(25) + spread(1) + prose(30), prose(40) + spread(1) + prose(10), prose(30) + spread(30), prose(9)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [(r.doc_id, r.start_word, r.end_word, r.first_doc_id, r.first_start_word) for r in passages.shared_passages(docs, passages.Chaining(few=few)).collect()]
    assert got == [(len(pieces) + 1, 40, 111, len(pieces), 25)]
    left = {r.doc_id: r.text for r in passages.drop_repeats(docs, passages.Chaining(few=few)).collect()}
    assert len(left) == len(texts) and [i for i, t in enumerate(texts) if left[i] != " ".join(t)] == [len(pieces) + 1]


def test_passages_with_a_seed_of_two_documents_and_one_of_three(spark):
    rng = np.random.default_rng(13)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10 ** 9, n)]
    # the first run stands in two documents only, the others first in documents without the rest
    tail = prose(52)
    cuts = [tail[i:i + 7] for i in range(0, 52, 8)]
    texts = [*[prose(20) + c + prose(20) for c in cuts[1:]], prose(9) + tail + prose(9), prose(30) + sum((c + prose(1) for c in cuts), []) + prose(9)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [(r.doc_id, r.start_word, r.first_doc_id) for r in passages.shared_passages(docs).collect()] == [(len(texts) - 1, 30, len(texts) - 2)]


def test_passages_between_other_places_of_their_seeds(spark):
    rng = np.random.default_rng(14)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10 ** 9, n)]
    runs = [prose(7) for _ in range(9)]
    alone = sum((run + prose(60) for run in runs), [])
    texts = [alone + sum((run + prose(1) for run in runs), []) + prose(60) + alone, prose(30) + sum((run + prose(1) for run in runs), []) + prose(9)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [(r.doc_id, r.start_word, r.end_word, r.first_start_word) for r in passages.shared_passages(docs).collect()]
    assert got == [(1, 30, 101, len(alone))]


def test_passages_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10 ** 9, n)]
    one, two, short = prose(70), prose(60), prose(20)
    least, greatest = ["a", *prose(9), *two], ["z", *prose(199), *one, *prose(5)]
    rows = [(0, prose(10) + one + prose(10) + two), (1, least), (1, greatest), (1, greatest), (1, ["b", *short]), (2, two), (3, prose(30))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows] + [(1, None)], "doc_id long, text string")
    got = [(r.doc_id, r.start_word, r.end_word, r.n_pieces) for r in passages.shared_passages(docs).orderBy("doc_id").collect()]
    assert got == [(1, 200, 270, 1), (2, 0, 60, 1)]
    left = Counter((r.doc_id, r.text) for r in passages.drop_repeats(docs).collect())
    kept = " ".join(greatest[:200] + greatest[270:])
    assert left == Counter([(0, " ".join(rows[0][1])), (1, " ".join(least)), (1, kept), (1, kept), (1, " ".join(rows[4][1])), (3, " ".join(rows[6][1])), (1, None)])


def test_fenwick_chains_against_all_orders():
    rng = np.random.default_rng(5)
    plan = passages.Chaining(k=3, skipped=0.2)
    for _ in range(200):
        b, a = np.sort(rng.integers(0, 30, 9)), rng.integers(0, 30, 9)
        best = [3.0] * 9
        for i in range(9):
            for j in range(i):
                if b[j] < b[i] and a[j] < a[i]:
                    best[i] = max(best[i], best[j] + 3 - 0.2 * float(b[i] - b[j] + a[i] - a[j]))
        chain = passages.chains_of(b, a, plan)[0]
        score = 3 * len(chain) - 0.2 * sum(float(b[y] - b[x] + a[y] - a[x]) for x, y in itertools.pairwise(chain))
        assert abs(score - max(best)) < 1e-9


def test_shards_of_hot_keys(spark):
    rows = [(i, "same" * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() < 1.05 * sums.mean() and sums.min() > 0.95 * sums.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    again = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).toPandas()
    assert got.sort_values("doc_id")[["shard", "slot"]].values.tolist() == again.sort_values("doc_id")[["shard", "slot"]].values.tolist()


def plain_shards(rows, got):
    """Every column of the shards held against the rows: sizes, checksums, the law, gapless slots, equal texts together."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == want
    slots, sums, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(0 <= s < 16 for s in slots) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    weight = Counter()
    for i, t in rows:
        weight[zlib.crc32((t or "").encode()), len((t or "").encode()) + 1] += len((t or "").encode()) + 1
    mean = sum(sums.values()) / 16
    assert all(len(h) == 1 for k, h in homes.items() if weight[k] <= mean / 128 and k[1] <= mean / 128)
    return [sums[s] / mean for s in range(16)]


def test_shards_of_repeated_rows(spark):
    rows = [(1, "x" * 60)] * 3000 + [(i, f"text {i} " * (1 + i % 40)) for i in range(10, 3008)]
    filled = plain_shards(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert min(filled) > 0.99 and max(filled) < 1.01
    few = [(None, None), (None, None), (2, ""), (3, "é" * 9), (3, "é" * 9)]
    plain_shards(few, sharding.shard_documents(spark.createDataFrame(few, "doc_id long, text string")).collect())
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_of_large_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    filled = plain_shards([tuple(r) for r in docs.collect()], sharding.shard_documents(docs.withColumn("shard", F.lit("clash")).withColumn("__at", F.lit(1)).withColumn("a.b", F.lit(1))).collect())
    assert min(filled) > 0.99 and max(filled) < 1.01
    assert sharding.rooms([5, 0, 0], 9) == [0.0, 2.0, 4.0] and sharding.dealt_first([("a", 9), ("b", 7), ("b", 8)], 10.0, 2) == ([0, 0, 1], [16, 8])


def test_urls(spark):
    urls = ["HTTP://User@WWW.Ex.org:80/a/b?q#f", "//x.y.z", "no host", None, "https://h/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(url_lists.url_keys(F.col("url"))).collect()]
    assert got == [["www.ex.org/a", "www.ex.org", "ex.org"], ["x.y.z", "y.z"], [], [], ["h"]]
    captures = spark.createDataFrame([(1, "http://a.b.c/d", "2024-01-05"), (2, "http://a.b.c/d", "2024-02-01"), (3, None, "2024-01-05"), (4, "http://a.b.c", None)], "id long, url string, fetched_on string").withColumn("fetched_on", F.col("fetched_on").cast("date"))
    entries = spark.createDataFrame([("b.c", "spam", "2024-01-01", "add"), ("b.c", "spam", "2024-01-10", "remove"), ("a.b.c/d", "allow", "2024-02-01", "add"), ("b.c", "adult", "2024-02-01", "add"), (None, "x", "2024-01-01", "add"), ("b.c", None, "2023-01-01", "odd")],
                                    "key string, category string, day string, action string").withColumn("day", F.col("day").cast("date"))
    got = {r.id: (r.n_active, r.entry, r.blocked) for r in url_lists.active_entries(captures, entries).collect()}
    assert got == {1: (1, "b.c", True), 2: (2, "a.b.c/d", False), 3: (0, None, False), 4: (0, None, False)}


def test_words_at_once():
    text = "Ab  ab\tAB \x1c\x85é É\n" + "x" * 300 + " y"
    own = text.encode().lower().split()
    got = words.word_hashes(text)
    assert len(got) == len(own) and [got.tolist().index(h) for h in got] == [own.index(w) for w in own] and len(words.word_hashes(None)) == 0


@pytest.mark.parametrize("name", ["op2_temporal_url_lists", "op3_mix_sources", "op4_minhash", "op10_line_rules"])
def test_sql(spark, name):
    from compare import compare, engine

    from scoreloom.llm import queries
    assert compare(spark, engine(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)[0] == "same"
