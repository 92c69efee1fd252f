"""Wrapper induction, hard negatives and repaired conversations beside plain versions."""

import hashlib
import html
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import conversation_repair as repair
from scoreloom.llm import hard_negatives, wrappers
from scoreloom.llm.common import cut
from scoreloom.llm.page_trees import page_tree

SF = "/root/testdata/sf0.001"
CLASH = [("id", "clash"), ("part", "clash"), ("a.b", "clash"), ("score", "clash"), ("host", "clash")]


def with_clashes(df):
    for name, value in CLASH:
        df = df.withColumn(name, F.lit(value))
    return df


# conversations

def all_scripts(codes):
    """Least cost and audit by trying every script."""
    def ways(i, state):
        if i == len(codes):
            for inserts in range(4):
                at = state
                for _ in range(inserts):
                    at = repair.following(at)
                if at in (0, 3):
                    yield 2 * inserts, "I" * inserts
            return
        initial, fault = "suax"[codes[i] >> 2], codes[i] & 3
        at = state
        for inserts in range(4):
            rest = [("D", at, 3)]
            if fault in (0, 3):
                extra = int(fault == 3)
                rest.append(("R", repair.following(at), 2 + extra))
                if initial == "s" and at == 0:
                    rest.append(("K", 1, extra))
                if initial == "u" and at != 2:
                    rest.append(("K", 2, extra))
                if initial == "a" and at == 2:
                    rest.append(("K", 3, extra))
            for letter, to, cost in rest:
                for more, audit in ways(i + 1, to):
                    yield 2 * inserts + cost + more, "I" * inserts + letter + audit
            at = repair.following(at)
    return min(ways(0, 0))


def test_audits_against_all_scripts():
    rng = np.random.default_rng(13)
    for n in range(5):
        for _ in range(25):
            codes = bytes(rng.integers(0, 16, n).tolist())
            assert repair.whole_audit(codes) == all_scripts(codes), codes
    for codes in itertools.product((0, 4, 8, 12, 1, 7), repeat=3):
        assert repair.whole_audit(bytes(codes)) == all_scripts(bytes(codes))


def plain_repair(rows):
    """The contract's columns by a table of all least (cost, audit) pairs, row by row."""
    out = {}
    convs = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        convs[conv] += [(turn, "user" if act == 4 else role, text)] * (0 if act == 0 else 2 if act == 3 else 1)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
            seen.add((role, text))
        states = {0: (0, "", ())}
        for (_, role, text), fault in zip(own, faults):
            new = {}
            for state, (cost, audit, lines) in states.items():
                at, before = state, lines
                for inserts in range(4):
                    done = [("D", at, 3, before)]
                    if fault in (0, 3):
                        to = 3 if at == 2 else 2
                        done.append(("R", to, 2 + (fault == 3), (*before, ("user:" if to == 2 else "assistant:") + text)))
                        if role[:1] == "s" and at == 0:
                            done.append(("K", 1, int(fault == 3), (*before, f"{role}:{text}")))
                        if role[:1] == "ua"[to - 2]:
                            done.append(("K", to, int(fault == 3), (*before, f"{role}:{text}")))
                    for letter, to, more, written in done:
                        way = (cost + 2 * inserts + more, audit + "I" * inserts + letter, written)
                        new[to] = min(new.get(to, way), way)
                    at = 3 if at == 2 else 2
                    before = (*before, "user:" if at == 2 else "assistant:")
            states = new
        ends = []
        for state, (cost, audit, lines) in states.items():
            for inserts in range(3):
                if state in (0, 3):
                    ends.append((cost + 2 * inserts, audit + "I" * inserts, lines))
                state = 3 if state == 2 else 2
                lines = (*lines, "user:" if state == 2 else "assistant:")
        cost, audit, lines = min(ends)
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TALK = "conv_id long, turn int, role string, text string"


def talks():
    rng, roles = np.random.default_rng(7), ["user", "assistant", "system", "tool", None, "", "s", "Assistant"]
    texts = ["Yes.", "No", " \n", "", None, "Why?", "Ünder \x1c", "ok!  ", "Yes.", "long " * 50 + "."]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(int(rng.integers(1, 12))):
            rows.append((conv, None if rng.random() < 0.1 else int(rng.integers(0, 9)), roles[int(rng.choice(8, p=[.4, .3, .1, .05, .05, .03, .04, .03]))], texts[int(rng.integers(0, 10))]))
    hot = [(1000, t, roles[t % 2], f"turn {t % 200}." if t % 7 else "same") for t in range(900)] + [(1000, 5, "user", "again and again.")] * 300
    return rows + hot + rows[:20] + [(2000, None, None, None), (1 << 60, 1, "user", "big"), ((1 << 60) + 1, 1, "assistant", "big.")]


@pytest.mark.parametrize("plan", [repair.Plan(), repair.Plan(rows=4), repair.Plan(rows=50, chars=200)])
def test_repairs_against_plain(spark, plan):
    rows = talks()
    df = with_clashes(spark.createDataFrame(rows, TALK).repartition(5))
    got = {r[0]: tuple(r)[1:] for r in repair.repaired_conversations(df, plan).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    want = plain_repair(rows)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def test_repairs_of_nothing(spark):
    assert repair.repaired_conversations(spark.createDataFrame([], TALK)).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    one = repair.repaired_conversations(spark.createDataFrame([(5, dropped, "user", "x")], TALK)).collect()
    assert [tuple(r)[:8] for r in one] == [(5, 0, 0, 0, 0, 0, 0, "")] and one[0].repaired_sha256 == hashlib.sha256(b"").hexdigest()


# hard negatives

def plain_negatives(rows, anchor):
    fine = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own = (label, [int(np.floor(256 * x)) for x in v])
        fine[i] = min(fine.get(i, own), own)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in fine.items():
        if not anchor(a):
            continue
        others = [(-score(v, w), j, kind) for j, (kind, w) in fine.items() if j != a and len(w) == len(v)]
        for p, positive in sorted((s, j) for s, j, kind in others if kind == label)[:5]:
            low = sorted((s, j) for s, j, kind in others if kind != label and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(a, positive, rank + 1, j, -p, -s) for rank, (s, j) in enumerate(low)]
    return sorted(out)


ROWS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("plan", [hard_negatives.Plan(), hard_negatives.Plan(part=37, directions=3)])
def test_negatives_against_plain(spark, plan):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.3 * rng.normal(size=8)], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(i, rows[10][1], i % 3) for i in range(400, 520)]  # one very common vector
    rows += [(520, [0.0] * 8, 1), (530, [1.0] * 3, 1), (540, [2.0] * 3, 1), (531, [1.5] * 3, 2), (541, [], 1), (550, [], 1), (551, [], 0), (560, [1.0, None], 1), (570, [float("nan")] * 8, 1),
             (580, None, 1), (590, [1.0] * 8, None), (None, [1.0] * 8, 1), (600, [1e300] * 8, 1), (10, rows[10][1], 3), (20, rows[20][1], rows[20][2]), (610, [3e4] * 8, 1), (620, [2.9e4] * 8, 1), (621, [2.8e4] * 8, 2)]
    df = with_clashes(spark.createDataFrame(rows, ROWS))
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, plan).collect())
    want = plain_negatives([r for r in rows if r[0] != 600], lambda i: i % 10 == 0)
    assert got == want and len(want) > 300
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") % 10 == 0, plan).count() == 0
    assert hard_negatives.hard_negatives(df.where("label is null"), F.lit(True), plan).count() == 0


def test_bounds_hold_and_thin_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 300
    vectors = np.vstack([c + rng.normal(size=(50, 16)) * 40 for c in centres]).astype(np.int64)
    directions = hard_negatives.Directions(centres[:20])
    angles = directions.angles(vectors)
    import pandas as pd
    cell = hard_negatives.Cell(pd.DataFrame({"id": np.arange(1000), "label": 0, "v": [v.tobytes() for v in vectors], "angles": [a.tobytes() for a in angles.astype(np.float32)]}))
    seen = 0
    for at in range(0, 1000, 50):
        v, length = vectors[at], float(np.sqrt((vectors[at] ** 2).sum()))
        scores = vectors @ v
        top = int(np.sort(scores)[-6])
        places = cell.window(angles[at].astype(np.float32).astype(np.float64), length, 0.8 * top, top)
        assert set(np.flatnonzero((scores >= 0.8 * top) & (scores <= top))) <= set(places.tolist())
        seen += len(places)
    assert seen < 0.2 * 20 * 1000  # clustered rows: few are scored


# pages

def article(page):
    """Plain version for pages whose article is an element of that name."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    text = re.sub(r"</?(?:p|h1|br|div)\b[^>]*>", " ", body.group(1)) if body else ""
    return " ".join(html.unescape(re.sub(r"</?(?:b|i|a)\b[^>]*>", "", text)).split())


def test_whole_table_of_pages(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        pages = spark.read.parquet(f"{sf}/pages.parquet")
        want = Counter((r.page_id, article(r.html)) for r in pages.collect())
        got = wrappers.extract_main_text(pages).collect()
        assert Counter((r.page_id, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)


def words(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 10 ** 6, n)) + "."


def test_pages_without_names(spark):
    """Nothing but bare containers: what all pages of a host share is template, the container that varies is the article."""
    rng, rows, want = np.random.default_rng(3), [], {}
    for i in range(12):
        parts = [words(rng, 8), *[words(rng, 30) for _ in range(2 + i % 3)]]
        links = "".join(f"<li><a href=/{x}>{words(rng, 2)}</a>" for x in range(6))
        page = (f"<html><body><div><div>The daily news of our town</div><ul>{links}</ul></div><div><div><h1>{parts[0]}</h1>" + "".join(f"<p>{p}" for p in parts[1:])
                + "<p>Read all of this on paper, too.</p></div></div><div><p>All rights of this house are kept.<p>Made by hand.</div>")
        rows.append((i, f"http://plain.example.org/{i}", page))
        want[i] = " ".join(parts)
    rows += [(50 + i, "http://plain.example.org/copy", rows[0][2]) for i in range(40)]  # copies of one page make nothing a template
    got = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in want} == want and {got[50 + i] for i in range(40)} == {want[0]}


def test_parts_that_are_not_the_article(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site name</h1></header>
    <div id="cookie-notice">We bake %d.</div><div class="breadcrumbs"><a>Home</a></div><main><article class="post"><header><h1>Title %d</h1></header><p>One&nbsp;&amp; two<b>three</b>
    four %d.</p><div class="ad-slot">Buy %d!</div><ul><li>first %d<li>second %d</ul><table><tr><td>cell %d<td>next %d</table><aside>By the way %d</aside><form><p>Mail %d</p><input value=x></form>
    <script>var x = "<p>no</p>";</script><blockquote>Said %d</blockquote><!-- <p>hidden</p> --><p hidden>gone</p><span class="share-buttons">Share</span> tail &lt;%d&gt;</article>
    <section id="comments"><h2>Comments</h2><p>I read %d of it.</p></section></main><aside class="related"><p>More %d</p></aside><footer>(c) %d</footer></body></html>"""
    rows = [(i, f"https://a.example.com/{i}", page % ((i,) * 15)) for i in range(7)]
    rows += [(100, "https://single.example.com/", rows[3][2]), (101, None, rows[4][2]), (102, "no url", None), (103, "https://a.example.com/x", ""), (104, "https://a.example.com/y", "<nav>menu</nav>"),
             (105, None, "just text &eacute; < 5"), (105, None, "just text &eacute; < 5"), (None, "https://a.example.com/z", "<p>" + "long " * 200_000)]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in wrappers.extract_main_text(df).collect()}
    want = "Title {0} One & twothree four {0}. first {0} second {0} cell {0} next {0} Said {0} tail <{0}>"
    assert [got[i].text for i in range(7)] == [want.format(i) for i in range(7)] and got[100].text == want.format(3) and got[101].text == want.format(4)
    assert [got[i].text for i in (102, 103, 104, 105)] == ["", "", "", "just text é < 5"] and got[None].n_chars == 999_999
    assert wrappers.extract_main_text(df).count() == len(rows) and wrappers.extract_main_text(cut(df.limit(0))).count() == 0


def test_tree_matching_against_all_alignments():
    rng = np.random.default_rng(1)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(int(rng.integers(0, 4)))] if depth else []
        return wrappers.Slot("abc"[int(rng.integers(0, 3))], kids=kids)

    def best(a, b):
        if a.symbol != b.symbol:
            return 0
        rows, most = (a.kids, b.kids), 0
        for n in range(min(len(a.kids), len(b.kids)) + 1):
            for x in itertools.combinations(rows[0], n):
                for y in itertools.combinations(rows[1], n):
                    most = max(most, sum(best(i, j) for i, j in zip(x, y)))
        return 1 + most

    for _ in range(60):
        a, b = tree(3), tree(3)
        a.symbol = b.symbol
        assert wrappers.matching(a, b) == best(a, b)


def test_broken_markup():
    for source in ("<", "<p", "</", "<a href='", "<!--", "<script>", "<p><b>x<br><p>y</p>", "&#xZ;&amp", "<table><tr><td>a<tr><td>b</table>", "<![CDATA[x]]>", "<p>\x00</p></p></div>"):
        assert page_tree(source).tag == "html"
    assert [n.text for n in page_tree("<p><b>x<br><p>y</p>z<td>").walk() if n.text] == ["x", "y", "z"]


@pytest.mark.parametrize("name", ["op12_angular_negatives", "op13_hirschberg_repair"])
def test_sql_of_new_operators(spark, name):
    from compare import compare, engine

    from scoreloom.llm import queries
    for sf in (SF, "/root/testdata/sf0.01"):
        assert compare(spark, engine(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf)[0] == "same"
