"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text goes with them.

Everything is an expression on the arrays of one row: no shuffle, no Python.  Costly columns pass through ``fence``, so each is
computed once and read by the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.values import fence
from scoreloom.llm.common import SPACES, WORD, n_words_of, quoted, words_of

SYMBOLS = r"[#*$%&|<>]"
SYMBOL_CHARACTERS = "#*$%&|<>"
BOILERPLATE = (r"(?i)(accept (all )?cookies|cookie (policy|settings)|privacy policy|terms of (use|service)|all rights reserved|"
               r"enable javascript|sign up|log in|subscribe now|click here|skip to (main )?content|lorem ipsum)")


def line_verdict(line: Column, symbol_words: float = 0.2, separator_words: float = 0.1, shouted_words: float = 0.3,
                 fragment: int = 4) -> Column:
    """The first rule that a line breaks, or null.

    ``symbols``: too many words carry a symbol.  ``navigation``: too many words are separators.  ``shouting``: too many words end in
    more than one exclamation or question mark.  ``boilerplate``: at most 30 words with a stock phrase.  ``fragment``: fewer than
    ``fragment`` words without a mark at the end.  Null and blank lines break none.
    """
    n = F.regexp_count(line, F.lit(WORD))
    share = lambda pattern: F.regexp_count(line, F.lit(pattern)) / n
    end = r"[.!?…。！？:;,\"'”’»)\]][\x20\x09-\x0D]*$"
    return (F.when(n < 1, F.lit(None).cast("string"))
            .when(share(r"(?<![^\x20\x09-\x0D])(\||>|»|•|·)(?![^\x20\x09-\x0D])") >= separator_words, "navigation")
            .when(share(r"[^\x20\x09-\x0D]*[#*$%&|<>][^\x20\x09-\x0D]*") >= symbol_words, "symbols")
            .when(share(r"[!?]{2,}(?![^\x20\x09-\x0D])") >= shouted_words, "shouting")
            .when((n <= 30) & line.rlike(BOILERPLATE), "boilerplate")
            .when((n < fragment) & ~line.rlike(end), "fragment"))


def clean_lines(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """Adds ``lines`` (array of line, words, verdict), ``n_words``, ``removed_words`` and ``clean_text`` (lines that broke no rule).

    A null text has no lines, no words and a null clean text.  Columns of these names are replaced.
    """
    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.struct(
        x.alias("line"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words"), line_verdict(x, **limits).alias("verdict")))
    cut = fence(docs.withColumn("lines", F.coalesce(lines, F.array().cast("array<struct<line:string,words:bigint,verdict:string>>"))), ["lines"])
    total = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    bad = F.filter("lines", lambda x: x["verdict"].isNotNull())
    good = F.transform(F.filter("lines", lambda x: x["verdict"].isNull()), lambda x: x["line"])
    return fence(cut.withColumns({"n_words": total(F.col("lines")), "removed_words": total(bad),
                                  "clean_text": F.when(F.col(text).isNotNull(), F.array_join(good, "\n"))}),
                 ["n_words", "removed_words", "clean_text"])


def repeat_words(docs: DataFrame, text: str = "text", window: int = 3, name: str = "n_repeat_words") -> DataFrame:
    """Adds how many words stand in windows of ``window`` words that the text holds twice or more, the first time included.

    Windows are compared by a 64-bit hash.  Texts with fewer words than a window, and null texts, have none.
    """
    kept = [c for c in docs.columns if c != name]
    spread = fence(docs.select(*kept, words_of(F.col(text)).alias("__words")), ["__words"])
    many = F.size("__words") - (window - 1)
    hashes = F.transform(F.slice("__words", 1, F.greatest(many, F.lit(0))),
                         lambda w, i: F.xxhash64(w, *[F.get("__words", i + k) for k in range(1, window)]))
    hashed = fence(spread.withColumn("__hashes", hashes).drop("__words"), ["__hashes"])
    placed = F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"),
                    F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ranked = fence(hashed.withColumn("__placed", placed).drop("__hashes"), ["__placed"])
    again = F.filter("__placed", lambda p, j: (F.coalesce(F.get("__placed", j - 1)["h"] == p["h"], F.lit(False)))
                     | F.coalesce(F.get("__placed", j + 1)["h"] == p["h"], F.lit(False)))
    starts = fence(ranked.withColumn("__starts", F.sort_array(F.transform(again, lambda p: p["i"]))).drop("__placed"), ["__starts"])
    fresh = F.transform("__starts", lambda p, j: F.least(F.lit(window), p - F.coalesce(F.get("__starts", j - 1), F.lit(-window))))
    return starts.withColumn(name, F.coalesce(F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")).drop("__starts")


def judge_lines(docs: DataFrame, text: str = "text", least_words: int = 50, repeated: int = 50, lost: float = 0.3, **limits) -> DataFrame:
    """The documents' columns, counts of each text, ``base_failed``, ``removed_words``, ``clean_text`` and ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``repeated`` percent of them in repeated three-word windows.
    ``kept``: not failed, and the removed lines hold at most ``lost`` of the words.  Null and empty texts fail.  Every row gives one
    row; equal rows give equal rows; other columns pass, but for those of the names added here.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "clean_text", "kept")
    passing = [c for c in docs.columns if c not in added]
    # whatever the other columns are called, they travel as one
    asked = docs.select(F.struct(*[F.col(quoted(c)) for c in passing] or [F.lit(0)]).alias("__row"), F.col(quoted(text)).alias("__text"))
    cleaned = clean_lines(repeat_words(asked, "__text"), "__text", **limits)
    t = F.coalesce(F.col("__text"), F.lit(""))
    worded = F.transform(F.filter("lines", lambda x: x["words"] > 0), lambda x: x["line"])
    counted = cleaned.withColumns({
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOL_CHARACTERS, ""))).cast("long"),
        "n_dup_lines": (F.size(worded) - F.size(F.array_distinct(worded))).cast("long"),
    })
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeated * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= lost * F.col("n_words")))
    return judged.select(*[F.col("__row")[c].alias(c) for c in passing], *added)


__all__ = ["BOILERPLATE", "SYMBOLS", "clean_lines", "judge_lines", "line_verdict", "n_words_of", "repeat_words"]
