"""Column functions on text: trimming, quoting, hashing, text blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.values import let

SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n+"


def strip(c: Column) -> Column:
    """Trim every kind of white space (``trim`` only removes spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def fold(c: Column) -> Column:
    """Case-insensitive form; German sharp s counts as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def words(c: Column) -> Column:
    """White-space separated words, none for blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def sentences(c: Column) -> Column:
    """Split after . ! ? followed by space, and at line breaks; trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")


# Typographic characters and what they are compared as.
QUOTE_CHARACTERS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"}


def quote_form(c: Column) -> Column:
    """Comparison form for quotes: straight marks, no emphasis, single spaces, folded case."""
    marks = "".join(QUOTE_CHARACTERS)
    plain = "".join(QUOTE_CHARACTERS.values())
    c = F.replace(F.translate(c, marks + "*_`", plain), F.lit("…"), F.lit("..."))
    return fold(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def quote_in_text(quote: Column, text: Column) -> Column:
    """Is the quote a passage of the text?  Parts around an elision '...' must occur in order."""
    parts = F.filter(F.transform(F.split(quote_form(quote), r"\.\.\."),
                                 lambda p: F.regexp_replace(p, "^[ \"'.]+|[ \"'.]+$", "")), lambda p: p != "")
    # the haystack rides along in the accumulator, so it is normalised once and not once per part
    start = F.struct(quote_form(text).alias("hay"), F.lit(1).alias("at"))

    def step(acc, part):
        found = F.when(acc["at"] > 0, F.position(part, acc["hay"], acc["at"])).otherwise(0)
        return F.struct(acc["hay"].alias("hay"), F.when(found > 0, found + F.length(part)).otherwise(0).alias("at"))

    return F.coalesce((F.size(parts) > 0) & (F.aggregate(parts, start, step)["at"] > 0), F.lit(False))


def kv_lines(entries: Column, sep: str = ": ") -> Column:
    """array<struct<label,value>> as 'label: value' lines, in order."""
    return F.array_join(F.transform(entries, lambda e: F.concat(e["label"], F.lit(sep), e["value"])), "\n")


def bullets(items: Column, marker: str = "- ") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(marker), x)), "\n")


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def json_block(value: Column, pretty: bool = True) -> Column:
    return F.to_json(value, {"pretty": str(pretty).lower()})


def normalize_prompt(c: Column) -> Column:
    """No outer white space, no trailing spaces on lines, at most one blank line in a row."""
    lines = F.regexp_replace(strip(c), r"\r\n|[\n\r\f\x0B\x1C\x1D\x1E\x85\u2028\u2029]", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"(?U)[^\S\n]+(?=\n|$)", ""), r"\n{3,}", "\n\n")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts, by bisection on equal prefixes (log n comparisons)."""
    def bisect(pair):
        span = F.struct(F.lit(0).alias("lo"), F.least(F.length(pair["a"]), F.length(pair["b"])).alias("hi"))

        def halve(acc, _):
            mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
            same = F.substring(pair["a"], F.lit(1), mid) == F.substring(pair["b"], F.lit(1), mid)
            return F.struct(F.when(same, mid).otherwise(acc["lo"]).alias("lo"),
                            F.when(same, acc["hi"]).otherwise(mid - 1).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(31)), span, halve)["lo"]

    return let(F.struct(a.alias("a"), b.alias("b")), bisect)
