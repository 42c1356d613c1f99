"""Cleaning and counting of texts, as Column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column

from inkgauge.functions import fixed

#: White space and line ends as in Unicode text handling, with the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a lambda would compute it again for every element it is used for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def compact(c: Column) -> Column:
    return F.regexp_replace(c, SPACE + "+", "")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def lines(c: Column) -> Column:
    """Lines without their ends; a last line end makes no further line."""
    return let(F.split(c, LINE_END), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x))


def full_lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def normalized(c: Column) -> Column:
    """BOM, line ends, blanks, broken spacing and runs of blank lines put right, in this order."""
    steps = [("﻿", ""), ("\r\n?", "\n"), ("[ \t]+", " "), (" *\n *", "\n"), *fixed.SPACING_REPAIRS, ("\n{3,}", "\n\n")]
    return strip(reduce(lambda x, s: F.regexp_replace(x, *s), steps, c))


def line_key(line: Column) -> Column:
    """Lines count as equal without white space; one-character lines only when equal as they are."""
    return let(compact(line), lambda k: F.when(F.length(k) >= 2, k).otherwise(line))


def deduplicated(c: Column) -> Column:
    """Array of lines: first occurrences, runs of blanks as one, none at the ends.

    First occurrences come from sorting (key, position) pairs, so a text costs n log n and no shuffle.
    """
    place = lambda x, i: F.struct(line_key(x).alias("k"), i.alias("i"), x.alias("x"))
    placed = F.array_sort(F.transform(F.transform(lines(c), strip), place))
    first = let(placed, lambda p: F.filter(p, lambda s, i: (s["x"] == "") | (i == 0) | ~F.get(p, i - 1)["k"].eqNullSafe(s["k"])))
    back = F.transform(F.array_sort(F.transform(first, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])
    tight = let(back, lambda b: F.filter(b, lambda x, i: (x != "") | ((i > 0) & (F.get(b, i - 1) != ""))))
    return let(tight, lambda t: F.when((F.size(t) > 0) & (F.get(t, F.size(t) - 1) == ""), F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t))


def clean(c: Column) -> Column:
    """Normalised and deduplicated text: what the gate scores."""
    return strip(F.array_join(deduplicated(normalized(c)), "\n"))


def is_noise(line: Column, least: float) -> Column:
    """Long lines with few letters and digits; blank lines too when least is the cleaning rule's."""
    bare = strip(line)
    return (F.length(bare) >= 8) & (count(bare, fixed.MEANINGFUL) / F.greatest(F.length(bare), F.lit(1)) < least)


def unique(values: Column) -> Column:
    """White space collapsed, empty ones dropped, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.regexp_replace(strip(v), SPACE + "+", " ")), lambda v: v != ""))


def ratio(n: Column, d: Column) -> Column:
    return n / F.greatest(d, F.lit(1))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def profile(c: Column) -> list[Column]:
    """Character-class counts of a text."""
    found = {"meaningful": fixed.MEANINGFUL, "hangul": fixed.HANGUL, "ascii_word": fixed.ASCII_WORD, "garbage": fixed.GARBAGE, "spaced_runs": fixed.SPACED_RUN}
    return [F.length(c).alias("total"), *[count(c, p).alias(n) for n, p in found.items()]]


def line_counts(c: Column) -> list[Column]:
    """Lines, repeated lines, short lines and noise lines of a text."""
    full = full_lines(c)
    short = lambda keys: F.size(F.filter(keys, lambda k: F.length(k) <= 3))
    counts = let(
        full,
        lambda f: let(
            F.transform(f, compact),
            lambda k: F.array(F.size(f), F.size(k) - F.size(F.array_distinct(k)), short(k), F.size(F.filter(f, lambda x: is_noise(x, 0.35)))),
        ),
    )
    return [F.get(counts, F.lit(i)).alias(name) for i, name in enumerate(("n_lines", "n_duplicate", "n_short", "n_noise"))]


def text_score(c: Column) -> Column:
    """Score from 0 to 1 of the profile and line counts (columns of those names), unrounded."""
    total, n = F.col("total"), F.col("n_lines")
    penalty = (
        ratio(F.col("garbage"), total) * 1.7
        + ratio(F.col("n_short"), n) * 0.18
        + ratio(F.col("n_duplicate"), n) * 0.25
        + ratio(F.col("spaced_runs"), total) * 0.45
        + ratio(F.col("n_noise"), n) * 0.35
    )
    score = clamp(ratio(F.col("meaningful"), total) * 1.05 - penalty)
    return F.when(F.length(strip(c)) < 120, F.least(score, F.lit(0.45))).otherwise(score)


def text_warnings(c: Column) -> Column:
    total, n = F.col("total"), F.col("n_lines")
    return F.array_compact(F.array(
        F.when(F.length(strip(c)) < 120, fixed.TOO_SHORT),
        F.when(ratio(F.col("garbage"), total) > 0.10, fixed.MUCH_GARBAGE),
        F.when(ratio(F.col("n_short"), n) > 0.35, fixed.SHORT_LINES),
        F.when(ratio(F.col("spaced_runs"), total) > 0.12, fixed.MUCH_SPACING),
    ))
