"""Typed patterns in texts: dates, times, amounts, phones, URLs, nutrition and allergy codes."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from inkgauge.functions import fixed
from inkgauge.functions.text import SPACE, clamp, count, let, strip, unique


def found(c: Column, *patterns: str) -> Column:
    """All matches, those of the first pattern first; cleaned and distinct."""
    every = [F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in patterns]
    return unique(F.concat(*every) if len(every) > 1 else every[0])


def formatted_phone(value: Column) -> Column:
    plain = F.regexp_replace(strip(value), SPACE + "+", "")

    def shaped(d: Column) -> Column:
        cut = lambda a, b: F.concat_ws("-", F.substring(d, 1, a), F.substring(d, a + 1, b), F.substring(d, a + b + 1, 4))
        ten = F.when(d.startswith("02"), cut(2, 4)).otherwise(cut(3, 3))
        return F.when(F.length(d) == 10, ten).when(F.length(d) == 11, cut(3, 4)).otherwise(plain)

    return let(F.regexp_replace(value, r"(?U)\D", ""), shaped)


def phones(c: Column) -> Column:
    every = F.transform(F.regexp_extract_all(c, F.lit(fixed.GATE_PHONE), F.lit(0)), formatted_phone)
    return F.array_distinct(F.filter(every, lambda v: v != ""))


def dominant_month(values: Column) -> Column:
    """Only the most frequent month's dates where it has three at least; the first seen month wins a tie."""
    month = lambda v: F.regexp_extract(v, r"(?U)^\s*(\d{1,2})\s*/", 1)
    def kept(v: Column) -> Column:
        ranked = let(
            F.filter(F.transform(v, month), lambda m: m != ""),
            lambda ms: F.array_sort(F.transform(F.array_distinct(ms), lambda m, i: F.struct((-F.size(F.filter(ms, lambda x: x == m))).alias("n"), i.alias("i"), m.alias("m")))),
        )
        return let(F.get(ranked, F.lit(0)), lambda top: F.when(F.coalesce(-top["n"], F.lit(0)) < 3, v).otherwise(F.filter(v, lambda x: month(x) == top["m"])))

    return let(values, kept)


def masked(c: Column) -> Column:
    """The text with every nutrition and allergy value blanked out, so that they can't be read as dates."""
    values = F.concat(found(c, fixed.NUTRITION), found(c, fixed.ALLERGY))
    return F.aggregate(values, c, lambda t, v: F.replace(t, v, F.lit(" ")))


def gate_patterns(c: Column) -> Column:
    """Struct of eight arrays."""
    rest = masked(c)
    meals = dominant_month(found(rest, fixed.MEAL_DATE))
    return F.struct(
        unique(F.concat(meals, found(rest, fixed.DOTTED_DATE, fixed.HANGUL_DATE))).alias("dates"),
        found(c, fixed.GATE_TIME).alias("times"),
        found(c, fixed.AMOUNT).alias("amounts"),
        phones(c).alias("phones"),
        found(c, fixed.URL, fixed.SHORT_URL).alias("urls"),
        meals.alias("meal_dates"),
        found(c, fixed.NUTRITION).alias("nutrition_numbers"),
        found(c, fixed.ALLERGY).alias("allergy_numbers"),
    )


def table_patterns(c: Column) -> Column:
    """Struct of five arrays, by the looser rules for table text."""
    return F.struct(
        found(c, fixed.URL, fixed.SHORT_URL).alias("urls"),
        found(c, fixed.TABLE_PHONE).alias("phones"),
        found(c, fixed.TABLE_DATE, fixed.TABLE_SHORT_DATE).alias("dates"),
        found(c, fixed.TABLE_TIME).alias("times"),
        found(c, fixed.AMOUNT).alias("amounts"),
    )


def pattern_counts(p: str, keys: tuple[str, ...]) -> Column:
    return F.struct(*[F.size(f"{p}.{k}").alias(k) for k in keys])


def any_pattern(p: Column) -> Column:
    out = F.lit(False)
    for k in fixed.TABLE_KEYS:
        out = out | (F.coalesce(F.size(p[k]), F.lit(0)) > 0)
    return out


def doc_type(c: Column) -> Column:
    return F.when(c.rlike(fixed.MEAL_NOTICE), "meal_notice").otherwise("general_notice")


def menu_words(c: Column) -> Column:
    return sum((count(c, w) for w in fixed.MENU_WORDS[1:]), count(c, fixed.MENU_WORDS[0]))


def notice_words(c: Column) -> Column:
    return sum((c.contains(w).cast("int") for w in fixed.NOTICE_WORDS[1:]), c.contains(fixed.NOTICE_WORDS[0]).cast("int"))


def url_key(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(v)), "^https?://", ""), r"[.,;:)\]}]+$", "")


def suspicious_urls(c: Column, urls: Column) -> Column:
    """Candidates that hint at a URL and aren't among the valid ones."""
    every = F.regexp_extract_all(c, F.lit(fixed.URL_CANDIDATE), F.lit(0))
    return unique(let(F.transform(urls, url_key), lambda valid: F.filter(every, lambda v: v.rlike(fixed.URL_HINT) & ~F.array_contains(valid, url_key(v)))))


def suspicious_phones(c: Column, valid: Column) -> Column:
    key = lambda v: F.regexp_replace(v, r"(?U)\D", "")
    every = F.regexp_extract_all(c, F.lit(fixed.PHONE_CANDIDATE), F.lit(0))
    return unique(let(F.transform(valid, key), lambda known: F.filter(every, lambda v: ~F.array_contains(known, key(v)))))


def upto(n: Column, most: int) -> Column:
    return F.least(n / most, F.lit(1.0))


def pattern_score(p: Column, kind: Column, c: Column) -> Column:
    """Score of the gate's patterns by document type, unrounded."""
    n = lambda k: F.size(p[k])
    meal = upto(n("meal_dates"), 8) * 0.32 + upto(menu_words(c), 20) * 0.24 + upto(n("nutrition_numbers"), 10) * 0.16 + upto(n("allergy_numbers"), 12) * 0.10
    meal = meal + upto(n("amounts") + n("phones") + n("urls"), 3) * 0.18
    general = upto(core_count(p), 5) * 0.72 + upto(notice_words(c), 5) * 0.28
    return clamp(F.when(kind == "meal_notice", meal).otherwise(general))


def core_count(p: Column) -> Column:
    return F.size(p["dates"]) + F.size(p["times"]) + F.size(p["phones"]) + F.size(p["urls"]) + F.size(p["amounts"])


def pattern_warnings(p: Column, kind: Column, bad_urls: Column, bad_phones: Column) -> Column:
    meal = kind == "meal_notice"
    confused = (F.size(p["nutrition_numbers"]) >= 3) & F.exists(p["dates"], lambda d: d.rlike(r"\d+\.\d+"))
    return F.array_compact(F.array(
        F.when(meal & (F.size(p["meal_dates"]) == 0), fixed.NO_MEAL_DATE),
        F.when(meal & confused, fixed.CONFUSED_DATES),
        F.when(~meal & (core_count(p) == 0), fixed.NO_CORE),
        F.when(F.size(bad_urls) > 0, fixed.BROKEN_URLS),
        F.when(F.size(bad_phones) > 0, fixed.BROKEN_PHONES),
    ))


def table_text_score(p: Column, c: Column) -> Column:
    """Points for patterns and length of table text, less for mostly special characters."""
    n = lambda k: F.size(p[k])
    solid, special = F.length(F.regexp_replace(c, SPACE + "+", "")), count(F.regexp_replace(c, SPACE + "+", ""), r"[^가-힣A-Za-z0-9]")
    size = count(c, fixed.MEANINGFUL)
    length = F.when(size >= 120, 3.0).when(size >= 50, 2.0).when(size >= 15, 1.0).otherwise(-3.0)
    share = F.when(solid > 0, special / F.greatest(solid, F.lit(1))).otherwise(1.0)
    return (n("urls") + n("phones")) * 5.0 + (n("dates") + n("times") + n("amounts")) * 3.0 + length + F.when(share > 0.55, -2.0).otherwise(0.0)


def rotation_score(c: Column) -> Column:
    """How much a text looks like an upright page's."""
    return (
        count(c, fixed.HANGUL) * 2.0 + count(c, r"[가-힣]{2,}") * 3.0 + count(c, r"(?U)\d") * 0.8 + count(c, r"(?U)\d{4}\s*[.\-/]\s*\d{1,2}") * 8.0
        + count(c, r"(?U)\d{2,4}[-\s]\d{3,4}[-\s]\d{4}") * 8.0 + count(c, r"(?i)https?://|www\.|bit\.ly") * 12.0 - count(c, r"\?") * 0.5
    )
