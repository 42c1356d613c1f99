"""Edit distances and overlaps between a truth and a hypothesis."""

from __future__ import annotations

import unicodedata

import pyspark.sql.functions as F
from pyspark.sql import Column
from pyspark.sql.types import StringType

from inkgauge.functions import fixed
from inkgauge.functions.text import SPACE, full_lines, let, normalized, strip

NO_BLANKS = "[ \n]"


@F.pandas_udf(StringType())
def _nfc(texts):
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def composed(c: Column) -> Column:
    """NFC; of ASCII texts, which it can't change, only nulls go to Python (a UDF runs for all rows, whatever the branch)."""
    ascii_ = c.rlike(r"^\p{ASCII}*$")
    return F.when(ascii_, c).otherwise(_nfc(F.when(~ascii_, c)))


def eval_normalized(c: Column, nfc: bool = True) -> Column:
    """NFC, blanks as one, line ends as one, stripped."""
    c = composed(c) if nfc else c
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n+", "\n"))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, NO_BLANKS, "")


def coded(a: Column, b: Column) -> list[Column]:
    """Two token arrays as strings of one character a token, equal tokens by equal characters.

    Characters are numbered over both arrays from the private use area on and, beyond it, from
    the supplementary planes, so pairs may have over a million distinct tokens.
    """
    # UTF-16BE units: BMP private use first, surrogate pairs beyond.
    units = lambda k: F.when(k < 6000, F.hex((57344 + k).cast("long"))).otherwise(F.concat(F.hex((55296 + F.floor((k - 6000) / 1024)).cast("long")), F.hex((56320 + (k - 6000) % 1024).cast("long"))))
    names = lambda known: F.map_from_arrays(known, F.transform(known, lambda t, i: F.decode(F.unhex(units(i)), "UTF-16BE")))
    named = let(F.array_distinct(F.concat(a, b)), names)

    def spelled(x: Column) -> Column:
        return let(named, lambda m: F.array_join(F.transform(x, lambda t: F.element_at(m, t)), ""))

    return [spelled(a), spelled(b)]


def rate(distance: Column, size: Column, other: Column) -> Column:
    """distance / size; with nothing expected 0 if nothing came, else 1."""
    return F.when(size > 0, distance / F.greatest(size, F.lit(1))).otherwise((other > 0).cast("double"))


def cer(truth: Column, hyp: Column) -> Column:
    """Character error rate without blanks and line ends."""
    return let(squeezed(truth), lambda a: let(squeezed(hyp), lambda b: rate(F.levenshtein(a, b), F.length(a), F.length(b))))


def gate_cer(truth: Column, hyp: Column) -> Column:
    """Character error rate of normalised texts, blanks kept."""
    return let(normalized(truth), lambda a: F.levenshtein(normalized(hyp), a) / F.greatest(F.length(a), F.lit(1)))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, SPACE + "+"), lambda t: t != "")


def token_rate(truth: Column, hyp: Column) -> Column:
    def counted(a: Column, b: Column) -> Column:
        x, y = coded(a, b)
        return rate(F.levenshtein(x, y), F.size(a), F.size(b))

    return let(truth, lambda a: let(hyp, lambda b: counted(a, b)))


def wer(truth: Column, hyp: Column) -> Column:
    return token_rate(tokens(truth), tokens(hyp))


def jamo(c: Column) -> Column:
    """Hangul syllables as three decimal index strings, other characters as they are, blanks and line ends dropped."""
    chars = F.filter(F.split(squeezed(c), ""), lambda x: x != "")
    code = lambda x: F.ascii(x) - 44032
    parts = lambda x: F.array(*[p.cast("int").cast("string") for p in (F.floor(code(x) / 588), F.floor(code(x) / 28) % 21, code(x) % 28)])
    return F.flatten(F.transform(chars, lambda x: F.when(x.rlike("^[가-힣]$"), parts(x)).otherwise(F.array(x))))


def jamo_cer(truth: Column, hyp: Column) -> Column:
    return token_rate(jamo(truth), jamo(hyp))


def line_accuracy(truth: Column, hyp: Column) -> Column:
    """Equal lines at equal places of the non-blank lines, over the longer text's."""
    same = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False))))
    share = lambda a, b: let(F.greatest(F.size(a), F.size(b)), lambda most: F.when(most == 0, 1.0).otherwise(same(a, b) / F.greatest(most, F.lit(1))))
    return let(full_lines(truth), lambda a: let(full_lines(hyp), lambda b: share(a, b)))


def runs(x: Column) -> Column:
    """(v, n) of each distinct value of an array, by value: runs of the sorted array."""

    def of(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda e: (e["i"] == 0) | (F.get(s, e["i"] - 1) != e["v"]))
        return let(starts, lambda st: F.transform(st, lambda e, j: F.struct(e["v"].alias("v"), (F.coalesce(F.get(st, j + 1)["i"], F.size(s)) - e["i"]).alias("n"))))

    return let(F.array_sort(x), of)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection: both arrays' runs sorted together, equal neighbours paired."""
    paired = lambda z: F.transform(z, lambda e, j: F.when(F.get(z, j + 1)["v"] == e["v"], F.least(e["n"], F.get(z, j + 1)["n"])).otherwise(0))
    return let(F.array_sort(F.concat(runs(a), runs(b))), lambda z: F.aggregate(paired(z), F.lit(0), lambda total, e: total + F.coalesce(e, F.lit(0))))


def precision_recall(hit: Column, truth: Column, hyp: Column) -> list[Column]:
    p = hit / F.greatest(hyp, F.lit(1))
    r = hit / F.greatest(truth, F.lit(1))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.greatest(p + r, F.lit(1e-300))).alias("f1")]


def gate_tokens(c: Column) -> Column:
    return F.regexp_extract_all(normalized(c), F.lit(fixed.TOKEN), F.lit(0))


def characters(c: Column) -> Column:
    return F.filter(F.split(squeezed(c), ""), lambda x: x != "")
