"""Look-alike characters corrected, but only inside amounts, times, dates, weekdays, grades, classes and phones."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgauge.functions import fixed

CORRECTIONS = T.ArrayType(
    T.StructType([*(T.StructField(n, T.StringType()) for n in ("slot_type", "raw_text", "corrected_text", "reason")), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("review_required", T.BooleanType())])
)
_DIGITS = str.maketrans(fixed.LOOKALIKE_FROM, fixed.LOOKALIKE_TO)


def _digits(s: str) -> str:
    return s.translate(_DIGITS)


def _within(value: str, low: int, high: int) -> bool:
    return value.isdigit() and low <= int(value) <= high


def _amount(m):
    number = re.sub(r"\s+", "", _digits(m[1]).replace(".", ","))
    return (number + "원", False) if re.search(r"\d", number) else (None, False)


def _time(m):
    hour, minute = _digits(m[1]), _digits(m[2])
    return f"{hour}:{minute}", not (_within(hour, 0, 23) and _within(minute, 0, 59))


def _date(m):
    month, day = _digits(m[1]), _digits(m[3])
    return f"{month}월 {day}일", not (_within(month, 1, 12) and _within(day, 1, 31))


def _grade(m):
    return _digits(m[1]) + (f"-{_digits(m[2])}" if m[2] else "") + "학년", False


#: (slot, pattern, what is confused, match -> (corrected or None, review required)), in the order ties resolve.
SLOTS = (
    ("amount", re.compile(fixed.AMOUNT_SLOT), "digit/unit", _amount),
    ("time", re.compile(fixed.TIME_SLOT), "digit", _time),
    ("date", re.compile(fixed.DATE_SLOT), "month/day", _date),
    ("weekday", re.compile(fixed.WEEKDAY_SLOT), "Hangul", lambda m: (f"({fixed.WEEKDAY_LOOKALIKES.get(m[1], m[1])})", False)),
    ("grade", re.compile(fixed.GRADE_SLOT), "digit/unit", _grade),
    ("class", re.compile(fixed.CLASS_SLOT), "digit/unit", lambda m: (_digits(m[1]) + "반", False)),
    ("phone", re.compile(fixed.PHONE_SLOT), "digit", lambda m: (_digits(m[0]), False)),
)


def find(text: str) -> list[dict]:
    """Every change a slot would make, by (start, end); equal places keep the order of SLOTS."""
    out = []
    for slot, pattern, what, correct in SLOTS:
        for m in pattern.finditer(text):
            fixed_text, review = correct(m)
            if fixed_text is not None and fixed_text != m[0]:
                out.append({"slot_type": slot, "raw_text": m[0], "corrected_text": fixed_text, "reason": f"{slot} slot: {what} confusable correction", "start": m.start(), "end": m.end(), "review_required": review})
    return sorted(out, key=lambda c: (c["start"], c["end"]))


@F.pandas_udf(CORRECTIONS)
def find_corrections(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: find(t) if t else [])


def applied(found: Column) -> Column:
    """Of the found corrections those that don't overlap an earlier kept one; natively."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast(CORRECTIONS).alias("kept"))
    step = lambda acc, c: F.when(c["start"] >= acc["last"], F.struct(c["end"].alias("last"), F.array_append(acc["kept"], c).alias("kept"))).otherwise(acc)
    return F.aggregate(found, start, step, lambda acc: acc["kept"])


def corrected(text: Column, kept: Column) -> Column:
    """The text with kept corrections spliced in, from the last to the first so that places hold."""
    splice = lambda t, c: F.concat(F.substr(t, F.lit(1), c["start"]), c["corrected_text"], F.substr(t, c["end"] + 1))
    return F.aggregate(F.reverse(kept), text, splice)
