"""Layout, tables, slots, highlights and metrics on small inputs."""

import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkgauge.functions import edit, geometry
from inkgauge.operators import layout, slots
from inkgauge.plans import fixtures, registry


@pytest.mark.parametrize(("case", "raw", "expected"), fixtures.SLOT_CASES)
def test_slot_cases(case, raw, expected):
    out, last, parts = slots.find(raw), 0, []
    for c in out:
        if c["start"] >= last:
            parts += [raw[last : c["start"]], c["corrected_text"]]
            last = c["end"]
    assert "".join(parts) + raw[last:] == expected


def test_slots_natively_applied(spark):
    got = {r["case_id"]: r for r in registry.slot_corrections(spark, "").collect()}
    assert all(got[c]["corrected"] == e for c, _, e in fixtures.SLOT_CASES)
    assert got["OCR-SLOT-007"]["n"] == 5 and got["OCR-SLOT-006"]["n"] == 0


def test_slot_review_and_overlap():
    (c,) = slots.find("일시: 28:7O")
    assert (c["slot_type"], c["corrected_text"], c["review_required"]) == ("time", "28:70", True)
    assert [c["slot_type"] for c in slots.find("1O원 6일")][0] == "amount"
    assert slots.find("5월 6일(목) 9:00, 문의 010-1234-5678") == []
    assert slots.find("대상: l~6확년")[0]["corrected_text"] == "1-6학년"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="0Ool|15SB:,.-~ 원완월일반밤학확년(묵)가", max_size=40))
def test_slots_are_sorted_and_real(raw):
    found = slots.find(raw)
    assert [(c["start"], c["end"]) for c in found] == sorted((c["start"], c["end"]) for c in found)
    assert all(raw[c["start"] : c["end"]] == c["raw_text"] != c["corrected_text"] for c in found)


def test_highlights(spark):
    got = {r["doc_id"]: r for r in registry.highlight_links(spark, "").collect()}
    assert set(got) == {1, 2}
    assert (got[1]["highlight_id"], got[1]["category"], got[1]["x"], got[1]["page_height"]) == ("h_001", "제출", 120.0, 1414.0)
    assert (got[2]["source"], got[2]["page_width"]) == ("pdfplumber_line", 595.28)


def test_spaced_and_boundaries(spark):
    df = spark.createDataFrame([([0, 4, 8, 12],), ([],), ([3],)], "p array<int>")
    assert [r[0] for r in df.select(layout.spaced(F.col("p"))).collect()] == [[0, 8], [], [3]]
    assert [r[0] for r in df.select(layout.boundaries(F.col("p"), F.lit(0), F.lit(15))).collect()] == [[0, 8, 15], [0, 15], [0, 15]]


def test_runs_close_at_the_end(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 9, 9, 0, 9, 9, 9])], "k int, i int, value int")
    assert sorted(r["center"] for r in layout.run_centers(df, "k", threshold=F.lit(5)).collect()) == [2, 5]


def test_words_to_lines_round_half_to_even(spark):
    df = spark.createDataFrame([(1, "b", 5.0, 6.0, 10.0, 11.0), (1, "a", 1.0, 2.0, 8.0, 9.0), (1, " ", 1.0, 2.0, 50.0, 51.0)], "d int, text string, x0 double, x1 double, top double, bottom double")
    (r,) = layout.words_to_lines(df, "d").collect()
    assert (r["text"], r["x"], r["width"], r["height"]) == ("a b", 1.0, 5.0, 3.0)


def test_merge_is_one_pass(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 100, 100), (1, 1, 90, 0, 100, 99), (1, 2, 185, 0, 100, 98), (1, 3, 600, 600, 10, 10)], "k long, ordinal int, x int, y int, width int, height int")
    got = sorted((r["x"], r["width"]) for r in layout.merge_boxes(df, "k").collect())
    assert got == [(0, 285), (600, 10)]


def test_equal_boxes_survive_containment(spark):
    df = spark.createDataFrame([(1, 0, 0, 9, 9), (1, 0, 0, 9, 9), (1, 2, 2, 3, 3)], "k int, x int, y int, width int, height int")
    assert layout.without_contained(df, "k").count() == 2


def test_iou_is_symmetric(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 10, 10), (0, 0, 10, 10, 10, 0, 5, 5)], "ax int, ay int, aw int, ah int, bx int, by int, bw int, bh int")
    a, b = ({k: F.col(p + k[0]) for k in geometry.BOX} for p in "ab")
    for r in df.select(geometry.iou(a, b).alias("u"), geometry.iou(b, a).alias("v")).collect():
        assert r["u"] == r["v"]
    assert df.select(geometry.iou(a, b)).collect()[1][0] == 0.0


def test_edit_rates(spark):
    rows = [("", ""), ("", "x"), ("a b", "a b"), ("가1", "가 2"), ("b a a", "a a b")]
    df = spark.createDataFrame(rows, "t string, h string")
    got = df.select(edit.cer(F.col("t"), F.col("h")), edit.wer(F.col("t"), F.col("h")), edit.jamo_cer(F.col("t"), F.col("h")), edit.line_accuracy(F.col("t"), F.col("h"))).collect()
    assert tuple(got[0]) == (0.0, 0.0, 0.0, 1.0) and tuple(got[1]) == (1.0, 1.0, 1.0, 0.0) and tuple(got[2]) == (0.0, 0.0, 0.0, 1.0)
    assert got[3][0] == 0.5 and got[3][1] == 2.0 and got[3][2] == 0.25


def test_multiset_overlap(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["a", "a", "a", "c"]), ([], ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(edit.multiset_overlap(F.col("a"), F.col("b"))).collect()] == [2, 0]


def test_table_results(spark):
    got = {(r["doc_id"], r["table_id"]): r for r in registry.table_results(spark, "").collect()}
    assert got[1, "table_001"]["best_variant"] == "psm6"
    assert got[1, "table_002"]["filter_reason"] == "too_small, low_ocr_signal"
    assert got[2, "table_001"]["best_variant"] == "psm11" and got[2, "table_001"]["is_candidate"]
