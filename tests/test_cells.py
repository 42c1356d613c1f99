"""From a table's pixels to its cell structure, on small images."""

import numpy as np
import pytest

from inkgauge.operators import cells, pixels


def drawn(h_lines=(), v_lines=(), w=240, h=160):
    image = np.full((h, w), 255, np.uint8)
    for y in h_lines:
        image[y : y + 3] = 0
    for x in v_lines:
        image[:, x : x + 3] = 0
    return image


def test_line_mask_equals_brute_force():
    rng = np.random.default_rng(3)
    mask = rng.random((20, 60)) < 0.8
    for length in (1, 4, 9):
        want = np.zeros_like(mask)
        for y in range(20):
            for x in range(60 - length + 1):
                if mask[y, x : x + length].all():
                    want[y, max(0, x - 2) : x + length + 2] = True
        assert (pixels.line_mask(mask, length) == want).all()


def test_foreground_and_rotations():
    image = drawn([50])
    assert pixels.foreground(image)[50:53].all() and not pixels.foreground(image)[:40].any()
    assert 0 < pixels.foreground_ratio(image) < 0.1 and pixels.foreground_ratio(np.zeros((0, 0), np.uint8)) == 0.0
    assert [v.shape for v in pixels.rotations(image).values()] == [(160, 240), (240, 160)] * 2
    assert pixels.rotations(image)["rotation_90"][0, -1] == image[0, 0]


@pytest.fixture(scope="module")
def grids(spark):
    made = [("a", drawn([40, 80, 120], [80, 160])), ("b", drawn([40, 80])), ("c", drawn([], [100])), ("d", drawn()), ("e", drawn(range(12, 150, 12), range(20, 230, 30)))]
    rows = [(1, t, x.shape[1], x.shape[0], x.tobytes()) for t, x in made] + [(1, "bad", 9, 9, b"x"), (1, "null", None, None, None)]
    images = spark.createDataFrame(rows, "doc_id long, table_id string, width int, height int, pixels binary")
    found = pixels.line_profiles(images, "doc_id", "table_id")
    assert {r["table_id"] for r in found.where("error is not null").collect()} == {"bad", "null"}
    lined = cells.best_lines(found.where("error is null"))
    tried = cells.grid_trials(lined, "doc_id", "table_id")
    texts = tried.where("ordinal = 1 and row = 0 and col = 0").selectExpr("doc_id", "table_id", "ordinal", "'010-1234-5678' as text")
    best = cells.best_grid(lined, texts, "doc_id", "table_id")
    return cells.grid(lined.join(best, ["doc_id", "table_id"])).cache()


def test_grids(grids):
    got = {r["table_id"]: r for r in grids.collect()}
    assert {k: r["method"] for k, r in got.items()} == {"a": "line_split", "b": "line_split_rows_only", "c": "line_split_cols_only", "d": "uniform_grid", "e": "line_split"}
    assert got["a"]["row_boundaries"] == [0, 41, 81, 121, 160] and got["a"]["col_boundaries"] == [0, 81, 161, 240]
    assert got["d"]["warnings"] == ["No interior lines detected (h=0, v=0). Best grid: 3x4."] and got["d"]["selected_grid_reason"].startswith("grid_3x4 selected: pattern_count=1")
    assert any("exceeds limit" in w for w in got["e"]["warnings"])


def test_structures(spark, grids):
    placed = cells.grid_cells(grids, "doc_id", "table_id")
    texts = spark.createDataFrame(
        [(1, "a", 0, 0, 0, "psm6", "first"), (1, "a", 0, 0, 1, "url_config", "https://a.kr/b"), (1, "a", 0, 1, 0, "psm6", "a cell of sixteen letters"), (1, "a", 0, 1, 1, "psm7", "a cell of sixteen letters"), (1, "a", 1, 0, 0, "psm6", None)],
        "doc_id long, table_id string, row int, col int, ordinal int, variant string, text string",
    )
    read = cells.cell_texts(placed, texts, "doc_id", "table_id")
    found = cells.structures(grids, read, "doc_id", "table_id")
    got = {r["table_id"]: r["cell_structure"] for r in cells.with_structures(grids.select("doc_id", "table_id"), found.where("table_id <> 'd'"), "doc_id", "table_id").collect()}
    a = got["a"]
    assert (a["row_count"], a["col_count"], a["structure_hint"], a["rows"][0]) == (4, 3, "url_table_candidate", ["https://a.kr/b", "a cell of sixteen letters", ""])
    assert [c["ocr_variant"] for c in a["cells"][:4]] == ["url_config", "psm6", "psm6", "psm6"] and a["cells"][0]["bbox"] == [0, 0, 81, 41]
    assert a["grid_candidates"] is None and a["line_detection"]["h_lines"] == 3 and got["d"] is None
    e = got["e"]
    assert len(e["cells"]) == 30 and {c["ocr_variant"] for c in e["cells"]} == {"skipped"} and "too small" in e["warnings"][-1] and len(e["rows"]) == e["row_count"]
