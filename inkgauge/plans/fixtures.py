"""Small inline inputs for behaviour that the data tables don't show: Korean notices, boxes, words, cards.

Each is a VALUES list that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (name, columns, rows); "\n" in a text stands for a line end.
NOTICES = (
    (1, "2026학년도 5월 학교급식 안내\n급식비: 4,402원 × 17회 = 74,834원\n예정 식단\n5/6(수다날) 밥 국 김치 우유\n569.36/21.02/274.41/2.7\n(1.2.5.6)\n5/7 볶음 구이 떡\n5/8 만두 과일\n6/1 탕\n원산지 쌀 국내산\n상담 전화 02-123-4567\nwww.example.kr/a"),
    (2, "현장 체험학습 신청 안내\n일시: 2026년 5월 6일 9:00 ~ 14:40\n장소: 시민공원\n문의 010-1234-5678, 031 123 4567\n제출 기간 2026. 5. 1.\n참여 대상 3학년\nhttps://school.example.com/form 시간 엄수"),
    (3, "meeting 13.16 and 1.5 then 6.10, call 02-1234-5678 or 0212345678"),
    (4, ""),
    (5, "알레르기 (1.2.13.) 표시\n4,402원입니다 4,402원 300 원\n3/1 3/2 4/5"),
    (6, "신고 안내\n공익 제보 044-200-7777\nbit.ly/abc.DEF httpx broken.comx www"),
)
SLOT_CASES = (
    ("OCR-SLOT-001", "체험학습비는 44,B70완입니다.", "체험학습비는 44,870원입니다."),
    ("OCR-SLOT-002", "일시: 8:5O ~ 14:4O", "일시: 8:50 ~ 14:40"),
    ("OCR-SLOT-003", "5원 6일(묵)까지 제출", "5월 6일(목)까지 제출"),
    ("OCR-SLOT-004", "대상: l-6확년, 3밤", "대상: 1-6학년, 3반"),
    ("OCR-SLOT-005", "문의: O10-1234-567S", "문의: 010-1234-5675"),
    ("OCR-SLOT-006", "B반 학생은 OpenClass로 이동", "B반 학생은 OpenClass로 이동"),
    ("OCR-SLOT-007", "5원 6일(묵) 8:5O까지 44,B70완 납부, 문의 O10-1234-567S", "5월 6일(목) 8:50까지 44,870원 납부, 문의 010-1234-5675"),
)
BOXES = (
    (1, 0, 100, 100, 200, 100), (1, 1, 250, 120, 200, 100), (1, 2, 440, 130, 200, 100), (1, 3, 120, 110, 30, 30), (1, 4, 900, 900, 90, 90), (1, 5, 900, 900, 90, 90),
    (2, 0, 0, 0, 400, 300), (2, 1, 400, 0, 200, 300), (2, 2, 0, 300, 600, 50), (2, 3, 700, 700, 250, 200), (2, 4, 705, 705, 240, 190), (2, 5, 10, 1000, 120, 60),
)
WORDS = (
    (1, 1, "alpha", 10.0, 40.0, 10.0, 20.0), (1, 1, "beta", 45.0, 70.0, 9.0, 19.5), (1, 1, "gamma", 5.0, 9.0, 10.1, 21.0), (1, 1, "next", 10.0, 30.0, 30.0, 40.0),
    (1, 2, "page", 10.5, 30.25, 6.0, 12.0), (1, 2, "two", 31.0, 44.0, 5.9, 12.5), (2, 1, " ", 1.0, 2.0, 50.0, 55.0), (2, 1, "가나", 3.0, 9.0, 100.0, 111.0),
)
TABLES = (
    (1, "table_001", 0, 6.5, True, None), (1, "table_002", 1, 3.0, False, "too_small"), (1, "table_003", 2, 6.5, True, None),
    (2, "table_001", 0, 1.0, True, None),
)
VARIANTS = (
    (1, "original", 0, "short text", "ok"), (1, "sharpened", 1, "학부모 안내문입니다 자세한 내용은 2026년 5월 6일까지 제출 바랍니다", "ok"), (1, "table_001", 2, "5/6 13:00~14:00 www.a.com 02-123-4567", "ok"),
    (1, "table_001_psm6", 3, "5/6 13:00~14:00 www.a.com 02-123-4567 x", "ok"), (1, "table_002", 4, "???", "ok"), (1, "table_003_zoom2x", 5, "1,000원 5/7", "ok"), (1, "table_003", 6, "", "runtime_error"),
    (2, "original", 0, "only one", "ok"), (2, "table_001_psm11", 1, "abc", "ok"), (2, "table_001_psm11", 2, "5/9 5/10 5/11", "ok"),
)
LAYOUTS = (
    (1, '[{"text":"참가 동의서는 4월 28일(화)까지 담임선생님께 제출 바랍니다","page":1,"source":"mlkit_line","bbox":{"x":120,"y":340,"width":380,"height":28},"page_size":{"width":1000,"height":1414}}]'),
    (2, '{"pages":[{"page":1,"width":595.28,"height":841.89,"lines":[{"text":"준비물: 간편한 복장, 물","source":"pdfplumber_line","bbox":{"x":80,"y":240,"width":220,"height":14}}]}]}'),
    (3, '[{"text":"전혀 다른 문장입니다","page":1,"bbox":{"x":1,"y":2,"width":3,"height":4}}]'),
    (4, "not json"),
)
CARDS = (
    (1, 0, "4월 28일(화)까지 담임선생님께 제출 바랍니다", None, "제출", 0.92), (1, 1, "4월 28일(화)까지 담임선생님께 제출 바랍니다", None, "again", 0.5),
    (2, 0, "간편한 복장, 물", None, "준비물", 0.85), (3, 0, "4월 28일까지 제출", None, "x", 0.1), (4, 0, "a", None, "x", 0.1),
)


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, str):
        return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in v.split("\n"))
    return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"{v}"


def values(rows, columns: str) -> str:
    """SELECT from VALUES that both engines read; the first row's types hold."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


COLUMNS = {
    "notices": (NOTICES, "doc_id, text"), "slot_cases": (SLOT_CASES, "case_id, raw, expected"), "boxes": (BOXES, "doc_id, ordinal, x, y, width, height"),
    "words": (WORDS, "doc_id, page, text, x0, x1, top, bottom"), "tables": (TABLES, "doc_id, table_id, ordinal, candidate_priority_score, is_candidate, filter_reason"),
    "variants": (VARIANTS, "doc_id, name, ordinal, text, status"), "layouts": (LAYOUTS, "doc_id, layout"), "cards": (CARDS, "doc_id, ordinal, value_ko, title_ko, chip, importance"),
}


def sql(name: str) -> str:
    return values(*COLUMNS[name])


def _read(spark: SparkSession, name: str) -> DataFrame:
    df = spark.sql(sql(name).replace("\\", "\\\\"))
    return df.withColumn("doc_id", df["doc_id"].cast("long")) if "doc_id" in df.columns else df


def notices(spark):
    return _read(spark, "notices")


def slot_cases(spark):
    return _read(spark, "slot_cases")


def boxes(spark):
    return _read(spark, "boxes").selectExpr("*", "1000 AS image_w", "1400 AS image_h")


def words(spark):
    return _read(spark, "words")


def tables(spark):
    return _read(spark, "tables")


def variants(spark):
    return _read(spark, "variants")


def layouts(spark):
    return _read(spark, "layouts")


def cards(spark):
    return _read(spark, "cards").selectExpr("*", "CAST(NULL AS STRING) AS value_translated", "CAST(NULL AS STRING) AS value_easy_ko")
