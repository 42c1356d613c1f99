"""Patterns, word lists, weights and thresholds that results depend on."""

# Spacing repairs, in the order they apply (Java regex, Unicode classes).
SPACING_REPAIRS = (
    (r"(?U)(\d{4})\s*학\s*년\s*도", "$1학년도"),
    (r"(?U)(\d{1,2})\s*월", "$1월"),
    (r"(?U)학\s*교\s*급\s*식", "학교급식"),
    (r"(?U)급\s*식\s*안\s*내", "급식 안내"),
    (r"(?U)(\d)\s*/\s*(\d)", "$1/$2"),
    (r"(?U)(\d)\s*\.\s*(\d)", "$1.$2"),
    (r"(?U)(\d)\s*,\s*(\d{3})", "$1,$2"),
    (r"(?U)\s+원", "원"),
)

# Patterns of the quality gate.
NUTRITION = r"(?U)\b\d+(?:\.\d+)?/\d+(?:\.\d+)?/\d+(?:\.\d+)?/\d+(?:\.\d+)?\b"
ALLERGY = r"(?U)\((?:\d{1,2}\.){2,}\d{1,2}\)"
MEAL_DATE = r"(?U)(?<![\d.])(?:[1-9]|1[0-2])\s*/\s*(?:[1-9]|[12]\d|3[01])(?:\([^)]+\))?(?![\d.])"
DOTTED_DATE = r"(?U)\b20\d{2}\s*[.]\s*(?:[1-9]|1[0-2])\s*[.]\s*(?:[1-9]|[12]\d|3[01])\s*[.]?"
HANGUL_DATE = r"(?U)\b20\d{2}\s*년\s*(?:[1-9]|1[0-2])\s*월(?:\s*(?:[1-9]|[12]\d|3[01])\s*일)?"
GATE_PHONE = r"(?U)(?<!\d)0\d{1,2}\s*[-\s]\s*\d{3,4}\s*[-\s]\s*\d{4}\b"
GATE_TIME = r"(?U)\b\d{1,2}\s*:\s*\d{2}(?:\s*[~-]\s*\d{1,2}\s*:\s*\d{2})?\b"
AMOUNT = r"(?U)\b\d{1,3}(?:,\d{3})+\s*원\b|\b\d+\s*원\b"
URL = r"(?iu)(?:https?://)?(?:www\.)?[A-Za-z0-9][A-Za-z0-9.-]*\.(?:com|net|org|kr)(?:/[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*)?"
SHORT_URL = r"(?iu)bit\.ly/[A-Za-z0-9._-]+"
URL_CANDIDATE = r"(?iuU)\b(?:www|http|bit|w{2,}|[A-Za-z0-9.-]+)\S{0,40}\b"
URL_HINT = r"(?iu)www|http|bit\.?|\.com|\.kr"
PHONE_CANDIDATE = r"(?U)\b0\d[\d\s.-]{6,14}\d\b"

# Patterns of table text.
TABLE_PHONE = r"(?U)\b0\d{1,2}[-\s.]?\d{3,4}[-\s.]?\d{4}\b"
TABLE_DATE = r"(?U)\b\d{4}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{1,2}\b"
TABLE_SHORT_DATE = r"(?U)\b\d{1,2}\s*[.\-/]\s*\d{1,2}\b"
TABLE_TIME = r"(?U)\b\d{1,2}\s*:\s*\d{2}\s*(?:~|-)\s*\d{1,2}\s*:\s*\d{2}\b"
TABLE_KEYS = ("urls", "phones", "dates", "times", "amounts")

# Character classes.
MEANINGFUL = r"[가-힣A-Za-z0-9]"
HANGUL = r"[가-힣]"
ASCII_WORD = r"[A-Za-z0-9]"
GARBAGE = r"[^ \n\t\r가-힣A-Za-z0-9.,:/()\-_%+~#@&=]"
SPACED_RUN = r"(?U)(?:\S\s){4,}\S"
TOKEN = r"[가-힣A-Za-z0-9:/._-]+"

# Word lists.
MEAL_NOTICE = r"(?U)학교\s*급식|급식|식단|알레르기"
MENU_WORDS = ("밥", "국", "김치", "우유", "샐러드", "볶음", "구이", "찜", "탕", "면", "떡", "과일", "핫도그", "만두")
NOTICE_WORDS = ("안내", "신청", "기간", "문의", "대상", "장소", "시간", "참여", "제출")

# Section starts.
TITLE_START = r"(?U)학교\s*급식\s*안내|급식\s*안내"
MEAL_START = r"(?U)예정\s*식단|\d{1,2}/\d{1,2}|급식\s*식단"
ORIGIN_START = r"원산지|식재료"
PUBLIC_START = r"(?U)공익\s*제보|상담\s*전화|신고"

# Labels of the rendered model input, and its caps.
BLOCKS = {"title": "[문서 제목]", "notice": "[주요 안내]", "meal_table": "[급식 일정/메뉴]", "patterns": "[추출 패턴]", "nutrition": "[영양성분 수치 후보]", "allergy": "[알레르기/식품 코드 후보]", "origin_info": "[원산지 정보]", "public_report_info": "[공익제보/문의]"}
PATTERN_LABELS = (("날짜", "dates"), ("급식 날짜", "meal_dates"), ("금액", "amounts"), ("전화번호", "phones"), ("URL", "urls"))
CAUTION = "[주의]\nOCR/PDF 변환 결과 기반 정제 후보입니다. 사용자 확인이 필요합니다."
VALUE_CAP, NUMBER_CAP = 20, 30

# Messages.
TOO_SHORT = "OCR text is too short for automatic verification."
MUCH_GARBAGE = "Garbage character ratio is above 0.10."
SHORT_LINES = "Too many short OCR lines."
MUCH_SPACING = "Excessive character spacing detected."
NO_MEAL_DATE = "No meal date pattern detected."
CONFUSED_DATES = "Nutrition-like numbers may still be mixed with date candidates."
NO_CORE = "No core notice pattern detected."
BROKEN_URLS = "Suspicious broken URL candidates detected."
BROKEN_PHONES = "Suspicious broken phone number candidates detected."
NO_TABLE = "No table candidate detected."
SPARSE_CELLS = "Table cell OCR density is low."
NO_CELLS = "Table candidates exist, but cell_structure is missing."
BELOW_THRESHOLD = "overall_score below threshold"
GARBAGE_REASON = "garbage_ratio above 0.10"
F1_REASON = "F1 below target 0.90"
CER_REASON = "CER above target 0.10"

# Thresholds and weights of the gate.
THRESHOLD, TARGET_F1, TARGET_CER = 0.90, 0.90, 0.10
WEIGHTS_TABLE, WEIGHTS_TEXT = (0.50, 0.35, 0.15), (0.62, 0.38, 0.0)

# Look-alikes corrected in slots.
LOOKALIKE_FROM, LOOKALIKE_TO = "OoIl|SsB", "00111558"
WEEKDAY_LOOKALIKES = {"묵": "목", "귬": "금"}
AMOUNT_SLOT = r"([0-9OoIl|SsB][0-9OoIl|SsB,.]{1,})\s*(원|완)"
TIME_SLOT = r"(?<![0-9A-Za-z])([0-9OoIl|]{1,2})\s*:\s*([0-9OoIl|Ss]{2})(?![0-9A-Za-z])"
DATE_SLOT = r"([0-9OoIl|]{1,2})\s*(월|원)\s*([0-9OoIl|]{1,2})\s*일"
WEEKDAY_SLOT = r"\(([월화수목묵금귬토일])\)"
GRADE_SLOT = r"([0-9OoIl|]{1,2})\s*(?:[-~]\s*([0-9OoIl|]{1,2}))?\s*(학|확)\s*년"
CLASS_SLOT = r"([0-9OoIl|]{1,2})\s*(반|밤)"
PHONE_SLOT = r"(?<![\w])([0-9OoIl|Ss]{2,4}(?:-[0-9OoIl|Ss]{3,4}){1,2})(?![\w])"

# OCR variants of a table, label and suffix of the result's name.
TABLE_VARIANTS = (("default", ""), ("psm6", "_psm6"), ("psm11", "_psm11"), ("url_config", "_url_config"), ("zoom2x", "_zoom2x"), ("zoom2x_psm6", "_zoom2x_psm6"), ("zoom2x_psm11", "_zoom2x_psm11"), ("zoom2x_url_config", "_zoom2x_url_config"), ("zoom3x", "_zoom3x"))
CHUNK_VARIANTS = ("default", "psm6", "psm11", "url_config")
FALLBACK_NAMES = ("adaptive_threshold", "contrast_enhanced", "sharpened", "warped", "original")

# Line-detection parameters and grids by aspect.
KERNEL_RATIOS, LINE_FRACTIONS = (3, 5, 8), (0.40, 0.30, 0.20)
GRIDS = ((2.5, ((2, 2), (2, 3), (3, 4), (4, 4), (3, 3))), (1.2, ((3, 3), (3, 4), (4, 3), (4, 4))), (0.8, ((3, 2), (3, 3), (2, 3))), (None, ((4, 2), (3, 2), (5, 2))))
MOST_GRID_CELLS, MOST_CELLS, LEAST_CELL = 20, 30, 20
# Texts of result documents.
ENGINE = "pytesseract"
ROTATION_FAILED = "Rotation OCR failed; original orientation was used."
ROTATION_USELESS = "Rotation scores were not useful; original orientation was used."
ROTATION_BEST = "Best rotation selected by quick OCR scoring."
CAUTIONS = (
    "OCR text is an experiment artifact, not ground truth.",
    "Do not use OCR output directly as training data without human review.",
)
TODO = ("PDF input handling", "Table crop improvement", "CER/WER evaluation")
