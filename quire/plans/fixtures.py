"""Literal rows for rules that the driver's tables don't trigger, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Texts with personal data and look-alikes, notation faults, and labels.
PERSONAL = (
    "등록 900101-2345678 끝", "900101-9234567", "전화 010-1234-5678, 02-123-4567", "031.234.5678 / 1588-1234", "01012345678", "010.1234-5678", "kim01012345678@example.com",
    "4111-1111-1111-1111", "4111 1111 1111 1111", "1234-5678-9012-3456", "110-234-567890", "123-45-67890", "2026-07-16", "12-34-567890-12", "M12345678",
)
NOTATION = (
    "2025.1.6 회의", "2025. 1. 6. 개최", "2025. 01. 06. 개최", "오후 3시 시작", "13 : 20 도착", "345천원 지급", "금 113,560원", "붙임: 계획서", "2. 20.∼2. 24.까지", "MOU(업무 협약)",
    "원장:김갑동", "https://example.com", "핵심 — 요약",
)
LABELS = (
    "성명", "연번1", "제1항목", "업 체 명", "Date of Birth", "6개월", "1억원", "2026년", "제3회", "해당없음", "Seoul", "주식회사 가나", "연락처:", "신청 사유", "Name", "등록기준지²",
)
FORMATS = (
    ("19900315", "date:yy.mm.dd"), ("900315", "date:yyyy-mm-dd"), ("01012345678", "phone:intl"), ("900315-1234567", "rrn:masked"), ("1234567890", "mask:###-##-#####"), ("2026.7.5", "yyyy. m. d."),
    ("abc", "upper"), ("a1b2", "digits"), ("x", "nope"), ("021234567", "phone:dot"), ("99991399", "date:yyyy-mm-dd"), ("12", "###"),
)
TYPES = (
    ("동의", "□ 예"), ("번호", "900101-1234567"), ("비고", "2026. 7. 5."), ("비고", "02-123-4567"), ("비고", "a.b@example.com"), ("비고", "1,200원"), ("신청 금액", ""), ("E-mail (email)", ""), ("내용", "문장"),
)
SERIALS = ((1.0, False, "date"), (59.0, False, "date"), (61.0, False, "date"), (45306.0, False, "date"), (0.0, True, "date"), (-5.0, False, "date"), (45306.75, False, "datetime"))
RANGES = (("1 - 3, 5", 10), ("1-100", 5), ("abc,1,xyz", 9), ("3-1", 9), ("2,2,7", 6))


def numbered(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    """Rows with their place in front, as one small table."""
    return spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "case_id long, " + schema)


def _literal(x: object) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x)


def values_sql(rows: tuple, columns: str) -> str:
    """The same rows in SQL."""
    body = ", ".join("(" + ", ".join([str(i), *(_literal(x) for x in (r if isinstance(r, tuple) else (r,)))]) + ")" for i, r in enumerate(rows))
    return f"(SELECT * FROM (VALUES {body}) AS v(case_id, {columns}))"
