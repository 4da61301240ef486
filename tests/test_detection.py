import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions import text as T
from veilframe.operators import detect as D
from veilframe.operators import patterns as P

HITS = [
    ("PASSPORT_RU", "4510 123456"), ("PASSPORT_RU", "45 10 123456"),
    ("INN_RU", "ИНН 7707083893"), ("INN_RU", "инн 770708389312"), ("INN_RU", "INN:7707083893"),
    ("SNILS_RU", "123-456-789 12"), ("SNILS_RU", "12345678912"),
    ("PHONE_RU", "+7 999 123-45-67"), ("PHONE_RU", "+7(999)123-45-67"), ("PHONE_RU", "8 999 123-45-67"),
    ("CREDIT_CARD", "4532 0151 1283 0366"), ("CREDIT_CARD", "4532015112830366"),
    ("BANK_ACCOUNT_RU", "40817810099910004312"),
    ("VEHICLE_PRIVATE_RU", "А123ВС77"), ("VEHICLE_PRIVATE_RU", "а 123 вс 777"),
    ("VEHICLE_TAXI_BUS_RU", "АВ 123 77"), ("VEHICLE_TRAILER_RU", "АВ 1234 77"),
    ("VEHICLE_MOTO_RU", "1234 АВ 77"), ("VIN", "WVWZZZ3CZWE123456"),
    ("KPP_RU", "КПП 770701001"), ("BIK_RU", "044525225"), ("OGRN_RU", "1027700132195"),
    ("INTL_PASSPORT_RU", "71 1234567"),
    ("OMS_RU", "ОМС 1234567890123456"), ("OMS_RU", "полис 1234567890123456"),
    ("DRIVER_LICENSE_RU", "77 14 892015"),
    ("ADDRESS_RU", "г. Москва, ул. Тверская, д. 10, кв. 5"),
    ("AADHAAR_IN", "1234 5678 9012"), ("AADHAAR_IN", "123456789012"), ("PAN_IN", "ABCDE1234F"),
    ("VOTER_ID_IN", "ABC1234567"), ("PASSPORT_IN", "A1234567"), ("GSTIN_IN", "27ABCDE1234F1Z5"),
    ("DRIVING_LICENSE_IN", "MH12 2010 1234567"), ("PHONE_IN", "+91 9876543210"),
    ("PHONE_IN", "919876543210"), ("IFSC_IN", "SBIN0001234"),
    ("VEHICLE_STANDARD_IN", "MH 12 AB 1234"), ("VEHICLE_BH_IN", "21 BH 1234 AB"),
    ("EMAIL_ADDRESS", "<user@test.com>"),
]
MISSES = [
    ("INN_RU", "7707083893"), ("KPP_RU", "770701001"), ("VIN", "WVWZZZ3CZWI123456"),
    ("CREDIT_CARD", "4532015112830367"), ("CREDIT_CARD", "123"), ("EMAIL_ADDRESS", "user@ home"),
]


@pytest.mark.parametrize("hit,cases", [(True, HITS), (False, MISSES)])
def test_literal_cases(spark, hit, cases):
    for ty in dict.fromkeys(t for t, _ in cases):
        rows = [(text,) for t, text in cases if t == ty]
        found = spark.createDataFrame(rows, "text string").select(
            "text", F.expr(D.pattern_spans("text", P.BY_TYPE[ty])).alias("s")
        )
        for row in found.collect():
            assert bool(row.s) is hit, (ty, row.text)


TEXTS = [
    "Права: 77 14 892015. Полис ОМС: 1234567890123456. г. Москва, ул. Тверская, д. 10, кв. 5. 4532015112830366.",
    "Клиент 😀 日本, тел +7 999 123-45-67, ИНН 7707083893; СНИЛС 123-456-789 12\nА123ВС77 и а 124 вс 77",
    "4510 123456 4510 123457 71 1234567 044525225 КПП 770701001",
    "12345", "", " \n\t ", "￿ 4510 123456 ￾",
]


def test_offsets_equal_the_regex_module(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for pattern in P.RU + P.IN:
        found = df.select("text", F.expr(S.find_all("text", pattern.compiled)).alias("m"))
        for row in found.collect():
            expected = [
                (m.start(), m.group())
                for m in re.finditer(pattern.regex, row.text, re.IGNORECASE)
            ]
            assert [(m.st, m.v) for m in row.m] == expected, pattern.ty


def test_long_text_gives_the_same_spans_as_short_ones(spark):
    line = "Паспорт 45 10 12345{i}; тел +7 999 123-45-6{j}! почта user{i}@mail.example, слова и слова. "
    lines = [line.format(i=i % 10, j=i % 7) for i in range(1500)]
    long = "".join(lines)
    df = spark.createDataFrame([(0, long)], "k int, text string")
    got = D.found_in(df, ["k"], lang="ru").collect()
    expected, base = [], 0
    short = spark.createDataFrame(list(enumerate(lines)), "k int, text string")
    per = {}
    for row in D.found_in(short, ["k"], lang="ru").collect():
        per.setdefault(row.k, []).append(row)
    for i, text in enumerate(lines):
        expected += [(r.st + base, r.ty, r.v) for r in per.get(i, [])]
        base += len(text)
    assert len(long) > 2 * S.PART
    assert sorted((r.st, r.ty, r.v) for r in got) == sorted(expected)


def test_ties_and_overlaps(spark):
    df = spark.createDataFrame([("ИНН 7707083893, БИК 044525225",)], "text string")
    spans = df.select(F.explode(F.expr(D.detect("text", "'ru'"))).alias("s")).collect()
    assert [(r.s.ty, r.s.v) for r in spans] == [("INN_RU", "7707083893"), ("BIK_RU", "044525225")]


def test_splice_many_pieces(spark):
    text = "ab1" * 200
    pieces = f"transform({S.find_all('text', '[0-9]')}, m -> named_struct('st', m.st, 'ln', m.ln, 'rep', '<>'))"
    df = spark.createDataFrame([(text,), ("none",)], "text string")
    got = [r[0] for r in df.select(F.expr(S.splice("text", pieces))).collect()]
    assert got == [text.replace("1", "<>"), "none"]


def test_scalars(spark):
    df = spark.createDataFrame(
        [("4532015112830366", "Привет"), ("4532015112830367", "Hello"), ("123", "Hello Привет")],
        "n string, t string",
    )
    rows = df.select(F.expr(T.luhn_valid("n")), F.expr(T.language("t"))).collect()
    assert [tuple(r) for r in rows] == [(True, "ru"), (False, "en"), (False, "ru")]
    assert T.is_sensitive_header("Зарплата сотрудника") and T.is_sensitive_header("salary")
    assert not T.is_sensitive_header("Имя") and not T.is_sensitive_header(None)
