"""Texts with identifiers, derived from the given tables.

Each is one SELECT that Spark and the oracle both understand, so the two sides
work on the same texts: ``{w}`` in a template is a number of w digits made from the
key, ``{abc}`` one of the characters.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PRIMES = [7919, 104729, 15485863, 611953, 1299709, 224737, 350377, 479909, 746773, 882377]
PLATE = "АВЕКМНОРСТУХ"
LATIN = "ABCDEFGHJKLMNPRSTUVWXYZ"


def filled(key: str, template: str) -> str:
    """A SQL expression for ``template`` with its places filled from ``key``."""
    parts = []
    for i, piece in enumerate(re.split(r"(\{[^}]*\})", template)):
        place = piece[1:-1] if piece.startswith("{") else None
        mixed = f"({key} * {_PRIMES[i % len(_PRIMES)]} + {31 * i + 17})"
        if place is None:
            if piece:
                parts.append(f"'{piece}'")
        elif place.isdigit():
            width = int(place)
            # A long number is put together from short ones.
            for j in range(0, width, 6):
                w = min(6, width - j)
                salted = f"({mixed} * {j + 1} + {j})"
                parts.append(f"lpad(cast({salted} % {10**w} as string), {w}, '0')")
        else:
            parts.append(f"substr('{place}', cast({mixed} % {len(place)} as int) + 1, 1)")
    return f"concat({', '.join(parts)})"


_C, _L = "{" + PLATE + "}", "{" + LATIN + "}"

# Two hits or more and a near miss for every type.
TEMPLATES = {
    "PASSPORT_RU": "Паспорт 45{2} №{6} выдан, ранее {2} {2} {6}; код {5}.",
    "INTL_PASSPORT_RU": "Загранпаспорт {2} {7} или {2}{7}; код {6}.",
    "INN_RU": "ИНН {10}, инн: {12}; без слова {8}, INN:{10}.",
    "SNILS_RU": "Страховой {3}-{3}-{3} {2} и {11} конец, {10}.",
    "OGRN_RU": "ОГРН {13}, ОГРНИП {15}, прочее {14}.",
    "KPP_RU": "КПП {9}, кпп: {9}, без слова {9}.",
    "BANK_ACCOUNT_RU": "Счёт 4{19}, другой 3{19}.",
    "BIK_RU": "БИК 04{7}, прочее 05{7}.",
    "CREDIT_CARD": "Карта {4} {4} {4} {4} и {16}, {4}-{4}-{4}-{4}; код {12}.",
    "PHONE_RU": "тел +7 9{2} {3}-{2}-{2}, 8({3}){3}{2}{2}; код 7{5}.",
    "DRIVER_LICENSE_RU": "Права {2} {2} {6}, {2} АВ {6}; код {5}.",
    "OMS_RU": "ОМС {16}, полис: {16}; номер {16}.",
    "ADDRESS_RU": "Адрес: г. Москва, ул. Тверская, д. {2}, кв. {3}; затем город Тверь, дом {1} и всё.",
    "VEHICLE_PRIVATE_RU": f"Номер {_C}{{3}}{_C}{_C}{{2}}, {_C} {{3}} {_C}{_C} {{3}}; код {{2}}.",
    "VEHICLE_TAXI_BUS_RU": f"Такси {_C}{_C} {{3}} {{2}}, {_C}{_C}{{3}}{{3}}; код {{2}}.",
    "VEHICLE_TRAILER_RU": f"Прицеп {_C}{_C} {{4}} {{2}}, {_C}{_C}{{4}}{{3}}; код {{2}}.",
    "VEHICLE_MOTO_RU": f"Мотоцикл {{4}} {_C}{_C} {{2}}, {{4}}{_C}{_C}{{3}}; код {{2}}.",
    "VIN": f"Кузов XWV{_L}{_L}ZZ{{10}}, код XIO{_L}{_L}ZZ{{10}}.",
    "AADHAAR_IN": "Aadhaar {4} {4} {4} or {12}, code {11}.",
    "PAN_IN": f"PAN {_L}{_L}{_L}{_L}{_L}{{4}}{_L}, code {_L}{{4}}{_L}.",
    "VOTER_ID_IN": f"Voter {_L}{_L}{_L}{{7}}, code {{7}}.",
    "PASSPORT_IN": f"Passport {_L}{{7}}, code {_L}{{6}}.",
    "GSTIN_IN": f"GST {{2}}{_L}{_L}{_L}{_L}{_L}{{4}}{_L}1Z{{1}}, code {{2}}{_L}Z.",
    "DRIVING_LICENSE_IN": f"Licence {_L}{_L}{{2}} 20{{2}} {{7}} or {_L}{_L}-{{2}}-20{{2}}-{{7}}, code {{4}}.",
    "PHONE_IN": "Phone +91 9{9} or 919{9}, code {7}.",
    "IFSC_IN": f"IFSC {_L}{_L}{_L}{_L}0{{6}}, code {_L}0{{6}}.",
    "VEHICLE_STANDARD_IN": f"Car MH {{2}} {_L}{_L} {{4}}, KA{{2}}{_L}{{4}}; code {{3}}.",
    "VEHICLE_BH_IN": f"Car {{2}} BH {{4}} {_L}{_L}, {{2}}BH{{4}}{_L}; code {{3}}.",
    "EMAIL_ADDRESS": "Mail to user{5}.x@host{2}.example.com, or a{4}@b{1}.example; not user{3}@ home.",
}


def typed_texts(ty: str) -> str:
    """One text per customer with identifiers of one type: k, text."""
    return f"SELECT c_custkey AS k, {filled('c_custkey', TEMPLATES[ty])} AS text FROM customer"


_CLIENT = (
    "concat('Клиент ', c_name, ', тел +7 9', lpad(cast(c_custkey % 100 as string), 2, '0'), ' ', "
    "lpad(cast(c_custkey % 1000 as string), 3, '0'), '-', "
    "lpad(cast(c_nationkey as string), 2, '0'), '-', "
    "lpad(cast(c_custkey % 97 as string), 2, '0'), ', ИНН ', "
    "lpad(cast(7700000000 + c_custkey as string), 10, '0'))"
)
# One text per customer; a nation is a group.
RU_CLIENTS = (
    "SELECT cast(c_nationkey as string) AS group_id, c_custkey AS doc_seq, 0 AS unit_no, "
    f"{_CLIENT} AS text FROM customer"
)
# The client named again in every order: values repeat within a group.
RU_ORDERS = (
    "SELECT cast(c_nationkey as string) AS group_id, o_orderkey AS doc_seq, 0 AS unit_no, "
    f"concat('Заказ: ', {_CLIENT}, ', почта client', cast(c_custkey as string), "
    "'@shop.example, приоритет ', o_orderpriority) AS text "
    "FROM orders JOIN customer ON o_custkey = c_custkey"
)
# Many groups, and one that holds every third order.
SKEWED_ORDERS = (
    "SELECT case when o_orderkey % 3 = 0 then 'hot' else cast(c_nationkey as string) end AS group_id, "
    f"o_orderkey AS doc_seq, 0 AS unit_no, concat('Заказ: ', {_CLIENT}) AS text "
    "FROM orders JOIN customer ON o_custkey = c_custkey"
)
EN_CLIENTS = (
    "SELECT cast(c_nationkey as string) AS group_id, c_custkey AS doc_seq, 0 AS unit_no, "
    + filled(
        "c_custkey",
        "Client phone +91 9{9}, PAN ABCDE{4}F, Aadhaar {4} {4} {4}, mail user{5}@host{2}.example.",
    )
    + " AS text FROM customer"
)
# Text that quotes names of suppliers and nations.
NAMED_TEXTS = (
    "SELECT o_orderkey AS k, concat('Order for ', s_name, ' from ', n_name, ' by clerk ', "
    "cast(o_orderkey % 7 as string), ', see ', upper(n_name), '.') AS text FROM orders "
    "JOIN supplier ON s_suppkey = o_orderkey % (SELECT count(*) FROM supplier) "
    "JOIN nation ON n_nationkey = s_nationkey"
)
GAZETTEER = (
    "SELECT lower(s_name) AS form, 'RU_ORGANIZATION' AS ty, 0.9 AS score FROM supplier "
    "UNION ALL SELECT lower(n_name), 'RU_LOCATION', 0.9 FROM nation "
    "UNION ALL SELECT lower(concat(s_name, ' from ', n_name)), 'PERSON', 0.95 FROM supplier "
    "JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0"
)
# Sessions out of orders: the even keys belong to a group, the others stand alone.
SESSIONS = (
    "SELECT md5(cast(o_orderkey as string)) AS session_id, "
    "case when o_orderkey % 2 = 0 then concat('grp-', cast(o_custkey as string)) end AS group_id, "
    "concat('user-', cast(o_custkey % 10 as string)) AS user_token, "
    "concat('file', cast(o_orderkey % 100 as string), '.txt') AS filename, 'ru' AS lang, "
    "o_orderdate AS created_at, o_orderkey AS seq FROM orders"
)
# Their tokens: one of the order, one shared by all orders of a customer.
SESSION_TOKENS = (
    "SELECT md5(cast(o_orderkey as string)) AS session_id, "
    "concat('<ORDER_', cast(o_orderkey as string), '>') AS token, "
    "concat('order ', cast(o_orderkey as string)) AS original FROM orders UNION ALL "
    "SELECT md5(cast(o_orderkey as string)), '<PRIORITY_1>', o_orderpriority FROM orders"
)
# Requests that name sessions, groups, both, or nothing known.
REQUESTS = (
    "SELECT c_custkey AS req, case when c_custkey % 4 = 0 then concat('grp-', cast(c_custkey as string)) "
    "when c_custkey % 4 = 1 then concat(md5(cast(c_custkey as string)), ', grp-', cast(c_custkey as string)) "
    "when c_custkey % 4 = 2 then concat(md5(cast(c_custkey as string)), chr(10), ' ,', "
    "md5(cast(c_custkey + 1 as string))) "
    "else concat('unknown-', cast(c_custkey as string)) end AS ids FROM customer"
)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str, select: str) -> DataFrame:
    """Run one of the SELECTs above on the tables of ``sf``."""
    named = {}
    for name in TABLES:
        if re.search(rf"\b{name}\b", select):
            named[name] = table(spark, sf, name)
            select = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", select)
    return spark.sql(select, **named)
