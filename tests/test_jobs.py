import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions import fakes
from veilframe.operators import entities as E
from veilframe.operators import patterns as P
from veilframe.operators.contain import contained_in, occurrences
from veilframe.operators.names import case_forms, pool_forms
from veilframe.plans import jobs
from veilframe.sources import sessions

TEXTS = [
    (1, "g", "Права: 77 14 892015. Полис ОМС: 1234567890123456. Карта 4532015112830366, +7 999 123-45-67."),
    (2, "g", "Email <user@test.com> и Second@Test.com, тел +7 999 123-45-67, ещё 8 999 765-43-21"),
    (3, "g", "   "),
    (4, "h", "USER@test.com, паспорт 4510 123456 и 4510 123457, снова 4510 123456"),
    (5, "g", "Нет ничего"),
    (6, "h", "user@TEST.com пишет: ИНН 7707083893, БИК 044525225"),
]


def frame(spark):
    return spark.createDataFrame(TEXTS, "doc_seq bigint, group_id string, text string")


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def model(texts):
    """One text after the other, as a person would do it by hand."""
    maps, counts, out = {}, {}, {}
    mail = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
    for seq, group, text in texts:
        spans = [
            (m.end() - m.start(), -m.start(), -p.rank, p.ty)
            for p in P.RU
            for m in re.finditer(p.regex, text, re.IGNORECASE)
            if not p.luhn or luhn(m.group())
        ]
        kept = []
        for ln, neg, _, ty in sorted(spans, reverse=True):
            if all(max(-neg, s) >= min(-neg + ln, e) for s, e, _ in kept):
                kept.append((-neg, -neg + ln, ty))
        for chosen in (kept, None):
            if chosen is None:
                chosen = [(m.start(), m.end(), "EMAIL_ADDRESS") for m in mail.finditer(text)]
            for start, end, ty in sorted(chosen, reverse=True):
                key = (group, text[start:end].strip().lower())
                if key not in maps:
                    counts[group, ty] = counts.get((group, ty), 0) + 1
                    maps[key] = f"<{ty}_{counts[group, ty]}>"
                text = text[:start] + maps[key] + text[end:]
        out[seq] = text
    return out


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_tags_equal_the_sequential_model(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        done = jobs.mask(frame(spark), group="group_id", lang="ru")
        assert {r.doc_seq: r.masked_text for r in done.masked.collect()} == model(TEXTS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("mode", ["tags", "fake"])
def test_round_trip(spark, mode):
    done = jobs.mask(frame(spark), group="group_id", lang="ru", mode=mode, secret="s")
    rows = done.masked.collect()
    originals = {(r.group_id, r.original) for r in done.entities.collect()}
    for row in rows:
        for group, original in originals:
            assert group != row.group_id or len(original) < 5 or original not in row.masked_text
    back = jobs.restore_group(done.masked.drop("text"), "masked_text", done.token_map)
    texts = {t[0]: t[2] for t in TEXTS}
    for row in back.collect():
        assert row.restored_text.lower() == texts[row.doc_seq].lower()


def test_tokens_are_one_to_one_and_runs_go_on(spark):
    df = frame(spark)
    one = jobs.mask(df.where("doc_seq < 4"), group="group_id", lang="ru")
    two = jobs.mask(df.where("doc_seq >= 4"), group="group_id", lang="ru", existing=one.entities)
    every = {(r.group_id, r.norm): r.token for r in one.entities.collect()}
    for row in two.entities.collect():
        assert every.setdefault((row.group_id, row.norm), row.token) == row.token
    assert len({(g, t) for (g, _), t in every.items()}) == len(every)
    whole = jobs.mask(df, group="group_id", lang="ru").entities.collect()
    assert every == {(r.group_id, r.norm): r.token for r in whole}


def test_reuse_left_to_right_and_case(spark):
    df = frame(spark).unionByName(frame(spark).withColumn("doc_seq", F.col("doc_seq") + 10))
    a = jobs.mask(df, group="group_id", lang="ru").masked.select("doc_seq", "masked_text")
    b = jobs.mask(df, group="group_id", lang="ru", reuse=True).masked.select("doc_seq", "masked_text")
    assert sorted(a.collect()) == sorted(b.collect())
    ltr = jobs.mask(frame(spark), group="group_id", lang="ru", left_to_right=True).entities
    assert ltr.where("norm = '4510 123456'").first().token == "<PASSPORT_RU_1>"
    exact = jobs.mask(frame(spark), group="group_id", lang="ru", case_sensitive=True).entities
    assert exact.where("group_id = 'h' and ty = 'EMAIL_ADDRESS'").count() == 2


def test_fakes_have_their_format(spark):
    rows = [("g", f"v{ty}{i}", ty, "A123BC77" if ty.startswith("VEHICLE") else "1234567890", i)
            for ty in list(P.BY_TYPE) + ["PERSON", "RU_ORGANIZATION", "RU_LOCATION", "OTHER"]
            for i in range(1, 30)]
    df = spark.createDataFrame(rows, "group_id string, norm string, ty string, original string, n bigint")
    made = fakes.stand_ins(df, "s").collect()
    for row in made:
        if row.ty in fakes.FORMATS:
            shape = "".join(
                f"[{fakes.ALPHABETS[c]}]" if c in fakes.ALPHABETS else re.escape(c)
                for c in fakes.FORMATS[row.ty]
            )
            assert re.fullmatch(shape + ("[0-9]" if row.ty == "CREDIT_CARD" else ""), row.token), row
        if row.ty == "CREDIT_CARD":
            assert luhn(row.token)
        if row.ty == "OTHER":
            assert row.token.startswith("[OTHER_")
        if row.ty.startswith("VEHICLE"):
            assert re.fullmatch(r"[A-Z]\d{3}[A-Z]{2}\d{2}", row.token)
    for ty in {r.ty for r in made}:
        tokens = [r.token for r in made if r.ty == ty]
        assert len(set(tokens)) == len(tokens), ty


def test_a_space_is_used_up_before_anything_else(spark):
    """A hundred cities: as many stand-ins, also where some are originals of the group."""
    from veilframe.operators.fake_tokens import faked

    schema = "group_id string, norm string, ty string, original string, n bigint"
    rows = [("g", f"v{i}", "RU_LOCATION", f"V{i}", i) for i in range(1, 101)]
    first = faked(spark.createDataFrame(rows, schema), "s").collect()
    cities = {r.token for r in first}
    assert len(cities) == 100 and not any(t.startswith("[") for t in cities)
    taken = sorted(cities)[:30]
    # Thirty of the values are originals now; the others still have seventy stand-ins of their own.
    rows = [("g", t.lower(), "RU_ORGANIZATION", t, i) for i, t in enumerate(taken, 1)]
    rows += [("g", f"v{i}", "RU_LOCATION", f"V{i}", i) for i in range(1, 81)]
    tokens = [r.token for r in faked(spark.createDataFrame(rows, schema), "s").collect() if r.ty == "RU_LOCATION"]
    assert len(set(tokens)) == 80
    assert {t for t in tokens if not t.startswith("[")} == cities - set(taken)


def test_small_spaces_overflow_into_other_tokens(spark):
    from veilframe.operators.fake_tokens import faked

    rows = [("g", f"city{i}", "RU_LOCATION", f"City{i}", i) for i in range(1, 301)]
    df = spark.createDataFrame(rows, "group_id string, norm string, ty string, original string, n bigint")
    tokens = [r.token for r in faked(df, "s").collect()]
    assert len(set(tokens)) == 300


def test_ordinals_over_wide_gaps(spark):
    seqs = [0, 1, 65535, 65536, 70000, 2**32, 2**32 + 5, 2**40]
    df = spark.createDataFrame([("g", s) for s in seqs] + [("h", 7)], "g string, s bigint")
    got = E.with_ordinals(df, ["g"], "s", []).where("g = 'g'").orderBy("s").collect()
    assert [r.n for r in got] == list(range(1, len(seqs) + 1))


def test_containment_against_brute_force(spark):
    needles = ["а", "аб", "абв", "1234", "12345", "б 1", "нет"]
    hays = ["абв 12345", "баба", "x1234y", "", "б 1" * 200]
    n = spark.createDataFrame([("s", x) for x in needles], "g string, needle string")
    h = spark.createDataFrame([("s", x) for x in hays], "g string, hay string")
    pairs = {(r.needle, r.hay) for r in contained_in(n, h, ["g"]).collect()}
    assert pairs == {(a, b) for a in needles for b in hays if a in b}
    texts = h.withColumnRenamed("hay", "text").withColumn("k", F.length("text"))
    got = {(r.needle, r.k, r.st) for r in occurrences(texts, n, ["g"]).collect()}
    assert got == {
        (a, len(b), i) for a in needles for b in hays for i in range(len(b)) if b.startswith(a, i)
    }


def test_case_forms_of_a_person(spark):
    people = spark.createDataFrame(
        [("g", "белову ивану", "Белову Ивану", "Орлов Денис")],
        "group_id string, norm string, original string, token string",
    )
    rows = case_forms(people, pool_forms(spark)).collect()
    whole = {r.case: (r.token, r.original) for r in rows if not r.words}
    assert whole["datv"] == ("Орлову Денису", "Белову Ивану")
    assert whole["nomn"] == ("Орлов Денис", "Белов Иван")
    assert ("Орловым", "Беловым") in {(r.token, r.original) for r in rows if r.words}


def test_session_table_expires(spark, tmp_path):
    path = str(tmp_path / "sessions")
    used = spark.createDataFrame(
        [("a", "<X_1>", "secret", "2024-01-01 01:00:00"), ("b", "<X_1>", "other", "2024-01-02 01:00:00"),
         ("c", "<X_1>", "third", "2024-01-02 23:00:00")],
        "id string, token string, original string, at string",
    )
    rows = sessions.new_sessions(
        used, ["id", "at"], "k", session_id=F.col("id"), created_at=F.col("at").cast("timestamp")
    )
    sessions.append_sessions(rows, path)
    table = sessions.read_sessions(spark, path)
    assert b"secret" not in bytes(table.where("session_id = 'a'").first().entity_map_enc)
    assert {r.original for r in sessions.tokens_of(table, "k").collect()} == {"secret", "other", "third"}
    assert sessions.tokens_of(table, "wrong").count() == 0
    now = F.lit("2024-01-03 12:00:00").cast("timestamp")
    left = sessions.expire(spark, path, now, 24)
    assert [r.session_id for r in left.collect()] == ["c"]


def test_a_repeated_batch_of_a_stream_writes_once(spark, tmp_path):
    """Masked texts, entities, sessions and audit lines are the same after a batch was played again."""
    from veilframe.sources.sinks import read_batches, write_batch
    from veilframe.streaming.jobs import mask_batches

    out = str(tmp_path)
    work = mask_batches(f"{out}/t", lang="ru", secret="s", sessions=f"{out}/s", audits=f"{out}/a")
    first, second = frame(spark), frame(spark).withColumn("doc_seq", F.col("doc_seq") + 100)

    def written():
        made = read_batches(spark, f"{out}/s", sessions.SCHEMA).select("session_id", "entities_count")
        lines = read_batches(spark, f"{out}/a", "token string, original_text_preview string", "json")
        texts = spark.read.parquet(f"{out}/t/masked").select("doc_seq", "masked_text")
        return [sorted(map(tuple, df.collect())) for df in (made, lines, texts)]

    work(first, 0)
    work(second, 1)
    once = written()
    work(second, 1)
    assert written() == once and all(once)
    # A batch without its mark was not written to its end.
    write_batch(first.select("doc_seq"), f"{out}/s", "7")
    (tmp_path / "s" / "batch=7" / "_SUCCESS").unlink()
    assert written() == once


def test_sessions_beyond_their_time_are_not_known(spark):
    from veilframe.plans.files import Sess

    used = spark.createDataFrame([("a", "<X_1>", "one", 1), ("b", "<X_1>", "two", 30)], "id string, token string, original string, age int")
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    rows = Sess.new_sessions(used, ["id", "age"], "k", session_id=F.col("id"), created_at=now - F.make_dt_interval(hours=F.col("age")))
    texts = spark.createDataFrame([(1, "a", "<X_1>"), (2, "b", "<X_1>"), (3, "a, b", "<X_1>")], "n int, ids string, text string")
    back = jobs.restore(texts, "text", "ids", rows, "k", ["n"], now=now)
    assert {r.n: (r.restored_text, r.status) for r in back.collect()} == {1: ("one", 200), 2: ("<X_1>", 404), 3: ("one", 200)}
    every = jobs.restore(texts, "text", "ids", rows, "k", ["n"], ttl_hours=None)
    assert {r.n: r.restored_text for r in every.collect()} == {1: "one", 2: "two", 3: "two"}
