"""Steps whose cost must not grow faster than their rows."""

import pandas as pd
from pyspark.sql import functions as F

from veilframe import shared
from veilframe.functions import fakes
from veilframe.functions import text as T
from veilframe.operators import contain
from veilframe.operators import detect as D
from veilframe.operators import patterns as P
from veilframe.plans import jobs
from veilframe.plans import queries as Q
from veilframe.sources import containers


class _Stopped(Exception):
    pass


def test_stand_ins_search_texts_once_in_many_tasks(spark, tmp_path, monkeypatch):
    """one small file of customers is dealt out, and its values are written before they are numbered."""
    rows = spark.range(20).selectExpr("id as c_custkey", "cast(id % 3 as int) as c_nationkey", "concat('Customer#', id) as c_name")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    written = []

    def seen(df, label, *args, **options):
        written.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        raise _Stopped

    monkeypatch.setattr(Q, "staged", seen)
    try:
        Q.fake_tokens(spark, str(tmp_path))
    except _Stopped:
        pass
    label, plan = written[0]
    assert label == "first" and "Repartition" in plan and "Window" not in plan


def test_short_walks_reach_every_place(spark):
    """legs of a walk give each value of a small space to one ordinal, as one long walk did."""
    _, size = fakes.WORDED["RU_LOCATION"]
    frame = spark.range(1, size + 2).selectExpr("'g' as group_id", "cast(id as string) as norm", "'RU_LOCATION' as ty", "id as n", "'x' as original")
    made = [r.token for r in fakes.stand_ins(frame, "s").orderBy("n").collect()]
    assert fakes.WALK % fakes.LEG == 0 and made[-1] is None and len(set(made[:-1])) == size


def test_small_containers_share_a_table(monkeypatch):
    """units of small files are given out together, those of large ones at once."""
    files = pd.DataFrame({"path": [f"/in/{i}.txt" for i in range(5)], "content": [b"text"] * 5})
    tables = list(containers._read(iter([files])))
    assert len(tables) == 1 and list(tables[0]["path"]) == list(files["path"]) and set(tables[0]["unit_no"]) == {0}
    monkeypatch.setattr(containers, "GIVEN_OUT", 7)
    assert [len(t) for t in containers._read(iter([files]))] == [2, 2, 1]
    assert list(containers._read(iter([files[:0]]))) == []


def test_changes_of_long_rows_are_a_set(spark):
    """pairs of a row are not compared with all before them; repeated strings count once."""
    rows = spark.createDataFrame([("g", 1)], "group_id string, doc_seq bigint")
    units = spark.range(300).selectExpr("'g' as group_id", "1L as doc_seq", "cast(id % 100 as string) as text", "concat('m', id % 100) as new")
    done = jobs._with_changes(rows, units, "new")
    assert "array_distinct" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert done.select(F.explode("changes")).count() == 100
    assert done.first()["changes"]["7"] == "m7"


def test_small_tables_are_spread_before_their_texts_are_searched(spark, tmp_path):
    """texts of one small file are searched by more than one task."""
    spark.range(20).selectExpr(
        "id as c_custkey", "cast(id % 3 as int) as c_nationkey", "concat('Customer#', lpad(id, 9, '0')) as c_name"
    ).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spans = Q.overlaps_resolved(spark, str(tmp_path))
    assert "Repartition" in spans._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_seq for r in spans.where("ty = 'PHONE_RU'").collect()} == set(range(20))


def test_inputs_of_unknown_size_are_spread(spark):
    """Texts are dealt out whatever their files, batches of streams too."""
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(1, "a")], 1), "k int, text string")
    assert "Repartition" in shared.spread(rows)._jdf.queryExecution().optimizedPlan().toString()
    stream = spark.readStream.format("rate").load()
    assert "Repartition" in shared.spread(stream)._jdf.queryExecution().logical().toString()


def test_shapes_know_what_patterns_match(spark):
    """The shape of a text shows each digit and letter that a pattern takes, and no space."""
    codes = spark.range(1, 0x110000).where("id not between 55296 and 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'utf-32') as c")
    folded = codes.selectExpr("c", f"{T.in_capitals('c')} as u")
    seen = folded.select("c", "u", F.expr(D._shape("u")).alias("f"))
    assert seen.where(r"c rlike r'(?iuU)\d' and f <> '0'").isEmpty()
    assert seen.where(r"c rlike r'(?iuU)[\s.()-]' and f <> ''").isEmpty()
    assert seen.where("c rlike '(?iuU)[A-ZАВЕКМНОРСТУХ]' and f <> 'A'").isEmpty()
    # A capital I with a dot is an I to a pattern only; the test for words has never taken it for one.
    letters = "".join(sorted(set("".join("".join(p.words) for p in P.RU + P.IN)) - set("04.-")))
    for letter in letters:
        assert seen.where(f"c rlike '(?iuU){letter}' and u <> '{letter}' and c <> '\u0130'").isEmpty(), letter


def test_needles_meet_few_places_of_texts(spark):
    """numbers that share their short grams are looked up by longer ones, each met by few."""
    needles = spark.range(20_000).selectExpr("'g' as g", "cast(7700000000 + id as string) as needle")
    keyed = contain._keyed(needles, ["g"])
    assert keyed.groupBy("gram").count().agg(F.max("count")).first()[0] <= 2 and keyed.count() == 20_000


def test_more_anchors_than_are_sent_at_once(spark, monkeypatch):
    """many needles are looked up in several passes, and no place is lost or found twice."""
    monkeypatch.setattr(contain, "BROADCAST_ANCHORS", 7)
    needles = spark.range(40).selectExpr("'g' as g", "concat('n', cast(id * 37 as string)) as needle")
    texts = spark.range(3).selectExpr("'g' as g", "id as k", "concat_ws(' ', transform(sequence(0, 39), i -> concat('n', i * 37))) as text")
    text = texts.first().text
    expected = sum(text.count(r.needle) for r in needles.collect())
    assert contain.occurrences(texts, needles, ["g"]).distinct().count() == 3 * expected


def test_restored_texts_are_written_before_they_are_read_twice(spark, monkeypatch):
    """The masking of the texts to restore is not done again for each time they are read."""
    written = []
    real = jobs.staged
    monkeypatch.setattr(jobs, "staged", lambda df, label, *a, **o: written.append(label) or real(df, label, *a, **o))
    texts = spark.createDataFrame([("g", 1, 0, "see <A_1>")], "group_id string, doc_seq long, unit_no int, text string")
    tokens = spark.createDataFrame([("g", "<A_1>", "Ann")], "group_id string, token string, original string")
    assert jobs.restore_group(texts, "text", tokens).first().restored_text == "see Ann" and written == ["replies"]


def test_xml_is_written_in_many_files(spark, tmp_path, monkeypatch):
    """one small file of customers becomes many files of XML, which many tasks read."""
    rows = spark.range(20).selectExpr("id as c_custkey", "cast(id % 3 as int) as c_nationkey", "concat('Customer#', id) as c_name")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    parts = []
    real = Q._written

    def seen(df, *args, **options):
        parts.append(df.rdd.getNumPartitions())
        return real(df, *args, **options)

    monkeypatch.setattr(Q, "_written", seen)
    assert Q.xml_masked(spark, str(tmp_path)).count() == 20
    assert parts[0] >= spark.sparkContext.defaultParallelism


def test_batches_of_a_stream_have_many_files(spark, monkeypatch, tmp_path):
    """a batch is read by many tasks."""
    monkeypatch.setattr(Q, "fresh_path", lambda s, label: f"{tmp_path}/{label}")
    Q._stream(spark, spark.range(1000).coalesce(1))
    assert len(list((tmp_path / "stream").glob("part-*"))) > spark.sparkContext.defaultParallelism


def test_spans_of_a_long_text_are_settled_in_stretches(spark):
    """many spans that overlap in pairs are compared inside short stretches only, with the result that all give."""
    import random

    from veilframe.functions import spans as S

    dice = random.Random(5)
    texts = []
    for n, gap in ((64, 5), (65, 3), (500, 4), (2000, 30), (2000, 2)):
        made = [(dice.randint(0, n * gap), dice.choice([1, 3, 9, 300 if dice.random() < 0.02 else 2]), dice.randint(0, 3)) for _ in range(n)]
        texts.append([(st, ln, pr, "T", 1.0, str(i)) for i, (st, ln, pr) in enumerate(made)])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {S.SPANS}")
    got = {r.i: [tuple(s) for s in r.k] for r in rows.select("i", F.expr(S.resolve_overlaps("x")).alias("k")).collect()}
    for i, spans in enumerate(texts):
        kept = []
        for s in sorted(spans, key=lambda s: (-s[1], s[0], s[2], s)):
            if all(max(s[0], k[0]) >= min(s[0] + s[1], k[0] + k[1]) for k in kept):
                kept.append(s)
        assert got[i] == sorted(kept)
    # The stretches: no fold over all spans but the one that few spans take.
    sql = S.resolve_overlaps("x")
    assert "cs[k + 1]" in sql and f"size(o) <= {S.PIECES}" in sql


def test_tokens_of_a_long_text_are_not_looked_up_one_by_one(spark):
    """spans get their tokens by their place, in texts of one part and of many."""
    notes = [f"тел +7 901 {i % 1000:03d}-{i // 1000:02d}-17, ИНН {7700000000 + i}" for i in range(5000)]
    rows = spark.createDataFrame([(1, "g", "\n".join(notes)), (2, "g", "; ".join(notes)), (3, "g", notes[7]), (4, "g", "ничего")], "doc_seq long, group_id string, text string")
    result = jobs.mask(rows, group="group_id", lang="ru")
    plan = result.masked._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at" not in plan and "map_from_entries" not in plan
    tokens = {r.original: r.token for r in result.entities.collect()}
    masked = {r.doc_seq: r for r in result.masked.collect()}
    one = [f"тел {tokens[n[4:20]]}, ИНН {tokens[n[26:]]}" for n in notes]
    assert masked[1].masked_text == "\n".join(one) and masked[2].masked_text == "; ".join(one) and masked[3].masked_text == one[7]
    assert (masked[1].map_size, masked[1].spans_found, masked[3].map_size, masked[4].map_size) == (10000, 10000, 2, 0)
    assert masked[4].masked_text == "ничего"


def test_strings_of_a_long_row_go_through_a_dictionary(spark, monkeypatch):
    """rows with many strings and changes give what the search of the map gives."""
    from veilframe.sources import leaves

    rows = spark.createDataFrame(
        [(1, ["a", "b", None, "a"], {"a": "x"}), (2, ["a"], None), (3, None, {"a": "x"}), (4, [], {}), (5, ["a", "c"], {"c": None})],
        "i int, s array<string>, m map<string,string>",
    )
    few = [tuple(r) for r in rows.select("i", leaves.put_in(F.col("s"), F.col("m")).alias("s")).orderBy("i").collect()]
    monkeypatch.setattr(leaves, "LOOKUPS", 0)
    many = [tuple(r) for r in rows.select("i", leaves.put_in(F.col("s"), F.col("m")).alias("s")).orderBy("i").collect()]
    assert few == many and few[0] == (1, ["x", "b", None, "x"]) and few[1] == (2, ["a"])


def test_stand_ins_of_known_formats_are_filled_without_a_search(spark):
    """Formats known beforehand are filled by arithmetic, with what the walk and the markers give in plain Python."""
    import hashlib
    import math

    digest = hashlib.sha256(b"fakes:s").hexdigest()

    def expected(group, ty, n, form):
        size = fakes._size_of(form)
        side = math.isqrt(size - 1) + 1
        left, right = divmod(n - 1, side)
        while True:
            for j in range(1, fakes.ROUNDS + 1):
                mixed = hashlib.sha256(f"{digest}:{j}:{group}:{ty}:{form}:{right}".encode()).hexdigest()[:15]
                left, right = right, (left + int(mixed, 16) % side) % side
            if left * side + right < size:
                break
        at, out = left * side + right, ""
        for c in reversed(form):
            chars = fakes.ALPHABETS.get(c)
            if chars:
                at, place = divmod(at, len(chars))
            out = (chars[place] if chars else c) + out
        return out

    formed = {**fakes.FORMATS, "INN_RU": fakes.BY_LENGTH["INN_RU"][0], "VEHICLE_STANDARD_IN": "~~ ## ~ ####"}
    formed.pop("CREDIT_CARD")
    rows = [
        ("g", "x", ty, n, "MH 12 A 1234" if ty.startswith("VEHICLE") else "1234567890")
        for ty, form in formed.items() for n in (1, 2, 77, 999_999, 10**18) if n <= fakes._size_of(form)
    ]
    made = fakes.stand_ins(spark.createDataFrame(rows, "group_id string, norm string, ty string, n long, original string"), "s")
    assert {(r.ty, r.n): r.token for r in made.collect()} == {(r[2], r[3]): expected("g", r[2], r[3], formed[r[2]]) for r in rows}
    phone = fakes._filled_in(fakes.FORMATS["PHONE_RU"])
    assert "aggregate" not in phone and "lpad" in phone
