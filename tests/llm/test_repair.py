"""Conversation repair against trying every edit."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from veilframe.llm import repair
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WHITE = re.compile("[^\x20\x09-\x0d]")
ROLES = {"u": "user", "a": "assistant"}


def faults(rows):
    """b, d, t or . for each (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        shown = WHITE.findall(text)
        if not shown:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("." if shown[-1] in ".!?" else "t")
        seen.add((role, text))
    return "".join(out)


def cheapest(rows, found):
    """(cost, audit, repaired rows) over all ways, kept per number of rows and last role."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {(0, ""): (0, "", ())}

    def offer(where, way):
        if where not in best or way[:2] < best[where][:2]:
            best[where] = way
            return True
        return False

    for i in range(len(rows) + 1):
        for _ in range(8):
            for q in list(follow):
                if (i, q) in best:
                    cost, audit, out = best[i, q]
                    for r in follow[q].replace("s", ""):
                        offer((i, r), (cost + 2, audit + "I", (*out, (ROLES[r], ""))))
        if i == len(rows):
            break
        role, text = rows[i]
        for q in follow:
            if (i, q) not in best:
                continue
            cost, audit, out = best[i, q]
            offer((i + 1, q), (cost + 3, audit + "D", out))
            if found[i] in "bd":
                continue
            more = found[i] == "t"
            for r in follow[q]:
                if role[:1] == r:
                    offer((i + 1, r), (cost + more, audit + "K", (*out, (role, text))))
                if r != "s":
                    offer((i + 1, r), (cost + 2 + more, audit + "R", (*out, (ROLES[r], text))))
    return min((best[len(rows), q] for q in ("", "a") if (len(rows), q) in best), key=lambda w: w[:2])


def sha(rows) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def expected(table):
    """What the contract says of rows (conv_id, turn, role, text)."""
    said = lambda v: " " if v is None else v
    talks = {}
    for conv, turn, role, text in table:
        rows = talks.setdefault(conv, [])
        way = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        rows += [(turn, "user" if way == 4 else role, text)] * (1 + (way == 3))
    out = {}
    for conv, rows in talks.items():
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
        rows = sorted(rows, key=key)
        turns = {t for t, _, _ in rows if t is not None}
        plain = [r[1:] for r in rows]
        found = faults(plain)
        roles = [r[:1] for r, _ in plain]
        cost, audit, done = cheapest(plain, found)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            found.count("b"),
            found.count("d"),
            found.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),  # noqa: B905
            cost,
            audit,
            sha(done),
        )
    return out


def found(df):
    rows = df.collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    out = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_plain_python(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert found(QUERIES["op12_repair"](spark, SF)) == expected(rows)


def tried(flaws, initials):
    """The lightest of all strings of edits up to a length, by playing each."""
    best = None
    for n in range(len(flaws), 2 * len(flaws) + 3):
        for audit in product("DIKR", repeat=n):
            if sum(e != "I" for e in audit) != len(flaws):
                continue
            cost, i, given = 0, 0, ""
            for e in audit:
                turn = "a" if given[-1:] == "u" else "u"
                if e in "KR" and flaws[i] in "bd":
                    break
                given += initials[i] if e == "K" else turn if e in "RI" else ""
                cost += {"K": 0, "R": 2, "D": 3, "I": 2}[e] + (e in "KR" and flaws[i] == "t")
                i += e != "I"
            else:
                if re.fullmatch("(s?(ua)+)?", given):
                    best = min(best or (99, ""), (cost, "".join(audit)))
    return best


@pytest.mark.parametrize("seed", range(40))
def test_agenda_against_every_string_of_edits(seed):
    dice = random.Random(seed)
    n = dice.randint(0, 3)
    flaws = "".join(dice.choice("..td") for _ in range(n))
    initials = "".join(dice.choice("suax") for _ in range(n))
    ends = [(w["cost"], w["audit"]) for w in repair.ways(flaws, initials, "e") if w["q1"] in "ea"]
    assert min(ends) == tried(flaws, initials)


@pytest.mark.parametrize("seed", range(60))
def test_blocks_give_what_the_whole_gives(seed):
    dice = random.Random(seed)
    n = dice.randint(1, 60)
    kinds = dice.choice(["....t", "bd.", "dddd.", ".t", "b"])
    flaws = "".join(dice.choice(kinds) for _ in range(n))
    initials = "".join(dice.choice(dice.choice(["uas", "u", "s", "ua", "xu"])) for _ in range(n))
    whole = min((w["cost"], w["audit"]) for w in repair.ways(flaws, initials, "e") if w["q1"] in "ea")
    talk = repair._Conversation("k")
    told, at, b = [], 0, 0
    while at < n:
        size = dice.randint(1, 7)
        part = (flaws[at : at + size], initials[at : at + size])
        told += talk.add(0, b, *part, repair.ways(*part, repair.STATES))
        at, b = at + size, b + 1
    *rest, sums = talk.end()
    assert (sums["cost"], sums["audit"]) == whole
    assert "".join(d["audit"] for d in told + rest) == whole[1]
    assert [d["block"] for d in told + rest] == list(range(b))


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello"), (1, 2, "assistant", "Hello"),
    (1, 9, "tool", "x."), (2, None, None, None), (2, None, "user", "a."), (2, None, "user", "a."), (None, 3, "", "b!"),
    (None, 3, "", "b!"), (None, None, "assistant", "  \n"), (3, 0, "user", ""), (4, 5, "user", "é. "),
]


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, key string, part int, block int"
    assert repair.report(spark.createDataFrame([], schema)).count() == 0
    rows = ROWS + [(100 + i, t, r, "Yes.") for i in range(60) for t, r in enumerate(("user", "assistant"))]
    table = spark.createDataFrame([(*r, "k", 1, 1) for r in rows], schema)
    assert found(repair.report(table)) == expected(rows)


@pytest.mark.parametrize("partitions", [1, 13])
def test_a_conversation_over_many_blocks(spark, partitions):
    """One conversation of 3,000 rows beside others, cut into blocks and ranges."""
    dice = random.Random(5)
    rows = [(7, t // 2, dice.choice(["user", "assistant", "assistant", "x"]), dice.choice(["a.", "b", f"{t}!", " "])) for t in range(3_000)]
    rows += [(8, t, "user", "same.") for t in range(300)] + [(i, 0, "user", "q?") for i in range(20, 60)]
    rows += [(9, t, "user", " ") for t in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert found(repair.report(table)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.mark.parametrize("kind", ["decimal(20,0)", "smallint", "string"])
def test_ids_of_any_type(spark, kind):
    table = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = repair.report(table.selectExpr(f"cast(conv_id AS {kind}) conv_id", "turn", "role", "text")).collect()
    assert {None if r.conv_id is None else int(r.conv_id): r.audit for r in got} == {c: w[6] for c, w in expected(ROWS).items()}
