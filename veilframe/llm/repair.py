"""Conversation repair: the cheapest edits after which turns alternate as they should.

A repair is a weighted deduction. The item (i, q) says that the rows before i are dealt with
and that the roles given so far leave the pattern ``(s?(ua)+)?`` in state q. An edit deduces
the next item; what it costs is added and its initial is appended, so (cost, audit) never
falls, and items that lead on equally keep their order: the functions are superior and
monotone. Knuth's agenda then pops items lightest first, each final when popped, until the
goal is.

Conversations may be of any length. Their rows are ordered over the cluster and cut into
blocks; an agenda in each block deduces ``q0 -> q1`` for all states, in parallel, and a
second one joins these to the items of the whole conversation, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import drop_path, fresh_path, staged

# States: nothing given yet, after the system turn, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = "e", "s", "u", "a"
STATES = EMPTY + SYSTEM + USER + ASSISTANT
ENDS = EMPTY + ASSISTANT
# Which role may follow.
NEXT = {EMPTY: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLE = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
# BEHIND[p][q]: from p, all that is left to do costs at most this more than from q.
BEHIND = {
    EMPTY: {SYSTEM: 0, USER: 2, ASSISTANT: 0},
    SYSTEM: {EMPTY: 4, USER: 2, ASSISTANT: 4},
    USER: {EMPTY: 5, SYSTEM: 2, ASSISTANT: 2},
    ASSISTANT: {EMPTY: 3, SYSTEM: 0, USER: 2},
}
# Faults of a row, the first that holds.
FINE, BLANK, DUPLICATE, TRUNCATED = ".", "b", "d", "t"
WHITE = " \t\n\x0b\x0c\r"
BLOCK_ROWS = 64
BLOCK_CHARS = 1 << 20

Light = tuple[int, str]


def lightest(
    axioms: Iterable[tuple[int, str, object]],
    deduce: Callable[[object], Iterable[tuple[int, str, object]]],
    goals: set,
) -> dict[object, Light]:
    """(cost, audit) of the lightest derivation of every goal that has one.

    ``deduce`` gives what an item leads to: cost to add, audit to append, the new item.
    """
    agenda = list(axioms)
    heapify(agenda)
    final: dict[object, Light] = {}
    left = set(goals)
    while agenda and left:
        cost, audit, item = heappop(agenda)
        if item in final:
            continue
        final[item] = cost, audit
        left.discard(item)
        for more, edit, new in deduce(item):
            if new not in final:
                heappush(agenda, (cost + more, audit + edit, new))
    return {g: final[g] for g in goals if g in final}


def edits(faults: str, initials: str) -> Callable[[tuple[int, str]], Iterator[tuple[int, str, tuple[int, str]]]]:
    """The deductions over some rows, known by their faults and the initials of their roles."""

    def deduce(item):
        i, q = item
        for r in NEXT[q]:
            if r != SYSTEM:
                yield COST[INSERT], INSERT, (i, r)
        if i == len(faults):
            return
        yield COST[DELETE], DELETE, (i + 1, q)
        if faults[i] in (BLANK, DUPLICATE):
            return
        extra = TRUNCATED_COST * (faults[i] == TRUNCATED)
        for r in NEXT[q]:
            if r == initials[i]:
                yield COST[KEEP] + extra, KEEP, (i + 1, r)
            if r != SYSTEM:
                yield COST[REROLE] + extra, REROLE, (i + 1, r)

    return deduce


def ways(faults: str, initials: str, entries: str) -> list[dict]:
    """The lightest way through some rows from each of the entry states to each state."""
    n, deduce = len(faults), edits(faults, initials)
    return [
        {"q0": q0, "q1": q1, "cost": cost, "audit": audit}
        for q0 in entries
        for (_, q1), (cost, audit) in lightest([(0, "", (0, q0))], deduce, {(n, q) for q in STATES}).items()
    ]


def apply(rows: list[tuple[str, str]], state: str, audit: str) -> list[tuple[str, str, str]]:
    """The rows (role, text, edit) that the edits give, and nothing for deleted ones."""
    out, i = [], 0
    for edit in audit:
        if edit == DELETE:
            i += 1
            continue
        if edit == KEEP:
            state = rows[i][0][0]
            out.append((*rows[i], edit))
        else:
            state = next(r for r in NEXT[state] if r != SYSTEM)
            out.append((ROLE[state], "" if edit == INSERT else rows[i][1], edit))
        i += edit != INSERT
    return out


# --- rows to blocks ------------------------------------------------------------------

BLOCK = (
    "key string, part int, block long, faults string, initials string, rows array<struct<role:string,text:string>>, "
    "ways array<struct<q0:string,q1:string,cost:long,audit:string>>"
)
_BLOCK = pa.schema(
    [
        ("key", pa.string()),
        ("part", pa.int32()),
        ("block", pa.int64()),
        ("faults", pa.string()),
        ("initials", pa.string()),
        ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
        (
            "ways",
            pa.list_(pa.struct([("q0", pa.string()), ("q1", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])),
        ),
    ]
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted rows of one range, and the ways through each."""
    key, rows, faults, initials, chars, n, entries = None, [], [], [], 0, 0, STATES
    part = 0

    def closed():
        f, r = "".join(faults), "".join(initials)
        block = {"key": key, "part": part, "block": n, "faults": f, "initials": r}
        return block | {"rows": [{"role": a, "text": b} for a, b in rows], "ways": ways(f, r, entries)}

    for batch in batches:
        done, size = [], 0
        for new, at, role, text, fault in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if rows and (new != key or len(rows) == BLOCK_ROWS or chars > BLOCK_CHARS):
                done.append(closed())
                size += chars
                # A conversation that begins inside the range enters its first block empty.
                entries = EMPTY if new != key else STATES
                rows, faults, initials, chars, n = [], [], [], 0, n + 1
                if size > BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist(done, _BLOCK)
                    done, size = [], 0
            key, part = new, at
            rows.append((role, text))
            faults.append(fault)
            initials.append(role[:1] or " ")
            chars += len(text)
        if done:
            yield pa.RecordBatch.from_pylist(done, _BLOCK)
    if rows:
        yield pa.RecordBatch.from_pylist([closed()], _BLOCK)


def blocks(turns: DataFrame) -> DataFrame:
    """Blocks of conversations from rows of ``key`` (not null), ``turn``, ``role`` and ``text``.

    Rows of a conversation go by turn, none first; those of one turn by role, then by the
    MD5 of the text. A conversation may lie in several ranges, so none is too long for a task.
    """
    spark = turns.sparkSession
    path = fresh_path(spark, "turns")
    numbered = turns.select("key", "turn", "role", "text", F.monotonically_increasing_id().alias("row"))
    numbered.write.parquet(path)
    rows = spark.read.schema(numbered.schema).parquet(path).withColumn("digest", F.md5("text"))
    same, place = ["key", "role", "digest"], F.struct("turn", "row")
    firsts = rows.groupBy(*same).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(firsts.select(*same, "first"), same, "left")
    end = F.rtrim("text", F.lit(WHITE))
    fault = (
        F.when(end == "", BLANK)
        .when(F.col("first").isNotNull() & (place > F.col("first")), DUPLICATE)
        .when(~end.rlike(r"[.!?]\z"), TRUNCATED)
        .otherwise(FINE)
    )
    order = ["key", "turn", "role", "digest", "row"]
    ranged = rows.select(*order, "text", fault.alias("fault")).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = ranged.select("key", F.spark_partition_id().alias("part"), "role", "text", "fault").mapInArrow(_blocks, BLOCK)
    found = staged(cut, "blocks")
    drop_path(spark, path)
    return found


# --- blocks to conversations ---------------------------------------------------------

DECIDED = (
    "key string, part int, block long, state string, audit string, cost long, illegal long, "
    "blank long, duplicate long, truncated long"
)
_DECIDED = pa.schema(
    [("key", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("state", pa.string()), ("audit", pa.string())]
    + [(c, pa.int64()) for c in ("cost", "illegal", "blank", "duplicate", "truncated")]
)
LEGAL = {"su", "ua", "au"}


class _Conversation:
    """The lightest ways through the blocks of one conversation so far.

    ``live`` has for each state the cost, the audit since the last decided block, and the
    (entry state, audit) of every block not yet decided. A block is decided once all live
    ways agree on it, so few blocks are held, however long the conversation is.
    """

    def __init__(self, key: str):
        self.key = key
        self.live: dict[str, tuple[int, str, tuple]] = {EMPTY: (0, "", ())}
        self.open: list[tuple[int, int]] = []
        self.audit: list[str] = []
        self.count = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.illegal, self.last = 0, ""

    def add(self, part: int, block: int, faults: str, initials: str, through: list[dict]) -> list[dict]:
        for f in self.count:
            self.count[f] += faults.count(f)
        roles = self.last + initials
        self.illegal += sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1))
        self.last = roles[-1]
        best: dict[str, tuple] = {}
        begun = [(cost, audit, ("in", q)) for q, (cost, audit, _) in self.live.items()]
        leads = {q: [w for w in through if w["q0"] == q] for q in STATES}

        def deduce(item):
            kind, q = item[:2]
            if kind == "in":
                return [(w["cost"], w["audit"], ("by", w["q1"], q, w["audit"])) for w in leads[q]]
            if kind == "by":
                # The antecedents of an item are kept with it, to be told once it is final.
                best.setdefault(q, item[2:])
                return [(0, "", ("out", q))]
            return []

        out = lightest(begun, deduce, {("out", q) for q in STATES})
        self.open.append((part, block))
        self.live = {
            q: (cost, audit, (*self.live[best[q][0]][2], best[q])) for (_, q), (cost, audit) in out.items()
        }
        dear = {q for q in self.live for p in self.live if p != q and self.live[q][0] > self.live[p][0] + BEHIND[p][q]}
        for q in dear:
            del self.live[q]
        return self._decide()

    def _decide(self) -> list[dict]:
        decided = []
        while self.open and len({way[0] for _, _, way in self.live.values()}) == 1:
            state, audit = next(iter(self.live.values()))[2][0]
            part, block = self.open.pop(0)
            decided.append({"key": self.key, "part": part, "block": block, "state": state, "audit": audit})
            self.audit.append(audit)
            self.live = {q: (cost, tail[len(audit) :], way[1:]) for q, (cost, tail, way) in self.live.items()}
        return decided

    def end(self) -> list[dict]:
        """The goal: the lightest of the states in which a conversation may end, and what was decided."""
        goal = min((self.live[q][:2], q) for q in ENDS if q in self.live)[1]
        self.live = {goal: self.live[goal]}
        decided = self._decide()
        whole = {"key": self.key, "audit": "".join(self.audit), "cost": self.live[goal][0], "illegal": self.illegal}
        faults = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": TRUNCATED}
        return [*decided, whole | {name: self.count[f] for name, f in faults.items()}]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    talk = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if talk is None or talk.key != row["key"]:
                out += talk.end() if talk else []
                talk = _Conversation(row["key"])
            out += talk.add(row["part"], row["block"], row["faults"], row["initials"], row["ways"])
        if out:
            yield pa.RecordBatch.from_pylist(out, _DECIDED)
    if talk:
        yield pa.RecordBatch.from_pylist(talk.end(), _DECIDED)


def decisions(cut: DataFrame) -> DataFrame:
    """For each block its entry state and audit; for each conversation, with a null block, its sums.

    Blocks without texts move: some bytes for each row. Those of one conversation come to
    one task in order, since an audit is one value, but are not held there.
    """
    light = cut.select("key", "part", "block", "faults", "initials", "ways")
    ordered = light.repartition("key").sortWithinPartitions("key", "part", "block")
    return staged(ordered.mapInArrow(_decide, DECIDED), "decisions")


TURNS = "key string, part int, block long, turns array<struct<role:string,text:string,edit:string>>"
_TURNS = pa.schema(
    [
        ("key", pa.string()),
        ("part", pa.int32()),
        ("block", pa.int64()),
        ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))),
    ]
)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            turns = apply([(r["role"], r["text"]) for r in row["rows"]], row["state"], row["audit"])
            turns = [dict(zip(("role", "text", "edit"), t, strict=True)) for t in turns]
            out = {"key": row["key"], "part": row["part"], "block": row["block"], "turns": turns}
            yield pa.RecordBatch.from_pylist([out], _TURNS)


def repaired(cut: DataFrame, decided: DataFrame) -> DataFrame:
    """key, part, block, turns: the turns of the repaired conversations, block by block."""
    own = decided.where("block IS NOT NULL").select("key", "part", "block", "state", "audit")
    met = cut.select("key", "part", "block", "rows").join(own, ["key", "part", "block"])
    return met.mapInArrow(_apply, TURNS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, running, begun = None, None, False
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if running is None or row["key"] != key:
                if running:
                    out.append({"key": key, "repaired_sha256": running.hexdigest()})
                key, running, begun = row["key"], hashlib.sha256(), False
            for t in row["turns"]:
                running.update(f"{chr(10) * begun}{t['role']}:{t['text']}".encode())
                begun = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if running:
        yield pa.RecordBatch.from_pylist([{"key": key, "repaired_sha256": running.hexdigest()}], schema)


def digests(turns: DataFrame) -> DataFrame:
    """key, repaired_sha256. A digest runs over the blocks of a conversation in order, so they
    pass through one task, one block at a time."""
    ordered = turns.repartition("key").sortWithinPartitions("key", "part", "block")
    return ordered.mapInArrow(_digest, "key string, repaired_sha256 string")


# --- the query -----------------------------------------------------------------------


def key_of(conv: Column) -> Column:
    """A conversation's id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def damaged(rows: DataFrame) -> DataFrame:
    """key, turn, role, text of the rows that are left; null values are one space.

    The CRC-32 of ``conv_id:turn`` modulo 20 says what happens to a row: 0 drops it, 1 empties
    its text, 2 takes out ``. ! ?``, 3 repeats it, 4 makes it a user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.where(way != 0).select(
        key_of(F.col("conv_id")).alias("key"),
        "turn",
        F.when(way == 4, "user").otherwise(said("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(way == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def gaps(turns: DataFrame) -> DataFrame:
    """key, gaps: turn numbers that are missing between the smallest and the largest."""
    each = turns.groupBy("key", "turn").agg(F.lit(1).alias("one"))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return each.groupBy("key").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows, as the query op12 returns them.

    Nulls are one space, except that a null turn comes first and no gap is counted for it;
    rows without a conversation id are one conversation. A role's initial is its first
    character; an empty role, or one that begins otherwise than s, u or a, must be changed
    or deleted. Rows that are there several times are duplicates of the first. A
    conversation of which nothing is left has zeros. No rows: no conversations. Other
    columns of rows are not looked at.
    """
    left = damaged(rows.select("conv_id", "turn", "role", "text"))
    cut = blocks(left)
    decided = decisions(cut)
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [
        rows.select(key_of(F.col("conv_id")).alias("key"), F.col("conv_id").alias("id")).dropDuplicates(["key"]),
        gaps(left),
        decided.where("block IS NULL").select("key", *sums[1:], "audit"),
        digests(repaired(cut, decided)),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.join(part, "key", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return whole.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
