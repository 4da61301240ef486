"""Conversations as formatted text, tokens and a loss mask aligned by offsets.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts every ``<|``
gets a backslash between its signs, and one more if there are some already, so no
text can form a control string, and taking one backslash away gives the text back.
A newline or backslash of a role is written as an escape as well.

Turns are rendered in blocks of consecutive turns of one conversation, so that no
task holds a long conversation. A block is encoded once with offsets. Control
strings are tokens of their own and no token reaches over one, so the tokens of
the blocks in a row are those of the whole conversation. Sorted spans of turns
and tokens are intersected by binary search: a token belongs to the loss if it
shares a character with an answer, and the share is kept with it.

Edge cases: null roles and texts are empty; null conv_ids are one conversation;
a null turn comes first, equal turns go by role and text; a repeated row is a
turn of its own; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK_TURNS = 64
# Characters of blocks that are given out together, and rows that are taken in together.
GIVEN_OUT, TAKEN = 256 * 1024, 256
LEARNED = ("assistant",)

RENDERED = (
    "conv_id {id}, block long, formatted string, token_ids array<int>, token_ends array<int>, "
    "loss array<struct<token:int,start:int,end:int>>"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]], learned) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of the texts that are learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role in learned and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text."""
    turns = []
    for piece in formatted.split(OPEN)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((unescape_role(role), unescape(rest[: rest.rindex(CLOSE)])))
    return turns


def intersect(spans, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of token, start, end: each token's share of each span, both in order.

    Several tokens may lie within one character; the first of them has it.
    """
    if not len(starts) or not len(spans):
        return np.zeros((0, 3), dtype=np.int64)
    # What tokens before have covered is not covered again.
    clear = np.maximum(starts, np.r_[0, np.maximum.accumulate(ends)[:-1]])
    a, b = np.array(spans, dtype=np.int64).T
    low = np.searchsorted(ends, a, side="right")
    count = np.maximum(np.searchsorted(starts, b, side="left") - low, 0)
    a, b = np.repeat(a, count), np.repeat(b, count)
    t = np.arange(count.sum()) + np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count)
    begin = np.maximum(a, clear[t])
    return np.stack([t, begin, np.maximum(np.minimum(b, ends[t]), begin)], axis=1)


def encoder(spec: str):
    """The tokenizer with the control strings as tokens and offsets of whole tokens."""
    from tokenizers import AddedToken, Tokenizer, processors

    tok = Tokenizer.from_str(spec)
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    tok.add_special_tokens([AddedToken(s, normalized=False, special=True) for s in (OPEN, CLOSE)])
    return tok


def _rows(batches):
    """The rows of all batches, of which a few at a time are Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, TAKEN):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, TAKEN).columns], strict=True)


def _offsets(arrays) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())


def list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(arrays) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(arrays), pa.array(np.concatenate(arrays)))


def format_conversations(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned: tuple[str, ...] = LEARNED,
    tokenizer: str = TOKENIZER,
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """One row per block of turns: conv_id, block, formatted, token_ids, token_ends, loss.

    ``loss`` lists the learned tokens with their share of an answer in the block's
    characters. The tokenizer file is read on the driver and goes out by broadcast.
    """
    spark = turns.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.floor(F.col(turn) / block_turns).cast("long").alias("block"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        tok = encoder(spec.value)

        def done(key, held):
            formatted, spans = render(held, learned)
            coded = tok.encode(formatted, add_special_tokens=False)
            offsets = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)
            loss = intersect(spans, offsets[:, 0], offsets[:, 1])
            return (*key, formatted, np.array(coded.ids, dtype=np.int32), offsets[:, 1].astype(np.int32), loss)

        def blocks():
            key, held = None, []
            for c, b, _, r, t in _rows(batches):
                if key != (c, b):
                    if held:
                        yield done(key, held)
                    key, held = (c, b), []
                held.append((r, t))
            if held:
                yield done(key, held)

        def batch_of(done):
            ids, blocks, texts, codes, ends, shares = zip(*done, strict=True)
            loss = np.concatenate(shares).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in loss.T], ["token", "start", "end"])
            columns = [
                pa.array(ids, ID_KINDS.get(kind, pa.string())), pa.array(blocks, pa.int64()), pa.array(texts, pa.string()),
                _lists(codes), _lists(ends), pa.ListArray.from_arrays(_offsets(shares), struct),
            ]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "formatted", "token_ids", "token_ends", "loss"])

        held, size = [], 0
        for row in blocks():
            held.append(row)
            size += len(row[2])
            if size >= GIVEN_OUT:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return (
        rows.repartition("conv_id", "block")
        .sortWithinPartitions("conv_id", "block", "turn", "role", "text")
        .mapInArrow(run, RENDERED.format(id=kind))
    )


ID_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def digests(blocks: DataFrame) -> DataFrame:
    """What the formatted blocks say, read back, one row per conversation.

    Blocks of a conversation pass in order through running digests; a conversation
    is never held as a whole.
    """
    kind = blocks.schema["conv_id"].dataType.simpleString()
    names = [
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
        "formatted_chars", "n_tokens", "n_loss_tokens",
    ]

    def read_back(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TAKEN):
                yield read(batch.slice(at, TAKEN))

    def read(batch):
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        turns, loss, count, chars, learned = [], [], [], [], []
        shares = cols["loss"].flatten()
        token, start, end = (shares.field(i).to_numpy() for i in range(3))
        at = 0
        for formatted, n in zip(cols["formatted"].to_pylist(), list_sizes(cols["loss"]).tolist(), strict=True):
            parsed = parse(formatted)
            turns.append("".join(f"{r}\n{t}\n" for r, t in parsed))
            count.append(len(parsed))
            a, b = start[at : at + n], end[at : at + n]
            # Shares that touch are one answer; no answer touches the next.
            cut = np.flatnonzero(a[1:] != b[:-1]) + 1
            first, last = a[np.r_[0, cut]] if n else a, b[np.r_[cut - 1, n - 1]] if n else b
            loss.append("".join(unescape(formatted[x:y]) for x, y in zip(first.tolist(), last.tolist(), strict=True)))
            chars.append(len(formatted))
            learned.append(len(np.unique(token[at : at + n])))
            at += n
        said = [turns, loss, count, chars, list_sizes(cols["token_ids"]), learned]
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(said, kinds, strict=True)]],
            ["conv_id", "block", "turns", "loss", "n", "chars", "tokens", "learned"],
        )

    def sums(batches):
        def row(key, s):
            values = (key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), *s[4:])
            kinds = [ID_KINDS.get(kind, pa.string()), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names
            )

        key, state = None, None
        for c, _, turns, loss, n, chars, tokens, learned in _rows(batches):
            if state is None or c != key:
                if state is not None:
                    yield row(key, state)
                key, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            state[0] += n
            state[1].update(turns.encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += chars
            state[5] += tokens
            state[6] += learned
        if state is not None:
            yield row(key, state)

    return (
        blocks.select("conv_id", "block", "formatted", "token_ids", "loss")
        .mapInArrow(
            read_back,
            f"conv_id {kind}, block long, turns string, loss string, n long, chars long, tokens long, learned long",
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "block")
        .mapInArrow(
            sums,
            f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
            "formatted_chars long, n_tokens long, n_loss_tokens long",
        )
    )
