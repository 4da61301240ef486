"""Documents whose word shingles overlap: an exact Jaccard self-join.

A document's set is its distinct shingles, as 64-bit hashes. Documents with equal
sets are one class and are compared once. The rest goes in rounds:

1. Postings. All shingles have one global order, frequent ones last. Two sets that
   reach the threshold share one of the first ``prefix`` shingles of each, so only
   these are posted.
2. Stars. In the posting list of a shingle each class is paired with the first class
   of a size that fits. This needs one pass and makes fewer pairs than rows.
3. Search. Pairs that their parity signatures don't rule out go to a T-occurrence
   search: candidates of one query form an inverted index, DivideSkip merges the
   short lists with a heap, probes the long ones by binary search, and keeps the
   classes that reach the overlap. Large candidate sets are searched in blocks.
4. Rest. After the stars most lists hold one component only. In those that don't,
   signatures are compared across components, and of the pairs that remain the
   likeliest that connect the list go to the search: fewer than the list has rows. Lists in which one
   of them is no link, and others were left for it, are taken once more, with the components known by
   then and with all their pairs. Lists of frequent shingles are kept in salted blocks, and
   classes outside the list's largest component go to every block. So no link between
   different components is lost.

Components are the smallest labels that links lead to, found by repeated joins.

Edge cases: a null text, or one without words, has an empty set and is linked with
nothing; its component is its own id. Rows without an id take part in links, but
never name a component. Repeated rows are copies like others. Sets compare by
64-bit hashes, classes by 128 bits.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import drop_path, fresh_path, staged_at
from veilframe.llm.words import (
    SPACED,
    as_long,
    grams,
    key_filter,
    may_hold,
    mix,
    slices,
    words_of,
)

WORDS = 5
# The threshold as a fraction: 100 * intersection >= 80 * union.
NUMERATOR, DENOMINATOR = 80, 100
# At most so many shingles are known as frequent; they only change the order.
FREQUENT = 1 << 18
# A shingle counts as frequent from so many classes among some millions of shingles.
CHUNK, SEEN = 1 << 21, 4
# Classes of one list that are handled in one task.
LIST_ROWS = 4096
# Lists of up to so many rows are handled together, row by row at a distance.
SHORT = 64
# Bytes of sets that one search holds.
SEARCH_BYTES = 16 << 20
BINARY = pa.binary()


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A written table and its path; the shuffles that made it are freed."""
    path = fresh_path(df.sparkSession, f"setjoin-{label}")
    return staged_at(df, path, tidy=True), path


# --- sets and their bounds -----------------------------------------------------------


def needed_overlap(a, b):
    """Smallest intersection with which sets of sizes a and b reach the threshold."""
    return -(-(NUMERATOR * (a + b)) // (NUMERATOR + DENOMINATOR))


def fits(a, b):
    """Can sets of sizes a and b reach the threshold at all?"""
    return np.minimum(a, b) * DENOMINATOR >= np.maximum(a, b) * NUMERATOR


def prefix_length(n):
    return n - (-(-NUMERATOR * n // DENOMINATOR)) + 1


def class_key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    parts = [np.add.reduce(mix(s ^ np.uint64(seed))) for seed in (0x51ED270B, 0xA0761D64)]
    return np.array(parts, dtype=np.uint64).tobytes()


def signature(s: np.ndarray) -> bytes:
    """Parities of shingle counts in buckets, a few buckets for each shingle at most."""
    bits = 1 << max(6, len(s).bit_length())
    odd = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def possible(a: bytes, na: int, b: bytes, nb: int) -> bool:
    """False if parities prove that the sets differ in too many shingles."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    odd = int(np.bitwise_count(x ^ y).sum())
    return (na + nb - odd) // 2 >= needed_overlap(na, nb)


def shingle_sets(texts: pa.Array, k: int):
    """For each text its sorted set of shingle hashes."""
    words = words_of(texts, SPACED)
    hashes = words.hashes()
    g, at = grams(hashes, words.first, k)
    cuts = np.searchsorted(at, words.first)
    for i, n in enumerate(np.diff(words.first)):
        if n >= k:
            yield np.unique(g[cuts[i] : cuts[i + 1]])
        elif n:
            # Too short for a shingle: all its words are one.
            own, _ = grams(hashes[words.first[i] : words.first[i + 1]], np.array([0, n]), int(n))
            yield own
        else:
            yield np.zeros(0, np.uint64)


# --- T-occurrence search ---------------------------------------------------------------


def divide_skip(query: np.ndarray, index: dict, sizes: list[int], mu: float = 0.01) -> list:
    """(member, overlap) of the members whose set reaches the threshold with ``query``.

    ``index`` has the sorted member numbers of each shingle. Lists are divided: the
    longest are only probed for members that the heap-merge of the others leaves possible.
    """
    n = len(query)
    lists = sorted((index[t] for t in query.tolist() if t in index), key=len)
    if not lists:
        return []
    # No smaller set can reach the threshold.
    least = needed_overlap(n, -(-NUMERATOR * n // DENOMINATOR))
    long = min(int(least / (mu * math.log(len(lists[-1]) + 1) + 1)), least - 1, len(lists))
    short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
    out = []
    for member, run in groupby(heapq.merge(*short)):
        seen = sum(1 for _ in run)
        size = sizes[member]
        if min(n, size) * DENOMINATOR < max(n, size) * NUMERATOR:
            continue
        wanted = needed_overlap(n, size)
        # Shortest of the long lists first; stop when too few are left.
        for left, one in zip(range(len(probed), 0, -1), probed, strict=True):
            if seen + left < wanted:
                break
            at = bisect_left(one, member)
            seen += at < len(one) and one[at] == member
        if seen >= wanted:
            out.append((member, seen))
    return out


def inverted(sets: list[np.ndarray]) -> dict:
    token = np.concatenate(sets)
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, member = token[order], member[order].tolist()
    cuts = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True]).tolist()
    names = token[cuts[:-1]].tolist()
    return {t: member[a:b] for t, a, b in zip(names, cuts, cuts[1:], strict=False)}


# --- passes over the documents -----------------------------------------------------------


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """Per document (id, hash, n, key, sig); and rows (token, seen) of frequent shingles."""

    def run(batches):
        tokens: list[np.ndarray] = []
        known, held = set(), 0

        def frequent():
            t, c = np.unique(np.concatenate(tokens), return_counts=True)
            return t[c >= SEEN], c[c >= SEEN]

        def rows(ids, hashes, n, key, sig, t, c):
            a, b = len(n), len(t)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids, pa.nulls(b, ids.type)]),
                    pa.concat_arrays([hashes, pa.nulls(b, pa.int64())]),
                    pa.array([*n, *[None] * b], pa.int64()),
                    pa.array([*key, *[None] * b], BINARY),
                    pa.array([*sig, *[None] * b], BINARY),
                    pa.concat_arrays([pa.nulls(a, pa.int64()), as_long(t)]),
                    pa.array([*[None] * a, *c.tolist()], pa.int64()),
                ],
                ["id", "hash", "n", "key", "sig", "token", "seen"],
            )

        none = np.zeros(0, np.uint64)
        kind = None
        for batch in slices(batches, "text"):
            n, keys, sigs = [], [], []
            kind = batch.column(0).type
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                keys.append(key := class_key(s) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
                # Copies say nothing about how many classes share a shingle.
                if key is not None and key not in known:
                    known.add(key)
                    tokens.append(s)
                    held += len(s)
            t, c = none, none
            if held >= CHUNK:
                t, c = frequent()
                tokens, known, held = [], set(), 0
            yield rows(batch.column(0), batch.column(2), n, keys, sigs, t, c)
        if tokens:
            t, c = frequent()
            yield rows(pa.nulls(0, kind), pa.nulls(0, pa.int64()), [], [], [], t, c)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"id {kind}, hash long, n long, key binary, sig binary, token long, seen long"
    )


def postings(docs: DataFrame, k: int, frequent) -> DataFrame:
    """(token, salt, key, n, pos) of the first shingles of each class, in the global order."""

    def run(batches):
        tokens, ranks, blocks = frequent.value
        known: set[bytes] = set()
        for batch in slices(batches, "text"):
            cols: list[list] = [[], [], [], [], []]
            for s in shingle_sets(batch.column(0), k):
                n = len(s)
                if not n or (key := class_key(s)) in known:
                    continue
                known.add(key)
                rank, block = np.zeros(n, np.int64), np.ones(n, np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    hit = tokens[at] == s
                    rank, block = np.where(hit, ranks[at], 0), np.where(hit, blocks[at], 1)
                p = prefix_length(n)
                first = np.argsort(rank, kind="stable")[:p]
                cols[0].append(s[first])
                cols[1].append(np.frombuffer(key, np.uint64)[0] % block[first].astype(np.uint64))
                cols[2].extend([key] * p)
                cols[3].append(np.full(p, n))
                cols[4].append(np.arange(p))
            if cols[0]:
                yield pa.RecordBatch.from_arrays(
                    [
                        as_long(np.concatenate(cols[0])),
                        pa.array(np.concatenate(cols[1]).astype(np.int32)),
                        pa.array(cols[2], BINARY),
                        pa.array(np.concatenate(cols[3]).astype(np.int32)),
                        pa.array(np.concatenate(cols[4]).astype(np.int32)),
                    ],
                    ["token", "salt", "key", "n", "pos"],
                )

    return docs.select("text").mapInArrow(run, "token long, salt int, key binary, n int, pos int")


def sets_of(docs: DataFrame, k: int, bits) -> DataFrame:
    """(key, shingles) of the documents whose text's hash the filter lets pass.

    The others are left before their words are cut.
    """

    def run(batches):
        bitmap = np.frombuffer(bits.value, np.uint8)
        known: set[bytes] = set()
        wanted = (
            batch.filter(pa.array(may_hold(bitmap, batch.column(1).to_numpy().view(np.uint64))))
            for batch in batches
        )
        for batch in slices(wanted, "text"):
            keys, sets = [], []
            for s in shingle_sets(batch.column(0), k):
                if not len(s) or (key := class_key(s)) in known:
                    continue
                known.add(key)
                keys.append(key)
                sets.append(s.tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, BINARY), pa.array(sets, BINARY)], ["key", "shingles"]
                )

    return docs.select("text", "hash").mapInArrow(run, "key binary, shingles binary")


# --- posting lists -------------------------------------------------------------------------


def whole_lists(batches, names: list[str]):
    """Rows sorted by the first two columns, as tables that end where a list ends."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        t, s = (table[c].to_numpy() for c in names)
        change = np.flatnonzero((t[1:] != t[:-1]) | (s[1:] != s[:-1])) + 1
        if len(change):
            yield table.slice(0, change[-1]).combine_chunks()
            rest = table.slice(change[-1])
        else:
            rest = table
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def key_numbers(keys: pa.Array) -> np.ndarray:
    """Keys of 16 bytes as two numbers each."""
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)


def bounds(table: pa.Table) -> np.ndarray:
    t, s = table["token"].to_numpy(), table["salt"].to_numpy()
    return np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1]), True])


def near_rows(cut: np.ndarray):
    """Arrays (i, j) of rows of one list, j behind i; all pairs of the lists of up to SHORT rows."""
    size = np.diff(cut)
    end = np.repeat(np.where(size <= SHORT, cut[1:], 0), size)
    i = np.arange(len(end))
    for d in range(1, SHORT):
        i = i[i + d < end[i]]
        if not len(i):
            return
        yield i, i + d


def allowed_places(n, rest, i, j):
    """Can the rows reach the threshold, if they share nothing before this list's shingle?"""
    return np.minimum(rest[i], rest[j]) >= needed_overlap(n[i], n[j])


def partnered(cut: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows have a partner in their list; all rows of long lists count as such."""
    rest, size = n - pos, np.diff(cut)
    out = np.repeat(size > SHORT, size)
    for i, j in near_rows(cut):
        ok = allowed_places(n, rest, i, j)
        out[i[ok]] = out[j[ok]] = True
    return out


def star_lists(lists: DataFrame, frequent, keep_single: bool) -> DataFrame:
    """Each row of a list with the head of its size: (head, head_n, salts) beside its columns.

    Rows come by size. The first row is a head; a row whose size doesn't fit the head is the next.
    Rows that sizes and places allow no partner are left out. ``salts`` is the highest salt of the list.
    """

    def run(batches):
        tokens, _, blocks = frequent.value
        split, most = tokens[blocks > 1], blocks[blocks > 1] - 1
        for table in whole_lists(batches, ["token", "salt"]):
            # Copies from several partitions stand side by side.
            name = key_numbers(table["key"].combine_chunks())
            t, s = table["token"].to_numpy(), table["salt"].to_numpy()
            same = (t[1:] == t[:-1]) & (s[1:] == s[:-1]) & (name[1:] == name[:-1]).all(axis=1)
            table = table.filter(pa.array(np.r_[True, ~same]))
            n, pos = (table[c].to_numpy().astype(np.int64) for c in ("n", "pos"))
            take = partnered(bounds(table), n, pos)
            salts = np.zeros(len(n), np.int32)
            if len(split):
                t = table["token"].to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(split, t), len(split) - 1)
                salts = np.where(split[at] == t, most[at], 0).astype(np.int32)
            if keep_single:
                take |= salts > 0
            table = table.append_column("salts", pa.array(salts)).filter(pa.array(take))
            if not table.num_rows:
                continue
            cut, n = bounds(table), table["n"].to_numpy()
            head = np.zeros(len(n), np.int64)
            for a, b in zip(cut, cut[1:], strict=False):
                while a < b:
                    # Rows are sorted by n: those that fit the head follow it.
                    end = a + np.searchsorted(n[a:b], n[a] * DENOMINATOR // NUMERATOR, side="right")
                    head[a:end] = a
                    a = end
            key = table["key"].combine_chunks()
            at = pa.array(head)
            out = table.append_column("head", key.take(at)).append_column(
                "head_n", table["n"].combine_chunks().take(at)
            )
            yield from out.to_batches()

    sorted_rows = lists.repartition("token", "salt").sortWithinPartitions(
        "token", "salt", "n", "key"
    )
    return sorted_rows.mapInArrow(
        run, "token long, salt int, key binary, n int, pos int, salts int, head binary, head_n int"
    )


def odd_buckets(sigs: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many buckets the parities of two rows differ, for rows i and j."""
    size = np.array([len(s) for s in sigs])
    least = np.minimum(size[i], size[j])
    out = np.zeros(len(i), np.int64)
    for width in np.unique(least).tolist():
        at = np.flatnonzero(least == width)
        rows, place = np.unique(np.r_[i[at], j[at]], return_inverse=True)
        # The parts of a longer signature add up to a shorter one.
        bits = np.stack(
            [np.bitwise_xor.reduce(np.frombuffer(sigs[r], np.uint64).reshape(-1, width // 8)) for r in rows.tolist()]
        )
        for a in range(0, len(at), 1 << 14):
            x, y = place[a : min(a + (1 << 14), len(at))], place[len(at) + a : len(at) + a + (1 << 14)]
            out[at[a : a + len(x)]] = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1)
    return out


def rest_pairs(rows: DataFrame, whole: bool) -> DataFrame:
    """Pairs (q, d, nq) of one list and different components that sizes, places and signatures allow.

    All of them if ``whole``. Else of each list the likeliest that connect what they all connect; where that
    leaves some out, token names the list. Rows that are not ``own`` are not compared with each other.
    A component without a name is that of the key alone.
    """

    def run(batches):
        for table in whole_lists(batches, ["token", "salt"]):
            cut = bounds(table)
            n, pos = (table[c].to_numpy().astype(np.int64) for c in ("n", "pos"))
            rest, own = n - pos, table["own"].to_numpy()
            key, sig = table["key"].combine_chunks(), table["sig"].to_pylist()
            comp = pc.coalesce(table["comp"].combine_chunks(), key).dictionary_encode().indices.to_numpy()
            size = np.diff(cut)
            of = np.repeat(np.arange(len(size)), size)
            taken: list[tuple] = []

            def likely(i, j):
                """Those of the pairs that are possible, with the shares of shingles that differ."""
                i, j = (x[(comp[i] != comp[j]) & (own[i] | own[j]) & allowed_places(n, rest, i, j)] for x in (i, j))
                odd = odd_buckets(sig, i, j)
                ok = (n[i] + n[j] - odd) // 2 >= needed_overlap(n[i], n[j])
                return i[ok], j[ok], odd[ok] / (n[i] + n[j])[ok]

            def connecting(i, j, far):
                """Of the pairs of one list those that connect it, likeliest first; were others left out?"""
                above: dict = {}

                def top(x):
                    while x in above:
                        x = above[x]
                    return x

                kept = []
                for at in np.argsort(far, kind="stable").tolist():
                    x, y = top(comp[i[at]]), top(comp[j[at]])
                    if x != y:
                        above[x] = y
                        kept.append(at)
                return i[kept], j[kept], len(kept) < len(i)

            pairs = [likely(i, j) for i, j in near_rows(cut)]
            if pairs:
                i, j, far = (np.concatenate(x) for x in zip(*pairs, strict=True))
                order = np.argsort(of[i], kind="stable")
                i, j, far = i[order], j[order], far[order]
                ends = np.flatnonzero(np.r_[True, of[i][1:] != of[i][:-1], True]) if len(i) else np.zeros(0, int)
                for a, b in zip(ends, ends[1:], strict=False):
                    if whole or b - a == 1:
                        taken.append((i[a:b], j[a:b], False))
                    else:
                        taken.append(connecting(i[a:b], j[a:b], far[a:b]))
            for a, b in zip(cut[:-1][size > SHORT], cut[1:][size > SHORT], strict=True):
                if (comp[a:b] == comp[a]).all():
                    continue
                known: list = []
                held, left = 0, False
                for i in range(a + 1, b):
                    low = a + np.searchsorted(n[a:b], -(-n[i] * NUMERATOR // DENOMINATOR))
                    known.append(likely(np.full(max(i - low, 0), i), np.arange(low, i)))
                    held += len(known[-1][0])
                    # What doesn't connect is left at once, so no list holds all its pairs.
                    if held > LIST_ROWS or i == b - 1:
                        x, y, far = (np.concatenate(c) for c in zip(*known, strict=True))
                        if whole:
                            taken.append((x, y, False))
                            known, held = [], 0
                            continue
                        x, y, some = connecting(x, y, far)
                        left |= some
                        far = (n[x] + n[y]) * 0.0 if not len(x) else odd_buckets(sig, x, y) / (n[x] + n[y])
                        known, held = [(x, y, far)], 0
                if not whole:
                    taken.append((known[0][0], known[0][1], left))
            taken = [x for x in taken if len(x[0])]
            if not taken:
                continue
            i, j = (np.concatenate([x[c] for x in taken]) for c in (0, 1))
            left = np.repeat([x[2] for x in taken], [len(x[0]) for x in taken])
            name = table["token"].to_numpy()[i]
            a, b = key.take(pa.array(i)), key.take(pa.array(j))
            turned = pc.less(a, b)
            out = pa.table(
                {
                    "q": pc.if_else(turned, a, b),
                    "d": pc.if_else(turned, b, a),
                    "nq": np.where(turned.to_numpy(zero_copy_only=False), n[i], n[j]).astype(np.int32),
                    "token": pa.array(name, mask=~left),
                }
            )
            # Lists that stand together often hold the same pairs.
            yield from out.group_by(["q", "d", "nq", "token"]).aggregate([]).to_batches()

    sorted_rows = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "key")
    return sorted_rows.mapInArrow(run, "q binary, d binary, nq int, token long")


def rest_blocks(lists: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of the lists with signature and component; of salted lists some in every block."""
    columns = ["token", "salt", "key", "n", "pos", "sig", "comp"]
    plain = lists.where("salts = 0").join(known, "key").select(*columns, F.lit(True).alias("own"))
    wide = lists.where("salts > 0").join(known, "key").withColumn("comp", F.coalesce("comp", "key"))
    bulk = wide.groupBy("token", "comp").agg(F.count("*").alias("size")).groupBy("token").agg(
        F.max(F.struct("size", "comp"))["comp"].alias("bulk")
    )
    others = F.filter(F.sequence(F.lit(0), F.col("salts")), lambda s: s != F.col("salt"))
    asking = wide.join(bulk, "token").where("comp != bulk").withColumn("salt", F.explode(others))
    return plain.unionByName(wide.select(*columns, F.lit(True).alias("own"))).unionByName(
        asking.select(*columns, F.lit(False).alias("own"))
    )


# --- search ---------------------------------------------------------------------------------


def search(docs: DataFrame, k: int, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (q, d) whose sets reach the threshold, with their overlap.

    ``pairs`` must have nq, the size of q's set, and each pair once; ``classes`` names
    the hash of one text for each key. What was found is written; the sets are deleted.
    """
    spark = docs.sparkSession
    pairs, pairs_path = written(pairs.select("q", "d", "nq"), "pairs")
    keys = pairs.select(F.col("q").alias("key")).union(pairs.select("d")).distinct()
    bits = spark.sparkContext.broadcast(key_filter(classes.join(keys, "key", "left_semi"), "hash"))
    sets, sets_path = written(
        sets_of(docs, k, bits).join(keys, "key", "left_semi").dropDuplicates(["key"]), "sets"
    )
    # A query with many candidates is asked block by block.
    size = F.greatest(F.lit(1), F.lit(SEARCH_BYTES) / (F.col("nq") * 10)).cast("long")
    plan = pairs.groupBy("q", "nq").agg(F.count("*").alias("m")).select(
        "q", F.ceil(F.col("m") / size).cast("int").alias("blocks")
    )
    members = (
        pairs.join(plan, "q")
        .withColumn("block", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
        .join(sets.withColumnRenamed("key", "d"), "d")
        .select("q", "block", "d", "shingles")
    )
    queries = plan.join(sets.withColumnRenamed("key", "q"), "q").select(
        "q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(None).cast("binary").alias("d"), "shingles",
    )

    def ask(rows):
        query = [s for d, s in rows if d is None]
        found = [(d, np.frombuffer(s, np.uint64)) for d, s in rows if d is not None]
        if not query or not found:
            return []
        sets = [s for _, s in found]
        hits = divide_skip(
            np.frombuffer(query[0], np.uint64), inverted(sets), [len(s) for s in sets]
        )
        return [(found[i][0], overlap) for i, overlap in hits]

    def run(batches):
        # Sorted by query and block: a group is searched when the next one begins.
        group, rows = None, []
        out: list[tuple] = []

        def result():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], BINARY),
                    pa.array([x[1] for x in out], BINARY),
                    pa.array([x[2] for x in out], pa.int64()),
                ],
                ["q", "d", "overlap"],
            )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for q, block, d, s in zip(*columns, strict=True):
                if (q, block) != group:
                    if group:
                        out += [(group[0], *hit) for hit in ask(rows)]
                    group, rows = (q, block), []
                rows.append((d, s))
            if out:
                yield result()
                out.clear()
        if group:
            out += [(group[0], *hit) for hit in ask(rows)]
            if out:
                yield result()

    groups = queries.unionByName(members).repartition("q", "block").sortWithinPartitions("q", "block")
    links, _ = written(groups.mapInArrow(run, "q binary, d binary, overlap long"), "links")
    drop_path(spark, pairs_path)
    drop_path(spark, sets_path)
    bits.destroy()
    return links


def components(links: DataFrame) -> DataFrame:
    """(key, comp): the smallest key that links lead to, for all keys with a link."""
    spark = links.sparkSession
    edges, edges_path = written(
        links.select(F.col("q").alias("a"), F.col("d").alias("b"))
        .union(links.select("d", "q"))
        .distinct(),
        "edges",
    )
    labels, labels_path = written(
        edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("comp")),
        "labels",
    )
    while True:
        near = (
            edges.join(labels.withColumnRenamed("key", "b"), "b")
            .groupBy("a")
            .agg(F.min("comp").alias("near"))
        )
        # The label's own label is at least as small: paths halve in each round.
        far = labels.select(F.col("key").alias("comp"), F.col("comp").alias("far"))
        new = (
            labels.join(near.withColumnRenamed("a", "key"), "key")
            .join(far, "comp", "left")
            .select("key", "comp", F.least("comp", "near", "far").alias("next"))
        )
        new, new_path = written(new, "labels")
        drop_path(spark, labels_path)
        labels, labels_path = new.select("key", F.col("next").alias("comp")), new_path
        if new.where("next != comp").isEmpty():
            drop_path(spark, edges_path)
            return labels


# --- the join --------------------------------------------------------------------------------


def jaccard_links(docs: DataFrame, k: int = WORDS, doc_id: str = "doc_id", text: str = "text"):
    """(profiles, links): (id, n, key, hash) per document, and enough links (q, d) between classes.

    The links connect just those classes that all links together connect.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    passed, _ = written(profiles(source, k), "profiles")
    profile = passed.where("n is not null").select("id", "n", "key", "hash")
    classes = passed.where("key is not null").select("key", "n", "sig").dropDuplicates(["key"])

    top = (
        passed.where("token is not null")
        .groupBy("token")
        .agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "token")
        .limit(FREQUENT)
        .toArrow()
    )
    tokens, seen = top["token"].to_numpy().view(np.uint64), top["seen"].to_numpy()
    ranks = np.arange(len(tokens), 0, -1)
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast(
        (tokens[order], ranks[order], (-(-seen // LIST_ROWS)).astype(np.int64)[order])
    )

    posted = postings(source, k, frequent)
    lists, lists_path = written(star_lists(posted, frequent, True), "lists")
    # Heads of salted lists are joined by a star of their own.
    heads = lists.where("key = head and salts > 0").select("token", F.lit(0).alias("salt"), "key", "n", "pos")
    between = star_lists(heads, frequent, False)
    stars = (
        lists.select("head", "head_n", "key", "n")
        .unionByName(between.select("head", "head_n", "key", "n"))
        .where("head != key")
        .distinct()
    )
    # One text of each class, by its hash, is enough to find its set again.
    texts = passed.where("key is not null").groupBy("key").agg(F.min("hash").alias("hash"))
    sig = classes.select("key", "sig")
    stars = stars.join(sig, "key").join(
        sig.select(F.col("key").alias("head"), F.col("sig").alias("head_sig")), "head"
    )

    def allowed(batches):
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("head_sig", "head_n", "sig", "n")]
            yield batch.filter(pa.array([possible(*x) for x in zip(*columns, strict=True)], pa.bool_()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stars.schema)
    likely = stars.mapInArrow(allowed, kinds).select(
        F.col("head").alias("q"), F.col("key").alias("d"), F.col("head_n").alias("nq")
    )
    first = search(source, k, likely, texts)
    frequent.destroy()

    # Lists that still hold several components.
    links, asked, failed = first, lists, None
    for whole in (False, True):
        known = sig.join(components(links), "key", "left")
        rest, rest_path = written(rest_pairs(rest_blocks(asked, known), whole), "rest")
        left = rest.select("q", "d", "nq").distinct()
        if failed is not None:
            left = left.join(failed, ["q", "d"], "left_anti")
        more = search(source, k, left, texts)
        links = links.unionByName(more)
        if whole:
            break
        failed = left.join(more, ["q", "d"], "left_anti").select("q", "d")
        again = rest.where("token is not null").join(failed, ["q", "d"], "left_semi").select("token").distinct()
        if again.isEmpty():
            break
        asked = lists.join(again, "token", "left_semi")
    drop_path(spark, lists_path)
    return profile, links


def jaccard_components(
    docs: DataFrame, k: int = WORDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    profile, links = jaccard_links(docs, k, doc_id, text)
    named = profile.where("key is not null").groupBy("key").agg(F.min("id").alias("own"))
    comps = named.join(components(links), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    smallest = comps.groupBy("comp").agg(F.min("own").alias("component"))
    by_class = comps.join(smallest, "comp").select("key", "component")
    return profile.join(by_class, "key", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
    )


def first_rows(docs: DataFrame, k: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, hash, bare: of each component the row with the smallest id, or else one without; all rows without words.

    ``hash`` is xxhash64 of the text; with the id it tells rows apart where ids repeat or are null.
    """
    profile, links = jaccard_links(docs, k, doc_id, text)
    row = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    rows = profile.where("key is not null").groupBy("key").agg(F.min(row).alias("row"))
    comps = rows.join(components(links), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    first = comps.groupBy("comp").agg(F.min("row").alias("row")).select("row.id", "row.hash", F.lit(False).alias("bare"))
    bare = profile.where("key is null").select("id", "hash", F.lit(True).alias("bare")).distinct()
    return first.unionByName(bare).withColumnRenamed("id", "doc_id")
