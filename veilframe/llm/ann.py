"""Nearest neighbours by robust-pruned directed graphs, one graph per shard.

Equal vectors are one node that knows its ids, so very many copies neither swell
a graph nor tear it apart. Nodes go to shards of about ``shard_rows`` by the hash
of the vector; a shard's graph is one row of a written table. A graph is built in
rounds: greedy searches from a medoid propose neighbours, pruning keeps a
neighbour unless a kept one is nearer to it by the factor ``alpha``, and edges
are made two-way and pruned again. A query walks every shard of its dimension by
beam search, its candidates get their exact distance in double precision, and the
nearest of all shards are its result.

Edge cases: vectors that are null, empty, zero, or hold nulls or non-finite
components take no part; vectors are compared with those of their length only;
a null vec_id takes no part; a repeated row (id and vector) counts once; rows with
the id of the query are its own; equal distances go by the smaller vec_id; with
fewer candidates than ``k`` all are found; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import staged

NEIGHBOURS = 10
SHARD_ROWS = 2048
DEGREE = 24
BEAM = 64
ALPHA = 1.2
EVERY = 100
# Queries of one walk are taken together.
WALK = 256


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and vec, the components' bytes in double precision; vectors that count only."""

    def run(batches):
        for batch in batches:
            ids, vecs = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = v.values
                if i is None or values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], ["id", "vec"]
            )

    source = rows.select(F.col(vec_id).cast("long"), F.col(vector))
    return source.mapInArrow(run, "id long, vec binary")


def nodes(vectors: DataFrame, k: int) -> DataFrame:
    """vec and ids: the k + 1 smallest ids of each vector; no other can be among the k nearest."""
    once = vectors.dropDuplicates(["vec", "id"])
    at = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = once.withColumn("at", at).where(F.col("at") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of queries to the nodes ``at``, less the query's own norm."""
    return norms[at] - 2.0 * np.einsum("qd,qrd->qr", q, x[at])


def beam_search(x, norms, graph, start: int, q: np.ndarray, beam: int):
    """(nodes, distances) of each query's beam, nearest first; -1 where there is none."""
    n, m = len(q), len(x)
    one = np.arange(n)[:, None]
    found = np.full((n, beam), m, dtype=np.int64)
    far = np.full((n, beam), np.inf, dtype=np.float32)
    open_ = np.zeros((n, beam), dtype=bool)
    seen = np.zeros((n, m + 1), dtype=bool)
    seen[:, m] = True
    found[:, 0], open_[:, 0] = start, True
    far[:, 0] = _distances(x, norms, q, np.full((n, 1), start))[:, 0]
    seen[:, start] = True
    while True:
        active = np.flatnonzero(open_.any(1))
        if not len(active):
            return np.where(found == m, -1, found), far
        # The nearest node of each beam that has not been left yet.
        place = open_[active].argmax(1)
        node = found[active, place]
        open_[active, place] = False
        near = graph[node]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        d = np.where(fresh, _distances(x, norms, q[active], np.minimum(near, m - 1)), np.inf)
        ids = np.concatenate([found[active], np.where(fresh, near, m)], 1)
        ds = np.concatenate([far[active], d.astype(np.float32)], 1)
        op = np.concatenate([open_[active], fresh], 1)
        order = np.argsort(ds, 1, kind="stable")[:, :beam]
        row = one[: len(active)]
        found[active], far[active], open_[active] = ids[row, order], ds[row, order], op[row, order]


def robust_prune(x, norms, node: np.ndarray, options: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node at most ``degree`` of its options (-1: none), the nearest and diverse."""
    m = len(x)
    safe = np.where(options < 0, 0, options)
    d = norms[safe] + norms[node][:, None] - 2.0 * np.einsum("nd,ncd->nc", x[node], x[safe])
    bad = (options < 0) | (options == node[:, None])
    d = np.where(bad, np.inf, np.maximum(d, 0))
    order = np.argsort(d, 1, kind="stable")
    row = np.arange(len(node))[:, None]
    safe, d = safe[row, order], d[row, order]
    among = norms[safe][:, :, None] + norms[safe][:, None, :] - 2.0 * np.einsum("ncd,ned->nce", x[safe], x[safe])
    alive = np.isfinite(d)
    out = np.full((len(node), degree), m, dtype=np.int64)
    for at in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        pick = alive.argmax(1)
        rows = np.flatnonzero(has)
        out[rows, at] = safe[rows, pick[rows]]
        # Relaxed pruning; distances are squared, and so is the factor. A copy of the pick goes too.
        covered = alpha * alpha * np.maximum(among[rows, pick[rows]], 0) <= d[rows]
        covered[np.arange(len(rows)), pick[rows]] = True
        covered |= safe[rows] == safe[rows, pick[rows]][:, None]
        alive[rows] &= ~covered
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
    """(graph, medoid): row i has the nodes that node i points to; len(x) where there is none."""
    m = len(x)
    norms = np.einsum("nd,nd->n", x, x)
    rng = np.random.default_rng(m)
    start = int(np.argmin(norms - 2.0 * x @ x.mean(0)))
    graph = np.full((m + 1, degree), m, dtype=np.int64)
    if m > 1:
        first = rng.integers(0, m - 1, (m, min(degree, m - 1)))
        first = np.sort(first + (first >= np.arange(m)[:, None]), 1)
        first[:, 1:][first[:, 1:] == first[:, :-1]] = m
        graph[:m, : first.shape[1]] = first
    for factor in (1.0, alpha):
        order = rng.permutation(m)
        for a in range(0, m, WALK):
            node = order[a : a + WALK]
            options, _ = beam_search(x, norms, graph, start, x[node], beam)
            own = np.where(graph[node] == m, -1, graph[node])
            kept = robust_prune(x, norms, node, np.concatenate([options, own], 1), degree, factor)
            graph[node] = kept
            # Edges back; a node with too many is pruned again.
            source = np.repeat(node, degree)
            target = kept.ravel()
            source, target = source[target < m], target[target < m]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            to, at, counts = np.unique(target, return_index=True, return_counts=True)
            wide = np.full((len(to), degree + int(counts.max(initial=0))), -1, dtype=np.int64)
            wide[:, :degree] = np.where(graph[to] == m, -1, graph[to])
            lane = np.arange(len(source)) - np.repeat(at, counts)
            wide[np.repeat(np.arange(len(to)), counts), degree + lane] = source
            for b in range(0, len(to), WALK):
                graph[to[b : b + WALK]] = robust_prune(x, norms, to[b : b + WALK], wide[b : b + WALK], degree, factor)
    return graph, start


def sharded(classes: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with their dim and shard, shards of each dim)."""
    dims = staged(
        classes.groupBy((F.octet_length("vec") / 8).cast("int").alias("dim")).agg(
            F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")
        ),
        "ann-dims",
    )
    dealt = (
        classes.withColumn("dim", (F.octet_length("vec") / 8).cast("int"))
        # A row per length of vectors: few, however many vectors there are.
        .join(F.broadcast(dims), "dim")
        .withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int"))
    )
    return dealt.drop("shards"), dims


INDEX = "dim int, shard int, vecs binary, graph binary, start int, ids array<array<bigint>>"


def index(dealt: DataFrame, shard_total: int, degree: int, beam: int, alpha: float) -> DataFrame:
    """One row per shard: its vectors, graph, entry and ids."""

    def run(batches):
        def done(key, vecs, ids):
            x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
            graph, start = build(x.astype(np.float32), degree, beam, alpha)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                    pa.array([x.tobytes()], pa.binary()),
                    pa.array([graph.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([start], pa.int32()), pa.array([ids], pa.list_(pa.list_(pa.int64()))),
                ],
                ["dim", "shard", "vecs", "graph", "start", "ids"],
            )

        key, vecs, ids = None, [], []
        for batch in batches:
            for d, s, v, i in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (d, s):
                    if vecs:
                        yield done(key, vecs, ids)
                    key, vecs, ids = (d, s), [], []
                vecs.append(v)
                ids.append(i)
        if vecs:
            yield done(key, vecs, ids)

    return (
        dealt.select("dim", "shard", "vec", "ids")
        .repartition(max(1, shard_total), "dim", "shard")
        .sortWithinPartitions("dim", "shard", "vec")
        .mapInArrow(run, INDEX)
    )


def search(shards: DataFrame, queries: DataFrame, shard_total: int, k: int, degree: int, beam: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of each shard for each query.

    ``queries`` has a row for each shard of a query: id, vec, dim, shard.
    """
    none = lambda kind: F.lit(None).cast(kind)
    both = shards.select(
        "dim", "shard", none("long").alias("id"), F.col("vecs").alias("vec"), "graph", "start", "ids"
    ).unionByName(
        queries.select(
            "dim", "shard", "id", "vec", none("binary").alias("graph"), none("int").alias("start"),
            none("array<array<bigint>>").alias("ids"),
        )
    )

    def run(batches):
        def walk(asked):
            ids_q = [a[0] for a in asked]
            q = np.frombuffer(b"".join(a[1] for a in asked), np.float64).reshape(len(asked), -1)
            at, _ = beam_search(low, norms, graph, start, q.astype(np.float32), max(beam, k + 1))
            qs, vs, ds = [], [], []
            for i, row in enumerate(at):
                row = row[row >= 0]
                d = np.sqrt(((exact[row] - q[i]) ** 2).sum(1))
                near = sorted((float(s), v) for s, n in zip(d, row, strict=True) for v in ids[n] if v != ids_q[i])
                for s, v in near[:k]:
                    qs.append(ids_q[i])
                    vs.append(v)
                    ds.append(s)
            return pa.RecordBatch.from_arrays(
                [pa.array(qs, pa.int64()), pa.array(vs, pa.int64()), pa.array(ds, pa.float64())],
                ["query_id", "vec_id", "score"],
            )

        asked: list = []
        for batch in batches:
            for dim, _, i, v, g, s, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if g is not None:
                    if asked:
                        yield walk(asked)
                        asked = []
                    exact = np.frombuffer(v, np.float64).reshape(-1, dim)
                    low = exact.astype(np.float32)
                    norms = np.einsum("nd,nd->n", low, low)
                    graph = np.frombuffer(g, np.int32).reshape(-1, degree).astype(np.int64)
                    start, ids = s, own
                    continue
                asked.append((i, v))
                if len(asked) == WALK:
                    yield walk(asked)
                    asked = []
        if asked:
            yield walk(asked)

    return (
        both.repartition(max(1, shard_total), "dim", "shard")
        .sortWithinPartitions("dim", "shard", F.col("graph").isNull(), "id")
        .mapInArrow(run, "query_id long, vec_id long, score double")
    )


def nearest(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    every: int = EVERY,
    k: int = NEIGHBOURS,
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    beam: int = BEAM,
    alpha: float = ALPHA,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of each row whose id is divisible by ``every``."""
    vectors = usable(rows, vec_id, vector)
    classes = staged(nodes(vectors, k), "ann-nodes")
    dealt, dims = sharded(classes, shard_rows)
    total = int(dims.agg(F.sum("shards")).first()[0] or 0)
    shards = staged(index(dealt, total, degree, beam, alpha), "ann-index")
    asked = (
        vectors.where(F.col("id") % every == 0)
        .distinct()
        .withColumn("dim", (F.octet_length("vec") / 8).cast("int"))
        .join(F.broadcast(dims), "dim")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    )
    found = search(shards, asked, total, k, degree, beam)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
