"""Grades of documents by ordinal cumulative-link regression on hashed text.

P(grade <= k | x) = 1 / (1 + exp(w.x - threshold_k)): one weight vector for all
grades, and thresholds that rise. Expected grade and the probability of a grade
above a bound come from the same numbers and are used for selection.

Words are hashed, and so are the shapes of what stands between white space
("Of%%%" is "Aa%%%"), so that junk is known by its form. Counts are damped by a
logarithm and scaled to unit length, so long texts weigh no more than short ones.

The fit takes at most ``fit_rows`` rated documents, those with the smallest hash
of the id, in numpy on the driver: a bounded number of bounded rows. Scoring runs
over all documents in whole.

Edge cases: a null or empty text has no features and gets the probabilities of
the thresholds alone; ratings null or of documents that are not there take no part;
a document rated twice takes its lowest rating; without ratings fit() raises.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.words import PLAIN, SPACED, mix, slices, words_of

BITS = 18
FIT_ROWS = 12_000
# No document of the fit keeps more features than this (the most frequent ones).
FIT_FEATURES = 2_000
# Features of the fit that are worked on at once.
ENTRIES = 1 << 17

# Letters, capitals and digits become one sign each; other bytes stay.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")


def shape_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for the shape of each white-space token, and the token counts of the texts."""
    words = words_of(texts, SPACED)
    raw = np.frombuffer(texts.cast(pa.large_string()).fill_null("").buffers()[2] or b"", np.uint8)
    column = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
    shape = SHAPE[raw[at : at + len(words.low)]]
    # Only the last four bytes and the length's order count: prose has few shapes.
    h = np.zeros(len(words.starts), dtype=np.uint64)
    for back in range(1, 5):
        place = words.ends - back
        inside = place >= words.starts
        value = np.where(inside, shape[np.maximum(place, 0)], 0).astype(np.uint64)
        h = h * np.uint64(257) + value
    return mix(h + np.uint64(1 << 40)), words.counts()


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of all features, by text; values of a text have unit length."""
    words = words_of(texts, PLAIN)
    shapes, shape_counts = shape_hashes(texts)
    n = len(texts)
    text = np.concatenate([np.repeat(np.arange(n), words.counts()), np.repeat(np.arange(n), shape_counts)])
    bucket = (np.concatenate([words.hashes(), shapes]) >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique((text << BITS) | bucket, return_counts=True)
    text, bucket = key >> BITS, key & ((1 << BITS) - 1)
    value = 1.0 + np.log(count)
    norm = np.sqrt(np.bincount(text, weights=value * value, minlength=n))
    return text, bucket, value / norm[text]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


@dataclass
class OrdinalModel:
    weights: np.ndarray  # one per bucket
    thresholds: np.ndarray  # rising, one fewer than grades

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, as columns."""
        return _sigmoid(z[:, None] - self.thresholds[None, :])


def fit_ordinal(
    row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray,
    epochs: int = 300, rate: float = 0.5, decay: float = 3e-6,
) -> OrdinalModel:
    """Maximum likelihood by Adam over all rows; thresholds rise by construction.

    Features are gone through ENTRIES at a time, so a fit takes little more memory than they do. Rows weigh so that each grade counts as much as any other.
    """
    grades = int(grade.max()) + 1
    share = np.bincount(grade, minlength=grades)
    weight = (len(grade) / (max(1, np.count_nonzero(share)) * np.maximum(share, 1)))[grade] / len(grade)
    # The first threshold, then the logarithms of the gaps between them.
    t = np.r_[-1.0, np.zeros(grades - 2)]
    present = np.zeros(1 << BITS, dtype=bool)
    present[bucket] = True
    used = np.flatnonzero(present)
    place = (np.cumsum(present, dtype=np.int32) - 1)[bucket]
    pieces = [slice(a, a + ENTRIES) for a in range(0, len(value), ENTRIES)]
    v = np.zeros(len(used))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (v, t)]
    one = np.arange(len(grade))
    for step in range(1, epochs + 1):
        theta = np.cumsum(np.r_[t[0], np.exp(t[1:])])
        z = np.zeros(len(grade))
        for s in pieces:
            np.add.at(z, row[s].astype(np.intp), value[s] * v[place[s]])
        low = np.concatenate([np.zeros((len(z), 1)), _sigmoid(theta[None, :] - z[:, None]), np.ones((len(z), 1))], 1)
        up, down = low[one, grade + 1], low[one, grade]
        p = np.maximum(up - down, 1e-12)
        # d/dz and d/dtheta of -log p
        du, dd = up * (1 - up), down * (1 - down)
        dz = weight * (du - dd) / p
        dtheta = np.zeros(grades + 1)
        np.add.at(dtheta, grade + 1, -weight * du / p)
        np.add.at(dtheta, grade, weight * dd / p)
        dtheta = dtheta[1:-1]
        tail = np.cumsum(dtheta[::-1])[::-1]
        dt = np.r_[tail[0], tail[1:] * np.exp(t[1:])]
        dv = np.zeros(len(used))
        for s in pieces:
            np.add.at(dv, place[s].astype(np.intp), value[s] * dz[row[s]])
        dv += decay * v
        for x, g, s in ((v, dv, state[0]), (t, dt, state[1])):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            x -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-9) * (0.1 if x is t else 1.0)
    w = np.zeros(1 << BITS)
    w[used] = v
    return OrdinalModel(w, np.cumsum(np.r_[t[0], np.exp(t[1:])]))


def fit(
    docs: DataFrame, ratings: DataFrame, grade: Column,
    doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS,
) -> OrdinalModel:
    """Fit on at most ``fit_rows`` rated documents; ``grade`` is 0, 1, 2 ... of a rating row."""
    rated = (
        ratings.select(F.col(doc_id).alias("id"), grade.cast("int").alias("grade"))
        .where("id is not null and grade is not null")
        .groupBy("id")
        .agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(fit_rows)
    )
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches):
        for batch in slices(batches, "text"):
            at, bucket, value = features(batch.column(0))
            cuts = np.searchsorted(at, np.arange(batch.num_rows + 1))
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                top = np.arange(a, b)
                if b - a > FIT_FEATURES:
                    top = np.sort(a + np.argsort(-value[a:b], kind="stable")[:FIT_FEATURES])
                rows.append((bucket[top].astype(np.int32), value[top].astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                ],
                ["grade", "bucket", "value"],
            )

    joined = source.join(F.broadcast(rated), "id").dropDuplicates(["id"]).select("text", "grade")
    table = joined.mapInArrow(run, "grade int, bucket array<int>, value array<float>").toArrow()
    if not table.num_rows:
        raise ValueError("no rated documents to fit on")
    lengths = pc.list_value_length(table["bucket"]).to_numpy()
    flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in table[c].chunks])
    row, bucket, value = np.repeat(np.arange(table.num_rows, dtype=np.int32), lengths), flat("bucket"), flat("value")
    grades = table["grade"].to_numpy()
    del table
    return fit_ordinal(row, bucket, value, grades)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The input columns, with ``grade_probabilities``: P(grade > k) for each k.

    A column of that name in the input is replaced.
    """
    name = "grade_probabilities"
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.weights.astype(np.float32), model.thresholds)
    )

    def run(batches):
        weights, thresholds = shared.value
        own = OrdinalModel(weights, thresholds)
        for batch in slices(batches, text):
            at, bucket, value = features(batch.column(batch.schema.get_field_index(text)))
            z = np.bincount(at, weights=value * weights[bucket], minlength=batch.num_rows)
            tails = own.above(z)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(tails), pa.list_(pa.float64()))],
                [*batch.schema.names, name],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, {name} array<double>")


def graded(docs: DataFrame, model: OrdinalModel, text: str = "text", bound: int = 1) -> DataFrame:
    """score(), with expected_grade and tail_probability = P(grade > bound)."""
    out = score(docs, model, text)
    total = F.expr("aggregate(grade_probabilities, 0D, (a, x) -> a + x)")
    return out.withColumn("expected_grade", total).withColumn(
        "tail_probability", F.col("grade_probabilities")[bound]
    )




def rating() -> Column:
    """Grade of a labels row: 0 harmful, 1 poor, 2 good; null if it isn't rated."""
    return F.expr("case when toxic = 1 then 0 when quality = 0 then 1 when quality = 1 then 2 end")
