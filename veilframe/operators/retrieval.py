"""Finding documents: by words, by vectors, and by both."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.text import let
from veilframe.shared import staged

TOKEN = "[a-z0-9]+"
K1, B = 1.2, 0.75
RANK_OFFSET = 60


def bm25(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """BM25 score of every document that holds a term: key, score.

    Only the query's own terms leave the row; the corpus figures are one row.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    counted = docs.select(key, words.alias("w")).select(
        key,
        F.size("w").alias("dl"),
        *[
            F.size(_equal("w", t)).alias(f"tf{i}")
            for i, t in enumerate(terms)
        ],
    )
    figures = counted.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("dl").alias("avgdl"),
        *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))],
    ).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        df = figures[f"df{i}"] or 0
        tf = F.col(f"tf{i}")
        idf = F.log(F.lit(1 + (figures["n"] - df + 0.5) / (df + 0.5)))
        length = 1 - B + B * F.col("dl") / F.lit(figures["avgdl"] or 1.0)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * length)
    any_term = F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0
    return counted.where(any_term).select(key, score.alias("score"))


def _equal(words: str, term: str) -> Column:
    return F.filter(words, lambda x: x == term)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine between a vector column and one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return F.when((norm > 0) & F.lit(length > 0), dot / (norm * length))


def top(scored: DataFrame, k: int, key: str) -> DataFrame:
    """The ``k`` best with their rank; each task keeps no more than ``k``."""
    best = scored.orderBy(F.desc("score"), key).limit(k)
    # At most k rows are left here.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fused(a: DataFrame, b: DataFrame, key: str, offset: int = RANK_OFFSET) -> DataFrame:
    """Two rankings (key, rank) as one, by the sum of reciprocal ranks."""
    left = a.select(key, F.col("rank").alias("ra"))
    right = b.select(key, F.col("rank").alias("rb"))

    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (offset + F.col(rank)), F.lit(0.0))

    return left.join(right, key, "full_outer").select(key, (part("ra") + part("rb")).alias("score"))


# --- dense retrieval for a table of questions --------------------------------------------

# Questions that are told to every task at once; more are asked block by block.
QUESTIONS = 4_096
# Vectors that are multiplied with them at once.
VECTORS = 2_048
# Scores are compared to this many places, so equal vectors tie whatever order they are summed in.
PLACES = 12


def _unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``width`` finite numbers and not all zero, with length 1; and which rows they are."""
    right = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False) == width
    at = np.flatnonzero(right)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, width) if len(at) else np.zeros((0, width))
    length = np.sqrt((x * x).sum(axis=1))
    fine = np.isfinite(length) & (length > 0)
    return x[fine] / length[fine, None], at[fine]


def _best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of scores its k best (ids, scores), ties by the smaller id."""
    out = []
    cut = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    for row, least in zip(scores, cut, strict=True):
        at = np.flatnonzero(row >= least)
        at = at[np.lexsort((ids[at], -row[at]))][:k]
        out.append((ids[at], row[at]))
    return out


def nearest(
    questions: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding",
    least: float | None = None, questions_at_once: int = QUESTIONS,
) -> DataFrame:
    """The ``k`` vectors most like each question by cosine: question, key, rank, score. Exact.

    ``questions`` and ``vectors`` have a whole number ``key`` and an array ``vector``; a vector
    with the key of the question is left out, as are null, empty, zero and non-finite ones and
    those of another length than the question. ``least`` is the smallest score that counts.
    A task multiplies a batch of vectors with a block of questions and keeps its k best, and
    these are merged; ties go to the smaller key. Each block reads the vectors once.
    """
    spark = questions.sparkSession
    n = questions.count()
    blocks = max(1, -(-2 * n // questions_at_once) if n > questions_at_once else 1)
    asked = staged(
        questions.select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v"))
        .where("q IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))),
        "questions",
    )

    def asker(told):
        def run(batches):
            best: dict[int, list] = {}
            for batch in batches:
                every = batch.column(0)
                for width, (q, own) in told.value.items():
                    x, at = _unit_rows(batch.column(1), width)
                    if not len(x):
                        continue
                    ids = every.take(pa.array(at)).to_numpy(zero_copy_only=False)
                    kept = best.setdefault(width, [(np.zeros(0, np.int64), np.zeros(0))] * len(own))
                    for lo in range(0, len(x), VECTORS):
                        here = ids[lo : lo + VECTORS]
                        scores = np.round(q @ x[lo : lo + VECTORS].T, PLACES)
                        scores[own[:, None] == here[None, :]] = -np.inf
                        for i, (new, s) in enumerate(_best_of(scores, here, k)):
                            ids_i, s_i = np.concatenate([kept[i][0], new]), np.concatenate([kept[i][1], s])
                            top = np.lexsort((ids_i, -s_i))[:k]
                            kept[i] = ids_i[top], s_i[top]
            for width, kept in best.items():
                own = told.value[width][1]
                count = [len(ids) for ids, _ in kept]
                columns = [np.repeat(own, count), *(np.concatenate(c) for c in zip(*kept, strict=True))]
                found = np.isfinite(columns[2])
                yield pa.RecordBatch.from_arrays([pa.array(c[found]) for c in columns], ["question", "id", "score"])

        return run

    source = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL")
    parts = []
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).select("q", "v").toArrow()
        v, q = rows["v"].combine_chunks(), rows["q"].to_numpy()
        widths = set(pa.compute.list_value_length(v).drop_null().to_pylist()) - {0}
        told = {w: _unit_rows(v, w) for w in widths}
        told = spark.sparkContext.broadcast({w: (x, q[at]) for w, (x, at) in told.items() if len(at)})
        parts.append(source.mapInArrow(asker(told), "question long, id long, score double"))
    found = reduce(DataFrame.unionByName, parts)
    if least is not None:
        found = found.where(F.col("score") >= least)
    order = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("question", F.col("id").alias(key), "rank", "score")


# --- lexical retrieval for a table of questions --------------------------------------------

# Postings of one block, and best weights that are kept of each term.
POSTINGS, BEST = 128, 100


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _counted(words: str) -> str:
    """The different words of an array with how often each is there, found in the row: equal words stand together once sorted."""
    starts = "filter(sequence(0, size(s) - 1), i -> i = 0 or s[i] <> s[i - 1])"
    each = "transform(p, (at, j) -> named_struct('term', s[at], 'tf', coalesce(get(p, j + 1), size(s)) - at))"
    return f"if(size({words}) > 0, {let(f'sort_array({words})', 's', let(starts, 'p', each))}, null)"


def _blocks(avgdl: float, size: int):
    """A function that makes blocks of postings (term, doc, dl, tf) in the order of these columns."""

    def run(batches):
        held = None
        for batch in chain(batches, [None]):
            if batch is None and held is None:
                return
            columns = held if batch is None else (batch.column(0), *(c.to_numpy() for c in batch.columns[1:]))
            if not len(columns[0]):
                continue
            if held is not None and batch is not None:
                columns = (pa.concat_arrays([held[0], columns[0]]), *map(np.concatenate, zip(held[1:], columns[1:], strict=True)))
            term, doc, dl, tf = columns
            other = np.r_[True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)]
            # Rows that repeat a document are one posting.
            new = np.flatnonzero(other | np.r_[True, (doc[1:] != doc[:-1]) | (dl[1:] != dl[:-1])])
            tf = np.add.reduceat(tf, new)
            term, doc, dl, other = term.take(pa.array(new)), doc[new], dl[new], other[new]
            held = None
            if batch is not None:  # the last posting may go on in the next batch
                held = (term[-1:], doc[-1:], dl[-1:], tf[-1:])
                term, doc, dl, tf, other = term[:-1], doc[:-1], dl[:-1], tf[:-1], other[:-1]
            if not len(doc):
                continue
            weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            at = np.arange(len(doc))
            begin = np.flatnonzero((at - np.maximum.accumulate(np.where(other, at, 0))) % size == 0)
            postings = pa.StructArray.from_arrays([pa.array(doc), pa.array(weight)], ["doc", "weight"])
            yield pa.RecordBatch.from_arrays(
                [
                    term.take(pa.array(begin)),
                    pa.array(np.maximum.reduceat(weight, begin)),
                    pa.ListArray.from_arrays(pa.array(np.r_[begin, len(doc)].astype(np.int32)), postings),
                ],
                ["term", "most", "postings"],
            )

    return run


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """An inverted index for bm25_many(): ``path``/blocks and ``path``/terms.

    A block has up to 128 postings of a term in the order of their documents (whole numbers,
    not negative) and the largest weight among them; blocks are sorted by term, so a reader is led
    to its files by their statistics. ``terms`` has the frequency of each term and its
    largest weights. Words are counted inside the row, and the postings move once, by ranges of term
    and document, so a frequent term is spread over many tasks.
    """
    spark = docs.sparkSession
    counted = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), _words(text).alias("w"))
    sizes = counted.select("doc", F.size("w").alias("dl"), "w")
    n, avgdl = sizes.where("dl >= 0").agg(F.count(F.lit(1)), F.avg("dl")).first()
    each = sizes.select("doc", "dl", F.explode(F.expr(_counted("w"))).alias("t")).select("t.term", "doc", "dl", "t.tf")
    order = ["term", "doc", "dl"]
    blocks = each.repartitionByRange("term", "doc").sortWithinPartitions(*order).mapInArrow(
        _blocks(float(avgdl or 1.0), POSTINGS), "term string, most double, postings array<struct<doc:bigint,weight:double>>"
    )
    blocks.write.parquet(f"{path}/blocks")
    # The best weights of each block are enough to find those of the term.
    best = spark.read.parquet(f"{path}/blocks").select(
        "term",
        F.size("postings").alias("df"),
        F.slice(F.sort_array("postings.weight", asc=False), 1, BEST).alias("best"),
    )
    frequency = best.groupBy("term").agg(F.sum("df").alias("df"))
    order = Window.partitionBy("term").orderBy(F.desc("weight"))
    top = best.select("term", F.explode("best").alias("weight")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= BEST)
    top = top.groupBy("term").agg(F.sort_array(F.collect_list("weight"), asc=False).alias("best"))
    idf = F.log(1 + (F.lit(int(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    frequency.join(top, "term").select("term", "df", idf.alias("idf"), "best").repartitionByRange("term").sortWithinPartitions(
        "term"
    ).write.parquet(f"{path}/terms")


def bm25_many(questions: DataFrame, path: str, k: int = 10, places: int = 9) -> DataFrame:
    """The ``k`` best documents of each question: question, doc, rank, score. Exact, k up to BEST.

    ``questions`` has ``question`` and an array ``terms``; repeated terms count once. The k-th
    best weight of a single term is a score that k documents reach. A block whose largest
    weight, together with the largest ones of all other terms, stays below that holds no
    document of the answer, nor does any other block of such a document fall, so what is left
    is scored in full. Scores are compared to ``places`` places, ties go to the smaller document.
    """
    if k > BEST:
        raise ValueError(f"the index keeps {BEST} weights of a term")
    spark = questions.sparkSession
    asked = questions.select("question", F.explode(F.array_distinct("terms")).alias("term"))
    known = asked.join(spark.read.parquet(f"{path}/terms"), "term")
    bounds = known.groupBy("question").agg(
        F.sum(F.col("idf") * F.col("best")[0]).alias("all"),
        F.max(F.coalesce(F.col("idf") * F.try_element_at("best", F.lit(k)), F.lit(0.0))).alias("reached"),
    )
    wanted = known.join(bounds, "question").select(
        "question", "term", "idf",
        # What a block must hold itself; a little less, as sums are rounded.
        ((F.col("reached") - F.col("all")) / F.col("idf") + F.col("best")[0] - 1e-9).alias("least"),
    )
    # Written, so its size is known: words of few questions are told to all tasks, and no block moves.
    wanted = staged(wanted, "wanted")
    blocks = spark.read.parquet(f"{path}/blocks")
    left = blocks.join(wanted, "term").where(F.col("most") >= F.col("least"))
    scored = left.select("question", "idf", F.explode("postings").alias("p")).groupBy("question", F.col("p.doc").alias("doc")).agg(
        F.round(F.sum(F.col("idf") * F.col("p.weight")), places).alias("score")
    )
    order = Window.partitionBy("question").orderBy(F.desc("score"), "doc")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("question", "doc", "rank", "score")
