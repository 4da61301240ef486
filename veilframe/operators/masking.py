"""Put tokens into texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.spans import running, splice
from veilframe.functions.text import let

KEY = ["group_id", "doc_seq", "unit_no"]


def used_tokens(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """Which part of which text uses which token: KEY, part, norm, token, original.

    A part names a value once, however often it repeats it. Frequent values
    make large join partitions, which adaptive execution splits.
    """
    named = F.expr(
        "flatten(transform(parts, (c, i) -> transform(array_distinct(transform(c.spans, "
        "s -> s.norm)), n -> named_struct('part', i, 'norm', n))))"
    )
    values = hits.select(*KEY, F.explode(named).alias("u")).select(*KEY, "u.part", "u.norm")
    return values.join(
        entities.select("group_id", "norm", "token", "original"), ["group_id", "norm"]
    ).select(*KEY, "part", "norm", "token", "original")


def apply_tokens(hits: DataFrame, entities: DataFrame, text: str, out: str) -> DataFrame:
    """Texts with spans, each span replaced by the token of its value.

    A span is known by its number in the text, so the tokens of a text come back in the order of
    its spans, and none is looked up among all others of a long text. A key that repeats fails the job.
    """
    norms = F.expr("flatten(transform(parts, c -> transform(c.spans, s -> s.norm)))")
    # Texts of one key are told apart by their values, as far as they have others.
    told = hits.withColumn("_h", F.xxhash64(norms))
    each = told.select(*KEY, "_h", F.posexplode(norms).alias("i", "norm"))
    named = each.join(entities.select("group_id", "norm", "token"), ["group_id", "norm"])
    per_text = named.groupBy(*KEY, "_h").agg(F.collect_list(F.struct("i", "token")).alias("_tokens"))
    pieces = "zip_with(c.spans, slice(ts, o + 1, size(c.spans)), (s, w) -> named_struct('st', s.st, 'ln', s.ln, 'rep', w))"
    filled = f"zip_with(parts, os, (c, o) -> {splice(f'substring(`{text}`, c.base + 1, c.len)', pieces)})"
    sizes = running("parts", "n", "size(x.spans)")
    whole = let("sort_array(_tokens).token", "ts", let(sizes, "os", f"array_join({filled}, '')"))
    count = "aggregate(parts, 0, (n, c) -> n + size(c.spans))"
    repeated = "raise_error('a text of this group, number and unit repeats')"
    return (
        told.join(per_text, [*KEY, "_h"])
        .withColumn(out, F.expr(f"if(size(_tokens) = {count}, {whole}, {repeated})"))
        .withColumn("map_size", F.expr("size(array_distinct(_tokens.token))"))
        .drop("_tokens", "_h")
    )
