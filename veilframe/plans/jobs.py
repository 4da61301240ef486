"""The jobs users call: mask, restore, report, audit."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import text as T
from veilframe.operators import detect as D
from veilframe.operators import entities as E
from veilframe.operators.fake_tokens import faked
from veilframe.operators.gazetteer import gazetteer_spans
from veilframe.operators.masking import KEY, apply_tokens, used_tokens
from veilframe.operators.names import case_forms, token_in_case
from veilframe.operators.restoring import restore_tokens
from veilframe.shared import staged
from veilframe.sources import leaves
from veilframe.sources import sessions as Sess

MODES = ("tags", "fake")


@dataclass(frozen=True)
class MaskResult:
    """``masked``: the input with masked_text, spans_found, map_size and KEY.
    ``entities``: every value of these texts with its token. ``used``: which text
    uses which token. ``forms``: tokens of case forms, or none.
    """

    masked: DataFrame
    entities: DataFrame
    used: DataFrame
    forms: DataFrame | None = None

    @property
    def token_map(self) -> DataFrame:
        """(group_id, token, original), case forms included."""
        rows = self.entities.select(
            "group_id", "token", "original", F.lit(1).alias("_r"), "doc_seq", "unit_no"
        )
        if self.forms is None:
            return rows.select("group_id", "token", "original")
        more = self.forms.select(
            "group_id",
            "token",
            "original",
            F.lit(0).alias("_r"),
            F.lit(0).cast("bigint").alias("doc_seq"),
            F.lit(0).alias("unit_no"),
        )
        return E.last_written(
            rows.unionByName(more), ["group_id"], ["_r", "doc_seq", "unit_no", "original"]
        )


def _keyed(
    df: DataFrame, text: str, seq: str, group: str | None, unit: str | None
) -> DataFrame:
    """Add KEY. A text that belongs to no group is a group of its own."""
    own = F.concat(F.lit("text-"), F.col(seq).cast("string"))
    group_id = own if group is None else F.coalesce(F.col(group).cast("string"), own)
    return df.withColumns(
        {
            "group_id": group_id,
            "doc_seq": F.col(seq).cast("bigint"),
            "unit_no": F.lit(0) if unit is None else F.col(unit).cast("int"),
        }
    )


def mask(
    df: DataFrame,
    text: str = "text",
    seq: str = "doc_seq",
    group: str | None = None,
    unit: str | None = None,
    mode: str = "tags",
    lang: str = "auto",
    secret: str | None = None,
    existing: DataFrame | None = None,
    gazetteer: DataFrame | None = None,
    name_forms: DataFrame | None = None,
    names: DataFrame | None = None,
    left_to_right: bool = False,
    case_sensitive: bool = False,
    reuse: bool = False,
) -> MaskResult:
    """Replace every identifier of a text column by a token of its group.

    A null ``seq`` fails the job. ``seq`` orders the texts of a group and, with ``unit``, tells them apart.
    ``mode`` is ``tags`` or ``fake`` (needs ``secret``). ``existing`` is the
    entity table of earlier runs of the same groups; a group has one writer at a
    time. ``gazetteer`` adds names from a list, ``names`` spans found elsewhere
    (KEY, spans). ``reuse`` masks equal texts of a group once.

    The texts are read and searched once: what has no span is written in its
    final form, and only the rest is shuffled.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "fake" and not secret:
        raise ValueError("fake tokens need a secret")
    units = _keyed(df, text, seq, group, unit)
    missing = F.raise_error(f"{seq} is null: texts cannot be told apart")
    units = units.withColumn("doc_seq", F.when(F.col("doc_seq").isNull(), missing).otherwise(F.col("doc_seq")))
    if reuse:
        return _mask_once(
            units, text, mode=mode, lang=lang, secret=secret, existing=existing,
            gazetteer=gazetteer, name_forms=name_forms, names=names,
            left_to_right=left_to_right, case_sensitive=case_sensitive,
        )
    extra = None
    if gazetteer is not None:
        names = gazetteer_spans(units.select(*KEY, F.col(text).alias("text")), gazetteer, KEY)
    if names is not None:
        units = units.join(names.withColumnRenamed("spans", "_names"), KEY, "left")
        extra = "_names"
    searched = D.with_parts(units, text, lang, extra, case_sensitive).drop("_names")
    searched = searched.withColumn("hit", F.expr("exists(parts, c -> size(c.spans) > 0)"))
    searched = staged(searched, "searched", partition_by=("hit",))
    hits = searched.where("hit")
    found = E.mentions(hits, D.spans_of("parts"))
    first = E.first_mentions(found, left_to_right)
    numbered = E.number_entities(first, existing)
    if mode == "tags":
        fresh = E.tagged(numbered)
    else:
        fresh = faked(staged(numbered, "numbered"), secret, existing)
    columns = ["group_id", "norm", "ty", "original", "token", "n", "doc_seq", "unit_no", "pass", "nst"]
    fresh = staged(fresh.select(columns), "entities")
    forms = None
    if name_forms is not None and mode == "fake":
        people = fresh.where(F.col("ty") == "PERSON")
        forms = staged(case_forms(people, name_forms), "forms")
        fresh = token_in_case(fresh, forms).select(columns)
    entities = fresh
    if existing is not None:
        entities = fresh.unionByName(E.known_values(found, existing), allowMissingColumns=True)
    used = used_tokens(hits, entities)
    done = apply_tokens(hits, entities, text, "masked_text")
    clean = searched.where("not hit").withColumns(
        {"masked_text": F.col(text), "map_size": F.lit(0)}
    )
    count = F.expr("aggregate(parts, 0, (n, c) -> n + size(c.spans))")
    masked = done.unionByName(clean).withColumn("spans_found", count)
    return MaskResult(masked.drop("parts", "hit"), entities, used, forms)


def _mask_once(units: DataFrame, text: str, **options) -> MaskResult:
    """Mask one of each set of equal texts in a group, and share the result."""
    digest = F.sha2(F.col(text), 256)
    marked = units.withColumn("_digest", digest)
    chosen = (
        marked.groupBy("group_id", "_digest")
        .agg(F.min(F.struct("doc_seq", "unit_no")).alias("m"))
        .select("group_id", "m.doc_seq", "m.unit_no")
    )
    once = marked.join(chosen, KEY, "left_semi").select(*KEY, "_digest", text)
    result = mask(once, text, "doc_seq", "group_id", "unit_no", **options)
    shared = result.masked.select(
        "group_id", "_digest", "masked_text", "map_size", "spans_found"
    )
    masked = marked.join(shared, ["group_id", "_digest"], "left").drop("_digest")
    return MaskResult(masked, result.entities, result.used, result.forms)


def mask_rows(
    df: DataFrame, strings: Column, seq: str, group: str | None = None, **options
) -> tuple[DataFrame, MaskResult]:
    """Mask all strings of a row together.

    ``strings`` is an array of the row's strings in document order. Adds
    ``changes``, a map from each changed string to its masked form; equal strings
    of a row have equal masks, so the map can be applied anywhere in the row.
    """
    rows = _keyed(df, seq, seq, group, None).drop("unit_no")
    units = rows.select("group_id", "doc_seq", F.posexplode(strings).alias("unit_no", "text"))
    units = units.where(f"not ({T.is_blank('text')})")
    result = mask(units, "text", "doc_seq", "group_id", "unit_no", **options)
    return _with_changes(rows, result.masked, "masked_text"), result


def restore_rows(
    df: DataFrame,
    strings: Column,
    seq: str,
    token_map: DataFrame,
    group: str | None = None,
) -> DataFrame:
    """The same with originals put back: adds ``changes`` from token to text."""
    rows = _keyed(df, seq, seq, group, None).drop("unit_no")
    units = rows.select("group_id", "doc_seq", F.posexplode(strings).alias("unit_no", "text"))
    back = restore_tokens(
        units.where(f"not ({T.is_blank('text')})"),
        "text", token_map, ["group_id"], ["doc_seq", "unit_no"], "restored_text",
    )
    return _with_changes(rows, back, "restored_text")


def _with_changes(rows: DataFrame, units: DataFrame, new: str) -> DataFrame:
    # A set, as telling the pairs of a list apart compares each with all before it.
    pairs = F.collect_set(F.struct(F.col("text").alias("key"), F.col(new).alias("value")))
    changes = (
        units.where(F.col(new) != F.col("text"))
        .groupBy("group_id", "doc_seq")
        .agg(F.map_from_entries(pairs).alias("changes"))
    )
    return rows.join(changes, ["group_id", "doc_seq"], "left")


def changed(value: Column, changes: Column) -> Column:
    return F.coalesce(F.element_at(changes, value), value)


def _strings(df: DataFrame, columns: Sequence[str]) -> Column:
    """The strings of some columns of a row, nested ones included; numbers as text."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numbers = {c for c in columns if not leaves.holds_strings(kinds[c])}

    def of(c: str) -> Column:
        if c in numbers:
            return F.filter(F.array(F.col(c).cast("string")), lambda x: x.isNotNull())
        return leaves.strings_of(kinds[c], F.col(c))

    return F.concat(*[of(c) for c in columns]) if columns else F.array().cast("array<string>")


def mask_table(
    df: DataFrame, seq: str, group: str | None = None, columns: Sequence[str] | None = None, **options
) -> tuple[DataFrame, MaskResult]:
    """Mask every string of a table, and numbers under a sensitive header as text.

    Strings inside structs, arrays and maps are masked where they are; keys of maps and the
    names of fields stay. A numeric column that is masked comes back as string.
    """
    chosen = list(columns or maskable_columns(df, keep=(seq, group)))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows, result = mask_rows(df, _strings(df, chosen), seq, group, **options)

    def cell(name: str) -> Column:
        if name not in chosen:
            return F.col(name)
        if leaves.holds_strings(kinds[name]):
            return leaves.with_changes(kinds[name], F.col(name), F.col("changes")).alias(name)
        masked = changed(F.col(name).cast("string"), F.col("changes"))
        return T.numeric_round_trip(masked).alias(name)

    return rows.select(*[cell(c) for c in df.columns]), result


def maskable_columns(df: DataFrame, keep: Sequence[str | None] = ()) -> list[str]:
    numbers = {"byte", "short", "integer", "long", "float", "double", "decimal"}
    return [
        f.name
        for f in df.schema.fields
        if f.name not in keep
        and (
            leaves.holds_strings(f.dataType)
            or (f.dataType.typeName() in numbers and T.is_sensitive_header(f.name))
        )
    ]


def restore_table(
    df: DataFrame, seq: str, token_map: DataFrame, group: str | None = None
) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    chosen = [c for c in df.columns if leaves.holds_strings(kinds[c]) and c not in (seq, group)]
    rows = restore_rows(df, _strings(df, chosen), seq, token_map, group)
    return rows.select(
        *[
            leaves.with_changes(kinds[c], F.col(c), F.col("changes")).alias(c) if c in chosen else F.col(c)
            for c in df.columns
        ]
    )


def restore(
    df: DataFrame, text: str, ids: str, table: DataFrame, secret: str, key: Sequence[str],
    now: Column | None = None, ttl_hours: int | None = Sess.TTL_HOURS,
) -> DataFrame:
    """Restore texts by the identifier list each one carries.

    Adds restored_text, status (404 where no identifier is known; the text is
    then left alone). Sessions that are older than ``ttl_hours`` at ``now`` (the current
    time) are not known any more; with None they never end.
    """
    if ttl_hours is not None:
        table = Sess.live(table, F.current_timestamp() if now is None else now, ttl_hours)
    asked = df.withColumn("ids", F.col(ids))
    requests = asked.select("ids")
    token_map = Sess.resolved_map(requests, "ids", table, secret)
    status = Sess.resolve_status(requests, "ids", table).select("ids", "status")
    back = restore_tokens(asked, text, staged(token_map, "maps"), ["ids"], list(key), "restored_text")
    return back.join(status, "ids", "left").drop(*([] if ids == "ids" else ["ids"]))


def restore_group(
    df: DataFrame, text: str, token_map: DataFrame, key: Sequence[str] = ("doc_seq", "unit_no")
) -> DataFrame:
    """Restore texts that carry their group_id with the group's token map.

    The texts are written first: they are read for their tokens and once more to put originals in.
    """
    df = staged(df, "replies")
    return restore_tokens(df, text, token_map, ["group_id"], list(key), "restored_text")


def mask_batch(df: DataFrame, group_id: str | None = None, **options) -> tuple[str, MaskResult]:
    """All texts under one group, in the order of their number."""
    group_id = group_id or f"batch_{os.urandom(4).hex()}"
    return group_id, mask(df.withColumn("group_id", F.lit(group_id)), group="group_id", **options)


@dataclass
class Project:
    """A group of texts and files that share their tokens."""

    spark: SparkSession
    group_id: str
    path: str
    secret: str

    def _existing(self) -> DataFrame | None:
        from veilframe.sources.sinks import read_entities

        table = read_entities(self.spark, f"{self.path}/entities", self.secret)
        if table is None:
            return None
        return table.where(F.col("group_id") == self.group_id)

    def mask(self, df: DataFrame, **options) -> DataFrame:
        from veilframe.sources.sinks import append_entities

        options.setdefault("secret", self.secret)
        _, result = mask_batch(df, self.group_id, existing=self._existing(), **options)
        masked = staged(result.masked, "masked")
        append_entities(result.entities.where(F.col("doc_seq").isNotNull()), f"{self.path}/entities", self.secret)
        return masked

    def restore(self, df: DataFrame, text: str = "text", key: Sequence[str] = ("doc_seq",)) -> DataFrame:
        existing = self._existing()
        if existing is None:
            raise LookupError(f"group {self.group_id} is not known")
        return restore_group(df.withColumn("group_id", F.lit(self.group_id)), text, existing, key)


def scan_report(
    df: DataFrame, text: str = "text", lang: str = "auto", by: Sequence[str] = ()
) -> DataFrame:
    """Hits per type and language, without masking anything."""
    spoken = D.effective_lang(f"`{text}`", lang)
    texts = df.select(*by, F.expr(spoken).alias("text_lang"), F.col(text).alias("text"))
    found = D.found_in(texts, [*by, "text_lang"], "text", "text_lang")
    return found.groupBy(*by, "text_lang", "ty").agg(
        F.count(F.lit(1)).alias("hits")
    )


def audit(
    texts: DataFrame, used: DataFrame, key: Sequence[str], user: str = "user_token",
    text: str = "masked_text", at: Column | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Audit events: who hid how many values, and how the text begins.

    The preview is taken from the masked text unless told otherwise.
    """
    hidden = used.groupBy(*key).agg(F.count_distinct("original").alias("hidden_entities_count"))
    at = F.current_timestamp() if at is None else at
    return texts.join(hidden, list(key), "left").select(
        *keep,
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        T.shortened_token(F.col(user)).alias("token"),
        F.lit("ANONYMIZED_REQUEST").alias("action"),
        F.coalesce("hidden_entities_count", F.lit(0)).alias("hidden_entities_count"),
        T.preview(F.col(text)).alias("original_text_preview"),
    )


def mask_files(spark: SparkSession, path: str, out: str, **options):
    from veilframe.plans.files import mask_files as run

    return run(spark, path, out, **options)


def restore_files(spark: SparkSession, path: str, out: str, **options):
    from veilframe.plans.files import restore_files as run

    return run(spark, path, out, **options)
