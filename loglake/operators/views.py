"""Saved view state as data: highlights, annotations, filters, presets."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loglake.functions.text import quote_literal, quote_replacement
from loglake.functions.times import bucket_keys, bucket_label
from loglake.operators.pages import correlate, search
from loglake.operators.predicates import combine, entry_filter


# ---- highlights --------------------------------------------------------------


def rules_by_upload(rules: DataFrame) -> DataFrame:
    """The highlight rules of each upload as one array in order of creation."""
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "id", "text", "color")))
    return rules.where(F.col("text") != "").groupBy("upload_id").agg(ordered.alias("rules"))


def _rule_array(rules: Sequence[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("text"), F.lit(c).alias("color")) for t, c in rules if t])


def first_rule_color(haystack: Column, rules: Column) -> Column:
    """Colour of the first rule whose text occurs, upper and lower case alike."""
    low = F.lower(haystack)
    hits = F.filter(rules, lambda r: F.contains(low, F.lower(r["text"])))
    return F.get(hits, 0)["color"]


def entry_haystack() -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("message", "raw_line", "component", "level")])


def highlight(entries: DataFrame, rules: DataFrame | Sequence[tuple[str, str]]) -> DataFrame:
    """Entries with the colour of the first matching rule, NULL when none matches.

    Rules given as a list become literals; a rule table is first folded to one array
    per upload and equi-joined, so no row is multiplied by the number of rules.
    """
    if not isinstance(rules, DataFrame):
        if not any(text for text, _ in rules):
            return entries.withColumn("color", F.lit(None).cast("string"))
        low = F.lower(entry_haystack())
        color = F.coalesce(*[F.when(F.contains(low, F.lit(t.lower())), c) for t, c in rules if t])
        return entries.withColumn("color", color)
    joined = entries.join(rules_by_upload(rules), "upload_id", "left")
    return joined.withColumn("color", first_rule_color(entry_haystack(), F.col("rules"))).drop("rules")


def mark_text(text: Column, rules: Column | Sequence[tuple[str, str]]) -> Column:
    """Wrap every match of each rule in a mark with the rule's colour, rule by rule."""
    if not isinstance(rules, Column):
        if not any(t for t, _ in rules):
            return F.coalesce(text, F.lit(""))
        rules = _rule_array(rules)

    def apply(marked, rule):
        opening = F.concat(F.lit('<mark style="background:'), quote_replacement(rule["color"]), F.lit('40">$0</mark>'))
        return F.regexp_replace(marked, F.concat(F.lit("(?iu)"), quote_literal(rule["text"])), opening)

    return F.aggregate(rules, F.coalesce(text, F.lit("")), apply)


def highlight_markup(
    entries: DataFrame, rules: DataFrame | Sequence[tuple[str, str]], column: str = "message"
) -> DataFrame:
    """Entries with ``marked``: the column's text with all rules marked."""
    if not isinstance(rules, DataFrame):
        return entries.withColumn("marked", mark_text(F.col(column), rules))
    joined = entries.join(rules_by_upload(rules), "upload_id", "left")
    marked = F.when(F.col("rules").isNull(), F.coalesce(column, F.lit(""))).otherwise(
        mark_text(F.col(column), F.col("rules"))
    )
    return joined.withColumn("marked", marked).drop("rules")


# ---- annotations -------------------------------------------------------------


def resolve_annotations(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """Annotations with the name of their file; an entry pin without a file dangles."""
    names = files.select(F.col("id").alias("file_id"), "filename")
    joined = annotations.join(names, "file_id", "left")
    return joined.withColumn("dangling", F.col("ts").isNull() & F.col("filename").isNull())


def annotation_markers(annotations: DataFrame, hist: DataFrame, unit: str = "hour") -> DataFrame:
    """Time pins that fall into a bucket the histogram shows."""
    pins = annotations.where(F.col("ts").isNotNull())
    keys = bucket_keys(F.col("ts"), unit)
    pins = pins.select(F.col("id").alias("annotation_id"), bucket_label(keys, unit).alias("bucket"), "color", "note")
    return pins.join(hist.select("bucket").distinct(), "bucket").select("annotation_id", "bucket", "color", "note")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def validate_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations with ``error``: NULL for a valid one, else why it is refused.

    A pin is either a time or a file together with a record.
    """
    has_file, has_entry = _filled("file_id"), F.col("entry_id").isNotNull()
    entry_pin, time_pin = has_file & has_entry, F.col("ts").isNotNull()
    error = (
        F.when(~_filled("note") | ~_filled("color"), "note and color are required")
        .when(entry_pin & time_pin, "only one kind of pin is allowed")
        .when(~entry_pin & ~time_pin, "either ts or file_id with entry_id is required")
        .when(has_file != has_entry, "file_id and entry_id must be given together")
    )
    return annotations.withColumn("error", error)


# The fields each kind of saved rule must have.
REQUIRED_FIELDS = {
    "filters": ("kind", "rule"),
    "highlights": ("text", "color"),
    "presets": ("name", "snapshot"),
}


def validate_rules(rules: DataFrame, kind: str) -> DataFrame:
    """Saved filters, highlights or presets with ``error`` for missing fields."""
    first, second = REQUIRED_FIELDS[kind]
    complete = _filled(first) & _filled(second)
    return rules.withColumn("error", F.when(~complete, f"{first} and {second} are required"))


def clear_view_state(filters: DataFrame, highlights: DataFrame, upload_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filters and highlights without those of the given uploads."""
    ids = upload_ids.select("upload_id")
    return filters.join(ids, "upload_id", "left_anti"), highlights.join(ids, "upload_id", "left_anti")


# ---- saved filters and presets -----------------------------------------------


def filter_predicates(saved: Sequence[tuple[str, str]]) -> tuple[Column | None, list[Column]]:
    """The time window and one predicate per search of the saved filters, given as (kind, rule JSON).

    A later timeline rule replaces an earlier one, as there is one time window.
    """
    searches, window = [], None
    for kind, text in saved:
        rule = json.loads(text)
        if kind == "search":
            searches.append(entry_filter(
                files=rule.get("files"), q=rule.get("q"), fields=rule.get("fields") or "all",
                mode=rule.get("mode") or "text", attrs=rule.get("attrs"),
            ))
        elif kind == "timeline":
            window = entry_filter(files=rule.get("files"), ts_from=rule.get("from"), ts_to=rule.get("to"))
    return window, searches


def apply_filters(entries: DataFrame, saved: Sequence[tuple[str, str]], how: str = "and") -> DataFrame:
    """Entries inside the window of a view that pass its searches (all of them, or any with ``or``)."""
    window, searches = filter_predicates(saved)
    hits = entries.where(combine(searches, how))
    return hits if window is None else hits.where(window)


def apply_preset(
    entries: DataFrame, files: DataFrame, upload_id: str | None, snapshot: str | dict, *, offset: int = 0
) -> DataFrame:
    """The page a preset shows: its files, window, searches, order, size and colours."""
    snap = json.loads(snapshot) if isinstance(snapshot, str) else snapshot
    window = snap.get("timeline") or {}
    saved = [entry_filter(ts_from=window.get("from"), ts_to=window.get("to"))]
    for rule in snap.get("searchFilters") or []:
        saved.append(entry_filter(
            q=rule.get("q"), fields=rule.get("fields") or "all",
            mode=rule.get("mode") or "text", attrs=rule.get("attrs"),
        ))
    kept = entries.where(combine(saved))
    paging = dict(files=snap.get("selectedFileIds"), limit=snap.get("pageSize"), offset=offset)
    if snap.get("correlateMode"):
        items = correlate(kept, files, upload_id, **paging).items
    else:
        items = search(kept, files, upload_id, **paging)
    return highlight(items, [(h["text"], h["color"]) for h in snap.get("highlights") or []])
