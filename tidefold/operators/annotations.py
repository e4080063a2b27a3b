"""Nested annotation tasks to rows: label forms, cancelled and malformed annotations, one row for each event and label.

A task is a row with its JSON text; shapes vary from task to task, so each level is parsed as text or as a list of texts,
and what doesn't fit is left out, never an error. All of it is one map over rows but for the global row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import row_numbers
from .scratch import written

TASK = "id string, data string, audio string, file_upload string, label string, annotations string"
EVENT = "start string, end string, channel string, labels string, choices string"
EVENT_FIELDS = EVENT.replace(" string", ":string")


def _items(text: Column) -> Column:
    """The elements of a JSON list as texts; null where it is no list."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def _is_map(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))


def tasks_of(documents: DataFrame, body: str = "value") -> DataFrame:
    """SRC3: rows (file_index, task) of texts that are each a JSON list of tasks; a byte order mark is ignored.

    A text that is no list raises. Elements keep their place; those that aren't maps are rows without events.
    """
    text = F.regexp_replace(body, "^\\ufeff", "")
    items = F.coalesce(_items(text), F.raise_error(F.lit("annotations must be a JSON list")).cast("array<string>"))
    return documents.select(F.posexplode(items).alias("file_index", "task")).withColumn("file_index", F.col("file_index").cast("long"))


def normal_labels(raw: Column) -> Column:
    """SF12: null is no label, a list its elements that are neither null nor empty, anything else the one label that it is."""
    listed = F.filter(_items(raw), lambda x: x.isNotNull() & (x != ""))
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(listed.isNotNull(), listed).otherwise(F.array(raw))


def _truthy(text: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(text)).isin("", "false", "null", "0", "0.0", "[]", "{}"), F.lit(False))


def _event(text: Column) -> Column:
    return F.from_json(text, EVENT)


def events_of(task: Column) -> Column:
    """FIL7, SF14: a task's events in order: (start, end, channel, labels) as texts.

    A top-level list `label` is preferred, its maps are the events. Otherwise the results of all annotations that aren't
    cancelled, whose value is a map with a start and an end; their labels are `labels`, or `choices` where those say nothing.
    """
    direct = F.filter(_items(task["label"]), _is_map)
    notes = F.filter(F.coalesce(_items(task["annotations"]), F.array().cast("array<string>")), _is_map)
    notes = F.filter(F.transform(notes, lambda n: F.from_json(n, "was_cancelled string, result string")), lambda n: ~_truthy(n["was_cancelled"]))
    results = F.filter(F.flatten(F.transform(notes, lambda n: F.coalesce(_items(n["result"]), F.array().cast("array<string>")))), _is_map)
    values = F.transform(results, lambda r: F.from_json(r, f"value struct<{EVENT_FIELDS}>")["value"])  # null where it is no map
    whole = F.filter(values, lambda e: e["start"].isNotNull() & e["end"].isNotNull())
    named = F.transform(whole, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["channel"].alias("channel"), F.when(_truthy(e["labels"]), e["labels"]).otherwise(e["choices"]).alias("labels")))
    zero = F.lit("0")
    plain = F.transform(F.transform(direct, _event), lambda e: F.struct(F.coalesce(e["start"], zero).alias("start"), F.coalesce(e["end"], zero).alias("end"), e["channel"].alias("channel"), e["labels"].alias("labels")))
    return F.coalesce(plain, named)


def audio_of(task: Column) -> Column:
    """The first name that a task gives: data.audio, data.file, data.wav, audio, file_upload; with forward slashes."""
    data = F.from_json(F.when(_is_map(task["data"]), task["data"]), "audio string, file string, wav string")
    given = F.filter(F.array(data["audio"], data["file"], data["wav"], task["audio"], task["file_upload"]), lambda x: x.isNotNull() & (x != ""))
    return F.translate(F.coalesce(F.get(given, 0), F.lit("")), "\\", "/")


def flatten(tasks: DataFrame, joined: bool = False, separator: str = "|", unknown: str = "unknown", numbered: bool = True) -> DataFrame:
    """PRJ2, PRJ3: a row for each event and label of tasks (file_index, task), or for each event with its labels joined.

    Columns: row_id (running over the whole table by file, event and label), file_index, event_index, label_index (not where
    joined), source_id, audio, start_s, end_s, duration_s (0 at least), channel, label, label_count. An event without labels
    has the unknown one. A start or end that is no number is null, and so is the duration. Numbering sorts the whole table;
    without `numbered` there is no row_id, and all of it is one map. Tasks are parsed once.
    """
    parsed = tasks.withColumn("t", F.when(F.col("task").rlike(r"^\s*\{"), F.from_json("task", TASK)))  # what is no map costs an error each
    rows = parsed.select("file_index", F.col("t.id").alias("source_id"), audio_of(F.col("t")).alias("audio"), F.posexplode(events_of(F.col("t"))).alias("event_index", "e"))
    labels = normal_labels(F.col("e.labels"))
    rows = rows.withColumn("labels", F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(unknown))))
    start, end = (F.expr(f"try_cast(e.{c} as double)") for c in ("start", "end"))
    head = ["file_index", F.col("event_index").cast("long").alias("event_index")]
    label = [F.array_join("labels", separator).alias("label")] if joined else [F.posexplode("labels").alias("label_index", "label")]
    rest = ["source_id", "audio", start.alias("start_s"), end.alias("end_s"), F.when(end - start > 0, end - start).when(start.isNotNull() & end.isNotNull(), 0.0).alias("duration_s"), F.expr("try_cast(e.channel as bigint)").alias("channel")]
    flat = rows.select(*head, *rest, *label, F.size("labels").alias("label_count"))
    order = ["file_index", "event_index"] + ([] if joined else ["label_index"])
    if not joined:
        flat = flat.withColumn("label_index", F.col("label_index").cast("long"))
    flat = row_numbers(written(flat), order, "row_id") if numbered else flat
    return flat.select(*(["row_id"] if numbered else []), *order, "source_id", "audio", "start_s", "end_s", "duration_s", "channel", "label", "label_count")
