"""Queries: filters, projections, string and path functions, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, scalars
from ..operators import dedup, filters
from ..operators.frames import running_totals
from .registry import register
from .views import EV, events, table

_BASE = "string_split(url, '/')[-1]"


@register("sanitize_stem", "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS stem FROM pages")
def sanitize_stem(spark, d):
    """SF1."""
    return table(spark, d, "pages").select("page_id", paths.sanitize_stem("url").alias("stem"))


@register("path_parts", rf"SELECT page_id, {_BASE} AS base, regexp_replace({_BASE}, '^(.+)\.[^.]*$', '\1') AS stem, lower(regexp_extract({_BASE}, '.(\.[^.]+)$', 1)) AS suffix FROM pages")
def path_parts(spark, d):
    """SF2."""
    return table(spark, d, "pages").select("page_id", paths.basename("url").alias("base"), paths.stem("url").alias("stem"), paths.suffix("url").alias("suffix"))


@register("label_from_name", "SELECT s_suppkey, nullif(regexp_extract(s_name, '^(?:Supplier#0*([0-9]+))', 1), '') AS label FROM supplier")
def label_from_name(spark, d):
    """SF3."""
    return table(spark, d, "supplier").select("s_suppkey", paths.label_from_name("s_name", "Supplier#0*([0-9]+)").alias("label"))


@register("class_key", f"SELECT page_id, CASE WHEN regexp_extract(url, '([^/]+)/[^/]*$', 1) = 'noise' OR regexp_extract(url, '([^/]+)/[^/]*$', 1) LIKE 'K%' THEN regexp_extract(url, '([^/]+)/[^/]*$', 1) ELSE split_part({_BASE}, '-', 1) END AS key FROM pages")
def class_key(spark, d):
    """SF4."""
    return table(spark, d, "pages").select("page_id", paths.class_key("url").alias("key"))


@register("upload_prefix", "SELECT DISTINCT o_orderpriority AS name, CASE WHEN regexp_replace(o_orderpriority, '^[^-]*-', '') = '' THEN o_orderpriority ELSE regexp_replace(o_orderpriority, '^[^-]*-', '') END AS stripped FROM orders")
def upload_prefix(spark, d):
    """SF5."""
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("name")).distinct().withColumn("stripped", paths.strip_upload_prefix("name"))


@register("prefix_normalise", "SELECT page_id, rtrim(regexp_replace(url, '^https?://', ''), '/') AS key FROM pages")
def prefix_normalise(spark, d):
    """SF6."""
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/+$", "").alias("key"))


@register("subfolder_after_prefix", r"""WITH r AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS r FROM pages)
SELECT page_id, CASE WHEN contains(r, '/') THEN coalesce(nullif(split_part(r, '/', 1), ''), '__root__') ELSE '__root__' END AS folder FROM r""")
def subfolder_after_prefix(spark, d):
    """SF7."""
    return table(spark, d, "pages").select("page_id", paths.subfolder_after("url", "https?://[^/]+/").alias("folder"))


@register("year_month_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month FROM orders")
def year_month_key(spark, d):
    """SF8: year and month out of object keys."""
    key = F.concat_ws("/", F.lit("tier"), F.year("o_orderdate"), F.month("o_orderdate"), F.concat(F.lit("f"), "o_orderkey", F.lit(".wav")))
    year, month = paths.year_month(F.col("key"))
    return table(spark, d, "orders").select("o_orderkey", key.alias("key")).select("o_orderkey", year.alias("year"), month.alias("month"))


@register("audio_to_label_path", "SELECT p_partkey, '/data/lbl/' || p_name || '/' || p_partkey || '.h5' AS path FROM part")
def audio_to_label_path(spark, d):
    """SF9."""
    audio = F.concat(F.lit("/data/wav/"), "p_name", F.lit("/"), "p_partkey", F.lit(".flac"))
    return table(spark, d, "part").select("p_partkey", paths.label_path(audio).alias("path"))


@register("chunk_suffix", "SELECT s_suppkey, 'rec_' || s_suppkey AS stem FROM supplier")
def chunk_suffix(spark, d):
    """SF10."""
    return table(spark, d, "supplier").select("s_suppkey", paths.strip_chunk_suffix(F.concat(F.lit("rec_"), "s_suppkey", F.lit("_"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"))).alias("stem"))


@register("relative_path", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS path FROM pages")
def relative_path(spark, d):
    """SF11."""
    return table(spark, d, "pages").select("page_id", F.when(F.col("url").startswith("https://"), F.substring("url", F.lit(9), F.length("url"))).otherwise(F.col("url")).alias("path"))


@register("candidate_keys", f"SELECT page_id, CASE WHEN {_BASE} IN ('', url) THEN url ELSE url || '|' || {_BASE} END AS keys FROM pages")
def candidate_keys(spark, d):
    """SF13: distinct non-empty candidates in order."""
    keys = F.array_distinct(F.filter(F.array("url", paths.basename("url")), lambda x: x != ""))
    return table(spark, d, "pages").select("page_id", F.array_join(keys, "|").alias("keys"))


@register("iso_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso FROM events")
def iso_utc(spark, d):
    """SF15."""
    return table(spark, d, "events").select("event_id", scalars.iso_utc("ts").alias("iso"))


@register("nullish_parse", "SELECT event_id, nullif(nullif(trim(CASE WHEN event_type = 'view' THEN ' None ' WHEN event_type = 'click' THEN '' ELSE event_type END), ''), 'None') AS v FROM events")
def nullish_parse(spark, d):
    """SF16."""
    raw = F.when(F.col("event_type") == "view", " None ").when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", scalars.nullish(raw).alias("v"))


@register("size_duration", "SELECT doc_id, round(n_chars / (16000.0 * 2), 8) AS seconds FROM documents")
def size_duration(spark, d):
    """SF18."""
    return table(spark, d, "documents").select("doc_id", F.round(scalars.size_duration("n_chars", 16000, 1, 2), 8).alias("seconds"))


@register("folder_coalesce", "SELECT event_id, coalesce(nullif(trim(CASE WHEN event_type = 'click' THEN ' ' ELSE event_type END), ''), 'user' || user_id, 'unknown') AS folder FROM events")
def folder_coalesce(spark, d):
    """SF33."""
    given = F.when(F.col("event_type") == "click", " ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.nullif(F.trim(given), F.lit("")), F.concat(F.lit("user"), "user_id"), F.lit("unknown")).alias("folder"))


@register("config_coalesce", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS v FROM events")
def config_coalesce(spark, d):
    """SF31."""
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k")).alias("v"))


@register("all_equal", "SELECT user_id, count(DISTINCT event_type) = 1 AS same FROM events GROUP BY user_id")
def all_equal(spark, d):
    """SF32: by a minimum and a maximum, without a distinct count."""
    return table(spark, d, "events").groupBy("user_id").agg((F.min("event_type") == F.max("event_type")).alias("same"))


@register("tolerant_parse", """WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{"duration": "abc"}' WHEN event_id % 11 = 0 THEN '{bad' ELSE '{"duration": ' || value || ', "rate": 16000}' END AS j, value FROM events)
SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE round_even(value * 16000, 0)::BIGINT END AS samples FROM r""")
def tolerant_parse(spark, d):
    """SRC4, PRJ6: bad JSON and bad numbers become nulls; samples are rounded half to even."""
    line = F.when(F.col("event_id") % 7 == 0, '{"duration": "abc"}').when(F.col("event_id") % 11 == 0, "{bad").otherwise(F.concat(F.lit('{"duration": '), "value", F.lit(', "rate": 16000}')))
    got = F.from_json(line, "duration string, rate string", {"mode": "PERMISSIVE"})
    return table(spark, d, "events").select("event_id", got.alias("r")).select("event_id", scalars.sample_count(F.expr("try_cast(r.duration as double)"), F.expr("try_cast(r.rate as double)")).alias("samples"))


@register("quality_reject_reason", """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT vec_id, x, list_avg(x) AS a FROM s),
q AS (SELECT vec_id, sqrt(list_avg([(v - a) * (v - a) for v in x])) AS std, sqrt(list_avg([v * v for v in x])) AS rms, list_max([abs(v) for v in x]) AS peak FROM m)
SELECT vec_id, CASE WHEN std < 0.1248 THEN 'std_lt' WHEN rms < 0.125 THEN 'rms_lt' WHEN peak < 0.33 THEN 'peak_lt' END AS reason FROM q""")
def quality_reject_reason(spark, d):
    """FIL2: reasons in their order."""
    return table(spark, d, "embeddings").select("vec_id", dedup.reject_reason("embedding", 64, 0.1248, 0.125, 0.33).alias("reason"))


@register("reject_report", "SELECT count(*) AS total, count(*) FILTER (WHERE n_chars = 1000) AS exact, count(*) FILTER (WHERE n_chars < 100) AS short, round(min(n_chars), 0)::BIGINT AS least FROM documents")
def reject_report(spark, d):
    """AG6, SNK14: counts of a filter run, in one pass."""
    return table(spark, d, "documents").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") == 1000).alias("exact"), F.count_if(F.col("n_chars") < 100).alias("short"), F.min("n_chars").alias("least"))


@register("exact_length", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 10")
def exact_length(spark, d):
    """FIL1: pushed down to the scan."""
    return filters.exact_length(table(spark, d, "lineitem"), "l_quantity", 10).select("l_orderkey", "l_linenumber")


@register("duration_range", "SELECT doc_id FROM documents WHERE n_chars BETWEEN 500 AND 2000")
def duration_range(spark, d):
    """FIL4."""
    return filters.duration_between(table(spark, d, "documents"), "n_chars", 500, 2000).select("doc_id")


@register("min_rate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 40 AND l_tax >= 0.05")
def min_rate(spark, d):
    """FIL3."""
    return filters.at_least(table(spark, d, "lineitem"), l_quantity=40, l_tax=0.05).select("l_orderkey", "l_linenumber")


@register("ext_filter", rf"SELECT page_id FROM pages WHERE lower(regexp_extract({_BASE}, '.(\.[^.]+)$', 1)) IN ('.html', '.htm')")
def ext_filter(spark, d):
    """FIL5."""
    return table(spark, d, "pages").where(paths.suffix("url").isin(".html", ".htm")).select("page_id")


@register("substring_exclude", "SELECT page_id FROM pages WHERE NOT contains(url, 'utm_') AND NOT contains(url, '#top')")
def substring_exclude(spark, d):
    """FIL6."""
    return filters.without_any(table(spark, d, "pages"), "url", ["utm_", "#top"]).select("page_id")


@register("array_filter", "SELECT vec_id, len([x for x in embedding if x > 0.1])::BIGINT AS n FROM embeddings WHERE len([x for x in embedding if x > 0.1]) > 0")
def array_filter(spark, d):
    """FIL16: elements are filtered before they are exploded or counted; rows that keep none go."""
    kept = filters.with_entries(table(spark, d, "embeddings"), "embedding", lambda x: x > F.lit(0.1).cast("double"))
    return kept.select("vec_id", F.size("embedding").cast("long").alias("n"))


@register("degenerate_filter", f"WITH {EV} SELECT event_id FROM ev WHERE t + value - 10 > t")
def degenerate_filter(spark, d):
    """FIL8."""
    return filters.proper_intervals(events(spark, d), "t", F.col("t") + F.col("value") - 10).select("event_id")


@register("route_labels", "SELECT CASE WHEN event_type IN ('error', 'signup') THEN event_type ELSE 'background' END AS route, count(*) AS n FROM events GROUP BY 1")
def route_labels(spark, d):
    """FIL9."""
    return table(spark, d, "events").groupBy(filters.label_route("event_type", ["error", "signup", "view"], ["view"]).alias("route")).agg(F.count("*").alias("n"))


@register("min_label_size", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars >= 300 AND coalesce(quality, 0) > 0")
def min_label_size(spark, d):
    """FIL12."""
    return filters.labelled_enough(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "n_chars", "quality", 300).select("doc_id")


@register("path_contains", "SELECT page_id FROM pages WHERE contains(url, '/en/')")
def path_contains(spark, d):
    """FIL13."""
    return filters.with_any(table(spark, d, "pages"), "url", ["/en/"]).select("page_id")


@register("class_prefix", "SELECT s_suppkey FROM supplier WHERE s_name LIKE 'Supplier#00000001%' OR s_name = 'noise'")
def class_prefix(spark, d):
    """FIL14."""
    return table(spark, d, "supplier").where(F.col("s_name").startswith("Supplier#00000001") | (F.col("s_name") == "noise")).select("s_suppkey")


@register("metric_allow", "SELECT event_id, event_type AS metric FROM events WHERE event_type IN ('error', 'click')")
def metric_allow(spark, d):
    """FIL17."""
    return table(spark, d, "events").where(F.col("event_type").isin("error", "click")).select("event_id", F.col("event_type").alias("metric"))


@register("finite_only", "SELECT event_id FROM events WHERE value / nullif(event_id % 5, 0) IS NOT NULL")
def finite_only(spark, d):
    """FIL18."""
    x = F.try_divide("value", F.col("event_id") % 5)
    return table(spark, d, "events").where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))).select("event_id")


@register("flatten_events", """WITH o AS (SELECT o_orderkey, list({'n': l_linenumber, 'flags': [l_returnflag, l_linestatus]} ORDER BY l_linenumber, l_partkey, l_suppkey) AS ev FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
e AS (SELECT o_orderkey, unnest(range(0, len(ev))) AS event_index, unnest(ev) AS e FROM o), f AS (SELECT o_orderkey, event_index, e.n AS n, unnest(range(0, 2)) AS label_index, unnest(e.flags) AS label FROM e)
SELECT o_orderkey AS file, event_index, label_index, n AS start_n, label, 2 AS label_count FROM f""")
def flatten_events(spark, d):
    """PRJ2, SF12, SF14: one row for each event and label of a nested record."""
    line = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array("l_returnflag", "l_linestatus").alias("labels")).alias("e"))
    packed = line.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list("e"))).alias("doc"))
    parsed = packed.select(F.col("l_orderkey").alias("file"), F.from_json("doc", "array<struct<l_linenumber int, l_partkey bigint, l_suppkey bigint, labels array<string>>>").alias("ev"))
    flat = parsed.select("file", F.posexplode_outer("ev").alias("event_index", "e"))
    labels = F.when(F.size("e.labels") > 0, F.col("e.labels")).otherwise(F.array(F.lit("unknown")))
    return flat.select("file", F.col("event_index").cast("long").alias("event_index"), F.posexplode(labels).alias("label_index", "label"), F.col("e.l_linenumber").alias("start_n"), F.size("e.labels").alias("label_count")).withColumn("label_index", F.col("label_index").cast("long"))


@register("join_multilabels", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag || ';' || l_linestatus AS label FROM lineitem")
def join_multilabels(spark, d):
    """PRJ3."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(F.array("l_returnflag", "l_linestatus"), ";").alias("label"))


@register("window_projection", f"WITH {EV} SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_index, event_id AS window_id, user_id AS recording_id, t AS start_s, t + 5 AS end_s FROM ev")
def window_projection(spark, d):
    """PRJ1: every window, with its global row number."""
    ev = running_totals(events(spark, d), ["event_id"], {"n": F.lit(1)})
    return ev.select((F.col("n") - 1).alias("row_index"), F.col("event_id").alias("window_id"), F.col("user_id").alias("recording_id"), F.col("t").alias("start_s"), (F.col("t") + 5).alias("end_s"))


@register("record_projection", "SELECT doc_id || '.wav' AS audio_filepath, n_chars / 100.0 AS duration, 16000 AS sample_rate, source AS station FROM documents")
def record_projection(spark, d):
    """PRJ5: core fields over extra ones."""
    extra = {"station": F.col("source"), "sample_rate": F.lit(-1)}
    core = {"audio_filepath": F.concat(F.col("doc_id").cast("string"), F.lit(".wav")), "duration": F.col("n_chars") / 100.0, "sample_rate": F.lit(16000)}
    return table(spark, d, "documents").select(*[c.alias(k) for k, c in (extra | core).items()])


@register("loss_history", "SELECT user_id AS epoch, min(value) AS loss FROM events GROUP BY user_id ORDER BY user_id")
def loss_history(spark, d):
    """PRJ8: epoch maps to rows; what isn't a number goes."""
    history = table(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("v")).select(F.create_map(F.col("user_id").cast("string"), F.col("v").cast("string"), F.concat(F.lit("x"), "user_id"), F.lit("1")).alias("m"))
    rows = history.select(F.explode("m").alias("k", "v"))
    return rows.select(F.expr("try_cast(k as bigint)").alias("epoch"), F.expr("try_cast(v as double)").alias("loss")).where("epoch is not null and loss is not null").orderBy("epoch")


@register("recursive_flatten", "SELECT event_id, 'props.k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'props.n.type', event_type FROM events")
def recursive_flatten(spark, d):
    """PRJ4: nested values as dotted keys; the schema is declared, so it is a stack of columns."""
    doc = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.struct(F.col("event_type").alias("type")).alias("n")))
    got = table(spark, d, "events").select("event_id", F.from_json(doc, "k string, n struct<type string>").alias("p"))
    rows = F.filter(F.array(F.struct(F.lit("props.k").alias("path"), F.col("p.k").alias("value")), F.struct(F.lit("props.n.type").alias("path"), F.col("p.n.type").alias("value"))), lambda r: r["value"].isNotNull())
    return got.select("event_id", F.inline(rows))


@register("clone_rows", "SELECT vec_id, c AS copy, vec_id * 3 + c AS seed FROM embeddings, range(0, 3) r(c)")
def clone_rows(spark, d):
    """PRJ7."""
    return table(spark, d, "embeddings").select("vec_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("copy")).withColumn("seed", F.col("vec_id") * 3 + F.col("copy"))


@register("pivot_summary", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'signup') AS signup FROM events GROUP BY user_id")
def pivot_summary(spark, d):
    """SNK2, AG15: counts by file and label; the labels are given, so there is no pass to find them."""
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "signup"]).count()
    return p.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "error", "signup")])
