"""Queries: overlap joins, lookups, semi and anti joins, dedup, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import containment, dedup, intervals
from ..operators.frames import running_totals
from .registry import register
from .views import ANN, EV, WIN, annotations, events, table, windows

HOUR = 3600.0

_HIT = "a.event_start <= w.end_s AND least(w.end_s, a.event_end) - greatest(w.start_s, a.event_start) >= 0.1"
_FLAGS = f"""fl AS (SELECT w.user_id, w.start_s, w.end_s,
  coalesce(bool_or(a.label = 'sound'), false) AS is_sound, coalesce(bool_or(a.label = 'artifact'), false) AS is_artifact
  FROM win w LEFT JOIN ann a ON a.user_id = w.user_id AND a.label IN ('sound', 'artifact') AND {_HIT} GROUP BY ALL)"""


def _labelled(spark, d):
    ev = events(spark, d)
    return intervals.label_windows(windows(ev), annotations(ev), "user_id", 0.1, bucket_s=HOUR)


@register("label_windows", f"WITH {EV}, {WIN}, {ANN}, {_FLAGS} SELECT is_sound, is_artifact, count(*) AS n, min(start_s) AS first_s FROM fl WHERE NOT is_artifact OR is_sound GROUP BY ALL")
def label_windows(spark, d):
    """JN1, JN3, FIL10: windows by whether a sound or an artifact overlaps them; artifacts without sound are left out."""
    kept = _labelled(spark, d).where(~F.col("is_artifact") | F.col("is_sound"))
    return kept.groupBy("is_sound", "is_artifact").agg(F.count("*").alias("n"), F.min("start_s").alias("first_s"))


@register("labelled_windows", f"WITH {EV}, {WIN}, {ANN}, {_FLAGS} SELECT row_number() OVER (ORDER BY user_id, start_s) - 1 AS row_index, user_id, start_s, end_s, is_sound, is_artifact FROM fl")
def labelled_windows(spark, d):
    """WN1, PRJ1: a global running id over the labelled windows, by partition offsets instead of one sorted partition."""
    rows = running_totals(_labelled(spark, d), ["user_id", "start_s"], {"n": F.lit(1)})
    return rows.select((F.col("n") - 1).alias("row_index"), *[c for c in rows.columns if c != "n"])


@register("file_labels", f"""WITH {EV}, {WIN}, {ANN}, {_FLAGS}
SELECT user_id, floor(start_s / 86400)::BIGINT AS day, max(CASE WHEN is_sound THEN 'sound' ELSE 'noise' END) AS label, count(*) AS windows FROM fl GROUP BY 1, 2""")
def file_labels(spark, d):
    """AG1, AG14: a file (user and day) is sound if any of its windows is."""
    return _labelled(spark, d).groupBy("user_id", F.floor(F.col("start_s") / 86400).alias("day")).agg(F.max(F.when(F.col("is_sound"), "sound").otherwise("noise")).alias("label"), F.count("*").alias("windows"))


for _name, _how, _not in (("overlap_semi", "left_semi", ""), ("overlap_anti", "left_anti", "NOT ")):

    @register(_name, f"WITH {EV}, {WIN}, {ANN} SELECT w.* FROM win w WHERE {_not}EXISTS (SELECT 1 FROM ann a WHERE a.user_id = w.user_id AND a.label = 'sound' AND {_HIT})")
    def _overlap(spark, d, how=_how):
        """JN1, JN8: windows with, or without, an overlapping sound."""
        ev = events(spark, d)
        return intervals.overlap_join(windows(ev), annotations(ev).where("label = 'sound'"), "user_id", 0.1, bucket_s=HOUR, how=how)


@register("overlap_bucketed", f"WITH {EV}, {WIN}, {ANN} SELECT w.user_id, w.start_s, a.event_id FROM win w JOIN ann a ON a.user_id = w.user_id AND a.label = 'sound' AND {_HIT}")
def overlap_bucketed(spark, d):
    """JN1 with time buckets in the key, for recordings that hold very many events."""
    ev = events(spark, d)
    pairs = intervals.overlap_join(windows(ev), annotations(ev).where("label = 'sound'"), "user_id", 0.1, bucket_s=HOUR)
    return pairs.select("w.user_id", "w.start_s", "e.event_id")


@register("basename_fanout_join", """WITH p AS (SELECT page_id, url, string_split(url, '/')[-1] AS base FROM pages), k AS (SELECT DISTINCT page_id, unnest([url, base]) AS name FROM p)
SELECT k.name, count(DISTINCT k.page_id) AS n FROM k JOIN (SELECT DISTINCT base AS name FROM p) b ON b.name = k.name GROUP BY k.name""")
def basename_fanout_join(spark, d):
    """JN2, SF2: build rows under their path and base name, probed by base name."""
    p = table(spark, d, "pages").select("page_id", F.col("url").alias("audio"))
    probe = p.select(F.element_at(F.split("audio", "/"), -1).alias("audio")).distinct()
    return intervals.fan_out_basename(p).distinct().join(probe, "audio").groupBy(F.col("audio").alias("name")).agg(F.countDistinct("page_id").alias("n"))


for _name, _strict in (("segment_label_clip", False), ("segment_label_clip_strict", True)):
    _rule = "((s < a AND a < e) OR (s < b AND b < e) OR (a < s AND s < e AND e < b))" if _strict else "(s < b AND e > a)"

    @register(_name, f"""WITH {EV}, {WIN}, {ANN}, j AS (SELECT w.user_id, x.event_id, w.start_s AS a, w.end_s AS b, x.event_start AS s, x.event_end AS e FROM win w JOIN ann x ON x.user_id = w.user_id)
SELECT user_id, event_id, round(greatest(s - a, 0), 4) AS clip_start, round(least(e, b) - a, 4) AS clip_end, floor(greatest(s - a, 0) * 200)::BIGINT AS frame_start, ceil((least(e, b) - a) * 200)::BIGINT AS frame_end FROM j WHERE {_rule}""")
    def _clip(spark, d, strict=_strict):
        """JN4, SF17: labels clipped to their segments, in seconds and in frames of 200 a second."""
        ev = events(spark, d)
        pairs = intervals.overlap_join(windows(ev), annotations(ev), "user_id", bucket_s=HOUR)
        pairs = pairs.select("w.user_id", "e.event_id", F.col("w.start_s").alias("seg_start"), F.col("w.end_s").alias("seg_end"), "e.event_start", "e.event_end")
        out = intervals.clip_to_segment(pairs, strict, 200.0)
        return out.select("user_id", "event_id", F.round("clip_start", 4).alias("clip_start"), F.round("clip_end", 4).alias("clip_end"), F.col("frame_start").cast("long").alias("frame_start"), F.col("frame_end").cast("long").alias("frame_end"))


_TP = f"""WITH {EV}, t AS (SELECT user_id, event_id AS id, t AS t0, t + value AS t1 FROM ev WHERE event_type = 'error'), p AS (SELECT user_id, event_id AS id, t - 1800 AS p0, t + 1800 AS p1 FROM ev WHERE event_type = 'click'),
j AS (SELECT t.user_id, t.id AS tid, p.id AS pid, (least(t1, p1) - greatest(t0, p0)) / ((t1 - t0) + (p1 - p0) - (least(t1, p1) - greatest(t0, p0))) AS iou FROM t JOIN p ON t.user_id = p.user_id AND t0 < p1 AND p0 < t1),
u AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(n_t, 0) AS n_t, coalesce(n_p, 0) AS n_p FROM (SELECT user_id, count(*) AS n_t FROM t GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n_p FROM p GROUP BY 1) b ON a.user_id = b.user_id),
h AS (SELECT user_id, count(*) FILTER (WHERE iou > 0.0005) AS tp, count(*) FILTER (WHERE NOT iou > 0.0005) AS low, count(DISTINCT tid) AS th, count(DISTINCT pid) AS ph FROM j GROUP BY 1),
s AS (SELECT user_id, count(*) AS splits FROM (SELECT user_id, tid FROM j GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1), m AS (SELECT user_id, count(*) AS mergers FROM (SELECT user_id, pid FROM j GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT u.user_id, coalesce(tp, 0) AS tp, coalesce(low, 0) + n_p - coalesce(ph, 0) AS fp, n_t - coalesce(th, 0) AS fn, coalesce(splits, 0) AS splits, coalesce(mergers, 0) AS mergers FROM u LEFT JOIN h USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN m USING (user_id)"""


@register("iou_match", _TP)
def iou_match(spark, d):
    """JN5, AG9: truth and predictions by overlap: true and false positives, misses, splits and mergers."""
    ev = events(spark, d)
    truth = ev.where("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), F.col("t").alias("t0"), (F.col("t") + F.col("value")).alias("t1"))
    pred = ev.where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), (F.col("t") - 1800).alias("p0"), (F.col("t") + 1800).alias("p1"))
    return intervals.match_by_iou(truth, pred, "user_id", 0.0005, bucket_s=HOUR)


@register("iou_histogram", f"""WITH {EV}, j AS (SELECT (least(a.t + a.value, b.t + 1800) - greatest(a.t, b.t - 1800)) / (a.value + 3600 - (least(a.t + a.value, b.t + 1800) - greatest(a.t, b.t - 1800))) AS iou
FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND a.t < b.t + 1800 AND b.t - 1800 < a.t + a.value)
SELECT least(floor(iou * 10000), 99)::BIGINT AS bin, count(*) AS n FROM j WHERE iou > 0 GROUP BY 1""")
def iou_histogram(spark, d):
    """AG29: histogram of non-zero overlaps."""
    ev = events(spark, d)
    a = ev.where("event_type = 'error'").select("user_id", F.col("t").alias("start_s"), (F.col("t") + F.col("value")).alias("end_s"), "value")
    b = ev.where("event_type = 'click'").select("user_id", (F.col("t") - 1800).alias("event_start"), (F.col("t") + 1800).alias("event_end"))
    shared = F.least("end_s", "event_end") - F.greatest("start_s", "event_start")
    iou = shared / (F.col("value") + 3600 - shared)
    pairs = intervals.overlap_join(a, b, "user_id", bucket_s=HOUR).where("start_s < event_end and event_start < end_s")
    j = pairs.select(iou.alias("iou")).where("iou > 0")
    return j.groupBy(F.least(F.floor(F.col("iou") * 10000), F.lit(99)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@register("bracket_asof", f"""WITH {EV}, p AS (SELECT user_id, t FROM ev WHERE event_type = 'error'), b AS (SELECT user_id, t AS bt FROM ev WHERE event_type = 'click')
SELECT p.user_id, p.t AS pos, max(bt) FILTER (WHERE bt < p.t) AS prev_pos, min(bt) FILTER (WHERE bt > p.t) AS next_pos FROM p LEFT JOIN b ON b.user_id = p.user_id GROUP BY p.user_id, p.t""")
def bracket_asof(spark, d):
    """JN17: for each error the last click before it and the first after it."""
    ev = events(spark, d)
    return intervals.bracket(ev.where("event_type = 'error'").select("user_id", F.col("t").alias("pos")), ev.where("event_type = 'click'").select("user_id", F.col("t").alias("pos")), "user_id")


@register("last_wins_lookup", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_wins_lookup(spark, d):
    """JN6: of rows with one key the last wins."""
    return dedup.last_wins(table(spark, d, "conversations"), "conv_id", "turn", "text")


@register("dedup_first_wins", """WITH r AS (SELECT source, lang, doc_id, n_chars, first_value(n_chars) OVER w AS f, row_number() OVER w AS rn FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id))
SELECT source, lang, min(doc_id) AS doc_id, max(f) AS n_chars, count(*) - 1 AS duplicates, count(*) FILTER (WHERE n_chars <> f) AS conflicts FROM r GROUP BY source, lang""")
def dedup_first_wins(spark, d):
    """AG5: the first record of each key, with duplicates and conflicting values counted."""
    return dedup.first_wins(table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], ["doc_id"], "n_chars")


@register("dedup_conflicts", """WITH r AS (SELECT n_chars, first_value(n_chars) OVER (PARTITION BY source, lang ORDER BY doc_id) AS f FROM documents)
SELECT count(*) AS total, count(*) FILTER (WHERE n_chars <> f) AS conflicts FROM r""")
def dedup_conflicts(spark, d):
    """AG5, AG6: totals of the same dedup."""
    out = dedup.first_wins(table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], ["doc_id"], "n_chars")
    return out.agg((F.sum("duplicates") + F.count("*")).alias("total"), F.sum("conflicts").alias("conflicts"))


@register("existing_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def existing_semi_join(spark, d):
    """JN9: rows whose file exists."""
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@register("only_new_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def only_new_anti_join(spark, d):
    """JN8: rows of a listing that aren't processed yet."""
    return dedup.anti_new(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@register("lookup_broadcast", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_broadcast(spark, d):
    """JN7: a small lookup; Spark broadcasts it by its size."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_name", "n_name")


@register("in_split", "SELECT vec_id, label FROM embeddings WHERE label IN (SELECT DISTINCT quality FROM labels)")
def in_split(spark, d):
    """JN10: membership in a small set."""
    members = table(spark, d, "labels").select(F.col("quality").alias("label")).distinct()
    return table(spark, d, "embeddings").select("vec_id", "label").join(members, "label", "left_semi").select("vec_id", "label")


@register("contains_join", "SELECT DISTINCT p_partkey, w.word FROM part JOIN (VALUES ('red'), ('blue'), ('ring')) w(word) ON contains(p_name, w.word)")
def contains_join(spark, d):
    """JN11: names that contain one of a few words: the fixed words are a literal array, so there is no nested-loop join."""
    words = F.array(*map(F.lit, ("red", "blue", "ring")))
    hits = F.filter(words, lambda w: F.contains(F.col("p_name"), w))
    return table(spark, d, "part").select("p_partkey", F.explode(hits).alias("word")).distinct()


@register("pattern_join", "SELECT doc_id, i.pattern FROM documents JOIN (SELECT DISTINCT substr(text, 1, 30) AS pattern FROM benchmark) i ON contains(text, i.pattern)")
def pattern_join(spark, d):
    """JN11 against a table of patterns: documents that hold how a benchmark item begins."""
    patterns = table(spark, d, "benchmark").select(F.substring("text", 1, 30).alias("pattern"))
    return containment.containing(table(spark, d, "documents"), "doc_id", "text", patterns, "pattern").select("doc_id", "pattern")


@register("channel_default", "SELECT p_partkey, coalesce(CASE WHEN contains(p_name, 'red') THEN 1 WHEN contains(p_name, 'blue') THEN 2 WHEN contains(p_name, 'ring') THEN 3 END, 0) AS channel FROM part")
def channel_default(spark, d):
    """JN14: channel of the first table entry that the name contains, else 0."""
    channel = F.lit(0)
    for word, n in (("ring", 3), ("blue", 2), ("red", 1)):
        channel = F.when(F.contains("p_name", F.lit(word)), n).otherwise(channel)
    return table(spark, d, "part").select("p_partkey", channel.alias("channel"))


@register("positional_join", "SELECT e.vec_id AS row_index, label, quality FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id")
def positional_join(spark, d):
    """JN12: rows aligned by an explicit row index."""
    e, x = table(spark, d, "embeddings"), table(spark, d, "labels")
    return e.join(x, e.vec_id == x.doc_id).select(F.col("vec_id").alias("row_index"), "label", "quality")


@register("shifted_partner", """WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5('0:' || s_suppkey), s_suppkey) AS r, count(*) OVER () AS n FROM supplier)
SELECT a.s_suppkey, b.s_suppkey AS partner FROM r a JOIN r b ON b.r = a.r % a.n + 1""")
def shifted_partner(spark, d):
    """JN15: a random partner for each row."""
    return dedup.shifted_partner(table(spark, d, "supplier"), "s_suppkey")


@register("registry_left_join", """SELECT n.n_name AS tag, c.n AS customers, s.n AS suppliers FROM nation n LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s.k = n_nationkey""")
def registry_left_join(spark, d):
    """JN13: a registry with left lookups in result stores, each aggregated before the join."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("tag"))
    return n.join(c, "k", "left").join(s, "k", "left").select("tag", "customers", "suppliers")


@register("union_splits", "SELECT 'documents' AS split, doc_id AS id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels UNION ALL SELECT 'pages', page_id FROM pages")
def union_splits(spark, d):
    """SE1: splits as one table with a split column."""
    parts = [table(spark, d, t).select(F.lit(t).alias("split"), F.col(k).alias("id")) for t, k in (("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    """SE2."""
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@register("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    """SE3."""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@register("batch_union", "SELECT label, sum(n)::BIGINT AS n FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1 UNION ALL SELECT quality, count(*) FROM labels GROUP BY 1) GROUP BY 1")
def batch_union(spark, d):
    """AG25: batches are concatenated by a union and counted once."""
    both = table(spark, d, "embeddings").select("label").union(table(spark, d, "labels").select("quality"))
    return both.groupBy("label").agg(F.count("*").alias("n"))


@register("one_label_per_file", "SELECT DISTINCT user_id, floor(epoch_us(ts) / 86400000000)::BIGINT AS day, 'x' AS label FROM events")
def one_label_per_file(spark, d):
    """AG4: distinct files, each with one label; a second label would raise."""
    ev = events(spark, d).select(F.struct("user_id", F.floor(F.col("t") / 86400).alias("day")).alias("file"), F.lit("x").alias("label"))
    return dedup.assert_one_label(ev, "file", "label").select("file.user_id", "file.day", "label")


@register("null_guard", "SELECT count(*) AS n FROM documents WHERE doc_id IS NOT NULL")
def null_guard(spark, d):
    """FIL11: a null would raise."""
    return dedup.assert_not_null(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source").agg(F.count("*").alias("n"))


@register("common_root", """WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, string_split(min(url), '/') AS a, string_split(max(url), '/') AS b FROM pages GROUP BY 1)
SELECT host, array_to_string([a[i] for i in range(1, len(a) + 1) if len([j for j in range(1, i + 1) if a[j] IS DISTINCT FROM b[j]]) = 0], '/') AS root FROM h""")
def common_root(spark, d):
    """AG23: the common path of each host's URLs is that of the least and the greatest one."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")
    p = table(spark, d, "pages").groupBy(host).agg(F.split(F.min("url"), "/").alias("a"), F.split(F.max("url"), "/").alias("b"))
    same = F.filter(F.sequence(F.lit(1), F.size("a")), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i))
    return p.select("host", F.array_join(F.slice("a", 1, F.size(same)), "/").alias("root"))


@register("same_origin", "SELECT page_id, url LIKE 'https://blog.%' AND regexp_matches(url, '^https://blog\\.ththan\\.example\\.net/en/') AS under FROM pages")
def same_origin(spark, d):
    """FIL15: URLs under a base URL."""
    return table(spark, d, "pages").select("page_id", paths.under_base("url", "https://blog.ththan.example.net/en/").alias("under"))
