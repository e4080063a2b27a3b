"""Queries: formats, connectors and streams, written from the supplied tables and read again by the library's readers."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, scalars
from ..operators import annotations, audio, dedup, frames, nested
from ..operators.scratch import folder
from ..sources import commit, files, settings, sinks, snapshots
from ..sources.storage import write_bytes
from ..streaming import state, watch
from .registry import register
from .views import table


def _new(spark, name: str) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}/{name}"


@register("csv_scan", "SELECT event_id, user_id, value FROM events")
def csv_scan(spark, d):
    """SRC1, SNK1."""
    at = _new(spark, "csv")
    sinks.write_csv(table(spark, d, "events").select("event_id", "user_id", "value"), at)
    return files.read_csv(spark, at, "event_id bigint, user_id bigint, value double")


@register("headerless_manifest", "SELECT event_id || '.wav' AS filename, value AS start_s, value + 5 AS end_s FROM events")
def headerless_manifest(spark, d):
    """SRC2: six columns without a header are known by their places."""
    at = _new(spark, "csv")
    rows = table(spark, d, "events").select(F.lit(0), F.lit("x"), "user_id", F.concat(F.col("event_id").cast("string"), F.lit(".wav")), "value", F.col("value") + 5)
    rows.write.csv(at)
    return files.read_manifest_csv(spark, at, header=False)


def _tasks(spark, d) -> DataFrame:
    """Tasks from events, one each, in the shapes that exports have: a direct list, cancelled and malformed annotations."""
    e, s = F.col("event_id"), F.lit
    ev = table(spark, d, "events")
    kind = F.to_json(F.array("event_type", s(""), s(None), F.concat("event_type", s("2"))))
    span = F.concat(s('"start":'), e.cast("string"), s(',"end":'), (e + 2).cast("string"))
    noted = F.concat(
        s('{"id":'), e.cast("string"), s(',"data":{"file":"d\\\\'), e.cast("string"), s('.wav"},"annotations":[7,{"was_cancelled":'), F.when(e % 7 == 0, "true").otherwise("false"),
        s(',"result":["x",{"value":{'), span, s(',"channel":1,"labels":'), kind, s('}},{"value":{"start":1}},{"value":{"end":1,"start":4,"labels":[],"choices":["c"]}}]},{"result":[{"value":{"start":0,"end":1,"labels":"one"}}]}]}'),
    )
    direct = F.concat(s('{"id":'), e.cast("string"), s(',"audio":"a.wav","label":["x",{'), span, s('},{"start":0.5,"end":1,"labels":[null]}],"annotations":[]}'))
    return ev.select(e.alias("file_index"), F.when(e % 5 == 0, direct).when(e % 5 == 1, s('"no task"')).otherwise(noted).alias("task"))


_TASK_ROWS = """WITH f AS (
  SELECT event_id AS f, 0 AS e, 0 AS l, 'a.wav' AS audio, event_id::DOUBLE AS s, event_id + 2::DOUBLE AS t, NULL::BIGINT AS ch, 'unknown' AS label, 1 AS n FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, 1, 0, 'a.wav', 0.5, 1, NULL, 'unknown', 1 FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, 0, l, 'd/' || event_id || '.wav', event_id, event_id + 2, 1, CASE l WHEN 0 THEN event_type ELSE event_type || '2' END, 2 FROM events, range(0, 2) r(l) WHERE event_id % 5 > 1 AND event_id % 7 > 0
  UNION ALL SELECT event_id, 1, 0, 'd/' || event_id || '.wav', 4, 1, NULL, 'c', 1 FROM events WHERE event_id % 5 > 1 AND event_id % 7 > 0
  UNION ALL SELECT event_id, CASE WHEN event_id % 7 > 0 THEN 2 ELSE 0 END, 0, 'd/' || event_id || '.wav', 0, 1, NULL, 'one', 1 FROM events WHERE event_id % 5 > 1)"""


@register("flatten_tasks", _TASK_ROWS + " SELECT row_number() OVER (ORDER BY f, e, l) - 1 AS row_id, f AS file_index, e AS event_index, l AS label_index, f::VARCHAR AS source_id, audio, s AS start_s, t AS end_s, greatest(0, t - s) AS duration_s, ch AS channel, label, n AS label_count FROM f")
def flatten_tasks(spark, d):
    """PRJ2, FIL7, SF12, SF14: annotation tasks to a row for each event and label."""
    return annotations.flatten(_tasks(spark, d))


@register("flatten_tasks_joined", _TASK_ROWS + " SELECT row_number() OVER (ORDER BY f, e) - 1 AS row_id, f AS file_index, e AS event_index, f::VARCHAR AS source_id, any_value(audio) AS audio, any_value(s) AS start_s, any_value(t) AS end_s, greatest(0, any_value(t - s)) AS duration_s, any_value(ch) AS channel, string_agg(label, '|' ORDER BY l) AS label, any_value(n) AS label_count FROM f GROUP BY f, e")
def flatten_tasks_joined(spark, d):
    """PRJ3: the same with an event's labels joined."""
    return annotations.flatten(_tasks(spark, d), joined=True)


@register("task_files", "SELECT event_id::VARCHAR AS source_id, event_type AS label FROM events")
def task_files(spark, d):
    """SRC3: a file for each user that is one list of tasks, with a byte order mark; written and read by tasks."""
    at = _new(spark, "tasks")
    task = F.struct(F.col("event_id").alias("id"), F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.array("event_type").alias("labels"))).alias("label"))
    lists = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(task)).alias("tasks"))  # a file's, which is one value by its format
    content = F.concat(F.lit("\ufeff"), F.to_json("tasks")).cast("binary")
    commit.write_files(lists.select(F.concat(F.col("user_id").cast("string"), F.lit(".json")).alias("name"), content.alias("content")), at)
    return annotations.flatten(annotations.tasks_of(spark.read.text(at, wholetext=True)), numbered=False).select("source_id", "label")


@register("root_tsv", "SELECT '/data' AS root, source || '/' || doc_id || '.txt' AS rel_path, n_chars AS n_samples FROM documents")
def root_tsv(spark, d):
    """SRC5, SNK5."""
    at = _new(spark, "tsv")
    rows = table(spark, d, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("rel_path"), F.col("n_chars").alias("n_samples"))
    sinks.write_root_tsv(rows, "/data", at)
    return files.read_root_tsv(spark, at)[0]


@register("tsv_lookup", "SELECT c_custkey, n_name AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey > 3")
def tsv_lookup(spark, d):
    """SRC6: a lookup table as TSV; keys without an entry have none."""
    at = _new(spark, "tsv")
    sinks.write_csv(table(spark, d, "nation").where("n_nationkey > 3").select(F.col("n_nationkey").alias("RandomizedName"), F.col("n_name").alias("OriginalName")), at, sep="\t")
    lookup = files.read_csv(spark, at, "RandomizedName int, OriginalName string", sep="\t")
    c = table(spark, d, "customer")
    return c.join(lookup, c.c_nationkey == lookup.RandomizedName, "left").select("c_custkey", F.col("OriginalName").alias("name"))


@register("npy_matrix", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_index, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[64]::DOUBLE, 5) AS last FROM embeddings")
def npy_matrix(spark, d):
    """SRC7, SNK9: the vectors as .npy parts in the order of their ids."""
    at = _new(spark, "npy")
    sinks.write_npy(table(spark, d, "embeddings"), at, "vec_id", "embedding", rows_each=300)
    spark.dataSource.register(files.NpySource)
    m = spark.read.format("npy").option("rowsEach", 200).load(at)
    return m.select("row_index", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"), F.round(F.element_at("embedding", -1).cast("double"), 5).alias("last"))


@register("vector_store", "SELECT vec_id AS window_id, label::BIGINT AS recording_id, 'r' || label || '.wav' AS filename, vec_id * 5.0::DOUBLE AS start_s, vec_id * 5.0::DOUBLE + 5 AS end_s, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def vector_store(spark, d):
    """SRC8: windows, recordings and vectors."""
    at, e = _new(spark, "store"), table(spark, d, "embeddings")
    start = F.col("vec_id") * F.lit(5.0)
    e.select(F.col("vec_id").alias("window_id"), F.col("label").cast("long").alias("recording_id"), start.alias("start_s"), (start + 5).alias("end_s")).write.parquet(f"{at}/windows")
    e.select(F.col("label").cast("long").alias("recording_id")).distinct().select("recording_id", F.concat(F.lit("r"), F.col("recording_id").cast("string"), F.lit(".wav")).alias("filename")).write.parquet(f"{at}/recordings")
    e.select(F.col("vec_id").alias("window_id"), "embedding").write.parquet(f"{at}/vectors")
    out = files.read_windows(spark, at)
    return out.select("window_id", "recording_id", "filename", "start_s", "end_s", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"))


@register("label_store", """WITH e AS (SELECT user_id::VARCHAR AS clip, event_id / 4.0 AS s, event_id / 4.0 + 0.5 AS t, event_type AS lbl, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 END::BIGINT AS cat, (event_id % 3 = 0)::BIGINT AS foc FROM events WHERE event_id % 2 = 0)
SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY s, t) - 1 AS pos, s::FLOAT AS start_time_lbl, t::FLOAT AS end_time_lbl, floor(s * 100)::BIGINT AS start_frame_lbl, floor(t * 100)::BIGINT AS end_frame_lbl, lbl, cat AS lbl_cat, foc FROM e""")
def label_store(spark, d):
    """SRC9, SNK10: label arrays by clip, also of clips without labels."""
    at, ev = _new(spark, "labels"), table(spark, d, "events")
    start = F.col("event_id") / 4.0
    e = ev.where("event_id % 2 = 0").select(F.col("user_id").cast("string").alias("clip"), start.alias("start_s"), (start + 0.5).alias("end_s"), F.col("event_type").alias("label"), (F.col("event_id") % 3 == 0).alias("focal"))
    sinks.write_labels(e, ev.select(F.col("user_id").cast("string").alias("clip")), at, 100, ["error", "click"])
    return files.read_labels(spark, at)


@register("arrow_splits", "SELECT vec_id, label, CASE WHEN vec_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM embeddings")
def arrow_splits(spark, d):
    """SRC10: Arrow files of two splits."""
    e, at = table(spark, d, "embeddings").select("vec_id", "label"), {s: _new(spark, f"{s}.arrow") for s in ("train", "test")}
    sinks.write_arrow(e.where("vec_id % 4 <> 0"), f"{at['train']}/parts")
    sinks.write_arrow(e.where("vec_id % 4 = 0"), f"{at['test']}/parts")
    spark.dataSource.register(files.ArrowSource)
    parts = [spark.read.format("arrow_files").load(f"{p}/parts").withColumn("split", F.lit(s)) for s, p in at.items()]
    return parts[0].unionByName(parts[1])


_PCM = "list_max([trunc(least(greatest(v::DOUBLE, -1), 1) * 32767) / 32768 for v in embedding])"


def _clips(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"))


@register("audio_files", f"SELECT vec_id AS id, 4.0::DOUBLE AS duration, 16 AS sample_rate, round({_PCM}, 5) AS peak FROM embeddings")
def audio_files(spark, d):
    """SNK11, SRC13, SRC14: WAV files written and their headers and samples read."""
    at = _new(spark, "wav")
    sinks.write_wav(_clips(spark, d), at, rate=16)
    got = files.read_audio(spark, at, samples=True)
    return got.select(paths.stem(F.col("path")).cast("bigint").alias("id"), "duration", "sample_rate", F.round(F.array_max("samples").cast("double"), 5).alias("peak"))


@register("audio_headers", "SELECT vec_id AS id, 4.0::DOUBLE AS duration, 16 AS sample_rate FROM embeddings")
def audio_headers(spark, d):
    """SRC13: WAV files' headers; their samples aren't read."""
    at = _new(spark, "wav")
    sinks.write_wav(_clips(spark, d), at, rate=16)
    return files.read_audio(spark, at).select(paths.stem(F.col("path")).cast("bigint").alias("id"), "duration", "sample_rate")


@register("audio_splits", f"SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS split, 2.0::DOUBLE AS duration, round({_PCM}, 5) AS peak FROM embeddings")
def audio_splits(spark, d):
    """SRC11: WAV bytes in Parquet splits, decoded."""
    content = F.pandas_udf(lambda x: pd.Series([sinks.wav_bytes(v, 32) for v in x]), "binary")
    at = {s: _new(spark, s) for s in "ab"}
    coded = _clips(spark, d).select(F.col("name").cast("bigint").alias("id"), content("samples").alias("bytes"))
    for k, p in enumerate(at.values()):
        coded.where(F.col("id") % 2 == k).write.parquet(p)
    got = files.decode_audio(files.read_splits(spark, **at), "bytes")
    return got.select("id", "split", "duration", F.round(F.array_max("samples").cast("double"), 5).alias("peak"))


@register("label_frame", "SELECT 'n' || user_id AS name, event_id || '.wav' AS audio_file, event_id / 8.0 AS start_s, event_id / 8.0 + 1.5 AS end_s, event_type AS focal FROM events")
def label_frame(spark, d):
    """SRC12: a label frame with intervals, converted to Parquet once."""
    at, s = _new(spark, "frame"), F.col("event_id") / 8.0
    interval = lambda c: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c)
    frame = table(spark, d, "events").select(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("Name"), F.concat(F.col("event_id").cast("string"), F.lit(".wav")).alias("AudioFile"), interval(s).alias("StartRelative"), interval(s + 1.5).alias("EndRelative"), F.col("event_type").alias("Focal"))
    frame.write.parquet(at)
    return files.read_label_frame(spark, at)


@register("file_listing", "SELECT s_suppkey, length(s_name) AS length FROM supplier WHERE s_suppkey % 3 < 2")
def file_listing(spark, d):
    """SRC15: files of an extension in any case, below folders of any depth."""
    at = _new(spark, "tree")

    def save(rows):
        for r in rows:
            ext = ("wav", "WAV", "txt")[r["s_suppkey"] % 3]
            write_bytes(f"{at}/n{r['s_nationkey']}/s/{r['s_suppkey']}.{ext}", r["s_name"].encode())

    table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name").foreachPartition(save)
    return files.list_files(spark, at, [".wav"]).select(paths.stem(F.col("path")).cast("bigint").alias("s_suppkey"), "length")


@register("pruned_walk", "WITH n AS (SELECT s_nationkey AS n, count(*) AS c FROM supplier GROUP BY 1) SELECT '/a/' || n || '/manifest.jsonl' AS path FROM n UNION ALL SELECT '/a/' || n || '/sub/manifest.jsonl' FROM n WHERE c <= 2")
def pruned_walk(spark, d):
    """SRC16: manifests below folders with many WAV files are left out; a folder's own manifest isn't."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("/a/"), F.col("s_nationkey").cast("string")).alias("f"), "s_suppkey")
    wavs = s.select(F.concat("f", F.lit("/"), F.col("s_suppkey").cast("string"), F.lit(".wav")).alias("path"))
    notes = s.select("f").distinct().select(F.explode(F.array(F.concat("f", F.lit("/manifest.jsonl")), F.concat("f", F.lit("/sub/manifest.jsonl")))).alias("path"))
    return files.pruned_manifests(wavs.unionByName(notes), 2)


@register("container_slices", "SELECT c_custkey, c_name AS name FROM customer")
def container_slices(spark, d):
    """SRC17: byte ranges of container files, one for each nation; containers and references are made by tasks."""
    at = _new(spark, "containers")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.octet_length("c_name").alias("n"))
    whole = c.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))).alias("parts"))  # one file by its format
    commit.write_files(whole.select(F.concat(F.col("c_nationkey").cast("string"), F.lit(".zip")).alias("name"), F.array_join(F.transform("parts", lambda p: p["c_name"]), "").cast("binary").alias("content")), at)
    placed = frames.running_in_groups(c, ["c_nationkey"], [F.col("c_custkey")], {"end": F.col("n")})
    refs = placed.select("c_custkey", F.concat_ws(":", F.concat(F.lit(f"{at}/"), F.col("c_nationkey").cast("string"), F.lit(".zip")), (F.col("end") - F.col("n")).cast("string"), F.col("n").cast("string")).alias("at"))
    return files.read_slices(refs).select("c_custkey", F.col("bytes").cast("string").alias("name"))


@register("object_listing", "SELECT 'b' AS bucket, CASE WHEN c_custkey % 2 = 0 THEN 'p/' ELSE 'q/' END || lpad(c_custkey::VARCHAR, 9, '0') || CASE WHEN c_custkey = 7 THEN '.WAV' ELSE '.wav' END AS key, length(c_name)::BIGINT AS size FROM customer WHERE c_custkey % 5 > 0")
def object_listing(spark, d):
    """SRC18-SRC20: paged listings that tasks write, JSON of one prefix, XML of one whose JSON listing fails; by extension."""
    at = _new(spark, "pages")
    k = F.col("c_custkey")
    ending = F.when(k % 5 == 0, ".txt").when(k == 7, ".WAV").otherwise(".wav")
    prefix = F.when(k % 2 == 0, "p").otherwise("q")
    items = table(spark, d, "customer").select(prefix.alias("prefix"), F.floor(k / 100).alias("page"), F.struct(F.concat(prefix, F.lit("/"), F.lpad(k.cast("string"), 9, "0"), ending).alias("name"), F.length("c_name").alias("size")).alias("item"))
    last = items.agg(F.max("page")).first()[0] or 0
    pages = items.groupBy("prefix", "page").agg(F.sort_array(F.collect_list("item")).alias("items"))  # 50 items at most
    more = F.col("page") < last
    after = F.concat(F.lit("t"), (F.col("page") + 1).cast("string"))
    token = F.when(F.col("page") == 0, "0").otherwise(F.concat(F.lit("t"), F.col("page").cast("string")))
    contents = F.array_join(F.transform("items", lambda i: F.concat(F.lit("<Contents><Key>"), i["name"], F.lit("</Key><Size>"), i["size"].cast("string"), F.lit("</Size></Contents>"))), "")
    xml = F.concat(F.lit("<R xmlns='u'>"), F.when(more, F.concat(F.lit("<IsTruncated>true</IsTruncated><NextMarker>"), after, F.lit("</NextMarker>"))).otherwise("<IsTruncated>false</IsTruncated>"), contents, F.lit("</R>"))
    json_page = F.to_json(F.struct("items", F.when(more, after).alias("nextPageToken")))
    of_p = F.col("prefix") == "p"
    named = pages.select(F.concat(F.lit("b-"), "prefix", F.when(of_p, "-json-").otherwise("-xml-"), token).alias("name"), F.when(of_p, json_page).otherwise(xml).cast("binary").alias("content"))
    broken = items.where("prefix = 'q'").limit(1).select(F.lit("b-q-json-0").alias("name"), F.lit("<html>error</html>").cast("binary").alias("content"))
    commit.write_files(named.unionByName(broken), at)
    spark.dataSource.register(files.ListingSource)
    return spark.read.format("listing").options(bucket="b", prefixes="p,q", pages=at, extensions=".wav").load()


@register("listing_stream", "SELECT 'b' AS bucket, 'p/' || lpad(s_suppkey::VARCHAR, 9, '0') || '.wav' AS key, length(s_name)::BIGINT AS size FROM supplier")
def listing_stream(spark, d):
    """SRC18, ST1: a listing whose pages tasks write, listed as a stream in two runs, between which keys are added."""
    at, out, kept = (_new(spark, n) for n in ("pages", "listed", "state"))
    key = F.concat(F.lit("p/"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".wav"))
    items = table(spark, d, "supplier").select(key.alias("name"), F.length("s_name").alias("size"), F.floor(F.col("s_suppkey") / 30).alias("page"))
    last = items.agg(F.max("page")).first()[0] or 0

    def write(upto: int, whole: bool) -> None:
        """The first pages; the last of them only in part, if it isn't whole."""
        shown = items.where((F.col("page") < upto) | ((F.col("page") == upto) & (F.lit(whole) | (F.col("name") < F.lit(f"p/{upto * 30 + 10:09d}.wav")))))
        pages = shown.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("name", "size"))).alias("items"))  # 30 items at most
        body = F.to_json(F.struct("items", F.when(F.col("page") < upto, F.concat(F.lit("t"), (F.col("page") + 1).cast("string"))).alias("nextPageToken")))
        name = F.concat(F.lit("b-p-json-"), F.when(F.col("page") == 0, "0").otherwise(F.concat(F.lit("t"), F.col("page").cast("string"))))
        commit.write_files(pages.select(name.alias("name"), body.cast("binary").alias("content")), at)

    spark.dataSource.register(files.ListingSource)
    for upto, whole in ((last // 2, False), (last, True)):
        write(upto, whole)
        stream = spark.readStream.format("listing").options(bucket="b", prefixes="p", pages=at, extensions=".wav").load()
        watch.drain(stream, watch.append_to(out), kept)
    return spark.read.schema("bucket string, key string, size bigint").json(f"{out}/batch=*")


@register("crawl_pages", "WITH RECURSIVE r AS (SELECT 0::BIGINT AS i UNION ALL SELECT c FROM (SELECT unnest([2 * i + 1, 2 * i + 2]) AS c FROM r) JOIN pages ON page_id = c) SELECT 'h/' || i AS url FROM r")
def crawl_pages(spark, d):
    """SRC21: what can be reached over saved pages, links out of the base left."""
    i = F.col("page_id")
    url = lambda c: F.concat(F.lit("h/"), c.cast("string"))
    top = table(spark, d, "pages").agg(F.max("page_id")).first()[0] or 0
    links = F.filter(F.array(*[F.when(c <= top, url(c)) for c in (2 * i + 1, 2 * i + 2)], F.concat(F.lit("x/"), i.cast("string")), F.lit("h/0")), lambda u: u.isNotNull())
    return files.crawl(table(spark, d, "pages").select(url(i).alias("url"), links.alias("links")), "h/0", "h/")


def _archive(params: dict):
    return [(f"{params['deviceCode']}-{params['ext']}-{i}", i) for i in range(int(params["n"]))]


@register("archive_files", "SELECT s_name AS target, 'D' || s_suppkey || '-' || CASE WHEN s_nationkey % 2 = 0 THEN 'mp3' ELSE 'wav' END || '-' || i AS file, i AS size FROM (SELECT *, unnest(range(0, CASE WHEN s_nationkey % 3 = 0 THEN 2 ELSE 1 END)) AS i FROM supplier)")
def archive_files(spark, d):
    """SRC22: layered request parameters for each supplier, and what the archive lists for each."""
    core = F.create_map(F.lit("deviceCode"), F.concat(F.lit("D"), F.col("s_suppkey").cast("string")))
    key = F.col("s_nationkey")
    extra = F.map_filter(F.create_map(F.lit("ext"), F.when(key % 2 == 0, "mp3"), F.lit("n"), F.when(key % 3 == 0, "2")), lambda k, v: v.isNotNull())
    targets = table(spark, d, "supplier").select(F.col("s_name").alias("target"), core.alias("core"), extra.alias("extra"))
    requests = files.archive_request_table(targets, {"ext": "flac", "n": 1}, {"ext": "wav", "site": None}, token="t")
    return files.fetch_archives(requests, _archive)


@register("settings_scan", """WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.yaml' ELSE '.json' END AS name, s_name, s_nationkey FROM supplier)
SELECT name, 'labels' AS path, '["' || s_name || '","b, c"]' AS value FROM s UNION ALL SELECT name, 'paths.train', '"t' || k || '.csv"' FROM s
UNION ALL SELECT name, 'paths.n', s_nationkey::VARCHAR FROM s UNION ALL SELECT name, 'paths.deep.on', CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END FROM s""")
def settings_scan(spark, d):
    """SRC23, SNK18, SF31: a settings file for each supplier, YAML or JSON, written and read by tasks, without the keys that the defaults don't know."""
    at = _new(spark, "settings")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")

    def make(rows):
        for k, name, n in rows:
            value = {"labels": [name, "b, c"], "paths": {"train": f"t{k}.csv", "n": int(n), "deep": {"on": bool(k % 3 == 0), "odd": 1}}, "unknown": {"x": 1}}
            yield (f"s{k}.yaml", settings.dump_yaml(value).encode()) if k % 2 == 0 else (f"s{k}.json", json.dumps(value).encode())

    commit.write_files(commit.files_of(rows, make, []), at)
    return settings.scan_settings(spark, at, {"labels": [], "paths": {"train": "", "n": 0, "deep": {"on": False}}})


@register("source_list", "SELECT min(p_partkey) AS pos, p_brand AS bucket, lower(p_type) || '/' AS prefix FROM part GROUP BY 2, 3")
def source_list(spark, d):
    """SRC24: sources of a table, written in several ways, distinct at their first place."""
    slash = lambda c, n: F.concat(F.when(F.col("p_partkey") % n == 0, "/").otherwise(""), c, F.when(F.col("p_partkey") % 2 == 0, "/").otherwise(""))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), slash(F.col("p_brand"), 3).alias("bucket"), slash(F.lower("p_type"), 5).alias("prefix"))
    return files.source_table(rows)


@register("selection_tables", "SELECT user_id::VARCHAR AS fn, value AS start_s, value + 1 AS end_s, event_type AS label FROM events WHERE event_type = 'error' UNION ALL SELECT DISTINCT 'empty', NULL::DOUBLE, NULL::DOUBLE, NULL FROM events")
def selection_tables(spark, d):
    """SNK3: a table for each file, one of them without events."""
    at, ev = _new(spark, "tables"), table(spark, d, "events")
    fn = F.col("user_id").cast("string").alias("fn")
    rows = ev.where("event_type = 'error'").select(fn, F.col("value").alias("start_s"), (F.col("value") + 1).alias("end_s"), F.col("event_type").alias("label"))
    sinks.selection_tables(rows, rows.select("fn").union(spark.createDataFrame([("empty",)], "fn string")), at)
    lines = spark.read.text(at).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.txt$", 1).alias("fn"), F.split("value", "\t").alias("v"))
    body = lines.where(~F.element_at("v", 1).startswith("Begin")).select("fn", F.get("v", 0).cast("double").alias("start_s"), F.get("v", 1).cast("double").alias("end_s"), F.get("v", 2).alias("label"))
    heads = lines.where(F.element_at("v", 1).startswith("Begin")).select("fn")
    return heads.join(body, "fn", "left")


@register("jsonl_append", "SELECT event_id, event_type FROM events")
def jsonl_append(spark, d):
    """SNK4: written, then appended to."""
    at, ev = _new(spark, "jsonl"), table(spark, d, "events").select("event_id", "event_type")
    sinks.write_jsonl(ev.where("event_id % 2 = 0"), at)
    sinks.write_jsonl(ev.where("event_id % 2 = 1"), at, append=True)
    return spark.read.schema("event_id bigint, event_type string").json(at)


@register("routed_folders", "SELECT CASE WHEN n_chars < 200 THEN 'rejects' ELSE lang END AS route, doc_id FROM documents")
def routed_folders(spark, d):
    """SNK6: one pass to a folder for each route."""
    at = _new(spark, "routes")
    sinks.fan_out(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), F.when(F.col("n_chars") < 200, "rejects").otherwise(F.col("lang")), at)
    return spark.read.parquet(at).select("route", "doc_id")


@register("replaced_table", "SELECT doc_id, n_chars * 2 AS n FROM documents")
def replaced_table(spark, d):
    """SNK7: a table replaced as a whole; a replacement that is too small leaves it."""
    at, docs = _new(spark, "table"), table(spark, d, "documents")
    snapshots.write_snapshot(docs.select("doc_id", F.col("n_chars").alias("n")), at)
    snapshots.write_snapshot(docs.select("doc_id", (F.col("n_chars") * 2).alias("n")), at, least_rows=1)
    try:
        snapshots.write_snapshot(docs.limit(0).select("doc_id", F.col("n_chars").alias("n")), at, least_rows=1)
    except ValueError:
        pass  # as it should
    return snapshots.read_snapshot(spark, at)


@register("sharded_folders", "SELECT doc_id, 'shard_' || lpad(((row_number() OVER (ORDER BY doc_id) - 1) // 64)::VARCHAR, 6, '0') AS shard FROM documents")
def sharded_folders(spark, d):
    """SNK8."""
    at = _new(spark, "shards")
    sinks.write_sharded(table(spark, d, "documents").select("doc_id"), "doc_id", 64, at)
    return spark.read.parquet(at).select("doc_id", "shard")


@register("registry_upsert", "SELECT c_custkey AS tag, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS score FROM customer")
def registry_upsert(spark, d):
    """SNK13: new rows replace those of their key, in the ranges of keys that they touch."""
    at = _new(spark, "registry")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("tag"), F.col("c_acctbal").alias("score"))
    snapshots.write_snapshot(c, at, "tag", ranges=4)
    snapshots.upsert_snapshot(c.where("tag % 3 = 0").withColumn("score", F.col("score") + 1), at, "tag")
    return snapshots.read_snapshot(spark, at)


@register("model_bundle", "SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY 1")
def model_bundle(spark, d):
    """SNK15: rows of each label for which the loaded pipeline predicts as the saved one did, and its labels are all there."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    at, e = _new(spark, "bundle"), table(spark, d, "embeddings")
    rows = e.select("vec_id", F.col("label").cast("double").alias("y"), array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("x"))
    model = Pipeline(stages=[LogisticRegression(featuresCol="x", labelCol="y", maxIter=5)]).fit(rows)
    sinks.save_bundle(model, [str(i) for i in range(10)], at)
    loaded, labels = sinks.load_bundle(at)
    both = model.transform(rows).select("vec_id", "y", F.col("prediction").alias("p")).join(loaded.transform(rows).select("vec_id", "prediction"), "vec_id").where(F.col("p") == F.col("prediction"))
    return both.where(F.col("y") < len(labels)).groupBy(F.col("y").cast("long").alias("label")).agg(F.count("*").alias("n"))


@register("metric_series", "SELECT event_type AS run, user_id AS step, 'best' AS metric, max(value) AS value FROM events GROUP BY 1, 2 UNION ALL SELECT event_type, user_id, 'n', count(*)::DOUBLE FROM events GROUP BY 1, 2")
def metric_series(spark, d):
    """SNK17: metrics as a long table."""
    wide = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("step")).agg(F.max("value").alias("best"), F.count("*").cast("double").alias("n"))
    return sinks.metric_series(wide, "run", "step")


def _folder_of_batches(spark, d, name: str, **columns: Column) -> tuple[str, str, str]:
    """Events as JSON files in two batches' folders: the pattern of both, where to write, where to keep state."""
    at = _new(spark, name)
    for k in (0, 1):
        table(spark, d, "events").where(F.col("event_id") % 2 == k).select(*[c.alias(n) for n, c in columns.items()]).write.mode("append").json(f"{at}/in")
    return f"{at}/in", f"{at}/out", f"{at}/state"


@register("watched_folder", "SELECT event_id, event_type FROM events")
def watched_folder(spark, d):
    """ST1, ST5: each file of a watched folder once, over two runs, appended."""
    src, out, kept = _folder_of_batches(spark, d, "watched", event_id=F.col("event_id"), event_type=F.col("event_type"))
    for _ in range(2):
        watch.drain(watch.watch(spark, src, "event_id bigint, event_type string"), watch.append_to(out), kept)
    return spark.read.schema("event_id bigint, event_type string").json(f"{out}/batch=*")


@register("best_so_far", "WITH b AS (SELECT event_type AS task, max(value) AS score FROM events GROUP BY 1) SELECT task, score, (SELECT CASE WHEN count(*) = 2 THEN sum(score * CASE task WHEN 'error' THEN 1 ELSE 3 END) / 4 END FROM b WHERE task IN ('error', 'click')) AS composite FROM b")
def best_so_far(spark, d):
    """ST2: the best score of each task over batches, and the composite of two tasks."""
    src, out, kept = _folder_of_batches(spark, d, "best", task=F.col("event_type"), step=F.col("event_id"), score=F.col("value"))
    state.drain_updates(state.best_so_far(watch.watch(spark, src, "task string, step bigint, score double", per_trigger=1)), out, kept)
    best = state.latest(spark, out, "task").select("task", "score")
    return best.crossJoin(F.broadcast(watch.composite(best, {"error": 1.0, "click": 3.0})))  # one row


@register("idle_stop", "SELECT count(*) AS n FROM events")
def idle_stop(spark, d):
    """ST3: polls until nothing comes any more."""
    src, out, kept = _folder_of_batches(spark, d, "idle", event_id=F.col("event_id"))
    watch.run_until_idle(watch.watch(spark, src, "event_id bigint"), watch.append_to(out), kept, empty_polls=2, poll_s=0.0)
    return spark.read.schema("event_id bigint").json(f"{out}/batch=*").agg(F.count("*").alias("n"))


@register("only_new_rows", "SELECT DISTINCT user_id FROM events")
def only_new_rows(spark, d):
    """ST4: of each key the first row over all batches."""
    src, out, kept = _folder_of_batches(spark, d, "new", user_id=F.col("user_id"))
    state.drain_updates(state.unseen(watch.watch(spark, src, "user_id bigint", per_trigger=1), "user_id"), out, kept)
    return spark.read.parquet(out).select("user_id")


def _flaky(row: dict) -> dict:
    """A call that fails the first time."""
    calls: list[int] = []

    def call():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("try again")
        return {"s_suppkey": row["s_suppkey"], "length": len(row["s_name"]), "calls": len(calls)}

    return watch.with_retries(call, sleep=lambda s: None)


@register("fetched_side_by_side", "SELECT s_suppkey::BIGINT AS s_suppkey, length(s_name) AS length, 2::BIGINT AS calls FROM supplier")
def fetched_side_by_side(spark, d):
    """ST7, ST8: calls that wait, several at a time, each with a retry."""
    return watch.bounded_map(table(spark, d, "supplier").select("s_suppkey", "s_name"), _flaky, "s_suppkey bigint, length bigint, calls bigint")


@register("resampled", "SELECT vec_id, ceil(64 * 44100 / 16000.0)::INT AS n FROM embeddings")
def resampled(spark, d):
    """SF20: lengths at another rate; a test holds the values against the filter's definition."""
    return audio.resampled(table(spark, d, "embeddings"), "embedding", 16_000, 44_100).select("vec_id", F.size("embedding").alias("n"))


@register("resampled_blocks", """WITH t AS (SELECT label, ceil(count(*) * 64 * 3 / 8.0)::BIGINT AS n FROM embeddings GROUP BY 1)
SELECT label, i AS chunk, least(100, n - i * 100) AS n FROM (SELECT label, n, unnest(range(0, ceil(n / 100.0)::BIGINT)) AS i FROM t)""")
def resampled_blocks(spark, d):
    """ST6: blocks of each label's recording to chunks of 100 samples at 3/8 of the rate."""
    got = audio.resample_blocks(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 16_000, 6_000, 100)
    return got.select("label", "chunk", F.size("samples").cast("long").alias("n"))


@register("softmax_scores", "WITH x AS (SELECT vec_id, [exp(v::DOUBLE - list_max(embedding)::DOUBLE) for v in embedding] AS e FROM embeddings) SELECT vec_id, round(list_max(e) / list_sum(e), 8) AS top FROM x")
def softmax_scores(spark, d):
    """SF25."""
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(scalars.softmax("embedding")), 8).alias("top"))


@register("squared_loss", """WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, round(list_avg([(e[i] - e[65 - i]) * (e[i] - e[65 - i]) for i in range(1, 65)]), 8) AS mse,
round(list_sum([CASE WHEN abs(e[i] - e[65 - i]) < 0.1 THEN 0.5 * (e[i] - e[65 - i]) * (e[i] - e[65 - i]) / 0.1 ELSE abs(e[i] - e[65 - i]) - 0.05 END for i in range(1, 65)]), 8) AS smooth FROM x""")
def squared_loss(spark, d):
    """SF26: mean squared and smooth L1 loss of vectors against themselves backwards."""
    back = F.reverse("embedding")
    smooth = F.aggregate(F.zip_with("embedding", back, lambda a, b: scalars.smooth_l1(a.cast("double"), b.cast("double"), 0.1)), F.lit(0.0), lambda a, v: a + v)
    return table(spark, d, "embeddings").select("vec_id", F.round(scalars.squared_error("embedding", back), 8).alias("mse"), F.round(smooth, 8).alias("smooth"))


@register("gained", "SELECT vec_id, round(list_max([v::DOUBLE for v in embedding]) * pow(10, (vec_id % 7 - 3) / 20.0), 8) AS peak FROM embeddings")
def gained(spark, d):
    """SF27: vectors raised by decibels."""
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(scalars.with_gain("embedding", F.col("vec_id") % 7 - 3)), 8).alias("peak"))


@register("sinc_filters", """WITH f AS (SELECT n_nationkey AS k, 50.0 + n_nationkey * 20 AS lo, 150.0 + n_nationkey * 40 AS hi FROM nation), t AS (SELECT *, unnest(range(-8, 9)) AS n FROM f)
SELECT k, n + 8 AS tap, round((2 * hi / 8000 * CASE WHEN n = 0 THEN 1 ELSE sin(2 * pi() * hi * n / 8000) / (2 * pi() * hi * n / 8000) END - 2 * lo / 8000 * CASE WHEN n = 0 THEN 1 ELSE sin(2 * pi() * lo * n / 8000) / (2 * pi() * lo * n / 8000) END) * (0.54 + 0.46 * cos(2 * pi() * n / 16)), 10) AS value FROM t""")
def sinc_filters(spark, d):
    """SF29: band-pass filters of 17 taps."""
    k = F.col("n_nationkey")
    taps = scalars.sinc_filter(50.0 + k * 20, 150.0 + k * 40, 17, 8000.0)
    return table(spark, d, "nation").select(k.alias("k"), F.posexplode(taps).alias("tap", "v")).select("k", F.col("tap").cast("long").alias("tap"), F.round("v", 10).alias("value"))


@register("position_tables", "WITH p AS (SELECT n_nationkey AS pos, unnest(range(0, 8)) AS i FROM nation) SELECT pos, i, round(CASE WHEN i < 4 THEN sin(pos * pow(10000, -i / 4.0)) ELSE cos(pos * pow(10000, -(i - 4) / 4.0)) END, 9) AS value FROM p")
def position_tables(spark, d):
    """SF29: sine and cosine tables."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.posexplode(scalars.position_table("n_nationkey", 8)).alias("i", "v"))
    return rows.select("pos", F.col("i").cast("long").alias("i"), F.round("v", 9).alias("value"))


@register("attention_biases", """WITH s AS (SELECT unnest([0.25, 0.0625, 0.015625, 0.00390625, 0.5, 0.125])::DOUBLE AS slope, unnest(range(0, 6)) AS head)
SELECT head, a.r_regionkey AS i, b.r_regionkey AS j, -abs(a.r_regionkey - b.r_regionkey) * slope AS bias FROM s, region a, region b""")
def attention_biases(spark, d):
    """SF29: biases of six heads between five places."""
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("i"))
    heads = F.array(*[F.struct(F.lit(h).cast("long").alias("head"), F.lit(v).alias("slope")) for h, v in enumerate(scalars.alibi_slopes(6))])
    places = r.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("s", F.explode(heads))
    return places.select("s.head", "i", "j", scalars.alibi_bias("i", "j", F.col("s.slope")).alias("bias"))


@register("label_decode", "SELECT event_id, event_type AS label FROM events")
def label_decode(spark, d):
    """ML2: codes by rank and back."""
    from .registry import QUERIES

    ev, codes = table(spark, d, "events"), QUERIES["label_encode"](spark, d)
    names = ev.select("event_type").distinct().groupBy().agg(F.array_sort(F.collect_set("event_type")).alias("names"))  # the label set
    return codes.crossJoin(F.broadcast(names)).select("event_id", F.get("names", F.col("code").cast("int")).alias("label"))


@register("joined_urls", """SELECT page_id, unnest(['rel', 'root', 'up', 'whole', 'scheme']) AS kind, unnest(['https://h.org/a/b/' || page_id || '?q=1', 'https://h.org/' || page_id, 'https://h.org/a/' || page_id || '#t', 'ftp://x/' || page_id, 'https://y/' || page_id]) AS url FROM pages""")
def joined_urls(spark, d):
    """SF11: links against a base URL."""
    i = F.col("page_id").cast("string")
    links = {"rel": F.concat(i, F.lit("?q=1")), "root": F.concat(F.lit("/"), i), "up": F.concat(F.lit("../x/.././"), i, F.lit("#t")), "whole": F.concat(F.lit("ftp://x/"), i), "scheme": F.concat(F.lit("//y/"), i)}
    rows = table(spark, d, "pages").select("page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("href")) for k, c in links.items()])).alias("l"))
    return rows.select("page_id", "l.kind", paths.join_url("https://h.org/a/b/c.html", F.col("l.href")).alias("url"))


@register("aligned_rows", "SELECT doc_id, n_chars, length(text) AS length FROM documents")
def aligned_rows(spark, d):
    """JN12: two tables row by row; their lengths are compared first."""
    docs = table(spark, d, "documents")
    return dedup.aligned(docs.select("doc_id", "n_chars"), docs.select("doc_id", F.length("text").cast("long").alias("length")), "doc_id")


@register("json_leaves", """SELECT event_id, 'a.b.type' AS path, event_type AS value FROM events WHERE event_id % 5 > 0 UNION ALL SELECT event_id, 'a.n', event_id::VARCHAR FROM events WHERE event_id % 5 > 0
UNION ALL SELECT event_id, 'list', '[1, 2]' FROM events WHERE event_id % 5 > 0""")
def json_leaves(spark, d):
    """PRJ4: documents of any depth; bad ones have no rows."""
    e = F.col("event_id")
    doc = F.when(e % 5 == 0, "{bad").otherwise(F.concat(F.lit('{"a":{"b":{"type":"'), "event_type", F.lit('","none":null},"n":'), e.cast("string"), F.lit('},"list":[1,2],"empty":{}}')))
    return nested.flatten_json(table(spark, d, "events").select("event_id", doc.alias("doc")), "event_id", "doc")
