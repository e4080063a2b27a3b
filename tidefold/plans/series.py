"""Queries: frames, runs, budgets, sampling and splits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import filters, frames, sampling
from .registry import register
from .views import EV, events, seconds, table

_MD5 = "md5('{seed}:' || {key})"


@register("islands", f"""WITH {EV}, f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, (value >= 5)::INT AS x FROM ev),
g AS (SELECT user_id, event_id, rn - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f WHERE x = 1) SELECT user_id, min(event_id) AS first, max(event_id) AS last FROM g GROUP BY user_id, run""")
def islands(spark, d):
    """WN2."""
    return frames.islands(events(spark, d).withColumn("x", (F.col("value") >= 5).cast("int")), "user_id", "event_id", "x")


for _name, _kind, _at in (("moving_avg_segments", "avg", 8.0), ("moving_max_segments", "max", 20.0)):

    @register(_name, f"""WITH {EV}, f AS (SELECT user_id, event_id, {_kind}(value) OVER w AS m, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, (CASE WHEN n = 3 THEN m ELSE 0 END >= {_at})::INT AS x FROM f),
g AS (SELECT user_id, event_id, rn - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM x WHERE x = 1) SELECT user_id, min(event_id) AS first, max(event_id) AS last FROM g GROUP BY user_id, run""")
    def _moving(spark, d, kind=_kind, at=_at):
        """WN3, WN4, WN5: thresholded moving statistic, fused into runs."""
        x = (frames.moving("value", "user_id", "event_id", 3, kind) >= at).cast("int")
        return frames.islands(events(spark, d).withColumn("x", x), "user_id", "event_id", "x")


@register("segment_likelihood", f"""WITH {EV}, f AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, (value >= 5)::INT AS x FROM ev),
g AS (SELECT user_id, event_id, value, rn - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f WHERE x = 1) SELECT user_id, min(event_id) AS first, round(avg(value), 6) AS likelihood FROM g GROUP BY user_id, run""")
def segment_likelihood(spark, d):
    """WN5: mean likelihood of each fused segment."""
    rn = lambda: F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    ones = events(spark, d).withColumn("a", rn()).where("value >= 5").withColumn("run", F.col("a") - rn())
    return ones.groupBy("user_id", "run").agg(F.min("event_id").alias("first"), F.round(F.avg("value"), 6).alias("likelihood")).drop("run")


@register("ema", f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev),
e AS (SELECT user_id, rn, value AS acc FROM r WHERE rn = 1 UNION ALL SELECT r.user_id, r.rn, r.value * 0.1 + e.acc * 0.9 FROM e JOIN r ON r.user_id = e.user_id AND r.rn = e.rn + 1)
SELECT user_id, round(arg_max(acc, rn), 6) AS ema FROM e GROUP BY user_id""")
def ema(spark, d):
    """WN7."""
    return frames.ema(events(spark, d), "user_id", "event_id", "value", 0.1).select("user_id", F.round("ema", 6).alias("ema"))


@register("hop_windows", "SELECT vec_id, s // 8 AS frame, round(list_avg([v::DOUBLE * v::DOUBLE for v in embedding[s + 1:s + 16]]), 6) AS power FROM embeddings, range(0, 49, 8) r(s)")
def hop_windows(spark, d):
    """WN16."""
    f = table(spark, d, "embeddings").select("vec_id", F.posexplode(frames.hop_frames("embedding", 16, 8)).alias("frame", "x"))
    return f.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round(F.pow(scalars.rms("x"), F.lit(2)), 6).alias("power"))


@register("chunk_array", "SELECT vec_id, s // 24 AS chunk, len(embedding[s + 1:s + 24])::BIGINT AS n FROM embeddings, range(0, 64, 24) r(s)")
def chunk_array(spark, d):
    """SF21: the tail stays as a short chunk."""
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(frames.chunk("embedding", 24)).alias("chunk", "x")).select("vec_id", F.col("chunk").cast("long").alias("chunk"), F.size("x").cast("long").alias("n"))


@register("suffix_scan", f"WITH {EV} SELECT event_id, sum((value > 5)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS n FROM ev")
def suffix_scan(spark, d):
    """WN14."""
    marked = events(spark, d).select("event_id", "user_id", (F.col("value") > 5).cast("int").alias("v"))
    return frames.running_in_groups(marked, ["user_id"], [F.desc("event_id")], {"n": F.col("v")}).select("event_id", "n")


@register("patience_counter", f"""WITH {EV}, r AS (SELECT event_id, user_id, value, row_number() OVER w AS rn, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, max(value) OVER w AS best FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, best, rn - max(CASE WHEN p IS NULL OR value > p THEN rn END) OVER (PARTITION BY user_id ORDER BY event_id) AS since_best FROM r""")
def patience_counter(spark, d):
    """WN12."""
    return frames.patience(events(spark, d), "user_id", "event_id", "value").select("event_id", "best", F.col("since_best").cast("long").alias("since_best"))


@register("per_run_order", f"WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS step FROM ev")
def per_run_order(spark, d):
    """WN13."""
    rows = frames.running_in_groups(events(spark, d).select("event_id", "user_id", "value"), ["user_id"], ["value", "event_id"], {"step": F.lit(1)})
    return rows.select("event_id", F.col("step").cast("long").alias("step"))


@register("annealed_rate", "SELECT event_id, round(CASE WHEN event_id >= 5000 THEN 0.9999 ELSE 0.9999 - (0.9999 - 0.99) * (1 - event_id / 5000.0) END, 8) AS rate FROM events")
def annealed_rate(spark, d):
    """WN15."""
    return table(spark, d, "events").select("event_id", F.round(scalars.annealed("event_id", 0.99, 0.9999, 5000), 8).alias("rate"))


@register("output_offset", "SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_n FROM documents")
def output_offset(spark, d):
    """WN10."""
    rows = frames.running_in_groups(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], {"n": F.col("n_chars")})
    return rows.select("doc_id", (F.col("n") - F.coalesce("n_chars", F.lit(0))).cast("long").alias("offset_n"))


@register("shard_assign", "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS shard FROM documents")
def shard_assign(spark, d):
    """SNK8."""
    rows = frames.running_in_groups(table(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"], {"n": F.lit(1)})
    return rows.select("doc_id", "source", F.floor((F.col("n") - 1) / 10).alias("shard"))


@register("shard_align", """WITH RECURSIVE r AS (SELECT source, doc_id, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
a AS (SELECT source, doc_id, rn, 0::BIGINT AS b, n AS e FROM r WHERE rn = 1 UNION ALL
SELECT r.source, r.doc_id, r.rn, CASE WHEN r.n > 50000 - a.e % 50000 AND r.n <= 50000 THEN a.e + 50000 - a.e % 50000 ELSE a.e END, CASE WHEN r.n > 50000 - a.e % 50000 AND r.n <= 50000 THEN a.e + 50000 - a.e % 50000 ELSE a.e END + r.n FROM a JOIN r ON r.source = a.source AND r.rn = a.rn + 1)
SELECT source, doc_id, b AS begin FROM a""")
def shard_align(spark, d):
    """WN11."""
    return frames.shard_align(table(spark, d, "documents"), "source", "doc_id", "n_chars", 50_000)


@register("budget_select", f"""WITH r AS (SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY {_MD5.format(seed=1, key='doc_id')}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents)
SELECT doc_id, source FROM r WHERE b < 30000""")
def budget_select(spark, d):
    """WN8: in hash order until the target is reached; the crossing row stays."""
    return frames.take_until(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", [sampling.hash_order(1, "doc_id"), "doc_id"], "n_chars", 30_000).select("doc_id", "source")


@register("greedy_budget", """WITH RECURSIVE r AS (SELECT source, n_chars::DOUBLE AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT DISTINCT source, 0::BIGINT AS rn, 0::BIGINT AS taken, 0::DOUBLE AS total FROM documents UNION ALL
SELECT f.source, r.rn, f.taken + (CASE WHEN 20000 - total <= 0 OR (x > 20000 - total AND 20000 - total < x / 2 AND taken > 0) THEN 0 ELSE 1 END), total + (CASE WHEN 20000 - total <= 0 OR (x > 20000 - total AND 20000 - total < x / 2 AND taken > 0) THEN 0 ELSE x END) FROM f JOIN r ON r.source = f.source AND r.rn = f.rn + 1)
SELECT source, arg_max(taken, rn) AS taken, arg_max(total, rn) AS total FROM f GROUP BY source""")
def greedy_budget(spark, d):
    """WN9."""
    return frames.greedy_budget(table(spark, d, "documents"), "source", "doc_id", "n_chars", 20_000)


@register("sample_per_group", f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_MD5.format(seed=2, key='doc_id')}, doc_id) <= 5")
def sample_per_group(spark, d):
    """SO3."""
    return sampling.per_group(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5, 2)


@register("hours_per_month", f"""WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS n FROM orders)
SELECT o_orderkey, ym FROM o QUALIFY row_number() OVER (PARTITION BY ym ORDER BY {_MD5.format(seed=3, key='o_orderkey')}, o_orderkey) <= greatest(1, round_even(n / 20.0, 0))""")
def hours_per_month(spark, d):
    """SO4: a share of each month's files, at least one."""
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"))
    return sampling.per_group(o, "ym", "o_orderkey", F.greatest(F.lit(1), F.bround(F.col("__n") / 20.0)), 3).select("o_orderkey", "ym")


@register("per_class_cap", f"SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_MD5.format(seed=4, key='vec_id')}, vec_id) <= 20")
def per_class_cap(spark, d):
    """SO6."""
    return sampling.per_group(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 20, 4)


@register("top_union_keep", """WITH a AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50), b AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50)
SELECT o_orderkey FROM a UNION SELECT o_orderkey FROM b UNION SELECT o_orderkey FROM orders WHERE o_orderkey < 3""")
def top_union_keep(spark, d):
    """SO7, SE3."""
    return sampling.keep_top_union(table(spark, d, "orders"), "o_totalprice", "o_orderdate", "o_orderkey", 50, F.col("o_orderkey") < 3).select("o_orderkey")


@register("stratified_split", f"""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_MD5.format(seed=5, key='vec_id')}, vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'test' WHEN rn <= round_even(n * 0.2, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, d):
    """SO8."""
    return sampling.ranked_split(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", (0.2, 0.1), 5).select("vec_id", "split")


@register("fraction_split", """WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT source, n, CASE WHEN n >= 3 THEN least(greatest(1, round_even(n * 0.8, 0)::BIGINT), n - 2) ELSE n END AS train FROM n),
v AS (SELECT *, CASE WHEN n >= 3 THEN least(greatest(1, round_even(n * 0.1, 0)::BIGINT), n - train - 1) ELSE 0 END AS val FROM t) SELECT source, train, val, n - train - val AS test FROM v""")
def fraction_split(spark, d):
    """SO9."""
    train, val, test = sampling.fraction_sizes(F.col("n"), 0.8, 0.1)
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", train.alias("train"), val.alias("val"), test.alias("test"))


@register("group_kfold", """WITH s AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT c_nationkey, n, row_number() OVER (ORDER BY n DESC, c_nationkey) - 1 AS r FROM s)
SELECT c_nationkey, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold, n FROM r""")
def group_kfold(spark, d):
    """SO13."""
    folded = sampling.group_folds(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 5)
    return folded.groupBy("c_nationkey", "fold").agg(F.count("*").alias("n"))


@register("leave_p_out", f"WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY {_MD5.format(seed=6, key='s_suppkey')}, s_suppkey) AS rn, count(*) OVER () AS n FROM supplier) SELECT s_suppkey FROM r WHERE rn <= round_even(n * 0.2, 0)")
def leave_p_out(spark, d):
    """SO11."""
    return sampling.ranked_split(table(spark, d, "supplier").select("s_suppkey"), None, "s_suppkey", (0.2, 0.0), 6).where("split = 'test'").select("s_suppkey")


@register("split_by_individual", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'valid' ELSE 'train' END AS split FROM part")
def split_by_individual(spark, d):
    """SO12."""
    found = filters.of_individual(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "red")
    return found.select("p_partkey", F.when(F.col("is_individual"), "valid").otherwise("train").alias("split"))


@register("random_mask", f"SELECT vec_id, i - 1 AS pos, row_number() OVER (PARTITION BY vec_id ORDER BY md5('7:' || (vec_id * 64 + i - 1))) <= 16 AS kept FROM embeddings, range(1, 65) r(i)")
def random_mask(spark, d):
    """SO14: the first quarter of positions in hash order, within the row: no shuffle."""
    noise = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.md5(F.concat(F.lit("7:"), (F.col("vec_id") * 64 + i).cast("string")).cast("binary")))
    cut = F.element_at(F.array_sort("noise"), 16)
    rows = table(spark, d, "embeddings").select("vec_id", noise.alias("noise")).withColumn("cut", cut)
    return rows.select("vec_id", "cut", F.posexplode("noise").alias("pos", "h")).select("vec_id", F.col("pos").cast("long").alias("pos"), (F.col("h") <= F.col("cut")).alias("kept"))


@register("fair_share", """WITH RECURSIVE s AS (SELECT n_nationkey AS k, (n_nationkey * 7) % 11 + 1 AS cap, row_number() OVER (ORDER BY n_nationkey) AS rn, count(*) OVER () AS n FROM nation),
f AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS k, 100::BIGINT AS rest, 0::BIGINT AS share UNION ALL SELECT s.rn, s.k, rest - least(cap, ceil(rest / (n - s.rn + 1)))::BIGINT, least(cap, ceil(rest / (n - s.rn + 1)))::BIGINT FROM f JOIN s ON s.rn = f.rn + 1)
SELECT k AS source, share FROM f WHERE rn > 0""")
def fair_share(spark, d):
    """SO5."""
    s = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("source"), ((F.col("n_nationkey") * 7) % 11 + 1).alias("cap"))
    return sampling.fair_share(s, "source", "cap", 100)


@register("sort_desc_nulls", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey LIMIT 200")
def sort_desc_nulls(spark, d):
    """SO1, SO2: a report of the first 200; NaN counts as null."""
    key = F.nanvl(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")), F.lit(None).cast("double"))
    return table(spark, d, "orders").orderBy(key.desc_nulls_last(), "o_orderkey").limit(200).select("o_orderkey", "o_totalprice")


@register("limit_ordered", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def limit_ordered(spark, d):
    """SO2: a top-20 report."""
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@register("rasterise_labels", f"""WITH {EV}, a AS (SELECT event_id, user_id, floor(t % 86400 / 60)::BIGINT AS f0, floor((t % 86400 + value * 10) / 60)::BIGINT AS f1, event_type FROM ev WHERE event_type IN ('error', 'click')),
g AS (SELECT event_id, user_id, event_type, unnest(range(f0, f1 + 1)) AS frame FROM a) SELECT user_id, frame, arg_max(event_type, event_id) AS label FROM g GROUP BY user_id, frame""")
def rasterise_labels(spark, d):
    """SF24: intervals to frames, the last writer wins."""
    a = table(spark, d, "events").where("event_type in ('error', 'click')").withColumn("s", seconds() % 86400)
    f = a.select("event_id", "user_id", "event_type", F.explode(F.sequence(F.floor(F.col("s") / 60), F.floor((F.col("s") + F.col("value") * 10) / 60))).alias("frame"))
    return f.groupBy("user_id", "frame").agg(F.max_by("event_type", "event_id").alias("label"))
