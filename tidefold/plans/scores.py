"""Queries: metrics, group vectors, scalar numerics, models."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metrics, neighbours
from .registry import register
from .views import EV, table

_PRED = "p AS (SELECT label AS truth, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::BIGINT AS predicted FROM embeddings), c AS (SELECT DISTINCT label::BIGINT AS class FROM embeddings), m AS (SELECT a.class AS truth, b.class AS predicted, (SELECT count(*) FROM p WHERE p.truth = a.class AND p.predicted = b.class) AS n FROM c a, c b)"
_REPORT = _PRED + """, r AS (SELECT class, (SELECT sum(n) FROM m WHERE truth = class AND predicted = class) AS tp, (SELECT sum(n) FROM m WHERE truth = class) AS support, (SELECT sum(n) FROM m WHERE predicted = class) AS pn FROM c),
q AS (SELECT class, coalesce(tp / nullif(pn, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support FROM r), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q)"""


def _matrix(spark, d):
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("label").cast("long").alias("truth"), metrics.argmax(F.slice("embedding", 1, 10)).alias("predicted"))
    return metrics.confusion(rows, "truth", "predicted", rows.select(F.col("truth").alias("class")).distinct())


@register("argmax_class", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS cls FROM embeddings")
def argmax_class(spark, d):
    """AG3."""
    return table(spark, d, "embeddings").select("vec_id", metrics.argmax("embedding").alias("cls"))


for _name, _kind in (("group_mean_vec", "avg"), ("group_max_vec", "max")):

    @register(_name, f"WITH l AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, dim, round({_kind}(v), 6) AS value FROM l GROUP BY label, dim")
    def _group(spark, d, kind=_kind):
        """AG2."""
        out = metrics.group_vectors(table(spark, d, "embeddings"), "label", "embedding", kind)
        return out.select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@register("layer_average", "SELECT vec_id, i - 1 AS dim, round((embedding[i + 16]::DOUBLE + embedding[i + 32] + embedding[i + 48]) / 3, 6) AS v FROM embeddings, range(1, 17) r(i)")
def layer_average(spark, d):
    """AG26: mean of the last three of four layers of a vector, without a shuffle."""
    layer = lambda k: F.slice("embedding", 16 * k + 1, 16)
    total = F.zip_with(F.zip_with(layer(1), layer(2), lambda a, b: a.cast("double") + b.cast("double")), layer(3), lambda a, b: (a + b.cast("double")) / 3)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(total).alias("dim", "v")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


@register("confusion_matrix", f"WITH {_PRED} SELECT * FROM m")
def confusion_matrix(spark, d):
    """AG7."""
    return _matrix(spark, d)


@register("norm_confusion", f"WITH {_PRED} SELECT truth, predicted, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 0), 6) AS share FROM m")
def norm_confusion(spark, d):
    """AG30."""
    return metrics.normalised(_matrix(spark, d)).withColumn("share", F.round("share", 6))


@register("class_report", f"WITH {_REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM f")
def class_report(spark, d):
    """AG8."""
    return metrics.class_report(_matrix(spark, d)).select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("report_summary", f"""WITH {_REPORT} SELECT round((SELECT sum(n) FILTER (WHERE truth = predicted) / sum(n) FROM m), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy,
round(avg(f1) FILTER (WHERE class IN (SELECT truth FROM m WHERE n > 0 UNION SELECT predicted FROM m WHERE n > 0)), 6) AS seen_macro_f1 FROM f""")
def report_summary(spark, d):
    """AG8, AG10."""
    m = _matrix(spark, d)
    out = metrics.summary(metrics.class_report(m), m)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register("micro_counts", f"WITH {EV} SELECT count(*) FILTER (WHERE value > 5 AND event_type = 'error') AS tp, count(*) FILTER (WHERE value > 5 AND event_type <> 'error') AS fp, count(*) FILTER (WHERE value <= 5 AND event_type <> 'error') AS tn, count(*) FILTER (WHERE value <= 5 AND event_type = 'error') AS fn FROM ev")
def micro_counts(spark, d):
    """AG9."""
    p, t = F.col("value") > 5, F.col("event_type") == "error"
    return table(spark, d, "events").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & ~t).alias("tn"), F.count_if(~p & t).alias("fn"))


@register("accuracy", f"WITH {EV} SELECT round(avg(((value > 5) = (event_type = 'error'))::INT), 6) AS accuracy FROM ev")
def accuracy(spark, d):
    """AG10."""
    return table(spark, d, "events").agg(F.round(F.avg(((F.col("value") > 5) == (F.col("event_type") == "error")).cast("int")), 6).alias("accuracy"))


_AP = """WITH j AS (SELECT lang, n_chars AS s, toxic::DOUBLE AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT {k} s, sum(y) AS tp, count(*)::DOUBLE AS n FROM j GROUP BY {k} s),
c AS (SELECT {k} tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER ({p}) AS alltp FROM g WINDOW w AS ({p} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT {k} round(sum(tp / nullif(alltp, 0) * ctp / cn), 6) AS ap FROM c {g}"""


def _scored(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")


@register("average_precision", _AP.format(k="lang,", p="PARTITION BY lang", g="GROUP BY lang"))
def average_precision(spark, d):
    """AG11, FIL16: by class."""
    return metrics.average_precision(_scored(spark, d), "n_chars", "toxic", "lang").withColumn("ap", F.round("ap", 6))


@register("ap_micro", _AP.format(k="", p="", g=""))
def ap_micro(spark, d):
    """AG11: over all classes."""
    return metrics.average_precision(_scored(spark, d), "n_chars", "toxic").withColumn("ap", F.round("ap", 6))


@register("pr_curve", """WITH j AS (SELECT n_chars AS s, toxic FROM documents JOIN labels USING (doc_id)), g AS (SELECT s, sum(toxic) AS tp, count(*) AS n FROM j GROUP BY s)
SELECT s AS threshold, round(sum(tp) OVER w / sum(n) OVER w, 6) AS precision, round(sum(tp) OVER w / sum(tp) OVER (), 6) AS recall FROM g WINDOW w AS (ORDER BY s DESC)""")
def pr_curve(spark, d):
    """AG29: precision and recall at each score."""
    curve = metrics.precision_recall(_scored(spark, d), "n_chars", "toxic")
    return curve.select(F.col("n_chars").alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("roc_auc", """WITH j AS (SELECT n_chars AS s, toxic::DOUBLE AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT s, sum(y) AS p, count(*)::DOUBLE AS n FROM j GROUP BY s),
r AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS r FROM g) SELECT round((sum(r * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)), 6) AS auc FROM r""")
def roc_auc(spark, d):
    """AG18."""
    return metrics.roc_auc(_scored(spark, d), "n_chars", "toxic").withColumn("auc", F.round("auc", 6))


@register("duration_by_class", "SELECT event_type, round_even(sum(value) / 60, 1) AS minutes, count(*) AS n FROM events GROUP BY event_type")
def duration_by_class(spark, d):
    """AG12, AG13."""
    return table(spark, d, "events").groupBy("event_type").agg(F.bround(F.sum("value") / 60, 1).alias("minutes"), F.count("*").alias("n"))


@register("class_histogram", "SELECT event_type, count(DISTINCT user_id) AS files FROM events GROUP BY event_type")
def class_histogram(spark, d):
    """AG28."""
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("files"))


@register("worker_metric_reduce", "SELECT round(100 * sum(tp) / nullif(sum(tp) + sum(fp), 0), 3) AS precision, round(log2(sum(loss) / sum(n)), 3) AS ppl FROM (SELECT user_id, count(*) FILTER (WHERE value > 5) AS tp, count(*) FILTER (WHERE value <= 5) AS fp, sum(value) AS loss, count(*) AS n FROM events GROUP BY user_id)")
def worker_metric_reduce(spark, d):
    """AG17."""
    w = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 5).alias("tp"), F.count_if(F.col("value") <= 5).alias("fp"), F.sum("value").alias("loss"), F.count("*").alias("n"))
    return w.agg(F.round(100 * F.try_divide(F.sum("tp"), F.sum("tp") + F.sum("fp")), 3).alias("precision"), F.round(F.log2(F.sum("loss") / F.sum("n")), 3).alias("ppl"))


@register("var_by_dim", "WITH l AS (SELECT unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT dim, sqrt(var_samp(v) + 1e-6) AS s FROM l GROUP BY dim) SELECT round(avg(s), 6) AS spread FROM s")
def var_by_dim(spark, d):
    """AG16."""
    long = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("dim", "v"))
    return long.groupBy("dim").agg(F.sqrt(F.var_samp(F.col("v").cast("double")) + 1e-6).alias("s")).agg(F.round(F.avg("s"), 6).alias("spread"))


@register("correlation", "SELECT round(corr(value, event_id), 6) AS r FROM events")
def correlation(spark, d):
    """AG19."""
    return table(spark, d, "events").agg(F.round(F.corr("value", "event_id"), 6).alias("r"))


@register("knn_purity", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, round(list_sum([(a.e[i] - b.e[i]) * (a.e[i] - b.e[i]) for i in range(1, 65)]), 9) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT same, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rk FROM p) SELECT round(avg(same::INT), 6) AS purity FROM r WHERE rk <= 10""")
def knn_purity(spark, d):
    """JN16."""
    return neighbours.knn_purity(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 10).withColumn("purity", F.round("purity", 6))


@register("knn_join", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS other, round(list_sum([(a.e[i] - b.e[i]) * (a.e[i] - b.e[i]) for i in range(1, 65)]), 9) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS rank FROM p) SELECT vec_id, rank, other, round(d, 6) AS d FROM r WHERE rank <= 3""")
def knn_join(spark, d):
    """JN16: the three nearest other rows of every row."""
    near = neighbours.nearest_rows(table(spark, d, "embeddings"), "vec_id", "embedding", 3)
    return near.select(F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), "other", F.round("d", 6).alias("d"))


@register("cluster_nmi", """WITH p AS (SELECT label AS a, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1) AS b FROM embeddings), t AS (SELECT count(*)::DOUBLE AS n FROM p), ab AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2), ca AS (SELECT a, count(*) AS n FROM p GROUP BY 1), cb AS (SELECT b, count(*) AS n FROM p GROUP BY 1),
mi AS (SELECT sum(ab.n / t.n * ln(ab.n * t.n / (ca.n * cb.n))) AS v FROM ab JOIN ca USING (a) JOIN cb USING (b), t), ha AS (SELECT -sum(ca.n / t.n * ln(ca.n / t.n)) AS v FROM ca, t), hb AS (SELECT -sum(cb.n / t.n * ln(cb.n / t.n)) AS v FROM cb, t)
SELECT round(mi.v / ((ha.v + hb.v) / 2), 6) AS nmi FROM mi, ha, hb""")
def cluster_nmi(spark, d):
    """AG20: normalised mutual information from a contingency table."""
    m = _matrix(spark, d).where("n > 0")
    whole, ra, rb = W.partitionBy(F.lit(0)), W.partitionBy("truth"), W.partitionBy("predicted")
    x = m.select("truth", "predicted", F.col("n").cast("double").alias("n"), F.sum("n").over(whole).cast("double").alias("t"), F.sum("n").over(ra).alias("a"), F.sum("n").over(rb).alias("b"))
    p = lambda c: F.col(c) / F.col("t")
    agg = x.agg(F.sum(p("n") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"), (-F.sum(p("n") * F.ln(p("a")))).alias("ha"), (-F.sum(p("n") * F.ln(p("b")))).alias("hb"))
    return agg.select(F.round(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2), 6).alias("nmi"))


@register("best_layer", "WITH s AS (SELECT label AS layer, round(avg(embedding[1]), 6) AS f1 FROM embeddings GROUP BY 1) SELECT layer, f1 FROM s ORDER BY f1 DESC, layer LIMIT 1")
def best_layer(spark, d):
    """AG21: the best one, the first on ties."""
    s = table(spark, d, "embeddings").groupBy(F.col("label").alias("layer")).agg(F.round(F.avg(F.element_at("embedding", 1).cast("double")), 6).alias("f1"))
    return s.orderBy(F.desc("f1"), "layer").limit(1)


@register("composite_score", "SELECT user_id, round(0.5 * avg(value) FILTER (WHERE event_type = 'click') + 0.3 * avg(value) FILTER (WHERE event_type = 'error') + 0.2 * avg(value) FILTER (WHERE event_type = 'signup'), 6) AS score FROM events GROUP BY user_id")
def composite_score(spark, d):
    """AG22: null where any part is missing."""
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(0.5 * mean("click") + 0.3 * mean("error") + 0.2 * mean("signup"), 6).alias("score"))


@register("otsu_threshold", """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), h AS (SELECT least(floor((value - lo) / (hi - lo) * 64), 63) AS bin, lo, hi, count(*)::DOUBLE AS n FROM events, b GROUP BY 1, 2, 3),
m AS (SELECT bin, lo + (bin + 0.5) * (hi - lo) / 64 AS mid, n FROM h), s AS (SELECT bin, mid, sum(n) OVER w AS w0, sum(n * mid) OVER w AS s0, sum(n) OVER () AS w, sum(n * mid) OVER () AS s FROM m WINDOW w AS (ORDER BY bin))
SELECT round(mid, 6) AS threshold FROM s WHERE w0 < w ORDER BY round(pow(s * w0 / w - s0, 2) / (w0 * (w - w0)), 6) DESC, bin LIMIT 1""")
def otsu_threshold(spark, d):
    """AG31."""
    return metrics.otsu(table(spark, d, "events"), "value", 64).withColumn("threshold", F.round("threshold", 6))


@register("label_encode", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def label_encode(spark, d):
    """ML2: ranks over the distinct labels, a few rows, joined back."""
    ev = table(spark, d, "events")
    codes = ev.select("event_type").distinct().select("event_type", (F.row_number().over(W.orderBy("event_type")) - 1).cast("long").alias("code"))
    return ev.join(codes, "event_type").select("event_id", "code")


@register("standardize", "WITH l AS (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY dim) SELECT vec_id, dim, round((v - m) / s, 5) AS z FROM l JOIN s USING (dim)")
def standardize(spark, d):
    """ML1: by statistics of each dimension, one row a dimension."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    stats = rows.select(F.posexplode("e").alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    facts = stats.groupBy().agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("f"))  # one row, an entry a dimension
    z = F.zip_with("e", "f", lambda v, f: F.round((v - f["m"]) / f["s"], 5))
    out = rows.crossJoin(F.broadcast(facts)).select("vec_id", F.posexplode(z).alias("dim", "z"))
    return out.select("vec_id", F.col("dim").cast("long").alias("dim"), "z")


@register("zscore_array", "WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_avg(embedding::DOUBLE[]) AS m FROM embeddings), s AS (SELECT vec_id, e, m, sqrt(list_avg([(v - m) * (v - m) for v in e])) AS s FROM x) SELECT vec_id, round(list_max([(v - m) / s for v in e]), 6) AS peak FROM s")
def zscore_array(spark, d):
    """SF22."""
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(scalars.zscore("embedding")), 6).alias("peak"))


@register("conv_length", "SELECT doc_id, floor((floor((floor((n_chars - 10) / 5.0) + 1 - 3) / 2.0) + 1 - 3) / 2.0)::BIGINT + 1 AS frames FROM documents")
def conv_length(spark, d):
    """SF23."""
    return table(spark, d, "documents").select("doc_id", scalars.conv_length("n_chars", [(10, 5), (3, 2), (3, 2)]).cast("long").alias("frames"))


@register("sigmoid_threshold", "SELECT event_id, round(1 / (1 + exp(-(value - 5))), 6) AS p, 1 / (1 + exp(-(value - 5))) >= 0.5 AS on_ FROM events")
def sigmoid_threshold(spark, d):
    """SF25."""
    p = scalars.sigmoid(F.col("value") - 5)
    return table(spark, d, "events").select("event_id", F.round(p, 6).alias("p"), (p >= 0.5).alias("on_"))


@register("focal_loss", "WITH p AS (SELECT event_id, 1 / (1 + exp(-(value - 5))) AS p, (event_type = 'error')::INT AS y FROM events) SELECT event_id, round(-(CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END) * pow(1 - (CASE WHEN y = 1 THEN p ELSE 1 - p END), 2) * ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12)), 6) AS loss FROM p")
def focal_loss(spark, d):
    """SF26."""
    rows = table(spark, d, "events").select("event_id", scalars.sigmoid(F.col("value") - 5).alias("p"), (F.col("event_type") == "error").cast("int").alias("y"))
    return rows.select("event_id", F.round(scalars.focal_loss("p", "y"), 6).alias("loss"))


@register("mix_blend", "SELECT vec_id, round(1 / (1 + pow(10, (embedding[1]::DOUBLE - embedding[2]::DOUBLE) / 20)), 6) AS p FROM embeddings")
def mix_blend(spark, d):
    """SF28."""
    return table(spark, d, "embeddings").select("vec_id", F.round(scalars.mix_share(F.element_at("embedding", 1).cast("double"), F.element_at("embedding", 2).cast("double")), 6).alias("p"))


@register("mel_scale", "SELECT event_id, round(2595 * log10(1 + value * 100 / 700), 6) AS mel, round(700 * (pow(10, 2595 * log10(1 + value * 100 / 700) / 2595) - 1), 4) AS hz FROM events")
def mel_scale(spark, d):
    """SF29."""
    mel = scalars.hz_to_mel(F.col("value") * 100)
    return table(spark, d, "events").select("event_id", F.round(mel, 6).alias("mel"), F.round(scalars.mel_to_hz(mel), 4).alias("hz"))


@register("loudness", "SELECT vec_id, round(greatest(20 * log10(greatest(sqrt(list_avg([v::DOUBLE * v::DOUBLE for v in embedding])), 1e-12)), -100), 6) AS db FROM embeddings")
def loudness(spark, d):
    """SF27."""
    return table(spark, d, "embeddings").select("vec_id", F.round(scalars.loudness_db("embedding"), 6).alias("db"))


@register("mono_mix", "SELECT vec_id, round(list_max([(embedding[i]::DOUBLE + embedding[i + 32]) / 2 for i in range(1, 33)]), 6) AS peak FROM embeddings")
def mono_mix(spark, d):
    """SF19: two channels to their mean."""
    mono = F.zip_with(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), lambda a, b: (a.cast("double") + b.cast("double")) / 2)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(mono), 6).alias("peak"))


@register("collate_pad", "SELECT doc_id, least(n_chars, 1000) AS kept, greatest(1000 - n_chars, 0) AS pad FROM documents")
def collate_pad(spark, d):
    """ML10: cropped or padded to a length, with the padding counted."""
    return table(spark, d, "documents").select("doc_id", F.least("n_chars", F.lit(1000)).cast("long").alias("kept"), F.greatest(1000 - F.col("n_chars"), F.lit(0)).cast("long").alias("pad"))
