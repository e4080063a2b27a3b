"""Queries: fitted models and array numerics. Most have no SQL form; tests hold them against direct computation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import metrics, models
from .registry import register
from .views import events, table


@register("edge_segments")
def edge_segments(spark, d):
    """WN6."""
    return models.edge_segments(events(spark, d), "user_id", "event_id", "value", models.EdgeOptions(low=1.0))


_POWER = """f AS (SELECT vec_id, label, k, pow(sum(x * cos(2 * pi() * k * n / 64)), 2) + pow(sum(x * sin(2 * pi() * k * n / 64)), 2) AS p
FROM (SELECT vec_id, label, unnest(range(0, 64)) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings), range(0, 33) r(k) GROUP BY ALL),
b AS (SELECT vec_id, label, CASE WHEN k < 5 THEN 0 ELSE (k - 1) // 4 END AS band, sum(p) AS p, sum(p * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) AS whole FROM f GROUP BY ALL)"""


@register("band_energy", f"WITH {_POWER} SELECT label, band, round(avg(share), 6) AS share FROM (SELECT label, band, p / (sum(p) OVER (PARTITION BY vec_id) + 1e-9) AS share FROM b) GROUP BY ALL")
def band_energy(spark, d):
    """AG24: mean share of each frequency band by class."""
    rows = table(spark, d, "embeddings")
    shares = models.band_shares(rows, "vec_id", "embedding", 8).join(rows.select("vec_id", "label"), "vec_id")
    return shares.select("label", F.posexplode("shares").alias("band", "s")).groupBy("label", "band").agg(F.round(F.avg("s"), 6).alias("share"))


def _mean_power(m: np.ndarray) -> np.ndarray:
    return (m * m).mean(axis=1)


@register("band_occlusion", f"WITH {_POWER} SELECT label, band, round(avg(whole / 4096), 9) AS drop FROM b GROUP BY ALL")
def band_occlusion(spark, d):
    """ML5: with a signal's power as the score."""
    out = models.occlusion(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 8, _mean_power)
    return out.withColumn("drop", F.round("drop", 9))


def _projection():
    lines = np.random.default_rng(0).standard_normal((64, 16)).astype(np.float32)
    return lambda x: np.tanh(x @ lines)


@register("embed_windows")
def embed_windows(spark, d):
    """ML4: with a fixed random projection as the model."""
    out = models.embed(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", _projection, "vector")
    return out.select("vec_id", F.size("vector").alias("size"), F.round(F.element_at("vector", 1).cast("double"), 4).alias("first"))


_COMBO = "WITH c AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'q' ELSE '' END || CASE WHEN toxic = 1 THEN 't' ELSE '' END AS combo FROM labels), r AS (SELECT doc_id, row_number() OVER (PARTITION BY combo ORDER BY md5('{seed}:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY combo) AS n FROM c)"


def _labels(spark, d):
    flags = F.filter(F.array(F.when(F.col("quality") == 1, "q"), F.when(F.col("toxic") == 1, "t")), lambda x: x.isNotNull())
    return table(spark, d, "labels").select("doc_id", flags.alias("labels"))


@register("multilabel_split", " UNION ALL ".join(f"SELECT * FROM ({_COMBO.format(seed=s)} SELECT {s} AS split, doc_id, rn <= round_even(n * 0.2, 0) AS is_valid FROM r)" for s in (0, 1)))
def multilabel_split(spark, d):
    """SO10: two stratified splits of rows with several labels."""
    parts = [models.multilabel_split(_labels(spark, d), "doc_id", "labels", 0.2, s).select(F.lit(s).alias("split"), "doc_id", "is_valid") for s in (0, 1)]
    return parts[0].unionByName(parts[1])


_ROUNDED = "round_even((SELECT count(*) FROM l WHERE {0}) * 0.2, 0)"


@register("iterative_split", f"""WITH l AS (SELECT doc_id, quality = 1 AS q, toxic = 1 AS t, md5('3:' || doc_id) AS h FROM labels),
a AS (SELECT *, CASE WHEN t THEN row_number() OVER (PARTITION BY t ORDER BY h, doc_id) <= {_ROUNDED.format('t')} END AS v FROM l),
b AS (SELECT *, CASE WHEN v IS NULL AND q THEN row_number() OVER (PARTITION BY v IS NULL AND q ORDER BY h, doc_id) <= {_ROUNDED.format('q')} - (SELECT count(*) FROM a WHERE q AND v) ELSE v END AS w FROM a)
SELECT doc_id, CASE WHEN w IS NULL THEN row_number() OVER (PARTITION BY w IS NULL ORDER BY h, doc_id) <= {_ROUNDED.format('NOT q AND NOT t')} ELSE w END AS is_valid FROM b""")
def iterative_split(spark, d):
    """SO10: stratified label by label, the rarest (toxic) first."""
    return models.iterative_split(_labels(spark, d), "doc_id", "labels", 0.2, 3).select("doc_id", "is_valid")


_SHARE = ", ".join(f"{w} * (SELECT count(*) FROM l WHERE {{0}}) AS {{1}}{f}" for f, w in enumerate((3, 1, 1)))


def _choice(by: str) -> str:
    """The fold that wants most, then most rows, then the first, as SQL over the wants by0 ... and n0 ..."""
    beats = lambda f, g: f"({by}{f} > {by}{g} OR ({by}{f} = {by}{g} AND (n{f} > n{g} OR (n{f} = n{g} AND {f} < {g}))))"
    return f"CASE WHEN {beats(0, 1)} AND {beats(0, 2)} THEN 0 WHEN {beats(1, 2)} THEN 1 ELSE 2 END"


_FEWER = "((SELECT count(*) FROM l WHERE t) < (SELECT count(*) FROM l WHERE q))"


@register("iterative_folds", f"""WITH RECURSIVE l AS (SELECT doc_id, quality = 1 AS q, toxic = 1 AS t, md5('7:' || doc_id) AS h FROM labels),
o AS (SELECT doc_id, q, t, CASE WHEN q OR t THEN CASE WHEN {_FEWER} THEN CASE WHEN t THEN 't' ELSE 'q' END ELSE CASE WHEN q THEN 'q' ELSE 't' END END ELSE '-' END AS step, h FROM l),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN step = '-' THEN 2 WHEN (step = 't') = {_FEWER} THEN 0 ELSE 1 END, CASE WHEN q AND t THEN 1 WHEN q THEN 0 ELSE 2 END, h, doc_id) AS rn FROM o),
f AS (SELECT 0::BIGINT AS rn, -1 AS fold, {_SHARE.format('q', 'q')}, {_SHARE.format('t', 't')}, {_SHARE.format('true', 'n')}
UNION ALL SELECT rn, fold, {", ".join([f"q{k} - CASE WHEN q AND fold = {k} THEN 5 ELSE 0 END" for k in range(3)] + [f"t{k} - CASE WHEN t AND fold = {k} THEN 5 ELSE 0 END" for k in range(3)] + [f"n{k} - CASE WHEN fold = {k} THEN 5 ELSE 0 END" for k in range(3)])}
FROM (SELECT r.rn, r.q, r.t, CASE r.step WHEN 'q' THEN {_choice("q")} WHEN 't' THEN {_choice("t")} ELSE {_choice("n")} END AS fold, q0, q1, q2, t0, t1, t2, n0, n1, n2 FROM f JOIN r ON r.rn = f.rn + 1)),
s AS (SELECT q, t, fold, count(*) AS n FROM r JOIN f USING (rn) GROUP BY ALL), e AS (SELECT q, t, fold, sum(n) OVER (PARTITION BY q, t ORDER BY fold) AS upto FROM s)
SELECT doc_id, min(fold) AS fold FROM (SELECT doc_id, q, t, row_number() OVER (PARTITION BY q, t ORDER BY h, doc_id) AS rk FROM l) JOIN e USING (q, t) WHERE rk <= upto GROUP BY doc_id""")
def iterative_folds(spark, d):
    """SO10: three folds of 3, 1 and 1 shares, the label with fewest rows left first."""
    return models.iterative_folds(_labels(spark, d), "doc_id", "labels", [3, 1, 1], 7).select("doc_id", "fold")


@register("few_shot", " UNION ALL ".join(f"SELECT * FROM ({_COMBO.format(seed=9)} SELECT {f} AS fraction, doc_id FROM r WHERE rn <= round_even(n * {f}, 0))" for f in ("0.01::DOUBLE", "0.1::DOUBLE", "0.25::DOUBLE", "0.5::DOUBLE", "0.75::DOUBLE")))
def few_shot(spark, d):
    """SO10: nested training shares, each stratified."""
    parts = [models.multilabel_split(_labels(spark, d), "doc_id", "labels", f, 9).where("is_valid").select(F.lit(f).alias("fraction"), "doc_id") for f in (0.01, 0.1, 0.25, 0.5, 0.75)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("logreg_probe")
def logreg_probe(spark, d):
    """ML1, ML3: accuracy and F1 of a probe on a held-out fold."""
    rows = table(spark, d, "embeddings").withColumn("fold", F.pmod("vec_id", F.lit(5)))
    found = models.logistic_probe(rows, "embedding", "label", "fold", 0)
    classes = rows.select(F.col("label").cast("long").alias("class")).distinct()
    m = metrics.confusion(found, "truth", "predicted", classes)
    return metrics.summary(metrics.class_report(m), m)


@register("cluster_quality")
def cluster_quality(spark, d):
    """AG20."""
    return models.cluster_quality(table(spark, d, "embeddings"), "embedding", 10)
