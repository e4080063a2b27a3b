"""Near-duplicates, embeddings and nearest neighbours against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import common, embeddings, minhash, nearest
from tests.conftest import SMALL


def smallest(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(words)} - {()} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def made_docs(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(n // 6):
        base = rng.choices(words, k=rng.randint(20, 120))
        docs.append(base)
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(copy)
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize("shingle,num", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, shingle, num):
    texts = [*made_docs(shingle), None, "", "  \t", "one two", "One  TWO", "ÄB cd ef", "äb cd ef", "x " * 30_000, "x " * 30_000 + "y"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    out = {r["key"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle, num).collect()}
    sets = {k: shingles(t, shingle) for k, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = smallest(sets, links)
    assert {k: r["component"] for k, r in out.items()} == want
    assert {k: r["n"] for k, r in out.items()} == {k: len(s) for k, s in sets.items()}
    assert all(r["kept"] == (want[k] == k) for k, r in out.items()) and len(set(want.values())) < len(want)


def test_crowded_region(spark):
    """A base and hundreds of edited copies: one region for every tree."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        copy = list(base)
        for _ in range(rng.randint(1, 7)):
            copy[rng.randrange(150)] = f"n{rng.random()}"
        rows.append((i, " ".join(copy)))
    out = {r["key"]: r["component"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    sets = {k: shingles(t, 3) for k, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert out == smallest(sets, links)


def test_crowd_without_a_base(spark):
    """Thousands of texts from one template, under the threshold to each other; hundreds have one near copy above it."""
    rng = random.Random(11)
    frame = [f"t{i}" for i in range(130)]
    rows, number = [], iter(range(10**6))
    for i in range(4000):
        own = [f"o{next(number)}" for _ in range(12)]
        rows.append((i, " ".join(frame + own)))
        if i < 600:
            copy = frame + own
            for at in (0, 141, *rng.sample(range(4, 126, 4), 3)):
                copy[at] = f"e{next(number)}"
            rows.append((10_000 + i, " ".join(copy)))
    sets = {k: shingles(t, 3) for k, t in rows}
    assert all(100 * len(sets[i] & sets[10_000 + i]) >= 85 * len(sets[i] | sets[10_000 + i]) for i in range(600))
    assert 100 * len(sets[0] & sets[1]) < 85 * len(sets[0] | sets[1])
    out = {r["key"]: r["component"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()}
    assert out == {k: k % 10_000 for k in sets}


def test_near_duplicates_odd_rows(spark):
    text = "a b c d e f g h i j"
    rows = [(None, text, 1), (7, text, 2), (7, text, 3), (9, text, 4), (None, "lone words here are few", 5), (3, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int").withColumnRenamed("component", "digest")
    out = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert len(out) == 6 and all(r[2] == 7 for r in out if r[1] == 6 and r[0] is not None)
    assert (None, 6, 7, False) in out and (None, 1, None, False) in out and (3, 0, 3, True) in out
    assert sorted(r["doc_id"] is None for r in minhash.keep_first(df).collect()) == [False, False, True, True]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_first(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(90)] + [(2000, 2000 + i) for i in range(1, 60)] + [(5, 5), (None, 3)]
    out = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert out == smallest({n for l in real for n in l}, real)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_are_dealt_out(spark):
    """Keys with half and a quarter of all rows, null keys' rows left out, one row of facts each."""
    rows = spark.range(4_000).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 4 == 1, 2).otherwise(F.col("id")).alias("k"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    facts = common.materialize(rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")), "facts")
    out = common.join_facts(rows, facts, ["k"], 4_001)
    assert out.columns == ["k", "id", "n", "first"] and out.count() == out.select("id").distinct().count() == 4_000
    assert {(r["k"], r["n"], r["first"]) for r in out.where("k < 3").distinct().collect()} == {(1, 2_000, 0), (2, 1_000, 1)}


def test_a_third_equal(spark):
    """A third of all texts and vectors are one: a class whose rows are dealt over tasks."""
    text = "one text that a third of all rows share word for word"
    rows = [(i, text if i % 3 == 0 else f"text number {i} with words of its own n{i} m{i} k{i}") for i in range(300)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["key"]: r["component"] for r in out} == {i: 0 if i % 3 == 0 else i for i, _ in rows}
    rng = np.random.default_rng(1)
    same = rng.standard_normal(8).tolist()
    vectors = [(i, same if i % 3 == 0 else rng.standard_normal(8).tolist()) for i in range(300)]
    found = {r["key"]: r for r in embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert [found[i]["n_links"] for i in range(300)] == ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()


def test_components_of_hubs(spark, monkeypatch):
    """Two hubs with most of the links, which are dealt over tasks, and a flushed forest."""
    monkeypatch.setattr(common, "FOREST_NODES", 50)
    rng = random.Random(5)
    links = [(h, i) for h in (7_000, 3) for i in rng.sample(range(10, 6_000), 900)] + [(9_000 + i, 9_001 + i) for i in range(0, 60, 2)]
    out = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert out == smallest({n for l in links for n in l}, links)


@pytest.mark.parametrize("shape", ["chain", "hubs", "pairs"])
def test_crowds_equal_brute_force(spark, shape):
    """Over SMALL texts of one prefix region: a chain of edits, two bases with copies, pairs away from the base."""
    rng = random.Random(shape)
    words = [f"v{i}" for i in range(3_000)]
    base = rng.choices(words, k=150)

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            t[rng.randrange(len(t))] = rng.choice(words)
        return t

    texts = []
    if shape == "chain":
        for _ in range(120):
            texts.append(base)
            base = edited(base, 2)
    elif shape == "hubs":
        other = edited(base, 12)
        texts = [edited(b, rng.randint(0, 3)) for b in (base, other) for _ in range(60)]
    else:
        for _ in range(60):
            far = edited(base, 7)
            texts += [far, edited(far, 2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingles(t, 5) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    out = {r["key"]: r["component"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == smallest(range(len(rows)), links)


def test_unlike_texts_of_one_id_stay(spark):
    rows = [(1, "one text of many quite different words here"), (1, "one text of many quite different words here"), (1, "another one, with nothing in common at all"), (2, None), (2, ""), (None, "one text of many quite different words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(0), "place": F.lit(0), "many": F.lit(0)})
    out = minhash.keep_first(df)
    assert out.columns == df.columns and sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted((str(a), str(b)) for a, b in set(rows))


def made_vectors(seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, 16))
    rows = [*base, *[b + rng.standard_normal(16) * s for b in base[:15] for s in (0.02, 0.1, 0.2, 0.3)], *base[:5] * 3, base[0], base[0]]
    out = [list(map(float, r)) for r in rows]
    return out + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]


def test_embeddings_equal_brute_force(spark):
    rows = list(enumerate(made_vectors(1)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("x"))
    out = {r["key"]: r for r in embeddings.near_duplicates(df).collect()}
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    want = smallest([i for i, _ in rows], links)
    assert {k: r["component"] for k, r in out.items()} == want
    assert {k: r["n_links"] for k, r in out.items()} == {i: sum(i in l for l in links) for i, _ in rows}


def test_embeddings_in_blocks(spark, monkeypatch):
    """Crowded buckets are dealt out as pairs of blocks, with the same result."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, list(map(float, base + rng.standard_normal(16) * 0.08))) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = sorted(map(tuple, embeddings.near_duplicates(df).collect()))
    monkeypatch.setattr(embeddings, "BLOCK", 25)
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == plain
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert [r[1] for r in plain] == ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()


def test_embeddings_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(empty).count() == 0
    assert nearest.nearest(empty, F.lit(True)).count() == 0


def exact_nearest(rows, asks, k):
    """By the inner product in double precision, after one scaling by a power of two; ties go to the smaller id."""
    scale = -np.frexp(max(np.abs(v).max() for _, v in rows))[1]
    ids, x = np.array([i for i, _ in rows]), np.ldexp(np.array([v for _, v in rows], dtype=np.float64), scale)
    out = {}
    for i, v in zip(ids.tolist(), x):
        if asks(i):
            order = np.lexsort((ids, -(x * v).sum(axis=1)))
            out[i] = [j for j in ids[order].tolist() if j != i][:k]
    return out


def found_nearest(out):
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def recall(got, want):
    return sum(len(set(got[q]) & set(v)) for q, v in want.items()) / sum(map(len, want.values()))


def test_nearest_small_and_ties(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(9)]
    odd = [(20, None), (21, [0.0, 0.0]), (None, [1.0, 1.0]), (22, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = found_nearest(nearest.nearest(df, F.col("vec_id") % 4 == 0, k=20))
    assert got == exact_nearest(rows, lambda i: i % 4 == 0, 20)


@pytest.mark.parametrize("scale", [1e-200, 1e-7, 1.0, 1e160])
def test_nearest_at_any_scale(spark, scale):
    """Small and huge vectors, with near-ties, over several cells."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((800, 16))
    x[400:] = x[:400] * (1 + 1e-13 * rng.integers(-3, 4, (400, 1)))
    rows = [(i, (v * scale).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found_nearest(nearest.nearest(df, F.col("vec_id") % 40 == 0, 10)), exact_nearest(rows, lambda i: i % 40 == 0, 10)
    assert recall(got, want) >= 0.9 and all(len(v) == 10 for v in got.values())


@pytest.mark.parametrize("kind", ["clustered", "even", "third"])
def test_nearest_over_cells(spark, monkeypatch, kind):
    """Many cells and parts, several rounds and groups of queries; a third of all rows are one vector."""
    for name, value in (("ROWS", 150), ("QUERIES", 40), ("SAMPLE", 1_000)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4_000, 24))
    if kind == "clustered":
        x = rng.standard_normal((25, 24))[rng.integers(0, 25, len(x))] + 0.2 * x
    if kind == "third":
        x[:1_300] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found_nearest(nearest.nearest(df, F.col("vec_id") % 50 == 0, 20)), exact_nearest(rows, lambda i: i % 50 == 0, 20)
    assert recall(got, want) >= 0.9
    if kind == "third":
        assert got[0] == want[0] == list(range(1, 21))


def test_nearest_recall(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in df.collect()]
    want = exact_nearest(rows, lambda i: i % 20 == 0, 20)
    assert recall(found_nearest(nearest.nearest(df, F.col("vec_id") % 20 == 0)), want) >= 0.9


def test_nearest_unequal_lengths(spark):
    """Inner products of vectors of very different lengths, over many blocks."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(12) * rng.random() * 5) for i in range(3000)]
    x = np.array([v for _, v in rows])
    asked = np.arange(0, 3000, 60)
    who, row, _ = nearest.search_part(np.arange(3000), x, asked, x[asked], np.full(len(asked), -np.inf), float(np.linalg.norm(x, axis=1).max()) * 1.000001, 20)
    want = exact_nearest(rows, lambda i: i % 60 == 0, 20)
    got = {}
    for q, j in zip(asked[who].tolist(), row.tolist()):
        got.setdefault(q, set()).add(j)
    assert recall(got, want) >= 0.9


def test_query_groups_follow_the_tree(monkeypatch):
    monkeypatch.setattr(nearest, "QUERIES", 10)
    base, sub = nearest.query_groups([(0, 4), (1, 4), (2, 5), (4, 35), (5, 1)], 7)
    assert base.tolist() == [0, 0, 1, 1, 2, 6, 6] and sub.tolist() == [1, 1, 1, 1, 4, 1, 1]


def test_nearest_reads_parts_for_neighbouring_queries_together(spark, monkeypatch):
    """On clustered vectors of like length a group of queries reads few parts; results are those of brute force."""
    monkeypatch.setattr(nearest, "ROWS", 64)
    monkeypatch.setattr(nearest, "QUERIES", 64)
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 1, (24, 16))
    x = centre[rng.integers(0, 24, 2400)] + rng.normal(0, 0.02, (2400, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    stats = {}
    out = nearest.nearest(df, F.col("vec_id") % 5 == 0, 10, stats=stats).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 2400, 5):
        near = x @ x[q]
        near[q] = -2
        hits += len(got[q] & set(np.argsort(-near, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 10 * 480
    parts, groups = 2400 // 64, 480 // 64
    print(stats, parts * groups)
    assert stats["reads"] < 0.6 * parts * groups
