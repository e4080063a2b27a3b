"""Shard alignment over many tasks, folds by iterative stratification, containment: against versions that go row by row."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidefold.operators import containment, frames, models


def test_shards_over_many_tasks_equal_the_fold(spark, monkeypatch):
    rng = random.Random(1)
    size = {"small": lambda: rng.randint(1, 40), "mixed": lambda: rng.choice([1, 30, 90, 100, 101, 250]), "giants": lambda: rng.choice([100, 150, 350]), "zeros": lambda: rng.choice([0, 0, 50, 100]), "exact": lambda: 25, None: lambda: rng.randint(1, 99)}
    rows = [(k, i, make()) for k, make in size.items() for i in rng.sample(range(5000), 150)] + [("small", 9999, None), ("one", 1, 7)]
    df = spark.createDataFrame(rows, "k string, i long, n long").repartition(4)
    fold = sorted(map(tuple, frames.shard_align(df, "k", "i", "n", 100).collect()), key=repr)
    monkeypatch.setattr(frames, "GROUP_ROWS", 50)
    assert sorted(map(tuple, frames.shard_align(df, "k", "i", "n", 100).collect()), key=repr) == fold and len(fold) == 901
    assert frames.shard_align(df.limit(0), "k", "i", "n", 100).count() == 0


def row_by_row(sets, weights):
    """Iterative stratification, one row after the other."""
    whole, folds = sum(weights), range(len(weights))
    names = sorted({x for s in sets for x in s})
    left = Counter(x for s, n in sets.items() for x in s for _ in range(n))
    want = {x: [left[x] * w for w in weights] for x in names}
    rows = [sum(sets.values()) * w for w in weights]
    out, todo = {s: [0] * len(weights) for s in sets}, dict(sets)

    def one(s, by):
        f = max(folds, key=lambda f: (by[f], rows[f], -f))
        out[s][f] += 1
        rows[f] -= whole
        for x in s:
            want[x][f] -= whole

    while todo:
        names = [x for x in sorted({x for s in todo for x in s}) if sum(n for s, n in todo.items() if x in s)]
        if not names:
            for s in sorted(todo):
                for _ in range(todo[s]):
                    one(s, rows)
            break
        name = min(names, key=lambda x: (sum(n for s, n in todo.items() if x in s), x))
        for s in sorted(s for s in todo if name in s):
            for _ in range(todo.pop(s)):
                one(s, want[name])
    return out


@pytest.mark.parametrize("seed", range(8))
def test_dealt_counts_equal_row_by_row(seed):
    rng = random.Random(seed)
    names = "abcdef"[: rng.randint(1, 6)]
    every = [c for k in range(len(names) + 1) for c in itertools.combinations(names, k)]
    sets = {s: rng.choice([1, 2, 7, 40]) for s in rng.sample(every, rng.randint(1, len(every)))}
    weights = [rng.randint(1, 5) for _ in range(rng.randint(2, 5))]
    assert models.deal_sets(sets, weights) == row_by_row(sets, weights)


def test_large_counts_are_dealt_at_once():
    out = models.deal_sets({("a",): 10**12, ("a", "b"): 10**6 + 1, (): 5}, [8, 1, 1])
    for labels, n in ((("a",), 10**12), (("a", "b"), 10**6 + 1), ((), 5)):
        assert sum(out[labels]) == n
    a = [out["a",][f] + out["a", "b"][f] for f in range(3)]
    assert all(abs(a[f] - (10**12 + 10**6 + 1) * w / 10) <= 1 for f, w in enumerate([8, 1, 1]))


def test_folds_share_every_label_within_a_row(spark):
    rng = random.Random(5)
    rows = [(i, [x for x, p in (("common", 0.6), ("some", 0.2), ("rare", 0.03)) if rng.random() < p]) for i in range(1500)] + [(2000, None), (2001, [None, "some", "some"])]
    df = spark.createDataFrame(rows, "i long, labels array<string>")
    out = {r["i"]: r["fold"] for r in models.iterative_folds(df, "i", "labels", [1, 1, 1, 1], 3).collect()}
    assert set(out) == {i for i, _ in rows}
    for name in ("common", "some", "rare"):
        got = Counter(out[i] for i, ls in rows if ls and name in ls)
        assert max(got.values()) - min(got.get(f, 0) for f in range(4)) <= 1, (name, got)
    assert models.iterative_folds(df.limit(0), "i", "labels", [1, 1], 3).count() == 0


def test_patterns_equal_a_nested_loop(spark):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choices("abcé ", k=rng.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (7, "abcabc"), (None, "no key abc"), (502, "x" * 5000 + "needle")]
    patterns = ["".join(rng.choices("abcé ", k=k)) for k in (1, 1, 2, 2, 3, 3, 4, 5, 8) for _ in range(3)] + ["needle", "", None, "zzz", "abc"]
    t, p = spark.createDataFrame(texts, "i long, text string"), spark.createDataFrame([(x,) for x in patterns], "text string")
    out = containment.containing(t, "i", "text", p, "text")
    want = sorted(((i, x, w) for i, x in texts for w in set(patterns) if x is not None and w is not None and w in x), key=repr)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    plan = containment.containing(t, "i", "text", p.where("text <> ''"), "text")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert containment.containing(t, "i", "text", p.limit(0), "text").count() == 0
    assert containment.containing(t.limit(0), "i", "text", p, "text").count() == 0


def test_texts_are_cut_into_pieces_once(spark):
    """The texts are read for their pieces and once more to verify; pieces are of 1 to 3 characters beyond ASCII too."""
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    texts = [(i, t) for i, t in enumerate(["a\U0001f600b\u00e9c", "xy", "x", "", None, "abcabc", "\U0001f600"] * 3)]
    patterns = ["\U0001f600b\u00e9", "\U0001f600", "xy", "x", "bca", "abca", "zz", "y"]
    t = spark.createDataFrame(texts, "i long, text string").repartition(2)
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    out = containment.containing(t.withColumn("text", F.udf(counted, "string").asNondeterministic()("text")), "i", "text", p, "pattern")
    got = sorted((r["i"], r["pattern"]) for r in out.collect())
    assert got == sorted((i, x) for i, text in texts for x in patterns if text and x in text)
    assert read.value <= 2 * len(texts)
