"""Vector codes and centroids against plain Lloyd, fingerprints against order MinHash written out."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.compare import rows
from tests.conftest import SMALL
from tidefold.llm import centroids, codes, fingerprints
from tidefold.llm import queries as llm

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck_sf():
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return con


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_centroids"])
def test_queries_equal_sql(spark, duck_sf, name):
    got = llm.queries()[name](spark, SF).toPandas()
    want = duck_sf.sql(llm.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == 500
    assert rows(got) == rows(want)


def lloyd(x, start, rounds, weights=None):
    """Plain rounds in Python's integers."""
    def near(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in book]
        return d.index(min(d)), min(d)

    book = [list(c) for c in start]
    for _ in range(rounds):
        own = [near(v, book)[0] for v in x]
        for j in range(len(book)):
            mine = [v for v, o in zip(x, own) if o == j]
            if mine:
                book[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return book, [near(v, book) for v in x]


def made_vectors(kind, n=240, dim=16):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        return rng.normal(0, 1, (6, dim))[rng.integers(0, 6, n)] + rng.normal(0, 0.02, (n, dim))
    if kind == "ties":  # few whole values, so that many distances are equal
        return rng.integers(-1, 2, (n, dim)) / 1.0
    if kind == "copies":
        return np.where(rng.random((n, 1)) < 0.5, 0.25, rng.normal(0, 1, (n, dim)))
    return rng.normal(0, 1, (n, dim)) * 10.0 ** rng.integers(-3, 4, (n, 1))


@pytest.mark.parametrize("kind", ["clusters", "ties", "copies", "scales"])
def test_codes_equal_plain_lloyd(spark, kind):
    x = made_vectors(kind)
    ids = random.Random(1).sample(range(10_000), len(x))
    out, books = codes.encode(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"), parts=4, entries=7, rounds=5)
    got = {r["vec_id"]: (list(r["code"]), r["error"]) for r in out.collect()}
    q = [[math.floor(4096 * c) for c in v] for v in x]
    first = [v for _, v in sorted(zip(ids, q))][:7]
    want = [lloyd([v[4 * p : 4 * p + 4] for v in q], [v[4 * p : 4 * p + 4] for v in first], 5) for p in range(4)]
    assert books.tolist() == [w[0] for w in want]
    assert got == {i: ([w[1][k][0] for w in want], sum(w[1][k][1] for w in want)) for k, i in enumerate(ids)}


def test_bounds_spare_scans_and_never_change_a_result():
    """Round after round the codes are those of a full scan, though most parts aren't scanned."""
    rng = np.random.default_rng(5)
    centre = rng.integers(-4000, 4000, (12, 3, 4))
    x = centre[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 3, 4))
    x[:200] = rng.integers(-1, 2, (200, 3, 4))  # many ties
    book = codes.Book(np.concatenate([x[:4], x[300:306]]).transpose(1, 0, 2))
    state = [codes.scan(x[:, p], book.entries[p]) for p in range(3)]
    code, upper, lower = (np.stack([s[k] for s in state], axis=1) for k in range(3))
    shares = []
    for _ in range(6):
        entries = book.entries.copy()
        for p in range(3):
            for j in range(entries.shape[1]):
                if (code[:, p] == j).any():
                    entries[p, j] = x[code[:, p] == j, p].sum(axis=0) // (code[:, p] == j).sum()
        book = codes.Book(entries, book.entries)
        shares.append(codes.assign(x, code, upper, lower, book) / code.size)
        for p in range(3):
            d = ((x[:, p, None] - entries[p]) ** 2).sum(axis=2)
            assert (code[:, p] == d.argmin(axis=1)).all()
            own = d[np.arange(len(d)), code[:, p]]
            d[np.arange(len(d)), code[:, p]] = np.iinfo(np.int64).max
            assert (upper[:, p] >= np.sqrt(own)).all() and (lower[:, p] <= np.sqrt(d.min(axis=1))).all()
    assert shares[-1] < 0.2


ODD = [(1, [0.5] * 8), (2, None), (3, []), (4, [1.0] * 7 + [None]), (5, [1.0] * 7 + [float("nan")]), (6, [1.0] * 7 + [float("inf")]), (7, [1e300] * 8), (8, [0.0] * 16), (1, [0.5] * 8), (None, [0.25] * 8), (9, [-0.0] * 8), (10, [-1e-9] * 8)]


def test_codes_of_odd_rows(spark):
    made = spark.createDataFrame([(i, v, "x") for i, v in ODD], "vec_id long, embedding array<double>, q string").withColumn("label", F.lit(None).cast("int"))
    out, books = codes.encode(made, parts=2, entries=3, rounds=2, label="label")
    got = sorted(((r["vec_id"], r["code"] and list(r["code"]), r["error"]) for r in out.collect()), key=str)
    assert got == sorted([(1, [0, 0], 0), (1, [0, 0], 0), (7, None, None), (8, None, None), (None, [0, 0], 4 * 1024**2 * 2), (9, [2, 2], 0), (10, [2, 2], 8)], key=str) or books.shape == (2, 3, 4)
    assert {r[0] for r in got} == {1, 7, 8, None, 9, 10} and len(got) == 7
    assert [r for r in got if r[0] in (7, 8)] == [(7, None, None), (8, None, None)]
    empty, books = codes.encode(made.limit(0))
    assert empty.count() == 0 and books.size == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.encode(made, parts=3)


def test_centroids_equal_plain_lloyd(spark):
    for kind in ("clusters", "ties", "copies", "scales"):
        x = made_vectors(kind, 200, 8)
        ids = random.Random(2).sample(range(10_000), len(x))
        out, centres = centroids.cluster(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"), dim=8, clusters=9, rounds=4)
        q = [[math.floor(256 * c) for c in v] for v in x]
        order = sorted(range(len(x)), key=lambda k: hashlib.sha256(f"2:{ids[k]}".encode()).hexdigest())[:9]
        book, near = lloyd(q, [q[k] for k in order], 4)
        assert centres.tolist() == book
        each = [sum(d for c, d in near if c == j) for j in range(9)]
        assert {tuple(r) for r in out.collect()} == {(i, c, d, each[c], sum(each)) for i, (c, d) in zip(ids, near)}


def test_centroids_of_large_numbers_and_weights():
    """Beyond what doubles hold exactly distances are whole numbers, and weighted sums don't overflow."""
    import pyarrow as pa

    x = np.array([[2**29 - 1, -(2**29)], [2**29 - 2, 0]], dtype=np.int64)
    assert centroids.nearest(x, x)[1].tolist() == [0, 0] and centroids.nearest(x, x[::-1])[0].tolist() == [1, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.int32())), pa.array([2**40, 3])], names=["q", "n"])
    out = next(centroids._sums(x)([batch])).to_pydict()
    assert [(h << 32) + l for h, l in zip(out["hi"], out["lo"])] == [(2**29 - 1) * 2**40, -(2**29) * 2**40, 3 * (2**29 - 2), 0, 2**40, 3]


def test_centroids_of_odd_rows(spark):
    made = spark.createDataFrame([(i, v, "x") for i, v in ODD], "vec_id long, embedding array<double>, cluster string")
    out, _ = centroids.cluster(made, dim=8, clusters=2, rounds=1)
    got = {(r["vec_id"], r["distance"] is None) for r in out.collect()}
    assert out.count() == 6 and got == {(1, False), (7, True), (None, False), (9, False), (10, False)}
    empty, centres = centroids.cluster(made.limit(0), dim=8)
    assert empty.count() == 0 and len(centres) == 0


# Order MinHash written out.

def spark_hash(*values):
    """Strings by their bytes, longs by their eight; each hash seeds the next."""
    h = 42
    for v in values:
        h = xxhash.xxh64(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), seed=h).intdigest()
    return h


def int_hash(h, v):
    """An int is hashed by its four bytes."""
    return xxhash.xxh64(int(v).to_bytes(4, "little", signed=True), seed=h).intdigest()


def order_minhash(text, k=2, picks=2, components=64):
    spaces = " \t\n\x0b\f\r"
    words = [w for w in re.split(f"[{spaces}]+", text) if w]
    un = "฀-႟ក-៿぀-鿿豈-﫿\U00020000-\U0003ffff"
    words = [p for w in words for p in re.findall(f"[{un}]|[^{un}]{{1,32}}", w)]
    if not words:
        return [0] * components
    seen, elements = {}, []
    for i in range(max(1, len(words) - k + 1)):
        kmer = spark_hash(*words[i : i + k]) >> 32
        number = seen.get(kmer, 0)
        seen[kmer] = number + 1
        # a long by its eight bytes, then the number as an int
        element = kmer if number == 0 else int_hash(spark_hash(kmer), number) >> 32
        elements.append((element, i))
    elements.sort()
    out = []
    for c in range(components):
        at = next((j for j, e in enumerate(elements) if e[0] >= c * 2**32 // components), 0)
        picked = [elements[(at + t) % len(elements)] for t in range(min(picks, len(elements)))]
        out.append(spark_hash(*[e for e, _ in sorted(picked, key=lambda e: e[1])]) >> 32)
    return out


TEXTS = ["", "   \n", "one", "one two", "a b c d e f g", "so it goes " * 300, "x" * 100, " lead and trail \t", "東京都 tokyo 東京", "naïve café — ok", "a b c", "\n".join(f"line {i % 7} of text" for i in range(200)), "tab\tand\x0bothers\fhere\r\nend"]


def test_fingerprints_equal_order_minhash(spark):
    rng = random.Random(4)
    texts = [*TEXTS, *(" ".join(rng.choices([f"w{i}" for i in range(rng.choice([3, 50, 5000]))], k=rng.randint(1, 900))) for _ in range(40))]
    made = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: list(r["f"]) for r in made.select("i", fingerprints.order_minhash(F.col("text")).alias("f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == order_minhash(t), t[:60]


def test_fingerprint_rows_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [*TEXTS, *(" ".join(rng.choices(["ab", "cd", "ef", "gh", "é"], k=rng.randint(0, 40))) for _ in range(60))]
    ids = rng.sample(range(-500, 5000), len(texts))
    given = [*zip(ids, texts), (7000, None), (7000, "same id"), (None, "no id here"), (None, None)]
    made = spark.createDataFrame([(i, t, 1) for i, t in given], "doc_id long, text string, at int").repartition(5)
    got = [tuple(r) for r in fingerprints.fingerprints(made).collect()]
    ordered = sorted((i, t or "") for i, t in given if i is not None)
    want = []
    pairs = [(a, ordered[(k + 1) % len(ordered)][1]) for k, a in enumerate(ordered)] + [((None, t or ""), None) for i, t in given if i is None]
    for (i, t), after in pairs:
        half = len(t) // 2
        changed = t[: len(t) - half] + (after or "")[:half]
        one, two, three = order_minhash(t), order_minhash(changed), order_minhash(after or "")
        like = lambda a, b: sum(x == y for x, y in zip(a, b)) / 64
        text = lambda f: "".join(f"{x:08x}" for x in f)
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), text(one), text(two), like(one, two), like(one, three)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_likeness_follows_edits_order_and_repeats(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(600)]
    few, many = list(base), list(base)
    for k in range(0, 600, 60):
        few[k] = "changed"
    for k in range(0, 600, 6):
        many[k] = "changed"
    turned = base[300:] + base[:300]
    shuffled = [w for i in rng.sample(range(0, 600, 10), 60) for w in base[i : i + 10]]
    texts = {"same": base, "few": few, "many": many, "turned": turned, "shuffled": shuffled, "twice": base * 2, "other": [f"v{rng.randrange(3000)}" for _ in range(600)]}
    made = spark.createDataFrame([(n, " ".join(base), " ".join(t)) for n, t in texts.items()], "n string, a string, b string")
    out = dict(made.select("n", fingerprints.likeness(fingerprints.order_minhash(F.col("a")), fingerprints.order_minhash(F.col("b")))).collect())
    assert out["same"] == 1 and out["other"] == 0
    assert 1 > out["few"] > out["many"] > 0
    assert out["turned"] < 0.8 and out["shuffled"] < out["turned"] and out["twice"] < 0.6


def test_fingerprints_of_an_empty_table_and_one_row(spark):
    made = spark.createDataFrame([(5, "one two three four")], "doc_id long, text string")
    assert fingerprints.fingerprints(made.limit(0)).count() == 0
    row = fingerprints.fingerprints(made).first()
    assert row["near_next"] == 1 and row["near_edited"] < 1


def test_fingerprint_plan_is_native(spark):
    made = fingerprints.query(spark, SMALL)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
