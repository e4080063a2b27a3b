"""MinHash near-duplicates with an LSH forest.

1. Each text's distinct word shingles become 64-bit hashes; texts with the same set share a digest of 128 bits and are one
   class, named by 64 of them (where two classes would share a name they get others).
2. Each class gets `trees` signature orders: in each, classes are sorted by a sequence of minimum hashes (a range
   partition and a sort, so one crowded region is split over tasks).
3. Neighbours in an order with a long common prefix are candidates. The depth adapts to the region: a run of classes that
   share the first `depth` hashes is taken whole where it is small; a crowded one is split at deeper prefixes, and what is
   still crowded gives, for each member, its neighbours in the order and the region's centre.
4. Candidates whose sketches are far below the threshold are dropped (by over four standard deviations), the others are
   confirmed on the full sets: a region's centre is sent once for each LINKS rows that it meets. Components of confirmed
   links are found in the cluster.
5. What neighbours and centres leave open is settled exactly: the members of a crowded run, or of one that a partition's
   border cuts, that those components don't join yet meet all others of the run on their full sets, in pairs of blocks
   dealt over tasks. Members of the run's largest component meet the others only, so a group of copies costs nothing.

With 20 trees and depth 4, a pair at similarity 0.85 shares a prefix in some tree with probability 1 - 4e-7, at 0.8 with
1 - 3e-5.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _local_forest, components, discard, join_facts, materialize, partitions_for, scratch, small_batches, unused

TREES, DEPTH, DEEPER = 20, 4, 8
HASHES = TREES * (DEPTH + 4)
SMALL, NEAR = 24, 4
BLOCK, BLOCK_ITEMS = 1_500, 1_000_000  # rows and shingles of a block
LINKS = 256  # rows that meet one copy of a set
_SEEDS = np.random.default_rng(20240521).integers(1, 2**32, size=(2, HASHES), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Words(dict):
    """Hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, k: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of a text's word k-shingles; A-Z are lowered, words are cut at ASCII white space.

    With fewer than k words the whole sequence is one shingle; without words the set is empty.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], dtype=np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
        out += h[i : i + n] * _MIX[0]
    out ^= out >> np.uint64(32)
    out *= _MIX[2]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum hashes of a set, under HASHES multiply-shift functions, taken over pieces of the set."""
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 512):
        x = low[i : i + 512, None] * _SEEDS[0] + high[i : i + 512, None] * _SEEDS[1]
        np.minimum(best, x.min(axis=0), out=best)
    best ^= best >> np.uint32(15)
    best *= np.uint32(0x2C1B3C6D)
    best ^= best >> np.uint32(13)
    return best


def _signed(k: int):
    def run(batches):
        words = _Words()
        for pdf in batches:
            sizes, digests, checks, signs = [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, k, words)
                sizes.append(len(s))
                high, low = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                digests.append(high if len(s) else None)
                checks.append(low)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"key": pdf["key"], "nameless": pdf["nameless"], "place": pdf["place"], "n": np.array(sizes, dtype=np.int64), "digest": pd.array(digests, dtype="Int64"), "check": checks, "sign": signs})

    return run


def _orders(batches):
    """A row for each class and tree: the sort key, and a sketch of two bits of each minimum hash."""
    for pdf in batches:
        sign = np.frombuffer(b"".join(pdf["sign"]), dtype=np.uint32).reshape(len(pdf), HASHES)
        bits = (sign & np.uint32(3)).astype(np.uint8)
        packed = bits[:, 0::4] | bits[:, 1::4] << 2 | bits[:, 2::4] << 4 | bits[:, 3::4] << 6
        sketches = [r.tobytes() for r in packed]
        first = sign[:, : TREES * DEPTH].reshape(len(pdf), TREES, DEPTH).astype(">u4")
        deep = (sign >> np.uint32(2)).astype(np.uint8)
        for t in range(TREES):
            more = np.concatenate((deep[:, TREES * DEPTH + t * 4 : TREES * DEPTH + t * 4 + 4], np.roll(deep, -(t * 7 + 3), axis=1)[:, : DEEPER - 4]), axis=1)
            keys = [bytes([t]) + a.tobytes() + b.tobytes() for a, b in zip(first[:, t], more)]
            yield pd.DataFrame({"sort": keys, "digest": pdf["digest"], "sketch": sketches})


_SAME = np.array([sum((x >> s) & 3 == 0 for s in (0, 2, 4, 6)) for x in range(256)], dtype=np.uint8)


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from sketches: the share of equal two-bit fields, less those that are equal by chance."""
    equal = _SAME[a ^ b].sum(axis=1, dtype=np.int64) / HASHES
    return (equal - 0.25) / 0.75


class _Region:
    """The rows of one sorted partition, and the candidate pairs that its crowded and its small regions give."""

    PREFIX = 1 + 4 * DEPTH

    def __init__(self, pdf: pd.DataFrame):
        n = self.n = len(pdf)
        keys = np.frombuffer(b"".join(pdf["sort"]), dtype=np.uint8).reshape(n, self.PREFIX + DEEPER)
        self.keys = keys
        self.sketch = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint8).reshape(n, HASHES // 4)
        self.digest = pdf["digest"].to_numpy(dtype=np.int64)
        differ = keys[1:] != keys[:-1]
        self.common = np.where(differ.any(axis=1), differ.argmax(axis=1), self.PREFIX + DEEPER)  # bytes shared with the row before
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def runs(self, lo: int, hi: int, depth: int):
        """The runs of rows that share `depth` bytes."""
        cuts = (lo + 1 + np.flatnonzero(self.common[lo : hi - 1] < depth)).tolist()
        return zip([lo, *cuts], [*cuts, hi])

    def neighbours(self, lo: int, hi: int, reach: int) -> None:
        for step in range(1, min(reach, hi - lo - 1) + 1):
            x, y = np.arange(lo, hi - step), np.arange(lo + step, hi)
            swap = self.digest[x] > self.digest[y]  # the smaller first, so that all orders give the same pair
            self.pairs.append((np.where(swap, y, x), np.where(swap, x, y)))

    def visit(self, lo: int, hi: int) -> None:
        """A small region gives all its pairs; a crowded one neighbours, its centre with each, and then its deeper parts."""
        todo = [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= SMALL:
                self.neighbours(lo, hi, hi - lo)
                continue
            self.neighbours(lo, hi, NEAR)
            centre = lo + _centre(self.sketch[lo:hi])
            rest = np.concatenate((np.arange(lo, centre), np.arange(centre + 1, hi)))
            self.pairs.append((np.full(len(rest), centre), rest))
            depth = int(self.common[lo : hi - 1].min()) + 1  # where they first part
            if depth <= self.PREFIX + DEEPER:
                todo += [(a, b) for a, b in self.runs(lo, hi, depth) if b - a > 1]

    def found(self, floor: float):
        """The pairs so far whose sketches reach the floor."""
        if self.pairs:
            a, b = (np.concatenate([p[k] for p in self.pairs]) for k in (0, 1))
            self.pairs.clear()
            for i in range(0, len(a), 50_000):
                x, y = a[i : i + 50_000], b[i : i + 50_000]
                ok = _similar(self.sketch[x], self.sketch[y]) >= floor
                yield pd.DataFrame({"a": self.digest[x[ok]], "b": self.digest[y[ok]], "run": None}).drop_duplicates(["a", "b"])

    def members(self, lo: int, hi: int) -> pd.DataFrame:
        """The rows of a run, named by the prefix that they share in all partitions."""
        return pd.DataFrame({"a": self.digest[lo:hi], "b": pd.array([None] * (hi - lo), dtype="Int64"), "run": [self.keys[lo, : self.PREFIX].tobytes()] * (hi - lo)})


def _candidates(floor: float):
    """Candidate pairs of one sorted partition (its size is bounded by the number of partitions), and rows (digest, null,
    run) of the runs that these pairs don't cover: crowded ones, and those at the partition's borders."""

    def run(batches):
        frames = list(batches)
        if not frames:
            return
        rows = _Region(pd.concat(frames, ignore_index=True))
        del frames
        held = 0
        for lo, hi in rows.runs(0, rows.n, rows.PREFIX):
            if hi - lo > SMALL or lo == 0 or hi == rows.n:
                yield rows.members(lo, hi)
            if hi - lo > 1:
                rows.visit(lo, hi)
                held += hi - lo
                if held > 20_000:
                    yield from rows.found(floor)
                    held = 0
        yield from rows.found(floor)

    return run


def _centre(sketch: np.ndarray) -> int:
    """The row nearest to the most common value of each field: what most of a region was copied from."""
    votes = np.zeros((4, HASHES), dtype=np.int64)
    fields = np.stack([(sketch >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(sketch), HASHES)
    for v in range(4):
        votes[v] = (fields == v).sum(axis=0)
    return int((fields == votes.argmax(axis=0)).sum(axis=1).argmax())


def _sets(k: int):
    def run(batches):
        words = _Words()
        for pdf in batches:
            items = [shingle_set(t, k, words) for t in pdf["text"]]
            yield pd.DataFrame({"digest": pdf["digest"], "size": [len(s) for s in items], "items": [s.tobytes() for s in items]})

    return run


def _confirmed(num: int, den: int):
    """Rows sorted by (a, block): the set of `a`, then those of each b; the pairs that reach the similarity num / den, in
    whole numbers."""

    def run(batches):
        x = None
        for pdf in batches:
            ok = []
            for first, items in zip(pdf["first"], pdf["items"]):
                y = np.frombuffer(items, dtype=np.uint64)
                if first:
                    x = y
                    ok.append(False)
                    continue
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pdf.loc[np.array(ok, dtype=bool), ["a", "b"]]

    return run


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are links. Each a is dealt into blocks of about LINKS pairs, and its set sent once to each."""
    facts = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")), "degrees")
    dealt = join_facts(pairs, facts, ["a"], pairs.count())
    dealt = materialize(dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / LINKS)).alias("block")), "blocks")
    heads = dealt.select("a", "block").distinct().join(sets.select(F.col("digest").alias("a"), "items"), "a").select("a", "block", F.lit(True).alias("first"), F.col("a").alias("b"), "items")
    rest = dealt.join(sets.select(F.col("digest").alias("b"), "items"), "b").select("a", "block", F.lit(False).alias("first"), "b", "items")
    rows = heads.unionByName(rest).repartition("a", "block").sortWithinPartitions("a", "block", F.desc("first"))
    return materialize(rows.mapInPandas(_confirmed(num, den), "a long, b long"), "links")


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set in x with each in y: frequent items by a product of matrices, others one by one."""
    (tx, rx), (ty, ry) = ((np.concatenate(s), np.repeat(np.arange(len(s)), [len(v) for v in s])) for s in (x, y))
    (ux, nx), (uy, ny) = np.unique(tx, return_counts=True), np.unique(ty, return_counts=True)
    both, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    often = nx[ix].astype(np.int64) * ny[iy] * 128 > len(x) * len(y)
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    frequent = both[often]
    for i in range(0, len(frequent), 2048):
        part = frequent[i : i + 2048]
        sides = []
        for t, r, n in ((tx, rx, len(x)), (ty, ry, len(y))):
            at = np.minimum(np.searchsorted(part, t), len(part) - 1)
            ok = part[at] == t
            m = np.zeros((n, len(part)), dtype=np.float32)
            m[r[ok], at[ok]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    rare = both[~often]
    if len(rare):
        order = np.argsort(ty, kind="stable")
        ty, ry = ty[order], ry[order]
        at = np.minimum(np.searchsorted(rare, tx), len(rare) - 1)
        ok = rare[at] == tx
        tx, rx = tx[ok], rx[ok]
        first = np.searchsorted(ty, tx)
        many = np.searchsorted(ty, tx, side="right") - first
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()), 4_000_000)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(tx)]):
            m = many[a:b]
            place = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            cell = np.repeat(rx[a:b], m) * len(y) + ry[np.repeat(first[a:b], m) + place]
            out += np.bincount(cell, minlength=out.size).reshape(out.shape)
    return out


def _met(num: int, den: int):
    """Two blocks of a run (or one with itself) compared set by set; the components that they join, as a forest."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["block"] == k] for k in key[1:]]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"hi": [], "lo": []}, dtype="int64")
        x, y = ([np.frombuffer(v, dtype=np.uint64) for v in s["items"]] for s in sides)
        shared = _shared(x, y).astype(np.int64)
        sizes = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :]
        i, j = np.nonzero(den * shared >= num * (sizes - shared))
        u, v = sides[0]["root"].to_numpy()[i], sides[1]["root"].to_numpy()[j]
        links = pd.DataFrame({"hi": np.maximum(u, v), "lo": np.minimum(u, v)})[u != v].drop_duplicates()
        return pd.concat([pd.DataFrame({"hi": [], "lo": []}, dtype="int64"), *_local_forest([links])], ignore_index=True)

    return run


def _remainder(crowd: DataFrame, stars: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (hi, lo) between components that rows of one run (run, digest) add to the components found so far."""
    known = stars.withColumnsRenamed({"node": "digest", "component": "root"})
    rows = crowd.join(known, "digest", "left").withColumn("root", F.coalesce("root", "digest")).join(sets.select("digest", "size"), "digest")
    rows = materialize(rows.select("run", "digest", "root", "size"), "crowd")
    parts = rows.groupBy("run", "root").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    top = F.max(F.struct("m", "s", "root"))
    runs = parts.groupBy("run").agg(top.alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s")).where("m > top.m").withColumn("n", F.col("m"))

    def blocks(n, s):
        return F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(s / F.lit(BLOCK_ITEMS)))

    runs = runs.select("run", "n", F.col("top.root").alias("major"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("others"), blocks(F.col("top.m"), F.col("top.s")).alias("majors"))
    dealt = join_facts(rows, materialize(runs, "runs"), ["run"], rows.count()).withColumn("h", F.xxhash64("digest"))
    is_major = F.col("root") == F.col("major")
    dealt = dealt.withColumn("block", F.when(is_major, F.col("others") + F.pmod("h", "majors")).otherwise(F.pmod("h", "others")))
    # rows of the largest component don't meet each other
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_major, F.col("others")).otherwise(F.col("others") + F.col("majors")) - 1)))
    dealt = dealt.select("digest", "run", F.least("block", "t").alias("i"), F.greatest("block", "t").alias("j"), "block", "root")
    met = dealt.join(sets.select("digest", "items"), "digest").groupBy("run", "i", "j").applyInPandas(_met(num, den), "hi long, lo long")
    more = materialize(met.distinct(), "more")
    discard(rows)
    return more


def _classes(signed: DataFrame) -> DataFrame:
    """Of each class one row: its smallest key (null keys last), where its text is, and its signature."""
    rank = F.when(F.col("nameless"), F.lit(2**63 - 1)).otherwise(F.col("key"))
    found = signed.where("digest is not null").groupBy("digest").agg(F.min(F.when(~F.col("nameless"), F.col("key"))).alias("smallest"), F.min(rank).alias("rank"), F.min_by("place", rank).alias("place"), F.first("sign").alias("sign"), F.count("*").alias("rows"), F.min("check").alias("least"), F.max("check").alias("most"))
    return materialize(found, "classes")


def _grouped(docs: DataFrame, shingle: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """A row for each row of `docs`: key, place (its text's hash), n, root (its group; null for an empty set), component."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("key"), F.col(key).isNull().alias("nameless"), F.xxhash64(text).alias("place"), F.col(text).alias("text"))
    signed = materialize(source.mapInPandas(_signed(shingle), "key long, nameless boolean, place long, n long, digest long, check long, sign binary"), "signed")
    classes = _classes(signed)
    twice = classes.where("least < most").select("digest", F.lit(True).alias("twice"))
    if not twice.isEmpty():  # unequal sets of one name
        signed = signed.join(twice, "digest", "left").withColumn("digest", F.when(F.col("twice"), F.xxhash64("digest", "check")).otherwise(F.col("digest"))).drop("twice")
        signed = materialize(signed, "signed")
        classes = _classes(signed)
    count = classes.count()

    floor = num / den - 4.5 * math.sqrt(0.8875 * 0.1125 / HASHES) / 0.75
    parts = partitions_for(count * TREES, 150_000, least=min(12, max(1, count // 500)))
    rows = classes.select("digest", "sign").mapInPandas(_orders, "sort binary, digest long, sketch binary")
    sorted_rows = rows.repartitionByRange(parts, "sort", "digest").sortWithinPartitions("sort", "digest")
    met = materialize(sorted_rows.mapInPandas(_candidates(floor), "a long, b long, run binary"), "met")
    pairs = materialize(met.where("run is null").select("a", "b").distinct(), "pairs")
    crowd = met.where("run is not null").select("run", F.col("a").alias("digest"))

    # full sets, only of classes that have a candidate or are in a crowd: read again from the texts, one text for each class
    wanted = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).union(crowd.select("digest")).distinct()
    wanted = wanted.join(classes.select("digest", "place", "rank"), "digest")
    rank = F.when(F.col("nameless"), F.lit(2**63 - 1)).otherwise(F.col("key"))
    texts = source.where("text is not null").select("place", rank.alias("rank"), "text").join(wanted, ["place", "rank"]).groupBy("digest").agg(F.first("text").alias("text"))
    sets = materialize(texts.mapInPandas(_sets(shingle), "digest long, size long, items binary"), "sets")
    links = _links(pairs, sets, num, den)
    discard(pairs)

    stars = components(links)
    more = _remainder(crowd, stars, sets, num, den)
    discard(met, sets)
    if not more.isEmpty():
        stars = components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    found = stars.withColumnsRenamed({"node": "digest", "component": "root"})
    labelled = classes.select("digest", "smallest", "rows").join(found, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    first = labelled.groupBy("root").agg(F.min("smallest").alias("component"))
    labels = materialize(labelled.join(first, "root").select("digest", "root", "component", F.col("rows").alias("n")), "labels")
    out = signed.select(F.when(~F.col("nameless"), F.col("key")).alias("key"), "place", F.col("n").alias("size"), "digest")
    joined = join_facts(out.where("digest is not null"), labels, ["digest"], signed.count()).select("key", "place", F.col("size").alias("n"), "root", "component")
    return joined.unionByName(out.where("digest is null").select("key", "place", F.col("size").alias("n"), F.lit(None).cast("long").alias("root"), F.col("key").alias("component")))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate groups: a row for each row of `docs`: key, n (set size), component (the group's smallest key), kept.

    Rows are linked where den * |intersection| >= num * |union| of their shingle sets; equal sets always are. A null or
    empty text, or one without words, has an empty set and is linked with nothing: its component is its own key. Rows
    with a null key take part and have no key of their own: their component is the group's smallest key, or null in a
    group without keys, and kept is false; the same key on several rows stands for each of them. A text is read whole by one
    task, however long. Other columns of `docs` are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with scratch(spark), small_batches(spark):
        out = _grouped(docs, shingle, num, den, key, text).select("key", "n", "component", F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))
        return materialize(out, "groups", keep=True)


def keep_first(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` that stay: of each group the row with the smallest doc_id; of rows equal in id and text one.

    Unlike texts under one id are unlike documents, and all stay. So do rows with a null doc_id, as they can't be told apart.
    Null and empty texts are in no group; texts are read whole, however long; an empty table stays empty; other columns pass
    through, whatever they are called.
    """
    spark = docs.sparkSession
    with scratch(spark), small_batches(spark):
        rows = _grouped(docs, shingle, num, den, "doc_id", "text").where("key is not null")
        rows = materialize(rows.groupBy("key", "place", "root").agg(F.count("*").alias("n")), "rows")
        first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("key", "place", "n")).alias("f")).select("f.*")
        kept = materialize(rows.where("root is null").select("key", "place", "n").unionByName(first), "kept", keep=True)
    key, place, many = (unused(docs, c) for c in ("key", "place", "many"))
    named = docs.where("doc_id is not null").withColumns({key: F.col("doc_id").cast("long"), place: F.xxhash64("text")})
    joined = named.join(kept.withColumnsRenamed({"key": key, "place": place, "n": many}), [key, place])
    out = joined.where(F.col(many) == 1).select(*docs.columns)
    if not kept.where("n > 1").isEmpty():  # only repeated rows are shuffled once more
        out = out.unionByName(joined.where(F.col(many) > 1).dropDuplicates([key, place]).select(*docs.columns))
    return out.unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    """`op2_minhash_near_dedup`: three-word shingles, similarity of 0.85 or more."""
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, num=85)
    return out.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS t FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)]) END AS g FROM w
), n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s), e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN c ON c.a = doc_id
"""
