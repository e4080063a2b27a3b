"""Vector codes: product quantisation whose codebooks come from exact integer Lloyd rounds with Hamerly's bounds.

A vector is a number of parts, and each part has a codebook of its own. For each part of each vector two bounds are kept
from round to round: an upper one on the distance to its own entry, and a lower one on that to the second nearest. When
entries have moved, the upper bound grows by the way of its own entry, and the lower one falls by the longest way of any
other. While the upper bound is less than the lower one, or than half the way to the entry nearest to its own, the part stays
where it is. Only where that fails strictly is the exact distance to its own entry taken, and where that fails too all
entries are scanned, in whole numbers. Bounds are rounded outwards, so a part that may tie is always scanned, and the scan
gives ties to the lower index. The result is that of plain Lloyd.

A round is one map over the table of the round before, which carries integers, codes and bounds, and one sum over it: no
shuffle but that of partial sums. Codebooks are a bounded number of integers; vectors and codes stay in the cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_facts, materialize, scratch, table
from .grid import SUMS, doubles, finite, on_grid, split_sums, total

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bounds are rounded outwards by this share, more than the rounding of the few operations that make them.
UP, DOWN = 1 + 2.0**-50, 1 - 2.0**-50
#: Rows of parts that a full scan compares with all entries at once.
SCANNED = 8192


def _length(squares: np.ndarray, outwards: float) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * outwards


class Book:
    """Codebooks of a round, (parts, entries, width) integers, and how they moved since the round before."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        parts, count, _ = entries.shape
        apart = ((entries[:, :, None] - entries[:, None]) ** 2).sum(axis=3).astype(np.float64)
        apart[:, np.arange(count), np.arange(count)] = np.inf
        self.half = np.sqrt(apart.min(axis=2)) / 2 * DOWN
        moved = np.zeros((parts, count)) if before is None else _length(((entries - before) ** 2).sum(axis=2), UP)
        order = np.sort(moved, axis=1)
        longest, second = order[:, -1:], order[:, -2:-1] if count > 1 else np.zeros((parts, 1))
        self.moved = moved
        self.others = np.where((moved == longest) & ((moved == longest).sum(axis=1, keepdims=True) == 1), second, longest)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of one part: the nearest entry, the lower index at a tie, and the bounds that follow."""
    near, upper, lower = np.empty(len(x), dtype=np.uint8), np.empty(len(x)), np.empty(len(x))
    for i in range(0, len(x), SCANNED):
        d = ((x[i : i + SCANNED, None] - entries[None]) ** 2).sum(axis=2)
        best = d.argmin(axis=1)
        at = np.arange(len(d))
        near[i : i + SCANNED] = best
        upper[i : i + SCANNED] = _length(d[at, best], UP)
        if entries.shape[0] == 1:
            lower[i : i + SCANNED] = np.inf
        else:
            d[at, best] = np.iinfo(np.int64).max
            lower[i : i + SCANNED] = _length(d.min(axis=1), DOWN)
    return near, upper, lower


def assign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: Book) -> int:
    """Bring codes and bounds of all parts, (rows, parts, width), up to date in place; how many parts were scanned."""
    scanned = 0
    for p in range(x.shape[1]):
        own = code[:, p]
        u = (upper[:, p] + book.moved[p, own]) * UP
        low = np.maximum((lower[:, p] - book.others[p, own]) * DOWN, 0)
        bound = np.maximum(low, book.half[p, own])
        open_ = np.flatnonzero(~(u < bound))
        if len(open_):
            u[open_] = _length(((x[open_, p] - book.entries[p, own[open_]]) ** 2).sum(axis=1), UP)
            open_ = open_[~(u[open_] < bound[open_])]
            code[open_, p], u[open_], low[open_] = scan(x[open_, p], book.entries[p])
            scanned += len(open_)
        upper[:, p], lower[:, p] = u, low
    return scanned


def _matrix(column, kind, shape: tuple) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), *shape).copy()


def _binary(a: np.ndarray):
    import pyarrow as pa

    return pa.array([r.tobytes() for r in a], pa.binary())


STATE = "vec_id long, label string, q binary, code binary, upper binary, lower binary"


def _first(width: int, parts: int, entries: np.ndarray):
    """Rows with an array of integers `q`, as state: every part is scanned."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, parts, width)
            code, upper, lower = np.empty(x.shape[:2], np.uint8), np.empty(x.shape[:2]), np.empty(x.shape[:2])
            for p in range(parts):
                code[:, p], upper[:, p], lower[:, p] = scan(x[:, p], entries[p])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _binary(x.astype(np.int32)), _binary(code), _binary(upper), _binary(lower)], names=["vec_id", "label", "q", "code", "upper", "lower"])

    return run


def _next(width: int, parts: int, book: Book, last: bool):
    """State brought up to the book; after the last round the error stands in place of the bounds."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("q"), np.int32, (parts, width)).astype(np.int64)
            code, upper, lower = _matrix(b.column("code"), np.uint8, (parts,)), _matrix(b.column("upper"), np.float64, (parts,)), _matrix(b.column("lower"), np.float64, (parts,))
            assign(x, code, upper, lower, book)
            kept = [b.column("vec_id"), b.column("label")]
            if last:
                error = ((x - book.entries[np.arange(parts), code]) ** 2).sum(axis=(1, 2))
                yield pa.RecordBatch.from_arrays([*kept, _binary(code), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([*kept, b.column("q"), _binary(code), _binary(upper), _binary(lower)], names=["vec_id", "label", "q", "code", "upper", "lower"])

    return run


def _sums(width: int, parts: int, count: int):
    """Sums of components and counts for each entry of each part, over a partition."""

    def run(batches):
        import pyarrow as pa

        sums, counts = np.zeros((parts, count, width), dtype=object), np.zeros((parts, count), dtype=object)
        for b in batches:
            if not b.num_rows:
                continue
            x, code = _matrix(b.column("q"), np.int32, (parts, width)).astype(np.int64), _matrix(b.column("code"), np.uint8, (parts,))
            for p in range(parts):
                mine = np.zeros((count, width), dtype=np.int64)
                np.add.at(mine, code[:, p], x[:, p])
                sums[p] += mine
                counts[p] += np.bincount(code[:, p], minlength=count)
        slots = [*sums.ravel(), *counts.ravel()]
        hi, lo = split_sums(slots)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slots)), pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["slot", "hi", "lo"])

    return run


def _moved(entries: np.ndarray, slots: list[int]) -> np.ndarray:
    parts, count, width = entries.shape
    sums, counts = slots[: entries.size], slots[entries.size :]
    out = [sums[i] // counts[i // width] if counts[i // width] else int(v) for i, v in enumerate(entries.ravel())]
    return np.array(out, dtype=np.int64).reshape(parts, count, width)


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Code words for each vector, (vec_id, label as text, code, error), and the codebooks, (parts, entries, width) integers.

    A component becomes floor(scale * x). The codebooks start as the parts of the `entries` smallest keys, ascending, and
    there are at most 256 entries; with fewer rows there are fewer. `code` has a byte for each part, `error` is the sum of the
    squared distances of the last assignment; ties go to the lower index.

    Rows whose vector is null, empty or holds a null or non-finite component are dropped. Rows that can't be compared stay
    with null code and error: those whose vector has not the length that most have (the shorter one, if two are as
    frequent), and those with a component so large that a squared distance might not fit a long. A length that `parts`
    doesn't divide is an error. Repeated rows are rows of their own, those of a repeated key in order of their vectors; rows
    with a null key take part but start no entry unless there are too few others. An empty table gives no rows and no
    entries. Other columns aren't read.
    """
    spark = vectors.sparkSession
    named = F.lit(None).cast("string") if label is None else F.col(label).cast("string")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), named.alias("label"), doubles(vector).alias("v")).where(finite(F.col("v")) & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if lengths is None:
        return rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), dtype=np.int64)
    width, rest = divmod(lengths["size"], parts)
    if rest:
        raise ValueError(f"vectors of length {lengths['size']} can't be cut into {parts} equal parts")
    rows = rows.select("vec_id", "label", F.when(F.size("v") == width * parts, on_grid(F.col("v"), scale)).alias("q"))
    whole = rows.where("q is not null")
    starts = [r["q"] for r in whole.orderBy(F.asc_nulls_last("vec_id"), "q").limit(min(entries, 256)).collect()]
    out_of_grid = rows.where("q is null").select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if not starts:
        return out_of_grid, np.zeros((parts, 0, width), dtype=np.int64)
    book = Book(np.array(starts, dtype=np.int64).reshape(-1, parts, width).transpose(1, 0, 2))
    slots = book.entries.size + parts * len(starts)
    with scratch(spark):
        state = materialize(whole.mapInArrow(_first(width, parts, book.entries), STATE), "state")
        for k in range(rounds):
            sums = state.select("q", "code").mapInArrow(_sums(width, parts, len(starts)), SUMS)
            book = Book(_moved(book.entries, total(sums, slots)), book.entries)
            last = k == rounds - 1
            after = state.mapInArrow(_next(width, parts, book, last), "vec_id long, label string, code binary, error long" if last else STATE)
            after = materialize(after.unionByName(out_of_grid) if last else after, "codes" if last else "state", keep=last)
            discard(state)
            state = after
    return state, book.entries


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op12_vector_codes`: all vectors in 8 parts of 16 entries; errors summed by label, nulls together."""
    with scratch(spark):
        coded, books = encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), label="label")
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        rows = coded.withColumn("none", F.col("label").isNull()).withColumn("label", F.coalesce("label", F.lit("")))
        facts = materialize(rows.groupBy("none", "label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count("*").alias("n")), "labels")
        out = join_facts(rows, facts, ["none", "label"], coded.count())
        out = out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.expr("try_cast(label_error as long)").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
        return materialize(out, "coded", keep=True)


def _oracle() -> str:
    """Plain Lloyd, round by round."""
    steps = [f"""q AS (SELECT vec_id, label, (i - 1) // 8 AS part, (i - 1) % 8 AS pos, floor({SCALE} * e[i])::BIGINT AS x
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0), range(1, 65) t(i)),
c0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, pos, x FROM q WHERE vec_id IN (SELECT DISTINCT vec_id FROM q ORDER BY vec_id LIMIT {ENTRIES}))"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""d{k} AS (SELECT vec_id, part, entry, sum((q.x - c.x) * (q.x - c.x))::BIGINT AS d FROM q JOIN c{k} c USING (part, pos) GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM d{k} GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM q JOIN a{k} USING (vec_id, part) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} LEFT JOIN s{k} USING (part, entry, pos))""")
    return f"""WITH {', '.join(steps)},
r AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
l AS (SELECT r.*, label FROM r JOIN embeddings USING (vec_id))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256 FROM l"""


ORACLE_SQL = _oracle()
