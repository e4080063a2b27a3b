"""Substring dedup by chunks of SPAN bytes at content-defined places (winnowing over a gear rolling hash).

Of every REACH places in a row, the one whose next sixteen bytes have the least gear hash begins a chunk; that depends on
the bytes there only, so an insertion moves no place behind it. Every passage of SPAN + REACH - 1 bytes thus holds a whole
chunk, whatever its words and wherever it stands, and chunks inside a longer one overlap. Chunks are compared by a 128-bit
digest: a digest's first holder is the smallest doc_id (in it, the first place). Adjoining repeated chunks form spans;
shorter repeats than a chunk are chance and are left alone.

Only digests and counts are shuffled: counted per digest with partial aggregation and written, then joined back to the
chunks. A passage that a third of all documents share is one row after the partial counts, and its chunks are dealt over
many tasks of the join (`join_facts`). A text is cut by one task, whose memory grows with its longest text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_facts, materialize, scratch, small_batches, unused

WINDOW = 16
SPAN, REACH = 88, 64  # REACH is a power of two
GEAR = np.random.default_rng(7).integers(0, 2**32, size=256, dtype=np.uint64).astype(np.uint32)


def _gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + gear[byte], kept to WINDOW shifts, at every place at once."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:  # sums of 2, 4, 8, 16 shifted values
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step)
        h, step = wider, step * 2
    return h


def _sliding(x: np.ndarray, pick) -> np.ndarray:
    """The least or largest (`pick`) of each REACH values in a row."""
    step = 1
    while step < REACH:
        x, step = pick(x[:-step], x[step:]), step * 2
    return x


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places after the WINDOW bytes whose hash is the least of some REACH in a row; two are never over REACH apart."""
    if len(data) < WINDOW + REACH - 1:
        return np.zeros(0, np.int64)
    h = _gear(data)[WINDOW - 1 :]
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    edge = np.zeros(REACH - 1, np.uint32)
    least = np.concatenate((edge, _sliding(h, np.minimum), edge))  # of the windows that a place is in, the largest least
    return WINDOW + np.flatnonzero(_sliding(least, np.maximum) == h)


def chunks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts (bytes) of a text's chunks, all of SPAN bytes, and their digests as two columns; a text's ends have one each."""
    raw = text.encode()
    n = len(raw)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    starts = boundaries(np.frombuffer(raw, dtype=np.uint8)) - WINDOW
    starts = np.unique(np.concatenate(([0, n - SPAN], starts[starts <= n - SPAN])))
    view = memoryview(raw)
    digests = b"".join([xxhash.xxh3_128_digest(view[a : a + SPAN]) for a in starts.tolist()])
    return starts, np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)


def _chunked(batches):
    for pdf in batches:
        cut = [chunks(t) for t in pdf["text"]]
        yield pd.DataFrame({"key": pdf["key"], "place": pdf["place"], "high": [d[:, 0] for _, d in cut], "low": [d[:, 1] for _, d in cut], "starts": [s.astype(np.int32) for s, _ in cut]})


def _spans(marked) -> list[tuple[int, int, bool]]:
    """Maximal spans of repeated chunks (start, end, later); a later span repeats something before it, a first one doesn't.

    Where a later and a first chunk overlap, the later one begins where the first one ends: what stays, stays whole.
    """
    out: list[list] = []
    for s, e, later in sorted(marked):
        if out and s <= out[-1][1]:
            if out[-1][2] == later:
                out[-1][1] = max(out[-1][1], e)
                continue
            if not later:
                out[-1][1] = s
            s = max(s, out[-1][1])
            if e <= s:
                continue
        out.append([s, e, later])
    return [(int(s), int(e), bool(later)) for s, e, later in out if e > s]


SPANS = "array<struct<start:int,end:int,later:boolean>>"


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every text that occur more than once in the table: key, place (the text's hash), spans in bytes.

    Only rows with such a span are returned. A span's `later` is false where it is its first occurrence (smallest key,
    then the first place in the text). Null, empty and short texts have no spans; rows with a null key take no part; rows
    that repeat key and text are copies of each other, none of them later. Other columns aren't read; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    source = docs.where(F.col(key).isNotNull() & (F.octet_length(text) >= SPAN)).select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("place"), F.col(text).alias("text"))
    with scratch(spark), small_batches(spark):
        cut = source.mapInPandas(_chunked, "key long, place long, high array<long>, low array<long>, starts array<int>")
        cut = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "chunks")
        digests = cut.select("key", F.explode(F.arrays_zip("high", "low")).alias("c")).select("key", "c.high", "c.low")
        counted = materialize(digests.groupBy("high", "low").agg(F.count("*").alias("n"), F.min("key").alias("first")).where("n > 1"), "counted")
        total = cut.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]
        rows = cut.select("row", F.explode(F.arrays_zip("high", "low", "starts")).alias("c")).select("row", "c.high", "c.low", F.col("c.starts").alias("start"))
        hits = join_facts(rows, counted, ["high", "low"], total).groupBy("row").agg(F.collect_list(F.struct("start", "high", "low", "first")).alias("c"))
        hits = materialize(hits, "hits")
        discard(counted)
        found = hits.join(cut.select("row", "key", "place"), "row").select("key", "place", "c").mapInPandas(_first_places, f"key long, place long, spans {SPANS}")
        return materialize(found.where(F.size("spans") > 0), "spans", keep=True)


def _first_places(batches):
    """Merge a text's repeated chunks; in the first holder a digest's first place stays and its other places are later."""
    for pdf in batches:
        spans = []
        for key, c in zip(pdf["key"], pdf["c"]):
            met: set[tuple[int, int]] = set()
            marked = []
            for s, high, low, first in sorted((x["start"], x["high"], x["low"], x["first"]) for x in c):
                marked.append((s, s + SPAN, key != first or (high, low) in met))
                met.add((high, low))
            spans.append([{"start": s, "end": e, "later": l} for s, e, l in _spans(marked)])
        yield pd.DataFrame({"key": pdf["key"], "place": pdf["place"], "spans": spans})


def _without(text: str, spans) -> str:
    """The text without its later spans, cut at whole characters."""
    raw, out, at = text.encode(), [], 0
    for s in spans:
        if s["later"]:
            a, b = int(s["start"]), int(s["end"])
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            out.append(raw[at : max(a, at)])
            at = max(b, at)
    return b"".join([*out, raw[at:]]).decode()


def _cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if s is None or t is None else _without(t, s) for t, s in zip(texts, spans)])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and others) with every later occurrence of a repeated span taken out of its text.

    The first occurrence stays. Rows without such a span, with a null doc_id or a null text stay as they are; n_chars, if
    there is such a column, follows a changed text. Texts are searched and cut whole, however long; of repeated rows each is
    cut alike; an empty table stays empty; other columns pass through, whatever they are called.
    """
    place, key, cut = (unused(docs, c) for c in ("place", "key", "spans"))
    spans = repeated_spans(docs).where(F.exists("spans", lambda s: s["later"])).withColumnsRenamed({"key": key, "place": place, "spans": cut})
    named = docs.withColumns({place: F.xxhash64("text"), key: F.col("doc_id").cast("long")})
    changed = named.join(spans, [key, place], "left").withColumn("text", F.pandas_udf(_cut_out, "string")("text", cut))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return changed.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """`op1_substring_dedup`: all repeated spans of all documents, in bytes; `later` spans are what dedup takes out."""
    from .common import table

    spans = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spans.select(F.col("key").alias("doc_id"), F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.later").alias("later"))
