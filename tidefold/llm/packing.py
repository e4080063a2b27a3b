"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words.

Bins are ordered by residual space and carry bitmaps: for each residual the set of bins that have it, for each source and
each duplicate cluster the set of bins that hold a document of it, all as bits over the bins of a shard. A document goes
into the tightest bin that it fits and that holds neither its source nor its cluster: the search starts at the smallest
residual that suffices and goes on to the next larger one until some bin is compatible; otherwise it opens a bin.

Pieces of documents are written once, each with a number of its own, and dealt into shards of about SHARD pieces and
SHARD_BYTES bytes by a hash of that number, so a source, a cluster or a repeated row with a third of all rows is spread
evenly, and a shard's size doesn't grow with the input. A shard is packed and its sequences are put together in the same
task: the texts are shuffled once. Bins don't cross shards.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions_for, small_batches

CAPACITY, SHARD, SHARD_BYTES = 2048, 4096, 32 << 20
SEPARATOR = "\n"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Bins:
    """The open bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []  # those that some bin has, in order
        self.having: dict[int, int] = {}  # residual -> bins
        self.source: dict = {}
        self.cluster: dict = {}
        self.count = 0

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        """Put a piece into the tightest compatible bin, or a new one: (bin, offset)."""
        barred = (self.source.get(source, 0) if source is not None else 0) | (self.cluster.get(cluster, 0) if cluster is not None else 0)
        chosen = residual = -1
        for i in range(bisect_left(self.residuals, size), len(self.residuals)):
            fit = self.having[self.residuals[i]] & ~barred
            if fit:
                residual = self.residuals[i]
                chosen = (fit & -fit).bit_length() - 1
                break
        if chosen < 0:
            chosen, residual = self.count, self.capacity
            self.count += 1
        else:
            self._drop(residual, chosen)
        bit = 1 << chosen
        left = residual - size
        if left not in self.having:
            self.having[left] = 0
            insort(self.residuals, left)
        self.having[left] |= bit
        if source is not None:
            self.source[source] = self.source.get(source, 0) | bit
        if cluster is not None:
            self.cluster[cluster] = self.cluster.get(cluster, 0) | bit
        return chosen, self.capacity - residual

    def _drop(self, residual: int, chosen: int) -> None:
        rest = self.having[residual] & ~(1 << chosen)
        if rest:
            self.having[residual] = rest
        else:
            del self.having[residual]
            self.residuals.pop(bisect_left(self.residuals, residual))


def cut(text: str, capacity: int) -> list[tuple[int, str]]:
    """A text as pieces of `capacity` words and a rest: (words, text); the pieces joined are the text again."""
    raw = text.encode()
    words = len(raw.split())
    if words <= capacity:
        return [(words, text)]
    at = [m.start() for i, m in enumerate(_WORD.finditer(raw)) if i % capacity == 0][1:]
    cuts = [0, *at, len(raw)]
    return [(min(capacity, words - i * capacity), raw[a:b].decode()) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _pieces(capacity: int):
    def run(batches):
        for pdf in batches:
            made = [cut(t, capacity) for t in pdf["text"]]
            out = pdf.drop(columns="text").loc[np.repeat(pdf.index, [len(m) for m in made])]
            yield out.assign(piece=[i for m in made for i in range(len(m))], size=[n for m in made for n, _ in m], text=[t for m in made for _, t in m])

    return run


BINS = "shard long, bin long, doc_ids array<long>, pieces array<long>, words array<long>, starts array<long>, lengths array<long>, text string"


def _packed(capacity: int, separator: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "cluster", "piece", "row"], ascending=[False, True, True, True, True], kind="stable", na_position="last")
        bins, held = Bins(capacity), []
        for row in pdf.itertuples(index=False):
            at, _ = bins.place(int(row.size), row.source, row.cluster)
            if at == len(held):
                held.append([])
            held[at].append((None if row.nameless else int(row.key), int(row.piece), int(row.size), len(row.text), row.text))
        rows = []
        for number, members in enumerate(held):
            ids, pieces, words, lengths, texts = zip(*members)
            starts = np.concatenate(([0], np.cumsum([n + len(separator) for n in lengths[:-1]]))).astype(np.int64)
            rows.append((int(pdf["shard"].iloc[0]), number, list(ids), list(pieces), list(words), starts.tolist(), list(lengths), separator.join(texts)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BINS.split(", ")])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, separator: str = SEPARATOR) -> DataFrame:
    """A row for each sequence: shard, bin, its `text`, and for each document or piece in it, in order: doc_ids, pieces (its
    number in its document), words, and where it stands in the text: starts and lengths in code points. Between two stands
    the separator. A bin has `capacity` words at most, and of each source and each cluster one document.

    Words are runs of other than ASCII white space. A document longer than `capacity` is cut before words into full pieces,
    each a sequence of its own (shard -1), and a rest; a document's pieces joined are its whole text, however long. `cluster`
    names a column of duplicate clusters (null: none); by default documents of equal text are one. A null or empty text is a
    piece of no words. A null source conflicts with nothing; rows with a null key are packed and keep it; repeated rows are
    packed each, never into one bin. Ties go by key, text and piece. Other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    group = F.when(F.col(cluster).isNotNull(), F.xxhash64(cluster)) if cluster else F.xxhash64(body)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("key"), F.col(key).isNull().alias("nameless"), F.col(source).cast("string").alias("source"), group.cast("string").alias("cluster"), body.alias("text"))
    with small_batches(spark):
        pieces = rows.mapInPandas(_pieces(capacity), "key long, nameless boolean, source string, cluster string, piece long, size long, text string")
        pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")  # the result reads it
    part = pieces.where(F.col("size") < capacity)
    facts = part.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(partitions_for(facts[0], SHARD), partitions_for(facts[1], SHARD_BYTES))
    dealt = part.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).repartition(shards, "shard")
    packed = dealt.groupBy("shard").applyInPandas(_packed(capacity, separator), BINS)
    one = lambda c: F.array(c)
    length = F.length("text").cast("long")
    alone = pieces.where(F.col("size") == capacity).select(F.lit(-1).cast("long").alias("shard"), F.col("row").alias("bin"), one(F.when(~F.col("nameless"), F.col("key"))).alias("doc_ids"), one("piece").alias("pieces"), one("size").alias("words"), one(F.lit(0).cast("long")).alias("starts"), one(length).alias("lengths"), "text")
    return packed.unionByName(alone)


def query(spark, sf_dir: str) -> DataFrame:
    """`op5_best_fit_packing`: all documents into sequences of CAPACITY words, of each source and text one in a sequence."""
    from .common import table

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
