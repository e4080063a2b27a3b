"""Document fingerprints by order MinHash, in DataFrame functions only.

A text is a sequence of words: runs of other than white space, cut after PIECE characters, and single characters of scripts
that set no spaces. A k-mer is `k` words in a row, or the whole text if it has fewer; its occurrences are numbered, so that
an element of the text is a k-mer and its number. A hash puts all elements on a circle. Each component of the fingerprint
starts at one of `components` even places on the circle, takes the `picks` elements that follow, puts them back into their
order in the text and hashes the tuple. An order that starts elsewhere on the circle is as random as any other, so each
component is an order MinHash of its own, and one pass over the elements serves them all.

Two fingerprints agree in a component if the same elements were least in both texts and stand in the same order. The share
of components that agree is the `likeness`: it falls with words that are replaced, as MinHash does, and also with passages
that change places and with repeats that are added or taken away, which sets of k-mers don't see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

KMER, PICKS, COMPONENTS, PIECE = 2, 2, 64, 32
#: Ranges of ids for each shuffle partition, so that ranges hashed to partitions come out even, and ranges at most.
RANGES, MOST_RANGES = 8, 65_536

#: Blocks of scripts written without spaces (Thai to Myanmar, Khmer, kana and ideographs).
UNSPACED = r"\u0E00-\u109F\u1780-\u17FF\u3040-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"

#: An element and its place in one long: 32 bits of hash, 31 of place.
PLACE = 31


def _with(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _packed(digest: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(digest, 64 - 32), PLACE) + place


def _digest(packed: Column) -> Column:
    return F.shiftright(packed, PLACE)


def _words(text: Column) -> Column:
    """The words of a text that begins and ends with one. Most texts are cut at white space alone; a pattern goes over the others."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[{UNSPACED}]|[^\s{UNSPACED}]{{1,{PIECE}}}"), F.lit(0))
    plain = lambda words: F.when(F.exists(words, lambda w: F.length(w) > PIECE), pieces).otherwise(words)
    return F.when(text.rlike(f"[{UNSPACED}]"), pieces).otherwise(_with(F.split(text, r"\s+"), plain))


def _elements(words: Column, k: int) -> Column:
    """The occurrence-numbered k-mers of a text of one word or more, packed with their places, ascending."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    kmers = F.transform(F.sequence(F.lit(0), last), lambda i: _packed(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), i))

    def numbered(kmers: Column) -> Column:
        """In sorted order the occurrences of a k-mer stand together. The first keeps the k-mer's hash, later ones get one with their number."""
        at = lambda i: _digest(F.get(kmers, i))
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(PLACE))])

        def later(x: Column, i: Column) -> Column:
            first = F.aggregate(steps, i, lambda lo, step: F.when((lo >= step) & (at(lo - step) == _digest(x)), lo - step).otherwise(lo))
            number = F.when((i == 1) | (at(i - 2) != _digest(x)), 1).otherwise(i - first)
            return _packed(F.xxhash64(_digest(x), number), x.bitwiseAND(F.lit((1 << PLACE) - 1)))

        return F.transform(kmers, lambda x, i: F.when(F.get(kmers, i - 1).bitwiseXOR(x) < (1 << PLACE), later(x, i)).otherwise(x))

    return F.sort_array(_with(F.sort_array(kmers), numbered))


def _tuples(elements: Column, picks: int, components: int) -> Column:
    """The hash of each component's tuple. `components` is a power of two: the first bits of an element say where it stands."""
    bits = components.bit_length() - 1
    place = lambda packed: F.shiftright(packed, PLACE + 32 - bits).cast("int")

    def firsts(starts: Column) -> Column:
        """For each component the index of the first element at or after its place; past the last one it is the first of all."""
        part = lambda k: place(F.get(elements, F.get(starts, k)))
        upto = F.transform(starts, lambda s, k: F.array_repeat(s, part(k) - F.when(k == 0, -1).otherwise(part(k - 1))))
        return F.concat(F.flatten(upto), F.array_repeat(F.lit(0), F.lit(components - 1) - part(F.size(starts) - 1)))

    def one(first: Column) -> Column:
        n = F.size(elements)
        picked = F.transform(F.sequence(first, first + F.least(F.lit(picks), n) - 1), lambda i: F.get(elements, i % n))
        ordered = F.sort_array(F.transform(picked, lambda e: F.struct(e.bitwiseAND(F.lit((1 << PLACE) - 1)).alias("at"), _digest(e).alias("of"))))
        return F.shiftrightunsigned(F.xxhash64(F.transform(ordered, lambda e: e["of"])), 32)

    differ = lambda i: F.get(elements, i).bitwiseXOR(F.get(elements, i - 1)) >= (1 << (PLACE + 32 - bits))
    changes = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(0), F.size(elements) - 1), differ))  # there's nothing before the first
    return F.transform(_with(changes, firsts), one)


def order_minhash(text: Column, k: int = KMER, picks: int = PICKS, components: int = COMPONENTS) -> Column:
    """The fingerprint of a text: an array of `components` numbers of 32 bits.

    Equal texts have equal fingerprints, and so have texts that differ in white space alone. Null, empty and blank texts have
    that of no elements, which agrees with no other. Whole texts are read, however long, by the task that holds them.
    """
    nothing = F.array_repeat(F.lit(0).cast("bigint"), components)
    of = lambda t: _with(_words(t), lambda w: _with(_elements(w, k), lambda e: _tuples(e, picks, components)))
    return _with(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r")), lambda t: F.when(t == "", nothing).otherwise(of(t)))


def likeness(one: Column, other: Column) -> Column:
    """The share of components in which two fingerprints agree."""
    return F.aggregate(F.zip_with(one, other, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(one)


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits for each component."""
    return F.concat_ws("", F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def _constants(values: list, kind: str) -> Column:
    """A constant array, as one literal for the optimizer, however many values it has."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _ranged(docs: DataFrame, key: str, at: str, halo: str) -> DataFrame:
    """Rows with the range of ids in which they stand, `at`; the row that opens a range also ends the one before it, as a `halo`.

    Rows with a null key stand in ranges of their own.
    """
    ranges = min(MOST_RANGES, RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = _constants([i / ranges for i in range(ranges)], "double")
    cuts, least = docs.agg(F.percentile_approx(key, shares, 100 * ranges), F.min(key)).first()
    begins = [] if least is None else sorted({least, *cuts})
    opened = _constants(begins, "bigint")
    steps = [F.lit(1 << b) for b in reversed(range(len(begins).bit_length()))]
    climb = lambda i, step: F.when(F.get(opened, i + step) <= F.col(key), i + step).otherwise(i)
    mine = F.aggregate(F.array(F.lit(0), *steps), F.lit(0), climb)
    place = lambda where, is_halo: F.struct(where.cast("int").alias("at"), F.lit(is_halo).alias("halo"))
    nowhere = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(ranges))
    places = F.when(F.col(key).isNull(), F.array(place(nowhere, 0)))
    places = places.when(F.get(opened, mine) == F.col(key), F.array(place(mine, 0), place(F.pmod(mine - 1, F.lit(max(1, len(begins)))), 1)))
    return docs.select(*docs.columns, F.inline(places.otherwise(F.array(place(mine, 0))))).withColumnsRenamed({"at": at, "halo": halo})


def edited(text: Column, following: Column) -> Column:
    """`text` with its last half, rounded down, replaced by as many characters of the following text, or all that it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is that with the next larger key; after the last comes the first. The ids are cut into ranges of about as
    many rows; texts are shuffled once, by range, and the row that opens a range is also sent to the range before it.

    Null texts count as empty. Rows of a repeated key follow each other in order of their texts, in one range. A row with a
    null key has no place in the order: its next text is empty. A single row is its own next one. Very long texts are read
    whole by one task. An empty table gives no rows; other columns aren't read, so that their names can't clash.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    over = W.partitionBy("at").orderBy("halo", "key", "text")
    of_next = lambda c: F.lead(c).over(over)
    placed = _ranged(docs, "key", "at", "halo").withColumn("following", of_next("text"))
    placed = placed.withColumn("edited", edited(F.col("text"), F.when(F.col("key").isNull(), "").otherwise(F.coalesce("following", F.lit("")))))
    prints = placed.select("at", "halo", "key", "text", F.sha2("edited", 256).alias("edited_sha256"), order_minhash(F.col("text")).alias("own"), order_minhash(F.col("edited")).alias("of_edited"))
    out = prints.withColumn("of_next", of_next("own")).where("halo = 0")
    nothing = order_minhash(F.lit(None).cast("string"))
    of_next_row = F.when(F.col("key").isNull(), nothing).otherwise(F.coalesce("of_next", nothing))
    return out.select(
        F.col("key").alias(key),
        F.length("text").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("of_edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("of_edited")).alias("near_edited"),
        likeness(F.col("own"), of_next_row).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op11_order_minhash`: every document, its edited text and its next document."""
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
