"""Windows over ordered frames: runs, moving statistics, budgets, counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

#: Rows of a group up to which one task may sort it; larger groups are ordered over all tasks.
GROUP_ROWS = 1_000_000


def running_totals(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """Add running sums, this row included, over one order of the whole table, without gathering it in one task.

    Rows are range-partitioned and sorted by the order (which must be total) and summed as they are written, a partition
    each: one shuffle. The totals of the partitions before it, one row a partition, are added when the table is read. The
    number of a row is the running sum of 1; a null adds nothing.
    """
    kinds = {name: "bigint" if isinstance(df.select(value).schema[0].dataType, T.IntegralType) else "double" for name, value in sums.items()}
    values = {f"__v_{name}": F.coalesce(value.cast(kinds[name]), F.lit(0).cast(kinds[name])) for name, value in sums.items()}
    placed = df.withColumns(values).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*placed.schema.fields, *[T.StructField(f"__r_{name}", placed.schema[f"__v_{name}"].dataType) for name in sums]])

    added_to = list(values)  # names only: columns can't go to workers

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        carry = dict.fromkeys(added_to, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            added = []
            for v in added_to:
                total = pc.add(pc.cumulative_sum(batch.column(v)), pa.scalar(carry[v], batch.column(v).type))
                carry[v] = total[-1].as_py()
                added.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *[f"__r_{v[4:]}" for v in added_to]])

    placed = written(placed.mapInArrow(run, schema).withColumn("__p", F.spark_partition_id()))
    totals = placed.groupBy("__p").agg(*[F.sum(v).alias(v) for v in values])
    earlier = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select("__p", *[F.coalesce(F.sum(f"__v_{name}").over(earlier), F.lit(0)).alias(f"__o_{name}") for name in sums])
    out = placed.join(F.broadcast(offsets), "__p")
    return out.select(*df.columns, *[(F.col(f"__o_{name}") + F.col(f"__r_{name}")).alias(name) for name in sums])


def row_numbers(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add the place of each row, from 0, in one order of the whole table, without gathering it in one task.

    As `running_totals` of 1 less one, without sums: rows are numbered within their range partition as they are written, and
    the rows of the partitions before it, one number a partition, are added when the table is read. `df` is read twice, for
    the bounds of the ranges and for the rows, so one that is made with effort should be `written` before.
    """
    within = (1 << 33) - 1  # of a monotonically increasing id the lower bits count the rows of a partition
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    totals = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    earlier = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select("__p", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__o"))
    out = placed.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return out.select(*df.columns, (F.col("__o") + F.col("__id").bitwiseAND(F.lit(within))).alias(name))


def running_in_groups(df: DataFrame, group: list[str], order: list, sums: dict[str, Column], counts: str | None = None) -> DataFrame:
    """Add running sums, this row included, within each group; with `counts` also the group's number of rows.

    Groups of up to GROUP_ROWS rows are windows. Where one is larger, the running sums of the whole table by group and order
    are taken, less where the group starts: its rows then stand in many tasks, and only one row a group is joined back.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("__n"))
    largest = sizes.agg(F.max("__n")).first()[0] or 0
    if largest <= GROUP_ROWS:
        over = W.partitionBy(*group)
        out = df.withColumns({name: F.coalesce(F.sum(v).over(over.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) for name, v in sums.items()})
        return out.withColumn(counts, F.count("*").over(over)) if counts else out
    keyed = df.withColumns({f"__x_{n}": F.coalesce(v, F.lit(0)) for n, v in sums.items()})
    total = running_totals(keyed, [*group, *order], {name: F.col(f"__x_{name}") for name in sums} | {"__i": F.lit(1)})
    starts = total.groupBy(*[F.col(g).alias(f"__g_{g}") for g in group]).agg(F.count("*").alias("__n"), *[F.min_by(F.col(n) - F.col(f"__x_{n}"), "__i").alias(f"__s_{n}") for n in sums])
    same = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group]
    out = total.join(written(starts), same)
    return out.select(*df.columns, *[(F.col(n) - F.col(f"__s_{n}")).alias(n) for n in sums], *([F.col("__n").alias(counts)] if counts else []))


def islands(frames: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Maximal runs of value 1: key, first and last index. The difference of two row numbers is constant within a run."""
    marked = frames.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(index)))
    ones = marked.where(F.col(value) == 1).withColumn("__run", F.col("__rn") - F.row_number().over(W.partitionBy(key).orderBy(index)))
    return ones.groupBy(key, "__run").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("__run")


def moving(value: str, key: str, index: str, width: int, kind: str = "avg") -> Column:
    """Average or maximum of this frame and the width - 1 after it; 0 where fewer remain."""
    over = W.partitionBy(key).orderBy(index).rowsBetween(0, width - 1)
    stat = F.avg(value) if kind == "avg" else F.max(value)
    return F.when(F.count(value).over(over) == width, stat.over(over)).otherwise(F.lit(0.0))


def ema(df: DataFrame, key: str, index: str, value: str, weight: float) -> DataFrame:
    """Exponential moving average at the end of each key's series: acc = w x + (1 - w) acc, from its first value.

    It is a weighted sum: a value `back` places before the end counts w (1 - w)^back, the first one (1 - w)^back. So it is
    aggregated like any sum, over any number of tasks. A null counts nothing.
    """
    ranked = running_in_groups(df.select(key, index, value), [key], [index], {"__i": F.lit(1)}, counts="__m")
    kept = F.pow(F.lit(1 - weight), F.col("__m") - F.col("__i"))
    return ranked.groupBy(key).agg(F.sum(F.col(value).cast("double") * kept * F.when(F.col("__i") == 1, 1.0).otherwise(weight)).alias("ema"))


def take_until(df: DataFrame, key: str | list[str], order: list, size: str, target: int) -> DataFrame:
    """Rows in the order until their sizes reach the target; the row that crosses it is kept."""
    run = running_in_groups(df, [key] if isinstance(key, str) else key, order, {"__run": F.col(size)})
    return run.where(F.col("__run") - F.coalesce(size, F.lit(0)) < target).drop("__run")


def _folded(df: DataFrame, key: str, order: str, size: str, fold, added: str) -> DataFrame:
    """A sequential pass over each key's sizes in order, a row at a time: its memory doesn't grow with a key's rows.

    `fold` makes for each key a function of the next size, giving a value for the row, and one that gives the row at the end.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state, started = None, None, False
        for pdf in batches:
            rows = []
            for k, o, n in zip(pdf[key], pdf[order], pdf[size]):
                if not started or k != name:
                    if started:
                        rows += state.end(name)
                    name, state, started = k, fold(), True
                rows += state.next(k, o, n)
            yield pd.DataFrame(rows, columns=columns)
        if started:
            yield pd.DataFrame(state.end(name), columns=columns)

    schema = added.format(key=f"`{key}` {kinds[key]}", order=f"`{order}` {kinds[order]}")
    columns = [c.split()[0].strip("`") for c in schema.split(", ")]
    placed = df.select(key, order, size).repartition(key).sortWithinPartitions(key, order)
    return placed.mapInPandas(run, schema)


class _Greedy:
    def __init__(self, target: float):
        self.target, self.taken, self.total = target, 0, 0.0

    def next(self, key, order, size) -> list:
        left = self.target - self.total
        if not (left <= 0 or (size > left and left < size / 2 and self.taken > 0)):
            self.taken, self.total = self.taken + 1, self.total + float(size)
        return []

    def end(self, key) -> list:
        return [(key, self.taken, self.total)]


class _Aligned:
    def __init__(self, shard: int):
        self.shard, self.at = shard, 0

    def next(self, key, order, size) -> list:
        room = self.shard - self.at % self.shard
        begin = self.at + room if room < size <= self.shard else self.at
        self.at = begin + int(size)
        return [(key, order, begin)]

    def end(self, key) -> list:
        return []


def greedy_budget(df: DataFrame, key: str, order: str, size: str, target: float) -> DataFrame:
    """A row for each key: how many rows a greedy pass takes and their total.

    A row is skipped where it is larger than what remains, that is under half of it, and something was taken before. The
    pass is sequential by nature: a key is one task's, row by row. Rows without a size are left out.
    """
    return _folded(df.where(F.col(size).isNotNull()), key, order, size, lambda: _Greedy(target), "{key}, taken bigint, total double")


def shard_align(df: DataFrame, key: str, order: str, size: str, shard: int) -> DataFrame:
    """Offsets at which each row starts, moved to the next shard where it would straddle two: (key, order, begin).

    A row larger than a shard isn't moved. Rows without a size are left out; the order is total within a key. Keys of up to
    GROUP_ROWS rows are one task each, row by row; beyond that the rows of a key stand in many tasks (`_aligned_wide`).
    """
    rows = df.where(F.col(size).isNotNull())
    largest = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= GROUP_ROWS:
        return _folded(rows, key, order, size, lambda: _Aligned(shard), "{key}, {order}, begin bigint")
    return _aligned_wide(rows, key, order, size, shard)


def _aligned_wide(rows: DataFrame, key: str, order: str, size: str, shard: int) -> DataFrame:
    """`shard_align` without going through a key's rows one by one.

    If a row starts a shard, running sums say which row of its key is the first that doesn't fit any more and starts the
    next one: a pointer for each row. Pointers are followed from each key's first row by doubling: with those over 1, 2, 4,
    ... steps the known starts reach as many more, so the rounds are the logarithm of the shards of a key. A row then
    begins as far after the last start before it as the sizes between them say.

    A row that is larger than a shard stays where it is, so that search goes on behind it, from the shard's end that
    follows the next smaller row: a round for each such stretch that a shard's end meets.
    """
    named = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(size).cast("long").alias("n"))
    small = (F.col("n") <= shard).cast("int")
    placed = running_totals(named, ["k", "o"], {"end": F.col("n"), "i": F.lit(1), "smalls": small})
    placed = written(placed.withColumn("s", F.col("end") - F.col("n")))
    ends = placed.groupBy("k").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min_by("s", "i").alias("base"))  # a row a key
    ends = written(ends)
    whole = placed.join(ends.select(F.col("k").alias("key"), "last"), F.col("k").eqNullSafe(F.col("key"))).select("i", "s", "last")

    def first_beyond(asks: DataFrame) -> DataFrame:
        """For rows (i, s, last, w): `to`, the first row whose end is past s + w shards."""
        points = placed.select(F.col("end").alias("v"), F.lit(0).alias("ask"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("bigint").alias("s"), F.lit(None).cast("bigint").alias("last"), F.lit(None).cast("bigint").alias("w"))
        points = points.unionByName(asks.select((F.col("s") + F.col("w") * shard).alias("v"), F.lit(1).alias("ask"), "i", "s", "last", "w"))
        found = running_totals(points, ["v", "ask", "i"], {"before": 1 - F.col("ask")}).where("ask = 1")
        return found.select("i", "s", "last", "w", (F.col("before") + 1).alias("to")).where("to <= last")

    heads = placed.select(F.col("i").alias("to"), "n", "smalls")
    next_small = placed.where(small == 1).select(F.col("smalls").alias("next"), F.col("s").alias("from_s"))
    pointers, asks = None, whole.withColumn("w", F.lit(1).cast("long"))
    while True:
        found = written(first_beyond(asks).join(heads, "to"))
        fits = found.where(F.col("n") <= shard).select("i", "to", "w")
        pointers = fits if pointers is None else written(pointers.unionByName(fits))
        stuck = found.where(F.col("n") > shard).withColumn("next", F.col("smalls") + 1).join(next_small, "next")
        asks = stuck.select("i", "s", "last", F.ceil((F.col("from_s") - F.col("s")) / shard).cast("long").alias("w"))
        if asks.isEmpty():
            break
    starts = written(ends.select(F.col("first").alias("i"), F.lit(0).cast("long").alias("begin")))
    jumps, known = written(pointers), 0
    while (count := starts.count()) > known and not jumps.isEmpty():
        known = count
        reached = starts.join(jumps, "i").select(F.col("to").alias("i"), (F.col("begin") + F.col("w") * shard).alias("begin"))
        starts = written(starts.unionByName(reached).groupBy("i").agg(F.min("begin").alias("begin")))
        then = jumps.select(F.col("i").alias("to"), F.col("to").alias("after"), F.col("w").alias("more"))
        jumps = written(jumps.join(then, "to").select("i", F.col("after").alias("to"), (F.col("w") + F.col("more")).alias("w")))
    marked = placed.join(starts, "i", "left")
    counted = written(running_totals(marked, ["i"], {"run": F.col("begin").isNotNull().cast("int")}))
    origin = counted.where("begin is not null").select("run", (F.col("begin") - F.col("s")).alias("shift"))
    return counted.join(origin, "run").select(F.col("k").alias(key), F.col("o").alias(order), (F.col("s") + F.col("shift")).alias("begin"))


def patience(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Best value so far, and how many rows ago it was reached; only a strictly larger value counts as better."""
    over = W.partitionBy(key).orderBy(order)
    past = F.max(value).over(over.rowsBetween(W.unboundedPreceding, -1))
    better = past.isNull() | (F.col(value) > past)
    out = df.withColumns({"best": F.max(value).over(over.rowsBetween(W.unboundedPreceding, 0)), "__rn": F.row_number().over(over), "__better": better})
    last = F.max(F.when(F.col("__better"), F.col("__rn"))).over(over.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("since_best", F.col("__rn") - last).drop("__rn", "__better")


def hop_frames(array: str, width: int, hop: int) -> Column:
    """Slices of `width` values at every `hop`-th place; a partial tail is dropped."""
    last = F.size(array) - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(array, s + 1, width))


def chunk(array: str, width: int, keep_tail: bool = True) -> Column:
    """Consecutive slices; the tail is kept as a short one or dropped; width -1 keeps the whole."""
    if width == -1:
        return F.array(F.col(array))
    n = F.ceil(F.size(array) / width) if keep_tail else F.floor(F.size(array) / width)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(array, (i * width + 1).cast("int"), width))).otherwise(F.array().cast("array<array<float>>"))
