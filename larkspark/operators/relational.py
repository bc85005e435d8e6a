"""Joins, sorting, set operations and movement of data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast by hand only if its plan's size estimate is at most this.
BROADCAST_BYTES = 64 << 20

#: About how many pairs a task of join_many makes.
TASK_PAIRS = 1 << 22

#: About how many rows of nearly distinct keys a task groups at once.
TASK_ROWS = 1 << 19

_HINTS = {"shuffle_hash": "shuffle_hash", "merge": "merge", "auto": None, "broadcast": None}


def size_estimate(df: DataFrame) -> int:
    """The optimizer's estimate of df's size in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join(probe: DataFrame, build: DataFrame, on, how: str = "inner", strategy: str = "auto") -> DataFrame:
    """An equi join with an optional residual in on. strategy broadcast holds only for a build side of a checked size; otherwise the optimizer chooses."""
    if strategy not in _HINTS:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "broadcast" and size_estimate(build) <= BROADCAST_BYTES:
        build = F.broadcast(build)
    elif _HINTS[strategy]:
        build = build.hint(_HINTS[strategy])
    return probe.join(build, on, how)


def join_many(probe: DataFrame, build: DataFrame, probe_key: list[str], build_key: list[str], task_pairs: int = TASK_PAIRS) -> DataFrame:
    """An inner equi join of sides that both repeat their keys, so that its rows grow with the product of the sides.

    Tasks are planned by the bytes they read, which would leave the pairs to a few of them, so an action counts each
    key's pairs first, and both sides are dealt to as many tasks as the pairs need. A key with more than a quarter of
    a task's pairs is cut into parts: a probe row, copies too, goes to one of them, a build row to all. The merge join
    spills, so no side has to fit a task. The probe should be the larger side.
    """
    if [t for _, t in probe.select(*probe_key).dtypes] != [t for _, t in build.select(*build_key).dtypes]:
        raise ValueError("the keys' types differ, so rows wouldn't be dealt alike")
    names = [f"__key{i}" for i in range(len(probe_key))]
    probe, build = (df.filter(" and ".join(f"`{k}` is not null" for k in keys)) for df, keys in ((probe, probe_key), (build, build_key)))
    counts = [df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count("*").alias(c)) for df, keys, c in ((probe, probe_key, "__probe"), (build, build_key, "__build"))]
    pairs = F.col("__probe").cast("double") * F.col("__build")
    parts = F.least(F.ceil(pairs * 4 / task_pairs), "__probe").cast("int")
    keys = counts[0].join(counts[1], names).select(*names, pairs.alias("__pairs"), parts.alias("__parts"))
    # Keys that are cut have a quarter of a task's pairs at least, so there are at most four a task of them.
    found = keys.agg(F.sum("__pairs").alias("pairs"), F.collect_list(F.when(F.col("__parts") > 1, F.struct(*names, "__parts"))).alias("cut")).first()
    tasks = max(1, math.ceil((found["pairs"] or 0) / task_pairs))
    if tasks > 1 and found["cut"]:
        cut = F.broadcast(probe.sparkSession.createDataFrame([tuple(r) for r in found["cut"]], keys.drop("__pairs").schema))
        # Which task a row is dealt to follows from the rows alone, their order within it doesn't, so the task is what tells a key's parts apart.
        spread = min(tasks, 8 * max(r["__parts"] for r in found["cut"]))
        probe, build = probe.repartition(spread).withColumn("__task", F.spark_partition_id()), build.repartition(spread)
        probe, build = (df.join(cut, [df[k] == cut[n] for k, n in zip(keys, names, strict=True)], "left").drop(*names) for df, keys in ((probe, probe_key), (build, build_key)))
        parts = F.least(F.coalesce("__parts", F.lit(1)), F.lit(spread))
        probe = probe.withColumn("__part", F.pmod("__task", parts)).drop("__task", "__parts")
        build = build.withColumn("__to", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
        probe_key, build_key = [*probe_key, "__part"], [*build_key, "__to"]
    probe, build = probe.repartition(tasks, *probe_key), build.repartition(tasks, *build_key)
    return join(probe, build, [probe[p] == build[b] for p, b in zip(probe_key, build_key, strict=True)], strategy="merge").drop("__part", "__to")


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """The number of tasks that df's rows, which are counted, are to be dealt to before they are grouped by nearly distinct keys.

    Left to itself the optimizer measures exchanges in packed bytes, and a task's hash tables take many times these.
    """
    return max(1, math.ceil(df.count() / rows))


def row_count_hint(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast in its joins if so many rows of its columns' default sizes are few enough, else to be shuffled.

    Only the plan hangs on the hint: a wrong one costs time, never rows. Hints of selectivity have no counterpart:
    the optimizer re-plans by what exchanges have measured.
    """
    width = sum(int(f.dataType().defaultSize()) for f in df._jdf.schema().fields())
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES and size_estimate(df) <= 64 * BROADCAST_BYTES else df.hint("shuffle_hash")


def bloom_build(build: DataFrame, key: str, bits: int = 1 << 20, hashes: int = 3) -> DataFrame:
    """A Bloom filter of a side's keys as a table: the words of a bit array that aren't zero. Filters of parts merge by bit-or."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(hashes)]))
    return build.filter(F.col(key).isNotNull()).select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))


def bloom_merge(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of several filters (a repack of what parts have built)."""
    return union_all(*filters).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def bloom_probe(probe: DataFrame, bloom: DataFrame, key: str, bits: int = 1 << 20, hashes: int = 3) -> DataFrame:
    """The probe rows whose key may be in the filter: all that are, and a few others. The filter has a fixed size, so it is broadcast."""
    words = F.broadcast(bloom.agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("__bloom")))
    tests = []
    for i in range(hashes):
        at = F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits))
        mask = F.coalesce(F.try_element_at(F.col("__bloom"), F.shiftright(at, 6)), F.lit(0).cast("long"))
        tests.append(F.shiftrightunsigned(mask, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0)
    hit = tests[0]
    for t in tests[1:]:
        hit &= t
    return probe.filter(F.col(key).isNotNull()).join(words).filter(hit).drop("__bloom")


def bloom_semi(probe: DataFrame, build: DataFrame, key: str) -> DataFrame:
    """The probe rows whose key the build side has: what a Bloom filter approximates, exactly. The optimizer adds a runtime Bloom filter to large scans by itself."""
    return probe.join(build.select(key), key, "left_semi")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of the same keys at or before its time; one window over both sides."""
    from pyspark.sql import Window

    fields = F.struct(*values)
    kinds = right.select(fields.alias("v")).schema["v"].dataType
    both = left.withColumn("__v", F.lit(None).cast(kinds)).withColumn("__left", F.lit(1)).unionByName(right.select(*by, time, fields.alias("__v"), F.lit(0).alias("__left")), allowMissingColumns=True)
    last = F.last("__v", ignorenulls=True).over(Window.partitionBy(*by).orderBy(time, "__left").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("__last", last).filter("__left = 1").select(*left.columns, *[F.col("__last")[v].alias(v) for v in values])


def sort(df: DataFrame, *keys: tuple[str, str], nulls: str = "last") -> DataFrame:
    """Keys with asc, desc or none (a field that is only kept); nulls last either way, or first if asked for. All columns stay."""
    if nulls not in ("first", "last"):
        raise ValueError(f"nulls come first or last, not {nulls}")
    order: list[Column] = []
    for name, direction in keys:
        if direction not in ("asc", "desc", "none"):
            raise ValueError(f"unknown direction {direction}")
        if direction != "none":
            order.append(getattr(F.col(name), f"{direction}_nulls_{nulls}")())
    return df.orderBy(*order) if order else df


def top_k(df: DataFrame, k: int, *keys: tuple[str, str]) -> DataFrame:
    """The first k rows of sort: each task keeps k rows before they meet."""
    return sort(df, *keys).limit(k)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.unionByName(o)
    return first


def split(df: DataFrame, n: int, policy: str = "hash", key: str | Column | None = None) -> list[DataFrame]:
    """n parts that make up df. Each part reads df again, so cut an expensive df first.

    hash deals rows by the hash of a key, or else of the whole row; random evenly, by the hash of a row's columns
    with a seed of its own, so equal rows stay together; local by the partition that a row is in, without looking
    at it, for a df whose partitions are the same each time it is read. All are deterministic: parts of a
    recomputed source still make up the whole.
    """
    if policy not in ("hash", "random", "local"):
        raise ValueError(f"unknown policy {policy}")
    if policy == "local":
        part = F.spark_partition_id() % n
    elif policy == "random":
        part = F.pmod(F.xxhash64(F.lit("random"), *df.columns), F.lit(n))
    else:
        part = F.pmod(F.xxhash64(*([key] if key is not None else df.columns)), F.lit(n))
    return [df.filter(part == i) for i in range(n)]


def exchange(df: DataFrame, n: int, policy: str = "random", key: str | None = None) -> DataFrame:
    """Deals rows to n partitions: hash by key, random evenly, local without a shuffle (fewer partitions only)."""
    if policy == "hash":
        return df.repartition(n, key)
    return df.repartition(n) if policy == "random" else df.coalesce(n)


def dictionary_scan(df: DataFrame, column: str, regex: str) -> DataFrame:
    """The distinct values of a column that match the whole regex."""
    return df.select(column).distinct().filter(F.col(column).rlike(f"^(?:{regex})$"))
