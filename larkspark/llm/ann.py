"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives a vector a hash string of BITS bits (sides of random hyperplanes, orthogonal to each other as far
as the dimension allows) and is the sorted array of these strings. A query descends in every tree to the longest
prefix that anything shares with it, and ascends in all trees at once, a bit at a time, until the ranges of strings
that share its prefix hold as many candidates as were asked for. The ranges are contiguous in the sorted arrays, so
their vectors are scored by one matrix product for all queries that end at the same prefix.

The arrays are kept in parts that begin with the same few bits (base): a tree's part holds all strings of a prefix,
so a query needs one part of each tree, and parts with many vectors or queries are split into blocks on both sides.
The base is one bit less than what the sample's queries end at; a query that has to ascend beyond it is asked
again with base 0, the whole arrays.

How many candidates are asked for is fitted: for SAMPLE queries the exact neighbours are found in a pass over all
vectors, and the least number is taken with which the forest finds TARGET of them. So clustered vectors are
searched with a number that doesn't depend on the table's size, and vectors without any structure, for which no
index gives more, with a share of it. fit_forest returns the measured recall and cost.

For inner products vectors get one more component that makes them equally long, and queries a zero, so the
largest inner product is the smallest angle. Equal vectors are one entry with the smallest ids it needs, so a
vector that a third of the rows hold costs as much as any other.

Defined results: vectors that are null, zero, of another length than most, or that hold a null or non-finite
component take no part, neither as queries nor as candidates; neither do rows with a null id. Rows with the
same id and vector are one; an id with several vectors is found by each of them and listed once, with its best
score. Equal scores, of equal or of different vectors, are ordered by the smaller id. An empty table gives an empty
result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, runs

TREES = 48
BITS = 32
#: Queries whose exact neighbours are found to fit the forest, at most, and the share of these to be found.
SAMPLE, TARGET = 128, 0.94
#: Vectors and queries in a block, at most on average.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Rows of the table of parts that are broadcast, by count; beyond that it is joined by a shuffle.
BROADCAST_PARTS = 200_000
ROWS_AT_ONCE = 4096


@lru_cache(maxsize=2)
def _planes(dim: int) -> np.ndarray:
    """A column for each bit of each tree; a tree's first columns are orthogonal."""
    rng, wide = np.random.default_rng(71), dim + 1
    turns = [[np.linalg.qr(rng.standard_normal((wide, wide)))[0] for _ in range(-(-BITS // wide))] for _ in range(TREES)]
    return np.hstack([np.hstack(t)[:, :BITS] for t in turns])


def hash_strings(v: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """A row of TREES strings (32-bit numbers) for each vector."""
    return np.packbits((v @ planes > 0).reshape(len(v), TREES, BITS), axis=2).view(">u4")[:, :, 0].astype("<u4")


def prefix_ranges(strings: np.ndarray, asked: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The range of a sorted array that shares the first level bits with each string asked for."""
    low = (asked.astype(np.int64) >> (BITS - level)) << (BITS - level)
    return np.searchsorted(strings, low), np.searchsorted(strings, low + (1 << (BITS - level)))


class Forest(NamedTuple):
    """What fit_forest found: candidates to ask for (summed over the trees), the part's bits, and on the sample the recall and the dot products per query as a share of the vectors."""

    candidates: float
    base: int
    recall: float
    cost: float


class _Queries(NamedTuple):
    number: np.ndarray
    data: np.ndarray
    keys: np.ndarray


def _sums(tables: list[pa.Array], like: int, kind: str) -> np.ndarray:
    raw = b"".join(tables)
    return np.frombuffer(raw, kind).reshape(-1, like)


def fit_forest(table: DataFrame, wanted: DataFrame, dim: int, kind: str, k: int, sample: int = SAMPLE, target: float = TARGET) -> Forest | None:
    """Fits the number of candidates; table: number, data, keys; wanted: number, data, keys. None without queries.

    One pass: each task counts, in sorted arrays, how many strings share each prefix of the sample's queries,
    and keeps their nearest vectors. What goes to the driver is bounded by the sample.
    """
    some = wanted.orderBy(F.xxhash64("number"), "number").limit(sample).collect()
    if not some:
        return None
    q = _Queries(np.array([r["number"] for r in some], np.int64), _sums([r["data"] for r in some], dim, kind).astype(float), _sums([r["keys"] for r in some], TREES, "<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(q.number), BITS + 1), np.int64)
        score, reach, seen = (np.empty((len(q.number), 0)) for _ in range(3))
        for whole in batches:
            for at in range(0, whole.num_rows, 2 * ROWS_AT_ONCE):
                b = whole.slice(at, 2 * ROWS_AT_ONCE)
                number, x, keys = b["number"].to_numpy(), _sums(b["data"].to_pylist(), dim, kind).astype(float), _sums(b["keys"].to_pylist(), TREES, "<u4")
                for t in range(TREES):
                    own = np.sort(keys[:, t]).astype(np.int64)
                    for level in range(BITS + 1):
                        low, high = prefix_ranges(own, q.keys[:, t], level)
                        held[:, level] += high - low
                s = q.data @ x.T
                s[q.number[:, None] == number[None, :]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                apart = (q.keys[:, None, :] ^ keys[best]).min(axis=2)
                shared = BITS - np.ceil(np.log2(apart + 1.0))
                score, reach = np.hstack([score, np.take_along_axis(s, best, 1)]), np.hstack([reach, shared])
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, reach = np.take_along_axis(score, top, 1), np.take_along_axis(reach, top, 1)
        n, wide = score.shape
        of, real = np.repeat(np.arange(n), wide), np.isfinite(score).ravel()
        rows = [(np.repeat(np.arange(n), BITS + 1), np.tile(np.arange(BITS + 1), n), held.ravel(), np.zeros(n * (BITS + 1)))]
        rows.append((of[real], np.full(real.sum(), -1), reach.ravel()[real].astype(np.int64), score.ravel()[real]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["query", "level", "n", "score"])

    found = cut(table.select("number", "data", "keys").mapInArrow(run, "query long, level long, n long, score double"), "fit")
    counts = np.zeros((len(some), BITS + 1))
    for r in found.filter("level >= 0").groupBy("query", "level").agg(F.sum("n").alias("n")).collect():
        counts[r["query"], r["level"]] = r["n"]
    top = Window.partitionBy("query").orderBy(F.desc("score"))
    near = found.filter("level < 0").withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k).select("query", "n").collect()
    drop(found)
    of, reach = np.array([r["query"] for r in near], int), np.array([r["n"] for r in near])
    rows = counts[0, 0] / TREES
    for half in range(200):
        ask = min(TREES * (k + 1) * 2 ** (half / 4), TREES * rows)
        level = np.maximum((counts >= ask).sum(axis=1) - 1, 0)
        recall = float((reach >= level[of]).mean()) if len(of) else 1.0
        if recall >= target or ask >= TREES * rows:
            break
    cost = float(counts[np.arange(len(some)), level].mean() / max(rows, 1))
    return Forest(float(ask), max(0, int(level.min()) - 1), recall, cost)


_PART = "bucket long, part long, size long, keys binary, number binary, first binary, data binary, level binary"


def _parts(df: DataFrame, base: int, what: str) -> DataFrame:
    """Each tree's strings in parts that share their first base bits; a task's vectors of a part are one row.

    what: count (their number alone), keys (the strings alone) or all. Queries bring a column level.
    """
    columns = ["number", "keys", *(["first", "data"] if what == "all" else []), *(c for c in ("level",) if c in df.columns)]
    kinds = {"number": "<i8", "first": "<i8", "level": "<i8"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                keys = _sums(b["keys"].to_pylist(), TREES, "<u4")
                values = {c: b[c].to_numpy().astype(kinds[c]) for c in columns if c in kinds}
                if "data" in columns:
                    values["data"] = np.frombuffer(b"".join(b["data"].to_pylist()), np.uint8).reshape(len(keys), -1)
                out: dict[str, list] = {c.split()[0]: [] for c in _PART.split(", ")}
                for t in range(TREES):
                    order = np.argsort(keys[:, t], kind="stable")
                    own = keys[order, t]
                    prefix = own.astype(np.int64) >> (BITS - base)
                    edges = [0, *(np.flatnonzero(np.diff(prefix)) + 1).tolist(), len(own)]
                    for i, j in zip(edges, edges[1:], strict=False):
                        out["bucket"].append(t << BITS | int(prefix[i]))
                        out["size"].append(j - i)
                        out["part"].append(zlib.crc32(values["number"][order[i:j]].tobytes()))
                        out["keys"].append(own[i:j].tobytes() if what != "count" else b"")
                        for c in ("number", "first", "data", "level"):
                            out[c].append(values[c][order[i:j]].tobytes() if c in values and what != "count" else b"")
                yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64() if c in ("bucket", "part", "size") else pa.binary()) for c in out], list(out))

    return df.select(*columns).mapInArrow(run, _PART)


def _blocks(table: DataFrame, queries: DataFrame, base: int, what: str, deal: DataFrame) -> DataFrame:
    """Parts of vectors (role 0) beside the parts of queries (role 1) that need them, in blocks of bounded size."""
    many = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    mine = _parts(table, base, what).join(deal, "bucket").withColumn("v", F.pmod("part", "vs")).withColumn("q", many("qs")).withColumn("role", F.lit(0))
    asked = _parts(queries, base, what).join(deal, "bucket").withColumn("q", F.pmod("part", "qs")).withColumn("v", many("vs")).withColumn("role", F.lit(1))
    columns = ["bucket", "v", "q", "role", *[c.split()[0] for c in _PART.split(", ")][3:]]
    return mine.select(*columns).unionByName(asked.select(*columns)).repartition("bucket", "v", "q").sortWithinPartitions("bucket", "v", "q")


def _side(t: pa.Table, role: int, *columns: tuple[str, str]) -> list[np.ndarray]:
    own = t.filter(pa.compute.equal(t["role"], role))
    return [np.frombuffer(b"".join(own[c].to_pylist()), kind) for c, kind in columns]


def _levels(table: DataFrame, queries: DataFrame, base: int, candidates: float, deal: DataFrame) -> DataFrame:
    """number, level: where each query's ascent ends; null if that is beyond base."""
    names = [f"c{x}" for x in range(base, BITS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            (own,) = _side(t, 0, ("keys", "<u4"))
            keys, number = _side(t, 1, ("keys", "<u4"), ("number", "<i8"))
            if len(own) and len(keys):
                own = np.sort(own).astype(np.int64)
                held = [np.subtract(*prefix_ranges(own, keys, x)[::-1]) for x in range(base, BITS + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (number, *held)], ["number", *names])

    counts = _blocks(table, queries, base, "keys", deal).mapInArrow(run, "number long, " + ", ".join(f"{c} long" for c in names))
    sums = counts.groupBy("number").agg(*[F.sum(c).alias(c) for c in names])
    level = F.coalesce(*[F.when(F.col(c) >= candidates, F.lit(base + i).cast("long")) for i, c in reversed([*enumerate(names)])])
    return sums.select("number", level.alias("level"))


def _best(x: np.ndarray, y: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the k vectors of largest inner product, and these; ties to the smaller id."""
    for at in range(0, len(y), 256):
        s = y[at : at + 256] @ x.T
        # A matrix product may round equal scores differently, so those close to the last place are worked out again.
        least = np.partition(s, -k, axis=1)[:, -k] - 1e-9 * (1 + np.abs(s).max(axis=1)) if s.shape[1] > k else np.full(len(s), -np.inf)
        for i in range(len(s)):
            of = np.flatnonzero(s[i] >= least[i])
            exact = (x[of] * y[at + i]).sum(axis=1)
            order = np.lexsort((first[of], -exact))[:k]
            yield of[order], exact[order]


def _scored(table: DataFrame, queries: DataFrame, base: int, dim: int, kind: str, k: int, deal: DataFrame) -> DataFrame:
    """query, entry, first, score: of each tree's range of each query the k best entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            keys, number, first, data = _side(t, 0, ("keys", "<u4"), ("number", "<i8"), ("first", "<i8"), ("data", kind))
            asked, query, level, wish = _side(t, 1, ("keys", "<u4"), ("number", "<i8"), ("level", "<i8"), ("data", kind))
            if not len(keys) or not len(asked):
                continue
            order = np.argsort(keys, kind="stable")
            keys, number, first, x = keys[order].astype(np.int64), number[order], first[order], data.reshape(-1, dim)[order].astype(float)
            y = wish.reshape(-1, dim).astype(float)
            low, high = prefix_ranges(keys, asked, level)
            out: list[tuple] = []
            together = np.lexsort((high, low))
            edges = [0, *(np.flatnonzero((np.diff(low[together]) != 0) | (np.diff(high[together]) != 0)) + 1).tolist(), len(together)]
            for i, j in zip(edges, edges[1:], strict=False):
                of, (a, b) = together[i:j], (low[together[i]], high[together[i]])
                if a < b:
                    for who, (found, score) in zip(of, _best(x[a:b], y[of], first[a:b], k), strict=True):
                        out.append((np.full(len(found), query[who]), number[a:b][found], first[a:b][found], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query", "entry", "first", "score"])

    return _blocks(table, queries, base, "all", deal).mapInArrow(run, "query long, entry long, first long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Returns query_id, rank, vec_id, score: the k largest inner products found for each query among all rows but its own."""
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sound = F.expr("id is not null and vec is not null and exists(vec, x -> x <> 0) and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    src = src.filter(F.coalesce(sound, F.lit(False)))
    shape = src.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(F.expr("aggregate(vec, 0d, (s, x) -> s + x * x)")).alias("most")).orderBy(F.desc("n"), "dim").first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape is None:
        return empty
    dim, longest = shape["dim"], float(np.sqrt(shape["most"]))
    src = src.filter(F.size("vec") == dim)

    # Equal vectors: the k + 1 smallest ids are all that any answer can hold. The limit on a rank is applied before the shuffle, too.
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    entries = src.select("vec", "id").distinct().withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = _planes(dim)
        for whole in batches:
            for at in range(0, len(whole), ROWS_AT_ONCE):
                b = whole.iloc[at : at + ROWS_AT_ONCE]
                x = np.stack([np.asarray(v, float) for v in b["vec"]])
                unit = x / longest
                rest = np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1)))[:, None]
                own = x / np.sqrt((x**2).sum(axis=1))[:, None]
                strings, asks = hash_strings(np.hstack([unit, rest]), planes), hash_strings(np.hstack([own, np.zeros((len(x), 1))]), planes)
                yield pd.DataFrame({"ids": b["ids"], "vec": b["vec"], "data": [r.tobytes() for r in x.astype(kind)], "keys": [r.tobytes() for r in strings], "asks": [r.tobytes() for r in asks]})

    table = entries.mapInPandas(hashed, "ids array<long>, vec array<double>, data binary, keys binary, asks binary")
    table = cut(table.withColumn("number", F.monotonically_increasing_id()).withColumn("first", F.element_at("ids", 1)), "entries")
    asked = cut(src.filter("asks").select("vec", F.col("id").alias("query_id")).distinct().join(table.select("vec", F.col("number").alias("query")), "vec").drop("vec"), "queries")
    wanted = cut(table.join(asked.select(F.col("query").alias("number")).distinct(), "number", "left_semi").select("number", "data", F.col("asks").alias("keys"), "first"), "wanted")
    table = table.select("number", "first", "keys", "data", "ids")
    forest = fit_forest(table, wanted, dim, kind, k)
    if forest is None:
        return empty
    found, base, todo = None, forest.base, wanted
    while True:
        size = lambda df, c, n: _parts(df, base, "count").groupBy("bucket").agg(F.ceil(F.sum("size") / n).alias(c))  # noqa: B023, E731
        deal = cut(size(table, "vs", BLOCK).join(size(todo, "qs", QUERY_BLOCK), "bucket"), "parts")
        if deal.count() <= BROADCAST_PARTS:
            deal = F.broadcast(deal)
        levels = cut(_levels(table, todo, base, forest.candidates, deal), "levels")
        ready = todo.join(levels.filter("level is not null"), "number")
        more = cut(_scored(table, ready, base, dim, kind, k + 1, deal), "scored")
        found = more if found is None else found.unionByName(more)
        left = levels.filter("level is null").select("number")
        if base == 0 or left.isEmpty():
            break
        todo, base = todo.join(left, "number", "left_semi"), 0

    best = Window.partitionBy("query").orderBy(F.desc("score"), "first", "entry")
    found = found.groupBy("query", "entry", "first").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    ids = found.join(table.select(F.col("number").alias("entry"), "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    ids = ids.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    out = asked.join(ids, "query").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
