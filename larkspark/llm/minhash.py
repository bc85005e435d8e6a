"""Near-duplicate detection with SetSketch registers.

A document's set is its distinct word shingles. Each register holds, on an exponential scale with base BASE,
the smallest of the exponentially distributed hash values of the set's elements (truncated to one byte); the
registers of a union are the elementwise larger ones, and those of similar sets agree often. Bands of
registers make candidates. Whether a candidate pair's similarity, estimated by maximum likelihood jointly from
how many registers are larger, smaller and equal and from both sizes, can reach the threshold decides if the
pair is verified on the full sets. Documents with equal sets are one node from the start.

No pairs within a bucket are listed as a whole. First every member of a bucket is held against the smallest
one. In buckets that then still hold several components every member is held against the likeliest of a few
representatives; and where several components are left even then, the members outside the bucket's largest
component are held against all members, in blocks of bounded size: first by sketches, which leaves the members
that may still have a link, then those by their sets, between components that the block hasn't joined yet. A
pair is looked at in the first band alone that it shares. So a bucket of n members of which s are linked with
none of its largest component costs s times n comparisons of sketches, in (s / BLOCK) * (n / BLOCK) tasks'
worth of blocks, and no set travels unless a sketch asks for it.

Defined results: a null or empty text, or one without words, has the empty set and is linked with nothing. A
text of any length counts with its whole set. Rows with equal sets are linked, whether their ids are equal or
not; rows that share an id but not a text are documents of their own. A row with a null id is its own
component, null, and is kept. Of a component the rows with its smallest id are kept; drop_near_duplicates
keeps one of them. An empty table gives an empty result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, map_texts, runs, turn
from .components import connected_components

BASE = 1.12
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: The scale's lowest step is one byte's 0.
LOWEST = -40
#: A pair whose estimate is lower than the threshold by this isn't verified: over four standard errors of the estimate.
MARGIN = 0.18
#: Members that one task compares with a bucket's centre.
CHUNK = 256
#: Members of a bucket that stand for it while most of it is still to be joined.
REPRESENTATIVES = 8
#: Members of a bucket on each side of a block, and bytes of their sets, on average.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Digests of candidates are broadcast up to this counted number (about 40 bytes each).
BROADCAST_IDS = 200_000
#: Distinct words whose hashes a worker keeps.
CACHE_WORDS = 250_000

_MULTIPLIERS = np.random.default_rng(20240607).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_words: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles; A-Z are lower-cased."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    get, put = _words.get, _words.setdefault
    h = np.array([get(w) or put(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(k, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def registers(items: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes: one byte a register, 0 for the empty set."""
    if not len(items):
        return np.zeros(REGISTERS, np.uint8)
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 1024):
        low = np.minimum(low, (items[at : at + 1024, None] * _MULTIPLIERS[None, :]).min(axis=0))
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53))
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) - LOWEST, 0, 255).astype(np.uint8)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _chances(j: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of two sets of similarity j: the chances that a register of the first is larger or smaller, and their derivatives by j."""
    u = na / (na + nb)
    v, c, scale = 1 - u, (BASE - 1) / BASE, np.log(BASE)
    x, y = np.maximum(u - v * j, 0), np.maximum(v - u * j, 0)
    up, down = (np.maximum(-np.log1p(-z * c) / scale, 1e-9) for z in (x, y))
    return up, down, -v * c / (1 - x * c) / scale, -u * c / (1 - y * c) / scale


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a > b).sum(axis=1), (a < b).sum(axis=1)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs of sketches (rows of a and b) of sets of known sizes."""
    more, less = (x[:, None] for x in _counts(a, b))
    na, nb = na[:, None], nb[:, None]
    j = np.linspace(0, 1, 65)[None, :] * np.minimum(na / nb, nb / na)
    up, down, _, _ = _chances(j, na, nb)
    fit = more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.maximum(1 - up - down, 1e-9))
    return j[np.arange(len(j)), fit.argmax(axis=1)]


def may_reach(least: float, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the likelihood, which has one maximum, still rises at least: then the estimate is that or more."""
    more, less = _counts(a, b)
    up, down, rise, fall = _chances(least, na, nb)
    return more * rise / up + less * fall / down - (REGISTERS - more - less) * (rise + fall) / np.maximum(1 - up - down, 1e-9) >= 0


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) < len(y):
        x, y = y, x
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    common = int((x[at] == y).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def sketch_documents(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_shingles, d1 and d2 (128 bits of the whole set; null for the empty set), sketch."""

    def work(texts: list[str | None]) -> tuple[None, list[pa.Array]]:
        turn("minhash", _words.clear)
        sets = [shingles(t, k) for t in texts]
        digests = [_digest(s) if len(s) else (None, None) for s in sets]
        return None, [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.array([registers(s).tobytes() for s in sets], pa.binary())]

    return map_texts(docs, id_col, text_col, "n_shingles long, d1 long, d2 long, sketch binary", work)


def _digest(items: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """node, items: the full set of each wanted node (node, id, d1, d2), from the text that has its id and its digest."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    src = texts.join(wanted, "id").select("node", "d1", "d2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                node, d1, d2, text = (c.to_pylist() for c in b.slice(at, 256).columns)
                sets = [shingles(t, k) for t in text]
                good = [i for i, s in enumerate(sets) if len(s) and _digest(s) == (d1[i], d2[i])]
                yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in good], pa.int64()), pa.array([sets[i].tobytes() for i in good], pa.binary())], ["node", "items"])

    sets = cut(src.mapInArrow(run, "node long, items binary"), "sets")
    again = sets.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
    if again.isEmpty():
        return sets
    # Rows that repeat an id with its text: their set is kept once.
    again = cut(again, "repeated")
    once = cut(sets.join(again, "node", "left_anti").unionByName(sets.join(again, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items"))), "sets")
    drop(sets, again)
    return once


def _similar(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that have to be verified, by their sketches."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            for at in range(0, p.num_rows, 4096):
                x = p.slice(at, 4096)
                keep = may_reach(percent / 100 - MARGIN, _sketches(x["sa"]), _sketches(x["sb"]), np.asarray(x["na"], float), np.asarray(x["nb"], float))
                yield x.select(["a", "b"]).filter(pa.array(keep))

    # J is at most the smaller size over the larger one.
    near = pairs.join(one, "a").join(two, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The links among pairs (a, b), to be read once, and a table that they need. One side's set is held while its partners stream by, in chunks of bounded size."""
    hot = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).filter("chunks > 1"), "hot")
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "chunks"), F.lit(0).cast("long")).alias("chunk"))
    centres = dealt.select("a", "chunk").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("b"), "items")
    members = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "chunk", F.lit(1).alias("role"), "b", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.empty(0, np.uint64)
        for p in batches:
            found = []
            for i, role in enumerate(p["role"].to_pylist()):
                own = np.frombuffer(p["items"][i].as_buffer(), np.uint64)
                if role == 0:
                    centre = own.copy()
                elif _linked(centre, own, percent):
                    found.append(i)
            yield p.select(["a", "b"]).take(pa.array(found, pa.int64()))

    both = centres.unionByName(members).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")
    return both.mapInArrow(run, "a long, b long"), hot


class _Block:
    """The members of a bucket that meet in a block: left ones, outside its largest component, against all in right."""

    COLUMNS = "bucket long, i long, j long, node long, component long, band int, minor long, own long, centre long, n long, sketch binary"

    def __init__(self, t: pa.Table, percent: int):
        self.key = [t[c][0].as_py() for c in ("bucket", "i", "j")]
        self.percent, self.band = percent, t["band"][0].as_py()
        self.node, self.component, self.size = (t[c].to_numpy() for c in ("node", "component", "n"))
        self.left = np.flatnonzero(t["minor"].to_numpy() == self.key[1])
        self.right = t["own"].to_numpy() == self.key[2]
        self.outside, self.known = t["minor"].to_numpy() >= 0, self.node == t["centre"][0].as_py()
        self.sketch = _sketches(t["sketch"])

    def partners(self, x: int, part: np.ndarray) -> np.ndarray:
        """Who may be linked with x: in another part, not seen with x in an earlier band, of fitting size and sketch."""
        n = self.size
        # A pair with the bucket's centre is known; one of two left members is looked at by the smaller one.
        far = self.right & (part != part[x]) & ~self.known & (~self.outside | (self.node > self.node[x]))
        far = np.flatnonzero(far & (np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * self.percent)) if not self.known[x] else np.empty(0, int)
        if self.band and len(far):
            to = self.band * ROWS
            far = far[~(self.sketch[far, :to] == self.sketch[x, :to]).reshape(len(far), self.band, ROWS).all(axis=2).any(axis=1)]
        if not len(far):
            return far
        own = np.broadcast_to(self.sketch[x], (len(far), REGISTERS))
        return far[may_reach(self.percent / 100 - MARGIN, own, self.sketch[far], np.full(len(far), float(n[x])), n[far].astype(float))]

    def alive(self) -> np.ndarray:
        """Members with a pair that only the sets can decide."""
        out = np.zeros(len(self.node), bool)
        for x in self.left:
            far = self.partners(x, self.component)
            out[far] = True
            out[x] |= len(far) > 0
        return np.flatnonzero(out)

    def links(self, items: list[np.ndarray]) -> list[tuple[int, int]]:
        """The links that join components, the likeliest partners first."""
        part, found = self.component.copy(), []
        for x in self.left:
            far = self.partners(x, part)
            if len(far):
                near = estimate(np.broadcast_to(self.sketch[x], (len(far), REGISTERS)), self.sketch[far], np.full(len(far), float(self.size[x])), self.size[far].astype(float))
                far = far[np.argsort(-near, kind="stable")]
            for y in far:
                if part[y] != part[x] and _linked(items[x], items[y], self.percent):
                    found.append((int(self.node[x]), int(self.node[y])))
                    part[part == part[y]] = part[x]
        return found


def _mixed(members: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members with their components, and the buckets that hold several of them (pairs have been looked at in full)."""
    now = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = now.groupBy("bucket", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    mixed = counted.groupBy("bucket").agg(F.max(F.struct("rows", "component")).alias("top"), F.count("*").alias("several"), F.sum("rows").alias("size"), F.sum("weight").alias("weight"))
    return now, cut(mixed.filter("several > 1 and size > 2"), "mixed")


def _to_representatives(members: DataFrame, parts: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """Links of members with one representative of their bucket each, to be read once, and the tables that they need; None if no bucket holds several components."""
    now, mixed = _mixed(members, parts)
    if mixed.isEmpty():
        return None, [mixed]
    now = cut(now.join(mixed.select("bucket"), "bucket").select("bucket", "node", "component"), "members")
    sketches = nodes.select("node", "n", "sketch")
    some = now.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(REPRESENTATIVES)).alias("slot")).agg(F.min("node").alias("node"))
    some = some.join(now, ["bucket", "node"]).join(sketches, "node")
    some = cut(some.groupBy("bucket").agg(F.collect_list(F.struct("node", "component", "n", "sketch")).alias("others")), "representatives")
    rows = now.join(sketches, "node").join(some, "bucket").select("node", "component", "n", "sketch", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                count = b["others"].value_lengths().to_numpy()
                of, flat = np.repeat(np.arange(b.num_rows), count), b["others"].flatten()
                node, component, n = (b[c].to_numpy() for c in ("node", "component", "n"))
                other, their, m = (flat.field(c).to_numpy() for c in ("node", "component", "n"))
                keep = np.flatnonzero((component[of] != their) & (np.minimum(n[of], m) * 100 >= np.maximum(n[of], m) * percent))
                of, x, y = of[keep], _sketches(b["sketch"])[of[keep]], _sketches(flat.field("sketch"))[keep]
                other, n, m = other[keep], n[of].astype(float), m[keep].astype(float)
                good = np.flatnonzero(may_reach(percent / 100 - MARGIN, x, y, n, m)) if len(keep) else keep
                near = estimate(x[good], y[good], n[good], m[good]) if len(good) else np.empty(0)
                best = good[np.lexsort((other[good], -near, of[good]))]
                best = best[np.unique(of[best], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(other[best]), pa.array(node[of[best]])], ["a", "b"])

    near = cut(rows.mapInArrow(run, "a long, b long").distinct(), "similar")
    links, hot = _verified(near, sets, percent)
    return links, [now, mixed, some, near, hot]


def _within_buckets(members: DataFrame, parts: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """The links that buckets with several components still hold, to be read once, and the tables that they need; None if there are no such buckets."""
    now, mixed = _mixed(members, parts)
    if mixed.isEmpty():
        return None, [mixed]
    chunks = lambda rows, weight: F.greatest(F.ceil(rows / BLOCK), F.ceil(weight * 8 / BLOCK_BYTES))
    outside = F.col("size") - F.col("top.rows")
    mixed_table, mixed = mixed, mixed.select("bucket", F.col("top.component").alias("largest"), chunks(outside, F.col("weight") * outside / F.col("size")).alias("rights"), chunks(F.col("size"), F.col("weight")).alias("lefts"))
    now = now.join(mixed, "bucket").withColumn("minor", F.when(F.col("component") == F.col("largest"), -1).otherwise(F.pmod(F.xxhash64("node"), "rights"))).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), "lefts"))
    last = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    # As a right member in a block for each group of left ones; as a left member also in the blocks of the other right groups.
    right = now.withColumn("i", F.explode(last("rights"))).withColumn("j", F.col("own"))
    left = now.filter("minor >= 0 and lefts > 1").withColumn("j", F.explode(F.filter(last("lefts"), lambda x: x != F.col("own")))).withColumn("i", F.col("minor"))
    columns = [c.split()[0] for c in _Block.COLUMNS.split(", ")]
    narrow = [c for c in columns if c not in ("n", "sketch")]
    blocks = cut(right.select(*narrow).unionByName(left.select(*narrow)), "blocks")
    sketches = nodes.select("node", "n", "sketch")

    def alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            keep = _Block(t, percent).alive()
            if len(keep):
                yield from t.select(narrow).take(pa.array(keep)).combine_chunks().to_batches()

    dealt = lambda df: df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    kinds = {c.split()[0]: c for c in _Block.COLUMNS.split(", ")}
    left_over = cut(dealt(blocks.join(sketches, "node").select(*columns)).mapInArrow(alive, ", ".join(kinds[c] for c in narrow)), "alive")
    drop(blocks)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            found = _Block(t, percent).links([np.frombuffer(x, np.uint64) for x in t["items"].to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    links = dealt(left_over.join(sketches, "node").join(sets, "node").select(*columns, "items")).mapInArrow(joined, "a long, b long")
    return links, [left_over, mixed_table]


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns for each document: id, n_shingles, component_id (smallest id linked with it, directly or not), kept.

    Documents are linked if the sizes of their sets' intersection and union have 100 * i >= percent * u.
    """
    prints = cut(sketch_documents(docs, k, id_col, text_col), "sketches")
    equal = prints.filter("id is not null and n_shingles > 0").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    equal = cut(equal.withColumn("node", F.monotonically_increasing_id()), "equal")
    bands = equal.select("node", "n", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sketch, i * {ROWS} + 1, {ROWS})))")).alias("band", "bucket"))
    first = cut(bands.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("size")).filter("size > 1").drop("size"), "centres")
    members = cut(bands.join(first, "bucket"), "members")
    drop(first)
    ids = members.select("node").distinct()
    nodes = cut(equal.join(ids, "node", "left_semi"), "nodes")
    wanted = nodes.select("node", "id", "d1", "d2")
    if nodes.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = _full_sets(docs, wanted, k, id_col, text_col)
    stars = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    near = cut(_similar(stars, nodes, percent), "similar")
    links, hot = _verified(near, sets, percent)
    parts = connected_components(links)
    drop(near, hot)
    for step in (_to_representatives, _within_buckets):
        links, needed = step(members, parts, nodes, sets, percent)
        if links is not None:
            # A component stays one as the star of its smallest node.
            joined = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
            drop(parts)
            parts = joined
        drop(*needed)
    drop(members, sets, nodes)
    # A component's id is the smallest one of its nodes.
    own = equal.select("node", "id").join(parts, "node")
    low = cut(own.groupBy("component").agg(F.min("id").alias("low")), "smallest")
    named = own.join(low, "component").select("node", "low")
    labels = cut(equal.select("node", "d1", "d2", "id").join(named, "node", "left").select("d1", "d2", F.coalesce("low", "id").alias("component_id")), "labels")
    drop(parts, low, equal)
    of = prints.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("d1")).alias("d1"), "d2").join(labels, ["d1", "d2"], "left")
    same = F.coalesce("component_id", "id")
    return of.select(F.col("id").alias(id_col), "n_shingles", same.alias("component_id"), F.coalesce(same == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: one that has its smallest id. All columns as they were.

    Rows are told apart by their id and their text, so of rows that share both one stays.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    keyed = docs.withColumn(row, F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text"))))
    verdict = cut(near_duplicates(keyed, k, percent, row, text_col).select(row, "kept").filter(F.col(row).isNotNull()), "verdicts")
    gone = cut(verdict.filter("not kept").select(row).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    out = keyed.join(gone, row, "left_anti")
    again = cut(verdict.filter("kept").groupBy(row).agg(F.count("*").alias("n")).filter("n > 1").select(row), "repeated")
    if not again.isEmpty():
        out = out.join(again, row, "left_anti").unionByName(out.join(again, row, "left_semi").dropDuplicates([row]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
