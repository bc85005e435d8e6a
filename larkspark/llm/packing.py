"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

A document becomes its token ids and a closing id. Documents over the limit are cut into pieces of the full
length, of which the first may be shorter; a full piece is a sequence by itself. The other pieces are dealt by
a hash into blocks of bounded size. Each block is evolved on several islands: a solution is a list of bins; a
crossover injects whole well-filled bins of one parent into the other, removes the bins that now hold
duplicates, and puts the displaced documents back by best fit. Between rounds the best solution of each island
migrates to the next island of its block; a last task for each block crosses the islands' best ones and keeps
the best. Evolution of a block ends as soon as the number of bins equals its lower bound.

Defined results: a null or empty text is a document of the closing id alone. A text of any length is encoded
whole, in the memory that its ids take. Repeated rows are packed each for itself; ids may be null or of any
type and are passed on as they are. Of bins that fit equally well the first one is taken, and of equally long
pieces the first one goes first. An empty table gives an empty result. Other columns, whatever their names,
are not looked at.
"""

from __future__ import annotations

import base64
import json
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, turn

#: Pieces in a block, on average.
BLOCK_ITEMS = 6000
ISLANDS = 2
ROUNDS = 2
POPULATION = 4
OFFSPRING = 6
#: A bin of this share of the capacity is well-filled: a crossover may inject it.
WELL_FILLED = 0.995


class Encoder:
    """Byte-level BPE ids of whole texts. Each text is encoded by native code in one call."""

    SPECIAL = "<|endoftext|>"

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        if path.endswith(".json"):
            from .bpe import byte_alphabet

            back = {c: b for b, c in enumerate(byte_alphabet())}
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {self.SPECIAL: len(ranks)}
        self.path, self.special, self.other = path, {*special}, None
        self.bpe = tiktoken.Encoding("larkspark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        allowed = self.special if any(s in text for s in self.special) else set()
        try:
            return self.bpe.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        except ValueError:  # a run of white space that is too long for this engine's pattern
            if self.other is None:
                from tokenizers import Tokenizer

                self.other = Tokenizer.from_file(self.path)
            return np.array(self.other.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def tokenize(docs: DataFrame, path: str, end_id: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: id, piece, start, length, ids_crc32. One pass without a shuffle."""

    def work(texts: list[str | None]) -> tuple[np.ndarray, list[pa.Array]]:
        turn("packing", _ENCODERS.clear)
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encode, end = _ENCODERS[path].encode, np.array([end_id], "<u4")
        rows: list[tuple[int, int, int, int, int]] = []
        for of, text in enumerate(texts):
            ids = np.concatenate([encode(text).astype("<u4", copy=False), end])
            n, at, k = len(ids), 0, 0
            while at < n:
                to = at + ((n - at - 1) % limit + 1)
                rows.append((of, k, at, to - at, zlib.crc32(ids[at:to])))
                at, k = to, k + 1
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return np.array(columns[0], np.int64), [pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True)]

    return map_texts(docs, id_col, text_col, "piece int, start long, length long, ids_crc32 long", work)


class Bins:
    """A solution: bins of item numbers, with the bins of each free space at hand for best fit."""

    def __init__(self, sizes: list[int], limit: int):
        self.sizes, self.limit = sizes, limit
        self.bins: dict[int, list[int]] = {}
        self.free: dict[int, int] = {}
        self.by_free: list[set[int] | None] = [None] * (limit + 1)
        self.mask, self.next = 0, 0

    def copy(self) -> Bins:
        new = Bins(self.sizes, self.limit)
        for k, items in self.bins.items():
            new.add(list(items), self.free[k])
        return new

    def _file(self, k: int, free: int) -> None:
        self.free[k] = free
        at = self.by_free[free]
        if at is None:
            at = self.by_free[free] = set()
        at.add(k)
        self.mask |= 1 << free

    def _unfile(self, k: int) -> int:
        free = self.free.pop(k)
        at = self.by_free[free]
        at.discard(k)
        if not at:
            self.mask &= ~(1 << free)
        return free

    def add(self, items: list[int], free: int) -> None:
        self.bins[self.next] = items
        self._file(self.next, free)
        self.next += 1

    def remove(self, k: int) -> list[int]:
        self._unfile(k)
        return self.bins.pop(k)

    def best_fit(self, items: list[int]) -> None:
        """Largest first, each into the bin with the least free space that holds it, else into a new bin."""
        sizes = self.sizes
        for i in sorted(items, key=lambda i: -sizes[i]):
            self.place(i)

    def place(self, i: int) -> None:
        s = self.sizes[i]
        m = self.mask >> s
        if m:
            free = s + (m & -m).bit_length() - 1
            k = min(self.by_free[free])
            self._unfile(k)
            self.bins[k].append(i)
            self._file(k, free - s)
        else:
            self.add([i], self.limit - s)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: smaller is better."""
        return len(self.bins), -sum((self.limit - f) ** 2 for f in self.free.values())


def crossover(into: Bins, other: Bins, rng: random.Random) -> Bins:
    """A child of into that holds some of the well-filled bins of other."""
    child = into.copy()
    most = int(into.limit * (1 - WELL_FILLED))
    full = [k for k, f in other.free.items() if f <= most] or list(other.bins)
    inject = rng.sample(full, max(1, len(full) // 3))
    holds = {i for k in inject for i in other.bins[k]}
    displaced: list[int] = []
    for k in [k for k, items in child.bins.items() if not holds.isdisjoint(items)]:
        displaced += [i for i in child.remove(k) if i not in holds]
    for k in inject:
        child.add(list(other.bins[k]), other.free[k])
    child.best_fit(displaced)
    return child


def mutate(child: Bins, rng: random.Random) -> None:
    """Opens some of the emptiest bins, with a few others for their partners, and puts their items back by best fit."""
    worst = sorted(child.bins, key=lambda k: -child.free[k])[: 2 + len(child.bins) // 20]
    some = {*worst, *rng.sample(sorted(child.bins), min(len(child.bins), len(worst)))}
    child.best_fit([i for k in sorted(some) for i in child.remove(k)])


def evolve(sizes: list[int], limit: int, seeds: list[list[list[int]]], rng: random.Random) -> list[list[int]]:
    """The best solution found; seeds are solutions to start from, without any a population of best-fit ones."""
    bound = -(-sum(sizes) // limit)
    population: list[Bins] = []
    for bins in seeds:
        one = Bins(sizes, limit)
        for items in bins:
            one.add(list(items), limit - sum(sizes[i] for i in items))
        population.append(one)
    while len(population) < (POPULATION if not seeds else 2):
        one = Bins(sizes, limit)
        if not population:
            one.best_fit(list(range(len(sizes))))
        else:
            for i in sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.9, 1.0)):
                one.place(i)
        population.append(one)
        if len(one.bins) == bound:
            break
    population.sort(key=Bins.fitness)
    for _ in range(OFFSPRING):
        if len(population[0].bins) <= bound or len(population) < 2:
            break
        a, b = rng.sample(population, 2)
        child = crossover(a, b, rng)
        mutate(child, rng)
        population = sorted([*population, child], key=Bins.fitness)[:-1]
    return list(population[0].bins.values())


def _solutions(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[list[list[int]]]]:
    """The items in a fixed order, and the solutions that the rows bring along (by the column origin; -1: none)."""
    rows = rows.sort_values(["origin", "length", "item"], kind="stable")
    first = rows["origin"].iloc[0]
    items = rows[rows["origin"] == first].reset_index(drop=True)
    out = []
    for origin, part in rows.groupby("origin", sort=True):
        if origin >= 0:
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(part["bin"]):
                bins.setdefault(b, []).append(i)
            out.append(list(bins.values()))
    return items, out


def pack(pieces: DataFrame, limit: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns, with a length of at most limit).

    The pieces are written with a number each, so that every later read finds the same numbers.

    Each block is worked on in one task: its size is bounded by BLOCK_ITEMS on average, whatever the input's size.
    """
    pieces = cut(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    items = pieces.filter(F.col("length") < limit)
    full = pieces.filter(F.col("length") >= limit)
    n = items.count()
    blocks = max(1, round(n / BLOCK_ITEMS))
    kept = "block long, island int, item long, length long, origin int, bin int"

    def step(last: bool, turn: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            own, seeds = _solutions(rows)
            block, island = int(rows["block"].iloc[0]), int(rows["island"].iloc[0])
            sizes = [int(x) for x in own["length"]]
            best = evolve(sizes, limit, seeds, random.Random(f"{block} {island} {turn}"))
            bin_of = [0] * len(sizes)
            start = [0] * len(sizes)
            for k, members in enumerate(best):
                at = 0
                for i in members:
                    bin_of[i], start[i] = k, at
                    at += sizes[i]
            out = own.assign(bin=bin_of, origin=island)
            if last:
                return pd.DataFrame({"item": out["item"], "sequence_id": block * (1 << 24) + pd.Series(bin_of, dtype="int64"), "offset": pd.Series(start, dtype="int64")})
            return out[["block", "island", "item", "length", "origin", "bin"]]

        return run

    # Only item numbers and lengths go through the rounds; a hash deals them, so repeated or hot ids don't gather.
    state = items.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"), "item", "length", F.lit(-1).alias("origin"), F.lit(0).alias("bin"))
    for turn in range(ROUNDS):
        best = state.groupBy("block", "island").applyInPandas(step(False, turn), kept)
        if turn < ROUNDS - 1:  # the elite stays, and a copy of it migrates to the next island
            best = best.withColumn("island", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS).cast("int"))))
        state = best
    ends = state.withColumn("island", F.lit(0)).groupBy("block", "island").applyInPandas(step(True, ROUNDS), "item long, sequence_id long, offset long")
    packed = items.join(ends, "item").drop("item")
    alone = full.withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone.drop("item"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns a row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(tokenize(docs, path, end_id, limit, id_col, text_col), limit).withColumnRenamed("id", id_col)
