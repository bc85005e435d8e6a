"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel counts common subsequences of three characters, each weighted by DECAY to the power of its span in
both strings, whose last character stands at most SPAN after the first: gaps and inserted characters lower a match but don't undo
it. Its features are normalised by their norm as if all subsequences differed, which keeps it a kernel. A
document is a bag of strings: its words with their ends marked, runs of single characters joined to one, and
windows of long words. Training on labelled documents alternates (multiple-instance learning): landmarks
and first positives are the strings that labelled documents set apart most; then each toxic document's
highest string is its positive and each clean document's highest one a hard negative. A document's score
combines its highest string's decision with the number and share of its strings on the toxic side, repeats
included: a clean document may hold one such word by chance, a toxic one holds them throughout. The weights of
the three come from documents that the machine which scored them wasn't fitted on.

The decision is linear in the landmarks' feature maps, so their weighted sum is one table over character
triples and a string's score costs the same for any number of landmarks.

Training is bounded by parameters: SAMPLE_PER_CLASS documents, LANDMARKS, RANKED telling strings, POSITIVES and
NEGATIVES strings that the machine is fitted on. Scoring isn't: every string of a whole text counts.

Defined results: null and empty texts, and texts without a string, get the score of the lowest decision. A text
of any length is scored as a whole, in memory that grows with it. Without labelled documents of both classes all
scores are the share of class 1 among them (0 if none). Repeated rows get equal scores; an id with labels of both
classes trains nothing. score_toxicity returns its own columns alone; drop_toxic leaves all columns, whatever
their names, as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, turn
from .training import calibrate, fit_in_task, is_held_out, labelled_sample, sigmoid

#: Labelled documents of each class that the machine is fitted on, at most.
SAMPLE_PER_CLASS = 1500
LANDMARKS = 384
#: A string counts as toxic from the start if it stands in so many labelled kinds of document, this often for each clean one's rate.
STRONG_COUNT, STRONG_RATIO = 4, 20
#: Strings that training looks at, at most: those that set the classes apart most, positives from the start, and usual and rare strings of clean documents.
RANKED, POSITIVES, NEGATIVES = 40 * LANDMARKS, 1500, (1500, 3000)
SPAN = 6
DECAY = 0.5
ITERATIONS = 3
#: Machines that are fitted besides, each without a part of the documents, to learn how whole documents are scored.
PARTS = 3
#: The decision of a document without a string, as which lower ones count, and the machine's margin, as which higher ones do.
LOWEST, MARGIN = -3.0, 1.0
COST = 1000.0
#: Longer words are cut into overlapping windows of this length.
WINDOW = 24
#: Distinct strings whose decisions a worker keeps.
CACHE_STRINGS = 250_000
#: Characters that are cut off at both ends of a word.
AROUND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Codes: 0 takes no part in a subsequence, EDGE marks a string's ends, other letters share the codes left.
CODES, EDGE = 64, 63
_PAIRS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]


def _code_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1, 1 << 16):
        x = chr(c)
        if "a" <= x <= "z":
            table[c] = 1 + ord(x) - ord("a")
        elif x.isdigit():
            table[c] = 27 + c % 10
        elif x.isalpha():
            table[c] = 37 + (c * 40503 >> 4) % (EDGE - 37)
    table[2] = EDGE
    return table


_TABLE = _code_table()


def strings(text: str | None) -> Counter[str]:
    """The strings of a whole text and how often each stands in it."""
    words = text.lower().split() if text else []
    out: Counter[str] = Counter()
    for w, n in Counter(words).items():
        out[w.strip(AROUND)] += n
    out.pop("", None)
    if any(len(w) == 1 for w in out):
        run: list[str] = []
        for w in [*words, ""]:
            if len(w) == 1:
                run.append(w)
            elif run:
                if len(run) > 2:
                    out["".join(run)] += 1
                run = []
    for w in [w for w in out if len(w) > WINDOW]:
        n = out.pop(w)
        for i in range(0, len(w) - WINDOW // 2, WINDOW // 2):
            out[w[i : i + WINDOW]] += n
    return out


def codes(words: list[str]) -> np.ndarray:
    """A row of codes for each string, with its ends marked."""
    chars = np.array([f"\x02{w}\x02" for w in words], f"U{WINDOW + 2}").view(np.uint32).reshape(len(words), WINDOW + 2)
    return _TABLE[np.minimum(chars, (1 << 16) - 1)].astype(np.int32)


def triples(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(index of each triple, whether it counts, weight) for each pair of distances."""
    wide = c.shape[1]
    for a, b in _PAIRS:
        x, y, z = c[:, : wide - b], c[:, a : wide - b + a], c[:, b:]
        yield (x * CODES + y) * CODES + z, (x > 0) & (y > 0) & (z > 0), DECAY ** (b + 1)


class Landmarks:
    """The landmarks' normalised feature maps, on the triples that they hold."""

    def __init__(self, words: list[str]):
        c = codes(words)
        norm, seen = np.zeros(len(words)), np.zeros(CODES**3, bool)
        for index, counts, weight in triples(c):
            seen[index[counts]] = True
            norm += weight * weight * counts.sum(axis=1)
        self.held = np.flatnonzero(seen)
        self.row = np.zeros(CODES**3, np.int32)  # row 0: a triple that no landmark holds
        self.row[self.held] = np.arange(1, len(self.held) + 1)
        self.maps = np.zeros((len(self.held) + 1, len(words)), np.float32)
        column = np.arange(len(words))
        for index, counts, weight in triples(c):
            for k in range(index.shape[1]):
                np.add.at(self.maps, (self.row[index[:, k]], column), np.where(counts[:, k], weight, 0))
        self.maps[0] = 0
        self.maps /= np.sqrt(np.maximum(norm, 1e-12))[None, :].astype(np.float32)
        values, vectors = np.linalg.eigh(self.maps.T.astype(float) @ self.maps)
        keep = values > 1e-5 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])  # from kernel values with landmarks to Nyström features

    def features(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.maps.shape[1]), np.float32)
        for at in range(0, len(words), 256):
            c = codes(words[at : at + 256])
            norm = np.zeros(len(c))
            for index, counts, weight in triples(c):
                out[at : at + 256] += weight * self.maps[self.row[index]].sum(axis=1)
                norm += weight * weight * counts.sum(axis=1)
            out[at : at + 256] /= np.sqrt(np.maximum(norm, 1e-12))[:, None].astype(np.float32)
        return out @ self.root

    def table(self, weights: np.ndarray) -> np.ndarray:
        """The decision's weight of each triple."""
        out = np.zeros(CODES**3, np.float32)
        out[self.held] = (self.maps @ (self.root @ weights))[1:]
        return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps; both classes weigh the same as a whole."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y == 1, 1.0, -1.0)
    c = cost * len(y) * weight * np.where(y == 1, 0.5 / max(1e-9, weight[y == 1].sum()), 0.5 / max(1e-9, weight[y == 0].sum()))
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        margin = 1 - sign * (x @ w)
        on = margin > 0
        xs = x[on] * c[on, None]
        g = ridge @ w - xs.T @ (sign[on] * margin[on])
        step = np.linalg.solve(ridge + xs.T @ x[on], g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """table: the decision's weight of each triple; bias; and the calibration of a document's measures."""

    def __init__(self, table: np.ndarray | None, bias: float, scale: tuple[float, ...], share: float):
        self.table, self.bias, self.scale, self.share = table, bias, scale, share
        self.cache: dict[str, float] = {}

    def __reduce__(self):
        return ToxicityModel, (self.table, self.bias, self.scale, self.share)

    def forget(self) -> None:
        self.cache.clear()

    def decisions(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for at in range(0, len(words), 2048):
            c = codes(words[at : at + 2048])
            total, norm = np.zeros(len(c)), np.zeros(len(c))
            for index, counts, weight in triples(c):  # the table is 0 at triples that don't count
                total += weight * self.table[index].sum(axis=1)
                norm += weight * weight * counts.sum(axis=1)
            out[at : at + 2048] = total / np.sqrt(np.maximum(norm, 1e-12))
        return out + self.bias

    def look_up(self, bags: list[Counter[str]]) -> None:
        """Puts the decisions of all strings of bags into the cache."""
        new = list(set().union(*bags).difference(self.cache)) if bags else []
        if len(self.cache) + len(new) > CACHE_STRINGS:
            self.cache.clear()
            new = list(set().union(*bags))
        for at in range(0, len(new), 100_000):
            self.cache.update(zip(new[at : at + 100_000], self.decisions(new[at : at + 100_000]).tolist(), strict=True))

    def measures(self, bags: list[Counter[str]]) -> np.ndarray:
        """A row for each document: its highest decision, and the logarithms of the number and percentage of strings on the toxic side."""
        self.look_up(bags)
        out = np.zeros((len(bags), 3))
        for i, b in enumerate(bags):
            top = max(map(self.cache.__getitem__, b), default=LOWEST)
            over = sum(n for w, n in b.items() if self.cache[w] > 0) if top > 0 else 0
            out[i] = min(max(top, LOWEST), MARGIN), np.log1p(over), np.log1p(100 * over / b.total()) if over else 0
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.share)
        # Column by column: a matrix product may round equal rows differently.
        x = self.measures([strings(t) for t in texts]).T
        return sigmoid(sum(a * m for a, m in zip(self.scale[:-1], x, strict=True)) + self.scale[-1])


def part_of(bag: Counter[str]) -> int:
    """The part of the documents that a document is in; most near copies are in the same."""
    return min((hash_of(w) for w in bag if len(w) > 5), default=0) % PARTS


def fit_bags(bags: list[Counter[str]], y: np.ndarray, counts: dict[int, int]) -> ToxicityModel:
    """The machine of all bags, calibrated on the measures that machines of the other parts give to each part."""
    bags = [Counter(b) for b in bags]
    model = fit_machine(bags, y, counts)
    if model.table is None:
        return model
    x = model.measures(bags)
    model.cache.clear()
    parts = np.array([part_of(b) for b in bags])
    for p in range(PARTS):
        own, others = np.flatnonzero(parts == p), np.flatnonzero(parts != p)
        part = fit_machine([bags[i] for i in others], y[others], counts)
        if part.table is not None and len(own):
            x[own] = part.measures([bags[i] for i in own])
    model.scale = calibrate(x, y, counts)
    while min(model.scale[:-1]) < 0:  # more telling strings never make a document less toxic
        x[:, np.argmin(model.scale[:-1])] = 0
        model.scale = calibrate(x, y, counts)
    return model


def fit_machine(bags: list[Counter[str]], y: np.ndarray, counts: dict[int, int]) -> ToxicityModel:
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if not (y == 1).any() or not (y == 0).any():
        return ToxicityModel(None, 0.0, (0.0, 0.0), share)
    # Copies and near copies would make any of their words look telling, so each kind of document counts once.
    kinds = {}
    for b, t in zip(bags, y, strict=True):
        kinds.setdefault((int(t), *sorted(hash_of(w) for w in b if len(w) > 5)[:2]) if b else (int(t),), b)
    of1, of0 = [b for k, b in kinds.items() if k[0]], [b for k, b in kinds.items() if not k[0]]
    n1, n0 = len(of1), len(of0)
    in1, in0 = Counter(w for b in of1 for w in b), Counter(w for b in of0 for w in b)

    def ratio(w: str) -> float:
        return (in1[w] + 0.1) / (n1 + 0.2) * (n0 + 0.2) / (in0[w] + 0.1)

    def apart(w: str) -> float:
        return in1[w] * np.log(ratio(w))

    # The strings that set apart most; and greedily those that reach documents which few others reach, so rare kinds get landmarks too.
    ranked = sorted((w for w in in1 if in1[w] > 1 and in1[w] * n0 > 5 * in0[w] * n1), key=lambda w: (-apart(w), w))[:RANKED]
    good = set(ranked)
    # Labels err: what stands in two or three of the toxic kinds only may do so by chance, so it's neither a positive nor a landmark.
    strong = [w for w in ranked if in1[w] >= STRONG_COUNT and ratio(w) >= STRONG_RATIO][:POSITIVES]
    first = strong[: LANDMARKS // 4]
    left = [(b.keys() & strong, len(b.keys() & first)) for b in of1]
    for w in strong[len(first) :]:
        if len(first) < LANDMARKS // 2 and sum(w in b for b, n in left if n < 2) > 1:
            first.append(w)
            left = [(b, n + (w in b)) for b, n in left]
    usual = [w for w, _ in sorted(in0.items(), key=lambda x: (-x[1], x[0])) if w not in good]
    rare = sorted((w for w in in0 if in0[w] < 3 and w not in good), key=lambda w: (hash_of(w), w))
    if not first:
        first = sorted(in1, key=lambda w: (-apart(w), w))[:8]
    landmarks = list(dict.fromkeys([*first, *usual[: LANDMARKS // 4], *rare[: LANDMARKS // 4]]))
    space = Landmarks(landmarks)
    known: dict[str, np.ndarray] = {}
    positives = dict.fromkeys([*first, *strong])
    negatives = dict.fromkeys([*usual[: NEGATIVES[0]], *rare[: NEGATIVES[1]]])
    model = None
    for turn in range(ITERATIONS):
        words = [*positives, *negatives]
        new = [w for w in words if w not in known]
        known.update(zip(new, space.features(new), strict=True))
        z = np.stack([known[w] for w in words])
        # A string weighs as many documents as it stands in, so frequent insults aren't lost among rare forms.
        weight = np.array([min(in1[s], 30) for s in positives] + [1 + min(in0[s], 30) ** 0.5 for s in negatives], float)
        w = svm(z, np.array([1] * len(positives) + [0] * len(negatives)), weight)
        model = ToxicityModel(space.table(w[:-1]), float(w[-1]), (0.0, 0.0), share)
        model.look_up([*of1, *of0])
        score = dict(model.cache)
        top = lambda b: max(b, key=lambda s: (score[s], s), default="")
        if turn < ITERATIONS - 1:
            best = sorted({top(b) for b in of1} - {""})
            positives = dict.fromkeys([*strong, *(w for w in first if score[w] > -0.5), *[w for w in best if score[w] > 0 and in1[w] > 1 and ratio(w) >= STRONG_RATIO / 2][:POSITIVES]]) or positives
            negatives.update(dict.fromkeys(w for w in sorted({top(b) for b in of0} - {""}) if w not in positives))
    model.cache.clear()
    return model


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fits the machine on a bounded sample of the labelled documents that aren't held out; only the model goes to the driver."""
    sample, counts = labelled_sample(docs, labels, label_col, per_class, id_col, text_col)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [sorted(strings(t).items()) for t in b["text"]]
            yield pd.DataFrame({"bag": [[w for w, _ in o] for o in own], "times": [[n for _, n in o] for o in own], "y": b["y"]})

    def fit(rows: pd.DataFrame) -> ToxicityModel:
        same: dict[str, str] = {}  # documents share most of their strings: each is kept once
        own = sorted((int(y), [same.setdefault(w, w) for w in bag], [int(n) for n in times]) for y, bag, times in zip(rows["y"], rows["bag"], rows["times"], strict=True))
        return fit_bags([Counter(dict(zip(bag, times, strict=True))) for _, bag, times in own], np.array([y for y, _, _ in own], int), counts)

    return fit_in_task(sample.mapInPandas(bags, "bag array<string>, times array<int>, y int"), fit)


def score_column(model, spark, text_col: str = "text") -> Column:
    """The model's score of a whole text, as a column. The model is broadcast once; its size doesn't depend on the data."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        turn(f"scores {id(own)}", own.forget)
        for texts in batches:
            for at in range(0, len(texts), ROWS_AT_ONCE):
                yield pa.array(own.scores(texts.slice(at, ROWS_AT_ONCE).to_pylist()), pa.float64())

    return score(F.col(text_col).cast("string"))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, held_out, score, predicted. One pass over the texts for the sample and one for the scores, without a shuffle of texts."""
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(id_col), is_held_out(id_col).alias("held_out"), score_column(model, docs.sparkSession, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that score at least threshold; all columns as they were."""
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    return docs.filter(score_column(model, docs.sparkSession, text_col) < threshold)
