"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is a position with two labels, good and bad. Its potentials use features of the line
and of the lines beside it; neighbouring labels share a transition potential. The field is trained by maximum
likelihood on labelled documents, whose lines inherit their label: no labelled line is at hand, so transitions
are learnt from chains whose lines are all good or all bad, and a change within a document rests on the lines'
own features and on those of their neighbours. A document's quality is the mean of its
lines' marginal probabilities of being good (by the forward-backward recursions), weighted by their lengths,
and calibrated.

Defined results: a null or empty text, or one without words, has no line; its score is the calibrated score of
an even quality (one half). A text of any length is scored as a whole: the recursions take a step for
each line of the longest text among ROWS_AT_ONCE. Without labelled documents of both classes all scores are the
share of class 1 among them (0 if none). Repeated rows get equal scores; an id with labels of both classes trains
nothing. score_quality returns its own columns alone; keep_good leaves all columns, whatever their names, as they
are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import score_column
from .training import calibrate, fit_in_task, is_held_out, labelled_sample, sigmoid

#: Labelled documents of each class that the field is fitted on, at most.
SAMPLE_PER_CLASS = 1200
STEPS = 80
RIDGE = 1e-3

#: Classes of bytes, taken away to count them.
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SYMBOL, _BANG, _PAIRED, _SPACE = b"#*$%&|<>@^~=+_{}[]\\", b"!?", b"()\"'`-/:;", b" \t\r\x0b\x0c"
#: Thresholds at which a measure of a line turns a feature on.
_STEPS = {
    "words": (2, 4, 8, 20, 60, 200),
    "length": (2.5, 4, 5, 6, 8, 12),
    "symbols": (0.001, 0.01, 0.03, 0.08, 0.2),
    "bangs": (0.001, 0.01, 0.04, 0.1),
    "upper": (0.02, 0.1, 0.3, 0.6),
    "digits": (0.01, 0.05, 0.2),
    "paired": (0.01, 0.05, 0.15),
    "adjacent": (0.01, 0.05, 0.2, 0.5),
    "repeated": (0.1, 0.3, 0.5, 0.7, 0.9),
    "noisy": (0.02, 0.1, 0.3, 0.6),
    "copy": (0.5,),
    "copies": (0.2, 0.5),
}
FEATURES = 1 + sum(map(len, _STEPS.values()))
_CUTS = [(i, x) for i, cuts in enumerate(_STEPS.values()) for x in cuts]
_COLUMN, _CUT = np.array([i for i, _ in _CUTS]), np.array([x for _, x in _CUTS])


def lines_of(text: str | None) -> tuple[list[tuple[float, ...]], list[int]]:
    """The measures and the lengths of a whole text's lines with a word."""
    measures, sizes = [], []
    if not text:
        return measures, sizes
    lines = [x for x in text.encode().split(b"\n") if x and not x.isspace()]
    seen = Counter(lines) if len(lines) > 1 else {}
    copied = 1 - len(seen) / len(lines) if seen else 0.0
    for b in lines:
        words = b.split()
        n, size = len(words), len(b)
        solid = max(1, sum(map(len, words)))
        rate = lambda kind: (size - len(b.translate(None, kind))) / solid  # noqa: B023, E731
        symbols, bangs = rate(_SYMBOL), rate(_BANG)
        adjacent = sum(map(bytes.__eq__, words, words[1:])) / n
        noisy = sum(1 for w in words if w[-1] in _SYMBOL or w[-1] in _BANG) / n if symbols or bangs else 0.0
        # Long lines repeat words by themselves; the square root is what a varied text of that length has.
        repeated = 1 - len(set(words)) / n if n > 3 else 0.0
        measures.append((n, solid / n, symbols, bangs, rate(_UPPER), rate(_DIGIT), rate(_PAIRED), adjacent, repeated, noisy, float(bool(seen) and seen[b] > 1), copied))
        sizes.append(size)
    return measures, sizes


class Chains:
    """The lines of several documents, laid out one after the other."""

    def __init__(self, docs: list[tuple[list[tuple[float, ...]], list[int]]]):
        self.counts = np.array([len(m) for m, _ in docs], int)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])[:-1] if len(docs) else np.zeros(0, int)
        rows = [r for m, _ in docs for r in m]
        self.sizes = np.array([s for _, x in docs for s in x], float)
        raw = np.array(rows, float).reshape(len(rows), len(_STEPS))
        own = np.hstack([np.ones((len(rows), 1)), raw[:, _COLUMN] > _CUT])
        first, last = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        some = self.counts > 0
        first[self.starts[some]] = True
        last[(self.starts + self.counts - 1)[some]] = True
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[first], after[last] = 0, 0
        self.x = np.hstack([own, before, after])
        # Documents by falling length: at each position those that reach it are the first ones.
        self.order = np.argsort(-self.counts, kind="stable")
        self.reach = [int((self.counts > t).sum()) for t in range(int(self.counts.max()) if len(docs) else 0)]

    def recursions(self, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginals of good per line, expected transitions, log partition functions); emit: log potential of good over bad."""
        n, at = len(self.counts), self.starts[self.order]
        forward, backward = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
        potential = np.stack([np.zeros_like(emit), emit], axis=1)
        log_z = np.zeros(n)
        for t, k in enumerate(self.reach):
            i = at[:k] + t
            if t == 0:
                forward[i] = potential[i]
            else:
                p = forward[i - 1][:, :, None] + trans[None]
                forward[i] = potential[i] + np.logaddexp(p[:, 0], p[:, 1])
        for t in range(len(self.reach) - 2, -1, -1):
            i = at[: self.reach[t + 1]] + t
            q = (potential[i + 1] + backward[i + 1])[:, None, :] + trans[None]
            backward[i] = np.logaddexp(q[:, :, 0], q[:, :, 1])
        some = self.counts > 0
        ends = (self.starts + self.counts - 1)[some]
        log_z[some] = np.logaddexp(forward[ends, 0], forward[ends, 1])
        of = np.repeat(np.arange(n), self.counts)
        good = np.exp(np.minimum(forward[:, 1] + backward[:, 1] - log_z[of], 0))
        pairs = np.ones(len(emit), bool)
        pairs[ends] = False
        i = np.flatnonzero(pairs)
        joint = np.exp(forward[i][:, :, None] + trans[None] + (potential[i + 1] + backward[i + 1])[:, None, :] - log_z[of[i]][:, None, None])
        return good, joint.sum(axis=0), log_z

    def quality(self, weights: np.ndarray, trans: np.ndarray) -> np.ndarray:
        """Length-weighted means of the marginals; one half without lines."""
        out = np.full(len(self.counts), 0.5)
        some = self.counts > 0
        if some.any():
            good, _, _ = self.recursions(self.x @ weights, trans)
            out[some] = np.add.reduceat(good * self.sizes, self.starts[some]) / np.add.reduceat(self.sizes, self.starts[some])
        return out


class QualityModel:
    """The field's weights and transitions, and the calibration."""

    def __init__(self, weights: np.ndarray | None, trans: np.ndarray | None, scale: tuple[float, float], share: float):
        self.weights, self.trans, self.scale, self.share = weights, trans, scale, share

    def forget(self) -> None:
        """It keeps nothing between texts."""

    def evidence(self, chains: Chains) -> np.ndarray:
        q = np.clip(chains.quality(self.weights, self.trans), 1e-4, 1 - 1e-4)
        return np.log(q / (1 - q))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        return sigmoid(self.scale[0] * self.evidence(Chains([lines_of(t) for t in texts])) + self.scale[1])


def fit_chains(docs: list, y: np.ndarray, counts: dict[int, int]) -> QualityModel:
    """Maximum likelihood by gradient steps whose sizes adapt to each weight."""
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if not (y == 1).any() or not (y == 0).any():
        return QualityModel(None, None, (0.0, 0.0), share)
    chains = Chains(docs)
    of = np.repeat(np.arange(len(docs)), chains.counts)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) / np.maximum(1, chains.counts)
    w, trans = np.zeros(chains.x.shape[1]), np.zeros((2, 2))
    mean, square = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    label = y[of]
    inner = np.ones(len(of), bool)
    some = chains.counts > 0
    inner[(chains.starts + chains.counts - 1)[some]] = False
    # With the labels of a document all equal, the observed transitions are good-good and bad-bad.
    observed = np.array([[(inner & (label == 0)).sum(), 0], [0, (inner & (label == 1)).sum()]], float)
    for step in range(1, STEPS + 1):
        good, joint, _ = chains.recursions(chains.x @ w, trans)
        g = chains.x.T @ (weight[of] * (label - good)) - RIDGE * w
        gt = (observed - joint) / max(1.0, observed.sum()) - RIDGE * trans
        grad = np.concatenate([g, gt.ravel()])
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        move = 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
    model = QualityModel(w, trans, (1.0, 0.0), share)
    model.scale = calibrate(model.evidence(chains), y, counts)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fits the field on a bounded sample of the labelled documents that aren't held out; only the model goes to the driver."""
    sample, counts = labelled_sample(docs, labels, label_col, per_class, id_col, text_col)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [lines_of(t) for t in b["text"]]
            yield pd.DataFrame({"measures": [[x for r in m for x in r] for m, _ in both], "sizes": [s for _, s in both], "y": b["y"]})

    def fit(rows: pd.DataFrame) -> QualityModel:
        k = len(_STEPS)
        own = sorted(zip(rows["y"], map(list, rows["sizes"]), map(list, rows["measures"]), strict=True))
        chains = [([tuple(m[i : i + k]) for i in range(0, len(m), k)], sizes) for _, sizes, m in own]
        return fit_chains(chains, np.array([y for y, _, _ in own], int), counts)

    return fit_in_task(sample.mapInPandas(measured, "measures array<double>, sizes array<int>, y int"), fit)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, held_out, score, predicted. One pass over the texts for the sample and one for the scores, without a shuffle of texts."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(id_col), is_held_out(id_col).alias("held_out"), score_column(model, docs.sparkSession, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that score under threshold; all columns as they were."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    return docs.filter(score_column(model, docs.sparkSession, text_col) >= threshold)
