"""What the two classifiers share: a bounded labelled sample, calibration, and scoring as a column."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A row whose crc32 of the id as text leaves 0 is held out from training.
FOLDS, HELD_OUT = 5, 0


def is_held_out(id_col: str | Column) -> Column:
    """True for rows whose labels training never sees; a null id is held out."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """Up to per_class training documents of each class (text, y), picked by a hash of the id, and the number of training labels of each class.

    The sample's ids are at most 2 * per_class rows, so they are broadcast and the documents aren't shuffled. Of
    documents that share an id one counts, the one whose text sorts first, so the sample is bounded whatever
    repeats; an id with labels of both classes trains nothing.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(~is_held_out("id") & F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # Labels of documents that an earlier step has dropped find no text, so the ids come from the labels that still have one.
    own = docs.select(F.col(id_col).alias("id"))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other").join(own.distinct(), "id", "left_semi")
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(ids, "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y"), counts


def fit_in_task(rows: DataFrame, fit: Callable[[pd.DataFrame], Any]) -> Any:
    """fit(rows), worked out in one task: only the model goes to the driver, and a lost executor's fit is run again.

    rows have to be bounded, as those of labelled_sample are; fit may not depend on their order.
    """

    none = pd.DataFrame(columns=rows.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [b for b in batches if len(b)]
        yield pd.DataFrame({"model": [pickle.dumps(fit(pd.concat(own, ignore_index=True) if own else none))]})

    got = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit(none)


def calibrate(x: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> tuple[float, ...]:
    """(a, b) of sigmoid(a * x + b), by regularised maximum likelihood with smoothed targets; classes weigh as in the training labels.

    If x has several columns, an a for each comes before b.
    """
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, counts.get(1, n1) / n1, counts.get(0, n0) / n0)
    weight = weight / weight.mean()
    columns = [x] if x.ndim == 1 else [c.copy() for c in x.T]
    mean, spread = [c.mean() for c in columns], [c.std() or 1.0 for c in columns]
    z = np.stack([*[(c - m) / s for c, m, s in zip(columns, mean, spread, strict=True)], np.ones(len(x))], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - target)) + 1e-3 * w
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return *[float(a / s) for a, s in zip(w[:-1], spread, strict=True)], float(w[-1] - sum(a * m / s for a, m, s in zip(w[:-1], mean, spread, strict=True)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
