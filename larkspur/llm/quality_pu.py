"""Text quality by positive-unlabelled learning with the non-negative unbiased risk.

The model is logistic on shape features of a whole text.  It is trained on trusted positives P and unlabelled web text
U with an estimated class prior pi, minimising  pi*E_P[l(g)] + max(0, E_U[l(-g)] - pi*E_P[l(-g)])  (the second term, the
risk on negatives, can't be negative).  The weights see no negative label.  Only the two numbers that turn the margin into
a probability are set by all labelled training rows, negative ones included.  The class prior of U is estimated: it begins
as the share of positives among the labelled training rows, and is then the mean probability of U by the model fitted with
the last estimate, corrected for the labelled rows' share, until it stays (or ROUNDS times).

The fit sees bounded samples (parameters `positives`, `unlabelled`; smallest hashes of the id), so the driver's work
doesn't grow; scores are computed for every text where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import small_batches

POSITIVES, UNLABELLED, ROUNDS = 6000, 6000, 4
_SIGNS = re.compile(r"[#$%&*@^~+=<>{}\[\]\\]")


def features(text: str) -> list[float]:
    """Shares and means over a whole text; an empty text has zeros and a flag of its own."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    joined = "".join(words)
    upper = sum(map(str.isupper, words)) / n
    bang = text.count("!")
    pipe = text.count("|")
    signs = len(_SIGNS.findall(joined))
    alpha = sum(map(str.isalpha, words)) / n
    digit = sum(map(str.isdigit, joined)) / len(joined)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    distinct = len(set(words))
    lines = text.split("\n")
    own_lines = len(set(lines)) / len(lines)
    stops = text.count(".") / n
    commas = text.count(",") / n
    ends = sum(w[-1] == "!" for w in words) / n
    odd_end = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'" for w in words) / n
    return [
        upper, min(bang / n, 2.0), min(pipe / n, 1.0), min(signs / n, 3.0), alpha, digit, again,
        distinct / n, distinct / n**0.8, own_lines, min(stops, 1.0), min(commas, 1.0), ends, odd_end,
        min(len(joined) / n, 40.0) / 10, np.log1p(chars) / 10, np.log1p(n) / 10,
        float(upper > 0.3), float(pipe / n > 0.2), float(signs / n > 0.3), float(again > 0.2), float(ends > 0.2), 0.0,
    ]


N_FEATURES = 23


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -40, 40)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, labelled: np.ndarray, labels: np.ndarray, steps: int = 500, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Full-batch Adam on the non-negative risk with logistic loss, then a two-parameter calibration."""
    both = np.concatenate([positive, unlabelled])
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.0, float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    norm = lambda x: np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    p, u = norm(positive), norm(unlabelled)
    w, m, v = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1)
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        push = -prior * (p * _sigmoid(-gp)[:, None]).mean(axis=0)
        pull = (u * _sigmoid(gu)[:, None]).mean(axis=0) - prior * (p * _sigmoid(gp)[:, None]).mean(axis=0)
        grad = (push + pull if negative >= 0 else -pull) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = Model(mean, scale, w, 1.0, 0.0)
    if len(set(labels.tolist())) == 2:
        g, s, o = model.margin(labelled), 1.0, 0.0
        for _ in range(50):  # Newton steps of logistic regression on the margin
            q = _sigmoid(s * g + o)
            r, h = q - labels, q * (1 - q) + 1e-6
            a = np.array([[(h * g * g).sum() + 1e-2, (h * g).sum()], [(h * g).sum(), h.sum() + 1e-2]])
            ds, do = np.linalg.solve(a, [(r * g).sum(), r.sum()])
            s, o = s - float(np.clip(ds, -1, 1)), o - float(np.clip(do, -1, 1))
        model.slope, model.offset = max(s, 1e-3), o
    return model


def estimate_prior(scores: np.ndarray, share: float, steps: int = 50) -> float:
    """Share of positives among unlabelled scores, which are probabilities where positives are `share`: the fixed point of
    the mean of the scores corrected for it."""
    odds = np.clip(scores, 1e-6, 1 - 1e-6) / (1 - np.clip(scores, 1e-6, 1 - 1e-6)) * (1 - share) / share
    prior = share
    for _ in range(steps):
        both = odds * prior / (1 - prior)
        prior = float(np.clip((both / (1 + both)).mean(), 0.01, 0.99))
    return prior


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x.as_py() or "") for x in batch.column("_text")]
        yield pa.RecordBatch.from_arrays([batch.column("_i"), batch.column("_y"), pa.array(rows, pa.list_(pa.float64()))], names=["_i", "_y", "x"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs: all texts; labels: id and 0/1 label of the training rows only.

    The fit sees at most `positives` labelled and `unlabelled` other ids, those with the smallest hashes; of rows that
    repeat an id, one.  Null ids and labels are passed over, null texts count as empty; of repeated labels of an id the
    larger counts.  Without positives or texts the model gives every text the same score.  Whole texts are looked at,
    each by one task.  Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    known = (
        labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_i").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_i"), "_i").limit(positives)
    )
    web = docs.select(F.col(id_col).alias("_i")).dropna().distinct().orderBy(F.xxhash64(F.lit(3), "_i"), "_i").limit(unlabelled).withColumn("_y", F.lit(-1))
    picked = F.broadcast(known.unionByName(web))  # at most positives + unlabelled rows
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_text")).join(picked, "_i")
    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.select("_i", "_y", "_text").mapInArrow(_feature_batches, f"_i {kind}, _y int, x array<double>").groupBy("_i", "_y").agg(F.min("x").alias("x")).collect()
    got = sorted(got, key=lambda r: (r["_y"], r["_i"]))
    y = np.array([r["_y"] for r in got], np.int64)
    x = np.array([r["x"] for r in got], np.float64).reshape(len(got), N_FEATURES)
    named = y >= 0
    share = float(np.clip(y[named].mean(), 0.01, 0.99)) if named.any() else 0.5
    prior = share
    for _ in range(ROUNDS):
        model = fit(x[y == 1], x[~named], prior, x[named], y[named].astype(float))
        found = estimate_prior(model.score(x[~named]), share) if (~named).any() and len(set(y[named].tolist())) == 2 else prior
        if abs(found - prior) < 0.005:
            break
        prior = found
    return model


def score_quality(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id and score (0 to 1) of every whole text.

    Null text: as an empty one, which has a score of its own.  Repeated rows and null ids are scored each by itself; equal
    texts have equal scores.  Only the text enters a score, all of it however long.  Empty table: empty result.  Other
    columns of docs are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column("_text")], np.float64).reshape(batch.num_rows, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(model.score(x), pa.float64())], names=["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)
