"""Quality: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled 1; the unlabelled side is web text as it comes, labels unseen.
The class prior is estimated from the two samples: a set that holds the share ``a`` of the positives and ``b`` of the
unlabelled text bounds the prior by ``b / a``, and the least such bound over a classifier's upper sets is
the estimate.  A small network then minimises the non-negative unbiased risk (logistic loss), taking a step
back whenever the part of the risk owed to negatives falls below ``-beta`` (zero but for the error of the estimated prior).

Features see the form of a text, not its words: frequencies of byte-class pairs, repetition of words,
lengths.  Both samples are bounded (``max_docs``) and chosen by hash of the id.

Defined results: a null or empty text has the features of no bytes and gets a score like any other; without positives or
without unlabelled text every score is the prior's bound of 0; repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    max_docs: int = 8000
    hidden: int = 24
    epochs: int = 60
    batch: int = 512
    rate: float = 0.004
    decay: float = 1e-4
    beta: float = 0.05
    seed: int = 3


@dataclass
class Model:
    prior: float = 0.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    net: tuple | None = None


def _classes() -> np.ndarray:
    c = np.full(256, 13, np.uint8)  # other ASCII signs
    c[97:123], c[65:91], c[48:58] = 0, 1, 2
    c[32], c[10] = 3, 4
    c[[9, 11, 12, 13]] = 5
    for ch, k in ((".", 6), (",", 7), ("!", 8), ("?", 8), ("|", 9), ("%", 10), ("$", 10), ("&", 10), ("*", 10), ("#", 10), ("-", 11), (":", 11), (";", 11), ("'", 12), ('"', 12)):
        c[ord(ch)] = k
    c[0:9] = 15
    c[128:192], c[192:256] = 14, 15
    return c


_CLASS = _classes()
N_FEATURES = 256 + 7


def features(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if not raw:
            continue
        c = _CLASS[np.frombuffer(raw, np.uint8)]
        pairs = np.bincount((c[:-1] << 4).astype(np.int16) + c[1:], minlength=256) if len(c) > 1 else np.zeros(256)
        out[i, :256] = np.sqrt(pairs / max(1, len(c) - 1))
        words = raw.split()
        n = max(1, len(words))
        again = sum(map(bytes.__eq__, words, words[1:]))
        lines = raw.split(b"\n")
        out[i, 256:] = (again / n, np.sqrt(len(set(words)) / n), len(set(words[:64])) / max(1, min(64, n)), len(raw) / n / 10, np.log1p(n) / 5, np.log1p(len(raw) / len(lines)) / 5, len(set(lines)) / len(lines))
    return out


def _forward(net: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, v, c = net
    hidden = np.tanh(x @ a + b)
    return hidden @ v + c, hidden


def _loss(z: np.ndarray) -> np.ndarray:
    """Logistic loss of margin z."""
    return np.logaddexp(0, -z)


def _slope(z: np.ndarray) -> np.ndarray:
    return -1 / (1 + np.exp(np.clip(z, -40, 40)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, p: Params, non_negative: bool = True) -> tuple:
    """A network of one hidden layer that minimises the non-negative risk; with ``non_negative`` off, positives against unlabelled."""
    rng = np.random.default_rng(p.seed)
    d = positive.shape[1]
    net = [rng.normal(0, 1 / np.sqrt(d), (d, p.hidden)), np.zeros(p.hidden), rng.normal(0, 0.1, p.hidden), np.zeros(1)]
    m, s, step = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    rounds = max(1, len(unlabelled) // p.batch)
    # small samples take as many steps as large ones
    epochs = max(p.epochs, -(-900 // rounds))
    for _ in range(epochs):
        up, pp = rng.permutation(len(unlabelled)), rng.permutation(len(positive))
        for k in range(rounds):
            xu = unlabelled[up[k::rounds]]
            xp = positive[pp[k::rounds]] if len(positive) >= rounds else positive
            x = np.r_[xp, xu]
            z, hidden = _forward(net, x)
            zp, zu, n, u = z[: len(xp)], z[len(xp) :], len(xp), len(xu)
            if non_negative:
                owed = _loss(-zu).mean() - prior * _loss(-zp).mean()
                if owed >= -p.beta:
                    g = np.r_[prior * (_slope(zp) + _slope(-zp)) / n, -_slope(-zu) / u]
                else:  # step back on the part that overfits
                    g = np.r_[-prior * _slope(-zp) / n, _slope(-zu) / u]
            else:
                g = np.r_[0.5 * _slope(zp) / n, -0.5 * _slope(-zu) / u]
            gh = np.outer(g, net[2]) * (1 - hidden**2)
            grads = [x.T @ gh + p.decay * net[0], gh.sum(0), hidden.T @ g + p.decay * net[2], np.array([g.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                s[i] = 0.999 * s[i] + 0.001 * grad**2
                net[i] = net[i] - p.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(net)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, p: Params) -> float:
    """The least bound on the share of positives in the unlabelled text, on halves not trained on."""
    quick = Params(max_docs=p.max_docs, hidden=p.hidden, epochs=max(1, p.epochs // 4), batch=p.batch, rate=p.rate, decay=10 * p.decay, seed=p.seed)
    bounds = []
    for half in (0, 1):
        net = train(positive[half::2], unlabelled[half::2], 0.5, quick, non_negative=False)
        zp, zu = np.sort(_forward(net, positive[1 - half :: 2])[0]), np.sort(_forward(net, unlabelled[1 - half :: 2])[0])
        if not len(zp) or not len(zu):
            continue
        cuts = np.quantile(zp, np.linspace(0.0, 0.7, 141))
        a = 1 - np.searchsorted(zp, cuts) / len(zp)
        b = 1 - np.searchsorted(zu, cuts) / len(zu)
        slack = np.sqrt(b * (1 - b) / len(zu)) + np.sqrt(a * (1 - a) / len(zp))
        bounds.append(float(((b + slack) / np.maximum(a, 1e-9)).min()))
    return float(np.clip(np.mean(bounds), 0.01, 0.99)) if bounds else 0.5


def _sample(spark: SparkSession, documents: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the documents with the given ids, a bounded number: of the texts of one id the least."""
    chosen = spark.createDataFrame(ids.collect(), "doc_id long")

    def measure(batches):
        for b in batches:
            x = features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = texts.orderBy("doc_id").select("text").mapInArrow(measure, "x binary").collect()
    return np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, N_FEATURES).astype(float)


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, trainable, p: Params = Params()) -> Model:
    """Train on positives among the rows for which ``trainable`` holds, and on unlabelled text of the same folds."""
    by_hash = lambda df: df.orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.max_docs)
    trusted = labels.where(F.col("doc_id").isNotNull() & trainable).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    web = documents.where(F.col("doc_id").isNotNull() & trainable).select("doc_id").distinct()
    positive, unlabelled = _sample(spark, documents, by_hash(trusted)), _sample(spark, documents, by_hash(web))
    if len(positive) < 2 or len(unlabelled) < 2:
        return Model()
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.01
    positive, unlabelled = ((x - mean) / scale for x in (positive, unlabelled))
    prior = estimate_prior(positive, unlabelled, p)
    return Model(prior, mean, scale, train(positive, unlabelled, prior, p))


def score(spark: SparkSession, documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``documents``."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                if m.net is None:
                    s = np.full(part.num_rows, m.prior)
                else:
                    z = _forward(m.net, (features(part.column("text").to_pylist()) - m.mean) / m.scale)[0]
                    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
