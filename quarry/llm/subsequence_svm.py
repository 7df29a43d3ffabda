"""Toxicity: a subsequence string-kernel SVM on Nystroem landmarks.

The kernel compares two words by the character subsequences of length three that they share, each
occurrence weighted by ``decay`` to the power of the stretch it spans, so that ``st.upid``,
``stuupid`` and ``s t u p i d`` stay close to ``stupid``.  Stretches are bounded by ``max_span``.
Each word is scaled by the norm its length would have without repeated subsequences; that keeps the
kernel positive definite, since it scales by a function of one word only.

A sentence is a bag of windows (its words, and runs of single characters read as one word); its
decision is the largest of its windows.  The machine is trained on the sentences of labelled
documents, by multiple instances: a sentence enters by its witness, the window of the largest
decision.  All sentences of a clean document are clean; of a toxic document those are toxic that
the machine takes for toxic, at least the one of the largest decision.  Witnesses and machine take turns for
``rounds`` rounds, from a first machine on windows that toxic sentences hold significantly more often.  The
landmark expansion of the linear SVM is folded into one weight per subsequence, so scoring a word
costs one table look-up per subsequence.

Defined results: a null or empty text scores as a text without any window; an unlabelled or
one-class training set gives every document the share of label 1 (0 without rows); repeated rows are
scored alike; a null ``doc_id`` is never trained on and not held out; of the texts of one id the
least is trained on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.runtime import ARROW_ROWS, Workspace

#: A run of single characters with gaps: read as one word.
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+\s")
_WIDTH = 20
#: Files of the labelled documents; their number is bounded, so this is too.
_PARTS = 64


@dataclass(frozen=True)
class Params:
    """``max_docs`` bounds the labelled documents of each class that are trained on, ``max_words``
    the distinct windows of each class, ``landmarks`` the Nystroem basis.  A toxic document whose best
    witness is decided below ``floor``, or is not ``odds`` times as common in toxic documents, is no evidence of its label.
    ``evidence`` is the log-likelihood from which a window of the first machine is toxic: insults of a language that
    few documents are in stand in few of them."""

    decay: float = 0.5
    max_span: int = 6
    landmarks: int = 512
    max_docs: int = 6000
    max_words: int = 12000
    rounds: int = 2
    floor: float = -0.5
    odds: float = 8.0
    cost: float = 2.0
    evidence: float = 12.0
    seed: int = 7


@dataclass
class Model:
    params: Params
    prior: float = 0.0
    table: np.ndarray | None = None
    bias: float = 0.0
    link: np.ndarray = field(default_factory=lambda: np.zeros(5))


def _codes() -> np.ndarray:
    c = 39 + np.arange(65536) % 25
    for i, ch in enumerate("abcdefghijklmnopqrstuvwxyz0123456789^$"):
        c[ord(ch)] = i + 1
    return c.astype(np.int32)


_CODES = _codes()


def window(token: str) -> str:
    """The letters and digits of a token, between end marks."""
    kept = token if token.isalnum() else "".join(filter(str.isalnum, token))
    return f"^{kept}$" if kept else ""


def pieces(word: str) -> list[str]:
    """Long words in overlapping stretches, so that the whole word counts."""
    if len(word) <= _WIDTH:
        return [word]
    return [word[i : i + _WIDTH] for i in range(0, len(word) - _WIDTH // 2, _WIDTH // 2)]


def sentences(text: str) -> list[list[str]]:
    """The distinct windows of each sentence that has any."""
    bags = []
    for s in _SENTENCE.split(text.lower()):
        tokens = {*s.split(), *("".join(x.split()) for x in _SPACED.findall(s))}
        if bag := sorted({x for w in map(window, tokens) if w for x in pieces(w)}):
            bags.append(bag)
    return bags


@lru_cache(maxsize=None)
def _triples(n: int, decay: float, span: int):
    """(i, j, k, weight) of the subsequences of a word of n characters, and its norm."""
    found = [(i, j, k, decay ** (k - i + 1)) for i, j, k in combinations(range(n), 3) if k - i < span]
    return found, float(np.sqrt(sum(w * w for *_, w in found))) or 1.0


def _arrays(words: list[str]):
    """Yields (positions in words, code array) for each length."""
    by: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        by.setdefault(len(w), []).append(at)
    for n, at in by.items():
        for lo in range(0, len(at), 8192):
            part = at[lo : lo + 8192]
            raw = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), "<u4").reshape(len(part), n)
            yield part, np.where(raw < 65536, _CODES[np.minimum(raw, 65535)], 39 + raw % 25).astype(np.int32)


def decide_words(table: np.ndarray, words: list[str], p: Params) -> np.ndarray:
    """The decision values, without bias, of words of at most ``_WIDTH`` characters."""
    out = np.zeros(len(words), np.float32)
    for at, c in _arrays(words):
        found, norm = _triples(c.shape[1], p.decay, p.max_span)
        total = np.zeros(len(at), np.float32)
        cols = np.ascontiguousarray(c.T)
        last = None
        for i, j, k, w in found:
            if (i, j) != last:
                head, last = (cols[i] << 12) | (cols[j] << 6), (i, j)
            total += np.float32(w) * table[head | cols[k]]
        out[at] = total / norm
    return out


def explicit(words: list[str], p: Params):
    """Sparse feature rows of words: (row, subsequence code, value)."""
    rows, cols, vals = [], [], []
    for at, c in _arrays(words):
        found, norm = _triples(c.shape[1], p.decay, p.max_span)
        for i, j, k, w in found:
            rows.append(np.asarray(at))
            cols.append((c[:, i] << 12) | (c[:, j] << 6) | c[:, k])
            vals.append(np.full(len(at), w / norm, np.float64))
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def kernel(words: list[str], landmarks: list[str], p: Params) -> np.ndarray:
    """The kernel matrix between words and landmarks."""
    lr, lc, lv = explicit(landmarks, p)
    used, pos = np.unique(lc, return_inverse=True)
    basis = np.zeros((len(used), len(landmarks)))
    np.add.at(basis, (pos, lr), lv)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for lo in range(0, len(words), 512):
        wr, wc, wv = explicit(words[lo : lo + 512], p)
        at = np.searchsorted(used, wc)
        hit = (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == wc)
        dense = np.zeros((min(512, len(words) - lo), len(used)))
        np.add.at(dense, (wr[hit], at[hit]), wv[hit])
        out[lo : lo + 512] = dense @ basis
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Newton's method on the primal of the linear SVM; the last column of x is the constant."""
    d = x.shape[1]
    v, ridge = np.zeros(d), np.ones(d)
    ridge[-1] = 1e-3
    for _ in range(40):
        gram, side = np.diag(ridge), np.zeros(d)
        for lo in range(0, len(x), 2048):  # block by block: no second copy of x
            part, sign, cs = x[lo : lo + 2048], y[lo : lo + 2048], weight[lo : lo + 2048]
            active = sign * (part @ v) < 1
            part, scaled = part[active].astype(float), 2 * cost * cs[active]
            gram += (part * scaled[:, None]).T @ part
            side += part.T @ (scaled * sign[active])
        step = np.linalg.solve(gram, side)
        if np.allclose(step, v, atol=1e-7):
            break
        v = step
    return v


def train_words(positive: list[str], seen_in: np.ndarray, negative: list[str], hard: list[str], p: Params) -> tuple[np.ndarray, float]:
    """The folded weight table and bias of the landmark SVM over windows; positives weigh by the
    root of the documents they were ``seen_in``; ``hard`` negatives become landmarks first."""
    take = lambda ws, n: [ws[i] for i in np.linspace(0, len(ws) - 1, min(n, len(ws))).astype(int)]
    marks = list(dict.fromkeys(positive[: p.landmarks // 8] + take(positive, p.landmarks // 4) + hard[: p.landmarks // 2] + take(negative, p.landmarks)))[: p.landmarks]
    words = positive + negative
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    root_n = np.sqrt(seen_in)
    weight = 0.5 * len(y) * np.r_[root_n / root_n.sum(), np.full(len(negative), 1 / len(negative))]
    values, vectors = np.linalg.eigh(kernel(marks, marks, p))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) * (values > 1e-6)
    z = np.ones((len(words), root.shape[1] + 1), np.float32)
    for lo in range(0, len(words), 2048):
        z[lo : lo + 2048, :-1] = kernel(words[lo : lo + 2048], marks, p) @ root
    v = squared_hinge(z, y, weight, p.cost)
    alpha = root @ v[:-1]
    lr, lc, lv = explicit(marks, p)
    table = np.zeros(64**3)
    np.add.at(table, lc, lv * alpha[lr])
    return table.astype(np.float32), float(v[-1])


class Scorer:
    """Features of texts under a model; remembers words, at most ``keep`` of them."""

    def __init__(self, model: Model, keep: int = 300_000):
        self.model, self.keep, self.known = model, keep, {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) + len(tokens) > self.keep:
            self.known.clear()
        new = [t for t in tokens if t not in self.known]
        cut, owner = [], []
        for i, t in enumerate(new):
            w = window(t)
            for x in pieces(w) if w else []:
                cut.append(x)
                owner.append(i)
        best = np.full(len(new), -2.0, np.float32)
        if cut:
            np.maximum.at(best, owner, decide_words(self.model.table, cut, self.model.params) + np.float32(self.model.bias))
        self.known.update(zip(new, best.tolist()))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: the largest, mean of three largest, share and number of positive windows."""
        out = np.zeros((len(texts), 4))
        for lo in range(0, len(texts), 128):
            split = []
            for t in texts[lo : lo + 128]:
                low = (t or "").lower()
                toks = low.split()
                if len(toks) > 3 and (found := _SPACED.findall(low)):
                    toks += ["".join(x.split()) for x in found]
                split.append(toks)
            self.learn(set().union(*split))
            get = self.known.__getitem__
            for i, toks in enumerate(split, lo):
                if not toks:
                    out[i] = (-2, -2, 0, 0)
                    continue
                d = np.fromiter(map(get, toks), np.float32, len(toks))
                top = np.sort(np.partition(d, -3)[-3:] if len(d) > 3 else d)
                n = int((d > 0).sum())
                out[i] = (top[-1], top.mean(), np.log1p(100 * n / len(d)), np.log1p(n))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        if m.table is None:
            return np.full(len(texts), m.prior)
        return 1 / (1 + np.exp(-np.clip(np.c_[self.features(texts), np.ones(len(texts))] @ m.link, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression with classes weighted alike (the last column is the constant)."""
    w = np.where(y > 0, 0.5 * len(y) / max(1, (y > 0).sum()), 0.5 * len(y) / max(1, (y == 0).sum()))
    b = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, x.T @ (w * (y - q)) - pull * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def hardest(spark: SparkSession, words: DataFrame, model: Model) -> DataFrame:
    """``word, d``: the decision of each distinct window, largest first."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            ws = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(decide_words(m.table, ws, m.params).astype(float) + m.bias)], ["word", "d"])

    return words.mapInArrow(run, "word string, d double").orderBy(F.desc("d"), "word")


def witnesses(spark: SparkSession, docs: DataFrame, model: Model, keep: int = 300_000) -> DataFrame:
    """``word, y, n, d``: the windows that stand for the sentences of labelled documents, the number of
    documents (``y`` 1) or sentences (``y`` 0) they stand for, and their decision."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m, known = shared.value, {}
        for b in batches:
            words, ys, ds = [], [], []
            texts, labels = b.column("text").to_pylist(), b.column("y").to_pylist()
            for lo in range(0, len(texts), 128):
                slab = [sentences(t) for t in texts[lo : lo + 128]]
                if len(known) > keep:
                    known.clear()
                new = list({w for bags in slab for bag in bags for w in bag if w not in known})
                known.update(zip(new, (decide_words(m.table, new, m.params).astype(float) + m.bias).tolist()))
                for bags, y in zip(slab, labels[lo:]):
                    best = [max(bag, key=lambda w: (known[w], w)) for bag in bags]
                    if y and best:
                        best = list({w for w in best if known[w] > 0} or {max(best, key=lambda w: (known[w], w))})
                    words += best
                    ys += [y] * len(best)
                    ds += [known[w] for w in best]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ys, pa.int32()), pa.array(ds, pa.float64())], ["word", "y", "d"])

    return docs.select("text", "y").mapInArrow(run, "word string, y int, d double").groupBy("word", "y").agg(F.count("*").alias("n"), F.max("d").alias("d"))


def explaining(docs: DataFrame, candidates: dict[str, int]) -> list[tuple[str, int]]:
    """The candidate windows that explain toxic documents, with the documents they were seen in.

    All words of a toxic text that has many copies look toxic.  So, commonest first, a window counts
    if it stands in three documents that none before it explains, or if no single window before
    it accompanies it in four of five documents, which copies of a text would.
    """
    names = list(candidates)
    at = {w: i for i, w in enumerate(names)}

    def hits(batches):
        for b in batches:
            out = [sorted({at[x] for w in map(window, t.lower().split()) if w for x in pieces(w) if x in at}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["hits"])

    rows = docs.where("y = 1").select("text").mapInArrow(hits, "hits array<int>").collect()  # at most max_docs rows
    seen: list[set[int]] = [set() for _ in names]
    for k, r in enumerate(rows):
        for i in r["hits"]:
            seen[i].add(k)
    explained: set[int] = set()
    kept: list[int] = []
    for i in sorted(range(len(names)), key=lambda i: (-len(seen[i]), names[i])):
        mine = seen[i]
        if not mine:
            continue
        if len(mine - explained) >= 3 or max((len(mine & seen[j]) for j in kept), default=0) < 0.8 * len(mine):
            kept.append(i)
            explained |= mine
    return [(names[i], len(seen[i])) for i in kept]


def training_ids(labels: DataFrame, column: str, trainable, p: Params) -> DataFrame:
    """At most ``max_docs`` labelled ids of each class, chosen by hash: (doc_id, y)."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & trainable).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.max_docs) for y in (0, 1)]
    return parts[0].union(parts[1])


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, trainable, column: str = "toxic", p: Params = Params()) -> Model:
    """Train on the rows of ``labels`` for which the column expression ``trainable`` holds."""
    ids = [(r["doc_id"], r["y"]) for r in training_ids(labels, column, trainable, p).collect()]  # at most 2 * max_docs
    n = [sum(1 for _, y in ids if y == k) for k in (0, 1)]
    model = Model(p, prior=n[1] / max(1, sum(n)))
    if not all(n):
        return model
    chosen = spark.createDataFrame(ids, "doc_id long, y int")
    ws = Workspace(spark, "toxicity")
    found = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    # one text an id, so that at most 2 * max_docs rows are left; the passes below read these alone
    docs = ws.table(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).repartition(_PARTS, "doc_id"), "labelled")

    def windows(batches):
        for b in batches:
            words, ys = [], []
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                seen = set().union(*sentences(text))
                words += seen
                ys += [y] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ys, pa.int32())], ["word", "y"])

    counts = docs.mapInArrow(windows, "word string, y int").groupBy("word").agg(F.sum("y").alias("pos"), F.sum(F.lit(1) - F.col("y")).alias("neg"))
    odds = (F.col("pos") + 0.1) / n[1] / ((F.col("neg") + 0.1) / n[0])
    share = n[1] / sum(n)
    # How unlikely so one-sided a word is, were it as common in both classes.  Copies of a document are
    # no independent witnesses, hence the wide margin; few toxic documents can give but little evidence.
    evidence = F.col("pos") * float(np.log(1 / share)) + F.col("neg") * float(np.log(1 / (1 - share)))
    counts = ws.table(counts.withColumn("odds", odds).withColumn("evidence", evidence), "windows")
    toxic = counts.where((F.col("neg") * n[1] * 200 <= F.col("pos") * n[0]) & (F.col("evidence") > min(p.evidence, 0.2 * n[1] * float(np.log(1 / share))))).orderBy(F.desc("evidence"), "word").limit(p.max_words)
    clean = counts.where((F.col("odds") < 2.0) & (F.col("neg") > 0))
    common = clean.orderBy(F.desc("neg"), "word").limit(p.max_words // 4)
    other = clean.orderBy(F.xxhash64("word"), "word").limit(p.max_words * 3 // 4)
    positive = explaining(docs, {r["word"]: r["pos"] for r in toxic.select("word", "pos").collect()})
    negative = list(dict.fromkeys(r["word"] for r in common.select("word").union(other.select("word")).collect()))
    if positive and negative:
        words, seen_in = [w for w, _ in positive], np.array([k for _, k in positive], float)
        model.table, model.bias = train_words(words, seen_in, negative, [], p)
        # the clean windows that come closest to toxic ones join the negatives
        close = [r["word"] for r in hardest(spark, clean.select("word"), model).limit(p.max_words // 3).collect() if r["d"] > -0.9]
        negative = list(dict.fromkeys(negative + close))
        model.table, model.bias = train_words(words, seen_in, negative, close, p)
        one_sided = counts.where(F.col("neg") * n[1] * p.odds <= F.col("pos") * n[0]).select("word")
        for _ in range(p.rounds):
            stand = ws.table(witnesses(spark, docs, model), "witnesses")
            high = stand.where((F.col("y") == 1) & (F.col("d") > p.floor)).join(one_sided, "word", "left_semi").orderBy(F.desc("n"), "word").limit(p.max_words).collect()
            low = stand.where("y = 0").orderBy(F.desc("d"), "word").limit(p.max_words // 3).select("word").collect()
            if not high:
                break
            words, seen_in = [r["word"] for r in high], np.array([r["n"] for r in high], float)
            chosen_words = set(words)
            close = [w for w in (r["word"] for r in low) if w not in chosen_words]
            negative = [w for w in dict.fromkeys(negative + close) if w not in chosen_words]
            model.table, model.bias = train_words(words, seen_in, negative, close, p)
    if model.table is None:
        ws.drop(ws.root)
        return model

    shared = spark.sparkContext.broadcast(model)  # one table of 64**3 floats

    def measure(batches):
        s = Scorer(shared.value)
        for b in batches:
            x = s.features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("y"), *(pa.array(x[:, i]) for i in range(4))], ["y", "a", "b", "c", "d"])

    rows = np.array(docs.mapInArrow(measure, "y int, a double, b double, c double, d double").collect(), float).reshape(-1, 5)
    ws.drop(ws.root)
    model.link = logistic(np.c_[rows[:, 1:], np.ones(len(rows))], rows[:, 0])
    return model


def score(spark: SparkSession, documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``documents``."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        s = Scorer(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, ARROW_ROWS):
                part = b.slice(lo, ARROW_ROWS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s.scores(part.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(spark: SparkSession, documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``documents``, all columns, that score below ``threshold``."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        s = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array(s.scores(b.column(text_at).to_pylist()) < threshold))

    text_at = documents.columns.index("text")
    return documents.mapInArrow(run, documents.schema)
