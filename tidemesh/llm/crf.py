"""Document quality by a linear-chain conditional random field over lines.

The chain labels every line good or bad from features of the line and its neighbours. Forward-backward gives each
line's marginal; a document's score is their mean, weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.llm.common import small_batches, table
from tidemesh.llm.divergence import WORDS

#: The chain is fitted on at most SAMPLE labelled documents, on all lines of each, in runs of RUN lines.
SAMPLE, RUN = 3000, 64
BINS = 8
_COMMON = frozenset(WORDS)
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "mark": b"#*$%&<>@^_~=+\\/{}[]", "bar": b"|", "bang": b"!?", "point": b".,;:'\"()-", "space": b" \t\v\f\r"}
_TABLES = {k: np.isin(np.arange(256), list(v)).astype(np.uint8) for k, v in _KINDS.items()}
FEATURES = (*_KINDS, "chars", "word_chars", "fresh", "common", "short", "again", "ends", "opens", "long_word")


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, line lengths in characters plus one) of a whole text."""
    lines = text.split("\n")
    data = np.frombuffer(text.encode(), np.uint8)
    cuts = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], cuts + 1])
    size = np.diff(np.concatenate([starts, [len(data) + 1]])) - 1
    out = np.zeros((len(lines), len(FEATURES)), np.float32)
    some = np.maximum(size, 1)
    for j, table_ in enumerate(_TABLES.values()):
        sums = np.concatenate([[0], np.cumsum(table_[data], dtype=np.int64)])
        out[:, j] = (sums[starts + size] - sums[starts]) / some
    seen: set[str] = set()
    more = []
    for line in lines:
        words = line.split()
        n = len(words) or 1
        more.append((len(line), n, len(set(words)), sum(map(_COMMON.__contains__, words)), line in seen and bool(words), line[-1:] in ".!?", line[:1].isupper(), max(map(len, words), default=0)))
        seen.add(line)
    more = np.array(more, np.float32)
    n = more[:, 1]
    k = len(_KINDS)
    out[:, k] = np.log1p(more[:, 0])
    out[:, k + 1] = more[:, 0] / n
    out[:, k + 2] = more[:, 2] / n
    out[:, k + 3] = more[:, 3] / n
    out[:, k + 4] = n < 5
    out[:, k + 5 : k + 8] = more[:, 4:7]
    out[:, k + 8] = more[:, 7]
    return out, more[:, 0] + 1


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin numbers of every feature, each in its own range of numbers."""
    out = np.empty(x.shape, np.int32)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(edges[j], x[:, j], "left") + j * BINS
    return out


def with_neighbours(ids: np.ndarray, n_ids: int) -> np.ndarray:
    """A line's ids, with those of the line before and after it; the ends of a text have an id of their own."""
    edge = np.full((1, ids.shape[1]), n_ids, ids.dtype)
    before, after = np.concatenate([edge, ids[:-1]]), np.concatenate([ids[1:], edge])
    return np.hstack([ids, before + n_ids + 1, after + 2 * (n_ids + 1)])


def _step(logit: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The next line's log-odds from this one's: to[i, j] weighs a step from state i to j."""
    return np.logaddexp(to[1, 1] + logit, to[0, 1]) - np.logaddexp(to[1, 0] + logit, to[0, 0])


def marginals(scores: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, forward, backward) log-odds of state 1; scores is sequences x lines, rows in falling length."""
    n, most = scores.shape
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    live = np.searchsorted(-lengths, -np.arange(1, most + 1), "right")  # rows of so many lines at least
    if most:
        ahead[:, 0] = scores[:, 0]
    for t in range(1, most):
        k = live[t]
        ahead[:k, t] = scores[:k, t] + _step(ahead[:k, t - 1], to)
    for t in range(most - 2, -1, -1):
        k = live[t + 1]
        back[:k, t] = _step(scores[:k, t + 1] + back[:k, t + 1], to.T)
    return ahead + back, ahead, back


class Chain:
    """Weights of line features (summed per line) and of steps between line labels."""

    def __init__(self, edges: np.ndarray):
        self.edges, self.n_ids = edges, edges.shape[0] * BINS
        self.weights, self.bias, self.to = np.zeros(3 * (self.n_ids + 1)), 0.0, np.zeros((2, 2))

    def ids(self, x: np.ndarray) -> np.ndarray:
        return with_neighbours(binned(x, self.edges), self.n_ids)

    def fit(self, runs: list[tuple[np.ndarray, int]], rounds: int = 120, rate: float = 0.08, ridge: float = 1e-3) -> None:
        """Full-batch Adam on the mean log-likelihood of runs (ids, label), each line labelled as its document."""
        runs = sorted(runs, key=lambda r: -len(r[0]))
        lengths = np.array([len(r[0]) for r in runs])
        most = int(lengths.max())
        where = np.concatenate([np.arange(n) + i * most for i, n in enumerate(lengths)])
        ids = np.concatenate([r[0] for r in runs])
        y = np.repeat([float(r[1]) for r in runs], lengths)
        row_y = np.array([float(r[1]) for r in runs])
        steps = (lengths - 1).astype(float)
        gold = np.array([[((1 - row_y) * steps).sum(), 0.0], [0.0, (row_y * steps).sum()]])
        inside = np.arange(most)[None, 1:] < lengths[:, None]
        state = [np.zeros(len(self.weights) + 5), np.zeros(len(self.weights) + 5)]
        flat = ids.ravel()
        for k in range(1, rounds + 1):
            scores = np.zeros(len(runs) * most)
            scores[where] = self.weights[ids].sum(1) + self.bias
            scores = scores.reshape(len(runs), most)
            post, ahead, back = marginals(scores, lengths, self.to)
            error = y - 1 / (1 + np.exp(-post.ravel()[where]))
            # pair posteriors: forward odds of the line, the step, score and backward odds of the next line
            left, right = ahead[:, :-1], scores[:, 1:] + back[:, 1:]
            joint = np.stack([self.to[i, j] + i * left + j * right for i in (0, 1) for j in (0, 1)])
            joint = np.exp(joint - joint.max(0))
            joint = (joint / joint.sum(0) * inside).sum((1, 2)).reshape(2, 2)
            slope = np.concatenate([np.bincount(flat, np.repeat(error, ids.shape[1]), len(self.weights)), [error.sum()], (gold - joint).ravel()]) / len(y)
            slope -= ridge * np.concatenate([self.weights, [0.0], self.to.ravel()])
            state[0] = 0.9 * state[0] + 0.1 * slope
            state[1] = 0.99 * state[1] + 0.01 * slope**2
            move = rate * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8)
            self.weights += move[:-5]
            self.bias += move[-5]
            self.to += move[-4:].reshape(2, 2)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean marginal of each whole text; 0 for null and empty texts."""
        out, rows = np.zeros(len(texts)), []
        for i, text in enumerate(texts):
            if text:
                x, size = line_features(text)
                rows.append((i, self.weights[self.ids(x)].sum(1) + self.bias, size))
        rows.sort(key=lambda r: -len(r[1]))
        at = 0
        while at < len(rows):  # texts of about as many lines go together, so that little is padded
            most = len(rows[at][1])
            part = rows[at : at + max(16, 200_000 // most)]
            at += len(part)
            lengths = np.array([len(r[1]) for r in part])
            scores = np.zeros((len(part), most))
            for row, r in zip(scores, part, strict=True):
                row[: len(r[1])] = r[1]
            post = marginals(scores, lengths, self.to)[0]
            for row, (i, s, size) in zip(post, part, strict=True):
                p = 1 / (1 + np.exp(-np.clip(row[: len(s)], -60, 60)))
                out[i] = (p * size).sum() / size.sum()
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and y of at most `most` labelled documents, the first by hash of doc_id, one row each.

    The labels' rows are few enough to be broadcast: `most` at most. A doc_id labelled twice takes the larger label, one
    with several texts the least of them.
    """
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return joined.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Chain:
    """A chain fitted on a bounded sample; without labelled documents, one that scores every line 0.5."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = [line_features(text or "")[0].tobytes() for text in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": lines})

    found = labelled_sample(docs, labels, label, sample).mapInPandas(run, "doc_id long, y int, x binary").collect()
    found.sort(key=lambda r: r["doc_id"])
    parts = [(np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, len(FEATURES)), r["y"]) for r in found]
    every = np.concatenate([x for x, _ in parts]) if parts else np.zeros((1, len(FEATURES)), np.float32)
    chain = Chain(np.stack([np.quantile(np.unique(c), np.linspace(0, 1, BINS + 1)[1:-1]) for c in every.T]))
    if parts:
        chain.fit([(ids[k : k + RUN], y) for ids, y in ((chain.ids(x), y) for x, y in parts) for k in range(0, len(ids), RUN)])
    return chain


def score_documents(docs: DataFrame, chain: Chain, *carry: str) -> DataFrame:
    """doc_id, the columns of carry and score of every row.

    Null and empty texts score 0. Repeated rows stay rows of their own; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(shared.value.scores(list(part)))

    return docs.select("doc_id", *carry, score("text").alias("score"))


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; nulls, ties and empty tables as at fit and score_documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    chain = fit(docs, labels.where(part != 1))
    scored = score_documents(docs, chain)
    return scored.select("doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
