"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a learned vector of its hash, the mean of learned vectors of its character trigrams, and the log-odds
of the word and of its strongest run of GRAM bytes in the training sample. Trigrams and runs are those of the whole
word, however long it is. Windows of WINDOW words, each overlapping
the next by half, are scored; a document takes its highest window.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.llm.common import small_batches, table

WINDOW, STRIDE = 32, 16
#: Trained on at most PER_CLASS labelled documents of each label, on all windows of each.
PER_CLASS = 1500
WORD_ROWS, CHAR_ROWS, GRAM_ROWS, DIM, HIDDEN, WIDE, GRAM = 1 << 16, 1 << 11, 1 << 18, 6, 8, 20, 6
REMEMBERED, FOLDS, OFTEN = 150_000, 4, 20
#: Bytes from piece to piece of a long word, so that each run of GRAM bytes is in one; pieces that are worked on at once.
STEP, LOT = WIDE - GRAM + 1, 20_000


class Keys:
    """Words as rows: row is a word's own; chars, mask and runs are those of its pieces of WIDE bytes, first to the next first."""

    def __init__(self, row: np.ndarray, first: np.ndarray, chars: np.ndarray, mask: np.ndarray, runs: np.ndarray):
        self.row, self.first, self.chars, self.mask, self.runs = row, first, chars, mask, runs
        self.n = np.maximum(np.add.reduceat(mask.sum(1), first[:-1]) if len(row) else np.zeros(0, np.int64), 1)[:, None]

    def take(self, words: np.ndarray) -> Keys:
        many = np.diff(self.first)[words]
        first = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(self.first[words] - first[:-1], many) + np.arange(first[-1])
        return Keys(self.row[words], first, self.chars[at], self.mask[at], self.runs[at])

    def owner(self) -> np.ndarray:
        """The word of each piece."""
        return np.repeat(np.arange(len(self.row)), np.diff(self.first))

    def strongest(self, odds: np.ndarray) -> np.ndarray:
        """The largest of the odds of each word's runs."""
        return np.maximum.reduceat(odds[self.runs].max(1), self.first[:-1]) if len(self.row) else np.zeros(0, odds.dtype)


def word_keys(words: list[str]) -> Keys:
    """Keys of lower-cased words; rows 0 are kept for padding.

    A word that is longer than a piece goes into several, each STEP bytes on: every run and trigram is in one of them,
    and a trigram that two hold counts in the later one only.
    """
    plain = [w.encode() for w in words]
    row = np.fromiter((zlib.crc32(b) for b in plain), np.int64, len(plain)) % (WORD_ROWS - 1) + 1
    data = [b"^" + b + b"$" for b in plain]
    size = np.fromiter(map(len, data), np.int64, len(data))
    many = 1 + np.maximum(0, -((WIDE - size) // STEP))
    first = np.concatenate([[0], np.cumsum(many)])
    if len(data) < first[-1]:
        data = [b[k : k + WIDE] for b, n in zip(data, many.tolist(), strict=True) for k in range(0, n * STEP, STEP)]
    last = np.zeros(len(data), bool)
    last[first[1:] - 1] = True
    chars, mask, runs = np.zeros((len(data), WIDE - 2), np.int32), np.zeros((len(data), WIDE - 2), bool), np.zeros((len(data), STEP), np.int32)
    for at in range(0, len(data), LOT):
        some = data[at : at + LOT]
        wide = np.array(some, f"S{WIDE}").view(np.uint8).reshape(len(some), WIDE).astype(np.uint32)
        three = (wide[:, :-2] * np.uint32(961) + wide[:, 1:-1] * np.uint32(31) + wide[:, 2:]) * np.uint32(2654435761)
        own = (wide[:, 2:] > 0) & (last[at : at + LOT, None] | (np.arange(WIDE - 2) < STEP))
        run = np.zeros((len(some), STEP), np.int64)
        for k in range(GRAM):  # the sums of GRAM bytes fit in a long, so one remainder does
            run *= 257
            run += wide[:, k : STEP + k]
        run %= 2147483647
        run *= 40503
        run %= GRAM_ROWS - 1
        chars[at : at + LOT], mask[at : at + LOT] = np.where(own, three % np.uint32(CHAR_ROWS - 1) + 1, 0), own
        runs[at : at + LOT] = np.where(wide[:, GRAM - 1 :] > 0, run + 1, 0)
    return Keys(row, first, chars, mask, runs)


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def window_starts(n: int) -> np.ndarray:
    """Starts of all windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW, STRIDE)
    return np.append(starts, n - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, forward pass and gradients; both directions are computed together, on a leading axis of two."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda *shape, scale=0.3: (rng.normal(size=shape) * scale).astype(np.float32)
        size = 2 * DIM + 3
        self.odds, self.run_odds = np.zeros(WORD_ROWS, np.float32), np.zeros(GRAM_ROWS, np.float32)
        self.known = np.zeros(WORD_ROWS, bool)  # words of OFTEN training documents have a vector of their own
        self.p = {"word": init(WORD_ROWS, DIM, scale=0.05), "char": init(CHAR_ROWS, DIM, scale=0.1), "W": init(2, size, 3 * HIDDEN), "b": init(2, 1, 3 * HIDDEN, scale=0.01), "U": init(2, HIDDEN, 3 * HIDDEN), "a": init(2 * HIDDEN), "w": init(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        self.scale, self.held = (1.0, 0.0), None

    def scorer(self) -> Scorer:
        """The scorer of a Python worker, whose words stay remembered from task to task."""
        self.held = self.held or Scorer(self)
        return self.held

    def inputs(self, keys: Keys, odds: np.ndarray | None = None) -> np.ndarray:
        """The input vectors of words; odds, if given, has two other log-odds of each word."""
        x = np.empty((len(keys.row), 2 * DIM + 3), np.float32)
        x[:, :DIM] = self.p["word"][np.where(self.known[keys.row], keys.row, 0)]
        lots = [(self.p["char"][keys.chars[at : at + LOT]] * keys.mask[at : at + LOT, :, None]).sum(1) for at in range(0, len(keys.chars), LOT)]
        x[:, DIM : 2 * DIM] = (np.add.reduceat(np.concatenate(lots), keys.first[:-1]) if lots else 0) / keys.n
        x[:, 2 * DIM] = self.odds[keys.row] if odds is None else odds[:, 0]
        x[:, 2 * DIM + 1] = np.minimum(keys.n[:, 0], 16) / 16
        x[:, 2 * DIM + 2] = keys.strongest(self.run_odds) if odds is None else odds[:, 1]
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        """Words x (2 * 3 * HIDDEN): what each direction's gates get from a word."""
        return np.concatenate([x @ self.p["W"][0] + self.p["b"][0], x @ self.p["W"][1] + self.p["b"][1]], 1)

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; g is windows x WINDOW x (2 * 3 * HIDDEN), mask windows x WINDOW (all true: None)."""
        n, T, _ = g.shape
        H, U = HIDDEN, self.p["U"]
        states = np.zeros((2, T + 1, n, H), np.float32)
        held = []
        for t in range(T):
            x = np.stack([g[:, t, : 3 * H], g[:, T - 1 - t, 3 * H :]])
            h = states[:, t]
            u = h @ U
            zr = _sigmoid(x[..., : 2 * H] + u[..., : 2 * H])
            z, r = zr[..., :H], zr[..., H:]
            c = np.tanh(x[..., 2 * H :] + r * u[..., 2 * H :])
            new = c + z * (h - c)
            if mask is not None:
                m = np.stack([mask[:, t], mask[:, T - 1 - t]])[..., None]
                new = np.where(m, new, h)
            states[:, t + 1] = new
            if keep:
                held.append((z, r, c, u))
        out = np.concatenate([states[0, 1:], states[1, :0:-1]], 2)  # WINDOW x windows x 2 * HIDDEN
        e = out @ self.p["a"]
        if mask is not None:
            e = np.where(mask.T, e, np.float32(-1e9))
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[..., None] * out).sum(0)
        logit = pooled @ self.p["w"] + self.p["c"][0]
        return (logit, states, held, out, alpha, pooled) if keep else logit

    def backward(self, x: np.ndarray, mask: np.ndarray, kept: tuple, d: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters after the word inputs, and of the inputs (windows x WINDOW x size)."""
        _, states, held, out, alpha, pooled = kept
        H, p = HIDDEN, self.p
        T = out.shape[0]
        grad = {"w": pooled.T @ d, "c": np.array([d.sum()])}
        dpool = d[:, None] * p["w"]
        dalpha = (out * dpool).sum(2)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        dout = alpha[..., None] * dpool + de[..., None] * p["a"]
        grad["a"] = (out * de[..., None]).sum((0, 1))
        dstates = np.stack([dout[..., :H], dout[::-1, :, H:]])
        grad |= {"W": np.zeros_like(p["W"]), "b": np.zeros_like(p["b"]), "U": np.zeros_like(p["U"])}
        dx, carry = np.zeros_like(x), np.zeros_like(states[:, 0])
        for t in range(T - 1, -1, -1):
            h, (z, r, c, u) = states[:, t], held[t]
            total = dstates[:, t] + carry
            m = np.stack([mask[:, t], mask[:, T - 1 - t]])[..., None]
            dh = total * m
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * u[..., 2 * H :] * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], 2)
            dg = np.concatenate([dz, dr, dc], 2)
            both = np.stack([x[:, t], x[:, T - 1 - t]])
            grad["U"] += h.transpose(0, 2, 1) @ du
            grad["W"] += both.transpose(0, 2, 1) @ dg
            grad["b"] += dg.sum(1, keepdims=True)
            dboth = dg @ p["W"].transpose(0, 2, 1)
            dx[:, t] += dboth[0]
            dx[:, T - 1 - t] += dboth[1]
            carry = dh * z + du @ p["U"].transpose(0, 2, 1) + total * (1 - m)
        return grad, dx


def train(docs: list[tuple[list[str], int]], rounds: int = 5, steps: int = 60, batch: int = 256, rate: float = 0.02, seed: int = 0) -> Network:
    """A network fitted on documents (words, label).

    Only some window of a toxic document need be toxic: in each round its highest window counts, against windows of
    other documents, a half of them those that score highest. A training document sees the log-odds of the other
    folds only, as a new document would. At last a logistic fit turns a document's highest logit into a probability.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array([d[1] for d in docs])
    if not len(docs) or y.min() == y.max():
        net.scale = (0.0, 4.0 if len(docs) and y.min() else -4.0)
        return net
    vocabulary: dict[str, int] = {}
    texts = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for words, _ in docs]
    keys = word_keys(list(vocabulary))
    row = keys.row
    often = np.zeros(WORD_ROWS, int)
    fold = np.zeros(len(docs), int)
    for f in (0, 1):
        fold[y == f] = np.arange((y == f).sum()) % FOLDS

    for ids in texts:
        often[np.unique(row[ids])] += 1
    net.known = often >= OFTEN

    def odds(rows_of: Callable[[np.ndarray], np.ndarray], rows: int) -> list[np.ndarray]:
        """Log-odds without each fold in turn, and with all."""
        seen, n = np.zeros((FOLDS, 2, rows), np.int32), np.zeros((FOLDS, 2))
        for ids, label, f in zip(texts, y, fold, strict=True):
            seen[f, label, np.unique(rows_of(np.unique(ids)))] += 1
            n[f, label] += 1
        out = []
        for f in range(FOLDS + 1):
            s, m = (seen.sum(0), n.sum(0)) if f == FOLDS else (seen.sum(0) - seen[f], n.sum(0) - n[f])
            o = np.clip(np.log((s[1] + 1) / (m[1] + 2)) - np.log((s[0] + 1) / (m[0] + 2)), -4, 4).astype(np.float32)
            o[s.sum(0) < 3] = 0  # what so few documents have says nothing
            o[0] = 0
            out.append(o)
        return out

    word_odds, run_odds = odds(row.__getitem__, WORD_ROWS), odds(lambda ids: keys.take(ids).runs, GRAM_ROWS)
    net.odds, net.run_odds = word_odds[FOLDS], run_odds[FOLDS]
    seen_odds = np.stack([np.stack([word_odds[f][row], keys.strongest(run_odds[f])], 1) for f in range(FOLDS)], 1)  # words x FOLDS x 2
    windows, masks, owner = [], [], []
    for i, ids in enumerate(texts):
        at = window_starts(len(ids))[:, None] + np.arange(WINDOW)
        padded = np.append(ids, np.zeros(WINDOW, np.int64))
        windows.append(np.where(at < len(ids), padded[at], 0) * FOLDS + fold[i])  # a word as its document's fold sees it
        masks.append(at < len(ids))
        owner.append(np.full(len(at), i))
    windows, masks, owner = np.concatenate(windows), np.concatenate(masks), np.concatenate(owner)
    masks[:, 0] |= ~masks.any(1)
    toxic = y[owner] == 1
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    k = 0

    def given(ids: np.ndarray) -> np.ndarray:
        w = ids // FOLDS
        return net.inputs(keys.take(w), seen_odds[w, ids % FOLDS])

    def score() -> np.ndarray:
        out = []
        for part in np.array_split(np.arange(len(windows)), max(1, len(windows) // 4096)):
            used, at = np.unique(windows[part], return_inverse=True)
            out.append(net.forward(net.project(given(used))[at.reshape(len(part), WINDOW)], masks[part]))
        return np.concatenate(out)

    first = seen_odds.sum(2).ravel()
    rank = np.where(masks, first[windows], -9).max(1) + 0.1 * np.where(masks, first[windows], 0).sum(1) / WINDOW
    clean = np.flatnonzero(~toxic)
    for _ in range(rounds):
        order = np.lexsort((rank, owner))
        top = order[np.append(owner[order][1:] != owner[order][:-1], True)]  # each document's highest window
        positive = top[toxic[top]]
        hard = clean[np.argsort(-rank[clean], kind="stable")[: max(len(positive), 200)]]
        for _ in range(steps):
            half = batch // 2
            pick = np.concatenate([rng.choice(positive, half), rng.choice(hard, half // 2), rng.choice(clean, half - half // 2)])
            ids, m = windows[pick], masks[pick]
            used, at = np.unique(ids, return_inverse=True)
            at = at.reshape(ids.shape)
            xs = given(used)
            w = used // FOLDS
            x = xs[at]
            kept = net.forward(net.project(xs)[at], m, keep=True)
            d = ((_sigmoid(kept[0]) - toxic[pick]) / len(pick)).astype(np.float32)
            grad, dx = net.backward(x, m, kept, d)
            flat, dxs = at.ravel(), np.zeros((len(used), x.shape[2]), np.float32)
            np.add.at(dxs, flat, dx.reshape(-1, x.shape[2]))
            grad["word"] = np.zeros_like(net.p["word"])
            np.add.at(grad["word"], np.where(net.known[row[w]], row[w], 0), dxs[:, :DIM])
            grad["char"] = np.zeros_like(net.p["char"])
            taken = keys.take(w)
            part = (dxs[:, DIM : 2 * DIM] / taken.n)[taken.owner()][:, None] * taken.mask[..., None]
            np.add.at(grad["char"], taken.chars.ravel(), part.reshape(-1, DIM))
            k += 1
            for name, v in net.p.items():
                a, b = moment[name]
                a *= 0.9
                a += 0.1 * grad[name]
                b *= 0.99
                b += 0.01 * grad[name] ** 2
                v -= (rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
        rank = score()
    best = np.full(len(docs), -np.inf)
    np.maximum.at(best, owner, rank)
    net.scale = _logistic(best, y)
    return net


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit, by Newton's steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.05 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -2, 2)
    return float(max(a, 0.05)), float(b)


class Scorer:
    """Scores whole texts in a task; the gates' inputs of the words met are remembered, REMEMBERED or those of one lot at most."""

    def __init__(self, net: Network):
        self.net, self.rows = net, {}
        halves = np.array([0.5, 0.5, 1.0], np.float32)  # a gate is (1 + tanh(x / 2)) / 2
        self.scale = np.repeat(np.tile(halves, 2), HIDDEN)
        self.U = np.stack([net.p["U"][:, :, k * HIDDEN : (k + 1) * HIDDEN] * halves[k] for k in range(3)])
        self.table = np.zeros((3, 2, REMEMBERED + 1, HIDDEN), np.float32)  # gate, direction, word, unit; row 0 is padding

    def ids(self, words: list[str]) -> np.ndarray:
        """Rows of the table; words not met yet are added, all at once."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.rows]
        if len(self.rows) + len(fresh) >= self.table.shape[2]:
            self.rows.clear()
            fresh = list(dict.fromkeys(words))
            if len(fresh) >= self.table.shape[2]:
                self.table = np.zeros((3, 2, len(fresh) + 1, HIDDEN), np.float32)
        if fresh:
            ends = np.cumsum([len(w) + 10 for w in fresh])  # characters bound what is worked on at once
            for a, b in pairwise([0, *np.unique(np.searchsorted(ends, np.arange(20 * LOT, ends[-1], 20 * LOT), "right") + 1), len(fresh)]):
                some = fresh[a:b]
                first = len(self.rows) + 1
                got = self.net.project(self.net.inputs(word_keys(some))) * self.scale
                self.table[:, :, first : first + len(some)] = got.reshape(-1, 2, 3, HIDDEN).transpose(2, 1, 0, 3)
                self.rows.update(zip(some, range(first, first + len(some)), strict=True))
        return np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """What Network.forward gives for windows of rows; 0 pads a window at its end."""
        n, T = windows.shape
        H, columns = HIDDEN, np.ascontiguousarray(windows.T)
        mask = columns > 0 if not columns.all() else None
        x, u, h = np.empty((3, 2, n, H), np.float32), np.empty((3, 2, n, H), np.float32), np.zeros((2, n, H), np.float32)
        out = np.empty((T, 2, n, H), np.float32)
        for t in range(T):
            for k in range(3):
                np.take(self.table[k, 0], columns[t], 0, x[k, 0], "clip")
                np.take(self.table[k, 1], columns[T - 1 - t], 0, x[k, 1], "clip")
            np.matmul(h, self.U, u)
            x[:2] += u[:2]
            np.tanh(x[:2], x[:2])
            x[:2] *= 0.5
            x[:2] += 0.5
            c = x[2]
            u[2] *= x[1]
            c += u[2]
            np.tanh(c, c)
            new = h - c
            new *= x[0]
            new += c
            if mask is not None:
                new = np.where(np.stack([mask[t], mask[T - 1 - t]])[..., None], new, h)
            h = new
            out[t, 0], out[T - 1 - t, 1] = h[0], h[1]
        a, w = self.net.p["a"], self.net.p["w"]
        e = out[:, 0] @ a[:H] + out[:, 1] @ a[H:]
        if mask is not None:
            e = np.where(mask, e, np.float32(-1e9))
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        return (e * (out[:, 0] @ w[:H] + out[:, 1] @ w[H:])).sum(0) + self.net.p["c"][0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The highest window of each whole text as a probability; texts meet in lots, long ones in several of them."""
        best = np.full(len(texts), -np.inf)
        words, windows, owner = [], [], []

        def run() -> None:
            ids = np.append(self.ids(words), np.zeros(WINDOW, np.int32))
            starts, of = np.concatenate(windows), np.concatenate(owner)
            for a in range(0, len(starts), 1024):
                at = starts[a : a + 1024, 0, None] + np.arange(WINDOW)
                rows = np.where(np.arange(WINDOW) < starts[a : a + 1024, 1, None], ids[np.minimum(at, len(ids) - 1)], 0)
                np.maximum.at(best, of[a : a + 1024], self.logits(rows))
            words.clear()
            windows.clear()
            owner.clear()

        for i, text in enumerate(texts):
            own = split_words(text)
            starts = window_starts(len(own))
            for a in range(0, len(starts) if own else 0, LOT // STRIDE):  # all windows of the whole text, so many at a time
                part = starts[a : a + LOT // STRIDE]
                windows.append(np.stack([part - part[0] + len(words), np.minimum(len(own) - part, WINDOW)], 1))
                owner.append(np.full(len(part), i))
                words += own[part[0] : part[-1] + WINDOW]
                if len(words) >= 2 * LOT:
                    run()
        if words:
            run()
        a, b = self.net.scale
        logit = np.where(np.isfinite(best), a * np.where(np.isfinite(best), best, 0) + b, -60)
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Network:
    """A network fitted on a bounded sample: the first per_class documents of each label by hash of doc_id.

    All windows of a training document count. A doc_id labelled twice takes the larger label, one with several texts
    the least of them; null labels don't count. Without documents of both labels the network gives one low or high score.
    """
    small_batches(docs.sparkSession)
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    some = some.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).union(some.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # 2 * per_class rows at most
    found = joined.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text")).orderBy("doc_id").collect()
    return train([(split_words(r["text"]), r["y"]) for r in found])


def score_documents(docs: DataFrame, net: Network, *carry: str) -> DataFrame:
    """doc_id, the columns of carry and score of every row: all windows of the whole text.

    Null and empty texts score (almost) 0. Repeated rows stay rows of their own; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value.scorer()
        for part in texts:
            yield pd.Series(scorer.scores(list(part)))

    return docs.select("doc_id", *carry, score("text").alias("score"))


def op8_window_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; nulls, ties and empty tables as at fit and score_documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    net = fit(docs, labels.where(part != 2))
    scored = score_documents(docs, net)
    return scored.select("doc_id", (part == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
