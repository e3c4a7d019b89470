"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of five-word shingles. Consistent weighted samples, whose agreement has the probability of
the weighted Jaccard similarity, are banded into buckets; pairs that share a bucket are verified by exact weighted
Jaccard similarity, and links make classes. Equal texts are one node throughout.

A shingle weighs its count times 1 + ln(p) / ln(floor), p being its share of all documents or floor if that is more:
1 where every document has it, 2 where few do. Only shingles above the floor need a count of their own, and those are
HEAVY at most, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.llm.common import saved, scratch, small_batches, table

WORDS, SIMILAR = 5, 0.8
SAMPLES, ROWS = 64, 4
#: A pair whose smaller weight is less than this share of the larger can't be SIMILAR (with room for rounding).
COMPARABLE = SIMILAR - 1e-6
SKETCH, FLOOR, HEAVY = 1 << 20, 1 / 1000, 1 << 19
#: Rounds that compare each node with one other of its buckets; members of a bucket that are compared pair by pair in
#: one join, larger buckets going in blocks of BLOCK; members of a class that one join pairs with a node.
STARS, SMALL, BLOCK, FEW, SALT = 2, 32, 512, 4, 128

_P, _P_INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, 0 to n - 1 at least."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, p in enumerate((_P, _P_INVERSE)):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, text numbers): the distinct shingles of each of at most 256 texts, by text and hash.

    Words are cut at ASCII white space. A text of fewer than WORDS words has one shingle of all, one without words
    none. Hashes have 56 bits.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    end = end[1:] if len(end) > len(begin) else end
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    word = mixed((sums[end] - sums[begin]) * inverse[begin])
    stops = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(stops, begin, "right")
    n = np.bincount(of, minlength=len(texts))
    hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(word) >= WORDS:
        at = np.flatnonzero(of[WORDS - 1 :] == of[: len(of) - WORDS + 1])
        hashes, owner = word[at].copy(), of[at]
        for k in range(1, WORDS):
            hashes = hashes * np.uint64(0x100000001B3) + word[at + k]
    first = np.concatenate([[0], np.cumsum(n)])
    few = np.flatnonzero((n > 0) & (n < WORDS))
    if len(few):
        joint = np.zeros(len(few), np.uint64)
        for k in range(WORDS):
            joint = joint * np.uint64(0x100000001B3) + np.where(k < n[few], word[np.minimum(first[few] + k, len(word) - 1)], np.uint64(0))
        hashes, owner = np.concatenate([hashes, joint]), np.concatenate([owner, few])
    keys = np.sort((owner.astype(np.uint64) << np.uint64(56)) | (mixed(hashes) >> np.uint64(8)))
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([fresh, [len(keys)]]))
    keys = keys[fresh]
    return keys & np.uint64((1 << 56) - 1), counts, (keys >> np.uint64(56)).astype(np.int64)


def _batches(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first number, texts as UTF-8), at most 256 texts and about 4 MB in one."""
    some: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        some.append((text or "").encode())
        size += len(some[-1])
        if len(some) == 256 or size > 4_000_000:
            yield i + 1 - len(some), some
            some, size = [], 0
    if some:
        yield len(texts) - len(some), some


class Weights:
    """Shingle weights: hashes above the floor with theirs, all others weigh 2."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, documents: int, floor: float):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        share = np.maximum(counts[order] / max(documents, 1), floor)
        self.values = 1 + np.log(np.minimum(share, 1)) / math.log(floor)
        self.held = np.zeros(SKETCH, bool)
        self.held[(self.hashes % np.uint64(SKETCH)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), 2.0)
        some = np.flatnonzero(self.held[(hashes % np.uint64(SKETCH)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes[some]
            out[some[hit]] = self.values[at[hit]]
        return out * counts


def corpus_weights(docs: DataFrame) -> Weights:
    """Document frequencies over all documents, in two passes.

    The first counts shingles by SKETCH buckets; the second counts exactly those in buckets above the floor. Sums go
    through Spark; to the driver come the heavy buckets (SKETCH at most) and shingles (HEAVY at most, as the floor
    rises with the shingles of a document).
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = np.zeros(SKETCH, np.int64), 0
        for pdf in batches:
            n += len(pdf)
            for _, some in _batches(list(pdf["text"])):
                counts += np.bincount((shingles(some)[0] % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        parts = counts.astype(np.int32).reshape(64, -1)
        yield pd.DataFrame({"part": range(64), "counts": [p.tobytes() for p in parts], "documents": [n] + [0] * 63})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in pdf["counts"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [counts.astype(np.int64).tobytes()], "documents": [pdf["documents"].sum()]})

    schema = "part int, counts binary, documents long"
    sums = saved(docs.select("text").mapInPandas(sketch, schema).groupBy("part").applyInPandas(total, schema), "sketch")
    documents, rows = 0, {}
    for r in sums.collect():  # SKETCH counts in all
        documents += r["documents"]
        rows[r["part"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    counts = np.concatenate([rows[p] for p in range(64)]) if rows else np.zeros(SKETCH, np.int64)
    floor = max(FLOOR, counts.sum() / max(documents, 1) / HEAVY)
    heavy = docs.sparkSession.sparkContext.broadcast(np.packbits(counts >= floor * documents))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, held, size = np.unpackbits(heavy.value).astype(bool), [], 0
        for pdf in batches:
            for _, some in _batches(list(pdf["text"])):
                h = shingles(some)[0]
                held.append(h[bits[(h % np.uint64(SKETCH)).astype(np.int64)]])
                size += len(held[-1])
            if size > 1_000_000:
                yield _counted(held)
                held, size = [], 0
        yield _counted(held)

    found = docs.select("text").mapInPandas(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= floor * documents).toPandas()
    return Weights(found["h"].to_numpy(np.int64).astype(np.uint64), found["n"].to_numpy(np.int64), documents, floor)


def _counted(held: list[np.ndarray]) -> pd.DataFrame:
    h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
    return pd.DataFrame({"h": h.astype(np.int64), "n": n})


class Sampler:
    """Improved consistent weighted sampling; the variates of a shingle and sample are looked up by its hash."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        grid = (rng.permutation(1 << 16) + 0.5) / (1 << 16)
        self.r = (-np.log(grid) - np.log((rng.permutation(1 << 16) + 0.5) / (1 << 16))).astype(np.float32)
        self.ln_c = np.log(-np.log(grid[rng.permutation(1 << 16)]) - np.log((rng.permutation(1 << 16) + 0.5) / (1 << 16))).astype(np.float32)

    def sample(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Texts x SAMPLES 32-bit samples; starts are the texts' first shingles."""
        ln_w = np.log(weights).astype(np.float32)
        low = np.uint64(0xFFFF)
        out = np.empty((len(starts), SAMPLES), np.uint32)
        for k in range(SAMPLES):
            u = hashes * self.factors[k]
            u ^= u >> np.uint64(31)
            u *= np.uint64(0x9E3779B97F4A7C15)
            r = self.r[(u >> np.uint64(48)).astype(np.intp)]
            ln_c = self.ln_c[((u >> np.uint64(32)) & low).astype(np.intp)]
            beta = ((u >> np.uint64(16)) & low).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(ln_w / r + beta)
            ln_a = ln_c - r * (t - beta + 1)
            order = ln_a.view(np.int32)
            order = (order ^ ((order >> 31) & 0x7FFFFFFF)).astype(np.int64) + (1 << 31)
            name = (u ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) & np.uint64(0xFFFFFFFF)
            out[:, k] = np.minimum.reduceat((order.astype(np.uint64) << np.uint64(32)) | name, starts) & np.uint64(0xFFFFFFFF)
        return out


@lru_cache(maxsize=1)
def one_sampler() -> Sampler:
    """The tables of a Python worker."""
    return Sampler()


def node_of(text: Column) -> Column:
    """A text's node: equal texts share it; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signatures(docs: DataFrame, weights: Broadcast) -> DataFrame:
    """node, doc_id (the least), sig, bands and mass (the sum of its weights) of every distinct text.

    Texts without words have none of the last three.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, weigh = one_sampler(), weights.value
        bands = SAMPLES // ROWS
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for pdf in batches:
            sigs, keys, masses = [None] * len(pdf), [None] * len(pdf), np.full(len(pdf), np.nan)
            for first, some in _batches(list(pdf["text"])):
                h, n, of = shingles(some)
                if not len(h):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                w = weigh(h, n)
                got = sampler.sample(h, w, starts)
                masses[first + of[starts]] = np.add.reduceat(w, starts)
                folded = got.reshape(len(got), bands, ROWS).astype(np.uint64)
                key = np.broadcast_to(salt, folded.shape[:2])
                for k in range(ROWS):
                    key = mixed(key * np.uint64(0x100000001B3) + folded[:, :, k])
                for i, g, b in zip(of[starts], got.astype(np.uint16), key.astype(np.int64), strict=True):
                    sigs[first + i], keys[first + i] = g.tobytes(), b
            yield pd.DataFrame({"node": pdf["node"], "doc_id": pdf["doc_id"], "sig": sigs, "bands": keys, "mass": masses})

    # ids go as text, as pandas turns longs with nulls to floats
    rows = docs.select(node_of(F.col("text")).alias("node"), F.col("doc_id").cast("string"), "text").mapInPandas(run, "node binary, doc_id string, sig binary, bands array<long>, mass double")
    rows = saved(rows, "signatures")
    return saved(rows.groupBy("node").agg(F.min(F.col("doc_id").cast("long")).alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("mass").alias("mass")), "nodes")


def comparable(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (lead, node) whose weights don't rule out that they are SIMILAR, which is exact."""
    mass = nodes.select("node", "mass")
    both = pairs.join(mass.withColumnRenamed("mass", "_b"), "node").join(mass.select(F.col("node").alias("lead"), F.col("mass").alias("_a")), "lead")
    return both.where(F.least("_a", "_b") >= F.lit(COMPARABLE) * F.greatest("_a", "_b")).select("lead", "node")


def sharing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The comparable pairs (lead, node) that share a band."""
    sig = nodes.select("node", "sig")
    both = comparable(pairs, nodes).join(sig.withColumnRenamed("sig", "sig_b"), "node").join(sig.select(F.col("node").alias("lead"), F.col("sig").alias("sig_a")), "lead")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(-1, SAMPLES) for c in ("sig_a", "sig_b"))
            yield pdf.loc[shared_bands(a == b).any(1), ["lead", "node"]]

    return both.mapInPandas(run, "lead binary, node binary")


def shared_bands(same: np.ndarray) -> np.ndarray:
    """Pairs x bands from pairs x samples: where all samples of a band agree."""
    return same.reshape(len(same), -1, ROWS).all(2)


def near_mass(mass: float, others: np.ndarray) -> np.ndarray:
    """Which of the other weights don't rule out SIMILAR."""
    return np.minimum(mass, others) >= COMPARABLE * np.maximum(mass, others)


def verified(pairs: DataFrame, texts: DataFrame, weights: Broadcast) -> DataFrame:
    """The pairs (lead, node) whose weighted Jaccard similarity is SIMILAR or more.

    The texts of a lead's partners go to it in lots of about SALT, each with the lead's own text first.
    """
    lots = pairs.groupBy("lead").agg(F.ceil(F.count("*") / SALT).cast("int").alias("lots"))
    members = pairs.join(lots, "lead").select("lead", F.pmod(F.xxhash64("node"), "lots").cast("int").alias("lot"), F.lit(1).alias("role"), "node")
    leads = lots.select("lead", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(0).alias("role"), F.col("lead").alias("node"))
    told = members.union(leads).join(texts, "node").select("lead", "lot", "role", "node", "text")
    parts = max(12, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = told.repartition(parts, "lead", "lot").sortWithinPartitions("lead", "lot", "role")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weigh, own = weights.value, (np.zeros(0, np.uint64), np.zeros(0))
        for pdf in batches:
            good = np.zeros(len(pdf), bool)
            role = pdf["role"].to_numpy()
            for first, some in _batches(list(pdf["text"])):
                h, n, of = shingles(some)
                w = weigh(h, n)
                cuts = np.searchsorted(of, np.arange(len(some) + 1))
                for i in range(len(some)):
                    this = h[cuts[i] : cuts[i + 1]], w[cuts[i] : cuts[i + 1]]
                    if role[first + i] == 0:
                        own = this
                    else:
                        good[first + i] = jaccard(own, this) >= SIMILAR - 1e-9
            yield pdf.loc[good, ["lead", "node"]]

    return ordered.mapInPandas(run, "lead binary, node binary")


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets of sorted hashes; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / total) if (total := a[1].sum() + b[1].sum() - least) > 0 else 0.0


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node) of every node that has an edge (a, b).

    Each round hooks every root to its least neighbour, follows the hooks to their ends, and goes on with the edges
    between the roots that are left: at least half of the roots go in a round. The driver sees counts only.
    """
    roots, left = None, saved(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hook = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "hooks")
        moved = True
        while moved:  # every node that is hooked to is hooked itself, so one table follows three hooks
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            two = hook.join(up, "root").select("node", F.col("next").alias("root"))
            jumped = saved(two.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jumps")
            moved = not jumped.where("moved").isEmpty()
            hook = jumped.select("node", "root")
        if roots is None:
            roots = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = saved(roots.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        to = lambda c: hook.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        moved = left.join(to("a"), "a").join(to("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        left = saved(moved.where("a <> b").distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)


def star_pairs(rest: DataFrame, turn: int) -> DataFrame:
    """One pair (lead, node) a node: each bucket (key, node, root) has a lead, another one in each turn.

    A node with leads of other roots in several buckets takes the one that it shares most buckets with.
    """
    lead = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root")).alias("l")).select("key", F.col("l.node").alias("lead"), F.col("l.root").alias("lead_root"))
    pairs = rest.join(lead, "key").where("lead_root <> root").groupBy("node", "lead").agg(F.count("*").alias("shared"))
    return pairs.groupBy("node").agg(F.max_by("lead", F.struct("shared", "lead")).alias("lead")).select("lead", "node")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after the links (lead, node) have joined their classes."""
    a = roots.select(F.col("node").alias("lead"), F.col("root").alias("a"))
    edges = links.join(a, "lead").join(roots.select("node", F.col("root").alias("b")), "node").select("a", "b")
    up = components(edges).select(F.col("node").alias("root"), F.col("root").alias("up"))
    return saved(roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")


def unsettled(member: DataFrame, roots: DataFrame) -> DataFrame:
    """The buckets (key, band, node, root) whose members are of several classes."""
    told = member.select("key", "band", "node").join(roots, "node")
    open_keys = told.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("key")
    return saved(told.join(open_keys, "key").select("key", "band", "node", "root"), "rest")


def open_classes(rest: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other): nodes of buckets of SMALL members, and roots of other classes there that have a comparable member."""
    few = rest.join(rest.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") <= SMALL), "key")
    one = few.select("key", F.col("node").alias("lead"), F.col("root").alias("lead_root"))
    near = one.join(few, "key").where((F.col("lead") < F.col("node")) & (F.col("lead_root") != F.col("root"))).select("lead", "node").distinct()
    near = comparable(near, nodes)
    own = rest.select("node", "root").distinct()
    near = near.join(own, "node").join(own.select(F.col("node").alias("lead"), F.col("root").alias("lead_root")), "lead")
    return near.select("node", F.col("lead_root").alias("other")).union(near.select("lead", "root")).distinct()


def bucket_links(rest: DataFrame, nodes: DataFrame, texts: DataFrame, weights: Broadcast) -> DataFrame:
    """Links (lead, node) within buckets of more than SMALL members.

    Members outside a bucket's commonest class meet all its members in blocks, with samples and texts: a member is sent
    once for each block of those that ask, and one that asks once for each block of members. A task verifies the pairs of
    different classes and gives out links only, one for a node and class. A pair is looked at in the first band that it
    shares.
    """
    each = rest.groupBy("key", "root").agg(F.count("*").alias("n"))
    commonest = F.max_by("root", F.struct("n", "root")).alias("main")
    sizes = each.groupBy("key").agg(F.sum("n").alias("size"), commonest).where(F.col("size") > SMALL)
    large = saved(rest.join(sizes, "key").select("key", "band", "node", "root", "main"), "large")
    counts = large.groupBy("key").agg(F.count_if(F.col("root") != F.col("main")).alias("_asked"), F.count("*").alias("_held"))
    counts = counts.select("key", F.ceil(F.col("_asked") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("_held") / BLOCK).cast("int").alias("columns"))
    told = large.join(counts, "key").join(nodes.select("node", "sig"), "node").join(texts, "node")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = told.where("root <> main").select(F.col("key").alias("q"), place("rows").alias("qi"), every("columns").alias("qj"), F.col("band").alias("asked_band"), F.col("node").alias("asked"), F.col("root").alias("asked_root"), F.col("sig").alias("asked_sig"), F.col("text").alias("asked_text"))
    stock = told.select("key", every("rows").alias("i"), place("columns").alias("j"), "node", "root", "main", "sig", "text")

    def run(asked: pd.DataFrame, stock: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(stock):
            band, main = asked["asked_band"].iloc[0], stock["main"].iloc[0]
            a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, SAMPLES) for x in (asked["asked_sig"], stock["sig"]))
            mine, theirs = weighted(list(asked["asked_text"]), weights.value), weighted(list(stock["text"]), weights.value)
            masses = np.array([w.sum() for _, w in theirs])
            names, roots = stock["node"].to_numpy(), stock["root"].to_numpy()
            for node, root, sig, own in zip(asked["asked"], asked["asked_root"], a, mine, strict=True):
                same = b == sig
                share = same.mean(1)
                likely = np.flatnonzero((shared_bands(same).argmax(1) == band) & (roots != root) & near_mass(own[1].sum(), masses))
                linked = set()
                for k in likely[np.argsort(-share[likely], kind="stable")]:
                    # both members outside the commonest class: the smaller one asks
                    if roots[k] in linked or (roots[k] != main and names[k] < node):
                        continue
                    if jaccard(own, theirs[k]) >= SIMILAR - 1e-9:
                        linked.add(roots[k])
                        out.append((names[k], node))
        return pd.DataFrame(out, columns=["lead", "node"])

    return asked.groupBy("q", "qi", "qj").cogroup(stock.groupBy("key", "i", "j")).applyInPandas(run, "lead binary, node binary")


def class_links(wanted: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, weights: Broadcast) -> DataFrame:
    """Links (lead, node) that join each wanted (node, other) to the class of root other, if any of its members is
    similar: all members that share a band with it are tested, the likeliest first, until one is.

    Classes of FEW members are paired in a join. Nodes and members of larger ones meet in blocks, with their samples
    and texts, so that a text is sent once a block and not once a pair.
    """
    sizes = saved(roots.groupBy(F.col("root").alias("other")).agg(F.count("*").alias("size")), "sizes")
    own = roots.join(sizes.select(F.col("other").alias("root"), F.col("size").alias("own_size")), "root").select("node", "root", "own_size")
    both = wanted.join(own, "node").join(sizes, "other")
    # a pair of classes is looked at from the smaller one; where equal, from the one with the larger root
    both = saved(both.where("own_size < size OR (own_size = size AND root > other)").select("node", "other", "size"), "wanted")
    small = both.where(F.col("size") <= FEW).join(roots.select(F.col("root").alias("other"), F.col("node").alias("lead")), "other").select("lead", "node")
    out = verified(saved(sharing(small, nodes), "class-pairs"), texts, weights)

    large = both.where(F.col("size") > FEW)
    counts = large.groupBy("other", "size").agg(F.count("*").alias("n"))
    counts = counts.select("other", F.ceil(F.col("n") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("size") / BLOCK).cast("int").alias("columns"))
    content = nodes.select("node", "sig").join(texts, "node")
    cell = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = large.select("node", "other").join(counts, "other").join(content, "node").select(F.col("other").alias("q"), cell("rows").alias("qi"), every("columns").alias("qj"), F.col("node").alias("asked"), F.col("sig").alias("asked_sig"), F.col("text").alias("asked_text"))
    stock = roots.select(F.col("root").alias("other"), "node").join(counts, "other").join(content, "node").select("other", every("rows").alias("i"), cell("columns").alias("j"), "node", "sig", "text")
    def run(asked: pd.DataFrame, stock: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(stock):
            a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, SAMPLES) for x in (asked["asked_sig"], stock["sig"]))
            mine, theirs = weighted(list(asked["asked_text"]), weights.value), weighted(list(stock["text"]), weights.value)
            masses = np.array([w.sum() for _, w in theirs])
            for node, sig, own in zip(asked["asked"], a, mine, strict=True):
                same = b == sig
                some = np.flatnonzero(shared_bands(same).any(1) & near_mass(own[1].sum(), masses))
                for k in some[np.argsort(-same[some].mean(1), kind="stable")]:
                    if jaccard(own, theirs[k]) >= SIMILAR - 1e-9:
                        out.append((stock["node"].iloc[k], node))
                        break
        return pd.DataFrame(out, columns=["lead", "node"])

    return out.union(asked.groupBy("q", "qi", "qj").cogroup(stock.groupBy("other", "i", "j")).applyInPandas(run, "lead binary, node binary"))


def weighted(texts: list[str | None], weights: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's sorted shingle hashes and their weights."""
    out = []
    for _, some in _batches(texts):
        h, n, of = shingles(some)
        w = weights(h, n)
        cuts = np.searchsorted(of, np.arange(len(some) + 1))
        out += [(h[a:b], w[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def classes(docs: DataFrame) -> DataFrame:
    """node, doc_id (its least) and root, which a class's nodes share, of every distinct text.

    Classes are the components of links: equal texts, and pairs that share a bucket (a pair of similarity 0.8 does with
    probability 0.9998) with weighted Jaccard similarity SIMILAR or more; every such pair of two classes is verified, but
    for those whose weights rule it out, so the pair is linked with that probability. First every node is compared with a lead of
    its buckets, in a few turns; then with all bucket mates of every other class, so
    no bucket or group is capped. Null
    counts as empty; texts without words equal only their copies. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return saved(_classes(docs), "classes", keep=True)


def _classes(docs: DataFrame) -> DataFrame:
    weights = docs.sparkSession.sparkContext.broadcast(corpus_weights(docs))
    nodes = signatures(docs, weights)
    member = nodes.where("bands is not null").select("node", F.posexplode("bands").alias("band", "key"))
    shared = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    member = saved(member.join(shared, "key"), "members")
    active = member.select("node").distinct()
    wanted = nodes.join(active, "node").select("node", F.col("doc_id").alias("_doc_id"))
    texts = docs.select(node_of(F.col("text")).alias("node"), "doc_id", "text").join(wanted, "node").where(F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    texts = saved(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    roots = saved(active.select("node", F.col("node").alias("root")), "roots")
    rest = member
    for turn in range(STARS):
        rest = unsettled(member, roots)
        if rest.isEmpty():
            break
        pairs = saved(comparable(star_pairs(rest, turn), nodes), "pairs")
        roots = merged(roots, saved(verified(pairs, texts, weights), "links"))
    rest = unsettled(member, roots)
    wanted = saved(open_classes(rest, nodes), "open")
    links = bucket_links(rest, nodes, texts, weights).union(class_links(wanted, roots, nodes, texts, weights))
    final = merged(roots, saved(links, "class-links"))

    return nodes.select("node", "doc_id").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row: class_id is the least doc_id of the row's class (see classes).

    A null doc_id has the class of its text, null if no row of the class has one. Repeated rows stay rows of their own.
    """
    named = classes(docs)
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    told = named.select("node", "root").join(least, "root").select("node", "class_id")
    return docs.select("doc_id", node_of(F.col("text")).alias("node")).join(told, "node").select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with the least doc_id of their class (see classes), one row of each class."""
    named = classes(docs)
    kept = named.groupBy("root").agg(F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("node"), F.min("doc_id").alias("least"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), node_of(F.col("text")).alias("own")).join(kept, F.col("own") == F.col("node"))
    return rows.where(F.col("row.doc_id").eqNullSafe(F.col("least"))).dropDuplicates(["own"]).select("row.*")


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document (see near_duplicates)."""
    return near_duplicates(table(spark, sf_dir, "documents"))
