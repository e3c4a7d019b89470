"""Exact top-k search with a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it. A query visits annuli in the order of their bounds
and stops where the triangle inequality shows that no vector further in or out can reach its k-th best. It does so
twice: first in its nearest block only, which gives a k-th best to start from, then in the blocks that are left.
The largest inner product becomes the nearest neighbour by one more coordinate: with M the largest norm,
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x for x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemesh.llm.common import saved, table

#: Pivots are at most so many vectors, the sample that the index is fitted on; every vector is indexed.
PIVOTS = 32
#: Rings of a pivot, vectors in a block, queries that meet a block at once, vectors in a slice of a block's annulus.
RINGS, BLOCK, CHUNK, SLICE = 64, 8192, 4096, 256
EXACT, LEAST, MOST = 2.0**53, -(1 << 63), (1 << 63) - 1


def scaled(df: DataFrame, key: str, vector: str, *others: Column) -> DataFrame:
    """key as id, the other columns, and v, the vector's floor(256 * x) as doubles, which hold these integers exactly.

    Vectors null or with null or non-finite components (or such of 256 * x) are left out. No more columns are read.
    """
    wide = F.transform(F.col(vector), lambda x: x.cast("double") * 256)
    fine = F.forall(wide, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    whole = F.transform(wide, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    return df.where(F.col(vector).isNotNull() & fine).select(F.col(key).alias("id"), *others, whole.alias("v"))


def numbered(df: DataFrame) -> DataFrame:
    """df written with row, a number of each row's own, so that repeated rows stay apart."""
    return saved(df.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of integers as longs; what passes a long's range is its nearer end."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    left, right = ([[int(x) for x in row] for row in m.tolist()] for m in (a, b))
    return np.array([[min(max(sum(x * y for x, y in zip(u, v, strict=True)), LEAST), MOST) for v in right] for u in left], np.int64).reshape(len(a), len(b))


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, by differences: no cancellation for near rows."""
    return np.stack([np.sqrt(((a - p) ** 2).sum(1)) for p in b], 1) if len(b) else np.zeros((len(a), 0))


class Searcher:
    """The task-side half: what a query needs to know of the index. Distances are measured in units of the largest component."""

    def __init__(self, pivots: np.ndarray, width: int, unit: float, norm2: float, k: int):
        self.width, self.unit, self.norm2, self.k = width, unit, norm2, k
        self.pivots = lifted(pivots / unit, norm2)

    def keyed(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds each vector's cell (nearest pivot, smaller number on ties) and its distance to it."""
        for pdf in batches:
            d = distances(lifted(matrix(pdf["v"], self.width) / self.unit, self.norm2), self.pivots)
            cell = d.argmin(1) if len(pdf) else np.zeros(0, int)
            yield pdf.assign(cell=cell.astype("int32"), far=d[np.arange(len(pdf)), cell])

    def reach(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """How far a vector may lie from a query (in units) and still score floor; a little more, against rounding."""
        size = (q * q).sum(1) + self.norm2
        room = np.where(floor > LEAST, size - 2 * (floor.astype(float) / self.unit / self.unit), np.inf)
        return np.sqrt(np.maximum(room, 0)) * (1 + 1e-9) + 1e-6 * np.sqrt(size)

    def admitted(self, blocks: pd.DataFrame, first: bool):
        """One row per query and block that its bound admits, but for the nearest block; with first, that one only."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cell, low, high, number = (blocks[c].to_numpy() for c in ("cell", "low", "high", "block"))
            some = max(1, 2_000_000 // max(1, len(blocks)))
            for pdf in batches:
                for at in range(0, len(pdf), some):
                    part = pdf.iloc[at : at + some]
                    q = matrix(part["v"], self.width) / self.unit
                    d = distances(np.hstack([q, np.zeros((len(q), 1))]), self.pivots)[:, cell]
                    bound = np.maximum(np.maximum(low - d, d - high), 0)
                    near = bound.argmin(1)
                    if first:
                        i, j = np.arange(len(q)), near
                    else:
                        ok = bound <= self.reach(q, part["floor"].to_numpy(np.int64))[:, None]
                        ok[np.arange(len(q)), near] = False
                        i, j = np.nonzero(ok)
                    yield pd.DataFrame({"block": number[j], "query": part["row"].to_numpy()[i], "at": d[i, j]})

        return run

    def scan(self, queries: pd.DataFrame, vectors: pd.DataFrame, seen: Accumulator | None = None) -> pd.DataFrame:
        """The k best of a block for each query: slices of its sorted annulus, nearest bound first, until bounds fail.

        Queries go on together: in each step every query that isn't done takes the next slice of its own order.
        """
        out = {"query": [], "vec_id": [], "score": []}
        if len(queries) and len(vectors):
            vectors = vectors.sort_values(["far", "id", "row"])
            x, ids, rows, far = matrix(vectors["v"], self.width), vectors["id"].to_numpy(), vectors["row"].to_numpy(), vectors["far"].to_numpy()
            starts = np.arange(0, len(x), SLICE)
            low, high = far[starts], far[np.minimum(starts + SLICE, len(x)) - 1]
            q, own, at = matrix(queries["v"], self.width), queries["query"].to_numpy(), queries["at"].to_numpy()[:, None]
            floor = queries["floor"].to_numpy(np.int64).copy()
            bound = np.maximum(np.maximum(low - at, at - high), 0)
            order = np.argsort(bound, 1, kind="stable")
            kept: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]  # (-score, id), best first
            for step in range(len(starts)):
                take = order[:, step]
                live = np.flatnonzero(bound[np.arange(len(q)), take] <= self.reach(q / self.unit, floor))
                if not len(live):
                    break
                for s in np.unique(take[live]):
                    mine, part = live[take[live] == s], slice(starts[s], starts[s] + SLICE)
                    score = inner(q[mine], x[part])
                    hit = (score >= floor[mine, None]) & (rows[part] != own[mine, None])
                    if seen is not None:
                        seen.add(score.size)
                    for i in np.flatnonzero(hit.any(1)):
                        n, found = mine[i], np.flatnonzero(hit[i])
                        best = sorted(kept[n] + [(-int(a), int(b)) for a, b in zip(score[i, found], ids[part][found], strict=True)])[: self.k]
                        kept[n] = best
                        if len(best) == self.k:
                            floor[n] = max(floor[n], -best[-1][0])
            for n, best in enumerate(kept):
                out["query"] += [own[n]] * len(best)
                out["vec_id"] += [b for _, b in best]
                out["score"] += [-a for a, _ in best]
        return pd.DataFrame(out).astype("int64")


def dealt_blocks(keyed: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """keyed (see Searcher.keyed) with block, and the blocks: rings of one cell, so many that a block holds about BLOCK
    vectors; a full ring is cut by row. To the driver come the counts of PIVOTS * RINGS rings.
    """
    edge = keyed.agg(F.max("far")).first()[0] or 1.0
    keyed = keyed.withColumn("ring", F.least(F.lit(RINGS - 1), F.floor(F.col("far") / (edge * (1 + 1e-12)) * RINGS)).cast("int"))
    rings = keyed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).orderBy("cell", "ring").collect()
    groups: list[dict] = []
    for r in rings:
        if groups and groups[-1]["cell"] == r["cell"] and groups[-1]["n"] + r["n"] <= BLOCK:
            last = groups[-1]
            last |= {"n": last["n"] + r["n"], "high": r["high"], "rings": [*last["rings"], r["ring"]]}
        else:
            groups.append({"cell": r["cell"], "n": r["n"], "low": r["low"], "high": r["high"], "rings": [r["ring"]]})
    blocks, deal = [], []
    for g in groups:
        cuts = -(-g["n"] // BLOCK)
        deal += [(g["cell"], ring, len(blocks), cuts) for ring in g["rings"]]
        blocks += [(len(blocks) + c, g["cell"], g["low"], g["high"]) for c in range(cuts)]
    dealt = keyed.sparkSession.createDataFrame(deal, "cell int, ring int, first long, cuts int")  # PIVOTS * RINGS rows at most
    keyed = keyed.join(F.broadcast(dealt), ["cell", "ring"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("cuts")))
    return keyed.select("block", "id", "row", "v", "far"), pd.DataFrame(blocks, columns=["block", "cell", "low", "high"])


def visited(asked: DataFrame, queries: DataFrame, keyed: DataFrame, searcher: Searcher, seen: Accumulator | None) -> DataFrame:
    """query, vec_id, score: the k best of each asked block (block, query, at).

    A block goes once to each lot of about CHUNK queries that ask for it, and not at all where none does.
    """
    asked = saved(asked, "asked")
    lots = asked.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("lots"))
    told = asked.join(lots, "block").withColumn("lot", F.pmod(F.xxhash64("query"), "lots").cast("int")).join(queries.select(F.col("row").alias("query"), "v", "floor"), "query")
    stock = keyed.join(lots, "block").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select("block", "lot", "id", "row", "v", "far")
    asking = told.select("block", "lot", "query", "at", "v", "floor")
    found = asking.groupBy("block", "lot").cogroup(stock.groupBy("block", "lot")).applyInPandas(lambda a, b: searcher.scan(a, b, seen), "query long, vec_id long, score long")
    return saved(found, "found")


def search(vectors: DataFrame, queries: DataFrame, k: int, seen: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k largest integer inner products, ties to the smaller id.

    vectors and queries hold id, v (see scaled) and row (see numbered), which sets a query's own vector apart; without
    row that is every vector of its id. Vectors of several lengths meet as if the shorter went on in zeros. Scores past
    a long's range count as its nearer end. A query without any other vector gives no rows; repeated rows are rows of
    their own, also as queries; rows with a null id take no part; empty tables give no rows. To the driver come three
    sums, the pivots (PIVOTS rows) and the counts of rings (PIVOTS * RINGS rows); vectors and queries meet by block. seen
    counts the vectors that queries were compared with.
    """
    spark = vectors.sparkSession
    if "row" not in vectors.columns:
        vectors, queries = (df.withColumn("row", F.col("id")) for df in (vectors, queries))
    vectors, queries = saved(vectors.where("id is not null").select("id", "v", "row"), "vectors"), queries.where("id is not null").select("id", "v", "row")
    width, unit, most = vectors.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.count("*")).first()
    if not most or not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    unit = unit or 1.0
    norm2 = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / unit) * (x / unit)))).first()[0]
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(PIVOTS).collect()
    known, known_rows = matrix([r["v"] for r in sample], width), np.array([r["row"] for r in sample])
    searcher = Searcher(known, width, unit, norm2, k)
    keyed, blocks = dealt_blocks(saved(vectors.mapInPandas(searcher.keyed, "id long, v array<double>, row long, cell int, far double"), "keyed"))

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A first floor: the k-th best among the sample, as any k vectors bound the answer from below."""
        for pdf in batches:
            s = inner(matrix(pdf["v"], width), known)
            low = [int(np.sort(row[known_rows != own])[-k]) if (known_rows != own).sum() >= k else LEAST for row, own in zip(s, pdf["row"], strict=True)]
            yield pdf.assign(floor=np.array(low, np.int64))

    queries = saved(queries.mapInPandas(floors, "id long, v array<double>, row long, floor long"), "queries")
    pair = "block long, query long, at double"
    near = visited(queries.mapInPandas(searcher.admitted(blocks, True), pair), queries, keyed, searcher, seen)
    best = near.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
    raised = queries.join(best, queries["row"] == best["query"], "left").select("id", "v", "row", F.greatest("floor", F.coalesce("least", "floor")).alias("floor"))
    raised = saved(raised, "raised")
    rest = visited(raised.mapInPandas(searcher.admitted(blocks, False), pair), raised, keyed, searcher, seen)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    top = near.union(rest).withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(queries.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every vector whose vec_id is divisible by 50 (see search)."""
    vectors = numbered(scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return search(vectors, vectors.where("id % 50 = 0"), 5)


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS NOT NULL AND c.r <> q.r
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
