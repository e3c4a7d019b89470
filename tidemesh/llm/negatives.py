"""Hard-negative mining with segment summaries.

A vector is cut into segments; of each its mean and its deviation (the norm of what is left without the mean) are stored.
For two vectors the inner product of a segment of n components is n times the product of the means, give or take the
product of the deviations at most. Neighbouring segments' summaries give that of the segment they make, so bounds are
tried on the whole vector first, then on halves, and so on; only vectors that no level excludes are scored exactly.
Blocks of vectors have the ranges of their summaries, which exclude whole blocks for a query before any vector moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemesh.llm.common import saved, scratch, small_batches, table
from tidemesh.llm.pivots import LEAST, MOST, inner, matrix, scaled

#: Segments of a vector at the finest level (a power of two), vectors in a block, block summaries in a page, queries that
#: meet a block or page at once, vectors of a block that are refined at once.
SEGMENTS, BLOCK, PAGE, CHUNK, TILE = 16, 8192, 256, 2048, 512
#: Vectors of the bounded sample from which the first floors come, whatever the table's size.
SAMPLE = 1024


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) of SEGMENTS segments of each row; rows go on in zeros to a multiple of SEGMENTS."""
    wide = np.zeros((len(x), -(-max(x.shape[1], 1) // SEGMENTS) * SEGMENTS))
    wide[:, : x.shape[1]] = x
    parts = wide.reshape(len(x), SEGMENTS, -1)
    mean = parts.mean(2)
    return mean, np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))


def coarser(mean: np.ndarray, dev: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """The summaries of segments twice as long as those of n components given."""
    a, b = mean[:, ::2], mean[:, 1::2]
    return (a + b) / 2, np.sqrt(dev[:, ::2] ** 2 + dev[:, 1::2] ** 2 + n / 2 * (a - b) ** 2)


def levels(mean: np.ndarray, dev: np.ndarray, n: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Summaries of 1, 2, 4, ... SEGMENTS segments, and the components of one segment."""
    out = [(mean, dev, n)]
    while out[0][0].shape[1] > 1:
        m, d, size = out[0]
        out.insert(0, (*coarser(m, d, size), 2 * size))
    return out


class Miner:
    """The task-side half. Bounds are in units of the largest component, a little wider against rounding."""

    def __init__(self, width: int, unit: float):
        self.width, self.unit, self.size = width, unit, -(-max(width, 1) // SEGMENTS)

    def units(self, floor: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Floors and caps of scores in units; a long's ends stand for all that lies beyond."""
        floor, cap = np.asarray(floor), np.asarray(cap)
        return np.where(floor <= LEAST, -np.inf, floor / self.unit / self.unit), np.where(cap >= MOST, np.inf, cap / self.unit / self.unit)

    def slack(self) -> float:
        return 1e-9 * (self.width + 1)

    def summed(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mean, dev = summaries(matrix(pdf["v"], self.width) / self.unit)
            yield pdf.assign(mean=list(mean), dev=list(dev), code=((mean.reshape(len(pdf), 4, -1).mean(2) > 0) * [1, 2, 4, 8]).sum(1).astype("int32"))

    def block_bounds(self, q: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(low, high): what a vector of each block may score with each query, in units."""
        mq, dq = (np.stack(q[c].to_numpy()) for c in ("mean", "dev"))
        low, high, most = (np.stack(b[c].to_numpy()) for c in ("low", "high", "most"))
        rest = dq @ most.T
        plus, minus = np.maximum(mq, 0), np.minimum(mq, 0)
        top = self.size * (plus @ high.T + minus @ low.T)
        bottom = self.size * (plus @ low.T + minus @ high.T)
        return bottom - rest - self.slack(), top + rest + self.slack()

    def admitted(self, same: bool):
        """One row per query and block of the same label (or of others) whose bounds admit a score that counts."""

        def run(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(blocks):
                return pd.DataFrame({"query": [], "block": []}).astype("int64")
            low, high = self.block_bounds(queries, blocks)
            floor, cap = (np.stack(queries[c].to_numpy()) for c in ("floor", "cap"))
            ok = np.zeros(low.shape, bool)
            for k in range(floor.shape[1]):
                least, most = self.units(floor[:, [k]], cap[:, [k]])
                ok |= (high >= least) & (low <= most) & (floor[:, [k]] <= cap[:, [k]])
            label, first, last = queries["label"].to_numpy()[:, None], blocks["first"].to_numpy(), blocks["last"].to_numpy()
            ok &= (first <= label) & (label <= last) if same else (first != label) | (label != last)
            i, j = np.nonzero(ok)
            return pd.DataFrame({"query": queries["row"].to_numpy()[i], "block": blocks["block"].to_numpy()[j]})

        return run

    def left(self, mine: list, theirs: list, part: slice, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, vectors of the part, which of their pairs): what no level excludes from scores of least to most.

        A query or vector none of whose pairs is left takes no part in the next level.
        """
        i, j = np.arange(len(least)), np.arange(part.start, min(part.stop, len(theirs[0][0])))
        ok = np.ones((len(i), len(j)), bool)
        for (mq, dq, n), (mx, dx, _) in zip(mine, theirs, strict=True):
            middle, room = n * (mq[i] @ mx[j].T), dq[i] @ dx[j].T + self.slack()
            ok &= (middle + room >= least[i, None]) & (middle - room <= most[i, None])
            rows, columns = ok.any(1), ok.any(0)
            i, j, ok = i[rows], j[columns], ok[rows][:, columns]
        return i, j, ok

    def scan(self, k: int, same: bool, seen: Accumulator | None = None):
        """query, band, none, id, row, score: of a block the first k of each query and band, best first.

        Part after part is refined with floors that rise to the worst of k that were found; what is left is scored.
        """

        def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
            best: dict[tuple[int, int], list[tuple]] = {}
            if len(queries) and len(vectors):
                vectors = vectors.sort_values(["label", "code", "row"])
                x, q = matrix(vectors["v"], self.width), matrix(queries["v"], self.width)
                theirs, mine = (levels(np.stack(df["mean"].to_numpy()), np.stack(df["dev"].to_numpy()), self.size) for df in (vectors, queries))
                ids, none, rows, labels = (vectors[c].to_numpy() for c in ("id", "none", "row", "label"))
                own, label = queries["row"].to_numpy(), queries["label"].to_numpy()
                floor, cap = (np.stack(queries[c].to_numpy()).astype(np.int64) for c in ("floor", "cap"))
                for at in range(0, len(x), TILE):
                    void = floor > cap
                    least, most = self.units(np.where(void, MOST, floor).min(1), np.where(void, LEAST, cap).max(1))
                    least[void.all(1)] = np.inf
                    i, j, ok = self.left(mine, theirs, slice(at, at + TILE), least, most)
                    ok &= ((label[i, None] == labels[j]) == same) & (own[i, None] != rows[j])
                    score = inner(q[i], x[j])
                    if seen is not None:
                        seen.add(score.size)
                    for band in range(floor.shape[1]):
                        hit = ok & (score >= floor[i, None, band]) & (score <= cap[i, None, band])
                        for a in np.flatnonzero(hit.any(1)):
                            c = np.flatnonzero(hit[a])
                            if len(c) > k:
                                c = c[score[a, c] >= np.partition(score[a, c], -k)[-k]]
                            found = zip((-score[a, c]).tolist(), *(column[j[c]].tolist() for column in (none, ids, rows)), strict=True)
                            best[i[a], band] = first = sorted([*best.get((i[a], band), []), *found])[:k]
                            if len(first) == k:
                                floor[i[a], band] = max(floor[i[a], band], -first[-1][0])
                out = [(own[n], band, none_, id_, row, -s) for (n, band), first in best.items() for s, none_, id_, row in first]
            else:
                out = []
            return pd.DataFrame(out, columns=["query", "band", "none", "id", "row", "score"]).astype({"query": "int64", "band": "int32", "none": "bool", "id": "int64", "row": "int64", "score": "int64"})

        return run


def dealt(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks): the n rows with block, about BLOCK rows next to each other by label and code (the signs of the means
    of four quarters); blocks with their labels from first to last, and the ranges of means and the most of deviations of
    each segment. A label or code of many rows goes on through blocks."""
    parts = max(1, -(-n // BLOCK))
    rows = rows.repartitionByRange(parts, "label", "code", F.xxhash64("row")).withColumn("block", F.spark_partition_id().cast("long"))
    rows = saved(rows, "dealt")
    ends = [f(F.col(c)[s]).alias(f"{label}{s}") for f, c, label in ((F.min, "mean", "low"), (F.max, "mean", "high"), (F.max, "dev", "most")) for s in range(SEGMENTS)]
    blocks = rows.groupBy("block").agg(F.min("label").alias("first"), F.max("label").alias("last"), *ends)
    blocks = blocks.select("block", "first", "last", *(F.array(*(f"{c}{s}" for s in range(SEGMENTS))).alias(c) for c in ("low", "high", "most")))
    return rows, saved(blocks.withColumn("page", F.expr(f"block div {PAGE}")), "blocks")


def met(asks: DataFrame, stock: DataFrame, key: list[str], run: Callable, schema: str) -> DataFrame:
    """run on the asks and the stock of each key; the stock goes once to each lot of about CHUNK asks."""
    lots = asks.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("lots"))
    asking = asks.join(lots, key).withColumn("lot", F.pmod(F.xxhash64("row"), "lots").cast("int")).drop("lots")
    held = stock.join(lots, key).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    return asking.groupBy(*key, "lot").cogroup(held.groupBy(*key, "lot")).applyInPandas(run, schema)


def first_of(miner: Miner, queries: DataFrame, rows: DataFrame, blocks: DataFrame, same: bool, k: int, seen: Accumulator | None) -> DataFrame:
    """query, band, rank, none, id, row, score: the first k of each query and band among rows of the same label, or of others.

    queries has row, label, v, mean, dev, floor and cap, the last two a list of bands each; scores outside don't count.
    """
    pages = blocks.agg(F.max("page")).first()[0] or 0
    asks = queries.drop("v").withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages))))
    pairs = saved(met(asks, blocks, ["page"], miner.admitted(same), "query long, block long"), "asked")
    asks = pairs.join(queries.withColumnRenamed("row", "query"), "query").withColumnRenamed("query", "row")
    found = met(asks, rows, ["block"], miner.scan(k, same, seen), "query long, band int, none boolean, id long, row long, score long")
    order = F.row_number().over(Window.partitionBy("query", "band").orderBy(F.desc("score"), "none", "id", "row"))
    return saved(saved(found, "found").withColumn("rank", order).where(F.col("rank") <= k), "first")


def mine(vectors: DataFrame, anchor: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, seen: Accumulator | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hardest negatives of each positive.

    vectors has id, label and v (whole numbers as doubles, see pivots.scaled); anchors are its rows for which the SQL
    condition `anchor` holds. An anchor's positives are its first `positives` other rows of its label by integer inner
    product; of the rows of other labels with low * positive_score <= 100 * score <= high * positive_score the first
    `negatives` are returned for each positive. Ties go to the smaller id, null ids last. Rows with a null label take no
    part; repeated rows are rows of their own, and an anchor leaves out its own row only. Vectors of several lengths
    meet as if the shorter went on in zeros; scores past a long's range count as its nearer end. Anchors without
    positives or negatives have no rows, nor have empty tables.

    All bounds hold for all rows: nothing is sampled but the SAMPLE rows that give the first floors. To the driver come
    those, two maxima, the number of rows and that of pages. seen counts the exact scores of blocks.
    """
    spark = vectors.sparkSession
    small_batches(spark, rows=2048)
    with scratch(spark):
        rows = saved(vectors.where("label IS NOT NULL").select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), F.col("label").cast("long").alias("label"), "v").withColumn("row", F.monotonically_increasing_id()), "vectors")
        width, unit, n = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.count("*")).first()
        miner = Miner(width or 0, unit or 1.0)
        shape = "id long, none boolean, label long, v array<double>, row long, mean array<double>, dev array<double>"
        rows, blocks = dealt(rows.mapInPandas(miner.summed, f"{shape}, code int"), n)
        sample = rows.orderBy(F.xxhash64("row", F.lit(1)), "row").limit(SAMPLE).select("row", "label", "v").collect()
        known, known_rows, known_labels = matrix([r["v"] for r in sample], miner.width), np.array([r["row"] for r in sample]), np.array([r["label"] for r in sample])

        def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The worst of the first `positives` among the sample bounds the answer from below."""
            for pdf in batches:
                low_ = []
                for own, label, s in zip(pdf["row"], pdf["label"], inner(matrix(pdf["v"], miner.width), known), strict=True):
                    s = np.sort(s[(known_labels == label) & (known_rows != own)])
                    low_.append([int(s[-positives]) if len(s) >= positives else LEAST])
                yield pdf.assign(floor=low_, cap=[[MOST]] * len(pdf))

        anchors = saved(rows.where(f"NOT none AND ({anchor})").select("id", "none", "label", "v", "row", "mean", "dev"), "anchors")
        asking = saved(anchors.mapInPandas(floors, f"{shape}, floor array<long>, cap array<long>"), "asking")
        first = first_of(miner, asking.drop("id", "none"), rows, blocks, True, positives, seen)

        def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The band of each positive; its floor rises to the worst of `negatives` of the sample that lie in it."""
            for pdf in batches:
                floor, cap = [], []
                for label, scores, s in zip(pdf["label"], pdf["scores"], inner(matrix(pdf["v"], miner.width), known), strict=True):
                    s = np.sort(s[known_labels != label])
                    bottom, top = [max(-(-low * int(p) // 100), LEAST) for p in scores], [min(high * int(p) // 100, MOST) for p in scores]
                    for i, (a, b) in enumerate(zip(bottom, top, strict=True)):
                        inside = s[(s >= a) & (s <= b)]
                        bottom[i] = int(inside[-negatives]) if len(inside) >= negatives else a
                    floor.append(bottom)
                    cap.append(top)
                yield pdf.drop(columns="scores").assign(floor=floor, cap=cap)

        scores = first.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores"))
        told = anchors.join(scores, anchors["row"] == scores["query"]).drop("query")
        asking = saved(told.mapInPandas(bands, f"{shape}, floor array<long>, cap array<long>"), "asking")
        hard = first_of(miner, asking.drop("id", "none"), rows, blocks, False, negatives, seen)
        plus = first.select("query", (F.col("rank") - 1).alias("band"), F.when(~F.col("none"), F.col("id")).alias("positive_id"), F.col("score").alias("positive_score"))
        minus = hard.select("query", "band", "rank", F.when(~F.col("none"), F.col("id")).alias("negative_id"), F.col("score").alias("negative_score"))
        named = anchors.select(F.col("row").alias("query"), F.col("id").alias("anchor_id"))
        result = minus.join(plus, ["query", "band"]).join(named, "query")
        return saved(result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives", keep=True)


def op12_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose vec_id is divisible by 100 (see mine); where vec_id is divisible by 7 the
    label is (label + 1) % 10. Vectors null or with null or non-finite components take no part."""
    read = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(scaled(read, "vec_id", "embedding", label.alias("label")), "id % 100 = 0")


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.r <> a.r
), pos AS (
  SELECT ar, anchor_id, cr, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5
)
SELECT pos.anchor_id, positive_id, row_number() OVER (PARTITION BY ar, pos.cr ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (ar) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
