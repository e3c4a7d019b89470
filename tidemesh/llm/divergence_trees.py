"""Source divergence audit on hash-consed segment trees over term ids.

A group's counts over the terms of its language are a segment tree. The terms are cut into chunks, whose trees are the
subtrees at one depth of the whole; a task holds the trees of one chunk. In it equal count subtrees of all groups are
one node, and two trees are walked at the same time from their roots: each pair of nodes that the walk meets, however
often, is priced once. Chunks' prices are summed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemesh.llm.common import saved, scratch, small_batches, table

#: Documents that a kept term is in at least, terms of a group's report.
DOCUMENTS, REPORTED = 10, 10
#: Terms of a chunk (a power of two), sources of a language whose trees are in one task, or twice as many; entries that a
#: counting task holds before it hands them on.
CHUNK, SOURCES, HELD = 1 << 12, 64, 200_000
ONE = 1_000_000_000

#: A-Z lower-cased, other bytes of terms as they are, all that is in no term blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term, over whole texts, summed in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array([n[t] for t in terms], pa.int64()), pa.array([d[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                seen = Counter(text.translate(_FOLD).split(b" "))
                del seen[b""]
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(seen)
                d.update(seen.keys())
                size += len(n)
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    read = docs.select(*blank, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = read.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(ONE * (count + 2) / (total + 2 * terms)), exact for counts of any size."""
    if total < 9_000_000_000 and counts.max(initial=0) < 9_000_000_000:
        return 1 + ONE * (counts + 2) // (total + 2 * terms)
    return np.array([1 + ONE * (int(c) + 2) // (total + 2 * terms) for c in counts], np.int64)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) for shares, which are ONE + 1 at most, so that squares fit a long."""
    return (p - q) ** 2 // np.maximum(p + q, 1)


class Forest:
    """Segment trees over one range of terms; equal subtrees are one node.

    counts holds a row a tree, a column a term. A leaf is a count, or void, right of the last term, which costs nothing.
    levels[0] are leaves; levels[k][i] are the left and right child, on level k - 1, of node i on level k; roots has
    the root of each tree.
    """

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, counts.shape[1] - 1).bit_length()
        padded = np.full((len(counts), width), -1, np.int64)
        padded[:, : counts.shape[1]] = counts
        self.leaves, at = np.unique(padded, return_inverse=True)
        self.row = at = at.reshape(padded.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        size = len(self.leaves)
        while at.shape[1] > 1:
            nodes, at_ = np.unique(at[:, ::2] * size + at[:, 1::2], return_inverse=True)
            self.levels.append((nodes // size, nodes % size))
            at, size = at_.reshape(len(at), -1), len(nodes)
        self.roots = at[:, 0]

    def total(self, a: int, b: int, p: np.ndarray, q: np.ndarray) -> int:
        """The prices of all terms of trees a and b, whose leaves have shares p and q, summed.

        Down the levels a pair of nodes that was met before is not followed again; up the levels each has one price.
        """
        left, right = self.roots[[a]], self.roots[[b]]
        met: list[np.ndarray] = []
        for lefts, rights in reversed(self.levels):
            size = int(max(lefts.max(), rights.max())) + 1
            pairs = np.concatenate([lefts[left] * size + lefts[right], rights[left] * size + rights[right]])
            pairs, at = np.unique(pairs, return_inverse=True)
            met.append(at.reshape(2, -1))
            left, right = pairs // size, pairs % size
        value = np.where(self.leaves[left] < 0, 0, price(p[left], q[right]))
        for at in reversed(met):
            value = value[at[0]] + value[at[1]]
        return int(value[0])

    def terms(self, a: int, b: int, p: np.ndarray, q: np.ndarray, most: int) -> list[tuple[int, int]]:
        """(place, price) of the terms that tree a has and gives more than tree b; the most dear, earlier ones on ties."""
        pairs, at = np.unique(self.row[a] * len(self.leaves) + self.row[b], return_inverse=True)
        left, right = pairs // len(self.leaves), pairs % len(self.leaves)
        value = np.where((self.leaves[left] > 0) & (p[left] > q[right]), price(p[left], q[right]), -1)[at.reshape(-1)]
        best = np.argsort(-value, kind="stable")[:most]
        return [(int(i), int(value[i])) for i in best if value[i] >= 0]


def priced(leaves: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
    """One chunk of a language's trees, of the sources of one block or of two: source, item (a source; null for a term),
    number (of the term, or null), value."""
    out: list[tuple] = []
    for a in about.itertuples():  # one row
        blocks = [a.low_sources, a.high_sources] if a.low != a.high else [a.low_sources]
        names = [m["source"] for b in blocks for m in b]
        totals = [m["total"] for b in blocks for m in b]
        counts = np.zeros((len(names) + 1, a.width), np.int64)
        place = (leaves["number"] - a.start).to_numpy(np.int64)
        counts[leaves["source"].map({s: i for i, s in enumerate(names)}).to_numpy(np.int64), place] = leaves["n"]
        counts[-1, place] = leaves["lang_n"]
        forest = Forest(counts)
        share = [shares(np.maximum(forest.leaves, 0), t, a.terms) for t in [*totals, a.lang_total]]
        split = len(blocks[0])
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                if a.low == a.high or i < split <= j:
                    out.append((names[i], names[j], None, forest.total(i, j, share[i], share[j])))
            if a.low == a.high:
                out += [(names[i], None, a.start + at, value) for at, value in forest.terms(i, -1, share[i], share[-1], REPORTED)]
    return pd.DataFrame(out, columns=["source", "item", "number", "value"]).astype({"number": "Int64", "value": "int64", "source": "object", "item": "object"})


def audit(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of each language are from each other, and on which terms.

    docs has text, lang and source, null ones read as ''; other columns are not read, and a row is a document, also one
    that occurs again. A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps the
    terms of at least `documents` documents. Part pair has a row for each two sources of a language both ways, part term
    REPORTED terms at most that a source gives more than its language; ranks fall with value, ties by item. All
    arithmetic is on whole numbers. A source without any kept term has counts of 0, a language without any has pairs of
    value 0. No document gives no rows.

    Texts are read once; counts, summed in tasks, are shuffled by term. A task holds the trees of one chunk of CHUNK
    terms for two blocks of about SOURCES sources. Nothing comes to the driver.
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        counted = saved(term_counts(docs), "counted")
        per_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= documents)
        kept = saved(per_term.orderBy("lang", "term").select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("number")), "kept")
        chunk = F.expr(f"number div {CHUNK}").alias("chunk")
        leaves = saved(counted.join(kept, ["lang", "term"]).select("lang", "source", "number", chunk, "n", "lang_n"), "leaves")

        names = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        totals = leaves.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        langs = names.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).cast("int").alias("blocks"))
        groups = names.join(totals, ["lang", "source"], "left").join(langs, "lang")
        groups = saved(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "blocks", F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("block")), "groups")
        members = groups.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources"))
        low, high = (members.select("lang", F.col("block").alias(b), F.col("sources").alias(f"{b}_sources")) for b in ("low", "high"))
        blocks = low.join(high, "lang").where("low <= high")
        chunks = kept.groupBy("lang", chunk).agg(F.min("number").alias("start"), F.count("*").cast("int").alias("width"))
        sums = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
        about = chunks.join(sums, "lang").join(blocks, "lang")

        dealt = leaves.join(groups.drop("total"), ["lang", "source"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("lang", "chunk", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "source", "number", "n", "lang_n")
        key = ["lang", "chunk", "low", "high"]

        def run(key: tuple, leaves: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
            return priced(leaves, about).assign(lang=key[0])

        found = saved(dealt.groupBy(*key).cogroup(about.groupBy(*key)).applyInPandas(run, "source string, item string, number long, value long, lang string"), "priced")

        one = found.where("number IS NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        both = one.union(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
        others = names.select("lang", F.col("source").alias("item"))
        pairs = names.join(others, "lang").where(F.col("source") != F.col("item")).join(both, ["lang", "source", "item"], "left")
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "number"))
        top = found.where("number IS NOT NULL").withColumn("rank", place).where(F.col("rank") <= REPORTED)
        top = top.join(kept.select("number", F.col("term").cast("string").alias("word")), "number")
        rows = pairs.withColumn("rank", rank).union(top.select("lang", "source", F.lit("term"), F.col("word"), "value", "rank"))
        return saved(rows, "audit", keep=True)


def op11_divergence_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all (lang, source) groups of documents (see audit, also for nulls, ties and empty groups)."""
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), t AS (
  SELECT r, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), l AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), gn AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source
), p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.c, 0) AS c,
         1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (gn.n + 2 * l.v) AS p,
         1 + (1000000000 * (kept.c + 2)) // (l.n + 2 * l.v) AS q
  FROM gn JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms)
) WHERE part = 'pair' OR rank <= 10
"""
