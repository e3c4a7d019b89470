"""Repeated passages by level-wise doubling: windows of words that repeat at one length are extended to twice that length.

A window counts by its 128-bit fingerprint, which of twice the length is mixed from those of its halves. Below the
wanted length only winnowed windows count: of all short windows in a wanted one, that of the least fingerprint, which is
the same in every copy of it; where that short window is unique, so is the wanted one. From the wanted length on every
window that is left counts, and lengths double until none repeats.

No level joins occurrences with each other. A window's occurrences are summed to their number and the first of them, in
partial sums, and only first ones are sent back to their text; what a text doesn't get back repeats an earlier place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.llm.common import delete, place, saved, scratch, small_batches, swept, table

#: Words of a window whose repeats are removed, and of the windows that come first.
WINDOW, FIRST = 20, 10
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

Lanes = tuple[np.ndarray, np.ndarray]


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        steps = np.full(1 << max(16, n.bit_length()), base, np.uint64)
        back = np.full(len(steps), pow(base, -1, 1 << 64), np.uint64)
        steps[0] = back[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _powers[base]


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def joined(left: Lanes, right: Lanes) -> Lanes:
    """Fingerprints of sequences from those of their two parts; not symmetric and not linear."""
    a, b = left[0] + np.uint64(0x2545F4914F6CDD1D) * _stirred(right[0]), left[1] + np.uint64(0x5851F42D4C957F2D) * _stirred(right[1])
    return _stirred(a), _stirred(b)


def words(texts: list[bytes]) -> tuple[Lanes, np.ndarray]:
    """Fingerprints of the words of some texts, in order, and the number of each word's text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    end = end[len(end) - len(begin) :]
    lanes = []
    for base in _BASES:
        powers, inverse = _power_tables(base, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        lanes.append(_stirred((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)))
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, "right")
    return (lanes[0], lanes[1]), of


def windows(word: Lanes, length: int) -> Lanes:
    """Fingerprints of all windows of so many words, also of those that run from one text into the next."""
    if length == 1:
        return word
    half = length // 2
    part = windows(word, half)
    rest = part if length == 2 * half else windows(word, length - half)
    n = len(word[0]) - length + 1
    return joined((part[0][: max(n, 0)], part[1][: max(n, 0)]), (rest[0][half : half + max(n, 0)], rest[1][half : half + max(n, 0)]))


def winnowed(short: np.ndarray, fits: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of span short windows from each place that fits on, the first on ties."""
    if not len(fits):
        return fits
    return np.lib.stride_tricks.sliding_window_view(short, span)[fits].argmin(1) + fits


def _lots(batch: pa.RecordBatch, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about limit bytes together; a longer text is a run of its own."""
    size, start = 0, 0
    for i, n in enumerate(pc.binary_length(batch["text"]).to_pylist()):
        if size and size + n > limit:
            yield start, i
            size, start = 0, i
        size += n
    if start < batch.num_rows:
        yield start, batch.num_rows


def _lists(of: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """One list a text of each array, whose elements are in order of their texts."""
    stops = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32))
    return [pa.ListArray.from_arrays(stops, pa.array(v)) for v in values]


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a column of lists and the row of each; null is an empty list."""
    column = batch[name]
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)


def texts_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbers, nodes): each different text once, as a node whose number follows the order of texts.

    numbers has digest, owner (the least doc_id of the text; null comes last) and node; nodes has node and text, as
    UTF-8. Texts are in order of owner, those of one owner of their digests.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    read = docs.select(F.col("doc_id").alias("owner"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    least = F.min(F.struct(F.col("owner").isNull().alias("none"), "owner")).alias("first")
    ordered = read.groupBy("digest").agg(least).orderBy("first", "digest")
    numbers = saved(ordered.select("digest", F.col("first.owner").alias("owner"), F.monotonically_increasing_id().alias("node")), "numbers")
    once = read.groupBy("digest").agg(F.first("text").alias("text")).join(numbers, "digest").select("node", "text")
    path = place(docs.sparkSession, "nodes")
    once.write.option("compression", "zstd").parquet(path)
    return numbers, docs.sparkSession.read.schema(once.schema).parquet(path)


def _first_level(nodes: DataFrame, window: int, first: int) -> DataFrame:
    """node, unique: the places in each text of winnowed windows of `first` words that occur once in all texts."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch["node"].to_numpy()
            for low, high in _lots(batch):
                word, of = words(batch["text"].slice(low, high - low).to_pylist())
                fits = np.flatnonzero(of[window - 1 :] == of[: max(len(of) - window + 1, 0)])
                mark = windows(word, first)[0]
                at = np.unique(winnowed(mark, fits, window - first + 1))
                start = np.searchsorted(of, np.arange(high - low))
                columns = [mark[at].view(np.int64), node[low + of[at]], (at - start[of[at]]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mark", "node", "at"])

    found = nodes.mapInArrow(pick, "mark long, node long, at int")
    once = found.groupBy("mark").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("at").alias("at")).where("n = 1")
    return once.groupBy("node").agg(F.collect_list("at").alias("unique"))


def _wanted_level(nodes: DataFrame, unique: DataFrame, window: int, first: int) -> DataFrame:
    """node, at, h1, h2: the windows of the wanted length whose winnowed windows repeat, as lists; texts without any have no row."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in _lots(whole):
                batch = whole.slice(low, high - low)
                word, of = words(batch["text"].to_pylist())
                fits = np.flatnonzero(of[window - 1 :] == of[: max(len(of) - window + 1, 0)])
                start = np.searchsorted(of, np.arange(high - low))
                alone, owner = _flat(batch, "unique")
                once = np.zeros(len(of) + 1, bool)
                once[alone.astype(np.int64) + start[owner]] = True
                fits = fits[~once[winnowed(windows(word, first)[0], fits, window - first + 1)]]
                full, node = windows(word, window), np.unique(of[fits])
                lists = _lists(np.searchsorted(node, of[fits]), len(node), (fits - start[of[fits]]).astype(np.int32), *(lane[fits].view(np.int64) for lane in full))
                yield pa.RecordBatch.from_arrays([pa.array(batch["node"].to_numpy()[node]), *lists], ["node", "at", "h1", "h2"])

    return nodes.join(unique, "node", "left").select("node", "text", "unique").mapInArrow(extend, _LEVEL)


_LEVEL = "node long, at array<int>, h1 array<long>, h2 array<long>"


def _judged(level: DataFrame, length: int) -> DataFrame:
    """Each text's windows of one length judged: node, again (places that repeat an earlier one), whether any window of the
    text repeats, and at, h1, h2 of the windows of twice the length whose halves both repeat."""
    rows = level.select("node", F.explode(F.arrays_zip("at", "h1", "h2")).alias("w")).select("node", "w.*")
    firsts = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("node", "at")).alias("f")).select("f.node", "f.at", (F.col("n") == 1).alias("once"))
    told = firsts.groupBy("node").agg(F.collect_list("at").alias("first"), F.collect_list("once").alias("once"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, of = _flat(batch, "at")
            lanes = [_flat(batch, h)[0].view(np.uint64) for h in ("h1", "h2")]
            first, owner = _flat(batch, "first")
            once = _flat(batch, "once")[0].astype(bool)
            key, theirs = (of.astype(np.int64) << 32) | at, (owner.astype(np.int64) << 32) | first.astype(np.int64)
            again = ~np.isin(key, theirs)
            repeats = ~np.isin(key, theirs[once])
            key, lanes, row = key[repeats], [lane[repeats] for lane in lanes], of[repeats]
            next_ = np.minimum(np.searchsorted(key, key + length), max(len(key) - 1, 0))
            both = np.flatnonzero(key[next_] == key + length) if len(key) else np.zeros(0, np.int64)
            twice = joined((lanes[0][both], lanes[1][both]), (lanes[0][next_[both]], lanes[1][next_[both]]))
            n = batch.num_rows
            columns = [batch["node"], *_lists(of[again], n, at[again]), pa.array(np.bincount(row, minlength=n) > 0)]
            columns += _lists(row[both], n, (key[both] & 0xFFFFFFFF).astype(np.int32), *(lane.view(np.int64) for lane in twice))
            yield pa.RecordBatch.from_arrays(columns, ["node", "again", "any", "at", "h1", "h2"])

    return level.join(told, "node", "left").mapInArrow(judge, "node long, again array<int>, any boolean, at array<int>, h1 array<long>, h2 array<long>")


def repeats(nodes: DataFrame, window: int = WINDOW, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(again, longest): node and the places whose windows repeat an earlier one; node and the longest doubled length at
    which one of its windows occurs more than once. Texts without a repeated window have no row in either.

    A driver round for each length; to the driver comes whether any window is left. A level's windows are deleted once
    the next level's are written.
    """
    spark = nodes.sparkSession

    def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        path = place(spark, label)
        df.write.parquet(path)
        swept(spark)
        return spark.read.schema(df.schema).parquet(path), path

    swept(spark)
    level, old = written(_wanted_level(nodes, _first_level(nodes, window, first), window, first), "windows")
    length, again, lengths = window, None, []
    while True:
        judged, path = written(_judged(level, length), "judged")
        delete(spark, old)
        again = saved(judged.where(F.size("again") > 0).select("node", "again"), "again") if again is None else again
        lengths.append(saved(judged.where("any").select("node", F.lit(length).cast("long").alias("length")), "lengths"))
        level, old = judged.where(F.size("at") > 0).select("node", "at", "h1", "h2"), path
        if level.isEmpty():
            delete(spark, old)
            break
        length *= 2
    longest = lengths[0]
    for more in lengths[1:]:
        longest = longest.union(more)
    return again, longest.groupBy("node").agg(F.max("length").alias("longest"))


def _spans(window: int):
    """node, text, again -> node, n_words, spans of words to remove as [begin, end), kept."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, begins, ends, kept = [], [], [], []
            for text, again in zip(batch["text"].to_pylist(), batch["again"], strict=True):
                found = text.split()  # bytes are cut at the six ASCII white-space characters
                at = np.sort(again.values.to_numpy()) if again.is_valid else np.zeros(0, np.int32)
                gap = np.flatnonzero(np.diff(at) > window)
                begin, end = at[np.concatenate([[0], gap + 1])] if len(at) else at, at[np.concatenate([gap, [-1]])] + window if len(at) else at
                n_words.append(len(found))
                begins.append(begin.tolist())
                ends.append(end.tolist())
                keep = np.zeros(len(found) + 1, np.int32)
                np.add.at(keep, begin, 1)
                np.add.at(keep, end, -1)
                kept.append(b" ".join([found[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0)] if len(at) else found))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (begins, ends)]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(n_words, pa.int64()), *lists, pa.array(kept, pa.binary())], ["node", "n_words", "begins", "ends", "kept"])

    return cut


def remove_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST, of_kept: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, spans, longest and the kept text of every row of docs.

    Removed are the words that a window of `window` words covers which also starts earlier: in a row of a smaller
    doc_id, or earlier in the same text. spans are the removed runs of words, [begin, end); longest is the longest of
    window, 2 * window, ... words that occurs more than once from a place in the text, or 0. kept is the words that are
    left, joined by one space, in UTF-8; of_kept makes other columns of it instead, while each text is one row. Words are runs of anything but ASCII white space.

    Null texts are empty and texts of fewer words than a window keep all. Rows with a null doc_id come after all others.
    Rows of one doc_id and text have one result, none removing the other's words; different texts of one doc_id are in
    the order of their SHA-256. Other columns of docs are not read. Equal texts are worked on once. Nothing is capped.
    """
    small_batches(docs.sparkSession)
    if window % first or (window // first) & (window // first - 1):
        raise ValueError("window must be first times a power of two")
    of_kept = {"kept": lambda kept: kept} if of_kept is None else of_kept
    with scratch(docs.sparkSession):
        numbers, nodes = texts_of(docs)
        again, longest = repeats(nodes, window, first)
        cut = nodes.join(again, "node", "left").select("node", "text", "again").mapInArrow(_spans(window), "node long, n_words long, begins array<int>, ends array<int>, kept binary")
        cut = cut.select("node", "n_words", F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end")).alias("spans"), *(f(F.col("kept")).alias(n) for n, f in of_kept.items()))
        result = saved(cut.join(longest, "node", "left").join(numbers, "node"), "cut", keep=True)
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))
    met = rows.join(result, "digest")
    gone = ~F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("n_words") >= window)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    all_words = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end")))
    return met.select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(removed).alias("n_removed"), F.when(gone, all_words).otherwise(F.col("spans")).alias("spans"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"), *(F.when(gone, f(F.unhex(F.lit("")))).otherwise(F.col(n)).alias(n) for n, f in of_kept.items()),
    )


def op13_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 20 words that start earlier: doc_id, n_words, n_removed,
    kept_sha256 (see remove_repeats, also for nulls, ties and repeated rows)."""
    left = remove_repeats(table(spark, sf_dir, "documents"), of_kept={"kept_sha256": lambda kept: F.sha2(kept, 256)})
    return left.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i+19], ' ')) AS h, md5(array_to_string(w[i:i+19], ' ')) AS m
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), firsts AS (
  SELECT h, m, min({'d': doc_id, 'i': i}) AS f FROM wins GROUP BY h, m HAVING count(*) > 1
), again AS (
  SELECT doc_id, wins.i FROM wins JOIN firsts USING (h, m) WHERE {'d': doc_id, 'i': wins.i} > f
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM again, (SELECT unnest(range(20)) AS k)
), per AS (
  SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)),
                                            lambda x: NOT list_contains(g, x[2])), lambda x: x[1]), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""
