"""WARC archives with a two-level capture index.

Tasks write gzip-member WARC files to a shared folder. The index has a line per record, sorted by reversed-host URL
key and cut into compressed blocks; a sparse directory has a row per block. A lookup searches the directory for the
blocks of its sorted keys, searches the blocks' sorted lines, both by bisection, and reads the records' byte ranges.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.llm.common import saved, shared_dir, small_batches, table
from tidemesh.llm.linkgraph import after_scheme, host_of

#: Payloads shorter than this are always stored; index lines in a block; bytes after which a task begins a new file.
MIN_REVISIT, BLOCK_LINES, FILE_BYTES = 100, 1000, 1 << 30
#: Bytes of a file that a task reads on end; bytes of payloads in a batch that it gives out.
STRETCH, HELD = 64 << 20, 8 << 20
DATE = "2024-01-01T00:00:00Z"
LINE = "surt string, page_id string, file string, offset long, length long"  # ids as text: pandas turns longs with nulls to floats


def url_key(url: Column) -> Column:
    """Reversed-host key: com,example,www)/path?query; what isn't a URL is its own key, null is empty.

    Tabs and line breaks, which end a field or line of the index, are percent-encoded in a key.
    """
    rest = F.regexp_replace(after_scheme(url), r"^[^/?#]*", "")
    turned = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    key = F.coalesce(F.when(F.instr(url, "://") > 0, F.concat(turned, F.lit(")"), rest)), url, F.lit(""))
    for raw, code in (("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        key = F.replace(key, F.lit(raw), F.lit(code))
    return key


def member(headers: list[tuple[str, object]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(body))] if v is not None)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + b"\r\n" + body + b"\r\n\r\n") + packer.flush()


def record(page_id: str | None, url: str | None, html: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit without its payload."""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\r\n]", "", url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", page_id),
        ("X-Payload-Length", len(html)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", refers_to)]
        return member(headers, http)
    return member(headers, http + html)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and its payload."""
    head, _, body = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, body[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def opened(folder: str):
    """(file system, path) of a URI; executors reach the shared folder by whatever scheme it has."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _own_name(kind: str) -> str:
    """A task attempt's file name: a second attempt never writes over the first."""
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId():08d}"


def writer(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = opened(folder)
        out, n, at, name = None, 0, 0, ""
        try:
            for pdf in batches:
                lines = []
                for row in pdf.itertuples(index=False):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, n, at = f"{_own_name('part')}-{n:04d}.warc.gz", n + 1, 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    page = row.page_id
                    data = record(page, row.url, bytes(row.html), row.digest, row.refers_to)
                    out.write(data)
                    lines.append((row.surt, page, name, at, len(data)))
                    at += len(data)
                yield pd.DataFrame(lines, columns=["surt", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def block_writer(folder: str):
    """Each partition of sorted lines becomes one index file of compressed blocks; yields the directory's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = opened(folder)
        out, at, name, rows, held = None, 0, _own_name("index") + ".gz", [], []

        def flush(lines: list[tuple]) -> None:
            nonlocal at
            data = zlib.compress("\n".join("\t".join("" if pd.isna(x) else str(x) for x in line) for line in lines).encode(), 6)
            out.write(data)
            rows.append((lines[0][0], lines[-1][0], name, at, len(data), len(lines)))
            at += len(data)

        for pdf in batches:
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            held += list(pdf.itertuples(index=False, name=None))
            while len(held) >= BLOCK_LINES:
                flush(held[:BLOCK_LINES])
                del held[:BLOCK_LINES]
        if held:
            flush(held)
        if out is not None:
            out.close()
        yield pd.DataFrame(rows, columns=["first_key", "last_key", "index_file", "offset", "length", "lines"])

    return run


def block_lines(folder: str, name: str, offset: int, length: int) -> list[list[str]]:
    """One block's lines, by a range read."""
    system, path = opened(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return [line.split("\t") for line in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]


def write_archive(pages: DataFrame, label: str = "warc") -> tuple[str, DataFrame]:
    """Writes WARC files and their index; returns the folder and the directory.

    The directory has a row per block: first_key, last_key, index_file, offset, length, lines. Of rows with equal
    payloads of MIN_REVISIT bytes or more, those with the smallest page_id (several, where rows share it) are responses
    and the others revisits of it; rows with a null page_id count as larger than all, and are responses where no row has one. A null html is an
    empty payload. Only files named in the index count: a lost attempt's files are never read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), url_key(F.col("url")).alias("surt"))
    long = rows.where(F.octet_length("html") >= MIN_REVISIT)
    first = long.groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = rows.join(first, F.col("digest") == F.col("_digest"), "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    told = told.select(F.col("page_id").cast("string"), "url", "html", "digest", "surt", F.col("refers_to").cast("string"))
    lines = saved(told.mapInPandas(writer(folder), LINE), "lines")
    ordered = lines.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
    blocks = ordered.mapInPandas(block_writer(folder), "first_key string, last_key string, index_file string, offset long, length long, lines int")
    return folder, saved(blocks, "directory")


RECORD = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}


def _records(folder: str, lines: pd.DataFrame, files: dict) -> Iterator[tuple]:
    """The records of some lines, with one open handle per file; what a record says of its payload must hold."""
    system, path = opened(folder)
    for name, offset, length, page in zip(lines["file"], lines["offset"], lines["length"], lines["page_id"], strict=True):
        if name not in files:
            if len(files) >= 32:
                files.pop(next(iter(files))).close()
            files[name] = system.open_input_file(f"{path}/{name}")
        headers, payload = parsed(files[name].read_at(int(length), int(offset)))
        kind, size, told = headers["WARC-Type"], int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, told):
            raise ValueError(f"the payload of {name} at {offset} doesn't have its length and digest")
        refers = headers.get("X-Refers-To-Page")
        yield int(page) if page else None, headers.get("WARC-Target-URI"), size, told, kind, int(refers) if refers else None, payload


def read_lines(folder: str, lines: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of index lines, by range reads; a task reads stretches of a file in order."""
    keep = [c for c in RECORD if payloads or c != "payload"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: dict = {}

        def batch(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=list(RECORD)).astype({"page_id": "Int64", "refers_to": "Int64"})[keep]

        for pdf in batches:
            rows, size = [], 0
            for row in _records(folder, pdf, files):
                rows.append(row if payloads else (*row[:-1], None))
                size += len(row[-1]) if payloads else 0
                if size > HELD:
                    yield batch(rows)
                    rows, size = [], 0
            yield batch(rows)
        for f in files.values():
            f.close()

    parts = max(12, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = lines.repartition(parts, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return placed.mapInPandas(run, ", ".join(f"{c} {RECORD[c]}" for c in keep))


def _as_lines(rows: list[list[str]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["surt", "page_id", "file", "offset", "length"]).astype({"offset": "int64", "length": "int64"})


def read_archive(folder: str, directory: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the index, block by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                yield _as_lines(block_lines(folder, b.index_file, b.offset, b.length))

    n = max(1, directory.sparkSession.sparkContext.defaultParallelism * 2)
    return read_lines(folder, directory.repartition(n, "index_file", "offset").mapInPandas(run, LINE), payloads)


def find(folder: str, directory: DataFrame, keys: DataFrame, payloads: bool = False, reads: Accumulator | None = None) -> DataFrame:
    """The records of all keys (a column; see url_key), each once, however often a key is asked for.

    A key goes to the index files whose range holds it: their ranges, one for each task that wrote the index, come to
    the driver. With an index file meet its keys and its part of the directory: sorted keys are bisected in the
    directory, each block that may hold one is read once (reads counts them), and keys are bisected in its lines. A key
    with many records is spread over many blocks and files, as lines are sorted by page_id too.
    """
    spark = directory.sparkSession
    ranges = directory.groupBy("index_file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("first", "last").collect()
    shared = spark.sparkContext.broadcast(tuple([r[c] for r in ranges] for c in ("index_file", "first", "last")))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, firsts, lasts = shared.value
        for pdf in batches:
            rows = [(names[k], key) for key in pdf["key"] for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pd.DataFrame(rows, columns=["index_file", "key"])

    def search(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("offset")
        firsts, lasts = list(blocks["first_key"]), list(blocks["last_key"])
        at, lines, line_keys, out = -1, [], [], []
        for key in sorted(asked["key"]):
            for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                if k != at:
                    b = blocks.iloc[k]
                    at, lines = k, block_lines(folder, b["index_file"], int(b["offset"]), int(b["length"]))
                    line_keys = [x[0] for x in lines]
                    if reads is not None:
                        reads.add(1)
                out += lines[bisect.bisect_left(line_keys, key) : bisect.bisect_right(line_keys, key)]
        return _as_lines(out)

    asked = keys.toDF("key").where("key is not null").distinct().mapInPandas(deal, "index_file string, key string")
    lines = asked.groupBy("index_file").cogroup(directory.groupBy("index_file")).applyInPandas(search, LINE)
    return read_lines(folder, lines, payloads)


def lookup(folder: str, directory: DataFrame, urls: list[str]) -> list[tuple]:
    """The records of some urls (a user's short list), with payloads; see find."""
    wanted = directory.sparkSession.createDataFrame([(u,) for u in urls], "url string").select(url_key(F.col("url")).alias("key"))
    return find(folder, directory, wanted, payloads=True).collect()


def op6_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, looked up by the page's url through the index (see write_archive and find)."""
    pages = table(spark, sf_dir, "pages")
    folder, directory = write_archive(pages)
    return find(folder, directory, pages.select(url_key(F.col("url")))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
