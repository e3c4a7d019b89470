"""The queries that SQL can express, against DuckDB on the smallest tables, and hostile inputs for all operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemesh.llm import crf, divergence, linkgraph, mixing, neardup, packing, pivots, registry, sharding, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, label int"
LONG = "word " * 30_000
ROWS = [
    (1, "The cat sat on the mat and it was good.\nIt was the best of cats.", "en", "a", 5, "x", 0),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", 1),
    (4, " \t\n ", "de", None, 3, "y", 1),
    (5, LONG, "en", "b", len(LONG), "y", 0),
    (None, "no id here", "fr", "b", 1, None, None),
    (6, "The cat sat on the mat and it was good.\nIt was the best of cats.", "en", "c", 5, "x", 0),
    (6, "The cat sat on the mat and it was good.\nIt was the best of cats.", "en", "c", 5, "x", 0),
    (7, "émoji 😀 and ünïcödé   spaces", "xx", "ü", 9, "z", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def compare(df, sql):
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    rel = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    key = lambda row: tuple("\0" if x is None else repr(x) for x in row)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    compare(registry.queries()[name](spark, SF), registry.oracle_sql()[name])


def test_registry_has_one_query_for_each_operator():
    names = list(registry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names


def test_hostile_rows_classifiers(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 0, 1), (6, 1, None), (None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    chain, net = crf.fit(docs, labels), toxicity.fit(docs, labels)
    for scored in (crf.score_documents(docs, chain), toxicity.score_documents(docs, net)):
        rows = scored.collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert crf.score_documents(none, chain).count() == 0 == toxicity.score_documents(none, net).count()
    blank = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert crf.score_documents(docs, crf.fit(docs, blank)).count() == len(ROWS)
    assert toxicity.score_documents(docs, toxicity.fit(docs, blank)).where("score < 0.3").count() == len(ROWS)


def test_hostile_rows_rules(docs, none):
    got = {r["doc_id"]: r for r in divergence.judge(docs).collect()}
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[5]["n_words"] == 30_000 and got[5]["n_repeat_words"] == 30_000
    assert got[7]["n_words"] == 5
    assert divergence.judge(docs, "text", "size").columns[-2:] == ["text", "size"]
    assert divergence.judge(none).count() == 0


def test_hostile_rows_shards(docs, none):
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == len(ROWS)
    for shard in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {16}
    assert sharding.shard_documents(none, 4).count() == 0


def test_hostile_rows_near_duplicates(docs, none):
    got = [(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (6, 1), (6, 1), (7, 7), (None, None)], key=str)
    kept = sorted((r["doc_id"] for r in neardup.one_of_each(docs).collect()), key=str)
    assert kept == [1, 2, 4, 5, 7, None]
    assert neardup.near_duplicates(none).count() == 0
    clash = docs.select("*", *(F.lit(1).alias(c) for c in ("root", "own", "node", "least", "_own", "_node", "row")))
    assert neardup.one_of_each(clash).columns == clash.columns and neardup.one_of_each(clash).count() == 6


def test_hostile_rows_packing(spark, docs, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(packing.pieces(docs, path, ids=True))
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
    assert sum(r["doc_tokens"] == 1 for r in rows) == 2
    full = packing.sequences(packed).collect()
    assert sum(r["n_tokens"] for r in full) == sum(r["length"] for r in rows)
    assert all(len(r["ids"]) == 2048 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in full)
    assert packing.pack(packing.pieces(none, path)).count() == 0


def test_hostile_rows_mix(docs, none):
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.plan_mix(none).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    plan = mixing.plan_mix(docs, whole=True)
    copies = {(r["doc_id"], r["size"]): r["n"] for r in mixing.copies_of(plan).groupBy("doc_id", "size").agg(F.count("*").alias("n")).collect()}
    assert {(r["doc_id"], r["n_words"]): r["n"] for r in mixed.withColumn("n_words", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).groupBy("doc_id", "n_words").agg(F.count("*").alias("n")).collect()} == copies
    assert mixing.mix_documents(none).count() == 0


def test_hostile_rows_pages(spark):
    rows = [(1, "https://A.Example.com/en/9", "x" * 120), (2, None, None), (3, "no scheme", "x" * 120), (3, "http://h", ""), (None, "http://u.net/de/1?q#f", "x" * 120), (4, "http://a.example.com/en/7z", "y"), (4, "http://a.example.com/en/7z", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["path"]): r for r in linkgraph.filter_urls(pages).collect()}
    assert got[(1, "/en/9")]["verdict"] == "block" and got[(1, "/en/9")]["host"] == "a.example.com"
    assert got[(4, "/en/7z")]["rule"] == "example.com/en/7" and got[(4, "/en/7z")]["verdict"] == "allow"
    assert got[(2, "")]["host"] == "" and got[(2, "")]["verdict"] == "allow"
    folder, directory = warc.write_archive(pages)
    back = warc.read_archive(folder, directory, payloads=True).collect()
    assert len(back) == len(rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in back)
    assert kinds.count(("3", "revisit", 1)) == 1 and ("None", "revisit", 1) in kinds and ("1", "response", None) in kinds
    assert [r[0] for r in warc.lookup(folder, directory, ["http://a.example.com/en/7z", "http://nowhere"])] == [4, 4]
    assert linkgraph.filter_urls(pages.limit(0)).count() == 0
    folder, directory = warc.write_archive(pages.limit(0), "none")
    assert warc.read_archive(folder, directory).count() == 0


def test_index_lookup_reads_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 10)
    rows = [(i, f"http://host{i % 40}.org/p\t{i}" if i % 3 else f"http://host{i % 40}.org/\n", f"page {i} " * 30, "clash") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").withColumn("surt", F.lit(1))
    folder, directory = warc.write_archive(pages, "few")
    assert directory.count() >= 40
    for wanted in ("http://host7.org/p\t7", "http://host3.org/\n"):
        reads = spark.sparkContext.accumulator(0)
        key = spark.createDataFrame([(wanted,)] * 3, "url string").select(warc.url_key(F.col("url")))
        got = sorted(r["page_id"] for r in warc.find(folder, directory, key, payloads=True, reads=reads).collect())
        assert got == [i for i, url, _, _ in rows if url == wanted] and got
        assert 1 <= reads.value <= 3
    everything = warc.find(folder, directory, pages.select(warc.url_key(F.col("url"))), payloads=True).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in everything) == [(i, html) for i, _, html, _ in rows]


def test_hostile_rows_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, None]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, []), (7, [2.0]), (50, [1e6, -1e6]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = pivots.scaled(table, "vec_id", "embedding")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in pivots.search(v, v.where("id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 7), (0, 3, 1), (0, 4, 6), (50, 1, 7), (50, 2, 0), (50, 3, 1), (50, 4, 6)]
    assert pivots.search(v.limit(0), v.limit(0), 5).count() == 0
    clash = table.select("*", *(F.lit("x").alias(c) for c in ("id", "v", "row", "block", "floor")))
    v = pivots.numbered(pivots.scaled(clash, "vec_id", "embedding"))
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in pivots.search(v, v.where("id % 50 = 0"), 5).orderBy("query_id", "rank").collect()] == got
