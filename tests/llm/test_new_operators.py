"""Divergence trees, segment negatives and substring doubling against brute force and on hostile inputs."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemesh.llm import divergence_trees, negatives, pivots, substrings
from tidemesh.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, node int, at string, rank int, number long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, "x", 2, 3) for i, t, lang, source in rows], DOCS)


# --- substring doubling


def brute_repeats(rows, window):
    """doc_id -> (words, removed, kept words joined, longest) by sets of all windows; doc_ids are unique."""
    texts = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first, places = {}, Counter()
    for i in sorted(texts):
        w = texts[i]
        for at in range(len(w) - window + 1):
            first.setdefault(tuple(w[at : at + window]), (i, at))
    for length in (window * 2**k for k in range(12)):
        for w in texts.values():
            places.update(tuple(w[at : at + length]) for at in range(len(w) - length + 1))
    out = {}
    for i, w in texts.items():
        gone = {at + k for at in range(len(w) - window + 1) if first[tuple(w[at : at + window])] != (i, at) for k in range(window)}
        longest = max([0, *(length for length in (window * 2**k for k in range(12)) for at in range(len(w) - length + 1) if places[tuple(w[at : at + length])] > 1)])
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), longest)
    return out


def test_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(4000)}"
    passage = [word() for _ in range(90)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(int(rng.integers(0, 160)))]
        if i % 3 == 0:
            low = int(rng.integers(0, 40))
            w[len(w) // 2 : len(w) // 2] = passage[low : low + int(rng.integers(15, 50))]
        if i % 7 == 0:
            w += w[:25] + ["x"] + w[:19]
        rows.append((i * 3, ("\t " if i % 2 else "\n").join(w)))
    rows += [(500, " ".join(["la"] * 300)), (501, "la " * 21), (502, rows[9][1]), (503, rows[9][1].replace("\n", "  ")), (504, None), (505, ""), (506, " \n\v "), (507, "é ü " * 40)]
    df = docs_of(spark, [(i, t, None, None) for i, t in rows])
    for window, first in ((20, 10), (20, 20), (8, 1)):
        got = {r["doc_id"]: r for r in substrings.remove_repeats(df, window, first).collect()}
        want = brute_repeats(rows, window)
        assert got.keys() == want.keys()
        for i, (n, removed, kept, longest) in want.items():
            r = got[i]
            assert (r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) == (n, removed, kept), (window, i)
            assert removed == sum(s["end"] - s["begin"] for s in r["spans"])
            if hash_copy := [j for j, t in rows if j < i and t == dict(rows)[i]]:
                assert removed in (0, n) and hash_copy
            else:
                texts = {t for _, t in rows}
                alone = brute_repeats([(k, t) for k, t in enumerate(texts)], window)
                assert r["longest"] == alone[list(texts).index(dict(rows)[i])][3]


def test_repeats_of_hostile_rows(spark):
    text, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(10)) + " " + " ".join(f"a{i}" for i in range(30))
    rows = [(None, text), (4, text), (4, text), (4, other), (9, text), (9, "short text"), (None, "short text"), (2, None)]
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(docs_of(spark, [(i, t, None, None) for i, t in rows])).collect()]
    first = hashlib.sha256(text.encode()).digest() < hashlib.sha256(other.encode()).digest()
    want = [(None, 30, 30), (9, 30, 30), (9, 2, 0), (None, 2, 0), (2, 0, 0), *[(4, 30, 0 if first else 30)] * 2, (4, 40, 30 if first else 0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substrings.remove_repeats(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs_of(spark, []), 20, 7)


def test_word_fingerprints():
    texts = [b"one two  two\none", b"", b" two\x0bone\x1ctwo ", "é é".encode() + b"\x85"]
    (a, b), of = substrings.words(texts)
    found = [w for t in texts for w in t.split()]
    assert len(a) == len(found) and of.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    assert len({*zip(a.tolist(), b.tolist(), strict=True)}) == len({*found}) == len({*a.tolist()})
    pair = substrings.windows((a, b), 2)[0]
    assert len({*pair.tolist()}) == len({*zip(found, found[1:], strict=False)})
    assert substrings.words([b""])[1].size == 0 and substrings.windows(substrings.words([b"a"])[0], 4)[0].size == 0


# --- divergence trees


def brute_audit(rows, documents):
    terms = [[t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")] for _, text, _, _ in rows]
    groups, in_docs, out = defaultdict(Counter), defaultdict(Counter), []
    for (_, _, lang, source), found in zip(rows, terms, strict=True):
        groups[(lang or "", source or "")].update(found)
        in_docs[lang or ""].update(set(found))
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in in_docs[lang].items() if n >= documents), key=str.encode)
        own = {g[1]: c for g, c in groups.items() if g[0] == lang}
        whole = sum(own.values(), Counter())

        def share(c, kept=kept):
            return {t: 1 + int(Fraction(10**9 * (c[t] + 2), sum(c[k] for k in kept) + 2 * len(kept))) for t in kept}

        def cost(p, q):
            return int(Fraction((p - q) ** 2, p + q))

        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            pairs = [(-sum(cost(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            few = [(-cost(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", few, 10)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(found)[:most])]
    return out


def test_audit_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in ("ant", "Öl", "été", "中") for b in ("", "a", "b", "zz", "é")]
    rows = [(i, " 1-".join(rng.choice(vocabulary, int(rng.integers(0, 30)))), [None, "en", "de"][i % 3], ["a", "b", None, "ü", "c", "d"][int(rng.integers(0, 6))]) for i in range(90)]
    rows += [(i, t, "en", "quiet") for i, t in ((None, None), (91, ""), (91, "\x00[`{ 12"))] + [(95, "word", "xx", "p"), (96, None, "xx", "q"), (97, "word", "xx", "q"), (98, None, "alone", "p")] + [(99, "ant anta " * 20_000, "de", "a")] * 2
    for chunk, sources, held in ((1 << 12, 64, 200_000), (4, 2, 3)):
        for name, value in (("CHUNK", chunk), ("SOURCES", sources), ("HELD", held)):
            monkeypatch.setattr(divergence_trees, name, value)
        got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence_trees.audit(docs_of(spark, rows)).collect()]
        assert sorted(got) == sorted(brute_audit(rows, 10))
    assert divergence_trees.audit(docs_of(spark, [])).count() == 0


def test_forest_shares_subtrees_and_prices_pairs_once(monkeypatch):
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (6, 700)) * (rng.random((6, 700)) < 0.02)
    forest = divergence_trees.Forest(counts)
    assert sum(len(n) for n, _ in forest.levels) + len(forest.leaves) < 6 * 1023 / 4
    calls = []
    plain = divergence_trees.price
    monkeypatch.setattr(divergence_trees, "price", lambda p, q: calls.append(len(p)) or plain(p, q))
    share = [divergence_trees.shares(np.maximum(forest.leaves, 0), int(c.sum()), 700) for c in counts]
    for i in range(6):
        for j in range(6):
            p, q = (divergence_trees.shares(counts[k], int(counts[k].sum()), 700) for k in (i, j))
            assert forest.total(i, j, share[i], share[j]) == int(plain(p, q).sum())
    assert max(calls) <= 10
    large = np.array([0, 3, 10**15])
    assert divergence_trees.shares(large, 10**15 + 3, 3).tolist() == [1 + 10**9 * (int(c) + 2) // (10**15 + 9) for c in large]


# --- segment negatives


def brute_negatives(rows, every):
    kept = [(n, i, label, [int(np.floor(256 * np.float32(x))) for x in v]) for n, (i, label, v) in enumerate(rows) if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a[3], b[3], strict=False))
    for a in kept:
        if a[1] is None or a[1] % every:
            continue
        ranked = sorted(((-score(a, c), c[1] is None, c[1] or 0, c[0], c) for c in kept if c[0] != a[0]), key=lambda t: t[:4])
        for p in [r for r in ranked if r[4][2] == a[2]][:5]:
            fits = [r for r in ranked if r[4][2] != a[2] and -30 * p[0] <= -100 * r[0] <= -90 * p[0]][:10]
            out += [(a[1], p[4][1], k + 1, r[4][1], -p[0], -r[0]) for k, r in enumerate(fits)]
    return out


def mined(df, every, **more):
    v = pivots.scaled(df, "vec_id", "embedding", F.col("label").cast("long").alias("label"))
    return [tuple(r) for r in negatives.mine(v, f"id % {every} = 0", **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


@pytest.mark.parametrize("block", [4096, 16])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CHUNK", 8 if block == 16 else 2048)
    monkeypatch.setattr(negatives, "PAGE", 8 if block == 16 else 256)
    monkeypatch.setattr(negatives, "SAMPLE", 40)
    monkeypatch.setattr(negatives, "TILE", 8 if block == 16 else 512)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 24))
    rows = [(i if i != 77 else None, int(i % 4) if i % 50 else None, [float(np.float32(x)) for x in centres[(i + i // 40) % 4] + 0.3 * rng.normal(size=24)]) for i in range(300)]
    rows += [(100, 0, rows[10][2]), (100, 0, rows[10][2]), (600, 1, []), (601, 2, None), (602, 2, [1.0, None]), (603, 2, [float("nan")]), (604, 3, [float("inf")]), (605, 1, [2.0, 1.0]), (None, 2, rows[10][2]), *[(700 + i, 3, rows[11][2]) for i in range(30)], (1000, 9, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").select("*", *(F.lit(1).alias(c) for c in ("id", "v", "row", "none", "cell", "cut")))
    got = mined(df, 10)
    assert sorted(got, key=str) == sorted(brute_negatives(rows, 10), key=str) and len(got) > 200
    assert mined(df.limit(0), 10) == []


def test_segment_bounds_hold_and_tighten():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(50, 37)), rng.normal(size=(50, 37))
    exact, room = (x * q).sum(1), []
    for (mx, dx, n), (mq, dq, _) in zip(negatives.levels(*negatives.summaries(x), 3), negatives.levels(*negatives.summaries(q), 3), strict=True):
        middle, r = n * (mx * mq).sum(1), (dx * dq).sum(1)
        assert (np.abs(exact - middle) <= r + 1e-9).all()
        room.append(r)
    assert all((b <= a + 1e-9).all() for a, b in zip(room, room[1:], strict=False))


def test_negatives_of_clusters_score_few_vectors(spark):
    rng = np.random.default_rng(6)
    centres = np.repeat(rng.normal(size=(20, 16)), 4, 1)
    rows = [(i, int(i % 20) // 2, (centres[i % 20] + 0.02 * rng.normal(size=64)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    seen = spark.sparkContext.accumulator(0)
    got = mined(df, 200, seen=seen)
    assert sorted(got) == sorted(brute_negatives(rows, 200))
    assert seen.value < 0.5 * 20 * 4000 * 2


def test_operators_leave_only_their_results(spark, tmp_path):
    import os

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    df = docs_of(spark, [(i, "some words here " * 20, "en", f"s{i % 3}") for i in range(20)])
    for made in (lambda: divergence_trees.audit(df), lambda: substrings.remove_repeats(df)):
        made().count()
        new = {n for n in os.listdir(folder) if not n.startswith(".")} - before
        assert len(new) == 1
        before |= new


def test_pipeline_deletes_what_stages_have_read(spark):
    import os

    import corpus_pipeline

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    left = {n.split("-")[0] for n in set(os.listdir(folder)) - before}
    assert left <= {"curriculum_mix", "pieces", "classes"} and "curriculum_mix" in left
