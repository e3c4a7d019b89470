"""Quality rules by distribution divergence.

Every document's character-class and common-word histograms are compared with references of its language by
Jensen-Shannon distance. The references are sums over all documents of a language. All work is DataFrame functions on
the JVM: one pass over the texts, whose small counts are written once, and one over those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.llm.common import WORD, saved, table

# Common words of the languages that have a reference.
COMMON = {
    "en": "the of and to in a is that for it as with was on be by this are at from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
CLASSES = ("upper", "digit", "symbol", "point", "space", "other")
SYMBOLS = r"[#*$%&|<>]"
POINTS = r"[.,;:!?'\"()\-]"

#: Distances (0 to 1) above which a document goes, and how much text a comparison needs.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.2, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.26, 150


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read but never compute again, as a generator's output isn't inlined."""
    made = F.struct(*(c.alias(k) for k, c in columns.items()))
    return df.select("*", F.inline(F.array(made)))


def _covered(at: str, most: str) -> Column:
    """Words in windows of three that begin at the positions of a sorted array, each word once."""
    gaps = F.arrays_zip(F.col(at).alias("at"), F.slice(at, 2, F.greatest(F.col(most), F.lit(1))).alias("next"))
    step = F.lit(3).cast("long")
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda n, s: n + F.coalesce(F.least(s["next"] - s["at"], step), step))


def repeated_words(df: DataFrame, words: str, n_words: str, out: str) -> DataFrame:
    """Adds out: words that stand in a window of three words found twice or more in the row's array, first included.

    A window's hash and its position share one long: as many low bits as positions need, the others (48 of 63 at
    20,000 words) from the hash. Sorted, equal windows are neighbours. Neighbours whose hashes are equal are compared word
    by word; a row where any of these differ is counted again by sorting the windows' words themselves, so counts are exact.
    """
    m = F.greatest(F.col(n_words).cast("int") - 2, F.lit(0))
    df = _held(df, _m=m, _p=F.pow(F.lit(2.0), F.ceil(F.log2(m + 1.0))).cast("long"))
    df = _held(df, _high=F.lit(2**63 - 1) - (F.col("_p") - 1))
    three = F.arrays_zip(*(F.slice(words, k, F.col("_m")).alias(f"w{k}") for k in (1, 2, 3)))
    df = _held(df, _s=F.sort_array(F.transform(three, lambda s, i: _window_hash(s).bitwiseAND(F.col("_high")) + i)))
    # codes are not negative, so two of one hash differ in low bits only: one comparison for each window
    code = lambda i: F.get("_s", i)
    firsts = F.when(F.col("_m") > 1, F.sequence(F.lit(0), F.col("_m") - 2)).otherwise(F.array().cast("array<int>"))
    df = _held(df, _met=F.filter(firsts, lambda i: code(i).bitwiseXOR(code(i + 1)) < F.col("_p")))
    place = lambda x: x.bitwiseAND(F.col("_p") - 1)
    df = _held(df, _pairs=F.transform("_met", lambda i: F.struct(place(code(i)).alias("a"), place(code(i + 1)).alias("b"))))
    word = lambda at, k: F.get(F.col(words), (at + k).cast("int"))
    unlike = lambda s: ~((word(s["a"], 0) == word(s["b"], 0)) & (word(s["a"], 1) == word(s["b"], 1)) & (word(s["a"], 2) == word(s["b"], 2)))
    df = _held(df, _at=F.sort_array(F.array_distinct(F.concat("_pairs.a", "_pairs.b"))), _clash=F.exists("_pairs", unlike))
    # the windows themselves, for the rows where hashes clash
    spelt = F.sort_array(F.transform(three, lambda s, i: F.struct(s["w1"].alias("a"), s["w2"].alias("b"), s["w3"].alias("c"), i.cast("long").alias("i"))))
    df = _held(df, _w=F.when(F.col("_clash"), spelt))
    pairs = F.arrays_zip(F.col("_w").alias("at"), F.slice("_w", 2, F.greatest(F.col("_m"), F.lit(1))).alias("next"), F.concat(F.array(F.get("_w", F.lit(-1))), F.col("_w")).alias("last"))
    equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    found = F.transform(F.filter(pairs, lambda s: equal(s["at"], s["next"]) | equal(s["at"], s["last"])), lambda s: s["at"]["i"])
    df = _held(df, _exact=F.when(F.col("_clash"), F.sort_array(F.filter(found, lambda i: i.isNotNull()))).otherwise(F.col("_at")))
    return df.withColumn(out, _covered("_exact", "_m")).drop("_m", "_p", "_high", "_s", "_met", "_pairs", "_at", "_clash", "_w", "_exact")


def _window_hash(window: Column) -> Column:
    return F.xxhash64(window["w1"], window["w2"], window["w3"])


def text_counts(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, lang, the base counts, n_chars, the character classes and hist (word number, count) per row.

    The columns of carry come along in one struct, _carry, so that no name of theirs clashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "lang", (F.struct(*carry) if carry else F.lit(None).cast("int")).alias("_carry"), text.alias("_text"))
    df = _held(df, _words=F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    common = F.filter("_words", lambda w: F.lower(w).isin(*WORDS))
    df = _held(df, n_words=F.size("_words").cast("long"), _lines=lines, _ids=F.transform(common, lambda w: F.array_position(F.array(*map(F.lit, WORDS)), F.lower(w)).cast("int")))
    n_of = lambda k: F.size("_ids") - F.size(F.filter("_ids", lambda i: i != k))
    df = df.select(
        "*",
        F.length("_text").cast("long").alias("n_chars"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("upper"),
        F.regexp_count("_text", F.lit("[0-9]")).cast("long").alias("digit"),
        F.regexp_count("_text", F.lit(POINTS)).cast("long").alias("point"),
        F.transform(F.array_distinct("_ids"), lambda k: F.struct(k.alias("k"), n_of(k).cast("long").alias("n"))).alias("hist"),
    )
    df = repeated_words(df, "_words", "n_words", "n_repeat_words")
    df = df.withColumn("symbol", F.col("n_symbols")).withColumn("space", F.col("n_chars") - F.col("word_chars"))
    df = df.withColumn("other", F.col("n_chars") - F.col("upper") - F.col("digit") - F.col("symbol") - F.col("point") - F.col("space"))
    return df.drop("_text", "_words", "_lines", "_ids")


def references(counts: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Per language of COMMON found: shares of the character classes, and of the common words with all others last.

    At most a row for each language and word comes to the driver.
    """
    known = counts.where(F.col("lang").isin(*COMMON))
    chars = known.groupBy("lang").agg(*(F.sum(c).alias(c) for c in CLASSES), F.sum("n_words").alias("words")).collect()
    hist = known.select("lang", F.inline("hist")).groupBy("lang", "k").agg(F.sum("n").alias("n")).collect()
    out = {}
    for row in chars:
        word = [0] * len(WORDS)
        for h in hist:
            if h["lang"] == row["lang"]:
                word[h["k"] - 1] = h["n"]
        word.append(row["words"] - sum(word))
        char = [row[c] for c in CLASSES]
        if sum(char) and row["words"]:
            out[row["lang"]] = [c / sum(char) for c in char], [w / row["words"] for w in word]
    return out


def _divergence(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence in bits."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return (part(p) + part(q)) / 2


def char_distance(reference: list[float]) -> Column:
    parts = [_divergence(F.col(c) / F.col("n_chars"), F.lit(q)) for c, q in zip(CLASSES, reference, strict=True)]
    return F.when(F.col("n_chars") > 0, F.sqrt(F.greatest(F.lit(0.0), sum(parts[1:], parts[0]))))


def word_distance(reference: list[float]) -> Column:
    """Only words that the document has are visited: a bin without any adds half its reference share."""
    shares = F.array(*map(F.lit, reference))
    seen = F.aggregate("hist", F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"), F.lit(0).cast("long").alias("n")), lambda a, h: F.struct((a["d"] + _divergence(h["n"] / F.col("n_words"), F.element_at(shares, h["k"]))).alias("d"), (a["q"] + F.element_at(shares, h["k"])).alias("q"), (a["n"] + h["n"]).alias("n")))
    rest = F.lit(reference[-1])
    total = F.transform(F.array(seen), lambda a: a["d"] + (1.0 - rest - a["q"]) / 2 + _divergence((F.col("n_words") - a["n"]) / F.col("n_words"), rest))[0]
    return F.when(F.col("n_words") > 0, F.sqrt(F.greatest(F.lit(0.0), total)))


def judge(docs: DataFrame, *carry: str) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance and word_distance (to the nearest reference), and the columns of carry.

    A null text counts as empty: no words, base_failed, null distances. A document shorter than MIN_CHARS or MIN_WORDS
    isn't held to that distance. Without any document in a language of COMMON there are no references, and only the
    base rules decide. The lang column only sorts documents into references: a document of any or no language is
    compared with all of them. Repeated rows stay rows of their own; an empty table gives no rows.
    """
    counts = saved(text_counts(docs, *carry), "divergence")
    found = references(counts)
    least = lambda columns: F.least(*columns) if len(columns) > 1 else columns[0] if columns else F.lit(None).cast("double")
    counts = counts.withColumn("char_distance", least([char_distance(c) for c, _ in found.values()]))
    counts = counts.withColumn("word_distance", least([word_distance(w) for _, w in found.values()]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = (F.col("n_chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)
    odd = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    kept = ~failed & ~F.coalesce(far, F.lit(False)) & ~F.coalesce(odd, F.lit(False))
    counts = counts.withColumn("base_failed", failed).withColumn("kept", kept)
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance", *(["_carry.*"] if carry else []))


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of every document (see judge)."""
    return judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


_LANGS = ", ".join(f"'{x}'" for x in COMMON)
_LIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
_PART = "(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END) / 2"
OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), wins AS (
  SELECT r, i, [w[i], w[i+1], w[i+2]] AS v FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM wins) WHERE c > 1
), reps AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), c AS (
  SELECT d.r, doc_id, lang, len(w)::BIGINT AS n_words, length(t)::BIGINT AS n_chars,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS upper, len(regexp_extract_all(t, '[0-9]'))::BIGINT AS digit,
         len(regexp_extract_all(t, '[.,;:!?''"()\-]'))::BIGINT AS point
  FROM d LEFT JOIN lines USING (r) LEFT JOIN reps USING (r)
), cls AS (
  SELECT r, lang, n_chars, unnest([0, 1, 2, 3, 4, 5]) AS k,
         unnest([upper, digit, n_symbols, point, n_chars - word_chars,
                 n_chars - upper - digit - n_symbols - point - (n_chars - word_chars)]) AS n FROM c
), cref AS (
  SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cls WHERE lang IN ({_LANGS}) GROUP BY lang, k
), cdist AS (
  SELECT r, min(s) AS s FROM (
    SELECT r, cref.lang, sqrt(greatest(0, sum({_PART.format(p="(n / n_chars)", q="q")}))) AS s
    FROM cls JOIN cref USING (k) WHERE n_chars > 0 GROUP BY r, cref.lang) GROUP BY r
), bins AS (
  SELECT r, k, count(*) AS n FROM (SELECT r, list_position({_LIST}, lower(x)) AS k FROM (SELECT r, unnest(w) AS x FROM d))
  WHERE k > 0 GROUP BY r, k
), h AS (
  SELECT r, lang, n_words, k, coalesce(bins.n, 0) AS n
  FROM (SELECT * FROM c CROSS JOIN (SELECT unnest(range(1, {len(WORDS) + 1})) AS k)) LEFT JOIN bins USING (r, k) WHERE n_words > 0
), hist AS (
  SELECT * FROM h UNION ALL SELECT r, any_value(lang), any_value(n_words), 0, any_value(n_words) - sum(n) FROM h GROUP BY r
), wref AS (
  SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM hist WHERE lang IN ({_LANGS}) GROUP BY lang, k
), wdist AS (
  SELECT r, min(s) AS s FROM (
    SELECT r, wref.lang, sqrt(greatest(0, sum({_PART.format(p="(n / n_words)", q="q")}))) AS s
    FROM hist JOIN wref USING (k) GROUP BY r, wref.lang) GROUP BY r
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(n_chars >= {MIN_CHARS} AND cdist.s > {MAX_CHAR_DISTANCE}, false)
       AND NOT coalesce(n_words >= {MIN_WORDS} AND wdist.s > {MAX_WORD_DISTANCE}, false) AS kept
FROM v LEFT JOIN cdist USING (r) LEFT JOIN wdist USING (r)
"""
