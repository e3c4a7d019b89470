"""URL filtering by rules and link-graph propagation.

Personalised PageRank spreads trust along host edges from hosts with allowed pages, and distrust against them from
hosts with blocked pages; a host whose distrust outweighs its trust is blocked. A rule decides a page before its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.llm.common import saved, table

#: (verdict, rule): a host, and with the first "/" a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: absolute links between hosts, counted, and an edge each way between a host and its parent.

    Parents are the host without its first label, down to two labels. Links within a host move nothing and are left out.
    """
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("url"))
    links = links.select("src", host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit(":"), "url")).otherwise(F.col("url"))).alias("dst"))
    counted = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = pages.where("host like '%.%.%'").select("host").distinct()
    up = hosts.select(F.explode(F.arrays_zip(chain.alias("a"), F.slice(chain, 2, F.size(labels)).alias("b"))).alias("e")).select("e.a", "e.b").where("b is not null and a <> '' and b <> ''").distinct()
    kin = up.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(up.select("b", "a")).withColumn("weight", F.lit(1.0))
    return counted.union(kin).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 12, per_table: int = 4) -> DataFrame:
    """host, trust and distrust after rounds of personalised PageRank.

    seeds has host, trust and distrust (any scale, not null). Trust follows the edges, distrust goes against them; both
    return to their seeds with 1 - damping. Every round is one join on host and one sum; each per_table rounds are
    written to the shared folder, which cuts the lineage. Without edges the seeds keep their shares.
    """
    total = seeds.agg(F.sum("trust"), F.sum("distrust")).first()
    of = lambda c, t: F.col(c) / F.lit(float(t)) if t else F.lit(0.0)
    seeds = saved(seeds.select("host", of("trust", total[0]).alias("trust"), of("distrust", total[1]).alias("distrust")), "seeds")
    out = edges.groupBy(F.col("src").alias("s")).agg(F.sum("weight").alias("out"))
    into = edges.groupBy(F.col("dst").alias("d")).agg(F.sum("weight").alias("into"))
    both = edges.join(out, F.col("src") == F.col("s")).join(into, F.col("dst") == F.col("d"))
    ahead = both.select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("weight") / F.col("out")).alias("t"), F.lit(0.0).alias("d"))
    back = both.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("weight") / F.col("into")).alias("d"))
    steps = saved(ahead.union(back), "steps")
    rank = seeds
    for k in range(rounds):
        moved = steps.join(rank, steps["from"] == rank["host"]).select(F.col("to").alias("host"), (F.col("trust") * F.col("t") * damping).alias("trust"), (F.col("distrust") * F.col("d") * damping).alias("distrust"))
        base = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
        rank = moved.union(base).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if (k + 1) % per_table == 0 or k + 1 == rounds:
            rank = saved(rank, "rank")
    return rank


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's share of trust, per row of pages.

    Seeds: a host's pages that rules allow count as its trust, those that rules block as its distrust. share is
    trust / (trust + distrust), null where neither reached the host; a page without a rule is blocked if its host's
    share is below the threshold, else allowed. A null url, or one without ://, has an empty host and path, fits no
    rule and is allowed; a null html has no links; repeated rows stay rows of their own; an empty table gives no rows.
    """
    told = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    told = told.withColumn("rule", rule).withColumn("says", says)
    edges = saved(host_edges(told), "edges")
    seeds = told.where("host <> ''").groupBy("host").agg(F.count_if(F.col("says") == "allow").cast("double").alias("trust"), F.count_if(F.col("says") == "block").cast("double").alias("distrust"))
    rank = propagate(edges, seeds)
    share = rank.select(F.col("host").alias("_host"), (F.col("trust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0))).alias("share"))
    judged = told.drop("html").join(share, F.col("host") == F.col("_host"), "left")
    method = F.when(F.coalesce(F.col("share"), F.lit(1.0)) < threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"), F.round("share", 6).alias("share"))


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
