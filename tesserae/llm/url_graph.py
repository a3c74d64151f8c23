"""URL filter: fixed host and path rules, and for the rest a verdict from the link graph of hosts. DataFrame functions only.

Edges lead from a page's host to the other known hosts that its HTML links to or names, weighted by how often. Hosts of
pages that a rule allows are trusted seeds, hosts of pages that a rule blocks are distrusted ones, each weighted by its
pages. Trust flows along the edges as personalised PageRank; distrust flows against them. A host is blocked where its
distrust exceeds its trust.

Cases: null urls and urls without "://" have an empty host and path, fit no rule and are allowed; null HTML has no links;
repeated pages count again; rows with one page_id or none are rows of their own; very long urls and HTML are read whole;
without seeds everything is allowed; where trust and distrust are equal, a host is allowed; an empty table gives an empty
result; other columns are ignored. After ROUNDS rounds at most DAMPING ** ROUNDS of the mass has not settled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import stage, unstage

#: (verdict, host, path); given by the operator's contract.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Share of trust passed on, and rounds: longer ways than that count for nothing.
DAMPING, ROUNDS = 0.85, 10
#: Names of hosts in HTML: labels joined by dots.
HOST_NAME = r"[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+"


def parts(pages: DataFrame) -> DataFrame:
    """pages with host and path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return pages.withColumn("_rest", rest).withColumn("host", F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)).withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)).drop("_rest")


def rule_columns(rules=None) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    name = verdict = None
    for what, host, path in sorted(RULES if rules is None else rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, n) between different known hosts."""
    named = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(HOST_NAME), F.lit(0))).alias("dst"))
    found = named.select("src", F.translate("dst", string.ascii_uppercase, string.ascii_lowercase).alias("dst")).where("src <> dst AND src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return found.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust). seeds: host, trust, distrust, each of whose columns sums to 1 or 0."""
    out_sum = links.groupBy("src").agg(F.sum("n").alias("out_n"))
    in_sum = links.groupBy("dst").agg(F.sum("n").alias("in_n"))
    weighted = links.join(out_sum, "src").join(in_sum, "dst")
    # both directions in one table: trust goes from src to dst, distrust from dst to src
    both = weighted.select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("n") / F.col("out_n")).alias("t"), F.lit(0.0).alias("d")).unionByName(
        weighted.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("in_n")).alias("d"))
    )
    both = stage(both.groupBy("at", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "links")
    base = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    state = seeds.select("host", "trust", "distrust")
    for k in range(rounds):
        sent = both.join(state, F.col("at") == F.col("host")).select(F.col("to").alias("host"), (F.col("trust") * F.col("t") * damping).alias("trust"), (F.col("distrust") * F.col("d") * damping).alias("distrust"))
        state = sent.unionByName(base).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if k % 5 == 4:
            state = stage(state, "trust")
    return state


def judged(pages: DataFrame, rules=None) -> DataFrame:
    """page_id, host, path, rule and verdict of each row."""
    rule, verdict = rule_columns(rules)
    own = parts(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).withColumn("rule", rule).withColumn("by_rule", verdict)
    counts = stage(
        own.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked")), "hosts"
    )
    total = counts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    share = lambda c, n: (F.col(c) / F.lit(float(n))) if n else F.lit(0.0)
    seeds = counts.select("host", share("allowed", total["a"]).alias("trust"), share("blocked", total["b"]).alias("distrust"))
    # staged: three sums read the links, and they are all that is taken from the HTML
    links = stage(edges(own.select("host", "html"), counts), "edges")
    scored = stage(propagate(links, seeds), "hosts-judged")
    unstage(links)
    out = own.select("page_id", "host", "path", "rule", "by_rule").join(scored, "host", "left")
    method = F.when(F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"))
