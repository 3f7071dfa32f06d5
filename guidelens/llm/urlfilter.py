"""URL filters: pattern rules indexed by their rarest literal token; DataFrame functions only.

A rule is a host rule (`example.net/en/`: the host and all subdomains, paths that
start with `/en/`) or a pattern (`^ads^`: `^` is any character but a-z and 0-9, or
an end; `*` is anything). Every rule becomes a regular expression and the literal
tokens (runs of a-z, 0-9) that any match must hold as whole tokens. Token counts
over all URLs give each rule its rarest token; the tokens of a URL are joined with
that index, and only the rules found so run their regular expression. The longest
host rule that fits decides; without one, a URL is blocked if a pattern matches.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path:
from there up to `?`, `#` or the end. Null URLs and URLs without `://` have
neither, match nothing and are allowed. What a URL hits depends on the URL alone, so
the few hits are found by URL and joined to the pages: repeated rows and ids stay as
often as they are, and URLs of any length are taken whole. Rules without a whole token
are tried on every URL. Of host rules of equal length (ties) the last one given
decides. An empty table gives no rows. Columns other than page_id and url, whatever
their names, don't matter. The rule list is the caller's and is broadcast: at most
MAX_RULES rules, else a ValueError.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the contract: name (host and path), verdict.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Patterns that block where no host rule decides: advertising, tracking, gambling, adult sites, malware.
PATTERNS = ("^ads^", "^ad^", "^adserver^", "^banner^", "^doubleclick^", "^track^", "^tracker^", "^tracking^", "^casino^", "^poker^", "^betting^", "^gambling^", "^adult^", "^porn^", "^xxx^", "^malware^", "^phishing^", "^warez^")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    is_host: bool


def host_rule(name: str, verdict: str) -> Rule:
    tokens = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", name.lower())
    return Rule(name, verdict, r"^//(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9])", r"\\\1", name), tuple(tokens), True)


def pattern_rule(pattern: str) -> Rule:
    body = "".join("(?:^|[^a-z0-9]|$)" if c == "^" else ".*" if c == "*" else c if c.isalnum() else "\\" + c for c in pattern.strip("*"))  # anything at an end says nothing
    tokens = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", pattern)
    whole = [t for t in tokens if re.search(rf"[^a-z0-9*]{t}[^a-z0-9*]", pattern)]
    return Rule(pattern, "block", body, tuple(whole), False)


RULES = tuple(host_rule(*r) for r in HOST_RULES) + tuple(map(pattern_rule, PATTERNS))


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """rank (host rules by length of name, then as given), rule, verdict, is_host, regex, tokens."""
    rows = F.array(*(F.struct(F.lit((len(r.name) << 32) + i).alias("rank"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.is_host).alias("is_host"), F.lit(r.regex).alias("regex"), F.array(*map(F.lit, r.tokens or ("",))).alias("tokens")) for i, r in enumerate(rules)))
    return spark.range(1).select(F.inline(rows))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    base = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    if not rules:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    table = rule_table(pages.sparkSession, rules)
    exact = F.concat(F.lit("//"), host(F.col("url")), path(F.col("url")))
    found = F.array_distinct(F.regexp_extract_all(lowered(exact), F.lit("[a-z0-9]+"), 0))
    if not all(r.tokens for r in rules):  # rules without a token stand under the empty one, which every URL then has
        found = F.concat(F.array(F.lit("")), found)
    tokens = pages.where(F.col("url").isNotNull()).select("url", F.explode(found).alias("token"))

    wanted = table.select("rank", F.explode("tokens").alias("token"))
    counts = tokens.select("token").join(F.broadcast(wanted.select("token").distinct()), "token").groupBy("token").count()
    rarest = wanted.join(F.broadcast(counts), "token", "left").groupBy("rank").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    index = rarest.join(table.drop("tokens"), "rank")

    met = tokens.join(F.broadcast(index), "token").withColumn("exact", exact)
    fits = met.where(F.regexp_like(F.when(F.col("is_host"), F.col("exact")).otherwise(lowered(F.col("exact"))), F.col("regex")))
    best = F.max(F.when(F.col("is_host"), F.struct("rank", "rule", "verdict"))).alias("best")
    hits = fits.groupBy(F.col("url").alias("_url")).agg(best, F.max(F.when(~F.col("is_host"), F.col("verdict"))).alias("other"))
    out = base.join(hits, F.col("url") == F.col("_url"), "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "other", F.lit("allow")).alias("verdict"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def judged_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the same rows, rule by rule."""
    hosts = sorted((r for r in rules if r.is_host), key=lambda r: -len(r.name))
    case = lambda what: " ".join(f"WHEN regexp_matches('//' || host || path, {_text(r.regex)}) THEN {_text(what(r))}" for r in hosts)
    low = f"translate('//' || host || path, '{UPPER}', '{LOWER}')"
    pattern = " OR ".join(f"regexp_matches({low}, {_text(r.regex)})" for r in rules if not r.is_host)
    return f"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
      SELECT page_id, host, path, CASE {case(lambda r: r.name)} END AS rule,
        CASE {case(lambda r: r.verdict)} WHEN {pattern} THEN 'block' ELSE 'allow' END AS verdict FROM p"""
