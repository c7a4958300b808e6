"""URL rules found by their rarest literal token.

Every rule is a pair of regular expressions for host and path. It is indexed under the one of its literal tokens
that the fewest urls hold. A url fetches candidate rules by its tokens, and only candidates run their expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import UPPER, broadcast_if_bounded, store

RULE_SCHEMA = "rule string, action string, host_regex string, path_regex string, tokens array<string>, rank int, shown boolean"

#: Words that block a host when they stand between non-alphanumerics. Fixed values of the method.
BLOCKED_HOST_WORDS = ("spam", "pills", "casino", "poker", "porn", "xxx", "viagra", "malware", "phishing", "warez")


def host_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, action): a host with its subdomains, and the start of a path."""
    rows = []
    for host, path, action in rules:
        words = re.findall("[a-z0-9]+", host.lower())
        # the last word of a path prefix may go on in the url, so only closed words are literal tokens
        words += re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
        rows.append((host + path, action, rf"(?s)^(?:.*\.)?{_quoted(host)}\z", rf"(?s)^{_quoted(path)}", sorted(set(words)), 1, True))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def word_rules(spark: SparkSession, words: tuple[str, ...] = BLOCKED_HOST_WORDS) -> DataFrame:
    """Rules of the method: block hosts that hold a word of the list."""
    rows = [(w, "block", rf"(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|\z)", "", [w], 0, False) for w in words]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _quoted(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", literal)


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without a host."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def index_rules(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """The rules, each with the token of its own that the fewest urls hold; no token: the empty one, which all hold."""
    wanted = rules.select("*", F.explode_outer("tokens").alias("token")).drop("tokens").fillna("", ["token"])
    known, _ = broadcast_if_bounded(wanted.select("token").distinct())
    counts = url_tokens.join(known, "token").groupBy("token").agg(F.count("*").alias("urls"))
    order = F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), F.col("token").alias("token"))
    names = [c for c in wanted.columns if c != "token"]
    rarest = wanted.join(counts, "token", "left").groupBy(*names).agg(F.min(order).alias("rarest"))
    return rarest.select(*names, F.col("rarest.token").alias("token"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to every row.

    Of the rules that fit, the highest rank wins, then the longest, then the first in order; without one the verdict
    is allow. Rules that are not shown leave ``rule`` null. A null url or one without :// has an empty host and path
    and fits no host rule. Repeated urls are judged once; rows are never merged. Input columns named like the four
    results are replaced. An empty table gives an empty one.
    """
    own = {"host", "path", "rule", "verdict"}
    rows = pages.select(*[c for c in pages.columns if c not in own], url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    urls = store(rows.select("host", "path").distinct())
    # A-Z only: lower() would turn other signs, such as that of Kelvin, into letters of a token
    plain = F.translate(F.concat_ws("/", "host", "path"), UPPER, UPPER.lower())
    words = F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))
    url_tokens = urls.select("host", "path", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), words))).alias("token"))
    index, _ = broadcast_if_bounded(store(index_rules(rules, url_tokens)))
    fits = F.expr("regexp_like(host, host_regex) and regexp_like(path, path_regex)")
    best = F.max(F.struct("rank", F.length("rule").alias("size"), "rule", "action", "shown"))
    judged = url_tokens.join(index, "token").where(fits).groupBy("host", "path").agg(best.alias("best"))
    return rows.join(judged, ["host", "path"], "left").select(
        *[c for c in rows.columns if c not in own], "host", "path",
        F.when(F.col("best.shown"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
    )
