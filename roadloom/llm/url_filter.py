"""URL rules looked up by short hashes of host-suffix and path-prefix expressions.

A rule names a host and the beginning of a path, as in ``example.org/en/``. A URL is
expanded into the suffixes of its host, and those that hash to the same short prefix as a
host with rules are joined with it; the full digest then confirms the host. A confirmed
host is expanded into expressions, the host with each beginning of the path that is as long
as one of its rules' paths; these are joined with the rules in the same way, by a short
prefix that the full digest confirms. The longest matching rule decides; a URL without one
gets the default verdict.

The lengths come from the rules as data, so the plan is the same for any number of rules,
and a URL is expanded by the rules of its own hosts only.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
in lower case; the path goes on up to ``?``, ``#`` or the end. A null URL, or one without
``://``, has an empty host and path and matches no rule. Equal rows are judged once and
returned as often as they came; a null id is kept. Rules with a null or empty host or a
null path never match; of several equal rules one counts, ``block`` before ``allow``. Very
long URLs are read as a whole. Empty tables of pages give no rows, empty tables of rules
the default verdict; columns other than the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of the SHA-256 digest that the join uses: 32 bits.
PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hot expressions are spread over so many keys in joins that are not broadcast.
SALTS = 16


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (host, path, verdict) rows."""
    rows = [F.struct(*(F.lit(value).cast("string").alias(name) for name, value in zip(("host", "path", "verdict"), rule))) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_parts(url: str):
    """Host and path columns of a URL column."""
    pattern = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    host = F.expr(f"translate(coalesce(regexp_extract({url}, r{pattern}, 1), ''), '{UPPER}', '{LOWER}')")
    return host, F.expr(f"coalesce(regexp_extract({url}, r{pattern}, 2), '')")


def _hashed(text, name: str):
    """The full digest of a text and its short prefix, as columns named after ``name``."""
    digest = F.sha2(text, 256)
    return digest.alias(f"_{name}_full"), F.substring(digest, 1, PREFIX_DIGITS).alias(f"_{name}_prefix")


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """A row per page: its host and path, the rule that decides, and the verdict."""
    listed = rules.where("host <> '' AND path IS NOT NULL").groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(
        F.max("verdict").alias("_verdict")  # of equal rules, block comes after allow
    )
    # The line feed keeps hosts and paths apart; no rule's host holds one that a URL's host could match.
    by_host = _salted(listed.groupBy("_host").agg(F.array_sort(F.collect_set(F.length("_path"))).alias("_lengths")).select("_lengths", *_hashed(F.col("_host"), "host")))
    by_rule = _salted(listed.select(F.concat("_host", "_path").alias("_rule"), "_verdict", *_hashed(F.concat("_host", F.lit("\n"), "_path"), "rule")))
    host, path = url_parts("url")
    # Equal rows travel as one with their number, so that a hot URL is one row.
    seen = (
        pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
        .groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("_copies"))
        .select("page_id", "url", "_copies", host.alias("host"), path.alias("path"))
        .withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    )
    every_suffix = F.expr("transform(IF(host <> '', sequence(1, size(split(host, '[.]'))), NULL), k -> substring_index(host, '.', -k))")
    suffixes = seen.withColumn("_suffix", F.explode_outer(every_suffix)).select("*", *_hashed(F.col("_suffix"), "suffix"))
    hosts = suffixes.join(
        by_host, (F.col("_suffix_prefix") == F.col("_host_prefix")) & (suffixes["_salt"] == by_host["_salt"]), "left"
    ).drop(by_host["_salt"])
    # Only a confirmed host has lengths; other rows stay without an expression.
    beginnings = F.expr("transform(filter(IF(_suffix_full = _host_full, _lengths, NULL), n -> n <= length(path)), n -> substring(path, 1, n))")
    expanded = hosts.select("page_id", "url", "_copies", "host", "path", "_salt", "_suffix", F.explode_outer(beginnings).alias("_beginning"))
    expanded = expanded.select("*", *_hashed(F.concat("_suffix", F.lit("\n"), "_beginning"), "expression"))
    found = expanded.join(
        by_rule, (F.col("_expression_prefix") == F.col("_rule_prefix")) & (expanded["_salt"] == by_rule["_salt"]), "left"
    )
    confirmed = F.when(
        F.col("_expression_full") == F.col("_rule_full"), F.struct(F.length("_rule").alias("n"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
    )
    best = found.groupBy("page_id", "url", "_copies", "host", "path").agg(F.max(confirmed).alias("_best"))
    return best.select(
        "page_id", "url", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"), F.explode(F.expr("sequence(1, CAST(_copies AS INT))")).alias("_copy"),
    ).drop("_copy")


def allowed_pages(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """The pages whose URL is not blocked, with all their columns."""
    urls = pages.select(F.lit(0).alias("page_id"), F.col(url).alias("url")).distinct()
    blocked = judge(urls, rules, default).where("verdict = 'block'").select(F.col("url").alias("_blocked"))
    return pages.join(blocked, pages[url].eqNullSafe(blocked["_blocked"]), "left_anti")
