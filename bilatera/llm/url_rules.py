"""URL filter by a list of rules, looked up by hash prefixes of host-suffix and path-prefix expressions.

A rule (host, path, verdict) fits a url when the url's host is the rule's or a subdomain of it, and the url's path starts
with the rule's. Every address is expanded into expressions: its last 1, 2, ... labels joined with the first characters of its
path, for the shapes (labels, path length) that rules have. Expressions and rules meet in an equi-join on the first 32 bits
of their SHA-256 digests; a hit counts when the full digests agree. Of the rules that fit, the longest (host and path
together, then the longer host) gives the verdict; rules that contradict each other in the same place block. Without a
rule the verdict is ``allow``, as in any look-up of a list of bad places.

Only DataFrame functions. Addresses are made distinct before they are expanded, so a page that comes again and again is
judged once; a frequent host meets its rules in ``SALTS`` parts. Only the shapes of rules reach the driver: as many as there are different pairs of
numbers in the list, whatever the number of rules and pages.

Null url, or one without ``://``: empty host and path, which no rule fits. User part and port belong to the host as written. Rules
with null host, path or verdict, and those whose path is neither empty nor starts with a slash, fit nothing. An empty rule host fits every address.
Rows that repeat come out as often; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts in which a frequent expression meets the rules.
SALTS = 16
#: Hexadecimal digits of a digest that are joined.
PREFIX = 8
DEFAULT = "allow"


def lowered(c: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def address(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = lowered(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _shape(host: Column, path: Column) -> tuple[Column, Column]:
    return F.when(host == "", 0).otherwise(F.size(F.split(host, "[.]"))), F.length(path)


def usable(rules: DataFrame) -> DataFrame:
    """Rules that can fit, one for each place: host, path, verdict, digest, labels, length."""
    host, path, verdict = lowered(F.trim("host")), F.col("path"), F.lower("verdict")
    good = rules.select(host.alias("host"), path.alias("path"), verdict.alias("verdict")).where(
        "host is not null and verdict in ('allow', 'block') and (path = '' or path like '/%')"
    )
    one = good.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block stands after allow
    labels, length = _shape(F.col("host"), F.col("path"))
    return one.withColumns({"digest": F.sha2(F.concat("host", "path"), 256), "labels": labels, "length": length})


def expressions(places: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """(host, path, labels, length, digest): what the rules of these shapes would have to be called to fit each place."""
    labels, length = _shape(F.col("host"), F.col("path"))
    kinds = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("length")) for a, b in sorted(shapes)])
    fit = F.filter(kinds, lambda s: (s["labels"] <= labels) & (s["length"] <= length))
    each = places.select("host", "path", F.inline(fit))
    # The last labels of a host; none of them is the empty host.
    tail = F.when(F.col("labels") == 0, F.lit("")).otherwise(F.expr("substring_index(host, '.', -labels)"))
    return each.withColumn("digest", F.sha2(F.concat(tail, F.substr("path", F.lit(1), F.col("length"))), 256))


def judge(pages: DataFrame, rules: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """page_id, host, path, the rule that decides (null: none) and the verdict, one row for every page."""
    host, path = address(F.col("url").cast("string"))
    seen = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    known = usable(rules)
    shapes = [(r["labels"], r["length"]) for r in known.select("labels", "length").distinct().collect()]
    if not shapes:
        return seen.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(DEFAULT)})
    prefix = F.substring("digest", 1, PREFIX)
    asked = expressions(seen.select("host", "path").distinct(), shapes).withColumns(
        {"prefix": prefix, "salt": F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int")}
    )
    listed = known.select(
        prefix.alias("prefix"), F.col("digest").alias("full"), F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"), "verdict", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    hits = asked.join(listed, ["prefix", "salt"]).where("digest = full")
    rank = F.struct(F.length("rule"), F.col("host_length"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    return seen.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict")
    )
