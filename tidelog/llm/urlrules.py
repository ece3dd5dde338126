r"""URL filtering with pattern rules that are indexed by their rarest literal token.

Tokens are the runs of [0-9a-z] of host and path. For each rule the literal token that
the fewest URLs hold is its index key; a URL's tokens fetch the rules under them, and only
those run their regular expression. The longest rule that fits decides; of rules of one
length the first in text order. Rules are a table of any length; pattern lines are
parsed by parse_rule.

Defined results: a null URL, or one without "://", has an empty host and path and only
meets rules that match the empty string; rules without a literal token are candidates for
every URL; repeated rows are judged each; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.code import ship
from . import kernel
from .store import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules over this many are joined by shuffle on (token, salt) instead of being broadcast.
BROADCAST_RULES = 100_000
SALTS = 16


@dataclass(frozen=True)
class Rule:
    name: str  # shown in the result
    verdict: str
    regex: str  # searched for in host + path
    literals: tuple[str, ...]  # whole tokens that a fitting URL has
    decisive: bool = True  # else a pattern of the method, weaker than every decisive rule


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains, where the path starts with path."""
    whole = [x for x in re.findall(r"[0-9a-z]+", host)]
    inner = re.findall(r"(?<=[^0-9a-z])([0-9a-z]+)(?=[^0-9a-z])", path)  # the last may go on in the URL
    return Rule(host + path, verdict, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path), tuple(dict.fromkeys([*whole, *inner])))


def parse_rule(line: str) -> Rule:
    """A pattern line over host and path, the case of letters ignored: @@ first allows (else block), || begins a host or a parent
    domain, | at either end anchors there, * is any run, ^ a separator (not a letter, digit or one of _.%-) or the end."""
    verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
    body = body.lower()
    if body.startswith("||"):
        head, body, bound = r"^(?:[^/]*\.)?", body[2:], True
    elif body.startswith("|"):
        head, body, bound = "^", body[1:], True
    else:
        head, bound = "", False
    tail, body, closed = ("$", body[:-1], True) if body.endswith("|") else ("", body, False)
    regex = "".join(".*" if c == "*" else r"(?:[^0-9a-z_.%-]|$)" if c == "^" else re.escape(c) for c in body)
    literals = [
        m.group() for m in re.finditer(r"[0-9a-z]+", body)
        if (body[m.start() - 1] != "*" if m.start() else bound) and (body[m.end()] != "*" if m.end() < len(body) else closed)
    ]
    return Rule(line, verdict, f"(?is){head}{regex}{tail}", tuple(dict.fromkeys(literals)))


_RULES = "name string, rule_verdict string, regex string, literals array<string>, decisive boolean"


def parse_rules(lines: DataFrame, column: str = "pattern", decisive: bool = True) -> DataFrame:
    """The rule table of a column of pattern lines, parsed in tasks; null, empty and repeated lines count once or not at all."""
    ship(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_rule(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist(
                [{"name": r.name, "rule_verdict": r.verdict, "regex": r.regex, "literals": list(r.literals), "decisive": decisive} for r in found],
                pa.schema([("name", pa.string()), ("rule_verdict", pa.string()), ("regex", pa.string()), ("literals", pa.list_(pa.string())), ("decisive", pa.bool_())]),
            )

    return lines.select(F.col(column).alias("line")).where("line <> ''").distinct().mapInArrow(kernel.freeing(run), _RULES)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.verdict, r.regex, list(r.literals), r.decisive) for r in rules], _RULES)


#: Fixed values of the query: host, path and verdict.
CONTRACT_RULES = tuple(
    host_rule(h, p, v)
    for v, h, p in (
        ("allow", "com", "/"),
        ("block", "example.com", "/en/"),
        ("allow", "www.example.com", "/en/"),
        ("block", "net", "/es/"),
        ("block", "net", "/fr/"),
    )
)
#: The method's own verdict where no rule fits: words that mark spam hosts.
SPAM_PATTERNS = tuple(Rule(f"~{w}", "block", rf"^[^/]*\b{w}\b", (w,), False) for w in ("bets", "casino", "pills", "porn", "poker", "viagra", "xxx"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    """Distinct tokens, the case of A-Z ignored, and the empty token that every URL has."""
    text = F.translate(F.concat(host, path), _UPPER, _LOWER)
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(text, "[^0-9a-z]+")))


def rule_index(urls: DataFrame, rules: DataFrame, small: bool) -> DataFrame:
    """token, name, rule_verdict, regex, decisive: each rule under that one of its literal tokens that the fewest rows of urls (a column of tokens) hold; "" if it has none."""
    wanted = rules.select("name", "decisive", F.explode("literals").alias("token"))
    known = wanted.select("token").distinct()
    counted = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(known) if small else known, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(counted, "token", "left").groupBy("name", "decisive").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    return rules.join(rarest, ["name", "decisive"], "left").select(F.coalesce("least.token", F.lit("")).alias("token"), "name", "rule_verdict", "regex", "decisive")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = CONTRACT_RULES, patterns: tuple[Rule, ...] = SPAM_PATTERNS, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, rule (the deciding decisive rule, else null), verdict, pattern (the method's pattern that fits, else null). rules: a few, or a table from parse_rules."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).select("*", _tokens(F.col("host"), F.col("path")).alias("tokens"))
    table = cut(rules.unionByName(rule_table(spark, patterns))) if isinstance(rules, DataFrame) else rule_table(spark, (*rules, *patterns))
    small = table.count() <= BROADCAST_RULES  # the check of what is broadcast
    index = cut(rule_index(parsed, table, small))
    each = parsed.select("*", F.monotonically_increasing_id().alias("_id")).select("_id", id_col, "host", "path", F.explode("tokens").alias("token"))
    if small:
        met = each.join(F.broadcast(index), "token", "left")
    else:
        salted = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("_salt", F.pmod(F.hash("_id"), F.lit(SALTS)).cast("int")).join(salted, ["token", "_salt"], "left")
    # min() of (shorter is worse, name): the longest name first, then text order.
    order = F.struct((-F.length("name")).alias("n"), F.col("name"), F.col("rule_verdict").alias("verdict"))
    fits = F.col("regex").isNotNull() & F.rlike(F.concat("host", "path"), F.col("regex"))
    best = met.groupBy("_id").agg(
        F.first(id_col).alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"),
        F.min(F.when(fits & F.col("decisive"), order)).alias("rule"), F.min(F.when(fits & ~F.col("decisive"), order)).alias("pattern"),
    )
    return best.select(
        id_col, "host", "path", F.col("rule.name").alias("rule"),
        F.coalesce("rule.verdict", "pattern.verdict", F.lit("allow")).alias("verdict"), F.col("pattern.name").alias("pattern"),
    )


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
  FROM (SELECT DISTINCT host, path FROM p), r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY host, path),
s AS (SELECT p.*, m.rule, m.v, list_sort(list_filter(['bets', 'casino', 'pills', 'poker', 'porn', 'viagra', 'xxx'], lambda w: list_contains(regexp_split_to_array(p.host, '[^0-9a-zA-Z_]+'), w))) AS w
  FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path),
t AS (SELECT *, CASE WHEN len(w) > 0 THEN '~' || list_sort(list_transform(w, lambda x: [lpad((99 - length(x))::VARCHAR, 2, '0'), x]))[1][2] END AS pattern FROM s)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict, pattern FROM t
"""
