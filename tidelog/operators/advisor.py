"""Rules over metric series and logs: conditions, overlaps and triggers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EXPRESSION = re.compile(r"(?:[\w.]+|[<>=!]=?|[-+*/()%]|\s|and|or|not)*", re.IGNORECASE)


def checked(expression: str, names: set[str]) -> Column:
    """A boolean over the given names, from a text of comparisons, arithmetic and and/or/not only."""
    words = set(re.findall(r"[A-Za-z_]\w*", expression)) - {"and", "or", "not", "AND", "OR", "NOT"}
    if not _EXPRESSION.fullmatch(expression) or words - names:
        raise ValueError(f"expression not allowed: {expression!r}")
    return F.expr(expression)


def log_condition(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines that the pattern matches, per entity."""
    return lines.where(F.col("line").rlike(pattern)).groupBy("entity").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


def parse_statistics(lines: DataFrame) -> DataFrame:
    """entity, ts, stat, value from lines like `name COUNT : 12`."""
    found = F.regexp_extract("line", r"^\s*([\w.\-]+)\s+COUNT\s*:\s*(\d+)\s*$", 1)
    number = F.regexp_extract("line", r"^\s*([\w.\-]+)\s+COUNT\s*:\s*(\d+)\s*$", 2)
    return lines.where(found != "").select("entity", "ts", found.alias("stat"), number.cast("long").alias("value"))


def options_condition(options: DataFrame, expression: str, names: list[str]) -> DataFrame:
    """Entities whose options(entity, option, value) fulfil the expression."""
    wide = options.groupBy("entity").pivot("option", names).agg(F.max("value"))
    return wide.where(checked(expression, set(names))).select("entity")


def burst(series: DataFrame, window: int, threshold: float, duration: int, percent: bool, time: Column) -> DataFrame:
    """Points whose change over `window` points, per `duration` of time, reaches the threshold."""
    w = Window.partitionBy("entity", "stat").orderBy("ts")
    old, at = F.lag("value", window).over(w), F.lag(time, window).over(w)
    change = (F.col("value") - old) * 100.0 / old if percent else (F.col("value") - old).cast("double")
    rated = series.withColumn("rate", change * duration / (time - at))
    return rated.where(F.col("rate") >= threshold).select("entity", "stat", "ts", "rate")


def aggregate(series: DataFrame, op: str) -> DataFrame:
    """entity, stat, value by latest, oldest, max, min or avg."""
    how = {"latest": F.max_by("value", "ts"), "oldest": F.min_by("value", "ts"), "max": F.max("value"), "min": F.min("value"), "avg": F.avg("value")}
    return series.groupBy("entity", "stat").agg(how[op].cast("double").alias("value"))


def expression(series: DataFrame, text: str, stats: list[str]) -> DataFrame:
    """entity, ts of the epochs whose stats fulfil the expression."""
    wide = series.groupBy("entity", "ts").pivot("stat", stats).agg(F.max("value"))
    return wide.where(checked(text, set(stats))).select("entity", "ts")


def overlap(left: DataFrame, right: DataFrame, within: int, time: str = "t") -> DataFrame:
    """entity, t1, t2: the first pair of triggers at most `within` apart. Triggers are binned by time, so a pair is looked for in three bins."""
    bins = F.floor(F.col(time) / within)
    a = left.select("entity", F.col(time).alias("t1"), F.explode(F.array(bins - 1, bins, bins + 1)).alias("_bin"))
    b = right.select("entity", F.col(time).alias("t2"), bins.alias("_bin"))
    pairs = a.join(b, ["entity", "_bin"]).where(F.abs(F.col("t1") - F.col("t2")) <= within)
    return pairs.groupBy("entity").agg(F.min(F.struct("t1", "t2")).alias("p")).select("entity", "p.t1", "p.t2")


def rule(conditions: list[DataFrame]) -> DataFrame:
    """entity for which every condition holds."""
    every = conditions[0].select("entity", F.lit(0).alias("c"))
    for i, c in enumerate(conditions[1:], 1):
        every = every.unionByName(c.select("entity", F.lit(i).alias("c")))
    return every.groupBy("entity").agg(F.countDistinct("c").alias("n")).where(F.col("n") == len(conditions)).select("entity")


def deltas(series: DataFrame) -> DataFrame:
    """Cumulative counters to changes; the first point keeps its value."""
    w = Window.partitionBy("entity", "stat").orderBy("ts")
    return series.withColumn("value", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0)))


def parse_rules_file(lines: DataFrame) -> DataFrame:
    """section, kind, name, key, value of an INI rules file (lines: at, line): sections are [kind "name"], entries key=value; comments and blanks are skipped.

    A rules file is small, yet its sections are carried over ranges of lines, not in one task."""
    from .ordering import running

    text = F.trim("line")
    head = F.regexp_extract(text, r'^\[(\w+)\s+"([^"]+)"\]$', 0)
    own = running(lines.where((text != "") & ~text.startswith("#") & ~text.startswith(";")), ["at"], F.when(head != "", head), "section", True)
    entry = own.where(F.trim("line").contains("=") & ~F.trim("line").startswith("["))
    part = lambda i: F.regexp_extract("section", r'^\[(\w+)\s+"([^"]+)"\]$', i)
    return entry.select(part(1).alias("kind"), part(2).alias("name"), F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.expr("substr(line, instr(line, '=') + 1)")).alias("value"))
