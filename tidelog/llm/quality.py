"""Quality rules with host verdicts, in DataFrame expressions only.

Each text gets base measures and a base verdict. Failures are counted by host, the
hosts' failure rates are shrunk with a beta prior that is fitted to all hosts, and hosts
whose rate is surely far above the typical one are rejected; the verdicts are joined back to
documents. Where the hosts' rates differ no more than chance makes them differ, the prior is
a point, all rates are shrunk to it and no host is rejected.

Defined results: a null or empty text has no words and fails the base rules; a null host
is a host of its own; repeated rows are judged each and all count; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is rejected if its shrunk failure rate, less DEVIATIONS posterior deviations, is over HOST_RATIO times the prior's mean or over MAX_HOST_RATE.
HOST_RATIO, MAX_HOST_RATE, DEVIATIONS = 2.0, 0.5, 2.0
#: Copies of the small host table, so that one hot host's documents meet it in so many tasks.
SALTS = 16
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\u000b\f\r"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def measures(docs: DataFrame, text: str = "text") -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as columns over docs."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, _SPACE, "") != "")

    def repeat(w: Column) -> Column:
        # Windows sorted by hash stand beside their equals; the positions of those that
        # have an equal neighbour, in order, cover min(3, gap) words each and 3 at the end.
        n = F.size(w)
        windows = F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            hit = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            at = F.array_sort(F.transform(hit, lambda x: x["i"]))
            return F.get(F.transform(F.array(at), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)), 0)

        return F.when(n < 3, 0).otherwise(F.get(F.transform(F.array(windows), covered), 0))

    in_words = F.transform(F.array(_words(t)), lambda w: F.struct(F.size(w).alias("n_words"), repeat(w).alias("n_repeat_words")))
    in_lines = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return [
        F.get(in_words, 0).alias("w"),
        F.length(F.translate(t, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.get(in_lines, 0).cast("long").alias("n_dup_lines"),
    ]


def base_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: id, host, the measures and base_failed."""
    m = docs.select(F.col(id_col), F.col(host).alias("host"), *measures(docs, text))
    n, r = F.col("w.n_words").cast("long"), F.col("w.n_repeat_words").cast("long")
    return m.select(
        id_col, "host", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
    )


def host_verdicts(judged: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate and host_rejected.

    The prior is fitted by moments: with m the mean and v the variance of the hosts' rates, less the
    variance m(1-m)/n that chance gives a host of n documents, its weight is m(1-m)/v - 1; where nothing of v is left, it is unbounded."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("chance"))
    spread = F.col("m") * (1 - F.col("m"))
    prior = prior.withColumn("between", F.col("v") - spread * F.col("chance")).select("m", F.when(F.col("between") > 0, F.greatest(F.lit(0.0), spread / F.col("between") - 1)).alias("weight"))
    shrunk = F.coalesce((F.col("n_failed") + F.col("m") * F.col("weight")) / (F.col("n_docs") + F.col("weight")), F.col("m"))
    known = hosts.join(F.broadcast(prior)).withColumn("shrunk_rate", shrunk)  # the prior is one row
    deviation = F.sqrt(F.col("shrunk_rate") * (1 - F.col("shrunk_rate")) / (F.col("n_docs") + F.col("weight") + 1))
    rejected = F.col("shrunk_rate") - DEVIATIONS * deviation > F.least(HOST_RATIO * F.col("m"), F.lit(MAX_HOST_RATE))
    return known.select("host", "n_docs", "n_failed", "shrunk_rate", F.coalesce(rejected, F.lit(False)).alias("host_rejected"))


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Base measures, base_failed, host, shrunk_rate, host_rejected and kept, per document."""
    judged = cut(base_rules(docs, id_col, text, host))
    salted = judged.withColumn("salt", F.pmod(F.hash(F.col(id_col), F.col("word_chars"), F.col("n_words")), F.lit(SALTS)))
    verdicts = host_verdicts(judged).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.alias("d").join(verdicts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")) & (F.col("d.salt") == F.col("h.salt")), "left")
    rejected = F.coalesce(F.col("h.host_rejected"), F.lit(False))
    return joined.select(
        *(F.col(f"d.{c}") for c in (id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
        (~F.col("d.base_failed") & ~rejected).alias("kept"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
x AS (SELECT *, len(w)::BIGINT AS n_words, list_transform(generate_series(1, len(w) - 2), lambda i: [w[i], w[i + 1], w[i + 2]]) AS g FROM w),
p AS (SELECT rid, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM (SELECT row_number() OVER () AS rid, g FROM x)),
b AS (SELECT row_number() OVER () AS rid, * FROM x),
q AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM p),
r AS (SELECT rid, sum(least(3, coalesce(nx - i, 3))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM q WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, source, n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM b LEFT JOIN r USING (rid)),
j AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n_docs, sum(base_failed::INT)::BIGINT AS n_failed FROM j GROUP BY source),
k AS (SELECT avg(n_failed / n_docs) AS m, var_pop(n_failed / n_docs) AS v, avg(1 / n_docs) AS chance FROM h),
s AS (SELECT m, CASE WHEN v - m * (1 - m) * chance > 0 THEN greatest(0.0, m * (1 - m) / (v - m * (1 - m) * chance) - 1) END AS weight FROM k),
y AS (SELECT source, m, n_docs + weight + 1 AS size, (n_failed + m * weight) / (n_docs + weight) AS rate FROM h, s),
z AS (SELECT source, coalesce(rate - 2 * sqrt(rate * (1 - rate) / size) > least(2 * m, 0.5), false) AS rejected FROM y)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT rejected) AS kept
FROM j JOIN z ON j.source IS NOT DISTINCT FROM z.source
"""
