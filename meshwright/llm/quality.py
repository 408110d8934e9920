"""Quality rules with host verdicts, in DataFrame functions only.

Documents are measured and tested by rules; rule failures are summed by host; each
host's failure rate is shrunk towards the corpus with an empirical beta prior; a host
whose rate is surely above that of the corpus gets a strict verdict, which is joined back to its documents:
there a document that also breaks a soft rule is rejected.  Clean documents of a bad
host stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Fixed values of the word and symbol classes.
SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

#: Rule limits (production defaults).
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SOFT_SYMBOL_PERCENT = 10
SOFT_DUP_LINE_PERCENT = 30
SOFT_MEAN_CHARS = (2, 15)
#: A host is strict when its failure rate is above the corpus rate by so many deviations of its posterior.
STRICT_DEVIATIONS = 2.0


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES + "+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, first occurrences included.

    Windows are compared by 64-bit hash within one document. Documents whose windows are all
    distinct stop at a hash set; others sort their windows once, so the cost stays
    n log n for the longest documents.
    """
    grams = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(g: Column) -> Column:
        ranked = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(r: Column) -> Column:
            return F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            r,
                            lambda x, k: F.struct(
                                x["i"].alias("i"),
                                (
                                    F.coalesce(F.get(r, k - 1)["h"] == x["h"], F.lit(False))
                                    | F.coalesce(F.get(r, k + 1)["h"] == x["h"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            )

        def length(s: Column) -> Column:
            return F.aggregate(
                F.transform(s, lambda p, k: F.least(F.lit(3), F.coalesce(p - F.get(s, k - 1), F.lit(3)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        return _let(_let(ranked, starts), length)

    distinct = lambda g: F.size(F.array_distinct(g)) == F.size(g)
    return F.when(
        F.size(words) >= 3,
        _let(grams, lambda g: F.when(distinct(g), F.lit(0).cast("long")).otherwise(covered(g))),
    ).otherwise(F.lit(0).cast("long"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measure(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """Per-document counts: ``doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    A null text has no words and zero counts. A null source is a host of its own. Repeated rows
    are measured each. Other columns of ``docs`` are not read, or with ``whole_rows`` kept inside
    the struct ``_row``, where no name can clash.
    """
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if whole_rows else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.regexp_replace("t", SPACES + "+", "")
    lines = lambda ls: F.size(ls) - F.size(F.array_distinct(ls))
    spoken = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("host"),
            text.alias("t"),
            *row,
        )
        .withColumn(
            "m",
            _let(
                _words(F.col("t")),
                lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
            ),
        )
        .select(
            "doc_id",
            "host",
            "m.n_words",
            F.length(bare).cast("long").alias("word_chars"),
            (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            _let(spoken, lines).cast("long").alias("n_dup_lines"),
            F.size(spoken).cast("long").alias("n_lines"),
            "m.n_repeat_words",
            *(["_row"] if whole_rows else []),
        )
    )


def verdicts(measured: DataFrame) -> DataFrame:
    """Add ``base_failed, soft_failed``: hard rules reject alone, soft ones only in strict hosts."""
    mean_low, mean_high = SOFT_MEAN_CHARS
    hard = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = (
        (100 * F.col("n_symbols") > SOFT_SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > SOFT_DUP_LINE_PERCENT * F.col("n_lines"))
        | (F.col("word_chars") < mean_low * F.col("n_words"))
        | (F.col("word_chars") > mean_high * F.col("n_words"))
    )
    return measured.withColumns({"base_failed": hard, "soft_failed": soft})


def host_counts(judged: DataFrame) -> DataFrame:
    """``host, n_docs, n_failed``."""
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    return judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed).alias("n_failed"))


def host_rates(hosts: DataFrame) -> DataFrame:
    """Per host of :func:`host_counts`: documents, failures, the failure rate shrunk by an empirical beta prior, and whether it is strict.

    The prior's mean and strength come from the hosts' own rates by the method of moments
    (strength between 2 and 10,000); with one host, or no spread, the strength is the upper bound.
    """
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.var_samp(F.col("n_failed") / F.col("n_docs")).alias("spread"),
        F.avg(1 / F.col("n_docs")).alias("per_doc"),
    ).select(
        "mean",
        F.coalesce(
            F.greatest(
                F.lit(2.0),
                F.least(
                    F.lit(10_000.0),
                    F.try_divide(
                        F.col("mean") * (1 - F.col("mean")),
                        F.greatest(F.lit(0.0), F.col("spread") - F.col("mean") * (1 - F.col("mean")) * F.col("per_doc")),
                    ),
                ),
            ),
            F.lit(10_000.0),
        ).alias("strength"),
    )
    # One row: the corpus totals, so this broadcast never grows.
    return hosts.join(F.broadcast(prior)).select(
        "host",
        "n_docs",
        "n_failed",
        ((F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))).alias("rate"),
        "mean",
        (F.col("n_docs") + F.col("strength") + 1).alias("weight"),
    ).withColumn("strict_host", F.col("rate") - STRICT_DEVIATIONS * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("weight")) > F.col("mean"))


#: Rows of a host table that may be broadcast; a longer one is joined by shuffle.
BROADCAST_HOSTS = 50_000


def _with_hosts(judged: DataFrame, hosts: DataFrame) -> DataFrame:
    """Join shrunk rates to documents and give the verdict."""
    hosts = staged(hosts.select(F.col("host").alias("_host"), "rate", "strict_host"), "hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    return (
        judged.join(hosts, judged["host"].eqNullSafe(hosts["_host"]), "left")
        .drop("_host")
        .withColumn("strict_host", F.coalesce("strict_host", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~(F.col("strict_host") & F.col("soft_failed")))
    )


def judge(docs: DataFrame) -> DataFrame:
    """Measured documents with ``base_failed, soft_failed, rate, strict_host, kept``.

    One row per row of ``docs``; an empty table gives an empty result.
    """
    judged = staged(verdicts(measure(docs)), "quality")
    return _with_hosts(judged, host_rates(host_counts(judged)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged; texts are neither shuffled nor written.

    Texts are measured twice, once for the rates of the hosts and once for the verdicts: that costs time, but no copy of the corpus on disk.
    Null and empty texts have too few words and go; repeated rows are judged each. An empty table gives an empty result; no column name can clash.
    """
    # Counts are read twice, for the prior and for the hosts: one small row a host is staged.
    rates = host_rates(staged(host_counts(verdicts(measure(docs)).select("host", "base_failed", "soft_failed")), "host-counts"))
    judged = verdicts(measure(docs, whole_rows=True)).select("host", "base_failed", "soft_failed", "_row")
    return _with_hosts(judged, rates).filter("kept").select("_row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
),
m AS (
  SELECT d.doc_id, d.source, len(w) AS n_words,
         CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS wc,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN repeated r USING (rid)
),
j AS (
  SELECT *, coalesce(wc, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_symbols > 10 * coalesce(wc, 0) OR 100 * n_dup_lines > 30 * n_lines
         OR coalesce(wc, 0) < 2 * n_words OR coalesce(wc, 0) > 15 * n_words AS soft_failed
  FROM m
),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft_failed) AS f FROM j GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS mean, var_samp(f / n) AS spread, avg(1 / n) AS per_doc FROM h),
s AS (
  SELECT mean, coalesce(greatest(2.0, least(10000.0,
         mean * (1 - mean) / nullif(greatest(0.0, spread - mean * (1 - mean) * per_doc), 0))), 10000.0) AS strength
  FROM p
),
hosts AS (SELECT source, n, mean, (f + mean * strength) / (n + strength) AS rate, strength FROM h, s)
SELECT j.doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (soft_failed AND rate - 2.0 * sqrt(rate * (1 - rate) / (n + strength + 1)) > mean) AS kept
FROM j JOIN hosts ON j.source IS NOT DISTINCT FROM hosts.source
"""
