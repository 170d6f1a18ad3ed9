"""Mixing sources to target weights by Poisson replication.

Method: each document draws its number of copies from a Poisson distribution whose mean is its source's target
repetition rate. The draw inverts the distribution at a fraction hashed from seed and doc_id, so it is the same on
every run and on every cluster; copies are exploded and shuffled globally by a hash. Native Spark expressions.

Defined cases: a null source is a source of its own (given weights name it by the empty text); rows that repeat a doc_id draw the same count; texts are not looked
at; a source with weight 0, or absent from given weights, gives no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import settle, table, u52

SEED = "mix-1"
#: Target weight of a source: its number of documents to this power (1: as found; 0: all sources alike).
TEMPERATURE = 0.5
BROADCAST_ROWS = 20_000
#: Means up to which the draw starts at exp(-mean).
EXACT = 700.0


def source_rates(docs: DataFrame, *, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: int | None = None, source_col: str = "source") -> DataFrame:
    """(_src, _rate): the mean number of copies of a document, so that sources meet their weights and ``total`` rows are expected (default: as many as there are)."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("_src")).agg(F.count("*").cast("double").alias("_n"))
    if weights is None:
        weighted = counts.withColumn("_w", F.pow("_n", F.lit(float(temperature))))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weighted = counts.withColumn("_w", F.coalesce(given[F.coalesce("_src", F.lit(""))], F.lit(0.0)))
    sums = weighted.agg(F.sum("_w").alias("_sw"), F.sum("_n").alias("_sn"))
    rows = F.lit(float(total)) if total is not None else F.col("_sn")
    rate = F.when(F.col("_sw") > 0, rows * F.col("_w") / F.col("_sw") / F.col("_n")).otherwise(0.0)
    return weighted.crossJoin(F.broadcast(sums)).select("_src", rate.alias("_rate"))  # one row of sums


def poisson_inverse(rate: Column, u: Column) -> Column:
    """The least k with P(X <= k) > u, X Poisson of the given mean.

    The fold stops at mean + 12 deviations + 40, where the tail is below the 52 bits of u. Means above EXACT, where exp(-mean) would
    underflow, start as far below the mean, at a probability by Stirling's series."""
    spread = F.sqrt(rate) * 12 + 40
    first = F.when(rate > EXACT, F.floor(rate - spread)).otherwise(0).cast("int")
    k = F.greatest(first, F.lit(1)).cast("double")
    log_p = k - rate + k * F.log(rate / k) - F.log(k * (2 * math.pi)) / 2 - 1 / (k * 12) + 1 / (k * k * k * 360)
    p0 = F.when(rate > EXACT, F.exp(log_p)).otherwise(F.exp(-rate))
    steps = F.sequence(first + 1, (rate + spread).cast("int"))
    zero = F.struct(p0.alias("p"), p0.alias("c"), first.alias("k"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * rate / i
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), (a["k"] + F.when(a["c"] <= u, 1).otherwise(0)).alias("k"))

    return F.aggregate(steps, zero, step, lambda a: a["k"])


def poisson_mix(docs: DataFrame, rates: DataFrame, *, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Rows of ``docs``, each as often as drawn, with ``_copy`` (from 0) and ``_order`` (the global shuffle's key).

    The rates are a row per source. They are counted, and broadcast up to BROADCAST_ROWS; beyond that they are joined by
    sorting, where AQE can split a hot source. Rows are dealt by the hash key, so no source gathers in one task."""
    rates = settle(rates)
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    u = u52(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    met = docs.join(rates, F.col(source_col).cast("string").eqNullSafe(F.col("_src")), "inner")
    drawn = met.withColumn("_count", poisson_inverse(F.col("_rate"), u)).where(F.col("_count") > 0)
    copies = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("_copy").cast("string")).cast("binary"))
    keyed = copies.withColumn("_order", order).drop("_src", "_rate", "_count")
    return keyed.repartition(F.col("_order")).sortWithinPartitions("_order")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    out = poisson_mix(docs, source_rates(docs))
    return out.select("doc_id", "text", "lang", "source", "n_chars", F.col("_copy").cast("long").alias("copy"), F.col("_order").alias("order_key"))


SQL = f"""
WITH RECURSIVE counts AS (
  SELECT source AS src, count(*)::DOUBLE AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source
), rates AS (
  SELECT src, (sum(n) OVER ()) * w / (sum(w) OVER ()) / n AS rate FROM counts
), firsts AS (
  SELECT src, rate, CASE WHEN rate > {EXACT} THEN floor(rate - 12 * sqrt(rate) - 40)::INT ELSE 0 END AS k FROM rates
), starts AS (
  SELECT src, rate, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(j - rate + j * ln(rate / j) - ln(j * {2 * math.pi!r}) / 2 - 1 / (j * 12) + 1 / (j * j * j * 360)) END AS p
  FROM (SELECT *, greatest(k, 1)::DOUBLE AS j FROM firsts)
), cdf(src, rate, k, p, c) AS (
  SELECT src, rate, k, p, p FROM starts
  UNION ALL
  SELECT src, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < rate + 12 * sqrt(rate) + 40
), drawn AS (
  SELECT doc_id, text, lang, source, n_chars, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents
), counts_drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, max(f.k) + count(c.k) AS n
  FROM (SELECT *, row_number() OVER () AS r FROM drawn) d JOIN firsts f ON d.source IS NOT DISTINCT FROM f.src
  LEFT JOIN cdf c ON d.source IS NOT DISTINCT FROM c.src AND c.c <= d.u
  GROUP BY d.r, d.doc_id, d.text, d.lang, d.source, d.n_chars
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::BIGINT AS copy FROM counts_drawn WHERE n > 0
)
SELECT doc_id, text, lang, source, n_chars, copy, md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS order_key FROM copies
"""
