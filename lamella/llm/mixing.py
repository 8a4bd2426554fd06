"""Operator 10: mix sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

#: Up to so many sources the rate table is broadcast; beyond, it is joined by shuffle and AQE splits hot sources.
MAX_BROADCAST_SOURCES = 2_000
#: A mean above this is split into equal parts with a draw each, as exp(-mean) would leave the range of doubles.
MAX_MEAN = 500.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1), the same on every run and engine: 52 bits of the md5 of the parts joined by colons."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, source: str, weights: dict[str, float] | None, temperature: float, size: float) -> DataFrame:
    """A row per source: its name, the mean repetition rate and the Poisson distribution function at 0, 1, 2, ... as an array."""
    counts = stored(docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        named = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1])))) if weights else F.create_map().cast("map<string,double>")
        weighed = counts.withColumn("w", F.coalesce(F.try_element_at(named, F.coalesce(F.col("source"), F.lit(""))), F.lit(0.0)))
    total = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    all_n, all_w = float(total["n"] or 0), float(total["w"] or 0)
    mean = F.when(F.lit(all_w) > 0, F.col("w") / F.lit(all_w or 1.0) * F.lit(all_n * size) / F.col("n")).otherwise(F.lit(0.0))
    out = weighed.withColumn("mean", mean).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / MAX_MEAN)).cast("int")).withColumn("m", F.col("mean") / F.col("parts"))
    top = F.ceil(F.col("m") + 12 * F.sqrt("m") + 40).cast("int")
    first = F.exp(-F.col("m"))
    step = F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf")),
        lambda a, k: F.struct((a["p"] * F.col("m") / k).alias("p"), (a["c"] + a["p"] * F.col("m") / k).alias("c"), F.concat(a["cdf"], F.array(a["c"] + a["p"] * F.col("m") / k)).alias("cdf")),
    )
    return out.select("source", "mean", "parts", step["cdf"].alias("cdf"))


def mix(docs: DataFrame, *, source: str = "source", key: str = "doc_id", weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: int = 42, copy: str = "mix_copy") -> DataFrame:
    """docs, each row as many times as its Poisson draw says, in a random order that is the same on every run.

    A source's mean rate is its target share times ``size`` times all rows, over its rows; shares are ``weights``
    (sources not named: 0, their rows go) or, without, proportional to rows ** temperature. The draw inverts the
    Poisson distribution at a hash of seed and key, so equal keys get equal counts, whatever the partitions.
    Rows come out hash-dealt over the shuffle partitions and sorted by a second hash in each: read in partition order,
    a global shuffle without a sampling pass. ``copy`` numbers a row's copies from 1.
    A null source is a source of its own (weights name it ""); a null key draws as the string null; repeated rows draw alike, each its
    own copies; an empty table gives an empty result; columns named like our own are kept, ours take a free name.
    """
    copy = free_name(docs, copy)
    table = rates(docs, source, weights, temperature, size)
    r = table.select(*(F.col(c).alias(f"__mix_{c}") for c in table.columns))
    if table.count() <= MAX_BROADCAST_SOURCES:
        r = F.broadcast(r)
    d = docs.join(r, docs[source].eqNullSafe(r["__mix_source"]), "left")
    draws = F.aggregate(
        F.sequence(F.lit(1), F.col("__mix_parts")),
        F.lit(0),
        lambda n, part: n + F.size(F.filter(F.col("__mix_cdf"), lambda c: c < uniform(F.lit(seed), docs[key], part))),
    )
    one = F.aggregate(F.col("__mix_cdf"), F.lit(0), lambda n, c: n + F.when(c < F.col("__mix_u"), 1).otherwise(0))
    d = d.withColumn("__mix_u", uniform(F.lit(seed), docs[key], F.lit(1)))
    d = d.withColumn("__mix_n", F.when(F.col("__mix_parts") == 1, one).otherwise(draws)).where("__mix_n > 0")
    d = d.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_n").cast("long"))).alias(copy))
    place = F.xxhash64(F.lit(seed), d[key], d[copy])
    return d.withColumn("__mix_place", place).repartition("__mix_place").sortWithinPartitions(F.xxhash64("__mix_place", F.lit(seed))).drop("__mix_place")


#: The same draw in DuckDB, for the default weights (rows ** 0.5), size 1 and seed 42.
ORACLE = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
means AS (SELECT source, w / (SELECT sum(w) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n AS m FROM counts),
cdf AS (
  SELECT source, m, 0 AS k, exp(-m) AS p, exp(-m) AS c FROM means
  UNION ALL
  SELECT source, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM cdf WHERE k < ceil(m + 12 * sqrt(m) + 40)
),
draws AS (
  SELECT *, (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents
),
reps AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c < d.u) AS reps FROM draws d
)
SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, reps)) AS mix_copy FROM reps WHERE reps > 0
"""
