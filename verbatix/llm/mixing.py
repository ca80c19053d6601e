"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its share of the wanted total over what it
has. Every document draws a uniform number from a hash of the seed and its id and
inverts the Poisson distribution of that mean: the number of copies is the number of
values of the distribution function at or below the draw. Copies are exploded, and
a hash of id and copy number both deals them to partitions and orders each
partition: a global shuffle in one exchange, without sampling passes.

Rates above ``PART`` are the sum of several draws with smaller means, so the
distribution function never underflows. The table of sources is one row per source
with its distribution function; it is broadcast only up to ``BROADCAST_ROWS``.

Edge cases: a null source is a source of its own; a null ``doc_id`` hashes as the
word null; repeated rows draw alike; a source without a weight gets weight 0; an
empty table gives no rows; the columns of ``documents`` come back with ``copy_no``
and ``shuffle_key``, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SEED = 20240229
#: The largest mean of a single draw.
PART = 50.0
#: Values of the distribution function beyond its mean that are kept: the rest is below 1e-16.
SPAN = 130
BROADCAST_ROWS = 10_000


def _draw(*parts: str) -> str:
    """SQL of a uniform number in [0, 1): 52 bits of an MD5."""
    return f"(conv(substr(md5(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, 13), 16, 10) / 4503599627370496D)"


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(name, rate, draws, cdf) per source. ``weights`` are shares of the output's documents; by default all sources weigh alike."""
    counts = docs.groupBy(F.coalesce("source", F.lit("\0null")).alias("name")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        known = docs.sparkSession.createDataFrame([(k if k is not None else "\0null", float(v)) for k, v in weights.items()], "name string, weight double")
        counts = counts.join(F.broadcast(known), "name", "left").fillna(0.0, "weight")  # the caller's own list
    counts = common.materialize(counts)
    total = counts.agg(F.sum("n").alias("n"), F.sum("weight").alias("w"))
    rated = counts.join(F.broadcast(total.select(F.col("n").alias("all_n"), "w")), F.lit(True))  # one row
    rated = rated.select("name", (F.col("weight") / F.greatest("w", F.lit(1e-300)) * F.col("all_n") * epochs / F.col("n")).alias("rate"))
    rated = rated.withColumn("draws", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("draws"))
    steps = rated.select("name", "rate", "draws", "mean", F.explode(F.sequence(F.lit(0), F.ceil("mean").cast("int") + SPAN)).alias("k"))
    log_factorial = F.expr("aggregate(sequence(1, greatest(k, 1)), 0D, (a, x) -> a + ln(cast(x as double)))")
    p = F.when(F.col("mean") == 0, F.when(F.col("k") == 0, 1.0).otherwise(0.0)).otherwise(F.exp(F.col("k") * F.log("mean") - F.col("mean") - log_factorial))
    sums = steps.withColumn("p", p).withColumn("c", F.sum("p").over(Window.partitionBy("name").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return sums.groupBy("name", "rate", "draws").agg(F.expr("transform(array_sort(collect_list(struct(k, c))), x -> x.c)").alias("cdf"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """Copies of documents, shuffled: the columns of ``documents`` with ``copy_no`` (from 1) and ``shuffle_key``."""
    docs = docs.select(*COLUMNS)
    table = common.materialize(rates(docs, weights, epochs).withColumnRenamed("name", "_name"))
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    named = docs.withColumn("_name", F.coalesce("source", F.lit("\0null"))).join(table, "_name")
    doc = "coalesce(cast(doc_id as string), 'null')"
    # The inner transform makes each draw once, not for every value of the distribution function.
    copies = F.expr(f"aggregate(transform(sequence(1, draws), j -> {_draw(doc, 'cast(j as string)')}), 0, (a, u) -> a + size(filter(cdf, c -> u >= c)))")
    many = named.withColumn("_copies", copies).where("_copies > 0").select(*COLUMNS, F.explode(F.expr("sequence(1, _copies)")).alias("copy_no"))
    keyed = many.withColumn("shuffle_key", F.expr(f"cast(conv(substr(md5(concat_ws(':', 'order', '{SEED}', {doc}, cast(copy_no as string))), 1, 13), 16, 10) as bigint)"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(common.table(spark, sf_dir, "documents"))


def oracle(docs: str = "documents", columns: tuple[str, ...] = COLUMNS, extra: bool = True) -> str:
    """DuckDB SQL of ``replicate`` with equal weights, over a table or subquery (every rate below ``PART``, one draw)."""
    u = f"(('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, 'null'), '1')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    key = f"('0x' || substr(md5(concat_ws(':', 'order', '{SEED}', coalesce(doc_id::VARCHAR, 'null'), copy_no::VARCHAR)), 1, 13))::BIGINT"
    return f"""WITH d AS (SELECT * FROM {docs}), n AS (SELECT source, count(*) AS n FROM d GROUP BY source),
 m AS (SELECT source, (1.0::DOUBLE / count(*) OVER ()) * sum(n) OVER () / n AS mean FROM n),
 k AS (SELECT source, mean, unnest(range(0, ceil(mean)::INT + {SPAN + 1})) AS k FROM m),
 c AS (SELECT source, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM k),
 l AS (SELECT source, list(c) AS cdf FROM c GROUP BY source),
 r AS (SELECT d.*, len(list_filter(cdf, lambda x: {u} >= x)) AS copies FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
 x AS (SELECT * EXCLUDE (copies), unnest(range(1, copies + 1)) AS copy_no FROM r)
 SELECT {', '.join(columns)}{f', copy_no::INT AS copy_no, {key} AS shuffle_key' if extra else ''} FROM x"""


ORACLE = oracle()
