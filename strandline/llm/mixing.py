"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies of its documents that brings it to its share of the mixture. Each
document draws its own number of copies: a uniform number from the hash of its id and a seed is put through the
inverse of the Poisson distribution with that mean. Documents are exploded by their counts and all copies put in
the order of another hash, a shuffle of the whole mixture. The same ids and seed give the same mixture, on any
partitioning. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import few, stored

PART_RATE = 500.0  # exp(-rate) is still a normal number
RUN = 4096  # copies of a document that are listed at once


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """(source, n, rate): how often each source's documents are to occur on average.

    The mixture has epochs x the rows of docs. weights: target shares by source (any positive scale; a source
    that is not named gets none). Without weights, shares go with the sources' rows to the power of temperature.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        named = [(F.col("source").isNull() if s is None else F.col("source") == F.lit(s), float(w)) for s, w in weights.items()]
        share = F.coalesce(*[F.when(at, F.lit(w)) for at, w in named], F.lit(0.0))
    weighed = stored(sizes.withColumn("w", share), "sources")
    rows, shares = weighed.agg(F.sum("n"), F.sum("w")).first()  # two numbers
    if not shares:
        return weighed.select("source", "n", F.lit(0.0).alias("rate"))
    rate = F.lit(epochs) * F.lit(rows) * F.col("w") / F.lit(shares) / F.col("n")
    return weighed.select("source", "n", rate.alias("rate"))


def parts(rate: str = "rate") -> Column:
    """How many draws a rate is split into: sums of independent Poisson numbers are Poisson, of the summed rate."""
    return F.greatest(F.ceil(F.col(rate) / PART_RATE), F.lit(1)).cast("int")


def poisson_cdf(rate: str = "rate") -> Column:
    """P(count <= k) for k = 0, 1, ... up to where no double is left to gain; for a rate of PART_RATE at most."""
    last = f"cast(ceil({rate} + 12 * sqrt({rate}) + 30) as int)"
    step = f"struct(s.p * {rate} / k as p, array_append(s.c, element_at(s.c, -1) + s.p * {rate} / k) as c)"
    return F.expr(f"aggregate(sequence(1, {last}), struct(exp(-{rate}) as p, array(exp(-{rate})) as c), (s, k) -> {step}, s -> s.c)")


def uniform(key: Column, seed: int) -> Column:
    """In [0, 1): the first 52 bits of the md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.7, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as drawn, in shuffled order, with columns copy (from 1) and shuffle_key added.

    A row is keyed by its doc_id, or by its text where that is null; rows of one key draw alike. Columns copy and
    shuffle_key of docs are replaced; a null source is a source of its own. A source of weight zero is left
    out; an empty table stays empty. A rate above 500 is the sum of several draws, so rates have no limit.
    """
    return _shuffled(docs.drop("copy", "shuffle_key"), weights, temperature, epochs, seed)


def replicated(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.7, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """As mixed(), with just the columns of docs, a column copy or shuffle_key among them as it is."""
    own = [x for x in ("copy", "shuffle_key") if x in docs.columns]
    out = _shuffled(docs.withColumnsRenamed({x: f"__{x}" for x in own}), weights, temperature, epochs, seed)
    return out.drop("copy", "shuffle_key").withColumnsRenamed({f"__{x}": x for x in own})


def _shuffled(docs: DataFrame, weights: dict[str | None, float] | None, temperature: float, epochs: float, seed: int) -> DataFrame:
    """The copies go to a partition by their place in the even range of the hash, so no pass is needed to find its bounds."""
    split = source_rates(docs, weights, temperature, epochs).withColumn("parts", parts()).withColumn("rate", F.col("rate") / F.col("parts"))
    rates = few(stored(split.select(F.col("source").alias("__source"), F.col("parts").alias("__parts"), poisson_cdf().alias("__cdf")), "rates"), 10_000)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))))
    drawn = docs.withColumn("__key", key).join(rates, F.col("source").eqNullSafe(F.col("__source")))
    more = F.transform(F.sequence(F.lit(1), F.col("__parts") - 1), lambda i: uniform(F.concat("__key", F.lit("|"), i.cast("string")), seed))
    each = F.concat(F.array(uniform(F.col("__key"), seed)), F.when(F.col("__parts") > 1, more).otherwise(F.array().cast("array<double>")))
    drawn = drawn.withColumn("__u", each).withColumn("__n", F.expr("aggregate(__u, 0L, (s, u) -> s + size(filter(__cdf, c -> u >= c)))"))
    runs = drawn.where("__n > 0").drop("__cdf", "__source", "__u", "__parts").withColumn("__run", F.explode(F.expr(f"sequence(0L, (__n - 1) div {RUN})")))
    copies = runs.withColumn("copy", F.explode(F.expr(f"sequence(cast(__run * {RUN} + 1 as int), cast(least((__run + 1) * {RUN}, __n) as int))")))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}#"), F.col("__key"), F.lit("#"), F.col("copy").cast("string")))).drop("__key", "__n", "__run")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.substring("shuffle_key", 1, 12), 16, 10).cast("long").cast("double") / F.lit(float(1 << 48))
    return copies.repartitionById(n, F.floor(place * n).cast("int")).sortWithinPartitions("shuffle_key", "doc_id", "copy")


def mixed_sql(temperature: float = 0.7, epochs: float = 1.0, seed: int = 17) -> str:
    """The same mixture in DuckDB's SQL, for tables without null ids or sources."""
    return f"""
with sizes as (select source, count(*) n, pow(count(*)::double, {temperature}) w from documents group by source),
rates as (select source, {epochs} * (select sum(n) from sizes) * w / (select sum(w) from sizes) / n as rate from sizes),
terms as (
  select source, rate, k, exp(-rate) * exp(case when k = 0 then 0 else k * ln(rate) - lgamma(k + 1) end) as p
  from rates, range(0, 200) t(k)),
cdf as (select source, k, sum(p) over (partition by source order by k) as c from terms),
drawn as (
  select d.*, (('0x' || substr(md5('{seed}|' || d.doc_id), 1, 13))::bigint)::double / 4503599627370496.0 as u from documents d),
counted as (
  select doc_id, (select count(*) from cdf where cdf.source = drawn.source and drawn.u >= cdf.c) as n from drawn)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, cast(t.copy as integer) as copy,
  md5('{seed}#' || d.doc_id || '#' || t.copy) as shuffle_key
from documents d join counted using (doc_id), unnest(range(1, counted.n + 1)) t(copy)
"""
