"""Operator 6, mixing sources to target weights: Poisson replication.

A source's rate is its target weight times the total over what it has, so the
expected output has the input's size and each source its target share.  Each
document gets a count from the Poisson distribution of that mean, by inverting
the distribution at a number that depends on the seed and the document's id
alone, so a task that is run again repeats what it did.  Documents are exploded by
their counts and the copies sorted by a hash: a global shuffle.

A mean over ``PART`` is split into equal parts that are drawn apart and added up,
which has the same distribution and keeps exp(-mean) within a double.

Defined results: a null source is the source ""; a null id counts as "" in the
hash; rows with equal ids get equal counts, each row its own copies; null and
empty texts are replicated like any other; a source without a weight gets none of
the output; an empty table gives an empty table; extra columns are carried along.
The operator's own columns are copy, n_copies, rate and shuffle_key; where the input
has a column of that name, in whatever case, the operator's gets underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salted_join

SEED = 17
PART = 256.0
#: Sources up to which their table of rates is broadcast.
FEW = 4096
OWN = ("rate", "n_copies", "copy", "shuffle_key")
#: Copies of a document that one task makes; more are made by several.
BLOCK = 1024


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) from the hash of the parts as text: 52 bits."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """_source, rate, _parts, _cdf.  Without ``weights``, all sources weigh the same."""
    counts = docs.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        shares = counts.withColumn("_w", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([("" if k is None else k, float(w)) for k, w in weights.items()] or [("", 0.0)], "_source string, _w double")
        shares = counts.join(given, "_source", "left").fillna(0.0, ["_w"])
    total = shares.agg(F.sum("_n").alias("_all"), F.sum("_w").alias("_sum"))
    rate = F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum") * F.col("_all") / F.col("_n")).otherwise(F.lit(0.0))
    out = shares.join(F.broadcast(total)).select("_source", rate.alias("rate"))  # one row
    mean = F.col("rate") / F.col("_parts")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def more(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    out = out.withColumn("_parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    return out.withColumn("_cdf", F.aggregate(F.sequence(F.lit(1), last), zero, more, lambda s: s["c"]))


def own_names(columns: list[str]) -> dict[str, str]:
    """The name of each of the operator's columns beside ``columns``."""
    taken, out = {c.lower() for c in columns}, {}
    for name in OWN:
        free = name
        while free.lower() in taken:
            free = f"_{free}"
        out[name] = free
    return out


def replicate(df: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, source: str = "source", id: str = "doc_id") -> DataFrame:
    """``df``'s columns with rate, n_copies and copy (from 0), in the order of shuffle_key."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    docs = df.select(row, F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("_source"), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("_id"))
    table = rates(docs.select("_source"), weights)
    if table.select("_source").limit(FEW + 1).count() <= FEW:
        docs = docs.join(F.broadcast(table), "_source")
    else:
        docs = salted_join(docs, table, ["_source"], F.col("_id"), "inner")
    highest = table.agg(F.max("rate")).first()[0] or 0.0
    drawn = lambda part: F.size(F.filter(F.col("_cdf"), lambda c: c <= uniform(F.lit(str(seed)), F.col("_id"), part.cast("string"))))
    count = F.when(F.col("_parts") == 1, drawn(F.lit(1))).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda total, part: total + drawn(part)))
    docs = docs.select("_row", "_id", "rate", count.alias("n_copies")).where("n_copies > 0")
    last = F.col("n_copies") - 1
    copies = docs.where(last < BLOCK).withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
    # A count over twice the highest rate and BLOCK is out of the distribution's reach.
    if highest > BLOCK / 2 - 64:
        blocks = docs.where(last >= BLOCK).withColumn("_block", F.explode(F.sequence(F.lit(0), last, F.lit(BLOCK)))).repartition("_id", "_block")
        many = blocks.withColumn("copy", F.explode(F.sequence("_block", F.least(F.col("_block") + BLOCK - 1, last)))).drop("_block")
        copies = copies.unionByName(many)
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}s"), F.col("_id"), F.col("copy").cast("string")).cast("binary"))
    names = own_names(df.columns)
    own = [F.col(c).alias(names[c]) for c in ("rate", "n_copies", "copy")]
    return copies.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns), *own, key.alias(names["shuffle_key"])).orderBy(f"`{names['shuffle_key']}`")


def sql(docs: str = "documents", seed: int = SEED) -> str:
    """The same for DuckDB, for equal weights and rates up to ``PART``."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, text FROM {docs}),
r AS (SELECT source, 1.0::DOUBLE / (count(*) OVER ())::DOUBLE * (sum(n) OVER ())::DOUBLE / n::DOUBLE AS rate
      FROM (SELECT source, count(*) AS n FROM d GROUP BY 1)),
c(source, rate, k, p, cdf) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
u AS (SELECT *, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d),
lists AS (SELECT source, list(cdf) AS l FROM c GROUP BY 1),
n AS (SELECT u.doc_id, u.source, u.text, len(list_filter(l, lambda x: x <= u.u))::INTEGER AS n_copies FROM u JOIN lists USING (source))
SELECT doc_id, source, n_copies, copy, md5('{seed}s:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR) AS shuffle_key, text
FROM (SELECT *, unnest(range(n_copies))::INTEGER AS copy FROM n)"""
