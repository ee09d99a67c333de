"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

Method. Each source has a weight; all sources share ``share`` x the words of the corpus in
proportion to their weights, no source beyond ``cap`` x its own words (the excess goes to the
others by weight). The mix is dealt in equal blocks of ``block`` words, fewer where the smallest target
is below ``fine`` such blocks (at least one word), so that a small source meets its target too: the blocks go to the sources by
highest quotients target/(2k-1), and each source's blocks to its shards (a seeded hash of the
document id) in the same way by shard size. Inside a shard the documents stand in a seeded
order; whole passes over the shard come first, then the quota's rest is filled in that order, so
the taken words of a shard are its quota and no document exceeds ``cap`` x its words. What a
shard's blocks hold beyond ``cap`` x its words is dealt on, word by word, to the source's other
shards in their order, up to ``cap`` x theirs: a source of few short documents gets its blocks too.

Quotients are ranked only near the threshold: a seat count of the highest-quotients method
differs from round(target/block) by at most share x (n/2 + 1) + 1, so about 3 n candidates are
ranked for n sources, however many blocks there are. A source has one shard for every
``shard_docs`` of its documents, so a window holds about that many rows of a source, a hot one too.

Defined cases: null or blank text has size 0 and is never taken; a null source is a source of
its own, last in order; no words at all give targets of 0; rows that repeat a ``doc_id`` are
separate documents that share its place in the order (told apart by size; equal rows get equal
numbers only when their words are both taken or both left, so at a quota's edge one is taken
first); a very long text is one document, taken in part where the quota ends inside it; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

WEIGHTS, SHARE, CAP, BLOCK, FINE, SHARD_DOCS, SEED = (3, 1, 2), 1.5, 2, 64, 128, 4_000, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words: the text's length after each word is replaced by one character and
    separators are dropped."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "\x00"), r"[\x20\x09-\x0D]+", "")).cast("long")


def seeded(id_col: Column, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":" + seed)))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``(source, source_size, n_docs, target)`` in words, from ``(source, size)``."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1))
    s = s.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * cap).cast("double"))
    # water filling: sources in the order of limit/weight; a prefix of them is at its limit
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("spent")) / F.col("left_w"))
    )
    # the first source below its limit sets the level of all from there on
    free = F.col("limit") > F.col("weight") * F.col("level")
    level = F.min(F.when(free, F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(every)["level"]
    target = F.when(level.isNotNull() & (F.col("limit") > F.col("weight") * level), F.col("weight") * level).otherwise(F.col("limit"))
    return s.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def apportion(parts: DataFrame, group: list[str], claim: str, total: str, order: list[Column]) -> DataFrame:
    """Sainte-Lague seats: adds ``seats`` to ``parts``; in each group ``total`` seats go to the
    highest quotients claim/(2k-1), ties by ``order``. A claim of 0 gets none."""
    w = Window.partitionBy(*group)
    all_claims = F.sum(claim).over(w)
    p = parts.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_share", F.when(all_claims > 0, F.col(claim) / all_claims).otherwise(0.0))
    p = p.withColumn("_margin", F.ceil(F.col("_n") * F.col("_share")).cast("long") + 2)
    p = p.withColumn("_base", F.greatest(F.lit(0).cast("long"), F.round(F.col("_share") * F.col(total)).cast("long") - F.col("_margin")))
    p = p.withColumn("_extra", F.col(total) - F.sum("_base").over(w))
    seat = F.explode(F.sequence(F.col("_base") + 1, F.col("_base") + 2 * F.col("_margin") + 1))
    q = p.filter(F.col(claim) > 0).withColumn("_k", seat).withColumn("_q", F.col(claim) / (2 * F.col("_k") - 1))
    rank = F.row_number().over(w.orderBy(F.col("_q").desc(), *order))
    won = q.withColumn("_won", (rank <= F.col("_extra")).cast("long"))
    keep = [c for c in parts.columns]
    return won.groupBy(*keep).agg((F.min("_base") + F.sum("_won")).alias("seats"))


def mix(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, fine: int = FINE,
    shard_docs: int = SHARD_DOCS, seed: str = SEED, keep: list[str] | None = None,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs``.

    ``keep`` names further columns to carry (the pipeline stage carries the text).
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *(keep or []))
    targets = source_targets(sized.select("source", "size"), weights, share, cap)
    targets = targets.withColumn("shards", (F.floor(F.col("n_docs") / shard_docs) + 1).cast("long"))
    every = Window.partitionBy()  # one row a source
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    blocks = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(smallest / fine))).cast("long"))
    blocks = blocks.withColumn("blocks", F.floor(F.sum("target").over(every) / F.col("block")).cast("long")).withColumn("g", F.lit(0))
    quota = apportion(blocks, ["g"], "target", "blocks", [F.col("source").asc_nulls_last()]).select(
        F.col("source").alias("q_source"), "seats", "block")

    key = seeded(F.col("doc_id"), seed)
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "shards")
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    rows = rows.withColumn("key", key).withColumn("shard", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("shards"))

    shards = rows.groupBy("source", "shard").agg(F.sum("size").cast("long").alias("shard_size"))
    shards = shards.join(quota, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source").withColumnRenamed("seats", "blocks")
    won = apportion(shards.withColumn("claim", F.col("shard_size").cast("double")), ["source"], "claim", "blocks", [F.col("shard")])
    won = won.select(F.col("source").alias("w_source"), F.col("shard").alias("w_shard"), "shard_size", (F.col("seats") * F.col("block")).alias("quota"))

    limit = F.col("shard_size") * cap
    by_shard = Window.partitionBy("w_source").orderBy("w_shard").rowsBetween(Window.unboundedPreceding, -1)
    won = won.withColumn("spare", F.greatest(F.lit(0), limit - F.col("quota")))
    won = won.withColumn("over", F.sum(F.greatest(F.lit(0), F.col("quota") - limit)).over(Window.partitionBy("w_source")))
    won = won.withColumn("left", F.col("over") - F.coalesce(F.sum("spare").over(by_shard), F.lit(0)))
    dealt_on = F.greatest(F.lit(0), F.least(F.col("spare"), F.col("left")))
    won = won.withColumn("quota", (F.least(F.col("quota"), limit) + dealt_on).cast("long")).drop("spare", "over", "left")

    w = Window.partitionBy("source", "shard").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))
    rows = rows.join(won, F.col("source").eqNullSafe(F.col("w_source")) & (F.col("shard") == F.col("w_shard")), "left")
    whole = F.least(F.lit(cap), F.floor(F.col("quota") / F.col("shard_size"))).cast("long")
    rest = F.col("quota") - whole * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    taken = F.when(F.col("shard_size") > 0, F.least(F.col("size") * cap, F.col("size") * whole + part)).otherwise(F.lit(0))
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), *(keep or []))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


SQL = {
    "op8_source_mix": f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}') AS key
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source),
s1 AS (
  SELECT *, ([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    (source_size * {CAP})::DOUBLE AS lim FROM s0),
s2 AS (
  SELECT *, sum(source_size) OVER () * {SHARE}::DOUBLE AS total,
    coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w
  FROM s1),
s3 AS (SELECT *, (total - spent) / left_w AS level FROM s2),
s4 AS (
  SELECT s3.*, (SELECT arg_min(level, lim / weight) FROM s3 WHERE lim > weight * level) AS lv,
    (floor(n_docs / {SHARD_DOCS}) + 1)::BIGINT AS shards FROM s3),
t AS (SELECT source, source_size, n_docs, shards, CASE WHEN lv IS NOT NULL AND lim > weight * lv THEN weight * lv ELSE lim END AS target FROM s4),
b AS (SELECT greatest(1, least({BLOCK}, floor(min(target) FILTER (target > 0) / {FINE})))::BIGINT AS block FROM t),
a0 AS (SELECT source, target, floor(sum(target) OVER () / (SELECT block FROM b))::BIGINT AS blocks, count(*) OVER () AS n,
  CASE WHEN sum(target) OVER () > 0 THEN target / sum(target) OVER () ELSE 0 END AS share FROM t),
a1 AS (SELECT *, ceil(n * share)::BIGINT + 2 AS margin FROM a0),
a2 AS (SELECT *, greatest(0, round(share * blocks)::BIGINT - margin) AS base FROM a1),
a3 AS (SELECT *, blocks - sum(base) OVER () AS extra FROM a2),
a4 AS (SELECT *, unnest(range(base + 1, base + 2 * margin + 2)) AS k FROM a3 WHERE target > 0),
a5 AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST) AS r FROM a4),
q AS (SELECT source, (min(base) + count(*) FILTER (r <= extra))::BIGINT AS blocks FROM a5 GROUP BY source),
r AS (SELECT d.*, t.source_size, t.target, ('0x' || substr(key, 1, 8))::BIGINT % t.shards AS shard
  FROM d LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h0 AS (SELECT source, shard, sum(size)::BIGINT AS shard_size FROM r GROUP BY 1, 2),
h1 AS (SELECT h0.*, q.blocks, count(*) OVER (PARTITION BY h0.source) AS n,
  CASE WHEN sum(shard_size) OVER (PARTITION BY h0.source) > 0 THEN shard_size::DOUBLE / sum(shard_size) OVER (PARTITION BY h0.source) ELSE 0 END AS share
  FROM h0 JOIN q ON h0.source IS NOT DISTINCT FROM q.source),
h2 AS (SELECT *, ceil(n * share)::BIGINT + 2 AS margin FROM h1),
h3 AS (SELECT *, greatest(0, round(share * blocks)::BIGINT - margin) AS base FROM h2),
h4 AS (SELECT *, blocks - sum(base) OVER (PARTITION BY source) AS extra FROM h3),
h5 AS (SELECT *, unnest(range(base + 1, base + 2 * margin + 2)) AS k FROM h4 WHERE shard_size > 0),
h6 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * k - 1) DESC, shard) AS rn FROM h5),
w0 AS (SELECT source, shard, shard_size, (min(base) + count(*) FILTER (rn <= extra))::BIGINT * (SELECT block FROM b) AS quota, shard_size * {CAP} AS lim
  FROM h6 GROUP BY 1, 2, 3),
w1 AS (SELECT *, greatest(0, lim - quota) AS spare, sum(greatest(0, quota - lim)) OVER (PARTITION BY source) AS beyond FROM w0),
w2 AS (SELECT *, beyond - coalesce(sum(spare) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM w1),
w AS (SELECT source, shard, shard_size, (least(quota, lim) + greatest(0, least(spare, rest)))::BIGINT AS quota FROM w2),
x AS (
  SELECT r.*, w.quota, w.shard_size,
    coalesce(sum(size) OVER (PARTITION BY r.source, r.shard ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM r LEFT JOIN w ON r.source IS NOT DISTINCT FROM w.source AND r.shard = w.shard),
y AS (SELECT *, least({CAP}, floor(quota::DOUBLE / shard_size))::BIGINT AS whole FROM x)
SELECT doc_id, size, source_size, target,
  coalesce(CASE WHEN shard_size > 0 THEN least(size * {CAP}, size * whole + greatest(0, least(size, quota - whole * shard_size - before))) ELSE 0 END, 0)::BIGINT AS taken
FROM y"""
}
