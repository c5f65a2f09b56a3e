"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm.common import documents, settled

#: Rows of a range partition, on average.
PART_ROWS = 500_000


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 1 / 64) -> DataFrame:
    """Deal documents into `shards` contiguous runs of near equal bytes.

    The order is (md5 of the text, id), so equal texts are neighbours. The rows are range partitioned in that order,
    each partition's bytes and rows are summed, and the sums before a partition plus a running sum within it give
    each row's place in the whole. Cuts stand at equal byte targets. A cut between equal texts moves to where they
    begin or end, whichever is nearer, as long as the shards stay near equal: it never moves by more than `tolerance`
    of a shard's bytes for the sake of a group that is larger than that. So equal texts share a shard unless their
    group is larger than the tolerance and lies across a cut.

    Returns id, size (UTF-8 bytes + 1), text_crc32, shard, slot (gapless from 0 in each shard).

    A null text counts as empty (size 1, crc 0); a very long one is a row like any other, and a shard may pass its
    target by the longest row. Null ids come first among equal texts. Repeated rows each get a slot of their own; a
    number that each row has on arrival keeps them apart, so they too are spread over partitions. An empty table
    gives an empty result; with fewer bytes than shards some shards stay empty. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("h"),
        F.monotonically_increasing_id().alias("nth"),
    )
    sized, order = settled(sized), ["h", "doc_id", "nth"]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sized.count() // PART_ROWS))
    # The partition number must be the same in every later use, so the dealt rows are settled.
    dealt = settled(sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"))
    within = Window.partitionBy("part").orderBy(*order)
    placed = settled(
        dealt.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(offsets), "part")  # one row of three numbers for each PART_ROWS rows
        .select("doc_id", "size", "text_crc32", "h", (F.col("byte0") + F.col("upto") - F.col("size")).alias("start"), (F.col("row0") + F.col("nth") - 1).alias("rank"))
    )
    cuts = _cuts(placed, totals.agg(F.sum("bytes")).first()[0] or 0, shards, tolerance)
    first = placed.agg(*(F.coalesce(F.sum((F.col("start") < c).cast("long")), F.lit(0)).alias(f"c{i}") for i, c in enumerate(cuts)), F.lit(0).alias("none")).first()
    shard, base = F.lit(0), F.lit(0).cast("long")
    for i, c in enumerate(cuts):
        shard = shard + (F.col("start") >= c).cast("int")
        base = F.when(F.col("start") >= c, F.lit(first[i])).otherwise(base)
    return placed.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("rank") - base).cast("long").alias("slot"))


def _cuts(placed: DataFrame, total: int, shards: int, tolerance: float) -> list[int]:
    """The byte offsets at which shards 1, 2, ... begin; the driver sees at most two rows for each cut."""
    targets = [total * k // shards for k in range(1, shards)]
    if not total or not targets:
        return targets
    over = F.exists(F.array(*map(F.lit, targets)), lambda t: (F.col("start") <= t) & (F.col("start") + F.col("size") > t))
    rows = placed.where(over).select("h", "start", "size").collect()
    own = placed.where(F.col("h").isin([bytes(h) for h in {bytes(r["h"]) for r in rows}]))
    spans = {bytes(g["h"]): (g["low"], g["high"]) for g in own.groupBy("h").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("size")).alias("high")).collect()}
    found = []
    for t in targets:
        r = next(r for r in rows if r["start"] <= t < r["start"] + r["size"])
        low, high = spans[bytes(r["h"])]
        if high - low > total / shards * tolerance:
            low, high = r["start"], r["start"] + r["size"]
        found.append(low if t - low <= high - t else high)
    return found


def op7_byte_prefix_shards(spark, sf_dir: str) -> DataFrame:
    out = byte_shards(documents(spark, sf_dir), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP7_SQL = """
WITH polynomial AS MATERIALIZED (
  SELECT list(list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)),
sized AS (
  SELECT doc_id, md5(coalesce(text, '')) AS h, hex(encode(coalesce(text, ''))) AS x FROM documents),
summed AS (
  SELECT doc_id, h, CAST(length(x) // 2 + 1 AS BIGINT) AS size,
         CAST(xor(list_reduce(range(0, length(x) // 2), lambda a, k: xor(a >> 8, t[(xor(a, CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT)) & 255) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32
  FROM sized, polynomial),
placed AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM summed),
grouped AS (
  SELECT *, min(start) OVER (PARTITION BY h) AS low, max(start + size) OVER (PARTITION BY h) AS high, CAST(sum(size) OVER () AS BIGINT) AS total FROM placed),
hit AS (
  SELECT total * k // 8 AS target, total, CASE WHEN high - low > CAST(total AS DOUBLE) / 8 / 64 THEN start ELSE low END AS low,
         CASE WHEN high - low > CAST(total AS DOUBLE) / 8 / 64 THEN start + size ELSE high END AS high
  FROM grouped, range(1, 8) AS r(k) WHERE start <= total * k // 8 AND start + size > total * k // 8),
cuts AS (SELECT list(CASE WHEN target - low <= high - target THEN low ELSE high END) AS c FROM hit),
dealt AS (SELECT doc_id, size, text_crc32, start, CAST(len(list_filter(c, lambda x: x <= start)) AS INTEGER) AS shard FROM placed, cuts)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""
