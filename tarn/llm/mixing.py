"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm.common import WORD, documents, packed, settled

WEIGHTS = (5, 2, 1)
#: Rows of a bucket over all sources and size classes, on average.
BUCKET_ROWS = 1_000_000


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """How often each document goes into a mix whose sources have given weights.

    Sources in code-point order (null last) take `weights` in turn and divide `share` of all words by them. No
    target passes `most` times its source's words; what is left over goes to the others by weight. A document's
    expected copies are its source's target over its source's words. Within a source, documents stand by size class
    (an eighth of a power of two), then by an md5 of id and text; the expected copies are summed along that order
    from a random offset, and each integer that the sum crosses is a copy. Walking by size keeps the words taken
    within about one document of the target.

    The place in the order comes from the sums of all earlier buckets plus a count within the bucket. Buckets are
    leading digits of the md5, more of them the more rows there are, so the order doesn't depend on their number, and
    a source with most of the rows is spread over as many tasks as its rows fill.

    Returns id, size, source, source_size, target, expected, copies, taken (copies * size); with `carry` also doc, the row.

    A null text has size 0. Documents of size 0 take part (taken 0); very long ones are rows like any other. A source
    without words has target 0. Rows of a null id or a repeated one are told apart by their text; rows equal in both
    are counted one by one, and which of them is taken doesn't matter to id, text and source. Ties can't occur
    otherwise. An empty table gives an empty result. Other columns may have any name.
    """
    n = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    place_key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n.alias("size"), place_key.alias("md5"), F.struct(*docs.columns).alias("doc"))
    sized = settled(whole.drop("doc"))
    digits = 2
    while digits < 8 and sized.count() > BUCKET_ROWS * 16**digits:
        digits += 1
    key = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name")]
    bits = F.length(F.bin("size"))
    bucket = F.substring("md5", 1, digits)
    placed = [
        "doc_id", "size", "md5", *key,
        (bits * 8 + F.expr("shiftright(size * 8, length(bin(size)))")).cast("int").alias("class"),
        bucket.alias("bucket"),
    ]
    place = ["no_source", "name", "class", "bucket"]
    counts = sized.select(*placed).groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    earlier = Window.partitionBy("no_source", "name").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    rates = _rates(counts.groupBy("no_source", "name").agg(F.sum("words").alias("source_size")), weights, share, most, seed)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n", "words").join(rates, ["no_source", "name"])
    nth = F.row_number().over(Window.partitionBy(*place).orderBy("md5"))
    last = F.col("before") + F.col("nth")
    copies = F.floor(last * F.col("expected") + F.col("offset")) - F.floor((last - 1) * F.col("expected") + F.col("offset"))
    rows = whole.select(*placed, "doc") if carry else sized.select(*placed)
    return (
        rows.withColumn("nth", nth).join(starts, place)
        .withColumn("copies", copies.cast("long"))
        .select("doc_id", "size", F.when(~F.col("no_source"), F.col("name")).alias("source"), "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["doc"] if carry else []))
    )


def _rates(sources: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int) -> DataFrame:
    """Target, expected copies and offset of each source; the windows run over one row for each source."""
    nth = F.row_number().over(Window.orderBy("no_source", "name")).cast("long")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("nth", nth).withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("all", F.sum("source_size").over(everything))
    # Sources in the order in which a rising level meets their limits; the level holds if this one and all later ones are below theirs. It falls from then on, so the highest that holds counts.
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "nth")
    left = F.col("all") * share - F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))
    ranked = ranked.withColumn("fit", F.max(fits).over(everything))
    target = F.least(F.coalesce(F.col("fit") * F.col("weight"), F.col("limit").cast("double")), F.col("limit").cast("double"))
    offset = ((F.col("nth") * 2654435761 + seed * 40503) % 4294967296) / F.lit(4294967296.0)
    return ranked.withColumn("target", target).select(
        "no_source", "name", "source_size", "target", offset.alias("offset"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("expected")
    )


def op4_systematic_mix(spark, sf_dir: str) -> DataFrame:
    return packed(mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS name,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, text
  FROM documents),
placed AS (
  SELECT *, length(bin(size)) * 8 + ((size * 8) >> length(bin(size))) AS class,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place
  FROM sized),
sources AS (
  SELECT no_source, name, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY no_source, name) AS nth
  FROM placed GROUP BY no_source, name),
weighed AS (
  SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS lim,
         CAST(sum(source_size) OVER () AS BIGINT) AS everything
  FROM sources),
levels AS (
  SELECT *, (CAST(everything AS DOUBLE) * 1.5 - CAST(coalesce(sum(lim) OVER (ORDER BY CAST(lim AS DOUBLE) / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (ORDER BY CAST(lim AS DOUBLE) / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
fitted AS (
  SELECT *, max(CASE WHEN level <= CAST(lim AS DOUBLE) / weight THEN level END) OVER () AS fit FROM levels),
rates AS (
  SELECT no_source, name, source_size, least(coalesce(fit * weight, CAST(lim AS DOUBLE)), CAST(lim AS DOUBLE)) AS target,
         ((nth * 2654435761 + 7 * 40503) % 4294967296) / 4294967296.0::DOUBLE AS off
  FROM fitted),
walked AS (
  SELECT p.doc_id, p.size, r.source_size, r.target, r.off,
         CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0::DOUBLE END AS expected,
         row_number() OVER (PARTITION BY p.no_source, p.name ORDER BY class, place) AS nth
  FROM placed p JOIN rates r ON p.no_source = r.no_source AND p.name = r.name)
SELECT doc_id, size, source_size, target,
       CAST(floor(nth * expected + off) - floor((nth - 1) * expected + off) AS BIGINT) * size AS taken
FROM walked
"""
