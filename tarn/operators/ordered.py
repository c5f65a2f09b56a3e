"""Work along an order: running sums, as-of joins and joins of points with intervals, without one task for a hot key."""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.window import Window

from tarn.plans.state import join_dealt, ship

#: Rows that a slice of the order should have, and slices along it at most (64 x 64).
EACH, GROUPS = 1 << 20, 64
#: Points of one bin of intervals beyond which they are dealt to parts.
CROWDED = 100_000
#: Buckets of keys that a slice of the order is dealt to.
BUCKETS = 16


def slices(rows: DataFrame, at: Column, each: int = EACH) -> Column:
    """The slice of the order that `at` lies in: slices have about `each` rows, whatever the values' distribution.

    Equal values are in one slice. The cuts are approximate quantiles, at most 4096 literals.
    """
    rows = rows.select(at.alias("v"))
    kind, counted = rows.schema["v"].dataType, rows.agg(F.count("v").alias("n")).first()["n"]
    wanted = min(GROUPS * GROUPS, counted // each)
    if wanted < 2:
        return F.lit(0)
    cuts = rows.agg(F.percentile_approx("v", [k / wanted for k in range(1, wanted)], 10 * GROUPS * GROUPS).alias("q")).first()["q"]
    cuts = sorted(set(cuts))
    groups = [cuts[k : k + GROUPS] for k in range(0, len(cuts), GROUPS)]
    passed = lambda values: F.size(F.filter(F.array(*(F.lit(v).cast(kind) for v in values)), lambda x: x <= at))
    if len(groups) == 1:
        return passed(cuts)
    group = passed([g[0] for g in groups]) - 1
    table = F.array(*(F.array(*(F.lit(v).cast(kind) for v in g)) for g in groups))
    return F.when(group < 0, F.lit(0)).otherwise(group * GROUPS + F.size(F.filter(F.get(table, group), lambda x: x <= at)))


def running_sum(rows: DataFrame, order: str, value: str, into: str, each: int = EACH) -> DataFrame:
    """The rows with the sum of value up to and with each, in the order of a column of distinct values.

    Slices of the order are summed apart, then over slices (a row for each), so no task has all rows.
    """
    dealt = rows.withColumn("__slice", slices(rows, F.col(order), each))
    sums = dealt.groupBy("__slice").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__slice", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))  # a row for each slice
    own = F.sum(value).over(Window.partitionBy("__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__own", own).join(F.broadcast(bases), "__slice").select(*rows.columns, (F.col("__base") + F.col("__own")).alias(into))


def as_of(left: DataFrame, right: DataFrame, left_at: str, right_at: str, by: list[tuple[str, str]] | None = None, within: Column | None = None, exact: bool = True, prefix: str = "r_", each: int = EACH) -> DataFrame:
    """Each left row with the last right row of its key at or before it; right columns get a prefix, NULL without one.

    by: pairs of left and right columns that must be equal. within: how far back the right row may be, as an interval
    or a number. Without `exact` a right row must be earlier. Of right rows at one time, the greatest by all its columns
    is taken. A left row with a null key or time finds nothing; right rows with one are never found.

    Both sides are sorted once, together: within a key and a slice of the order the last right row is carried on, and the
    last one of earlier slices comes from a table of one row for each key and slice. So a key that has a third of all
    rows is spread over its slices, and nothing is paired that isn't returned.
    """
    by = by or []
    keys = [f"__k{i}" for i in range(len(by))]
    l_key = [F.col(a).alias(k) for (a, _), k in zip(by, keys, strict=True)]
    r_key = [F.col(b).alias(k) for (_, b), k in zip(by, keys, strict=True)]
    whole = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    r_kind, l_kind = right.select(whole(right).alias("r")).schema["r"].dataType.simpleString(), left.select(whole(left).alias("l")).schema["l"].dataType.simpleString()
    found = right.where(F.col(right_at).isNotNull()).select(*r_key, F.col(right_at).alias("__t"), F.lit(None).cast(l_kind).alias("__l"), whole(right).alias("__r"))
    found = found.dropna(subset=keys) if keys else found
    asked = left.select(*l_key, F.col(left_at).alias("__t"), whole(left).alias("__l"), F.lit(None).cast(r_kind).alias("__r"))
    both = asked.unionAll(found)
    both = both.withColumn("__slice", F.coalesce(slices(both, F.col("__t"), each), F.lit(-1)))
    # Right rows stand before left ones of the same time, or after them where only earlier ones count.
    side = F.col("__r").isNull() if exact else F.col("__r").isNotNull()
    order = Window.partitionBy(*keys, "__slice").orderBy(F.col("__t").asc_nulls_first(), side, F.col("__r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__last", F.last("__r", ignorenulls=True).over(order)).where(F.col("__l").isNotNull())
    ends = both.groupBy(*keys, "__slice").agg(F.max(F.when(F.col("__r").isNotNull(), F.struct("__t", "__r"))).alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__slice", F.last("__end", ignorenulls=True).over(earlier)["__r"].alias("__before")).where(F.col("__before").isNotNull())
    got = carried.join(ends, [*keys, "__slice"], "left").withColumn("__r", F.coalesce("__last", "__before"))
    if within is not None:
        got = got.withColumn("__r", F.when(F.col("__r")[right_at] >= F.col("__t") - within, F.col("__r")))
    got = got.withColumn("__r", F.when(F.col("__t").isNotNull(), F.col("__r")))
    return got.select("__l.*", *(F.col("__r")[c].alias(f"{prefix}{c}") for c in right.columns))


def within_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: list[tuple[str, str]] | None = None, prefix: str = "r_") -> DataFrame:
    """The pairs of a point and an interval of its key with start <= at < end; the intervals' columns get a prefix.

    An interval goes to bins of the smallest power-of-two width that isn't less than its length, so it lies in at most
    two; a point looks into its bin of each width that any interval has (at most 64). Bins are joined by equality. Points
    of a crowded bin are dealt to parts, and its intervals copied to each part, so no task has all of a hot bin.
    Nulls and empty intervals pair with nothing. Numbers, dates and timestamps
    serve.
    """
    by = by or []
    keys = [f"__k{i}" for i in range(len(by))]
    kind = dict(points.dtypes)[at]
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") if kind.startswith(("date", "timestamp")) else F.col(c).cast("double")
    whole = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    length = number(end) - number(start)
    r = intervals.where(length > 0).select(*(F.col(b).alias(k) for (_, b), k in zip(by, keys, strict=True)), F.ceil(F.log2(length)).cast("int").alias("__level"), number(start).alias("__a"), number(end).alias("__b"), whole(intervals).alias("__r"))
    levels = [x["__level"] for x in r.select("__level").distinct().orderBy("__level").collect()]  # powers of two
    scale = lambda level: F.pow(F.lit(2.0), level)
    bin_of = lambda v, level: F.floor(v / scale(level)).cast("long")
    bins = F.array_distinct(F.array(bin_of(F.col("__a"), F.col("__level")), bin_of(F.col("__b"), F.col("__level"))))
    r = r.withColumn("__bin", F.explode(bins))
    point = points.where(F.col(at).isNotNull()).select(*(F.col(a).alias(k) for (a, _), k in zip(by, keys, strict=True)), number(at).alias("__t"), whole(points).alias("__l"))
    seen = point.withColumn("__level", F.explode(F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>"))).withColumn("__bin", bin_of(F.col("__t"), F.col("__level")))
    cell = [*keys, "__level", "__bin"]
    hit = join_dealt(seen, r, cell, CROWDED).where((F.col("__a") <= F.col("__t")) & (F.col("__t") < F.col("__b")))
    return hit.select("__l.*", *(F.col("__r")[c].alias(f"{prefix}{c}") for c in intervals.columns))


def _between(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The sums of v[i:j], out of those of pairs, of pairs of pairs and so on: nothing is subtracted, so values outside
    a range leave no error in it."""
    i, j, total = i.copy(), j.copy(), np.zeros(len(i))
    with np.errstate(all="ignore"):
        while (live := i < j).any():
            first = live & (i & 1 == 1)
            total[first] += v[i[first]]
            last = live & (j & 1 == 1)
            j -= last
            total[last] += v[j[last]]
            i, j = (i + first) >> 1, j >> 1
            v = np.append(v, 0.0) if len(v) & 1 else v
            v = v[::2] + v[1::2]
    return total


def _codes(left: pa.Table, right: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key of the rows on both sides."""
    code = np.zeros(left.num_rows + right.num_rows, np.int64)
    for k in keys:
        each = pa.concat_arrays([*left.column(k).chunks, *right.column(k).chunks]).dictionary_encode()
        code = np.unique(code * len(each.dictionary) + each.indices.to_numpy(), return_inverse=True)[1]
    return code[: left.num_rows], code[left.num_rows :]


def interval_sums(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, value: str, per: list[str], by: list[tuple[str, str]] | None = None, each: int = EACH, room: int = EACH) -> DataFrame:
    """per, hits, total: the number of pairs of `within_intervals` and their sum of value, grouped by columns of the intervals.

    No pair is formed: points lie in slices of the order and buckets of their keys. An interval asks the slices that it
    begins and ends in, and the sums of the whole slices between, each by a few sums of runs of points. So work grows with
    points and intervals, not with pairs. Where a slice's bucket has more than `room` rows of a side, points of equal key
    and time, and equal intervals, become one, and that side is dealt to parts. total is NULL if no value is known; groups
    without a pair are left out. Both sides are read several times; they should be settled or cheap.
    """
    by = by or []
    keys = [f"__k{i}" for i in range(len(by))]
    kind = dict(points.dtypes)[at]
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") if kind.startswith(("date", "timestamp")) else F.col(c).cast("double")
    kinds = points.select(*(a for a, _ in by)).unionAll(intervals.select(*(b for _, b in by))).schema if by else []
    named = lambda side: [F.col(pair[side]).cast(f.dataType).alias(k) for pair, k, f in zip(by, keys, kinds, strict=True)]
    point = points.select(*named(0), number(at).alias("__t"), F.col(value).cast("double").alias("__v")).where("not isnan(__t)").dropna(subset=[*keys, "__t"])
    span = intervals.select(*named(1), number(start).alias("__a"), number(end).alias("__b"), *(F.col(c) for c in per)).where("__a < __b")
    span = span.dropna(subset=keys) if keys else span
    wanted = min(GROUPS, point.count() // each)
    cuts = sorted(set(point.agg(F.percentile_approx("__t", [k / wanted for k in range(1, wanted)], 10 * GROUPS * GROUPS).alias("q")).first()["q"])) if wanted > 1 else []
    passed = lambda v: reduce(operator.add, ((F.lit(c) <= v).cast("int") for c in cuts), F.lit(0))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int") if keys else F.lit(0)

    one = F.lit(1).cast("long")
    point = point.select(bucket.alias("__bucket"), passed(F.col("__t")).alias("__slice"), *keys, "__t", one.alias("__n"), F.col("__v").isNotNull().cast("long").alias("__known"), "__v")
    if len(cuts) > 1:  # whole slices, as points of a slice of their own
        whole = point.groupBy("__bucket", "__slice", *keys).agg(F.sum("__n").alias("__n"), F.sum("__known").alias("__known"), F.sum("__v").alias("__v"))
        point = point.unionAll(whole.select("__bucket", F.lit(-1), *keys, F.col("__slice").cast("double"), "__n", "__known", "__v"))
    span = span.withColumns({"__s": passed(F.col("__a")), "__e": passed(F.col("__b"))})
    asks = lambda s, a, b: F.struct(s.alias("s"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    first, last = asks(F.col("__s"), F.col("__a"), F.col("__b")), asks(F.col("__e"), F.col("__a"), F.col("__b"))
    middle = asks(F.lit(-1), F.col("__s") + 1, F.col("__e"))
    pieces = F.when(F.col("__e") == F.col("__s"), F.array(first)).when(F.col("__e") == F.col("__s") + 1, F.array(first, last)).otherwise(F.array(first, last, middle))
    span = span.withColumn("__ask", F.explode(pieces)).select(bucket.alias("__bucket"), F.col("__ask.s").alias("__slice"), *keys, F.col("__ask.a").alias("__a"), F.col("__ask.b").alias("__b"), *per)

    cell = ["__bucket", "__slice"]
    rows = lambda df: {(r[0], r[1]): r[2] for r in df.groupBy(*cell).count().collect()}  # noqa: E731  at most (GROUPS + 1) * BUCKETS
    here, there = rows(point), rows(span)
    parts = [(*c, -(-n // room), -(-there[c] // room)) for c, n in here.items() if c in there]
    if any(p > 1 or q > 1 for *_, p, q in parts):
        point = point.groupBy(*cell, *keys, "__t").agg(F.sum("__n").alias("__n"), F.sum("__known").alias("__known"), F.sum("__v").alias("__v"))
        span = span.groupBy(*span.columns).agg(F.count(F.lit(1)).alias("__times"))
        dealt = F.broadcast(points.sparkSession.createDataFrame(parts, "__bucket int, __slice int, __p int, __q int"))
        own = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        point = point.join(dealt, cell).withColumns({"__i": own(point, "__p")}).withColumn("__j", every("__q")).drop("__p", "__q")
        span = span.join(dealt, cell).withColumns({"__j": own(span, "__q").cast("int")}).withColumn("__i", every("__p")).drop("__p", "__q")
        point, cell = point.withColumn("__i", F.col("__i").cast("int")), [*cell, "__i", "__j"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return right.select(per).slice(0, 0).append_column("hits", pa.array([], pa.int64())).append_column("total", pa.array([], pa.float64()))
        mine, asked = _codes(left, right, keys)
        t, n, known, v = (left.column(c).to_numpy() for c in ("__t", "__n", "__known", "__v"))
        times = np.unique(t)
        place = lambda code, at: code * (len(times) + 1) + np.searchsorted(times, at)
        placed = place(mine, t)
        order = np.argsort(placed)
        i, j = (np.searchsorted(placed[order], place(asked, right.column(c).to_numpy())) for c in ("__a", "__b"))
        counts = lambda x: (lambda upto: upto[j] - upto[i])(np.append(0, np.cumsum(x[order])))
        hits, some, total = counts(n), counts(known) > 0, _between(np.where(known > 0, v, 0.0)[order], i, j)
        if "__times" in right.column_names:
            hits, total = hits * right.column("__times").to_numpy(), total * right.column("__times").to_numpy()
        out = right.select(per).append_column("hits", pa.array(hits.astype(np.int64))).append_column("total", pa.array(total, mask=~some))
        return out.filter(pa.array(hits > 0))

    ship(points.sparkSession)
    schema = StructType([*intervals.select(*per).schema.fields]).add("hits", LongType()).add("total", DoubleType())
    found = point.groupBy(*cell).cogroup(span.groupBy(*cell)).applyInArrow(meet, schema)
    return found.groupBy(*per).agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"))
