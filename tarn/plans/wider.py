"""Named queries over walks, orders, gradient noise, files and streams, with the SQL that states the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarn.functions.noise import simplex_noise
from tarn.functions.values import uniform_sql
from tarn.operators import flow, ordered, paths, pyramid
from tarn.plans import catalog as c
from tarn.plans.catalog import NY, _r, query
from tarn.plans.model import NoiseParams
from tarn.plans.state import shared_folder
from tarn.streaming.cells import drain, running_means, sessions

# ---- sampled walks

WALKS, CELLS = 20_000, 48
_U = uniform_sql("id", 5)


def _walks_sql(starts: str, share: str) -> str:
    """Walks step by step, each over at most CELLS cells; `starts` has n and v."""
    return f"""WITH RECURSIVE g AS MATERIALIZED {c._graph_sql(c._TILT)}, size AS (SELECT count(*) AS cells FROM g), per AS MATERIALIZED ({c._PER}),
sums AS MATERIALIZED (SELECT n, rain, sum(rain) OVER (ORDER BY n) AS upto FROM per), draws AS (SELECT CAST(range AS BIGINT) AS id FROM range({WALKS})),
starts AS MATERIALIZED ({starts}),
walk AS (SELECT n, v, 1 AS seen FROM starts UNION ALL SELECT g.nxt, w.v, seen + 1 FROM walk w JOIN g USING (n) WHERE g.nxt >= 0 AND seen < {CELLS})
SELECT g.n, round(coalesce(sum(v), 0) * {share} / {WALKS}, 6) AS total FROM g LEFT JOIN walk USING (n) GROUP BY 1"""


_EVEN = f"SELECT CAST(floor({_U} * (SELECT cells FROM size)) AS BIGINT) AS n, 1.0::DOUBLE AS v FROM draws"


@query("sampled_walks", _walks_sql(_EVEN, "(SELECT cells FROM size)"))
def _sampled(spark, d):
    graph = flow.steepest(c.tilted(spark, d), NY).select("n", "nxt")
    return flow.accumulate_sampled(graph, WALKS, CELLS, seed=5, ny=NY).select("n", *_r("total"))


@query("sampled_walks_weighted", _walks_sql(f"SELECT n, rain AS v FROM ({_EVEN}) JOIN per USING (n)", "(SELECT cells FROM size)"))
def _sampled_weighted(spark, d):
    graph = flow.steepest(c.tilted(spark, d), NY).select("n", "nxt")
    return flow.accumulate_sampled(graph, WALKS, CELLS, c.per_order(spark, d).select("n", F.col("rain").alias("s")), seed=5, ny=NY).select("n", *_r("total"))


@query("sampled_walks_reservoir", _walks_sql(f"SELECT s.n, 1.0::DOUBLE AS v FROM (SELECT {_U} * (SELECT max(upto) FROM sums) AS place FROM draws) ASOF JOIN (SELECT n, upto - rain AS low FROM sums WHERE rain > 0) s ON place >= low", "(SELECT max(upto) FROM sums)"))
def _sampled_reservoir(spark, d):
    graph = flow.steepest(c.tilted(spark, d), NY).select("n", "nxt")
    return flow.accumulate_sampled(graph, WALKS, CELLS, c.per_order(spark, d).select("n", F.col("rain").alias("s")), True, 5, NY).select("n", *_r("total"))


@query("upstream_sample", f"""WITH RECURSIVE g AS MATERIALIZED {c._graph_sql(c._TILT)},
walk AS (SELECT n, n AS cell FROM g UNION ALL SELECT g.nxt, w.cell FROM walk w JOIN g USING (n) WHERE g.nxt >= 0),
placed AS (SELECT n, CAST(row_number() OVER (PARTITION BY n ORDER BY {uniform_sql('cell', 8)}, cell) - 1 AS INTEGER) AS place, cell FROM walk)
SELECT n, place, cell FROM placed WHERE place < 4""")
def _reservoirs(spark, d):
    return flow.upstream_sample(flow.steepest(c.tilted(spark, d), NY), 4, 8, ny=NY)


# ---- events and orders, by time: events run over a month, so their times are stretched over the orders' years

_STRETCH, _BASE = 80, 1704067200000000 * 80 - 788918400000000
_EVENTS = f"(SELECT event_id, user_id, value, make_timestamp(epoch_us(ts) * {_STRETCH} - {_BASE}) AS t FROM events)"
_BOUGHT = "(SELECT o_orderdate AS day, o_orderkey AS key, o_custkey % 40 AS who, o_totalprice AS price FROM orders)"


def _events(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp")) * _STRETCH - _BASE
    return c._table(spark, d, "events").select("event_id", "user_id", "value", F.timestamp_micros(micros).alias("t"))


def _bought(spark, d):
    return c._table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("day"), F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 40).alias("who"), F.col("o_totalprice").alias("price"))


@query("as_of_orders", f"""SELECT event_id, r.key AS order_key, r.price AS price, CAST(date_diff('second', r.day, t) AS BIGINT) AS seconds FROM {_EVENTS} e
LEFT JOIN (SELECT event_id, max(b) AS r FROM (SELECT e.event_id, struct_pack(day := o.day, key := o.key, price := o.price) AS b FROM {_EVENTS} e JOIN {_BOUGHT} o ON o.who = e.user_id % 40 AND o.day <= e.t AND o.day >= e.t - INTERVAL 90 DAY) GROUP BY 1) USING (event_id)""")
def _as_of(spark, d):
    events = _events(spark, d).withColumn("who", F.col("user_id") % 40)
    got = ordered.as_of(events, _bought(spark, d), "t", "day", [("who", "who")], within=F.expr("INTERVAL 90 DAYS"))
    return got.select("event_id", F.col("r_key").alias("order_key"), F.col("r_price").alias("price"), (F.unix_seconds("t") - F.unix_seconds("r_day")).alias("seconds"))


@query("events_in_order_intervals", f"""SELECT o.key AS order_key, CAST(count(*) AS BIGINT) AS hits, round(sum(e.value), 4) AS total FROM {_EVENTS} e JOIN {_BOUGHT} o
ON o.who = e.user_id % 40 AND e.t >= o.day AND e.t < o.day + to_days(CAST(1 + o.key % 9 * o.key % 60 AS INTEGER)) GROUP BY 1""")
def _intervals(spark, d):
    spans = _bought(spark, d).withColumn("until", F.col("day") + F.make_dt_interval(days=(1 + F.col("key") % 9 * F.col("key") % 60).cast("int")))
    sums = ordered.interval_sums(_events(spark, d).withColumn("who", F.col("user_id") % 40), spans, "t", "day", "until", "value", ["key"], [("who", "who")])
    return sums.select(F.col("key").alias("order_key"), "hits", F.round("total", 4).alias("total"))


@query("running_rain", f"SELECT n, sum(rain) OVER (ORDER BY n) AS upto FROM ({c._PER})")
def _running(spark, d):
    return ordered.running_sum(c.per_order(spark, d).select("n", "rain"), "n", "rain", "upto", each=4096).select("n", "upto")


# ---- ways of events along the flow


@query("event_paths", f"""WITH RECURSIVE g AS MATERIALIZED {c._graph_sql(c._TILT)}, size AS (SELECT count(*) AS cells FROM g),
walk AS (SELECT event_id AS id, CAST(0 AS BIGINT) AS step, CAST(event_id * 7919 % cells AS BIGINT) AS n FROM events, size UNION ALL SELECT w.id, step + 1, g.nxt FROM walk w JOIN g USING (n) WHERE g.nxt >= 0)
SELECT id, step, n FROM walk""")
def _paths(spark, d):
    graph, cells = flow.steepest(c.tilted(spark, d), NY).select("n", "nxt"), c.grid_of(spark, d).cells
    starts = c._table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 7919 % cells).alias("n"))
    return paths.flow_paths(graph, starts, NY)


# ---- gradient noise

_NOISE = NoiseParams(octaves=3, seed=4, ext=(24.0, 16.0))


def _corner_sql(k: int, octave: int) -> str:
    """One corner's part: what it is away from, its direction, its weight."""
    si, sj, sk = (f"CASE WHEN {r} >= {3 - k} THEN 1 ELSE 0 END" for r in ("rx", "ry", "rz"))
    cell = f"(((i + {si}) % 1024 + 1024) % 1024 * 1024 + ((j + {sj}) % 1024 + 1024) % 1024) * 1024 + ((k + {sk}) % 1024 + 1024) % 1024"
    g = f"CAST(floor({uniform_sql(f'({cell})', _NOISE.seed + octave)} * 12) AS BIGINT)"
    ways = [(a, b, s, t) for a, b in (("x", "y"), ("x", "z"), ("y", "z")) for t in ("", "-") for s in ("", "-")]
    away = f"struct_pack(x := x - {si} + {k / 6!r}::DOUBLE, y := y - {sj} + {k / 6!r}::DOUBLE, z := z - {sk} + {k / 6!r}::DOUBLE, g := {g})"
    return f"list_transform([{away}], lambda c: power(greatest(0.6::DOUBLE - c.x * c.x - c.y * c.y - c.z * c.z, 0), 4) * CASE {' '.join(f'WHEN c.g = {m} THEN {s}c.{a} + ({t}c.{b})' for m, (a, b, s, t) in enumerate(ways))} END)[1]"


def _octave_sql(octave: int) -> str:
    f = _NOISE.frequency * _NOISE.lacunarity**octave
    return f"""(SELECT n, 32 * ({' + '.join(_corner_sql(k, octave) for k in range(4))}) AS h FROM (
SELECT *, CAST(x >= y AS INTEGER) + CAST(x >= z AS INTEGER) AS rx, CAST(y > x AS INTEGER) + CAST(y >= z AS INTEGER) AS ry, CAST(z > x AS INTEGER) + CAST(z > y AS INTEGER) AS rz FROM (
SELECT n, i, j, k, u - i + (i + j + k) / 6.0::DOUBLE AS x, v - j + (i + j + k) / 6.0::DOUBLE AS y, w - k + (i + j + k) / 6.0::DOUBLE AS z FROM (
SELECT *, CAST(floor(u + (u + v + w) / 3.0::DOUBLE) AS BIGINT) AS i, CAST(floor(v + (u + v + w) / 3.0::DOUBLE) AS BIGINT) AS j, CAST(floor(w + (u + v + w) / 3.0::DOUBLE) AS BIGINT) AS k FROM (
SELECT n, x * {f / _NOISE.ext[0]!r}::DOUBLE AS u, y * {f / _NOISE.ext[1]!r}::DOUBLE AS v, {_NOISE.seed * f!r}::DOUBLE AS w FROM ({c._ORDERS}))))))"""


_GAINS = [_NOISE.gain**k for k in range(_NOISE.octaves)]


@query("simplex_noise", f"SELECT n, round(({' + '.join(f'o{k}.h * {g!r}::DOUBLE' for k, g in enumerate(_GAINS))}) / {sum(_GAINS)!r}::DOUBLE, 6) AS h FROM {_octave_sql(0)} o0 {' '.join(f'JOIN {_octave_sql(k)} o{k} USING (n)' for k in range(1, _NOISE.octaves))}")
def _simplex(spark, d):
    return simplex_noise(c.height(spark, d).select("n", "x", "y"), _NOISE).select("n", *_r("h"))


# ---- two feeds of events, the second with rows that come late

#: Seconds that the watermark stays behind, that end a session, that end a cell's mean.
_LATE, _GAP, _IDLE = 21_600, 7_200, 43_200
_IN_FIRST = "(day < 18 AND event_id % 5 <> 0)"
_FEEDS = f"(SELECT event_id, CAST(user_id AS BIGINT) AS n, ts, value, CASE WHEN {_IN_FIRST} THEN 1 ELSE 2 END AS feed FROM (SELECT *, day(ts) AS day FROM events))"


def _fed(spark, d, make):
    """Files that a stream makes of two feeds, one after the other: of the first 18 days four events in five come in the
    first feed, the fifth ones come late, with the rest of the month."""
    folder = f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"
    rows = c._table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", F.col("user_id").cast("long").alias("n"), "ts", F.col("value").cast("double").alias("value"))
    first = (F.dayofmonth("ts") < 18) & (F.col("event_id") % 5 != 0)
    for feed in (rows.where(first), rows.where(~first)):
        feed.write.mode("append").parquet(f"{folder}/in")
        drain(make(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")), folder)
    return spark.read.parquet(f"{folder}/out")


_MARKS = f"""marks AS (SELECT make_timestamp((epoch_ms(max(ts) FILTER (WHERE feed = 1)) - {_LATE * 1000}) * 1000) AS w1, make_timestamp((epoch_ms(max(ts)) - {_LATE * 1000}) * 1000) AS w2 FROM feeds)"""


def _runs_sql(rows: str) -> str:
    """Each row with its session's number, over rows (n, ts, value, ...)."""
    return f"""(SELECT *, sum(new) OVER (PARTITION BY n ORDER BY ts, event_id) AS k FROM (
SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY n ORDER BY ts, event_id) + to_seconds({_GAP}) THEN 0 ELSE 1 END AS new FROM {rows}))"""


_SESSION = f"SELECT n, min(ts) AS start, max(ts) + to_seconds({_GAP}) AS \"end\", round(avg(value) * {c.KEPT}::DOUBLE, 6) AS mean, count(value) AS hits"


@query("stream_sessions", f"""WITH feeds AS {_FEEDS}, {_MARKS},
one AS {_runs_sql('(SELECT * FROM feeds WHERE feed = 1)')}, ends AS (SELECT n, k, max(ts) + to_seconds({_GAP}) AS stop FROM one GROUP BY 1, 2),
closed AS (SELECT one.* FROM one JOIN ends USING (n, k), marks WHERE stop <= w1),
two AS {_runs_sql(f'(SELECT event_id, n, ts, value FROM one JOIN ends USING (n, k), marks WHERE stop > w1 UNION ALL SELECT event_id, n, ts, value FROM feeds, marks WHERE feed = 2 AND ts + to_seconds({_GAP}) > w1)')}
{_SESSION} FROM closed GROUP BY n, k UNION ALL SELECT s.* FROM ({_SESSION} FROM two GROUP BY n, k) s, marks WHERE s."end" <= w2""")
def _sessions(spark, d):
    out = _fed(spark, d, lambda s: sessions(s, F.col("n"), f"{_LATE} seconds", f"{_GAP} seconds"))
    return out.select("n", *(F.col(k).cast("timestamp_ntz").alias(k) for k in ("start", "end")), F.round(F.col("mean") * c.KEPT, 6).alias("mean"), "hits")


_MEAN = f"SELECT n, min(ts) AS first, max(ts) AS last, round(avg(value) * {c.KEPT}::DOUBLE, 6) AS mean, count(value) AS hits"


@query("stream_means", f"""WITH feeds AS {_FEEDS}, {_MARKS},
one AS (SELECT f.*, max(ts) OVER (PARTITION BY n) + to_seconds({_IDLE}) < w1 AS told FROM feeds f, marks WHERE feed = 1),
two AS (SELECT n, ts, value FROM one WHERE NOT told UNION ALL SELECT n, ts, value FROM feeds, marks WHERE feed = 2 AND ts > w1)
{_MEAN} FROM one WHERE told GROUP BY n UNION ALL SELECT s.* FROM ({_MEAN} FROM two GROUP BY n) s, marks WHERE s.last + to_seconds({_IDLE}) < w2""")
def _means(spark, d):
    out = _fed(spark, d, lambda s: running_means(s, F.col("n"), f"{_LATE} seconds", _IDLE))
    return out.select("n", *(F.col(k).cast("timestamp_ntz").alias(k) for k in ("first", "last")), F.round(F.col("mean") * c.KEPT, 6).alias("mean"), "hits")


# ---- tiles of growing side


_LEVELS, _SIDE = 4, 16


@query("tile_pyramid", " UNION ALL ".join(f"SELECT {k} AS level, CAST(x // {_SIDE * 2**k} AS BIGINT) AS tx, CAST(y // {_SIDE * 2**k} AS BIGINT) AS ty, count(*) AS cells, count(h) AS known, round(sum(h), 3) AS total, min(h) AS low, max(h) AS high FROM ({c._HOLES}) GROUP BY ALL" for k in range(_LEVELS)))
def _pyramid(spark, d):
    return pyramid.tile_pyramid(c.holes(spark, d), _LEVELS, _SIDE).select("level", "tx", "ty", "cells", "known", *_r("total", digits=3), "low", "high")
