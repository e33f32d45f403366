"""Time series from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake import bindings as b
from scenelake.operators import temporal as op

from .registry import query


@query(
    f"""WITH {b.POSES}, s AS (SELECT traj, us, max(x) AS x FROM t WHERE event_id % 2 = 0 GROUP BY traj, us), q AS (SELECT traj, event_id AS qid, us FROM t WHERE event_id % 2 = 1),
 a AS (SELECT q.traj, qid, q.us, s.us AS au, s.x AS ax FROM q ASOF LEFT JOIN s ON q.traj = s.traj AND q.us >= s.us), c AS (SELECT a.*, s.us AS bu, s.x AS bx FROM a ASOF LEFT JOIN s ON a.traj = s.traj AND a.us <= s.us)
 SELECT traj, qid, us, round(CASE WHEN bu - au <= 86400000000 THEN CASE WHEN bu = au THEN ax ELSE ax + (bx - ax) * (us - au) / (bu - au) END END, 4) AS x FROM c"""
)
def asof_interpolate(spark, d):
    t = b.poses(spark, d)
    q = t.filter("event_id % 2 = 1").select("traj", F.col("event_id").alias("qid"), "us")
    return op.asof_interpolate(q, t.filter("event_id % 2 = 0"), "traj", 86_400_000_000).withColumn("x", F.round("x", 4))


@query(f"WITH {b.POSES} SELECT traj, event_id, round(coalesce(x - lag(x) OVER w, lead(x) OVER w - x, 0), 6) AS dx FROM t WINDOW w AS (PARTITION BY traj ORDER BY us, event_id)")
def ego_motion(spark, d):
    return op.ego_motion(b.poses(spark, d), "traj", ["us", "event_id"]).select("traj", "event_id", F.round("dx", 6).alias("dx"))


@query(
    f"""WITH {b.POSES}, s AS (SELECT traj, us, event_id, coalesce(abs(x - lag(x) OVER (PARTITION BY traj ORDER BY us, event_id)), 0) AS s FROM t), c AS (SELECT traj, sum(s) OVER (PARTITION BY traj ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS d FROM s),
 w AS (SELECT traj, unnest(range(greatest(0, CAST(floor((d-450)/200) AS INT)+1), CAST(floor(d/200) AS INT)+1)) AS w FROM c) SELECT traj, CAST(w AS INT) AS w, count(*) AS n FROM w GROUP BY 1, 2"""
)
def distance_windows(spark, d):
    return op.distance_windows(b.poses(spark, d), "traj", ["us", "event_id"], 200.0, 450.0)


@query(f"WITH {b.POSES}, m AS (SELECT traj, max(us) AS last FROM t GROUP BY traj) SELECT traj FROM m WHERE last >= (SELECT max(us) FROM t) - 3600000000 * 12")
def recent_expiry(spark, d):
    t = b.poses(spark, d)
    top = t.agg(F.max("us").alias("top"))
    return t.groupBy("traj").agg(F.max("us").alias("last")).join(F.broadcast(top)).filter(F.col("last") >= F.col("top") - 3600000000 * 12).select("traj")


@query(f"WITH {b.POSES} SELECT traj, event_id, round(avg(x) OVER w, 6) AS mean, round(median(x) OVER w, 6) AS median FROM t WINDOW w AS (PARTITION BY traj ORDER BY us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def moving_average(spark, d):
    m = op.moving_average(b.poses(spark, d), "traj", ["us", "event_id"], "x", 20)
    return m.select("traj", "event_id", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


WALKED = f"""WITH RECURSIVE {b.POSES}, q AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY us, event_id) AS n FROM t),
 g(traj, n, us, event_id, here, d) AS (SELECT traj, n, us, event_id, x, CAST(0 AS DOUBLE) FROM q WHERE n = 1 UNION ALL SELECT q.traj, q.n, q.us, q.event_id, CASE WHEN abs(q.x - g.here) > 5.0 THEN q.x ELSE g.here END, CASE WHEN abs(q.x - g.here) > 5.0 THEN g.d + abs(q.x - g.here) ELSE g.d END FROM g JOIN q ON q.traj = g.traj AND q.n = g.n + 1),
 z AS (SELECT traj, n, us, event_id, d FROM g)"""


@query(WALKED + " SELECT traj, us, event_id, round(d, 6) AS d FROM z")
def travelled_distance(spark, d):
    return op.travelled(b.poses(spark, d), "traj", ["us", "event_id"], 5.0).withColumn("d", F.round("d", 6))


@query(WALKED + ", o AS (SELECT a.traj, a.us, a.event_id, min(c.n) AS m FROM z a LEFT JOIN z c ON c.traj = a.traj AND c.d >= a.d + 100 - 1e-9 GROUP BY ALL) SELECT o.traj, o.us, o.event_id, coalesce(z.event_id, -1) AS end_id FROM o LEFT JOIN z ON z.traj = o.traj AND z.n = o.m")
def distance_end_frame(spark, d):
    walked = op.travelled(b.poses(spark, d), "traj", ["us", "event_id"], 5.0)
    return op.end_frames(walked, "traj", ["us", "event_id"], 100.0)


@query("WITH e AS (SELECT user_id, event_type, date_trunc('hour', ts) AS h FROM events) SELECT CAST(epoch(h) AS BIGINT) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM e GROUP BY 1, 2")
def hourly_counts(spark, d):
    e = b.read(spark, d, "events")
    return e.groupBy(F.unix_timestamp(F.date_trunc("hour", "ts")).alias("hour"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS imu FROM events), s AS (SELECT user_id, event_id, ts FROM e WHERE imu = 0), m AS (SELECT user_id, ts FROM e WHERE imu = 1)
 SELECT s.event_id, count(m.ts) AS n FROM s LEFT JOIN m ON s.user_id = m.user_id AND m.ts > s.ts - INTERVAL 6 HOUR AND m.ts <= s.ts GROUP BY s.event_id"""
)
def scan_sync(spark, d):
    """Samples of one stream within six hours before each scan of the other,
    as the streaming join emits them; hour buckets make it an equi-join."""
    e = b.read(spark, d, "events").select("user_id", "event_id", b.micros("ts").alias("us"), F.col("event_type").alias("kind"))
    span = 6 * 3_600_000_000
    k = F.floor(F.col("us") / span)
    scans = e.filter("kind <> 'view'").select("user_id", "event_id", "us", F.explode(F.array(k, k - 1)).alias("k"))
    imu = e.filter("kind = 'view'").select("user_id", F.col("us").alias("m"), k.alias("k"))
    met = scans.join(imu, ["user_id", "k"]).filter((F.col("m") > F.col("us") - span) & (F.col("m") <= F.col("us"))).groupBy("event_id").agg(F.count("*").alias("n"))
    return e.filter("kind <> 'view'").select("event_id").join(met, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"))
