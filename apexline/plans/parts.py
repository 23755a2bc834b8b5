"""The stand-in tables and common derivations, as check SQL."""

from apexline.plans.registry import part

part(
    "numbered",
    """
SELECT 'E' || (user_id % 2) AS event, CAST(user_id AS VARCHAR) AS car, 'C' || (user_id % 6) AS klass,
  event_id, epoch_us(ts) AS t, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  row_number() OVER w AS n, lag(epoch_us(ts)) OVER w AS t_before,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS bought
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
part(
    "crossing",
    """
SELECT event, car, klass, event_id, t, event_type, cents, k, (n - 2) // 5 + 1 AS lap,
  (n - 2) % 5 + 1 AS sector, t - t_before AS dur,
  CASE WHEN k % 13 <> 0 THEN t - t_before END AS reading,
  CASE WHEN k % 11 <> 0 THEN bought END AS counter
FROM numbered WHERE n > 1""",
    "numbered",
)


def _five(expr, name):
    return ", ".join(
        f"max(CASE WHEN sector = {i} THEN {expr} END) AS {name}{i}" for i in range(1, 6)
    )


part(
    "lap0",
    f"""
SELECT event, car, klass, lap, {_five('reading', 's')}, {_five('cents', 'v')},
  max(t) AS tend, CASE WHEN count(*) = 5 THEN CAST(sum(dur) AS BIGINT) END AS rt,
  count(*) FILTER (event_type = 'error') >= 2 AS inpit,
  max(CASE WHEN sector = 1 THEN event_type END) AS driver,
  arg_max(event_type, sector) AS vehicle,
  max(CASE WHEN sector = 5 THEN dur END) AS d5, max(CASE WHEN sector = 2 THEN dur END) AS d2,
  max(CASE WHEN sector = 4 THEN k END) AS k4, arg_max(k, sector) AS k5
FROM crossing GROUP BY event, car, klass, lap""",
    "crossing",
)
part(
    "lap",
    """
SELECT *, CASE WHEN inpit AND k5 % 7 <> 0 THEN tend - d5 // 10 END AS pit_in,
  CASE WHEN inpit AND k4 % 5 <> 0 THEN d2 END AS pit_dur,
  CASE WHEN inpit THEN 'J'
       WHEN EXISTS (SELECT 1 FROM lap0 b WHERE b.event = a.event AND b.car = a.car
                    AND b.lap = a.lap - 1 AND b.inpit) THEN 'A' ELSE 'N' END AS pit_status
FROM lap0 a""",
    "lap0",
)
part(
    "holes",
    """
SELECT *, (CASE WHEN s1 IS NULL THEN 1 ELSE 0 END) + (CASE WHEN s2 IS NULL THEN 1 ELSE 0 END)
  + (CASE WHEN s3 IS NULL THEN 1 ELSE 0 END) + (CASE WHEN s4 IS NULL THEN 1 ELSE 0 END) AS missing,
  rt - (coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0) + coalesce(s4, 0) + coalesce(s5, 0)) AS hole
FROM lap""",
    "lap",
)
_FILL = "missing = 1 AND s5 IS NOT NULL AND rt <> 0 AND hole > 0 AND hole < 259200000000"
part(
    "fixed",
    "SELECT event, car, klass, lap, "
    + ", ".join(f"CASE WHEN s{i} IS NULL AND {_FILL} THEN hole ELSE s{i} END AS s{i}" for i in range(1, 5))
    + ", s5, v1, v2, v3, v4, v5, tend, rt, inpit, driver, vehicle, pit_in, pit_dur, pit_status FROM holes",
    "holes",
)
part(
    "sector_row",
    " UNION ALL ".join(
        f"SELECT event, car, lap, {i} AS sector, s{i} AS s, v{i} AS speed, inpit, pit_status,"
        " tend - CASE WHEN coalesce(rt, 0) = 0 THEN coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)"
        " + coalesce(s4, 0) + coalesce(s5, 0) ELSE rt END + "
        + " + ".join(f"coalesce(s{j}, 0)" for j in range(1, i + 1))
        + " AS t1 FROM fixed"
        for i in range(1, 6)
    ),
    "fixed",
)
part(
    "leg",
    """
SELECT event, car, lap, CAST(sector AS BIGINT) AS sector, CAST(t1 - s AS BIGINT) AS t0,
  CAST(t1 AS BIGINT) AS t1, speed FROM sector_row WHERE s IS NOT NULL""",
    "sector_row",
)
part(
    "dim",
    """
SELECT event, car, arg_max(klass, lap) AS klass, arg_max(vehicle, lap) AS vehicle
FROM lap GROUP BY event, car""",
    "lap",
)
part(
    "boundary",
    """
SELECT l.event, d.klass, l.car, l.lap, l.sector, l.t1 AS t,
  row_number() OVER (PARTITION BY l.event, l.car ORDER BY l.t1, l.lap, l.sector) AS k
FROM leg l JOIN dim d USING (event, car)""",
    "leg", "dim",
)
# The counting rule itself: rivals with more boundaries by t, or as many and earlier.
part(
    "chart",
    """
SELECT a.event, a.klass, a.car, a.k, a.lap, a.sector, a.t,
  1 + (SELECT count(*) FROM boundary b WHERE b.event = a.event AND b.klass = a.klass
       AND b.car <> a.car AND b.k = a.k
       AND (b.t < a.t OR EXISTS (SELECT 1 FROM boundary c WHERE c.event = b.event AND c.car = b.car
                                 AND c.k = b.k + 1 AND c.t <= a.t AND b.t <= a.t))) AS position
FROM boundary a""",
    "boundary",
)
part(
    "max_lap",
    """
SELECT d.event, d.klass, greatest(max(l.lap), 1) AS max_lap
FROM lap l JOIN dim d ON d.event = l.event AND d.car = l.car GROUP BY d.event, d.klass""",
    "lap", "dim",
)
part(
    "raw_sector",
    " UNION ALL ".join(
        f"SELECT event, car, lap, {i} AS sector, s{i} AS s, inpit, pit_status FROM lap"
        for i in range(1, 6)
    ),
    "lap",
)
part(
    "class_avg",
    """
SELECT p.event, p.klass, p.sector, coalesce(floor((a.total * 20 + a.n * 1000000)
  / (a.n * 2000000)) / 10, 0.0) AS avg_s
FROM (SELECT DISTINCT event, klass, CAST(sector AS BIGINT) AS sector FROM dim, range(1, 6) g(sector)) p
LEFT JOIN (SELECT d.event, d.klass, r.sector, CAST(sum(r.s) AS BIGINT) AS total, count(*) AS n
  FROM raw_sector r JOIN dim d USING (event, car) WHERE NOT r.inpit AND r.s IS NOT NULL
  GROUP BY d.event, d.klass, r.sector) a
ON a.event = p.event AND a.klass = p.klass AND a.sector = p.sector""",
    "raw_sector", "dim",
)
