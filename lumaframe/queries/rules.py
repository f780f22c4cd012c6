"""Rules with state over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaframe.queries.registry import query
from lumaframe.streaming.replay import replay

#: The log in order per source, and one recursive step per event.
LOG = ", log AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts_ms, seq) AS i FROM attempt)"


@query("attempt", f"""{LOG}
    , run AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS ts_ms, CAST(0 AS BIGINT) AS seq, 0 AS n, CAST(0 AS BIGINT) AS first, '' AS outcome FROM (SELECT DISTINCT source FROM attempt)
      UNION ALL
      SELECT l.source, l.i, l.ts_ms, l.seq,
             CASE WHEN k.n >= 5 THEN k.n WHEN l.ok THEN 0 ELSE k.n + 1 END, CASE WHEN k.n >= 5 OR k.n > 0 THEN r.first ELSE l.ts_ms END, CASE WHEN k.n >= 5 THEN 'blocked' WHEN l.ok THEN 'ok' ELSE 'failed' END
      FROM run r JOIN log l ON l.source = r.source AND l.i = r.i + 1, LATERAL (SELECT CASE WHEN r.n > 0 AND l.ts_ms - r.first > 900000 THEN 0 ELSE r.n END AS n) k)
    SELECT source, ts_ms, seq, outcome FROM run WHERE i > 0""")
def login_limiter(v):
    return replay(v("attempt"), "login", "source")


@query("attempt", f"""{LOG}
    , run AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS ts_ms, CAST(0 AS BIGINT) AS seq, 0 AS n, CAST(0 AS BIGINT) AS until, '' AS outcome FROM (SELECT DISTINCT source FROM attempt)
      UNION ALL
      SELECT l.source, l.i, l.ts_ms, l.seq, CASE WHEN l.ts_ms < r.until OR l.ok OR r.n + 1 >= 5 THEN 0 ELSE r.n + 1 END,
             CASE WHEN l.ts_ms < r.until THEN r.until WHEN NOT l.ok AND r.n + 1 >= 5 THEN l.ts_ms + 30000 ELSE 0 END,
             CASE WHEN l.ts_ms < r.until THEN 'locked' WHEN l.ok THEN 'ok' WHEN r.n + 1 >= 5 THEN 'lock' ELSE 'failed' END
      FROM run r JOIN log l ON l.source = r.source AND l.i = r.i + 1)
    SELECT source, ts_ms, seq, outcome FROM run WHERE i > 0""")
def download_lock(v):
    return replay(v("attempt"), "download", "source")


@query("feed", """
    , log AS (SELECT user_name AS name, ts_ms, event_id AS seq, row_number() OVER (PARTITION BY user_name ORDER BY ts_ms, event_id) AS i FROM feed),
    run AS (SELECT name, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS ts_ms, CAST(0 AS BIGINT) AS seq, CAST(-1000000000 AS BIGINT) AS last, '' AS outcome FROM (SELECT DISTINCT name FROM log)
      UNION ALL
      SELECT l.name, l.i, l.ts_ms, l.seq, CASE WHEN l.ts_ms - r.last >= 300000 THEN l.ts_ms ELSE r.last END, CASE WHEN l.ts_ms - r.last >= 300000 THEN 'taken' ELSE 'dropped' END
      FROM run r JOIN log l ON l.name = r.name AND l.i = r.i + 1)
    SELECT name, ts_ms, seq, outcome FROM run WHERE i > 0""")  # fmt: skip
def name_throttle(v):
    return replay(v("feed").select(F.col("user_name").alias("name"), "ts_ms", F.col("event_id").alias("seq")), "throttle", "name")


def _tokens(v):
    """Each user issues a token with the first sign-up and redeems it afterwards; modes and values follow the user's number."""
    feed = v("feed").where("event_type in ('signup', 'purchase')")
    first = feed.where("event_type = 'signup'").groupBy("user_name").agg(F.min(F.struct("ts_ms", "event_id")).alias("f"))
    rows = feed.join(first, "user_name", "left").withColumn("is_first", F.col("event_id") == F.col("f.event_id"))
    rows = rows.where("event_type = 'purchase' or is_first")
    number = F.col("user_id") % 4
    mode = F.when(number == 0, "use").when(number == 1, "hour").when(number == 2, "day").otherwise("other")
    return rows.select(F.col("user_name").alias("token"), "ts_ms", F.col("event_id").alias("seq"), F.when(F.coalesce("is_first", F.lit(False)), "issue").otherwise("redeem").alias("op"), mode.alias("mode"), (F.col("user_id") % 13 - 1).alias("value"))


@query("feed", """
    , issue AS (SELECT user_name AS token, user_id, ts_ms, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY ts_ms, event_id) AS n FROM feed WHERE event_type = 'signup') WHERE n = 1),
    terms AS (SELECT *, CASE user_id % 4 WHEN 0 THEN least(greatest(user_id % 13 - 1, 1), 1000) WHEN 3 THEN 10 ELSE 0 END AS uses,
                ts_ms + CASE user_id % 4 WHEN 1 THEN CAST(3600000 AS BIGINT) * greatest(user_id % 13 - 1, 1) WHEN 2 THEN CAST(86400000 AS BIGINT) * least(greatest(user_id % 13 - 1, 1), 30) ELSE CAST(86400000 AS BIGINT) * 30 END AS until FROM issue),
    valid AS (SELECT f.event_id, row_number() OVER (PARTITION BY t.token ORDER BY f.ts_ms, f.event_id) AS n, t.uses FROM feed f JOIN terms t ON t.token = f.user_name
              WHERE f.event_type = 'purchase' AND (f.ts_ms, f.event_id) > (t.ts_ms, t.seq) AND f.ts_ms <= t.until)
    SELECT token, ts_ms, seq, 'issued' AS outcome FROM issue
    UNION ALL SELECT f.user_name, f.ts_ms, f.event_id, CASE WHEN x.event_id IS NOT NULL AND (x.uses = 0 OR x.n <= x.uses) THEN 'counted' ELSE 'refused' END
    FROM feed f LEFT JOIN valid x ON x.event_id = f.event_id WHERE f.event_type = 'purchase'""")  # fmt: skip
def token_quota(v):
    return replay(_tokens(v), "redeem", "token")


@query("feed", """
    , log AS (SELECT 1000 + 10 * (user_id - user_id % 3) + event_id % 4 AS folder_id, ts_ms, event_id AS seq, user_name, CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'activity' WHEN 'error' THEN 'release' ELSE 'force' END AS op,
                row_number() OVER (PARTITION BY user_id - user_id % 3, event_id % 4 ORDER BY ts_ms, event_id) AS i FROM feed),
    run AS (SELECT folder_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS ts_ms, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS held, CAST(0 AS BIGINT) AS at, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS holder FROM (SELECT DISTINCT folder_id FROM log)
      UNION ALL
      SELECT l.folder_id, l.i, l.ts_ms, l.seq,
        CASE WHEN l.op = 'claim' THEN coalesce(r.held, l.user_name) WHEN l.op = 'release' AND r.held = l.user_name THEN NULL WHEN l.op = 'force' AND r.at < l.ts_ms - 1800000 THEN NULL ELSE r.held END,
        CASE WHEN l.op = 'claim' AND (r.held IS NULL OR r.held = l.user_name) THEN l.ts_ms WHEN l.op = 'activity' AND r.held = l.user_name THEN l.ts_ms ELSE r.at END,
        CASE l.op WHEN 'claim' THEN CASE WHEN r.held IS NULL THEN 'claimed' WHEN r.held = l.user_name THEN 'renewed' ELSE 'refused' END
                  WHEN 'activity' THEN CASE WHEN r.held = l.user_name THEN 'renewed' END
                  WHEN 'release' THEN CASE WHEN r.held = l.user_name THEN 'released' ELSE 'kept' END
                  ELSE CASE WHEN r.held IS NOT NULL AND r.at < l.ts_ms - 1800000 THEN 'released' ELSE 'kept' END END,
        CASE WHEN l.op = 'claim' THEN coalesce(r.held, l.user_name) ELSE r.held END
      FROM run r JOIN log l ON l.folder_id = r.folder_id AND l.i = r.i + 1)
    SELECT folder_id, ts_ms, seq, outcome, holder FROM run WHERE i > 0 AND outcome IS NOT NULL""")  # fmt: skip
def claim_log(v):
    op = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "activity").when(F.col("event_type") == "error", "release").otherwise("force")
    log = v("feed").select((F.lit(1000) + 10 * (F.col("user_id") - F.col("user_id") % 3) + F.col("event_id") % 4).alias("folder_id"), "ts_ms", F.col("event_id").alias("seq"), "user_name", op.alias("op"))
    return replay(log, "claim", "folder_id")
