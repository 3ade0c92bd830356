"""Gates, schedules, windows and access queries over the event log."""
import re
import uuid

from pyspark.sql import functions as F

from ..functions.clock import pacific_reset_seconds
from ..operators import access
from ..session import checkpoint_folder
from ..streaming import admission, jobs, ledger
from . import bindings as b


def _log(spark, folder):
    return b.bound(spark, folder, b.LOG)


def t1(spark, folder):
    requests = _log(spark, folder).select("event_id", "ts", F.col("event_type").alias("model"), (F.pmod("event_id", F.lit(3)) + 1).cast("int").alias("requests"),
                                          F.col("tokens"), (F.col("class") == "index").alias("indexing"))
    return admission.admit(requests, ["model"], admission.Limits(rpm=4, tpm=2500, rpd=300, index_rpm=3, index_tpm=2000, index_rpd=250))


def t2(spark, folder):
    b.open_tables(spark, folder)
    rows = spark.sql("SELECT p_partkey, 10 + p_size AS rpm, cast(p_retailprice * 30 AS bigint) AS tpm, CASE WHEN p_size > 20 THEN p_size * 20 END AS rpd, 700 AS daily_budget, "
                     "10 AS rpm_reserve, 3000 AS tpm_reserve, 25 AS daily_reserve FROM part")
    return admission.quota_limits(rows).select("p_partkey", "limit_rpm", "limit_tpm", "limit_daily", "index_rpm", "index_tpm", "index_daily", "valid")


T2_SQL = """SELECT p_partkey, l1 AS limit_rpm, l2 AS limit_tpm, l3 AS limit_daily, greatest(1, l1 - 10) AS index_rpm, greatest(1, l2 - 3000) AS index_tpm, greatest(1, l3 - 25) AS index_daily,
  l1r > 10 AND l2 > 3000 AND l3 > 25 AS valid FROM (SELECT p_partkey, CAST(greatest(1, floor((10 + p_size) * 0.7::DOUBLE)) AS BIGINT) AS l1, CAST(floor((10 + p_size) * 0.7::DOUBLE) AS BIGINT) AS l1r,
  CAST(greatest(1, floor(floor(p_retailprice * 30) * 0.7::DOUBLE)) AS BIGINT) AS l2, CAST(CASE WHEN p_size > 20 THEN least(700, floor(p_size * 20 * 0.7::DOUBLE)) ELSE 700 END AS BIGINT) AS l3 FROM part) x"""


def t3(spark, folder):
    log = _log(spark, folder)
    usage = log.where("event_type <> 'error'").select("event_id", F.floor("value").cast("long").alias("actual_tokens"))
    return admission.reconcile(log.select("event_id", "ts", "tokens"), usage)


T3_SQL = b.with_log("SELECT event_id, ts, CASE WHEN event_type <> 'error' AND floor(value) > 0 THEN CAST(ceil(floor(value) * 1.25) AS BIGINT) ELSE tokens END AS tokens FROM log")


def t4(spark, folder):
    return admission.submissions(_log(spark, folder), ["user_id"])


def t5(spark, folder):
    return admission.rate_limit(_log(spark, folder).withColumn("is_chat", F.col("event_type") == "click"), ["event_type"], 2, 1)


def t6(spark, folder):
    return admission.counted_allowance(_log(spark, folder).select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], 5)


T6_SQL = "SELECT * FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS used FROM events) x WHERE used <= 5"


def t6_refunds(spark, folder):
    return admission.counted_allowance_with_refunds(_log(spark, folder).withColumn("refund", F.col("event_type") == "error"), ["user_id"], 5)


# The gates' plain loops: one recursive step per event of each key, in the order of arrival.
_ARRIVALS = """arrivals AS MATERIALIZED (SELECT {key} AS key, event_id, epoch_us(ts) // 1000 AS ms, {columns},
  row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS place FROM log)"""

T6_REFUNDS_SQL = f"""WITH RECURSIVE log AS ({b.LOG}), {_ARRIVALS.format(key="user_id", columns="event_type = 'error' AS refund")},
steps AS (SELECT key, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS event_id, true AS granted, CAST(0 AS BIGINT) AS used FROM arrivals WHERE place = 1
  UNION ALL SELECT a.key, a.place, a.event_id, a.refund OR s.used < 5, CASE WHEN a.refund THEN greatest(0, s.used - 1) WHEN s.used < 5 THEN s.used + 1 ELSE s.used END
  FROM steps s JOIN arrivals a ON a.key = s.key AND a.place = s.place + 1)
SELECT event_id, granted, used FROM steps WHERE place > 0"""

T4_SQL = f"""WITH RECURSIVE log AS ({b.LOG}), {_ARRIVALS.format(key="user_id", columns="1 AS one")},
steps AS (SELECT key, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS event_id, ms AS opened, CAST(0 AS BIGINT) AS n, ms AS now FROM arrivals WHERE place = 1
  UNION ALL SELECT a.key, a.place, a.event_id, CASE WHEN a.ms >= s.opened + 86400000 THEN a.ms ELSE s.opened END, CASE WHEN a.ms >= s.opened + 86400000 THEN 1 ELSE s.n + 1 END, a.ms
  FROM steps s JOIN arrivals a ON a.key = s.key AND a.place = s.place + 1)
SELECT event_id, n <= 2 AS admitted, CASE WHEN n <= 2 THEN 0 ELSE CAST(greatest(1, ceil((opened + 86400000 - now) / 1000)) AS BIGINT) END AS wait_seconds FROM steps WHERE place > 0"""

T5_SQL = f"""WITH RECURSIVE log AS ({b.LOG}), {_ARRIVALS.format(key="event_type", columns="1 AS one")},
steps AS (SELECT key, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS event_id, true AS admitted, CAST([] AS BIGINT[]) AS taken FROM arrivals WHERE place = 1
  UNION ALL SELECT key, place, event_id, len(live) < most, CASE WHEN len(live) < most THEN list_append(live, ms) ELSE live END
  FROM (SELECT a.key, a.place, a.event_id, a.ms, CASE WHEN a.key = 'click' THEN 2 ELSE 1 END AS most, list_filter(s.taken, lambda t: t >= a.ms - 60000) AS live
    FROM steps s JOIN arrivals a ON a.key = s.key AND a.place = s.place + 1) x)
SELECT event_id, admitted FROM steps WHERE place > 0"""


_PACIFIC = "CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE)"
_RESET = f"""CAST(greatest(1, ceil((epoch_us(timezone('America/Los_Angeles', CAST({_PACIFIC} + 1 AS TIMESTAMP))) - epoch_us(timezone('UTC', ts))) / 1000000)) AS BIGINT)"""
_T1_COLUMNS = f"event_id % 3 + 1 AS n, tokens AS t, class = 'index' AS i, {_PACIFIC} AS day, {_RESET} AS day_wait"
T1_SQL = f"""WITH RECURSIVE log AS ({b.LOG}), {_ARRIVALS.format(key="event_type", columns=_T1_COLUMNS)},
steps AS (SELECT key, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS event_id, 'ok' AS reason, CAST(0 AS BIGINT) AS wait_seconds, CAST([] AS STRUCT(ms BIGINT, n BIGINT, t BIGINT, i BOOLEAN)[]) AS live,
    day, CAST(0 AS HUGEINT) AS day_n, CAST(0 AS HUGEINT) AS day_i FROM arrivals WHERE place = 1
  UNION ALL SELECT key, place, event_id, reason, CASE reason WHEN 'ok' THEN 0 WHEN 'day' THEN day_wait WHEN 'too_large' THEN NULL
      ELSE coalesce(CAST(ceil(greatest(1000, oldest + 60001 - ms) / 1000) AS BIGINT), 60) END,
    CASE WHEN reason = 'ok' THEN list_append(live, {{'ms': ms, 'n': n, 't': t, 'i': i}}) ELSE live END, day,
    day_n + CASE WHEN reason = 'ok' THEN n ELSE 0 END, day_i + CASE WHEN reason = 'ok' AND i THEN n ELSE 0 END
  FROM (SELECT *, CASE WHEN n > CASE WHEN i THEN 3 ELSE 4 END OR t > CASE WHEN i THEN 2000 ELSE 2500 END THEN 'too_large'
      WHEN all_n + n > 4 OR all_t + t > 2500 THEN 'minute' WHEN i AND (mine_n + n > 3 OR mine_t + t > 2000) THEN 'minute'
      WHEN day_n + n > 300 OR i AND day_i + n > 250 THEN 'day' ELSE 'ok' END AS reason,
      CASE WHEN all_n + n > 4 OR all_t + t > 2500 THEN live[1].ms ELSE mine[1].ms END AS oldest
    FROM (SELECT *, coalesce(list_sum([e.n for e in live]), 0) AS all_n, coalesce(list_sum([e.t for e in live]), 0) AS all_t,
        coalesce(list_sum([e.n for e in mine]), 0) AS mine_n, coalesce(list_sum([e.t for e in mine]), 0) AS mine_t
      FROM (SELECT *, list_filter(live, lambda e: e.i) AS mine
        FROM (SELECT a.*, list_filter(s.live, lambda e: e.ms > a.ms - 60000) AS live, CASE WHEN s.day = a.day THEN s.day_n ELSE 0 END AS day_n, CASE WHEN s.day = a.day THEN s.day_i ELSE 0 END AS day_i
          FROM steps s JOIN arrivals a ON a.key = s.key AND a.place = s.place + 1) x) y) z) w)
SELECT event_id, reason = 'ok' AS admitted, reason, wait_seconds FROM steps WHERE place > 0"""


def t7(spark, folder):
    return jobs.latest_progress(_log(spark, folder), "user_id", ["ts", "event_id"], ["event_type", "value", "event_id"])


T7_SQL = "SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def t7_changes(spark, folder):
    return jobs.progress_changes(_log(spark, folder).select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], ["event_type"])


T7_CHANGES_SQL = """SELECT user_id, event_id, ts, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) x
WHERE before IS DISTINCT FROM event_type"""

_JOBS = """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'queued' ELSE 'failed' END AS status, ts AS heartbeat_at,
  CASE WHEN value > 60 THEN ts + INTERVAL 1 DAY END AS next_attempt_at, value < 20 AS cancel_requested FROM events"""
_NOW = "2024-01-15 00:00:00"


def t8(spark, folder):
    b.open_tables(spark, folder)
    return jobs.recover(spark.sql(_JOBS), F.lit(_NOW).cast("timestamp_ntz")).select("id", "action", "status_after")


T8_SQL = f"""SELECT id, action, CASE action WHEN 'cancel' THEN 'cancelled' WHEN 'requeue' THEN 'queued' ELSE status END AS status_after FROM (SELECT *, CASE
  WHEN status = 'failed' OR coalesce(next_attempt_at > TIMESTAMP '{_NOW}', false) THEN 'none'
  WHEN status = 'running' AND heartbeat_at >= TIMESTAMP '{_NOW}' - INTERVAL 120 SECOND THEN 'none' WHEN cancel_requested THEN 'cancel' WHEN status = 'running' THEN 'requeue' ELSE 'launch' END AS action
  FROM ({_JOBS}) j) x"""


def t9(spark, folder):
    log = _log(spark, folder).select("user_id", "event_id", "ts", F.col("event_type").isin("error", "click").alias("failed"),
                                     F.when(F.col("value") > 100, F.round("value")).alias("provider_delay"))
    return jobs.retry_times(log, "user_id").select("event_id", "attempt", "delay_seconds", "next_attempt_at")


T9_SQL = """SELECT event_id, attempt, delay_seconds, ts + to_seconds(CAST(delay_seconds AS INT)) AS next_attempt_at FROM (SELECT *, greatest(least(300, 60 * pow(2, least(attempt, 10))), coalesce(CASE WHEN value > 100 THEN round(value) END, 0)) AS delay_seconds FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, run, failed ORDER BY ts, event_id) - 1 AS attempt FROM (
    SELECT *, event_type IN ('error', 'click') AS failed, sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) a) c WHERE failed) x"""


def t9_rules(spark, folder):
    """A task's delay and whether its user may set the time themselves, for every event as a failed try."""
    attempt, told = F.pmod("event_id", F.lit(6)).cast("int"), F.when(F.col("value") > 100, F.col("value"))
    asked = F.timestamp_add("HOUR", (F.pmod("event_id", F.lit(80)) - 10).cast("int"), F.col("ts"))
    return _log(spark, folder).select("event_id", F.round(jobs.task_retry_delay(attempt, F.col("event_type") == "error", told), 6).alias("delay_seconds"),
                                      jobs.user_retry_allowed(F.col("ts"), asked).alias("user_allowed"))


T9_RULES_SQL = """SELECT event_id, round(greatest(least(240, CASE WHEN event_type = 'error' THEN 60 ELSE 10 END * pow(2, event_id % 6)), coalesce(CASE WHEN value > 100 THEN value END, 0)), 6) AS delay_seconds,
  event_id % 80 - 10 > 0 AND event_id % 80 - 10 <= 48 AS user_allowed FROM events"""

_MEMBERS = {"documents": "source AS analysis_id, concat('d', doc_id) AS path, text AS content",
            "pages": "concat('src', page_id % 20) AS analysis_id, concat('p', page_id) AS path, html AS content"}


def _file_facts(members):
    return members.select("analysis_id", "path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("content_hash"))


def _snapshot_totals(files):
    return files.groupBy("analysis_id").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.countDistinct("content_hash").alias("contents"))


def t10(spark, folder):
    """Documents, then pages, arrive as members of the same snapshots: the second arrival merges with the first and runs its stages again."""
    out = f"{checkpoint_folder(spark)}/codestrata/{uuid.uuid4().hex}"
    for table, columns in _MEMBERS.items():
        # A pattern, as a stream takes a single file by that only; a folder of files fits it as well.
        arriving = spark.readStream.schema(spark.read.parquet(f"{folder}/{table}.parquet").schema).parquet(f"{folder}/{table}.[p]arquet").selectExpr(*[c.strip() for c in re.split(r",(?![^(]*\))", columns)])
        ledger.staged_intake(arriving, [("files", _file_facts), ("totals", _snapshot_totals)], f"{out}/tables", f"{out}/{table}").awaitTermination()
    return ledger.current(spark, f"{out}/tables", "totals")


T10_SQL = f"""SELECT analysis_id, count(*) AS files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes, count(DISTINCT sha256(content)) AS contents
FROM ({' UNION ALL '.join(f'SELECT {columns} FROM {table}' for table, columns in _MEMBERS.items())}) m GROUP BY analysis_id"""


def t12(which):
    def call(spark, folder):
        return jobs.arrival_windows(_log(spark, folder), "event_type")[which]
    return call


T12_MINUTE = b.with_log("SELECT event_type, date_trunc('minute', ts) AS start, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS end, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM log GROUP BY ALL")
T12_SLIDING = b.with_log("""SELECT event_type, s AS start, s + INTERVAL 60 SECOND AS end, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
  SELECT *, time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(CAST(10 * k AS INT)) AS s FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS k FROM log) a) x GROUP BY ALL""")
T12_SESSION = b.with_log("""SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh
  FROM log) a) x GROUP BY event_type, session""")


def t_reset(spark, folder):
    return _log(spark, folder).select("event_id", pacific_reset_seconds(F.col("ts")).alias("seconds"))


T_RESET_SQL = """SELECT event_id, CAST(greatest(1, ceil((epoch_us(timezone('America/Los_Angeles', CAST(CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) + 1 AS TIMESTAMP))) - epoch_us(timezone('UTC', ts))) / 1000000)) AS BIGINT) AS seconds FROM events"""

_ANALYSES = """SELECT concat('a', o_orderkey) AS analysis_id, concat('repo', o_custkey) AS repository_id, o_orderdate AS created_at, o_orderstatus <> 'P' AS graph_ready, o_totalprice > 499000 AS demo FROM orders"""
_GRANTS = """SELECT DISTINCT concat('u', l_suppkey) AS user_id, concat('a', l_orderkey) AS analysis_id, o_orderdate AS created_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


def _access(spark, folder):
    b.open_tables(spark, folder)
    return spark.sql(_ANALYSES), spark.sql(_GRANTS), spark.sql("SELECT concat('u', s_suppkey) AS user_id FROM supplier")


def l1(spark, folder):
    analyses, grants, _ = _access(spark, folder)
    return access.repository_list(grants, analyses)


L1_SQL = f"""WITH seen AS (SELECT DISTINCT user_id, analysis_id FROM ({_GRANTS}) g)
SELECT user_id, repository_id, analysis_id AS latest_analysis_id, newest FROM (SELECT s.user_id, a.*, max(created_at) OVER (PARTITION BY s.user_id, repository_id) AS newest,
  row_number() OVER (PARTITION BY s.user_id, repository_id ORDER BY graph_ready DESC, created_at DESC, a.analysis_id DESC) AS pick FROM seen s JOIN ({_ANALYSES}) a ON a.analysis_id = s.analysis_id) x WHERE pick = 1"""


def l2(spark, folder):
    analyses, grants, users = _access(spark, folder)
    asked = grants.groupBy("user_id").agg(F.min("analysis_id").alias("analysis_id")).withColumn("request_id", F.col("user_id"))
    return access.snapshot_list(asked, analyses, grants).select("request_id", "analysis_id", "place")


L2_SQL = f"""WITH a AS ({_ANALYSES}), g AS ({_GRANTS}), ok AS (SELECT user_id, analysis_id FROM g SEMI JOIN (SELECT * FROM a WHERE NOT demo) n USING (analysis_id) UNION
  SELECT concat('u', s_suppkey), analysis_id FROM supplier, (SELECT * FROM a WHERE demo) d),
asked AS (SELECT user_id, min(analysis_id) AS analysis_id FROM g GROUP BY user_id)
SELECT q.user_id AS request_id, o.analysis_id, row_number() OVER (PARTITION BY q.user_id ORDER BY o.created_at DESC, o.analysis_id DESC) AS place FROM asked q JOIN a h ON h.analysis_id = q.analysis_id
JOIN a o ON o.repository_id = h.repository_id JOIN ok ON ok.user_id = q.user_id AND ok.analysis_id = o.analysis_id"""


_ASKED = "SELECT DISTINCT concat('u', l_suppkey + l_linenumber) AS user_id, concat('a', l_orderkey) AS analysis_id FROM lineitem"


def l3(spark, folder):
    analyses, grants, _ = _access(spark, folder)
    return access.access(spark.sql(_ASKED), analyses, grants)


L3_SQL = f"""SELECT q.user_id, q.analysis_id, coalesce(a.demo, false) OR (g.user_id IS NOT NULL AND NOT coalesce(a.demo, true)) AS allowed FROM ({_ASKED}) q
LEFT JOIN ({_ANALYSES}) a ON a.analysis_id = q.analysis_id LEFT JOIN (SELECT user_id, analysis_id FROM ({_GRANTS}) h) g ON g.user_id = q.user_id AND g.analysis_id = q.analysis_id"""


def l4(spark, folder):
    b.open_tables(spark, folder)
    turns = spark.sql("SELECT l_suppkey AS user_id, l_returnflag AS analysis_id, l_orderkey * 10 + l_linenumber AS seq, l_partkey FROM lineitem")
    return access.latest_turns(turns, ["user_id", "analysis_id"], ["seq", "l_partkey"])


L4_SQL = """SELECT user_id, analysis_id, seq, l_partkey, least(n, 50) - back + 1 AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id, analysis_id ORDER BY seq DESC, l_partkey DESC) AS back,
  count(*) OVER (PARTITION BY user_id, analysis_id) AS n FROM (SELECT l_suppkey AS user_id, l_returnflag AS analysis_id, l_orderkey * 10 + l_linenumber AS seq, l_partkey FROM lineitem) t) x WHERE back <= 50"""


def l4_saved(spark, folder):
    rows = _log(spark, folder).select(F.col("event_id").alias("id"), F.col("event_type").alias("analysis_id"), (F.col("user_id") % 50).alias("user_id"), F.col("ts").alias("created_at"))
    return access.saved_investigations(rows, ["user_id", "analysis_id"], 40)


L4_SAVED_SQL = """SELECT id, analysis_id, user_id, created_at, place, n >= 40 AS at_limit FROM (SELECT event_id AS id, event_type AS analysis_id, user_id % 50 AS user_id, ts AS created_at,
  row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY ts DESC, event_id DESC) AS place, count(*) OVER (PARTITION BY user_id % 50, event_type) AS n FROM events) x WHERE place <= 40"""

QUERIES = {
    "t1_quota_admission": (t1, T1_SQL), "t2_quota_limits": (t2, T2_SQL), "t3_usage_reconcile": (t3, T3_SQL), "t4_submission_allowance": (t4, T4_SQL), "t5_request_rate_limit": (t5, T5_SQL),
    "t6_counted_allowance": (t6, T6_SQL), "t6_counted_allowance_refunds": (t6_refunds, T6_REFUNDS_SQL), "t7_job_progress_latest": (t7, T7_SQL), "t7_job_progress_changes": (t7_changes, T7_CHANGES_SQL),
    "t8_stale_lease_recovery": (t8, T8_SQL), "t9_retry_schedule": (t9, T9_SQL), "t9_retry_rules": (t9_rules, T9_RULES_SQL), "t10_incremental_ingest": (t10, T10_SQL), "t12_arrival_minutes": (t12("minute"), T12_MINUTE), "t12_arrival_sliding": (t12("sliding"), T12_SLIDING),
    "t12_arrival_sessions": (t12("session"), T12_SESSION), "t_pacific_reset": (t_reset, T_RESET_SQL), "l1_repository_list": (l1, L1_SQL), "l2_snapshot_list": (l2, L2_SQL),
    "l3_access_filter": (l3, L3_SQL), "l4_latest_n_per_owner": (l4, L4_SQL), "l4_saved_investigations": (l4_saved, L4_SAVED_SQL),
}
