"""Queries of the intraday machines and of the streams, with SQL; a stream's query replays a table in two slices through a
query that ends when all is read, and returns what the stream has written."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.jobs.tables import BARS, INTRADAY, bars, dates_as_text, intraday, rounded, table
from tapeworks.operators.ordered import shared_path
from tapeworks.operators.textchecks import session_gaps
from tapeworks.streaming import intraday as live
from tapeworks.streaming.triggers import MACHINES

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, dates: tuple[str, ...] = ()) -> None:
    Q[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    if sql:
        SQL[name] = dates_as_text(sql, dates)


def _sliced(rows: DataFrame, cuts: list[str]) -> DataFrame:
    """A stream of a table's rows, slice by slice in the order of the conditions, one file each."""
    path = f"{shared_path(rows.sparkSession)}/slices-{uuid.uuid4().hex}"
    for i, cut in enumerate(cuts):
        rows.where(cut).repartition(1).write.parquet(f"{path}/{i}")
    return rows.sparkSession.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)


def _drained(stream: DataFrame, mode: str = "update", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a stream over all that its source holds; the rows it wrote with their micro-batch, or nothing with a sink."""
    spark = stream.sparkSession
    path = f"{shared_path(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(sink or write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return None if sink else spark.read.parquet(f"{path}/out")


def _newest(rows: DataFrame, key: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


HALVES = ["hour(ts) < 12", "hour(ts) >= 12"]

#: Bars with what each machine knows (q), then the bars at which its phases change, each the first after the one before.
_MACHINES = f"""{INTRADAY},
q AS (SELECT *, row_number() OVER w AS i, sum(c * v) OVER w / sum(v) OVER w AS m, max(h) OVER (PARTITION BY ticker, session ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph, max(h) OVER w AS sh FROM intraday WINDOW w AS (PARTITION BY ticker, session ORDER BY ts)),
s AS (SELECT ticker, session, count(*) AS n, min(ts) AS opened, max(ts) AS closed, max(h) AS hi, min(l) AS lo FROM q GROUP BY ticker, session),
o1 AS (SELECT ticker, session, l AS ol, v AS ov FROM q WHERE i = 1),
o2 AS (SELECT ticker, session, min(i) AS ti, arg_min(c, i) AS tc, arg_min(sh, i) AS th, min(ts) AS tt FROM q JOIN o1 USING (ticker, session) WHERE i > 1 AND c < ol AND v >= 1.2::DOUBLE * ov GROUP BY ticker, session),
o3 AS (SELECT ticker, session, min(ts) AS vt FROM q JOIN o1 USING (ticker, session) JOIN o2 USING (ticker, session) WHERE i > ti AND c > ol AND c > m GROUP BY ticker, session),
r1 AS (SELECT ticker, session, min(i) AS ri, arg_min(l, i) AS rl, arg_min(h, i) AS rh FROM q WHERE c < o GROUP BY ticker, session),
r2 AS (SELECT ticker, session, min(i) FILTER (h > rh) AS vi, min(ts) FILTER (h > rh) AS vt, min(i) FILTER (l < rl) AS ti, min(ts) FILTER (l < rl) AS tt FROM q JOIN r1 USING (ticker, session) WHERE i > ri GROUP BY ticker, session),
f1 AS (SELECT ticker, session, min(i) AS a FROM q WHERE i > 1 AND c < m AND ph > c GROUP BY ticker, session),
f2 AS (SELECT ticker, session, min(i) AS b, arg_min(h, i) AS bh FROM q JOIN f1 USING (ticker, session) WHERE i > a AND c >= m GROUP BY ticker, session),
f3 AS (SELECT ticker, session, min(i) AS d, arg_min(l, i) AS dl FROM q JOIN f2 USING (ticker, session) WHERE i > b AND h < bh AND c < m GROUP BY ticker, session),
f4 AS (SELECT ticker, session, min(i) AS ti, min(ts) AS tt FROM q JOIN f3 USING (ticker, session) WHERE i > d AND l < dl GROUP BY ticker, session),
f5 AS (SELECT ticker, session, min(ts) AS vt FROM q JOIN f4 USING (ticker, session) WHERE i > ti AND c > m GROUP BY ticker, session),
k AS (SELECT s.*, 'orl' AS kind, CASE WHEN vt IS NOT NULL THEN 'invalidated' WHEN tt IS NOT NULL THEN 'triggered' ELSE 'armed' END AS phase, tc - 0.05::DOUBLE AS entry, th + 0.25::DOUBLE * {{atr}} AS stop, tt, vt, CASE WHEN vt IS NOT NULL THEN 'post_trigger_close_reclaimed_orl_and_vwap' END AS reason
    FROM s LEFT JOIN o2 USING (ticker, session) LEFT JOIN o3 USING (ticker, session)
    UNION ALL SELECT s.*, 'first_red', CASE WHEN vi IS NOT NULL THEN 'invalidated' WHEN ti IS NOT NULL THEN 'triggered' WHEN ri IS NOT NULL THEN 'red_marked' ELSE 'armed' END, CASE WHEN ti < coalesce(vi, ti + 1) THEN rl - 0.05::DOUBLE END, CASE WHEN ti < coalesce(vi, ti + 1) THEN rh END, CASE WHEN ti < coalesce(vi, ti + 1) THEN tt END, vt, CASE WHEN ti < vi THEN 'post_trigger_red_high_taken_out' WHEN vi IS NOT NULL THEN 'red_high_taken_out' END
    FROM s LEFT JOIN r1 USING (ticker, session) LEFT JOIN r2 USING (ticker, session)
    UNION ALL SELECT s.*, 'vwap_fail', CASE WHEN vt IS NOT NULL THEN 'invalidated' WHEN tt IS NOT NULL THEN 'triggered' WHEN d IS NOT NULL THEN 'rejection_confirmed' WHEN b IS NOT NULL THEN 'vwap_retest_seen' WHEN a IS NOT NULL THEN 'first_crack_seen' ELSE 'armed' END, CASE WHEN tt IS NOT NULL THEN dl - 0.05::DOUBLE END, CASE WHEN tt IS NOT NULL THEN bh END, tt, vt, CASE WHEN vt IS NOT NULL THEN 'post_trigger_close_above_vwap' END
    FROM s LEFT JOIN f1 USING (ticker, session) LEFT JOIN f2 USING (ticker, session) LEFT JOIN f3 USING (ticker, session) LEFT JOIN f4 USING (ticker, session) LEFT JOIN f5 USING (ticker, session)),
e AS (SELECT ticker, session, kind, phase, n AS bars, CAST(closed AS VARCHAR) AS last_ts, round(entry, 4) AS entry, round(stop, 4) AS stop, CAST(tt AS VARCHAR) AS triggered_at, CAST(vt AS VARCHAR) AS invalidated_at, reason, opened, hi, lo FROM k)"""

_PHASES = "SELECT ticker, session, kind, phase, bars, last_ts, entry, stop, triggered_at, invalidated_at, reason FROM e WHERE kind = "
for _name in MACHINES:
    _add(f"t_{_name}_fsm", lambda s, d, n=_name: live.fold_sessions(intraday(s, d), n), f"WITH {_MACHINES.format(atr='0')} {_PHASES}'{_name}'", ("session",))

# T5 and T7: three plans for each kind of event, one of them without a daily range, and one for a ticker that never trades.
_RISK, _CAP, _ATR = 1000.0, 25000.0, 2.5


def _plans(s: SparkSession, d: str) -> DataFrame:
    tickers = table(s, d, "events").select(F.col("event_type").alias("ticker")).distinct().unionByName(table(s, d, "region").select(F.col("r_name").alias("ticker")))
    rows = tickers.select("ticker", F.posexplode(F.array(*[F.lit(k) for k in (*MACHINES, "orl")])).alias("at", "kind"))
    return rows.select(F.concat_ws("-", "ticker", "kind", "at").alias("plan_id"), "ticker", "kind", F.lit(_RISK).alias("risk_usd"), F.lit(_CAP).alias("cap_usd"), F.when(F.col("at") < 3, F.lit(_ATR)).alias("atr_14"))


_TEXT = ["plan_id", "session", "ticker", "kind", "state", "status", "skip_reason", "armed_at", "triggered_at", "invalidated_at", "reason", "entry", "stop", "shares", "risk_at_trigger", "session_high", "session_low", "bars", "last_ts"]
_MONITORED = f"""WITH {_MACHINES.format(atr=f'{_ATR}::DOUBLE')},
p AS (SELECT ticker || '-' || kind || '-' || nth AS plan_id, ticker, kind, nth FROM (SELECT DISTINCT event_type AS ticker FROM events UNION ALL SELECT r_name FROM region) CROSS JOIN (VALUES ('orl', 0), ('first_red', 1), ('vwap_fail', 2), ('orl', 3)) v(kind, nth)),
j AS (SELECT plan_id, e.session, p.ticker, p.kind, phase, CASE WHEN nth = 3 THEN 'atr_14_unavailable' WHEN p.kind = 'orl' AND strftime(opened, '%H:%M') <> '00:00' THEN 'opening_range_bar_unavailable' END AS skip, e.* EXCLUDE (session, ticker, kind, phase), session IS NULL AS nb FROM p LEFT JOIN e ON e.ticker = p.ticker AND e.kind = p.kind),
t AS (SELECT *, CASE WHEN skip IS NULL AND phase = 'triggered' AND entry > 0 AND stop > entry THEN CAST(floor(least({_RISK} / (stop - entry), {_CAP} / entry)) AS BIGINT) END AS shares FROM j)
SELECT plan_id, session, ticker, kind, CASE WHEN nb OR skip IS NOT NULL THEN 'armed' ELSE phase END AS state, CASE WHEN nb THEN 'no_bars' WHEN skip IS NOT NULL THEN 'skipped' ELSE 'evaluated' END AS status, CASE WHEN NOT nb THEN skip END AS skip_reason,
    CASE WHEN skip IS NULL THEN CAST(opened AS VARCHAR) END AS armed_at, CASE WHEN skip IS NULL THEN triggered_at END AS triggered_at, CASE WHEN skip IS NULL THEN invalidated_at END AS invalidated_at, CASE WHEN skip IS NULL THEN reason END AS reason, CASE WHEN skip IS NULL THEN entry END AS entry, CASE WHEN skip IS NULL THEN stop END AS stop,
    shares, round(shares * (stop - entry), 2) AS risk_at_trigger, CASE WHEN skip IS NULL THEN hi END AS session_high, CASE WHEN skip IS NULL THEN lo END AS session_low, coalesce(bars, 0) AS bars, CASE WHEN skip IS NULL THEN last_ts END AS last_ts FROM t"""
_add("t05_plan_monitor", lambda s, d: live.plan_monitor(_plans(s, d), intraday(s, d), "UTC", "00:00").select(*_TEXT), _MONITORED, ("session",))
_add("t05_plan_monitor_stream", lambda s, d: _newest(_drained(live.stream_monitor(_plans(s, d), _sliced(intraday(s, d), HALVES), None, "UTC", "00:00", silence=None)), ["plan_id", "session"]).select(*_TEXT), f"SELECT * FROM ({_MONITORED}) WHERE status <> 'no_bars'", ("session",))

# T8: each day's bar twice, its first print at the open and its last one with the day's low and close.
def _prints(s: SparkSession, d: str) -> DataFrame:
    day = F.col("date").cast("timestamp")
    both = F.explode(F.array(F.struct((day + F.expr("interval 9 hours")).alias("ts"), F.col("open").alias("low"), F.col("open").alias("close")), F.struct((day + F.expr("interval 15 hours")).alias("ts"), F.col("low"), F.col("close"))))
    return bars(s, d).select("symbol", "date", both.alias("x")).select("symbol", "date", "x.*")


_add("t08_short_sale_state", lambda s, d: live.short_sale_state(bars(s, d)), f"WITH {BARS}, q AS (SELECT symbol, date, coalesce(low <= lag(close) OVER w * (1 - 0.1::DOUBLE), false) AS hit FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, date, hit, hit OR coalesce(lag(hit) OVER (PARTITION BY symbol ORDER BY date), false) AS restricted FROM q", ("date",))
_YEARS = [f"year(date) {x}" for x in ("< 1999", "= 1999", "= 2000", "> 2000")]
_add("t08_short_sale_stream", lambda s, d: _newest(_drained(live.stream_short_sale(_sliced(_prints(s, d), _YEARS), keep=None)), ["symbol", "date"]), SQL["t08_short_sale_state"])


# T9: the later half of each day comes first, the earlier half late.
def _repaired(s: SparkSession, d: str) -> DataFrame:
    writer = live.SessionRepair(f"{shared_path(s)}/repair-{uuid.uuid4().hex}", "vwap_fail")
    rows = intraday(s, d).withColumn("arrival", F.lit(1))
    _drained(_sliced(rows, HALVES[::-1]), "append", writer)
    behind = writer.late(s).groupBy("ticker", "session").agg(F.count("*").alias("late_bars"))
    return writer.states(s).join(behind, ["ticker", "session"], "left").select("ticker", "session", "phase", "bars", "entry", "stop", F.coalesce("late_bars", F.lit(0)).alias("late_bars"))


_add("t09_latest_arrivals", lambda s, d: live.latest_arrivals(table(s, d, "events").select(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").cast("string").alias("ts"), "event_id"), "event_id"), "SELECT event_type AS ticker, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, max(event_id) AS event_id FROM events GROUP BY 1, 2")
_add("t09_repaired_sessions", _repaired, f"WITH {_MACHINES.format(atr='0')}, late AS (SELECT ticker, session, count(*) FILTER (hour(ts) < 12) AS early, count(*) FILTER (hour(ts) >= 12) AS later FROM intraday GROUP BY ticker, session) SELECT ticker, session, phase, bars, entry, stop, CASE WHEN later > 0 THEN early ELSE 0 END AS late_bars FROM e JOIN late USING (ticker, session) WHERE kind = 'vwap_fail'", ("session",))

# T10: pauses of 300 seconds or more, in batch and as a stream; a user's last run has no pause after it.
_GAPS = "q AS (SELECT user_id, event_id, date_trunc('second', ts) AS ts, CAST(floor(epoch(lead(ts) OVER w)) - floor(epoch(ts)) AS BIGINT) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_add("t10_session_gaps", lambda s, d: session_gaps(table(s, d, "events")), f"WITH {_GAPS} SELECT user_id, event_id, gap FROM q WHERE gap >= 300")
_RUNS = f"WITH {_GAPS}, r AS (SELECT *, count(*) FILTER (gap >= 300) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM q) SELECT user_id, max(event_id) FILTER (gap IS NULL OR gap >= 300) AS event_id, CAST(max(ts) AS VARCHAR) AS ended, count(*) AS events FROM r GROUP BY user_id, run"
_add("t10_session_runs", lambda s, d: live.stream_session_gaps(table(s, d, "events")).withColumn("ended", F.col("ended").cast("string")), _RUNS)


def _streamed_runs(s: SparkSession, d: str) -> DataFrame:
    """Runs that a stream over the table has closed by its watermark."""
    rows = table(s, d, "events").select("user_id", "event_id", "ts")
    end = rows.agg(F.max("ts")).first()[0]  # one time
    half = rows.agg(F.expr("timestampadd(SECOND, timestampdiff(SECOND, min(ts), max(ts)) div 2, min(ts))")).first()[0]
    out = _drained(live.stream_session_gaps(_sliced(rows, [f"ts < timestamp '{half}'", f"ts >= timestamp '{half}'"])), "append").drop("batch")
    return out.where(F.col("ended") < F.lit(end) - F.expr("interval 16 minutes")).withColumn("ended", F.col("ended").cast("string"))


_add("t10_session_runs_stream", _streamed_runs, f"SELECT * FROM ({_RUNS}) WHERE CAST(ended AS TIMESTAMP) < (SELECT max(ts) FROM events) - INTERVAL 16 MINUTE")
