"""Intraday monitors: cumulative price means and trigger state machines, as a batch fold and as a stream.

A session's state is a function of its bars in order. The batch form folds a whole session; the stream keeps the
machine's state per (ticker, session), feeds it each micro-batch's bars in time order and drops bars that come later
than one already folded, so both agree on bars that arrive in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeworks.streaming.triggers import FIELDS, MACHINES, STATE, Bar, fresh, step

def session_vwap(bars: DataFrame) -> DataFrame:
    """Running sum(close * volume) / sum(volume) from the session's open; the close while there is no volume."""
    w = Window.partitionBy("ticker", "session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    v = F.sum("v").over(w)
    return bars.withColumn("vwap", F.when(v > 0, F.sum(F.col("c") * F.col("v")).over(w) / v).otherwise(F.col("c")))


OUT = "ticker string, session date, kind string, phase string, bars long, last_ts string, entry double, stop double, triggered_at string, invalidated_at string, reason string"


def _advance(state: dict, g: pd.DataFrame, kind: str, atr: float | None = 0.0) -> dict:
    state = dict(state)
    for ts, o, h, low, c, v in g.sort_values("ts")[["ts", "o", "h", "l", "c", "v"]].itertuples(index=False):
        if str(ts) > state["at"]:  # others are late or repeated
            step(state, Bar(str(ts), *map(float, (o, h, low, c, v))), kind, atr)
    return state


def _session_row(ticker: str, session: object, kind: str, s: dict) -> pd.DataFrame:
    return pd.DataFrame([{"ticker": ticker, "session": session, "kind": kind, "phase": s["phase"], "bars": s["n"], "last_ts": s["at"], **{k: s[k] for k in ("entry", "stop", "triggered_at", "invalidated_at", "reason")}}])


def fold_sessions(bars: DataFrame, kind: str, atr: float = 0.0) -> DataFrame:
    """Final state of each (ticker, session) in batch; atr widens the opening-range machine's stop."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return _session_row(g["ticker"].iat[0], g["session"].iat[0], kind, _advance(fresh(), g, kind, atr))

    return bars.groupBy("ticker", "session").applyInPandas(run, OUT)


def stream_sessions(bars: DataFrame, kind: str, idle_seconds: int = 86400, atr: float = 0.0) -> DataFrame:
    """The same as a stream with a watermark of two bars; states go once a session has been idle for
    `idle_seconds`."""
    names = list(FIELDS)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        s = _advance(dict(zip(names, state.get, strict=True)) if state.exists else fresh(), rows, kind, atr)
        state.update(tuple(s[k] for k in names))
        state.setTimeoutTimestamp((int(rows["ts"].max().timestamp()) + idle_seconds) * 1000)
        yield _session_row(key[0], key[1], kind, s)

    return bars.withWatermark("ts", "10 minutes").groupBy("ticker", "session").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


#: One row of a monitored plan; shares and risk are of the trigger's prices and null in every other phase.
MONITOR = "plan_id string, session date, ticker string, kind string, state string, status string, skip_reason string, armed_at string, triggered_at string, invalidated_at string, reason string, entry double, stop double, shares long, risk_at_trigger double, session_high double, session_low double, bars long, last_ts string"


def _opened(s: dict, first: pd.Timestamp, kind: str, atr: float | None, clock: tuple[str, str, str]) -> dict:
    """A new state with the reason why the opening-range machine does not run, if there is one; clock: the zone of the
    times, the exchange's zone and its opening time."""
    if kind == "orl" and atr is None:
        return s | {"skip_reason": "atr_14_unavailable"}
    if kind == "orl" and first.tz_localize(clock[0]).tz_convert(clock[1]).strftime("%H:%M") != clock[2]:
        return s | {"skip_reason": "opening_range_bar_unavailable"}
    return s


def _monitor_row(plan_id: str, session: object, plan: dict, s: dict, silent: bool = False) -> dict:
    shares = risk = None
    if s["phase"] == "triggered" and s["entry"] > 0 and s["stop"] > s["entry"]:
        per = s["stop"] - s["entry"]
        shares = math.floor(min(plan["risk_usd"] / per, plan["cap_usd"] / s["entry"]))
        risk = round(shares * per, 2)
    status = "no_bars" if silent else "skipped" if s["skip_reason"] else "evaluated"
    if s["skip_reason"]:  # nothing was evaluated
        s = fresh() | {"skip_reason": s["skip_reason"], "n": s["n"]}
    return {
        "plan_id": plan_id, "session": session, "ticker": plan["ticker"], "kind": plan["kind"], "state": s["phase"], "status": status, **{k: s[k] for k in ("skip_reason", "armed_at", "triggered_at", "invalidated_at", "reason", "entry", "stop")},
        "shares": shares, "risk_at_trigger": risk, "session_high": s["high"], "session_low": s["low"], "bars": s["n"], "last_ts": s["at"] or None,
    }


def _plan_of(rows: pd.DataFrame) -> dict:
    """The plan's fields, which every row of its group repeats."""
    first = rows.iloc[0]
    return {"ticker": first["ticker"], "kind": first["kind"], "risk_usd": float(first["risk_usd"]), "cap_usd": float(first["cap_usd"]), "atr": None if pd.isna(first["atr_14"]) else float(first["atr_14"])}


def _plan_advance(s: dict | None, plan: dict, rows: pd.DataFrame, clock: tuple[str, str, str]) -> dict:
    rows = rows[rows["ts"].notna()]
    if s is None:
        s = fresh()
    if s["n"] == 0 and len(rows):
        s = _opened(s, rows["ts"].min(), plan["kind"], plan["atr"], clock)
    return _advance(s, rows, plan["kind"], plan["atr"])


_MONITOR_COLUMNS = [c.split()[0] for c in MONITOR.split(", ")]
_PLAN_BAR = ["plan_id", "session", "ticker", "kind", "risk_usd", "cap_usd", "atr_14", "ts", "o", "h", "l", "c", "v"]


def plan_monitor(plans: DataFrame, bars: DataFrame, zone: str = "America/New_York", opening: str = "09:30") -> DataFrame:
    """Each plan (plan_id, ticker, kind, risk_usd, cap_usd, atr_14) against every session of its ticker's bars: its machine's
    phase and prices, and on a trigger the shares that its risk and its cap allow, floor(min(risk / (stop - entry), cap /
    entry)), with the risk at the trigger; null where the stop is not above the entry.

    A kind without a machine is an error. A plan whose ticker has no bars is armed, with status no_bars and no session.
    """
    clock = (bars.sparkSession.conf.get("spark.sql.session.timeZone"), zone, opening)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        plan = _plan_of(g)
        s = _plan_advance(None, plan, g, clock)
        return pd.DataFrame([_monitor_row(g["plan_id"].iat[0], g["session"].iat[0], plan, s)], columns=_MONITOR_COLUMNS)

    found = plans.join(bars, "ticker").select(*_PLAN_BAR).groupBy("plan_id", "session").applyInPandas(run, MONITOR)
    none = plans.join(bars.select("ticker").distinct(), "ticker", "left_anti")
    empty = {"plan_id": F.col("plan_id"), "ticker": F.col("ticker"), "kind": F.col("kind"), "state": F.lit("armed"), "status": F.lit("no_bars"), "bars": F.lit(0)}
    return found.unionByName(none.select(*[empty.get(c.split()[0], F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in MONITOR.split(", ")]))


def stream_monitor(plans: DataFrame, bars: DataFrame, watch: DataFrame | None = None, zone: str = "America/New_York", opening: str = "09:30", silence: str | None = "10 minutes", keep: int = 5) -> DataFrame:
    """The same as a stream: bars (or none yet) joined with the table of plans, a machine's state per plan and session.

    watch: a stream of sessions to be watched (ticker, session), so that a ticker that trades nothing is known as well.
    After each `silence` without a bar, by the clock of the cluster, the last state goes out again with status no_bars; it
    never moves by that. `keep` silences in a row end a session's watch and drop its state. Such a stream never runs out of
    work; without a silence (a replay) there are no timers and states stay.
    """
    names = list(FIELDS)
    length = int(pd.Timedelta(silence).total_seconds() * 1000) if silence else 0
    clock = (bars.sparkSession.conf.get("spark.sql.session.timeZone"), zone, opening)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip([*names, "quiet", "ticker", "kind", "risk_usd", "cap_usd", "atr"], state.get, strict=True)) if state.exists else None
        if state.hasTimedOut:
            quiet = held["quiet"] + 1
            s = {k: held[k] for k in names}
            if quiet >= keep:
                state.remove()
            else:
                state.update((*(s[k] for k in names), quiet, *(held[k] for k in ("ticker", "kind", "risk_usd", "cap_usd", "atr"))))
                state.setTimeoutDuration(length)
            yield pd.DataFrame([_monitor_row(key[0], key[1], held, s, silent=True)], columns=_MONITOR_COLUMNS)
            return
        rows = pd.concat(list(parts))
        plan = _plan_of(rows) if held is None else held
        s = _plan_advance(held and {k: held[k] for k in names}, plan, rows, clock)
        state.update((*(s[k] for k in names), 0, *(plan[k] for k in ("ticker", "kind", "risk_usd", "cap_usd", "atr"))))
        if length:
            state.setTimeoutDuration(length)
        if rows["ts"].notna().any():
            yield pd.DataFrame([_monitor_row(key[0], key[1], plan, s)], columns=_MONITOR_COLUMNS)

    rows = bars.select("ticker", "session", "ts", "o", "h", "l", "c", "v")
    if watch is not None:
        rows = rows.unionByName(watch.select("ticker", "session"), allowMissingColumns=True)
    kept = STATE + ", quiet long, ticker string, kind string, risk_usd double, cap_usd double, atr double"
    return rows.join(plans, "ticker").select(*_PLAN_BAR).groupBy("plan_id", "session").applyInPandasWithState(run, MONITOR, kept, "update", GroupStateTimeout.ProcessingTimeTimeout if length else GroupStateTimeout.NoTimeout)


class SessionRepair:
    """foreachBatch writer that keeps (ticker, session) states right whatever order bars arrive in.

    Each micro-batch's bars are stored under its number, which makes a repeated batch overwrite itself. The sessions it
    touches are folded again from all their stored bars, the last arrival of each bar counting, and written as that batch's
    states; bars that came behind the last one folded before are also kept as the side output `late`. A session has at
    most a day's bars, so a fold is small however long the stream has run; only touched sessions' bars are read beyond the
    scan, which partitions by session date prune.
    """

    def __init__(self, path: str, kind: str, arrival: str = "arrival", atr: float = 0.0):
        self.path, self.kind, self.arrival, self.atr = path.rstrip("/"), kind, arrival, atr

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = self.states(spark, number) if number else None
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("session").parquet(f"{self.path}/bars/batch={number}")
        mine = spark.read.parquet(f"{self.path}/bars/batch={number}")
        if before is not None:
            late = mine.join(before.select("ticker", "session", "last_ts"), ["ticker", "session"]).where(F.col("ts") <= F.col("last_ts").cast("timestamp")).drop("last_ts")
            late.write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        days = [r[0] for r in mine.select("session").distinct().collect()]  # the days of one micro-batch
        stored = spark.read.parquet(f"{self.path}/bars").where((F.col("batch") <= number) & F.col("session").isin(days))
        rows = stored.join(mine.select("ticker", "session").distinct(), ["ticker", "session"], "left_semi")
        last = Window.partitionBy("ticker", "session", "ts").orderBy(F.desc("batch"), F.desc(self.arrival))
        rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "batch")
        fold_sessions(rows, self.kind, self.atr).write.mode("overwrite").parquet(f"{self.path}/states/batch={number}")

    def states(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The latest state of each session (of batches before a number)."""
        rows = spark.read.parquet(f"{self.path}/states")
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        newest = Window.partitionBy("ticker", "session").orderBy(F.desc("batch"))
        return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "batch")

    def late(self, spark: SparkSession) -> DataFrame:
        """All bars that came late, with the batch that brought them."""
        return spark.read.parquet(f"{self.path}/late")


def regular_session(bars: DataFrame, ts: str = "ts", zone: str = "America/New_York") -> DataFrame:
    """Rows from 09:30 to before 16:00 local time, Monday to Friday, with the local session date."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return bars.withColumn("session", F.to_date(local)).where((minute >= 570) & (minute < 960) & (F.weekday(local) < 5))


def short_sale_state(bars: DataFrame, drop: float = 0.10) -> DataFrame:
    """Restricted on a day whose low is `drop` below the close before, and on the day after."""
    w = Window.partitionBy("symbol").orderBy("date")
    hit = F.col("low") <= F.lag("close").over(w) * (1 - drop)
    rows = bars.withColumn("hit", F.coalesce(hit, F.lit(False)))
    return rows.select("symbol", "date", "hit", (F.col("hit") | F.coalesce(F.lag("hit").over(w), F.lit(False))).alias("restricted"))


RESTRICTION = "symbol string, date date, hit boolean, restricted boolean"


def stream_short_sale(prints: DataFrame, drop: float = 0.10, keep: str | None = "5 days") -> DataFrame:
    """The same as a stream of prints or bars (symbol, date, ts, low, close), one row a symbol, day and micro-batch.

    A symbol's state outlives its sessions: the day before's last close and whether it was restricted by its own fall. It
    goes after `keep` without a print (None, for a replay: never). Within a day prints may come in any order; days must not go back.
    """
    length = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else 0

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        day, at, low, close, prior, carried = state.get if state.exists else (None, "", None, None, None, False)
        out = []
        for date, g in pd.concat(list(parts)).sort_values(["date", "ts"]).groupby("date"):
            date = str(date)[:10]
            if day is not None and date < day:
                continue
            if date != day:
                carried = low is not None and prior is not None and low <= prior * (1 - drop)
                day, at, prior, low, close = date, "", close, None, None
            low = float(g["low"].min()) if low is None else min(low, float(g["low"].min()))
            if str(g["ts"].iat[-1]) >= at:
                at, close = str(g["ts"].iat[-1]), float(g["close"].iat[-1])
            hit = prior is not None and low <= prior * (1 - drop)
            out.append({"symbol": key[0], "date": pd.Timestamp(day).date(), "hit": hit, "restricted": hit or carried})
        state.update((day, at, low, close, prior, carried))
        if length:
            state.setTimeoutDuration(length)
        yield pd.DataFrame(out, columns=["symbol", "date", "hit", "restricted"])

    kept = "day string, at string, low double, close double, prior double, carried boolean"
    return prints.groupBy("symbol").applyInPandasWithState(run, RESTRICTION, kept, "update", GroupStateTimeout.ProcessingTimeTimeout if length else GroupStateTimeout.NoTimeout)


def stream_session_gaps(events: DataFrame, seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """user_id, event_id, ended, events: the last event of each run of a user's events that a pause of `seconds` or more
    has ended, once the watermark has passed it. Works on a table as well; there a user's last run has ended too."""
    second = events.withColumn("ts", F.date_trunc("second", "ts"))
    gap = f"{seconds * 1000 - 1} milliseconds"  # a window ends at the pause, not after it
    if events.isStreaming:
        second = second.withWatermark("ts", delay)
    rows = second.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.max(F.struct("ts", "event_id")).alias("last"), F.count("*").alias("events"))
    return rows.select("user_id", F.col("last.event_id").alias("event_id"), F.col("last.ts").alias("ended"), "events")


def latest_arrivals(bars: DataFrame, arrival: str) -> DataFrame:
    """One bar per (ticker, ts): the last to arrive."""
    w = Window.partitionBy("ticker", "ts").orderBy(F.desc(arrival))
    return bars.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stream_latest(bars: DataFrame, arrival: str) -> DataFrame:
    """Stream of one bar per (ticker, ts), the last to arrive, out once the watermark of 10 minutes has passed it; what
    comes later than that is dropped."""
    rest = [c for c in bars.columns if c not in ("ticker", "ts")]
    rows = bars.withWatermark("ts", "10 minutes").groupBy("ticker", "ts").agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("x"))
    return rows.select("ticker", "ts", "x.*").select(*bars.columns)


def opening_status(bars: DataFrame, ranges: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """ticker, session and why the opening-range monitor skips it (null: it runs): no daily true range (ranges: ticker,
    session, atr_14), or a first bar that is not the 09:30 one of the zone; the range's absence goes first."""
    first = bars.groupBy("ticker", "session").agg(F.min("ts").alias("first"))
    opens = F.date_format(F.from_utc_timestamp("first", zone), "HH:mm") == "09:30"
    rows = first.join(ranges.select("ticker", "session", "atr_14"), ["ticker", "session"], "left")
    return rows.select("ticker", "session", F.when(F.col("atr_14").isNull(), "atr_14_unavailable").when(~opens, "opening_range_bar_unavailable").alias("skip_reason"))


def orl_monitor(bars: DataFrame, ranges: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """The opening-range machine's phase where it runs, armed and the reason where it is skipped."""
    status = opening_status(bars, ranges, zone)
    found = fold_sessions(bars, "orl").select("ticker", "session", "phase", "bars")
    ran = F.col("skip_reason").isNull()
    return status.join(found, ["ticker", "session"]).select("ticker", "session", F.when(ran, F.col("phase")).otherwise("armed").alias("state"), F.when(ran, "evaluated").otherwise("skipped").alias("status"), "skip_reason", "bars")
