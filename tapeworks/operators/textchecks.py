"""Jobs on session logs: usage, errors, sequences, requests, pauses, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of an error in tool output, and of a wish for automation.
ERROR_WORDS = ("error", "exception", "traceback", "failed")
REQUEST_WORDS = ("skill", "create", "automate", "workflow", "pipeline", "スキル", "作成", "自動化", "ワークフロー")
#: Starts of prompts that a program wrote.
AUTOMATED_STARTS = ("# LLM Skill Review Request", "Improve the skill '", "Implement the following plan:", "Score each skill idea candidate")


def usage_counts(messages: DataFrame, pattern: str = r"skills/([a-z0-9-]+)/") -> DataFrame:
    return messages.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def error_mentions(messages: DataFrame, samples: int = 5) -> DataFrame:
    """Per conversation: messages with an error word and the first samples of them."""
    hit = F.lower("text").rlike("|".join(ERROR_WORDS))
    ranked = messages.where(hit).withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return ranked.groupBy("conv_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= samples, F.struct("k", F.substring("text", 1, 200).alias("t"))))), lambda x: x["t"]).alias("samples"))


def repeated_sequences(messages: DataFrame, item: str, n: int = 3, least: int = 3) -> DataFrame:
    """Sequences of n consecutive items seen at least `least` times over all conversations."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    cols: list[Column] = [F.col(item), *[F.lead(item, k).over(w) for k in range(1, n)]]
    rows = messages.select(F.when(cols[-1].isNotNull(), F.concat_ws(">", *cols)).alias("sequence")).where("sequence is not null")
    return rows.groupBy("sequence").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def session_sequences(calls: DataFrame, session: str, order: list[str], item: str, n: int = 3, least: int = 3, floor: int = 9) -> DataFrame:
    """(session, sequence, n): runs of n consecutive items seen `least` times or more in one session; sessions of under
    `floor` calls have none. Items that start with two underscores mark errors and are no calls."""
    calls = calls.where(F.col(item).isNotNull() & ~F.col(item).startswith("__"))
    w = Window.partitionBy(session).orderBy(*order)
    cols = [F.col(item), *[F.lead(item, k).over(w) for k in range(1, n)]]
    size = F.count("*").over(Window.partitionBy(session))
    rows = calls.select(session, size.alias("_size"), F.when(cols[-1].isNotNull(), F.concat_ws(">", *cols)).alias("sequence")).where((F.col("_size") >= floor) & F.col("sequence").isNotNull())
    return rows.groupBy(session, "sequence").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def automation_requests(messages: DataFrame) -> DataFrame:
    """User messages with a request word, distinct by their first 100 characters; those that a program wrote are left out."""
    hit, text = F.lower("text").rlike("|".join(REQUEST_WORDS)), F.regexp_replace("text", r"^\s+", "")
    for start in AUTOMATED_STARTS:
        hit = hit & ~text.startswith(start)
    return messages.where((F.col("role") == "user") & hit).select("conv_id", F.substring("text", 1, 100).alias("request")).distinct()


def session_gaps(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Events (user_id, ts, event_id) whose next event of the same user comes after `seconds` or more."""
    gap = F.unix_timestamp(F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) - F.unix_timestamp("ts")
    return events.withColumn("gap", gap).where(F.col("gap") >= seconds).select("user_id", "event_id", "gap")


def log_totals(messages: DataFrame) -> DataFrame:
    return messages.groupBy("role").agg(F.count("*").alias("messages"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))
