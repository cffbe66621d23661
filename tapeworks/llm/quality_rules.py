"""Quality rules of documents and of their hosts, in DataFrame functions alone.

Documents first get counts and a verdict by fixed rules. Failures of each of five rules are then counted by host, each
rule's rates are shrunk towards all hosts by a beta prior of its own, fitted to their spread, and a host whose shrunken
rate of one rule is too high takes its documents with it. The first two rules also fail a document by themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import cut

WHITE = " \t\n\x0b\f\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for the row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but the six ASCII white-space characters."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside width-word windows that occur at least twice in the text, the first one included."""

    def covered(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda e, j: (F.get(s, j - 1)["g"] == e["g"]) | (F.coalesce(F.get(s, j + 1)["g"] == e["g"], F.lit(False)))))
        places = F.array_sort(F.transform(twice, lambda e: e["i"]))
        gaps = let(places, lambda p: F.transform(p, lambda v, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1), v + width) - v)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    last = F.size(words) - width
    grams = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))
    count = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(last >= 1, count).otherwise(F.lit(0)).cast("long")


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host, th and the base counts and verdict of every row; a null text has no words and fails."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text_col).alias("th"), text.alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    rows = rows.select(
        "id", "host", "th", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def rule_failures() -> dict[str, Column]:
    """What fails each rule: too few words, repeated windows, symbols, repeated lines, odd mean word length."""
    n = F.col("n_words")
    return {
        "short": n < 10, "repeats": 100 * F.col("n_repeat_words") > 20 * n, "symbols": 100 * F.col("n_symbols") > 10 * n,
        "lines": 20 * F.col("n_dup_lines") > n, "lengths": (F.col("word_chars") > 12 * n) | (F.col("word_chars") < 2 * n),
    }


def host_verdicts(rules: DataFrame, limit: float = 0.5) -> DataFrame:
    """host, host_docs, <rule>_rate (shrunken share of documents that fail it) of each rule, and host_kept.

    A rule's prior is a beta distribution with the mean and variance of the hosts' rates, weighted by documents; its
    weight is held between 1 and 10,000 documents. Hosts without a name form one host.
    """
    tests = rule_failures()
    hosts = rules.groupBy("host").agg(F.count("*").alias("host_docs"), *[F.sum(c.cast("long")).alias(r) for r, c in tests.items()])
    sums = [x for r in tests for x in (F.sum(r).alias(f"{r}_f"), F.sum(F.col(r) * F.col(r) / F.col("host_docs")).alias(f"{r}_q"))]
    seen = hosts.agg(F.sum("host_docs").alias("n"), *sums).first()
    n = seen["n"] or 0
    rates = {}
    for r in tests:
        mean = (seen[f"{r}_f"] or 0) / n if n else 0.0
        spread = max((seen[f"{r}_q"] or 0.0) / n - mean * mean, 0.0) if n else 0.0
        weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 10_000.0) if spread > 1e-12 else 10_000.0
        rates[r] = (F.col(r) + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
    kept = F.greatest(*rates.values()) <= limit
    return hosts.select("host", "host_docs", *[c.alias(f"{r}_rate") for r, c in rates.items()], kept.alias("host_kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """Counts, base_failed and kept of every row: kept if neither it nor its host fails.

    A null or blank text has no words and fails; a null host counts as one host; rows without an id and repeated rows
    are kept as they are, each counting for its host; a very long text is one row's arrays; rates that tie with the
    limit pass; an empty table gives an empty table; other columns play no part. Host verdicts are cut before the join,
    so that both sides are plain exchanges, which Spark splits at a hot host.
    """
    rules = cut(document_rules(docs, id_col, text_col, host_col))
    hosts = cut(host_verdicts(rules, limit).withColumnRenamed("host", "name"))
    out = rules.join(hosts, F.col("host").eqNullSafe(F.col("name")))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
u AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT r, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS gram
        FROM u WINDOW p AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g WHERE gram IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE c > 1 GROUP BY r),
b AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
rl AS (SELECT source, unnest([{'r': 'short', 'x': n_words < 10}, {'r': 'repeats', 'x': 100 * n_repeat_words > 20 * n_words}, {'r': 'symbols', 'x': 100 * n_symbols > 10 * n_words},
        {'r': 'lines', 'x': 20 * n_dup_lines > n_words}, {'r': 'lengths', 'x': word_chars > 12 * n_words OR word_chars < 2 * n_words}]) AS z FROM f),
s AS (SELECT source, z.r AS r, count(*) AS n, CAST(count(*) FILTER (z.x) AS DOUBLE) AS x FROM rl GROUP BY ALL),
m AS (SELECT r, sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) - pow(sum(x) / sum(n), 2) AS spread FROM s GROUP BY r),
a AS (SELECT r, mean, CASE WHEN spread > 1e-12 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 10000) ELSE 10000 END AS weight FROM m),
o AS (SELECT source, bool_and((x + mean * weight) / (n + weight) <= 0.5) AS ok FROM s JOIN a USING (r) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND ok AS kept
FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source
"""
