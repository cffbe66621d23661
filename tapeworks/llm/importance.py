"""Target-distribution importance resampling: hashed word runs of a raw corpus and of a target, log ratios by bucket, and
a Gumbel draw of the documents that look most like the target.

Features are found by a byte automaton over whole Arrow batches: a lookup table classifies every byte, differences give
word boundaries, and the CRCs of all runs advance together, one byte a step, through the CRC's own table. Only counts by
bucket leave the tasks (a row per bucket and task at most); a document's weight is made where its text is, from the table of gains,
whose size is the number of buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.mixing import prefix_sums
from tapeworks.llm.shared import written
from tapeworks.llm.textblock import Words, blocks, segment_sum

#: Bytes of words: digits, letters (capitals are lowered) and all bytes of characters beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True

#: Steps that all words take together; the rest of a longer word is added by zlib, so that one long word costs no steps.
STEPS = 64


def crc_table() -> np.ndarray:
    """The 256 entries of the reflected CRC-32: eight shifts of each byte, with the polynomial where a bit falls out."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = crc_table()


def advance(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Register of each run after the bytes raw[start:end]; registers are the inverted CRC, as the automaton holds them."""
    state = state.copy()
    lens = ends - starts
    order = np.argsort(-lens, kind="stable")
    at, now = starts[order], state[order]
    sizes = -lens[order]
    for j in range(min(int(lens.max(initial=0)), STEPS)):
        live = int(np.searchsorted(sizes, -j, "left"))
        reg = now[:live]
        now[:live] = _CRC[(reg ^ raw[at[:live] + j]) & 255] ^ (reg >> 8)
    state[order] = now
    for i in np.flatnonzero(lens > STEPS).tolist():
        state[i] = zlib.crc32(raw[starts[i] + STEPS : ends[i]].tobytes(), int(~state[i])) ^ 0xFFFFFFFF
    return state


def feature_buckets(raw: np.ndarray, offs: np.ndarray, least: int, most: int, buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each run length of least to most words: (buckets, offsets by text); and the words of each text."""
    words = Words(raw, offs, lower=True, table=IN_WORD)
    n = len(words)
    row = words.rows()
    found, state, starts = [], np.full(n, 0xFFFFFFFF, np.uint32), np.arange(n)
    for length in range(1, most + 1):
        if length > 1:
            good = starts + length - 1 < n
            good[good] = row[starts[good]] == row[starts[good] + length - 1]
            starts, state = starts[good], state[good]
            state = _CRC[(state ^ np.uint32(32)) & 255] ^ (state >> 8)
        last = starts + length - 1
        state = advance(state, words.raw, words.starts[last], words.ends[last])
        if length >= least:
            found.append(((~state).astype(np.int64) % buckets, np.searchsorted(row[starts], np.arange(len(offs)))))
    return found, np.diff(words.first)


def bucket_counts(texts: DataFrame, text_col: str, least: int, most: int, buckets: int) -> DataFrame:
    """(bucket, n) of all features of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, offs in blocks(batch.column(0)):
                for found, _ in feature_buckets(raw, offs, least, most, buckets)[0]:
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw_counts: DataFrame, target_counts: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln of the smoothed target share over the smoothed raw share) by bucket; as many values as buckets."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((raw_counts, s), (target_counts, t)):
        for r in counts.collect():
            into[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def gumbel(id_col: str, seed: int):
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of sha256('<seed>:<id>'); a null id counts as no characters."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", least: int = 1, most: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """id, n_features, weight, score and rank of every document; ranks 1, 2, ... go to the drawn ones, others have null.

    A null or empty text, or one without words, has no features, weight 0 and is never drawn. Of the N documents with at
    least least_words words, floor(percent * N / 100) are drawn by highest score; ties go to the smaller id (null last), then
    to fewer features and the text's hash. Repeated rows are rows like any others. A very long text is a block of
    its own. With an empty target all gains follow the raw counts; an empty table of documents gives no rows. Other
    columns play no part.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, least, most, buckets), bucket_counts(target, target_text, least, most, buckets), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in blocks(batch.column(2)):
                found, n_words = feature_buckets(raw, offs, least, most, buckets)
                weight, n = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for bucket, at in found:
                    weight += segment_sum(gains[bucket], at)
                    n += np.diff(at)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n_words), pa.array(n), pa.array(weight)], ["id", "th", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, th long, n_words long, n_features long, weight long")
    rows = written(rows.withColumn("score", F.col("weight") + gumbel("id", seed)), "importance")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("th")]
    ranked = prefix_sums(able.withColumn("one", F.lit(1)), [], order, ["one"]).withColumn("rank", F.col("before_one") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = ["id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(rest.select(*out)).withColumnRenamed("id", id_col)


IMPORTANCE_SQL = r"""
WITH RECURSIVE tab(i, c, k) AS (SELECT range, CAST(range AS BIGINT), 0 FROM range(256)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
tbl AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
w AS (SELECT true AS raw, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
    UNION ALL SELECT false, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT raw, doc_id, unnest(ws) AS word FROM w),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM f)),
y AS (SELECT word, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(h) // 2 + 1), lambda p: CAST('0x' || substr(h, CAST(2 * p - 1 AS BIGINT), 2) AS BIGINT))) AS bytes FROM v),
b AS (SELECT word, xor(4294967295, list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 10000 AS bucket FROM y, tbl),
c AS (SELECT bucket, CAST(count(*) FILTER (raw) AS DOUBLE) AS s, CAST(count(*) FILTER (NOT raw) AS DOUBLE) AS t FROM f JOIN b USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM c),
d AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN b USING (word) JOIN g USING (bucket) WHERE raw GROUP BY doc_id),
z AS (SELECT documents.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || sha256('2024:' || documents.doc_id)[1:8] AS BIGINT) AS h FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM z),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS many FROM r)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * many // 100 THEN CAST(place AS BIGINT) END AS rank FROM k
"""
