"""Toxicity by compression distance: two zstandard dictionaries, one of windows that mark toxic text and one of
ordinary text, and the length of each window under both.

A window is a word of any length, cut as in packing, after lower-casing, in learning and in scoring. Words that are far
more common in documents labelled toxic than chance allows are the toxic dictionary's content, the commonest others the ordinary one's. Every byte is written `widen` times, as the codec finds
no match shorter than a few bytes. The share of a window's ordinary length that the toxic dictionary saves is compared
over the document; a logistic curve fitted on the labelled documents calibrates the document's score.

Learning is grouped aggregation over at most `fit_rows` labelled documents; what reaches the driver is bounded by the
dictionaries' sizes and by that many rows of two features for the curve. Scoring is one pass over the texts without a shuffle: a task
compresses each distinct word once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.packing import Pieces
from tapeworks.llm.textblock import blocks

#: Bytes in both dictionaries and before every window, so that a window always compresses.
PREFIX = b"\n0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!?+=:;()[]{}\n"


def widened(text: bytes, widen: int) -> bytes:
    return np.repeat(np.frombuffer(text, np.uint8), widen).tobytes()


@lru_cache(maxsize=4)
def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), source_size=120, write_content_size=False, write_checksum=False, write_dict_id=False)
    book.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=book, compression_params=how)


def dictionary(words: list[str], widen: int, most_bytes: int) -> bytes:
    """Dictionary content, the most telling words last, where matches cost least."""
    return widened("".join(f"<{w}>" for w in words[::-1]).encode(), widen)[-most_bytes:] + PREFIX


def window_savings(words: list[bytes], toxic: bytes, plain: bytes, widen: int, level: int) -> np.ndarray:
    """The share of each window's ordinary length that the toxic dictionary saves."""
    one, two = _compressor(toxic, level), _compressor(plain, level)
    base_one, base_two = len(one.compress(PREFIX)), len(two.compress(PREFIX))
    out = np.empty(len(words), np.float32)
    for i, word in enumerate(words):
        body = PREFIX + widened(b"<" + word + b">", widen)
        a, b = len(one.compress(body)) - base_one, len(two.compress(body)) - base_two
        out[i] = (b - a) / max(b, 4)
    return out


def lowered(text: Column) -> Column:
    """Text as windows are cut from it, for learning and scoring alike."""
    return F.lower(text.cast("string"))


def distinct_windows(labelled: DataFrame) -> DataFrame:
    """(y, word): each row's distinct windows; labelled: text (lowered), y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in blocks(batch.column(1)):
                words = Pieces(raw, offs)
                if not len(words):
                    continue
                uniq, where, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
                pairs = np.unique(words.rows() * len(uniq) + back)
                names = pa.array([w.decode(errors="replace") for w in words.bytes_of(where)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(pairs // len(uniq))), names.take(pa.array(pairs % len(uniq)))], ["y", "word"])

    return labelled.select("y", "text").mapInArrow(run, "y int, word string")


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def learn_words(labelled: DataFrame, most: int = 2000, ordinary: int = 30_000, low: float = 5.0) -> tuple[list[str], list[str]]:
    """(toxic, ordinary) words, most telling first. labelled: text (lowered), y (1 toxic).

    A word is telling if its documents' toxic share exceeds the overall share by `low` standard deviations and is at
    least a half, however common other words are. Both lists are bounded, as a dictionary is: words in fewer than three
    labelled documents are not learned, at most `most` telling ones are, and the `ordinary` commonest others, of which the
    dictionary's 256 KB then hold the commonest (at sf0.1 a third of 30,000).
    """
    rows = distinct_windows(labelled)
    counts = labelled.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    base = (counts["t"] or 0) / max(counts["n"], 1)
    words = rows.groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    z = (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1)
    words = words.where("n > 2").withColumn("z", z)
    found = words.where((F.col("z") >= low) & (F.col("t") * 2 >= F.col("n"))).orderBy(F.desc("z"), "word").limit(most).collect()
    plain = words.where("z < 1").orderBy(F.desc(F.col("n") - F.col("t")), "word").limit(ordinary).collect()
    return [r["word"] for r in found], [r["word"] for r in plain]


def document_savings(docs: DataFrame, keep: list[str], text_col: str, toxic: bytes, plain: bytes, widen: int, level: int, most: int = 1_000_000) -> DataFrame:
    """The columns in keep, and f1 and f2: the largest and the second largest saving among the document's windows."""
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        for batch in batches:
            for a, b, raw, offs in blocks(batch.column(len(keep))):
                words = Pieces(raw, offs)
                f1, f2 = np.zeros(b - a), np.zeros(b - a)
                if len(words):
                    names = words.hashes()
                    uniq, where, back = np.unique(names, return_index=True, return_inverse=True)
                    if len(known) > most:
                        known, value = np.zeros(0, np.uint64), np.zeros(0, np.float32)
                    new = ~np.isin(uniq, known, assume_unique=True)
                    if new.any():
                        got = window_savings(words.bytes_of(where[new]), toxic, plain, widen, level)
                        known, value = np.concatenate([known, uniq[new]]), np.concatenate([value, got])
                        order = np.argsort(known)
                        known, value = known[order], value[order]
                    each = value[np.searchsorted(known, uniq)]
                    row = words.rows()
                    order = np.lexsort((-each[back], row))
                    row, back = row[order], back[order]
                    first = np.searchsorted(row, np.arange(b - a))
                    has = np.searchsorted(row, np.arange(b - a), "right") > first
                    f1[has] = np.maximum(each[back[first[has]]], 0)
                    other = np.where(back == back[first[row]], -1.0, each[back])
                    f2[has] = np.maximum(np.maximum.reduceat(other, first[has]), 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), pa.array(f1), pa.array(f2)], [*keep, "f1", "f2"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "f1 double, f2 double"])
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps, row i counted n[i] times; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0, widen: int = 3, level: int = 9, fit_rows: int = 30_000) -> DataFrame:
    """id, held_out, score, predicted of every row.

    Learns from labelled rows (labels: id_col, toxic) outside the held-out fold only. A null or empty text has no
    windows and gets the curve's value at 0; so has every text if no row is labelled (score 0.5) or no word is telling.
    Rows without an id are held out. Labels without a value are left out; an id whose labels clash counts as toxic;
    repeated rows are used as they come, extra columns ignored. A very long text is scored whole; ties in savings change
    nothing, as the features are the two largest values. Words and curve are learned from at most `fit_rows` labelled
    ids, those with the least hashes; rows of equal savings and label are one weighted row of the curve.
    """
    text = lowered(F.col(text_col))
    marks = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("y")).where("_id is not null and y is not null").where(fold("_id", folds) != held)
    marks = marks.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    train = docs.select(F.col(id_col).alias("_doc"), text.alias("text")).where("text is not null")
    train = train.join(F.broadcast(marks), F.col("_doc") == F.col("_id")).select("text", "y")  # at most fit_rows labels
    words, plain = learn_words(train)
    one, two = dictionary(words, widen, 1 << 18), dictionary(plain, widen, 1 << 18)
    seen = document_savings(train, ["y"], "text", one, two, widen, level).groupBy("f1", "f2", "y").agg(F.count("*").alias("n"))
    seen = seen.orderBy(F.xxhash64("f1", "f2"), "f1", "f2", "y").limit(2 * fit_rows).toPandas()  # savings are few fractions; their hashes' order is free of size and label
    if len(seen) and seen["y"].nunique() > 1:
        w = fit_logistic(seen[["f1", "f2"]].to_numpy(float), seen["y"].to_numpy(float), seen["n"].to_numpy(float))
    else:
        w = np.array([0.0, 0.0, 0.0 if not len(seen) else (4.0 if seen["y"].iat[0] else -4.0)])
    out = document_savings(docs.select(F.col(id_col).alias("_id"), text.alias("text")), ["_id"], "text", one, two, widen, level)
    score = 1 / (1 + F.exp(-(F.lit(float(w[0])) * F.col("f1") + F.lit(float(w[1])) * F.col("f2") + F.lit(float(w[2])))))
    out = out.select(F.col("_id").alias(id_col), F.coalesce(fold("_id", folds) == held, F.lit(True)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
