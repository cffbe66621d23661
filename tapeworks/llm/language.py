"""Language identification by Bayesian evidence fusion.

Evidence on a text: its byte trigrams under each language's model, the language declared in its markup or record, the
suffix of its address, and a prior of its host, smoothed towards its domain and then towards all rows. The models of
the evidence come from grouped aggregation over all rows: trigram counts by declared language (a table of fixed size),
then, with the language that the trigrams alone favour, how often each language is declared as what, stands under
which suffix, and is found at which host and domain. A uniform model stands for text in none of the languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import written
from tapeworks.llm.textblock import LOWER, blocks

LANGUAGES = ("de", "en", "es", "fr")
NONE = "und"


def trigrams(raw: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of a block, and the text of each; a text of fewer than three bytes has none."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[raw].astype(np.uint32)
    code = low[:-2] | (low[1:-1] << np.uint32(8)) | (low[2:] << np.uint32(16))
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    good = row[:-2] == row[2:]
    return (code[good] >> np.uint32(32 - int(np.log2(buckets)))).astype(np.int64), row[:-2][good]


def trigram_model(rows: DataFrame, languages: tuple[str, ...], buckets: int) -> np.ndarray:
    """Log probabilities, one row per language and a uniform one; rows: declared, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            names = batch.column(0).to_pylist()
            own = np.array([languages.index(x) if x in languages else -1 for x in names])
            for a, b, raw, offs in blocks(batch.column(1)):
                code, row = trigrams(raw, offs, buckets)
                lang = own[a:b][row]
                use = lang >= 0
                total += np.bincount(lang[use] * buckets + code[use], minlength=total.size).reshape(total.shape)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(languages))), pa.array([x.astype("<i8").tobytes() for x in total], pa.binary())], ["k", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(buckets, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), "<i8")
        return pa.table({"k": table.column("k").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((len(languages) + 1, buckets))
    for row in rows.select("declared", "text").mapInArrow(run, "k long, counts binary").groupBy("k").applyInArrow(add, "k long, counts binary").collect():  # fixed size
        out[row["k"]] = np.frombuffer(row["counts"], "<i8")
    out[:-1] += 0.5
    out[-1] = 1
    return np.log(out / out.sum(1, keepdims=True))


def text_evidence(rows: DataFrame, model: np.ndarray, buckets: int, most: int) -> DataFrame:
    """rows without text, with n (trigrams) and ll (log likelihoods, trigrams beyond `most` weigh no more)."""
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in blocks(batch.column(len(keep))):
                code, row = trigrams(raw, offs, buckets)
                n = np.bincount(row, minlength=b - a)
                sums = np.stack([np.bincount(row, m[code], b - a) for m in model], 1)
                ll = sums / np.maximum(n, 1)[:, None] * np.minimum(n, most)[:, None] / 3
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, ll.size + 1, ll.shape[1], dtype=np.int32)), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), pa.array(n.astype(np.int64)), flat], [*keep, "n", "ll"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.select(*keep, "text").mapInArrow(run, f"{kinds}, n long, ll array<double>")


def best(scores: Column) -> Column:
    """Position (from 1) of the largest score, the first of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int")


def shares(found: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """Counts of each text-favoured language by `by`, as an array."""
    parts = [F.coalesce(F.sum(F.when(F.col("guess") == k + 1, 1).otherwise(0)), F.lit(0)).cast("double") for k in range(size)]
    return found.groupBy(*by).agg(F.array(*parts).alias(name))


def identify(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES, buckets: int = 1 << 14, most: int = 300, weight: float = 20.0, limit: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in carry, lang, posterior, text_lang, kept of every row of (id, text, declared, suffix, domain, host).

    kept is false where no language reaches `limit`, and where the text is in none of the languages. A text of fewer
    than three bytes (null, empty) has no evidence of its own and is not kept, whatever its host. Null or unknown
    declarations, suffixes and hosts count as values of their own. Repeated rows get equal results.
    """
    names = [*languages, NONE]
    k = len(names)
    declared = F.when(F.col("declared").isin(*languages), F.col("declared")).when(F.col("declared").isNull(), F.lit("")).otherwise(F.lit(NONE))
    rows = rows.withColumn("declared", declared).withColumn("suffix", F.coalesce("suffix", F.lit(""))).withColumn("domain", F.coalesce("domain", F.lit(""))).withColumn("host", F.coalesce("host", F.lit("")))
    model = trigram_model(rows, languages, buckets)
    found = text_evidence(rows, model, buckets, most).withColumn("guess", F.when(F.col("n") > 0, best(F.col("ll"))))
    found = written(found, "language-evidence")
    known = found.where("guess is not null")

    total = shares(known, [], k, "c").first()["c"]  # k numbers
    total = np.array(total or [0.0] * k) + 1.0
    prior = F.array(*[F.lit(float(x)) for x in total / total.sum()])
    sums = F.array(*[F.lit(float(x)) for x in total])
    by_declared = shares(known, ["declared"], k, "d")
    by_suffix = shares(known, ["suffix"], k, "s")
    by_domain = shares(known, ["domain"], k, "p").withColumn("p", smoothed(F.col("p"), prior, weight))
    by_host = shares(known, ["domain", "host"], k, "h")
    hosts = by_host.join(by_domain, "domain").select("domain", "host", smoothed(F.col("h"), F.col("p"), weight).alias("h"))
    out = found.join(by_declared, "declared", "left").join(by_suffix, "suffix", "left").join(hosts, ["domain", "host"], "left")

    def given(counts: Column) -> Column:
        """Log share of a value among each language's rows, with one row added to each side."""
        return F.zip_with(F.coalesce(counts, F.array(*[F.lit(0.0)] * k)), sums, lambda c, n: F.log((c + 0.5) / (n + 3.0)))

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    score = plus(plus(F.col("ll"), given(F.col("d"))), plus(given(F.col("s")), F.transform(F.coalesce("h", prior), lambda x: F.log(x))))
    out = out.withColumn("score", score).withColumn("top", F.array_max("score"))
    out = out.withColumn("lang", F.element_at(F.array(*map(F.lit, names)), best(F.col("score"))))
    out = out.withColumn("posterior", 1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    kept = (F.col("n") > 0) & (F.col("lang") != NONE) & (F.col("posterior") >= limit)
    return out.select("id", *carry, F.when(F.col("n") > 0, F.col("lang")).otherwise(NONE).alias("lang"), F.round("posterior", 6).alias("posterior"), F.element_at(F.array(*map(F.lit, names)), F.col("guess")).alias("text_lang"), kept.alias("kept"))


def smoothed(counts: Column, towards: Column, weight: float) -> Column:
    """Shares of the counts with `weight` more rows dealt as in `towards`."""
    n = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(counts, towards, lambda c, p: (c + p * F.lit(weight)) / (n + F.lit(weight)))


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Records: the declared language is a column, the host is the source, there is no address."""
    none = F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lower(F.substring(F.col(lang_col).cast("string"), 1, 2)).alias("declared"), none.alias("suffix"), none.alias("domain"), F.col(host_col).cast("string").alias("host"))


def page_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Web pages: visible text, the lang attribute of the html element, and suffix, domain and host of the address."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    host = F.when(host == "", None).otherwise(host)
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2})", 1))
    return pages.select(F.col(id_col).alias("id"), bare.alias("text"), F.when(declared == "", None).otherwise(declared).alias("declared"), F.element_at(F.split(host, r"\."), -1).alias("suffix"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), host.alias("host"))
