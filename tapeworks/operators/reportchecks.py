"""Checks of report texts: each is a function of documents (doc_id, text) to findings (doc_id, check, subject, detail), all of
it expressions and windows; and the same registry as a table function for LATERAL joins in SQL.

A document's lines are one window, its mentions one array, so that a long document costs its length. Before a pattern is
tried, a text is asked for plain strings without which the pattern cannot match; patterns run once over a text.
"""

from __future__ import annotations

import calendar
import datetime as dt
import functools
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

# Digits of usual prices, usual ratios of a future to its fund, spellings of one instrument, words of
# headings and tables of allocations, months, weekdays in both languages, and patterns.
PRICE_DIGITS = {"GLD": (2, 3), "GC": (3, 4), "SPY": (2, 3), "SPX": (4, 5), "VIX": (1, 2), "TLT": (2, 3), "SLV": (2, 2), "SI": (2, 2), "USO": (2, 2), "CL": (2, 3)}
RATIOS = {("GLD", "GC"): 15.0, ("SLV", "SI"): 2.3, ("USO", "CL"): 0.85, ("SPY", "SPX"): 10.0}
NOTATIONS = {
    "gold": ("Gold", "GLD", "GC", "金", "金先物", "ゴールド"), "sp500": ("S&P 500", "S&P500", "SPX", "SPY", "SP500"), "oil": ("WTI", "Crude", "CL", "USO", "原油"),
    "silver": ("Silver", "SLV", "SI", "銀"), "bonds": ("TLT", "10Y", "10年債", "米国債"), "vix": ("VIX", "恐怖指数"),
}
HEADING_WORDS = ("配分", "アロケーション", "allocation", "セクター配分", "asset allocation")
TABLE_WORDS = ("配分", "allocation", "ウェイト", "weight", "比率", "ratio", "目安比率")
MONTHS = {name.lower(): i for i in range(1, 13) for name in (calendar.month_name[i], calendar.month_abbr[i])}
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
WEEKDAYS_JA = "月火水木金土日"
MENTION = r"(?:^|[\s(])(" + "|".join(sorted(PRICE_DIGITS, key=len, reverse=True)) + r")(?=[)\s:,][\s\S]{0,80}?\$([0-9,]+(?:\.[0-9]+)?))"
DATES = {  # pattern, and the groups of month, day, year (0: none) and weekday
    "year": (r"\b([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})\s*\((\w+)\)", (1, 2, 3, 4)), "no_year": (r"\b([A-Za-z]+)\s+(\d{1,2})\s*\((\w+)\)", (1, 2, 0, 3)),
    "kanji": (r"(\d{1,2})月(\d{1,2})日[（(]([月火水木金土日])(?:曜日)?[）)]", (1, 2, 0, 3)), "slash": (r"(\d{1,2})/(\d{1,2})[（(]([月火水木金土日])[）)]", (1, 2, 0, 3)),
}
BRACKET = r"\d\s*\("
YEAR_IN_TEXT = r"(?:^|\D)(20[23]\d)(?:\D|$)"
PERCENT = r"(\d+(?:\.\d+)?)(?:\s*[-~]\s*(\d+(?:\.\d+)?))?\s*%"
BP, PCT_RATE = r"(?i)\d+\s*bp", r"(?i)(?:yield|rate|利回り|金利).*?\d+(?:\.\d+)?%"
INSTRUMENT, MOVEMENT = r"(?i)\b(?:Gold|Silver|Oil|Crude|WTI|SPY|SPX|VIX|GLD|GC|TLT|SLV|USO|CL|SI)\b", r"(?i)\b(?:moved|rose|fell|dropped|gained|lost|up|down|changed|increased|decreased)\b"
NUMBER, UNIT = r"\b\d+(?:\.\d+)?\b", r"(?i)(?:\$\d|\d\s*%|\d\s*bps?)"


def _any(text: Column, parts: Iterable[str]) -> Column:
    """The text holds one of the parts."""
    return functools.reduce(lambda a, b: a | b, [text.contains(x) for x in parts])


def _finding(name: str, subject: Column, detail: Column) -> list[Column]:
    return [F.col("doc_id"), F.lit(name).alias("check"), subject.alias("subject"), detail.alias("detail")]


def price_scale_check(docs: DataFrame) -> DataFrame:
    """A price within 80 characters of a ticker with an unusual number of digits; and for each mention of a fund beside one
    of its future, the ratio farthest off, where it is off by more than half."""
    text = F.col("text")
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(MENTION), F.lit(1)).alias("t"), F.regexp_extract_all("text", F.lit(MENTION), F.lit(2)).alias("p"))
    priced = F.transform(both, lambda m: F.struct(m["t"].alias("ticker"), F.regexp_replace(m["p"], ",", "").try_cast("double").alias("price")))
    docs = docs.where(text.contains("$") & _any(text, PRICE_DIGITS)).select("doc_id", F.filter(priced, lambda m: m["price"] > 0).alias("seen"))
    of = lambda future: F.transform(F.filter("seen", lambda m: m["ticker"] == future), lambda m: m["price"])
    ends = F.array(*[F.struct(F.lit(fund).alias("fund"), F.lit(future).alias("future"), F.lit(usual).alias("usual"), F.array_min(of(future)).alias("least"), F.array_max(of(future)).alias("most")) for (fund, future), usual in RATIOS.items()]).cast("array<struct<fund string, future string, usual double, least double, most double>>")
    rows = docs.select("doc_id", F.explode_outer("seen").alias("m"), ends.alias("ends")).where("m is not null").select("doc_id", "m.*", "ends")
    rows = rows.withColumn("e", F.get(F.filter("ends", lambda e: (e["fund"] == F.col("ticker")) & e["least"].isNotNull()), F.lit(0)))
    limits = {k: F.element_at(F.create_map(*[F.lit(x) for t, v in PRICE_DIGITS.items() for x in (t, v[i])]), F.col("ticker")) for i, k in enumerate(("lo", "hi"))}
    rows = rows.select("doc_id", "ticker", F.length(F.floor("price").cast("string")).alias("digits"), limits["lo"].alias("few"), limits["hi"].alias("many"), "e.future", "e.usual", (F.col("e.least") / F.col("price")).alias("lo"), (F.col("e.most") / F.col("price")).alias("hi"))
    worst = F.when(F.col("hi") - F.col("usual") >= F.col("usual") - F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    rows = rows.withColumn("worst", worst)
    odd = F.when((F.col("digits") < F.col("few")) | (F.col("digits") > F.col("many")), F.struct(F.col("ticker").alias("subject"), F.col("digits").cast("string").alias("detail")))
    off = F.when(F.abs(F.col("worst") - F.col("usual")) / F.col("usual") > 0.5, F.struct(F.concat_ws("/", "future", "ticker").alias("subject"), F.format_string("%.1f", "worst").alias("detail")))
    found = rows.select("doc_id", F.explode_outer(F.array_compact(F.array(odd, off))).alias("x")).where("x is not null")
    return found.select(*_finding("price_scale", F.col("x.subject"), F.col("x.detail")))


def _spelling(form: str) -> str:
    return ("(?i)" if len(form) > 3 else "") + r"(?<!\w)" + re.escape(form) + r"(?!\w)"


def _part(form: str) -> str | None:
    """What a text holds, but for the case of ASCII letters, wherever the spelling matches; None where case counts or is
    none. The letters s, k and i are left out, as they also match others (long s, the sign of kelvin, the Turkish ones)."""
    return max(re.split("[ski]", form.lower()), key=len) if len(form) > 3 and form.lower() != form.upper() else None


def mixed_notation_check(docs: DataFrame) -> DataFrame:
    """More than one spelling of one instrument in a document."""
    parts = {form: re.escape(part) for forms in NOTATIONS.values() for form in forms if (part := _part(form))}
    out, docs = [], docs.select("doc_id", "text", F.col("text").rlike("(?i)" + "|".join(parts.values())).alias("loose"))
    for name, forms in NOTATIONS.items():
        held = {form: F.col("loose") & F.col("text").rlike("(?i)" + parts[form]) if form in parts else F.col("text").contains(form) for form in forms}
        hits = F.array_compact(F.array(*[F.when(held[form] & F.col("text").rlike("(?U)" + _spelling(form)), F.lit(form)) for form in forms]))
        out.append(F.when(F.size(hits) > 1, F.struct(F.lit(name).alias("subject"), F.array_join(hits, ", ").alias("detail"))))
    rows = docs.select("doc_id", F.explode_outer(F.array_compact(F.array(*out))).alias("x")).where("x is not null")
    return rows.select(*_finding("notation", F.col("x.subject"), F.col("x.detail")))


def weekday_mismatch_check(docs: DataFrame, as_of: str | None = None, year: int | None = None) -> DataFrame:
    """A date whose weekday disagrees with the calendar, in English with or without a year and in Japanese without.

    A missing year is that of `as_of` that brings the month nearest; without it the first year 2020 to 2039 in the text,
    else `year` (this year). Dates that do not exist and words that are no weekday are passed over.
    """
    month_of = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    stated_of = F.create_map(*[F.lit(x) for i in range(7) for x in (WEEKDAYS[i], i, WEEKDAYS_JA[i], i)])
    text, none, parts = F.col("text"), F.array().cast("array<string>"), []
    before = {"year": text.rlike(BRACKET), "no_year": text.rlike(BRACKET), "kanji": text.contains("月"), "slash": text.contains("/")}
    for kind, (pattern, _) in DATES.items():
        said = F.when(before[kind], F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        parts.append(F.transform(said, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("said"))))  # noqa: B023
    docs = docs.where(_any(text, "(（"))
    rows = docs.select("doc_id", F.regexp_extract("text", YEAR_IN_TEXT, 1).alias("in_text"), F.explode_outer(F.concat(*parts)).alias("x")).where("x is not null").select("doc_id", "in_text", "x.*")
    # a date said matches its pattern alone as it does within the text, so its groups are taken from it
    for i, name in enumerate("mdyw"):
        of = [F.when(F.col("kind") == kind, F.regexp_extract("said", pattern, groups[i]) if groups[i] else F.lit("")) for kind, (pattern, groups) in DATES.items()]
        rows = rows.withColumn(name, F.coalesce(*of))
    month = F.coalesce(F.col("m").try_cast("int"), F.try_element_at(month_of, F.lower("m")))
    rows = rows.withColumn("month", month).where("month is not null")
    if as_of:
        base, at = int(as_of[:4]), int(as_of[5:7])
        inferred = F.lit(base) + F.when(F.col("month") - at < -6, 1).when(F.col("month") - at > 6, -1).otherwise(0)
    else:
        inferred = F.coalesce(F.col("in_text").try_cast("int"), F.lit(year or dt.date.today().year))
    day = F.try_to_date(F.concat_ws("-", F.coalesce(F.col("y").try_cast("int"), inferred), "month", "d"), "y-M-d")
    stated = F.try_element_at(stated_of, F.lower(F.substring("w", 1, 3)))
    rows = rows.withColumn("day", day).withColumn("stated", stated).where("day is not null and stated is not null")
    return rows.where(F.weekday("day") != F.col("stated")).select(*_finding("dates", F.col("said"), F.date_format("day", "yyyy-MM-dd EEE")))


def allocation_sum_check(docs: DataFrame) -> DataFrame:
    """Sections under a heading of allocations (up to the next heading) and tables with a header of weights, two
    percentages or more: fixed ones that do not add up to 100 +- 0.5, or ranges that do not hold 100 +- 0.5."""
    text, low, line = F.col("text"), F.lower("text"), F.col("line")
    docs = docs.where(_any(text, "%％") & ((text.contains("#") & low.rlike("|".join(HEADING_WORDS))) | (text.contains("|") & low.rlike("|".join(TABLE_WORDS)))))
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.translate("line", "％〜–—", "%~--"))
    title, none = F.lower("line"), F.array().cast("array<string>")
    wanted = title.rlike("|".join(HEADING_WORDS)) & ~(title.contains("ポジション") & ~title.contains("配分"))
    lo, hi = (F.when(line.contains("%"), F.regexp_extract_all("line", F.lit(PERCENT), F.lit(k))).otherwise(none) for k in (1, 2))
    head, bar = line.rlike(r"^#{1,6}\s"), line.contains("|")
    lines = lines.select("doc_id", "i", head.alias("head"), bar.alias("bar"), (head & wanted).alias("wanted"), (bar & title.rlike("|".join(TABLE_WORDS))).alias("weights"), lo.alias("lo"), hi.alias("hi"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))
    rows = lines.select("doc_id", "i", "head", "bar", "wanted", "weights", F.size("lo").alias("n"), total(F.col("lo")).alias("a"), total(F.zip_with("lo", "hi", lambda a, b: F.when(b == "", a).otherwise(b))).alias("b"))
    # only these numbers are dealt out by document
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("of", F.last(F.when(F.col("head"), F.when(F.col("wanted"), F.col("i")).otherwise(-1)), ignorenulls=True).over(w)).withColumn("run", F.sum(F.when(F.col("bar"), 0).otherwise(1)).over(w))
    rows = rows.withColumn("top", F.first(F.when(F.col("bar"), F.col("weights")), ignorenulls=True).over(Window.partitionBy("doc_id", "run").orderBy("i")))
    under, within = (F.col("of") >= 0) & ~F.col("head"), F.col("bar") & F.col("top")
    parts = F.array(*[F.when(use, F.struct(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("k"))) for kind, use, key in (("heading", under, "of"), ("table", within, "run"))])
    rows = rows.where("n > 0").select("doc_id", "n", "a", "b", F.explode(F.array_compact(parts)).alias("p")).select("doc_id", "p.kind", "p.k", "n", "a", "b")
    sums = rows.groupBy("doc_id", "kind", "k").agg(*[F.sum(c).alias(c) for c in "nab"])
    fixed = F.abs(F.col("a") - F.col("b")) < 0.01
    bad = F.when(fixed, F.abs(F.col("a") - 100) > 0.5).otherwise((F.col("a") > 100.5) | (F.col("b") < 99.5))
    found = sums.where((F.col("n") > 1) & bad)
    return found.select(*_finding("allocations", F.col("kind"), F.when(fixed, F.format_string("%.2f", "a")).otherwise(F.format_string("%.2f-%.2f", "a", "b"))))


def unit_check(docs: DataFrame) -> DataFrame:
    """Basis points beside rates in % in one document; and lines with an instrument, a word of movement and a number, but no
    unit."""
    text = F.col("text")
    mixed = docs.where(text.contains("%") & text.rlike(BP) & text.rlike(PCT_RATE)).select(*_finding("units", F.lit("mixed"), F.lit("")))
    lines = docs.where(text.rlike(INSTRUMENT) & text.rlike(MOVEMENT)).select("doc_id", F.explode_outer(F.split("text", "\n")).alias("line"))
    bare = lines.where(F.col("line").rlike(INSTRUMENT) & F.col("line").rlike(MOVEMENT) & F.col("line").rlike(NUMBER) & ~F.col("line").rlike(UNIT))
    return mixed.unionByName(bare.select(*_finding("units", F.lit("bare"), F.trim("line"))))


CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {"price_scale": price_scale_check, "notation": mixed_notation_check, "dates": weekday_mismatch_check, "allocations": allocation_sum_check, "units": unit_check}


def findings(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """All findings of the chosen checks; a null text has none."""
    out = None
    for name in names or list(CHECKS):
        one = CHECKS[name](docs)
        out = one if out is None else out.unionByName(one)
    return out


def run_checks(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """doc_id, check, n: findings of the chosen checks on every document, 0 where there are none."""
    every = docs.select("doc_id", F.explode(F.array(*map(F.lit, names or list(CHECKS)))).alias("check"))
    found = findings(docs, names).groupBy("doc_id", "check").agg(F.count("*").alias("n"))
    return every.join(found, ["doc_id", "check"], "left").select("doc_id", "check", F.coalesce("n", F.lit(0)).alias("n"))


def _prices(text: str) -> Iterator[tuple[str, str]]:
    if "$" not in text or not any(x in text for x in PRICE_DIGITS):
        return
    seen = [(m[1], float(m[2].replace(",", "") or 0)) for m in re.finditer(MENTION, text)]
    seen = [(t, p) for t, p in seen if p > 0]
    for t, p in seen:
        if not PRICE_DIGITS[t][0] <= len(str(int(p))) <= PRICE_DIGITS[t][1]:
            yield t, str(len(str(int(p))))
    for (fund, future), usual in RATIOS.items():
        ends = [p for t, p in seen if t == future]
        for p in (p for t, p in seen if ends and t == fund):
            worst = max((max(ends) / p, min(ends) / p), key=lambda r: abs(r - usual))
            if abs(worst - usual) / usual > 0.5:
                yield f"{future}/{fund}", f"{worst:.1f}"


#: Of each spelling: its part in lower case or itself, and its pattern.
_SPELLINGS = {form: (_part(form), re.compile(_spelling(form))) for forms in NOTATIONS.values() for form in forms}


def _notations(text: str) -> Iterator[tuple[str, str]]:
    low = text.lower()
    for name, forms in NOTATIONS.items():
        hits = []
        for form in forms:
            part, pattern = _SPELLINGS[form]
            if (part in low if part else form in text) and pattern.search(text):
                hits.append(form)
        if len(hits) > 1:
            yield name, ", ".join(hits)


def _weekdays(text: str) -> Iterator[tuple[str, str]]:
    if "(" not in text and "（" not in text:
        return
    found, bracket = re.search(YEAR_IN_TEXT, text), re.search(BRACKET, text)
    before = {"year": bracket, "no_year": bracket, "kanji": "月" in text, "slash": "/" in text}
    for kind, (pattern, (m, d, y, w)) in DATES.items():
        for hit in re.finditer(pattern, text) if before[kind] else ():
            month = int(hit[m]) if hit[m].isdigit() else MONTHS.get(hit[m].lower())
            word = hit[w].lower()[:3]
            stated = WEEKDAYS.index(word) if word in WEEKDAYS else WEEKDAYS_JA.find(word)
            try:
                day = dt.date(int(hit[y]) if y else int(found[1]) if found else dt.date.today().year, month or 0, int(hit[d]))
            except ValueError:
                continue
            if stated >= 0 and day.weekday() != stated:
                yield hit[0], f"{day} {calendar.day_abbr[day.weekday()]}"


def _allocations(text: str) -> Iterator[tuple[str, str]]:
    if "%" not in text and "％" not in text:
        return
    sections: list[tuple[str, list[str]]] = []
    heading = table = None
    for line in text.translate(str.maketrans("％〜–—", "%~--")).split("\n"):
        low = line.lower()
        if re.match(r"#{1,6}\s", line):
            on = any(w in low for w in HEADING_WORDS) and not ("ポジション" in low and "配分" not in low)
            heading = ("heading", []) if on else None
            sections += [heading] if on else []
        elif heading:
            heading[1].append(line)
        if "|" not in line:
            table = None
        elif table is None:
            table = ("table" if any(w in low for w in TABLE_WORDS) else "", [line])
            sections += [table] if table[0] else []
        else:
            table[1].append(line)
    for kind, lines in sections:
        pairs = [(float(a), float(b or a)) for line in lines if "%" in line for a, b in re.findall(PERCENT, line)]
        lo, hi = (sum(x[k] for x in pairs) for k in (0, 1))
        if len(pairs) > 1 and abs(lo - hi) < 0.01 and abs(lo - 100) > 0.5:
            yield kind, f"{lo:.2f}"
        elif len(pairs) > 1 and abs(lo - hi) >= 0.01 and (lo > 100.5 or hi < 99.5):
            yield kind, f"{lo:.2f}-{hi:.2f}"


_MOVEMENT = re.compile(MOVEMENT)


def _units(text: str) -> Iterator[tuple[str, str]]:
    if "%" in text and re.search(BP, text) and re.search(PCT_RATE, text):
        yield "mixed", ""
    at = 0
    while moved := _MOVEMENT.search(text, at):  # one pass over the text; each line with a movement is looked at once
        at = text.find("\n", moved.end()) + 1 or len(text)
        line = text[text.rfind("\n", 0, moved.start()) + 1 : at].removesuffix("\n")
        if re.search(INSTRUMENT, line) and re.search(NUMBER, line) and not re.search(UNIT, line):
            yield "bare", line.strip(" ")


_BY_TEXT: dict[str, Callable[[str], Iterator[tuple[str, str]]]] = {"price_scale": _prices, "notation": _notations, "dates": _weekdays, "allocations": _allocations, "units": _units}


class ReportChecks:
    """report_checks(text[, names]): the registry as a table function; names is a constant array of checks, all without it.

    The same findings as findings(), a text at a time; for large tables findings() stays in the JVM.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, names: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.dataType != StringType():
            raise ValueError("report_checks: the first argument is the text")
        unknown = set((names and names.value) or ()) - set(_BY_TEXT)
        if (names and not names.isConstantExpression) or unknown:
            raise ValueError(f"report_checks: names is a constant array of {sorted(_BY_TEXT)}")
        return AnalyzeResult(StructType().add("check", StringType()).add("subject", StringType()).add("detail", StringType()))

    def eval(self, text: str | None, names: list[str] | None = None) -> Iterator[tuple[str, str, str]]:
        for name in names or list(_BY_TEXT):
            for subject, detail in _BY_TEXT[name](text or ""):
                yield name, subject, detail


def register(spark: SparkSession) -> None:
    """Make report_checks known to the session's SQL."""
    spark.udtf.register("report_checks", F.udtf(ReportChecks))
