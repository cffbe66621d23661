"""The corpus operators against brute force, exact round trips and held-out accuracy, with nulls, ties, repeats, empty
tables and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import jaccard, language, licenses, media, mixing, packing, quality_model, quality_rules, shared, suffix_dedup, textblock, toxicity
from tapeworks.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, th string, component string, key string"
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def sentence(n: int, rng: random.Random) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], None, 1, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def corpus() -> list[str | None]:
    rng = random.Random(11)
    texts: list[str | None] = []
    passage = sentence(45, rng)
    for _ in range(25):
        base = sentence(rng.randint(30, 160), rng)
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            w = base.split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), sentence(20, rng) + " " + passage + " " + sentence(30, rng), passage + "\n" + sentence(9, rng), None, "", "  \n\t ", "one", "one", "One two", "one two", "ü é ñ ü é ñ", "x" * 700, "x" * 450, sentence(9000, rng)]
    return texts


TEXTS = corpus()


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


@pytest.mark.parametrize(("n", "num", "den", "block"), [(3, 90, 100, 512), (5, 80, 100, 3)])
def test_jaccard_components(spark, n, num, den, block):
    sets = [shingles(t, n) for t in TEXTS]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = jaccard.ngram_jaccard_join(frame(spark, TEXTS), n=n, num=num, den=den, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_without_ids_and_rows(spark):
    df = frame(spark, ["a b c d", "a b c d", "q r s t"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.ngram_jaccard_join(df, n=3, num=9, den=10).collect()) == [(-1, 1), (1, 1), (2, 2)]
    assert jaccard.ngram_jaccard_join(df.limit(0)).count() == 0


def test_disjoint_sets_do_not_link():
    child, _ = jaccard.overlap_links([np.array([1, 2], np.uint64), np.array([3, 4], np.uint64)], 8, 10)
    assert len(child) == 0


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in shared.connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_words_and_hashes():
    raw = np.frombuffer("ab  cd\tab".encode() + "ef".encode(), np.uint8)
    w = textblock.Words(raw, np.array([0, 9, 9, 11]))
    assert w.bytes_of(np.arange(4)) == [b"ab", b"cd", b"ab", b"ef"] and w.first.tolist() == [0, 3, 3, 4]
    h = w.hashes()
    assert h[0] == h[2] != h[1]


@pytest.mark.parametrize("hot", [2048, 2])
def test_repeated_bytes(spark, hot, monkeypatch):
    length = 200
    raw = [(t or "").encode() for t in TEXTS]
    count = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    want = {}
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        rest = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        want[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest())
    original = suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda d, c, n: original(d, c, n, hot=hot))
    got = suffix_dedup.remove_repeats(frame(spark, TEXTS)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert any(v[1] for v in want.values())
    kept = suffix_dedup.remove_repeats(frame(spark, TEXTS), carry=["lang", "source"]).where("n_removed = 0").collect()
    assert all(r.kept == (TEXTS[r.doc_id] or "") for r in kept)
    assert suffix_dedup.remove_repeats(frame(spark, ["a"]).limit(0)).count() == 0


def brute_repeats(raw: list[bytes], length: int):
    count = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = {}
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        rest = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[i] = (sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest())
    return out


def test_buckets_that_all_settle(spark):
    """Passages of 60 to 199 shared bytes open buckets in which nothing is repeated to full depth."""
    rng = random.Random(5)
    shared_part = sentence(60, rng)
    texts = [sentence(30, rng) + shared_part[:n] + sentence(40, rng) for n in (60, 90, 120, 150, 180, 198, 60, 90)]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert got == brute_repeats([t.encode() for t in texts], 200) and not any(v[0] for v in got.values())
    first, last = suffix_dedup.runs(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(first) == len(last) == 0


@pytest.mark.parametrize("length", [31, 130, 420])
def test_repeats_of_other_lengths(spark, length):
    texts = TEXTS[:60] + ["x" * 900, "ab" * 300, TEXTS[3] + "\n" + TEXTS[3]]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, texts), length=length).collect()}
    assert got == brute_repeats([(t or "").encode() for t in texts], length)


def test_bucket_pointers_against_sorted_suffixes():
    """Windows are shared after the last round exactly if their bytes occur twice, whatever the depth's doubling does."""
    rng = np.random.default_rng(2)
    for length, gram in ((200, 50), (70, 32), (9, 9), (45, 4)):
        bodies = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in rng.integers(length, 3 * length, 12)]
        bodies += [bodies[0][3:] + b"c", b"a" * (length + 40)]
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
        name = np.append(suffix_dedup.gram_names(raw, gram), np.zeros(gram - 1, np.uint64))
        windows, again = suffix_dedup.refine(name, offs[:-1], offs[1:], length, gram)
        text = raw.tobytes()
        count = Counter(text[w : w + length] for w in windows)
        assert again.tolist() == [count[text[w : w + length]] > 1 for w in windows] and again.any()


def test_media_round_trip(spark, tmp_path):
    from pathlib import Path

    out = media.media_columns(frame(spark, TEXTS)).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        payload = media.pad((TEXTS[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.width, r.height, r.depth) == (64, len(payload) // 64, 8)
    shard = media.unpack(Path(out[0].shard).read_bytes())
    assert all(hashlib.sha256(media.decode(m)).hexdigest() == name for name, m in shard.items())
    heads = media.read_members(media.store(frame(spark, ["a", "a", None])), bodies=False).collect()
    assert len(heads) == 2 and all(r.payload_sha256 is None and r.media_bytes > 0 for r in heads)


def test_mixing(spark):
    rng = random.Random(1)
    texts = [sentence(rng.randint(1, 60), rng) for _ in range(200)] + [None, ""]
    df = frame(spark, texts, ["b", "a", "c", None, "b", "b"])
    got = mixing.mix_sources(df).collect()
    sizes = {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in got} == sizes
    taken, target = defaultdict(int), {}
    for r in got:
        s = ["b", "a", "c", None, "b", "b"][r.doc_id % 6]
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        target[s] = (r.target, r.source_size)
    assert all(taken[s] == int(t) for s, (t, _) in target.items())
    assert sum(t for t, _ in target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    free = [t / w for (t, n), w in ((target["a"], 3), (target["b"], 1), (target["c"], 2), (target[None], 3)) if t < 2 * n]
    assert max(free) == pytest.approx(min(free))
    assert sorted((r.doc_id, r.taken) for r in mixing.mix_sources(df.repartition(3)).collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_quality_rules(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 5000] + ["a b c d e f a b c d e g h i j", "l one\nl one\n\nl two $#", "a a a a a a a a a a a a"]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, texts, ["s", None])).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w)) and r.kept == (not r.base_failed)
    bad = frame(spark, ["few"] * 60 + [sentence(40, random.Random(2))] * 3, ["s"])
    assert quality_rules.quality_rules(bad).where("kept").count() == 0
    assert quality_rules.quality_rules(bad.limit(0)).count() == 0
    again = quality_rules.quality_rules(bad.union(bad).withColumn("doc_id", F.lit(None).cast("long")))
    assert again.count() == 126


def test_host_rules_one_by_one(spark):
    """A host falls by the rate of one rule that fails no document by itself; each rule has a prior of its own."""
    rng = random.Random(7)
    clean = [sentence(40, rng) for _ in range(90)]
    odd = [sentence(40, rng) + " # $ % & | < >" for _ in range(30)]
    texts = [x for k in range(30) for x in (*clean[3 * k : 3 * k + 3], odd[k])]
    df = frame(spark, texts, ["a", "b", "c", "d"])
    got = quality_rules.quality_rules(df).join(df.select("doc_id", "source"), "doc_id").collect()
    assert all(not r.base_failed for r in got) and {r.source for r in got if not r.kept} == {"d"} == {r.source for r in got} - {r.source for r in got if r.kept}
    rates = {r.host: r for r in quality_rules.host_verdicts(quality_rules.document_rules(df)).collect()}
    for rule, fails in (("symbols", {"a": 0, "b": 0, "c": 0, "d": 30}), ("short", dict.fromkeys("abcd", 0))):
        mean = sum(fails.values()) / 120
        spread = sum(f * f / 30 for f in fails.values()) / 120 - mean * mean
        weight = min(max(mean * (1 - mean) / spread - 1, 1), 10_000) if spread > 1e-12 else 10_000
        assert all(rates[h][f"{rule}_rate"] == pytest.approx((f + mean * weight) / (30 + weight)) for h, f in fails.items())


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [*TEXTS, "don't <|endoftext|> x1y22 naïve — “quoted”, ﬁne é ½ 你好 a", "A,b;C 3.14%"]
    got = packing.pack_documents(frame(spark, texts), path, group_pieces=40).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_first_fit_decreasing():
    sizes = np.random.default_rng(4).integers(1, 4097, 500)
    where, _ = packing.first_fit_decreasing(sizes, 4096)
    room: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, x in enumerate(room) if x >= sizes[i]), len(room))
        if k == len(room):
            room.append(4096)
        room[k] -= int(sizes[i])
        assert where[i] == k


def labelled(spark, n=1500):
    rng = random.Random(8)
    texts, marks = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        w = [rng.choice(VOCABULARY) for _ in range(rng.randint(20, 60))]
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["zorkful", "blimpish", "quaxer", "vexorious"])
        texts.append(" ".join(x + "###" for x in w) if junk else " ".join(w))
        marks.append((i, int(not junk), int(toxic)))
    return frame(spark, texts), spark.createDataFrame([*marks, (None, 1, 1), (n + 5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_and_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    tox = toxicity.toxicity(docs.union(frame(spark, [None]).withColumn("doc_id", F.lit(None).cast("long"))), labels).collect()
    assert len(tox) == 1501 and all(0 <= r.score <= 1 for r in tox)
    held = [r for r in tox if r.held_out and r.doc_id is not None]
    assert {r.doc_id for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id].toxic for r in held]) > 0.97
    qual = [r for r in quality_model.quality_scores(docs, labels).collect() if r.held_out]
    assert {r.doc_id for r in qual} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in qual]) > 0.95
    none = labels.limit(0)
    assert toxicity.toxicity(docs.limit(3), none).count() == 3 and quality_model.quality_scores(docs.limit(3), none).first().score == 0.5
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and quality_model.quality_scores(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality_model.quality_scores])
def test_repeated_labelled_ids_do_not_crowd_out_a_label(spark, operator):
    """Each labelled id has eight rows, and more rows than the fit's bound: both labels must still reach the fit."""
    docs, labels = labelled(spark, 600)
    many = docs.crossJoin(spark.range(8).select("id")).withColumn("text", F.concat("text", F.lit(" x"), F.col("id").cast("string"))).select(*docs.columns)
    truth = {r.doc_id: r for r in labels.collect()}
    field = "toxic" if operator is toxicity.toxicity else "quality"
    held = [r for r in operator(many, labels, fit_rows=480).collect() if r.held_out]
    assert len(held) >= 8 * 90 and np.mean([r.predicted == truth[r.doc_id][field] for r in held]) > 0.95


def test_toxicity_learns_rare_and_short_words(spark):
    """A toxic word in a fiftieth of the commonest one's documents, and three-letter ones, mark held-out documents too."""
    rng = random.Random(9)
    rows = []
    for i in range(6000):
        mark = "zorkful" if i % 4 == 0 else {1: "blimpish", 5: "ÄXQ", 9: "zqx"}.get(i % 240)
        w = [rng.choice(VOCABULARY) for _ in range(20)]
        rows.append((i, " ".join([*w[:9], mark, *w[9:]] if mark else w), int(mark is not None), mark))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int, mark string")
    words, _ = toxicity.learn_words(data.select(toxicity.lowered(F.col("text")).alias("text"), F.col("toxic").alias("y")))
    assert set(words) == {"zorkful", "blimpish", "äxq", "zqx"}
    got = toxicity.toxicity(data, data).where("held_out").join(data, "doc_id").collect()
    assert len({r.mark for r in got}) == 5 and all(r.predicted == r.toxic for r in got)


def test_language(spark):
    words = {"de": "der die und nicht ein schön über", "en": "the and that with from this have", "es": "el que los para con una año", "fr": "le les que des pour dans été"}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(30)), k, "host", "example.com", "com") for i, k in enumerate(rng.choices(list(words), k=200))]
    rows += [(900, None, "en", "host", "example.com", "com"), (901, "чужой текст на другом языке, совсем другом", None, None, None, None), (902, rows[0][1], None, "new", None, "org")]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string")
    got = {r.id: r for r in language.identify(df).collect()}
    assert all(got[i].lang == k and got[i].kept for i, _, k, *_ in rows[:200])
    assert not got[900].kept and not got[901].kept and got[902].lang == rows[0][2]
    page = language.page_rows(spark.createDataFrame([(1, "https://www.a.example.de:80/x", '<HTML dir="l" LANG=fr-CA><script>x</script><p>Bon<b>jour</b></p>'), (2, None, None)], "page_id long, url string, html string")).collect()
    assert (page[0].host, page[0].suffix, page[0].domain, page[0].declared) == ("www.a.example.de", "de", "example.de", "fr") and "x" not in page[0].text and page[1].host is None
    assert language.identify(df.limit(0)).count() == 0


def test_language_with_declarations_withheld(spark):
    """On rows whose declaration is withheld, the label is no input: text alone and fused evidence against it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 0
    rows = language.document_rows(docs)
    found = language.identify(rows.withColumn("declared", F.when(~held, F.col("declared")))).where(held).join(rows.select("id", F.col("declared").alias("truth")), "id")
    got = found.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("truth")).cast("int")).alias("fused"), F.avg((F.col("text_lang") == F.col("truth")).cast("int")).alias("text")).first()
    assert got.n > 150 and got.fused >= 0.99 and got.text >= 0.99
    twice = rows.where("id < 5").union(rows.where("id < 5")).withColumn("th", F.lit(1)).withColumn("lang", F.lit("xx"))
    assert language.identify(twice).count() == 2 * rows.where("id < 5").count()


def test_packing_spreads_repeated_rows(spark):
    path = tokenizer_path("word_bpe_49k.json")
    df = frame(spark, ["one two three"]).crossJoin(spark.range(300).select("id")).drop("id")
    got = packing.pack_documents(df, path, group_pieces=40).collect()
    groups = Counter(r.sequence_id >> 32 for r in got)
    assert len(got) == 300 and len(groups) > 4 and max(groups.values()) < 150
    assert packing.pack_documents(df.limit(0), path).count() == 0
    assert packing.cuts_agree(path)


def test_media_edges(spark):
    df = frame(spark, ["a", None, "b" * 70000]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    got = {(r.doc_id, r.n_bytes): r for r in media.media_columns(df.union(df)).collect()}
    assert set(got) == {(None, 1), (1, 0), (2, 70000)} and media.media_columns(df.union(df)).count() == 6
    for r in got.values():
        assert media.describe(media.pad({1: b"a", 0: b"", 70000: b"b" * 70000}[r.n_bytes]), r.height) == r.feature and r.media_bytes > 0
    assert media.media_columns(df.limit(0)).count() == 0


def test_licenses(spark):
    body = sentence(300, random.Random(6))
    texts = [body + "\nReleased under the MIT License.\n" + body, body, None, "Licensed under the apache license version 2.0", "licensed under nothing", "All rights reserved. All rights reserved.", "Permission is hereby granted, free of charge, to any human obtaining a copy of this software and associated documentation files"]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert [got[i].license for i in range(7)] == ["mit", None, None, "apache-2.0", None, "all-rights-reserved", "mit"]
    assert got[0].coverage == 1.0 and got[0].first_word == 300 and got[0].end_word == 305 and got[5].n_notices == 2 and got[6].coverage < 1
    a, b = [1, 2, 3, 9, 4, 5, 6, 7], [1, 3, 2, 4, 5, 8, 7]
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs, key=lambda p: p[1]) and len(pairs) == 5
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])


def test_whole_license_texts(spark):
    from tapeworks.llm.license_texts import TEXTS

    cut = {k: " ".join(t.split()[: int(0.95 * len(t.split()))]) for k, t in TEXTS.items()}
    texts = [f"Copyright 2020 Someone {t} and more" for t in TEXTS.values()] + list(cut.values()) + [TEXTS["mit"] + " " + TEXTS["zlib"]] + ["words " * 5000 + TEXTS["isc"]] * 2
    got = licenses.license_scan(frame(spark, texts)).orderBy("doc_id").collect()
    names = list(TEXTS)
    assert [r.license for r in got[: len(names)]] == names and [r.license for r in got[len(names) : 2 * len(names)]] == names
    assert all(r.n_notices == 1 for r in got[: 2 * len(names)]) and all(r.coverage < 1 for r in got[len(names) : 2 * len(names)] if len(TEXTS[r.license]) > 400)
    assert got[-3].licenses == ["mit", "zlib"] and got[-1].license == got[-2].license == "isc" and got[-1].first_word == 5000
    assert licenses.license_scan(frame(spark, ["a"]).limit(0)).count() == 0


def test_license_variants(spark):
    gnu = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    texts = {
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License": "cc-by-3.0",
        "This work is licensed under the GNU General Public License, version 2": "gpl-2.0", gnu.format("program", "General Public", "2"): "gpl-2.0", gnu.format("program", "General Public", "3"): "gpl-3.0",
        gnu.format("library", "Lesser General Public", "2.1"): "lgpl-2.1", gnu.format("program", "Lesser General Public", "3"): "lgpl-3.0", gnu.format("program", "Affero General Public", "3"): "agpl-3.0",
        licenses._BSD_2: "bsd-2-clause", licenses._BSD_3: "bsd-3-clause", licenses._BSD: "bsd", "This is free and unencumbered software released into the public domain.": "unlicense",
    }
    got = licenses.license_scan(frame(spark, [f"some words before {t} and some after" for t in texts])).orderBy("doc_id").collect()
    assert [r.license for r in got] == list(texts.values()) and all(r.licenses == [r.license] and r.n_notices == 1 for r in got)
