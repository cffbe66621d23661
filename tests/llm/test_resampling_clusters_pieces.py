"""Importance resampling, centroid clustering and sentence pieces against brute force and the library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import centroids, importance, sentence_pieces
from tapeworks.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, id long, th string, n_words string, bucket int, rank string, q string, cluster string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RNG = random.Random(5)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, -1, "x", "y", 2, "z", "q", "c") for i, t in rows], COLUMNS)


def some_texts() -> list[str | None]:
    vocabulary = ["".join(RNG.choice("abcXYZé9") for _ in range(RNG.randint(1, 8))) for _ in range(60)]
    texts: list[str | None] = [" ".join(RNG.choice(vocabulary) for _ in range(RNG.randint(1, 60))) for _ in range(80)]
    return [*texts, None, "", " \n", "a" * 300 + " " + "b" * 65 + "-" + "c" * 64, "x" * 70_000, "one", texts[3], texts[3], " ".join(vocabulary) * 40, "A-b_c d\x00e f 你好,世界"]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_resample(docs, target, least, most, buckets, least_words, percent):
    def features(t):
        w = WORD.findall(lowered(t))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        f = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(WORD.findall(lowered(x)))])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("least", "most", "buckets", "percent"), [(1, 1, 10_000, 10), (1, 2, 97, 60), (2, 3, 500, 100)])
def test_importance_against_brute_force(spark, least, most, buckets, percent):
    docs = [*enumerate(some_texts()), (7, some_texts()[7]), (None, "l m n " * 9)]
    target = ["abc X a1 你好", None, "", *[t for _, t in docs[:9]]]
    aims = spark.createDataFrame([(t, 1, "k") for t in target], "text string, bucket int, n string")
    got = importance.importance_resample(frame(spark, docs), aims, least=least, most=most, buckets=buckets, least_words=20, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_resample(docs, target, least, most, buckets, 20, percent)


def test_importance_of_empty_tables(spark):
    docs, aims = frame(spark, [(1, "a b " * 15), (2, None)]), frame(spark, [])
    got = {r.doc_id: (r.n_features, r["rank"]) for r in importance.importance_resample(docs, aims, percent=100).collect()}
    assert got == {1: (30, 1), 2: (0, None)}
    assert importance.importance_resample(docs.limit(0), docs).count() == 0


def test_crcs_advance_together():
    words = [bytes(RNG.randrange(256) for _ in range(n)) for n in (0, 1, 2, 63, 64, 65, 200, 5000)]
    ends = np.cumsum([len(w) for w in words])
    raw = np.frombuffer(b"".join(words), np.uint8)
    state = importance.advance(np.full(len(words), 0xFFFFFFFF, np.uint32), raw, ends - [len(w) for w in words], ends)
    assert (~state).tolist() == [zlib.crc32(w) for w in words]


def brute_clusters(rows, dims, k, rounds, seed, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        where = [nearest(v)[1] for _, v in kept]
        for c in range(len(cents)):
            mine = [v for (_, v), w in zip(kept, where, strict=True) if w == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    final = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in final:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, d, c in final), key=str)


@pytest.mark.parametrize(("dims", "k", "spread"), [(8, 7, 3), (4, 40, 1), (64, 40, 100_000), (3, 500, 2)])
def test_clusters_against_brute_force(spark, dims, k, spread):
    rng = random.Random(dims)
    rows = [(i, [float(rng.randint(-spread, spread)) / 4 for _ in range(dims)]) for i in range(300)]  # few values: many ties
    rows += [(5, rows[5][1]), (None, rows[6][1]), (900, None), (901, []), (902, [1.0] * (dims + 1)), (903, [None] + [1.0] * (dims - 1)), (904, [float("nan")] * dims), (905, [float("inf")] + [0.0] * (dims - 1))]
    df = spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], "vec_id long, embedding array<float>, id string, cluster int, q string")
    got = centroids.centroid_clusters(df.repartition(3), dims=dims, k=k).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(rows, dims, k, 5, 2, 256)
    assert centroids.centroid_clusters(df.limit(0), dims=dims, k=k).count() == 0


def test_components_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        centroids.centroid_clusters(df, k=1).count()


def test_bounds_skip_distances():
    rng = np.random.default_rng(1)
    cents = rng.integers(-4000, 4000, (20, 16))
    q = (cents[rng.integers(0, 20, 3000)] + rng.integers(-50, 50, (3000, 16))).astype(np.int16)
    cluster, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf, np.float32), np.zeros((3000, 20), np.float32)
    first = centroids.assign(q, cents, centroids.between(cents), cluster, upper, lower)
    want = np.stack([centroids.squared(q, c) for c in cents]).argmin(0)
    assert (cluster == want).all()
    moved = cents + 1
    upper, lower = centroids.up(upper.astype(float) + 4), centroids.down(lower.astype(float) - 4)
    again = centroids.assign(q, moved, centroids.between(moved), cluster, upper, lower)
    assert again < 3000 < first < 3000 * 20 + 3000


PIECES = ["", None, " ", "   ", "a", " a  b\t\n c ", "Hello, World! 12345 don't", "x" * 5000, "▁▁ a▁b ▁", "你好 \U0001f9ff͸\x00\x01 ünïcödé", "</s><0x41><unk> <s>", "    " * 37 + "def f():\n\t\treturn  1", "aaaaaaaaab" * 9, "　 ﻿ ​"]


def test_pieces_equal_the_library(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentence_pieces._library(path)
    rng = random.Random(9)
    vocabulary = [sp.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = [*PIECES, *["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(150)], *["".join(rng.choice(" ▁ae tThn\nßΩ1.,é") for _ in range(200)) for _ in range(60)]]
    rows = [*enumerate(texts), (3, texts[3]), (None, "n")]
    got = sentence_pieces.piece_ids(frame(spark, rows).repartition(3), path, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        back = sp.decode(ids)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert sentence_pieces.piece_ids(frame(spark, []), path).count() == 0


def test_decoder_of_any_ids():
    path = tokenizer_path("piece_bpe_32k.model")
    sp, decoder = sentence_pieces._library(path), sentence_pieces.Decoder(path)
    rng = random.Random(4)
    for _ in range(400):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(1, 3), 29871]) for _ in range(rng.randint(0, 12))]
        assert decoder.decode(np.array(ids, np.int64)).decode() == sp.decode(ids), ids


def test_compatible_pairs_by_definition():
    model = sentence_pieces.PieceModel.load(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(6)
    short = [p for p in model.ids if len(p) < 4]
    for _ in range(4000):
        a, b = rng.choice(short), rng.choice(short)
        assert model.compatible(a, b) == (sentence_pieces.merged(list(a + b), model.rank)[0] == [a, b]), (a, b)


def test_columns_of_the_queries(spark):
    from tapeworks.llm.queries import queries

    found = queries()
    assert found["op11_importance_resampling"](spark, "/root/testdata/sf0.001").dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert found["op12_centroid_clusters"](spark, "/root/testdata/sf0.001").dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert found["op13_sentence_pieces"](spark, "/root/testdata/sf0.001").where(F.col("n_tokens") < 1).count() == 0
