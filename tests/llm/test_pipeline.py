"""Each stage of the pipeline, and the whole of it, against plain Python; nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tapeworks.llm.queries import tokenizer_path
from test_llm_operators import DOCS, brute_repeats, sentence, shingles

COLUMNS = pipeline.COLUMNS
WORDS = {"de": "der die und nicht ein schön über haus weg", "en": "the and that with from this have house way", "es": "es el que los para con una año casa", "fr": "le les que des pour dans été maison une"}


def frame(spark, rows):
    """rows: (id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), 1, "x", "y", "z") for i, t, lang, source in rows], DOCS)


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def components(sets, num, den):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_language_stage(spark):
    rng = random.Random(1)
    good = [(i, text(k, rng.randint(20, 60), rng), k, f"s{i % 3}") for i, k in enumerate(rng.choices(list(WORDS), k=120))]
    bad = [(200, None, "en", "s0"), (201, "", "en", "s1"), (202, "чужой текст на совсем другом языке, который здесь никто не читает", None, None), (203, "ab", "en", "s0")]
    rows = good + bad + [good[0], (None, good[1][1], good[1][2], "s1")]
    out = pipeline.language_id(spark, frame(spark, rows), "")
    assert out.columns == COLUMNS
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter((i, t) for i, t, *_ in rows if (i, t) not in {(b[0], b[1]) for b in bad})
    assert pipeline.language_id(spark, frame(spark, []), "").count() == 0


def test_near_copy_stage(spark):
    rng = random.Random(2)
    base = [sentence(rng.randint(30, 120), rng) for _ in range(15)]
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(rng.randint(0, 3)):
            w = t.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [None, "", None, "one", "one", sentence(6000, rng)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[i], "en", "s") for i in order]
    lead = components([shingles(t, 5) for t in texts], 80, 100)
    out = pipeline.near_copies(spark, frame(spark, rows), "")
    assert out.columns == COLUMNS
    assert sorted(r.doc_id for r in out.collect()) == sorted({i for i, k in enumerate(lead) if i == k})
    assert 15 <= len(set(lead)) < len(texts)
    twice = frame(spark, [rows[0], rows[0], (None, rows[0][1], "en", "s"), (None, None, "en", "s")])
    assert sorted((r.doc_id is None, r.text is None) for r in pipeline.near_copies(spark, twice, "").collect()) == sorted([(False, rows[0][1] is None)] + [(True, True)] + ([(True, False)] if rows[0][1] is None else []))
    assert pipeline.near_copies(spark, frame(spark, []), "").count() == 0


def test_passage_stage(spark):
    rng = random.Random(3)
    passage = sentence(60, rng)
    texts = [sentence(20, rng) + " " + passage + " " + sentence(10, rng), passage + "\n" + sentence(9, rng), sentence(80, rng), None, "", "é" * 150 + sentence(40, rng)]
    want = brute_repeats([(t or "").encode() for t in texts], 200)
    out = pipeline.repeated_passages(spark, frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), "")
    assert out.columns == COLUMNS
    got = {r.doc_id: r for r in out.collect()}
    assert all(len((texts[i] or "").encode()) - len(got[i].text.encode()) == want[i][0] and got[i].n_chars == len(got[i].text) for i in got) and len(got) == len(texts)
    assert want[0][0] > 200 and got[2].text == texts[2]
    assert pipeline.repeated_passages(spark, frame(spark, []), "").count() == 0


def test_mixture_stage(spark):
    rng = random.Random(4)
    rows = [(i, None if i == 7 else "" if i == 8 else sentence(rng.randint(1, 50), rng), "en", ["b", "a", "c", None, "b", "b"][i % 6]) for i in range(120)]
    out = pipeline.mixture(spark, frame(spark, rows), "")
    assert out.columns == COLUMNS
    whole = {i: (t or "").split() for i, t, *_ in rows}
    taken, source = defaultdict(int), {i: s for i, _, _, s in rows}
    for r in out.collect():
        n = len(r.text.split())
        assert r.text.split() == whole[r.doc_id][:n] and n > 0 and r.n_chars == len(r.text)
        taken[r.doc_id] += n
    assert all(n <= 2 * len(whole[i]) for i, n in taken.items())
    size = Counter()
    for i, w in whole.items():
        size[source[i]] += len(w)
    left, weight = 1.5 * sum(size.values()), {"a": 3, "b": 1, "c": 2, None: 3}
    target, free = {}, set(size)
    while free:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 2 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    got = Counter()
    for i, n in taken.items():
        got[source[i]] += n
    assert all(got[s] == int(target[s]) for s in size)
    assert pipeline.mixture(spark, frame(spark, []), "").count() == 0


def test_packing_stage_and_whole_run(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(5)
    rows = [(i, text(k, rng.randint(30, 200), rng), k, f"s{i % 3}") for i, k in enumerate(rng.choices(list(WORDS), k=60))]
    rows += [(100, rows[0][1], rows[0][2], "s1"), (101, rows[1][1] + " und", rows[1][2], "s0"), (102, None, "en", "s1"), (103, "", None, None), (104, "чужой текст на другом языке " * 5, None, "s1"), rows[2], (None, text("en", 80, rng), "en", "s2")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = Counter(r.text for r in docs.collect())
    got = pipeline.run(spark, str(tmp_path)).collect()
    pieces = Counter((r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got)
    want = Counter()
    for t, n in left.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[(len(ids), at, len(part), zlib.crc32(part.tobytes()))] += n
    assert pieces == want
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= 4096
    kept = {r.doc_id for r in got}
    assert not kept & {100, 101, 102, 103, 104}


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_an_empty_table(spark, name):
    out = dict(pipeline.STAGES)[name](spark, frame(spark, []).where(F.lit(False)), "")
    assert out.count() == 0
