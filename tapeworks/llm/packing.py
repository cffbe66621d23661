"""Packing tokenised documents into sequences: first-fit decreasing with a tournament tree of bin capacities, run
independently in randomised groups.

Texts are tokenised word by word: a word's ids depend on the word alone, so each task encodes a distinct word once.
Documents are cut at multiples of the capacity; whole pieces fill a sequence each, the rest are packed. Only piece
sizes are shuffled. Groups are random and of a bounded expected size, so no task holds more than its groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.textblock import LOWER, Words, blocks

_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _LETTER
_KIND[48:58] = _DIGIT


class Pieces(Words):
    """Words cut further, at every change between letters, digits (one each) and signs, where the tokeniser cuts too.

    Words with an apostrophe, a control character, a special token's start or letters outside ASCII and Latin-1 stay
    whole, as their inner cuts depend on more.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        super().__init__(raw, offs)
        self.raw = raw = LOWER[raw]
        if not len(self.starts):
            return
        kind = _KIND[raw]
        odd = (raw == 39) | ((raw < 32) & self.inside) | (raw == 127)
        odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
        high = raw >= 128
        if high.any():
            before = np.zeros(len(raw), np.uint8)
            before[1:] = raw[:-1]
            tail = (raw < 192) & (before == 195) & (raw != 151) & (raw != 183)
            odd |= high & ~((raw == 195) | tail)
        if odd.any():
            bad = np.unique(np.searchsorted(self.starts, np.flatnonzero(odd), "right") - 1)
            n = self.ends[bad] - self.starts[bad]
            at = np.cumsum(n) - n
            kind[np.arange(int(n.sum())) - np.repeat(at - self.starts[bad], n)] = _LETTER
        edge = np.zeros(len(raw), bool)
        edge[self.starts] = True
        edge[1:] |= self.inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        starts = np.flatnonzero(edge)
        final = np.zeros(len(raw) + 1, bool)
        final[self.ends] = True
        final[starts] |= self.inside[np.maximum(starts - 1, 0)] & (starts > 0)
        final[starts[0]] = False
        self.starts, self.ends = starts, np.flatnonzero(final)
        self.first = np.searchsorted(starts, offs)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Vocabulary:
    """Ids of the words met so far in a task; it starts anew beyond `most` words."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.path, self.most = path, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, keys: np.ndarray, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        ids, owner, counts = [], [], np.zeros(len(texts), np.int64)
        for a in range(0, len(texts), 20_000):
            part = texts[a : a + 20_000]
            whole = _tokenizer(self.path).encode("\n".join(part), add_special_tokens=False)
            begin = np.cumsum([0] + [len(w) + 1 for w in part])
            spot = np.fromiter((x[0] for x in whole.offsets), np.int64, len(whole.ids))
            ids.append(np.array(whole.ids, np.uint32))
            owner.append(np.searchsorted(begin, spot, "right") - 1 + a)
        np.add.at(counts, np.concatenate(owner) if owner else np.zeros(0, np.int64), 1)
        base = len(self.ids)
        start = base + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, *ids])
        keys, start, counts = (np.concatenate(x) for x in ((self.keys, keys), (self.start, start), (self.count, counts)))
        order = np.argsort(keys)
        self.keys, self.start, self.count = keys[order], start[order], counts[order]

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block in order, and the number of ids of each word."""
        uniq, where, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, uniq)
        new = np.ones(len(uniq), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != uniq[inside]
        if new.any():
            self.add(uniq[new], words.bytes_of(where[new]))
        at = np.searchsorted(self.keys, uniq)[back]
        count, start = self.count[at], self.start[at]
        into = np.cumsum(count) - count
        return self.ids[np.arange(int(count.sum())) - np.repeat(into - start, count)], count


#: Letters in both cases, digits, signs and letters beyond ASCII, in runs and mixed.
PROBE = "Plain words, MixedCase and UPPER; 3.14 x1y22 (a+b)/c [d_e] #f $5 don't na\u00efve \u2014 \u00e9t\u00e9 \u4f60\u597d\nnext line\tTab  two"


def cuts_agree(path: str) -> bool:
    """Whether a tokenizer gives the same ids word by word as for a whole text: the probe, and all its own pieces, apart and
    side by side."""
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=False)
    pieces = [p.replace("</w>", " ") for p in sorted(vocabulary, key=vocabulary.get) if not p.startswith("<|")]
    for text in (PROBE, " ".join(pieces), "".join(pieces)):
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, _ = Vocabulary(path).encode(Pieces(raw, np.array([0, len(raw)])))
        if ids.tolist() != _tokenizer(path).encode(text, add_special_tokens=False).ids:
            return False
    return True


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """id, th, start, length, ids_crc32, doc_tokens, copy (how many rows alike came before in the batch): each document's
    ids and end_id, cut at multiples of capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from encoded(batches)
        finally:
            _tokenizer.cache_clear()  # workers are reused by stages that need no tokeniser

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(tokenizer)
        for batch in batches:
            copies: dict = {}
            for a, b, raw, offs in blocks(batch.column(2)):
                words = Pieces(raw, offs)
                ids, count = vocabulary.encode(words) if len(words) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                total = np.concatenate(([0], np.cumsum(count)))[words.first] if len(words) else np.zeros(b - a + 1, np.int64)
                row, start, length, crc, size, copy = [], [], [], [], [], []
                for i in range(b - a):
                    same = (batch.column(0)[a + i].as_py(), batch.column(1)[a + i].as_py())
                    nth = copies[same] = copies.get(same, -1) + 1
                    mine = np.append(ids[total[i] : total[i + 1]], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(mine), capacity):
                        part = mine[s : s + capacity]
                        row.append(a + i)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        size.append(len(mine))
                        copy.append(nth)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), *(pa.array(x, pa.int64()) for x in (start, length, crc, size, copy))], ["id", "th", "start", "length", "ids_crc32", "doc_tokens", "copy"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, th long, start long, length long, ids_crc32 long, doc_tokens long, copy long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: the leftmost bin with room, found by walking down a tournament tree of room."""
    n = len(sizes)
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    leaves = 1 << max(n - 1, 0).bit_length()
    tree = [capacity] * (2 * leaves)
    order = np.argsort(-sizes, kind="stable").tolist()
    size = sizes.tolist()
    for i in order:
        need, at = size[i], 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        where[i], offset[i] = at - leaves, capacity - tree[at]
        tree[at] -= need
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
    return where, offset


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 4096, group_pieces: int = 16384) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed one by one, and spread over groups by their number
    in the batch, so that no group holds a table's copies; a very long text is many pieces; ties in length go by content.
    The number of groups follows the table's rows and bytes, `group_pieces` expected pieces each. A tokenizer whose ids
    depend on more than a word is refused. An empty table gives no pieces; other columns play no part.
    """
    if not cuts_agree(tokenizer):
        raise ValueError(f"{tokenizer}: its ids depend on more than a word; this operator encodes word by word")
    bulk = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("b")).first()
    groups = 1 + (bulk["n"] + (bulk["b"] or 0) // (2 * capacity)) // group_pieces
    pieces = token_pieces(docs, id_col, text_col, tokenizer, end_id, capacity)
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("id", "th", "start", "copy", F.lit(41)), F.lit(groups)))
    kind = pieces.schema["id"].dataType.simpleString()

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["length", "id", "th", "start"], ascending=[False, True, True, True], ignore_index=True)
        where, offset = first_fit_decreasing(x["length"].to_numpy(), capacity)
        x["sequence_id"] = (int(x["grp"].iat[0]) << 32) + where
        x["offset"] = offset
        return x[["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    out = pieces.groupBy("grp").applyInPandas(pack, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
