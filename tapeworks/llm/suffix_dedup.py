"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Suffixes are ordered only as far as needed: to know whether a string of `length` bytes starts elsewhere, a suffix is
refined until its bucket is its own (settled: not repeated) or its bucket's depth reaches `length`.

1. Initial buckets. The bucket of a suffix is named by its first `gram` bytes. Of every window of `length` bytes the
   suffix with the least name stands for the window (equal windows pick the same one), which leaves about one suffix
   in 75 for the shuffle. A bucket with one suffix settles all windows that it stands for.
2. Refinement. The other buckets travel to one place each, with the bytes of their windows. There the suffixes are
   sorted by (own bucket, bucket of the suffix `depth` bytes later); each run of equal pairs is a new bucket of twice
   the depth. The new buckets are the pointers that the next round sorts by, at the suffix itself and at the later
   one; a suffix alone in its bucket is settled and leaves, and so does every suffix that points to a settled one.
   Windows whose bytes occur more than once as a whole need no sorting and stand for each other.
   A bucket of more than `hot` suffixes is not sent to one place: its windows are named by the same pairs of buckets
   where their text is, to full depth, combined there, and Spark groups the last names, so no task holds an unbounded
   bucket.
3. Windows in buckets of two or more cover the bytes to remove.

Texts that occur more than once as a whole are reduced to one unit first. Names are 64-bit hashes of content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import cut, discard, written
from tapeworks.llm.textblock import _TABLE, blocks, mix, powers

_U = np.uint64
_PAIR = _U(0xC2B2AE3D27D4EB4F)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_inverse = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """At least n powers of the hash base's inverse, modulo 2**64."""
    global _inverse
    if len(_inverse) < n:
        step = np.full(n, _INVERSE, np.uint64)
        step[0] = 1
        _inverse = np.cumprod(step, dtype=np.uint64)
    return _inverse


def gram_names(raw: np.ndarray, n: int) -> np.ndarray:
    """Names of all n-byte strings of a buffer."""
    if len(raw) < n:
        return np.zeros(0, np.uint64)
    power = powers(len(raw))[: len(raw)]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * power, out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse_powers(len(raw))[: len(raw) - n + 1])


def representatives(raw: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, name, position, first window, last window) of the suffixes that stand for the windows of each text."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none.astype(np.uint64), none, none, none
    names = gram_names(raw, gram)
    low = (names & ~_U(0xFFFFFFFF)) | np.arange(len(names), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    n = len(raw) - length + 1
    low = np.minimum(low[:n], low[width - span : width - span + n])
    room = np.zeros(len(raw) + 1, np.int32)
    size = np.diff(offs)
    ok = size >= length
    np.add.at(room, offs[:-1][ok], 1)
    np.add.at(room, offs[1:][ok] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(room[:n]) > 0)
    if not len(start):
        return none, none.astype(np.uint64), none, none, none
    at = (low[start] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    text = np.searchsorted(offs, start[first], "right") - 1
    base = offs[text]
    return text, names[at[first]], at[first] - base, start[first] - base, start[last] - base


def refined_names(name: np.ndarray, gram: int, length: int) -> np.ndarray:
    """Names at full depth from names of `gram` bytes: each round pairs a bucket with the one that its depth leads to."""
    depth = gram
    while depth < length:
        step = min(depth, length - depth)
        name = mix(name[:-step] * _PAIR + name[step:])
        depth += step
    return name


def pointers(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each key's bucket in sorted order, and whether it is the bucket's only one."""
    order = np.argsort(key)
    s = key[order]
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    last = np.ones(len(s), bool)
    last[:-1] = new[1:]
    bucket, alone = np.empty(len(s), np.uint64), np.empty(len(s), bool)
    bucket[order] = np.cumsum(new).astype(np.uint64)
    alone[order] = new & last
    return bucket, alone


def refine(name: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, repeated): all windows of the bodies [start, end) and whether their last bucket is shared.

    name: the initial buckets' names (`gram` bytes deep) at every place of the buffer.
    """
    depth, pointer = gram, name
    settled = np.zeros(len(name), bool)
    while depth < length:
        step = min(depth, length - depth)
        depth += step
        at = _ragged(start, np.maximum(end - start - depth + 1, 0))
        done = settled[at] | settled[at + step]
        settled[at] = done
        at = at[~done]
        bucket, alone = pointers(mix(pointer[at] * _PAIR + pointer[at + step]))
        pointer = pointer.copy()
        pointer[at] = bucket
        settled[at] = alone
    windows = _ragged(start, end - start - length + 1)
    if gram == length:
        _, settled[windows] = pointers(name[windows])
    return windows, ~settled[windows]


def runs(start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive starts within a group."""
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    return first, np.concatenate((first[1:], np.full(min(len(start), 1), len(start)))) - 1


def _ragged(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... n[0] of them, then lo[1], ..."""
    at = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(at - lo, n)


def repeated_windows(docs: DataFrame, text_col: str = "text", length: int = 200, gram: int = 50, hot: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(units, windows): distinct texts of `length` bytes or more as u1, u2, text, copies; and u1, u2, spans with the
    runs of windows (first and last start) that also start elsewhere in another unit or in the same one."""
    gram = min(gram, length)
    if length - gram >= 1 << 15:
        raise ValueError("length is at most 32,767 bytes more than gram")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("u1"), F.xxhash64(F.lit(1), text).alias("u2"), text.alias("text")).where(F.octet_length("text") >= length)
    units = rows.groupBy("u1", "u2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = np.unique(batch.column(0).to_numpy(), return_index=True)[1]
            batch = batch.take(pa.array(np.sort(once)))
            for a, b, raw, offs in blocks(batch.column(1)):
                who, name, at, lo, hi = representatives(raw, offs, length, gram)
                unit = batch.column(0).slice(a, b - a).to_numpy()[who]
                for i in range(0, len(who), 500_000):
                    j = i + 500_000
                    yield pa.RecordBatch.from_arrays([pa.array(name[i:j].view(np.int64)), pa.array(unit[i:j]), pa.array((at[i:j] << 30) | ((at - lo)[i:j] << 15) | (hi - lo)[i:j])], ["name", "u1", "place"])

    suffixes = written(rows.select("u1", "text").mapInArrow(stand, "name long, u1 long, place long"), "suffixes")
    who = F.struct("u1", "place")
    buckets = suffixes.groupBy("name").agg(F.count("*").alias("n"), F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo <> hi").select("name", "n")
    buckets = written(buckets, "bucket-names")  # so that both sides of the join are plain exchanges, which Spark can split at a hot name
    open_ = suffixes.join(buckets, "name").groupBy("u1").agg(F.collect_set(F.struct("place", "name", (F.col("n") > hot).alias("hot"))).alias("places"))
    open_ = written(open_, "open-buckets")
    discard(suffixes, buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["u1", "u2", "lo", "hi", "name", "body"]

        def windows_of(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            # Combined before the shuffle: of windows alike one goes on, and all of them are known to be repeated.
            u1, u2, at, name = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(name, kind="stable")
            same = name[order][1:] == name[order][:-1]
            again, later = np.zeros(len(name), bool), np.zeros(len(name), bool)
            again[order[1:]] = later[order[1:]] = same
            again[order[:-1]] |= same
            k = np.flatnonzero(~later)
            yield pa.RecordBatch.from_arrays([pa.array(u1[k]), pa.array(u2[k]), pa.array(at[k]), pa.nulls(len(k), pa.int64()), pa.array(name[k].view(np.int64)), pa.nulls(len(k), pa.binary())], names)
            k = np.flatnonzero(again)
            first, last = runs(at[k], u1[k])
            yield pa.RecordBatch.from_arrays([pa.array(u1[k][first]), pa.array(u2[k][first]), pa.array(at[k][first]), pa.array(at[k][last]), pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.binary())], names)

        def bodies_of(out: list[list]) -> pa.RecordBatch:
            u1, u2, lo, name, body = out
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (u1, u2, lo)), pa.nulls(len(lo), pa.int64()), pa.array(name, pa.int64()), pa.array(body, pa.binary())], names)

        for batch in batches:
            u1, u2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out, held = [[] for _ in range(5)], 0
            parts: list[tuple[np.ndarray, ...]] = []
            many = 0
            for i, (body, places) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                raw, places = body.as_buffer(), places.values
                code = places.field("place").to_numpy()
                is_hot = places.field("hot").to_numpy(zero_copy_only=False)
                name = places.field("name").to_numpy()
                whole = memoryview(raw)
                lo = (code >> 30) - ((code >> 15) & 32767)
                hi = lo + (code & 32767)
                good = hi + length <= len(whole)  # a unit that shares only u1 with the one meant
                cold = good & ~is_hot
                for p, q, x in zip(lo[cold].tolist(), (hi[cold] + length).tolist(), name[cold].tolist(), strict=True):
                    held += q - p
                    for k, v in enumerate((int(u1[i]), int(u2[i]), p, x, bytes(whole[p:q]))):
                        out[k].append(v)
                warm = np.flatnonzero(good & is_hot)
                if len(warm):
                    data = np.frombuffer(raw, np.uint8)
                    window = np.unique(_ragged(lo[warm], (hi - lo + 1)[warm]))
                    first, last = int(window[0]), int(window[-1]) + length
                    full = refined_names(gram_names(data[first:last], gram), gram, length)
                    parts.append((np.full(len(window), u1[i]), np.full(len(window), u2[i]), window, full[window - first]))
                    many += len(window)
                    if many > 1 << 19:
                        yield from windows_of(parts)
                        parts, many = [], 0
                if held > 4 << 20:
                    yield bodies_of(out)
                    out, held = [[] for _ in range(5)], 0
            if held:
                yield bodies_of(out)
            if parts:
                yield from windows_of(parts)

    sent = written(units.join(open_, "u1").select("u1", "u2", "text", "places").mapInArrow(send, "u1 long, u2 long, lo long, hi long, name long, body binary"), "buckets")
    discard(open_)

    def settle(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        _, _, raw, offs = next(blocks(batch.column("body").combine_chunks(), 1 << 62))
        start, end = offs[:-1], offs[1:]
        size = powers(len(raw) + 1)[: len(raw) + 1]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * size[:-1], dtype=np.uint64)))
        back = inverse_powers(len(raw) + 1)
        body = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _PAIR)
        _, one, which, copies = np.unique(body, return_index=True, return_inverse=True, return_counts=True)
        names = mix((total[gram:] - total[:-gram]) * back[: len(raw) - gram + 1])
        names = np.append(names, np.zeros(gram - 1, np.uint64))
        windows, again = refine(names, start[one], end[one], length, gram)
        row = np.repeat(np.arange(len(one)), end[one] - start[one] - length + 1)
        again &= copies[row] == 1
        first, last = runs(windows[again], row[again])
        r = one[row[again][first]]
        copy = np.flatnonzero(copies[which] > 1)
        u1, u2, lo = (batch.column(c).to_numpy() for c in ("u1", "u2", "lo"))
        begin = np.concatenate((lo[r] + windows[again][first] - start[r], lo[copy]))
        final = np.concatenate((lo[r] + windows[again][last] - start[r], lo[copy] + (end - start)[copy] - length))
        r = np.concatenate((r, copy))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u1[r], u2[r], begin, final)], ["u1", "u2", "lo", "hi"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:  # sorted by name: cut between buckets
            held.append(batch)
            size += batch.nbytes
            if size > 1 << 20:
                table = pa.Table.from_batches(held)
                name = table.column("name").to_numpy()
                edge = int(np.searchsorted(name, name[-1]))
                if edge:
                    yield from settle(table.slice(0, edge))
                held = table.slice(edge).to_batches()
                size = sum(x.nbytes for x in held) if edge else 0
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield from settle(table)

    cold = sent.where("body is not null").select("name", "u1", "u2", "lo", "body").repartition("name").sortWithinPartitions("name").mapInArrow(meet, "u1 long, u2 long, lo long, hi long")
    known = sent.where("hi is not null").select("u1", "u2", "lo", "hi")
    warm = sent.where("body is null and hi is null").select("name", "u1", "u2", "lo")
    spot = F.struct("u1", "u2", "lo")
    twice = warm.groupBy("name").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("name")
    warm = warm.join(written(twice, "hot-names"), "name").select("u1", "u2", "lo", F.col("lo").alias("hi"))
    spans = cut(cold.unionByName(known).unionByName(warm).groupBy("u1", "u2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    discard(sent)
    return units, spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, carry: list[str] | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with carry also those columns and kept, the text of the
    remaining bytes without characters that a cut has broken.

    A null text counts as empty; a text shorter than `length` bytes keeps all. Of whole texts that occur more than
    once, every copy loses all its bytes. Repeated rows are copies. A very long text is cut into suffixes in a block of its
    own and its windows travel by bucket like any other's. An empty table gives an empty table; other columns play no part.
    """
    units, windows = repeated_windows(docs, text_col, length)

    def outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for body, copies, spans in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                raw = body.as_buffer().to_pybytes()
                gone: list[list[int]] = []
                if copies.as_py() > 1:
                    gone = [[0, len(raw)]]
                elif spans.is_valid:
                    for lo, hi in sorted((x["lo"], x["hi"] + length) for x in spans.as_py()):
                        if gone and lo <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], hi)
                        else:
                            gone.append([lo, hi])
                kept, at = [], 0
                for lo, hi in gone:
                    kept.append(raw[at:lo])
                    at = hi
                rest = b"".join([*kept, raw[at:]])
                for col, x in zip(cols, (len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if carry is not None else None), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["u1", "u2", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = units.join(windows, ["u1", "u2"], "left").where("spans is not null or copies > 1").select("u1", "u2", "text", "copies", "spans")
    found = found.mapInArrow(outcome, "u1 long, u2 long, n_removed long, n_spans long, kept_sha256 string, kept string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = [text.alias("_body"), F.struct(*carry).alias("_more")] if carry is not None else []
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("u1"), F.xxhash64(F.lit(1), text).alias("u2"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"), *more)
    out = rows.join(found, ["u1", "u2"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")]
    more = ["_more.*", F.coalesce("kept", "_body").alias("kept")] if carry is not None else []
    return out.select(F.col("id").alias(id_col), "n_bytes", *counts, F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *more)
