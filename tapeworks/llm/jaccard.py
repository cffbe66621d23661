"""N-gram Jaccard join: blocked sparse matrix product of the document by n-gram incidence.

Plan, for texts whose shingle sets have a Jaccard similarity of num / den or more. Rows of the incidence matrix are the
distinct sets; a set A can link only if at least ceil(num / den * |A|) of its columns are held by another row, so it may
have at most |A| - ceil(num / den * |A|) columns of its own ("lone" ones).

1. Column blocks. Only columns whose hash lies in the first part of the hash range are sent, one row per column and
   flush, with the only holder or none; a column with one holder counts as lone for it. Rows with too many lone columns
   in this block alone are discarded; text that no other document resembles ends here. The rows left are packed once,
   and lone columns of a second block are added to those of the first.
2. All columns of what is left are counted exactly: how many rows hold each. Columns held by more than a share of all
   rows by a sketch of fixed size ("heavy") aren't sent; they come last in the order below. Rows whose lone columns are
   beyond their bound send nothing.
3. Of what is left, each row sends its first |A| - ceil(num / den * |A|) + 1 columns, those with the fewest holders
   first, lone ones counted in. Linked rows share one of them. Rows that share one form candidate clusters.
4. In a cluster the product accumulates overlap counts over column blocks and discards pairs whose count so far plus
   what remains is below the bound that the two sizes give. Clusters are dealt into row blocks bounded in rows and
   bytes; a task takes block 0 and one other block, so the data sent grows with the cluster, not with its square, and
   returns only a spanning forest of its links.
5. Rows outside their cluster's largest component after that are compared with all its blocks, which completes the
   exact answer: pairs inside one component need no further look.

Sets are compared by 64-bit shingle hashes: an error takes a collision between two sets that are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import connected_components, cut, discard, written
from tapeworks.llm.textblock import blocks, mix, segment_sum, shingle_sets

_U = np.uint64
_BITS = 22
_SLICE = 1 << 16
_HEAVY = 1 << 40


def set_keys(vals: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set."""
    n = np.diff(offs).astype(np.uint64)
    one = mix(segment_sum(mix(vals ^ _U(0x1234567)), offs) + n)
    two = mix(segment_sum(mix(vals * _U(0xC2B2AE3D27D4EB4F) + _U(7)), offs) ^ (n * _U(31)))
    return one, two


def packed(items: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary value for each segment of an array of 8-byte items."""
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer((offs * items.itemsize * (items.shape[1] if items.ndim > 1 else 1)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(items))]).cast(pa.binary())


def unpacked(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Block by block, the 8-byte items of a binary column, end to end, and each value's first."""
    for a, b, raw, offs in blocks(column):
        yield a, b, np.frombuffer(raw.tobytes(), np.uint64), offs // 8


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def holders(key: np.ndarray, who: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with its least holder, and whether it has others."""
    order = np.lexsort((who, key))
    key, who, many = key[order], who[order], many[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return key, who, many
    last = np.concatenate((at[1:], [len(key)])) - 1
    return key[at], who[at], np.logical_or.reduceat(many, at) | (who[at] != who[last])


def lone_columns(rows: DataFrame, sets_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], low: float, high: float, parts: int, flush: int = 1_000_000) -> DataFrame:
    """(d, lone): how many columns in a part of the hash range each set alone holds, for sets with any.

    sets_of yields (columns, offsets, set keys) of a batch of rows."""
    least, most = (_U(min(int(x * 2**64), 2**64 - 1)) for x in (low, high))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            key, who = (np.concatenate(x) for x in zip(*held, strict=True))
            key, who, many = holders(key, who, np.zeros(len(key), bool))
            for at in range(0, len(key), 200_000):
                to = at + 200_000
                yield pa.RecordBatch.from_arrays([as_long(key[at:to]), pa.array(who[at:to].view(np.int64), mask=many[at:to])], ["key", "d"])

        for batch in batches:
            for vals, at, d in sets_of(batch):
                use = (vals >= least) & (vals <= most)
                held.append((vals[use], np.repeat(d, np.diff(at))[use]))
                size += int(use.sum())
                if size >= flush:
                    yield from send()
                    held, size = [], 0
        if size:
            yield from send()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, who, many = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for batch in batches:
            key.append(batch.column(0).to_numpy().view(np.uint64))
            who.append(batch.column(1).fill_null(0).to_numpy().view(np.uint64))
            many.append(batch.column(1).is_null().to_numpy(zero_copy_only=False))
        _, who, many = holders(np.concatenate(key), np.concatenate(who), np.concatenate(many))
        who = who[~many]
        for i in range(0, len(who), 200_000):
            yield pa.RecordBatch.from_arrays([as_long(who[i : i + 200_000])], ["d"])

    sent = rows.mapInArrow(local, "key long, d long").repartition(parts, "key")
    return sent.mapInArrow(meet, "d long").groupBy("d").agg(F.count("*").alias("lone"))


def heavy_cells(rows: DataFrame, least: int, tasks: int = 64) -> np.ndarray:
    """Which of 2**22 cells of the hash range have `least` entries or more in the packed sets: half a megabyte of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _BITS, np.uint32)
        for batch in batches:
            for _, _, vals, _ in unpacked(batch.column(0)):
                np.add.at(total, (vals >> _U(64 - _BITS)).astype(np.int64), 1)
        used = [k for k in range(len(total) // _SLICE) if total[k * _SLICE : (k + 1) * _SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([total[k * _SLICE : (k + 1) * _SLICE].tobytes() for k in used], pa.binary())], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_SLICE, np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint32)
        return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    out = np.zeros(1 << _BITS, bool)
    for row in rows.select("vals").coalesce(tasks).mapInArrow(run, "slice long, counts binary").groupBy("slice").applyInArrow(add, "slice long, counts binary").collect():  # fixed size
        out[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.unpackbits(np.frombuffer(row["counts"], np.uint8)).astype(bool)
    return out


def ordered_columns(rows: DataFrame, heavy: np.ndarray, parts: int) -> DataFrame:
    """d, n (size of the set) and items: (holders, column) of its columns that other rows hold, or may hold."""
    bits = np.packbits(heavy)

    def is_heavy(vals: np.ndarray) -> np.ndarray:
        cell = (vals >> _U(64 - _BITS)).astype(np.int64)
        return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1

    def chosen(which: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = batch.column(0).to_numpy()
                for a, b, vals, at in unpacked(batch.column(1)):
                    use = is_heavy(vals) == which
                    yield pa.RecordBatch.from_arrays([as_long(vals[use]), pa.array(np.repeat(d[a:b], np.diff(at))[use])], ["key", "d"])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            key.append(batch.column(0).to_numpy().view(np.uint64))
            who.append(batch.column(1).to_numpy())
        _, back, count = np.unique(key := np.concatenate(key), return_inverse=True, return_counts=True)
        count, who = count[back], np.concatenate(who)
        at = np.flatnonzero(count > 1)
        for i in range(0, len(at), 200_000):
            x = at[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(who[x]), pa.array(count[x]), as_long(key[x])], ["d", "held", "key"])

    rare = rows.select("d", "vals").mapInArrow(chosen(False), "key long, d long").repartition(parts, "key").mapInArrow(meet, "d long, held long, key long")
    much = rows.select("d", "vals").mapInArrow(chosen(True), "key long, d long").select("d", F.lit(_HEAVY).alias("held"), "key")
    each = rare.unionByName(much).select("d", F.lit(0).cast("long").alias("n"), F.struct("held", "key").alias("item"))
    size = rows.select("d", F.col("n_shingles").alias("n"))
    return each.unionByName(size.withColumn("item", F.lit(None).cast(each.schema["item"].dataType))).groupBy("d").agg(F.max("n").alias("n"), F.collect_list("item").alias("items"))


def first_columns(held: np.ndarray, key: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
    """The columns that a set of n sends: those with the fewest holders first, after its lone ones."""
    take = n - -(-num * n // den) + 1 - (n - len(key))
    if take <= 0:
        return np.zeros(0, np.uint64)
    return key[np.lexsort((key, held))[:take]]


def merge_columns(col: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One (column, least key) for each column, and the distinct edges from other keys to that least key."""
    order = np.lexsort((key, col))
    col, key = col[order], key[order]
    new = np.ones(len(col), bool)
    new[1:] = col[1:] != col[:-1]
    lead = key[new][np.cumsum(new) - 1] if len(col) else key
    odd = key != lead
    pairs = np.unique(np.stack([key[odd], lead[odd]], 1), axis=0) if odd.any() else np.zeros((0, 2), np.uint64)
    return col[new], key[new], pairs[:, 0], pairs[:, 1]


def candidate_edges(ordered: DataFrame, num: int, den: int, parts: int, flush: int = 1_000_000) -> DataFrame:
    """(a, b): set keys that share a column which both send, as stars around the least key that a task has met."""

    def send(col: list[np.ndarray], key: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        c, k, a, b = merge_columns(np.concatenate(col), np.concatenate(key))
        for at in range(0, len(c), 200_000):
            to = at + 200_000
            yield pa.RecordBatch.from_arrays([as_long(c[at:to]), as_long(k[at:to]), pa.nulls(len(c[at:to]), pa.int64())], ["key", "a", "b"])
        yield pa.RecordBatch.from_arrays([as_long(mix(a)), as_long(a), as_long(b)], ["key", "a", "b"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        col, key, held = [], [], 0
        for batch in batches:
            items = batch.column(2)
            at = items.offsets.to_numpy() - items.offsets[0].as_py()
            item = items.flatten()
            held_by, column = item.field("held").to_numpy(), item.field("key").to_numpy().view(np.uint64)
            for i, (d, n) in enumerate(zip(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_pylist(), strict=True)):
                first = first_columns(held_by[at[i] : at[i + 1]], column[at[i] : at[i + 1]], n, num, den)
                if len(first):
                    col.append(first)
                    key.append(np.full(len(first), d))
                    held += len(first)
            if held >= flush:
                yield from send(col, key)
                col, key, held = [], [], 0
        if held:
            yield from send(col, key)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        col, key = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for batch in batches:
            ready = batch.column(2).is_valid()
            done = batch.filter(ready)
            if done.num_rows:
                yield done.select(["a", "b"])
            rest = batch.filter(pa.compute.invert(ready))
            col.append(rest.column(0).to_numpy().view(np.uint64))
            key.append(rest.column(1).to_numpy().view(np.uint64))
        _, _, a, b = merge_columns(np.concatenate(col), np.concatenate(key))
        yield pa.RecordBatch.from_arrays([as_long(a), as_long(b)], ["a", "b"])

    return ordered.mapInArrow(local, "key long, a long, b long").repartition(parts, "key").mapInArrow(meet, "a long, b long").distinct()


def overlap_links(sets: list[np.ndarray], num: int, den: int, cells: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among a block's sets, by a product over column blocks."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n), size)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    need = num * (size[:, None] + size[None, :])
    live = np.minimum(size[:, None], size[None, :]) * den >= num * np.maximum(size[:, None], size[None, :])
    np.fill_diagonal(live, False)
    shared = count[col] > 1
    row, col = row[shared], (np.cumsum(count > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    rest = np.bincount(row, minlength=n).astype(np.int64)
    overlap = np.zeros((n, n), np.float32)
    columns = int(col[-1]) + 1 if len(col) else 0
    width = max(1, min(columns, max(256, cells // max(n, 1))))
    for start in range(0, columns, width):
        part = slice(*np.searchsorted(col, [start, start + width]))
        keep = live.any(1)
        use = keep[row[part]]
        x = np.zeros((n, width), np.float32)
        x[row[part][use], col[part][use] - start] = 1
        which = np.flatnonzero(keep)
        overlap[np.ix_(which, which)] += x[which] @ x[which].T
        rest -= np.bincount(row[part], minlength=n)
        live &= (overlap + np.minimum(rest[:, None], rest[None, :])) * (den + num) >= need
        if not live.any():
            break
    live &= overlap * (den + num) >= need  # for sets without any shared column
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(live, label[None, :], n).min(1, initial=n))
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def document_sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, th (hash of the text), n_shingles, d and k2 (keys of the set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in blocks(batch.column(2)):
                vals, at = shingle_sets(raw, offs, n)
                one, two = set_keys(vals, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(at)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["id", "th", "n_shingles", "d", "k2"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, th long, n_shingles long, d long, k2 long")


def block_product(tasks: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links of each task: rows of columns task, cluster, node, vals (packed set)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("node", "ascending")]).combine_chunks()
        cluster, node = table.column("cluster").to_numpy(), table.column("node").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("vals")]
        cuts = np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1], [True])))
        left: list[str] = []
        right: list[str] = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = [i for i in range(lo, hi) if i == lo or node[i] != node[i - 1]]
            a, b = overlap_links([sets[i] for i in mine], num, den)
            left += [node[mine[i]] for i in a]
            right += [node[mine[i]] for i in b]
        return pa.table({"a": pa.array(left, pa.string()), "b": pa.array(right, pa.string())})

    return tasks.groupBy("task").applyInArrow(run, "a string, b string")


def cluster_links(rows: DataFrame, num: int, den: int, block: int, block_bytes: int = 16 << 20) -> DataFrame:
    """(a, b): links that connect all linked nodes of each cluster; rows: node, cluster, n_shingles, vals."""
    count = cut(rows.groupBy("cluster").agg(F.count("*").alias("members"), F.sum(8 * F.col("n_shingles")).alias("bulk")).where("members > 1"))
    many = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("bulk") / block_bytes)).cast("int")
    count = count.withColumn("blocks", many)
    small = count.where("blocks = 1").agg(F.sum("bulk")).first()[0] or 0
    tasks = max(1 + small // (block_bytes // 8), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.join(count, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    one = dealt.where("blocks = 1").withColumn("task", F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(tasks)))).select("task", "cluster", "node", "vals")
    each = F.when(F.col("own") == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array(F.col("own")))
    split = dealt.where("blocks > 1").withColumn("other", F.explode(each)).select(F.concat_ws("/", F.lit("m"), "cluster", "other").alias("task"), "cluster", "node", "vals")
    links = cut(block_product(one.unionByName(split), num, den))
    if count.where("blocks > 1").isEmpty():
        return links

    # Rows of a dealt cluster that are not yet in its largest component meet every block.
    part = cut(connected_components(links))
    place = cut(dealt.where("blocks > 1").select("node", "cluster", "blocks", "own").join(part, "node", "left").withColumn("root", F.coalesce("root", "node")))
    most = place.groupBy("cluster", "root").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    place = cut(place.join(cut(most), "cluster").withColumn("odd", F.col("root") != F.col("main")))
    odd_blocks = cut(place.where("odd").groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("odd_blocks")))
    place = place.join(odd_blocks, "cluster").select("node", "odd_blocks", "odd", "own", F.col("blocks").alias("all"))
    wide = cut(place).join(rows.select("node", "cluster", "vals"), "node")
    odd = wide.where("odd").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("odd_blocks")).cast("int"))
    odd = odd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    full = wide.withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1))).withColumn("other", F.col("own"))
    again = odd.select("cluster", "mine", "other", "node", "vals").unionByName(full.select("cluster", "mine", "other", "node", "vals"))
    again = again.select(F.concat_ws("/", F.lit("r"), "cluster", "mine", "other").alias("task"), "cluster", "node", "vals")
    return links.unionByName(cut(block_product(again, num, den)))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, block: int = 256, part_rows: int = 2_000_000) -> DataFrame:
    """id, n_shingles, component_id (least id reachable by links), th (hash of the text) and lead for every row of docs.

    lead tells whether the row has its component's least id and, with that id, the least th: one text of each
    component, all rows with an empty set, and repeated rows alike.

    Words are lower-cased A-Z. A null or blank text has an empty set, links with nothing and is its own component.
    Equal texts and equal sets link. Rows without an id keep a row: their component is the least id that they reach,
    null if there is none. Repeated rows give repeated rows; ties among ids fall to the text's hash; a very long text is
    a block of its own in each pass. An empty table gives an empty table; other columns of docs, whatever their names,
    play no part.
    """
    sets = written(document_sets(docs, id_col, text_col, n), "jaccard-sets")
    first = F.min(F.struct(F.col("id").isNull().alias("nil"), "id", "th")).alias("x")
    lead = sets.where("n_shingles > 0").groupBy("d", "k2", "n_shingles").agg(F.count("*").alias("copies"), first)
    lead = written(lead, "jaccard-leads")

    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    share = min(1.0, 1.5 * (den - num) / den)

    def of_text(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _, _, raw, offs in blocks(batch.column(0)):
            vals, at = shingle_sets(raw, offs, n)
            yield vals, at, set_keys(vals, at)[0]

    def of_packed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        d = batch.column(0).to_numpy().view(np.uint64)
        for a, b, vals, at in unpacked(batch.column(1)):
            yield vals, at, d[a:b]

    lone = lone_columns(docs.select(F.col(text_col).cast("string").alias("text")), of_text, 0.0, share, 1 + int(total * share) // part_rows)
    allowed = F.col("n_shingles") - F.ceil(F.col("n_shingles") * num / den)
    left = lead.join(lone, "d", "left").withColumn("lone", F.coalesce("lone", F.lit(0))).where(F.col("lone") <= allowed)
    left = written(left.select("d", "k2", "n_shingles", "lone", "x.id", "x.th"), "jaccard-left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            # Repeated rows come one after the other out of the join; one of them will do.
            d = batch.column("d").to_numpy()
            keep = np.ones(len(d), bool)
            if len(d):
                keep[1:] = d[1:] != d[:-1]
                keep[0] = last is None or d[0] != last
                last = d[-1]
            batch = batch.filter(pa.array(keep))
            for a, b, raw, offs in blocks(batch.column("text")):
                vals, at = shingle_sets(raw, offs, n)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in ("d", "k2", "n_shingles", "lone")] + [packed(vals, at)], ["d", "k2", "n_shingles", "lone", "vals"])

    texts = docs.select(F.col(id_col).alias("id2"), F.xxhash64(text_col).alias("th2"), F.col(text_col).cast("string").alias("text"))
    rows = left.join(texts, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))).select("d", "k2", "n_shingles", "lone", "text")
    block_one = written(rows.mapInArrow(pack, "d long, k2 long, n_shingles long, lone long, vals binary"), "jaccard-rows")
    discard(left)

    more = block_one.agg(F.sum("n_shingles")).first()[0] or 0
    high = min(1.0, 3 * share)
    lone = lone_columns(block_one.select("d", "vals"), of_packed, np.nextafter(share, 1), high, 1 + int(more * (high - share)) // part_rows).withColumnRenamed("lone", "more")
    rows = block_one.join(lone, "d", "left").where(F.col("lone") + F.coalesce("more", F.lit(0)) <= allowed)
    rows = written(rows.select("d", "k2", "n_shingles", "vals"), "jaccard-rows-2")
    discard(block_one)

    bulk = rows.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).first()
    # A task that counts cells sends 16 MB whatever it has read: 200 million columns a task keep that to a hundredth.
    heavy = heavy_cells(rows, max(64, bulk["n"] // 200), max(64, (bulk["s"] or 0) // 200_000_000))
    ordered = written(ordered_columns(rows, heavy, 1 + (bulk["s"] or 0) // part_rows), "jaccard-columns")
    sent = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + int((bulk["s"] or 0) * share) // part_rows)
    label = cut(connected_components(candidate_edges(ordered, num, den, sent)).select(F.col("node").alias("d"), F.col("root").alias("cluster")))
    discard(ordered)
    node = F.concat(F.lpad(F.hex("d"), 16, "0"), F.lpad(F.hex("k2"), 16, "0"))
    links = cluster_links(rows.join(label, "d").withColumn("node", node), num, den, block)
    root = cut(connected_components(links))
    discard(rows)

    # Sets that have copies or links are named after their component; all others are their own.
    leads = lead
    lead = lead.withColumn("node", node).join(root, "node", "left").where("root is not null or copies > 1").withColumn("root", F.coalesce("root", "node")).select("d", "k2", "root", "x")
    with_root = written(lead, "jaccard-named")
    discard(leads)
    least = cut(with_root.groupBy("root").agg(F.min("x").alias("least")))
    lead = written(with_root.join(least, "root").select("d", "k2", "least"), "jaccard-least")
    discard(with_root)
    named = sets.where("n_shingles > 0").join(lead, ["d", "k2"], "left").select("id", "n_shingles", "th", "least")
    out = named.unionByName(sets.where("n_shingles = 0").select("id", "n_shingles", "th").withColumn("least", F.lit(None).cast(named.schema["least"].dataType)))
    mine = F.coalesce(F.col("id").eqNullSafe(F.col("least.id")) & F.col("th").eqNullSafe(F.col("least.th")), F.lit(False))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"), "th", (F.col("least").isNull() | mine).alias("lead"))
