"""Operator 6: SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most `most` bits are linked. Fixing one of
most + 1 blocks of bits deals the distinct fingerprints into cells that hold both
ends of every link; a cell with too many is dealt again by blocks of its free bits,
until it is small or, by count of its free bits, can't hold more. In each cell the
fingerprints are sorted by Gray rank and grouped; each group keeps the bits that all
its members share (mask and pattern), upper nodes those that their groups share.
Two nodes descend together, adding up the differences in the bits that both fix;
pairs of nodes that differ in more than `most` bits are left with all below them.
A cell gives a spanning forest of its links, never all pairs; the forests' edges
meet in alternating large-star and small-star rounds over tables in the shared
folder.

Near-duplicates at a shingle similarity (near_duplicates()) go through the same index.
One fingerprint of a whole text differs in about 10 bits between texts at a similarity
of 0.8, so a text has 64: each is the SimHash of BAND five-word shingles, drawn as the
smallest in bins by hash, which two texts draw alike as often as their similarity says.
Texts whose fingerprints the index links at NEAR bits are candidates. Of pairs at a
similarity of 0.8 at most one in 100,000 is expected to agree in none of the 64, as
1 - 0.8 ** 8 to the 64th power says for independent draws, and of more similar ones
fewer. The shingles themselves decide.

Contract: see fingerprints() and link(); one row per document with the smallest id
of its component.

* null and empty texts have fingerprint zero, linked like any other.
* very long texts are hashed whole, in slices. Ties: a bit is set in over half.
* repeated rows and equal fingerprints are one node; each row is returned; rows
  without an id name no component, and one that only they have is null.
* empty table: empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Distinct fingerprints in a cell; dealt no further once its free bits can't hold more.
CELL = 4096
#: Members of a leaf and of an upper node.
FAN = 8
#: Pairs of nodes that a task holds at once.
AT_ONCE = 1 << 18
#: Words hashed at once.
SLICE = 1 << 16


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash of lower-case (A-Z) word shingles, repeats included, as a signed 64-bit number."""
    words = text.lower().split()  # bytes split at 0x20 and 0x09-0x0D alone
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else iter([b" ".join(words)])
    hashes, ones = map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        h = np.fromiter(islice(hashes, SLICE), "<u8", min(SLICE, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp for every row."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t or b"", size, seed) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, fp long")


#: Near-duplicates: least similarity, bins of a sketch, bins in a band, half the texts that a cell compares, about.
ALIKE, BINS, BAND, HALF = 0.8, 512, 8, 512
#: Bits in which the fingerprints of a band may differ.
NEAR = 1
#: Texts whose shingles are asked for by keys sent to every executor; more are joined by a shuffle.
MOST_SENT = 1_000_000
_PROBES = np.random.default_rng(512).integers(0, BINS, (BINS, 64))


def shingles(text: bytes, size: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of a text's distinct lower-case word shingles, rising."""
    words = text.lower().split()
    own = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) > size else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), own), "<u8"))


def _drawn(h: np.ndarray) -> np.ndarray:
    """The smallest of rising shingle hashes in each of BINS bins, mixed with the bin's number; an empty
    bin borrows from the first full one of its own sequence. Two texts agree in about as many bins
    as their similarity says."""
    at, first = np.unique(h >> np.uint64(55), return_index=True)
    least = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    least[at.astype(int)], full[at.astype(int)] = h[first], True
    source = np.arange(BINS)
    for k in range(_PROBES.shape[1]):
        empty = np.flatnonzero(~full[source])
        if not len(empty):
            break
        source[empty] = _PROBES[empty, k]
    source = np.where(full[source], source, int(at[0]))
    return (least[source] ^ (np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)


def band_prints(h: np.ndarray) -> np.ndarray:
    """SimHash of each band's drawn shingles, from a text's rising shingle hashes, as signed 64-bit numbers."""
    drawn = _drawn(h).astype("<u8").reshape(-1, BAND)
    ones = np.unpackbits(drawn.view(np.uint8).reshape(-1, BAND, 8), axis=2, bitorder="little").sum(1, dtype=np.int64)
    return np.packbits(ones * 2 > BAND, axis=1, bitorder="little").view("<i8").ravel()


def _minima(h: np.ndarray) -> bytes:
    """Four bits of what each bin draws; of unlike draws one in 16 agrees."""
    four = (_drawn(h) >> np.uint64(60)).astype(np.uint8)
    return (four[::2] | four[1::2] << np.uint8(4)).tobytes()


def sketch(text: bytes) -> bytes:
    return _minima(shingles(text))


def _similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, as rows of 64-bit words."""
    far = np.zeros(len(x), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k] ^ y[:, k]
        d |= d >> np.uint64(2)
        d |= d >> np.uint64(1)
        far += np.bitwise_count(d & np.uint64(0x1111111111111111))
    return 1 - far / BINS * 16 / 15


def similarity(a: bytes, b: bytes) -> float:
    """Of two texts' shingles, by their sketches."""
    return float(_similar(*(np.frombuffer(s, "<u8")[None] for s in (a, b)))[0])


def set_print(h: np.ndarray) -> int:
    """One number for a text's shingles."""
    return _signed(xxhash.xxh64_intdigest(h.tobytes()))


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash (of the text), set (of its shingles), bands (its band prints) for every row."""

    def run(batches):
        for b in batches:
            sets = [shingles(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(set_print, sets), pa.int64()), pa.array([band_prints(h).tobytes() for h in sets], pa.binary())], ["doc_id", "row_hash", "set", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("row_hash"), F.col(text_col))
    return rows.mapInArrow(run, "doc_id long, row_hash long, set long, bands binary")


def _sets(batches):
    for b in batches:
        sets = [shingles(t or b"") for t in b.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(map(set_print, sets), pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["set", "shingles"])


def _bands(batches):
    """Each text's band prints, a row each."""
    for b in batches:
        fp = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(np.repeat(b.column(0).to_numpy(), BINS // BAND))], ["fp", "set"])


def _alike(table: pa.Table) -> pa.Table:
    """Links of a cell's texts by their shingles; those within what has grown together already are passed over."""
    own_set, sets = table["set"].to_numpy(), [np.frombuffer(x.as_buffer(), "<u8") for x in table["shingles"]]
    size, label, a, b = np.array([len(x) for x in sets]), np.arange(len(sets)), [], []
    for i, own in enumerate(sets):
        todo = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        todo = todo[np.minimum(size[todo], size[i]) >= ALIKE * np.maximum(size[todo], size[i]) - 1e-6]
        if not len(todo):
            continue
        every = np.concatenate([sets[k] for k in todo])
        hit = own[np.minimum(np.searchsorted(own, every), size[i] - 1)] == every
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[todo]) - size[todo])
        near = todo[both / (size[i] + size[todo] - both) >= ALIKE]
        if len(near):
            label[np.isin(label, label[near])] = label[i]
            a += [np.full(len(near), own_set[i])]
            b += [own_set[near]]
    return pa.table({"a": pa.array(np.concatenate(a) if a else [], pa.int64()), "b": pa.array(np.concatenate(b) if b else [], pa.int64())})


def _blocks(free: list[int], parts: int) -> list[int]:
    """Masks of nearly equal blocks of the given bits."""
    cuts = [round(len(free) * k / parts) for k in range(parts + 1)]
    return [sum(1 << b for b in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks_below(mask: int, most: int) -> list[int]:
    """The masks of the cells into which a cell with this mask is dealt."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | x for x in _blocks(free, most + 1)]


def _gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _ranges(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number in lo .. lo + n - 1 of each, and whose it is."""
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + lo[own], own


class GrayIndex:
    """Levels of nodes over fingerprints that are sorted by cell and Gray rank."""

    def __init__(self, cell: np.ndarray, fp: np.ndarray):
        full = np.full(len(fp), ~np.uint64(0))
        self.levels = [(cell, fp, full, np.arange(len(fp)), np.ones(len(fp), np.int64))]
        while True:
            cell, pattern, mask = self.levels[-1][:3]
            new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            size = np.diff(np.append(new, len(cell)))
            if len(self.levels) > 1 and (size == 1).all():
                return
            nth = np.arange(len(cell)) - np.repeat(new, size)
            first = np.flatnonzero(nth % FAN == 0)
            count = np.diff(np.append(first, len(cell)))
            head = np.repeat(pattern[first], count)
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ head), first)
            self.levels.append((cell[first], pattern[first], shared, first, count))

    def links(self, most: int):
        """Pairs of positions whose fingerprints differ in at most `most` bits, in slices."""
        roots = np.arange(len(self.levels[-1][0]))
        todo = [(len(self.levels) - 1, roots, roots, np.bitwise_count(np.zeros(len(roots), np.uint64)).astype(np.int64), np.zeros(len(roots), np.uint64))]
        while todo:
            k, a, b, far, fixed = todo.pop()
            if k == 0:
                yield a[a != b], b[a != b]
                continue
            _, pattern, mask, _, _ = self.levels[k - 1]
            first, count = self.levels[k][3:]
            step = max(1, AT_ONCE // (FAN * FAN))
            if len(a) > step:
                todo += [(k, a[s : s + step], b[s : s + step], far[s : s + step], fixed[s : s + step]) for s in range(0, len(a), step)]
                continue
            x, own = _ranges(first[a], count[a])
            y, of = _ranges(first[b][own], count[b][own])
            x, own = x[of], own[of]
            if k:  # a node against itself: each pair of children once
                once = (a[own] != b[own]) | (x <= y)
                x, y, own = x[once], y[once], own[once]
            both = mask[x] & mask[y]
            more = np.bitwise_count((pattern[x] ^ pattern[y]) & both & ~fixed[own]).astype(np.int64)
            d = far[own] + more
            near = d <= most
            todo.append((k - 1, x[near], y[near], d[near], both[near]))


def forest(n: int, links) -> np.ndarray:
    """The smallest position that each of n positions reaches over the links;
    those within what has grown together already are passed over."""
    label = np.arange(n)
    for a, b in links:
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        while len(a):
            x, y = label[a], label[b]
            if (x == y).all():
                break
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(label, hi, lo)
            while (label[label] != label).any():
                label = label[label]
    return label


def _cell_edges(batches, most: int):
    """Spanning edges of each cell's links; cells arrive whole, one after another."""
    rest: list = []

    def edges(mask, key, fp, rep):
        cell = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
        u = np.ascontiguousarray(fp).view(np.uint64)
        order = np.lexsort((_gray_rank(u), cell))
        label = forest(len(order), GrayIndex(cell[order], u[order]).links(most))
        own = rep[order]
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[label[moved]])], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        rest.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        last = rest[-1][0][-1], rest[-1][1][-1]
        ends = np.flatnonzero((rest[-1][0] != last[0]) | (rest[-1][1] != last[1]))
        if len(rest) > 1 and not len(ends) and (rest[0][0][0], rest[0][1][0]) == last:
            continue  # the whole batch goes on with the same cell
        cols = [np.concatenate(c) for c in zip(*rest, strict=True)]
        other = np.flatnonzero((cols[0] != last[0]) | (cols[1] != last[1]))
        whole = int(other[-1]) + 1 if len(other) else 0
        rest = [[c[whole:] for c in cols]]
        if whole:
            yield edges(*(c[:whole] for c in cols))
    if rest:
        yield edges(*(np.concatenate(c) for c in zip(*rest, strict=True)))


def components(spark: SparkSession, scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of the edges reaches.

    Alternating large-star and small-star; each round is a table in the shared
    folder. A node with very many neighbours is summed within tasks first, and its
    join is one that adaptive execution splits.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = near.join(least, "a")
        moved = joined.filter("b > a") if large else joined.filter("b <> m")
        out = moved.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges0")
    seen, k = mark(now), 0
    while seen[0]:
        big = scratch.write(star(now, True), f"large{k}")
        after = scratch.write(star(big, False), f"edges{k + 1}")
        scratch.drop(f"edges{k}")
        scratch.drop(f"large{k}")
        now, k, was = after, k + 1, seen
        seen = mark(now)
        if seen == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def link(spark: SparkSession, fps: DataFrame, most: int = 3, cell: int = CELL) -> DataFrame:
    """fps and component_id, from a table of doc_id, fp."""
    scratch = Scratch(spark)
    nodes = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep IS NOT NULL"), "nodes")
    deal = lambda df, masks: df.withColumn("mask", F.explode(masks)).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    shown = ["mask", "key", "fp", "rep"]
    level = masks_below(0, most)
    dealt = deal(nodes, F.array(*[F.lit(_signed(m)).cast("long") for m in level])).select(shown)
    deeper = lambda masks: [m for m in masks if 64 - m.bit_count() > cell.bit_length() - 1]
    below, k = deeper(level), 0
    while below:  # cells with too many go on by blocks of their free bits
        full = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).filter((F.col("n") > cell) & F.col("mask").isin([_signed(m) for m in below])).select("mask", "key")
        full = scratch.write(full, f"full{k}")
        n, k = full.count(), k + 1
        if not n:
            break
        few = (lambda x: F.broadcast(x)) if n <= 200_000 else (lambda x: x)
        step = {m: masks_below(m, most) for m in below}
        table = spark.createDataFrame([(_signed(m), [_signed(x) for x in s]) for m, s in step.items()], "mask long, deeper array<long>")
        again = deal(dealt.join(few(full), ["mask", "key"], "left_semi").join(F.broadcast(table), "mask").drop("mask", "key"), F.col("deeper"))
        dealt = dealt.join(few(full), ["mask", "key"], "left_anti").select(shown).unionByName(again.select(shown))
        below = deeper({x for s in step.values() for x in s})
    parts = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key")
    edges = parts.mapInArrow(partial(_cell_edges, most=most), "a long, b long")
    labels = components(spark, scratch, edges)
    named = scratch.write(nodes.join(labels, nodes["rep"] == labels["node"], "left").select("fp", F.coalesce("label", "rep").alias("component_id")), "named")
    return fps.join(named, "fp", "left")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash, component_id, first: texts linked at a five-word shingle similarity of 0.8
    or more; first says whether a row has its component's smallest id and, of those, text hash."""
    scratch = Scratch(spark)
    table = scratch.write(prints(docs, id_col, text_col), "prints")
    nodes = table.select("set", "bands").distinct()
    shown = scratch.write(nodes.mapInArrow(_bands, "fp long, set long"), "shown")
    with Scratch.dropped():  # a fingerprint stands for itself in the index: what links two names a band
        linked = link(spark, shown.withColumn("doc_id", F.col("fp")), NEAR)
        bands = scratch.write(linked.select(F.col("component_id").alias("band"), "set"), "bands")
    scratch.drop("shown")
    groups = bands.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set")).alias("who")).filter("n > 1")
    groups = scratch.write(groups.groupBy("n", "who").agg(F.min("band").alias("band")), "groups")  # equal groups once
    parts = F.when(F.col("n") > 2 * HALF, F.ceil(F.col("n") / HALF)).otherwise(F.lit(1)).cast("int")
    cells = bands.join(groups, "band").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("set"), "parts").cast("int"))
    # a large group is compared part by part, every two of them in a cell
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "set")
    cells = scratch.write(cells, "cells")
    scratch.drop("bands")
    busy = scratch.write(cells.select("set").distinct(), "busy")
    few = F.broadcast(busy) if busy.count() <= MOST_SENT else busy
    sets = docs.select(F.col(text_col)).mapInArrow(_sets, "set long, shingles binary").join(few, "set", "left_semi")
    sets = scratch.write(sets.groupBy("set").agg(F.first("shingles").alias("shingles")), "sets")
    edges = cells.join(sets, "set").groupBy("band", "lo", "hi").applyInArrow(lambda t: _alike(t), "a long, b long")
    labels = components(spark, scratch, edges)
    named = table.select("set").distinct().join(labels.withColumnRenamed("node", "set"), "set", "left").select("set", F.coalesce("label", "set").alias("label"))
    rows = scratch.write(table.select("doc_id", "row_hash", "set").join(named, "set"), "rows")
    least = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("least"))
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row_hash") == F.col("least.row_hash"))
    return rows.join(least, "label").select("doc_id", "row_hash", F.col("least.doc_id").alias("component_id"), first.alias("first"))


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = Scratch(spark).write(fingerprints(docs), "fps")
    return link(spark, fps, 3).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
