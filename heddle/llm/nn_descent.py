"""Operator 5: nearest neighbours by NN-descent and greedy graph search.

Distinct vectors are nodes, dealt by a hash of their id into blocks; a block is one
row that holds its nodes' vectors (as given, and in 8 bits for building) and lists
of neighbours. Every round is four joins by block. A block asks once for each node that
its lists name, saying how many of them do. The node draws from these numbers how
many reverse links of each block it wants, and replies with its vector; the block then
sends it the vectors of as many. So a node that very many lists name gets one short
request a block, and no more vectors than any other. A node then compares its
neighbours and the sample of reverse neighbours with each other, if one of a pair is
new, and offers each the others that beat the last on its list; offers to one block
are merged in a tree. Rounds end when few lists change, however many it takes. Lists
start from cells: a node lies in the cells of the pivots nearest to it in direction, and
the nodes of a cell are compared as one matrix product. Pivots are nodes drawn by a hash
of their ids, at most PIVOTS of them; a cell that grows far beyond SIDE rows (like
directions, or more nodes than the pivots are meant for) is dealt into parts at random,
and the rounds find what its parts have not met. Lists, samples and offers grow with the
number of nodes.

A query walks the graph from its own node: it asks all its best nodes not yet asked for
their neighbours (a block of queries asks each node once), has them scored on the vectors
as given, in double precision, is told of those that are among its best, and stops when its
best nodes, as many as a list holds, have all been asked.

Contract: query_id, rank, vec_id, score; a query's nearest by inner product, ties to
the smaller id. Recall against brute force is measured in the tests.

* vectors that are null, zero or hold null or non-finite components take no part;
  vectors of one length are searched among themselves. Doubles are scored as doubles.
* equal vectors are one node; the smallest ids among the copies are found with it.
* repeated ids: rows of one id and vector count once; of one id and unlike vectors each is
  searched and found by itself, and the id's ranks are over all that its rows find.
* Empty table: empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import pickle
from functools import reduce
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, settings

#: Lists that still change, as a share, to end.
SETTLED = 0.02
#: Nodes in a block with lists of LEAST; rows of a cell, about; nodes that may be pivots, at most.
NODES, SIDE, PIVOTS = 2000, 4096, 16_384
#: Components that are dealt to cells at a time, rows of a cell that are compared at a time, and centres.
DEALT, STRIPE, CENTRES = 1 << 20, 256, 32
#: Messages of offers to one block that one task merges.
FAN = 256
#: Results, scored nodes kept beyond the width; neighbours that a block of queries gets in a step, about, and nodes that a query asks at least.
TOP, SPARE, HEARD, ASKED = 20, 32, 1 << 20, 16
#: Length of the lists up to BASE nodes, and what each doubling beyond adds to it.
LEAST, BASE, MORE = 48, 10_000, 8


class Effort(NamedTuple):
    """What building and searching spend on each node."""

    near: int  #: neighbours in a list, and best nodes that are all asked in the end
    reverse: int  #: reverse neighbours in a comparison
    offers: int  #: offers that a comparison makes to each node
    cells: int  #: cells that a node starts in

    @classmethod
    def of(cls, nodes: int) -> Effort:
        doublings = max(0.0, math.log2(max(nodes, 1) / BASE))
        near = LEAST + math.ceil(MORE * doublings)
        return cls(near, near * 7 // 12, near // 8, 8)


MESSAGE = "block long, body binary"


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(29)) % np.uint64(blocks)).astype(np.int64)


def _send(block: np.ndarray, *cols: np.ndarray):
    """Rows of columns to each block they go to."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
    bodies = [pickle.dumps(tuple(c[order[a:b]] for c in cols), 5) for a, b in zip(first, [*first[1:], len(block)], strict=True)] if len(block) else []
    return pa.table({"block": pa.array(block[first] if len(block) else [], pa.int64()), "body": pa.array(bodies, pa.binary())})


def _got(table: pa.Table) -> list[tuple]:
    return [pickle.loads(x.as_py()) for x in table["body"]]


def _joined(parts: list[tuple]) -> tuple:
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _starts(rising: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], rising[1:] != rising[:-1]])) if len(rising) else np.zeros(0, int)


def _runs(rising: np.ndarray):
    """Where each run of equal values begins and ends."""
    return itertools.pairwise([*_starts(rising).tolist(), len(rising)])


def _nth(rising: np.ndarray) -> np.ndarray:
    """Places, from 0, in the runs of equal values."""
    first = _starts(rising)
    return np.arange(len(rising)) - np.repeat(first, np.diff(np.append(first, len(rising))))


def _first_of(key: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` largest values of each key (a small number), by key and falling value."""
    if value.dtype == np.float32:  # both in one number, which sorts several times faster
        bits = value.view(np.uint32)
        falling = np.where(bits >> 31, bits, ~(bits | np.uint32(1 << 31)))
        order = np.argsort(key.astype(np.uint64) << np.uint64(32) | falling)
    else:
        order = np.lexsort((-value, key))
    return order[_nth(key[order]) < most]


def _offers(blocks: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.Table:
    """Messages of offers b to nodes a, whose rows lie side by side: each node once, its number of offers, offers."""
    block = _block(a, blocks)
    order = np.argsort(block, kind="stable")
    block, a, b, s = block[order], a[order], b[order], s[order]
    bodies = []
    for lo, hi in _runs(block):
        own = _starts(a[lo:hi])
        bodies.append(pickle.dumps((a[lo:hi][own], np.diff(np.append(own, hi - lo)).astype(np.int32), b[lo:hi], s[lo:hi]), 5))
    return pa.table({"block": pa.array(block[_starts(block)], pa.int64()), "body": pa.array(bodies, pa.binary())})


def _offered(table: pa.Table) -> tuple:
    a, times, b, s = _joined(_got(table))
    return np.repeat(a, times), b, s


def _best_of(a: np.ndarray, b: np.ndarray, s: np.ndarray, most: int) -> tuple:
    """The `most` best offers to each node, each once; nodes and offers are small numbers."""
    key = a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b
    order = np.argsort(key)
    order = order[_starts(key[order])]
    a, b, s = a[order], b[order], s[order]
    top = _first_of(a, s, most)
    return a[top], b[top], s[top]


def _largest(near: np.ndarray, most: int, beat: np.ndarray | float) -> np.ndarray:
    """Flat positions of about the `most` largest of each row that are above `beat`; twice as many at most."""
    n = near.shape[-1]
    least = np.partition(near, n - most, axis=-1)[..., n - most, None]
    hit = np.flatnonzero((near >= least) & (near > beat))
    if len(hit) > 2 * most * (near.size // n):  # ties
        only = np.zeros(near.shape, bool)
        np.put_along_axis(only, np.argpartition(near, n - most, axis=-1)[..., n - most :], True, -1)
        hit = np.flatnonzero(only & (near > beat))
    return hit


def _vectors(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length, none null, as a matrix."""
    flat = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(col), -1)


# A block's body: ids (rising), vectors, 8-bit vectors and scales, neighbours (-1: none), nearness, new.
def _fresh(near: int, key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    ids = table["id"].to_numpy()
    vec = _vectors(table["vec"])
    order = np.argsort(ids)
    ids, vec = ids[order], vec[order]
    scale = np.abs(vec).max(1) / vec.dtype.type(127)
    small = np.rint(vec / scale[:, None]).astype(np.int8)
    n = len(ids)
    body = ids, vec, small, scale, np.full((n, near), -1, np.int64), np.full((n, near), -np.inf, vec.dtype), np.zeros((n, near), bool)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([pickle.dumps(body, 5)], pa.binary()), "changed": pa.array([n * near], pa.int64())})


def _way(vec: np.ndarray) -> np.ndarray:
    """Directions, in floats."""
    x = (vec / np.abs(vec).max(1, keepdims=True)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(vec: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """The `most` nearest pivots of each row, in any order."""
    out = np.empty((len(vec), most), np.int64)
    for lo in range(0, len(vec), STRIPE):
        near = _way(vec[lo : lo + STRIPE]) @ pivots.T
        out[lo : lo + STRIPE] = np.argpartition(near, len(pivots) - most, axis=1)[:, len(pivots) - most :]
    return out


def _in_lots(batches):
    """ids and vectors, about DEALT components at a time."""
    ids, vec, n = [], [], 0
    for b in batches:
        if b.num_rows:
            ids.append(b.column(0).to_numpy())
            vec.append(_vectors(b.column(1)))
            n += vec[-1].size
        if n >= DEALT:
            yield np.concatenate(ids), np.concatenate(vec)
            ids, vec, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(vec)


def _sizes(pivots: np.ndarray, most: int, batches):
    total = np.zeros(len(pivots), np.int64)
    for _, vec in _in_lots(batches):
        total += np.bincount(_cells(vec, pivots, most).ravel(), minlength=len(pivots))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(total)], ["cell", "n"])


def _to_cells(pivots: np.ndarray, parts: np.ndarray, most: int, batches):
    """Nodes to each of their cells, or the part of it that a hash of the id picks."""
    before = np.cumsum(parts) - parts
    for ids, vec in _in_lots(batches):
        cell = _cells(vec, pivots, most)
        mixed = (ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
        cell = before[cell] + (mixed[:, None] % parts[cell].astype(np.uint64)).astype(np.int64)
        at = np.repeat(np.arange(len(ids)), most)
        yield from _send(cell.ravel(), ids[at], vec[at]).to_batches()


def _beside(blocks: int, most: int):
    """Offers among the nodes of a cell."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, vec = _joined(_got(table))
        order = np.lexsort((ids, _block(ids, blocks)))
        ids, vec = ids[order], vec[order]
        n, k = len(ids), min(most, len(ids) - 1)
        a, b, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, vec.dtype)]
        for lo in range(0, n if k > 0 else 0, STRIPE):
            near = vec[lo : lo + STRIPE] @ vec.T
            rows = np.arange(len(near))
            near[rows, lo + rows] = -np.inf
            if np.isnan(near).any():  # products beyond the numbers' range
                near = np.where(np.isnan(near), -np.inf, near)
            hit = _largest(near, k, -np.inf)
            a.append(lo + hit // n)
            b.append(hit % n)
            s.append(near.ravel()[hit])
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
        return _offers(blocks, ids[a], ids[b], s)

    return run


def _requests(blocks: int, batches):
    """Each block's wish for the nodes that its lists name, and how often they do."""
    for b in batches:
        for own, body in zip(b.column("block").to_pylist(), b.column("body"), strict=True):
            near = pickle.loads(body.as_py())[4]
            to, times = np.unique(near[near >= 0], return_counts=True)
            yield from _send(_block(to, blocks), np.full(len(to), own), to, times).to_batches()


def _draws(rng: np.random.Generator, at: np.ndarray, times: np.ndarray, most: int) -> np.ndarray:
    """How many of the links that each row stands for are among `most` drawn of its node's; rows lie by node."""
    wanted = times.copy()
    first = _starts(at)
    total = np.add.reduceat(times, first)
    ends = np.append(first[1:], len(at))
    for k in np.flatnonzero(total > 64 * most):  # few; their links are never written out
        lo, hi = first[k], ends[k]
        drawn = np.searchsorted(np.cumsum(times[lo:hi]), rng.choice(total[k], most, replace=False, shuffle=False), "right")
        wanted[lo:hi] = np.bincount(drawn, minlength=hi - lo)
    rows = np.flatnonzero(np.repeat((total > most) & (total <= 64 * most), ends - first))
    if len(rows):
        link = np.repeat(rows, times[rows])
        node = np.repeat(np.arange(len(first)), ends - first)[link]
        order = np.argsort(node.astype(np.uint64) << np.uint64(32) | rng.integers(0, 1 << 32, len(link), np.uint64))
        wanted[rows] = np.bincount(link[order][_nth(node[order]) < most], minlength=len(at))[rows]
    return wanted


def _replies(seed: int, reverse: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return _send(np.zeros(0, np.int64))
        ids, _, small, scale, _, value, _ = _got(left)[0]
        own, to, times = _joined(_got(right))
        order = np.lexsort((own, to))
        own, to, times = own[order], to[order], times[order]
        at = np.searchsorted(ids, to)
        wanted = _draws(np.random.default_rng([seed, left["block"][0].as_py()]), at, times, reverse)
        return _send(own, to, wanted, value[at, -1], scale[at], small[at])

    return run


def _links(blocks: int, seed: int):
    """A block's own links beside its neighbours' vectors, and the reverse links that neighbours have drawn."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return _send(np.zeros(0, np.int64))
        ids, _, small, scale, near, value, new = _got(left)[0]
        to, wanted, last, their, vec = _joined(_got(right))
        order = np.argsort(to)
        to, wanted, last, their, vec = (c[order] for c in (to, wanted, last, their, vec))
        i, k = np.nonzero(near >= 0)
        at = np.searchsorted(to, near[i, k])
        own = pa.table({"block": left["block"], "body": pa.array([pickle.dumps((ids[i], at, new[i, k], to, last, their, vec), 5)], pa.binary())})
        rng = np.random.default_rng([seed, left["block"][0].as_py()])
        order = np.argsort(at.astype(np.uint64) << np.uint64(32) | rng.integers(0, 1 << 32, len(at), np.uint64))
        some = order[_nth(at[order]) < wanted[at[order]]]
        i, k, v = i[some], k[some], near[i[some], k[some]]
        return pa.concat_tables([own, _send(_block(v, blocks), v, ids[i], new[i, k], value[i, -1], scale[i], small[i])])

    return run


def _told(table: pa.Table) -> tuple:
    """Links of a block's centres, both ways (centre, place of the member, new), and the members, with their vectors."""
    links, members, n = [], [], 0
    for body in _got(table):
        if len(body) == 7:
            centre, at, new, *each = body
        else:
            centre, member, new, *rest = body
            at, each = np.arange(len(member)), (member, *rest)
        links.append((centre, at + n, new))
        members.append(tuple(each))
        n += len(each[0])
    return _joined(links), _joined(members)


def _compared(blocks: int, offers: int, most: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        (centre, at, new), (member, last, scale, vec) = _told(table)
        ids, first, code = np.unique(member, return_index=True, return_inverse=True)
        last, scale, vec = last[first], scale[first], vec[first]
        # a neighbour both ways counts once, as new if either is
        link = (np.unique(centre, return_inverse=True)[1] * len(ids) + code[at]) * 2 + ~new
        link.sort()
        link = link[_starts(link >> 1)]
        centre, at, new = link // (2 * len(ids)), (link >> 1) % len(ids), link & 1 == 0
        first = _starts(centre)
        size = np.diff(np.append(first, len(centre)))
        by = np.argsort(size, kind="stable")
        first, size = first[by], size[by]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, scale.dtype))]
        for lo in range(0, len(first), CENTRES):
            f, n = first[lo : lo + CENTRES], size[lo : lo + CENTRES]
            wide = int(n.max())
            k = min(offers, wide - 1)
            if k < 1:
                continue
            place = f[:, None] + np.minimum(np.arange(wide)[None], n[:, None] - 1)
            none = np.arange(wide)[None] >= n[:, None]
            who, old = at[place], ~new[place]
            x = vec[who].astype(scale.dtype) * scale[who][..., None]
            near = x @ x.transpose(0, 2, 1)
            bad = old[:, :, None] & old[:, None, :]
            bad |= none[:, None, :]
            bad[:, np.arange(wide), np.arange(wide)] = True
            np.copyto(near, -np.inf, where=bad)
            hit = _largest(near, k, np.where(none, np.inf, last[who])[..., None])
            row = hit // wide
            s = near.ravel()[hit]
            fine = np.isfinite(s)
            out.append((who.ravel()[row][fine], who.ravel()[row - row % wide + hit % wide][fine], s[fine]))
        a, b, s = _best_of(*_joined(out), most)
        return _offers(blocks, ids[a], ids[b], s)

    return run


def _best(most: int):
    """The best offers to each node of a block, out of several messages."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b, s = _offered(table)
        (own, a), (to, b) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        a, b, s = _best_of(a, b, s, most)
        return _offers(1, own[a], to[b], s).set_column(0, "block", pa.array([key[0].as_py()], pa.int64()))

    return run


def _in_tree(offers: DataFrame, blocks: int, most: int) -> DataFrame:
    """Offers of all blocks, merged until at most about FAN messages go to each."""
    parts = blocks
    while parts > FAN:
        parts = -(-parts // FAN)
        offers = offers.groupBy("block", F.pmod(F.xxhash64("body"), F.lit(parts)).alias("part")).applyInArrow(_best(most), MESSAGE)
    return offers


def _merged(left: pa.Table, right: pa.Table) -> pa.Table:
    ids, vec, small, scale, near, value, new = _got(left)[0]
    changed = 0
    if right.num_rows:
        a, b, s = _offered(right)
        i, k = np.nonzero(near >= 0)
        row = np.concatenate([i, np.searchsorted(ids, a)])
        ends, to = np.unique(np.concatenate([near[i, k], b]), return_inverse=True)
        val = np.concatenate([value[i, k], s])
        pair = (row * len(ends) + to) * 2 + (np.arange(len(row)) >= len(i))  # of a pair the one that was there comes first
        order = np.argsort(pair)
        order = order[_starts(pair[order] >> 1)]
        row, val, pair = row[order], val[order], pair[order]
        top = _first_of(row, val, near.shape[1])
        row, to, val, is_new = row[top], ends[(pair[top] >> 1) % len(ends)], val[top], pair[top] & 1 == 1
        nth = _nth(row)
        near, value, new = np.full_like(near, -1), np.full_like(value, -np.inf), np.zeros_like(new)
        near[row, nth], value[row, nth], new[row, nth] = to, val, is_new
        changed = int(is_new.sum())
    else:
        new = np.zeros_like(new)
    body = pickle.dumps((ids, vec, small, scale, near, value, new), 5)
    return pa.table({"block": left["block"], "body": pa.array([body], pa.binary()), "changed": pa.array([changed], pa.int64())})


GRAPH = MESSAGE + ", changed long"


def build(spark: SparkSession, scratch: Scratch, nodes: DataFrame, blocks: int, effort: Effort) -> DataFrame:
    """The graph's blocks, from a table of id and vec."""
    dim, n, kind = len(nodes.first().vec), nodes.count(), dict(nodes.dtypes)["vec"]

    def with_block(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_block(b.column(0).to_numpy(), blocks)), *b.columns], ["block", "id", "vec"])

    dealt = nodes.mapInArrow(with_block, f"block long, id long, vec {kind}")
    graph = scratch.write(dealt.groupBy("block").applyInArrow(lambda key, table: _fresh(effort.near, key, table), GRAPH), "graph0", "uncompressed")
    pivots = -(-n * effort.cells // SIDE) if n > SIDE else 1
    most = min(effort.cells, pivots)
    drawn = nodes.orderBy(F.xxhash64("id"), "id").limit(min(pivots, PIVOTS)).collect()
    way = _way(np.array([r.vec for r in drawn], np.float32 if kind == "array<float>" else float))
    sizes = {r.cell: r.n for r in nodes.mapInArrow(lambda b: _sizes(way, most, b), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    parts = np.array([max(1, -(-sizes.get(c, 0) // (3 * SIDE))) for c in range(len(way))], np.int64)
    dealt = nodes.mapInArrow(lambda b: _to_cells(way, parts, most, b), MESSAGE)
    # a node has as many messages as cells, so that they needn't be merged in a tree
    offers = dealt.groupBy("block").applyInArrow(_beside(blocks, effort.near if len(way) == 1 else effort.near // 2), MESSAGE)
    graph = _next(scratch, graph, offers, "start", "graph0")
    # nothing has been compared through the graph yet
    for k in count():
        if k == 0:
            graph = scratch.write(graph.mapInArrow(_all_new, GRAPH), "round0", "uncompressed")
            scratch.drop("start")
        asked = graph.mapInArrow(lambda b: _requests(blocks, b), MESSAGE)
        replies = graph.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_replies(k, effort.reverse), MESSAGE)
        told = graph.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_links(blocks, k), MESSAGE)
        offers = told.groupBy("block").applyInArrow(_compared(blocks, effort.offers, effort.near), MESSAGE)
        graph = _next(scratch, graph, _in_tree(offers, blocks, effort.near), f"round{k + 1}", f"round{k}")
        changed = graph.agg(F.sum("changed")).first()[0] or 0
        if changed <= SETTLED * effort.near * n:
            break
    return graph


def _all_new(batches):
    for b in batches:
        bodies = []
        for x in b.column(1):
            ids, vec, small, scale, near, value, _ = pickle.loads(x.as_py())
            bodies.append(pickle.dumps((ids, vec, small, scale, near, value, near >= 0), 5))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bodies, pa.binary()), b.column(2)], ["block", "body", "changed"])


def _next(scratch: Scratch, graph: DataFrame, offers: DataFrame, name: str, old: str) -> DataFrame:
    out = scratch.write(graph.groupBy("block").cogroup(offers.groupBy("block")).applyInArrow(_merged, GRAPH), name, "uncompressed")
    scratch.drop(old)
    return out


# A block of queries: ids, vectors (as given), and of each the nodes scored, scores, asked.
def _starting(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "body": pa.array([], pa.binary()), "open": pa.array([], pa.int64())})
    ids, vec = _got(left)[0][:2]
    own = np.unique(right["id"].to_numpy())
    x = vec[np.searchsorted(ids, own)]
    body = own, x, [np.array([q]) for q in own], [np.array([y @ y]) for y in x.astype(float)], [np.zeros(1, bool) for _ in own]
    return pa.table({"block": left["block"], "body": pa.array([pickle.dumps(body, 5)], pa.binary()), "open": pa.array([len(own)], pa.int64())})


def _turns(asked: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Places of the nodes that each query of a block asks next."""
    most = max(ASKED, HEARD // (len(asked) * width))
    return [np.flatnonzero(~a[:width])[:most] for a in asked]


def _frontier(blocks: int, width: int, batches):
    for b in batches:
        for block, body in zip(b.column("block").to_pylist(), b.column("body"), strict=True):
            *_, found, _, asked = pickle.loads(body.as_py())
            node = np.unique(np.concatenate([f[t] for f, t in zip(found, _turns(asked, width), strict=True)]))
            yield from _send(_block(node, blocks), np.full(len(node), block), node).to_batches()


def _neighbours(left: pa.Table, right: pa.Table) -> pa.Table:
    if not right.num_rows:
        return _send(np.zeros(0, np.int64))
    ids, near = (_got(left)[0][k] for k in (0, 4))
    block, node = _joined(_got(right))
    return _send(block, node, near[np.searchsorted(ids, node)])


def _unseen(blocks: int, width: int):
    """Has the nodes that aren't among a query's best scored where their vectors are, with the score that they have to reach."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return _send(np.zeros(0, np.int64))
        own, x, found, score, asked = _got(left)[0]
        node, near = _joined(_got(right))
        order = np.argsort(node)
        node, near = node[order], near[order]
        to = []
        for f, t in zip(found, _turns(asked, width), strict=True):
            w = np.setdiff1d(near[np.searchsorted(node, f[t])], f)
            to.append(w[w >= 0])
        beat = np.array([s[width - 1] if len(s) >= width else -np.inf for s in score])
        who, to = np.repeat(np.arange(len(own)), [len(w) for w in to]), np.concatenate(to)
        block = _block(to, blocks)
        order = np.argsort(block, kind="stable")
        block, who, to = block[order], who[order], to[order]
        bodies = []
        for lo, hi in _runs(block):
            start = _starts(who[lo:hi])
            each = who[lo:hi][start]
            bodies.append(pickle.dumps((own[each], x[each], beat[each], np.diff(np.append(start, hi - lo)).astype(np.int32), to[lo:hi]), 5))
        return pa.table({"block": pa.array(block[_starts(block)], pa.int64()), "body": pa.array(bodies, pa.binary())})

    return run


def _scores(blocks: int):
    """The nodes that reach the score asked for; a node that doesn't is never among that query's best."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return _send(np.zeros(0, np.int64))
        ids, vec = _got(left)[0][:2]
        out = []
        for own, x, beat, times, to in _got(right):
            at = np.repeat(np.arange(len(own)), times)
            v = vec[np.searchsorted(ids, to)].astype(float)
            s = np.einsum("ij,ij->i", v, x.astype(float)[at])
            fine = np.flatnonzero(s >= beat[at])
            out.append((own[at[fine]], to[fine], s[fine]))
        q, to, s = _joined(out)
        return _send(_block(q, blocks), q, to, s)

    return run


def _moved(width: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """Queries with what was scored for them; those asked for are marked as asked."""
    own, x, found, score, asked = _got(left)[0]
    for a, t in zip(asked, _turns(asked, width), strict=True):
        a[t] = True
    if right.num_rows:
        q, to, s = _joined(_got(right))
        order = np.argsort(q, kind="stable")
        q, to, s = q[order], to[order], s[order]
        first = _starts(q)
        for i, (lo, hi) in zip(np.searchsorted(own, q[first]), _runs(q), strict=True):
            f, v, a = np.concatenate([found[i], to[lo:hi]]), np.concatenate([score[i], s[lo:hi]]), np.concatenate([asked[i], np.zeros(hi - lo, bool)])
            best = np.lexsort((f, -v))[: width + SPARE]
            found[i], score[i], asked[i] = f[best], v[best], a[best]
    still = sum(not a[:width].all() for a in asked)
    return pa.table({"block": left["block"], "body": pa.array([pickle.dumps((own, x, found, score, asked), 5)], pa.binary()), "open": pa.array([still], pa.int64())})


STATE = MESSAGE + ", open long"


def _found(batches):
    for b in batches:
        for body in b.column(b.schema.get_field_index("body")):
            own, _, found, score, _ = pickle.loads(body.as_py())
            q = np.repeat(own, [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate(found)), pa.array(np.concatenate(score))], ["query", "node", "score"])


def search(spark: SparkSession, scratch: Scratch, graph: DataFrame, queries: DataFrame, blocks: int, width: int) -> DataFrame:
    """query, node, score of the best nodes found, from a table of the queries' node ids."""

    def with_block(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_block(b.column(0).to_numpy(), blocks)), b.column(0)], ["block", "id"])

    own = queries.mapInArrow(with_block, "block long, id long")
    state = scratch.write(graph.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_starting, STATE), "walk0", "uncompressed")
    for k in count():
        asked = state.mapInArrow(lambda b: _frontier(blocks, width, b), MESSAGE)
        near = graph.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_neighbours, MESSAGE)
        new = state.groupBy("block").cogroup(near.groupBy("block")).applyInArrow(_unseen(blocks, width), MESSAGE)
        scored = graph.groupBy("block").cogroup(new.groupBy("block")).applyInArrow(_scores(blocks), MESSAGE)
        state = scratch.write(state.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(lambda left, right: _moved(width, left, right), STATE), f"walk{k + 1}", "uncompressed")
        scratch.drop(f"walk{k}")
        if not state.agg(F.sum("open")).first()[0]:
            break
    return state.mapInArrow(_found, "query long, node long, score double")


def usable(vec: Column) -> Column:
    """Vectors without null or non-finite components that aren't zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0)


def nearest(spark: SparkSession, rows: DataFrame, is_query: Column, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's nearest other rows."""
    kind = "float" if dict(rows.dtypes)[vec_col] == "array<float>" else "double"
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: (x + F.lit(0.0)).cast(kind)).alias("vec"), is_query.alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    each = [_nearest(spark, clean.filter(F.size("vec") == r.n).distinct(), top) for r in clean.select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]
    if not each:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = each[0] if len(each) == 1 else reduce(DataFrame.unionByName, each)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _nearest(spark: SparkSession, clean: DataFrame, top: int) -> DataFrame:
    """query_id, vec_id, score among vectors of one length."""
    scratch = Scratch(spark)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "64"}):
        nodes = clean.groupBy("vec").agg(F.min("id").alias("node"))
        copies = scratch.write(clean.join(nodes, "vec").select("node", "id", "asks", "vec"), "copies")
        nodes = copies.filter("node = id").select(F.col("node").alias("id"), "vec")
        effort = Effort.of(n := nodes.count())
        blocks = max(1, -(-n * effort.near // (NODES * LEAST)))
        graph = build(spark, scratch, nodes, blocks, effort)
        found = scratch.write(search(spark, scratch, graph, copies.filter("asks").select(F.col("node").alias("id")).distinct(), blocks, effort.near), "found")
    first = Window.partitionBy("node").orderBy("id")
    some = copies.select("node", "id").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= top + 1).select("node", F.col("id").alias("vec_id"))
    asks = copies.filter("asks").select(F.col("node").alias("query"), F.col("id").alias("query_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    # the best of a query's node, with one to spare for the query's own row, serve all its copies
    each = found.join(some, "node").withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= top + 1)
    return asks.join(each, "query").filter("vec_id <> query_id").select("query_id", "vec_id", "score")


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
