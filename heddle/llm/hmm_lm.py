"""Operator 2: a hidden Markov language model.

Texts are held out or trained on; tokens are lower-case (A-Z) words, then one end.
Word counts are sharded by word over all training texts. The model emits word w in
state s with P(class(w) | s) * P(w | class(w)): a word that makes up more than one
in OWN of all tokens has a class to itself, but for hash collisions; all others, and
words never seen, share the class of their last letters. P(w | class) is absolutely
discounted, and what the discount frees is the class's chance of an unseen word, so
the probabilities of all texts add up to one.

Baum-Welch runs over all training texts: each partition's forward and backward
recursions give expected counts by state, which are summed by class over all
partitions (at most OWN + ENDS classes, whatever the corpus). Rounds go on until the
likelihood settles. The exact likelihood of every text comes from the scaled forward
recursion. Starting values only are fitted on a bounded sample, of at most SEEDS unlike
training texts; where there are fewer than states, they are the priors, perturbed.

Texts travel once, as packs of word numbers; each pack gets the counts and classes
of its own words by a join, and is then read from the shared folder in each round.

Contract: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

* null and empty texts: the end alone. Very long texts are scored and trained on whole;
  the recursions of one of over PART tokens keep the states of one part at a time.
* no training text: every class is unseen, N is 0, all words unknown; scores stay finite.
* repeated rows count and are scored each; empty table: empty result. Other columns
  are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, trim

STATES = 8
#: Gain in log likelihood a token (nats) below which another round isn't made.
SETTLED = 0.01
OWN, ENDS = 1 << 16, 1 << 12
#: Letters at a word's end that name a shared class.
LETTERS = 3
PACK_BYTES = 24 << 20
SEEDS = 2000
#: Sequences and padded tokens that one recursion holds; tokens of a part of a long one.
WIDE, PADDED, PART = 512, 1 << 19, 1 << 16
STAY, SMOOTH = 0.9, 200.0
CLASSES = OWN + ENDS


def _held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2 if doc_id is not None else False


def _packed(batches):
    """Rows of two kinds: a pack's texts as numbers of its words, and each of its words."""
    z = zstandard.ZstdCompressor(level=3)
    task, k = TaskContext.get().partitionId() << 32, 0

    def out(number, ids, held, size, tokens):
        pack = task + k
        blob = z.compress(pickle.dumps((np.asarray(ids, object), np.asarray(held, bool), np.asarray(size, np.int64), np.concatenate(tokens))))
        names = ["pack", "local", "word", "n", "blob"]
        yield pa.RecordBatch.from_arrays([pa.array([pack]), pa.array([None], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.int64()), pa.array([blob], pa.binary())], names)
        n = np.zeros(len(number), np.int64)
        own = [t for t, h in zip(tokens, held, strict=True) if not h]
        if own:
            n += np.bincount(np.concatenate(own), minlength=len(n))
        words = list(number)
        for at in range(0, len(words), 1 << 16):
            w = words[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), pack)), pa.array(np.arange(at, at + len(w), dtype=np.int32)), pa.array(w, pa.binary()), pa.array(n[at : at + len(w)]), pa.nulls(len(w), pa.binary())], names)

    fresh = lambda: (defaultdict(count().__next__), [], [], [], [], 0)
    number, ids, held, size, tokens, used = fresh()
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = (t or b"").lower().split()  # bytes split at 0x20 and 0x09-0x0D alone
            words.append(b"")  # the end
            tokens.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            ids.append(i)
            held.append(_held_out(i))
            size.append(len(words))
            used += len(t or b"") + 16
            if used >= PACK_BYTES:
                yield from out(number, ids, held, size, tokens)
                number, ids, held, size, tokens, used = fresh()
                k += 1
                trim()
    if ids:
        yield from out(number, ids, held, size, tokens)
        number, ids, held, size, tokens, used = fresh()
    trim()


def _encoded(left: pa.Table, right: pa.Table) -> pa.Table:
    """A pack with the count and both hashes of each of its words."""
    local = right["local"].to_numpy()
    table = np.zeros((3, len(local)), np.int64)
    for k, name in enumerate(("c", "own", "ending")):
        table[k, local] = right[name].to_numpy()
    packs = [zstandard.ZstdDecompressor().decompress(x) for x in left["blob"].to_pylist()]
    z = zstandard.ZstdCompressor(level=3)
    rows = [z.compress(pickle.dumps((*pickle.loads(p), table[0], table[1].astype(np.int32), table[2].astype(np.int32)))) for p in packs]
    found = pa.table({"pack": left["pack"], "blob": pa.array(rows, pa.binary())})
    del packs, rows, table, local
    trim()
    return found


class Model:
    """Parameters of bounded size: what a task needs beside its packs."""

    def __init__(self, tokens: int, types: int, classes: np.ndarray):
        """classes: a row (class, tokens, types, types seen once and twice) for each class seen."""
        self.tokens, self.types = tokens, types
        self.total, self.kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        if len(classes):
            k = classes[:, 0].astype(int)
            self.total[k], self.kinds[k] = classes[:, 1], classes[:, 2]
            n1, n2 = classes[:, 3].sum(), classes[:, 4].sum()
        else:
            n1 = n2 = 0.0
        self.discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
        self.prior = (self.total + 1) / (self.total.sum() + CLASSES)
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), (1 - STAY) / max(1, STATES - 1))
        np.fill_diagonal(self.move, STAY)
        self.emit = np.tile(self.prior[:, None], STATES)

    def frequent(self, c: np.ndarray) -> np.ndarray:
        return (c > 0) & (c * OWN > self.tokens)

    def of_words(self, c, own, ending) -> tuple[np.ndarray, np.ndarray]:
        """Class and log P(word | class) of each word, given counts and hashes."""
        often = self.frequent(c)
        k = np.where(often, own, OWN + ending)
        total = self.total[k]
        seen = np.where(often, c / np.maximum(total, 1), (c - self.discount) / np.maximum(total, 1))
        new = np.where(total > 0, self.discount * self.kinds[k] / np.maximum(total, 1), 1.0)
        return k, np.log(np.where(c > 0, seen, new))

    def learn(self, counts: np.ndarray, move: np.ndarray | None = None, start: np.ndarray | None = None) -> None:
        """New parameters from expected counts."""
        self.emit = (counts + SMOOTH * self.prior[:, None]) / (counts.sum(0) + SMOOTH)
        if move is not None:
            self.move = (move + 1) / (move.sum(1, keepdims=True) + STATES)
            self.start = (start + 1) / (start.sum() + STATES)


def _groups(size: np.ndarray, wide: int = WIDE, padded: int = PADDED):
    """Sequences longest first, in groups of about the same length."""
    order, at = np.argsort(-size, kind="stable"), 0
    while at < len(order):
        n = int(max(1, min(wide, padded // max(1, size[order[at]]))))
        yield order[at : at + n]
        at += n


def _laid(k: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes by time and sequence, and how many sequences go on at each time."""
    step = np.arange(size[0])
    at = np.minimum(first[None, :] + step[:, None], len(k) - 1)
    return k[at], np.searchsorted(-size, -step, "left")


def forward(model: Model, k: np.ndarray, first: np.ndarray, size: np.ndarray, keep: bool = False):
    """Scaled forward recursion over sequences sorted longest first: log likelihood of
    each, and with keep all scaled states, scales and emissions."""
    x, going = _laid(k, first, size)
    kind = np.float32 if keep else np.float64
    emit, move = model.emit.astype(kind), model.move.astype(kind)
    ll = np.zeros(len(size))
    states = np.empty((*x.shape, STATES), kind) if keep else None
    scales = np.ones(x.shape, kind)
    a = model.start.astype(kind) * emit[x[0]]
    for t in range(len(x)):
        n = going[t]
        if t:
            a = (a[:n] @ move) * emit[x[t, :n]]
        s = a.sum(1)
        a = a / s[:, None]
        scales[t, :n] = s
        if keep:
            states[t, :n] = a
        if t % 1024 == 1023 or t == len(x) - 1:
            lo = t - t % 1024
            ll += np.log(scales[lo : t + 1].astype(float)).sum(0)
    return (ll, states, scales, x, going, emit, move) if keep else ll


def expected(model: Model, k: np.ndarray, first: np.ndarray, size: np.ndarray, counts: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> float:
    """Add the sequences' expected counts by forward and backward recursion; their log likelihood."""
    ll, states, scales, x, going, emit, move = forward(model, k, first, size, keep=True)
    back = np.ones((going[-1], STATES), np.float32)
    for t in range(len(x) - 1, -1, -1):
        n = going[t]
        if t < len(x) - 1:
            n1 = going[t + 1]
            w = emit[x[t + 1, :n1]] * back[:n1] / scales[t + 1, :n1, None]
            moves += states[t, :n1].T @ w
            back = np.ones((n, STATES), np.float32)
            back[:n1] = w @ move.T
        states[t, :n] *= back
    starts += states[0].sum(0)
    inside = np.arange(x.shape[1])[None, :] < going[:, None]
    own, g = x[inside], states[inside]
    for s in range(STATES):
        counts[:, s] += np.bincount(own, g[:, s], CLASSES)
    return float(ll.sum())


def expected_long(model: Model, k: np.ndarray, counts: np.ndarray, moves: np.ndarray, starts: np.ndarray, part: int) -> float:
    """The same for one long sequence: forward to find what each part follows on, then back through the parts."""

    def run(x, a):
        states, scales = np.empty((len(x), STATES)), np.empty(len(x))
        for t, c in enumerate(x):
            a = (model.start if a is None else a @ model.move) * model.emit[c]
            scales[t] = a.sum()
            a = states[t] = a / scales[t]
        return states, scales

    heads, a, ll = [], None, 0.0
    for lo in range(0, len(k), part):
        heads.append((lo, a))
        states, scales = run(k[lo : lo + part], a)
        a, ll = states[-1].copy(), ll + float(np.log(scales).sum())
    back = np.ones(STATES)
    for lo, head in reversed(heads):
        x = k[lo : lo + part]
        states, scales = run(x, head)
        own = np.empty_like(states)
        for t in range(len(x) - 1, -1, -1):
            own[t] = states[t] * back
            w = model.emit[x[t]] * back / scales[t]
            before = states[t - 1] if t else head
            if before is not None:
                moves += np.outer(before, w)
                back = model.move @ w
        for s in range(STATES):
            counts[:, s] += np.bincount(x, own[:, s], CLASSES)
        if head is None:
            starts += own[0]
    return ll


def _open(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _names() -> list[str]:
    return [f"s{k}" for k in range(STATES)]


def _baum_welch(shared, batches):
    """One row of expected counts for each class met in this task; rows -1 .. -STATES
    hold moves from each state, row -STATES - 1 starts, row -STATES - 2 the log likelihood."""
    model: Model = shared.value
    counts, moves, starts, ll = np.zeros((CLASSES, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES), 0.0
    for b in batches:
        for blob in b.column(b.schema.get_field_index("blob")):
            ids, held, size, tokens, c, own, ending = _open(blob.as_py())
            k = model.of_words(c, own, ending)[0][tokens]
            first = np.cumsum(size) - size
            first, size = first[~held], size[~held]
            for f, n in zip(first[size > PART], size[size > PART], strict=True):
                ll += expected_long(model, k[f : f + n], counts, moves, starts, PART)
            first, size = first[size <= PART], size[size <= PART]
            for g in _groups(size):
                ll += expected(model, k, first[g], size[g], counts, moves, starts)
    trim()
    at = np.flatnonzero(counts.any(1))
    key = np.concatenate([at, -1 - np.arange(STATES), [-STATES - 1, -STATES - 2]])
    rows = np.concatenate([counts[at], moves * model.move, starts[None], np.full((1, STATES), ll)])
    for lo in range(0, len(key), 1 << 15):
        yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + (1 << 15)]), *(pa.array(rows[lo : lo + (1 << 15), s]) for s in range(STATES))], ["key", *_names()])


def _drawn(shared, share, batches):
    """Classes and their counts of a share of the training texts, by a hash of id and classes, and of each pack's first by it."""
    model: Model = shared.value
    for b in batches:
        for blob in b.column(b.schema.get_field_index("blob")):
            ids, held, size, tokens, c, own, ending = _open(blob.as_py())
            k, first = model.of_words(c, own, ending)[0][tokens].astype("<i4"), np.cumsum(size) - size
            rows = [(zlib.crc32(k[f : f + n].tobytes(), zlib.crc32(f"seed {i}".encode())), f, n) for i, h, n, f in zip(ids.tolist(), held.tolist(), size.tolist(), first.tolist(), strict=True) if not h]
            least = min(rows)[0] if rows else 0
            out = [(d, *np.unique(k[f : f + n], return_counts=True)) for d, f, n in rows if d < share * 2**32 or d == least]
            cols = [o[0] for o in out], [o[1].astype("<i4").tobytes() for o in out], [o[2].astype("<i4").tobytes() for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["draw", "at", "many"])


def seeded(rows: list[tuple[np.ndarray, np.ndarray]], prior: np.ndarray) -> np.ndarray:
    """Counts by class and state of a bounded sample, by k-means over its texts' root
    frequencies; of fewer texts than states, the priors times fixed random numbers."""
    if len(rows) < STATES:
        return 1e4 * prior[:, None] * np.random.default_rng(0).uniform(0.5, 1.5, (CLASSES, STATES))
    dense = np.zeros(CLASSES)
    for at, many in rows:
        dense[at] += many
    top = np.argsort(-dense, kind="stable")[:3000]
    place = np.full(CLASSES, -1)
    place[top] = np.arange(len(top))
    x = np.zeros((len(rows), len(top)), np.float32)
    for i, (at, many) in enumerate(rows):
        ok = place[at] >= 0
        x[i, place[at[ok]]] = np.sqrt(many[ok] / many.sum())
    best, best_far = None, np.inf
    for seed in range(4):
        rng = np.random.default_rng(seed)
        centre = x[[rng.integers(len(x))]]
        while len(centre) < STATES:
            far = np.maximum(0, 2 - 2 * (x @ centre.T).max(1)) ** 2 + 1e-9
            centre = np.concatenate([centre, x[[rng.choice(len(x), p=far / far.sum())]]])
        for _ in range(12):
            own = (x @ centre.T).argmax(1)
            centre = np.stack([x[own == s].mean(0) if (own == s).any() else centre[s] for s in range(STATES)])
            centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
        far = float((1 - (x @ centre.T).max(1)).sum())
        if far < best_far:
            best, best_far = own, far
    counts = np.zeros((CLASSES, STATES))
    for s, (at, many) in zip(best, rows, strict=True):
        counts[at, s] += many
    return counts


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(shared, batches):
    model: Model = shared.value
    for b in batches:
        for blob in b.column(b.schema.get_field_index("blob")):
            ids, held, size, tokens, c, own, ending = _open(blob.as_py())
            k, lw = model.of_words(c, own, ending)
            k, first = k[tokens], np.cumsum(size) - size
            ll = np.add.reduceat(lw[tokens], first)
            for g in _groups(size):
                ll[g] += forward(model, k, first[g], size[g])
            base = np.add.reduceat(np.log10(c + 1.0)[tokens], first) - size * np.log10(float(model.tokens + model.types + 1))
            known = np.add.reduceat((c > 0)[tokens].astype(np.int64), first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.tolist(), pa.int64()), pa.array(held), pa.array(size), pa.array(known), pa.array(np.full(len(ids), model.tokens)), pa.array(base), pa.array(ll / np.log(10))],
                [x.split()[0] for x in RESULT.split(", ")],
            )


def train(spark: SparkSession, scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The trained model, and the packs that _scored reads."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_packed, "pack long, local int, word binary, n long, blob binary")
    rows = scratch.write(rows, "packs")
    words = rows.filter("local IS NOT NULL").select("pack", "local", "word", "n")
    # sums of a word are partial in every task, so a common word is a row of each; the join is one that adaptive execution splits
    totals = words.groupBy("word").agg(F.sum("n").alias("c")).select(
        "word", "c",
        F.pmod(F.xxhash64("word"), F.lit(OWN)).cast("int").alias("own"),
        F.pmod(F.xxhash64(F.substring("word", -LETTERS, LETTERS)), F.lit(ENDS)).cast("int").alias("ending"),
    )
    totals = scratch.write(totals, "totals")
    counted = scratch.write(words.select("pack", "local", "word").join(totals, "word").drop("word"), "counted")
    kinds = totals.filter("c > 0")
    tokens, types = (int(x or 0) for x in kinds.agg(F.sum("c"), F.count("*")).first())
    often = F.col("c") * OWN > tokens
    cls = kinds.groupBy(F.when(often, F.col("own")).otherwise(F.col("ending") + OWN).alias("k")).agg(
        F.sum("c").alias("c"), F.count("*").alias("n"), F.sum(F.when((F.col("c") == 1) & ~often, 1).otherwise(0)).alias("n1"), F.sum(F.when((F.col("c") == 2) & ~often, 1).otherwise(0)).alias("n2")
    )
    model = Model(tokens, types, cls.toPandas().to_numpy(float))  # at most CLASSES rows
    packs = rows.filter("blob IS NOT NULL").select("pack", "blob").groupBy("pack").cogroup(counted.select("pack", "local", "c", "own", "ending").groupBy("pack")).applyInArrow(_encoded, "pack long, blob binary")
    packs = scratch.write(packs, "encoded", "uncompressed")
    for name in ("packs", "counted", "totals"):
        scratch.drop(name)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # from here on a row is a whole pack
    texts = docs.count()
    shared = spark.sparkContext.broadcast(model)
    share = min(1.0, 4 * SEEDS / max(1, texts))
    sample = packs.mapInArrow(lambda b: _drawn(shared, share, b), "draw long, at binary, many binary").distinct().orderBy("draw", "at", "many").limit(SEEDS).toPandas()
    if not len(sample):
        return model, packs
    model.learn(seeded([(np.frombuffer(a, "<i4"), np.frombuffer(m, "<i4")) for a, m in zip(sample["at"], sample["many"], strict=True)], model.prior))
    reached = -np.inf
    while True:
        shared = spark.sparkContext.broadcast(model)
        sums = packs.mapInArrow(lambda b, s=shared: _baum_welch(s, b), "key long, " + ", ".join(f"{n} double" for n in _names()))
        found = sums.groupBy("key").agg(*(F.sum(n).alias(n) for n in _names())).toPandas()  # at most CLASSES + STATES + 2 rows
        key, value = found["key"].to_numpy(), found[_names()].to_numpy(float)
        counts = np.zeros((CLASSES, STATES))
        counts[key[key >= 0]] = value[key >= 0]
        by = {int(k): v for k, v in zip(key[key < 0], value[key < 0], strict=True)}
        model.learn(counts, np.stack([by[-1 - s] for s in range(STATES)]), by[-STATES - 1])
        before, reached = reached, by[-STATES - 2][0] / tokens
        if reached - before < SETTLED:
            break
    return model, packs


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    scratch = Scratch(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        model, packs = train(spark, scratch, docs, id_col, text_col)
        shared = spark.sparkContext.broadcast(model)
        return scratch.write(packs.mapInArrow(lambda b: _scored(shared, b), RESULT), "scored")
    finally:
        spark.conf.set(key, before)
        scratch.drop("encoded")


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
