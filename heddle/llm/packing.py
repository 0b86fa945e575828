"""Operator 8: pattern packing by non-negative least squares.

Documents become token ids, then pieces of at most `length` tokens. The lengths'
histogram (at most `length` counts, however many documents there are) is all that
packing needs: patterns of up to three lengths that fill a sequence exactly are
enumerated, non-negative least squares fits their repeat counts to the histogram,
the counts are rounded within what is there, and the residual is packed best fit,
longest first. The plan then goes back to the pieces by their rank among those of
the same length.

Contract: a document is its ids without special tokens, then one end id. Only
documents longer than a sequence are cut, into whole sequences; the last piece may
be shorter. Every token lands in exactly one place; no sequence is over `length`.

* null and empty texts: the end id alone. Very long texts: many pieces.
* ties: pieces of one length are ranked by (id, piece); repeated rows are packed
  each; empty table: empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from .common import Scratch

#: Chunks of text that a worker remembers; all are forgotten once there are more.
CACHED = 400_000
#: Pieces of one length that one task ranks, and blocks of them that one task numbers.
RANKED, NUMBERED = 128, 1024
#: Rows of the plan that may be sent to every executor (24 bytes each); more are joined by a shuffle.
MOST_SENT = 200_000
NNLS_STEPS = 300
#: Patterns that a plan repeats, those with the largest counts; best fit packs what is left.
MOST_PATTERNS = 8192
#: Fixed value: the tokenizer file's own pattern for words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall


class WordIds:
    """Ids of whole texts by a tokenizers file, put together from remembered chunks.

    The tokenizer never looks across white space, so a text's ids are those of its
    chunks between white space. Texts with special tokens' marks, and characters
    whose normal form this can't tell at sight, go through the library itself.
    """

    def __init__(self, path: str, cached: int = CACHED, proven: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.cached, self.seen = Tokenizer.from_file(path), cached, {}
        self.differed, self.renewed = 0, False
        self.proven = ranks_suffice(path) if proven is None else proven
        self._rank(path)
        self.special = [t.content[:2] for t in self.tok.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if (text.isascii() or _latin(text)) and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            chunks = text.lower().split()
        else:
            chunks = [c for c in self.tok.normalizer.normalize_str(text).split(" ") if c]
            if any(self.tok.normalizer.normalize_str(c) != c for c in set(chunks)):
                return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            return b"".join(map(self.seen.__getitem__, chunks))
        except KeyError:
            new = [c for c in set(chunks) if c not in self.seen]
        if len(self.seen) + len(new) > self.cached:
            self.seen.clear()
            new = list(set(chunks))
        self._learn(new)
        if self.renewed:
            self.renewed = False
            self._learn(list(set(chunks)))
        return b"".join(map(self.seen.__getitem__, chunks))

    def _learn(self, new: list[str]) -> None:
        """Remember new chunks' ids: by ranked merges if the file's merges are proven to agree with them, else the library's.
        A few of every batch are checked against the library all the same; where one differs the library's
        ids are taken, from then on for all chunks."""
        one, ids = self.ranked.encode_single_piece, self.id_of
        plain = [c for c in new if c.isascii() or _latin(c)] if self.proven and not self.differed else []
        for c in plain:
            self.seen[c] = b"".join([ids[i] for w in WORDS(c) for i in one(w.encode() + b"\xff")])
        probe = plain[:: 1 + len(plain) // 4]
        rest = [c for c in new if c not in self.seen]
        for c, e in zip(probe + rest, self.tok.encode_batch_fast(probe + rest, add_special_tokens=False), strict=True):
            own = np.asarray(e.ids, "<u4").tobytes()
            self.differed += self.seen.setdefault(c, own) != own
        if plain and self.differed:  # what was remembered so far is in doubt too
            self.seen.clear()
            self.renewed = True

    def _rank(self, path: str) -> None:
        """The same merges as tiktoken's ranks, which are several times faster for words not met before.

        A word's end is the byte 0xFF, which no UTF-8 text has; merging it with the
        last byte comes first, then the file's merges in their order.
        """
        singles, merges = _merges(path)
        tokens = singles + [(a + b, n) for a, b, n in merges]
        ranks: dict[bytes, int] = {}
        for t, _ in tokens:
            ranks.setdefault(t, len(ranks))
        number = dict(reversed(tokens))
        self.id_of = [number[t].to_bytes(4, "little") for t in ranks]
        self.ranked = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe


def _merges(path: str) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, bytes, int]]]:
    """Of a tokenizers file: (bytes, id) of the single symbols, and (left, right, id) of the merges in order."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # byte-level BPE's printable bytes
    char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*shown}))}
    byte = {c: b for b, c in char.items()}
    raw = lambda t: bytes(byte[c] for c in t.removesuffix(suffix)) + b"\xff" * t.endswith(suffix)
    singles = [(bytes([b]), vocab[char[b]]) for b in range(256)] + [(bytes([b, 255]), vocab[char[b] + suffix]) for b in range(255)]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return singles, [(raw(a), raw(b), vocab[a + b]) for a, b in pairs]


def ranks_agree(merges: list[tuple[bytes, bytes, int]]) -> bool:
    """Whether merging any neighbours that make a token, lowest rank first, is merging by the listed pairs.

    It is if every token has one listed pair, and merging the token's own symbols by rank
    ends with that pair. For neighbours x, y in any text: no merge has crossed their outer
    ends yet, so what happened between those is what happens to the token xy alone, and
    that comes to two parts in one way only, the listed one. So both ways have the same
    candidates, of the same ranks, at every step.
    """
    rank = {a + b: k for k, (a, b, _) in enumerate(merges)}
    if len(rank) < len(merges):
        return False
    for a, b, _ in merges:
        whole = a + b
        end = len(whole) - whole.endswith(b"\xff")
        parts = [whole[k : k + 1] for k in range(end - 1)] + [whole[end - 1 :]]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], len(rank)))
            if parts[at] + parts[at + 1] not in rank:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if parts != [a, b]:
            return False
    return True


_PROVEN: dict[str, bool] = {}


def ranks_suffice(path: str) -> bool:
    """ranks_agree() of a file, told once a process."""
    if path not in _PROVEN:
        _PROVEN[path] = ranks_agree(_merges(path)[1])
    return _PROVEN[path]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_LOADED: dict[str, WordIds] = {}


def _word_ids(path: str, proven: bool) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path, proven=proven)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for every piece of every document."""
    end, proven = int(end_id).to_bytes(4, "little"), ranks_suffice(path)

    def cut(batches):
        ids_of = _word_ids(path, proven)
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = ids_of(t or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at : at + 4 * length]
                    rows.append((i, k, at // 4, len(own) // 4, zlib.crc32(own), own))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, schema)


def patterns(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (i, j, k), i >= j >= k >= 0, that sum to length; 0 stands for no document."""
    i, j = np.meshgrid(np.arange(length + 1), np.arange(length + 1), indexing="ij")
    k = length - i - j
    ok = (i >= j) & (j >= k) & (k >= 0) & (i > 0)
    return i[ok], j[ok], k[ok]


def nnls(rows: tuple[np.ndarray, ...], want: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """x >= 0 that brings the patterns' use of each length near want, by accelerated
    projected gradients; lengths weigh by the root of their counts."""
    weight = 1.0 / (want + 1.0)
    weight[0] = 0.0  # no document
    use = lambda x: sum(np.bincount(r, x, len(want)) for r in rows)
    grad = lambda e: sum(e[r] for r in rows)
    v = np.ones(len(rows[0]))
    for _ in range(12):  # the largest eigenvalue gives the step
        v = grad(weight * use(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(rows[0]))
    t = 1.0
    for _ in range(steps):
        z = np.maximum(0.0, y - grad(weight * (use(y) - want)) / (1.05 * top))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = z, z + (t - 1) / t2 * (z - x), t2
    return x


def best_fit(counts: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over a histogram: ((length, copies), ...), repeats.

    Bins that look alike are filled together, so the work depends on the lengths
    that occur and not on how many pieces have them.
    """
    size = len(counts) - 1
    spaces: list[int] = []
    bins: dict[int, list] = {}

    def put(space: int, what: tuple, n: int) -> None:
        if space not in bins:
            bins[space] = []
            insort(spaces, space)
        bins[space].append([what, n])

    for ell in range(size, 0, -1):
        left = int(counts[ell])
        while left:
            k = bisect_left(spaces, ell)
            if k == len(spaces):
                each = size // ell
                if left >= each:
                    put(size - each * ell, ((ell, each),), left // each)
                if left % each:
                    put(size - left % each * ell, ((ell, left % each),), 1)
                break
            space = spaces[k]
            what, n = group = bins[space][-1]
            each = space // ell
            m = min(n, left // each)
            if not m:
                each, m = left, 1
            group[1] -= m
            if not group[1]:
                bins[space].pop()
            if not bins[space]:
                del bins[space]
                spaces.pop(k)
            put(space - each * ell, (*what, (ell, each)), m)
            left -= m * each
    return [(what, n) for space in sorted(bins) for what, n in bins[space]]


def plan(counts: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns and repeats that hold exactly counts[n] pieces of each length n."""
    left = counts.astype(np.int64).copy()
    size = len(left) - 1
    rows = patterns(size)
    there = np.logical_and.reduce([(left[r] > 0) | (r == 0) for r in rows])
    rows = tuple(r[there] for r in rows)
    out = []
    if len(rows[0]):
        x = nnls(rows, left.astype(float))
        most = np.flatnonzero(x >= 0.5)
        for p in most[np.argsort(-x[most], kind="stable")][:MOST_PATTERNS]:
            what: dict[int, int] = {}
            for r in rows:
                if r[p]:
                    what[int(r[p])] = what.get(int(r[p]), 0) + 1
            n = min(int(x[p] + 0.5), *(int(left[k]) // m for k, m in what.items()))
            if n:
                out.append((tuple(what.items()), n))
                for k, m in what.items():
                    left[k] -= n * m
    return out + best_fit(left)


def pack(spark: SparkSession, cut: DataFrame, length: int = 2048) -> DataFrame:
    """Pieces with sequence_id and offset. cut: a table with doc_id, piece and length."""
    hist = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    counts = np.zeros(length + 1, np.int64)
    for k, n in hist.items():
        counts[k] = n
    taken, runs, first = dict.fromkeys(hist, 0), [], 0
    for what, n in plan(counts) if hist else []:
        at = 0
        for ell, each in what:
            runs.append((ell, taken[ell], taken[ell] + n * each, first, each, at))
            taken[ell] += n * each
            at += ell * each
        first += n
    places = spark.createDataFrame(runs, "length long, lo long, hi long, first long, each long, at long")
    # ranks among the pieces of a length: within blocks of a few hundred, then over the blocks
    many = F.ceil(F.create_map(*[F.lit(x) for k, n in sorted(hist.items()) for x in (int(k), int(n))] or [F.lit(0), F.lit(0)])[F.col("length")] / RANKED)
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), many))
    own = Window.partitionBy("length", "block").orderBy("doc_id", "piece")
    sizes = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    # sums ahead of a block: of the blocks in its part, then of the parts before it, so that no task numbers all blocks of a length
    before = lambda *by, order: F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    sizes = sizes.withColumn("part", F.floor(F.col("block") / NUMBERED))
    parts = sizes.groupBy("length", "part").agg(F.sum("n").alias("n")).select("length", "part", before("length", order="part").alias("parts_ahead"))
    ahead = sizes.withColumn("ahead", before("length", "part", order="block")).drop("n").join(parts, ["length", "part"])
    ahead = ahead.select("length", "block", (F.col("ahead") + F.col("parts_ahead")).alias("ahead"))
    ranked = dealt.withColumn("nth", F.row_number().over(own) - 1).join(ahead, ["length", "block"]).withColumn("rank", F.col("ahead") + F.col("nth")).drop("ahead", "nth", "block")
    found = ranked.join(F.broadcast(places) if len(runs) <= MOST_SENT else places, "length").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    return found.withColumns({
        "sequence_id": F.col("first") + F.floor(step / F.col("each")),
        "offset": F.col("at") + F.pmod(step, F.col("each")) * F.col("length"),
    }).drop("rank", "lo", "hi", "first", "each", "at")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = Scratch(spark).write(pieces(docs, tokenizer_path()), "pieces")
    return pack(spark, cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
