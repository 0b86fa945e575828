"""Operator 9: SentencePiece encoding and decoding of merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, best score first and leftmost
among equals, and merges until no pair is a piece. Pieces never hold a space mark
behind their first character and never a newline, so texts fall into segments that
can't merge with each other; each worker remembers the segments it has met. In
every Arrow batch the new segments are checked against the sentencepiece library,
and a segment that differed would be taken from the library and counted.

Contract: ids of encode() with begin and end ids, no sampling; decoded is decode(ids).

* null and empty texts: the begin and end ids, and an empty decoded text.
* very long texts: encoded whole, segment by segment. Repeated rows: a row each.
* empty table: empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import tokenizer_path

#: Segments that a worker remembers; all are forgotten once there are more.
CACHED = 500_000
MARK = "▁"
#: A segment's letters, with what leads to them.
TAIL = re.compile(r"\W*[^\W\d_]+").match


class PieceBpe:
    """A merge-type vocabulary with byte fallback, and its codec."""

    def __init__(self, path: str, cached: int = CACHED):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kinds = {i: "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "byte" if sp.is_byte(i) else "piece" for i in range(n)}
        self.ids = {sp.id_to_piece(i): i for i in range(n) if kinds[i] == "piece"}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end, self.cached, self.differed = sp.bos_id(), sp.eos_id(), cached, 0
        self.seen: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(n)]
        inner = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in inner):
            raise ValueError("pieces of this vocabulary cross words")
        self.inner = {p[k : k + 2] for p in inner for k in range(len(p) - 1)}
        # an empty text shows whether the library puts a space mark ahead of a text
        if sp.encode("a") != sp.encode(" a")[-len(sp.encode("a")) :] and len(sp.encode(" a")) != len(sp.encode("a")) + 1:
            raise ValueError("this vocabulary strips or doesn't prefix white space")

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment by the agenda of adjacent pairs."""
        sym, n, score = list(segment), len(segment), self.score
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(sym[i] + sym[i + 1])
            if s is not None:
                agenda.append((-s, i, i + 1, len(sym[i]) + len(sym[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not sym[i] or not sym[j] or len(sym[i]) + len(sym[j]) != size:
                continue  # one side has merged since
            sym[i] += sym[j]
            sym[j] = ""
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                s = score.get(sym[i] + sym[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, k, len(sym[i]) + len(sym[k])))
            h = prev[i]
            if h >= 0:
                s = score.get(sym[h] + sym[i])
                if s is not None:
                    heapq.heappush(agenda, (-s, h, i, len(sym[h]) + len(sym[i])))
        out: list[int] = []
        for s in sym:
            if s:
                i = self.ids.get(s)
                out += [i] if i is not None else [self.bytes[b] for b in s.encode()]
        return out

    @staticmethod
    def segments(text: str) -> list[str]:
        """Parts that can't merge with each other. A part starts with a newline, then
        stands as it is, or else had one space mark ahead of it that isn't written."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " not in text and not text.startswith(" "):
            return text.replace("\n", " \n").split(" ")
        return [x[1:] if x[0] == " " else x for x in re.findall(r"\n[^ \n]*| +[^ \n]*", " " + text)]

    def _pieces(self, segment: str) -> bytes:
        """Ids of a segment that begins with a space mark or nothing, as bytes. What follows
        a letter that no piece joins to the mark behind it is a segment of its own."""
        at = TAIL(segment)
        if at and at.end() < len(segment) and segment[at.end() - 1 : at.end() + 1] not in self.inner:
            return self._part(segment[: at.end()]) + self._part(segment[at.end() :])
        return self._part(segment)

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= self.cached:
                self.parts.clear()
            found = self.parts[part] = b"".join(map(self.raw.__getitem__, self.merge(part)))
        return found

    def _learn(self, new: list[str]) -> None:
        """Remember new segments' ids, checked against the library."""
        line = int(self.bytes[10]).to_bytes(4, "little")
        marked = [s for s in new if s[:1] != "\n"]
        lone = [s for s in new if s[:1] == "\n"]
        own = {s: self._pieces(MARK + s.replace(" ", MARK)) for s in marked} | {s: line + self._pieces(s[1:]) for s in lone}
        # one text of all new segments: if the library gives the same ids for it, it does for each of them
        whole = " ".join(s for s in marked if s and " " not in s)
        if whole and not self._same(whole, [own[s] for s in marked if s and " " not in s]):
            self._mend(own)
        if lone and not self._same("a" + "".join(lone), [self._pieces(MARK + "a"), *(own[s] for s in lone)]):
            self._mend(own)
        for s in marked:
            if " " in s and not self._same(s, [own[s]]):
                self._mend(own)
        self.seen.update(own)

    def _same(self, text: str, own: list[bytes]) -> bool:
        return np.asarray(self.lib.encode(text), "<u4").tobytes() == b"".join(own)

    def _mend(self, own: dict[str, bytes]) -> None:
        """Take the library's ids wherever they differ, and count that."""
        head = self._pieces(MARK + "a")
        for s, ids in own.items():
            lib = np.asarray(self.lib.encode("a" + s if s[:1] == "\n" else s), "<u4").tobytes() if s else ids
            lib = lib[len(head) :] if s[:1] == "\n" else lib
            if lib != ids:
                self.differed += 1
                own[s] = lib

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, begin and end ids included."""
        begin, end = (int(x).to_bytes(4, "little") for x in (self.begin, self.end))
        parts = [self.segments(t) if t else [] for t in texts]
        out = []
        for own in parts:
            try:
                body = b"".join(map(self.seen.__getitem__, own))
            except KeyError:
                new = [s for s in set(own) if s not in self.seen]
                if len(self.seen) + len(new) > self.cached:
                    self.seen.clear()
                    new = list(set(own))
                self._learn(new)
                body = b"".join(map(self.seen.__getitem__, own))
            out.append(begin + body + end)
        return out

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        return [self.lib.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]


_LOADED: dict[str, PieceBpe] = {}


def _codec(path: str) -> PieceBpe:
    if path not in _LOADED:
        _LOADED[path] = PieceBpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded, differed: ids as little-endian unsigned 32-bit integers;
    differed: segments of the batch in which agenda and library differed."""

    def run(batches):
        codec = _codec(path)
        for b in batches:
            before = codec.differed
            ids = codec.encode_batch(b.column(1).to_pylist())
            text = codec.decode_batch(ids)
            n = [codec.differed - before] * len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(text, pa.string()), pa.array(n, pa.int64())], ["doc_id", "ids", "decoded", "differed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, ids binary, decoded string, differed long")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What encode_decode gives as digests alone, without carrying ids and texts back to the JVM."""

    def run(batches):
        codec = _codec(path)
        for b in batches:
            before = codec.differed
            ids = codec.encode_batch(b.column(1).to_pylist())
            text = codec.decode_batch(ids)
            cols = [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(t.encode()).hexdigest() for t in text], [codec.differed - before] * len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "differed"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, differed long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, schema)


def op9_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, tokenizer_path("piece_bpe_32k.model"))
