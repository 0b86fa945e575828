"""Operator 10: quality by an interpolated modified Kneser-Ney n-gram model.

The model is one of characters, of order ORDER, trained on trusted texts (labelled
good, but for a calibration fold). A character n-gram is one long: 12 bits for each
symbol. A character below DIRECT is one symbol, any other is two, one of its upper and one of
its lower bits, so that no two texts are the same symbols; starts and ends have
symbols of their own. Documents are read once and written in packs of some tens of MB, dealt by
pack; the roles of its rows meet a pack where it lies, and it names its distinct
n-grams once. Counts, discounts, context totals and back-off weights are sharded
tables keyed by n-gram, joined order by order; the packs' n-grams are joined with
the result, and each pack meets its own n-grams' probabilities, so that no table of
the corpus is ever sent everywhere, and no text is shuffled.

A document's perplexity is drawn towards its language's median with the weight of
PRIOR signs, so that a short text is judged on what it shows. A language's threshold
is a quantile of its calibration fold's perplexities. A fold too small to hold that
quantile is helped by the others: the threshold is then no less than the bound within
which the next text falls with that probability (Student's t), by the fold's mean and a
spread drawn towards that of all folds with the weight of LENT texts. Documents above
it are rejected.

Contract: doc_id, lang, n_chars, perplexity, threshold, kept, held_back (calibration fold) for every row.

* null and empty texts: only the end sign is scored. Very long texts: scored whole.
* a null language is a language of its own; one without calibration texts takes the
  quantile over all of them, widened likewise. No trusted text at all: everything is
  kept, with null perplexity and threshold. Where no language has two calibration
  texts nothing tells a spread, and everything is kept, with null threshold.
* ties at the threshold are kept. Repeated rows are scored each; a repeated label
  counts once. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, settings, trim

ORDER, BITS = 5, 12
START, END, SIGNS = 2, 3, 4
#: Code points below it are one symbol each; symbols of the upper 11 and lower 10 bits of all others come behind them.
DIRECT = 1980
LEAD, TRAIL = SIGNS + DIRECT, SIGNS + DIRECT + (0x110000 >> 10)
PACK_BYTES = 32 << 20
#: Signs that one step of counting or scoring holds.
STEP = 1 << 19
PRIOR = 200
QUANTILE = 0.997
#: Texts that the spread over all languages counts for, in that of a language with a small fold.
LENT = 10
#: Each CALIBRATE-th trusted text is kept from training, for the thresholds.
CALIBRATE = 5
#: Languages whose thresholds, a row each, may be sent to every executor; more are joined by a shuffle.
MOST_LANGUAGES = 10_000


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes of the texts' symbols and ends, one after another, and how many each text has."""
    raw = np.frombuffer("".join(["\0" * (ORDER - 1) + t + "\0" for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    size = np.array([len(t) + ORDER for t in texts])
    last = np.cumsum(size) - 1
    first = last + 1 - size
    sym = raw + SIGNS
    sym[last] = END
    for k in range(ORDER - 1):
        sym[first + k] = START
    wide = raw >= DIRECT
    if wide.any():
        each = 1 + wide
        at = np.cumsum(each)[wide] - 2
        size = np.add.reduceat(each, first)
        first = np.cumsum(size) - size
        sym = np.repeat(sym, each)
        sym[at], sym[at + 1] = LEAD + (raw[wide] >> 10), TRAIL + (raw[wide] & 1023)
    out = np.zeros(len(sym), np.int64)
    for k in range(ORDER):
        out[ORDER - 1 :] |= sym[ORDER - 1 - k : len(sym) - k] << (BITS * k)
    inside = np.ones(len(sym), bool)
    for k in range(ORDER - 1):
        inside[first + k] = False
    return out[inside], size - (ORDER - 1)


def _steps(texts: list[str]):
    """Lists of texts with about STEP signs."""
    own, n = [], 0
    for t in texts:
        own.append(t)
        n += len(t) + ORDER
        if n >= STEP:
            yield own
            own, n = [], 0
    if own:
        yield own


def _packs(batches):
    """A row for each pack of about PACK_BYTES of this task's texts: its number, their ids, and [(id, lang, text), ...]."""
    z = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(3, window_log=25, enable_ldm=True))
    own, size, k, task = [], 0, 0, TaskContext.get().partitionId() << 32

    def out():
        ids, raw = pa.array([[r[0] for r in own]], pa.list_(pa.int64())), z.compress(pickle.dumps(own))
        return pa.RecordBatch.from_arrays([pa.array([task + k]), ids, pa.array([raw], pa.binary())], ["pack", "ids", "rows"])

    for b in batches:
        for i, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own.append((i, lang, text or ""))
            size += len(own[-1][2]) + 16
            if size >= PACK_BYTES:
                yield out()
                own, size, k = [], 0, k + 1
                trim()
    if own:
        yield out()
    own = []
    trim()


def _rows(packs: pa.Table) -> list[tuple]:
    """The texts of a pack, which a group of them has one of."""
    return [r for raw in packs["rows"] for r in pickle.loads(zstandard.ZstdDecompressor().decompress(raw.as_py()))]


def _grams(packs: pa.Table, roles: pa.Table) -> pa.Table:
    """A pack's distinct n-grams, rising, each less the one before it, and how often each is in training texts."""
    seen, train, counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    texts = [r[2] for r in _rows(packs)]
    role = dict(zip(roles["nth"].to_pylist(), roles["role"].to_pylist(), strict=True))
    for own in _steps([t for k, t in enumerate(texts) if role.get(k) == 1]):
        g, n = np.unique(codes(own)[0], return_counts=True)
        train, at = np.unique(np.concatenate([train, g]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(train)).astype(np.int64)
    for own in _steps([t for k, t in enumerate(texts) if role.get(k) != 1]):
        seen = np.union1d(seen, codes(own)[0])
    every = np.union1d(seen, train)
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, train)] = counts
    found = pa.table({"pack": packs["pack"][:1], "grams": pa.array([np.diff(every, prepend=0).tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary())})
    del texts, every, seen, train, n
    trim()
    return found


def _named(batches):
    """A row for each n-gram of a pack."""
    for b in batches:
        for pack, grams, counts in zip(*(b.column(c) for c in ("pack", "grams", "counts")), strict=True):
            g, n = np.cumsum(np.frombuffer(grams.as_py(), np.int64)), np.frombuffer(counts.as_py(), np.int64)
            for at in range(0, len(g), 1 << 16):
                own = g[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), pack.as_py())), pa.array(own), pa.array(n[at : at + (1 << 16)])], ["pack", "gram", "n"])


def _row_hash(text: str) -> int:
    """What xxhash64() gives in SQL."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


SCORED = "doc_id long, lang string, role int, n_chars long, nll double, row_hash long"


def _score(packs: pa.Table, own: pa.Table) -> pa.Table:
    """A pack's texts by its n-grams' values; rows of negative n-grams are roles, by the text's place."""
    gram, value = own["gram"].to_numpy(), own["nll"].to_numpy()
    role = {int(-1 - g): int(v) for g, v in zip(gram[gram < 0], value[gram < 0], strict=True)}
    order = np.argsort(gram)[len(role) :]
    gram, value = gram[order], value[order].astype(float)
    rows, nll = _rows(packs), []
    for texts in _steps([r[2] for r in rows]):
        c, size = codes(texts)
        nll += np.add.reduceat(value[np.searchsorted(gram, c)], np.cumsum(size) - size).tolist()
    cols = [r[0] for r in rows], [r[1] for r in rows], [role.get(k, 0) for k in range(len(rows))], [len(r[2]) + 1 for r in rows], nll, [_row_hash(r[2]) for r in rows]
    kinds = pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64()
    found = pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "lang", "role", "n_chars", "nll", "row_hash"])
    del rows, cols, gram, value, order
    trim()
    return found


def kneser_ney(scratch: Scratch, counts: DataFrame, needed: DataFrame) -> DataFrame:
    """gram, nll of every needed n-gram, by the counts of the highest order."""
    low = lambda c, n: F.col(c).bitwiseAND((1 << (BITS * n)) - 1)
    tables, cur = {}, counts
    for n in range(ORDER, 0, -1):
        cur = scratch.write(cur, f"count{n}")
        of = {r.c: r.n for r in cur.filter("c < 5").groupBy("c").agg(F.count("*").alias("n")).collect()}
        n1, n2, n3, n4 = (float(of.get(k, 0)) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        raw = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        d1, d2, d3 = (min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1))
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        ctx = F.shiftright("gram", BITS)
        sums = scratch.write(cur.groupBy(ctx.alias("ctx")).agg(F.sum("c").alias("total"), F.sum(d).alias("kept")), f"ctx{n}")
        tables[n] = (cur.withColumn("less", F.col("c") - d), sums)
        cur = cur.groupBy(low("gram", n - 1).alias("gram")).agg(F.count("*").cast("long").alias("c"))
    wanted = {ORDER: needed}
    for n in range(ORDER - 1, 0, -1):
        wanted[n] = wanted[n + 1].select(low("gram", n).alias("gram")).distinct()
    p = None
    for n in range(1, ORDER + 1):
        less, sums = tables[n]
        q = wanted[n].withColumns({"ctx": F.shiftright("gram", BITS), "rest": low("gram", n - 1)})
        q = q.join(less.select("gram", "less"), "gram", "left").join(sums, "ctx", "left")
        q = q.withColumn("below", F.lit(1.0 / (1 << BITS))) if p is None else q.join(p.select(F.col("gram").alias("rest"), F.col("p").alias("below")), "rest")
        mix = F.when(F.col("total").isNull(), F.col("below")).otherwise((F.coalesce("less", F.lit(0.0)) + F.col("kept") * F.col("below")) / F.col("total"))
        p = scratch.write(q.select("gram", mix.alias("p")), f"p{n}")
        for name in (f"count{n}", f"ctx{n}", f"p{n - 1}"):
            scratch.drop(name)
    return p.select("gram", (-F.log("p")).cast("float").alias("nll"))


def roles_of(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """pack, nth, role of trusted texts: 1 for training, 2 for calibration. ids: a table of pack, nth and doc_id."""
    trusted = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    fold = F.when(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(CALIBRATE)) == 0, 2).otherwise(1)
    return ids.join(trusted, "doc_id").select("pack", "nth", fold.alias("role"))


def _beyond(quantile: float, df: Column) -> Column:
    """Student's t quantile, by its expansion about the normal one."""
    z = NormalDist().inv_cdf(quantile)
    terms = z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return sum((F.lit(t) / F.pow(df, F.lit(k)) for k, t in enumerate(terms[1:], 1)), F.lit(terms[0]))


def perplexities(spark: SparkSession, docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The contract's columns and row_hash, a hash of the text that tells rows of one id apart."""
    scratch = Scratch(spark)
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "200"}):
        packs = docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(_packs, "pack long, ids array<long>, rows binary")
        packs = scratch.bucketed(packs, "packs", "pack", buckets_for(spark, docs, PACK_BYTES // 2), "uncompressed")
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):  # a row is a whole pack's
        roles = scratch.write(roles_of(packs.select("pack", F.posexplode("ids").alias("nth", "doc_id")), labels), "roles")
        texts = packs.select("pack", "rows").groupBy("pack")
        grams = scratch.write(texts.cogroup(roles.groupBy("pack")).applyInArrow(_grams, "pack long, grams binary, counts binary"), "grams")
        grams = grams.mapInArrow(_named, "pack long, gram long, n long")
        every = scratch.write(grams.groupBy("gram").agg(F.sum("n").alias("c")), "every")
    trained = not every.filter("c > 0").isEmpty()
    nll = kneser_ney(scratch, every.filter("c > 0"), every.select("gram")) if trained else every.select("gram", F.lit(None).cast("float").alias("nll"))
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
        own = scratch.write(grams.select("pack", "gram").join(nll, "gram").select("pack", "gram", "nll"), "own")
    for name in ("grams", "every", f"p{ORDER}") if trained else ("grams", "every"):
        scratch.drop(name)
    own = own.unionByName(roles.select("pack", (-1 - F.col("nth").cast("long")).alias("gram"), F.col("role").cast("float").alias("nll")))
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "20000"}):
        scored = scratch.write(texts.cogroup(own.groupBy("pack")).applyInArrow(_score, SCORED), "scored")
    for name in ("packs", "own", "roles"):
        scratch.drop(name)
    base = scored.withColumn("lang_key", F.coalesce("lang", F.lit("")))
    fold = base.filter("role = 2")
    if not trained or fold.isEmpty():
        none = F.lit(None).cast("double")
        return scored.select("doc_id", "lang", "n_chars", (F.exp(F.col("nll") / F.col("n_chars")) if trained else none).alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"), (F.col("role") == 2).alias("held_back"), "row_hash")
    # one row a language: sent to every executor while they are few
    few = F.broadcast if base.select("lang_key").distinct().count() <= MOST_LANGUAGES else lambda df: df
    middle = fold.groupBy("lang_key").agg(F.percentile_approx(F.col("nll") / F.col("n_chars"), 0.5, 10000).alias("middle"))
    whole = float(fold.agg(F.percentile_approx(F.col("nll") / F.col("n_chars"), 0.5, 10000)).first()[0])
    drawn = lambda df: df.join(few(middle), "lang_key", "left").withColumn("drawn", (F.col("nll") + PRIOR * F.coalesce("middle", F.lit(whole))) / (F.col("n_chars") + PRIOR))
    own = drawn(fold).groupBy("lang_key").agg(
        F.percentile_approx("drawn", quantile, 10000).alias("own"), F.count("*").alias("n"), F.avg("drawn").alias("mean"), ((F.count("*") - 1) * F.coalesce(F.var_samp("drawn"), F.lit(0.0))).alias("within")
    )
    own = scratch.write(own, "folds")
    # over all languages: the spread within them, and for those without a fold that of all texts
    pool = own.agg(F.sum("within").alias("within"), F.sum(F.col("n") - 1).alias("df")).first()
    every = drawn(fold).agg(F.percentile_approx("drawn", quantile, 10000).alias("own"), F.count("*").alias("n"), F.avg("drawn").alias("mean"), F.var_samp("drawn").alias("var"))
    lent = min(LENT, pool.df)
    df = F.lit(lent) + F.col("n") - 1
    known = pool.within / pool.df if pool.df else 0.0
    spread = F.sqrt((F.lit(lent * known) + F.col("within")) / df)
    least = F.col("mean") + _beyond(quantile, df) * spread * F.sqrt(1 + 1 / F.col("n"))
    enough = F.col("n") * (1 - quantile) >= 1
    widened = lambda least: F.when(enough, F.col("own")).otherwise(F.greatest("own", least))
    cuts = own.select("lang_key", (widened(least) if pool.df else F.lit(None).cast("double")).alias("cut"))
    over = every.select(widened(F.col("mean") + _beyond(quantile, F.col("n") - 1) * F.sqrt("var") * F.sqrt(1 + 1 / F.col("n")))).first()[0] if pool.df else None
    cut = F.coalesce("cut", F.lit(over).cast("double"))
    return drawn(base).join(few(cuts), "lang_key", "left").select(
        "doc_id", "lang", "n_chars", F.exp("drawn").alias("perplexity"), F.exp(cut).alias("threshold"), F.coalesce(F.col("drawn") <= cut, F.lit(True)).alias("kept"), (F.col("role") == 2).alias("held_back"), "row_hash"
    )


def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return perplexities(spark, docs, labels).drop("row_hash")
