"""Operator 4: language identification by compression.

Each language gets a zstandard raw-content dictionary of passages drawn from its
training texts. A text is compressed with every dictionary; the language whose
dictionary makes it smallest is predicted, and the prediction is rejected where the
margin over the second is narrow.

The dictionaries are fitted on a bounded sample: about `passages` passages of
`passage` characters for each language, from anywhere in its texts, drawn by a hash of id and
text; rows that repeat both count once. Each language's dictionary, 128 KiB with these
parameters, goes to every executor.

Contract: lang_pred is a learned value, or `und` for a null text or one without a
letter; score (0 to 1) is the saving over the second-best language, per cent of it
scaled by 1 / FULL; rejected tells narrow margins, with lang_pred still the best.

* very long texts are compressed whole, in chunks whose sizes add up.
* ties go to the language with more training texts, then by name.
* no training text: everything is `und`. Empty table: empty result. Repeated rows
  are predicted each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PASSAGES, PASSAGE = 128, 1024
LEVEL, CHUNK = 6, 8192
#: A saving of this share over the second-best language counts as certain.
FULL = 0.10
#: Below this share the prediction is rejected.
NARROW = 0.004


def dictionaries(train: DataFrame, passages: int = PASSAGES, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, content) by falling number of training texts; at most about passages * passage characters each."""
    text = F.col(text_col)
    usable = train.filter(text.isNotNull() & F.col(lang_col).isNotNull() & (F.length(text) > 0))
    draw = F.xxhash64(F.col(id_col), text, F.lit("passage"))
    found = usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"), F.approx_count_distinct(draw).alias("unlike")).collect()
    if not found:
        return []
    counts = {r.lang: r.n for r in found}
    share = F.create_map(*[F.lit(x) for r in found for x in (r.lang, min(1.0, passages / max(1, r.unlike - 1)))])
    taken = usable.filter(F.pmod(draw, F.lit(1 << 40)) / float(1 << 40) < share[F.col(lang_col)])
    at = F.lit(1) + F.pmod(F.xxhash64(draw), F.greatest(F.lit(1), F.length(text) - passage)).cast("int")
    rows = taken.select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.substring(text, at, F.lit(passage)).alias("p")).distinct().collect()
    parts: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(rows, key=lambda r: (r.draw, r.p)):
        parts[r.lang].append(r.p.lower())
    order = sorted(counts, key=lambda k: (-counts[k], k))
    return [(k, "\n".join(parts[k]).encode()) for k in order]


class Compressors:
    def __init__(self, contents: list[tuple[str, bytes]], level: int = LEVEL):
        self.each = []
        for lang, content in contents:
            if len(content) < 8:  # too little for the library to take it as a dictionary
                content = content.ljust(8, b"\n")
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.each.append((lang, zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False)))

    def sizes(self, text: str) -> list[tuple[int, int, str]]:
        """(bytes, place by training texts, language), smallest first."""
        raw = text.lower().encode()
        chunks = [raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK)]
        return sorted((sum(len(c.compress(x)) for x in chunks), k, lang) for k, (lang, c) in enumerate(self.each))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not any(map(str.isalpha, text)) or not self.each:
            return "und", 0.0, True
        found = self.sizes(text)
        if len(found) == 1:
            return found[0][2], 1.0, False
        saved = (found[1][0] - found[0][0]) / found[1][0]
        return found[0][2], min(1.0, saved / FULL), saved < NARROW


def identify(spark: SparkSession, docs: DataFrame, contents: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """id, the kept columns, lang_pred, score, rejected. The text alone decides."""
    shared = spark.sparkContext.broadcast(contents)  # bounded by the sample's parameters
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("_text"))

    def run(batches):
        own = Compressors(shared.value)
        for b in batches:
            lang, score, rejected = zip(*(own.predict(t) for t in b.column(b.num_columns - 1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            cols = [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{n}` {t}" for n, t in base.dtypes[:-1]) + ", lang_pred string, score double, rejected boolean"
    return base.mapInArrow(run, schema)


def held_out(of: int, left: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == left


def op4_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = dictionaries(docs.filter(~held_out(3, 1)))
    return identify(spark, docs, learned, keep=(held_out(3, 1).alias("held_out"),))
