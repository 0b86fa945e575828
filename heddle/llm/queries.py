"""The corpus operators' queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import dedup_stream, hmm_lm, langid_zstd, nn_descent, packing, pii_feistel, piece_bpe, quality_kn, sharding, simhash_gray
from .common import arrow_limits, ship


def _ready(query):
    def run(spark, sf_dir):
        ship(spark)
        arrow_limits(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


_ALL = [
    pii_feistel.op1_feistel_pseudonyms,
    hmm_lm.op2_hidden_markov,
    dedup_stream.op3_streaming_dedup,
    langid_zstd.op4_compression_langid,
    nn_descent.op5_nn_descent,
    simhash_gray.op6_simhash_gray,
    sharding.op7_sampled_splitters,
    packing.op8_pattern_packing,
    piece_bpe.op9_piece_bpe,
    quality_kn.op10_kneser_ney_quality,
]
QUERIES = {q.__name__: _ready(q) for q in _ALL}
ORACLES = {"op3_streaming_dedup": dedup_stream.OP3_SQL}
