"""The ten operators against plain versions, with nulls, empty and long texts, ties,
repeated rows, empty tables and columns of clashing names."""

import datetime
import functools
import hashlib
import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heddle.llm import dedup_stream, hmm_lm, langid_zstd, nn_descent, packing, pii_feistel, piece_bpe, quality_kn, sharding, simhash_gray

from . import brute

RNG = np.random.default_rng(7)
WORDS = ["".join(RNG.choice(list("abcdefghilmnorstuéü"), RNG.integers(2, 10))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    out = [(k, prose(int(RNG.integers(1, 120)))) for k in range(60)]
    out += [(60, None), (61, ""), (62, "  \n\t "), (63, None), (64, "word " * 30000), (65, out[3][1]), (66, out[3][1].replace(" ", "\n\t ")), (67, out[4][1].upper())]
    near = out[5][1].split() + prose(80).split()
    out += [(70, " ".join(near)), (71, " ".join([*near[:-1], "other"])), (72, " ".join(["other", *near[1:]]))]
    out += [(80, "x y z"), (80, "x y z"), (81, "x y"), (82, "日本語 <|endoftext|> it's\x00 \x1c ▁  a  b")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(i, t, ["en", "fr", None][k % 3], "src", len(t or ""), 1, "h", 2.0, b"x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, shard int, fp string, range double, digest binary").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


# 1 ---------------------------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


def test_pii(spark, empty):
    cases = {
        "4111111111111111": lambda s: luhn(s) and s[0] == "4",
        "4111 1111 1111 1111": lambda s: luhn(s.replace(" ", "")) and s[4] == " ",
        "DE89370400440532013000": lambda s: int(s[4:] + "1314" + s[2:4]) % 97 == 1,
        "10.1.2.3": lambda s: all(0 <= int(x) < 256 for x in s.split(".")) and len(s.split(".")) == 4,
        "1999-02-28": lambda s: 1800 <= int(s[:4]) < 2200,
        "123-45-6789": lambda s: s[3] == s[6] == "-" and s[:3] not in ("000", "666") and s[0] != "9",
        "+1 (682) 555-5413": lambda s: s.startswith("+1 (") and s[4] > "1" and s[9] > "1",
        "ab.c9@mail.example.com": lambda s: s.endswith("@mail.example.com") and s[2] == "." and s[4].isdigit(),
    }
    wrong = ["4111111111111112", "DE88370400440532013000", "256.1.1.1", "1999-02-30", "666-12-3456", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "12345"]
    texts = [(k, f"a {v}, b {v}.") for k, v in enumerate(cases)] + [(50 + k, f"a {v} b") for k, v in enumerate(wrong)] + [(90, None), (91, ""), (92, "y" * 99999 + " 10.1.2.3")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("_x", F.lit(1))
    got = by_id(pii_feistel.pseudonymise(df, "key"), "doc_id")
    for k, (v, ok) in enumerate(cases.items()):
        body = got[k].text[2:-1]
        first, second = body.split(", b ")
        assert first == second != v and ok(first), (v, first)
        assert got[k].n_replaced == 2
    for k, v in enumerate(wrong):
        assert (got[50 + k].text, got[50 + k].n_replaced) == (f"a {v} b", 0)
    assert got[90].text is None and got[91].text == "" and got[92].text.startswith("y" * 99999) and got[92].n_replaced == 1
    other = by_id(pii_feistel.pseudonymise(df, "other"), "doc_id")
    assert other[0].text != got[0].text
    assert pii_feistel.pseudonymise(empty, "key").count() == 0


def test_pii_is_a_permutation(spark):
    """Different values get different pseudonyms; and the rounds are those of a plain network."""
    values = [f"10.0.{a}.{b}" for a in range(6) for b in range(256)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id long, text string")
    got = by_id(pii_feistel.pseudonymise(df, "k"), "doc_id")
    assert len({r.text for r in got.values()}) == len(values)
    x, y = 10 * 256, 5
    for i in range(pii_feistel.ROUNDS):
        prf = lambda v, i=i: int(hashlib.sha256(f"k|ipv4|{i}|{v}".encode()).hexdigest()[:15], 16)
        x, y = ((x + prf(y)) % 65536, y) if i % 2 == 0 else (x, (y + prf(x)) % 65536)
    assert got[5].text == f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    days = [f"{y}-{m:02}-{d:02}" for y in (1800, 1999, 2000, 2199) for m in range(1, 13) for d in range(1, 29)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(days)], "doc_id long, text string")
    assert len({r.text for r in pii_feistel.pseudonymise(df, "k").collect()}) == len(days)


def test_pii_slash_dates_keep_apart(spark):
    """All slash dates of 400 years, read either way."""
    first = datetime.date(1800, 1, 1)
    days = [first + datetime.timedelta(k) for k in range(146_097)]
    texts = [(f"{d.month:02}/{d.day:02}/{d.year}",) for d in days] + [(f"{d.day:02}/{d.month:02}/{d.year}",) for d in days if d.day > 12]
    got = pii_feistel.pseudonymise(spark.createDataFrame(texts, "text string"), "k").agg(F.count_distinct("text"), F.sum("n_replaced")).first()
    assert tuple(got) == (len(texts), len(texts)) and len(texts) == 234_594


def test_pii_matches_plain_networks(spark):
    """Cards, accounts and phones against the network written plainly, and numbers that look alike."""
    rng = np.random.default_rng(24)
    cards = []
    for _ in range(60):
        body = "".join(map(str, rng.integers(0, 10, int(rng.integers(12, 19)))))
        cards.append(next(body + c for c in "0123456789" if luhn(body + c)))
    plain = {c: c[0] + brute.digits("k", "card", c[1:-1]) for c in cards}
    phones = [f"+49 {a} {b}" for a in range(20, 60) for b in (12345678, 7654321)] + ["+44 20 7946 0958", "+33 1 23 45 67 89", "+4930123456"]
    values = [*cards, *phones]
    got = [r.text for r in pii_feistel.pseudonymise(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    for c, g in zip(cards, got, strict=False):
        assert g[:-1] == plain[c] and luhn(g)
    for v, g in zip(phones, got[len(cards) :], strict=True):
        cc = 2
        digits = "".join(x for x in v if x.isdigit())
        assert "".join(x for x in g if x.isdigit()) == digits[:cc] + brute.digits("k", "phone", digits[cc:])
        assert [x for x in g if not x.isdigit()] == [x for x in v if not x.isdigit()]
    assert len(set(got)) == len(set(values))
    # what is no value stays; a card ahead of other digits goes, the digits behind stay
    same = ["+1 000 555 1234", "DE99370400440532013000", "12:30:45", "aa:bb:cc:dd:ee:ff", "std::abc", "1.2.3"]
    other = ["4111 1111 1111 1111 123", "4111-1111-1111-1111 12/27", "3782 822463 10005 12", "fe80::1ff:fe23:4567:890a", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"]
    rows = {r.text0: r.text for r in pii_feistel.pseudonymise(spark.createDataFrame([(f"a {v} b",) for v in same + other], "text string").withColumn("text0", F.col("text")).withColumn("_pii", F.lit(1)), "k").collect()}
    assert all(rows[f"a {v} b"] == f"a {v} b" for v in same)
    for v in other:
        new = rows[f"a {v} b"][2:-2]
        assert new != v and len(new) == len(v)
    assert rows["a 4111 1111 1111 1111 123 b"].endswith(" 123 b") and luhn(rows["a 4111 1111 1111 1111 123 b"][2:21].replace(" ", ""))


def test_pii_keeps_columns_of_clashing_names(spark):
    df = spark.createDataFrame([("10.0.0.1", 1, 2, 3)], "text string, _pii int, _n int, n_chars int")
    out = pii_feistel.pseudonymise(df, "k")
    assert out.columns == [*df.columns, "n_replaced"] and tuple(out.first())[1:] == (1, 2, 3, 1)


# 2 ---------------------------------------------------------------------------------------------


def test_hmm(spark, docs, rows, empty):
    got = hmm_lm.score(spark, docs).collect()
    want, n = brute.base_score(rows)
    assert len(got) == len(rows)
    for r in got:
        score, known = want[r.doc_id]
        assert r.base_score == pytest.approx(score) and r.n_known == known and r.train_tokens == n
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and math.isfinite(r.score) and r.score < 0
    assert hmm_lm.score(spark, empty).count() == 0


@pytest.mark.parametrize("many", [40, 4])
def test_hmm_scores_whole_texts(spark, monkeypatch, many):
    """The query's score by a plain forward recursion; few texts train states that differ, too."""
    monkeypatch.setattr(hmm_lm, "PART", 50)
    rng = np.random.default_rng(28)
    rows = [(k, prose(int(rng.integers(0, 30)), rng)) for k in range(many)] + [(900, None), (901, " ".join(rng.choice(WORDS, 130))), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from heddle.llm.common import Scratch

    model, _ = hmm_lm.train(spark, Scratch(spark), df)
    assert model.emit.std(1).max() > 0 and not np.allclose(model.move, model.move[0])
    seqs = [[*brute.tokens(t), b""] for _, t in rows]
    counts = Counter(w for (i, _), s in zip(rows, seqs, strict=True) if zlib.crc32(str(i).encode()) % 7 != 2 for w in s)
    words = sorted({w for s in seqs for w in s})
    table = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select("w", F.pmod(F.xxhash64("w"), F.lit(hmm_lm.OWN)).alias("own"), F.pmod(F.xxhash64(F.substring("w", -hmm_lm.LETTERS, hmm_lm.LETTERS)), F.lit(hmm_lm.ENDS)).alias("ending"))
    place = {bytes(r.w): (r.own, r.ending) for r in table.collect()}
    k, lw = model.of_words(np.array([counts[w] for w in words]), *(np.array([place[w][x] for w in words]) for x in (0, 1)))
    at = {w: n for n, w in enumerate(words)}
    want = sorted((i, (brute.forward(model.start, model.move, model.emit, [k[at[w]] for w in s]) + sum(lw[at[w]] for w in s)) / math.log(10)) for (i, _), s in zip(rows, seqs, strict=True))
    got = sorted((r.doc_id, r.score) for r in hmm_lm.score(spark, df).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-5)


def test_hmm_long_sequences_part_by_part():
    rng = np.random.default_rng(29)
    m = hmm_lm.Model(450, 36, np.array([[k, 50, 4, 1, 1] for k in range(9)], float))
    m.learn(rng.random((hmm_lm.CLASSES, hmm_lm.STATES)) * 50 * (np.arange(hmm_lm.CLASSES) < 9)[:, None], rng.random((hmm_lm.STATES,) * 2) * 9, rng.random(hmm_lm.STATES))
    k = rng.integers(0, 9, 100)
    sums = lambda: (np.zeros((hmm_lm.CLASSES, hmm_lm.STATES)), np.zeros((hmm_lm.STATES,) * 2), np.zeros(hmm_lm.STATES))
    whole, parts = sums(), sums()
    ll = hmm_lm.expected(m, k, np.array([0]), np.array([100]), *whole)
    assert hmm_lm.expected_long(m, k, *parts, 7) == pytest.approx(ll, rel=1e-5) == pytest.approx(brute.forward(m.start, m.move, m.emit, k), rel=1e-5)
    for a, b in zip(whole, parts, strict=True):
        assert b == pytest.approx(a, rel=1e-3, abs=1e-4)


def test_hmm_recursions(monkeypatch):
    rng = np.random.default_rng(1)
    classes = np.array([[k, 50, 4, 1, 1] for k in range(9)], float)
    m = hmm_lm.Model(450, 36, classes)
    m.learn(rng.random((hmm_lm.CLASSES, hmm_lm.STATES)) * 50 * (np.arange(hmm_lm.CLASSES) < 9)[:, None], rng.random((hmm_lm.STATES,) * 2) * 9, rng.random(hmm_lm.STATES))
    assert m.emit.sum(0) == pytest.approx(np.ones(hmm_lm.STATES)) and m.move.sum(1) == pytest.approx(np.ones(hmm_lm.STATES))
    seqs = [rng.integers(0, 9, n) for n in (1, 2, 7, 7, 30)]
    k, size = np.concatenate(seqs), np.array([len(s) for s in seqs])
    first = np.cumsum(size) - size
    counts, moves, starts = np.zeros((hmm_lm.CLASSES, hmm_lm.STATES)), np.zeros((hmm_lm.STATES,) * 2), np.zeros(hmm_lm.STATES)
    for g in hmm_lm._groups(size):
        ll = hmm_lm.forward(m, k, first[g], size[g])
        assert ll == pytest.approx([brute.forward(m.start, m.move, m.emit, seqs[i]) for i in g])
        hmm_lm.expected(m, k, first[g], size[g], counts, moves, starts)
    assert counts.sum() == pytest.approx(size.sum(), rel=1e-4) and starts.sum() == pytest.approx(5, rel=1e-4)
    assert (moves * m.move).sum() == pytest.approx(size.sum() - 5, rel=1e-4)
    before = sum(brute.forward(m.start, m.move, m.emit, s) for s in seqs)
    monkeypatch.setattr(hmm_lm, "SMOOTH", 1e-6)  # unsmoothed, a round can't lose likelihood
    m.learn(counts, moves * m.move, starts)
    assert sum(brute.forward(m.start, m.move, m.emit, s) for s in seqs) > before


def test_hmm_words_add_up():
    """Known words and each class's unseen word have the whole probability."""
    c = np.array([900, 40, 3, 2, 1, 1, 1])
    own, ending = np.array([5, 6, 7, 8, 9, 9, 3]), np.array([1, 1, 1, 2, 2, 2, 2])
    tokens = 10**6
    m = hmm_lm.Model(tokens, len(c), np.zeros((0, 5)))
    often = m.frequent(c)
    k = np.where(often, own, hmm_lm.OWN + ending)
    table = {}
    for x, n, f in zip(k, c, often, strict=True):
        t = table.setdefault(int(x), [x, 0, 0, 0, 0])
        t[1] += n
        t[2] += 1
        t[3] += int(n == 1 and not f)
        t[4] += int(n == 2 and not f)
    m = hmm_lm.Model(tokens, len(c), np.array(list(table.values()), float))
    k, lw = m.of_words(c, own, ending)
    new = m.of_words(np.zeros(2, int), np.zeros(2, int), np.array([1, 2]))
    for cls in set(k.tolist()):
        unseen = sum(math.exp(w) for x, w in zip(*new, strict=True) if x == cls)
        assert sum(np.exp(lw[k == cls])) + unseen == pytest.approx(1)


def test_hmm_beats_single_words(spark):
    """Two languages that never mix in a text: states tell them apart on held-out texts."""
    rng = np.random.default_rng(3)
    words = [[f"{a}{k}" for k in range(200)] for a in ("ga", "zo")]
    rows = [(k, " ".join(rng.choice(words[k % 2], 60))) for k in range(400)]
    got = hmm_lm.score(spark, spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.95


# 3 ---------------------------------------------------------------------------------------------


def _check_dedup(df, rows):
    got = df.collect()
    want = brute.exact_groups(rows)
    assert len(got) == len(rows)
    by_hash = {(i, hashlib.sha256(k.encode()).hexdigest()): v for (i, k), v in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_hash[r.doc_id, r.text_sha256]
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_dedup(spark, docs, rows, empty):
    _check_dedup(dedup_stream.dedup(spark, docs), rows)
    assert dedup_stream.dedup(spark, empty).count() == 0


def test_dedup_checks_bytes(spark, docs, rows):
    """A digest of one hex digit collides all the time; the groups stay right."""
    _check_dedup(dedup_stream.dedup(spark, docs, digest=lambda t: F.concat(F.lit("0"), F.substring(F.sha2(t, 256), 1, 1))), rows)


def test_dedup_of_repeated_ids(spark):
    """Unlike texts of one id that collide: the locator tells which of them a group's bytes are."""
    rows = [(5, "b text"), (5, "a text"), (None, "a text"), (None, "c"), (7, "c"), (7, "b text"), (7, "b\ttext")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("named", F.lit(1)).withColumn("keep_hash", F.lit(2))
    _check_dedup(dedup_stream.dedup(spark, df, digest=lambda t: F.lit("00")), rows)


def test_dedup_hot_group(spark):
    rows = [(k, "the same text") for k in range(900)] + [(1000 + k, f"text {k}") for k in range(50)]
    _check_dedup(dedup_stream.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")), rows)


# 4 ---------------------------------------------------------------------------------------------


def test_langid(spark, empty):
    rng = np.random.default_rng(4)
    words = {lang: ["".join(rng.choice(list(a), rng.integers(3, 9))) for _ in range(150)] for lang, a in (("aa", "abcdefgh"), ("bb", "klmnopqr"), ("cc", "stuvwxyz"))}
    rows = [(k, " ".join(rng.choice(words[lang], 40)), lang) for k in range(300) for lang in [list(words)[k % 3]]]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !!", "bb"), (903, " ".join(rng.choice(words["bb"], 30000)), None), (904, "q", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    learned = langid_zstd.dictionaries(df.filter("doc_id % 2 = 0"))
    assert {k for k, _ in learned} == set(words) and all(len(b) <= 3 * langid_zstd.PASSAGES * langid_zstd.PASSAGE for _, b in learned)
    got = by_id(langid_zstd.identify(spark, df, learned), "doc_id")
    assert len(got) == len(rows) + len(odd)
    assert sum(got[i].lang_pred == lang for i, _, lang in rows if i % 2) >= 0.98 * 150
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert got[904].lang_pred in words and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid_zstd.identify(spark, df, []).collect()} == {"und"}
    assert langid_zstd.identify(spark, empty, learned).count() == 0


def test_langid_matches_plain_compression(spark):
    """The smallest of the texts' sizes under each dictionary, ties to the language with more texts, then by name."""
    rng = np.random.default_rng(26)
    learned = [("bb", " ".join(rng.choice(WORDS, 900)).encode()), ("aa", " ".join(f"{w}q" for w in rng.choice(WORDS, 900)).encode()), ("tie", b"")]
    learned.append(("same", learned[0][1]))
    rows = [(k, prose(int(rng.integers(1, 3000)), rng)) for k in range(30)] + [(100, "½ ² 12"), (101, "ªº"), (102, "x"), (102, "x"), (103, "日"), (104, None)]
    rows += [(200 + k, " ".join(f"{w}q" for w in rng.choice(WORDS, 40))) for k in range(10)]

    def plain(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0, True
        raw, sizes = text.lower().encode(), []
        for _, content in learned:
            d = zstandard.ZstdCompressionDict(content.ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=langid_zstd.LEVEL)
            c = zstandard.ZstdCompressor(dict_data=d, level=langid_zstd.LEVEL, write_content_size=False)
            sizes.append(sum(len(c.compress(raw[k : k + langid_zstd.CHUNK])) for k in range(0, len(raw), langid_zstd.CHUNK)))
        least, next_ = sorted(sizes)[:2]
        saved = (next_ - least) / next_
        return learned[sizes.index(least)][0], min(1.0, saved / langid_zstd.FULL), saved < langid_zstd.NARROW

    got = langid_zstd.identify(spark, spark.createDataFrame(rows, "doc_id long, text string"), learned).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score, r.rejected) for r in got) == sorted((i, *plain(t)) for i, t in rows)


def test_langid_sample_of_repeated_rows(spark):
    """Rows without ids and rows that are all alike give a bounded sample that isn't empty."""
    rows = [(None, f"{prose(30)} {k}", "aa") for k in range(900)] + [(None, "the same words", "bb")] * 900 + [(7, "seven " * 20, "cc")] * 300
    learned = dict(langid_zstd.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert learned["bb"] == b"the same words" and learned["cc"] == ("seven " * 20).encode()
    assert 60 <= learned["aa"].count(b"\n") + 1 <= 220


# 5 ---------------------------------------------------------------------------------------------


def _exact(rows, top):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, x in ok:
        if i % 20 == 0:
            out[i] = sorted(((-float(x @ y), j) for j, y in ok if j != i))[:top]
    return out


def test_nearest_small_is_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(120)]
    rows += [(200 + k, rows[7][1]) for k in range(45)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [None] * 8), (480, [float("inf")] * 8), (500, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
    got = {}
    for r in nn_descent.nearest(spark, df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = _exact(rows, 20)
    assert set(got) == set(want)
    hit = 0
    for i, w in want.items():
        g = sorted(got[i])
        assert [x[0] for x in g] == list(range(1, len(w) + 1)) and all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(g, g[1:], strict=False))
        hit += len({x[1] for x in g} & {x[1] for x in w})
    assert hit == sum(map(len, want.values()))
    assert nn_descent.nearest(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = df.filter("vec_id < 5")
    assert nn_descent.nearest(spark, few, F.col("vec_id") % 20 == 0).count() == 4


def test_nearest_of_doubles_and_all_lengths(spark):
    """Scores are those of the vectors as given, and each length is searched by itself."""
    rng = np.random.default_rng(30)
    x = {k: rng.standard_normal(6 if k % 2 else 9) * 10.0 ** int(rng.integers(-3, 4)) for k in range(0, 160)}
    x |= {20 * k: rng.standard_normal(6) for k in (10, 11)} | {1000: np.full(6, 1e39)}
    got = {}
    for r in nn_descent.nearest(spark, spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(got) == {k for k in x if k % 20 == 0}
    for q, found in got.items():
        best = sorted(((-float(x[q] @ v), k) for k, v in x.items() if k != q and len(v) == len(x[q])))[:20]
        assert len(found) == 20 and len(set(found) & {k for _, k in best}) >= 18
        assert all(s == pytest.approx(float(x[q] @ x[k]), rel=1e-12) for k, s in found.items())


def test_nearest_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = {}
    for r in nn_descent.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 150 and hit / (150 * 20) >= 0.9


def test_nearest_effort_follows_the_nodes(spark, monkeypatch):
    efforts = [nn_descent.Effort.of(n) for n in (0, 10_000, 51_280, 300_000, 10**8)]
    assert efforts[0] == efforts[1] and all(all(x <= y for x, y in zip(a, b, strict=True)) and a.near < b.near for a, b in zip(efforts[1:], efforts[2:], strict=False))
    # the lists settle, and are as long as the number of nodes asks for
    monkeypatch.setattr(nn_descent, "BASE", 100)
    seen, following = [], nn_descent._next
    monkeypatch.setattr(nn_descent, "_next", lambda scratch, graph, offers, name, old: seen.append(following(scratch, graph, offers, name, old)) or seen[-1])
    x = np.random.default_rng(10).standard_normal((400, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    nn_descent.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count()
    assert nn_descent.Effort.of(400).near == 64
    assert seen[-1].agg(F.sum("changed")).first()[0] <= nn_descent.SETTLED * 64 * 400


def test_nearest_hubs_get_short_requests():
    """A node that every list names gets a row a block, and no more vectors than others."""
    n, blocks, near, reverse = 4000, 40, 8, 28
    rng = np.random.default_rng(31)
    ids = np.arange(n)
    block = nn_descent._block(ids, blocks)
    asked, graph = [], {}
    for b in range(blocks):
        own = ids[block == b]
        lists = rng.integers(50, n, (len(own), near))
        lists[:, 0] = 7  # the hub
        small, ones = rng.integers(-9, 9, (len(own), 4)).astype(np.int8), np.ones(len(own))
        body = own, small.astype(float), small, ones, lists, np.ones(lists.shape), np.ones(lists.shape, bool)
        graph[b] = pa.table({"block": pa.array([b], pa.int64()), "body": pa.array([pickle.dumps(body)], pa.binary())})
        asked += nn_descent._requests(blocks, graph[b].to_batches())

    def got(tables):
        whole = pa.Table.from_batches([x for t in tables for x in (t.to_batches() if isinstance(t, pa.Table) else [t])])
        return {b: whole.filter(pc.equal(whole["block"], b)) for b in range(blocks)}

    requests = got(asked)
    hub = int(nn_descent._block(np.array([7]), blocks)[0])
    own, to, times = nn_descent._joined(nn_descent._got(requests[hub]))
    assert (to == 7).sum() == blocks and times[to == 7].sum() == n
    replies = got([nn_descent._replies(0, reverse)(graph[b], requests[b]) for b in range(blocks)])
    told = got([nn_descent._links(blocks, 0)(graph[b], replies[b]) for b in range(blocks)])
    links, back = Counter(), Counter()
    for b in range(blocks):
        for body in nn_descent._got(told[b]):
            if len(body) == 7:
                links.update(zip(body[0].tolist(), body[3][body[1]].tolist(), strict=True))
            else:
                back.update(zip(body[0].tolist(), body[1].tolist(), strict=True))
    want = Counter((int(u), int(v)) for b in range(blocks) for u, l in zip(ids[block == b], nn_descent._got(graph[b])[0][4], strict=True) for v in l)
    assert links == want
    named = Counter(v for _, v in want.elements())
    per = Counter(v for v, _ in back.elements())
    assert per == {v: min(k, reverse) for v, k in named.items()}
    assert all((u, v) in want for v, u in back)


def test_nearest_recall_with_hubs(spark, monkeypatch):
    """Vectors of log-normal length: a few are in almost all lists. Offers are merged in a tree of many levels."""
    monkeypatch.setattr(nn_descent, "FAN", 2)
    monkeypatch.setattr(nn_descent, "NODES", 300)
    rng = np.random.default_rng(32)
    x = (rng.standard_normal((2000, 16)) * rng.lognormal(0, 0.7, (2000, 1))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = {}
    for r in nn_descent.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 100 and hit / (100 * 20) >= 0.9


def test_nearest_lists_start_from_cells(spark, monkeypatch):
    """Most neighbours are found before the first round, so that few rounds are needed."""
    seen, following = {}, nn_descent._next

    def keep(scratch, graph, offers, name, old):
        out = following(scratch, graph, offers, name, old)
        if name.startswith("start"):
            seen.update((int(i), set(near[near >= 0].tolist())) for r in out.collect() for ids, *_, near, _, _ in [pickle.loads(r.body)[:7]] for i, near in zip(ids, near, strict=True))
        return out

    monkeypatch.setattr(nn_descent, "_next", keep)
    x = np.random.default_rng(33).standard_normal((6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nn_descent.nearest(spark, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count()
    hit = 0
    for q in range(0, 6000, 30):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(seen[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(seen) == 6000 and hit / (200 * 20) >= 0.9


def test_nearest_of_like_directions(spark, monkeypatch):
    """A cell that most nodes lie in is dealt into parts; the rounds link what they have not met."""
    monkeypatch.setattr(nn_descent, "SIDE", 64)
    monkeypatch.setattr(nn_descent, "PIVOTS", 20)
    rows, beside = [], nn_descent._to_cells
    rng = np.random.default_rng(34)
    x = rng.standard_normal((2000, 16)) * 0.3
    x[:1500, 0] += 9
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    parts = np.array([1, 3, 1])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(900)), pa.array([v.tolist() for v in x[:900]], pa.list_(pa.float32()))], ["id", "vec"])
    pivots = np.stack([-x[0], x[0], x[1900]])
    for b in beside(pivots, parts, 1, [batch]):
        rows += [(c, len(i)) for c, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i in [pickle.loads(body)[0]]]
    assert sum(n for _, n in rows) == 900 and {c for c, _ in rows} >= {1, 2, 3} and max(n for _, n in rows) < 400
    got = {}
    for r in nn_descent.nearest(spark, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 100 and hit / (100 * 20) >= 0.9


def test_nearest_walk_is_told_only_of_better_nodes():
    """Every node that reaches a query's score comes back, at its exact score, and no other."""
    rng = np.random.default_rng(35)
    ids, vec = np.arange(0, 3000, 3), rng.standard_normal((1000, 16)).astype(np.float32)
    x = rng.standard_normal((2, 16)).astype(np.float32)
    exact = vec.astype(float) @ x.astype(float).T
    graph = pa.table({"block": pa.array([0]), "body": pa.array([pickle.dumps((ids, vec))], pa.binary())})
    beat = np.array([-np.inf, np.sort(exact[500:, 1])[-7]])
    asks = pa.table({"block": pa.array([0]), "body": pa.array([pickle.dumps((np.array([5, 8]), x, beat, np.array([500, 500]), np.concatenate([ids[:500], ids[500:]])))], pa.binary())})
    q, to, s = nn_descent._joined(nn_descent._got(nn_descent._scores(1)(graph, asks)))
    assert sorted(to[q == 5]) == ids[:500].tolist() and (q == 8).sum() == 7
    assert np.allclose(s, exact[to // 3, (q == 8).astype(int)], rtol=1e-12, atol=0)


def test_nearest_keeps_to_the_largest_in_spite_of_ties():
    near = np.zeros((3, 50), np.float32)
    near[0, 40:45] = 1
    near[1, 7] = -np.inf
    hit = nn_descent._largest(near, 5, -np.inf)
    assert set(range(40, 45)) <= set(hit.tolist()) and 57 not in hit and len(hit) <= 30
    assert set(nn_descent._largest(near, 5, np.array([[0.5], [np.inf], [0.5]])).tolist()) == set(range(40, 45))


# 6 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cell", [4096, 4])
def test_simhash(spark, docs, rows, empty, cell):
    fps = simhash_gray.fingerprints(docs)
    got = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in simhash_gray.link(spark, fps, cell=cell).collect()}
    want = {(i, brute.simhash(t)) for i, t in rows}
    assert set(got) == want
    ids = sorted(want)
    label = brute.closure(ids, lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)
    assert got == {n: label[n][0] for n in ids}
    assert simhash_gray.link(spark, simhash_gray.fingerprints(empty)).count() == 0


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 2**63, 200, dtype=np.uint64)
    for _ in range(4):
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (len(fp), 2)).astype(np.uint64), axis=1)
        fp = np.unique(np.concatenate([fp, (fp ^ flips)[:150]]))
    cell = np.sort(rng.integers(0, 3, len(fp)))
    order = np.lexsort((simhash_gray._gray_rank(fp), cell))
    fp, cell = fp[order], cell[order]
    far = np.bitwise_count(fp[:, None] ^ fp[None])
    for most in (0, 3, 7):
        found = {tuple(sorted(p)) for a, b in simhash_gray.GrayIndex(cell, fp).links(most) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu((far <= most) & (cell[:, None] == cell[None]), 1))), strict=True))


def test_components_of_long_chains(spark):
    from heddle.llm.common import Scratch

    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)]
    got = {r.node: r.label for r in simhash_gray.components(spark, Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {1000 + k: 1000 for k in range(1, 300)}


def test_near_duplicates(spark):
    rng = np.random.default_rng(11)
    base = [[*rng.choice(WORDS, 150)] for _ in range(40)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(20):
        w = base[k].copy()
        w[int(rng.integers(150))] = "edited"
        rows.append((100 + k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in simhash_gray.near_duplicates(spark, spark.createDataFrame([*rows, (500, None)], "doc_id long, text string")).collect()}
    assert all(brute.jaccard(rows[k][1], rows[40 + k][1]) >= 0.8 for k in range(20))
    assert got == {k: k for k in range(40)} | {100 + k: k for k in range(20)} | {500: 500}


@pytest.mark.parametrize("half", [512, 8])
def test_near_duplicates_of_appended_and_shortened_copies(spark, monkeypatch, half):
    """Changes in one place, at similarities just above and below 0.8; small cells compare large groups whole."""
    monkeypatch.setattr(simhash_gray, "HALF", half, raising=False)
    rng = np.random.default_rng(19)
    rows, want = [], {}
    for k in range(120):
        w = [f"{x}{k}" for x in rng.choice(WORDS, int(rng.integers(40, 400)))]
        n, share = len(w), (0.10, 0.15, 0.20, 0.23, 0.30, 0.40)[k % 6]
        tail = [f"{x}a{k}" for x in rng.choice(WORDS, int(n * share))]
        pair = " ".join(w), " ".join(w + tail if k % 2 else w[: n - int(n * share)])
        rows += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if brute.jaccard(*pair) >= 0.8 else 2 * k + 1}
    base = [*rng.choice(WORDS, 200)]
    rows += [(1000 + k, " ".join([*base, f"end{k}"])) for k in range(60)]
    want |= {1000 + k: 1000 for k in range(60)}
    assert sum(want[2 * k + 1] == 2 * k for k in range(120)) >= 60
    got = {r.doc_id: r.component_id for r in simhash_gray.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_go_through_the_gray_index(spark, monkeypatch):
    """Candidates are what the index links: those whose band prints differ in a bit are found, and without links none is."""
    base = [[f"{x}{k}" for x in np.random.default_rng(k).choice(WORDS, 120)] for k in range(6)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)] + [(100 + k, " ".join([*w, "end"])) for k, w in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = []

    def seen(spark, fps, most=3, cell=simhash_gray.CELL):
        linked.append((most, sorted((r.set, r.fp) for r in fps.collect())))
        return link(spark, fps, most, cell)

    link = simhash_gray.link
    monkeypatch.setattr(simhash_gray, "link", seen)
    got = {r.doc_id: r.component_id for r in simhash_gray.near_duplicates(spark, docs).collect()}
    assert got == {i: i % 100 for i, _ in rows}
    sets = [simhash_gray.shingles(t.encode()) for _, t in rows]
    assert linked == [(simhash_gray.NEAR, sorted((simhash_gray.set_print(h), int(fp)) for h in sets for fp in simhash_gray.band_prints(h)))]
    for h in sets:  # bit by bit
        drawn = simhash_gray._drawn(h).reshape(-1, simhash_gray.BAND).tolist()
        assert simhash_gray.band_prints(h).tolist() == [simhash_gray._signed(sum((sum(x >> b & 1 for x in d) * 2 > len(d)) << b for b in range(64))) for d in drawn]
    # prints of one text a bit off those of its copy: no two are equal, and the index alone can tell
    monkeypatch.setattr(simhash_gray, "link", lambda spark, fps, most: link(spark, fps.withColumn("fp", F.col("fp").bitwiseXOR(F.when(F.col("set").isin(odd), 1 << 20).otherwise(0).cast("long"))).withColumn("doc_id", F.col("fp")), most))
    odd = [simhash_gray.set_print(simhash_gray.shingles(t.encode())) for i, t in rows if i >= 100]
    got = {r.doc_id: r.component_id for r in simhash_gray.near_duplicates(spark, docs).collect()}
    assert got == {i: i % 100 for i, _ in rows}
    monkeypatch.setattr(simhash_gray, "link", lambda spark, fps, most: fps.withColumn("component_id", F.xxhash64("set", "fp")))
    got = {r.doc_id: r.component_id for r in simhash_gray.near_duplicates(spark, docs).collect()}
    assert got == {i: i for i, _ in rows}


def test_sketch_tells_similarity():
    rng = np.random.default_rng(12)
    for _ in range(20):
        w = [*rng.choice(WORDS, 400)]
        v = w.copy()
        for k in rng.integers(0, 400, int(rng.integers(0, 20))):
            v[k] = f"new{k}"
        a, b = " ".join(w), " ".join(v)
        assert abs(simhash_gray.similarity(*(simhash_gray.sketch(t.encode()) for t in (a, b))) - brute.jaccard(a, b)) < 0.09


# 7 ---------------------------------------------------------------------------------------------


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard_by_bytes(spark, docs, 4).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.shard for r in got} <= set(range(4))
    assert sharding.shard_by_bytes(spark, empty).count() == 0


def test_sharding_is_even_with_a_hot_text(spark):
    rng = np.random.default_rng(13)
    rows = [(k, "hot text" * 20) for k in range(2000)] + [(5000 + k, prose(int(rng.integers(1, 60)), rng)) for k in range(4000)] + [(9999 + k, "pair") for k in range(2)]
    got = sharding.shard_by_bytes(spark, spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    total, sizes = sum(r["size"] for r in got), [0] * 8
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes) - min(sizes) <= 0.03 * total / 8
    assert len({r.shard for r in got if r.doc_id >= 9999}) == 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sharding_splits_samples_over_tasks(spark, monkeypatch):
    """Boundaries from sums over several ranges of the sample are those of one."""
    rng = np.random.default_rng(27)
    df = spark.createDataFrame([(k, prose(int(rng.integers(1, 60)), rng)) for k in range(1500)], "doc_id long, text string")
    want = sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_by_bytes(spark, df, 8).collect())
    monkeypatch.setattr(sharding, "SAMPLED", 4000)
    assert sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_by_bytes(spark, df, 8).collect()) == want


# 8 ---------------------------------------------------------------------------------------------


def test_packing(spark, docs, rows, empty):
    path = packing.tokenizer_path()
    cut = packing.pieces(docs, path, with_ids=True)
    got = packing.pack(spark, cut.cache()).collect()
    lib = packing.Tokenizer.from_file(path)
    want = {}
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            raw = np.array(ids[at : at + 2048], "<u4").tobytes()
            want.setdefault((i, k, at, len(raw) // 4, zlib.crc32(raw)), []).append(raw)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(k for k, v in want.items() for _ in v)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(spark, packing.pieces(empty, path)).count() == 0


def test_packing_takes_the_librarys_ids_where_merges_differ(rows):
    own = packing.WordIds(packing.tokenizer_path())
    own("some words first")
    own.id_of = [*reversed(own.id_of)]
    for _, t in rows[:20]:
        assert own(t or "") == np.array(own.tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    assert own.differed


def test_packing_proves_that_ranks_give_the_files_merges():
    assert packing.ranks_suffice(packing.tokenizer_path())
    ab, bc = (b"a", b"b", 300), (b"b", b"c", 301)
    assert packing.ranks_agree([ab, bc, (b"ab", b"c", 302)])
    assert not packing.ranks_agree([ab, bc, (b"a", b"bc", 302)])  # by rank ab and c would meet, which isn't listed
    assert not packing.ranks_agree([ab, bc, (b"ab", b"c", 302), (b"a", b"bc", 302)])  # two ways to one token
    own = packing.WordIds(packing.tokenizer_path(), proven=False)
    assert own("words of the library") == packing.WordIds(packing.tokenizer_path())("words of the library")


@given(st.lists(st.text("aeinrstlog'\xe9\xdf\u0131 7.", max_size=40), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_packing_ids_are_the_librarys(texts):
    own = _word_ids()
    for t in texts:
        assert own(t) == np.array(own.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@functools.cache
def _word_ids():
    return packing.WordIds(packing.tokenizer_path())


def test_packing_numbers_many_blocks(spark, monkeypatch):
    """Ranks over blocks and parts of them: each place is taken once."""
    monkeypatch.setattr(packing, "RANKED", 3)
    monkeypatch.setattr(packing, "NUMBERED", 4)
    cut = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 5 == 0, 700).otherwise(300).cast("long").alias("length"))
    got = packing.pack(spark, cut).collect()
    assert len(got) == 500 and len({(r.sequence_id, r.offset) for r in got}) == 500


def test_plan_holds_every_piece():
    rng = np.random.default_rng(14)
    for size, n in ((64, 500), (64, 200000), (2048, 3000)):
        counts = np.zeros(size + 1, np.int64)
        counts[1:] = np.bincount(np.minimum(size, 1 + rng.geometric(4 / size, n)), minlength=size + 1)[1:]
        used = np.zeros(size + 1, np.int64)
        made = packing.plan(counts)
        for what, repeats in made:
            assert sum(a * b for a, b in what) <= size
            for a, b in what:
                used[a] += b * repeats
        assert (used == counts).all()
        assert sum(r for _, r in made) <= 1.01 * sum(r for _, r in packing.best_fit(counts)) + 1


# 9 ---------------------------------------------------------------------------------------------


def test_piece_bpe(spark, docs, rows, empty):
    path = packing.tokenizer_path("piece_bpe_32k.model")
    lib = piece_bpe.PieceBpe(path).lib
    got = {}
    for r in piece_bpe.digests(docs, path).collect():
        got.setdefault(r.doc_id, set()).add((r.n_tokens, r.ids_sha256, r.decoded_sha256, r.differed))
    for i, t in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest(), 0
        assert want in got[i], (i, (t or "")[:40])
    assert piece_bpe.digests(empty, path).count() == 0
    both = piece_bpe.encode_decode(docs.filter("doc_id = 0"), path).first()
    assert both.decoded == rows[0][1]


def test_piece_merges_match_the_library():
    codec = piece_bpe.PieceBpe(packing.tokenizer_path("piece_bpe_32k.model"), cached=50)
    rng = np.random.default_rng(15)
    signs = list("abeinrst  \n\té▁.,'{}\r<>0日👍")
    for _ in range(400):
        t = "".join(rng.choice(signs, int(rng.integers(0, 40))))
        assert codec.encode_batch([t])[0] == np.array(codec.lib.encode(t, add_bos=True, add_eos=True), "<u4").tobytes(), repr(t)
    assert codec.differed == 0


# 10 --------------------------------------------------------------------------------------------


def test_quality(spark, empty):
    rng = np.random.default_rng(16)
    good = [(k, prose(60, rng), "en") for k in range(150)]
    junk = [(500 + k, " ".join(f"{w.upper()}!!#{k}" for w in rng.choice(WORDS, 60)), "en") for k in range(30)]
    odd = [(900, None, None), (901, "", "en"), (902, prose(9000, rng), "xx"), (903, "ok", "en"), (0, good[0][1], "en")]
    docs = spark.createDataFrame(good + junk + odd, "doc_id long, text string, lang string").withColumn("kept", F.lit("x"))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(120)] + [(k, 0, 0) for k in range(500, 510)] + [(3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality_kn.perplexities(spark, docs, labels).collect()
    assert len(rows) == len(good + junk + odd)
    kept = {r.doc_id: r.kept for r in rows}
    assert not any(kept[i] for i, *_ in junk) and sum(kept[i] for i, *_ in good) >= 147 and kept[902]
    none = quality_kn.perplexities(spark, docs, labels.limit(0)).collect()
    assert all(r.kept and r.perplexity is None for r in none)
    assert quality_kn.perplexities(spark, empty, labels).count() == 0


def test_quality_of_rare_languages(spark):
    """A language with few calibration texts keeps its clean documents and loses its junk."""
    rng = np.random.default_rng(18)
    fold = [r.id for r in spark.range(2000).filter(F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(quality_kn.CALIBRATE)) == 0).collect()]
    train = [k for k in range(2000) if k not in set(fold)]
    rows, trusted, clean, junk, at = [], [], {}, {}, 10_000
    for lang, n in (("en", 100), ("l1", 1), ("l2", 2), ("l5", 5), ("l10", 10)):
        own = [fold.pop() for _ in range(n)] + [train.pop() for _ in range(4 * n)]
        trusted += own
        clean[lang], junk[lang] = range(at, at + 60), range(at + 60, at + 70)
        rows += [(k, prose(60, rng), lang) for k in [*own, *clean[lang]]]
        rows += [(k, " ".join(f"{w.upper()}!!#{k}" for w in rng.choice(WORDS, 60)), lang) for k in junk[lang]]
        at += 100
    labels = spark.createDataFrame([(k, 1, 0) for k in trusted], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_kn.perplexities(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    for lang in clean:
        assert sum(kept[k] for k in clean[lang]) >= 58 and not any(kept[k] for k in junk[lang]), lang


def test_kneser_ney(spark):
    from heddle.llm.common import Scratch

    rng = np.random.default_rng(17)
    train, texts = ([prose(8, rng) for _ in range(n)] for n in (30, 6))
    train += ["日本語の文章です", "日木語の丈章です", "one \x02two\x03 three", "πλ ߼߽"]
    texts += ["日本語の章", "two\x02\x03", "\x03", "👍 ߼", ""]
    grams, n = np.unique(np.concatenate([quality_kn.codes([t])[0] for t in train]), return_counts=True)
    counts = spark.createDataFrame([(int(g), int(c)) for g, c in zip(grams, n, strict=True)], "gram long, c long")
    every = np.unique(np.concatenate([grams, *(quality_kn.codes([t])[0] for t in texts)]))
    nll = {r.gram: r.nll for r in quality_kn.kneser_ney(Scratch(spark), counts, spark.createDataFrame([(int(g),) for g in every], "gram long")).collect()}
    got = [sum(nll[int(g)] for g in quality_kn.codes([t])[0]) for t in texts]
    assert got == pytest.approx(brute.kneser_ney(train, quality_kn.ORDER, texts), rel=1e-5)


def test_symbols_tell_all_texts_apart():
    """Signs in the text are no starts or ends, and no two signs are one."""
    signs = [chr(x) for x in (*range(0, 5000), *range(0x4E00, 0xA000, 7), *range(0x10000, 0x110000, 997))]
    assert len({quality_kn.codes([c])[0].tobytes() for c in signs}) == len(signs)
    for texts in (["", "a", "\x02\x03"], ["日本語", "a日", "", "b"]):
        both, size = quality_kn.codes(texts)
        assert both.tolist() == [g for t in texts for g in quality_kn.codes([t])[0].tolist()] and size.tolist() == [len(brute.symbols(t)) + 1 for t in texts]


@pytest.mark.parametrize("quantile", [0.8, 0.997])
def test_quality_decisions(spark, quantile):
    """Shrinkage, quantile and decision, with folds that hold the quantile, small ones and none."""
    rng = np.random.default_rng(23)
    rows = [(k, prose(int(rng.integers(0, 9)), rng), "en") for k in range(90)] + [(100 + k, prose(5, rng), "xx") for k in range(14)] + [(200 + k, prose(4, rng).upper(), None) for k in range(6)]
    rows += [(300, None, "en"), (301, "", "zz"), (5, rows[5][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(k, 1, 0) for k in [*range(70), *range(100, 112)]], "doc_id long, quality int, toxic int")
    fold = {r.doc_id for r in labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(quality_kn.CALIBRATE)) == 0).collect()}
    trusted = {r.doc_id for r in labels.collect()}
    nll = brute.kneser_ney([t or "" for i, t, _ in rows if i in trusted - fold], quality_kn.ORDER, [t or "" for _, t, _ in rows])
    want = brute.decisions([(lang, len(t or "") + 1, x, i in fold) for (i, t, lang), x in zip(rows, nll, strict=True)], quantile, quality_kn.PRIOR, quality_kn.LENT)
    want = {(i, t or ""): w for (i, t, _), w in zip(rows, want, strict=True)}
    text = {(i, simhash_gray._signed(quality_kn._row_hash(t or "") & (2**64 - 1))): (i, t or "") for i, t, _ in rows}
    got = quality_kn.perplexities(spark, docs, labels, quantile).collect()
    assert len(got) == len(rows)
    for r in got:
        perplexity, threshold, kept = want[text[r.doc_id, r.row_hash]]
        assert r.perplexity == pytest.approx(perplexity, rel=1e-4) and r.threshold == pytest.approx(threshold, rel=2e-3)
        assert r.kept == kept or abs(r.perplexity / r.threshold - 1) < 2e-3
        assert r.held_back == (r.doc_id in fold)


# All -------------------------------------------------------------------------------------------


def test_null_ids_and_single_rows(spark):
    """Rows without an id go through every operator; so do tables of one row."""
    some = spark.createDataFrame([(None, "a text"), (None, "a text"), (None, None), (7, "a text"), (8, "other words")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    path, pieces = packing.tokenizer_path(), packing.tokenizer_path("piece_bpe_32k.model")
    for df in (some, some.filter("doc_id = 8"), some.filter("text IS NULL")):
        n = df.count()
        assert pii_feistel.pseudonymise(df, "k").count() == n
        assert hmm_lm.score(spark, df).count() == n
        assert dedup_stream.dedup(spark, df).count() == n
        assert langid_zstd.identify(spark, df, langid_zstd.dictionaries(df)).count() == n
        assert simhash_gray.link(spark, simhash_gray.fingerprints(df)).count() == n
        assert simhash_gray.near_duplicates(spark, df).count() == n
        assert sharding.shard_by_bytes(spark, df).count() == n
        assert packing.pack(spark, packing.pieces(df, path)).count() == n
        assert piece_bpe.digests(df, pieces).count() == n
        assert quality_kn.perplexities(spark, df, labels).count() == n
    got = {(r.doc_id, r.text_sha256[:6]): (r.keep_id, r.group_size, r.kept) for r in dedup_stream.dedup(spark, some).collect() if r.doc_id}
    assert set(got.values()) == {(None, 3, False), (8, 1, True)}
