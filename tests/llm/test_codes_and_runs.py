"""Byte-level BPE against the library, vector codes against full scans, periodic
runs against a search of all periods."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from riskframe.llm import bytebpe, periodic, queries, veccode

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ byte-level BPE
def hard_texts(rng):
    kinds = ["a", "Z", "5", "'", "'s", "'re ", " ", "  ", "\n", "\t", "\r\n", "!", "?!", "é", "日本", "ß",
             " ", " ", "　", "\x1c", "\x85", "\U0001f600", "é", "_", "1a", "a1", "-"]
    return ["".join(rng.choice(kinds) * rng.randint(1, 4) for _ in range(rng.randint(1, 60)))
            for _ in range(400)]


def test_cut_texts_keep_their_ids():
    rng = random.Random(1)
    encoding = bytebpe.load_encoding(path("byte_bpe_multi_50k.tiktoken"), PATTERN)
    for t in hard_texts(rng):
        want = encoding.encode_ordinary(t)
        for long in (1, 5, 20):
            assert bytebpe.encode_text(encoding, t, long) == want
            assert "".join(bytebpe.cut(t, long)) == t


@pytest.mark.parametrize("text", [
    " " * 5000, "a" + " " * 5000, "a" + " " * 5000 + "b c", "\n" * 9000 + "1" + "\t" * 4096 + " x",
    "x" * 70_000, ("word " * 20_000) + " " * 4097 + "　" * 5000 + "'s"])
def test_long_white_space_as_the_library(text):
    encoding = bytebpe.load_encoding(path("byte_bpe_multi_50k.tiktoken"), PATTERN)
    assert bytebpe.encode_text(encoding, text, 1000) == encoding.encode_ordinary(text)


def test_white_space_beyond_the_matcher():
    encoding = bytebpe.load_encoding(path("byte_bpe_multi_50k.tiktoken"), PATTERN)
    ids = bytebpe.encode_text(encoding, "a" + " " * 2_000_000 + "b")
    assert encoding.decode(ids) == "a" + " " * 2_000_000 + "b"
    assert ids[-1] == encoding.encode_ordinary(" b")[0]


def test_byte_bpe(spark):
    encoding = bytebpe.load_encoding(path("byte_bpe_multi_50k.tiktoken"), PATTERN)
    texts = [None, "", " ", *hard_texts(random.Random(2)), "ab " * 50_000, "ab " * 50_000]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)],
                               "id long, text string, `a.b` string, IDS string")
    rows = bytebpe.encode(df, decoded="decoded").collect()
    assert len(rows) == len(texts) and rows[0].asDict().keys() == {"id", "text", "a.b", "ids", "decoded"}
    for r in rows:
        t = texts[r.id] or ""
        assert r.text == texts[r.id] and r.ids == encoding.encode_ordinary(t)
        assert bytes(r.decoded) == t.encode()
    back = bytebpe.decode(bytebpe.encode(df, keep=["id"])).collect()
    assert {r.id: bytes(r.decoded).decode() for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert bytebpe.decode(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded == b""
    assert bytebpe.encode(df.limit(0)).count() == 0


def test_op11_digests(spark):
    encoding = bytebpe.load_encoding(path("byte_bpe_multi_50k.tiktoken"), PATTERN)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    rows = queries.op11_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


# ------------------------------------------------------------------ vector codes
def full_lloyd(rows, parts, entries, rounds):
    """Codes, errors and codebooks by whole scans with Python's integers."""
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = sorted([r for r in rows if ok(r[1])], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(next((r[1] for r in kept if r[1]), []))
    kept = [r for r in kept if len(r[1]) == length and length]
    cuts = [length * i // parts for i in range(parts + 1)]
    xs = [[[math.floor(1024 * x) for x in r[1][a:b]] for a, b in zip(cuts, cuts[1:])] for r in kept]
    books = [[x[p] for x in xs[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in xs:
                groups.setdefault(nearest(p, x[p])[1], []).append(x[p])
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    found = [[nearest(p, x[p]) for p in range(parts)] for x in xs]
    return ([(r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(kept, found)],
            books)


@pytest.mark.parametrize("entries,scale", [(5, 1.0), (256, 1.0), (3, 90_000.0), (4, 0.002)])
def test_vector_codes(spark, entries, scale):
    rng = random.Random(entries)
    rows = [(i, [rng.gauss(0, 1) * scale for _ in range(8)], rng.choice([None, 1, 2]), "x")
            for i in range(300)]
    rows += [(7, list(rows[40][1]), 1, "x"), (7, list(rows[40][1]), 1, "x"), (None, list(rows[3][1]), 2, "x")]
    odd = [(-3, None, 1, "x"), (-2, [1.0, None] * 4, 1, "x"), (-1, [float("nan")] * 8, 1, "x"),
           (-1, [float("-inf")] * 8, 1, "x")]
    short = [(-9, [], 3, "x"), (900, [1.0], 3, "x"), (901, [1e300] * 8, 3, "x")]
    df = spark.createDataFrame(rows + odd + short, "vec_id long, embedding array<double>, label int, Code string")
    coded, books = veccode.compress(df.repartition(5), entries=entries)
    want, want_books = full_lloyd(rows, 4, entries, 4)
    got = [(r.vec_id, r.code, r.error) for r in coded.collect()]
    order = lambda r: (str(r[0]), str(r[1]))
    assert sorted(got, key=order) == sorted(want + [(k, None, None) for k, *_ in short], key=order)
    assert [b.tolist() for b in books.books] == want_books
    assert coded.columns == ["vec_id", "label", "code", "error"]
    sums = {}
    for r in coded.collect():
        sums[r.label] = sums.get(r.label, 0) + (r.error or 0)
    sums[3] = None
    out = veccode.with_group_error(coded, "label")
    assert all(r.label_error == sums[r.label] for r in out.collect()) and out.count() == len(got)


def test_vector_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    for some in (df, df.limit(0)):
        coded, books = veccode.compress(some)
        assert coded.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()


def test_active_entries_give_the_full_scan():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x, book = rng.integers(-4, 5, (200, 3)), rng.integers(-4, 5, (20, 3))
        entry, dist = veccode.assign(x, book)
        moved = rng.random(20) < rng.random()
        new = np.where(moved[:, None], book + rng.integers(-1, 2, (20, 3)), book)
        got = veccode.reassign(x, new, (new != book).any(1), entry, dist)
        want = veccode.assign(x, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    big = rng.integers(-2 ** 29, 2 ** 29, (30, 4))
    assert veccode.exact_type(big, big) is np.int64
    assert veccode.distances(big, big)[3, 7] == sum((int(a) - int(b)) ** 2 for a, b in zip(big[3], big[7]))


# ------------------------------------------------------------------ periodic runs
def all_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted((s, n, q) for s, n, q in out if not any(
        p < q and t <= s and t + m >= s + n for t, m, p in out))


def repetitive(rng):
    n, kind = rng.randint(0, 260), rng.randint(0, 4)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    if kind == 2:
        return [rng.choice("abcdefgh") for _ in range(n)]
    words = []
    while len(words) < n:
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
        words += unit * rng.randint(1, 8) + unit[:rng.randint(0, len(unit))]
    return words


def test_periodic_runs(spark):
    rng = random.Random(5)
    texts = [" ".join(repetitive(rng)) for _ in range(300)]
    texts += [None, "", " \n\t", "a a a a a a", "a a a a a", "a a " * 7, texts[3], texts[3], "x " * 30_000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id long, text string, RUNS string")
    rows = periodic.runs(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = [w.decode() for w in (texts[r.id] or "").encode().split()]
        want = all_runs(words) if len(words) < 20_000 else [(0, len(words), 1)]
        assert [(x.start, x.length, x.period) for x in r.runs] == want and r.n_words == len(words)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic.runs(df.limit(0)).count() == 0


def test_transform_is_a_convolution():
    rng = np.random.default_rng(6)
    for size in (1, 2, 8, 32):
        y = rng.integers(1, 4, 5 * size + 3)
        lag, block, _ = periodic.agreeing_blocks(y.astype(np.uint64), size)
        padded = np.r_[y, np.zeros(4 * size, int)]
        want = {(d, b) for b in range(-(-len(y) // size)) for d in range(size)
                if (padded[b * size:(b + 1) * size] == padded[(b + 1) * size + d:(b + 2) * size + d]).all()}
        assert set(zip(lag.tolist(), block.tolist())) == want


def test_long_texts_take_no_square_time():
    rng = random.Random(7)
    words = [rng.choice("abc") for _ in range(70_000)]
    text = " ".join([*words, *words, *words, *words, *words])
    _, (_, start, length, period), _ = periodic.batch_runs([text])
    assert (70_000, 350_000, 0) in set(zip(period.tolist(), length.tolist(), start.tolist()))


def test_op13_plants_and_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    planted = {r.doc_id: r.text for r in queries.planted_repeats(
        spark.read.parquet(SF + "/documents.parquet")).collect()}
    rows = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert rows.keys() == texts.keys() and sum(r.n_runs > 0 for r in rows.values()) > 10
    for k, r in rows.items():
        w, h = [x.decode() for x in (texts[k] or "").encode().split()], zlib.crc32(str(k).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert (planted[k] or "").encode().split() == [x.encode() for x in w]
        runs = all_runs(w) if n < 1500 else None
        if runs is not None:
            assert r.n_runs == len(runs)
            assert r.runs_sha256 == hashlib.sha256("".join(
                f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
            best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
            assert (r.start, r.length, r.period) == (best or (None,) * 3)
            assert r.exponent_milli == (best and 1000 * best[1] // best[2])


def test_null_rows(spark):
    docs = spark.createDataFrame([(None, "a a a a a a"), (3, None), (None, None)], "doc_id long, text string")
    got = queries.planted_repeats(docs).orderBy(F.col("text").desc_nulls_last()).collect()
    assert [r.text for r in got] == ["a a a a a a", None, None]
