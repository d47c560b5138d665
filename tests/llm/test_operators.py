"""Each operator against a plain-Python version, with the odd cases: nulls,
empty and very long texts, ties and repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from riskframe.llm import (blocks, bpe, bytebpe, chat, components, decontam, embedjoin, langid, linededup, lm,
                           ngramjoin, shards, urlfilter)

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("", "n", "r")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_texts(rng):
    """Texts no operator may trip over."""
    long = prose(rng, 30_000)
    return [None, "", " ", "\n\n", "?! 12", "a", "ab cd", long, long, "Été é\u0301t ﬀ 日本 語 \U0001f600",
            "<|endoftext|> it's I'LL x\u00a0y\tz", "x" * 5000]


# ------------------------------------------------------------------ language ID
def test_language_id(spark):
    docs = spark.read.parquet(SF001 + "/documents.parquet").withColumn("pred", F.lit(1))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    protos = langid.prototypes(docs.where(~held))
    rows = langid.identify(docs, protos).where(held).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.pred == 1 for r in rows)
    odd = spark.createDataFrame([(t,) for t in odd_texts(random.Random(1))], "text string")
    letters = [c * 40 for c in "\u0130\U00030000\U000323af\u0434\u4e00"]
    rare = langid.identify(spark.createDataFrame([(t, "x", 1) for t in letters],
                                                 "text string, lang_pred string, Score int"), protos)
    assert rare.columns == ["text", "lang_pred", "score"]       # columns of these names are replaced
    assert all(r.lang_pred in protos for r in rare.collect())
    got = langid.identify(odd, protos).collect()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert got[7].score == got[8].score
    assert langid.identify(odd.limit(0), protos).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.prototypes(docs.limit(0)) == {}


def test_bundles_are_sums_of_bound_letters():
    b = langid.Binder(64, 3)
    ids, found = b.ids("Ab")
    x, y = b.classes[ord("a")], b.classes[ord("b")]
    second, first, own = b.parts
    want = second[0] * first[x] * own[y] + second[x] * first[y] * own[0]
    assert found and (b.bundle(ids, np.ones(len(ids))) == want).all()


# ------------------------------------------------------------------ decontamination
@pytest.mark.parametrize("broadcast_bytes", [decontam.BROADCAST_BYTES, 0])
def test_decontamination(spark, broadcast_bytes):
    rng = random.Random(2)
    items = [(i, prose(rng, n)) for i, n in enumerate([8, 9, 12, 13, 14, 30, 60])]
    items += [(7, None), (8, ""), (9, items[5][1])]
    docs = [(i, prose(rng, 40)) for i in range(20)]
    for k, (_, text) in enumerate(items[:7]):
        w = text.split()
        docs.append((100 + k, f"{prose(rng, 9)} {text.upper()}! {prose(rng, 5)}"))
        for m in (1, 2, 3):
            v = list(w)
            for at in rng.sample(range(len(w)), min(m, len(w))):
                v[at] = "zzz"
            docs.append((100 * m + 100 + k, " ".join(v)))
        docs.append((900 + k, " ".join(w[len(w) // 2:])))
    docs += [(1000, None), (1001, ""), (None, items[4][1]), (1002, items[5][1]), (1002, items[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_match for r in decontam.overlaps(
        d, b, ["doc_id"], broadcast_bytes=broadcast_bytes).collect()}
    want = brute.leaks(docs, items)
    assert got == want and len(want) > 20
    left = Counter(r.doc_id for r in decontam.remove_contaminated(d, b).collect())
    assert left == Counter(k for k, t in docs if not any((k, i) in want for i, _ in items))
    assert decontam.remove_contaminated(d, b.limit(0)).count() == len(docs)
    assert decontam.overlaps(d.limit(0), b, ["doc_id"]).count() == 0


def test_long_item_and_long_document(spark):
    """Work is linear in the length of an item that a document repeats."""
    text = " ".join(f"w{i}" for i in range(30_000))
    d = spark.createDataFrame([(1, text), (2, f"a b {text} c")], "doc_id long, text string")
    b = spark.createDataFrame([(5, text)], "item_id long, text string")
    got = sorted(map(tuple, decontam.overlaps(d, b, ["doc_id"]).collect()))
    assert got == [(1, 5, 13, 0), (2, 5, 13, 2)]


def test_masks_are_lossless():
    from itertools import combinations
    for gone in combinations(range(decontam.WINDOW), decontam.WINDOW - decontam.MATCHES):
        assert any(not {at + o for o in mask} & set(gone) for mask in decontam.MASKS
                   for at in range(decontam.WINDOW - mask[-1]))


# ------------------------------------------------------------------ chat
def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "\n", "x", "é", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", "</s>", None]),
             rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))]))
            for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "assistant", "</s>"), (99, 1, "user", "b"), (99, 1, "user", "b"),
             (99, 1, "user", None), (99, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    none_first = lambda x: (x is not None, x)
    for c in {r[0] for r in rows}:
        want = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c),
                      key=lambda y: (none_first(y[0]) if y[0] is not None else (False, 0), y[1], y[2]))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in want]
        assert got[c].loss_texts == [x for _, r, x in want if r == "assistant"]
        for s in got[c].loss_spans:
            body = got[c].formatted[s.start:s.end]
            assert not any(x in body for x in ("<s>", "</s>", "[INST]", "[/INST]"))
            assert got[c].formatted[s.end:].startswith("</s>")
    assert chat.format_conversations(df.limit(0)).count() == 0


# ------------------------------------------------------------------ language model
@pytest.mark.parametrize("hot_words", [10**6, 20, 0])
def test_lm_counts_and_base_score(spark, hot_words):
    rng = random.Random(4)
    rows = [(i, prose(rng, 30).title(), i % 3 > 0) for i in range(30)]
    rows += [(100 + i, t, bool(i % 2)) for i, t in enumerate(odd_texts(rng))] + [(None, "new words", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    out = lm.score(df, F.col("learn"), rounds=1, hot_words=hot_words).collect()
    toks = lambda t: lm.tokens_of(t) + [b""]
    c = Counter(w for _, t, k in rows if k for w in toks(t))
    total, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in out}
    for k, t, _ in rows:
        want = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in toks(t))
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (
            len(toks(t)), sum(c[w] > 0 for w in toks(t)), total)
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0


def test_lm_scores_do_not_follow_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_TOKENS", 2_000)
    rng = random.Random(8)
    df = spark.createDataFrame([(i, prose(rng, 60)) for i in range(300)], "doc_id long, text string")
    one, many = ({r.doc_id: r.score for r in lm.score(
        df.repartition(n), F.col("doc_id") % 10 > 0, rounds=2).collect()} for n in (1, 7))
    assert one.keys() == many.keys()
    assert all(many[k] == pytest.approx(x, abs=1e-6) for k, x in one.items())


def test_summed():
    rng = np.random.default_rng(9)
    at, rows = rng.integers(0, 20, 200), rng.normal(size=(200, 3))
    want = np.zeros((20, 3))
    np.add.at(want, at, rows)
    places, sums = lm.summed(at, rows)
    assert (places == np.unique(at)).all() and np.allclose(sums, want[places])


def test_lm_is_normalised(spark):
    """Probabilities of all classes after a context, and of all words and the
    unseen one in a group, sum to one."""
    noise = np.full(lm.CLASSES, 1 / lm.CLASSES)
    model = lm.Model(noise)
    z = lm.normalisers(spark, model)
    near, far = model.r @ model.c[0] @ model.q.T + model.b, model.r @ model.c[1] @ model.q.T
    for v, u in ((0, 0), (5, 900)):
        assert np.exp(near[v] + far[u] - z[v, u]).sum() == pytest.approx(1, abs=1e-4)
    docs = spark.createDataFrame([(prose(random.Random(5), 400),)], "text string")
    lex, _ = lm.lexicon(lm.count_words(docs))
    groups = lex.kind > lm.WORDS
    sums = np.bincount(lex.kind[groups], 10 ** lex.log_count[groups], lm.CLASSES)
    held = sums > 0
    assert np.allclose(10 ** lex.log_mass[held], sums[held] + lm.SMOOTH)


def test_lm_beats_unigrams_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        "doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).alias("h"))
    r = lm.score(docs, ~F.col("h")).where("h").agg(F.sum("score").alias("s"),
                                                  F.sum("base_score").alias("b")).first()
    assert r.s > r.b


# ------------------------------------------------------------------ embeddings
@pytest.mark.parametrize("cell_rows", [4096, 10])
def test_embedding_join(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(embedjoin, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=8)
            for k in range(int(rng.integers(1, 9))):
                rows.append((n, (centre + rng.normal(size=8) * 0.25 * (k > 1)).tolist(), label))
                n += 1
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 8, 0), (903, [1.0, None] + [0.0] * 6, 0),
             (904, [float("nan")] * 8, 0), (905, [float("inf")] * 8, 0), (906, [1.0, 2.0], 0),
             (907, [2.0, 4.0], 0), (908, [1e-200] * 8, 1), (909, [1e200] * 8, 1),
             (None, [2.0, 4.0], 0), (910, rows[0][1], 0), (910, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in
                  embedjoin.range_join(df, cell_rows=cell_rows).collect())
    want = brute.cosine_links(rows)
    # the plain version squares without scaling first
    fix = {(908, 0, 908): (908, 1, 908), (909, 0, 909): (909, 1, 908)}
    assert got == Counter({fix.get(k, k): v for k, v in want.items()})
    assert embedjoin.range_join(df.limit(0)).count() == 0


def test_embedding_join_moves_no_vector_to_every_cell(spark, monkeypatch):
    """Vectors without structure visit most cells: they are met where they lie."""
    rng = np.random.default_rng(16)
    x = rng.normal(size=(500, 24))
    x[300:380] = x[300] + rng.normal(size=(80, 24)) * 0.05           # a dense cluster
    x[400:480] = x[:80] + rng.normal(size=(80, 24)) * 0.38           # about the threshold
    x[490:] = x[300]
    rows = [(i, v, (0, 0, 0, 1, 2 + i % 7)[i % 5])
            for i, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    dealt, rounds = [], []
    per_block, one_round = embedjoin.per_block, getattr(embedjoin, "_round", None)

    def watched(placed, *rest):
        dealt.append(placed.count())
        return per_block(placed, *rest)

    def counted(placed, bounds, *rest):
        rounds.append(bounds)
        return one_round(placed, bounds, *rest)

    monkeypatch.setattr(embedjoin, "per_block", watched)
    monkeypatch.setattr(embedjoin, "_round", counted, raising=False)
    monkeypatch.setattr(embedjoin, "ROUND_BYTES", 80 * 24 * 8, raising=False)
    monkeypatch.setattr(embedjoin, "MERGED", 2, raising=False)
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in
                  embedjoin.range_join(df, cell_rows=30).collect())
    assert got == brute.cosine_links(rows)
    assert sum(dealt) <= len(rows)
    assert len(rounds) > 3


def test_screens_of_pairs_are_never_below_their_cosine():
    rng = np.random.default_rng(17)
    x = embedjoin._normal(rng.normal(size=(400, 40)) * np.linspace(2, 0.1, 40))
    x[200:] = embedjoin._normal(x[:200] + rng.normal(size=(200, 40)) * 0.03)
    axes = embedjoin._axes(x, 0.93)
    assert axes is not None and axes.shape[1] < 40
    s = embedjoin._screen(x, axes)
    cosine, bound = x @ x.T, embedjoin._screen_bound(s.shape[1], 0.0)
    assert (s @ s.T >= cosine + bound).all()


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(300, 500)] + [(0, i) for i in range(1, 50)]
    edges += [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    for g in brute.groups(700, edges):
        for x in g[1:]:
            assert got[x] == g[0]


def test_roots_of_a_chain():
    a = np.zeros((5, 5), dtype=bool)
    for i, j in ((0, 4), (4, 2), (1, 3)):
        a[i, j] = a[j, i] = True
    assert blocks.roots(a).tolist() == [0, 1, 0, 1, 0]


# ------------------------------------------------------------------ n-gram join
def test_ngram_join(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "CHUNK_SHINGLES", 400)
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = prose(rng, rng.choice([3, 5, 20, 80, 150])).split()
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, t) for i, t in enumerate(odd_texts(rng))]
    rows += [(None, rows[0][1].upper()), (2, rows[2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit("x"))
    out = ngramjoin.near_duplicates(df).collect()
    want, n = brute.near(rows)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == want
    assert sum(r.kept for r in out) == n and all(r.t == "x" for r in out)
    assert ngramjoin.near_duplicates(df.limit(0)).count() == 0
    assert 1 - (1 - 0.8 ** ngramjoin.matched_depth()) ** ngramjoin.TREES >= ngramjoin.TARGET_RECALL


# ------------------------------------------------------------------ line dedup
def test_line_dedup(spark):
    rng = random.Random(9)
    common = [prose(rng, 8) for _ in range(6)]
    rows = []
    for i in range(60):
        lines = [prose(rng, 10) for _ in range(4)] + [c for k, c in enumerate(common)
                                                     if rng.random() < 0.05 + 0.1 * k]
        rng.shuffle(lines)
        rows.append(("\n".join(lines + [""] * (i % 3)), f"s{rng.randrange(9)}"))
    rows += [("\n".join(common), f"s{i}") for i in range(7)] + [(common[5], None), (None, "s1"), ("", "s2")]
    rows += [rows[0], rows[0]]
    rows += [("\n".join([common[0], common[4], common[5], "x"]), f"t{i}") for i in range(3)]
    rows += [(common[2] + "\n\n" + common[3], "u"), (common[4], "v")]
    df = spark.createDataFrame([(i, t, s, 1) for i, (t, s) in enumerate(rows)],
                               "doc_id long, text string, source string, line int")
    out = linededup.remove_boilerplate(df).orderBy("doc_id").collect()
    want = brute.without_boilerplate(rows)
    assert [r.text for r in out] == want and want != [t for t, _ in rows]
    assert sum(r.n_removed for r in out) > 0 and all(r.line == 1 for r in out)
    assert linededup.remove_boilerplate(df.limit(0)).count() == 0
    clash = linededup.remove_boilerplate(df.withColumn("N_removed", F.lit("x")))
    assert clash.columns == [*df.columns, "n_lines", "n_removed"]


# ------------------------------------------------------------------ shards
def test_shards(spark, tmp_path):
    rng = random.Random(10)
    texts = [prose(rng, rng.randint(1, 60)) + rng.choice(["", ".", ", x", "  y", "\n z", "\nz"])
             for _ in range(200)] + odd_texts(rng)
    src = str(tmp_path / "docs")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string") \
        .repartition(3).write.parquet(src)
    docs = spark.read.parquet(src)
    manifest, layout = shards.write_shards(docs, path=str(tmp_path / "out"), sequence=64, shard_slots=50)
    rows = {r.slot: r for r in manifest.collect()}
    assert sorted(rows) == list(range(layout.total))
    coder = shards.Coder(shards.default_vocabulary())
    want = Counter()
    for t in texts:
        whole = coder.plain.encode_ordinary(t or "")
        assert np.frombuffer(coder.ids(t or ""), "<u2").tolist() == whole
        want.update([*whole, shards.DOCUMENT_END])
    read = list(shards.read_slots(layout, 0, layout.total))
    got = Counter(int(x) for s, block in enumerate(read) for x in block[:rows[s].n_ids])
    assert got == want
    # a text read back from its slots: the sequences of one input part in their first order
    numbers = shards.feistel(np.arange(layout.total), layout.total, inverse=True)
    in_order = [read[s] for s in np.argsort(numbers)]
    sizes = [rows[s].n_ids for s in np.argsort(numbers)]
    ids = [int(x) for block, n in zip(in_order, sizes) for x in block[:n]]
    read_back, at = Counter(), 0
    while at < len(ids):
        end = ids.index(shards.DOCUMENT_END, at)
        read_back[tuple(ids[at:end])] += 1
        at = end + 1
    assert read_back == Counter(tuple(coder.plain.encode_ordinary(t or "")) for t in texts)
    for s, block in enumerate(read):
        r = rows[s]
        assert (r.shard, r.at) == (s // 50, s % 50 * layout.stride)
        assert r.crc == zlib.crc32(block.astype("<u2").tobytes()) and r.first_key.isdigit()
    again, same = shards.write_shards(docs, path=str(tmp_path / "again"), sequence=64, shard_slots=50)
    assert {r.slot: r.crc for r in again.collect()} == {s: r.crc for s, r in rows.items()}
    resumed = list(shards.read_slots(layout, 70, 40))
    assert all((a == b).all() for a, b in zip(resumed, read[70:110], strict=True))
    assert sum((tmp_path / "out").joinpath(f).stat().st_size for f in
               [p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".bin"]) \
        == layout.total * layout.stride
    empty, none = shards.write_shards(docs.limit(0), path=str(tmp_path / "none"))
    assert empty.count() == 0 and none.total == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        a = shards.feistel(np.arange(n), n)
        assert sorted(a.tolist()) == list(range(n))
        assert (shards.feistel(a, n, inverse=True) == np.arange(n)).all()


def test_token_ids_without_look_ahead():
    coder = shards.loaded(shards.default_vocabulary())
    assert coder.quick is not coder.plain and shards.loaded(shards.default_vocabulary()) is coder
    blanks = [chr(c) for c in bytebpe.WHITE_SPACE]
    for a in blanks:
        assert not shards.blanks_in_a_row(f"{a}x{a}") and not shards.blanks_in_a_row(a)
        assert all(shards.blanks_in_a_row(f"x{a}{b}y") for b in blanks)
    ends = ["x", "é", "7", "'s", "'", "!", "\x1c", "\u200b", "中", ""]
    texts = [f"{left}{a}{right}{a}" for a in blanks for left in ends for right in ends]
    texts += [f"{t} {t}\n" for t in texts] + [f"a{a}{b}b" for a in blanks for b in blanks]
    used = [shards.blanks_in_a_row(t) for t in texts]
    assert 0 < sum(used) < len(texts)
    for t in texts + ["word 12, " * 20_000]:
        assert np.frombuffer(coder.ids(t), "<u2").tolist() == bytebpe.encode_text(coder.plain, t)
        assert coder.count(t) == len(coder.ids(t)) // 2


# ------------------------------------------------------------------ BPE
@pytest.mark.parametrize("hot_bytes, slice_bytes", [
    (bpe.HOT_BYTES, bpe.SLICE_BYTES), (bpe.HOT_BYTES, 500), (2000, 500), (0, 500)])
def test_bpe(spark, monkeypatch, hot_bytes, slice_bytes):
    monkeypatch.setattr(bpe, "SLICE_BYTES", slice_bytes)
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 50)).title() + rng.choice([".", "!?", ",", "'s", ""])
             for _ in range(60)] + odd_texts(rng) + ["a.\u0301 ' ;x;", "<|ENDOFTEXT|>. <|startoftext|>,",
                                                    "İΣ ΑΣ. l.l 'LL.", "\u0085a\u2003b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ids2 long, text string")
    coded = bpe.encode(df, hot_bytes=hot_bytes)
    got = {r.ids2: r for r in bpe.decode(coded).join(coded.select("ids2", "ids"), "ids2").collect()}
    library = bpe.load_tokenizer(bpe.default_vocabulary())
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == want
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)
    both = {r.ids2: r for r in bpe.encode(df, hot_bytes=hot_bytes, decoded="back", keep=["ids2"]).collect()}
    assert both.keys() == got.keys()
    for k, r in both.items():
        assert (r.ids, r.back) == (got[k].ids, got[k].decoded)
    assert bpe.encode(df.limit(0)).count() == 0


def test_bpe_asks_for_a_chunk_once(monkeypatch):
    rng = random.Random(13)
    library = bpe.load_tokenizer(bpe.default_vocabulary())
    texts = [prose(rng, rng.randint(0, 30)).title() + rng.choice(["", ".", " l.l", " É!?"]) for _ in range(40)]
    split = [t.encode().split() for t in [*texts, "", *texts]]
    words = sorted({w for chunks in split for c in chunks for w in bpe.parts_of(c)})
    ids = {w: library.encode(w.decode(), add_special_tokens=False).ids for w in words}
    some = words[::2]
    packed = bpe.Packed([pa.table({
        "h": pa.array(bpe.hashes(some).view(np.int64)),
        "packed": pa.array([np.array(ids[w], "<u2").tobytes() for w in some], pa.binary())})], "<u2")
    rest = {w: np.array(ids[w], "<u2") for w in words[1::2]}
    piece = pa.array([f" {p}".encode() for p in bpe.pieces()], pa.large_binary())
    asked = []
    look_up = packed.look_up
    packed.look_up = lambda w: (asked.extend(w), look_up(w))[1]
    for most in (bpe.KEPT_WORDS, 0):
        monkeypatch.setattr(bpe, "KEPT_WORDS", most)
        asked.clear()
        known = bpe.Known(packed, "<u2")
        for _ in range(2):
            flat, ends = known.ids_of(split, lambda: rest)
            back = bpe.spelt(piece, pa.array(flat.astype(np.int32)), ends).to_pylist()
            for t, a, b, spelled in zip([*texts, "", *texts], ends[:-1], ends[1:], back, strict=True):
                want = library.encode(t, add_special_tokens=False).ids
                assert flat[a:b].tolist() == want
                assert spelled == library.decode(want, skip_special_tokens=False)
        met = [w for c in {c for chunks in split for c in chunks} for w in bpe.parts_of(c)]
        assert Counter(asked) == Counter(met * (1 if most else 2))
    flat, ends = bpe.Known(packed, "<u2").ids_of([[], []], lambda: rest)
    assert len(flat) == 0 and ends.tolist() == [0, 0, 0]
    assert bpe.spelt(piece, pa.array(flat.astype(np.int32)), ends).to_pylist() == ["", ""]


# ------------------------------------------------------------------ URL rules
def test_url_rules(spark):
    rng = random.Random(12)
    hosts = ["net", "example.net", "a.example.net", "anet", "example.com", "x.org", "org", "", "q.E.net"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/english", "/de/x", "/fr/", "/a.b/c", "/(x"]
    urls = [f"{s}{h}{p}{q}" for s in ("http://", "//", "HTTP://u@") for h in hosts for p in paths
            for q in ("", "?a=/en/", "#f://z")] + [None, "", "://", "http://a\nb.net/en/"]
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.net/en", "block"), ("org", "block"),
             ("org/fr/", "allow"), ("net/a.b/", "allow"), ("net/(x", "allow"), ("Example.com/de/", "block"),
             ("net/", "block")]
    df = spark.createDataFrame([(i % 50, u) for i, u in enumerate(urls * 2)], "page_id long, url string")
    out = urlfilter.filter_urls(df, spark.createDataFrame(rules, "rule string, verdict string")).collect()
    assert len(out) == 2 * len(urls)
    for r in out:
        rest = r.url.partition("://")[2] if r.url and "://" in r.url else ""
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].partition("?")[0].partition("#")[0]
        fits = []
        for rule, verdict in rules:
            h, slash, p = rule.partition("/")
            if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(slash + p):
                fits.append((len(rule), rule, verdict))
        want = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want[1], want[2]), r.url
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {r.verdict for r in urlfilter.filter_urls(df, none).collect()} == {"allow"}
    assert urlfilter.filter_urls(df.limit(0), none).count() == 0
