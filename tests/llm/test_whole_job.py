"""Cases in which an operator once did less than its whole job."""

import random

import corpus_pipeline as P
from riskframe.llm import ngramjoin

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
                    for _ in range(n))


# ------------------------------------------------------------------ pipeline, language
def test_short_texts_of_a_known_language_stay(spark):
    rng = random.Random(23)
    docs = spark.read.parquet(SF + "/documents.parquet")
    firsts = [(w, r.lang) for r in docs.limit(100).collect() for w in r.text.split()[:2] if w.isalpha()]
    rows = [(-1 - i, t, k, "s", len(t)) for i, (t, k) in enumerate(
        [("A.", "en"), ("Avec.", "fr"), *firsts])]
    unlike = ["".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω ") for _ in range(600)) for _ in range(20)]
    rows += [(-10_000 - i, t, None, "s", len(t)) for i, t in enumerate(unlike)]
    after = P.language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF)
    kept = {r.doc_id for r in after.collect()}
    clean = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}
    assert clean | {r[0] for r in rows if r[2]} <= kept
    assert sum(r[0] in kept for r in rows if not r[2]) <= 10      # long texts are judged


# ------------------------------------------------------------------ pipeline, lines
def test_boilerplate_leaves_documents_that_consist_mostly_of_it(spark):
    rng = random.Random(21)
    common, article = [prose(rng, 12) for _ in range(3)], [prose(rng, 30) for _ in range(2)]
    own = [prose(rng, 6) for _ in range(6)]
    texts = ["\n".join([*common, x]) for x in own]                # more than half boilerplate
    texts += [common[0], ""]                                      # nothing else, no copy
    texts += ["\n".join(article)] * 6                             # copies of one article
    texts[7] = texts[8].replace("\n", "\n\n")                     # and one with a blank line
    rows = [(i, t, "en", f"s{i % 7}", len(t)) for i, t in enumerate(texts)]
    after = P.lines(spark, spark.createDataFrame(rows, DOCS), SF)
    got = [r.text for r in after.orderBy("doc_id").collect()]
    assert got == [*own, "", *texts[7:]]
    left = P.near_duplicates(spark, after, SF).collect()
    assert sum(article[0] in r.text for r in left) == 1


# ------------------------------------------------------------------ op6, pipeline
def test_blocks_of_short_texts_are_bounded_in_rows(spark, monkeypatch):
    rng = random.Random(22)
    base, n, seen = prose(rng, 40), 6000, []
    per_block = ngramjoin.per_block

    def watched(placed, cell, *rest):
        seen.append(placed.groupBy(*cell, "i", "j").count().agg({"count": "max"}).first()[0])
        return per_block(placed, cell, *rest)

    monkeypatch.setattr(ngramjoin, "per_block", watched)
    df = spark.createDataFrame([(i, f"{base} w{i}") for i in range(n)], "doc_id long, text string")
    out = ngramjoin.near_duplicates(df).collect()
    assert seen[0] <= 2.5 * 1024
    assert {(r.class_id, r.n_links) for r in out} == {(0, n - 1)} and sum(r.kept for r in out) == 1
