"""Every stage of the pipeline against its plain version, on its own input."""

import brute
import corpus_pipeline as P
from riskframe.llm import bpe
from riskframe.llm.common import shared_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    library = bpe.load_tokenizer(bpe.default_vocabulary())
    for name, stage in P.STAGES:
        before = docs.orderBy("doc_id").collect()
        docs = shared_table(stage(spark, docs, SF))
        after = docs.orderBy("doc_id").collect()
        by_id = {r.doc_id: r for r in before}
        if name == "language":
            kept = {r.doc_id for r in after}
            assert all(r.doc_id in kept for r in before if sum(c.isalpha() for c in r.text) > 20)
            assert all(any(c.isalpha() for c in r.text) for r in after)
        elif name == "lines":
            assert [r.text for r in after] == brute.without_boilerplate([(r.text, r.source) for r in before])
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "near_duplicates":
            want, n = brute.near([(r.doc_id, r.text) for r in before])
            assert len(after) == n and {r.doc_id for r in after} == {c for _, c, _ in want}
        elif name == "clean_of_benchmarks":
            bad = {d for d, _ in brute.leaks([(r.doc_id, r.text) for r in before], items)}
            assert [r.doc_id for r in after] == [r.doc_id for r in before if r.doc_id not in bad]
        else:
            assert [r.doc_id for r in after] == [r.doc_id for r in before]
            for r in after:
                assert list(r.ids) == library.encode(by_id[r.doc_id].text, add_special_tokens=False).ids
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
        empty = stage(spark, spark.createDataFrame([], spark.read.parquet(SF + "/documents.parquet").schema), SF)
        assert empty.count() == 0


def test_odd_rows_survive_every_stage(spark):
    schema = spark.read.parquet(SF + "/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0),
            (2, "the same words here and there again", None, None, 1),
            (2, "the same words here and there again", None, None, 1), (3, "12 !?", "en", "b", 5)]
    for _, stage in P.STAGES:
        assert stage(spark, spark.createDataFrame(rows, schema), SF).count() <= len(rows)
