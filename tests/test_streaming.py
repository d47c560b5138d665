"""The stateless per-row stages (feature functions, fitted encoders, compiled
network) apply to a streaming frame unchanged."""


from riskframe.operators import scoring as SC
from riskframe.sources.tables import embedding_features

from conftest import SF001


def test_compiled_scoring_on_a_stream(spark, tmp_path):
    batch = embedding_features(spark, SF001, 64)
    src = tmp_path / "in"
    batch.write.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    feats = [f"e_{i}" for i in range(64)]
    mlp = SC.rule_weights([64, 8, 1], scale=0.3)
    scored = SC.score(stream, mlp, feats).select("vec_id", "probability", "prediction")
    q = (scored.writeStream.format("memory").queryName("scored_stream")
         .option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.vec_id: r.probability for r in spark.table("scored_stream").collect()}
    want = {r.vec_id: r.probability for r in SC.score(batch, mlp, feats).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
