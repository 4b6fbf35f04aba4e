import os
import shutil

from vectorloom.plans import registry, registry_streams as RS
from vectorloom.session import scratch_path
from vectorloom.sources import testdata as T
from vectorloom.streaming import corpus as S


def test_progress_keeps_every_batch_over_a_restart(spark, sf, tmp_path):
    """Over a hundred batches, more than Spark keeps, and a restart in between."""
    m, v = registry._model_and_vocab(spark, sf)
    q = T.vector_queries(spark, sf).select("qid", "embedding").limit(5)
    src = RS.write_stream_corpus(spark, sf, 110)
    shards = sorted(f for f in os.listdir(src) if f.endswith(".gz"))
    arriving, folder, ckpt = tmp_path / "in", scratch_path(spark, "progress"), scratch_path(spark, "ck")
    arriving.mkdir()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for part in (shards[:6], shards[6:]):
            for f in part:
                shutil.copy(f"{src}/{f}", arriving)
            S.stream_topk(RS._stream(spark, str(arriving), 1), q, m, v, 3, ckpt, folder)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    rows = sorted(S.progress_rows(spark, folder).collect())
    assert len(rows) == len(shards) > 100 and [r["batch_id"] for r in rows] == list(range(len(rows)))
    total = 0
    for r in rows:
        total += r["input_rows"]
        assert r["total_rows"] == total and r["seconds"] > 0 and r["rows_per_second"] >= 0
    assert total == T.passages(spark, sf).count()
