import gzip
import json
import os
import tempfile

import numpy as np

from vectorloom.sources import models as MD
from vectorloom.sources import trec as TR
from vectorloom.plans import registry


def _tmp():
    return tempfile.mkdtemp(prefix="vl-test-")


def test_topics_and_qrels_rules(spark):
    d = _tmp()
    with open(f"{d}/topics.tsv", "w") as f:
        f.write("q1\tfirst\n\n   \nq2\ttext\twith tab\nq1\tsecond\nnotab\n")
    with open(f"{d}/qrels.tsv", "w") as f:
        f.write("q1\tQ0\td1\t0\nq1\tQ0\td2\t1\nq1\tQ0\td1\t1\nq2\tQ0\td3\nq2\tQ0\td4\t1\textra\n\n")
    t = {r["qid"]: r["text"] for r in TR.read_topics(spark, f"{d}/topics.tsv").collect()}
    assert t == {"q1": "second", "q2": "text\twith tab"}
    q = sorted(tuple(r) for r in TR.read_qrels(spark, f"{d}/qrels.tsv").collect())
    assert q == [("q1", "d1", 1), ("q1", "d2", 1)]


def test_corpus_pool_and_missing(spark):
    d = _tmp()
    rows = [[{"docid": "a", "title": "T", "text": "x"}, {"docid": "b", "title": None, "text": "y"}],
            [{"docid": "c", "title": "", "text": None}, {"docid": "a", "title": "", "text": "later"}]]
    for i, shard in enumerate(rows):
        with gzip.open(f"{d}/docs-{i:02d}.jsonl.gz", "wt") as f:
            for r in shard:
                f.write(json.dumps(r) + "\n")
    corpus = TR.read_corpus(spark, d)
    got = {r["docid"]: r["text"] for r in TR.dedupe_passages(corpus).collect()}
    assert got == {"a": "later", "b": "y", "c": ""}
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "z", 1)], "qid string, docid string, rel int")
    found, missing = TR.pooled_passages(corpus, qrels)
    assert [r["docid"] for r in found.collect()] == ["a"]
    assert [r["docid"] for r in missing.collect()] == ["z"]
    empty = _tmp()
    try:
        TR.read_corpus(spark, empty)
        raise AssertionError("expected an error")
    except FileNotFoundError:
        pass


def test_packed_roundtrip_and_legacy(spark, sf):
    for r in ("int4", "turbo-lloyd-1", "turbo-lloyd-2", "int8"):
        m = registry.recipe(spark, sf, r)
        packed, meta = MD.export_packed(m)
        path = MD.save_packed(packed, meta, f"{_tmp()}/model")
        assert path.endswith(".packed")
        p2, m2 = MD.load_packed(spark, path)
        assert m2["bits"] == m.bits and m2["embed_dim"] == m.dim
        a = {x["row_id"]: np.array(x["embedding"]) for x in MD.decode_packed(p2, m2).collect()}
        from vectorloom.operators.tables import decode
        b = {x["row_id"]: np.array(x["embedding"]) for x in decode(m).collect()}
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    # legacy: scalar codebook value, no bits / method / source
    d = _tmp()
    packed = spark.createDataFrame([(i, bytearray(4), 1.0) for i in range(10)],
                                   "row_id bigint, packed binary, scale double")
    packed.write.parquet(f"{d}/x.packed/packed")
    with open(f"{d}/meta.json", "w") as f:
        json.dump({"codebook_val": 0.0499, "embed_dim": 32, "vocab_size": 10,
                   "tokenizer_name": "words"}, f)
    spark.read.text(f"{d}/meta.json").write.text(f"{d}/x.packed/meta")
    _, meta = MD.load_packed(spark, f"{d}/x.packed")
    assert meta["codebook"] == [-0.0499, 0.0499] and meta["bits"] == 1
    assert meta["method"] == "turbo-lloyd" and meta["source_model"] == ""


def test_model_save_load(spark, sf):
    m = registry.recipe(spark, sf, "turbo-lloyd-3")
    path = MD.save_model(m, _tmp())
    back = MD.load_model(spark, path)
    assert (back.kind, back.bits, back.dim, back.provenance) == (m.kind, 3, m.dim, m.provenance)
    assert sorted(map(tuple, back.weights.select("row_id", "codes").collect())) == \
        sorted(map(tuple, m.weights.select("row_id", "codes").collect()))
