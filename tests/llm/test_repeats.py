"""Rows that repeat or share ids, vectors of several lengths, huge components, ids of other types."""
import random

import numpy as np
from test_llm import SCHEMA, closure, prose

from vectorloom.llm import components, decontam, embedding_dedup, jaccard_join


def test_components_grow_with_more_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    labels, done = None, []
    for part in (links[:100], links[100:101], links[101:180], [], links[180:]):
        done += part
        found = spark.createDataFrame(part, "a bigint, b bigint")
        labels = components.components(found) if labels is None else components.merged(labels, found)
        want = closure(range(300), done)
        met = {x for a, b in done if a != b for x in (a, b)}
        assert {r.node: r.component_id for r in labels.collect()} == {x: want[x] for x in met}


def test_vectors_of_one_id_of_many_lengths_and_sizes(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(1, base, 0), (1, base, 0), (1, -base, 0), (2, base * 1e200, 0), (3, base[:8], 0), (4, base[:8], 0),
            (5, np.append(base, 0.0), 0), (6, base * 1e-200, 0), (None, base, 0), (7, base, None)]
    half = np.zeros(16)
    half[0], half[1] = 1e200, 0.0
    other = np.zeros(16)
    other[0], other[1] = 0.5e200, np.sqrt(3) / 2 * 1e200              # cosine 0.5
    rows += [(8, half, 1), (9, other, 1), (10, [1e308] * 16, 1), (11, [1e308] * 16, 1)]
    df = spark.createDataFrame([(i, [float(x) for x in v], x, "clash") for i, v, x in rows],
                               "vec_id bigint, embedding array<double>, label int, rep string")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or 0) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(False, 1, 0, 1), (False, 1, 3, 1), (False, 1, 3, 1), (False, 2, 3, 1), (False, 3, 1, 3), (False, 4, 1, 3),
                   (False, 5, 0, 5), (False, 6, 3, 1), (False, 7, 0, 7), (False, 8, 0, 8), (False, 9, 0, 9),
                   (False, 10, 1, 10), (False, 11, 1, 10), (True, 0, 0, 0)]


def test_near_duplicate_stage_drops_rows_not_ids(spark):
    import corpus_pipeline
    rng = random.Random(3)
    base, unique = prose(rng, 120), prose(rng, 90)
    rows = [(3, base), (3, base), (7, base + " tail"), (7, unique), (None, base), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_near_duplicates(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([(3, base), (7, unique), (None, None), (8, "")], key=str)
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs.limit(0), "").collect() == []


def test_item_ids_of_other_types(spark):
    rng = random.Random(6)
    item = prose(rng, 30)
    docs = spark.createDataFrame([(1, "x y " + item + " z", "en", "s", 1), (2, prose(rng, 50), "en", "s", 1)], SCHEMA)
    for kind, value in (("int", 5), ("string", "five"), ("smallint", 5)):
        items = spark.createDataFrame([(value, item)], f"item_id {kind}, text string")
        assert [(r.doc_id, r.item_id) for r in decontam.overlaps(docs, items).collect()] == [(1, value)]


def test_join_by_a_row_number(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e f"] * 3 + ["z y x w v"])], "`row.no` bigint, text string")
    got = {tuple(r)[0]: tuple(r)[2] for r in jaccard_join.join_components(docs, id_col="row.no").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_no_table_of_the_jaccard_join_repeats_its_joins(spark, monkeypatch):
    """What a turn reads many times is written once: each join is a broadcast that the driver holds for a while."""
    joins, written = {}, jaccard_join.cut_lineage

    def counted(df, name="stage"):
        joins[name] = max(joins.get(name, 0), df._jdf.queryExecution().analyzed().toString().count("Join "))
        return written(df, name)

    monkeypatch.setattr(jaccard_join, "cut_lineage", counted)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1:]])) for i in range(0, 40, 13)]
    rows += [(100 + i, " ".join(f"v{i}_{j}" for j in range(20))) for i in range(3)] + [(200, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join_components(docs, n=1, percent=80).collect()}
    assert got == {i: 0 if i < 40 else i for i, _ in rows}
    assert max(joins.values()) <= 12, joins
