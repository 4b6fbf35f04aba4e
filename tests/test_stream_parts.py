import numpy as np
import pytest

from vectorloom.operators import kernels, text
from vectorloom.plans import registry, registry_streams as RS
from vectorloom.streaming import corpus, stateful


@pytest.mark.parametrize("query_bytes, row_bytes", [(1 << 26, 1 << 26), (1 << 15, 1 << 14)])
def test_a_lexicon_beyond_one_part_is_met_part_by_part(spark, sf, monkeypatch, query_bytes, row_bytes):
    """It raised an error before; all queries were held by every task at once."""
    batch = {tuple(r) for r in registry.QUERIES["topk_full"](spark, sf).collect()}
    monkeypatch.setattr(text, "HELD_LEXICON_BYTES", 1 << 14)
    monkeypatch.setattr(stateful, "QUERY_BLOCK_BYTES", query_bytes)
    monkeypatch.setattr(corpus, "HELD_ROWS_BYTES", row_bytes)
    m, v = registry._model_and_vocab(spark, sf)
    assert len(text.sent_lexicons({"": m}, v, last=True)) > 3
    assert {tuple(r) for r in RS.q_stream_topk(spark, sf).collect()} == batch


def test_progress_counts_every_passage_with_a_lexicon_in_parts(spark, sf, monkeypatch):
    monkeypatch.setattr(text, "HELD_LEXICON_BYTES", 1 << 14)
    rows = RS.q_stream_progress(spark, sf).collect()
    assert sorted(r["batch_id"] for r in rows) == list(range(RS.PROGRESS_FILES))
    assert {r["passages"] for r in rows} == {spark.read.parquet(f"{sf}/documents.parquet").count()}


def test_state_keeps_the_best_of_strings_and_repeats():
    import pandas as pd

    class Value:
        held = None
        exists = lambda self: self.held is not None         # noqa: E731
        get = lambda self: self.held                        # noqa: E731

        def update(self, value):
            self.held = value

    for names in (list("edcba"), [5, 4, 3, 2, 1]):
        top = stateful._TopK(3, "string")
        top.top = Value()
        list(top.handleInputRows((7,), iter([pd.DataFrame({"docid": names, "score": [.1, .5, .5, .2, .9]})]), None))
        assert top.top.held == ([names[4], *sorted(names[1:3])], [.9, .5, .5])
        again = pd.DataFrame({"docid": [names[4], names[0]], "score": [.9, .7]})
        out = list(top.handleInputRows((7,), iter([again.head(1), again.tail(1)]), None))
        assert top.top.held == ([names[4], names[0], min(names[1:3])], [.9, .7, .5]) and out[0]["kept"][0] == 3


def test_a_value_read_once_is_not_kept(spark):
    sent = spark.sparkContext.broadcast(np.arange(5))

    def run(_):
        first = kernels.value_once(sent).sum()
        return [(int(first), "_value" in vars(sent), int(kernels.value_once(sent).sum()))]

    assert spark.sparkContext.parallelize([0], 1).mapPartitions(run).collect() == [(10, False, 10)]
