"""Line dedup against all runs of lines of all documents, compared as texts."""
import random

import pytest
from test_llm import SCHEMA, lower, prose

from vectorloom.llm import line_dedup


def own_lines(text):
    return [" ".join(lower(x).split()) for x in (text or "").split("\n") if x.split()]


def repeats(docs, least):
    """Per document the lines of its runs of ``least`` words that also stand earlier; all runs are compared."""
    first, places = {}, []
    for i, lines in sorted(docs.items()):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= least:
                    key = tuple(lines[a:b])
                    first.setdefault(key, (i, a))
                    places.append((key, i, a, b))
    gone = {i: set() for i in docs}
    for key, i, a, b in places:
        if first[key] != (i, a):
            gone[i] |= set(range(a, b))
    return gone


def found_runs(spark, data):
    df = spark.createDataFrame([(i, t) for i, t in data], "doc bigint, text string")
    gone = {i: set() for i, _ in data}
    for r in line_dedup.repeated_runs(df).collect():
        gone[r.doc] |= set(range(r.from_line, r.to_line))
    return gone


def test_a_run_whose_fingerprint_stands_alone_elsewhere(spark):
    rng, data = random.Random(1), []
    for k in range(40):         # the first line's first place is in a document without the second line
        one, two, tail = (f"{prose(rng, n)} k{k}" for n in (11, 11, 1))
        data += [(10 * k, one), (10 * k + 1, f"a{k}\n{one}\n{two}\n{tail}"), (10 * k + 2, f"b{k}\n{one}\n{two}\n{tail}")]
    gone = found_runs(spark, data)
    for k in range(40):
        assert gone[10 * k] == set() and gone[10 * k + 2] == {1, 2, 3}


@pytest.mark.parametrize("seed", range(3))
def test_against_all_runs(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, n) for n in (1, 2, 5, 9, 9, 12, 12, 25)]
    data = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.85 else prose(rng, rng.randrange(1, 30))
                          for _ in range(rng.randrange(1, 16)))) for i in range(120)]
    data += [(500, None), (501, ""), (502, "\n \n"), (503, "\n".join([pool[0]] * 40))]
    docs = {i: own_lines(t) for i, t in data}
    gone = found_runs(spark, data)
    sure, may = repeats(docs, 20), repeats(docs, 8)
    for i in docs:
        assert sure[i] <= gone[i] <= may[i], i
    assert sum(map(len, sure.values())) > 200
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], SCHEMA)
    for r in line_dedup.dedup_lines(df).collect():
        assert (r.n_lines, r.n_deleted) == (len(docs[r.doc_id]), len(gone[r.doc_id]))


def test_very_long_text_and_clashing_columns(spark):
    rng = random.Random(7)
    long = "\n".join(prose(rng, 9) for _ in range(20_000))
    df = spark.createDataFrame([(2, long, 5, "x", "h"), (1, long[:900_000], 6, "y", "g"), (3, "short", None, None, None)],
                               "doc_id bigint, text string, n_lines int, doc string, lines string")
    out = line_dedup.dedup_lines(df)
    assert sorted(out.columns) == sorted([*df.columns, "n_deleted"])
    got = {r.doc_id: r for r in out.collect()}
    whole = long[:900_000].count("\n")
    assert got[1].n_deleted == 0 and got[3].text == "short"
    assert whole <= got[2].n_deleted <= whole + 1 and got[2].n_lines == 20_000
