from vectorloom.sources.testdata import containment_pairs


def test_containment_exact(spark):
    hot = "all rights reserved by the owner"
    docs = [
        (1, f"intro. {hot}. The quick brown fox jumps over the lazy dog. end"),
        (2, f"{hot} and more {hot}"),
        (3, "The quick brown fox jumps over the lazy cat."),          # shares shingles, not contained
        (4, "xThe quick brown fox jumps over the lazy dog. twice: The quick brown fox jumps over the lazy dog."),
        (5, "short one here"),
        (6, None),
        (7, "the shorts onerous, xshort onely a --- b"),
        (8, "one tiny little thing, a lonely tiny little things"),
        (9, ""),
    ] + [(100 + i, f"filler {i}. {hot}. filler") for i in range(30)]
    items = [
        (10, "The quick brown fox jumps over the lazy dog."),
        (11, hot),
        (12, "short one"),
        (13, "nowhere to be found in any document at all today"),
        (14, "---"),
        (15, "ne tiny little thing"),
        (16, "ne tin"),
        (17, ""),
        (18, None),
        (19, "short one"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in containment_pairs(d, it, "doc_id", "item_id").collect()}
    want = {(dd, ii) for dd, t in docs for ii, x in items if None not in (t, x) and x in t}
    assert got == want
    assert (4, 10) in got and (3, 10) not in got and len([p for p in got if p[1] == 11]) == 32


def test_few_items_are_searched_without_a_join(spark):
    docs = [(1, "a one two three four b"), (1, "a one two three four b"), (1, "one two three fourx"), (None, "one two three four"),
            (2, "one two"), (3, None), (4, "x one two three y")]
    items = [(1, "one two three four"), (1, "one two three four"), (2, "one two"), (None, "one two three"), (None, "one"),
             (3, "one two three")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    few = containment_pairs(d, it, "doc_id", "item_id")
    assert "Join" not in few._jdf.queryExecution().toString() and "Exchange" not in few._jdf.queryExecution().toString()
    joined = containment_pairs(d, it, "doc_id", "item_id", scanned_chars=0)
    assert "Join" in joined._jdf.queryExecution().toString()
    in_order = lambda df: sorted(map(str, df.collect()))      # noqa: E731
    assert in_order(few) == in_order(joined)
