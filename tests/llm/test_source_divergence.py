"""The source audit against sums over every term, with Python integers."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vectorloom.llm import source_divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, n bigint"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, min_docs=10, top=10):
    count, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", TERM.findall(lower(text or ""))
        sources[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, names in sources.items():
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        v = len(kept)
        total = Counter()
        for s in names:
            total.update({t: n for t, n in count[lang, s].items() if t in kept})

        def prices(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}
        p, q = {s: prices(count[lang, s]) for s in names}, prices(total)

        def gap(a, b):
            return (a - b) ** 2 // (a + b)
        for s in names:
            pair = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in names - {s})
            term = sorted((-gap(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            for part, found in ("pair", pair), ("term", term[:top]):
                out += [(lang, s, part, i.decode(), -x, r + 1) for r, (x, i) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [w for i in range(150) for w in [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}"] * (1 + 200 // (i + 1))]
    words += ["É", "日本", "ÀB", "MixedCase", "mixedcase"]
    out = []
    for i in range(500):
        source = "big" if i % 3 == 0 else f"s{rng.randrange(7)}"
        skew = rng.choice([1, 1, 2, 5])
        text = " ".join(rng.choice(words[:len(words) // skew]) for _ in range(rng.randrange(60)))
        out.append((text.replace("wa", "WA", rng.randrange(4)), rng.choice(["en", "en", "de"]), source))
    out += [(None, "en", "empty"), ("12 !!", "fr", "only"), ("", None, None), ("rare words here", None, "x"),
            (None, None, None), ("été " * 12, "fr", "only2"), ("word " * 50_000, "en", "long"), ("a" * 200_000, "en", "s1")]
    return out + out[:30] + [("tie tye", "tt", s) for s in ("é", "z", "a", "Z")] * 10


def audited(spark, rows, **options):
    df = spark.createDataFrame([(1, t, lang, s, 1, "t", 7) for t, lang, s in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, source_divergence.audit(df, **options).collect()))


def test_equals_sums_over_terms(spark, rows):
    want = brute(rows)
    assert any(r[2] == "term" for r in want) and len(want) > 100
    assert audited(spark, rows) == want


def test_tiles_and_blocks_change_nothing(spark, rows):
    assert audited(spark, rows, tile=3, block_terms=20) == brute(rows)
    assert audited(spark, rows, min_docs=1, top=3) == brute(rows, 1, 3)


def test_empty_table_and_texts_without_terms(spark):
    assert audited(spark, []) == []
    assert audited(spark, [(None, "en", "a"), ("1 2", "en", "b")]) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_halved_blocks_give_the_same_joint_tables(monkeypatch):
    rng = np.random.default_rng(4)
    n_terms, n_sources = 300, 6
    c = rng.geometric(0.05, (n_terms, n_sources)) * (rng.random((n_terms, n_sources)) < 0.6)
    p = 1 + 10**9 * (c + 2) // (c.sum(axis=0) + 2 * n_terms)
    zero = 1 + 10**9 * 2 // (c.sum(axis=0) + 2 * n_terms)
    t, s = np.nonzero(c)
    for columns in (8, 100, 10_000):
        monkeypatch.setattr(source_divergence, "COLUMNS", columns)
        sums, terms = source_divergence.block_gaps(t, c.sum(axis=1), np.zeros(len(t), int), s, p[t, s],
                                                   (zero, zero), True)
        for i in range(n_sources):
            for j in range(i + 1, n_sources):
                assert sums[i, j] == sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(p[:, i], p[:, j]))
                assert terms[i, j] == n_terms
