import math
import random
from collections import Counter, defaultdict

import numpy as np

from vectorloom.llm import kneser_ney

SCHEMA = "doc_id bigint, text string, lang string"


def brute_force(trusted, order, spell):
    """p(context, character) of interpolated modified Kneser-Ney, None before a text."""
    grams = lambda t: zip(*((([None] * (order - 1) + list(t))[k:]) for k in range(order)))
    level = {order: Counter(g for t in trusted for g in grams(t))}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    parts = {}
    for k, n in level.items():
        c = [max(1, sum(v == i for v in n.values())) for i in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1])
        d = [0] + [min(max((i + 1) - (i + 2) * y * c[i + 1] / c[i], 0), i + 1) for i in range(3)]
        total, spare = defaultdict(float), defaultdict(float)
        for g, v in n.items():
            total[g[:-1]] += v
            spare[g[:-1]] += d[min(v, 3)]
        parts[k] = n, d, total, spare

    def p(g):
        if not g:
            return None
        n, d, total, spare = parts[len(g)]
        below = p(g[1:]) if len(g) > 1 else spell(g[-1])
        t = total.get(g[:-1], 0)
        return below if not t else max(n[g] - d[min(n[g], 3)], 0) / t + max(spare[g[:-1]] / t, 1e-12) * below

    return lambda text: math.exp(-sum(math.log(p(g)) for g in grams(text)) / len(text)) if text else None


def test_perplexity_is_that_of_whole_characters(spark, monkeypatch):
    rng = random.Random(5)
    words = ["мама", "папа", "ёж", "the", "Cat", "日本", "語る", "𝒳y", "sat\n", "99"]
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), "x") for i in range(40)]
    data += [(40, "a", "x"), (41, "ß€𝒵 qqq", "x"), (42, "\0\0 мама", "x"), (43, "", "x"), (44, None, None), (None, "папа", "x"), (3, "twice", "x")]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(25)], "doc_id bigint, quality int, toxic int")
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)          # noqa: E731
    for order in (2, 4):
        kept = []
        monkeypatch.setattr(kneser_ney, "speller", lambda *a, make=kneser_ney.speller: kept.append(make(*a)) or kept[-1])
        results = []
        for most in (kneser_ney.HELD_GRAMS, 0):                   # looked up in tasks, and joined
            monkeypatch.setattr(kneser_ney, "HELD_GRAMS", most)
            results.append(kneser_ney.classify(docs, labels, order=order, quantile=1.0).collect())
        monkeypatch.undo()

        def spell(c):
            number = int.from_bytes(c.encode(), "little")
            return math.exp(kept[0](np.asarray([number], np.uint32))[0])

        expected = brute_force([lower(t) for i, t, _ in data if i is not None and i < 25], order, spell)
        for rows in results:
            got = sorted((str(r.doc_id), r.perplexity or 0.0) for r in rows)
            want = sorted((str(i), expected(lower(t or "")) or 0.0) for i, t, _ in data)
            assert [g[0] for g in got] == [w[0] for w in want]
            assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9)


def test_characters_of_one_byte_class_differ(spark):
    """а and е are bytes of the same classes: a text that has the one for the other was kept."""
    rng = random.Random(6)
    good = [" ".join(rng.choice(["мама", "баба", "рама", "лапа"]) for _ in range(30)) for _ in range(30)]
    data = [(i, t, "ru") for i, t in enumerate(good)] + [(100, good[0].replace("а", "е"), "ru")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(spark.createDataFrame(data, SCHEMA), labels, quantile=1.0).collect()}
    assert all(got[i].kept for i in range(30)) and not got[100].kept
    assert got[100].perplexity > 2 * got[0].perplexity


def test_characters_of_any_bytes():
    texts = [b"aB", "é日𝒳".encode(), b"", b"\x80\x80\x80\x80\x80", b"\xff\xc3", b"\xa9z"]
    offs = np.cumsum([0, *map(len, texts)])
    symbols, at = kneser_ney.characters(np.frombuffer(b"".join(texts), np.uint8), offs)
    assert np.diff(at).tolist() == [2, 3, 0, 2, 2, 2]
    assert symbols[:5].tolist() == [97, 98, *(int.from_bytes(c.encode(), "little") for c in "é日𝒳")]
