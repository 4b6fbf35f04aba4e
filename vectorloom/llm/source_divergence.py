"""How far the sources of a language differ in their words, by products of one-hot count levels.

Each term of a language is a row, each (source, count) that occurs in a column, and a cell is
1 where the source has the term that often. The product of the columns with their transpose is
every joint table at once: how many terms have count c in one source and count d in the other.
A divergence is a sum over terms of a function of the two counts alone, so each cell of a joint
table is priced once and multiplied by its number of terms.

1. ``term_counts``: occurrences and documents per (lang, source, term), added up over a few
   megabytes of text by Arrow's exact dictionaries, then in one shuffle by (lang, term);
2. terms are dealt into blocks of similar frequency, so that a block has few levels, and
   sources into tiles; (block, tile, tile) is one group: a product of two column blocks;
3. in a group, blocks with many columns are halved until the product is small; the cells are
   priced there, and only one sum per pair of sources leaves the group.

All arithmetic is on whole numbers: products of 0/1 matrices in float32 are exact below 2^24
terms a block (blocks hold far fewer), prices are int64 or decimals.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import LOWER, byte_class, chunks, runs, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# a term is a run of ASCII letters and non-ASCII characters
LETTERS = byte_class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
CHUNK = 4 << 20         # bytes of whole texts counted at once
SENT = 1 << 15          # rows of counts that leave a task at once
UNIT = 1_000_000_000
COLUMNS = 1024          # one-hot columns of a side beyond which a block of terms is halved


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        groups = pa.Table.from_arrays([b.column(0), b.column(1)], ["l", "s"])
        groups = groups.append_column("i", pa.array(np.arange(b.num_rows)))
        named = groups.group_by(["l", "s"], use_threads=False).aggregate([("i", "list")])
        member = np.zeros(b.num_rows, dtype=np.int64)
        lang, source = (named.column(c).combine_chunks() for c in ("l", "s"))
        lists = named.column("i_list").combine_chunks()
        member[lists.flatten().to_numpy()] = np.repeat(np.arange(len(named)), lists.value_lengths().to_numpy())
        buf, offs = text_bytes(b.column(2))
        for lo, hi, part, at in chunks(buf, offs, CHUNK):
            inside = LETTERS[part]
            starts, ends, owner = runs(inside, at)
            if not len(starts):
                continue
            letters = LOWER[part[inside]]
            cuts = np.zeros(len(starts) + 1, dtype=np.int64)
            np.cumsum(ends - starts, out=cuts[1:])
            words = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(letters)]).dictionary_encode()
            code, n_terms = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            in_doc, times = np.unique(owner * n_terms + code, return_counts=True)     # a document's terms
            key = member[lo + in_doc // n_terms] * n_terms + in_doc % n_terms
            key, back = np.unique(key, return_inverse=True)
            n, in_docs = np.bincount(back, weights=times).astype(np.int64), np.bincount(back)
            for first in range(0, len(key), SENT):
                some = slice(first, first + SENT)
                g = pa.array(key[some] // n_terms)
                yield pa.RecordBatch.from_arrays(
                    [lang.take(g), source.take(g),
                     words.dictionary.take(pa.array(key[some] % n_terms)).cast(pa.large_string()).cast(pa.string()),
                     pa.array(n[some]), pa.array(in_docs[some])], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, source, term, n, total, first): occurrences of the terms in ``min_docs`` documents of a language.

    ``total`` is the term's number in all sources of the language; ``first`` marks one row of
    each (lang, term). Every row of ``docs`` is a document of its own.
    """
    counted = docs.select("lang", "source", "text").mapInArrow(
        _count_terms, "lang string, source string, term string, n bigint, docs bigint")
    # one shuffle: both the sums per source and those per term are made where (lang, term) lies
    summed = (counted.repartition("lang", "term").groupBy("lang", "term", "source")
              .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    of_term = Window.partitionBy("lang", "term")
    return (summed.withColumn("total", F.sum("n").over(of_term)).withColumn("docs", F.sum("docs").over(of_term))
            .withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
            .filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "total", "first"))


def price(count: str | Column, n: str, v: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (n + 2 v)) in whole numbers, whatever their size."""
    count = F.col(count) if isinstance(count, str) else count
    times = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.call_function("div", times, (F.col(n) + 2 * F.col(v)).cast("decimal(20,0)")) + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _columns(source: np.ndarray, p: np.ndarray, term: np.ndarray, n_terms: int,
             zero: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one-hot matrix (terms x columns), and each column's source and price.

    ``zero``: the price of count 0 of every source, which fills the cells of terms it lacks.
    """
    level = np.concatenate([source, np.arange(len(zero))])
    paid = np.concatenate([p, zero])
    order = np.lexsort((paid, level))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (level[order[1:]] != level[order[:-1]]) | (paid[order[1:]] != paid[order[:-1]])
    column = np.empty(len(order), dtype=np.int64)
    column[order] = np.cumsum(new) - 1
    x = np.zeros((n_terms, new.sum()), dtype=np.float32)
    x[:, column[len(source):]] = 1
    x[term, column[len(source):][source]] = 0
    x[term, column[:len(source)]] = 1
    return x, level[order[new]], paid[order[new]]


def block_gaps(term: np.ndarray, weight: np.ndarray, side: np.ndarray, source: np.ndarray, p: np.ndarray,
               zero: tuple[np.ndarray, np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sums, terms) per (source of side 0, source of side 1) over the terms given.

    term 0..T-1 with a ``weight`` each that orders them; side, source and p of each count;
    zero[s][i]: the price of count 0 of source i of side s. ``same``: both sides are one
    tile, whose counts are given once, as side 0.
    """
    sizes = len(zero[0]), len(zero[1])
    sums, terms = np.zeros(sizes, dtype=np.int64), np.zeros(sizes, dtype=np.int64)
    rank = np.empty(len(weight), dtype=np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(weight))
    order = np.argsort(rank[term], kind="stable")
    term, side, source, p = rank[term][order], side[order], source[order], p[order]
    todo = [(0, len(weight))]
    while todo:
        lo, hi = todo.pop()
        cut = slice(*np.searchsorted(term, (lo, hi)))
        t, s, g, q = term[cut] - lo, side[cut], source[cut], p[cut]
        of = [s == 0, s == 0 if same else s == 1]
        if hi - lo > 16 and max(len(np.unique(g[o] * (2 * UNIT) + q[o])) for o in of) > COLUMNS:
            todo += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
            continue
        left = _columns(g[of[0]], q[of[0]], t[of[0]], hi - lo, zero[0])
        right = left if same else _columns(g[of[1]], q[of[1]], t[of[1]], hi - lo, zero[1])
        joint = left[0].T @ right[0]                  # every joint table of the two tiles
        a, b = np.nonzero(joint)
        if same:
            a, b = a[left[1][a] < left[1][b]], b[left[1][a] < left[1][b]]
        n = joint[a, b].astype(np.int64)
        pair = left[1][a] * sizes[1] + right[1][b]
        # below 2^53: at most terms * UNIT a block
        gaps = np.bincount(pair, weights=n * _gap(left[2][a], right[2][b]), minlength=sums.size)
        sums += gaps.astype(np.int64).reshape(sizes)
        terms += np.bincount(pair, weights=n, minlength=sums.size).astype(np.int64).reshape(sizes)
    return sums, terms


def _tile_gaps(counts: pa.Table, groups: pa.Table) -> pa.Table:
    if not len(counts) or not len(groups):
        return pa.table({c: pa.array([], pa.string() if c == "lang" else pa.int64()) for c in
                         ("lang", "i", "j", "sum", "terms")})
    index, tile = np.asarray(groups["index"]), np.asarray(groups["home"])
    x, y = groups["x"][0].as_py(), groups["y"][0].as_py()
    own = [np.sort(index[tile == x]), np.sort(index[tile == y])]
    zero = []
    for o in own:
        at = np.argsort(index, kind="stable")
        zero.append(np.asarray(groups["p0"])[at][np.searchsorted(index[at], o)])
    words = counts["term"].combine_chunks().dictionary_encode()
    term = words.indices.to_numpy().astype(np.int64)
    weight = np.zeros(len(words.dictionary), dtype=np.int64)
    weight[term] = np.asarray(counts["total"])
    side = (np.asarray(counts["own"]) != x).astype(np.int64)
    i = np.asarray(counts["i"])
    source = np.where(side == 0, np.searchsorted(own[0], i), np.searchsorted(own[1], i))
    sums, terms = block_gaps(term, weight, side, source, np.asarray(counts["p"]), (zero[0], zero[1]), x == y)
    a, b = np.nonzero(terms)
    return pa.table({"lang": pa.array([groups["lang"][0].as_py()] * len(a), pa.string()), "i": own[0][a],
                     "j": own[1][b], "sum": sums[a, b], "terms": terms[a, b]})


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, tile: int = 64, block_terms: int = 1024) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from others and from its language.

    A term is a run of ASCII letters and non-ASCII characters, only A-Z lower-cased. The terms
    in at least ``min_docs`` documents of a language are kept; a group (lang, source) gives a
    term of count c the price p = 1 + floor(10^9 (c + 2) / (N + 2 V)), with N its occurrences
    of kept terms and V the language's number of them; the language itself does the same. The
    gap of two prices is floor((p - q)^2 / (p + q)).

    Part ``pair``: every other source of the language with the gaps of all kept terms added
    up. Part ``term``: the ``top`` kept terms the source has whose price is above the
    language's, with the gap. Ranks go by value, then by the item's bytes.

    Null text, lang and source count as ''. Every (lang, source) that occurs is a group, also
    without any term; a language of one source has no pairs. Each row counts as a document
    of its own, repeated ids included. Other columns are ignored; an empty table gives an
    empty result. ``tile`` sources and ``block_terms`` terms bound a group of a task.
    """
    docs = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
                         for c in ("lang", "source", "text")))
    counts = cut_lineage(term_counts(docs, min_docs), "term_counts")
    per_lang = counts.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("first").alias("v"))
    per_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = cut_lineage(
        docs.select("lang", "source").distinct()
        .join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_group", "n_lang", "v")),
                (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint").alias("i"))
        .withColumn("own", F.floor(F.col("i") / tile).cast("int"))
        .withColumn("p0", F.when(F.col("v") > 0, price(F.lit(0), "n_group", "v"))), "groups")
    priced = (counts.join(groups, ["lang", "source"])
              .select("lang", "source", "term", "total", "i", "own", price("n", "n_group", "v").alias("p"),
                      price("total", "n_lang", "v").alias("q")))

    tiles = groups.groupBy("lang").agg((F.max("own") + 1).alias("tiles"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    sides = [F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")]
    # blocks: terms of about equal frequency, in as many parts as block_terms asks for
    size_class = F.floor(F.log2("total") * 2).cast("int")
    parts = (counts.filter("first").groupBy("lang", size_class.alias("class"))
             .agg(F.ceil(F.count("*") / block_terms).alias("parts")))
    placed = (priced.withColumn("class", size_class).join(parts, ["lang", "class"]).join(tiles, "lang")
              .withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
              .select("lang", "class", "part", "term", "total", "i", "own", "p", other))
    placed = placed.select("lang", "class", "part", *sides, "term", "total", "i", "own", "p")
    known = groups.join(tiles, "lang").select("lang", F.col("i").alias("index"), F.col("own").alias("home"), "p0", other)
    sides = [F.least("home", "other").alias("x"), F.greatest("home", "other").alias("y")]
    known = (known.select("lang", *sides, "index", "home", "p0").join(parts, "lang")
             .select("lang", "class", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"),
                     "x", "y", "index", "home", "p0"))
    keys = ["lang", "class", "part", "x", "y"]
    sums = (placed.groupBy(*keys).cogroup(known.groupBy(*keys))
            .applyInArrow(_tile_gaps, "lang string, i bigint, j bigint, sum bigint, terms bigint")
            .groupBy("lang", "i", "j").agg(F.sum("sum").alias("sum"), F.sum("terms").alias("terms")))

    # terms that neither source of a pair has are left: all have the gap of the prices of 0
    mine = groups.select("lang", "i", "source", "v", F.col("p0").alias("p"))
    theirs = groups.select("lang", F.col("i").alias("j"), F.col("source").alias("item"), F.col("p0").alias("q"))
    pairs = mine.join(theirs, "lang").filter("i < j").join(sums, ["lang", "i", "j"], "left")
    gap = F.expr("coalesce(((p - q) * (p - q)) div (p + q), 0)")
    value = F.coalesce("sum", F.lit(0)) + (F.col("v") - F.coalesce("terms", F.lit(0))) * gap
    pairs = pairs.select("lang", "source", "item", value.alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                           F.row_number().over(order).alias("rank"))
    of_terms = (priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                              gap.alias("value"))
                .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return of_pairs.unionByName(of_terms)
