"""Text -> token ids -> pooled, normalised vectors.

Tokens are maximal runs of letters and digits of the lower-cased text (the
word-level stand-in for a subword tokenizer). The plan of ``encode``:

  texts --words--> (text_id, array of words)                 narrow
        --sum of the words' vectors in a kernel-->            narrow
        --sum per text_id, of ids that repeat-->              one shuffle
        --mean, L2 normalise-->                               narrow

The lexicon (vocabulary joined to the weights) has one row per vocabulary word.
It is counted, and held by the kernel as codes or in single precision where that
loses nothing. What exceeds the bound is dealt into parts (models, then slices of the
words), and the texts go past each part. Small texts, and lexicons of more than
``HELD_PARTS`` parts, go through a join of the exploded words instead: with a
broadcast where that is proven to fit, else shuffled with AQE skew splitting.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.joins import DEFAULT_BROADCAST_BYTES, bounded_rows, broadcast_if_bounded, skew_join
from . import kernels
from .tables import DENSE, PACKED, EmbeddingModel, remap_token_ids

WORD_PATTERN = r"[\p{L}\p{N}]+"


def words_expr(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(WORD_PATTERN), 0)


def build_vocab(texts: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """(token_id, word): words by count desc, word asc; the first ``size``.

    The count is a partial aggregation (hot words collapse before the shuffle);
    the top-``size`` is a distributed take-ordered; numbering runs over at most
    ``size`` rows, the model's own table size.
    """
    counts = (texts.select(F.explode(words_expr(text_col)).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))
    top = counts.orderBy(F.desc("cnt"), F.asc("word")).limit(size)
    w = Window.orderBy(F.desc("cnt"), F.asc("word"))
    return top.select((F.row_number().over(w) - 1).cast("bigint").alias("token_id"), "word")


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return (texts.select(F.explode(words_expr(text_col)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))


def token_weights(texts: DataFrame, vocab: DataFrame, a: float = 1e-3,
                  text_col: str = "text") -> DataFrame:
    """(row_id, weight) = a / (a + p(word)), p = word frequency in ``texts``."""
    c = word_counts(texts, text_col)
    total = float(c.agg(F.sum("cnt")).first()[0] or 1)
    return (vocab.join(c, "word")
            .select(F.col("token_id").alias("row_id"),
                    (F.lit(a) / (F.lit(a) + F.col("cnt") / F.lit(total))).alias("weight")))


def tokenize(texts: DataFrame, vocab: DataFrame, id_col: str = "text_id",
             text_col: str = "text") -> DataFrame:
    """(text_id, pos, token_id) for in-vocabulary words; pos counts all words."""
    words = texts.select(F.col(id_col).alias("text_id"), F.posexplode(words_expr(text_col)).alias("pos", "word"))
    return skew_join(words, vocab.select("word", "token_id"), "word").select("text_id", "pos", "token_id")


def token_counts(tokens: DataFrame) -> DataFrame:
    """(text_id, token_id, tf) and per-text length via the sum of tf."""
    return tokens.groupBy("text_id", "token_id").agg(F.count(F.lit(1)).alias("tf"))


def lexicon(model: EmbeddingModel, vocab: DataFrame) -> DataFrame:
    """(word, <weights columns>) for every vocabulary word the model covers."""
    toks = remap_token_ids(vocab.select("word", "token_id"), model.id_map)
    if model.token_to_row is None:
        toks = toks.withColumn("row_id", F.col("token_id"))
    else:
        toks = toks.join(model.token_to_row, "token_id")
    return toks.join(model.weights, "row_id").select("word", *model.weight_columns())


# Decode the lexicon before broadcasting it when the decoded table is this small;
# beyond it the compact (quantized / packed) rows are broadcast and each token
# is decoded after the join.
DECODED_LEXICON_BYTES = 64 * 1024 * 1024


# The lexicons that the pooling kernel may hold at once, and how often texts are read for others.
HELD_LEXICON_BYTES = 128 * 1024 * 1024
HELD_PARTS = 16
# Ids of texts (their hashes) that repeat and come to the driver; the vectors of more are all shuffled.
REPEATED_IDS = 4096
# Texts estimated smaller than this are joined: a plan without a job that reads the lexicon.
SMALL_TEXTS_BYTES = 4 * 1024 * 1024


class Sent(list):
    """Broadcasts of lexicons; ``sliced`` where the words of a model are in more than one."""

    sliced = False


def sent_lexicons(models: dict[str, EmbeddingModel], vocab: DataFrame,
                  lexicons: dict[str, DataFrame] | None = None, most: int | None = None,
                  last: bool = False) -> Sent | None:
    """Broadcasts for ``kernels.pool_words`` that hold every model's lexicon together, each of at most
    ``HELD_LEXICON_BYTES``: several models, or a slice of the words of one. They are read one by
    one. None where there are more than ``most`` (``HELD_PARTS``); ``last`` as in ``kernels.held_lexicon``."""
    most = HELD_PARTS if most is None else most
    spark, d = vocab.sparkSession, max(m.dim for m in models.values())
    parts: list[dict[str, tuple[int, int]]] = []        # the slice of each model, and of how many
    left = 0
    for name, m in models.items():
        row = 80 + (8 * d if m.levels() is None or m.dim < d else d)
        n = bounded_rows(lexicons[name] if lexicons else lexicon(m, vocab), min(most * HELD_LEXICON_BYTES // row, (1 << 31) - 2))
        if n is None:
            return None
        slices = -(-n * row // HELD_LEXICON_BYTES) or 1
        if slices > 1 or n * row > left or not parts:
            parts.extend({} for _ in range(slices))
            left = HELD_LEXICON_BYTES if slices == 1 else 0
        for i in range(slices):
            parts[len(parts) - slices + i][name] = i, slices
        left -= n * row
    if len(parts) > most:
        return None
    out = Sent()
    out.sliced = any(slices > 1 for part in parts for _, slices in part.values())
    for part in parts:
        held = {}
        for name, (i, slices) in part.items():
            lex = lexicons[name] if lexicons else lexicon(models[name], vocab)
            if slices > 1:
                lex = lex.where(F.pmod(F.xxhash64("word"), F.lit(slices)) == i)
            held[name] = held_compactly(lex, models[name], d, last)
        out.append(kernels.send_lexicons(spark, held))
    return out


def held_compactly(lex: DataFrame, m: EmbeddingModel, d: int, last: bool = False) -> tuple:
    """``kernels.compact_lexicon`` of a model's lexicon; decoded where that has none, ``last`` as in
    ``kernels.held_lexicon``."""
    levels, held = m.levels(), None
    if m.dim == d and (levels is not None or m.kind == DENSE):
        columns = ["embedding"] if m.kind == DENSE else m.weight_columns()
        table = lex if m.kind != DENSE else m.decoded(lex, ["word"])
        held = kernels.compact_lexicon(table.select("word", *columns).toArrow(), d, levels,
                                       m.bits if m.kind == PACKED else None)
    if held is None:
        rows = m.decoded(lex, ["word"]).select("word", F.col("embedding").cast("array<double>"))
        held = kernels.held_lexicon(rows.toArrow(), d, last)
    return held


def pooled(texts: DataFrame, held: Sent, d: int, id_col: str = "text_id", text_col: str = "text",
           key: tuple[str, ...] = ("text_id",), repeats: bool = False) -> DataFrame:
    """(*key, embedding) from the pooling kernel; the key is text_id, or model and text_id.

    Sums of texts whose id occurs once leave their task as vectors; the others' are shuffled.
    With ``repeats`` the ids are not looked up first, and all are.
    """
    of = F.xxhash64(id_col)
    found = None
    if not (repeats or held.sliced):
        found = [r[0] for r in texts.groupBy(of.alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                 .select("h").limit(REPEATED_IDS + 1).collect()]

    def sums(rows: DataFrame) -> DataFrame:
        words = spread(rows).select(F.col(id_col).alias("text_id"), words_expr(text_col).alias("words"))
        return reduce(DataFrame.unionByName, [kernels.pool_words(words, part, d) for part in held])

    def added(rows: DataFrame) -> DataFrame:
        return mean_pool_df(sums(rows).select(F.struct(*key).alias("key"), "embedding", "n"), d, "key",
                            n=F.sum("n")).select("key.*", "embedding")

    if found is None or len(found) > REPEATED_IDS:
        return added(texts)
    once = sums(texts.where(~of.isin(found)) if found else texts).select(*key, mean_pool_expr("embedding", "n"))
    return once.unionByName(added(texts.where(of.isin(found)))) if found else once


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, without a job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def mean_pool_df(joined: DataFrame, d: int, key: str = "text_id",
                 vec: str = "embedding", n: Column | None = None) -> DataFrame:
    """Sum the token vectors per ``key``, divide by the number of tokens that
    have a vector (at least 1), L2-normalise. Null vectors (placeholder rows of
    texts without known words) count as absent, giving a zero vector. ``n`` counts
    the tokens where a row is more than one."""
    summed = V.sum_vectors(joined, key, vec, d, extra=[(F.count(vec) if n is None else n).alias("_n")])
    return summed.select(key, mean_pool_expr(vec, "_n"))


def mean_pool_expr(vec: str, count: str) -> Column:
    n = F.greatest(F.col(count), F.lit(1)).cast("double")
    mean = F.transform(vec, lambda x: F.coalesce(x / n, F.lit(0.0)))
    return V.l2_normalise_expr(mean).alias("embedding")


def spread(texts: DataFrame) -> DataFrame:
    """Round-robin small inputs over the cluster (a file with a single row group would be
    tokenized by one task alone). Decided from the optimizer's size estimate of the input,
    without a job: inputs of more than a scan split per core are left as they are."""
    spark = texts.sparkSession
    par = spark.sparkContext.defaultParallelism
    split = int(re.match(r"\d+", spark.conf.get("spark.sql.files.maxPartitionBytes"))[0])
    return texts.repartition(2 * par) if estimated_bytes(texts) < par * split else texts


def encode(texts: DataFrame, model: EmbeddingModel, vocab: DataFrame,
           id_col: str = "text_id", text_col: str = "text",
           lex: DataFrame | None = None, vocab_rows: int | None = None,
           held: Sent | None = None, repeats: bool = False) -> DataFrame:
    """(text_id, embedding) for every input text (no known word -> zero vector).

    ``vocab_rows`` is a proven bound on the vocabulary (``build_vocab(size=N)``
    never returns more than N words); with it the lexicon's size is known and no
    counting job is needed to decide the broadcast. ``held`` is the model's lexicon
    (``sent_lexicons``) for texts that many plans encode. ``repeats`` as in ``pooled``.
    """
    lx = lex if lex is not None else lexicon(model, vocab)
    if held is None and estimated_bytes(texts) >= SMALL_TEXTS_BYTES:
        held = sent_lexicons({"": model}, vocab, {"": lx})
    if held is not None:
        return pooled(texts, held, model.dim, id_col, text_col, repeats=repeats)
    texts = spread(texts)
    decoded_row = 64 + 8 * model.dim
    dec = model.decoded(lx, ["word"])
    if vocab_rows is not None:
        small = vocab_rows * decoded_row <= DECODED_LEXICON_BYTES
        dec_lx = F.broadcast(dec) if small else dec
    else:
        dec_lx, small = broadcast_if_bounded(dec, decoded_row, DECODED_LEXICON_BYTES)
    if small:
        lx_b, decode_after = dec_lx, False
    elif vocab_rows is not None and vocab_rows * (model.row_bytes() + 48) <= DEFAULT_BROADCAST_BYTES:
        lx_b, decode_after = F.broadcast(lx), True
    else:
        lx_b, _ = broadcast_if_bounded(lx, model.row_bytes() + 48)
        decode_after = True
    words = texts.select(F.col(id_col).alias("text_id"),
                         F.posexplode_outer(words_expr(text_col)).alias("pos", "word"))
    joined = words.join(lx_b, "word", "left")
    hit = F.col(lx_b.columns[1]).isNotNull()
    joined = joined.where(hit | F.col("pos").isNull() | (F.col("pos") == 0))
    if decode_after:
        joined = joined.select("text_id", F.when(hit, model.decode_expr()).alias("embedding"))
    return mean_pool_df(joined.select("text_id", "embedding"), model.dim)


def encode_models(texts: DataFrame, models: dict[str, EmbeddingModel], vocab: DataFrame,
                  id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(model, text_id, embedding) of every text under every model, words made once.

    The lexicons of the models are one table with a model column; narrower models are
    filled up with zeros, which changes no cosine. A text without a known word gets a zero
    vector of each model.
    """
    d = max(m.dim for m in models.values())
    held = sent_lexicons(models, vocab) if estimated_bytes(texts) >= SMALL_TEXTS_BYTES else None
    if held is not None:
        return pooled(texts, held, d, id_col, text_col, ("model", "text_id"))
    lex, size = None, 0
    for name, m in models.items():
        wide = F.concat("embedding", F.array_repeat(F.lit(0.0), d - m.dim)) if m.dim < d else F.col("embedding")
        part = m.decoded(lexicon(m, vocab), ["word"]).select("word", F.lit(name).alias("model"), wide.alias("embedding"))
        lex = part if lex is None else lex.unionByName(part)
        size += m.tokens * (64 + 8 * d)
        lex = lex.unionByName(vocab.sparkSession.createDataFrame([("", name, None)], lex.schema))
    if size <= DECODED_LEXICON_BYTES:           # tokens bound the rows of each model's lexicon
        lex = F.broadcast(lex)
    # every text begins with an empty word, which each model has without a vector
    each = spread(texts).select(F.col(id_col).alias("text_id"), F.explode(F.concat(
        F.array(F.lit("")), F.coalesce(words_expr(text_col), F.array().cast("array<string>")))).alias("word"))
    keyed = each.join(lex, "word").select(F.struct("model", "text_id").alias("key"), "embedding")
    return mean_pool_df(keyed, d, key="key").select("key.*", "embedding")
