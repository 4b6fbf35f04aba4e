"""Registered queries: one Spark builder per operator key, each paired (where
SQL can express it) with an independent DuckDB statement over the same tables.

Every builder reads the driver's tables from ``sf_dir`` and runs over whole
tables. Vector outputs use the long comparison form (id, dim, value).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import vectors as V
from ..functions.levels import uniform_qmax
from ..operators import kernels
from ..operators import quantize as Q
from ..operators import rank as R
from ..operators import relevance as M
from ..operators import tables as TB
from ..operators import text as X
from ..sources import testdata as T
from . import evaluation as E
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str | Callable[[], str]] = {}


def register(key: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


def oracle_sql() -> dict[str, str]:
    return {k: (v() if callable(v) else v) for k, v in SQL.items()}


# --------------------------------------------------------------------------
# shared context
# --------------------------------------------------------------------------

def base(spark: SparkSession, sf: str) -> TB.EmbeddingModel:
    return T.base_model(spark, sf)


def recipe(spark: SparkSession, sf: str, name: str, m: TB.EmbeddingModel | None = None):
    m = m or base(spark, sf)
    if name == "baseline":
        return m
    if name.startswith("turbo-lloyd-"):
        return Q.quantize(m, int(name.rsplit("-", 1)[1]), "turbo-lloyd")
    if name.startswith("int"):
        return Q.quantize(m, int(name[3:]), "uniform")
    raise ValueError(name)


def model_artifact(spark: SparkSession, sf: str, name: str) -> TB.EmbeddingModel:
    """A compressed model as its consumers see it: built once, written to the
    shared checkpoint folder, read back (encode / rank / evaluate read it)."""
    from ..session import materialize
    m = recipe(spark, sf, name)
    return m.derive(weights=materialize(lambda: m.weights, ("model", sf, name), spark, "model",
                                          T.paths(sf, "embeddings")))


def vocab(spark: SparkSession, sf: str, m: TB.EmbeddingModel) -> DataFrame:
    """The vocabulary of ``documents`` sized to the model (written once, reused)."""
    from ..session import materialize
    return materialize(lambda: X.build_vocab(T.texts(spark, sf), m.num_rows),
                       ("vocab", sf, m.num_rows), spark, "vocab", T.paths(sf, "documents"))


def codes_long(w: DataFrame, with_scale: bool = True) -> DataFrame:
    cols = ["row_id", F.posexplode("codes").alias("dim", "_c")]
    if with_scale:
        cols.append("scale")
    out = w.select(*cols).select("row_id", F.col("dim").cast("int").alias("dim"),
                                 F.col("_c").cast("int").alias("code"),
                                 *([F.round("scale", 6).alias("scale")] if with_scale else []))
    return out


def decoded_long(m: TB.EmbeddingModel) -> DataFrame:
    return V.long_form(TB.decode(m), "row_id", "embedding")


def _vec_sql(final_src: str, id_col: str = "row_id", val: str = "x") -> str:
    return f"SELECT {id_col} AS row_id, dim, round({val}, 6) AS value FROM {final_src}"


# --------------------------------------------------------------------------
# 2.1 / 2.2 tables and projections
# --------------------------------------------------------------------------

def _sql_read_embeddings():
    s = O.Sql()
    return s.build(_vec_sql(s.dense()))


@register("read_embeddings", _sql_read_embeddings)
def q_read_embeddings(spark, sf):
    return V.long_form(base(spark, sf).weights, "row_id", "embedding")


def _sql_l2():
    s = O.Sql()
    n = s.normalised(s.dense(), "nz")
    return s.build(f"SELECT text_id AS row_id, dim, round(v, 6) AS value FROM {n}")


@register("l2_normalise", _sql_l2)
def q_l2_normalise(spark, sf):
    m = base(spark, sf)
    return V.long_form(TB.l2_normalise(m.weights, m.dim), "row_id", "embedding")


def _sql_row_norms():
    s = O.Sql()
    return s.build(f"SELECT row_id, round(greatest(sqrt(sum(x * x)), 1e-8), 6) AS norm "
                   f"FROM {s.dense()} GROUP BY row_id")


@register("row_norms", _sql_row_norms)
def q_row_norms(spark, sf):
    m = base(spark, sf)
    return TB.row_norms(m.weights, m.dim).select("row_id", F.round("norm", 6).alias("norm"))


def _sql_fold():
    s = O.Sql()
    s.vocab()
    s.add("tw", "SELECT v.token_id AS row_id, 0.001 / (0.001 + c.cnt / (SELECT sum(cnt) FROM word_counts)::DOUBLE) "
                "AS weight FROM vocab v JOIN word_counts c USING (word)")
    return s.build(f"SELECT d.row_id, d.dim, round(d.x * coalesce(w.weight, 1.0), 6) AS value "
                   f"FROM {s.dense()} d LEFT JOIN tw w USING (row_id)")


@register("fold_token_weights", _sql_fold)
def q_fold_token_weights(spark, sf):
    m = base(spark, sf)
    tw = X.token_weights(T.texts(spark, sf), vocab(spark, sf, m))
    return V.long_form(TB.fold_token_weights(m.weights, tw, m.dim), "row_id", "embedding")


# --------------------------------------------------------------------------
# 2.3 quantization
# --------------------------------------------------------------------------

def _sql_rot():
    s = O.Sql()
    return s.build(_vec_sql(s.hadamard()))


@register("rotate_hadamard", _sql_rot)
def q_rotate_hadamard(spark, sf):
    m = base(spark, sf)
    return V.long_form(Q.rotate_hadamard(m.weights, m.dim), "row_id", "embedding")


def _sql_uniform(bits):
    def f():
        s = O.Sql()
        c = s.uniform_codes(bits, s.dense(), f"u{bits}")
        return s.build(f"SELECT row_id, dim, code, round(scale, 6) AS scale FROM {c}")
    return f


@register("quantize_uniform", _sql_uniform(4))
def q_quantize_uniform(spark, sf):
    return codes_long(recipe(spark, sf, "int4").weights)


@register("int8", _sql_uniform(8))
def q_int8(spark, sf):
    return codes_long(recipe(spark, sf, "int8").weights)


@register("int2", _sql_uniform(2))
def q_int2(spark, sf):
    return codes_long(recipe(spark, sf, "int2").weights)


def _sql_turbo(bits):
    def f():
        s = O.Sql()
        c = s.codebook_codes(bits, s.hadamard(), f"tl{bits}")
        return s.build(f"SELECT row_id, dim, code, round(scale, 6) AS scale FROM {c}")
    return f


def _turbo_query(bits):
    def q(spark, sf):
        return codes_long(recipe(spark, sf, f"turbo-lloyd-{bits}").weights)
    return q


for _b in (1, 2, 3, 4):
    register(f"turbo_lloyd_{_b}", _sql_turbo(_b))(_turbo_query(_b))


def _sql_qcb():
    # codebook quantization without rotation (the operator on its own)
    s = O.Sql()
    c = s.codebook_codes(3, s.dense(), "cb3")
    return s.build(f"SELECT row_id, dim, code, round(scale, 6) AS scale FROM {c}")


@register("quantize_codebook", _sql_qcb)
def q_quantize_codebook(spark, sf):
    return codes_long(Q.quantize_codebook(base(spark, sf), 3).weights)


def _sql_decode(recipe_name):
    def f():
        s = O.Sql()
        return s.build(_vec_sql(s.model(recipe_name)))
    return f


@register("decode_uniform", _sql_decode("int8"))
def q_decode_uniform(spark, sf):
    return decoded_long(recipe(spark, sf, "int8"))


@register("decode_codebook", _sql_decode("turbo-lloyd-2"))
def q_decode_codebook(spark, sf):
    return decoded_long(recipe(spark, sf, "turbo-lloyd-2"))


ERROR_RECIPES = ("int8", "int4", "int2", "turbo-lloyd-1", "turbo-lloyd-2", "turbo-lloyd-3",
                 "turbo-lloyd-4")


def _sql_qerr():
    s = O.Sql()
    parts = []
    for r in ERROR_RECIPES:
        dec = s.model(r)
        ref = s.hadamard() if r.startswith("turbo") else s.dense()
        parts.append(f"SELECT '{r}' AS name, round(avg((a.x - b.x) * (a.x - b.x)), 12) AS mse, "
                     f"count(DISTINCT a.row_id)::BIGINT AS rows FROM {ref} a JOIN {dec} b USING (row_id, dim)")
    return s.build(" UNION ALL ".join(parts))


@register("quantization_error", _sql_qerr)
def q_quantization_error(spark, sf):
    m = base(spark, sf)
    rot = Q.rotate_hadamard(m.weights, m.dim)
    outs = []
    for r in ERROR_RECIPES:
        mr = recipe(spark, sf, r, m)
        ref = rot if r.startswith("turbo") else m.weights
        outs.append(Q.quantization_error(ref, mr).select(
            F.lit(r).alias("name"), F.round("mse", 12).alias("mse"), F.col("rows").cast("bigint")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


SIZE_RECIPES = ("baseline", "int8", "int4", "int2", "turbo-lloyd-1", "turbo-lloyd-2",
                "turbo-lloyd-3", "turbo-lloyd-4")


def _size_spark(m: TB.EmbeddingModel) -> DataFrame:
    """(name, num_rows, size_bytes, size_mb) aggregated from the weights table."""
    if m.kind == TB.DENSE:
        agg = m.weights.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("e"))
        size = F.col("e") * 4
    else:
        agg = m.weights.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("codes")).alias("e"))
        size = F.floor((F.col("e") * m.bits + 7) / 8) + 4 * F.col("n")
    return agg.select(F.lit(m.name.split("_", 1)[1] if "_" in m.name else "baseline").alias("name"),
                      F.col("n").cast("bigint").alias("num_rows"),
                      size.cast("bigint").alias("size_bytes"),
                      F.round(size / 1e6, 6).alias("size_mb"))


def _bits_of(r: str) -> int | None:
    if r.startswith("turbo-lloyd-"):
        return int(r.rsplit("-", 1)[1])
    if r.startswith("int"):
        return int(r[3:])
    return None


def _size_sql_expr(r: str) -> str:
    b = _bits_of(r)
    if b is None:
        return "e * 4"
    return f"(e * {b} + 7) // 8 + 4 * n"


def _sql_model_size():
    parts = []
    for r in SIZE_RECIPES:
        parts.append(f"SELECT '{r}' AS name, n::BIGINT AS num_rows, ({_size_sql_expr(r)})::BIGINT AS size_bytes, "
                     f"round(({_size_sql_expr(r)}) / 1e6, 6) AS size_mb FROM "
                     f"(SELECT count(*) AS n, sum(len(embedding)) AS e FROM embeddings)")
    return " UNION ALL ".join(parts)


@register("model_size", _sql_model_size)
def q_model_size(spark, sf):
    m = base(spark, sf)
    outs = [_size_spark(recipe(spark, sf, r, m)) for r in SIZE_RECIPES]
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def _sql_ratio():
    return ("SELECT name, round(first_value(size_bytes) OVER (ORDER BY name = 'baseline' DESC) "
            "/ size_bytes::DOUBLE, 6) AS ratio FROM (" + _sql_model_size() + ")")


@register("compression_ratio", _sql_ratio)
def q_compression_ratio(spark, sf):
    return _ratio(q_model_size(spark, sf))


def _ratio(sizes: DataFrame) -> DataFrame:
    dense_bytes = sizes.where(F.col("name") == "baseline").select("size_bytes").first()[0]
    return sizes.select("name", F.round(F.lit(float(dense_bytes)) / F.col("size_bytes"), 6).alias("ratio"))


# --------------------------------------------------------------------------
# packing
# --------------------------------------------------------------------------

PACK_RECIPES = ("turbo-lloyd-1", "turbo-lloyd-2", "turbo-lloyd-4", "turbo-lloyd-3")


def _sql_pack_for(s: O.Sql, r: str, codes_src: str, shift: int = 0) -> str:
    b = _bits_of(r)
    per = B.codes_per_byte(b)
    sh = (f"({8} - {b} * (dim % {per} + 1))" if b in B.PACKED_WIDTHS else "0")
    name = "pk_" + r.replace("-", "_")
    s.add(name + "_bytes", f"SELECT row_id, dim // {per} AS byte, sum((code + {shift}) << {sh}) AS v "
                           f"FROM {codes_src} GROUP BY row_id, dim // {per}")
    return s.add(name, f"SELECT row_id, string_agg(printf('%02X', v), '' ORDER BY byte) AS packed_hex "
                       f"FROM {name}_bytes GROUP BY row_id")


def _sql_pack():
    s = O.Sql()
    parts = []
    for r in PACK_RECIPES:
        b = _bits_of(r)
        c = s.codebook_codes(b, s.hadamard(), f"tl{b}")
        p = _sql_pack_for(s, r, c)
        parts.append(f"SELECT '{r}' AS name, row_id, packed_hex FROM {p}")
    return s.build(" UNION ALL ".join(parts))


def _packed(m: TB.EmbeddingModel, shift: int = 0) -> DataFrame:
    codes = F.transform("codes", lambda c: c.cast("int") + shift) if shift else F.col("codes")
    return m.weights.select("row_id", B.pack(codes, m.dim, m.bits).alias("packed"), "scale")


@register("pack_codes", _sql_pack)
def q_pack_codes(spark, sf):
    m = base(spark, sf)
    outs = []
    for r in PACK_RECIPES:
        mr = recipe(spark, sf, r, m)
        outs.append(_packed(mr).select(F.lit(r).alias("name"), "row_id",
                                       F.hex("packed").alias("packed_hex")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def _sql_unpack():
    s = O.Sql()
    parts = []
    for r in PACK_RECIPES:
        b = _bits_of(r)
        c = s.codebook_codes(b, s.hadamard(), f"tl{b}")
        parts.append(f"SELECT '{r}' AS name, row_id, dim, code FROM {c}")
    return s.build(" UNION ALL ".join(parts))


@register("unpack_codes", _sql_unpack)
def q_unpack_codes(spark, sf):
    m = base(spark, sf)
    outs = []
    for r in PACK_RECIPES:
        mr = recipe(spark, sf, r, m)
        p = _packed(mr)
        u = kernels.unpack_rows(p, mr.dim, mr.bits)
        outs.append(codes_long(u, with_scale=False).select(F.lit(r).alias("name"), "row_id", "dim", "code"))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def _sql_export():
    s = O.Sql()
    c = s.uniform_codes(4, s.dense(), "u4")
    p = _sql_pack_for(s, "int4", c, shift=uniform_qmax(4) + 1)
    return s.build(f"SELECT p.row_id, p.packed_hex, round(n.scale, 6) AS scale FROM {p} p "
                   f"JOIN u4_scale n USING (row_id)")


@register("export_packed", _sql_export)
def q_export_packed(spark, sf):
    from ..sources.models import export_packed
    m = recipe(spark, sf, "int4")
    packed, meta = export_packed(m)
    return packed.select("row_id", F.hex("packed").alias("packed_hex"), F.round("scale", 6).alias("scale"))


@register("decode_packed", _sql_decode("int4"))
def q_decode_packed(spark, sf):
    from ..sources.models import decode_packed, export_packed
    packed, meta = export_packed(recipe(spark, sf, "int4"))
    return V.long_form(decode_packed(packed, meta), "row_id", "embedding")


# --------------------------------------------------------------------------
# 2.5 text encoding
# --------------------------------------------------------------------------

def _sql_vocab():
    s = O.Sql()
    return s.build(f"SELECT token_id, word FROM {s.vocab()}")


@register("build_vocab", _sql_vocab)
def q_build_vocab(spark, sf):
    return vocab(spark, sf, base(spark, sf))


def _sql_tokenize():
    s = O.Sql()
    t = s.tokens(O.DOCS, "tok")
    return s.build(f"SELECT text_id, pos, token_id FROM {t}")


@register("tokenize", _sql_tokenize)
def q_tokenize(spark, sf):
    m = base(spark, sf)
    return X.tokenize(T.texts(spark, sf), vocab(spark, sf, m)) \
        .select(F.col("text_id").cast("bigint"), F.col("pos").cast("int"), "token_id")


def _sql_token_counts():
    s = O.Sql()
    t = s.tokens(O.DOCS, "tok")
    return s.build(f"SELECT text_id, token_id, count(*)::BIGINT AS tf FROM {t} GROUP BY text_id, token_id")


@register("token_counts", _sql_token_counts)
def q_token_counts(spark, sf):
    m = base(spark, sf)
    return X.token_counts(X.tokenize(T.texts(spark, sf), vocab(spark, sf, m))) \
        .select(F.col("text_id").cast("bigint"), "token_id", F.col("tf").cast("bigint"))


def _sql_encode(recipe_name, texts_sql):
    def f():
        s = O.Sql()
        e = s.encode(texts_sql, s.model(recipe_name), "enc")
        return s.build(f"SELECT text_id, dim, round(v, 6) AS value FROM {e}")
    return f


def _encode_query(recipe_name, which):
    def q(spark, sf):
        m = model_artifact(spark, sf, recipe_name)
        v = vocab(spark, sf, m)
        texts = T.texts(spark, sf) if which == "docs" else \
            T.topics_a(spark, sf).withColumnRenamed("qid", "text_id")
        return V.long_form(X.encode(texts, m, v, vocab_rows=m.tokens), "text_id", "embedding")
    return q


register("encode", _sql_encode("turbo-lloyd-1", O.DOCS))(_encode_query("turbo-lloyd-1", "docs"))
register("mean_pool", _sql_encode("baseline", O.TOPICS_A))(_encode_query("baseline", "topics"))
@register("encode_packed", _sql_encode("int4", O.DOCS))
def q_encode_packed(spark, sf):
    from ..sources.models import export_packed, packed_model
    packed, meta = export_packed(recipe(spark, sf, "int4"))
    m = packed_model(packed, meta)
    v = vocab(spark, sf, m)
    return V.long_form(X.encode(T.texts(spark, sf), m, v), "text_id", "embedding")


# --------------------------------------------------------------------------
# 2.6 ranking
# --------------------------------------------------------------------------

def _model_and_vocab(spark, sf, r="turbo-lloyd-1"):
    m = model_artifact(spark, sf, r)
    return m, vocab(spark, sf, m)


def _sql_topk_pooled():
    s = O.Sql()
    w = s.model("turbo-lloyd-1")
    s.add("jq", f"SELECT text_id, text FROM ({O.TOPICS_A}) WHERE text_id IN (SELECT qid FROM ({O.QRELS_A}))")
    s.add("pool", f"SELECT text_id, text FROM ({O.DOCS}) WHERE text_id IN (SELECT docid FROM ({O.QRELS_A}))")
    q = s.encode("SELECT * FROM jq", w, "qe")
    p = s.encode("SELECT * FROM pool", w, "pe")
    r = s.ranked(s.scores(q, p, "sc"), 10, "rk")
    return s.build(f"SELECT qid, docid, rank, round(score, 6) AS score FROM {r}")


def _ranked_out(r: DataFrame) -> DataFrame:
    return r.select(F.col("qid").cast("bigint"), F.col("docid").cast("bigint"),
                    F.col("rank").cast("int"), F.round("score", 6).alias("score"))


@register("topk_pooled", _sql_topk_pooled)
def q_topk_pooled(spark, sf):
    m, v = _model_and_vocab(spark, sf)
    j = T.judgments_a(spark, sf)
    jq = M.judged_queries(T.topics_a(spark, sf), j)
    pool = M.pool(T.passages(spark, sf), j)
    q, p = E.encode_pair(m, v, jq, pool)
    return _ranked_out(R.topk(q, p, 10, m.dim, sizes=jq))


def _sql_topk_full():
    s = O.Sql()
    w = s.model("turbo-lloyd-1")
    q = s.encode(O.TOPICS_B, w, "qe")
    p = s.encode(O.PASSAGES_B, w, "pe")
    r = s.ranked(s.scores(q, p, "sc"), 100, "rk")
    return s.build(f"SELECT qid, docid, rank, round(score, 6) AS score FROM {r}")


@register("topk_full", _sql_topk_full)
def q_topk_full(spark, sf):
    m, v = _model_and_vocab(spark, sf)
    topics = T.topics_b(spark, sf)
    q, p = E.encode_pair(m, v, topics, T.passages_b(spark, sf))
    return _ranked_out(R.topk(q, p, 100, m.dim, sizes=topics))


VEC_Q = "SELECT vec_id::BIGINT AS row_id, dim, x FROM (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE vec_id % 10 = 0"
VEC_R = VEC_Q.replace("vec_id % 10 = 0", "vec_id % 10 <> 0")


def _sql_nearest():
    s = O.Sql()
    s.add("vq", VEC_Q)
    s.add("vr", VEC_R)
    q = s.normalised("vq", "vqn")
    p = s.normalised("vr", "vrn")
    r = s.ranked(s.scores(q, p, "sc"), 10, "rk")
    return s.build(f"SELECT qid, docid, rank, round(score, 6) AS score FROM {r}")


def _vec_sets(spark, sf):
    m = base(spark, sf)
    q = TB.l2_normalise(T.vector_queries(spark, sf).select("qid", "embedding"), m.dim)
    r = TB.l2_normalise(T.vector_rows(spark, sf).select("docid", "embedding"), m.dim)
    return m, q, r


@register("nearest_rows", _sql_nearest)
def q_nearest_rows(spark, sf):
    m, q, r = _vec_sets(spark, sf)
    return _ranked_out(R.topk(q, r, 10, m.dim))


def _sql_simmat():
    s = O.Sql()
    s.add("vq", VEC_Q)
    s.add("vr", VEC_R)
    sc = s.scores(s.normalised("vq", "vqn"), s.normalised("vr", "vrn"), "sc")
    return s.build(f"SELECT qid, docid, round(score, 6) AS score FROM {sc}")


@register("similarity_matrix", _sql_simmat)
def q_similarity_matrix(spark, sf):
    m = base(spark, sf)
    a = m.weights.where(F.col("row_id") % T.VECTOR_QUERY_MOD == 0).withColumnRenamed("row_id", "qid")
    b = m.weights.where(F.col("row_id") % T.VECTOR_QUERY_MOD != 0).withColumnRenamed("row_id", "docid")
    return R.similarity_matrix(a, b, m.dim).select("qid", "docid", F.round("score", 6).alias("score"))


def _sql_simpair():
    s = O.Sql()
    n = s.normalised(s.dense(), "dn")
    return s.build(
        f"SELECT a.text_id // 2 AS pair_id, round(sum(a.v * b.v), 6) AS cosine FROM {n} a JOIN {n} b "
        f"ON b.text_id = a.text_id + 1 AND a.dim = b.dim WHERE a.text_id % 2 = 0 GROUP BY a.text_id")


@register("similarity_pairwise", _sql_simpair)
def q_similarity_pairwise(spark, sf):
    m = base(spark, sf)
    return R.similarity_pairwise(T.pairs(spark, sf), m.weights, m.dim) \
        .select(F.col("pair_id").cast("bigint"), F.round("cosine", 6).alias("cosine"))


# --------------------------------------------------------------------------
# 2.7 relevance and metrics
# --------------------------------------------------------------------------

@register("judged_queries", f"SELECT DISTINCT qid FROM ({O.QRELS_A})")
def q_judged_queries(spark, sf):
    return M.judged_queries(T.topics_a(spark, sf), T.judgments_a(spark, sf)).select(
        F.col("qid").cast("bigint"))


@register("num_relevant", "SELECT qid, num_relevant FROM (" + O.JUDGED_B + ")")
def q_num_relevant(spark, sf):
    return M.num_relevant(T.judgments_b(spark, sf)).select(
        F.col("qid").cast("bigint"), F.col("num_relevant").cast("bigint"))


def _full_a_sql(s: O.Sql, k: int = 100) -> str:
    w = s.model("turbo-lloyd-1")
    s.add("jq", f"SELECT text_id, text FROM ({O.TOPICS_A}) WHERE text_id IN (SELECT qid FROM ({O.QRELS_A}))")
    q = s.encode("SELECT * FROM jq", w, "qe")
    p = s.encode(O.DOCS, w, "pe")
    return s.ranked(s.scores(q, p, "sc"), k, "rk")


def _full_a_spark(spark, sf, k: int = 100):
    m, v = _model_and_vocab(spark, sf)
    j = T.judgments_a(spark, sf)
    jq = M.judged_queries(T.topics_a(spark, sf), j)
    q, p = E.encode_pair(m, v, jq, T.passages(spark, sf))
    return R.topk(q, p, k, m.dim, sizes=jq), j


def _sql_ranked_rels():
    s = O.Sql()
    r = _full_a_sql(s)
    return s.build(f"SELECT r.qid, r.docid, r.rank, coalesce(l.rel, 0) AS rel FROM {r} r "
                   f"LEFT JOIN ({O.QRELS_A}) l ON l.qid = r.qid AND l.docid = r.docid")


@register("ranked_rels", _sql_ranked_rels)
def q_ranked_rels(spark, sf):
    r, j = _full_a_spark(spark, sf)
    return M.ranked_rels(r, j).select(F.col("qid").cast("bigint"), F.col("docid").cast("bigint"),
                                      F.col("rank").cast("int"), F.col("rel").cast("int"))


def _sql_dcg():
    s = O.Sql()
    r = _full_a_sql(s)
    return s.build(f"SELECT r.qid, round(coalesce(sum(CASE WHEN r.rank <= 10 THEN coalesce(l.rel, 0) / log2(r.rank + 1) END), 0.0), 6) AS dcg_10 "
                   f"FROM {r} r LEFT JOIN ({O.QRELS_A}) l ON l.qid = r.qid AND l.docid = r.docid GROUP BY r.qid")


@register("dcg_at_k", _sql_dcg)
def q_dcg_at_k(spark, sf):
    r, j = _full_a_spark(spark, sf)
    return M.dcg_at_k(M.ranked_rels(r, j), 10).select(F.col("qid").cast("bigint"), "dcg_10")


def _sql_per_query(cols):
    def f():
        s = O.Sql()
        r = _full_a_sql(s)
        pq = s.metrics(r, O.QRELS_A, O.JUDGED_A, (10,), (100,), "pq")
        return s.build(f"SELECT qid, {', '.join(f'round({c}, 6) AS {c}' for c in cols)} FROM {pq}")
    return f


def _per_query_spark(cols):
    def q(spark, sf):
        r, j = _full_a_spark(spark, sf)
        sc = M.query_scores(T.topics_a(spark, sf), r, j, (10,), (100,))
        return sc.select(F.col("qid").cast("bigint"), *[F.round(c, 6).alias(c) for c in cols])
    return q


register("ndcg_at_k", _sql_per_query(["ndcg_10"]))(_per_query_spark(["ndcg_10"]))
register("recall_at_k", _sql_per_query(["recall_100"]))(_per_query_spark(["recall_100"]))


def _sql_eval_pooled():
    s = O.Sql()
    w = s.model("turbo-lloyd-1")
    s.add("jq", f"SELECT text_id, text FROM ({O.TOPICS_A}) WHERE text_id IN (SELECT qid FROM ({O.QRELS_A}))")
    s.add("pool", f"SELECT text_id, text FROM ({O.DOCS}) WHERE text_id IN (SELECT docid FROM ({O.QRELS_A}))")
    q = s.encode("SELECT * FROM jq", w, "qe")
    p = s.encode("SELECT * FROM pool", w, "pe")
    r = s.ranked(s.scores(q, p, "sc"), 10, "rk")
    pq = s.metrics(r, O.QRELS_A, O.JUDGED_A, (10,), (10, 3), "pq")
    return s.build(s.summary(pq, (10,), (10, 3)))


@register("eval_pooled", _sql_eval_pooled)
def q_eval_pooled(spark, sf):
    m, v = _model_and_vocab(spark, sf)
    return E.eval_pooled(m, v, T.topics_a(spark, sf), T.passages(spark, sf), T.judgments_a(spark, sf))


def _sql_eval_pooled_lang():
    s = O.Sql()
    w = s.model("turbo-lloyd-1")
    s.add("jb", O.JUDGED_B)
    s.add("jq", f"SELECT text_id, text FROM ({O.TOPICS_B}) WHERE text_id IN (SELECT qid FROM jb)")
    s.add("pool", "SELECT doc_id::BIGINT AS text_id, text FROM documents p WHERE doc_id % 7 <> 0 AND EXISTS "
                  "(SELECT 1 FROM documents q WHERE q.doc_id % 7 = 0 AND q.lang = p.lang AND q.source = p.source)")
    q = s.encode("SELECT * FROM jq", w, "qe")
    p = s.encode("SELECT * FROM pool", w, "pe")
    r = s.ranked(s.scores(q, p, "sc", same_lang=True), 10, "rk")
    pq = s.metrics(r, O.LABELS_B, "SELECT * FROM jb", (10,), (10, 3), "pq", group="lang")
    return s.build(s.every_lang(s.summary(pq, (10,), (10, 3), group="lang"), ["ndcg_10", "recall_10", "recall_3"]))


@register("eval_pooled_lang", _sql_eval_pooled_lang)
def q_eval_pooled_lang(spark, sf):
    m, v = _model_and_vocab(spark, sf)
    return E.eval_pooled(m, v, T.topics_b(spark, sf), T.passages_b(spark, sf),
                         T.judgments_b(spark, sf), group_cols=("lang",))


def _sql_eval_full():
    s = O.Sql()
    r = _full_a_sql(s)
    pq = s.metrics(r, O.QRELS_A, O.JUDGED_A, (10,), (100,), "pq")
    return s.build(f"SELECT *, (SELECT count(*) FROM documents)::BIGINT AS total_passages FROM ("
                   + s.summary(pq, (10,), (100,)) + ")")


@register("eval_full", _sql_eval_full)
def q_eval_full(spark, sf):
    m, v = _model_and_vocab(spark, sf)
    return E.eval_full(m, v, T.topics_a(spark, sf), T.passages(spark, sf), T.judgments_a(spark, sf))


def _sql_eval_full_lang(model="turbo-lloyd-1"):
    s = O.Sql()
    w = s.model(model)
    s.add("jb", O.JUDGED_B)
    s.add("jq", f"SELECT text_id, text FROM ({O.TOPICS_B}) WHERE text_id IN (SELECT qid FROM jb)")
    q = s.encode("SELECT * FROM jq", w, "qe")
    p = s.encode(O.PASSAGES_B, w, "pe")
    r = s.ranked(s.scores(q, p, "sc", same_lang=True), 100, "rk")
    pq = s.metrics(r, O.LABELS_B, "SELECT * FROM jb", (10,), (100,), "pq", group="lang")
    return s.build("SELECT m.*, coalesce(t.total_passages, 0) AS total_passages FROM ("
                   + s.every_lang(s.summary(pq, (10,), (100,), group="lang"), ["ndcg_10", "recall_100"])
                   + ") m LEFT JOIN (SELECT lang, count(*)::BIGINT AS total_passages FROM documents "
                     "WHERE doc_id % 7 <> 0 GROUP BY lang) t ON t.lang IS NOT DISTINCT FROM m.lang")


@register("eval_full_lang", _sql_eval_full_lang)
def q_eval_full_lang(spark, sf):
    m, v = _model_and_vocab(spark, sf)
    return E.eval_full(m, v, T.topics_b(spark, sf), T.passages_b(spark, sf),
                       T.judgments_b(spark, sf), group_cols=("lang",))


def _sql_eval_vectors():
    s = O.Sql()
    s.add("vq", VEC_Q)
    s.add("vr", VEC_R)
    r = s.ranked(s.scores(s.normalised("vq", "vqn"), s.normalised("vr", "vrn"), "sc"), 10, "rk")
    s.add("vlab", "SELECT q.vec_id::BIGINT AS qid, p.vec_id::BIGINT AS docid, 1 AS rel FROM embeddings q "
                  "JOIN embeddings p ON q.label = p.label WHERE q.vec_id % 10 = 0 AND p.vec_id % 10 <> 0")
    s.add("vj", "SELECT qid, count(*)::BIGINT AS num_relevant FROM vlab GROUP BY qid")
    pq = s.metrics(r, "SELECT * FROM vlab", "SELECT * FROM vj", (10,), (10,), "pq")
    return s.build(s.summary(pq, (10,), (10,)))


@register("eval_vectors", _sql_eval_vectors)
def q_eval_vectors(spark, sf):
    m, q, r = _vec_sets(spark, sf)
    return E.eval_vectors(q, r, T.judgments_vectors(spark, sf), m.dim)


def _sql_ndcg_qrels_ideal():
    s = O.Sql()
    r = _full_a_sql(s)
    s.add("lab", f"SELECT r.qid, r.rank, coalesce(l.rel, 0) AS rel FROM {r} r "
                 f"LEFT JOIN ({O.QRELS_A}) l ON l.qid = r.qid AND l.docid = r.docid")
    s.add("dcg", "SELECT qid, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) END) AS dcg FROM lab GROUP BY qid")
    s.add("idl", f"SELECT qid, sum(CASE WHEN rn <= 10 THEN rel / log2(rn + 1) END) AS idcg FROM ("
                 f"SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS rn "
                 f"FROM ({O.QRELS_A}) WHERE rel > 0) GROUP BY qid")
    return s.build("SELECT j.qid, round(CASE WHEN coalesce(i.idcg, 0) > 0 THEN coalesce(d.dcg, 0) / i.idcg "
                   "ELSE 0.0 END, 6) AS ndcg_10 FROM (SELECT DISTINCT qid FROM (" + O.QRELS_A + ")) j "
                   "LEFT JOIN dcg d USING (qid) LEFT JOIN idl i USING (qid)")


@register("ndcg_at_k_qrels_ideal", _sql_ndcg_qrels_ideal)
def q_ndcg_at_k_qrels_ideal(spark, sf):
    """nDCG@10 with the textbook ideal (all relevant documents of the query)."""
    r, j = _full_a_spark(spark, sf)
    sc = M.query_scores(T.topics_a(spark, sf), r, j, (10,), (100,), ideal="qrels")
    return sc.select(F.col("qid").cast("bigint"), F.round("ndcg_10", 6).alias("ndcg_10"))


@register("eval_full_timed")
def q_eval_full_timed(spark, sf):
    """eval_full per language with the wall-clock seconds of the run."""
    m, v = _model_and_vocab(spark, sf)
    return E.eval_full_timed(m, v, T.topics_b(spark, sf), T.passages_b(spark, sf),
                             T.judgments_b(spark, sf), group_cols=("lang",))
