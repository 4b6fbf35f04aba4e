"""Inputs derived from the driver's parquet tables (see FIXTURES.md part B).

  dense         embeddings -> (row_id, embedding array<double>)
  texts         documents  -> (text_id, text, lang)
  topics A      benchmark  -> (qid, text); qrels A = documents containing it
  topics B      documents with doc_id % 7 = 0 -> (qid, text, lang, source);
                passages B = the rest; rel = same lang and source (a rule)
  vector set    embeddings vec_id % 10 = 0 as queries, the rest as rows; rel = same label
  pairs         consecutive vec_ids (2i, 2i+1); gold = same label
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vectors as V
from ..operators.relevance import Judgments
from ..operators.tables import EmbeddingModel, dense_model
from .store import fingerprint

# items of at most so many characters, with 8 for each, are searched in every text without a join
SCANNED_CHARS = 4 << 20
RUN_PATTERN = r"[\p{L}\p{N}]+"
QUERY_MOD = 7
VECTOR_QUERY_MOD = 10


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Its schema is looked up in the files once per state of them."""
    path, = paths(sf_dir, name)
    key = path, fingerprint(spark, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def paths(sf_dir: str, *names: str) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names]


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("row_id"),
        V.as_double_array("embedding").alias("embedding"))


_SHAPES: dict[tuple, tuple[int, int]] = {}


def _shape(w: DataFrame, key: tuple) -> tuple[int, int]:
    """(rows, width) of a vector table; one aggregate job per table version."""
    if key not in _SHAPES:
        stats = w.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("lo"),
                      F.max(F.size("embedding")).alias("hi")).first()
        if stats["lo"] != stats["hi"]:
            raise ValueError("embedding rows differ in width")
        _SHAPES[key] = (int(stats["n"]), int(stats["lo"]))
    return _SHAPES[key]


def base_model(spark: SparkSession, sf_dir: str, name: str = "embeddings") -> EmbeddingModel:
    w = dense(spark, sf_dir)
    n, d = _shape(w, tuple(paths(sf_dir, "embeddings")) + (fingerprint(spark, *paths(sf_dir, "embeddings")),))
    return dense_model(w, d, n, [name])


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("text_id"), "text", "lang")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "lang", F.col("doc_id").alias("docid"), "text")


def topics_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _shingles(words, size: int, start: int, stop_before: int, sep: str):
    """Distinct hashes of the ``size``-run windows starting at 1-based positions
    start .. n - size + 1 - stop_before (empty when the text is too short)."""
    last = F.size(words) - size + 1 - stop_before
    return F.when(last >= start, F.array_distinct(F.transform(
        F.sequence(F.lit(start), last),
        lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), sep))))) \
        .otherwise(F.array().cast("array<bigint>"))


def containment_pairs(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str,
                      text: str = "text", span: int = 4, scanned_chars: int = SCANNED_CHARS) -> DataFrame:
    """(doc_key, item_key) where the document text contains the item text.

    Items that are few (``scanned_chars``) are searched in every document by
    ``_scan_pairs``: no text is cut into shingles or shuffled. Otherwise: an
    item's *interior* runs (all but its first and last) are delimited by the
    item's own characters, so every occurrence of the item reproduces them as
    whole runs of the document. Items with interior runs are met by an equi-join
    on hashed shingles of ``span`` of them (of all, where there are fewer) and
    verified with ``instr``. Each item is anchored on its rarest shingle (lowest
    document frequency), so a phrase repeated across the corpus never becomes a
    hot join key. Items without interior runs (at most two runs, or none) may
    begin and end inside longer runs: they are searched in every document by
    ``_scan_pairs``. A null text contains and is contained in nothing; an empty
    item is contained in every text.
    """
    sep = "\u0001"
    runs = lambda c: F.regexp_extract_all(F.col(c), F.lit(RUN_PATTERN), 0)
    it = items.where(F.col(text).isNotNull()).select(
        F.col(item_key).alias("_item"), F.col(text).alias("_itext"), runs(text).alias("_w"))
    n = F.size("_w")
    searched = docs.select(F.col(doc_key).alias("_doc"), F.col(text).alias("_dtext"))
    if (it.agg(F.sum(F.length("_itext") + 8)).first()[0] or 0) <= scanned_chars:
        # the two kinds apart: the joins below take no null ids
        found = _scan_pairs(searched.where("_doc is not null"),
                            it.where((n >= 3) & F.col("_item").isNotNull()).select("_item", "_itext"))
        return found.unionByName(_scan_pairs(searched, it.where(n < 3).select("_item", "_itext"))) \
            .select(F.col("_doc").alias(doc_key), F.col("_item").alias(item_key))
    item_sh = None
    for L in range(1, span + 1):
        own = it.where(n >= span + 2 if L == span else n == L + 2)
        part = own.select("_item", F.lit(L).alias("_alen"), F.explode(
            _shingles(F.col("_w"), L, 2, 1, sep)).alias("_a"))
        item_sh = part if item_sh is None else item_sh.unionByName(part)
    sizes = sorted(r[0] for r in item_sh.select("_alen").distinct().collect())   # <= span values
    scanned = _scan_pairs(searched, it.where(n < 3).select("_item", "_itext"))
    if not sizes:
        return scanned.select(F.col("_doc").alias(doc_key), F.col("_item").alias(item_key))
    dw = docs.select(F.col(doc_key).alias("_doc"), runs(text).alias("_w"))
    doc_sh = None
    for L in sizes:
        part = dw.select("_doc", F.lit(L).alias("_alen"), F.explode(_shingles(F.col("_w"), L, 1, 0, sep)).alias("_a"))
        doc_sh = part if doc_sh is None else doc_sh.unionByName(part)
    # document shingles that some item has; their document frequency
    hits = doc_sh.join(item_sh.select("_alen", "_a").distinct(), ["_alen", "_a"], "left_semi")
    dfreq = hits.groupBy("_alen", "_a").agg(F.count(F.lit(1)).alias("_df"))
    best = item_sh.join(dfreq, ["_alen", "_a"]).groupBy("_item").agg(
        F.min_by(F.struct("_alen", "_a"), F.struct("_df", "_a")).alias("_b")) \
        .select("_item", "_b._alen", "_b._a")
    cand = hits.join(best, ["_alen", "_a"]).select("_doc", "_item").distinct()
    dtext = docs.select(F.col(doc_key).alias("_doc"), F.col(text).alias("_dtext"))
    ver = cand.join(dtext, "_doc").join(it.select("_item", "_itext"), "_item") \
              .where(F.instr(F.col("_dtext"), F.col("_itext")) > 0).select("_doc", "_item")
    return ver.unionByName(scanned).select(F.col("_doc").alias(doc_key), F.col("_item").alias(item_key))


def _scan_pairs(docs: DataFrame, items: DataFrame, block_chars: int = 1 << 20) -> DataFrame:
    """(_doc, _item) for items (_item, _itext) found anywhere in documents (_doc, _dtext).

    A stated query set against all rows: the items go out in blocks of at most
    ``block_chars`` characters (a longer item is a block of its own), and every
    block is one narrow pass of a string automaton over the documents.
    """
    out_type = f"_doc {docs.schema['_doc'].dataType.simpleString()}, " \
               f"_item {items.schema['_item'].dataType.simpleString()}"
    blocks, size = [], block_chars
    for item, words in items.toLocalIterator():
        if size + len(words) > block_chars:
            blocks.append({})
            size = 0
        blocks[-1].setdefault(words, []).append(item)
        size += len(words)
    out = docs.sparkSession.createDataFrame([], out_type)
    for block in blocks:
        held = docs.sparkSession.sparkContext.broadcast(block)      # at most block_chars characters

        def scan(batches, held=held):
            import ahocorasick
            import pyarrow as pa

            names, machine = held.value, ahocorasick.Automaton()
            for word in names:
                if word:
                    machine.add_word(word, word)
            machine.make_automaton()
            for b in batches:
                rows, found = [], []
                for i, words in enumerate(b.column(1)):
                    words = words.as_py()
                    if words is not None:
                        hits = {w for _, w in machine.iter(words)} if len(machine) else set()
                        hits |= {""} & names.keys()
                        for w in hits:
                            found.extend(names[w])
                            rows.extend([i] * len(names[w]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, item_type)],
                    names=["_doc", "_item"])

        from pyspark.sql.pandas.types import to_arrow_type
        item_type = to_arrow_type(items.schema["_item"].dataType)
        out = out.unionByName(docs.select("_doc", "_dtext").mapInArrow(scan, out_type))
    return out


def qrels_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import materialize

    def build():
        pairs = containment_pairs(table(spark, sf_dir, "documents"),
                                  table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
        return pairs.select(F.col("item_id").alias("qid"), F.col("doc_id").alias("docid"),
                            F.lit(1).alias("rel"))
    return materialize(build, ("qrels_a", sf_dir), spark, "qrels_a", paths(sf_dir, "documents", "benchmark"))


def judgments_a(spark: SparkSession, sf_dir: str) -> Judgments:
    return Judgments(qrels=qrels_a(spark, sf_dir))


def topics_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where(F.col("doc_id") % QUERY_MOD == 0).select(
        F.col("doc_id").alias("qid"), "text", "lang", "source")


def passages_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where(F.col("doc_id") % QUERY_MOD != 0).select(
        F.col("doc_id").alias("docid"), "text", "lang", "source")


def judgments_b(spark: SparkSession, sf_dir: str) -> Judgments:
    return Judgments(query_keys=topics_b(spark, sf_dir).select("qid", "lang", "source"),
                     doc_keys=passages_b(spark, sf_dir).select("docid", "lang", "source"),
                     keys=("lang", "source"), by=("lang",))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % VECTOR_QUERY_MOD == 0).select(
        F.col("vec_id").alias("qid"), V.as_double_array("embedding").alias("embedding"), "label")


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % VECTOR_QUERY_MOD != 0).select(
        F.col("vec_id").alias("docid"), V.as_double_array("embedding").alias("embedding"), "label")


def judgments_vectors(spark: SparkSession, sf_dir: str) -> Judgments:
    return Judgments(query_keys=vector_queries(spark, sf_dir).select("qid", "label"),
                     doc_keys=vector_rows(spark, sf_dir).select("docid", "label"),
                     keys=("label",))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    a = e.where(F.col("vec_id") % 2 == 0).select(
        (F.col("vec_id") / 2).cast("bigint").alias("pair_id"), F.col("vec_id").alias("a"),
        F.col("label").alias("la"))
    b = e.where(F.col("vec_id") % 2 == 1).select(
        ((F.col("vec_id") - 1) / 2).cast("bigint").alias("pair_id"), F.col("vec_id").alias("b"),
        F.col("label").alias("lb"))
    return a.join(b, "pair_id").select("pair_id", "a", "b",
                                       (F.col("la") == F.col("lb")).cast("int").alias("gold"))
