"""Language identification with a blended-spectrum string kernel.

A text is the sets of byte n-grams (1 to 3 bytes of its UTF-8 form, ASCII letters
lower-cased) it contains. The kernel of two texts is the mean over the orders of
|A & B| / sqrt(|A| |B|). A bounded, labelled sample gives Nystroem landmarks and
one-versus-rest kernel ridge regressions. A prediction is the product of the
batch's presence rows with the landmarks' rows and with the regression weights;
as the kernel is linear in the presence rows, the last two factors are multiplied
first, once, so a batch costs one sparse product whatever the number of landmarks.
Three-byte n-grams are hashed to 2^17 features; the kernel is defined on these.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
ORDERS = 3
HASH_BITS = 17
WIDTHS = (256, 1 << 16, 1 << HASH_BITS)


def held_out(id_col: str) -> Column:
    """True for documents that no model may learn from: crc32 of the id's text mod 3 is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def presence(buf: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct n-gram features of one text, per order."""
    c = T.LOWER[buf].astype(np.uint32)
    grams = [c, (c[:-1] << 8) | c[1:],
             ((((c[:-2] << 16) | (c[1:-1] << 8) | c[2:]) * np.uint32(0x9E3779B1))
              >> np.uint32(32 - HASH_BITS))]
    out = []
    for g, width in zip(grams, WIDTHS):
        seen = np.zeros(width, dtype=bool)
        seen[g] = True
        out.append(np.flatnonzero(seen))
    return out


@dataclass
class KernelModel:
    langs: list[str]
    weights: list[np.ndarray]      # per order: features x languages
    bias: np.ndarray

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """One row of regression values per text of the buffer."""
        n = len(offs) - 1
        out = np.tile(self.bias, (n, 1))
        for lo, hi, part, at in T.chunks(buf, offs):
            rows = [presence(part[at[i]:at[i + 1]]) for i in range(hi - lo)]
            for order, w in enumerate(self.weights):
                sets = [r[order] for r in rows]
                sizes = np.asarray([len(s) for s in sets])
                filled = np.flatnonzero(sizes)
                if len(filled):
                    first = np.cumsum(np.append(0, sizes[filled][:-1]))
                    sums = np.add.reduceat(w[np.concatenate(sets)], first, axis=0)
                    out[lo + filled] += sums / np.sqrt(sizes[filled])[:, None]
        return out


def fit(texts: list[str], langs: list[str], landmarks: int = 256, ridge: float = 0.1) -> KernelModel:
    """Kernel ridge regression on Nystroem features of the sample, in input order.

    The landmarks are taken in turn from each language, so a rare one has its own.
    """
    names = sorted(set(langs))
    if not names:
        return KernelModel([], [np.zeros((w, 0), np.float32) for w in WIDTHS], np.zeros(0))
    sets = [presence(np.frombuffer(t.encode("utf-8", "replace"), np.uint8)) for t in texts]
    turn: dict[str, int] = {}
    order = sorted(range(len(langs)), key=lambda i: (turn.setdefault(langs[i], 0),
                                                     turn.update({langs[i]: turn[langs[i]] + 1}) or i))
    picked = order[:landmarks]
    kernel = np.zeros((len(sets), len(picked)))
    marks = []
    for o, width in enumerate(WIDTHS):
        m = np.zeros((width, len(picked)), dtype=np.float32)
        for j, i in enumerate(picked):
            if len(sets[i][o]):
                m[sets[i][o], j] = 1 / np.sqrt(len(sets[i][o])) / ORDERS
        marks.append(m)
        for i, s in enumerate(sets):
            if len(s[o]):
                kernel[i] += m[s[o]].sum(axis=0) / np.sqrt(len(s[o]))
    values, vectors = np.linalg.eigh((kernel[picked] + kernel[picked].T) / 2)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel @ root
    y = np.where(np.asarray(langs)[:, None] == np.asarray(names)[None, :], 1.0, -1.0)
    share = np.asarray([langs.count(x) for x in names]) / len(langs)
    bias = 2 * share - 1
    a = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ (y - bias))
    alpha = (root @ a).astype(np.float32)
    return KernelModel(names, [m @ alpha for m in marks], bias)


def training_sample(docs: DataFrame, per_language: int = 400, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """About ``per_language`` whole texts of each language, picked by a hash of the id.

    The sample is the only thing a model learns from, and it is bounded by
    ``per_language`` times the number of languages. Held-out documents, null
    languages and texts without a letter are left out.
    """
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"),
                        held_out(id_col).alias("h")).filter("not h and l is not null")
    counts = dict(known.groupBy("l").count().collect())        # one row per language
    if not counts:
        return [], []
    spark = docs.sparkSession
    top = float(1 << 63)
    share = spark.createDataFrame([(k, int(min(1.0, per_language / n) * top) - 1) for k, n in counts.items()],
                                  "l string, most bigint")
    rank = F.xxhash64("i").bitwiseAND(F.lit((1 << 63) - 1))
    rows = (known.join(F.broadcast(share), "l").filter((rank <= F.col("most")) & has_letter(F.col("t")))
            .select("l", "t", "i").collect())
    rows.sort(key=lambda r: (r.l, str(r.i), r.t))
    return [r.t for r in rows], [r.l for r in rows]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: KernelModel, text_col: str = "text",
            pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language of every whole text and its score between 0 and 1.

    A null text, a text without a letter, or a model without languages gives
    ``und`` and 0. Ties go to the first language by name. An existing column of
    the same name as an output is replaced; other columns pass through.
    """
    shared = T.share(docs.sparkSession, model)    # features x languages
    docs = docs.drop(pred, score).withColumn("__letter", has_letter(F.col(f"`{text_col}`")))
    names = docs.columns[:-1]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared()
        langs = np.asarray([*m.langs, UNKNOWN], dtype=object)
        for b in batches:
            sure = b.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            n = b.num_rows
            best, top = np.full(n, len(m.langs)), np.zeros(n)
            if m.langs and n:
                values = m.scores(*T.text_bytes(b.column(at)))
                best = np.where(sure, values.argmax(axis=1), best)
                top = np.where(sure, np.clip((values.max(axis=1) + 1) / 2, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(names))), pa.array(langs[best].tolist(), pa.string()),
                 pa.array(top, pa.float64())], names=[*names, pred, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1])
    return docs.mapInArrow(T.kernel(run), f"{schema}, {pred} string, {score} double")
