import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import bits as B


def _roundtrip(spark, codes, bits):
    n, d = codes.shape
    df = spark.createDataFrame([(i, [int(x) for x in codes[i]]) for i in range(n)],
                               "row_id bigint, codes array<int>")
    out = df.select("row_id", B.pack(F.col("codes"), d, bits).alias("p")) \
            .select("row_id", F.length("p").alias("nbytes"), B.unpack(F.col("p"), d, bits).alias("u")) \
            .orderBy("row_id").collect()
    return [r["nbytes"] for r in out], np.array([r["u"] for r in out])


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
@pytest.mark.parametrize("shape", [(4, 16), (20, 256), (1, 64)])
def test_pack_unpack_exact(spark, bits, shape):
    rng = np.random.default_rng(bits * 1000 + shape[1])
    codes = rng.integers(0, 1 << bits, size=shape)
    _, back = _roundtrip(spark, codes, bits)
    assert (back == codes).all()


@pytest.mark.parametrize("bits,width", [(1, 4), (2, 8), (4, 16), (8, 32)])
def test_packed_width(spark, bits, width):
    codes = np.random.default_rng(0).integers(0, 1 << bits, size=(10, 32))
    nbytes, _ = _roundtrip(spark, codes, bits)
    assert set(nbytes) == {width}


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_edges(spark, bits):
    for fill in (0, (1 << bits) - 1):
        codes = np.full((5, 16), fill)
        _, back = _roundtrip(spark, codes, bits)
        assert (back == codes).all()


def test_one_bit_padding_and_three_bits(spark):
    codes = np.random.default_rng(1).integers(0, 2, size=(3, 13))
    nbytes, back = _roundtrip(spark, codes, 1)
    assert set(nbytes) == {2} and (back == codes).all()
    codes3 = np.random.default_rng(2).integers(0, 8, size=(3, 10))
    nbytes, back = _roundtrip(spark, codes3, 3)
    assert set(nbytes) == {10} and (back == codes3).all()


def test_bad_width():
    with pytest.raises(ValueError):
        B.packed_len(30, 2)
    with pytest.raises(ValueError):
        B.packed_len(31, 4)
