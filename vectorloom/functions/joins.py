"""Join helpers with an explicit, checked broadcast decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast a side only when it is proven to hold at most this many bytes.
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024


def bounded_rows(df: DataFrame, max_rows: int) -> int | None:
    """Row count of ``df`` if it is at most ``max_rows``, else None.

    ``limit`` stops the scan early, so the check costs at most max_rows + 1 rows.
    """
    n = df.limit(max_rows + 1).count()
    return n if n <= max_rows else None


def broadcast_if_bounded(df: DataFrame, row_bytes: int,
                         max_bytes: int = DEFAULT_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``broadcast(df)`` when rows * row_bytes <= max_bytes (checked), else ``df``.

    Beyond the bound the caller's join falls back to a shuffle join; AQE's skew
    handling splits hot keys there.
    """
    max_rows = max(1, max_bytes // max(1, row_bytes))
    n = bounded_rows(df, max_rows)
    if n is None:
        return df, False
    return F.broadcast(df), True


def skew_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner", row_bytes: int = 96,
              max_bytes: int = DEFAULT_BROADCAST_BYTES, support: float = 0.005, salts: int = 32) -> DataFrame:
    """``big`` joined to ``small`` on the column ``on`` (inner or left), whatever the sizes and skew.

    A small side proven to fit is broadcast. Otherwise a frequent-items sketch of ``big`` names
    the values that may hold more than ``support`` of its rows (at most a few hundred, and none
    that does is missed); their rows are dealt over ``salts`` parts, each of which gets a copy of
    the small side's rows of these values. All other rows join plainly. Columns of ``small``
    other than ``on`` must not be in ``big``.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"an inner or left join is wanted, not {how!r}")
    sent, fits = broadcast_if_bounded(small, row_bytes, max_bytes)
    if fits:
        return big.join(sent, on, how)
    hot = [v for v in big.stat.freqItems([on], support).first()[0] if v is not None]
    if not hot:
        return big.join(small, on, how)
    often = F.coalesce(F.col(on).isin(hot), F.lit(False))
    dealt = big.where(often).withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = small.where(often).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    few = dealt.join(copies, [on, "_salt"], how).drop("_salt")
    return few.unionByName(big.where(~often).join(small, on, how))
