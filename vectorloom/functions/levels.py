"""Fixed values and seeded constants shared by Spark code and the SQL checks."""

from __future__ import annotations

import math

import numpy as np

# --- Fixed values (must equal the published reconstruction levels) ---------
# Max-Lloyd optimal reconstruction levels of the standard normal N(0, 1),
# keyed by bit width, in ascending order (Max 1960; Lloyd 1982).
GAUSSIAN_LLOYD_MAX_LEVELS: dict[int, tuple[float, ...]] = {
    1: (-0.7979, 0.7979),
    2: (-1.5104, -0.4528, 0.4528, 1.5104),
    3: (-2.1519, -1.3439, -0.7560, -0.2451, 0.2451, 0.7560, 1.3439, 2.1519),
    4: (-2.7326, -2.0690, -1.6181, -1.2562, -0.9424, -0.6568, -0.3881, -0.1284,
        0.1284, 0.3881, 0.6568, 0.9424, 1.2562, 1.6181, 2.0690, 2.7326),
}
# The seed of every random rotation.
ROTATION_SEED = 42
# ---------------------------------------------------------------------------


def lloyd_levels(bits: int) -> list[float]:
    if bits not in GAUSSIAN_LLOYD_MAX_LEVELS:
        raise ValueError(
            f"no Max-Lloyd codebook for {bits} bits; available: "
            f"{sorted(GAUSSIAN_LLOYD_MAX_LEVELS)}")
    return list(GAUSSIAN_LLOYD_MAX_LEVELS[bits])


def midpoints(levels: list[float]) -> list[float]:
    """Decision thresholds between sorted levels: x > m_j means level > j."""
    return [(levels[j] + levels[j + 1]) / 2.0 for j in range(len(levels) - 1)]


def stored_codebook(bits: int, d: int) -> list[float]:
    """Levels divided by sqrt(D): decoded value = row norm * codebook[code]."""
    s = math.sqrt(d)
    return [v / s for v in lloyd_levels(bits)]


def uniform_qmax(bits: int) -> int:
    if bits < 2 or bits > 8:
        raise ValueError(f"uniform quantization needs 2..8 bits, got {bits} "
                         "(1 bit has q_max = 0 and cannot be decoded)")
    return (1 << (bits - 1)) - 1


def uniform_codebook(bits: int) -> list[float]:
    """Implicit codebook of uniform codes after shifting by q_max + 1."""
    q = uniform_qmax(bits)
    return [float(v) / q for v in range(-q - 1, q + 1)]


def hadamard_signs(d: int, seed: int = ROTATION_SEED) -> list[int]:
    """Random +-1 diagonal applied before the Hadamard transform."""
    rng = np.random.default_rng(seed)
    return [int(x) for x in rng.choice(np.array([-1, 1]), size=d)]


def qr_rotation(d: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """Orthogonal (D, D) matrix from the QR factorisation of a seeded Gaussian."""
    rng = np.random.default_rng(seed)
    q, r = np.linalg.qr(rng.standard_normal((d, d)))
    return q * np.sign(np.diag(r))[None, :]


def hadamard_blocks(d: int) -> list[int]:
    """Powers of two that add up to the width, the widest first: 768 is 512 + 256."""
    if d <= 0:
        raise ValueError(f"a rotation needs at least one dimension, not {d}")
    return [1 << b for b in reversed(range(d.bit_length())) if d >> b & 1]


def butterfly(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows times diag(signs) H / sqrt(width), block by block, in log2(width) passes of sums and
    differences. Agrees with ``hadamard_matrix`` and keeps every row's norm."""
    out = x * signs
    start = 0
    for width in hadamard_blocks(x.shape[1]):
        part = np.ascontiguousarray(out[:, start:start + width])
        half = 1
        while half < width:
            pairs = part.reshape(len(x), width // (2 * half), 2, half)
            part = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2)
            half *= 2
        out[:, start:start + width] = part.reshape(len(x), width) / math.sqrt(width)
        start += width
    return out


def hadamard_matrix(d: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """The full orthogonal matrix of ``rotate_hadamard`` (for tests)."""
    s = np.array(hadamard_signs(d, seed), dtype=np.float64)
    out, start = np.zeros((d, d)), 0
    for width in hadamard_blocks(d):
        idx = np.arange(width)
        parity = np.array([[bin(i & j).count("1") & 1 for j in idx] for i in idx])
        out[start:start + width, start:start + width] = np.where(parity == 0, 1.0, -1.0) / math.sqrt(width)
        start += width
    return s[:, None] * out
