"""Hashed character n-grams and a logistic fit on them, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SPAN = 1 << 20
_ROWS = 256


def spans(text: str, overlap: int) -> Iterator[np.ndarray]:
    """UTF-8 bytes of the lower-cased text, words set apart by one blank, in overlapping spans.

    Spans bound the memory of a text of any length; the overlap keeps n-grams across their ends.
    """
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "replace"), np.uint8)
    for low in range(0, max(1, len(raw) - overlap), SPAN):
        yield raw[low : low + SPAN + overlap]


def ngram_buckets(text: str, sizes: Sequence[int], bits: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of the n-grams within words, the blank beside a word included.

    With ``weights``, only buckets of non-zero weight.
    """
    found = []
    for raw in spans(text, max(sizes) - 1):
        blanks = np.concatenate([[0], np.cumsum(raw == 32, dtype=np.int32)])
        h = np.zeros(len(raw), np.uint64)
        for k in range(max(sizes)):
            n = k + 1
            if n > len(raw):
                break
            h = (h[: len(raw) - k] ^ raw[k:]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            if n in sizes:
                last = len(raw) - k
                # no blank strictly inside the n-gram
                whole = blanks[k : k + last] - blanks[1 : last + 1] <= 0
                at = ((h[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
                found.append(at if weights is None else at[weights[at] != 0])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def fit_logistic(
    rows: Sequence[np.ndarray], target: np.ndarray, scale: np.ndarray, importance: np.ndarray, l2: float, rounds: int = 80, rate: float = 0.03
) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias) of a logistic model on the buckets with non-zero ``scale``.

    A feature has the value ``scale[bucket]``; targets may be soft. Full-batch Adam from zero, so the
    same rows in the same order give the same model.
    """
    used = np.flatnonzero(scale)
    place = np.full(len(scale), -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    # one copy of the features, 4 bytes each; sums run over blocks of rows
    columns = [place[r][place[r] >= 0] for r in rows]
    sizes = np.array([len(c) for c in columns])
    blocks = [(low, np.concatenate(columns[low : low + _ROWS])) for low in range(0, len(columns), _ROWS)]
    del columns
    factor = scale[used]
    total = importance.sum()
    prior = float((importance * target).sum() / total)
    w, bias = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        weights, g, gb = w * factor, np.zeros(len(used)), 0.0
        for low, flat in blocks:
            own = sizes[low : low + _ROWS]
            owner = np.repeat(np.arange(len(own)), own)
            z = np.bincount(owner, weights=weights[flat], minlength=len(own)) + bias
            error = importance[low : low + _ROWS] * (sigmoid(z) - target[low : low + _ROWS])
            g += np.bincount(flat, weights=error[owner], minlength=len(used))
            gb += error.sum()
        g, gb = g * factor / total + l2 * w, gb / total
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        one, two = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / one) / (np.sqrt(v / two) + 1e-8)
        bias -= rate * (mb / one) / (np.sqrt(vb / two) + 1e-8)
    out = np.zeros(len(scale))
    out[used] = w * factor
    return out, bias


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
