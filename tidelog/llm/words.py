"""Hashes of windows of words, for many texts at once."""

from __future__ import annotations

import numpy as np

from tidelog.llm.spans import mixed


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each `width`-word window that begins at a word, and whether it lies inside that word's text."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - k)] = words[k:]
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + part)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    return out, left >= width
