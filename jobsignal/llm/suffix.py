"""Suffix order of an integer string, cut at a depth."""

from __future__ import annotations

import numpy as np


def argsort(key: np.ndarray) -> np.ndarray:
    """Stable order of non-negative integers; key and index are sorted as one number where both fit 63 bits."""
    n = len(key)
    bits = n.bit_length()
    if n and int(key.max()).bit_length() + bits <= 63:
        return np.sort((key.astype(np.int64) << bits) | np.arange(n)) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


def dense(key: np.ndarray) -> np.ndarray:
    """Rank of each value among the distinct values."""
    order = argsort(key)
    s = key[order]
    step = np.empty(len(s), np.int64)
    step[:1] = 0
    step[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.int64)
    out[order] = np.cumsum(step)
    return out


def _after(rank: np.ndarray, h: int) -> np.ndarray:
    """Rank of the suffix h further on, 0 past the end."""
    out = np.zeros_like(rank)
    if h < len(rank):
        out[:-h] = rank[h:] + 1
    return out


def suffix_ranks(codes: np.ndarray, depth: int, held: int = 1) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` symbols (prefix doubling); equal prefixes share a rank.

    Each code stands for the ``held`` symbols from its place on, so doubling starts there.
    """
    n = len(codes)
    rank, h = dense(codes), held
    while h < depth and n:
        step = min(h, depth - h)
        rank = dense(rank * (n + 1) + _after(rank, step))
        h += step
    return rank


def suffix_array(codes: np.ndarray, depth: int, held: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, ranks); ties at ``depth`` stand by position."""
    rank = suffix_ranks(codes, depth, held)
    return argsort(rank), rank
