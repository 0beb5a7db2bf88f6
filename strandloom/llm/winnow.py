"""Winnowing: every window of hashes is owned by its smallest hash, so equal windows are owned by equal hashes at equal places."""

from __future__ import annotations

import numpy as np


# values that are searched at once: the index of one must fit into the 24 bits that its comparison leaves
SEGMENT = 1 << 24


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the index of its smallest one; of equal ones the first. 40 bits of a value are compared."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    if n > SEGMENT:  # parts that overlap by all but one value of a window, with a window at least
        step = max(1, SEGMENT - width + 1)
        return np.concatenate([at + window_minima(values[at : at + step + width - 1], width) for at in range(0, n - width + 1, step)])
    low = np.uint64((1 << 24) - 1)
    keys = (values & ~low) | np.arange(n, dtype=np.uint64)
    if width == 1:
        return np.arange(n)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)


def owned_runs(values: np.ndarray, width: int, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of the runs of windows with one owner, among windows marked in `usable` (n - width + 1 flags)."""
    at = np.flatnonzero(usable)
    if not len(at):
        return at, at, at
    owner = window_minima(values, width)[at]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)))
    return owner[new], at[new], at[np.append(new[1:], len(at)) - 1]
