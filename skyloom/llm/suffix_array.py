"""Sorting chosen suffixes of a text, one bucket at a time, in bounded memory.

The positions i with i mod 31 in a difference cover D are ranked first: by their leading
32 bytes, then by doubling. D is a perfect difference set, so for any two residues some
shift below 31 takes both into the sample.

Then the suffixes to sort are dealt into buckets by their leading bytes, and each bucket
is sorted on its own by its leading 32 bytes. Suffixes that agree on these (long ties)
are told apart by the rank of the sample position at their residue's shift, so no
comparison ever runs on along the text.
"""

from __future__ import annotations

import numpy as np

PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
PREFIX = 32

_SHIFT = np.array([next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)], dtype=np.int64)


def _keys(padded: np.ndarray, at: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The leading bytes from each position and a number behind them, as strings of one width: their order is that of bytes, then numbers."""
    out = np.empty((len(at), PREFIX + 8), np.uint8)
    out[:, :PREFIX] = np.lib.stride_tricks.sliding_window_view(padded, PREFIX)[at]
    out[:, PREFIX:] = tail.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view(f"S{PREFIX + 8}")[:, 0]


def _names(keys: np.ndarray) -> tuple[np.ndarray, bool]:
    """Ranks from 1 on, equal for equal keys, and whether all differ."""
    order = np.argsort(keys)
    new = np.zeros(len(order), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out, bool(new[1:].all())


def cover_ranks(padded: np.ndarray, n: int, depth: int | None = None, need: np.ndarray | None = None) -> np.ndarray:
    """Rank of each sample position among the sample's suffixes (0 elsewhere and past the end).

    With ``depth`` ranks need to tell suffixes apart only within so many bytes; then the
    positions ``need``, and those a multiple of the period further on within ``depth``, do.
    """
    if depth is None or need is None:
        base = np.arange(0, n, PERIOD)
        at = (base[:, None] + np.array(COVER)).reshape(-1)
        at = at[at < n]
    else:
        marked = np.zeros(n + depth + PERIOD, bool)
        for k in range(0, depth, PERIOD):
            marked[need + k] = True
        at = np.flatnonzero(marked[:n])
    ranks = np.zeros(n + 2 * PERIOD + PREFIX, np.int64)
    if not len(at):
        return ranks
    names, distinct = _names(_keys(padded, at, np.minimum(n - at, PREFIX)))
    ranks[at] = names
    reach = PERIOD
    while not distinct and reach < (depth or n):
        names, distinct = _names(ranks[at] * (len(at) + 1) + ranks[np.minimum(at + reach, len(ranks) - 1)])
        ranks[at] = names
        reach *= 2
    return ranks


def sort_suffixes(text: np.ndarray, at: np.ndarray, depth: int | None = None, bucket: int = 1 << 20) -> np.ndarray:
    """The positions ``at`` of ``text`` (uint8) in the order of their suffixes.

    ``bucket`` bounds the suffixes sorted at once. With ``depth`` the order is that of the
    first ``depth`` bytes, and of residue, then position rank, where these agree.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(PERIOD + PREFIX + 8, np.uint8)))
    ranks = cover_ranks(padded, n, depth, at + _SHIFT[at % PERIOD])
    lead = padded[at].astype(np.int64) << 16 | padded[at + 1].astype(np.int64) << 8 | padded[at + 2]
    out = []
    for part in _buckets(lead, bucket):
        mine = at[part]
        residue = mine % PERIOD
        order = np.argsort(_keys(padded, mine, residue << 40 | ranks[mine + _SHIFT[residue]]))
        mine = mine[order]
        if depth is None:
            mine = _merge_residues(padded, mine, ranks)
        out.append(mine)
    return np.concatenate(out) if out else at[:0]


def _buckets(lead: np.ndarray, most: int):
    """Index lists in the order of the leading bytes, of about ``most`` suffixes each."""
    order = np.argsort(lead, kind="stable")
    ends = np.flatnonzero(np.diff(lead[order])) + 1
    start = 0
    for end in [*ends.tolist(), len(order)]:
        if end - start >= most or end == len(order):
            if end > start:
                yield order[start:end]
            start = end


def _merge_residues(padded: np.ndarray, mine: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Within runs that agree on the prefix, merges the residues by their common shift into the sample."""
    import functools

    lead = np.lib.stride_tricks.sliding_window_view(padded, PREFIX)[mine]
    tied = np.zeros(len(mine), bool)
    tied[1:] = (lead[1:] == lead[:-1]).all(1)
    starts = np.flatnonzero(~tied)
    ends = np.append(starts[1:], len(mine))

    def compare(i, j):
        shift = _COMMON[i % PERIOD][j % PERIOD]
        return int(ranks[i + shift]) - int(ranks[j + shift]) or j - i

    out = mine.copy()
    for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        out[s:e] = sorted(mine[s:e].tolist(), key=functools.cmp_to_key(compare))
    return out


_COMMON = [[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]
