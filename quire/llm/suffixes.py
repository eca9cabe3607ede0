"""Suffix arrays by two-stage sorting, to a given depth, in numpy.

Only suffixes that are smaller than their successor (the suffix one byte on) are sorted directly; every other suffix is placed by a scan over
the buckets of first bytes: when a suffix comes up in order, the one before it takes the next free place of its bucket. Common prefixes of
neighbours in the array are then counted up to the depth.
"""

from __future__ import annotations

import numpy as np

#: Ends a stretch of text; UTF-8 has no such byte, so equal windows of text hold none of it.
END = 0xFF


def padded(stretches: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all stretches, END after each and `depth` times more at last, and where each stretch begins."""
    sizes = np.array([len(x) + 1 for x in stretches], np.int64)
    text = np.frombuffer(bytes([END]).join([*stretches, bytes([END]) * (depth + 8)]), np.uint8)
    return text, np.cumsum(sizes) - sizes


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers in the order of the bytes."""
    rows = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
    return rows[at].view(">u8").ravel().astype(np.uint64)


def _steps(depth: int) -> list[int]:
    """Offsets of eight-byte words that cover `depth` bytes exactly (8 at least)."""
    return [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]


def _sorted(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the `depth` bytes from each on: by the first word, then ties by the next."""
    at = at[np.argsort(_words(text, at), kind="stable")]
    if not len(at):
        return at
    word = _words(text, at)
    group = np.cumsum(np.r_[False, word[1:] != word[:-1]])
    for step in _steps(depth)[1:]:
        tied = np.r_[group[1:] == group[:-1], False]
        tied[1:] |= tied[:-1]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        word = _words(text, at[places] + step)
        order = np.lexsort((word, group[places]))  # moves rows within their group only
        at[places], word = at[places[order]], word[order]
        apart = np.zeros(len(at), np.int64)
        apart[places[1:]] = (word[1:] != word[:-1]) & (group[places[1:]] == group[places[:-1]])
        group = group + np.cumsum(apart)
    return at


def _rising(text: np.ndarray) -> np.ndarray:
    """For each place but the last, whether its suffix is smaller than the next: the first unequal neighbours from there on rise, as the end does."""
    up = text[:-1] < text[1:]
    edge = np.where(text[:-1] != text[1:], np.arange(len(text) - 1), len(text) - 1)
    edge = np.minimum.accumulate(edge[::-1])[::-1]
    return np.r_[up, True][edge]


def suffix_array(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places of text (from padded) in the order of their suffixes, to `depth` bytes at least (8 or more).

    Beyond the wanted ones, just those suffixes are sorted that inducing needs: the successors of falling ones.
    """
    rising, need = _rising(text), np.zeros(len(text), bool)
    need[wanted] = True
    fresh = wanted
    while len(fresh):  # a falling suffix is placed when its successor comes up
        fresh = fresh[~rising[fresh]] + 1
        fresh = fresh[~need[fresh]]
        need[fresh] = True
    direct = _sorted(text, np.flatnonzero(need[:-1] & rising), depth)
    lows = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    falling = need[:-1] & ~rising

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """Hands the places before `found` to their buckets; returns those of this very bucket."""
        before = found[found > 0] - 1
        before = before[falling[before]]
        if not len(before):
            return before
        first = text[before]
        own = before[first == byte]
        rest, first = before[first != byte], first[first != byte]
        order = np.argsort(first, kind="stable")
        rest, first = rest[order], first[order]
        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else first
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(first)], strict=False):
            waiting[first[low]].append(rest[low:high])
        return own

    for byte in range(256):
        turn = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        while len(turn):  # runs of one byte: each turn places the suffixes one byte before
            out.append(turn)
            turn = induce(turn, byte)
        grown = direct[lows[byte] : lows[byte + 1]]
        out.append(grown)
        induce(grown, byte)
        waiting[byte] = []
    found = np.concatenate(out)
    chosen = np.zeros(len(text), bool)
    chosen[wanted] = True
    return found[chosen[found]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of the array how many bytes it shares with the one before, `depth` at most; 0 for the first."""
    shared = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for step in range(0, depth, 8):
        a, b = _words(text, order[open_ - 1] + step), _words(text, order[open_] + step)
        apart = a ^ b
        same = apart == 0
        lead = np.zeros(len(open_), np.int64)
        for k in range(1, 8):
            lead += apart < np.uint64(1 << (64 - 8 * k))
        shared[open_] += np.where(same, 8, lead)
        open_ = open_[same]
    return np.minimum(shared, depth)
