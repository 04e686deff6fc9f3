"""Deep-shallow sorting of suffixes, many groups of them at once.

Multikey quicksort goes eight bytes a step down to a shallow depth; what is
still together there is put into blind tries: a node looks at the one byte in
which a suffix first leaves its head, so that the bytes before are compared
once, not once a level.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16  # bytes that multikey quicksort looks at
STEP = 8


def words(buffer: np.ndarray) -> np.ndarray:
    """The big-endian 64-bit word at every byte of a buffer; it ends STEP bytes before the buffer does."""
    return np.ndarray((max(len(buffer) - STEP + 1, 0),), dtype=">u8", buffer=buffer, strides=(1,))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Numbers, from 0, of runs of equal neighbours."""
    new = np.zeros(len(keys[0]), np.int64)
    if len(new):
        change = np.zeros(len(new) - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        new[1:] = np.cumsum(change)
    return new


def _shared(group: np.ndarray) -> np.ndarray:
    """Which members of groups (runs of numbers) are not alone."""
    return np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)


def multikey(at: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Members that share their first ``depth`` bytes with another one of their group, in order, and their new groups."""
    which = np.arange(len(starts))
    for d in range(0, depth, STEP):
        # the last step goes back to end at the depth
        word = at[starts[which] + min(d, depth - STEP)].astype(np.uint64)
        order = np.lexsort((word, group))
        which, word = which[order], word[order]
        group = _runs(group[order], word)
        keep = _shared(group)
        which, group = which[keep], _runs(group[keep])
    return which, group


def common(at: np.ndarray, a: np.ndarray, b: np.ndarray, begin: int, end: int) -> np.ndarray:
    """How many bytes, up to ``end``, the suffixes at ``a`` and ``b`` have in common, ``begin`` of which are known."""
    out = np.full(len(a), end, np.int64)
    live = np.arange(len(a))
    for d in range(begin, end, STEP):
        d = min(d, end - STEP)
        x = at[a[live] + d].astype(np.uint64) ^ at[b[live] + d].astype(np.uint64)
        differ = x != 0
        if differ.any():
            # the first byte that differs: leading zero bytes of the word
            y = x[differ]
            lead = np.zeros(len(y), np.int64)
            for shift in (32, 16, 8):
                high = (y >> np.uint64(64 - shift)) == 0
                lead += np.where(high, shift // 8, 0)
                y = np.where(high, y << np.uint64(shift), y)
            out[live[differ]] = d + lead
            live = live[~differ]
        if not len(live):
            break
    return out


def blind_tries(buffer: np.ndarray, at: np.ndarray, starts: np.ndarray, which: np.ndarray, group: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Members with equal first ``end`` bytes, and numbers of their leaves.

    All groups grow their tries together. The first member of a group is its
    head; the others leave the head's path at some depth by some byte, which
    makes them members of the node there, or they reach the head's own leaf.
    """
    leaf_of, leaves, made = [], [], 0
    while len(which):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        head = which[np.repeat(first, np.diff(np.r_[first, len(which)]))]
        depth = common(at, starts[which], starts[head], begin, end)
        equal = depth >= end
        shared = np.bincount(group[equal], minlength=len(first))[group] > 1
        done = equal & shared
        if done.any():
            leaf_of.append(which[done])
            leaves.append(_runs(group[done]) + made)
            made = int(leaves[-1][-1]) + 1
        rest = ~equal
        which, group, depth = which[rest], group[rest], depth[rest]
        branch = buffer[starts[which] + depth]
        order = np.lexsort((branch, depth, group))
        which = which[order]
        group = _runs(group[order], depth[order], branch[order])
        keep = _shared(group)
        which, group = which[keep], _runs(group[keep])
    if not leaves:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(leaf_of), np.concatenate(leaves)


def equal_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (numbers in ``starts``) that share their first ``length`` bytes with another one of their group, and numbers of what they share.

    ``group`` is ascending; ``length`` is 8 at least and lies within the data for every suffix.
    """
    buffer = np.concatenate([data, np.zeros(STEP, np.uint8)])
    at = words(buffer)
    shallow = min(shallow, length)
    which, group = multikey(at, starts, group, shallow)
    return blind_tries(buffer, at, starts, which, group, shallow - shallow % STEP, length)
