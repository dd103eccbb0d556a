"""Equal strings of a fixed length in a text, by backward extension on its Burrows-Wheeler transform (numpy)."""

from __future__ import annotations


def equal_prefixes(text, length: int):
    """(rows, starts): positions in the order of their cyclic suffixes, and where runs with equal ``length`` bytes begin.

    Prefix doubling sorts the suffixes to at least ``length`` bytes; the ranks on
    the way give the boundaries between rows whose common prefix is shorter
    than the last power of two below ``length``. From there the boundaries
    are extended backward, breadth first: the row of c + suffix starts a new
    run at depth d + 1 where its neighbour has another first byte or comes from
    another run at depth d. Depths grow by one and stop at ``length``: longer
    common prefixes are never looked at.
    """
    import numpy as np
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    wide = np.concatenate([text, np.resize(text, 8)]).astype(np.uint64)
    key, depth = wide[:n].copy(), 1
    while depth < 8:  # eight bytes as one number, cyclic
        key = (key << np.uint64(8 * depth)) | np.roll(key, -depth % n)
        depth *= 2
    shallow, at = None, 1
    if length <= 8:
        order = np.argsort(key >> np.uint64(8 * (8 - length)), kind="stable")
        short = (key >> np.uint64(8 * (8 - length)))[order]
        return order, np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
    while True:
        order = np.argsort(key)  # ties may fall as they like: only equality up to ``length`` counts
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        if depth < length:
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            at = depth
            key = (rank << 32) | np.roll(rank, -depth % n)
            depth *= 2
            continue
        break
    # Boundaries at depth ``at`` of the final order: the ranks of that depth, read along it.
    shallow = rank[order]
    new = np.concatenate([[True], shallow[1:] != shallow[:-1]])
    first, before = text[order], text[order - 1]
    turn = np.concatenate([[True], first[1:] != first[:-1]])
    back = np.argsort(before, kind="stable")  # row of c + suffix -> row of the suffix
    for _ in range(at, length):
        run = np.cumsum(new, dtype=np.int32)[back]
        new = turn | np.concatenate([[True], run[1:] != run[:-1]])
    return order, np.flatnonzero(new)
