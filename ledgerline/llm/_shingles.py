"""Word shingles of a text as sets of 64-bit hashes (numpy)."""

from __future__ import annotations

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: dict = {}


def mixed(x):
    """A 64-bit finaliser: every input bit reaches every output bit."""
    import numpy as np
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int):
    """Powers of the base and of its inverse, up to n."""
    import numpy as np
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words(text: str):
    """64-bit hashes of the words, in order: A-Z lowered, split at spaces and the characters 09 to 0D."""
    import numpy as np
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    ends = np.flatnonzero(blank)
    a, b = np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(data)]])
    a, b = a[b > a], b[b > a]
    if not len(a):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64)])
    return mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(text: str, n: int):
    """Sorted distinct hashes of the ``n``-word shingles; with fewer words, the whole sequence as one."""
    import numpy as np
    w = words(text)
    if not len(w):
        return w
    k = min(n, len(w))
    h = w[:len(w) - k + 1].copy()
    for i in range(1, k):
        h = mixed(h * np.uint64(_BASE) + w[i:len(w) - k + 1 + i])
    return np.unique(mixed(h + np.uint64(k)))
