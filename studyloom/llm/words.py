"""Word and shingle hashes of whole texts, computed over the bytes of a group of texts at once.

A word is a run of ASCII letters and digits and of all other non-ASCII characters, after lower-casing; everything else
separates. Equal words have equal 64-bit hashes; unequal ones meet with a chance of about 2**-64.
"""
import numpy as np

_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD[128:] = True
_STEP = 0x9E3779B97F4A7C15


def mix(x):
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n):
    p = np.full(n, _STEP, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def groups(texts, size=1 << 19):
    """(first, list of folded UTF-8 texts) in groups of about ``size`` bytes; NULL counts as empty."""
    first, out, got = 0, [], 0
    for i, t in enumerate(texts):
        b = t.lower().encode() if t else b""
        out.append(b)
        got += len(b) + 1
        if got >= size:
            yield first, out
            first, out, got = i + 1, [], 0
    if out:
        yield first, out


def word_hashes(folded):
    """(hash of each word, offset of each text's first word and the total) for a list of folded texts."""
    data = np.frombuffer(b"\n".join(folded) + b"\n", np.uint8)
    inside = _WORD[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    lens = np.flatnonzero(edge == -1) - starts
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in folded), np.int64, len(folded)))
    offs = np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), offs
    packed = np.concatenate([[0], np.cumsum(lens)[:-1]])
    place = np.arange(packed[-1] + lens[-1]) - np.repeat(packed, lens)
    value = (data[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[place]
    return mix(np.add.reduceat(value, packed) + lens.astype(np.uint64)), offs


def shingles(h, k):
    """Hash of the k words from each position on; positions near the end of the array are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = (s + h[j:j + n]) * np.uint64(_STEP)
    return mix(s)


def owners(offs):
    """Index of the text that each word belongs to."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))
