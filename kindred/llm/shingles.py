"""Bags of word shingles as 64-bit hashes, for whole batches of texts at once.

A word is a run of ASCII letters, digits and non-ASCII characters of the lower-cased
text.  A shingle is five consecutive words; a text of one to four words has one shingle
of all its words.  A text without a word has an empty bag.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

WORDS = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)  # odd: its powers have inverses modulo 2**64
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _MUL)
_PLACES = mix64(np.arange(101, 101 + WORDS, dtype=np.uint64) * _MUL) | np.uint64(1)
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_IN_WORD[128:] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(1 << max(16, (n - 1).bit_length()), base, dtype=np.uint64)
        p[0] = 1
        have = _powers[name] = np.cumprod(p, dtype=np.uint64)
    return have


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and where each text's words begin (one entry more than texts)."""
    raws = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
    if len(buf) > 1 << 21 and len(raws) > 1:  # bound the working arrays
        half = len(raws) // 2
        (a, x), (b, y) = word_hashes(texts[:half]), word_hashes(texts[half:])
        return np.concatenate([a, b]), np.concatenate([x, y[1:] + x[-1]])
    inside = _IN_WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]  # the last byte is no word's
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[buf] * _power("step", _STEP, len(buf))[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("inverse", _INVERSE, len(buf))[starts]
    h = mix64(h + (ends - starts).astype(np.uint64) * _MUL)
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    return h, np.searchsorted(starts, offsets)


def sequence_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each text's sequence of words."""
    n = len(first) - 1
    counts = np.diff(first)
    place = np.arange(len(h)) - np.repeat(first[:-1], counts)
    most = int(counts.max()) if n else 0
    out = []
    for name, base, salt in (("k1", _MUL | np.uint64(1), 0x51), ("k2", np.uint64(0xC2B2AE3D27D4EB4F), 0xA7)):
        terms = mix64(h + np.uint64(salt)) * _power(name, base, most + 1)[place]
        sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(terms, out=sums[1:])
        out.append(mix64(sums[first[1:]] - sums[first[:-1]] + counts.astype(np.uint64) * _MUL).view(np.int64))
    return out[0], out[1]


def bags(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, shingle, count``: each text's different shingles, in order of text and hash."""
    n = len(first) - 1
    counts = np.diff(first)
    many = np.where(counts >= WORDS, counts - WORDS + 1, (counts > 0).astype(counts.dtype))
    padded = np.concatenate([h, np.zeros(WORDS, dtype=np.uint64)])
    rolled = np.zeros(len(h), dtype=np.uint64)
    for k in range(WORDS):
        rolled += padded[k : k + len(h)] * _PLACES[k]
    begins = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(n), many)
    at = np.arange(begins[-1]) - begins[text] + first[:-1][text]
    s = rolled[at]
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
        part = h[first[i] : first[i + 1]]
        s[begins[i]] = (part * _PLACES[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    s = mix64(s)
    for i in range(n):
        s[begins[i] : begins[i + 1]].sort()
    if not len(s):
        return text, s, np.zeros(0, dtype=np.int64)
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (text[1:] != text[:-1])])
    where = np.flatnonzero(new)
    return text[where], s[where], np.diff(np.concatenate([where, [len(s)]]))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted hashes, counts); two empty bags are equal."""
    (ha, ca), (hb, cb) = a, b
    if not len(ha) and not len(hb):
        return 1.0
    if not len(ha) or not len(hb):
        return 0.0
    at = np.searchsorted(ha, hb)
    at[at == len(ha)] = 0
    same = ha[at] == hb
    shared = int(np.minimum(ca[at[same]], cb[same]).sum())
    return shared / (int(ca.sum()) + int(cb.sum()) - shared)
