"""Longest common subsequences of many string pairs.

Two strings are compared by the bit-parallel recurrence, one addition a letter: long ones
one pair after the other, on integers as long as the shorter string; short ones, and a
string with all windows of another, on whole arrays of lanes, where strings over 64
characters take several words with a carry.
"""

from __future__ import annotations

import numpy as np

#: Lanes that are worked on together, times words: bounds the working arrays.
LANES = 1 << 17


class Coded:
    """Strings as rows of small integers, and for each the places of every letter as bits."""

    def __init__(self, strings: list[str]) -> None:
        raw = [np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32) for s in strings]
        self.lengths = np.array([len(r) for r in raw], dtype=np.int64)
        flat = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
        number = np.zeros(int(flat.max(initial=0)) + 1, dtype=np.int64)
        number[flat] = 1
        number = np.cumsum(number) - 1
        self.codes, self.letters = number[flat], int(number[-1]) + 1
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def padded(self, rows: np.ndarray, before: int, width: int) -> np.ndarray:
        """The given strings after ``before`` blanks, filled with blanks to ``width``; a blank meets no letter."""
        out = np.full((len(rows), width), self.letters, dtype=np.int64)
        n = self.lengths[rows]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        who = np.repeat(np.arange(len(rows)), n)
        out[who, before + at] = self.codes[np.repeat(self.starts[rows], n) + at]
        return out

    def masks(self, rows: np.ndarray, words: int) -> np.ndarray:
        """For each word, string and letter (and the blank), the bits of the places where it stands; strings and letters as one axis."""
        out = np.zeros((words, len(rows) * (self.letters + 1)), dtype=np.uint64)
        n = self.lengths[rows]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        who = np.repeat(np.arange(len(rows)), n)
        letter = self.codes[np.repeat(self.starts[rows], n) + at]
        np.bitwise_or.at(out.reshape(-1), (at >> 6) * out.shape[1] + who * (self.letters + 1) + letter, np.uint64(1) << (at & 63).astype(np.uint64))
        return out


def _run(masks: np.ndarray, letters: int, table: np.ndarray, bits: np.ndarray, steps: int, letter_at) -> np.ndarray:
    """Subsequence lengths: lane x compares string ``table[x]`` of ``masks`` with the letters ``letter_at(step)[x]``."""
    words, lanes = len(masks), len(table)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    state = [np.full(lanes, full) for _ in range(words)]
    base = table * (letters + 1)
    at = np.empty(lanes, dtype=np.int64)
    u, t, carry = (np.empty(lanes, dtype=np.uint64) for _ in range(3))
    over, more = np.empty(lanes, dtype=bool), np.empty(lanes, dtype=bool)
    for k in range(steps):
        np.add(base, letter_at(k), out=at)
        for w in range(words):
            s = state[w]
            np.take(masks[w], at, out=u, mode="clip")
            np.bitwise_and(u, s, out=u)
            np.add(s, u, out=t)
            if words > 1:
                np.less(t, s, out=over)
                if w:
                    np.add(t, carry, out=t)
                    np.logical_or(over, np.less(t, carry, out=more), out=over)
                np.copyto(carry, over)
            np.bitwise_xor(s, u, out=s)  # u is part of s: what is left of it
            np.bitwise_or(s, t, out=s)
    zeros = np.zeros(lanes, dtype=np.int64)
    for w in range(words):
        own = np.clip(bits - 64 * w, 0, 64)
        low = np.where(own == 64, full, (np.uint64(1) << np.minimum(own, 63).astype(np.uint64)) - np.uint64(1))
        zeros += own - np.bitwise_count(state[w] & low).astype(np.int64)
    return zeros


def _chunks(order: np.ndarray, weight: np.ndarray):
    """Parts of ``order`` whose weights add up to about LANES."""
    if not len(order):
        return
    cut = np.cumsum(weight[order]) // LANES
    yield from np.split(order, np.flatnonzero(np.diff(cut)) + 1)


def common(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    number: dict[str, int] = {}
    which = np.array([[number.setdefault(x, len(number)), number.setdefault(y, len(number))] for x, y in zip(a, b, strict=True)], dtype=np.int64).reshape(-1, 2)
    return common_of(list(number), which[:, 0], which[:, 1])


def _shared(x: str, y: str) -> int:
    """How many letters two strings begin with in common."""
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


#: Pairs of strings up to this length are compared together; longer ones, up to LONG, where there are MANY of them for each word of their length.
SHORT, LONG, MANY = 32, 1024, 64


def common_of(strings: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``strings[a[i]]`` and ``strings[b[i]]``; each different pair is compared once."""
    many = max(1, len(strings))
    pairs, back = np.unique(np.minimum(a, b) * many + np.maximum(a, b), return_inverse=True)
    left, right = pairs // many, pairs % many
    size = np.array([len(x) for x in strings], dtype=np.int64)
    most = np.maximum(size[left], size[right]) if len(pairs) else np.zeros(0, dtype=np.int64)
    words = np.minimum(size[left], size[right]) // 64 + 1 if len(pairs) else most
    short = (most <= SHORT) | ((most <= LONG) & (np.bincount(words[most <= LONG], minlength=int(words.max(initial=0)) + 1)[words] >= MANY * words))
    out = np.zeros(len(pairs), dtype=np.int64)
    if short.any():
        few, which = np.unique(np.concatenate([left[short], right[short]]), return_inverse=True)
        out[short] = _together([strings[i] for i in few.tolist()], *np.split(which, 2))
    long = np.flatnonzero(~short)
    known: dict[str, dict[str, int]] = {}
    out[long] = [_one(strings[i], strings[j], known) for i, j in zip(left[long].tolist(), right[long].tolist(), strict=True)]
    return out[back]


def _one(x: str, y: str, known: dict[str, dict[str, int]]) -> int:
    """The recurrence on a Python integer as long as the shorter string.

    What both begin and end with is part of the subsequence, and only the rest is compared.
    """
    if x == y:
        return len(x)
    k = _shared(x, y)
    x, y = x[k:], y[k:]
    if x and y and x[-1] == y[-1]:
        e = _shared(x[::-1], y[::-1])
        x, y = x[: len(x) - e], y[: len(y) - e]
        k += e
    if not x or not y:
        return k
    if len(x) > len(y):
        x, y = y, x
    places = known.get(x)
    if places is None:
        places = known[x] = {}
        bit = 1
        for c in x:
            places[c] = places.get(c, 0) | bit
            bit <<= 1
    full = (1 << len(x)) - 1
    state, of = full, places.get
    for c in y:
        hit = of(c)
        if hit:
            u = state & hit
            state = (state + u) | (state - u)
    return k + len(x) - (state & full).bit_count()


def _together(strings: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The recurrence on lanes, one for each pair."""
    coded = Coded(strings)
    swap = coded.lengths[a] > coded.lengths[b]
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    out = np.zeros(len(a), dtype=np.int64)
    n, m = coded.lengths[short], coded.lengths[long]
    live = np.flatnonzero(n > 0)
    words = -(-n // 64)
    for few in np.unique(words[live]).tolist():
        same = live[words[live] == few]
        for some in _chunks(same[np.argsort(m[same], kind="stable")], few * ((coded.letters + 1) // 8 + 1) + m // 8):
            steps = int(m[some].max())
            tables, table = np.unique(short[some], return_inverse=True)
            letters = coded.padded(long[some], 0, steps).T.copy()
            out[some] = _run(coded.masks(tables, few), coded.letters, table, n[some], steps, lambda k, letters=letters: letters[k])
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised indel similarity of each pair; two empty strings are equal."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], dtype=float)
    return np.where(total > 0, 2 * common(a, b) / np.maximum(total, 1), 1.0)


def partials(a: list[str], b: list[str]) -> np.ndarray:
    """The best ratio of each pair's shorter string to a window of its length, or cut off at an end, of the longer."""
    out = np.zeros(len(a))
    todo: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(x) > len(y):
            x, y = y, x
        if x in y:
            out[i] = 1.0 if x or not y else 0.0
        elif x:
            todo.append((i, x, y))
            if len(x) == len(y):
                todo.append((i, y, x))
    coded = Coded([s for _, x, y in todo for s in (x, y)])
    short, long = np.arange(0, 2 * len(todo), 2), np.arange(1, 2 * len(todo), 2)
    n, m = coded.lengths[short], coded.lengths[long]
    about = (4 * np.log2(np.maximum(m, 1))).astype(np.int64)  # strings of very different lengths are not filled up to one length
    for like in np.unique(about).tolist():
        same = np.flatnonzero(about == like)
        for some in _chunks(same[np.argsort(n[same], kind="stable")], 8 * (n + m)):
            best = _windows(coded, short[some], long[some])
            for at, value in zip(some.tolist(), best.tolist(), strict=True):
                i = todo[at][0]
                out[i] = max(out[i], value)
    return out


def _windows(coded: Coded, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The best ratio of each short string to a window of its length, or cut off at an end, of the long one.

    Strands are combed through the grid of both strings' letters, a diagonal at a time: two that meet pass each other once at
    most, and not where letters agree.  Those that go from the top to the bottom count what a window lacks.
    """
    n, m = coded.lengths[short], coded.lengths[long]
    rows, columns = int(n.max()), int(m.max())
    kind = np.uint16 if max(rows + columns, coded.letters) < (1 << 16) - 2 else np.uint32
    # row r of the grid is at rows - 1 - r, so that a diagonal is a slice of both; blanks of the two sides differ
    a = coded.padded(short, 0, rows)[:, ::-1].T.astype(kind)
    b = coded.padded(long, 0, columns)
    b[np.arange(columns) >= m[:, None]] = coded.letters + 1
    b = b.T.astype(kind)
    h = np.repeat(np.arange(rows, dtype=kind)[:, None], len(n), axis=1)
    v = np.repeat(np.arange(rows, rows + columns, dtype=kind)[:, None], len(n), axis=1)
    space = np.empty((min(rows, columns), len(n)), dtype=kind)
    for d in range(rows + columns - 1):
        lo, hi = max(0, d - rows + 1), min(columns, d + 1)
        x, y, t = h[rows - 1 - d + lo : rows - 1 - d + hi], v[lo:hi], space[: hi - lo]
        np.bitwise_xor(a[rows - 1 - d + lo : rows - 1 - d + hi], b[lo:hi], out=t)
        np.minimum(t, 1, out=t)
        np.multiply(t, y, out=t)
        np.maximum(x, t, out=t)  # what goes down: the entering strand where letters agree, else the larger
        np.bitwise_xor(x, y, out=x)
        np.bitwise_xor(x, t, out=x)
        np.copyto(y, t)
    # a strand from s to e is in the windows that begin after e - n and no later than s
    end, who = np.nonzero((v >= rows) & (np.arange(columns)[:, None] < m))
    begin = v[end, who].astype(np.int64) - rows
    inside = end - begin < n[who]
    end, begin, who = end[inside], begin[inside], who[inside]
    width = rows + columns + 1
    change = np.bincount(who * width + end + 1, minlength=len(n) * width) - np.bincount(who * width + begin + n[who] + 1, minlength=len(n) * width)
    lacking = np.cumsum(change.reshape(len(n), width), axis=1)  # of the window that begins at k - n
    k = np.arange(width)
    held = np.minimum(k, m[:, None]) - np.maximum(k - n[:, None], 0)
    ratio = np.where((k >= 1) & (k < n[:, None] + m[:, None]), 2 * (held - lacking) / np.maximum(n[:, None] + held, 1), 0.0)
    return ratio.max(axis=1)
