"""Words, spans and repeats of many texts at once, as NumPy arrays over their UTF-8 bytes.

These helpers run inside tasks, on the texts of one Arrow batch.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LONG = 256  # bytes of a span from which on it is hashed by its bytes
SLICE = 2 << 20  # bytes looked at together; a longer text is a slice of its own
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_powers = {}


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 1), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 2 * SLICE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pair(x: np.ndarray, y) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + y + np.uint64(0x165667B19E3779F9))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the runs of bytes other than blanks."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~BLANK[data]
    edge = np.zeros(len(data) + 2, bool)
    edge[offsets + 1] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[1:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[2:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class SpanHash:
    """64-bit hashes of any spans of a byte array.

    A polynomial modulo 2 ** 64 takes certain different texts of a thousand bytes and more for the same (Thue-Morse
    words and their complements), so spans longer than ``LONG`` are hashed by their bytes.
    """

    def __init__(self, data: np.ndarray):
        self.data = np.ascontiguousarray(data)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * powers(len(data), _ODD), out=self.sums[1:])
        self.back = powers(len(data) + 1, _INVERSE)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        out = mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i]:ends[i]], digest_size=8).digest(), "little")
        return out


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for every n in ``lengths``, one after another."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)


def _dense(order: np.ndarray, fresh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of its group, as a rank, for sorted rows; and which rows share a group."""
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(order)))
    return np.repeat(first[begin], size), np.repeat(size > 1, size)


class SuffixArray:
    """Suffix array of the symbols of several documents, by prefix doubling.

    ``codes`` are symbols, ``ends`` the end of the document of each position (no repeat crosses it).
    Documents are sorted apart from each other.  Only suffixes that still share their first 2**k
    symbols are sorted again.  With a ``limit`` doubling ends before more symbols than that are compared, and
    only the last ranks are kept.  A code may
    stand for the next ``unit`` symbols; then only the ranks of suffixes that long are meaningful.
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray, limit: int | None = None, by_document: bool = True, unit: int = 1):
        n = len(codes)
        self.ends, self.levels = ends, []
        order = np.lexsort((codes, ends)) if by_document else np.argsort(codes, kind="stable")
        fresh = np.ones(n, bool)
        if n:
            ranked = codes[order]
            fresh[1:] = ranked[1:] != ranked[:-1]
            if by_document:
                fresh[1:] |= ends[order[1:]] != ends[order[:-1]]
            del ranked
        rank = np.empty(n, np.int64)
        start, shared = _dense(order, fresh, np.arange(n))
        rank[order] = start
        live, width = order[shared], unit
        del order, fresh, start, shared
        self.levels.append(rank)
        while len(live) and (limit is None or 2 * width <= limit):
            rank = rank.copy()
            behind = live + width
            inside = behind < ends[live]
            follow = np.where(inside, self.levels[-1][np.minimum(behind, n - 1)], -1 - live)
            mine = self.levels[-1][live]
            again = np.lexsort((follow, mine))
            a, b = mine[again], follow[again]
            live = live[again]
            fresh = np.ones(len(live), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            head = np.ones(len(live), bool)
            head[1:] = a[1:] != a[:-1]
            begin = np.flatnonzero(head)
            place = a + ragged(np.diff(np.append(begin, len(live))))
            start, shared = _dense(live, fresh, place)
            rank[live] = start
            live, width = live[shared], 2 * width
            if limit is not None:
                self.levels.clear()
            self.levels.append(rank)
        self.width = width  # symbols that the last ranks tell apart
        self.order = np.argsort(rank, kind="stable") if limit is None else None

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``a`` and ``b`` share at their beginning."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            p, q = a + length, b + length
            room = np.flatnonzero((p < self.ends[a]) & (q < self.ends[b]))
            same = room[self.levels[k][p[room]] == self.levels[k][q[room]]]
            length[same] += 1 << k
        return length

    def longest_repeat(self) -> np.ndarray:
        """For every position the length of the longest repeat that begins there: its largest LCP."""
        longest = np.zeros(len(self.order), np.int64)
        if len(self.order) > 1:
            a, b = self.order[:-1], self.order[1:]
            lcp = self.common_prefix(a, b)
            longest[b] = lcp  # no position is twice in a, or twice in b
            longest[a] = np.maximum(longest[a], lcp)
        return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in some span."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + lengths, -1)
    return np.cumsum(depth[:-1]) > 0
