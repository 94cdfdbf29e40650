"""Words and paragraphs of many texts at once, as numpy columns.

A paragraph is a sentence: texts are cut at line ends, and after ``.``, ``!`` or ``?`` where a space follows. Words are cut at ASCII
spaces and lower-cased (A-Z); in a text with spaces beyond ASCII, also where such a space ends a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE = 5
LONG = 40  # words from which a sentence is also looked at in pieces
REACH = 6  # words on either side that decide where a piece begins
CHUNK = 1 << 20  # bytes of texts that are looked at together, and one text at least
BLOCK = 1 << 16  # bytes whose words are hashed together, and one word at least
FACTOR = 0xD6E8FEB86659FD93
SPREAD = np.uint64(0x9E3779B97F4A7C15)

_CODE = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_CODE >= 65) & (_CODE <= 90), _CODE + 32, _CODE).astype(np.uint8)
_SPACE = np.isin(_CODE, [9, 10, 11, 12, 13, 32])
_STOP = np.isin(_CODE, list(b".!?"))
_ODD = np.isin(_CODE, [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])  # with these, spaces beyond ASCII's six begin


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * SPREAD
    return x ^ (x >> np.uint64(32))


_VALUE = mixed(mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * SPREAD))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of FACTOR and of its inverse."""
    if len(_powers[0]) < n:
        for k, x in enumerate((FACTOR, pow(FACTOR, -1, 1 << 64))):
            more = np.full(max(n, 2 * BLOCK), x, np.uint64)
            more[0] = 1
            _powers[k] = np.cumprod(more)
    return _powers[0][:n], _powers[1][:n]


class Stretches:
    """Hashes of stretches of a column: equal ones have equal hashes, wherever they stand."""

    def __init__(self, values: np.ndarray) -> None:
        powers, self.back = _upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[:-1], out=self.sums[1:])

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[first]) * self.back[first])


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``first`` and hold ``n``."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def paragraphs(text: str) -> list[tuple[int, int, list[bytes]]]:
    """start, end (code points) and lower-cased words of every paragraph."""
    out, start = [], 0
    for line in text.split("\n"):
        at = start
        for piece in re.split(r"(?<=[.!?])(?=\s)", line):
            if words := piece.encode().lower().split():
                lead = len(piece) - len(piece.lstrip())
                out.append((at + lead, at + len(piece.rstrip()), words))
            at += len(piece)
        start += len(line) + 1
    return out


def located(text: str, cut: list[tuple[int, int, list[bytes]]]) -> list[tuple[int, int]]:
    """start and end (code points) of every word; of all its sentence where spaces beyond ASCII hide some."""
    out = []
    for s, e, w in cut:
        spans = [(m.start(), m.end()) for m in WORD.finditer(text, s, e)]
        out += spans if len(spans) == len(w) else [(s, e)] * len(w)
    return out


class Texts:
    """Words and paragraphs of the texts of a column, one after the other.

    Of every word: ``start`` and ``end`` in its text (code points), ``at`` and ``upto`` (bytes of ``low``, all texts in lower case), ``hash``. Of
    every paragraph: ``first`` and ``last`` (its words, the latter exclusive), ``p_start``, ``p_end``, ``p_doc``. ``edge``: the first word of every text, and the end.
    """

    def __init__(self, column: pa.Array) -> None:
        data, off = _bytes_of(column)
        self.low = _LOWER[data]
        n = len(data)
        is_word = ~_SPACE[data]
        begins, ends = is_word.copy(), is_word.copy()
        begins[1:] &= ~is_word[:-1]
        ends[:-1] &= ~is_word[1:]
        inner = off[(off > 0) & (off < n)]
        begins[inner] |= is_word[inner]
        ends[inner - 1] |= is_word[inner - 1]
        odd = _odd_spaces(data)
        self.plain = not len(odd)
        if len(odd):
            cut = odd[(odd > 0) & _STOP[data[odd - 1]] & ~np.isin(odd, off)]
            begins[cut], ends[cut - 1] = True, True
        self.at, self.upto = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.edge = np.searchsorted(self.at, off)
        new = np.zeros(len(self.at) + 1, bool)
        new[1:] = _STOP[data[self.upto - 1]]
        new[np.searchsorted(self.at, np.flatnonzero(data == 10))] = True
        new[self.edge] = True
        self.first = np.flatnonzero(new[:-1])
        self.last = np.append(self.first[1:], len(self.at))[: len(self.first)]
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.edge))
        if n and data.max() > 127:
            points = np.zeros(n + 1, np.int32)
            np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        else:
            points = np.arange(n + 1, dtype=np.int32)
        base = points[off[self.doc]]
        self.start, self.end = points[self.at] - base, points[self.upto] - base
        self.p_start, self.p_end, self.p_doc = self.start[self.first], self.end[self.last - 1], self.doc[self.first]
        for d in np.unique(np.searchsorted(off, odd, "right") - 1).tolist():
            text = data[off[d] : off[d + 1]].tobytes().decode()
            cut = paragraphs(text)
            low, high = np.searchsorted(self.p_doc, (d, d + 1))
            self.p_start[low:high], self.p_end[low:high] = [x[0] for x in cut], [x[1] for x in cut]
            if spans := located(text, cut):
                self.start[self.edge[d] : self.edge[d + 1]], self.end[self.edge[d] : self.edge[d + 1]] = zip(*spans, strict=True)
        self.hash = self._hashes()
        self.stretch = Stretches(self.hash)

    def _hashes(self) -> np.ndarray:
        out, i = np.empty(len(self.at), np.uint64), 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.upto, self.at[i] + BLOCK, "right")))
            a = self.at[i]
            out[i:j] = Stretches(_VALUE[self.low[a : self.upto[j - 1]]])(self.at[i:j] - a, self.upto[i:j] - a)
            i = j
        return out

    def contents(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the words of each stretch, as long."""
        return self.stretch(first, last).view(np.int64)

    def words(self, first: int, last: int) -> bytes:
        """The words of a stretch, with spaces between."""
        if self.plain:
            return self.low[self.at[first] : self.upto[last - 1]].tobytes()
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.at[first:last].tolist(), self.upto[first:last].tolist(), strict=True))

    def minima(self, first: np.ndarray, last: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The least of ``values``, one a shingle, of each stretch of SHINGLE words or more; ``values`` ends with one more."""
        return np.minimum.reduceat(values, np.stack([first, last - SHINGLE + 1], 1).ravel())[::2] if len(first) else values[:0]

    def shingles(self) -> np.ndarray:
        """A 32-bit hash of the shingle that begins at each word, and one number more."""
        out = np.zeros(max(0, len(self.hash) - SHINGLE + 1), np.uint64)
        for i in range(SHINGLE):
            out = (out ^ self.hash[i : i + len(out)]) * SPREAD
            out ^= out >> np.uint64(29)
        return np.append((out >> np.uint64(32)).astype(np.uint32), np.uint32(0))

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """first and last word of every piece, start and end (code points) of the sentences around.

        Looked at in pieces are sentences of LONG words or more, and neighbours that are all shorter than SHINGLE. A piece begins at
        a word whose hash is the least of those within REACH, SHINGLE words after the last one or more. A sentence that isn't cut is no piece.
        """
        n = self.last - self.first
        short = n < SHINGLE
        turn = np.ones(len(n), bool)
        turn[1:] = ~(short[1:] & short[:-1] & (self.p_doc[1:] == self.p_doc[:-1]))
        a = np.flatnonzero(turn)
        b = np.append(a[1:], len(n))[: len(a)] - 1
        first, last = self.first[a], self.last[b]
        taken = (last - first >= SHINGLE) & (short[a] | (last - first >= LONG))
        first, last, s, e, short = first[taken], last[taken], self.p_start[a[taken]], self.p_end[b[taken]], short[a[taken]]
        cuts = self._cuts(first, last)
        begin = np.sort(np.concatenate([first, cuts]))
        own = np.searchsorted(first, begin, "right") - 1
        end = np.minimum(np.append(begin[1:], len(self.at))[: len(begin)], last[own])
        cut = short[own] | (end - begin < (last - first)[own])
        return begin[cut], end[cut], s[own[cut]], e[own[cut]]

    def _cuts(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        large = last - first >= 2 * SHINGLE
        first, n = first[large], (last - first)[large]
        if not len(first):
            return first
        own = np.repeat(np.arange(len(first)), n)
        word = ranges(first, n)
        place = np.arange(len(word)) + REACH * (own + 1)
        padded = np.zeros(len(word) + REACH * (len(first) + 1), np.uint64)  # no word is the least near an end
        padded[place] = self.hash[word]
        least = np.minimum(padded[:-1], padded[1:])
        least = np.minimum(least[:-2], least[2:])
        least = np.minimum(least[:-4], least[4:])  # of eight
        least = np.minimum(least[: len(padded) - 2 * REACH], least[2 * REACH - 7 :])
        found = np.flatnonzero(padded[place] == least[place - REACH])
        found = found[padded[place[found]] > 0]
        cuts, own = word[found], own[found]
        close = np.flatnonzero((np.diff(cuts) < SHINGLE) & (np.diff(own) == 0))
        if not len(close):
            return cuts
        keep, tied = np.ones(len(cuts), bool), np.unique(own[close])
        for low, high in zip(np.searchsorted(own, tied).tolist(), np.searchsorted(own, tied, "right").tolist(), strict=True):
            upto = 0
            for i, x in enumerate(cuts[low:high].tolist(), low):
                keep[i] = x >= upto
                upto = x + SHINGLE if keep[i] else upto
        return cuts[keep]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none), and where each begins."""
    column = pc.fill_null(column, pa.scalar("").cast(column.type)) if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def _odd_spaces(data: np.ndarray) -> np.ndarray:
    """Where spaces beyond ASCII's six begin."""
    at = np.flatnonzero(_ODD[data])
    if not len(at):
        return at
    a, b, c = (np.where(at + k < len(data), data[np.minimum(at + k, len(data) - 1)], 0) for k in range(3))
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | np.isin(c, [0xA8, 0xA9, 0xAF])) | (b == 0x81) & (c == 0x9F)
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return at[(a < 0x20) | two | three]


def slices(size: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most``, and of one row at least."""
    total, begin = np.cumsum(size), 0
    while begin < len(size):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + most, "right")))
        yield begin, end
        begin = end


def bytes_in(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of ``batch`` of about CHUNK bytes of text each, with their texts."""
    for begin, end in slices(bytes_in(batch.column("text"))):
        some = batch.slice(begin, end - begin)
        yield some, Texts(some.column("text"))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every text, one after the other, as hashes of 46 bits or more in their order; where each text's begin, and the end."""
    t = Texts(column)
    n = np.maximum(0, np.diff(t.edge) - SHINGLE + 1)
    first = ranges(t.edge[:-1], n)
    bits = np.uint64(max(1, len(n).bit_length()))
    keys = np.repeat(np.arange(len(n), dtype=np.uint64) << (np.uint64(64) - bits), n) | (t.stretch(first, first + SHINGLE) >> bits)
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    edge = np.searchsorted(keys, np.arange(len(n), dtype=np.uint64) << (np.uint64(64) - bits))
    return keys & ((np.uint64(1) << (np.uint64(64) - bits)) - np.uint64(1)), np.append(edge, len(keys))


def shared(sets: np.ndarray, edge: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles the texts ``a`` and ``b`` of each pair share, of what `shingle_sets` gives."""
    size, out = np.diff(edge), np.zeros(len(a), np.int64)
    for i, j in slices(size[a] + size[b]):
        bits = max(1, (j - i).bit_length())
        place, lost = np.uint64(64 - bits), np.uint64(max(0, bits - max(1, len(size).bit_length())))
        pair = np.arange(j - i, dtype=np.uint64) << place
        keys = np.concatenate([np.repeat(pair, size[x]) | (sets[ranges(edge[x], size[x])] >> lost) for x in (a[i:j], b[i:j])])
        keys.sort()
        out[i:j] = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> place).astype(np.int64), minlength=j - i)
    return out
