"""Pre-token boundaries by a small finite-state machine over whole batches.

The split pattern of the byte-level vocabularies is

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

It is compiled by hand into eight states over symbols that carry up to two
characters of look-ahead. Texts are cut into chunks of fixed length; each chunk
is reduced to its *state map* (an element of the finite transition monoid), the
maps are composed by a parallel prefix scan, and then every chunk is replayed
from its true start state. No step depends on where a text begins or ends.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from spanframe.llm.batches import row_slices

LETTER, NUMBER, OTHER, QUOTE, SPACE, WHITE, ONE, R, V, L, E = range(11)
UNKNOWN, END = 255, 99
CHUNK = 64

# states: what the characters read so far of the current piece are
FRESH, LETTERS, NUMBERS, OTHERS, WHITES, GLUE, LAST1, LAST2 = range(8)
# symbols: a class with its look-ahead
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE, S_QUOTE1, S_QUOTE2, S_SPACE, S_WHITE, S_WHITE_MORE = range(9)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state]; symbols + 9 begin a text; 18 changes nothing."""
    follow, start = np.zeros((19, 8), np.uint8), np.zeros((19, 8), bool)
    for state in range(8):
        for symbol in range(9):
            fresh, to = True, FRESH
            if state == LAST2 or state == LAST1:
                fresh, to = False, LAST1 if state == LAST2 else FRESH
            elif symbol in (S_LETTER, S_NUMBER, S_OTHER):
                to = (LETTERS, NUMBERS, OTHERS)[symbol]
                fresh = state not in (to, GLUE)
            elif symbol in (S_QUOTE, S_QUOTE1, S_QUOTE2):
                if state in (OTHERS, GLUE):
                    fresh, to = False, OTHERS
                else:
                    to = {S_QUOTE: OTHERS, S_QUOTE1: LAST1, S_QUOTE2: LAST2}[symbol]
            elif symbol == S_WHITE_MORE:
                fresh, to = state != WHITES, WHITES
            else:  # the last white character before something else begins a piece
                to = GLUE if symbol == S_SPACE else FRESH
            follow[symbol, state], start[symbol, state] = to, fresh
    follow[9:18], start[9:18] = follow[:9, FRESH][:, None], True
    follow[18] = np.arange(8)
    return follow, start


def _monoid(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements as state maps, step[element, symbol], product[first, second])."""
    index = {tuple(range(8)): 0}
    todo, step = [tuple(range(8))], []
    for element in todo:
        row = []
        for symbol in range(len(follow)):
            made = tuple(int(follow[symbol, s]) for s in element)
            if made not in index:
                index[made] = len(index)
                todo.append(made)
            row.append(index[made])
        step.append(row)
    elements = np.array(todo, np.uint8)
    product = np.array([[index[tuple(b[s] for s in a)] for b in todo] for a in todo], np.int16)
    return elements, np.array(step, np.int16), product


FOLLOW, START = _machine()
ELEMENTS, STEP, PRODUCT = _monoid(FOLLOW)
_STEP, _FOLLOW, _START = STEP.ravel(), FOLLOW.ravel(), START.ravel()


class Splitter:
    """``together(strings)`` says for each string whether the library keeps it in one piece.

    Classes of characters beyond ASCII are asked of the library itself, once for
    each code point: Unicode versions differ between libraries.
    """

    def __init__(self, together: Callable[[list[str]], list[bool]]):
        self.together = together
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        for c in range(128):
            ch = chr(c)
            self.table[c] = (LETTER if ch.isalpha() else NUMBER if ch.isdigit() else QUOTE if ch == "'" else SPACE if ch == " "
                             else WHITE if c in (9, 10, 11, 12, 13) else OTHER)
        for chars, kind in (("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
            for ch in chars:
                self.table[ord(ch)] = kind

    def _learn(self, points: np.ndarray) -> None:
        chars = [chr(p) for p in points]
        letter = self.together([f"a{c}a" for c in chars])
        number = self.together([f"1{c}1" for c in chars])
        other = self.together([f"!{c}!" for c in chars])
        self.table[points] = np.where(letter, LETTER, np.where(number, NUMBER, np.where(other, OTHER, WHITE)))

    def split(self, data: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Byte offsets at which pieces start; ``heads``: the offsets at which non-empty texts start."""
        if not len(data):
            return np.zeros(0, np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        at = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.table[points]
        if (new := kind == UNKNOWN).any():
            self._learn(np.unique(points[new]))
            kind = self.table[points]
        first = np.zeros(len(at) + 2, bool)
        first[np.searchsorted(at, heads)] = True
        first[len(at):] = True
        ahead = np.where(first[1: len(at) + 1], END, np.append(kind[1:], END))
        symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_QUOTE, S_SPACE, S_WHITE] + [S_LETTER] * 5, np.uint8)[kind]
        white = (kind == SPACE) | (kind == WHITE)
        symbol[white & ((ahead == SPACE) | (ahead == WHITE) | (ahead == END))] = S_WHITE_MORE
        quotes = np.flatnonzero(kind == QUOTE)
        a = ahead[quotes]
        b = np.where((a == END) | (quotes + 1 >= len(at)), END, ahead[np.minimum(quotes + 1, len(at) - 1)])
        two = ((a == R) & (b == E)) | ((a == V) & (b == E)) | ((a == L) & (b == L))
        symbol[quotes] = np.where(a == ONE, S_QUOTE1, np.where(two, S_QUOTE2, S_QUOTE))
        symbol[first[: len(at)]] += 9
        return at[self._starts(symbol)]

    @staticmethod
    def _starts(symbol: np.ndarray) -> np.ndarray:
        n = len(symbol)
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, 18, np.uint8)
        grid[:n] = symbol
        columns = np.ascontiguousarray(grid.reshape(rows, CHUNK).T).astype(np.intp)
        maps = np.zeros(rows, np.intp)
        for column in columns:  # each chunk's state map
            maps = _STEP[maps * 19 + column].astype(np.intp)
        reach = 1
        while reach < rows:  # inclusive prefix scan: maps[i] becomes maps[0] .. maps[i]
            maps[reach:] = PRODUCT[maps[:-reach], maps[reach:]]
            reach *= 2
        state = np.zeros(rows, np.intp)
        state[1:] = ELEMENTS[maps[:-1], FRESH]
        out = np.zeros((CHUNK, rows), bool)
        for j, column in enumerate(columns):
            at = column * 8 + state
            out[j] = _START[at]
            state = _FOLLOW[at].astype(np.intp)
        return np.flatnonzero(out.T.ravel()[:n])


def segments(data: np.ndarray, marks: np.ndarray, low: int, high: int, limit: int, special: bytes = b"") -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Rows ``low`` to ``high`` as (row, first byte, last byte + 1), and how often ``special`` stood in each row.

    ``special`` strings are left out. A long text is cut where a single space
    stands between two ASCII letters: a piece starts there whatever came before.
    """
    parts: list[tuple[int, int, int]] = []
    found = np.zeros(high - low, np.int64)
    raw = data[marks[low]: marks[high]].tobytes() if special else b""
    base = int(marks[low])
    hits: list[int] = []
    if special:
        at = raw.find(special)
        while at >= 0:
            hits.append(base + at)
            at = raw.find(special, at + len(special))
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    k = 0
    for row in range(low, high):
        start, end = int(marks[row]), int(marks[row + 1])
        pieces = []
        while k < len(hits) and hits[k] < end:
            pieces.append((start, hits[k]))
            start = hits[k] + len(special)
            found[row - low] += 1
            k += 1
        pieces.append((start, end))
        for a, b in pieces:
            while b - a > limit:
                body = data[a:b]
                good = np.zeros(0, np.int64)
                seek = limit // 2
                while seek < b - a and not len(good):  # look further where a stretch has no such space
                    part = body[seek: seek + limit]
                    good = np.flatnonzero((part[1:-1] == 32) & letter[part[:-2]] & letter[part[2:]]) + 1 + seek
                    seek += limit - 2
                if not len(good):
                    break
                parts.append((row, a, a + int(good[0])))
                a += int(good[0])
            if b > a:
                parts.append((row, a, b))
    return parts, found


def pieces(data: np.ndarray, marks: np.ndarray, splitter: Splitter, limit: int, special: bytes = b""):
    """Yield (row of each piece, bytes, starts, ends, rows with special strings, their counts) by bounded slices."""
    for low, high in row_slices(marks, limit):
        parts, found = segments(data, marks, low, high, limit, special)
        hit = np.flatnonzero(found)
        given = False
        i = 0
        while i < len(parts) or (not given and len(hit)):
            j, size = i, 0
            while j < len(parts) and (j == i or size + parts[j][2] - parts[j][1] <= limit):
                size += parts[j][2] - parts[j][1]
                j += 1
            chunk = parts[i:j]
            body = np.concatenate([data[a:b] for _, a, b in chunk]) if chunk else np.zeros(0, np.uint8)
            lengths = np.array([b - a for _, a, b in chunk], np.int64)
            heads = np.cumsum(lengths) - lengths
            starts = splitter.split(body, heads)
            ends = np.append(starts[1:], len(body))[: len(starts)]
            rows = np.array([r for r, _, _ in chunk], np.int64)
            rows = rows[np.searchsorted(heads, starts, side="right") - 1] if len(starts) else np.zeros(0, np.int64)
            yield rows, body, starts, ends, (hit + low if not given else hit[:0]), (found[hit] if not given else found[:0])
            given = True
            i = j


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one piece for each distinct byte string, number of that string for each piece).

    Hashes find the repeats, and every piece is compared byte by byte with the one that stands for it.
    """
    from spanframe.llm.batches import word_hashes

    _, first, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size, other = ends - starts, starts[first[back]]
    same = np.array_equal(size, size[first[back]])
    if same:
        shift = np.repeat(other - starts, size)
        at = np.arange(len(shift)) + np.repeat(starts - (np.cumsum(size) - size), size)
        same = np.array_equal(data[at], data[at + shift])
    if not same:  # two strings under one hash
        raw, numbers = data.tobytes(), {}
        back = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        first = np.zeros(len(numbers), np.int64)
        first[back[::-1]] = np.arange(len(back))[::-1]
    return first, back
