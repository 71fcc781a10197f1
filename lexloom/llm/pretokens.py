"""Pretokens of byte-level BPE as a deterministic transducer over character classes.

The automaton has eight states and reads one class a character (with one
character of look-ahead folded into the symbol); its output says whether the
character begins a pretoken. Texts are cut into chunks of equal length. For
each chunk the map from every possible first state to the last state is found
(almost every map is constant after a few characters, and then one lane
follows it), the maps are composed by a parallel prefix scan, and a second
pass with the true first states writes the output.
"""

from __future__ import annotations

import numpy as np

BREAK, LETTER, NUMBER, OTHER, OPEN, WHITE, ONE, TWO = range(8)
C_LETTER, C_NUMBER, C_OTHER, C_BLANK, C_WHITE, C_APOS2, C_APOS3, C_INNER = range(8)
CHUNK = 256
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The class of each code point, from the Unicode properties L, N and white space."""
    if not _classes:
        import regex

        table = np.full(0x110000, C_OTHER, np.uint8)
        text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, value in ((r"\p{L}+", C_LETTER), (r"\p{N}+", C_NUMBER), (r"\s+", C_WHITE)):
            for m in regex.finditer(pattern, text):
                table[ord(text[m.start()]) : ord(text[m.end() - 1]) + 1] = value
        table[0xD800:0xE000] = C_OTHER
        table[0x1C:0x20] = C_OTHER  # separators are white space to Python alone
        table[32] = C_BLANK
        _classes.append(table)
    return _classes[0]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and begins[state, symbol]; symbol = class * 4 + (next is no white space) * 2 + first of a text."""
    follow, begins = np.zeros((8, 32), np.uint8), np.zeros((8, 32), bool)
    for state in range(8):
        for symbol in range(32):
            c, solid, first = symbol >> 2, symbol >> 1 & 1, symbol & 1
            s = BREAK if first else state
            if c == C_LETTER:
                go, out = {TWO: ONE, ONE: BREAK}.get(s, LETTER), s not in (LETTER, OPEN, ONE, TWO)
            elif c == C_NUMBER:
                go, out = NUMBER, s not in (NUMBER, OPEN)
            elif c == C_OTHER or (c in (C_APOS2, C_APOS3) and s in (OTHER, OPEN)):
                go, out = OTHER, s not in (OTHER, OPEN)
            elif c in (C_APOS2, C_APOS3):
                go, out = (ONE if c == C_APOS2 else TWO), True
            elif c == C_INNER:
                go, out = BREAK, False
            elif solid:
                go, out = (OPEN if c == C_BLANK else BREAK), True
            else:
                go, out = WHITE, s != WHITE
            follow[state, symbol], begins[state, symbol] = go, out
    return follow, begins


FOLLOW, BEGINS = _automaton()
#: The next state, shifted to make room for a symbol, of each (state, symbol).
STEP = (FOLLOW.reshape(-1) << 5).astype(np.uint8)


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), in log2(rows) steps."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), 1)
        step *= 2
    return maps


def run(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether each character begins a pretoken."""
    n = len(symbols)
    if not n:
        return np.zeros(0, bool)
    lanes = -(-n // chunk)
    padded = np.zeros(lanes * chunk, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    head = min(4, chunk)
    for k in range(head):
        maps = FOLLOW[maps, grid[k][:, None]]
    open_ = np.flatnonzero((maps != maps[:, :1]).any(1))
    one, wide = maps[:, 0] << 5, maps[open_]
    for k in range(head, chunk):
        one = STEP.take(one | grid[k])
        if len(open_):
            wide = FOLLOW[wide, grid[k][open_, None]]
    maps = np.repeat((one >> 5)[:, None], 8, 1)
    maps[open_] = wide
    state = np.empty(lanes, np.uint8)
    state[0] = BREAK
    state[1:] = compose_scan(maps)[:-1, BREAK] << 5
    seen = np.empty((chunk, lanes), np.uint8)
    for k in range(chunk):
        np.bitwise_or(state, grid[k], out=seen[k])
        state = STEP.take(seen[k])
    return BEGINS.reshape(-1).take(np.ascontiguousarray(seen.T).reshape(-1)[:n])


def special_string(added: list[dict]) -> bytes:
    """The special string of a tokenizer file: of none or one added token that is matched as it stands; other files are refused."""
    if len(added) > 1 or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("a file with one added token at most, matched as it stands, is needed")
    return added[0]["content"].encode() if added else b""


def boundaries(offsets: np.ndarray, data: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pretokens begin, and of those the ones that are the special string."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e
    raw = data.tobytes()
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # byte position of each character
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = char_classes()[points]
    n = len(kind)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    specials = []
    if special:
        p = raw.find(special)
        while p >= 0:
            row = np.searchsorted(offsets, p, "right") - 1
            if p + len(special) <= offsets[row + 1]:
                specials.append(p)
                p += len(special) - 1
            p = raw.find(special, p + 1)
    apos = np.flatnonzero(points == 39)
    if len(apos):
        ends = np.searchsorted(at, offsets[np.searchsorted(offsets, at[apos], "right")])
        for p in specials:  # a contraction doesn't reach into the special string
            k = np.searchsorted(at, p)
            ends = np.where(apos < k, np.minimum(ends, k), ends)
        a = points[np.minimum(apos + 1, n - 1)]
        b = points[np.minimum(apos + 2, n - 1)]
        two = (apos + 1 < ends) & np.isin(a, [ord(c) for c in "stmd"])
        pair = a.astype(np.int64) << 21 | b
        three = (apos + 2 < ends) & np.isin(pair, [ord(x) << 21 | ord(y) for x, y in ("re", "ve", "ll")])
        kind = kind.copy()
        kind[apos[two]] = C_APOS2
        kind[apos[three]] = C_APOS3
    for p in specials:
        k = int(np.searchsorted(at, p))
        kind[k : k + len(special)] = C_INNER
        first[k] = first[k + len(special)] = True
    solid = np.zeros(n, bool)
    solid[:-1] = (kind[1:] != C_BLANK) & (kind[1:] != C_WHITE) & ~first[1:n]
    flags = run((kind << 2) | (solid.astype(np.uint8) << 1) | first[:n])
    marks = np.array(specials, np.int64)
    if specials:
        flags[np.searchsorted(at, marks)] = True
    return at[flags], marks
