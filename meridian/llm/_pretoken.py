"""Pre-tokens without a regex: codepoint classes and a scan over composed transition functions.

Every codepoint is a symbol: its class, and for white space whether a non-space
follows, for an apostrophe whether a contraction follows. A symbol is a function from
the state before it to the state after it. Functions compose associatively, so blocks
of the text are folded independently, the blocks' functions are scanned, and a second
pass inside the blocks marks the positions at which a pre-token begins.
"""

from __future__ import annotations

import unicodedata

import numpy as np

# The code points of Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions of the published pre-tokenisation pattern, by length after the apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")

OTHER, LETTER, NUMBER, WHITE_ = range(4)
FRESH, IN_L, IN_N, IN_O, IN_S, ATTACH, ONE, TWO = range(8)
L, N, O, A1, A2, SP_LAST, SP, WS_LAST, WS = range(9)
_BLOCK = 64
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        c = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        c[WHITE] = WHITE_
        _classes = c
    return _classes


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and begins[symbol, state]; symbols from 9 on are those at a document's start."""
    after = np.empty((18, 8), np.uint8)
    begins = np.zeros((18, 8), bool)
    for s in range(8):
        for symbol, run in ((L, IN_L), (N, IN_N), (O, IN_O)):
            after[symbol, s], begins[symbol, s] = run, s not in (run, ATTACH)
        for symbol, left in ((A1, ONE), (A2, TWO)):
            joined = s in (IN_O, ATTACH)
            after[symbol, s], begins[symbol, s] = IN_O if joined else left, not joined
        after[SP_LAST, s], begins[SP_LAST, s] = ATTACH, True
        after[WS_LAST, s], begins[WS_LAST, s] = FRESH, True
        for symbol in (SP, WS):
            after[symbol, s], begins[symbol, s] = IN_S, s != IN_S
    for s, then in ((TWO, ONE), (ONE, FRESH)):  # the letters of a contraction
        after[L, s], begins[L, s] = then, False
    after[9:], begins[9:] = after[:9, [FRESH] * 8], True
    return after, begins


AFTER, BEGINS = _tables()


def codepoints(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, and the byte at which each begins."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    if len(at) == len(buf):
        return buf.astype(np.uint32), at
    pad = np.r_[buf, np.zeros(3, np.uint8)]
    lead = buf[at].astype(np.uint32)
    cp = lead.copy()
    for size, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        k = np.flatnonzero(lead >= (0xC0, 0xE0, 0xF0)[size - 2]) if size == 4 else np.flatnonzero((lead >= (0xC0, 0xE0)[size - 2]) & (lead < (0xE0, 0xF0)[size - 2]))
        v = lead[k] & mask
        for j in range(1, size):
            v = v << 6 | (pad[at[k] + j] & 0x3F)
        cp[k] = v
    return cp, at


def symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point; first: the indexes at which documents begin."""
    n = len(cp)
    kind = classes()[cp]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    white = kind == WHITE_
    last = np.ones(n, bool)  # a non-space follows in the same document
    last[:-1] = ~white[1:]
    last &= ~opens[1:]
    out = np.array([O, L, N, WS], np.uint8)[kind]
    out[white & last] = WS_LAST
    space = cp == 0x20
    out[space] = np.where(last[space], SP_LAST, SP)
    q = np.flatnonzero(cp == 0x27)
    if len(q):
        pad = np.r_[cp, 0, 0]
        nxt, far = pad[q + 1], pad[q + 2]
        stop = np.r_[opens[1:], True, True]
        one = ~stop[q]
        two = one & ~stop[q + 1]
        out[q[one & np.isin(nxt, [ord(x) for x in SHORT])]] = A1
        for x in LONG:
            out[q[two & (nxt == ord(x[0])) & (far == ord(x[1]))]] = A2
    out[first] += 9
    return out


def starts(sym: np.ndarray) -> np.ndarray:
    """True where a pre-token begins."""
    n = len(sym)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // _BLOCK)
    grid = np.full(rows * _BLOCK, L, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, _BLOCK).T)
    table = AFTER.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))  # each block's function
    for col in grid:
        whole = table[(col.astype(np.uint16) * 8)[:, None] + whole]
    # Scan of the blocks' functions by doubling: after it, row i is the composition of blocks 0..i.
    step = 1
    while step < rows:
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step], 1)
        step *= 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = FRESH, whole[:-1, FRESH]
    out = np.empty((_BLOCK, rows), bool)
    begins = BEGINS.ravel()
    for j, col in enumerate(grid):
        k = col.astype(np.uint16) * 8 + state
        out[j] = begins[k]
        state = table[k]
    return out.T.ravel()[:n]


def pretokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pre-tokens of the documents in buf, and the index of each document's first one (and the end)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    cp, at = codepoints(buf)
    first = np.searchsorted(at, np.unique(off[:-1][off[:-1] < off[1:]]))
    s = at[starts(symbols(cp, first))]
    return s, np.r_[s[1:], len(buf)], np.searchsorted(s, off)
