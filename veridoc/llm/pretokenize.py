"""Pre-tokenisation without a regex engine.

The split that byte-level vocabularies expect (contractions, then an optional space with a run of letters,
of numbers or of other signs, then white space, whose last character leads the next piece if it is a space)
is run as a finite automaton over codepoint classes. A class is a function from state to state; functions
compose associatively, and the closure of the class functions under composition is a small table. So the
text is cut in equal blocks, each block is folded to one function (all blocks at once, column by column),
the blocks' functions are chained to find the state each block starts in, and a second sweep gives the state
at every position. Boundaries then follow from neighbouring states.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

# The White_Space codepoints of Unicode.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers that Unicode 16 adds to the tables of Python 3.13 (first, last).
UNICODE_16_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
UNICODE_16_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

# Codepoint classes. The letters of contractions have their own.
END, LETTER, NUMBER, SIGN, SPACE, OTHER_SPACE, APOSTROPHE, C_STMD, C_RV, C_E, C_L = range(11)
# States: what the last character was. QUOTE is an apostrophe that starts a piece; HALF_E and HALF_L stand
# after 'r or 'v and after 'l; CLOSED is the last letter of a contraction.
S_START, S_LETTER, S_NUMBER, S_SIGN, S_SPACE, S_OTHER, S_QUOTE, S_HALF_E, S_HALF_L, S_CLOSED = range(10)
BLOCK = 128


def _step(state: int, kind: int) -> int:
    if kind == END:
        return S_START
    if kind == SPACE:
        return S_SPACE
    if kind == OTHER_SPACE:
        return S_OTHER
    if kind == NUMBER:
        return S_NUMBER
    if kind == SIGN:
        return S_SIGN
    if kind == APOSTROPHE:
        return S_SIGN if state in (S_SIGN, S_QUOTE, S_SPACE) else S_QUOTE
    if state == S_QUOTE and kind == C_STMD:
        return S_CLOSED
    if state == S_QUOTE and kind == C_RV:
        return S_HALF_E
    if state == S_QUOTE and kind == C_L:
        return S_HALF_L
    if (state, kind) in ((S_HALF_E, C_E), (S_HALF_L, C_L)):
        return S_CLOSED
    return S_LETTER


@cache
def classes() -> np.ndarray:
    """The class of each codepoint."""
    table = np.full(0x110000, SIGN, np.uint8)
    for code in range(0x110000):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            table[code] = LETTER
        elif major == "N":
            table[code] = NUMBER
    for spans, kind in ((UNICODE_16_LETTERS, LETTER), (UNICODE_16_NUMBERS, NUMBER)):
        for first, last in spans:
            table[first : last + 1] = kind
    table[WHITE_SPACE] = OTHER_SPACE
    table[0x20] = SPACE
    table[ord("'")] = APOSTROPHE
    for letters, kind in (("stmd", C_STMD), ("rv", C_RV), ("e", C_E), ("l", C_L)):
        table[[ord(c) for c in letters]] = kind
    return table


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The closure of the class functions: (then, apply, identity's row omitted). then[f * 11 + c] is f
    followed by the function of class c; apply[f * 10 + s] is f(s). Function c is that of class c; the last
    one is the identity."""
    base = [tuple(_step(s, c) for s in range(10)) for c in range(11)]
    known = {f: i for i, f in enumerate(base)}
    functions = list(base)
    known_identity = tuple(range(10))
    then = []
    i = 0
    while i < len(functions):
        row = []
        for g in base:
            h = tuple(g[s] for s in functions[i])
            if h not in known:
                known[h] = len(functions)
                functions.append(h)
            row.append(known[h])
        then.append(row)
        i += 1
    functions.append(known_identity)
    then.append(list(range(11)))
    kind = np.uint16
    return np.array(then, kind).reshape(-1), np.array(functions, np.uint8).reshape(-1), np.array([len(functions) - 1], kind)


def states(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state after each position."""
    n = len(kinds)
    then, apply, identity = monoid()
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    folded = np.full(blocks, identity[0], np.intp)
    for column in columns:
        folded *= 11
        folded += column
        folded = then[folded].astype(np.intp)
    # Chain the blocks: log-step scan of the functions' tables.
    maps = apply.reshape(-1, 10)[folded]
    shift = 1
    while shift < blocks:
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].copy(), axis=1)
        shift *= 2
    now = np.zeros(blocks, np.intp)
    now[1:] = maps[:-1, S_START]
    step = apply[: 11 * 10].reshape(11, 10).T.reshape(-1).copy()  # [state * 11 + class]
    out = np.empty((BLOCK, blocks), np.uint8)
    for j, column in enumerate(columns):
        now *= 11
        now += column
        out[j] = step[now]
        now = out[j].astype(np.intp)
    return out.T.reshape(-1)[:n]


# For each state, the run it belongs to: pieces break where the run changes.
_RUN = np.array([0, 1, 2, 3, 4, 4, 3, 1, 1, 1], np.uint8)


def starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each position of a text whose documents are each closed by END."""
    state = states(kinds)
    run = _RUN[state]
    before_state = np.concatenate([np.zeros(1, np.uint8), state[:-1]])
    before = np.concatenate([np.zeros(1, np.uint8), run[:-1]])
    after_state = np.concatenate([state[1:], np.zeros(1, np.uint8)])
    after = np.concatenate([run[1:], np.zeros(1, np.uint8)])
    start = run != before
    # A space leads the piece after it; other white space doesn't.
    start &= ~((before_state == S_SPACE) & (run != 0) & (run != 4))
    # The last white space of a run stands apart if something follows.
    start |= (run == 4) & (after != 4) & (after != 0)
    # Contractions: no break inside, one behind.
    closed = state == S_CLOSED
    half = (state == S_HALF_E) | (state == S_HALF_L)
    start &= ~closed
    start &= ~(half & (after_state == S_CLOSED))
    start |= (before_state == S_CLOSED) & (run != 0)
    return start


def pieces(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined (each closed by a mark), the first and end positions of all pieces in codepoints,
    and for each text the number of pieces before its end."""
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes()[code]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds[ends] = END
    start = starts(kinds)
    start[ends] = True  # closes the last piece of each text
    at = np.flatnonzero(start)
    closing = np.searchsorted(at, ends)
    keep = np.ones(len(at), bool)
    keep[closing] = False
    first = at[keep]
    end = np.append(at[1:], len(code))[keep]
    return joined, first, end, closing - np.arange(len(texts))
