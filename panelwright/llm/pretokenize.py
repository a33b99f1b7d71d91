"""Pre-token boundaries without a regex.

Code points are mapped to classes by one table; two characters of lookahead refine the classes of
apostrophes and of the last white space before a word. What is left is an eight-state automaton.
Each class is a function from state to state, functions compose associatively, and the few
functions that can arise are numbered with a composition table. So the state before every character
comes from a blocked parallel scan over small integers, and a boundary is a lookup by (state, class).

The boundaries are those of the pattern of public_tokenizers.PATTERN. Which code points are letters and numbers
depends on a Unicode version, so the class table is asked of the tokenizer library itself, once on the driver
(`unicode_classes`), and sent to the workers: neither the worker's Python nor its Unicode data enters a result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np

from panelwright.llm.common import chunks
from panelwright.llm.slices import PADDING, SliceCodes

LETTER, NUMBER, OTHER, SPACE_RUN, SPACE_LAST, WHITE_LAST, SHORT_FORM, LONG_FORM, END = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, GLUE, IN_SPACES, ONE_MORE, TWO_MORE = range(8)

#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters that form a token with an apostrophe before them.
SHORT_FORMS = "stmd"
LONG_FORMS = ("re", "ve", "ll")

BLOCK = 64


def _step(state: int, kind: int) -> tuple[int, bool]:
    """(next state, whether a token starts at this character)."""
    if kind == END:
        return FRESH, True
    if kind == LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, GLUE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, GLUE)
    if kind == OTHER or (kind in (SHORT_FORM, LONG_FORM) and state in (IN_OTHERS, GLUE)):
        return IN_OTHERS, state not in (IN_OTHERS, GLUE)
    if kind == SHORT_FORM:
        return ONE_MORE, True
    if kind == LONG_FORM:
        return TWO_MORE, True
    if kind == SPACE_RUN:
        return IN_SPACES, state != IN_SPACES
    return (GLUE if kind == SPACE_LAST else FRESH), True


@functools.cache
def unicode_classes() -> bytes:
    """The class of every code point by the tokenizer library's Unicode version, compressed to some kilobytes."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single_bytes = {bytes([b]): b for b in range(256)}
    kinds = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single_bytes, special_tokens={})
        found = probe.decode_bytes(probe.encode_ordinary(every)).decode()  # what doesn't match is left out
        kinds[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    kinds[WHITE_SPACE] = SPACE_RUN
    return zlib.compress(kinds.tobytes(), 9)


@functools.cache
def _classes(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


@functools.cache
def _tables():
    """The functions of the classes, their composition, action and the boundary tables."""
    identity = tuple(range(8))
    generators = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    numbers = {identity: 0}
    todo = [identity]
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[f[s]] for s in range(8))
            if h not in numbers:
                numbers[h] = len(numbers)
                todo.append(h)
    functions = list(numbers)
    assert len(functions) <= 16, "a composition must fit the packed table"
    compose = np.array([[numbers[tuple(g[f[s]] for s in range(8))] for g in functions] for f in functions], np.uint8)
    by_kind = bytes(numbers[g] for g in generators).ljust(256, b"\0")
    state = bytes(f[FRESH] for f in functions).ljust(256, b"\0")
    boundary = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)], np.uint8)
    return by_kind, _packed(compose), state, _packed(boundary)


def _packed(table: np.ndarray) -> bytes:
    """A table of at most 16 columns as a 256-byte map from row << 4 | column."""
    out = np.zeros((16, 16), np.uint8)
    out[: table.shape[0], : table.shape[1]] = table
    return out.tobytes()


def _look(packed: bytes, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    at = np.left_shift(rows, 4)
    at = np.bitwise_or(at, columns)
    return np.frombuffer(at.tobytes().translate(packed), np.uint8).reshape(at.shape)


def _scan(x: np.ndarray, compose: bytes) -> np.ndarray:
    """Exclusive prefix compositions of the functions x: blocks in lockstep, then the blocks' totals."""
    n = len(x)
    if n <= BLOCK:
        out, f = np.zeros(n, np.uint8), 0
        for i in range(n):
            out[i] = f
            f = compose[f << 4 | int(x[i])]
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = x
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    before = np.zeros_like(grid)
    for j in range(1, BLOCK):
        before[j] = _look(compose, before[j - 1], grid[j - 1])
    totals = _look(compose, before[-1], grid[-1])
    full = _look(compose, _scan(totals, compose)[None, :], before)
    return full.T.ravel()[:n]


def starts(codes: np.ndarray, ends: np.ndarray, classes: bytes) -> np.ndarray:
    """Positions at which a pre-token starts; ends: positions of the separators, which count as starts."""
    by_kind, compose, state, boundary = _tables()
    kinds = _classes(classes).take(codes)
    white = kinds == SPACE_RUN
    kinds[ends] = END
    white[ends] = True
    last = np.zeros(len(codes), bool)
    last[:-1] = white[:-1] & ~white[1:]
    last[ends] = False
    at = np.flatnonzero(last)
    kinds[at] = np.where(codes[at] == 0x20, SPACE_LAST, WHITE_LAST)
    marks = np.flatnonzero(codes == 0x27)
    if len(marks):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        is_mark = kinds[marks] == OTHER
        kinds[marks[is_mark & np.isin(one, [ord(c) for c in SHORT_FORMS])]] = SHORT_FORM
        for a, b in LONG_FORMS:
            kinds[marks[is_mark & (one == ord(a)) & (two == ord(b))]] = LONG_FORM
    functions = _scan(np.frombuffer(kinds.tobytes().translate(by_kind), np.uint8), compose)
    states = np.frombuffer(functions.tobytes().translate(state), np.uint8)
    return np.flatnonzero(_look(boundary, states, kinds))


def runs(texts: list[str], classes: bytes, most_chars: int = 1 << 19) -> Iterator[tuple[bytes, np.ndarray, list[int]]]:
    """(data, cuts, ends) of runs of texts of about most_chars that are scanned together.

    data is the run's UTF-8 bytes and padding; pre-token i is its bytes cuts[i] to cuts[i + 1]; ends are the numbers of
    the separators, one after each text.
    """
    for lo, hi in chunks(texts, most_chars):
        part = texts[lo:hi]
        joined = "\n".join(part) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in part]) - 1
        at = starts(codes, ends, classes)
        numbers = np.searchsorted(at, ends).tolist()
        data = joined.encode("utf-8", "surrogatepass")
        if len(data) > len(codes):
            width = np.ones(len(codes), np.int64)
            for least in (0x80, 0x800, 0x10000):
                width += codes >= least
            at = (np.cumsum(width) - width)[at]
        yield data + b"\0" * PADDING, np.append(at, len(data)), numbers


def pretokens(texts: list[str], most_chars: int = 1 << 19, classes: bytes | None = None) -> Iterator[list[str]]:
    """The pre-tokens of each text, in order."""
    for data, cuts, ends in runs(texts, classes or unicode_classes(), most_chars):
        places = cuts.tolist()
        pieces = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(places, places[1:])]
        first = 0
        for end in ends:
            yield pieces[first:end]
            first = end + 1


def coded(texts: list[str], classes: bytes, slices: SliceCodes) -> Iterator[np.ndarray]:
    """The codes of each text's pre-tokens, as unsigned 32-bit integers."""
    for data, cuts, ends in runs(texts, classes):
        codes, counts = slices.codes(data, cuts[:-1], cuts[1:])
        upto = np.append(0, np.cumsum(counts)).tolist()
        first = 0
        for end in ends:
            yield codes[upto[first] : upto[end]]
            first = end + 1
