"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The texts of a chunk are laid end to end as one array of code points, each mapped to a class
(letter, number, space, other white space, other, apostrophe before a contraction, end of text). A
class is a transition function over the states of a small automaton; the functions that classes can
compose to form a finite monoid, so a prefix scan over its multiplication table, which is
associative and therefore done block-wise, gives the state before each code point, and state and
class tell where a piece begins. No regular expression runs. Slices between boundaries are merged by
rank once and cached; byte offsets of tokens are kept, so a span of tokens decodes to its bytes.

Defined cases: a null text encodes as an empty one (no ids, the hash of nothing); null doc_ids and
repeated rows are rows like others; an empty table gives no rows; further columns are ignored; a
text of any length is encoded whole (a piece without boundaries is merged with a heap in
O(n log n)). Letters and numbers are those of Python's Unicode tables.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents

CHUNK_CHARS = 500_000
"""Texts are laid end to end up to so many code points; a longer text is a chunk of its own."""
CACHE_PIECES = 200_000
CACHE_CHARS = 64
"""The cache is emptied beyond so many pieces; longer pieces are not kept from chunk to chunk."""

# Classes of code points.
LETTER, NUMBER, SPACE, WHITE, OTHER, SHORT, LONG, END = range(8)
# States: nothing open; in a run of a class; one or two letters of a contraction still to come; a contraction done.
_OPEN, _L, _N, _P, _W, _O, _C1, _C2, _DONE = range(9)

# The contractions of the pattern and the code points of Unicode's White_Space.
_ONE_LETTER = "stmd"
_TWO_LETTERS = ("re", "ve", "ll")
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, kind: int) -> int:
    if kind == END:
        return _OPEN
    if kind == LETTER:
        return {_C2: _C1, _C1: _DONE}.get(state, _L)
    if kind in (SHORT, LONG) and state not in (_O, _P):
        return _C1 if kind == SHORT else _C2
    return {NUMBER: _N, SPACE: _P, WHITE: _W}.get(kind, _O)


#: A piece begins where the state before is none of these (for spaces: or a non-space follows).
_CONTINUES = {LETTER: (_L, _P, _C1, _C2), NUMBER: (_N, _P), SPACE: (_P, _W), WHITE: (_P, _W), OTHER: (_O, _P), SHORT: (_O, _P), LONG: (_O, _P), END: ()}


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, multiplication table, state that an element takes _OPEN to)."""
    generators = [tuple(_step(s, k) for s in range(9)) for k in range(8)]
    elements = list(dict.fromkeys([tuple(range(9)), *generators]))
    index = {e: i for i, e in enumerate(elements)}
    at = 0
    while at < len(elements):  # closure
        for g in generators:
            made = tuple(g[s] for s in elements[at])
            if made not in index:
                index[made] = len(elements)
                elements.append(made)
        at += 1
    times = np.array([[index[tuple(b[s] for s in a)] for b in elements] for a in elements], np.uint8)
    assert len(elements) < 256
    return np.array([index[g] for g in generators], np.uint8), times, np.array([e[_OPEN] for e in elements], np.uint8)


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(cp))[0])
        if kind is not None:
            table[cp] = kind
    table[_WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    return table


def scan(elements: np.ndarray, times: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive prefix products: blocks side by side, then the blocks' products, then both together."""
    n = len(elements)
    if n <= width:
        out = elements.copy()
        for i in range(1, n):
            out[i] = times[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint8)  # element 0 is the identity
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for i in range(1, width):
        grid[i] = times[grid[i - 1], grid[i]]
    before = scan(grid[-1], times, width)
    grid[:, 1:] = times[before[None, :-1], grid[:, 1:]]
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points; ``ends`` are the places that stand between texts, which
    count as pieces of their own."""
    kinds = _classes()[points]
    kinds[ends] = END
    quote = np.flatnonzero(points[:-2] == 0x27) if len(points) > 2 else np.zeros(0, int)
    if len(quote):
        first, second = points[quote + 1], points[quote + 2]
        inside = kinds[quote + 1] != END
        one = inside & np.isin(first, [ord(c) for c in _ONE_LETTER])
        two = inside & (kinds[quote + 2] != END) & functools.reduce(np.logical_or, [(first == ord(a)) & (second == ord(b)) for a, b in _TWO_LETTERS])
        kinds[quote[one]] = SHORT
        kinds[quote[two]] = LONG
    of_class, times, acts = _monoid()
    state = np.empty(len(points), np.uint8)
    state[0] = _OPEN
    state[1:] = acts[scan(of_class[kinds[:-1]], times)]
    begins = np.ones((8, 9), bool)
    for kind, states in _CONTINUES.items():
        begins[kind, list(states)] = False
    start = begins[kinds, state]
    white = (kinds == SPACE) | (kinds == WHITE)
    follows = np.zeros(len(points), bool)
    follows[:-1] = ~white[1:] & (kinds[1:] != END)
    return np.flatnonzero(start | (white & follows))


class Codec:
    """A vocabulary's encoder and decoder, with its cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.names = {i: str(i) for i in self.tokens}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Joins the neighbours of lowest rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or after[j] != end:
                continue  # one of the two was joined meanwhile
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text of one chunk."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = boundaries(points, ends)
        seps = np.searchsorted(starts, ends).tolist()
        at = starts.tolist()
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        low = 0
        for sep in seps:
            pieces = [joined[a:b] for a, b in zip(at[low:sep], at[low + 1 : sep + 1], strict=True)]
            low = sep + 1
            for p in set(pieces).difference(cache):
                cache[p] = self.merge(p.encode())
            ids = list(chain.from_iterable(map(cache.__getitem__, pieces)))
            for p in {p for p in pieces if len(p) > CACHE_CHARS}:
                del cache[p]
            yield ids

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offset of each token, and the length at the end."""
        return np.concatenate([[0], np.cumsum([len(self.tokens[i]) for i in ids])]).astype(np.int64).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker and vocabulary."""
    return Codec(path)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) in groups of up to CHUNK_CHARS."""
    group: list[str] = []
    size = first = 0
    for i, t in enumerate(texts):
        t = t or ""
        if group and size + len(t) > CHUNK_CHARS:
            yield first, group
            group, size, first = [], 0, i
        group.append(t)
        size += len(t) + 1
    if group:
        yield first, group


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids array<int>, offsets array<long> (byte offset of each token, then the length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for first, texts in chunks(batch.column(1).to_pylist()):
                ids = list(c.encode(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array([c.offsets(x) for x in ids], pa.list_(pa.int64()))],
                    ["doc_id", "ids", "offsets"],
                )

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids, exact (the ids decode to the text's bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for first, texts in chunks(batch.column(1).to_pylist()):
                ids = list(c.encode(texts))
                exact = [c.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(exact)], ["doc_id", "n_tokens", "ids", "exact"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, exact boolean")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, bytes of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids, and keeps digests of both,
    in one pass, so that ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        name = c.names.__getitem__
        for batch in batches:
            for first, texts in chunks(batch.column(1).to_pylist()):
                n, a, b = [], [], []
                for ids in c.encode(texts):
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
