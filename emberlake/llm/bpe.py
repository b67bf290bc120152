"""Byte-level BPE encoding and decoding over whole texts.

Texts of a batch become one array of code points. Each code point has a class; classes are
refined by what follows (the last white space of a run, an apostrophe before a clitic), and
every class is a transition function of a small automaton. Such functions compose
associatively, so their prefix compositions give the state before every code point: blocks
are composed first, then the blocks, then each block is entered with its own state. A code
point starts a piece where its (state, class) entry says so; no pattern is matched.

Each piece is merged pair by pair, lowest rank first, with a bounded cache in front. Long
pieces use a heap, so a piece of any length costs n log n. Encoding keeps the end offset of
every token in the text's bytes; decoding gathers token bytes by id and returns the exact
bytes.

Null and empty texts have no tokens and decode to no bytes. Ids and repeated rows pass
through; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import small_batches

#: Classes of code points and of code points in context.
LETTER, NUMBER, OTHER, SPACE, BLANK, LAST_SPACE, LAST_BLANK, CLITIC1, CLITIC2, EDGE = range(10)
#: States: a new piece must begin; in a run of letters, numbers, others; one space that joins
#: what follows; in a run of white space; one or two letters of a clitic still to come.
NEW, IN_L, IN_N, IN_O, JOIN, IN_W, ONE, TWO = range(8)
STATES = 8
BLOCK = 64
#: Entries of the piece cache of one worker; it starts afresh when full.
CACHED = 200_000
#: Pieces up to this many bytes merge side by side in arrays, longer ones each through a heap.
SIDE_BY_SIDE = 48
#: Above every id; a rank above every rank.
BASE, NONE = 1 << 24, np.iinfo(np.int32).max

# The code points of Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def code_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[WHITE] = BLANK
    out[0x20] = SPACE
    return out


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state by (class, state) and whether a piece starts there."""
    go = np.zeros((10, STATES), np.uint8)
    cut = np.ones((10, STATES), bool)
    for kind, run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
        go[kind] = run
        cut[kind, [run, JOIN]] = False
    # Inside a clitic the letters belong to it and the piece ends after the last one.
    go[LETTER, [ONE, TWO]] = [NEW, ONE]
    cut[LETTER, [ONE, TWO]] = False
    for kind in (SPACE, BLANK):  # inside a run of white space
        go[kind] = IN_W
        cut[kind, IN_W] = False
    go[LAST_SPACE] = JOIN
    go[LAST_BLANK] = NEW
    for kind, clitic in ((CLITIC1, ONE), (CLITIC2, TWO)):  # only where a run of others would begin
        go[kind] = clitic
        go[kind, [IN_O, JOIN]] = IN_O
        cut[kind, [IN_O, JOIN]] = False
    go[EDGE] = NEW
    return go, cut


def contextual(points: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Classes refined by what follows inside the same text; ``last`` marks each text's last code point."""
    kind = code_classes()[points]
    white = (kind == SPACE) | (kind == BLANK)
    before_solid = np.zeros(len(kind), bool)
    before_solid[:-1] = white[:-1] & ~white[1:]
    before_solid &= ~last
    kind = np.where(before_solid, kind + np.uint8(LAST_SPACE - SPACE), kind)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        end1 = last[at]
        end2 = end1 | last[np.minimum(at + 1, len(last) - 1)]
        single = ~end1 & np.isin(one, [ord(c) for c in "sdmt"])
        double = ~end2 & (((one == ord("l")) & (two == ord("l"))) | (((one == ord("v")) | (one == ord("r"))) & (two == ord("e"))))
        kind[at[single]] = CLITIC1
        kind[at[double]] = CLITIC2
    return kind


def states_before(kind: np.ndarray) -> np.ndarray:
    """State before each element, by composing transition functions in blocks."""
    go, _ = automaton()
    n = len(kind)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, EDGE, np.uint8)
    padded[:n] = kind
    grid = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    flat = go.ravel()
    whole = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    for column in grid:
        whole = flat[column[:, None].astype(np.intp) * STATES + whole]
    # Blocks compose the same way: each doubling joins a prefix with the one before it.
    prefix, step = whole, 1
    while step < rows:
        joined = prefix.copy()
        joined[step:] = np.take_along_axis(prefix[step:], prefix[:-step], axis=1)
        prefix, step = joined, step * 2
    state = np.concatenate([[NEW], prefix[:-1, NEW]]).astype(np.uint8) if rows else np.zeros(0, np.uint8)
    out = np.empty((BLOCK, rows), np.uint8)
    for i, column in enumerate(grid):
        out[i] = state
        state = flat[column.astype(np.intp) * STATES + state]
    return out.T.reshape(-1)[:n]


def pieces(texts: list[str]) -> Iterator[list[str]]:
    """The pieces of each text, in order; together they are the text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    last = np.zeros(len(points), bool)
    ends = np.cumsum(lengths)
    last[ends[lengths > 0] - 1] = True
    kind = contextual(points, last)
    first = np.zeros(len(points), bool)
    first[(ends - lengths)[lengths > 0]] = True
    # A text begins in the state NEW whatever stood before it: its first code point always cuts,
    # and the function of an edge is composed into it.
    starts = np.flatnonzero(_cuts(kind, first))
    bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
    at = np.append(starts, len(points)).tolist()
    for i in range(len(texts)):
        lo, hi = bounds[i], bounds[i + 1]
        yield [joined[a:b] for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1])]


def _cuts(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start. An edge is put before the first code point of every text."""
    _, cut = automaton()
    at = np.flatnonzero(first)
    spread = np.insert(kind, at, EDGE)
    states = np.delete(states_before(spread), at + np.arange(len(at)))
    return cut[kind, states]


class Ranks:
    """Merge ranks of a vocabulary file, with a bounded cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.cached: dict[str, bytes] = {}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * BASE + right] = rank
        # Open addressing over all pairs that merge.
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        for key, slot in zip(pairs, self._slots(np.array(list(pairs), np.int64)).tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = key, pairs[key]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair of ids, ``NONE`` where the two don't merge."""
        keys = (left * BASE + right).ravel()
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out.reshape(left.shape)

    def merge_equal(self, raw: list[bytes]) -> list[bytes]:
        """Ids of pieces of one length, all merged side by side, one pair of each per step."""
        n, width = len(raw), len(raw[0])
        ids = self.single[np.frombuffer(b"".join(raw), np.uint8)].reshape(n, width)
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while True:
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                flat, each = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, row in enumerate(rows[done].tolist()):
                    out[row] = flat[k * each : (k + 1) * each]
                rows, ids, ranks, best, low = rows[~done], ids[~done], ranks[~done], best[~done], low[~done]
            if not len(rows):
                return out
            every, m = np.arange(len(rows)), ids.shape[1]
            keep = np.arange(m - 1) + (np.arange(m - 1) > best[:, None])
            ids = np.take_along_axis(ids, keep, 1)
            ids[every, best] = low
            at = np.arange(m - 2)
            ranks = np.take_along_axis(ranks, np.minimum(at + (at >= best[:, None]), m - 2), 1)
            has = best > 0
            ranks[every[has], best[has] - 1] = self.pair_ranks(ids[every[has], best[has] - 1], ids[every[has], best[has]])
            has = best < m - 2
            ranks[every[has], best[has]] = self.pair_ranks(ids[every[has], best[has]], ids[every[has], best[has] + 1])

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't cached."""
        out, by_length = {}, {}
        for piece in new:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > SIDE_BY_SIDE:
                out[piece] = np.array([self.ranks[p] for p in _heap(raw, self.ranks)], "<u4").tobytes()
            else:
                by_length.setdefault(len(raw), ([], []))[0].append(piece)
                by_length[len(raw)][1].append(raw)
        for names, raw in by_length.values():
            out.update(zip(names, self.merge_equal(raw)))
        return out

    def encode(self, batch: list[list[str]]) -> list[bytes]:
        """Ids of each text, given as its pieces, as little-endian unsigned 32-bit integers."""
        if len(self.cached) >= CACHED:
            self.cached.clear()
        new = set().union(*batch).difference(self.cached)
        learnt = self.learn(new)
        long = {p: ids for p, ids in learnt.items() if len(p) > SIDE_BY_SIDE}
        self.cached.update(learnt)
        get = self.cached.__getitem__
        out = [b"".join(map(get, text)) for text in batch]
        for piece in long:  # rare and large: not kept
            del self.cached[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> list[int]:
        """End of every token in the bytes of the text."""
        return np.cumsum([len(self.tokens[i]) for i in np.frombuffer(ids, "<u4")], dtype=np.int64).tolist()


def _heap(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Same merges for long pieces: a heap of candidate pairs over a linked list of parts."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts at i, 0 when merged away
    before = list(range(-1, n - 1))

    def rank(i: int) -> int | None:
        j = end[i]
        return ranks.get(piece[i : end[j]]) if j < n else None

    heap = [(r, i, end[end[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[end[k]]))
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = end[i]
    return out


@cache
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def _batches(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, token_ends): ids of every text and where each token ends in its UTF-8 bytes.

    ``ids`` is binary, unsigned 32-bit little-endian; ``token_ends`` is left out on request.
    The rank file at ``path`` must be readable on every executor.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary" + ", token_ends array<long>" * offsets

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = ranks_of(path)
        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"]]
            ids = [x for batch in _batches(texts) for x in vocabulary.encode(list(pieces(batch)))]
            out = {"doc_id": frame["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids}
            if offsets:
                out["token_ends"] = [vocabulary.offsets(x) for x in ids]
            yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the exact bytes of every text as ``decoded``."""
    @F.pandas_udf("binary")
    def bytes_of(ids: pd.Series) -> pd.Series:
        vocabulary = ranks_of(path)
        return ids.map(vocabulary.decode)

    return encoded.withColumn("decoded", bytes_of("ids"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per text: token count and digests of its ids and of the bytes decoded from them."""
    return decode(encode(docs, path, offsets=False), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op8_bpe": op8_bpe}
