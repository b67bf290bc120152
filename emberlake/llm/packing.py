"""Packing of token sequences by best-fit decreasing.

A document is the ids of its whole text followed by one end id. Documents longer than a
window are first cut into full windows; what remains of them, and all shorter documents,
are placed in falling order of length, each into the open window with the least room that
holds it. A segment tree over the room that windows have left finds that window.

Nothing is shuffled: every partition packs what it reads, in blocks of about ``BLOCK``
tokens, so memory is bounded by a block and the longest document. Windows of a block that
best fit leaves unfilled are closed by cutting: the emptiest ones are taken apart and fill
the gaps of the fullest. At most one window of a block stays open; its pieces are packed
again with the next block. The last one of a partition is cut into sequences whose lengths
are powers of two, which need no padding.

Ids come from the ``tokenizers`` library. Texts are cut before a space, tab or line end
that follows a character which surely is no white space, and between a letter and ASCII
punctuation or a digit; no match of the tokenizer's pattern spans such a place, so the
parts have the ids of the whole, and parts met before are remembered. A part that is one
word, with or without a space before it, goes straight to the library's merge model.

Null and empty texts are the end id alone; repeated rows are packed each; an empty table
gives an empty result; a null id stays null. Other columns are not read.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlake.llm.common import small_batches

WINDOW, END = 2048, 1
#: Tokens packed together, parts of texts a task remembers, and the characters of the longest of them.
BLOCK, REMEMBERED, REMEMBERED_LETTERS = 1 << 22, 1 << 19, 64

LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Characters that some definition counts as white space beside space, tab and line ends.
ODD = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
PLAIN = re.compile(f"[ \t\n\r]*[{LETTERS}]++(?=[\t\n\r -@\\[-`{{-~]|\\Z)|[ \t\n\r]+[^ \t\n\r]*|[^ \t\n\r]+")
HAS_ODD = re.compile(f"[{ODD}]")
CUT = re.compile(f"(?<=[^ \t\n\r{ODD}])(?=[ \t\n\r])")
WORD = re.compile(f" ?[{LETTERS}]+")


def parts_of(text: str) -> list[str]:
    """Parts of a text that may be encoded one by one."""
    return CUT.split(text) if HAS_ODD.search(text) else PLAIN.findall(text)


def byte_letters() -> dict[int, str]:
    """How the tokenizer's alphabet writes a space and the letters of ``LETTERS`` outside ASCII: one sign for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = dict(zip(kept, map(chr, kept))) | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in kept)}
    return {c: "".join(signs[b] for b in chr(c).encode()) for c in [32, *range(0xC0, 0x100)]}


class Encoder(dict):
    """Ids of whole texts as little-endian 32-bit integers; as a dictionary, the ids of parts met before."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.signs = self.tokenizer.model, byte_letters()
        self.space = self.signs[32]

    def __missing__(self, part: str) -> bytes:
        if WORD.fullmatch(part):
            signs = part.translate(self.signs) if not part.isascii() else self.space + part[1:] if part[0] == " " else part
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(signs)])
        else:
            ids = b"".join([n.to_bytes(4, "little") for n in self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids])
        if len(part) <= REMEMBERED_LETTERS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, parts_of(text)))


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process, so that tasks after the first find most words known."""
    return Encoder(path)


class Windows:
    """Open windows by the room they have left."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves < window + 1:
            self.leaves *= 2
        self.tree = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, number: int, room: int) -> None:
        if not self.open[room]:
            at = room + self.leaves
            while at and not self.tree[at]:
                self.tree[at] = 1
                at //= 2
        self.open[room].append(number)

    def take(self, room: int) -> int:
        number = self.open[room].pop()
        if not self.open[room]:
            at = room + self.leaves
            self.tree[at] = 0
            at //= 2
            while at and not (self.tree[2 * at] or self.tree[2 * at + 1]):
                self.tree[at] = 0
                at //= 2
        return number

    def tightest(self, length: int) -> int | None:
        """Least room of an open window that is ``length`` or more."""
        at = length + self.leaves
        if self.tree[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(lengths: list[int], window: int) -> tuple[list[list[int]], list[int]]:
    """Windows as lists of item numbers, and the room each has left; items go in falling order of length."""
    windows, rooms, open_ = [], [], Windows(window)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = open_.tightest(lengths[item])
        if room is None:
            number, room = len(windows), window
            windows.append([])
            rooms.append(0)
        else:
            number = open_.take(room)
        windows[number].append(item)
        rooms[number] = room - lengths[item]
        if rooms[number]:
            open_.put(number, rooms[number])
    return windows, rooms


#: A piece: (row, start in its document, ids, tokens of the document).
Piece = tuple[object, int, bytes, int]


def tokens(piece: Piece) -> int:
    return len(piece[2]) // 4


def cut(piece: Piece, length: int) -> tuple[Piece, Piece]:
    """The first ``length`` tokens of a piece, and the rest."""
    row, start, ids, whole = piece
    return (row, start, ids[: 4 * length], whole), (row, start + length, ids[4 * length :], whole)


def closed(pieces: list[Piece], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces of the one that may be left over."""
    windows, rooms = best_fit([tokens(p) for p in pieces], window)
    full = [[pieces[i] for i in w] for w, room in zip(windows, rooms) if not room]
    gaps = sorted((room, n) for n, room in enumerate(rooms) if room)
    loose: list[Piece] = []
    while gaps:
        room, n = gaps.pop(0)
        filled = [pieces[i] for i in windows[n]]
        while room and (loose or gaps):
            if not loose:
                loose = [pieces[i] for i in windows[gaps.pop()[1]]]
            piece = loose.pop()
            if tokens(piece) > room:
                piece, rest = cut(piece, room)
                loose.append(rest)
            filled.append(piece)
            room -= tokens(piece)
        if room:
            return full, filled
        full.append(filled)
    # What a taken-apart window has left over always fits one window.
    return full, loose


def binary(pieces: list[Piece], window: int) -> Iterator[list[Piece]]:
    """Sequences of the pieces with lengths that are powers of two, the longest first."""
    left, rest = sum(map(tokens, pieces)), list(pieces)
    while left:
        room = min(window, 1 << (left.bit_length() - 1))
        left -= room
        filled = []
        while room:
            piece = rest.pop(0)
            if tokens(piece) > room:
                piece, more = cut(piece, room)
                rest.insert(0, more)
            filled.append(piece)
            room -= tokens(piece)
        yield filled


def sequences(documents: Iterator[tuple[object, bytes]], window: int, block: int) -> Iterator[list[Piece]]:
    """Sequences of the documents (row, ids)."""
    held, size = [], 0
    for row, ids in documents:
        rest = (row, 0, ids, len(ids) // 4)
        while tokens(rest) > window:
            # A memory view, so that a very long document is not copied once per window.
            piece, rest = cut((rest[0], rest[1], memoryview(rest[2]), rest[3]), window)
            yield [(piece[0], piece[1], bytes(piece[2]), piece[3])]
        held.append((rest[0], rest[1], bytes(rest[2]), rest[3]))
        size += tokens(rest)
        if size >= block:
            full, held = closed(held, window)
            yield from full
            size = sum(map(tokens, held))
    full, held = closed(held, window)
    yield from full
    yield from binary(held, window)


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed(
    df: DataFrame, path: str, window: int = WINDOW, end: int = END, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece.

    ``path`` names the tokenizer's file, which every executor must have. ids are
    little-endian 32-bit integers. A sequence's number holds the partition that packed it.
    """
    small_batches(df.sparkSession)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    last = end.to_bytes(4, "little")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, first = encoder_of(path), TaskContext.get().partitionId() << 33

        def documents():
            for frame in frames:
                for row, text in zip(frame["_id"], frame["_text"]):
                    yield row, encoder.encode(text) + last

        rows, room = [], 0
        for number, pieces in enumerate(sequences(documents(), window, block)):
            offset = 0
            for row, start, ids, whole in pieces:
                rows.append((row, start, len(ids) // 4, ids, whole, first + number, offset))
                offset += len(ids) // 4
            room += 4 * offset
            if room >= 8 << 20:
                yield pd.DataFrame(rows, columns=["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])
                rows, room = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    # Ids travel as text: pandas would turn integers with nulls among them into doubles.
    ids = df.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return ids.mapInPandas(pack, f"doc_id string, {SCHEMA}").withColumn("doc_id", F.col("doc_id").cast(kind))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op12_packing": op12_packing}
