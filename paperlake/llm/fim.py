"""Fill-in-middle examples as piece tables.

A text is cut into prefix, middle and suffix and given out in another order between sentinels. No text is put together
for that: a document becomes descriptors (buffer, start, length) over two immutable buffers, the text's own bytes and the
sentinels. A cut splits a descriptor in two, an arrangement permutes descriptors and puts those of sentinels between them, the
inverse permutation restores the text, and digests take in descriptor after descriptor. ``render`` writes the bytes out
for those who want them.

Every document is worked on where it is read; nothing is shuffled. Choices depend on the document's id alone, so a task that
is repeated gives the same examples.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.frames import map_texts

PREFIX, SUFFIX, MIDDLE = SENTINELS = (b"<P>", b"<S>", b"<M>")
MARKS = b"".join(SENTINELS)
TEXT, MARK = 0, 1
#: Hundredths of documents that stay plain, and of the others that are given out suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = "1"


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


_MARK_OF = {mark: Piece(MARK, k * 3, 3) for k, mark in enumerate(SENTINELS)}
#: Order of the text's three pieces and of the sentinels before them.
ARRANGEMENTS: dict[str, tuple[tuple[bytes, int], ...]] = {
    "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
    "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
}


def split(pieces: list[Piece], at: int) -> list[Piece]:
    """The pieces with a cut at byte ``at`` of what they say; a cut at an edge leaves an empty piece on one side."""
    out, before = [], 0
    for k, piece in enumerate(pieces):
        if at <= before + piece.length:
            here = at - before
            return [*out, piece._replace(length=here), Piece(piece.buffer, piece.start + here, piece.length - here), *pieces[k + 1 :]]
        out.append(piece)
        before += piece.length
    raise ValueError("a cut behind the end")


def arranged(pieces: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix in the order of ``form``, each behind its sentinel."""
    return [p for mark, k in ARRANGEMENTS[form] for p in (_MARK_OF[mark], pieces[k])]


def restored(pieces: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix out of an output's pieces, by the inverse permutation."""
    if form == "plain":
        return pieces
    own = [p for p in pieces if p.buffer != MARK]
    back = sorted(range(len(own)), key=lambda k: ARRANGEMENTS[form][k][1])
    return [own[k] for k in back]


def parsed(output: bytes, form: str) -> list[Piece]:
    """Pieces of an output that came as bytes: its sentinels are found, all else is text over ``output`` itself."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    found, at = [], 0
    order = [mark for mark, _ in ARRANGEMENTS[form]]
    for k, mark in enumerate(order):
        if output[at : at + 3] != mark:
            raise ValueError(f"no {form} output")
        stop = output.find(order[k + 1], at + 3) if k + 1 < len(order) else len(output)
        if stop < 0:
            raise ValueError(f"no {form} output")
        found += [_MARK_OF[mark], Piece(TEXT, at + 3, stop - at - 3)]
        at = stop
    return found


def said(pieces: list[Piece], text: bytes) -> bytes:
    """The bytes that pieces stand for."""
    buffers = (text, MARKS)
    return b"".join([buffers[b][s : s + n] for b, s, n in pieces])


def digest(pieces: list[Piece], text: bytes) -> str:
    """SHA-256 of what the pieces stand for, taken in piece by piece."""
    buffers, state = (memoryview(text), MARKS), hashlib.sha256()
    for b, s, n in pieces:
        state.update(buffers[b][s : s + n])
    return state.hexdigest()


class Cuts:
    """Where code points of a text begin."""

    def __init__(self, text: bytes) -> None:
        self.starts = None if text.isascii() else np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        self.bytes = len(text)
        self.count = self.bytes if self.starts is None else len(self.starts)

    def byte(self, character: int) -> int:
        if self.starts is None or character >= self.count:
            return min(character, self.count) if self.starts is None else self.bytes
        return int(self.starts[character])


def choices(doc_id: str) -> tuple[int, ...]:
    """Four numbers from a document's id."""
    found = hashlib.sha256(f"{SEED}:{doc_id}".encode()).hexdigest()
    return tuple(int(found[8 * k : 8 * k + 8], 16) for k in range(4))


def example(text: bytes, doc_id: str) -> tuple[int, str, int | None, int | None, list[Piece]]:
    """Characters, form, characters of prefix and middle (none if plain) and the output's pieces of a document."""
    cuts = Cuts(text)
    a, b, plain, first = choices(doc_id)
    whole = [Piece(TEXT, 0, len(text))]
    if not text or plain % 100 >= 100 - PLAIN or any(mark in text for mark in SENTINELS):
        return cuts.count, "plain", None, None, whole
    low, high = sorted((a % (cuts.count + 1), b % (cuts.count + 1)))
    form = "spm" if first % 100 < SUFFIX_FIRST else "psm"
    three = split(split(whole, cuts.byte(low)), cuts.byte(high))
    return cuts.count, form, low, high - low, arranged(three, form)


PIECES = "array<struct<buffer:int,start:bigint,length:bigint>>"
KINDS = (
    pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
    pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])),
)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``found``: n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, pieces.

    ``restored_sha256`` is that of the text rebuilt from the output's pieces and the form. Null texts count as empty ones, which
    stay plain; a null doc_id counts as the empty text. Repeated rows give repeated rows, an empty table none.
    """

    def function(texts: list[bytes], ids: list) -> list[pa.Array]:
        out: list[list] = [[] for _ in KINDS]
        for text, doc_id in zip(texts, ids, strict=True):
            n, form, prefix, middle, pieces = example(text, "" if doc_id is None else str(doc_id))
            values = (n, form, prefix, middle, digest(pieces, text), digest(restored(pieces, form), text), [p._asdict() for p in pieces])
            for column, value in zip(out, values, strict=True):
                column.append(value)
        return [pa.array(column, kind) for column, kind in zip(out, KINDS, strict=True)]

    fields = f"n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, pieces {PIECES}"
    return map_texts(docs, fields, function, beside="doc_id")


def render(text: Column, pieces: Column) -> Column:
    """The output itself, from a document's text and its pieces; null texts count as empty ones."""
    own, marks = F.coalesce(text, F.lit("")).cast("binary"), F.lit(MARKS.decode()).cast("binary")

    def bytes_of(p: Column) -> Column:
        whole = F.when(p["buffer"] == MARK, marks).otherwise(own)
        return F.substring(whole, (p["start"] + 1).cast("int"), p["length"].cast("int"))

    return F.aggregate(F.transform(pieces, bytes_of), F.lit("").cast("binary"), lambda said, more: F.concat(said, more)).cast("string")
