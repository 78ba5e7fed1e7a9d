"""Words of whole texts as arrays: byte classes over Arrow buffers, words as numbers into a dictionary of their chunk."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD, GAP, BREAK = 0, 1, 2


def byte_classes(gaps: Iterable[int], breaks: Iterable[int] = ()) -> np.ndarray:
    """The class of each byte: what stands between words, what also ends a piece, and all others, which make words."""
    found = np.full(256, WORD, np.uint8)
    found[list(gaps)] = GAP
    found[list(breaks)] = BREAK
    return found


def lower_bytes() -> np.ndarray:
    """Each byte with A-Z lower-cased."""
    found = np.arange(256, dtype=np.uint8)
    found[65:91] += 32
    return found


@dataclass
class Words:
    """The words of some texts in order: their number in ``dictionary``, their text's place, and a number for each piece."""

    ids: np.ndarray
    dictionary: pa.Array
    text: np.ndarray
    piece: np.ndarray
    #: Place of the first word of each text, and the number of all words.
    starts: np.ndarray


def chunks(batches: Iterable[pa.RecordBatch], column: str, size: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, cut so that a chunk holds at most ``rows`` rows and ``size`` bytes of ``column``, or one row that is longer."""
    for batch in batches:
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > size or i - start == rows:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(lengths) > start:
            yield batch.slice(start)


def words(texts: pa.Array, classes: np.ndarray, lower: np.ndarray) -> Words:
    """Words of whole texts, null counting as empty. No word or piece reaches across two texts."""
    whole = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
    _, at, data = whole.buffers()
    offsets = np.frombuffer(at, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    read = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(whole) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(whole) else np.zeros(1, np.int64)
    kind = classes[read]
    inner = kind == WORD
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    begins = offsets[:-1][offsets[:-1] < len(read)]
    first[begins] = inner[begins]
    starts = np.flatnonzero(first)
    places = np.searchsorted(starts, offsets)
    held = np.append(np.cumsum(inner, dtype=np.int32)[starts] - 1 if len(read) < 1 << 31 else np.cumsum(inner)[starts] - 1, np.count_nonzero(inner)).astype(np.int64)
    letters = lower[read[inner]]
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(held), pa.py_buffer(letters)]).dictionary_encode()
    text = np.repeat(np.arange(len(whole), dtype=np.int64), np.diff(places))
    piece = (np.searchsorted(np.flatnonzero(kind == BREAK), starts) if len(starts) else np.zeros(0, np.int64)) + text
    return Words(flat.indices.to_numpy().astype(np.int64), flat.dictionary.cast(pa.large_string()), text, piece, places)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, every bit of which depends on all of ``h``'s."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
