"""Separator-aware recursive chunking (C1) as an Arrow-batched column function."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillvec import constants as const

# Pages of a batch that are cut before their chunks leave the task.
PAGES_AT_ONCE = 64


def _cut_before(text: str, mark: str) -> list[str]:
    """Pieces of `text`, each later piece opening with the separator."""
    head, *rest = text.split(mark)
    return [piece for piece in [head, *(mark + tail for tail in rest)] if piece]


def _slide(text: str, size: int, overlap: int) -> Iterator[str]:
    """Plain character windows, for text without any separator left."""
    start = 0
    while start + size < len(text):
        yield text[start : start + size]
        start += size - overlap
    yield text[start:]


def _pack(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to `size`; each chunk reopens with up to `overlap` of the one before."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            yield "".join(window)
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        yield "".join(window)


def _chunks(text: str, size: int, overlap: int, marks: Sequence[str]) -> Iterator[str]:
    level = next((i for i, mark in enumerate(marks) if mark == "" or mark in text), None)
    if level is None:
        yield text
        return
    if marks[level] == "":
        yield from _slide(text, size, overlap)
        return
    small: list[str] = []
    for piece in _cut_before(text, marks[level]):
        if len(piece) < size:
            small.append(piece)
            continue
        yield from _pack(small, size, overlap)
        small = []
        finer = marks[level + 1 :]
        if finer:
            yield from _chunks(piece, size, overlap, finer)
        else:
            yield piece
    yield from _pack(small, size, overlap)


def split_text(
    text: str,
    size: int = const.CHUNK_SIZE,
    overlap: int = const.CHUNK_OVERLAP,
    marks: Sequence[str] = tuple(const.CHUNK_SEPARATORS),
) -> list[str]:
    """Trimmed, non-empty chunks of one page."""
    trimmed = (chunk.strip() for chunk in _chunks(text, size, overlap, marks))
    return [chunk for chunk in trimmed if chunk]


def chunk_recursive(
    text: Column,
    size: int = const.CHUNK_SIZE,
    overlap: int = const.CHUNK_OVERLAP,
    marks: Sequence[str] = tuple(const.CHUNK_SEPARATORS),
) -> Column:
    """array<string> of chunks per page text; pages are split independently, in parallel."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    marks = tuple(marks)

    @F.arrow_udf("array<string>")
    def split_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for start in range(0, len(pages), PAGES_AT_ONCE):
                some = pages.slice(start, PAGES_AT_ONCE).to_pylist()
                yield pa.array([split_text(page, size, overlap, marks) if page else [] for page in some], type=pa.list_(pa.string()))

    # Non-deterministic to the optimizer, which would otherwise repeat the call in filters it derives.
    return split_pages.asNondeterministic()(text)
