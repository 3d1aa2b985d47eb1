"""Fill-in-middle texts by in-place block rotation.

A text is scanned for its cuts, its UTF-8 bytes go into one bytearray with the sentinels at
prefix, middle and suffix, and two neighbouring blocks change places by three reversals, in place.
Reading back finds the sentinels, rotates the same blocks again and takes the sentinels out.
A text that holds a sentinel stays plain, and no sentinel can begin inside another one or
straddle its edge, so each is found exactly once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import row_beside_text

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Texts of at least this many bytes leave a task as one Arrow batch.
OUT_BYTES = 8 << 20


def reverse(bytes_: np.ndarray, start: int, end: int) -> None:
    """Reverse ``bytes_[start:end]`` in place."""
    half = (end - start) // 2
    head = bytes_[start : start + half].copy()
    bytes_[start : start + half] = bytes_[end - half : end][::-1]
    bytes_[end - half : end] = head[::-1]


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the blocks ``start:middle`` and ``middle:end`` by three reversals."""
    bytes_ = np.frombuffer(buffer, np.uint8)
    reverse(bytes_, start, middle)
    reverse(bytes_, middle, end)
    reverse(bytes_, start, end)


def byte_offset(text: str, units: int) -> int:
    """Bytes that the first ``units`` code points take."""
    return units if text.isascii() else len(text[:units].encode())


def numbers_of(seed: int, doc: object) -> tuple[int, ...]:
    """h1 to h4: the first four 8-digit groups of the SHA-256 of ``seed:doc``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def transform(text: str, numbers: tuple[int, ...], plain: int, spm: int) -> tuple[str, int | None, int | None, bytearray]:
    """(form, code points of prefix and of middle, output) of one text."""
    h1, h2, h3, h4 = numbers
    buffer = bytearray(text.encode())
    if not text or h3 % 100 >= 100 - plain or any(sentinel in buffer for sentinel in SENTINELS):
        return "plain", None, None, buffer
    n = len(text)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    start, end = byte_offset(text, first), byte_offset(text, second)
    buffer[end:end] = SUFFIX
    buffer[start:start] = MIDDLE
    buffer[0:0] = PREFIX
    # <P>prefix | <M>middle | <S>suffix
    middle, suffix = len(PREFIX) + start, len(PREFIX) + len(MIDDLE) + end
    if h4 % 100 < spm:
        rotate(buffer, 0, suffix, len(buffer))
        return "spm", first, second - first, buffer
    rotate(buffer, middle, suffix, len(buffer))
    return "psm", first, second - first, buffer


def restore(output: bytes, form: str) -> bytearray:
    """The text that :func:`transform` was given, from its output and form alone."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    if form == "psm":
        rotate(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), len(buffer))
    else:
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        place = buffer.index(sentinel)
        del buffer[place : place + len(sentinel)]
    return buffer


def _batches(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``OUT_BYTES`` each."""
    start = total = 0
    for row, size in enumerate(sizes):
        total += size
        if total >= OUT_BYTES:
            yield start, row + 1
            start, total = row + 1, 0
    if start < batch.num_rows:
        yield start, batch.num_rows


def fill_in_middle(
    docs: DataFrame, *, doc: str = "doc_id", text: str = "text", seed: int = 1, plain: int = 10, spm: int = 20, with_text: bool = False
) -> DataFrame:
    """Rows (row, n, form, prefix_chars, middle_chars, output), one per row of ``docs``.

    ``row`` holds the columns of ``docs`` (without the text unless asked for), so no name can clash. ``n`` counts code points.
    ``plain`` percent of the documents stay as they are, ``spm`` percent of the others put the suffix first. Cuts and form follow from
    ``seed`` and the id alone: repeated ids are cut by the same numbers, a null id by those of the empty id. A null text is an empty
    one; an empty text, or one that holds a sentinel, is plain, with null for its cuts. A prefix, middle or suffix may be
    empty. A text is handled as one bytearray, however long. An empty table gives an empty result.
    """
    rows, kind = row_beside_text(docs, text, with_text)
    rows = rows.select("row", "text", F.col(f"row.`{doc}`").cast("string").alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) for x in batch["text"].cast(pa.binary()).fill_null(b"").to_pylist()]
            for start, end in _batches(batch, sizes):
                part = batch.slice(start, end - start)
                found = []
                counts = []
                for name, content in zip(part["doc"].to_pylist(), part["text"].to_pylist()):
                    content = content or ""
                    counts.append(len(content))
                    found.append(transform(content, numbers_of(seed, name), plain, spm))
                forms, prefixes, middles, outputs = zip(*found)
                yield pa.RecordBatch.from_arrays([
                    part["row"], pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                    pa.array(middles, pa.int64()), pa.array(map(bytes, outputs), pa.binary()).cast(pa.string()),
                ], ["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"row {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, *, output: str = "output", form: str = "form") -> DataFrame:
    """The columns of ``rows`` in the struct ``row`` beside ``restored``, the text rebuilt from output and form.

    A null output or form gives null.
    """
    kept = rows.select(F.struct("*").alias("row"), F.col(output).alias("output"), F.col(form).alias("form"))
    kind = kept.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) for x in batch["output"].cast(pa.binary()).fill_null(b"").to_pylist()]
            for start, end in _batches(batch, sizes):
                part = batch.slice(start, end - start)
                outputs = part["output"].cast(pa.binary()).to_pylist()
                texts = [None if x is None or f is None else bytes(restore(x, f)) for x, f in zip(outputs, part["form"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(texts, pa.binary()).cast(pa.string())], ["row", "restored"])

    return kept.mapInArrow(run, f"row {kind}, restored string")
