"""Token ids in files of independent zstandard frames with a trailing seek table.

A shard file holds the ids of a range of documents, little-endian unsigned 32-bit,
cut into frames that decompress alone. After them stand, in frames that zstandard
readers skip, an index of the documents and the seek table: per frame its
compressed and decompressed size and the low 32 bits of the XXH64 of its content
(the public seekable format). A reader finds the frames of the documents that it
wants, reads and checks those and leaves the rest.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.errors import CurationError
from tagweave.llm.common import shuffle_partitions
from tagweave.llm.files import open_file, write_whole

# Fixed values of the public format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
INDEX = 0x184D2A50
FOOTER = struct.Struct("<IBI")

FRAME_BYTES = 1 << 20
INDEX_ROW = np.dtype([("doc", "<i8"), ("known", "u1"), ("length", "<u8")])


class FrameWriter:
    """Append documents; a frame closes at ``frame_bytes``, a longer document spans several."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.held = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append((0 if doc is None else doc, doc is not None, len(ids) // 4))
        self.held += ids
        while len(self.held) >= self.frame_bytes:
            self._frame(bytes(self.held[: self.frame_bytes]))
            del self.held[: self.frame_bytes]

    def _frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.out.write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self._frame(bytes(self.held))
        rows = np.array(self.docs, INDEX_ROW).tobytes()
        step = 1 << 30
        pieces = [rows[i : i + step] for i in range(0, len(rows), step)]
        for piece in pieces:
            self.out.write(struct.pack("<II", INDEX, len(piece)) + piece)
        # the count and size of the index stand in its own last frame
        tail = struct.pack("<QQ", len(rows), len(pieces))
        self.out.write(struct.pack("<II", INDEX, len(tail)) + tail)
        table = np.array(self.frames, "<u4").tobytes() + FOOTER.pack(len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FrameReader:
    """Read documents by their place in the file; ``frames_read`` counts frames decompressed."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or flags != 0x80:
            raise CurationError("no seek table with checksums")
        start = size - FOOTER.size - 12 * count
        table = np.frombuffer(self._at(start, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.packed = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(table[:, 1])])
        length, pieces = struct.unpack("<QQ", self._at(start - 8 - 16, 16))
        rows, at = [], int(self.packed[-1])
        for _ in range(pieces):
            _, piece = struct.unpack("<II", self._at(at, 8))
            rows.append(self._at(at + 8, piece))
            at += 8 + piece
        self.index = np.frombuffer(b"".join(rows), INDEX_ROW)
        if len(self.index) * INDEX_ROW.itemsize != length:
            raise CurationError("document index cut short")
        self.first = np.concatenate([[0], np.cumsum(self.index["length"].astype(np.int64))])
        self.unpacker = zstandard.ZstdDecompressor()
        self.frames_read = 0
        self._kept = (-1, b"")

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _frame(self, number: int) -> bytes:
        if self._kept[0] != number:
            packed = self._at(int(self.packed[number]), int(self.packed[number + 1] - self.packed[number]))
            content = self.unpacker.decompress(packed)
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[number]:
                raise CurationError(f"frame {number} does not match its checksum")
            self.frames_read += 1
            self._kept = (number, content)
        return self._kept[1]

    def ids(self, place: int) -> bytes:
        """The ids of the document at this place, as bytes."""
        low, high = 4 * int(self.first[place]), 4 * int(self.first[place + 1])
        parts, frame = [], int(np.searchsorted(self.plain, low, "right")) - 1
        while low < high:
            base = int(self.plain[frame])
            parts.append(self._frame(frame)[low - base : high - base])
            low, frame = int(self.plain[frame + 1]), frame + 1
        return b"".join(parts)


#: The steps before the merges, as a tokenizer file states them, that the short way below restates. Fixed values.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
#: Words of printable ASCII and Latin-1 letters take the short way; the pattern is the tokenizer's own for such words.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Such a word of letters alone is one match of that pattern, once in lower case.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
TABLE_WORDS = 400_000


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cuts_words(path: str) -> bool:
    """Whether a tokenizer file states just the steps that the short way restates, so that words can be encoded one by one."""
    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    plain = all(stated.get(name) is None for name in ("truncation", "padding", "post_processor"))
    special = all(token["content"].startswith("<|") and not token["normalized"] for token in stated.get("added_tokens") or [])
    model = stated["model"]
    whole = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
    return plain and special and whole and stated["normalizer"] == NORMALIZER and stated["pre_tokenizer"] == PRE_TOKENIZER


def byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTable(dict):
    """Ids of words as bytes, made when a word is first met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if LETTERS.fullmatch(text):
            piece = text.lower()
            ids = self.pieces.get(piece) or self._piece(piece)
        elif PLAIN.fullmatch(text) and "<|" not in text:
            ids = b"".join([self.pieces.get(p) or self._piece(p) for p in PIECE.findall(text.lower())])
        else:
            ids = packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        # printable ASCII is spelled as it is
        spelled = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        found = packed([t.id for t in self.model.tokenize(spelled)])
        self.pieces[piece] = found
        return found


class WordEncoder:
    """Encode texts word by word, each distinct word once, where the tokenizer file allows it; else by the library, text by text.

    Distinct words are kept up to ``TABLE_WORDS``; then the table starts anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words = WordTable(path)
        self.by_word = cuts_words(path)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; none for a null text."""
        if not self.by_word:
            ids = self.words.tokenizer.encode(text or "", add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        if len(self.words) > TABLE_WORDS:
            self.words.clear()
            self.words.pieces.clear()
        return b"".join(map(self.words.__getitem__, (text or "").encode().split()))


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_token_files(
    docs: DataFrame, folder: str, encoder: Callable[[], Callable[[str | None], bytes]], *, doc: str = "doc_id", text: str = "text",
    end_id: int | None = 1, shards: int | None = None,
) -> list[tuple[int, int, int]]:
    """Write shard files in ascending order of ids; returns (shard, documents, ids), one row per shard.

    Rows are dealt by ranges of ``doc`` (null first), of rows of one id by the text's hash and of equal ones by a number of their own,
    so no id, null or repeated, has to fit one shard. A null text has no ids but the end id. Repeated rows are written as
    often as they occur. A text of any length is encoded whole and spans frames. An empty table writes shards without documents or none.
    """
    spark = docs.sparkSession
    end = b"" if end_id is None else struct.pack("<I", end_id)
    order = ["doc", "print", "number"]
    rows = docs.select(
        F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("print"), F.monotonically_increasing_id().alias("number")
    )
    rows = rows.repartitionByRange(shards or shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode, counts = TaskContext.get().partitionId(), encoder(), [0, 0]

        def fill(out) -> None:
            writer = FrameWriter(out)
            for batch in batches:
                for key, content in zip(batch["doc"], batch["text"]):
                    ids = encode(content.as_py()) + end
                    writer.add(key.as_py(), ids)
                    counts[0] += 1
                    counts[1] += len(ids) // 4
            writer.close()

        write_whole(f"{folder}/{shard:06d}.ids", fill)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [counts[0]], "ids": [counts[1]]})

    found = rows.mapInArrow(write, "shard long, docs long, ids long").collect()
    return sorted((r["shard"], r["docs"], r["ids"]) for r in found)


def read_token_files(spark, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """Rows (doc, start, ids): start counts the ids of all documents before it, ids are the bytes."""
    base, starts = 0, {}
    for shard, _, ids in shards:
        starts[shard] = base
        base += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch["shard"].to_pylist():
                with open_file(f"{folder}/{shard:06d}.ids") as source:
                    reader = FrameReader(source)
                    for low in range(0, len(reader.index), 200):
                        rows = reader.index[low : low + 200]
                        yield pa.RecordBatch.from_pydict({
                            "doc": pa.array(rows["doc"], mask=rows["known"] == 0),
                            "start": starts[shard] + reader.first[low : low + len(rows)],
                            "ids": pa.array([reader.ids(low + i) for i in range(len(rows))], pa.binary()),
                        })

    names = spark.createDataFrame([(s,) for s, _, _ in shards], "shard long").repartitionByRange(max(1, len(shards)), "shard")
    return names.mapInArrow(read, "doc long, start long, ids binary")
