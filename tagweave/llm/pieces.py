"""SentencePiece encoding and decoding by a table of distinct chunks.

White space is marked by U+2581 before a word. Where no piece of the model holds
a mark after any other character, merges never cross from a word to the next
mark, so a text's ids are those of its chunks (marks, then a word) one after the
other. Each task segments a distinct chunk once and joins ids back by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagweave.llm.common import row_beside_text, slices, with_small_batches

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Chunks that a worker keeps at most between texts; common ones outlive the rest.
TABLE_CHUNKS = 100_000


class ChunkEncoder:
    """Whole texts go through the library where the model's pieces cross marks or it rewrites text."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as source:
            proto = sentencepiece_model_pb2.ModelProto.FromString(source.read())
        spec = proto.normalizer_spec
        crossing = any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)
        own = any(p.type == p.USER_DEFINED for p in proto.pieces)
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self.by_chunk = plain and not crossing and not own and not proto.trainer_spec.treat_whitespace_as_suffix
        self.by_chunk = self.by_chunk and proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if not self.by_chunk:
            return np.array(self.model.encode(text), "<u4")
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        # half a table that is full becomes the older one; what is met again moves on, the rest goes with the next turn
        if len(self.chunks) >= TABLE_CHUNKS // 2:
            self.older, self.chunks = self.chunks, {}
        known = self.chunks
        missing = [c for c in dict.fromkeys(chunks) if c not in known]
        again = {c: self.older[c] for c in missing if c in self.older}
        known |= again
        missing = [c for c in missing if c not in again]
        # the library puts a mark before every text: take it off and let the library put it back
        inner = [c for c in missing if c[0] == MARK and len(c) > 1]
        for chunk, ids in zip(inner, self.model.encode([c[1:] for c in inner], num_threads=1)):
            known[chunk] = np.array(ids, "<u4").tobytes()
        for chunk in missing:
            if chunk == MARK:
                known[chunk] = np.array([self.model.piece_to_id(MARK)], "<u4").tobytes()
        return np.frombuffer(b"".join([known[c] for c in chunks]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


@lru_cache(2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode_pieces(docs: DataFrame, model: str, *, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text in the struct ``row``, ``ids`` and ``decoded``, their text.

    ``model`` is the path of the model file on every executor. A null or empty text
    has no ids and decodes to the empty text. Repeated rows are encoded each, a text of
    any length whole. An empty table gives an empty result.
    """
    with_small_batches(docs.sparkSession)
    rows, kind = row_beside_text(docs, text, False)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(model)
        for batch in (part for whole in batches for part in slices(whole)):
            ids, decoded = [], []
            for content in batch["text"]:
                found = encoder.encode(content.as_py())
                ids.append(found)
                decoded.append(encoder.decode(found))
            ends = np.cumsum([0, *map(len, ids)], dtype="i4")
            values = pa.array(np.concatenate(ids).astype("i4") if ids else np.zeros(0, "i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([batch["row"], lists, pa.array(decoded, pa.string())], ["row", "ids", "decoded"])

    return rows.mapInArrow(encode, f"row {kind}, ids array<int>, decoded string")
