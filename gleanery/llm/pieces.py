"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece holds a whitespace marker behind another character, no merge can
reach over the start of a marked word. Each distinct marked word is therefore
segmented once and its ids are put back wherever the word stands. The table
belongs to a worker and is emptied when full: one for the whole corpus would
send every word of every text through a shuffle.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import frugal, pieces_of, small_batches, text_bytes

TABLE_SIZE = 300_000  # distinct chunks a worker keeps
_MARK = "▁"
_SLICE = 2 << 20


class Chunks:
    """Parts texts at places no piece reaches over, and segments each distinct part once."""

    def __init__(self, path: str, table_size: int = TABLE_SIZE):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as layout

        with open(path, "rb") as file:
            spec = layout.ModelProto.FromString(file.read())
        norm = spec.normalizer_spec
        pieces = [p.piece for p in spec.pieces if p.type in (1, 4)]  # 1 and 4: ordinary and user-defined
        if (
            norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not norm.add_dummy_prefix
            or not norm.escape_whitespaces
            or any(p.type == 4 for p in spec.pieces)
            or any(_MARK in p.lstrip(_MARK) for p in pieces)
        ):
            raise ValueError(f"{path}: pieces may cross whitespace markers, or texts are normalised")
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.mark = np.array([self.processor.piece_to_id(_MARK)], np.int32).tobytes()
        # A line break no piece holds parts texts as well.
        self.breaks = not any("\n" in p for p in pieces)
        self.parts = re.compile(" +[^ \n]*|\n[^ \n]*" if self.breaks else " +[^ ]*")
        self.table: dict[str, bytes] = {" ": self.mark}  # ids as 32-bit numbers
        self.table_size = table_size

    def split(self, text: str) -> list[str]:
        """The chunks of a text: each starts with its spaces, the first of which is the marker put in front."""
        return self.parts.findall(" " + text.replace(_MARK, " ")) if text else []

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks that are not in the table yet."""
        missing = [c for c in chunks if c not in self.table]
        if len(self.table) + len(missing) > self.table_size:
            self.table = {" ": self.mark}
            missing = [c for c in chunks if c not in self.table]
        # The library puts one marker in front of what it gets: instead of the chunk's own first
        # space, or before the line break a chunk starts with, where it is cut off again.
        ids = self.processor.encode([c[1:] if c[0] == " " else c for c in missing])
        self.table.update(
            (c, array("i", x if c[0] == " " else x[1:]).tobytes()) for c, x in zip(missing, ids, strict=True)
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.ids(texts)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get = self.table.__getitem__
        return [np.frombuffer(b"".join(map(get, parts)), np.int32) for parts in split]


@lru_cache(maxsize=2)
def _chunks(path: str, table_size: int) -> Chunks:
    return Chunks(path, table_size)


def encode_decode(docs: DataFrame, path: str, table_size: int = TABLE_SIZE) -> DataFrame:
    """``doc_id, ids array<int>, decoded``: one row per row of ``docs``.

    ``ids`` are what the library's encode gives for the whole text, without begin
    and end ids; ``decoded`` is what its decode makes of them. ``path`` names a
    model file every worker can read. A null or empty text has no ids and decodes
    to an empty text; a null doc_id stays null; repeated rows give repeated rows;
    other columns of ``docs`` are ignored.
    """
    small_batches(docs.sparkSession)

    @frugal
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(path, table_size)
        for batch in batches:
            for part in pieces_of(batch, _SLICE):
                ids = chunks.ids([x.decode() for x in part.column("body").to_pylist()])
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate([*ids, np.empty(0, np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                        pa.array([chunks.processor.decode(x.tolist()) if len(x) else "" for x in ids], pa.string()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_bytes(docs["text"]).alias("body"))
    return rows.mapInArrow(code, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame, *carried: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded documents, and the columns named."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *carried,
    )
