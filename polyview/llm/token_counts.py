"""Exact token counts of texts of any length by overlapping chunks.

A huge text is encoded in chunks that overlap.  Two neighbours are spliced at a
byte where both have a token boundary and whose two characters no piece of the
vocabulary holds side by side: no merge can cross such a place in any context,
so the tokens on either side are those of the whole text.  Where an overlap has
no such place it is widened, in the end to the whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import id_and_text, shipped, slices
from polyview.llm.pieces import PieceEncoder

CHUNK = 16 << 10
OVERLAP = 512


class ChunkedCounter:
    """chunk, overlap: bytes; the result does not depend on them."""

    def __init__(self, encoder: PieceEncoder, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.encoder, self.chunk, self.overlap = encoder, chunk, max(1, overlap)
        self.widened = 0

    def _ends(self, data: bytes, start: int, stop: int) -> np.ndarray:
        """Where the tokens of one chunk end in the whole text."""
        return start + self.encoder.encode(data[start:stop].decode()).ends

    @staticmethod
    def _to_character(data: bytes, at: int) -> int:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def _splice(self, data: bytes, left: np.ndarray, right: np.ndarray, low: int, high: int) -> int | None:
        """The last common boundary of the overlap that is proved to be stable."""
        both = np.intersect1d(left, right)
        for at in both[(both > low) & (both < high)][::-1].tolist():
            if data[at] & 0xC0 == 0x80:
                continue
            before = data[self._to_character(data, at - 1):at].decode()
            if self.encoder.stable(before, data[at:at + 4].decode(errors="ignore")[0]):
                return at
        return None

    def count_all(self, texts: list[str]) -> list[int]:
        """Texts of at most one chunk are encoded together, the others one by one."""
        short = [t for t in texts if len(t) * 4 <= self.chunk]
        counts = iter([len(e.ids) for e in self.encoder.encode_all(short)])
        return [next(counts) if len(t) * 4 <= self.chunk else self.count(t) for t in texts]

    def count(self, text: str) -> int:
        data = text.encode()
        if len(data) <= self.chunk or not self.encoder.split:
            return len(self.encoder.encode(text).ids)
        total, done = 0, -1  # the dummy prefix may be a token that ends at 0
        begin, stop = 0, self._to_character(data, self.chunk)
        left = self._ends(data, begin, stop)
        while stop < len(data):
            overlap = self.overlap
            while True:
                start = max(done, 0, self._to_character(data, max(0, stop - overlap)))
                new_stop = min(len(data), self._to_character(data, start + max(self.chunk, 2 * overlap)))
                right = self._ends(data, start, new_stop)
                at = self._splice(data, left, right, start, stop)
                if at is not None or start <= max(done, 0):
                    break
                overlap *= 2
                self.widened += 1
            if at is None:  # the overlap is all of the left chunk: the longer one replaces it
                if new_stop == stop:
                    raise ValueError("a chunk did not grow")
                left, stop = right, new_stop
                continue
            total += int(((left > done) & (left <= at)).sum())
            done, left, stop = at, right, new_stop
        return total + int((left > done).sum())


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK,
                 overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit), one row per input row.

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows give repeated rows.
    """
    model = shipped(docs.sparkSession, model_path)

    def run(batches):
        counter = ChunkedCounter(PieceEncoder(model.value), chunk, overlap)
        for part in slices(batches):
            texts = part["text"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(counter.count_all(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    counted = id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
