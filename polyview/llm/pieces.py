"""SentencePiece encoding that keeps the place of every piece in the original text.

The text is normalised by longest-prefix matches in the model's compiled
character map, and every normalised byte keeps the original byte it came from.
The library's BPE then runs on segments that start at a word.  No piece of the
vocabulary has a word mark behind another character (checked when the model is
loaded; other models and texts that hold marks are encoded whole), so no merge
can cross from one segment to the next, and the result equals that of the whole
text.  Short segments keep the library's merge queue in the processor's caches.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as proto

from polyview.llm.common import id_and_text, shipped, slices

MARK = "▁"
# A segment ends with the text or behind a word and before the spaces that follow it.
SEGMENTS = re.compile("(?s:.{128}[^ ]*(?: +[^ ]*)?|.+)").findall


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size:]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at this place and its replacement."""
        if not self.units:
            return None
        best, node = None, self._jump(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.strings[best[1]:self.strings.index(b"\0", best[1])]


@dataclass
class Encoded:
    """Ids as a list and as an array, and the original byte span of each piece."""

    ids: list[int]
    array: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class PieceEncoder:
    def __init__(self, model: bytes):
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rules = spec.normalizer_spec
        self.map = CharacterMap(self.rules.precompiled_charsmap)
        self.literal = not self.map.units and not self.rules.remove_extra_whitespaces
        kinds = proto.ModelProto.SentencePiece
        pieces = [p.piece for p in spec.pieces]
        self.prefix = MARK if self.rules.escape_whitespaces else " "
        self.lengths = np.array(
            [1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.pairs = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        byte_complete = spec.trainer_spec.byte_fallback
        # Segments go to the library without their first space, which its dummy prefix restores.
        # A segment of one space would be the empty text for the library, which has no pieces.
        self.alone = self.processor.piece_to_id(MARK)
        self.split = (byte_complete and self.alone != self.processor.unk_id() and spec.trainer_spec.model_type == proto.TrainerSpec.BPE
                      and self.literal and self.rules.add_dummy_prefix
                      and self.rules.escape_whitespaces
                      and not any(p[1] == MARK != p[0] for p in self.pairs)
                      and not any(p.type == kinds.USER_DEFINED for p in spec.pieces))
        width = len(str(len(pieces))) + 1
        self.decimals = np.array([f"{i},".rjust(width).encode() for i in range(len(pieces))])

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes and its end the original byte offset."""
        if not self.literal:
            out, _ = self._mapped(text.encode())
            text, places = out.decode(), self.places(text)
        else:
            places = self.places(text)
            text = text.replace(" ", MARK) if self.rules.escape_whitespaces else text
        if text and self.rules.add_dummy_prefix:
            text = self.prefix + text
        return text, places

    def places(self, text: str) -> np.ndarray:
        """The byte offsets of ``normalise`` alone; fast where normalisation keeps all characters."""
        data = text.encode()
        if self.literal:
            places = np.arange(len(data), dtype=np.int64)
            if self.rules.escape_whitespaces:
                places = places.repeat(np.where(np.frombuffer(data, np.uint8) == 32, 3, 1))
        else:
            places = np.array(self._mapped(data)[1], np.int64)
        before = len(self.prefix.encode()) if self.rules.add_dummy_prefix and len(places) else 0
        return np.concatenate([places[:1].repeat(before), places, [len(data)]]).astype(np.int64)

    def _mapped(self, data: bytes) -> tuple[bytearray, list[int]]:
        squeeze = self.rules.remove_extra_whitespaces
        space = MARK.encode() if self.rules.escape_whitespaces else b" "
        out, places, at, after_space = bytearray(), [], 0, squeeze
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                lead = data[at]
                width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = width, data[at:at + width]
            width, new = hit
            if squeeze and after_space:
                new = new.lstrip(b" ")
            if new:
                for byte in new:
                    part = space if byte == 32 else bytes([byte])
                    out += part
                    places += [at] * len(part)
                after_space = squeeze and new.endswith(b" ")
            at += width
        while squeeze and out.endswith(space):
            del out[-len(space):], places[-len(space):]
        return out, places

    def encode_all(self, texts: list[str]) -> list[Encoded]:
        """The texts of one slice; all their segments go to the library in one call."""
        parts, owners = [], []
        for text in texts:
            cut = SEGMENTS(text) if self.split and MARK not in text else [text]
            parts += [part[1:] if i else part for i, part in enumerate(cut)]
            owners.append(len(cut))
        found = self.processor.encode(parts, num_threads=1) if parts else []
        flat, sizes, at = [], [], 0
        for owned in owners:
            # Only behind a cut is a segment empty: its one mark went to the prefix.
            own = [ids or [self.alone] if i else ids for i, ids in enumerate(found[at:at + owned])]
            at += owned
            sizes.append(sum(map(len, own)))
            flat += chain.from_iterable(own)
        every, out, at = np.array(flat, np.int32), [], 0
        for text, size in zip(texts, sizes, strict=True):
            out.append(self._placed(text, flat[at:at + size], every[at:at + size]))
            at += size
        return out

    def _placed(self, text: str, ids: list[int], array: np.ndarray) -> Encoded:
        lengths, places = self.lengths[array], self.places(text)
        stops = np.cumsum(lengths)
        if len(ids) and stops[-1] != len(places) - 1:
            raise ValueError("the pieces do not cover the normalised text")
        return Encoded(ids, array, places[stops - lengths], places[stops])

    def decimal(self, encoded: Encoded) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.decimals[encoded.array].tobytes().replace(b" ", b"")[:-1]

    def encode(self, text: str) -> Encoded:
        return self.encode_all([text])[0]

    def stable(self, before: str, after: str) -> bool:
        """Whether no piece can hold these two neighbouring characters together."""
        return self.split and (before + after).replace(" ", MARK) not in self.pairs

    def decode(self, encoded: Encoded) -> str:
        return self.processor.decode(encoded.ids)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, ids and, for every piece, its span of original bytes (starts, ends).

    Null and empty texts have no pieces.  Repeated rows give repeated rows.
    """
    model = shipped(docs.sparkSession, model_path)

    def run(batches):
        encoder = PieceEncoder(model.value)
        kind = pa.list_(pa.int64())
        for part in slices(batches):
            rows = encoder.encode_all(part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], *(pa.array([getattr(r, k) for r in rows], kind)
                                   for k in ("ids", "starts", "ends"))],
                ["doc_id", "ids", "starts", "ends"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, ids array<long>, starts array<long>, ends array<long>")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids again, and return digests of both.

    One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and
    spans_crc32, the checksum of the pieces' end offsets (little-endian 64 bit).
    Null and empty texts have no tokens and the digests of the empty string.
    """
    model = shipped(docs.sparkSession, model_path)

    def digest(text: bytes) -> str:
        return hashlib.sha256(text).hexdigest()

    def run(batches):
        encoder = PieceEncoder(model.value)
        for part in slices(batches):
            rows = encoder.encode_all(part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([len(r.ids) for r in rows], pa.int64()),
                 pa.array([digest(encoder.decimal(r)) for r in rows], pa.string()),
                 pa.array([digest(encoder.decode(r).encode()) for r in rows], pa.string()),
                 pa.array([zlib.crc32(r.ends.astype("<i8").tobytes()) for r in rows], pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
