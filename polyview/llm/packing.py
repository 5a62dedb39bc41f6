"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Pieces are dealt to shards of a bounded expected size.  A shard packs its pieces,
longest first, each into the open bin whose choice leaves the squared counts of
open bins per residual gap smallest.  A new bin is opened only when no open one
has room, because every further bin is a further sequence.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import id_and_text, shipped, slices
from polyview.session import cut_lineage

CAPACITY = 4096
PER_SHARD = 50_000
REMEMBERED = 500_000
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
# Room for the sequence numbers of one shard.
SHARD_STEP = 1 << 32
# The normaliser and the splitter under which words may be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and splits as ``WordTokenizer`` needs it,
    merges without chance, and adds only tokens that hold ``<|``."""
    return (spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == SPLITTER
            and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            and all("<|" in token["content"] for token in spec["added_tokens"]))


class WordTokenizer:
    """Ids of whole texts from those of their words.

    A tokenizer that drops white space, never merges across it and splits a
    Latin letter from punctuation that follows may encode words one by
    one.  It lower-cases, so words are lower-cased first and found again more
    often.  A word of plain letters needs no normalising or splitting and goes
    straight to the tokenizer's model; others take the whole tokenizer.  Texts
    that may hold a special token are encoded whole, and so are all texts if the
    file's normaliser, splitter or added tokens are others.
    """

    def __init__(self, spec: bytes, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words = splits_at_spaces(json.loads(spec))
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))}
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.pool, self.ends = array("I"), array("q", [0])

    def _encode(self, word: str) -> list[int]:
        if not (word.isascii() and word.isalpha()):
            if not PLAIN(word):
                return self.tokenizer.encode(word, add_special_tokens=False).ids
            word = word.translate(self.letters)
        return [token.id for token in self.tokenizer.model.tokenize(word)]

    def _places(self, words: list[str]) -> list[int]:
        """Where the words stand in the pool; new ones are added."""
        if len(self.places) + len(words) > self.remembered:
            self._forget()
        for word in words:
            if word not in self.places:
                self.places[word] = len(self.places)
                self.pool.extend(self._encode(word))
                self.ends.append(len(self.pool))
        return [self.places[w] for w in words]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.by_words:
            return [self._whole(text) for text in texts.to_pylist()]
        special = pc.match_substring(texts, "<|").to_pylist()
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-zß-öø-ÿ])([.,!$%&*#;:?])", r"\1 \2")
        words = pc.ascii_split_whitespace(plain)
        offsets = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        places = np.array(self._places(coded.dictionary.to_pylist()), np.int64)
        ends, pool = np.array(self.ends), np.array(self.pool, np.uint32)
        places = places[coded.indices.to_numpy()]
        each = ends[places + 1] - ends[places]
        stops = np.cumsum(each)
        flat = pool[np.repeat(ends[places] - (stops - each), each) + np.arange(each.sum())]
        bounds = np.concatenate([[0], stops])[offsets - offsets[0]]
        return [self._whole(texts[i].as_py()) if special[i] else flat[bounds[i]:bounds[i + 1]] for i in range(len(texts))]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' ids, each followed by ``end_id``, cut into pieces of at most ``capacity``.

    doc_id, piece (from 0), start, length, ids_crc32 (little-endian unsigned 32-bit ids).
    Null and empty texts give the end id alone.
    """
    spec = shipped(docs.sparkSession, tokenizer_path)

    def run(batches):
        tokenizer = WordTokenizer(spec.value)
        end = np.array([end_id], np.uint32)
        for part in slices(batches, 1024):
            rows = []
            names, texts = part["doc_id"].to_pylist(), part["text"]
            for name, ids in zip(names, tokenizer.ids(texts), strict=True):
                whole = np.concatenate([ids, end]).astype("<u4")
                for piece, at in enumerate(range(0, len(whole), capacity)):
                    own = whole[at:at + capacity]
                    rows.append((name, piece, at, len(own), zlib.crc32(own.tobytes())))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, piece long, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order.

    open[g] counts open bins with gap g.  Moving a bin from gap g to g - s changes
    the sum of squares by 2 (open[g - s] - open[g] + 1), and by 1 - 2 open[s] when it
    becomes full.  Ties go to the smallest gap, then to the bin opened last.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        counts = open_bins[size:]
        change = 2 * (open_bins[:capacity + 1 - size] - counts)
        change[0] = -2 * counts[0] - 1
        change = np.where(counts > 0, change, np.iinfo(np.int64).max)
        gap = size + int(change.argmin())
        if open_bins[gap]:
            own = members[gap].pop()
            open_bins[gap] -= 1
        else:
            own, gap, used = used, capacity, used + 1
        bins[i], offsets[i] = own, capacity - gap
        if gap > size:
            open_bins[gap - size] += 1
            members[gap - size].append(own)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """Adds sequence_id and offset to rows of doc_id, piece, start, length, ids_crc32.

    The input is written to the checkpoint folder once, so it is not computed
    again.  Rows are dealt to shards by hash; a shard is packed in one task and
    holds about ``per_shard`` rows of five numbers, whatever the input's size.
    Lengths must lie between 1 and ``capacity``.  An empty input gives an empty result.
    """
    pieces = cut_lineage(pieces)
    shards = -(-max(1, pieces.count()) // per_shard)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"),
                             ("ids_crc32", "ascending")])
        lengths = rows["length"].to_numpy()
        bins, offsets = sum_of_squares(lengths, capacity)
        shard = rows["shard"][0].as_py()
        return rows.drop_columns("shard").append_column(
            "sequence_id", pa.array(bins + shard * SHARD_STEP)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(
        run, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY,
                   per_shard: int = PER_SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack; one row per piece (see ``token_pieces`` and ``pack``).

    Repeated rows are packed as often as they occur; an empty table gives an empty result.
    ``tokenizer_path`` may name any file of the tokenizers library.
    """
    return pack(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), capacity, per_shard)
