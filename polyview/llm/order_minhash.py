"""Order MinHash: signatures of texts that are sensitive to edit distance.

A text's k-mers of code points are numbered by occurrence, so repeated ones differ.
Each of ``SKETCHES`` hash functions selects the ``PICKED`` smallest of them; in the
order in which they stand in the text, they are hashed to one number.  Texts share
such a number if the same k-mers were selected and stand in the same order.  The
likeness of two signatures is the share of equal numbers.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import id_and_text, slices
from polyview.session import cut_lineage

LENGTH = 8
SKETCHES = 64
PICKED = 2
# k-mers that are hashed by all functions at a time.
BLOCK = 1 << 11
NONE = np.uint64((1 << 64) - 1)
STEP = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class OrderMinHash:
    def __init__(self, length: int = LENGTH, sketches: int = SKETCHES, picked: int = PICKED, seed: int = 11):
        self.length, self.sketches, self.picked = length, sketches, picked
        keys = mixed(np.arange(1, 2 * sketches + 1, dtype=np.uint64) * STEP + np.uint64(seed))
        self.factors = (keys[:sketches] | np.uint64(1)).astype(np.uint32)[:, None]
        self.shifts = keys[sketches:].astype(np.uint32)[:, None]

    def plain(self, points: np.ndarray) -> np.ndarray:
        """A 64-bit hash per k-mer, in text order; a shorter text is one k-mer, an empty one none."""
        k = min(self.length, len(points))
        if not k:
            return np.zeros(0, np.uint64)
        n = len(points) - k + 1
        out, wide = np.zeros(n, np.uint64), points.astype(np.uint64) + np.uint64(1)
        for j in range(k):
            out *= BASE
            out += wide[j:j + n]
        return mixed(out)

    @staticmethod
    def numbered(plain: np.ndarray) -> np.ndarray:
        """Repeated hashes changed by their number among equal ones, the first of each kept."""
        n = len(plain)
        if not n:
            return plain
        bits = np.uint64(max(1, n.bit_length()))
        # The place stands in the lowest bits, so equal ones are sorted by it.
        ranked = np.sort((plain >> bits << bits) | np.arange(n, dtype=np.uint64))
        group = ranked >> bits
        new = np.concatenate([[True], group[1:] != group[:-1]])
        if new.all():
            return plain
        first = np.flatnonzero(new)
        number = np.empty(n, np.uint64)
        number[(ranked & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = (
            np.arange(n) - np.repeat(first, np.diff(np.append(first, n))))
        out = plain.copy()
        again = np.flatnonzero(number)
        out[again] = mixed(plain[again] + number[again] * STEP)
        return out

    def smallest(self, kmers: np.ndarray, first: int, end: int) -> np.ndarray:
        """sketches x picked: (hash << 32) + place of the smallest k-mers in a part of the text; NONE where there are fewer."""
        best = np.full((self.sketches, self.picked), NONE)
        low = (kmers[first:end] >> np.uint64(32)).astype(np.uint32)
        rows = np.arange(self.sketches)
        room = np.empty((self.sketches, min(BLOCK, max(1, len(low)))), np.uint32)
        for at in range(0, len(low), BLOCK):
            width = min(BLOCK, len(low) - at)
            part = room[:, :width]
            np.multiply(low[at:at + width], self.factors, out=part)
            part += self.shifts
            found = []
            for _ in range(min(self.picked, width)):
                place = part.argmin(axis=1)
                found.append((part[rows, place].astype(np.uint64) << np.uint64(32)) + (place + (first + at)).astype(np.uint64))
                part[rows, place] = 0xFFFFFFFF
            best = self.merged(best, np.stack(found, axis=1))
        return best

    def merged(self, *bests: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate(bests, axis=1), axis=1)[:, :self.picked]

    def signature(self, kmers: np.ndarray, best: np.ndarray) -> np.ndarray:
        """One number of 16 bits per hash function."""
        places = np.sort(np.where(best == NONE, np.uint64(1 << 32), best & np.uint64(0xFFFFFFFF)), axis=1)
        known = np.append(kmers, NONE)
        out = np.full(self.sketches, STEP)
        for j in range(self.picked):
            out = mixed(out * BASE + known[np.minimum(places[:, j], np.uint64(len(kmers)))])
        return (out >> np.uint64(48)).astype(np.uint16)

    def of(self, points: np.ndarray) -> np.ndarray:
        kmers = self.numbered(self.plain(points))
        return self.signature(kmers, self.smallest(kmers, 0, len(kmers)))

    def of_both(self, points: np.ndarray, cut: int, edited: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a text and of one that has its first ``cut`` code points; what they share is selected once."""
        same = max(0, cut - self.length + 1)
        plain = self.plain(points)
        own, other = self.numbered(plain), self.numbered(np.concatenate([plain[:same], self.plain(edited[same:])]))
        shared = self.smallest(own, 0, same)
        return (self.signature(own, self.merged(shared, self.smallest(own, same, len(own)))),
                self.signature(other, self.merged(shared, self.smallest(other, same, len(other)))))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def written(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, hasher: OrderMinHash | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (four hex digits per hash function); equal texts have equal ones, null is empty."""
    hasher = hasher or OrderMinHash()

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([written(hasher.of(code_points(t))) for t in part["text"].to_pylist()], pa.string())],
                ["doc_id", "fingerprint"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


ROW = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
       "near_edited double, near_next double, part int, role int, text string")
# Rows of the pass over the ranges: done, the first one of a range, the last one (which needs the next range's first).
DONE, FIRST, LAST = 0, 1, 2


class Edits:
    """A row for every document, from its text and the next one's."""

    def __init__(self, hasher: OrderMinHash):
        self.hasher, self.rows = hasher, []

    def add(self, number: int | None, text: str, following: str) -> None:
        points, new = code_points(text), code_points(following)
        replaced = len(points) // 3
        cut = len(points) - replaced
        edited = np.concatenate([points[:cut], new[:replaced]])
        own, other = self.hasher.of_both(points, cut, edited)
        self.rows.append([number, len(points), sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode(
            "utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other), None, None, DONE, None])

    def near(self, row: list, signature: np.ndarray) -> None:
        row[6] = likeness(row[3], signature)


def compared(docs: DataFrame, hasher: OrderMinHash | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per input row.

    A text is edited by replacing its last third of code points by as many first ones of the
    next document, by falling doc_id; after the last comes the first.  Of equal ids the one with the smaller hash
    of the text stands first; rows without an id stand last.  A lone document is its own next one.
    Null and empty texts have no k-mers; their likeness to each other is 1, to others 0.

    Documents are sorted by ranges, so a row's next one stands behind it; only the last row of a
    range looks for the first one of the next.
    """
    hasher = hasher or OrderMinHash()
    once = id_and_text(docs, id_col, text_col).withColumn("print", F.xxhash64("text")).withColumn(
        "tie", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), "print", "tie"]
    ranged = once.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "text", F.spark_partition_id().alias("part"))

    def batch(rows):
        columns = list(zip(*rows, strict=True))
        for c in (3, 4):
            columns[c] = [None if s is None else s.astype(">u2").tobytes() for s in columns[c]]
        types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          [c.split()[0] for c in ROW.split(", ")])

    def end(number, text, part, role):
        return [number, None, None, None, None, None, None, part, role, text]

    def walk(batches):
        """Rows with their next one in the same range; a row waits until the next one's signature is known."""
        made, before, here = Edits(hasher), None, None
        for part in slices(batches):
            ready = []
            for doc, text, at in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), part["part"].to_pylist(), strict=True):
                if before is None:
                    ready.append(end(doc, text, at, FIRST))
                else:
                    made.add(*before, text)
                    if len(made.rows) > 1:
                        made.near(made.rows[-2], made.rows[-1][3])
                before, here = (doc, text), at
            ready += made.rows[:-1]
            made.rows = made.rows[-1:]
            if ready:
                yield batch(ready)
        if before is not None:
            for row in made.rows:
                made.near(row, hasher.of(code_points(before[1])))
            yield batch([*made.rows, end(*before, here, LAST)])

    found = cut_lineage(ranged.mapInArrow(walk, ROW))
    filled = sorted(r["part"] for r in found.filter(F.col("role") == LAST).select("part").collect())
    follows = docs.sparkSession.createDataFrame(
        list(zip(filled, [*filled[1:], *filled[:1]], strict=True)), "part int, next int")
    last = found.filter(F.col("role") == LAST).join(F.broadcast(follows), "part").select("doc_id", "text", "next")
    first = found.filter(F.col("role") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("following"))

    def join_ends(batches):
        for part in slices(batches, 1):
            made = Edits(hasher)
            for doc, text, following in zip(*[part[c].to_pylist() for c in ("doc_id", "text", "following")], strict=True):
                made.add(doc, text, following)
                made.near(made.rows[-1], hasher.of(code_points(following)))
            if made.rows:
                yield batch(made.rows)

    ends = last.join(first, "next").select("doc_id", "text", "following").mapInArrow(join_ends, ROW)
    return found.filter(F.col("role") == DONE).unionByName(ends).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
