"""SimHash fingerprints and all links between near ones, by vantage-point trees.

A fingerprint's place in the tree is a list of Hamming distances from a vantage
point, one per level; each level measures on bits of its own, so the levels'
triangle bounds add up: two fingerprints within radius r differ by r at most in
the sum of their distances' differences.  A leaf is a shard.  A fingerprint is
kept in its own leaf and visits every later leaf that its ball overlaps; leaves
that the summed bounds exclude are pruned.  Every close pair meets in exactly one
leaf, where it is verified.  A leaf reports links that span what it found
connected, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyview.llm.common import id_and_text, slices
from polyview.llm.components import components
from polyview.session import cut_lineage

VANTAGE = 0x5A17C3E99B64D02F
# Leaves are made so small that a fingerprint meets about so many others in random data.
MEETINGS = 4096
SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, width: int = 3, seed: int = SEED) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; no word: 0."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        hashes = np.array([digest(joined[a:b], seed) for a, b in
                           zip(starts[at:at + (1 << 14)], ends[at:at + (1 << 14)], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and bits (the fingerprint as a signed long); null and empty texts have 0."""

    def run(batches):
        for part in slices(batches):
            bits = np.array([fingerprint(t, width) for t in part["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text_hash"], pa.array(bits.view(np.int64))], ["doc_id", "text_hash", "bits"])

    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, bits long")


class Tree:
    """depth levels, each on 64 / depth bits; leaves are numbered by their distances."""

    def __init__(self, depth: int, radius: int):
        self.depth, self.radius, self.bits = depth, radius, 64 // depth
        self.base = self.bits + 1
        self.steps = np.array(self._ball(depth, radius), np.int64)

    @staticmethod
    def _ball(depth: int, radius: int) -> list[list[int]]:
        """Differences of total size up to radius whose first one that is not 0 is positive, and the zero."""
        found = [([0] * depth, radius)]
        for level in range(depth):
            more = []
            for step, left in found:
                for d in range(-left, left + 1):
                    if d and (d > 0 or any(step[:level])):
                        more.append((step[:level] + [d] + step[level + 1:], left - abs(d)))
            found += more
        return [step for step, _ in found]

    def distances(self, bits: np.ndarray) -> np.ndarray:
        far = (bits ^ np.uint64(VANTAGE))[:, None] >> (np.arange(self.depth, dtype=np.uint64) * np.uint64(self.bits))
        return np.bitwise_count(far & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def number(self, distances: np.ndarray) -> np.ndarray:
        return distances @ (self.base ** np.arange(self.depth, dtype=np.int64))

    def visits(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf each fingerprint must be in; its own one first."""
        own = self.distances(bits)
        rows, leaves = [], []
        for step in self.steps:
            to = own + step
            fits = ((to >= 0) & (to <= self.bits)).all(axis=1)
            rows.append(np.flatnonzero(fits))
            leaves.append(self.number(to[fits]))
        return np.concatenate(rows), np.concatenate(leaves)

    def share(self) -> float:
        """The part of random fingerprints that one of them meets."""
        one = np.array([1.0])
        for _ in range(self.bits):
            one = np.convolve(one, [0.5, 0.5])
        shift = {d: float((one[max(0, -d):len(one) - max(0, d)] * one[max(0, d):len(one) - max(0, -d)]).sum())
                 for d in range(-self.radius, self.radius + 1)}
        return float(sum(np.prod([shift[int(d)] for d in step]) for step in self.steps))


def plan_tree(rows: int, radius: int, meetings: int = MEETINGS) -> Tree:
    """The shallowest tree whose leaves are small enough."""
    for depth in (4, 8, 16):
        tree = Tree(depth, radius)
        if rows * tree.share() <= meetings:
            break
    return tree


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; parent names every element's smallest root before and after."""
    while True:
        left, right = parent[a], parent[b]
        apart = left != right
        if not apart.any():
            return
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        np.minimum.at(parent, np.maximum(left, right), np.minimum(left, right))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def leaf_links(bits: np.ndarray, own: np.ndarray, radius: int, block: int = 1 << 22) -> np.ndarray:
    """Pairs (fingerprint, root) that span what the leaf's own members link, among them and with visitors."""
    order = np.argsort(~own, kind="stable")
    bits, n_own = bits[order], int(own.sum())
    parent = np.arange(len(bits))
    step = max(1, block // max(1, len(bits)))
    for at in range(0, n_own, step):
        near = np.bitwise_count(bits[at:min(at + step, n_own), None] ^ bits[None, at:]) <= radius
        a, b = np.nonzero(near)
        if len(a) > min(step, n_own - at):  # more than each one with itself
            merge(parent, a + at, b + at)
    child = np.flatnonzero(parent != np.arange(len(bits)))
    return np.stack([bits[child], bits[parent[child]]], axis=1)


def near_links(distinct: DataFrame, rows: int, radius: int = 2, meetings: int = MEETINGS) -> DataFrame:
    """Links a, b that connect exactly what pairs within ``radius`` connect.

    distinct: the column bits, no value twice; rows: their number.  A leaf that
    holds more than expected is searched in blocks of bounded memory.
    """
    tree = plan_tree(rows, radius, meetings)

    def send(batches):
        for part in slices(batches, 1 << 14):
            bits = part["bits"].to_numpy().view(np.uint64)
            row, leaf = tree.visits(bits)
            own = np.arange(len(row)) < len(bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf), pa.array(bits[row].view(np.int64)), pa.array(own)], ["leaf", "bits", "own"])

    def search(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        leaf = None

        def flush():
            if not held:
                return None
            bits = np.concatenate([h[0] for h in held])
            own = np.concatenate([h[1] for h in held])
            held.clear()
            return leaf_links(bits, own, radius) if own.any() and len(bits) > 1 else None

        def batch(found):
            pairs = np.concatenate(found).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for part in batches:
            leaves, found = part["leaf"].to_numpy(), []
            bits = part["bits"].to_numpy().view(np.uint64)
            own = part["own"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(leaves)) + 1).tolist(), len(leaves)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if leaf is not None and leaves[a] != leaf and (links := flush()) is not None and len(links):
                    found.append(links)
                leaf = leaves[a]
                held.append((bits[a:b], own[a:b]))
            if found:
                yield batch(found)
        if (links := flush()) is not None and len(links):
            yield batch([links])

    sent = distinct.select("bits").mapInArrow(send, "leaf long, bits long, own boolean")
    return sent.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(search, "a long, b long")


def groups(distinct: DataFrame, radius: int, meetings: int) -> DataFrame:
    """bits, root (the smallest fingerprint of its component) of every fingerprint that has links."""
    roots = components(near_links(distinct, distinct.count(), radius, meetings))
    return roots.select(F.col("node").alias("bits"), "root").unionAll(
        roots.select(F.col("root").alias("bits"), "root").distinct())


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, meetings: int = MEETINGS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable by links).

    One row per input row.  Null and empty texts have fingerprint 0 and link like others.
    Rows with a null doc_id take part; a component without any other id has a null component_id.
    """
    marked = cut_lineage(fingerprints(docs, width, id_col, text_col))
    distinct = cut_lineage(marked.groupBy("bits").agg(F.min("doc_id").alias("least")))
    # Only fingerprints with links change: their components' smallest ids are found among themselves.
    linked = groups(distinct, radius, meetings).join(distinct, "bits")
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(lowest, "root").select("bits", "component_id", F.lit(True).alias("linked"))
    of = distinct.join(named, "bits", "left").select(
        "bits", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return marked.join(of, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def rows_named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """carried (all columns), none (no id), id and text_hash of every row."""
    own = F.col(id_col).cast("long")
    return docs.select(
        F.struct("*").alias("carried"), own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"))


def one_row_of(rows: DataFrame, stays: DataFrame) -> DataFrame:
    """The carried columns of one row for each of none, id, text_hash in ``stays``."""
    keys = ["none", "id", "text_hash"]
    equal = Window.partitionBy(*keys).orderBy(F.xxhash64("carried"))
    return rows.join(stays, keys, "left_semi").withColumn("nth", F.row_number().over(equal)).filter(
        "nth = 1").select("carried.*")


def keep_one_of_each(docs: DataFrame, width: int = 3, radius: int = 2, meetings: int = MEETINGS,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with its own columns: that with the smallest id.

    Rows without an id stay only if their whole group has none; of rows with equal ids the
    one with the smallest hash of the text stays, and one of equal rows.
    """
    marked = fingerprints(docs, width, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash"))
    distinct = cut_lineage(marked.groupBy("bits").agg(first.alias("first")))
    rooted = distinct.join(groups(distinct, radius, meetings), "bits", "left")
    stays = rooted.groupBy(F.coalesce("root", "bits").alias("root")).agg(F.min("first").alias("first")).select(
        F.col("first.none").alias("none"), F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"))
    return one_row_of(rows_named(docs, id_col, text_col), stays)
