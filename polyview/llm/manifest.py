"""Merkle manifest of a table: a tree of three per source, and one over the sources.

Rows are placed by one range sort: every row learns its position among its
source's rows.  Nodes are appended in order, a block of ``WIDTH ** HEIGHT``
consecutive positions at a time, wherever the block is.  A node joins the open
run of its level; when a run is complete, or its tree is, all rows below it get
the run's other digests appended to their witnesses and the run's digest is
appended one level up.  The roots of all blocks are the nodes of the next round,
appended in the same way, until one node per tree is left; the subroots of the
sources are the nodes of the last tree.  On the way back every round extends the
witnesses of its blocks by those of the block roots.

A task holds one block's nodes and their witnesses; what the driver sees are two
counts per task and the root.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.session import cut_lineage

WIDTH = 3
# Levels of a block: 243 nodes.
HEIGHT = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TREE = ["known", "name"]


def digest_of(parts: list[bytes]) -> bytes:
    return sha256("".join([p.hex() for p in parts]).encode()).digest()


class Subtrees:
    """Nodes appended in order; each open run's members carry what they have of their witnesses.

    A witness is a path, one byte a level (place in the run + 4 x the run's length), and
    the digests of the other members, level by level, left to right.
    """

    def __init__(self, witnesses: bool):
        self.runs: list[list[tuple[bytes, int, int]]] = [[]]
        self.count = 0
        self.paths: list[bytearray] | None = [] if witnesses else None
        self.siblings: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        if self.paths is not None:
            self.paths.append(bytearray())
            self.siblings.append(bytearray())
        self.count += 1
        self._join(0, digest, self.count - 1, self.count)

    def _join(self, level: int, digest: bytes, first: int, end: int) -> None:
        if level == len(self.runs):
            self.runs.append([])
        self.runs[level].append((digest, first, end))
        if len(self.runs[level]) == WIDTH:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        digests = [digest for digest, _, _ in run]
        if self.paths is not None:
            for place, (_, first, end) in enumerate(run):
                others = b"".join(digests[:place] + digests[place + 1:])
                for i in range(first, end):
                    self.paths[i].append(place + 4 * len(run))
                    self.siblings[i] += others
        self._join(level + 1, digest_of(digests), run[0][1], run[-1][2])

    def root(self, height: int | None) -> bytes:
        """Completes the open runs up to one node, at ``height`` if given."""
        level = 0
        while level != height and (height is not None or len(self.runs[level]) != 1 or any(self.runs[level + 1:])):
            if self.runs[level]:
                self._complete(level)
            level += 1
        return self.runs[level][0][0]


def fold(digest: bytes, path: bytes, siblings: str) -> str:
    """The root, in hex, that a node's digest and its witness lead to."""
    folded, at = digest.hex(), 0
    for step in path:
        place, others = step & 3, (step >> 2) - 1
        end = at + 64 * others
        mid = at + 64 * place
        folded = sha256((siblings[at:mid] + folded + siblings[mid:end]).encode()).hexdigest()
        at = end
    return folded


def written(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """known, name (the source), doc_id, digest, tampered (null where the row was not changed)."""
    def leaf(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*[written(F.col(c)) for c in FIELDS[:-1]], written(text)), 256))

    text, number = F.col("text"), F.col("doc_id").cast("long")
    hit = (F.crc32(number.cast("string")) % 2 == 0) & text.contains("\n")
    return docs.select(*FIELDS).select(
        F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("name"),
        number.alias("doc_id"), leaf(text).alias("digest"),
        F.when(hit, leaf(F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The nodes with pos, the place among those of their tree (known, name) by ``order``, from 0.

    Equal nodes may stand in either order, so one key's rows may lie in many ranges.
    """
    order = [*TREE, *[F.col(c).asc_nulls_first() for c in order], "digest", "tie"]
    once = cut_lineage(nodes.withColumn("tie", F.monotonically_increasing_id()))
    ranged = cut_lineage(once.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn(
        "part", F.spark_partition_id()))
    # Only the first tree of a range can have begun in an earlier one.
    ends = ranged.groupBy("part", *TREE).count().groupBy("part").agg(
        F.min(F.struct(*TREE, "count")).alias("first"), F.max(F.struct(*TREE, "count")).alias("last"),
        (F.count(F.lit(1)) == 1).alias("single")).collect()
    before, tree, seen = {}, None, 0
    for row in sorted(ends, key=lambda r: r["part"]):
        first, last = row["first"], row["last"]
        before[row["part"]] = seen if tuple(first[:2]) == tree else 0
        seen = last["count"] + (before[row["part"]] if row["single"] else 0)
        tree = tuple(last[:2])

    def number(batches):
        here, at = None, 0
        for batch in batches:
            places = []
            for key in zip(batch["known"].to_pylist(), batch["name"].to_pylist(), batch["part"].to_pylist(), strict=True):
                if key != here:
                    at, here = (before[key[2]] if here is None else 0), key
                places.append(at)
                at += 1
            yield batch.drop_columns(["part"]).append_column("pos", pa.array(places, pa.int64()))

    kept = [f"{n} {t}" for n, t in ranged.dtypes if n != "part"]
    return ranged.mapInArrow(number, ", ".join([*kept, "pos long"]))


def runs_of_blocks(batch: pa.RecordBatch):
    """(block, first row, end) of the consecutive rows of each block in a batch."""
    keys = list(zip(batch["known"].to_pylist(), batch["name"].to_pylist(), batch["block"].to_pylist(), strict=True))
    at = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            yield keys[at], at, i
            at = i


def by_block(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / WIDTH ** height).cast("long"))


def height_of(block: int, count: int, height: int) -> int | None:
    """Where a block's root stands: a first block that isn't full is a whole tree."""
    return None if block == 0 and count < WIDTH ** height else height


def block_roots(nodes: DataFrame, height: int) -> DataFrame:
    """known, name, pos (of the block among its tree's), digest."""

    def run(batches):
        here, tree = None, None

        def row():
            return (*here, tree.root(height_of(here[2], tree.count, height)))

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.bool_(), pa.string(), pa.int64(), pa.binary()), strict=True)],
                [*TREE, "pos", "digest"])

        for batch in batches:
            rows, digests = [], batch["digest"].to_pylist()
            for key, first, end in runs_of_blocks(batch):
                if key != here:
                    if here is not None:
                        rows.append(row())
                    here, tree = key, Subtrees(False)
                for digest in digests[first:end]:
                    tree.append(digest)
            if rows:
                yield out(rows)
        if here is not None:
            yield out([row()])

    keyed = by_block(nodes.select(*TREE, "pos", "digest"), height)
    return keyed.repartition(*TREE, "block").sortWithinPartitions(*TREE, "block", "pos").mapInArrow(
        run, "known boolean, name string, pos long, digest binary")


def extended(nodes: DataFrame, above: DataFrame, height: int, finish, schema: str) -> DataFrame:
    """The nodes with whole witnesses, as ``finish`` makes rows of them.

    above: known, name, block, path, siblings, subroot; the witness of every block's root.
    finish(rows): batches of rows; a row has the node's columns (a dict), path, siblings, subroot.
    """
    keyed = by_block(nodes, height)
    own = [c for c in keyed.columns if c not in (*TREE, "block")]

    def run(batches):
        here, tree, root, held = None, None, None, []

        def rows():
            tree.root(height_of(here[2], tree.count, height))
            for node, path, siblings in zip(held, tree.paths, tree.siblings, strict=True):
                yield here, node, bytes(path) + root[0], bytes(siblings) + root[1], root[2]

        for batch in batches:
            nodes_in, uppers = batch["node"].to_pylist(), batch["upper"].to_pylist()
            for key, first, end in runs_of_blocks(batch):
                if key != here:
                    if here is not None:
                        yield finish(rows())
                    here, tree, held = key, Subtrees(True), []
                for node, upper in zip(nodes_in[first:end], uppers[first:end], strict=True):
                    if node is None:
                        root = (upper["path"], upper["siblings"], upper["subroot"])
                    else:
                        held.append(node)
                        tree.append(node["digest"])
        if here is not None:
            yield finish(rows())

    rows = keyed.select(*TREE, "block", F.struct(*own).alias("node")).unionByName(
        above.select(*TREE, "block", F.struct("path", "siblings", "subroot").alias("upper")), allowMissingColumns=True)
    # The block's witness comes first.
    return rows.repartition(*TREE, "block").sortWithinPartitions(
        *TREE, "block", F.col("node.pos").asc_nulls_first()).mapInArrow(run, schema)


MANIFEST = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
            "verified boolean")
UPPER = "known boolean, name string, block long, path binary, siblings binary, subroot binary"
UPPER_TYPES = (pa.bool_(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _batch(rows: list[tuple], names: list[str], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _to_blocks(rows) -> pa.RecordBatch:
    """A node of a round is the root of the block that has its number."""
    out = [(key[0], key[1], node["pos"], path, siblings, subroot) for key, node, path, siblings, subroot in rows]
    return _batch(out, [*TREE, "block", "path", "siblings", "subroot"], UPPER_TYPES)


def _to_sources(rows) -> pa.RecordBatch:
    """A node of the tree of sources is the root of its source's tree."""
    out = [(node["source_known"], node["source_name"], 0, path, siblings, node["digest"]) for _, node, path, siblings, _ in rows]
    return _batch(out, [*TREE, "block", "path", "siblings", "subroot"], UPPER_TYPES)


def rounds_of(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, and so on; the last has one root per tree."""
    rounds = [nodes]
    while True:
        rounds.append(cut_lineage(block_roots(rounds[-1], height)))
        if not (rounds[-1].agg(F.max("pos")).first()[0] or 0):
            return rounds


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per input row.

    Rows without a source are a source of their own, before the others.  Rows without a
    doc_id stand first in their source and are not tampered with; of equal ids the one with
    the smaller leaf stands first, equal rows get neighbouring places.  Empty tables have no rows.
    """
    rounds = rounds_of(placed(leaves(docs), ["doc_id"]), height)
    subroots = rounds.pop().select(
        F.lit(True).alias("known"), F.lit("").alias("name"), F.col("known").alias("source_known"),
        F.col("name").alias("source_name"), "digest")
    upper = rounds_of(placed(subroots, ["source_known", "source_name"]), height)
    top = upper.pop().first()
    spark = docs.sparkSession
    if top is None:
        return spark.createDataFrame([], MANIFEST)
    root = bytes(top["digest"])
    above = spark.createDataFrame([(True, "", 0, b"", b"", root)], UPPER)
    for nodes in reversed(upper[1:]):
        above = extended(nodes, above, height, _to_blocks, UPPER)
    above = extended(upper[0], above, height, _to_sources, UPPER)
    for nodes in reversed(rounds[1:]):
        above = extended(nodes, above, height, _to_blocks, UPPER)
    name = root.hex()

    def finish(rows):
        out = []
        for _, node, path, siblings, subroot in rows:
            others = siblings.hex()
            folded = fold(node["tampered"] or node["digest"], path, others)
            out.append((node["doc_id"], node["digest"].hex(), subroot.hex(), name,
                        sha256(others.encode()).hexdigest(), folded, folded == name))
        return _batch(out, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                      (pa.int64(), *[pa.string()] * 5, pa.bool_()))

    return extended(rounds[0], above, height, finish, MANIFEST)
