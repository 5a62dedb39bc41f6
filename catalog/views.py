"""View sets derived from the given tables."""

from __future__ import annotations

import sys
from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.plans.blocks import RUNS, packed
from polyview.session import lookup, sized, task_parts
from polyview.sources import cells_from_arrays, cells_from_facts, dense_index, match_subjects

# Documents that one task sorts and counts.
DOCUMENTS = 20_000

# Subject key and the embedding dimensions of each view: (first, count).
TWO = ((0, 32), (32, 32))
THREE = ((0, 21), (21, 21), (42, 22))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_frame(spark: SparkSession, sf_dir: str, parts) -> DataFrame:
    """One row per vector, with one array column per view."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        *[
            F.slice(F.col("embedding").cast("array<double>"), start + 1, count).alias(f"v{i}")
            for i, (start, count) in enumerate(parts)
        ],
    )


def embedding_cells(spark: SparkSession, sf_dir: str, parts) -> DataFrame:
    frame = embedding_frame(spark, sf_dir, parts)
    return cells_from_arrays(frame, "row_id", [f"v{i}" for i in range(len(parts))])


def width(parts) -> int:
    return sum(count for _, count in parts)


def customer_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """Per customer: revenue by brand, revenue by part type, orders by priority.

    Every table is read once and moves by its join keys and once by customer; brands, types and priorities
    travel as numbers.  The cells are kept where their customer is, so what follows need not move them.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    n_lines = lines.count()
    columns = [part["p_brand"], part["p_type"], orders["o_orderpriority"]]
    names = [
        part.select(columns[0].alias("name")).distinct(),
        part.select(columns[1].alias("name")).distinct(),
        orders.select(columns[2].alias("name")).distinct(),
    ]
    widths = [n.count() for n in names]

    def numbered(df, column, i):
        """A name that is null has no number, as in an inner join."""
        index = dense_index(names[i], ["name"], f"f{i}", widths[i])
        return df.join(lookup(index, widths[i]), F.col(column) == F.col("name"), "left").drop(column, "name")

    parts = numbered(numbered(part, "p_brand", 0), "p_type", 1)
    lines = sized(sized(lines, n_lines, "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "f0", "f1", "revenue"), n_lines, "l_orderkey")
    none = F.lit(None).cast("bigint")
    bought = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("bigint").alias("row_id"), "f0", "f1", none.alias("f2"), "revenue")
    ordered = numbered(orders.drop("o_orderkey"), "o_orderpriority", 2).select(
        F.col("o_custkey").cast("bigint").alias("row_id"), none.alias("f0"), none.alias("f1"), "f2",
        F.lit(1.0).alias("revenue"))
    facts = bought.unionByName(ordered).repartition(task_parts(spark, n_lines), "row_id")
    items = F.filter(F.array(*[
        F.struct(F.lit(i).cast("int").alias("view_idx"), F.col(f"f{i}").alias("feature_id"), F.col("revenue"))
        for i in range(3)]), lambda x: x["feature_id"].isNotNull())
    cells = facts.select("row_id", F.inline(items)).groupBy("view_idx", "row_id", "feature_id").agg(
        F.sum("revenue").cast("double").alias("value"))
    return cells.persist(), widths


def brand_cells(spark: SparkSession, sf_dir: str, view: int) -> tuple[DataFrame, int]:
    """Per customer: revenue by brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    revenue = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    names = part.select(F.col("p_brand").alias("name")).distinct()
    width = names.count()
    index = dense_index(names, ["name"], "feature_id", width)
    return cells_from_facts(revenue, "o_custkey", "p_brand", F.col("revenue"), view, index, width), width


def event_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """Per user: event counts by type and mean value by type, matched by key to
    the revenue by brand of the customer of the same number."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    names = events.select(F.col("event_type").alias("name")).distinct()
    n_types = names.count()
    types = dense_index(names, ["name"], "feature_id", n_types)
    per_type = events.groupBy("user_id", "event_type").agg(
        F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"))
    counts = cells_from_facts(per_type, "user_id", "event_type", F.col("n"), 0, types, n_types)
    means = cells_from_facts(per_type, "user_id", "event_type", F.col("mean"), 1, types, n_types)
    brand, n_brands = brand_cells(spark, sf_dir, 2)
    cells = counts.unionByName(means).unionByName(brand)
    return match_subjects(cells, 3), [n_types, n_types, n_brands]


GAPS = "\t\n\x0b\f\r"


def _bucket_counts(buckets: int, as_runs: bool = False):
    """Texts in order of their key in; per key the counts of its words' and three-character grams' md5 buckets out."""

    def run(batches):
        places, rare, out = {}, {}, []
        # Up to 255 characters get a number other than 0; grams of them have a slot that holds their bucket plus 1.
        letters, n_letters = np.zeros(sys.maxunicode + 1, np.uint8), 0
        slots = np.zeros(1 << 24, np.int32)

        def bucket(token):
            return int.from_bytes(md5(token.encode(), usedforsecurity=False).digest()[:4], "big") % buckets

        def place(known, token):
            if len(known) > 1 << 20:
                known.clear()
            known[token] = found = bucket(token)
            return found

        def grams(text):
            """The bucket of every three characters."""
            nonlocal n_letters
            c = np.frombuffer(text.encode("utf-32-le"), "<u4")
            x = letters[c]
            if n_letters < 255 and not x.all():
                new = np.unique(c[x == 0])[:255 - n_letters]
                letters[new] = np.arange(n_letters + 1, n_letters + 1 + len(new))
                n_letters += len(new)
                x = letters[c]
            x = x.astype(np.int32)
            slot = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
            known = (x[:-2] > 0) & (x[1:-1] > 0) & (x[2:] > 0)
            found = slots[slot]
            new = np.flatnonzero(known & (found == 0))
            if len(new):
                for i in new[np.unique(slot[new], return_index=True)[1]].tolist():
                    slots[slot[i]] = bucket(text[i:i + 3]) + 1
                found = slots[slot]
            found -= 1
            for i in np.flatnonzero(~known).tolist():
                g = text[i:i + 3]
                found[i] = rare[g] if g in rare else place(rare, g)
            return found

        def counts(text):
            spaced = text
            for gap in GAPS:
                spaced = spaced.replace(gap, " ")
            words = Counter(spaced.split(" "))
            words.pop("", None)
            total = np.bincount(grams(text) + buckets, minlength=2 * buckets) if len(text) > 2 else np.zeros(2 * buckets, np.int64)
            np.add.at(total, np.array([places[w] if w in places else place(places, w) for w in words], np.int64), list(words.values()))
            return total

        def written():
            sizes = [len(at) for _, at, _ in out]
            at = np.concatenate([at for _, at, _ in out])
            if as_runs:
                # Two runs a document, of which the empty ones are left out.
                ends = np.cumsum([0] + [x for _, found, _ in out for n in [int(np.searchsorted(found, buckets))] for x in (n, len(found) - n)])
                some = np.flatnonzero(np.diff(ends))
                return packed(some % 2, pa.array([k for k, _, _ in out], pa.int64()).take(pa.array(some // 2)),
                              np.append(ends[some], ends[-1]), at % buckets, np.concatenate([v for _, _, v in out]).astype(float), buckets)
            return pa.RecordBatch.from_arrays([
                pa.array((at // buckets).astype(np.int32)),
                pa.array([k for k, _, _ in out], pa.int64()).take(pa.array(np.repeat(np.arange(len(out)), sizes))),
                pa.array(at % buckets), pa.array(np.concatenate([v for _, _, v in out]).astype(float)),
            ], names=["view_idx", "row_id", "feature_id", "value"])

        key = total = None
        held = 0
        for batch in batches:
            for k, text in zip(batch.column("row_id").to_pylist(), batch.column("text")):
                found = counts(text.as_py())
                if total is not None and k == key:
                    total += found
                    continue
                if total is not None:
                    at = np.flatnonzero(total)
                    out.append((key, at, total[at]))
                    held += len(at)
                    if held > 1 << 18:
                        yield written()
                        out, held = [], 0
                key, total = k, found
        if total is not None:
            at = np.flatnonzero(total)
            out.append((key, at, total[at]))
            yield written()

    return run


def document_cells(spark: SparkSession, sf_dir: str, buckets: int = 16384) -> tuple[DataFrame, list[int]]:
    """Per document: hashed word counts and hashed counts of three-character grams.

    Whole texts, read once; both views are counts of md5 buckets.  The texts move to their key, not the
    cells, which are several times larger; texts of one key are counted together.
    """
    cells = _placed_texts(spark, sf_dir).mapInArrow(
        _bucket_counts(buckets), "view_idx int, row_id bigint, feature_id bigint, value double")
    return cells, [buckets, buckets]


def document_runs(spark: SparkSession, sf_dir: str, buckets: int = 16384) -> DataFrame:
    """The cells of ``document_cells`` as runs, so that no row is made of a cell."""
    return _placed_texts(spark, sf_dir).mapInArrow(_bucket_counts(buckets, True), RUNS)


def _placed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("row_id"), "text")
    placed = docs.filter(F.col("text").isNotNull()).repartition(
        task_parts(spark, docs.count(), DOCUMENTS), "row_id").sortWithinPartitions("row_id")
    return placed.select("row_id", F.lower("text").alias("text"))
