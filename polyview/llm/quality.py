"""Quality by likeness to trusted text, with DataFrame functions only.

Words and word pairs are hashed into a table that grows with the number of documents.
Two multinomials are counted over it: of trusted documents and of all.  A document's
score is its mean log-likelihood ratio per gram.  Trusted counts are kept apart for
two halves of the texts, split by the text's hash; a text is judged by the counts of
the half that it is not in, so its own words don't speak for it.  A document stays if
its score reaches a threshold that is calibrated on the labels and it breaks none of
the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.session import cut_lineage, lookup, scan_tasks

# The table has the next power of two above this times the fourth root of the documents' number.
TABLE = 1 << 13
# Added to each bucket's raw count; the trusted counts get as much of their own smaller total.
SMOOTHING = 10.0
# At most this share of the good labelled documents may be lost to the threshold.
LOST = 0.02
# Scores are binned to so much for the calibration.
BIN = 1e-3
# Log ratios are whole multiples of its inverse, so that sums are exact in any order.
UNIT = 1 << 24
# Rows of equal ids and texts share a score.
KEY = ["none", "id", "print"]

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def with_base_columns(rows: DataFrame) -> DataFrame:
    """Adds the base counts to rows of text and words.

    n_repeat_words is how many words stand in a window of three that occurs twice or
    more; a word counts once however many windows hold it.  Windows are compared by
    64-bit hash, and sorted with their places only where some hash repeats.
    Intermediate arrays are columns of their own, so each is computed once.
    """
    text, words = F.coalesce(F.col("text"), F.lit("")), F.col("words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "_lines": lines,
        "_windows": F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
    }).drop("text", "words")
    windows, ranked = F.col("_windows"), F.col("_ranked")
    rows = rows.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_ranked": F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    }).drop("_lines", "_windows")
    # A repeated window equals a neighbour in the sorted array.
    repeated = F.filter(ranked, lambda x, i: F.get(ranked, i - 1)["h"].eqNullSafe(x["h"]) | F.get(ranked, i + 1)["h"].eqNullSafe(x["h"]))
    places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    # Each repeated window adds the words up to the next one's start, three at most.
    covered = F.aggregate(
        places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(3))).alias("n")),
        lambda s: s["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_ranked")


def known_ids(labels: DataFrame) -> tuple[DataFrame, int]:
    """known_id, good, bad of every labelled id, and their number; good: quality 1 and not toxic, bad: quality 0 or toxic."""
    quality, toxic = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    known = cut_lineage(labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("known_id")).agg(
        F.coalesce(F.min((quality == 1) & (toxic == 0)), F.lit(False)).alias("good"),
        F.coalesce(F.max((quality == 0) | (toxic == 1)), F.lit(False)).alias("bad")))
    return known, known.count()


def table_size(rows: int) -> int:
    return 1 << math.ceil(math.log2(TABLE * max(1, rows) ** 0.25))


def keyed(docs: DataFrame, id_col: str, text_col: str, *carried: Column) -> DataFrame:
    """none (no id), id, print (of the text), text and the carried columns."""
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(text).alias("print"),
                       text.alias("text"), *carried)


def grams(rows: DataFrame, buckets: int, *columns: str) -> DataFrame:
    """The columns and bucket, a row for each word and each pair of neighbours; half is that of the text.

    Rows without words and last words without a neighbour have null buckets besides.  Grams are hashed row by row,
    in generated code; functions of arrays' elements would be interpreted.
    """
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("half", F.pmod("print", F.lit(2)).cast("int"))
    words = F.col("words")
    following = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    # explode() would add a filter on the array's size, and with it a second computation of the array.
    pairs = rows.select(*columns, "half", F.explode_outer(F.arrays_zip(words.alias("word"), following.alias("following"))).alias("pair"))
    word, following = F.col("pair.word"), F.col("pair.following")

    def bucket(*parts):
        return F.when(parts[-1].isNotNull(), F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int"))

    return pairs.select(*columns, "half", F.explode(F.array(bucket(word), bucket(word, following))).alias("bucket"))


def ratio_table(rows: DataFrame, known: DataFrame, n_known: int, buckets: int, smoothing: float = SMOOTHING) -> DataFrame | None:
    """bucket, ratio0, ratio1: log ratios for texts of either half, in whole units, for all buckets that occur.

    The raw counts are those of all documents, the trusted ones those of the good documents of the
    other half.  None without good documents in both halves.
    """
    good = known.filter("good").select("known_id")
    marked = rows.join(lookup(good, n_known), (F.col("id") == F.col("known_id")) & ~F.col("none"), "left").withColumn(
        "good", F.col("known_id").isNotNull())
    # Few tasks sum up much each, so that their partial sums are small next to their input.
    each = scan_tasks(grams(marked, buckets, "good"))
    good_of = [F.sum((F.col("good") & (F.col("half") == h)).cast("long")) for h in (0, 1)]
    counts = cut_lineage(each.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), good_of[0].alias("good0"), good_of[1].alias("good1")).filter("bucket IS NOT NULL"))
    total = counts.agg(*[F.sum(c).alias(c) for c in ("raw", "good0", "good1")]).first()
    if not total["good0"] or not total["good1"]:
        return None

    def ratio(name):
        value = F.log((F.col(name) * F.lit(total["raw"] / total[name]) + smoothing) / (F.col("raw") + smoothing))
        return F.round(value * UNIT).cast("long")

    return counts.select("bucket", ratio("good1").alias("ratio0"), ratio("good0").alias("ratio1"))


def scores_of(rows: DataFrame, table: DataFrame | None, buckets: int) -> DataFrame:
    """none, id, print, n_grams, score (the mean log ratio per gram) of every distinct id and text that has words.

    The table has a row for each of the buckets, whose number is known, so it is broadcast; what is
    summed up travels as one row per text.
    """
    each = grams(rows, buckets, *KEY)
    if table is None:
        ratio = F.lit(0).cast("long")
    else:
        each = each.join(F.broadcast(table), "bucket", "left")
        ratio = F.when(F.col("half") == 0, F.col("ratio0")).otherwise(F.col("ratio1"))
    # Of equal rows, each adds the same to both sums.
    return each.groupBy(*KEY).agg(F.count("bucket").alias("n_grams"), F.sum(ratio).alias("total")).filter("n_grams > 0").select(
        *KEY, "n_grams", (F.col("total") / F.col("n_grams") / F.lit(UNIT)).alias("score"))


def threshold_of(bins: list[tuple[float, int, int]], lost: float = LOST, width: float = BIN) -> float | None:
    """The score that tells good from bad best: most bad rejected less good rejected, in shares, with at most ``lost`` of the good.

    bins: (number, good, bad); a bin holds scores from number x width on.  The threshold is the lower edge of a
    bin, the lowest of equal ones.  Without good ones there is none.
    """
    goods, bads = (sum(b[c] for b in bins) for c in (1, 2))
    if not goods:
        return None
    best, at, good, bad = -1.0, None, 0, 0
    for number, here_good, here_bad in sorted(bins):
        if good > lost * goods:
            break
        gain = bad / max(1, bads) - good / goods
        if gain > best:
            best, at = gain, number
        good, bad = good + here_good, bad + here_bad
    return at * width


def calibrated(scores: DataFrame, known: DataFrame, n_known: int) -> float | None:
    """The threshold for the labelled documents that are long enough for the base rules."""
    labelled = scores.filter("NOT none AND n_grams >= 99").join(
        lookup(known.filter("good OR bad"), n_known), F.col("id") == F.col("known_id"))
    found = labelled.groupBy(F.floor(F.col("score") / BIN).cast("long").alias("bin")).agg(
        F.sum((F.col("good") & ~F.col("bad")).cast("long")).alias("good"), F.sum(F.col("bad").cast("long")).alias("bad")).collect()
    return threshold_of([(r["bin"], r["good"], r["bad"]) for r in found])


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float | None, id_col: str, text_col: str) -> DataFrame:
    """none, id, print, the base counts, score, base_failed and kept of every row."""
    rows = keyed(docs, id_col, text_col)
    buckets = table_size(docs.count())
    known, n_known = known_ids(labels)
    table = ratio_table(rows, known, n_known, buckets)
    scores = cut_lineage(scores_of(rows, table, buckets))
    if threshold is None and table is not None:
        threshold = calibrated(scores, known, n_known)
    base = with_base_columns(rows.withColumn("words", words_of(F.col("text"))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = F.lit(True) if threshold is None else F.col("score") >= threshold
    return base.join(scores.drop("n_grams"), KEY, "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn(
        "base_failed", failed).withColumn("kept", ~failed & good)


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept.

    One row per input row; rows of equal texts have equal verdicts.  Null and empty texts have no words and
    fail the base rules.  Labels of the same id count as bad if one of them is.  Without good documents in
    both halves all scores are 0 and the base rules decide, as they do without any labels.
    """
    return verdicts(docs, labels, threshold, id_col, text_col).select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "score", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose verdict is kept, with their own columns."""
    lost = cut_lineage(verdicts(docs, labels, threshold, id_col, text_col).filter(~F.col("kept")).select(*KEY).distinct())
    rows = keyed(docs, id_col, text_col, F.struct("*").alias("carried")).drop("text")
    return rows.join(lookup(lost, lost.count()), KEY, "left_anti").select("carried.*")
