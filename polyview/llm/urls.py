"""URL filter: host and path rules, then a logistic regression; DataFrame functions only.

The model reads hashed character n-grams of host and path.  It is trained from a
small table of labelled URLs (its size is checked), so fitting costs the same
whatever the size of the filtered table; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = (3, 4, 5)
FEATURES = 1 << 18
# A training table may have so many rows.
MOST_LABELLED = 100_000


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]

# The labelled table: hosts and paths put together from these words.
THEMES = {
    "gambling": "casino poker bets betting jackpot slots roulette bingo lottery wager odds spins",
    "medicine": "pills viagra meds pharmacy cialis tablets steroid dosage",
    "adult": "adult xxx porn sex cams escort nude hookup erotic fetish",
    "spam": "spam backlinks linkfarm seo clickbait doorway bulkmail traffic",
    "tracking": "ads adserver tracker pixel popup banner click redirect",
    "money": "payday loans cash forex bitcoin crypto profit riches",
    "fakes": "replica counterfeit knockoff fakes cracked keygen warez torrent",
    "fraud": "phishing malware scam hacked prize winner giveaway claim",
}
LURES = "free cheap best hot win buy fast online top vip royal big x".split()
PLACES = "hub club zone shop farm world serve deals city land spot link bay".split()
SUBJECTS = """
garden history library kitchen weather museum science railway harbour village school hospital algebra physics music
poetry grammar castle river mountain bicycle pottery theatre journal archive council market orchard astronomy geology
botany chess recipe novel painter violin carpenter teacher student research atlas bridge forest island lantern meadow
""".split()
KINDS = "news guide notes review forum society daily online data tools world shop city club hub land link spot".split()
SYLLABLES = "an ba co den er fi gra hul in jo kel lo mar nes or pra quin ron sta th ul ver wen yor zel ti on".split()
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SECTIONS = "articles page view post item topic product about search category".split()
FRONTS = ["", "", "www.", "m.", "blog.", "shop."]
ENDS = ["com", "net", "org", "info", "example.com", "example.net", "example.org"]
TONGUES = "en de fr es it".split()
PER_WORD = 20


def _picker(*key) -> Callable[[Sequence[str]], str]:
    """Picks entries of lists, the same ones for the same key."""
    digest = int.from_bytes(hashlib.sha256("/".join(map(str, key)).encode()).digest(), "big")

    def pick(options: Sequence[str]) -> str:
        nonlocal digest
        digest, place = divmod(digest, len(options))
        return options[place]

    return pick


def _url(pick, host: str) -> str:
    """A URL of the host; paths say nothing about the label."""
    number = str(int(pick(range(1, 10000))))
    path = pick([f"/{pick(TONGUES)}/{number}", f"/{pick(SECTIONS)}/{number}", f"/{pick(TONGUES)}/{pick(SECTIONS)}"])
    return f"{pick(['http', 'https'])}://{pick(FRONTS)}{host}.{pick(ENDS)}{path}{pick(['', '', '/', '.html'])}"


def labelled_table() -> list[tuple[str, float, bool]]:
    """(url, label, held_out): 1 is unwanted; one host in five is held out, by its hash, whatever stands around it.

    Unwanted hosts hold a word of a theme beside a lure, a place or another word of the theme.  Wanted ones are
    made of subjects and kinds, or are names without a meaning, of syllables or of any letters.
    """
    rows = []
    for theme in THEMES.values():
        words = theme.split()
        for word in words:
            for n in range(PER_WORD):
                pick = _picker("unwanted", word, n)
                pair = [word, pick(pick([LURES, PLACES, words]))]
                rows.append((pick([pair, pair[::-1]]), 1.0, pick))
    for subject in SUBJECTS:
        for n in range(PER_WORD):
            pick = _picker("wanted", subject, n)
            pair = [subject, pick(pick([KINDS, SUBJECTS]))]
            rows.append((pick([pair, pair[::-1]]), 0.0, pick))
    for n in range(PER_WORD * len(SUBJECTS)):
        pick = _picker("syllables", n)
        rows.append((["".join(pick(SYLLABLES) for _ in range(pick(range(2, 5))))], 0.0, pick))
        pick = _picker("letters", n)
        rows.append((["".join(pick(LETTERS) for _ in range(pick(range(4, 13))))], 0.0, pick))
    hosts = [(pick(["-", "-", ""]).join(parts), label, pick) for parts, label, pick in rows]
    return [(_url(pick, host), label, _picker("part", host)(range(5)) == 0) for host, label, pick in hosts]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then the path up to
    ``?``, ``#`` or the end.  Both are empty without ``://`` and for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """All n-grams of the framed host and path, each marked with where it is from."""

    def cut(mark: str, text: Column, n: int) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.when(F.length(framed) >= n, F.sequence(F.lit(1), F.length(framed) - (n - 1))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(f"{mark}{n}"), F.substring(framed, i, F.lit(n))))

    return F.concat(*(cut("h", host, n) for n in SIZES), *(cut("p", path, n) for n in SIZES))


def labelled_urls(spark: SparkSession, held_out: bool = False) -> DataFrame:
    """The rows of the labelled table to train on, or those held out: url, label."""
    return spark.createDataFrame(
        [(url, label) for url, label, out in labelled_table() if out == held_out], "url string, label double")


def with_grams(rows: DataFrame) -> DataFrame:
    """Adds host, path and the feature vector to rows with the column url."""
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("grams", grams(F.col("host"), F.col("path")))
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="hashed")
    # Unit length, so that long URLs do not weigh more than short ones.
    return Normalizer(inputCol="hashed", outputCol="features").transform(hashed.transform(rows)).drop("grams", "hashed")


def train(labelled: DataFrame, most: int = MOST_LABELLED) -> LogisticRegressionModel:
    """Fit on rows of url and label (1 unwanted); a table of more than ``most`` rows is refused."""
    known = with_grams(labelled.select("url", "label").filter("label is not null"))
    if known.limit(most + 1).count() > most:
        raise ValueError(f"the labelled table has more than {most} rows")
    fit = LogisticRegression(regParam=1e-5, maxIter=100, standardization=False, aggregationDepth=2)
    return fit.fit(known)


def by_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; of equal names the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.name))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, threshold: float = 0.5,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score (the model's probability of block).

    One row per input row.  The longest rule that fits decides, else the model: block from
    ``threshold`` on.  Null URLs and URLs without ``://`` have an empty host and path, fit no
    rule and are judged by the model like others.
    """
    spark = pages.sparkSession
    model = train(labelled if labelled is not None else labelled_urls(spark))
    rows = with_grams(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")))
    rows = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), 1))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")
