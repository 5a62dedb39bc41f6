"""The other operators and the pipeline against brute force on small fixtures."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

import corpus_pipeline
from polyview.llm import quality, urls
from polyview.llm.chat import DEFAULT, Formatter, Reader, format_conversations, read_back
from polyview.llm.components import components
from polyview.llm.licenses import BASE, FUZZY, LOWER, WORD, Scanner, scan_licenses
from polyview.llm.neighbours import nearest
from polyview.llm.pii import Permutation, Pseudonymiser, luhn, pseudonymise
from polyview.llm.quality import judge
from polyview.llm.simhash import Tree, keep_one_of_each, leaf_links, merge, near_duplicates
from polyview.llm.urls import RULES, filter_urls

SPLIT = re.compile("[^\x20\x09-\x0D]+").findall


# Personal data

def test_permutations_are_bijections_without_fixed_points():
    for size in (1, 2, 3, 7, 100, 999):
        p = Permutation(b"key", "t", size)
        new = [p.apply(x) for x in range(size)]
        assert sorted(new) == list(range(size)) and [p.undo(y) for y in new] == list(range(size))
        assert size == 1 or all(a != b for a, b in enumerate(new))


def test_formats_stay_valid_and_equal_values_linked():
    text = ("und.34@mail7.example.com; +1 (017) 555-7713%%% 233.254.104.120. 4417744280351547 4929 3483 8530 6306 "
            "2020-02-29 29/2/2020 123-45-6789 DE89370400440532013000 GB82 WEST 1234 5698 7654 32")
    one, undo = Pseudonymiser(b"k"), Pseudonymiser(b"k", undo=True)
    new, found = one.replace(text)
    assert [k for _, _, k, _ in found] == ["email", "phone", "ipv4", "card", "card", "date", "date", "ssn", "iban", "iban"]
    assert undo.replace(new)[0] == text and len(one.find(new)) == len(found)
    for _, _, kind, value in found:
        if kind == "card":
            digits = value.replace(" ", "")
            assert int(digits[-1]) == luhn(digits[:-1])
    days = [re.split("[-/]", v) for _, _, k, v in found if k == "date"]
    assert [int(x) for x in days[0]] == [int(x) for x in days[1][::-1]]
    for clean in ("9807915762804490", "999.1.1.1", "1.2.3.4.5", "2021-13-01", "version 3.0", "000-12-3456", "a @ b"):
        assert one.replace(clean) == (clean, [])


def test_pseudonym_rows(make):
    pairs = [(1, None), (2, ""), (3, "mail a.b1@c.org"), (4, "again a.b1@c.org"), (4, "again a.b1@c.org"), (None, "x")]
    rows = pseudonymise(make(pairs)).collect()
    mails = {r.text.split()[-1] for r in rows if r.n_found}
    assert len(rows) == 6 and len(mails) == 1 and mails != {"a.b1@c.org"}
    assert {(r.spans[0].start, r.spans[0].length) for r in rows if r.doc_id == 3} == {(5, 10)}
    assert not pseudonymise(make(pairs).limit(0)).collect()


# Licenses

def test_license_places_and_edits(make):
    scanner, rng = Scanner(BASE, FUZZY), random.Random(3)
    words = ["cc", "by", "CC", "general", "public", "license", "all", "rights", "reserved", "nc", "é", "\x00", "licence"]
    for _ in range(600):
        text = "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "é", ""]) for _ in range(rng.randrange(25)))
        own, (joined, _) = WORD.findall(text.translate(LOWER)), scanner.reduce(text)
        hits = scanner.scan(joined)
        want = sorted((b.label, i) for b in BASE for i in range(len(own))
                      if own[i:i + len(b.words.split())] == b.words.split())
        assert sorted((h.label, h.first) for h in hits if h.base) == want
        for notice, pattern in list(zip(scanner.notices, scanner.patterns, strict=True))[len(BASE):]:
            if pattern.search(joined):
                assert any(h.label == notice.label and not h.base for h in hits)
    text = "See: Relesed under the MIT  License. All rights reserved, CC-BY"
    row = scan_licenses(make([(1, text)])).collect()[0]
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels, row.labels) == (
        11, 2, 6, 9, "cc-by,reserved", "cc-by,mit,reserved")
    spans = {(s.label, text[s.start:s.start + s.length], s.edits) for s in row.spans}
    assert ("mit", "Relesed under the MIT  License", 1) in spans
    rows = scan_licenses(make([(1, None), (2, "")])).collect()
    assert all((r.n_words, r.n_base, r.first_word, r.labels, r.score) == (0, 0, None, "", 0.0) for r in rows)


# Neighbours

def brute(ids, x, every, k):
    out = []
    for i in np.flatnonzero(ids % every == 0):
        scores = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:k]
        out += [(int(ids[i]), n + 1, int(ids[j]), float(scores[j])) for n, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("factor", [1.0, 1.05])
def test_nearest(spark, factor):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 6)), 2)
    x[100:180] = x[100]  # copies tie
    ids = rng.permutation(400) * 3
    odd = [(4000, None), (4020, []), (4040, [0.0] * 6), (4060, [math.nan] * 6), (4080, [None] * 6),
           (4100, [math.inf] * 6), (None, [1.0] * 6)]
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)] + [(i, v, 1) for i, v in odd]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in nearest(frame, 20, 20, factor, per_shard=90, per_block=8).collect())
    want = brute(ids, x, 20, 20)
    if factor == 1.0:
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)
    else:
        assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.9 * len(want)
    assert not nearest(frame.limit(0)).collect()


# Near-duplicates

def plain_fingerprint(text):
    words = SPLIT("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    parent = np.arange(n)
    links = np.array(list(links), dtype=int).reshape(-1, 2)
    merge(parent, links[:, 0], links[:, 1])
    return parent


@pytest.mark.parametrize("depth", [2, 4, 8])
def test_tree_meets_every_close_pair(depth):
    rng, radius = np.random.default_rng(0), 2
    bits = set(rng.integers(0, 2**63, 60, dtype=np.uint64).tolist())
    for b in list(bits):
        for _ in range(3):
            for _ in range(int(rng.integers(1, 4))):
                b ^= 1 << int(rng.integers(64))
            bits.add(b)
    bits = np.array(sorted(bits), np.uint64)
    tree = Tree(depth, radius)
    row, leaf = tree.visits(bits)
    own, at, links = np.arange(len(row)) < len(bits), {int(b): i for i, b in enumerate(bits)}, []
    order = np.argsort(leaf, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
        if own[part].any():
            links += [(at[int(a)], at[int(b)]) for a, b in leaf_links(bits[row[part]], own[part], radius)]
    close = np.bitwise_count(bits[:, None] ^ bits[None]) <= radius
    assert (roots(len(bits), links) == roots(len(bits), zip(*np.nonzero(close), strict=True))).all()


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(40)] + [(5, 5), (7, 3)] + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(160, links)
    assert got == {i: int(r) for i, r in enumerate(want) if i != r}
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def test_near_duplicates(make):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    pairs = [(i * 7 % 61 + 10, t) for i, t in enumerate(texts)]
    for i in range(40):  # copies and copies with an edit
        words_of = texts[i].split()
        words_of[rng.randrange(len(words_of))] = "EDIT" if i % 2 else words_of[0]
        pairs.append((200 + i, " ".join(words_of)))
    pairs += [(300, None), (301, ""), (302, "Two WORDS"), (303, "two words"), (None, texts[3]), (None, "alone without id"),
              (200, texts[0]), (200, texts[0])]
    marks = [plain_fingerprint(t or "") for _, t in pairs]
    close = np.bitwise_count(np.array(marks, np.uint64)[:, None] ^ np.array(marks, np.uint64)[None]) <= 2
    group = roots(len(pairs), zip(*np.nonzero(close), strict=True))
    least = {g: min((i for (i, _), h in zip(pairs, group, strict=True) if h == g and i is not None), default=None) for g in group}
    want = sorted((str(i), f"{m:016x}", str(least[g])) for (i, _), m, g in zip(pairs, marks, group, strict=True))
    docs = make(pairs)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in near_duplicates(docs).collect()) == want
    kept = keep_one_of_each(docs.withColumnRenamed("source", "root"))
    assert kept.columns == ["doc_id", "text", "lang", "root", "n_chars"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, least.values()))
    assert not near_duplicates(docs.limit(0)).collect() and not keep_one_of_each(docs.limit(0)).collect()


# Chat

def test_chat(spark):
    rng = random.Random(2)
    parts = ["\\", "### Assistant:", "</turn>", "</role>", "### Role:", "a", " ", "\n", "</tur", "n>", "### User:"]
    for _ in range(1500):
        turns = [(rng.choice(["user", "assistant", "", "tool", "</role>"]), "".join(rng.choice(parts) for _ in range(rng.randrange(9))))
                 for _ in range(rng.randrange(5))]
        formatter, reader, got = Formatter(DEFAULT), Reader(DEFAULT), []
        full = "".join(s[4] for role, text in turns for s in formatter.segments(role, text))
        while full:
            n = rng.randrange(1, 40)
            got += reader.feed(full[:n])
            full = full[n:]
        assert got + list(reader.feed("", last=True)) == turns
    rows = [(1, 1, "assistant", "hé", "x"), (1, 0, "user", None, "x"), (2, 0, "assistant", "first", "x"), (2, 1, None, "?", "x"),
            (None, 0, "user", "u", "x"), (1, 1, "assistant", "hé", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg string")
    got = {r.conv_id: r for r in read_back(format_conversations(frame)).collect()}
    turns = {1: [("user", ""), ("assistant", "hé"), ("assistant", "hé")], 2: [("assistant", "first"), ("", "?")], None: [("user", "u")]}
    for conv, said in turns.items():
        loss = "".join(t for r, t in said if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.loss_chars) == (len(said), len(loss))
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert [got[c].valid for c in (1, 2, None)] == [False, False, True]
    assert not read_back(format_conversations(frame.limit(0))).collect()


# Quality

def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_places(words, n):
    first = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    pairs = [xxhash.xxh64_intdigest(b.encode(), seed=xxhash.xxh64_intdigest(a.encode(), seed=42))
             for a, b in zip(words, words[1:], strict=False)]
    return [signed(h) % n for h in first + pairs]


def plain_scores(pairs, good_ids, n):
    """Per row: the score from the other half's counts."""
    halves = [signed(xxhash.xxh64_intdigest((t or "").encode(), seed=42)) % 2 for _, t in pairs]
    raw, target = np.zeros(n), np.zeros((2, n))
    places = [plain_places(SPLIT(t or ""), n) for _, t in pairs]
    for (i, _), h, own in zip(pairs, halves, places, strict=True):
        for p in own:
            raw[p] += 1
            target[h, p] += i in good_ids
    def ratio(h):
        return np.log((target[h] * raw.sum() / target[h].sum() + quality.SMOOTHING) / (raw + quality.SMOOTHING))
    ratios = [ratio(1), ratio(0)]
    return [ratios[h][own].mean() if own else 0.0 for h, own in zip(halves, places, strict=True)]


def plain_threshold(scores, lost=0.02):
    """scores: (score, good, bad) of long labelled rows; every edge is tried."""
    bins = sorted((math.floor(s / quality.BIN), g, b) for s, g, b in scores)
    goods, bads = sum(b[1] for b in bins), sum(b[2] for b in bins)
    best = None
    for edge in sorted({b[0] for b in bins}):
        good, bad = sum(b[1] for b in bins if b[0] < edge), sum(b[2] for b in bins if b[0] < edge)
        if good <= lost * goods and (best is None or bad / max(1, bads) - good / goods > best[0]):
            best = (bad / max(1, bads) - good / goods, edge)
    return best[1] * quality.BIN


def plain_base(text):
    words = SPLIT(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if SPLIT(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality(spark, make):
    rng = random.Random(9)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}###" for i in range(60)]
    pairs = [(i, "\n".join(" ".join(rng.choice(good if i % 4 or rng.random() < 0.5 else bad) for _ in range(15)) for _ in range(rng.randrange(1, 8))))
             for i in range(160)]
    pairs += [(190, None), (191, ""), (192, "a b c " * 30), (193, "x\n\nx\n x\ty\x0bz"), (None, "no id"), (5, pairs[5][1])]
    labelled = [(i, int(i % 4 > 0), int(i % 10 == 2)) for i in range(120)] + [(None, 1, 0), (3, 1, None), (7, 0, 0), (150, None, None)]
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    bad_ids = {i for i, q, t in labelled if q == 0 or t == 1}
    good_ids = {i for i, q, t in labelled if q == 1 and t != 1} - bad_ids - {None}
    n = quality.table_size(len(pairs))
    scores = plain_scores(pairs, good_ids, n)
    threshold = plain_threshold([(s, i in good_ids, i in bad_ids) for (i, t), s in zip(pairs, scores, strict=True)
                                 if i in good_ids | bad_ids and len(SPLIT(t or "")) >= 50])
    want = []
    for (i, text), score in zip(pairs, scores, strict=True):
        base = plain_base(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        want.append((str(i), *base, failed, not failed and score >= threshold, round(score, 9)))
    docs = make(pairs)
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept,
                  round(r.score, 9)) for r in judge(docs, labels).collect())
    assert [g[:-1] for g in got] == [w[:-1] for w in sorted(want)]
    assert np.allclose([g[-1] for g in got], [w[-1] for w in sorted(want)], atol=1e-6)
    assert any(not w[6] and not w[7] for w in want) and any(w[7] for w in want)
    kept = quality.keep_good(docs.withColumnRenamed("lang", "kept"), labels)
    assert kept.columns == ["doc_id", "text", "kept", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if w[7])
    assert not judge(docs.limit(0), labels).collect() and not quality.keep_good(docs.limit(0), labels).collect()
    rows = judge(docs, labels.limit(0)).collect()
    assert all(r.score == 0 and r.kept != r.base_failed for r in rows) and len(rows) == len(pairs)
    # Labels by shuffle, as where there are too many to broadcast.
    known, _ = quality.known_ids(labels)
    keyed = quality.keyed(docs, "doc_id", "text")
    tables = [sorted(map(tuple, quality.ratio_table(keyed, known, count, n).collect())) for count in (None, 10)]
    assert tables[0] == tables[1] and len(tables[0]) > 100


def test_quality_threshold():
    assert quality.threshold_of([]) is None and quality.threshold_of([(3, 0, 5)]) is None
    assert quality.threshold_of([(-5, 4, 0), (2, 1, 0)], width=1.0) == -5
    bins = [(0, 0, 8), (1, 2, 8), (2, 3, 4), (3, 95, 0)]
    assert quality.threshold_of(bins, 0.02, 1.0) == 2 and quality.threshold_of(bins, 0.05, 1.0) == 3


# URLs

def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fit, key=lambda r: len(r.name)) if fit else None


def test_urls(spark):
    known = ["http://WWW.Example.com/en/1?x=/de/", "https://example.com/en/", "ftp://a.net/es/x#y", "http://net/fr/", "http://com",
             "http://xcom/", "https://b.com?q", "http://mexample.com/en/3", None, "", "nothing", "http://", "x://y://z/é"]
    held_out = [("http://casino-jackpots.example.org/de/4", "block"), ("http://cheap-pills-shop.org/order", "block"),
                ("http://adult-cams.example.net/de/8", "block"), ("http://www.historymuseum.org/exhibits/roman", "allow"),
                ("http://blog.erinthe.example.org/de/14", "allow"), ("http://docs.algebra.net/en/groups.html", "allow")]
    many = [*known, *(u for u, _ in held_out), known[0]]
    frame = spark.createDataFrame(list(enumerate(many)), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS features")
    rows = {r.page_id: r for r in filter_urls(frame, RULES).collect()}
    assert len(rows) == len(many)
    for i, url in enumerate(many):
        host, path, rule = plain_rule(url)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule and rule.name)
        assert rows[i].verdict == (rule.verdict if rule else "block" if rows[i].score >= 0.5 else "allow")
    assert [rows[len(known) + i].verdict for i in range(len(held_out))] == [v for _, v in held_out]
    assert not filter_urls(frame.limit(0), RULES).collect()


def test_url_model_on_hosts_held_out(spark):
    rows = urls.labelled_table()
    assert rows == urls.labelled_table() and len(rows) < urls.MOST_LABELLED
    host = re.compile(r"://([^/]*)")
    parts = [{host.search(u)[1] for u, _, out in rows if out is side} for side in (True, False)]
    assert not parts[0] & parts[1] and len(parts[0]) > 500
    held = urls.labelled_urls(spark, held_out=True).withColumn("page_id", F.monotonically_increasing_id())
    verdicts = filter_urls(held, []).join(held.select("page_id", "label"), "page_id").collect()
    unwanted = [r.verdict == "block" for r in verdicts if r.label == 1]
    wanted = [r.verdict == "block" for r in verdicts if r.label == 0]
    assert np.mean(unwanted) >= 0.9 and np.mean(wanted) <= 0.01


def test_url_features_and_probability(spark):
    """The score against its formula in numpy; a very long URL, repeated rows, extra columns that clash."""
    known = spark.createDataFrame([("http://casino.org/a", 1.0), ("http://garden.org/a", 0.0), ("http://x.org", 0.0), (None, 1.0)],
                                  "url string, label double")
    model = urls.train(known)
    texts = ["http://casino-garden.org/a/b", "http://" + "long-" * 800 + ".org/" + "p" * 4_000, None, "http://casino.org/a", "http://casino.org/a"]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "page_id long, url string, score int, grams string")
    index = HashingTF(numFeatures=urls.FEATURES).indexOf
    for row in filter_urls(frame, [], known).collect():
        host, path, _ = plain_rule(texts[row.page_id])
        grams = {f"{mark}{n}{framed[i:i + n]}" for mark, framed in (("h", f"^{host}$"), ("p", f"^{path}$"))
                 for n in urls.SIZES for i in range(len(framed) - n + 1)}
        places = {index(gram) for gram in grams}
        margin = sum(model.coefficients[p] for p in places) / max(1, len(places)) ** 0.5 + model.intercept
        assert row.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
        assert row.verdict == ("block" if row.score >= 0.5 else "allow")


# Pipeline

def test_pipeline(spark, make, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    good = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    pairs = [(i, t) for i, t in enumerate(good)] + [(50, good[3]), (51, "short"), (52, None), (53, good[4] + " mail me.7@x.org")]
    make(pairs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in pairs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{number}")
        if number < 3:
            assert docs.columns == before.columns
    stages = [spark.read.parquet(f"{tmp_path}/{i}") for i in range(4)]
    assert {r.doc_id for r in stages[0].collect()} == {*range(12), 50, 53}
    left = {r.doc_id for r in stages[1].collect()}
    assert 50 not in left and left >= set(range(12))
    assert {r.doc_id for r in stages[2].collect()} == left
    assert not any("me.7@x.org" in r.text for r in stages[2].collect())
    assert {r.doc_id for r in stages[3].collect()} == left
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, stages[3].collect()))


def test_pipeline_on_empty_tables(spark, make, tmp_path):
    docs, labels = make([(1, "x")]).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.collect() == [] and "sequence_id" in whole.columns
