"""The manifest against the tree built as its definition says, level by level."""

import hashlib
import random
import zlib

import pytest

from polyview.llm.manifest import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    """The root, and every node's siblings and (place, run) per level."""
    found = [([], []) for _ in digests]
    nodes = [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for place, (_, below) in enumerate(run):
                others = [d for d, _ in run[:place] + run[place + 1:]]
                for i in below:
                    found[i][0].append(others)
                    found[i][1].append(place)
            above.append((h([d for d, _ in run]), [i for _, below in run for i in below]))
        nodes = above
    return nodes[0][0], found


def leaf(row, text):
    parts = []
    for value in (row[0], row[3], row[2], row[4], text):
        value = None if value is None else str(value)
        parts.append("-" if value is None else f"{len(value.encode())}:{value}")
    return h(parts)


def expected(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in by_source[s]])
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, (top, top_places) in zip(sources, tops, strict=True):
        for (_, _, plain, row), (siblings, places) in zip(by_source[s], trees[s][1], strict=True):
            text = row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(row, text)
            for others, place in zip(siblings + top, places + top_places, strict=True):
                folded = h(others[:place] + [folded] + others[place:])
            proof = h([d for others in siblings + top for d in others])
            out.append((row[0], plain, trees[s][0], root, proof, folded, folded == root))
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("height", [1, 2, 5])
def test_trees_of_all_sizes(spark, height):
    rng, rows = random.Random(height), []
    for n, source in [(0, "none"), (1, "b"), (2, None), (3, "a"), (4, ""), (9, "é"), (10, "z"), (27, "Z"), (31, "src0"),
                      (60, "src00")]:
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "\n", "plain", "é \n\n x"])
            rows.append((rng.choice([None, rng.randrange(10_000)]) if n == 9 else rng.randrange(-50, 10_000), text,
                         rng.choice([None, "en"]), source, rng.choice([None, 3]), "clash", "clash"))
    rows += rows[-40:] + [(7, "same\nrow", "en", "src00", 1, "x", "y")] * 50
    rng.shuffle(rows)
    found = manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), height).collect()
    assert sorted(map(tuple, found), key=key) == sorted(expected(rows), key=key)
    assert {r.verified for r in found} == {True, False}


def test_one_row_and_none(spark):
    rows = [(5, "x" * 2_000_000 + "\n", None, None, None, "c", "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = manifest(docs).collect()
    assert [tuple(r) for r in got] == expected(rows)
    assert got[0].leaf == got[0].subroot == got[0].root and got[0].proof_sha256 == h([])
    assert manifest(docs.limit(0)).collect() == []
