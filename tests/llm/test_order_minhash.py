"""Order MinHash against a plain computation, text by text."""

import hashlib
import random

import numpy as np
import pytest

from polyview.llm.order_minhash import (
    BASE, STEP, OrderMinHash, code_points, compared, fingerprints, likeness, mixed, written,
)

MASK = (1 << 64) - 1


def mix(x):
    return int(mixed(np.array([x & MASK], np.uint64))[0])


def plain_signature(hasher, text):
    """Every step by its definition, one k-mer at a time."""
    k = min(hasher.length, len(text))
    items, seen = [], {}
    for at in range(len(text) - k + 1 if k else 0):
        kmer = text[at:at + k]
        value = 0
        for c in kmer:
            value = (value * int(BASE) + ord(c) + 1) & MASK
        value, number = mix(value), seen.get(kmer, 0)
        seen[kmer] = number + 1
        items.append(mix(value + number * int(STEP)) if number else value)
    out = []
    for factor, shift in zip(hasher.factors[:, 0].tolist(), hasher.shifts[:, 0].tolist(), strict=True):
        ranked = sorted(range(len(items)), key=lambda i: (((items[i] >> 32) * factor + shift) & 0xFFFFFFFF, i))
        value = int(STEP)
        for i in [*sorted(ranked[:hasher.picked]), *[None] * hasher.picked][:hasher.picked]:
            value = mix((value * int(BASE) + (MASK if i is None else items[i])) & MASK)
        out.append(value >> 48)
    return np.array(out, np.uint16)


def expected(hasher, pairs):
    """doc_id -> row, for documents with distinct ids."""
    pairs = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0), reverse=True)
    out = {}
    for (i, text), (_, after) in zip(pairs, pairs[1:] + pairs[:1], strict=True):
        text, after = text or "", after or ""
        n = len(text) // 3
        edited = text[:len(text) - n] + after[:n]
        own, other = plain_signature(hasher, text), plain_signature(hasher, edited)
        out[i] = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(other),
                  likeness(own, other), likeness(own, plain_signature(hasher, after)))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "be", "é", "😀", "gamma", "del\nta", "x" * 12]
    return [None, "", "a", "ab", "abc", "abcdefgh", "aaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghi" * 30] + [
        " ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)]


def test_rows_against_plain_computation(make, texts):
    hasher = OrderMinHash(5, 16, 3)
    pairs = list(enumerate(texts)) + [(None, "no id at all")]
    want = expected(hasher, pairs)
    for parts in (1, 7):
        got = [tuple(r) for r in compared(make(pairs, parts), hasher).collect()]
        assert len(got) == len(pairs) and {r[0]: r for r in got} == want
    found = {r.doc_id: r.fingerprint for r in fingerprints(make(pairs), hasher).collect()}
    assert found == {i: row[3] for i, row in want.items()}


def test_lone_and_repeated_rows(make):
    hasher = OrderMinHash()
    assert compared(make([(1, "x")]).limit(0)).collect() == []
    lone = compared(make([(1, "one text, alone in its table")])).collect()
    assert tuple(lone[0]) == expected(hasher, [(1, "one text, alone in its table")])[1]
    rows = compared(make([(4, "the same text in many rows")] * 200 + [(2, "another one")])).collect()
    same = [r for r in rows if r.doc_id == 4]
    assert len(rows) == 201 and len({r.fingerprint for r in same}) == 1 and sum(r.near_next == 1.0 for r in same) == 199


def test_order_and_length_matter():
    rng = random.Random(9)
    hasher = OrderMinHash()
    half = ["".join(rng.choice("abcdefghij ") for _ in range(2000)) for _ in range(2)]
    one, swapped = (hasher.of(code_points(t)) for t in (half[0] + half[1], half[1] + half[0]))
    assert 0.3 < likeness(one, swapped) < 0.75  # pairs within one half keep their order
    near = hasher.of(code_points(half[0] + half[1][:1990] + "!" * 10))
    assert likeness(one, near) > 0.9
    long = "".join(rng.choice("abcdefghij ") for _ in range(300_000))
    both = hasher.of_both(code_points(long), 200_000, code_points(long[:200_000] + "q" * 100_000))
    assert (both[0] == hasher.of(code_points(long))).all()
    assert (both[1] == hasher.of(code_points(long[:200_000] + "q" * 100_000))).all()
