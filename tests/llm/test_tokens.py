"""Piece encoding, token counts and packing against the libraries themselves."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import Tokenizer

from polyview.llm.packing import WordTokenizer, pack, pack_documents, splits_at_spaces, sum_of_squares
from polyview.llm.pieces import PieceEncoder, encode_pieces, round_trip
from polyview.llm.token_counts import ChunkedCounter, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = list("ab  \n\t▁é日\x00😀.,<s>E12\r") + ["word", " the", "ﬁ", "Ａ", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "Thé."]


def texts(count, longest, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(longest))) for _ in range(count)]


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def test_pieces_equal_the_library(model, library):
    encoder = PieceEncoder(model)
    many = ["", " ", "  ", "a ", "▁", *texts(600, 700)]
    for text, got in zip(many, encoder.encode_all(many), strict=True):
        assert got.ids == library.encode(text)
        assert encoder.decimal(got).decode() == ",".join(map(str, got.ids))
        raw = text.encode()
        pieces = library.encode(text, return_type="proto").pieces
        assert len(pieces) == len(got.starts)
        assert b"".join(raw[a:b] for a, b in zip(got.starts, got.ends, strict=True)) == raw


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_maps(model, rule, squeeze):
    spec, rules = proto.ModelProto(), proto.NormalizerSpec()
    spec.ParseFromString(model)
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    spec.normalizer_spec.precompiled_charsmap = rules.precompiled_charsmap
    spec.normalizer_spec.remove_extra_whitespaces = squeeze
    mapped = spec.SerializeToString()
    encoder, library = PieceEncoder(mapped), sentencepiece.SentencePieceProcessor(model_proto=mapped)
    for text in texts(300, 30):
        assert encoder.normalise(text)[0] == library.normalize(text)
        assert encoder.encode(text).ids == library.encode(text)
    got = encoder.encode("Ａ① ﬁ")
    assert got.starts.tolist() == [0, 3, 6] and got.ends.tolist() == [3, 6, 10]


def test_counts_do_not_depend_on_chunks(model, library):
    encoder = PieceEncoder(model)
    for chunk, overlap in ((40, 4), (300, 1), (64, 64)):
        counter = ChunkedCounter(encoder, chunk, overlap)
        many = texts(400, 300, chunk) + ["a" * 2000, "日" * 500, " " * 999]
        assert counter.count_all(many) == [len(library.encode(t)) for t in many]
    assert counter.widened  # some overlaps had no stable place


def test_piece_queries(make, library):
    pairs = [(1, None), (2, ""), (3, "some words here"), (3, "some words here"), (None, "x  y"), (5, "long " * 9000)]
    docs = make(pairs)
    want = sorted((str(i), len(library.encode(t or "")),
                   hashlib.sha256(",".join(map(str, library.encode(t or ""))).encode()).hexdigest(),
                   hashlib.sha256(library.decode(library.encode(t or "")).encode()).hexdigest()) for i, t in pairs)
    rows = round_trip(docs, PIECES).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    counts = token_counts(docs, PIECES, chunk=1000).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == sorted(
        (str(i), len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in pairs)
    spans = {r.doc_id: r for r in encode_pieces(docs, PIECES).collect()}
    assert spans[3].ids == library.encode(pairs[2][1]) and spans[3].ends[-1] == 15
    empty = make([(1, "x")]).limit(0)
    assert not round_trip(empty, PIECES).collect() and not token_counts(empty, PIECES).collect()


def test_word_ids_equal_the_library():
    with open(WORDS, "rb") as file:
        tokenizer = WordTokenizer(file.read(), remembered=500)
    library = Tokenizer.from_file(WORDS)
    many = texts(800, 60)
    for at in range(0, len(many), 50):
        part = pa.array(["before", *many[at:at + 50], "behind"]).slice(1, 50)
        for text, ids in zip(many[at:at + 50], tokenizer.ids(part), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_another_tokenizer_takes_whole_texts(make):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as file:
        tokenizer = WordTokenizer(file.read())
    many = texts(200, 40, 7)
    for text, ids in zip(many, tokenizer.ids(pa.array(many)), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    with open(WORDS, "rb") as file:
        spec = json.loads(file.read())
    assert splits_at_spaces(spec) and not tokenizer.by_words
    cased = {**spec, "normalizer": {"type": "NFC"}}
    added = {**spec, "added_tokens": [*spec["added_tokens"], {**spec["added_tokens"][0], "id": 49408, "content": "the"}]}
    for other in (cased, added):
        assert not splits_at_spaces(other)
        raw = json.dumps(other)
        ids = WordTokenizer(raw.encode()).ids(pa.array(["The other's  THE"]))[0].tolist()
        assert ids == Tokenizer.from_str(raw).encode("The other's  THE", add_special_tokens=False).ids
    pairs = [(i, t) for i, t in enumerate(many[:40])]
    rows = pack_documents(make(pairs), path, capacity=64).collect()
    assert sum(r.length for r in rows) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in pairs)
    assert pack_documents(make(pairs).limit(0), WORDS).collect() == []


def squares(bins, lengths, capacity):
    gaps = {}
    for b, size in zip(bins, lengths, strict=True):
        gaps[b] = gaps.get(b, capacity) - size
    counts = np.bincount([g for g in gaps.values() if g], minlength=1)
    return int((counts.astype(int) ** 2).sum())


def test_each_choice_has_the_least_squares():
    lengths, capacity = np.random.default_rng(4).integers(1, 17, 60), 16
    bins, offsets = sum_of_squares(lengths, capacity)
    for n in range(1, len(lengths)):
        used = np.bincount(bins[:n], lengths[:n])
        fits = [b for b in range(len(used)) if used[b] + lengths[n] <= capacity]
        assert (bins[n] in fits) == bool(fits) and offsets[n] == (used[bins[n]] if bins[n] < len(used) else 0)
        if fits:
            best = min(squares([*bins[:n], b], lengths[:n + 1], capacity) for b in fits)
            assert squares(bins[:n + 1], lengths[:n + 1], capacity) == best


def test_packing(make):
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(5)
    pairs = [(i, " ".join("alpha beta gamma".split()[rng.randrange(3)] for _ in range(rng.randrange(1, 90))))
             for i in range(300)]
    pairs += [(300, None), (301, ""), (302, "tie"), (302, "tie"), (None, "none"), (303, "long " * 1000)]
    rows = pack_documents(make(pairs), WORDS, capacity=256, per_shard=150).collect()
    want = []
    for i, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(str(i), p, at, len(ids[at:at + 256]), zlib.crc32(np.array(ids[at:at + 256], "<u4").tobytes()))
                 for p, at in enumerate(range(0, len(ids), 256))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.05 * sum(r.length for r in rows) / 256 + 3
    assert not pack(make([(1, "x")]).limit(0).selectExpr(
        "doc_id", "0L piece", "0L start", "1L length", "0L ids_crc32")).collect()
