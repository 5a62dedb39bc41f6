"""Search for license notices that may be misspelt.

Texts are reduced to lower-case words joined by one space.  A notice that may
have k edits is cut into k + 1 seeds; a match with at most k edits holds at least
one of them unchanged (pigeonhole).  One Aho-Corasick pass finds all seeds of all
notices; only around a seed does the regex library look for the notice with a
bounded number of edits.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from polyview.llm.common import id_and_text, slices


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    edits: int = 0


# Phrases whose exact places are counted, and their labels.
BASE = [
    Notice("cc-by", "cc by"),
    Notice("gpl", "general public license"),
    Notice("reserved", "all rights reserved"),
]
# Further notices, found with up to so many edits (inserted, deleted or changed characters).
FUZZY = [
    Notice("gpl", "general public license", 2),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("reserved", "all rights reserved", 2),
    Notice("cc-by", "licensed under cc by", 2),
    Notice("cc-by-nc", "licensed under cc by nc", 1),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("apache", "licensed under the apache license", 3),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    Notice("mpl", "subject to the terms of the mozilla public license", 4),
]

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# A-Z to a-z, other ASCII that is no word character to a space.
REDUCE = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


@dataclass(frozen=True)
class Hit:
    """A place in words: first word, number of words, edits and likeness (1 - edits / length)."""

    label: str
    first: int
    words: int
    edits: int
    score: float
    base: bool


class Scanner:
    def __init__(self, base: list[Notice], fuzzy: list[Notice]):
        self.notices = [*base, *fuzzy]
        self.n_base = len(base)
        seeds: dict[str, list[tuple[int, int]]] = {}
        self.patterns, self.leftmost = [], []
        for i, notice in enumerate(self.notices):
            text, parts = f" {notice.words} ", notice.edits + 1
            edges = [len(text) * p // parts for p in range(parts + 1)]
            for a, b in zip(edges, edges[1:], strict=False):
                seeds.setdefault(text[a:b], []).append((i, a))
            words = regex.escape(notice.words, special_only=True, literal_spaces=True)
            pattern = f"(?<= )(?:{words}){{e<={notice.edits}}}(?= )"
            self.leftmost.append(regex.compile(pattern))
            self.patterns.append(regex.compile(f"(?b){pattern}"))
        self.machine = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.machine.add_word(seed, (len(seed), places))
        self.machine.make_automaton()

    @staticmethod
    def reduce(text: str) -> tuple[str, int]:
        words = text.encode().translate(REDUCE).split()
        return b" ".join([b"", *words, b""]).decode(), len(words)

    def _places(self, i: int, joined: str, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """Matches of one notice in a part, in time linear in its length; no two overlap.

        From the leftmost match on, the best one is looked for within one notice's reach behind
        the last; only fewer edits move it further, so it moves at most ``edits`` times and no
        match that overlaps what is kept has fewer.  What was passed over is searched again.
        """
        reach = len(self.notices[i].words) + self.notices[i].edits + 2
        found, parts = [], [(low, high)]
        while parts:
            a, b = parts.pop()
            best = self.leftmost[i].search(joined, a, b)
            if not best:
                continue
            a, edits = best.start() - 1, sum(best.fuzzy_counts)
            while edits:
                nearer = self.patterns[i].search(joined, best.start() - 1, min(b, best.end() + reach))
                if not nearer or sum(nearer.fuzzy_counts) >= edits:
                    break
                best, edits = nearer, sum(nearer.fuzzy_counts)
            found.append((i, *best.span(), edits))
            parts.append((best.end(), b))
            if best.start() - a > reach - 2 * self.notices[i].edits - 2:
                parts.append((a, best.start()))
        return found

    def scan(self, joined: str) -> list[Hit]:
        """All hits in reduced text, by notice and place."""
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, set[int]] = {}
        for last, (length, places) in self.machine.iter(joined):
            for i, offset in places:
                notice, start = self.notices[i], last + 1 - length - offset
                size = len(notice.words) + 2
                if i < self.n_base:
                    if start >= 0 and joined.startswith(f" {notice.words} ", start):
                        exact.setdefault(i, set()).add(start + 1)
                    continue
                k = notice.edits
                low, high = max(0, start - k), start + size + 2 * k
                own = windows.setdefault(i, [])
                if own and low <= own[-1][1]:
                    own[-1] = [min(low, own[-1][0]), max(high, own[-1][1])]
                else:
                    own.append([low, high])
        if not exact and not windows:
            return []
        found = [(i, at, at + len(self.notices[i].words), 0) for i, starts in exact.items() for at in starts]
        for i, spans in windows.items():
            for low, high in spans:
                found += self._places(i, joined, low, high)
        spaces = [m.start() for m in re.finditer(" ", joined)]
        hits = []
        for i, start, end, edits in sorted(found):
            first, behind = bisect_right(spaces, start) - 1, bisect_right(spaces, end - 1) - 1
            hits.append(Hit(self.notices[i].label, first, behind - first + 1, edits,
                            max(0.0, 1 - edits / len(self.notices[i].words)), i < self.n_base))
        return hits


def scan_licenses(docs: DataFrame, base: list[Notice] = BASE, fuzzy: list[Notice] = FUZZY,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row.

    doc_id; n_words; n_base, first_word and last_word: number, smallest and largest start
    (in words, from 0) of the exact places of base phrases, null where there are none;
    base_labels and labels: distinct, sorted, joined by commas; score: the likeness of the
    best hit, 0 without hits; spans: label, start and length in characters of the original
    text, edits.  Null and empty texts have no words and no hits; an empty table gives no rows,
    repeated rows and null ids each keep their row, columns other than the two named are not
    read.  Time is linear in a text's length, however many edited notices it holds.
    """
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                               ("edits", pa.int64())]))

    def row(scanner: Scanner, text: str) -> tuple:
        joined, n_words = scanner.reduce(text)
        hits = scanner.scan(joined)
        exact = [h for h in hits if h.base]
        spans = []
        if hits:
            words = [m.span() for m in WORD.finditer(text.translate(LOWER))]
            spans = [{"label": h.label, "start": words[h.first][0],
                      "length": words[h.first + h.words - 1][1] - words[h.first][0], "edits": h.edits} for h in hits]
        return (n_words, len(exact), min((h.first for h in exact), default=None),
                max((h.first for h in exact), default=None), ",".join(sorted({h.label for h in exact})),
                ",".join(sorted({h.label for h in hits})), max((h.score for h in hits), default=0.0), spans)

    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches):
        scanner = Scanner(base, fuzzy)
        for part in slices(batches):
            rows = [row(scanner, t) for t in part["text"].to_pylist()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] \
                if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], ["doc_id", *names])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
             "labels string, score double, spans array<struct<label: string, start: long, length: long, edits: long>>")


LOWER = {c: c + 32 for c in range(65, 91)}
