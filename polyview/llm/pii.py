"""Pseudonyms for personal data that keep its format.

Numbers and dates are recognised by pattern and validated (check digits, ranges,
the calendar).  A valid value is mapped within all values of its format by a
keyed permutation, a Feistel network of unequal halves that walks its cycle until
it is back in range.  Equal values get equal pseudonyms in every document, and
the key's owner can undo them.

Values written differently stay linked: phones by their country code and national
number, dates by their day.  For that a date keeps whether its month has two digits
and whether its day is below 10, up to 12 or above, so every notation of the new day
is read back as the same day.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

from polyview.llm.common import id_and_text, slices

ROUNDS = 8
DEMO_KEY = b"replace this key in production"


class Permutation:
    """A keyed permutation of 0 .. size-1 without fixed points (for a size over 1)."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.key, self.size = blake2b(key, digest_size=32).digest(), size
        self.tweak = f"{tweak}:{size}:".encode()
        self.left = math.isqrt(max(0, size - 1)) + 1
        self.right = -(-size // self.left)

    def _noise(self, step: int, value: int) -> int:
        data = self.tweak + step.to_bytes(1, "big") + value.to_bytes(40, "big")
        return int.from_bytes(blake2b(data, key=self.key, digest_size=48).digest(), "big")

    def _walk(self, value: int, steps: range, sign: int) -> int:
        while True:
            a, b = divmod(value, self.right)
            for step in steps:
                if step % 2:
                    b = (b + sign * self._noise(step, a)) % self.right
                else:
                    a = (a + sign * self._noise(step, b)) % self.left
            value = a * self.right + b
            if value < self.size:
                return value

    def _shift(self, value: int, by: int) -> int:
        mixed = (self._walk(value, range(ROUNDS), 1) + by) % self.size
        return self._walk(mixed, range(ROUNDS)[::-1], -1)

    def apply(self, value: int) -> int:
        return self._shift(value, 1)

    def undo(self, value: int) -> int:
        return self._shift(value, -1)


Move = Callable[[str, int, int], int]  # (tweak, size, value) -> value

# Each character stays in its class.
CLASSES = ["".join(map(chr, range(a, b))).replace(skip, "") for a, b, skip in (
    (48, 58, "-"), (97, 123, "-"), (65, 91, "-"), (0xDF, 0x100, "÷"), (0xC0, 0xDF, "×"))]
CLASS_OF = {c: (own, i) for own in CLASSES for i, c in enumerate(own)}


def by_class(text: str, kind: str, move: Move) -> str:
    """Permute all texts of one shape: every character within its class, the others fixed."""
    spots = [CLASS_OF.get(c) for c in text]
    value, size, shape = 0, 1, []
    for spot in spots:
        if spot:
            value = value * len(spot[0]) + spot[1]
            size *= len(spot[0])
            shape.append(str(CLASSES.index(spot[0])))
    value, out = move(f"{kind}:{''.join(shape)}", size, value), []
    for char, spot in zip(reversed(text), reversed(spots), strict=True):
        if spot:
            value, i = divmod(value, len(spot[0]))
            char = spot[0][i]
        out.append(char)
    return "".join(reversed(out))


def refill(pattern: str, digits: str) -> str:
    """The pattern with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in pattern)


def luhn(digits: str) -> int:
    doubled = [int(d) * (2 - i % 2) for i, d in enumerate(reversed(digits))]
    return -sum(x - 9 * (x > 9) for x in doubled) % 10


def email(text: str, move: Move) -> str:
    local, _, domain = text.rpartition("@")
    return f"{by_class(local, 'email', move)}@{domain}"


def card(text: str, move: Move) -> str | None:
    """13 to 19 digits of a bank card with a right check digit; keeps the first digit."""
    digits = re.sub(r"\D", "", text)
    if digits[0] not in "23456" or int(digits[-1]) != luhn(digits[:-1]):
        return None
    size = 10 ** (len(digits) - 2)
    middle = f"{move(f'card:{digits[0]}', size, int(digits[1:-1])):0{len(digits) - 2}d}"
    return refill(text, digits[0] + middle + str(luhn(digits[0] + middle)))


# Country codes of one and of two digits; all others have three.
ONE_DIGIT_CODES = set("17")
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 "
                      "60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
TRUNK = re.compile(r"\(0\)")


def country_code(digits: str) -> str:
    return digits[:1] if digits[:1] in ONE_DIGIT_CODES else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def phone(text: str, move: Move) -> str | None:
    """Keeps the country code; ``(0)`` is no part of the number, and one without a code is North American."""
    digits = re.sub(r"\D", "", TRUNK.sub("", text))
    code = country_code(digits) if text[0] == "+" else "1"
    rest = digits.removeprefix(code) if text[0] == "+" else digits
    if not 8 <= len(digits) <= 15 or len(rest) < 6:
        return None
    rest = f"{move(f'phone:{code}', 10 ** len(rest), int(rest)):0{len(rest)}d}"
    new = iter(code + rest if text[0] == "+" else rest)
    return "".join(part if TRUNK.fullmatch(part) else "".join(next(new) if c.isdigit() else c for c in part)
                   for part in re.split(r"(\(0\))", text))


def ipv4(text: str, move: Move) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    value = move("ipv4", 1 << 32, int.from_bytes(map(int, parts), "big"))
    return ".".join(map(str, value.to_bytes(4, "big")))


def ssn(text: str, move: Move) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(move("ssn", 898 * 99 * 9999, value), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


def day_class(day: dt.date) -> tuple[bool, int]:
    """What decides how a date's fields can be written and in which order they are read."""
    return day.month > 9, (day.day > 9) + (day.day > 12)


@cache
def days_by_class() -> dict[tuple[bool, int], list[dt.date]]:
    """All days from 1900 to 2099, ascending within their class."""
    out: dict[tuple[bool, int], list[dt.date]] = {}
    for number in range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1):
        day = dt.date.fromordinal(number)
        out.setdefault(day_class(day), []).append(day)
    return out


def date(text: str, move: Move) -> str | None:
    """A day from 1900 to 2099 in year-month-day, day-month-year or else month-day-year order.

    Days are permuted within their class.  So a field keeps its width with or without
    a leading zero, and a day that only month-day order explains gets another such day.
    """
    fields = re.split(r"\D", text)
    mark = re.search(r"\D", text)[0]
    orders = [(0, 1, 2)] if len(fields[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        try:
            day = dt.date(*(int(fields[i]) for i in order))
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        kind = day_class(day)
        days = days_by_class()[kind]
        new = days[move(f"date:{kind[0]:d}{kind[1]}", len(days), bisect_left(days, day))]
        out = list(fields)
        for i, number in zip(order, (new.year, new.month, new.day), strict=True):
            out[i] = str(number).zfill(len(fields[i]))
        return mark.join(out)
    return None


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def iban(text: str, move: Move) -> str | None:
    plain = text.replace(" ", "")
    country, account = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or int(plain[2:4]) != iban_check(country, account):
        return None
    account = by_class(account, f"iban:{country}", move)
    new = iter(f"{country}{iban_check(country, account):02d}{account}")
    return "".join(c if c == " " else next(new) for c in text)


# Lengths of IBANs by country, and of national numbers by country code.
IBAN_LENGTHS = {c: int(n) for n, own in (
    ("15", "NO"), ("16", "BE"), ("18", "DK FI FO GL NL"), ("19", "MK SI"), ("20", "AT BA EE KZ LT LU XK"),
    ("21", "CH HR LI LV"), ("22", "BG BH CR DE GB GE IE ME RS"), ("23", "AE GI IL"), ("24", "AD CZ ES MD PK RO SA SE SK TN"),
    ("25", "PT"), ("26", "IS TR"), ("27", "FR GR IT MC SM"), ("28", "AL AZ CY DO GT HU LB PL"), ("29", "BR PS QA UA"),
    ("30", "JO KW MU"), ("31", "MT")) for c in own.split()}
PHONE_LENGTHS = {
    "1": {10}, "7": {10}, "31": {9}, "32": {8, 9}, "33": {9}, "34": {9}, "41": {9}, "44": {9, 10}, "45": {8}, "47": {8},
    "48": {9}, "52": {10}, "55": {10, 11}, "61": {9}, "65": {8}, "86": {10, 11}, "90": {10}, "91": {10}, "351": {9}, "420": {9}}


def iban_ends(text: str) -> list[int]:
    """The end that its country's length asks for, then the whole; of an unknown country all ends of groups."""
    ends = [m.start() for m in re.finditer(" |$", text)][::-1]
    if length := IBAN_LENGTHS.get(text[:2]):
        return [e for e in ends if len(text[:e].replace(" ", "")) == length] + ends[:1]
    return ends


def phone_ends(text: str) -> list[int]:
    """The last end of a group that gives a national number of its country's length, then the whole."""
    ends = [m.start() for m in re.finditer(" |$", text)][::-1]
    if text[0] != "+":
        return ends[:1]
    code = country_code(re.sub(r"\D", "", text))
    lengths = {len(code) + n for n in PHONE_LENGTHS.get(code, ())}
    return [e for e in ends if len(re.sub(r"\D", "", TRUNK.sub("", text[:e]))) in lengths][:1] + ends[:1]


ENDS = {"iban": iban_ends, "phone": phone_ends}

# Patterns with the function that validates a match and gives its pseudonym; the first that fits wins.
KINDS: dict[str, tuple[str, Callable[[str, Move], str | None]]] = {
    "email": (r"(?<![\w.%+-])[\w%+-](?:[\w.%+-]{0,62}[\w%+-])?@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![\w-])", email),
    "iban": (r"(?<!\w)[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?!\w)", iban),
    "phone": (r"(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}"
              r"|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![\w-]|\.[0-9])", phone),
    "card": (r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}"
             r"|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\w-]|\.[0-9])", card),
    "ssn": (r"(?<![\w.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]|\.[0-9])", ssn),
    "ipv4": (r"(?<![\w.-])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w-]|\.[0-9])", ipv4),
    "date": (r"(?<![\w./-])(?:[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}(?=T[0-9]{2}(?::?[0-9]{2}|(?!\w)))"
             r"|(?:[0-9]{4}([./-])[0-9]{1,2}\2[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\3[0-9]{4})(?![\w/-]|\.[0-9]))", date),
}


class Pseudonymiser:
    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = key, undo
        self.patterns = {k: (re.compile(p), f) for k, (p, f) in KINDS.items()}
        self.maybe = re.compile("[0-9@]").search

    def move(self, tweak: str, size: int, value: int) -> int:
        own = Permutation(self.key, tweak, size)
        return own.undo(value) if self.undo else own.apply(value)

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of what is valid, by place; no two overlap."""
        if not self.maybe(text):
            return []
        found: list[tuple[int, int, str, str]] = []
        for kind, (pattern, rule) in self.patterns.items():
            if kind == "email" and "@" not in text:
                continue
            hit = pattern.search(text)
            while hit:
                start, at = hit.start(), hit.start() + 1  # a rejected match is searched inside
                for length in ENDS[kind](hit[0]) if kind in ENDS else [len(hit[0])]:
                    new = rule(hit[0][:length], self.move)
                    if new is not None:
                        at = start + length
                        found.append((start, at, kind, new))
                        break
                hit = pattern.search(text, at)
        # Kinds were searched in order of precedence; of two that overlap the earlier kind stays.
        kept: list[tuple[int, int, str, str]] = []
        order = {kind: i for i, kind in enumerate(KINDS)}
        for one in sorted(found, key=lambda x: (x[0], order[x[2]])):
            if kept and one[0] < kept[-1][1]:
                if order[one[2]] < order[kept[-1][2]]:
                    kept[-1] = one
                continue
            kept.append(one)
        return kept

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        found = self.find(text)
        parts, at = [], 0
        for start, end, _, new in found:
            parts += [text[at:start], new]
            at = end
        return ("".join([*parts, text[at:]]) if found else text), found


def pseudonymise_column(docs: DataFrame, key: bytes = DEMO_KEY, undo: bool = False, text_col: str = "text") -> DataFrame:
    """The same frame with the text column replaced; all other columns pass unchanged, nulls stay null.

    Texts of any length are taken whole.  An empty table stays empty, repeated rows stay
    repeated, and further columns may have any names.
    """

    def run(batches):
        worker = Pseudonymiser(key, undo)
        for part in slices(batches):
            new = [t if t is None else worker.replace(t)[0] for t in part.column(at).to_pylist()]
            columns = [pa.array(new, part.schema.field(at).type) if i == at else part.column(i)
                       for i in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_found, kinds (distinct, sorted, joined by commas) and spans.

    spans: kind, start and length in characters of the original text.  Null and empty
    texts give an empty text and nothing found.  Equal values get equal pseudonyms in
    all rows; a text without valid values stays as it is.  An empty table gives no rows,
    repeated rows and null ids keep theirs; columns other than the two named are not read.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        worker = Pseudonymiser(key)
        for part in slices(batches):
            rows = [worker.replace(t) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([t for t, _ in rows], pa.string()),
                 pa.array([len(f) for _, f in rows], pa.int64()),
                 pa.array([",".join(sorted({x[2] for x in f})) for _, f in rows], pa.string()),
                 pa.array([[{"kind": k, "start": a, "length": b - a} for a, b, k, _ in f] for _, f in rows], span)],
                ["doc_id", "text", "n_found", "kinds", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, text string, n_found long, kinds string, "
             "spans array<struct<kind: string, start: long, length: long>>")
