"""Values and notices that stand next to others."""

import datetime as dt
import random
import re
import time

from polyview.llm.licenses import BASE, FUZZY, Notice, Scanner, scan_licenses
from polyview.llm.pii import Pseudonymiser, date, phone, pseudonymise, pseudonymise_column


def test_values_before_other_words():
    one, undo = Pseudonymiser(b"k"), Pseudonymiser(b"k", undo=True)
    for value, behind in (("BE68 5390 0754 7034", " 2021"), ("AT61 1904 3002 3457 3201", " BIC"), ("2021-03-04", "T12:00:00Z"),
                          ("+1 (017) 555-7713", " 2021"), ("+44 20 7946 0958", " 2021"), ("4929 3483 8530 6306", " 2021")):
        alone, (text, found) = one.replace(value), one.replace(value + behind)
        assert len(found) == 1 and alone[0] != value and text == alone[0] + behind
        assert undo.replace(text)[0] == value + behind
    text, found = one.replace("1234 4929 3483 8530 6306")
    assert text == "1234 " + one.replace("4929 3483 8530 6306")[0] and len(found) == 1


def test_edited_notices_beside_exact_ones():
    right, wrong = "all rights reserved", "all rihts reserved"
    scanner, rng = Scanner(BASE, [n for n in FUZZY if n == Notice("reserved", right, 2)]), random.Random(5)
    for _ in range(200):
        parts = [rng.choice([right, wrong, "and", "some more words"]) for _ in range(rng.randrange(1, 8))]
        want, at = [], 0
        for part in parts:
            if part in (right, wrong):
                want.append((at, 3, int(part == wrong)))
            at += len(part.split())
        hits = scanner.scan(scanner.reduce(" ".join(parts))[0])
        assert sorted((h.first, h.words, h.edits) for h in hits if not h.base) == want


def edit(words, rng, most):
    """The words with up to so many characters deleted, doubled or changed, and how many."""
    letters, n = list(words), rng.randrange(most + 1)
    for at in rng.sample([i for i, c in enumerate(words) if c != " "], n):
        letters[at] = rng.choice(["", "q", letters[at] + "q"])
    return "".join(letters), n


def test_spans_of_every_notice():
    """Against every stretch of words, judged by the notice's pattern on that stretch alone."""
    rng = random.Random(11)
    for notice in FUZZY:
        scanner = Scanner([], [notice])
        for _ in range(12):
            parts = [rng.choice([edit(notice.words, rng, notice.edits)[0], "some other words", "license", "the"])
                     for _ in range(rng.randrange(1, 5))]
            joined, n_words = scanner.reduce(" ".join(parts))
            words = joined.split()
            # The fewest edits of each stretch that could match.
            size, cost = len(notice.words), {}
            for first in range(n_words):
                for behind in range(first + 1, n_words + 1):
                    stretch = " ".join(words[first:behind])
                    if abs(len(stretch) - size) <= notice.edits:
                        row = list(range(size + 1))
                        for i, c in enumerate(stretch, 1):
                            last, row = row, [i]
                            for j, d in enumerate(notice.words, 1):
                                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
                        if row[-1] <= notice.edits:
                            cost[first, behind - first] = row[-1]
            hits = sorted((h.first, h.words, h.edits) for h in scanner.scan(joined))
            assert all(cost[first, count] <= edits for first, count, edits in hits)
            assert all(a + n <= b for (a, n, _), (b, _, _) in zip(hits, hits[1:], strict=False))
            # Every stretch that matches meets a hit; the best of all is as good as the best hit.
            assert all(any(a < f + n and f < a + c for a, c, _ in hits) for f, n in cost)
            assert min(cost.values(), default=None) == min((e for _, _, e in hits), default=None)


def test_many_edited_notices_take_linear_time():
    scanner = Scanner(BASE, FUZZY)

    def seconds(n):
        begin = time.perf_counter()
        assert len(scanner.scan(scanner.reduce("all rihts reserved " * n)[0])) == n
        return time.perf_counter() - begin

    assert seconds(16_000) < 16 * seconds(2_000) + 1


def test_license_rows(spark):
    many = "all rihts reserved " * 3000
    docs = spark.createDataFrame([(1, many, "x"), (1, many, "x"), (None, "cc by", None)],
                                 "doc_id long, text string, n_words string")
    rows = scan_licenses(docs).collect()
    assert len(rows) == 3 and sum(r.doc_id is None and r.base_labels == "cc-by" for r in rows) == 1
    assert all(r.n_words == 9000 and len(r.spans) == 3000 for r in rows if r.doc_id == 1)
    assert not scan_licenses(docs.limit(0)).collect()


def test_dates_of_all_days_in_all_notations():
    one, undo = Pseudonymiser(b"k"), Pseudonymiser(b"k", undo=True)
    forms = ["{y}-{m:02d}-{d:02d}", "{y}.{m}.{d}", "{d:02d}/{m:02d}/{y}", "{d}/{m}/{y}", "{m:02d}/{d:02d}/{y}", "{m}-{d}-{y}",
             "{d:02d}/{m}/{y}"]
    seen, first = [set() for _ in forms], dt.date(1900, 1, 1)
    rng = random.Random(2)
    days = [first + dt.timedelta(days=n) for n in range(2000)]
    days += [first + dt.timedelta(days=rng.randrange(73049)) for _ in range(1500)]
    days = sorted({*days, dt.date(2099, 12, 31), dt.date(2000, 2, 29)})
    for day in days:
        new_days = set()
        for form, got in zip(forms, seen, strict=True):
            text = form.format(y=day.year, m=day.month, d=day.day)
            new = date(text, one.move)
            assert new != text and date(new, undo.move) == text and new not in got | {None}
            # Month first is read as day first where both are days; else all notations are linked.
            if form.index("{y") == 0 or form.index("{d") == 0 or day.day > 12:
                a, b, c = map(int, re.split(r"\D", new))
                new_days.add((a, b, c) if a > 31 else (c, b, a) if form.index("{d") == 0 else (c, a, b))
            got.add(new)
        assert len(new_days) == 1


def test_phones_in_several_notations_are_linked():
    one, undo = Pseudonymiser(b"k"), Pseudonymiser(b"k", undo=True)
    groups = [["+442079460958", "+44 20 7946 0958", "+44 (0)20 7946 0958", "+44-20-7946-0958"],
              ["(415) 555-2671", "+1 415 555 2671", "415-555-2671", "+1 (415) 555-2671", "+14155552671"],
              ["+351 212 345 678", "+351212345678"], ["+49 30 901820", "+4930901820"]]
    for group in groups:
        numbers = set()
        for text in group:
            new, found = one.replace(f"call {text} now")
            assert [k for _, _, k, _ in found] == ["phone"] and undo.replace(new)[0] == f"call {text} now"
            plain = phone(text, one.move)
            assert new == f"call {plain} now" and re.sub(r"\d", "0", plain) == re.sub(r"\d", "0", text)
            digits = re.sub(r"\D", "", plain.replace("(0)", ""))
            numbers.add(digits if text[0] == "+" else "1" + digits)
        assert len(numbers) == 1


def test_pseudonym_columns_that_clash_and_long_texts(spark):
    text = "a.b1@c.org " * 50_000
    docs = spark.createDataFrame([(1, text, "k", 5), (1, text, "k", 5), (None, None, None, None)],
                                 "doc_id long, text string, kinds string, spans int")
    rows = pseudonymise(docs).collect()
    assert sorted(r.n_found for r in rows) == [0, 50_000, 50_000] and {r.kinds for r in rows} == {"", "email"}
    assert not pseudonymise(docs.limit(0)).collect()
    new = pseudonymise_column(docs)
    assert new.columns == docs.columns and not pseudonymise_column(docs.limit(0)).collect()
    assert {(r.kinds, r.spans, r.text is None) for r in new.collect()} == {("k", 5, False), (None, None, True)}
    assert pseudonymise_column(new, undo=True).filter("text is not null").distinct().collect()[0].text == text
