"""Birth dates in a keyed cycle; names with given-name mentions, suffixes, hyphens, apostrophes and months; labelled phone numbers."""

from __future__ import annotations

import datetime
import json
import re

import pytest

from spanloom.llm import pii


def put(text: str) -> list[tuple[str, str]]:
    _, found = pii.replaced(text, b"k", lambda *_: None)
    return [(text[a:b], new) for a, b, _, new in found]


def test_dates_are_one_cycle():
    day = datetime.date(2020, 1, 1)
    dates = [(day + datetime.timedelta(k)).isoformat() for k in range(-400, 401)]
    new = [pii.next_date(b"k", d) for d in dates]
    assert len(set(new)) == len(dates) and all(a != b for a, b in zip(dates, new, strict=True))
    assert all(1900 <= datetime.date.fromisoformat(d).year <= 2029 for d in new)
    assert [pii.next_date(b"other", d) for d in dates] != new


def test_all_usual_dates_together():
    first = datetime.date(1900, 1, 1)
    n = (datetime.date(2030, 1, 1) - first).days
    new = {pii.next_date(b"k", (first + datetime.timedelta(k)).isoformat()) for k in range(n)}
    assert len(new) == n and min(new) == "1900-01-01" and max(new) == "2029-12-31"


@pytest.mark.parametrize("odd", ["1850-05-05", "1990-02-31", "1990-13-40", "0000-00-00", "9999-12-31"])
def test_other_dates_stay_of_their_kind(odd):
    new = pii.next_date(b"k", odd)
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", new) and new != odd
    right = lambda d: 1 <= int(d[5:7]) <= 12 and 1 <= int(d[8:]) <= 31
    assert right(new) == right(odd)
    try:
        assert not 1900 <= datetime.date.fromisoformat(new).year <= 2029  # those are the images of usual dates
    except ValueError:
        pass


def test_fifty_thousand_birth_dates_settle(spark):
    """More people than dates: all dates of 130 years, in several layouts."""
    first = datetime.date(1900, 1, 1)
    rows = []
    for k in range(50_000):
        d = first + datetime.timedelta(k % 47_482)
        rows.append((k, f"born {d.isoformat()}" if k % 2 else f"geboren am {d.day}.{d.month}.{d.year}"))
    got = {r.doc_id: json.loads(r.entities) for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "k").collect()}
    image = {}
    for k, text in rows:
        ((_, _, kind, new),) = got[k]
        old = pii.canonical("birth", re.search(r"\d[\d.-]+", text)[0])
        assert kind == "birth" and image.setdefault(old, pii.canonical("birth", new)) == pii.canonical("birth", new)
    assert len(set(image.values())) == len(image) == 47_482 and not any(a == b for a, b in image.items())


def test_given_name_mentions():
    (full, new), (given, short) = put("Mr John Smith met John.")
    assert (full, given) == ("John Smith", "John") and short == new.split()[0]
    (_, new), (caps, short) = put("Mrs Jane Roe called. JANE came.")
    assert caps == "JANE" and short == new.split()[0].upper()
    assert [m for m, _ in put("Mr J. Smith met Jo and Smith.")] == ["J. Smith", "Smith"]


@pytest.mark.parametrize("suffix", ["Jr.", "Sr", "II", "III"])
def test_suffixes_are_no_family_names(suffix):
    (a, new), (b, again) = put(f"Mr. Smith {suffix} saw Dr. Smith.")
    assert (a, b) == ("Smith", "Smith") and new == again


def test_months():
    assert [m for m, _ in put("Mr. May arrived in May, on 3 May and early May. May left.")] == ["May", "May"]
    assert [m for m, _ in put("Mrs. Roe left in May.")] == ["Roe"]


def test_format_of_names():
    (_, double), (_, irish) = put("Frau Müller-Lüdenscheidt und Mr O'Brien")
    assert re.fullmatch(r"[A-Z][a-z]+-[A-Z][a-z]+", double) and re.fullmatch(r"O'[A-Z][a-z]+", irish)
    assert put("Mr O’BRIEN")[0][1].startswith("O’") and put("Mr O’BRIEN")[0][1].isupper()


def test_labelled_phone_numbers():
    assert [re.sub(r"\d", "0", n) for _, n in put("Tel 030/1234567, Fax: (030) 123 456, Tel. +49 30 901820")] == ["000/0000000", "(000) 000 000", "+00 00 000000"]
    assert put("Seite 030/1234567") == []


def test_very_long_texts():
    text = "word " * 400_000 + "Mr John Smith, born 1980-01-02. " + "x" * 1_000_000 + " John Smith"
    assert [m for m, _ in put(text)] == ["John Smith", "1980-01-02", "John Smith"]
