"""Addresses from tables of cities and streets, written versions of phrases, and a model's words with their places."""

from __future__ import annotations

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from spanloom import queries as Q
from spanloom.functions import places
from spanloom.functions import text as T
from spanloom.operators import dictionary as D
from spanloom.plans.extract import extract
from spanloom.sources import gazetteers

CITIES = ["Alsbach-Hähnlein", "Alsbach", "Schkeuditz", "Montabaur", "Mülheim an der Ruhr", "Anning bei Sankt Georgen"]
STREETS = ["Am Rain", "Monsigniore-Seidinger-Straße"]
#: text, then street, house, zip and city of each address in it.
ADDRESSES = [
    ("Kern - Max-Joseph-Str. 2 B - \r\n 80333 \r\n Alsbach - xz 089/5116-0 ...", [("Max-Joseph-Str.", "2B", "80333", "Alsbach")]),
    ("Kern - Max-Joseph-Str. 2 B - \r\n 80333 \r\n Alsbach - Hähnlein - xz 089/5116-0 ...", [("Max-Joseph-Str.", "2B", "80333", "Alsbach-Hähnlein")]),
    ("Kern - Max-Joseph-Str. 2 B - \r\n 80333 \r\n Alsbach Hähnlein - xz 089/5116-0 ...", [("Max-Joseph-Str.", "2B", "80333", "Alsbach-Hähnlein")]),
    ("in 04435 Schkeuditz, Am Rain 5 C, Am Rain 5 C - 04435 Schkeuditz", [("Am Rain", "5C", "04435", "Schkeuditz")] * 2),
    ("Leipziger Str. 04435 Schkeuditz", [("Leipziger Str.", None, "04435", "Schkeuditz")]),
    (" 56410 Montabaur, Elgendorfer Str. ", [("Elgendorfer Str.", None, "56410", "Montabaur")]),
    ("45470 Mülheim an der Ruhr, \r\n Schultenberg 54C  (0,06", [("Schultenberg", "54C", "45470", "Mülheim an der Ruhr")]),
    ("Monsigniore Seidinger Straße, 56410 Anning bei Sankt Georgen", [("Monsigniore Seidinger Straße", None, "56410", "Anning bei Sankt Georgen")]),
    (" 56410 Anning bei Sankt Georgen, Monsigniore Seidinger Straße ", [("Monsigniore Seidinger Straße", None, "56410", "Anning bei Sankt Georgen")]),
    ("Am Rain 5, Schkeuditz", [("Am Rain", "5", None, "Schkeuditz")]),
    ("Schkeuditz am Rain", []), ("00435 Schkeuditz", []), ("Am Rain 5, 04435 Leipzig", []), ("", []), (None, []),
]


def table(spark, phrases):
    return spark.createDataFrame([(p,) for p in phrases], "phrase string")


def test_addresses(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(ADDRESSES)], "doc_id long, text string")
    got = {}
    for r in extract(docs, enabled={"address"}, dictionaries={"city": table(spark, CITIES), "street": table(spark, STREETS)}).orderBy("start").collect():
        assert ADDRESSES[r.doc_id][0][r.start : r.start + r.len] == r.value
        got.setdefault(r.doc_id, []).append(tuple(r.attrs.get(a) for a in ("street", "house", "zip", "city")))
    assert [got.get(k, []) for k in range(len(ADDRESSES))] == [want for _, want in ADDRESSES]
    with pytest.raises(ValueError, match="beside cities"):
        extract(docs, dictionaries={"street": table(spark, STREETS)})


def written(phrase: str) -> set[str]:
    """Versions by plain recursion over characters, then over spaces."""
    out = set()
    for kept in product(*[(c, "") if c in ".&\"'!" else (c,) for c in phrase]):
        words = "".join(kept).split()
        out |= {words[0] + "".join(m + w for m, w in zip(marks, words[1:], strict=True)) for marks in product(" -", repeat=len(words) - 1)} if words else set()
    return out


PHRASES = ["Müller & Söhne", "J. & K. Werke GmbH", "Kern", "  Am   Markt ", "...", "", "R'n'B-Haus", "&"]


def test_versions(spark):
    rows = gazetteers.versions(table(spark, [*PHRASES, None])).collect()
    assert len(rows) == len(set(rows))
    got = {}
    for r in rows:
        got.setdefault(r.phrase, set()).add(r.version)
    assert got == {p: written(p) for p in PHRASES if written(p)}
    with pytest.raises(ValueError, match="versions are more than 100"):
        gazetteers.versions(table(spark, PHRASES), most=100)


def test_a_company_in_every_allowed_writing(spark):
    entry = "Müller & Söhne"
    forms = sorted(written(entry))
    other = ["Müller - Söhne", "MüllerSöhne", "Müller, Söhne", "Müller und Söhne"]
    docs = spark.createDataFrame([(k, f"an {w} heute") for k, w in enumerate([*forms, *other, "MUELLER  SÖHNE"])], "doc_id long, text string")
    entries = table(spark, [entry, "Söhne Müller"])
    found = D.as_written(D.hits(docs, D.entries({"company": entries})), gazetteers.versions(entries)).collect()
    assert sorted((r.doc_id, r.start, r.entry) for r in found) == [(k, 3, entry) for k in [*range(len(forms)), len(forms) + len(other)]]


URLS = T.url_pattern(["de", "com"], ["https", "http"])
WORDS = [
    ("Am 3. 5. – 7,5 % „Ja“ sagte's", [("Am", "Am"), ("[%NUM%]", "3. 5."), ("-", "–"), ("[%NUM%]", "7,5"), ("%", "%"), ("\"", "„"), ("Ja", "Ja"), ("\"", "“"), ("sagte", "sagte"), ("'", "'"), ("s", "s")]),
    ("Siehe https://a-b.de/x?y=1, dann m.k@x.de -- 12 13 14", [("Siehe", "Siehe"), ("https://a-b.de/x?y=1", "https://a-b.de/x?y=1"), (",", ","), ("dann", "dann"), ("m.k@x.de", "m.k@x.de"), ("-", "--"), ("[%NUM%]", "12 13 14")]),
    ("1 2", [("[%NUM%]", "1 2")]), ("a ''b'' ,,c", [("a", "a"), ("\"", "''"), ("b", "b"), ("\"", "''"), (",", ",,"), ("c", "c")]), ("😀 1 a", [("😀", "😀"), ("[%NUM%]", "1"), ("a", "a")]), ("", []), (None, None),
]


def test_model_words_and_their_places(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(WORDS)], "k long, text string")
    rows = docs.select("k", T.model_words(F.col("text"), URLS).alias("w")).orderBy("k").collect()
    for (text, want), row in zip(WORDS, rows, strict=True):
        if not want:
            assert not row.w
            continue
        assert [(w.value, text[w.start : w.start + w.len]) for w in row.w] == want
        gaps = [text[a.start + a.len : b.start] for a, b in zip(row.w, row.w[1:], strict=False)]
        assert all(re.fullmatch(r"\s*", g) for g in gaps)


def test_model_words_of_a_long_text(spark):
    text = "12 " * 5_000 + "Ende " + "7 8 x " * 1_000
    docs = spark.createDataFrame([(text,)], "text string")
    (row,) = docs.select(T.model_words(F.col("text"), URLS).alias("w")).collect()
    assert len(row.w) == 2 + 2_000 and row.w[0].len == 14_999
    assert all(text[w.start : w.start + w.len] == {"[%NUM%]": "7 8"}.get(w.value, w.value) for w in row.w[1:])


def test_model_words_by_batches(spark, monkeypatch):
    """The same words and places without a fold over arrays: the plan has no row for a match but what Python gives back."""
    tlds, schemes = ["de", "com", "рф"], ["https", "http"]
    pieces = ["Am", "3.", "5", "–", "--", "„Ja“", "sagte's", "''", ",,", "٣", "ä1", "x@y.de", "https://a-b.de/x?y=1", "ü.рф", "1.рф", "№", "😀", "￿", "a￿b", "««", "[%NUM%]", "12/3", "www.1.", "\u2028"]
    rng = random.Random(6)
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(150)] + [t for t, _ in WORDS] + ["", "￿", "1 " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = docs.select("doc_id", F.posexplode(T.model_words(F.coalesce("text", F.lit("")), T.url_pattern(tlds, schemes))).alias("tok_id", "w"))
    want = sorted(map(repr, words.select("doc_id", "tok_id", "w.start", "w.len", "w.value").collect()))
    for size in (50, 2_000_000):
        monkeypatch.setattr(places, "SLICE", size)
        got = places.model_words(docs, tlds, schemes)
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, got.collect())) == want


def test_model_input_goes_by_batches(spark):
    plan = Q.model_input(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
