from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import checks as C
from spanloom.functions import sentences as S
from spanloom.functions import text as T
from spanloom.plans.extract import _ordered, entities_of, extract, scored, united_entities
from spanloom.operators.metrics import relevance
from spanloom.operators.resolve import resolved

GOLDEN = [
    ("Karte 5432110051294969 und 3600 6666 3333 44 und 4111 1111 1111 1111", [("CreditCard", "5432110051294969"), ("CreditCard", "3600 6666 3333 44"), ("CreditCard", "4111 1111 1111 1111")]),
    ("Nummern I526064554, A123456780 K734027627; Z610573490 Q327812091", [("HealthInsurance", x) for x in ("I526064554", "A123456780", "K734027627", "Z610573490", "Q327812091")]),
    ("Rentennummer 15070649C103 oder 13 020281 W 025 oder 12/190367/K/001 oder 04-150872-P-084", [("SocialSecurity", x) for x in ("15070649C103", "13 020281 W 025", "12/190367/K/001", "04-150872-P-084")]),
    ("Pass C73Z12345 und L6Z3PGVYC und L6Z3PGVYC3 und Y0GZC137N1 und E8448784", [("PassportIdCardNumber", x) for x in ("C73Z12345", "L6Z3PGVYC", "L6Z3PGVYC3", "Y0GZC137N1", "E8448784")]),
    ("Steueridentifikationsnr. 81872495633", [("TaxIdentification", "81872495633")]),
    ("Tax-ID 86 095 742 719", [("TaxIdentification", "86 095 742 719")]),
    ("Steuer-IdNr. 47/036/892/816", [("TaxIdentification", "47/036/892/816")]),
    ("St-Nr. 21/815/08150", [("TaxIdentification", "21/815/08150")]),
    ("Wagen MH-MT 2105 oder D-KA-8136", [("CarNumber", "MH-MT 2105"), ("CarNumber", "D-KA-8136")]),
    ("IBAN: DE91370501980061183273", [("AccountNumber", "DE91370501980061183273")]),
    ("Überweisung (BLZ 60010070), Kto.-Nr. 385550708", [("AccountNumber", "BLZ 60010070), Kto.-Nr. 385550708")]),
    ("Tel 01802/550444 und Fax 030/20458931", [("PhoneNumber", "01802/550444"), ("PhoneNumber", "030/20458931")]),
    ("Geburtsdatum 11.11.1971", [("Birthday", "Geburtsdatum 11.11.1971")]),
    ("am 11.11.1972 geboren", [("Birthday", "11.11.1972")]),
    ("Geb. am 25.01.77", [("Birthday", "Geb. am 25.01.77")]),
    ("Staatsangehörigkeit äthiopisch", [("Nationality", "äthiopisch")]),
    ("P.O.B. Rotenburg ( Wümme )", [("Birthplace", "Rotenburg ( Wümme )")]),
    ("Familienstand verheiratet", [("MaritalStatus", "verheiratet")]),
    ("Aktenzeichen Ist 8-F-48-03", [("CustomerNumber", "8-F-48-03")]),
    ("Vertragsnummer AID073453343", [("CustomerNumber", "AID073453343")]),
    ("Sie erreichen www.x-kom.de, google.com und user[at]host.de", [("Url", "www.x-kom.de"), ("Url", "google.com"), ("Email", "user[at]host.de")]),
    ("Er wohnt Max-Joseph-Str. 2 B - 80333 München", [("Address", "Max-Joseph-Str. 2 B - 80333 München")]),
    ("Wir danken der Internationale Bodensee Tourismus GmbH", [("Company", "Internationale Bodensee Tourismus GmbH")]),
    ("Anwesend war Herr Peter Schmidt", [("Name", "Herr Peter Schmidt")]),
    ("Gez. Anna Müller, Krüger Hans", [("Name", "Anna Müller"), ("Name", "Krüger Hans")]),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)] + [(1000, None), (1001, "")], "doc_id long, text string")
    return extract(docs).collect()


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(found, i):
    own = [(r.label, r.value) for r in sorted(found, key=lambda r: r.start) if r.doc_id == i]
    assert own == GOLDEN[i][1]


def test_places_and_overlaps(found):
    for r in found:
        text = GOLDEN[r.doc_id][0]
        assert text[r.start : r.start + r.len] == r.value
    by = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        assert r.start >= by.get(r.doc_id, 0)
        by[r.doc_id] = r.start + r.len


def test_attributes(spark):
    docs = spark.createDataFrame([(1, "Tel 01802/550444, Geburtsdatum 5. März 1968. IBAN DE89 3704 0044 0532 0130 00. Frau Anna Müller-Schmidt")], "doc_id long, text string")
    got = {r.label: r.attrs for r in extract(docs).collect()}
    assert got["Birthday"]["date"] == "1968-03-05"
    assert got["AccountNumber"]["bank_code"] == "37040044" and got["AccountNumber"]["iban_valid"] == "true"
    assert got["PhoneNumber"]["type"] == "Telephone"
    assert got["Name"]["surname"] == "Müller-Schmidt" and got["Name"]["title"] == "Frau"


def test_scores_agree(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "doc_id long, text string")
    a = {r.doc_id: (r.n_entities, r.n_categories, r.score) for r in scored(docs).collect()}
    b = {r.doc_id: (r.n_entities, r.n_categories, r.score) for r in relevance(extract(docs)).collect()}
    assert a == b
    assert a[0] == (3, 1, 10 + 6 + 90 + 15)


def test_united(spark):
    docs = spark.createDataFrame([(1, "Herr Peter Schmidt, Familienstand ledig, Tel 030/20458931. " + "wort " * 20 + "IBAN DE91370501980061183273")], "doc_id long, text string")
    (row,) = united_entities(docs).collect()
    assert [m.label for m in row.members] == ["Name", "MaritalStatus", "PhoneNumber"]


@pytest.mark.parametrize(
    ("value", "shape"),
    [("МТС", "AllCapital"), ("ABS", "AllCapital"), ("Thatcher", "LatinFirstCapital"), ("FireFox", "MixCapital"), ("U.N.", "AllCapitalWithDot"), ("A7", "NumCapital"), ("5F", "NumCapital"), ("F", "OneCapital"), ("F.", "OneCapitalWithDot"),
     ("iPad", "FirstLowerWithUpper"), ("XIV", "LatinCapital"), ("«", "Quote"), ("12:30", "Num"), ("wort", "Other"), ("St.-P", "MixCapital"), ("V-I.A", "MixCapitalWithDot")],
)
def test_shapes(spark, value, shape):
    assert spark.range(1).select(T.shape(F.lit(value)).alias("s")).first().s == shape


def test_tokens(spark):
    def toks(text):
        return [t.value for t in spark.range(1).select(T.tokens(F.lit(text)).alias("t")).first().t]

    assert toks("Der Müller-Verlag, Str. 5") == ["Der", "Müller-Verlag", ",", "Str.", "5"]
    assert toks("e.V. 12:30 a -- b") == ["e.", "V.", "12:30", "a", "--", "b"]
    assert toks("(x)") == ["(", "x", ")"]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_scanned(spark, n):
    values = [(k * 37) % 101 - 50 for k in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(
        T.scanned(F.col("v"), F.lit(0), lambda x, y: x + y).alias("sums"), T.scanned(F.col("v"), F.lit(-99), lambda x, y: F.greatest(x, y)).alias("tops")
    ).first()
    assert row.sums == [sum(values[:k]) for k in range(n)]
    assert row.tops == [max([-99, *values[:k]]) for k in range(n)]


def test_spans_of_a_long_text(spark):
    text = " ".join(f"ö{k} ÄB" for k in range(30_000))
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(T.spans(F.col("t"), "[0-9]+")).alias("s")).select("s.*").collect()
    assert [tuple(x) for x in got] == [(m.start(), len(m[0]), m[0]) for m in re.finditer("[0-9]+", text)]


def test_resolved_against_one_list(spark):
    kind = "struct<priority:int,start:int,len:int>"
    draw = random.Random(5)
    rows = [(k, [(draw.randrange(4), draw.randrange(9 * n + 1), draw.randrange(1, 7)) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 5, 40, 400, 400])]
    df = spark.createDataFrame(rows, f"k int, c array<{kind}>").select("k", resolved(F.col("c"), F.array().cast(f"array<{kind}>")).alias("out"))
    for k, out in df.collect():
        kept = []
        for p, s, n in sorted(rows[k][1], key=lambda c: (c[0], -c[2], c[1])):
            if all(b + m <= s or s + n <= b for _, b, m in kept):
                kept.append((p, s, n))
        assert [tuple(x) for x in out] == sorted(kept, key=lambda c: c[1])


def test_order_numbers_count_gaps(spark):
    text = "Herr Peter Schmidt, 030/20458931\nund  Frau Anna Weber\t01802/550444 " * 60
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = rows.select("doc_id", F.explode(_ordered(F.col("text"), entities_of("text", None, None))).alias("o")).select("doc_id", "o.e.start", "o.order_num").collect()
    assert len(got) >= 240 and {r.doc_id for r in got} == {1}
    assert all(r.order_num == len(re.findall(r"\s+", text[: r.start])) for r in got)


def test_sentences(spark):
    row = spark.range(1).select(
        T.sentences(F.lit("Ein Satz.\nZwei! Sätze hier. Noch einer.\nHauptstr.\n5 Ende.")).alias("a"),
        S.sentences_full(F.lit("Dr. Maier kam um 5. Er ging! Am 3. Mai\nneue Zeile.")).alias("b"),
    ).first()
    assert row.a == ["Ein Satz.", "Zwei! Sätze hier. Noch einer.", "Hauptstr.\n5 Ende."]
    assert row.b == ["Dr. Maier kam um 5. Er ging!", "Am 3. Mai", "neue Zeile."]


def test_check_digits_have_one_digit(spark):
    """Each payload has exactly one check digit that holds."""
    base = spark.range(200).crossJoin(spark.range(10).withColumnRenamed("id", "d"))
    n8 = F.lpad(F.col("id").cast("string"), 8, "0")
    health = F.concat(F.char(F.lit(65) + F.pmod("id", F.lit(26))), n8, F.col("d").cast("string"))
    tax = F.concat(F.lpad((F.col("id") * 7919).cast("string"), 10, "1"), F.col("d").cast("string"))
    card = F.concat(F.lpad((F.col("id") * 104729).cast("string"), 15, "4"), F.col("d").cast("string"))
    for check in (C.health_insurance(health), C.tax_id(tax), C.luhn(card), C.luhn(card, strict=True)):
        assert base.where(check).groupBy("id").count().where("count = 1").count() == 200


def test_dates(spark):
    want = {"11.11.1971": "1971-11-11", "25.01.77": "1977-01-25", "25. Januar 1979": "1979-01-25", "25/01/1982": "1982-01-25", "1.2.05": "2005-02-01", "1999-12-31": "1999-12-31", "31.02.2000": None, "foo": None}
    rows = spark.createDataFrame(list(want.items()), "t string, w string").select("t", C.parse_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in rows} == want


def test_brackets(spark):
    want = {"(a[b]{c})": True, "(a": False, "a)": False, "([)]": False, "": True, "Tel 0": True}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", T.bracket_balance(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in rows} == want


def test_stream(spark, tmp_path):
    from spanloom.streaming import stream

    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, "Mail an a.b@example.com"), (2, "nichts")], "doc_id long, text string").write.parquet(src)
    stream.write_entities(stream.entity_stream(stream.document_stream(spark, src)), out, f"{tmp_path}/cp").awaitTermination()
    assert spark.read.text(out).count() == 1
