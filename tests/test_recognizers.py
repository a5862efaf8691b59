"""Recognisers whose values have many forms: companies, bank accounts, file numbers, marital status, addresses."""

from __future__ import annotations

import pytest

from spanloom.plans.extract import extract
from spanloom.sources.gazetteers import Gazetteers

COMPANIES = [
    "Henkel AG", "wurfel GmbH", "RWE AG", "Kronos Ltd. & Co KG", "tonies SE", "Acme Inc.",  # the word before, in any case
    "Oldenburger Baugesellschaft mbH", "NORDIS Gesellschaft mbH",  # ...gesellschaft mbH
    "Deutsche Post AG", "Theater Bremen gGmbH", "Hallenbad Bad-Ems GmbH", "Deutsches Haus für Kinder e.V.", "Hotel am Alten Markt GmbH", "Kulturregion Hannover Südheide gGmbH",  # an opening word
    "MVB Verkehrsbund Ems-Weser GmbH", "NDR Media GmbH", "KTE Kommunale Entsorgungsgesellschaft mbH", "LHB Portfolio AöR", "A+C Meier GmbH",  # an abbreviation
    "Linde Holding GmbH", "Basler Deutschland Holding GmbH", "Corpus Real Estate GmbH & Co KG", "Corpus Real Estate Service GmbH", "Sat.2 Media SE", "Ecco (Deutschland) AG", "Sybase Deutschland B.V. & Co. KG",  # middle words
    "Stiftung Berliner-Mauer", "Stiftung für Kinder-Hilfe", "Stiftung zur Förderung",
]

CASES = [
    ("Emsland Wasserservice e.V.", "Company", ["Wasserservice e.V."]),
    ("bei der Firma, sagt die GmbH & Co. KG", "Company", []),
    ("Kontoinhaber: Jutta Ehlers Kontonummer: 8112345678\nGeldinstitut: Volksbank Ems Bankleitzahl: 28069956", "AccountNumber", ["Kontoinhaber: Jutta Ehlers Kontonummer: 8112345678\nGeldinstitut: Volksbank Ems Bankleitzahl: 28069956"]),
    ("Bankleitzahl: 28069956 Kontonummer: 8112345678", "AccountNumber", ["Bankleitzahl: 28069956 Kontonummer: 8112345678"]),
    ("Konto 8112345678, BLZ 280 699 56", "AccountNumber", ["Konto 8112345678, BLZ 280 699 56"]),
    ("BLZ 28069956 Kto 123456 BLZ 37050198 Kto 7654321 Konto 999999", "AccountNumber", ["BLZ 28069956 Kto 123456", "BLZ 37050198 Kto 7654321"]),
    ("Konto 8112345678, Kontoinhaber: Jutta Ehlers", "AccountNumber", []),  # no bank code
    ("Konto 8112345678 steht weit weg von der BLZ 28069956", "AccountNumber", []),
    ("BLZ 99999999 Kto 123456", "AccountNumber", []),  # no clearing area 9
    ("Aktenzeichen 7-Bz-12-03 und Aktenzeichen 5.3247.431218.8, Vertragsnummer KLM073453343 Otto", "CustomerNumber", ["7-Bz-12-03", "5.3247.431218.8", "KLM073453343"]),
    ("Aktenzeichen Otto", "CustomerNumber", []),
    ("Verheiratet ja. Verheiratet: nein. Ledig wohl nein\nMarried no", "MaritalStatus", ["ja", "nein", "nein", "no"]),
    ("Er ist verheiratet und sagt ja", "MaritalStatus", []),
    ("Verheiratet eins zwei drei vier ja", "MaritalStatus", []),
    ("Beziehungsverhaeltnis durch Tod aufgeloeste Lebenspartnerschaft; Civil status: living together with the life partner", "MaritalStatus", ["durch Tod aufgeloeste Lebenspartnerschaft", "living together with the life partner"]),
    ("Tel. (01802/550433) und (Tel. 030/1234567)", "PhoneNumber", ["(01802/550433)", "030/1234567"]),
    ("Lange Straße 2, 80333 Alsbach - Hähnlein", "Address", ["Lange Straße 2, 80333 Alsbach - Hähnlein"]),
    ("80333 Alsbach Hähnlein", "Address", ["80333 Alsbach Hähnlein"]),
    ("Lange Straße 2, 00333 Berlin", "Address", []),
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [f"Vertrag mit\n{c}\nvom Mai" for c in COMPANIES] + [t for t, _, _ in CASES]
    rows = {}
    for r in extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert texts[r.doc_id][r.start : r.start + r.len] == r.value
        rows.setdefault(r.doc_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.start) for k, v in rows.items()}


@pytest.mark.parametrize("i", range(len(COMPANIES)))
def test_companies(found, i):
    assert [(r.label, r.value) for r in found.get(i, [])] == [("Company", COMPANIES[i])]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(found, i):
    assert [r.value for r in found.get(len(COMPANIES) + i, []) if r.label == CASES[i][1]] == CASES[i][2]


def test_attributes(spark):
    texts = [CASES[2][0], "Internationale Nordsee -  Tourismus GmbH", CASES[16][0], "Verheiratet: nein", "Konto 8112345678, BLZ 280 699 56"]
    attrs = {r.doc_id: dict(r.attrs) for r in extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert attrs[0] == {"bank_code": "28069956", "account": "8112345678", "bank": "Volksbank Ems", "owner": "Jutta Ehlers"}
    assert attrs[1] == {"name": "Internationale Nordsee-Tourismus GmbH"}
    assert attrs[2]["city"] == "Alsbach-Hähnlein" and attrs[2]["house"] == "2"
    assert attrs[3] == {"answer": "no"}
    assert attrs[4] == {"bank_code": "28069956", "account": "8112345678"}


def test_lists_of_codes(spark):
    g = Gazetteers(bank_codes=["28069956"], zip_codes=["80333"])
    docs = spark.createDataFrame([(1, "BLZ 28069956 Kto 123456"), (2, "BLZ 37050198 Kto 123456"), (3, "80333 München"), (4, "80334 München")], "doc_id long, text string")
    assert {r.doc_id for r in extract(docs, g).collect() if r.label in ("AccountNumber", "Address")} == {1, 3}
