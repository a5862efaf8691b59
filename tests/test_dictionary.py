"""Dictionary tables in extraction: the same rows as the built-in lists, versions of a phrase, large lists, frequent words."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.operators import dictionary as D
from spanloom.plans.extract import extract
from spanloom.queries import built_in_dictionaries


def table(spark, phrases):
    return spark.createDataFrame([(p,) for p in phrases], "phrase string")


def found(df):
    return sorted((r.doc_id, r.start, r.len, r.label, r.value) for r in df.collect())


TEXTS = [
    "Gez. Anna Müller, Krüger Hans und die Maria Koch. Max Weber nicht.",
    "Peter Schmidt-Braun, Staatsangehörigkeit: ist wohl äthiopisch, Geburtsort Frankfurt am Main",
    "Familienstand ist getrennt lebend. Nationality  British. Place of birth Madrid",
    "Bei Rheintal Maschinenbau GmbH & Co. KG und Nordlicht Reederei, Tel 030/20458931",
    "", None, "müller anna", "Geburtsort weit weg von Berlin, geboren in Wien", "Eva, Koch; Jan Bauer",
]


def test_same_rows_as_the_built_in_lists(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    built_in = {"name", "birthplace", "nationality", "marital", "company_list", "phone_preamble"}
    a = found(extract(docs, enabled=built_in))
    b = found(extract(docs, enabled=built_in, dictionaries=built_in_dictionaries(spark)))
    # Words meet in any case; the patterns of names in the list's own.
    assert [x for x in b if x not in a] == [(6, 0, 11, "Name", "müller anna")]
    assert [x for x in a if x not in b] == []
    attrs = {r.value: dict(r.attrs) for r in extract(docs, enabled=built_in, dictionaries=built_in_dictionaries(spark)).collect()}
    assert attrs["Peter Schmidt-Braun"] == {"firstname": "Peter", "surname": "Schmidt-Braun"}
    assert attrs["Krüger Hans"] == {"firstname": "Hans", "surname": "Krüger"}


@pytest.mark.parametrize("text", ["Nord-Stern Hölzl GmbH & Co.KG", "Nord - Stern Hölzl GmbH&CoKG", "nord stern hoelzl gmbh co kg", 'NORD-STERN "Hölzl" GmbH Co KG', "Nord Stern HÖLZL GmbHCoKG"])
def test_versions_of_a_phrase(spark, text):
    docs = spark.createDataFrame([(1, f"an {text} nach")], "doc_id long, text string")
    (row,) = extract(docs, enabled={"company_list"}, dictionaries={"company": table(spark, ['"Nord-Stern" Hölzl GmbH & Co. KG'])}).collect()
    assert (row.start, row.value) == (3, text)


def test_what_is_no_phrase(spark):
    docs = spark.createDataFrame([(1, "Nord ..... Stern"), (2, "Nordstern"), (3, "NordSternX"), (4, "Nord Sternen")], "doc_id long, text string")
    assert extract(docs, enabled={"company_list"}, dictionaries={"company": table(spark, ["Nord Stern"])}).count() == 0


@pytest.mark.parametrize("limit", [0, 100_000])
def test_against_a_walk_over_words(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(D, "SALT_ROWS", 20)
    rng = random.Random(limit)
    words = ["alpha", "beta", "gamma", "delta", "ähre"]
    phrases = {" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(12)}
    texts = [" ".join(rng.choices([*words, "x", "y"], k=rng.randint(0, 30))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.value) for r in D.hits(docs, D.entries({"company": table(spark, phrases)})).collect())
    want = []
    for i, t in enumerate(texts):
        places = [(m.start(), m.end()) for m in re.finditer(r"\w+", t)]
        for a in range(len(places)):
            want += [(i, places[a][0], t[places[a][0] : places[b][1]]) for b in range(a, len(places)) if t[places[a][0] : places[b][1]] in phrases]
    assert got == sorted(want)


def test_a_million_phrases(spark):
    n = 1_000_000
    companies = spark.range(n).select(F.concat(F.lit("Werk "), F.col("id").cast("string"), F.lit(" Nord")).alias("name"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("Lieferung an Werk-"), (F.col("id") * 4001 % (2 * n)).cast("string"), F.lit(" Nord GmbH, dann an Werk Süd.")).alias("text"))
    got = {r.doc_id: r.value for r in extract(docs, enabled={"company_list"}, dictionaries={"company": companies}).collect()}
    assert got == {i: f"Werk-{i * 4001 % (2 * n)} Nord GmbH" for i in range(300) if i * 4001 % (2 * n) < n}


def test_bad_kinds(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="no dictionary"):
        extract(docs, dictionaries={"street": table(spark, ["a"])})
    with pytest.raises(ValueError, match="together"):
        extract(docs, dictionaries={"surname": table(spark, ["a"])})
    assert extract(docs, enabled={"company_list"}, dictionaries={"company": table(spark, [])}).count() == 0


def test_a_small_dictionary_makes_no_row_of_a_word(spark, monkeypatch):
    """Texts are searched by batches; the rows are those of the joins, whatever the marks, cases and slices."""
    words = ["alpha", "Gamma", "ähre", "Straße", "STRASSE", "ŉx", "ﬁn", "ΐ", "ɤ", "𐐨𐐩", "42"]
    gaps = [" ", "-", ". ", "     ", "￿", "\n", "🙂", ""]
    rng = random.Random(5)
    phrases = D.entries({k: table(spark, [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(30)]) for k in ("company", "city")})
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", None, "￿", "alpha"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for limit, size in ((0, 2_000_000), (100_000, 2_000_000), (100_000, 50)):
        monkeypatch.setattr(D, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(D.places, "SLICE", size)
        rows = D.hits(docs, phrases)
        if limit:
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "Generate" not in plan and "Join" not in plan and "Exchange" not in plan
        found.append(sorted(map(repr, rows.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 500


def test_announcements_count_words_by_one_search(spark):
    texts = ["Geburtsort Wien", "a b-c Geburtsort: Wien, dann Geburtsort ist Ulm", "Geburtsort", "", None, "￿x￿ ä1 geburtsort in X", "kein Ort", "\\n Geburtsort\\nWien"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pattern = rf"(?i)(?<![\p{{L}}]){D.PREAMBLES['birthplace']}{D._GAP}"
    words = F.transform(D.T.spans(F.col("text"), pattern), lambda m: F.size(F.filter(D.T.spans(F.col("text"), D.WORD), lambda x: x["start"] < m["start"] + m["len"])))
    rows = docs.select(D.announcements(F.col("text"), "birthplace").alias("a"), F.coalesce(words, F.array().cast("array<int>")).alias("b"))
    assert [r.a for r in rows.collect()] == [r.b for r in rows.collect()]
    plan = docs.select(D.announcements(F.col("text"), "birthplace").alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert D.WORD in plan and f"regexp_replace(text#{plan.split('text#')[1].split(',')[0]}, {D.WORD}" not in plan
