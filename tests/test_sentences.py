"""Golden cases for each rule of the full splitter; places; time in proportion to the text."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from spanloom.functions.sentences import split_full

CASES = [
    # line feeds, end of text
    ["Erste Zeile", "\n", "zweite Zeile ohne Punkt"], ["Ein Satz.", " \r\n\t", "Noch einer."],
    # plain ends
    ["Er kam.", " ", "Sie ging."], ["Er kam!", " ", "Sie ging?", "  ", "Ja."], ["Ende.", " ", "7 Leute kamen."], ["Er lief um 3.5 km und www.x.de kam."],
    # abbreviations
    ["Dr. Maier kam mit Fr. Weber, Nr. 5 und Prof. Koch."], ["Wir haben Obst, Brot usw. auf dem Tisch."], ["Wir haben Obst usw.", " ", "Er ging."], ["Das gilt z. B. hier und u. a. dort."],
    # three dots
    ["Er kam... und ging."], ["Er kam...", " ", "Dann ging er."], ["Er kam… und ging."], ["Er kam…", " ", "Dann."],
    # single capitals, Roman numbers, other alphabets
    ["Peter F. Müller kam."], ["Das war Kapitel V.", " ", "Danach kam nichts."], ["Das war C.", " ", "Он ушёл."],
    # numbers and lists
    ["Am 3. Mai kam er um 5. Sie nicht."], ["Er hatte 1250.", " ", "Sie nicht."], ["9. Der neunte Punkt.", " ", "10. Der zehnte."], ["Es war so.", " ", "1234. Das steht da."],
    # streets, small letters
    ["Er wohnt Hauptstr. 5 in Ulm."], ["Die Lange Str. Nord ist lang."], ["Das war ein ende. und weiter."],
    # marks within brackets and quotes
    ["Er fragte (wirklich? ja!) Heute nicht."], ["Er rief \"Halt! Stehen bleiben!\" und ging.", " ", "Dann kam er."], ["Er rief „Halt! Stopp“ laut."], ["Er sagte: \"Ich gehe.", " ", "Du bleibst!\"", " ", "Gut!", " ", "So."],
    # closing marks, quotes with a dash, commas
    ["(Das war alles.)", " ", "Dann nichts."], ["\"Ich gehe.\"", " ", "Er ging."], ["Er kam. , dann nicht."], ["Ich gehe. \"- sagte er."],
    # smileys open nothing
    ["Toll :( aber gut!", " ", "Ja."], ["Toll ;-) wirklich!", " ", "Ja."],
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, "".join(c)) for i, c in enumerate(CASES)] + [(1000, ""), (1001, None), (1002, " \n ")], "i int, t string")
    return {r.i: r.s for r in docs.select("i", split_full(F.col("t")).alias("s")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(found, i):
    assert [s.value for s in found[i]] == CASES[i][::2]
    text = "".join(CASES[i])
    assert all(text[s.start : s.start + s.len] == s.value for s in found[i])


def test_nothing(found):
    assert found[1000] == found[1001] == found[1002] == []


def test_time_in_proportion(spark):
    took = {}
    for n in (500, 5000, 20_000):
        docs = spark.createDataFrame([("Dr. Maier rief „Halt!“ und ging. Dann (so?) kam Frau Öz. " * n,)], "t string")
        began = time.perf_counter()
        assert docs.select(F.size(split_full(F.col("t"))).alias("n")).first().n == 2 * n
        took[n] = time.perf_counter() - began
    assert took[20_000] < 8 * took[5000] + 5
