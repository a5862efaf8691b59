from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spanloom.functions import text as T
from spanloom.operators import grouping, metrics, neural
from spanloom.sources import corpora, gazetteers

LABELS = ["O", "B-PER", "I-PER"]


def test_line_dictionaries(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Straße\n\n# comment\n  berlin \nBERLIN\n", encoding="utf-8")
    assert {r.phrase for r in gazetteers.read_lines(spark, f"{tmp_path}/a.txt").collect()} == {"STRAßE", "BERLIN"}
    (tmp_path / "b.txt").write_text("030; Berlin\n089;München\n030;again\n;none\n", encoding="utf-8")
    assert {r.code for r in gazetteers.read_codes(spark, f"{tmp_path}/b.txt").collect()} == {"030", "089"}
    (tmp_path / "c.txt").write_text("10115\nx\n80333\n10115\n")
    assert {r.code for r in gazetteers.read_integers(spark, f"{tmp_path}/c.txt").collect()} == {10115, 80333}


def test_xml_dictionaries(spark, tmp_path):
    (tmp_path / "u.xml").write_text("<r><tlds><t>com</t><t> de </t></tlds><s><u>ftp</u></s></r>")
    assert {r.value for r in gazetteers.read_xml_values(spark, f"{tmp_path}/u.xml", "r/tlds/t/text()").collect()} == {"com", "de"}
    (tmp_path / "n.xml").write_text('<names><name n1="Max" n2="Weber"/><name n1="a" n2="a"/></names>')
    got = {(r.n1, r.n2) for r in gazetteers.read_excluded_names(spark, f"{tmp_path}/n.xml").collect()}
    assert got == {("MAX", "WEBER"), ("WEBER", "MAX"), ("A", "A")}
    assert gazetteers.read_binary(spark, f"{tmp_path}/n.xml").first().content.startswith(b"<names>")


def test_conll_round_trip(spark, tmp_path):
    (tmp_path / "in.txt").write_text("Anna\tB-PER\nMeyer I-PER\n\nBerlin B-LOC\n.\n\n", encoding="utf-8")
    rows = corpora.read_conll(spark, f"{tmp_path}/in.txt")
    assert [(r.token, r.tag) for r in rows.orderBy("sent_id", "tok_id").collect()] == [("Anna", "B-PER"), ("Meyer", "I-PER"), ("Berlin", "B-LOC"), (".", "O")]
    corpora.write_conll(rows, f"{tmp_path}/out")
    again = corpora.read_conll(spark, f"{tmp_path}/out")
    assert sorted((r.token, r.tag) for r in again.collect()) == sorted((r.token, r.tag) for r in rows.collect())


def test_inline_tags(spark):
    lines = spark.createDataFrame([(1, "Heute kam <PER>Anna Meyer</PER> nach <G>Bonn</G> ."), (2, "nichts")], "id long, text string")
    got = [(r.id, r.token, r.tag) for r in corpora.inline_to_bio(lines).orderBy("id", "tok_id").collect()]
    assert got == [(1, "Heute", "O"), (1, "kam", "O"), (1, "Anna", "B-PER"), (1, "Meyer", "I-PER"), (1, "nach", "O"), (1, "Bonn", "B-LOC"), (1, ".", "O"), (2, "nichts", "O")]


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([(1, 4, 3, "Name", "A&B"), (1, 0, 2, "Url", "<x")], "doc_id long, start int, len int, label string, value string")
    assert corpora.to_json_rows(e).first().json.startswith('[{"start":0')
    assert "&lt;x" in corpora.to_html(e).first().html and "A&amp;B" in corpora.to_html(e).first().html
    corpora.append_log(spark.createDataFrame([("a",)], "value string"), f"{tmp_path}/log")
    corpora.append_log(spark.createDataFrame([("b",)], "value string"), f"{tmp_path}/log")
    assert spark.read.text(f"{tmp_path}/log").count() == 2
    w = spark.createDataFrame([("e", [2, 2], [1.0, 2.0, 3.0, 4.0])], "name string, shape array<int>, data array<float>")
    corpora.save_weights(w, f"{tmp_path}/w")
    assert corpora.load_weights(spark, f"{tmp_path}/w").first().shape == [2, 2]


def test_phrase_versions():
    assert gazetteers.separator_versions(["a", "b", "c"]) == ["a b c", "a b-c", "a-b c", "a-b-c"]
    assert gazetteers.dropped_versions("A.B!") == ["A.B", "A.B!", "AB", "AB!"]
    assert len(gazetteers.orders(["x", "y", "z"])) == 6


def tags(spark, *pairs):
    return spark.createDataFrame([(1, i, t, g) for i, (t, g) in enumerate(pairs)], "s long, tok_id int, token string, tag string")


def test_bio(spark):
    t = tags(spark, ("Von", "O"), ("der", "O"), ("Leyen", "B-PER"), ("sah", "O"), ("Bonn", "I-LOC"), ("Köln", "B-LOC"), ("Hans", "B-PER"))
    fixed = [r.tag for r in grouping.bio_repair(t, ["s"]).orderBy("tok_id").collect()]
    assert fixed == ["B-PER", "I-PER", "I-PER", "O", "I-LOC", "B-LOC", "B-PER"]
    chains = [(r.first_tok, r.n_tok, r.label, r.text) for r in grouping.bio_chains(grouping.bio_repair(t, ["s"]), ["s"]).orderBy("first_tok").collect()]
    assert chains == [(0, 3, "PER", "Von der Leyen"), (4, 1, "LOC", "Bonn"), (5, 1, "LOC", "Köln"), (6, 1, "PER", "Hans")]


def test_word_order(spark):
    t = spark.createDataFrame([(1, 0, 3, False), (1, 4, 1, True), (1, 5, 2, False), (1, 9, 2, False)], "d long, start int, len int, is_punct boolean")
    assert [r.order_num for r in grouping.word_order(t, ["d"]).orderBy("start").collect()] == [0, 0, 0, 1]


def test_longest_common_subsequence(spark):
    cases = [("a b c d", "b d"), ("a b", "c"), ("a", "a"), ("a b a b", "b a b a")]

    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rows = spark.createDataFrame(cases, "x string, y string").select("x", "y", metrics.longest_common(F.split("x", " "), F.split("y", " ")).alias("n")).collect()
    assert {(r.x, r.y): r.n for r in rows} == {(x, y): lcs(x.split(), y.split()) for x, y in cases}


def test_rouge_of_whole_turns(spark, tmp_path):
    """Words after the thirtieth count; words are distinct; and F1 is of the union over all pairs of a group."""
    rows = [(1, 0, " ".join(f"a{i}" for i in range(40)) + " x x y"), (1, 1, " ".join(f"b{i}" for i in range(40)) + " x x z y")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (got,) = __spark_entry__.queries()["rouge_pairs"](spark, str(tmp_path)).collect()
    assert (got.n_union, got.n_ref, got.n_hyp) == (2, 42, 43) and got.f1 == pytest.approx(4 / 85)
    pairs = spark.createDataFrame([(1, ["p", "q"], ["q"]), (1, ["r"], ["r", "s"])], "g long, ref array<string>, hyp array<string>")
    (got,) = metrics.rouge(pairs, ["g"]).collect()
    assert (got.n_union, got.n_ref, got.n_hyp) == (2, 3, 3)
    assert metrics.common_words(list("abab"), list("baba")) == list("bab")  # the reference goes left on ties


def test_chunks(spark):
    for n, want in ((5, [5]), (110, [110]), (121, [110]), (122, [110, 12]), (300, [110, 110, 80])):
        got = spark.range(1).select(neural.chunked(F.array_repeat(F.lit("w"), n)).alias("c")).first().c
        assert [len(x) for x in got] == want


def test_tagger(spark):
    rows = spark.createDataFrame([(1, [3, 4, 5]), (2, [7]), (3, [])], "sent_id long, ids array<int>")
    got = {r.sent_id: r.tags for r in neural.predict_tags(rows, neural.random_weights(50, 3), LABELS).collect()}
    assert [len(got[i]) for i in (1, 2, 3)] == [3, 1, 0] and set(sum(got.values(), [])) <= set(LABELS)
    w = {"w": neural.np.ones((4, 8)), "u": neural.np.ones((2, 8)), "b": neural.np.zeros(8)}
    assert neural.lstm(neural.np.ones((5, 4)), w).shape == (5, 2)


@pytest.mark.parametrize(("value", "want"), [("Müller & Co.", "MUELLER CO"), ("A-B/C", "A B C"), ("e.V.", "EV")])
def test_phrase_key(spark, value, want):
    assert spark.range(1).select(T.phrase_key(F.lit(value)).alias("k")).first().k == want


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if not n.startswith(("op", "pipeline", "letter_combined"))])
def test_queries_against_sql(spark, name):
    """Each query and its SQL give the same rows at the smallest scale."""
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    got = __spark_entry__.queries()[name](spark, sf)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)

    def plain(v):
        return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)
    assert a == b
