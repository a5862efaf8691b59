"""Work of short rows is dealt over tasks, and done once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom import queries as Q
from spanloom.functions import text as T
from spanloom.operators import matching, metrics
from spanloom.plans import extract as plans


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """2500 customers in one row group."""
    folder = tmp_path_factory.mktemp("tables")
    spark.range(1, 2501).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(folder / "customer.parquet"))
    return str(folder)


def largest_task(rows) -> int:
    return rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_letters_are_dealt(spark, customers):
    letters = Q.letters(spark, customers)
    assert letters.count() == 2500 and letters.select("doc_id").distinct().count() == 2500
    assert largest_task(letters) < 1250


def optimized(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("dictionaries", [False, True])
def test_patterns_stand_in_a_plan_once(spark, dictionaries):
    docs = spark.createDataFrame([(1, "Karte 4111 1111 1111 1111")], "doc_id long, text string")
    tables = {"company": spark.createDataFrame([("Nordwind",)], "phrase string")} if dictionaries else None
    found = plans.extract(docs, dictionaries=tables)
    assert not any("array_sort(" in line for line in optimized(found).splitlines() if line.lstrip(" :+-").startswith("Filter"))
    assert [r.label for r in found.collect()] == ["CreditCard"]


def test_combined_takes_rules_that_are_there(spark):
    docs = spark.createDataFrame([(1, "Herr Hans Meyer")], "doc_id long, text string")
    rules = spark.createDataFrame([(1, 0, 4, "X")], "doc_id long, start int, len int, label string")
    model = spark.createDataFrame([(1, 8, 2, "Y")], "doc_id long, start int, len int, label string")
    assert {r.label for r in plans.combined(docs, model, rules=rules).collect()} == {"X", "Y"}


@pytest.mark.parametrize("text", ["", "none", "a1b22", "1", "11￿2", "￿", "ä1\n2 ", "$1\\2"])
def test_spans(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(T.spans(F.col("text"), "[0-9]+").alias("s")).first()
    want, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in "0123456789":
            end += 1
        if end > at:
            want.append((at, end - at, text[at:end]))
        at = max(end, at + 1)
    assert [tuple(x) for x in row.s] == want


def test_a_table_in_many_small_tasks_stays(spark):
    assert Q.spread(spark.range(0, 400, 1, 4), 50).rdd.getNumPartitions() == 4
    assert Q.spread(spark.range(0, 404, 1, 4), 50).rdd.getNumPartitions() == 9
    assert Q.spread(spark.range(0), 50).count() == 0


def test_customers_and_lines_are_dealt(spark, tmp_path):
    spark.range(25_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert largest_task(Q.digit_candidates(spark, str(tmp_path), F.lit("1"))) < 125_000
    lines = spark.range(1200).select((F.col("id") % 300).alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"), F.col("id").alias("l_partkey"))
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    before, Q.LINES = Q.LINES, 100
    try:
        rows = Q._lines(spark, str(tmp_path))
        assert rows.count() == lines.select("l_orderkey", "l_linenumber").distinct().count() and largest_task(rows) < 400
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        Q.LINES = before


def test_common_words_in_small_slices(spark):
    pairs = spark.createDataFrame([(k, [str(k), "a"], ["a", str(k)]) for k in range(200)], "k long, ref array<string>, hyp array<string>").coalesce(1)
    own = {r.k: r.lcs for r in metrics.rouge_words(pairs, ["k"]).collect()}
    assert own == {k: metrics.common_words([str(k), "a"], ["a", str(k)]) for k in range(200)}


def merged_by_hand(rules: list[tuple], model: list[tuple]) -> list[tuple]:
    gone, out = set(), []
    for d, start, size, label in model:
        met = sorted(r[1:] for r in rules if r[0] == d and r[1] <= start + size and start <= r[1] + r[2])
        if not met:
            out.append((d, start, size, label, "model"))
        elif start <= met[0][0] and size > met[0][1]:
            gone.add((d, *met[0]))
            out += [x for x in [(d, start, size, label, "model")] if x not in out]
    return sorted(out + [(*r, "rules") for r in rules if r not in gone])


@pytest.mark.parametrize("most", [40, 2000])
def test_merge_is_one_shuffle_without_a_join(spark, most):
    """No side is broadcast, however small the estimate: letters made from keys hold more entities than the keys' bytes tell."""
    rng = random.Random(most)
    made = lambda labels, n: [(rng.randrange(20), rng.randrange(most), rng.randrange(most // 5), rng.choice(labels)) for _ in range(n)]
    rules, model = made("RS", 300), made("MN", 200)
    rules, model = rules + rules[:20], model + model[:20]
    schema = "doc_id long, start int, len int, label string"
    rows = matching.overlap_merge(spark.createDataFrame(rules, schema), spark.createDataFrame(model, schema))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(map(tuple, rows.collect())) == merged_by_hand(rules, model)
