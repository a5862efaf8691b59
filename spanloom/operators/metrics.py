"""Document relevance, label scores, vocabularies and corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from spanloom.functions import text as T

# What an entity of each label adds, and which labels weigh how by their share.
LABEL_VALUES = {
    "Address": 1, "PhoneNumber": 1, "Email": 1, "Birthplace": 1, "MaritalStatus": 1, "Nationality": 1,
    "AccountNumber": 30, "CreditCard": 30, "HealthInsurance": 30,
    "PassportIdCardNumber": 20, "CarNumber": 20, "DriverLicense": 20, "SocialSecurity": 20, "TaxIdentification": 20,
}
SOFT = ["Name", "MaritalStatus", "Address", "Birthplace", "PhoneNumber", "Nationality", "Email"]
HARD = ["AccountNumber", "CreditCard", "PassportIdCardNumber", "CarNumber", "HealthInsurance", "DriverLicense", "SocialSecurity", "TaxIdentification"]
#: Pairs of texts that are compared at once.
PAIRS = 64
FOCUS = {"Birthday": (0, -2, -5, -10), "soft": (0, -1, -2, -3), "hard": (1, 2, 3, 5)}


def label_value(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LABEL_VALUES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label), F.lit(0))


def focus(label: Column, percent: Column) -> Column:
    """What each entity of a label adds by the label's share of the document's entities."""

    def by_share(steps: tuple) -> Column:
        return F.when(percent <= 50, steps[0]).when(percent <= 74, steps[1]).when(percent <= 89, steps[2]).otherwise(steps[3])

    return F.when(label == "Birthday", by_share(FOCUS["Birthday"])).when(label.isin(SOFT), by_share(FOCUS["soft"])).when(label.isin(HARD), by_share(FOCUS["hard"])).otherwise(0)


def relevance(entities: DataFrame) -> DataFrame:
    """doc_id, n_entities, n_categories, score: two levels of counts, both combined before the shuffle."""
    labels = entities.groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("doc_id"))
    labels = labels.withColumn("share", F.floor(F.col("n") * 100 / total))
    points = 10 + 2 * F.col("n") + F.col("n") * label_value(F.col("label")) + F.col("n") * focus(F.col("label"), F.col("share"))
    return labels.groupBy("doc_id").agg(F.sum("n").alias("n_entities"), F.count("*").alias("n_categories"), F.sum(points).cast("long").alias("score"))


def relevance_of(entities: Column) -> Column:
    """The same score from an array of entities, within the row."""
    n = F.size(entities)
    labels = F.array_distinct(F.transform(entities, lambda e: e["label"]))

    def points(label: Column) -> Column:
        own = F.struct(label.alias("label"), F.size(F.filter(entities, lambda e: e["label"] == label)).alias("n"))
        return T.let(own, lambda o: 10 + o["n"] * (2 + label_value(o["label"]) + focus(o["label"], F.floor(o["n"] * 100 / n))))

    return F.aggregate(F.transform(labels, points), F.lit(0).cast("long"), lambda a, b: a + b)


def label_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("label").agg(F.count("*").alias("n_entities"), F.countDistinct("doc_id").alias("n_docs"))


def label_scores(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """label, tp, n_ref, n_hyp, precision, recall, f1 of reference and hypothesis tags (ref, hyp), for each class."""
    per = pairs.select(F.explode(F.array(F.struct(F.col("ref").alias("label"), F.lit(1).alias("r"), F.lit(0).alias("h"), (F.col("ref") == F.col("hyp")).cast("int").alias("t")), F.struct(F.col("hyp").alias("label"), F.lit(0).alias("r"), F.lit(1).alias("h"), F.lit(0).alias("t")))).alias("x"))
    sums = per.groupBy("x.label").agg(F.sum("x.t").alias("tp"), F.sum("x.r").alias("n_ref"), F.sum("x.h").alias("n_hyp"))
    out = classes.join(sums, "label", "left").na.fill(0, ["tp", "n_ref", "n_hyp"])
    p = F.when(F.col("n_hyp") > 0, F.col("tp") / F.col("n_hyp")).otherwise(0.0)
    r = F.when(F.col("n_ref") > 0, F.col("tp") / F.col("n_ref")).otherwise(0.0)
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def macro_f1(scores: DataFrame) -> DataFrame:
    """The mean over all classes; one that never occurs counts as 0."""
    return scores.agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_classes"))


def vocabulary(tokens: DataFrame, size: int, column: str = "token", first_id: int = 3) -> DataFrame:
    """token, n, id: the size most frequent tokens, ties in order of the token; ids follow the reserved ones."""
    counts = tokens.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(size)
    return counts.withColumn("id", F.row_number().over(W.orderBy(F.desc("n"), column)) + first_id - 1)


def length_histogram(lengths: DataFrame, width: int = 100) -> DataFrame:
    """bucket, n and the running share in percent of lengths (column n)."""
    counts = lengths.groupBy(F.floor(F.col("n") / width).alias("bucket")).agg(F.count("*").alias("n"))
    run = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("percent", F.sum("n").over(run) * 100 / F.sum("n").over(W.partitionBy()))


def vocabulary_ratio(tokens: DataFrame, vocab: DataFrame, by: list[str]) -> DataFrame:
    """Share of each group's tokens that the vocabulary has."""
    known = tokens.join(vocab.select("token", F.lit(1).alias("_in")), "token", "left")
    return known.groupBy(*by).agg(F.avg(F.coalesce("_in", F.lit(0))).alias("ratio"), F.count("*").alias("n"))


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short arrays: a fold over one row of the table after another."""
    zero = F.transform(b, lambda _: F.lit(0))

    def row(last: Column, x: Column) -> Column:
        cells = F.arrays_zip(b.alias("y"), last.alias("up"), F.concat(F.array(F.lit(0)), last).alias("corner"))
        start = F.struct(F.lit(0).alias("left"), F.array().cast("array<int>").alias("out"))

        def cell(acc: Column, c: Column) -> Column:
            best = F.when(c["y"] == x, c["corner"] + 1).otherwise(F.greatest(c["up"], acc["left"]))
            return F.struct(best.alias("left"), F.concat(acc["out"], F.array(best)).alias("out"))

        return F.aggregate(F.slice(cells, 1, F.size(b)), start, cell, lambda acc: acc["out"])

    return F.coalesce(F.array_max(F.aggregate(a, zero, row)), F.lit(0))


def common_words(a: list[str], b: list[str]) -> list[str]:
    """The words of the longest common subsequence, chosen as the reference walks back; the table is filled row by row."""
    ids = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in words], np.int64) for words in (a, b))
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x)):
        # A cell is the most of the one above, the one before, and one more than the corner where the words are equal.
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], (table[i, :-1] + 1) * (y == x[i])))
    out, i, j = [], len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1, j] > table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def rouge_words(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The columns of by, ref, hyp and lcs for pairs with ref and hyp (arrays of words): the common words of whole arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few pairs at a time are Python objects, however many rows a batch has.
        for batch in (b.slice(k, PAIRS) for b in batches for k in range(0, len(b), PAIRS)):
            ref, hyp = batch.column("ref").to_pylist(), batch.column("hyp").to_pylist()
            lcs = pa.array([common_words(a or [], b or []) for a, b in zip(ref, hyp, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*by, "ref", "hyp"]), lcs], names=[*by, "ref", "hyp", "lcs"])

    rows = pairs.select(*by, "ref", "hyp")
    return rows.mapInArrow(run, StructType([*rows.schema, StructField("lcs", ArrayType(StringType()))]))


def rouge(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n_union, n_ref, n_hyp, precision, recall, f1 of each group of pairs: distinct words of all common subsequences over those of ref and hyp."""
    lcs = rouge_words(pairs, by)
    words = lcs.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("words")) for k in ("lcs", "ref", "hyp")])).alias("s"))
    words = words.select(*by, "s.k", F.explode_outer("s.words").alias("word"))
    sizes = words.distinct().groupBy(*by).agg(*[F.count_if((F.col("k") == k) & F.col("word").isNotNull() & ((F.lit(k) != "lcs") | (F.col("word") != ""))).alias(n) for k, n in (("lcs", "n_union"), ("ref", "n_ref"), ("hyp", "n_hyp"))])
    p = F.when(F.col("n_hyp") > 0, F.col("n_union") / F.col("n_hyp")).otherwise(0.0)
    r = F.when(F.col("n_ref") > 0, F.col("n_union") / F.col("n_ref")).otherwise(0.0)
    return sizes.select(*by, "n_union", "n_ref", "n_hyp", p.alias("precision"), r.alias("recall"), F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
