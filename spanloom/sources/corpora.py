"""Labelled corpora in and out, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INLINE_TAGS = {"PER": "PER", "N": "PER", "ORG": "ORG", "J": "ORG", "LOC": "LOC", "G": "LOC"}


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """sent_id, tok_id, token, tag.  `token<TAB or space>tag` lines; an empty line ends a sentence.

    Each sentence is read as one record (records end at empty lines), so no
    running sum over the file is needed to number them.
    """
    records = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    numbered = records.withColumn("sent_id", F.monotonically_increasing_id())
    lines = numbered.select("sent_id", F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("tok_id", "line"))
    parts = F.split(F.trim("line"), r"[\t ]+")
    return lines.select("sent_id", "tok_id", F.get(parts, 0).alias("token"), F.coalesce(F.get(parts, 1), F.lit("O")).alias("tag"))


def sentence_pairs(corpus: DataFrame) -> DataFrame:
    """sent_id, source and target: tokens and tags in order."""
    rows = F.array_sort(F.collect_list(F.struct("tok_id", "token", "tag")))
    return corpus.groupBy("sent_id").agg(rows.alias("rows")).select("sent_id", F.col("rows.token").alias("source"), F.col("rows.tag").alias("target"))


def inline_to_bio(lines: DataFrame, text: str = "text") -> DataFrame:
    """Sentences with inline tags (<PER>…</PER>, <N>, <ORG>, <J>, <LOC>, <G>) as tok_id, token, tag beside the other columns."""
    pieces = F.regexp_extract_all(text, F.lit(r"<(\w+)[^>]*>[^<]*</\1>|[^<]+"), F.lit(0))
    others = [c for c in lines.columns if c != text]
    kinds = F.create_map(*[F.lit(x) for kv in INLINE_TAGS.items() for x in kv])
    p = lines.select(*others, F.posexplode(pieces).alias("_p", "_piece"))
    p = p.withColumn("_kind", F.try_element_at(kinds, F.upper(F.regexp_extract("_piece", r"^<(\w+)", 1))))
    p = p.withColumn("_words", F.filter(F.split(F.regexp_replace("_piece", "<[^>]*>", ""), r"\s+"), lambda w: w != ""))
    p = p.select(*others, "_p", "_kind", F.posexplode("_words").alias("_w", "token"))
    tag = F.when(F.col("_kind").isNull(), "O").otherwise(F.concat(F.when(F.col("_w") == 0, "B-").otherwise("I-"), F.col("_kind")))
    order = W.partitionBy(*others).orderBy("_p", "_w") if others else W.orderBy("_p", "_w")
    return p.select(*others, (F.row_number().over(order) - 1).alias("tok_id"), "token", tag.alias("tag"))


def write_conll(corpus: DataFrame, path: str) -> None:
    """`token<TAB>tag` lines, an empty line after each sentence."""
    line = F.concat(F.array_join(F.transform(F.arrays_zip("source", "target"), lambda r: F.concat_ws("\t", r["source"], r["target"])), "\n"), F.lit("\n"))
    sentence_pairs(corpus).select(line.alias("value")).write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str) -> None:
    """Feature rows, tab-separated, for a sequence-model trainer."""
    features.write.mode("overwrite").csv(path, sep="\t")


def to_json_rows(entities: DataFrame) -> DataFrame:
    """doc_id and its entities as one JSON text."""
    rows = F.array_sort(F.collect_list(F.struct("start", "len", "label", "value")))
    return entities.groupBy("doc_id").agg(F.to_json(rows).alias("json"))


def to_html(entities: DataFrame) -> DataFrame:
    """doc_id and a table of its entities for reading."""

    def escaped(c):
        return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    cell = F.concat(F.lit("<tr><td>"), F.col("label"), F.lit("</td><td>"), escaped(F.col("value")), F.lit("</td></tr>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("start", cell.alias("row")))), lambda r: r["row"])
    return entities.groupBy("doc_id").agg(F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))


def append_log(requests: DataFrame, path: str) -> None:
    """Append lines (column value) to a log folder."""
    requests.select("value").write.mode("append").text(path)


def save_weights(weights: DataFrame, path: str) -> None:
    """name, shape, data: a model's arrays as a table."""
    weights.select("name", "shape", "data").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
