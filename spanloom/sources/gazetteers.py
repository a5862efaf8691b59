"""Dictionaries: readers for the usual file layouts, and small built-in lists that files replace.

Large dictionaries stay DataFrames and are met by joins (operators.matching);
the built-in ones are short enough to stand inside patterns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import permutations, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """phrase: lines of a text file, trimmed, in upper case; without empty lines, comments (#) and repeats."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(T.upper(line).alias("phrase")).distinct()


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """code, name: lines `code;name`."""
    rows = spark.read.schema("code string, name string").csv(path, sep=";")
    return rows.select(F.trim("code").alias("code"), F.trim("name").alias("name")).where("code <> ''").dropDuplicates(["code"])


def read_integers(spark: SparkSession, path: str) -> DataFrame:
    """code: whole numbers, one a line; other lines are passed over."""
    return spark.read.text(path).select(F.trim("value").try_cast("int").alias("code")).where("code is not null").distinct()


def read_xml_values(spark: SparkSession, path: str, xpath: str) -> DataFrame:
    """value: texts that an XPath finds in an XML file of resources (domains, schemes, abbreviations)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.xpath("value", F.lit(xpath))).alias("value")).select(F.trim("value").alias("value")).where("value <> ''").distinct()


def read_excluded_names(spark: SparkSession, path: str, row_tag: str = "name") -> DataFrame:
    """n1, n2: pairs of names that are none, in both orders.  The XML rows have attributes or elements n1 and n2."""
    rows = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "").schema("n1 string, n2 string").load(path)
    rows = rows.select(T.upper(F.trim("n1")).alias("n1"), T.upper(F.trim("n2")).alias("n2"))
    return rows.unionByName(rows.select(F.col("n2").alias("n1"), F.col("n1").alias("n2"))).distinct()


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path and content of resource or weight files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def separator_versions(words: list[str], separator: str = "-") -> list[str]:
    """All ways to put a separator or a space between neighbouring words."""
    return [words[0] + "".join(s + w for s, w in zip(marks, words[1:], strict=True)) for marks in product((" ", separator), repeat=len(words) - 1)] if words else []


def dropped_versions(phrase: str, characters: str = ".&\"'!") -> list[str]:
    """The phrase with every choice of these characters left out, without repeats."""
    kept = product(*[(c, "") if c in characters else (c,) for c in phrase])
    return sorted({re.sub(" +", " ", "".join(x)).strip() for x in kept})


def versions(entries: DataFrame, phrase: str = "phrase", separator: str = "-", characters: str = ".&\"'!", most: int = 10_000_000) -> DataFrame:
    """entries with version: every way to write a phrase, its own among them, without repeats.

    Each of the characters is left out or not; then each space between the words
    that remain is a space or the separator.  A phrase of w words and c such
    characters has at most 2 ** (w - 1 + c) versions; their sum is counted before
    any is made, and a dictionary with more than `most` is an error: such lists
    meet texts by operators.dictionary.key, which takes one row a phrase.  Null and
    blank phrases have no version; a version without words is none.
    """
    text = F.trim(F.regexp_replace(F.col(phrase), r"\s+", " "))
    optional = F.lit("[" + re.escape(characters) + "]")
    rows = entries.withColumn("_text", text).where("_text <> ''").withColumn("_optional", F.regexp_count("_text", optional))
    bits = F.col("_optional") + F.size(F.split("_text", " ")) - 1
    planned = rows.agg(F.sum(F.pow(F.lit(2.0), bits))).first()[0] or 0.0
    if planned > most:
        raise ValueError(f"{planned:.0f} versions are more than {most}")

    def bit(mask: Column, k: Column) -> Column:
        return F.pmod(F.floor(mask / F.pow(F.lit(2.0), k)), F.lit(2)) == 1

    def masks(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), F.pow(F.lit(2.0), n).cast("long") - 1))

    # The text between optional characters, with or without the character behind each piece.
    cut, marks = F.split("_text", optional), F.regexp_extract_all("_text", optional, F.lit(0))
    kept = F.array_join(F.transform(cut, lambda x, k: F.when(bit(F.col("_mask"), k) & F.get(marks, k).isNotNull(), F.concat(x, F.get(marks, k))).otherwise(x)), "")
    dropped = rows.withColumn("_mask", masks(F.col("_optional"))).withColumn("_text", F.trim(F.regexp_replace(kept, " +", " "))).where("_text <> ''")
    dropped = dropped.drop("_mask", "_optional").dropDuplicates()
    words = F.split("_text", " ")
    joined = F.array_join(F.transform(words, lambda w, k: F.when(k == 0, w).when(bit(F.col("_mask"), k - 1), F.concat(F.lit(separator), w)).otherwise(F.concat(F.lit(" "), w))), "")
    return dropped.withColumn("_mask", masks(F.size(words) - 1)).withColumn("version", joined).drop("_mask", "_text").dropDuplicates()


def orders(labels: list[str]) -> list[tuple[str, ...]]:
    """All orders of a set of labels."""
    return list(permutations(labels))


def symmetric(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("n2").alias("n1"), F.col("n1").alias("n2"))).distinct()


@dataclass
class Gazetteers:
    """Word lists of the recognisers.  Fixed values, short samples of each kind; pass fuller lists for real work."""

    tlds: list[str] = field(default_factory=lambda: "com org net edu gov int info biz name io app dev de at ch fr es it nl be pl cz dk se no fi uk ie us ca eu ru jp cn in br au example test".split())
    schemes: list[str] = field(default_factory=lambda: "http https ftp ftps sftp file mailto ssh git ldap news telnet".split())
    firstnames: list[str] = field(default_factory=lambda: "Anna Maria Sabine Petra Julia Katharina Laura Lena Sarah Eva Claudia Monika Max Hans Peter Thomas Michael Stefan Andreas Jan Paul Lukas Felix Jürgen Klaus Martin John James Mary Linda David Emma".split())
    surnames: list[str] = field(default_factory=lambda: "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Braun Zimmermann Krüger Hartmann Lange Werner Smith Johnson Brown Miller Davis Wilson".split())
    excluded: list[tuple[str, str]] = field(default_factory=lambda: [("Max", "Weber"), ("Klein", "Wolf")])
    cities: list[str] = field(default_factory=lambda: ["Berlin", "Hamburg", "München", "Köln", "Frankfurt am Main", "Frankfurt", "Stuttgart", "Düsseldorf", "Leipzig", "Dresden", "Bremen", "Hannover", "Nürnberg", "Bonn", "Münster", "Karlsruhe", "Mannheim", "Augsburg", "Kiel", "Freiburg", "Mainz", "Rostock", "Rotenburg (Wümme)", "Rotenburg", "Alsbach", "Alsbach-Hähnlein", "Montabaur", "Schkeuditz", "Mülheim an der Ruhr"])
    birthplaces: list[str] = field(default_factory=lambda: ["Berlin", "Hamburg", "München", "Köln", "Frankfurt am Main", "Frankfurt", "Leipzig", "Dresden", "Bremen", "Wien", "Zürich", "Rotenburg (Wümme)", "Rotenburg ( Wümme )", "Rotenburg", "Paris", "London", "Madrid"])
    nationalities: list[str] = field(default_factory=lambda: "deutsch österreichisch schweizerisch französisch spanisch italienisch polnisch türkisch griechisch russisch äthiopisch britisch german austrian swiss french spanish italian polish turkish greek russian british american".split())
    marital: list[str] = field(default_factory=lambda: ["verheiratet", "ledig", "geschieden", "verwitwet", "getrennt lebend", "getrennt", "verlobt", "eingetragene Lebenspartnerschaft", "durch Tod aufgelöste Lebenspartnerschaft", "durch Tod aufgeloeste Lebenspartnerschaft", "living together with the life partner", "married", "single", "divorced", "widowed", "separated"])
    companies: list[str] = field(default_factory=lambda: ["Musterwerke", "Nordlicht Reederei", "Alpenblick Hotels", "Rheintal Maschinenbau"])
    company_suffixes: list[str] = field(default_factory=lambda: ["GmbH & Co. KG", "GmbH & Co KG", "GmbH & Co.KG", "Ltd. & Co KG", "Ltd. & Co. KG", "B.V. & Co. KG", "gGmbH", "GmbH", "AG", "AöR", "KGaA", "KG", "OHG", "UG", "SE", "e.V.", "e. V.", "eG", "B.V.", "Ltd.", "Inc.", "LLC", "Corp."])
    company_prefixes: list[str] = field(default_factory=lambda: ["Stiftung", "Verein", "Bundesverband"])
    plate_areas: list[str] = field(default_factory=lambda: "B M K S D F L H HH HB HL HRO KA MA MH DA DO DU E EN ER FR FÜ GE GÖ HD HN HSK IN J KI KL KO KS LU MD MG MS MZ N OB OF OL P PB PF R RE RT SB SG SHA SI TR TÜ UL W WI WÜ WUP ZW".split())
    #: Known bank codes and zip codes; without a list, any of the right form.
    bank_codes: list[str] = field(default_factory=list)
    zip_codes: list[str] = field(default_factory=list)
    licence_authorities: list[str] = field(default_factory=lambda: ["J010", "N070", "F010", "J430", "F013", "B072"])
    old_passport_prefixes: list[str] = field(default_factory=lambda: ["E8448", "1220", "2720", "3720"])
    old_tax_prefixes: list[str] = field(default_factory=lambda: ["918", "218", "048", "21", "93", "10"])
    area_codes: dict[str, str] = field(default_factory=lambda: {"30": "Berlin", "40": "Hamburg", "89": "München", "221": "Köln", "69": "Frankfurt", "711": "Stuttgart", "211": "Düsseldorf", "341": "Leipzig", "351": "Dresden", "421": "Bremen", "511": "Hannover", "911": "Nürnberg", "228": "Bonn", "7042": "Vaihingen", "1802": "Service", "800": "Freephone"})
    mobile_codes: list[str] = field(default_factory=lambda: "151 152 157 159 160 162 163 170 171 172 173 174 175 176 177 178 179".split())
