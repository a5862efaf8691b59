"""Dictionaries as tables inside extraction: phrases of any number meet the words of texts.

A phrase is its letters and digits alone (umlauts folded, upper case), so
dashes, spaces, dots, ampersands and quotes in and between its words make no
difference: "Ast-Rein GmbH & Co.KG" is also "Ast - Rein GmbH & Co. KG".

Texts are cut into words with their places.  A word that opens no phrase goes no
further; behind one that does, the runs of as many words as its longest phrase
are looked up.  Both steps are equal joins: against a table that is counted as
small by broadcast, else by a shuffle in which each frequent word of the texts is
dealt over as many salts as its count asks for.  What comes back are the hits, so
texts are never shuffled.  A dictionary that is counted as small as a whole goes to
the texts instead: each batch of them is searched at once, and no word is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import places
from spanloom.functions import text as T
from spanloom.operators.recognizers import DETERMINERS, HOUSE, PREAMBLES, STREET, _GAP, _title

#: A dictionary side of at most so many rows is broadcast.
BROADCAST_ROWS = 100_000
#: Rows of one word that meet their phrases under one salt.
SALT_ROWS = 100_000
#: Words of one phrase lie apart by so many characters at most, none a letter or digit.
MOST_GAP = 4
WORD = r"[\p{L}\p{Nd}]+"
HIT = "struct<start:int,len:int,at:int,n_tok:int,value:string,gap:string,before:string,kinds:array<string>,phrase:string>"


def key(text: Column) -> Column:
    """Letters and digits alone, umlauts folded, in upper case."""
    return F.regexp_replace(T.folded_upper(text), r"[^\p{L}\p{Nd}]", "")


def entries(phrases: dict[str, DataFrame]) -> DataFrame:
    """kind, phrase, key, opener (its first word's key) and n_words of each different phrase; each table's first column holds the phrases."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(f"`{df.columns[0]}`").cast("string").alias("phrase")) for kind, df in phrases.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    words = T.matches(F.col("phrase"), WORD)
    rows = rows.select("kind", "phrase", key(F.col("phrase")).alias("key"), key(F.element_at(words, 1)).alias("opener"), F.size(words).alias("n_words"))
    return rows.where("n_words > 0").dropDuplicates(["kind", "key", "opener"])


def words(text: Column) -> Column:
    """Words in order: start, len, value, key, and the gap before (null if it is long)."""
    found = T.spans(F.coalesce(text, F.lit("")), WORD)

    def whole(w: Column) -> Column:
        def each(x: Column, i: Column) -> Column:
            last = F.get(w, i - 1)
            stop = F.coalesce(last["start"] + last["len"], F.lit(0))
            size = x["start"] - stop
            gap = F.when((i > 0) & (size <= MOST_GAP), F.substring(F.coalesce(text, F.lit("")), stop + 1, size))
            return F.struct(x["start"].alias("start"), x["len"].alias("len"), x["value"].alias("value"), key(x["value"]).alias("key"), gap.alias("gap"))

        return F.transform(w, each)

    return T.let(found, whole)


def met(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """The equal join of text rows with a dictionary side, whatever the sizes and however frequent a key is."""
    n = table.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on)
    frequent = rows.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > SALT_ROWS).select(on, F.ceil(F.col("_n") / SALT_ROWS).cast("int").alias("_salts"))
    salted = table.join(frequent, on, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    dealt = salted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    # At most 1/SALT_ROWS of the rows' number of keys are frequent; where even these are many, they meet by a shuffle too.
    known = rows.join(frequent, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    return known.join(dealt, [on, "_salt"]).drop("_salt")


def hits(docs: DataFrame, dictionary: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, len, at (the word's number), n_tok, value, gap and word before, kinds, phrase (as listed; a city's first): every run of words that is a phrase."""
    most = dictionary.agg(F.max("n_words")).first()[0] or 0
    openers = dictionary.groupBy("opener").agg(F.max("n_words").alias("most")).withColumnRenamed("opener", "word")
    own = F.min_by("phrase", F.struct(F.col("kind") != "city", "phrase"))
    by_key = dictionary.groupBy("key").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), own.alias("phrase"))
    if dictionary.count() <= BROADCAST_ROWS:
        return _searched(docs.select(F.col(doc_id).alias("doc_id"), *places.marked(F.col(text), WORD)), openers, by_key)
    listed = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    # A phrase written in fewer words than its entry is found, one in more words up to two more.
    reach = F.lit(most + 2)
    runs = F.transform(F.col("w"), lambda x, i: F.struct(i.cast("int").alias("at"), x["key"].alias("word"), F.get(F.col("w"), i - 1)["value"].alias("before"), F.slice(F.col("w"), i + 1, reach).alias("run")))
    tokens = listed.select("doc_id", F.explode(runs).alias("t")).select("doc_id", "t.*")
    opened = met(tokens, openers, "word")
    n = F.sequence(F.lit(1), F.least(F.col("most") + 2, F.size("run")))
    grams = opened.withColumn("n_tok", F.explode(n)).withColumn("part", F.slice("run", F.lit(1), F.col("n_tok")))
    close = F.forall("part", lambda x: (x["start"] == F.col("part")[0]["start"]) | x["gap"].isNotNull())
    grams = grams.where(close).select(
        "doc_id", "at", "n_tok", "before", F.col("part")[0]["start"].alias("start"), F.col("part")[0]["gap"].alias("gap"),
        F.array_join(F.transform("part", lambda x: x["key"]), "").alias("key"),
        F.array_join(F.transform("part", lambda x, i: F.when(i == 0, x["value"]).otherwise(F.concat(x["gap"], x["value"]))), "").alias("value"),
    )
    return met(grams, by_key, "key").select("doc_id", "start", F.length("value").alias("len"), "at", "n_tok", "value", "gap", "before", "kinds", "phrase")


#: For sums that tell words apart: the bytes of a word times the powers of this, so that the sum of a run follows from its words'.
BASE = 0x9E3779B97F4A7C15
_folds: dict[str, dict[int, str]] = {}


def _letters(spark: SparkSession) -> dict[int, str]:
    """The key of each letter or digit that is not its own, by Spark's rules of case (no letter beyond has two cases)."""
    app = spark.sparkContext.applicationId
    if app not in _folds:
        one = spark.range(0x30, 0x20000).where("id not between 55296 and 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
        _folds[app] = {r.id: r.k for r in one.where(F.col("c").rlike(WORD)).select("id", key(F.col("c")).alias("k"), "c").where("k <> c").collect()}
    return _folds[app]


def _keys(words: pa.Array, fold: dict[int, str]) -> pa.Array:
    """The keys of words (as `key` has them)."""
    plain = pc.ascii_upper(words)
    other = pc.not_equal(pc.binary_length(words), pc.utf8_length(words))
    return pc.replace_with_mask(plain, other, pa.array([w.translate(fold) for w in words.filter(other).to_pylist()], pa.string()))


def _sums(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each key's sum, and by what the sum of what stands behind it is multiplied."""
    size = pc.binary_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer("".join(keys.to_pylist()).encode(), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))

    def powers(base: int) -> np.ndarray:
        return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(data), base, np.uint64))))

    up = powers(BASE)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * up[:-1])))
    return (total[ends[1:]] - total[ends[:-1]]) * powers(pow(BASE, -1, 2**64))[ends[:-1]], up[size]


def _searched(texts: DataFrame, openers: DataFrame, by_key: DataFrame) -> DataFrame:
    """The hits of a small dictionary: runs of words are compared by sums, then by their keys."""
    listed = by_key.collect()
    keys, opens = pa.array([r.key for r in listed], pa.string()), openers.collect()
    data = (
        _letters(texts.sparkSession), pa.array([r.word for r in opens], pa.string()), np.array([r.most + 2 for r in opens] + [0]), keys, np.sort(_sums(keys)[0]),
        pa.array([r.kinds for r in listed], pa.list_(pa.string())), pa.array([r.phrase for r in listed], pa.string()),
    )
    shared = texts.sparkSession.sparkContext.broadcast(data)
    out = ["start", "len", "at", "n_tok", "value", "gap", "before", "kinds", "phrase"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, opens, longest_run, keys, sums, kinds, phrases = shared.value
        for batch in batches:
            for piece in places.sliced(batch):
                w = places.located(piece)
                if not len(w.row) or not len(sums):
                    continue
                coded = w.value.dictionary_encode()
                word = coded.indices.to_numpy()
                name = _keys(coded.dictionary, fold)
                reach = longest_run[pc.fill_null(pc.index_in(name, value_set=opens), len(opens)).to_numpy(zero_copy_only=False)]
                total, by = _sums(name)
                gap = w.start - np.concatenate((np.zeros(1, np.int64), (w.start + w.len)[:-1]))
                joins = (w.at > 0) & (gap <= MOST_GAP)
                first = np.flatnonzero(reach[word] > 0)
                run_sum, power, n = total[word[first]], by[word[first]], 1
                while len(first):
                    place = np.minimum(np.searchsorted(sums, run_sum), len(sums) - 1)
                    likely = first[sums[place] == run_sum]
                    if len(likely):
                        entry = pc.index_in(pc.binary_join_element_wise(*[name.take(pa.array(word[likely + k])) for k in range(n)], ""), value_set=keys)
                        likely, entry = likely[entry.is_valid().to_numpy(zero_copy_only=False)], entry.drop_null()
                    if len(likely):
                        at = w.element[likely]
                        value = pc.binary_join_element_wise(*[w.pieces.take(pa.array(at + k)) for k in range(2 * n - 1)], "")
                        some = w.at[likely] > 0
                        before = w.pieces.take(pa.array(np.where(some, at - 2, 0), mask=~some))
                        between = w.pieces.take(pa.array(at - 1, mask=~joins[likely]))
                        yield pa.RecordBatch.from_arrays(
                            [piece.column(0).take(pa.array(w.row[likely])), pa.array(w.start[likely], pa.int32()), pc.utf8_length(value).cast(pa.int32()), pa.array(w.at[likely], pa.int32()), pa.array(np.full(len(likely), n), pa.int32()),
                             value, between, before, kinds.take(entry), phrases.take(entry)], names=["doc_id", *out],
                        )
                    n += 1
                    more = (reach[word[first]] >= n) & (first + n - 1 < len(word))
                    first, run_sum, power = first[more], run_sum[more], power[more]
                    close = (w.row[first + n - 1] == w.row[first]) & joins[first + n - 1]
                    first, run_sum, power = first[close], run_sum[close], power[close]
                    run_sum, power = run_sum + power * total[word[first + n - 1]], power * by[word[first + n - 1]]

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, start int, len int, at int, n_tok int, value string, gap string, before string, kinds array<string>, phrase string")


def as_written(found: DataFrame, versions: DataFrame) -> DataFrame:
    """Hits that are written as one of their phrase's versions (phrase, version), in any case and with umlauts folded or not."""
    table = versions.select(F.col("phrase").alias("entry"), T.folded_upper(F.col("version")).alias("_version")).distinct()
    met_ = met(found.withColumn("_version", T.folded_upper(F.regexp_replace("value", r"\s+", " "))), table, "_version")
    return met_.where(key(F.col("entry")) == key(F.col("value"))).drop("_version")


def by_document(found: DataFrame) -> DataFrame:
    """doc_id and its hits in order of place."""
    fields = [F.col(c).alias(c) for c in ("start", "len", "at", "n_tok", "value", "gap", "before", "kinds", "phrase")]
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(f"array<{HIT}>").alias("hits"))


def of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda h: F.array_contains(h["kinds"], kind))


def longest(found: Column) -> Column:
    """Of hits that begin at one place the longest (they are in order of start and length)."""
    return F.filter(found, lambda h, i: F.coalesce(F.get(found, i + 1)["start"] != h["start"], F.lit(True)))


def _candidate(priority: int, label: str, recognizer: str, h: Column, attrs: dict[str, Column]) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in attrs.items()])
    return F.struct(
        F.lit(priority).alias("priority"), F.lit(label).alias("label"), F.lit(recognizer).alias("recognizer"), h["start"].alias("start"), h["len"].alias("len"), h["value"].alias("value"),
        F.filter(pairs, lambda p: p["value"].isNotNull()).alias("attrs"),
    )


def listed(found: Column, kind: str, form: str, priority: int, label: str, recognizer: str) -> Column:
    """Candidates that are a phrase as they stand, with a legal form (a phrase of kind form) right behind."""
    forms = longest(of_kind(found, form))

    def candidate(h: Column) -> Column:
        behind = F.get(F.filter(forms, lambda f: (f["at"] == h["at"] + h["n_tok"]) & f["gap"].rlike(r"^\s+$")), F.lit(0))

        def whole(f: Column) -> Column:
            value = F.concat(h["value"], F.coalesce(F.concat(f["gap"], f["value"]), F.lit("")))
            return _candidate(priority, label, recognizer, F.struct(h["start"].alias("start"), F.length(value).alias("len"), value.alias("value")), {"name": value})

        return T.let(behind, whole)

    return F.transform(longest(of_kind(found, kind)), candidate)


def announced(found: Column, announcements: Column, kind: str, priority: int, label: str, recognizer: str, attr: str, most: int = 3) -> Column:
    """Candidates that begin within `most` words behind an announcement: the nearest for each (announcements: the number of the next word)."""
    own = longest(of_kind(found, kind))

    def near(own_: Column) -> Column:
        def first(p: Column) -> Column:
            return F.get(F.filter(own_, lambda h: (h["at"] >= p) & (h["at"] <= p + most)), F.lit(0))

        return F.filter(F.transform(announcements, first), lambda h: h.isNotNull())

    return F.transform(T.let(own, near), lambda h: _candidate(priority, label, recognizer, h, {attr: F.lower(h["value"]) if attr != "place" else h["value"]}))


def names(found: Column, excluded: list[tuple[str, str]], priority: int) -> Column:
    """Given name and family name beside each other in either order, a comma between them or not; a family name may be double."""
    own = longest(F.filter(found, lambda h: F.arrays_overlap(h["kinds"], F.array(F.lit("firstname"), F.lit("surname")))))
    pairs = sorted({f"{a} {b}" for a, b in excluded} | {f"{b} {a}" for a, b in excluded})
    none = F.lit(None).cast("struct<start:int,len:int,value:string,front:string,back:string,turned:boolean>")

    def paired(h: Column) -> Column:
        def each(a: Column, i: Column) -> Column:
            b, c = F.get(h, i + 1), F.get(h, i + 2)
            beside = (b["at"] == a["at"] + a["n_tok"]) & b["gap"].rlike(r"^\s?,?\s?$")
            double_b = F.array_contains(b["kinds"], "surname") & F.array_contains(c["kinds"], "surname") & (c["at"] == b["at"] + b["n_tok"]) & c["gap"].rlike(r"^\s?-\s?$")
            first_a, last_a, first_b, last_b = (F.array_contains(x["kinds"], k) for x in (a, b) for k in ("firstname", "surname"))
            free = ~F.coalesce(F.lower(a["before"]).isin(DETERMINERS.split("|")), F.lit(False)) & ~F.concat(a["value"], F.lit(" "), b["value"]).isin(pairs or [""])

            def named(back: Column, turned: Column) -> Column:
                value = F.concat(a["value"], b["gap"], back)
                return F.struct(a["start"].alias("start"), F.length(value).alias("len"), value.alias("value"), a["value"].alias("front"), back.alias("back"), turned.alias("turned"))

            double = F.concat(b["value"], c["gap"], c["value"])
            return (
                F.when(beside & free & first_a & F.coalesce(double_b, F.lit(False)), named(double, F.lit(False)))
                .when(beside & free & first_a & last_b, named(b["value"], F.lit(False)))
                .when(beside & free & last_a & first_b, named(b["value"], F.lit(True)))
                .otherwise(none)
            )

        return F.filter(F.transform(h, each), lambda x: x.isNotNull())

    def candidate(x: Column) -> Column:
        given, family = (F.when(x["turned"], b).otherwise(a) for a, b in ((x["front"], x["back"]), (x["back"], x["front"])))
        return _candidate(priority, "Name", "name", x, {"firstname": given, "surname": family, "title": _title(x["value"])})

    return F.transform(T.let(own, paired), candidate)


#: What may stand between the parts of an address, and where a letter begins a name.
_BETWEEN = r"\s*(?:[,;–-]\s*)?"
_ZIP = r"(?<![\p{L}\p{Nd}])\d{5}\s+(?=\p{L})"


def address_marks(text: Column) -> Column:
    """Places of the parts of addresses that patterns tell: streets by their last word, house numbers, zip codes, and what leads from a street to a city or from a city to a street."""
    house = rf"\s{HOUSE}(?![\p{{L}}\p{{Nd}}])"
    none = F.array().cast(T.SPAN)

    def spans(pattern: str, guard: str = r"\d") -> Column:
        return F.when(text.rlike(guard), T.spans(text, pattern)).otherwise(none)

    return F.struct(
        spans(rf"(?<![\p{{L}}\p{{Nd}}]){STREET}(?!\p{{L}})").alias("streets"),
        spans(house).alias("houses"),
        spans(_ZIP).alias("zips"),
        spans(rf"(?<=[\p{{L}}.])(?:(?:{house})?{_BETWEEN}{_ZIP}|{house}{_BETWEEN}(?=\p{{Lu}}))").alias("to_city"),
        spans(rf"(?<=[\p{{L}})]){_BETWEEN}{STREET}(?!\p{{L}})(?:{house})?").alias("to_street"),
    )


def addresses(found: Column, marks: Column, zip_codes: list[str], priority: int) -> Column:
    """Addresses round cities that are phrases: street and house number before or behind, a zip code or a house number at least.

    Streets are phrases of kind street or those that patterns tell; a city's
    attribute is written as it is listed, whatever dashes and spaces the text has.
    """
    cities, listed_streets = longest(of_kind(found, "city")), longest(of_kind(found, "street"))

    def at_start(spans: Column, place: Column) -> Column:
        return F.get(F.filter(spans, lambda x: x["start"] == place), F.lit(0))

    def at_stop(spans: Column, place: Column) -> Column:
        return F.get(F.filter(spans, lambda x: x["start"] + x["len"] == place), F.lit(0))

    def built(streets_: Column, own: Column) -> Column:
        def candidate(c: Column) -> Column:
            stop = c["start"] + c["len"]
            joint, zip_ = at_stop(marks["to_city"], c["start"]), at_stop(marks["zips"], c["start"])
            before = F.coalesce(at_stop(own, joint["start"]), at_stop(F.transform(marks["streets"], _bare), joint["start"]))
            beside = F.get(F.filter(streets_, lambda s: (s["at"] == c["at"] + c["n_tok"]) & s["gap"].rlike(rf"^{_BETWEEN}$")), F.lit(0))
            house = at_start(marks["houses"], beside["start"] + beside["len"])
            behind = F.coalesce(F.concat(beside["gap"], beside["value"], F.coalesce(house["value"], F.lit(""))), at_start(marks["to_street"], stop)["value"])
            forward = before.isNotNull()
            value = F.when(forward, F.concat(before["value"], joint["value"], c["value"])).when(zip_.isNotNull(), F.concat(zip_["value"], c["value"], F.coalesce(behind, F.lit(""))))
            start = F.when(forward, before["start"]).otherwise(zip_["start"])
            side = F.when(forward, joint["value"]).otherwise(F.regexp_replace(behind, rf"^{_BETWEEN}", ""))
            number = F.when(forward, F.regexp_extract(side, rf"^\s({HOUSE})(?![\p{{L}}\p{{Nd}}])", 1)).otherwise(F.regexp_extract(side, rf"\s({HOUSE})$", 1))
            street = F.when(forward, before["value"]).otherwise(F.regexp_replace(side, rf"\s{HOUSE}$", ""))
            code = F.regexp_extract(F.coalesce(F.when(forward, joint["value"]), zip_["value"]), r"(\d{5})\s+$", 1)
            listed_code = code.isin(zip_codes) if zip_codes else ~code.startswith("00")
            # A house number of five digits is a zip code.
            attrs = {"street": F.nullif(street, F.lit("")), "house": F.nullif(F.regexp_replace(number, r"\s", ""), F.lit("")), "zip": F.nullif(code, F.lit("")), "city": c["phrase"]}
            span = F.struct(start.alias("start"), F.length(value).alias("len"), value.alias("value"))
            return F.when(value.isNotNull() & ((code == "") | listed_code), _candidate(priority, "Address", "address", span, attrs))

        return F.filter(F.transform(cities, candidate), lambda x: x.isNotNull())

    # Both kinds of streets have a place and a value.
    return T.let(listed_streets, lambda s: T.let(F.transform(s, _bare), lambda own: built(s, own)))


def _bare(h: Column) -> Column:
    return F.struct(h["start"].alias("start"), h["len"].alias("len"), h["value"].alias("value"))


def announcements(text: Column, kind: str) -> Column:
    """For each preamble of a kind the number of the word behind it."""
    pattern = rf"(?i)(?<![\p{{L}}]){PREAMBLES[kind]}{_GAP}"
    stops = F.transform(T.spans(text, pattern), lambda m: m["start"] + m["len"])
    # Words up to a place: as many as begin before it, which is one search of the text so far.
    return F.when(text.rlike(pattern), F.transform(stops, lambda p: F.regexp_count(F.substring(text, F.lit(1), p), F.lit(WORD)))).otherwise(F.array().cast("array<int>"))


def last_of(values: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row of the greatest order for each key: the current version of a dictionary whose rows carry one."""
    return values.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
