"""Documents to resolved entities, groups and scores.

Everything up to the entities of a document is one narrow projection: patterns,
checks and the choice among overlaps are expressions on the row, so reading
and extraction are one stage without a shuffle.  A cheap test on the text
guards each recogniser that needs digits or a keyword.
"""

from __future__ import annotations

from pyspark import SparkContext, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import dictionary as D
from spanloom.operators import grouping, metrics
from spanloom.operators.matching import overlap_merge
from spanloom.operators.recognizers import Recognizer, candidates, recognizers
from spanloom.operators.resolve import resolved
from spanloom.sources.gazetteers import Gazetteers

ENTITY = "struct<priority:int,label:string,recognizer:string,start:int,len:int,value:string,attrs:array<struct<key:string,value:string>>>"
#: What a text must have before a recogniser's pattern is tried; the cheap test comes first.
GUARDS = {
    "email": r"@|\(at\)|\[at\]", "address": r"\d", "phone_preamble": r"\d", "iban": r"DE\d{2}", "customer": r"\d", "birthday": r"\d", "card": r"\d{4}", "passport": r"\d",
    "car": r"\d", "health": r"[A-Z]\d{9}", "driver": r"\d{5}", "ssn": r"\d{6}", "tax": r"\d", "phone": r"\d{3}",
}


def candidate_array(text: Column, gazetteers: Gazetteers | None = None, enabled: set[str] | None = None) -> Column:
    """All candidates of a text; enabled: names of recognisers, all by default."""
    chosen: list[tuple[int, Recognizer]] = [(k, r) for k, r in enumerate(recognizers(gazetteers or Gazetteers())) if enabled is None or r.name in enabled]
    none = F.array().cast(f"array<{ENTITY}>")
    parts = []
    for k, r in chosen:
        found = candidates(text, r, k)
        guard = r.guard or GUARDS.get(r.name)
        parts.append(F.when(text.rlike(guard), found).otherwise(none) if guard else found)
    return F.concat(none, *[F.coalesce(p, none) for p in parts])


def entity_array(text: Column, gazetteers: Gazetteers | None = None, enabled: set[str] | None = None) -> Column:
    """The resolved entities of a text."""
    return resolved(candidate_array(text, gazetteers, enabled), F.array().cast(f"array<{ENTITY}>"))


_built: dict[tuple, Column] = {}


def _kept(make, text: str, gazetteers: Gazetteers | None, enabled: set[str] | None) -> Column:
    """An expression on a column by name.  Building it takes thousands of calls to the JVM, so it is kept."""
    key = (make.__name__, id(SparkContext._active_spark_context), text, repr(gazetteers or Gazetteers()), tuple(sorted(enabled)) if enabled is not None else None)
    if key not in _built:
        _built[key] = make(F.col(text), gazetteers, enabled)
    return _built[key]


def entities_of(text: str, gazetteers: Gazetteers | None, enabled: set[str] | None) -> Column:
    return _kept(entity_array, text, gazetteers, enabled)


def candidates_of(text: str, gazetteers: Gazetteers | None, enabled: set[str] | None) -> Column:
    return _kept(candidate_array, text, gazetteers, enabled)


#: Kinds of dictionary tables, and the recognisers whose built-in lists they replace.
DICTIONARIES = {"company": {"company_list"}, "firstname": {"name"}, "surname": {"name"}, "birthplace": {"birthplace"}, "nationality": {"nationality"}, "marital": {"marital"}, "city": {"address"}, "street": {"address"}}


def _with_dictionaries(docs: DataFrame, dictionaries: dict[str, DataFrame], gazetteers: Gazetteers | None, enabled: set[str] | None, text: str) -> tuple[DataFrame, Column]:
    """Rows with doc_id, and their entities: candidates of patterns and of dictionary tables, resolved together.

    Patterns run on the text where it lies; words and phrases meet by joins; then
    each document's candidates, not its text, meet by doc_id (which is unique).
    """
    g = gazetteers or Gazetteers()
    if unknown := sorted(set(dictionaries) - set(DICTIONARIES)):
        raise ValueError(f"no dictionary of kind {', '.join(unknown)}")
    if len({"firstname", "surname"} & set(dictionaries)) == 1:
        raise ValueError("given names and family names are looked up together")
    if "street" in dictionaries and "city" not in dictionaries:
        raise ValueError("no dictionary of cities: streets are looked up beside cities")
    replaced = set().union(*(DICTIONARIES[k] for k in dictionaries))
    every = recognizers(g)
    wanted = {r.name for r in every if enabled is None or r.name in enabled}
    priority = {r.name: k for k, r in enumerate(every)}
    none = F.array().cast(f"array<{ENTITY}>")
    marks = [k for k in ("birthplace", "nationality", "marital") if k in dictionaries and k in wanted]
    base = docs.select("doc_id", candidates_of(text, gazetteers, wanted - replaced).alias("c"), *[D.announcements(F.col(text), k).alias(k) for k in marks], *([D.address_marks(F.col(text)).alias("address_marks")] if "city" in dictionaries and "address" in wanted else []))
    used = {k: df for k, df in dictionaries.items() if DICTIONARIES[k] & wanted}
    if not used:
        return base, resolved(F.col("c"), none)
    phrases = used | ({"form": docs.sparkSession.createDataFrame([(x,) for x in g.company_suffixes], "phrase string")} if "company" in used else {})
    found = D.by_document(D.hits(docs, D.entries(phrases), text))
    rows = base.join(found.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    h = F.coalesce("hits", F.array().cast(f"array<{D.HIT}>"))
    parts = [F.col("c")]
    if "company" in used:
        parts.append(D.listed(h, "company", "form", priority["company_list"], "Company", "company_list"))
    if "surname" in used:
        parts.append(D.names(h, g.excluded, priority["name"]))
    if "city" in used:
        parts.append(D.addresses(h, F.col("address_marks"), g.zip_codes, priority["address"]))
    for k, label, attr in (("birthplace", "Birthplace", "place"), ("nationality", "Nationality", "nationality"), ("marital", "MaritalStatus", "status")):
        if k in marks:
            parts.append(D.announced(h, F.col(k), k, priority[k], label, k, attr))
    return rows, resolved(F.concat(*[p.cast(f"array<{ENTITY}>") for p in parts]), none)


def extract(
    docs: DataFrame, gazetteers: Gazetteers | None = None, enabled: set[str] | None = None, text: str = "text", emit_urls: bool = True, dictionaries: dict[str, DataFrame] | None = None
) -> DataFrame:
    """doc_id, ent_id, label, recognizer, start, len, value, attrs.

    dictionaries: tables of phrases (first column) by kind, of any size, instead
    of the built-in lists of company, firstname and surname, birthplace,
    nationality, marital; and cities and streets of addresses (city, street).
    """
    if dictionaries:
        found, entities = _with_dictionaries(docs, dictionaries, gazetteers, enabled, text)
    else:
        found, entities = docs, entities_of(text, gazetteers, enabled)
    # The expression itself is exploded: for a column, Spark adds a filter on its size, which would bring all patterns a second time.
    rows = found.select("doc_id", F.posexplode(entities).alias("ent_id", "e"))
    out = rows.select("doc_id", "ent_id", "e.label", "e.recognizer", "e.start", "e.len", "e.value", F.map_from_entries("e.attrs").alias("attrs"))
    return out if emit_urls else out.where("label <> 'Url'")


def scored(docs: DataFrame, gazetteers: Gazetteers | None = None, enabled: set[str] | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_entities, n_categories, score of documents with entities: within the row, without a shuffle."""

    def figures(e: Column) -> Column:
        labels = F.size(F.array_distinct(F.transform(e, lambda x: x["label"])))
        return F.struct(F.size(e).alias("n_entities"), labels.alias("n_categories"), metrics.relevance_of(e).alias("score"))

    # Exploded, so that the filter on the figures does not bring the patterns with it a second time.
    rows = docs.select("doc_id", F.explode(F.transform(F.array(entities_of(text, gazetteers, enabled)), figures)).alias("f"))
    return rows.select("doc_id", "f.*").where("n_entities > 0")


def _ordered(text: Column, entities: Column) -> Column:
    """The entities, each with its order number: how many gaps lie before it.  One sort of gaps and entities by place, and a running count."""

    def counted(e: Column) -> Column:
        gaps = F.transform(T.spans(text, r"\s+"), lambda g: F.struct(g["start"].alias("at"), F.lit(1).alias("gap"), F.lit(-1).alias("i")))
        own = F.transform(e, lambda x, i: F.struct(x["start"].alias("at"), F.lit(0).alias("gap"), i.alias("i")))

        def numbered(marks: Column) -> Column:
            before = T.scanned(F.transform(marks, lambda m: m["gap"]), F.lit(0), lambda x, y: x + y)
            both = F.zip_with(marks, before, lambda m, n: F.struct(m["i"].alias("i"), n.alias("n")))
            return F.transform(F.filter(both, lambda x: x["i"] >= 0), lambda x: F.struct(F.get(e, x["i"]).alias("e"), x["n"].alias("order_num")))

        return F.when(F.size(e) > 0, T.let(F.array_sort(F.concat(gaps, own)), numbered))

    return T.let(entities, counted)


def united_entities(docs: DataFrame, gazetteers: Gazetteers | None = None, text: str = "text") -> DataFrame:
    """Names with the entities that follow them: doc_id, ue_id, start, len, n_members, members."""
    rows = docs.select("doc_id", F.explode(_ordered(F.col(text), entities_of(text, gazetteers, None))).alias("o"))
    rows = rows.select("doc_id", "o.e.start", "o.e.len", "o.e.label", "o.e.value", "o.order_num")
    return grouping.united(rows, ["doc_id"], F.col("label") == "Name")


def combined(docs: DataFrame, model_entities: DataFrame, gazetteers: Gazetteers | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Rule entities (rules, if they are there already) merged with a model's (doc_id, start, len, label), in order of start.

    A model's entities may be made from the rules', so these are kept on disk: the patterns run once.
    """
    if rules is None:
        rules = extract(docs, gazetteers).select("doc_id", "start", "len", "label").persist(StorageLevel.DISK_ONLY)
    merged = overlap_merge(rules, model_entities)
    return merged.withColumn("ent_id", F.row_number().over(W.partitionBy("doc_id").orderBy("start", "len")) - 1)
