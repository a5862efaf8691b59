"""Joins of token tables with dictionaries and with each other.

Token tables have doc_id, sent_id, tok_id, value (and start, len).  Nothing
here pairs all tokens of a sentence: phrases meet k-gram keys by equality, and
neighbours meet by equal places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import text as T

SENT = ["doc_id", "sent_id"]


def token_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, sent_id, tok_id, start, len, value of every token."""
    sents = docs.select("doc_id", F.posexplode(T.sentences(F.col(text))).alias("sent_id", "sentence"))
    toks = sents.select("doc_id", "sent_id", F.posexplode(T.tokens(F.col("sentence"))).alias("tok_id", "t"))
    return toks.select("doc_id", "sent_id", "tok_id", "t.start", "t.len", "t.value")


def k_grams(tokens: DataFrame, most: int, key: Column | None = None, to_left: bool = False) -> DataFrame:
    """tokens with n_tok and key for each run of 1 to most tokens that begins (to_left: ends) at the token."""
    word = F.col("value") if key is None else key
    order = W.partitionBy(*SENT).orderBy("tok_id")
    near = [F.col("_w0"), *[F.col(f"_w{k}") for k in range(1, most)]]
    placed = tokens.withColumn("_w0", word)
    placed = placed.withColumns({f"_w{k}": (F.lag if to_left else F.lead)("_w0", k).over(order) for k in range(1, most)})
    runs = [F.struct(F.lit(n).alias("n_tok"), F.concat_ws(" ", *(reversed(near[:n]) if to_left else near[:n])).alias("key"), near[n - 1].isNotNull().alias("whole")) for n in range(1, most + 1)]
    out = placed.withColumn("_run", F.explode(F.array(*runs))).where("_run.whole")
    return out.select(*tokens.columns, "_run.n_tok", "_run.key")


def phrase_matches(tokens: DataFrame, phrases: DataFrame, most: int, to_left: bool = False) -> DataFrame:
    """The longest dictionary phrase from each token (to_left: up to it); phrases has key (canonical) and what it stands for."""
    grams = k_grams(tokens, most, T.folded_upper(F.col("value")), to_left)
    hits = grams.join(phrases, "key")
    best = F.row_number().over(W.partitionBy(*SENT, "tok_id").orderBy(F.desc("n_tok"), "key"))
    return hits.withColumn("_best", best).where("_best = 1").drop("_best")


def with_fallback(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """tokens in a word list by upper case, or else by folded umlauts; words has word (upper)."""
    exact = words.select(F.col("word").alias("_exact")).distinct()
    folded = words.select(T.fold_umlauts(F.col("word")).alias("_folded")).distinct()
    t = tokens.withColumn("_upper", T.upper(F.col("value"))).withColumn("_norm", T.folded_upper(F.col("value")))
    t = t.join(exact, F.col("_upper") == F.col("_exact"), "left").join(folded, F.col("_norm") == F.col("_folded"), "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_folded").isNotNull(), "folded")
    return t.withColumn("matched_by", how).where("matched_by is not null").drop("_upper", "_norm", "_exact", "_folded")


def longest_prefix(values: DataFrame, column: str, prefixes: DataFrame, lengths: list[int]) -> DataFrame:
    """values with the longest entry of prefixes (prefix and what it stands for) that column begins with.

    One equal join on the cut-off keys of each length that the dictionary has.
    """
    cut = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.substring(column, 1, n).alias("prefix")) for n in lengths]), lambda c: F.length(c["prefix"]) == c["n"])
    keyed = values.withColumn("_row", F.monotonically_increasing_id()).withColumn("_cut", F.explode(cut))
    hits = keyed.select("*", F.col("_cut.prefix").alias("prefix"), F.col("_cut.n").alias("prefix_len")).join(prefixes, "prefix")
    best = F.row_number().over(W.partitionBy("_row").orderBy(F.desc("prefix_len")))
    return hits.withColumn("_best", best).where("_best = 1").drop("_best", "_row", "_cut")


def class_string(tokens: DataFrame, code: Column) -> DataFrame:
    """One string a sentence, one letter a token: sequences of token classes become patterns on it."""
    letters = F.array_sort(F.collect_list(F.struct("tok_id", code.alias("c"))))
    return tokens.groupBy(*SENT).agg(F.array_join(F.transform(letters, lambda x: x["c"]), "").alias("classes"))


def class_matches(classes: DataFrame, pattern: str) -> DataFrame:
    """first_tok and n_tok of each match of a pattern of classes."""
    return classes.select(*SENT, F.explode(T.spans(F.col("classes"), pattern)).alias("m")).select(
        *SENT, F.col("m.start").alias("first_tok"), F.col("m.len").alias("n_tok"), F.col("m.value").alias("classes")
    )


def first_within(preambles: DataFrame, values: DataFrame, distance: int = 3) -> DataFrame:
    """For each preamble (end_tok: the token after it) the nearest value that begins at most distance tokens later.

    Each preamble asks for distance + 1 places, so the join is on equal places.
    """
    asked = preambles.withColumn("tok_id", F.explode(F.sequence(F.col("end_tok"), F.col("end_tok") + distance)))
    hits = asked.join(values, [*SENT, "tok_id"])
    best = F.row_number().over(W.partitionBy(*SENT, "end_tok").orderBy("tok_id"))
    return hits.withColumn("_best", best).where("_best = 1").drop("_best")


def right_neighbours(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs in which the right one begins at the token where the left one ends."""
    return left.join(right.withColumnRenamed("first_tok", "end_tok"), [*SENT, "end_tok"])


def overlap_merge(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Rule and model entities of each document (doc_id, start, len, label) as one list.

    A model entity that touches no rule entity is added; it replaces the
    leftmost one it touches if it starts no later and is strictly longer;
    otherwise it is dropped.  Touching ends count as an overlap.

    Both lists are shuffled once, by document, and sorted there: no join, so no
    side is ever broadcast by an estimate (a table of keys says little of how
    many entities its texts hold).  In order of start, the leftmost rule entity
    that ends at or behind a place is the first that does, so only those that end
    behind all before them are asked for.
    """
    fields = ["start", "len", "label"]
    own = F.struct(*fields)
    rows = rules.select("doc_id", *fields, F.lit(True).alias("_rule")).unionByName(model.select("doc_id", *fields, F.lit(False).alias("_rule")))
    end = F.col("start") + F.col("len")
    before = W.partitionBy("doc_id").orderBy(*fields).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_reach", F.max(F.when(F.col("_rule"), end)).over(before))
    record = F.col("_rule") & (F.col("_reach").isNull() | (end > F.col("_reach")))
    rows = rows.withColumn("_place", F.when(record, end).when(~F.col("_rule"), F.col("start")))
    # From the last place to the first, a rule entity before the model's that begin where it ends.
    places = W.partitionBy("doc_id").orderBy(F.desc("_place"), F.desc("_rule")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_left", F.last(F.when(record & F.col("_place").isNotNull(), own), ignorenulls=True).over(places))
    met = F.coalesce(F.col("doc_id").isNotNull() & (F.col("_left.start") <= end) & F.col("start").isNotNull(), F.lit(False))
    rows = rows.withColumn("_met", ~F.col("_rule") & met)
    rows = rows.withColumn("_wins", F.col("_met") & F.coalesce((F.col("start") <= F.col("_left.start")) & (F.col("len") > F.col("_left.len")), F.lit(False)))
    about = F.when(F.col("_rule"), own).when(F.col("_wins"), F.col("_left"))
    same = W.partitionBy("doc_id", about).orderBy("_rule", *fields)
    beaten = F.col("_rule") & F.max("_wins").over(same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    again = F.col("_wins") & F.coalesce(F.lag(own).over(same).eqNullSafe(own) & ~F.lag("_rule").over(same), F.lit(False))
    rows = rows.withColumns({"_beaten": beaten, "_again": again})
    kept = rows.where(~F.col("_beaten") & ~F.col("_again") & (F.col("_rule") | F.col("_wins") | ~F.col("_met")))
    return kept.select("doc_id", *fields, F.when(F.col("_rule"), "rules").otherwise("model").alias("origin"))


def with_url_tokens(tokens: DataFrame, urls: DataFrame) -> DataFrame:
    """Tokens that lie in an address span give way to one token for it; places are numbered anew by start."""
    u = urls.select("doc_id", F.col("start").alias("_s"), (F.col("start") + F.col("len")).alias("_e"))
    inside = tokens.join(u, "doc_id").where((F.col("start") < F.col("_e")) & (F.col("start") + F.col("len") > F.col("_s"))).select("doc_id", "start", "len").distinct()
    rest = tokens.select("doc_id", "start", "len", "value", F.lit(False).alias("is_url")).join(inside, ["doc_id", "start", "len"], "left_anti")
    all_ = rest.unionByName(urls.select("doc_id", "start", "len", "value", F.lit(True).alias("is_url")))
    return all_.withColumn("tok_id", F.row_number().over(W.partitionBy("doc_id").orderBy("start", "len")) - 1)
