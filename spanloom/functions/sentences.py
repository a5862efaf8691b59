"""Full sentence splitting as one Catalyst expression, in time linear in the text.

A text is cut into words by white space.  Whether a sentence ends at a word is
decided by the word, its neighbours and what is open at that place: brackets and
quotes are counted by running folds that start anew at each end: first at those
that do not depend on the count, then at all.  The rules, in order:

1. A line feed ends a sentence, and so does the text.
2. `!`, `?` and `…` end one unless a bracket or quote is open there; `…` does not
   before a small letter.
3. A dot that ends a word (closing quotes and brackets after it do not count):
   not after an abbreviation that stands before a name or number, nor after other
   abbreviations unless a capital follows; three dots only before a capital; not
   after a single capital, unless it is a Roman number or the next word has
   another alphabet; not after one or two digits, after `Str.` or before
   a small letter, a comma, colon or semicolon, or a quote with a dash; not after
   a number that is a sentence's first word, which begins a list.

Smileys open and close nothing.  Dots within a word (numbers, addresses, file
names) end nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import text as T

SENTENCES = "array<struct<start:int,len:int,value:string>>"
# Abbreviations before a name or a number, and others.
BEFORE_NAMES = ["Dr", "Prof", "Dipl", "Ing", "Hr", "Fr", "Hrn", "Nr", "No", "Tel", "St", "Str", "Mr", "Mrs", "Ms", "Abs", "Art", "Bd", "Abb", "Kap", "Jan", "Feb", "Aug", "Sept", "Okt", "Nov", "Dez"]
OTHERS = ["bzw", "ca", "evtl", "ggf", "inkl", "max", "min", "usw", "vgl", "etc", "vs", "Jr", "Sr", "Co", "Inc", "Ltd", "z", "u", "d", "h", "s", "o", "i", "a", "B"]
OPEN, CLOSED = "(‹{\\[«„“‚", ")›}\\]»”’"
SMILEY = r"[:;=8][-o*']?[)(\]\[DPp/]"
CLOSERS = r"[\"”»’)\]}›“‘']+$"
#: Words without any of these neither end a sentence nor open or close anything.
SPECIAL = rf"[.!?…\"{OPEN}{CLOSED}]"


def _count(value: Column, of: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, f"[{of}]", ""))


def _dot_ends(w: Column, i: Column) -> Column:
    """Whether the dot that ends word i, if one does, ends a sentence; whether it begins a list is decided later."""
    core = F.regexp_replace(F.get(w, i)["value"], CLOSERS, "")
    nxt = F.coalesce(F.get(w, i + 1)["value"], F.lit(""))
    bare = F.regexp_replace(core, r"^[\"„«“‚‘'(\[{‹]+|\.+$", "")
    opening = F.regexp_replace(nxt, r"^[\"„«“‚‘'(\[{‹]+", "")
    upper, lower = opening.rlike(r"^\p{Lu}"), opening.rlike(r"^\p{Ll}")
    cyrillic = r"\p{IsCyrillic}"
    other_script = upper & (bare.rlike(cyrillic) != F.substring(opening, 1, 1).rlike(cyrillic))
    return (
        F.when(~core.endswith("."), False)
        .when(nxt.rlike(r"^[,;:]|^[\"”“»][-–—]"), False)
        .when(core.rlike(r"\.\.\.$"), upper)
        .when(bare.isin(BEFORE_NAMES) & (upper | lower | opening.rlike(r"^\p{Nd}")), False)
        .when(bare.isin(OTHERS) & (F.length(bare) > 1), upper)
        .when(bare.rlike(r"^\p{Lu}$"), other_script | (bare.isin("I", "V", "X") & upper))
        .when(bare.rlike(r"^\p{Ll}$|^\p{Nd}{1,2}$|(?i)str$") & (nxt != ""), False)
        .otherwise(~lower)
    )


def split_full(text: Column) -> Column:
    """start, len and value of each sentence."""
    text = F.coalesce(text, F.lit(""))
    zipped = F.arrays_zip(F.split(text, r"\S+").alias("gap"), T.matches(text, r"\S+").alias("value"))
    words = F.filter(zipped, lambda p: p["value"].isNotNull())

    def flagged(w: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            core, plain = F.regexp_replace(x["value"], CLOSERS, ""), F.regexp_replace(x["value"], SMILEY, "")
            after = F.coalesce(F.get(w, i + 1)["gap"], F.lit("\n"))
            broken = after.contains("\n") | after.contains("\r")
            opened = F.regexp_replace(core, SMILEY, "")
            common = F.struct(
                x["gap"].alias("gap"), x["value"].alias("value"), broken.alias("broken"), F.lit(False).alias("dot"), F.lit(False).alias("mark"),
                *[F.lit(0).alias(c) for c in ("delta", "odd", "own", "own_odd")],
            )
            special = F.struct(
                x["gap"].alias("gap"), x["value"].alias("value"), broken.alias("broken"), F.when(x["value"].contains("."), _dot_ends(w, i)).otherwise(False).alias("dot"),
                (core.rlike("[!?]$") | (core.rlike("…$") & ~F.coalesce(F.get(w, i + 1)["value"], F.lit("")).rlike(r"^\p{Ll}"))).alias("mark"),
                (_count(plain, OPEN) - _count(plain, CLOSED)).alias("delta"), F.pmod(_count(plain, '"'), F.lit(2)).alias("odd"),
                (_count(opened, OPEN) - _count(opened, CLOSED)).alias("own"), F.pmod(_count(opened, '"'), F.lit(2)).alias("own_odd"),
            )
            return F.when(x["value"].rlike(SPECIAL), special).otherwise(common)

        return F.transform(w, one)

    def listed(w: Column) -> Column:
        """Ends by dots and line feeds, without dots of numbers that begin a sentence."""

        def one(x: Column, i: Column) -> Column:
            before = F.get(w, i - 1)
            first = before.isNull() | before["broken"] | before["dot"]
            ends = x["broken"] | F.when(x["dot"], ~(first & x["value"].rlike(r"^\p{Nd}+\.$"))).otherwise(False)
            return F.struct(*[x[c].alias(c) for c in ("gap", "value", "mark", "delta", "odd", "own", "own_odd")], ends.alias("ends"))

        return F.transform(w, one)

    def counted(w: Column) -> Column:
        state = lambda delta, odd, anew: F.struct(delta.alias("delta"), odd.alias("odd"), anew.alias("anew"))
        steps = F.transform(w, lambda x, i: state(x["delta"], x["odd"], F.coalesce(F.get(w, i - 1)["ends"], F.lit(True))))

        def add(a: Column, b: Column) -> Column:
            return state(F.when(b["anew"], b["delta"]).otherwise(a["delta"] + b["delta"]), F.when(b["anew"], b["odd"]).otherwise(F.pmod(a["odd"] + b["odd"], F.lit(2))), a["anew"] | b["anew"])

        before = T.scanned(steps, state(F.lit(0), F.lit(0), F.lit(False)), add, block=32)

        def marked(open_: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                anew = F.coalesce(F.get(w, i - 1)["ends"], F.lit(True))
                inside = F.when(anew, (x["own"] > 0) | (x["own_odd"] == 1)).otherwise((F.get(open_, i)["delta"] + x["own"] > 0) | (F.pmod(F.get(open_, i)["odd"] + x["own_odd"], F.lit(2)) == 1))
                return ended(x, x["ends"] | F.when(x["mark"], ~inside).otherwise(False))

            return F.transform(w, one)

        return T.let(before, marked)

    def ended(x: Column, ends: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("gap", "value", "mark", "delta", "odd", "own", "own_odd")], ends.alias("ends"))

    def with_marks(w: Column) -> Column:
        """Ends by marks too.  The second count starts anew also at the ends that the first one found; texts without brackets and quotes need none."""
        opens = F.exists(w, lambda x: (x["delta"] != 0) | (x["odd"] != 0) | (x["own"] != 0) | (x["own_odd"] != 0))
        return F.when(opens, T.let(counted(w), counted)).otherwise(F.transform(w, lambda x: ended(x, x["ends"] | x["mark"])))

    def sentences(w: Column) -> Column:
        firsts = F.filter(F.transform(w, lambda x, i: F.when(F.coalesce(F.get(w, i - 1)["ends"], F.lit(True)), i)), lambda i: i.isNotNull())

        def each(f: Column) -> Column:
            def one(a: Column, k: Column) -> Column:
                part = F.slice(w, a + 1, F.coalesce(F.get(f, k + 1), F.size(w)) - a)
                value = F.array_join(F.transform(part, lambda x, i: F.when(i == 0, x["value"]).otherwise(F.concat(x["gap"], x["value"]))), "")
                return F.struct(F.length(F.get(w, a)["gap"]).alias("gap"), value.alias("value"))

            return F.transform(f, one)

        def placed(s: Column) -> Column:
            before = T.scanned(F.transform(s, lambda x: x["gap"] + F.length(x["value"])), F.lit(0), lambda a, b: a + b)
            return F.zip_with(s, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.length(x["value"]).alias("len"), x["value"].alias("value")))

        return T.let(T.let(firsts, each), placed)

    out = T.let(T.let(T.let(T.let(words, flagged), listed), with_marks), sentences)
    return F.when(F.size(words) > 0, out).otherwise(F.array()).cast(SENTENCES)


def sentences_full(text: Column) -> Column:
    """The sentences' texts."""
    return F.transform(split_full(text), lambda s: s["value"])
