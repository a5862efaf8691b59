"""Text functions as Catalyst expressions: case, umlauts, shapes, tokens, spans of patterns.

Offsets are code points, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,len:int,value:string>>"
# Hyphens, quotes and other marks with a part in tokens.
HYPHENS = "-—–"
QUOTES = "\"'«»“”„‘’‚‹›"
JOINERS = "&\\-_­‒-―‘‛"
SEPARATORS = "/()\\[\\]{};!?<>€%$°&\\-_­‒-―‘‛\",:〃+*=|~@#§"
NUMBER = "[%NUM%]"
#: Stands beside matches while their places are found: no character, so texts hardly hold it.
MARK = "\uffff"

_BODY = rf"(?:[\p{{L}}\p{{Nd}}.]|(?<=[\p{{L}}\p{{Nd}}])[{JOINERS}](?=[\p{{L}}\p{{Nd}}])|(?<=\p{{Nd}})[\",:〃](?=\p{{Nd}}))"
#: A word with its inner marks (a dot before a capital closes it), or a run of one separator.
#: A run of letters and digits is taken at once, without a way back: nothing behind it asks for less.
TOKEN = rf"{_BODY}(?:(?<!\.)[\p{{L}}\p{{Nd}}]++|(?!(?<=\.)\p{{Lu}}){_BODY})*+|([{SEPARATORS}])\1*"


def upper(text: Column) -> Column:
    """Upper case of the same length: ß stays."""
    return F.translate(F.upper(F.translate(text, "ß", "\u0001")), "\u0001", "ß")


def fold_umlauts(text: Column) -> Column:
    """ä, ö, ü and ß as two letters each."""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def folded_upper(text: Column) -> Column:
    return F.upper(fold_umlauts(text))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(values: Column, zero: Column, add, block: int = 128) -> Column:
    """For each element, add over all elements before it, from zero (add: associative, as a sum or a maximum).

    An array that grows inside a fold is copied at every step, so the fold runs
    within blocks, then over the blocks: a long text takes time in proportion.
    """

    def before(items: Column, value) -> Column:
        start = F.struct(zero.alias("at"), F.filter(F.array(zero), lambda _: F.lit(False)).alias("out"))
        return F.aggregate(items, start, lambda acc, i: F.struct(add(acc["at"], value(i)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def run(v: Column) -> Column:
        last = F.size(v) - 1
        blocks = F.sequence(F.lit(0), F.floor(last / block).cast("int"))
        parts = F.transform(blocks, lambda b: before(F.sequence(b * block, F.least(b * block + (block - 1), last)), lambda i: F.get(v, i)))

        def joined(p: Column) -> Column:
            return F.flatten(F.zip_with(p, before(p, lambda x: x["at"])["out"], lambda x, base: F.transform(x["out"], lambda y: add(base, y))))

        return F.when(last >= 0, let(parts, joined)).otherwise(F.filter(F.array(zero), lambda _: F.lit(False)))

    return let(values, run)


def spans(text: Column, pattern: str) -> Column:
    """start, len and value of each match.  Starts add up from the gaps between matches.

    Gaps and values come from one search that marks the matches, whose compiled
    pattern Spark keeps from row to row; `split` compiles its pattern for each
    row, so it only serves texts that hold the mark.  Texts without a match cost
    one search; the array functions see only others.
    """
    none = F.array().cast(SPAN)
    measured = lambda gap, value: F.struct(F.length(gap).alias("gap"), F.length(value).alias("len"), value.alias("value"))
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    marked = let(parts, lambda p: F.transform(F.sequence(F.lit(1), F.floor(F.size(p) / 2).cast("int")), lambda i: measured(F.get(p, 2 * i - 2), F.get(p, 2 * i - 1))))
    zipped = F.arrays_zip(F.split(text, pattern).alias("gap"), matches(text, pattern).alias("value"))
    zipped = F.transform(F.filter(zipped, lambda p: p["value"].isNotNull()), lambda p: measured(p["gap"], p["value"]))

    def placed(found: Column) -> Column:
        before = scanned(F.transform(found, lambda p: p["gap"] + p["len"]), F.lit(0), lambda x, y: x + y)
        return F.zip_with(found, before, lambda p, at: F.struct((at + p["gap"]).alias("start"), p["len"].alias("len"), p["value"].alias("value")))

    return F.when(text.rlike(pattern), let(F.when(text.contains(MARK), zipped).otherwise(marked), placed)).otherwise(none)


def tokens(text: Column) -> Column:
    """Tokens with their places."""
    return spans(text, TOKEN)


def sentences(text: Column) -> Column:
    """Simple splitting: a sentence ends at a dot before a line's end (not after a street's abbreviation), or at ? or … before space."""
    return F.filter(F.transform(F.split(text, r"(?<=\.)(?<!(?i:str)\.)[ \t]*\r?\n\s*|(?<=[?…])\s+(?=[\p{Lu}\p{Nd}\"„«(])"), F.trim), lambda s: s != "")


def _n(value: Column, pattern: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, pattern, ""))


def shape(value: Column) -> Column:
    """Shape class of a token."""
    n, first = F.length(value), F.substring(value, 1, 1)
    digits, uppers, lowers = _n(value, r"\p{Nd}"), _n(value, r"\p{Lu}"), _n(value, r"\p{Ll}")
    dots, hyphens, roman = _n(value, r"\."), _n(value, f"[{HYPHENS}]"), _n(value, "[IVXLCDM]")
    first_upper, first_lower = first.rlike(r"^\p{Lu}"), first.rlike(r"^\p{Ll}")
    some, plain = uppers > 0, dots == 0
    return (
        F.when(plain & (digits > 0) & (n > 1) & (first_upper | ((uppers > 0) & value.rlike(r"^.[^\p{Lu}\p{Ll}]*\p{Lu}"))), "NumCapital")
        .when((uppers > 1) & plain & ((roman == n) | (roman + hyphens == n)), "LatinCapital")
        .when((uppers > 1) & plain & ((uppers == n) | (uppers + hyphens == n)), "AllCapital")
        .when((uppers > 1) & ~plain & (uppers + dots == n), "AllCapitalWithDot")
        .when((uppers > 1) & ~plain & (uppers + dots + hyphens == n), "MixCapitalWithDot")
        .when(some & plain & ((roman == n) | (roman + hyphens == n)), "LatinCapital")
        .when((uppers == 1) & (n == 1), "OneCapital")
        .when(some & (dots == 1) & (((n == 2) & first_upper) | ((n == 3) & value.rlike(rf"^[{HYPHENS}]\p{{Lu}}"))), "OneCapitalWithDot")
        .when(some & first_upper & (uppers == 1) & (lowers + 1 == n), "LatinFirstCapital")
        .when(some & first_upper, "MixCapital")
        .when(some & first_lower & (digits == 0) & plain, "FirstLowerWithUpper")
        .when(first.rlike(f"^[{QUOTES}]"), "Quote")
        .when((lowers == 0) & (uppers == 0) & (digits > 0), "Num")
        .otherwise("Other")
    )


def unstick(value: Column) -> Column:
    """Runs of digits and runs of other characters."""
    return matches(value, r"[0-9]+|[^0-9]+")


def trim_punctuation(value: Column) -> Column:
    """Without punctuation at the end; two characters stay at least."""
    return F.concat(F.substring(value, 1, 2), F.regexp_replace(F.substring(value, 3, 1 << 30), r"[\p{P}]+$", ""))


def number_placeholders(words: Column) -> Column:
    """Tokens with digits and no letters become one placeholder, neighbours together."""
    one = F.transform(words, lambda w: F.when(w.rlike("[0-9]") & ~w.rlike("[A-Za-z]"), F.lit(NUMBER)).otherwise(w))
    return F.filter(one, lambda w, i: ~((w == NUMBER) & (i > 0) & (F.coalesce(F.element_at(one, F.greatest(i, F.lit(1))), F.lit("")) == NUMBER)))


def _one_run(words: Column) -> Column:
    """Neighbouring number placeholders as one, which reaches from the first one's start to the last one's end."""

    def joined(w: Column) -> Column:
        # Seen from the end: the nearest word behind each that is no number.
        others = F.reverse(F.transform(w, lambda x, i: F.when(x["value"] == NUMBER, F.lit(-1)).otherwise(i.cast("int"))))
        behind = F.reverse(scanned(others, F.lit(-1), lambda x, y: F.when(y < 0, x).otherwise(y)))

        def run(b: Column) -> Column:
            def each(x: Column, i: Column) -> Column:
                stop = F.get(w, F.when(F.get(b, i) < 0, F.size(w)).otherwise(F.get(b, i)) - 1)
                size = F.when(x["value"] == NUMBER, stop["start"] + stop["len"] - x["start"]).otherwise(x["len"])
                first = (x["value"] != NUMBER) | (i == 0) | (F.get(w, F.greatest(i - 1, F.lit(0)))["value"] != NUMBER)
                return F.when(first, F.struct(x["start"].alias("start"), size.alias("len"), x["value"].alias("value")))

            return F.filter(F.transform(w, each), lambda x: x.isNotNull())

        return let(behind, run)

    return let(words, joined)


def model_pattern(urls: str) -> str:
    """Addresses, tokens and single marks."""
    return rf"(?:{EMAIL})|(?:{urls})|{TOKEN}|''|[\p{{P}}\p{{S}}]"


def model_words(text: Column, urls: str) -> Column:
    """Words as a model reads them, each with its place in the text as it stands: start, len, value.

    Addresses (urls: their pattern; e-mails) are words of their own and stay as
    they are, other marks words of one character; single hyphens and quotes of all kinds become - and ", doubled
    marks one mark, and numbers that follow each other one placeholder.  A place
    covers what its value stands for, so values of another length move no place.
    """
    address = rf"(?:{EMAIL})|(?:{urls})"

    def value(v: Column) -> Column:
        return (
            F.when(v.rlike(rf"^(?:{address})$"), v)
            .when(v.rlike(r"\p{Nd}") & ~v.rlike(r"\p{L}"), F.lit(NUMBER))
            .when(v.rlike("^[-—–‐‑‒―]{1,2}$"), F.lit("-"))
            .when(v.rlike("^(?:''|[«»“”„‘’‚‹›‛])$"), F.lit('"'))
            .when(v == ",,", F.lit(","))
            .otherwise(v)
        )

    found = F.transform(spans(text, model_pattern(urls)), lambda w: F.struct(w["start"].alias("start"), w["len"].alias("len"), value(w["value"]).alias("value")))
    return _one_run(found)


def phrase_key(text: Column) -> Column:
    """Canonical form of a phrase: folded, upper, without . & " ' !, dashes and slashes as spaces, single spaces."""
    key = F.regexp_replace(folded_upper(text), "[.&\"'!]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(key, "[-–—/]", " "), " +", " "))


def bracket_balance(text: Column) -> Column:
    """Whether round, square and curly brackets close in order: pairs without brackets between them are taken out until none is left."""
    only = F.regexp_replace(text, r"[^()\[\]{}]", "")
    folded = F.aggregate(
        F.split(only, ""),
        F.lit(""),
        lambda open_, c: F.when(c.isin("(", "[", "{", ""), F.concat(open_, c))
        .when(F.concat(F.right(open_, F.lit(1)), c).isin("()", "[]", "{}"), F.substring(open_, F.lit(1), F.length(open_) - 1))
        .otherwise(F.concat(open_, c)),
    )
    return folded == ""


def url_pattern(tlds: list[str], schemes: list[str]) -> str:
    """Addresses that begin with a scheme or www., or are a name with a known top-level domain; the end has no punctuation but /."""
    tld = "|".join(sorted(tlds, key=len, reverse=True))
    body = r"[^\s<>\"”»]*[^\s<>\"”»\p{P}]/?|[^\s<>\"”»]*/"
    return rf"(?=[\p{{L}}\p{{Nd}}])\b(?:(?:{'|'.join(schemes)}):(?://)?(?:{body})|www\.(?:{body})|(?:[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}}-]*+\.)+(?:{tld})\b(?:[/?#](?:{body})?)?)"


EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*+(?:@|\(at\)|\[at\])(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"


def is_email(url: Column) -> Column:
    """Whether an address is an e-mail's; with a scheme, only without a slash after it."""
    at = url.rlike(r"@|\(at\)|\[at\]")
    return at & ~(url.rlike("^[A-Za-z]+:") & url.rlike("^[A-Za-z]+:.*/"))
