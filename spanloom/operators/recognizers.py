"""Recognisers: patterns, a check, and attributes for each label, as expressions on the text column.

All recognisers of a document are arrays in one projection; candidates are
never exploded before they are resolved.  Order is priority: what stands first
claims its place.  Values keep the text's own spelling; attrs holds the
canonical parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import checks as C
from spanloom.functions import text as T
from spanloom.sources.gazetteers import Gazetteers

ATTRS = "array<struct<key:string,value:string>>"  # pairs, for maps have no order
_L, _R = r"(?<![\p{L}\p{Nd}_])", r"(?![\p{L}\p{Nd}_])"
_NAME = r"\p{Lu}[\p{L}]+(?:-\p{Lu}[\p{L}]+)?"
_DATE = r"\d{1,2}[./-]\s?\d{1,2}[./-]\s?(?:\d{4}|\d{2})(?!\d)|\d{1,2}\.?\s?(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|January|February|March|May|June|July|October|December)\s\d{4}|\d{4}-\d{2}-\d{2}"
# Words that announce a value, by label.
PREAMBLES = {
    "phone": r"(?:Telefonnummer|Telefon|Tel|Telefax|Faxnummer|Fax|Handynummer|Handynr|Handy|Mobiltelefon|Mobilnummer|Mobil|Mobile No|Mobile|Phone No|Phone|Rufnummer)",
    "iban": r"IBAN",
    "bank_code": r"(?:BLZ|Bankleitzahl|Bank code)",
    "owner": r"(?:Kontoinhaber|Account owner|Account holder)",
    "bank": r"(?:Geldinstitut|Kreditinstitut|Bank name|Bank)",
    "account": r"(?:Kontonummer|Konto-Nr|Kto\.?-?Nr|Kto|Konto|Account No|Account number)",
    "customer": r"(?:Kundennummer|Kunden-Nr|Kundennr|Vertragsnummer|Vertrags-Nr|Vertragsnr|Aktenzeichen|Rechnungsnummer|Mitgliedsnummer|Customer number|Contract number|File number)",
    "birthday": r"(?:Geburtsdatum|Geburtstag|[Gg]eboren am|[Gg]eb\.? am|Geb\.?|Date of birth|DOB|born on)",
    "birthplace": r"(?:Geburtsort|[Gg]eboren in|Place of birth|P\.O\.B\.?|born in)",
    "nationality": r"(?:Staatsangehörigkeit|Staatsbürgerschaft|Nationalität|Nationality|Citizenship)",
    "marital": r"(?:Familienstand|Personenstand|Beziehungsstatus|Beziehungsstand|Beziehungsverh(?:ä|ae)ltnis|Marital status|Civil status|Relationship status)",
    "tax": r"(?:Steueridentifikationsnummer|Steueridentifikationsnr|Steuer-IdNr|Steuer-ID|Steuer-Id|IdNr|Tax-ID|Tax ID|Tax number|Steuernummer|St\.?-?\s?Nr)",
    "title": r"(?:Herrn|Herr|Frau|Prof\. Dr\.|Prof\.|Dr\.|Dipl\.-Ing\.|Mrs\.|Mr\.|Ms\.|Professor|Doctor)",
}
_GAP = r"\s*[.:\-]{0,2}\s*"
# What makes a company's name reach further to the left of its legal form.
COMPANY_OPENERS = ["Deutsche", "Deutsches", "Mitteldeutsche", "Hallenbad", "Theater", "Internationale", "Kulturregion", "Tourismus", "Stadtwerke", "Kommunale", "Hotel"]
COMPANY_LINKS = ["für", "zur", "zum", "am", "an"]
COMPANY_MIDDLES = ["Deutschland", "(Deutschland)", "Holding", "Real Estate", "Asset", "Management", "Service", "Media", "Digital"]
# Questions about marital status that are answered by yes or no.
MARITAL_QUESTIONS = r"(?:Verheiratet|Ledig|Geschieden|Verwitwet|Married|Single|Divorced|Widowed)"
YES_NO = r"(?:ja|nein|yes|no)"
DETERMINERS = "der|die|das|eine|ein|zu|zum|von|vom|in|im|auf"


@dataclass
class Recognizer:
    name: str
    label: str
    pattern: str
    group: int = 0
    check: Callable[[Column], Column] | None = None
    attrs: Callable[[Column], dict[str, Column]] | None = None
    #: A pattern that a text must have before this one is tried.
    guard: str | None = None
    #: Finds the matches' places, where no one pattern does.
    find: Callable[[Column], Column] | None = None
    #: Characters a match can begin with.  Tested first, they spare most places the look-behind and the alternatives.
    lead: str | None = None

    def __post_init__(self):
        if self.lead:
            flags, bare = ("(?i)", self.pattern[4:]) if self.pattern.startswith("(?i)") else ("", self.pattern)
            self.pattern = rf"{flags}(?=[{self.lead}])(?:{bare})"


def _initials(*lists: list[str]) -> str:
    return "".join(sorted({re.escape(w[0]) for words in lists for w in words if w}))


def _or(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True)) + ")"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _plain(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, r"[^\p{L}\p{Nd}]", ""))


def _title(v: Column) -> Column:
    return (
        F.when(v.rlike("^Prof"), "Professor").when(v.rlike("^D(r|octor)"), "Doctor").when(v.rlike("^Dipl"), "Engineer")
        .when(v.rlike("^(Frau|Mrs|Ms)"), "Frau").when(v.rlike("^(Herr|Mr)"), "Herr")
    )


def city_pattern(cities: list[str]) -> str:
    """Names of cities, longest first; a dash or space in a name stands for either, with spaces around."""
    names = sorted(set(cities), key=len, reverse=True)
    return "(?:" + "|".join(r"(?:\s*-\s*|\s+)".join(map(re.escape, re.split(r"[\s-]+", n))) for n in names) + ")"


def bank_field(kind: str) -> str:
    """The pattern of one announced field of a bank account; group 1 is its value."""
    preambles = "|".join(PREAMBLES[k] for k in ("owner", "bank", "account", "bank_code", "iban"))
    word = rf"(?!(?:{preambles})(?!\p{{L}}))\p{{Lu}}[\p{{L}}.-]*"
    value = {"account": r"\d(?:[ ]?\d){3,9}(?!\d)", "bank_code": r"\d[\d ]{6,9}\d(?!\d)"}.get(kind, rf"{word}(?:[ ](?:{word}|&|der|für|und|of)){{0,4}}")
    # "Bank" alone also ends other words; a name after it needs a mark.
    gap = r"\s*:\s*" if kind == "bank" else _GAP
    return rf"(?<![\p{{L}}]){PREAMBLES[kind]}{gap}({value})"


def records(text: Column, fields: dict[str, str], reach: int = 12) -> Column:
    """Places of records of announced fields that may stand in any order.

    Fields of all kinds are taken in order of place; one joins the open record
    if that has no field of its kind yet and ends at most `reach` characters
    before, else it opens a record.  A record of one field is none.
    """

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(T.spans(text, pattern), lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["len"]).alias("stop"), F.lit(kind).alias("kind")))

    found = F.concat(*[of_kind(k, p) for k, p in fields.items()])

    def dealt(ordered: Column) -> Column:
        record = "struct<start:int,stop:int,kinds:array<string>>"
        start = F.struct(F.lit(None).cast(record).alias("open"), F.array().cast(f"array<{record}>").alias("done"))

        def step(acc: Column, f: Column) -> Column:
            o = acc["open"]
            fits = o.isNotNull() & ~F.array_contains(o["kinds"], f["kind"]) & (f["start"] >= o["stop"]) & (f["start"] - o["stop"] <= reach)
            # A place inside the open record belongs to a longer field that began before.
            inside = o.isNotNull() & (f["start"] < o["stop"])
            joined = F.struct(o["start"].alias("start"), f["stop"].alias("stop"), F.concat(o["kinds"], F.array(f["kind"])).alias("kinds"))
            fresh = F.struct(f["start"].alias("start"), f["stop"].alias("stop"), F.array(f["kind"]).alias("kinds"))
            opened = F.when(inside, o).when(fits, joined).otherwise(fresh).cast(record)
            closed = F.when(fits | inside | o.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(o)))
            return F.struct(opened.alias("open"), closed.alias("done"))

        return F.aggregate(ordered, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda r: F.size(r["kinds"]) > 1))

    def placed(r: Column) -> Column:
        size = r["stop"] - r["start"]
        return F.struct(r["start"].alias("start"), size.alias("len"), F.substring(text, r["start"] + 1, size).alias("value"))

    return F.transform(T.let(F.array_sort(found), dealt), placed)


def company_to_left(suffix: str) -> str:
    """A legal form and what belongs to it on its left.

    By precedence: an opening word or an abbreviation in capitals up to four
    words before, all between with capitals or linking words; a word before
    `...gesellschaft mbH`; a word before the usual middle words; a number
    beside a capitalised word; the word before, in any case but a determiner.
    An abbreviation right before all that belongs to it too.
    """
    s = r"[ \t\u00a0]{1,3}"
    short = r"\p{Lu}(?:[+&]?\p{Lu})+(?![\p{L}\p{Nd}])"
    capital = r"\p{Lu}[\p{L}\p{Nd}.&+'-]*"
    word = rf"(?!(?:{DETERMINERS}|und|oder|and|the|of|bei|mit|für|Co)\b)[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}}.&+'-]*"
    bare = rf"(?!{suffix})"
    between = rf"(?:{s}{bare}(?:{capital}|{'|'.join(COMPANY_LINKS)}|[-–](?=\s))){{0,3}}"
    ways = [
        rf"(?:{_or(COMPANY_OPENERS)}(?!\p{{L}})|{short}){between}",
        rf"{word}{s}\p{{L}}*[Gg]esellschaft(?={s}mbH)",
        rf"{word}(?:{s}{_or(COMPANY_MIDDLES)}(?!\p{{L}}))+",
        rf"(?:\d{{1,3}}{s}{capital}|{capital}{s}\d{{1,3}})",
        word,
    ]
    return rf"{_L}{bare}(?:{short}{s}{bare})?(?:{'|'.join(ways)}){s}{suffix}"


#: A street by its last word, and a house number.
STREET = r"\p{Lu}[\p{L}.-]*(?:\s\p{Lu}?[\p{L}-]*)?(?:straße|strasse|str\.|Straße|Strasse|Str\.|allee|Allee|platz|Platz|weg|Weg|ring|Ring|markt|Markt|berg|Berg)"
HOUSE = r"\d{1,4}(?:\s?[A-Za-z]\b)?(?:-\d{1,4})?"


def recognizers(g: Gazetteers) -> list[Recognizer]:
    """All recognisers in order of priority."""
    street, house = STREET, HOUSE
    city = city_pattern(g.cities)
    by_key = F.create_map(*[F.lit(x) for c in sorted(set(g.cities)) for x in (re.sub(r"[\s-]+", " ", c), c)])
    zip_city = rf"\d{{5}}\s+{city}"
    address = rf"{_L}(?:{street}\s{house}\s*[,;–-]?\s*{zip_city}|{zip_city}\s*[,;–-]?\s*{street}\s{house}|{street}\s{house}\s*[,;–-]?\s*{city}|{zip_city}){_R}"
    area = "|".join(sorted(g.area_codes, key=len, reverse=True))
    mobile = "|".join(g.mobile_codes)
    local = r"(?:[ /-]{0,3}\d+)+"
    phone = rf"(?<![\p{{L}}\p{{Nd}}+])(?:\+49\s?(?:\(0\)\s?)?|0049\s?|\(0|0)(?:{area}|{mobile})\)?{local}{_R}"
    first, last = _or(g.firstnames), _or(g.surnames)
    double = rf"{last}(?:\s?-\s?{last})?"
    suffix = rf"(?:{_or(g.company_suffixes)}|mbH)(?![\p{{L}}\p{{Nd}}])"
    address_guard = rf"(?=[.w{_initials(g.schemes)}])(?:\.{_or(g.tlds)}\b|www\.|{_or(g.schemes)}:)"

    def bank_records(text: Column) -> Column:
        return records(text, {k: bank_field(k) for k in ("owner", "bank", "account", "bank_code")})

    def bank_code(v: Column) -> Column:
        return F.regexp_replace(F.regexp_extract(v, rf"{PREAMBLES['bank_code']}{_GAP}(\d[\d ]{{6,9}}\d)", 1), " ", "")

    def bank_check(v: Column) -> Column:
        """Both numbers are there, and the bank code is one of the list, or without a list of eight digits from a clearing area (1 to 8)."""
        code = bank_code(v)
        known = code.isin(g.bank_codes) if g.bank_codes else code.rlike(r"^[1-8]\d{7}$")
        return known & (F.regexp_extract(v, bank_field("account"), 1) != "")

    def bank_parts(v: Column) -> dict[str, Column]:
        text = {k: F.nullif(F.regexp_replace(F.trim(F.regexp_extract(v, bank_field(k), 1)), r"\s+", " "), F.lit("")) for k in ("bank", "owner")}
        return {"bank_code": bank_code(v), "account": F.regexp_replace(F.regexp_extract(v, bank_field("account"), 1), " ", "")} | text

    def company_parts(v: Column) -> dict[str, Column]:
        return {"name": F.regexp_replace(F.regexp_replace(v, r"\s+-\s*|\s*-\s+", "-"), r"\s+", " ")}

    def zip_check(v: Column) -> Column:
        code = F.regexp_extract(v, r"(?<!\d)(\d{5})(?!\d)", 1)
        known = code.isin(g.zip_codes) if g.zip_codes else ~code.startswith("00")
        return (code == "") | known

    def parts(kind: str) -> Callable[[Column], dict[str, Column]]:
        return lambda v: {kind: v}

    def iban_parts(v: Column) -> dict[str, Column]:
        p = _plain(v)
        return {"iban": p, "bank_code": F.substring(p, 5, 8), "account": F.substring(p, 13, 10), "iban_valid": C.iban_valid(p).cast("string")}

    def address_parts(v: Column) -> dict[str, Column]:
        s = F.regexp_extract(v, rf"({street})\s({house})", 1)
        return {
            "street": F.nullif(s, F.lit("")),
            "house": F.nullif(F.regexp_replace(F.regexp_extract(v, rf"({street})\s({house})", 2), " ", ""), F.lit("")),
            "zip": F.nullif(F.regexp_extract(v, r"(?<!\d)(\d{5})(?!\d)", 1), F.lit("")),
            "city": F.try_element_at(by_key, F.regexp_replace(F.regexp_extract(v, rf"({city})", 1), r"[\s-]+", " ")),
        }

    def name_parts(v: Column) -> dict[str, Column]:
        bare = F.regexp_replace(v, rf"^(?:{PREAMBLES['title']}\s+)+", "")
        turned = bare.rlike(",")
        front, back = F.trim(F.split_part(F.regexp_replace(bare, ",", " "), F.lit(" "), F.lit(1))), F.trim(F.element_at(F.split(bare, r"[ ,]+"), -1))
        one = ~bare.rlike("[ ,]")
        return {"firstname": F.when(one, F.lit(None)).when(turned, back).otherwise(front), "surname": F.when(turned, front).otherwise(back), "title": _title(v)}

    def phone_parts(v: Column) -> dict[str, Column]:
        code = C.area_code(v)
        cities = F.create_map(*[F.lit(x) for kv in g.area_codes.items() for x in kv])
        found = F.regexp_extract(code, rf"^({area})", 1)
        kind = F.when(code.rlike(rf"^(?:{mobile})"), "Mobile").otherwise("Telephone")
        return {"type": kind, "city_area": F.try_element_at(cities, found)}

    after = lambda kind: rf"(?<![\p{{L}}]){PREAMBLES[kind]}{_GAP}"
    return [
        Recognizer("email", "Email", T.EMAIL, 0, None, parts("email")),
        Recognizer("url", "Url", T.url_pattern(g.tlds, g.schemes), 0, None, parts("url"), guard=address_guard),
        Recognizer("address", "Address", address, 0, zip_check, address_parts, lead=r"\p{Lu}\d"),
        Recognizer("phone_preamble", "PhoneNumber", rf"{after('phone')}(\(\d[\d /-]*\d\)(?:[ /-]{{0,3}}\d+)*|[+(]?\d(?:[\d ()/-]*\d))", 1, lambda v: (F.length(_digits(v)) >= 5) & T.bracket_balance(v), phone_parts, lead="TFHMPR"),
        Recognizer("iban", "AccountNumber", rf"{_L}DE\d{{2}}(?:\s?\d{{4}}){{4}}\s?\d{{2}}{_R}", 0, lambda v: C.iban_shape(_plain(v)), iban_parts, lead="D"),
        Recognizer("bank_fields", "AccountNumber", "", 0, bank_check, bank_parts, find=bank_records, guard=PREAMBLES["account"]),
        Recognizer("customer", "CustomerNumber", rf"{after('customer')}(?:(?:Lautet|Ist|Nummer|Number|Nr|No|lautet|ist)\.?{_GAP})?((?=[\p{{L}}\d.-]*\d)[\p{{Lu}}\d][\p{{L}}\d]*(?:[.-][\p{{L}}\d]+)*){_R}", 1, None, parts("number"), lead="KVARMCF"),
        Recognizer("birthday", "Birthday", rf"{after('birthday')}({_DATE})|(?<=\bam )(?:{_DATE})(?= geboren)", 0, lambda v: C.parse_date(F.regexp_extract(v, rf"({_DATE})", 1)).isNotNull(), lambda v: {"date": C.parse_date(F.regexp_extract(v, rf"({_DATE})", 1)).cast("string")}, lead=r"GgDb\d"),
        Recognizer("birthplace", "Birthplace", rf"{after('birthplace')}(?:\S+\s+){{0,3}}?({_or(g.birthplaces)})(?!\p{{L}})", 1, None, lambda v: {"place": F.regexp_replace(v, r"\(\s*(.*?)\s*\)", "($1)")}, lead="GgPb"),
        Recognizer("marital", "MaritalStatus", rf"(?i){after('marital')}(?:\S+\s+){{0,3}}?({_or(g.marital)}){_R}", 1, None, lambda v: {"status": F.lower(v)}, lead="fpbmcr"),
        Recognizer("marital_answer", "MaritalStatus", rf"(?<![\p{{L}}]){MARITAL_QUESTIONS}(?: \((?:ja/nein|yes/no)\))?{_GAP}(?:\S+\s+){{0,3}}?({YES_NO}){_R}", 1, None, lambda v: {"answer": F.when(v.isin("ja", "yes"), "yes").otherwise("no")}, lead="VLGMSDW"),
        Recognizer("nationality", "Nationality", rf"(?i){after('nationality')}(?:\S+\s+){{0,3}}?({_or(g.nationalities)})\p{{L}}{{0,2}}{_R}", 1, None, lambda v: {"nationality": F.lower(v)}, lead="snc"),
        Recognizer("card", "CreditCard", rf"(?<![\p{{L}}\p{{Nd}}_.,/-])(?:\d{{13,16}}|\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{1,4}}|\d{{5}}[ -]\d{{5}}[ -]\d{{5}}|\d{{8}}[ -]\d{{8}}){_R}", 0, lambda v: C.luhn(_digits(v)), lambda v: {"number": _digits(v)}, lead=r"\p{Nd}"),
        Recognizer("passport", "PassportIdCardNumber", rf"{_L}(?=[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{{8,10}}{_R}", 0, lambda v: C.passport(v, g.old_passport_prefixes), parts("number"), lead="A-Z0-9"),
        Recognizer("car", "CarNumber", rf"{_L}(?:D\s?-\s?)?{_or(g.plate_areas)}(?:\s?-\s?|\s)[A-Z]{{1,2}}[\s-]{{0,3}}\d{{1,4}}[EH]?{_R}|{_L}D\s?-\s?{_or(g.plate_areas)}\s?-\s?\d{{1,4}}{_R}", 0, None, lambda v: {"number": F.regexp_replace(v, r"\s*-\s*", "-")}, lead=f"D{_initials(g.plate_areas)}"),
        Recognizer("health", "HealthInsurance", rf"{_L}[A-Z]\d{{9}}{_R}", 0, C.health_insurance, parts("number"), lead="A-Z"),
        Recognizer("driver", "DriverLicense", rf"{_L}[A-Z0-9]{{9}}[0-9X][0-9A-Z]{_R}", 0, lambda v: F.substring(v, 1, 4).isin(g.licence_authorities) & C.driver_licence_digit(v), parts("number"), lead="A-Z0-9"),
        Recognizer("ssn", "SocialSecurity", rf"{_L}\d{{2}}[ /-]{{0,3}}\d{{6}}[ /-]{{0,3}}[A-Z][ /-]{{0,3}}\d{{3}}{_R}", 0, lambda v: C.social_security(_plain(v)), lambda v: {"number": _plain(v)}, lead=r"\d"),
        Recognizer("tax", "TaxIdentification", rf"{after('tax')}(\d(?:[\d /-]*\d)){_R}", 1, lambda v: C.tax_id(_digits(v)) | C.tax_number_old(_digits(v), g.old_tax_prefixes), lambda v: {"number": _digits(v), "type": F.when(C.tax_id(_digits(v)), "New").otherwise("Old")}, lead="SIT"),
        Recognizer("company_list", "Company", rf"{_L}{_or(g.companies)}(?:\s{_or(g.company_suffixes)})?(?![\p{{L}}\p{{Nd}}])", 0, None, parts("name"), lead=_initials(g.companies)),
        Recognizer("company_suffix", "Company", company_to_left(suffix), 0, None, company_parts, guard=rf"\s{suffix}", lead=r"\p{L}\p{Nd}"),
        Recognizer("company_prefix", "Company", rf"{_L}{_or(g.company_prefixes)}(?:[ ](?:{'|'.join(COMPANY_LINKS)}))?[ ]{{1,3}}\p{{Lu}}[\p{{L}}-]*(?:[ ]{{0,3}}-[ ]{{0,3}}\p{{Lu}}[\p{{L}}-]*|[ ]{{1,3}}\p{{Lu}}[\p{{L}}-]*)*", 0, None, company_parts, lead=_initials(g.company_prefixes)),
        Recognizer("name_title", "Name", rf"{_L}(?:{PREAMBLES['title']}\s+)+(?:{_NAME}\s+|\p{{Lu}}\.\s*)?{_NAME}", 0, None, name_parts, lead="HFPDM"),
        Recognizer("name", "Name", rf"{_L}(?={first}|{last})(?<!\b(?:{DETERMINERS})\s)(?:{first}\s?,?\s{double}|{double}\s?,?\s{first}){_R}", 0, lambda v: _not_excluded(v, g), name_parts, lead=_initials(g.firstnames, g.surnames)),
        Recognizer("phone", "PhoneNumber", phone, 0, lambda v: F.length(_digits(v)).between(7, 16) & T.bracket_balance(v), phone_parts, lead="+(0"),
    ]


def _not_excluded(v: Column, g: Gazetteers) -> Column:
    pairs = {f"{a} {b}" for a, b in g.excluded} | {f"{b} {a}" for a, b in g.excluded}
    return ~F.regexp_replace(v, r"\s*,?\s+", " ").isin(sorted(pairs)) & ~v.rlike(r"\.")


def candidates(text: Column, rec: Recognizer, priority: int) -> Column:
    """Array of candidates of one recogniser; where the pattern announces a value, the place is the value's."""
    found = rec.find(text) if rec.find else T.spans(text, rec.pattern)
    if rec.group:

        def inner(m: Column) -> Column:
            own = F.struct(m["start"].alias("start"), m["value"].alias("whole"), F.regexp_extract(m["value"], rec.pattern, rec.group).alias("value"))

            def placed(o: Column) -> Column:
                shift = F.length(o["whole"]) - F.instr(F.reverse(o["whole"]), F.reverse(o["value"])) - F.length(o["value"]) + 1
                return F.struct((o["start"] + shift).cast("int").alias("start"), F.length(o["value"]).alias("len"), o["value"].alias("value"))

            return T.let(own, placed)

        found = F.transform(found, inner)
    if rec.check is not None:
        found = F.filter(found, lambda m: F.coalesce(rec.check(m["value"]), F.lit(False)))

    def whole(m: Column) -> Column:
        attrs = rec.attrs(m["value"]) if rec.attrs else {}
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in attrs.items()])
        return F.struct(
            F.lit(priority).alias("priority"), F.lit(rec.label).alias("label"), F.lit(rec.name).alias("recognizer"), m["start"].alias("start"), m["len"].alias("len"),
            m["value"].alias("value"), F.filter(pairs, lambda p: p["value"].isNotNull()).cast(ATTRS).alias("attrs"),
        )

    return F.transform(found, whole)
