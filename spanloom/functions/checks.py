"""Check digits and layouts of numbers, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Areas of social-security numbers, and letters of passports.
SSN_AREAS = [*range(2, 5), *range(8, 22), *range(23, 27), 28, 29, *range(38, 41), *range(42, 83), 89]
SSN_WEIGHTS = [2, 1, 2, 5, 7, 1, 2, 1]
PASSPORT_FIRST = "CFGHJKLMNPRTVWXY"
PASSPORT_REST = "0-9CFGHJKLMNPRTVWXYZ"
STREET_ENDS = ["straße", "strasse", "str.", "allee", "platz", "weg", "ring", "markt", "berg"]
GERMAN_MONTHS = {"januar": 1, "februar": 2, "märz": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12}
ENGLISH_MONTHS = {"january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "october": 10, "december": 12}


def values(text: Column) -> Column:
    """Digits as they are, A..Z as 10..35."""
    return F.transform(F.split(text, ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, b: a + b)


def root(n: Column) -> Column:
    """Cross sum, again and again."""
    return F.when(n == 0, F.lit(0)).otherwise(F.pmod(n - 1, F.lit(9)) + 1)


def _all_but_last(array: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))


def luhn(digits: Column, strict: bool = False) -> Column:
    """Luhn's check.  The doubled digits are the even ones from the left; strict: every second one from the right."""
    v = values(digits)

    def weighed(d: Column, i: Column) -> Column:
        doubled = F.pmod(F.size(v) - i if strict else i, F.lit(2)) == 0
        return F.when(doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    check = F.pmod(10 - F.pmod(total(F.transform(_all_but_last(v), weighed)), F.lit(10)), F.lit(10))
    return digits.rlike("^[0-9]{2,}$") & (check == F.element_at(v, -1))


def iban_shape(text: Column) -> Column:
    """DE and 20 more characters, in one piece or in groups of four."""
    return text.rlike(r"^DE[0-9A-Z]{20}$|^DE[0-9]{2}( [0-9]{4}){4} [0-9]{2}$")


def iban_valid(text: Column) -> Column:
    """The international check, remainder 1 modulo 97."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rest = F.aggregate(values(turned), F.lit(0), lambda acc, v: F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))
    return plain.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{10,30}$") & (rest == 1)


def _letter_roots(letter: Column, first: int, second: int) -> Column:
    """A letter's number in the alphabet as two digits with a weight each."""
    n = F.ascii(letter) - 64
    return root(F.floor(n / 10) * first) + root(F.pmod(n, F.lit(10)) * second)


def health_insurance(text: Column) -> Column:
    """A letter and nine digits; weights 1, 2 by turns, the letter as two digits."""
    body = F.transform(F.slice(values(text), 2, 8), lambda d, i: root(d * (1 + F.pmod(i, F.lit(2)))))
    check = F.pmod(_letter_roots(F.substring(text, 1, 1), 1, 2) + total(body), F.lit(10))
    return text.rlike("^[A-Z][0-9]{9}$") & (check == F.substring(text, 10, 1).cast("int"))


def driver_licence_digit(text: Column) -> Column:
    """The tenth character of a driver licence: weights 9 to 1, modulo 11, X for 10."""
    body = F.transform(F.slice(values(text), 1, 9), lambda v, i: v * (9 - i))
    rest = F.pmod(total(body), F.lit(11))
    return text.rlike("^[0-9A-Z]{9}[0-9X][0-9A-Z]$") & (F.when(rest == 10, "X").otherwise(rest.cast("string")) == F.substring(text, 10, 1))


def social_security(text: Column) -> Column:
    """Area, date, letter, serial: 12 characters, weighted cross sums modulo 10."""
    v, weights = values(text), F.array(*map(F.lit, SSN_WEIGHTS))
    front = F.transform(F.slice(v, 1, 8), lambda d, i: root(d * F.element_at(weights, i + 1)))
    tail = root(F.element_at(v, 10) * 2) + root(F.element_at(v, 11))
    check = F.pmod(total(front) + _letter_roots(F.substring(text, 9, 1), 2, 1) + tail, F.lit(10))
    return text.rlike("^[0-9]{8}[A-Z][0-9]{3}$") & F.substring(text, 1, 2).cast("int").isin(SSN_AREAS) & (check == F.element_at(v, 12))


def tax_id(text: Column) -> Column:
    """Eleven digits under ISO 7064 modulo 11, 10."""

    def step(product: Column, d: Column) -> Column:
        s = F.pmod(d + product, F.lit(10))
        return F.pmod(F.when(s == 0, 10).otherwise(s) * 2, F.lit(11))

    product = F.aggregate(F.slice(values(text), 1, 10), F.lit(10), step)
    return text.rlike("^[0-9]{11}$") & (F.pmod(11 - product, F.lit(10)) == F.substring(text, 11, 1).cast("int"))


def tax_number_old(text: Column, prefixes: list[str]) -> Column:
    """10 to 13 digits that begin with a known prefix of three characters or else two."""
    return text.rlike("^[0-9]{10,13}$") & (F.substring(text, 1, 3).isin(prefixes) | F.substring(text, 1, 2).isin(prefixes))


def passport_digit(text: Column) -> Column:
    """Last digit: weights 7, 3, 1 by turns, modulo 10."""
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    body = F.transform(_all_but_last(values(text)), lambda v, i: v * F.element_at(weights, F.pmod(i, F.lit(3)) + 1))
    return text.rlike("[0-9]$") & (F.pmod(total(body), F.lit(10)) == F.right(text, F.lit(1)).cast("int"))


def passport(text: Column, old_prefixes: list[str] | None = None) -> Column:
    """Child's, old and new passport and identity-card numbers of 8 to 10 characters."""
    child = text.rlike("^[A-G][0-9]{7,8}$")
    new = text.rlike(f"^[{PASSPORT_FIRST}][{PASSPORT_REST}]{{8,9}}$")
    tests = [F.startswith(text, F.lit(p)) & F.substring(text, len(p) + 1, 20).rlike("^[0-9]*$") for p in old_prefixes or ()]
    old = reduce(lambda a, b: a | b, tests, F.lit(False))
    n = F.length(text)
    return ((n == 8) & child) | ((n == 9) & ((child & passport_digit(text)) | old | new)) | ((n == 10) & (old | new) & passport_digit(text))


def street_suffix(text: Column) -> Column:
    """Street by its last part; a capitalised part alone is one too."""
    return F.lower(text).rlike("(" + "|".join(e.replace(".", r"\.") for e in STREET_ENDS) + ")$")


def house_number(text: Column) -> Column:
    return text.rlike(r"^[0-9][0-9A-Za-zÄÖÜäöüß-]*$")


def upper_abbreviation(text: Column) -> Column:
    """At least two characters: capitals, with punctuation or +."""
    return text.rlike(r"^[A-ZÄÖÜ][A-ZÄÖÜ.&+-]+$")


def parse_date(text: Column) -> Column:
    """Day, month and year in the layouts of letters and forms; two-digit years fall in 1930 to 2029."""
    plain = F.lower(F.trim(text))
    numeric = r"^(\d{1,2})[./ -]\s*(\d{1,2})[./ -]\s*(\d{4}|\d{2})$"
    named = r"^(\d{1,2})\.?\s*(\p{L}+)\.?,?\s+(\d{4}|\d{2})$"
    months = F.create_map(*[F.lit(x) for kv in (GERMAN_MONTHS | ENGLISH_MONTHS).items() for x in kv])

    def date(pattern: str, month: Column) -> Column:
        year = F.regexp_extract(plain, pattern, 3).try_cast("int")
        year = F.when(year < 30, year + 2000).when(year < 100, year + 1900).otherwise(year)
        made = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(plain, pattern, 1), 2, "0"))
        return F.when(plain.rlike(pattern) & month.isNotNull(), made.try_cast("date"))

    iso = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), plain.try_cast("date"))
    return F.coalesce(iso, date(numeric, F.regexp_extract(plain, numeric, 2).try_cast("int")), date(named, F.try_element_at(months, F.regexp_extract(plain, named, 2))))


def area_code(number: Column) -> Column:
    """A phone number's digits from its area code on: without 0, 49 or 490 in front."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    return F.regexp_replace(digits, "^(490|49|0)", "")
