"""Personal data replaced by keyed surrogates.

Detection finds e-mail addresses, phone numbers, IPv4 and IPv6 addresses, long
account and card numbers, IBANs, social-security numbers, secrets, labelled birth
dates and passport numbers, and names that stand after a title; and then, in the
same text, further mentions of these people without a title, by full, family or
given name (but for a month's name where a date is meant).  Each entity (type and canonical form) gets a replacement drawn by
HMAC-SHA-256 from a key: of its type, with digits for digits and letters for
letters in the mention's own layout and case, keeping a card's Luhn validity, an
IBAN's country and check digits, an address's validity, a secret's known prefix,
and a name's gender and script.  The same entity always gets the same surrogate,
in every document.

Hyphens and apostrophes in names stay where they are, and Jr, II and the like are
no part of a name.  Given and family names are entities of their own, so "Mr John Smith", "J. Smith",
"Dr Smith" and a later "Smith" become one person, and a family keeps one name.  A
given name after a title that tells no gender has the gender of the same name in
its document, or else the only one it has in the table.

Distinct entities stay distinct: the distinct entities of the whole table are
given surrogates, and those that clash, as they would be printed, with another's
surrogate or with a real entity are drawn again until none does.  Birth dates are
few, so they are not drawn: in a cycle through all dates, in an order that the key
decides, each date's surrogate is the next one, so they differ from each other and
from their own date, however many there are.  First draws need no table, so only the entities drawn again are looked up: from a broadcast if they
are counted as few, else by a join.

Defined results: null text stays null, with no entities; overlapping
detections go to the earlier and longer one; equal rows give equal rows; texts of
any length are read whole; an empty table gives no rows; other columns, whatever
their names, are ignored.  Names that never follow a title and postal addresses
are not found.
"""

from __future__ import annotations

import hmac
import json
import re
from calendar import monthrange
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import BROADCAST_ROWS, written

# Titles by gender, and names by script and gender that replace others.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "госпожа", "г-жа", "Κυρία"],
    "n": ["Dr", "Prof", "Professor", "Doctor"],
}
NAMES = {
    "latin": {
        "m": ["Adrian", "Bruno", "Caspar", "Damian", "Edgar", "Felix", "Gregor", "Hugo", "Ivo", "Jonas", "Konrad", "Leon", "Magnus", "Nils", "Oskar", "Pascal", "Quentin", "Ruben", "Silas", "Tobias"],
        "f": ["Adele", "Bianca", "Clara", "Daria", "Elena", "Frida", "Greta", "Helena", "Ines", "Jana", "Klara", "Lena", "Marta", "Nora", "Olivia", "Paula", "Rosa", "Selma", "Tilda", "Vera"],
        "last": ["Ahrens", "Bergmann", "Calder", "Dorn", "Ellwood", "Falk", "Garner", "Hollis", "Imhof", "Jansen", "Keller", "Lorca", "Marlow", "Norden", "Orlow", "Prado", "Quast", "Rivera", "Stern", "Thorne", "Ulrich", "Vidal", "Winter", "Ziegler"],
    },
    "cyrillic": {
        "m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев"],
        "f": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Лидия", "Нина"],
        "last": ["Белых", "Гончар", "Долгих", "Коваль", "Мороз", "Седых", "Чернов", "Шевчук"],
    },
    "greek": {
        "m": ["Ανδρέας", "Γιώργος", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος"],
        "f": ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
        "last": ["Αλεξίου", "Δήμου", "Ζέρβας", "Λάμπρου", "Μάνος", "Ρήγας"],
    },
}
_REST = r"[^\W\d_]*(?:[-'’](?!s\b)[^\W\d_]+)*"  # of a name after its capital
_CAPITAL = r"(?-i:[A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_GENDER = {t: g for g, x in TITLES.items() for own in x for t in (own, own.upper())}
_TITLE = "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True))
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "la", "zu", "zum")
SUFFIXES = ("Jr", "Sr", "Jun", "Sen", "II", "III", "IV")
_SUFFIX = rf"(?!(?:{'|'.join(SUFFIXES)})\b)"
# Months that are names too, and words before a month.
MONTHS = {"april", "may", "june", "august", "mai", "juni", "juli", "avril", "abril"}
_DATED = re.compile(r"(?:\b(?:in|on|of|since|until|till|by|during|from|to|last|next|this|every|early|late|im|am|seit|bis|ab|vom|zum|ende|anfang|mitte|en|de|le)|\d\.?(?:st|nd|rd|th)?)[ ]$", re.I)
_SURNAME = rf"{_SUFFIX}(?:(?:{'|'.join(PARTICLES)})[ ])*{_CAPITAL}(?:\.|{_REST})"
PREFIXES = ("sk", "pk", "ghp", "gho", "xoxa", "xoxb", "xoxp", "AKIA", "AIza")
DETECT = re.compile(
    rf"""(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}(?:@|\(at\)|\[at\])(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}})
    |(?P<secret>(?:(?<=["'`=: ])|\b)(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{{32,128}}(?![0-9A-Za-z])|\b(?:{'|'.join(PREFIXES)})[-_A-Za-z0-9]{{12,}})
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,4}})?(?![A-Za-z0-9]))
    |(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d))
    |(?P<ipv6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?:[0-9A-Fa-f]{{1,4}}:){{1,6}}(?::[0-9A-Fa-f]{{1,4}}){{1,6}})(?![\w:]|\.\d))
    |(?:(?:[Bb]orn(?:[ ]on)?|[Dd]ate[ ]of[ ]birth|DOB|[Gg]eboren(?:[ ]am)?|[Gg]eb\.|[Gg]eburtsdatum|[Nn]ée?[ ]le|[Nn]acid[oa][ ]el):?[ ]?(?P<birth>\d{{4}}-\d\d-\d\d|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}})(?!\d))
    |(?:(?:[Pp]assport|[Rr]eisepass|[Pp]asaporte|[Pp]asseport)(?:[ ](?:no\.?|number|[Nn]r\.?|n°))?:?[ ](?P<passport>(?=[A-Z]*\d)[A-Z0-9]{{7,9}})(?![A-Za-z0-9]))
    |(?:\b(?:Tel|Telefon|Phone|Fax|Mobil|Handy|Rufnummer)\.?:?[ ](?P<phone2>\(?0\d{{1,5}}\)?[ /-]{{1,3}}\d{{2,}}(?:[ -]\d+)*)(?!\d))
    |(?P<phone>(?<![\w+])\+1[ .\-]?\(?\d{{3}}\)?[ .\-]?\d{{3}}[ .\-]?\d{{4}}(?!\d)|(?<![\w+])\+\d{{1,3}}(?:[ .\-/]?\(?\d{{1,5}}\)?){{2,6}}(?!\d|\.\d)|(?<![\w+.-])\(\d{{3}}\)[ ]?\d{{3}}[-. ]\d{{4}}(?!\d)|(?<![\w+.-])\d{{3}}[-. ]\d{{3}}[-. ]\d{{4}}(?![\d-]))
    |(?P<card>(?<![\d.-])\d(?:[ -]?\d){{12,18}}(?![\d]|[.-]\d))
    |(?P<ssn>(?<![\d-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d-]))
    |(?P<name>\b(?P<title>(?:(?:{_TITLE})\.?[ ])+)(?P<person>{_SURNAME}(?:[ ]{_SURNAME}){{0,2}}))""",
    re.X,
)
#: A text without any of these has no entity; it is passed over at once.
_HINT = re.compile(rf"[\d@]|\b(?:{_TITLE})\b|\((?:at)\)|\[at\]")
_DIGITS = re.compile(r"\d")
#: Tasks that the rows of one text may be dealt over.
SALTS = 32


def luhn(digits: str) -> int:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10


def canonical(kind: str, mention: str) -> str:
    """The form that all mentions of an entity share (names: see people)."""
    if kind == "email":
        return re.sub(r"\(at\)|\[at\]", "@", mention.lower())
    if kind in ("phone", "card", "ssn"):
        return ("+" if mention.startswith("+") else "") + "".join(_DIGITS.findall(mention))
    if kind == "birth":
        parts = [p.zfill(2) for p in re.split(r"\D", mention)]
        return "-".join(parts if len(parts[0]) == 4 else reversed(parts))
    if kind == "iban":
        return mention.replace(" ", "").upper()
    return mention.lower() if kind in ("secret", "ipv6") else mention


def _own_names(person: str) -> list[str]:
    """Given names and the family name, without particles, in lower case."""
    return [x.lower() for x in person.split(" ") if x not in PARTICLES]


@lru_cache(4096)
def _mentions(names: frozenset[str]) -> re.Pattern:
    """Full and family names in their own case or in capitals, longest first."""
    forms = sorted({f for n in names for f in (n, n.upper())}, key=lambda f: (-len(f), f))
    return re.compile(r"(?<![\w@.-])(?:" + "|".join(map(re.escape, forms)) + r")(?![\w@-])")


def people(text: str, titled: list[tuple[int, int, str, str]], taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """start, end (of the name alone), "name" and canonical form of each mention of the people that titles point out.

    titled: start and end of the name, its titles, the name.  The canonical
    form is gender | names in lower case; an initial is followed by = and the
    given name it stands for, if the text has that.
    """
    own = []
    for start, end, titles, person in titled:
        gender = next((g for t in re.findall(r"[^ .]+(?:-[^ .]+)?", titles) if (g := _GENDER.get(t, "n")) != "n"), "n")
        own.append((start, end, gender, _own_names(person)))
    full = {(*names,): g for g in ("f", "m") for _, _, gender, names in own if gender == g and len(names) > 1}
    for _, _, gender, names in own:
        if len(names) > 1:
            full.setdefault((*names,), gender)
    forms = {}
    for (start, end, _, person), (_, _, _, names) in zip(titled, own, strict=True):
        forms[person] = names
        given, family = person.split(" ")[0], person.split(" ")[-1]
        if len(names) > 1 and given not in PARTICLES and not given.endswith("."):
            forms.setdefault(f"{given[0]}. {family}", [f"{given[0].lower()}.", names[-1]])
        if len(family) > 1 and not family.endswith("."):
            forms.setdefault(family, names[-1:])
        if len(names) > 1 and len(given) > 2 and given not in PARTICLES and not given.endswith("."):
            forms.setdefault(given, [names[0], ""])  # a given name alone: no family name
    spans = sorted([(s, e) for s, e, _, _ in own] + taken)
    at = 0
    for m in _mentions(frozenset(forms)).finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        dated = m[0].lower() in MONTHS and _DATED.search(text, max(0, m.start() - 12), m.start())
        if not dated and (at == len(spans) or spans[at][0] >= m.end()):
            names = forms.get(m[0]) or next(n for f, n in forms.items() if f.upper() == m[0])
            own.append((m.start(), m.end(), "n", names))
    out = []
    for start, end, gender, names in own:
        if gender == "n":
            gender = full.get((*names,), "n")
        if names[-1] == "" and gender == "n":
            gender = next((g for g in ("f", "m") for k, own_gender in full.items() if own_gender == g and k[0] == names[0]), "n")
        if len(names) > 1 and names[0].endswith("."):
            known = sorted((k, g) for k, g in full.items() if k[-1] == names[-1] and k[0].startswith(names[0][:-1]) and not k[0].endswith("."))
            if known:
                gender, names = (known[0][1] if gender == "n" else gender), [f"{names[0]}={known[0][0][0]}", *names[1:]]
        out.append((start, end, "name", gender + "|" + " ".join(names)))
    return out


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, type and canonical form of each entity, in order and apart from each other."""
    if not _HINT.search(text):
        return []
    found, titled = [], []
    for m in DETECT.finditer(text):
        kind = (m.lastgroup or "").rstrip("2")
        if m["person"]:
            titled.append((m.start("person"), m.end("person"), m["title"], m["person"]))
        else:
            found.append((*m.span(m.lastgroup), kind, canonical(kind, m[m.lastgroup])))
    if titled:
        found = sorted(found + people(text, titled, [f[:2] for f in found]))
    return found


def parts(kind: str, canon: str) -> list[tuple[str, str]]:
    """The entities that are drawn for a mention: itself, or its given and family names."""
    if kind != "name":
        return [(kind, canon)]
    gender, names = canon.split("|", 1)
    *given, family = names.split(" ")
    return [("initial", x) if x.endswith(".") else ("given", f"{gender}|{x.split('=')[-1]}") for x in given] + [("initial" if family.endswith(".") else "family", family)] * bool(family)


class Stream:
    """Numbers drawn from a key and a label, without end."""

    def __init__(self, key: bytes, label: str):
        self.key, self.label, self.block, self.pool = key, label.encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.digest(self.key, self.label + self.block.to_bytes(4, "big"), sha256)
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n


def _rounds(key: bytes, label: str, x: int, half: int, order) -> int:
    """A keyed permutation of numbers of 2 * half bits (four Feistel rounds); the same rounds backwards undo it."""
    left, right = x >> half, x & ((1 << half) - 1)
    for k in order:
        if order.step > 0:
            left, right = right, left ^ (int.from_bytes(hmac.digest(key, f"{label}|{k}|{right}".encode(), sha256)[:4], "big") & ((1 << half) - 1))
        else:
            left, right = right ^ (int.from_bytes(hmac.digest(key, f"{label}|{k}|{left}".encode(), sha256)[:4], "big") & ((1 << half) - 1)), left
    return left << half | right


def next_date(key: bytes, canon: str) -> str:
    """The date after this one in a cycle whose order the key decides: through the days of 1900 to 2029, or through all other dates, written as they may be."""
    year, month, day = map(int, canon.split("-"))
    first = date(1900, 1, 1).toordinal()
    usual = 1900 <= year <= 2029 and 1 <= month <= 12 and 1 <= day <= monthrange(year, month)[1]
    if usual:
        half, size, x = 8, date(2030, 1, 1).toordinal() - first, date(year, month, day).toordinal() - first
    else:
        half, size, x = 14, 10_000 * 100 * 100, (year * 100 + month) * 100 + day

    def member(y: int) -> bool:
        if y >= size or usual:
            return y < size
        rest = y % 10_000
        valid = 1 <= rest // 100 <= 12 and 1 <= rest % 100 <= 31
        # A wrong month or day stays one.
        return valid == (1 <= month <= 12 and 1 <= day <= 31) and not (1900 <= y // 10_000 <= 2029 and valid and rest % 100 <= monthrange(y // 10_000, rest // 100)[1])

    place = _rounds(key, "birth", x, half, range(0, 4, 1))
    while True:
        place = (place + 1) % (1 << 2 * half)
        if member(y := _rounds(key, "birth", place, half, range(3, -1, -1))):
            break
    if usual:
        return date.fromordinal(first + y).isoformat()
    return f"{y // 10_000:04d}-{y // 100 % 100:02d}-{y % 100:02d}"


def _like(character: str, draw: Stream) -> str:
    if character.isdigit():
        return str(draw.below(10))
    if "a" <= character <= "z":
        return "abcdefghijklmnopqrstuvwxyz"[draw.below(26)]
    if "A" <= character <= "Z":
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[draw.below(26)]
    return character


@lru_cache(1 << 16)
def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of the replacement of an entity."""
    draw = Stream(key, f"{kind}|{canon}|{attempt}")
    if kind == "email":
        local, domain = canon.rsplit("@", 1)
        labels = domain.split(".")
        own = Stream(key, f"domain|{domain}")  # addresses of one domain keep one domain
        labels = ["".join(_like(c, own) for c in x) for x in labels[:-1]] + labels[-1:]
        pad = "".join(str(draw.below(10)) for _ in range(attempt // 4))  # a short name has few others like it
        return "".join(_like(c, draw) for c in local) + pad + "@" + ".".join(labels)
    if kind == "ip":
        return ".".join(str(draw.below(254) + 1) for _ in range(4))
    if kind == "phone":
        code = 2 if canon.startswith("+1") else 3 if canon.startswith("+") else 0
        return canon[:code] + "".join(str(draw.below(10)) for _ in canon[code:])
    if kind == "card":
        body = [str(draw.below(10)) for _ in canon[:-1]]
        check = (10 - luhn("".join(body) + "0")) % 10
        return "".join(body) + str(check if luhn(canon) == 0 else (check + 1 + draw.below(9)) % 10)
    if kind == "ssn":
        return f"{100 + draw.below(565):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "iban":
        body = "".join(_like(c, draw) for c in canon[4:])
        number = int("".join(str(int(c, 36)) for c in body + canon[:2] + "00"))
        valid = int("".join(str(int(c, 36)) for c in canon[4:] + canon[:4])) % 97 == 1
        check = 98 - number % 97
        return f"{canon[:2]}{check if valid else (check + 1 + draw.below(90)) % 97:02d}{body}"
    if kind == "ipv6":
        return ":".join("".join("123456789abcdef0"[draw.below(15 + bool(k))] for k in range(len(x))) for x in canon.split(":"))
    if kind == "birth":
        return next_date(key, canon)
    if kind == "passport":
        return "".join(_like(c, draw) for c in canon)
    if kind in ("given", "family"):
        gender, name = canon.split("|", 1) if kind == "given" else ("", canon)
        script = "cyrillic" if re.search("[а-яё]", name) else "greek" if re.search("[α-ωά-ώ]", name) else "latin"
        pool = NAMES[script]["last" if kind == "family" else gender] if gender != "n" else NAMES[script]["m"] + NAMES[script]["f"]
        # Each part of a double name has its own; a letter before an apostrophe stays.  Drawn again: doubled and trebled names, as many as it takes.
        own = re.split(r"([-'’])", name)
        out = [x if x in "-'’" or (len(x) == 1 and own[k + 1 : k + 2] in (["'"], ["’"])) else pool[draw.below(len(pool))] for k, x in enumerate(own) if x]
        return "-".join(["".join(out), *(pool[draw.below(len(pool))] for _ in range((attempt + 1) // 2))]).lower()
    if kind == "initial":  # a cycle through the letters in an order drawn from the key: distinct, and never itself
        script = "абвгдежзийклмнопрстуфхцчшщэюя" if re.search("[а-яё]", canon) else "αβγδεζηθικλμνξοπρστυφχψω" if re.search("[α-ω]", canon) else "abcdefghijklmnopqrstuvwxyz"
        order = sorted(script, key=lambda c: hmac.digest(key, f"initial|{c}".encode(), sha256))
        return order[(order.index(canon[0]) + 1) % len(order)] + "." if canon[0] in order else canon
    prefix = next((p for p in PREFIXES if canon.startswith(p.lower())), "")
    if prefix:
        return prefix.lower() + "".join(_like(c, draw) for c in canon[len(prefix) :])
    out = [_like(c, draw) if not re.match("[0-9a-f]", c) or not re.fullmatch("[0-9a-f]+", canon) else "0123456789abcdef"[draw.below(16)] for c in canon]
    return "".join(out)


def laid_out(kind: str, mention: str, chosen: str) -> str:
    """The surrogate in the mention's layout and case."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(chosen.lstrip("+"))
        return _DIGITS.sub(lambda _: next(digits), mention)
    if kind == "iban":
        letters = iter(chosen)
        return "".join(c if c == " " else next(letters) for c in mention)
    if kind == "birth":
        year, month, day = chosen.split("-")
        old = re.split(r"(\D)", mention)
        new = [year, month, day] if len(old[0]) == 4 else [day, month, year]
        return new[0] + old[1] + new[1] + old[3] + new[2]
    if kind == "email":
        at = re.search(r"@|\(at\)|\[at\]", mention)[0]
        chosen = chosen.replace("@", at)
        return chosen.upper().replace("(AT)", "(at)").replace("[AT]", "[at]") if mention.isupper() else chosen
    if kind == "secret":
        prefix = next((p for p in PREFIXES if mention.startswith(p)), "")
        own = "".join(c.upper() if o.isupper() else c for c, o in zip(chosen, mention, strict=True))
        return prefix + own[len(prefix) :]
    return chosen.upper() if kind == "ipv6" and mention.upper() == mention else chosen


def named(mention: str, canon: str, chosen: list[str]) -> str:
    """A name with the surrogates of its parts in its layout and case."""
    out, chosen, forms = [], iter(chosen), iter(canon.split("|", 1)[1].split(" "))
    for own in mention.split(" "):
        if own in PARTICLES:
            out.append(own)
            continue
        new, form = next(chosen), next(forms)
        if "=" in form:
            new = new[0] + "."
        out.append(new.upper() if own.isupper() and len(own) > 2 else re.sub(r"(^|[-'’])(\w)", lambda m: m[1] + m[2].upper(), new))
    return " ".join(out)


def replaced(text: str, key: bytes, again: Callable[[str, str], str | None]) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and start, end (in the old text), type and replacement of each."""
    out, at, found = [], 0, []
    for start, end, kind, canon in detect(text):
        chosen = [again(k, c) or surrogate(key, k, c) for k, c in parts(kind, canon)]
        new = named(text[start:end], canon, chosen) if kind == "name" else laid_out(kind, text[start:end], chosen[0])
        out += [text[at:start], new]
        at = end
        found.append((start, end, kind, new))
    return "".join(out) + text[at:], found


def assignments(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """kind, canon, surrogate, attempt and drawn (the form it was drawn for) of every distinct entity of the table; surrogates of different drawn forms are distinct and no real entity."""

    def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {p for t in batch.column(0).to_pylist() if t for _, _, k, c in detect(t) for p in parts(k, c) if p[0] != "initial"}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], names=["kind", "canon"])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            chosen = [surrogate(key, k, c, n) for k, c, n in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.string())], names=["kind", "canon", "attempt", "surrogate"])

    schema = "kind string, canon string, attempt int, surrogate string"
    known = written(docs.select(text).mapInArrow(entities, "kind string, canon string").distinct(), "entities")
    # A given name of unknown gender is that name's only known one.
    name = F.substring_index("canon", "|", -1)
    genders = known.where("kind = 'given' and canon not like 'n|%'").groupBy(name.alias("name")).agg(F.min("canon").alias("one"), F.count("*").alias("n")).where("n = 1").select("name", "one")
    unknown = (F.col("kind") == "given") & F.col("canon").startswith("n|")
    resolved = known.withColumn("name", F.when(unknown, name)).join(genders, "name", "left").select("kind", "canon", F.coalesce("one", "canon").alias("drawn"))
    resolved = written(resolved, "entities")
    forms = resolved.select("kind", F.col("drawn").alias("canon")).distinct()
    now = written(forms.withColumn("attempt", F.lit(0)).mapInArrow(drawn, schema), "surrogates")
    # What is printed for a given name has no gender mark.
    printed = F.when(F.col("kind") == "given", name).otherwise(F.col("canon"))
    real = known.where("kind <> 'birth'").select("kind", printed.alias("surrogate")).distinct()
    for _ in range(200):
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n")).where("n > 1")
        clash = now.join(first.select("kind", "surrogate", "first"), ["kind", "surrogate"]).where("canon <> first.canon").select("kind", "canon")
        clash = written(clash.unionByName(now.join(real, ["kind", "surrogate"]).select("kind", "canon")).distinct(), "clashes")
        if clash.isEmpty():
            return resolved.join(now.withColumnRenamed("canon", "drawn"), ["kind", "drawn"]).select("kind", "canon", "surrogate", "attempt", "drawn")
        moved = now.join(clash.withColumn("again", F.lit(True)), ["kind", "canon"], "left")
        moved = moved.select("kind", "canon", (F.col("attempt") + F.coalesce(F.col("again").cast("int"), F.lit(0))).alias("attempt"))
        now = written(moved.mapInArrow(drawn, schema), "surrogates")
    raise RuntimeError("surrogates still clash")


def replace_pii(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities, and entities as JSON [[start, end, type, replacement], ...]."""
    secret = key.encode()
    again = assignments(docs, secret, text).where("attempt > 0 or drawn <> canon").select("kind", "canon", "surrogate")
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, text string, n_entities long, entities string"

    def rewritten(ids: pa.Array, texts: list, lookups) -> pa.RecordBatch:
        done = [(None, []) if t is None else replaced(t, secret, look) for t, look in zip(texts, lookups, strict=True)]
        columns = [pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int64()), pa.array([json.dumps(f, ensure_ascii=False) for _, f in done], pa.string())]
        return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "text", "n_entities", "entities"])

    if few:
        table = {(r.kind, r.canon): r.surrogate for r in again.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                for k in range(0, len(batch), 256):
                    piece = batch.slice(k, 256)
                    yield rewritten(piece.column(0), piece.column(1).to_pylist(), [lambda a, b: table.get((a, b))] * len(piece))

        return rows.mapInArrow(run, out)

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, *pair) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for pair in {p for _, _, k, c in detect(t) for p in parts(k, c)}]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.string()) for k in (1, 2))], names=["row", "kind", "canon"])

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [{(x["kind"], x["canon"]): x["surrogate"] for x in own or ()} for own in batch.column(2).to_pylist()]
            yield rewritten(batch.column(0), batch.column(1).to_pylist(), [lambda a, b, t=t: t.get((a, b)) for t in tables])

    # Equal texts have equal replacements, so a text's hash can stand for its row; each is dealt over SALTS, so that no text is a hot key.
    keyed = rows.withColumn("row", F.xxhash64("text"))
    own = keyed.where("text is not null").select("row", "text").mapInArrow(mentions, "row long, kind string, canon string").distinct().join(again, ["kind", "canon"])
    own = own.groupBy("row").agg(F.collect_set(F.struct("kind", "canon", "surrogate")).alias("own"))
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    keyed = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return keyed.join(own, ["row", "salt"], "left").select("doc_id", "text", "own").mapInArrow(run_joined, out)
