"""Quality rules, line first.

Each line is held against three groups of rules: punctuation (it ends a
sentence or holds several, and its words don't each drag symbols or shouts;
scripts that write no end marks need none), navigation (menus of separators,
arrows, short items and menu words, page counters) and boilerplate (notices that
sites repeat; phrases that prose has too must begin their line or make most of it).  Lines that fail are removed; then a document that has lost more
than MOST_LOST of its word characters, or keeps fewer than LEAST_WORDS words, is
rejected.  Words are maximal runs of characters other than space and \\t \\n \\v
\\f \\r throughout, so other white space is part of a word.  Beside that verdict
stand a few whole-text counts and the base rule on them.  Lines and words are
counted as equal only if their bytes are.

Defined results: null text has no lines; a line without words is neither
judged nor counted as lost; a text without words fails the base rule; equal
rows give equal rows; a text of any length is read whole; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words
from spanloom.llm.shared import tidy

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
MOST_LOST = 0.3
_U = np.uint64

# Symbols, marks, words and phrases of the line rules.
SYMBOLS = "#*$%&|<>"
ENDS = ".!?…。！？｡．؟۔।॥։።:;\"'”’»›)]）】」』"
SEPARATORS = {"|", "||", ">", ">>", "»", "›", "•", "·", "::", "/", "«", "<", "→", "←", "▸", "▶", "■", "◦", "~"}
MENU_WORDS = {
    "home", "homepage", "menu", "login", "logout", "register", "search", "contact", "about", "us", "sitemap", "faq", "help", "next", "previous", "back", "share", "subscribe", "archive", "archives", "categories", "tags", "forum", "blog", "news", "shop", "cart", "checkout", "account", "profile", "settings", "support", "terms", "privacy", "imprint", "print", "top", "more", "all", "page",
    "startseite", "suche", "kontakt", "impressum", "anmelden", "abmelden", "datenschutz", "hilfe", "weiter", "zurück", "warenkorb", "übersicht",
    "accueil", "recherche", "connexion", "panier", "aide", "suivant", "précédent", "mentions", "légales",
    "inicio", "buscar", "contacto", "ayuda", "siguiente", "anterior", "carrito", "cuenta", "acceder",
}
BOILERPLATE = re.compile(
    r"(?i)\b(?:all rights reserved|terms (?:of|and) (?:use|service|conditions)|privacy (?:policy|notice|settings)|cookie (?:policy|settings|notice)|(?:use|uses|using|accept|accepting) (?:all )?cookies|enable (?:javascript|cookies)|javascript is (?:disabled|required|not)|"
    r"sign up (?:for|now|today)|subscribe (?:to our|now|today)|lorem ipsum|powered by|follow us|skip to (?:content|main)|leave a (?:comment|reply)|related (?:posts|articles)|filed under|permalink|unsubscribe|advertisement|sponsored content|"
    r"alle rechte vorbehalten|verwendet cookies|hier klicken|weiterlesen|newsletter abonnieren|tous droits réservés|utilise des cookies|cliquez ici|lire la suite|todos los derechos reservados|utiliza cookies|haga clic|leer más)\b|\{\s*\}|©|\(c\) ?(?:19|20)\d\d"
)
#: Phrases that prose has too: they must begin their line, or be two thirds of its letters.
EVERYDAY = re.compile(r"(?i)\b(?:click here|read (?:more|the full)|continue reading|log in to|share (?:this|on)|add to (?:cart|basket)|back to top|posted (?:by|in|on)|your browser)\b(?!,)")
#: Words one of which each phrase has.
TRIGGERS = {
    "rights", "terms", "privacy", "cookie", "cookies", "javascript", "click", "read", "reading", "sign", "log", "subscribe", "lorem", "powered", "share", "follow", "add", "skip", "back", "leave", "related", "posted", "filed", "permalink", "unsubscribe", "browser", "advertisement", "sponsored",
    "rechte", "klicken", "weiterlesen", "newsletter", "droits", "cliquez", "lire", "derechos", "haga", "leer",
}
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"[{©]|\([cC]\)")
_RUN = re.compile(r"[#*$%&|<>~^_=+]{2}|!!|\?\?")
COUNTER = re.compile(r"(?i)(?:page|seite|página)\s*\d+\s*(?:of|von|sur|de|/)\s*\d+|(?:\d+|\.{2,3}|…)(?:\s+(?:\d+|\.{2,3}|…)){3,}")
_DRAGS = re.compile(r"(?:[#*$%&|<>~^_=+]{2,}|!{2,}|\?{2,})[.,;:]?$")
#: Thai, Lao, Tibetan, Myanmar and Khmer: sentences end with a space, if with anything.
_UNMARKED = re.compile(r"[\u0E00-\u0EFF\u0F00-\u0FFF\u1000-\u109F\u1780-\u17FF]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _everyday(line: str) -> bool:
    """Whether an everyday phrase of notices makes the line one."""
    m = EVERYDAY.search(line)
    if not m:
        return False
    letters = sum(map(len, _LETTERS.findall(line)))
    return not _LETTERS.search(line[: m.start()]) or 3 * sum(map(len, _LETTERS.findall(m[0]))) >= 2 * letters


def line_fails(line: str) -> str | None:
    """The group of rules that a line with words fails, or None."""
    own = _WORD.findall(line)
    separators = 0 if SEPARATORS.isdisjoint(own) else sum(w in SEPARATORS for w in own)
    if separators >= 2 and separators * 10 >= len(own) or COUNTER.fullmatch(line.strip()):
        return "navigation"
    if len(own) <= 8:
        bare = [b for b in (w.strip(".,;:!?()").lower() for w in own) if b]
        if bare and all(b in MENU_WORDS or b in SEPARATORS for b in bare):
            return "navigation"
    if (_SIGNS.search(line) or not TRIGGERS.isdisjoint(_LETTERS.findall(line.lower()))) and (BOILERPLATE.search(line) or _everyday(line)):
        return "boilerplate"
    if _RUN.search(line) and sum(bool(_DRAGS.search(w)) for w in own) * 2 > len(own):
        return "punctuation"
    # A line of several sentences is prose even if its last one is left open; so is one in a script without end marks.
    if own[-1][-1] in ENDS or sum(w[-1] in ".!?…。" for w in own) >= 2:
        return None
    last = own[-1]
    return None if 2 * len(_UNMARKED.findall(last)) > len(last) else "punctuation"


def cleaned(text: str | None) -> str:
    """The text without the lines that fail."""
    return "\n".join(x for x in (text or "").split("\n") if not _WORD.search(x) or line_fails(x) is None)


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    n_rows = len(offsets) - 1
    starts, ends, at = words.spans(data, offsets)
    n = np.diff(at)

    def summed(flags: np.ndarray, where: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[where[1:]] - total[where[:-1]]

    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    out = {"n_words": n, "word_chars": summed(~words.SPACE[data] & (data & 0xC0 != 0x80), offsets), "n_symbols": summed(symbol[data], offsets)}

    # Lines: from a row's start or a line feed to the next one or the row's end.
    feeds = np.flatnonzero(data == 10)
    edges = np.concatenate((offsets[:-1], feeds + 1))
    until = np.concatenate((offsets[1:], feeds))
    line_start, line_end = np.sort(edges), np.sort(until)
    row = np.searchsorted(offsets, line_start, side="right") - 1
    first_word = np.searchsorted(starts, line_start)
    worded = (first_word < len(starts)) & (starts[np.minimum(first_word, max(len(starts) - 1, 0))] < line_end) if len(starts) else np.zeros(len(line_start), bool)
    line, row = words.numbers(data, line_start[worded], line_end[worded]), row[worded]
    order = np.lexsort((line, row))
    again = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order][1:][again], minlength=n_rows)

    # Windows: numbers of two words, then of four and of five; windows found twice in a row cover their words.
    per_row = np.maximum(n - WINDOW + 1, 0)
    row = np.repeat(np.arange(n_rows), per_row)
    first = np.repeat(at[:-1], per_row) + np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    own = words.numbers(data, starts, ends).astype(_U)
    wide = _U(len(own) + 1)
    two = np.unique(own[:-1] * wide + own[1:], return_inverse=True)[1].astype(_U) if len(own) else own
    four = np.unique(two[first] * wide + two[first + 2], return_inverse=True)[1].astype(_U) if len(row) else own[:0]
    key = four * wide + own[first + WINDOW - 1] if len(row) else four
    order = np.lexsort((key, row))
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(row), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    out["n_repeat_words"] = summed(np.cumsum(cover)[:-1] > 0, at)
    return out


def clean_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept, lost (share of word characters removed), removed (lines) and the cleaned text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.utf8(batch.column(1))
            for i, j in words.slices(offsets, 1_000_000):
                base = counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                texts = batch.column(1).slice(i, j - i).to_pylist()
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED_PERCENT * base["n_words"])
                clean = [cleaned(t) for t in texts]
                left = [_WORD.findall(c) for c in clean]
                chars = np.array([sum(map(len, w)) for w in left], np.int64)
                lost = 1 - chars / np.maximum(base["word_chars"], 1)
                lost[base["word_chars"] == 0] = 0
                removed = np.array([(t or "").count("\n") - c.count("\n") for t, c in zip(texts, clean, strict=True)], np.int64)
                kept = ~failed & (lost <= MOST_LOST) & (np.array([len(w) for w in left], np.int64) >= LEAST_WORDS)
                columns = [pa.array(base[k].astype(np.int64)) for k in NAMES]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *columns, pa.array(failed), pa.array(kept), pa.array(lost), pa.array(removed), pa.array(clean, pa.string())],
                    names=["doc_id", *NAMES, "base_failed", "kept", "lost", "removed", "clean_text"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, {', '.join(f'{k} long' for k in NAMES)}, base_failed boolean, kept boolean, lost double, removed long, clean_text string")


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
