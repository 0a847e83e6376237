"""Characters and entities to plain ASCII text."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an HTML entity is written as in plain text.
ENTITY_TEXT = {
    "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"',
    "copy": "(C)", "mdash": "--", "nbsp": " ", "rarr": "->", "larr": "<-", "middot": "*",
    "ndash": "-", "oelig": "oe", "aelig": "ae",
    "agrave": "a", "aacute": "a", "acirc": "a", "atilde": "a", "auml": "a", "aring": "a",
    "egrave": "e", "eacute": "e", "ecirc": "e", "euml": "e",
    "igrave": "i", "iacute": "i", "icirc": "i", "iuml": "i",
    "ograve": "o", "oacute": "o", "ocirc": "o", "otilde": "o", "ouml": "o",
    "ugrave": "u", "uacute": "u", "ucirc": "u", "uuml": "u",
    "lrm": "", "rlm": "",
}
# Characters without an accent to strip, as they are transliterated.
TRANSLITERATED = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D",
    "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "©": "(C)", "®": "(R)", "«": "<<", "»": ">>",
    "—": "--", "–": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "•": "o", "→": "->", "←": "<-",
    "€": "EUR", " ": " ",
}


def _accented() -> tuple[str, str]:
    """Latin letters whose canonical decomposition is an ASCII letter and marks, and those letters."""
    pairs = [(chr(code), unicodedata.normalize("NFD", chr(code))[0]) for code in range(0xC0, 0x250)]
    pairs = [(letter, base) for letter, base in pairs if base.isascii() and base != letter]
    return "".join(letter for letter, _ in pairs), "".join(base for _, base in pairs)


def ascii_fold(text: Column) -> Column:
    """Accented letters and typographic marks as ASCII; whatever is left outside ASCII goes."""
    single = {mark: plain for mark, plain in TRANSLITERATED.items() if len(plain) == 1}
    longer = {mark: plain for mark, plain in TRANSLITERATED.items() if len(plain) != 1}
    letters, bases = _accented()
    folded = F.translate(text, letters + "".join(single), bases + "".join(single.values()))
    folded = reduce(lambda c, mark: F.replace(c, F.lit(mark), F.lit(longer[mark])), longer, folded)
    # most text is ASCII already, and one look tells
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]", "")).otherwise(text)


def _entity_map(names: dict) -> Column:
    """One literal, folded when the query is planned."""
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _character(code: Column) -> Column:
    """Text of one Unicode code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def entity_text(entity: Column) -> Column:
    """Text for one entity such as `&amp;`, `&#8217;` or `&#x2019;` (the semicolon may be missing)."""
    names = {"apos": "'"} | {name: chr(code) for name, code in name2codepoint.items()} | ENTITY_TEXT
    codes = {name2codepoint[name]: plain for name, plain in ENTITY_TEXT.items()}
    name = F.regexp_extract(entity, r"^&([a-zA-Z][-.a-zA-Z0-9]*)", 1)
    hexadecimal = F.regexp_extract(entity, r"^&#[xX]0*([0-9a-fA-F]{1,6});?$", 1)
    decimal = F.regexp_extract(entity, r"^&#0*([0-9]{1,7});?$", 1)
    code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(decimal != "", decimal).cast("int")
    known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    numbered = F.when(known, F.coalesce(_entity_map(codes)[code.cast("string")], _character(code)))
    named = F.coalesce(_entity_map(names)[name], F.concat(F.lit("&"), name, F.lit(";")))
    return F.when(code.isNotNull(), F.coalesce(numbered, entity)).when(name != "", named).otherwise(entity)


def unescape(text: Column) -> Column:
    """Text with all its complete entities replaced."""
    pieces = F.regexp_extract_all(text, F.lit(r"&#?[a-zA-Z0-9]+;|[^&]+|&"), F.lit(0))
    replaced = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^&.+;$"), entity_text(p)).otherwise(p)), "")
    return F.when(text.contains("&"), replaced).otherwise(text)


def visible_text(html: Column) -> Column:
    """Text of a page without tags, scripts and styles, on one line."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(text), r"\s+", " "))
