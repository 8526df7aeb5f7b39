"""Text as columns: cleaning, accents, tokens, n-grams, sentences.

All but the Unicode normal form are JVM expressions. ``nfc`` and ``strip_accents`` go
through Arrow, as Spark has no normal forms.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Interface lines, characters and patterns of the cleaning rules.
BOILERPLATE_LINES = (
    "tải về", "tải xuống", "xem chi tiết", "xem thêm", "thu gọn", "in", "in trang", "chia sẻ", "đóng", "quay lại", "nộp hồ sơ", "nộp trực tuyến", "đăng nhập",
    "trang chủ", "hướng dẫn", "lượt xem", "mẫu đơn, tờ khai", "không có thông tin",
)
ZERO_WIDTH = r"[​‌‍⁠﻿]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
ODD_SPACES = r"[ \t   ]{2,}|[\t   ]"
SPACE_BEFORE_PUNCT = r"\s+([,.;:!?)])"
BULLET = r"^\s*(?:[•●▪◦·–—*+]|-(?!\d))\s*"
WORD = r"[\p{L}\p{N}_]+"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


_TONES = "̣̀́̃̉"


def _move_tones(t: str | None) -> str | None:
    if t is None or t.isascii():
        return t
    s = list(unicodedata.normalize("NFD", t))
    for i in range(len(s) - 2):
        pair = (s[i] + s[i + 1]).lower()
        open_end = i + 3 >= len(s) or not (s[i + 3].isalnum() or s[i + 3] == "_" or "̀" <= s[i + 3] <= "ͯ")
        if pair in ("oa", "oe", "uy") and s[i + 2] in _TONES and open_end and not (i and s[i - 1] in "qQ"):
            s[i + 1], s[i + 2] = s[i + 2], s[i + 1]
    return unicodedata.normalize("NFC", "".join(s))


@F.pandas_udf(StringType())
def normalize_tone(text: pd.Series) -> pd.Series:
    """NFC, with the tone mark of an open syllable oa, oe, uy on its first vowel."""
    return text.map(_move_tones)


@F.pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Lower case without marks; đ becomes d."""

    def plain(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t if t is None else t.lower()
        d = unicodedata.normalize("NFD", _move_tones(t).lower().replace("đ", "d"))
        return unicodedata.normalize("NFC", "".join(c for c in d if not unicodedata.combining(c)))

    return text.map(plain)


#: Latin letters with marks that strip_latin folds, and what they become.
_FOLDED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(unicodedata.normalize("NFD", chr(c))) > 1]


def strip_latin(text: Column) -> Column:
    """The same in the JVM for NFC text of Latin letters: one translate."""
    lowered = F.translate(F.lower(text), "".join(a for a, _ in _FOLDED), "".join(b for _, b in _FOLDED))
    return F.translate(F.lower(lowered), "đ", "d")


#: Letters with one of the five tones: without it, and which it is.
_TONED = [(chr(c), unicodedata.normalize("NFC", "".join(x for x in d if x not in _TONES)), tone) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] for d in [unicodedata.normalize("NFD", chr(c))] for tone in [next((x for x in d if x in _TONES), "")] if tone]


def without_tone(word: Column) -> Column:
    """An NFC word without its tones; other marks are part of its letters."""
    return F.translate(word, "".join(a for a, _, _ in _TONED), "".join(b for _, b, _ in _TONED))


def tone(word: Column) -> Column:
    """The tones of an NFC word, in order, as their marks."""
    letters = "".join(a for a, _, _ in _TONED)
    return F.translate(F.regexp_replace(word, f"[^{letters}]", ""), letters, "".join(t for _, _, t in _TONED))


def has_diacritics(text: Column) -> Column:
    return strip_latin(text) != F.lower(text)


#: The cleaning rules in their order, each on the text as the one before left it: (name, pattern, replacement).
RULES = (
    ("zero_width_char", ZERO_WIDTH, ""),
    ("control_char", CONTROL, " "),
    ("collapse_space", ODD_SPACES, " "),
    ("space_before_punct", SPACE_BEFORE_PUNCT, "$1"),
    ("bullet_to_dash", BULLET, "- "),
)


def normalize_line(line: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The cleaning rules on an NFC line; a null stays null."""
    for name, pattern, by in rules:
        line = F.trim(line) if name == "space_before_punct" else line
        line = F.regexp_replace(line, pattern, by)
    return line


def rule_hits(line: Column) -> list[Column]:
    """How often each rule applies to the line, by name."""
    out = []
    for name, pattern, by in RULES:
        line = F.trim(line) if name == "space_before_punct" else line
        out.append(F.regexp_count(line, F.lit(pattern)).cast("bigint").alias(name))
        line = F.regexp_replace(line, pattern, by)
    return out


def clean_query(question: Column) -> Column:
    return normalize_line(F.coalesce(question, F.lit("")))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def syllables(text: Column) -> Column:
    return tokens(strip_latin(clean_query(text)))


def count_syllables(text: Column) -> Column:
    return F.size(tokens(text))


def content(words: Column, stop: tuple[str, ...]) -> Column:
    """Words that are no stop words, no numbers and longer than one character."""
    listed = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    return F.filter(words, lambda w: ~F.array_contains(listed, w) & ~w.rlike(r"^\d+$") & (F.length(w) > 1))


def _run_of(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def ngrams(words: Column, least: int = 1, most: int = 2) -> Column:
    """Runs of least to most words, joined by a space."""
    parts = []
    for n in range(least, most + 1):
        last = F.size(words) - n + 1
        if n == 1:
            runs = words
        elif n == 2:
            runs = F.zip_with(F.slice(words, 1, last), F.slice(words, 2, last), lambda a, b: F.concat(a, F.lit(" "), b))
        else:
            runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), _run_of(words, n))
        parts.append(F.when(last >= 1, runs).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def lines(text: Column) -> Column:
    """Lines that are not blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.;:])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^\w.-]+", "_"), r"^_+|_+$", "")


def expand_words(text: Column, table: dict[str, str]) -> Column:
    """Each word that is a key of the table, in any case, replaced by its value."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    pieces = F.regexp_extract_all(text, F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}_]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda w: F.coalesce(F.try_element_at(pairs, F.lower(w)), w)), "")


def dice(a: Column, b: Column) -> Column:
    """Twice the common share of two token sets; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    sizes = F.size(x) + F.size(y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / sizes)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def short_error(message: Column, most: int = 200) -> Column:
    return F.left(F.substring_index(message, "\n", 1), F.lit(most))


def leading_digit(answer: Column) -> Column:
    return F.substring(answer, 1, 1).try_cast("int")


def clean_cell(cell: Column) -> Column:
    """Trimmed text of a spreadsheet cell; null is empty, and a whole float loses its .0."""
    return F.regexp_replace(F.trim(F.coalesce(cell.cast("string"), F.lit(""))), r"\.0$", "")


def content_hash(text: Column) -> Column:
    """SHA-256 after line ends became line feeds."""
    return F.sha2(F.regexp_replace(text, "\r\n", "\n"), 256)


def half_away(x: Column, digits: int) -> Column:
    """x >= 0 rounded as doubles are by C and SQL engines written in it: times a power of ten, halves up. Spark's round() goes by the shortest decimal, so halves may differ."""
    y = x * float(10**digits)
    return (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / float(10**digits)


def fixed(x: Column, digits: int, missing: str = "–") -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(missing)).otherwise(F.format_number(x, digits))
