"""Text functions as column expressions: cleaning, segments, tokens, synonyms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and symbols that cleaning is defined by.
HTML_TAG = "<[^>]+>"
HTML_ENTITY = r"&(?:nbsp|amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);"
DECORATION = "[●○◎◇◆□■△▲▽▼☆★♣♠♥♦►▶◀◄→←↑↓↔⇒⇐⇑⇓※☎✔✖✕✓✗✘⊙⊚⊛⊜⊝]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
PAGE_NUMBER = r"(?im)^\s*(?:-\s*\d+\s*-|\d+\s*/\s*\d+|\[\s*\d+\s*\]|\(\s*\d+\s*\)|페이지\s*\d+|page\s*\d+)\s*$"
URL = r"https?://[^\s]+|www\.[^\s]+"

WIDE = "".join(map(chr, [*range(0xFF01, 0xFF5F), 0x3000]))
NARROW = "".join(map(chr, [*range(0x21, 0x7F), 0x20]))


def nfc(text: Column) -> Column:
    """Unicode composition. Spark has no function for it, so an Arrow UDF does it; ASCII texts, which are composed, stay out of it."""

    @F.pandas_udf("string")
    def compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.coalesce(compose(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def replace_all(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(by))
    return text


def fold_width(text: Column) -> Column:
    """Full-width forms and the ideographic space to ASCII."""
    return F.translate(text, WIDE, NARROW)


def trim_all(text: Column) -> Column:
    return replace_all(text, (r"^\s+|\s+$", ""))


def strip_html(text: Column) -> Column:
    """Tags go, their bodies stay; entities become spaces."""
    return replace_all(text, (HTML_TAG, ""), (HTML_ENTITY, " "))


def clean_document(text: Column, compose: bool = True) -> Column:
    """Cleaning of a document, after Unicode composition."""
    text = nfc(text) if compose else text
    out = strip_html(replace_all(text, (CONTROL, "")))
    out = replace_all(fold_width(out), (DECORATION, ""), (PAGE_NUMBER, ""))
    out = replace_all(out, (r"\.{3,}", "."), ("[-–—]{3,}", "-"), ("_{3,}", ""), (r"[^\S\n]{2,}", " "), (r"\n{3,}", "\n\n"))
    lines = F.transform(F.split(out, r"\r\n|\n|\r", -1), trim_all)
    return trim_all(F.array_join(lines, "\n"))


def clean_query(text: Column, compose: bool = True) -> Column:
    text = nfc(text) if compose else text
    out = fold_width(replace_all(text, (CONTROL, "")))
    return trim_all(replace_all(out, (DECORATION, ""), (r"[^\S\n]{2,}", " ")))


def contains_url(text: Column) -> Column:
    return text.contains("http://") | text.contains("https://") | text.contains("www.")


def strip_urls(text: Column) -> Column:
    return F.btrim(replace_all(text, (URL, ""), (r"\s{2,}", " ")), F.lit(" \t\n\r"))


def segments(text: Column) -> Column:
    """Sentences: lines, trimmed, then cut after . ? or ! before a blank or the end."""
    cut = F.regexp_replace(text, F.lit(r"([.?!])[ \t]+"), F.lit("$1\n"))
    parts = F.transform(F.split(cut, "\n", -1), lambda s: F.btrim(s, F.lit(" \t\r")))
    return F.filter(parts, lambda s: s != "")


def tokens(text: Column) -> Column:
    """Default tokenizer: runs of letters and digits in lower case. Any array<string> column can stand in for it."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def expand_synonyms(words: Column, synonyms: Mapping[str, list[str]]) -> Column:
    """After each token its synonyms, in order."""
    if not synonyms:
        return words
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(table[w], F.array().cast("array<string>")))))


def parse_synonyms(lines: list[str]) -> dict[str, list[str]]:
    """`word<TAB>synonym` lines; # starts a comment; a repeated word gathers synonyms."""
    out: dict[str, list[str]] = {}
    for line in lines:
        word, tab, other = line.strip().partition("\t")
        if tab and not word.startswith("#") and word and other:
            out.setdefault(word, []).append(other)
    return out


def truncate_utf8(text: Column, size: int) -> Column:
    """At most `size` bytes, cut before a character that would not fit whole."""
    raw = F.encode(text, "UTF-8")
    # a character starts after byte k unless the next byte continues one; it has four bytes at most
    ends = [F.when(~F.hex(F.substring(raw, k + 1, 1)).between("80", "BF"), F.substring(raw, 1, k)) for k in range(size, max(-1, size - 4), -1)]
    return F.when(F.octet_length(text) <= size, text).otherwise(F.decode(F.coalesce(*ends), "UTF-8"))


def token_hashes(words: Column) -> Column:
    """Fixed values throughout: a hash that must agree bit for bit with ids stored elsewhere.

    32-bit token ids, for exchange with stores that key terms by number; terms themselves are keyed by string here.
    """

    def rotate(x: int, n: int) -> int:
        return (x << n | x >> (32 - n)) & 0xFFFFFFFF

    def scramble(k: int) -> int:
        return rotate(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF

    def one(word: str) -> int:
        data = word.encode()
        h = 0x9E3779B9 ^ len(data)
        whole = len(data) // 4 * 4
        for i in range(0, whole, 4):
            h = (rotate(h ^ scramble(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        if data[whole:]:
            h ^= scramble(int.from_bytes(data[whole:], "little"))
        h ^= len(data)
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> shift) * by & 0xFFFFFFFF
        h ^= h >> 16
        return h - (1 << 32) if h >> 31 else h

    @F.pandas_udf("array<int>")
    def hashes(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ws: None if ws is None else [one(w) for w in ws])

    return hashes(words)
