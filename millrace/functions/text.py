"""Column functions over text: words, lines, normal forms, scripts, masks.

All are built-in expressions, but for normalize(), whose Unicode composition and
entities have none; it leaves the JVM for the rows that need them only.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Invisible characters that normalize() drops (joiners U+200C, U+200D stay).
NOISE = "​﻿‎‏‪‫‬‭‮⁦⁧⁨⁩�"
#: Control characters that normalize() drops.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
#: Chat-template markers, the rule set for corpora and the one for prose lanes.
GHOST = r"(?i)<\|[a-z_]+\|>|\[/?INST\]|<</?SYS>>|</?s>|###\s*(?:Human|Assistant|System)\s*:|<\|(?:im_start|im_end|endoftext)\|>"
GHOST_PROSE = r"(?i)<\|[a-z_]+\|>|\[/?INST\]|<</?SYS>>|###\s*(?:Human|Assistant|System)\s*:"
#: Personal data, in the order of masking.  Digits and word characters are ASCII ones, which any SQL engine reads alike;
#: digits of other scripts are not masked.
PII = [
    ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("AADHAAR", r"(?<![0-9])[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}(?![0-9])"),
    ("PHONE", r"(?<![0-9])(?:\+?91[\s-]?)?[6-9][0-9]{9}(?![0-9])"),
    ("IP", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
]
#: The English stop words of the quality rules.
STOP_WORDS = ["the", "be", "to", "of", "and", "a", "in", "that", "have", "it", "for", "not", "on", "with"]


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body, and lambdas in it, use it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S"))


def match_form(text: Column) -> Column:
    """Lower case, runs of letters, numbers and _, joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), " ")


def title_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def garbage(text: Column) -> Column:
    """How many invisible and control characters a raw text has."""
    return (F.regexp_count(text, F.lit(f"[{NOISE}]")) + F.regexp_count(text, F.lit(CONTROL))).cast("long")


def composed(texts: pd.Series) -> pd.Series:
    """Composition (NFC), noise and control characters out, entities resolved: in that order."""
    drop = dict.fromkeys(map(ord, NOISE))
    control = re.compile(CONTROL)
    return texts.map(lambda t: None if t is None else html.unescape(control.sub("", unicodedata.normalize("NFC", t).translate(drop))))


def normalize(text: Column, python: bool = True) -> Column:
    """Composed, without invisible and control characters and entities, blanks and newlines collapsed.

    A text without entities, combining marks and other characters that composition can
    change is done by built-in functions alone."""
    plain = F.regexp_replace(F.regexp_replace(text, f"[{NOISE}]", ""), CONTROL, "")
    if python:
        needs = text.rlike(r"&[#A-Za-z]") | text.rlike(r"[̀-ͯऀ-꯿가-￿\x{10000}-\x{10FFFF}]")
        plain = F.when(needs, F.pandas_udf(composed, StringType())(F.when(needs, text))).otherwise(plain)
    squeezed = F.regexp_replace(F.regexp_replace(plain, r"[ \t\xa0]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(squeezed, r"(?U)^\s+|\s+$", "")


def script_ratio(text: Column, block: str) -> Column:
    """The share of a Unicode block's characters among those that are not white space; 0 for none."""
    visible = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.when(visible > 0, F.regexp_count(text, F.lit(block)) / visible).otherwise(F.lit(0.0))


def strip_ghosts(text: Column, pattern: str = GHOST) -> Column:
    return F.regexp_replace(text, pattern, " ")


def masked(text: Column, tags: dict[str, str] | None = None) -> tuple[Column, dict[str, Column]]:
    """The text with personal data masked, and how many spans of each kind were."""
    counts = {}
    for name, pattern in PII:
        counts[name] = F.regexp_count(text, F.lit(pattern)).cast("long")
        text = F.regexp_replace(text, pattern, (tags or {}).get(name, f"<{name}>"))
    return text, counts


@dataclass(frozen=True)
class Quality:
    """Rules of the quality filter, in order; the first that fails names the reason."""

    min_words: int = 20
    max_dup_lines: float = 0.30
    max_symbols: float = 0.10
    word_length: tuple[float, float] = (2.5, 12.0)
    terminal: str = ".?!।॥"
    min_terminal: float = 0.10
    script: str | None = r"\p{InDevanagari}"
    min_script: float = 0.40
    stop_words: tuple[str, ...] = ()
    suffix: str = ""


SCRIPT_AWARE = Quality()
#: The script-aware rules for Latin text.
LATIN = Quality(script=r"\p{IsLatin}")
ENGLISH = Quality(word_length=(3.0, 10.0), terminal=".?!", min_terminal=0.15, script=None, stop_words=tuple(STOP_WORDS), suffix="_en")


def quality_reason(text: Column, q: Quality) -> Column:
    """Why a text fails the rules, or null if it passes."""
    w, ln = words(text), lines(text)
    n, k = F.size(w), F.size(ln)
    letters = F.aggregate(w, F.lit(0), lambda acc, x: acc + F.length(x))
    ends = F.size(F.filter(ln, lambda x: F.regexp_replace(x, r"(?U)\s+$", "").rlike(f"[{q.terminal}]$")))
    mean = letters / n
    rules = [
        (n < q.min_words, "too_short"),
        ((k > 0) & (1 - F.size(F.array_distinct(ln)) / k > q.max_dup_lines), "dup_lines"),
        (F.regexp_count(text, F.lit("[#…]")) / n > q.max_symbols, "symbol_ratio"),
        ((mean < q.word_length[0]) | (mean > q.word_length[1]), "word_len" + q.suffix),
    ]
    if q.stop_words:
        known = F.array(*[F.lit(s) for s in q.stop_words])
        rules.append((F.size(F.array_intersect(F.transform(w, F.lower), known)) < 2, "no_stopwords" + q.suffix))
    rules.append(((k > 0) & (ends / k < q.min_terminal), "no_terminal_punct" + q.suffix))
    if q.script:
        rules.append((script_ratio(text, q.script) < q.min_script, "low_script"))
    reason = F.when(rules[0][0], rules[0][1])
    for test, name in rules[1:]:
        reason = reason.when(test, name)
    return reason
