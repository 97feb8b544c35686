"""Tokens, terms and sizes of texts, as column expressions; the same rules in Python for task strings."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
STOP_WORDS = tuple("a an the is are to of for in on and or how change fix add implement with when should from".split())
WORD_STOP_WORDS = (*STOP_WORDS, "behavior", "code")
FILLER_WORDS = tuple(
    (
        "where what which why does work works used use using uses code function functions file files call calls called "
        "handle handled handles handling this that there here into about also then than them they have has been being make makes made would could "
        "need needs find show get gets set sets new old all any each every only some same other like more most less not but can will its our your "
        "their via per out over under after before during while whether exist exists existing case cases logic behavior behaviour flow path value "
        "values data type types option options change changes fix add implement implemented support supported check checks checked repository "
        "project structure part parts way ways thing things happen happens when should from with the and for are how "
        "slow fast come comes goes going right wrong properly correctly actually really still just even instead again done doing "
        "there know want look looks seem seems right same better worse good bad"
    ).split()
)
TEST_FILE = r"(?i)(?:^|[/.])(?:__tests__|test|tests|spec)(?:[/.]|$)|\.(?:test|spec)\.[cm]?[jt]sx?$"
SOURCE_FILE = r"\.(?:[cm]?[jt]sx?|vue)$"
MARKUP_FILE = r"(?i)\.html?$"
DECLARATION_FILE = r"\.d\.[cm]?ts$"
SKIPPED_LINE = r"^(?:\/\/|\/\*|\*|<!--|import\b|export\s*\{|\}?\s*from\s)"
LINE_CHARS, LINE_KEPT, FILE_LINES = 400, 200, 3000

_TOKEN = r"([\p{L}\p{N}]+)"


def spaced(text: Column) -> Column:
    """A camel-case border becomes a space."""
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; camel case, _ and - part words."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(spaced(text), "[_-]+", " ")), F.lit(_TOKEN), F.lit(1))


def without(words: Column, stop: tuple[str, ...]) -> Column:
    gone = F.array(*map(F.lit, stop))
    return F.filter(words, lambda w: ~F.array_contains(gone, w))


def task_tokens(text: Column) -> Column:
    """Different tokens of two characters or more that aren't stop words, in order."""
    return F.array_distinct(F.filter(without(tokens(text), STOP_WORDS), lambda w: F.length(w) > 1))


def keyword_terms(text: Column) -> Column:
    """Different ASCII words over two letters that say something, in order."""
    plain = F.filter(tokens(text), lambda w: (F.length(w) > 2) & w.rlike("^[a-z][a-z0-9]*$"))
    return F.array_distinct(without(plain, (*STOP_WORDS, *FILLER_WORDS)))


def split_tokens(text: str) -> list[str]:
    """``tokens`` for one string on the driver."""
    return regex.findall(r"[\p{L}\p{N}]+", re.sub(r"[_-]+", " ", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)).lower())


def query_terms(task: str) -> list[str]:
    return list(dict.fromkeys(t for t in split_tokens(task) if t not in STOP_WORDS))


def keywords_of(task: str) -> list[str]:
    gone = {*STOP_WORDS, *FILLER_WORDS}
    return list(dict.fromkeys(t for t in split_tokens(task) if len(t) > 2 and re.fullmatch(r"[a-z][a-z0-9]*", t) and t not in gone))


def words_of(task: str) -> list[str]:
    """Words of a task for ranking callers: camel case parts only, with the longer stop list."""
    found = regex.findall(r"[\p{L}\p{N}]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", task).lower())
    return list(dict.fromkeys(w for w in found if len(w) > 1 and w not in WORD_STOP_WORDS))


def matches_term(token: Column, term: Column) -> Column:
    """The same, or begun by a term of four letters or more."""
    return (token == term) | ((F.length(term) >= 4) & F.startswith(token, term))


def estimate(text: Column) -> Column:
    """Tokens of a text: a quarter of its characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def clip(text: Column, most: int = 48) -> Column:
    one_line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one_line) > most, F.concat(F.substring(one_line, 1, most), F.lit("…"))).otherwise(one_line)


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def directory_of(path: Column) -> Column:
    """Everything before the last slash; '.' for none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def normal_identifier(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def kept_line(line: Column) -> Column:
    """Whether a trimmed line is worth keeping for keyword search."""
    return (F.length(line) > 0) & (F.length(line) <= LINE_CHARS) & ~line.rlike(SKIPPED_LINE)
