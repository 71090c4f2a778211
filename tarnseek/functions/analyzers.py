"""Text analyzers: text → tokens, as native column expressions.

An analyzer splits text into words along Unicode word boundaries, optionally
lower-cases them, chops over-long ones and blanks out stop words. The result is
an array with one slot per word; a stop word leaves a NULL slot, so positions
keep their gaps and phrases can be matched on the array.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, SparkSession, functions as F

from tarnseek.errors import TarnseekError
from tarnseek.functions.columns import let

# --- fixed values -----------------------------------------------------------
ENGLISH_STOP_WORDS = tuple(
    "a an and are as at be but by for if in into is it no not of on or such "
    "that the their then there these they this to was will with".split()
)
MAX_TOKEN_LENGTH = 255

# Scripts written without blanks: a Han or Hiragana character is a word of its
# own; Katakana and South-East Asian letters form runs. Such pieces are set off
# by blanks before words are extracted.
_UNSPACED = (
    r"\p{IsHan}\p{M}*+|\p{IsHiragana}\p{M}*+|[\p{IsKatakana}ー]++"
    r"|[\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}]++"
)
# Block ranges that hold all of them; a test that spares most texts the rewrite, itself spared by one range that is cheap to test.
_MAYBE_UNSPACED = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\uffff\x{10000}-\x{3ffff}]"
_BEYOND = r"[\u0e00-\x{10ffff}]"

# Unicode word boundaries for the rest: letters may be joined by one of . : ' ’ ·
# and digits by one of . , ; ' ’; letters, digits and low lines stick together.
# What follows may be empty, so these runs never give back; written greedy, Java takes them in a tight loop.
_LETTERS = r"\p{L}[\p{L}\p{M}]*"
_DIGITS = r"\p{Nd}[\p{Nd}\p{M}]*"
_PIECE = rf"{_LETTERS}(?:[.:'’·]{_LETTERS})*+|{_DIGITS}(?:[.,;'’]{_DIGITS})*+"
WORD_PATTERN = rf"(?<!_)_*+(?:{_PIECE})(?:{_PIECE}|_)*+"


def words(text: Column, lowercase: bool, max_length: int = MAX_TOKEN_LENGTH) -> Column:
    """All words of a text in order, stop words included."""
    folded = F.lower(text) if lowercase else text
    # Letters of these scripts have no case, so the text is tested as it is.
    unspaced = text.rlike(_BEYOND) & text.rlike(_MAYBE_UNSPACED)
    spaced = F.when(unspaced, F.regexp_replace(folded, f"({_UNSPACED})", " $1 ")).otherwise(folded)
    found = F.regexp_extract_all(spaced, F.lit(WORD_PATTERN), F.lit(0))

    def chop(ws: Column) -> Column:
        pieces = F.transform(
            ws, lambda w: F.regexp_extract_all(w, F.lit(f"(?s).{{1,{max_length}}}"), F.lit(0))
        )
        too_long = F.exists(ws, lambda w: F.octet_length(w) > max_length)
        return F.when(too_long, F.flatten(pieces)).otherwise(ws)

    return let(found, chop)


class Tokenizing:
    """What analyzers of any kind share: tokens and query literals come from the same slots."""

    #: Each token stands in the folded text as it is, so a plain test of the text can come first.
    stands_in_text = True

    def slots(self, text: Column) -> Column:
        """One array slot per word; NULL where there is no token."""
        raise NotImplementedError

    def tokens(self, text: Column) -> Column:
        """The tokens in order."""
        return F.filter(self.slots(text), lambda w: w.isNotNull())

    def fold(self, text: Column) -> Column:
        return text

    def analyze_literal(self, spark: SparkSession, text: str) -> list[tuple[int, str]]:
        """(position, token) of a query literal, by the same expression as table text."""
        if (self, text) not in _literals:
            row = spark.sql("SELECT 1").select(self.slots(F.lit(text)).alias("slots")).first()
            if len(_literals) >= _KEPT_LITERALS:
                _literals.clear()
            _literals[self, text] = [(i, w) for i, w in enumerate(row["slots"]) if w is not None]
        return list(_literals[self, text])

    def to_dict(self) -> dict:
        raise NotImplementedError


@dataclass(frozen=True)
class Pipeline(Tokenizing):
    """An analyzer of one's own: any native expression from a text to an array of tokens, NULL where a word has none.

    Its tokens needn't stand in the text, so texts aren't sifted before they are tokenised. A table keeps the
    name, under which the pipeline must be registered in every session that opens the table; so give a changed one a name of its own.
    """

    name: str
    function: Callable[[Column], Column]
    stands_in_text = False

    def slots(self, text: Column) -> Column:
        return self.function(text)

    def to_dict(self) -> dict:
        return {"pipeline": self.name}


@dataclass(frozen=True)
class Analyzer(Tokenizing):
    """``name`` is for people; the other values are what a table keeps."""

    name: str
    lowercase: bool = True
    stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS
    max_token_length: int = MAX_TOKEN_LENGTH

    def slots(self, text: Column) -> Column:
        """One array slot per word; NULL where a stop word stood."""
        found = words(text, self.lowercase, self.max_token_length)
        if not self.stop_words:
            return found
        stop = list(self.stop_words)
        return F.transform(found, lambda w: F.when(~w.isin(stop), w))

    def tokens(self, text: Column) -> Column:
        """The words that are not stop words, in order."""
        found = words(text, self.lowercase, self.max_token_length)
        if not self.stop_words:
            return found
        stop = list(self.stop_words)
        return F.filter(found, lambda w: ~w.isin(stop))

    def fold(self, text: Column) -> Column:
        return F.lower(text) if self.lowercase else text

    def with_stop_words(self, stop_words: Iterable[str]) -> Analyzer:
        return replace(self, name=f"{self.name}+stop", stop_words=tuple(sorted(set(stop_words))))

    def to_dict(self) -> dict:
        return {**vars(self), "stop_words": list(self.stop_words)}

    @staticmethod
    def from_dict(raw: dict) -> Tokenizing:
        if "pipeline" in raw:
            return analyzer_named(raw["pipeline"])
        return Analyzer(**{**raw, "stop_words": tuple(raw["stop_words"])})


# Analysed query literals, so that building one query doesn't analyse them repeatedly.
_literals: dict[tuple[Tokenizing, str], list[tuple[int, str]]] = {}
_KEPT_LITERALS = 1_000

STANDARD = Analyzer("standard")
CASE_PRESERVING = Analyzer("case_preserving", lowercase=False)

def _unaccented() -> tuple[str, str]:
    """Latin letters with accents that can be taken off, and the letters without them."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250))]
    pairs = [(c, base) for c, base in pairs if base != c and base.isascii()]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


def without_accents(text: Column) -> Column:
    """Latin letters without their accents, whether these are part of the letter or follow it."""
    plain = F.regexp_replace(F.translate(text, *_unaccented()), "[\u0300-\u036f]", "")
    return F.when(F.char_length(text) == F.octet_length(text), text).otherwise(plain)


FOLDED = Pipeline("folded", lambda text: STANDARD.slots(without_accents(text)))

_registry: dict[str, Tokenizing] = {}


def register_analyzer(name: str, analyzer: Tokenizing | Callable[[Column], Column]) -> None:
    """Make an analyzer, or a function from text to tokens (see ``Pipeline``), known by a case-insensitive name.

    Tables copy the analyzer's values when created, so a later change of the
    name touches only tables created after it.
    """
    if not isinstance(analyzer, Tokenizing):
        analyzer = Pipeline(name.lower(), analyzer)
    _registry[name.lower()] = analyzer


def analyzer_named(name: str) -> Tokenizing:
    try:
        return _registry[name.lower()]
    except KeyError:
        raise TarnseekError(f"analyzer[{name}] is not registered") from None


def reset_analyzers() -> None:
    _registry.clear()
    register_analyzer("standard", STANDARD)
    register_analyzer("case_preserving", CASE_PRESERVING)
    register_analyzer("folded", FOLDED)


reset_analyzers()


def stop_words_from_lines(lines: Iterable[str]) -> tuple[str, ...]:
    """Stop words of a word list: one per line, blank lines skipped."""
    return tuple(w for w in (line.strip() for line in lines) if w)

