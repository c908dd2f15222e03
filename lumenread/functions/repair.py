"""Repairs of extracted text: composed characters, doubled signs, words that were split."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def single_signs(text: Column, signs: str, stop: str | None = None, letters: str | None = None) -> Column:
    """Composed text in which a doubled sign is one, and blanks before a sign are gone.

    stop is a sign that ends a letter: two of them and a doubled one of letters are one of each, other two are one.
    """
    out = nfc(text)
    if stop is not None:
        out = F.regexp_replace(out, f"{stop}{stop}([{letters}])\\1", f"{stop}$1") if letters else out
        out = F.regexp_replace(out, f"{stop}{stop}", stop)
    out = F.regexp_replace(out, f"([{signs}])\\1+", "$1")
    out = F.regexp_replace(out, f"\\s+([{signs}])", "$1")
    return F.regexp_replace(out, " ", " ")


def merged(words: list[str], known: Iterable[str], longest: int = 4, script: str = r"[^\W\d_]+") -> list[str]:
    """Words with runs of up to longest joined where the whole is known and some part isn't; the longest run first.

    Only words of the script are joined: a mark or a number ends a run.
    """
    word = re.compile(script)
    known = known if isinstance(known, (set, frozenset)) else frozenset(known)
    out, at = [], 0
    while at < len(words):
        for n in range(min(longest, len(words) - at), 1, -1):
            run = words[at: at + n]
            if all(map(word.fullmatch, run)) and "".join(run) in known and any(w not in known for w in run):
                out.append("".join(run))
                at += n
                break
        else:
            out.append(words[at])
            at += 1
    return out


def merge_words(words: Column, lexicon: frozenset[str], longest: int = 4, script: str = r"[^\W\d_]+") -> Column:
    """Column form of merged(); the lexicon travels with the plan, so it has to be a word list of known size."""
    return F.pandas_udf(lambda rows: rows.map(lambda w: merged(list(w), lexicon, longest, script) if w is not None else None), "array<string>")(words)


def has_script(text: Column, first: int, last: int) -> Column:
    """Whether a text has a letter of a script, given by its first and last code point."""
    return text.rlike(f"[\\x{{{first:x}}}-\\x{{{last:x}}}]")


def bare_signs(text: Column) -> Column:
    """Whether a text starts with a combining sign, which no word does."""
    return text.rlike(r"^[\p{Mn}\p{Mc}]")
