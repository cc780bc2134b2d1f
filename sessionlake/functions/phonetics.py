"""Phonetic keys of words: consonants as they sound in English, after marks are folded."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import MARKED, PLAIN

VOWELS = set("aeiou")
_FOLD = str.maketrans(MARKED, PLAIN)
#: First letters that are silent or sound like others, in the order in which they are tried.
OPENINGS = (("ae", "e"), ("gn", "n"), ("kn", "n"), ("pn", "n"), ("wr", "r"), ("wh", "w"), ("x", "s"))


def sound_key(word: str) -> str:
    """The metaphone key of a word, an empty one where nothing sounds.

    Rules by letter, each looking a letter or two around: doubled letters but ``c`` sound once, vowels sound at the start
    only, and silent letters (``gh`` before a consonant, ``b`` after a final ``m``, ``w`` before a consonant) are left out.
    """
    w = "".join(c for c in word.translate(_FOLD).lower() if "a" <= c <= "z")
    for old, new in OPENINGS:
        if w.startswith(old):
            w = new + w[len(old):]
            break
    out: list[str] = []
    k, n = 0, len(w)
    at = lambda i: w[i] if 0 <= i < n else ""
    while k < n:
        c, before, after, then = w[k], at(k - 1), at(k + 1), at(k + 2)
        step, said = 1, ""
        if c == before and c != "c":
            pass
        elif c in VOWELS:
            said = c if k == 0 else ""
        elif c == "b":
            said = "" if before == "m" and not after else "b"
        elif c == "c":
            if after == "i" and then == "a" or after == "h" and before != "s":
                said, step = "x", 2 if after == "h" else 1
            elif after == "h":
                said, step = "k", 2
            elif after in ("i", "e", "y") and after:
                said = "" if before == "s" else "s"
            else:
                said = "k"
        elif c == "d":
            said, step = ("j", 2) if after == "g" and then in ("e", "i", "y") and then else ("t", 1)
        elif c == "g":
            if after == "h":
                said, step = ("k" if then in VOWELS or k == 0 else "f" if not then and before == "u" else ""), 2
            elif after == "n" and (not then or then == "s" and not at(k + 3)):
                said = ""
            elif after in ("i", "e", "y") and after and before != "g":
                said = "j"
            else:
                said = "k"
        elif c == "h":
            said = "h" if after in VOWELS and before not in ("c", "g", "p", "s", "t") else ""
        elif c == "k":
            said = "" if before == "c" else "k"
        elif c == "p":
            said, step = ("f", 2) if after == "h" else ("p", 1)
        elif c == "q":
            said = "k"
        elif c == "s":
            said, step = ("x", 2) if after == "h" else ("x", 1) if after == "i" and then in ("o", "a") and then else ("s", 1)
        elif c == "t":
            if after == "i" and then in ("o", "a") and then:
                said = "x"
            elif after == "h":
                said, step = "0", 2
            else:
                said = "" if after == "c" and then == "h" else "t"
        elif c == "v":
            said = "f"
        elif c in "wy":
            said = c if after in VOWELS else ""
        elif c == "x":
            said = "ks"
        elif c == "z":
            said = "s"
        else:  # f j l m n r
            said = c
        out.append(said)
        k += step
    return "".join(out).upper()


@F.pandas_udf(StringType())
def sound_keys(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else sound_key(w))


def same_sound(a: Column, b: Column) -> Column:
    """Whether two words sound alike: equal keys that are not empty."""
    x, y = sound_keys(a), sound_keys(b)
    return F.coalesce((x == y) & (x != ""), F.lit(False))
