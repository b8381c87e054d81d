"""English stems by the published suffix rules of 1980, as an Arrow function with a bounded memory of words met."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The endings of the second to fourth step and what they become where enough of the word is left before them.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
MEMORY = 200_000


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    """The longest ending that the word has is swapped if ``least`` or more is left before it."""
    found = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if found and _measure(word[: -len(found[0])]) >= least:
        return word[: -len(found[0])] + found[1]
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and those with other characters than a to z, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for ending, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            word = word[: -len(ending)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for ending in ("ed", "ing"):
            if word.endswith(ending):
                rest = word[: -len(ending)]
                if "v" in _shape(rest):
                    if rest.endswith(("at", "bl", "iz")):
                        rest += "e"
                    elif _doubled(rest) and rest[-1] not in "lsz":
                        rest = rest[:-1]
                    elif _measure(rest) == 1 and _short(rest):
                        rest += "e"
                    word = rest
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2, 1), STEP_3, 1)
    ending = max((e for e in STEP_4 if word.endswith(e)), key=len, default="")
    rest = word[: len(word) - len(ending)]
    if ending and _measure(rest) > 1 and (ending != "ion" or rest[-1:] in ("s", "t")):
        word = rest
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


class Stems(dict):
    """Stems of the words met; emptied when there are MEMORY of them."""

    def __missing__(self, word: str) -> str:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = porter(word)
        return out


def stems(words: Column) -> Column:
    """An array of words as their stems; null stays null."""
    known = Stems()

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda ws: None if ws is None else [None if w is None else known[w] for w in ws])

    return F.pandas_udf(run, "array<string>")(words)
