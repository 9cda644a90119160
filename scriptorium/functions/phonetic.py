"""A four-place sound code in which vowels, H and W all part equal codes, and the block keys made of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, tokens

# The code of each letter from A to Z.
CODES = "01230120022455012623010202"


def soundex(c: Column | str) -> Column:
    """The code of a word's ASCII letters; 0000 where it has none."""
    letters = F.upper(F.regexp_replace(col(c), "[^A-Za-z]", ""))
    coded = F.regexp_replace(F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", CODES), r"(.)\1+", "$1")
    rest = F.replace(F.substr(coded, F.lit(2)), F.lit("0"), F.lit(""))
    return F.when(letters == "", "0000").otherwise(F.rpad(F.concat(F.substr(letters, F.lit(1), F.lit(1)), rest), 4, "0"))


def block_keys(norm: Column | str, kind: str) -> Column:
    """Distinct block keys of a comparison form: the first initial with the sound of the last word (people) or the
    first (places), and of the second word where there are three or more. X_0000 for a blank form."""
    if kind not in ("people", "places"):
        raise ValueError("kind is people or places")

    def keys(words: Column) -> Column:
        initial = F.upper(F.substr(words[0], F.lit(1), F.lit(1)))
        main = F.concat(initial, F.lit("_"), soundex(F.element_at(words, -1) if kind == "people" else words[0]))
        second = F.when(F.size(words) >= 3, F.concat(initial, F.lit("_"), soundex(F.get(words, F.lit(1)))))
        return F.array_distinct(F.array_compact(F.array(main, second)))

    return let(tokens(norm), lambda w: F.when(F.size(w) == 0, F.array(F.lit("X_0000"))).otherwise(keys(F.when(F.size(w) > 0, w))))
