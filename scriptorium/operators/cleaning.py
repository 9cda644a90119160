"""Cleaning of OCR text: gutters, noise lines, paragraphs and words split across lines.

A document is cleaned inside its own row, by Arrow's compute functions over the lines of a batch; nothing is shuffled.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS, WS_IN_LINE, col, let, strip, tokens
from ..session import ship

#: Shortest word, length from which a line is trusted.
SHORTEST_WORD, LONG_LINE = 3, 30
#: Stands behind a continuation line, whose end keeps its spaces; a code point that Unicode reserves for such use.
_KEEP = "﷐"
_BROKEN = rf"([A-Za-z])-[{WS_IN_LINE}]*\n[{WS_IN_LINE}]*(\p{{Ll}}[^\n]*)"


def is_noise(line: Column | str) -> Column:
    """Whether a line is no text: too short, without a word, of scraps, or of signs. Blank lines are not noise."""
    s = strip(line)

    def judged(s: Column) -> Column:
        # the branches are asked in order, so scraps are listed for short lines only
        scraps = F.regexp_extract_all(s, F.lit("[A-Za-z]+"), 0)
        short = F.size(F.filter(scraps, lambda w: F.length(w) <= 2))
        known = F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))
        return (
            F.when(s == "", False).when(F.length(s) < SHORTEST_WORD, True).when(F.length(s) >= LONG_LINE, False)
            .when(~s.rlike(f"[A-Za-z]{{{SHORTEST_WORD},}}"), True).when(5 * short > 3 * F.size(scraps), True)
            .otherwise(5 * known < 2 * F.length(s))
        )

    return let(s, judged)


def strip_gutter(line: Column | str) -> Column:
    """A line without column rules and white space at its start."""
    return F.regexp_replace(F.regexp_replace(col(line), rf"\A[{WS}_|~]+", ""), r"\A- ([A-Za-z])", "$1")


#: The characters of WS, for trims that take them one by one.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_CLEANED = "clean_text string, original_lines int, noise_removed int, artifacts_stripped int, hyphens_resolved int, output_paragraphs int"
#: Bytes of text that are cleaned at once.
_AT_ONCE = 4 << 20


def _noise(s: pa.Array) -> pa.Array:
    """is_noise of stripped lines, in Arrow."""
    size = pc.utf8_length(s)
    short = pc.and_(pc.greater_equal(size, SHORTEST_WORD), pc.less(size, LONG_LINE))
    t, length = s.filter(short), size.filter(short)
    scraps, words = pc.count_substring_regex(t, "[A-Za-z]+"), pc.count_substring_regex(t, f"[A-Za-z]{{{SHORTEST_WORD},}}")
    known = pc.utf8_length(pc.replace_substring_regex(t, r"[^\p{L}\p{N}]+", ""))
    scrappy = pc.greater(pc.multiply(5, pc.subtract(scraps, words)), pc.multiply(3, scraps))
    bad = pc.or_(pc.or_(pc.equal(words, 0), scrappy), pc.less(pc.multiply(5, known), pc.multiply(2, length)))
    return pc.replace_with_mask(pc.and_(pc.greater(size, 0), pc.less(size, SHORTEST_WORD)), short, bad)


def _clean(texts: pa.Array) -> pa.Array:
    """Clean text and counters of texts: all lines of all texts at once, by Arrow's compute functions."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    starts = np.concatenate(([0], ends))[:-1]
    cut = pc.replace_substring_regex(pc.utf8_ltrim(lines, _SPACES + "_|~"), r"\A- ([A-Za-z])", r"\1")
    full, s = pc.not_equal(pc.utf8_trim(lines, _SPACES), ""), pc.utf8_trim(cut, _SPACES)
    noise = _noise(s)
    kept = pc.if_else(pc.or_(noise, pc.equal(s, "")), "", cut)

    def total(flags: pa.Array) -> pa.Array:
        return pa.array(np.add.reduceat(flags.to_numpy(zero_copy_only=False).astype("int32"), starts), pa.int32())

    def joined(parts: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), parts), by)

    whole = pc.replace_substring_regex(joined(kept, ends, "\n"), _BROKEN, rf"\1\2{_KEEP}")
    whole = pc.replace_substring(pc.replace_substring_regex(whole, rf"[{WS_IN_LINE}]+(\n|\z)", r"\1"), _KEEP, "")
    blocks = pc.split_pattern_regex(whole, "\n\n+")
    parts, of = blocks.flatten(), pc.list_parent_indices(blocks)
    some = pc.not_equal(pc.utf8_trim(parts, _SPACES), "")
    paragraphs = np.bincount(of.filter(some).to_numpy(), minlength=len(texts))
    clean_text = joined(pc.replace_substring(pc.utf8_trim(parts.filter(some), "\n"), "\n", " "), np.cumsum(paragraphs), "\n\n")
    hyphens = pc.match_substring_regex(kept, rf"[A-Za-z]-[{WS}]*\z")
    counters = [pa.array(ends - starts, pa.int32()), total(noise), total(pc.and_(full, pc.not_equal(cut, lines))), total(hyphens), pa.array(paragraphs, pa.int32())]
    return pa.StructArray.from_arrays([clean_text, *counters], names=[c.split()[0] for c in _CLEANED.split(", ")])


def _clean_batch(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    piece = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype="int64") // _AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)] if len(texts) else [0]
    found = [_clean(texts.slice(x, y - x)) for x, y in pairwise(cuts)]
    kind = pa.struct([(c.split()[0], pa.string() if c.endswith("string") else pa.int32()) for c in _CLEANED.split(", ")])
    return pa.concat_arrays(found) if found else pa.array([], kind)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with clean_text and stats: original_lines, noise_removed, artifacts_stripped, hyphens_resolved, output_paragraphs.

    Null text counts as empty. hyphens_resolved counts every line of a paragraph that ends in a hyphen behind a
    letter, joined or not.
    """
    ship(docs.sparkSession)
    rows = docs.withColumn("__cleaned", F.arrow_udf(_clean_batch, _CLEANED)(F.make_valid_utf8(F.col(text))))
    stats = F.struct(*(F.col(f"__cleaned.{c.split()[0]}") for c in _CLEANED.split(", ")[1:]))
    return rows.withColumn("clean_text", F.col("__cleaned.clean_text")).withColumn("stats", stats).drop("__cleaned")


# Ligatures and what they stand for.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}


def repair(text: Column | str) -> Column:
    """Ligatures spelt out, runs of spaces made one, lines of signs alone dropped, at most two line breaks in a row."""
    out = col(text)
    for sign, letters in LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    out = F.regexp_replace(out, "[ \t]{2,}", " ")
    out = F.array_join(F.filter(F.split(out, "\n", -1), lambda x: ~x.rlike(r"\A[ \t]*[!-/:-@\[-`{-~]+[ \t]*\z")), "\n")
    return F.regexp_replace(out, "\n{3,}", "\n\n")


def _counted(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    dense = pc.replace_substring_regex(texts, f"[{WS}]+", "")
    counts = [pc.count_substring_regex(texts, f"[^{WS}]+"), pc.utf8_length(pc.replace_substring_regex(dense, r"\P{L}+", "")), pc.utf8_length(dense)]
    return pa.StructArray.from_arrays([c.cast(pa.int32()) for c in counts], names=["words", "letters", "signs"])


def quality(text: Column | str) -> Column:
    """words, letters, signs (without white space) and letters of words, from which the gates below are drawn."""
    ship(SparkSession.active())
    return F.arrow_udf(_counted, "words int, letters int, signs int")(F.make_valid_utf8(col(text)))


def page_ok(text: Column | str, words: int = 15, share: float = 0.45, mean: float = 2.0, counted: Column | None = None) -> Column:
    """Whether a page's OCR is usable: enough words, mostly letters, words of two characters on average. counted: the text's quality, where a query has it already."""
    return let(quality(text) if counted is None else counted, lambda q: (q["words"] >= words) & (q["signs"] > 0) & (q["letters"] >= share * q["signs"]) & (q["signs"] >= mean * q["words"]))


def document_ok(text: Column | str, words: int = 100, share: float = 0.40, counted: Column | None = None) -> Column:
    """ok and reason for the OCR of a whole document. counted: the text's quality, where a query has it already."""

    def judged(q: Column) -> Column:
        part = q["letters"] / F.nullif(q["signs"], F.lit(0))
        ratio = F.format_string("%.2f", F.coalesce(part, F.lit(0.0)))
        few = q["words"] < words
        return F.struct(
            (~few & (q["signs"] > 0) & F.coalesce(part >= share, F.lit(False))).alias("ok"),
            F.when(few, F.format_string(f"too few words (%d < {words})", q["words"])).when(q["signs"] == 0, "no non-whitespace content")
            .when(part < share, F.concat(F.lit("alpha ratio too low ("), ratio, F.lit(f" < {share})"))).otherwise(F.concat(F.format_string("%,d", q["words"]), F.lit(" words, alpha="), ratio)).alias("reason"),
        )

    return let(quality(text) if counted is None else counted, judged)


def is_scan(text: Column | str, least: int = 100) -> Column:
    """Whether extracted text is so short that the file must be a scan."""
    dense = F.coalesce(col(text), F.lit(""))
    for c in " \n\t":
        dense = F.replace(dense, F.lit(c), F.lit(""))
    return F.length(dense) < least
