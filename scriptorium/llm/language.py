"""Language identification with hyperdimensional profiles.

Each letter, of any script, has a random vector of DIMENSIONS signs that follows from its code point. A trigram's
vector binds its letters' vectors, permuted by place (rotated two, one and no steps) and multiplied; a text's vector
bundles (sums) those of its trigrams, and a language's prototype those of its labelled texts. A text gets the language
whose prototype has the largest cosine with it. Dot products distribute over the bundle, so a worker computes each
trigram's product with every prototype once and a text's cosines are sums over its trigrams; the text's own norm is
the same for all languages and cancels.

Letters are lower-cased. Runs of anything else are a boundary symbol, and no trigram has it in the middle.

How well a text fits its language is told by its likeness: the mean product of its trigrams over that of the
language's own trigrams, which is the prototype's norm over their number. It is about 1 for a text of the language,
of any length and however many languages there are, and close to 0 for letters at random.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS, SEED = 4096, 20240229
UNDETERMINED = "und"
#: A pipeline rejects a document whose likeness is below LEAST_LIKENESS by more than SURE standard errors. Those of
#: sf0.1 with more than 30 characters have 0.40 and more; code and languages not learned from had 0.21 and less.
LEAST_LIKENESS, SURE = 0.3, 3.0
#: Bytes of trigram products, and letters' vectors, that a worker remembers; it then forgets them all and goes on.
REMEMBERED, LETTERS = 64 << 20, 4096
_AT_ONCE, _ROWS, _MOST_COUNTED = 1 << 20, 1 << 14, 1 << 18
_letter: np.ndarray | None = None
_vectors_of: dict[int, dict[int, np.ndarray]] = {}


class Model(NamedTuple):
    """Languages in order, their prototypes (rows, of unit length) and the mean product of each one's own trigrams with its prototype."""

    langs: list[str]
    prototypes: np.ndarray
    usual: np.ndarray


def _letters() -> np.ndarray:
    """Whether a code point is a letter; made once in a process."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), np.bool_, 0x110000)
    return _letter


def _trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trigram codes (21 bits a symbol, 0 the boundary) and the places in texts that they come from, for some texts or a piece of a long one at a time."""
    letter = _letters()

    def codes(parts: list[np.ndarray], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        cps = np.concatenate(parts)
        sym = np.where(letter[cps], cps, 0).astype(np.int64)
        own = np.repeat(np.array(at), [len(p) for p in parts])
        keep = sym != 0
        keep[1:] |= sym[:-1] != 0
        keep[:1] = True  # the boundary before the first letter
        sym, own = sym[keep], own[keep]
        inner = np.flatnonzero(sym[1:-1]) + 1
        return sym[inner - 1] << 42 | sym[inner] << 21 | sym[inner + 1], own[inner]

    space = np.array([32], np.uint32)
    parts, at, size = [], [], 0
    for k, text in enumerate(texts):
        cps = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        whole = np.concatenate((space, cps, space))
        for a in range(0, len(whole) - 2, _AT_ONCE):  # pieces overlap by two, so each trigram comes once
            parts.append(whole[a : a + _AT_ONCE + 2])
            at.append(k)
            size += len(parts[-1])
            if size >= _AT_ONCE:
                yield _joined(codes, parts, at)
                parts, at, size = [], [], 0
    if parts:
        yield _joined(codes, parts, at)


def _joined(codes, parts, at):
    # a piece may start or end inside a word; the pieces of one text are then handled one by one
    if len(set(at)) == len(at):
        return codes(parts, at)
    each = [codes([p], [k]) for p, k in zip(parts, at)]
    return np.concatenate([c for c, _ in each]), np.concatenate([o for _, o in each])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 modulo 4; not so for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letter_vector(symbol: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The signs of a letter, or of the boundary (0)."""
    known = _vectors_of.setdefault(dimensions, {})
    if symbol not in known:
        if len(known) >= LETTERS:
            known.clear()
        bits = np.frombuffer(np.random.default_rng([SEED, symbol]).bytes(-(-dimensions // 8)), np.uint8)
        known[symbol] = np.where(np.unpackbits(bits)[:dimensions], 1, -1).astype(np.int8)
    return known[symbol]


def trigram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vectors of trigrams, a row each."""
    three = np.stack((codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF))
    symbols, at = np.unique(three, return_inverse=True)
    at = at.reshape(three.shape)
    of = np.stack([letter_vector(int(s), dimensions) for s in symbols]) if len(symbols) else np.zeros((0, dimensions), np.int8)
    return np.roll(of, 2, 1)[at[0]] * np.roll(of, 1, 1)[at[1]] * of[at[2]]


def _bundles(dimensions: int):
    def flushed(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows = []
        for lang, (codes, n) in counts.items():
            total = np.zeros(dimensions)
            for a in range(0, len(codes), 1024):
                total += n[a : a + 1024].astype(np.float64) @ trigram_vectors(codes[a : a + 1024], dimensions).astype(np.float64)
            rows.append((lang, total, int(n.sum())))
        counts.clear()
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.list_(pa.float64()), pa.int64()))], names=["lang", "bundle", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for codes, _ in _trigrams([t for x, t in zip(langs, texts) if x == lang]):
                    seen, before = counts.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    found, n = np.unique(codes, return_counts=True)
                    both, at = np.unique(np.concatenate((seen, found)), return_inverse=True)
                    counts[lang] = both, np.bincount(at, np.concatenate((before, n))).astype(np.int64)
                if sum(len(c) for c, _ in counts.values()) > _MOST_COUNTED:
                    yield flushed(counts)
        yield flushed(counts)

    return of


def fit(labelled: DataFrame, dimensions: int = DIMENSIONS) -> Model:
    """The model of labelled texts.

    labelled: lang, text, all rows of which are learned from, but for null lang. Executors bundle; what reaches the
    driver is `dimensions` numbers a language, however many rows and trigrams there are. Sums are of whole numbers and
    so do not depend on how rows are dealt.
    """
    common.small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(common.lean(_bundles(dimensions)), "lang string, bundle array<double>, n long")
    rows = common.stash(rows, "bundles")
    summed = rows.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    listed = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("b"))
    got = listed.join(rows.groupBy("lang").agg(F.sum("n").alias("n")), "lang").where("n > 0").select("lang", F.transform("b", lambda x: x["x"]).alias("b"), "n").orderBy("lang").collect()
    common.discard(rows)
    bundles = np.array([r.b for r in got]).reshape(len(got), dimensions)
    norms = np.maximum(np.linalg.norm(bundles, axis=1), 1e-9)
    return Model([r.lang for r in got], bundles / norms[:, None], norms / np.array([r.n for r in got]).reshape(-1))


class _Products:
    """Each trigram's products with the prototypes, computed when first met."""

    def __init__(self, model: Model):
        self.unit = model.prototypes.astype(np.float32).T
        self.dimensions = model.prototypes.shape[1]
        self.most = REMEMBERED // (8 + 4 * len(model.langs))
        self.codes, self.table = np.zeros(0, np.int64), np.zeros((0, len(model.langs)), np.float32)

    def _found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        return at, self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), np.bool_)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """A row for each of codes."""
        at, known = self._found(codes)
        if not known.all():
            new = np.unique(codes[~known])
            if len(self.codes) and len(self.codes) + len(new) > self.most:
                new, self.codes, self.table = np.unique(codes), self.codes[:0], self.table[:0]
            rows = [trigram_vectors(new[a : a + 1024], self.dimensions).astype(np.float32) @ self.unit for a in range(0, len(new), 1024)]
            every = np.concatenate((self.codes, new))
            order = np.argsort(every)
            self.codes, self.table = every[order], np.concatenate((self.table, *rows))[order]
            at, _ = self._found(codes)
        return self.table[at]


def _judged(texts: list[str | None], model: Model, products: _Products) -> tuple[list[str], list[float], list[float], list[float]]:
    """lang_pred, score, likeness and its standard error of each text."""
    langs = model.langs
    sums, squares, letters = np.zeros((len(texts), len(langs))), np.zeros((len(texts), len(langs))), np.zeros(len(texts), np.int64)
    for codes, own in _trigrams(texts):
        for a in range(0, len(codes), _ROWS):
            here = own[a : a + _ROWS]
            starts = np.flatnonzero(np.diff(here, prepend=-1))
            letters += np.bincount(here, minlength=len(texts))
            if langs:
                rows = products(codes[a : a + _ROWS]).astype(np.float64)
                sums[here[starts]] += np.add.reduceat(rows, starts)
                squares[here[starts]] += np.add.reduceat(rows * rows, starts)
    out: tuple[list, ...] = ([], [], [], [])
    for k, row in enumerate(sums):
        n = int(letters[k])
        if not n or not langs:
            found = (UNDETERMINED, 0.0, 0.0, 0.0)
        else:
            top = int(row.argmax())
            mean, usual = row[top] / n, model.usual[top]
            spread = max(np.sqrt(max(0.0, squares[k, top] / n - mean * mean)), usual)
            found = (langs[top], float(row[top] / row[row > 0].sum()) if row[top] > 0 else 0.0, float(mean / usual), float(spread / usual / np.sqrt(n)))
        for column, x in zip(out, found):
            column.append(x)
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score, likeness and likeness_error, which take the place of columns of these names; other columns pass through and are not looked at but for text.

    UNDETERMINED, with zeros, where text is null or has no letter, or the model knows no language. Ties go to the
    language first in order. score is the best cosine's share of all positive ones, 0 where none is. likeness_error is
    the standard error of likeness by the spread of the text's trigrams, which counts as 1 at least.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    added = ["lang_pred", "score", "likeness", "likeness_error"]
    docs = docs.drop(*added)
    names, at = [*docs.columns, *added], docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = _Products(shared.value)
        for batch in batches:
            found = _judged(batch.column(at).to_pylist(), shared.value, products)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(found, (pa.string(), pa.float64(), pa.float64(), pa.float64())))], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(common.lean(of), f"{schema}, lang_pred string, score double, likeness double, likeness_error double")


def learned(docs: DataFrame) -> Model:
    """The model of those labelled documents that are not held out."""
    return fit(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, likeness, likeness_error: learned from the labelled documents that are not held out, for all rows.

    docs: doc_id, text, lang; other columns are ignored whatever their names. Very long texts are read in pieces.
    """
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learned(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "likeness", "likeness_error")


def recognised(docs: DataFrame, least: float = LEAST_LIKENESS) -> DataFrame:
    """docs without those that have no letter or are like no language, with the predicted language where lang is null; the columns stay as they were.

    A text goes where its likeness lies below least by more than SURE standard errors, so one of a few words is not
    rejected on thin evidence. Each row is judged by its own text. Where no document has a label there is nothing to
    be like, and every row is UNDETERMINED and goes.
    """
    found = identify(docs.withColumnsRenamed({c: f"__{c}" for c in ("lang_pred", "score", "likeness", "likeness_error") if c in docs.columns}), learned(docs))
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("likeness") + SURE * F.col("likeness_error") >= least))
    lang = F.coalesce(F.col("lang"), F.col("lang_pred")).alias("lang")
    return kept.select(*(lang if c == "lang" else F.col(f"__{c}").alias(c) if c in ("lang_pred", "score", "likeness", "likeness_error") else F.col(c) for c in docs.columns))
