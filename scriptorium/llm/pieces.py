"""SentencePiece encoding and decoding, by a forward pass shared over common prefixes.

A text's spaces become marks, and it is cut into marked words where no piece of the model reaches across. The
distinct words of a batch are sorted, which walks their trie depth-first; a stack holds the forward state of each
prefix of the present word, and the next word starts from the longest prefix that they share.

For a unigram model the state is Viterbi's: the best score of the prefix and its last piece. A BPE model has no scores
to add up, but the same pass is exact with another rule: the encoding of a prefix ends with the piece that, after the
encoding of what precedes it, forms a pair that merging leaves apart; there is exactly one. So the state is the last
piece, and merging itself runs only on pairs of pieces, once each. Both give the library's ids.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words (of LONGEST characters at most: in scripts without spaces a word may be a whole text) that a Python worker
#: remembers, and pairs of pieces, some 40 MB each; it then forgets them all and goes on.
REMEMBERED, LONGEST = 150_000, 64
_MARK = "\u2581"
_models: dict[int, Model] = {}


class Model:
    """A SentencePiece model (unigram or BPE, with byte fallback and the identity normaliser) from its file's bytes."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        spec, normal = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type not in (1, 2) or not spec.byte_fallback or spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with byte fallback are supported")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("only models without normalisation, user-defined and unused pieces are supported")
        self.bpe, self.dummy = spec.model_type == 2, normal.add_dummy_prefix
        self.ids, self.scores, self.bytes, self.surface = {}, {}, [0] * 256, []
        for k, p in enumerate(proto.pieces):
            if p.type == 1:
                text = p.piece.replace(_MARK, " ")
                self.ids[text], self.scores[text] = k, p.score
                self.surface.append(text.encode())
            elif p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = k
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.surface.append(spec.unk_surface.encode() if p.type == 2 else b"")
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values(), default=0.0) - 10.0
        self._split = self._splitter()
        self.known: dict[str, bytes] = {}
        self.apart: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.endings: dict = {}
        for text in self.ids:
            node = self.endings
            for c in reversed(text):
                node = node.setdefault(c, {})
            node[""] = text

    def _splitter(self):
        pairs = {(a, b) for text in self.ids for a, b in zip(text, text[1:])}
        if any(b == " " and a != " " for a, b in pairs):
            raise ValueError("a piece goes on after a space")
        alone = "" if any("\n" in p for p in pairs) else r"\n"
        marks = "".join(p for p in string.punctuation + "\r\t" if not any((p, x) in pairs or (x, p) in pairs for x in string.ascii_letters + string.digits))
        both = {c for a, b in pairs for c, d in ((a, b), (b, a)) if d in marks and c not in marks and c != " "}
        first = f"{alone}|" if alone else ""
        coarse = re.compile(rf"{first} *[^ {alone}]+| +")
        fine = re.compile(rf"{first} *[{re.escape(marks)}]+| *[^ {alone}{re.escape(marks)}]+| +") if marks else coarse
        hard = re.compile("[" + re.escape("".join(sorted(both))) + "]") if both else None

        def split(text: str) -> list[str]:
            if not text:
                return []
            text = (" " if self.dummy else "") + text.replace(_MARK, " ")
            return (coarse if hard and hard.search(text) else fine).findall(text)

        return split

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored adjacent pair merges first, the leftmost of equals. For short strings."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _apart(self, before: str, piece: str) -> bool:
        """Whether merging leaves the pair as it is; before is empty at the start of a word."""
        ok = self.apart[before][piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return ok

    def _step_bpe(self, word: str, i: int, last: list[str]) -> str:
        """The last piece of word[:i]: a walk from its end through the trie of reversed pieces."""
        node, a, apart = self.endings, i, self.apart
        while a:
            a -= 1
            node = node.get(word[a])
            if node is None:
                break
            piece = node.get("")
            if piece is not None:
                ok = apart[last[a]].get(piece)
                if ok or (ok is None and self._apart(last[a], piece)):
                    return piece
        return word[i - 1]  # a character without a piece, spelt in bytes

    def _step_unigram(self, word: str, i: int, best: list[float]) -> tuple[float, str]:
        top, chosen = None, ""
        for a in range(max(0, i - self.longest), i):
            piece = word[a:i]
            score = self.scores.get(piece, self.unknown if a == i - 1 else None)
            if score is not None and (top is None or best[a] + score > top):
                top, chosen = best[a] + score, piece
        return top, chosen

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Ids (32-bit, as bytes) of distinct words, in sorted order."""
        before, last, best = "", [""], [0.0]
        for word in sorted(words):
            shared, end = 0, min(len(before), len(word))
            while shared < end and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                if self.bpe:
                    last.append(self._step_bpe(word, i, last))
                else:
                    score, piece = self._step_unigram(word, i, best)
                    last.append(piece)
                    best.append(score)
            before, i, found = word, len(word), []
            while i:
                known = self.ids.get(last[i])
                found += [known] if known is not None else [self.bytes[b] for b in reversed(last[i].encode())]
                i -= len(last[i])
            yield word, np.array(found[::-1], np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        split = [self._split(t or "") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if sum(map(len, self.apart.values())) > REMEMBERED:
            self.apart.clear()
        known, once = self.known, {}
        new = set().union(*split).difference(known) if split else set()
        for word, ids in self.encode_words(new):
            (known if len(word) <= LONGEST else once)[word] = ids
        if not once:
            return [np.frombuffer(b"".join([known[w] for w in words]), np.int32) for words in split]
        return [np.frombuffer(b"".join([known[w] if w in known else once[w] for w in words]), np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; invalid UTF-8 becomes U+FFFD."""
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return (data[1:] if self.dummy and data[:1] == b" " else data).decode(errors="replace")


def _model(raw: bytes) -> Model:
    key = hash(raw)
    if key not in _models:
        _models.clear()
        _models[key] = Model(raw)
    return _models[key]


def _raw(df: DataFrame, path: str):
    common.small_batches(df.sparkSession)
    with open(path, "rb") as f:
        raw = f.read()
    _model(raw)  # an unsupported model is refused here
    return df.sparkSession.sparkContext.broadcast(raw)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text, ids for each row of docs. Null and empty texts have no ids; other columns are ignored whatever their names. model is a file that the driver reads."""
    raw = _raw(docs, model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw.value)
        for batch in batches:
            found = model.encode(batch.column(1).to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "text", "ids"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(of), "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with a column decoded: the text of its ids, empty for null. encoded: ids, and columns that pass through."""
    raw = _raw(encoded, model)
    at, names = encoded.columns.index("ids"), [*encoded.columns, "decoded"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw.value)
        for batch in batches:
            ids = batch.column(at)
            ends, values = np.asarray(ids.offsets), np.asarray(ids.values)
            texts = [model.decode(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return encoded.mapInArrow(common.lean(of), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, decoded string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256, round_trip: each row of docs encoded, decoded and compared, in one pass of one worker.

    Null and empty texts have no ids and come back empty. A text with U+2581 comes back with a space in its place, and
    so without round_trip. Other columns are ignored whatever their names.
    """
    raw = _raw(docs, model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = model.encode(texts)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            digests, same = [], []
            for ids, text in zip(found, texts):
                decoded = model.decode(ids)
                digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                same.append(decoded == (text or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(of), "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, round_trip boolean")
