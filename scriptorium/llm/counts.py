"""Token counts that follow edits.

A document's state is its text as leaves of LEAF pre-tokens (LEAF / 2 to 2 * LEAF after edits), with the characters
and tokens of each. While it is edited the leaves hang in a balanced tree (a treap) with the sums of each subtree. An
edit finds its first leaf by going down the sums; pre-tokens are cut and counted anew from that leaf's start until a
cut falls on the start of an untouched leaf behind the edit; the old leaves between are split off and the new ones
merged in, which changes sums on the paths to them alone, whatever the number of leaves. A cut depends on less than
CONTEXT characters behind it, so starting that far before the edit gives the cuts of a recount from the beginning.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

LEAF, CONTEXT = 64, 4
#: Pre-tokens, of LONGEST characters at most, whose counts a Python worker remembers (some 50 MB); it then forgets them all and goes on.
REMEMBERED, LONGEST = 300_000, 64
_CUT = regex.compile(bpe.PATTERN)
_AT_ONCE = 1 << 20
_known: dict[int, dict[str, int]] = {}
_ranks = random.Random(8)


class Counter:
    """Tokens of pre-tokens."""

    def __init__(self, raw: bytes):
        self.encode = bpe.encoding(raw).encode_ordinary
        self.known = _known.setdefault(hash(raw), {})

    def __call__(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found, long = [], {}
        for part in set(parts).difference(known):
            (known if len(part) <= LONGEST else long)[part] = len(self.encode(part))
        if not long:
            return [known[p] for p in parts]
        for p in parts:
            found.append(long[p] if p in long else known[p])
        return found


class Node:
    """A leaf's text and tokens, at the root of a subtree with the sums of its characters and tokens."""

    __slots__ = ("text", "own", "rank", "left", "right", "chars", "tokens")

    def __init__(self, text: str, own: int):
        self.text, self.own, self.rank = text, own, _ranks.random()
        self.left = self.right = None
        self.chars, self.tokens = len(text), own


class Tree:
    """The leaves of a text; touched counts the subtrees whose sums were made anew since it was built."""

    def __init__(self, leaves: list[tuple[str, int]]):
        self.touched, self.root = 0, None
        self.root = self._built(leaves)
        self.touched = 0

    def _sum(self, n: Node) -> Node:
        a, b = n.left, n.right
        n.chars = len(n.text) + (a.chars if a else 0) + (b.chars if b else 0)
        n.tokens = n.own + (a.tokens if a else 0) + (b.tokens if b else 0)
        self.touched += 1
        return n

    def _built(self, leaves: list[tuple[str, int]]) -> Node | None:
        """A treap of leaves in order, in one pass: the stack is its right edge."""
        edge: list[Node] = []
        for leaf in leaves:
            node, below = Node(*leaf), None
            while edge and edge[-1].rank < node.rank:
                below = self._sum(edge.pop())
            node.left = below
            if edge:
                edge[-1].right = node
            edge.append(node)
        for node in reversed(edge):
            self._sum(node)
        return edge[0] if edge else None

    def _merge(self, a: Node | None, b: Node | None) -> Node | None:
        if not a or not b:
            return a or b
        if a.rank > b.rank:
            a.right = self._merge(a.right, b)
            return self._sum(a)
        b.left = self._merge(a, b.left)
        return self._sum(b)

    def _split(self, n: Node | None, at: int) -> tuple[Node | None, Node | None]:
        """The leaves before character at, which is where one starts, and the others."""
        if not n:
            return None, None
        before = n.left.chars if n.left else 0
        if at <= before:
            a, n.left = self._split(n.left, at)
            return a, self._sum(n)
        n.right, b = self._split(n.right, at - before - len(n.text))
        return self._sum(n), b

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    def start_of_leaf(self, at: int) -> int:
        """The first character of the leaf that holds character at, or of the last."""
        n, start = self.root, 0
        while n:
            before = n.left.chars if n.left else 0
            if at < before:
                n = n.left
            elif at >= before + len(n.text) and n.right:
                start += before + len(n.text)
                n, at = n.right, at - before - len(n.text)
            else:
                return start + before
        return start

    def leaves(self, at: int = 0) -> Iterator[Node]:
        """Leaves in order from the one that starts at character at."""
        path, n = [], self.root
        while n:
            before = n.left.chars if n.left else 0
            if at <= before:
                path.append(n)
                n = n.left
            else:
                n, at = n.right, at - before - len(n.text)
        while path:
            n = path.pop()
            yield n
            n = n.right
            while n:
                path.append(n)
                n = n.left

    def replace(self, start: int, end: int, leaves: list[tuple[str, int]]) -> None:
        """Other leaves in place of those from character start to end, where leaves begin."""
        left, rest = self._split(self.root, start)
        _, right = self._split(rest, end - start)
        self.root = self._merge(self._merge(left, self._built(leaves)), right)


def _sizes(parts: list[str], count: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each LEAF pre-tokens."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.arange(0, len(parts), LEAF)
    return tuple(np.add.reduceat(np.fromiter(x, np.int64, len(parts)), starts) for x in (map(len, parts), count(parts)))


def measure(text: str, count: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of the leaves of a whole text."""
    if len(text) <= _AT_ONCE:
        return _sizes(_CUT.findall(text), count)
    found, parts, size = [], [], 0
    for m in _CUT.finditer(text):
        parts.append(m[0])
        size += len(m[0])
        if size >= _AT_ONCE and len(parts) % LEAF == 0:
            found.append(_sizes(parts, count))
            parts, size = [], 0
    found.append(_sizes(parts, count))
    return tuple(np.concatenate(x) for x in zip(*found))


def plant(text: str, chars: list[int], tokens: list[int]) -> Tree:
    """The tree of a text whose leaves have these sizes."""
    ends = np.cumsum(np.array(chars, np.int64)).tolist()
    return Tree([(text[a:b], n) for a, b, n in zip([0, *ends], ends, tokens)])


def edit(tree: Tree, at: int, removed: int, inserted: str, count: Counter) -> int:
    """Edits the text of tree, and gives the number of pre-tokens that were counted anew. at and removed are held within the text.

    Only leaves around the edit are read. Where less than half a leaf is left of them, the next leaf joins in.
    """
    at = min(max(at, 0), tree.chars)
    removed = min(max(removed, 0), tree.chars - at)
    start = tree.start_of_leaf(max(0, at - CONTEXT))
    coming, old, size = tree.leaves(start), [], 0
    following = next(coming, None)
    while following and (start + size < at + removed or not old):
        old.append(following.text)
        size += len(following.text)
        following = next(coming, None)
    old = "".join(old)
    text = old[: at - start] + inserted + old[at - start + removed :]
    shift, bounds, parts, end, step = len(inserted) - removed, {len(text)}, [], 0, 1
    while True:
        if end in bounds and (len(parts) >= LEAF // 2 or not parts or not following) and end >= at - start + len(inserted):
            break
        m = _CUT.match(text, end)
        if following and (not m or max(m.end() + 1, m.start() + CONTEXT) > len(text)):
            more = []
            while following and len(more) < step:  # twice as many each time, so that a long pre-token is not read over and over
                more.append(following.text)
                following = next(coming, None)
            for leaf in more:
                text += leaf
                bounds.add(len(text))
            step *= 2
            continue
        parts.append(m[0])
        end = m.end()
    each = -(-len(parts) // LEAF) if len(parts) > 2 * LEAF else min(1, len(parts))
    cuts = [len(parts) * k // max(1, each) for k in range(each + 1)]
    n = count(parts)
    tree.replace(start, start + end - shift, [("".join(parts[a:b]), sum(n[a:b])) for a, b in zip(cuts, cuts[1:])])
    return len(parts)


def _counted(raw):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(raw.value)
        for batch in batches:
            sizes = [measure(t or "", count) for t in batch.column(1).to_pylist()]
            leaves = [pa.array([x[k] for x in sizes], pa.list_(pa.int64())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *leaves, pa.array([int(x[1].sum()) for x in sizes], pa.int64())], names=["doc_id", "text", "chars", "tokens", "n_tokens"])

    return of


_STATE = "doc_id long, text string, chars array<long>, tokens array<long>, n_tokens long"


def count_tokens(docs: DataFrame, ranks: str = bpe.RANKS) -> DataFrame:
    """The state of each row of docs: doc_id, text, chars and tokens (of the leaves), n_tokens.

    docs: doc_id, text; other columns pass by whatever their names. Null and empty texts have no leaf and no token.
    """
    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_counted(bpe.share(docs.sparkSession, ranks)), _STATE)


def apply_edits(state: DataFrame, ranks: str = bpe.RANKS) -> DataFrame:
    """The state after edits: that of count_tokens with n_before (the count before them), n_edits and recounted, the pre-tokens that were counted anew.

    state: as count_tokens gives it, with edits, an array of (at, removed, inserted) that apply one after another;
    null is none. Places are characters of the text as the edits before left it, held within it.
    """
    common.small_batches(state.sparkSession)
    raw = bpe.share(state.sparkSession, ranks)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(raw.value)
        for batch in batches:
            rows = []
            for doc, text, chars, tokens, edits in zip(*(c.to_pylist() for c in batch.columns)):
                tree, anew = plant(text or "", chars, tokens), 0
                before = tree.tokens
                for e in edits or []:
                    anew += edit(tree, e["at"] or 0, e["removed"] or 0, e["inserted"] or "", count)
                leaves = list(tree.leaves())
                rows.append((doc, "".join(x.text for x in leaves), [len(x.text) for x in leaves], [x.own for x in leaves], tree.tokens, before, len(edits or []), anew))
            columns = list(zip(*rows)) or [[] for _ in range(8)]
            types = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "text", "chars", "tokens", "n_tokens", "n_before", "n_edits", "recounted"])

    return state.select("doc_id", "text", "chars", "tokens", "edits").mapInArrow(of, f"{_STATE}, n_before long, n_edits long, recounted long")


def revised(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_edits, recounted, sha256_after: each row of docs counted whole, then edited three times by a rule.

    An insertion at a third, a deletion of seven characters at the half, and a character replaced at a place that
    doc_id chooses (null counts as 0). Null texts count as empty; no rows give no rows.
    """
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    rule = [(F.floor(n / 3), 0, " edited"), (F.floor(n / 2), 7, ""), (F.pmod(F.coalesce("doc_id", F.lit(0)) % 1_000_003 * 7919, n + 1), 1, "Ω\n")]
    edits = F.array(*(F.struct(at.cast("long").alias("at"), F.lit(k).cast("long").alias("removed"), F.lit(x).alias("inserted")) for at, k, x in rule))
    after = apply_edits(count_tokens(docs).withColumn("edits", edits))
    return after.select(
        "doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), "n_edits", "recounted",
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256_after"),
    )
