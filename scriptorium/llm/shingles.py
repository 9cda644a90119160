"""Near duplicates by SimHash tables and MinHash bands, verified by the Jaccard similarity of their word shingles.

Two texts are linked where their sets of SHINGLE-word runs have a similarity of NUM / DEN or more. Candidates share a
bucket of one of two kinds. The covering tables of simhash, here over the SimHash fingerprint of the set, hold every
pair within simhash.RADIUS bits, whatever the hashes of the bands are. At 0.8 fingerprints differ by about ten bits,
and a covering of radius 10 has 2047 tables; so what lies beyond the radius shares a band of MinHash values: ROWS of
them agree with probability s ** ROWS, so at s = 0.8 all of BANDS fail in 1.3e-7 of pairs, and above it in fewer.
Every candidate pair is verified on the sets themselves, and so no other pair is linked.

Only distinct sets enter the buckets. Each bucket has a hub, the member that shares most buckets with others, as the
original of a group of copies does. All members are compared with their hubs first, which links most of a group of any
size by one comparison each. Any two members of a bucket have its hub in common; so what is not yet linked to a hub is
then compared, in blocks, with all that had been compared with it. There a set stands for itself by what it and its
hub have not in common: the symmetric difference of two sets is that of their differences from a third. Thus every two
texts that share a bucket are compared or known to be linked through others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE, NUM, DEN, SEED = 5, 4, 5, 42
BANDS, ROWS = 40, 5
#: Sets, and hashes, that a block of a comparison holds on either side.
BLOCK, BLOCK_HASHES = 2048, 1 << 21
_AT_ONCE, _REMEMBERED = 4096, 200_000
_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_OFFSETS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_BAND_SEEDS = _rng.integers(0, 1 << 63, BANDS).astype(np.uint64)
_MASKS = np.array(simhash.covering_masks(), np.uint64)
_TABLE_SEEDS = _rng.integers(0, 1 << 63, len(_MASKS)).astype(np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of shingle words; one of all words where there are fewer, none without words."""
    words = (text or "").encode().lower().split()  # of bytes, as in simhash
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    of = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - k + 1
    found = np.full(n, k, np.uint64)
    for j in range(k):
        found = _mixed(found * np.uint64(0x9E3779B97F4A7C15) + of[j : j + n])
    return np.unique(found)


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of the BANDS buckets of a set; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    low, least = (hashes >> np.uint64(32)).astype(np.uint32), None
    for a in range(0, len(low), _AT_ONCE):
        values = low[a : a + _AT_ONCE] * _FACTORS
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        values ^= _OFFSETS
        now = values.min(1)
        least = now if least is None else np.minimum(least, now)
    keys = _BAND_SEEDS.copy()
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set, unsigned: a bit is 1 if set in over half of the hashes; zero of the empty set."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _AT_ONCE):
        raw = hashes[a : a + _AT_ONCE].astype(">u8").view(np.uint8)
        counts += np.unpackbits(raw).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def tables(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set's bucket in each covering table; none for the empty set. Sets whose fingerprints differ in simhash.RADIUS bits or fewer have one in common."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return _mixed((np.uint64(fingerprint(hashes)) & _MASKS) ^ _TABLE_SEEDS)


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _listed(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    values = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, keys = [], []
        for text in batch.column(1).to_pylist():
            hashes = shingle_set(text)
            nodes.append(_node(hashes))
            keys.append(np.concatenate((tables(hashes), bands(hashes))))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.array(nodes, np.uint64).view(np.int64)), _listed(keys)], names=["doc_id", "node", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(x) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(x) for x in found], np.uint64).view(np.int64)), _listed(found)], names=["node", "hashes"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, hub, size (of both sets together), own (of the node's), diff (the hashes that one has and the other has not) of pairs (node, hub; stashed, each once).

    A node has few hubs but a hub may have any number of nodes, so where pairs are few the sets of nodes take them in
    where they are, and only sets that hubs need are shuffled; the partition of a hot hub can be cut.
    """
    few = common.hinted(pairs)
    if few is pairs:
        nodes, needed = common.spread_join(pairs, sets.withColumnRenamed("hashes", "of_a"), ["node"]), sets
    else:
        nodes = few.join(sets.withColumnRenamed("hashes", "of_a"), "node")
        needed = sets.join(F.broadcast(pairs.select(F.col("hub").alias("node")).distinct()), "node", "left_semi")
    both = common.spread_join(nodes, needed.select(F.col("node").alias("hub"), F.col("hashes").alias("of_b")), ["hub"])
    diff = F.concat(F.array_except("of_a", "of_b"), F.array_except("of_b", "of_a"))
    return both.select("node", "hub", (F.size("of_a") + F.size("of_b")).alias("size"), F.size("of_a").alias("own"), diff.alias("diff"))


def _blocks_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the asking and the asked sets of each block, one for each component that an asking set is linked to and not yet part of."""
    for batch in batches:
        rows, edges = batch.column(0), []
        of = {f.name: rows.values.field(k) for k, f in enumerate(rows.type.value_type)}
        asks, node, comp, own = (of[k].to_numpy(zero_copy_only=False) for k in ("asks", "node", "c", "own"))
        hashes, ends = np.asarray(of["diff"].values), np.asarray(of["diff"].offsets)
        for a, b in zip(np.asarray(rows.offsets)[:-1], np.asarray(rows.offsets)[1:]):
            here = np.arange(a, b)
            asking, asked = here[asks[a:b]], here[~asks[a:b]]
            if not len(asking) or not len(asked):
                continue
            sizes = np.diff(ends[a : b + 1])
            row = np.repeat(here, sizes)
            words, column, times = np.unique(hashes[ends[a] : ends[b]], return_inverse=True, return_counts=True)
            shared = np.cumsum(times > 1) - 1  # a column for each hash that two sets have
            keep = times[column] > 1
            row, column = row[keep], shared[column[keep]]
            place = np.zeros(b - a, np.int64)
            place[asking - a], place[asked - a] = np.arange(len(asking)), np.arange(len(asked))
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            common_to = np.zeros((len(asking), len(asked)), np.float32)
            for first in range(0, int(shared[-1]) + 1 if len(shared) else 0, 2048):
                lo, hi = np.searchsorted(column, (first, first + 2048))
                left, right = np.zeros((len(asking), 2048), np.float32), np.zeros((len(asked), 2048), np.float32)
                r, c = row[lo:hi], column[lo:hi] - first
                is_asking = asks[r]
                left[place[r[is_asking] - a], c[is_asking]] = 1
                right[place[r[~is_asking] - a], c[~is_asking]] = 1
                common_to += left @ right.T
            of_both = own[asking][:, None].astype(np.int64) + own[asked][None, :]
            apart = sizes[asking - a][:, None] + sizes[asked - a][None, :] - 2 * common_to.astype(np.int64)
            near = ((DEN - NUM) * of_both >= (DEN + NUM) * apart) & (comp[asking][:, None] != comp[asked][None, :])
            for k in np.flatnonzero(near.any(1)):
                found = asked[near[k]]
                _, one = np.unique(comp[found], return_index=True)
                edges += [(int(node[asking[k]]), int(node[x])) for x in found[one]]
        both = np.array(edges, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def links(prints: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, component of the nodes that are linked to a smaller one. prints: doc_id, node, keys (of its buckets) of docs."""
    rows = prints.groupBy("node").agg(F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), "node")
    rows = common.stash(rows, "keys")
    met = common.stash(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    few = common.hinted(met)
    members = common.stash((common.spread_join(rows, met, ["key"]) if few is met else rows.join(few, "key")).select("key", "node", "n"), "members")
    common.discard(rows, met)
    degrees = members.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = members.join(degrees, "node").groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"))
    pairs = common.spread_join(members.select("key", "node"), ranked, ["key"]).where("node <> hub")
    pairs = common.stash(pairs.select("node", "hub").distinct(), "pairs")
    wanted = pairs.select("node").union(pairs.select(F.col("hub").alias("node"))).distinct()
    ids = prints.select("doc_id", "node").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = common.with_ids(docs.select("doc_id", "text"), common.stash(ids, "candidates"), "left_semi").select("text")
    sets = common.stash(texts.mapInArrow(common.lean(_sets), "node long, hashes array<long>").groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
    compared = common.stash(_compared(pairs, sets), "compared")
    common.discard(members, sets, pairs)
    edges = common.stash(compared.where((DEN - NUM) * F.col("size") >= (DEN + NUM) * F.size("diff")).select(F.col("node").alias("a"), F.col("hub").alias("b")), "similar")
    found = common.stash(common.components(edges), "components")

    named = common.spread_join(compared, found, ["node"], "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    named = common.spread_join(named, found.select(F.col("node").alias("hub"), F.col("component").alias("hub_c")), ["hub"], "left")
    named = common.stash(named.select("node", "hub", "own", "diff", "c", (F.col("c") != F.coalesce("hub_c", "hub")).alias("apart")), "named")
    blocks = lambda n, hashes: F.greatest(F.ceil(n / block), F.ceil(hashes / BLOCK_HASHES))
    opened = named.groupBy("hub").agg(
        blocks(F.count("*"), F.sum(F.size("diff"))).alias("asked_in"), blocks(F.count_if("apart"), F.sum(F.when(F.col("apart"), F.size("diff")))).alias("asking_in"), F.count_if("apart").alias("n_apart")
    ).where("n_apart > 0").drop("n_apart")
    opened = common.stash(opened, "open")
    if opened.isEmpty():
        return found
    rows = common.spread_join(named, opened, ["hub"])
    spot = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    fields = ["hub", "node", "c", "own", "diff"]
    asked = rows.select(*fields, spot(F.col("asked_in")).alias("asked"), every(F.col("asking_in")).alias("asking"), F.lit(False).alias("asks"))
    asking = rows.where("apart").select(*fields, every(F.col("asked_in")).alias("asked"), spot(F.col("asking_in")).alias("asking"), F.lit(True).alias("asks"))
    cells = asked.unionByName(asking).groupBy("hub", "asked", "asking").agg(F.collect_list(F.struct("asks", "node", "c", "own", "diff")).alias("rows"))
    more = common.stash(cells.select("rows").mapInArrow(common.lean(_blocks_linked), "a long, b long"), "further")
    common.discard(compared, named)
    return found if more.isEmpty() else common.components(edges.union(more))


def near_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id and component_id of each row of docs.

    docs: doc_id, text; other columns are ignored whatever their names. Texts without words are alike. component_id is
    the smallest doc_id reachable over links, null where the component has none. No rows give no rows.
    """
    common.small_batches(docs.sparkSession)
    prints = common.stash(docs.select("doc_id", "text").mapInArrow(common.lean(_prints), "doc_id long, node long, keys array<long>"), "prints")
    found = links(prints, docs, block)
    of = prints.groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("c"))
    of = common.stash(of, "nodes")
    ids = common.spread_join(of, of.groupBy("c").agg(F.min("least").alias("component_id")), ["c"]).select("node", "component_id")
    return common.spread_join(prints.select("doc_id", "node"), ids, ["node"]).select("doc_id", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id, all columns as they were. Rows that share a doc_id stay or go together; rows without one stay only where their component has no other."""
    return common.one_of_each(docs, near_groups(docs))
