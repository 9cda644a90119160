"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Bit i of a fingerprint has the label phi(i) = 1 + i mod (2^(r+1) - 1), a non-zero vector of r+1 bits; table v, for
each non-zero v, looks at the bits whose label has odd overlap with v. The labels of r differing bits span at most r
dimensions, so some v is orthogonal to all of them and in its table the two fingerprints collide: every pair within
the radius shares a bucket. Only distinct fingerprints enter the tables. A bucket of up to MOST_IN_BUCKET of them is
compared as a whole in one task and gives a spanning forest, not its pairs. Larger buckets go another exact way:
fingerprints x and y at distance 3 or less, equal in the table's bits, have a common neighbour z at distance 1 or
less from x and 2 or less from y; each member names its few hundred neighbours, and those meet by z.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS, SHINGLE, SEED = 3, 3, 42
MOST_IN_BUCKET = 2048
_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned; zero where it has no word."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone are lowered, ASCII white space alone splits
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), _AT_ONCE):
        raw = b"".join([digest(data[a:b], SEED) for a, b in zip(starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 masks, unsigned."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if ((1 + i % n) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, reps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join what is linked within a bucket: each member to the smallest rep of its component."""
    edges, left = [], np.arange(len(fps))
    while len(left) > 1:
        group, queue, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(fps[left] ^ fps[queue.pop()]) <= radius
            if near.any():
                group += (found := left[near].tolist())
                queue += found
                left = left[~near]
        if len(group) > 1:
            least = int(reps[group].min())
            edges += [(int(x), least) for x in reps[group] if x != least]
    return edges


def _forests(radius: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, edges = batch.column(0), []
            ends = np.asarray(members.offsets).tolist()
            fps = np.asarray(members.values.field(0)).view(np.uint64)
            reps = np.asarray(members.values.field(1))
            for a, b in zip(ends, ends[1:]):
                edges += forest(fps[a:b], reps[a:b], radius)
            both = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return of


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each member of a large bucket: itself and what one or two flips of the bits its table ignores lead to."""
    for batch in batches:
        for free, fp, rep in zip(*(c.to_pylist() for c in batch.columns)):
            bits = np.array([1 << i for i in range(64) if free >> i & 1], np.uint64)
            pairs = np.array([x | y for x, y in combinations(bits.tolist(), 2)], np.uint64)
            z = np.concatenate((np.zeros(1, np.uint64), bits, pairs)) ^ np.int64(fp).view(np.uint64)
            near = np.arange(len(z)) <= len(bits)
            yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)), pa.array(near), pa.array(np.full(len(z), rep))], names=["z", "near", "rep"])


def links(nodes: DataFrame, radius: int = RADIUS, most: int = MOST_IN_BUCKET) -> DataFrame:
    """Edges (a, b) between the reps of distinct fingerprints that connect exactly those within the radius of one another, directly or through others. nodes: fp, rep."""
    if radius > 3:
        raise ValueError("large buckets are exact up to radius 3")
    masks = [_signed(x) for x in covering_masks(radius)]
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(x)).alias("key"), F.lit(_signed(~x & (1 << 64) - 1)).alias("free")) for t, x in enumerate(masks))))
    rows = nodes.select("fp", "rep", tables.alias("b")).select("b.*", "fp", "rep")
    large = common.stash(rows.groupBy("t", "key").count().where(F.col("count") > most).select("t", "key"), "large_buckets")
    small = rows.join(large, ["t", "key"], "left_anti").groupBy("t", "key").agg(F.collect_list(F.struct("fp", "rep")).alias("members")).where(F.size("members") > 1)
    edges = small.select("members").mapInArrow(common.lean(_forests(radius)), "a long, b long")
    if large.isEmpty():
        return edges
    probes = rows.join(large, ["t", "key"]).select("free", "fp", "rep").mapInArrow(common.lean(_neighbours), "z long, near boolean, rep long")
    # a z meets only fingerprints within two flips of it, so its set stays small however large the bucket was
    met = probes.groupBy("z").agg(F.min(F.when(F.col("near"), F.col("rep"))).alias("b"), F.collect_set("rep").alias("all"))
    return edges.union(met.where("b is not null and size(all) > 1").select(F.explode("all").alias("a"), "b").where("a <> b"))


def near_groups(docs: DataFrame, radius: int = RADIUS, most: int = MOST_IN_BUCKET) -> DataFrame:
    """Fingerprint and component of each row of docs: doc_id, fingerprint, component_id.

    docs: doc_id, text; other columns are ignored whatever their names. Texts without words (null, empty) have
    fingerprint zero and are linked like any other; repeated rows and equal texts share a fingerprint.
    component_id is the smallest doc_id reachable over links of at most radius differing bits. A null doc_id keeps
    its row, but names a component only where all its doc_ids are null. No rows give no rows.
    """
    common.small_batches(docs.sparkSession)
    fps = common.stash(docs.select("doc_id", "text").mapInArrow(common.lean(_fingerprints), "doc_id long, fp long"), "fingerprints")
    nodes = common.stash(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    # a group without any doc_id still links its neighbours: it stands under an id of its own, sorted last
    none = F.lit((1 << 63) - 1) - F.pmod("fp", F.lit(1 << 40))
    ided = nodes.select("fp", F.coalesce("rep", none).alias("rep"))
    found = common.components(links(ided, radius, most))
    known = ided.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("least"))
    known = known.select("fp", F.when(F.col("least") < F.lit((1 << 63) - 1 - (1 << 40)), F.col("least")).alias("component_id"))
    return common.spread_join(fps, known, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id, all columns as they were. Rows that share a doc_id stay or go together; rows without one stay only where their component has no other."""
    return common.one_of_each(docs, near_groups(docs))
