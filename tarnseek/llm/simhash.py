"""SimHash near-duplicates, linked through BK-trees over shards of the fingerprints.

A pair within ``radius`` bits agrees in at least ``blocks - radius`` of ``blocks`` bit blocks, so
each distinct fingerprint goes to one shard for every choice of that many blocks. Every shard
has a BK-tree whose children are keyed by their Hamming distance to the parent; a search follows
only the edges whose key lies within the radius of its own distance. A shard gives each
fingerprint an edge to the least of its group, never all pairs, and the groups are joined up by
connected components.

Shards of more than ``SHARD_ROWS`` fingerprints are dealt over several trees, and their members
search the other trees too, so none is cut and no task holds a whole one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnseek.functions.columns import fresh_names
from tarnseek.llm.arrow_groups import by_bytes
from tarnseek.llm.common import components, row_key, written

SHINGLE_WORDS = 4
RADIUS = 4
BLOCKS = 7
SHARD_ROWS = 4096
#: Shingles hashed at once, and (search, node) pairs looked at together.
_SHINGLE_BATCH = 1 << 16
_PAIR_BATCH = 1 << 20
#: Bytes of texts taken from a batch at once.
_TEXT_BYTES = 4 << 20


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """64 bits, each 1 if set in over half of the hashes of the word shingles; no words give 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(tokens) - words + 1)]
    ends = ends[min(words, len(tokens)) - 1 :]
    set_bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SHINGLE_BATCH):
        cut = slice(at, at + _SHINGLE_BATCH)
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[cut].tolist(), ends[cut].tolist())]
        as_bytes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(as_bytes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in by_bytes(batch, "text", _TEXT_BYTES):
            found = np.fromiter((fingerprint(t.as_py()) for t in rows.column("text")), np.uint64, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row_key"), pa.array(found.view(np.int64))], names=["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp) of every row; fp as a signed long. A null text counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key().alias("row_key"), "text")
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, row_key long, fp long")


class BKForest:
    """BK-trees over groups of fingerprints, built and searched level by level.

    ``group`` says to which tree each fingerprint belongs; equal fingerprints of a group are
    one apart at key 0. All trees grow together: on each level the first fingerprint that asks
    for a (parent, distance) edge becomes the child there, and the others go down to it.
    """

    def __init__(self, values: np.ndarray, group: np.ndarray):
        self.values = values
        n = len(values)
        _, root, tree = np.unique(group, return_index=True, return_inverse=True)
        self.groups, self.roots = group[root], root
        at = root[tree]
        moving = np.flatnonzero(at != np.arange(n))
        at = at[moving]
        parents, keys, children = [], [], []
        while len(moving):
            apart = np.bitwise_count(values[moving] ^ values[at]).astype(np.int64)
            edge = at * 65 + apart
            new, first, slot = np.unique(edge, return_index=True, return_inverse=True)
            child = moving[first]
            parents.append(new // 65), keys.append(new % 65), children.append(child)
            at = child[slot]
            stay = at != moving
            moving, at = moving[stay], at[stay]
        if parents:
            edge = np.concatenate(parents) * 65 + np.concatenate(keys)
            order = np.argsort(edge, kind="stable")
            self.edge, self.child = edge[order], np.concatenate(children)[order]
        else:
            self.edge = self.child = np.zeros(0, np.int64)

    def within(self, values: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(search number, node) pairs at most ``radius`` bits apart, some at a time."""
        where = np.searchsorted(self.groups, group)
        has = where < len(self.groups)
        has[has] = self.groups[where[has]] == group[has]
        search = np.flatnonzero(has)
        waiting = [(search, self.roots[where[has]])] if len(search) else []
        while waiting:
            search, node = waiting.pop()
            if len(search) > _PAIR_BATCH:
                half = len(search) // 2
                waiting += [(search[half:], node[half:]), (search[:half], node[:half])]
                continue
            apart = np.bitwise_count(values[search] ^ self.values[node]).astype(np.int64)
            near = apart <= radius
            if near.any():
                yield search[near], node[near]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(apart - radius, 0), "left")
            high = np.searchsorted(self.edge, node * 65 + np.minimum(apart + radius, 64), "right")
            many = high - low
            if many.sum():
                ahead = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                waiting.append((np.repeat(search, many), self.child[ahead]))


def _least_linked(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` rows the least row it is linked to, over any number of links."""
    label = np.arange(n)
    for left, right in pairs:
        while True:
            low = np.minimum(label[left], label[right])
            if (label[left] == low).all() and (label[right] == low).all():
                break
            np.minimum.at(label, label[left], low)
            np.minimum.at(label, label[right], low)
            while not np.array_equal(label, label[label]):
                label = label[label]
    return label


#: Roles of a row in a shard: it is in the tree and searches, it only searches, it has searched.
_MEMBER, _SEARCH, _DONE = 0, 1, 2


def _linked(shard: np.ndarray, role: np.ndarray, fp: np.ndarray, radius: int) -> pd.DataFrame:
    """Edges from each fingerprint of a shard to the least one of its group there."""
    values = fp.view(np.uint64)
    member = np.flatnonzero(role != _SEARCH)
    search = np.flatnonzero(role != _DONE)
    forest = BKForest(values[member], shard[member])
    pairs = forest.within(values[search], shard[search], radius)
    label = _least_linked(len(fp), ((search[s], member[m]) for s, m in pairs))
    moved = label != np.arange(len(fp))
    return pd.DataFrame({"a": fp[moved], "b": fp[label[moved]]})


def _search_shards(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            new = (rows[["c", "key", "shard"]].diff() != 0).any(axis=1).to_numpy()
            shard = np.cumsum(new)
            role, fp = rows["role"].to_numpy(), rows["fp"].to_numpy()
            last = int(np.flatnonzero(shard == shard[-1])[0])
            yield _linked(shard[:last], role[:last], fp[:last], radius)
            kept = rows.iloc[last:]
            if len(kept) > 8 * SHARD_ROWS and (role[last:] == _SEARCH).any():
                yield _linked(shard[last:], role[last:], fp[last:], radius)
                kept = kept[kept["role"] != _SEARCH].assign(role=np.int32(_DONE))
        if kept is not None and len(kept):
            yield _linked(np.zeros(len(kept), np.int64), kept["role"].to_numpy(), kept["fp"].to_numpy(), radius)

    return run


def block_masks(blocks: int, radius: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of the blocks on which a close pair can agree."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all within ``radius`` bits.

    Not all pairs: within a shard each fingerprint has an edge to the least of its group.
    """
    masks = F.array([F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(blocks, radius)])
    rows = fps.select("fp", F.posexplode(masks).alias("c", "key"))
    sizes = rows.groupBy("c", "key").count().where(F.col("count") > shard_rows)
    sizes = written(sizes.select("c", "key", F.ceil(F.col("count") / shard_rows).cast("int").alias("shards")), "shards")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("shards", F.lit(1))).cast("int")
    rows = rows.join(sizes, ["c", "key"], "left").withColumn("own", own)
    # A row is a member of its own shard's tree and searches those before it.
    rows = rows.select("c", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("shard"))
    rows = rows.withColumn("role", F.when(F.col("shard") == F.col("own"), _MEMBER).otherwise(_SEARCH)).drop("own")
    dealt = rows.repartition("c", "key", "shard").sortWithinPartitions("c", "key", "shard", "role")
    return dealt.select("c", "key", "shard", "role", "fp").mapInPandas(_search_shards(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, fp (signed), root and component_id.

    Words are lower-cased in A-Z; shingles of four words hashed by XXH64. component_id is the
    smallest doc_id that can be reached over links; null ids don't count unless all are null.
    root is the least fingerprint of the component. Null and empty texts have fingerprint zero
    and link like any other. Repeated rows stay repeated. Other columns of ``docs`` aren't
    read. An empty table gives an empty one.
    """
    table = written(fingerprints(docs), "fingerprints")
    first = written(table.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    roots = components(links(first.select("fp"), radius, blocks), "components")
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of = written(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    return table.join(of, "fp")


def keep_first(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest doc_id.

    Of repeated rows with that id one stays; of several texts of a group under it, one. If all
    ids of a group are null, one row of the group stays. All columns are kept.
    """
    rows = near_duplicates(docs, radius, blocks).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    same = rows.groupBy("root", "doc_id", "row_key").agg(F.count("*").alias("n"))
    heads = same.groupBy("root").agg(F.min_by(F.struct("doc_id", "row_key", "n"), "row_key").alias("head"))
    doc, key, many, row = fresh_names(docs, "head_doc", "head_key", "head_rows", "own_key")
    heads = written(heads.select(F.col("head.doc_id").alias(doc), F.col("head.row_key").alias(key), F.col("head.n").alias(many)), "heads")
    here = docs.withColumn(row, row_key())
    found = here.join(heads, here["doc_id"].eqNullSafe(F.col(doc)) & (F.col(row) == F.col(key)))
    once = found.where(F.col(many) == 1).select(docs.columns)
    repeated = found.where(F.col(many) > 1).dropDuplicates([doc, key]).select(docs.columns)
    return once.unionByName(repeated)
