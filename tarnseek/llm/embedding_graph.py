"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards.

Equal vectors are one node. Each node goes to the shards of its nearest centres (fitted on a bounded sample); every
shard builds a graph, and a node's adjacency lists from all its shards are united. Then each shard is searched for its own
nodes: greedily from its medoid, and on around every point in range as far as the range goes. What is reached counts
if its cosine, in double precision, is high enough. A pair that shares several cells counts in the first of them.

Cells of more than ``SHARD_ROWS`` nodes are dealt over several shards, and their nodes search the other shards too. Tasks
give counts and links to the least of a group, never all pairs, so a large group costs rows in proportion to its size.
At last, recall is audited: a bounded number of nodes is compared with all others by brute force, and if too few of their
links were found, all is done again with more cells for each node and a wider beam; with all of both, nothing is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnseek.llm import flat_graph
from tarnseek.llm.arrow_groups import slices
from tarnseek.llm.common import components, written
from tarnseek.llm.flat_graph import FlatGraph
from tarnseek.llm.simhash import _least_linked

THRESHOLD = 0.9
#: Nodes of a shard at most (about), and nodes for each centre before they overlap.
SHARD_ROWS = 2048
CELL_ROWS = 1024
#: Centres at most, and rows of the sample they are fitted on, for each centre.
MAX_CENTRES = 4096
SAMPLE_ROWS = 8
#: Cells that a node goes to at first.
OVERLAP = 3
BEAM = 48
#: Nodes whose links are counted by brute force, and the share of their links that must be found.
AUDITED = 1024
MIN_RECALL = 0.97
_QUERIES = 256
_MEMBER, _SEARCH = 0, 1


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; first divided by their largest part, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(embedding: Column) -> Column:
    """Whether a vector is not null, has parts, all of them finite, and isn't zero."""
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, dim, embedding, copies, first_id) of each distinct usable vector; a written table, whose numbers stay."""
    distinct = vectors.where(usable(F.col("embedding"))).groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    return written(distinct.select(F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("dim"), "embedding", "copies", "first_id"), "graph-nodes")


def _routed(rows: np.ndarray, width: int) -> np.ndarray:
    """The vectors as the centres see them: cut or filled up to one length."""
    if rows.shape[1] < width:
        rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    return rows[:, :width].astype(np.float32)


def _sampled(hashed: Column, share: float) -> Column:
    """True for about this share of the hashes."""
    return F.pmod(hashed, F.lit(1 << 40)) < F.lit(math.ceil(share * (1 << 40)))


def fitted_centres(nodes: DataFrame, total: int, cell_rows: int = CELL_ROWS) -> np.ndarray:
    """Centres by k-means on a sample of nodes of the most frequent length, taken by their hashes: at most MAX_CENTRES * SAMPLE_ROWS."""
    many = int(np.clip(round(total / cell_rows), 1, MAX_CENTRES))
    dim = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]
    share = min(1.0, 1.5 * many * SAMPLE_ROWS / total)
    hashed = F.xxhash64("embedding")
    sample = nodes.where((F.col("dim") == dim) & _sampled(hashed, share)).select(hashed.alias("h"), "embedding").toArrow()
    sample = sample.take(np.argsort(sample.column("h").to_numpy(), kind="stable")[: many * SAMPLE_ROWS]).combine_chunks()
    if not len(sample):
        return np.zeros((1, dim), np.float32)
    points = unit(_matrix(sample.column("embedding").combine_chunks())).astype(np.float32)
    centres = points[:many].copy()
    for _ in range(8):
        cell = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, points)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def routed(nodes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """``nodes`` with ``cells``: the numbers of the nearest centres, in ascending order."""
    sent = nodes.sparkSession.sparkContext.broadcast(centres)
    overlap = min(overlap, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for _, rows in slices(batches, ["dim"], 4096):
            near = -(_routed(unit(_matrix(rows.column("embedding"))), c.shape[1]) @ c.T)
            cells = np.sort(np.argpartition(near, overlap - 1, axis=1)[:, :overlap].astype(np.int32), axis=1)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * overlap), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(n) for n in ("node", "dim", "embedding", "copies")] + [listed], names=["node", "dim", "embedding", "copies", "cells"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    return nodes.select("node", "dim", "embedding", "copies").mapInArrow(run, f"node long, dim int, embedding {kind}, copies long, cells array<int>")


class _Shard:
    """The members of a shard as they come in."""

    def __init__(self):
        self.batches: list[pa.RecordBatch] = []

    def add(self, rows: pa.RecordBatch) -> None:
        self.batches.append(rows)

    def column(self, name: str) -> pa.Array:
        return pa.chunked_array([b.column(name) for b in self.batches]).combine_chunks()

    def vectors(self) -> np.ndarray:
        return unit(_matrix(self.column("embedding")))


_SHARD = ["cell", "dim", "part"]


def _shards(rows: DataFrame, shard_rows: int) -> DataFrame:
    """A row for each node and cell: cell, own (the node's part of it), node, dim, embedding, copies, cells."""
    rows = rows.select("*", F.explode("cells").alias("cell"))
    sizes = rows.groupBy("cell", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    sizes = written(sizes, "graph-cells")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    return rows.join(sizes, ["cell", "dim"]).withColumn("own", own).drop("parts")


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, neighbours) from the graph of each shard."""

    def graph_of(shard: _Shard) -> pa.RecordBatch:
        node = shard.column("node").to_numpy()
        edges = FlatGraph.build(shard.vectors().astype(np.float32)).edges
        ends = np.concatenate(([0], np.cumsum((edges >= 0).sum(axis=1)))).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(node[edges[edges >= 0]]))
        return pa.RecordBatch.from_arrays([pa.array(node), listed], names=["node", "neighbours"])

    key, shard = None, _Shard()
    for at, rows in slices(batches, _SHARD):
        if at != key:
            if shard.batches:
                yield graph_of(shard)
            key, shard = at, _Shard()
        shard.add(rows)
    if shard.batches:
        yield graph_of(shard)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.int64()), ("links", pa.int64())])


def _found(a, b, near, links) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, near, links)], schema=_FOUND)


def _first_shared(cell: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether two rows of ascending cells share none before ``cell``."""
    earlier = (left[:, :, None] == right[:, None, :]) & (left[:, :, None] < cell)
    return ~earlier.any(axis=(1, 2))


class _Search:
    """A shard that is searched: its members with the united lists of neighbours among them."""

    def __init__(self, cell: int, shard: _Shard, threshold: float, beam: int):
        order = np.argsort(shard.column("node").to_numpy(), kind="stable")
        self.cell, self.threshold, self.beam = cell, threshold, beam
        self.node = shard.column("node").to_numpy()[order]
        self.copies = shard.column("copies").to_numpy()[order]
        self.vectors = shard.vectors()[order]
        self.cells = _matrix(shard.column("cells")).astype(np.int32)[order]
        lists = shard.column("neighbours").take(pa.array(order))
        flat = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.node, flat), len(self.node) - 1)
        here = self.node[at] == flat
        row = np.repeat(np.arange(len(order)), np.diff(lists.offsets.to_numpy()))[here]
        edges = flat_graph._padded(row, at[here].astype(np.int32), len(order), np.int32(-1))
        self.graph = FlatGraph(self.vectors.astype(np.float32), edges if edges.shape[1] else np.full((len(order), 1), -1, np.int32))

    def reached(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The members that each query reaches, with an exact cosine high enough, and whose first shared cell this is."""
        found = self.graph.within(vectors.astype(np.float32), self.threshold - 1e-5, self.beam)
        row, col = np.nonzero(found)
        for at in range(0, len(row), 1 << 16):
            r, c = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
            good = np.einsum("nd,nd->n", vectors[r], self.vectors[c]) >= self.threshold
            good[good] = _first_shared(self.cell, cells[r[good]], self.cells[c[good]])
            found[r, c] = good
        return found

    def among_members(self) -> Iterator[pa.RecordBatch]:
        n = len(self.node)
        found = np.zeros((n, n), bool)
        for at in range(0, n, _QUERIES):
            found[at : at + _QUERIES] = self.reached(self.vectors[at : at + _QUERIES], self.cells[at : at + _QUERIES])
        # A link found from one end is one from both.
        found |= found.T
        np.fill_diagonal(found, False)
        label = _least_linked(n, [np.nonzero(found)])
        near = found.sum(axis=1)
        has = np.flatnonzero(near)
        yield _found(self.node[has], self.node[label[has]], near[has], found[has] @ self.copies)

    def by_others(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Links between members and nodes of later parts of the cell."""
        all_nodes, all_copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        all_vectors, all_cells = unit(_matrix(rows.column("embedding"))), _matrix(rows.column("cells")).astype(np.int32)
        for at in range(0, len(all_nodes), _QUERIES):
            cut = slice(at, at + _QUERIES)
            node, copies = all_nodes[cut], all_copies[cut]
            found = self.reached(all_vectors[cut], all_cells[cut])
            row, col = np.nonzero(found)
            if not len(row):
                continue
            label = _least_linked(len(node) + len(self.node), [(row, len(node) + col)])
            everyone = np.concatenate((node, self.node))
            near = np.concatenate((found.sum(axis=1), found.sum(axis=0)))
            links = np.concatenate((found @ self.copies, found.T @ copies))
            has = np.flatnonzero(near)
            yield _found(everyone[has], everyone[label[has]], near[has], links[has])


def _searched(threshold: float, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, search = None, _Shard(), None
        for at, rows in slices(batches, [*_SHARD, "role"], 4096):
            if at[:3] != key:
                if shard.batches and search is None:
                    yield from _Search(key[0], shard, threshold, beam).among_members()
                key, shard, search = at[:3], _Shard(), None
            if at[3] == _MEMBER:
                shard.add(rows)
                continue
            if search is None:
                search = _Search(key[0], shard, threshold, beam)
                yield from search.among_members()
            yield from search.by_others(rows)
        if shard.batches and search is None:
            yield from _Search(key[0], shard, threshold, beam).among_members()

    return run


def links(nodes: DataFrame, centres: np.ndarray, threshold: float, overlap: int, beam: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b, near, links), a row for each node and shard in which it has links: ``near`` other nodes with ``links`` vectors in all,
    and b, the first of its group there."""
    rows = written(_shards(routed(nodes, centres, overlap), shard_rows), "graph-shards")
    members = rows.withColumn("part", F.col("own")).select(*_SHARD, "node", "embedding")
    built = members.repartition(*_SHARD).sortWithinPartitions(*_SHARD, "node").mapInArrow(_built, "node long, neighbours array<long>")
    # A node has a list from each of its cells.
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    united = written(united, "graph-lists")
    columns = [*_SHARD, "role", "node", "embedding", "copies", "cells"]
    members = rows.join(united, "node").withColumns({"part": F.col("own"), "role": F.lit(_MEMBER)}).select(*columns, "neighbours")
    others = rows.where("own > 0").withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("own") - 1)), "role": F.lit(_SEARCH)})
    others = others.select(*columns, F.array().cast("array<long>").alias("neighbours"))
    dealt = members.union(others).repartition(*_SHARD).sortWithinPartitions(*_SHARD, "role", "node")
    return dealt.mapInArrow(_searched(threshold, beam), "a long, b long, near long, links long")


def brute_force(nodes: DataFrame, queries: pa.Table, threshold: float) -> DataFrame:
    """(node, exact): for each of the given nodes (node, embedding; few) how many others have a cosine of at least ``threshold``."""
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    lengths = np.array([len(x) for x in queries.column("embedding")])
    for d in np.unique(lengths).tolist():
        some = queries.filter(pa.array(lengths == d)).combine_chunks()
        by_length[d] = some.column("node").to_numpy(), unit(_matrix(some.column("embedding").combine_chunks()))
    sent = nodes.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = {d: np.zeros(len(q[0]), np.int64) for d, q in sent.value.items()}
        for (d,), rows in slices(batches, ["dim"], 2048):
            if d in many:
                node, vectors = sent.value[d]
                near = unit(_matrix(rows.column("embedding"))) @ vectors.T >= threshold
                many[d] += (near & (rows.column("node").to_numpy()[:, None] != node)).sum(axis=0)
        for d, count in many.items():
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[d][0]), pa.array(count)], names=["node", "exact"])

    counts = nodes.select("node", "dim", "embedding").mapInArrow(run, "node long, exact long")
    return counts.groupBy("node").agg(F.sum("exact").alias("exact"))


def audit(nodes: DataFrame, total: int, counts: DataFrame, threshold: float, rows: int = AUDITED) -> float:
    """The share of the links of at most ``rows`` nodes, picked by hash, that are in ``counts`` (a, near); 1 if they have none.

    Every node counts alike: shares are averaged over the picked nodes that have links.
    """
    share = min(1.0, 1.5 * rows / max(1, total))
    hashed = F.xxhash64(F.lit(1), "embedding")
    picked = nodes.where(_sampled(hashed, share)).select("node", "embedding").toArrow().slice(0, rows).combine_chunks()
    if not len(picked):
        return 1.0
    exact = brute_force(nodes, picked, threshold).where("exact > 0")
    seen = exact.join(counts.select(F.col("a").alias("node"), "near"), "node", "left")
    return seen.agg(F.avg(F.coalesce("near", F.lit(0)) / F.col("exact"))).first()[0] or (1.0 if exact.isEmpty() else 0.0)


def linked(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, beam: int = BEAM, min_recall: float = MIN_RECALL,
           cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, float]:
    """(nodes, links, audited recall): the distinct vectors, and (a, near, links, root) of each that has links."""
    nodes = nodes_of(vectors)
    total = nodes.count()
    if not total:
        none = nodes.sparkSession.createDataFrame([], "a long, near long, links long, root long")
        return nodes, none, 1.0
    centres = fitted_centres(nodes, total, cell_rows)
    while True:
        found = written(links(nodes, centres, threshold, overlap, beam, shard_rows), "graph-links")
        counts = written(found.groupBy("a").agg(F.sum("near").alias("near"), F.sum("links").alias("links")), "graph-counts")
        recall = audit(nodes, total, counts, threshold)
        everything = overlap >= len(centres) and beam >= 2 * shard_rows
        if recall >= min_recall or everything:
            break
        overlap, beam = min(2 * overlap, len(centres)), min(2 * beam, 2 * shard_rows)
    roots = components(found.select("a", "b"), "graph-components").select(F.col("node").alias("a"), "root")
    return nodes, written(counts.join(roots, "a", "left").withColumn("root", F.coalesce("root", "a")), "graph-linked"), recall


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    Vectors link if their cosine, in double precision, is at least ``threshold``; equal vectors do. Null, empty and zero
    vectors, and those with null or non-finite parts, link with nothing, and vectors of different lengths don't link with
    each other. n_links counts the other rows linked directly, repeated rows and rows of one vec_id each on their own. component_id is the
    smallest vec_id that links lead to, its own included; null ids don't count unless all are null. kept says that the row's id is
    that one. All rows stay; other columns aren't read; an empty table gives an empty one.

    All links found are real; the share found is audited (see ``linked``) and at least ``MIN_RECALL`` of those of the audited nodes.
    """
    rows = vectors.select("vec_id", "embedding")
    nodes, found, _ = linked(rows, threshold, **settings)
    table = nodes.join(found, nodes["node"] == found["a"], "left").withColumn("root", F.coalesce("root", "node"))
    table = table.select("embedding", "first_id", "copies", "root", F.coalesce("links", F.lit(0)).alias("links"))
    table = written(table, "graph-classes")
    least = table.groupBy("root").agg(F.min("first_id").alias("component_id"))
    n_links = (F.col("links") + F.col("copies") - 1).alias("n_links")
    table = written(table.join(least, "root").select("embedding", n_links, "component_id"), "graph-classes")
    good = usable(F.col("embedding"))
    with_links = rows.where(good).join(table, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = reduce(DataFrame.unionByName, [with_links, alone])
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
