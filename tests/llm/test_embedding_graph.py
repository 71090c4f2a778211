import math
from collections import Counter

import numpy as np
import pytest

from tarnseek.llm import embedding_graph, flat_graph
from tarnseek.llm.registered import QUERIES
from tests.compare import TESTDATA
from tests.llm.helpers import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow_rows(vectors, threshold=0.9):
    """(vec_id, links, least id, kept) by comparing all pairs."""
    good = [i for i, (_, v, *_) in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    label = list(range(len(vectors)))
    links = [0] * len(vectors)
    for d in {len(vectors[i][1]) for i in good}:
        of = [i for i in good if len(vectors[i][1]) == d]
        m = np.array([vectors[i][1] for i in of], np.float64)
        m /= np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        near = m @ m.T >= threshold
        np.fill_diagonal(near, False)
        for i, row in zip(of, near):
            links[i] = int(row.sum())
        # Components by spreading the least label.
        at = np.arange(len(of))
        while True:
            low = np.minimum(at, np.where(near, at[None, :], len(of)).min(axis=1, initial=len(of)))
            if (low == at).all():
                break
            at = low
        for k, i in enumerate(of):
            label[i] = of[at[k]]
    least = {}
    for i, (doc, *_) in enumerate(vectors):
        if doc is not None:
            least[label[i]] = min(doc, least.get(label[i], doc))
    return Counter((doc, links[i], least.get(label[i]), doc == least.get(label[i])) for i, (doc, *_) in enumerate(vectors))


def crowd(rng, groups, alone, dim=64):
    """Groups of near copies of a vector among vectors of their own."""
    out = []
    for size in groups:
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            noise = rng.normal(size=dim)
            out.append(centre + 0.2 * noise / np.linalg.norm(noise))
    return np.concatenate((np.array(out).reshape(-1, dim), rng.normal(size=(alone, dim)))).astype(np.float32)


def table(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], SCHEMA)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(QUERIES["op12_embedding_near_dedup"](spark, f"{TESTDATA}/{sf}")) == slow_rows(rows)


def test_recall_over_overlapping_shards(spark):
    """Many small cells and shards: nearly all links are found, and none that isn't one."""
    vectors = crowd(np.random.default_rng(4), [2] * 60 + [5] * 20 + [300], 1500)
    df = table(spark, vectors)
    got = {r["vec_id"]: r for r in embedding_graph.near_duplicates(df, cell_rows=100, shard_rows=150).collect()}
    exact = {r[0]: r for r in slow_rows([(i, v.tolist()) for i, v in enumerate(vectors)])}
    assert len(got) == len(vectors)
    assert all(got[i]["n_links"] <= exact[i][1] for i in got)
    with_links = [i for i in exact if exact[i][1]]
    assert np.mean([got[i]["n_links"] / exact[i][1] for i in with_links]) >= 0.95
    assert sum(got[i]["component_id"] == exact[i][2] for i in with_links) >= 0.97 * len(with_links)
    assert all(got[i]["kept"] == (i == got[i]["component_id"]) for i in got)


def test_audit_widens_until_enough_is_found(spark):
    """One cell for each node and a beam of one find too little at first."""
    vectors = crowd(np.random.default_rng(6), [2] * 150, 300)
    df = table(spark, vectors)
    settings = {"cell_rows": 30, "shard_rows": 60, "overlap": 1, "beam": 1}
    *_, low = embedding_graph.linked(df, min_recall=0.0, **settings)
    *_, high = embedding_graph.linked(df, min_recall=0.999, **settings)
    assert low < 0.9 <= 0.99 < high


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (9, [2.0, 0.1, 0.0]), (2**60 + 1, [0.0, 1.0, 0.0]),
        (2**60 + 3, [0.0, 3.0, -0.0]), (None, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, -1.0]), (7, None), (7, []), (8, [0.0, 0.0, 0.0]), (10, [nan, 1.0, 0.0]),
        (11, [inf, 1.0, 0.0]), (12, [None, 1.0, 0.0]), (13, [1.0, 0.0]), (14, [1e-38, 0.0, 0.0]), (15, [3e38, 3e37, 0.0]), (16, [1.0]), (17, [-1.0]), (None, None),
    ]
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], "vec_id long, embedding array<float>, node string, a string, links string")
    exact = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v in rows]
    assert rows_of(embedding_graph.near_duplicates(df)) == slow_rows(exact)


def test_many_copies_of_one_vector(spark):
    vectors = [[1.0, 2.0, 3.0]] * 500 + [[1.0, 2.0, 3.001]] * 300 + [[-1.0, 0.0, 0.0]]
    got = Counter((r["n_links"], r["component_id"]) for r in embedding_graph.near_duplicates(table(spark, vectors)).collect())
    assert got == {(799, 0): 800, (0, 800): 1}


def test_empty_and_unusable_tables(spark):
    assert embedding_graph.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], SCHEMA)
    assert rows_of(embedding_graph.near_duplicates(only)) == {(1, 0, 1, True): 1, (2, 0, 2, True): 1}


def test_graph_edges_are_bounded_and_range_search_is_whole_within_a_group():
    points = crowd(np.random.default_rng(2), [700], 800)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    graph = flat_graph.FlatGraph.build(points)
    assert graph.edges.shape == (1500, flat_graph.DEGREE)
    assert all(len(set(e[e >= 0])) == (e >= 0).sum() and i not in e for i, e in enumerate(graph.edges))
    exact = points @ points.T >= 0.9
    found = graph.within(points, 0.9)
    assert (found <= exact).all()
    assert ((found | found.T) & exact).sum() >= 0.99 * exact.sum()
