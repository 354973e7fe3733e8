"""Graph search against brute force."""

import collections

import numpy as np
import pytest
from llm_cases import FOLDER
from pyspark.sql import functions as F

from tributary.llm.graph_index import Graph, distances, search


def exact(ids, vectors, query, k=10):
    dist = np.sqrt(((vectors - vectors[ids == query][0]) ** 2).sum(axis=1))
    other = ids != query
    order = np.lexsort((ids[other], dist[other]))[:k]
    return list(zip(ids[other][order].tolist(), dist[other][order].tolist()))


def test_recall_and_scores(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").withColumn("rank", F.lit("clash"))
    pandas = table.toPandas()
    ids, vectors = pandas.vec_id.to_numpy(), np.stack(pandas.embedding.to_numpy()).astype(float)
    found = collections.defaultdict(list)
    for r in sorted(search(table, table.where("vec_id % 10 = 0"), shard_rows=100).collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for query in ids[ids % 10 == 0]:
        want = exact(ids, vectors, query)
        hits += len({i for i, _ in want} & {i for i, _ in found[query]})
        total += len(want)
        assert all(abs(s - np.sqrt(((vectors[ids == i][0] - vectors[ids == query][0]) ** 2).sum())) < 1e-12 for i, s in found[query])
    assert hits / total >= 0.9


def test_odd_vectors_ties_and_few_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [1.0, None]), (8, []),
            (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (1, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in search(table, table).collect())
    root = round(2**0.5, 6)
    want = []
    for q, near in ((0, [(1, 0.0), (2, 0.0), (3, root)]), (1, [(0, 0.0), (2, 0.0), (3, root)]), (2, [(0, 0.0), (1, 0.0), (3, root)]), (3, [(0, root), (1, root), (2, root)])):
        want += [(q, i + 1, v, s) for i, (v, s) in enumerate(near)]
    assert got == want
    assert search(table.limit(0), table.limit(0)).count() == 0


def test_many_copies_of_a_vector(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(300 + i, [float(i), 1.0]) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = [r.vec_id for r in sorted(search(table, table.where("vec_id = 200")).collect(), key=lambda r: r["rank"])]
    assert got == list(range(10))


def test_a_graph_prunes_what_lies_behind(spark):
    line = np.array([[float(i), 1.0] for i in range(1, 60)])
    graph = Graph(line, degree=4)
    assert (graph.edges >= 0).sum(axis=1).max() <= 4
    near, _ = graph.search(line.astype(np.float32) / line.max().astype(np.float32), 8)
    assert (near[:, 0] == np.arange(59)).mean() > 0.9


@pytest.mark.parametrize(("clusters", "spread"), [(2, 0.01), (2, 0.5), (4, 0.01), (8, 0.1), (40, 0.3)])
def test_recall_on_clusters(spark, clusters, spread):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 64))
    vectors = centres[rng.integers(clusters, size=4096)] + spread * rng.normal(size=(4096, 64))
    ids = np.arange(4096)
    table = spark.createDataFrame(list(zip(ids.tolist(), vectors.tolist())), "vec_id long, embedding array<double>").repartition(4)
    found = collections.defaultdict(set)
    for r in search(table, table.where("vec_id % 64 = 0")).collect():
        found[r.query_id].add(r.vec_id)
    hits = sum(len({i for i, _ in exact(ids, vectors, q)} & found[q]) for q in ids[::64].tolist())
    assert hits / (10 * len(ids[::64])) >= 0.95


def test_distances_beyond_the_square_root_of_the_largest_number():
    x = np.array([[1e200, 0.0], [3.0, 4.0], [1.5e308, 1.0]])
    assert distances(x, np.zeros(2)).tolist() == [1e200, 5.0, 1.5e308]
    assert distances(x, np.array([-1e200, 0.0]))[0] == 2e200
