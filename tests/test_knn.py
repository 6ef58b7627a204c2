import numpy as np
import pytest

from citeloom.operators.knn import vector_matches, vector_search


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).round(3)
    x[50] = x[7]  # copies must tie
    x[51] = 2 * x[7]
    x[60] = 0
    q = rng.normal(size=(9, 8)).round(3)
    q[0] = x[7]
    scope = [("a", "b", "c")[i % 3] for i in range(300)]
    corpus = spark.createDataFrame([(i, [float(v) for v in x[i]], scope[i]) for i in range(300)], "id long, vector array<float>, scope string").repartition(5)
    queries = spark.createDataFrame([(i, [float(v) for v in q[i]], "a" if i % 2 else None) for i in range(9)], "query_id long, vector array<float>, scope string")
    return x.astype("float32").astype(float), q.astype("float32").astype(float), scope, corpus, queries


def expected(x, q, scope, k):
    norms = np.linalg.norm(x, axis=1)
    out = {}
    for i, v in enumerate(q):
        s = np.round(np.divide(x @ v, norms * np.linalg.norm(v), out=np.zeros(len(x)), where=norms > 0), 9)
        rows = [j for j in range(len(x)) if i % 2 == 0 or scope[j] == "a"]
        out[i] = sorted(rows, key=lambda j: (-s[j], j))[:k]
    return out


@pytest.mark.parametrize("bound", [None, 2])
def test_search_equals_brute_force(data, bound):
    x, q, scope, corpus, queries = data
    got = {}
    for r in vector_search(corpus, queries, 7, 8, bound).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == expected(x, q, scope, 7)
    assert got[0][:3] == [7, 50, 51]


def test_fewer_rows_than_k_and_no_queries(data):
    _, _, _, corpus, queries = data
    assert vector_search(corpus.filter("id < 3"), queries.filter("query_id = 0"), 10, 8).count() == 3
    assert vector_search(corpus, queries.filter("query_id < 0"), 10, 8).count() == 0


def test_matches_above_floor(data):
    x, q, _, corpus, queries = data
    got = {(r.query_id, r.id) for r in vector_matches(corpus, queries.drop("scope"), 0.55, 8).collect()}
    norms = np.linalg.norm(x, axis=1)
    want = set()
    for i, v in enumerate(q):
        s = np.round(np.divide(x @ v, norms * np.linalg.norm(v), out=np.zeros(len(x)), where=norms > 0), 9)
        want |= {(i, int(j)) for j in np.flatnonzero(s > 0.55)}
    assert got == want
