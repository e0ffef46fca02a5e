import numpy as np

from heatwise.llm import annlink
from heatwise.llm.annlink import link_vectors


def brute(rows, threshold=0.93):
    """{id: (links, component)} by all pairs of rows."""
    ok = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = (np.array(v, dtype=np.float64), label)
    links, parent = {i: 0 for i in ok}, {i: i for i in ok}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    groups = {}
    for i, (v, label) in ok.items():
        groups.setdefault((label, len(v)), []).append(i)
    for ids in groups.values():
        x = np.stack([ok[i][0] for i in ids])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            links[ids[a]] += 1
            links[ids[b]] += 1
            p, q = root(ids[a]), root(ids[b])
            parent[max(p, q)] = min(p, q)
    return {i: (links.get(i, 0), root(i) if i in ok else i) for i, _, _ in rows}


def test_embeddings_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    report = {}
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(df, report=report).collect()}
    want = brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
    assert got == want and report["recall"] in (None, 1.0)


def test_chains_cliques_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(annlink, "BLOCK", 64)
    monkeypatch.setattr(annlink, "PER_CENTRE", 100)
    rng = np.random.default_rng(2)
    rows = []
    base = rng.normal(size=16)
    for k in range(150):                                              # a clique over several blocks
        rows.append((base + rng.normal(size=16) * 0.05, 1))
    for k in range(60):                                               # a chain: only neighbours link
        t = k * 0.3
        rows.append((np.concatenate([[np.cos(t), np.sin(t)], np.zeros(13), [k // 20 * 3.0]]), 2))
    rows += [(rng.normal(size=16), int(rng.integers(1, 4))) for _ in range(300)]
    rows += rows[:20] + rows[:5]                                      # exact copies
    data = [(1000 + 7 * i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(df).collect()}
    want = brute(data)
    missing = sum(w[0] for w in want.values()) - sum(g[0] for g in got.values())
    assert 0 <= missing <= 0.02 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.98


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "b"), (3, [1.0, 0.0], None, "c"), (4, None, 1, "d"), (5, [0.0, 0.0], 1, "e"),
            (6, [nan, 1.0], 1, "f"), (7, [inf, 1.0], 1, "g"), (8, [None, 1.0], 1, "h"), (9, [], 1, "i"), (10, [1.0, 0.0], 2, "j"),
            (11, [1.0, 0.0, 0.0], 1, "k"), (2, [2.0, 0.0], 1, "b"), (12, [1.0, 0.0], 1, "l"), (None, [1.0, 0.0], 1, "m"),
            (13, [1e-200, 0.0], 1, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    got = [tuple(r) for r in link_vectors(df).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r[1:] for r in got}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[12] == (3, 1, False) and by[13][1] == 1
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert by[None] == (0, None, True)
    assert link_vectors(df.where("false")).count() == 0


def test_pruned_graph_reaches_the_range():
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(40, 24))
    x = np.repeat(centre, 25, axis=0) + rng.normal(size=(1000, 24)) * 0.25
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = annlink.prune(x)
    assert graph.shape == (1000, annlink.DEGREE) and (graph[:, 0] >= 0).all() and (graph < 0).any()
    a, b = annlink.range_search(x, graph, np.arange(1000), 0.93)
    found = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    want = set(zip(*map(lambda v: v.tolist(), np.nonzero(np.triu(x @ x.T >= 0.93, 1)))))
    assert want and len(want - found) <= 0.01 * len(want)


def _tight_groups(groups, size, dims):
    """Groups of near-identical vectors whose centres have cosine 0.96 with each other."""
    rng = np.random.default_rng(5)
    own = np.linalg.qr(rng.normal(size=(dims, groups + 1)))[0].T
    centre = np.sqrt(0.96) * own[0] + np.sqrt(0.04) * own[1:]
    x = np.repeat(centre, size, axis=0) + rng.normal(size=(groups * size, dims)) * 1e-4
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_links_between_tight_groups():
    for groups, size, dims in ((6, 60, 64), (4, 100, 128)):
        x = _tight_groups(groups, size, dims)
        m = len(x)
        lists = annlink.neighbours(x)
        graph = np.full((m, max(map(len, lists))), -1)
        for i, r in enumerate(lists):
            graph[i, :len(r)] = r
        a, b = annlink.range_search(x, graph, np.arange(m), 0.93)
        assert len(np.unique(np.minimum(a, b) * m + np.maximum(a, b))) >= 0.98 * m * (m - 1) / 2
        a, b = annlink.all_pairs(x, 0.93)
        assert len(a) == m * (m - 1) // 2
        key = np.sort(a * m + b)
        assert annlink._complete(x, key, 0.93) and not annlink._complete(x, key[key // m % 2 == 0], 0.93)


def test_lost_links_are_compared_exactly(spark, monkeypatch):
    x = _tight_groups(6, 60, 64)
    data = [(i, x[i].tolist(), 1) for i in range(len(x))] + [(1000 + i, x[0].tolist(), 1) for i in range(400)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    want = brute(data)
    assert {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(df).collect()} == want
    monkeypatch.setattr(annlink, "_complete", lambda *a: True)
    monkeypatch.setattr(annlink, "range_search", lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    report = {}
    assert {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(df, report=report).collect()} == want
    assert report["exact"] and report["recall"] == 1.0


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "de"), (2, [1.0, 0.01], "de"), (3, [1.0, 0.0], "fr"), (4, [1.0, 0.0], None), (5, [1.0, 0.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert sorted(tuple(r) for r in link_vectors(df).collect()) == [
        (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
