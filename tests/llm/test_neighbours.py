import numpy as np

from sextant.llm import neighbours as n


def clustered(rng, rows, dim=16, spread=0.25):
    centres = rng.normal(size=(rows // 10, dim))
    return centres[rng.integers(len(centres), size=rows)] + spread * rng.normal(size=(rows, dim))


def frame(spark, vectors, start=1):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None, "x") for i, v in enumerate(vectors, start)], "seq bigint, vector array<float>, rep string")


def exact(vectors, k):
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 1500) * rng.uniform(0.5, 20, size=(1500, 1))
    s, best = exact(x, 5)
    got = n.most_similar(frame(spark, x), 5, 16).toPandas()
    pairs = set(zip(got.seq - 1, got.other - 1))
    want = {(i, j) for i in range(len(x)) for j in best[i]}
    assert len(pairs & want) / len(want) >= 0.95
    assert (got.groupby("seq").size() == 5).all()
    assert np.allclose(got.similarity, s[got.seq - 1, got.other - 1], atol=1e-5)
    floor = n.most_similar(frame(spark, x), 5, 16, floor=0.9).toPandas()
    near = {(i, j) for i, j in want if s[i, j] >= 0.9}
    assert len(set(zip(floor.seq - 1, floor.other - 1)) & near) / len(near) >= 0.95 and (floor.similarity >= 0.9).all()


def test_hot_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 16))
    x[:40] = x[0] * rng.uniform(1, 9, size=(40, 1))  # a third points the same way
    x[40:43] = x[40]
    rows = [*x, None, [0.0] * 16, [1.0] * 8, [float("nan")] * 16, []]
    got = n.most_similar(frame(spark, rows), 5, 16).toPandas()
    assert got.seq.max() == 120 and (got.groupby("seq").size() == 5).all()
    hot = got[got.seq <= 40]
    assert (hot.other <= 40).all() and (hot.seq != hot.other).all()
    three = got[got.seq.isin([41, 42, 43]) & (got["rank"] <= 2)]
    assert set(three.other) == {41, 42, 43}
    pairs = n.similar_pairs(n.most_similar(frame(spark, rows), 5, 16, floor=0.99)).collect()
    assert all(r["seq_a"] < r["seq_b"] for r in pairs) and len(pairs) < 40 * 6


def test_crowded_cells_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 40)
    rng = np.random.default_rng(6)
    x = np.concatenate([1.0 + 0.2 * rng.normal(size=(300, 16)), rng.normal(size=(60, 16))])
    _, best = exact(x, 3)
    got = n.most_similar(frame(spark, x), 3, 16, probes=100, rerank=60).toPandas()
    want = {(i, j) for i in range(len(x)) for j in best[i]}
    assert len(set(zip(got.seq - 1, got.other - 1)) & want) / len(want) >= 0.9


def test_hot_group_of_near_but_not_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(n, "PASS", 700, raising=False)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=(600, 64))
    cosine = rng.uniform(0.95, 0.998, size=600)
    away -= (away @ x[0])[:, None] * x[0]
    x[:600] = cosine[:, None] * x[0] + np.sqrt(1 - cosine**2)[:, None] * away / np.linalg.norm(away, axis=1, keepdims=True)
    s, best = exact(x, 5)
    want = {(i, j) for i in range(len(x)) for j in best[i] if s[i, j] >= 0.88}
    got = n.most_similar(frame(spark, x), 5, 64, floor=0.88).toPandas()
    assert len(want) == 3000 and set(zip(got.seq - 1, got.other - 1)) == want and len(got) == len(want)


def test_exact_without_a_floor(spark):
    x = np.random.default_rng(10).normal(size=(900, 64))  # no clusters: true neighbours lie in cells far apart
    _, best = exact(x, 5)
    got = n.most_similar(frame(spark, x), 5, 64).toPandas()
    assert set(zip(got.seq - 1, got.other - 1)) == {(i, j) for i in range(len(x)) for j in best[i]}


def test_small_tables(spark):
    assert n.most_similar(frame(spark, []), 5, 16).count() == 0
    assert n.most_similar(frame(spark, [np.ones(16)]), 5, 16).count() == 0
    two = n.most_similar(frame(spark, [np.ones(16), np.arange(16.0)]), 5, 16).collect()
    assert sorted((r["seq"], r["other"], r["rank"]) for r in two) == [(1, 2, 1), (2, 1, 1)]


def test_vectors_leave_the_disk_when_the_codes_are_written(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    monkeypatch.setattr("sextant.session.shared_folder", lambda _: folder)
    x = np.random.default_rng(11).normal(size=(300, 16))
    x[1] = x[0]
    got = n.most_similar(frame(spark, x), 5, 16).toPandas()
    assert (got.groupby("seq").size() == 5).all()
    kept = {p.parent.parent.name.split("-")[1] for p in tmp_path.rglob("*.parquet")}
    assert "codes" in kept and "vectors" not in kept


def test_completing_search_multiplies_groups_once(spark, monkeypatch):
    monkeypatch.setattr(n, "PASS", 600)
    monkeypatch.setattr(n, "MOST_PASS", 600, raising=False)
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(300, 64)), 8, axis=0) + 0.22 * rng.normal(size=(2400, 64))
    x[:200] = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s, best = exact(x, 5)
    want = {(i, j) for i in range(len(x)) for j in best[i] if s[i, j] >= 0.88}
    turns = []
    completed = n._completed
    monkeypatch.setattr(n, "_completed", lambda *a: turns.append((a[1].value, a[5])) or completed(*a))
    got = n.most_similar(frame(spark, x), 5, 64, floor=0.88).toPandas()
    assert set(zip(got.seq - 1, got.other - 1)) == want and len(got) == len(want)
    assert [now for _, now in turns] == [0, 1, 2, 3] and sum(len(s.rep) for s, _ in turns) == len(x)
    assert sum(len(s.middle) for s, _ in turns) < 0.35 * len(x)  # of each the search multiplies the middle, not the members
    space = np.empty((n.QUERIES, n.BLOCK), np.float32)
    for source, _ in turns:
        asking = slice(0, 8)
        assert n._open_groups(source.middle[asking, :-1], source.radius[asking], source.reach[asking], source, space).mean() < 0.2
