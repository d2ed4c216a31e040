"""kNN against brute force, SMOTE invariants, stores and file round trips."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorum.operators import neighbours as N
from quorum.operators.neighbours import knn_join, smote


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(str(i), [float(x) for x in p]) for i, p in enumerate(pts)], "id string, v array<double>")
    got = knn_join(df, df, 4, "id", "v", exclude_self=True, tile_rows=70).collect()
    by_q = {}
    for r in got:
        by_q.setdefault(r["qid"], []).append((r["rank"], r["rid"]))
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(300):
        want = [str(j) for j in np.lexsort((np.array([str(j) for j in range(300)]), d[i]))[:4]]
        assert [rid for _, rid in sorted(by_q[str(i)])] == want


def _brute(q, r, k, exclude):
    """{qid: [rid]} by (distance, rid), ids being the positions as text."""
    names = np.array([str(j) for j in range(len(r))])
    out = {}
    for i, x in enumerate(q):
        d = np.sqrt(((r - x) ** 2).sum(axis=1))
        if exclude:
            d[i] = np.inf
        order = np.lexsort((names, d))[:k]
        out[str(i)] = [str(j) for j in order if np.isfinite(d[j])]
    return out


def _frame(spark, points):
    return spark.createDataFrame([(str(i), [float(x) for x in p]) for i, p in enumerate(points)], "id string, v array<double>")


def _by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["qid"], []).append(r["rid"])
    return out


def test_knn_prunes_tiles_of_clustered_points(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([c + rng.normal(size=(80, 5)) for c in rng.normal(scale=40, size=(12, 5))])
    df, pairs = _frame(spark, pts), []
    got = _by_query(knn_join(df, df, 5, "id", "v", exclude_self=True, tile_rows=60, tile_pairs=pairs))
    assert got == _brute(pts, pts, 5, True)
    scored, every = pairs[0]
    assert scored < every / 2


def test_knn_with_a_hot_cell_of_ties(spark):
    """Half of the rows are one point, others lie on a grid whose distances tie, far from the origin."""
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 4, size=(200, 3)).astype(float)
    pts = np.concatenate([np.tile([1.0, 1.0, 1.0], (200, 1)), grid]) + 1e6
    df = _frame(spark, pts)
    assert _by_query(knn_join(df, df, 7, "id", "v", exclude_self=True, tile_rows=40)) == _brute(pts, pts, 7, True)
    few = _frame(spark, pts[:50])
    assert _by_query(knn_join(df, few, 60, "id", "v", tile_rows=20)) == _brute(pts, pts[:50], 60, False)


def test_queries_of_a_single_tile_are_dealt_to_many_tasks(spark, monkeypatch):
    from quorum.operators import neighbours as N
    sizes = lambda k, exclude: (lambda q, r: pd.DataFrame({"qid": [str(len(q))], "rid": [str(len(r))], "distance": [0.0]}))
    monkeypatch.setattr(N, "_tile_topk", sizes)
    rows = spark.range(6000).coalesce(1)
    asked = rows.select(F.col("id").cast("string").alias("qid"), F.array(F.lit(0.0)).alias("qvec"), F.lit(None).cast("double").alias("kth"),
                        F.lit(0).cast("long").alias("part"), F.array(F.lit(0).cast("long")).alias("tiles"))
    held = rows.select(F.col("id").cast("string").alias("rid"), F.array(F.lit(0.0)).alias("rvec"), F.lit(0).cast("long").alias("tile"))
    got = [(int(r["qid"]), int(r["rid"])) for r in N._score(asked, held, 1, False, 20000).collect()]
    assert len(got) >= 3 and sum(n for n, _ in got) == 6000
    assert all(n == 6000 for _, n in got)  # every block meets all references


def test_pivot_distances_keep_within_their_error():
    from quorum.operators.neighbours import Tiles, pivot_distances, pivot_error
    rng = np.random.default_rng(5)
    for origin, scale in ((0.0, 1.0), (1e6, 1.0), (0.0, 500.0), (1e8, 1e-3)):
        rows = origin + scale * rng.normal(size=(400, 9))
        rows[:50] = rows[0]
        pivots = np.unique(rows[::8], axis=0)
        exact = np.sqrt(((rows[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
        got = pivot_distances(rows, pivots)
        centre = pivots.mean(axis=0)
        norms = np.sqrt(((rows - centre) ** 2).sum(axis=1)), np.sqrt(((pivots - centre) ** 2).sum(axis=1)).max()
        assert (np.abs(got - exact) <= pivot_error(norms[0] + norms[1], np.abs(rows).max(axis=1), 9)[:, None]).all()
        cell = got.argmin(axis=1)
        d = got[np.arange(len(rows)), cell]
        held = np.unique(cell)
        tiles = Tiles(pivots, held, np.array([d[cell == c].min() for c in held]), np.array([d[cell == c].max() for c in held]),
                      np.array([(cell == c).sum() for c in held]))
        low, high = tiles.bounds(rows)
        apart = np.sqrt(((rows[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2))
        for t, c in enumerate(held):
            assert (low[:, t] <= apart[:, cell == c].min(axis=1)).all() and (apart[:, cell == c].max(axis=1) <= high[:, t]).all()


def test_knn_by_probes_has_the_stated_recall(spark):
    rng = np.random.default_rng(3)
    pts = np.concatenate([c + rng.normal(size=(100, 6)) for c in rng.normal(scale=6, size=(8, 6))])
    df, pairs = _frame(spark, pts), []
    got = _by_query(knn_join(df, df, 5, "id", "v", exclude_self=True, tile_rows=50, probes=4, tile_pairs=pairs))
    want = _brute(pts, pts, 5, True)
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.9
    assert pairs[0][0] <= 4 * len(pts)


def test_smote_counts_and_convexity(spark):
    rows = [(f"p{i}", 1, [float(i), float(i % 3)]) for i in range(10)] + \
           [(f"n{i}", 0, [100.0 + i, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, label int, v array<double>")
    syn = smote(df, "id", "label", "v", ratio=0.5, k=3, seed=42)
    out = syn.collect()
    assert len(out) == int(0.5 * 60) - 10
    for r in out:
        x, y = r["v"]
        assert 0.0 <= x <= 9.0 and 0.0 <= y <= 2.0 and r["label"] == 1
    again = sorted((r["id"], tuple(r["v"])) for r in smote(df, "id", "label", "v", ratio=0.5, k=3, seed=42).collect())
    assert again == sorted((r["id"], tuple(r["v"])) for r in out)


def test_results_store_round_trip(spark, tmp_path):
    from quorum.sources.tables import ResultsStore
    store = ResultsStore(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([("m", 1.0)], "model_name string, cost double")
    store.save("r1", {"model_metrics": a})
    store.save("r2", {"model_metrics": a.withColumn("cost", F.lit(2.0))})
    store.save("r1", {"model_metrics": a.withColumn("cost", F.lit(3.0))})
    got = {r["run_id"]: r["cost"] for r in store.load("model_metrics").collect()}
    assert got == {"r1": 3.0, "r2": 2.0}
    store.clear("model_metrics")
    assert store.load("model_metrics").count() == 0


def test_a_run_is_replaced_as_a_whole(spark, tmp_path):
    from quorum.sources.tables import ResultsStore
    store = ResultsStore(spark, str(tmp_path / "store"))

    def frame(x):
        return spark.createDataFrame([("m", float(x)), ("n", float(x))], "model_name string, cost double")

    def held(run="r"):
        return {n: sorted(r["cost"] for r in store.load(n, run).collect()) for n in ("model_metrics", "sweep")}

    store.save("r", {"model_metrics": frame(1), "sweep": frame(1)})
    store.save("other", {"model_metrics": frame(9)})
    broken = frame(2).withColumn("cost", F.when(F.col("model_name") == "n", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("cost")))
    for save in (lambda: store.save("r", {"model_metrics": frame(2), "sweep": broken}),
                 lambda: store.replace_models("r", {"model_metrics": frame(2), "sweep": broken}, ["m", "n"])):
        with pytest.raises(Exception, match="lost"):
            save()
        assert held() == {"model_metrics": [1, 1], "sweep": [1, 1]}
    before = store.load("sweep", "r")
    store.save("r", {"model_metrics": frame(3), "sweep": frame(3)})
    assert held() == {"model_metrics": [3, 3], "sweep": [3, 3]} and before.count() == 2
    store.replace_models("r", {"model_metrics": frame(4).limit(1), "sweep": frame(4).limit(1)}, ["m"])
    assert held() == {"model_metrics": [3, 4], "sweep": [3, 4]}
    store.append("r", "sweep", frame(5))
    assert held() == {"model_metrics": [3, 4], "sweep": [3, 4, 5, 5]}
    store.save("r", {"sweep": frame(6)})        # the run's other datasets stay
    assert held() == {"model_metrics": [3, 4], "sweep": [6, 6]} and held("other")["model_metrics"] == [9, 9]
    store.vacuum()
    versions = {n: len(list((tmp_path / "store" / "data" / n).iterdir())) for n in ("model_metrics", "sweep")}
    assert versions == {"model_metrics": 2, "sweep": 1} and held() == {"model_metrics": [3, 4], "sweep": [6, 6]}
    with pytest.raises(ValueError, match="no dataset"):
        store.load("unknown")


def test_replaced_versions_are_deleted_a_commit_later(spark, tmp_path):
    from quorum.sources.tables import ResultsStore
    store = ResultsStore(spark, str(tmp_path / "store"))
    for i in range(5):
        store.save("r", {"sweep": spark.createDataFrame([("m", float(i))], "model_name string, cost double")})
    assert len(list((tmp_path / "store" / "data" / "sweep").iterdir())) == 2 and store.load("sweep").first()["cost"] == 4


def test_metrics_json_coercion_F16(spark, tmp_path):
    from quorum.sources.tables import scan_metrics_json
    p = tmp_path / "stored_run.json"
    p.write_text('{"model_metrics": [{"model_name": "AD_Decision", "split": "Full", "threshold_type": "base", '
                 '"threshold": null, "tp": "35", "fp": "1648", "tn": 726, "fn": "3", "cost": 347.6}]}')
    r = scan_metrics_json(spark, str(p)).collect()[0]
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["threshold"]) == (35, 1648, 726, 3, None)


def test_knn_tiles_are_exact_on_ties_and_far_origins():
    import numpy as np
    import pandas as pd

    from quorum.operators.neighbours import _tile_topk
    rng = np.random.default_rng(1)
    for offset, scale in ((0, 1), (1e8, 0.1), (1e8, 0), (0, 0), (-3e5, 1e-6)):
        rv, qv = np.round(rng.normal(size=(60, 3)), 1) * scale + offset, np.round(rng.normal(size=(7, 3)), 1) * scale + offset
        r = pd.DataFrame({"rid": [f"r{i:03d}" for i in range(60)], "rvec": list(rv)}).sample(frac=1, random_state=1)
        q = pd.DataFrame({"qid": [f"q{i}" for i in range(7)], "qvec": list(qv)})
        got = [tuple(t) for t in _tile_topk(5, False)(q, r).itertuples(index=False)]
        want = [(i, j, d) for i, a in zip(q.qid, q.qvec)
                for d, j in sorted((float(np.sqrt(((b - a) ** 2).sum())), j) for j, b in zip(r.rid, r.rvec))[:5]]
        assert got == want


def test_query_goes_once_to_each_part_of_small_tiles_F1(spark):
    """Where pruning doesn't help, a query is copied for each part of tiles, not for each tile; results are those of one tile."""
    import numpy as np

    from quorum.operators import neighbours as N
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 16)))], "id string, embedding array<double>")
    rows = df.selectExpr("id as rid", "embedding as rvec")
    _, tiles = N._tiled(rows, 600, 16)
    asked = N._ask(df.selectExpr("id as qid", "embedding as qvec", "cast(null as double) as kth"), tiles, 5, 16, others=True)
    assert len(tiles.cell) > 30 and asked.count() == 600 and asked.agg(F.sum(F.size("tiles"))).first()[0] > 600 * 10
    pairs = []
    got = N.knn_join(df, df, 5, exclude_self=True, tile_rows=16, tile_pairs=pairs)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in N.knn_join(df, df, 5, exclude_self=True).collect()}
    assert pairs[0][0] <= pairs[0][1]


def test_boxes_of_a_tile_are_exact():
    import numpy as np

    from quorum.operators import neighbours as N
    rng = np.random.default_rng(3)
    for rv in (np.round(rng.normal(size=(2000, 3)), 1), np.ones((1500, 2)), np.vstack([np.zeros((1200, 4)), rng.normal(size=(800, 4))]),
               np.round(rng.normal(size=(2000, 2)), 2) + 1e8, rng.normal(size=(1500, 40))):
        ids = np.array([f"{i:05d}" for i in range(len(rv))])
        for exclude in (True, False):
            want = N._direct(rv[::7], rv, ids[::7], ids, 5, exclude)
            got = N._block_topk(rv[::7], rv, ids[::7], ids, np.full(len(rv[::7]), np.inf), 5, exclude)
            assert all(np.array_equal(a, b) for a, b in zip(want, got))
            near = N._block_topk(rv[::7], rv, ids[::7], ids, want[2].reshape(-1, 5)[:, 4], 5, exclude)  # by the known k-th distance
            assert all(np.array_equal(a, b) for a, b in zip(want, near))


class CountedId(str):
    """A text that counts how often it is compared for equality."""
    compared = 0
    __hash__ = str.__hash__

    def __eq__(self, other):
        CountedId.compared += 1
        return str.__eq__(self, other)

    def __ne__(self, other):
        CountedId.compared += 1
        return str.__ne__(self, other)


@pytest.mark.parametrize("n_ids, n_refs", [(900, 900), (300, 900), (900, 40), (1, 90)])
def test_direct_compares_few_ids(n_ids, n_refs):
    """Every pair's ids were compared as texts, which took more than all else; ids may repeat and rows may be equal."""
    rng = np.random.default_rng(5)
    rv = rng.integers(0, 3, (n_refs, 6)).astype(float)
    rids = np.array(sorted(CountedId(i % n_ids) for i in range(n_refs)), dtype=object)
    order = rng.permutation(n_refs)
    qv, qids = rv[order], rids[order]
    k = 5
    want = []
    for i, q in enumerate(qv):
        d = np.sqrt(((rv - q) ** 2).sum(axis=1))
        near = sorted((d[j], j) for j in range(n_refs) if str(rids[j]) != str(qids[i]))[:k]
        want += [(i, j, x) for x, j in near]
    CountedId.compared = 0
    got = N._direct(qv, rv, qids, rids, k, True)
    assert list(zip(*(g.tolist() for g in got))) == want
    # a few candidates a query are compared, not every pair
    assert n_ids < 300 or n_refs < 300 or CountedId.compared < n_refs * n_refs / 4


def test_query_that_needs_most_tiles_of_a_part_names_none_F1(spark):
    """The tiles of such a query were listed and scored one by one; the part is one product now, without its home tile."""
    rng = np.random.default_rng(8)
    points = rng.normal(size=(700, 20))
    points[600:] = points[:100]  # ties
    df = spark.createDataFrame([(str(i % 650), [float(x) for x in v]) for i, v in enumerate(points)], "id string, embedding array<double>")
    _, tiles = N._tiled(df.selectExpr("id as rid", "embedding as rvec"), 700, 16)
    asked = N._ask(df.selectExpr("id as qid", "embedding as qvec", "cast(null as double) as kth"), tiles, 5, 16, others=True, whole=True).collect()
    assert len(asked) == 700 and all(len(r["tiles"]) == 1 and -1 - r["tiles"][0] in range(tiles.size) for r in asked)
    pairs = []
    got = N.knn_join(df, df, 5, exclude_self=True, tile_rows=16, tile_pairs=pairs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, N.knn_join(df, df, 5, exclude_self=True).collect()))
    assert pairs[0][0] <= pairs[0][1]


def test_scan_in_single_precision_is_exact_F1(monkeypatch):
    """Products in single precision only find candidates; ids may repeat, rows may be equal, origins far off."""
    monkeypatch.setattr(N, "_SCAN_QUERIES", 50, raising=False)
    monkeypatch.setattr(N, "_SCAN_ROWS", 40, raising=False)
    rng = np.random.default_rng(9)
    for rv in (rng.normal(size=(700, 40)), np.round(rng.normal(size=(700, 3)), 1), rng.normal(size=(300, 30)) * 1e-25, rng.normal(size=(300, 30)) * 1e25,
               rng.normal(size=(500, 20)) + 1e7, np.ones((400, 5)), np.vstack([rng.normal(size=(200, 20)), 1e6 + rng.normal(size=(200, 20))])):
        ids = np.array(sorted(f"{i % 350:05d}" for i in range(len(rv))))
        for k in (5, 90):
            for exclude in (True, False):
                want = N._direct(rv[::3], rv, ids[::3], ids, k, exclude)
                unknown = np.full(len(rv[::3]), np.inf)
                own = N._own(ids[::3], ids, exclude)
                got = N._scan(rv[::3], rv, *own, np.arange(len(rv)), unknown, k)
                assert all(np.array_equal(a, b) for a, b in zip(want, got))
                assert all(np.array_equal(a, b) for a, b in zip(want, N._boxed(rv[::3], rv, *own, np.arange(len(rv)), unknown, k)))


def test_points_of_few_dimensions_ask_few_tiles_F2(spark):
    """Rings around pivots reach through the whole set; boxes of a tree are asked by the queries near them only."""
    rng = np.random.default_rng(10)
    pts = rng.uniform(size=(3000, 3)) * [100, 10, 3]
    df, pairs = _frame(spark, pts), []
    got = _by_query(knn_join(df, df, 5, "id", "v", exclude_self=True, tile_rows=60, tile_pairs=pairs))
    assert got == _brute(pts, pts, 5, True)
    assert pairs[0][0] < pairs[0][1] / 8


def test_missing_numbers_leave_other_rows_their_neighbours_F2(spark):
    """A reference with NaN or NULL took the neighbours of its whole tile; it is near nothing, and a query with one has none."""
    rng = np.random.default_rng(11)
    pts = rng.normal(size=(400, 3))
    rows = [(str(i), [float(x) for x in p]) for i, p in enumerate(pts)] + [("nan", [float("nan"), 0.0, 0.0]), ("null", [0.0, None, 0.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    assert _by_query(knn_join(df, df, 5, "id", "v", exclude_self=True, tile_rows=50)) == _brute(pts, pts, 5, True)


def test_tree_with_a_leaf_of_many_equal_rows_F2(spark):
    rng = np.random.default_rng(12)
    pts = np.concatenate([np.tile([1.0, 2.0], (500, 1)), rng.normal(size=(300, 2))])
    df = _frame(spark, pts)
    assert _by_query(knn_join(df, df, 6, "id", "v", exclude_self=True, tile_rows=30)) == _brute(pts, pts, 6, True)
