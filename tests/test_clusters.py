import numpy as np
import pytest

from lumenweave.operators import checks, clusters


def line(n):
    return np.array([(i * 0.0001, 0.0) for i in range(n)])


def occupation(labels, k):
    return np.bincount(labels, minlength=k).tolist()


@pytest.mark.parametrize(("n", "k", "cap"), [(32, 2, 16), (33, 3, 16), (17, 3, 8), (5, 3, 2), (260, 17, 16)])
def test_capacities_hold(n, k, cap):
    labels = clusters.cluster(line(n), k, cap)
    got = occupation(labels, k)
    assert sum(got) == n and max(got) <= cap and min(got) > 0
    assert (labels == clusters.cluster(line(n), k, cap)).all()


@pytest.mark.parametrize("bad", [(33, 2, 16), (3, 4, 16), (3, -1, 16), (3, 0, 16), (0, 1, 16), (3, 1, 0), (3, True, 16), (3, 1, True)])
def test_impossible(bad):
    with pytest.raises(clusters.ClusterError):
        clusters.cluster(line(bad[0]), bad[1], bad[2])


def test_twenty_starts_at_every_size(monkeypatch):
    runs, lloyd = [], clusters._lloyd
    monkeypatch.setattr(clusters, "_lloyd", lambda *a: runs.append(lloyd(*a)) or runs[-1])
    p = np.random.default_rng(3).random((200, 2))
    want = clusters.cluster(p, 13, 16)
    assert len(runs) == 20
    monkeypatch.setattr(clusters, "BLOCK", 50)  # as for more points than fit in a block
    assert (clusters.cluster(p, 13, 16) == want).all() and len(runs) == 40


def test_assignment():
    centres = np.array([(0.0, 0.0), (0.003, 0.0)])
    labels = clusters.assign(line(30), centres, 16)
    assert max(occupation(labels, 2)) <= 16 and labels[0] == 0 and labels[29] == 1
    with pytest.raises(clusters.ClusterError):
        clusters.assign(line(17), centres[:1], 16)
    with pytest.raises(clusters.ClusterError):
        clusters.assign([(float("nan"), 0.0)], centres, 16)
    assert len(clusters.assign([], centres, 16)) == 0


def test_assignment_equals_a_plain_one():
    rng = np.random.default_rng(4)
    p, c = rng.random((60, 2)), rng.random((7, 2))
    f = abs(np.cos(np.radians(p[:, 1].mean())))
    d = ((p[:, None, 0] - c[None, :, 0]) * f) ** 2 + (p[:, None, 1] - c[None, :, 1]) ** 2
    two = np.sort(d, axis=1)
    room, want = [9] * 7, [-1] * 60
    for i in sorted(range(60), key=lambda i: (-(two[i, 1] - two[i, 0]), two[i, 0], i)):
        j = next(j for j in np.argsort(d[i], kind="stable") if room[j])
        want[i] = int(j)
        room[j] -= 1
    assert clusters.assign(p, c, 9).tolist() == want


def test_grouping():
    assert len(set(clusters.group_by_capacity(line(17), 8).tolist())) == 3
    assert len(set(clusters.group_by_capacity(line(5), 2).tolist())) == 3


def test_hierarchy_and_checks(spark):
    from lumenweave.plans.config import DEFAULT

    hps = spark.createDataFrame([(p, i, i * 0.0001, 0.0) for p, n in ((1, 260), (2, 3)) for i in range(n)], "project_id long, hp_id long, lon double, lat double")
    rows = clusters.hierarchy(hps, DEFAULT).toPandas()
    one = rows[rows.project_id == 1]
    assert len(one) == 260 and one.cto.nunique() == 17 and one.pon.nunique() == 3 and one.ceo.nunique() == 2
    assert one.groupby("cto").size().max() <= 16 and one.groupby("pon").cto.nunique().max() <= 8
    centres = spark.createDataFrame([(1, i, i * 0.0015, 0.0) for i in range(20)] + [(2, 7, 0.0, 0.0), (2, 8, 1.0, 0.0)], "project_id long, centre_id long, lon double, lat double")
    rows = clusters.hierarchy(hps, DEFAULT, centres).toPandas()
    assert rows[rows.project_id == 1].cto.nunique() == 20 and rows[(rows.project_id == 2) & rows.hp_id.isna()].cto.tolist() == [2]
    hp = spark.range(4).withColumnRenamed("id", "hp_id")
    ctos = spark.createDataFrame([("CTO_1", [0, 1]), ("CTO_2", [1, 2])], "cto_id string, hp_ids array<long>")
    pons = spark.createDataFrame([("P", ["CTO_1", "CTO_2"])], "pon_id string, cto_ids array<string>")
    ceos = spark.createDataFrame([("C", ["P"])], "ceo_id string, pon_ids array<string>")
    assert sorted(map(tuple, checks.violations(hp, ctos, pons, ceos, (16, 8, 2)).collect())) == [("hp_in_none", "3"), ("hp_in_several", "1")]
    with pytest.raises(checks.AllocationError):
        checks.require_valid(hp, ctos, pons, ceos, (16, 8, 2))


def test_leaves_give_the_nearest_of_all_centres(monkeypatch):
    rng = np.random.default_rng(9)
    knot = np.concatenate((rng.random((900, 2)), 0.5 + 1e-6 * rng.random((300, 2)), np.full((100, 2), 0.25)))
    for p, k in ((rng.random((1, 2)), 1), (rng.random((60, 2)), 7), (knot, 80)):
        c = p[rng.integers(len(p), size=k)]  # some twice
        d = (p[:, None, 0] - c[None, :, 0]) ** 2 + (p[:, None, 1] - c[None, :, 1]) ** 2
        for block in (clusters.BLOCK, 200):
            monkeypatch.setattr(clusters, "BLOCK", block)
            leaves = clusters.Leaves(p)
            label, best = (leaves.flat(x) for x in leaves.nearest(c))
            assert (label == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
            label, best = leaves.nearest_few(c, 5)
            want = np.argsort(d, axis=1, kind="stable")[:, :5]
            assert (label == want).all() and (best == np.take_along_axis(d, want, axis=1)).all()


def test_assignment_of_many_equals_a_plain_one():
    rng = np.random.default_rng(10)
    p, c = rng.random((640, 2)) * 1e-2, rng.random((40, 2)) ** 3 * 1e-2
    f = abs(np.cos(np.radians(p[:, 1].mean())))
    d = (p[:, None, 0] * f - c[None, :, 0] * f) ** 2 + (p[:, None, 1] - c[None, :, 1]) ** 2
    two = np.sort(d, axis=1)
    room, want = [16] * 40, [-1] * 640
    for i in sorted(range(640), key=lambda i: (-(two[i, 1] - two[i, 0]), two[i, 0], i)):
        want[i] = int(next(j for j in np.argsort(d[i], kind="stable") if room[j]))
        room[want[i]] -= 1
    assert clusters.assign(p, c, 16).tolist() == want


def test_a_leaf_meets_few_centres():
    p = np.random.default_rng(11).random((20_000, 2))
    leaves = clusters.Leaves(p)
    c = clusters._seeded(leaves, 1250, np.random.default_rng(1))
    assert len(np.unique(c, axis=0)) == 1250
    node, _ = leaves._candidates(c, 1)
    assert len(node) * leaves.x.shape[1] < 25 * len(p)  # of 1,250 for each point
    same = clusters._seeded(clusters.Leaves(np.zeros((40, 2))), 30, np.random.default_rng(1))
    assert same.shape == (30, 2)


def test_searches_from_what_is_known_equal_whole_ones(monkeypatch):
    rng = np.random.default_rng(12)
    knot = np.concatenate((rng.random((3000, 2)), 0.5 + 1e-6 * rng.random((300, 2)), np.full((100, 2), 0.25)))
    leaves = clusters.Leaves(knot)
    c, most = clusters._seeds(leaves, 200, np.random.default_rng(1))
    c[7] = c[8]  # a tie
    before, few = leaves.nearest(c), leaves.nearest_few(c, 5)[0]
    moved = np.zeros(200, bool)
    moved[[3, 8, 50]] = True
    later = c.copy()
    later[moved] = rng.random((3, 2))
    for block in (clusters.BLOCK, 200):
        monkeypatch.setattr(clusters, "BLOCK", block)
        got, want = leaves.nearest(later, (*before, moved)), leaves.nearest(later)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        got, want = leaves.nearest_few(later, 5, few), leaves.nearest_few(later, 5)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    first = clusters._seeded(leaves, 200, np.random.default_rng(1))
    got, want = leaves.nearest(first, most=most), leaves.nearest(first)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_only_leaves_near_moved_centres_look_again(monkeypatch):
    p = np.random.default_rng(13).random((20_000, 2))
    leaves, pairs, reach = clusters.Leaves(p), [], clusters.Leaves._reach
    c = clusters._seeded(leaves, 1250, np.random.default_rng(1))
    before, moved = leaves.nearest(c), np.arange(1250) < 12
    monkeypatch.setattr(clusters.Leaves, "_reach", lambda *a: pairs.append(reach(*a)) or pairs[-1])
    leaves.nearest(c + 1e-4 * moved[:, None], (*before, moved))
    assert len(np.unique(pairs[0][0])) < len(leaves.at) / 10


def test_seeds_of_all_starts_at_once_equal_one_by_one(monkeypatch):
    rng = np.random.default_rng(14)
    knot = np.concatenate((rng.random((5000, 2)), 0.5 + 1e-6 * rng.random((300, 2)), np.full((100, 2), 0.25)))
    one_by_one = clusters._seeds
    for p, k in ((knot, 300), (rng.random((30, 2)), 30), (np.zeros((40, 2)), 30), (knot[:1], 1)):
        leaves, draws = clusters.Leaves(p), np.random.default_rng(1)
        want = [one_by_one(leaves, k, draws) for _ in range(6)]
        calls = []
        monkeypatch.setattr(clusters, "_seeds", lambda *a: calls.append(a) or one_by_one(*a))
        for block in (1_000_000, len(p)):
            monkeypatch.setattr(clusters, "BLOCK", block)
            got = list(clusters._seed_sets(leaves, k, np.random.default_rng(1), 6))
            assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(got, want, strict=True))
        assert bool(calls) == (len(np.unique(p, axis=0)) <= k)


def test_no_task_clusters_two_projects(spark):
    rows = [(p, i, -44.3 + i * 1e-5, -2.5 + i % 7 * 1e-5) for p in range(25) for i in range(40)]
    config = {"engenharia": {"capacidade_hp_por_cto": 16, "ctos_por_pon": 8, "pons_por_ceo": 2}}
    out = clusters.hierarchy(spark.createDataFrame(rows, "project_id long, hp_id long, lon double, lat double"), config)
    tasks = out.selectExpr("project_id", "spark_partition_id() as task").distinct().collect()
    assert len(tasks) == len({r.task for r in tasks}) == 25
