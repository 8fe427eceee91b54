"""Metrics against plain dynamic programs, empty sequences included, and clusterers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoflow.cluster import CLARA, PAM, Hierarchical, agglomerate, pam
from kairoflow.errors import IncompleteMatrixError
from kairoflow.metrics import DTW, LCP, LCS, Aggregation, Chi2, Edit, Hamming, LinearPairwise, SequenceMetric, SoftDTW, SquaredL2, StaticMetric, metric, resumable
from kairoflow.metrics.matrix import DistanceMatrix
from kairoflow.operators import build_events, build_trajectories
from kairoflow.operators.pool import ID

ROWS = [("seq_1", 0, "A", 1.2), ("seq_1", 1, "B", 3.6), ("seq_2", 0, "A", -1.3), ("seq_2", 1, "C", -2.0), ("seq_2", 2, "B", 2.1)]
IDS = ["empty_1", "empty_2", "seq_1", "seq_2"]
SEQ = {i: [r[2:] for r in ROWS if r[0] == i] for i in IDS}


@pytest.fixture(scope="module")
def pool(spark):
    static = spark.createDataFrame([(i, "x" if i < "s" else "y") for i in IDS], "id string, kind string")
    return build_events(spark.createDataFrame(ROWS, "id string, t long, status string, value double"), "id", "t", static=static)


def hamming(a, b):
    return float(a[0] != b[0])


def l2(a, b):
    return (a[1] - b[1]) ** 2 / (a[1] ** 2 + b[1] ** 2)


def table(first, step):
    def run(a, b, d):
        t = {}
        for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            t[i, j] = first(i, j) if not (i and j) else step(t, i, j, d(a[i - 1], b[j - 1]))
        return t[len(a), len(b)]

    return run


edit = table(lambda i, j: float(i + j), lambda t, i, j, d: min(t[i - 1, j - 1] + d, t[i - 1, j] + 1, t[i, j - 1] + 1))
common = table(lambda i, j: 0, lambda t, i, j, d: t[i - 1, j - 1] + 1 if d <= 0 else max(t[i - 1, j], t[i, j - 1]))
warp = table(lambda i, j: 0.0 if i == j else math.inf, lambda t, i, j, d: d + min(t[i - 1, j - 1], t[i - 1, j], t[i, j - 1]))


def soft(a, b, d, gamma=0.5):
    def least(*x):
        low = min(x)
        return low if math.isinf(low) else low - gamma * math.log(sum(math.exp(-(v - low) / gamma) for v in x))

    return table(lambda i, j: 0.0 if i == j else math.inf, lambda t, i, j, c: c + least(t[i - 1, j - 1], t[i - 1, j], t[i, j - 1]))(a, b, d)


def prefix(a, b, d):
    return next((k for k in range(min(len(a), len(b))) if d(a[k], b[k]) > 0), min(len(a), len(b)))


def nan_if_empty(f):
    return lambda a, b, d: f(a, b, d) if a and b else math.nan


def linear(a, b, d):
    k = min(len(a), len(b))
    return sum(d(x, y) for x, y in zip(a, b)) / k if k else math.nan


CASES = [
    (Edit, {}, edit), (LCS, {}, lambda a, b, d: len(a) + len(b) - 2 * common(a, b, d)), (LCS, {"mode": "length"}, common),
    (LCP, {}, lambda a, b, d: len(a) + len(b) - 2 * prefix(a, b, d)), (DTW, {}, nan_if_empty(warp)), (SoftDTW, {"gamma": 0.5}, nan_if_empty(soft)),
    (LinearPairwise, {}, linear),
]


@pytest.mark.parametrize("kind,options,expected", CASES)
@pytest.mark.parametrize("entity,distance", [(Hamming("status"), hamming), (SquaredL2("value"), l2), (Hamming("status", 2.0, (("A", "B", 0.5),)), None)])
def test_against_plain_programs(pool, kind, options, expected, entity, distance):
    if distance is None:
        distance = lambda a, b: 0.0 if a[0] == b[0] else 0.5 if {a[0], b[0]} == {"A", "B"} else 2.0
    got = {(r.id_a, r.id_b): r.distance for r in kind(entity, **options).between(pool, None).collect()}
    assert set(got) == set(itertools.combinations(IDS, 2))
    for (a, b), value in got.items():
        assert value == pytest.approx(expected(SEQ[a], SEQ[b], distance), nan_ok=True), (a, b)


def test_edit_paths_agree_and_normalise(pool):
    fast, slow = Edit(Hamming("status"), normalize=True), Edit(Hamming("status", 1.0, (("A", "zz", 9.0),)), normalize=True)
    assert fast.unit and not slow.unit
    rows = lambda m: sorted((r.id_a, r.id_b, round(r.distance, 9)) for r in m.between(pool, None).collect())
    assert rows(fast) == rows(slow)
    assert fast(pool, "seq_1", "empty_1") == 1.0


def test_chi2_rules(pool):
    got = {(r.id_a, r.id_b): r.distance for r in Chi2(feature="status").between(pool, None).collect()}
    assert got["empty_1", "empty_2"] == 0 and got["empty_1", "seq_1"] == 1
    p, q = {"A": 0.5, "B": 0.5}, {"A": 1 / 3, "B": 1 / 3, "C": 1 / 3}
    assert got["seq_1", "seq_2"] == pytest.approx(math.sqrt(sum((p.get(c, 0) - q[c]) ** 2 / (p.get(c, 0) + q[c]) for c in q)))


def test_padding_band_and_config(pool):
    assert LinearPairwise(Hamming("status"), agg="sum", padding=3.0)(pool, "seq_1", "seq_2") == 1 + 3
    assert math.isinf(DTW(Hamming("status"), window=1).cross(pool.subset(["seq_1"]), pool.subset(["seq_2"])).first()[2]) is False
    with pytest.raises(ValueError):
        DTW(Hamming("status"), window=0)
    made = Edit(Hamming("status"), indel=2.0)
    assert SequenceMetric.from_config(made.to_config()) == made
    assert metric("edit", entity=Hamming("status")) == Edit(Hamming("status"))


def test_matrix_forms_and_resume(pool, tmp_path):
    m = resumable(Edit(Hamming("status")), pool, str(tmp_path / "m"), blocks=3)
    square, ids = m.to_numpy()
    assert ids == IDS and (square == square.T).all() and square[2, 3] == 1 and m.to_frame().count() == 16
    again = resumable(Edit(Hamming("status")), pool, str(tmp_path / "m"), blocks=3)
    assert (again.to_numpy()[0] == square).all()
    own = SoftDTW(Hamming("status")).matrix(pool)
    assert own.to_numpy()[0][2, 2] < 0


def test_configs_round_trip_through_json():
    import json

    from kairoflow.metrics import Combined, EntityMetric

    class Apart(EntityMetric):
        """A metric of the caller's own."""

        def __init__(self, feature):
            self.feature = feature

        def to_config(self):
            return {"type": "Apart", "feature": self.feature}

    row = Combined((Hamming("status", cost=(("A", "B", 0.5),)), SquaredL2("value")), (0.7, 0.3), "mean")
    for made in (Chi2(feature="status"), Edit(row, indel=2.0), SoftDTW(SquaredL2("value"), gamma=0.5)):
        assert SequenceMetric.from_config(json.loads(json.dumps(made.to_config()))) == made
    assert SequenceMetric.from_config(Edit(Apart("status")).to_config()).entity.feature == "status"


def test_unknown_distances_are_not_zero(pool, spark, tmp_path):
    m = DTW(Hamming("status")).matrix(pool)
    square, _ = m.to_numpy()
    assert np.isnan(square[0, 2]) and square[0, 0] == 0 and square[2, 3] == square[3, 2] >= 0
    assert m.missing() == 5 and Edit(Hamming("status")).matrix(pool).check_complete().missing() == 0
    with pytest.raises(IncompleteMatrixError):
        m.check_complete()
    with pytest.raises(IncompleteMatrixError):
        PAM(DTW(Hamming("status"))).labels(pool)
    assert DistanceMatrix.empty(pool.ids()).missing() == 6
    back = DistanceMatrix.from_path(spark, SoftDTW(Hamming("status")).matrix(pool).save(str(tmp_path / "m")))
    assert back.own is not None and back.ids.count() == 4


def test_resuming_notices_other_rows(pool, tmp_path):
    one = resumable(Edit(Hamming("status")), pool, str(tmp_path / "m"), blocks=2).to_numpy()[0]
    fewer = build_events(pool.entity.where("_rank < 1").select(F.col(ID).alias("id"), F.col("_t").alias("t"), "status", "value"), "id", "t", static=pool.static.withColumnRenamed(ID, "id"))
    two = resumable(Edit(Hamming("status")), fewer, str(tmp_path / "m"), blocks=2).to_numpy()[0]
    assert one[0, 3] == 3 and two[0, 3] == 1


def test_many_categories_take_the_general_program(pool, monkeypatch):
    monkeypatch.setattr(Edit, "MOST_LEVELS", 2)
    got = {(r.id_a, r.id_b): r.distance for r in Edit(Hamming("status")).between(pool, None).collect()}
    assert got["seq_1", "seq_2"] == 1 and len(got) == 6


def test_trajectory_mix(pool, spark):
    t = build_trajectories({"a": pool, "b": pool}, pool.static.withColumnRenamed(ID, "id"), "id")
    mix = Aggregation({"a": Edit(Hamming("status")), "b": DTW(Hamming("status"))}, StaticMetric(), weights={"a": 2.0})
    got = {(r.id_a, r.id_b): r.distance for r in mix.matrix(t).pairs.collect()}
    assert got["seq_1", "seq_2"] == pytest.approx((2 * 1 + 1 + 0) / 4)
    assert got["empty_1", "seq_1"] == pytest.approx((2 * 2 + 1) / 3)  # the warping distance is NaN
    own = StaticMetric(compare=lambda a, b: abs(len(a["kind"]) - len(b["kind"])) + 2).of(pool.static)
    assert {r.distance for r in own.collect()} == {2.0}
    column = StaticMetric(columns=lambda a, b: F.when(a["kind"] == b["kind"], 0).otherwise(5)).of(pool.static)
    assert {r.distance for r in column.collect()} == {0.0, 5.0}


def test_medoids_and_merging():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (12, 2)) for c in ((0, 0), (5, 5), (0, 9))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    truth = np.repeat([0, 1, 2], 12)
    same = lambda labels: len(set(zip(truth, labels))) == 3
    medoids, labels, inertia = pam(d, 3)
    assert same(labels) and inertia == pytest.approx(d[:, medoids].min(1).sum())
    assert all(same(agglomerate(d, linkage, 3)) for linkage in ("complete", "average", "single"))
    assert same(agglomerate(d, "average", None, threshold=2.0))


def test_clusterers_on_a_pool(pool):
    for clusterer in (PAM(Chi2(feature="status"), 2), Hierarchical(Chi2(feature="status"), 2), CLARA(Chi2(feature="status"), 2, sampling_ratio=1.0, instances=1, random_state=0)):
        labels = {r[ID]: r.cluster for r in clusterer.fit(pool).static.collect()}
        assert labels["empty_1"] == labels["empty_2"] != labels["seq_2"]
    with pytest.raises(ValueError):
        PAM(Chi2(feature="status"), 2).fit(pool.subset(["seq_1"]))


@pytest.fixture(scope="module")
def long_pool(spark):
    """Sequences of up to 140 rows: several words of bits, and an empty one."""
    rng = np.random.default_rng(5)
    rows = [(f"k{i:02d}", t, "ABCD"[rng.integers(4)], float(rng.integers(1, 9))) for i in range(24) for t in range(int(rng.choice([3, 60, 64, 65, 130, 140]) if i else 140))]
    static = spark.createDataFrame([(f"k{i:02d}", "xy"[i % 2]) for i in range(25)], "id string, kind string")
    return build_events(spark.createDataFrame(rows, "id string, t long, status string, value double"), "id", "t", static=static)


def banded(a, b, d, window=40):
    t = {(0, 0): 0.0}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        if abs(i - j) <= window:
            t[i, j] = d(a[i - 1], b[j - 1]) + min(t.get(k, math.inf) for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
    return t.get((len(a), len(b)), math.inf)


@pytest.mark.parametrize("kind,options,entity,expected", [
    (Edit, {}, Hamming("status"), edit), (LCS, {}, Hamming("status"), lambda a, b, d: len(a) + len(b) - 2 * common(a, b, d)),
    (LCP, {}, Hamming("status"), lambda a, b, d: len(a) + len(b) - 2 * prefix(a, b, d)), (DTW, {"window": 40}, SquaredL2("value"), nan_if_empty(banded)),
    (SoftDTW, {"gamma": 0.5}, Hamming("status"), nan_if_empty(soft)), (LinearPairwise, {}, SquaredL2("value"), linear),
])
def test_tiles_hold_each_pair_once(long_pool, monkeypatch, kind, options, entity, expected):
    """Many tiles of few ids, and no table of pairs that carries their sequences."""
    from kairoflow.metrics import tiles

    monkeypatch.setattr(tiles, "LEAST_IDS", 4)
    seq = {f"k{i:02d}": [] for i in range(25)}
    for r in long_pool.entity.orderBy(ID, "_rank").collect():
        seq[r[ID]].append((r.status, r.value))
    frame = kind(entity, **options).between(long_pool, None)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "a_f0" not in plan and "_i" not in plan.replace("_id", "")
    rows = frame.collect()
    got = {(r.id_a, r.id_b): r.distance for r in rows}
    assert len(rows) == len(got) and set(got) == set(itertools.combinations(sorted(seq), 2))
    d = hamming if isinstance(entity, Hamming) else l2
    some = list(itertools.combinations(sorted(seq), 2))[::7]
    for a, b in some:
        assert got[a, b] == pytest.approx(expected(seq[a], seq[b], d), nan_ok=True), (a, b)


def test_row_metrics_of_one_direction(long_pool):
    """A caller's own row metric that isn't symmetric is asked from the lesser id to the greater."""
    from kairoflow.metrics import EntityMetric

    class Rise(EntityMetric):
        def __init__(self, feature):
            self.feature = feature

        def encode(self, columns):
            return [np.array([float(v) for v in columns[0]])], None

        def distance(self, a, b, levels):
            return np.maximum(b[0] - a[0], 0.0)

    first = {r[ID]: r.value for r in long_pool.entity.where("_rank = 0").collect()}
    top = long_pool.entity.where("_rank = 0").select(F.col(ID).alias("id"), F.col("_t").alias("t"), "value")
    got = LinearPairwise(Rise("value")).between(build_events(top, "id", "t"), None).collect()
    assert len(got) == 24 * 23 // 2 and all(r.distance == max(first[r.id_b] - first[r.id_a], 0.0) for r in got)


def test_few_weights_keep_logarithms(long_pool):
    """Path weights out of a double's range take the slow way."""
    pair = (long_pool.subset(["k00"]), long_pool.subset(["k00", "k24"]))
    got = {r.id_b: r.distance for r in SoftDTW(Hamming("status"), gamma=0.001).cross(*pair).collect()}
    seq = [(r.status, r.value) for r in pair[0].entity.orderBy("_rank").collect()]
    assert got["k00"] == pytest.approx(soft(seq, seq, hamming, 0.001)) and math.isnan(got["k24"])


def merged_plainly(d, linkage, n_clusters, threshold=None):
    """Repeated merging by a search of the whole matrix: the first of the least distances by row and column."""
    n, d = len(d), d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    members = {i: [i] for i in range(n)}
    while len(members) > (1 if threshold is not None else n_clusters):
        i, j = divmod(int(np.argmin(d)), n)
        if threshold is not None and d[i, j] >= threshold:
            break
        a, b = len(members[i]), len(members[j])
        new = np.maximum(d[i], d[j]) if linkage == "complete" else np.minimum(d[i], d[j]) if linkage == "single" else (a * d[i] + b * d[j]) / (a + b)
        new[i] = np.inf
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        d[i, j] = np.inf
        members[i] += members.pop(j)
    labels = np.empty(n, int)
    for label, i in enumerate(sorted(members)):
        labels[members[i]] = label
    return labels


@pytest.mark.parametrize("linkage", ["complete", "average", "single"])
def test_merging_equals_a_search_of_the_whole_matrix(linkage):
    """Many equal distances, and sizes that a search of all pairs for each merge doesn't end for."""
    rng = np.random.default_rng(2)
    for n, most, k, threshold in ((1, 3, 1, None), (40, 3, 5, None), (60, 1000, 1, None), (50, 9, 2, 6.0), (80, 4, 3, None)):
        d = rng.integers(0, most, (n, n)).astype(float)
        d = np.triu(d, 1) + np.triu(d, 1).T
        assert (agglomerate(d, linkage, k, threshold) == merged_plainly(d, linkage, k, threshold)).all()
    x = rng.random((3000, 2))
    labels = agglomerate(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), linkage, 3)
    assert set(labels) == {0, 1, 2} and labels[0] == 0


def test_clusterers_read_tiles(long_pool, monkeypatch):
    """PAM by passes over tiles gives what it gives on the matrix, and no clusterer collects pairs."""
    from kairoflow.cluster import medoids
    from kairoflow.metrics import tiles

    monkeypatch.setattr(tiles, "LEAST_IDS", 4)
    for metric in (Edit(Hamming("status")), Chi2(feature="status"), SoftDTW(Hamming("status"), gamma=2.0)):
        whole = long_pool.subset(long_pool.ids().where(f"{ID} <> 'k24'")) if isinstance(metric, SoftDTW) else long_pool
        square, ids = metric.matrix(whole).to_numpy()
        monkeypatch.setattr(DistanceMatrix, "to_numpy", None)
        expected = pam(square, 3)
        for most in (0, 2048):
            monkeypatch.setattr(medoids, "ON_DRIVER", most, raising=False)
            clusterer = PAM(metric, 3)
            labels = {r[ID]: r.label for r in clusterer.labels(whole).collect()}
            assert clusterer.medoids == [ids[i] for i in expected[0]] and clusterer.inertia == pytest.approx(expected[2])
            assert [labels[i] for i in ids] == list(expected[1])
        got = {r[ID]: r.label for r in Hierarchical(metric, 3, linkage="average").labels(whole).collect()}
        assert [got[i] for i in ids] == list(merged_plainly(square, "average", 3))
        monkeypatch.undo()
        monkeypatch.setattr(tiles, "LEAST_IDS", 4)


def test_sampled_medoids_stay_off_the_driver(long_pool, monkeypatch):
    """CLARA's samples go through tiles: no matrix and no list of the sample's pairs or ids reaches the driver as rows."""
    from kairoflow.cluster import medoids
    from kairoflow.cluster.square import Square

    expected = CLARA(Chi2(feature="status"), 2, sampling_ratio=0.7, instances=2, random_state=3)
    labels = {r[ID]: r.label for r in expected.labels(long_pool).collect()}
    monkeypatch.setattr(medoids, "ON_DRIVER", 0)
    for owner, name in ((DistanceMatrix, "to_numpy"), (Square, "square"), (Square, "condensed")):
        monkeypatch.setattr(owner, name, None)
    got = CLARA(Chi2(feature="status"), 2, sampling_ratio=0.7, instances=2, random_state=3)
    assert {r[ID]: r.label for r in got.labels(long_pool).collect()} == labels and got.medoids == expected.medoids


def test_static_rows_meet_in_tiles(spark, monkeypatch):
    """Null-safe equality of values of many kinds, as Spark has it, without a join of pairs."""
    from kairoflow.metrics import tiles

    monkeypatch.setattr(tiles, "LEAST_IDS", 3)
    nan = float("nan")
    rows = [(1, "a", 0.0, 5, None), (2, "a", -0.0, 5, None), (3, "a", nan, 5, b"x"), (4, "a", nan, 5, b"x"), (5, None, 1.0, None, b"x"), (6, None, 1.0, None, b"x"), (7, "None", 1.0, None, b"x"), (8, None, 1.0, 0, b"x"), (9, "a", 0.0, 5, b"")]
    static = spark.createDataFrame(rows, f"{ID} long, s string, v double, k int, b binary").withColumn("at", F.timestamp_micros(F.col("k")))
    frame = StaticMetric().of(static)
    assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()
    alike = {(1, 2), (3, 4), (5, 6)}
    assert {(r.id_a, r.id_b, r.distance) for r in frame.collect()} == {(a, b, 0.0 if (a, b) in alike else 1.0) for a, b in itertools.combinations(range(1, 10), 2)}
    listed = static.withColumn("v", F.array("v"))  # values without a text of their own go by a join
    assert {(r.id_a, r.id_b) for r in StaticMetric().of(listed).collect() if not r.distance} == alike


@pytest.mark.parametrize("agg", ["mean", "sum"])
def test_mixed_tiles_equal_stacked_distances(long_pool, pool, spark, monkeypatch, agg):
    """A pair's distances are mixed in its tile, as they are where a metric has pairs of its own."""
    from kairoflow.metrics import tiles

    monkeypatch.setattr(tiles, "LEAST_IDS", 4)

    class Own(DTW):
        def between(self, one, two):
            return super().between(one, two).select("*")

    some = long_pool.subset([f"k{i:02d}" for i in range(3, 14)])
    t = build_trajectories({"a": long_pool, "b": some, "c": pool}, long_pool.static.withColumnRenamed(ID, "id"), "id")
    mix = lambda warp: Aggregation({"a": Edit(Hamming("status"), normalize=True), "b": warp(SquaredL2("value")), "c": Chi2(feature="status")}, StaticMetric(), agg=agg, weights={"b": 0.5, "static": 3.0})
    frame = mix(DTW).matrix(t).pairs
    assert "Aggregate [id_a" not in frame._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda f: {(r.id_a, r.id_b): round(r.distance, 9) for r in f.collect()}
    one, two = rows(frame), rows(mix(Own).matrix(t).pairs)
    assert len(one) > 25 * 24 // 2 and one == two
