"""Builders, criteria, alignment, conversion, bins, stores: hand-made tables and error contracts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kairoflow.errors import CriterionError, LevelError
from kairoflow.operators import ANY, Builder, Entity, Length, Pattern, Rank, Static, Time, build_events, build_intervals, build_states, build_trajectories
from kairoflow.operators.pool import ID, RANK
from kairoflow.sources import Workspace, load_pool, read_csv, read_sql, save_pool, simulate_events, simulate_intervals, simulate_states, simulate_trajectories, source

ROWS = [(1, 0.0, 2.0, "A"), (1, 2.0, 5.0, "B"), (1, 5.0, None, "A"), (2, 1.0, 1.5, None), (2, 1.0, 3.0, "C"), (3, 4.0, 6.0, "B")]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id long, start double, end double, label string")


@pytest.fixture(scope="module")
def static(spark):
    return spark.createDataFrame([(1, 30, 9.0), (3, 50, None), (9, 70, 1.0)], "id long, age int, stop double")


@pytest.fixture(scope="module")
def events(frame, static):
    return build_events(frame.select("id", F.col("start").alias("t"), "label"), "id", "t", static=static)


@pytest.fixture(scope="module")
def intervals(frame, static):
    return build_intervals(frame.where("end is not null"), "id", "start", "end", static=static)


@pytest.fixture(scope="module")
def states(frame, static):
    return build_states(frame.select("id", "start", "label"), "id", "start", static=static)


def ids(df):
    return {r[0] for r in df.collect()}


def ranks(df):
    return sorted((r[ID], r[RANK]) for r in df.collect())


def test_sources_are_stacked_and_ids_kept(spark, frame, static):
    more = spark.createDataFrame([(7, 1.0, 5)], "id long, t double, extra int")
    pool = Builder("event").add(frame.withColumnRenamed("start", "t"), "id", time="t", features=["label"]).add(more, "id", time="t").add(static, "id", is_static=True).build()
    assert pool.features == ["extra", "label"] and pool.static_features == ["age", "stop"]
    assert ids(pool.ids()) == {1, 2, 3, 7, 9}
    assert {r[ID]: r.length for r in pool.lengths().collect()} == {1: 3, 2: 2, 3: 1, 7: 1, 9: 0}
    with pytest.raises(KeyError):
        Builder("event").add(frame, "id", time="nope")
    with pytest.raises(ValueError):
        Builder("interval").add(frame, "id", start="start")
    with pytest.raises(ValueError):
        Builder("event").build()


def test_state_ends_and_continuity(frame, states):
    ends = [(r[ID], r._start, r._end) for r in states.entity.orderBy(ID, RANK).collect()]
    assert ends[:3] == [(1, 0.0, 2.0), (1, 2.0, 5.0), (1, 5.0, None)]
    closed = build_states(frame.select("id", "start", "label"), "id", "start", end_value=9.0)
    assert closed.entity.where("_end is null").isEmpty()
    with pytest.raises(ValueError, match="don't follow"):
        build_states(frame, "id", "start", "end", validate_continuity=True)


def test_criteria(events, intervals, states):
    assert ids(events.which(Entity("label = 'A'"))) == {1}
    assert ids(events.which(Length(ge=2))) == {1, 2} and ids(events.which(Length(le=0))) == set()
    assert ids(events.which(Static("age > 40"))) == {3, 9}
    assert ids(events.which(Length(ge=2)).subtract(events.which(Entity("label = 'A'")))) == {2}
    assert ranks(events.filter_entities(Rank(last=1)).entity) == [(1, 2), (2, 1), (3, 0)]
    assert ranks(events.filter_entities(Rank(first=-1)).entity) == [(1, 0), (1, 1), (2, 0)]
    assert ranks(events.filter_entities(Rank(start=1, step=2)).entity) == [(1, 2)]
    # A second filter ranks what the first one left.
    assert ranks(events.filter_entities(Rank(last=2)).filter_entities(Rank(first=1)).entity) == [(1, 1), (2, 0), (3, 0)]
    assert ids(events.which(Pattern("label", ["A", ANY, "A"]))) == {1}
    assert ids(events.which(Pattern("label", ["A", "*", "A"], present=False))) == {2, 3}
    assert ids(states.which(Time(start_ge=4.5))) == {1, 2, 3}  # open ends reach any time
    assert ids(intervals.which(Time(start_ge=1.0, end_le=3.0, duration_within=True))) == {2}
    assert ids(intervals.which(Time(end_le=3.0, duration_within=True, all_entities=True))) == {2}
    assert events.match(Entity("label = 'B'"), 3) and not events.match(Entity("label = 'B'"), 2)


def test_criterion_errors(events, states):
    for bad in (lambda: Length(), lambda: Length(gt=5, lt=5), lambda: Rank(), lambda: Rank(first=1, last=1), lambda: Rank(ranks=()), lambda: Time(), lambda: Pattern("label", [ANY])):
        with pytest.raises(CriterionError):
            bad()
    with pytest.raises(LevelError):
        events.which(Rank(first=1))
    with pytest.raises(LevelError):
        events.filter_entities(Length(ge=1))
    with pytest.raises(CriterionError):
        events.which(Entity("t + 1" if False else "_t + 1"))
    with pytest.raises(CriterionError):
        events.which(Time(end_le=3.0))
    with pytest.raises(NotImplementedError):
        states.filter_entities(Entity("label = 'A'"))


def test_reference_dates(events, intervals):
    t0 = lambda pool: {r.id: (r.t0, r.t0_rank) for r in pool.t0_data().collect()}
    assert t0(events) == {1: (0.0, 0), 2: (1.0, 1), 3: (4.0, 0), 9: (None, None)}
    assert t0(events.set_t0(position=-3)) == {1: (0.0, 0), 2: (None, None), 3: (None, None), 9: (None, None)}
    assert t0(events.set_t0(direct={1: 4.0, 2: 0.5}))[1] == (4.0, 1) and t0(events.set_t0(direct={2: 0.5}))[2] == (0.5, 0)
    assert t0(events.set_t0(feature="stop"))[9] == (1.0, 0)
    assert t0(events.set_t0(query="label = 'A'", use_first=False))[1] == (5.0, 2)
    assert t0(intervals.set_t0(position=0, anchor="middle"))[3][0] == 5.0
    with pytest.raises(ValueError):
        events.set_t0(position=0, direct=1.0)
    with pytest.raises(TypeError):
        events.set_t0(feature="age")
    kept = events.set_t0(query="label = 'A'").filter_entities(Rank(start=1, relative=True)).entity
    assert ranks(kept) == [(1, 1), (1, 2), (2, 0), (2, 1), (3, 0)]  # ids without a date are kept whole


def test_conversion(events, intervals, states):
    assert [r["end"] for r in events.as_interval(2.5).temporal_data().where("id = 3").collect()] == [6.5]
    assert [r["end"] for r in events.as_state("stop").temporal_data().where("id = 1").orderBy("start").collect()] == [2.0, 5.0, 9.0]
    assert states.as_interval().kind == "interval"
    assert sorted(r["time"] for r in intervals.as_event("middle").temporal_data().where("id = 1").collect()) == [1.0, 3.5]
    with pytest.raises(NotImplementedError):
        intervals.as_state()
    with pytest.raises(TypeError):
        events.as_interval("1d")
    with pytest.warns(UserWarning):
        assert events.as_event() is events


def test_bins_and_tensor(events, intervals):
    table = {(r.id, r.bin): r.label for r in events.binned_data(bin_size=2.0, fill_value="-").collect()}
    assert len(table) == 4 * 3 and table[1, 1] == "B" and table[9, 0] == "-" and table[1, 2] == "A"
    cells, names, features = intervals.to_tensor("label", 2.0, ohe=True, overlap_rule="max", fill_value=0)
    assert cells.shape == (4, 4, 3) and names == [1, 2, 3, 9] and features == ["label_A", "label_B", "label_C"]
    assert cells[0, 1].tolist() == [1.0, 1.0, 0.0]  # a period's last bin is inclusive
    with pytest.raises(ValueError):
        events.binned_data(bin_size=0.0001)
    with pytest.raises(TypeError):
        events.binned_data(bin_size="1d")


def test_describe_and_survival(states, events):
    row = states.describe().where("id = 1").first()
    assert (row.length, row.n_transitions, row.n_changes, row.median_duration) == (3, 1, 2, 2.5)
    assert states.describe().where("id = 9").first().length == 0
    got = {r.id: (r.occurred, r.time) for r in events.survival_target("stop").collect()}
    assert got == {1: (True, 9.0)}
    assert events.metadata()["features"]["label"]["min_length"] == 1


def test_description_as_static(states, events):
    more = events.describe(add_to_static=True, prefix="d")
    assert {r["_id"]: r.d_length for r in more.static.collect()} == {1: 3, 2: 2, 3: 1, 9: 0} and "age" in more.static_features
    assert more.describe(add_to_static=True, prefix="d").static_features == more.static_features
    with pytest.raises(ValueError):
        events.describe(by_id=False, add_to_static=True)
    both = build_trajectories({"a": events, "b": events}).describe(add_to_static=True)
    assert {r["_id"]: (r.a_length, r.n_sequences) for r in both.static.collect()}[1] == (3, 2)


def test_navigation(events):
    assert list(events) == [1, 2, 3, 9] and len(events) == 4 and 2 in events and 7 not in events and bool(events.subset([7]))
    assert {key: pool.entity.count() for key, pool in events.items()} == {1: 3, 2: 2, 3: 1, 9: 0}
    assert [pool.entity.count() for pool in events.values()] == [3, 2, 1, 0]
    both = build_trajectories({"a": events, "b": events})
    assert {r.id: r.n for r in both.apply("a", by_id=True, n=F.count("*")).collect()} == {1: 3, 2: 2, 3: 1}
    assert both.cast_to_timestep("int").pools["b"].entity.schema["_t"].dataType.typeName() == "integer"
    assert both.cast_to_datetime("s").pools["a"].is_datetime


def test_shared_folder_is_asked_for():
    from types import SimpleNamespace

    from kairoflow.session import shared_dir

    conf = SimpleNamespace(get=lambda name, default: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    assert shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file://")


def test_features(events, spark):
    dummies = events.cast_features({"label": "categorical"}).to_dummies("label", drop_first=True)
    assert [c for c in dummies.columns if c.startswith("label")] == ["label_B", "label_C"]
    flags = events.apply(flag="label = 'A'").withColumnRenamed("id", "id")
    wide = events.add_entity_features(flags)
    assert wide.features == ["flag", "label"] and wide.entity.where("flag").count() == 2
    with pytest.raises(ValueError):
        wide.add_entity_features(flags)
    more = events.add_static_features(spark.createDataFrame([(2, "x")], "id long, tag string"))
    assert {r[ID]: r.tag for r in more.static.collect()}[2] == "x"
    assert more.drop_features("tag", is_static=True).static_features == ["age", "stop"]
    with pytest.raises(KeyError):
        events.temporal_data(["nope"])
    assert events.row(1, -1)["_t"] == 5.0
    assert dict(events.cast_id("string").entity.dtypes)[ID] == "string"
    assert events.cast_to_datetime("s").row(1, 1)["_t"] == datetime(1970, 1, 1, 0, 0, 2)


def test_sets(events):
    with pytest.raises(ValueError):
        events.extend(events)
    one, two = events.split(ratio=0.5, seed=1)
    assert one.ids().count() == two.ids().count() == 2 and one.ids().intersect(two.ids()).isEmpty()
    back = one.extend(two)
    assert back.entity.count() == 6 and ids(back.ids()) == {1, 2, 3, 9}


def test_trajectories(events, states, static):
    t = build_trajectories({"e": events, "s": states.subset([1])}, static, "id")
    seen = {r.id: (r.e, r.s) for r in t.presence().collect()}
    assert seen == {1: (True, True), 2: (True, False), 3: (True, False), 9: (False, False)}
    assert ids(t.which(Static("age > 40"))) == {3, 9} and ids(t.which(Length(ge=3), alias="s")) == {1}
    assert t.describe().where("id = 2").first().s_length is None
    assert t.drop_pools("s").aliases == ["e"]
    closed = build_trajectories({"e": events, "i": events.as_interval(1.0)}, static, "id")
    assert closed.binned_data({"e": ["label"], "i": ["label"]}, 2.0).columns == ["id", "bin", "e_label", "i_label"]
    with pytest.raises(ValueError):
        t.set_t0(position=0)
    assert t.set_t0(on="e", position=1).t0_data().where("id = 1").first().s_t0_rank == 1
    with pytest.raises(TypeError):
        t.add("x", events.cast_id("string"))


def test_stores(events, states, static, spark, tmp_path):
    path = str(tmp_path / "pool")
    saved = save_pool(events.set_t0(position=0), path)
    assert saved.entity.count() == 6 and saved.t0 is not None
    with pytest.raises(FileExistsError):
        save_pool(events, path)
    assert save_pool(load_pool(spark, path).subset([1]), path, overwrite=True).entity.count() == 3
    ws = Workspace(spark, str(tmp_path / "ws"))
    ws["a"] = events
    ws["t"] = build_trajectories({"e": events, "s": states}, static, "id")
    assert ws.names() == ["a", "t"] and ws["t"].aliases == ["e", "s"] and ws["a"].kind == "event"
    del ws["a"]
    assert ws.names() == ["t"]
    with pytest.raises(KeyError):
        ws["a"]


def test_readers_and_simulators(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("id,t,label\n1,2020-01-01 10:00:00,A\n")
    assert dict(read_csv(spark, str(path)).dtypes)["t"] == "timestamp_ntz"
    assert read_sql(spark, "SELECT '03/02/2020' AS d", parse_dates=("d",)).first().d == datetime(2020, 2, 3)
    with pytest.raises(KeyError):
        source(spark, "nope")
    a, b = (simulate_events(spark, 5, seed=4).entity.orderBy(ID, RANK).collect() for _ in range(2))
    assert a == b
    apart = simulate_intervals(spark, 5, overlap=False).entity.orderBy(ID, RANK).collect()
    assert all(x._end <= y._start for x, y in zip(apart, apart[1:]) if x[ID] == y[ID])
    assert simulate_states(spark, 3).kind == "state" and simulate_trajectories(spark, 3).aliases == ["events", "intervals", "states"]


def test_stream(spark, sf, tmp_path):
    from kairoflow.streaming import event_counts, read_events, sessions

    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    for name, made in (("counts", lambda s: event_counts(s, "ts", "1 day", "event_type")), ("visits", lambda s: sessions(s, "user_id", "ts", "2 hours"))):
        stream = read_events(spark, str(tmp_path / "in"), schema, "ts")
        q = made(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_long_durations_do_not_overflow(spark):
    """Sums beyond a long come as exact decimals, others as longs."""
    from decimal import Decimal

    from kairoflow.charts import bar_table
    from kairoflow.operators import build_intervals

    rows = [(i, 0, 2**62, "x") for i in range(3)] + [(9, 5, 8, "y")]
    pool = build_intervals(spark.createDataFrame(rows, "id long, a long, b long, kind string"), "id", "a", "b")
    assert [tuple(r) for r in bar_table(pool, "kind", show_as="duration").collect()] == [("all", "x", Decimal(3 * 2**62)), ("all", "y", Decimal(3))]
    short = bar_table(pool.subset([0, 9]), "kind", show_as="duration")
    assert dict(short.dtypes)["value"] == "bigint" and [r.value for r in short.collect()] == [2**62, 3]


def test_the_grid_of_bins_is_not_moved(spark, monkeypatch):
    """Bins are made beside their id, in tasks of bounded size, and nothing is dealt or sorted by bin."""
    import re

    from kairoflow.operators import binning, build_intervals

    rows = [(i, 10 * k, 10 * k + 25 * (i % 3), float(k)) for i in range(40) for k in range(i % 5)] + [(99, 17, 3, 1.0)]
    pool = build_intervals(spark.createDataFrame(rows, "id long, a long, b long, v double"), "id", "a", "b")
    monkeypatch.setattr(binning, "ROWS_AT_ONCE", 50, raising=False)
    frame = pool.binned_data(bin_size=10, overlap_rule="sum", fill_value=-1.0)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*_bin", plan)
    assert f"hashpartitioning(_id#" in plan and max(int(n) for n in re.findall(r"hashpartitioning\(_id[^)]*, (\d+)\)", plan)) > 4
    expected = {(i, b): -1.0 for i in {r[0] for r in rows} for b in range(9)}
    for i, a, b, v in rows:
        for k in range(a // 10 if a <= b else 9, min(b // 10, 8) + 1):
            expected[i, k] = v + max(expected[i, k], 0.0)
    got = {(r["id"], r["bin"]): r["v"] for r in frame.collect()}
    assert got == expected, [(k, got.get(k), expected.get(k)) for k in sorted({*got, *expected}) if got.get(k) != expected.get(k)][:6]
