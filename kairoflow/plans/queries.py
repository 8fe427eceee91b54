"""One query for each operator family, with DuckDB SQL that gives the same rows.

Pair queries and clusterers run over all ids, and so does their SQL. Dynamic programs other than
the unit-cost edit distance and the clusterers have no SQL; tests hold them against plain programs.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairoflow.charts import bar_table, occupancy_table, span_table, timeline_table
from kairoflow.cluster import CLARA, PAM, Hierarchical
from kairoflow.metrics import DTW, LCP, LCS, Aggregation, Chi2, Combined, Edit, Hamming, LinearPairwise, SoftDTW, SquaredL2, StaticMetric
from kairoflow.operators import ANY, WILDCARD, Entity, Length, Pattern, Rank, Static, Time
from kairoflow.operators.pool import ID
from kairoflow.plans import pools as p

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Ranked events, states, orders and shipments.
E = "e AS (SELECT user_id AS id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
S = E + ", s AS (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY r) AS te FROM e)"
O = "o AS (SELECT o_custkey AS id, o_orderdate AS ts, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders)"
I = "i AS (SELECT o_custkey AS id, o_orderdate AS ts, shipped AS te, o_orderpriority FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE shipped >= o_orderdate)"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def _us(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a}))"


def _pick(pool, ids):
    """Events of the ids that a criterion gave, counted."""
    return pool.subset(ids).entity.groupBy(F.col(ID).alias("id")).agg(F.count("*").alias("n"))


def _rounded(name: str, digits: int):
    """What ``F.round`` gives; it goes by way of decimals, which only numbers near a half need."""
    scaled = F.col(name) * float(10**digits)
    whole = F.rint(scaled)
    plain = (F.abs(scaled) <= 1e10) & (F.abs(scaled - whole) < 0.499)
    return F.when(plain, whole / float(10**digits)).otherwise(F.round(name, digits))


def _rows(frame, *names):
    return frame.select(F.col(ID).alias("id"), *names)


# -- description -------------------------------------------------------------------------------

_EVENTS = f"""SELECT id, count(*) AS length, count(DISTINCT struct_pack(a := event_type, b := value)) AS n_unique_entities, {_us('min(ts)', 'max(ts)')} AS temporal_span,
 floor(median(g))::BIGINT AS median_gap, floor(stddev_samp(g))::BIGINT AS gap_std FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY id ORDER BY r) AS g FROM e) GROUP BY id"""


@query("describe_events", f"WITH {E} {_EVENTS}")
def _(spark, sf):
    return p.events(spark, sf).describe().withColumnRenamed("user_id", "id")


@query("describe_states", f"""WITH {S}, c AS (SELECT *, {_us('ts', 'te')} AS d, coalesce(event_type <> lag(event_type) OVER (PARTITION BY id ORDER BY r), false) AS ch FROM s)
SELECT id, count(*) AS length, count(DISTINCT event_type) AS n_unique_entities, {_us('min(ts)', 'max(te)')} AS temporal_span, floor(avg(d))::BIGINT AS mean_duration,
 floor(median(d))::BIGINT AS median_duration, floor(stddev_samp(d))::BIGINT AS duration_std, greatest(count_if(ch) - 1, 0)::BIGINT AS n_transitions, count_if(ch)::BIGINT AS n_changes FROM c GROUP BY id""")
def _(spark, sf):
    return p.states(spark, sf).describe().withColumnRenamed("user_id", "id")


@query("describe_intervals", f"""WITH {I}, d AS (SELECT *, {_us('ts', 'te')} AS d FROM i)
SELECT id, count(*) AS length, count(DISTINCT o_orderpriority) AS n_unique_entities, {_us('min(ts)', 'max(te)')} AS temporal_span, floor(avg(d))::BIGINT AS mean_duration,
 floor(median(d))::BIGINT AS median_duration, round(stddev_samp(d) / 1000000) AS seconds_std FROM d GROUP BY id""")
def _(spark, sf):
    found = p.shipments(spark, sf).describe().withColumnRenamed("o_custkey", "id")
    return found.withColumn("seconds_std", F.round(F.col("duration_std") / 1000000)).drop("duration_std")


@query("describe_rollup", f"""WITH {E}, d AS ({_EVENTS}), u AS (UNPIVOT (SELECT length::DOUBLE AS length, temporal_span::DOUBLE AS temporal_span, median_gap::DOUBLE AS median_gap FROM d) ON length, temporal_span, median_gap INTO NAME metric VALUE v)
SELECT metric, count(v)::DOUBLE AS n, round(avg(v), 3) AS mean, round(min(v), 3) AS low, round(quantile_cont(v, 0.25), 3) AS q1, round(quantile_cont(v, 0.5), 3) AS q2, round(max(v), 3) AS high FROM u GROUP BY metric""")
def _(spark, sf):
    names = {"count": "n", "mean": "mean", "min": "low", "25%": "q1", "50%": "q2", "max": "high"}
    frame = p.events(spark, sf).describe(by_id=False)
    long = frame.select("statistic", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("length", "temporal_span", "median_gap")])).alias("x")).select("statistic", "x.*")
    out = long.groupBy("metric").pivot("statistic", list(names)).agg(F.first("v"))
    return out.select("metric", *[F.round(F.col(f"`{k}`"), 3).alias(v) if v != "n" else F.col(f"`{k}`").alias(v) for k, v in names.items()])


@query("describe_empty_ids", f"WITH {E}, d AS ({_EVENTS}) SELECT c_custkey::BIGINT AS id, coalesce(length, 0) AS length, n_unique_entities, median_gap FROM customer LEFT JOIN d ON d.id = c_custkey")
def _(spark, sf):
    return p.events_static(spark, sf).describe().select(F.col("user_id").alias("id"), "length", "n_unique_entities", "median_gap")


@query("feature_metadata", "SELECT min(value) AS low, max(value) AS high, min(length(event_type))::INT AS shortest, max(length(event_type))::INT AS longest FROM events")
def _(spark, sf):
    entity = p.events(spark, sf).entity
    return entity.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min(F.length("event_type")).alias("shortest"), F.max(F.length("event_type")).alias("longest"))


@query("survival", f"""WITH {E}, z AS (SELECT id, ts AS t0 FROM e WHERE r = 0), f AS (SELECT id, min(ts) AS ended FROM e WHERE event_type = 'purchase' GROUP BY id), c AS (SELECT id, max(ts) AS censor FROM e GROUP BY id)
SELECT id, ended IS NOT NULL AS occurred, epoch_us(coalesce(ended, censor)) - epoch_us(t0) AS time FROM z LEFT JOIN f USING (id) JOIN c USING (id) WHERE epoch_us(coalesce(ended, censor)) > epoch_us(t0)""")
def _(spark, sf):
    pool = p.events(spark, sf)
    ended = pool.entity.where("event_type = 'purchase'").groupBy(ID).agg(F.min("_t").alias("ended"))
    static = pool.ids().join(ended, ID, "left").withColumnRenamed(ID, "user_id")
    return pool.add_static_features(static).survival_target("ended").withColumnRenamed("user_id", "id")


# -- criteria ----------------------------------------------------------------------------------


@query("filter_entity_rows", f"WITH {E} SELECT id, ts, event_type, value FROM e WHERE value > 50 AND event_type <> 'view'")
def _(spark, sf):
    return p.events(spark, sf).filter_entities(Entity("value > 50 AND event_type <> 'view'")).temporal_data().withColumnRenamed("user_id", "id")


@query("filter_entity_any", f"WITH {E} SELECT id, count(*) AS n FROM e WHERE id IN (SELECT id FROM e WHERE value > 95) GROUP BY id")
def _(spark, sf):
    pool = p.events(spark, sf)
    return _pick(pool, pool.which(Entity(F.col("value") > 95)))


@query("filter_length", f"WITH {E} SELECT id, count(*) AS n FROM e GROUP BY id HAVING count(*) >= 60 AND count(*) < 80")
def _(spark, sf):
    pool = p.events(spark, sf)
    return _pick(pool, pool.which(Length(ge=60, lt=80)))


@query("filter_static", f"WITH {E} SELECT id, count(*) AS n FROM e JOIN customer ON c_custkey = id WHERE c_acctbal > 3000 AND c_mktsegment = 'BUILDING' GROUP BY id")
def _(spark, sf):
    pool = p.events_static(spark, sf)
    return _pick(pool, pool.which(Static("c_acctbal > 3000 AND c_mktsegment = 'BUILDING'")))


@query("idset_algebra", f"WITH {E} (SELECT id FROM e GROUP BY id HAVING count(*) >= 60) INTERSECT (SELECT id FROM e WHERE value > 90) EXCEPT (SELECT id FROM e GROUP BY id HAVING count(*) > 90)")
def _(spark, sf):
    pool = p.events(spark, sf)
    ids = pool.which(Length(ge=60)).intersect(pool.which(Entity("value > 90"))).subtract(pool.which(Length(gt=90)))
    return ids.withColumnRenamed(ID, "id")


for _name, _rank, _where in (
    ("first", Rank(first=3), "r < 3"),
    ("last", Rank(last=2), "r >= n - 2"),
    ("slice", Rank(start=4, end=-4, step=3), "r >= 4 AND r < n - 4 AND r % 3 = 0"),
    ("picks", Rank(ranks=(0, 5, -1)), "r = 0 OR r = 5 OR r = n - 1"),
):
    query(f"filter_rank_{_name}", f"WITH {E} SELECT id, ts FROM e WHERE {_where}")(lambda spark, sf, rank=_rank: _rows(p.events(spark, sf).filter_entities(rank).entity, F.col("_t").alias("ts")))


@query("filter_rank_relative", f"""WITH {E}, z AS (SELECT id, arg_min(ts, r) AS t0 FROM e WHERE event_type = 'purchase' GROUP BY id), k AS (SELECT e.id, max(r) AS nr FROM e JOIN z USING (id) WHERE ts <= t0 GROUP BY e.id)
SELECT e.id, ts FROM e LEFT JOIN k USING (id) WHERE nr IS NULL OR (r - nr >= -2 AND r - nr < 3)""")
def _(spark, sf):
    pool = p.events(spark, sf).set_t0(query="event_type = 'purchase'")
    return _rows(pool.filter_entities(Rank(start=-2, end=3, relative=True)).entity, F.col("_t").alias("ts"))


_LO, _HI = datetime(1996, 1, 1), datetime(1996, 12, 31)


@query("filter_time_overlap", f"WITH {I} SELECT id, ts, te FROM i WHERE te >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1996-12-31'")
def _(spark, sf):
    return _rows(p.shipments(spark, sf).filter_entities(Time(start_ge=_LO, end_le=_HI)).entity, F.col("_start").alias("ts"), F.col("_end").alias("te"))


@query("filter_time_contain", f"WITH {I} SELECT id, ts, te FROM i WHERE ts >= TIMESTAMP '1996-01-01' AND te <= TIMESTAMP '1996-12-31'")
def _(spark, sf):
    return _rows(p.shipments(spark, sf).filter_entities(Time(start_ge=_LO, end_le=_HI, duration_within=True)).entity, F.col("_start").alias("ts"), F.col("_end").alias("te"))


@query("filter_time_all", f"WITH {I} SELECT id, count(*) AS n FROM i GROUP BY id HAVING bool_and(ts >= TIMESTAMP '1994-01-01')")
def _(spark, sf):
    pool = p.shipments(spark, sf)
    return _pick(pool, pool.which(Time(start_ge=datetime(1994, 1, 1), duration_within=True, all_entities=True)))


_L = "l AS (SELECT *, lead(event_type) OVER w AS t1, lead(event_type, 2) OVER w AS t2 FROM e WINDOW w AS (PARTITION BY id ORDER BY r))"


@query("pattern_adjacent", f"WITH {E}, {_L} SELECT DISTINCT id FROM l WHERE event_type = 'click' AND t1 = 'purchase'")
def _(spark, sf):
    pool = p.events(spark, sf)
    return pool.which(Pattern("event_type", ["^click$", "^purchase$"])).withColumnRenamed(ID, "id")


@query("pattern_gap", f"WITH {E}, f AS (SELECT id, min(r) AS r FROM e WHERE event_type = 'signup' GROUP BY id) SELECT DISTINCT e.id FROM e JOIN f USING (id) WHERE event_type = 'purchase' AND e.r > f.r")
def _(spark, sf):
    return p.events(spark, sf).which(Pattern("event_type", ["signup", ANY, "purchase"], regex=False)).withColumnRenamed(ID, "id")


@query("pattern_wildcard", f"WITH {E}, {_L} SELECT DISTINCT id FROM l WHERE event_type = 'view' AND t1 IS NOT NULL AND t2 = 'purchase'")
def _(spark, sf):
    return p.events(spark, sf).which(Pattern("event_type", ["view", WILDCARD, "purchase"])).withColumnRenamed(ID, "id")


@query("pattern_absent", f"WITH {E}, {_L} SELECT DISTINCT id FROM e EXCEPT SELECT id FROM l WHERE event_type ILIKE '%click%' AND t1 ILIKE '%click%' AND t2 ILIKE '%click%'")
def _(spark, sf):
    return p.events(spark, sf).which(Pattern("event_type", ["CLICK", "CLICK", "CLICK"], present=False, case_sensitive=False)).withColumnRenamed(ID, "id")


@query("pattern_witness", f"WITH {E}, {_L}, f AS (SELECT id, min(r) AS f FROM l WHERE event_type = 'click' AND t1 = 'purchase' GROUP BY id) SELECT e.id, ts, event_type FROM e JOIN f USING (id) WHERE r = f OR r = f + 1")
def _(spark, sf):
    return _rows(p.events(spark, sf).filter_entities(Pattern("event_type", ["click", "purchase"])).entity, F.col("_t").alias("ts"), "event_type")


# -- alignment ---------------------------------------------------------------------------------


@query("t0_position", f"WITH {E} SELECT id, ts AS t0, r AS t0_rank FROM e WHERE r = n - 3")
def _(spark, sf):
    return p.events(spark, sf).set_t0(position=-3).t0_data().withColumnRenamed("user_id", "id")


@query("t0_query_floor", f"""WITH {E}, z AS (SELECT id, max_by(ts, r) AS t0 FROM e WHERE value > 99 GROUP BY id)
SELECT u.id, t0, CASE WHEN t0 IS NOT NULL THEN coalesce(max(CASE WHEN ts <= t0 THEN r END), 0) END AS t0_rank FROM (SELECT DISTINCT id FROM e) u LEFT JOIN z USING (id) LEFT JOIN e ON e.id = u.id GROUP BY u.id, t0""")
def _(spark, sf):
    return p.events(spark, sf).set_t0(query="value > 99", use_first=False).t0_data().withColumnRenamed("user_id", "id")


@query("t0_direct", f"WITH {E} SELECT id, TIMESTAMP '2024-01-10' AS t0, coalesce(max(CASE WHEN ts <= TIMESTAMP '2024-01-10' THEN r END), 0) AS t0_rank FROM e GROUP BY id")
def _(spark, sf):
    return p.events(spark, sf).set_t0(direct=datetime(2024, 1, 10)).t0_data().withColumnRenamed("user_id", "id")


@query("relative_time", f"WITH {E} SELECT id, round((epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY id ORDER BY r))) / 86400000000.0, 6) AS days FROM e")
def _(spark, sf):
    return p.events(spark, sf).relative_time("d").select(F.col("user_id").alias("id"), F.round("ts", 6).alias("days"))


# -- conversion --------------------------------------------------------------------------------


@query("event_to_interval", f"WITH {E} SELECT id, ts AS start, ts + INTERVAL 90 MINUTE AS \"end\", event_type FROM e")
def _(spark, sf):
    return p.events(spark, sf).as_interval("90m").temporal_data(["event_type"]).withColumnRenamed("user_id", "id")


@query("event_to_state", f"WITH {S} SELECT id, ts AS start, coalesce(te, TIMESTAMP '2030-01-01') AS \"end\", event_type FROM s")
def _(spark, sf):
    return p.events(spark, sf).as_state(datetime(2030, 1, 1)).temporal_data(["event_type"]).withColumnRenamed("user_id", "id")


@query("period_middle", f"WITH {I} SELECT id, make_timestamp(epoch_us(ts) + (epoch_us(te) - epoch_us(ts)) // 2) AS time, o_orderpriority FROM i")
def _(spark, sf):
    return p.shipments(spark, sf).as_event("middle").temporal_data().withColumnRenamed("o_custkey", "id")


# -- projections and features --------------------------------------------------------------------


@query("one_hot", f"WITH {E} SELECT id, ts, " + ", ".join(f"(event_type = '{c}')::TINYINT AS event_type_{c}" for c in ("click", "error", "purchase", "signup", "view")) + " FROM e")
def _(spark, sf):
    frame = p.events(spark, sf).to_dummies("event_type", categories={"event_type": ["click", "error", "purchase", "signup", "view"]})
    return frame.withColumnRenamed("user_id", "id")


@query("apply_by_id", f"WITH {E} SELECT id, round(avg(value), 9) AS mean, count(DISTINCT event_type) AS kinds FROM e GROUP BY id")
def _(spark, sf):
    return p.events(spark, sf).apply(by_id=True, mean="round(avg(value), 9)", kinds="count(DISTINCT event_type)").withColumnRenamed("user_id", "id")


@query("apply_window", f"WITH {E} SELECT id, r, round(value - avg(value) OVER (PARTITION BY id), 9) AS centred FROM e")
def _(spark, sf):
    mean = F.avg("value").over(Window.partitionBy(ID))
    return p.events(spark, sf).apply(centred=F.round(F.col("value") - mean, 9)).withColumnsRenamed({"user_id": "id", "_rank": "r"})


@query("cast_lenient", f"WITH {E} SELECT id, r, try_cast(event_type AS INTEGER) AS event_type, value::BIGINT AS value FROM (SELECT id, r, event_type, floor(value) AS value FROM e)")
def _(spark, sf):
    pool = p.events(spark, sf).with_features(overwrite=True, value="floor(value)").cast_features({"event_type": "int", "value": "long"}, strict=False)
    return pool.entity.select(F.col(ID).alias("id"), F.col("_rank").alias("r"), "event_type", "value")


# -- bins --------------------------------------------------------------------------------------

_B = "x AS (SELECT *, ((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM e)) // 86400000000)::BIGINT AS bin FROM e)"


@query("binned_events", f"WITH {E}, {_B}, g AS (SELECT id, unnest(generate_series(0, (SELECT max(bin) FROM x)))::BIGINT AS bin FROM (SELECT DISTINCT id FROM e)), a AS (SELECT id, bin, arg_min(event_type, r) AS event_type, arg_min(value, r) AS value FROM x GROUP BY id, bin) SELECT id, bin, event_type, value FROM g LEFT JOIN a USING (id, bin)")
def _(spark, sf):
    return p.events(spark, sf).binned_data(bin_size="1d").withColumnRenamed("user_id", "id")


@query("binned_intervals", f"""WITH {I}, k AS (SELECT *, (epoch_us(ts) - (SELECT least(min(epoch_us(ts)), min(epoch_us(te))) FROM i)) // 2592000000000 AS a, (epoch_us(te) - (SELECT least(min(epoch_us(ts)), min(epoch_us(te))) FROM i)) // 2592000000000 AS b FROM i),
y AS (SELECT id, unnest(generate_series(a, b))::BIGINT AS bin, o_orderpriority FROM k), g AS (SELECT id, unnest(generate_series(0, (SELECT max(bin) FROM y)))::BIGINT AS bin FROM (SELECT DISTINCT id FROM i))
SELECT g.id, g.bin, coalesce(count(o_orderpriority), 0) AS o_orderpriority FROM g LEFT JOIN y USING (id, bin) GROUP BY g.id, g.bin""")
def _(spark, sf):
    return p.shipments(spark, sf).binned_data(bin_size="30d", overlap_rule="count", fill_value=0).withColumnRenamed("o_custkey", "id")


# -- trajectories ------------------------------------------------------------------------------


@query("presence_map", "SELECT c_custkey::BIGINT AS id, c_custkey IN (SELECT user_id FROM events) AS events, c_custkey IN (SELECT o_custkey FROM orders) AS orders FROM customer UNION SELECT user_id, true, user_id IN (SELECT o_custkey FROM orders) FROM events UNION SELECT o_custkey, o_custkey IN (SELECT user_id FROM events), true FROM orders")
def _(spark, sf):
    return p.trajectories(spark, sf).presence().withColumnRenamed("user_id", "id")


@query("trajectory_describe", f"WITH {E}, {O}, a AS ({_EVENTS}), b AS (SELECT id, count(*) AS length FROM o GROUP BY id), u AS (SELECT c_custkey::BIGINT AS id FROM customer UNION SELECT id FROM a UNION SELECT id FROM b) SELECT u.id, a.length AS events_length, a.median_gap AS events_median_gap, b.length AS orders_length, 2 AS n_sequences FROM u LEFT JOIN a USING (id) LEFT JOIN b USING (id)")
def _(spark, sf):
    return p.trajectories(spark, sf).describe().select(F.col("user_id").alias("id"), "events_length", "events_median_gap", "orders_length", "n_sequences")


@query("trajectory_t0", f"WITH {E}, {O}, z AS (SELECT id, ts AS t0 FROM e WHERE r = 1), u AS (SELECT c_custkey::BIGINT AS id FROM customer UNION SELECT id FROM e UNION SELECT id FROM o), f AS (SELECT o.id, max(CASE WHEN o.ts <= t0 THEN r END) AS k FROM o JOIN z USING (id) GROUP BY o.id) SELECT u.id, t0, CASE WHEN u.id IN (SELECT id FROM o) AND t0 IS NOT NULL THEN coalesce(k, 0) END AS orders_t0_rank FROM u LEFT JOIN z USING (id) LEFT JOIN f USING (id)")
def _(spark, sf):
    return p.trajectories(spark, sf).set_t0(on="events", position=1).t0_data().select(F.col("user_id").alias("id"), "t0", "orders_t0_rank")


# -- sets --------------------------------------------------------------------------------------


@query("extend_skip", f"WITH {E}, {O} SELECT id, ts FROM e UNION ALL SELECT id, ts FROM o WHERE id NOT IN (SELECT id FROM e)")
def _(spark, sf):
    joined = p.events(spark, sf).extend(p.orders(spark, sf), on_duplicate="skip")
    return joined.entity.select(F.col(ID).alias("id"), F.col("_t").alias("ts"))


@query("split_counts", "SELECT 'first' AS part, (count(DISTINCT user_id) * 7 // 10)::BIGINT AS n FROM events UNION ALL SELECT 'second', count(DISTINCT user_id) - (count(DISTINCT user_id) * 7 // 10)::BIGINT FROM events")
def _(spark, sf):
    pool = p.events(spark, sf)
    one, two = pool.split(count=pool.ids().count() * 7 // 10, seed=3)
    count = lambda q, name: q.ids().agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(one, "first").unionByName(count(two, "second"))


# -- charts ------------------------------------------------------------------------------------


@query("category_rate", "SELECT 'all' AS facet, event_type AS label, round(count(*) / sum(count(*)) OVER (), 9) AS value FROM events GROUP BY event_type")
def _(spark, sf):
    return bar_table(p.events(spark, sf), "event_type", show_as="rate").withColumn("value", F.round("value", 9))


@query("category_duration", f"WITH {I} SELECT c_mktsegment AS facet, o_orderpriority AS label, sum({_us('ts', 'te')})::BIGINT AS value FROM i JOIN customer ON c_custkey = id GROUP BY ALL")
def _(spark, sf):
    pool = p.shipments(spark, sf).add_static_features(p.customers(spark, sf).withColumnRenamed("id", "o_custkey"))
    return bar_table(pool, "o_orderpriority", show_as="duration", facet="c_mktsegment")


@query("occupancy_percent", f"""WITH {S}, m AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(coalesce(te, ts))) AS hi FROM s), b AS (SELECT id, event_type, unnest(generate_series(((epoch_us(ts) - lo + 86399999999) // 86400000000)::BIGINT, ((epoch_us(coalesce(te, make_timestamp(hi))) - lo + 86399999999) // 86400000000 - 1)::BIGINT)) AS bin FROM s, m),
c AS (SELECT bin, event_type AS label, count(DISTINCT id) AS v FROM b GROUP BY ALL) SELECT 'all' AS facet, bin, label, round(v * 100 / sum(v) OVER (PARTITION BY bin), 6) AS value FROM c""")
def _(spark, sf):
    return occupancy_table(p.states(spark, sf), "event_type", "1d").withColumn("value", F.round("value", 6))


@query("span_medians", f"WITH {I} SELECT 'all' AS facet, o_orderpriority AS label, round(median({_us('ts', 'te')} / 86400000000.0), 6) AS median, count(*) AS n FROM i GROUP BY o_orderpriority")
def _(spark, sf):
    return span_table(p.shipments(spark, sf), "o_orderpriority").groupBy("facet", "label").agg(F.round(F.max("median"), 6).alias("median"), F.count("*").alias("n"))


@query("timeline_rows", f"WITH {E} SELECT id, 'all' AS facet, event_type AS label, (dense_rank() OVER (ORDER BY id) - 1)::BIGINT AS y, ts FROM e")
def _(spark, sf):
    return timeline_table(p.events(spark, sf), "event_type").withColumnRenamed("user_id", "id")


# -- distances ---------------------------------------------------------------------------------

_F = E + ", q AS (SELECT * FROM e)"
_TYPE = Hamming("event_type")


_CHARS = _F + ", v AS (SELECT event_type, chr(96 + dense_rank() OVER (ORDER BY event_type)::INT) AS c FROM (SELECT DISTINCT event_type FROM q)), t AS (SELECT id, string_agg(c, '' ORDER BY r) AS s FROM q JOIN v USING (event_type) GROUP BY id)"


@query("dist_edit", f"WITH {_CHARS} SELECT a.id AS id_a, b.id AS id_b, levenshtein(a.s, b.s)::DOUBLE AS distance FROM t a JOIN t b ON a.id < b.id")
def _(spark, sf):
    return Edit(_TYPE).between(p.events(spark, sf), None)


_PAIRS = "k AS (SELECT a.id AS id_a, b.id AS id_b, a.r, a.event_type AS ta, b.event_type AS tb, a.value AS va, b.value AS vb, least(a.n, b.n) AS m, a.n AS na, b.n AS nb FROM q a JOIN q b ON a.id < b.id AND a.r = b.r)"


@query("dist_linear", f"WITH {_F}, {_PAIRS} SELECT id_a, id_b, round(avg((ta <> tb)::INT), 9) AS distance FROM k GROUP BY ALL")
def _(spark, sf):
    return LinearPairwise(_TYPE).between(p.events(spark, sf), None).withColumn("distance", _rounded("distance", 9))


@query("dist_l2", f"WITH {_F}, {_PAIRS} SELECT id_a, id_b, round(sum(CASE WHEN va * va + vb * vb > 0 THEN (va - vb) ** 2 / (va * va + vb * vb) ELSE 0 END), 6) AS distance FROM k GROUP BY ALL")
def _(spark, sf):
    return LinearPairwise(SquaredL2("value"), agg="sum").between(p.events(spark, sf), None).withColumn("distance", _rounded("distance", 6))


@query("dist_combined", f"WITH {_F}, {_PAIRS} SELECT id_a, id_b, round(avg((0.7 * (ta <> tb)::INT + 0.3 * CASE WHEN va * va + vb * vb > 0 THEN (va - vb) ** 2 / (va * va + vb * vb) ELSE 0 END)), 6) AS distance FROM k GROUP BY ALL")
def _(spark, sf):
    metric = Combined((_TYPE, SquaredL2("value")), (0.7, 0.3))
    return LinearPairwise(metric).between(p.events(spark, sf), None).withColumn("distance", _rounded("distance", 6))


@query("dist_lcp", f"WITH {_F}, {_PAIRS} SELECT id_a, id_b, (any_value(na) + any_value(nb) - 2 * coalesce(min(CASE WHEN ta <> tb THEN r END), any_value(m)))::DOUBLE AS distance FROM k GROUP BY id_a, id_b")
def _(spark, sf):
    return LCP(_TYPE).between(p.events(spark, sf), None)


@query("dist_chi2", f"""WITH {_F}, h AS (SELECT id, event_type, count(*) / any_value(n) AS s FROM q GROUP BY id, event_type), u AS (SELECT a.id AS id_a, b.id AS id_b FROM (SELECT DISTINCT id FROM q) a JOIN (SELECT DISTINCT id FROM q) b ON a.id < b.id),
c AS (SELECT id_a, id_b, y.event_type, coalesce(h1.s, 0) AS pa, coalesce(h2.s, 0) AS pb FROM u CROSS JOIN (SELECT DISTINCT event_type FROM q) y LEFT JOIN h h1 ON h1.id = id_a AND h1.event_type = y.event_type LEFT JOIN h h2 ON h2.id = id_b AND h2.event_type = y.event_type)
SELECT id_a, id_b, round(sqrt(sum(CASE WHEN pa + pb > 0 THEN (pa - pb) ** 2 / (pa + pb) ELSE 0 END)), 6) AS distance FROM c GROUP BY id_a, id_b""")
def _(spark, sf):
    return Chi2(feature="event_type").between(p.events(spark, sf), None).withColumn("distance", _rounded("distance", 6))


@query("dist_static", "SELECT a.c_custkey::BIGINT AS id_a, b.c_custkey::BIGINT AS id_b, (a.c_mktsegment <> b.c_mktsegment OR a.c_nationkey <> b.c_nationkey)::INT::DOUBLE AS distance FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey")
def _(spark, sf):
    return StaticMetric().of(p.customers(spark, sf).select(F.col("id").alias(ID), "c_mktsegment", "c_nationkey"))


@query("dist_aggregation", f"""WITH {_CHARS}, {O}, d AS (SELECT a.id AS id_a, b.id AS id_b, 2.0 AS w, levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) AS d FROM t a JOIN t b ON a.id < b.id
UNION ALL SELECT a.id, b.id, 1.0, avg((a.o_orderstatus <> b.o_orderstatus)::INT) FROM o a JOIN o b ON a.id < b.id AND a.r = b.r GROUP BY a.id, b.id)
SELECT id_a, id_b, round(sum(w * d) / sum(w), 6) AS distance FROM d GROUP BY id_a, id_b""")
def _(spark, sf):
    t = p.trajectories(spark, sf)
    return Aggregation({"events": Edit(_TYPE, normalize=True), "orders": LinearPairwise(Hamming("o_orderstatus"))}, weights={"events": 2.0}).matrix(t).pairs.withColumn("distance", _rounded("distance", 6))


@query("dist_lcs")
def _(spark, sf):
    return LCS(_TYPE).between(p.events(spark, sf), None)


@query("dist_dtw")
def _(spark, sf):
    return DTW(SquaredL2("value"), window=30).between(p.events(spark, sf), None)


@query("dist_softdtw")
def _(spark, sf):
    return SoftDTW(_TYPE, gamma=0.5).between(p.events(spark, sf), None)


@query("cluster_pam")
def _(spark, sf):
    return PAM(Edit(_TYPE), n_clusters=3).labels(p.events(spark, sf)).withColumnRenamed(ID, "id")


@query("cluster_hierarchical")
def _(spark, sf):
    return Hierarchical(Chi2(feature="event_type"), n_clusters=3, linkage="average").labels(p.events(spark, sf)).withColumnRenamed(ID, "id")


@query("cluster_clara")
def _(spark, sf):
    return CLARA(Chi2(feature="event_type"), n_clusters=2, sampling_ratio=0.3, instances=2, random_state=1).labels(p.events(spark, sf)).withColumnRenamed(ID, "id")
