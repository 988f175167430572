"""Queries over the test tables: each operator on whole tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..engine import Engine
from ..functions import labels as L
from ..functions.timeutil import DAY, HOUR, bucket, ntz_ns, shard_number
from ..metrics import text_lines
from ..operators import aggregate as A
from ..operators import points as P
from ..operators import series as S
from ..sources import requests, wal
from ..streaming.ingest import files, windowed
from ..streaming.late import OUT, judge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MONTH = 30 * DAY
#: 3 and 4 January 2024, and the years 1997 to 1999, in ns.
JANUARY = (1_704_240_000_000_000_000, 1_704_412_800_000_000_000)
YEARS = (852_076_800_000_000_000, 946_684_800_000_000_000)
ALL = (-(1 << 62), 1 << 62)

EVENTS = "(SELECT event_id AS seq, event_type AS name, CAST(user_id AS VARCHAR) AS usr, epoch_ns(ts) AS ts_ns, value FROM events)"
ORDERS = "(SELECT o_orderkey AS seq, o_orderstatus AS name, o_orderpriority AS priority, epoch_ns(o_orderdate) AS ts_ns, o_totalprice AS value FROM orders)"
LINES = "(SELECT l_returnflag AS name, epoch_ns(l_shipdate) AS ts_ns, l_extendedprice AS value FROM lineitem)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark, sf_dir) -> DataFrame:
    """name, labels (user), ts_ns, value, seq."""
    rows = session.apply(spark).read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_type").alias("name"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"), ntz_ns("ts").alias("ts_ns"), "value", F.col("event_id").alias("seq"))


def orders(spark, sf_dir) -> DataFrame:
    """name (status), labels (priority), ts_ns, value, seq."""
    rows = session.apply(spark).read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.col("o_orderstatus").alias("name"), F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("labels"), ntz_ns("o_orderdate").alias("ts_ns"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))


def lineitems(spark, sf_dir) -> DataFrame:
    rows = session.apply(spark).read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_returnflag").alias("name"), ntz_ns("l_shipdate").alias("ts_ns"), F.col("l_extendedprice").alias("value"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """To 4 places; the small offset takes values that lie between two of them the same way in any order of summation."""
    return df.withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in columns or ("value",)})


# range aggregates ------------------------------------------------------------
def _range_sql(value: str, source: str = EVENTS, where: str = "", step: int = HOUR) -> str:
    return f"SELECT name, ts_ns - ts_ns % {step} AS ts, round({value} + 1e-7, 4) AS value, count(*) AS count FROM {source} {where} GROUP BY ALL"


def _range(agg: str, value: str) -> None:
    def run(spark, sf_dir):
        return rounded(A.aggregate(A.in_range(events(spark, sf_dir), *ALL), agg, HOUR, ["name"]))

    run.__name__ = f"range_{agg}_1h"
    query(_range_sql(value))(run)


for _agg, _sql in (("avg", "avg(value)"), ("sum", "sum(value)"), ("min", "min(value)"), ("max", "max(value)"), ("count", "CAST(count(*) AS DOUBLE)")):
    _range(_agg, _sql)


@query(f"WITH b AS (SELECT name, ts_ns - ts_ns % {HOUR} AS ts, avg(value) AS v, count(*) AS count FROM {EVENTS} GROUP BY ALL) SELECT name, ts, round(v - coalesce(lag(v) OVER (PARTITION BY name ORDER BY ts), 0) + 1e-7, 4) AS value, count FROM b")
def range_delta_1h(spark, sf_dir):
    return rounded(A.aggregate(events(spark, sf_dir), "delta", HOUR, ["name"]))


@query(_range_sql("avg(value)", where=f"WHERE ts_ns >= {JANUARY[0]} AND ts_ns < {JANUARY[1]}"))
def range_filter(spark, sf_dir):
    return rounded(A.aggregate(A.in_range(events(spark, sf_dir), *JANUARY), "avg", HOUR, ["name"]))


@query(_range_sql("avg(value)", LINES, step=DAY))
def lineitem_avg_1d(spark, sf_dir):
    return rounded(A.aggregate(lineitems(spark, sf_dir), "avg", "1d", ["name"]))


@query(_range_sql("avg(value)", step=60_000_000_000))
def default_step(spark, sf_dir):
    return rounded(A.aggregate(events(spark, sf_dir), "no such aggregate", 0, ["name"]))


@query(f"SELECT priority, ts_ns - ts_ns % {MONTH} AS ts, round(sum(value), 2) AS sum, min(value) AS min, max(value) AS max, count(*) AS count FROM {ORDERS} WHERE priority IN ('1-URGENT', '5-LOW') GROUP BY ALL")
def multi_series(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("priority", F.col("labels")["priority"]).where(F.col("priority").isin("1-URGENT", "5-LOW"))
    out = rows.groupBy("priority", bucket(F.col("ts_ns"), MONTH).alias("ts")).agg(F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count"))
    return out.withColumn("sum", F.round("sum", 2))


@query(f"""
WITH s AS (SELECT name, usr, row_number() OVER (ORDER BY min(seq)) AS id FROM {EVENTS} GROUP BY name, usr),
asked AS (SELECT * FROM (VALUES (0, 2), (1, 999999999), (2, 2), (3, 1)) t(pos, id)),
b AS (SELECT s.id, e.ts_ns - e.ts_ns % {DAY} AS ts, max(value) AS value, count(*) AS count FROM {EVENTS} e JOIN s ON e.name = s.name AND e.usr = s.usr GROUP BY ALL)
SELECT CAST(a.pos AS INTEGER) AS pos, CAST(a.id AS BIGINT) AS series_id, coalesce(s.name, '') AS name, count(b.ts) AS n, CAST(coalesce(sum(b.count), 0) AS BIGINT) AS points, max(b.value) AS top
FROM asked a LEFT JOIN s ON a.id = s.id LEFT JOIN b ON a.id = b.id GROUP BY a.pos, a.id, s.name""")
def multi_request(spark, sf_dir):
    """Requested order, a repeated and an unknown id; the nested results summed up, as arrays compare badly."""
    rows = events(spark, sf_dir)
    dim = S.register(rows, S.empty(spark))
    out = A.query_many(S.with_ids(rows, dim), dim, [2, 999_999_999, 2, 1], *ALL, "max", DAY)
    top = F.aggregate("results", F.lit(None).cast("double"), lambda a, x: F.greatest(a, x["value"]))
    return out.select("pos", "series_id", "name", F.size("results").cast("long").alias("n"), F.aggregate("results", F.lit(0).cast("long"), lambda a, x: a + x["count"]).alias("points"), top.alias("top"))


# series ----------------------------------------------------------------------
_SERIES = f"(SELECT CAST(row_number() OVER (ORDER BY min(seq)) AS BIGINT) AS series_id, name, usr FROM {EVENTS} GROUP BY name, usr)"


@query(f"SELECT * FROM {_SERIES}")
def register_series(spark, sf_dir):
    return S.register(events(spark, sf_dir), S.empty(spark)).select("series_id", "name", F.col("labels")["user"].alias("usr"))


@query(f"SELECT name, usr, CAST(750 + row_number() OVER (ORDER BY min(seq)) AS BIGINT) AS series_id FROM (SELECT * FROM {EVENTS} e WHERE CAST(usr AS BIGINT) % 2 = 1) GROUP BY name, usr")
def register_the_rest(spark, sf_dir):
    """Series of even users are known, with ids up to 750: the others follow on."""
    rows = events(spark, sf_dir)
    known = rows.where(F.col("labels")["user"].cast("long") % 2 == 0).groupBy("name", L.key(F.col("labels")).alias("k")).agg(F.lit(750).cast("long").alias("series_id"))
    known = known.select("series_id", "name", F.map_from_entries("k").alias("labels"))
    return S.register(rows, known).select("name", F.col("labels")["user"].alias("usr"), "series_id")


@query(f"SELECT ts_ns - ts_ns % {DAY} AS ts, round(avg(value) + 1e-7, 4) AS value, count(*) AS count FROM {EVENTS} WHERE name = 'error' AND usr = '8' GROUP BY ALL")
def series_lookup(spark, sf_dir):
    rows = events(spark, sf_dir)
    dim = S.register(rows, S.empty(spark))
    own = S.with_ids(rows, dim).join(F.broadcast(S.lookup(dim, "error", {"user": "8"}).select("series_id")), "series_id", "left_semi")
    return rounded(A.aggregate(own, "avg", DAY).drop("series_id"))


@query(f"SELECT CAST(i AS BIGINT) AS series_id, coalesce(s.name, '') AS name FROM (SELECT unnest(range(1, 2001)) AS i) LEFT JOIN {_SERIES} s ON s.series_id = i")
def name_by_id(spark, sf_dir):
    dim = S.register(events(spark, sf_dir), S.empty(spark))
    return S.names_of(spark.range(1, 2001).select(F.col("id").alias("series_id")), dim)


@query(f"SELECT count(*) AS series FROM {_SERIES}")
def series_cardinality(spark, sf_dir):
    return S.cardinality(S.register(events(spark, sf_dir), S.empty(spark)))


@query("""SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_.-]{1,128}') AS good_name, regexp_full_match(c_mktsegment, '[A-Za-z0-9_.]{1,64}') AS good_label, 'c{seg=' || c_mktsegment || '}' AS shown FROM customer""")
def valid_names(spark, sf_dir):
    rows = session.apply(spark).read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_custkey", L.valid_name(F.col("c_name")).alias("good_name"), L.valid_labels(F.create_map("c_mktsegment", F.lit("x"))).alias("good_label"), L.shown(F.lit("c"), F.create_map(F.lit("seg"), F.col("c_mktsegment"))).alias("shown"))


@query("""SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, CAST(2 AS INTEGER) AS n FROM orders""")
def parse_labels(spark, sf_dir):
    """Label texts with a pair without =, one with an empty key, a repeated key and a trailing comma."""
    rows = session.apply(spark).read.parquet(f"{sf_dir}/orders.parquet")
    text = F.concat(F.lit("status=old,x,=y,priority="), F.col("o_orderpriority"), F.lit(",status="), F.col("o_orderstatus"), F.lit(","))
    own = rows.select("o_orderkey", L.parsed(text).alias("m"))
    return own.select("o_orderkey", F.col("m")["status"].alias("status"), F.col("m")["priority"].alias("priority"), F.size("m").alias("n"))


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer")
def trim_values(spark, sf_dir):
    rows = session.apply(spark).read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_custkey", L.trimmed(F.concat(F.lit("　\t "), F.col("c_mktsegment"), F.lit(" \n"))).alias("segment"))


# write requests --------------------------------------------------------------
@query("""SELECT coalesce(CASE WHEN o_orderkey % 10 = 3 THEN 'bad ts' WHEN o_orderkey % 10 = 4 THEN 'bad value' WHEN o_orderkey % 10 = 5 THEN 'bad label' WHEN contains(o_clean, ' ') THEN 'bad name' END, 'ok') AS reason, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM (SELECT *, CASE WHEN o_orderkey % 10 = 6 THEN 'bad name' ELSE o_orderstatus END AS o_clean FROM orders) GROUP BY 1""")
def write_requests(spark, sf_dir):
    """Requests as text, some unreadable: accepted and quarantined rows by reason."""
    rows = session.apply(spark).read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 10
    text = rows.select(
        F.when(k == 6, "bad name").otherwise(F.col("o_orderstatus")).alias("name"),
        F.when(k == 5, "a-b=1").otherwise(F.concat(F.lit("priority="), F.col("o_orderpriority"))).alias("labels"),
        F.when(k == 3, " 12 ").otherwise(ntz_ns("o_orderdate").cast("string")).alias("ts"),
        F.when(k == 4, "1.5d").otherwise(F.col("o_totalprice").cast("string")).alias("value"),
        F.col("o_orderkey").alias("seq"), "o_totalprice",
    )
    parsed = requests.validated(requests.single(text)).join(text.select("seq", "o_totalprice"), "seq")
    return parsed.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT name, count(*) AS n, CAST(min(ts_ns) AS BIGINT) AS first, CAST(max(ts_ns) AS BIGINT) AS last, round(sum(value) + 1e-7, 4) AS total FROM {EVENTS} GROUP BY name")
def bulk_json(spark, sf_dir):
    """JSON arrays of points, one per user, read back with all 19 digits of their times."""
    rows = events(spark, sf_dir)
    point = F.struct("name", "labels", F.col("ts_ns").alias("ts"), "value")
    bodies = rows.groupBy(F.col("labels")["user"].cast("long").alias("seq"), F.pmod("seq", F.lit(16)).alias("part")).agg(F.to_json(F.collect_list(point)).alias("body"))
    good, _ = requests.accept(requests.bulk(bodies.select("seq", "body")))
    return good.groupBy("name").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first"), F.max("ts_ns").alias("last"), F.round(F.sum("value") + 1e-7, 4).alias("total"))


# points ----------------------------------------------------------------------
@query(f"SELECT name, priority, ts_ns, arg_max(value, seq) AS value, max(seq) AS seq FROM {ORDERS} GROUP BY name, priority, ts_ns")
def last_write_wins(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("priority", F.col("labels")["priority"])
    return P.last_write_wins(rows, "name", "priority")


@query(f"SELECT name, ts_ns - ts_ns % {MONTH} AS ts, round(sum(value), 2) AS value, count(*) AS count FROM (SELECT name, priority, ts_ns, arg_max(value, seq) AS value FROM {ORDERS} GROUP BY ALL) GROUP BY ALL")
def last_write_then_sum(spark, sf_dir):
    rows = P.last_write_wins(orders(spark, sf_dir).withColumn("priority", F.col("labels")["priority"]), "name", "priority")
    return A.aggregate(rows, "sum", MONTH, ["name"]).withColumn("value", F.round("value", 2))


@query(f"SELECT name, ts_ns - ts_ns % {MONTH} AS ts, round(sum(value), 2) AS value, count(*) AS count FROM {ORDERS} GROUP BY ALL")
def union_without_dedup(spark, sf_dir):
    rows = orders(spark, sf_dir)
    both = rows.where("seq < 5000").unionByName(rows.where("seq >= 5000"))
    return A.aggregate(both, "sum", MONTH, ["name"]).withColumn("value", F.round("value", 2))


_LATE = f"""WITH r AS (SELECT *, max(ts_ns) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {ORDERS}),
j AS (SELECT *, ts_ns >= greatest(coalesce(pm - pm % {MONTH}, 0), 0) AS accepted FROM r)"""


@query(_LATE + " SELECT name, CAST(count_if(accepted) AS BIGINT) AS accepted, count(*) AS total FROM j GROUP BY name")
def late_accept(spark, sf_dir):
    rows = P.floors(orders(spark, sf_dir), MONTH, 0)
    return rows.groupBy("name").agg(F.count_if(P.on_time()).alias("accepted"), F.count("*").alias("total"))


@query(_LATE + " SELECT seq, ts_ns, accepted FROM j")
def late_accept_stream(spark, sf_dir):
    """The streaming rule over the table as a stream, against the running maximum in SQL.

    The table arrives in four stretches of seq, each taken up before the next is there: the order of files says
    nothing of that of seq. The floor goes from one to the next by the checkpoint.
    """
    folder = session.work_dir(spark, "late")
    rows = orders(spark, sf_dir).withColumn("series_id", F.lit(0).cast("long")).select("series_id", "ts_ns", "value", "seq")
    lo, hi = rows.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    cuts = [lo + (hi + 1 - lo) * k // 4 for k in range(5)]
    for start, end in zip(cuts, cuts[1:], strict=False):
        rows.where((F.col("seq") >= start) & (F.col("seq") < end)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        judge(stream, f"{folder}/out", f"{folder}/state", MONTH, 0).awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out").select("seq", "ts_ns", "accepted")


@query(f"SELECT seq, ts_ns - 1704672000000000000 - (ts_ns - 1704672000000000000) % {DAY} AS ts, ts_ns // {HOUR} + 1 AS shard FROM {EVENTS}")
def bucket_expressions(spark, sf_dir):
    """Buckets of times on both sides of 0 (days around 8 January 2024), and shard ordinals."""
    rows = events(spark, sf_dir)
    return rows.select("seq", bucket(F.col("ts_ns") - 1_704_672_000_000_000_000, DAY).alias("ts"), shard_number(F.col("ts_ns"), HOUR).alias("shard"))


# downsampling, shards, retention ---------------------------------------------
_DAILY = f"(SELECT name, usr, ts_ns - ts_ns % {DAY} AS ts_ns, avg(value) AS value, sum(value) AS s, count(*) AS c, min(value) AS lo, max(value) AS hi FROM {EVENTS} GROUP BY name, usr, ts_ns - ts_ns % {DAY})"


def _daily(spark, sf_dir) -> DataFrame:
    return A.downsample(events(spark, sf_dir).withColumn("usr", F.col("labels")["user"]), DAY, ["name", "usr"])


@query(f"SELECT name, usr, ts_ns, round(value + 1e-7, 4) AS value, c AS count, lo AS min, hi AS max FROM {_DAILY}")
def downsample_1d(spark, sf_dir):
    return rounded(_daily(spark, sf_dir)).select("name", "usr", "ts_ns", "value", "count", "min", "max")


@query(f"SELECT name, ts_ns - ts_ns % {7 * DAY} AS ts, round(avg(value) + 1e-7, 4) AS value, count(*) AS count FROM {_DAILY} GROUP BY ALL")
def requery_downsampled(spark, sf_dir):
    return rounded(A.aggregate(_daily(spark, sf_dir), "avg", "7d", ["name"]))


@query(_range_sql("avg(value)", step=7 * DAY))
def requery_exact(spark, sf_dir):
    return rounded(A.reaggregate(_daily(spark, sf_dir), "avg", "7d", ["name"]))


@query(f"WITH s AS (SELECT ts_ns - ts_ns % {DAY} AS shard_start, count(*) AS points, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts FROM {EVENTS} GROUP BY 1) SELECT shard_start, shard_start + {DAY} AS shard_end, points, min_ts, max_ts, CASE WHEN shard_start < (SELECT max(shard_start) FROM s) THEN 'sealed' ELSE 'active' END AS state FROM s")
def shard_list(spark, sf_dir):
    return A.shards(events(spark, sf_dir), DAY)


@query(f"SELECT count(DISTINCT ts_ns - ts_ns % {DAY}) AS shards, CAST(1 AS BIGINT) AS active, count(DISTINCT ts_ns - ts_ns % {DAY}) - 1 AS sealed, CAST(0 AS BIGINT) AS archived FROM {EVENTS}")
def shard_stats(spark, sf_dir):
    return A.shard_counts(A.shards(events(spark, sf_dir), DAY))


@query(f"WITH s AS (SELECT DISTINCT ts_ns - ts_ns % {DAY} AS s FROM {EVENTS}), j AS (SELECT s, CASE WHEN s + {DAY} <= {JANUARY[1]} THEN 'archived' ELSE 'sealed' END AS state FROM s) SELECT count(*) AS shards, CAST(0 AS BIGINT) AS active, CAST(count(*) FILTER (state = 'sealed') AS BIGINT) AS sealed, CAST(count(*) FILTER (state = 'archived') AS BIGINT) AS archived FROM j")
def shard_archive(spark, sf_dir):
    """After a rotation all shards are sealed; those that end by 5 January are archived."""
    return A.shard_counts(A.shards(events(spark, sf_dir), DAY, JANUARY[1], rotated=True))


@query(f"SELECT min(ts_ns - ts_ns % {DAY}) AS shard_start FROM {EVENTS} HAVING count(*) > 0")
def next_block(spark, sf_dir):
    """The block to compact next: the oldest shard."""
    return A.shards(events(spark, sf_dir), DAY).where("state = 'sealed'").orderBy("shard_start").limit(1).select("shard_start")


@query(f"WITH s AS (SELECT ts_ns - ts_ns % {DAY} AS shard_start, max(ts_ns) AS max_ts, count(*) AS points FROM {EVENTS} GROUP BY 1) SELECT shard_start, max_ts, points FROM s WHERE max_ts > (SELECT max(max_ts) FROM s) - {7 * DAY}")
def retention_blocks(spark, sf_dir):
    own = A.shards(events(spark, sf_dir), DAY)
    now = own.agg(F.max("max_ts").alias("now"))
    return own.crossJoin(F.broadcast(now)).where(F.col("max_ts") > F.col("now") - 7 * DAY).select("shard_start", "max_ts", "points")


@query(f"SELECT name, count(*) AS n FROM {EVENTS} WHERE ts_ns > (SELECT max(ts_ns) FROM {EVENTS}) - {7 * DAY} GROUP BY name")
def retention_points(spark, sf_dir):
    rows = events(spark, sf_dir)
    now = rows.agg(F.max("ts_ns").alias("now"))
    return rows.crossJoin(F.broadcast(now)).where(F.col("ts_ns") > F.col("now") - 7 * DAY).groupBy("name").agg(F.count("*").alias("n"))


# the store -------------------------------------------------------------------
def _engine(spark, sf_dir, name: str, source=events, **options) -> Engine:
    e = Engine(spark, session.work_dir(spark, name), **({"window": DAY} | options))
    e.ingest(source(spark, sf_dir))
    return e


@query(f"SELECT series_id, ts_ns - ts_ns % {HOUR} AS ts, round(sum(value) + 1e-7, 4) AS value, count(*) AS count FROM {EVENTS} e JOIN {_SERIES} s ON e.name = s.name AND e.usr = s.usr WHERE ts_ns >= {JANUARY[0]} AND ts_ns < {JANUARY[1]} GROUP BY ALL")
def store_range(spark, sf_dir):
    """Written to the store by shard, and read with partition pruning."""
    e = _engine(spark, sf_dir, "range")
    return rounded(A.aggregate(e.points(*JANUARY), "sum", HOUR))


@query(f"SELECT name, priority, ts_ns, arg_max(value, seq) AS value FROM {ORDERS} GROUP BY name, priority, ts_ns")
def store_last_write(spark, sf_dir):
    """Two generations that overwrite each other's times: the last write of all counts."""
    e = Engine(spark, session.work_dir(spark, "lww"), window=365 * DAY)
    rows = orders(spark, sf_dir)
    e.ingest(rows.where("seq % 2 = 1"))
    e.ingest(rows.where("seq % 2 = 0"))
    dim = e.store.series().select("series_id", "name", F.col("labels")["priority"].alias("priority"))
    return e.points(*ALL).join(F.broadcast(dim), "series_id").select("name", "priority", "ts_ns", "value")


_SEALED = f"ts_ns - ts_ns % {DAY} < (SELECT max(ts_ns - ts_ns % {DAY}) FROM {EVENTS})"


@query(f"SELECT series_id, ts_ns - ts_ns % {HOUR} AS ts_ns, round(avg(value) + 1e-7, 4) AS value, count(*) AS count, min(value) AS min, max(value) AS max FROM {EVENTS} e JOIN {_SERIES} s ON e.name = s.name AND e.usr = s.usr WHERE {_SEALED} GROUP BY ALL")
def store_compact(spark, sf_dir):
    """Sealed shards are replaced by their downsampled rows."""
    e = _engine(spark, sf_dir, "compact", downsample=HOUR)
    e.compact()
    return rounded(e.store.read("downsampled").select("series_id", "ts_ns", "value", "count", "min", "max"))


@query(f"WITH b AS (SELECT ts_ns - ts_ns % {DAY} AS s, max(ts_ns) AS m FROM {EVENTS} GROUP BY 1) SELECT count(*) AS blocks, CAST((SELECT count(*) FROM {EVENTS} WHERE ts_ns - ts_ns % {DAY} IN (SELECT s FROM b WHERE m > (SELECT max(m) FROM b) - {7 * DAY})) AS BIGINT) AS points FROM b WHERE m > (SELECT max(m) FROM b) - {7 * DAY}")
def store_sweep(spark, sf_dir):
    e = _engine(spark, sf_dir, "sweep", max_age=7 * DAY)
    e.sweep(e.stats().first().max_ts)
    e.store.reclaim()
    return e.store.blocks().agg(F.count("*").alias("blocks"), F.sum("points").alias("points"))


@query(f"SELECT count(DISTINCT ts_ns - ts_ns % {DAY}) AS shards, count(DISTINCT ts_ns - ts_ns % {DAY}) AS blocks, count(*) AS points, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts, (SELECT count(*) FROM {_SERIES}) AS series FROM {EVENTS}")
def store_stats(spark, sf_dir):
    return _engine(spark, sf_dir, "stats").stats()


@query(f"SELECT 'blocks_flushed ' || count(DISTINCT ts_ns - ts_ns % {DAY}) AS line FROM {EVENTS} UNION ALL SELECT 'points_ingested ' || count(*) FROM {EVENTS} UNION ALL SELECT 'series_registered ' || count(*) FROM {_SERIES}")
def metrics_text(spark, sf_dir):
    return _engine(spark, sf_dir, "metrics").metrics.lines(spark)


@query("SELECT o_orderstatus || ' ' || count(*) AS line FROM orders GROUP BY o_orderstatus")
def metrics_lines(spark, sf_dir):
    return text_lines(orders(spark, sf_dir).groupBy("name").agg(F.count("*").alias("value")))


@query(f"SELECT '{{\"ts\":' || ts || ',\"count\":' || count || '}}' AS json FROM (SELECT ts_ns - ts_ns % {HOUR} AS ts, count(*) AS count FROM {EVENTS} WHERE name = 'click' GROUP BY 1)")
def json_results(spark, sf_dir):
    rows = A.aggregate(events(spark, sf_dir).where("name = 'click'"), "count", HOUR, ["name"])
    return rows.select(F.to_json(F.struct("ts", "count")).alias("json"))


@query(f"""WITH r AS (SELECT name, ts_ns - ts_ns % {HOUR} AS ts, max(value) AS value, count(*) AS n FROM {EVENTS} GROUP BY ALL)
SELECT '{{"name":"' || name || '","ts":' || ts || ',"value":' || value || ',"count":' || n || '}}' AS json FROM r""")
def json_values(spark, sf_dir):
    """Results of all series with their values, as JSON."""
    rows = A.aggregate(events(spark, sf_dir), "max", HOUR, ["name"])
    return rows.select(F.to_json(F.struct("name", "ts", "value", "count")).alias("json"))


@query(f"""WITH w AS (SELECT name, ts_ns - ts_ns % {HOUR} AS ts, avg(value) AS v, count(*) AS count FROM {EVENTS} GROUP BY ALL)
SELECT name, ts, round(v + 1e-7, 4) AS value, count FROM w WHERE ts + {2 * HOUR} <= (SELECT max(ts_ns) FROM {EVENTS})""")
def stream_windows(spark, sf_dir):
    """Hourly windows of a stream, closed an hour after their end; the stream ends half way and goes on from its checkpoint."""
    folder = session.work_dir(spark, "windows")
    rows = events(spark, sf_dir).select("name", "ts_ns", "value")
    middle = (rows.agg(F.coalesce(F.min("ts_ns") + F.max("ts_ns"), F.lit(0))).first()[0]) // 2
    for half in (F.col("ts_ns") < middle, F.col("ts_ns") >= middle):
        rows.where(half).write.mode("append").parquet(f"{folder}/in")
        closed = windowed(files(spark, f"{folder}/in", schema="name string, ts_ns long, value double"), "1 hour", "1 hour")
        closed.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("name string, ts long, value double, count long").parquet(f"{folder}/out")
    return out.withColumn("value", F.round(F.col("value") + 1e-7, 4))


# the record log --------------------------------------------------------------
@query(f"SELECT CAST(seq AS BIGINT) AS seq, ts_ns, value FROM {EVENTS} WHERE seq >= 100")
def log_replay(spark, sf_dir):
    """All points as 37-byte records in segments, decoded again, from seq 100 on."""
    rows = events(spark, sf_dir).select("seq", F.lit(1).cast("long").alias("series_id"), "ts_ns", "value")

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(1).to_pylist():
                r = wal.decoded(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[c])) for c in ("seq", "ts_ns", "value")], ["seq", "ts_ns", "value"])

    return wal.segments(rows, 4096).mapInArrow(decode, "seq long, ts_ns long, value double").where("seq >= 100")
