"""Queries of functions, advertising, assignments, upserts and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import numeric as n
from wayfold.functions import temporal as tm
from wayfold.functions import text as tx
from wayfold.operators import records as r
from wayfold.operators import tracks as k
from wayfold.plans.book import Book
from wayfold.sources.transit import NOW_US, Transit

book = Book()
query = book.query
HOUR = "((t_us // 1000000 + 18000) // 3600 % 24)"
WEEKEND = "(((t_us // 1000000 + 18000) // 86400 + 3) % 7 >= 5)"


@query(
    f"""SELECT fix_id, {HOUR}::INT AS hour, {WEEKEND} AS weekend, CASE WHEN {HOUR} >= 5 AND {HOUR} < 14 THEN 'FIRST' ELSE 'SECOND' END AS shift, {HOUR} BETWEEN 5 AND 22 AS in_full_day,
 CASE WHEN {HOUR} >= 23 THEN 'NIGHT' WHEN {HOUR} >= 20 THEN 'EVENING' WHEN {HOUR} >= 17 THEN 'EVENING_RUSH' WHEN {HOUR} >= 10 THEN 'DAYTIME' WHEN {HOUR} >= 7 THEN 'MORNING_RUSH' ELSE 'NIGHT' END AS period,
 least(CASE WHEN {HOUR} >= 23 THEN 25 WHEN {HOUR} >= 20 THEN 15 WHEN {HOUR} >= 17 THEN 8 WHEN {HOUR} >= 10 THEN 12 WHEN {HOUR} >= 7 THEN 6 ELSE 25 END + CASE WHEN {WEEKEND} THEN 5 ELSE 0 END, 30)::INT AS wait,
 CASE WHEN age <= 3 AND speed > 10 THEN 'HIGH' WHEN age <= 10 THEN 'MEDIUM' WHEN age <= 30 THEN 'LOW' ELSE 'STALE' END AS freshness FROM (SELECT fix_id, lag_us * 29 + 1704000000000000 AS t_us, speed, fix_id % 40 AS age FROM fixes)"""
)
def time_functions(t: Transit) -> DataFrame:
    f = t.fixes.selectExpr("fix_id", "lag_us * 29 + 1704000000000000 as t_us", "speed", "fix_id % 40 as age")
    us = F.col("t_us")
    return f.select("fix_id", tm.local_hour(us).alias("hour"), tm.is_weekend(us).alias("weekend"), tm.shift(us).alias("shift"), tm.shift_covers(F.lit("FULL_DAY"), us).alias("in_full_day"), tm.period(us).alias("period"), tm.expected_wait(us).cast("int").alias("wait"), tm.freshness(F.col("age"), F.col("speed") > 10).alias("freshness"))


@query(
    """SELECT fix_id, round(CASE WHEN d <= 0 THEN 0 WHEN d >= up + down THEN (12.5 - v) / 1.0 + (d - up - down) / 12.5 + 12.5 / 1.0 ELSE (sqrt(greatest(0.0, (2 * d + v * v) / 2)) - v) + sqrt(greatest(0.0, (2 * d + v * v) / 2)) END, 6) AS stop_s,
 round(CASE WHEN i < 5 THEN 1 + (0.7 - 1) * (5 - i) / 5 ELSE 1.0 END, 6) AS factor, round(1 / (1 + d / 2500.0), 6) AS confidence, round(least(150 + v * greatest(0.0, i - 3), 300.0), 6) AS turn_m, round(CASE WHEN (((d - 600) % 900) + 900) % 900 > 450 THEN (((d - 600) % 900) + 900) % 900 - 900 ELSE (((d - 600) % 900) + 900) % 900 END, 6) AS loop_m
FROM (SELECT *, (12.5 * 12.5 - v * v) / 2 AS up, 12.5 * 12.5 / 2 AS down FROM (SELECT fix_id, (fix_id * 7 % 1200)::DOUBLE AS d, speed / 8 AS v, (fix_id % 9)::DOUBLE AS i FROM fixes))"""
)
def motion_functions(t: Transit) -> DataFrame:
    f = t.fixes.selectExpr("fix_id", "cast(fix_id * 7 % 1200 as double) as d", "speed / 8 as v", "cast(fix_id % 9 as double) as i")
    d, v, i = F.col("d"), F.col("v"), F.col("i")
    return f.select("fix_id", F.round(n.time_to_stop(d, v, F.lit(12.5), 1.0), 6).alias("stop_s"), F.round(n.damped(F.lit(0.7), i), 6).alias("factor"), F.round(n.confidence(d), 6).alias("confidence"), F.round(n.turn_window(150, v, i, 3, 300.0), 6).alias("turn_m"), F.round(n.loop_delta(d - 600, F.lit(900.0)), 6).alias("loop_m"))


NORM = "trim(regexp_replace(regexp_replace(translate(lower(coalesce({0}, '')), '" + tx.FROM + "', '" + tx.TO + "'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS norm_md5, length({NORM.format('text')}) AS norm_chars FROM documents")
def search_norm(t: Transit) -> DataFrame:
    """The normal form of every whole text."""
    norm = tx.search_norm(F.col("text"))
    return t.raw("documents").select("doc_id", F.md5(norm).alias("norm_md5"), F.length(norm).cast("bigint").alias("norm_chars"))


@query("""SELECT stop_id, concat_ws(', ', nullif(name_tm, ''), 'city ' || city_id, CASE WHEN is_major THEN 'major' END) AS subtitle, left(name, 8) AS short, regexp_replace(name, '[^0-9]', '', 'g') AS digits, nullif(trim(coalesce(name_tm, '  ')), '') AS cleaned, starts_with(name, 'Supplier') AS prefixed FROM stops""")
def text_functions(t: Transit) -> DataFrame:
    return t.stops.select("stop_id", F.concat_ws(", ", F.nullif(F.col("name_tm"), F.lit("")), F.concat(F.lit("city "), "city_id"), F.expr("case when is_major then 'major' end")).alias("subtitle"), F.left("name", F.lit(8)).alias("short"), F.regexp_replace("name", "[^0-9]", "").alias("digits"), F.nullif(F.trim(F.coalesce("name_tm", F.lit("  "))), F.lit("")).alias("cleaned"), F.startswith("name", F.lit("Supplier")).alias("prefixed"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, (json_extract_string(props, '$.k')::BIGINT % 7)::INT AS weekday, json_extract_string(props, '$.missing') IS NULL AS missing FROM events")
def json_fields(t: Transit) -> DataFrame:
    """Fields of JSON properties, with null for what is absent."""
    p = F.from_json("props", "k bigint, missing string")
    return t.raw("events").select("event_id", p["k"].alias("k"), (p["k"] % 7).cast("int").alias("weekday"), p["missing"].isNull().alias("missing"))


@query("SELECT day, placement, impressions, clicks, CASE WHEN impressions <> 0 THEN round((clicks * 100.0 / impressions)::DECIMAL(20,10), 2)::DOUBLE END AS ctr FROM (SELECT t_us // 86400000000 AS day, vehicle_id % 20 AS placement, count(*) FILTER (WHERE event_type = 'view') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM (SELECT user_id AS vehicle_id, event_type, epoch_us(ts) AS t_us FROM events) GROUP BY 1, 2)")
def ad_sales_report(t: Transit) -> DataFrame:
    """Impressions, clicks and click rate by day and placement."""
    e = t.raw("events").selectExpr("unix_micros(cast(ts as timestamp)) div 86400000000 as day", "user_id % 20 as placement", "event_type")
    counts = e.groupBy("day", "placement").agg(F.count_if(F.col("event_type") == "view").alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return counts.withColumn("ctr", n.percent(F.col("clicks"), F.col("impressions")))


STATE = "case place_id % 6 when 0 then 'DRAFT' when 1 then 'PENDING_PAYMENT' when 2 then 'SCHEDULED' when 3 then 'ACTIVE' when 4 then 'PAUSED' when 5 then 'EXPIRED' end as state"
PLACEMENT = f"pl AS (SELECT place_id, (place_id * 37 % 300)::INT AS s, CASE WHEN place_id % 9 <> 0 THEN (place_id * 37 % 300 + place_id * 11 % 60)::INT END AS e, is_active, {STATE} FROM places)"
PLACEMENT_SPARK = ("place_id", "cast(place_id * 37 % 300 as int) as s", "case when place_id % 9 <> 0 then cast(place_id * 37 % 300 + place_id * 11 % 60 as int) end as e", "is_active", STATE)
#: The states that a placement may go to.
MOVES = {
    "DRAFT": ["PENDING_PAYMENT", "CANCELLED"],
    "PENDING_PAYMENT": ["SCHEDULED", "CANCELLED"],
    "SCHEDULED": ["ACTIVE", "CANCELLED"],
    "ACTIVE": ["PAUSED", "EXPIRED", "CANCELLED"],
    "PAUSED": ["ACTIVE", "EXPIRED", "CANCELLED"],
}


@query("SELECT place_id, CASE WHEN NOT is_active THEN 'INACTIVE' WHEN s > 150 THEN 'SCHEDULED' WHEN e < 150 THEN 'EXPIRED' ELSE 'ACTIVE' END AS status, greatest(s - 150, 0) AS days_until_start, CASE WHEN e IS NOT NULL THEN greatest(e - 150, 0) END AS days_until_end, coalesce(e BETWEEN 150 AND 157, false) AS expiring FROM pl", PLACEMENT)
def placement_status(t: Transit) -> DataFrame:
    """Placements on day 150: their status by period, days left, and whether they end within a week."""
    p = t.places.selectExpr(*PLACEMENT_SPARK)
    return p.selectExpr("place_id", "case when not is_active then 'INACTIVE' when s > 150 then 'SCHEDULED' when e < 150 then 'EXPIRED' else 'ACTIVE' end as status", "greatest(s - 150, 0) as days_until_start", "case when e is not null then greatest(e - 150, 0) end as days_until_end", "coalesce(e between 150 and 157, false) as expiring")


@query("SELECT pl.place_id, pl.state, m.next FROM pl JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, moves in MOVES.items() for b in moves) + ") m(state, next) ON pl.state = m.state", PLACEMENT)
def placement_transitions(t: Transit) -> DataFrame:
    """The states that each placement may go to."""
    allowed = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return t.places.selectExpr(*PLACEMENT_SPARK).select("place_id", "state", F.explode(allowed[F.col("state")]).alias("next"))


@query("SELECT status, provider, payments, revenue, latest FROM (SELECT status, plan_id % 3 AS provider, count(*) AS payments, round(sum(CASE WHEN status = 'F' THEN price ELSE 0 END), 2) AS revenue, max(created_us) AS latest FROM plans WHERE created_us BETWEEN 800000000000000 AND 950000000000000 GROUP BY 1, 2)")
def payment_report(t: Transit) -> DataFrame:
    """Payments in a range by status and provider, with what was earned."""
    p = t.plans.where("created_us between 800000000000000 and 950000000000000")
    return p.groupBy("status", F.expr("plan_id % 3").alias("provider")).agg(F.count(F.lit(1)).alias("payments"), F.round(F.sum(F.expr("case when status = 'F' then price else 0 end")), 2).alias("revenue"), F.max("created_us").alias("latest"))


@query("SELECT client, plan_id, status FROM (SELECT plan_id % 500 AS client, plan_id, status, row_number() OVER (PARTITION BY plan_id % 500 ORDER BY created_us DESC, plan_id DESC) AS rn FROM plans) WHERE rn = 1")
def latest_subscription(t: Transit) -> DataFrame:
    """The newest row of each client."""
    best = t.plans.groupBy(F.expr("plan_id % 500").alias("client")).agg(F.max(F.struct("created_us", "plan_id", "status")).alias("b"))
    return best.select("client", "b.plan_id", "b.status")


@query("SELECT coalesce(a.route_id, b.route_id) AS route_id, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, round((coalesce(a.s, 0) + coalesce(b.s, 0)) / (coalesce(a.n, 0) + coalesce(b.n, 0)), 6) AS mean FROM (SELECT route_id, count(*) AS n, sum(speed) AS s FROM fixes WHERE fix_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT route_id, count(*) AS n, sum(speed) AS s FROM fixes WHERE fix_id % 2 = 1 GROUP BY 1) b USING (route_id)")
def merged_rolling_mean(t: Transit) -> DataFrame:
    """Means of an old batch and a new one, merged by their counts."""
    old, new = (r.rolling_mean(t.fixes.where(f"fix_id % 2 = {k}"), ["route_id"], "speed") for k in (0, 1))
    return r.merge_means(old, new, ["route_id"]).select("route_id", "n", F.round("mean", 6).alias("mean"))


@query("SELECT category, count(DISTINCT alias) AS aliases, array_to_string(list_sort(list(DISTINCT alias)), '|') AS listed, coalesce(list_sum(list(place_id) FILTER (WHERE is_active)), 0)::BIGINT AS active_sum FROM places GROUP BY 1")
def place_aliases(t: Transit) -> DataFrame:
    return t.places.groupBy("category").agg(F.count_distinct("alias").alias("aliases"), F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("listed"), F.coalesce(F.sum(F.when(F.col("is_active"), F.col("place_id"))), F.lit(0)).alias("active_sum"))


@query("SELECT city_id, category, place_id, name FROM (SELECT *, row_number() OVER (PARTITION BY city_id, category ORDER BY is_active DESC, name, place_id) AS rn FROM places) WHERE rn = 1")
def distinct_on_place(t: Transit) -> DataFrame:
    """One place for each city and category, by priority."""
    best = t.places.groupBy("city_id", "category").agg(F.min(F.struct(~F.col("is_active"), "name", "place_id")).alias("b"))
    return best.select("city_id", "category", "b.place_id", "b.name")


UPSERT = """old AS (SELECT stop_id AS id, name, (stop_id % 3 + 1)::INT AS version FROM stops WHERE stop_id % 4 <> 0), new AS (SELECT stop_id AS id, upper(name) AS name, (stop_id % 2 + 1)::INT AS version FROM stops WHERE stop_id % 3 <> 1)"""


def _versions(t: Transit) -> tuple[DataFrame, DataFrame]:
    return t.stops.where("stop_id % 4 <> 0").selectExpr("stop_id as id", "name", "cast(stop_id % 3 + 1 as int) as version"), t.stops.where("stop_id % 3 <> 1").selectExpr("stop_id as id", "upper(name) as name", "cast(stop_id % 2 + 1 as int) as version")


@query("SELECT id, CASE WHEN new.id IS NULL THEN old.name WHEN old.id IS NULL OR old.version = new.version THEN new.name ELSE old.name END AS name, (CASE WHEN old.id IS NULL THEN 1 WHEN new.id IS NULL OR old.version <> new.version THEN old.version ELSE old.version + 1 END)::INT AS version, CASE WHEN new.id IS NULL THEN 'KEPT' WHEN old.id IS NULL THEN 'INSERTED' WHEN old.version = new.version THEN 'UPDATED' ELSE 'CONFLICT' END AS outcome FROM old FULL JOIN new USING (id)".replace("SELECT id,", "SELECT coalesce(old.id, new.id) AS id,").replace("USING (id)", "ON old.id = new.id"), UPSERT)
def upsert_versioned(t: Transit) -> DataFrame:
    return r.upsert(*_versions(t), "id", ["name"])


@query("SELECT id, name FROM old UNION ALL SELECT id, name FROM new WHERE id NOT IN (SELECT id FROM old)", UPSERT)
def insert_ignore(t: Transit) -> DataFrame:
    old, new = _versions(t)
    return r.insert_ignore(old.select("id", "name"), new.select("id", "name"), ["id"])


@query("SELECT coalesce(old.id, new.id) AS id, old.name AS before, new.name AS after FROM old JOIN new ON old.id = new.id WHERE nullif(trim(old.name), '') IS DISTINCT FROM nullif(trim(new.name), '')", UPSERT)
def name_history(t: Transit) -> DataFrame:
    """Names that changed, blanks being no name."""
    old, new = _versions(t)
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    return old.select("id", F.col("name").alias("before")).join(new.select("id", F.col("name").alias("after")), "id").where(~clean("before").eqNullSafe(clean("after")))


@query(f"SELECT fix_id, CASE WHEN tries >= 3 THEN 'PERMANENT' WHEN next_us IS NULL OR next_us <= {NOW_US} THEN 'READY' ELSE 'WAITING' END AS state, CASE WHEN tries < 3 THEN {NOW_US} + least(60 * pow(2, tries), 1800)::BIGINT * 1000000 END AS next_us FROM (SELECT fix_id, (fix_id % 5)::INT AS tries, CASE WHEN fix_id % 7 <> 0 THEN t_us + fix_id % 3600 * 1000000 END AS next_us FROM fixes WHERE event_type = 'error')")
def dead_letters(t: Transit) -> DataFrame:
    """Failed fixes: whether they may be tried again, and when next."""
    failed = t.fixes.where("event_type = 'error'").selectExpr("fix_id", "cast(fix_id % 5 as int) as tries", "case when fix_id % 7 <> 0 then t_us + fix_id % 3600 * 1000000 end as next_us")
    return r.retry_state(failed, NOW_US)


@query("SELECT fix_id, 'fixes-' || strftime(make_timestamp(t_us), '%Y%m%d-%H') || '.jsonl' AS file, row_number() OVER (PARTITION BY t_us // 3600000000 ORDER BY t_us, fix_id) AS line FROM fixes")
def recorded_fixes(t: Transit) -> DataFrame:
    """Every fix with the hourly log file it is recorded in, and its line there."""
    return k.numbered(t.fixes.select("fix_id", "t_us"), "t_us", "fix_id", 3_600_000_000, "line").select("fix_id", F.concat(F.lit("fixes-"), F.date_format(F.timestamp_micros("t_us"), "yyyyMMdd-HH"), F.lit(".jsonl")).alias("file"), "line")


@query(
    f"""SELECT v.vehicle_id, a.route_id, CASE WHEN a.route_id IS NOT NULL THEN 'ASSIGNED' WHEN v.route_id IS NOT NULL AND v.vehicle_id % 5 <> 0 THEN 'CLEARED' ELSE 'UNCHANGED' END AS outcome FROM vehicles v LEFT JOIN (SELECT vehicle_id, r.route_id FROM (SELECT vehicle_id, (vehicle_id * 3 % 25)::BIGINT AS route_id FROM vehicles WHERE vehicle_id % 4 = 1 AND updated_us > {NOW_US} - 1200000000) x JOIN routes r ON r.route_id = x.route_id AND r.is_active) a ON a.vehicle_id = v.vehicle_id WHERE v.is_active"""
)
def shift_assignment(t: Transit) -> DataFrame:
    """Valid assignments applied to active vehicles; other routes are cleared unless the vehicle is preserved."""
    valid = t.vehicles.where(f"vehicle_id % 4 = 1 and updated_us > {NOW_US} - 1200000000").selectExpr("vehicle_id", "vehicle_id * 3 % 25 as new_route")
    valid = valid.join(t.routes.where("is_active").select(F.col("route_id").alias("new_route")), "new_route")
    out = t.vehicles.where("is_active").join(valid, "vehicle_id", "left")
    return out.select("vehicle_id", F.col("new_route").alias("route_id"), F.expr("case when new_route is not null then 'ASSIGNED' when route_id is not null and vehicle_id % 5 <> 0 then 'CLEARED' else 'UNCHANGED' end").alias("outcome"))


@query(f"SELECT view, age_min, age_min <= most AS healthy FROM (SELECT kind AS view, ({NOW_US} - max(updated_us)) // 60000000 AS age_min, CASE kind WHEN 0 THEN 10 WHEN 1 THEN 15 ELSE 60 END AS most FROM (SELECT provider AS kind, updated_us FROM vehicles) GROUP BY kind)")
def view_health(t: Transit) -> DataFrame:
    """The age of each snapshot against its limit."""
    age = t.vehicles.groupBy(F.col("provider").alias("view")).agg(F.expr(f"({NOW_US} - max(updated_us)) div 60000000").alias("age_min"))
    return age.select("view", "age_min", F.expr("age_min <= case view when 0 then 10 when 1 then 15 else 60 end").alias("healthy"))
