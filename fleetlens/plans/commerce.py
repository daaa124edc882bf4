"""Sales questions: groupings, calendar periods, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import text, timefn
from fleetlens.operators import business, skew
from fleetlens.plans.bindings import AS_OF
from fleetlens.plans.registry import query

PERIODS_SQL = """
    SELECT period, lo, hi FROM (VALUES
      ('today', DATE '2001-07-15', DATE '2001-07-15'), ('this week', DATE '2001-07-09', DATE '2001-07-15'),
      ('last week', DATE '2001-07-02', DATE '2001-07-08'), ('this month', DATE '2001-07-01', DATE '2001-07-15'),
      ('last month', DATE '2001-06-01', DATE '2001-06-30'), ('this quarter', DATE '2001-07-01', DATE '2001-07-15'),
      ('last quarter', DATE '2001-04-01', DATE '2001-06-30'), ('this year', DATE '2001-01-01', DATE '2001-07-15')) p(period, lo, hi)"""


@query("ag01_group_by", """
    SELECT region, channel, count(*) AS units, round(sum(unit_price), 2) AS revenue, round(avg(unit_price), 6) AS mean,
           min(unit_price) AS low, max(unit_price) AS high FROM sales GROUP BY 1, 2""")
def group_by(t):
    p = F.col("unit_price")
    return t.sales.groupBy("region", "channel").agg(
        F.count("*").alias("units"), F.round(F.sum(p), 2).alias("revenue"), F.round(F.avg(p), 6).alias("mean"),
        F.min(p).alias("low"), F.max(p).alias("high"))


@query("ag06_having", "SELECT vehicle_id, count(*) AS units FROM sales GROUP BY 1 HAVING count(*) > 12")
def having(t):
    return t.sales.groupBy("vehicle_id").agg(F.count("*").alias("units")).where("units > 12")


@query("ag10_by_month", "SELECT date_trunc('month', sold_on)::DATE AS month, count(*) AS units FROM sales GROUP BY 1")
def by_month(t):
    return t.sales.groupBy(F.trunc("sold_on", "month").alias("month")).agg(F.count("*").alias("units"))


@query("ag13_distinct_buyers", "SELECT region, count(DISTINCT vehicle_id) AS buyers FROM sales GROUP BY 1")
def distinct_buyers(t):
    return t.sales.groupBy("region").agg(F.count_distinct("vehicle_id").alias("buyers"))


@query("ag15_grouping_sets", """
    SELECT coalesce(region, 'all') AS region, coalesce(channel, 'all') AS channel, count(*) AS units,
           round(100 * avg((status = 'F')::INT), 1) AS finished_pct
    FROM sales GROUP BY GROUPING SETS ((), (region), (channel), (region, channel))""")
def grouping_sets(t):
    """One measure at several groupings. Counts per finest group come first, so
    the sets expand over a handful of rows."""
    fine = t.sales.groupBy("region", "channel").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("status") == "F", 1)).alias("f"))
    sets = fine.cube("region", "channel").agg(F.sum("n").alias("units"), F.sum("f").alias("f"))
    return sets.select(
        F.coalesce("region", F.lit("all")).alias("region"), F.coalesce("channel", F.lit("all")).alias("channel"), "units",
        F.round(100 * F.col("f") / F.col("units"), 1).alias("finished_pct"))


@query("ag27_corpus_version", "SELECT count(*) AS documents, max(doc_id) AS newest FROM documents")
def corpus_version(t):
    return t.documents.agg(F.count("*").alias("documents"), F.max("doc_id").alias("newest"))


@query("ag28_best_per_group", """
    SELECT region, max(unit_price) AS best, arg_max(id, (unit_price, id)) AS best_id FROM sales GROUP BY 1""")
def best_per_group(t):
    return t.sales.groupBy("region").agg(
        F.max("unit_price").alias("best"), F.max_by("id", F.struct("unit_price", "id")).alias("best_id"))


@query("ag36_region_share", """
    SELECT region, count(*) AS units, round(100 * count(*) / (SELECT count(*) FROM sales), 2) AS share_pct FROM sales GROUP BY 1""")
def region_share(t):
    return business.shares(t.sales, "region")


@query("ag36_period_change", """
    WITH p AS (SELECT region, count(*) FILTER (sold_on BETWEEN DATE '2001-01-01' AND DATE '2001-03-31') AS units_before,
                      count(*) FILTER (sold_on BETWEEN DATE '2001-04-01' AND DATE '2001-06-30') AS units_after FROM sales
               WHERE sold_on BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' GROUP BY 1)
    SELECT region, units_before, units_after, round(100 * (units_after - units_before) / units_before, 1) AS change_pct FROM p""")
def period_change(t):
    return business.compare_periods(t.sales, "region", ("2001-01-01", "2001-03-31"), ("2001-04-01", "2001-06-30"))


@query("j10_sales_by_period", f"""
    WITH p AS ({PERIODS_SQL})
    SELECT period, region, count(*) AS units, round(sum(unit_price), 2) AS revenue
    FROM sales JOIN p ON sold_on BETWEEN lo AND hi GROUP BY 1, 2""")
def sales_by_period(t):
    return business.by_period(t.sales, business.calendar(t.spark, AS_OF), ["region"]).withColumn("revenue", F.round("revenue", 2))


@query("sf07_periods_of_days", """
    WITH d AS (SELECT DISTINCT sold_on AS day FROM sales), q AS (
      SELECT day, day - ((isodow(day) - 1)::INT) AS week, date_trunc('month', day)::DATE AS month,
             (date_trunc('month', day) - to_months(((month(day) + 8) % 12 % 3)::INT))::DATE AS quarter,
             (date_trunc('month', day) - to_months(((month(day) + 8) % 12)::INT))::DATE AS year FROM d)
    SELECT day, 'today' AS period, day AS lo, day AS hi FROM q
    UNION ALL SELECT day, 'this week', week, day FROM q
    UNION ALL SELECT day, 'last week', week - 7, week - 1 FROM q
    UNION ALL SELECT day, 'this month', month, day FROM q
    UNION ALL SELECT day, 'last month', (month - INTERVAL 1 MONTH)::DATE, month - 1 FROM q
    UNION ALL SELECT day, 'this quarter', quarter, day FROM q
    UNION ALL SELECT day, 'last quarter', (quarter - INTERVAL 3 MONTH)::DATE, quarter - 1 FROM q
    UNION ALL SELECT day, 'this year', year, day FROM q""")
def periods_of_days(t):
    """The calendar of every day with a sale: calendar weeks, a year that starts in April."""
    days = t.sales.select(F.col("sold_on").alias("day")).distinct()
    rows = timefn.periods(F.col("day"), week_mode="calendar_week", year_start_month=4)
    return days.select("day", F.inline(rows))


@query("sf08_quarter_labels", """
    SELECT 'Q' || (((month(sold_on) + 8) % 12) // 3 + 1) || ' FY' || (CASE WHEN month(sold_on) >= 4 THEN year(sold_on)
           ELSE year(sold_on) - 1 END) AS fiscal, 'Q' || quarter(sold_on) || ' ' || year(sold_on) AS quarter, count(*) AS units
    FROM sales GROUP BY 1, 2""")
def quarter_labels(t):
    return t.sales.groupBy(timefn.quarter_label(F.col("sold_on"), 4).alias("fiscal"),
                           timefn.quarter_label(F.col("sold_on")).alias("quarter")).agg(F.count("*").alias("units"))


@query("pf03_days_in_zone", """
    SELECT event_type, count(*) AS n FROM events
    WHERE ts >= TIMESTAMP '2024-01-07 18:30:00' AND ts < TIMESTAMP '2024-01-14 18:30:00' GROUP BY 1""")
def days_in_zone(t):
    """8 to 14 January in India: the bounds are midnights there."""
    from fleetlens import reference as ref
    rows = t.telemetry
    keep = timefn.in_zone(F.col("recorded_at"), F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date"), ref.TIME_ZONE)
    return rows.where(keep).groupBy(F.col("metric_name").alias("event_type")).agg(F.count("*").alias("n"))


@query("pf04_text_match", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'RED%' OR contains(lower(p_type), 'promo')")
def text_match(t):
    return t.part.where(F.col("p_name").ilike("RED%") | F.contains(F.lower("p_type"), F.lit("promo"))).select("p_partkey", "p_name")


@query("pf05_array_overlap", """
    SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue']) AND list_contains(string_split(p_name, ' '), 'bolt')""")
def array_overlap(t):
    words = F.split("p_name", " ")
    return t.part.where(F.arrays_overlap(words, F.array(F.lit("red"), F.lit("blue"))) & F.array_contains(words, "bolt")).select("p_partkey")


@query("pf06_null_safe_inequality", "SELECT id FROM telemetry WHERE drive_mode IS DISTINCT FROM 'Eco'")
def null_safe_inequality(t):
    return t.telemetry.where(~F.col("drive_mode").eqNullSafe("Eco")).select("id")


@query("pf07_null_checks", "SELECT count(*) FILTER (drive_mode IS NULL) AS without_mode, count(*) FILTER (drive_mode IS NOT NULL) AS with_mode FROM telemetry")
def null_checks(t):
    m = F.col("drive_mode")
    return t.telemetry.agg(F.count(F.when(m.isNull(), 1)).alias("without_mode"), F.count(F.when(m.isNotNull(), 1)).alias("with_mode"))


@query("tk01_custom_order", """
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    ORDER BY list_position(['3-MEDIUM', '1-URGENT', '5-LOW', '2-HIGH', '4-NOT SPECIFIED'], o_orderpriority), o_totalprice DESC, o_orderkey LIMIT 50""")
def custom_order(t):
    wanted = F.array(*[F.lit(p) for p in ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH", "4-NOT SPECIFIED"]])
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(
        F.array_position(wanted, F.col("o_orderpriority")), F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("so02_union_all", """
    SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier""")
def union_all(t):
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b)


@query("so03_intersect", "SELECT c_custkey AS id FROM customer INTERSECT SELECT user_id FROM events")
def intersect(t):
    return t.customer.select(F.col("c_custkey").alias("id")).intersect(t.events.select(F.col("user_id").alias("id")))


@query("so04_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events")
def except_(t):
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.events.select(F.col("user_id").alias("id")))


@query("so05_duplicate_ids", "SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1 HAVING count(*) > 7")
def duplicate_ids(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines")).where("lines > 7")


@query("so06_set_equality", """
    WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1)
    SELECT l_orderkey, flags = ['A', 'N', 'R'] AS all_flags FROM s""")
def set_equality(t):
    flags = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    wanted = F.array_sort(F.array(F.lit("R"), F.lit("N"), F.lit("A")))
    return flags.select("l_orderkey", (F.array_sort("flags") == wanted).alias("all_flags"))


@query("so07_first_per_url", """
    SELECT page_id, site FROM (SELECT page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS site FROM pages)
    QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) = 1""")
def first_per_url(t):
    """The first page of each address, an aggregate that combines before the shuffle."""
    site = F.rtrim(F.regexp_replace("url", "[?#].*$", ""), F.lit("/"))
    return t.pages.groupBy(site.alias("site")).agg(F.min("page_id").alias("page_id"))


@query("sf01_numeric", """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS r, abs(l_tax - l_discount) AS a,
           floor(l_extendedprice)::BIGINT AS f, ceil(l_extendedprice)::BIGINT AS c, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS l FROM lineitem""")
def numeric(t):
    p, d, x = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(p * d, 4).alias("r"), F.abs(x - d).alias("a"), F.floor(p).alias("f"),
                             F.ceil(p).alias("c"), F.greatest(x, d).alias("g"), F.least(x, d).alias("l"))


@query("sf02_nulls_and_casts", """
    SELECT id, coalesce(drive_mode, 'none') AS mode, nullif(metric_name, 'click') AS other, CAST(floor(metric_value) AS BIGINT) AS whole FROM telemetry""")
def nulls_and_casts(t):
    return t.telemetry.select("id", F.coalesce("drive_mode", F.lit("none")).alias("mode"), F.nullif("metric_name", F.lit("click")).alias("other"),
                              F.floor("metric_value").cast("long").alias("whole"))


@query("sf03_dates", """
    SELECT id, date_trunc('month', sold_on)::DATE AS month, year(sold_on) AS y, isodow(sold_on) AS weekday,
           strftime(sold_on, '%d/%m/%Y') AS shown, date_diff('day', sold_on, DATE '2001-07-15') AS days_old FROM sales""")
def dates(t):
    return t.sales.select(
        "id", F.trunc("sold_on", "month").alias("month"), F.year("sold_on").alias("y"), (F.weekday("sold_on") + 1).alias("weekday"),
        F.date_format("sold_on", "dd/MM/yyyy").alias("shown"), F.date_diff(F.lit(AS_OF).cast("date"), "sold_on").alias("days_old"))


@query("sf04_strings", """
    SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, trim(substring(p_name, 1, 5)) AS s FROM part""")
def strings(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"), F.length("p_name").alias("n"),
                         F.trim(F.substring("p_name", 1, 5)).alias("s"))


@query("sf05_json_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_paths(t):
    parsed = F.from_json("props", "k long")
    return t.events.select("event_id", parsed["k"].alias("k"))


@query("w13_interleave", """
    SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders""")
def interleave(t):
    """Round robin over the priorities: sort by turn, then priority."""
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    turns = skew.running(rows, ["o_orderpriority"], F.col("o_orderkey"), [], {"turn": F.lit(1)})
    return turns.orderBy("turn", "o_orderpriority")


@query("w14_every_nth", """
    SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n % 23 = 3""")
def every_nth(t):
    """The reference's deterministic sample: the third of every 23 in order."""
    rows = skew.running(t.orders.select("o_orderkey"), [], F.col("o_orderkey"), [], {"n": F.lit(1)}, hot_rows=100_000)
    return rows.where("n % 23 = 3").select("o_orderkey")


@query("tk08_hash_sample", """
    SELECT o_orderkey FROM orders WHERE ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967295.0 < 0.1""")
def hash_sample(t):
    """A sample anybody can recompute from the id."""
    return t.orders.where(hash_share(F.col("o_orderkey").cast("string")) < 0.1).select("o_orderkey")


def hash_share(key):
    from fleetlens.operators.opsmetrics import hash_share as share
    return share(key)


@query("tk09_failures_and_sample", """
    SELECT o_orderkey, o_orderstatus = 'F' AS failed FROM orders
    WHERE o_orderstatus = 'F' OR ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967295.0 < 0.2""")
def failures_and_sample(t):
    failed = F.col("o_orderstatus") == "F"
    return t.orders.where(failed | (hash_share(F.col("o_orderkey").cast("string")) < 0.2)).select("o_orderkey", failed.alias("failed"))


@query("sf12_normal_ids", """
    SELECT c_custkey, regexp_replace(regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g') AS normal_id FROM customer""")
def normal_ids(t):
    return t.customer.select("c_custkey", text.normal_id(F.col("c_name")).alias("normal_id"))


@query("sf13_slugs", """
    SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
           trim(regexp_replace(lower(trim(p_brand || ' No.')), '[^a-z0-9]+', '_', 'g'), '_') AS column_key FROM part""")
def slugs(t):
    name = F.concat_ws(" / ", "p_name", "p_brand")
    return t.part.select("p_partkey", text.slug(name).alias("slug"), text.column_key(F.concat("p_brand", F.lit(" No."))).alias("column_key"))


@query("sf14_lists_and_dates", """
    SELECT o_orderkey, len(list_filter(list_transform(string_split(o_orderpriority || ', ,' || o_orderstatus, ','), lambda x: trim(x)), lambda x: x <> '')) AS parts,
           try_cast(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS day FROM orders""")
def lists_and_dates(t):
    both = F.concat_ws(", ,", "o_orderpriority", "o_orderstatus")
    return t.orders.select("o_orderkey", F.size(text.as_list(both)).alias("parts"),
                           text.as_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


@query("sf31_call_keys", """
    SELECT l_orderkey, l_linenumber, l_returnflag || ':{"a":"' || lower(l_linestatus) || '","b":"x y"}' AS call_key FROM lineitem""")
def call_keys(t):
    args = F.create_map(F.lit("b"), F.lit("  X   y "), F.lit("a"), F.col("l_linestatus"), F.lit("z"), F.lit(None).cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", text.call_key(F.col("l_returnflag"), args).alias("call_key"))
