"""Panel building: dedup, pivots, labels, lags, cleaning rules, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import overlap as O
from ..operators import relational as R
from .registry import big, h, query, r6

FACTS = "SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS y, o_orderkey, o_totalprice, o_orderdate, o_orderstatus FROM orders"


def facts(t):
    return t("orders").select("o_custkey", big(F.year("o_orderdate")).alias("y"), "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS k FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) AS l_quantity FROM r WHERE k = 1""")
def dedup_keep_first(t, spark):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return R.dedup_first(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).select("l_orderkey", big("l_linenumber").alias("l_linenumber"), "l_partkey", "l_quantity")


@query("SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS qty_a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS qty_n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS qty_r FROM lineitem GROUP BY l_orderkey")
def pivot_fixed_columns(t, spark):
    wide = R.pivot_fixed(t("lineitem"), ["l_orderkey"], "l_returnflag", ["A", "N", "R"], F.sum("l_quantity"))
    return wide.select("l_orderkey", F.col("A").alias("qty_a"), F.col("N").alias("qty_n"), F.col("R").alias("qty_r"))


@query("""WITH s AS (SELECT user_id, event_id, ts + INTERVAL 1 DAY AS t FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, ts FROM events WHERE event_type = 'error')
SELECT s.event_id, CAST(max(CASE WHEN e.ts > s.t AND e.ts <= s.t + INTERVAL 3 DAY THEN 1 ELSE 0 END) AS BIGINT) AS label FROM s LEFT JOIN e ON e.user_id = s.user_id GROUP BY s.event_id""")
def forward_event_label(t, spark):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    return R.forward_label(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), "user_id", "ts", "ts", "1 day", "3 days").select("event_id", "label")


@query(f"""WITH f AS ({FACTS}), p AS (SELECT DISTINCT o_custkey, y FROM f)
SELECT p.o_custkey, p.y, CAST(CASE WHEN p.y + 1 <= 2000 THEN CASE WHEN a.y IS NULL THEN 0 ELSE 1 END END AS BIGINT) AS label_1, CAST(CASE WHEN p.y + 2 <= 2000 THEN CASE WHEN b.y IS NULL THEN 0 ELSE 1 END END AS BIGINT) AS label_2
FROM p LEFT JOIN p a ON a.o_custkey = p.o_custkey AND a.y = p.y + 1 LEFT JOIN p b ON b.o_custkey = p.o_custkey AND b.y = p.y + 2""")
def censored_horizon_labels(t, spark):
    f = facts(t)
    got = R.censored_labels(f.select("o_custkey", "y").distinct(), f, ("o_custkey", "y"), 2, F.lit(2000))
    return got.select("o_custkey", "y", big(F.col("labels")[0]).alias("label_1"), big(F.col("labels")[1]).alias("label_2"))


@query(f"""WITH p AS (SELECT o_custkey, y, round(sum(o_totalprice), 2) AS total FROM ({FACTS}) GROUP BY 1, 2)
SELECT p.o_custkey, p.y, round(p.total, 4) AS total, round(q.total, 4) AS before FROM p LEFT JOIN p q ON q.o_custkey = p.o_custkey AND q.y = p.y - 1""")
def exact_year_lag(t, spark):
    p = facts(t).groupBy("o_custkey", "y").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return R.exact_lag(p, "o_custkey", "y", ["total"]).select("o_custkey", "y", F.round("total", 4).alias("total"), F.round("total_lag1", 4).alias("before"))


@query("""WITH d AS (SELECT user_id, min(ts) AS first_error FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT e.event_id, CAST(coalesce(d.first_error <= e.ts, false) AS BOOLEAN) AS declared FROM events e LEFT JOIN d USING (user_id) WHERE e.event_type = 'purchase'""")
def first_declaration_join(t, spark):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    first = R.first_event(e.where("event_type = 'error'"), "user_id", "ts", "first_error")
    return e.where("event_type = 'purchase'").join(first, "user_id", "left").select("event_id", F.coalesce(F.col("first_error") <= F.col("ts"), F.lit(False)).alias("declared"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def anti_join_entities(t, spark):
    return R.anti_entities(t("customer").withColumnRenamed("c_custkey", "o_custkey"), t("orders").where("o_orderstatus = 'P'"), "o_custkey").select(F.col("o_custkey").alias("c_custkey"), "c_mktsegment")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5) GROUP BY 1")
def semi_join_whitelist(t, spark):
    return t("lineitem").join(t("part").where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(f"""WITH f AS ({FACTS}) SELECT o_custkey, round(max(CASE WHEN y = 1996 THEN o_totalprice END), 4) AS h1996, round(max(CASE WHEN y = 1997 THEN o_totalprice END), 4) AS h1997, round(max(CASE WHEN y = 1998 THEN o_totalprice END), 4) AS h1998
FROM f GROUP BY 1 HAVING count(DISTINCT CASE WHEN y IN (1996, 1997, 1998) THEN y END) = 3""")
def aligned_horizons(t, spark):
    got = R.aligned(facts(t), "o_custkey", "y", "o_totalprice", [1996, 1997, 1998])
    return got.select("o_custkey", *[F.round(c, 4).alias(c) for c in ("h1996", "h1997", "h1998")])


@query(f"""WITH f AS ({FACTS}) SELECT count(*) AS shared FROM (SELECT o_custkey FROM f WHERE y = 1995 INTERSECT SELECT o_custkey FROM f WHERE y = 2001)""")
def shared_entity_count(t, spark):
    f = facts(t)
    return R.shared_entities(f.where("y = 1995"), f.where("y = 2001"), "o_custkey").agg(F.count("*").alias("shared"))


@query("""WITH a AS (SELECT p_partkey, p_retailprice AS v FROM part), b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS v FROM part)
SELECT a.p_partkey, a.v AS a, b.v AS b FROM a JOIN b USING (p_partkey) WHERE a.v IS DISTINCT FROM b.v AND (a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 0.5)""")
def run_mismatches(t, spark):
    a = t("part").select("p_partkey", F.col("p_retailprice").alias("v"))
    b = a.withColumn("v", F.when(F.col("p_partkey") % 7 == 0, None).when(F.col("p_partkey") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return R.mismatches(a, b, ["p_partkey"], "v", 0.5)


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT l.event_id, r.value AS last_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def as_of_join(t, spark):
    e = t("events").select("event_id", "user_id", "ts", "event_type", "value")
    views = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("value").alias("last_value"))
    return R.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "at", ["last_value"]).select("event_id", "last_value")


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS code FROM part")
def dense_entity_codes(t, spark):
    return R.dense_codes(t("part").select("p_partkey", "p_brand"), "p_brand", "code").select("p_partkey", "code")


CODES = "CASE WHEN s_suppkey % 5 = 0 THEN ' ' || CAST(s_suppkey AS VARCHAR) WHEN s_suppkey % 5 = 1 THEN 'sc' || CAST(s_suppkey AS VARCHAR) WHEN s_suppkey % 5 = 2 THEN '12-' || CAST(s_suppkey AS VARCHAR) WHEN s_suppkey % 5 = 3 THEN NULL ELSE CAST(s_suppkey % 7 AS VARCHAR) END"
NORMAL = "CASE WHEN regexp_full_match(upper(trim(c)), '[0-9]{1,8}') THEN lpad(upper(trim(c)), 8, '0') WHEN regexp_full_match(upper(trim(c)), '[A-Z0-9]{1,8}') THEN upper(trim(c)) END"


def registry(t):
    s = t("supplier")
    text, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 5
    code = F.when(k == 0, F.concat(F.lit(" "), text)).when(k == 1, F.concat(F.lit("sc"), text)).when(k == 2, F.concat(F.lit("12-"), text)).when(k == 3, F.lit(None)).otherwise((F.col("s_suppkey") % 7).cast("string"))
    return s.select("s_suppkey", "s_nationkey", "s_acctbal", S.code8(code).alias("code"))


@query(f"""WITH r AS (SELECT s_suppkey, s_nationkey, s_acctbal, {NORMAL} AS code FROM (SELECT *, {CODES} AS c FROM supplier)), n AS (SELECT *, count(*) OVER (PARTITION BY code) AS k FROM r)
SELECT s_suppkey, code, CASE WHEN code IS NULL THEN 'malformed' WHEN k > 1 THEN 'duplicate' WHEN s_acctbal < 0 THEN 'balance' WHEN s_nationkey < 5 THEN 'nation' ELSE 'included' END AS reason FROM n""")
def cohort_reasons(t, spark):
    r = registry(t)
    twice = r.where("code is not null").groupBy("code").agg(F.count("*").alias("k"))
    rules = [("malformed", F.col("code").isNull()), ("duplicate", F.col("k") > 1), ("balance", F.col("s_acctbal") < 0), ("nation", F.col("s_nationkey") < 5)]
    return r.join(twice, "code", "left").select("s_suppkey", "code", F.coalesce(S.first_failing(rules), F.lit("included")).alias("reason"))


@query(f"""WITH r AS (SELECT {NORMAL} AS code FROM (SELECT *, {CODES} AS c FROM supplier))
SELECT sha256(concat('{{"rule": 1}}', chr(10), string_agg(code, chr(10) ORDER BY code))) AS digest, count(*) AS n FROM (SELECT DISTINCT code FROM r WHERE code IS NOT NULL)""")
def cohort_digest(t, spark):
    return O.sorted_set_digest(registry(t).where("code is not null"), "code", '{"rule": 1}')


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST((o_orderkey * 37) % 900 AS INTEGER) AS b FROM orders)
SELECT o_orderkey, CAST((year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END AS BIGINT) AS months FROM d""")
def whole_month_spans(t, spark):
    d = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("a")).withColumn("b", F.date_add("a", ((F.col("o_orderkey") * 37) % 900).cast("int")))
    return d.select("o_orderkey", S.whole_months("a", "b").alias("months"))


RAW = "CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 4 = 2 THEN 'unknown' END"


@query(f"SELECT o_orderkey, CAST(coalesce(try_strptime(r, '%d/%m/%Y'), try_strptime(r, '%Y-%m-%d')) AS DATE) AS parsed FROM (SELECT o_orderkey, {RAW} AS r FROM orders)")
def tolerant_dates(t, spark):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.lit("unknown"))
    return t("orders").select("o_orderkey", S.parse_date(raw).alias("parsed"))


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '$' || CAST(p_partkey AS VARCHAR) || ',500.25' WHEN p_partkey % 3 = 1 THEN CAST(p_partkey AS VARCHAR) ELSE 'n/a' END AS m, CASE WHEN p_size % 10 = 0 THEN '9999' ELSE CAST(p_size AS VARCHAR) END AS s, CASE WHEN p_size % 4 = 0 THEN '10+ years' WHEN p_size % 4 = 1 THEN '< 1 year' WHEN p_size % 4 = 2 THEN CAST(p_size AS VARCHAR) || ' years' END AS e FROM part)
SELECT p_partkey, TRY_CAST(replace(replace(m, '$', ''), ',', '') AS DOUBLE) AS amount, TRY_CAST(nullif(s, '9999') AS DOUBLE) AS size, CASE WHEN e LIKE '< 1%' THEN 0.0 ELSE TRY_CAST(nullif(regexp_extract(e, '([0-9]+)', 1), '') AS DOUBLE) END AS years FROM m""")
def tolerant_numbers(t, spark):
    text, k, s = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3, F.col("p_size")
    m = F.when(k == 0, F.concat(F.lit("$"), text, F.lit(",500.25"))).when(k == 1, text).otherwise("n/a")
    size = F.when(s % 10 == 0, "9999").otherwise(s.cast("string"))
    years = F.when(s % 4 == 0, "10+ years").when(s % 4 == 1, "< 1 year").when(s % 4 == 2, F.concat(s.cast("string"), F.lit(" years")))
    return t("part").select("p_partkey", S.money(m).alias("amount"), S.sentinel(size, "9999").alias("size"), S.years_employed(years).alias("years"))


@query("""WITH n AS (SELECT p_type, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS f FROM (SELECT DISTINCT p_type FROM part)), m AS (SELECT c_mktsegment, regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '', 'g') || 'x' AS g FROM (SELECT DISTINCT c_mktsegment FROM customer)), x AS (SELECT p_type AS other, f || 'set' AS g FROM n)
SELECT n.p_type AS name, x.other AS clash FROM n JOIN x ON n.f = x.g OR (least(length(n.f), length(x.g)) >= 6 AND (CASE WHEN length(n.f) <= length(x.g) THEN contains(x.g, n.f) ELSE contains(n.f, x.g) END))""")
def fuzzy_name_clashes(t, spark):
    n = t("part").select("p_type").distinct().withColumn("f", S.folded("p_type"))
    other = n.select(F.col("p_type").alias("clash"), F.concat("f", F.lit("set")).alias("g"))  # both are lists of names
    return n.join(F.broadcast(other), S.same_name(F.col("f"), F.col("g"))).select(F.col("p_type").alias("name"), "clash")


@query("""WITH r AS (SELECT p_partkey, p_type, p_size, p_retailprice FROM part), e AS (SELECT * FROM r WHERE p_size <= 25 AND p_retailprice > 950)
SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM e) WHERE k <= 3""")
def top_n_per_kind(t, spark):
    from pyspark.sql import Window as W

    e = t("part").where("p_size <= 25 and p_retailprice > 950")
    return e.withColumn("k", F.row_number().over(W.partitionBy("p_type").orderBy("p_partkey"))).where("k <= 3").select("p_type", "p_partkey")


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END, CASE WHEN p_brand LIKE '%1' THEN 'brand' END], lambda x: x IS NOT NULL), ',') AS why FROM part""")
def exclusion_reasons(t, spark):
    rules = [("large", F.col("p_size") > 40), ("dear", F.col("p_retailprice") > 1500), ("brand", F.col("p_brand").endswith("1"))]
    return t("part").select("p_partkey", F.array_join(S.reasons(rules), ",").alias("why"))


@query("""WITH l(x) AS (VALUES ('CC BY 4.0'), ('CC-BY-NC 4.0'), ('cc by-sa'), ('CC0'), ('Public Domain (CC0)'), ('MIT'), ('GPL'), (NULL), ('cc by'))
SELECT coalesce(x, '-') AS licence, CASE WHEN x IN ('CC BY 4.0', 'CC0', 'Public Domain (CC0)', 'MIT', 'cc by') THEN true ELSE false END AS ok FROM l""")
def licence_verdicts(t, spark):
    rows = spark.createDataFrame([(x,) for x in ("CC BY 4.0", "CC-BY-NC 4.0", "cc by-sa", "CC0", "Public Domain (CC0)", "MIT", "GPL", None, "cc by")], "x string")
    return rows.select(F.coalesce("x", F.lit("-")).alias("licence"), S.licence_ok("x").alias("ok"))


@query("""SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')), lambda x: x NOT IN ('this', 'that', 'with'))), ' ') AS words FROM benchmark""")
def name_tokens(t, spark):
    return t("benchmark").select("item_id", F.array_join(S.tokens("text", ["this", "that", "with"]), " ").alias("words"))


@query("SELECT last_day(make_date(CAST(y AS INTEGER), CAST(m AS INTEGER), 1)) AS d FROM range(1995, 2002) a(y), (VALUES (3), (6), (9), (12)) b(m)")
def quarter_end_calendar(t, spark):
    from ..sources.calendars import quarter_ends

    return quarter_ends(spark, "1995-01-01", "2001-12-31")


@query("""WITH n AS (SELECT l_orderkey, list_sort([printf('%.4e', l_quantity), printf('%.4e', l_extendedprice), printf('%.4e', l_discount), printf('%.4e', l_tax)]) AS t FROM lineitem WHERE l_linestatus = 'F'), h AS (SELECT md5(array_to_string(t, chr(31))) AS row_hash FROM n), c AS (SELECT DISTINCT row_hash FROM h),
m AS (SELECT DISTINCT md5(array_to_string(list_sort([printf('%.4e', l_quantity), printf('%.4e', l_extendedprice), printf('%.4e', l_discount), printf('%.4e', l_tax)]), chr(31))) AS row_hash FROM lineitem WHERE l_returnflag = 'R')
SELECT count(*) AS n, count(m.row_hash) AS shared, round(count(m.row_hash) / CAST(count(*) AS DOUBLE), 6) AS share FROM c LEFT JOIN m USING (row_hash)""")
def row_hash_containment(t, spark):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    a = O.row_hashes(t("lineitem").where("l_linestatus = 'F'").select(*cols), cols)
    b = O.row_hashes(t("lineitem").where("l_returnflag = 'R'").select(*cols), cols)
    return O.containment(a, b, "row_hash").select("n", "shared", r6("share").alias("share"))


@query("""WITH q AS (SELECT printf('%.4e', l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT printf('%.4e', l_discount) AS v, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'l_quantity' AS "column", md5(string_agg(v || ':' || CAST(n AS VARCHAR), chr(31) ORDER BY v || ':' || CAST(n AS VARCHAR))) AS fingerprint FROM q UNION ALL SELECT 'l_discount', md5(string_agg(v || ':' || CAST(n AS VARCHAR), chr(31) ORDER BY v || ':' || CAST(n AS VARCHAR))) FROM e
UNION ALL SELECT 'l_returnflag', md5(string_agg(CAST(n AS VARCHAR), chr(31) ORDER BY n)) FROM f""")
def column_content_fingerprints(t, spark):
    return O.column_fingerprints(t("lineitem").select("l_quantity", "l_discount", "l_returnflag"), ["l_quantity", "l_discount"], ["l_returnflag"])


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def set_operations(t, spark):
    n = t("customer").select(F.col("c_nationkey").alias("k")).unionByName(t("supplier").select(F.col("s_nationkey").alias("k")))
    c, o = t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k"))
    count = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return count(n.distinct(), "union").unionByName(count(n, "union_all")).unionByName(count(c.intersect(o), "intersect")).unionByName(count(c.subtract(o), "except"))


@query(f"""WITH s AS (SELECT o_custkey, o_orderkey, {h("o_orderkey")} % 100 AS s FROM orders) SELECT o_custkey, CAST(max(CASE WHEN s >= 97 THEN 1 ELSE 0 END) AS BIGINT) AS flag FROM s GROUP BY 1""")
def any_per_entity(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.max(big(S.bucket(100, "o_orderkey") >= 97)).alias("flag"))
