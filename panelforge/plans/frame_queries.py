"""Labelled panels built end to end from the given tables: orders stand for reports and loans, line items for their elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as B
from ..operators import relational as R
from .registry import big, query, r6

ELEMENTS = ["Assets", "Revenue", "CurrentLiabilities", "NonCurrentLiabilities"]


def reports(t):
    return t("orders").select(
        F.col("o_orderkey").alias("report_id"), F.when(F.col("o_custkey") % 29 > 0, F.col("o_custkey")).alias("code"), F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderpriority").alias("form"),
        F.when(F.col("o_orderkey") % 13 == 0, "D").otherwise("R").alias("status"), (F.col("o_orderkey") % 11 == 0).alias("consolidated"), (F.col("o_orderkey") % 2).alias("audited"),
    )


FILED = """WITH r AS (SELECT o_orderkey AS report_id, o_custkey AS code, year(o_orderdate) AS year, CAST(o_orderdate AS DATE) AS filed, o_orderpriority AS form, o_orderkey % 2 AS audited FROM orders WHERE o_orderkey % 11 != 0 AND o_orderkey % 13 != 0 AND o_custkey % 29 > 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY filed, report_id) AS k FROM r) WHERE k = 1),
e AS (SELECT l_orderkey AS report_id, sum(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS a, sum(CASE WHEN l_linenumber = 2 THEN l_extendedprice END) AS v, sum(CASE WHEN l_linenumber = 3 THEN l_extendedprice END) AS c, sum(CASE WHEN l_linenumber = 4 THEN l_extendedprice END) AS n FROM lineitem GROUP BY 1),
d AS (SELECT o_custkey AS code, min(CAST(o_orderdate AS DATE)) AS declared FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1), s AS (SELECT o_custkey AS code, min(CAST(o_orderdate AS DATE)) AS entry FROM orders GROUP BY 1), m AS (SELECT max(CAST(o_orderdate AS DATE)) AS cut FROM orders)"""


@query(f"""{FILED} SELECT f.code, CAST(f.year AS INTEGER) AS year, f.filed, CAST(CASE WHEN declared > filed AND declared <= filed + 365 THEN 1 ELSE 0 END AS BIGINT) AS label, round(v / nullif(a, 0), 6) AS turnover, round(CASE WHEN c IS NOT NULL OR n IS NOT NULL THEN (coalesce(c, 0) + coalesce(n, 0)) / nullif(a, 0) END, 6) AS debt, round(ln(1 + greatest(a, 0)), 6) AS log_assets, round(CASE WHEN v IS NOT NULL THEN ln(1 + greatest(v, 0)) END, 6) AS log_revenue, round(ln(1 + (filed - entry)), 6) AS log_age_days, form, audited
FROM f JOIN e USING (report_id) LEFT JOIN d ON d.code = f.code LEFT JOIN s ON s.code = f.code, m WHERE a IS NOT NULL AND NOT coalesce(declared <= filed, false) AND filed + 365 <= cut""")
def filed_label_frame(t, spark):
    """Company-year panel with a forward declaration label, from reports, long elements, declarations and register entries."""
    wide = R.pivot_fixed(t("lineitem").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("report_id"), F.element_at(F.array(*[F.lit(e) for e in ELEMENTS]), F.col("l_linenumber")).alias("element"), "l_extendedprice"), ["report_id"], "element", ELEMENTS, F.sum("l_extendedprice"))
    o = t("orders").select(F.col("o_custkey").alias("code"), "o_orderkey", F.to_date("o_orderdate").alias("day"))
    declared = o.where("o_orderkey % 7 = 0").select("code", F.col("day").alias("declared"))
    cut = F.lit(o.agg(F.max("day")).first()[0])
    got = B.filing_frame(reports(t), wide, declared, o.select("code", F.col("day").alias("entry")), {"turnover": ("Revenue", "Assets"), "debt": ("Liabilities", "Assets")}, "D", 365, cut)
    return got.withColumns({c: r6(c) for c in ("turnover", "debt", "log_assets", "log_revenue", "log_age_days")})


LOANS = "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS made, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 1500 AS INTEGER) END AS bad FROM orders"


def loans(t):
    made = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", "o_custkey", made.alias("made"), F.when(F.col("o_orderkey") % 6 == 0, F.date_add(made, (F.col("o_orderkey") % 1500).cast("int"))).alias("bad"))


@query(f"""WITH l AS ({LOANS}), m AS (SELECT max(made) AS s FROM l) SELECT o_orderkey, made, CAST(CASE WHEN bad <= made + INTERVAL 12 MONTH THEN 1 ELSE 0 END AS BIGINT) AS label FROM l, m WHERE made <= s - INTERVAL 12 MONTH""")
def default_label_frame(t, spark):
    x = loans(t)
    return B.default_frame(x, "made", "bad", F.lit(x.agg(F.max("made")).first()[0]), 12).select("o_orderkey", "made", "label")


@query(f"""WITH l AS (SELECT *, CASE WHEN o_orderkey % 19 = 0 THEN 'CANCELLED' WHEN bad IS NOT NULL OR o_orderkey % 23 = 0 THEN 'CHARGED' ELSE 'PAID' END AS status FROM ({LOANS})) SELECT status, count(*) AS n, CAST(sum(CASE WHEN bad <= made + INTERVAL 36 MONTH THEN 1 ELSE 0 END) AS BIGINT) AS labels FROM l WHERE status != 'CANCELLED' AND NOT (status = 'CHARGED' AND bad IS NULL) GROUP BY 1""")
def charge_off_label_frame(t, spark):
    x = loans(t).withColumn("status", F.when(F.col("o_orderkey") % 19 == 0, "CANCELLED").when(F.col("bad").isNotNull() | (F.col("o_orderkey") % 23 == 0), "CHARGED").otherwise("PAID"))
    got = B.charge_off_frame(x, "made", "bad", "status", ["CANCELLED", "CHARGED", "PAID"], ["CANCELLED"], "CHARGED", F.lit("2020-01-01").cast("date"), 36)
    return got.groupBy("status").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


@query("""WITH p AS (SELECT l_orderkey, CAST(max(CASE WHEN l_returnflag = 'R' AND l_quantity > 30 THEN 1 ELSE 0 END) AS BIGINT) AS label FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1) SELECT o_orderkey, o_totalprice, label FROM orders JOIN p ON l_orderkey = o_orderkey""")
def distress_label_frame(t, spark):
    """Loans at origination with whether any later record is in distress; those without records leave."""
    records = t("lineitem").where("l_orderkey % 3 > 0").withColumnRenamed("l_orderkey", "o_orderkey")
    return B.distress_frame(t("orders").select("o_orderkey", "o_totalprice"), records, "o_orderkey", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30)).select("o_orderkey", "o_totalprice", "label")


@query(f"""WITH l AS ({LOANS}), p AS (SELECT CAST(CASE WHEN bad <= made + INTERVAL 12 MONTH THEN 1 ELSE 0 END AS BIGINT) AS label, CAST(o_custkey AS DOUBLE) AS a, CASE WHEN o_orderkey % 5 = 0 THEN 1e0 END AS b, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS DOUBLE) END AS c FROM l)
SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate, CASE WHEN avg(label) < 1e-2 THEN 'rarer' WHEN avg(label) > 2e-1 THEN 'more common' ELSE 'inside' END AS band, round((avg(CASE WHEN b IS NULL THEN 1e0 ELSE 0e0 END) + avg(CASE WHEN c IS NULL THEN 1e0 ELSE 0e0 END)) / 3, 6) AS missing, CAST(CASE WHEN avg(CASE WHEN b IS NULL THEN 1e0 ELSE 0e0 END) > 5e-1 THEN 1 ELSE 0 END + CASE WHEN avg(CASE WHEN c IS NULL THEN 1e0 ELSE 0e0 END) > 5e-1 THEN 1 ELSE 0 END AS BIGINT) AS mostly_missing, CAST(1 AS BIGINT) AS constant FROM p""")
def panel_feasibility(t, spark):
    key = F.col("o_orderkey")
    p = loans(t).select(big(F.coalesce(F.col("bad") <= F.add_months("made", 12), F.lit(False))).alias("label"), F.col("o_custkey").alias("a"), F.when(key % 5 == 0, 1.0).alias("b"), F.when(key % 2 == 0, key).alias("c"))
    got = B.feasibility(p, ["a", "b", "c"], "label", (0.01, 0.2))
    return got.select("n", "positives", r6("rate").alias("rate"), "band", r6("missing").alias("missing"), "mostly_missing", "constant")
