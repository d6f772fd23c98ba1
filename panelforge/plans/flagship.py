"""The flagship query: a forward event label with a lag, a horizon and censoring, split out of time, scored per split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import relational as R
from ..operators import splits as P
from ..operators.tables import settled
from .registry import query, r6


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT event_type) AS types FROM events GROUP BY 1, 2), m AS (SELECT max(ts) AS cut FROM events),
g AS (SELECT d.*, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY AS opens, CAST(day AS TIMESTAMP) + INTERVAL 2 DAY AS closes FROM d, m WHERE CAST(day AS TIMESTAMP) + INTERVAL 2 DAY <= cut),
l AS (SELECT g.*, CAST(epoch(CAST(day AS TIMESTAMP)) / 86400 AS DOUBLE) AS t, CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = g.user_id AND e.event_type = 'error' AND e.ts > opens AND e.ts <= closes) THEN 1 ELSE 0 END AS label FROM g),
q AS (SELECT quantile_cont(t, 5e-1) AS a, quantile_cont(t, 2e0/3e0) AS b, quantile_cont(t, 5e0/6e0) AS c FROM l), w AS (SELECT 0 AS split, a AS start, b AS stop FROM q UNION ALL SELECT 1, b, c FROM q UNION ALL SELECT 2, c, CAST('infinity' AS DOUBLE) FROM q),
s AS (SELECT l.*, w.split FROM l, w WHERE t >= start AND t < stop), k AS (SELECT split, n AS p, count(*) AS c, sum(label) AS pos FROM s GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY split ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY split ORDER BY p DESC) AS cp, sum(pos) OVER (PARTITION BY split) AS tp, sum(c) OVER (PARTITION BY split) AS tn FROM k)
SELECT CAST(split AS BIGINT) AS split, CAST(sum(c) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, round(1 - sum(pos * ((cn - c) - (cp - pos) + (c - pos) / 2e0)) / (max(tp) * (max(tn) - max(tp))), 6) AS auc, round(sum(pos * cp / CAST(cn AS DOUBLE)) / max(tp), 6) AS ap FROM r GROUP BY 1""")
def flagship_out_of_time(t, spark):
    e = t("events").select("user_id", "ts", "event_type", "value")
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("event_type").alias("types"))
    cut = e.agg(F.max("ts").alias("cut"))  # one row
    start = F.col("day").cast("timestamp_ntz")
    open_rows = days.crossJoin(F.broadcast(cut)).withColumn("at", start).where(F.col("at") + F.expr("INTERVAL 2 DAYS") <= F.col("cut")).drop("cut")
    labelled = settled(R.forward_label(open_rows, e.where("event_type = 'error'"), "user_id", "at", "ts", "1 day", "1 day"), "labelled")
    timed = labelled.withColumn("t", F.unix_date("day").cast("double"))
    test = P.out_of_time(timed, "user_id", "t", 1.0).where("part = 'test'")
    return M.rank_metrics(test.withColumn("p", F.col("n").cast("double")), ["split"], "label", "p").select("split", "n", "positives", r6("auc").alias("auc"), r6("ap").alias("ap"))
