"""Families of score pairs, two runs side by side, and what tables of a catalogue share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import comparison as Q
from ..operators import overlap as O
from ..operators import significance as U
from .evaluation_queries import TWO, two_scores, weight_sql
from .metric_queries import RES, results
from .registry import big, h, query, r6

THREE = f"SELECT s.*, round(2 * {h("concat(_row_id, '|c')")} / 4294967296e0 / 3 + y / 3e0, 2) AS c FROM ({TWO}) s"


def three_scores(t):
    return two_scores(t).withColumn("c", F.round(2 * S.uniform("_row_id", F.lit("c")) / 3 + F.col("y") / 3.0, 2))


DRAWS = 60


def family_sql(pairs: list[tuple[str, str]], value: str) -> str:
    return f"""WITH s AS ({THREE}), l AS (SELECT g, o_custkey AS k, y, 'p' AS which, p AS v FROM s UNION ALL SELECT g, o_custkey, y, 'b', b FROM s UNION ALL SELECT g, o_custkey, y, 'c', c FROM s), n AS (SELECT g, k, which, v, count(*) AS n, sum(y) AS pos FROM l GROUP BY ALL),
u AS (SELECT k, i AS draw, {h("concat(i, '|', k)")} / 4294967296e0 AS u FROM (SELECT DISTINCT k FROM n), range(0, {DRAWS + 1}) r(i)), d AS (SELECT k, draw, CASE WHEN draw = 0 THEN 1 ELSE {weight_sql('u')} END AS w FROM u),
x AS (SELECT g, draw, which, v, sum(w * n) AS n, sum(w * pos) AS pos FROM n JOIN d USING (k) WHERE w > 0 GROUP BY ALL), r AS (SELECT *, sum(n) OVER z AS cn, sum(pos) OVER z AS cp FROM x WINDOW z AS (PARTITION BY g, draw, which ORDER BY v DESC)),
t AS (SELECT g, draw, which, CAST(sum(pos) AS DOUBLE) AS tp, CAST(sum(n - pos) AS DOUBLE) AS tn, sum(pos * ((cn - n) - (cp - pos) + (n - pos) / 2e0)) AS lost, sum(pos * cp / CAST(cn AS DOUBLE)) AS gain FROM r GROUP BY ALL),
m AS (SELECT g, draw, which, CASE WHEN tp > 0 AND tn > 0 THEN {value} END AS m FROM t), q AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in pairs)}) q(a, b)),
e AS (SELECT i.g, q.a, q.b, i.draw, i.m - j.m AS diff FROM q JOIN m i ON i.which = q.a JOIN m j ON j.which = q.b AND j.g = i.g AND j.draw = i.draw),
f AS (SELECT g, a, b, max(CASE WHEN draw = 0 THEN diff END) AS diff, count(CASE WHEN draw > 0 THEN diff END) AS drawn, quantile_cont(CASE WHEN draw > 0 THEN diff END, 25e-3) AS low, quantile_cont(CASE WHEN draw > 0 THEN diff END, 975e-3) AS high, count(CASE WHEN draw > 0 AND diff <= 0 THEN 1 END) AS below, count(CASE WHEN draw > 0 AND diff >= 0 THEN 1 END) AS above FROM e GROUP BY ALL),
y AS (SELECT *, least(1e0, greatest(2e0 * least(below, above) / drawn, 1e0 / (drawn + 1))) AS p FROM f), k AS (SELECT *, least(1e0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, concat_ws('|', g, a, b)) + 1)) AS adj FROM y)
SELECT g, a, b, round(diff, 6) AS diff, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, round(max(adj) OVER (ORDER BY p, concat_ws('|', g, a, b)), 6) AS p_holm FROM k"""


def family_of(t, pairs, metric):
    got = U.many_differences(three_scores(t), ["g"], "o_custkey", "y", ["p", "b", "c"], pairs, metric, DRAWS, 30)
    return got.select("g", "a", "b", *[r6(c).alias(c) for c in ("diff", "low", "high", "p", "p_holm")])


EVERY, EXACT = [("b", "c"), ("b", "p"), ("c", "p")], [("b", "p"), ("c", "p")]


@query(family_sql(EVERY, "1 - lost / (tp * tn)"))
def strategy_family(t, spark):
    """All pairs of three scores in every group as one family, from one bootstrap over customers."""
    return family_of(t, EVERY, "auc")


@query(family_sql(EXACT, "gain / tp"))
def reference_family(t, spark):
    """Each score against one that is named as exact, by average precision."""
    return family_of(t, EXACT, "ap")


RUN = f"WITH r AS ({RES}), a AS (SELECT task, split, CASE WHEN method = '1-URGENT' THEN 'ours' ELSE method END AS method, error FROM r WHERE method IN ('1-URGENT', '3-MEDIUM', '4-NOT SPECIFIED')), b AS (SELECT task, split, CASE WHEN method = '2-HIGH' THEN 'ours' ELSE method END AS method, error FROM r WHERE method IN ('2-HIGH', '3-MEDIUM', '5-LOW'))"


def two_runs(t):
    r = results(t)
    part = lambda own, *rest: r.where(F.col("method").isin(own, *rest)).withColumn("method", F.when(F.col("method") == own, "ours").otherwise(F.col("method")))
    return part("1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED"), part("2-HIGH", "3-MEDIUM", "5-LOW")


BASE = ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"{RUN} SELECT task, split, CASE WHEN method = 'ours' THEN 'ours [a]' ELSE method END AS method, error FROM a UNION ALL SELECT task, split, CASE WHEN method = 'ours' THEN 'ours [b]' ELSE method END, error FROM b WHERE method = 'ours' UNION ALL SELECT task, split, method, error FROM b WHERE method <> 'ours' AND NOT EXISTS (SELECT 1 FROM a WHERE a.task = b.task AND a.split = b.split AND a.method = b.method)")
def combined_results(t, spark):
    """Two runs of one candidate's name as one table; the baseline that both have agrees and counts once."""
    a, b = two_runs(t)
    return Q.combined_runs(a, b, ["task", "split"], "method", "error", BASE)[0].select("task", "split", "method", "error")


@query(f"""{RUN}, w AS (SELECT task, avg(c) AS c, avg(r) AS r FROM (SELECT task, error AS c, NULL AS r FROM a WHERE method = 'ours' UNION ALL SELECT task, NULL, error FROM b WHERE method = 'ours') GROUP BY 1), k AS (SELECT count(CASE WHEN c < r THEN 1 END) AS wins, count(CASE WHEN c > r THEN 1 END) AS losses, count(CASE WHEN c = r THEN 1 END) AS ties, avg(c - r) AS mean_delta FROM w WHERE c IS NOT NULL AND r IS NOT NULL),
z AS (SELECT wins, losses, ties, mean_delta, (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1)) * pow(5e-1, wins + losses)) FROM range(0, 1000) x(i) WHERE i <= least(wins, losses)) AS tail FROM k) SELECT wins, losses, ties, round(mean_delta, 3) AS mean_delta, round(least(1e0, 2 * tail), 6) AS p FROM z""")
def compared_runs(t, spark):
    """The sign test by task of one run's candidate against the other's."""
    a, b = two_runs(t)
    return Q.compare_runs(a, b, "task", ["split"], "method", "error", BASE, "3-MEDIUM")[1].select("wins", "losses", "ties", F.round("mean_delta", 3).alias("mean_delta"), r6("p").alias("p"))


TABLES = {
    "recent": ("orders WHERE o_orderdate >= DATE '1998-01-01'", {"price": "o_totalprice", "customer": "o_custkey"}),
    "accounts": ("customer", {"balance": "c_acctbal", "nation": "c_nationkey", "number": "c_custkey"}),
    "parts": ("part", {"price": "p_retailprice", "size": "p_size"}),
    "orders": ("orders", {"p": "o_totalprice", "c": "o_custkey"}),
    "mixed": ("customer", {"n": "c_nationkey", "b": "c_acctbal", "k": "(SELECT max(c_custkey) + min(c_custkey) FROM customer) - c_custkey"}),
    "lines": ("lineitem", {"e": "l_extendedprice", "q": "l_quantity"}),
    "suppliers": ("supplier", {"b": "s_acctbal", "n": "s_nationkey", "k": "s_suppkey"}),
}
MINE, THEIRS = ["recent", "accounts", "parts"], ["orders", "mixed", "lines", "suppliers"]


def _rows(name: str) -> str:
    source, columns = TABLES[name]
    return f"SELECT DISTINCT '{name}' AS t, md5(array_to_string(list_sort([{', '.join(f"printf('%.4e', CAST({e} AS DOUBLE))" for e in columns.values())}]), chr(31))) AS h FROM {source}"


def _columns(name: str) -> str:
    source, columns = TABLES[name]
    return " UNION ALL ".join(f"SELECT '{name}' AS t, '{c}' AS c, concat(count(*), '-', sum(CAST(CAST(concat('0x', substr(md5(concat(v, ':', n)), 1, 15)) AS BIGINT) AS HUGEINT))) AS f FROM (SELECT printf('%.4e', CAST({e} AS DOUBLE)) AS v, count(*) AS n FROM {source} GROUP BY 1)" for c, e in columns.items())


@query(f"""WITH a AS ({' UNION ALL '.join(map(_rows, MINE))}), b AS ({' UNION ALL '.join(map(_rows, THEIRS))}), ac AS ({' UNION ALL '.join(map(_columns, MINE))}), bc AS ({' UNION ALL '.join(map(_columns, THEIRS))}),
n AS (SELECT t, count(*) AS n FROM a GROUP BY 1), w AS (SELECT t, count(*) AS w FROM ac GROUP BY 1), r AS (SELECT a.t, b.t AS ref, count(*) AS shared FROM a JOIN b USING (h) GROUP BY 1, 2), k AS (SELECT ac.t, bc.t AS ref, count(DISTINCT ac.c) AS cols FROM ac JOIN bc USING (f) GROUP BY 1, 2),
p AS (SELECT t, ref, coalesce(shared / CAST(n AS DOUBLE), 0) AS row_share, coalesce(cols / CAST(w AS DOUBLE), 0) AS column_share, coalesce(cols, 0) AS shared_columns FROM r FULL JOIN k USING (t, ref) JOIN n USING (t) JOIN w USING (t)), o AS (SELECT *, row_share >= 5e-1 OR (shared_columns >= 3 AND column_share >= 5e-1) AS over FROM p),
best AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY t ORDER BY over DESC, row_share DESC, column_share DESC, ref) = 1), l AS (SELECT t, string_agg(ref, ',' ORDER BY ref) AS overlapping FROM o WHERE over GROUP BY 1)
SELECT n.t AS candidate, n AS hashed, ref AS best, round(row_share, 6) AS row_share, round(column_share, 6) AS column_share, shared_columns, coalesce(overlapping, '') AS overlapping FROM n LEFT JOIN best USING (t) LEFT JOIN l USING (t)""")
def catalogue_overlaps(t, spark):
    """Three candidate tables against four references: part of one, one with its rows mixed, and strangers."""
    top = t("customer").agg((F.max("c_custkey") + F.min("c_custkey")).alias("top"))  # one row
    frames = {
        "recent": t("orders").where("o_orderdate >= DATE '1998-01-01'"), "accounts": t("customer"), "parts": t("part"), "orders": t("orders"),
        "mixed": t("customer").crossJoin(F.broadcast(top)).withColumn("k", F.col("top") - F.col("c_custkey")), "lines": t("lineitem"), "suppliers": t("supplier"),
    }
    shaped = {name: (frames[name].select(*[(F.col("k") if e.startswith("(") else F.col(e)).alias(c) for c, e in columns.items()]), list(columns)) for name, (_, columns) in TABLES.items()}
    report, _ = O.catalogue_report({n: shaped[n] for n in MINE}, {n: shaped[n] for n in THEIRS})
    return report.select("candidate", "hashed", "best", r6("row_share").alias("row_share"), r6("column_share").alias("column_share"), big("shared_columns").alias("shared_columns"), F.array_join("overlapping", ",").alias("overlapping"))
