"""Seeded generation by hashes, invariants of generated accounts, deterministic streams of tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.quantiles import quantiles
from .registry import big, h, query, r6


def uq(key: str, salt: str) -> str:
    return f"({h(f'concat(CAST({key} AS VARCHAR), chr(124), {salt!r})')} / 4294967296e0)"


ACC = f"""SELECT c_custkey AS firm, exp(10 + 2 * {uq('c_custkey', 'size')}) AS assets, {uq('c_custkey', 'cash')} AS a, {uq('c_custkey', 'recv')} AS b, {uq('c_custkey', 'inv')} AS c, {uq('c_custkey', 'cur')} AS d, {uq('c_custkey', 'lev')} AS e, {uq('c_custkey', 'rev')} AS f FROM customer"""


def accounts(t):
    """Balance sheets that hold their identities: assets = current + fixed = liabilities + equity; current = cash + receivables + inventory."""
    u = lambda salt: S.uniform("c_custkey", F.lit(salt))
    got = t("customer").select(F.col("c_custkey").alias("firm"), F.exp(10 + 2 * u("size")).alias("assets"), *[u(k).alias(n) for n, k in zip("abcdef", ("cash", "recv", "inv", "cur", "lev", "rev"))])
    current = F.col("assets") * F.col("d")
    total = F.col("a") + F.col("b") + F.col("c") + 1e-9
    return got.select("firm", "assets", current.alias("current"), (F.col("assets") - current).alias("fixed"), *[(current * F.col(x) / total).alias(n) for x, n in zip("abc", ("cash", "receivables", "inventory"))], (F.col("assets") * F.col("e") * 1.2).alias("liabilities"), (F.col("assets") - F.col("assets") * F.col("e") * 1.2).alias("equity"), (F.col("assets") * F.col("f") * 2).alias("revenue"))


BAL = f"SELECT firm, assets, assets * d AS current, assets - assets * d AS fixed, assets * d * a / (a + b + c + 1e-9) AS cash, assets * d * b / (a + b + c + 1e-9) AS receivables, assets * d * c / (a + b + c + 1e-9) AS inventory, assets * e * 12e-1 AS liabilities, assets - assets * e * 12e-1 AS equity, assets * f * 2 AS revenue FROM ({ACC})"


@query(f"SELECT firm, round(current / assets, 6) AS current_share, round(equity / assets, 6) AS equity_share, abs(assets - current - fixed) < 1e-6 AND abs(assets - liabilities - equity) < 1e-6 AS balanced FROM ({BAL})")
def generated_accounts(t, spark):
    fine = (F.abs(F.col("assets") - F.col("current") - F.col("fixed")) < 1e-6) & (F.abs(F.col("assets") - F.col("liabilities") - F.col("equity")) < 1e-6)
    return accounts(t).select("firm", r6(F.col("current") / F.col("assets")).alias("current_share"), r6(F.col("equity") / F.col("assets")).alias("equity_share"), fine.alias("balanced"))


@query(f"WITH b AS ({BAL}), f AS (SELECT avg(abs(equity)) * 1e-6 AS fl, avg(abs(liabilities)) * 1e-6 AS ll FROM b) SELECT firm, round(revenue / CASE WHEN equity < 0 THEN -greatest(abs(equity), fl) ELSE greatest(abs(equity), fl) END, 4) AS turnover, round(cash / greatest(abs(liabilities), ll), 4) AS liquidity FROM b, f")
def ratio_family(t, spark):
    b = accounts(t)
    floors = b.agg((F.avg(F.abs("equity")) * 1e-6).alias("fl"), (F.avg(F.abs("liabilities")) * 1e-6).alias("ll"))  # one row
    x = b.crossJoin(F.broadcast(floors))
    return x.select("firm", F.round(S.floored_ratio(F.col("revenue"), F.col("equity"), F.col("fl")), 4).alias("turnover"), F.round(S.floored_ratio(F.col("cash"), F.col("liabilities"), F.col("ll")), 4).alias("liquidity"))


@query(f"SELECT firm, CASE WHEN {uq('firm', 'gate')} < 1 / (1 + exp(-(-1 + 2 * (e - 5e-1)))) THEN NULL ELSE round(e, 6) END AS leverage FROM ({ACC})")
def missing_not_at_random(t, spark):
    e = S.uniform("c_custkey", F.lit("lev"))
    mask = S.uniform("c_custkey", F.lit("gate")) < 1 / (1 + F.exp(-(-1 + 2 * (e - 0.5))))
    return t("customer").select(F.col("c_custkey").alias("firm"), F.when(~mask, r6(e)).alias("leverage"))


@query(f"SELECT firm, CAST((CASE WHEN a > 5e-1 THEN 1 ELSE 0 END) + (CASE WHEN e > 3e-1 THEN 2 ELSE 0 END) + (CASE WHEN f > 7e-1 THEN 4 ELSE 0 END) AS BIGINT) AS leaf FROM ({ACC})")
def oblivious_tree_leaves(t, spark):
    u = lambda salt: S.uniform("c_custkey", F.lit(salt))
    bits = [(u("cash") > 0.5), (u("lev") > 0.3), (u("rev") > 0.7)]
    leaf = F.lit(0)
    for i, b in enumerate(bits):
        leaf = leaf.bitwiseOR(F.shiftleft(b.cast("int"), i))
    return t("customer").select(F.col("c_custkey").alias("firm"), big(leaf).alias("leaf"))


@query(f"WITH g AS (SELECT firm, b AS x, e, {uq('firm', 'leak')} AS v FROM ({ACC})), c AS (SELECT quantile_cont(e, 7e-1) AS cut FROM g) SELECT firm, e > cut AS inside, CAST(CASE WHEN e > cut THEN v < 1 / (1 + exp(-(4 * x - 2))) ELSE v < 2e-2 END AS BIGINT) AS label FROM g, c")
def gated_default_labels(t, spark):
    u = lambda salt: S.uniform("c_custkey", F.lit(salt))
    g = t("customer").select(F.col("c_custkey").alias("firm"), u("recv").alias("x"), u("lev").alias("e"), u("leak").alias("v"))
    cut = quantiles(g, [], "e", [0.7]).select(F.col("q")[0].alias("cut"))  # one row
    x = g.crossJoin(F.broadcast(cut))
    inside = F.col("e") > F.col("cut")
    return x.select("firm", inside.alias("inside"), big(F.when(inside, F.col("v") < 1 / (1 + F.exp(-(4 * F.col("x") - 2)))).otherwise(F.col("v") < 0.02)).alias("label"))


@query(f"WITH g AS (SELECT firm, e FROM ({ACC})), q AS (SELECT [quantile_cont(e, 2e-1), quantile_cont(e, 5e-1), quantile_cont(e, 9e-1)] AS cuts FROM g) SELECT firm, CAST(len(list_filter(cuts, lambda c: c <= e)) AS BIGINT) AS class FROM g, q")
def cut_latent_classes(t, spark):
    g = t("customer").select(F.col("c_custkey").alias("firm"), S.uniform("c_custkey", F.lit("lev")).alias("e"))
    cuts = quantiles(g, [], "e", [0.2, 0.5, 0.9], "cuts")  # one row
    return g.crossJoin(F.broadcast(cuts)).select("firm", big(S.edges_below(F.col("e"), F.col("cuts"))).alias("class"))


@query(f"SELECT firm, CAST(CASE WHEN {uq('firm', 'flip')} < 1e-1 THEN 1 - CAST(e > 5e-1 AS INTEGER) ELSE CAST(e > 5e-1 AS INTEGER) END AS BIGINT) AS y FROM ({ACC})")
def flipped_labels(t, spark):
    y = (S.uniform("c_custkey", F.lit("lev")) > 0.5).cast("int")
    return t("customer").select(F.col("c_custkey").alias("firm"), big(F.when(S.uniform("c_custkey", F.lit("flip")) < 0.1, 1 - y).otherwise(y)).alias("y"))


@query(f"WITH k AS (SELECT firm, e, row_number() OVER (ORDER BY firm) AS i, row_number() OVER (ORDER BY {h('concat(CAST(firm AS VARCHAR), chr(124), chr(112))')}, firm) AS j FROM ({ACC})) SELECT a.firm, round(b.e, 6) AS permuted FROM k a JOIN k b ON a.i = b.j")
def permuted_column(t, spark):
    from ..operators.generation import permuted

    g = t("customer").select(F.col("c_custkey").alias("firm"), S.uniform("c_custkey", F.lit("lev")).alias("e"))
    return permuted(g, "firm", "e", "p").select("firm", r6("permuted").alias("permuted"))


@query(f"SELECT CAST(i AS BIGINT) AS i, CAST(i % 4 AS BIGINT) AS rank, round({uq('i', 's7')}, 6) AS x FROM range(0, 200) r(i)")
def deterministic_task_stream(t, spark):
    from ..operators.generation import task_stream

    return task_stream(spark, 0, 200, world=4, seed="s7").select("i", "rank", r6("x").alias("x"))


@query(None)
def generated_tables(t, spark):
    """Tables of a layered random graph with labels at a target rate, one task a table."""
    from ..operators.generation import scm_tables

    return scm_tables(spark, tasks=16, rows=64, features=6, seed=11)
