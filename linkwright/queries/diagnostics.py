"""Queries of the diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkwright.operators import blocking, decision, diagnostics
from linkwright.queries.decisions import CHOSEN, EXCLUSIVE, P, S, TRUE, _evaluated, md5_mod_sql
from linkwright.queries.tables import CHANNELS_SQL, channels, read, rounded, scored

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_orderstatus").alias("grp"))


@query(f"WITH {P}, c AS (SELECT o_orderkey AS q, count(pairs.q) AS copies FROM orders LEFT JOIN pairs ON pairs.q = o_orderkey AND prob >= 0.6 GROUP BY 1) SELECT copies, count(*) AS n_queries FROM c GROUP BY 1")
def near_copy_counts(spark, sf_dir):
    return diagnostics.near_copy_counts(scored(spark, sf_dir), F.col("prob") >= 0.6, _orders(spark, sf_dir).select("q"))


@query("""SELECT l_returnflag = 'R' AS owned, count(*) AS n, round(avg((l_quantity > 20)::INT), 6) AS same_name, round(avg((l_discount > 0.05)::INT), 6) AS extra_token, round(avg((l_tax > 0.04)::INT), 6) AS lacks_token,
  round(avg(CASE WHEN l_linenumber > 1 THEN (l_linestatus = 'F')::INT END), 6) AS numbers_differ FROM lineitem GROUP BY 1""")
def near_copy_profile(spark, sf_dir):
    c = F.col
    rows = read(spark, sf_dir, "lineitem").select((c("l_returnflag") == "R").alias("owned"), (c("l_quantity") > 20).alias("same_name"), (c("l_discount") > 0.05).alias("extra_token"), (c("l_tax") > 0.04).alias("lacks_token"), F.when(c("l_linenumber") > 1, c("l_linestatus") == "F").alias("numbers_differ"))
    return rounded(diagnostics.near_copy_profile(rows))


@query(f"WITH {P}, q AS (SELECT q, max(prob) AS top, count(*) FILTER (WHERE prob >= 0.5) AS likely FROM pairs GROUP BY q) SELECT o_orderstatus AS grp, count(*) AS n, round(avg(top), 6) AS mean_top, round(avg((top >= 0.9)::INT), 6) AS sure, round(avg((top < 0.5)::INT), 6) AS hopeless, round(avg(likely), 6) AS mean_likely FROM q JOIN orders ON o_orderkey = q GROUP BY 1")
def confidence_profile(spark, sf_dir):
    return rounded(diagnostics.confidence_profile(scored(spark, sf_dir), _orders(spark, sf_dir)))


@query(f"""WITH {CHOSEN}, b AS (SELECT q, max(prob) AS top FROM pairs GROUP BY q), r AS (SELECT f.*, coalesce(top, 0) AS top FROM f LEFT JOIN b USING (q))
  SELECT CASE WHEN f >= 1 THEN 'none' WHEN n_true = 0 THEN 'false match for an empty set' WHEN n_pred = 0 THEN 'empty for a match' WHEN tp = 0 THEN 'all wrong' WHEN tp = n_true THEN 'too many' ELSE 'too few' END AS kind,
    CASE WHEN top < 0.5 THEN 'below .5' WHEN top < 0.9 THEN '.5 to .9' ELSE 'above .9' END AS band, count(*) AS n, round(sum(1 - f), 6) AS lost FROM r GROUP BY 1, 2""")
def residual_bands(spark, sf_dir):
    return rounded(diagnostics.residual_bands(_evaluated(spark, sf_dir), scored(spark, sf_dir)))


@query("""WITH d AS (SELECT (l_returnflag = 'R')::INT AS y, abs(l_suppkey - l_partkey % 100) AS delta FROM lineitem) SELECT y, count(*) AS n, round(avg((delta = 0)::INT), 6) AS agree,
  quantile_cont(CASE WHEN delta > 0 THEN delta END, 0.25)::DOUBLE AS gap_p25, quantile_cont(CASE WHEN delta > 0 THEN delta END, 0.5)::DOUBLE AS gap_p50, quantile_cont(CASE WHEN delta > 0 THEN delta END, 0.75)::DOUBLE AS gap_p75 FROM d GROUP BY 1""")
def number_deltas(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.abs(F.col("l_suppkey") - F.col("l_partkey") % 100).alias("delta"))
    return rounded(diagnostics.number_deltas(rows))


@query(f"""WITH {CHANNELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s_price DESC, p) AS ra FROM ch), t AS (SELECT q, p FROM ch WHERE y = 1)
  SELECT 'truth' AS stage, count(*) AS kept FROM t UNION ALL SELECT 'retrieved', count(*) FROM t SEMI JOIN (SELECT q, p FROM r WHERE ra <= 200) USING (q, p) UNION ALL SELECT 'kept', count(*) FROM t SEMI JOIN (SELECT q, p FROM r WHERE ra <= 25) USING (q, p)""")
def retrieval_funnel(spark, sf_dir):
    pairs = channels(spark, sf_dir)
    stages = {"retrieved": blocking.top_k(pairs, "s_price", 200), "kept": blocking.top_k(pairs, "s_price", 25)}
    return diagnostics.retrieval_funnel(pairs.where("y = 1"), stages)


@query(f"WITH {S}, k AS (SELECT p_partkey AS p FROM part WHERE p_size > 25) SELECT (k.p IS NOT NULL)::INT AS seen, count(*) AS n, round(avg(((prob >= 0.5) <> (y = 1))::INT), 6) AS error, round(avg(prob), 6) AS mean_prob FROM pairs LEFT JOIN k ON k.p = pairs.p GROUP BY 1")
def seen_unseen(spark, sf_dir):
    return rounded(diagnostics.seen_unseen(scored(spark, sf_dir, "l_suppkey"), read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("p"))))


@query(f"WITH {P}, sure AS (SELECT * FROM pairs WHERE prob >= 0.7), {EXCLUSIVE.format(src='sure')}, n AS (SELECT o_orderkey, o_orderstatus, count(x.q) AS n FROM orders LEFT JOIN x ON x.q = o_orderkey GROUP BY 1, 2) SELECT o_orderstatus AS grp, count(*) AS n_queries, round(avg(n), 6) AS mean_size, round(avg((n = 0)::INT), 6) AS empty FROM n GROUP BY 1")
def set_sizes(spark, sf_dir):
    queries = _orders(spark, sf_dir)
    sets = decision.to_sets(decision.threshold_policy(scored(spark, sf_dir), 0.7), queries.select("q"))
    return rounded(diagnostics.set_sizes(sets, queries))


@query("SELECT l_returnflag, count(*) AS n, round(avg((l_suppkey % 25 = c_nationkey)::INT), 6) AS nation, round(avg((l_linestatus = o_orderstatus)::INT), 6) AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def field_agreement(spark, sf_dir):
    items, orders, customers = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    rows = items.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.select("l_returnflag", (F.col("l_suppkey") % 25).alias("nation_q"), F.col("c_nationkey").alias("nation_p"), F.col("l_linestatus").alias("status_q"), F.col("o_orderstatus").alias("status_p"))
    return rounded(diagnostics.field_agreement(rows, ["nation", "status"], ["l_returnflag"]))


@query(f"WITH {P}, {TRUE} SELECT p_brand AS src, count(*) AS n_links, count(DISTINCT q) AS n_queries FROM t JOIN part ON p_partkey = p GROUP BY 1")
def links_by_source(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("src"))
    return diagnostics.links_by_source(scored(spark, sf_dir).where("y = 1").join(parts, "p"), "src")


@query("WITH r AS (SELECT l_linenumber AS run, avg(l_discount) AS f FROM lineitem GROUP BY 1) SELECT count(*) AS runs, round(avg(f), 6) AS mean_f, round(stddev_samp(f), 6) AS std_f FROM r")
def seed_spread(spark, sf_dir):
    return rounded(diagnostics.seed_spread(read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("run"), F.col("l_discount").alias("f"))))


@query(f"WITH {S}, c AS (SELECT num_agree, y, prob, least(greatest(prob, 1e-7), 1 - 1e-7) AS p FROM pairs) SELECT num_agree, round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, count(*) FILTER (WHERE (prob >= 0.9) <> (y = 1)) AS errors FROM c GROUP BY 1")
def log_loss(spark, sf_dir):
    return rounded(diagnostics.log_loss(scored(spark, sf_dir, "l_suppkey"), ["num_agree"]))


@query(f"WITH {S} SELECT q, p, CASE WHEN prob >= 0.3 THEN prob ELSE prob * 2 END AS feature FROM pairs")
def reused_features(spark, sf_dir):
    pairs = scored(spark, sf_dir, "l_suppkey").select("q", "p", "prob")
    known = pairs.where("prob >= 0.3").withColumnRenamed("prob", "feature")
    compute = lambda missing: missing.join(pairs, ["q", "p"]).withColumn("feature", F.col("prob") * 2)
    return diagnostics.reuse(pairs.select("q", "p"), known, compute)


@query(f"WITH {S} SELECT q, p, q % 5 AS fold FROM pairs WHERE y = 1 AND q % 5 <> 0 ORDER BY md5(q::VARCHAR || '|' || p::VARCHAR || '|0'), q, p LIMIT 2000")
def training_pairs(spark, sf_dir):
    """A sample of a fixed size is the operator itself."""
    pairs = scored(spark, sf_dir, "l_suppkey").where("y = 1").withColumn("fold", F.pmod(F.col("q"), F.lit(5)))
    return diagnostics.training_pairs(pairs, 2000).select("q", "p", "fold")


def _veto_sql() -> str:
    half = f"CASE WHEN {md5_mod_sql('o_orderkey::VARCHAR || ' + chr(39) + '|veto' + chr(39), 2)} = 0 THEN 'select' ELSE 'confirm' END"
    rows = []
    for tau in (0.6, 0.8, 1.1):
        rows.append(f"""SELECT {tau}::DOUBLE AS tau, {half} AS half, round(avg(CASE WHEN coalesce(n_pred, 0) = 0 AND coalesce(n_true, 0) = 0 THEN 1.0 WHEN coalesce(tp, 0) = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END), 6) AS macro_f05
          FROM orders LEFT JOIN (SELECT coalesce(a.q, b.q) AS q, count(a.q) AS n_pred, count(b.q) AS n_true, count(a.q + b.q) AS tp FROM (SELECT * FROM x WHERE prob < {tau}) a FULL JOIN t b ON a.q = b.q AND a.p = b.p GROUP BY 1) s ON s.q = o_orderkey GROUP BY 1, 2""")
    return f"WITH {P}, {TRUE}, sure AS (SELECT * FROM pairs WHERE prob >= 0.5), {EXCLUSIVE.format(src='sure')} " + " UNION ALL ".join(rows)


@query(_veto_sql())
def veto_grid(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    chosen = decision.threshold_policy(pairs, 0.5).withColumn("copy_score", F.col("prob"))
    return rounded(diagnostics.veto_grid(chosen, pairs.where("y = 1"), _orders(spark, sf_dir).select("q"), [0.6, 0.8, 1.1]))


@query("SELECT o_orderpriority, round(avg((o_orderstatus = 'F')::INT), 6) AS F, round(avg((o_orderstatus = 'O')::INT), 6) AS O, round(avg((o_orderstatus = 'P')::INT), 6) AS P FROM orders GROUP BY 1")
def cross_tab(spark, sf_dir):
    return rounded(diagnostics.cross_tab(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]))


@query("WITH b AS (SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 0 WHEN l_quantity > 10 AND l_quantity <= 25 THEN 1 WHEN l_quantity > 25 AND l_quantity <= 45 THEN 2 END AS bin FROM lineitem) SELECT bin, count(*) AS n FROM b GROUP BY 1")
def quantity_bins(spark, sf_dir):
    return diagnostics.binned(read(spark, sf_dir, "lineitem"), "l_quantity", [0, 10, 25, 45]).groupBy("bin").agg(F.count("*").alias("n"))
