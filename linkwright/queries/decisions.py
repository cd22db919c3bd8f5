"""Decision, evaluation and context queries over scored pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkwright.operators import context, decision, evaluate, sampling, shift
from linkwright.queries.tables import CHANNELS_SQL, channels, read, rounded, scored, scored_sql
from linkwright.sources import sinks

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


P, S = scored_sql(), scored_sql("l_suppkey")
EXCLUSIVE = "x AS (SELECT * FROM (SELECT *, max(prob) OVER (PARTITION BY p) AS top FROM {src}) WHERE prob >= top)"


def expected_sql(src: str, miss: float, name: str = "ef", claim_once: bool = True) -> str:
    """CTEs that end in ``name``: the expected-F selection over ``src``."""
    claimed = f"SELECT * FROM (SELECT *, max(prob) OVER (PARTITION BY p) AS top FROM {src} WHERE prob >= 0.05) WHERE prob >= top" if claim_once else f"SELECT * FROM {src} WHERE prob >= 0.05"
    return f"""{name}_a AS ({claimed}),
      {name}_b AS (SELECT *, row_number() OVER w AS k, sum(prob) OVER (w ROWS UNBOUNDED PRECEDING) AS hits, sum(prob) OVER (PARTITION BY q) AS total,
          exp(sum(ln(1 - least(prob, 1 - 1e-9))) OVER (PARTITION BY q)) AS p_empty FROM {name}_a WINDOW w AS (PARTITION BY q ORDER BY prob DESC, p)),
      {name}_c AS (SELECT *, 1.25 * hits / (k + 0.25 * (total + {miss})) AS f FROM {name}_b),
      {name}_d AS (SELECT *, max(f) OVER (PARTITION BY q) AS best FROM {name}_c),
      {name}_e AS (SELECT *, min(CASE WHEN f >= best - 1e-12 THEN k END) OVER (PARTITION BY q) AS stop FROM {name}_d),
      {name} AS (SELECT q, p, prob, y, num_agree FROM {name}_e WHERE k <= stop AND best > p_empty)"""


@query(f"WITH {P}, {EXCLUSIVE.format(src='pairs')} SELECT q, p, prob FROM x")
def exclusive_claims(spark, sf_dir):
    return decision.exclusive(scored(spark, sf_dir)).select("q", "p", "prob")


@query(f"WITH {P}, sure AS (SELECT * FROM pairs WHERE prob >= 0.5), {EXCLUSIVE.format(src='sure')} SELECT q, p, prob FROM x")
def threshold_policy(spark, sf_dir):
    return decision.threshold_policy(scored(spark, sf_dir), 0.5).select("q", "p", "prob")


@query(f"WITH {P} SELECT q, p, prob FROM pairs WHERE prob >= 0.5")
def threshold_shared(spark, sf_dir):
    return decision.threshold_policy(scored(spark, sf_dir), 0.5, claim_once=False).select("q", "p", "prob")


@query(f"WITH {S}, {expected_sql('pairs', 0.0)} SELECT q, p, prob FROM ef")
def expected_f_policy(spark, sf_dir):
    return decision.expected_f_policy(scored(spark, sf_dir, "l_suppkey")).select("q", "p", "prob")


@query(f"WITH {S}, {expected_sql('pairs', 0.3)}, g AS (SELECT q, max(prob) AS top FROM pairs GROUP BY q) SELECT q, p, prob FROM ef JOIN g USING (q) WHERE top >= 0.6")
def gated_expected_f_policy(spark, sf_dir):
    return decision.gated_expected_f_policy(scored(spark, sf_dir, "l_suppkey"), 0.6, 0.3).select("q", "p", "prob")


@query(f"""WITH {S}, {expected_sql('pairs', 0.3)}, g AS (SELECT q, max(prob) AS top FROM pairs GROUP BY q),
  u AS (SELECT q, p, prob FROM pairs WHERE prob >= 0.9 UNION SELECT q, p, prob FROM ef JOIN g USING (q) WHERE top >= 0.6 AND num_agree = 1), {EXCLUSIVE.format(src='u')}
  SELECT q, p, prob FROM x""")
def conditional_policy(spark, sf_dir):
    return decision.conditional_policy(scored(spark, sf_dir, "l_suppkey")).select("q", "p", "prob")


@query(f"WITH {P}, " + ", ".join(f"t{i} AS (SELECT * FROM (SELECT *, max(prob) OVER (PARTITION BY p) AS top FROM pairs WHERE prob >= {t}) WHERE prob >= top)" for i, t in enumerate((0.3, 0.5, 0.7, 0.9)))
       + " SELECT policy, count(*) AS n_pairs, count(DISTINCT q) AS n_queries FROM (" + " UNION ALL ".join(f"SELECT 'thr{t}' AS policy, q FROM t{i}" for i, t in enumerate((0.3, 0.5, 0.7, 0.9))) + ") GROUP BY 1")
def policy_sweep(spark, sf_dir):
    own = {k: v for k, v in decision.policies().items() if k in ("thr0.3", "thr0.5", "thr0.7", "thr0.9")}
    return decision.sweep(scored(spark, sf_dir), own).groupBy("policy").agg(F.count("*").alias("n_pairs"), F.countDistinct("q").alias("n_queries"))


@query(f"""WITH {P}, sure AS (SELECT * FROM pairs WHERE prob >= 0.7), {EXCLUSIVE.format(src='sure')},
  s AS (SELECT q, string_agg(p, ',' ORDER BY p::VARCHAR) AS ids FROM (SELECT DISTINCT q, p::VARCHAR AS p FROM x) GROUP BY q)
  SELECT o_orderkey AS q_id, coalesce(ids, '') AS ids FROM orders LEFT JOIN s ON q = o_orderkey""")
def match_sets(spark, sf_dir):
    chosen = decision.threshold_policy(scored(spark, sf_dir), 0.7).select(F.col("q").alias("q_id"), F.col("p").cast("string").alias("p_id"))
    queries = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q_id"), F.col("o_orderkey").alias("position"))
    return sinks.set_rows(chosen, queries).select("q_id", "ids")


def _planted(rows, drop, twice, stranger, repeat, unknown):
    """Set rows of queries, with violations by key: no row, two rows, no such query, an id twice, an id of no record."""
    q = F.col("q_id")
    ids = F.when((q % repeat == 0) & (F.col("ids") != ""), F.concat("ids", F.lit(","), "ids")).otherwise(F.col("ids"))
    ids = F.when(q % unknown == 0, F.concat(ids, F.lit(",999999999"))).otherwise(ids)
    own = rows.where(q % drop != 0).select("q_id", ids.alias("ids"))
    return own.unionByName(own.where(q % twice == 0)).unionByName(own.where(q % stranger == 0).select((-q).alias("q_id"), "ids"))


def _planted_sql(name: str, chosen: str, drop: int, twice: int, stranger: int, repeat: int, unknown: int) -> str:
    return f"""{name}0 AS (SELECT o_orderkey AS q_id, coalesce(ids, '') AS ids FROM orders LEFT JOIN (SELECT q, string_agg(p, ',' ORDER BY p) AS ids FROM (SELECT DISTINCT q, p::VARCHAR AS p FROM ({chosen})) GROUP BY q) ON q = o_orderkey),
      {name}1 AS (SELECT q_id, CASE WHEN q_id % {repeat} = 0 AND ids <> '' THEN ids || ',' || ids ELSE ids END || CASE WHEN q_id % {unknown} = 0 THEN ',999999999' ELSE '' END AS ids FROM {name}0 WHERE q_id % {drop} <> 0),
      {name} AS (SELECT * FROM {name}1 UNION ALL SELECT * FROM {name}1 WHERE q_id % {twice} = 0 UNION ALL SELECT -q_id, ids FROM {name}1 WHERE q_id % {stranger} = 0),
      {name}e AS (SELECT q_id, unnest(list_filter(string_split(ids, ','), lambda t: t <> '')) AS p_id FROM {name})"""


MATCH_PLANTS, CANDIDATE_PLANTS = (97, 89, 83, 79, 73), (101, 103, 107, 109, 113)


def _contract_sql() -> str:
    rows = []
    for rule, t in (("match", "m"), ("candidate", "c")):
        rows += [
            f"SELECT '{rule}: query without a row' AS rule, count(*) AS violations FROM orders WHERE o_orderkey NOT IN (SELECT q_id FROM {t})", f"SELECT '{rule}: row without a query', count(*) FROM {t} WHERE q_id NOT IN (SELECT o_orderkey FROM orders)",
            f"SELECT '{rule}: query twice', count(*) FROM (SELECT q_id FROM {t} GROUP BY 1 HAVING count(*) > 1)", f"SELECT '{rule}: id twice', count(*) FROM (SELECT q_id, p_id FROM {t}e GROUP BY 1, 2 HAVING count(*) > 1)",
            f"SELECT '{rule}: id not in the pool', count(*) FROM {t}e WHERE p_id NOT IN (SELECT p_partkey::VARCHAR FROM part)",
        ]
    rows.append("SELECT 'match: not among the candidates', count(*) FROM me WHERE (q_id, p_id) NOT IN (SELECT (q_id, p_id) FROM ce)")
    return f"WITH {P}, {_planted_sql('m', 'SELECT q, p FROM pairs WHERE prob >= 0.3', *MATCH_PLANTS)}, {_planted_sql('c', 'SELECT q, p FROM pairs WHERE (q + p) % 11 <> 0', *CANDIDATE_PLANTS)} " + " UNION ALL ".join(rows)


@query(_contract_sql())
def contract_check(spark, sf_dir):
    """Output tables with every kind of violation, and how often the contract finds each."""
    pairs = scored(spark, sf_dir).select(F.col("q").alias("q_id"), F.col("p").cast("string").alias("p_id"), "prob", "q", "p")
    queries = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q_id"), F.col("o_orderkey").alias("position"))
    pool = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("p_id"))
    matches = _planted(sinks.set_rows(pairs.where("prob >= 0.3"), queries), *MATCH_PLANTS)
    return sinks.contract(matches, _planted(sinks.set_rows(pairs.where("(q + p) % 11 <> 0"), queries), *CANDIDATE_PLANTS), queries, pool)


@query(f"WITH {S} SELECT q, p, prob FROM pairs WHERE prob >= 0.5 AND NOT (prob >= 0.8 AND y >= 0.8 AND num_agree = 1)")
def near_copy_veto(spark, sf_dir):
    return decision.veto(scored(spark, sf_dir, "l_suppkey").where("prob >= 0.5"), "prob", "y", "num_agree", 0.8).select("q", "p", "prob")


def _context_sql(scores: list[str]) -> str:
    columns = ["q", "p"]
    for s in scores:
        columns += [f"row_number() OVER (PARTITION BY q ORDER BY {s} DESC, p) AS {s}_rank_q", f"round(max({s}) OVER (PARTITION BY q), 6) AS {s}_max_q", f"round(max({s}) OVER (PARTITION BY q) - {s}, 6) AS {s}_gap_q", f"row_number() OVER (PARTITION BY p ORDER BY {s} DESC, q) AS {s}_rank_p", f"round(max({s}) OVER (PARTITION BY p) - {s}, 6) AS {s}_gap_p"]
    return f"WITH {CHANNELS_SQL} SELECT {', '.join(columns)}, count(*) OVER (PARTITION BY q) AS n_cand_q, count(*) OVER (PARTITION BY p) AS n_cand_p FROM ch"


@query(_context_sql(["s_price", "s_quantity", "s_combo"]))
def context_features(spark, sf_dir):
    out = context.context_features(channels(spark, sf_dir), ["s_price", "s_quantity", "s_combo"])
    return rounded(out.drop("y", "s_price", "s_quantity", "s_combo"))


@query(f"""WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY prob DESC, q) AS prob_rank_p, row_number() OVER (PARTITION BY q ORDER BY prob DESC, p) AS prob_rank_q FROM pairs)
  SELECT q, p, prob_rank_q, round(max(prob) OVER (PARTITION BY q), 6) AS prob_max_q, round(max(prob) OVER (PARTITION BY q) - prob, 6) AS prob_gap_q, round(sum(prob) OVER (PARTITION BY q), 6) AS prob_sum_q,
    count(*) FILTER (WHERE prob >= 0.5) OVER (PARTITION BY q) AS n_conf_q, count(*) FILTER (WHERE prob >= 0.9) OVER (PARTITION BY q) AS n_conf90_q,
    round(coalesce(CASE WHEN prob_rank_p = 1 THEN max(CASE WHEN prob_rank_p = 2 THEN prob END) OVER (PARTITION BY p) ELSE max(prob) OVER (PARTITION BY p) END, -1.0), 6) AS other_best_p,
    prob_rank_p, count(*) FILTER (WHERE prob >= 0.5) OVER (PARTITION BY p) AS n_conf_p FROM r""")
def profile_features(spark, sf_dir):
    return rounded(context.profile_features(scored(spark, sf_dir, "l_suppkey")).drop("prob", "y", "num_agree"))


@query(f"""WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY prob DESC, p) AS r FROM pairs) SELECT q, p, prob FROM r WHERE prob >= 0.01 AND r <= 2""")
def undecided_pairs(spark, sf_dir):
    return context.undecided(scored(spark, sf_dir), "prob", most=2).select("q", "p", "prob")


@query(f"WITH {S} SELECT q, p, prob FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY prob DESC, q) AS r FROM pairs) WHERE r = 2")
def second_claims(spark, sf_dir):
    return context.nth(scored(spark, sf_dir, "l_suppkey"), "p", "prob", 2, "q").select("q", "p", "prob")


@query(f"""WITH {P}, sure AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY prob DESC, p) AS r FROM pairs WHERE prob >= 0.3) WHERE r <= 6),
  met AS (SELECT a.q, a.p, s.prob AS prob_other, a.p % 7 = s.p % 7 AS same_num, (x.p_brand = z.p_brand) AS same_src,
      100.0 * len(list_intersect(string_split(x.p_name, ' '), string_split(z.p_name, ' '))) / len(list_distinct(string_split(x.p_name, ' ') || string_split(z.p_name, ' '))) AS n_sim,
      CASE WHEN x.p_type = z.p_type THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS a_sim
    FROM pairs a JOIN sure s ON a.q = s.q AND a.p <> s.p JOIN part x ON x.p_partkey = a.p JOIN part z ON z.p_partkey = s.p),
  g AS (SELECT q, p, max(n_sim) AS sib_name_max, avg(n_sim) AS sib_name_mean, max(a_sim) AS sib_addr_max, avg(a_sim) AS sib_addr_mean, max(least(n_sim, a_sim)) AS sib_both_max,
      max(prob_other * greatest(least(n_sim, a_sim), 0) / 100) AS sib_wboth_max, max(same_num::INT::DOUBLE) AS sib_same_num, avg(same_src::INT) AS sib_same_src, count(*) AS n_sibs FROM met GROUP BY q, p)
  SELECT q, p, round(coalesce(sib_name_max, -1), 6) AS sib_name_max, round(coalesce(sib_name_mean, -1), 6) AS sib_name_mean, round(coalesce(sib_addr_max, -1), 6) AS sib_addr_max,
    round(coalesce(sib_addr_mean, -1), 6) AS sib_addr_mean, round(coalesce(sib_both_max, -1), 6) AS sib_both_max, round(coalesce(sib_wboth_max, -1), 6) AS sib_wboth_max,
    round(coalesce(sib_same_num, -1), 6) AS sib_same_num, round(coalesce(sib_same_src, -1), 6) AS sib_same_src, coalesce(n_sibs, 0) AS n_sibs FROM pairs LEFT JOIN g USING (q, p)""")
def sibling_support(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("name"), F.col("p_type").alias("addr"), (F.col("p_partkey") % 7).cast("string").alias("first_num"), F.col("p_brand").alias("src"))

    def shared(a, b):
        x, y = F.split(a, " "), F.split(b, " ")
        return 100.0 * F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))

    found = context.sibling_support(scored(spark, sf_dir), parts, shared, lambda a, b: F.when(a == b, 100.0).otherwise(0.0), least=0.3)
    return rounded(found.drop("prob", "y", "num_agree"))


TRUE = "t AS (SELECT DISTINCT q, p FROM pairs WHERE y = 1)"
PER_QUERY = """pq AS (SELECT o_orderkey AS q, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp FROM orders LEFT JOIN (
      SELECT coalesce(a.q, b.q) AS q, count(a.q) AS n_pred, count(b.q) AS n_true, count(a.q + b.q) AS tp FROM x a FULL JOIN t b ON a.q = b.q AND a.p = b.p GROUP BY 1) s ON s.q = o_orderkey),
  f AS (SELECT *, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END AS f,
      CASE WHEN n_pred > 0 THEN tp / n_pred WHEN n_true = 0 THEN 1.0 ELSE 0.0 END AS prec, CASE WHEN n_true > 0 THEN tp / n_true ELSE 1.0 END AS rec FROM pq)"""
REPORT = """count(*) AS n_queries, round(avg(f), 6) AS macro_f05, round(avg(prec), 6) AS precision, round(avg(rec), 6) AS recall,
  round(avg(CASE WHEN n_true = 0 THEN (n_pred = 0)::INT END), 6) AS singleton_accuracy, round(avg(CASE WHEN n_true > 0 THEN f END), 6) AS nonsingleton_f05,
  sum(n_pred - tp)::BIGINT AS false_merges, sum(n_true - tp)::BIGINT AS missed, round(avg((n_pred = tp AND n_true = tp)::INT), 6) AS exact_sets"""
CHOSEN = f"{P}, sure AS (SELECT * FROM pairs WHERE prob >= 0.5), {EXCLUSIVE.format(src='sure')}, {TRUE}, {PER_QUERY}"


def _evaluated(spark, sf_dir, threshold=0.5, claim_once=True):
    pairs = scored(spark, sf_dir)
    queries = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"))
    return evaluate.per_query(decision.threshold_policy(pairs, threshold, claim_once=claim_once), pairs.where("y = 1"), queries)


@query(f"WITH {CHOSEN} SELECT {REPORT} FROM f")
def f05_report(spark, sf_dir):
    return rounded(evaluate.report(_evaluated(spark, sf_dir)))


@query(f"WITH {CHOSEN} SELECT q % 5 AS fold, {REPORT} FROM f GROUP BY 1")
def f05_by_fold(spark, sf_dir):
    return rounded(evaluate.report(_evaluated(spark, sf_dir).withColumn("fold", F.col("q") % 5), ["fold"]))


@query(f"WITH {CHOSEN}, g AS (SELECT q % 5 AS fold, avg(f) AS f FROM f GROUP BY 1) SELECT round(avg(f), 6) AS mean_f05, round(stddev_pop(f), 6) AS std_f05 FROM g")
def f05_fold_spread(spark, sf_dir):
    return rounded(evaluate.fold_report(_evaluated(spark, sf_dir).withColumn("fold", F.col("q") % 5)))


@query(f"WITH {CHOSEN} SELECT o_orderpriority AS subset, CASE WHEN n_true = 0 THEN 'singleton' WHEN n_true = 1 THEN 'one' ELSE 'many' END AS kind, {REPORT} FROM f JOIN orders ON o_orderkey = q GROUP BY 1, 2")
def f05_subsets(spark, sf_dir):
    subset = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("subset"))
    kind = evaluate.cascade([("singleton", F.col("n_true") == 0), ("one", F.col("n_true") == 1)], "many")
    return rounded(evaluate.report(_evaluated(spark, sf_dir).join(subset, "q").withColumn("kind", kind), ["subset", "kind"]))


@query(f"WITH {P}, {TRUE}, c AS (SELECT q, p FROM pairs WHERE prob >= 0.2) SELECT round(count(c.q) / count(*), 6) AS candidate_recall FROM t LEFT JOIN c ON c.q = t.q AND c.p = t.p")
def candidate_recall(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    return rounded(evaluate.candidate_recall(pairs.where("prob >= 0.2"), pairs.where("y = 1")))


def _oracle_sql() -> str:
    score = """(SELECT avg(CASE WHEN coalesce(n_pred, 0) = 0 AND coalesce(n_true, 0) = 0 THEN 1.0 WHEN coalesce(tp, 0) = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END)
      FROM orders LEFT JOIN (SELECT coalesce(a.q, b.q) AS q, count(a.q) AS n_pred, count(b.q) AS n_true, count(a.q + b.q) AS tp FROM {v} a FULL JOIN t b ON a.q = b.q AND a.p = b.p GROUP BY 1) s ON s.q = o_orderkey)"""
    variants = {
        "as_is": "SELECT q, p FROM x", "perfect": "SELECT q, p FROM c SEMI JOIN t USING (q, p)",
        "drop_unowned": "SELECT q, p FROM x WHERE (q, p) IN (SELECT (q, p) FROM t) OR p IN (SELECT p FROM o)",
        "drop_owned": "SELECT q, p FROM x WHERE (q, p) IN (SELECT (q, p) FROM t) OR p NOT IN (SELECT p FROM o)",
        "add_candidates": "SELECT q, p FROM x UNION SELECT q, p FROM c SEMI JOIN t USING (q, p)", "add_unretrieved": "SELECT q, p FROM x UNION SELECT q, p FROM t ANTI JOIN c USING (q, p)",
    }
    ctes = ", ".join(f"v_{k} AS ({v})" for k, v in variants.items())
    rows = " UNION ALL ".join(f"SELECT '{k}' AS variant, round({score.format(v='v_' + k)}, 6) AS macro_f05" for k in variants)
    return f"WITH {P}, c AS (SELECT q, p, prob FROM pairs WHERE prob >= 0.3), {TRUE}, o AS (SELECT DISTINCT p FROM t WHERE p % 3 = 0), sure AS (SELECT * FROM pairs WHERE prob >= 0.6), {EXCLUSIVE.format(src='sure')}, {ctes} {rows}"


@query(_oracle_sql())
def oracle_losses(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    truth, queries = pairs.where("y = 1"), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"))
    return rounded(evaluate.oracle_losses(pairs.where("prob >= 0.3"), decision.threshold_policy(pairs, 0.6), truth, truth.where("p % 3 = 0"), queries))


@query("""WITH e AS (SELECT *, CASE WHEN o_totalprice < 50000 THEN 1 ELSE 0 END AS p_a_empty, o_totalprice / 4000 % 101 AS n_tset, o_totalprice / 900 % 101 AS a_tset,
    (o_orderstatus = 'P')::INT AS p_n_indic, (o_orderkey % 9 = 0)::INT AS p_n_is_domain, o_totalprice / 70 % 101 AS n_skel_ratio, o_totalprice / 30 % 101 AS n_ratio FROM orders)
  SELECT CASE WHEN p_a_empty = 1 THEN 'missing address' WHEN n_tset >= 90 AND a_tset < 70 THEN 'same name, other address' WHEN n_tset < 50 AND a_tset >= 85 THEN 'renamed at the address' WHEN p_n_indic = 1 THEN 'transliteration'
    WHEN p_n_is_domain = 1 THEN 'domain name' WHEN n_skel_ratio >= 90 AND n_ratio < 90 THEN 'typo' WHEN a_tset < 85 THEN 'address variation' ELSE 'other' END AS error, count(*) AS n FROM e GROUP BY 1""")
def error_taxonomy(spark, sf_dir):
    price = F.col("o_totalprice")
    rows = read(spark, sf_dir, "orders").select(
        (price < 50000).cast("int").alias("p_a_empty"), (price / 4000 % 101).alias("n_tset"), (price / 900 % 101).alias("a_tset"), (F.col("o_orderstatus") == "P").cast("int").alias("p_n_indic"),
        (F.col("o_orderkey") % 9 == 0).cast("int").alias("p_n_is_domain"), (price / 70 % 101).alias("n_skel_ratio"), (price / 30 % 101).alias("n_ratio"),
    )
    return rows.groupBy(evaluate.error_type().alias("error")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def crosstab_margins(spark, sf_dir):
    return evaluate.margins(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query(f"WITH {S}, b AS (SELECT floor(least(prob * 15, 14)) AS bin, count(*) AS n, abs(avg(prob) - avg(y)) AS gap FROM pairs GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b")
def calibration_error(spark, sf_dir):
    return rounded(evaluate.calibration_error(scored(spark, sf_dir, "l_suppkey")))


@query(f"WITH {S}, b AS (SELECT num_agree, floor(least(prob * 15, 14)) AS bin, count(*) AS n, abs(avg(prob) - avg(y)) AS gap FROM pairs GROUP BY 1, 2) SELECT num_agree, round(sum(n * gap) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b GROUP BY 1")
def calibration_by_stratum(spark, sf_dir):
    return rounded(evaluate.calibration_error(scored(spark, sf_dir, "l_suppkey"), ["num_agree"]))


@query(f"""WITH {P}, e AS (SELECT q, exp(sum(ln(1 - least(prob, 1 - 1e-9)))) AS p_empty, max(y) AS anyone FROM pairs GROUP BY q)
  SELECT CASE WHEN p_empty <= 0.05 THEN 0 WHEN p_empty <= 0.2 THEN 1 WHEN p_empty <= 0.5 THEN 2 WHEN p_empty <= 0.8 THEN 3 WHEN p_empty <= 0.95 THEN 4 ELSE 5 END AS band,
    count(*) AS n, round(avg(p_empty), 6) AS predicted, round(avg((anyone = 0)::INT), 6) AS actual FROM e GROUP BY 1""")
def empty_set_calibration(spark, sf_dir):
    return rounded(evaluate.empty_calibration(scored(spark, sf_dir)))


@query(f"""WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY prob DESC, q) AS r FROM pairs), g AS (SELECT p, sum(prob) AS s, max(CASE WHEN r = 2 THEN prob END) AS second FROM r GROUP BY p)
  SELECT count(*) AS n, round(avg(s), 6) AS mean_sum, round(avg((s > 1)::INT), 6) AS over_one, round(avg(second), 6) AS mean_second FROM g""")
def claim_coherence(spark, sf_dir):
    return rounded(evaluate.coherence(scored(spark, sf_dir, "l_suppkey")))


@query("""WITH r AS (SELECT l_returnflag AS grp, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS ra,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS rb FROM lineitem) SELECT grp, round(corr(ra, rb), 6) AS rho FROM r GROUP BY 1""")
def rank_correlation(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "grp")
    return rounded(evaluate.spearman(items, "l_quantity", "l_extendedprice", "grp"))


@query(f"""WITH {S}, c AS (SELECT prob, sum(y) AS pos, count(*) - sum(y) AS neg FROM pairs GROUP BY prob), b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
  SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM b""")
def exact_auc(spark, sf_dir):
    return rounded(evaluate.auc(scored(spark, sf_dir, "l_suppkey")))


@query("""SELECT count(*) AS n, count(DISTINCT p_name) AS n_distinct, count(*) FILTER (WHERE length(coalesce(p_name, '')) = 0) AS n_empty, round(avg(length(p_name)), 6) AS mean_length,
  quantile_cont(length(p_name), 0.5)::DOUBLE AS length_p50, quantile_cont(length(p_name), 0.9)::DOUBLE AS length_p90, round(quantile_cont(length(p_name), 0.99)::DOUBLE, 6) AS length_p99 FROM part""")
def column_profile(spark, sf_dir):
    return rounded(evaluate.profile(read(spark, sf_dir, "part"), "p_name"))


@query(f"WITH {P}, {TRUE}, s AS (SELECT o_orderkey, count(t.q) AS size FROM orders LEFT JOIN t ON t.q = o_orderkey GROUP BY 1) SELECT size, count(*) AS n FROM s GROUP BY 1")
def truth_structure(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    return evaluate.truth_structure(pairs.where("y = 1").select("q", "p"), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q")))


@query(f"WITH {P}, {TRUE} SELECT p, count(DISTINCT q) AS n FROM t GROUP BY p HAVING count(DISTINCT q) > 1")
def owners_twice(spark, sf_dir):
    return evaluate.owners_twice(scored(spark, sf_dir).where("y = 1"))


@query(f"""WITH {P}, {TRUE}, d AS (SELECT * FROM pairs WHERE prob >= 0.5),
  s1 AS (SELECT * FROM (SELECT *, max(prob) OVER (PARTITION BY p) AS top FROM d) WHERE prob >= top),
  sc AS (SELECT o_orderkey AS q, {{0}} AS f0, {{1}} AS f1 FROM orders LEFT JOIN (SELECT coalesce(a.q, b.q) AS q, count(a.q) AS np0, count(b.q) AS nt0, count(a.q + b.q) AS tp0 FROM d a FULL JOIN t b ON a.q = b.q AND a.p = b.p GROUP BY 1) x0 ON x0.q = o_orderkey
    LEFT JOIN (SELECT coalesce(a.q, b.q) AS q, count(a.q) AS np1, count(b.q) AS nt1, count(a.q + b.q) AS tp1 FROM s1 a FULL JOIN t b ON a.q = b.q AND a.p = b.p GROUP BY 1) x1 ON x1.q = o_orderkey)
  SELECT CASE WHEN f1 - f0 > 1e-12 THEN 'better' WHEN f1 - f0 < -1e-12 THEN 'worse' ELSE 'same' END AS change, count(*) AS n, round(avg(f1 - f0), 6) AS mean_diff FROM sc GROUP BY 1""".format(*[f"CASE WHEN coalesce(np{i}, 0) = 0 AND coalesce(nt{i}, 0) = 0 THEN 1.0 WHEN coalesce(tp{i}, 0) = 0 THEN 0.0 ELSE 1.25 * (tp{i} / np{i}) * (tp{i} / nt{i}) / (0.25 * (tp{i} / np{i}) + tp{i} / nt{i}) END" for i in (0, 1)]))
def run_comparison(spark, sf_dir):
    return rounded(evaluate.compare_runs(_evaluated(spark, sf_dir, claim_once=False), _evaluated(spark, sf_dir)))


@query(None)
def bootstrap_interval(spark, sf_dir):
    return evaluate.bootstrap(_evaluated(spark, sf_dir, claim_once=False), _evaluated(spark, sf_dir), 200)


@query(f"""WITH {S}, b AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY prob DESC, q) AS r FROM pairs)
  SELECT q, p, CASE WHEN prob >= 0.8 AND r = 1 THEN 1 WHEN prob <= 0.1 THEN 0 ELSE -1 END AS pseudo FROM b""")
def pseudo_labels(spark, sf_dir):
    return sampling.pseudo_labels(scored(spark, sf_dir, "l_suppkey"), high=0.8, low=0.1).select("q", "p", "pseudo")


HEX = "('0x' || substr(md5({t}), {i}, 8))::BIGINT"


def md5_mod_sql(text: str, m: int) -> str:
    """md5 modulo m from 32-bit quarters."""
    step, out = pow(16, 8, m), "0"
    for i in range(4):
        out = f"(({out}) * {step} + {HEX.format(t=text, i=8 * i + 1)}) % {m}"
    return f"({out})"


@query(f"WITH {P} SELECT q, p FROM pairs WHERE {md5_mod_sql('q::VARCHAR || ' + chr(39) + '#0' + chr(39), 10000)} < 3000")
def group_subsample(spark, sf_dir):
    return sampling.keep_groups(scored(spark, sf_dir), "q", 0.3).select("q", "p")


@query(f"""WITH {P}, u AS (SELECT q, p, prob FROM pairs WHERE prob > 0.02 AND prob < 0.98 ORDER BY md5(q::VARCHAR || '|' || p::VARCHAR || '|0') LIMIT 140),
  c AS (SELECT q, p, prob FROM pairs WHERE NOT (prob > 0.02 AND prob < 0.98) ORDER BY md5(q::VARCHAR || '|' || p::VARCHAR || '|0') LIMIT (SELECT 200 - count(*) FROM u)) SELECT * FROM u UNION ALL SELECT * FROM c""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(scored(spark, sf_dir), 200, "prob").select("q", "p", "prob")


@query(f"""WITH {S} SELECT q, p, round(a * c / (a * c + b * (1 - c)), 6) AS prob FROM (SELECT q, p, greatest(least(prob, 1 - 1e-7), 1e-7) AS c, (0.2 + 0.1 * num_agree) / 0.3 AS a, (1 - (0.2 + 0.1 * num_agree)) / 0.7 AS b FROM pairs)""")
def prior_reweight(spark, sf_dir):
    pairs = scored(spark, sf_dir, "l_suppkey")
    return rounded(pairs.select("q", "p", shift.reweight(F.col("prob"), F.lit(0.3), 0.2 + 0.1 * F.col("num_agree")).alias("prob")))


@query(f"WITH {S}, o AS (SELECT q, p, c / (1 - c) * ((1 - 0.4) / (1 - 0.2)) / (0.4 / 0.2) AS odds FROM (SELECT q, p, greatest(least(prob, 1 - 1e-7), 1e-7) AS c FROM pairs)) SELECT q, p, round(odds / (1 + odds), 6) AS prob FROM o")
def odds_correction(spark, sf_dir):
    return rounded(scored(spark, sf_dir, "l_suppkey").select("q", "p", shift.correct_odds(F.col("prob"), F.lit(0.2), F.lit(0.4)).alias("prob")))


# Two hundred rounds over all rows; a round that changes little changes nothing in six places.
@query(f"""WITH RECURSIVE {S}, c AS (SELECT num_agree, greatest(least(prob, 1 - 1e-7), 1e-7) AS p FROM pairs),
  em(num_agree, round_, pi) AS (SELECT DISTINCT num_agree, 0, 0.3::DOUBLE FROM c UNION ALL
    SELECT num_agree, round_ + 1, new FROM (SELECT em.num_agree, round_, pi, (SELECT avg(pi / 0.3 * p / (pi / 0.3 * p + (1 - pi) / 0.7 * (1 - p))) FROM c WHERE c.num_agree = em.num_agree) AS new FROM em) WHERE round_ < 200)
  SELECT num_agree, round(pi, 4) AS prior FROM em WHERE round_ = 200""")
def em_prior(spark, sf_dir):
    return rounded(shift.em_prior(scored(spark, sf_dir, "l_suppkey"), "num_agree", 0.3), 4)


@query("""WITH c AS (SELECT l_linestatus AS grp, CASE WHEN l_quantity > 5 THEN (l_quantity > 20)::INT END AS differs, (l_discount > 0.06)::INT AS extra FROM lineitem),
  r AS (SELECT grp, avg(differs) AS d, avg(extra) AS e FROM c GROUP BY 1 UNION ALL SELECT 'ALL', avg(differs), avg(extra) FROM c)
  SELECT grp, round(greatest(least(((d - 0.153) / (0.899 - 0.153) + (e - 0.134) / (0.472 - 0.134)) / 2, 0.99), 0.01), 6) AS share FROM r""")
def distractor_share(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("grp"), F.when(F.col("l_quantity") > 5, (F.col("l_quantity") > 20).cast("int")).alias("differs"), (F.col("l_discount") > 0.06).cast("int").alias("extra"))
    return rounded(shift.distractor_share(rows, "grp"))
