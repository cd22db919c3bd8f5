"""Queries of whole plans, models and simulations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from linkwright.config import Channel
from linkwright.functions.hashing import fold_of
from linkwright.operators import blocking, context, decision, evaluate, models, shift, simulate
from linkwright.plans import linkage
from linkwright.queries import raw
from linkwright.queries.decisions import S, md5_mod_sql
from linkwright.queries.tables import channels, read, rounded, scored
from linkwright.queries.texts import BASE_ROWS, FEATURES, _records
from linkwright.session import stage

QUERIES, SQL = {}, {}

#: Words of a document that stand for a name; all others stand for an address.
NAME_WORDS = 6
FLAGSHIP = {"name": Channel({"name": 1.0}, 10), "gram": Channel({"gram": 1.0}, 10), "combo": Channel({"name": 0.5, "addr": 0.5}, 10)}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def document_records(spark, sf_dir):
    """Documents as records: language for country, every fourth a query, first words for name, all others for address."""
    docs = read(spark, sf_dir, "documents")
    words = F.split(F.coalesce("text", F.lit("")), r"\s+", NAME_WORDS + 1)  # the rest stays whole
    return docs.select(
        F.col("doc_id").alias("rid"), F.coalesce("lang", F.lit("")).alias("country"), (F.col("doc_id") % 4 == 0).alias("is_query"), F.when(F.col("doc_id") % 4 == 0, 1).otherwise(2).alias("src"),
        F.array_join(F.slice(words, 1, NAME_WORDS), " ").alias("name"), F.coalesce(F.try_element_at(words, F.lit(NAME_WORDS + 1)), F.lit("")).alias("address"),
    )


@query(f"""WITH {raw.DOCUMENTS_SQL}, long AS (SELECT DISTINCT * FROM ({BASE_ROWS}) WHERE base <> 'conj'), sz AS (SELECT country, count(*) AS n FROM rec GROUP BY 1),
  df AS (SELECT country, base, feature, count(*) AS df FROM long GROUP BY ALL HAVING count(*) BETWEEN 2 AND 10000), idf AS (SELECT long.*, ln(n / df) AS idf FROM long JOIN df USING (country, base, feature) JOIN sz USING (country)),
  wt AS (SELECT *, idf / norm AS w FROM (SELECT *, sqrt(sum(idf * idf) OVER (PARTITION BY rid, base)) AS norm FROM idf) WHERE norm > 0),
  dot AS (SELECT x.rid AS q, z.rid AS p, {', '.join(f"sum(CASE WHEN base = '{b}' THEN x.w * z.w ELSE 0 END) AS d_{b}" for b in ('name', 'addr', 'gram'))} FROM wt x JOIN wt z USING (country, base, feature) WHERE x.is_query AND NOT z.is_query GROUP BY 1, 2),
  s AS (SELECT q, p, round(d_name, 9) AS s1, round(d_gram, 9) AS s2, round(d_name * 0.5 + d_addr * 0.5, 9) AS s3 FROM dot), r AS (SELECT *, {', '.join(f'row_number() OVER (PARTITION BY q ORDER BY s{i} DESC, p) AS r{i}' for i in (1, 2, 3))} FROM s),
  c AS (SELECT q, p, least(greatest(s1, s2, s3), 1) AS prob FROM r WHERE {' OR '.join(f'(r{i} <= 10 AND s{i} > 1e-6)' for i in (1, 2, 3))}),
  x AS (SELECT q, p FROM (SELECT *, max(prob) OVER (PARTITION BY p) AS top FROM c WHERE prob >= 0.6) WHERE prob >= top), g AS (SELECT q, count(*) AS n, string_agg(p::VARCHAR, ',' ORDER BY p) AS ids FROM (SELECT DISTINCT q, p FROM x) GROUP BY q)
  SELECT doc_id AS q, coalesce(n, 0) AS n_matches, coalesce(ids, '') AS matches FROM documents LEFT JOIN g ON g.q = doc_id WHERE doc_id % 4 = 0""")
def linkage_documents(spark, sf_dir):
    """Accepted matches of every query document, empty sets included."""
    sets = linkage.link(document_records(spark, sf_dir), FLAGSHIP, lambda x: decision.threshold_policy(x, 0.6))
    return sets.select("q", F.size("ps").cast("long").alias("n_matches"), F.array_join(F.transform("ps", lambda p: p.cast("string")), ",").alias("matches"))


@query(f"""WITH {FEATURES}, s AS (SELECT q, p, round(d_gram, 6) AS prob FROM dot), k AS (SELECT q, p, prob FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY prob DESC, p) AS r FROM s WHERE prob > 1e-6) WHERE r <= 5),
  x AS (SELECT q, p FROM (SELECT *, max(prob) OVER (PARTITION BY p) AS top FROM k WHERE prob >= 0.6) WHERE prob >= top), g AS (SELECT q, count(*) AS n, string_agg(p::VARCHAR, ',' ORDER BY p) AS ids FROM (SELECT DISTINCT q, p FROM x) GROUP BY q)
  SELECT rid AS q, coalesce(n, 0) AS n_matches, coalesce(ids, '') AS matches FROM rec LEFT JOIN g ON g.q = rid WHERE is_query""")
def linkage_parts(spark, sf_dir):
    """The whole plan on part names with one channel."""
    records = _records(spark, sf_dir)
    best = blocking.candidates(records, {"gram": Channel({"gram": 1.0}, 5)}, digits=6)
    chosen = decision.threshold_policy(best.select("q", "p", F.col("s_gram").alias("prob")), 0.6)
    sets = decision.to_sets(chosen, records.where("is_query").select(F.col("rid").alias("q")))
    return sets.select("q", F.size("ps").cast("long").alias("n_matches"), F.array_join(F.transform("ps", lambda p: p.cast("string")), ",").alias("matches"))


def _model_rows(spark, sf_dir):
    pairs = context.context_features(channels(spark, sf_dir), ["s_price", "s_quantity"])
    return pairs.withColumn("fold", fold_of(F.col("q").cast("string")))


MODEL_FEATURES = ["s_price", "s_quantity", "s_price_rank_q", "s_quantity_rank_q", "s_price_gap_p"]


@query(None)
def oof_scores(spark, sf_dir):
    rows = stage(_model_rows(spark, sf_dir).select("q", "p", "y", "fold", *MODEL_FEATURES), "model-rows")  # four fits and five scorings read it
    scored_rows = models.out_of_fold(rows, MODEL_FEATURES, models.logistic())
    return scored_rows.select("q", "p", "y", "fold", F.round("prob", 4).alias("prob"))


@query(None)
def adapted_scores(spark, sf_dir):
    """A model of one half of the queries, adapted to the other's own sure pairs; labels that the scores tell, so that there are some."""
    rows = _model_rows(spark, sf_dir).withColumn("y", (F.col("s_price") + 0.1 * F.col("s_quantity") > 0.4).cast("int"))
    source = rows.where("q % 2 = 0")
    target = models.logistic().fit(source, MODEL_FEATURES)(rows.where("q % 2 = 1"))
    return models.adapt(source, target, MODEL_FEATURES, models.logistic()).select("q", "p", F.round("prob", 4).alias("prob"))


@query(None)
def domain_auc(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    return rounded(models.domain_auc(rows.where("q % 2 = 0"), rows.where("q % 2 = 1"), MODEL_FEATURES, models.logistic()))


@query(None)
def partial_dependence(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    return rounded(models.partial_dependence(rows, models.logistic().fit(rows, MODEL_FEATURES), "s_price", [0.1, 0.3, 0.5, 0.7, 0.9]))


@query(f"""WITH {S}, v AS (SELECT prob, count(*) FILTER (WHERE q % 2 = 0) AS a, count(*) FILTER (WHERE q % 2 = 1) AS b FROM pairs GROUP BY 1), u AS (SELECT sum(a) OVER (ORDER BY prob) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY prob) / sum(b) OVER () AS fb FROM v)
  SELECT round(max(abs(fa - fb)), 6) AS ks FROM u""")
def ks_distance(spark, sf_dir):
    pairs = scored(spark, sf_dir, "l_suppkey")
    return rounded(models.ks_distance(pairs.where("q % 2 = 0"), pairs.where("q % 2 = 1")))


@query(f"""WITH {S}, k AS (SELECT q, p FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY prob DESC, p) AS r FROM pairs WHERE prob >= 0.01) WHERE r <= 100),
  t AS (SELECT p_partkey AS rid, string_split_regex(p_name || ' | ' || p_type, ' +') AS w FROM part), h AS (SELECT q, p, {md5_mod_sql('q::VARCHAR', 5)} AS fold, {md5_mod_sql('q::VARCHAR', 2)} AS bit FROM k)
  SELECT q, p, CASE WHEN fold IN (1, 2) THEN 'B' WHEN fold IN (3, 4) THEN 'A' WHEN bit = 0 THEN 'A' ELSE 'B' END AS half,
    round(len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(a.w || b.w))) * CASE WHEN fold IN (3, 4) OR (fold = 0 AND bit = 0) THEN 1 ELSE 2 END, 6) AS ce_logit FROM h JOIN t a ON a.rid = q JOIN t b ON b.rid = p""")
def cross_fit_scores(spark, sf_dir):
    """A second scorer with two half-models, over the undecided pairs; the models here are name overlaps, B's twice as large as A's."""

    def overlap(pairs):
        return [len(set(a.split()) & set(b.split())) / max(1, len(set(a.split()) | set(b.split()))) for a, b in pairs]

    pairs = context.undecided(scored(spark, sf_dir, "l_suppkey"), "prob", most=100).withColumn("half", models.cross_fit_half(fold_of(F.col("q").cast("string")), F.col("q")))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("rid"), F.concat_ws(" | ", "p_name", "p_type").alias("text"))
    return models.second_scores(pairs.select("q", "p", "half"), parts, {"A": overlap, "B": lambda pairs: [2 * x for x in overlap(pairs)]}).select("q", "p", "half", F.round("ce_logit", 6).alias("ce_logit"))


@query(f"SELECT c_custkey FROM customer WHERE NOT (c_custkey % 3 = 0 AND {md5_mod_sql('c_name || ' + chr(39) + '|drop' + chr(39), 10000)} < 4000)")
def dropped_queries(spark, sf_dir):
    records = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("entity_id"), (F.col("c_custkey") % 3 == 0).alias("is_query"))
    return simulate.drop_queries(records, 0.4).select("c_custkey")


@query(f"""WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND {md5_mod_sql('c_name || ' + chr(39) + '|univ' + chr(39), 10000)} < 5000)
  SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone) AND c_custkey NOT IN (SELECT c_custkey + 1 FROM gone)""")
def smaller_universe(spark, sf_dir):
    own = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("entity_id"), (F.col("c_custkey") % 3 == 0).alias("is_query"))
    truth = own.where("is_query").select(F.col("entity_id").alias("q_id"), (F.col("c_custkey") + 1).alias("k")).join(own.select(F.col("c_custkey").alias("k"), F.col("entity_id").alias("p_id")), "k").select("q_id", "p_id")
    return simulate.smaller_universe(own, truth).select("c_custkey")


def _uniform_sql(*keys: str) -> str:
    return f"((('0x' || substr(md5({" || '|' || ".join(keys)}), 1, 10))::BIGINT + 0.5) / 1099511627776)"


def _injection_sql() -> str:
    u = lambda what: _uniform_sql("id", "copy::VARCHAR", f"'{what}'", "'0'")
    total, steps = 0.0, []
    for k in range(12):
        total += math.exp(-simulate.RATE) * simulate.RATE**k / math.factorial(k)
        steps.append(f"(un > {total!r}::DOUBLE)::INT")
    return f"""WITH r AS (SELECT p_partkey::VARCHAR AS id, p_name AS name, p_size AS size, string_split(p_name, ' ') AS w FROM part), n AS (SELECT *, {_uniform_sql("id", "'copies'", "'0'")} AS un FROM r),
      c AS (SELECT *, unnest(range(1, 1 + {" + ".join(steps)})) AS copy FROM n),
      a AS (SELECT *, floor({u('step')} * {simulate.REACH}) + 1 AS step, ['North', 'New', 'And Sons'][(floor({u('token')} * 3) + 1)::INT] AS token FROM c),
      b AS (SELECT *, CASE WHEN size > 1 THEN greatest(1, size + CASE WHEN {u('sign')} < 0.5 THEN -step ELSE step END) ELSE size + step END AS moved,
        CASE WHEN {u('add')} < {simulate.ADD} THEN CASE WHEN {u('place')} < {simulate.AFTER} THEN w || [token] ELSE [token] || w END ELSE w END AS w2 FROM a),
      d AS (SELECT *, (floor({u('which')} * len(w2)) + 1)::INT AS gone FROM b)
      SELECT id AS source_id, copy::INT AS copy, array_to_string(CASE WHEN len(w2) > 2 AND {u('drop')} < {simulate.DROP} THEN list_concat(w2[1:gone - 1], w2[gone + 1:]) ELSE w2 END, ' ') AS name,
        CASE WHEN {u('number')} < {simulate.NUMBER} THEN moved::BIGINT::VARCHAR ELSE size::VARCHAR END || ' main street' AS address FROM d"""


@query(_injection_sql())
def near_copy_injection(spark, sf_dir):
    records = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(" main street")).alias("address"))
    return simulate.perturbed_copies(records, ["north", "new", "and sons"])


@query("""WITH c AS (SELECT l_suppkey AS q, l_partkey AS p, max(l_quantity * 2) AS n_tset, max(100 - l_linenumber * 3) AS a_tset, max((l_returnflag = 'R')::INT)::DOUBLE AS num_state, min(l_linestatus) AS grp FROM lineitem GROUP BY 1, 2),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n_tset DESC, q) AS r FROM c WHERE n_tset >= 90 AND a_tset >= 85) WHERE r = 1) SELECT grp, round(avg(num_state), 6) AS agree FROM b GROUP BY 1""")
def near_copy_agreement(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    pairs = items.groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("p")).agg(
        F.max(F.col("l_quantity") * 2).alias("n_tset"), F.max(100 - F.col("l_linenumber") * 3).alias("a_tset"), F.max((F.col("l_returnflag") == "R").cast("int")).cast("double").alias("num_state"), F.min("l_linestatus").alias("grp"))
    return rounded(shift.agreeing_share(pairs, "grp"))


@query("""WITH c AS (SELECT p, count(*) AS n FROM (SELECT DISTINCT l_suppkey AS q, l_partkey AS p FROM lineitem) GROUP BY 1) SELECT CASE WHEN n <= 20 THEN 'few' WHEN n <= 28 THEN 'some' ELSE 'many' END AS band, count(*) AS n_records, round(avg(n), 6) AS mean_claims FROM c GROUP BY 1""")
def claim_bands(spark, sf_dir):
    counts = channels(spark, sf_dir).groupBy("p").agg(F.count("*").alias("n"))
    band = evaluate.cascade([("few", F.col("n") <= 20), ("some", F.col("n") <= 28)], "many")
    return rounded(counts.groupBy(band.alias("band")).agg(F.count("*").alias("n_records"), F.avg("n").alias("mean_claims")))


@query("""WITH pr AS (SELECT l_orderkey AS q, l_partkey AS p, max(l_extendedprice / 110000) AS prob, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y FROM lineitem GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY prob DESC, p) AS r FROM pr), g AS (SELECT unnest([0.01, 0.05, 0.2]::DOUBLE[]) AS least), t AS (SELECT unnest([1, 2, 4]) AS most)
  SELECT least, most, count(*) FILTER (WHERE prob >= least AND r <= most) AS n_pairs, count(*) FILTER (WHERE prob >= least AND r <= most AND y = 1) AS n_true FROM r, g, t GROUP BY 1, 2""")
def undecided_grid(spark, sf_dir):
    ranked = scored(spark, sf_dir).withColumn("r", context.group_rank("q", "prob", "p"))
    grid = F.array(*[F.struct(F.lit(a).alias("least"), F.lit(b).alias("most")) for a in (0.01, 0.05, 0.2) for b in (1, 2, 4)])
    cells = ranked.select("prob", "r", "y", F.explode(grid).alias("g"))
    inside = (F.col("prob") >= F.col("g.least")) & (F.col("r") <= F.col("g.most"))
    return cells.groupBy("g.least", "g.most").agg(F.count_if(inside).alias("n_pairs"), F.count_if(inside & (F.col("y") == 1)).alias("n_true"))
