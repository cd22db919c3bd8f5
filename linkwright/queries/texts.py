"""Queries of normalisation, similarity, retrieval and corpus weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkwright.config import Channel
from linkwright.functions import addresses, hashing, kernels, names
from linkwright.functions import arrays as A
from linkwright.operators import blocking, pair_features
from linkwright.queries import raw
from linkwright.queries.decisions import md5_mod_sql
from linkwright.queries.tables import CHANNELS_SQL, channels, read, rounded
from linkwright.session import stage

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT c_custkey, (md5_number(c_name) % 5)::INT AS fold FROM customer")
def fold_assign(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", hashing.fold_of(F.col("c_name")).alias("fold"))


@query(f"SELECT c_custkey FROM customer WHERE {md5_mod_sql('c_name || ' + chr(39) + '|drop' + chr(39), 10000)} < 2500")
def hash_dropout(spark, sf_dir):
    return read(spark, sf_dir, "customer").where(hashing.dropped(F.col("c_name"), 0.25, "drop")).select("c_custkey")


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda t: t <> '')"


@query(f"""WITH d AS (SELECT DISTINCT unnest({_words('text')}) AS token FROM documents) SELECT token, {raw.skeleton_sql('token')} AS skeleton FROM d""")
def skeleton_tokens(spark, sf_dir):
    tokens = read(spark, sf_dir, "documents").select(F.explode(A.words(F.lower("text"))).alias("token")).distinct()
    return tokens.select("token", names.skeleton(F.col("token")).alias("skeleton"))


@query("""WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) || (p_size % 10)::VARCHAR AS token FROM part)
  SELECT token, CASE WHEN length(regexp_replace(token, '[^a-z]', '', 'g')) >= 2 AND length(regexp_replace(token, '[^a-z]', '', 'g')) < length(token) THEN translate(token, '0134578$', 'oleastbs') ELSE token END AS plain FROM t""")
def deleet_tokens(spark, sf_dir):
    tokens = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("t"), "p_size").select(F.concat("t", (F.col("p_size") % 10).cast("string")).alias("token")).distinct()
    return tokens.select("token", names.deleet(F.col("token")).alias("plain"))


@query(f"WITH {raw.ADDRESSES_SQL} SELECT c_custkey, a_norm, a_words, a_sorted, a_nums, a_first_num, a_pin, a_ncomp, a_empty FROM ad")
def address_tokens(spark, sf_dir):
    return addresses.address_columns(raw.raw_addresses(spark, sf_dir), "raw").select("c_custkey", "a_norm", "a_words", "a_sorted", "a_nums", "a_first_num", "a_pin", "a_ncomp", "a_empty")


NAME_COLUMNS = ("n_cons", "n_core", "n_sorted", "n_compact", "n_skel", "n_legal", "n_digits", "n_is_domain", "n_has_dba", "n_has_phone", "n_indic")


@query(f"WITH {raw.NAMES_SQL} SELECT p_partkey, {', '.join(NAME_COLUMNS)} FROM nm")
def name_tokens(spark, sf_dir):
    return names.name_columns(raw.raw_names(spark, sf_dir), "raw").select("p_partkey", *NAME_COLUMNS)


def _name_pairs(spark, sf_dir):
    """Distinct part names against each other, as (a, b): their number is that of the name vocabulary, not of the rows."""
    own = read(spark, sf_dir, "part").select("p_name").distinct()
    keyed = lambda n: own.select(F.col("p_name").alias(n), F.explode(F.split("p_name", " ")).alias("w"))
    return keyed("a").join(keyed("b"), "w").where("a < b").select("a", "b").distinct()


NAME_PAIRS = "n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM n), np AS (SELECT DISTINCT x.p_name AS a, z.p_name AS b FROM w x JOIN w z ON x.w = z.w AND x.p_name < z.p_name)"
SHARED = "len(list_intersect(string_split(a, ' '), string_split(b, ' ')))"
UNION = "len(list_distinct(string_split(a, ' ') || string_split(b, ' ')))"


@query(f"""WITH {NAME_PAIRS} SELECT a, b, round({SHARED} / {UNION}, 6) AS jaccard, round({SHARED} / least(len(list_distinct(string_split(a, ' '))), len(list_distinct(string_split(b, ' ')))), 6) AS containment,
  (split_part(a, ' ', 1) = split_part(b, ' ', 1))::INT::DOUBLE AS first_equal, round(least(length(a), length(b)) / greatest(length(a), length(b)), 6) AS length_ratio FROM np""")
def set_similarities(spark, sf_dir):
    x, y = F.split("a", " "), F.split("b", " ")
    sizes = F.length("a"), F.length("b")
    return rounded(_name_pairs(spark, sf_dir).select("a", "b", A.jaccard(x, y).alias("jaccard"), A.containment(x, y).alias("containment"), (x[0] == y[0]).cast("double").alias("first_equal"), (F.least(*sizes) / F.greatest(*sizes)).alias("length_ratio")))


@query(f"WITH {NAME_PAIRS} SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS sim FROM np")
def levenshtein_similarity(spark, sf_dir):
    return rounded(_name_pairs(spark, sf_dir).select("a", "b", kernels.levenshtein_similarity(F.col("a"), F.col("b")).alias("sim")))


@query(f"WITH {NAME_PAIRS} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS sim FROM np")
def jaro_winkler_similarity(spark, sf_dir):
    return rounded(_name_pairs(spark, sf_dir).select("a", "b", kernels.similarity("jaro_winkler", F.col("a"), F.col("b")).alias("sim")))


@query(None)
def ratio_kernels(spark, sf_dir):
    pairs = _name_pairs(spark, sf_dir)
    return rounded(pairs.select("a", "b", *[kernels.similarity(k, F.col("a"), F.col("b")).alias(k) for k in ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio")]))


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS q, l_partkey AS p, l_suppkey::VARCHAR AS a, l_partkey::VARCHAR AS b FROM lineitem)
  SELECT q, p, (a = b)::INT::DOUBLE AS num_state, round(ln(1 + abs(q - p)), 6) AS num_logdiff, (q % 2 = p % 2)::INT::DOUBLE AS num_same_parity, (length(a) = length(b))::INT::DOUBLE AS num_same_len,
    (length(a) = length(b) AND hamming(a, rpad(left(b, length(a)::INT), length(a)::INT, '#')) = 1)::INT::DOUBLE AS num_one_digit_sub, (a <> b AND list_sort(string_split(a, '')) = list_sort(string_split(b, '')))::INT::DOUBLE AS num_transposition,
    (a <> b AND (starts_with(a, b) OR starts_with(b, a)))::INT::DOUBLE AS num_prefix, (a <> b AND abs(q - p) <= 12)::INT::DOUBLE AS num_neighbour, round(ln(1 + abs(q - p)), 6) AS num_min_logdiff_any FROM x""")
def number_relations(spark, sf_dir):
    from linkwright.functions.numbers import number_relations as relations

    pairs = channels(spark, sf_dir).select("q", "p")
    street = F.array(F.lit("main"))
    a, b = F.col("q").cast("string"), F.col("p").cast("string")
    return rounded(pairs.select("q", "p", *[v.alias(k) for k, v in relations(a, b, street, street, F.array(b)).items()]))


def _records(spark, sf_dir):
    """Parts as records: brand for country, every fifth a query."""
    part = read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("rid"), F.col("p_brand").alias("country"), (F.col("p_partkey") % 5 == 0).alias("is_query"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("n_core"),
        F.lit("").alias("n_skel"), F.replace(F.col("p_name"), F.lit(" "), F.lit("")).alias("n_compact"), F.lit("").alias("n_cons"), F.col("p_name").alias("a_words"), F.lit("").alias("a_nums"), F.col("p_name").alias("a_norm"), (F.col("p_size") % 10).cast("string").alias("a_first_num"),
    )


RECORDS = "rec AS (SELECT p_partkey AS rid, p_brand AS country, p_partkey % 5 = 0 AS is_query, p_name || ' ' || lower(p_type) AS n_core, replace(p_name, ' ', '') AS n_compact, p_name AS a_norm, (p_size % 10)::VARCHAR AS a_first_num FROM part)"
GRAM = "'g:' || substr('^' || n_compact || '$', i, 4)"
FEATURES = f"""{RECORDS}, raw AS (
    SELECT rid, country, is_query, 'gram' AS base, unnest(list_transform(range(1, greatest(length(n_compact) - 1, 1) + 1), lambda i: 'g:' || substr('^' || n_compact || '$', i::BIGINT, 4))) AS feature FROM rec
    UNION ALL SELECT rid, country, is_query, 'name', unnest(list_transform(string_split(n_core, ' '), lambda t: 'w:' || t)) FROM rec
    UNION ALL SELECT rid, country, is_query, 'name', unnest(list_transform(range(1, len(string_split(n_core, ' '))), lambda i: 'b:' || string_split(n_core, ' ')[i] || '_' || string_split(n_core, ' ')[i + 1])) FROM rec
    UNION ALL SELECT rid, country, is_query, 'name', unnest(['p:' || substr(n_compact, 1, 5), 's:' || right(n_compact, 5), 'c:' || n_compact]) FROM rec WHERE length(n_compact) >= 4),
  long AS (SELECT DISTINCT * FROM raw), sz AS (SELECT country, count(*) AS n FROM rec GROUP BY 1), df AS (SELECT country, base, feature, count(*) AS df FROM long GROUP BY ALL HAVING count(*) BETWEEN 2 AND 10000),
  idf AS (SELECT long.*, ln(n / df) AS idf FROM long JOIN df USING (country, base, feature) JOIN sz USING (country)),
  wt AS (SELECT *, idf / norm AS w FROM (SELECT *, sqrt(sum(idf * idf) OVER (PARTITION BY rid, base)) AS norm FROM idf) WHERE norm > 0),
  dot AS (SELECT x.rid AS q, z.rid AS p, sum(CASE WHEN base = 'name' THEN x.w * z.w ELSE 0 END) AS d_name, sum(CASE WHEN base = 'gram' THEN x.w * z.w ELSE 0 END) AS d_gram FROM wt x JOIN wt z USING (country, base, feature) WHERE x.is_query AND NOT z.is_query GROUP BY 1, 2)"""


# Scores are rounded before ranking, so that sums in different orders don't break ties differently.
@query(f"WITH {FEATURES}, s AS (SELECT q, p, round(d_gram, 6) AS s_gram FROM dot) SELECT q, p, s_gram FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s_gram DESC, p) AS r FROM s WHERE s_gram > 1e-6) WHERE r <= 5")
def channel_topk(spark, sf_dir):
    return blocking.candidates(_records(spark, sf_dir), {"gram": Channel({"gram": 1.0}, 5)}, digits=6)


@query(f"""WITH {FEATURES}, s AS (SELECT q, p, round(d_name, 6) AS s_name, round(d_gram, 6) AS s_gram FROM dot),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s_name DESC, p) AS r1, row_number() OVER (PARTITION BY q ORDER BY s_gram DESC, p) AS r2 FROM s)
  SELECT q, p, s_name, s_gram FROM r WHERE (r1 <= 4 AND s_name > 1e-6) OR (r2 <= 3 AND s_gram > 1e-6)""")
def channel_union(spark, sf_dir):
    own = {"name": Channel({"name": 1.0}, 4), "gram": Channel({"gram": 1.0}, 3)}
    return blocking.candidates(_records(spark, sf_dir), own, digits=6)


@query(f"WITH {FEATURES}, g AS (SELECT a.rid AS q, b.rid AS p FROM rec a JOIN rec b ON a.country = b.country AND a.is_query AND NOT b.is_query AND left(a.n_compact, 1) = left(b.n_compact, 1)) SELECT q, p, round(coalesce(d_name, 0), 6) AS d_name, round(coalesce(d_gram, 0), 6) AS d_gram FROM g LEFT JOIN dot USING (q, p)")
def rescore_pairs(spark, sf_dir):
    bases = ["name", "gram"]
    _, classes, members, pairs = _class_pairs(spark, sf_dir, sorted({c for b in bases for c in blocking.INPUT[b]}))
    weights = blocking.tfidf(blocking.long_features(classes, bases), classes)
    return blocking.with_members(rounded(blocking.rescore(pairs, weights, bases)), members)


@query(f"""WITH {CHANNELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s_price DESC, p) AS ra, row_number() OVER (PARTITION BY q ORDER BY s_quantity DESC, p) AS rb FROM ch),
  k AS (SELECT q, p, least(ra, rb) - 0.001::DOUBLE * s_combo AS k FROM r) SELECT q, p, fused_rank FROM (SELECT q, p, row_number() OVER (PARTITION BY q ORDER BY k, p) AS fused_rank FROM k) WHERE fused_rank <= 25""")
def fused_rank(spark, sf_dir):
    return blocking.fused_rank(channels(spark, sf_dir), ["s_price", "s_quantity"], "s_combo", 25).select("q", "p", "fused_rank")


@query(f"""WITH {CHANNELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s_price DESC, p) AS ra, row_number() OVER (PARTITION BY q ORDER BY s_quantity DESC, p) AS rb FROM ch),
  k AS (SELECT q, p, greatest(1 / ra, 1 / rb) + 0.001::DOUBLE * s_combo AS k FROM r) SELECT q, p, rrf_rank FROM (SELECT q, p, row_number() OVER (PARTITION BY q ORDER BY k DESC, p) AS rrf_rank FROM k) WHERE rrf_rank <= 10""")
def reciprocal_rank(spark, sf_dir):
    return blocking.reciprocal_fusion(channels(spark, sf_dir), ["s_price", "s_quantity"], "s_combo").where("rrf_rank <= 10").select("q", "p", "rrf_rank")


@query(f"""WITH {CHANNELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s_price DESC, p) AS ra, row_number() OVER (PARTITION BY q ORDER BY s_quantity DESC, p) AS rb FROM ch), n AS (SELECT sum(y) AS n FROM ch)
  SELECT channel, k::INT AS k, round(hits / n, 6) AS recall FROM (""" + " UNION ALL ".join(f"SELECT '{c}' AS channel, {k} AS k, sum(CASE WHEN {r} <= {k} THEN y ELSE 0 END) AS hits FROM r" for c, r in (("s_price", "ra"), ("s_quantity", "rb")) for k in (5, 10, 20, 30)) + " UNION ALL SELECT 'union', 0, sum(y) FROM r), n")  # fmt: skip
def recall_at_k(spark, sf_dir):
    pairs = channels(spark, sf_dir)
    return rounded(blocking.recall_report(pairs, ["s_price", "s_quantity"], pairs.agg(F.sum("y").alias("n_true"))))


@query("SELECT round(1 - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) / ((SELECT count(*) FROM supplier) * (SELECT count(*) FROM part)), 6) AS reduction_ratio")
def reduction_ratio(spark, sf_dir):
    return rounded(blocking.reduction_ratio(channels(spark, sf_dir), read(spark, sf_dir, "supplier").count(), read(spark, sf_dir, "part").count()))


@query(f"WITH {CHANNELS_SQL}, t AS (SELECT DISTINCT l_suppkey AS q, l_partkey AS p FROM lineitem WHERE l_linenumber = 1) SELECT ch.q, ch.p, CASE WHEN t.q IS NULL THEN 0 ELSE 1 END AS label FROM ch LEFT JOIN t ON t.q = ch.q AND t.p = ch.p")
def label_pairs(spark, sf_dir):
    truth = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("p"))
    return blocking.label_pairs(channels(spark, sf_dir).select("q", "p"), truth).withColumnRenamed("y", "label")


@query(f"""WITH {RECORDS} SELECT rid, (SELECT count(*) FROM rec b WHERE b.is_query AND b.country = a.country AND b.n_core = a.n_core)::DOUBLE AS f_core_s1, (SELECT count(*) FROM rec b WHERE NOT b.is_query AND b.country = a.country AND b.n_core = a.n_core)::DOUBLE AS f_core_pool,
  (SELECT count(*) FROM rec b WHERE NOT b.is_query AND b.country = a.country AND b.a_norm = a.a_norm)::DOUBLE AS f_addr_pool, (SELECT count(*) FROM rec b WHERE b.is_query AND b.country = a.country AND b.n_core = a.n_core AND b.a_first_num = a.a_first_num)::DOUBLE AS f_core_num_s1 FROM rec a""")
def ambiguity_counts(spark, sf_dir):
    return pair_features.frequency_columns(_records(spark, sf_dir)).select("rid", *pair_features.FREQUENCIES)


@query(f"""WITH {RECORDS}, s AS (SELECT country, count(*) FILTER (WHERE is_query) AS nq, count(*) FILTER (WHERE NOT is_query) AS np FROM rec GROUP BY 1)
  SELECT rid, round((SELECT count(*) FROM rec b WHERE b.is_query AND b.country = a.country AND b.n_core = a.n_core) / greatest(nq, 1) * 1e5::DOUBLE, 6) AS f_core_s1_rel,
    round((SELECT count(*) FROM rec b WHERE NOT b.is_query AND b.country = a.country AND b.a_norm = a.a_norm) / greatest(np, 1) * 1e5::DOUBLE, 6) AS f_addr_pool_rel FROM rec a JOIN s USING (country)""")
def relative_ambiguity(spark, sf_dir):
    out = pair_features.relative_frequency(pair_features.frequency_columns(_records(spark, sf_dir)))
    return rounded(out.select("rid", "f_core_s1_rel", "f_addr_pool_rel"))


IDF = "n AS (SELECT country, count(*) AS n FROM rec GROUP BY 1), tok AS (SELECT DISTINCT rid, country, unnest(string_split(n_core, ' ')) AS token FROM rec), idf AS (SELECT country, token, ln((n + 1) / (count(*) + 1)) / ln(n + 1) AS w FROM tok JOIN n USING (country) GROUP BY country, token, n)"


@query(f"WITH {RECORDS}, {IDF} SELECT country, token, round(w, 6) AS w FROM idf")
def country_idf(spark, sf_dir):
    return rounded(pair_features.country_idf(_records(spark, sf_dir), "n_core"))


def _class_pairs(spark, sf_dir, columns):
    """(records, classes, members, pairs of classes): what holds for a pair of records depends on ``columns`` alone, so it is worked out once for all that agree in them."""
    own = _records(spark, sf_dir)
    classes, members = blocking.record_classes(own, columns)
    side = lambda k, f: classes.where(f).select(F.col("rid").alias(k), "country", F.substring("n_compact", 1, 1).alias("start"))
    return own, classes, members, side("q", "is_query").join(side("p", "NOT is_query"), ["country", "start"]).select("q", "p")


@query(f"""WITH {RECORDS}, {IDF}, pr AS (SELECT a.rid AS q, b.rid AS p FROM rec a JOIN rec b ON a.country = b.country AND a.is_query AND NOT b.is_query AND left(a.n_compact, 1) = left(b.n_compact, 1)),
  tw AS (SELECT rid, token, w FROM tok JOIN idf USING (country, token)), sq AS (SELECT rid, sum(w) AS s FROM tw GROUP BY 1), sh AS (SELECT q, p, sum(x.w) AS ws FROM pr JOIN tw x ON x.rid = q JOIN tw z ON z.rid = p AND z.token = x.token GROUP BY 1, 2)
  SELECT q, p, round(coalesce(ws, 0) / (a.s + b.s - coalesce(ws, 0)), 6) AS wjacc, round(coalesce(ws, 0) / a.s, 6) AS wcov_q, round(coalesce(ws, 0) / b.s, 6) AS wcov_p FROM pr JOIN sq a ON a.rid = q JOIN sq b ON b.rid = p LEFT JOIN sh USING (q, p)""")
def weighted_jaccard(spark, sf_dir):
    own, classes, members, pairs = _class_pairs(spark, sf_dir, ["n_core", "n_compact"])
    return blocking.with_members(rounded(pair_features.weighted_overlap(pairs, classes, "n_core", pair_features.country_idf(own, "n_core"))), members)


@query(f"""WITH {RECORDS}, {IDF}, pr AS (SELECT a.rid AS q, b.rid AS p FROM rec a JOIN rec b ON a.country = b.country AND a.is_query AND NOT b.is_query AND left(a.n_compact, 1) = left(b.n_compact, 1)),
  tw AS (SELECT rid, token, w FROM tok JOIN idf USING (country, token)), met AS (SELECT q, p, x.token AS t, x.w AS wt, z.token AS u, z.w AS wu, jaro_winkler_similarity(x.token, z.token) AS s FROM pr JOIN tw x ON x.rid = q JOIN tw z ON z.rid = p),
  fq AS (SELECT q, p, sum(CASE WHEN b >= 0.88 THEN w * b ELSE 0 END) / sum(w) AS v FROM (SELECT q, p, t, wt AS w, max(s) AS b FROM met GROUP BY ALL) GROUP BY 1, 2),
  fp AS (SELECT q, p, sum(CASE WHEN b >= 0.88 THEN w * b ELSE 0 END) / sum(w) AS v FROM (SELECT q, p, u, wu AS w, max(s) AS b FROM met GROUP BY ALL) GROUP BY 1, 2)
  SELECT q, p, round((fq.v + fp.v) / 2, 6) AS soft FROM fq JOIN fp USING (q, p)""")
def soft_tfidf(spark, sf_dir):
    own, classes, members, pairs = _class_pairs(spark, sf_dir, ["n_core", "n_compact"])
    return blocking.with_members(rounded(pair_features.weighted_overlap(pairs, classes, "n_core", pair_features.country_idf(own, "n_core"), soft=True).select("q", "p", "soft")), members)


@query("SELECT l_returnflag, round((SELECT count(*) FROM lineitem) / count(*), 6) AS weight FROM lineitem GROUP BY 1")
def balanced_weights(spark, sf_dir):
    return rounded(pair_features.balanced_weights(read(spark, sf_dir, "lineitem").select("l_returnflag"), "l_returnflag").distinct())


@query(f"""WITH {FEATURES}, s AS (SELECT q, p, round(d_name, 9) AS s_name, round(d_gram, 9) AS s_gram, round(d_name * 0.5 + d_gram * 0.5, 9) AS s_combo FROM dot),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s_name DESC, p) AS r1, row_number() OVER (PARTITION BY q ORDER BY s_gram DESC, p) AS r2, row_number() OVER (PARTITION BY q ORDER BY s_combo DESC, p) AS r3 FROM s)
  SELECT q, p, round(s_name, 6) AS s_name, round(s_gram, 6) AS s_gram, round(s_combo, 6) AS s_combo FROM r WHERE (r1 <= 10 AND s_name > 1e-6) OR (r2 <= 5 AND s_gram > 1e-6) OR (r3 <= 10 AND s_combo > 1e-6)""")
def multi_channel_candidates(spark, sf_dir):
    own = {"name": Channel({"name": 1.0}, 10), "gram": Channel({"gram": 1.0}, 5), "combo": Channel({"name": 0.5, "gram": 0.5}, 10)}
    return rounded(blocking.candidates(_records(spark, sf_dir), own))


# All five channels over raw names and addresses: features of every base, weights and ranks once more in SQL.
def _adjacent(items: str, tag: str) -> str:
    return f"list_transform(range(1, len({items})), lambda i: '{tag}:' || {items}[i] || '_' || {items}[i + 1])"


BASE_ROWS = f"""SELECT rid, country, is_query, 'name' AS base, unnest(list_transform(core, lambda t: 'w:' || t)) AS feature FROM rec
    UNION ALL SELECT rid, country, is_query, 'name', unnest(list_transform(list_filter(string_split(n_skel, ' '), lambda t: length(t) >= 2), lambda t: 'k:' || t)) FROM rec
    UNION ALL SELECT rid, country, is_query, 'name', unnest({_adjacent('core', 'b')}) FROM rec
    UNION ALL SELECT rid, country, is_query, 'name', unnest(['p:' || substr(n_compact, 1, 5), 's:' || right(n_compact, 5), 'c:' || n_compact]) FROM rec WHERE length(n_compact) >= 4
    UNION ALL SELECT rid, country, is_query, 'name', unnest(list_transform(list_filter(string_split(n_cons, ' '), lambda t: t <> ''), lambda t: 'w:' || t)) FROM rec WHERE len(core) = 0
    UNION ALL SELECT rid, country, is_query, 'addr', unnest(list_transform(a_wlist, lambda t: 'a:' || t)) FROM rec
    UNION ALL SELECT rid, country, is_query, 'addr', unnest(list_transform(list_filter(a_nlist, lambda t: length(t) >= 2), lambda t: 'n:' || t)) FROM rec
    UNION ALL SELECT rid, country, is_query, 'addr', unnest({_adjacent('a_wlist', 'ab')}) FROM rec
    UNION ALL SELECT rid, country, is_query, 'addr', unnest(list_filter(list_transform(range(1, len(a_list)), lambda i: CASE WHEN regexp_matches(a_list[i], '^[0-9]+$') AND NOT regexp_matches(a_list[i + 1], '^[0-9]+$') THEN 'nw:' || a_list[i] || '_' || a_list[i + 1] END), lambda t: t IS NOT NULL)) FROM rec
    UNION ALL SELECT rid, country, is_query, 'conj', 'x:' || a || '|' || b FROM (SELECT *, unnest(list_filter(core, lambda t: length(t) >= 2)[1:4]) AS a FROM rec) x, unnest(list_filter(a_wlist, lambda t: length(t) >= 3)[1:12]) AS u(b)
    UNION ALL SELECT rid, country, is_query, 'conj', 'y:' || a || '|' || b FROM (SELECT *, unnest(list_filter(core, lambda t: length(t) >= 2)[1:4]) AS a FROM rec) x, unnest(a_nlist[1:4]) AS u(b)
    UNION ALL SELECT rid, country, is_query, 'gram', unnest(list_transform(range(1, greatest(length(n_compact) - 1, 1) + 1), lambda i: 'g:' || substr('^' || n_compact || '$', i::BIGINT, 4))) FROM rec"""


@query(f"WITH {raw.RECORDS_SQL} SELECT DISTINCT rid, base, feature FROM ({BASE_ROWS})")
def channel_features(spark, sf_dir):
    return blocking.long_features(raw.normal_records(spark, sf_dir), ["addr", "conj", "gram", "name"]).select("rid", "base", "feature")


FIVE = {"name": "d_name", "addr": "d_addr", "combo": "d_name * 0.5 + d_addr * 0.5", "conj": "d_conj * 0.6 + d_name * 0.2 + d_addr * 0.2", "gram": "d_gram"}
KEPT = {"name": 30, "addr": 30, "combo": 30, "conj": 30, "gram": 20}


@query(f"""WITH {raw.RECORDS_SQL}, long AS (SELECT DISTINCT * FROM ({BASE_ROWS})), sz AS (SELECT country, count(*) AS n FROM rec GROUP BY 1),
  df AS (SELECT country, base, feature, count(*) AS df FROM long GROUP BY ALL HAVING count(*) BETWEEN 2 AND 10000), idf AS (SELECT long.*, ln(n / df) AS idf FROM long JOIN df USING (country, base, feature) JOIN sz USING (country)),
  wt AS (SELECT *, idf / norm AS w FROM (SELECT *, sqrt(sum(idf * idf) OVER (PARTITION BY rid, base)) AS norm FROM idf) WHERE norm > 0),
  dot AS (SELECT x.rid AS q, z.rid AS p, {', '.join(f"sum(CASE WHEN base = '{b}' THEN x.w * z.w ELSE 0 END) AS d_{b}" for b in ('name', 'addr', 'conj', 'gram'))} FROM wt x JOIN wt z USING (country, base, feature) WHERE x.is_query AND NOT z.is_query GROUP BY 1, 2),
  s AS (SELECT q, p, {', '.join(f'round({e}, 9) AS s_{n}' for n, e in FIVE.items())} FROM dot), r AS (SELECT *, {', '.join(f'row_number() OVER (PARTITION BY q ORDER BY s_{n} DESC, p) AS r_{n}' for n in FIVE)} FROM s)
  SELECT q, p, {', '.join(f'round(s_{n}, 6) AS s_{n}' for n in FIVE)} FROM r WHERE {' OR '.join(f'(r_{n} <= {k} AND s_{n} > 1e-6)' for n, k in KEPT.items())}""")
def five_channel_candidates(spark, sf_dir):
    """Retrieval as a whole with its default channels, from raw text on."""
    return rounded(blocking.candidates(stage(raw.normal_records(spark, sf_dir), "raw-records")))  # classes and their members read it
