"""Near-duplicate vectors by NN-descent.

Equal vectors of a label are one node. A first neighbour graph comes from ``ORDERS`` orderings by random hyperplane
signatures, in which each node meets those around it. Each round then joins neighbours of neighbours: a node
receives the vectors of its neighbours and of those that name it as one, compares them with one another, and each
keeps the best it met. Lists have ``NEIGHBOURS`` places; a list whose places all hold links is saturated
and gets ``ENLARGED``. Of the graph, the edges at the threshold are kept.

Where lists are full of links, a node has more links than places. So links are counted inside each component of the
threshold graph: its members are dealt into blocks, and blocks are compared in pairs. That returns counts, never the
pairs, and its cost grows with the square of a component's size over ``BLOCK``. The search is approximate in what
it finds, never in what it states: every link has been compared in double precision.

``audit`` compares nodes with all rows, ids divisible by 20 first, until ``LEAST_LINKED`` of them have links or all nodes
(``MOST_QUERIES`` at most) have been asked. Recall is the mean over single nodes that have a link, worked out apart for
small and for large components, and the least counts: many links of a few large groups can't hide what was missed
elsewhere. It is taken of the result and of the graph's own edges. Below ``RECALL`` the search is repeated with twice the
orderings, and beyond ``MOST_ORDERS`` an exact blockwise search of each label takes its place.

Vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with nothing. Vectors
of different lengths don't link. Repeated rows and equal vectors link with each other. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwright.llm.common import drop_table, materialise, ready, table
from linkwright.llm.graph import ranked_components

THRESHOLD = 0.93
NEIGHBOURS, ENLARGED = 10, 40
ORDERS, BITS, AROUND = 8, 30, 20
ROUNDS = 3
#: A round that changes a smaller share of the lists' places is the last.
STILL = 0.002
BLOCK, LEAST_BLOCK, MOST_PARTS = 512, 32, 32
#: Nodes asked by the audit at first and at most, linked ones that are enough, and the recall that is.
QUERIES, MOST_QUERIES, LEAST_LINKED, RECALL = 1_024, 16_384, 200, 0.95
#: Orderings beyond which the exact search takes over.
MOST_ORDERS = 32
#: Nodes of a label from which on each doubling adds two orderings.
FEW = 16_384
#: Nodes of a component up to which it counts as small in the audit.
SMALL = 32


def _units(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary vectors (doubles) of one length as unit rows; scaled first, so that no square overflows or vanishes."""
    rows = vectors.to_pylist()
    x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    if not x.size:
        return x
    x = x / np.ldexp(1.0, np.frexp(np.abs(x).max(1, keepdims=True))[1] - 1)  # a power of two: exact
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of the first column, by which the stream is sorted, and where groups start and end."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([carry, now]) if carry is not None else now
        key = now.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        carry = now.slice(cut)
        if cut:
            key = key[:cut]
            yield now.slice(0, cut), np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [cut]])
    if carry is not None:
        key = carry.column(0).to_numpy()
        yield carry, np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])


def classes(vectors: DataFrame) -> DataFrame:
    """One node for each different usable vector of a label: (rid, kin, embedding, vec, first_id, n)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    zero = F.forall("embedding", lambda x: x == 0)
    usable = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad & ~zero)
    alike = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.array(v, "<f8").tobytes() for v in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(own, pa.binary()), b.column(4), b.column(5)], names=["rid", "kin", "label", "embedding", "vec", "first_id", "n"])

    kin = F.xxhash64(F.col("label").cast("string"), F.size("embedding"))
    numbered = alike.select(F.monotonically_increasing_id().alias("rid"), kin.alias("kin"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), "first_id", "n")
    return materialise(numbered.mapInArrow(packed, "rid long, kin long, label string, embedding array<double>, vec binary, first_id long, n long"), "nn-classes")


def first_edges(nodes: DataFrame, orders: int, threshold: float) -> DataFrame:
    """(a, b, sim): in each ordering a node's best of those around it, and all links among them."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            rids, kins, vecs = b.column(0), b.column(1), b.column(2)
            lengths = np.array([len(v) // 8 for v in vecs.to_pylist()])
            for d in np.unique(lengths):
                at = pa.array(np.flatnonzero(lengths == d))
                x = _units(vecs.take(at))
                for k in range(orders):
                    p = planes.setdefault((int(d), k), np.random.default_rng([k, int(d)]).normal(size=(int(d), BITS)))
                    sign = (x @ p > 0) @ (1 << np.arange(BITS))[::-1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k)), kins.take(at), pa.array(sign.astype(np.int64)), rids.take(at), vecs.take(at)], names=["k", "kin", "sign", "rid", "vec"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            now = pa.Table.from_batches([b]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([b])])
            fresh = 0 if carry is None else carry.num_rows
            if not now.num_rows:
                continue
            group = now.column("k").to_numpy() * 0x9E3779B97F4A7C1 ^ now.column("kin").to_numpy()
            ends = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            for s, e in zip(ends, ends[1:]):
                if e - s < 2 or e <= fresh:
                    continue
                x, rid = _units(now.column("vec").slice(s, e - s)), now.column("rid").to_numpy()[s:e]
                w = min(AROUND, e - s - 1)
                sims = np.full((e - s, 2 * w), -2.0)
                other = np.zeros((e - s, 2 * w), np.int64)
                for d in range(1, w + 1):
                    dot = np.einsum("ij,ij->i", x[:-d], x[d:])
                    sims[:-d, d - 1], other[:-d, d - 1] = dot, rid[d:]
                    sims[d:, w + d - 1], other[d:, w + d - 1] = dot, rid[:-d]
                take = min(NEIGHBOURS, 2 * w)
                best = np.zeros(sims.shape, bool)
                np.put_along_axis(best, np.argpartition(-sims, take - 1, 1)[:, :take], True, 1)
                keep = (best | (sims >= threshold)) & (sims > -2)
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(rid[i]), pa.array(other[i, j]), pa.array(sims[i, j])], names=["a", "b", "sim"])
            carry = now.slice(max(0, now.num_rows - AROUND))

    signs = nodes.select("rid", "kin", "vec").mapInArrow(signed, "k long, kin long, sign long, rid long, vec binary")
    keys = ["k", "kin", "sign", "rid"]
    return signs.repartitionByRange(_tasks(nodes), *keys).sortWithinPartitions(*keys).mapInArrow(met, "a long, b long, sim double").dropDuplicates(["a", "b"])


def best(edges: DataFrame, threshold: float) -> DataFrame:
    """(a, list): each node's best neighbours, more of them if the places of an ordinary list all hold links.

    What one node gathers is bounded: it meets the members of the lists at which it is one, at most
    ``ENLARGED + 2 * NEIGHBOURS`` lists of that many members, or ``2 * AROUND`` of each ordering.
    """
    ordered = F.sort_array(F.collect_set(F.struct("sim", "b")), asc=False)
    lists = edges.groupBy("a").agg(ordered.alias("met"))
    saturated = F.coalesce(F.try_element_at("met", F.lit(NEIGHBOURS))["sim"] >= threshold, F.lit(False))
    return lists.select("a", F.slice("met", 1, F.when(saturated, ENLARGED).otherwise(NEIGHBOURS)).alias("list"))


def join_neighbours(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """(a, b, sim) of pairs that met at a common neighbour and are better than the last of a's list."""
    edges = lists.select("a", F.explode("list").alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.sim").alias("sim"))
    named_by = Window.partitionBy("b").orderBy(F.desc("sim"), "a")
    back = edges.withColumn("r", F.row_number().over(named_by)).where(F.col("r") <= 2 * NEIGHBOURS)
    itself = lists.select(F.col("a").alias("at"), F.col("a").alias("v"))
    members = edges.select(F.col("a").alias("at"), F.col("b").alias("v")).unionByName(back.select(F.col("b").alias("at"), F.col("a").alias("v"))).unionByName(itself).distinct()
    full = F.size("list") >= NEIGHBOURS
    worst = lists.select(F.col("a").alias("v"), F.when(full, F.element_at("list", -1)["sim"]).otherwise(-2.0).alias("worst"))
    known = nodes.select(F.col("rid").alias("v"), "vec").join(worst, "v")
    rows = members.join(known, "v").select("at", "v", "worst", "vec")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in _by_key(batches):
            x, v, bar = _units(t.column("vec")), t.column("v").to_numpy(), t.column("worst").to_numpy()
            out: list[list[np.ndarray]] = []
            step = 256
            for g in range(0, len(ends) - 1, step):
                starts, stops = ends[g : g + step + 1][:-1], ends[g + 1 : g + step + 1]
                size = int((stops - starts).max())
                place = starts[:, None] + np.arange(size)
                valid = place < stops[:, None]
                place = np.minimum(place, len(v) - 1)
                sims = np.matmul(x[place], x[place].transpose(0, 2, 1))
                ok = valid[:, :, None] & valid[:, None, :] & (sims > bar[place][:, :, None])
                ok[:, np.arange(size), np.arange(size)] = False
                i, j, k = np.nonzero(ok)
                out.append([v[place[i, j]], v[place[i, k]], sims[i, j, k]])
            a, b, s = (np.concatenate(c) for c in zip(*out))
            code, at = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(code[:, 0]), pa.array(code[:, 1]), pa.array(s[at])], names=["a", "b", "sim"])

    return rows.repartition(_tasks(nodes), "at").sortWithinPartitions("at").mapInArrow(met, "a long, b long, sim double").dropDuplicates(["a", "b"])


def descend(nodes: DataFrame, orders: int, threshold: float, rounds: int = ROUNDS) -> DataFrame:
    """(a, b), a < b: the edges at the threshold of the refined graph."""
    edges = materialise(first_edges(nodes, orders, threshold), "nn-edges")
    links = edges.where(F.col("sim") >= threshold).select("a", "b")
    lists = materialise(best(edges, threshold), "nn-lists")
    places = lists.agg(F.sum(F.size("list"))).first()[0] or 0
    for _ in range(rounds if places else 0):
        found = join_neighbours(nodes, lists)
        old = lists.select("a", F.explode("list").alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.sim").alias("sim"))
        after = materialise(best(found.unionByName(old), threshold), "nn-lists")
        kept = F.size(F.array_intersect(F.transform("list", lambda e: e["b"]), F.transform("was", lambda e: e["b"])))
        changed = after.join(lists.withColumnRenamed("list", "was"), "a").agg(F.sum(F.size("list") - kept)).first()[0] or 0
        drop_table(lists)
        lists = after
        if changed < STILL * places:
            break
    final = lists.select("a", F.explode("list").alias("e")).where(F.col("e.sim") >= threshold).select("a", F.col("e.b").alias("b"))
    return links.unionByName(final).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def count_links(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(rid, others): vectors linked with each node of a component, equal ones apart; blocks are compared in pairs."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("m"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.least(F.ceil(F.col("m") / LEAST_BLOCK), F.lit(MOST_PARTS))).cast("int")
    placed = roots.join(sizes, "root").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = placed.select(F.xxhash64("root", low, high).alias("key"), "own", (low != high).alias("two"), low.alias("low"), F.col("node").alias("rid")).join(nodes.select("rid", "n", "vec"), "rid")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in _by_key(batches):
            rid, n = t.column("rid").to_numpy(), t.column("n").to_numpy().astype(float)
            second = t.column("two").to_numpy() & (t.column("own").to_numpy() != t.column("low").to_numpy())
            x, total = _units(t.column("vec")), np.zeros(t.num_rows)
            for s, e in zip(ends, ends[1:]):
                if t.column("two")[int(s)].as_py():
                    i, j = s + np.flatnonzero(~second[s:e]), s + np.flatnonzero(second[s:e])
                    linked = x[i] @ x[j].T >= threshold
                    total[i], total[j] = linked @ n[j], n[i] @ linked
                else:
                    linked = x[s:e] @ x[s:e].T >= threshold
                    np.fill_diagonal(linked, False)
                    total[s:e] = linked @ n[s:e]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(total.astype(np.int64))], names=["rid", "others"])

    counted = rows.select("key", "rid", "own", "two", "low", "n", "vec").repartition(_tasks(nodes), "key").sortWithinPartitions("key").mapInArrow(count, "rid long, others long")
    return counted.groupBy("rid").agg(F.sum("others").alias("others"))


def exact_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join all that any links join, by comparing all blocks of a label in pairs.

    Each pair of blocks gives a spanning forest of its links, fewer than its nodes, however many links there are.
    """
    sizes = nodes.groupBy("kin").agg(F.count("*").alias("m"))
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = nodes.select("rid", "kin").join(sizes, "kin").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = placed.select(F.xxhash64("kin", low, high).alias("key"), "rid").join(nodes.select("rid", "vec"), "rid")

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in _by_key(batches):
            rid, x = t.column("rid").to_numpy(), _units(t.column("vec"))
            for s, e in zip(ends, ends[1:]):
                linked = x[s:e] @ x[s:e].T >= threshold
                left, out = np.ones(e - s, bool), []
                for i in range(e - s):
                    todo = [i] if left[i] else []
                    left[i] = False
                    while todo:
                        at = todo.pop()
                        new = np.flatnonzero(linked[at] & left)
                        left[new] = False
                        out.append(np.stack([np.full(len(new), rid[s + at]), rid[s + new]]))
                        todo.extend(new.tolist())
                a, b = np.concatenate(out, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.select("key", "rid", "vec").repartition(_tasks(nodes), "key").sortWithinPartitions("key").mapInArrow(forests, "a long, b long").distinct()


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def audit(nodes: DataFrame, links: DataFrame, roots: DataFrame, counted: DataFrame, threshold: float, queries: int = QUERIES) -> tuple[float | None, float | None, int]:
    """Recall of the result, recall of the graph's own edges, and how many linked nodes they are taken from; None for none.

    ``queries`` nodes, then four times as many and so on, are compared with all rows; they reach the driver and are broadcast.
    Of a node with more links than an enlarged list has places, that many edges are all.
    """
    spark = nodes.sparkSession
    sizes = roots.groupBy("root").agg(F.count("*").alias("m"))
    ends = links.select(F.col("a").alias("rid")).unionByName(links.select(F.col("b").alias("rid"))).groupBy("rid").agg(F.count("*").alias("edges"))
    while True:
        asked = nodes.orderBy(F.col("first_id") % 20 != 0, F.xxhash64("rid")).limit(queries).select("rid", "kin", "vec").collect()
        if not asked:
            return None, None, 0
        sent = spark.sparkContext.broadcast([(r.rid, r.kin, bytes(r.vec)) for r in asked])  # MOST_QUERIES vectors at most

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            by_kin: dict[int, tuple] = {}
            for r, k, v in sent.value:
                by_kin.setdefault(k, ([], []))[0].append(r)
                by_kin[k][1].append(v)
            by_kin = {k: (np.array(r), _units(pa.array(v, pa.binary()))) for k, (r, v) in by_kin.items()}
            for b in batches:
                kin, rid, n = b.column(1).to_numpy(), b.column(0).to_numpy(), b.column(2).to_numpy()
                for k in np.intersect1d(kin, list(by_kin)):
                    at, (own, x) = np.flatnonzero(kin == k), by_kin[k]
                    linked = _units(b.column(3).take(pa.array(at))) @ x.T >= threshold
                    linked &= rid[at][:, None] != own
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[at] @ linked), pa.array(linked.sum(0))], names=["rid", "true", "kinds"])

        true = nodes.select("rid", "kin", "n", "vec").mapInArrow(run, "rid long, true long, kinds long").groupBy("rid").agg(F.sum("true").alias("true"), F.sum("kinds").alias("kinds")).where(F.col("true") > 0)
        known = true.join(counted, "rid", "left").join(ends, "rid", "left").join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").join(sizes, "root", "left")
        share = F.least("true", F.coalesce("others", F.lit(0))) / F.col("true")
        most = F.least("kinds", F.lit(ENLARGED))
        edge_share = F.least(most, F.coalesce("edges", F.lit(0))) / most
        bands = known.groupBy((F.coalesce("m", F.lit(0)) <= SMALL).alias("small")).agg(F.count("*").alias("k"), F.avg(share).alias("found"), F.avg(edge_share).alias("edges")).collect()  # two rows
        linked = sum(r.k for r in bands)
        if linked >= LEAST_LINKED or len(asked) < queries or queries >= MOST_QUERIES:
            return (min(r.found for r in bands), min(r.edges for r in bands), linked) if bands else (None, None, 0)
        queries = min(4 * queries, MOST_QUERIES)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, orders: int | None = None, recall: float = RECALL, most_orders: int = MOST_ORDERS) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall, graph_recall, audited_nodes) for every row of ``vectors(vec_id, embedding, label)``.

    ``audited_recall`` is at least ``recall``, or null where no asked node has a link, or 1.0 after the exact search.
    """
    ready(vectors.sparkSession)
    nodes = classes(vectors)
    if orders is None:
        largest = nodes.groupBy("kin").count().agg(F.max("count")).first()[0] or 0
        orders = ORDERS + 2 * max(0, math.ceil(math.log2(max(largest, 1) / FEW)))
    most_orders, exact = max(orders, most_orders), False
    while True:
        links = materialise(exact_links(nodes, threshold) if exact else descend(nodes, orders, threshold), "nn-links")
        linked = ranked_components(links, nodes.select("rid", "first_id"), "rid", "first_id")
        roots = materialise(linked.select(F.col("rid").alias("node"), F.col("root_key").alias("root"), "component_id"), "nn-roots")
        counted = materialise(count_links(nodes, roots, threshold), "nn-counts")
        if exact:
            found = 1.0
            break
        found, of_graph, asked = audit(nodes, links, roots, counted, threshold)
        if found is None or found >= recall:
            break
        exact, orders = orders >= most_orders, 2 * orders
    component = F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("first_id"))
    own = nodes.select("rid", "label", "embedding", "first_id", "n").join(roots, F.col("rid") == F.col("node"), "left").join(counted, "rid", "left")
    named = own.select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), component.alias("component_id"))
    named = named.select(F.col("label").alias("l"), F.col("embedding").alias("e"), "n_links", "component_id")
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    joined = rows.join(named, (rows["label"] == named["l"]) & (rows["embedding"] == named["e"]), "left")
    component = F.coalesce("component_id", "vec_id")
    figures = [F.lit(x).cast("double").alias(n) for x, n in ((found, "audited_recall"), (of_graph, "graph_recall"))] + [F.lit(asked).cast("long").alias("audited_nodes")]
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), *figures)


def op1_nn_descent_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
