"""All queries of the library by name, with their SQL on the supplied tables.

The graph is the distinct (o_custkey, l_partkey) of orders and lineitem; the
thin graph has only lines of quantity 41 and more.  Doubles are rounded to six digits.
Queries whose SQL is written for the thin graph stay with it; each has a twin
``*_whole`` that runs the same operator on the whole graph.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_key
from pairloom.functions.storage import shared_dir, stored
from pairloom.jobs import experiments as jobs
from pairloom.operators import cooc, embed, evaluate, graph, lattice, paths, sampling
from pairloom.operators.model import predict_pairs, train_link_classifier
from pairloom.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_edges(spark: SparkSession, sf: str, thin: bool = False) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    lines = lines.where("l_quantity >= 41") if thin else lines
    joined = lines.select("l_orderkey", "l_partkey").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.project_edges(joined, "o_custkey", "l_partkey")


def edges_of(spark: SparkSession, sf: str, thin: bool = False) -> DataFrame:
    return graph.distinct_edges(raw_edges(spark, sf, thin))


def split_of(spark: SparkSession, sf: str, thin: bool = False) -> tuple[DataFrame, DataFrame]:
    return sampling.holdout_per_left(stored(edges_of(spark, sf, thin)), 0.2, 1)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in cols})


# SQL shared by the oracles; G is the graph, T and H its train and test edges
RAW = 'raw AS (SELECT o_custkey AS "left", l_partkey AS "right" FROM lineitem JOIN orders ON l_orderkey = o_orderkey{thin})'
E = ', e AS (SELECT DISTINCT "left", "right" FROM raw)'


def key(seed: object, *cols: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(cols)})), 1, 13))::BIGINT"


def base(thin: bool = False, more: str = "") -> str:
    return "WITH " + RAW.format(thin=" WHERE l_quantity >= 41" if thin else "") + E + more


SPLIT = f""", hk AS (SELECT "left", "right", row_number() OVER (PARTITION BY "left" ORDER BY {key(1, '"left"', '"right"')}, "right") AS k, count(*) OVER (PARTITION BY "left") AS n FROM e),
tr AS (SELECT "left", "right" FROM hk WHERE k > floor(0.2 * n + 0.5)), te AS (SELECT "left", "right" FROM hk WHERE k <= floor(0.2 * n + 0.5))"""
L_LIST = ', ll AS (SELECT "left", row_number() OVER (ORDER BY "left") - 1 AS pos FROM (SELECT DISTINCT "left" FROM e)), rl AS (SELECT "right", row_number() OVER (ORDER BY "right") - 1 AS pos FROM (SELECT DISTINCT "right" FROM e))'


def negatives_sql(n: str, by_degree: bool = False, seed: int = 1) -> str:
    """CTE ``neg``: the first n distinct non-edges in draw order."""
    lists = ', ep AS (SELECT "left", "right", row_number() OVER (ORDER BY "left", "right") - 1 AS pos FROM e), ll AS (SELECT "left", pos FROM ep), rl AS (SELECT "right", pos FROM ep)' if by_degree else L_LIST
    return (
        lists
        + f""", nn AS (SELECT {n} AS n), dr AS (SELECT i, {key(seed, "'L'", 'i')} % (SELECT count(*) FROM ll) AS li, {key(seed, "'R'", 'i')} % (SELECT count(*) FROM rl) AS ri FROM (SELECT unnest(range(0, (SELECT 6 * n + 1000 FROM nn))) AS i)),
nd AS (SELECT ll."left", rl."right", min(i) AS i FROM dr JOIN ll ON li = ll.pos JOIN rl ON ri = rl.pos WHERE NOT EXISTS (SELECT 1 FROM e WHERE e."left" = ll."left" AND e."right" = rl."right") GROUP BY 1, 2),
neg AS (SELECT "left", "right" FROM (SELECT "left", "right", row_number() OVER (ORDER BY i) AS k FROM nd) WHERE k <= (SELECT n FROM nn))"""
    )


N_TEST = "(SELECT count(*) FROM te)"
PAIRS = ', pairs AS (SELECT * FROM te UNION ALL SELECT * FROM neg)'


def eval_base(thin: bool = False) -> str:
    return base(thin, SPLIT + negatives_sql(N_TEST) + PAIRS)


def pairs_of(spark: SparkSession, sf: str, thin: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, pairs): pairs are the test edges and as many uniform non-edges."""
    edges = stored(edges_of(spark, sf, thin))
    train, test = (stored(d) for d in sampling.holdout_per_left(edges, 0.2, 1))
    return train, test, stored(test.unionByName(sampling.sample_negatives_uniform(edges, test.count(), 1)))


# ---- edge lists


@query(base() + ' SELECT "left", "right" FROM raw')
def edges_projected(spark, sf):
    return raw_edges(spark, sf)


@query(base() + ' SELECT "left", "right" FROM e')
def edges_distinct(spark, sf):
    return edges_of(spark, sf)


@query(base() + ', c AS (SELECT "right", row_number() OVER (ORDER BY "right") - 1 AS right_code FROM (SELECT DISTINCT "right" FROM e)) SELECT "left", "right", right_code FROM e JOIN c USING ("right")')
def factorize_ids(spark, sf):
    return graph.factorize(edges_of(spark, sf), "right")


@query(base() + ' SELECT "left", "right" + (SELECT max("left") + 1 FROM e) AS "right" FROM e')
def offset_right_ids(spark, sf):
    return graph.offset_right_ids(edges_of(spark, sf))


@query(base() + " SELECT DISTINCT 'left' AS side, \"left\" AS node FROM e UNION SELECT DISTINCT 'right', \"right\" FROM e")
def node_lists(spark, sf):
    return graph.node_lists(edges_of(spark, sf))


@query(base() + ' SELECT count(DISTINCT "left") AS n_left, count(DISTINCT "right") AS n_right, count(*) AS n_edges FROM e')
def graph_stats(spark, sf):
    return graph.graph_stats(edges_of(spark, sf))


@query(base() + ' SELECT "left" AS node, count(*) AS degree FROM raw GROUP BY 1')
def left_degrees(spark, sf):
    return graph.node_degrees(raw_edges(spark, sf), "left")


@query(base() + ' SELECT "right" AS node, count(*) AS degree FROM raw GROUP BY 1')
def right_degrees(spark, sf):
    return graph.node_degrees(raw_edges(spark, sf), "right")


# ---- files: written to the shared folder from the graph and read back


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query(base() + ' SELECT "left", "right" FROM raw')
def ratings_read(spark, sf):
    path = new_path(spark)
    raw_edges(spark, sf).select("left", "right", F.lit(5), F.lit(0)).write.csv(path, sep="\t")
    return io.read_ratings(spark, path)


@query(base() + ' SELECT dense_rank() OVER (ORDER BY "left") - 1 AS "left", dense_rank() OVER (ORDER BY "right") - 1 AS "right" FROM e')
def interactions_header_read(spark, sf):
    path = new_path(spark)
    raw_edges(spark, sf).select(F.col("right").alias("item"), F.col("left").alias("user")).write.option("header", True).csv(path, sep="\t")
    return io.read_interactions_header(spark, path, "user", "item")


@query(base() + ' SELECT dense_rank() OVER (ORDER BY "left") - 1 AS "left", "right" FROM e')
def ragged_adjacency_read(spark, sf):
    path = new_path(spark)
    lines = edges_of(spark, sf).groupBy("left").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(" ", F.collect_list(F.col("right").cast("string"))).alias("rights"))
    lines.orderBy("left").select(F.concat_ws(" ", F.col("n").cast("string"), "rights")).write.text(path)
    return io.read_ragged_adjacency(spark, path)


@query(base() + ' SELECT "left", "right" FROM e')
def edges_round_trip(spark, sf):
    path = new_path(spark)
    io.write_edges(edges_of(spark, sf), path)
    return io.read_edges(spark, path)


@query(eval_base() + ' SELECT "left", "right", CAST(1 AS INTEGER) AS label FROM te UNION ALL SELECT "left", "right", CAST(0 AS INTEGER) FROM neg')
def target_pairs_written(spark, sf):
    _, test, pairs = pairs_of(spark, sf)
    path = new_path(spark)
    io.write_target_pairs(test, pairs.join(test, ["left", "right"], "left_anti"), path)
    return spark.read.parquet(path)


@query(base() + ', d AS (SELECT "right", count(*) AS degree FROM e GROUP BY 1) SELECT "left", "right", degree FROM e JOIN d USING ("right")')
def pair_features_round_trip(spark, sf):
    edges, path = stored(edges_of(spark, sf)), new_path(spark)
    for sn, side in ((1, "left"), (2, "right")):
        io.write_pair_features(edges.join(graph.node_degrees(edges, side).withColumnRenamed("node", side), side).select("left", "right", "degree"), path, sn)
    return io.read_pair_features(spark, path, 2)


@query(base() + ', s AS (SELECT count(DISTINCT "left") AS n_left, count(DISTINCT "right") AS n_right, count(*) AS n_edges FROM e) SELECT * FROM s UNION ALL SELECT * FROM s')
def results_appended(spark, sf):
    stats, path = stored(graph.graph_stats(edges_of(spark, sf))), new_path(spark)
    for _ in range(2):
        io.append_results(stats, path)
    return spark.read.schema(stats.schema).option("header", True).csv(path)


@query(base() + ' SELECT DISTINCT least("left", "right") AS src, greatest("left", "right") AS dst, CAST(("left" + "right") % 5 AS DOUBLE) AS weight FROM e WHERE ("left" + "right") % 5 <> 0')
def weighted_edges_read(spark, sf):
    path = new_path(spark)
    raw_edges(spark, sf).select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("left", "right")), ((F.col("left") + F.col("right")) % 5).cast("string"))).write.text(path)
    return io.read_weighted_edges(spark, path)


@query(base() + ' SELECT greatest("left", "right") AS larger, least("left", "right") AS smaller, (("left" * 7 + "right") % 1000) / 8.0 AS score FROM e')
def predictions_written(spark, sf):
    path = new_path(spark)
    io.write_predictions(edges_of(spark, sf).withColumn("score", (F.col("left") * 7 + F.col("right")) % 1000 / F.lit(8.0)), path)
    return spark.read.schema("larger long, smaller long, score double").csv(path, sep="\t")


@query()
def observations_written(spark, sf):
    """Raw observations, written and read back."""
    path = new_path(spark)
    io.write_observations(_obs(spark, sf, 1), path)
    return rounded(spark.read.parquet(path), "value")


def _core_sql(k: int, rounds: int, thin: bool = True) -> str:
    sql, last = base(thin), "e"
    for i in range(rounds):
        sql += f', k{i} AS MATERIALIZED (SELECT "left", "right" FROM {last} WHERE "left" IN (SELECT "left" FROM {last} GROUP BY 1 HAVING count(*) >= {k}) AND "right" IN (SELECT "right" FROM {last} GROUP BY 1 HAVING count(*) >= {k}))'
        last = f"k{i}"
    return sql + f' SELECT "left", "right" FROM {last}'


@query(_core_sql(4, 14))
def k_core_4(spark, sf):
    return graph.k_core(edges_of(spark, sf, True), 4)


@query(_core_sql(4, 14, False))
def k_core_4_whole(spark, sf):
    return graph.k_core(edges_of(spark, sf), 4)


@query(base() + ' SELECT "left" AS node, string_agg("right"::VARCHAR, \',\' ORDER BY "right") AS neighbours FROM e GROUP BY 1')
def adjacency_left(spark, sf):
    return graph.adjacency(edges_of(spark, sf)).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@query(base(more=SPLIT + negatives_sql(N_TEST)) + ' SELECT "left", "right", 1 AS label FROM te UNION ALL SELECT "left", "right", 0 FROM neg')
def pairs_union(spark, sf):
    edges = stored(edges_of(spark, sf))
    _, test = sampling.holdout_per_left(edges, 0.2, 1)
    test = stored(test)
    return graph.union_pairs(test, sampling.sample_negatives_uniform(edges, test.count(), 1))


@query(base(more=SPLIT) + ' SELECT "left", "right" FROM tr')
def train_edges(spark, sf):
    edges = stored(edges_of(spark, sf))
    return graph.except_pairs(edges, sampling.holdout_per_left(edges, 0.2, 1)[1])


@query(base(more=SPLIT) + ' SELECT "left", "right" FROM te')
def holdout_test(spark, sf):
    return split_of(spark, sf)[1]


@query(base(more=SPLIT) + " SELECT count(*) AS leaked FROM tr JOIN te USING (\"left\", \"right\")")
def leak_check(spark, sf):
    return graph.overlap_check(*split_of(spark, sf))


@query(base() + f' SELECT "left", "right", row_number() OVER (ORDER BY {key(3, chr(34) + "left" + chr(34), chr(34) + "right" + chr(34))}, "left", "right") - 1 AS position FROM e')
def pairs_shuffled(spark, sf):
    return graph.shuffle_pairs(edges_of(spark, sf), 3)


@query(base() + ' SELECT "left", "right" FROM e UNION SELECT "right", "left" FROM e')
def symmetrized_edges(spark, sf):
    return graph.symmetrize(edges_of(spark, sf))


# ---- sampling


def _sample_sql(order: str) -> str:
    sides = "".join(
        f""", d{s[0]} AS (SELECT "{s}" AS node, count(*) AS degree FROM e GROUP BY 1), s{s[0]} AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY {order.format(key=key(5, f"'{s}'", "node"))}, node) AS k FROM d{s[0]}) WHERE k <= floor((SELECT count(*) FROM d{s[0]}) * sqrt(2500.0 / (SELECT count(*) FROM e))))"""
        for s in ("left", "right")
    )
    return base() + sides + ' SELECT "left", "right" FROM e WHERE "left" IN (SELECT node FROM sl) AND "right" IN (SELECT node FROM sr)'


@query(_sample_sql("{key}"))
def sample_random_subgraph(spark, sf):
    return sampling.sample_random_nodes(stored(edges_of(spark, sf)), 2500, 5)


@query(_sample_sql("-ln(({key} + 0.5) / 4503599627370496.0) / degree"))
def sample_degree_subgraph(spark, sf):
    return sampling.sample_degree_nodes(stored(edges_of(spark, sf)), 2500, 5)


@query(_sample_sql("{key}").replace("2500.0", "(CASE WHEN (SELECT count(*) FROM e) > 50000 THEN 25000.0 ELSE (SELECT count(*) FROM e) END)"))
def sample_for_budget(spark, sf):
    """25,000 edges at random if there are more than 50,000."""
    return sampling.sample_for_budget(stored(edges_of(spark, sf)), " Random", 5)


@query()
def sample_forest_fire(spark, sf):
    return sampling.sample_forest_fire(stored(edges_of(spark, sf)), 2500, 0.7, 5)


NODES = "SELECT 'left' AS side, \"left\" AS node FROM e UNION SELECT 'right', \"right\" FROM e"


@query(base() + f", v AS ({NODES}) SELECT least(2500, count(*))::BIGINT AS burned, count(DISTINCT side) AS sides, 0::BIGINT AS unlit, 0::BIGINT AS repeated FROM v")
def forest_fire_burned(spark, sf):
    """How many nodes a budget of 2,500 burns; how many were lit by none of their neighbours of the level before, though no start, or twice."""
    edges = stored(edges_of(spark, sf))
    burned = sampling.burn_forest(edges, 2500, 0.7, 5)
    near = edges.select(F.lit("left").alias("from_side"), F.col("left").alias("from_node"), F.lit("right").alias("side"), F.col("right").alias("node"))
    near = near.unionByName(edges.select(F.lit("right").alias("from_side"), F.col("right").alias("from_node"), F.lit("left").alias("side"), F.col("left").alias("node")))
    lit = near.join(burned.select(F.col("side").alias("from_side"), F.col("node").alias("from_node"), (F.col("level") + 1).alias("level")), ["from_side", "from_node"])
    unlit = burned.where("from_side is not null").join(lit, ["side", "node", "level", "from_side", "from_node"], "left_anti").agg(F.count(F.lit(1)).alias("unlit"))
    per_node = burned.groupBy("side", "node").agg(F.count(F.lit(1)).alias("n"))
    totals = per_node.agg(F.count(F.lit(1)).alias("burned"), F.countDistinct("side").alias("sides"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"))
    return totals.crossJoin(unlit).select("burned", "sides", "unlit", "repeated")  # a row each


LOG = "WITH o AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal FROM events)"


@query(LOG + " SELECT event_id, user_id, least(5, floor(pos / (SELECT count(*) // 5 FROM o)) + 1)::INT AS fold FROM o")
def kfold_blocks(spark, sf):
    return sampling.kfold_blocks(table(spark, sf, "events").select("event_id", "user_id", "ts"), 5, "ts", "event_id").select("event_id", "user_id", "fold")


def _allbut(spark, sf, start, stop):
    return sampling.allbut(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], start, stop).select("event_id", "user_id", "is_test")


@query(LOG + " SELECT event_id, user_id, ordinal BETWEEN 1 AND 10 AS is_test FROM o")
def allbut_1_10(spark, sf):
    return _allbut(spark, sf, 1, 10)


@query(LOG + " SELECT event_id, user_id, ordinal BETWEEN 11 AND 20 AS is_test FROM o")
def allbut_11_20(spark, sf):
    return _allbut(spark, sf, 11, 20)


@query(base(more=negatives_sql("(SELECT count(*) FROM e)")) + ' SELECT "left", "right" FROM neg')
def negatives_uniform(spark, sf):
    edges = stored(edges_of(spark, sf))
    return sampling.sample_negatives_uniform(edges, edges.count(), 1)


@query(base(more=negatives_sql("(SELECT count(*) FROM e)", True)) + ' SELECT "left", "right" FROM neg')
def negatives_by_degree(spark, sf):
    edges = stored(edges_of(spark, sf))
    return sampling.sample_negatives_by_degree(edges, edges.count(), 1)


EVAL = ', ev AS (SELECT p."left", p."right", CASE WHEN te."left" IS NULL THEN 0 ELSE 1 END AS label FROM (SELECT DISTINCT "left", "right" FROM pairs) p LEFT JOIN te ON te."left" = p."left" AND te."right" = p."right" WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr."left" = p."left" AND tr."right" = p."right"))'


@query(eval_base() + EVAL + ' SELECT "left", "right", label FROM ev')
def eval_pairs(spark, sf):
    train, test, pairs = pairs_of(spark, sf)
    return sampling.build_eval_pairs(pairs, train, test)


SPLITS = """, sp AS (SELECT "left", "right", 'train_pos' AS split FROM tr UNION ALL SELECT "left", "right", 'test_pos' FROM te UNION ALL SELECT "left", "right", 'negative' FROM neg)"""


def _splits(spark, sf):
    train, test, pairs = pairs_of(spark, sf)
    return sampling.assign_splits(pairs.unionByName(train), train, test)


@query(eval_base() + SPLITS + ' SELECT "left", "right", split FROM sp')
def pair_splits(spark, sf):
    return _splits(spark, sf)


def _split_counts_sql(thin: bool) -> str:
    return (
        base(thin, SPLIT + negatives_sql("(SELECT 2 * count(*) FROM e)")) + SPLITS + f""", ng AS (SELECT "left", "right", row_number() OVER (ORDER BY {key(2, '"left"', '"right"')}) AS k FROM sp WHERE split = 'negative'),
pt AS (SELECT CASE WHEN split = 'train_pos' THEN 'train' ELSE 'test' END AS part, CASE WHEN split = 'negative' THEN 0 ELSE 1 END AS label FROM sp WHERE split <> 'negative'
UNION ALL SELECT CASE WHEN k <= (SELECT count(*) FROM tr) THEN 'train' ELSE 'test' END, 0 FROM ng) SELECT part, label, count(*) AS n FROM pt GROUP BY 1, 2"""
    )


def _split_counts(spark, sf, thin):
    edges = stored(edges_of(spark, sf, thin))
    train, test = (stored(d) for d in sampling.holdout_per_left(edges, 0.2, 1))
    targets = edges.unionByName(sampling.sample_negatives_uniform(edges, 2 * edges.count(), 1))
    parts = sampling.split_train_test_negatives(stored(sampling.assign_splits(targets, train, test)), 1, 2)
    return parts.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


@query(_split_counts_sql(True))
def model_split_counts(spark, sf):
    return _split_counts(spark, sf, True)


@query(_split_counts_sql(False))
def model_split_counts_whole(spark, sf):
    return _split_counts(spark, sf, False)


def _ratio_samples_sql(thin: bool) -> str:
    return (
        base(thin, SPLIT + negatives_sql("(SELECT 12 * count(*) FROM te)"))
        + "".join([', lab AS (SELECT "left", "right", 1 AS label FROM te UNION ALL SELECT "left", "right", 0 FROM neg)'] + [f', r{r} AS (SELECT {r} AS ratio, "left", "right", row_number() OVER (ORDER BY {key(4, str(r), chr(34) + "left" + chr(34), chr(34) + "right" + chr(34))}, "left", "right") AS k FROM lab WHERE label = 0)' for r in (1, 10)])
        + ' SELECT ratio, "left", "right", 0 AS label FROM r1 WHERE k <= (SELECT count(*) FROM te) UNION ALL SELECT ratio, "left", "right", 0 FROM r10 WHERE k <= 10 * (SELECT count(*) FROM te) UNION ALL SELECT ratio, "left", "right", 1 FROM te, (SELECT unnest([1, 10])::INT AS ratio)'
    )


def _ratio_samples(spark, sf, thin):
    edges = stored(edges_of(spark, sf, thin))
    _, test = sampling.holdout_per_left(edges, 0.2, 1)
    test = stored(test)
    labelled = stored(graph.union_pairs(test, sampling.sample_negatives_uniform(edges, 12 * test.count(), 1)))
    one, ten = (sampling.sample_ratio(labelled, r, 4).withColumn("ratio", F.lit(r)) for r in (1, 10))
    return one.unionByName(ten).select("ratio", "left", "right", "label")


@query(_ratio_samples_sql(True))
def ratio_samples(spark, sf):
    return _ratio_samples(spark, sf, True)


@query(_ratio_samples_sql(False))
def ratio_samples_whole(spark, sf):
    return _ratio_samples(spark, sf, False)


# ---- co-occurrence


CO = ', co AS (SELECT a."right" AS s, b."right" AS v, count(*) AS co FROM {t} a JOIN {t} b ON a."left" = b."left" GROUP BY 1, 2), rd AS (SELECT "right", count(*) AS d FROM {t} GROUP BY 1), ld AS (SELECT "left", count(*) AS d FROM {t} GROUP BY 1)'


@query(base(more=CO.format(t="e")) + " SELECT s, v, co FROM co")
def item_cooccurrence(spark, sf):
    return cooc.cooccurrence(edges_of(spark, sf))


@query(base(more=CO.format(t="e")) + ' SELECT s, v, round(co / d, 6) AS p FROM co JOIN rd ON s = "right"')
def conditional_probability(spark, sf):
    return rounded(cooc.conditional_probability(stored(edges_of(spark, sf))), "p")


@query(base(more=CO.format(t="e")) + " SELECT s AS s1, v AS s2, co AS support FROM co WHERE s < v")
def pair_support(spark, sf):
    return cooc.combination_support(edges_of(spark, sf), 2).select(F.col("combo")[0].alias("s1"), F.col("combo")[1].alias("s2"), "support")


X = "(c::DOUBLE / n / ln(1 + dv.d) * ln(1 + du.d))::FLOAT"
OBS = {
    1: CO.format(t="tr") + f""", ob1 AS (SELECT * FROM (SELECT p."left", p."right", x.s::VARCHAR AS combo, {X.replace('c::DOUBLE / n', 'co.co::DOUBLE / ns.d')} AS x FROM pairs p JOIN (SELECT "left", "right" AS s FROM tr) x ON x."left" = p."left" JOIN co ON co.s = x.s AND co.v = p."right" JOIN rd ns ON ns."right" = x.s JOIN ld du ON du."left" = p."left" JOIN rd dv ON dv."right" = p."right") WHERE x > 1e-8)""",
    2: f""", tw AS (SELECT a."left", a."right" AS s1, b."right" AS s2 FROM tr a JOIN tr b ON a."left" = b."left" AND a."right" < b."right"), sup AS (SELECT s1, s2, count(*) AS n FROM tw GROUP BY 1, 2),
c2 AS (SELECT p."left", p."right", u.s1, u.s2, count(*) AS c FROM pairs p JOIN tr w ON w."right" = p."right" JOIN tw u ON u."left" = p."left" JOIN tw z ON z."left" = w."left" AND z.s1 = u.s1 AND z.s2 = u.s2 GROUP BY 1, 2, 3, 4),
ob2 AS (SELECT * FROM (SELECT c2."left", c2."right", c2.s1 || ',' || c2.s2 AS combo, {X} AS x FROM c2 JOIN sup ON sup.s1 = c2.s1 AND sup.s2 = c2.s2 JOIN ld du ON du."left" = c2."left" JOIN rd dv ON dv."right" = c2."right") WHERE x > 1e-8)""",
}


ORACLES["observations_written"] = eval_base() + OBS[1] + ' SELECT "left", "right", round(x::DOUBLE, 6) AS value FROM ob1'


def _obs(spark, sf, k):
    train, _, pairs = pairs_of(spark, sf)
    return cooc.observations(train, pairs, k)


def _shown(obs: DataFrame) -> DataFrame:
    return rounded(obs.withColumn("combo", F.array_join(F.col("combo").cast("array<string>"), ",")), "x")


@query(eval_base() + OBS[1] + ' SELECT "left", "right", combo, round(x::DOUBLE, 6) AS x FROM ob1')
def cond_observations_k1(spark, sf):
    return _shown(_obs(spark, sf, 1))


@query(eval_base() + OBS[1] + OBS[2] + ' SELECT "left", "right", combo, round(x::DOUBLE, 6) AS x FROM ob2')
def cond_observations_k2(spark, sf):
    return _shown(_obs(spark, sf, 2))


def _k3(spark, sf, thin):
    edges = stored(edges_of(spark, sf, thin))
    return lattice.observation_sums(edges, edges, 3)


@query(
    base(True) + CO.format(t="e") + f""", t3 AS (SELECT a."left", a."right" AS s1, b."right" AS s2, c."right" AS s3 FROM e a JOIN e b ON a."left" = b."left" AND a."right" < b."right" JOIN e c ON a."left" = c."left" AND b."right" < c."right"),
sup AS (SELECT s1, s2, s3, count(*) AS n, list("left") AS who FROM t3 GROUP BY 1, 2, 3), wl AS (SELECT s1, s2, s3, n, unnest(who) AS w FROM sup),
c3 AS (SELECT t3."left", e2."right", t3.s1, t3.s2, t3.s3, any_value(wl.n) AS n, count(*) AS c FROM t3 JOIN wl USING (s1, s2, s3) JOIN e e2 ON e2."left" = wl.w JOIN e p ON p."left" = t3."left" AND p."right" = e2."right" GROUP BY 1, 2, 3, 4, 5)
SELECT "left", "right", count(*) AS n, round(sum(x::DOUBLE), 6) AS s1 FROM (SELECT c3."left", c3."right", {X} AS x FROM c3 JOIN ld du ON du."left" = c3."left" JOIN rd dv ON dv."right" = c3."right") WHERE x > 1e-8 GROUP BY 1, 2"""
)
def cond_observations_k3(spark, sf):
    return rounded(_k3(spark, sf, True).select("left", "right", "n", "s1"), "s1")


#: Triples that another left node has too are listed; those of u alone are known by their number, each observed with every neighbour of u.
K3_WHOLE = (
    base()
    + CO.format(t="e")
    + f""", uw AS (SELECT a."left", b."left" AS w, list(a."right" ORDER BY a."right") AS s FROM e a JOIN e b ON a."right" = b."right" AND a."left" <> b."left" GROUP BY 1, 2 HAVING count(*) >= 3),
i1 AS (SELECT "left", w, s, unnest(range(1, len(s) - 1)) AS i FROM uw), i2 AS (SELECT *, unnest(range(i + 1, len(s))) AS j FROM i1), i3 AS (SELECT *, unnest(range(j + 1, len(s) + 1)) AS l FROM i2),
t3 AS MATERIALIZED (SELECT "left", w, s[i] AS s1, s[j] AS s2, s[l] AS s3 FROM i3), sup AS MATERIALIZED (SELECT "left", s1, s2, s3, 1 + count(*) AS n FROM t3 GROUP BY 1, 2, 3, 4),
hit AS (SELECT t3."left", t3.s1, t3.s2, t3.s3, p."right", count(*) AS c FROM t3 JOIN e v ON v."left" = t3.w JOIN e p ON p."left" = t3."left" AND p."right" = v."right" GROUP BY 1, 2, 3, 4, 5),
ct AS (SELECT p."left", p."right", n, 1 + coalesce(c, 0) AS c, count(*) AS t FROM e p JOIN sup ON sup."left" = p."left" LEFT JOIN hit ON hit."left" = p."left" AND hit."right" = p."right" AND hit.s1 = sup.s1 AND hit.s2 = sup.s2 AND hit.s3 = sup.s3 GROUP BY 1, 2, 3, 4
UNION ALL SELECT p."left", p."right", 1, 1, d * (d - 1) * (d - 2) // 6 - coalesce(k, 0) FROM e p JOIN ld USING ("left") LEFT JOIN (SELECT "left", count(*) AS k FROM sup GROUP BY 1) USING ("left")),
xs AS (SELECT ct."left", ct."right", t, {X}::DOUBLE AS x FROM ct JOIN ld du ON du."left" = ct."left" JOIN rd dv ON dv."right" = ct."right" WHERE t > 0)
SELECT "left", "right", sum(t)::BIGINT AS n, round(sum(t * x), 6) AS s1, round(sum(t * x * x), 6) AS s2, round(sum(t * x * x * x), 6) AS s3, round(sum(t * x * x * x * x), 6) AS s4, round(sum(-t * x * ln(x)), 6) AS raw_entropy FROM xs WHERE x > 1e-8 GROUP BY 1, 2"""
)


@query(K3_WHOLE)
def cond_observations_k3_whole(spark, sf):
    return rounded(_k3(spark, sf, False), "s1", "s2", "s3", "s4", "raw_entropy")


MOM = ', mo{k} AS (SELECT *, max(n) OVER (PARTITION BY "left") AS n_left FROM (SELECT "left", "right", count(*) AS n, sum(x::DOUBLE) AS s1, sum(x::DOUBLE * x::DOUBLE) AS s2, sum(x::DOUBLE * x::DOUBLE * x::DOUBLE) AS s3, sum(x::DOUBLE * x::DOUBLE * x::DOUBLE * x::DOUBLE) AS s4, sum(-x::DOUBLE * ln(x::DOUBLE)) AS raw_entropy FROM ob{k} GROUP BY 1, 2))'
SK = ", sk{k} AS (SELECT *, s1 / n_left AS m, s2 / n_left - (s1 / n_left) * (s1 / n_left) AS var, s3 / n_left - 3 * (s1 / n_left) * s2 / n_left + 2 * (s1 / n_left) * (s1 / n_left) * (s1 / n_left) AS m3, s4 / n_left - 4 * (s1 / n_left) * s3 / n_left + 6 * (s1 / n_left) * (s1 / n_left) * s2 / n_left - 3 * (s1 / n_left) * (s1 / n_left) * (s1 / n_left) * (s1 / n_left) AS m4, n_left::DOUBLE AS nn FROM mo{k})"
SKEW = "CASE WHEN nn >= 4 AND var > 1e-12 THEN sqrt(nn * (nn - 1)) / (nn - 2) * m3 / (var * sqrt(var)) ELSE 0 END"
KURT = "CASE WHEN nn >= 4 AND var > 1e-12 THEN (nn - 1) / ((nn - 2) * (nn - 3)) * ((nn + 1) * (m4 / (var * var) - 3) + 6) ELSE 0 END"
ENT = "CASE WHEN s1 > 1e-12 THEN ln(s1) - raw_entropy / s1 ELSE 10 END"
BIN = " + ".join(f"((s1 / n)::FLOAT >= {t}::FLOAT)::INT" for t in cooc.MEAN_EDGES)
K1 = eval_base() + OBS[1] + MOM.format(k=1) + SK.format(k=1)


def _moments(spark, sf):
    return cooc.observation_moments(_obs(spark, sf, 1))


@query(K1 + ' SELECT "left", "right", n, ' + ", ".join(f"round({c}, 6) AS {c}" for c in ("s1", "s2", "s3", "s4", "raw_entropy")) + " FROM mo1")
def cond_moments(spark, sf):
    return rounded(_moments(spark, sf), "s1", "s2", "s3", "s4", "raw_entropy")


@query(K1 + ' SELECT "left", "right", n, n_left FROM mo1')
def cond_left_max(spark, sf):
    return cooc.left_max_count(_moments(spark, sf)).select("left", "right", "n", "n_left")


@query(K1 + f' SELECT "left", "right", round({SKEW}, 4) + 0.0 AS skew, round({KURT}, 4) + 0.0 AS kurt FROM sk1')
def cond_skew_kurt(spark, sf):
    out = cooc.skew_kurtosis(cooc.left_max_count(_moments(spark, sf)))
    return out.select("left", "right", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("skew", "kurt")))


@query(K1 + f' SELECT "left", "right", round({ENT}, 6) + 0.0 AS entropy, round({ENT.replace("- raw", "+ raw")}, 6) + 0.0 AS shannon FROM mo1')
def cond_entropy(spark, sf):
    out = cooc.entropy(cooc.entropy(_moments(spark, sf)), shannon=True, name="shannon")
    return rounded(out.select("left", "right", "entropy", "shannon"), "entropy", "shannon")


@query(K1 + f' SELECT "left", "right", {BIN} AS mean_bin, round((1.0 / n)::FLOAT::DOUBLE, 6) AS weight FROM mo1')
def cond_mean_bins(spark, sf):
    hot = cooc.mean_bin_onehot(_moments(spark, sf))
    weights = [F.col(f"bin_{i}") for i in range(cooc.BINS)]
    at = sum((F.when(w > 0, F.lit(i)).otherwise(F.lit(0)) for i, w in enumerate(weights)), F.lit(0))
    return rounded(hot.select("left", "right", at.cast("int").alias("mean_bin"), F.greatest(*weights).alias("weight")), "weight")


HB = "greatest(0, least(9, floor(x * 10::FLOAT)::INT))"


@query(K1 + ' SELECT "left", "right", ' + ", ".join(f"count(*) FILTER (WHERE {HB} = {i}) AS hist_{i}" for i in range(10)) + " FROM ob1 GROUP BY 1, 2")
def cond_histogram(spark, sf):
    return cooc.observation_histogram(_obs(spark, sf, 1))


FULL = eval_base() + OBS[1] + MOM.format(k=1) + SK.format(k=1) + OBS[2] + MOM.format(k=2) + SK.format(k=2)


def _block_sql(k: int, i: int) -> str:
    return f', fb{i} AS (SELECT "left", "right", ({BIN}) AS mb, n, round(({KURT})::FLOAT::DOUBLE, 3) AS kurt, round(({SKEW})::FLOAT::DOUBLE, 3) AS skew, round(({ENT})::FLOAT::DOUBLE, 4) AS entropy FROM sk{k})'


def _feature_select(i: int) -> str:
    bins = ", ".join(f"round(coalesce(CASE WHEN f{i}.mb = {b} THEN (1.0 / f{i}.n)::FLOAT::DOUBLE END, 0), 6) AS bin_{b}_{i}" for b in range(10))
    return bins + ", " + ", ".join(f"coalesce(f{i}.{c}, 0) + 0.0 AS {c}_{i}" for c in ("kurt", "skew", "entropy"))


FEATURES = FULL + _block_sql(1, 0) + _block_sql(2, 1)
FROM = ' FROM (SELECT DISTINCT "left", "right" FROM pairs) p LEFT JOIN fb0 f0 ON f0."left" = p."left" AND f0."right" = p."right" LEFT JOIN fb1 f1 ON f1."left" = p."left" AND f1."right" = p."right"'
LOGD = ', round(ln(1 + coalesce(du.d, 0))::FLOAT::DOUBLE, 5) AS ldeg, round(ln(1 + coalesce(dv.d, 0))::FLOAT::DOUBLE, 5) AS rdeg'
LOGF = ' LEFT JOIN ld du ON du."left" = p."left" LEFT JOIN rd dv ON dv."right" = p."right"'


def _features(df: DataFrame) -> DataFrame:
    """Rounded as the float columns allow."""
    digits = {"bin": 6, "kur": 3, "ske": 3, "ent": 4, "lde": 5, "rde": 5}
    return df.select("left", "right", *((F.round(F.col(c).cast("double"), digits[c[:3]]) + F.lit(0.0)).alias(c) for c in df.columns[2:]))


@query(FEATURES + ' SELECT p."left", p."right", ' + _feature_select(0) + ", " + _feature_select(1) + FROM)
def pair_features(spark, sf):
    train, _, pairs = pairs_of(spark, sf)
    return _features(cooc.pair_features(train, pairs))


@query(eval_base() + CO.format(t="tr") + ' SELECT p."left", p."right"' + LOGD + " FROM pairs p" + LOGF)
def pair_log_degrees(spark, sf):
    train, _, pairs = pairs_of(spark, sf)
    return _features(cooc.log_degrees(train, pairs))


@query(FEATURES + ' SELECT p."left", p."right", ' + _feature_select(0) + ", " + _feature_select(1) + LOGD + FROM + LOGF)
def feature_matrix(spark, sf):
    train, _, pairs = pairs_of(spark, sf)
    return _features(cooc.feature_matrix(train, pairs))


# ---- path scores


P3 = ', p3 AS (SELECT p."left", p."right", count(*) AS paths FROM pairs p JOIN tr x ON x."left" = p."left" JOIN tr y ON y."right" = x."right" JOIN tr z ON z."left" = y."left" AND z."right" = p."right" GROUP BY 1, 2)'


@query(eval_base() + P3 + ' SELECT "left", "right", paths FROM p3')
def path3_counts(spark, sf):
    train, _, pairs = pairs_of(spark, sf)
    return paths.path3_count(train, pairs)


KATZ = P3 + ', kz AS (SELECT "left", "right", sum(t) AS score FROM (SELECT "left", "right", paths * 0.005::DOUBLE * 0.005 * 0.005 AS t FROM p3 UNION ALL SELECT tr."left", tr."right", 0.005::DOUBLE FROM tr JOIN pairs USING ("left", "right")) GROUP BY 1, 2)'


@query(eval_base() + KATZ + ' SELECT "left", "right", round(score, 12) AS score FROM kz')
def katz_3(spark, sf):
    train, _, pairs = pairs_of(spark, sf)
    return paths.katz(train, 3, 0.005, pairs).withColumn("score", F.round("score", 12))


#: Walks by the numbers of steps between left nodes (w2) and from right to left ones (b3), for all pairs at once.
WALKS = ', w2 AS MATERIALIZED (SELECT a."left" AS u, b."left" AS b, count(*) AS n FROM tr a JOIN tr b ON a."right" = b."right" GROUP BY 1, 2), b3 AS MATERIALIZED (SELECT z."right" AS v, w2.u AS b, sum(n)::BIGINT AS n FROM tr z JOIN w2 ON w2.b = z."left" GROUP BY 1, 2)'
KATZ5 = WALKS + ', k5 AS (SELECT "left", "right", sum(t) AS score FROM (SELECT p."left", p."right", 0.00000031250::DOUBLE * sum(w2.n * b3.n) AS t FROM pairs p JOIN w2 ON w2.u = p."left" JOIN b3 ON b3.v = p."right" AND b3.b = w2.b GROUP BY 1, 2 UNION ALL SELECT p."left", p."right", 0.000125::DOUBLE * b3.n FROM pairs p JOIN b3 ON b3.v = p."right" AND b3.b = p."left" UNION ALL SELECT "left", "right", 0.05::DOUBLE FROM tr JOIN pairs USING ("left", "right")) GROUP BY 1, 2)'


@query(eval_base() + KATZ5 + ' SELECT "left", "right", round(score, 10) AS score FROM k5')
def katz_5(spark, sf):
    """Length 5 and beta 0.05, the defaults."""
    train, _, pairs = pairs_of(spark, sf)
    return paths.katz(train, pairs=pairs).withColumn("score", F.round("score", 10))


def _distance_sql(limit: int) -> str:
    sql = ', b1 AS (SELECT "left", "right", 1 AS d FROM tr), v1 AS (SELECT DISTINCT "left", "left" AS b FROM tr)'
    for d in range(3, limit + 1, 2):
        sql += f', n{d} AS (SELECT DISTINCT f."left", e2."left" AS b FROM b{d - 2} f JOIN tr e2 ON e2."right" = f."right" WHERE f.d = {d - 2} AND NOT EXISTS (SELECT 1 FROM v{d - 2} v WHERE v."left" = f."left" AND v.b = e2."left")), v{d} AS (SELECT * FROM v{d - 2} UNION SELECT * FROM n{d}), b{d} AS (SELECT * FROM b{d - 2} UNION ALL SELECT DISTINCT n."left", e3."right", {d} FROM n{d} n JOIN tr e3 ON e3."left" = n.b WHERE NOT EXISTS (SELECT 1 FROM b{d - 2} q WHERE q."left" = n."left" AND q."right" = e3."right"))'
    return sql + f', gd AS (SELECT "left", "right", round(1.0 / d, 6)::DOUBLE AS score FROM b{limit} JOIN pairs USING ("left", "right") WHERE d > 1)'


@query(eval_base(True) + _distance_sql(3) + ' SELECT "left", "right", score FROM gd')
def graph_distance_3(spark, sf):
    train, _, pairs = pairs_of(spark, sf, True)
    return rounded(paths.graph_distance(train, 3, pairs=pairs), "score")


@query(eval_base() + _distance_sql(3) + ' SELECT "left", "right", score FROM gd')
def graph_distance_3_whole(spark, sf):
    train, _, pairs = pairs_of(spark, sf)
    return rounded(paths.graph_distance(train, 3, pairs=pairs), "score")


@query(eval_base(True) + _distance_sql(5) + ' SELECT "left", "right", score FROM gd')
def graph_distance_5(spark, sf):
    train, _, pairs = pairs_of(spark, sf, True)
    return rounded(paths.graph_distance(train, 5, pairs=pairs), "score")


@query(eval_base() + _distance_sql(5) + ' SELECT "left", "right", score FROM gd')
def graph_distance_5_whole(spark, sf):
    train, _, pairs = pairs_of(spark, sf)
    return rounded(paths.graph_distance(train, 5, pairs=pairs), "score")


def _l3_sql(factor: str) -> str:
    return f', w AS (SELECT tr."left", tr."right", 1 / sqrt({factor} * rd.d * ld.d) AS w FROM tr JOIN (SELECT "right", count(*) AS d FROM tr GROUP BY 1) rd USING ("right") JOIN (SELECT "left", count(*) AS d FROM tr GROUP BY 1) ld USING ("left")), l3 AS (SELECT p."left", p."right", sum(y.w) AS score FROM pairs p JOIN tr x ON x."left" = p."left" JOIN w y ON y."right" = x."right" JOIN tr z ON z."left" = y."left" AND z."right" = p."right" WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr."left" = p."left" AND tr."right" = p."right") GROUP BY 1, 2)'


@query(eval_base() + _l3_sql("2.0") + ' SELECT "left", "right", round(score, 6) AS score FROM l3')
def l3_scores(spark, sf):
    train, _, pairs = pairs_of(spark, sf)
    return rounded(paths.l3(train, pairs), "score")


@query(eval_base() + _l3_sql("1.0") + ' SELECT "left", "right", round(score, 6) AS score FROM l3')
def l3_scores_published(spark, sf):
    train, _, pairs = pairs_of(spark, sf)
    return rounded(paths.l3(train, pairs, "published"), "score")


@query(eval_base() + _l3_sql("1.0").replace('count(*) AS d FROM tr GROUP BY 1) rd', 'sum(1 + ("left" * 7 + "right") % 5) AS d FROM tr GROUP BY 1) rd').replace('count(*) AS d FROM tr GROUP BY 1) ld', 'sum(1 + ("left" * 7 + "right") % 5) AS d FROM tr GROUP BY 1) ld') + ' SELECT "left", "right", round(score, 6) AS score FROM l3')
def l3_scores_weighted(spark, sf):
    """Degrees as sums of weights, negative ones by their size."""
    train, _, pairs = pairs_of(spark, sf)
    size = 1 + (F.col("left") * 7 + F.col("right")) % 5
    return rounded(paths.l3(train.withColumn("weight", F.when(F.col("left") % 2 == 0, size).otherwise(-size)), pairs, "published", weight="weight"), "score")


@query(eval_base() + P3 + ' SELECT "left", "right", paths, rank FROM (SELECT *, row_number() OVER (PARTITION BY "left" ORDER BY paths DESC, "right") AS rank FROM p3) WHERE rank <= 5')
def ranked_predictions(spark, sf):
    train, _, pairs = pairs_of(spark, sf)
    return paths.rank_predictions(paths.path3_count(train, pairs), 5, "paths").withColumn("rank", F.col("rank").cast("long"))


# ---- embeddings


VEC = "WITH v AS (SELECT vec_id AS node, embedding FROM embeddings), n AS (SELECT count(*) AS n FROM v), pr AS (SELECT node AS \"left\", (node * 7 + 3) % n AS \"right\" FROM v, n)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))


def _vector_pairs(v: DataFrame) -> DataFrame:
    n = v.count()
    return v.select(F.col("node").alias("left"), ((F.col("node") * 7 + 3) % n).alias("right"))


@query(VEC + ' SELECT "left", "right", round(coalesce(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 0), 6) + 0.0 AS score FROM pr LEFT JOIN v a ON a.node = "left" LEFT JOIN v b ON b.node = "right"')
def dot_scores(spark, sf):
    v = _vectors(spark, sf)
    return rounded(embed.score_dot(_vector_pairs(v), v), "score")


@query(VEC + ', li AS (SELECT "left" AS node, "right" AS t FROM pr UNION ALL SELECT "right", "left" FROM pr), ex AS (SELECT node AS t, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM v) SELECT li.node, pos::INT AS pos, round(avg(x), 6) + 0.0 AS x FROM li JOIN ex USING (t) GROUP BY 1, 2')
def neighbor_mean(spark, sf):
    v = _vectors(spark, sf)
    means = embed.neighbor_mean(v, _vector_pairs(v))
    return rounded(means.select("node", F.posexplode("vec").alias("pos", "x")), "x")


@query()
def edge_embeddings(spark, sf):
    return embed.train_edge_embeddings(graph.offset_right_ids(edges_of(spark, sf)), seed=1)


def _weights_sql() -> str:
    """The fixed weights as lists of columns, and both layers by unnested products."""
    w = embed.random_weights(64, 64, 32, 1)
    lists = {k: "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in col) + "]" for col in w[k].T) + "]" for k in ("m1", "s1", "m2", "s2")}
    means = lambda src: f"SELECT node, list(x ORDER BY pos) AS x FROM (SELECT li.node, pos, avg(x) AS x FROM li JOIN (SELECT node AS t, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM {src}) USING (t) GROUP BY 1, 2) GROUP BY 1"
    layer = lambda m, s, mean, own: f"SELECT o.node, list_transform(range(1, len(w.{m}) + 1), lambda j: list_dot_product(a.x, w.{m}[j]) + list_dot_product(o.x, w.{s}[j])) AS x FROM {own} o JOIN {mean} a USING (node), w"
    return (
        VEC
        + ', li AS (SELECT "left" AS node, "right" AS t FROM pr UNION ALL SELECT "right", "left" FROM pr), w AS (SELECT '
        + ", ".join(f"{v}::DOUBLE[][] AS {k}" for k, v in lists.items())
        + f"), x0 AS (SELECT node, embedding::DOUBLE[] AS x FROM v), a0 AS ({means('x0')}), p1 AS ({layer('m1', 's1', 'a0', 'x0')}), x1 AS (SELECT node, list_transform(x, lambda y: greatest(y, 0)) AS x FROM p1), a1 AS ({means('x1')}), p2 AS ({layer('m2', 's2', 'a1', 'x1')})"
        + " SELECT node, (generate_subscripts(x, 1) - 1)::INT AS pos, round(unnest(x), 6) + 0.0 AS x FROM p2"
    )


@query(_weights_sql())
def sage_forward_values(spark, sf):
    """The vectors of ``sage_forward``, a row a component."""
    return rounded(sage_forward(spark, sf).select("node", F.posexplode("vec").alias("pos", "x")), "x")


@query()
def sage_forward(spark, sf):
    v = _vectors(spark, sf).withColumn("vec", F.col("vec").cast("array<double>"))
    return embed.sage_forward(v, _vector_pairs(v), embed.random_weights(64, 64, 32, 1))


@query()
def sage_embeddings(spark, sf):
    return embed.train_sage(graph.offset_right_ids(edges_of(spark, sf)), seed=1)


# ---- evaluation, model, jobs


ATT = KATZ + EVAL + ', att AS (SELECT ev."left", ev."right", label, coalesce(score, 0)::FLOAT AS score FROM ev LEFT JOIN kz ON kz."left" = ev."left" AND kz."right" = ev."right")'
METRIC = """, st AS (SELECT ratio, score, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY 1, 2), ru AS (SELECT *, sum(pos) OVER (PARTITION BY ratio ORDER BY score DESC) AS pr, sum(neg) OVER (PARTITION BY ratio ORDER BY score DESC) AS nr FROM st),
me AS (SELECT ratio, sum(neg * (pr - pos + pos / 2.0))::DOUBLE / (sum(pos)::DOUBLE * sum(neg)) AS auroc, sum(pos * (pr::DOUBLE / (pr + nr))) / sum(pos) AS aupr, (sum(pos) + sum(neg))::BIGINT AS n_samples FROM ru GROUP BY 1)"""


def _scored(spark, sf):
    train, test, pairs = pairs_of(spark, sf)
    ev = stored(sampling.build_eval_pairs(pairs, train, test))
    return stored(evaluate.attach_scores(ev, paths.katz(train, 3, 0.005, ev)))


@query(eval_base() + ATT + ' SELECT "left", "right", label, round(score::DOUBLE, 12) AS score FROM att')
def attach_scores(spark, sf):
    return _scored(spark, sf).withColumn("score", F.round(F.col("score").cast("double"), 12))


@query(eval_base() + ATT + ", s AS (SELECT 0 AS ratio, label, score FROM att)" + METRIC.format(src="s") + " SELECT round(auroc, 6) AS auroc FROM me")
def auroc(spark, sf):
    return rounded(evaluate.auroc(_scored(spark, sf)), "auroc")


@query(eval_base() + ATT + ", s AS (SELECT 0 AS ratio, label, score FROM att)" + METRIC.format(src="s") + " SELECT round(aupr, 6) AS aupr FROM me")
def average_precision(spark, sf):
    return rounded(evaluate.average_precision(_scored(spark, sf)), "aupr")


def _ratio_sql(src: str, ratios: tuple[int, ...], seed: int) -> str:
    parts = " UNION ALL ".join(f'SELECT {r} AS ratio, label, score FROM {src} WHERE label = 1 UNION ALL SELECT {r}, label, score FROM (SELECT label, score, row_number() OVER (ORDER BY {key(seed, str(r), chr(34) + "left" + chr(34), chr(34) + "right" + chr(34))}, "left", "right") AS k FROM {src} WHERE label = 0) WHERE k <= {r} * (SELECT count(*) FROM {src} WHERE label = 1)' for r in ratios)
    return f", s AS ({parts})"


@query(eval_base() + ATT + _ratio_sql("att", (1, 10, 100), 0) + METRIC.format(src="s") + " SELECT ratio, round(auroc, 4) AS auroc, round(aupr, 4) AS aupr, n_samples FROM me")
def evaluation_report(spark, sf):
    """Its SQL has one non-edge for each test edge, so all three rows hold the pairs of 1:1; see ``evaluation_report_whole``."""
    return evaluate.evaluate_at_ratios(_scored(spark, sf))


ATT_ALL = WALKS + EVAL + ', att AS (SELECT ev."left", ev."right", label, coalesce(b3.n * 0.005::DOUBLE * 0.005 * 0.005, 0)::FLOAT AS score FROM ev LEFT JOIN b3 ON b3.v = ev."right" AND b3.b = ev."left")'


@query(
    base(False, SPLIT + negatives_sql("(SELECT least(100 * (SELECT count(*) FROM te), (SELECT count(DISTINCT \"left\") * count(DISTINCT \"right\") - count(*) FROM e)))") + PAIRS)
    + ATT_ALL + _ratio_sql("att", (1, 10, 100), 0) + METRIC.format(src="s")
    + " SELECT ratio, round(auroc, 4) AS auroc, round(aupr, 4) AS aupr, n_samples, round(n_samples / (SELECT sum(label) FROM att) - 1, 4) AS reached FROM me"
)
def evaluation_report_whole(spark, sf):
    """The report on 100 non-edges for each test edge, or all that the graph has; ``reached`` is the ratio that a row really has."""
    edges = stored(edges_of(spark, sf))
    train, test = (stored(d) for d in sampling.holdout_per_left(edges, 0.2, 1))
    pairs = stored(test.unionByName(sampling.sample_negatives_up_to(edges, 100 * test.count(), 1)))
    ev = stored(sampling.build_eval_pairs(pairs, train, test))
    scored = stored(evaluate.attach_scores(ev, paths.katz(train, 3, 0.005, ev)))
    return evaluate.evaluate_at_ratios(scored, reached=True)


SCORED = KATZ + _l3_sql("2.0") + _distance_sql(5) + EVAL + "".join(f', a_{s} AS (SELECT ev."left", ev."right", label, coalesce(q.score, 0)::FLOAT AS score FROM ev LEFT JOIN {s} q ON q."left" = ev."left" AND q."right" = ev."right")' for s in ("kz", "l3", "gd"))


def _report_sql(thin: bool = True) -> str:
    one = lambda s: METRIC.format(src=f"s_{s}").replace("st AS", f"st_{s} AS").replace("FROM st)", f"FROM st_{s})").replace("ru AS", f"ru_{s} AS").replace("FROM ru ", f"FROM ru_{s} ").replace("me AS", f"me_{s} AS")
    names = {"kz": "katz", "gd": "graph_distance", "l3": "l3"}
    sql = eval_base(thin) + SCORED + "".join(f", s_{s} AS (SELECT 1 AS ratio, label, score FROM a_{s})" + one(s) for s in names)
    return sql + " " + " UNION ALL ".join(f"SELECT '{n}' AS model, ratio, round(auroc, 4) AS auroc, round(aupr, 4) AS aupr, n_samples FROM me_{s}" for s, n in names.items())


@query(_report_sql())
def baseline_report(spark, sf):
    """Holdout, non-edges, three path scorers, AUROC and average precision, on the thin graph."""
    train, test, pairs = pairs_of(spark, sf, True)
    return jobs.run_baselines(jobs.Split(train, test, pairs), jobs.PATH_SCORERS, ratios=(1,))


@query(_report_sql(False))
def baseline_report_whole(spark, sf):
    """The baseline report on the whole graph."""
    train, test, pairs = pairs_of(spark, sf)
    return jobs.run_baselines(jobs.Split(train, test, pairs), jobs.PATH_SCORERS, ratios=(1,))


@query()
def baseline_report_full(spark, sf):
    """All five scorers at 1:1, 1:10 and 1:100 on the whole graph, or with all non-edges that it has."""
    edges = stored(edges_of(spark, sf))
    train, test = (stored(d) for d in sampling.holdout_per_left(edges, 0.2, 1))
    pairs = stored(test.unionByName(sampling.sample_negatives_up_to(edges, 100 * test.count(), 1)))
    return jobs.run_baselines(jobs.Split(train, test, pairs), ratios=(1, 10, 100))


def _gbt(spark, sf):
    """(half, left, right, label, score): a classifier learns from one half of the pairs, by hash, and scores both."""
    train, test, pairs = pairs_of(spark, sf)
    rows = cooc.feature_matrix(train, pairs).join(sampling.build_eval_pairs(pairs, train, test), ["left", "right"])
    rows = stored(rows.withColumn("half", (hash_key(6, "left", "right") % 2).cast("int")))
    model = train_link_classifier(rows.where("half = 0"), cooc.feature_subsets()["Full"])
    return predict_pairs(model, rows).select("half", "left", "right", "label", "score")


@query(_report_sql(False).replace("SELECT 'katz' AS model", "SELECT 'g' AS dataset, 1 AS seed, 'all' AS sampling, 'katz' AS model").replace("SELECT 'graph_distance' AS model", "SELECT 'g', 1, 'all', 'graph_distance'").replace("SELECT 'l3' AS model", "SELECT 'g', 1, 'all', 'l3'"))
def grid_report(spark, sf):
    """A grid of one data set, one way of sampling that keeps all edges, and one seed; rows as appended to a file and read back."""
    path = new_path(spark)
    whole = edges_of(spark, sf)
    report = lambda split: jobs.run_baselines(split, jobs.PATH_SCORERS, ratios=(1,))
    jobs.run_grid(spark, {"g": whole}, path, seeds=(1,), samplings=("all",), job=report, prepared=lambda edges, seed, sampling: jobs.prepare(edges, seed))
    return spark.read.schema("dataset string, seed int, sampling string, model string, ratio int, auroc double, aupr double, n_samples long").option("header", True).csv(path)


@query()
def gbt_scores(spark, sf):
    """Probabilities of the half that nothing was learnt from; ``gbt_report`` has SQL."""
    return _gbt(spark, sf).where("half = 1").drop("half")


@query(eval_base() + f""", hv AS (SELECT {key(6, '"left"', '"right"')} % 2 AS half, label FROM (SELECT "left", "right", 1 AS label FROM te UNION ALL SELECT "left", "right", 0 FROM neg)) SELECT half::INT AS half, count(*) AS n, sum(label)::BIGINT AS positives, count(*) AS probabilities, half = 0 AS learnt FROM hv GROUP BY half""")
def gbt_report(spark, sf):
    """Of each half: rows, positives, scores within 0 and 1; and whether the half that taught is ranked well above chance."""
    scored = stored(_gbt(spark, sf))
    counts = scored.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("positives"), F.count(F.when(F.col("score").between(0, 1), 1)).alias("probabilities"))
    area = evaluate.ranking_metrics(scored, ["half"]).select("half", ((F.col("half") == 0) & (F.col("auroc") > 0.55)).alias("learnt"))
    return counts.join(area, "half")


@query()
def feature_experiment(spark, sf):
    train, test, _ = pairs_of(spark, sf)
    edges = train.unionByName(test)
    # 10 for each train edge and 100 for each test edge
    negatives = sampling.sample_negatives_up_to(stored(edges), 10 * train.count() + 100 * test.count(), 1, by_degree=True)
    split = jobs.Split(train, test, stored(edges.unionByName(negatives)))
    return jobs.run_feature_experiment(split)
