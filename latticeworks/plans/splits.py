"""Leakage-controlled splits: every draw is a hash rank, so that any engine repeats it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticeworks.operators.folds import group_folds
from latticeworks.operators.ranks import take_by_hash
from latticeworks.plans.common import hash_unit
from latticeworks.registry import query

_KEY_SQL = "SELECT p_partkey, p_name || '|' || CAST(CAST(floor(p_retailprice / 10) AS INTEGER) AS VARCHAR) AS key, p_type AS stratum, p_size FROM part"


def _keyed(t):
    key = F.concat_ws("|", "p_name", F.floor(F.col("p_retailprice") / 10).cast("int").cast("string"))
    return t.part.select("p_partkey", key.alias("key"), F.col("p_type").alias("stratum"), "p_size")


_HOLD_SQL = f"k AS ({_KEY_SQL}), g AS (SELECT key, row_number() OVER (ORDER BY md5('h|' || key), key) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT key FROM k))"


@query(f"WITH {_HOLD_SQL} SELECT p_partkey, CASE WHEN r <= greatest(1, floor(n * 0.02)) THEN 'val' ELSE 'train' END AS split FROM k JOIN g USING (key)")
def group_holdout(t):
    """Two percent of the groups, by hash rank."""
    k = _keyed(t)
    g = k.select("key").distinct().withColumn("h", F.md5(F.concat(F.lit("h|"), F.col("key"))))
    g = take_by_hash(g, "h", ["key"], lambda n: F.greatest(F.lit(1), F.floor(n * 0.02)))
    return k.join(g, "key").select("p_partkey", F.when(F.col("taken"), "val").otherwise("train").alias("split"))


_STRAT_SQL = f"""k AS ({_KEY_SQL}), g AS (SELECT key, min(stratum) AS stratum, count(*) AS size, max(p_size) AS top FROM k GROUP BY key),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('s|' || key), key) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM g),
s AS (SELECT key, stratum, CASE WHEN n >= 2 AND r <= greatest(1, round_even(n * 0.05, 0)) THEN 'val' ELSE 'train' END AS split FROM r)"""


def _group_split(t):
    k = _keyed(t)
    g = k.groupBy("key").agg(F.min("stratum").alias("stratum"))
    g = g.withColumn("h", F.md5(F.concat(F.lit("s|"), F.col("key"))))
    g = take_by_hash(g, "h", ["key"], lambda n: F.when(n >= 2, F.greatest(F.lit(1), F.bround(n * 0.05, 0))).otherwise(0), ["stratum"])
    return k, g.select("key", F.when(F.col("taken"), "val").otherwise("train").alias("split"))


@query(f"WITH {_STRAT_SQL} SELECT p_partkey, split FROM k JOIN s USING (key)")
def stratified_group_split(t):
    k, s = _group_split(t)
    return k.join(s, "key").select("p_partkey", "split")


@query(f"WITH {_STRAT_SQL} SELECT count(*) AS leaks FROM (SELECT key FROM k JOIN s USING (key) GROUP BY key HAVING count(DISTINCT split) > 1)")
def group_key_leakage(t):
    k, s = _group_split(t)
    return k.join(s, "key").groupBy("key").agg(F.count_distinct("split").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("leaks"))


@query("SELECT doc_id, CASE WHEN r <= greatest(1, floor(n * 0.05)) THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('r|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def row_stratified_split(t):
    """Five percent of each stratum, by hash rank."""
    own = t.documents.select("doc_id", "lang", F.md5(F.concat(F.lit("r|"), F.col("doc_id").cast("string"))).alias("h"))
    own = take_by_hash(own, "h", ["doc_id"], lambda n: F.greatest(F.lit(1), F.floor(n * 0.05)), ["lang"])
    return own.select("doc_id", F.when(F.col("taken"), "test").otherwise("train").alias("split"))


_FOLD_SQL = """
WITH RECURSIVE g AS (SELECT c_nationkey AS key, count(*) AS size FROM customer GROUP BY 1), o AS (SELECT key, size, row_number() OVER (ORDER BY size DESC, key) AS r FROM g),
f(r, key, fold, loads) AS (
  SELECT 0, -1, -1, [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL
  SELECT o.r, o.key, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + o.size ELSE x END)
  FROM f JOIN o ON o.r = f.r + 1)
SELECT c_custkey, CAST(fold AS INTEGER) AS fold FROM customer JOIN f ON c_nationkey = key"""


@query(_FOLD_SQL)
def group_kfold(t):
    """Five folds of whole groups: largest group first into the lightest fold."""
    folds = group_folds(t.customer, "c_nationkey", 5)
    return t.customer.join(folds, "c_nationkey").select("c_custkey", "fold")


@query(_FOLD_SQL.replace("c_nationkey", "p_name").replace("customer", "part").replace("c_custkey", "p_partkey").replace("-1, -1, -1", "-1, '', -1").replace("SELECT 0, -1", "SELECT 0, ''"))
def group_kfold_text(t):
    """The same over texts as keys, most of them groups of one or two rows."""
    folds = group_folds(t.part, "p_name", 5)
    return t.part.join(folds, "p_name").select("p_partkey", "fold")


_ATTEMPTS_SQL = """WITH g AS (SELECT DISTINCT c_nationkey AS key FROM customer), a AS (SELECT attempt, key, row_number() OVER (PARTITION BY attempt ORDER BY md5(attempt || '|' || key), key) AS r FROM g, (SELECT unnest(range(0, 30)) AS attempt)),
v AS (SELECT attempt, count(DISTINCT c_mktsegment || n_regionkey) AS coverage FROM a JOIN customer ON c_nationkey = key JOIN nation ON n_nationkey = key WHERE r <= 5 GROUP BY attempt)
SELECT attempt, coverage FROM v ORDER BY coverage DESC, attempt LIMIT 1"""


@query(_ATTEMPTS_SQL)
def inner_split_best_coverage(t):
    """Thirty seeded draws of five groups; the one that covers most labels wins. Labels are gathered by group first, so draws meet groups, not rows."""
    own = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    labels = own.groupBy(F.col("c_nationkey").alias("key")).agg(F.collect_set(F.concat("c_mktsegment", F.col("n_regionkey").cast("string"))).alias("labels"))
    drawn = labels.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    r = F.row_number().over(Window.partitionBy("attempt").orderBy(F.md5(F.concat_ws("|", F.col("attempt").cast("string"), F.col("key").cast("string"))), "key"))
    chosen = drawn.withColumn("r", r).where("r <= 5").groupBy("attempt").agg(F.size(F.array_distinct(F.flatten(F.collect_list("labels")))).cast("long").alias("coverage"))
    return chosen.orderBy(F.desc("coverage"), "attempt").limit(1).select("attempt", "coverage")


@query("WITH n AS (SELECT l_orderkey, count(*) AS phases FROM lineitem GROUP BY 1) SELECT 'train' AS role, count(*) AS n FROM n WHERE phases = 1 UNION ALL SELECT 'test', count(*) FROM n WHERE phases > 1 UNION ALL SELECT 'shared', count(*) FROM n WHERE phases IN (1, 2)")
def single_phase_subset(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("phases"))
    counts = n.agg(F.count_if(F.col("phases") == 1).alias("train"), F.count_if(F.col("phases") > 1).alias("test"), F.count_if(F.col("phases").isin(1, 2)).alias("shared"))
    return counts.unpivot([], ["train", "test", "shared"], "role", "n")


@query("SELECT doc_id, source || '|' || CAST(quality IS NOT NULL AS INTEGER) || CAST(coalesce(toxic = 1, false) AS INTEGER) AS stratum FROM documents LEFT JOIN labels USING (doc_id)")
def stratum_key(t):
    own = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return own.select("doc_id", F.concat("source", F.lit("|"), F.col("quality").isNotNull().cast("int").cast("string"), F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int").cast("string")).alias("stratum"))


@query("""WITH k AS (SELECT c_custkey, c_acctbal, CAST('0x' || substr(md5('t|' || c_custkey), 1, 6) AS BIGINT) / 16777216.0::DOUBLE < 0.8 AS train FROM customer), m AS (SELECT avg(c_acctbal) AS mu, stddev_pop(c_acctbal) + 1e-6 AS sd FROM k WHERE train)
SELECT c_custkey, round((c_acctbal - mu) / sd, 6) AS z FROM k, m""")
def standardise_train_only(t):
    """Mean and deviation come from the training part only."""
    k = t.customer.select("c_custkey", "c_acctbal", (hash_unit("t", "c_custkey") < 0.8).alias("train"))
    m = k.where("train").agg(F.avg("c_acctbal").alias("mu"), (F.stddev_pop("c_acctbal") + 1e-6).alias("sd"))
    return k.join(F.broadcast(m)).select("c_custkey", F.round((F.col("c_acctbal") - F.col("mu")) / F.col("sd"), 6).alias("z"))
