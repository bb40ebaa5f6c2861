"""Joins, aggregations, windows, set operations and predicates of the sample tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticeworks.operators.ranks import percentiles
from latticeworks.operators.relational import flag_membership, keep_one, one_to_one_left
from latticeworks.plans.common import hash_mod, hash_unit
from latticeworks.registry import query

# --- de-duplication ------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def dedup_keep_last(t):
    return keep_one(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_md5_keep_first(t):
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT count(*) - count(DISTINCT md5(text)) AS duplicates FROM documents")
def dup_count(t):
    return t.documents.select((F.md5("text")).alias("d")).agg((F.count(F.lit(1)) - F.count_distinct("d")).alias("duplicates"))


# --- masks and roles -----------------------------------------------------------------------------------------------

_MASKS_SQL = "SELECT d.doc_id, CAST(quality IS NOT NULL AS INTEGER) AS m_quality, CAST(coalesce(toxic = 1, false) AS INTEGER) AS m_toxic, CAST(n_chars >= 50 AS INTEGER) AS m_text, d.source, quality FROM documents d LEFT JOIN labels USING (doc_id)"


def _masks(t):
    own = t.documents.join(t.labels, "doc_id", "left")
    return own.select("doc_id", F.col("quality").isNotNull().cast("int").alias("m_quality"), F.coalesce((F.col("toxic") == 1), F.lit(False)).cast("int").alias("m_toxic"), (F.col("n_chars") >= 50).cast("int").alias("m_text"), "source", "quality")


@query(f"SELECT doc_id, m_quality, m_toxic, m_text, row_number() OVER (ORDER BY doc_id) - 1 AS ft_row FROM ({_MASKS_SQL}) WHERE m_quality + m_toxic > 0")
def head_masks_pool(t):
    """The pool keeps rows with a label; its row number is a rank by id, counted over distributed id buckets."""
    pool = _masks(t).where("m_quality + m_toxic > 0").withColumn("bucket", F.floor(F.col("doc_id") / 65_536))
    sizes = pool.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id"))
    return pool.withColumn("own", own).join(first.select("bucket", "first"), "bucket").select("doc_id", "m_quality", "m_toxic", "m_text", (F.col("first") + F.col("own") - 1).alias("ft_row"))


@query(f"SELECT CASE WHEN m_quality = 1 THEN 'ft' WHEN source IN ('src0', 'src1', 'src2') THEN 'pretrain' ELSE 'unlabeled' END AS split_role, count(*) AS n FROM ({_MASKS_SQL}) GROUP BY 1")
def split_role_case(t):
    role = F.when(F.col("m_quality") == 1, "ft").when(F.col("source").isin("src0", "src1", "src2"), "pretrain").otherwise("unlabeled")
    return _masks(t).groupBy(role.alias("split_role")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, CASE WHEN l_tax BETWEEN 0.035 AND 0.055 THEN 'band' WHEN abs(l_tax - 0.02) < 0.001 THEN 'line' END AS pair FROM lineitem WHERE l_tax BETWEEN 0.035 AND 0.055 OR abs(l_tax - 0.02) < 0.001")
def band_pair_select(t):
    """A band, and a line with its tolerance written as a range so that both reach the scan."""
    band, line = F.col("l_tax").between(0.035, 0.055), (F.col("l_tax") > 0.019) & (F.col("l_tax") < 0.021)
    return t.lineitem.where(band | line).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.when(band, "band").when(line, "line").alias("pair"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.95) FROM customer)")
def coverage_filters(t):
    limit = percentiles(t.customer, "c_acctbal", {"limit": 0.95})
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(F.broadcast(limit), F.col("c_acctbal") >= F.col("limit")).select("c_custkey", "c_mktsegment")


_REASON_SQL = "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'big:' || p_size WHEN p_size % 7 = 0 THEN 'duplicate' WHEN length(p_name) < 9 THEN 'short_text' WHEN NOT p_size BETWEEN 1 AND 230 THEN 'bad_class' END AS reason FROM part"


def _reason(t):
    size = F.col("p_size")
    reason = F.when(size > 45, F.concat(F.lit("big:"), size.cast("string"))).when(size % 7 == 0, "duplicate").when(F.length("p_name") < 9, "short_text").when(~size.between(1, 230), "bad_class")
    return t.part.select("p_partkey", reason.alias("reason"))


@query(_REASON_SQL)
def structure_validity(t):
    return _reason(t)


@query(f"SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM ({_REASON_SQL}) WHERE reason IS NOT NULL GROUP BY 1")
def skip_reason_hist(t):
    return _reason(t).where("reason is not null").groupBy(F.split("reason", ":")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 WHEN 'P' THEN -2 ELSE -3 END AS code, CASE WHEN o_orderstatus = 'F' THEN 'ok' WHEN o_orderstatus = 'O' THEN 'undef' ELSE 'error' END AS status FROM orders")
def status_map(t):
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(s == "F", 1).when(s == "O", -1).when(s == "P", -2).otherwise(-3).alias("code"), F.when(s == "F", "ok").when(s == "O", "undef").otherwise("error").alias("status"))


# --- joins ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def inner_join_labels(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE c_name IS NULL) AS missing FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_join_complete(t):
    own = t.orders.select("o_custkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    return own.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_name").isNull()).alias("missing"))


@query("SELECT s_suppkey, s_acctbal, n_name, quality, source FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT d.doc_id, source, quality FROM documents d LEFT JOIN labels USING (doc_id)) x ON x.doc_id = s_suppkey")
def enrich_one_to_one(t):
    left = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("doc_id"), "s_acctbal", "n_name")
    right = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return one_to_one_left(left, right, "doc_id").withColumnRenamed("doc_id", "s_suppkey")


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, p_type, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'STANDARD' THEN 4 WHEN 'LARGE' THEN 5 END AS code FROM lineitem JOIN part ON l_partkey = p_partkey")
def lookup_broadcast(t):
    """Ids to rows by equi join (Spark broadcasts the side if it is small enough), labels to codes by a literal map."""
    codes = F.create_map(*(F.lit(x) for pair in (("ECONOMY", 0), ("SMALL", 1), ("MEDIUM", 2), ("PROMO", 3), ("STANDARD", 4), ("LARGE", 5)) for x in pair))
    own = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").join(own, "l_partkey").withColumn("code", codes[F.col("p_type")])


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS returned FROM orders")
def semi_flag(t):
    keys = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return flag_membership(t.orders.select("o_orderkey"), keys, "o_orderkey", "returned")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_resume(t):
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


@query("""SELECT coalesce(a.source, b.source) AS source, a.n AS n_all, b.n AS n_toxic FROM (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) a
FULL JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) b ON a.source = b.source""")
def full_outer_metrics(t):
    a = t.documents.where("lang = 'en'").groupBy("source").agg(F.count(F.lit(1)).alias("n_all"))
    b = t.documents.select("doc_id", "source").join(t.labels.where("toxic = 1"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_toxic"))
    return a.join(b, "source", "full")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, k AS i, v FROM (SELECT o_orderkey, o_orderpriority, o_totalprice, unnest([1, 2, 3]) AS k, unnest(['a', 'b', 'c']) AS v FROM orders)")
def zip_align(t):
    """Position-aligned join of parallel arrays."""
    pairs = F.arrays_zip(F.array(F.lit(1), F.lit(2), F.lit(3)).alias("i"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("v"))
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", F.explode(pairs).alias("z")).select("o_orderkey", "o_orderpriority", "o_totalprice", F.col("z.i").alias("i"), F.col("z.v").alias("v"))


# --- sets ----------------------------------------------------------------------------------------------------------


@query("SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal, NULL FROM supplier")
def union_missing_columns(t):
    c = t.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT kind, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT 'c' AS kind, c_acctbal AS v FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier) GROUP BY kind")
def union_all(t):
    both = t.customer.select(F.lit("c").alias("kind"), F.col("c_acctbal").alias("v")).unionByName(t.supplier.select(F.lit("s").alias("kind"), F.col("s_acctbal").alias("v")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("SELECT p_partkey, p_size, p_size * 2 AS doubled, p_size > 25 AS big FROM part")
def column_concat(t):
    return t.part.select("p_partkey", "p_size").withColumns({"doubled": F.col("p_size") * 2, "big": F.col("p_size") > 25})


@query("SELECT count(*) AS shared FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1)")
def key_disjoint(t):
    keys = t.customer.select("c_custkey")
    return keys.where("c_custkey % 2 = 0").intersect(keys.where("c_custkey % 2 = 1")).agg(F.count(F.lit(1)).alias("shared"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS a, list_sort(list_distinct(list(l_linestatus))) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS both_, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a, a = b AS same FROM s""")
def set_algebra(t):
    s = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("a"), F.array_sort(F.collect_set("l_linestatus")).alias("b"))
    return s.select("l_orderkey", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("both_"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("only_a"), (F.col("a") == F.col("b")).alias("same"))


# --- aggregation ---------------------------------------------------------------------------------------------------


@query("SELECT lang, source, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share FROM documents GROUP BY 1, 2")
def role_counts(t):
    n = t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("SELECT n_regionkey, count(DISTINCT c_mktsegment) AS segments, count(DISTINCT c_custkey) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def group_nunique(t):
    own = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy("n_regionkey").agg(F.count_distinct("c_mktsegment").alias("segments"), F.count_distinct("c_custkey").alias("customers"))


@query("SELECT event_type, round(avg(CAST(value > 50 AS INTEGER)), 6) AS high, round(avg(CAST(value < 1 AS INTEGER)), 6) AS low FROM events GROUP BY 1")
def proportions(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("high"), F.round(F.avg((F.col("value") < 1).cast("int")), 6).alias("low"))


@query("SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1")
def profile_summary(t):
    """Plain aggregates a type, joined by its percentiles, which few types with many rows don't gather in one task."""
    plain = t.events.groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))
    q = percentiles(t.events, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["event_type"])
    return plain.join(q.select("event_type", *(F.round(c, 6).alias(c) for c in ("q25", "q50", "q75"))), "event_type", "left")


@query("SELECT n_regionkey, CASE WHEN count(c_acctbal) > 1 THEN round(stddev_pop(c_acctbal), 6) END AS sd_pop, round(stddev_samp(ln(c_acctbal)) FILTER (WHERE c_acctbal > 0), 6) AS sd_log FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def fold_summary_std(t):
    own = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    log = F.when(F.col("c_acctbal") > 0, F.ln(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))))
    return own.groupBy("n_regionkey").agg(F.when(F.count("c_acctbal") > 1, F.round(F.stddev_pop("c_acctbal"), 6)).alias("sd_pop"), F.round(F.stddev_samp(log), 6).alias("sd_log"))


def _counters(t):
    return t.orders.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("""SELECT '{"n":' || count(*) || ',"customers":' || count(DISTINCT o_custkey) || ',"finished":' || count(*) FILTER (WHERE o_orderstatus = 'F') || '}' AS summary FROM orders""")
def summary_json(t):
    return _counters(t).select(F.to_json(F.struct("n", "customers", "finished")).alias("summary"))


@query("""SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events UNION ALL SELECT unnest(json_keys('{"k":1,"even":1}')) FROM events WHERE event_id % 2 = 0) GROUP BY 1""")
def key_presence(t):
    keys = lambda c: F.explode(F.map_keys(F.from_json(c, "map<string,string>"))).alias("key")
    both = t.events.select(keys(F.col("props"))).unionAll(t.events.where("event_id % 2 = 0").select(keys(F.lit('{"k":1,"even":1}'))))
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT cue, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS cue FROM part) GROUP BY 1 ORDER BY n DESC, cue LIMIT 6")
def cue_frequency(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("cue")).groupBy("cue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cue").limit(6)


@query("SELECT source, lang, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY GROUPING SETS ((source), (lang), ())")
def scope_grouping_sets(t):
    own = t.documents.groupingSets([[F.col("source")], [F.col("lang")], []], "source", "lang")
    return own.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT phases, count(*) AS orders, round(avg(top), 6) AS mean_top FROM (SELECT l_orderkey, count(*) AS phases, max(l_extendedprice) / sum(l_extendedprice) AS top FROM lineitem GROUP BY 1) GROUP BY 1")
def phase_summary(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("phases"), (F.max("l_extendedprice") / F.sum("l_extendedprice")).alias("top"))
    return per.groupBy("phases").agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("top"), 6).alias("mean_top"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)))::DOUBLE / len(embedding), 6) AS coverage, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top, CAST(list_max(embedding) <= 0 AS INTEGER) AS empty FROM embeddings")
def mask_gate(t):
    """Coverage of the mask of positive components and the largest value inside it, in array functions."""
    ones = F.aggregate("embedding", F.lit(0), lambda a, x: a + (x > 0).cast("int"))
    return t.embeddings.select("vec_id", F.round(ones / F.size("embedding"), 6).alias("coverage"), F.round(F.array_max("embedding").cast("double"), 6).alias("top"), (F.array_max("embedding") <= 0).cast("int").alias("empty"))


# --- sort, limit, sample -------------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 12")
def seeded_sample_cap(t):
    """A capped sample for each source, the same on every engine: the smallest hashes. Spark cuts each task's part to the cap before the shuffle."""
    order = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("s|"), F.col("doc_id").cast("string"))), "doc_id")
    return t.documents.select("doc_id", "source").withColumn("r", F.row_number().over(order)).where("r <= 12").drop("r")


@query("SELECT event_id, value FROM events WHERE value < (SELECT quantile_cont(value, 0.995) FROM events)")
def quantile_trim(t):
    limit = percentiles(t.events, "value", {"limit": 0.995})
    return t.events.select("event_id", "value").join(F.broadcast(limit), F.col("value") < F.col("limit")).drop("limit")


@query("SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer) WHERE r IN (0, (n - 1) // 4, (n - 1) // 2, 3 * (n - 1) // 4, n - 1)")
def even_spaced_rows(t):
    """Rows at even ranks: the ranks come from counts of value buckets, so no window holds the whole table."""
    own = t.customer.select("c_custkey", "c_acctbal").withColumn("bucket", F.floor(F.col("c_acctbal") / 100))
    sizes = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = own.withColumn("own", F.row_number().over(Window.partitionBy("bucket").orderBy("c_acctbal", "c_custkey"))).join(first, "bucket")
    last = F.col("total") - 1
    wanted = F.array(F.lit(0), F.floor(last / 4), F.floor(last / 2), F.floor(3 * last / 4), last).cast("array<long>")
    return ranked.where(F.array_contains(wanted, F.col("first") + F.col("own") - 1)).select("c_custkey", "c_acctbal")


@query("SELECT least(p_size, 40) AS size, count(*) AS n FROM part GROUP BY 1")
def histogram_clip(t):
    return t.part.groupBy(F.least("p_size", F.lit(40)).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST('0x' || substr(md5('u|' || doc_id), 1, 6) AS BIGINT) / 16777216.0::DOUBLE AS u, CAST('0x' || substr(md5('b|' || doc_id), 1, 4) AS BIGINT) % 16 AS bucket FROM documents")
def hashed_draws(t):
    return t.documents.select("doc_id", hash_unit("u", "doc_id").alias("u"), hash_mod("b", "doc_id", 16).alias("bucket"))
