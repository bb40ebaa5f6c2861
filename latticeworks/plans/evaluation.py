"""Evaluation queries over predictions: accuracies, errors, thresholds, paired folds, comparisons, two-sample tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeworks.operators import metrics as E
from latticeworks.operators.metrics import by_value, masked_mean, micro_f1, set_counts
from latticeworks.operators.ranks import percentiles, running_sums
from latticeworks.operators.relational import null_safe_join
from latticeworks.plans.common import PRED_SQL, hash_mod, hash_unit, predictions
from latticeworks.registry import query

_P = f"p AS ({PRED_SQL})"


@query(f"WITH {_P} SELECT fold, round(avg(CAST((p >= 0.5) = (truth = 1) AS INTEGER)) FILTER (WHERE lang = 'en'), 6) AS acc_en, round(avg(CAST((p >= 0.5) = (truth = 1) AS INTEGER)), 6) AS acc, count(*) AS n FROM p GROUP BY fold")
def masked_accuracy(t):
    ok = (F.col("p") >= 0.5) == (F.col("truth") == 1)
    return predictions(t).groupBy("fold").agg(F.round(masked_mean(ok.cast("int"), F.col("lang") == "en"), 6).alias("acc_en"), F.round(F.avg(ok.cast("int")), 6).alias("acc"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_P} SELECT lang, round(avg(abs(p - truth)) FILTER (WHERE toxic = 0), 6) AS mae, round(quantile_cont(abs(p - truth), 0.5) FILTER (WHERE toxic = 0), 6) AS mae_median, round(quantile_cont(abs(p - truth) / greatest(abs(truth), 1e-6::DOUBLE), 0.5) FILTER (WHERE toxic = 0 AND truth > 0), 6) AS mape_median FROM p GROUP BY lang")
def masked_mae_median(t):
    e, mask = F.abs(F.col("p") - F.col("truth")), F.col("toxic") == 0
    relative = e / F.greatest(F.abs("truth").cast("double"), F.lit(1e-6))
    own = predictions(t).select("lang", F.when(mask, e).alias("mae_median"), F.when(mask & (F.col("truth") > 0), relative).alias("mape_median"))
    out = own.groupBy("lang").agg(F.round(F.avg("mae_median"), 6).alias("mae"))
    for c in ("mae_median", "mape_median"):
        out = null_safe_join(out, percentiles(own, c, {c: 0.5}, ["lang"]), ["lang"])
    return out.select("lang", "mae", F.round("mae_median", 6).alias("mae_median"), F.round("mape_median", 6).alias("mape_median"))


# True set: return flags of an order's lines. Predicted set: flags whose hashed score with the order passes a threshold.
_SETS_SQL = """
t AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS t FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, t, unnest(['A', 'N', 'R']) AS f FROM t),
q AS (SELECT l_orderkey, t, f, CAST('0x' || substr(md5(f || '|' || l_orderkey), 1, 6) AS BIGINT) / 16777216.0::DOUBLE AS u FROM s)"""


def _scored_sets(t):
    true = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("t"))
    flags = [F.struct(F.lit(f).alias("f"), hash_unit(f, "l_orderkey").alias("u")) for f in "ANR"]
    return true.withColumn("scores", F.array(*flags))


def _predicted(threshold):
    return F.transform(F.filter("scores", lambda s: s["u"] > threshold), lambda s: s["f"])


_COUNTS_SQL = f"""{_SETS_SQL},
c AS (SELECT l_orderkey, sum(CAST(u > 0.4 AND list_contains(t, f) AS INTEGER)) AS tp, sum(CAST(u > 0.4 AND NOT list_contains(t, f) AS INTEGER)) AS fp, sum(CAST(u <= 0.4 AND list_contains(t, f) AS INTEGER)) AS fn FROM q GROUP BY 1)"""


@query(f"WITH {_COUNTS_SQL} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(2 * (sum(tp) / greatest(sum(tp + fp), 1)::DOUBLE) * (sum(tp) / greatest(sum(tp + fn), 1)::DOUBLE) / greatest(sum(tp) / greatest(sum(tp + fp), 1)::DOUBLE + sum(tp) / greatest(sum(tp + fn), 1)::DOUBLE, 1e-9), 6) AS f1 FROM c")
def element_micro_f1(t):
    tp, fp, fn = set_counts(_predicted(0.4), F.col("t"))
    c = _scored_sets(t).select(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return c.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(micro_f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))


@query(f"WITH {_COUNTS_SQL} SELECT round(avg(CAST(fp = 0 AND fn = 0 AS INTEGER)), 6) AS exact FROM c")
def exact_set_match(t):
    return _scored_sets(t).agg(F.round(F.avg((F.array_sort(_predicted(0.4)) == F.col("t")).cast("int")), 6).alias("exact"))


_RANKS = "SELECT c_custkey, c_nationkey, n, row_number() OVER (PARTITION BY c_custkey ORDER BY md5(c_custkey || '|' || n) DESC) AS r FROM customer, (SELECT unnest(range(0, 25)) AS n)"


@query(f"SELECT round(avg(CAST(r <= 1 AS INTEGER)), 6) AS top1, round(avg(CAST(r <= 5 AS INTEGER)), 6) AS top5 FROM ({_RANKS}) WHERE n = c_nationkey")
def top5_accuracy(t):
    """Rank of the true class among 25 scores, by array functions: no row is made for a class."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda n: F.struct(F.md5(F.concat_ws("|", F.col("c_custkey").cast("string"), n.cast("string"))).alias("s"), n.alias("n")))
    ranked = t.customer.select("c_nationkey", F.reverse(F.array_sort(scores)).alias("scores"))
    hit = lambda k: F.array_contains(F.transform(F.slice("scores", 1, k), lambda s: s["n"]), F.col("c_nationkey"))
    return ranked.agg(*(F.round(F.avg(hit(k).cast("int")), 6).alias(f"top{k}") for k in (1, 5)))


@query(f"""WITH {_P}, o AS (SELECT p, row_number() OVER (ORDER BY p DESC, doc_id) AS i, avg(CAST(truth = 1 AS INTEGER)) OVER (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING) AS acc FROM p),
t(target) AS (VALUES (0.80::DOUBLE), (0.90::DOUBLE), (0.95::DOUBLE))
SELECT target, max(i) AS i, round(max_by(p, i), 6) AS threshold FROM t LEFT JOIN o ON acc >= target GROUP BY target""")
def threshold_calibration(t):
    """The confidence at the last rank whose running precision reaches the target; null if none does."""
    falling = predictions(t).select("doc_id", "p", "truth", (-F.col("p")).alias("order"))
    run = running_sums(falling, "order", {"i": F.lit(1), "right": (F.col("truth") == 1).cast("long")}, ties=["doc_id"])
    curve = run.select("p", "i", (F.col("right") / F.col("i")).alias("acc"))
    targets = t.spark.createDataFrame([(0.80,), (0.90,), (0.95,)], "target double")
    best = F.broadcast(targets).join(curve, F.col("acc") >= F.col("target"), "left")
    return best.groupBy("target").agg(F.max("i").alias("i"), F.round(F.max_by("p", "i"), 6).alias("threshold"))


@query(f"""WITH {_SETS_SQL}, th(th) AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE),
c AS (SELECT th, l_orderkey, sum(CAST(u > th AND list_contains(t, f) AS INTEGER)) AS tp, sum(CAST(u > th AND NOT list_contains(t, f) AS INTEGER)) AS fp, sum(CAST(u <= th AND list_contains(t, f) AS INTEGER)) AS fn FROM q, th GROUP BY 1, 2)
SELECT th, round(sum(tp) / greatest(sum(tp + fp), 1)::DOUBLE, 6) AS precision_, round(sum(tp) / greatest(sum(tp + fn), 1)::DOUBLE, 6) AS recall, round(avg(CAST(fp = 0 AND fn = 0 AS INTEGER)), 6) AS exact FROM c GROUP BY th""")
def threshold_sweep(t):
    """Six fixed thresholds for each row: an exploded literal, aggregated before any shuffle."""
    swept = _scored_sets(t).withColumn("th", F.explode(F.array(*(F.lit(x) for x in (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)))))
    tp, fp, fn = set_counts(_predicted(F.col("th")), F.col("t"))
    c = swept.select("th", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    ratio = lambda a, b: F.round(F.sum(a) / F.greatest(F.sum(b), F.lit(1)), 6)
    return c.groupBy("th").agg(ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), F.round(F.avg(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("int")), 6).alias("exact"))


#: The thresholds that calibration tries, the precision it asks for, and the threshold without it.
CALIBRATION, PRECISION, FALLBACK = [0.50 + 0.02 * i for i in range(25)], 0.95, 0.85

_FREE_SQL = """d AS (SELECT doc_id, CAST('0x' || substr(md5('p|' || doc_id), 1, 6) AS BIGINT) / 16777216.0::DOUBLE AS p, CAST('0x' || substr(md5('f|' || doc_id), 1, 4) AS BIGINT) % 5 AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""
_THRESHOLD_SQL = f"""c AS (SELECT i, sum(CAST(p > 0.5::DOUBLE + 0.02::DOUBLE * i AND truth = 1 AS INTEGER)) / greatest(sum(CAST(p > 0.5::DOUBLE + 0.02::DOUBLE * i AS INTEGER)), 1)::DOUBLE AS pr FROM p, (SELECT unnest(range(0, 25)) AS i) GROUP BY i),
th AS (SELECT coalesce(min(0.5::DOUBLE + 0.02::DOUBLE * i) FILTER (WHERE pr >= {PRECISION}), {FALLBACK}::DOUBLE) AS th, count(*) FILTER (WHERE pr >= {PRECISION}) = 0 AS is_fallback FROM c)"""


def _free(t):
    """Documents without a label, with a hashed confidence and class."""
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti").select("doc_id", hash_unit("p", "doc_id").alias("p"), hash_mod("f", "doc_id", 5).alias("k"))


def _threshold(t):
    return E.calibrated_threshold(predictions(t), "p", F.col("truth") == 1, PRECISION, FALLBACK, CALIBRATION)


@query(f"WITH {_P}, {_FREE_SQL}, {_THRESHOLD_SQL} SELECT doc_id, CASE WHEN p > th THEN k END AS pseudo_class, CASE WHEN p > th THEN round(p, 6) END AS confidence, is_fallback FROM d, th")
def pseudo_label_assign(t):
    """A class for unlabelled rows beyond the threshold that labelled ones calibrate; is_fallback tells where none reaches the precision."""
    sure = F.col("p") > F.col("threshold")
    return _free(t).join(F.broadcast(_threshold(t))).select("doc_id", F.when(sure, F.col("k")).alias("pseudo_class"), F.when(sure, F.round("p", 6)).alias("confidence"), "is_fallback")


@query(f"WITH {_P}, {_FREE_SQL}, {_THRESHOLD_SQL} SELECT th AS threshold, is_fallback, count(*) AS total_unlabeled, count(*) FILTER (WHERE p > th) AS labeled_any, count(*) FILTER (WHERE p > th AND k = 0) AS class_0, count(DISTINCT CASE WHEN p > th THEN k END) AS classes FROM d, th GROUP BY 1, 2")
def pseudo_label_registry(t):
    """The registry of an assignment: its threshold, and how many rows it covers."""
    sure = F.col("p") > F.col("threshold")
    own = _free(t).join(F.broadcast(_threshold(t)))
    return own.groupBy("threshold", "is_fallback").agg(F.count(F.lit(1)).alias("total_unlabeled"), F.count_if(sure).alias("labeled_any"), F.count_if(sure & (F.col("k") == 0)).alias("class_0"), F.count_distinct(F.when(sure, F.col("k"))).alias("classes"))


# Fold metrics: folds from orders, candidates from priorities, score the mean price share.
_FOLDS_SQL = "SELECT o_custkey % 5 AS fold, o_orderpriority AS candidate, avg(o_totalprice) AS score, CAST(count(*) % 30 AS INTEGER) AS epoch FROM orders GROUP BY 1, 2"


def _folds(t):
    return t.orders.groupBy((F.col("o_custkey") % 5).alias("fold"), F.col("o_orderpriority").alias("candidate")).agg(F.avg("o_totalprice").alias("score"), (F.count(F.lit(1)) % 30).cast("int").alias("epoch"))


@query(f"WITH f AS ({_FOLDS_SQL}), m AS (SELECT candidate, avg(score) AS mean, quantile_cont(epoch, 0.5) AS e FROM f GROUP BY 1) SELECT candidate, round(mean, 4) AS mean, CAST(least(greatest(floor(e), 5), 30) AS INTEGER) AS epochs FROM m ORDER BY mean DESC, candidate LIMIT 1")
def config_argmax(t):
    m = _folds(t).groupBy("candidate").agg(F.avg("score").alias("mean"), F.percentile("epoch", F.lit(0.5)).alias("e"))
    return m.orderBy(F.desc("mean"), "candidate").limit(1).select("candidate", F.round("mean", 4).alias("mean"), F.least(F.greatest(F.floor("e"), F.lit(5)), F.lit(30)).cast("int").alias("epochs"))


_PAIRED_SQL = f"f AS ({_FOLDS_SQL}), d AS (SELECT a.fold, a.score AS one, b.score AS other, a.score - b.score AS difference FROM f a JOIN f b ON a.fold = b.fold WHERE a.candidate = '1-URGENT' AND b.candidate = '5-LOW')"


def _paired(t):
    f = _folds(t)
    a = f.where("candidate = '1-URGENT'").select("fold", F.col("score").alias("one"))
    b = f.where("candidate = '5-LOW'").select("fold", F.col("score").alias("other"))
    return a.join(b, "fold").withColumn("difference", F.col("one") - F.col("other"))


@query(f"WITH {_PAIRED_SQL} SELECT round(avg(one), 4) AS one, round(avg(other), 4) AS other, round(avg(difference), 4) AS difference, round(stddev_pop(difference), 4) AS sd, count(DISTINCT fold) AS folds FROM d")
def paired_fold_diff(t):
    return _paired(t).agg(*(F.round(F.avg(c), 4).alias(c) for c in ("one", "other", "difference")), F.round(F.stddev_pop("difference"), 4).alias("sd"), F.count_distinct("fold").alias("folds"))


@query(f"WITH {_PAIRED_SQL} SELECT fold, metric, round(value, 4) AS value FROM (SELECT fold, 'one' AS metric, one AS value FROM d UNION ALL SELECT fold, 'other', other FROM d UNION ALL SELECT fold, 'difference', difference FROM d)")
def metric_unpivot(t):
    long = _paired(t).unpivot(["fold"], ["one", "other", "difference"], "metric", "value")
    return long.select("fold", "metric", F.round("value", 4).alias("value"))


@query("""WITH d AS (SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000 AS epoch, avg(value) AS score FROM events GROUP BY 1),
r AS (SELECT epoch, score, max(score) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM d),
b AS (SELECT *, max(CASE WHEN score = best THEN epoch END) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS last FROM r),
s AS (SELECT coalesce(min(epoch), (SELECT max(epoch) FROM d)) AS stop FROM b WHERE epoch - last >= 7 AND epoch >= 5)
SELECT stop AS stop_epoch, (SELECT max_by(epoch, score) FROM d WHERE epoch <= stop) AS best_epoch FROM s""")
def early_stop_scan(t):
    """Stop at the first epoch that is seven past the last improvement; an ordered fold over one short list of epochs."""
    day = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 86_400_000_000)
    epochs = t.events.groupBy(day.alias("epoch")).agg(F.avg("value").alias("score"))
    listed = epochs.agg(F.sort_array(F.collect_list(F.struct("epoch", "score"))).alias("e"))
    start = F.struct(F.lit(-1.0).alias("best"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("stop"), F.lit(0).cast("long").alias("last"))

    def step(a, x):
        better, open_ = x["score"] > a["best"], a["stop"].isNull()
        at = F.when(better, x["epoch"]).otherwise(a["at"])
        stop = F.when(open_ & (x["epoch"] - at >= 7) & (x["epoch"] >= 5), x["epoch"]).otherwise(a["stop"])
        return F.struct(F.when(open_ & better, x["score"]).otherwise(a["best"]).alias("best"), F.when(open_, at).otherwise(a["at"]).alias("at"), stop.alias("stop"), x["epoch"].alias("last"))

    return listed.select(F.aggregate("e", start, step).alias("a")).select(F.coalesce("a.stop", "a.last").alias("stop_epoch"), F.col("a.at").alias("best_epoch"))


@query(f"WITH {_P} SELECT 'hash' AS model, 'regime_a' AS regime, lang AS scope, round(avg(CAST((p >= 0.5) = (truth = 1) AS INTEGER)), 6) AS acc FROM p GROUP BY lang UNION ALL SELECT 'constant', 'regime_b', lang, round(avg(truth), 6) FROM p GROUP BY lang")
def model_comparison_long(t):
    p = predictions(t)
    a = p.groupBy(F.col("lang").alias("scope")).agg(F.round(F.avg(((F.col("p") >= 0.5) == (F.col("truth") == 1)).cast("int")), 6).alias("acc")).withColumns({"model": F.lit("hash"), "regime": F.lit("regime_a")})
    b = p.groupBy(F.col("lang").alias("scope")).agg(F.round(F.avg("truth"), 6).alias("acc")).withColumns({"model": F.lit("constant"), "regime": F.lit("regime_b")})
    return a.unionByName(b).select("model", "regime", "scope", "acc")


@query(f"WITH {_P}, o(lang, k) AS (VALUES ('en', 0), ('de', 1), ('fr', 2), ('es', 3), ('it', 4)) SELECT coalesce(k, 5) AS k, lang, count(*) AS n, round(avg(CAST((p >= 0.5) = (truth = 1) AS INTEGER)), 6) AS acc, round(avg(abs(p - truth)), 6) AS mae, round(quantile_cont(abs(p - truth), 0.5), 6) AS mae_median FROM p LEFT JOIN o USING (lang) GROUP BY 1, 2")
def system_breakdown(t):
    """Known classes in their order, all others after them."""
    order = t.spark.createDataFrame([("en", 0), ("de", 1), ("fr", 2), ("es", 3), ("it", 4)], "lang string, k int")
    own = predictions(t).withColumn("e", F.abs(F.col("p") - F.col("truth"))).join(F.broadcast(order), "lang", "left").withColumn("k", F.coalesce("k", F.lit(5)))
    plain = own.groupBy("k", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("p") >= 0.5) == (F.col("truth") == 1)).cast("int")), 6).alias("acc"), F.round(F.avg("e"), 6).alias("mae"))
    median = percentiles(own, "e", {"mae_median": 0.5}, ["k", "lang"])
    return null_safe_join(plain, median, ["k", "lang"]).select("k", "lang", "n", "acc", "mae", F.round("mae_median", 6).alias("mae_median"))


@query("""WITH s AS (SELECT o_custkey % 2 = 0 AS side, o_totalprice AS v FROM orders), c AS (SELECT v, count(*) FILTER (WHERE side) AS n1, count(*) FILTER (WHERE NOT side) AS n0 FROM s GROUP BY v),
u AS (SELECT sum(n1) OVER w / sum(n1) OVER ()::DOUBLE AS f1, sum(n0) OVER w / sum(n0) OVER ()::DOUBLE AS f0 FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)) SELECT round(max(abs(f1 - f0)), 6) AS ks FROM u""")
def ks_statistic(t):
    return E.ks_statistic(t.orders, "o_totalprice", F.col("o_custkey") % 2 == 0).select(F.round("ks", 6).alias("ks"))


@query("""WITH s AS (SELECT n_regionkey, c_custkey % 2 = 0 AS side, c_acctbal AS v FROM customer JOIN nation ON c_nationkey = n_nationkey), c AS (SELECT n_regionkey, v, count(*) FILTER (WHERE side) AS n1, count(*) FILTER (WHERE NOT side) AS n0 FROM s GROUP BY ALL),
u AS (SELECT n_regionkey, sum(n1) OVER w / sum(n1) OVER (PARTITION BY n_regionkey)::DOUBLE AS f1, sum(n0) OVER w / sum(n0) OVER (PARTITION BY n_regionkey)::DOUBLE AS f0 FROM c WINDOW w AS (PARTITION BY n_regionkey ORDER BY v ROWS UNBOUNDED PRECEDING))
SELECT n_regionkey, round(max(abs(f1 - f0)), 6) AS ks FROM u GROUP BY 1""")
def ks_statistic_by_group(t):
    own = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return E.ks_statistic(own, "c_acctbal", F.col("c_custkey") % 2 == 0, "n_regionkey").select("n_regionkey", F.round("ks", 6).alias("ks"))


_AUC_SQL = f"WITH {_P}, c AS (SELECT round(p, 2) AS v, count(*) FILTER (WHERE truth = 1) AS n1, count(*) FILTER (WHERE truth = 0) AS n0 FROM p GROUP BY 1), u AS (SELECT *, coalesce(sum(n0) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM c)"


@query(f"{_AUC_SQL} SELECT round(sum(n1 * (under + n0 / 2.0::DOUBLE)) / (sum(n1) * sum(n0)), 6) AS auc FROM u")
def roc_auc(t):
    scored = predictions(t).withColumn("v", F.round("p", 2))
    return E.roc_auc(scored, "v", F.col("truth") == 1).select(F.round("auc", 6).alias("auc"))


@query(f"{_AUC_SQL} SELECT v, round(sum(n1) OVER w / sum(n1) OVER ()::DOUBLE, 6) AS tpr, round(sum(n0) OVER w / sum(n0) OVER ()::DOUBLE, 6) AS fpr FROM u WINDOW w AS (ORDER BY v DESC ROWS UNBOUNDED PRECEDING)")
def roc_curve(t):
    v = by_value(predictions(t).withColumn("v", F.round("p", 2)), "v", F.col("truth") == 1)
    at = lambda c, n, total: F.round((F.col(total) - F.col(c) + F.col(n)) / F.col(total), 6)
    return v.select("v", at("c1", "n1", "t1").alias("tpr"), at("c0", "n0", "t0").alias("fpr"))


_LOSS_SQL = """SELECT doc_id, CASE WHEN truth = 1 THEN -ln(greatest(p, 1e-6::DOUBLE)) ELSE -ln(greatest(1 - p, 1e-6::DOUBLE)) END AS bce, {l1} AS smooth_l1, {angle} AS angle, {volume} AS volume FROM p WHERE toxic = 0"""
_L1 = "CASE WHEN abs({e}) < 1 THEN 0.5 * ({e}) * ({e}) ELSE abs({e}) - 0.5 END"


@query(f"WITH {_P}, l AS ({_LOSS_SQL.format(l1=_L1.format(e='p - truth'), angle=_L1.format(e='3 * (p - truth)'), volume=_L1.format(e='p - truth / 2'))}) SELECT doc_id, round(bce, 6) AS bce, round(smooth_l1, 6) AS smooth_l1, round(bce + smooth_l1 + 2.0 * angle + 0.5 * volume, 6) AS total FROM l")
def masked_losses(t):
    """Binary cross-entropy and smoothed absolute errors of rows with the mask, and their sum, in which angles weigh 2 and volumes 0.5."""
    p, y = F.col("p"), F.col("truth")
    bce = F.when(y == 1, -F.ln(F.greatest(p, F.lit(1e-6)))).otherwise(-F.ln(F.greatest(1 - p, F.lit(1e-6))))
    l1 = lambda e: F.when(F.abs(e) < 1, 0.5 * e * e).otherwise(F.abs(e) - 0.5)
    total = bce + l1(p - y) + 2.0 * l1(3 * (p - y)) + 0.5 * l1(p - y / 2)
    return predictions(t).where("toxic = 0").select("doc_id", F.round(bce, 6).alias("bce"), F.round(l1(p - y), 6).alias("smooth_l1"), F.round(total, 6).alias("total"))


@query("SELECT vec_id, CAST(list_position(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_max(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))) - 1 AS BIGINT) AS k, round(list_max(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))) / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))), 6) AS p FROM embeddings")
def softmax_argmax(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    own = t.embeddings.select("vec_id", v.alias("v")).withColumn("e", F.transform("v", lambda x: F.exp(x - F.array_max("v"))))
    return own.select("vec_id", (F.array_position("v", F.array_max("v")) - 1).cast("long").alias("k"), F.round(F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("p"))


@query(f"WITH {_P} SELECT source, count(*) AS n, CAST(sum(CAST(p >= 0.9 AS BIGINT)) AS BIGINT) AS confident, round(max(p), 6) AS top FROM p GROUP BY source")
def probability_scan(t):
    return predictions(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") >= 0.9).alias("confident"), F.round(F.max("p"), 6).alias("top"))


_COMPARE_SQL = f"WITH {_P}, z AS (SELECT lang AS metric, avg(p) AS zero_shot FROM p WHERE fold < 2 GROUP BY 1), u AS (SELECT lang AS metric, avg(p) AS tuned FROM p WHERE fold >= 2 GROUP BY 1)"


@query(f"{_COMPARE_SQL} SELECT metric, round(zero_shot, 6) AS zero_shot, round(tuned, 6) AS tuned, round(tuned - zero_shot, 6) AS gain FROM z FULL JOIN u USING (metric)")
def comparison_tables(t):
    p = predictions(t)
    z = p.where("fold < 2").groupBy(F.col("lang").alias("metric")).agg(F.avg("p").alias("zero_shot"))
    u = p.where("fold >= 2").groupBy(F.col("lang").alias("metric")).agg(F.avg("p").alias("tuned"))
    return z.join(u, "metric", "full").select("metric", F.round("zero_shot", 6).alias("zero_shot"), F.round("tuned", 6).alias("tuned"), F.round(F.col("tuned") - F.col("zero_shot"), 6).alias("gain"))


_TRANSFER_SQL = f"""WITH {_P}, r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || '|' || n) DESC) AS r FROM p, (SELECT unnest(range(0, 25)) AS n)),
f AS (SELECT doc_id, unnest(['A', 'N', 'R']) AS f FROM p),
b AS (SELECT doc_id, CAST('0x' || substr(md5(f || '|' || doc_id), 1, 6) AS BIGINT) / 16777216.0::DOUBLE > 0.4 AS guess, CAST('0x' || substr(md5('t' || f || '|' || doc_id), 1, 4) AS BIGINT) % 2 = 1 AS there FROM f),
s AS (SELECT doc_id, count(*) FILTER (WHERE guess AND there) AS tp, count(*) FILTER (WHERE guess AND NOT there) AS fp, count(*) FILTER (WHERE there AND NOT guess) AS fn FROM b GROUP BY doc_id)
SELECT lang || '->' || CASE WHEN lang = 'en' THEN 'other' ELSE 'en' END AS direction, count(*) AS n, round(avg(CAST((p >= 0.5) = (truth = 1) AS INTEGER)), 6) AS acc, round(avg(abs(p - truth)), 6) AS mae,
  round(avg(CAST(r <= 1 AS INTEGER)), 6) AS top1, round(avg(CAST(r <= 5 AS INTEGER)), 6) AS top5, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE, 6) AS f1, round(avg(CAST(fp + fn = 0 AS INTEGER)), 6) AS exact
FROM p JOIN r USING (doc_id) JOIN s USING (doc_id) WHERE n = doc_id % 25 GROUP BY 1"""


@query(_TRANSFER_SQL)
def transfer_metrics(t):
    """By direction of a transfer: accuracy, error, top-k of 25 classes, and how well sets are met. Scores are arrays of a row, so one aggregation is all that shuffles."""
    direction = F.concat("lang", F.lit("->"), F.when(F.col("lang") == "en", "other").otherwise("en"))
    scores = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda n: F.struct(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), n.cast("string"))).alias("s"), n.alias("n")))
    rank = F.array_position(F.transform(F.reverse(F.array_sort(scores)), lambda s: s["n"]), (F.col("doc_id") % 25).cast("int"))
    guess = F.array_compact(F.array(*(F.when(hash_unit(f, "doc_id") > 0.4, f) for f in "ANR")))
    there = F.array_compact(F.array(*(F.when(hash_mod(f"t{f}", "doc_id", 2) == 1, f) for f in "ANR")))
    own = predictions(t).withColumns({"direction": direction, "rank": rank, **dict(zip(("tp", "fp", "fn"), set_counts(guess, there), strict=True))})
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return own.groupBy("direction").agg(
        F.count(F.lit(1)).alias("n"), share((F.col("p") >= 0.5) == (F.col("truth") == 1)).alias("acc"), F.round(F.avg(F.abs(F.col("p") - F.col("truth"))), 6).alias("mae"),
        share(F.col("rank") <= 1).alias("top1"), share(F.col("rank") <= 5).alias("top5"), F.round(micro_f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"), share(F.col("fp") + F.col("fn") == 0).alias("exact"),
    )


@query(f"WITH {_P} SELECT round(avg(CAST((p >= 0.5) = (truth = 1) AS INTEGER)) FILTER (WHERE fold < 4) - avg(CAST((p >= 0.5) = (truth = 1) AS INTEGER)) FILTER (WHERE fold = 4), 6) AS gap FROM p")
def in_distribution_gap(t):
    ok = ((F.col("p") >= 0.5) == (F.col("truth") == 1)).cast("int")
    return predictions(t).agg(F.round(masked_mean(ok, F.col("fold") < 4) - masked_mean(ok, F.col("fold") == 4), 6).alias("gap"))


#: The weight of each metric in the selection score.
SELECTION = {"sys_acc": 1.0, "el_f1_micro": 1.0, "mae_a": -0.05, "mae_ang": -0.02, "sg_acc": 0.50, "sg_top5": 0.25}


@query(f"""WITH f AS ({_FOLDS_SQL}), m AS (SELECT fold, candidate, score / 200000 AS sys_acc, nullif(epoch, 7) / 30.0::DOUBLE AS el_f1_micro, epoch / 5.0::DOUBLE AS mae_a, CASE WHEN epoch % 2 = 0 THEN epoch / 3.0::DOUBLE END AS mae_ang, score / 400000 AS sg_acc, score / 300000 AS sg_top5 FROM f)
SELECT fold, candidate, round({" + ".join(f"{w} * coalesce({n}, 0)" for n, w in SELECTION.items())}, 6) AS selection FROM m""")
def selection_score(t):
    """A weighted sum of metrics in which missing ones count 0."""
    epoch, score = F.col("epoch"), F.col("score")
    metrics = {"sys_acc": score / 200_000, "el_f1_micro": F.nullif(epoch, F.lit(7)) / 30.0, "mae_a": epoch / 5.0, "mae_ang": F.when(epoch % 2 == 0, epoch / 3.0), "sg_acc": score / 400_000, "sg_top5": score / 300_000}
    zero = lambda c: F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)
    return _folds(t).select("fold", "candidate", F.round(sum(F.lit(w) * zero(metrics[n].cast("double")) for n, w in SELECTION.items()), 6).alias("selection"))


@query(f"""WITH {_P}, c AS (SELECT source, round(p, 2) AS v, count(*) FILTER (WHERE truth = 1) AS n1, count(*) FILTER (WHERE truth = 0) AS n0 FROM p GROUP BY 1, 2), u AS (SELECT *, coalesce(sum(n0) OVER (PARTITION BY source ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM c),
a AS (SELECT source, sum(n1 * (under + n0 / 2.0::DOUBLE)) / nullif(sum(n1) * sum(n0), 0) AS auc FROM u GROUP BY source) SELECT source, round(auc, 6) AS auc, CASE WHEN auc < 0.65 THEN 'small' WHEN auc < 0.90 THEN 'visible' WHEN auc IS NOT NULL THEN 'large' END AS verdict FROM a""")
def verdict_bands(t):
    """How well a score tells two sides apart in each source: a small gap below an AUC of 0.65, a visible one below 0.90, else a large one."""
    a = E.roc_auc(predictions(t).withColumn("v", F.round("p", 2)), "v", F.col("truth") == 1, "source")
    auc = F.col("auc")
    return a.select("source", F.round(auc, 6).alias("auc"), F.when(auc < 0.65, "small").when(auc < 0.90, "visible").when(auc.isNotNull(), "large").alias("verdict"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, round(abs(l_quantity - p_size), 6) AS error, round(abs(l_quantity - p_size) / greatest(p_size, 1e-6::DOUBLE), 6) AS relative FROM lineitem JOIN part ON l_partkey = p_partkey")
def error_metrics(t):
    own = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    e = F.abs(F.col("l_quantity") - F.col("p_size"))
    return own.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.round(e, 6).alias("error"), F.round(e / F.greatest(F.col("p_size").cast("double"), F.lit(1e-6)), 6).alias("relative"))


@query("""WITH l AS (SELECT vec_id, label, pos, CAST(x AS DOUBLE) AS v FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)),
c AS (SELECT pos, v, count(*) FILTER (WHERE label % 2 = 0) AS n1, count(*) FILTER (WHERE label % 2 = 1) AS n0 FROM l GROUP BY ALL),
u AS (SELECT pos, sum(n1) OVER w / sum(n1) OVER (PARTITION BY pos)::DOUBLE AS f1, sum(n0) OVER w / sum(n0) OVER (PARTITION BY pos)::DOUBLE AS f0 FROM c WINDOW w AS (PARTITION BY pos ORDER BY v ROWS UNBOUNDED PRECEDING)),
k AS (SELECT pos, max(abs(f1 - f0)) AS ks FROM u GROUP BY pos) SELECT pos, round(ks, 6) AS ks FROM k ORDER BY k.ks DESC, pos LIMIT 3""")
def top_k_features(t):
    """Features ranked by KS distance between two domains."""
    long = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "v")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.col("v").cast("double").alias("v"))
    return E.ks_statistic(long, "v", F.col("label") % 2 == 0, "pos").orderBy(F.desc("ks"), "pos").limit(3).select("pos", F.round("ks", 6).alias("ks"))


@query("""WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer), m AS (SELECT quantile_cont(v, 0.5) AS m FROM f) SELECT c_custkey, round(coalesce(v, m), 4) AS filled, coalesce(v, -1) AS flagged FROM f, m""")
def impute(t):
    f = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("v"))
    m = percentiles(f, "v", {"m": 0.5})
    return f.join(F.broadcast(m)).select("c_custkey", F.round(F.coalesce("v", "m"), 4).alias("filled"), F.coalesce("v", F.lit(-1.0)).alias("flagged"))
