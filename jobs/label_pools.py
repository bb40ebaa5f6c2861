"""Label pools: from raw documents and sparse labels to tables that training and evaluation start from.

    python -m jobs.label_pools --documents PATH --labels PATH --out PATH [--config FILE]

Steps: rows without an id or with too short a text are set aside with the reason; byte-identical texts are one row, the
one with the smallest id; the labels of all copies of a text are gathered, and a head is masked where it has no label or
its labels disagree; texts that differ in case, spacing or punctuation only form a group, and whole groups go to test,
validation and training by hash rank in each source, so that nothing leaks; the training groups are dealt into folds of
even size.

Writes ``index`` (each readable row with its digests, or the reason it was set aside), ``pool`` by role and split, and
``summary`` (rows and labels of each part). Texts stay where they are. Everything is decided by ids and hashes, and each
table is written over, so that a rerun gives the same files' rows, also after a run that broke off.

A null text counts as too short, a null source as ``unknown``. Of rows with one id and one text the smallest row stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, counted, log, read, settings, written
from latticeworks.operators.folds import group_folds
from latticeworks.operators.ranks import take_by_hash
from latticeworks.sources.scratch import new_path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII characters other than digits and letters.
_MARKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
COLUMNS = ["doc_id", "lang", "source", "copies", "quality", "toxic", "m_quality", "m_toxic", "fold", "role", "split"]


def index_of(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, source, lang, digest, key, reason): the only step that reads texts. ``reason`` is null for rows that go on."""
    text = F.coalesce("text", F.lit(""))
    plain = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _MARKS, " "))
    reason = F.when(F.col("doc_id").isNull(), "no_id").when(F.length(text) < least_chars, "too_short")
    return docs.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), "lang", F.md5(text).alias("digest"), F.md5(plain).alias("key"), reason.alias("reason"))


def pooled(index: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a different text: its first row, number of copies and labels. Copies are counted before the shuffle, so that a text that is a third of all rows is a few of its rows."""
    first = F.min(F.struct("doc_id", "source", "lang", "key"))
    texts = index.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    heads = ("quality", "toxic")
    bounds = [f(h).alias(f"{n}_{h}") for h in heads for n, f in (("least", F.min), ("most", F.max))]
    # An id may have several rows of one text, and several labels.
    own = index.select("doc_id", "digest").distinct().join(labels.select("doc_id", *heads), "doc_id").groupBy("digest").agg(*bounds)
    agreed = lambda h: F.when(F.col(f"least_{h}") == F.col(f"most_{h}"), F.col(f"least_{h}")).cast("int")
    pool = texts.join(own, "digest", "left").select("first.*", "copies", *(agreed(h).alias(h) for h in heads))
    masks = {f"m_{h}": F.col(h).isNotNull().cast("int") for h in heads}
    return pool.withColumns(masks).withColumn("role", F.when(F.col("m_quality") + F.col("m_toxic") > 0, "labelled").otherwise("unlabelled"))


def splits_of(pool: DataFrame, seed: str, test_percent: int, val_percent: int) -> DataFrame:
    """(key, split): whole groups by hash rank in their source, the smallest of the sources of a group."""
    groups = pool.groupBy("key").agg(F.min("source").alias("stratum")).withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("key"))))
    part = lambda percent: lambda n: F.floor(n * percent / 100)
    groups = take_by_hash(groups, "h", ["key"], part(test_percent), ["stratum"], flag="test")
    groups = take_by_hash(groups, "h", ["key"], part(test_percent + val_percent), ["stratum"], flag="held")
    return groups.select("key", F.when(F.col("test"), "test").when(F.col("held"), "val").otherwise("train").alias("split"))


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict) -> DataFrame:
    """The pool as written below ``out``."""
    raw, marks = read(spark, documents, config["format"]), read(spark, labels, config["format"])
    log.info("read %s documents from %s and %s labels from %s", raw.count(), documents, marks.count(), labels)
    index = written(index_of(raw, config["least_chars"]), f"{out}/index", ["reason"], "index")
    counted(index, "reason", "index by reason")
    pool = pooled(index.where("reason is null"), marks)
    split = splits_of(pool, config["seed"], config["test_percent"], config["val_percent"])
    placed = written(pool.join(split, "key").select("key", *(c for c in COLUMNS if c != "fold")), f"{out}/placed", ["split"], "rows with their split")
    folds = group_folds(placed.where("split = 'train'"), "key", config["folds"])
    pool = written(placed.join(folds, "key", "left").select(*COLUMNS), f"{out}/pool", ["role", "split"], "pool")
    counts = [F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"), *(F.sum(f"m_{h}").alias(h) for h in ("quality", "toxic"))]
    written(pool.groupBy("role", "split", "fold").agg(*counts), f"{out}/summary", ["split"], "summary")
    return pool


def job1_label_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the whole tables into one new folder: the second finds everything there and leaves it the same."""
    out, config = new_path(spark, "job1"), settings("label_pools")
    for _ in range(2):
        pool = run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, config)
    return pool


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, lang, md5(text) AS digest,
    md5(trim(regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '{_MARKS}', ' ', 'g'))) AS key
  FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 50),
t AS (SELECT digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang, min(key) AS key, count(*) AS copies FROM d GROUP BY 1),
h AS (
  SELECT digest, CASE WHEN min(quality) = max(quality) THEN min(quality) END AS quality, CASE WHEN min(toxic) = max(toxic) THEN min(toxic) END AS toxic
  FROM d JOIN labels USING (doc_id) GROUP BY 1),
p AS (SELECT t.*, quality, toxic, CAST(quality IS NOT NULL AS INTEGER) AS m_quality, CAST(toxic IS NOT NULL AS INTEGER) AS m_toxic FROM t LEFT JOIN h USING (digest)),
g AS (SELECT key, min(source) AS stratum, count(*) AS size FROM p GROUP BY 1),
r AS (SELECT key, size, row_number() OVER (PARTITION BY stratum ORDER BY md5('pool|' || key), key) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM g),
s AS (SELECT key, size, CASE WHEN r <= floor(n * 10 / 100.0) THEN 'test' WHEN r <= floor(n * 20 / 100.0) THEN 'val' ELSE 'train' END AS split FROM r),
o AS (SELECT key, size, row_number() OVER (ORDER BY size DESC, key) AS r FROM s WHERE split = 'train'),
f(r, key, fold, loads) AS (
  SELECT 0, '', -1, [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL
  SELECT o.r, o.key, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + o.size ELSE x END)
  FROM f JOIN o ON o.r = f.r + 1)
SELECT doc_id, lang, source, copies, quality, toxic, m_quality, m_toxic, CAST(fold AS INTEGER) AS fold,
  CASE WHEN m_quality + m_toxic > 0 THEN 'labelled' ELSE 'unlabelled' END AS role, split
FROM p JOIN s USING (key) LEFT JOIN f USING (key)
"""


def main() -> None:
    args = arguments("Label pools from documents and labels.", "documents", "labels", "out")
    spark = SparkSession.builder.appName("label-pools").getOrCreate()
    try:
        run(spark, args.documents, args.labels, args.out, settings("label_pools", args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
