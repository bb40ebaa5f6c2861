"""Conservative matching of names against an authority list, and classification of the result.

The authority is ``nation``; names to match are made from suppliers' nations in several spellings, some unknown.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticeworks.functions import strings as S
from latticeworks.operators.relational import first_match
from latticeworks.registry import query

_NAMES_SQL = """
n AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN n_name WHEN 1 THEN ' ' || lower(n_name) WHEN 2 THEN replace(n_name, '_', ' - ') WHEN 3 THEN 'x' || n_name ELSE replace(n_name, '_1', '_') END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
a AS (SELECT n_nationkey AS owner, n_name AS name, lower(trim(n_name)) AS exact, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS plain FROM nation UNION ALL SELECT n_nationkey, 'NATION', 'nation', 'nation' FROM nation WHERE n_nationkey < 2),
e AS (SELECT exact, min(owner) AS m FROM a GROUP BY 1),
p AS (SELECT plain, min(owner) AS m FROM a GROUP BY 1 HAVING count(DISTINCT owner) = 1)"""


def _names(t):
    n = F.col("n_name")
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, n).when(k == 1, F.concat(F.lit(" "), F.lower(n))).when(k == 2, F.replace(n, F.lit("_"), F.lit(" - "))).when(k == 3, F.concat(F.lit("x"), n)).otherwise(F.replace(n, F.lit("_1"), F.lit("_")))
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", name.alias("name"))


def _authority(t):
    """Names and their owners; one name has two owners."""
    own = t.nation.select(F.col("n_nationkey").alias("owner"), F.col("n_name").alias("name"))
    shared = t.nation.where("n_nationkey < 2").select(F.col("n_nationkey").alias("owner"), F.lit("NATION").alias("name"))
    return own.unionByName(shared).select("owner", S.exact_name(F.col("name")).alias("exact"), S.plain_name(F.col("name")).alias("plain"))


def _indexes(t):
    """Exact index: the first owner wins. Plain index: keys with more than one owner are left out."""
    a = _authority(t)
    exact = a.groupBy("exact").agg(F.min("owner").alias("match"))
    plain = a.groupBy("plain").agg(F.min("owner").alias("match"), F.count_distinct("owner").alias("owners")).where("owners = 1").drop("owners")
    return exact, plain


def _matched(t):
    exact, plain = _indexes(t)
    names = _names(t).select("s_suppkey", "name", S.exact_name(F.col("name")).alias("exact"), S.plain_name(F.col("name")).alias("plain"))
    by = lambda index, key: names.join(index, key).select("s_suppkey", "match")
    return first_match(names, "s_suppkey", [("exact", by(exact, "exact")), ("normalised", by(plain, "plain"))])


_MATCH_SQL = f"{_NAMES_SQL}, m AS (SELECT s_suppkey, name, coalesce(e.m, p.m) AS owner, CASE WHEN e.m IS NOT NULL THEN 'exact' WHEN p.m IS NOT NULL THEN 'normalised' END AS method FROM n LEFT JOIN e ON lower(trim(name)) = exact LEFT JOIN p ON regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = plain)"


@query(f"WITH {_MATCH_SQL} SELECT s_suppkey, owner AS match_, method FROM m")
def name_match_priority(t):
    return _matched(t).select("s_suppkey", F.col("match").alias("match_"), "method")


@query(f"WITH {_NAMES_SQL} SELECT plain, count(DISTINCT owner) AS owners, min(owner) AS first_owner FROM a GROUP BY 1 HAVING count(DISTINCT owner) > 1")
def name_index_collisions(t):
    return _authority(t).groupBy("plain").agg(F.count_distinct("owner").alias("owners"), F.min("owner").alias("first_owner")).where("owners > 1")


_SYSTEM_CASE = "CASE WHEN {n} < 1 THEN NULL WHEN {n} <= 2 THEN 'triclinic' WHEN {n} <= 15 THEN 'monoclinic' WHEN {n} <= 74 THEN 'orthorhombic' WHEN {n} <= 142 THEN 'tetragonal' WHEN {n} <= 167 THEN 'trigonal' WHEN {n} <= 194 THEN 'hexagonal' WHEN {n} <= 230 THEN 'cubic' END"


@query(f"SELECT p_partkey, p_size * 5 - 3 AS number, {_SYSTEM_CASE.format(n='(p_size * 5 - 3)')} AS system FROM part")
def sg_system_range_join(t):
    number = F.col("p_size") * 5 - 3
    return t.part.select("p_partkey", number.alias("number"), S.crystal_system(number).alias("system"))


_STATUS_SQL = f"""{_MATCH_SQL},
s AS (SELECT m.*, owner % 6 AS k, list_filter([owner * 9 + 1, owner * 7 + 2], lambda x: owner % 6 > 1) AS numbers, owner % 6 = 1 AS unresolved, {_SYSTEM_CASE.format(n='(owner * 9 + 1)')} AS stated FROM m),
c AS (SELECT *, list_filter(numbers, lambda x: {_SYSTEM_CASE.format(n='x')} = stated OR (stated = 'hexagonal' AND {_SYSTEM_CASE.format(n='x')} = 'trigonal')) AS fit FROM s)
SELECT s_suppkey, CASE WHEN owner IS NULL THEN 'unmatched_name' WHEN k = 0 THEN 'matched_no_spacegroup' WHEN unresolved THEN 'matched_unresolved_symbol' WHEN len(fit) = 0 THEN 'matched_crystal_system_conflict'
  WHEN len(list_distinct(fit)) = 1 AND len(list_distinct(numbers)) = 1 THEN 'usable_unique_spacegroup' WHEN len(list_distinct(fit)) = 1 THEN 'usable_after_crystal_system_filter' ELSE 'matched_ambiguous_spacegroup' END AS status FROM c"""


@query(f"WITH {_STATUS_SQL}")
def status_classification(t):
    """Seven outcomes of matching, by what the symbols of the matched record resolve to and whether the stated system allows them."""
    owner = F.col("match")
    k = owner % 6
    numbers = F.when(k > 1, F.array(owner * 9 + 1, owner * 7 + 2)).otherwise(F.array().cast("array<int>"))
    stated = S.crystal_system(owner * 9 + 1)
    own = _matched(t).withColumns({"k": k, "numbers": F.array_distinct(numbers), "stated": stated})
    fit = F.filter("numbers", lambda x: S.compatible_system(F.col("stated"), S.crystal_system(x)))
    status = (
        F.when(owner.isNull(), "unmatched_name").when(F.col("k") == 0, "matched_no_spacegroup").when(F.col("k") == 1, "matched_unresolved_symbol").when(F.size(fit) == 0, "matched_crystal_system_conflict")
        .when((F.size(fit) == 1) & (F.size("numbers") == 1), "usable_unique_spacegroup").when(F.size(fit) == 1, "usable_after_crystal_system_filter").otherwise("matched_ambiguous_spacegroup")
    )
    return own.select("s_suppkey", status.alias("status"))


@query("""WITH f AS (SELECT doc_id, quality AS old, CASE WHEN doc_id % 4 = 0 THEN quality WHEN doc_id % 4 = 1 THEN toxic END AS new FROM labels)
SELECT doc_id, CASE WHEN old IS NOT NULL AND new IS NOT NULL AND old <> new THEN old ELSE coalesce(new, old) END AS label, old IS NOT NULL AND new IS NOT NULL AND old <> new AS conflict, CASE WHEN new IS NOT NULL AND old = new THEN 'both' WHEN new IS NOT NULL THEN 'new' ELSE 'original' END AS origin FROM f""")
def enrich_merge(t):
    """A new label wins unless it contradicts the old one; contradictions are flagged and the original kept."""
    k = F.col("doc_id") % 4
    f = t.labels.select("doc_id", F.col("quality").alias("old"), F.when(k == 0, F.col("quality")).when(k == 1, F.col("toxic")).alias("new"))
    conflict = F.coalesce(F.col("old") != F.col("new"), F.lit(False))
    return f.select("doc_id", F.when(conflict, F.col("old")).otherwise(F.coalesce("new", "old")).alias("label"), conflict.alias("conflict"), F.when(F.col("old") == F.col("new"), "both").when(F.col("new").isNotNull(), "new").otherwise("original").alias("origin"))


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_writer_wins(t):
    order = Window.partitionBy("source").orderBy("doc_id")
    return t.documents.select("source", "doc_id").withColumn("r", F.row_number().over(order)).where("r = 1").select("source", "doc_id")
