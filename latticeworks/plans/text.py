"""Queries on text fields: parsing, tokens, lists, names, keys, rounding, encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeworks.functions import strings as S
from latticeworks.operators import symbols as symbol_table
from latticeworks.registry import query

_CELL_SQL = "SELECT p_partkey, 'a: ' || p_retailprice || '(3) b: ' || p_size || ' alpha: 90 beta: 99.65(1) gamma: ' || p_size || ' crystal system: ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' c: 7.5' ELSE '' END AS cell FROM part"


def _cells(t):
    text = F.concat(F.lit("a: "), F.col("p_retailprice").cast("string"), F.lit("(3) b: "), F.col("p_size").cast("string"), F.lit(" alpha: 90 beta: 99.65(1) gamma: "), F.col("p_size").cast("string"), F.lit(" crystal system: "), F.col("p_type"), F.when(F.col("p_size") % 2 == 0, " c: 7.5").otherwise(""))
    return t.part.select("p_partkey", text.alias("cell"))


@query(f"""SELECT p_partkey, TRY_CAST(regexp_extract(cell, '(?i)\\ba\\s*:\\s*([-+]?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS a, TRY_CAST(nullif(regexp_extract(cell, '(?i)\\bc\\s*:\\s*([-+]?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS c,
TRY_CAST(regexp_extract(cell, '(?i)\\bbeta\\s*:\\s*([-+]?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS beta, lower(regexp_extract(cell, '(?i)\\bcrystal system\\s*:\\s*([a-z]+)', 1)) AS system FROM ({_CELL_SQL})""")
def cell_text_parse(t):
    cell = F.col("cell")
    return _cells(t).select("p_partkey", *(S.number_field(cell, n).alias(n) for n in ("a", "c", "beta")), S.word_field(cell, "crystal system").alias("system"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) + CAST(p_retailprice AS DOUBLE) AS total, p_partkey % 3 <> 0 AS parsed FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, NULL, false FROM part WHERE p_partkey % 3 = 0")
def tuple_parse(t):
    text = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(", "), F.col("p_retailprice").cast("string"), F.lit(")"))).otherwise("(1, x)")
    parsed = S.tuple_of(text, 2)
    return t.part.select("p_partkey", (parsed[0] + parsed[1]).alias("total"), parsed.isNotNull().alias("parsed"))


_ELEMENTS_SQL = "[" + ", ".join(f"'{e}'" for e in S.ELEMENTS) + "]"


@query(f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]?')) AS el FROM documents) SELECT doc_id, string_agg(DISTINCT el, ',' ORDER BY el) AS elements FROM m WHERE list_contains({_ELEMENTS_SQL}, el) GROUP BY doc_id""")
def element_tokens(t):
    found = S.formula_elements(F.col("text"))
    return t.documents.select("doc_id", found.alias("e")).where(F.size("e") > 0).select("doc_id", F.array_join(F.array_sort("e"), ",").alias("elements"))


@query(f"""WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]?')) AS el FROM documents) SELECT el, count(*) AS n FROM m WHERE list_contains({_ELEMENTS_SQL}, el) GROUP BY el""")
def element_vocab(t):
    return t.documents.select(F.explode(S.formula_elements(F.col("text"))).alias("el")).groupBy("el").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS kept FROM part")
def element_normalise(t):
    """Lists lose nulls and 'nan'; an empty list is null."""
    items = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("nan"), F.lit(None))).otherwise(F.concat(F.split("p_name", " "), F.array(F.lit("NaN"))))
    return t.part.select("p_partkey", F.array_join(S.clean_list(items), " ").alias("kept"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS DOUBLE) * 1.5 END AS total FROM events")
def json_list_parse(t):
    """JSON inside a string column, and a list of numbers that is null as a whole if one item doesn't parse."""
    k = F.from_json("props", "k long")["k"]
    text = F.concat(F.lit('["'), k.cast("string"), F.lit('","'), F.when(F.col("event_id") % 4 == 0, "x").otherwise((k * 0.5).cast("string")), F.lit('"]'))
    numbers = S.float_list(F.from_json(text, "array<string>"))
    return t.events.select("event_id", k.alias("k"), F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""WITH c AS (SELECT l_orderkey, l_returnflag AS el, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT l_orderkey, list_reduce(list(n), lambda a, b: gcd(a, b)) AS g FROM c GROUP BY 1)
SELECT l_orderkey, string_agg(el || CASE WHEN n = g THEN '' ELSE CAST(n // g AS VARCHAR) END, '' ORDER BY el) AS formula FROM c JOIN g USING (l_orderkey) GROUP BY l_orderkey""")
def reduced_formula(t):
    c = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("el")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("l_orderkey").agg(F.collect_list(F.struct("el", "n")).alias("counts")).select("l_orderkey", S.reduced_formula(F.col("counts")).alias("formula"))


@query("SELECT n_nationkey, regexp_replace(lower(strip_accents('É' || n_name || ' (Ünder) -')), '[^a-z0-9]', '', 'g') AS plain, lower(trim('  ' || n_name)) AS exact FROM nation")
def name_normalise(t):
    return t.nation.select("n_nationkey", S.plain_name(F.concat(F.lit("É"), "n_name", F.lit(" (Ünder) -"))).alias("plain"), S.exact_name(F.concat(F.lit("  "), "n_name")).alias("exact"))


@query("SELECT c_custkey, regexp_extract(c_name, '\\d{5,}', 0) AS id, len(regexp_extract_all(c_name || ' R12345 R9', 'R\\d{5,}')) AS n FROM customer")
def id_extract(t):
    return t.customer.select("c_custkey", F.regexp_extract("c_name", r"\d{5,}", 0).alias("id"), F.size(F.regexp_extract_all(F.concat("c_name", F.lit(" R12345 R9")), F.lit(r"R\d{5,}"), F.lit(0))).cast("long").alias("n"))


@query("SELECT o_orderkey, replace('raw\\' || o_orderpriority || '\\x.npy', '\\', '/') AS path, split_part(o_orderpriority, '-', 2) AS suffix FROM orders")
def path_normalise(t):
    return t.orders.select("o_orderkey", F.regexp_replace(F.concat(F.lit("raw\\"), "o_orderpriority", F.lit("\\x.npy")), r"\\", "/").alias("path"), F.substring_index("o_orderpriority", "-", -1).alias("suffix"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'processed/train' WHEN 'O' THEN 'processed/test' ELSE 'raw' END || '/' || o_custkey || '/' || o_orderkey || '.npy' AS path FROM orders")
def role_path(t):
    """The path of a row's file, made anew from its role and ids."""
    root = F.when(F.col("o_orderstatus") == "F", "processed/train").when(F.col("o_orderstatus") == "O", "processed/test").otherwise("raw")
    return t.orders.select("o_orderkey", F.concat_ws("/", root, F.col("o_custkey").cast("string"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".npy"))).alias("path"))


@query()
def row_seed(t):
    """Seeds of each row for two independent draws."""
    return t.documents.select("doc_id", S.row_seed("source", "doc_id").alias("seed"), S.row_seed("source", "doc_id", second=True).alias("second"))


@query("SELECT s_suppkey, round_even(s_acctbal, 0) AS whole, round_even(s_acctbal / 8, 2) AS cents FROM supplier")
def half_even_rounding(t):
    return t.supplier.select("s_suppkey", F.bround("s_acctbal", 0).alias("whole"), F.bround(F.col("s_acctbal") / 8, 2).alias("cents"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, round(coalesce(nullif(l_tax, 0), 1.5406::DOUBLE) / 1.54, 6) AS w1, round(coalesce(nullif(l_discount, 0), 0) / 1.54, 6) AS w2, CAST(nullif(l_discount, 0) IS NOT NULL AS INTEGER) AS has2 FROM lineitem")
def lambda_features(t):
    second = F.nullif("l_discount", F.lit(0.0))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.round(F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.lit(1.5406)) / 1.54, 6).alias("w1"), F.round(F.coalesce(second, F.lit(0.0)) / 1.54, 6).alias("w2"), second.isNotNull().cast("int").alias("has2"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS f FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_transform(['A', 'N', 'R', 'X'], lambda v: CAST(list_contains(f, v) AS INTEGER)), '') AS hot, array_to_string(f, ',') AS back FROM s""")
def multi_hot_roundtrip(t):
    vocab = F.array(*(F.lit(v) for v in "ANRX"))
    hot = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f")).withColumn("bits", F.transform(vocab, lambda v: F.array_contains("f", v).cast("int")))
    back = F.filter(vocab, lambda v, i: F.get("bits", i) == 1)
    return hot.select("l_orderkey", F.array_join(F.transform("bits", lambda x: x.cast("string")), "").alias("hot"), F.array_join(back, ",").alias("back"))


@query("SELECT vec_id, round(CAST(list_max(list_transform(embedding, lambda x: sqrt(greatest(CAST(x AS DOUBLE), 0)))) AS DOUBLE), 6) AS top, round(CASE WHEN list_max(embedding) > 0 THEN list_sum(list_transform(embedding, lambda x: least(sqrt(greatest(CAST(x AS DOUBLE), 0)) / sqrt(CAST(list_max(embedding) AS DOUBLE)), 1))) ELSE 0.0::DOUBLE END, 5) AS total FROM embeddings")
def sqrt_normalise(t):
    """Square roots over their maximum; a vector without a positive value is all zero."""
    roots = F.transform("embedding", lambda x: F.sqrt(F.greatest(x.cast("double"), F.lit(0.0))))
    own = t.embeddings.select("vec_id", roots.alias("y")).withColumn("_top", F.array_max("y"))
    total = F.aggregate("y", F.lit(0.0), lambda a, x: a + F.least(x / F.col("_top"), F.lit(1.0)))
    return own.select("vec_id", F.round("_top", 6).alias("top"), F.round(F.when(F.col("_top") > 0, total).otherwise(0.0), 5).alias("total"))


@query("SELECT coalesce(nullif(lower(trim(CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_mktsegment END)), ''), 'missing') AS category, count(*) AS n FROM customer GROUP BY 1")
def category_missing(t):
    raw = F.when(F.col("c_custkey") % 6 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, "  ").otherwise(F.col("c_mktsegment"))
    return t.customer.groupBy(F.coalesce(F.nullif(F.lower(F.trim(raw)), F.lit("")), F.lit("missing")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_SYM_SQL = "SELECT p_partkey, p_name || ' | ' || p_brand || '; ' || p_type || ' (' || p_name || ')' AS s FROM part"


def _symbols(t):
    return t.part.select("p_partkey", S.symbols(F.concat("p_name", F.lit(" | "), "p_brand", F.lit("; "), "p_type", F.lit(" ("), "p_name", F.lit(")"))).alias("s"))


@query("SELECT p_partkey, p_name || '/' || p_brand || '/' || p_type AS symbols, 3 AS n FROM part")
def symbol_split(t):
    return _symbols(t).select("p_partkey", F.array_join("s", "/").alias("symbols"), F.size("s").alias("n"))


@query("""WITH d AS (SELECT p_partkey, replace(p_brand, '#', '') AS symbol FROM part), m AS (SELECT DISTINCT replace(p_brand, '#', '') AS symbol, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) * 9 AS number FROM part WHERE p_brand NOT IN ('Brand#3', 'Brand#7'))
SELECT p_partkey, number, CASE WHEN number <= 2 THEN 'triclinic' WHEN number <= 15 THEN 'monoclinic' WHEN number <= 74 THEN 'orthorhombic' WHEN number <= 142 THEN 'tetragonal' WHEN number <= 167 THEN 'trigonal' WHEN number <= 194 THEN 'hexagonal' WHEN number <= 230 THEN 'cubic' END AS system FROM d LEFT JOIN m USING (symbol)""")
def symbol_resolve(t):
    brand = F.regexp_replace("p_brand", "#", "")
    own = t.part.select("p_partkey", S.canonical_symbol(F.concat(F.lit("_"), brand, F.lit("?"))).alias("symbol"))
    table = t.part.where(~F.col("p_brand").isin("Brand#3", "Brand#7")).select(brand.alias("symbol"), (F.regexp_replace("p_brand", "Brand#", "").cast("int") * 9).alias("number")).distinct()
    return own.join(table, "symbol", "left").select("p_partkey", "number", S.crystal_system(F.col("number")).alias("system"))


_SPELLED_SQL = """
w AS (SELECT p_partkey AS key, [p_name, '_' || p_brand || ' ' || p_size % 9, p_type] AS symbols FROM part),
v AS (SELECT key, flatten(list_transform(symbols, lambda s: [s, replace(s, '_', ''), regexp_replace(replace(s, '_', ''), '\\s+', '', 'g')])) AS all_of FROM w),
u AS (SELECT key, unnest(all_of) AS candidate, unnest(range(1, len(all_of) + 1)) AS i FROM v),
f AS (SELECT key, candidate, min(i) AS i FROM u GROUP BY ALL), c AS (SELECT key, candidate, CAST(row_number() OVER (PARTITION BY key ORDER BY i) AS INTEGER) AS rank FROM f)"""


def _spelled(t):
    """Each part's name, brand (with a size in subscript digits and marks) and, in parentheses, type."""
    size = F.translate((F.col("p_size") % 9).cast("string"), "0123456789", "₀₁₂₃₄₅₆₇₈₉")
    return t.part.select("p_partkey", F.concat("p_name", F.lit(" | _"), "p_brand", F.lit(" "), size, F.lit(" ("), "p_type", F.lit(")")).alias("text"))


@query(f"WITH {_SPELLED_SQL} SELECT key AS p_partkey, rank, candidate FROM c")
def symbol_candidates(t):
    """The spellings to try for each part, in turn, by the table function."""
    return symbol_table.candidates(_spelled(t), "p_partkey", "text").select(F.col("key").alias("p_partkey"), "rank", "candidate")


@query(f"""WITH {_SPELLED_SQL}, d AS (SELECT DISTINCT replace(p_brand, '_', '') || p_size % 9 AS symbol, 10 * (p_size % 9) + length(p_brand) AS number FROM part WHERE p_size % 9 < 7)
SELECT key AS p_partkey, arg_min(number, rank) AS number, arg_min(candidate, rank) AS candidate FROM c JOIN d ON symbol = candidate GROUP BY key""")
def symbol_lookup(t):
    """The first spelling that a table of symbols has, with its number."""
    table = t.part.where("p_size % 9 < 7").select(F.concat(F.regexp_replace("p_brand", "_", ""), (F.col("p_size") % 9).cast("string")).alias("symbol"), (10 * (F.col("p_size") % 9) + F.length("p_brand")).cast("long").alias("number")).distinct()
    return symbol_table.resolve(_spelled(t), "p_partkey", "text", table).select(F.col("key").alias("p_partkey"), "number", "candidate")


@query("""WITH c AS (SELECT p_partkey, p_size % 4 + 1.0::DOUBLE AS a, p_size % 3 + 1.0::DOUBLE AS b, p_size % 2 + 1.0::DOUBLE AS c, CASE WHEN p_size % 5 = 0 THEN 100 ELSE 90 END AS be, CASE WHEN p_size % 7 = 0 THEN 120 ELSE 90 END AS ga FROM part)
SELECT p_partkey, CASE WHEN be = 90 AND ga = 90 AND a = b AND b = c THEN 'cubic' WHEN be = 90 AND ga = 90 AND a = b THEN 'tetragonal' WHEN be = 90 AND ga = 90 THEN 'orthorhombic' WHEN a = b AND be = 90 AND ga = 120 THEN 'hexagonal' WHEN ga = 90 AND be <> 90 THEN 'monoclinic' ELSE 'triclinic' END AS system FROM c""")
def lattice_system_case(t):
    size, right = F.col("p_size"), F.lit(90.0)
    sides = [(size % n + 1.0) for n in (4, 3, 2)]
    return t.part.select("p_partkey", S.lattice_system(*sides, right, F.when(size % 5 == 0, 100.0).otherwise(90.0), F.when(size % 7 == 0, 120.0).otherwise(90.0)).alias("system"))
