"""Merkle fixity audit of WARC records.

Every page becomes a WARC response record; records lie in files in order, each on its own range of offsets. A leaf is
the hash of a record with its range; 16 neighbouring nodes make a parent that hashes theirs and covers their ranges.
Two replicas are compared by their roots, and only below nodes that differ are the children compared, down to the
records that differ. A replica is another table of pages; its records are hashed by themselves and laid on the ranges of
the first manifest, so that a lost record doesn't shift the records after it. Where damage is rare, the descent reads
little beside the roots.

Scale: DataFrame operations only. Record bytes are hashed where they are read and never move; trees hold about a
hundred bytes a record, and each comparison reads the level below the mismatches only. Records meet by file, at most
a few thousand at a time.

Defined results: a null url or html is empty text, a null id is written as an empty id; repeated rows are records of
their own, in any order among themselves; pages of any length are one record, hashed whole; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.llm._store import materialize

FILE_RECORDS, FANOUT = 4096, 16


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC/1.1 response record, as text."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def hashed(pages: DataFrame) -> DataFrame:
    """page_id, hash and length of every page's record."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return own.select("page_id", F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("long").alias("length"))


def manifest(pages: DataFrame) -> DataFrame:
    """page_id, file, leaf, start, end, hash of every record.

    Files hold about FILE_RECORDS records, dealt by a hash of id and content; within a file records are ordered by id.
    """
    leaves = materialize(hashed(pages), "fixity-leaves")
    n_files = max(1, -(-leaves.count() // FILE_RECORDS))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "hash"))
    filed = leaves.withColumn("file", F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(n_files)))
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "hash")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = filed.withColumns({"leaf": (F.row_number().over(order) - 1).cast("long"), "end": F.sum("length").over(upto)})
    return materialize(placed.select("page_id", "file", "leaf", (F.col("end") - F.col("length")).alias("start"), "end", "hash"), "fixity-manifest")


def _counts(hashes: DataFrame, name: str) -> DataFrame:
    return hashes.groupBy("page_id", "hash").agg(F.count(F.lit(1)).alias(name))


def held(found: DataFrame, replica: DataFrame) -> DataFrame:
    """The manifest with ``other``, the hash of each record as ``replica`` (page_id, hash) holds it.

    Records are known by their id; among those of one id, equal ones answer to each other first, as often as both stores
    have them. The rest answer to what else the replica has under the id, or to nothing: lost.
    """
    group = found.groupBy("page_id", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("leaf").alias("first"))
    both = _matched(group, _counts(replica, "m"))
    left = both.where("coalesce(m, 0) > coalesce(n, 0)").groupBy("page_id").agg(F.min("hash").alias("changed"))
    short = both.where("n > coalesce(m, 0)").select("page_id", "hash", "first", F.coalesce("m", F.lit(0)).alias("m"))  # few, where damage is rare
    known = short.join(left.withColumnRenamed("page_id", "id"), F.col("page_id").eqNullSafe(F.col("id")), "left").select(F.col("page_id").alias("id"), F.col("hash").alias("own"), "first", "m", "changed")
    marked = found.join(known, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("own")), "left")
    kept = F.col("own").isNull() | (F.col("leaf") - F.col("first") < F.col("m"))  # equal records are neighbours in one file
    return marked.select(*found.columns, F.when(kept, F.col("hash")).otherwise(F.col("changed")).alias("other"))


def _matched(one: DataFrame, two: DataFrame) -> DataFrame:
    two = two.withColumnsRenamed({"page_id": "id", "hash": "own"})
    both = one.join(two, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("own")), "full")
    return both.withColumns({"page_id": F.coalesce("page_id", "id"), "hash": F.coalesce("hash", "own")}).drop("id", "own")


def extra(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id and records: how many more records the replica has under an id than the first store."""
    both = _matched(_counts(hashed(pages), "n"), _counts(hashed(replica), "m"))
    return both.groupBy("page_id").agg((F.sum(F.coalesce("m", F.lit(0))) - F.sum(F.coalesce("n", F.lit(0)))).alias("records")).where("records > 0")


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: FANOUT neighbours hash to one node over their joint range."""
    text = lambda x: F.concat_ws(":", x["hash"], x["start"].cast("string"), x["end"].cast("string"))
    child = F.struct("node", "hash", "start", "end")
    return nodes.groupBy("file", F.floor(F.col("node") / FANOUT).alias("up")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), text), ","), 256).alias("hash"), F.min("start").alias("start"), F.max("end").alias("end")
    ).select("file", F.col("up").alias("node"), "hash", "start", "end")


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of the trees of all files, leaves first; the last level has the roots, node 0 of each file."""
    levels = [leaves]
    top = leaves.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0]
    while True:
        levels.append(parents(levels[-1]))
        top //= FANOUT
        if not top:
            return [levels[0], *(materialize(x, "fixity-level") for x in levels[1:])]


def differing(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """(file, node) of the leaves that differ: from the roots, only children of differing nodes are compared."""
    bad = None
    for a, b in zip(reversed(one), reversed(other), strict=True):
        if bad is not None:
            below = bad.select("file", F.col("node").alias("up"))
            a, b = (x.withColumn("up", F.floor(F.col("node") / FANOUT)).join(below, ["file", "up"], "left_semi") for x in (a, b))
        a = a.select("file", "node", F.col("hash").alias("a"))
        b = b.select("file", "node", F.col("hash").alias("b"))
        bad = a.join(b, ["file", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")
    return bad


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of ``pages`` with its place, its hash, the root of its file, and whether ``replica``, another store's pages, doesn't hold it unchanged."""
    found = materialize(held(manifest(pages), hashed(replica)), "fixity-held")
    place = found.withColumn("node", F.col("leaf"))
    lost = F.sha2(F.lit("lost"), 256)
    one = tree(place.select("file", "node", "hash", "start", "end"))
    two = tree(place.select("file", "node", F.coalesce("other", lost).alias("hash"), "start", "end"))
    bad = differing(one, two).select("file", F.col("node").alias("leaf"), F.lit(True).alias("bad"))
    roots = one[-1].select("file", F.col("hash").alias("root"))
    out = found.join(roots, "file").join(bad, ["file", "leaf"], "left")
    return out.select("page_id", "file", "leaf", "start", "end", F.col("hash").alias("sha256"), "root", F.coalesce("bad", F.lit(False)).alias("corrupt"))


def damaged(pages: DataFrame, one_in: int = 256) -> DataFrame:
    """A replica for audit drills: the same pages, but about one in ``one_in``, by a hash of the url, has a changed text, and as many are lost."""
    draw = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("url"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(one_in))
    return pages.where(draw != 1).withColumn("html", F.when(draw == 0, F.concat(F.lit("\x00"), F.coalesce("html", F.lit("")))).otherwise(F.col("html")))
