"""WARC fixity audit with Merkle trees.

``manifest`` writes each row as a WARC record, deals records to files and
gives every record its offset, length and SHA-256. A file's records stand in
the order of a hash of their page_id, so each prefix of that hash is one range
of offsets. ``tree`` hashes these ranges upwards: a node covers the ``FANOUT``
ranges one hexadecimal digit longer and hashes their numbers, lengths and
hashes in order, up to one root a file. ``audit`` compares the roots of two
replicas and descends only below nodes that differ; in the shortest ranges
that differ it pairs records by page_id.

As a node knows the lengths in it and not where it begins, a record that is
lost or added changes the nodes above it and no others: it is one damaged
record. The lowest nodes hash their records by sums of the digests' parts, so
a page_id that repeats without bound is added up and never gathered.

All of it is DataFrame operations. A file holds about ``RECORDS`` records,
dealt by hash, so no group grows with the input.

Defined results: null html or url count as empty; records of one page_id are
ordered by digest and, in a range that differs, first matched by equal
digests, then in that order; a record that only one replica has is damaged
(digest or their_digest is null, with the offsets of the replica that has
it); repeated rows are records each; an empty table gives an empty manifest;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terraloom.llm.common import store

RECORDS = 1000
FANOUT = 16  #: one hexadecimal digit


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def n_files(pages: DataFrame, records: int = RECORDS) -> int:
    return max(1, -(-pages.count() // records))


def manifest(pages: DataFrame, files: int) -> DataFrame:
    """page_id, warc_file, spot, position, offset, length, digest of each of ``pages`` (page_id, url, html)."""
    md5 = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    number = lambda at, n: F.conv(F.substring(md5, at, n), 16, 10).cast("long")
    rows = pages.select("page_id", F.pmod(number(1, 8), F.lit(files)).alias("warc_file"), number(9, 8).alias("spot"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("_r"))
    rows = rows.select("page_id", "warc_file", "spot", F.octet_length("_r").cast("long").alias("length"), F.sha2("_r", 256).alias("digest"))
    order = Window.partitionBy("warc_file").orderBy("spot", F.col("page_id").asc_nulls_first(), "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("page_id", "warc_file", "spot", (F.row_number().over(order) - 1).cast("long").alias("position"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "digest")


def levels_for(records: int, fanout: int = FANOUT) -> int:
    """Digits of the lowest nodes, so that one holds about a record; eight at most."""
    n = 1
    while fanout**n < records and n < 8:
        n += 1
    return n


def _node(level: int) -> Column:
    """The number of the node of ``level`` digits in which a record stands."""
    return F.shiftright("spot", 4 * (8 - level))


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (warc_file, node, length, digest) of each level, stored, the lowest (of ``levels`` digits) first, roots last."""
    part = lambda k: F.sum(F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    low = records.groupBy("warc_file", _node(levels).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), *[part(k).alias(f"_{k}") for k in range(4)])
    low = store(low.select("warc_file", "node", "length", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("length").cast("string"), *[f"_{k}" for k in range(4)]), 256).alias("digest")), "merkle")
    out = [low]
    for _ in range(levels):
        kids = F.array_sort(F.collect_list(F.struct("node", "length", "digest")))  # at most FANOUT of them
        up = out[-1].groupBy("warc_file", F.shiftright("node", 4).alias("node")).agg(F.sum("length").alias("length"), kids.alias("_kids"))
        text = F.array_join(F.transform("_kids", lambda k: F.concat_ws("+", k["node"].cast("string"), k["length"].cast("string"), k["digest"])), ":")
        out.append(store(up.select("warc_file", "node", "length", F.sha2(text, 256).alias("digest")), "merkle"))
    return out


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(warc_file, node) of the lowest nodes that differ, found from the roots down."""
    below: DataFrame | None = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        a = a.select("warc_file", "node", F.col("digest").alias("_a"))
        b = b.select("warc_file", "node", F.col("digest").alias("_b"))
        if below is not None:
            parent = lambda x: x.withColumn("_up", F.shiftright("node", 4)).join(below, ["warc_file", "_up"], "left_semi").drop("_up")
            a, b = parent(a), parent(b)
        differ = a.join(b, ["warc_file", "node"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("warc_file", "node")
        below = differ.select("warc_file", F.col("node").alias("_up"))
    return differ


def paired(ours: DataFrame, theirs: DataFrame, differ: DataFrame, levels: int) -> DataFrame:
    """The records that differ, with both digests: in nodes of ``differ``, what has no equal on the other side, paired by page_id."""
    nth = lambda *by: F.row_number().over(Window.partitionBy("warc_file", *by).orderBy("digest", "position"))
    key = F.struct(F.col("page_id").isNull().alias("null"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"))

    def inside(x: DataFrame) -> DataFrame:
        held = x.withColumn("node", _node(levels)).join(differ, ["warc_file", "node"], "left_semi").drop("node")
        return held.withColumn("_id", key).withColumn("_nth", nth("page_id", "digest"))

    a, b = inside(ours), inside(theirs)
    same = ["warc_file", "_id", "digest", "_nth"]
    lone = lambda x, y: x.join(y.select(*same), same, "left_anti").withColumn("_nth", nth("page_id"))
    left = lone(a, b).select("warc_file", "_id", "_nth", F.struct("page_id", "spot", "position", "offset", "length", "digest").alias("_a"))
    right = lone(b, a).select("warc_file", "_id", "_nth", F.struct("page_id", "spot", "position", "offset", "length", "digest").alias("_b"))
    return left.join(right, ["warc_file", "_id", "_nth"], "full").select("warc_file", "_a", "_b")


def audit_pages(pages: DataFrame, replica: DataFrame, records: int = RECORDS) -> DataFrame:
    """The manifest of ``pages`` with their_digest and damaged, after auditing ``replica`` against it; records only the replica has follow."""
    files = n_files(pages, records)
    levels = levels_for(2 * records)
    ours, theirs = store(manifest(pages, files), "manifest"), store(manifest(replica, files), "manifest")
    differ = store(audit(tree(ours, levels), tree(theirs, levels)), "merkle-differ")
    found = store(paired(ours, theirs, differ, levels), "merkle-found")
    mine = found.where(F.col("_a").isNotNull()).select("warc_file", F.col("_a.position").alias("position"), F.col("_b.digest").alias("_theirs"), F.lit(True).alias("_found"))
    rows = ours.join(mine, ["warc_file", "position"], "left")
    bad = F.coalesce("_found", F.lit(False))
    rows = rows.select("page_id", "warc_file", "position", "offset", "length", "digest", F.when(bad, F.col("_theirs")).otherwise(F.col("digest")).alias("their_digest"), bad.alias("damaged"))
    more = found.where(F.col("_a").isNull()).select("_b.page_id", "warc_file", "_b.position", "_b.offset", "_b.length", F.lit(None).cast("string").alias("digest"), F.col("_b.digest").alias("their_digest"), F.lit(True).alias("damaged"))
    return rows.union(more)
