"""Merkle fixity audit of WARC archives: replicas are compared from the roots down, only mismatches are descended.

Each replica is measured by itself: its records are hashed where they are read, and only their keys, lengths and
hashes move. A leaf is a record's place, offset range and hash; a parent hashes the ranges and hashes of 16 children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.llm.common import fresh_path, stored, tidy

FANOUT_BITS = 4  # a node has up to 16 children
ARCHIVE_RECORDS = 4096
LEAF = ("archive", "node", "start", "end", "hash")


def warc_record(url: Column, html: Column) -> Column:
    """Bytes of a response record: headers, blank line, body, two line ends."""
    body = F.coalesce(html, F.lit(""))
    return F.encode(F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")), "UTF-8")


def archived(pages: DataFrame, records: int = ARCHIVE_RECORDS) -> DataFrame:
    """archive, page_id, url, record for every page, without a shuffle.

    Archives are dealt by a hash of URL and id, so a hot host spreads over all of them; null URLs and bodies are empty.
    """
    count = max(1, -(-pages.count() // records))
    key = F.md5(F.concat_ws("#", F.coalesce("url", F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    return pages.select((F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % count).alias("archive"), "page_id",
                        F.coalesce("url", F.lit("")).alias("url"), warc_record(F.col("url"), F.col("html")).alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """LEAF and the key (page_id, url, copy) of every record: in an archive records lie in order of URL, id and hash, one
    behind the other. copy numbers equal keys; a null record has no bytes and no hash.

    The sort is of narrow rows by archive, whose number of records is bounded by the dealing.
    """
    narrow = records.select("archive", "page_id", "url", F.coalesce(F.octet_length("record"), F.lit(0)).cast("long").alias("size"), F.sha2("record", 256).alias("hash"))
    w = Window.partitionBy("archive").orderBy("url", "page_id", "hash")
    upto = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    copy = F.row_number().over(Window.partitionBy("archive", "url", "page_id").orderBy("hash"))
    out = narrow.withColumns({"node": F.row_number().over(w).cast("long") - 1, "end": upto}).withColumn("copy", copy)
    return out.select("archive", "node", (F.col("end") - F.col("size")).alias("start"), "end", "hash", "page_id", "url", "copy")


def height(*every: DataFrame) -> int:
    """Levels above the leaves that the largest archive of any replica needs."""
    most = max((x.agg(F.max("node")).first()[0] or 0) for x in every)
    return -(-int(most).bit_length() // FANOUT_BITS)


def tree(leaves_: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """Levels of the Merkle trees of all archives, leaves first, the last a root an archive: LEAF.

    A parent hashes its children's ranges and hashes in order; a node has at most 16 children, so no group grows.
    """
    out = [leaves_.select(*LEAF)]
    for level in range(1, levels + 1):
        child = F.struct("node", "start", "end", "hash")
        line = lambda c: F.concat_ws(":", c["start"], c["end"], F.coalesce(c["hash"], F.lit("-")))
        up = out[-1].groupBy("archive", F.shiftright("node", FANOUT_BITS).alias("node")).agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), line), "\n"), 256).alias("hash"))
        out.append(stored(up.select(*LEAF), f"{name}-{level}"))
    return out


def audit(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """archive and node of the leaves that differ or that one side lacks; both trees have as many levels.

    Roots are compared first, those of archives that only one replica has differing; below, only children of differing
    nodes take part, so an intact archive costs a root. Nodes differ by range or hash.
    """
    bad = None
    for level in range(len(one) - 1, -1, -1):
        said = lambda df, side: df.select("archive", "node", F.struct("start", "end", F.coalesce("hash", F.lit("-")).alias("hash")).alias(side))
        sides = [said(x[level], s) for x, s in ((one, "l"), (two, "r"))]
        if bad is not None:
            parents = bad.select(F.col("archive").alias("a"), F.col("node").alias("p"))
            sides = [x.join(parents, (F.col("archive") == F.col("a")) & (F.shiftright("node", FANOUT_BITS) == F.col("p")), "left_semi") for x in sides]
        both = sides[0].join(sides[1], ["archive", "node"], "full")
        bad = both.where(~F.col("l").eqNullSafe(F.col("r"))).select("archive", "node")
    return bad


def located(one: DataFrame, two: DataFrame, bad: DataFrame) -> DataFrame:
    """What the differing leaves come down to, by record: status missing (in the replica), added (only there) or
    changed, with places and hashes in both. Records that only moved, because others before them changed in length,
    are no finding. one and two are leaves()."""
    key = ["archive", "page_id", "url", "copy"]
    said = lambda df, side: df.join(bad, ["archive", "node"], "left_semi").select(
        *key, F.struct(F.col("node").alias("ordinal"), "start", "end", "hash").alias(side))
    l, r = said(one, "l"), said(two, "r").withColumnsRenamed({k: f"r_{k}" for k in key})  # noqa: E741
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    both = l.join(r, same, "full")
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "added").when(~F.col("l.hash").eqNullSafe(F.col("r.hash")), "changed")
    named = [F.coalesce(k, f"r_{k}").alias(k) for k in ("archive", "page_id", "url")]
    return both.withColumn("status", status).where("status IS NOT NULL").select(
        *named, "status", F.col("l.ordinal").alias("ordinal"), F.col("l.start").alias("start_offset"), F.col("l.end").alias("end_offset"), F.col("l.hash").alias("sha256"),
        F.col("r.ordinal").alias("replica_ordinal"), F.col("r.start").alias("replica_start"), F.col("r.end").alias("replica_end"), F.col("r.hash").alias("replica_sha256"))


def compared(records: DataFrame, replica: DataFrame) -> DataFrame:
    """located() between two tables of records (archive, page_id, url, record).

    Null ids and URLs are keys like others; a null record is one without bytes; equal records are told apart by their
    number; an empty replica gives every record as missing, two empty ones no row; very long records are only hashed.
    """
    one, two = stored(leaves(records), "leaves"), stored(leaves(replica), "leaves-replica")
    levels = height(one, two)
    bad = stored(audit(tree(one, levels, "tree"), tree(two, levels, "tree-replica")), "differing")
    return located(one, two, bad)


def damaged(records: DataFrame) -> DataFrame:
    """A replica with damage that the data decide by the first two digits of the URL's MD5: 5a has another first byte,
    c3 has lost its bytes, e7 is not there, and f1 is there a second time under another URL."""
    mark = F.substring(F.md5("url"), 1, 2)
    first = F.concat(F.encode(F.lit("X"), "UTF-8"), F.expr("substring(record, 2)"))
    kept = records.where(mark != "e7").withColumn("record", F.when(mark == "5a", first).when(mark == "c3", F.lit(None)).otherwise(F.col("record")))
    return kept.withColumn("url", F.explode(F.when(mark == "f1", F.array("url", F.concat("url", F.lit("#copy")))).otherwise(F.array("url"))))


@tidy
def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located damage between the archives of all pages and a damaged replica of them; both are written and read back."""
    folders = [fresh_path(spark, "warc"), fresh_path(spark, "warc-replica")]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archived(pages).write.option("compression", "zstd").parquet(folders[0])
    records = spark.read.parquet(folders[0])
    damaged(records).write.option("compression", "zstd").parquet(folders[1])
    return compared(records, spark.read.parquet(folders[1]))


QUERIES = {"op4_merkle_audit": op4_merkle_audit}
ORACLES = {"op4_merkle_audit": r"""
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 4096.0) AS BIGINT)) AS archives FROM pages),
r AS (
  SELECT page_id, coalesce(url, '') AS url, md5(coalesce(url, ''))[1:2] AS mark,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
      || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    CAST(('0x' || md5(coalesce(url, '') || '#' || coalesce(CAST(page_id AS VARCHAR), ''))[1:8]) AS BIGINT) % n.archives AS archive
  FROM pages, n),
s AS (
  SELECT archive, page_id, url, strlen(record) AS size, sha256(record) AS hash, mark FROM r),
d AS (
  SELECT archive, page_id, url, CASE WHEN mark = 'c3' THEN 0 ELSE strlen(record) END AS size,
    CASE mark WHEN '5a' THEN sha256('X' || record[2:]) WHEN 'c3' THEN NULL ELSE sha256(record) END AS hash FROM r WHERE mark <> 'e7'
  UNION ALL SELECT archive, page_id, url || '#copy', strlen(record), sha256(record) FROM r WHERE mark = 'f1'),
a AS (
  SELECT *, row_number() OVER w - 1 AS ordinal, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS end_offset,
    row_number() OVER (PARTITION BY archive, url, page_id ORDER BY hash) AS copy
  FROM s WINDOW w AS (PARTITION BY archive ORDER BY url, page_id NULLS FIRST, hash NULLS FIRST)),
b AS (
  SELECT *, row_number() OVER w - 1 AS ordinal, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS end_offset,
    row_number() OVER (PARTITION BY archive, url, page_id ORDER BY hash) AS copy
  FROM d WINDOW w AS (PARTITION BY archive ORDER BY url, page_id NULLS FIRST, hash NULLS FIRST))
SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.url, b.url) AS url,
  CASE WHEN b.archive IS NULL THEN 'missing' WHEN a.archive IS NULL THEN 'added' ELSE 'changed' END AS status,
  CAST(a.ordinal AS BIGINT) AS ordinal, CAST(a.end_offset - a.size AS BIGINT) AS start_offset, CAST(a.end_offset AS BIGINT) AS end_offset, a.hash AS sha256,
  CAST(b.ordinal AS BIGINT) AS replica_ordinal, CAST(b.end_offset - b.size AS BIGINT) AS replica_start, CAST(b.end_offset AS BIGINT) AS replica_end,
  b.hash AS replica_sha256
FROM a FULL JOIN b ON a.archive = b.archive AND a.url = b.url AND a.page_id IS NOT DISTINCT FROM b.page_id AND a.copy = b.copy
WHERE a.hash IS DISTINCT FROM b.hash
"""}
