"""Lines that many documents share, by hash ranges, in DataFrame functions only.

Every line is reduced to a 128-bit hash of its key. Hashes are dealt to partitions by range; in a partition they are sorted by
hash, document and position, and a window streams through them: the first line of a key in a document counts the document.
What goes back to a document is a compressed bitmap, the runs of lines that it loses; texts are not dealt by line.

A key with a large share of all lines would fill one range. The commonest keys of a bounded sample are therefore dealt over all
partitions, each document to one, and their counts are added up. The sample decides about places only: every line is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

#: ASCII white space, which is stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column) -> Column:
    """The keys of all lines: stripped, A to Z in lower case."""
    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n"), lambda x: F.trim(x, F.lit(STRIPPED)))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: hash of the key (k1, k2), document (id, t), position."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(line_keys(text)).alias("at", "key"))
    long = keys.filter(F.length("key") >= min_chars)
    return long.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), "id", "t", "at")


def _commonest(docs: DataFrame, id_col: str, text_col: str, min_chars: int, one_in: int, at_most: int) -> DataFrame:
    """The hashes of the commonest keys in one of ``one_in`` documents; ``at_most`` rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = docs.filter(F.pmod(F.xxhash64(F.lit(7), F.col(id_col).cast("string"), text), F.lit(one_in)) == 0)
    n = _lines(some, id_col, text_col, min_chars).groupBy("k1", "k2").agg(F.count("*").alias("n"))
    return n.filter("n > 1").orderBy(F.desc("n"), "k1", "k2").limit(at_most).select("k1", "k2")


def _runs(at: Column) -> Column:
    """Sorted positions as runs of neighbours: where each starts, and its length."""
    starts = lambda p: F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i - 1) == x - 1, F.lit(False)))
    ends = lambda p: F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i + 1) == x + 1, F.lit(False)))
    return let(at, lambda p: F.transform(F.arrays_zip(starts(p).alias("a"), ends(p).alias("b")), lambda r: F.struct(r["a"].alias("start"), (r["b"] - r["a"] + 1).alias("n"))))


def without_runs(text: Column, dropped: Column) -> Column:
    """The lines of ``text`` outside the runs, joined again. Every line is copied once, whatever the number of runs."""

    def kept(x: Column) -> Column:
        lines, runs = x["lines"], x["runs"]
        begin = lambda i: F.coalesce(F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["n"], F.lit(0))
        end = lambda i: F.coalesce(F.get(runs, i)["start"], F.size(lines))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i)))), "\n")

    return F.when(F.size(dropped) > 0, let(F.struct(F.split(text, "\n").alias("lines"), dropped.alias("runs")), kept)).otherwise(text)


def line_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    one_in: int = 64,
    commonest: int = 1000,
) -> DataFrame:
    """Which lines every document loses: those whose key at least ``min_docs`` documents hold.

    Returns one row per input row: ``row`` (a struct of all input columns, so clashing names cannot meet), ``n_lines``,
    ``dropped`` (the compressed bitmap: runs of lines that go, with their starts from 0 and lengths) and ``n_dropped``. With
    ``keep_first`` the first line of each key (by id, nulls first, then position) stays.

    A null or empty text is one empty line. Keys of under ``min_chars`` code points are never dropped. Rows that agree in id and
    text are one document, so they are counted once and get the same bitmap; rows that share only the id are different documents.
    An empty table gives an empty result.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # At most ``commonest`` rows, so they may be broadcast.
    common = F.broadcast(_commonest(docs, id_col, text_col, min_chars, one_in, commonest).withColumn("spread", F.lit(True)))
    lines = _lines(docs, id_col, text_col, min_chars).join(common, ["k1", "k2"], "left").withColumn("spread", F.coalesce("spread", F.lit(False)))
    # Hashes are even, so equal ranges of them are even too.
    of_range = F.least(F.floor((F.col("k1") / 2.0**64 + 0.5) * n), F.lit(n - 1)).cast("int")
    place = F.when(F.col("spread"), F.pmod(of_range + F.pmod("t", F.lit(n)), F.lit(n))).otherwise(of_range).cast("int")
    dealt = lines.withColumn("place", place).repartitionById(n, F.col("place"))
    key, doc = ["place", "k1", "k2"], F.struct("id", "t")
    inorder = Window.partitionBy(*key).orderBy("id", "t", "at")
    streamed = dealt.withColumn("opens", ~doc.eqNullSafe(F.lag(doc).over(inorder)))
    whole = inorder.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = streamed.withColumn("docs", F.sum(F.col("opens").cast("long")).over(whole)).withColumn("nth", F.row_number().over(inorder))
    # Keys that were spread: one row a partition, added up; at most ``commonest`` rows again.
    parts = streamed.groupBy(*key).agg(F.sum(F.col("opens").cast("long")).alias("docs"), F.bool_or("spread").alias("spread"), F.min(F.struct("id", "t", "at")).alias("first"))
    total = parts.filter("spread").groupBy("k1", "k2").agg(F.sum("docs").alias("all_docs"), F.min("first").alias("first"))
    judged = counted.join(F.broadcast(total), ["k1", "k2"], "left")
    goes = F.when(F.col("spread"), F.col("all_docs")).otherwise(F.col("docs")) >= min_docs  # by the flag, so that both reads deal the same columns and share one shuffle
    if keep_first:
        goes = goes & F.when(F.col("spread"), ~F.struct("id", "t", "at").eqNullSafe(F.col("first"))).otherwise(F.col("nth") > 1)
    runs = judged.filter(goes).groupBy("id", "t").agg(_runs(F.sort_array(F.collect_set("at"))).alias("dropped"))
    back = runs.select(F.struct(F.col("id").isNotNull().alias("known"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "t").alias("_doc"), "dropped")
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("t")).alias("_doc"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    none = F.array().cast("array<struct<start:int,n:int>>")
    return rows.join(back, "_doc", "left").select(
        "row", "n_lines", F.coalesce("dropped", none).alias("dropped"), F.coalesce(F.aggregate("dropped", F.lit(0).cast("long"), lambda a, r: a + r["n"]), F.lit(0)).cast("long").alias("n_dropped")
    )


def lines_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the lines that they lose; columns as in the input, null texts stay null."""
    found = line_bitmaps(docs, id_col, text_col, **options)
    clean = without_runs(F.col("row")[text_col].cast("string"), F.col("dropped"))
    return found.select(*[(clean if f.name == text_col else F.col("row")[f.name]).alias(f.name) for f in docs.schema])


def line_digest(docs: DataFrame) -> DataFrame:
    """The query's columns, from :func:`line_bitmaps`. A null text counts as empty."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return line_bitmaps(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(without_runs(text, F.col("dropped")), 256).alias("kept_sha256"))


#: DuckDB SQL for the query.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT r, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, often.key IS NOT NULL AS gone FROM k LEFT JOIN often USING (key)),
g AS (SELECT r, count(*) AS n_lines, count_if(gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (r)
"""
