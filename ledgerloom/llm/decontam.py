"""Benchmark decontamination over a distributed positional inverted index.

:func:`build_index` turns documents into a stored index of all their terms: one row per document block, with its sorted
terms and, for each, its posting list of places. Posting lists lie within a row, so intersecting those of a phrase needs
no shuffle, a row is never split between tasks, and an executor that is lost costs only its own blocks. It is built once and
can be searched any number of times.

:func:`search` takes query phrases, and in every block starts from the rarest term of each phrase, shifts its places by
the term's offset, and intersects the other terms' shifted lists, rarest first, until none is left or all agree (exact
phrase). With ``slop`` it also returns places of the rarest term around which all terms occur close together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

#: A-Z to lower case; every other ASCII byte that is no digit or small letter divides words; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

MATCH = "array<struct<item:string,first:long,last:long,exact:boolean>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """Query phrases: every ``size`` consecutive words of an item, or all of a shorter item that has any.

    Returns ``item`` (the id as text), ``offset`` and ``terms``; nulls and texts without words give no rows.
    """
    folded = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.regexp_extract_all(folded, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    listed = items.select(F.col(id_col).cast("string").alias("item"), parts.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return listed.select("item", "w", F.explode(starts).alias("offset")).select("item", "offset", F.slice("w", F.col("offset") + 1, F.lit(size)).alias("terms"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = 100_000) -> DataFrame:
    """The index, stored: a row per block of documents with ``ids`` and ``lengths`` (words), ``terms`` (sorted), ``ends`` (where
    each term's postings end) and ``steps`` (postings: each term's first place, then the distances between its places), the
    last two as 32-bit little-endian numbers, since only searches read them.

    A place is the number of words before it in the block, with a gap between documents, so no phrase spans two. A block
    ends at ``block_words`` words; a longer text is a block of its own, whole. Null ids and texts are kept (null text: no
    words); repeated rows are separate documents; an empty table gives an empty index. A block takes most of a megabyte, so
    a row group has few of them: a task's memory depends on the size of a block, not on how many its file holds.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    lists = {"ids": kind, "lengths": T.LongType(), "terms": T.StringType()}
    schema = T.StructType([*(T.StructField(n, T.ArrayType(t)) for n, t in lists.items()), *(T.StructField(n, T.BinaryType()) for n in ("ends", "steps"))])

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0

        def emit() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            coded = pa.array([w for ws in texts for w in ws], pa.binary()).dictionary_encode()
            terms = coded.dictionary
            order = pc.array_sort_indices(terms).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            term = rank[coded.indices.to_numpy()]
            place = np.arange(len(term)) + np.repeat(np.arange(len(texts)), lengths)
            by_term = np.argsort(term, kind="stable")
            place = place[by_term]
            ends = np.cumsum(np.bincount(term, minlength=len(order)))
            steps = np.diff(place, prepend=0)
            first = ends[:-1]
            steps[first] = place[first]
            row = [pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())), pa.ListArray.from_arrays([0, len(terms)], terms.take(pa.array(order)).cast(pa.string())), *(pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (ends, steps))]
            return pa.RecordBatch.from_arrays(row, schema.names)

        for part in parts:
            id_type = part.schema.field(0).type
            for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids.append(i)
                texts.append(words(text.as_py()))
                held += len(texts[-1])
                if held >= block_words:
                    yield emit()
                    ids, texts, held = [], [], 0
        if ids:
            yield emit()

    return stored(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(blocks, schema), "index", group_rows=8)


def _exact(lists: dict[int, np.ndarray], phrase: np.ndarray) -> np.ndarray:
    """First places of a phrase: offset-adjusted lists, intersected from the shortest."""
    order = sorted(range(len(phrase)), key=lambda i: len(lists[phrase[i]]))
    first = lists[phrase[order[0]]] - order[0]
    for i in order[1:]:
        if not len(first):
            break
        other = lists[phrase[i]] - i
        at = np.searchsorted(other, first)
        at[at == len(other)] = 0
        first = first[other[at] == first] if len(other) else first[:0]
    return first


def _near(lists: dict[int, np.ndarray], phrase: np.ndarray, reach: int) -> np.ndarray:
    """Places of the rarest term with every other term of the phrase at most ``reach`` words away."""
    terms = sorted(set(phrase.tolist()), key=lambda t: len(lists[t]))
    at = lists[terms[0]]
    for t in terms[1:]:
        if not len(at):
            break
        other = lists[t]
        at = at[np.searchsorted(other, at - reach) < np.searchsorted(other, at + reach, "right")]
    return at


def search(index: DataFrame, queries: list[tuple[str | None, int, list[str]]], slop: int | None = None) -> DataFrame:
    """One row per indexed document: ``doc_id``, ``n_words``, ``n_hit`` (words inside exact matches) and ``matches``.

    ``matches`` lists every match: the item, the first and last word (numbers within the document), and whether it is an
    exact phrase. With ``slop``, places where all terms of a phrase lie within its length plus ``slop`` words of the rarest
    one are listed too, as not exact. Documents without matches have an empty array. Items may be null. ``queries`` is one
    bounded block; :func:`contaminated` searches the blocks one after the other.
    """
    terms = sorted({t for _, _, ts in queries for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    merged: dict[tuple[int, ...], set[str | None]] = {}
    for item, _, ts in queries:
        merged.setdefault(tuple(number[t] for t in ts), set()).add(item)
    listing = [(np.array(k), sorted(v, key=lambda x: (x is None, x or ""))) for k, v in merged.items()]
    shared = index.sparkSession.sparkContext.broadcast((listing, terms))
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("matches", T._parse_datatype_string(MATCH))])
    match_type = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("exact", pa.bool_())]))

    def searched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, names = shared.value
        asked = pa.array(names, pa.string())
        width = max((len(p) for p, _ in listed), default=1)
        table = np.zeros((len(listed), width), np.int64)
        for i, (p, _) in enumerate(listed):
            table[i] = np.resize(p, width)
        for part in parts:
            for k in range(part.num_rows):
                cell = lambda name: part.column(name)[k].values
                lengths = cell("lengths").to_numpy(zero_copy_only=False)
                ends, steps = (np.frombuffer(part.column(n)[k].as_py(), "<i4") for n in ("ends", "steps"))
                at = pc.fill_null(pc.index_in(asked, value_set=cell("terms")), -1).to_numpy(zero_copy_only=False)
                here = at >= 0
                starts = np.concatenate([[0], np.cumsum(lengths + 1)])
                found: list[list[dict]] = [[] for _ in lengths]
                cover = np.zeros(int(starts[-1]) + 1, np.int32)
                alive = np.flatnonzero(here[table].all(axis=1)) if len(listed) else np.empty(0, np.int64)
                lists = {t: np.cumsum(steps[ends[at[t] - 1] if at[t] else 0 : ends[at[t]]], dtype=np.int64) for t in np.unique(table[alive]).tolist()}
                for q in alive:
                    phrase, items = listed[q]
                    first = _exact(lists, phrase)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + len(phrase), -1)
                    spans = [(f, f + len(phrase) - 1, True) for f in first.tolist()]
                    if slop is not None:
                        near = _near(lists, phrase, len(phrase) - 1 + slop)
                        owner = np.searchsorted(starts, near, "right") - 1
                        spans += [(a, a, False) for a, o in zip(near.tolist(), owner.tolist(), strict=True) if _inside(lists, phrase, a, len(phrase) - 1 + slop, starts[o], starts[o + 1])]
                    for f, last, exact in spans:
                        d = int(np.searchsorted(starts, f, "right")) - 1
                        found[d] += [{"item": i, "first": f - int(starts[d]), "last": last - int(starts[d]), "exact": exact} for i in items]
                hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
                yield pa.RecordBatch.from_arrays([cell("ids"), pa.array(lengths, pa.int64()), pa.array(hit[starts[1:]] - hit[starts[:-1]], pa.int64()), pa.array(found, match_type)], schema.names)

    return index.mapInArrow(searched, schema)


def _inside(lists: dict[int, np.ndarray], phrase: np.ndarray, at: int, reach: int, lo: int, hi: int) -> bool:
    """Whether every term has a place near ``at`` within the same document."""
    lo, hi = max(lo, at - reach), min(hi, at + reach + 1)
    return all(np.searchsorted(lists[t], lo) < np.searchsorted(lists[t], hi) for t in set(phrase.tolist()))


def contaminated(docs: DataFrame, items: DataFrame, *, size: int = 10, slop: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_phrases: int = 200_000) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_words``, ``n_hit`` and ``matches``, for all phrases of ``items``.

    The documents are indexed once. The phrases are a stated query set, held on the driver in blocks of ``block_phrases``
    (about 30 MB each), which search the stored index one after another; with several, the rows of a document are merged by
    a number given to it in the index. Empty ``items`` find nothing; empty ``docs`` give an empty result; null items are
    items like others.
    """
    queries = phrases(items, item_col, item_text_col, size)
    n_blocks = max(1, -(-queries.count() // block_phrases))
    listed = lambda df: [(r.item, r.offset, r.terms) for r in df.collect()]
    if n_blocks == 1:
        return search(build_index(docs, id_col, text_col), listed(queries), slop)
    numbered = docs.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id")).alias("_key"), F.col(text_col).alias("_text"))
    index = build_index(numbered, "_key", "_text")
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("item", "offset"), F.lit(n_blocks))), "phrases")
    found = None
    for b in range(n_blocks):
        part = search(index, listed(queries.filter(F.col("block") == b)), slop)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    return merged.select(F.col("doc_id.id").alias("doc_id"), "n_words", _covered(F.col("matches")).alias("n_hit"), "matches")


def _covered(matches):
    """Number of distinct words inside exact matches."""
    spans = F.array_sort(F.transform(F.filter(matches, lambda m: m["exact"]), lambda m: F.struct(m["first"].alias("a"), m["last"].alias("b"))))
    zero = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(s["b"] - F.greatest(acc["end"], s["a"] - 1), F.lit(0))).alias("n"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def decontam_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns, from :func:`contaminated`."""
    found = contaminated(docs, benchmark)
    items = F.array_sort(F.array_distinct(F.transform(F.filter("matches", lambda m: m["exact"]), lambda m: m["item"])))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_only(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text") -> DataFrame:
    """Documents (all columns) in which no phrase of the benchmark occurs.

    Only the numbers of rows with hits leave the search. Texts are nulls, empty and repeated as :func:`contaminated` says. Rows
    are kept whole as one struct, so columns may have any names.
    """
    keyed = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    texts = keyed.select("row", F.col("doc")[text_col].alias("text"))
    hits = contaminated(texts, benchmark, size=size, id_col="row", text_col="text").filter("n_hit > 0").select(F.col("doc_id").alias("_hit"))
    return keyed.join(hits, F.col("row") == F.col("_hit"), "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS p
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
s AS (
  SELECT doc_id, i, k, array_to_string(w[i + 1 : i + k], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
m AS (SELECT s.doc_id, s.i, s.k, q.item_id FROM s JOIN q USING (p, k)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
