"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming search, links confirmed on full sets.

A document's shingle set gives a signature of 60 b-bit MinHash values. Two sets with Jaccard similarity s differ in each
value with probability 1 - s, so the Hamming distance over values of a pair at 0.8 is 12 on average, and beyond
``MAX_DISTANCE`` = 29 about twice in ten million pairs. The signature is split into 15 chunks of 4 values. By the pigeonhole
principle a pair within 29 differences has a chunk with at most one (15 x 2 > 29), so enumerating that one allowed error
(leaving out each value of each chunk in turn: 60 keys a signature) makes every such pair meet under some key.

Groups of copies never turn into all their pairs:

* equal sets are one class from the start;
* keys that hold the same members count as one key;
* under each key, members meet the key's smallest class only (a star), and confirmed links join components;
* only keys whose members then still lie in different components are looked at again, in groups of bounded size, where
  full sets are intersected by a matrix product; only links between different components leave a group. Members of larger
  keys meet otherwise: two sets that overlap enough share one of their rarest shingles, so each meets others under those
  of its shingles that are rarest among all these members, and passages that many quote bring none together.

So a link that is not needed to connect its component is not spelled out, but none that connects is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

CHUNKS, WIDTH = 15, 4
VALUES = CHUNKS * WIDTH
MAX_DISTANCE = 29
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; of all words as one if there are fewer; none of none."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = _mixed(h * _MIX + w[i : i + n - k + 1])
    return np.unique(h)


_FACTORS = np.random.default_rng(20_240_229).integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray) -> np.ndarray:
    """``VALUES`` MinHash values of 16 bits."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(found), 512):  # stays within the processor's cache
            np.minimum(low, (found[lo : lo + 512, None] * _FACTORS).min(axis=0), out=low)
        return (_mixed(low) & np.uint64(0xFFFF)).astype(np.int32)


def sketches(docs: DataFrame, id_col: str, text_col: str, row_col: str, size: int) -> DataFrame:
    """``id``, ``row``, ``n`` (set size), ``set_key`` (128-bit hash of the set; null if empty) and ``sig`` for every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("sig", T.ArrayType(T.IntegerType()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 512):
                cut, n, keys, sigs = part.slice(lo, 512), [], [], []
                for text in cut.column(2):
                    found = shingles(text.as_py(), size)
                    n.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    sigs.append(signature(found) if len(found) else None)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], schema.names)

    return docs.select(F.col(id_col), F.col(row_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """``cid``, ``n`` and ``shingles`` of rows (cid, n, set_key, text) whose text has the class's set."""
    schema = T.StructType([T.StructField("cid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 512):
                cut, at, sets = part.slice(lo, 512), [], []
                for i, (key, text) in enumerate(zip(cut.column("set_key"), cut.column("text"), strict=True)):
                    found = shingles(text.as_py(), size)
                    if xxhash.xxh3_128_digest(found.tobytes()) == key.as_py():
                        at.append(i)
                        sets.append(found.view(np.int64))
                yield pa.RecordBatch.from_arrays([*(cut.column(c).take(pa.array(at, pa.int64())) for c in ("cid", "n")), pa.array(sets, pa.list_(pa.int64()))], schema.names)

    return rows.select("cid", "n", "set_key", "text").mapInArrow(run, schema)


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that never passes through the driver. Spark guesses the size of exploded arrays, and of files of numbers that compress
    well, far too low, and would broadcast tables of the corpus's size."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def _keys(sig: Column) -> Column:
    """All keys of a signature: every chunk with each one of its values left out."""
    keys = []
    for c in range(CHUNKS):
        for e in range(WIDTH):
            rest = [F.get(sig, F.lit(c * WIDTH + i)) for i in range(WIDTH) if i != e]
            keys.append(F.xxhash64(F.lit(c * WIDTH + e), *rest))
    return F.array(*keys)


def components(edges: DataFrame) -> DataFrame:
    """``cid`` and ``comp`` (smallest cid reachable) for the nodes of ``edges`` (columns a, b), by large and small stars.

    Every round is a grouping and a join on distinct edges, written to the shared folder; no component is ever collected.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Large: every larger neighbour of u moves to u's smallest. Small: u and its smaller neighbours do."""
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        moved = _met(both, low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"), F.col("a").alias("u"))
        moved = moved.filter("a > u") if large else moved
        out = moved.select("a", "b")
        if not large:
            out = out.unionByName(low.select("a", F.col("low").alias("b")))
        return out.filter("a <> b").distinct()

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not now.isEmpty():
        before, now = now, stored(star(star(now, True), False), "edges")
        # Edges are distinct, so as many edges of which none is new are the same edges.
        if now.count() == before.count() and now.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    nodes = now.select(F.col("a").alias("cid"), F.col("b").alias("comp"))
    return nodes.unionByName(now.select(F.col("b").alias("cid"), F.col("b").alias("comp")).distinct())


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough."""
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"x{x}"))
    size = lambda x: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"))
    # Sizes first, so that sets of too different sizes do not travel.
    near = pairs.join(size("a"), "a").join(size("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    shared = F.size(F.array_intersect("xa", "xb"))
    full = near.join(side("b"), "b").join(side("a"), "a").withColumn("shared", shared)
    return full.filter(F.lit(100) * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def _tile_links(key: tuple, tile: pa.Table, percent: int, columns: int = 4096) -> pa.Table:
    """Links between different components in one tile: at most one for two components.

    Set intersections are counted exactly as a product of 0/1 matrices, over the shingles that two members share, in
    blocks of ``columns``.
    """
    first = {c: i for i, c in reversed(list(enumerate(tile["cid"].to_pylist())))}
    at = np.array(sorted(first.values()))
    tile = tile.take(pa.array(at))
    cid, comp = tile["cid"].to_numpy(), tile["comp"].to_numpy()
    lists = tile["shingles"].combine_chunks()
    owner = np.repeat(np.arange(len(cid)), lists.value_lengths().to_numpy())
    _, code, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[code]
    size = np.bincount(owner, minlength=len(cid))
    shared = np.zeros((len(cid), len(cid)))
    order = np.argsort(number, kind="stable")
    edges = np.searchsorted(number[order], np.arange(0, number.max(initial=-1) + 1 + columns, columns))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        m = np.zeros((len(cid), columns), np.float32)
        m[owner[order[lo:hi]], number[order[lo:hi]] - k * columns] = 1
        shared += m @ m.T
    linked = (100 * shared >= percent * (size[:, None] + size[None, :] - shared)) & (comp[:, None] < comp[None, :])
    i, j = np.nonzero(linked)
    _, one = np.unique(np.stack([comp[i], comp[j]], axis=1), axis=0, return_index=True) if len(i) else (None, np.empty(0, np.int64))
    return pa.table({"a": pa.array(cid[i[one]], pa.int64()), "b": pa.array(cid[j[one]], pa.int64())})


def _split_keys(rows: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Rows (key, cid, comp) with keys of more than ``tile`` members replaced by rare shingles.

    All members of such keys are taken together, each once. Order shingles by how many of them hold one, rarest first. Two
    sets with 100 * intersection >= percent * union share one of the first ``n - ceil(percent * n / 100) + 1`` shingles of
    each. So no link is lost, and what very many members quote comes last. Shingles that one member has, or that lie in one
    component, bring nobody together.
    """
    large = rows.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > tile).select("key")
    members, rest = _met(rows, large, "key", "left_semi").select("cid", "comp").distinct(), _met(rows, large, "key", "left_anti")
    held = _met(members, sets.select("cid", "n", "shingles"), "cid").select("cid", "comp", "n", F.explode("shingles").alias("s"))
    often = held.groupBy("s").agg(F.count("*").alias("often"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("often", "s"))
    first = _met(held, often, "s").withColumn("place", place).filter(100 * (F.col("n") - F.col("place") + 1) >= percent * F.col("n"))
    return rest.select("key", "cid", "comp").unionByName(first.filter("c0 < c1").select(F.xxhash64("s", F.lit("shingle")).alias("key"), "cid", "comp"))


def _cross_links(rows: DataFrame, sets: DataFrame, percent: int, tile: int, tile_shingles: int = 500_000) -> DataFrame:
    """Links across components among rows (key, cid, comp), every key cut into tiles and every two tiles compared once.

    A tile holds about ``tile`` members and ``tile_shingles`` shingles. Keys of more members come as rare shingles, so
    members are repeated only where very many share a rare one and are not linked.
    """
    rows = stored(_split_keys(rows, sets, percent, tile), "open")
    total = _met(rows, sets.select("cid", "n"), "cid").groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    sizes = total.select("key", F.greatest(F.ceil(F.col("m") / tile), F.ceil(F.col("n") / tile_shingles)).cast("int").alias("tiles"))
    dealt = _met(rows, sizes, "key").withColumn("t", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    met = dealt.select("key", "cid", "comp", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, "t").alias("i"), F.greatest(o, "t").alias("j")))).alias("at"))
    full = _met(met, sets.select("cid", "shingles"), "cid").select("key", "at.i", "at.j", "cid", "comp", "shingles")
    return full.groupBy("key", "i", "j").applyInArrow(lambda k, t: _tile_links(k, t, percent), "a long, b long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, row_col: str, size: int, percent: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and ``set_key``, ``id`` (the smallest of the set) and ``comp`` of every set that is not empty.

    ``row_col`` is a key of the rows that is the same at every reading.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(row_col).alias("_row"), F.col(text_col).cast("string").alias("text"))
    rows = stored(sketches(docs, id_col, text_col, row_col, size), "sketches")
    classes = rows.filter("n > 0").groupBy("set_key").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("cid", F.explode(_keys(F.col("sig"))).alias("key"))
    held = keyed.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("cid")).alias("print")).filter("low < high")
    leaders = held.groupBy("low", "high", "m", "print").agg(F.min("key").alias("key")).select("key", "low")
    met = stored(_met(keyed, leaders, "key").select("key", "cid", "low"), "met")
    involved = met.select("cid").distinct().join(classes, "cid").join(texts, F.col("row") == F.col("_row"))
    sets = stored(full_sets(involved, size), "sets")
    links = stored(_star_links(met.filter("cid > low").select(F.col("low").alias("a"), F.col("cid").alias("b")).distinct(), sets, percent), "links")
    comp = stored(components(links), "components")
    now = _met(met.select("key", "cid"), comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).filter("c0 < c1")
    # A key of two members has had its one pair tested by the star.
    rest = stored(_met(now, mixed.filter("m > 2").select("key"), "key"), "open")
    more = stored(_cross_links(rest, sets, percent, tile), "links")
    if not more.isEmpty():
        comp = stored(components(links.unionByName(more)), "components")

    return rows, _met(classes.select("cid", "set_key", "id"), comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, percent: int = 85, tile: int = 1024) -> DataFrame:
    """Group documents linked by ``100 * intersection >= percent * union`` of their shingle sets.

    Returns one row per input row: the id, ``n_shingles``, ``component_id`` (the smallest id reachable over links, itself
    included) and ``kept`` (whether that is its own id).

    Null, empty and word-free texts have empty sets and are linked with nothing. Repeated rows have equal sets, so they
    share a component; each gets its row. Null ids are ignored for the smallest id. ``percent`` under 80 weakens the
    guarantee of the candidate search. An empty table gives an empty result.
    """
    keyed = stored(docs.select(id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "rows")
    rows, named = _grouped(keyed, id_col, text_col, "_row", size, percent, tile)
    lowest = named.groupBy("comp").agg(F.min("id").alias("component"))
    named = named.join(lowest, "comp").select("set_key", "component")
    out = rows.select("id", "n", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 85) -> DataFrame:
    """Documents (all columns) without near-duplicates: one row of each component, and every row without words.

    The row with the smallest id stays, nulls last; of equal ids, the first as stored. Ids need not be distinct. Rows are kept
    whole as one struct, so columns may have any names.
    """
    keyed = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    rows, named = _grouped(keyed.select(F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].alias("text"), "row"), "id", "text", "row", 5, percent, 1024)
    first = rows.join(named.select("set_key", "comp"), "set_key").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    keep = first.select(F.col("first.row").alias("_kept")).unionByName(rows.filter("n = 0").select(F.col("row").alias("_kept")))
    return keyed.join(keep, keyed["row"] == F.col("_kept"), "left_semi").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
