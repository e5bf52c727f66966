"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has `size` coordinates. In round i < size each shingle falls into a coordinate by a hash
of its own and offers the value (i, hash); in round size + k all offer one to coordinate k. The least value stays, and a document is done
when all its coordinates have one. So every coordinate is filled, for short documents too, in O(size log size +
shingles) steps, and the share of equal coordinates is concentrated about the Jaccard similarity as if they were
drawn without replacement. Bands of `rows` coordinates collide: at a similarity of 0.85 two documents miss
all 52 bands of 8 with a probability of 7e-8. One byte of each coordinate is kept to estimate similarities.

Documents with equal sets are one node. Links are found among nodes, never as all pairs of a bucket, and only forests of links leave a
task; components are contracted after each step, and a step sees only buckets that still hold several components:
1. each node is held against one other by their full sets, the least pivot of its buckets, twice; this joins most groups;
2. then the members of each bucket come together with their full sets in chunks bounded in bytes, and each chunk keeps the components it
   finds (union-find), comparing only nodes of different components: first each node in its largest bucket, then all buckets;
3. at last chunks of one bucket meet in pairs, for buckets of several chunks. No partner is left out.
Pairs go on to the full sets if their sketches' estimate is at most 5.5 standard deviations below the least similarity,
which a true link falls short of with a probability of 2e-8; what those sets say is final.

Rules: texts without words are in no group and stay. Copies and equal rows are one node. A null doc_id takes part but
is never a group's smallest unless all are null, and is then not kept. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.llm.common import addressed, released, rereadable, shuffles_removed, stored
from daytrail.llm.shingles import mixed_bits, shingle_sets

#: Shingles and coordinates a worker holds at once, each in several arrays.
CHUNK_COST = 250_000


@dataclass(frozen=True)
class Near:
    """`percent`: least similarity of a link in hundredths. A chunk has `chunk` nodes and `shingles` shingles in the mean at most."""

    percent: int = 85
    width: int = 5
    rows: int = 8
    bands: int = 52
    chunk: int = 1024
    shingles: int = 1 << 19

    @property
    def least_equal(self) -> int:
        """Coordinates that a pair's sketches must share to be verified."""
        n, p = self.rows * self.bands, self.percent / 100
        return int(n * p - 5.5 * (n * p * (1 - p)) ** 0.5)


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row of `size` coordinates for each set; sets must not be empty."""
    out = np.full(len(sets) * size, -1, np.int64).astype(np.uint64)  # above any value
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    empty = out[0] if len(out) else None
    for i in range(2 * size):
        if not len(items):
            break
        hashed = mixed_bits(items + np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        value = np.uint64(i << 32) | (hashed & np.uint64(0xFFFFFFFF))
        if i < size:
            place = owner * size + ((hashed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            place = owner * size + (i - size)
        np.minimum.at(out, place, value)
        waiting = (out.reshape(-1, size) == empty).any(axis=1)
        stay = waiting[owner]
        if not stay.all():
            items, owner = items[stay], owner[stay]
    return out.reshape(-1, size)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band, the band's number within it."""
    n = sketch.shape[1] // rows
    parts = sketch[:, :n * rows].reshape(len(sketch), n, rows)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), (len(sketch), n)).copy()
    for k in range(rows):
        key = mixed_bits(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.astype(np.int64)


def sketched(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """(doc_id, file, row, n_shingles, node, keys, sketch): node, the set's 128-bit fingerprint, is null for an empty set."""
    size = near.rows * near.bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, cost = 0, [], 0
            for s in shingle_sets(batch["text"], near.width):
                held.append(s)
                cost += len(s) + size
                if cost > CHUNK_COST:
                    yield rows(batch.slice(at, len(held)), held)
                    at, held, cost = at + len(held), [], 0
            if held:
                yield rows(batch.slice(at, len(held)), held)

    def rows(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list[np.ndarray | None] = [None] * len(sets)
        sketch = sketches([sets[i] for i in full], size)
        bytes_: list[bytes | None] = [None] * len(sets)
        for i, k, c in zip(full, band_keys(sketch, near.rows), sketch.astype(np.uint8), strict=True):
            keys[i], bytes_[i] = k, c.tobytes()
        nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([
            batch["doc_id"], batch["__file"], batch["__row"], pa.array(list(map(len, sets)), pa.int64()),
            pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())],
            ["doc_id", "__file", "__row", "n_shingles", "node", "keys", "sketch"])

    own = addressed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(released(run), "doc_id LONG, __file LONG, __row LONG, n_shingles LONG, node BINARY, keys ARRAY<LONG>, sketch BINARY")


def full_sets(docs: DataFrame, wanted: DataFrame, near: Near = Near()) -> DataFrame:
    """(node, shingles) of the rows that stand for the wanted nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, cost = 0, [], 0
            for s in shingle_sets(batch["text"], near.width):
                held.append(s.view(np.int64))
                cost += len(s)
                if cost > CHUNK_COST:
                    yield rows(batch["node"].slice(at, len(held)), held)
                    at, held, cost = at + len(held), [], 0
            if held:
                yield rows(batch["node"].slice(at, len(held)), held)

    def rows(nodes: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([nodes, pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    texts = addressed(docs, F.col("text").cast("string").alias("text"))
    return texts.join(wanted, ["__file", "__row"]).select("text", "node").mapInArrow(released(run), "node BINARY, shingles ARRAY<LONG>")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, by alternating large and small stars (Kiveris et al., 2014).

    `links`: (a, b). Each step joins edges with a minimum per node, so a node's many edges need no single task.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        if large:
            out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def settled(edges: DataFrame) -> bool:
        """Whether all edges (a, b), b < a, are stars: a node has one edge down, or edges from above only. One shuffle tells."""
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
            edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        with shuffles_removed(edges.sparkSession):
            return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").isEmpty()

    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(down.filter("a <> b").distinct(), "edges")
    while not settled(edges):
        edges = stored(star(star(edges, True), False), "edges")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def similar_size(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _coordinates(sketch: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = sketch.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, 1), np.uint8)


def likely(pairs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = (_coordinates(batch["x"]) == _coordinates(batch["y"])).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(equal >= near.least_equal))

    of = nodes.select("node", "sketch")
    both = pairs.join(of.withColumnsRenamed({"node": "a", "sketch": "x"}), "a").join(of.withColumnsRenamed({"node": "b", "sketch": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(released(compare), "a BINARY, b BINARY")


def forest(table: pa.Table, percent: int, least_equal: int) -> pa.Table:
    """Links (a, b) that join the roots of a chunk's nodes, or of two chunks' nodes; no more than there are roots less one.

    `table`: (node, n, root, sketch, shingles, side); nodes of sides 0 and 1 are compared across, those of side 2 with each other.
    """
    names, roots, side = table["node"].to_pylist(), table["root"].to_pylist(), table["side"].to_numpy()
    n, sketch = table["n"].to_numpy(), _coordinates(table["sketch"])
    sets = table["shingles"].combine_chunks()
    flat, begin = sets.values.to_numpy(), sets.offsets.to_numpy()
    number: dict[bytes, int] = {}
    component = np.array([number.setdefault(r, len(number)) for r in roots])
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    a, b = [], []
    for i in left.tolist():
        fit = right[(component[right] != component[i]) & (np.minimum(n[right], n[i]) * 100 >= np.maximum(n[right], n[i]) * percent)]
        if side[i] == 2:
            fit = fit[fit > i]
        fit = fit[(sketch[fit] == sketch[i]).sum(axis=1) >= least_equal]
        for j in fit.tolist():
            if component[i] == component[j]:
                continue
            both = len(np.intersect1d(flat[begin[i]:begin[i + 1]], flat[begin[j]:begin[j + 1]], assume_unique=True))
            if both * 100 >= percent * (n[i] + n[j] - both):
                a.append(min(names[i], names[j])), b.append(max(names[i], names[j]))
                component[component == component[j]] = component[i]
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def within(members: DataFrame, nodes: DataFrame, sets: DataFrame, near: Near, across: bool) -> DataFrame:
    """Forests (a, b) of the links between roots in each chunk of each bucket, or `across` each two chunks of one bucket.

    `members`: (key, node, n, root).
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    count = F.greatest(F.ceil(F.col("c") / near.chunk), F.ceil(F.col("s") / near.shingles))
    dealt = members.join(sizes.select("key", count.alias("chunks")), "key").withColumn("own", F.pmod(F.xxhash64("node"), "chunks"))
    if across:
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
        dealt = dealt.filter("chunks > 1").withColumn("other", other).filter("own <> other")
        side = F.when(F.col("own") < F.col("other"), 0).otherwise(1)
    else:
        dealt, side = dealt.withColumn("other", F.col("own")), F.lit(2)
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "n", "root", side.alias("side"))
    percent, least = near.percent, near.least_equal
    full = dealt.join(nodes.select("node", "sketch"), "node").join(sets, "node")
    return full.groupBy("key", "low", "high").applyInArrow(
        lambda t: forest(t.select(["node", "n", "root", "sketch", "shingles", "side"]), percent, least), "a BINARY, b BINARY")


def linked(docs: DataFrame, nodes: DataFrame, near: Near = Near()) -> DataFrame:
    """(node, root) of all nodes that have a link. `nodes`: stored (node, n, keys, sketch, __file, __row)."""
    members = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    members = stored(members.join(stored(shared, "buckets"), "key"), "members")
    nodes = stored(members.select("node").distinct().join(nodes.drop("keys"), "node"), "shared-nodes")
    sets = stored(full_sets(docs, nodes.select("node", "__file", "__row"), near), "sets")
    links = roots = None

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        common = F.size(F.array_intersect("sa", "sb")).cast("long")
        return pairs.join(a, "a").join(b, "b").withColumn("i", common).filter(
            F.col("i") * 100 >= near.percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")

    def open_members() -> DataFrame:
        """Members of buckets with more than one component, with it."""
        if roots is None:
            return members.withColumn("root", F.col("node"))
        now = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
        return stored(now.join(stored(several, "open-buckets"), "key"), "open-members")

    def with_pivots(now: DataFrame, step: int) -> DataFrame:
        """One pair a node: with the least pivot of its buckets that has another root and a similar size."""
        order = lambda node: F.xxhash64(node, F.lit(step))
        pivot = now.groupBy("key").agg(F.min_by(F.struct("node", "n", "root"), order("node")).alias("p"))
        fit = now.join(pivot, "key").filter((F.col("p.root") != F.col("root")) & similar_size("p.n", "n", near.percent))
        one = fit.groupBy("node").agg(F.min_by("p.node", order("p.node")).alias("pivot"))
        return likely(one.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), nodes, near)

    def largest(now: DataFrame) -> DataFrame:
        """Each node in the largest of its buckets only."""
        sizes = now.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        one = now.join(sizes, "key").groupBy("node").agg(F.max(F.struct("c", "key"))["key"].alias("key"))
        return now.join(one, ["node", "key"])

    steps = [lambda now: verified(stored(with_pivots(now, 0), "pairs")), lambda now: verified(stored(with_pivots(now, 1), "pairs")),
             lambda now: within(largest(now), nodes, sets, near, False), lambda now: within(now, nodes, sets, near, False),
             lambda now: within(now, nodes, sets, near, True)]
    for step in steps:
        now = open_members()
        if now.isEmpty():
            break
        found = stored(step(now), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = stored(components(links), "roots")
            links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # stars, a link a node
    return nodes.select("node", F.col("node").alias("root")).limit(0) if roots is None else roots


def grouped(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """Every row: (doc_id, __file, __row, n_shingles, component_id, stays); `stays` on one row of each group."""
    docs = rereadable(docs)
    rows = stored(sketched(docs, near), "sketches")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__row")
    nodes = rows.filter("n_shingles > 0").groupBy("node").agg(
        F.min(own).alias("first"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes.select("node", "n", "keys", "sketch", "first", "first.__file", "first.__row"), "nodes")
    roots = linked(docs, nodes, near)
    of = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("first").alias("least"))
    classes = stored(of.select("node", "root").join(least, "root").select("node", "least"), "classes")
    df = rows.select("doc_id", "__file", "__row", "n_shingles", "node").join(classes, "node", "left")
    first = (F.col("least.__file") == F.col("__file")) & (F.col("least.__row") == F.col("__row"))
    return df.select("doc_id", "__file", "__row", "n_shingles",
                     F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
                     (F.col("node").isNull() | first).alias("stays"))


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row a document."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return grouped(docs, near).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def distinct_documents(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row of each group, with its own columns: that of the smallest doc_id, and of equal ids the first."""
    own, docs = docs.columns, rereadable(docs)
    gone = stored(grouped(docs, near).filter(~F.col("stays")).select("__file", "__row"), "duplicates")
    rows = addressed(docs, F.struct(*[docs[c] for c in own]).alias("__doc"))  # so that no name of theirs meets one of these
    return rows.join(gone, ["__file", "__row"], "left_anti").select(*[F.col(f"__doc.`{c}`") for c in own])


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
    SELECT DISTINCT r, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS shingle
    FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1) + 1))) AS i FROM w)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY a.r, b.r),
link AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, step.b FROM reach JOIN step ON step.a = reach.b),
least_id AS (SELECT reach.a AS r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM w JOIN least_id USING (r) LEFT JOIN n USING (r)
"""
