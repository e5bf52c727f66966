"""Merkle manifest of a dataset: a tree for each group, the groups' roots under one root, and every row's proof.

A group's leaves stand in a fixed order. On every level each `fanout` consecutive nodes, the last run fewer, become the hash of
their digests, until one is left. Levels are built in two steps:
1. Blocks of `fanout ** levels` consecutive leaves are subtrees, each built within a task, with the siblings on every leaf's way.
2. The blocks' roots go through a butterfly exchange: in round r, block p meets one block of each of the other subtrees of its
   aligned group of `fanout ** (r + 1)` blocks, the one whose number agrees with p in the lower digits. They swap their roots,
   and each hashes the parent for itself. So after the last round every block holds the group's root and has seen all siblings
   above it; nothing is handed down. A ragged last subtree has fewer blocks than its partners, which are dealt over it.
What a round moves is one digest for each block and partner. Blocks are rows / 2187, rounds their logarithm.

Leaf positions come from a range partition of (group, order) and one count for each partition and group, so a group that holds most rows
is in many partitions, and no window spans a group.

Rules: a null column's encoding is `-`, so null and empty differ. Rows with equal keys stand in the order of their leaves; equal leaves are
alike in all results but may swap places. A null doc_id comes first in its group. Null groups are one group, the first. A lone leaf is the root
of its tree and has no siblings; the hash of no siblings is that of the empty string. No rows give no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from daytrail.llm.common import stored, with_start


@dataclass(frozen=True)
class Tree:
    """`levels`: levels within a block."""

    fanout: int = 3
    levels: int = 7

    @property
    def block(self) -> int:
        return self.fanout ** self.levels


def encoded(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def subtree(leaves: list[str], fanout: int, levels: int) -> tuple[str, list[list[list[str]]]]:
    """(root, siblings of each leaf by level) after `levels` levels."""
    proofs: list[list[list[str]]] = [[] for _ in leaves]
    nodes, width = leaves, 1
    for _ in range(levels):
        runs = [nodes[k:k + fanout] for k in range(0, len(nodes), fanout)]
        for i, proof in enumerate(proofs):
            k = i // width
            run = runs[k // fanout]
            proof.append(run[:k % fanout] + run[k % fanout + 1:])
        nodes, width = [_hash(run) for run in runs], width * fanout
    return nodes[0], proofs


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `pos`, the row's place in its group by `order`, and `n`, the group's size. Not null: `group`."""
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = rows.repartitionByRange(*keys).withColumns({"__part": F.spark_partition_id(), "__one": F.lit(1).cast("long")})
    dealt = stored(dealt, "dealt")  # where a row went must not change when a task runs again
    sizes = dealt.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("n"))
    numbered = with_start(dealt, group, "__part", [F.col(c).asc_nulls_first() for c in order], "__one", "pos")
    return numbered.join(sizes, F.col(group) == F.col("__g")).drop("__g", "__part", "__one")


def blocks(leaves: DataFrame, group: str, digest: str, tree: Tree) -> DataFrame:
    """`leaves` with `block`, `inner`: their siblings within the block, and on each block's first row `node`, its root.

    Not more than one block of leaves is held at a time.
    """
    given = leaves.columns
    names = [*given, "block", "inner", "node"]
    siblings = ArrayType(ArrayType(StringType()))
    schema = StructType([*leaves.schema.fields, StructField("block", LongType()), StructField("inner", siblings),
                         StructField("node", StringType())])

    def built(held: pa.Table) -> Iterator[pa.RecordBatch]:
        n = held["n"][0].as_py()
        levels = 0
        while levels < tree.levels and tree.fanout ** levels < n:
            levels += 1
        root, proofs = subtree(held[digest].to_pylist(), tree.fanout, levels)
        extra = [pa.array(held["block"].to_pylist(), pa.int64()), pa.array(proofs, pa.list_(pa.list_(pa.string()))),
                 pa.array([root] + [None] * (len(proofs) - 1), pa.string())]
        yield from pa.table([*(held[c] for c in given), *extra], names=names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = np.array(held[group].to_pylist(), object)
            block = held["block"].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            at = 0
            for cut in cuts.tolist():
                yield from built(held.slice(at, cut - at))
                at = cut
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield from built(held)

    own = leaves.withColumn("block", F.floor(F.col("pos") / tree.block))
    return own.repartition(group, "block").sortWithinPartitions(group, "block", "pos").mapInArrow(run, schema)


def exchanged(roots: DataFrame, group: str, tree: Tree) -> DataFrame:
    """(group, block, root, outer): the group's root and the siblings above each block, by rounds of the butterfly.

    `roots`: (group, block, n_blocks, node).
    """
    most = roots.agg(F.max("n_blocks")).first()[0] or 0
    state = roots.withColumn("outer", F.expr("CAST(array() AS ARRAY<ARRAY<STRING>>)"))
    width, f = 1, tree.fanout
    while width < most:
        run = F.floor(F.col("block") / (width * f))
        j = F.floor(F.col("block") / width) - run * f
        begin = (run * f + F.col("other")) * width
        partner = begin + (F.col("block") % width) % F.least(F.lit(width), F.col("n_blocks") - begin)
        live = state.filter(F.col("n_blocks") > width)
        done = state.filter(F.col("n_blocks") <= width)
        calls = live.select("*", j.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(f - 1))).alias("other")).filter(
            (F.col("other") == F.col("own")) | (begin < F.col("n_blocks")))
        calls = calls.withColumn("partner", F.when(F.col("other") == F.col("own"), F.col("block")).otherwise(partner).cast("long"))
        theirs = live.select(F.col(group).alias("__g"), F.col("block").alias("__b"), F.col("node").alias("theirs"))
        met = calls.join(theirs, (F.col(group) == F.col("__g")) & (F.col("partner") == F.col("__b"))).groupBy(group, "block").agg(
            F.first("n_blocks").alias("n_blocks"), F.first("outer").alias("outer"), F.first("own").alias("own"),
            F.array_sort(F.collect_list(F.struct("other", "theirs"))).alias("run"))  # `fanout` rows at most
        live = met.select(
            group, "block", "n_blocks", F.sha2(F.array_join("run.theirs", ""), 256).alias("node"),
            F.concat("outer", F.array(F.filter("run", lambda x: x["other"] != F.col("own"))["theirs"])).alias("outer"))
        state = done.select(*live.columns).unionByName(live)
        width *= f
        if width < most:  # a round's frames use the state three times
            state = stored(state, "butterfly")
    return state.select(group, "block", F.col("node").alias("root"), "outer")


def grown(leaves: DataFrame, group: str, order: list[str], digest: str, tree: Tree = Tree()) -> tuple[DataFrame, DataFrame]:
    """A tree for each group: (leaves with pos, n, block, inner), and (group, block, root, outer) for each block.

    A leaf's siblings are `inner` and then its block's `outer`; see `folded`. `leaves` has no null `group`.
    """
    held = stored(blocks(placed(leaves, group, order), group, digest, tree), "subtrees")
    roots = held.filter("node IS NOT NULL").select(group, "block", F.ceil(F.col("n") / tree.block).alias("n_blocks"), "node")
    return held.drop("node"), stored(exchanged(roots, group, tree), "roots")


def folded(leaf: Column, pos: Column, siblings: Column, fanout: int = 3) -> Column:
    """The root that a leaf and its siblings lead to; `pos` says where the leaf stands among them on each level."""
    def step(state: Column, others: Column) -> Column:
        k = (state["pos"] % fanout).cast("int")
        before, after = F.slice(others, 1, k), F.slice(others, k + 1, F.size(others))
        run = F.concat(F.array_join(before, ""), state["node"], F.array_join(after, ""))
        return F.struct(F.sha2(run, 256).alias("node"), F.floor(state["pos"] / fanout).alias("pos"))

    start = F.struct(leaf.alias("node"), pos.cast("long").alias("pos"))
    return F.aggregate(siblings, start, step, lambda s: s["node"])


def manifest(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """(doc_id, source, pos, leaf, changed, subroot, root, inner, outer, top, top_pos) for each document.

    `changed` is the leaf of the document without its line breaks where the check sums say so, else null. `top` are the siblings
    above the source's root, which stands at `top_pos` among the sources.
    """
    columns = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    text = F.col("text").cast("string")
    fields = [encoded(c) for c in columns]
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    leaves = stored(docs.select(
        columns[0].alias("doc_id"), F.coalesce(F.concat(F.lit("="), columns[1]), F.lit("-")).alias("group"),  # null comes first
        hashed(*fields, encoded(text)).alias("leaf"),
        F.when(tampered, hashed(*fields, encoded(F.replace(text, F.lit("\n"), F.lit(""))))).alias("changed")), "leaves")
    held, of_block = grown(leaves, "group", ["doc_id", "leaf"], "leaf", tree)

    subroots = of_block.filter("block = 0").select(F.col("group").alias("source_group"), F.col("root").alias("subroot"))
    tops, of_top = grown(subroots.withColumn("all", F.lit("")), "all", ["source_group"], "subroot", tree)
    above = tops.join(of_top, ["all", "block"]).select(
        F.col("source_group").alias("group"), "subroot", F.col("pos").alias("top_pos"), F.concat("inner", "outer").alias("top"), "root")

    of_block = of_block.drop("root").join(above, "group")  # rows by block, not by leaf, meet their source
    source = F.when(F.col("group") != "-", F.substring("group", 2, 1 << 30))
    return held.join(of_block, ["group", "block"]).select(
        "doc_id", source.alias("source"), "pos", "leaf", "changed", "subroot", "root", "inner", "outer", "top", "top_pos")


def verified(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row a document."""
    df = manifest(docs, tree)
    siblings = F.concat("inner", "outer", "top")
    subroot = folded(F.coalesce("changed", "leaf"), F.col("pos"), F.concat("inner", "outer"), tree.fanout)
    df = df.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.flatten(siblings), ""), 256).alias("proof_sha256"),
                   folded(subroot, F.col("top_pos"), F.col("top"), tree.fanout).alias("folded_root"))
    return df.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, text, CAST(doc_id AS VARCHAR) AS name,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
    FROM documents),
crc AS (  -- bit by bit: 255 stands for a shift, any other number for a byte of the name
    SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(name, ''),
           lambda c: [CAST(ascii(c) AS BIGINT), 255, 255, 255, 255, 255, 255, 255, 255]))),
           lambda a, x: CASE WHEN x = 255 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, x) END) AS c FROM d),
leaf AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN xor(c, 4294967295) % 2 = 0
                THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS changed,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS m FROM crc),
up AS (  -- the trees of the sources, a level a step
    SELECT CAST(0 AS BIGINT) AS level, source, pos, m, leaf AS node FROM leaf
    UNION ALL
    SELECT level + 1, source, pos // 3, (min(m) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos))
    FROM up WHERE m > 1 GROUP BY level, source, pos // 3),
sub AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS m
        FROM up WHERE m = 1),
top AS (
    SELECT CAST(0 AS BIGINT) AS level, pos, m, subroot AS node FROM sub
    UNION ALL
    SELECT level + 1, pos // 3, (min(m) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE m > 1 GROUP BY level, pos // 3),
met AS (  -- the run that a leaf's way passes on each level of its source's tree, then of the tree of sources
    SELECT l.doc_id, false AS high, n.level, n.node, n.pos, l.pos // CAST(pow(3, n.level) AS BIGINT) AS own
    FROM leaf l JOIN up n ON l.source IS NOT DISTINCT FROM n.source AND n.pos // 3 = l.pos // CAST(pow(3, n.level + 1) AS BIGINT)
    WHERE n.m > 1
    UNION ALL
    SELECT l.doc_id, true, n.level, n.node, n.pos, s.pos // CAST(pow(3, n.level) AS BIGINT)
    FROM leaf l JOIN sub s ON l.source IS NOT DISTINCT FROM s.source JOIN top n ON n.pos // 3 = s.pos // CAST(pow(3, n.level + 1) AS BIGINT)
    WHERE n.m > 1),
level AS (
    SELECT doc_id, high, level, coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos < own), '') AS before,
           coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos > own), '') AS after FROM met GROUP BY ALL),
way AS (
    SELECT doc_id, string_agg(before || after, '' ORDER BY high, level) AS proof,
           list({'before': before, 'after': after} ORDER BY high, level) AS levels FROM level GROUP BY doc_id),
fold AS (
    SELECT l.*, sha256(coalesce(w.proof, '')) AS proof_sha256, (list_reduce(
           list_prepend({'before': coalesce(l.changed, l.leaf), 'after': ''}, coalesce(w.levels, [])),
           lambda a, x: {'before': sha256(x.before || a.before || x.after), 'after': ''})).before AS folded_root
    FROM leaf l LEFT JOIN way w USING (doc_id))
SELECT f.doc_id, f.leaf, s.subroot, t.node AS root, f.proof_sha256, f.folded_root, f.folded_root = t.node AS verified
FROM fold f JOIN sub s ON f.source IS NOT DISTINCT FROM s.source, (SELECT node FROM top WHERE m = 1) t
"""
