"""Mixing of sources to target weights.

Each source's words, its documents one after another, are cut into blocks of equal length. The output
is a row of shards of equal numbers of slots. Each slot draws its source from the target weights, so that a
shard's counts are multinomial; the j-th slot of a source takes the j-th block of the source's pseudorandom order,
a new order for each pass over the source; and slots meet blocks by (source, j).

A source's slots are as many as its target needs. Draws beyond that go to the sources that fell short, in
order, so that each source's taken words equal its target, rounded: its last slot takes as much of its block as is
left to take, and a source's shorter last block comes last in each pass.

Rules: a null text has no words; documents without words are in no block. A null source is a source of its own, the last.
Order within a source follows a hash of doc_id, then (doc_id, size), so reruns agree whatever the partitions; rows that are
equal in those may swap. Equal rows are separate documents. No documents give no rows.

All is DataFrame code, and no text is moved. There are three kinds of row: documents, blocks (words / `block`) and
one row for each source. Windows over all sources see only the latter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.llm.common import addressed, numbers, rereadable, stored, with_start, words


@dataclass(frozen=True)
class Mix:
    """`share`: words of the mix by words at hand; `most`: passes over a source at most; `shard`: slots of a shard."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    block: int = 512
    shard: int = 4096
    seed: int = 1


def targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row a source: (source, no, source_size, target, quota, n_blocks, n_slots, first_slot).

    Sources that reach their stop are those with the smallest ratio of stop to weight. So with sources
    in that order, one running sum finds the level at which the others share what is left.
    """
    one = Window.partitionBy(F.lit(0))  # over sources, never over documents
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in mix.weights])
    df = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    df = df.withColumn("no", F.row_number().over(by_name) - 1)
    df = df.withColumn("weight", F.get(weights, F.col("no") % len(mix.weights))).withColumn("stop", mix.most * F.col("source_size"))
    order = one.orderBy(F.col("stop") / F.col("weight"), "no")
    total = mix.share * F.sum("source_size").over(one)
    df = df.withColumn("left", total - (F.sum("stop").over(order) - F.col("stop"))).withColumn(
        "others", F.sum("weight").over(one) - F.sum("weight").over(order) + F.col("weight"))
    df = df.withColumn("level", F.col("left") / F.col("others")).withColumn("free", F.col("level") * F.col("weight") <= F.col("stop"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("stop") / F.col("weight"), "no", "level"))).over(one)
    df = df.withColumn("target", F.when(F.col("free"), first["level"] * F.col("weight")).otherwise(F.col("stop").cast("double")))
    df = df.withColumn("quota", F.round("target").cast("long")).withColumn("n_blocks", F.ceil(F.col("source_size") / mix.block))
    slots = F.expr(f"(quota div source_size) * n_blocks + ceil((quota % source_size) / {mix.block})")
    df = df.withColumn("n_slots", F.when(F.col("source_size") > 0, slots).otherwise(0).cast("long"))
    df = df.withColumn("first_slot", F.sum("n_slots").over(one.orderBy("no")) - F.col("n_slots")).withColumn(
        "all_slots", F.sum("n_slots").over(one))
    return df.select("source", "no", "source_size", "target", "quota", "n_blocks", "n_slots", "first_slot", "all_slots")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(" ", *parts))


def blocks(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(no, j, block, pass, take): the block that the source's j-th slot reads, and how many of its words."""
    passes = sources.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(mix.most - 1)))).filter(
        F.col("pass") * F.col("source_size") < F.col("quota"))
    df = numbers(passes.select("no", "pass", "source_size", "quota", "n_blocks"), F.col("n_blocks"), "block")
    # A shorter last block sorts behind the others of its pass, whose hashes are hexadecimal.
    short = (F.col("block") + 1) * mix.block > F.col("source_size")
    df = df.withColumn("hash", F.when(short, F.lit("z")).otherwise(_hash(F.lit(mix.seed), "no", "pass", "block")))
    df = df.withColumns({"bucket": F.substring("hash", 1, 3), "order": F.col("no") * mix.most + F.col("pass"), "one": F.lit(1)})
    df = with_start(df, "order", "bucket", ["hash", "block"], "one", "place")
    begin = F.col("pass") * F.col("source_size") + F.col("place") * mix.block
    length = F.least(F.lit(mix.block), F.col("source_size") - F.col("block") * mix.block)
    df = df.withColumn("take", F.least(length, F.col("quota") - begin)).filter("take > 0")
    return df.select("no", (F.col("pass") * F.col("n_blocks") + F.col("place")).alias("j"), "block", "pass", "take")


def draws(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(shard, no, j): every slot of the output with its source and the slot's number among the source's.

    A draw is a place in [0, all_slots), where each source holds a range as long as its slots. The range
    is found by an equality join on cells: there are as many cells as sources, so a cell meets two sources on average.
    """
    n_cells = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    ranges = sources.filter("n_slots > 0").withColumn("cells", n_cells)
    cell = lambda place: F.floor(place * F.col("cells") / F.col("all_slots"))
    guide = ranges.select("no", "first_slot", "n_slots", F.explode(F.sequence(
        cell(F.col("first_slot")), cell(F.col("first_slot") + F.col("n_slots") - 1))).alias("cell"))
    total = ranges.groupBy("cells", "all_slots").count().select("cells", "all_slots")
    slots = numbers(total, F.col("all_slots"), "t")
    draw = F.conv(F.substring(_hash(F.lit(mix.seed), F.lit("slot"), F.col("t")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    slots = slots.withColumn("place", F.floor(draw * F.col("all_slots"))).withColumn("cell", cell(F.col("place")))
    guide = stored(guide, "guide")
    # Two rows a source or so, broadcast where that is checked to be little.
    drawn = slots.join(F.broadcast(guide) if guide.count() <= 100_000 else guide.hint("merge"), "cell").filter("place >= first_slot AND place < first_slot + n_slots")
    counts = drawn.groupBy(F.floor(F.col("t") / mix.shard).alias("shard"), "no").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "shard-counts")
    counts = with_start(counts.withColumn("bucket", F.floor(F.col("shard") / 1024)), "no", "bucket", ["shard"], "n", "j0")
    counts = stored(counts.join(sources.select(F.col("no").alias("__no"), "n_slots"), F.col("no") == F.col("__no")).drop("__no"), "shard-runs")

    def units(df: DataFrame, first: Column, end: Column, name: str) -> DataFrame:
        return df.filter(first < end).withColumn(name, F.explode(F.sequence(first, end - 1)))

    within = units(counts, F.col("j0"), F.least(F.col("j0") + F.col("n"), F.col("n_slots")), "j").select("shard", "no", "j")
    # What was drawn too often and too rarely, of the order of the square root of the slots.
    over = counts.withColumn("extra", F.least("n", F.col("j0") + F.col("n") - F.col("n_slots"))).filter("extra > 0")
    over = with_start(over.withColumn("bucket", F.floor(F.col("shard") / 1024)), None, "bucket", ["shard", "no"], "extra", "at")
    spare = units(over, F.col("at"), F.col("at") + F.col("extra"), "unit").select("shard", "unit")
    had = counts.groupBy("no").agg(F.sum("n").alias("had"))
    short = sources.join(had, "no", "left").withColumn("had", F.coalesce("had", F.lit(0))).withColumn(
        "lack", F.col("n_slots") - F.col("had")).filter("lack > 0")
    short = short.withColumn("at", F.sum("lack").over(Window.partitionBy(F.lit(0)).orderBy("no")) - F.col("lack"))
    wanted = numbers(short.select("no", "had", "lack", "at"), F.col("lack"), "i").select(
        "no", (F.col("had") + F.col("i")).alias("j"), (F.col("at") + F.col("i")).alias("unit"))
    return within.unionByName(spare.join(wanted, "unit").select("shard", "no", "j"))


def placed(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(shard, slot, no, j, block, pass, take): the whole output, a row a slot."""
    # Catalyst takes what is counted out from a few rows for as small as these; both sides grow with the words.
    slots = draws(sources, mix).hint("merge").join(blocks(sources, mix), ["no", "j"])
    slot = F.row_number().over(Window.partitionBy("shard").orderBy(_hash(F.lit(mix.seed), F.lit("place"), "no", "j"), "no", "j")) - 1
    return slots.withColumn("slot", slot)


def streamed(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(documents with their number of words and their first word's place in the source, the sources)."""
    docs, text = rereadable(docs), F.col("text").cast("string")
    sized = stored(addressed(docs, F.col("doc_id"), F.col("source"), F.size(words(text)).cast("long").alias("size")), "sizes")
    sources = stored(targets(sized, mix), "targets")
    names = sources.select(F.col("source").alias("__source"), "no", "source_size", "target")
    df = sized.join(names, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    df = df.withColumn("bucket", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 3))
    return with_start(df, "no", "bucket", ["doc_id", "size", "__file", "__row"], "size", "start").drop("bucket"), sources


def spans(streams: DataFrame, sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(columns of streams, pass, begin, end): the words, counted in the document, that each slot takes of it."""
    first, last = F.floor(F.col("start") / mix.block), F.floor((F.col("start") + F.col("size") - 1) / mix.block)
    parts = streams.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    used = placed(sources, mix).select("no", "block", "pass", "take")
    at = F.col("block") * mix.block
    begin, end = F.greatest("start", at), F.least(F.col("start") + F.col("size"), at + F.col("take"))
    df = parts.hint("merge").join(used, ["no", "block"]).filter(begin < end)
    return df.withColumns({"begin": begin - F.col("start"), "end": end - F.col("start")}).drop("block", "take")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row a document."""
    streams, sources = streamed(docs, mix)
    streams = stored(streams, "streams")
    taken = spans(streams, sources, mix).groupBy("__file", "__row").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    return streams.join(taken, ["__file", "__row"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as documents with the columns of `docs`: a row for each document and pass with the words taken.

    A document that is taken whole keeps its text as it is; of others the taken words stay, each with the white
    space behind it. `n_chars` follows the text.
    """
    own, docs = docs.columns, rereadable(docs)
    streams, sources = streamed(docs, mix)
    streams = stored(streams, "streams")
    parts = spans(streams, sources, mix).groupBy("__file", "__row", "pass", "size").agg(
        F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("parts"), F.sum(F.col("end") - F.col("begin")).alias("taken"))
    # The documents' own columns stay in a structure, so that no name of theirs meets one of these.
    df = addressed(docs, F.struct(*own).alias("__doc"), F.col("text").cast("string").alias("words"))
    df = df.join(parts, ["__file", "__row"])
    text = F.regexp_replace("words", r"^[\x20\x09-\x0D]+", "")
    df = df.withColumn("units", F.when(F.col("taken") < F.col("size"), F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))))
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice("units", (p["begin"] + 1).cast("int"), (p["end"] - p["begin"]).cast("int")))), "")
    df = df.withColumn("out", F.when(F.col("taken") == F.col("size"), F.col("words")).otherwise(F.regexp_replace(some, r"[\x20\x09-\x0D]+$", "")))
    return df.select(*[F.col("out").alias(c) if c == "text" else F.length("out").cast("long").alias(c) if c == "n_chars" else F.col(f"__doc.{c}") for c in own])
