"""Cross-entropy difference of a target and a background model (Moore and Lewis, 2010).

Both models are n-gram models of the same order over one vocabulary, bytes, with the same smoothing: an n-gram's
probability given the bytes before it is (count + strength / 256) / (count of those bytes + strength). The target model
is counted on documents labelled good and not toxic, the background model on all documents. A document's score is
the mean over its tokens of background loss minus target loss, in bits: the higher, the more like the target.

Texts are cut into slices of bounded bytes, each behind the bytes its first n-grams look back on, and neighbouring slices are
dealt into blocks of bounded bytes. Counting: each task counts its slices' n-grams, and the counts are summed by n-gram.
Scoring: contexts are dealt into buckets, about one for every `BUCKET_BYTES` of text. A block asks each bucket for its distinct n-grams
there, packed in one row, and gets their counts and their contexts' ones back in the same way; the losses are made where the block's slices are,
whose sums are added by document in their order. So neither a model nor a long text's losses are ever held in one place.

Rules: a null or empty text has no tokens and the score null. Labels with a null id or value count for nothing; an id with any
good and non-toxic label is in the target. Every row is scored by itself. Without target documents all target losses are 8 bits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.llm.common import addressed, rereadable, stored

SLICE_BYTES = 2_000_000
BLOCK_BYTES = 8_000_000
ROW_BYTES = 64  # what a slice costs besides its text
BUCKET_BYTES = 4_000_000
TURNS = 2
PRIME = 2147483629  # contexts are dealt by their rest by it
COUNTS = ["target", "all_", "target_context", "all_context"]


@dataclass(frozen=True)
class Model:
    """`order`: bytes of an n-gram, 8 at most, so that its number is exact."""

    order: int = 4
    strength: float = 32.0


def pieces(docs: DataFrame, labels: DataFrame, model: Model) -> DataFrame:
    """(doc_id, file, row, slice, good, lead, bytes, block): the texts' slices; the first `lead` bytes belong to the slice before."""
    good = labels.filter("doc_id IS NOT NULL AND quality = 1 AND toxic = 0").select(F.col("doc_id").alias("__good")).distinct()
    docs = rereadable(docs)
    # Which rows are in the target goes to the texts as bits, 4 KB for 32768 rows of a file, so that no text is shuffled for it.
    place, spot = F.bitmap_bucket_number(F.col("__row") + 1), F.bitmap_bit_position(F.col("__row") + 1)
    ids = addressed(docs, F.col("doc_id"))
    bits = ids.join(good, ids["doc_id"] == F.col("__good"), "left_semi").groupBy("__file", place.alias("__range")).agg(
        F.bitmap_construct_agg(spot).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (spot / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    rows = addressed(docs, F.col("doc_id"), F.col("text")).withColumn("__range", place)
    rows = rows.join(F.broadcast(stored(bits, "target-rows")), ["__file", "__range"], "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "__file", "__row",
        F.coalesce(F.bit_get(byte, (spot % 8).cast("int")) == 1, F.lit(False)).alias("good"), F.col("text").cast("string").alias("text"))
    slice_bytes, block_bytes = SLICE_BYTES, BLOCK_BYTES
    schema = pa.schema([("doc_id", pa.int64()), ("__file", pa.int64()), ("__row", pa.int64()), ("slice", pa.int64()), ("good", pa.bool_()),
                        ("lead", pa.int64()), ("bytes", pa.binary()), ("block", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, out, size = 0, block_bytes, [], 0
        for batch in batches:
            texts = pc.fill_null(batch["text"].cast(pa.string()), "").cast(pa.binary())
            own = zip(*(batch[c].to_pylist() for c in ("doc_id", "__file", "__row", "good")), strict=True)
            for i, (doc_id, file, row, good) in enumerate(own):
                text = texts[i].as_py()
                for k, start in enumerate(range(0, max(len(text), 1), slice_bytes)):
                    lead = min(start, model.order - 1)
                    part = text[start - lead:start + slice_bytes]
                    cost = len(part) + ROW_BYTES
                    if held + cost > block_bytes:
                        block, held = xxhash.xxh3_64_intdigest(struct.pack("<qqq", file, row, k)) - (1 << 63), 0
                    held += cost
                    size += cost
                    out.append((doc_id, file, row, k, good, lead, part, block))
                    if size > block_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return stored(rows.mapInArrow(cut, "doc_id LONG, __file LONG, __row LONG, slice LONG, good BOOLEAN, lead LONG, bytes BINARY, block LONG"), "pieces", "zstd")


def grams(parts: pa.Array, leads: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of each byte's n-gram, in order; tokens of each slice). Texts begin behind zero bytes."""
    sizes = pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes)
    at = 0
    while at < len(parts):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right")))
        own, lead = sizes[at:to], leads[at:to]
        zeros = b"\0" * (order - 1)  # before each part, so that no n-gram reaches into the one before it
        data = np.frombuffer(zeros + zeros.join(parts.slice(at, to - at).to_pylist()), np.uint8).astype(np.uint64)
        number = data.copy()
        for k in range(1, order):
            number[k:] |= data[:-k] << np.uint64(8 * k)
        runs = np.stack([order - 1 + lead, own - lead], axis=1).ravel()
        yield number[np.repeat(np.tile([False, True], to - at), runs)].view(np.int64), own - lead
        at = to


def counted(rows: DataFrame, model: Model) -> DataFrame:
    """(gram, target, all_): how often each n-gram of the slices is in target documents and in all."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, at = batch["good"].to_numpy(zero_copy_only=False), 0
            for number, own in grams(batch["bytes"], batch["lead"].to_numpy(), model.order):
                target = np.repeat(good[at:at + len(own)], own)
                at += len(own)
                found, n = np.unique(number, return_counts=True)
                wanted, m = np.unique(number[target], return_counts=True)
                both = np.zeros(len(found), np.int64)
                both[np.searchsorted(found, wanted)] = m
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(both), pa.array(n)], ["gram", "target", "all_"])

    counts = rows.select("good", "lead", "bytes").mapInArrow(count, "gram LONG, target LONG, all_ LONG")
    return stored(counts.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("all_").alias("all_")), "grams")


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, first all their lowest bytes, then the next ones: small numbers take little more than a byte."""
    return pa.Codec("zstd").compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(-1)


class Places:
    """Places of n-grams in the ascending `ids`: a slot by a hash holds the most frequent of those that fall there, the others are searched for."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.shift = ids, np.uint64(63 - len(ids).bit_length())
        order = np.argsort(counts, kind="stable")
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self.slot(ids[order])] = order  # of equal slots the last one stays

    def slot(self, number: np.ndarray) -> np.ndarray:
        return (number.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def of(self, number: np.ndarray) -> np.ndarray:
        if not len(number):
            return np.zeros(0, np.int32)
        at = self.slots[self.slot(number)]
        other = np.flatnonzero(self.ids[at] != number)
        at[other] = np.searchsorted(self.ids, number[other])
        return at


def asked(rows: DataFrame, model: Model, buckets: int) -> DataFrame:
    """(bucket, block, n, grams): the distinct n-grams of each block in each bucket, as packed differences; a few rows if a block comes in parts."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch["block"].to_numpy()
            for b in np.unique(blocks).tolist():
                own = pa.array(blocks == b)
                found = [np.unique(number) for number, _ in grams(batch["bytes"].filter(own), batch["lead"].filter(own).to_numpy(), model.order)]
                each = np.unique(np.concatenate(found))
                of = (each.view(np.uint64) >> np.uint64(8)) % np.uint64(PRIME) % np.uint64(buckets)
                order = np.argsort(of, kind="stable")
                parts = [each[x] for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(x)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.unique(of).astype(np.int64)), pa.array(np.full(len(parts), b)), pa.array(list(map(len, parts)), pa.int64()),
                    pa.array([packed(np.diff(x, prepend=np.int64(0))) for x in parts], pa.binary())], ["bucket", "block", "n", "grams"])

    return rows.select("block", "lead", "bytes").mapInArrow(distinct, "bucket LONG, block LONG, n LONG, grams BINARY")


def answered(questions: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """`questions` with what the models say of their n-grams: counts and those of their contexts, which a bucket has whole."""
    def answer(known: pa.Table, parts: pa.Table) -> pa.Table:
        ids = known["gram"].to_numpy()
        order = np.argsort(ids)
        ids, own = ids[order], [known[c].to_numpy()[order] for c in ("target", "all_")]
        first = np.flatnonzero(np.diff(ids >> 8, prepend=(ids[:1] >> 8) - 1))
        context = np.repeat(np.arange(len(first)), np.diff(first, append=len(ids)))
        own += [np.add.reduceat(c, first)[context] if len(first) else c for c in own]
        found: list[list[bytes]] = [[], [], [], []]
        for n, data in zip(parts["n"].to_pylist(), parts["grams"].to_pylist(), strict=True):
            at = np.searchsorted(ids, np.cumsum(unpacked(data, n)))
            for k, values in enumerate(own):
                found[k].append(packed(values[at]))
        return pa.table([parts["block"], parts["n"], parts["grams"], *[pa.array(x, pa.binary()) for x in found]], ["block", "n", "grams", *COUNTS])

    known = counts.withColumn("bucket", F.shiftrightunsigned("gram", 8) % PRIME % buckets)
    return known.groupBy("bucket").cogroup(questions.groupBy("bucket")).applyInArrow(
        answer, "block LONG, n LONG, grams BINARY, " + ", ".join(f"{c} BINARY" for c in COUNTS))


def scores(docs: DataFrame, labels: DataFrame, model: Model = Model()) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score), losses in bits a token."""
    rows = pieces(docs, labels, model)
    counts = counted(rows, model)
    buckets = 1 + (counts.agg(F.sum("all_")).first()[0] or 0) // BUCKET_BYTES

    def score(parts: pa.Table, known: pa.Table) -> pa.Table:
        n = known["n"].to_pylist()
        none = np.zeros(0, np.int64)
        ids = np.concatenate([none, *(np.cumsum(unpacked(x, k)) for x, k in zip(known["grams"].to_pylist(), n, strict=True))])
        order = np.argsort(ids)
        own_target, own_all, of_target, of_all = (np.concatenate([none, *map(unpacked, known[c].to_pylist(), n)])[order] for c in COUNTS)
        ids, lost = ids[order], [-np.log2((c + model.strength / 256) / (total + model.strength))
                                 for c, total in ((own_target, of_target), (own_all, of_all))]
        places = Places(ids, own_all)
        sums: list[list[np.ndarray]] = [[], [], []]
        parts = parts.combine_chunks()
        for chunk in parts.to_batches():
            for number, own in grams(chunk["bytes"], chunk["lead"].to_numpy(), model.order):
                at, ends = places.of(number), np.cumsum(own)
                sums[0].append(own)
                for k, values in enumerate(lost):
                    total = np.concatenate(([0.0], np.cumsum(values[at]) if len(at) else []))
                    sums[k + 1].append(total[ends] - total[ends - own])
        n, target, background = (np.concatenate(x) if x else np.zeros(0) for x in sums)
        return pa.table([parts["doc_id"], parts["__file"], parts["__row"], parts["slice"], pa.array(n.astype(np.int64)), pa.array(target),
                         pa.array(background)], ["doc_id", "__file", "__row", "slice", "n", "target", "background"])

    # A block may come in several batches; its n-grams then come several times, of which the first found serves.
    # The blocks take turns, so that only a part of the questions, answers and texts lies in shuffle files at a time.
    done = []
    for turn in range(TURNS):
        some = rows.filter(F.pmod("block", F.lit(TURNS)) == turn)
        needed = answered(asked(some, model, buckets), counts, buckets)
        done.append(stored(some.drop("good").groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(
            score, "doc_id LONG, __file LONG, __row LONG, slice LONG, n LONG, target DOUBLE, background DOUBLE"), "sums"))
    sums = reduce(DataFrame.unionByName, done)
    slices = F.sort_array(F.collect_list(F.struct("slice", "n", "target", "background")))
    whole = sums.groupBy("__file", "__row").agg(F.first("doc_id").alias("doc_id"), slices.alias("s"))

    def added(name: str, zero: Column) -> Column:
        return F.aggregate(F.col(f"s.{name}"), zero, lambda x, y: x + y)

    whole = whole.select("doc_id", added("n", F.lit(0).cast("long")).alias("n_tokens"), *[
        added(c, F.lit(0.0)).alias(c) for c in ("target", "background")])
    some = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    return whole.select("doc_id", "n_tokens", (F.col("target") / some).alias("target_loss"), (F.col("background") / some).alias("background_loss"),
                        ((F.col("background") - F.col("target")) / some).alias("score"))
