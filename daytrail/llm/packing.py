"""Packing of documents into sequences by bin completion.

Only lengths matter for how pieces share sequences, and a length is at most `capacity`. So the corpus is
summed into one count per length (never more than `capacity` rows), fillings are searched on these counts,
each applied to as many sequences as the counts allow, and the answer, a bounded table of runs of ranks for
each length, is applied to the pieces where they are. Corpus size changes the counts, not the search.

Rules: a null text is empty and has only its end id; equal rows are packed as often as they come; no
documents give no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrail.llm.common import released, stored, with_start
from daytrail.llm.tokens import encoder

#: A filling and how many sequences have it: ((lengths, largest first), count).
Pattern = tuple[tuple[int, ...], int]
BUCKET_ROWS = 20_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Ids of every document with its end id, cut at `capacity`: (doc_id, piece, start, length, ids_crc32[, ids])."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()),
              pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]
    fields += [pa.field("ids", pa.list_(pa.int64()))] if with_ids else []
    names = [f.name for f in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, doc_ids = 0, batch["doc_id"].to_pylist()
            for ids, counts in coder.encode(batch["text"]):
                out: list[tuple] = []
                data, place = ids.astype("<u4", copy=False).tobytes(), 0
                for n in counts.tolist():
                    own = data[place:place + 4 * n] + end
                    place += 4 * n
                    for k, start in enumerate(range(0, n + 1, capacity)):
                        part = own[4 * start:4 * (start + capacity)]
                        out.append((doc_ids[at], k, start, len(part) // 4, zlib.crc32(part))
                                   + ((np.frombuffer(part, "<u4").astype(np.int64),) if with_ids else ()))
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], names)

    kinds = "doc_id LONG, piece INT, start LONG, length LONG, ids_crc32 LONG" + (", ids ARRAY<LONG>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(cut), kinds)


def waste_bound(counts: dict[int, int], capacity: int) -> int:
    """Fewest sequences any packing needs: pieces over a half stand alone, and for each k the pieces of at least
    k cannot use what is left beside larger ones (Martello and Toth)."""
    have = np.zeros(capacity + 2, np.int64)
    for length, n in counts.items():
        have[length] = n
    number, total = np.cumsum(have), np.cumsum(have * np.arange(capacity + 2))
    half, best = capacity // 2, -(-int(total[-1]) // capacity)
    for k in range(half + 1):
        alone = number[-1] - number[capacity - k]
        roomy = number[capacity - k] - number[half]
        room = roomy * capacity - (total[capacity - k] - total[half])
        small = total[half] - (total[k - 1] if k else 0)
        best = max(best, int(alone + roomy + max(0, -(-(small - room) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: pieces of one length fill the fullest sequences that still hold them."""
    open_: dict[int, list[list]] = {}  # room left: [lengths, count]
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if not n:
            return
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append([lengths, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                lengths, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, lengths, n = capacity, (), left
            each = min(room // length, left)
            full = min(n, left // each)
            put(room, lengths, n - full if lengths else 0)
            put(room - each * length, lengths + (length,) * each, full)
            left -= each * full
    return [(lengths, n) for groups in open_.values() for lengths, n in groups if lengths]


def completions(room: int, have: Counter, sizes: list[int], most_nodes: int = 400) -> list[tuple[int, ...]]:
    """Undominated fillings of `room` from the pieces at hand, least waste first.

    A filling is dominated if some of its pieces could give way to one larger piece, or the room left
    take another: what it leaves is then never the better rest. `sizes`: ascending lengths with `have` > 0.
    """
    at = bisect_right(sizes, room)
    if not at:
        return [()]
    if sizes[at - 1] == room:  # any other filling would fit inside that piece
        return [(room,)]
    found: list[tuple[int, ...]] = []
    nodes = 0

    def fits(low: int, high: int, taken: tuple[int, ...]) -> bool:
        """Is there an unused piece of low..high?"""
        for k in range(bisect_left(sizes, low), bisect_right(sizes, high)):
            if have[sizes[k]] > taken.count(sizes[k]):
                return True
        return False

    def dominated(taken: tuple[int, ...], slack: int) -> bool:
        if slack and fits(1, slack, taken):
            return True
        sums = {0: 0}  # sum of a subset: most pieces in it
        for length in taken[:8]:
            for total, n in list(sums.items()):
                sums[total + length] = max(n + 1, sums.get(total + length, 0))
        return any(fits(total + (n == 1), total + slack, taken) for total, n in sums.items() if n)

    def search(left: int, top: int, taken: tuple[int, ...]) -> None:
        nonlocal nodes
        nodes += 1
        k = bisect_right(sizes, min(left, top)) - 1
        while k >= 0 and have[sizes[k]] <= taken.count(sizes[k]):
            k -= 1
        if k < 0:
            if not dominated(taken, left):
                found.append(taken)
            return
        while k >= 0 and nodes < most_nodes:
            length = sizes[k]
            if have[length] > taken.count(length):
                search(left - length, length, (*taken, length))
                if found and sum(found[-1]) == room:
                    return
            k -= 1

    search(room, room, ())
    if not found:  # the node limit came first: the fullest greedy filling
        left, taken = room, ()
        for length in reversed(sizes[:at]):
            n = min(have[length], left // length)
            left, taken = left - n * length, taken + (length,) * n
        found.append(taken)
    return sorted(set(found), key=lambda f: (-sum(f), f))


def bin_completion(counts: dict[int, int], capacity: int, most_steps: int = 60_000) -> list[Pattern]:
    """Depth-first branch and bound over the fillings around the largest piece left.

    A branch ends when the waste so far cannot beat the incumbent, at first that of best fit. The search
    stops at the waste bound, where an answer is proven best, or after `most_steps` fillings.
    """
    total = sum(length * n for length, n in counts.items())
    bound = waste_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    best = sum(n for _, n in incumbent)
    have = Counter({length: n for length, n in counts.items() if n})
    steps = 0
    # Each level: the fillings still to try (best last), and the one applied: (lengths, count) or None.
    levels: list[list] = []
    used = spare = 0

    def open_level() -> None:
        sizes = sorted(have)
        top = sizes[-1]
        have[top] -= 1
        options = completions(capacity - top, have, [s for s in sizes if have[s]])
        have[top] += 1
        levels.append([[(top, *o) for o in options[::-1]], None])

    def apply(filling: tuple[int, ...], n: int) -> None:
        for length, k in Counter(filling).items():
            have[length] -= k * n
            if not have[length]:
                del have[length]

    open_level() if have and best > bound else None
    while levels and best > bound and steps < most_steps:
        options, applied = levels[-1]
        if applied:  # come back: undo
            filling, n = applied
            for length in filling:
                have[length] += n
            used, spare = used - n, spare - n * (capacity - sum(filling))
            levels[-1][1] = None
        if not options:
            levels.pop()
            continue
        steps += 1
        filling = options.pop()
        n = min(have[length] // k for length, k in Counter(filling).items())
        waste = spare + n * (capacity - sum(filling))
        if -(-(total + waste) // capacity) >= best:  # even if nothing more were wasted
            continue
        apply(filling, n)
        used, spare = used + n, waste
        levels[-1][1] = (filling, n)
        if have:
            open_level()
        elif used < best:
            best, incumbent = used, [tuple(level[1]) for level in levels]
    return incumbent


def placements(patterns: list[Pattern]) -> dict[int, list[np.ndarray]]:
    """Per length, ascending by first rank: (first rank, copies in a sequence, first sequence, offset of the first copy)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for lengths, n in patterns:
        offset = 0
        for length, k in sorted(Counter(lengths).items(), reverse=True):
            runs.setdefault(length, []).append((ranks[length], k, sequence, offset))
            ranks[length] += k * n
            offset += k * length
        sequence += n
    return {length: list(np.array(rows, np.int64).T) for length, rows in runs.items()}


def pack(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add `sequence_id` and `offset` to rows with a `length` of 1 to `capacity`.

    `parts` must be stored: it is read for the counts and again for the answer.
    """
    # At most `capacity` rows whatever the corpus, so the driver may hold them, and so the answer below.
    counts = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}
    runs = placements(bin_completion(counts, capacity))
    n_buckets = max(1, sum(counts.values()) // BUCKET_ROWS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["__rank"].to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                own = lengths == length
                first, copies, sequences, offsets = runs[length]
                at = np.searchsorted(first, ranks[own], "right") - 1
                nth, rest = np.divmod(ranks[own] - first[at], copies[at])
                sequence[own], offset[own] = sequences[at] + nth, offsets[at] + rest * length
            columns = [c for i, c in enumerate(batch.columns) if not batch.schema.field(i).name.startswith("__")]
            names = [n for n in batch.schema.names if not n.startswith("__")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    rows = parts.withColumn("__one", F.lit(1)).withColumn(
        "__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    ranked = with_start(rows, "length", "__bucket", order, "__one", "__rank")
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(released(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(stored(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)
