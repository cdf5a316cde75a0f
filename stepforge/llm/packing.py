"""Best-fit packing by bin completion over the histogram of lengths.

Lengths are whole numbers up to the capacity, so all that a packing needs is how many pieces have each length: a
table of at most ``capacity`` rows, however many documents there are. The driver solves that histogram; a solution is
a list of patterns (lengths in one sequence) with multiplicities. Pieces of one length are interchangeable: each gets
a rank within its length by per-task counts and a prefix sum, and the pattern that owns its rank tells its place.
No step gathers documents in one task, and a hot length is spread over all the tasks that read it.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Workspace
from .kernels import slices

#: Nodes that the branch and bound may visit before it settles for its incumbent.
NODES = 200
#: Steps of looking for one filling that count as a node.
STEPS = 1000
Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing, a whole group of equal bins at a time: [(bins, lengths)].

    Each length splits at most two groups and opens at most two, so there are at most 4 * capacity groups.
    """
    room: dict[int, list[tuple[int, Pattern]]] = {}
    order: list[int] = []

    def put(left: int, bins: int, pattern: Pattern) -> None:
        if bins:
            if left not in room:
                room[left] = []
                order.insert(bisect_right(order, left), left)
            room[left].append((bins, pattern))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect_right(order, size - 1)
            if k == len(order):
                each = capacity // size
                put(capacity - each * size, n // each, (size,) * each)
                put(capacity - n % each * size, int(n % each > 0), (size,) * (n % each))
                break
            left = order[k]
            bins, pattern = room[left].pop()
            if not room[left]:
                del room[left], order[k]
            each = left // size
            full = min(bins, n // each)
            put(left - each * size, full, pattern + (size,) * each)
            n -= full * each
            bins -= full
            if bins and n:
                put(left - n * size, 1, pattern + (size,) * n)
                n, bins = 0, bins - 1
            put(left, bins, pattern)
    return [x for groups in room.values() for x in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: total length, or long pieces that exclude one another (for each threshold)."""
    have = np.zeros(capacity + 2, np.int64)
    for size, n in counts.items():
        have[size] = n
    total = have * np.arange(capacity + 2)
    above, mass = np.append(np.cumsum(have[::-1])[::-1], 0), np.append(np.cumsum(total[::-1])[::-1], 0)
    best = -(-int(total.sum()) // capacity)
    half = capacity // 2 + 1
    for t in range(1, half):
        alone, big = int(above[capacity - t + 1]), int(above[half] - above[capacity - t + 1])
        spare = big * capacity - int(mass[half] - mass[capacity - t + 1])
        best = max(best, alone + big + max(0, -(-(int(mass[t] - mass[half]) - spare) // capacity)))
    return best


def completions(counts: Counter, left: int, waste: int) -> Iterator[Pattern | None]:
    """Undominated fillings of the space that the largest piece leaves, larger pieces first, built as they are asked for.

    A filling is dominated if a piece left out fits in it, alone or in place of smaller pieces of the filling. Fillings
    that waste more than allowed are not built. None stands for STEPS steps that found no filling.
    """
    fit = sorted((s for s in counts if s <= left), reverse=True)
    mass = [0]
    for s in reversed(fit):
        mass.append(mass[-1] + s * counts[s])
    mass.reverse()
    rising = [-s for s in fit]
    steps = 0

    def undominated(used: dict[int, int], room: int) -> bool:
        sums = 1  # bit s: some pieces smaller than x add up to s
        for x in reversed(fit):
            low = max(0, x - room)
            if counts[x] > used.get(x, 0) and sums >> low & (1 << x - low + 1) - 1:
                return False
            for _ in range(used.get(x, 0)):
                sums |= sums << x
        return True

    def most(k: int, room: int) -> int:
        return min(counts[fit[k]], room // fit[k]) if k < len(fit) else 0

    # (size's place, pieces of it, room before them, what must be filled from here, larger pieces as nested tuples)
    stack = [(0, most(0, left), left, left - waste, ())]
    while stack:
        if steps >= STEPS:
            steps = 0
            yield None
        steps += 1
        k, n, room, need, taken = stack.pop()
        if k == len(fit):
            steps += 10
            used = {}
            while taken:
                taken, size, each = taken
                used[size] = each
            if need <= 0 and undominated(used, room):
                steps = 0
                yield tuple(s for s in sorted(used, reverse=True) for _ in range(used[s]))
            continue
        if n:
            stack.append((k, n - 1, room, need, taken))
        size = fit[k]
        after = room - n * size
        # a piece left out though it fits would replace a rest that fills no more than it
        need = max(need - n * size, size + 1 if n < most(k, room) else 0)
        if need <= min(after, mass[k + 1]):
            k = max(k + 1, bisect_left(rising, -after))
            stack.append((k, most(k, after), after, need, (taken, size, n) if n else taken))


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[int, Pattern]]:
    """Fewest sequences for counts[length] pieces of each length, as [(sequences, lengths)].

    The best-fit solution is the first incumbent. While it has more sequences than the lower bound, the search fills
    the bin of the largest remaining piece in every undominated way whose waste still permits one sequence less, as
    often as the counts allow at once, and keeps each better solution. Paths with fewer discrepancies, fillings passed
    over for later ones, come first. It ends at the bound or after ``nodes`` nodes.
    """
    incumbent = best_fit(counts, capacity)
    bound, total = lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    size_of = lambda solution: sum(n for n, _ in solution)
    best, visited = size_of(incumbent), 0
    queue: list = []

    def visit(discrepancies: int, left: Counter, made: list, bins: int, wasted: int) -> None:
        nonlocal incumbent, best, visited
        visited += 1
        rest = best_fit(left, capacity)
        if bins + size_of(rest) < best:
            incumbent, best = made + rest, bins + size_of(rest)
        allowed = (best - 1) * capacity - total - wasted
        if left and allowed >= 0:
            largest = max(left)
            fillings = completions(left - Counter((largest,)), capacity - largest, allowed)
            heappush(queue, (discrepancies, -visited, left, made, bins, wasted, largest, fillings))

    if best > bound:
        visit(0, Counter({s: n for s, n in counts.items() if n}), [], 0, 0)
    while queue and best > bound and visited < nodes:
        discrepancies, order, left, made, bins, wasted, largest, fillings = heappop(queue)
        allowed = (best - 1) * capacity - total - wasted
        pattern = next(fillings, False) if allowed >= 0 else False
        if pattern is False:
            continue
        heappush(queue, (discrepancies + 1, order, left, made, bins, wasted, largest, fillings))
        if pattern is None:
            visited += 1
            continue
        spare = capacity - largest - sum(pattern)
        if spare > allowed:
            continue
        whole = Counter((largest, *pattern))
        times = min(left[s] // n for s, n in whole.items())
        times = max(1, min(times, allowed // spare if spare else times))
        child = Counter({s: n - whole[s] * times for s, n in left.items() if n > whole[s] * times})
        visit(discrepancies, child, [*made, (times, (largest, *pattern))], bins + times, wasted + spare * times)
    return incumbent


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids with an end id, cut into pieces only where they exceed the capacity.

    Columns: doc_id, piece, start, length, ids_crc32, and for pack(): task and rank (place among the pieces of its
    length in its task). The first piece takes the remainder. A null or empty text is one piece with the end id. Rows
    with equal doc_id are documents of their own; other columns are ignored.
    """

    def run(batches):
        encoder, task, seen = tokens.encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, raw, offsets in slices(texts, 1 << 20):
                rows = []
                found, bounds = encoder.encode(raw, offsets)
                for k, doc in enumerate(ids[a:b].to_pylist()):
                    data = found[bounds[k] : bounds[k + 1]].tobytes() + end
                    n = len(data) // 4
                    at = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for piece, (x, y) in enumerate(zip(at, at[1:], strict=False)):
                        rows.append((doc, piece, x, y - x, zlib.crc32(data[4 * x : 4 * y]), task, seen[y - x]))
                        seen[y - x] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 2048, nodes: int = NODES) -> DataFrame:
    """Adds sequence_id and offset to pieces that have length (1..capacity), task and rank; see token_pieces().

    ``pieces`` must be a written table, since its ranks must not change between reads. No pieces give no rows. Equal
    lengths are ties that their ranks settle. The log (info) tells the sequences above the lower bound.
    """
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    where: list[tuple[int, int, int, int, int]] = []
    taken, first = Counter(), 0
    solution = bin_completion(counts, capacity, nodes)
    bound = lower_bound(counts, capacity)
    logging.getLogger(__name__).info("%d sequences, %d above the lower bound", used := sum(n for n, _ in solution), used - bound)
    for times, pattern in solution:
        offset = 0
        for size, each in sorted(Counter(pattern).items(), reverse=True):
            where.append((size, taken[size], first, each, offset))
            taken[size] += times * each
            offset += size * each
        first += times
    table = np.asarray(sorted(where), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    def place(batches):
        for batch in batches:
            get = lambda name: batch.column(batch.schema.names.index(name)).to_numpy(zero_copy_only=False)
            size, rank = get("length"), get("rank") + get("before")
            at = np.searchsorted(keys, (size << 48) + rank, "right") - 1
            _, start, base, each, offset = table[at].T
            extra = [pa.array(base + (rank - start) // each), pa.array(offset + (rank - start) % each * size)]
            kept = [batch.column(batch.schema.names.index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(kept + extra, names=[*columns, "sequence_id", "offset"])

    columns = [c for c in pieces.columns if c not in ("task", "rank", "sequence_id", "offset")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns)
    return pieces.join(offsets, ["task", "length"]).mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenizes, cuts and packs documents; see token_pieces() and pack()."""
    work = Workspace(docs.sparkSession, "packing")
    return pack(work.save(token_pieces(docs, vocabulary or tokens.default_vocabulary(), capacity, end_id), "pieces"), capacity)
