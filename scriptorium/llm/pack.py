"""Fixed-capacity containers filled with texts: best fit, then a swap-based local search.

Texts are packed where they are read: each task takes up to CHUNK texts at a time and fills containers from them, for every
capacity. There is no shuffle and no group to be gathered, whatever the number of texts; at most a few containers per chunk
stay underfull. The search moves items between underfull containers by exchanges of up to two items for up to two (none
among them) that raise the sum of squared fills, until there is none left between any two containers of the chunk.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scriptorium.llm.tokens import VOCABULARY, count_tokens

#: Texts packed together; the only state a task holds.
CHUNK = 8_192
#: More than any sum of sizes.
GONE = 1 << 60


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of items by container: largest first, each into the fullest container it fits in."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(gaps, (sizes[i], -1))
        if k < len(gaps):
            gap, b = gaps.pop(k)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if gap > sizes[i]:
            insort(gaps, (gap - sizes[i], b))
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search to its end: when it returns, no exchange of at most two items for at most two between any two containers
    raises the sum of squared fills. Every exchange made raises it, so the search ends.

    A container that gives is held against all underfull ones at once: what each could give up stands in one log, and for
    each entry the sum to be given that fills most of the gap is looked up. Changed containers write new entries at the log's end, so
    that a container that found nothing reads on from there."""
    bins = [list(b) for b in bins]
    fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
    total = np.empty(0, np.int64)  # the log: sum of the items, their container, the items; dead entries have sum GONE
    owner, items, segment = np.empty(0, np.int64), [], {}
    read, fresh = {}, []  # how far a container has read the log, containers whose entries are to be written
    under = lambda: [b for b in np.lexsort((np.arange(len(bins)), fill)).tolist() if 0 < fill[b] < capacity]

    def write() -> None:
        nonlocal total, owner
        sums, who = [], []
        for b in dict.fromkeys(fresh):
            read.pop(b, None)
            if b in segment:
                total[slice(*segment.pop(b))] = GONE
            if 0 < fill[b] < capacity:
                own = {0: ()} | _sums(bins[b], sizes)
                segment[b] = (len(items), len(items) + len(own))
                items.extend(own.values())
                sums += own
                who += [b] * len(own)
        fresh.clear()
        total, owner = np.append(total, np.array(sums, np.int64)), np.append(owner, np.array(who, np.int64))

    def thin() -> None:
        nonlocal total, owner, items
        live = total != GONE
        at = np.append(0, np.cumsum(live)).tolist()
        items = [x for x, keep in zip(items, live.tolist()) if keep]
        total, owner = total[live], owner[live]
        for known in (segment, read):
            known.update({b: (at[x[0]], at[x[1]]) if isinstance(x, tuple) else at[x] for b, x in known.items()})

    fresh += under()
    write()
    changed = True
    while changed:
        changed = False
        for d in under():
            while 0 < fill[d] < capacity and read.get(d, 0) < len(items):
                if len(items) > 1_000 and 2 * sum(hi - lo for lo, hi in segment.values()) < len(items):
                    thin()
                since = read.get(d, 0)
                own = _sums(bins[d], sizes)
                given = np.array([-GONE, *sorted(own)], np.int64)
                f, t = fill[owner[since:]], total[since:]
                moved = given[np.searchsorted(given, t + (capacity - f), side="right") - 1] - t
                gain = moved * (f - fill[d] + moved)
                found = np.flatnonzero((moved > 0) & (gain > 0) & (owner[since:] != d))
                if not len(found):
                    read[d] = len(items)
                    break
                left = set(bins[d])
                for x in found[np.argsort(-gain[found], kind="stable")].tolist():
                    b, m, take = int(owner[since + x]), int(moved[x]), items[since + x]
                    give = own[int(t[x]) + m]
                    if b in fresh or not left.issuperset(give):
                        continue
                    left.difference_update(give)
                    for i in give:
                        bins[d].remove(i)
                    for i in take:
                        bins[b].remove(i)
                    bins[d] += take
                    bins[b] += give
                    fill[d] -= m
                    fill[b] += m
                    fresh.append(b)
                    if not left:
                        break
                fresh.append(d)
                write()
                changed = True
    return [b for b in bins if b]


def _sums(items: list[int], sizes: list[int]) -> dict[int, tuple[int, ...]]:
    """One or two of the items for each sum that they can have; items of one size are as good as each other."""
    by: dict[int, list[int]] = {}
    for i in items:
        if len(same := by.setdefault(sizes[i], [])) < 2:
            same.append(i)
    out = {2 * n: tuple(same) for n, same in by.items() if len(same) == 2}
    first = [(n, same[0]) for n, same in by.items()]
    for x, (n, i) in enumerate(first):
        for m, k in first[:x]:
            out[n + m] = (i, k)
    return out | {n: (i,) for n, i in first}


def pack_sizes(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """(item, first token, tokens) by container. An item over the capacity is divided into full containers and a rest; items
    of size 0 take no container."""
    out: list[list[tuple[int, int, int]]] = []
    items: list[tuple[int, int, int]] = []
    for i, n in enumerate(sizes):
        whole = n // capacity if n > capacity else 0
        out += [[(i, k * capacity, capacity)] for k in range(whole)]
        if n - whole * capacity:
            items.append((i, whole * capacity, n - whole * capacity))
    rest = [x[2] for x in items]
    return out + [[items[i] for i in b] for b in improve(best_fit(rest, capacity), rest, capacity)]


def pack(docs: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """spec_name, container, doc_id, first_token, n_tokens: the pieces in each container, for every capacity of `specs`.

    `specs` (spec_name, capacity_tokens) is a parameter table and fetched to the driver; null or non-positive capacities are
    left out. Null and empty texts have no tokens and are in no container. Repeated rows are packed each. Ties in size go by
    place. Extra columns are ignored. A container's name is made of
    task, chunk and number, so another split of the input gives another packing.
    """
    wanted = [(r.spec_name, int(r.capacity_tokens)) for r in specs.where("capacity_tokens > 0").select("spec_name", "capacity_tokens").distinct().orderBy("spec_name", "capacity_tokens").collect()]
    names = ["spec_name", "container", "doc_id", "first_token", "n_tokens"]

    def fill(ids: list[int], sizes: list[int], at: str) -> Iterator[pa.RecordBatch]:
        for spec, capacity in wanted:
            bins = pack_sizes(sizes, capacity)
            rows = [(f"{at}-{b}", ids[i], first, n) for b, items in enumerate(bins) for i, first, n in items]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array([spec] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64())))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        sizes: list[int] = []
        for b in batches:
            ids += b.column(0).to_pylist()
            sizes += count_tokens(b.column(1).to_pylist(), vocabulary)
            if len(ids) >= chunk:
                yield from fill(ids, sizes, f"{task}-{number}")
                ids, sizes, number = [], [], number + 1
        if ids:
            yield from fill(ids, sizes, f"{task}-{number}")

    return docs.select("doc_id", "text").mapInArrow(run, "spec_name string, container string, doc_id bigint, first_token bigint, n_tokens bigint")


def report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_name, capacity, containers, tokens, fill: how full the containers are."""
    from pyspark.sql import functions as F

    bins = packed.groupBy("spec_name", "container").agg(F.sum("n_tokens").alias("n"))
    return bins.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens")).join(F.broadcast(specs), "spec_name").select(
        "spec_name", F.col("capacity_tokens").alias("capacity"), "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill")
    )
