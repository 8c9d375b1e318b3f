"""Operator 1, best-fit packing: a configuration linear program over the length histogram.

1. Every document is encoded once; only documents over the capacity are cut, the
   odd-sized piece first.  A piece remembers its rank among the pieces of its
   length in its task, so no global sort is needed.
2. The histogram of lengths (at most ``capacity`` counters, whatever the input)
   goes to the driver.  There a configuration (a multiset of lengths that fits
   one sequence) is a column of a covering program: use as few configurations
   as possible so that every length is covered.  Multiplicative weights price
   the lengths, a knapsack dynamic program finds the best configuration for
   the prices, and the weights of what it covers shrink.
3. The fractional solution is rounded down; what remains goes, longest first,
   into the fullest sequence that still has room, else opens new ones.
4. The plan is a table of (length, range of ranks) -> (first sequence, offset).
   Its size depends on the capacity and the number of pricing rounds, not on
   the corpus.  Tasks look their pieces up in it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, map_slices
from .tokenizer import text_encoder

CAPACITY = 2048
#: Classes of lengths that the program prices at most, its rounds, and the shrink rate of weights.
CLASSES, ROUNDS, RATE = 256, 2_000, 0.25


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> dict[int, int]:
    """Unbounded knapsack: the multiset of items (index -> copies) of most value within ``room``."""
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], values[order]
    best, last = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    fits = np.searchsorted(s, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        n = fits[w]
        if n:
            with_item = best[w - s[:n]] + v[:n]
            k = int(with_item.argmax())
            if with_item[k] > best[w]:
                best[w], last[w] = with_item[k], k
    taken: dict[int, int] = {}
    w = room
    while w > 0:
        k = int(last[w])
        if k < 0:
            w -= 1
            continue
        i = int(order[k])
        taken[i] = taken.get(i, 0) + 1
        w -= int(s[k])
    return taken


def solve_configurations(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = ROUNDS, rate: float = RATE) -> tuple[dict[tuple, float], float]:
    """Fractional covering by multiplicative weights.

    Returns {configuration ((class, copies), ...): times}, scaled to the volume of
    the demand, and a lower bound on the number of sequences from the best prices seen.
    """
    weight = sizes / sizes.max()  # prices in proportion to size: the volume bound, to start with
    covered = np.zeros(len(sizes))
    times: dict[tuple, float] = {}
    bound = 0.0
    for _ in range(rounds):
        prices = weight / weight.max()
        taken = knapsack(prices, sizes, room)
        value = sum(prices[i] * n for i, n in taken.items())
        bound = max(bound, float((prices * demand).sum() / value))
        step = min(demand[i] / n for i, n in taken.items())
        key = tuple(sorted(taken.items()))
        times[key] = times.get(key, 0.0) + step
        for i, n in taken.items():
            gain = n * step / demand[i]
            covered[i] += gain
            weight[i] *= np.exp(-rate * gain)
        low = covered.min()
        if low > 0 and sum(times.values()) / low <= 1.005 * bound:
            break
    scale = float((covered * demand * sizes).sum() / (demand * sizes).sum())  # units of coverage by volume
    return {k: t / scale for k, t in times.items()}, bound


def plan_sequences(histogram: dict[int, int], capacity: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[list[tuple[int, list[int]]], float]:
    """Sequences for a histogram of lengths: [(how many, lengths in each)], and the program's bound.

    The bound holds for lengths rounded up to the grid, so with a grid over 1
    the result may lie below it.
    Every piece is placed exactly once and no sequence exceeds ``capacity``.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    groups: list[tuple[int, list[int]]] = []
    if full := left.pop(capacity, 0):
        groups.append((full, [capacity]))
    if not left:
        return groups, float(full)
    grid = max(1, -(-capacity // classes)) if len(left) > classes else 1
    by_class: dict[int, list[int]] = {}
    for n in sorted(left):
        by_class.setdefault(-(-n // grid), []).append(n)
    # A class is as large as its largest member, counted in steps of the grid.
    sizes = np.array(sorted(by_class), np.int64)
    demand = np.array([sum(left[n] for n in by_class[int(s)]) for s in sizes], float)
    room = capacity // grid
    times, bound = solve_configurations(sizes, demand, room, rounds)

    alive = sorted(left)

    def take(n: int, many: int) -> None:
        left[n] -= many
        if not left[n]:
            del alive[bisect_left(alive, n)]

    for config, t in sorted(times.items(), key=lambda x: (-x[1], x[0])):
        slots = sorted((int(sizes[i]) for i, n in config for _ in range(n)), reverse=True)
        uses = int(t)
        while uses > 0:  # runs of sequences with the same lengths
            chosen, taken = [], {}

            def spare(n: int) -> bool:
                return left[n] > taken.get(n, 0)

            for s in slots[:-1]:
                n = next((n for n in reversed(by_class[s]) if spare(n)), None)
                if n is None:
                    break
                taken[n] = taken.get(n, 0) + 1
                chosen.append(n)
            if len(chosen) < len(slots) - 1:
                break
            # Lengths under their class's size leave room: the last slot takes the longest that fits.
            at = bisect_right(alive, capacity - sum(chosen)) - 1
            while at >= 0 and not spare(alive[at]):
                at -= 1
            if at < 0 or alive[at] < by_class[slots[-1]][0]:
                break
            taken[alive[at]] = taken.get(alive[at], 0) + 1
            chosen.append(alive[at])
            run = min(uses, *(left[n] // k for n, k in taken.items()))
            for n, k in taken.items():
                take(n, k * run)
            groups.append((run, chosen))
            uses -= run

    # Best fit, longest first, over groups of sequences that have the same free room.
    free: dict[int, list[int]] = {}
    for g, (_, lengths) in enumerate(groups):
        if gap := capacity - sum(lengths):
            free.setdefault(gap, []).append(g)
    gaps = sorted(free)

    def add(gap: int, g: int) -> None:
        if gap:
            if gap not in free:
                free[gap] = []
                insort(gaps, gap)
            free[gap].append(g)

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = bisect_left(gaps, n)
            if at < len(gaps):
                gap = gaps[at]
                g = free[gap].pop()
                if not free[gap]:
                    del free[gap], gaps[at]
                many, lengths = groups[g]
                used = min(many, count)
                groups[g] = (used, [*lengths, n])
                add(gap - n, g)
                if used < many:
                    groups.append((many - used, lengths))
                    add(gap, len(groups) - 1)
                count -= used
            else:
                per = capacity // n
                if count >= per:
                    groups.append((count // per, [n] * per))
                    add(capacity - per * n, len(groups) - 1)
                    count %= per
                else:
                    groups.append((1, [n] * count))
                    add(capacity - count * n, len(groups) - 1)
                    count = 0
    return groups, bound + full


def plan_table(groups: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: pieces of ``length`` with rank >= ``rank`` go to ``sequence + rank - rank``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for many, lengths in groups:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + many
            offset += n
        sequence += many
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; an odd-sized piece comes first."""
    first = total if total <= capacity else total % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A document is its ids followed by ``end_id``.  Null and empty texts are the
    end id alone.  Null ids are carried; repeated rows are packed each on its
    own; which of several pieces of one length gets which place is arbitrary but
    fixed by the written pieces.  An empty table gives an empty result; other
    columns are ignored.  ``with_ids`` adds the piece's ids as little-endian
    32-bit integers; ``sequences`` joins them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    end = np.array([end_id], "<u4").tobytes()

    def body(slices):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for rows in slices:
            encoder = text_encoder(tokenizer_path)
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "seen", *(["ids"] if with_ids else []))}
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                ids = encoder.encode(text or "") + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    values = [doc_id, k, start, n, zlib.crc32(part), task, int(seen[n])]
                    seen[n] += 1
                    for name, value in zip(out, [*values, part] if with_ids else values):
                        out[name].append(value)
            yield out

    id_type = docs.schema[id_col].dataType.simpleString()
    ids_field = ", ids binary" if with_ids else ""
    ddl = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, seen long{ids_field}"
    pieces = scratch.keep(map_slices(docs, ddl, {"doc_id": id_col, "text": text_col}, body), "pieces")

    counts = scratch.keep(pieces.groupBy("length", "task").count(), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = plan_table(plan_sequences(histogram, capacity)[0])
    shift = 1 << 48
    keys = plan["length"] * shift + plan["rank"]

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("seen"))

    def place(slices):
        for rows in slices:
            length, rank = np.array(rows["length"], np.int64), np.array(rows["rank"], np.int64)
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            yield rows | {"sequence_id": plan["sequence"][at] + rank - plan["rank"][at], "offset": plan["offset"][at]}

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if with_ids else [])]
    out = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long{ids_field}"
    return map_slices(ranked, out, {c: c for c in columns}, place)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from ``pack(..., with_ids=True)``: sequence_id, n_tokens, ids.  A sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda got, x: F.concat(got, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
