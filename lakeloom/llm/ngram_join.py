"""Operator 6, n-gram Jaccard join: rare-first prefix filtering, verified once per pair.

1. *Signatures.*  One pass over the whole texts gives each document's set of
   shingle hashes, a signature of the set and its parities: whether it has an
   odd number of hashes in each of 256 ranges of the hash space.  The same pass
   counts every shingle of the corpus in a sketch of 2^22 counters.  Documents
   with equal sets form one node, so copies never meet each other again.
2. *Prefixes.*  Shingles are ordered by (count, hash), rare first; the counters
   fix one order for all documents, which is all that exactness needs.  Two
   sets with the wanted similarity share a shingle among the first
   n - ceil(t n) + 1 of each.  Only these prefix shingles are shuffled; a shingle
   far above the mean count is spread over salts.
   Shingles that only one node has are dropped in the sorted stream.
3. *Pairs.*  Nodes meet at a shingle; a shingle of many nodes is cut into blocks
   that meet block by block, each pair of blocks in its own task.  Pairs pass
   the length filter, the positional filter and a bitmap filter over the whole
   sets: two sets differ in at least as many hashes as ranges in parity.  First
   each node meets a few pivots of its shingle; components of the verified links
   then show what is settled, and in shingles that are not, nodes outside the
   largest component meet a few more.  After that every node meets all others of
   its shingle that are not in its component yet, except that members of a
   shingle's largest component don't meet each other.  So all links between
   components are found, while a group of near copies costs a few pairs a node.
4. *Suffixes and verification.*  The sets of distinct pairs are joined; the set of
   a node of many pairs is repeated for parts of them.  The suffix filter bounds
   what the sets can share behind the place where they met: it parts both
   suffixes at the middle hash of one, and the parts again, and adds up by how
   much the parts' sizes differ.  Only pairs that pass have their intersection
   counted, once per pair.

Shingles are compared by 64-bit hashes; a node is a number given to each (64-bit
signature, size), so equal sets are one node, and sets of an id with several
texts are several.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, dealt, dealt_join, documents, heavy_keys, map_slices, repeated, select_exact
from .components import components

WORDS, THRESHOLD = 5, 80
#: Counters of the sketch and slices it is summed in; ranges of the bitmap filter.
SKETCH_BITS, SLICES, RANGE_BITS = 22, 64, 8
#: Nodes a salted shingle has in one task, about; pivots a shingle has in each round.
SALTED, PIVOTS = 8_192, (4, 8)
#: Partial sketches that one task adds up.
FAN_IN = 256
#: Nodes of a block of one shingle, pairs that one copy of a set serves, documents of a set in one task.
BLOCK, PAIRS_OF_A_SET, COPIES = 4_096, 128, 1 << 17
#: Times that the suffix filter parts the suffixes.
SUFFIX_DEPTH = 2
ODD = ("o0", "o1", "o2", "o3")
#: Bounds of the packed word: shingles of one text, salts of one shingle.
MOST_SHINGLES, MOST_SALTS = (1 << 28) - 1, 126
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z in lower case, split at ASCII white space."""
    return text.lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; a text with fewer words is one shingle, without words none."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _MULTIPLIERS[i % 64] + (h[i : len(h) - k + 1 + i] >> np.uint64(32 - i % 8))
    total = np.sort(_mixed(total))
    fresh = np.ones(len(total), bool)
    np.not_equal(total[1:], total[:-1], out=fresh[1:])
    return total[fresh]


def prefix_length(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def signature(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """Four 64-bit words: for each range of the hash space, whether an odd number of hashes lies in it."""
    odd = np.bincount((hashes >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _pack(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype("<u4").tobytes(), 3)


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), "<u4")


def _describe(docs: DataFrame, width: int, id_type: str) -> DataFrame:
    """Rows with slice null: (doc_id, n, sig, o0..o3) of a document; others: (task, slice, blob) of a task's sketch."""

    def body(slices):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for rows in slices:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n", "sig", *ODD)}
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                s = shingle_set(text, width)
                out["doc_id"].append(doc_id)
                out["n"].append(len(s))
                out["sig"].append(signature(s) if len(s) else None)
                for k, word in zip(ODD, parities(s).tolist()):
                    out[k].append(word)
                np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield out | {k: [None] * len(out["n"]) for k in ("task", "slice", "blob")}
        part = (1 << SKETCH_BITS) // SLICES
        yield dict.fromkeys(("doc_id", "n", "sig", *ODD), [None] * SLICES) | {"task": [TaskContext.get().partitionId()] * SLICES, "slice": list(range(SLICES)), "blob": [_pack(sketch[k * part : (k + 1) * part]) for k in range(SLICES)]}

    ddl = f"doc_id {id_type}, n long, sig long, {', '.join(f'{k} long' for k in ODD)}, task int, slice int, blob binary"
    return map_slices(docs, ddl, {"doc_id": "doc_id", "text": "text"}, body)


def _add_sketches(partial: DataFrame, tasks: int, scratch: Scratch) -> np.ndarray:
    """Sum of the tasks' sketches, added up FAN_IN at a time.  Each level is a table, so that neither the one before nor its shuffle files stay."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint32)
        for blob in table.column("blob"):
            total += _unpack(blob.as_py())
        return pa.table({"task": pa.array([table.column("task")[0].as_py() // FAN_IN], pa.int32()), "slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "blob": [_pack(total)]})

    level = 0
    while True:
        partial = partial.groupBy("slice", F.floor(F.col("task") / FAN_IN).alias("group")).applyInArrow(add, "task int, slice int, blob binary")
        partial = scratch.keep(partial, f"sketch{level}")
        scratch.drop(f"sketch{level - 1}" if level else "described")
        tasks, level = -(-tasks // FAN_IN), level + 1
        if tasks <= 1:
            break
    found = {r["slice"]: _unpack(r["blob"]) for r in partial.collect()}  # 2^22 counters, whatever the input
    scratch.drop(f"sketch{level - 1}")
    return np.concatenate([found[k] for k in range(SLICES)]) if found else np.zeros(1 << SKETCH_BITS, np.uint32)


def _prefixes(docs: DataFrame, sketch, mean: float, width: int, threshold: int) -> DataFrame:
    """(key, sig, meta) of every prefix shingle that another document may have, too; ``_packed`` says what they hold."""
    top = mean + 6 * mean**0.5 + SALTED

    def body(slices):
        seen: set[tuple[int, int]] = set()
        counts = sketch.value
        for rows in slices:
            parts = []
            for text in rows["text"]:
                s = shingle_set(text, width)
                n = len(s)
                if not n or (key := (signature(s), n)) in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(key)
                c = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.lexsort((s, c))[: prefix_length(n, threshold)]
                pos = np.flatnonzero(c[first] > 1)  # a counter of 1: no other document has it
                first = first[pos]
                if n > MOST_SHINGLES:
                    raise ValueError(f"a text has {n} shingles; at most {MOST_SHINGLES} can be joined")
                salts = np.clip(-(-(c[first] - mean) // SALTED), 1, MOST_SALTS).astype(np.uint64)
                salt = np.where(c[first] > top, np.uint64(key[0] % (1 << 64)) % salts + np.uint64(1), np.uint64(0))
                parts.append((s[first] ^ salt * _SPREAD, np.full(len(first), key[0], np.int64), _packed(n, pos, salt)))
            if parts:
                key, sig, meta = (np.concatenate(x) for x in zip(*parts))
                yield {"key": pa.array(key.view(np.int64)), "sig": pa.array(sig), "meta": pa.array(meta.view(np.int64))}

    return map_slices(docs, "key long, sig long, meta long", {"text": "text"}, body)


def _packed(n: int, pos: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A set's size, a position and a salt (0: the shingle isn't salted) in one word; a salted key is the shingle mixed with its salt."""
    return np.uint64(n << 35) | pos.astype(np.uint64) << np.uint64(7) | salt


def _shared_only(prefixes: DataFrame) -> DataFrame:
    """(h, sig, n, pos) without repeated rows, and without unsalted shingles of one node only; holds one batch and one row."""

    def run(batches):
        pending, open_key, last = None, None, None  # a row that may be alone; the open run's key if it counts; the last row seen
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if pending is not None:
                cols = [np.concatenate((p, c)) for p, c in zip(pending, cols)]
                pending, last = None, None
            key, sig, meta = cols
            size = meta >> 35
            new_run = np.ones(len(key), bool)
            new_run[1:] = key[1:] != key[:-1]
            fresh = np.ones(len(key), bool)
            fresh[1:] = new_run[1:] | (sig[1:] != sig[:-1]) | (size[1:] != size[:-1])
            if last == (int(key[0]), int(sig[0]), int(size[0])):
                fresh[0] = False
            run_id = np.cumsum(new_run) - 1
            counts = (np.bincount(run_id, fresh) >= 2) | (meta[new_run] & 127 > 0)
            if open_key == int(key[0]):
                counts[0] = True
            last = (int(key[-1]), int(sig[-1]), int(size[-1]))
            open_key = last[0] if counts[-1] else None
            tail = (run_id == run_id[-1]) & fresh
            if not counts[-1] and tail.any():
                at = int(np.flatnonzero(tail)[0])
                pending = [c[at : at + 1] for c in cols]
            keep = fresh & counts[run_id]
            key, sig, meta = (c[keep] for c in cols)
            h = (key.view(np.uint64) ^ (meta & 127).astype(np.uint64) * _SPREAD).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(sig), pa.array((meta >> 35).astype(np.int32)), pa.array((meta >> 7 & MOST_SHINGLES).astype(np.int32))], names=["h", "sig", "n", "pos"])
        pa.default_memory_pool().release_unused()

    return prefixes.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(run, "h long, sig long, n int, pos int")


def _passes(threshold: int):
    """Length, positional and bitmap filter of two postings a and b of one shingle.

    Sets that link differ in at most |a| + |b| - 2 ceil(t (|a| + |b|) / (100 + t)) hashes.
    """
    a_n, b_n = F.col("a.n").cast("long"), F.col("b.n").cast("long")
    least, sizes = F.least(a_n - F.col("a.pos"), b_n - F.col("b.pos")), a_n + b_n
    length = (a_n * 100 >= b_n * threshold) & (b_n * 100 >= a_n * threshold)
    apart = sum((F.bit_count(F.col(f"a.{k}").bitwiseXOR(F.col(f"b.{k}"))) for k in ODD), F.lit(0))
    common = F.floor((threshold * sizes + (99 + threshold)) / (100 + threshold))
    return length & ((100 + threshold) * least >= threshold * sizes) & (apart <= sizes - 2 * common)


def _pairs(joined: DataFrame) -> DataFrame:
    """(p, q, p_pos, q_pos) of each pair once, p before q, with the first places where they met."""
    a_first = F.col("a.node") < F.col("b.node")
    pick = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))
    places = F.shiftleft(pick("a.pos", "b.pos").cast("long"), 32) + pick("b.pos", "a.pos")
    met = joined.select(pick("a.node", "b.node").alias("p"), pick("b.node", "a.node").alias("q"), places.alias("at"))
    met = met.groupBy("p", "q").agg(F.min("at").alias("at"))
    return met.select("p", "q", F.shiftright("at", 32).cast("int").alias("p_pos"), F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias("q_pos"))


def suffix_difference(x: np.ndarray, y: np.ndarray, depth: int = SUFFIX_DEPTH) -> int:
    """At least this many values are in one of two sorted arrays only: parts around the middle value of one differ by their sizes at least."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    w = y[len(y) // 2]
    a, b, c, d = np.searchsorted(x, w), np.searchsorted(x, w, "right"), np.searchsorted(y, w), np.searchsorted(y, w, "right")
    return suffix_difference(x[:a], y[:c], depth - 1) + abs(int(b - a - d + c)) + suffix_difference(x[b:], y[d:], depth - 1)


def may_link(x: np.ndarray, y: np.ndarray, i: int, j: int, threshold: int) -> bool:
    """Suffix filter of two sets, as their places in the order of shingles, that share the i-th of the one and the j-th of the other."""
    x, y = np.sort(x)[i + 1 :], np.sort(y)[j + 1 :]
    sizes = len(x) + i + len(y) + j + 2
    most = min(i, j) + 1 + (len(x) + len(y) - suffix_difference(x, y)) // 2
    return (100 + threshold) * most >= threshold * sizes


def _verify(pairs: DataFrame, sets: DataFrame, sketch, threshold: int, scratch: Scratch, name: str) -> DataFrame:
    """(p, q) of the pairs that link, by their sets' intersection."""
    ends = pairs.select(F.col("p").alias("node"), F.lit("p").alias("end")).unionByName(pairs.select(F.col("q").alias("node"), F.lit("q").alias("end")))
    counted = ends.groupBy("node", "end").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > PAIRS_OF_A_SET)
    heavy = scratch.keep(counted.groupBy("node").agg(F.ceil(F.max("c") / PAIRS_OF_A_SET).cast("long").alias("parts")), name)
    heavy = None if heavy.isEmpty() else bounded(heavy)
    # The sets are shuffled once for both joins and are in no table: these shuffles are most of the operator's disk.
    on = ["node"] if heavy is None else ["node", "part"]
    own = (sets if heavy is None else repeated(sets, ["node"], heavy)).select(*on, "hashes").repartition(*on).dropDuplicates(on)
    both = pairs
    for k, other in (("p", "q"), ("q", "p")):
        many = both if heavy is None else dealt(both, [k], heavy.withColumnRenamed("node", k), F.col(other))
        both = many.join(own.withColumnsRenamed({"node": k, "hashes": f"{k}_hashes"}), [k, *on[1:]]).drop("part")

    def run(batches):
        counts = sketch.value

        def places(hashes):
            """Where hashes stand in the order (count, hash), by the first bits of the hash."""
            return counts[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | hashes >> np.uint64(32)

        for batch in batches:
            sides = []
            for c in ("p_hashes", "q_hashes"):
                column = batch.column(batch.schema.get_field_index(c))
                sides.append((column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()))
            (x, x_at), (y, y_at) = sides
            first = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("p_pos", "q_pos")]
            links = np.zeros(batch.num_rows, bool)
            for r, (i, j) in enumerate(zip(*first)):
                a, b = x[x_at[r] : x_at[r + 1]], y[y_at[r] : y_at[r + 1]]
                if may_link(places(a), places(b), int(i), int(j), threshold):
                    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    links[r] = (100 + threshold) * int((b[at] == a).sum()) >= threshold * (len(a) + len(b))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(links)), batch.column(1).filter(pa.array(links))], names=["p", "q"])
        pa.default_memory_pool().release_unused()

    return both.select("p", "q", "p_pos", "q_pos", "p_hashes", "q_hashes").mapInArrow(run, pairs.select("p", "q").schema)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row: doc_id, n_shingles, class_id, component_id.

    class_id is the smallest id with the same set; component_id the smallest id
    that links reach, itself included.  Null, empty and word-less texts have no
    shingle and are alone.  A null id keeps its n_shingles but never links; its
    ids are null.  Rows that repeat an id are one document with the links of
    all its texts.  An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = select_exact(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("binary"))

    described = scratch.keep(_describe(rows, width, id_type), "described")
    own = scratch.keep(described.where("slice IS NULL").select("doc_id", "n", "sig", *ODD), "own")  # without the sketches
    partial = described.where("slice IS NOT NULL").select("task", "slice", "blob")
    tasks = (partial.agg(F.max("task")).first()[0] or 0) + 1
    sketch = _add_sketches(partial, tasks, scratch)
    mean = float(sketch.sum(dtype=np.float64) / len(sketch))

    linked = own.where("n > 0 AND doc_id IS NOT NULL")
    nodes = linked.groupBy("sig", "n").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), *(F.first(k).alias(k) for k in ODD))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written, so the numbers stay
    shared = spark.sparkContext.broadcast(sketch)  # 16 MB, whatever the input
    postings = scratch.keep(_shared_only(_prefixes(rows.where("doc_id IS NOT NULL"), shared, mean, width, threshold)), "shared")
    postings = postings.join(nodes.withColumn("n", F.col("n").cast("int")), ["sig", "n"])
    postings = scratch.keep(postings.select("h", "node", "n", "pos", *ODD), "postings")
    scratch.drop("shared")
    blocks = heavy_keys(postings, ["h"], BLOCK, scratch, "blocks")

    def to_sets(slices):
        seen: set[tuple] = set()
        for part in slices:
            out: dict[str, list] = {"id": [], "sig": [], "n": [], "hashes": []}
            for doc_id, text in zip(part["doc_id"], part["text"]):
                s = shingle_set(text, width)
                if not len(s) or (key := (doc_id, signature(s), len(s))) in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(key)
                for k, v in zip(out, (*key, s.view(np.int64))):
                    out[k].append(v)
            yield out

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        """(node, hashes) of the nodes that occur in pairs; only their texts go to Python again.  Rows that repeat id and text in several tasks repeat a node."""
        wanted = pairs.select(F.col("p").alias("node")).union(pairs.select("q")).distinct()
        wanted = scratch.keep(nodes.join(wanted, "node").select("node", "id", "sig", "n"), f"{name}-wanted")
        ids = bounded(scratch.keep(wanted.select(F.col("id").alias("doc_id")).distinct(), f"{name}-ids"))
        found = map_slices(rows.join(ids, "doc_id", "left_semi"), f"id {id_type}, sig long, n long, hashes array<bigint>", {"doc_id": "doc_id", "text": "text"}, to_sets)
        return found.join(bounded(wanted), ["id", "sig", "n"]).select("node", "hashes")

    links = None
    for k, pivots in enumerate((*PIVOTS, None)):
        here = postings.withColumn("label", F.col("node"))
        if links is not None:
            settled = scratch.keep(components(links, scratch, f"stars{k}"), f"labels{k}")
            here = postings.join(settled, "node", "left").select("h", "node", "n", "pos", *ODD, F.coalesce("root", "node").alias("label"))
            ranked = here.groupBy("h", "label").agg(F.count(F.lit(1)).alias("rows"))
            main = ranked.groupBy("h").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
            here = scratch.keep(dealt_join(here, main.select("h", "main"), ["h"], blocks, F.col("node")), f"open{k}")
        if pivots:
            order = F.xxhash64("node", F.lit(k))
            some = here.groupBy("h", F.pmod(order, F.lit(pivots)).alias("slot")).agg(F.min(F.struct(order.alias("o"), "node", "n", "pos", "label", *ODD)).alias("best"))
            others = some.select("h", *(f"best.{c}" for c in ("node", "n", "pos", "label", *ODD)))
            minor = here if links is None else here.where("label <> main")
            a, b = dealt(minor, ["h"], blocks, F.col("node"), "i").withColumn("j", F.lit(0)), repeated(others, ["h"], blocks, "i").withColumn("j", F.lit(0))
        else:
            minor = here if links is None else here.where("label <> main")
            a = repeated(dealt(minor, ["h"], blocks, F.col("node"), "i"), ["h"], blocks, "j")
            b = repeated(dealt(here, ["h"], blocks, F.col("node"), "j"), ["h"], blocks, "i")
        a, b = a.alias("a"), b.alias("b")
        same_block = (F.col("a.h") == F.col("b.h")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
        found = _pairs(a.join(b, same_block & (F.col("a.label") != F.col("b.label")) & _passes(threshold)))
        if links is not None:
            found = found.join(tried, ["p", "q"], "left_anti")
        found = scratch.keep(found, f"pairs{k}")
        if links is not None:
            scratch.drop(f"open{k}")
            scratch.drop(f"labels{k}")
        tried = found.select("p", "q") if links is None else tried.unionByName(found.select("p", "q"))
        sets = sets_of(found, f"sets{k}")
        more = scratch.keep(_verify(found, sets, shared, threshold, scratch, f"heavy{k}"), f"links{k}")
        links = more if links is None else links.unionByName(more)

    # An id with several texts is one document: its nodes are joined by the id itself.
    several = linked.groupBy("doc_id").agg(F.min(F.struct("sig", "n")).alias("low"), F.max(F.struct("sig", "n")).alias("high")).where("low <> high").select("doc_id")
    several = scratch.keep(several, "several")
    if not several.isEmpty():
        texts = linked.join(bounded(several), "doc_id", "left_semi").select("doc_id", "sig", "n").distinct().join(nodes, ["sig", "n"])
        texts = scratch.keep(texts.select("doc_id", "node"), "texts")
        first = texts.groupBy("doc_id").agg(F.min("node").alias("p"))
        heavy = heavy_keys(texts, ["doc_id"], BLOCK, scratch, "heavy-ids")
        links = links.unionByName(dealt_join(texts, first, ["doc_id"], heavy, F.col("node")).select("p", F.col("node").alias("q")))
    roots = components(links, scratch, "final")
    placed = scratch.keep(nodes.join(roots, "node", "left").select("sig", "n", "copies", F.col("id").alias("class_id"), "root"), "placed")
    grouped = placed.where("root IS NOT NULL")
    least = scratch.keep(grouped.groupBy("root").agg(F.min("class_id").alias("component_id")), "least")
    large = heavy_keys(grouped, ["root"], COPIES, scratch, "large")
    grouped = dealt_join(grouped, bounded(least), ["root"], large, F.col("sig"))
    single = placed.where("root IS NULL").withColumn("component_id", F.col("class_id"))
    placed = grouped.unionByName(single).select("sig", "n", "class_id", "component_id")
    copies = scratch.keep(nodes.where(F.col("copies") > COPIES).select("sig", "n", F.ceil(F.col("copies") / COPIES).cast("long").alias("parts")), "copies")
    alone = F.col("class_id").isNull() | F.col("doc_id").isNull()
    return dealt_join(own, placed, ["sig", "n"], None if copies.isEmpty() else bounded(copies), F.col("doc_id"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s
  FROM (SELECT doc_id, coalesce(w, []) AS w FROM words)
), classes AS (
  SELECT min(doc_id) AS node, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
), members AS (
  SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM sets
), tokens AS (
  SELECT node, n, unnest(s) AS g FROM classes
), pairs AS (
  SELECT a.node AS p, b.node AS q, a.n AS p_n, b.n AS q_n, count(*) AS c
  FROM tokens a JOIN tokens b ON a.g = b.g AND a.node < b.node GROUP BY ALL
), links AS (
  SELECT p, q FROM pairs WHERE 100 * c >= 80 * (p_n + q_n - c)
  UNION ALL SELECT q, p FROM pairs WHERE 100 * c >= 80 * (p_n + q_n - c)
), reach(node, root) AS (
  SELECT node, node FROM classes
  UNION
  SELECT l.q, r.root FROM reach r JOIN links l ON l.p = r.node
), roots AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT m.doc_id, m.n AS n_shingles,
       coalesce(c.node, m.doc_id) AS class_id,
       coalesce(r.root, m.doc_id) AS component_id
FROM members m LEFT JOIN classes c ON c.s = m.s AND m.n > 0 LEFT JOIN roots r ON r.node = c.node
"""
