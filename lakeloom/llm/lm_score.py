"""Operator 8, LM scoring: a hashed maximum-entropy model with a class-factored softmax.

*Counts.*  Documents fall into blocks of bounded size.  Each block's distinct
words (as 64-bit hashes) are pre-aggregated, their training counts are summed
over all blocks and joined back to the block; a word of very many blocks is
dealt over several tasks.  So every document is scored with exact corpus counts
although no table of all words is ever held in one place.

*Model.*  The most frequent tokens are dealt by rank into classes of equal size;
all other words form one rare class.  P(token) = P(class | history) *
P(token | class, history): two softmaxes whose scores are sums of weights of
hashed features (the word before, the pair before, the word before that) on top
of the log shares of plain counts.  The rare class is a tree of classes: each
level is one more softmax over 16 branches, which digits of the word's hash
choose, with weights by (history, node).  The tree grows with the distinct
words to about one word a leaf, the hashed rows with the training tokens (up to
MOST_DEPTH and MOST_BITS).  Words of one leaf have their smoothed share of it.

*Training.*  Every training document is used once.  A hash of id and text deals
documents to shards, whose number depends on the corpus alone, and orders them.
In each round every shard starts from the same weights, takes AdaGrad steps over
mini-batches of its documents in order and sends its weights back, which are
averaged by tokens seen, slice by slice and in the order of the shards.  So the
model does not depend on how the rows are partitioned.

*Scoring.*  A block's texts meet its words' counts and are scored in numpy batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, crc_part, dealt_join, documents, map_slices, number_columns

#: Classes and tokens of a class; bits of the feature hash; training rounds and step size.
CLASSES, WIDTH, FEATURE_BITS = 16, 16, 14
#: Levels of the rare class and bits of the feature hash at most; they bound a task's memory.
MOST_DEPTH, MOST_BITS = 5, 20
#: Training tokens a feature row, so that what the tasks send grows no faster than the input.
TOKENS_OF_A_ROW = 1_024
ROUNDS, STEP, BATCH = 2, 0.1, 65_536
#: Tokens whose scores are found at once, so that they stay in a core's cache.
CHUNK = 4_096
#: Rows of a block and bytes of a text in it; longer texts form blocks of as many times fewer rows.
BLOCK_ROWS, BLOCK_TEXT = 4_096, 1 << 14
#: Blocks of one word in one task; training tokens of a shard, and tokens for each feature row, at least.
BLOCKS_OF_A_WORD, SHARD_TOKENS, SHARD_ROW_TOKENS = 4_096, 1 << 21, 32
SLICES, FAN_IN = 16, 64
SMOOTHING = 0.1
END = xxhash.xxh3_64_intdigest(b" end of text ")  # no word contains a space
UNKNOWN = xxhash.xxh3_64_intdigest(b" a word that was not learned ")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _depth_of(leaves: int) -> int:
    return (leaves.bit_length() - 1) // 4


def _leaf(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Leaf of the rare class that a word belongs to: ``depth`` digits of its mixed hash."""
    x = (tokens ^ tokens >> np.uint64(31)) * _B
    return (x >> np.uint64(64 - 4 * depth)).astype(np.int64) if depth else np.zeros(len(tokens), np.int64)


def sizes_of(tokens: int, distinct: int) -> tuple[int, int]:
    """(depth of the rare class, bits of the feature hash) for that many training tokens and distinct words: about one word a leaf."""
    depth = 0
    while WIDTH**depth < distinct - CLASSES * WIDTH and depth < MOST_DEPTH:
        depth += 1
    return depth, min(max(FEATURE_BITS, (tokens // TOKENS_OF_A_ROW).bit_length() - 1), MOST_BITS)


def tokens_of(text: bytes | None) -> np.ndarray:
    """Hashes of a text's words and of one end token; A-Z in lower case, words split at ASCII white space."""
    words = text.lower().split() if text else []
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def _scores(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The bias plus the weights in three rows an example; shifted only where exp could leave its range."""
    z = np.take(weights, rows[0], axis=0)
    z += np.take(weights, rows[1], axis=0)
    z += np.take(weights, rows[2], axis=0)
    z += bias
    if z.size and (z.max() > 60 or z.min() < -60):
        z -= z.max(axis=1, keepdims=True)
    return z


def _softmax(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = _scores(weights, rows, bias)
    np.exp(z, out=z)
    z /= np.einsum("ij->i", z)[:, None]
    return z


def _log_choice(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """log10 of the softmax of each example's choice."""
    z = _scores(weights, rows, bias)
    own = z[np.arange(len(z)), chosen]
    np.exp(z, out=z)
    own -= np.log(np.einsum("ij->i", z))
    return np.maximum(own / np.log(np.float32(10)), -30)


@dataclass
class Model:
    """Shares of plain counts and weights of hashed features."""

    top: np.ndarray  # sorted hashes of the tokens that are modelled one by one
    rank: np.ndarray  # their ranks by count
    class_bias: np.ndarray  # log share of each class, the rare one last
    word_bias: np.ndarray  # log share of each token in its class, [CLASSES, WIDTH]
    rare_total: float  # smoothed total of the rare class
    class_weights: np.ndarray  # [features, CLASSES + 1]
    word_weights: np.ndarray  # [features, WIDTH]
    leaves: np.ndarray  # smoothed totals of the rare class's leaves, WIDTH ** depth
    branch_bias: list[np.ndarray]  # for each level of the rare class, log share of each branch in its node, [nodes, WIDTH]

    @classmethod
    def start(cls, counts: list[tuple[int, int]], total: int, distinct: int, leaves: np.ndarray | None = None, bits: int = FEATURE_BITS) -> Model:
        """From the most frequent (hash, count), most frequent first, the corpus totals and all words' smoothed totals by leaf."""
        n = CLASSES * WIDTH
        hashes = np.array([h for h, _ in counts[:n]], np.int64).view(np.uint64)
        c = np.zeros(n)
        c[: len(hashes)] = [k for _, k in counts[:n]]
        order = np.argsort(hashes)
        by_class = c.reshape(CLASSES, WIDTH) + 1e-3
        rare = total - c.sum() + SMOOTHING * (distinct - len(hashes) + 1)
        mass = np.append(c.reshape(CLASSES, WIDTH).sum(axis=1), max(rare, SMOOTHING)) + 1e-3
        if leaves is None:
            totals = np.array([max(rare, SMOOTHING)])
        else:
            totals = leaves.copy()
            depth = _depth_of(len(totals))
            np.subtract.at(totals, _leaf(hashes, depth), c[: len(hashes)] + SMOOTHING)
            np.maximum(totals, 0, out=totals)
            totals[_leaf(np.array([UNKNOWN], np.uint64), depth)] += SMOOTHING
        branch_bias = []
        at = totals
        while len(at) > 1:
            share = at.reshape(-1, WIDTH) + 1e-6
            branch_bias.insert(0, np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32))
            at = at.reshape(-1, WIDTH).sum(axis=1)
        return cls(
            hashes[order],
            np.arange(len(hashes))[order],
            np.log(mass / mass.sum()).astype(np.float32),
            np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32),
            float(max(rare, SMOOTHING)),
            np.zeros((1 << bits, CLASSES + 1), np.float32),
            np.zeros((1 << bits, WIDTH), np.float32),
            totals,
            branch_bias,
        )

    @property
    def bits(self) -> int:
        return len(self.word_weights).bit_length() - 1

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        """Rank of each token; CLASSES * WIDTH for the rare ones."""
        rare = CLASSES * WIDTH
        if not len(self.top):
            return np.full(len(tokens), rare, np.int64)
        at = np.minimum(np.searchsorted(self.top, tokens), len(self.top) - 1)
        return np.where(self.top[at] == tokens, self.rank[at], rare)

    def levels(self, features: np.ndarray, leaf: np.ndarray):
        """For each level of the rare class: feature rows, biases by node, the nodes passed and the branches taken to the leaves."""
        depth = len(self.branch_bias)
        for level, bias in enumerate(self.branch_bias):
            node = leaf >> (4 * (depth - level))
            salts = ((node * 16 + level + CLASSES + 1) * 0x9E3779B1 >> 5) & 0xFFFFFFFF
            yield (features + salts) & (len(self.word_weights) - 1), bias, node, leaf >> (4 * (depth - level - 1)) & (WIDTH - 1)

    def log10(self, features: np.ndarray, ranks: np.ndarray, counts: np.ndarray, tokens: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each token; ``counts`` are training counts, used for rare tokens; without ``tokens`` the rare class must have one leaf."""
        own, mask = ranks // WIDTH, len(self.word_weights) - 1
        p = _log_choice(self.class_weights, features, self.class_bias, own).astype(np.float64)
        frequent, rare = np.flatnonzero(own < CLASSES), np.flatnonzero(own == CLASSES)
        of = own[frequent]
        p[frequent] += _log_choice(self.word_weights, (features[:, frequent] + of * 7919) & mask, np.take(self.word_bias, of, axis=0), ranks[frequent] % WIDTH)
        leaf = np.zeros(len(rare), np.int64)
        if self.branch_bias:
            leaf = _leaf(np.where(counts[rare] > 0, tokens[rare], np.uint64(UNKNOWN)), len(self.branch_bias))
            for rows, bias, node, branch in self.levels(features[:, rare], leaf):
                p[rare] += _log_choice(self.word_weights, rows, np.take(bias, node, axis=0), branch)
        p[rare] += np.log10((counts[rare] + SMOOTHING) / self.leaves[leaf])
        return p


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` hashes stand in the sorted ``keys``, all of which are there: by their leading bits, then step by step."""
    bits = np.uint64(max(len(keys).bit_length(), 1))
    head = np.searchsorted(keys, np.arange(1 << int(bits), dtype=np.uint64) << (np.uint64(64) - bits))
    at = head[(wanted >> (np.uint64(64) - bits)).astype(np.int64)]
    short = np.flatnonzero(keys[at] < wanted)
    while len(short):
        at[short] += 1
        short = short[keys[at[short]] < wanted[short]]
    return at


def history_features(tokens: np.ndarray, starts: np.ndarray, bits: int = FEATURE_BITS) -> np.ndarray:
    """[3, tokens] hashed features: word before, pair before, skip word; texts begin at ``starts``."""
    one = np.empty_like(tokens)
    one[1:] = tokens[:-1]
    one[starts] = np.uint64(1)
    two = np.empty_like(tokens)
    two[1:] = one[:-1]
    two[starts] = np.uint64(2)
    down = np.uint64(64 - bits)
    pair = (one * _A) ^ (two * _B)
    return np.stack([((one ^ _B) * _A) >> down, ((pair ^ pair >> np.uint64(29)) * _A) >> down, ((two ^ _A) * _B) >> down]).astype(np.int64)


class Trainer:
    """AdaGrad over mini-batches, on one task's copy of the weights."""

    def __init__(self, model: Model):
        self.m = model
        self.g_class = np.full_like(model.class_weights, 1e-6)
        self.g_word = np.full_like(model.word_weights, 1e-6)
        self.seen = 0

    @staticmethod
    def _step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        """One update from the gradient of each example ([columns, examples]), added up by feature row ([3, examples])."""
        if len(weights) <= rows.size:  # examples share rows: sums over all rows, a column at a time; a sum of 0 moves nothing
            sums = np.empty((len(gradient), len(weights)), np.float32)
            total = np.empty(len(weights))
            for own, column in zip(sums, gradient):
                column = column.astype(np.float64)
                total.fill(0)
                for at in rows:
                    np.add.at(total, at, column)
                own[:] = total
            for a in range(0, len(weights), CHUNK):
                Trainer._move(weights, squares, slice(a, a + CHUNK), np.ascontiguousarray(sums[:, a : a + CHUNK].T))
            return
        rows, gradient = rows.ravel(), np.ascontiguousarray(gradient.T)
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # 16 bits at a time: a radix sort
        if len(weights) > 1 << 16:
            order = order[np.argsort((rows[order] >> 16).astype(np.uint16), kind="stable")]
        sorted_rows = rows[order]
        first = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
        order %= len(gradient)
        total = gradient[order[first]]
        times = np.diff(first, append=len(order))
        several = np.flatnonzero(times > 1)  # rows with one example need no sum
        if len(several):
            n = times[several]
            begin = np.cumsum(n) - n
            total[several] = np.add.reduceat(gradient[order[np.repeat(first[several] - begin, n) + np.arange(n.sum())]], begin, axis=0)
        Trainer._move(weights, squares, sorted_rows[first], total)

    @staticmethod
    def _move(weights: np.ndarray, squares: np.ndarray, at: np.ndarray | slice, total: np.ndarray) -> None:
        """The AdaGrad step of some rows from their summed gradients."""
        s = total * total
        s += squares[at]
        squares[at] = s
        np.sqrt(s, out=s)
        total /= s
        total *= STEP
        weights[at] -= total

    def learn(self, tokens: np.ndarray, starts: np.ndarray) -> None:
        """Steps over mini-batches of BATCH tokens; the gradients of one are found CHUNK tokens at a time."""
        m = self.m
        features, ranks = history_features(tokens, starts, m.bits), m.ranks(tokens)
        for a in range(0, len(tokens), BATCH):
            f, r, t = features[:, a : a + BATCH], ranks[a : a + BATCH], tokens[a : a + BATCH]
            frequent, rare = np.flatnonzero(r < CLASSES * WIDTH), np.flatnonzero(r == CLASSES * WIDTH)
            own = r // WIDTH
            self._update(m.class_weights, self.g_class, f, own, lambda c: m.class_bias)
            if len(frequent):
                own = own[frequent]
                rows = (f[:, frequent] + own * 7919) & (len(m.word_weights) - 1)
                self._update(m.word_weights, self.g_word, rows, r[frequent] % WIDTH, lambda c: np.take(m.word_bias, own[c], axis=0))
            if len(rare) and m.branch_bias:
                f = f[:, rare]
                for rows, bias, node, branch in m.levels(f, _leaf(t[rare], len(m.branch_bias))):
                    self._update(m.word_weights, self.g_word, rows, branch, lambda c: np.take(bias, node[c], axis=0))
            self.seen += len(r)

    def _update(self, weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, chosen: np.ndarray, bias) -> None:
        """One step of one softmax towards the choices made; ``bias`` gives the biases of a slice of the examples."""
        gradient = np.empty((weights.shape[1], len(chosen)), np.float32)
        for a in range(0, len(chosen), CHUNK):
            c = slice(a, a + CHUNK)
            z = _softmax(weights, rows[:, c], bias(c))
            z[np.arange(len(z)), chosen[c]] -= 1
            gradient[:, c] = z.T
        self._step(weights, squares, rows, gradient)


def _blob(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a, np.float32).tobytes(), 1)


def _train_round(docs: DataFrame, model: Model, shards: int, scratch: Scratch, name: str) -> Model:
    """Local steps over all rows of ``docs`` by shard, then the average of the shards' weights by tokens seen."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 132 bytes a feature row, 8 a leaf: 400 MB at most

    def body(slices):
        m = shared.value
        local, shard, pending, held = None, None, [], 0

        def learn() -> None:
            nonlocal pending, held
            if pending:
                sizes = np.fromiter(map(len, pending), np.int64, len(pending))
                local.learn(np.concatenate(pending), np.cumsum(sizes) - sizes)
            pending, held = [], 0

        def close():
            learn()
            change = np.concatenate(((local.m.class_weights - m.class_weights).ravel(), (local.m.word_weights - m.word_weights).ravel())) * local.seen
            yield {"shard": [shard] * SLICES, "slice": list(range(SLICES)), "seen": [local.seen] * SLICES, "blob": [_blob(c) for c in np.array_split(change, SLICES)]}

        for part in slices:
            for own, text in zip(part["shard"], part["text"]):
                if own != shard:
                    if local is not None:
                        yield from close()
                    shard, local = own, Trainer(replace(m, class_weights=m.class_weights.copy(), word_weights=m.word_weights.copy()))
                pending.append(tokens_of(text))
                held += len(pending[-1])
                if held >= BATCH:  # batches depend on the shard's documents alone
                    learn()
        if local is not None:
            yield from close()

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        total = sum(np.frombuffer(zstandard.decompress(b.as_py()), np.float32).astype(np.float64) for b in table.column("blob"))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py() // FAN_IN], pa.int64()), "slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "seen": pa.array([sum(table.column("seen").to_pylist())], pa.int64()), "blob": [_blob(total)]})

    schema = "shard long, slice int, seen long, blob binary"
    order = F.xxhash64("doc_id", "text")
    dealt = docs.select(F.pmod(F.xxhash64(order), F.lit(shards)).alias("shard"), order.alias("o"), "text")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "o")
    sums = scratch.keep(map_slices(dealt, schema, {"shard": "shard", "text": "text"}, body), name)
    while True:  # each level is a table, so that neither the one before nor its shuffle files stay
        sums = scratch.keep(sums.groupBy("slice", F.floor(F.col("shard") / FAN_IN).alias("group")).applyInArrow(add, schema), f"{name}-{shards}")
        scratch.drop(name)
        shards, name = -(-shards // FAN_IN), f"{name}-{shards}"
        if shards <= 1:
            break
    found = sorted(sums.collect(), key=lambda r: r["slice"])  # SLICES parts of one set of weights
    if found:
        change = np.concatenate([np.frombuffer(zstandard.decompress(r["blob"]), np.float32) for r in found]) / found[0]["seen"]
        cut = model.class_weights.size
        model.class_weights += change[:cut].reshape(model.class_weights.shape)
        model.word_weights += change[cut:].reshape(model.word_weights.shape)
    return model


def _blocks(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, block): a block is a run of rows of one file, so a task that scans has whole blocks.

    Texts of up to BLOCK_TEXT bytes come BLOCK_ROWS rows to a block, texts of
    twice that size half as many, and so on; so no block has more than BLOCK_ROWS
    times BLOCK_TEXT bytes but one that is a single text.
    """
    numbered, names = number_columns(docs)
    own = [F.col(names[id_col]).alias("doc_id"), F.col(names[text_col]).cast("binary").alias("text")]
    times = F.ceil(F.log2(F.octet_length("text") / F.lit(BLOCK_TEXT)))
    level = F.least(F.greatest(F.coalesce(times, F.lit(0)), F.lit(0)), F.lit(BLOCK_ROWS.bit_length() - 1)).cast("int")
    place = F.xxhash64("file", "level", F.floor(F.col("row") * F.pow(F.lit(2.0), "level") / BLOCK_ROWS))
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        rows = numbered.select(*own, *where)
    except AnalysisException:  # no scan of files: write the two columns first
        rows = scratch.keep(numbered.select(*own), "rows").select("doc_id", "text", *where)
    return rows.withColumn("level", level).select("doc_id", "text", place.alias("block"))


def _block_words(rows: DataFrame) -> DataFrame:
    """(block, h, c): the distinct tokens of each block's rows in this task with their training counts."""

    def body(slices):
        held: dict[int, list] = {}
        size = 0

        def flush():
            nonlocal held, size
            for block, parts in held.items():
                tokens = np.concatenate([p for p, _ in parts])
                train = np.repeat([t for _, t in parts], [len(p) for p, _ in parts])
                h, place = np.unique(tokens, return_inverse=True)
                c = np.bincount(place, train, len(h)).astype(np.int64)
                yield {"block": np.full(len(h), block, np.int64), "h": h.view(np.int64), "c": c}
            held, size = {}, 0

        for part in slices:
            for block, text, train in zip(part["block"], part["text"], part["train"]):
                tokens = tokens_of(text)
                held.setdefault(block, []).append((tokens, train))
                size += len(tokens)
            if size > 4_000_000:
                yield from flush()
        yield from flush()

    return map_slices(rows, "block long, h long, c long", {"block": "block", "text": "text", "train": "train"}, body)


def _most_frequent(counts: DataFrame, k: int) -> list[tuple[int, int]]:
    """The k most frequent (h, c), most frequent first, ties by hash; a histogram over powers of two bounds what is collected."""
    if k <= 0:
        return []
    powers = {r["p"]: r["n"] for r in counts.where("c > 0").groupBy(F.floor(F.log2("c") * 4).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    got, low = 0, None
    for p in sorted(powers, reverse=True):
        got, low = got + powers[p], p
        if got >= k:
            break
    if low is None:
        return []
    best = counts.where((F.col("c") > 0) & (F.floor(F.log2("c") * 4) >= low)).orderBy(F.desc("c"), "h").limit(k)
    return [(r["h"], r["c"]) for r in best.select("h", "c").collect()]


def _leaf_totals(counts: DataFrame, depth: int) -> np.ndarray:
    """Sum of c + SMOOTHING of the learned words of each leaf; the parts come as arrays of one leading byte each."""
    if not depth:
        return np.array([counts.where("c > 0").agg(F.coalesce(F.sum(F.col("c") + SMOOTHING), F.lit(0.0))).first()[0]])
    cut = max(WIDTH**depth // 256, 1)

    def leaves(slices):
        for part in slices:
            h = np.array(part["h"], np.int64).view(np.uint64)
            yield {"leaf": _leaf(h, depth), "c": part["c"]}

    def add(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf").to_numpy()
        total = np.bincount(leaf % cut, table.column("c").to_numpy() + SMOOTHING, cut)
        return pa.table({"part": pa.array([int(leaf[0]) // cut], pa.int64()), "blob": [zstandard.compress(total.tobytes(), 1)]})

    placed = map_slices(counts.where("c > 0"), "leaf long, c long", {"h": "h", "c": "c"}, leaves)
    parts = placed.groupBy(F.floor(F.col("leaf") / cut).alias("part")).applyInArrow(add, "part long, blob binary").collect()
    out = np.zeros(WIDTH**depth)
    for r in parts:
        out[r["part"] * cut : (r["part"] + 1) * cut] = np.frombuffer(zstandard.decompress(r["blob"]))
    return out


def lm_score(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says which rows are learned from, as a condition on ``doc_id`` (null:
    not).  A null or empty text is the end token alone.  Words are told apart by
    64-bit hashes.  Without training rows every count is 0: base_score is 0 for
    each token (0.1 over 0.1) and the model is uniform over its classes.  Repeated
    rows are counted and scored each; null ids are carried; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _blocks(docs, scratch, id_col, text_col).withColumn("train", F.coalesce(train, F.lit(False)))

    words = scratch.keep(_block_words(rows), "words")
    totals = scratch.keep(words.groupBy("h").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("blocks")), "totals")
    heavy = totals.where(F.col("blocks") > BLOCKS_OF_A_WORD).select("h", F.ceil(F.col("blocks") / BLOCKS_OF_A_WORD).cast("long").alias("parts"))
    heavy = scratch.keep(heavy, "heavy")
    leads = totals.select("h", "c")
    counted = dealt_join(words.select("block", "h"), leads, ["h"], None if heavy.isEmpty() else bounded(heavy), F.col("block"))
    n, v = leads.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    depth, bits = sizes_of(n, v)
    model = Model.start(_most_frequent(leads, CLASSES * WIDTH), n, v, _leaf_totals(leads, depth), bits)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))
    shards = -(-n // max(SHARD_TOKENS, SHARD_ROW_TOKENS << bits)) or 1
    for k in range(ROUNDS):
        model = _train_round(rows.where(F.col("train") & (part == k)).select("doc_id", "text"), model, shards, scratch, f"round{k}")
    shared = spark.sparkContext.broadcast(model)
    floor = SMOOTHING / (n + SMOOTHING * (v + 1))

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        m = shared.value
        keys = known.column("h").to_numpy().view(np.uint64)
        values = known.column("c").to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        ids = texts.column("doc_id")
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        at, column = 0, texts.column("text")
        while at < len(column):
            batch, size = [], 0
            while at < len(column) and size < 4 * BATCH:
                batch.append(tokens_of(column[at].as_py()))
                size += len(batch[-1])
                at += 1
            tokens = np.concatenate(batch)
            sizes = np.fromiter(map(len, batch), np.int64, len(batch))
            starts = np.cumsum(sizes) - sizes
            c = values[places(keys, tokens)].astype(np.float64)
            features, ranks = history_features(tokens, starts, m.bits), m.ranks(tokens)
            own = np.concatenate([m.log10(features[:, a : a + BATCH], ranks[a : a + BATCH], c[a : a + BATCH], tokens[a : a + BATCH]) for a in range(0, len(tokens), BATCH)])
            base = np.log10((c + SMOOTHING) * (floor / SMOOTHING))
            out["n_tokens"] += sizes.tolist()
            out["n_known"] += np.add.reduceat((c > 0).astype(np.int64), starts).tolist()
            out["base_score"] += [math.fsum(base[s : s + k]) for s, k in zip(starts, sizes)]
            out["score"] += np.add.reduceat(own, starts).tolist()
        return pa.table({"doc_id": ids, "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64())})

    left = rows.select("doc_id", "text", "block").groupBy("block")
    right = counted.select("block", "h", "c").groupBy("block")
    scored = left.cogroup(right).applyInArrow(score, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_part(F.col("doc_id"), 10) == 0
    scored = lm_score(documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
