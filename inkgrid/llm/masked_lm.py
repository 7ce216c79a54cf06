"""LM scoring by masked pseudo-likelihood.

A small network in numpy predicts each word from the two before and the two after it: embeddings,
one tanh layer, and a softmax over classes of entries followed by one over the entries of the class, so
probabilities are exact and sum to one. The most frequent words have an entry each; all other words of
the corpus share ``hashed`` entries, and such a word has the probability of its entry times its share
of the entry's occurrences in the whole corpus, so every word of the corpus has a probability of its own.
A text's score is the sum of log P(word | both sides) over all its words; ``mean_score`` divides by
their number.

Passes over all texts: word counts (summed by word before and after the shuffle), from which entries
and shares are taken and which grow with the corpus; ``rounds`` of training, each over its share of
the positions, all positions together; and scoring. Training texts travel as entry numbers, dealt to
shards by a hash of row and text: a shard of about ``2^20`` words (more if there would be over
``_SHARDS`` of them) starts from the common weights and learns from its texts in the order of the hash, and
weights are averaged by number of positions. Number and content of shards depend on the data alone,
so results do not depend on partitioning. Shares are joined by word, not broadcast; the driver holds the
entries and one set of weights (bounded by ``size``).

Null and empty texts, and texts without words, have 0 words, score 0.0 and a null mean; very long texts
are handled whole, one in a task. Repeated rows and rows with a null id count and are scored each for
itself. A word that the fitted corpus lacks counts as half an occurrence in all. With an empty table
there is nothing to learn and the result is empty. A kept column with the name of an outcome gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table, text_or_empty
from .memory import task
from .textkit import mix, utf8_chunks, word_hashes

SIDES = (-2, -1, 1, 2)
MEMBERS = 32


@dataclass
class Vocabulary:
    """Sorted hashes of the known words and their ids; other words share the ids from ``known`` to ``size``."""

    hashes: np.ndarray
    ids: np.ndarray
    size: int

    def lookup(self, words: np.ndarray) -> np.ndarray:
        known = len(self.hashes)
        out = known + (words % np.uint64(self.size - known)).astype(np.int64)
        if known:
            at = np.minimum(np.searchsorted(self.hashes, words), known - 1)
            hit = self.hashes[at] == words
            out[hit] = self.ids[at[hit]]
        return out


def _exponentials(logits: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row's logits, less their maximum where they could overflow, and the sums of the rows. Inputs are at most
    1 in size (tanh), so the weights bound the logits. Changes ``logits`` by what it takes off."""
    if np.abs(weights).sum(axis=0).max() + np.abs(bias).max() > 40:
        logits -= logits.max(axis=1, keepdims=True)
    out = np.exp(logits)
    return out, out @ np.ones(out.shape[1], out.dtype)


class Network:
    """Weights in one flat float32 vector, with named views."""

    def __init__(self, size: int, dims: int = 8, hidden: int = 16, weights: np.ndarray | None = None, seed: int = 5):
        self.size, self.dims, self.hidden, self.classes = size, dims, hidden, size // MEMBERS
        shapes = {"embed": (size + 1, dims), "mixing": (len(SIDES) * dims, hidden), "bias": (hidden,), "to_class": (hidden, self.classes), "class_bias": (self.classes,), "to_word": (self.classes, hidden, MEMBERS), "word_bias": (self.classes, MEMBERS)}
        total = sum(int(np.prod(s)) for s in shapes.values())
        if weights is None:
            rng = np.random.Generator(np.random.PCG64(seed))
            weights = (rng.standard_normal(total) * 0.1).astype(np.float32)
        self.weights = weights
        self.views, at = {}, 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            self.views[name] = weights[at : at + n].reshape(shape)
            at += n

    def _hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.views
        x = v["embed"][context].reshape(len(context), -1)
        return x, np.tanh(x @ v["mixing"] + v["bias"])

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        v = self.views
        _, h = self._hidden(context)
        group, member = np.divmod(target, MEMBERS)
        logits = h @ v["to_class"] + v["class_bias"]
        _, total = _exponentials(logits, v["to_class"], v["class_bias"])
        out = logits[np.arange(len(target)), group] - np.log(total)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(self.classes + 1))
        for g in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[g] : cuts[g + 1]]
            inner = h[rows] @ v["to_word"][g] + v["word_bias"][g]
            _, total = _exponentials(inner, v["to_word"][g], v["word_bias"][g])
            out[rows] += inner[np.arange(len(rows)), member[rows]] - np.log(total)
        return out.astype(np.float64)

    def step(self, context: np.ndarray, target: np.ndarray, memory: np.ndarray, rate: float) -> None:
        """One Adagrad step on the mean loss of a batch; ``memory`` holds the squared gradients."""
        v, n = self.views, len(target)
        x, h = self._hidden(context)
        group, member = np.divmod(target, MEMBERS)
        grad = Network(self.size, self.dims, self.hidden, np.zeros_like(self.weights))
        d = grad.views
        logits = h @ v["to_class"] + v["class_bias"]
        p, total = _exponentials(logits, v["to_class"], v["class_bias"])
        p /= total[:, None]
        p[np.arange(n), group] -= 1
        d["to_class"][:] = h.T @ p
        d["class_bias"][:] = p.sum(axis=0)
        dh = p @ v["to_class"].T
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(self.classes + 1))
        for g in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[g] : cuts[g + 1]]
            inner = h[rows] @ v["to_word"][g] + v["word_bias"][g]
            q, total = _exponentials(inner, v["to_word"][g], v["word_bias"][g])
            q /= total[:, None]
            q[np.arange(len(rows)), member[rows]] -= 1
            d["to_word"][g] = h[rows].T @ q
            d["word_bias"][g] = q.sum(axis=0)
            dh[rows] += q @ v["to_word"][g].T
        da = dh * (1 - h * h)
        d["mixing"][:] = x.T @ da
        d["bias"][:] = da.sum(axis=0)
        dx = (da @ v["mixing"].T).reshape(-1, self.dims)
        flat = context.ravel()
        for k in range(self.dims):
            d["embed"][:, k] = np.bincount(flat, dx[:, k], self.size + 1)
        g = grad.weights / n
        memory += g * g
        self.weights -= rate * g / (np.sqrt(memory) + 1e-6)


def windows(words: np.ndarray, counts: np.ndarray, outside: int, at: np.ndarray | None = None) -> np.ndarray:
    """(word, side) ids around every word, or around those ``at`` places; ``outside`` stands beyond the ends of a text."""
    reach = max(SIDES)
    moved = np.repeat(np.arange(reach, reach * len(counts), reach, dtype=np.int32), np.diff(counts))
    moved += np.arange(len(words), dtype=np.int32)
    padded = np.full(len(words) + reach * len(counts), outside, np.int32)
    padded[moved] = words
    if at is not None:
        moved = moved[at]
    out = np.empty((len(moved), len(SIDES)), np.int32)
    for k, side in enumerate(SIDES):
        np.take(padded, moved + np.int32(side), out=out[:, k])
    return out


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n of all words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(words, kind="stable")
            words, n = words[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
            return words[first], np.add.reduceat(n, first)

        def rows() -> Iterator[pa.RecordBatch]:
            words, n = merged()
            held.clear()
            for lo in range(0, len(words), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + (1 << 17)].view(np.int64)), pa.array(n[lo : lo + (1 << 17)])], names=["word", "n"])

        for batch in batches:
            for _, _, buf, offsets in utf8_chunks(batch.column("_text")):
                words, _ = word_hashes(buf, offsets)
                if len(words):
                    words = np.sort(words)
                    first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
                    held.append((words[first], np.diff(np.append(first, len(words)))))
                if len(held) >= 32:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1 << 21:
                        yield from rows()
        if held:
            yield from rows()

    texts = documents.select(F.lower(text_or_empty()).alias("_text"))
    return texts.mapInArrow(task("masked_lm")(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_vocabulary(counts: DataFrame, size: int, hashed: int) -> Vocabulary:
    """The ``size - hashed`` most frequent words, ties by hash."""
    top = counts.orderBy(F.desc("n"), "word").limit(size - hashed).select("word").toArrow().column("word").to_numpy().view(np.uint64)
    order = np.argsort(top)
    return Vocabulary(top[order], order.astype(np.int64), size)


def entry_shares(counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """word, log_share of every word without an entry of its own: its part of the occurrences of its entry."""
    spark = counts.sparkSession
    known = spark.createDataFrame(pa.table({"word": vocabulary.hashes.view(np.int64)}))
    rest = counts.join(F.broadcast(known), "word", "left_anti")  # bounded by size
    rest = rest.withColumn("entry", F.col("word").bitwiseAND(vocabulary.size - len(vocabulary.hashes) - 1))
    whole = rest.groupBy("entry").agg(F.sum("n").alias("whole"))
    return rest.join(F.broadcast(whole), "entry").select("word", F.ln(F.col("n") / F.col("whole")).alias("log_share"))  # a row an entry


_PARTS, _SHARDS, _SHARD_WORDS = 64, 4096, 1 << 20
_NUMBERED = "key long, ids binary"
_STRIDE = np.uint64(0x9E3779B97F4A7C15)


def numbered(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """key (hash of doc_id, if there is one, and text), ids (entries of the words, little-endian) of the texts with words."""
    kind = np.dtype("<u2") if vocabulary.size < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, offsets in utf8_chunks(batch.column("_text")):
                words, counts = word_hashes(buf, offsets)
                data = pa.py_buffer(vocabulary.lookup(words).astype(kind).tobytes())
                ends = pa.py_buffer((counts * kind.itemsize).astype(np.int64).tobytes())
                lists = pa.Array.from_buffers(pa.large_binary(), last - first, [None, ends, data])
                part = pa.RecordBatch.from_arrays([batch.column("key").slice(first, last - first), lists.cast(pa.binary())], names=["key", "ids"])
                yield part.filter(pa.array(np.diff(counts) > 0))

    key = F.xxhash64(*[F.col(c) for c in documents.columns if c == "doc_id"], "text")
    return documents.select(key.alias("key"), F.lower(text_or_empty()).alias("_text")).mapInArrow(task("masked_lm")(run), _NUMBERED)


def train_round(texts: DataFrame, size: int, shards: int, weights: np.ndarray, number: int, rounds: int, batch_size: int, rate: float) -> np.ndarray:
    """Mean of the weights that the shards arrive at, each weighted by its number of positions."""
    kind = "<u2" if size < 1 << 16 else "<u4"
    names = ["piece", "shard", "seen", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, net, memory, seen = None, None, None, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def learn(last: bool) -> None:
            """Batches of one length, whatever the pieces in which the texts arrive."""
            c, t = (np.concatenate(x) for x in zip(*held, strict=True))
            upto = len(t) if last else len(t) - len(t) % batch_size
            for lo in range(0, upto, batch_size):
                net.step(c[lo : min(lo + batch_size, upto)], t[lo : min(lo + batch_size, upto)], memory, rate)
            held[:] = [(c[upto:], t[upto:])]

        def close() -> pa.RecordBatch:
            learn(True)
            pieces = np.array_split(net.weights.astype(np.float64) * seen, _PARTS)
            return pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([shard] * _PARTS, pa.int64()), pa.array([seen] * _PARTS, pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=names)

        for batch in batches:
            own, keys = batch.column("shard").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            data = batch.column("ids").to_pylist()
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if own[a] != shard:
                    if seen:
                        yield close()
                    shard, net, memory, seen = int(own[a]), Network(size, weights=weights.copy()), np.full_like(weights, 1e-4 * (1 + 9 * number)), 0
                    held.clear()
                for lo in range(a, b, 512):
                    part = data[lo : min(lo + 512, b)]
                    ids = np.frombuffer(b"".join(part), kind).astype(np.int64)
                    counts = np.concatenate(([0], np.cumsum([len(x) // np.dtype(kind).itemsize for x in part])))
                    # place in the text, and key, in one number
                    start = keys[lo : lo + len(part)] - counts[:-1].astype(np.uint64) * _STRIDE
                    turn = mix(np.repeat(start, np.diff(counts)) + np.arange(len(ids), dtype=np.uint64) * _STRIDE) >> np.uint64(32)
                    masked = np.flatnonzero(turn % np.uint64(rounds) == number)
                    held.append((windows(ids, counts, size, masked), ids[masked]))
                    seen += len(masked)
                    if sum(len(t) for _, t in held) >= 4 * batch_size:
                        learn(False)
        if seen:
            yield close()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for piece, seen, data in zip(batch.column("piece").to_pylist(), batch.column("seen").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                own = totals.setdefault(piece, [0, 0.0])
                own[0] += seen
                own[1] = own[1] + np.frombuffer(data)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t[0] for t in totals.values()], pa.int64()), pa.array([t[1].tobytes() for t in totals.values()], pa.binary())], names=["piece", "seen", "sums"])

    placed = texts.withColumn("shard", F.pmod("key", F.lit(shards))).repartition("shard").sortWithinPartitions("shard", "key", "ids")
    learnt = placed.mapInArrow(task("masked_lm")(run), "piece int, shard long, seen long, sums binary")
    summed = learnt.repartition("piece").sortWithinPartitions("piece", "shard").mapInArrow(task("masked_lm")(add), "piece int, seen long, sums binary").toArrow().sort_by("piece")
    if not summed.num_rows:
        return weights
    return np.concatenate([np.frombuffer(d.as_py()) / n.as_py() for d, n in zip(summed.column("sums"), summed.column("seen"), strict=True)]).astype(np.float32)


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    shares: DataFrame
    words: int


def fit(documents: DataFrame, size: int = 2048, hashed: int = 256, rounds: int = 2, batch_size: int = 8192, rate: float = 0.3) -> Model:
    if size % MEMBERS or not 0 < hashed <= size or hashed & (hashed - 1):
        raise ValueError(f"size must be a multiple of {MEMBERS}, hashed a power of two and not over size")
    counts = materialize(word_counts(documents), "counts")
    words = counts.agg(F.sum("n")).first()[0] or 0
    vocabulary = build_vocabulary(counts, size, hashed)
    shares = materialize(entry_shares(counts, vocabulary), "shares")
    texts = materialize(numbered(documents, vocabulary), "numbered")
    shards = max(1, min(_SHARDS, -(-words // _SHARD_WORDS)))
    weights = Network(size).weights
    for number in range(rounds):
        weights = train_round(texts, size, shards, weights, number, rounds, batch_size, rate)
    return Model(vocabulary, weights, shares, words)


_OUTCOME = ["n_tokens", "score", "mean_score"]
_RARE = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.IntegerType())]))


def score_documents(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_tokens, score, mean_score."""
    boxed = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    texts = documents.select(boxed.alias("row"), F.lower(text_or_empty()).alias("_text"))
    schema = T.StructType([texts.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("known", T.DoubleType()), T.StructField("rare", _RARE)])
    vocabulary, weights = model.vocabulary, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(vocabulary.size, weights=weights)
        for batch in batches:
            for first, last, buf, offsets in utf8_chunks(batch.column("_text")):
                words, counts = word_hashes(buf, offsets)
                ids = vocabulary.lookup(words)
                around = windows(ids, counts, vocabulary.size)
                logs = [net.log_probability(around[lo : lo + 32768], ids[lo : lo + 32768]) for lo in range(0, len(ids), 32768)]
                before = np.concatenate(([0.0], np.cumsum(np.concatenate(logs) if logs else [])))
                n = np.diff(counts)
                # words without an entry of their own, once a text
                rare = np.flatnonzero(ids >= len(vocabulary.hashes))
                owner, word = np.repeat(np.arange(len(n)), n)[rare], words[rare]
                order = np.lexsort((word, owner))
                owner, word = owner[order], word[order]
                new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])))[: len(word)])
                times = np.diff(np.append(new, len(word))).astype(np.int32)
                ends = np.searchsorted(owner[new], np.arange(len(n) + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(word[new].view(np.int64)), pa.array(times)], names=["word", "n"])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, last - first), pa.array(n), pa.array(before[counts[1:]] - before[counts[:-1]]), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=schema.names)

    scored = materialize(texts.mapInArrow(task("masked_lm")(run), schema).withColumn("at", F.monotonically_increasing_id()), "scored")
    lacking = float(np.log(0.5 / max(model.words, 1)))
    each = scored.select("at", F.explode("rare").alias("x")).select("at", "x.word", "x.n").join(model.shares, "word", "left")
    added = each.groupBy("at").agg(F.sum(F.col("n") * F.coalesce("log_share", F.lit(lacking))).alias("added"))
    score = F.col("known") + F.coalesce("added", F.lit(0.0))
    out = scored.select("row", "n_tokens", "known", "at").join(added, "at", "left").select("row", "n_tokens", score.alias("score"), F.when(F.col("n_tokens") > 0, score / F.col("n_tokens")).alias("mean_score"))
    return out.select(*[F.col(f"row.`{c}`") for c in keep if c not in _OUTCOME], *_OUTCOME)


def op4_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score_documents(documents, fit(documents), ["doc_id"])
