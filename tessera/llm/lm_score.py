"""Masked pseudo-likelihood: a bidirectional window network predicts every word from the words on both its sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import M1, Adam, mix, only, removed, text_views, trimmed, written
from tessera.llm.ngram_join import word_hashes

SIDES = (-2, -1, 1, 2)
GROUPS, WIDTH = 32, 32  # a class is one of WIDTH in one of GROUPS
CLASSES = GROUPS * WIDTH
BUCKETS = CLASSES // 4  # the last classes: hash buckets of all words but the most frequent ones
NAMED = CLASSES - BUCKETS
EDGE = CLASSES  # what stands beyond the ends of a text


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts in a row, and how many each has."""
    parts = [word_hashes(data[off[i] : off[i + 1]]) for i in range(len(off) - 1)]
    return np.concatenate(parts).view(np.int64), np.array([len(p) for p in parts], np.int64)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, combined for every 32 MB of text."""
    held, size = [], 0

    def combined() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])

    for batch in batches:
        for _, data, off in text_views(batch):
            held.append(words_of(data, off)[0])
            size += len(data)
            if size > 32 << 20:
                yield combined()
                held, size = [], 0
    yield combined()


class Places:
    """The places of known longs: a hash table with open addressing, built and asked array by array."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(4 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self.slots(keys)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]  # of several, the last one gets the slot
            out = self.table[at] != left
            left, at = left[out], (at[out] + 1) & (len(self.table) - 1)

    def slots(self, w: np.ndarray) -> np.ndarray:
        return ((w.view(np.uint64) * M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, w: np.ndarray) -> np.ndarray:
        """The place of each long, -1 where it isn't known."""
        out, left, at = np.full(len(w), -1, np.int32), np.arange(len(w)), self.slots(w)
        while len(left):
            k = self.table[at]
            there = np.flatnonzero(k >= 0)
            k, left, at = k[there], left[there], at[there]
            hit = self.keys[k] == w[left]
            out[left[hit]] = k[hit]
            left, at = left[~hit], (at[~hit] + 1) & (len(self.table) - 1)
        return out


class Vocabulary:
    """The class of every word and the log-probability of the word in its class, from counts over the whole corpus.

    The words of the head are known one by one. Other words are taken as seen once; rare() and score() add the logarithm of
    their own counts by a join.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, tail: dict[int, int]):
        self.places, n = Places(words), counts.astype(np.float64)
        self.klass = (NAMED + bucket(words)).astype(np.int16)
        top = np.lexsort((words, -n))[:NAMED]
        self.klass[top] = np.arange(len(top))
        total = np.full(CLASSES, 1e-9)
        np.add.at(total, self.klass, n)
        for b, mass in tail.items():
            total[NAMED + b] += mass
        self.total = total
        self.inside = np.minimum(np.log(n / total[self.klass]), 0.0)
        self.tail = np.minimum(-np.log(np.maximum(total[NAMED:], 1.0)), 0.0)

    def look_up(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, log-probabilities in them, and where words outside the head are."""
        at = self.places.of(w)
        new = np.flatnonzero(at < 0)
        klass, inside = (x.take(at) if len(x) else np.zeros(len(w), x.dtype) for x in (self.klass, self.inside))
        b = bucket(w[new])
        klass[new], inside[new] = (NAMED + b).astype(np.int16), self.tail[b]
        return klass, inside, new


def bucket(w: np.ndarray) -> np.ndarray:
    return (mix(w.view(np.uint64) + np.uint64(77)) % np.uint64(BUCKETS)).astype(np.int64)


def contexts(klass: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For every word the classes on both sides, EDGE beyond its text."""
    far = max(map(abs, SIDES))
    at = np.arange(far, len(klass) + far) + far * np.repeat(np.arange(len(counts)), counts)  # texts with room between them
    line = np.full(len(klass) + far * (len(counts) + 2), EDGE, np.int16)
    line[at] = klass
    return np.stack([line.take(at + k) for k in SIDES], 1)


class WindowNet:
    """tanh of the sum of the sides' embeddings (one table for each side), then a softmax over groups and one over the classes
    of the word's group: both together are a distribution over all classes."""

    def __init__(self, hidden: int = 16, seed: int = 9):
        r = np.random.default_rng(seed)
        self.p = {"emb": r.normal(0, 0.1, (len(SIDES), CLASSES + 1, hidden)), "h": np.zeros(hidden), "top": r.normal(0, 0.1, (hidden, GROUPS)), "top0": np.zeros(GROUPS), "low": r.normal(0, 0.1, (GROUPS, hidden, WIDTH)), "low0": np.zeros((GROUPS, WIDTH))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def start(self, total: np.ndarray) -> "WindowNet":
        """From the classes' counts: without a context the network says their shares."""
        share = (total + 0.5).reshape(GROUPS, WIDTH)
        self.p["top0"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
        self.p["low0"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
        return self

    def hidden(self, c: np.ndarray) -> np.ndarray:
        z = self.p["emb"][0].take(c[:, 0], 0)
        for k in range(1, len(SIDES)):
            z += self.p["emb"][k].take(c[:, k], 0)
        z += self.p["h"]
        return np.tanh(z, out=z)

    def shares(self, h: np.ndarray, y: np.ndarray) -> tuple:
        """Both softmaxes (rows in the order of their groups), the order and the groups' ranges of rows in it."""
        order = np.argsort((y // WIDTH).astype(np.uint8), kind="stable")
        h, y = h[order], y[order]
        cuts = np.searchsorted(y // WIDTH, np.arange(GROUPS + 1))
        top, low = h @ self.p["top"] + self.p["top0"], np.empty((len(y), WIDTH), np.float32)
        for g in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[g], cuts[g + 1]
            np.matmul(h[a:b], self.p["low"][g], out=low[a:b])
            low[a:b] += self.p["low0"][g]
        if not self.small():
            for z in (top, low):
                z -= z.max(1, keepdims=True)
        return h, y, top, low, order, cuts

    def small(self) -> bool:
        """Whether no logit can be so large that its exponential overflows; hidden units are within -1 and 1."""
        most = [np.abs(self.p[w]).sum(-2).max() + np.abs(self.p[b]).max() for w, b in (("top", "top0"), ("low", "low0"))]
        return max(most) < 60

    def log_probs(self, c: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The log-probability of each class y in its context."""
        out = np.empty(len(y))
        for i in range(0, len(y), 8192):
            mine = y[i : i + 8192]
            _, sorted_, top, low, order, _ = self.shares(self.hidden(c[i : i + 8192]), mine)
            rows = np.arange(len(mine))
            p = top[rows, sorted_ // WIDTH].astype(np.float64) + low[rows, sorted_ % WIDTH]
            for z in (top, low):
                p -= np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))
            out[i + order] = p
        return np.minimum(out, 0.0)

    def gradient(self, c: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over these contexts and their classes."""
        h, y, top, low, order, cuts = self.shares(self.hidden(c), y)
        rows, n = np.arange(len(y)), len(y)
        for z, at in ((top, y // WIDTH), (low, y % WIDTH)):
            np.exp(z, out=z)
            z *= (1 / (n * (z @ np.ones(z.shape[1], np.float32))))[:, None]
            z[rows, at] -= np.float32(1 / n)
        dh = top @ self.p["top"].T
        grads = {"top": h.T @ top, "top0": top.sum(0), "low": np.zeros_like(self.p["low"]), "low0": np.zeros_like(self.p["low0"])}
        for g in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[g], cuts[g + 1]
            dh[a:b] += low[a:b] @ self.p["low"][g].T
            grads["low"][g], grads["low0"][g] = h[a:b].T @ low[a:b], low[a:b].sum(0)
        dh *= 1 - h * h
        emb = np.zeros_like(self.p["emb"])
        for k in range(len(SIDES)):
            side = c[order, k]
            by = np.argsort(side, kind="stable")
            side = side[by]
            first = np.flatnonzero(np.concatenate(([True], side[1:] != side[:-1])))
            emb[k][side[first]] = np.add.reduceat(dh[by], first, 0)
        return grads | {"h": dh.sum(0), "emb": emb}

    def steps(self, c: np.ndarray, y: np.ndarray, adam: Adam, r: np.random.Generator, size: int) -> None:
        for rows in np.array_split(r.permutation(len(y)), max(1, len(y) // size)):
            adam.step(self.gradient(c[rows], y[rows]))

    def packed(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def unpacked(self, flat: np.ndarray) -> "WindowNet":
        cuts = np.cumsum([v.size for v in self.p.values()])[:-1]
        self.p = {k: x.reshape(v.shape).astype(np.float32) for (k, v), x in zip(self.p.items(), np.split(flat, cuts))}
        return self


def trained(model, rate: float, size: int):
    """Training steps over all texts of a task, from the broadcast network: the parameters and how many words taught them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = model.value
        net, words = WindowNet().unpacked(flat), 0
        adam, r = Adam(net.p, rate), np.random.default_rng(12)
        for batch in batches:
            for _, data, off in text_views(batch, most=1 << 20):
                w, counts = words_of(data, off)
                if len(w):
                    klass = vocabulary.look_up(w)[0]
                    net.steps(contexts(klass, counts), klass, adam, r, size)
                    words += len(w)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([net.packed().tobytes()]), pa.array([words])], ["p", "words"])

    return run


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of networks, each weighted by its words."""
    total, words = np.float64(0.0), 0
    for batch in batches:
        for p, n in zip(batch.column("p"), batch.column("words").to_pylist()):
            total, words = total + n * np.frombuffer(p.as_py(), np.float32).astype(np.float64), words + n
    if words:
        yield pa.RecordBatch.from_arrays([pa.array([(total / words).astype(np.float32).tobytes()]), pa.array([words])], ["p", "words"])


def taught_by_all(rows: DataFrame, vocabulary: Vocabulary, net: WindowNet, rounds: int, rate: float, size: int) -> WindowNet:
    """The network after every word of every text has taught it once. A hash deals the documents to rounds; in a round each
    task trains a copy of the network on its texts, and the mean of the copies, weighted by their words, goes into the next
    round. Copies are averaged in 32 tasks first, so that what the driver gets doesn't grow with the tasks.
    """
    kind = "p binary, words long"
    turn = F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(rounds))
    for k in range(rounds):
        model = rows.sparkSession.sparkContext.broadcast((vocabulary, net.packed()))
        copies = rows.where(turn == k).select("text").mapInArrow(trimmed(trained(model, rate, size)), kind)
        means = copies.repartition(32).mapInArrow(trimmed(averaged), kind).toArrow()
        for out in averaged(iter(means.combine_chunks().to_batches())):
            net = WindowNet().unpacked(np.frombuffer(out.column("p")[0].as_py(), np.float32))
        model.destroy()
    return net


def learnt(docs: DataFrame, most_head: int, rounds: int, rate: float, size: int) -> tuple[Vocabulary, WindowNet | None, DataFrame, str]:
    """The vocabulary, from the words of all documents, and the network, from their classes' shares on taught by all documents.

    The head are the words with at least 1 / most_head of all occurrences: at most most_head of them, a proven bound. Also the
    counts of the other words that occur more than once, and the path of their table, for removed().
    """
    counts, path = written(docs.select("text").mapInArrow(trimmed(counted), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(2, -(-total // most_head))
    head = counts.where(F.col("n") >= least).toArrow()
    words, n = (head.column(c).to_numpy().astype(np.int64) for c in ("word", "n"))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = bucket(np.array(batch.column("word"), np.int64)) if len(batch) else np.zeros(0, np.int64)
            mass = np.bincount(b, np.asarray(batch.column("n")), BUCKETS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(mass)], ["b", "mass"])

    tail = {r["b"]: r["mass"] for r in counts.where(F.col("n") < least).mapInArrow(trimmed(tails), "b long, mass long").groupBy("b").agg(F.sum("mass").alias("mass")).collect()}
    others = counts.where((F.col("n") > 1) & (F.col("n") < least))
    vocabulary = Vocabulary(words, n, tail)
    if not total:
        return vocabulary, None, others, path
    rows = docs.where(F.octet_length("text") > 0)
    return vocabulary, taught_by_all(rows, vocabulary, WindowNet().start(vocabulary.total), rounds, rate, size), others, path


def scored(model):
    """Of every text its words, their log-probability but for the counts of words outside the head, and those words, each
    once with its count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, net = model.value
        for batch in batches:
            for rows, data, off in text_views(batch):
                w, counts = words_of(data, off)
                p, new, at = np.zeros(len(w)), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(w):
                    klass, inside, new = vocabulary.look_up(w)
                    p = inside + (net.log_probs(contexts(klass, counts), klass) if net else -np.log(CLASSES))
                    at = np.repeat(np.arange(len(counts)), counts)[new]
                rare = w[new]
                order = np.lexsort((rare, at))
                rare, at = rare[order], at[order]
                first = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (at[1:] != at[:-1])))[: len(rare)])
                times = np.diff(np.append(first, len(rare))).astype(np.int32)
                cuts = pa.array(np.searchsorted(at[first], np.arange(len(counts) + 1)), pa.int32())
                upto = np.concatenate(([0.0], np.cumsum(p)))
                ends = np.cumsum(counts)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (rare[first], times)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts), pa.array(upto[ends] - upto[ends - counts]), *lists], ["r", "doc_id", "n_tokens", "log_prob", "rare", "times"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, most_head: int = 1 << 20, rounds: int = 2, rate: float = 0.01, size: int = 8192) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob, pseudo_perplexity) for every row.

    A token is a white-space word, A-Z lower-cased. log_prob sums over all tokens of the whole text the log of
    P(class | two words on either side) * P(word | class); the first from the network, which all words of all documents
    teach once, the second from counts over all documents: of the head's words inside the tasks, of all others by a join of
    every text's words with the counts. Null, empty and wordless texts: 0 tokens, log_prob 0, null means. Repeated rows and
    null ids are kept and count in the statistics; an empty table gives no rows; other columns are not looked at.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    vocabulary, net, others, path = learnt(rows, most_head, rounds, rate, size)
    model = docs.sparkSession.sparkContext.broadcast((vocabulary, net))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select(F.monotonically_increasing_id().alias("r"), "doc_id", "text")
    # written, so that the rows' numbers stand
    out, p_out = written(rows.mapInArrow(trimmed(scored(model)), f"r long, doc_id {kind}, n_tokens long, log_prob double, rare array<long>, times array<int>"), "lm-texts")
    own = out.select("r", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("r", F.col("x.rare").alias("word"), F.col("x.times").alias("c"))
    own = own.join(others.hint("shuffle_hash"), "word").groupBy("r").agg(F.sum(F.col("c") * F.log("n")).alias("own"))
    total = F.col("log_prob") + F.coalesce("own", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    out = out.drop("rare", "times").join(own, "r", "left").select("doc_id", "n_tokens", total.alias("log_prob"))
    out = out.withColumn("mean_log_prob", mean).withColumn("pseudo_perplexity", F.exp(F.least(-F.col("mean_log_prob"), F.lit(700.0))))
    out, _ = written(out, "lm-scores")
    removed(docs.sparkSession, path, p_out)
    return out
