"""Quality classifier learnt from trusted positives and unlabelled text (non-negative unbiased risk)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Adam, held_out, only, strata, taught, text_views, trimmed
from tessera.llm.ngram_join import word_hashes

#: Byte kinds: 0 other; the rest in the order of this list.
KINDS = [range(97, 123), range(65, 91), range(48, 58), [32], [10], b".", b",", b"!", b"?", b"|", b"$#%&*", b"'\"()", b"<>=/@", b":;-_+", range(128, 256)]
KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate(KINDS):
    KIND[list(_bytes)] = _k + 1
WIDTH = 256 + 7


def features(data: np.ndarray) -> np.ndarray:
    """Of a whole text: how often each kind of byte follows each kind (roots of shares), and how long and how repetitive it is."""
    out = np.zeros(WIDTH, np.float32)
    if not len(data):
        return out
    kind = KIND[data]
    out[:256] = np.sqrt(np.bincount(kind[:-1] * 16 + kind[1:], minlength=256) / len(data))
    words = word_hashes(data)
    lines = np.flatnonzero(np.concatenate(([True], data[:-1] == 10)))
    if len(words):
        ordered = np.sort(words)
        fresh = 1 + np.count_nonzero(ordered[1:] != ordered[:-1])
        pair = np.sort(words[:-1] * np.uint64(3) + words[1:])
        out[256] = fresh / len(words)
        out[257] = fresh / (1 + 30 * np.sqrt(len(words)))
        out[258] = (1 + np.count_nonzero(pair[1:] != pair[:-1])) / max(1, len(pair))
        out[259] = min(len(data) / len(words), 40) / 10
    out[260] = np.log1p(len(data)) / 10
    out[261] = np.log1p(len(data) / len(lines)) / 10
    out[262] = len({data[a:b].tobytes() for a, b in zip(lines, [*lines[1:], len(data)])}) / len(lines)
    return out


class Scorer:
    """A network with one hidden layer over standardised features; the logit's sign is the class."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, hidden: int = 24, seed: int = 1):
        r = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.p = {"w": r.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)), "b": np.zeros(hidden), "v": r.normal(0, 1 / np.sqrt(hidden), hidden), "c": np.zeros(1)}

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["w"] + self.p["b"])

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden((x - self.mean) / self.spread) @ self.p["v"] + self.p["c"]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def backward(self, x: np.ndarray, h: np.ndarray, dz: np.ndarray) -> dict[str, np.ndarray]:
        dh = dz[:, None] * self.p["v"] * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dz, "c": np.array([dz.sum()])}


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 40, size: int = 512, rate: float = 0.003, decay: float = 1e-3, seed: int = 2) -> Scorer:
    """Minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the sigmoid loss; where the bracket is below zero, a step
    is taken that raises it again."""
    both = np.concatenate((positive, unlabelled))
    net = Scorer(both.mean(0), both.std(0) + 0.02)
    p, u = ((x - net.mean) / net.spread for x in (positive, unlabelled))
    r, adam = np.random.default_rng(seed), Adam(net.p, rate)
    steps = max(1, max(len(p), len(u)) // size)
    for _ in range(max(epochs, 400 // steps)):
        for a, b in zip(np.array_split(r.permutation(len(p)), steps), np.array_split(r.permutation(len(u)), steps)):
            if not len(a) or not len(b):
                continue
            x, y = p[a], u[b]
            hx, hy = net.hidden(x), net.hidden(y)
            sx, sy = (1 / (1 + np.exp(-np.clip(h @ net.p["v"] + net.p["c"], -40, 40))) for h in (hx, hy))
            # the loss of score s as positive is 1 - s, as negative s; both have slope s * (1 - s)
            dx, dy = sx * (1 - sx) / len(a), sy * (1 - sy) / len(b)
            if sy.mean() - prior * sx.mean() >= 0:
                gx, gy = net.backward(x, hx, -2 * prior * dx), net.backward(y, hy, dy)
            else:
                gx, gy = net.backward(x, hx, prior * dx), net.backward(y, hy, -dy)
            adam.step({k: gx[k] + gy[k] + decay * net.p[k] for k in gx})
    return net


def fit_apart(positive: np.ndarray, unlabelled: np.ndarray, epochs: int = 20, size: int = 512, rate: float = 0.003, decay: float = 1e-3, seed: int = 3) -> Scorer:
    """How much a row looks like a positive one rather than an unlabelled one: the same network by cross-entropy."""
    x, y = np.concatenate((positive, unlabelled)), np.repeat([1.0, 0.0], [len(positive), len(unlabelled)])
    weight = np.where(y > 0, 0.5 / max(1, len(positive)), 0.5 / max(1, len(unlabelled)))
    net = Scorer(x.mean(0), x.std(0) + 0.02, seed=seed)
    x = (x - net.mean) / net.spread
    r, adam = np.random.default_rng(seed), Adam(net.p, rate)
    steps = max(1, len(x) // size)
    for _ in range(max(epochs, 200 // steps)):
        for rows in np.array_split(r.permutation(len(x)), steps):
            h = net.hidden(x[rows])
            s = 1 / (1 + np.exp(-np.clip(h @ net.p["v"] + net.p["c"], -40, 40)))
            grads = net.backward(x[rows], h, (s - y[rows]) * weight[rows] / weight[rows].sum())
            adam.step({k: g + decay * net.p[k] for k, g in grads.items()})
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, gamma: float = 0.1, delta: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from features alone.

    Whatever the threshold of a score, the unlabelled rows above it are at least that share of the positives above it. So the
    ratio of both shares bounds it from above, and is close where hardly a negative scores so high: the least ratio, with
    room for what few rows leave to chance. Each half of the rows is scored by a network fitted on the other half.
    """
    halves = [(x[::2], x[1::2]) for x in (positive, unlabelled)]
    if min(len(h) for pair in halves for h in pair) == 0:
        return 0.5
    ratios = []
    for k in (0, 1):
        net = fit_apart(halves[0][k], halves[1][k], seed=3 + k)
        p, u = (np.sort(net.score(pair[1 - k])) for pair in halves)
        at = np.unique(p)
        share_p, share_u = ((len(x) - np.searchsorted(x, at)) / len(x) for x in (p, u))
        slack = (1 + gamma) * (np.sqrt(np.log(4 / delta) / (2 * len(u))) + np.sqrt(np.log(4 / delta) / (2 * len(p))))
        best = int(np.argmin((share_u + slack) / share_p))
        ratios.append(share_u[best] / share_p[best])
    return float(np.clip(np.mean(ratios), 0.01, 0.99))


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in text_views(batch):
            yield pa.RecordBatch.from_arrays([rows.column("quality"), pa.array([features(data[off[i] : off[i + 1]]).tobytes() for i in range(len(rows))], pa.binary())], ["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, each: int = 6000) -> Scorer | None:
    """Fitted on the driver on at most about `each` trusted positives and `each` unlabelled rows, chosen by a hash of their ids.

    Labels other than positive ones play no part: the prior is estimated from both sets of rows (see class_prior()). None
    without positives.
    """
    mine = labels.where(taught() & (F.col("quality") == 1)).select("doc_id", "quality").distinct()
    some = strata(mine, "quality", each)
    text = docs.where(taught())
    trusted = text.join(F.broadcast(some), "doc_id").select("quality", "text")
    free = strata(text.withColumn("quality", F.lit(-1)), "quality", each, seed=12).select("quality", "text")
    x = trusted.unionByName(free).mapInArrow(trimmed(featured), "quality int, x binary").toPandas()
    grid = np.frombuffer(b"".join(x["x"]), np.float32).reshape(-1, WIDTH).astype(np.float64)
    pos, un = grid[x["quality"] == 1], grid[x["quality"] == -1]
    return fit_nnpu(pos, un, class_prior(pos, un)) if len(pos) and len(un) else None


def scored(net: Scorer | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in text_views(batch):
                x = np.stack([features(data[off[i] : off[i + 1]]) for i in range(len(rows))])
                s = net.score(x) if net else np.full(len(rows), 0.5)
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(rows.num_columns - 1)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*rows.schema.names[:-1], "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", *, each: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, from features of its whole text.

    Labels are learnt from only where crc32 of doc_id modulo 3 is not 1. Null and empty texts have all features 0 and get a
    score too. Without trusted positives every score is 0.5. Repeated rows and null ids are kept (neither held out nor learnt
    from); repeated labels of an id count once, as their largest; an empty table gives no rows; other columns are not used.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    net = train(rows, only(labels, doc_id=label_id, quality=label_col), each)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(trimmed(scored(net)), f"doc_id {kind}, held_out boolean, score double, predicted int")
