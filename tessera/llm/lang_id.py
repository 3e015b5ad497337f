"""Language identification by a byte convolutional network, trained in numpy and applied to fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Adam, held_out, only, row_key, strata, taught, text_views, trimmed

WIDTHS = (2, 3, 4)
OVER = max(WIDTHS) - 1  # bytes that neighbouring windows share, so that no n-gram is lost between them
ASCII_LETTERS = np.zeros(256, bool)
ASCII_LETTERS[65:91] = ASCII_LETTERS[97:123] = True


def windows(off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's windows of `length` bytes: the text each is of, where it begins, how many of its bytes are the text's."""
    step, sizes = length - OVER, np.diff(off)
    counts = np.maximum(1, -(-(sizes - OVER) // step))
    owner = np.repeat(np.arange(len(sizes)), counts)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    return owner, off[:-1][owner] + begin, np.minimum(sizes[owner] - begin, length)


def cut(data: np.ndarray, begin: np.ndarray, real: np.ndarray, length: int) -> np.ndarray:
    """The bytes of some windows, filled up with spaces."""
    at = np.arange(length)
    x = data.take(np.minimum(begin[:, None] + at, max(len(data) - 1, 0))) if len(data) else np.zeros((len(begin), length), np.uint8)
    x[at >= real[:, None]] = 32
    return x


class ByteConv:
    """Byte embedding, filters of several widths, max pooling over the window, softmax."""

    def __init__(self, labels: list[str], length: int = 256, dim: int = 8, filters: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        self.labels, self.length = labels, length
        self.p = {"emb": r.normal(0, 0.5, (256, dim)), "out": np.zeros((filters * len(WIDTHS), len(labels))), "bias": np.zeros(len(labels))}
        self.p |= {f"w{w}": r.normal(0, 1 / np.sqrt(w * dim), (w * dim, filters)) for w in WIDTHS}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, size: int = 64, rate: float = 0.01, least_steps: int = 400, seed: int = 6) -> "ByteConv":
        r, adam, span = np.random.default_rng(seed), Adam(self.p, rate), self.length - OVER
        steps = max(1, len(x) // size)
        for _ in range(max(epochs, -(-least_steps // steps))):
            for rows in np.array_split(r.permutation(len(x)), steps):
                p, b = self.p, x[rows]
                e = p["emb"][b]
                pooled, kept = [], []
                for w in WIDTHS:
                    cols = np.concatenate([e[:, t : t + span] for t in range(w)], 2)
                    z = cols @ p[f"w{w}"]
                    at = z.argmax(1)
                    pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
                    kept.append((at, np.take_along_axis(cols, at[:, :, None], 1)))
                h = np.concatenate(pooled, 1)
                s = h @ p["out"] + p["bias"]
                s = np.exp(s - s.max(1, keepdims=True))
                s /= s.sum(1, keepdims=True)
                s[np.arange(len(rows)), y[rows]] -= 1
                s /= len(rows)
                g, dh = {"out": h.T @ s, "bias": s.sum(0), "emb": np.zeros_like(p["emb"])}, s @ p["out"].T
                for k, (w, (at, patch)) in enumerate(zip(WIDTHS, kept)):
                    d = dh[:, k * at.shape[1] : (k + 1) * at.shape[1]]
                    g[f"w{w}"] = np.einsum("nf,nfc->cf", d, patch)
                    back = d[:, :, None] * p[f"w{w}"].T[None]
                    for t in range(w):
                        np.add.at(g["emb"], np.take_along_axis(b, at + t, 1), back[:, :, t * e.shape[2] : (t + 1) * e.shape[2]])
                adam.step(g)
        return self

    def tables(self) -> dict[int, list[np.ndarray]]:
        """The filters' sums by byte or pair of bytes, so that a filter of width w is a few table rows added up."""
        out = {}
        for w in WIDTHS:
            d = self.p["emb"].shape[1]
            t = [self.p["emb"] @ self.p[f"w{w}"][k * d : (k + 1) * d] for k in range(w)]
            pairs = [(t[k][:, None] + t[k + 1][None]).reshape(65536, -1) for k in range(0, w - 1, 2)]
            out[w] = pairs + ([t[-1]] if w % 2 else [])
        return out

    def logits(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        span = self.length - OVER
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for w in WIDTHS:
            z = tables[w][0].take(pair[:, :span], 0)
            for k, t in enumerate(tables[w][1:]):
                z += t.take((pair if len(t) == 65536 else x)[:, 2 * k + 2 : 2 * k + 2 + span], 0)
            pooled.append(z.max(1))
        return np.concatenate(pooled, 1) @ self.p["out"] + self.p["bias"]


def train(docs: DataFrame, each: int = 1500, length: int = 256) -> ByteConv | None:
    """A network fitted on the driver: of about `each` labelled rows of every language, chosen by a hash of their ids, one
    window at a place that the same hash gives. None without such rows."""
    rows = docs.where(taught() & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    at = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.length("text") - length + 1, F.lit(1))) + 1
    sample = strata(rows, "lang", each).select("lang", F.substring("text", at.cast("int"), F.lit(length)).alias("text")).toPandas()
    if not len(sample):
        return None
    labels = sorted(sample["lang"].unique())
    raw = [t.encode()[:length].ljust(length) for t in sample["text"]]
    x = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, length)
    return ByteConv(labels, length).fit(x, np.searchsorted(labels, sample["lang"].to_numpy(str)))


def predictor(net: ByteConv | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            for rows, data, off in text_views(batch, most=1 << 18):
                n = len(rows)
                names, score = np.full(n, "und", object), np.zeros(n)
                if net:
                    letter = np.logical_or.reduceat(np.append(ASCII_LETTERS[data], False), off[:-1]) & (np.diff(off) > 0)
                    for i in np.flatnonzero(~letter & (np.diff(off) > 0)):
                        letter[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
                    total = np.zeros((n, len(net.labels)))
                    owner, begin, real = windows(off, net.length)
                    for i in range(0, len(owner), 1024):
                        some = slice(i, i + 1024)
                        z = net.logits(cut(data, begin[some], real[some], net.length), tables).astype(np.float64)
                        z -= np.logaddexp.reduce(z, axis=1, keepdims=True)
                        np.add.at(total, owner[some], z * np.maximum(real[some, None], 1))
                    mean = total / np.bincount(owner, np.maximum(real, 1), n)[:, None]
                    p = np.exp(mean - np.logaddexp.reduce(mean, axis=1, keepdims=True))
                    best = p.argmax(1)
                    names = np.where(letter, np.array(net.labels, object)[best], "und")
                    score = np.where(letter, p[np.arange(n), best], 0.0)
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(rows.num_columns - 1)), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], [*rows.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, net: ByteConv | None = None, each: int = 1500, row_keys: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, from all windows of its whole text.

    The network is fitted on the rows whose crc32 of doc_id modulo 3 is not 1 and that have a language (see train()), unless
    one is given. A text's score is the softmax of its windows' mean log-probabilities, weighted by their bytes. `und` with
    score 0: null text, a text without a letter, or no labelled rows to learn from. Rows in, rows out: repeated rows and null
    ids are kept (a null id is not held out, nor learnt from); an empty table gives no rows; other columns are not looked at.
    With `row_keys` also r1 and r2 (see row_key()).
    """
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col)
    net = net or train(rows)
    kind = rows.schema["doc_id"].dataType.simpleString()
    keys = row_key() if row_keys else []
    rows = rows.select("doc_id", held_out().alias("held_out"), *keys, "text")
    return rows.mapInArrow(trimmed(predictor(net)), f"doc_id {kind}, held_out boolean, {'r1 long, r2 long, ' if keys else ''}lang_pred string, score double")
