"""N-gram Jaccard join: documents whose sets of word shingles agree to a given share, and the classes their links make."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, classes, lists, mix, only, removed, row_key, signed, sought, text_views, trimmed, written

WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A task remembers so many sets, to send the keys of copies once.
MOST_SEEN = 1 << 18
#: Standard deviations above the expected number of empty groups that a band provides for.
SPREAD = 3


LOWER_VALUE = LOWER.astype(np.uint64) + np.uint64(1)
#: Multipliers of the bytes of a word by their place in it: odd and unrelated, so no pattern of bytes cancels out.
PLACE = mix(np.arange(4096, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def place_keys(place: np.ndarray) -> np.ndarray:
    if not len(place) or place.max() < len(PLACE):
        return PLACE.take(place)
    return mix(place.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def word_hashes(data: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word, in order; a word is a run of bytes other than ASCII white space, A-Z lower-cased.

    The sum of a word's bytes, each times the key of its place. Long texts go chunk by chunk; what a chunk's last word has so
    far is carried into the next.
    """
    out, held, size = [], np.uint64(0), 0
    for begin in range(0, len(data), chunk):
        part = data[begin : begin + chunk]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = WORD_BYTES[part]
        edges = np.flatnonzero(np.diff(inside))
        lengths = edges[1::2] - edges[::2]
        total = lengths.copy()
        if size and not inside[1]:  # the carried word ended with the chunk before
            out.append(mix(np.array([held + np.uint64(size)])))
            held, size = np.uint64(0), 0
        if not len(lengths):
            continue
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        place[: lengths[0]] += size
        sums = np.add.reduceat(place_keys(place) * LOWER_VALUE.take(part[inside[1:-1].view(bool)]), first)
        sums[0] += held
        total[0] += size
        held, size = np.uint64(0), 0
        if inside[-2] and begin + chunk < len(data):
            held, size = sums[-1], int(total[-1])
            sums, total = sums[:-1], total[:-1]
        out.append(mix(sums + total.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(data: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles; a text of 1 to n - 1 words has its whole sequence as one."""
    words = word_hashes(data)
    if not len(words):
        return words
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - size + 1 + k])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


class Bands:
    """Size bands for a share num / den: two linked sets are in one band or in adjacent ones.

    Linked sets of sizes a <= b differ in at most (a + b) * (den - num) / (den + num) shingles. With that bound `most` for a
    band, most + 1 + spare groups of the hash range hold at least 1 + spare groups without a difference. A set with up to
    `spare` empty groups needs keys for the others only: one of them has no difference and a hash, so equal group sums find
    every link. A set with more emits them all, and meets there with others that lack the same groups; so spare follows the
    number of empty groups that the band's smallest sets are expected to have.
    """

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        self.low, self.groups, self.spare = [1], [], []
        while (low := self.low[-1]) < largest:
            a = low * den // num
            self.low.append(a + 1)
            most = (a + a * den // num) * (den - num) // (den + num)
            self.spare.append(self.empty(low, most + 1))
            self.groups.append(most + 1 + self.spare[-1] if most else 0)  # without a difference only equal sets link

    @staticmethod
    def empty(low: int, need: int) -> int:
        """How many of a set's groups to expect empty, if it has `low` hashes and the pigeonhole needs `need` groups with one."""
        spare = 1
        for _ in range(8):  # more groups leave more of them empty
            mean = (need + spare) * math.exp(-low / (need + spare))
            spare = min(need, max(1, math.ceil(mean + SPREAD * math.sqrt(mean))))
        return spare

    def keys(self, h: np.ndarray) -> np.ndarray:
        """The tile keys of a set: of its own band, and of the band below as a guest."""
        band, out = int(np.searchsorted(self.low, len(h), "right")) - 1, []
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h + np.uint64(0x51ED270B)), out=total[1:])
        for k in (band, band - 1):
            if k < 0 or not (m := self.groups[k]):
                continue
            group = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            at = np.searchsorted(group, np.arange(m + 1, dtype=np.uint64))
            full = np.diff(at) > 0
            if m - full.sum() > self.spare[k]:
                full[:] = True
            g = np.flatnonzero(full)
            out.append(mix((total[at[g + 1]] - total[at[g]]) ^ mix((g + (k << 32)).astype(np.uint64))))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(h: np.ndarray, each: int) -> np.ndarray:
    """A signature with a bit set for each hash, as bytes: a power of two of bits, `each` for a hash at least."""
    bits = 1 << max(8, int(each * len(h) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out)


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Rows of 0 and 1 of the shortest bitmap's length; a longer one's parts are laid over each other."""
    least = 8 * min(map(len, bitmaps))
    return np.stack([np.unpackbits(np.frombuffer(b, np.uint8)).reshape(-1, least).max(0) for b in bitmaps])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted arrays of distinct hashes."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def prints(h: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that stand for a set."""
    return mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64), mix(h + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)


def tagged(n: int, num: int, den: int):
    """Rows with their set's size and prints; keys once for each set in a task, so that copies are combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in batches:
            for rows, data, off in text_views(batch):
                sizes, f1, f2, keys = [], [], [], []
                for i in range(len(rows)):
                    h = shingle_set(data[off[i] : off[i + 1]], n)
                    a, b = prints(h)
                    k = bands.keys(h) if len(h) and (a, b) not in seen else np.zeros(0, np.uint64)
                    if len(seen) > MOST_SEEN:
                        seen.clear()
                    seen.add((a, b))
                    sizes.append(len(h)), f1.append(a), f2.append(b), keys.append(k)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("r"), rows.column("r2"), pa.array(sizes, pa.int64()), signed(np.array(f1, np.uint64)), signed(np.array(f2, np.uint64)), lists(np.concatenate(keys), list(map(len, keys)))],
                    ["doc_id", "r", "r2", "n", "f1", "f2", "keys"],
                )

    return run


def live_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, f1): every set but the first of its key, with the first. One row is carried between batches."""
    key = first = last = None
    for batch in batches:
        k, f = (np.asarray(batch.column(x)) for x in ("key", "f1"))
        if not len(k):
            continue
        if key is not None:
            k, f = np.concatenate(([key, key], k)), np.concatenate(([first, last], f))
        new = np.concatenate(([True], k[1:] != k[:-1]))
        lead = f[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        fresh = ~new & np.concatenate(([False], f[1:] != f[:-1])) & (f != lead)
        if key is not None:
            fresh[:2] = False
        yield pa.RecordBatch.from_arrays([pa.array(k[fresh]), pa.array(lead[fresh]), pa.array(f[fresh])], ["key", "lead", "f1"])
        key, first, last = k[-1], lead[-1], f[-1]


def sets(n: int, each: int, whole: bool):
    """The bitmaps of texts' sets; the sets too, if they are wanted whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in text_views(batch):
                got = [shingle_set(data[off[i] : off[i + 1]], n) for i in range(len(rows))]
                own = np.flatnonzero(np.array([prints(h)[0] for h in got], np.uint64).view(np.int64) == np.asarray(rows.column("f1")))
                rows, got = rows.take(pa.array(own)), [got[i] for i in own]  # not rows whose key is the same by chance
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("f1", "node", "n")), pa.array([bitmap(h, each).tobytes() for h in got], pa.binary()), *([pa.array([h.tobytes() for h in got], pa.binary())] if whole else [])],
                    ["f1", "node", "n", "m", *(["h"] if whole else [])],
                )

    return run


def bound(a: int, pop_a, b: int, pop_b, common):
    """The most that two sets can share: each bit that only one of them has stands for a hash that the other lacks."""
    return common + np.minimum(a - pop_a, b - pop_b)


def may_link(size: np.ndarray, bitmaps: list[bytes], comps: list[int], num: int, den: int) -> np.ndarray:
    """Which pairs of a tile are of different classes and can link, by their sizes and bitmaps."""
    grid = folded(bitmaps).astype(np.float32)
    pop = grid.sum(1).astype(np.int64)
    top = bound(size[:, None], pop[:, None], size[None, :], pop[None, :], (grid @ grid.T).astype(np.int64))
    comp = np.unique(comps, return_inverse=True)[1]
    return (den * top >= num * (size[:, None] + size[None, :] - top)) & (comp[:, None] != comp[None, :])


def by_tile(columns: tuple[str, ...], solve, make):
    """A function over rows sorted by tile (key, i, j): solve(lists of the columns) for each tile of several classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            out = []
            for *at, row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), zip(*(batch.column(c).to_pylist() for c in columns))):
                if at != tile:
                    out += closed(tile, held)
                    tile, held = at, []
                held.append(row)
            yield make(out)
        yield make(closed(tile, held))

    def closed(tile, rows: list[tuple]) -> list[tuple]:
        rows = list(dict.fromkeys(rows))
        return solve(tile, *zip(*rows)) if len({r[1] for r in rows}) > 1 else []

    return run


def tile_survivors(num: int, den: int):
    """The members of each tile that can link with another one."""

    def solve(tile, nodes, comps, sizes, bitmaps):
        near = may_link(np.array(sizes, np.int64), bitmaps, comps, num, den).any(1)
        return [(*tile, nodes[i], comps[i]) for i in np.flatnonzero(near)]

    names = ["key", "i", "j", "node", "comp"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return by_tile(("node", "comp", "n", "m"), solve, lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names))


def tile_links(num: int, den: int):
    """Links that join the members of each tile that are of different classes, no more than make them one class."""

    def solve(_, nodes, comps, bitmaps, hashes):
        parent = {c: c for c in comps}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        hashes = [np.frombuffer(h, np.uint64) for h in hashes]
        size, out = np.array([len(h) for h in hashes]), []
        for i, j in zip(*np.nonzero(np.triu(may_link(size, bitmaps, comps, num, den), 1))):
            if (p := root(comps[i])) != (q := root(comps[j])):
                both = overlap(hashes[i], hashes[j])
                if den * both >= num * (size[i] + size[j] - both):
                    parent[max(p, q)] = min(p, q)
                    out.append((nodes[i], nodes[j]))
        return out

    return by_tile(("node", "comp", "m", "h"), solve, edge_batch)


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_classes(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", *, bits_each: int = 2, tile_rows: int = 512, tile_hashes: int = 1 << 20, broadcast_rows: int = BROADCAST_ROWS, row_keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the class of documents that chains of links reach.

    Two documents link when den * |intersection| >= num * |union| of their sets of n-word shingles. Hashes stand for shingles.

    1. Every set emits tile keys (size band, group of the hash range, sum of the group's hashes). Links differ in too few
       shingles to touch all groups, so linked sets share a key; equal sets are one set from here on.
    2. Sets of a key meet in the tile of the key's first set, each once for a tile, however many keys they share. A tile's
       bitmaps bound what pairs can share; sets travel only for members with a possible link, and are then compared exactly
       as long as they are of different classes.
    3. A tile of more than `tile_rows` sets or `tile_hashes` hashes is cut into blocks, so that no task holds it. If the blocks
       leave it in several classes, its blocks meet in pairs and compare across classes.

    Null or wordless texts: size 0, linked with nothing, component_id their own id. Null ids: the row counts, but gives no
    component_id; a class of null ids only has a null one. Repeated rows and ties: equal sets are one class. An empty table
    gives no rows. Other columns are not looked at, whatever their names. With `row_keys` also r1 and r2, which name a row by
    id and text (see row_key()), and `stays`: true for the row of each class that has the least id (nulls last, then the least
    key), for all rows equal to it, and for all rows of size 0.
    """
    spark = docs.sparkSession
    r, r2 = row_key()
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumns({"r": r, "r2": r2})
    full, p_full = written(rows.mapInArrow(trimmed(tagged(n, num, den)), "doc_id long, r long, r2 long, n long, f1 long, f2 long, keys array<long>"), "ngram-keys")
    base, p_base = written(full.drop("keys"), "ngram-sets")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r", "r2")  # the row that stands for others
    reps = base.where("n > 0").groupBy("f1", "f2").agg(F.min(first).alias("first"), F.first("n").alias("n"))
    reps = reps.select("f1", "f2", "n", "first", "first.r", F.expr("coalesce(first.doc_id, -1 - (first.r & 9223372036854775807))").alias("node"))
    keys = full.where(F.size("keys") > 0).select("f1", F.explode("keys").alias("key"))
    live, p_live = written(keys.repartition("key").sortWithinPartitions("key", "f1").mapInArrow(trimmed(live_runs), "key long, lead long, f1 long"), "ngram-live")
    removed(spark, p_full)
    lit = live.select("f1").union(live.select("lead")).distinct()
    want, p_want = written(reps.join(lit, "f1").select("r", "f1", "node", "n"), "ngram-want")

    def read(some: DataFrame, whole: bool, name: str) -> tuple[DataFrame, str]:
        """The bitmaps (and sets) of the representatives in `some`, from their texts."""
        kind = "f1 long, node long, n long, m binary" + ", h binary" * whole
        return written(rows.select("r", "text").join(sought(some, broadcast_rows), "r").mapInArrow(trimmed(sets(n, bits_each, whole)), kind), name)

    held, p_held = read(want, False, "ngram-signs")
    nodes = held.select("f1", "node", "n").distinct()
    pairs, p_pairs = written(live.select(F.col("lead").alias("key"), "f1").distinct().join(nodes, "f1").select("key", "f1", "node", "n"), "ngram-pairs")
    blocks = pairs.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / tile_rows), F.ceil(F.sum("n") / tile_hashes)).cast("int").alias("nb"))
    blocks, p_blocks = written(blocks, "ngram-blocks")
    dealt = pairs.join(blocks, "key").withColumn("at", F.expr("cast(pmod(xxhash64(node, 3), nb) as int)"))
    signs = held.select("node", "n", "m")
    paths = [p_live, p_want, p_pairs, p_blocks]

    def compared(tiles: DataFrame, name: str) -> DataFrame:
        """The links in tiles (key, i, j, node, comp): sets travel only for members whose bitmaps leave a link possible."""
        dealt = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        near, p_near = written(dealt(tiles.join(signs, "node")).mapInArrow(trimmed(tile_survivors(num, den)), "key long, i int, j int, node long, comp long"), f"{name}-near")
        some, p_some = written(want.join(near.select("node").distinct(), "node").select("r", "f1", "node", "n"), f"{name}-some")
        sets_, p_sets = read(some, True, f"{name}-sets")
        out, p_out = written(dealt(near.join(sets_.select("node", "m", "h"), "node")).mapInArrow(trimmed(tile_links(num, den)), "a long, b long"), name)
        paths.extend((p_near, p_out))
        removed(spark, p_some, p_sets)
        return out

    firsts = blocks.withColumn("at", F.explode(F.expr("sequence(0, nb - 1)"))).join(nodes.select("f1", "node"), F.col("key") == F.col("f1")).select("key", "node", "at")
    tiles = dealt.select("key", "node", "at").union(firsts)
    edges = compared(tiles.select("key", F.col("at").alias("i"), F.col("at").alias("j"), "node", F.col("node").alias("comp")), "ngram-edges")
    if blocks.where("nb > 1").limit(1).count():
        comp = classes(edges, "ngram-first")
        placed = dealt.where("nb > 1").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        placed, p_placed = written(placed.select("key", "node", "comp", "at", "nb"), "ngram-placed")
        open_ = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        rest = placed.join(open_, "key", "left_semi").withColumn("o", F.explode(F.expr("sequence(0, nb - 1)"))).where("o <> at")
        more = compared(rest.select("key", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "node", "comp"), "ngram-more")
        edges, p_all = written(edges.union(more), "ngram-all")
        paths += [p_placed, p_all]
    joined = classes(edges, "ngram-classes")
    named = reps.join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("first").alias("top"))
    names, p_names = written(named.select("f1", "f2", "comp").join(least, "comp").select("f1", "f2", "top"), "ngram-names")
    removed(spark, p_held, *paths)
    out = base.select("doc_id", "r", "r2", "n", "f1", "f2").join(names, ["f1", "f2"], "left")
    stays = (F.col("n") == 0) | (F.col("r").eqNullSafe(F.col("top.r")) & F.col("r2").eqNullSafe(F.col("top.r2")))
    shown = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("top.doc_id")).otherwise(F.col("doc_id")).alias("component_id")]
    out, _ = written(out.select(*shown, *([F.col("r").alias("r1"), "r2", stays.alias("stays")] if row_keys else [])), "ngram-out")
    removed(spark, p_base, p_names)
    return out
