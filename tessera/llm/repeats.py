"""Repeated byte strings: every byte covered by a string of a given length that also starts elsewhere in the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import M1, POWERS, mix, only, removed, row_key, signed, text_views, trimmed, written

Batches = Iterator[pa.RecordBatch]

GRAM = 64  # bytes of the grams that anchors are chosen from
CHUNK = 1 << 20  # windows that are looked at together; a gram's place in a chunk fits the low bits of its key
SYMBOL = 20  # bytes of a symbol of the transforms
SHARD = 1 << 14  # bytes of snippets whose suffixes are sorted together, before shards are merged
LOW = np.uint64((1 << 21) - 1)
MOST_SEEN = 1 << 18  # names of runs that a task remembers
PIECES = 10  # a sieve is made in 2 ** PIECES parts
MOST_WORDS = 24  # and has 2 ** MOST_WORDS words of 64 bits at most: beyond some 10 ** 8 values it lets more others through


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any slice; see slice_hash()."""
    up, _ = POWERS.upto(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total


def slice_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = POWERS.upto(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours: running minima from both ends of blocks of that width."""
    rows = -(-len(x) // width)
    grid = np.full(rows * width, ~np.uint64(0))
    grid[: len(x)] = x
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored_runs(total: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of `length` bytes with one anchor, the first of the grams of least hash in the window.

    Equal windows have equal anchors at equal distances, wherever they stand. Of each run: first window, number of windows,
    place of the anchor, hash of the anchor.
    """
    down, n = POWERS.upto(len(total))[1], len(total) - GRAM
    gram = (total[GRAM:] - total[:n]) * down[:n]
    gram ^= gram >> np.uint64(32)
    gram *= M1  # the high bits, which the order goes by, depend on all bits
    key = gram & ~LOW
    key |= np.arange(n, dtype=np.uint64)
    least = sliding_min(key, length - GRAM + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    place = (least[first] & LOW).astype(np.int64)
    return first, np.diff(np.append(first, len(least))), place, gram[place]


def runs_of(data: np.ndarray, length: int):
    """anchored_runs() with each run's name: a hash of its bytes (all its windows'), its anchor and the anchor's place.

    Long texts go CHUNK windows at a time. That cuts runs, which then are open if they stand whole elsewhere.
    """
    parts = []
    for c in range(0, len(data) - length + 1, CHUNK):
        total = prefix_hash(data[c : c + CHUNK + length - 1])
        start, n, place, anchor = anchored_runs(total, length)
        name = mix(slice_hash(total, start, start + n + length - 1) ^ mix(anchor + (place - start).astype(np.uint64)))
        parts.append((c + start, n, c + place, anchor, name))
    if not parts:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


def runs_of_all(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """runs_of() every text between two offsets, after the number of its text for each run."""
    got = [runs_of(data[a:b], length) for a, b in zip(off, off[1:])]
    return np.repeat(np.arange(len(got)), [len(g[0]) for g in got]), *(np.concatenate(x) for x in zip(*got))


def found(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x, at


def probes(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a sieve of 2 ** bits words where each value stands, and the up to four bits that it has there."""
    h, mask = mix(values), np.zeros(len(values), np.uint64)
    for k in range(0, 24, 6):
        mask |= np.uint64(1) << ((h >> np.uint64(k)) & np.uint64(63))
    return (h >> np.uint64(64 - bits)).astype(np.int64), mask


def passed(sieve: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be one that the sieve was made of: true for all of those, and for a few per cent of others."""
    at, mask = probes(values, len(sieve).bit_length() - 1)
    return sieve[at] & mask == mask


def sieve_of(df: DataFrame, column: str, most_words: int = MOST_WORDS):
    """A broadcast Bloom filter of a long column, of one or two bytes a row; tasks make its pieces. See passed()."""
    bits = min(max(PIECES + 2, (df.count() // 8).bit_length()), most_words)

    def dealt(batches: Batches) -> Batches:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((probes(x, bits)[0] >> (bits - PIECES)).astype(np.int32)), batch.column(0)], ["piece", "value"])

    def made(batches: Batches) -> Batches:
        held = {}
        for batch in batches:
            piece, x = batch.column("piece").to_numpy(), batch.column("value").to_numpy().view(np.uint64)
            at, mask = probes(x, bits)
            for p in np.unique(piece):
                mine = piece == p
                words = held.setdefault(int(p), np.zeros(1 << bits - PIECES, np.uint64))
                np.bitwise_or.at(words, at[mine] & len(words) - 1, mask[mine])
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([w.tobytes() for w in held.values()], pa.binary())], ["piece", "words"])

    pieces = df.select(column).mapInArrow(trimmed(dealt), "piece int, value long").repartition("piece").mapInArrow(trimmed(made), "piece int, words binary").toArrow()
    sieve = np.zeros((1 << PIECES, 1 << bits - PIECES), np.uint64)
    for p, words in zip(pieces.column("piece").to_pylist(), pieces.column("words")):
        sieve[p] = np.frombuffer(words.as_buffer(), np.uint64)
    return df.sparkSession.sparkContext.broadcast(sieve.ravel())


def longs(t: pa.Table, column: str) -> np.ndarray:
    return t.column(column).to_numpy().astype(np.int64).view(np.uint64)


def anchors(length: int):
    """Anchors with how often each stands in a slice of texts."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, data, off in text_views(batch):
                got = [runs_of(data[off[i] : off[i + 1]], length)[3] for i in range(len(rows))]
                a, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(a), pa.array(n)], ["anchor", "n"])

    return run


def named_runs(length: int, common):
    """Runs of the common anchors (and of a few others) with how often each stands in a slice of texts."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, data, off in text_views(batch):
                got = [runs_of(data[off[i] : off[i + 1]], length)[3:] for i in range(len(rows))]
                anchor, name = (np.concatenate([g[k] for g in got]) for k in (0, 1))
                hit = passed(common.value, anchor)
                anchor, (name, first, n) = anchor[hit], np.unique(name[hit], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(anchor[first]), signed(name), pa.array(n)], ["anchor", "name", "n"])

    return run


def snippets(length: int, open_):
    """The bytes of the runs of `open_` (and of a few others), each once in a task as far as it remembers them."""

    def run(batches: Batches) -> Batches:
        seen = set()
        for batch in batches:
            for rows, data, off in text_views(batch):
                out = []
                if len(seen) > MOST_SEEN:
                    seen.clear()
                begin, start, n, place, anchor, name = runs_of_all(data, off, length)
                for k in np.flatnonzero(passed(open_.value, name)):
                    if name[k] not in seen:
                        seen.add(name[k])
                        a = off[begin[k]] + start[k]
                        out.append((anchor[k], name[k], place[k] - start[k], data[a : a + n[k] + length - 1].tobytes()))
                a, s, p, b = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([signed(np.array(a, np.uint64)), signed(np.array(s, np.uint64)), pa.array(p, pa.int64()), pa.array(b, pa.binary())], ["anchor", "name", "place", "bytes"])

    return run


def ranked(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks."""
    key = (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    return out


def alphabet(snippets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbol that starts at each position, as its place among all symbols in the order of their bytes, and the snippets'
    numbers of positions: one more than bytes. Positions that no whole symbol follows have -1."""
    sizes = np.array([len(b) + 1 for b in snippets])
    data = np.frombuffer(b"\0".join(snippets) + b"\0" * (SYMBOL + 8), np.uint8)
    value = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(">u8").ravel().astype(np.uint64)
    n = int(sizes.sum())
    rank = ranked(value[: n + SYMBOL] >> np.uint64(32), value[: n + SYMBOL] & np.uint64(0xFFFFFFFF))
    rank = ranked(rank[: n + SYMBOL - 8], rank[8:])
    rank = ranked(rank[:n], rank[SYMBOL - 16 :][:n])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # positions to the snippet's last
    rank[left <= SYMBOL] = -1
    return rank, sizes


class ShardBwt:
    """The Burrows-Wheeler transform of snippets over symbols of SYMBOL bytes: their suffixes in order, as far as `length`
    bytes tell them apart, and for each the symbol before it, -1 where there is none.

    The ends of snippets, where no whole symbol follows, are symbols of their own; they come first.
    """

    def __init__(self, symbol: np.ndarray, sizes: np.ndarray, length: int):
        self.base, n = np.cumsum(sizes) - sizes, len(symbol)
        end = symbol < 0
        self.ends = int(end.sum())
        rank = symbol + self.ends
        rank[end] = np.arange(self.ends)
        left, step = np.repeat(self.base + sizes, sizes) - np.arange(n), SYMBOL
        while step < length:  # each round doubles the bytes that suffixes are ordered by
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = rank[step:]
            ahead[left <= step] = 0
            rank = ranked(rank, ahead)
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        self.before = np.full(n, -1, np.int32)
        inner = np.flatnonzero(self.order - np.repeat(self.base, sizes)[self.order] >= SYMBOL)
        self.before[inner] = symbol[self.order[inner] - SYMBOL]


def transforms(snippets: list[bytes], cuts: list[int], length: int) -> list[ShardBwt]:
    """The transforms of shards of the snippets, which are cut at these places, over one alphabet."""
    symbol, sizes = alphabet(snippets)
    at = np.concatenate(([0], np.cumsum(sizes)))
    return [ShardBwt(symbol[at[a] : at[b]], sizes[a:b], length) for a, b in zip(cuts, cuts[1:])]


def merged_transform(shards: list[ShardBwt], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes, ordered by their first `symbols` symbols, and how many of those each shares
    with the one before it (-1 for the first).

    Before pass k the interleave is right for k - 1 symbols. A pass walks it and hands on each suffix's predecessor by the
    symbol between the two, keeping the order otherwise: so it is right for k symbols, each shard's own order stays, and no
    suffix is compared with another. Suffixes part in the pass that sees their first differing symbol, which gives their
    common prefix; a pass in which none part is the last that is needed.
    """
    before = np.concatenate([s.before for s in shards])
    small = np.uint8 if len(shards) < 256 else np.uint16
    which = np.repeat(np.arange(len(shards), dtype=small), [len(s.order) for s in shards])
    ends = np.repeat(np.arange(len(shards), dtype=small), [s.ends for s in shards])
    block, common, blocks = np.zeros(len(which), np.int32), np.full(len(which), -1, np.int16), 0
    fresh, symbol = np.ones(len(which), bool), np.empty(len(which), np.int32)
    for k in range(symbols):
        symbol[np.argsort(which, kind="stable")] = before
        at = np.flatnonzero(symbol >= 0).astype(np.uint64)
        key = symbol.take(at).astype(np.uint64)
        key <<= np.uint64(32)
        key |= at
        key.sort()  # by one symbol each; places keep the order of equals
        source = key.astype(np.uint32)
        key >>= np.uint64(32)
        held, which = block.take(source), np.concatenate((ends, which.take(source)))
        fresh[len(ends) + 1 :] = (key[1:] != key[:-1]) | (held[1:] != held[:-1])
        np.cumsum(fresh, out=block, dtype=np.int32)
        if block[-1] == blocks:
            break
        common[fresh & (common < 0)] = k
        blocks = int(block[-1])
    common[~fresh] = symbols
    common[:1] = -1
    return which, common


def repeated(shards: list[ShardBwt], length: int) -> list[np.ndarray]:
    """Of each shard, at which positions strings of `length` bytes start that start elsewhere in the shards too."""
    symbols = length // SYMBOL
    which, common = merged_transform(shards, symbols)
    many = common >= symbols
    many[:-1] |= many[1:]
    place, out, at = np.argsort(which, kind="stable"), [], 0
    for s in shards:
        mask = np.zeros(len(s.order), bool)
        mask[s.order] = many[place[at : at + len(s.order)]]
        at += len(s.order)
        out.append(mask)
    return out


def merged(length: int):
    """Of snippets sorted by anchor and name: the ranges of windows that also start in others, for every snippet that has some."""

    def solve(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, list[int], list[int]]]:
        cuts, size = [0], 0
        for i, row in enumerate(rows):
            size += len(row[3])
            if size >= SHARD:
                cuts.append(i + 1)
                size = 0
        cuts = cuts if cuts[-1] == len(rows) else [*cuts, len(rows)]
        shards = transforms([r[3] for r in rows], cuts, length)
        for a, b, s, mask in zip(cuts, cuts[1:], shards, repeated(shards, length)):
            for (anchor, name, _, data), base in zip(rows[a:b], s.base):
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mask[base : base + len(data) - length + 1].view(np.int8), [0]))))
                if len(edges):
                    yield anchor, name, edges[::2].tolist(), edges[1::2].tolist()

    def run(batches: Batches) -> Batches:
        held, size = [], 0
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "name", "place", "bytes"))):
                if held and row[:2] == held[-1][:2]:
                    continue  # the same run from another task: one is enough to find what single runs share with it
                if size > 4 * SHARD and row[0] != held[-1][0]:
                    out += solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
            yield answers(out)
        yield answers(list(solve(held)) if held else [])

    def answers(rows: list) -> pa.RecordBatch:
        a, s, f, t = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(f, pa.list_(pa.int64())), pa.array(t, pa.list_(pa.int64()))], ["anchor", "name", "froms", "tos"])

    return run


def hot_windows(length: int):
    """Of a hot anchor's snippets: a row for every window, named by its bytes, so that no task needs them all."""

    def points(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        anchor, name, place, bytes_ = zip(*rows)
        sizes = np.array([len(b) - length + 1 for b in bytes_])
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = at + np.repeat(np.cumsum(sizes + length - 1) - sizes - length + 1, sizes)
        anchor, name, place = (np.repeat(np.array(x, np.int64), sizes) for x in (anchor, name, place))
        total = prefix_hash(np.frombuffer(b"".join(bytes_), np.uint8))
        w = mix(slice_hash(total, start, start + length) ^ mix(anchor.view(np.uint64) + (place - at).astype(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(name), pa.array(at), signed(w)], ["anchor", "name", "at", "window"])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            held, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "name", "place", "bytes"))):
                held.append(row)
                size += len(row[3])
                if size > CHUNK:
                    yield points(held)
                    held, size = [], 0
            if held:
                yield points(held)

    return run


def spans(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes that windows first..last - 1 cover: starts and ends."""
    level = np.zeros(len(data) + 1, np.int64)
    np.add.at(level, first, 1)
    np.add.at(level, last + length - 1, -1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(level) > 0).astype(np.int8)))))
    return edges[::2], edges[1::2]


def whole_characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same spans without the parts of characters at their ends."""
    heads = np.flatnonzero(np.append((data & 0xC0) != 0x80, True))
    s, e = heads[np.searchsorted(heads, starts)], heads[np.searchsorted(heads, ends, "right") - 1]
    return s[s < e], e[s < e]


def cleaned(length: int, looked, as_text: bool):
    """Texts with their repeated spans and what is left. Ranges come by run from `looked`, or with the rows."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, data, off in text_views(batch):
                other = [c for c in rows.schema.names if c not in ("text", "froms", "tos")]
                starts, ends, kept = [], [], []
                given = [rows.column(c).to_pylist() for c in ("froms", "tos")] if looked is None else None
                for i in range(len(rows)):
                    text = data[off[i] : off[i + 1]]
                    if looked is None:
                        first, last = (np.array(g[i] or [], np.int64) for g in given)
                    else:
                        full, full_anchor, part, part_anchor, lo, froms, tos = looked.value
                        start, n, _, anchor, name = runs_of(text, length)
                        (whole, place), (hit, at) = found(full, name), found(part, name)
                        if len(full):  # names alone are too short for the runs of a large corpus
                            whole &= full_anchor[place] == anchor
                        if len(part):
                            hit &= ~whole & (part_anchor[at] == anchor)
                        first, last = [start[whole]], [(start + n)[whole]]
                        for k in np.flatnonzero(hit):
                            a, b = lo[at[k]], lo[at[k] + 1]
                            first.append(start[k] + froms[a:b]), last.append(start[k] + tos[a:b])
                        first, last = np.concatenate(first), np.concatenate(last)
                    s, e = spans(text, first, last, length)
                    if as_text:
                        s, e = whole_characters(text, s, e)
                    keep = np.ones(len(text), bool)
                    for a, b in zip(s, e):
                        keep[a:b] = False
                    starts.append(s), ends.append(e), kept.append(text[keep].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in other), pa.array(np.diff(off)), *(pa.array([x.tolist() for x in y], pa.list_(pa.int64())) for y in (starts, ends)), pa.array(kept, pa.binary()).cast(pa.string() if as_text else pa.binary())],
                    [*other, "n_bytes", "starts", "ends", "kept"],
                )

    return run


def placed_runs(length: int, told):
    """The runs of `told` (and a few others) with their rows' keys and places: the way without look-up tables."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, data, off in text_views(batch):
                which, start, n, _, anchor, name = runs_of_all(data, off, length)
                hit = passed(told.value, name)
                keys = [pa.array(rows.column(k).to_numpy()[which[hit]]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(start[hit]), pa.array(n[hit]), signed(anchor[hit]), signed(name[hit])], ["r1", "r2", "start", "n", "anchor", "name"])

    return run


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", *, carry: tuple[str, ...] = (), as_text: bool = False, lookup_rows: int = 1 << 22, hot: int = 1 << 14) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept) for every row: the maximal spans of bytes that strings of `length` bytes cover
    which also start elsewhere in the corpus (the same row included; overlaps count), and the bytes that are left.

    1. Anchors cut all windows into runs; equal windows lie in runs of equal anchors. Anchors found once have no repeats.
    2. Runs of equal bytes repeat as a whole. Runs that share only their anchor with others are open.
    3. The open runs' bytes are dealt out by anchor; shards of them get Burrows-Wheeler transforms, which are merged (see
       merged_transform()): intervals of common prefixes of `length` bytes are the repeats. An anchor
       with more than `hot` different runs is counted window by window instead, so that no task holds its runs.
    4. Every text finds the ranges of its runs, in broadcast tables of at most `lookup_rows` rows, or beyond that by joins.

    What goes from one step to the next (anchors, open runs, runs to join) is picked by sieves, which miss none; the few others
    that they let through have no repeats, and the steps' own grouping and joins leave them out.

    `carry` names further columns to keep as they are. With `as_text`, spans leave out the parts of characters at their ends,
    and `kept` is a string. `length` must be a multiple of 20 and at least 128. Null and short texts lose nothing (null counts as empty). A repeated row
    repeats all it has, if it is long enough. Null ids are kept; an empty table gives no rows; other columns are not used.
    """
    if length % SYMBOL or length < 2 * GRAM:
        raise ValueError(f"length must be a multiple of {SYMBOL} and at least {2 * GRAM}")
    spark = docs.sparkSession
    rows = only(docs, doc_id=id_col, text=text_col, **{f"carried_{k}": c for k, c in enumerate(carry)})
    text = rows.select("text")

    common, p_common = written(text.mapInArrow(trimmed(anchors(length)), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "repeats-anchors")
    runs, p_runs = written(text.mapInArrow(trimmed(named_runs(length, sieve_of(common, "anchor"))), "anchor long, name long, n long").groupBy("anchor", "name").agg(F.sum("n").alias("n")), "repeats-runs")
    kinds = runs.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_, p_open = written(runs.join(kinds, "anchor").select("anchor", "name", "n", "kinds"), "repeats-open")
    bytes_ = text.mapInArrow(trimmed(snippets(length, sieve_of(open_, "name"))), "anchor long, name long, place long, bytes binary")
    hots = open_.where(F.col("kinds") > hot).select("anchor").distinct()
    n_hot = hots.count()
    if n_hot:
        bytes_, p_bytes = written(bytes_, "repeats-bytes")
        few = n_hot <= 1 << 16
        hots = F.broadcast(hots) if few else hots
        cool, warm = bytes_.join(hots, "anchor", "left_anti"), bytes_.join(hots, "anchor", "left_semi").dropDuplicates(["anchor", "name"])
    else:
        cool, warm = bytes_, None
    ranges = cool.repartition("anchor").sortWithinPartitions("anchor", "name").mapInArrow(trimmed(merged(length)), "anchor long, name long, froms array<long>, tos array<long>")
    if warm is not None:
        points = warm.mapInArrow(trimmed(hot_windows(length)), "anchor long, name long, at long, window long")
        points, p_points = written(points, "repeats-points")
        again = points.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
        single = points.join(again, "window").groupBy("anchor", "name").agg(F.sort_array(F.collect_set("at")).alias("froms"))
        ranges = ranges.unionByName(single.withColumn("tos", F.transform("froms", lambda x: x + 1)))
    solo = open_.where("n = 1").select("anchor", "name")
    ranges, p_ranges = written(ranges.join(solo, ["anchor", "name"], "left_semi").dropDuplicates(["anchor", "name"]), "repeats-ranges")
    full = runs.where("n > 1").select("anchor", "name")
    small = full.count() <= lookup_rows and (ranges.agg(F.sum(F.size("froms"))).first()[0] or 0) <= lookup_rows
    if small:
        part, whole = ranges.select("anchor", "name", "froms", "tos").toArrow(), full.toArrow()
        names, full_names = longs(part, "name"), longs(whole, "name")
        order = np.argsort(names)
        froms, tos = (pa.array([], x.type) if not x.num_chunks else x.combine_chunks().take(pa.array(order)) for x in (part.column("froms"), part.column("tos")))
        lo = np.cumsum(np.concatenate(([0], np.asarray(froms.value_lengths(), np.int64))))
        by = np.argsort(full_names)
        looked = spark.sparkContext.broadcast((full_names[by], longs(whole, "anchor")[by], names[order], longs(part, "anchor")[order], lo, np.asarray(froms.flatten()), np.asarray(tos.flatten())))
        source = rows
    else:
        r1, r2 = row_key()
        none = F.lit(None).cast("array<long>")
        told = full.select("anchor", "name", none.alias("froms"), none.alias("tos")).union(ranges.select("anchor", "name", "froms", "tos"))
        every = rows.select(r1, r2, "text").mapInArrow(trimmed(placed_runs(length, sieve_of(told, "name"))), "r1 long, r2 long, start long, n long, anchor long, name long")
        whole = F.array(F.struct(F.lit(0).cast("long").alias("froms"), F.col("n").alias("tos")))  # a run of `full` goes as a whole
        each = every.join(told, ["anchor", "name"]).select("r1", "r2", "start", F.explode(F.coalesce(F.arrays_zip("froms", "tos"), whole)).alias("x"))
        each = each.select("r1", "r2", (F.col("start") + F.col("x.froms")).alias("f"), (F.col("start") + F.col("x.tos")).alias("t")).distinct()
        per, _ = written(each.groupBy("r1", "r2").agg(F.collect_list(F.struct("f", "t")).alias("x")), "repeats-spans")
        source = rows.withColumns({"r1": r1, "r2": r2}).join(per, ["r1", "r2"], "left").select("doc_id", *rows.columns[2:], F.col("x.f").alias("froms"), F.col("x.t").alias("tos"), "text")
        looked = None
    removed(spark, p_common, p_runs, p_open, p_ranges, *([p_bytes, p_points] if warm is not None else []))
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + f", n_bytes long, starts array<long>, ends array<long>, kept {'string' if as_text else 'binary'}"
    return source.mapInArrow(trimmed(cleaned(length, looked, as_text)), schema).withColumnsRenamed({f"carried_{k}": c for k, c in enumerate(carry)})
