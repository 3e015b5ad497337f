"""Byte-level BPE over a table of distinct words: encode each word once, join the ids back by position, decode by id."""

from __future__ import annotations

import functools
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, released, removed, shared_dir, tidy, trimmed, written

#: Unicode White_Space, which the tokenizer's own pattern splits at, as a class of Java's patterns.
SPACE = r"\s\x85\p{Z}"
#: Texts of more bytes are split chunk by chunk.
CHUNK = 1 << 20
Batches = Iterator[pa.RecordBatch]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str, _made: dict = {}):  # noqa: B006  one for each worker process
    if path not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation(), t.no_padding()
        _made[path] = t
    return _made[path]


def specials(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def chunks(text: Column) -> Column:
    """The text in pieces of about CHUNK characters, cut only between a word's end and white space."""
    return F.when(F.octet_length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{{CHUNK}}}[{SPACE}]*+[^{SPACE}]++|.+"), F.lit(0)))


def words(text: Column, marks: list[str]) -> Column:
    """The words of a text, in order; joined they are the text.

    A word is a run of other characters with the one blank before it; white space left over is a word too. The tokenizer never
    merges across these borders, nor does a word's split depend on its neighbours, so ids of words in order are ids of the text.
    The strings of added tokens stand alone, as the tokenizer looks for them first.
    """

    def all_of(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    plain = all_of(rf" ?[^{SPACE}]++|[{SPACE}]++(?![^{SPACE}])|[{SPACE}]+(?=[{SPACE}])|[{SPACE}]")
    if not marks:
        return plain
    mark = "|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True))
    one = rf"(?:(?!{mark})[^{SPACE}])"
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(text, F.lit(m))
    return F.when(found, all_of(rf"{mark}| ?{one}+|[{SPACE}]+(?!{one})|[{SPACE}]")).otherwise(plain)


def planes(codes: np.ndarray) -> bytes:
    """Codes as bytes, their lowest bytes first, so that files keep them small."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def pack(codes: np.ndarray, strings: pa.StringArray) -> bytes:
    """Codes and their words as one compressed value."""
    data = b"".join(x.encode() for x in strings.to_pylist())
    lengths = pc.binary_length(strings).to_numpy()
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(codes)], "<u4").tobytes() + planes(codes) + planes(lengths) + data)


def unpacked(batches: Batches) -> Batches:
    """The rows (slice, code, word) that pack() put together."""
    for batch in batches:
        for name, blob in zip(batch.column("slice").to_pylist(), batch.column("codes")):
            data = zstandard.ZstdDecompressor().decompress(blob.as_buffer())
            n = int(np.frombuffer(data, "<u4", 1)[0])
            codes, lengths = (from_planes(data[4 + 4 * n * k : 4 + 4 * n * (k + 1)]) for k in (0, 1))
            cuts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            word = pa.StringArray.from_buffers(n, pa.py_buffer(cuts), pa.py_buffer(data[4 + 8 * n :]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(codes, pa.int32()), word], ["slice", "code", "word"])


def spark_hash(strings: pa.StringArray, most: int = 4096) -> np.ndarray:
    """What Spark's hash() gives strings of up to `most` bytes (32-bit Murmur3 with seed 42, the last bytes one by one)."""
    offset = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] is not None else np.zeros(0, np.uint8)
    size, h = np.diff(offset), np.full(len(strings), 42, np.uint32)

    def turned(x: np.ndarray, r: int) -> np.ndarray:
        return (x << np.uint32(r)) | (x >> np.uint32(32 - r))

    def mixed(at: np.ndarray, k: np.ndarray) -> None:
        k = turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h[at] = turned(h[at] ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)

    for k in range(min(int(size.max(initial=0)), most) // 4):
        at = np.flatnonzero(size >= 4 * k + 4)
        b = [data[offset[at] + 4 * k + j].astype(np.uint32) << np.uint32(8 * j) for j in range(4)]
        mixed(at, b[0] | b[1] | b[2] | b[3])
    for j in range(3):
        at = np.flatnonzero(size % 4 > j)
        mixed(at, data[offset[at] + size[at] // 4 * 4 + j].view(np.int8).astype(np.int32).view(np.uint32))
    h ^= size.astype(np.uint32)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h.view(np.int32)


def sliced(kind: pa.DataType, most: int, buckets: int):
    """Slices of texts: a row "doc" for each piece of a text, its words as codes, and a row "words" for each bucket `at` that
    Spark puts words of the slice in, packed with their codes (see pack()). A text with all its pieces stays in one slice."""

    def run(batches: Batches) -> Batches:
        dicts, held_codes, counts, rows, size, done, at = [], [], [], [], 0, 0, -1  # of a slice's batches; words are held once a batch

        def closed() -> Batches:
            name = (TaskContext.get().partitionId() << 32) + done
            d = pa.concat_arrays(dicts).dictionary_encode()
            codes_of = np.split(d.indices.to_numpy(zero_copy_only=False), np.cumsum([len(x) for x in dicts])[:-1])
            dicts.clear()
            often = np.zeros(len(d.dictionary), np.int64)
            for all_, code in zip(codes_of, held_codes):
                often[all_] += np.bincount(code, minlength=len(all_))
            order = np.argsort(-often, kind="stable")  # frequent words get small codes
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            columns = ["what", "slice", "at", "part", "doc_id", "codes"]
            for k, (all_, row, count) in enumerate(zip(codes_of, rows, counts)):
                parts = np.split(rank[all_][held_codes[k]], np.cumsum(count)[:-1])
                held_codes[k], n = None, len(row)
                yield pa.RecordBatch.from_arrays([pa.array(["doc"] * n), pa.array(np.full(n, name)), *row.columns, pa.array([planes(p) for p in parts], pa.binary())], columns)
            bucket = spark_hash(d.dictionary) % buckets
            order = pc.sort_indices(d.dictionary).to_numpy()  # neighbours look alike, which keeps the shuffle small
            order = order[np.argsort(bucket[order], kind="stable")]
            b = bucket[order]
            first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))[: len(b)]
            held, codes = d.dictionary.take(pa.array(order)), rank[order]
            blobs = [pack(codes[i:j], held.slice(i, j - i)) for i, j in zip(first, np.append(first[1:], len(b)))]
            k = len(first)
            yield pa.RecordBatch.from_arrays([pa.array(["words"] * k, pa.string()), pa.array(np.full(k, name)), pa.array(b[first], pa.int64()), pa.array(np.zeros(k, np.int32)), pa.nulls(k, kind), pa.array(blobs, pa.binary())], columns)

        for batch in batches:
            part, octets = (np.asarray(batch.column(c)) for c in ("part", "octets"))
            begin = 0
            while begin < len(batch):
                if part[begin] == 0 and size > most:
                    yield from closed()
                    released()
                    dicts, held_codes, counts, rows, size, done = [], [], [], [], 0, done + 1
                    at = -1
                end = len(batch)
                room = size + np.cumsum(octets[begin:])  # up to the first text that fills the slice
                full = np.flatnonzero((room > most) & np.append(part[begin + 1 :] == 0, True))
                if len(full):
                    end = begin + int(full[0]) + 1
                some = batch.slice(begin, end - begin)
                texts = at + np.cumsum(part[begin:end] == 0)
                at = int(texts[-1])
                w = some.column("words")
                d = w.flatten().dictionary_encode()
                dicts.append(d.dictionary)
                held_codes.append(d.indices.to_numpy(zero_copy_only=False))
                counts.append(np.asarray(w.value_lengths()))
                rows.append(pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), some.column("part"), some.column("doc_id")], ["at", "part", "doc_id"]))
                size = int(room[end - begin - 1])
                begin = end
        if rows:
            yield from closed()

    return run


def encoder(path: str):
    @F.arrow_udf("array<int>")
    def encode(word: pa.Array) -> pa.Array:
        ids = [e.ids for e in tokenizer(path).encode_batch_fast(word.to_pylist(), add_special_tokens=False)]
        return pa.array(ids, pa.list_(pa.int32()))

    return encode


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """The pieces flat[start : start + length], one after the other; places are worked out for `block` pieces at a time."""
    ends = np.cumsum(lengths, dtype=np.int64)
    if not len(ends):
        return flat[:0]
    out, done = np.empty(ends[-1], flat.dtype), 0
    for k in range(0, len(ends), block):
        upto = ends[min(k + block, len(ends)) - 1]
        at = np.repeat(starts[k : k + block] - ends[k : k + block] + lengths[k : k + block], lengths[k : k + block])
        at += np.arange(done, upto)
        flat.take(at, out=out[done:upto], mode="clip")
        done = upto
    return out


@functools.cache
def pieces(path: str) -> pa.Table:
    """(id, piece): the bytes of every id. A byte-level vocabulary writes each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocab, marks = tokenizer(path).get_vocab(with_added_tokens=True), set(specials(path))
    made = [piece.encode() if piece in marks or any(c not in letters for c in piece) else bytes(letters[c] for c in piece) for piece in vocab]
    return pa.table({"id": pa.array(vocab.values(), pa.int32()), "piece": pa.array(made, pa.binary())})


def texts_of(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Strings from their bytes in a row; bytes that are not UTF-8 become replacement characters."""
    out = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])], pa.string())
    return out


def packed(most: int = 1 << 20):
    """Rows of (slice, code, ids) with those of one slice together, as bytes: from about `most` rows at a time."""

    def closed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        name, code = (t.column(c).to_numpy() for c in ("slice", "code"))
        ids = pa.concat_arrays(t.column("ids").chunks)
        length, flat = np.asarray(ids.value_lengths(), np.int64), np.asarray(ids.flatten())
        order = np.lexsort((code, name))
        flat, length, code, name = gather(flat, (np.cumsum(length) - length)[order], length[order]), length[order], code[order], name[order]
        first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        cuts, ends = first[1:], np.cumsum(length)
        columns = [map(planes, x) for x in (np.split(code, cuts), np.split(length, cuts), np.split(flat, ends[cuts - 1]))]
        return pa.RecordBatch.from_arrays([pa.array(name[first]), *(pa.array(list(c), pa.binary()) for c in columns)], ["slice", "code", "length", "ids"])

    def run(batches: Batches) -> Batches:
        held, n = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n > most:
                yield closed(held)
                held, n = [], 0
        if held:
            yield closed(held)

    return run


def assembled(path: str, out: pa.Schema, finish: Callable[[Batches], Batches] | None, words_each: int = 1 << 17):
    """Of one slice: its texts' codes and its words' ids become (doc_id, ids, decoded), about words_each words at a time."""

    def solve(texts: pa.Table, found: pa.Table) -> Batches:
        order = pc.sort_indices(texts.select(["at", "part"]), sort_keys=[("at", "ascending"), ("part", "ascending")])
        at, doc_id, blobs = texts.column("at").to_numpy(), texts.column("doc_id").combine_chunks(), texts.column("codes")
        if (np.diff(order.to_numpy().view(np.int64)) < 0).any():  # else codes are not held twice
            at, doc_id, blobs = at[order.to_numpy()], doc_id.take(order), blobs.take(order)
        del order
        code, length, flat = (np.concatenate([np.zeros(0, np.int32), *(from_planes(b.as_buffer()) for b in found.column(c))]) for c in ("code", "length", "ids"))
        order = np.argsort(code)
        if len(code) and not (code[order] == np.arange(len(code))).all():
            raise ValueError("a slice's words and their ids don't agree")
        begin = (np.cumsum(length, dtype=np.int64) - length)[order]
        length = length[order]
        del code, order
        # the pieces of the slice's ids
        place = np.zeros(flat.max(initial=-1) + 1, np.int32)
        place[flat] = 1
        used = np.flatnonzero(place).astype(np.int32)
        place[used] = np.arange(len(used))
        joined = pa.table({"id": used}).join(pieces(path), "id", use_threads=False).sort_by("id")
        if joined.column("piece").null_count:
            raise ValueError("the vocabulary lacks an id of its own tokenizer")
        place = place[flat]
        del flat
        piece = joined.column("piece").to_pylist()
        bytes_ = np.frombuffer(b"".join(piece), np.uint8)
        piece_length = np.fromiter(map(len, piece), np.int32, len(piece))
        piece_start = np.cumsum(piece_length, dtype=np.int32) - piece_length
        sizes = pc.binary_length(blobs).to_numpy().astype(np.int64) // 4
        fresh = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))  # the first piece of each text
        per = np.add.reduceat(sizes, fresh)
        group = np.cumsum(per) // words_each
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            lo, hi = fresh[mine[0]], fresh[mine[-1] + 1] if mine[-1] + 1 < len(fresh) else len(at)
            codes = np.concatenate([from_planes(b.as_buffer()) for b in blobs.slice(lo, hi - lo)])
            tokens = length[codes]
            where = gather(place, begin[codes], tokens)
            ends = np.concatenate(([0], np.cumsum(tokens)))[np.concatenate(([0], np.cumsum(per[mine])))]
            size = piece_length[where]
            data = gather(bytes_, piece_start[where], size)
            cuts = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[ends]
            yield pa.RecordBatch.from_arrays(
                [doc_id.take(pa.array(fresh[mine])), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(used[where], pa.int32())), texts_of(data, cuts)],
                ["doc_id", "ids", "decoded"],
            )

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        got = solve(texts, found) if len(texts) else iter(())
        batches = list(finish(got) if finish else got)
        released()
        return pa.Table.from_batches(batches).cast(out) if batches else out.empty_table()

    return run


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", *, finish: Callable[[Batches], Batches] | None = None, finish_schema: str = "", slice_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row: the ids that the tokenizer of `path` gives the whole text
    without special tokens added (their strings in a text do become their ids), and the text that these ids decode to.

    1. Spark splits the texts into words. Slices of about slice_bytes bytes keep each distinct word once, and texts as the words'
       places in their slice; so no occurrence of a word is shuffled, and a frequent word has a row a slice.
    2. The slices' words are bucketed by word. The distinct words of a bucket are encoded, each once, and joined back to the
       slices' places; neither needs a shuffle.
    3. The ids go back to their slices by a shuffle, the texts stay where the slices were bucketed. The ids of a slice are
       joined to their pieces, and texts are put together by place.

    Null text counts as empty: no ids, "". Repeated rows and null ids are kept; an empty table gives no rows; other columns
    are not looked at. Long texts are split in pieces, but all pieces of a text meet in one task at the end. `finish` turns
    batches of (doc_id, ids, decoded) into others of doc_id and `finish_schema` in the same Python stage. The result is
    written; tables on the way are deleted.
    """
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    spark = docs.sparkSession
    path = path or default_path()
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names, base = {k: f"tessera_{k}_{uuid.uuid4().hex}" for k in ("slices", "words", "table")}, shared_dir(spark)

    def saved(df: DataFrame, name: str, by: str, *folders: str) -> DataFrame:
        """The table, bucketed in the shared folder, so that neither join nor grouping by the column shuffles it again."""
        writer = df.write.option("compression", "zstd").option("path", f"{base}/{names[name]}").bucketBy(n, by).sortBy(by)
        with tidy(spark):
            (writer.partitionBy(*folders) if folders else writer).saveAsTable(names[name])
        return spark.table(names[name])

    marks = specials(path)
    whole = any(re.search(r"\s", m) for m in marks)  # such a mark must not be cut
    text = F.coalesce(F.col("text"), F.lit(""))
    split = rows.select("doc_id", F.posexplode(F.array(text) if whole else chunks(text)).alias("part", "text")).select("doc_id", "part", F.octet_length("text").alias("octets"), words(F.col("text"), marks).alias("words"))
    arrow = to_arrow_schema(rows.select("doc_id").schema).field(0).type
    try:
        slices = saved(split.mapInArrow(trimmed(sliced(arrow, slice_bytes, n)), f"what string, slice long, at long, part int, doc_id {kind}, codes binary"), "slices", "slice", "what")
        places = slices.where("what = 'words'").select("slice", F.col("at").cast("int").alias("at"), "codes").repartitionById(n, F.col("at"))
        places = places.select("slice", "codes").mapInArrow(trimmed(unpacked), "slice long, code int, word string")
        places = saved(places, "words", "word")
        removed(spark, f"{base}/{names['slices']}/what=words")
        saved(places.select("word").distinct().withColumn("ids", encoder(path)("word")), "table", "word")
        found = places.hint("merge").join(spark.table(names["table"]), "word").select("slice", "code", "ids").mapInArrow(trimmed(packed()), "slice long, code binary, length binary, ids binary")
        texts = spark.table(names["slices"]).where("what = 'doc'").select("slice", "at", "part", "doc_id", "codes")
        schema = f"doc_id {kind}, " + (finish_schema or "ids array<int>, decoded string")
        shape = to_arrow_schema(spark.createDataFrame([], schema).schema)
        out, _ = written(texts.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(assembled(path, shape, finish), from_arrow_schema(shape)), "bpe-out")
    finally:
        for name in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(spark, f"{base}/{name}")
    return out
