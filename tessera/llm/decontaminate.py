"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, removed, row_key, written

SHINGLE = 5
BITS = 64


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(w: Column, size: int) -> Column:
    """A hash of every `size` neighbouring words, in order."""
    n = F.size(w) - size + 1
    every = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, size)), F.lit(size)))
    return F.when(n > 0, F.slice(every, F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of the weighted hashes (keys, h, c): bit b is set where the weights of hashes with the bit outweigh the rest."""
    sums = rows.groupBy(*keys).agg(*(F.sum(F.col("c") * (F.shiftright("h", b).bitwiseAND(F.lit(1)) * 2 - 1)).alias(f"s{b}") for b in range(BITS)))
    bit = [F.when(F.col(f"s{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(BITS)]
    whole = bit[0].cast("bigint")
    for x in bit[1:]:
        whole = whole.bitwiseOR(x.cast("bigint"))
    return sums.select(*keys, whole.alias("print"))


def blocks(radius: int) -> Column:
    """The print cut into radius + 1 blocks: prints that differ in at most `radius` bits agree in one of them."""
    cuts = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, num: int = 80, den: int = 100, radius: int = 27, broadcast_rows: int = 1 << 20, row_keys: bool = False) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): a row for every document and benchmark item that it holds.

    A document holds an item where a window of as many words as the item has den * |shared| >= num * |union|, both counted over
    the multisets of five-word shingles (an item of fewer words is one shingle). Windows are taken at every start, but for those
    with fewer shared shingles than the similarity needs even if each counts; so the order of an item's parts does not matter.
    start_word and similarity are those of the best; of equals the first at which a shared shingle stands in the same place of
    window and item, or the first if there is none. Such a pair has a SimHash distance of about 10 of 64 bits at 0.8, with a spread of 3;
    `radius` is more than 5 spreads above, which is no proof that no pair is lost (the tests measure it). Only built-in functions. What is broadcast (the items' shingles, the windows' rows) is counted
    before; beyond broadcast_rows rows Spark joins it otherwise. With `row_keys` the distinct (r1, r2) of the rows that hold an
    item instead (see row_key()).

    Null, empty and wordless texts and items hold nothing; repeated rows (equal in id and text) give their rows once, as do
    items of one id and text; null ids stay null; an empty table gives no rows; other columns are not looked at.
    """

    def hinted(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    spark = docs.sparkSession
    items = only(benchmark, item_id=item_col, text=item_text).select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0").dropDuplicates(["item_id", "item"])
    items = items.withColumns({"n": F.size("w"), "size": F.least(F.size("w"), F.lit(SHINGLE))})
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    rows = only(docs, doc_id=id_col, text=text_col).where("text is not null").withColumn("r", F.struct(*row_key()))
    if not sizes:
        return spark.createDataFrame([], "r1 long, r2 long" if row_keys else "doc_id long, item_id long, start_word long, similarity double")
    parts = [items.where(F.col("size") == k).select("item_id", "item", "n", "size", F.posexplode(shingle_hashes(F.col("w"), k)).alias("offset", "h")) for k in sizes]
    shingles, p_shingles = written(_union(parts), "decon-items")
    lookup = hinted(shingles.select("h", "item", "n", "size", "offset").distinct())
    text = rows.select("doc_id", "r", words(F.col("text")).alias("w")).where("size(w) > 0")
    hits = [text.select("doc_id", "r", F.size("w").alias("long"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("at", "h")) for k in sizes]
    hits = _union(hits).join(lookup, "h")
    start = F.greatest(F.least(F.col("at") - F.col("offset"), F.col("long") - F.col("n")), F.lit(0))
    hits = hits.groupBy("doc_id", "r", "long", "item", "n", "size").agg(F.sort_array(F.collect_set("at")).alias("ats"), F.collect_set(start).alias("aligned"))
    # shared shingles that a window must hold: both * den >= num * (total + item_total - both)
    hits = hits.withColumn("total", F.least("long", "n") - F.col("size") + 1)
    hits = hits.withColumn("need", F.expr(f"int(({num} * (total + n - size + 1) + {num + den - 1}) div {num + den})")).where("size(ats) >= need")

    def holding(j: Column) -> Column:
        """The starts of the windows that hold the shared shingles j to j + need - 1."""
        low = F.greatest(F.get("ats", j + F.col("need") - 1) - F.col("total") + 1, F.lit(0))
        high = F.least(F.get("ats", j), F.greatest(F.col("long") - F.col("n"), F.lit(0)))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("ats") - F.col("need")), holding)))
    windows = hits.select("doc_id", "r", "item", "n", "size", "aligned", F.explode(starts).alias("start"))
    windows, p_windows = written(windows.withColumn("aligned", F.array_contains("aligned", F.col("start"))), "decon-windows")
    # the windows' shingles, from the texts that have windows
    taken = windows.groupBy("r").agg(F.collect_set(F.struct("n", "size", "start")).alias("x"))
    held = rows.join(hinted(taken), "r").dropDuplicates(["r"]).select("r", words(F.col("text")).alias("w"), "x")
    cut = [
        held.select("r", shingle_hashes(F.col("w"), k).alias("hs"), F.expr(f"filter(x, y -> y.size = {k})").alias("x"))
        .select("r", "hs", F.explode("x").alias("x"))
        .select("r", "x.*", F.explode(F.slice("hs", F.col("x.start") + 1, F.col("x.n") - F.col("x.size") + 1)).alias("h"))
        for k in sizes
    ]
    key = ["r", "n", "size", "start"]
    counts, p_counts = written(_union(cut).groupBy(*key, "h").agg(F.count("*").alias("c")), "decon-counts")
    item_counts = shingles.groupBy("item_id", "item", "n", "size", "h").agg(F.count("*").alias("c"))
    item_key = ["item_id", "item", "n", "size"]
    # a window is compared with the items whose shared shingles it was taken for: it shares too few with all others
    near = fingerprint(counts, key).join(windows.select(*key, "item").distinct(), key).withColumn("x", F.explode(blocks(radius))).select(*key, "item", "print", "x.*")
    item_near = fingerprint(item_counts, item_key).withColumn("x", F.explode(blocks(radius))).select(*item_key, F.col("print").alias("item_print"), "x.*")
    pairs = near.join(hinted(item_near), ["item", "n", "size", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    pairs, p_pairs = written(pairs.select(*key, "item_id", "item").distinct(), "decon-pairs")
    weights = counts.groupBy(*key).agg(F.sum("c").alias("total")).join(pairs, key)
    weights = weights.join(hinted(item_counts.groupBy(*item_key).agg(F.sum("c").alias("item_total"))).drop("item_id"), ["item", "n", "size"])
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    shared = pairs.alias("p").join(counts.alias("c"), _all(same)).select("p.*", "c.h", "c.c")
    shared = shared.join(hinted(item_counts.select("item", "n", "size", "h", F.col("c").alias("k"))), ["item", "n", "size", "h"]).groupBy(*key, "item_id", "item").agg(F.sum(F.least("c", "k")).alias("both"))
    joined = shared.alias("a").join(weights.alias("b"), _all([F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*key, "item_id", "item"]])).select("a.*", "b.total", "b.item_total")
    union = F.col("total") + F.col("item_total") - F.col("both")
    best = F.max_by(F.struct((F.col("both") / union).alias("similarity"), F.col("start").cast("long").alias("start_word")), F.struct(F.col("both") / union, F.coalesce("aligned", F.lit(False)), -F.col("start")))
    joined = joined.where(F.col("both") * den >= union * num)
    if row_keys:
        found, _ = written(joined.select("r.r1", "r.r2").distinct(), "decon-found")
        removed(spark, p_shingles, p_windows, p_counts, p_pairs)
        return found
    joined = joined.join(windows.select("r", "doc_id").distinct(), "r")
    joined = joined.join(windows.select("r", "item", "start", "aligned").distinct(), ["r", "item", "start"], "left")
    found = joined.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start_word", "b.similarity")
    found, _ = written(found, "decon-found")
    removed(spark, p_shingles, p_windows, p_counts, p_pairs)
    return found


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


#: The same in DuckDB's SQL, over the windows at every start of all texts that share a shingle with an item of five words or
#: more, without fingerprints.
ORACLE = r"""
WITH items AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
docs AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
ishing AS (SELECT item_id, len(w) AS n, unnest(range(len(w) - 4)) AS o, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM items WHERE len(w) >= 5),
dshing AS (SELECT doc_id, len(w) AS long, unnest(range(len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM docs WHERE len(w) >= 5),
ic AS (SELECT item_id, s, count(*) AS k FROM ishing GROUP BY ALL),
pairs AS (SELECT DISTINCT d.doc_id, i.item_id, i.n, d.long FROM dshing d JOIN ishing i ON d.s = i.s),
hits AS (SELECT d.doc_id, ic.item_id, ic.s, ic.k, d.p FROM dshing d JOIN ic ON d.s = ic.s),
aligned AS (SELECT DISTINCT d.doc_id, i.item_id, greatest(least(d.p - i.o, d.long - i.n), 0) AS start FROM dshing d JOIN ishing i ON d.s = i.s),
wins AS (SELECT doc_id, item_id, n, long, unnest(range(greatest(long - n, 0) + 1)) AS start FROM pairs),
wc AS (SELECT w.doc_id, w.item_id, w.n, w.long, w.start, h.s, least(count(*), any_value(h.k)) AS b FROM wins w JOIN hits h ON h.doc_id = w.doc_id AND h.item_id = w.item_id AND h.p >= w.start AND h.p < w.start + w.n - 4 GROUP BY ALL),
j AS (SELECT doc_id, item_id, start, sum(b) AS b, least(any_value(long), any_value(n)) - 4 + any_value(n) - 4 AS t FROM wc GROUP BY ALL),
k AS (SELECT j.doc_id, j.item_id, j.start, j.b / (j.t - j.b) AS sim, a.start IS NOT NULL AS aligned FROM j LEFT JOIN aligned a ON a.doc_id = j.doc_id AND a.item_id = j.item_id AND a.start = j.start WHERE j.b * 100 >= 80 * (j.t - j.b))
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, CAST(sim AS DOUBLE) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, aligned DESC, start) AS r FROM k) WHERE r = 1"""
