"""The queries of this subpackage, each over its whole tables with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, lang_id, licenses, lm_score, ngram_join, quality, repeats, shards, telephony
from tessera.llm.common import table

Batches = Iterator[pa.RecordBatch]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def token_digests(batches: Batches) -> Batches:
    """Counts and digests in place of ids and decoded texts."""
    for batch in batches:
        ids = batch.column("ids")
        flat, off = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets)
        sums = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:])]
        back = [hashlib.sha256(t.as_buffer()).hexdigest() for t in batch.column("decoded")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int64()), pa.array(sums), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


TOKEN_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), finish=token_digests, finish_schema=TOKEN_DIGESTS)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), 24)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents"), 200)
    gone = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def media_digests(batches: Batches) -> Batches:
    """Digests of the payload as read back from the stored file, and of the file."""
    for batch in batches:
        files = batch.column("media").to_pylist()
        back = [telephony.unwav(f)[2] for f in files]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column("n_bytes"),
                pa.array(list(map(len, back)), pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()),
                pa.array(list(map(len, files)), pa.int64()),
                pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                batch.column("feature"),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return telephony.audio_columns(table(spark, sf_dir, "documents"), finish=media_digests, finish_schema=schema)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_bpe, op3_licenses, op4_decontaminate, op5_quality, op6_shards, op7_language, op8_repeats, op9_telephony, op10_lm_score)}

NGRAM_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
r AS (SELECT x AS doc_id, x AS o FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, coalesce(min(r.o), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id"""

ORACLE_SQL = {"op1_ngram_join": NGRAM_SQL, "op3_licenses": licenses.oracle(), "op4_decontaminate": decontaminate.ORACLE}
