"""Telephony audio columns: mu-law and A-law tables, IMA ADPCM blocks decoded across blocks, resampled PCM."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import only, text_views, trimmed

Batches = Iterator[pa.RecordBatch]
RATE = 8000
BLOCK = 192  # bytes of an ADPCM block: a header of 4, two samples in each other byte

#: Index steps by the low three bits of a code, and the steps of the public IMA ADPCM format (fixed values).
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
    143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
    1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def _mu_law() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    value = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -value, value).astype(np.int16)


def _a_law() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    step, value = (code >> 4) & 7, ((code & 15) << 4) + 8
    value = np.where(step > 0, (value + 256) << np.maximum(step - 1, 0), value)
    return np.where(code & 0x80, value, -value).astype(np.int16)


MU_LAW, A_LAW = _mu_law(), _a_law()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM: rows of BLOCK bytes to rows of samples, one step of all blocks at a time."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    body = blocks[:, 4:]
    codes = np.empty((2 * body.shape[1], len(blocks)), np.int32)
    codes[::2], codes[1::2] = (body & 15).T, (body >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        step = STEPS[index]
        low = code & 7
        move = ((2 * low + 1) * step) >> 3
        value += np.where(code & 8, -move, move)
        np.clip(value, -32768, 32767, out=value)
        out[k + 1] = value
        index += INDEX_STEP[low]
        np.clip(index, 0, 88, out=index)
    return out.T


def _between(taps: int = 6) -> np.ndarray:
    """Weights of the samples on both sides of the middle between two: a windowed sinc, whose sum is 1."""
    at = np.arange(taps) + 0.5
    half = np.sinc(at) * np.cos(np.pi * at / (2 * taps + 1)) ** 2
    return (half / (2 * half.sum())).astype(np.float32)


BETWEEN = _between()


def doubled(pcm: np.ndarray) -> np.ndarray:
    """To twice the rate by a half-band filter in two phases: the samples themselves, and between two of them the weighted
    sum of their neighbours. Beyond both ends the last sample goes on."""
    n, far = len(pcm), len(BETWEEN)
    x = np.empty(n + 2 * far, np.float32)
    x[:far], x[far : far + n], x[far + n :] = pcm[:1], pcm, pcm[-1:]
    middle = np.zeros(n, np.float32)
    for k, w in enumerate(BETWEEN):
        middle += w * (x[far - k : far - k + n] + x[far + 1 + k : far + 1 + k + n])
    out = np.empty(2 * n, np.int16)
    out[::2] = pcm
    out[1::2] = np.clip(np.rint(middle), -32768, 32767)
    return out


def wav(data: bytes, tag: int, bits: int, rate: int) -> bytes:
    """A mono RIFF WAVE file: tag 1 PCM, 6 A-law, 7 mu-law. Data of odd length gets the pad byte of the format."""
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * bits // 8, bits // 8, bits, 0)
    fact = struct.pack("<4sII", b"fact", 4, len(data) * 8 // bits)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def unwav(file: bytes) -> tuple[int, int, bytes]:
    """Tag, rate and data of a WAVE file, by its chunks."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(file):
        name, size = struct.unpack_from("<4sI", file, at)
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", file, at + 8)
        elif name == b"data":
            return tag, rate, file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK)


def feature(codes: np.ndarray, pcm: bytes, decoded: np.ndarray) -> str:
    """Root mean squares by both laws, peak, zero crossings, checksums of the ADPCM samples and of the resampled PCM."""
    mu, a = MU_LAW[codes].astype(np.int64), A_LAW[codes].astype(np.int64)
    crossings = int(np.count_nonzero((mu[1:] < 0) != (mu[:-1] < 0)))
    return f"mu_rms={np.sqrt((mu * mu).mean()):.3f};a_rms={np.sqrt((a * a).mean()):.3f};peak={int(np.abs(mu).max())};crossings={crossings};adpcm_crc={zlib.crc32(np.ascontiguousarray(decoded).tobytes())};pcm16k_crc={zlib.crc32(pcm)}"


def stored(finish: Callable[[Batches], Batches] | None):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, data, off in text_views(batch):
                media = [wav(padded(data[off[i] : off[i + 1]].tobytes()), 7, 8, RATE) for i in range(len(rows))]
                codes = [np.frombuffer(unwav(m)[2], np.uint8) for m in media]
                ends = np.cumsum([0, *(len(c) // BLOCK for c in codes)])
                blocks = adpcm(np.concatenate(codes).reshape(-1, BLOCK))
                pcm = [wav(doubled(MU_LAW[c]).tobytes(), 1, 16, 2 * RATE) for c in codes]
                text = [feature(c, p, blocks[a:b]) for c, p, a, b in zip(codes, pcm, ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(off)), pa.array(media, pa.binary()), pa.array(pcm, pa.binary()), pa.array(text, pa.string())],
                    ["doc_id", "n_bytes", "media", "pcm", "feature"],
                )

    return (lambda batches: finish(run(batches))) if finish else run


def audio_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, finish: Callable[[Batches], Batches] | None = None, finish_schema: str = "") -> DataFrame:
    """(doc_id, n_bytes, media, pcm, feature) for every row: the text's UTF-8 bytes, blanks appended up to a positive multiple
    of 192, kept as mu-law samples in a WAVE file (`media`, 8 kHz, lossless), the expanded samples at 16 kHz as a PCM WAVE
    file (`pcm`), and features of the samples as read back from `media`.

    Null text counts as empty: one block of blanks. Equal texts give equal values; repeated rows and null ids are kept; an
    empty table gives no rows; other columns are not looked at. `finish` turns the batches into others of `finish_schema`.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(stored(finish)), f"doc_id {kind}, " + (finish_schema or "n_bytes long, media binary, pcm binary, feature string"))
