"""Operator 7, telephony audio: mu-law and A-law by lookup, IMA ADPCM with numpy across blocks, resampled PCM.

`decode_media` reads WAVE containers of formats 1 (PCM), 6 (A-law), 7 (mu-law) and 17 (IMA ADPCM) and gives 16-bit PCM at
the wanted rate; `wave_file` writes any of them. The query stores each text's bytes as 8-bit codes in a mu-law file, reads the
file back, stores its PCM resampled to twice the rate as PCM files of bounded length, reads these back, and digests what they
hold; the same bytes stored as A-law and as ADPCM blocks are decoded as well.

Defined results: null text is the empty text, whose payload is 64 zero bytes; equal texts have equal values; null media
decode to null; media of another format or cut short raise ValueError; repeated rows are stored each; other columns are
ignored; an empty table gives an empty result. Long payloads pass through in pieces, so memory does not grow with them beyond
the bytes themselves.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, table

PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
BLOCK_BYTES = 64
#: Bytes decoded at a time.
PIECE = 1 << 20

#: Step sizes of IMA ADPCM, as its specification lists them.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
    209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
    24623, 27086, 29794, 32767])
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def _mu_law() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    x = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -x, x).astype("<i2")


def _a_law() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    e, m = (a >> 4) & 7, ((a & 15) << 4) + 8
    x = np.where(e == 0, m, (m + 256) << np.maximum(e - 1, 0))
    return np.where(a & 128, x, -x).astype("<i2")


MU_LAW_PCM, A_LAW_PCM = _mu_law(), _a_law()


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference and next index for each (index, nibble)."""
    step, nib = STEPS[:, None], np.arange(16)[None, :]
    d = (step >> 3) + np.where(nib & 4, step, 0) + np.where(nib & 2, step >> 1, 0) + np.where(nib & 1, step >> 2, 0)
    nxt = np.clip(np.arange(89)[:, None] + INDEX_STEPS[nib & 7], 0, 88)
    return np.where(nib & 8, -d, d).astype("int32").ravel(), (nxt * 16).astype("int32").ravel()


ADPCM_DIFF, ADPCM_NEXT = _adpcm_tables()


def decode_adpcm(data: np.ndarray, block: int = BLOCK_BYTES) -> np.ndarray:
    """Mono IMA ADPCM blocks to samples, one row a block: each step decodes one nibble of all blocks."""
    b = data.reshape(-1, block)
    out = np.empty((2 * (block - 4) + 1, len(b)), dtype="<i2")
    pred = b[:, :2].copy().view("<i2")[:, 0].astype("int32")
    index = np.minimum(b[:, 2], 88).astype("int32") * 16
    out[0] = pred
    for i, codes in enumerate(np.ascontiguousarray(b[:, 4:].T)):
        for j, nib in enumerate((codes & 15, codes >> 4)):
            at = index + nib
            pred = np.clip(pred + ADPCM_DIFF[at], -32768, 32767)
            index = ADPCM_NEXT[at]
            out[1 + 2 * i + j] = pred
    return np.ascontiguousarray(out.T)


def wave_file(data: bytes, kind: int, rate: int, block: int | None = None) -> bytes:
    """A mono WAVE file that holds data as it is."""
    bits = {PCM: 16, IMA_ADPCM: 4}.get(kind, 8)
    block = block or {PCM: 2}.get(kind, 1)
    per = 2 * (block - 4) + 1 if kind == IMA_ADPCM else 1
    extra = struct.pack("<HH", 2, per) if kind == IMA_ADPCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * block // per, block, bits) + extra
    head = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(data) // block * per) + b"data" + struct.pack("<I", len(data))
    return b"RIFF" + struct.pack("<I", len(head) + len(data) + len(data) % 2) + head + data + b"\0" * (len(data) % 2)


def read_wave(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format, rate, block size, data) of a WAVE file."""
    view, at, fmt = memoryview(media), 12, None
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAVE file")
    while at + 8 <= len(view):
        name, n = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"data":
            if fmt is None or at + 8 + n > len(view):
                break
            return fmt[0], fmt[2], fmt[4], view[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no whole data chunk")


def to_pcm(kind: int, block: int, data: np.ndarray) -> np.ndarray:
    """16-bit samples of data, whole blocks only."""
    if kind == MU_LAW:
        return MU_LAW_PCM[data]
    if kind == A_LAW:
        return A_LAW_PCM[data]
    if kind == PCM:
        return data[: len(data) // 2 * 2].view("<i2")
    if kind == IMA_ADPCM:
        return decode_adpcm(data[: len(data) // block * block], block).ravel()
    raise ValueError(f"format {kind} is not telephony audio")


def resample(x: np.ndarray, rate: int, to: int, following: int | None = None) -> np.ndarray:
    """Linear interpolation at the new rate, in integers. After the last sample comes `following`, or it holds on."""
    if rate == to or not len(x):
        return x
    at = np.arange(-(-len(x) * to // rate), dtype="int64") * rate
    i, part = np.minimum(at // to, len(x) - 1), at % to
    more = np.append(x, x[-1] if following is None else np.asarray(following, x.dtype)).astype("int64")
    return (more[i] + (more[i + 1] - more[i]) * part // to).astype("<i2")


def stored_pcm(media: bytes, to: int, samples: int = PIECE) -> Iterator[bytes]:
    """16-bit PCM files at rate `to` of a WAVE file's sound, each of about `samples` of its samples; one after the other they are the whole sound."""
    kind, rate, block, data = read_wave(media)
    codes = np.frombuffer(data, "uint8")
    unit = block if kind == IMA_ADPCM else {PCM: 2}.get(kind, 1)
    whole = len(codes) // unit
    per = 2 * (block - 4) + 1 if kind == IMA_ADPCM else 1
    # pieces of whole blocks whose samples fall on whole steps of the new rate, so that none moves
    step = rate // math.gcd(rate, to)
    take = max(1, samples // (per * step)) * step
    for a in range(0, max(1, whole), take):
        z = min(whole, a + take)
        pcm = to_pcm(kind, block, codes[a * unit : z * unit])
        nxt = to_pcm(kind, block, codes[z * unit : (z + 1) * unit])[:1] if z < whole else ()
        yield wave_file(resample(pcm, rate, to, int(nxt[0]) if len(nxt) else None).tobytes(), PCM, to)


def decode_media(media: Column, to: int = 16_000) -> Column:
    """Column of WAVE files: each one's 16-bit PCM bytes at rate `to`, itself a WAVE file."""

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        def one(m: bytes | None) -> bytes | None:
            return None if m is None else wave_file(b"".join(bytes(read_wave(p)[3]) for p in stored_pcm(m, to)), PCM, to)

        return pa.array([one(m) for m in col.to_pylist()], pa.binary())

    return run(media)


class Sound:
    """Running features of one stream of 16-bit samples that is fed in pieces."""

    def __init__(self) -> None:
        self.n = self.squares = self.peak = self.crossings = self.crc = 0
        self.last = np.zeros(0, "<i2")

    def feed(self, pcm: np.ndarray) -> None:
        x = pcm.astype("int32")
        self.n += len(x)
        self.squares += int((x.astype("int64") * x).sum())
        self.peak = max(self.peak, int(np.abs(x).max(initial=0)))
        joined = np.concatenate((self.last, pcm))
        self.crossings += int(((joined[1:] < 0) != (joined[:-1] < 0)).sum())
        self.crc = zlib.crc32(pcm.tobytes(), self.crc)
        self.last = joined[-1:].copy()

    def feature(self) -> str:
        return f"rms:{math.isqrt(self.squares // max(1, self.n))};peak:{self.peak};crossings:{self.crossings};crc:{self.crc:08x}"


def feature(media: bytes, to: int) -> str:
    """Features of a stored file's sound, from its resampled PCM as stored and read back, and of its codes read as A-law."""
    sound = Sound()
    for part in stored_pcm(media, to):
        sound.feed(np.frombuffer(read_wave(part)[3], "<i2"))
    _, rate, _, data = read_wave(media)
    crc = 0
    for a in range(0, len(data), PIECE):
        kind, _, block, again = read_wave(wave_file(bytes(data[a : a + PIECE]), A_LAW, rate))
        crc = zlib.crc32(to_pcm(kind, block, np.frombuffer(again, "uint8")).tobytes(), crc)
    return f"pcm{to}:{sound.feature()};alaw:{crc:08x}"


def adpcm_checks(payloads: list[memoryview], rate: int) -> list[int]:
    """A checksum of the sound of each payload (whole blocks) read as ADPCM, decoded across the blocks of all of them."""
    flat = np.frombuffer(b"".join(payloads), "uint8")
    ends = np.cumsum([len(p) for p in payloads]).tolist()
    out, d = [0] * len(payloads), 0
    for at in range(0, len(flat), PIECE):
        kind, _, block, data = read_wave(wave_file(flat[at : at + PIECE].tobytes(), IMA_ADPCM, rate, BLOCK_BYTES))
        sound = to_pcm(kind, block, np.frombuffer(data, "uint8")).reshape(-1, 2 * (block - 4) + 1)
        a = 0
        while a < len(sound):  # a piece may hold many payloads or part of one
            z = min((ends[d] - at) // block, len(sound))
            out[d] = zlib.crc32(sound[a:z], out[d])
            d += ends[d] <= at + z * block
            a = z
    return out


AUDIO = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 8000, to: int = 16_000) -> DataFrame:
    """Each text stored as a mu-law file and read back: digests of the payload and the file, and features of the sound."""

    def rows(ids: list, texts: pa.Array) -> Iterator[tuple]:
        raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]
        media = [wave_file(r + b"\0" * (-len(r) % BLOCK_BYTES if r else BLOCK_BYTES), MU_LAW, rate) for r in raw]
        back = [read_wave(m)[3] for m in media]
        for i, r, m, b, crc in zip(ids, raw, media, back, adpcm_checks(back, rate)):
            yield i, len(r), len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-BLOCK_BYTES:]), len(m), hashlib.sha256(m).hexdigest(), f"{feature(m, to)};adpcm:{crc:08x}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in AUDIO.split(", ")]
        for batch in batches:
            for a, z in slices(batch, 1, PIECE):
                cols = zip(*rows(batch.column(0).slice(a, z - a).to_pylist(), batch.column(1).slice(a, z - a)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), AUDIO)


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_audio(table(spark, sf_dir, "documents"))


QUERIES = {"op7_telephony": op7_telephony}
ORACLE: dict[str, str] = {}
