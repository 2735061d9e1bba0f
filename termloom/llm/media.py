"""Telephony audio: mu-law, A-law and IMA ADPCM in WAV files, decoded with numpy to resampled PCM.

mu-law and A-law expand by lookup tables; ADPCM steps through the samples of a block for all blocks at once. PCM is
resampled by a rational factor with a windowed-sinc kernel, for all files of a batch at once, and stored as a WAV file
beside the coded one; features come from both as they are read back.

Defined results: a null text is an empty payload, which is padded to one multiple like any other; repeated
rows give equal files; a very long text is a long file, worked on with a batch of few others; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of

RATE, UNIT = 8000, 576
#: An ADPCM block: predictor, step index, a reserved byte, then 32 bytes of two samples each.
BLOCK = 36
PCM_FORMAT, MULAW_FORMAT, ALAW_FORMAT, ADPCM_FORMAT = 1, 7, 6, 0x11
#: Resampling of the stored PCM: 8 kHz to 2 kHz. Other factors are parameters.
UP, DOWN = 1, 4
#: Zero crossings of the kernel on each side.
LOBES = 8
#: Bytes of payload that are decoded at once.
CHUNK = 4 << 20


def _mulaw_table() -> np.ndarray:
    c = ~np.arange(256) & 0xFF
    v = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
    return np.where(c & 128, -v, v).astype(np.int16)


def _alaw_table() -> np.ndarray:
    c = np.arange(256) ^ 0x55
    e, m = c >> 4 & 7, c & 15
    v = np.where(e == 0, (m << 4) + 8, (m << 4) + 264 << np.maximum(e - 1, 0))
    return np.where(c & 128, v, -v).astype(np.int16)


def _step_table() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM. Fixed values."""
    return np.array(
        [
            7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
            130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
            1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
            7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
        ],
        np.int32,
    )


MULAW, ALAW = _mulaw_table(), _alaw_table()
_STEP = _step_table()
_NIBBLE = np.arange(16)
#: By 16 * step index + nibble: what is added to the predictor, and 16 * the next step index.
_DIFF = sum(np.where(_NIBBLE & bit, _STEP[:, None] >> shift, 0) for bit, shift in ((4, 0), (2, 1), (1, 2))) + (_STEP[:, None] >> 3)
DIFF = np.where(_NIBBLE & 8, -_DIFF, _DIFF).astype(np.int32).ravel()
NEXT = (np.clip(np.arange(89)[:, None] + np.array([-1, -1, -1, -1, 2, 4, 6, 8])[_NIBBLE & 7], 0, 88) * 16).astype(np.int32).ravel()


def expand(codes: np.ndarray, law: int = MULAW_FORMAT) -> np.ndarray:
    return (MULAW if law == MULAW_FORMAT else ALAW)[codes]


def decode_adpcm(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples (blocks, 1 + 2 * (block - 4)) of whole blocks."""
    b = data.reshape(-1, block)
    value = b[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(b[:, 2], 88).astype(np.int32) * 16
    out = np.empty((1 + 2 * (block - 4), len(b)), np.int16)
    out[0] = value
    for k in range(block - 4):
        byte = np.ascontiguousarray(b[:, 4 + k])
        for at, nibble in ((2 * k + 1, byte & 15), (2 * k + 2, byte >> 4)):
            index += nibble
            value += DIFF[index]
            np.clip(value, -32768, 32767, out=value)
            index = NEXT[index]
            out[at] = value
    return out.T


def kernel(up: int, down: int) -> np.ndarray:
    """Taps of a windowed sinc at ``up`` times the rate, cut off at the lower of both rates' halves; an odd number."""
    wide = max(up, down)
    half = LOBES * wide
    t = np.arange(-half, half + 1) / wide
    taps = np.sinc(t) * np.hanning(2 * half + 3)[1:-1]
    return taps * up / taps.sum()


def resampled(x: np.ndarray, length: np.ndarray, up: int = UP, down: int = DOWN) -> tuple[np.ndarray, np.ndarray]:
    """(samples, their numbers) of signals one after another, each by itself; outside a signal is silence. ceil(n * up / down) samples of n."""
    taps = kernel(up, down)
    half = len(taps) // 2
    count = -(-length * up // down)
    # Every signal has silence before and behind it, as wide as the kernel reaches, and starts at a multiple of down behind
    # the first, so that one grid serves them all.
    gap = -(-half // up) + 1
    room = -(-(length + 2 * gap) // down) * down
    grid = (np.cumsum(room) - room) // down
    total = int(room.sum()) // down
    silent = np.zeros(total * down + 4 * gap + (up + 1) * down, np.float64)
    silent[_spread(2 * gap + grid * down, length)] = x
    out = np.zeros(int(count.sum()), np.int16)
    first = np.cumsum(count) - count
    for r in range(up):
        # Samples r, r + up, ... lie at equal places between two of the signal's: they share their taps.
        shift, phase = divmod(r * down, up)
        y = np.zeros(total)
        for k in range(-((half + phase) // up), (half - phase) // up + 1):
            at = 2 * gap + shift - k
            y += taps[half - (k * up + phase)] * silent[at : at + total * down : down]
        mine = np.maximum(-(-(count - r) // up), 0)
        step = _spread(np.zeros(len(mine), np.int64), mine)
        out[np.repeat(first, mine) + r + up * step] = np.clip(np.rint(y[np.repeat(grid, mine) + step]), -32768, 32767).astype(np.int16)
    return out, count


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of count, one run after another."""
    upto = np.cumsum(count)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(start - (upto - count), count)


def wav(payload: bytes, form: int = MULAW_FORMAT, rate: int = RATE) -> bytes:
    """A WAV file of one channel of 8-bit codes, ADPCM blocks or 16-bit samples."""
    extra = struct.pack("<HH", 2, 1 + 2 * (BLOCK - 4)) if form == ADPCM_FORMAT else b"\0\0"
    align, bits = (BLOCK, 4) if form == ADPCM_FORMAT else (2, 16) if form == PCM_FORMAT else (1, 8)
    samples = len(payload) // BLOCK * (1 + 2 * (BLOCK - 4)) if form == ADPCM_FORMAT else len(payload) // align
    fmt = struct.pack("<HHIIHH", form, 1, rate, rate * align // (65 if form == ADPCM_FORMAT else 1), align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body) + (len(payload) & 1)) + body + b"\0" * (len(payload) & 1)


def unwav(media: bytes) -> tuple[int, int, bytes]:
    """(format, rate, payload), by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, rate = 12, 0, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            form, _, rate = struct.unpack_from("<HHI", media, at + 8)
        if kind == b"data":
            return form, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * ((-len(raw)) % UNIT or UNIT * (not raw))


def signals(payloads: list[bytes], form: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples of all files one after another, their numbers)."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    length = np.array([len(p) for p in payloads])
    if form == PCM_FORMAT:
        return data.view("<i2"), length // 2
    if form == ADPCM_FORMAT:
        return decode_adpcm(data).ravel(), length // BLOCK * (1 + 2 * (BLOCK - 4))
    return expand(data, form), length


def pcm_files(payloads: list[bytes], form: int, up: int = UP, down: int = DOWN) -> list[bytes]:
    """Each file's samples, resampled, as a WAV file of 16-bit samples."""
    x, count = resampled(*signals(payloads, form), up, down)
    cut = np.cumsum(count)
    return [wav(x[hi - n : hi].astype("<i2").tobytes(), PCM_FORMAT, RATE * up // down) for n, hi in zip(count.tolist(), cut.tolist(), strict=True)]


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of files of some CHUNK bytes."""
    lo = 0
    while lo < len(sizes):
        hi, size = lo, 0
        while hi < len(sizes) and (hi == lo or size + sizes[hi] < CHUNK):
            size += sizes[hi]
            hi += 1
        yield lo, hi
        lo = hi


def encode_texts(docs: DataFrame, form: int = MULAW_FORMAT, up: int = UP, down: int = DOWN) -> DataFrame:
    """doc_id, n_bytes, media, pcm: each text's bytes as the codes of a file, and what they sound like as resampled PCM."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw = b.column("text").cast(pa.binary()).to_pylist()
            for lo, hi in _chunks([len(x) for x in raw]):
                payloads = [padded(x) for x in raw[lo:hi]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([len(x) for x in raw[lo:hi]], pa.int64()), pa.array([wav(x, form) for x in payloads], pa.binary()), pa.array(pcm_files(payloads, form, up, down), pa.binary())], names=["doc_id", "n_bytes", "media", "pcm"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(batches, "doc_id long, n_bytes long, media binary, pcm binary")


def decode_media(media: DataFrame) -> DataFrame:
    """Reads stored files back: doc_id, n_bytes, what was stored, a feature string, and the size of the PCM file."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            files, pcm = b.column("media").to_pylist(), b.column("pcm").to_pylist()
            for lo, hi in _chunks([len(f) for f in files]):
                yield _decoded(files[lo:hi], pcm[lo:hi], b.column("doc_id").slice(lo, hi - lo), b.column("n_bytes").slice(lo, hi - lo))

    return media.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(batches, schema)


def _decoded(files: list[bytes], pcm: list[bytes], ids: pa.Array, sizes: pa.Array) -> pa.RecordBatch:
    payloads = [unwav(f)[2] for f in files]
    codes = np.frombuffer(b"".join(payloads), np.uint8)
    length = np.array([len(p) for p in payloads])
    start = np.cumsum(length) - length
    mean = lambda x, at, n: np.add.reduceat(np.abs(x.astype(np.int32)).astype(np.int64), at) // n
    mu, al, ad = expand(codes, MULAW_FORMAT), expand(codes, ALAW_FORMAT), decode_adpcm(codes)
    levels = (mean(mu, start, length), mean(al, start, length), mean(ad.ravel(), start // BLOCK * ad.shape[1], length // BLOCK * ad.shape[1]))
    crossings = np.add.reduceat(np.diff(np.signbit(mu), append=False).astype(np.int64), start)
    last = start + length - 1
    crossings -= np.append(np.signbit(mu[last[:-1]]) != np.signbit(mu[start[1:]]), np.signbit(mu[last[-1]]))  # between files
    played = [unwav(f)[2] for f in pcm]
    x, count = signals(played, PCM_FORMAT)
    loud = mean(x, np.cumsum(count) - count, count)
    feature = [f"mulaw={a};alaw={b};adpcm={c};crossings={d};resampled={e};pcm={zlib.crc32(p):08x}" for a, b, c, d, e, p in zip(*(v.tolist() for v in (*levels, crossings, loud)), played, strict=True)]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    columns = [ids, sizes, pa.array(length, pa.int64()), pa.array(map(sha, payloads), pa.string()), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), pa.array([len(f) for f in files], pa.int64()), pa.array(map(sha, files), pa.string()), pa.array(feature, pa.string()), pa.array([len(f) for f in pcm], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes"])
