"""Media columns, GIF: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

``encode`` writes payloads as GIF89a with 8-bit samples (one sample a byte, an identity grey palette),
``WIDTH`` pixels wide, one frame for each ``ROWS`` rows. ``frames_of`` decodes any GIF87a/GIF89a stream
into timed, composed frames; ``decode`` is its DataFrame form, with a histogram of colours per frame.

Decoding LZW by whole arrays: between two clear codes the width of the k-th code depends on k alone,
so all codes of a segment are cut out at once. The entry made after code k is that code's string and
the next code's first byte, and both lie side by side in the output; so every code is a literal or a
copy of earlier output. Lengths and source positions of all bytes then follow by pointer doubling, in
as many steps as the logarithm of the longest chain. Encoding is the usual greedy dictionary walk.

Each document is one row and one task's work; nothing is shuffled. Memory: a few times one document,
or the samples that a frame's header asks for; codes that stand for more are cut before they are laid out.

Defined results: null payload: null media in ``encode``; ``pad`` turns null text into one block of
zeros. A stream that is cut or damaged, or whose canvas or frame would have over ``MAX_PIXELS`` pixels: the
frames read before it and ``error`` set, no exception.
Pixels that a damaged or short code stream does not give stay transparent. Zero-sized frames have no
pixels. Repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads are padded with zero bytes to a positive multiple of this, which is also the frame width.
BLOCK = 64
#: Rows of one frame: 64 x 4096 samples.
ROWS = 4096
DELAY_MS = 40
#: Colour histogram: 4 levels of red, green and blue.
LEVELS = 4
#: Pixels of a canvas or of a frame, at most: headers are not believed beyond it.
MAX_PIXELS = 1 << 26
_GREY = bytes(x for i in range(256) for x in (i, i, i))


def pad(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


# ---- LZW


def lzw_pack(data: bytes, bits: int = 8) -> bytes:
    """The code stream of data, whose samples have that many bits (2 to 8)."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes, cuts = [clear], []  # cuts: places in codes after which the table is new
    table: dict[int, int] = {}
    look, put = table.get, codes.append
    free, prefix = end + 1, -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        if (known := look(key)) is not None:
            prefix = known
            continue
        put(prefix)
        if free < 4096:
            table[key] = free
            free += 1
        else:
            put(clear)
            cuts.append(len(codes))
            table.clear()
            free = end + 1
        prefix = b
    if prefix >= 0:
        put(prefix)
    put(end)
    every = np.array(codes, np.uint32)
    starts = np.array([1, *cuts, len(codes)], np.int64)
    width = np.concatenate(([bits + 1], *(_widths(b - a, bits) for a, b in zip(starts[:-1], starts[1:], strict=True))))
    ends = np.cumsum(width)
    at, size = ends - width, (int(ends[-1]) + 7) // 8
    shifted, byte = every.astype(np.int64) << (at & 7), at >> 3
    out = np.zeros(size + 3)
    for i in range(3):  # a code touches at most three bytes; bits of neighbours don't overlap
        out += np.bincount(byte + i, shifted >> (8 * i) & 255, size + 3)
    return out[:size].astype(np.uint8).tobytes()


@functools.lru_cache(32)
def _table_widths(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths, and their running sums, of as many codes as make the table full."""
    widths = _widths(4096 - (1 << bits) - 1, bits)
    return widths, np.cumsum(widths)


def _widths(n: int, bits: int) -> np.ndarray:
    """Widths of the n codes that follow a clear code: before the k-th, k - 1 entries were made."""
    k = np.maximum(np.arange(n) - 1, 0) + (1 << bits) + 2
    return np.minimum(np.maximum(np.ceil(np.log2(k + 1)).astype(np.int64), bits + 1), 12)


def lzw_unpack(stream: bytes, bits: int = 8, most: int | None = None) -> tuple[np.ndarray, bool]:
    """Samples, and whether the stream was sound up to its end code (or up to ``most`` samples)."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int32)
    triples = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total = 8 * len(stream)
    widths, ends = _table_widths(bits)
    out, have, bit, span = [], 0, 0, len(widths)
    while most is None or have < most:
        n = int(np.searchsorted(ends, total - bit, "right"))
        if n == 0:
            return _joined(out), False
        start, width = bit + ends[:n] - widths[:n], widths[:n]
        codes = triples[start >> 3] >> (start & 7) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and n == span:  # a full table and no clear code: 12-bit codes go on, without new entries
            start = np.concatenate((start, np.arange(bit + int(ends[-1]), total - 11, 12)))
            width = np.concatenate((width, np.full(len(start) - n, 12)))
            codes = np.concatenate((codes, triples[start[n:] >> 3] >> (start[n:] & 7) & 4095))
            stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        data, sound = _copies(codes[:n].astype(np.int64), end + 1, None if most is None else most - have)
        out.append(data)
        have += len(data)
        if not sound or not len(stop):
            return _joined(out), False
        if codes[n] == end:
            return _joined(out), True
        bit = int(start[n] + width[n])
    return _joined(out), True


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def _copies(codes: np.ndarray, first: int, most: int | None = None) -> tuple[np.ndarray, bool]:
    """Bytes that the codes between two clear codes stand for, up to the code that reaches ``most`` bytes: a few codes
    may stand for gigabytes. The entry ``first + j`` is the string of code j and one byte more; it lies in the output
    where code j's string begins."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint8), True
    of = codes - first  # the code that an entry stems from
    wrong = np.flatnonzero(of >= np.arange(n))
    if len(wrong):
        good, _ = _copies(codes[: wrong[0]], first, most)
        return good, False
    # length: 1 for a literal, else one more than its code's: steps to a literal, by pointer doubling
    length = np.where(of >= 0, 1, 0)
    jump = np.where(of >= 0, of, np.arange(n))
    while True:
        further = length[jump]
        if not further.any():
            break
        length = length + further
        jump = jump[jump]
    length += 1
    ends = np.cumsum(length)
    if most is not None and ends[-1] > most:  # what comes later is referred to by none of these
        kept = int(np.searchsorted(ends, most)) + 1
        codes, of, length, ends = codes[:kept], of[:kept], length[:kept], ends[:kept]
    begin = ends - length
    total = int(length.sum())
    # every byte's source: itself for a literal, else the same offset of the code's own string
    source = np.arange(total) + np.repeat(np.where(of >= 0, begin[np.maximum(of, 0)] - begin, 0), length)
    while True:
        deeper = source[source]
        if (deeper == source).all():
            break
        source = deeper
    literal = np.zeros(total, np.uint8)
    plain = of < 0
    literal[begin[plain]] = codes[plain]
    return literal[source], True


# ---- streams


def gif_bytes(payload: bytes) -> bytes:
    """A GIF89a whose frames hold the payload's bytes as grey samples; its length is a multiple of BLOCK."""
    height = len(payload) // BLOCK
    out = [b"GIF89a", struct.pack("<HHBBB", BLOCK, min(height, ROWS), 0xF7, 0, 0), _GREY]
    for at in range(0, height, ROWS):
        rows = min(ROWS, height - at)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY_MS // 10, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, BLOCK, rows, 0) + b"\x08")
        codes = lzw_pack(payload[at * BLOCK : (at + rows) * BLOCK])
        out += [bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255)]
        out.append(b"\x00")
    return b"".join([*out, b"\x3b"])


def _blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while raw[at]:
        parts.append(raw[at + 1 : at + 1 + raw[at]])
        if len(parts[-1]) < raw[at]:
            raise IndexError
        at += 1 + raw[at]
    return b"".join(parts), at + 1


def _palette(raw: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    size = 3 << ((flags & 7) + 1)
    if len(raw) < at + size:
        raise IndexError
    table = np.zeros((256, 4), np.uint8)
    table[:, 3] = 255
    table[: size // 3, :3] = np.frombuffer(raw, np.uint8, size, at).reshape(-1, 3)
    return table, at + size


def frames_of(raw: bytes) -> Iterator[dict]:
    """Composed frames in order: start_ms, delay_ms, left, top, width, height, disposal, samples (the
    frame's own, rows in order), canvas (height, width, 4: RGBA after this frame is drawn; reused by the
    next step), error."""
    try:
        if raw[:6] not in (b"GIF87a", b"GIF89a"):
            raise IndexError
        wide, high, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
        common_palette, at = _palette(raw, 13, flags)
        if wide * high > MAX_PIXELS:
            raise IndexError
        canvas = np.zeros((high, wide, 4), np.uint8)
        delay, disposal, clear_index, clock = 0, 0, -1, 0
        while True:
            kind = raw[at]
            if kind == 0x3B:
                return
            if kind == 0x21:
                label = raw[at + 1]
                body, at = _blocks(raw, at + 2)
                if label == 0xF9 and len(body) >= 4:
                    disposal, delay = body[0] >> 2 & 7, 10 * (body[1] | body[2] << 8)
                    clear_index = body[3] if body[0] & 1 else -1
                continue
            if kind != 0x2C:
                raise IndexError
            left, top, w, h, flags = struct.unpack_from("<HHHHB", raw, at + 1)
            if w * h > MAX_PIXELS:
                raise IndexError
            own, at = _palette(raw, at + 10, flags)
            bits = raw[at]
            if not 1 < bits < 9:
                raise IndexError
            stream, at = _blocks(raw, at + 1)
            samples, sound = lzw_unpack(stream, bits, w * h)
            known = min(len(samples), w * h)
            drawn = np.zeros(w * h, np.uint8)
            drawn[:known] = samples[:known]
            given = np.arange(w * h).reshape(h, w) < known if known < w * h else None
            drawn = drawn.reshape(h, w)
            if flags & 0x40:  # interlaced: rows come in four passes
                order = np.argsort(np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))]))
                drawn, given = drawn[order], None if given is None else given[order]
            palette = own if own is not None else common_palette
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            if palette is not None:
                seen = drawn[: area.shape[0], : area.shape[1]]
                if given is None and clear_index < 0:
                    area[:] = palette[seen]
                else:
                    show = seen != clear_index
                    show &= True if given is None else given[: area.shape[0], : area.shape[1]]
                    area[show] = palette[seen[show]]
            yield {"start_ms": clock, "delay_ms": delay, "left": left, "top": top, "width": w, "height": h, "disposal": disposal, "samples": drawn, "canvas": canvas, "error": not sound or known < w * h}
            clock += delay
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear_index = 0, 0, -1
    except (IndexError, struct.error):
        yield {"start_ms": 0, "delay_ms": 0, "left": 0, "top": 0, "width": 0, "height": 0, "disposal": 0, "samples": np.empty((0, 0), np.uint8), "canvas": np.empty((0, 0, 4), np.uint8), "error": True}


def histogram(canvas: np.ndarray) -> np.ndarray:
    """LEVELS ** 3 counts of the canvas's visible pixels by colour."""
    bins = canvas[..., 0] >> 6 << 4 | canvas[..., 1] >> 6 << 2 | canvas[..., 2] >> 6
    visible = canvas[..., 3] > 0
    return np.bincount(bins[visible] if not visible.all() else bins.ravel(), minlength=LEVELS**3)


# ---- DataFrames


def encode(rows: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, payload) -> (id, media): payloads of a positive multiple of BLOCK bytes as GIF."""
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(payload_col).cast("binary").alias("p"))
    return common.mapped(out, lambda b: pa.RecordBatch.from_arrays([b["id"], pa.array([None if x is None else gif_bytes(pad(x)) for x in b["p"].to_pylist()], pa.binary())], names=["id", "media"]), "id long, media binary")


def decode(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row per frame: id, frame, start_ms, delay_ms, left, top, width, height, disposal, samples,
    histogram, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in zip(b["id"].to_pylist(), b["m"].to_pylist(), strict=True):
                for k, f in enumerate(frames_of(raw or b"")):
                    yield pa.RecordBatch.from_pylist([{"id": i, "frame": k, **{n: f[n] for n in ("start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "error")}, "samples": f["samples"].tobytes(), "histogram": histogram(f["canvas"]).tolist()}], schema=_FRAMES)

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("m")).mapInArrow(run, FRAMES)


FRAMES = "id long, frame int, start_ms int, delay_ms int, left int, top int, width int, height int, disposal int, samples binary, histogram array<long>, error boolean"
_INT = pa.int32()
_FRAMES = pa.schema([("id", pa.int64()), *((n, _INT) for n in ("frame", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal")), ("samples", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.bool_())])


def _digest(b: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for i, n, raw in zip(b["id"].to_pylist(), b["n_bytes"].to_pylist(), b["media"].to_pylist(), strict=True):
        payload, colours, clock, k = bytearray(), np.zeros(LEVELS**3, np.int64), 0, 0
        for k, f in enumerate(frames_of(raw), 1):
            if f["error"]:
                raise ValueError(f"media of {i} can't be read back")
            payload += f["samples"].tobytes()
            colours += histogram(f["canvas"])
            clock += f["delay_ms"]
        top = np.lexsort((np.arange(len(colours)), -colours))[:4]
        feature = f"frames={k};ms={clock};" + ",".join(f"{c // 16}{c // 4 % 4}{c % 4}:{colours[c]}" for c in top.tolist())
        out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
    columns = list(zip(*out, strict=True)) or [[]] * 8
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as GIF, read back and described: the frames' samples in order are the payload."""
    common.small_batches(spark)
    docs = common.read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("payload"))

    def store(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = b["payload"].to_pylist()
        return pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array([gif_bytes(pad(x)) for x in raw], pa.binary())], names=["id", "n_bytes", "media"])

    media = common.mapped(docs, store, "id long, n_bytes long, media binary")
    return common.mapped(media, _digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
