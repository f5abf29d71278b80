"""Media columns: documents stored as baseline JPEG, with dimensions and thumbnail hashes read back from the bytes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import jpeg

_FEATURES = "frames int, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string"


def padded(text: bytes) -> bytes:
    """Text with bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 mean cells of a thumbnail is darker than its right neighbour."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 10).astype(int)
    whole = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    whole[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    r0, r1, c0, c1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    r1, c1 = np.minimum(r1, thumb.shape[0]), np.minimum(c1, thumb.shape[1])
    r0, c0 = np.minimum(r0, r1 - 1), np.minimum(c0, c1 - 1)
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    cells = (whole[np.ix_(r1, c1)] - whole[np.ix_(r0, c1)] - whole[np.ix_(r1, c0)] + whole[np.ix_(r0, c0)]) / area
    return int.from_bytes(np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes(), "big")


def _features(images: list[bytes]) -> list[tuple]:
    """For each image the values of _FEATURES. One that can't be read has nulls and an error, and doesn't hold up others."""
    try:
        found = jpeg.thumbnails(images)
    except jpeg.ERRORS as e:
        if len(images) > 1:
            return [x for i in images for x in _features([i])]
        return [(*[None] * 7, f"{type(e).__name__}: {e}")]
    out = []
    for frames in found:
        if not frames:
            out.append((*[None] * 7, "no image"))
            continue
        payload = b"".join(t.tobytes() for _, _, t in frames)
        width, height = max(w for w, _, _ in frames), sum(h for _, h, _ in frames)
        hashes = "".join(f"{difference_hash(t):016x}" for _, _, t in frames)
        out.append((len(frames), width, height, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), f"{width}x{height}:{hashes}", None))
    return out


def _in_parts(items: list[bytes], most: int = 1 << 21) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for x in items:
        part.append(x)
        size += len(x)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def as_jpeg(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) for every row: the UTF-8 text, padded with bytes 0 to a positive multiple of 64, as
    the DC samples of a baseline JPEG. A null text is empty; ids, nulls and repeated rows pass as they are."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text").cast(pa.binary())]
            at = 0
            for part in _in_parts(texts):
                media = [jpeg.write_dc(padded(t)) for t in part]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(part)), pa.array([len(t) for t in part], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
                )
                at += len(part)

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(batches, "doc_id long, n_bytes long, media binary")


def jpeg_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The columns of media with, read from the JPEG bytes: the number of frames, width and (summed) height, size,
    SHA-256 and CRC-32 of the last 64 of the thumbnails' bytes, and the thumbnails' difference hashes.

    A null gives nulls. Bytes that hold no baseline JPEG that can be read whole (empty ones too) give nulls and what was
    wrong in `error`. Columns of media with these names are replaced.
    """
    schema = pa.schema([("frames", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string()), ("error", pa.string())])
    media = media.drop(*schema.names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            images = b.column(media_col).to_pylist()
            rows = iter([x for part in _in_parts([i for i in images if i is not None]) for x in _features(part)])
            rows = [next(rows) if i is not None else (None,) * len(schema) for i in images]
            found = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, *schema.names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(batches, f"{own}, {_FEATURES}")
