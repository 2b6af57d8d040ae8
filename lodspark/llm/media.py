"""Media columns: AVI motion-JPEG in binary columns, decoded to timed clips.

Clips are cut where the histogram of a frame differs from the one before by more than the recent
differences explain: their running mean plus WIDTH running deviations, and FLOOR at least.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import mjpeg
from .common import saved, spans_of, utf8

#: Histogram bins, memory of the running mean, deviations above it, least difference of a shot.
BINS, MEMORY, WIDTH, FLOOR = 16, 0.1, 3.0, 0.25
#: Frames that are coded or decoded together.
RUN = 2048

CLIP = "array<struct<clip:int,first_frame:int,frames:int,start_s:double,stop_s:double>>"
#: What is read from a file.
TOLD = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "n_frames": "int", "clips": CLIP}


def payloads(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes, filled with 255 to a positive multiple of a frame."""
    data, offsets = utf8(column)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        n = int(b - a)
        whole = max(1, -(-n // mjpeg.UNITS)) * mjpeg.UNITS
        out.append(data[a:b].tobytes() + b"\xff" * (whole - n))
    return out


def encode_all(texts: list[bytes]) -> list[bytes]:
    """An AVI file of each payload; frames of many files are coded together."""
    units = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, mjpeg.BLOCKS, 64)
    scans: list[bytes] = []
    for at in range(0, len(units), RUN):
        scans += mjpeg.encode_scans(units[at : at + RUN].astype(np.int16) - 128)
    edge = np.cumsum([0, *[len(t) // mjpeg.UNITS for t in texts]])
    return [mjpeg.write_avi(scans[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def decode_all(files: list[bytes]) -> tuple[list[bytes | None], list[np.ndarray], list[float]]:
    """Payload, frame histograms (of brightness) and frame rate of each file, through its index and its frames' entropy data.

    A file whose frames aren't of the kind that `encode_all` writes has no payload (null).
    """
    sizes, rates, flat = [], [], []
    for media in files:
        frames, rate = mjpeg.read_avi(media)
        tables = mjpeg.Tables()
        flat += [mjpeg.parse_frame(f, tables) for f in frames]
        sizes.append(len(frames))
        rates.append(rate)
    grams = np.empty((len(flat), BINS), np.float32)
    bodies: list[bytes | None] = []
    keys = [f.key for f in flat]
    at = 0
    while at < len(flat):  # runs of frames that decode together
        lead = flat[at]
        limit = max(1, RUN * mjpeg.SIDE**2 // max(1, lead.width * lead.height))
        end = at + 1
        while end < len(flat) and end - at < limit and keys[end] == keys[at]:
            end += 1
        units = mjpeg.decode_frames(flat[at:end])[0]
        level = mjpeg.plane(lead, units).reshape(end - at, -1) >> 4
        cells = level.astype(np.int64) + np.arange(end - at)[:, None] * BINS
        grams[at:end] = np.bincount(cells.ravel(), minlength=(end - at) * BINS).reshape(-1, BINS) / level.shape[1]
        if lead.is_payload:
            raw = units.reshape(end - at, -1) + 128
            whole = (raw.min(1) >= 0) & (raw.max(1) <= 255)
            bodies += [r.tobytes() if ok else None for r, ok in zip(raw.astype(np.uint8), whole.tolist(), strict=True)]
        else:
            bodies += [None] * (end - at)
        at = end
    edge = np.cumsum([0, *sizes])
    spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
    payload = [None if None in bodies[a:b] else b"".join(bodies[a:b]) for a, b in spans]
    return payload, [grams[a:b] for a, b in spans], rates


def shots(grams: np.ndarray) -> list[int]:
    """First frames of the shots: where the difference of histograms rises above its adaptive threshold."""
    found = [0] if len(grams) else []
    mean, spread, seen = 0.0, 0.0, 0
    for k, d in enumerate((np.abs(np.diff(grams, axis=0)).sum(1) / 2).tolist(), 1):
        if seen and d > max(FLOOR, mean + WIDTH * spread):
            found.append(k)
            mean, spread, seen = 0.0, 0.0, 0
            continue
        rate = max(MEMORY, 1 / (seen + 1))
        spread += rate * (abs(d - mean) - spread) if seen else 0.0
        mean += rate * (d - mean)
        seen += 1
    return found


def to_media(docs: DataFrame) -> DataFrame:
    """`doc_id, n_bytes, media`: every whole text as an AVI file in a binary column, other columns are left out.

    Null counts as empty: one frame of filling. Repeated rows and null ids give a file each, an empty
    table none. RIFF counts bytes in 32 bits, so a file ends at 4 GB; a text is 2 GB at most, but one
    whose file would be larger fails in `write_avi`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                text = part.column("text")
                n = np.diff(utf8(text)[1])
                media = pa.array(encode_all(payloads(text)), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), media], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `limit` bytes in a column: bounds what one step holds."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    for low, high in spans_of(offsets, limit):
        yield batch.slice(low, high - low)


def read_media(media: DataFrame) -> DataFrame:
    """What the files hold: every column but `media`, and sizes, digests and timed clips of the decoded frames.

    Columns named like one of the new ones, in any case, are replaced. Repeated rows and null ids stay
    as they are, an empty table gives an empty one. Null media is an empty file: no frames and no clips. Files of other frames than `to_media` writes
    have clips and media digests, and a null payload. A file that is no AVI of sequential JPEG frames fails.
    """
    told_of = T.StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in TOLD.items()))
    media = media.drop(*TOLD)
    keep = [f for f in media.schema.fields if f.name != "media"]
    out = T.StructType([*keep, *told_of.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("stop_s", pa.float64())]))
        for batch in batches:
            for part in _slices(batch, "media"):
                files = [x.as_py() or mjpeg.write_avi([]) for x in part.column("media")]
                texts, grams, rates = decode_all(files)
                clips = []
                for g, rate in zip(grams, rates, strict=True):
                    cuts = [*shots(g), len(g)]
                    clips.append([{"clip": i, "first_frame": a, "frames": b - a, "start_s": a / rate, "stop_s": b / rate} for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])
                arrays = [part.column(f.name) for f in keep]
                told = lambda of, kind, texts=texts: pa.array([None if t is None else of(t) for t in texts], kind)
                arrays += [told(len, pa.int64()), told(lambda t: hashlib.sha256(t).hexdigest(), pa.string()), told(lambda t: zlib.crc32(t[-32:]), pa.int64())]
                arrays += [pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array([len(g) for g in grams], pa.int32()), pa.array(clips, kind)]
                yield pa.RecordBatch.from_arrays(arrays, out.names)

    return media.mapInArrow(run, out)


def clips(media: DataFrame) -> DataFrame:
    """One row a clip: the columns of `media` but the file itself, with clip, first_frame, frames, start_s and stop_s; columns named like these are replaced."""
    own = ("clip", "first_frame", "frames", "start_s", "stop_s")
    media = media.drop(*own)
    read = read_media(media)
    return read.select(*[c for c in read.columns if c in media.drop(*TOLD).columns], F.inline("clips"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document into a stored AVI file and back from there; `feature` lists frames, shots and the shots' first frames."""
    read = read_media(saved(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
    starts = F.array_join(F.transform("clips", lambda c: c["first_frame"].cast("string")), ",")
    feature = F.concat_ws(";", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("shots="), F.size("clips")), F.concat(F.lit("at="), starts))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
