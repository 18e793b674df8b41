"""Media columns: progressive JPEG files in binary columns, decoded to full-resolution RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe.llm import jpeg
from cubeframe.llm.common import table

#: MCUs of 16 x 16 pixels of a payload image's row at most: the largest width in pixels is 65,535.
ROW_MCUS = 4095
#: Bytes of payload coded at once.
CHUNK = 1 << 20
_FLAT = np.ones(64, np.uint8)


def decode_images(images: DataFrame, id_col: str = "id", data_col: str = "data") -> DataFrame:
    """(id, height, width, rgb, error): the RGB bytes of each row's progressive JPEG, row by row.

    Null or empty data and files that aren't progressive JPEG give nulls and the reason in
    ``error``; repeated rows are decoded each. Other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ident, data in zip(pdf["id"], pdf["data"], strict=True):
                try:
                    if not data:
                        raise ValueError("no data")
                    rgb = jpeg.to_rgb(jpeg.decode_coefficients(bytes(data)))
                    row = (ident, rgb.shape[0], rgb.shape[1], rgb.tobytes(), None)
                except (ValueError, IndexError, KeyError, AttributeError, TypeError) as e:
                    row = (ident, None, None, None, str(e) or type(e).__name__)
                yield pd.DataFrame([row], columns=["id", "height", "width", "rgb", "error"]).astype({"height": "Int64", "width": "Int64"})

    return images.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).alias("data")).mapInPandas(run, "id long, height int, width int, rgb binary, error string")


def layout(n: int) -> jpeg.Frame:
    """The frame of a payload of ``n`` blocks: 4 of 6 are luma, the others chroma at half the resolution."""
    mcus = -(-n // 6)
    rows = -(-mcus // ROW_MCUS)
    return jpeg.Frame(16 * -(-mcus // rows), 16 * rows, [jpeg.Component(1, 2, 2, 0), jpeg.Component(2, 1, 1, 0), jpeg.Component(3, 1, 1, 0)])


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 64 bytes) as a progressive JPEG in colour: 64 bytes are the 64
    quantised coefficients of a block, less 128; luma blocks come first, then both chroma planes.
    The comment holds the number of blocks that are payload; up to five more a row fill the last."""
    blocks, frames, notes = [], [], []
    for payload in payloads:
        n = len(payload) // 64
        frame = layout(n)
        own = np.zeros((frame.width * frame.height // 256 * 6, 64), np.int16)
        own[:n] = np.frombuffer(payload, np.uint8).astype(np.int16).reshape(n, 64) - 128
        blocks.append(own)
        frames.append(frame)
        notes.append(b"blocks=%d" % n)
    return jpeg.encode_planar(np.concatenate(blocks), frames, _FLAT, notes)


def tensors(samples: np.ndarray, frames: list[jpeg.Frame]) -> np.ndarray:
    """(MCUs, 16, 16, 3): full-resolution RGB, chroma repeated, of images of ``layout`` one after the other."""
    mcus = np.array([f.width * f.height // 256 for f in frames])
    cols = np.repeat([f.width // 16 for f in frames], mcus)
    first = np.repeat(6 * (np.cumsum(mcus) - mcus), mcus)
    own = np.arange(int(mcus.sum())) - np.repeat(np.cumsum(mcus) - mcus, mcus)
    row, col = np.divmod(own, cols)
    corner = first + 4 * row * cols + 2 * col
    luma = samples[np.stack([corner, corner + 1, corner + 2 * cols, corner + 2 * cols + 1], axis=1)]
    luma = luma.reshape(-1, 2, 2, 8, 8).swapaxes(2, 3).reshape(-1, 16, 16)
    chroma = first + 4 * np.repeat(mcus, mcus) + own
    cb, cr = (samples[at].reshape(-1, 8, 8).repeat(2, axis=1).repeat(2, axis=2) for at in (chroma, chroma + np.repeat(mcus, mcus)))
    return jpeg.rgb(luma, cb, cr)


def load(files: list[bytes]) -> list[tuple[bytes, str]]:
    """(payload, feature) of stored files, from the decoded coefficients and the RGB tensors.

    The feature is height x width x 3, the sums of red, green and blue, of all samples' squares,
    and of samples in the upper halves of bands of 16 lines.
    """
    if not files:
        return []
    heads, held, _ = jpeg.decode_planar(files)
    frames = [frame for frame, _ in heads]
    rgb = tensors(jpeg.samples(held, heads[0][1][0]), frames)
    wide = rgb.reshape(len(rgb), 16, -1).astype(np.int64)
    per = np.column_stack([rgb.sum(axis=(1, 2), dtype=np.int64), np.einsum("mij,mij->m", wide, wide), wide[:, :8].sum(axis=(1, 2))])
    mcus = np.array([f.width * f.height // 256 for f in frames])
    sums = np.add.reduceat(per, np.cumsum(mcus) - mcus, axis=0)
    out = []
    for frame, at, total, data in zip(frames, 6 * (np.cumsum(mcus) - mcus), sums, files, strict=True):
        size = int.from_bytes(data[4:6], "big")
        n = int(data[6 : 4 + size].removeprefix(b"blocks="))
        payload = (held[at : at + n] + 128).astype(np.uint8).tobytes()
        out.append((payload, f"{frame.height}x{frame.width}x3:" + ":".join(map(str, total))))
    return out


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per row: n_bytes, and of the payload as read back from the stored JPEG its size,
    digests and feature; ``media`` itself with ``keep_media``.

    Null and empty texts are a payload of 64 zero bytes. Repeated rows and equal texts get equal
    values: a file depends on its text alone. Other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            at = 0
            while at < len(data):
                upto, room = at + 1, len(data[at])
                while upto < len(data) and room + len(data[upto]) <= CHUNK:
                    room += len(data[upto])
                    upto += 1
                yield rows(pdf["id"].iloc[at:upto], data[at:upto])
                at = upto

    def rows(ids: pd.Series, data: list[bytes]) -> pd.DataFrame:
        files = store([x + bytes(-len(x) % 64 or (0 if x else 64)) for x in data])
        out = []
        for x, file, (payload, feature) in zip(data, files, load(files), strict=True):
            out.append((len(x), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature, file if keep_media else None))
        made = pd.DataFrame(out, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"])
        made.insert(0, "doc_id", ids.to_numpy())
        return made if keep_media else made.drop(columns="media")

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if keep_media else "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
