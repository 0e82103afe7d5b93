"""Pixels: measures of an image's quality, the steps it needs, and the steps themselves, in numpy.

Images come as grey arrays: flat pixel values (array<double>) with a width. Library-backed decoding isn't needed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the flags.
LOW_SIDE, LOW_DPI, BLURRY, FLAT, NOISY, SKEWED = 1000, 150, 80.0, 35.0, 25.0, 0.5
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
MEASURES = "mean double, std double, blur double, noise double, skew double"


def blur(p: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian; 100 for images below three pixels a side."""
    if min(p.shape) < 3:
        return 100.0
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(lap.var())


def noise(p: np.ndarray) -> float:
    if min(p.shape) < 2:
        return 0.0
    return float((np.abs(np.diff(p, axis=1)).var() + np.abs(np.diff(p, axis=0)).var()) / 2)


def skew(p: np.ndarray) -> float:
    """The angle in -10 to 10 degrees at which rows of dark pixels stand out most; the first of equals."""
    step = max(1, max(p.shape) // 300)
    ys, xs = np.nonzero(p[::step, ::step] < 180)
    if not len(ys):
        return 0.0
    best, angle = -1.0, 0.0
    for a in np.linspace(-10, 10, 21):
        rows = np.round(ys * np.cos(np.radians(a)) + xs * np.sin(np.radians(a))).astype(int)
        score = float(np.bincount(rows - rows.min()).var())
        if score > best:
            best, angle = score, float(a)
    return angle


def measured(images: DataFrame) -> DataFrame:
    """image_id, width, pixels -> the measures of each image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, w, px in zip(pdf.image_id, pdf.width, pdf.pixels, strict=True):
                p = np.asarray(px, float).reshape(-1, int(w))
                rows.append((i, p.mean(), p.std(), blur(p), noise(p), skew(p)))
            yield pd.DataFrame(rows, columns=["image_id", "mean", "std", "blur", "noise", "skew"])

    return images.select("image_id", "width", "pixels").mapInPandas(run, f"image_id long, {MEASURES}")


def flags(width: Column, height: Column, dpi: Column) -> dict[str, Column]:
    low = (F.least(width, height) < LOW_SIDE) | (dpi < LOW_DPI)
    return {"low_resolution": low, "blurry": F.col("blur") < BLURRY, "low_contrast": F.col("std") < FLAT, "noisy": F.col("noise") > NOISY, "skewed": F.abs("skew") > SKEWED}


def planned_steps(mode: Column) -> Column:
    """Names of the steps an image needs, from its flags."""
    bad = F.col("low_contrast") | F.col("noisy")
    steps = [
        F.when(F.col("skewed"), "deskew"), F.when(F.col("low_resolution"), "resize"), F.when(F.col("low_resolution"), "sharpen"), F.when((mode != "L") | ~bad, "grayscale"),
        F.when(F.col("noisy"), "denoise"), F.when(F.col("low_contrast"), "contrast"), F.when(bad, "threshold"),
    ]
    return F.array_compact(F.array(*steps))


def _box_mean(p: np.ndarray, k: int) -> np.ndarray:
    q = np.pad(p, k // 2, mode="edge")
    s = np.pad(q.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def _median3(p: np.ndarray) -> np.ndarray:
    q = np.pad(p, 1, mode="edge")
    h, w = p.shape
    return np.median(np.stack([q[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)


def _lanczos(n: int, size: int) -> np.ndarray:
    """Weights by which n pixels become `size`: a windowed sinc of three lobes, wider where pixels are merged."""
    scale = n / size
    wide = max(scale, 1.0)
    x = (np.arange(n)[None, :] + 0.5 - (np.arange(size)[:, None] + 0.5) * scale) / wide
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def _resized(p: np.ndarray, width: int) -> np.ndarray:
    """At least that wide, sides in proportion."""
    if p.shape[1] >= width:
        return p
    h = max(1, round(p.shape[0] * width / p.shape[1]))
    return np.clip(np.rint(_lanczos(p.shape[0], h) @ p @ _lanczos(p.shape[1], width).T), 0, 255)


def _rotated(p: np.ndarray, degrees: float) -> np.ndarray:
    """About its middle, nearest pixels, white outside."""
    if abs(degrees) < 0.2:
        return p
    h, w = p.shape
    y, x = np.mgrid[:h, :w]
    c, s, cy, cx = np.cos(np.radians(degrees)), np.sin(np.radians(degrees)), (h - 1) / 2, (w - 1) / 2
    yy, xx = np.rint(cy + (y - cy) * c - (x - cx) * s).astype(int), np.rint(cx + (y - cy) * s + (x - cx) * c).astype(int)
    ok = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
    return np.where(ok, p[yy.clip(0, h - 1), xx.clip(0, w - 1)], 255.0)


STEPS = {
    "grayscale": lambda p: p,
    "resize": lambda p: _resized(p, 1200),
    "contrast": lambda p: np.clip((p - p.mean()) * 1.5 + p.mean(), 0, 255),
    "brightness": lambda p: np.clip(p * 1.1, 0, 255),
    "denoise": _median3,
    "sharpen": lambda p: np.clip(2 * p - _box_mean(p, 3), 0, 255),
    "threshold": lambda p: np.where(p > _box_mean(p, 15) - 10, 255.0, 0.0),
    "deskew": lambda p: _rotated(p, -skew(p)),
    "crop": lambda p: p[np.ix_((p < 250).any(1), (p < 250).any(0))] if (p < 250).any() else p,
}


def processed(images: DataFrame) -> DataFrame:
    """image_id, width, pixels, steps -> image_id, width, height, applied, pixels after its steps in order; unknown steps are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, w, px, steps in zip(pdf.image_id, pdf.width, pdf.pixels, pdf.steps, strict=True):
                p = np.asarray(px, float).reshape(-1, int(w))
                names = [s for s in steps if s in STEPS]
                for s in names:
                    p = STEPS[s](p)
                rows.append((i, p.shape[1], p.shape[0], names, p.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "applied", "pixels"])

    return images.select("image_id", "width", "pixels", "steps").mapInPandas(run, "image_id long, width int, height int, applied array<string>, pixels array<double>")


def cropped(p: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of an image inside a box of shares."""
    h, w = p.shape[:2]
    return p[int(box[1] * h) : max(int(box[1] * h) + 1, int(np.ceil(box[3] * h))), int(box[0] * w) : max(int(box[0] * w) + 1, int(np.ceil(box[2] * w)))]


def tensor(p: np.ndarray, side: int = 640) -> np.ndarray:
    """A grey image as the input of a vision model: three planes, resized, with mean and deviation taken out."""
    q = np.stack([np.interp(np.linspace(0, p.shape[1] - 1, side), np.arange(p.shape[1]), r) for r in p])
    q = np.stack([np.interp(np.linspace(0, p.shape[0] - 1, side), np.arange(p.shape[0]), c) for c in q.T]).T / 255.0
    return np.stack([(q - m) / s for m, s in zip(MEAN, STD, strict=True)])[None].astype(np.float32)


def png(p: np.ndarray) -> bytes:
    """A grey image as a PNG file."""
    rows = np.clip(np.rint(p), 0, 255).astype(np.uint8)
    raw = np.hstack([np.zeros((rows.shape[0], 1), np.uint8), rows]).tobytes()  # each row begins with its filter, none

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def as_png(images: DataFrame) -> DataFrame:
    """image_id, width, pixels -> image_id, content: PNG files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"image_id": pdf.image_id, "content": [png(np.asarray(px, float).reshape(-1, int(w))) for w, px in zip(pdf.width, pdf.pixels, strict=True)]})

    return images.select("image_id", "width", "pixels").mapInPandas(run, "image_id long, content binary")


def figure_crops(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Rendered pages (doc_id, page_index, width, pixels) and regions found on them (doc_id, page_index, region_idx, category,
    left, top, right, bottom as shares) -> a figure for each FIGURE region: doc_id, page_index, block_id, width, height, content (PNG).
    Pages and regions meet on their page; regions of pages that aren't rendered are left out."""
    r = regions.where("category = 'FIGURE'").groupBy("doc_id", "page_index").agg(F.collect_list(F.struct("region_idx", "left", "top", "right", "bottom")).alias("regions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, w, px, found in zip(pdf.doc_id, pdf.page_index, pdf.width, pdf.pixels, pdf.regions, strict=True):
                p = np.asarray(px, float).reshape(-1, int(w))
                for x in found:
                    part = cropped(p, (x["left"], x["top"], x["right"], x["bottom"]))
                    rows.append((doc, page, f"fig_ml_{page}_{x['region_idx']}", part.shape[1], part.shape[0], png(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "block_id", "width", "height", "content"])

    return pages.join(r, ["doc_id", "page_index"]).select("doc_id", "page_index", "width", "pixels", "regions").mapInPandas(run, "doc_id long, page_index int, block_id string, width int, height int, content binary")
