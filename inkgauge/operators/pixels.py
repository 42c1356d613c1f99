"""Plain array work on page images: rotations, local thresholds, foreground, line masks and profiles.

Images are columns (width, height, pixels), pixels being grey bytes, row by row. Work is per image in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from inkgauge.functions import fixed


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of (height, width, 3), rounded."""
    return np.rint(rgb[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def swapped(image: np.ndarray) -> np.ndarray:
    """BGR as RGB and back."""
    return image[..., ::-1]


def rotations(image: np.ndarray) -> dict[str, np.ndarray]:
    """The image turned clockwise by 0, 90, 180 and 270 degrees."""
    return {f"rotation_{90 * k}": np.rot90(image, -k) for k in range(4)}


def local_mean(image: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted mean over a square window around each pixel, edges repeated, rounded."""
    r = len(weights) // 2
    rows = np.pad(image.astype(np.float64), ((r, r), (r, r)), mode="edge")
    rows = sum(w * rows[i : i + image.shape[0]] for i, w in enumerate(weights))
    return np.rint(sum(w * rows[:, i : i + image.shape[1]] for i, w in enumerate(weights)))


def foreground(image: np.ndarray, kind: str = "mean", size: int = 31, offset: int = 15) -> np.ndarray:
    """True where a pixel is darker than its surroundings by at least offset; kind mean or gaussian."""
    x = np.arange(size) - size // 2
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-(x**2) / (2 * sigma**2)) if kind == "gaussian" else np.ones(size)
    return image.astype(np.float64) - local_mean(image, w / w.sum()) <= -offset


def foreground_ratio(image: np.ndarray) -> float:
    return float(foreground(image, "gaussian").mean()) if image.size else 0.0


def line_mask(mask: np.ndarray, length: int, grown: int = 2) -> np.ndarray:
    """The runs along a row of at least length pixels, grown at both ends."""
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), (_, end) = np.nonzero(step == 1), np.nonzero(step == -1)
    long = end - start >= length
    out = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int32)
    np.add.at(out, (row[long], np.maximum(start[long] - grown, 0)), 1)
    np.add.at(out, (row[long], np.minimum(end[long] + grown, mask.shape[1])), -1)
    return np.cumsum(out, 1)[:, :-1] > 0


def profiles(image: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """For each kernel ratio the line pixels of each row, and of each column."""
    mask = foreground(image)
    side = lambda m, least: [line_mask(m, max(m.shape[1] // r, least)).sum(1).tolist() for r in fixed.KERNEL_RATIOS]
    return side(mask, 15), side(mask.T, 12)


def line_profiles(images: DataFrame, *keys: str) -> DataFrame:
    """(keys..., width, height, text_density, h_profiles, v_profiles, error) of images (keys..., width, height, pixels).

    Null images and those whose pixels don't fit their size are rows with an error and null results.
    """

    def one(w, h, pixels):
        try:
            image = np.frombuffer(pixels, np.uint8).reshape(int(h), int(w))
            return (int(w), int(h), foreground_ratio(image), *profiles(image), None)
        except (TypeError, ValueError) as e:
            return None, None, None, None, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        new = ["width", "height", "text_density", "h_profiles", "v_profiles", "error"]
        for pdf in batches:
            got = pd.DataFrame([one(*r) for r in zip(pdf["width"], pdf["height"], pdf["pixels"], strict=True)], columns=new, dtype=object)
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), got], axis=1)

    kept = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)
    return images.select(*keys, "width", "height", "pixels").mapInPandas(run, f"{kept}, width int, height int, text_density double, h_profiles array<array<int>>, v_profiles array<array<int>>, error string")
