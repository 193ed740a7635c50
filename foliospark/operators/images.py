"""Image preprocessing in NumPy, for use inside page adapters. Arrays are (rows, columns) or (rows, columns, 3), 8 bits.

Memory stays a small multiple of the image's: windows are summed shift by shift or from running sums, never held side by side.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _padded(image: np.ndarray, half: int) -> np.ndarray:
    return np.pad(image.astype(float), half, mode="symmetric")


def _shifts(image: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(dy, dx, the image moved so) over a window."""
    h, w, half = *image.shape, size // 2
    wide = _padded(image, half)
    for y in range(size):
        for x in range(size):
            yield y - half, x - half, wide[y : y + h, x : x + w]


def window_mean(image: np.ndarray, size: int) -> np.ndarray:
    total = np.pad(_padded(image, size // 2).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    return (total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]) / size**2


def gaussian(image: np.ndarray, sigma: float, size: int | None = None) -> np.ndarray:
    size = size or 2 * int(4 * sigma + 0.5) + 1
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    wide, (h, w) = _padded(image, size // 2), image.shape
    rows = sum(v * wide[i : i + h] for i, v in enumerate(k / k.sum()))
    return sum(v * rows[:, i : i + w] for i, v in enumerate(k / k.sum()))


def reduce_noise(image: np.ndarray, size: int = 9, sigma_range: float = 75, sigma_space: float = 75) -> np.ndarray:
    """Bilateral filter: neighbours weigh by distance and by likeness."""
    g = gray(image).astype(float)
    total, weight = np.zeros(g.shape), np.zeros(g.shape)
    for dy, dx, moved in _shifts(g, size):
        if dy * dy + dx * dx <= (size // 2) ** 2:
            near = np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2) - (moved - g) ** 2 / (2 * sigma_range**2))
            total += near * moved
            weight += near
    return np.rint(total / weight).astype(np.uint8)


def enhance_contrast(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation: each tile's own curve at its center, mixed in between with those of its neighbours."""
    g = gray(image)
    rows, cols = (np.array_split(np.arange(n), min(tiles, n)) for n in g.shape)
    curves = np.empty((len(rows), len(cols), 256))
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            part = g[r[0] : r[-1] + 1, c[0] : c[-1] + 1]
            counts = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * part.size / 256)
            counts = np.minimum(counts, limit) + np.maximum(counts - limit, 0).sum() / 256
            curves[i, j] = counts.cumsum() / counts.sum() * 255

    def between(n: int, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.interp(np.arange(n), [(p[0] + p[-1]) / 2 for p in parts], np.arange(len(parts)))
        low = np.minimum(at.astype(int), len(parts) - 1)
        return low, np.minimum(low + 1, len(parts) - 1), at - low

    y0, y1, fy = (v[:, None] for v in between(g.shape[0], rows))
    x0, x1, fx = (v[None, :] for v in between(g.shape[1], cols))
    top = curves[y0, x0, g] * (1 - fx) + curves[y0, x1, g] * fx
    return np.rint(top * (1 - fy) + (curves[y1, x0, g] * (1 - fx) + curves[y1, x1, g] * fx) * fy).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """Threshold of the greatest variance between the two classes."""
    counts = np.bincount(gray(image).ravel(), minlength=256).astype(float)
    below = counts.cumsum()
    mass = (counts * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(below * above * (mass / below - (mass[-1] - mass) / above) ** 2)
    return int(between.argmax())


def binarize(image: np.ndarray, size: int = 11, offset: float = 2) -> np.ndarray:
    """Of thresholding globally, by a Gaussian and by a plain local mean, the result of greatest deviation, the first of equal ones."""
    g = gray(image)
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    found = [np.where(g > t, 255, 0).astype(np.uint8) for t in (otsu(g), gaussian(g, sigma, size) - offset, window_mean(g, size) - offset)]
    return max(found, key=lambda a: a.std())


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """About the center, nearest pixel, edges repeated."""
    h, w = image.shape[:2]
    a = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w]
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    sy = np.clip(np.rint(np.cos(a) * dy - np.sin(a) * dx + (h - 1) / 2), 0, h - 1).astype(int)
    sx = np.clip(np.rint(np.sin(a) * dy + np.cos(a) * dx + (w - 1) / 2), 0, w - 1).astype(int)
    return image[sy, sx]


def skew(image: np.ndarray, limit: float = 45) -> float:
    """Angle under the limit at which the rows of dark pixels stand out most: coarse steps first, then finer ones around the best.

    Only the dark pixels are turned. Their number bounds the work, so a large image is halved until few are left.
    """
    g = gray(image)
    while g.size > 1 << 20:
        g = g[::2, ::2]
    y, x = np.nonzero(g <= otsu(g))
    if not len(y) or len(y) == g.size:
        return 0.0
    y, x = y - g.shape[0] // 2, x - g.shape[1] // 2  # whole numbers: halves would round in pairs at 0 degrees alone

    def spread(a: float) -> float:
        place = np.rint(y * np.cos(np.deg2rad(a)) + x * np.sin(np.deg2rad(a))).astype(int)
        counts = np.bincount(place - place.min()).astype(float)
        return float((counts * counts).sum())

    best, step = 0.0, 1.0
    angles = np.arange(-limit + step, limit, step)
    while True:
        best = float(max(angles, key=lambda a: (spread(a), -abs(a))))
        if step <= 0.1:
            return best
        angles, step = np.linspace(best - step, best + step, 11), step / 5


def deskew(image: np.ndarray) -> np.ndarray:
    a = skew(image)
    return rotate(image, a) if abs(a) > 0.5 else image


def resize(image: np.ndarray, factor: float) -> np.ndarray:
    h, w = (max(1, int(round(n * factor))) for n in image.shape[:2])
    y = np.minimum((np.arange(h) / factor).astype(int), image.shape[0] - 1)
    x = np.minimum((np.arange(w) / factor).astype(int), image.shape[1] - 1)
    return image[np.ix_(y, x)]


def scale(image: np.ndarray) -> np.ndarray:
    """Heights under 750 up to 1500, over 3000 down to it."""
    h = image.shape[0]
    return resize(image, 1500 / h) if h < 750 or h > 3000 else image


def sharpen(image: np.ndarray) -> np.ndarray:
    g = gray(image).astype(float)
    return np.clip(np.rint(10 * g - 9 * window_mean(g, 3)), 0, 255).astype(np.uint8)


def optimal_resolution(image: np.ndarray, dpi: int = 300) -> np.ndarray:
    return resize(image, dpi / 150) if dpi > 150 else image


def denoise(image: np.ndarray, strength: float | None = None, patch: int = 5, reach: int = 5) -> np.ndarray:
    """Non-local means: pixels weigh by how alike the patches around them are. Without a strength, 1.15 times the noise's estimated deviation."""
    g = gray(image).astype(float)
    if strength is None:
        # Immerkaer's estimate: what a Laplacian that is blind to edges and slopes leaves.
        wide, (h, w) = _padded(g, 1), g.shape
        left = sum(k * wide[y : y + h, x : x + w] for y, row in enumerate(((1, -2, 1), (-2, 4, -2), (1, -2, 1))) for x, k in enumerate(row))
        strength = 1.15 * float(np.abs(left).mean()) * np.sqrt(np.pi / 2) / 6
    if strength <= 0:
        return gray(image)
    total, weight = np.zeros(g.shape), np.zeros(g.shape)
    for _, _, moved in _shifts(g, 2 * reach + 1):
        near = np.exp(-window_mean((moved - g) ** 2, patch) / strength**2)
        total += near * moved
        weight += near
    return np.rint(total / weight).astype(np.uint8)


def _cross(image: np.ndarray, pick: Callable) -> np.ndarray:
    """pick over each pixel and its four neighbours."""
    return pick([moved for dy, dx, moved in _shifts(image, 3) if abs(dy) + abs(dx) <= 1], axis=0)


def open_and_close(image: np.ndarray) -> np.ndarray:
    """Opening, then closing, by a disk of radius 1."""
    g = gray(image)
    for pick in (np.min, np.max, np.max, np.min):
        g = _cross(g, pick)
    return g.astype(np.uint8)


def sauvola(image: np.ndarray, size: int = 25, k: float = 0.2, span: float = 128) -> np.ndarray:
    """Local threshold from the mean and deviation of a window."""
    g = gray(image).astype(float)
    mean = window_mean(g, size)
    deviation = np.sqrt(np.maximum(window_mean(g * g, size) - mean * mean, 0))
    return np.where(g > mean * (1 + k * (deviation / span - 1)), 255, 0).astype(np.uint8)


def advanced(image: np.ndarray) -> np.ndarray:
    """Denoising, adaptive equalisation, opening and closing, and a local threshold."""
    return sauvola(open_and_close(enhance_contrast(denoise(image), clip=0.03 * 256)))


def _away_from(image: np.ndarray, still: np.ndarray | float, factor: float) -> np.ndarray:
    return np.clip(still + factor * (image.astype(float) - still), 0, 255)


def for_text_model(image: np.ndarray) -> np.ndarray:
    """What a line recogniser takes: equalised, smoothed a little, contrast by 1.5 and sharpness by 2."""
    x = gaussian(enhance_contrast(image, clip=0.03 * 256), 0.5)
    x = _away_from(x, round(float(x.mean())), 1.5)
    smooth = (9 * window_mean(x, 3) + 4 * x) / 13
    return np.rint(_away_from(x, smooth, 2.0)).astype(np.uint8)


def for_layout_model(image: np.ndarray, most: int = 1000, turned: int = 1) -> np.ndarray:
    """What a layout model takes: three channels, at most `most` pixels a side, contrast by 1.2, upright by its orientation tag (1 to 8)."""
    x = np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image
    if max(x.shape[:2]) > most:
        x = resize(x, most / max(x.shape[:2]))
    x = np.rint(_away_from(x, round(float(gray(x).mean())), 1.2)).astype(np.uint8)
    if turned in (2, 4, 5, 7):
        x = x[:, ::-1]
    return np.rot90(x, {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(turned, 0))


STEPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "noise_reduction": reduce_noise, "contrast_enhancement": enhance_contrast, "deskew": deskew, "rotation_correction": deskew, "binarization": binarize, "scaling": scale, "sharpening": sharpen, "advanced": advanced, "text_model": for_text_model, "layout_model": lambda x: gray(for_layout_model(x)),
}


def preprocess(image: np.ndarray, steps: tuple[str, ...] = ("noise_reduction", "contrast_enhancement", "deskew", "binarization"), dpi: int | None = None) -> tuple[np.ndarray, list[str]]:
    """The image after the steps, and which of them were applied. Unknown or failing ones are skipped."""
    done = []
    for name in steps:
        if name not in STEPS:
            log.warning("no step %s", name)
            continue
        try:
            image = STEPS[name](image)
            done.append(name)
        except (ValueError, IndexError, ZeroDivisionError) as e:
            log.warning("step %s failed: %s", name, e)
    return (optimal_resolution(image, dpi) if dpi else image), done


def preprocess_pages(pages: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """Pages (doc_id, page_number, width, height, pixels) of gray images, preprocessed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                image, done = preprocess(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width), steps)
                out.append((r.doc_id, r.page_number, image.shape[1], image.shape[0], image.tobytes(), done))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "width", "height", "pixels", "applied"])

    return pages.mapInPandas(run, "doc_id long, page_number int, width int, height int, pixels binary, applied array<string>")
