"""Pictures made readable: grey, stretched, sharpened, cut to black and white, trimmed, without speckles. NumPy on raw pixels."""

from __future__ import annotations

import numpy as np

#: Shares of pixels beyond black and white, sharpening, what is added to Otsu's threshold, margin, least speck.
CLIP, SHARPEN, OTSU_BIAS, MARGIN, SPECK = 0.01, 0.85, 8, 8, 6


def to_grey(pixels: np.ndarray) -> np.ndarray:
    """Height x width x 3 or 4 (or already grey) as 8-bit grey; transparent pixels are white."""
    if pixels.ndim == 2:
        return pixels.astype(np.uint8)
    rgb = pixels[..., :3].astype(np.float64)
    if pixels.shape[-1] == 4:
        alpha = pixels[..., 3:4] / 255.0
        rgb = rgb * alpha + 255.0 * (1 - alpha)
    return np.clip(rgb @ np.array([0.299, 0.587, 0.114]) + 0.5, 0, 255).astype(np.uint8)


def stretch(grey: np.ndarray, clip: float = CLIP) -> np.ndarray:
    low, high = np.quantile(grey, [clip, 1 - clip])
    return grey if high <= low else np.clip((grey.astype(np.float64) - low) * 255 / (high - low) + 0.5, 0, 255).astype(np.uint8)


def _blur(grey: np.ndarray) -> np.ndarray:
    padded = np.pad(grey.astype(np.float64), 1, mode="edge")
    h, w = grey.shape
    return sum(padded[i : i + h, j : j + w] for i in range(3) for j in range(3)) / 9


def unsharp(grey: np.ndarray, amount: float = SHARPEN) -> np.ndarray:
    return np.clip(grey + amount * (grey - _blur(grey)) + 0.5, 0, 255).astype(np.uint8)


def otsu(grey: np.ndarray) -> int:
    """The threshold that parts dark and light pixels with the greatest variance between them."""
    counts = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    below = np.cumsum(counts)
    sums = np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.nanargmax(np.nan_to_num(between, nan=-1.0)))


def without_specks(dark: np.ndarray, least: int = SPECK) -> np.ndarray:
    """Connected dark pixels of fewer than `least` become light."""
    out = dark.copy()
    seen = np.zeros(dark.shape, dtype=bool)
    for start in zip(*np.nonzero(dark)):
        if seen[start]:
            continue
        seen[start] = True
        stack, group = [start], []
        while stack:
            y, x = stack.pop()
            group.append((y, x))
            for j in range(max(0, y - 1), min(dark.shape[0], y + 2)):
                for i in range(max(0, x - 1), min(dark.shape[1], x + 2)):
                    if dark[j, i] and not seen[j, i]:
                        seen[j, i] = True
                        stack.append((j, i))
        if len(group) < least:
            out[tuple(zip(*group))] = False
    return out


def trim(image: np.ndarray, margin: int = MARGIN) -> np.ndarray:
    """Cut to what isn't nearly white, with a margin; an empty picture stays."""
    ys, xs = np.nonzero(image < 245)
    if not len(ys):
        return image
    return image[max(0, ys.min() - margin) : ys.max() + 1 + margin, max(0, xs.min() - margin) : xs.max() + 1 + margin]


def enhance(pixels: np.ndarray, photo: bool = False) -> np.ndarray:
    """A scan as black on white; a photo is stretched and sharpened only."""
    grey = unsharp(stretch(to_grey(pixels)))
    if photo:
        return grey
    dark = without_specks(grey < min(255, otsu(grey) + OTSU_BIAS))
    return trim(np.where(dark, 0, 255).astype(np.uint8))
