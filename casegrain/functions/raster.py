"""Statistics of rasters in numpy; each takes an array [height, width, 3] of bytes in RGB order.

Decoding is left to Spark's image source (PNG, JPEG, BMP, GIF), which gives BGR bytes; ``from_image`` turns those.
A JPEG's compression is imitated by its transform and quantisation, not by an encoder.
"""

from __future__ import annotations

import numpy as np

from casegrain.operators.encoders import scaled_table

MOST_SIDE, GHOST_SIDE = 512, 1024


def from_image(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    own = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(own, 3, axis=2) if channels == 1 else own[:, :, 2::-1]


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def resized(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the cells of a grid; single pixels where cells are smaller than those."""
    ys, xs = (np.linspace(0, n, m + 1).astype(int) for n, m in ((plane.shape[0], height), (plane.shape[1], width)))
    sums = np.pad(plane.astype(np.float64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    y0, x0 = np.minimum(ys[:-1], plane.shape[0] - 1), np.minimum(xs[:-1], plane.shape[1] - 1)
    y1, x1 = np.maximum(ys[1:], y0 + 1), np.maximum(xs[1:], x0 + 1)
    total = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    return total / np.outer(y1 - y0, x1 - x0)


def _hex(bits: np.ndarray) -> str:
    return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"


def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    out = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def average_hash(rgb: np.ndarray) -> str:
    small = resized(grey(rgb), 8, 8)
    return _hex(small > small.mean())


def difference_hash(rgb: np.ndarray) -> str:
    small = resized(grey(rgb), 8, 9)
    return _hex(small[:, 1:] > small[:, :-1])


def perceptual_hash(rgb: np.ndarray) -> str:
    d = dct_matrix(32)
    low = (d @ resized(grey(rgb), 32, 32) @ d.T)[:8, :8]
    return _hex(low > np.median(low))


def mean_colour(rgb: np.ndarray) -> tuple[int, int, int]:
    return tuple(int(round(resized(rgb[:, :, c], 64, 64).mean())) for c in range(3))


def last_bits(rgb: np.ndarray) -> dict:
    density = float((rgb & 1).mean())
    return {"density": round(density, 4), "anomaly": abs(density - 0.5) > 0.15}


def _entropy(p: np.ndarray | float) -> float:
    return 0.0 if p <= 0 or p >= 1 else float(-p * np.log2(p) - (1 - p) * np.log2(1 - p))


def bit_planes(rgb: np.ndarray) -> list[list[tuple[float, float]]]:
    """[channel][plane]: density and entropy."""
    out = []
    for c in range(3):
        planes = [float((rgb[:, :, c] >> k & 1).mean()) for k in range(8)]
        out.append([(round(p, 6), round(_entropy(p), 6)) for p in planes])
    return out


def pairs_of_values(rgb: np.ndarray) -> list[dict]:
    """The chi-square test of pairs of values for each channel."""
    out = []
    for c in range(3):
        counts = np.bincount(rgb[:, :, c].ravel(), minlength=256).reshape(128, 2)
        expected = counts.sum(axis=1) / 2
        use = expected > 5
        chi, dof = float((((counts[:, 0] - expected) ** 2)[use] / expected[use]).sum()), int(use.sum())
        out.append({"chi_square": chi, "dof": dof, "uniform": dof > 30 and chi < 0.4 * dof})
    return out


def spectrum_peak(rgb: np.ndarray) -> dict:
    """High frequencies' 99.5th percentile over their mean; above 18 speaks for an upsampling grid."""
    own = grey(rgb)[:MOST_SIDE, :MOST_SIDE]
    size = np.abs(np.fft.fftshift(np.fft.fft2(own - own.mean())))
    y, x = np.indices(own.shape)
    far = np.hypot(y - own.shape[0] // 2, x - own.shape[1] // 2) > min(own.shape) / 4
    high = size[far]
    ratio = float(np.percentile(high, 99.5) / max(high.mean(), 1e-9)) if high.size else 0.0
    return {"ratio": round(ratio, 3), "grid": ratio > 18}


def recompressed(plane: np.ndarray, quality: int) -> np.ndarray:
    """A grey plane through the 8x8 transform, quantised at a quality, and back; cut to whole blocks."""
    h, w = plane.shape[0] // 8 * 8, plane.shape[1] // 8 * 8
    d, q = dct_matrix(8), np.array(scaled_table(quality), float).reshape(8, 8)
    blocks = plane[:h, :w].reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3) - 128.0
    kept = np.round(d @ blocks @ d.T / q) * q
    return np.clip(d.T @ kept @ d + 128.0, 0, 255).transpose(0, 2, 1, 3).reshape(h, w)


def error_level(rgb: np.ndarray, quality: int = 90) -> dict:
    own = grey(rgb)
    back = recompressed(own, quality)
    off = np.abs(own[: back.shape[0], : back.shape[1]] - back)
    return {"max": float(off.max(initial=0)), "mean": float(off.mean()) if off.size else 0.0}


def ghost(rgb: np.ndarray, qualities: tuple[int, ...] = (50, 60, 65, 70, 75, 80, 85, 90)) -> dict:
    """Local minima of the error over qualities, and how unevenly the best quality is spread over 16x16 cells."""
    own = grey(rgb)[:GHOST_SIDE, :GHOST_SIDE]
    if min(own.shape) < 32:
        return {"minima": [], "spread": 0.0, "suspected": False}
    maps = np.stack([(own[: own.shape[0] // 8 * 8, : own.shape[1] // 8 * 8] - recompressed(own, q)) ** 2 for q in qualities])
    errors = maps.mean(axis=(1, 2))
    minima = [qualities[k] for k in range(1, len(qualities) - 1) if errors[k] < errors[k - 1] and errors[k] <= errors[k + 1]]
    n, m = maps.shape[1] // 16, maps.shape[2] // 16
    cells = maps[:, : n * 16, : m * 16].reshape(len(qualities), n, 16, m, 16).mean(axis=(2, 4))
    spread = float(np.var(np.array(qualities)[cells.argmin(axis=0)])) if cells.size else 0.0
    return {"minima": minima, "spread": round(spread, 3), "suspected": bool(minima) and spread > 180}


def mosaic(rgb: np.ndarray) -> dict:
    """Energy that a colour filter array leaves in the corners of the residual's spectrum, and red-green correlation."""
    own = rgb[:MOST_SIDE, :MOST_SIDE].astype(float)
    if min(own.shape[:2]) < 16:
        return {"energy": 0.0, "correlation": 0.0, "present": False}
    near = lambda p: (np.roll(p, 1, 0) + np.roll(p, -1, 0) + np.roll(p, 1, 1) + np.roll(p, -1, 1)) / 4
    rest = [own[:, :, c] - near(own[:, :, c]) for c in range(3)]
    size = np.abs(np.fft.fft2(rest[1]))
    h, w = size.shape[0] // 2, size.shape[1] // 2
    corner = size[h - 1 : h + 2, w - 1 : w + 2].mean() / max(size.mean(), 1e-9)
    a, b = rest[0].ravel(), rest[1].ravel()
    corr = float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else 0.0
    energy = float(min(1.0, corner / 5))
    return {"energy": round(energy, 4), "correlation": round(corr, 4), "present": energy >= 0.20 and corr > 0.15}


def copy_move(rgb: np.ndarray, block: int = 16, step: int = 8, ahead: int = 30, apart: int = 32) -> list[tuple[int, int, int]]:
    """(dy, dx, matches) of shifts, rounded to 16, that at least four pairs of like blocks share.

    Blocks in order of mean and spread are compared with the next ``ahead`` ones only.
    """
    own = grey(rgb)[:MOST_SIDE, :MOST_SIDE]
    places = [(y, x) for y in range(0, own.shape[0] - block + 1, step) for x in range(0, own.shape[1] - block + 1, step)]
    if len(places) < 2:
        return []
    tiles = np.stack([own[y : y + block, x : x + block].ravel() for y, x in places])
    keep = tiles.std(axis=1) > 2
    at, tiles = np.array(places)[keep], tiles[keep]
    order = np.lexsort((tiles.std(axis=1), tiles.mean(axis=1)))
    at, tiles = at[order], tiles[order]
    shifts: dict[tuple[int, int], int] = {}
    for k in range(1, ahead):
        if k >= len(at):
            break
        far = np.hypot(*(at[k:] - at[:-k]).T) >= apart
        off = np.abs(tiles[k:] - tiles[:-k]).max(axis=1) / 255
        for dy, dx in (at[k:] - at[:-k])[far & (off < 0.04)]:
            key = (round(abs(int(dy)) / 16) * 16, round(abs(int(dx)) / 16) * 16)
            shifts[key] = shifts.get(key, 0) + 1
    return sorted(((dy, dx, n) for (dy, dx), n in shifts.items() if n >= 4), key=lambda s: (-s[2], s))


def difference(a: np.ndarray, b: np.ndarray) -> dict:
    """How two rasters of one size differ: percent altered, mean square, largest, and 1 - mse / 255^2."""
    if a.shape != b.shape:
        return {"comparable": False}
    off = np.abs(a.astype(int) - b.astype(int))
    mse = float((off**2).mean())
    return {"comparable": True, "altered_pct": round(100 * float((off.max(axis=2) > 0).mean()), 3), "mse": round(mse, 3), "max": int(off.max()), "ssim": round(1 - mse / 255**2, 4), "identical": mse == 0}


def scrambled(rgb: np.ndarray) -> dict:
    """Whether a raster is noise: mean gradient, entropy of the first and last bits."""
    own = rgb[:: max(1, rgb.shape[0] // MOST_SIDE), :: max(1, rgb.shape[1] // MOST_SIDE)].astype(int)
    steps = [np.abs(np.diff(own, axis=k)).mean() if own.shape[k] > 1 else 0.0 for k in (0, 1)]
    gradient = float(np.mean(steps))
    top, last = (_entropy(float((own >> k & 1).mean())) for k in (7, 0))
    confidence = 0.95 if gradient >= 80 and min(top, last) > 0.98 else 0.75 if gradient >= 70 and top > 0.95 else 0.0
    return {"gradient": round(gradient, 2), "confidence": confidence, "encrypted": confidence > 0, "hidden_hint": last > 0.99 and top < 0.75}
