"""Image kernels in NumPy: uint8 BGR arrays in, numbers or arrays out.

No native imaging library is needed. Resizing averages areas, blurs are separable with mirrored
borders, edges are thinned Sobel gradients joined by hysteresis; they follow the public definitions of
these operations, so results agree with other libraries up to rounding.
"""

from __future__ import annotations

import numpy as np


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    b, g, r = (image[..., i].astype(np.float64) for i in range(3))
    return np.clip(np.rint(0.114 * b + 0.587 * g + 0.299 * r), 0, 255).astype(np.uint8)


def _area_weights(n: int, m: int) -> np.ndarray:
    """Matrix (m, n) that averages n cells into m by overlap."""
    edges = np.linspace(0, n, m + 1)
    cells = np.arange(n)
    over = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    w = np.clip(over, 0, None)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area-average resize, in float64."""
    a = image.astype(np.float64)
    rows, cols = _area_weights(a.shape[0], height), _area_weights(a.shape[1], width)
    if a.ndim == 2:
        return rows @ a @ cols.T
    return np.stack([rows @ a[..., c] @ cols.T for c in range(a.shape[2])], axis=-1)


def to_bytes(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def _filter(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r = len(kernel) // 2
    pad = [(r, r) if i == axis else (0, 0) for i in range(a.ndim)]
    p = np.pad(a, pad, mode="reflect" if a.shape[axis] > r else "edge")
    out = np.zeros(a.shape)
    for i, w in enumerate(kernel):
        out += w * np.take(p, range(i, i + a.shape[axis]), axis=axis)
    return out


def gaussian(a: np.ndarray, size: int, sigma: float = 0.0) -> np.ndarray:
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    return _filter(_filter(a.astype(np.float64), k, 0), k, 1)


def _shifted(a: np.ndarray, dy: int, dx: int, fill=0) -> np.ndarray:
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = a[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def _any_within(mask: np.ndarray, before: int, behind: int, axis: int) -> np.ndarray:
    """Whether any cell from ``before`` cells before to ``behind`` cells behind is set, by running counts."""
    n = mask.shape[axis]
    count = np.insert(mask.cumsum(axis=axis), 0, 0, axis=axis)
    at = np.arange(n)
    return np.take(count, np.minimum(at + behind + 1, n), axis=axis) > np.take(count, np.maximum(at - before, 0), axis=axis)


def dilate(mask: np.ndarray, size: int = 3, times: int = 1) -> np.ndarray:
    """Square dilation; an even square reaches farther ahead, so that it undoes the shift of ``erode``."""
    for _ in range(times):
        mask = _any_within(_any_within(mask, size // 2, (size - 1) // 2, 0), size // 2, (size - 1) // 2, 1)
    return mask


def erode(mask: np.ndarray, size: int = 3, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = ~_any_within(_any_within(~mask, (size - 1) // 2, size // 2, 0), (size - 1) // 2, size // 2, 1)
    return mask


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    return dilate(erode(mask, size), size)


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    return erode(dilate(mask, size), size)


def box(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square of odd size, mirrored at the borders, by running sums."""
    r = size // 2
    for axis in range(2):
        pad = [(r, r) if i == axis else (0, 0) for i in range(2)]
        total = np.insert(np.pad(a, pad, mode="reflect" if a.shape[axis] > r else "edge").cumsum(axis=axis), 0, 0, axis=axis)
        n = a.shape[axis]
        a = (np.take(total, np.arange(size, n + size), axis=axis) - np.take(total, np.arange(n), axis=axis)) / size
    return a


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = a.astype(np.float64)
    smooth, slope = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    return _filter(_filter(a, slope, 1), smooth, 0), _filter(_filter(a, slope, 0), smooth, 1)


def canny(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edge mask: L1 gradients, thinned across the edge, weak parts kept where they touch strong ones."""
    gx, gy = sobel(a)
    mag = np.abs(gx) + np.abs(gy)
    angle = np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    thin = np.zeros(mag.shape, bool)
    for k, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
        # a neighbour shifted by (-dy, -dx) stands where the centre is
        ahead, behind = _shifted(mag, -dy, -dx), _shifted(mag, dy, dx)
        thin |= (angle == k) & (mag > behind) & (mag >= ahead)
    weak, edge = thin & (mag > low), thin & (mag > high)
    while True:
        more = dilate(edge) & weak
        if (more == edge).all():
            return edge
        edge = more


def laplacian_variance(a: np.ndarray) -> float:
    p = np.pad(a.astype(np.float64), 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(lap.var())


def measures(image: np.ndarray) -> dict[str, float]:
    g = gray(image)
    return {"sharpness": laplacian_variance(g), "brightness": float(g.mean()), "contrast": float(g.std()), "edge_density": float(canny(g, 80, 180).mean())}


def text_density(image: np.ndarray) -> float:
    return float(canny(gray(image), 60, 160).mean())


def dhash(image: np.ndarray) -> str:
    """64-bit difference hash, 16 hexadecimal digits."""
    small = to_bytes(resize(gray(image), 9, 8)).astype(int)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


#: Sizes (width, height) at which frames are compared: changed share, mean difference, motion.
COMPARED = ((320, 180), (256, 144), (224, 224))


def miniatures(image: np.ndarray) -> list[bytes]:
    """The frame at the sizes of COMPARED, all that comparisons need of it."""
    g = gray(image)
    return [to_bytes(resize(g, *size)).tobytes() for size in COMPARED]


def deltas(before: list[bytes], now: list[bytes]) -> tuple[float, float, float]:
    """(changed share, mean difference, motion) between the miniatures of two frames."""
    change, diff, move = (np.abs(np.frombuffer(a, np.uint8).astype(int) - np.frombuffer(b, np.uint8)) for a, b in zip(before, now))
    motion = min(0.85 * float((move > 22).mean()) + 0.6 * float(move.mean() / 255), 0.65)
    return float((change > 18).mean()), float(diff.mean() / 255), motion


def change_ratio(before: np.ndarray, now: np.ndarray) -> float:
    return deltas(miniatures(before), miniatures(now))[0]


def mean_diff(before: np.ndarray, now: np.ndarray) -> float:
    return deltas(miniatures(before), miniatures(now))[1]


def motion(before: np.ndarray, now: np.ndarray) -> float:
    return deltas(miniatures(before), miniatures(now))[2]


def minmax(a: np.ndarray, top: float = 1.0) -> np.ndarray:
    low, high = float(a.min()), float(a.max())
    return (a - low) / (high - low) * top if high > low else np.zeros(a.shape)


def render(image: np.ndarray) -> np.ndarray:
    """Grey page of standard size and contrast, the base of all duplicate signatures."""
    return to_bytes(resize(to_bytes(minmax(gray(image).astype(np.float64), 255)), 512, 704))


def content_signature(page: np.ndarray | None) -> np.ndarray:
    return np.zeros((48, 48)) if page is None else minmax(to_bytes(resize(page, 48, 48)).astype(np.float64))


def raw_signature(image: np.ndarray | None) -> np.ndarray:
    return np.zeros((56, 56)) if image is None else minmax(to_bytes(resize(gray(image), 56, 56)).astype(np.float64))


def adaptive_dark(a: np.ndarray, block: int, c: float) -> np.ndarray:
    """Pixels darker than their Gaussian neighbourhood by more than ``c``."""
    a = a.astype(np.float64)
    r = block // 2
    local = gaussian(np.pad(a, r, mode="edge"), block)[r : r + a.shape[0], r : r + a.shape[1]]
    return a <= np.rint(local) - c


def layout_signature(page: np.ndarray | None) -> np.ndarray:
    return np.zeros((40, 40)) if page is None else adaptive_dark(to_bytes(resize(page, 40, 40)), 15, 7).astype(np.float64)


def histogram_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation of 32-bin histograms of 0..1 images; 1 if either histogram is flat."""
    x, y = (np.bincount((np.floor(v * 255).astype(int) // 8).ravel(), minlength=32).astype(np.float64) for v in (a, b))
    sx, sy = x.std(), y.std()
    return float(((x - x.mean()) * (y - y.mean())).mean() / (sx * sy)) if sx * sy > 0 else 1.0


def layout_diff(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a - b).mean())


def profile_diff(a: np.ndarray, b: np.ndarray) -> float:
    return float((np.abs(a.mean(axis=1) - b.mean(axis=1)).mean() + np.abs(a.mean(axis=0) - b.mean(axis=0)).mean()) / 2)


def cluster_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two raw signatures."""
    return max(0.0, min(0.7 * histogram_similarity(a, b) + 0.3 * (1 - min(layout_diff(a, b) / 0.14, 1.0)), 1.0))


def components(mask: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """8-connected components: labels from 1, and (x, y, width, height, area) of each.

    Runs of set pixels are joined row by row with a union-find.
    """
    labels = np.zeros(mask.shape, np.int32)
    up: list[int] = [0]
    runs: list[tuple[int, int, int, int]] = []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    before: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].view(np.int8) if mask.dtype == bool else (mask[y] > 0).astype(np.int8), [0]])))
        now, i = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            own = len(up)
            up.append(own)
            while i and before[i - 1][1] >= a:
                i -= 1
            while i < len(before) and before[i][0] <= b:
                if before[i][1] >= a:
                    x, z = find(own), find(before[i][2])
                    up[max(x, z)] = min(x, z)
                i += 1
            now.append((a, b, own))
            runs.append((y, a, b, own))
        before = now
    number: dict[int, int] = {}
    stats: list[list[int]] = []
    for y, a, b, own in runs:
        k = number.setdefault(find(own), len(number) + 1)
        labels[y, a:b] = k
        if k > len(stats):
            stats.append([a, y, b, y + 1, b - a])
        else:
            s = stats[k - 1]
            s[0], s[2], s[3], s[4] = min(s[0], a), max(s[2], b), y + 1, s[4] + b - a
    return labels, [(a, y, b - a, e - y, n) for a, y, b, e, n in stats]


def structure_tokens(page: np.ndarray | None) -> list[str]:
    """Places and sizes of ink components, as a set of tokens."""
    if page is None:
        return []
    h, w = page.shape
    _, found = components(opened(adaptive_dark(page, 31, 11), 2))
    out = {f"r{min(y * 8 // h, 7)}c{min(x * 8 // w, 7)}s{min(int(n / (h * w) * 8000), 9)}" for x, y, cw, ch, n in found if n >= 18 and cw >= 3 and ch >= 3}
    return sorted(out)


def thumbnail(image: np.ndarray, width: int = 360) -> np.ndarray:
    h, w = image.shape[:2]
    return to_bytes(resize(image, width, max(int(h * width / max(w, 1)), 1)))


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray, fill: float = 255.0) -> np.ndarray:
    """Samples at real coordinates; ``fill`` outside."""
    h, w = image.shape[:2]
    a = image.astype(np.float64).reshape(h, w, -1)
    inside = (x > -1) & (x < w) & (y > -1) & (y < h)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        ok = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        return np.where(ok[..., None], a[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)], fill)

    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return to_bytes(np.where(inside[..., None], out, fill)).reshape(*x.shape, *image.shape[2:])


def rotate(image: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise rotation on a white ground large enough for all of it."""
    degrees %= 360
    if degrees % 90 == 0:
        return np.rot90(image, -(degrees // 90)).copy()
    t = np.deg2rad(degrees)
    c, s = np.cos(t), np.sin(t)
    h, w = image.shape[:2]
    nw, nh = int(np.ceil(abs(w * c) + abs(h * s))), int(np.ceil(abs(w * s) + abs(h * c)))
    yy, xx = np.mgrid[0:nh, 0:nw]
    dx, dy = xx - (nw - 1) / 2, yy - (nh - 1) / 2
    return bilinear(image, c * dx + s * dy + (w - 1) / 2, -s * dx + c * dy + (h - 1) / 2)
