"""Page detection and clean-up on camera frames, in NumPy.

Outlines come from connected edge components: their convex hulls stand in for contours, reduced to
four corners where the hull is nearly a quadrilateral and to the smallest enclosing rectangle else.
Detection promises the stated measures, not the pixels of any particular imaging library. The thresholds
in ``detect``, ``crop`` and ``finish`` and in the measures they call are fixed values. Of ``denoise`` only
strength and patch are: a search of 7 x 7 places stands for one of 21 x 21, at a ninth of the work.
"""

from __future__ import annotations

import numpy as np

from . import images as im


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of integer points, counter-clockwise in x-right, y-up sense."""
    pts = sorted(map(tuple, np.unique(points, axis=0).tolist()))
    if len(pts) < 3:
        return np.array(pts, float)

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(reversed(pts)), float)


def polygon_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def smallest_rectangle(p: np.ndarray) -> np.ndarray:
    """Corners of the rectangle of least area around a hull: one side lies on a hull edge."""
    best = None
    for a, b in zip(p, np.roll(p, -1, axis=0)):
        d = (b - a) / max(np.hypot(*(b - a)), 1e-9)
        n = np.array([-d[1], d[0]])
        u, v = p @ d, p @ n
        area = (u.max() - u.min()) * (v.max() - v.min())
        if best is None or area < best[0]:
            best = (area, np.array([d * s + n * t for s, t in ((u.min(), v.min()), (u.max(), v.min()), (u.max(), v.max()), (u.min(), v.max()))]))
    return best[1]


def order_corners(p: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left by the extremes of x + y and y - x."""
    total, skew = p.sum(axis=1), p[:, 1] - p[:, 0]
    return np.array([p[total.argmin()], p[skew.argmin()], p[total.argmax()], p[skew.argmax()]])


def corners(outline: np.ndarray) -> np.ndarray:
    quad = order_corners(outline)
    whole = polygon_area(outline)
    return quad if len(np.unique(quad, axis=0)) == 4 and polygon_area(quad) >= 0.93 * whole else smallest_rectangle(outline)


def perspective_score(quad: np.ndarray) -> float:
    """Agreement of opposite sides, relative to the top and the left one; 1 for a parallelogram."""
    tl, tr, br, bl = quad
    side = lambda a, b: float(np.hypot(*(a - b)))
    unlike = lambda a, b: min(abs(a - b) / max(a, 1.0), 1.0)
    return 1 - (unlike(side(tl, tr), side(bl, br)) + unlike(side(tl, bl), side(tr, br))) / 2


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    rows, rhs = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1.0).reshape(3, 3)


def warp(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The quadrilateral as an upright rectangle."""
    tl, tr, br, bl = quad
    w = max(int(max(np.hypot(*(br - bl)), np.hypot(*(tr - tl)))), 2)
    h = max(int(max(np.hypot(*(tr - br)), np.hypot(*(tl - bl)))), 2)
    m = homography(np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float), quad)
    yy, xx = np.mgrid[0:h, 0:w]
    d = m[2, 0] * xx + m[2, 1] * yy + m[2, 2]
    return im.bilinear(image, (m[0, 0] * xx + m[0, 1] * yy + m[0, 2]) / d, (m[1, 0] * xx + m[1, 1] * yy + m[1, 2]) / d)


def border_touch(x: int, y: int, w: int, h: int, width: int, height: int) -> float:
    mx, my = max(int(0.04 * width), 8), max(int(0.04 * height), 8)
    return sum([x <= mx, y <= my, x + w >= width - mx, y + h >= height - my]) / 4


def single_page_shape(aspect: float, border: float) -> float:
    return max(0.0, 1 - 0.65 * min(abs(aspect - 0.72) / 0.38, 1.0) - 0.6 * max(0.0, (aspect - 0.92) / 0.35) - 0.45 * border)


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue 0..179, saturation and value 0..255."""
    b, g, r = (image[..., i].astype(float) for i in range(3))
    v = np.maximum(np.maximum(b, g), r)
    c = v - np.minimum(np.minimum(b, g), r)
    safe = np.where(c > 0, c, 1)
    hue = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30 % 180
    return np.stack([np.where(c > 0, np.rint(hue), 0), np.rint(np.where(v > 0, c / np.where(v > 0, v, 1) * 255, 0)), v], axis=-1)


def occlusion(image: np.ndarray) -> float:
    """Share of skin-coloured pixels."""
    h, s, v = np.moveaxis(hsv(image), -1, 0)
    return float(((h <= 25) & (s >= 25) & (s <= 180) & (v >= 60)).mean())


def otsu(g: np.ndarray) -> int:
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    w, m = n.cumsum(), (n * np.arange(256)).cumsum()
    between = (m[-1] * w - m * w[-1]) ** 2 / np.maximum(w * (w[-1] - w), 1e-9)
    return int(between.argmax())


def steady(mask: np.ndarray) -> np.ndarray:
    """Gaps of 3 % of the image closed, specks of a third of that removed."""
    size = max(round(min(mask.shape) * 0.03), 5) | 1
    return im.opened(im.closed(mask, size), max(size // 3, 3))


def page_mask(image: np.ndarray) -> np.ndarray:
    """Bright, unsaturated pixels by percentiles."""
    g, x = im.gray(image), hsv(image)
    cut = lambda a, share, least, most: int(np.clip(np.percentile(a, share), least, most))
    return steady((g >= cut(g, 72, 120, 245)) & (x[..., 1] <= cut(x[..., 1], 55, 26, 110)) & (x[..., 2] >= cut(x[..., 2], 70, 120, 245)))


def light_mask(image: np.ndarray) -> np.ndarray:
    """The lighter side of Otsu's threshold, or the darker one where the light lies along the border."""
    g = im.to_bytes(im.gaussian(im.gray(image), 5))
    mask = g > otsu(g)
    n = max(1, min(12, *(s // 4 for s in mask.shape)))
    border = np.concatenate([mask[:n].ravel(), mask[-n:].ravel(), mask[:, :n].ravel(), mask[:, -n:].ravel()])
    return steady(~mask if border.mean() > 0.7 else mask)


def background_intrusion(image: np.ndarray) -> float:
    """Share of the image that is no page and lies within 12 pixels of the border."""
    mask = light_mask(image)
    if not mask.any():
        return 1.0
    band = np.ones(mask.shape, bool)
    band[12:-12, 12:-12] = False
    return float((~mask & band).mean())


def gutter(image: np.ndarray) -> float:
    """Dark fold in the middle, relative to the outer sides."""
    g = im.gray(image)
    w = g.shape[1]
    if w < 60:
        return 0.0
    mid, half, side = w // 2, max(int(0.06 * w), 10), max(int(0.14 * w), 1)
    dark = lambda a, b: float((g[:, max(a, 0) : b] < 92).mean())
    return max(0.0, dark(mid - half, mid + half) - 0.55 * (dark(0, side) + dark(w - side, w)) / 2)


def opposing_page(image: np.ndarray) -> float:
    """Edges on both outer thirds without as many in the middle; each third is looked at by itself."""
    w = image.shape[1]
    if w < 60:
        return 0.0
    g = im.gray(image)
    left, centre, right = (float(im.canny(g[:, a:b], 60, 160).mean()) for a, b in ((0, w // 3), (w // 3, 2 * w // 3), (2 * w // 3, w)))
    if centre <= 0:
        return max(left, right)
    return max(0.0, min(left, right) + max(0.0, max(left, right) - 0.75 * centre))


def filled_area(part: np.ndarray) -> int:
    """Pixels of a connected part with its holes."""
    labels, found = im.components(~np.pad(part, 1))
    return labels.size - found[labels[0, 0] - 1][4]


def page_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(top, bottom, left, right) around the part of a mask that is most of a page; None without one."""
    h, w = mask.shape
    labels, found = im.components(mask)
    best, most = None, 0.0
    for k, (x, y, cw, ch, _) in enumerate(found, 1):
        if cw * ch < 0.35 * h * w or not 0.45 <= cw / ch <= 1.9:
            continue
        area = filled_area(labels[y : y + ch, x : x + cw] == k)
        cover, fill = area / (h * w), area / (cw * ch)
        if cover >= 0.35 and fill >= 0.7 and 0.7 * cover + 0.3 * fill > most:
            best, most = (x, y, cw, ch), 0.7 * cover + 0.3 * fill
    if not best:
        return None
    x, y, cw, ch = best
    pad = max(round(0.012 * min(h, w)), 6)
    top, bottom, left, right = max(y - pad, 0), min(y + ch + pad, h), max(x - pad, 0), min(x + cw + pad, w)
    return (top, bottom, left, right) if bottom - top >= 0.45 * h and right - left >= 0.45 * w else None


def crop(image: np.ndarray) -> np.ndarray:
    """The page within a frame, by colour or else by light; the frame itself if none stands out or it is small."""
    if min(image.shape[:2]) < 80:
        return image
    found = page_box(page_mask(image)) or page_box(light_mask(image))
    return image[found[0] : found[1], found[2] : found[3]] if found else image


def detect(frame: np.ndarray) -> dict:
    """Page measures of a camera frame, ``corrected`` (the upright page) and ``contour``."""
    h, w = frame.shape[:2]
    g = im.gray(frame)
    edges = im.dilate(im.canny(im.gaussian(g, 5), 60, 180))
    labels, found = im.components(edges)
    ranked = []
    for k, (x, y, cw, ch, _) in enumerate(found, 1):
        if cw * ch < 0.18 * h * w:
            continue
        yy, xx = np.nonzero(labels[y : y + ch, x : x + cw] == k)
        outline = hull(np.stack([xx + x, yy + y], axis=1))
        area = polygon_area(outline) if len(outline) > 2 else 0.0
        if area < 0.18 * h * w:
            continue
        quad = corners(outline)
        qx, qy = np.floor(quad.min(axis=0)).astype(int)
        qw, qh = (np.ceil(quad.max(axis=0)).astype(int) - (qx, qy) + 1).tolist()
        m = {"page_coverage": area / (h * w), "rectangularity": area / max(qw * qh, 1), "border_touch_ratio": border_touch(qx, qy, qw, qh, w, h)}
        m["single_page_score"] = single_page_shape(qw / max(qh, 1), m["border_touch_ratio"])
        score = 0.45 * m["page_coverage"] + 0.25 * m["rectangularity"] + 0.2 * m["single_page_score"] + 0.1 * (1 - m["border_touch_ratio"])
        ranked.append((score, quad, m))
    if not ranked:
        return {
            "found": False, "contour": None, "corrected": frame, "page_coverage": 0.0, "rectangularity": 0.0, "occlusion_ratio": occlusion(frame), "perspective_score": 0.0, "single_page_score": 0.0,
            "background_intrusion_ratio": 1.0, "border_touch_ratio": 1.0, "text_density": im.text_density(frame), "contour_confidence": 0.0, "gutter_ratio": 1.0, "opposing_page_ratio": 1.0, "normalized": False,
        }
    ranked.sort(key=lambda r: -r[0])  # stable: of equals the first
    score, quad, m = ranked[0]
    rival = ranked[1][0] if len(ranked) > 1 else 0.0
    quad = order_corners(quad)
    page = crop(warp(frame, quad))
    m |= {"perspective_score": perspective_score(quad), "background_intrusion_ratio": background_intrusion(page), "text_density": im.text_density(page), "gutter_ratio": gutter(page), "opposing_page_ratio": opposing_page(page), "occlusion_ratio": occlusion(page)}
    m["contour_confidence"] = max(0.0, min(0.34 * m["page_coverage"] + 0.28 * m["rectangularity"] + 0.24 * m["perspective_score"] + 0.14 * (1 - m["border_touch_ratio"]), 1.0))
    m["single_page_score"] = max(m["single_page_score"] - 0.35 * min(rival / max(score, 0.001), 1.0) - min(1.2 * m["gutter_ratio"], 0.35) - min(0.9 * m["opposing_page_ratio"], 0.35), 0.0)
    least = {"page_coverage": 0.42, "rectangularity": 0.62, "single_page_score": 0.58, "contour_confidence": 0.62}
    most = {"border_touch_ratio": 0.18, "background_intrusion_ratio": 0.2, "gutter_ratio": 0.11, "opposing_page_ratio": 0.2}
    normalized = all(m[k] >= v for k, v in least.items()) and all(m[k] <= v for k, v in most.items())
    return {"found": True, "contour": quad.tolist(), "corrected": page, "normalized": normalized} | {k: float(v) for k, v in m.items()}


def equalize_tiles(g: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited histogram equalisation on tiles, blended between tile centres."""
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    tables = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
            limit = max(clip * th * tw / 256, 1)
            over = np.maximum(n - limit, 0).sum()
            tables[i, j] = (np.minimum(n, limit) + over / 256).cumsum() * 255 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, tiles - 1), np.clip(np.floor(x).astype(int), 0, tiles - 1)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    at = lambda a, b: tables[a[:, None], b[None, :], g]
    return im.to_bytes((at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy)


def median3(g: np.ndarray) -> np.ndarray:
    p = np.pad(g, 1, mode="edge")
    return np.median([p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3)], axis=0).astype(g.dtype)


def denoise(g: np.ndarray, strength: float = 8.0, patch: int = 7, reach: int = 3) -> np.ndarray:
    """Non-local means: neighbours weighted by the likeness of the squares around them."""
    a = g.astype(float)
    p = np.pad(a, reach, mode="reflect" if min(a.shape) > reach else "edge")
    total, weight = np.zeros(a.shape), np.zeros(a.shape)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            other = p[reach + dy : reach + dy + a.shape[0], reach + dx : reach + dx + a.shape[1]]
            k = np.exp(-im.box((other - a) ** 2, patch) / strength**2)
            total, weight = total + k * other, weight + k
    return im.to_bytes(total / weight)


def trim_dark_border(image: np.ndarray, least: int = 16, pad: int = 8, small: int = 40) -> np.ndarray:
    lit = im.gray(image) > least
    rows, cols = np.flatnonzero(lit.any(axis=1)), np.flatnonzero(lit.any(axis=0))
    if not len(rows) or rows[-1] - rows[0] < small or cols[-1] - cols[0] < small:
        return image
    return image[max(rows[0] - pad, 0) : rows[-1] + 1 + pad, max(cols[0] - pad, 0) : cols[-1] + 1 + pad]


def flatten_background(g: np.ndarray) -> np.ndarray:
    ground = im.to_bytes(im.gaussian(g, 127 if min(g.shape) > 64 else 2 * (min(g.shape) // 2) - 1 or 1, 21))
    return im.to_bytes(g / np.maximum(ground, 1) * 255)


def finish(image: np.ndarray) -> np.ndarray:
    """Scan-like page: cropped, flattened, black on white with a white border, BGR.

    Ink that touches the border is no text. Where too much stays black for a page, the flattened greys
    are given instead, lightened to 135 and above.
    """
    page = trim_dark_border(im.gray(crop(image)))
    g = equalize_tiles(flatten_background(denoise(page)))
    ink = im.adaptive_dark(g, 35, 11)
    labels, found = im.components(ink)
    h, w = ink.shape
    outer = [k for k, (x, y, cw, ch, _) in enumerate(found, 1) if x == 0 or y == 0 or x + cw == w or y + ch == h]
    ink &= ~np.isin(labels, outer)
    white = im.opened(median3(np.where(ink, 0, 255).astype(np.uint8)) > 0, 2)
    if white.mean() < 0.5:
        white = ~white
    out = np.where(white, 255, 0).astype(np.uint8) if white.mean() >= 0.7 else im.to_bytes(135 + im.minmax(g, 120.0))
    framed = np.full((h + 40, w + 40), 255, np.uint8)
    framed[20:-20, 20:-20] = out
    return np.repeat(framed[..., None], 3, axis=2)
