"""From a photo to an upright page: paper, perspective, skew and ruled lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import kernels as K

#: Longest side of the copy that paper is looked for on, its blur and closing, share of
#: the frame that paper may cover, least share of a piece, least side, corner tolerance, ink to keep.
COPY, BLUR, CLOSING = 900, 3.0, 25
COVER, PIECE, SIDE, CORNER, KEEPS = (0.25, 0.995), 0.05, 0.20, 0.02, 0.85
#: Contrast of pen strokes, short side of a prepared page, least skew that is turned back.
CONTRAST, SHORT_SIDE, LEAST_SKEW = 40, 1600, 0.05


def shrunk(gray: np.ndarray, longest: int) -> np.ndarray:
    """A copy whose longest side is at most about ``longest``, by means of whole blocks."""
    k = max(1, int(np.ceil(max(gray.shape) / longest)))
    if k == 1:
        return gray.astype(float)
    h, w = (n // k * k for n in gray.shape)
    return gray[:h, :w].reshape(h // k, k, w // k, k).mean(axis=(1, 3))


def strokes(gray: np.ndarray) -> np.ndarray:
    """Thin dark marks: what a closing of about a fiftieth of the short side fills by over CONTRAST."""
    size = max(9, int(min(gray.shape) * 0.02)) | 1
    return K.close(gray, size // 2).astype(int) - gray > CONTRAST


def hull(points: np.ndarray) -> np.ndarray:
    """Corners (x, y) of the convex hull, in turn."""
    order = points[np.lexsort((points[:, 1], points[:, 0]))]

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(chain(order)[:-1] + chain(order[::-1])[:-1], float)


def simplified(polygon: np.ndarray, tolerance: float) -> np.ndarray:
    """The polygon without corners that stand less than ``tolerance`` off the line of the others."""
    if len(polygon) < 4:
        return polygon
    a = int(((polygon - polygon.mean(axis=0)) ** 2).sum(axis=1).argmax())
    b = int(((polygon - polygon[a]) ** 2).sum(axis=1).argmax())
    ring, keep = np.roll(polygon, -a, axis=0), {0, (b - a) % len(polygon)}
    todo = [(0, max(keep)), (max(keep), len(ring))]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        p, q = ring[i], ring[j % len(ring)]
        way, rest = q - p, ring[i + 1 : j] - p
        off = np.abs(way[0] * rest[:, 1] - way[1] * rest[:, 0]) / max(np.hypot(*way), 1e-9)
        if off.max() > tolerance:
            k = i + 1 + int(off.argmax())
            keep.add(k)
            todo += [(i, k), (k, j)]
    return ring[sorted(keep)]


def inside(polygon: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mask of a convex polygon."""
    y, x = np.mgrid[:h, :w]
    a, b = polygon, np.roll(polygon, -1, axis=0)
    sides = [(q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) for p, q in zip(a, b, strict=True)]
    return np.all([s >= 0 for s in sides], axis=0) | np.all([s <= 0 for s in sides], axis=0)


def ordered(corners: np.ndarray) -> np.ndarray:
    """Four corners as top left, top right, bottom right, bottom left."""
    total, off = corners.sum(axis=1), corners[:, 1] - corners[:, 0]
    return corners[[total.argmin(), off.argmin(), total.argmax(), off.argmax()]]


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The projective map that takes points to points, by least squares."""
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    return np.linalg.svd(np.array(rows, float))[2][-1].reshape(3, 3)


def robust_homography(source: np.ndarray, target: np.ndarray, within: float = 3.0, tries: int = 200, seed: int = 0) -> np.ndarray | None:
    """As :func:`homography`, from the largest set of points that agree to ``within`` pixels; None under four points."""
    if len(source) < 4:
        return None
    rng, best = np.random.default_rng(seed), np.zeros(len(source), bool)
    for _ in range(tries):
        pick = rng.choice(len(source), 4, replace=False)
        off = np.hypot(*(projected(homography(source[pick], target[pick]), source) - target).T)
        if (off < within).sum() > best.sum():
            best = off < within
    return homography(source[best], target[best]) if best.sum() >= 4 else None


def projected(matrix: np.ndarray, points: np.ndarray) -> np.ndarray:
    moved = np.column_stack([points, np.ones(len(points))]) @ matrix.T
    return moved[:, :2] / moved[:, 2:]


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray, border: float = 255.0) -> np.ndarray:
    """Bilinear values of an image at places; ``border`` outside."""
    h, w = image.shape
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    out = np.zeros(x.shape)
    for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1)):
        yy, xx = y0 + dy, x0 + dx
        ok = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        value = np.where(ok, image[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)], border)
        out += value * (fy if dy else 1 - fy) * (fx if dx else 1 - fx)
    return out


def warped(gray: np.ndarray, matrix: np.ndarray, h: int, w: int) -> np.ndarray:
    """The image after a projective map, on a page of h x w, white where nothing lands."""
    y, x = np.mgrid[:h, :w]
    at = projected(np.linalg.inv(matrix), np.column_stack([x.ravel(), y.ravel()]).astype(float))
    return np.clip(np.rint(sampled(gray.astype(float), at[:, 0], at[:, 1])), 0, 255).astype(np.uint8).reshape(h, w)


def flattened(gray: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The quadrilateral as a rectangle of its own side lengths; unchanged if a side is under 100 pixels."""
    c = ordered(corners)
    side = lambda i, j: float(np.hypot(*(c[i] - c[j])))
    w, h = round(max(side(0, 1), side(3, 2))), round(max(side(0, 3), side(1, 2)))
    if min(w, h) < 100:
        return gray
    return warped(gray, homography(c, np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)), h, w)


def registered(gray: np.ndarray, found: dict[int, np.ndarray], expected: dict[int, np.ndarray], h: int, w: int, least: int = 3) -> np.ndarray:
    """A photographed worksheet on its own page, from markers' corners by id; ValueError under ``least`` shared markers."""
    shared = sorted(set(found) & set(expected))
    if len(shared) < least:
        raise ValueError(f"{len(shared)} of {least} markers found")
    matrix = robust_homography(np.concatenate([found[k] for k in shared]), np.concatenate([expected[k] for k in shared]))
    if matrix is None:
        raise ValueError("markers don't agree")
    return warped(gray, matrix, h, w)


def regions(gray: np.ndarray) -> Iterator[np.ndarray]:
    """Corners of where paper may be, best guess first: the largest bright piece, then the hull of all large ones."""
    small = K.gaussian(shrunk(gray, COPY), BLUR)
    factor = gray.shape[0] / small.shape[0]
    bright = K.close((small > K.otsu(np.clip(small, 0, 255).astype(np.uint8))), CLOSING // 2)
    labels, n = K.components(bright)
    if not n:
        return
    sizes = K.areas(labels, n)
    for wanted in (labels == 1 + int(sizes.argmax()), np.concatenate([[False], sizes >= PIECE * bright.size])[labels]):
        if not COVER[0] <= wanted.mean() <= COVER[1]:
            continue
        rows = np.flatnonzero(wanted.any(axis=1))
        edge = np.concatenate([np.column_stack([pick(wanted[rows]), rows]) for pick in (lambda m: m.argmax(axis=1), lambda m: m.shape[1] - 1 - m[:, ::-1].argmax(axis=1))])
        border = hull(edge)
        if (np.ptp(border, axis=0) < SIDE * np.array(small.shape[::-1])).any():
            continue
        around = np.hypot(*(border - np.roll(border, -1, axis=0)).T).sum()
        corners = simplified(border, CORNER * around / 2)
        yield (corners if len(corners) == 4 else border) * factor


def keeps(mask: np.ndarray, region: np.ndarray, least: float = KEEPS) -> bool:
    """Whether the region holds enough of the ink; no ink is enough."""
    n = int(mask.sum())
    return not n or float((mask & region).sum()) >= least * n


def find_paper(gray: np.ndarray) -> np.ndarray | None:
    """The page without what it lies on: flattened if four corners show, else cropped; None if no region keeps the ink."""
    mask = strokes(gray)
    for corners in regions(gray):
        region = inside(corners, *gray.shape)
        if not keeps(mask, region):
            continue
        white = np.where(region, gray, 255).astype(np.uint8)
        if len(corners) == 4:
            return flattened(white, corners)
        (x0, y0), (x1, y1) = np.maximum(np.floor(corners.min(axis=0)).astype(int), 0), np.ceil(corners.max(axis=0)).astype(int)
        return white[y0 : y1 + 1, x0 : x1 + 1]
    return None


def skew(ink: np.ndarray, most: float = 8.0, step: float = 0.2) -> float:
    """The angle, in degrees, by which rows must be turned to stand out most; the first on a tie."""
    y, x = np.nonzero(ink[:: max(1, ink.shape[0] // 600 or 1), :: max(1, ink.shape[1] // 600 or 1)])
    if not len(y):
        return 0.0
    angles = np.arange(-round(most / step), round(most / step) + 1) * step
    shear = np.rint(y[None] + np.tan(np.radians(angles))[:, None] * x[None]).astype(int)
    rows = [np.bincount(s - s.min()) for s in shear]
    size = max(map(len, rows))
    return float(angles[int(np.argmax([np.var(np.pad(r, (0, size - len(r)))) for r in rows]))])


def turned(image: np.ndarray, degrees: float, border: float = 255.0) -> np.ndarray:
    """The image turned about its centre, bilinear; the angle is that of :func:`skew`."""
    h, w = image.shape
    y, x = np.mgrid[:h, :w]
    t = np.radians(degrees)
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    out = sampled(image.astype(float), np.cos(t) * dx + np.sin(t) * dy + (w - 1) / 2, np.cos(t) * dy - np.sin(t) * dx + (h - 1) / 2, border)
    return out > 0.5 if image.dtype == bool else np.clip(np.rint(out), 0, 255).astype(np.uint8)


def without_rules(ink: np.ndarray, dense: float = 0.30, gap: int = 3, thick: int = 5) -> np.ndarray:
    """Ink without ruled lines: rows, then columns, that are thin and long, kept where ink crosses them."""
    out = ink.copy()
    for axis in (0, 1):
        page = out if axis == 0 else out.T
        full = page.mean(axis=1) > dense
        edges = np.flatnonzero(np.diff(np.pad(full.astype(int), 1)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a <= thick:
                above, below = page[max(0, a - gap) : a].any(axis=0), page[b : b + gap].any(axis=0)
                page[a:b] &= above & below
    return out


def resized(gray: np.ndarray, short: int = SHORT_SIDE) -> np.ndarray:
    """The page with a short side of ``short`` pixels at most."""
    share = short / min(gray.shape)
    if share >= 1:
        return gray
    h, w = (round(n * share) for n in gray.shape)
    y, x = np.meshgrid((np.arange(h) + 0.5) / share - 0.5, (np.arange(w) + 0.5) / share - 0.5, indexing="ij")
    soft = K.gaussian(gray, 0.5 / share) if share < 0.75 else gray.astype(float)
    return np.clip(np.rint(sampled(soft, np.clip(x, 0, gray.shape[1] - 1), np.clip(y, 0, gray.shape[0] - 1))), 0, 255).astype(np.uint8)


def prepared(gray: np.ndarray, paper: bool = True, rules: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Gray page and ink of a photo without a template: paper found, resized, lit evenly, turned upright."""
    page = find_paper(gray) if paper else None
    page = resized(gray if page is None else page)
    ink = K.ink(K.even_light(page))
    if rules:
        ink = without_rules(ink)
    angle = skew(ink)
    if abs(angle) > LEAST_SKEW:
        page, ink = turned(page, angle), turned(ink, angle, 0.0)
    return page, ink
