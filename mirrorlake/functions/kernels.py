"""Picture kernels on NumPy arrays: perceptual hash, colour rings, corners, and agreement of corners.

A picture is an array (height, width, 3) of 8-bit RGB. Each kernel is whole-array work; loops run over
pyramid levels and kept corners only."""

from functools import lru_cache

import numpy as np

#: Hash grid and block, rings, corners.
GRID, BLOCK, RINGS = 64, 16, 12
HASH_EDGE, FEATURE_EDGE = 128, 512
LEVELS, LEVEL_SCALE, PATCH, ARC, CONTRAST = 8, 1.2, 15, 9, 18
KEYPOINTS, CELLS = 320, 8
ATTEMPTS, SAME_CORNER, CLEARLY_BETTER, ROOM, AGREEING = 200, 64, 8, 6.0, 16
#: The circle of sixteen pixels around a corner, clockwise from the top.
CIRCLE = ((0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3))
#: Linear sRGB to cone responses, and their cube roots to Oklab.
_CONES = np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]], np.float32)
_OKLAB = np.array([[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]], np.float32)
_CODE = np.arange(256, dtype=np.float32) / np.float32(255)
_LINEAR = np.where(_CODE <= 0.04045, _CODE / 12.92, ((_CODE + 0.055) / 1.055) ** 2.4).astype(np.float32)


def _xorshift(state: int):
    mask = (1 << 64) - 1
    while True:
        state ^= state << 13 & mask
        state ^= state >> 7
        state ^= state << 17 & mask
        yield state


def luma(rgb: np.ndarray) -> np.ndarray:
    weights = np.array([0.2126, 0.7152, 0.0722], np.float32)
    return np.clip(np.floor(rgb[..., :3].astype(np.float32) @ weights + 0.5), 0, 255).astype(np.uint8)


def fit_within(width: int, height: int, edge: int) -> tuple[int, int]:
    long = max(width, height)
    if long <= edge:
        return width, height
    return max(1, width * edge // long), max(1, height * edge // long)


def shrink(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean of the area under each target pixel, from running sums read at fractional edges."""
    out = picture.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
        edge = np.arange(size + 1) * (n / size)
        low = np.minimum(edge.astype(np.int64), n - 1)
        part = (edge - low).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
        out = np.diff(np.take(sums, low, axis) * (1 - part) + np.take(sums, low + 1, axis) * part, axis=axis) * (size / n)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


@lru_cache(maxsize=32)
def _triangle(n: int, size: int) -> np.ndarray:
    """Weights (size, n) of a resampling with a triangle filter, widened when shrinking."""
    ratio = n / size
    reach = max(1.0, ratio)
    centre = (np.arange(size) + 0.5) * ratio - 0.5
    weight = np.maximum(0, 1 - np.abs(np.arange(n)[None, :] - centre[:, None]) / reach)
    return weight / weight.sum(1, keepdims=True)


def resample(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    out = _triangle(gray.shape[0], height) @ gray.astype(np.float64) @ _triangle(gray.shape[1], width).T
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def _cosines() -> np.ndarray:
    k, at = np.arange(BLOCK)[:, None], np.arange(GRID)[None, :]
    return (np.where(k == 0, np.sqrt(1 / GRID), np.sqrt(2 / GRID)) * np.cos(np.pi * (2 * at + 1) * k / (2 * GRID))).astype(np.float32)


_BASIS = _cosines()


def low_block(rgb: np.ndarray) -> np.ndarray:
    """Low frequencies of the picture on a square grid."""
    grid = shrink(luma(rgb), GRID, GRID).astype(np.float32)
    return _BASIS @ grid @ _BASIS.T


def hash_bits(block: np.ndarray) -> bytes:
    rest = block.reshape(-1)[1:]
    return np.packbits(np.r_[rest > np.median(rest), False], bitorder="little").tobytes()


def variant_hashes(block: np.ndarray) -> list[bytes]:
    """Hashes of the eight turns and mirrors, which are sign changes and a transpose of the block."""
    sign = np.where(np.arange(block.shape[0]) % 2 == 1, -1, 1).astype(block.dtype)
    out = []
    for v in range(8):
        moved = block.T if v & 4 else block
        moved = moved * (sign[None, :] if v & 1 else 1) * (sign[:, None] if v & 2 else 1)
        out.append(hash_bits(moved))
    return out


def hash_words(packed: bytes) -> list[int]:
    """Four signed words of a 256-bit hash, low bytes first."""
    return np.frombuffer(packed, "<i8").tolist()


def oklab(rgb: np.ndarray) -> np.ndarray:
    return np.cbrt(_LINEAR[rgb[..., :3]] @ _CONES.T) @ _OKLAB.T


def ring_stats(rgb: np.ndarray) -> np.ndarray:
    """Mean lightness and colour and deviation of lightness in twelve rings of the inscribed circle: 48 floats."""
    h, w = rgb.shape[:2]
    y, x = np.mgrid[0:h, 0:w].astype(np.float32)
    away = np.sqrt((x - np.float32((w - 1) / 2)) ** 2 + (y - np.float32((h - 1) / 2)) ** 2)
    radius = np.float32(max(1.0, min(w, h) / 2))
    inside = away <= radius
    ring = np.minimum(RINGS - 1, (away[inside] / radius * RINGS).astype(np.int64))
    lab = oklab(rgb)[inside]
    n = np.bincount(ring, minlength=RINGS)
    mean = lambda v: np.bincount(ring, v, RINGS) / np.maximum(n, 1)
    light = mean(lab[:, 0])
    spread = np.sqrt(np.maximum(0, mean(lab[:, 0] * lab[:, 0]) - light**2))
    return np.stack([light, mean(lab[:, 1]), mean(lab[:, 2]), spread], 1).astype(np.float32).reshape(-1)


def ring_weights() -> np.ndarray:
    return np.tile(np.array([1, 4, 4, 1], np.float32), RINGS)


def _arcs() -> np.ndarray:
    """For each set of the circle's pixels, a bit a pixel: whether ARC of them follow each other and three of the
    four compass pixels are there."""
    sets = np.arange(1 << 16)
    twice, arc = sets | sets << 16, (1 << ARC) - 1
    return np.any([twice >> k & arc == arc for k in range(16)], axis=0) & (np.bitwise_count(sets & 0x1111) >= 3)


_ARCS = _arcs()


def fast_corners(gray: np.ndarray) -> np.ndarray:
    """(x, y, score) of the corners, the best of each 4x4 cell, in row order."""
    h, w = gray.shape
    if h <= 2 * PATCH or w <= 2 * PATCH:
        return np.zeros((0, 3), np.int64)
    # whole rows as one line; three of the four compass pixels are brighter, or darker, where their second least, or
    # second largest, is
    flat, circle = np.ascontiguousarray(gray).reshape(-1), np.array([dy * w + dx for dx, dy in CIRCLE])
    north, east, south, west = (flat[PATCH * w + step : (h - PATCH) * w + step] for step in circle[::4])
    inner = np.maximum(np.minimum(north, south), np.minimum(east, west))
    outer = np.minimum(np.maximum(north, south), np.maximum(east, west))
    middle = flat[PATCH * w : (h - PATCH) * w].astype(np.int16)
    at = np.flatnonzero((np.minimum(inner, outer) > middle + CONTRAST) | (np.maximum(inner, outer) < middle - CONTRAST)) + PATCH * w
    at = at[(at % w >= PATCH) & (at % w < w - PATCH)]
    ring = flat[at[:, None] + circle].astype(np.int16) - flat[at, None].astype(np.int16)
    bright, dark = (np.packbits(side, axis=1, bitorder="little").view("<u2")[:, 0] for side in (ring > CONTRAST, ring < -CONTRAST))
    found = _ARCS[bright] | _ARCS[dark]
    (y, x), score = np.divmod(at[found], w), np.abs(ring[found]).sum(1)
    cell = y // 4 * (w // 4 + 1) + x // 4
    order = np.argsort(cell * 4096 - score, kind="stable")  # a score is at most 16 x 255
    first = np.sort(order[np.r_[True, cell[order][1:] != cell[order][:-1]]]) if len(x) else order
    return np.stack([x[first], y[first], score[first]], 1)


_DISC_Y, _DISC_X = (a.ravel() for a in np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1])
_IN = _DISC_X**2 + _DISC_Y**2 <= PATCH**2
_DISC_X, _DISC_Y = _DISC_X[_IN], _DISC_Y[_IN]


def _pattern() -> np.ndarray:
    draw = _xorshift(0x2545F4914F6CDD1D)
    return np.array([next(draw) % (2 * PATCH - 5) - PATCH + 2 for _ in range(1024)], np.float32).reshape(256, 2, 2)


_PATTERN = _pattern()


#: The points of the pattern, first those of the left sides; how far they reach beyond PATCH when turned.
_POINTS = _PATTERN.transpose(2, 1, 0).reshape(2, 512)
_MARGIN = int(np.ceil(np.hypot(*_POINTS).max() + 0.5)) - PATCH
#: By the cosine and by minus the sine: x, then y, of all points.
_BY_COS, _BY_SIN = _POINTS.reshape(-1), np.concatenate([_POINTS[1], -_POINTS[0]])


def box_blur(gray: np.ndarray) -> np.ndarray:
    """Mean of three neighbours along rows, then along columns, cut to whole numbers."""
    g = gray.astype(np.uint16)
    for last, first, before, after in (np.s_[:, -1:], np.s_[:, :1], np.s_[:, :-1], np.s_[:, 1:]), (np.s_[-1:], np.s_[:1], np.s_[:-1], np.s_[1:]):
        sums = g.copy()
        sums[after] += g[before]
        sums[first] += g[first]
        sums[before] += g[after]
        sums[last] += g[last]
        g = sums // np.uint16(3)
    return g.astype(np.uint8)


def _away(x: np.ndarray) -> np.ndarray:
    """Rounded, halves away from zero."""
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)


def describe(gray: np.ndarray, smooth: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """256 bits for each corner, which is PATCH or more from every edge: comparisons of the smoothed picture at pairs
    turned by the corner's angle, at the edge where they fall beyond it."""
    w = gray.shape[1]
    patch = np.ascontiguousarray(gray).reshape(-1)[(y * w + x)[:, None] + (_DISC_Y * w + _DISC_X)].astype(np.float32)
    # whole numbers under 2**24: exact
    angle = np.arctan2(patch @ _DISC_Y.astype(np.float32), patch @ _DISC_X.astype(np.float32))
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    turned = _BY_COS * cos
    turned -= _BY_SIN * sin
    # rounded, halves away from zero: a half with the sign bit of each is added
    turned += (turned.view(np.uint32) & np.uint32(1 << 31) | np.float32(0.5).view(np.uint32)).view(np.float32)
    np.trunc(turned, turned)
    for axis in (0, 1):
        smooth = smooth.take(np.arange(-_MARGIN, smooth.shape[axis] + _MARGIN), axis, mode="clip")
    wide, stride = smooth, smooth.shape[1]
    off = (turned[:, 512:] * np.float32(stride) + turned[:, :512]).astype(np.int64)
    seen = wide.reshape(-1)[off + ((y + _MARGIN) * stride + x + _MARGIN)[:, None]]
    return np.packbits(seen[:, :256] > seen[:, 256:], axis=1, bitorder="little")


def feature_arrays(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (n, 2) and descriptors (n, 32) of at most KEYPOINTS corners of all pyramid levels, strongest first,
    spread over cells."""
    height, width = gray.shape
    level, scale, levels, scales, found = gray, np.float32(1), [], [], []
    for _ in range(LEVELS):
        if min(level.shape) < 2 * PATCH:
            break
        here = fast_corners(level)
        found.append(here[(here[:, 0] + PATCH < level.shape[1]) & (here[:, 1] + PATCH < level.shape[0])])
        levels.append(level)
        scales.append(scale)
        h, w = int(np.float32(level.shape[0]) / np.float32(LEVEL_SCALE)), int(np.float32(level.shape[1]) / np.float32(LEVEL_SCALE))
        if min(h, w) < 2 * PATCH:
            break
        level, scale = resample(level, w, h), np.float32(scale * np.float32(LEVEL_SCALE))
    if not sum(map(len, found)):
        return np.zeros((0, 2), np.int64), np.zeros((0, 32), np.uint8)
    of = np.repeat(np.arange(len(found)), [len(x) for x in found])
    places = np.concatenate([_away(x[:, :2].astype(np.float32) * s) for x, s in zip(found, scales, strict=True)])
    found = np.concatenate(found)
    order = np.argsort(-found[:, 2], kind="stable")
    cell_w, cell_h, quota = max(1, width // CELLS), max(1, height // CELLS), KEYPOINTS // CELLS**2 + 1
    cell = places[order, 0] // cell_w * (height + 1) + places[order, 1] // cell_h
    by_cell = np.argsort(cell, kind="stable")
    rank = np.empty(len(cell), np.int64)
    rank[by_cell] = np.arange(len(cell)) - np.searchsorted(cell[by_cell], cell[by_cell])
    kept = order[rank < quota][:KEYPOINTS]
    later = order[rank >= quota] if len(kept) < KEYPOINTS else order[:0]
    # only what can be kept is described
    bits = np.zeros((len(found), 32), np.uint8)
    wanted = np.zeros(len(found), bool)
    wanted[kept] = wanted[later] = True
    for k, level in enumerate(levels):
        at = np.flatnonzero(wanted & (of == k))
        if len(at):
            bits[at] = describe(level, box_blur(box_blur(level)), found[at, 0], found[at, 1])
    if len(later):
        every = np.r_[kept, later]
        points = np.concatenate([places[every].view(np.uint8), bits[every]], 1)
        new = np.zeros(len(every), bool)
        new[np.unique(points.view(f"V{points.shape[1]}").reshape(-1), return_index=True)[1]] = True
        new[: len(kept)] = True
        kept = every[new][:KEYPOINTS]
    return places[kept], bits[kept]


def features(gray: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(x, y, descriptor) of the corners of feature_arrays."""
    places, bits = feature_arrays(gray)
    return [(x, y, b.tobytes()) for (x, y), b in zip(places.tolist(), bits, strict=True)]


def pack_corners(points) -> bytes:
    return b"".join(np.array([x, y], "<u2").tobytes() + d for x, y, d in points)


def unpack_corners(raw: bytes) -> list[tuple[int, int, bytes]]:
    whole = np.frombuffer(raw[: len(raw) // 36 * 36], np.dtype([("x", "<u2"), ("y", "<u2"), ("d", "S32")]))
    return [(int(r["x"]), int(r["y"]), raw[k * 36 + 4 : k * 36 + 36]) for k, r in enumerate(whole)]


def corners_array(corners) -> tuple[np.ndarray, np.ndarray]:
    """Places (n, 2) and descriptor words (n, 4) of corners given as structs x, y, words."""
    got = [(c["x"], c["y"], *c["words"]) for c in (corners if corners is not None else [])]
    a = np.array(got, np.int64).reshape(-1, 6)
    return a[:, :2].astype(np.float32), a[:, 2:].astype(np.uint64)


def paired(one, other) -> tuple[np.ndarray, np.ndarray]:
    """Places of the corners that are each other's best match, near and clearly better than the next best."""
    (p, a), (q, b) = one, other
    if not len(a) or not len(b):
        return np.zeros((0, 2), np.float32), np.zeros((0, 2), np.float32)
    bits = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        bits += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    at = bits.argmin(1)
    best = bits[np.arange(len(a)), at].astype(np.int64)
    rest = bits.copy()
    rest[np.arange(len(a)), at] = np.iinfo(rest.dtype).max  # beyond every distance, and clearly
    good = np.flatnonzero((best <= SAME_CORNER) & (best * 10 <= rest.min(1).astype(np.int64) * CLEARLY_BETTER))
    good = good[np.ascontiguousarray(bits[:, at[good]].T).argmin(1) == good]
    return p[good], q[at[good]]


_DRAWS = np.array([x for _, x in zip(range(2 * ATTEMPTS), _xorshift(0x9E3779B97F4A7C15))], np.uint64).reshape(-1, 2)


def agreement(one, other) -> int:
    """Most pairs of matched corners that one turn, scale and shift carries onto each other within ROOM pixels,
    over a fixed sequence of draws; 0 for fewer matches than AGREEING."""
    p, q = paired(one, other)
    n = len(p)
    if n < AGREEING:
        return 0
    pick = (_DRAWS % np.uint64(n)).astype(np.int64)
    pick = pick[pick[:, 0] != pick[:, 1]]
    z, w = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    z, w = z.astype(np.complex64), w.astype(np.complex64)
    base, onto = z[pick[:, 1]] - z[pick[:, 0]], w[pick[:, 1]] - w[pick[:, 0]]
    length = base.real**2 + base.imag**2
    good = length >= 16
    pick, base, onto = pick[good], base[good], onto[good]
    turn = onto * base.conj() / length[good]
    scale = np.abs(turn)
    good = (scale >= 0.2) & (scale <= 5)
    turn, pick = turn[good], pick[good]
    shift = w[pick[:, 0]] - turn * z[pick[:, 0]]
    off = turn[:, None] * z[None, :] + shift[:, None] - w[None, :]
    votes = (off.real**2 + off.imag**2 <= ROOM * ROOM).sum(1)
    return int(votes.max(initial=0))


def fingerprint(rgb: np.ndarray) -> dict:
    """hashes (8 x 32 bytes), rings (48 floats) and corners of a decoded picture."""
    h, w = rgb.shape[:2]
    large = shrink(rgb, *fit_within(w, h, FEATURE_EDGE)) if max(h, w) > FEATURE_EDGE else rgb
    small = shrink(large, *fit_within(large.shape[1], large.shape[0], HASH_EDGE))
    return {"hashes": b"".join(variant_hashes(low_block(small))), "rings": ring_stats(small), "corners": features(luma(large))}
