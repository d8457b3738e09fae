import numpy as np

from mirrorlake.functions import kernels as k


def scene(h=300, w=400, seed=1):
    rnd = np.random.default_rng(seed)
    cells = rnd.integers(0, 256, (h // 24 + 1, w // 24 + 1, 3))
    big = np.kron(cells, np.ones((24, 24, 1)))[:h, :w]
    y, x = np.mgrid[0:h, 0:w]
    return np.clip(big + 25 * np.sin(x / 7 + y / 11)[..., None], 0, 255).astype(np.uint8)


def detailed(h, w, seed):
    """Overlapping boxes of many sizes and greys, smoothed a little, as photographs are."""
    rnd = np.random.default_rng(seed)
    out = np.full((h, w), 128.0)
    for _ in range(700):
        bh, bw = rnd.integers(8, 90, 2)
        y, x = rnd.integers(-20, h), rnd.integers(-20, w)
        out[max(0, y) : y + bh, max(0, x) : x + bw] = rnd.integers(20, 236)
    return np.repeat(k.box_blur(out.astype(np.uint8))[..., None], 3, 2)


def distance(a, b):
    """Least distance of a's variants to b's first hash."""
    bits = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in (a, b)]
    return min(int((bits[0][v * 256 : v * 256 + 256] != bits[1][:256]).sum()) for v in range(8))


def test_turns_mirrors_and_sizes_stay_near_and_others_do_not():
    base = scene()
    one = k.fingerprint(base)
    for moved in (np.rot90(base), np.rot90(base, 2), base[:, ::-1], base[::-1], base.transpose(1, 0, 2), k.shrink(base, 200, 150), (base // 16 * 16 + 8)):
        assert distance(one["hashes"], k.fingerprint(np.ascontiguousarray(moved))["hashes"]) <= 0.12 * 255
    assert distance(one["hashes"], k.fingerprint(scene(seed=9))["hashes"]) > 0.25 * 255
    turned = k.fingerprint(np.ascontiguousarray(np.rot90(base)))["rings"]
    assert np.sqrt(np.mean((one["rings"] - turned) ** 2)) < 0.01


def arrays(points):
    return np.array([p[:2] for p in points], np.float32), np.array([np.frombuffer(p[2], "<u8") for p in points])


def test_corners_find_a_crop_and_not_another_picture():
    base = detailed(700, 900, 1)
    small = k.shrink(base, *k.fit_within(900, 700, 512))
    crop = k.shrink(base[140:560, 180:720], *k.fit_within(540, 420, 512))
    one, two, other = (arrays(k.features(k.luma(x))) for x in (small, crop, detailed(400, 512, 5)))
    assert len(one[0]) <= k.KEYPOINTS
    assert k.agreement(one, two) >= k.AGREEING
    assert k.agreement(one, other) < k.AGREEING
    assert k.agreement(one, one) >= 0.9 * len(k.paired(one, one)[0])


def test_variant_hashes_are_those_of_the_moved_block():
    block = np.random.default_rng(3).standard_normal((16, 16)).astype(np.float32)
    v = k.variant_hashes(block)
    assert v[4] == k.hash_bits(np.ascontiguousarray(block.T)) and len(set(v)) == 8
    sign = np.where(np.arange(16) % 2, -1, 1)
    assert v[3] == k.hash_bits(block * sign[None, :] * sign[:, None])
    assert v[7] == k.hash_bits(block.T * sign[None, :] * sign[:, None])


def test_pack_and_unpack_corners():
    points = [(1, 2, bytes(range(32))), (65535, 0, b"\0" * 32)]
    assert k.unpack_corners(k.pack_corners(points) + b"xyz") == points


def plain_corners(gray):
    best = {}
    h, w = gray.shape
    for y in range(k.PATCH, h - k.PATCH):
        for x in range(k.PATCH, w - k.PATCH):
            ring = [int(gray[y + dy, x + dx]) - int(gray[y, x]) for dx, dy in k.CIRCLE]
            for side in ([v > k.CONTRAST for v in ring], [v < -k.CONTRAST for v in ring]):
                if sum(side[::4]) >= 3 and any(all((side * 2)[s : s + k.ARC]) for s in range(16)):
                    score, cell = sum(map(abs, ring)), (y // 4, x // 4)
                    if cell not in best or score > best[cell][2]:
                        best[cell] = (x, y, score)
    return sorted(best.values(), key=lambda p: (p[1], p[0]))


def test_corners_equal_their_definition():
    rnd = np.random.default_rng(2)
    pictures = [k.luma(detailed(90, 110, 3)), rnd.integers(0, 256, (45, 61)).astype(np.uint8), np.kron(rnd.integers(0, 2, (9, 8)) * 255, np.ones((7, 7))).astype(np.uint8)]
    found = [k.fast_corners(x) for x in pictures]
    assert [[tuple(r) for r in x.tolist()] for x in found] == [plain_corners(x) for x in pictures] and all(map(len, found[:2]))
    assert len(k.fast_corners(np.zeros((30, 90), np.uint8))) == 0 and k.features(np.zeros((90, 90), np.uint8)) == []


def test_only_corners_that_can_be_kept_are_described(monkeypatch):
    seen, describe = [], k.describe
    monkeypatch.setattr(k, "describe", lambda gray, smooth, x, y: seen.append(len(x)) or describe(gray, smooth, x, y))
    gray = np.random.default_rng(4).integers(0, 256, (300, 300)).astype(np.uint8)
    assert len(k.features(gray)) == k.KEYPOINTS == sum(seen) < len(k.fast_corners(gray))
