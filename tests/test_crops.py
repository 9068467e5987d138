"""Crop grids, assembly of proposals over crops, greedy suppression in rounds, thinning: against plain loops."""

import math

import numpy as np

from gridloom.operators import crops, mask


def brute_crops(w, h, layers, overlap=512 / 1500):
    out, n = [(0, 0, 0, 0, w, h)], 1
    for layer in range(1, layers + 1):
        side = 2**layer
        shared = int(overlap * min(w, h) * (2 / side))
        cw, ch = (math.ceil((shared * (side - 1) + s) / side) for s in (w, h))
        for x in range(side):
            for y in range(side):
                x0, y0 = int((cw - shared) * x), int((ch - shared) * y)
                out.append((n, layer, x0, y0, min(x0 + cw, w), min(y0 + ch, h)))
                n += 1
    return out


def test_crop_grid(spark):
    sizes = [(1, 640, 480), (2, 31, 100), (3, 1, 1)]
    got = crops.crop_boxes(spark.createDataFrame(sizes, "image_id long, width int, height int"), 2).collect()
    want = {(i, *c) for i, w, h in sizes for c in brute_crops(w, h, 2)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 3 * 21
    for i, w, h in sizes[:2]:  # each layer covers the image
        for layer in range(3):
            seen = np.zeros((h, w), bool)
            for r in got:
                if r.image_id == i and r.layer == layer:
                    seen[r.y0 : r.y1, r.x0 : r.x1] = True
            assert seen.all()


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0


def greedy(boxes, most):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        if all(iou(b[1:5], k[1:5]) <= most for k in kept):
            kept.append(b)
    return kept


def test_greedy_rounds_equal_the_loop(spark):
    rng = np.random.default_rng(1)
    rows = []
    for image in range(4):
        for n in range(120):
            x, y = rng.uniform(-90, 200, 2)
            w, h = rng.choice([0, 5, 40, 300]), rng.choice([0, 8, 40, 200])
            rows.append((image, n, float(x // 7 * 7), float(y // 7 * 7), float(x // 7 * 7 + w), float(y // 7 * 7 + h), float(rng.integers(0, 6))))
        rows += [(image, 200 + n, 500.0 + 3 * n, 0.0, 520.0 + 3 * n, 20.0, float(-n)) for n in range(12)]  # a chain: every other one goes
    df = spark.createDataFrame(rows, "image_id long, box_id long, x0 double, y0 double, x1 double, y1 double, score double").repartition(5)
    for most, tile in ((0.7, 64), (0.3, 16)):
        got = sorted((r.image_id, r.box_id) for r in mask.greedy_boxes(df, most, tile).collect())
        want = sorted((i, b[0]) for i in range(4) for b in greedy([r[1:] for r in rows if r[0] == i], most))
        assert got == want and 50 < len(want) < len(rows)
    assert not mask.greedy_boxes(df.limit(0)).collect()


def test_assembly_equals_loops(spark):
    rng = np.random.default_rng(2)
    sizes = {1: (60, 40), 2: (33, 70)}
    pixels, scores, masks = [], [], {}
    for image, (w, h) in sizes.items():
        things = [(*rng.integers(0, (w - 6, h - 6)), *rng.integers(3, 14, 2)) for _ in range(14)]
        for n, _, x0, y0, x1, y1 in brute_crops(w, h, 1):
            for m, (tx, ty, tw, th) in enumerate(things):
                own = [(r - y0, c - x0) for r in range(max(ty, y0), min(ty + th, y1, h)) for c in range(max(tx, x0), min(tx + tw, x1, w))]
                if own:
                    score = float(rng.integers(1, 5))
                    pixels += [(image, n, m, int(r), int(c)) for r, c in own]
                    scores.append((image, n, m, score))
                    rows, cols = [r + y0 for r, _ in own], [c + x0 for _, c in own]
                    masks[image, n, m] = (min(cols), min(rows), max(cols), max(rows), len(own), score)
    stay = {}
    for (image, n, m), (x0, y0, x1, y1, area, score) in masks.items():
        w, h = sizes[image]
        _, _, *edges = brute_crops(w, h, 1)[n]
        cut = any(abs(side - edge) <= 2 and not abs(side - border) <= 2 for side, edge, border in zip((x0, y0, x1, y1), edges, (0, 0, w, h), strict=True))
        if not cut:
            stay[image, n, m] = (x0, y0, x1, y1, score, area)
    kept = []
    for image, (w, h) in sizes.items():
        within = []
        for n, _, x0, y0, x1, y1 in brute_crops(w, h, 1):
            own = greedy([((n, m), *v[:5]) for (i, c, m), v in stay.items() if (i, c) == (image, n)], 0.7)
            within += [(*b[:5], 1 / ((x1 - x0) * (y1 - y0))) for b in own]
        kept += [(image, *b[0]) for b in greedy(within, 0.7)]
    got = crops.assemble(
        spark.createDataFrame(pixels, "image_id long, crop int, mask_id long, row int, col int").repartition(4),
        spark.createDataFrame(scores, "image_id long, crop int, mask_id long, score double"),
        spark.createDataFrame([(i, *s) for i, s in sizes.items()], "image_id long, width int, height int"),
        1, near=2.0,
    ).collect()
    assert sorted((r.image_id, r.crop, r.mask_id) for r in got) == sorted(kept) and 10 < len(kept) < len(stay) < len(masks)
    assert all((r.x0, r.y0, r.x1, r.y1, r.area, r.score) == masks[r.image_id, r.crop, r.mask_id] for r in got)


def brute_skeleton(m):
    m, phase, still = np.pad(m, 1).astype(int), 0, 0
    while still < 2:
        gone = []
        for r, c in zip(*np.nonzero(m), strict=True):
            p = [m[r - 1, c], m[r - 1, c + 1], m[r, c + 1], m[r + 1, c + 1], m[r + 1, c], m[r + 1, c - 1], m[r, c - 1], m[r - 1, c - 1]]
            runs = sum(p[n] == 0 and p[(n + 1) % 8] == 1 for n in range(8))
            ends = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if phase == 0 else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
            if 2 <= sum(p) <= 6 and runs == 1 and not any(ends):
                gone.append((r, c))
        for at in gone:
            m[at] = 0
        still, phase = (0 if gone else still + 1), 1 - phase
    return {(int(r) - 1, int(c) - 1) for r, c in zip(*np.nonzero(m), strict=True)}


def test_thinning_equals_loops_on_fifty_masks(spark):
    rng, rows, want = np.random.default_rng(4), [], set()
    for n in range(50):
        m = np.zeros((24, 30), bool)
        for _ in range(int(rng.integers(1, 5))):
            r, c = rng.integers(0, 20), rng.integers(0, 24)
            m[r : r + rng.integers(1, 14), c : c + rng.integers(1, 18)] = True
        m &= rng.random(m.shape) > (0.0 if n % 2 else 0.05)
        rows += [(n % 3, n, int(r), int(c)) for r, c in zip(*np.nonzero(m), strict=True)]
        want |= {(n % 3, n, r, c) for r, c in brute_skeleton(m)}
    df = spark.createDataFrame(rows + rows[:30], "image_id long, mask_id long, row int, col int").repartition(4)
    got = [tuple(r) for r in mask.skeleton(df).collect()]
    assert set(got) == want and len(got) == len(want) < len(rows) / 2
    assert mask.skeleton(df.limit(0)).count() == 0
