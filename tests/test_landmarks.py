"""Measures of a face against plain vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenread.functions import landmarks


def plain(points, face, width, height):
    p = [np.array(q, float) for q in points]
    px = [q * [width, height] for q in p]
    out = {}
    for n, (iris, (a, b, top, low)) in enumerate(zip(face.irises, face.eyes, strict=True), 1):
        centre, centre_px = np.mean([p[i] for i in iris], axis=0), np.mean([px[i] for i in iris], axis=0)
        wide, high, axis = abs(p[b][0] - p[a][0]), abs(p[low][1] - p[top][1]), px[b] - px[a]
        length = np.linalg.norm(axis)
        if wide < 1e-5 or high < 1e-5 or length < 1:
            return None
        along = axis / length
        offset = centre_px - (px[a] + px[b]) / 2
        out |= {f"eye{n}_x_ratio": (centre[0] - min(p[a][0], p[b][0])) / wide, f"eye{n}_y_ratio": (centre[1] - min(p[top][1], p[low][1])) / high}
        out |= {f"eye{n}_h_corner": offset @ along / length, f"eye{n}_v_corner": offset @ [-along[1], along[0]] / length, f"eye{n}_openness": np.linalg.norm(px[low] - px[top]) / length}
    cheek, other = (px[i] for i in face.cheeks)
    down, across = px[face.chin] - px[face.forehead], other - cheek
    left, right = px[face.eyes[0][0]], px[face.eyes[1][1]]
    if np.linalg.norm(down) < 1 or np.linalg.norm(across) < 1:
        return None
    unit = lambda v: v / np.linalg.norm(v)
    return out | {
        "head_yaw": (px[face.nose] - (cheek + other) / 2) @ unit(across) / np.linalg.norm(across), "head_pitch": (px[face.nose] - (left + right) / 2) @ unit(down) / np.linalg.norm(down),
        "head_roll_deg": math.degrees(math.atan2(*(right - left)[::-1])), "head_scale": np.linalg.norm(right - left) / width, "nose_x": p[face.nose][0], "nose_y": p[face.nose][1], "inter_ocular_px": np.linalg.norm(right - left)}


@pytest.mark.parametrize("face,n", [(landmarks.MESH, 478), (landmarks.FACE, 23)], ids=["mesh", "small"])
def test_measures(spark, face, n):
    rng = random.Random(n)
    faces = [[(rng.random(), rng.random()) for _ in range(n)] for _ in range(12)]
    narrow, flat = list(faces[0]), list(faces[1])
    narrow[face.eyes[0][1]] = narrow[face.eyes[0][0]]
    flat[face.chin] = flat[face.forehead]
    faces += [narrow, flat]
    rows = [(k, [x for x, _ in f], [y for _, y in f]) for k, f in enumerate(faces)] + [(90, [0.1], [0.2]), (91, None, None), (92, [None] * n, [0.5] * n)]
    found = {r["id"]: r["m"] for r in spark.createDataFrame(rows, "id int, x array<double>, y array<double>").select("id", landmarks.measures(F.col("x"), F.col("y"), face, 800.0, 600.0).alias("m")).collect()}
    for k, f in enumerate(faces):
        want = plain(f, face, 800, 600)
        assert (found[k] is None) == (want is None) and (want is None or found[k].asDict() == pytest.approx(want))
    assert found[12] is None and found[13] is None and found[90] is None and found[91] is None and found[92] is None
