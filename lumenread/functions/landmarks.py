"""Measures of the eyes and the head from the landmarks of a face, as expressions over an array of points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Face:
    """Places of landmarks in the array: for each eye its iris, two corners, upper and lower lid; the others one each."""

    irises: tuple[tuple[int, ...], tuple[int, ...]]
    eyes: tuple[tuple[int, int, int, int], tuple[int, int, int, int]]
    nose: int
    forehead: int
    chin: int
    cheeks: tuple[int, int]


#: The public face mesh of 478 points: fixed values.
MESH = Face(((468, 469, 470, 471, 472), (473, 474, 475, 476, 477)), ((33, 133, 159, 145), (362, 263, 386, 374)), nose=1, forehead=10, chin=152, cheeks=(234, 454))
#: Eyes that are narrower (share of the image) or faces and eyes that are narrower (pixels) aren't measured: fixed values.
LEAST_SHARE, LEAST_PIXELS = 1e-5, 1.0
NAMES = (
    *(f"eye{n}_{k}" for n in (1, 2) for k in ("x_ratio", "y_ratio")), *(f"eye{n}_{k}" for n in (1, 2) for k in ("h_corner", "v_corner")),
    "head_yaw", "head_pitch", "head_roll_deg", "head_scale", "nose_x", "nose_y", "eye1_openness", "eye2_openness", "inter_ocular_px")


class _Point:
    """A point of expressions."""

    def __init__(self, x: Column, y: Column):
        self.x, self.y = x, y

    def __sub__(self, other: _Point) -> _Point:
        return _Point(self.x - other.x, self.y - other.y)

    def __add__(self, other: _Point) -> _Point:
        return _Point(self.x + other.x, self.y + other.y)

    def by(self, x: float | Column, y: float | Column | None = None) -> _Point:
        return _Point(self.x * x, self.y * (x if y is None else y))

    def dot(self, other: _Point) -> Column:
        return self.x * other.x + self.y * other.y

    def length(self) -> Column:
        return F.sqrt(self.dot(self))


def measures(x: Column, y: Column, face: Face = MESH, width: float = 640.0, height: float = 480.0) -> Column:
    """A struct of the 17 measures from arrays of x and y, shares of an image of width x height; null where an eye or the face is too narrow or a point isn't there."""
    at = lambda i: _Point(F.get(x, F.lit(i)), F.get(y, F.lit(i)))
    pixel = lambda p: p.by(width, height)
    told: dict[str, Column] = {}
    fits = F.lit(True)
    for n, (iris_at, (a_at, b_at, top_at, low_at)) in enumerate(zip(face.irises, face.eyes, strict=True), 1):
        iris = at(iris_at[0])
        for i in iris_at[1:]:
            iris = iris + at(i)
        iris = iris.by(1.0 / len(iris_at))
        a, b, top, low = at(a_at), at(b_at), at(top_at), at(low_at)
        wide, high = F.abs(b.x - a.x), F.abs(low.y - top.y)
        told[f"eye{n}_x_ratio"] = (iris.x - F.least(a.x, b.x)) / wide
        told[f"eye{n}_y_ratio"] = (iris.y - F.least(top.y, low.y)) / high
        axis = pixel(b - a)
        length = axis.length()
        offset = pixel(iris - (a + b).by(0.5))
        # along the corners' line and across it, in eye widths
        told[f"eye{n}_h_corner"] = offset.dot(axis) / (length * length)
        told[f"eye{n}_v_corner"] = (offset.y * axis.x - offset.x * axis.y) / (length * length)
        told[f"eye{n}_openness"] = pixel(low - top).length() / length
        fits = fits & (wide >= LEAST_SHARE) & (high >= LEAST_SHARE) & (length >= LEAST_PIXELS)
    nose, (cheek, other) = pixel(at(face.nose)), (pixel(at(i)) for i in face.cheeks)
    across, down = other - cheek, pixel(at(face.chin) - at(face.forehead))
    left, right = pixel(at(face.eyes[0][0])), pixel(at(face.eyes[1][1]))
    told["head_yaw"] = (nose - (cheek + other).by(0.5)).dot(across) / across.dot(across)
    told["head_pitch"] = (nose - (left + right).by(0.5)).dot(down) / down.dot(down)
    told["head_roll_deg"] = F.degrees(F.atan2(right.y - left.y, right.x - left.x))
    told["head_scale"] = (right - left).length() / width
    told["nose_x"], told["nose_y"] = at(face.nose).x, at(face.nose).y
    told["inter_ocular_px"] = (right - left).length()
    fits = fits & (across.length() >= LEAST_PIXELS) & (down.length() >= LEAST_PIXELS)
    whole = F.struct(*(told[name].alias(name) for name in NAMES))
    for name in NAMES:
        fits = fits & told[name].isNotNull()
    return F.when(fits, whole)


# ---------------------------------------------------------------- query: embeddings as faces of 23 points

FACE = Face(((0, 1, 2, 3, 4), (5, 6, 7, 8, 9)), ((10, 11, 12, 13), (14, 15, 16, 17)), nose=18, forehead=19, chin=20, cheeks=(21, 22))


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of each embedding whose numbers are read as x and y by turns."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    pick = lambda odd: F.filter("e", lambda v, i: i % 2 == odd)
    found = rows.select("vec_id", measures(pick(0), pick(1), FACE).alias("m")).filter("m is not null")
    return found.select("vec_id", *(F.round(F.col("m")[name], 5).alias(name) for name in NAMES))


def _sql() -> str:
    """Written apart: points as pairs of named columns, angles by complex products."""
    parts = {f"i{n}": [5 * (n - 1) + k for k in range(5)] for n in (1, 2)}
    single = {"a1": 10, "b1": 11, "t1": 12, "l1": 13, "a2": 14, "b2": 15, "t2": 16, "l2": 17, "no": 18, "fo": 19, "ch": 20, "ca": 21, "cb": 22}
    columns = [f"e[{2 * i + 1 + d}] as {n}{c}" for n, i in single.items() for d, c in enumerate("xy")] + [f"({' + '.join(f'e[{2 * i + 1 + d}]' for i in own)}) / 5 as {n}{c}" for n, own in parts.items() for d, c in enumerate("xy")]
    out, keep = [], []
    for n in (1, 2):
        w2 = f"(pow(640 * (b{n}x - a{n}x), 2) + pow(480 * (b{n}y - a{n}y), 2))"
        ox, oy = f"640 * (i{n}x - (a{n}x + b{n}x) / 2)", f"480 * (i{n}y - (a{n}y + b{n}y) / 2)"
        out += [(f"eye{n}_x_ratio", f"(i{n}x - least(a{n}x, b{n}x)) / abs(b{n}x - a{n}x)"), (f"eye{n}_y_ratio", f"(i{n}y - least(t{n}y, l{n}y)) / abs(l{n}y - t{n}y)"),
                (f"eye{n}_h_corner", f"({ox} * 640 * (b{n}x - a{n}x) + {oy} * 480 * (b{n}y - a{n}y)) / {w2}"), (f"eye{n}_v_corner", f"({oy} * 640 * (b{n}x - a{n}x) - {ox} * 480 * (b{n}y - a{n}y)) / {w2}"),
                (f"eye{n}_openness", f"sqrt((pow(640 * (l{n}x - t{n}x), 2) + pow(480 * (l{n}y - t{n}y), 2)) / {w2})")]
        keep += [f"abs(b{n}x - a{n}x) >= 1e-5", f"abs(l{n}y - t{n}y) >= 1e-5", f"{w2} >= 1"]
    f2, v2 = "(pow(640 * (cbx - cax), 2) + pow(480 * (cby - cay), 2))", "(pow(640 * (chx - fox), 2) + pow(480 * (chy - foy), 2))"
    eye = "sqrt(pow(640 * (b2x - a1x), 2) + pow(480 * (b2y - a1y), 2))"
    out += [("head_yaw", f"(409600 * (nox - (cax + cbx) / 2) * (cbx - cax) + 230400 * (noy - (cay + cby) / 2) * (cby - cay)) / {f2}"), ("head_pitch", f"(409600 * (nox - (a1x + b2x) / 2) * (chx - fox) + 230400 * (noy - (a1y + b2y) / 2) * (chy - foy)) / {v2}"),
            ("head_roll_deg", "degrees(atan2(480 * (b2y - a1y), 640 * (b2x - a1x)))"), ("head_scale", f"{eye} / 640"), ("nose_x", "nox"), ("nose_y", "noy"), ("inter_ocular_px", eye)]
    keep += [f"{f2} >= 1", f"{v2} >= 1"]
    return f"with p as (select vec_id, {', '.join(columns)} from (select vec_id, list_transform(embedding, lambda v: cast(v as double)) as e from embeddings)) select vec_id, {', '.join(f'round({x}, 5) as {n}' for n, x in out)} from p where {' and '.join(keep)}"


QUERIES, ORACLE = {"landmarks": landmarks}, {"landmarks": _sql()}
