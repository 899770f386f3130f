"""Rigid-body geometry on row-major matrices in arrays, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dot(a: list[Column], b: list[Column]) -> Column:
    return _sum([x * y for x, y in zip(a, b)])


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def product(a: list[Column] | Column, b: list[Column] | Column, n: int) -> list[Column]:
    """The numbers of the product of two n x n matrices, each given as an array or as its numbers."""
    return [_sum([a[i * n + k] * b[k * n + j] for k in range(n)]) for i in range(n) for j in range(n)]


def matmul(a: Column, b: Column, n: int = 4) -> Column:
    return F.array(*product(a, b, n))


def times(*poses: Column) -> Column:
    """The product of 4x4 poses. Each factor is evaluated once, however long its expression is, as `matmul` repeats them."""
    two = lambda a, b: F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: matmul(p["a"], p["b"]))[0]
    return reduce(two, poses)


def rotation(t: Column) -> Column:
    """The 9 numbers of a 4x4 pose's rotation."""
    return F.array(*[t[i * 4 + j] for i in range(3) for j in range(3)])


def translation(t: Column) -> Column:
    return F.array(t[3], t[7], t[11])


def pose(rot: list[Column], xyz: list[Column]) -> Column:
    """A 4x4 pose from 9 numbers of a rotation and 3 of a place."""
    rows = [[*rot[3 * i : 3 * i + 3], xyz[i]] for i in range(3)]
    return F.array(*rows[0], *rows[1], *rows[2], *map(F.lit, (0.0, 0.0, 0.0, 1.0)))


def inverse_pose(t: Column) -> Column:
    """Inverse of a 4x4 pose whose upper left is a rotation."""
    turned = [t[j * 4 + i] for i in range(3) for j in range(3)]
    return pose(turned, [-_sum([t[j * 4 + i] * t[j * 4 + 3] for j in range(3)]) for i in range(3)])


def transformed(t: Column, x: Column, y: Column, z: Column) -> Column:
    return F.array(*[t[i * 4] * x + t[i * 4 + 1] * y + t[i * 4 + 2] * z + t[i * 4 + 3] for i in range(3)])


def projected(k: Column, p: Column) -> Column:
    """Pixel (u, v) of a camera point by 9 numbers of intrinsics; null behind the camera."""
    return F.when(p[2] > 0, F.array(k[0] * p[0] / p[2] + k[2], k[4] * p[1] / p[2] + k[5]))


def in_view(pixel: Column, width: int, height: int) -> Column:
    """Whether a pixel of `projected` lies in the image; false behind the camera."""
    return F.coalesce((pixel[0] >= 0) & (pixel[0] < width) & (pixel[1] >= 0) & (pixel[1] < height), F.lit(False))


def rotation_skew(t: Column) -> Column:
    """Greatest entry of |R'R - I|."""
    terms = [F.abs(_sum([t[k * 4 + i] * t[k * 4 + j] for k in range(3)]) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(3)]
    return F.greatest(*terms)


def is_identity(t: Column, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    """Whether a pose is the identity but for rounding: each entry within absolute + relative * |its own|."""
    return F.forall(F.zip_with(t, F.array(*map(F.lit, IDENTITY)), lambda a, b: F.abs(a - b) <= absolute + relative * F.abs(b)), lambda ok: ok)


def yaw_pose(angle: Column, x: Column, y: Column, z: Column) -> Column:
    c, s, o, i = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, o, x, s, c, o, y, o, o, i, z, o, o, o, i)


def rot6d(rot: Column) -> Column:
    """The first two rows of a rotation's 9 numbers."""
    return F.slice(rot, 1, 6)


def from_rot6d(v: Column) -> list[Column]:
    """9 numbers of the rotation whose first two rows are nearest to 6 numbers: made orthogonal one after the other."""
    a, b = [v[k].cast("double") for k in range(3)], [v[k].cast("double") for k in range(3, 6)]
    na = norm(a)
    x = [e / na for e in a]
    along = dot(x, b)
    b = [e - along * f for e, f in zip(b, x)]
    nb = norm(b)
    y = [e / nb for e in b]
    return [*x, *y, *cross(x, y)]


def relative(anchor: Column, t: Column) -> Column:
    """The pose t seen from the pose anchor."""
    return matmul(inverse_pose(anchor), t)


def angle_between(a: Column, b: Column) -> Column:
    """Degrees between the rotations of two poses."""
    trace = _sum([a[k * 4 + i] * b[k * 4 + i] for i in range(3) for k in range(3)])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def distance_between(a: Column, b: Column) -> Column:
    return norm([a[k] - b[k] for k in (3, 7, 11)])


def flipped(k: Column, width: int, height: int) -> Column:
    """Intrinsics of an image turned by 180 degrees."""
    return F.array(k[0], k[1], (width - 1) - k[2], k[3], k[4], (height - 1) - k[5], k[6], k[7], k[8])


def cropped(k: Column, x: float, y: float) -> Column:
    return F.array(k[0], k[1], k[2] - x, k[3], k[4], k[5] - y, k[6], k[7], k[8])


def resized(k: Column, sx: float, sy: float) -> Column:
    return F.array(k[0] * sx, k[1] * sx, k[2] * sx, k[3] * sy, k[4] * sy, k[5] * sy, k[6], k[7], k[8])


def unprojected(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """The camera point of a pixel at a depth."""
    return F.array((u - cx) * depth / fx, (v - cy) * depth / fy, depth)


def on_plane(t: Column, k: Column, u: Column, v: Column, height: float) -> Column:
    """Where the ray of a pixel meets the level z = height, for a camera at pose t."""
    ray = [(u - k[2]) / k[0], (v - k[5]) / k[4], F.lit(1.0)]
    way = [dot([t[i * 4 + j] for j in range(3)], ray) for i in range(3)]
    s = (height - t[11]) / F.nullif(way[2], F.lit(0.0))
    return F.array(*[t[i * 4 + 3] + s * way[i] for i in range(3)])


def outline(x0: Column, x1: Column, y0: Column, y1: Column, n: int) -> Column:
    """(x, y) along the four sides of a box, n to a side, both ends included."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    share = lambda k: k / (n - 1)
    side = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array(a[0] + share(k) * (b[0] - a[0]), a[1] + share(k) * (b[1] - a[1])))
    return F.concat(*[side(a, b) for a, b in zip(corners, corners[1:])])


def orbit(p: list[Column], p0: list[Column], pivot: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """(yaw, pitch, dolly) of a place p seen from a place p0 about a pivot: degrees, degrees and the ratio of distances."""
    v, v0 = [a - b for a, b in zip(p, pivot)], [a - b for a, b in zip(p0, pivot)]
    yaw = F.degrees(F.atan2(v[1], v[0]) - F.atan2(v0[1], v0[0]))
    pitch = F.degrees(F.asin(v[2] / norm(v)) - F.asin(v0[2] / norm(v0)))
    return F.pmod(yaw + 180.0, F.lit(360.0)) - 180.0, pitch, norm(v) / norm(v0)


def about_pivot(t: Column, yaw: Column, pivot: tuple[float, float, float]) -> Column:
    """The pose t turned by `yaw` radians about the vertical through a pivot."""
    c, s, o, i = F.cos(yaw), F.sin(yaw), F.lit(0.0), F.lit(1.0)
    turn = [c, -s, o, s, c, o, o, o, i]
    arm = [t[k * 4 + 3] - pivot[k] for k in range(3)]
    return pose(product(turn, [t[r * 4 + j] for r in range(3) for j in range(3)], 3), [dot(turn[3 * k : 3 * k + 3], arm) + pivot[k] for k in range(3)])


def euler_xyz(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """9 numbers of the rotation about x, then y, then z of fixed axes."""
    (ca, sa), (cb, sb), (cc, sc) = ((F.cos(v), F.sin(v)) for v in (roll, pitch, yaw))
    return [cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa, sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa, -sb, cb * sa, cb * ca]


def nudged(t: Column, push: list[Column], turn: list[Column], speed: float, spin: float) -> Column:
    """The pose t moved by a six-axis device: its y goes to x, its x to -y, its z to z; roll, pitch and minus yaw turn about fixed axes."""
    x, y, z = push
    rot = product(euler_xyz(turn[0] * spin, turn[1] * spin, -turn[2] * spin), [t[r * 4 + j] for r in range(3) for j in range(3)], 3)
    return pose(rot, [t[3] + y * speed, t[7] - x * speed, t[11] + z * speed])


def limited(v: Column, most: float) -> Column:
    """A vector shortened to a length of at most `most`."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x * F.least(F.lit(1.0), F.lit(most) / F.nullif(n, F.lit(0.0))))


def lerp(a: Column, b: Column, share: Column) -> Column:
    """Between two vectors, at a share held within 0 and 1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.zip_with(a, b, lambda x, y: x + s * (y - x))


def in_front(a: Column, b: Column, near: float) -> Column:
    """(a, b) of the part of a segment beyond the plane z = near, the end in front first; null if all of it lies behind."""
    cut = lambda p, q: F.array(p, F.zip_with(p, q, lambda x, y: x + (p[2] - near) / (p[2] - q[2]) * (y - x)))
    return F.when((a[2] > near) & (b[2] > near), F.array(a, b)).when(a[2] > near, cut(a, b)).when(b[2] > near, cut(b, a))


def depth_mm(metres: Column, low: float = 0.168, high: float = 10.0) -> Column:
    """Whole millimetres of a depth within range; 0 for what is out of it, unknown or not a number."""
    return F.when(metres.between(low, high) & ~F.isnan(metres), F.floor(metres * 1000)).otherwise(0).cast("int")


def finite(x: Column) -> Column:
    """0 for what is not a finite number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
