"""Field geometry as SQL expression text over struct<x,y,z> and struct<x,y,z,w> columns.

Text keeps a wide projection to one parse instead of thousands of column
objects; wrap it with `F.expr` or pass it to `selectExpr`.
"""

from __future__ import annotations

# Field size and speed limits used for scaling.
HALF_LENGTH = 5120.0
HALF_WIDTH = 5120.0
MAX_HEIGHT = 2044.0
DIAGONAL = 7245.0
MAX_CAR_SPEED = 2300.0
MAX_BALL_SPEED = 6000.0
BLUE_GOAL = (0.0, -5120.0, 0.0)
MIN_DIRECTION_LENGTH = 1.0e-4


def clamp(value: str, low: float, high: float) -> str:
    return f"greatest({low}D, least({value}, {high}D))"


def scaled(value: str, size: float, low: float = -1.0) -> str:
    return clamp(f"({value}) / {size}D", low, 1.0)


def scaled_position(p: str) -> list[str]:
    return [scaled(f"{p}.x", HALF_LENGTH), scaled(f"{p}.y", HALF_WIDTH), scaled(f"{p}.z", MAX_HEIGHT, 0.0)]


def scaled_velocity(v: str, limit: float) -> list[str]:
    return [scaled(f"{v}.{axis}", limit) for axis in "xyz"]


def vec3(x: float, y: float, z: float) -> str:
    return f"named_struct('x', {x}D, 'y', {y}D, 'z', {z}D)"


def dot(a: str, b: str) -> str:
    return " + ".join(f"{a}.{i} * {b}.{i}" for i in "xyz")


def magnitude(v: str) -> str:
    return f"sqrt({dot(v, v)})"


def distance(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{i} - {b}.{i}) * ({a}.{i} - {b}.{i})" for i in "xyz") + ")"


def scaled_distance(a: str, b: str) -> str:
    return f"least({distance(a, b)} / {DIAGONAL}D, 1.0D)"


def direction(a: str, b: str) -> str:
    """Unit vector from a to b, zero when the points coincide."""
    length = distance(a, b)
    parts = ", ".join(
        f"'{i}', if({length} < {MIN_DIRECTION_LENGTH}D, 0.0D, ({b}.{i} - {a}.{i}) / {length})" for i in "xyz"
    )
    return f"named_struct({parts})"


def quaternion_forward(q: str) -> str:
    """The unit X axis turned by a rotation."""
    x = f"1.0D - 2.0D * ({q}.y * {q}.y + {q}.z * {q}.z)"
    y = f"2.0D * ({q}.x * {q}.y + {q}.w * {q}.z)"
    z = f"2.0D * ({q}.x * {q}.z - {q}.w * {q}.y)"
    return f"named_struct('x', {x}, 'y', {y}, 'z', {z})"


def facing(position: str, rotation: str, target: str, length: str) -> str:
    """Cosine between where a car points and where the target is, `length` away."""
    forward = quaternion_forward(rotation)
    along = " + ".join(f"{forward}.{i} * ({target}.{i} - {position}.{i})" for i in "xyz")
    return f"if({length} < {MIN_DIRECTION_LENGTH}D, 0.0D, ({along}) / {length})"
