"""Ed25519 signatures (RFC 8032), as executors have no JVM to ask and the box no library.

Points are (X, Y, Z, T) with x = X/Z, y = Y/Z, xy = T/Z. A signature takes some milliseconds. Python's integers don't
take the same time for all values, so keys are for batch jobs, not for a service that others can time.
"""

from __future__ import annotations

import functools
import hashlib

# The curve. Fixed values.
PRIME = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
CURVE = -121665 * pow(121666, -1, PRIME) % PRIME
ROOT_OF_MINUS_ONE = pow(2, (PRIME - 1) // 4, PRIME)

Point = tuple[int, int, int, int]
ZERO: Point = (0, 1, 1, 0)


def plus(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]), (p[1] + p[0]) * (q[1] + q[0])
    c, d = 2 * CURVE * p[3] * q[3] % PRIME, 2 * p[2] * q[2]
    e, f, g, h = (b - a) % PRIME, (d - c) % PRIME, (d + c) % PRIME, (b + a) % PRIME
    return e * f % PRIME, g * h % PRIME, f * g % PRIME, e * h % PRIME


def times(n: int, p: Point) -> Point:
    out = ZERO
    while n:
        if n & 1:
            out = plus(out, p)
        p, n = plus(p, p), n >> 1
    return out


def packed(p: Point) -> bytes:
    z = pow(p[2], -1, PRIME)
    x, y = p[0] * z % PRIME, p[1] * z % PRIME
    return (y | (x & 1) << 255).to_bytes(32, "little")


def unpacked(data: bytes) -> Point | None:
    """The point of 32 bytes, or None if they are none's."""
    number = int.from_bytes(data, "little")
    y, odd = number & (1 << 255) - 1, number >> 255
    if len(data) != 32 or y >= PRIME:
        return None
    square = (y * y - 1) * pow(CURVE * y * y + 1, -1, PRIME) % PRIME
    x = pow(square, (PRIME + 3) // 8, PRIME)
    if x * x % PRIME != square:
        x = x * ROOT_OF_MINUS_ONE % PRIME
    if x * x % PRIME != square or (not x and odd):
        return None
    x = x if x & 1 == odd else PRIME - x
    return x, y, 1, x * y % PRIME


#: The generator: its y is 4/5, its x even.
BASE = unpacked((4 * pow(5, -1, PRIME) % PRIME).to_bytes(32, "little"))


@functools.cache
def _doublings() -> list[Point]:
    out = [BASE]
    for _ in range(255):
        out.append(plus(out[-1], out[-1]))
    return out


def times_base(n: int) -> Point:
    out = ZERO
    for i, p in enumerate(_doublings()):
        if n >> i & 1:
            out = plus(out, p)
    return out


def _hashed(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


@functools.lru_cache(16)
def _secret(seed: bytes) -> tuple[int, bytes, bytes]:
    """Scalar, nonce prefix and public key of a seed of 32 bytes."""
    if len(seed) != 32:
        raise ValueError("a seed has 32 bytes")
    h = hashlib.sha512(seed).digest()
    # the scalar's lowest three bits and its highest are cleared, the one below that is set
    scalar = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return scalar, h[32:], packed(times_base(scalar))


def public_key(seed: bytes) -> bytes:
    return _secret(seed)[2]


def sign(seed: bytes, message: bytes) -> bytes:
    scalar, prefix, public = _secret(seed)
    nonce = _hashed(prefix, message)
    point = packed(times_base(nonce))
    return point + ((nonce + _hashed(point, public, message) * scalar) % ORDER).to_bytes(32, "little")


def check(public: bytes, message: bytes, signature: bytes) -> bool:
    key = unpacked(public)
    answer = int.from_bytes(signature[32:], "little")
    if key is None or len(signature) != 64 or answer >= ORDER:
        return False
    minus = (PRIME - key[0], key[1], 1, PRIME - key[3])
    found = plus(times_base(answer), times(_hashed(signature[:32], public, message), minus))
    return packed(found) == signature[:32]
