"""Stable hashes and hash families as columns; the same formulas run in any SQL engine with md5."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def key_hash(key: Column) -> Column:
    """60-bit non-negative hash of a string: the first 15 hex digits of its md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def uniform(key: Column) -> Column:
    """Repeatable uniform in (0, 1) from a key, for tests and replays of noise; it gives no privacy."""
    return (key_hash(key).cast("double") + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@dataclass(frozen=True)
class HashFamily:
    """``depth`` pairwise independent functions onto 0..width-1: ((a * h + b) mod p) mod width."""

    depth: int
    width: int
    seed: int = 7
    prime: int = field(init=False)
    coefficients: tuple[tuple[int, int], ...] = field(init=False)

    def __post_init__(self) -> None:
        rng = random.Random(self.seed)
        object.__setattr__(self, "prime", next_prime(self.width))
        object.__setattr__(self, "coefficients", tuple((rng.randrange(1, max(2, self.width)), rng.randrange(self.width)) for _ in range(self.depth)))

    def positions(self, h: Column) -> Column:
        """array<long>: the position of hash ``h`` in each row; reduced first, so that no product overflows."""
        small = F.pmod(h, F.lit(self.prime))
        return F.array(*[F.pmod(F.pmod(F.lit(a) * small + F.lit(b), F.lit(self.prime)), F.lit(self.width)) for a, b in self.coefficients])


def matrix_hash(h: Column, rows: list[int], bits: int) -> Column:
    """XOR of the random rows that the set bits of ``h`` choose; 0 maps to all ones."""
    out = F.lit((1 << bits) - 1).cast("long")
    mixed = F.lit(0).cast("long")
    for i, r in enumerate(rows):
        mixed = mixed.bitwiseXOR(F.when(F.shiftright(h, i).bitwiseAND(F.lit(1)) == 1, F.lit(r).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.when(h == 0, out).otherwise(mixed)


def matrix_rows(bits: int, inputs: int, seed: int) -> list[int]:
    rng = random.Random(seed)
    return [rng.getrandbits(bits) for _ in range(inputs)]
