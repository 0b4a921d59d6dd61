"""The 64-bit xxHash of a row's values, and the numbers drawn from it, as SQL for DuckDB."""

from __future__ import annotations

import math

#: The primes of the algorithm.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
MASK = (1 << 64) - 1


def wide(x: object) -> str:
    return f"{x}::UHUGEINT"


def low(x: str) -> str:
    return f"({x} & {wide(MASK)})"


def times(x: str, prime: int) -> str:
    return low(f"({x} * {wide(PRIMES[prime - 1])})")


def rotated(x: str, by: int) -> str:
    return low(f"(({x} << {by}) | ({x} >> {64 - by}))")


class Hashed:
    """Selects all columns of a source with hashes as further columns; each step is a layer, so that no value is computed twice."""

    def __init__(self, source: str):
        self.sql = f"SELECT * FROM {source}"

    def step(self, name: str, value: str) -> None:
        self.sql = f"SELECT * EXCLUDE ({name}), {value} AS {name} FROM ({self.sql})"

    def hash(self, name: str, *parts: tuple[str, object]) -> Hashed:
        """``parts``: (int, expression), (long, expression) of numbers that aren't negative, or (text, up to three letters)."""
        self.sql = f"SELECT *, {wide(42)} AS {name} FROM ({self.sql})"
        for kind, value in parts:
            size = {"int": 4, "long": 8}.get(kind) or len(str(value))
            self.step(name, low(f"({name} + {wide(PRIMES[4])} + {wide(size)})"))
            if kind == "int":
                self.step(name, f"xor({name}, {times(wide(f'({value})'), 1)})")
                self.step(name, low(f"({times(rotated(name, 23), 2)} + {wide(PRIMES[2])})"))
            elif kind == "long":
                self.step(name, f"xor({name}, {times(rotated(times(wide(f'({value})'), 2), 31), 1)})")
                self.step(name, low(f"({times(rotated(name, 27), 1)} + {wide(PRIMES[3])})"))
            else:
                raw = str(value).encode()
                if len(raw) >= 4:
                    word = int.from_bytes(raw[:4], "little")
                    self.step(name, f"xor({name}, {times(wide(word), 1)})")
                    self.step(name, low(f"({times(rotated(name, 23), 2)} + {wide(PRIMES[2])})"))
                    raw = raw[4:]
                for byte in raw:
                    self.step(name, f"xor({name}, {times(wide(byte), 5)})")
                    self.step(name, times(rotated(name, 11), 1))
            for shift, prime in ((33, 2), (29, 3), (32, 0)):
                self.step(name, f"xor({name}, {name} >> {shift})")
                if prime:
                    self.step(name, times(name, prime))
        return self


def uniform(name: str) -> str:
    return f"((({name} & {wide((1 << 40) - 1)})::BIGINT + 1) / {float(1 << 40)}::DOUBLE)"


def normal(first: str, second: str) -> str:
    return f"(sqrt(-2 * ln({uniform(first)})) * cos({uniform(second)} * {2 * math.pi}))"
