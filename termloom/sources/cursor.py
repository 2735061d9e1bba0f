"""A cursor over bytes, forwards or backwards, and the integers and strings that index files hold.

One class serves both directions: a backward cursor is a forward one over the reversed bytes, so that positions are
still counted from the first byte of the file.
"""

from __future__ import annotations


class Cursor:
    """Reads on from a position; ``backward`` starts at the last byte and goes down."""

    def __init__(self, data: bytes, backward: bool = False, start: int | None = None) -> None:
        self.size, self.backward = len(data), backward
        self.data = data[::-1] if backward else data
        self.at = 0
        if start is not None:
            self.position = start

    @property
    def position(self) -> int:
        return self.size - 1 - self.at if self.backward else self.at

    @position.setter
    def position(self, value: int) -> None:
        self.at = self.size - 1 - value if self.backward else value

    def slice(self, start: int, length: int) -> Cursor:
        """A cursor over a part of the file, in the same direction."""
        whole = self.data[::-1] if self.backward else self.data
        if start < 0 or start + length > self.size:
            raise ValueError("slice outside the bytes")
        return Cursor(whole[start : start + length], self.backward)

    def peek(self, ahead: int = 0) -> int:
        """The byte so far ahead of the cursor, which stays."""
        return self.data[self.at + ahead]

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        if self.at + n > self.size:
            raise ValueError(f"{n} bytes wanted, {self.size - self.at} left")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def skip(self, n: int) -> None:
        self.at += n

    @property
    def left(self) -> int:
        return self.size - self.at

    def fixed(self, size: int, order: str = "big", signed: bool = True) -> int:
        return int.from_bytes(self.take(size), order, signed=signed)

    def varying(self) -> int:
        """Groups of seven bits, low ones first."""
        n = shift = 0
        while True:
            b = self.byte()
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    def blob(self) -> bytes:
        return self.take(self.varying())

    def text(self) -> str:
        return self.blob().decode()


def varying(n: int, bits: int = 32) -> bytes:
    """Groups of seven bits, low ones first, of the number's two's complement: five bytes for a negative 32-bit one."""
    n &= (1 << bits) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def blob(data: bytes) -> bytes:
    return varying(len(data)) + data
