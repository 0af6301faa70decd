"""MD5 of many short texts at once: a prefix with each number of a range behind it."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = [n for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 4294967296) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts of one numpy step, so that its arrays stay in a core's cache.
_CHUNK = 1 << 15


def _first_words(words: list, n: int) -> np.ndarray:
    """The first word of the state after a message of one block. words: 16 numbers, or arrays of n where texts differ."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    # The first word of the result is what the 61st step writes.
    for i in range(61):
        kind = i // 16
        if kind < 2:  # d ^ (b & (c ^ d)), then c ^ (d & (b ^ c))
            x, y, z = (b, c, d) if kind == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        np.add(f, a, out=f)
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f)
            word = 0
        np.add(f, np.uint32((_SINES[i] + word) & 0xFFFFFFFF), out=f)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=g)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)  # a's old value isn't needed any more
        a, b, c, d = d, a, b, c
    return b + np.uint32(_START[0])


def md5_of_numbers(prefix: str, low: int, high: int) -> np.ndarray:
    """The first 32 bits of the MD5 of prefix + str(k), for each k from low to high - 1 (none negative)."""
    out = np.empty(high - low, np.uint32)
    while low < high:
        digits = len(str(low))
        upto = min(high, 10**digits, low + _CHUNK)
        head = prefix.encode()
        size = len(head) + digits
        if size > 55:
            raise ValueError("a text of more than one block")
        numbers, rest = np.arange(low, upto), []
        for _ in range(digits):
            numbers, last = np.divmod(numbers, 10)
            rest.append(last.astype(np.uint32) + np.uint32(48))
        fixed = head + bytes(digits) + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
        words: list = [int.from_bytes(fixed[k : k + 4], "little") for k in range(0, 64, 4)]
        for place, digit in enumerate(reversed(rest), len(head)):
            words[place // 4] = (digit << np.uint32(8 * (place % 4))) + (words[place // 4] if isinstance(words[place // 4], np.ndarray) else np.uint32(words[place // 4]))
        out[len(out) - (high - low) : len(out) - (high - upto)] = _first_words(words, upto - low).byteswap()
        low = upto
    return out
