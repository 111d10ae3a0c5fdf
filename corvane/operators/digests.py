"""MD5 of many short texts at once: the 64 steps run over arrays, so a digest costs no call of its own."""

from __future__ import annotations

import hashlib

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(np.sin(i + 1.0)) * 2**32)) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
BLOCK = 8192  # messages at a time, so that the steps stay in the cache


def _steps(words: np.ndarray) -> np.ndarray:
    """States after the one block of every message; ``words`` has a row for each of the block's 16 words."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    used = [w.any() for w in words]
    for i in range(64):
        turn = i // 16
        if turn == 0:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = (7 * i) % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        np.add(a, _SINES[i], out=a)
        if used[g]:
            np.add(a, words[g], out=a)
        s = _SHIFTS[turn][i % 4]
        np.left_shift(a, np.uint32(s), out=t)
        np.right_shift(a, np.uint32(32 - s), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return np.stack([x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True)], 1)


def numbered_md5(heads: list[bytes], of: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """MD5 of ``heads[of[i]]`` followed by ``numbers[i]`` in decimal, as four big-endian words a row."""
    if not len(of):
        return np.zeros((0, 4), np.uint32)
    sizes = np.fromiter(map(len, heads), np.int64, len(heads))
    digits = np.array([str(x) for x in range(int(numbers.max()) + 1)] if numbers.max() < 4 * len(numbers) else [str(x) for x in numbers.tolist()], "S")
    which = numbers if len(digits) == numbers.max() + 1 and numbers.max() < 4 * len(numbers) else np.arange(len(numbers))
    width = digits.dtype.itemsize
    length = np.char.str_len(digits)
    tails = np.zeros((len(digits), width + 1), np.uint8)
    tails[:, :width] = digits.view(np.uint8).reshape(len(digits), width)
    tails[np.arange(len(digits)), length] = 0x80
    short = sizes + width < 56
    base = np.frombuffer(b"".join((h if s else b"").ljust(64, b"\0") for h, s in zip(heads, short, strict=True)), np.uint8).reshape(-1, 64)
    out = np.empty((len(of), 4), np.uint32)
    for at in range(0, len(of), BLOCK):
        part, tail = of[at : at + BLOCK], which[at : at + BLOCK]
        block = base[part]
        flat, to = block.reshape(-1), np.arange(0, 64 * len(part), 64) + np.where(short[part], sizes[part], 0)
        for j in range(width + 1):
            flat[to + j] = tails[tail, j]
        words = np.ascontiguousarray(block.view("<u4").T)
        words[14] = 8 * (sizes[part] + length[tail])
        out[at : at + BLOCK] = _steps(words)
    out = out.byteswap()
    for i in np.flatnonzero(~short[of]):
        out[i] = np.frombuffer(hashlib.md5(heads[of[i]] + str(int(numbers[i])).encode(), usedforsecurity=False).digest(), ">u4")
    return out


def text_md5(head: bytes, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MD5 of ``head`` followed by ``data[offsets[i]:offsets[i+1]]``, as four big-endian words a row; ``head`` has less than 55 bytes."""
    sizes = np.diff(offsets)
    out = np.empty((len(sizes), 4), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    long = int((sizes + len(head) > 55).sum())
    for at in range(long, len(sizes), BLOCK):
        rows = order[at : at + BLOCK]
        size, first = sizes[rows], offsets[rows]
        block = np.zeros((len(rows), 64), np.uint8)
        block[:, : len(head)] = np.frombuffer(head, np.uint8)
        for j in range(int(size[0])):
            n = int(np.searchsorted(-size, -j))  # the first n rows have more than j bytes
            block[:n, len(head) + j] = data[first[:n] + j]
        block[np.arange(len(rows)), len(head) + size] = 0x80
        words = np.ascontiguousarray(block.view("<u4").T)
        words[14] = 8 * (len(head) + size)
        out[rows] = _steps(words)
    out = out.byteswap()
    for i in order[:long]:
        out[i] = np.frombuffer(hashlib.md5(head + data[offsets[i] : offsets[i + 1]].tobytes(), usedforsecurity=False).digest(), ">u4")
    return out
