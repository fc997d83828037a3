"""The BLAKE3 hash function, by its published specification: chunks of 1024 bytes under a binary tree."""

from __future__ import annotations

import struct

#: The initial words (those of SHA-256) and the message permutation.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
START, END, PARENT, ROOT = 1, 2, 4, 8
MASK = 0xFFFFFFFF
#: Which state words each of a round's eight mixings takes: columns, then diagonals.
LANES = tuple((i, 4 + (i + s) % 4, 8 + (i + 2 * s) % 4, 12 + (i + 3 * s) % 4) for s in (0, 1) for i in range(4))


def compress(chain: tuple, block: bytes, counter: int, flags: int) -> tuple:
    """One block's 8 output words."""
    m = struct.unpack("<16I", block.ljust(64, b"\0"))
    v = [*chain, *IV[:4], counter & MASK, counter >> 32, len(block), flags]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(LANES):
            for word, right, left in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & MASK
                x = v[d] ^ v[a]
                v[d] = (x >> right | x << (32 - right)) & MASK
                v[c] = (v[c] + v[d]) & MASK
                x = v[b] ^ v[c]
                v[b] = (x >> left | x << (32 - left)) & MASK
        m = tuple(m[p] for p in PERMUTATION)
    return tuple(x ^ y for x, y in zip(v[:8], v[8:], strict=True))


def tree(data: bytes, first: int, root: int) -> tuple:
    """The chaining value of some whole chunks: the left half is the largest power of two that leaves a right one."""
    if len(data) <= 1024:
        chain, blocks = IV, [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
        for i, block in enumerate(blocks):
            last = i == len(blocks) - 1
            chain = compress(chain, block, first, (START if i == 0 else 0) | (END | root if last else 0))
        return chain
    half = 1 << ((len(data) - 1) // 1024).bit_length() - 1
    left, right = tree(data[: 1024 * half], first, 0), tree(data[1024 * half :], first + half, 0)
    return compress(IV, struct.pack("<16I", *left, *right), 0, PARENT | root)


def blake3(data: bytes) -> bytes:
    return struct.pack("<8I", *tree(bytes(data), 0, ROOT))
