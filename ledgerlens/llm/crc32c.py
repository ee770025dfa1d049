"""CRC-32C (Castagnoli) of long byte strings by whole-array table steps."""

from __future__ import annotations

import numpy as np

_POLY = 0x82F63B78
_LANE = 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    return t


TABLE = _byte_table()


def _apply(columns: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given by a table per byte (4, 256), on each crc."""
    return columns[0][crc & 255] ^ columns[1][(crc >> 8) & 255] ^ columns[2][(crc >> 16) & 255] ^ columns[3][crc >> 24]


def _zero_bytes(n: int) -> np.ndarray:
    """Tables of the map that n zero bytes make of a crc, n a power of two."""
    maps = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    maps = (maps >> np.uint32(8)) ^ TABLE[maps & 255]
    while n > 1:
        maps = np.stack([_apply(maps, row) for row in maps])
        n //= 2
    return maps


_SHIFTS: dict[int, np.ndarray] = {}


def _shift(n: int) -> np.ndarray:
    if n not in _SHIFTS:
        _SHIFTS[n] = _zero_bytes(n)
    return _SHIFTS[n]


def _plain(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc >> 8) ^ int(TABLE[(crc ^ b) & 255])
    return crc ^ 0xFFFFFFFF


def crc32c_many(records: list[bytes]) -> np.ndarray:
    """The CRC-32C of each record. Lanes of 64 bytes of all records advance together.

    A record is padded in front to whole lanes (leading zeros don't change a crc that starts at zero) and
    its first four bytes are inverted, which is the usual initial value. Each lane's crc then moves past the
    lanes after it, one power of two at a time, and those of a record are added up.
    """
    sizes = np.fromiter(map(len, records), np.int64, len(records))
    out = np.zeros(len(records), np.uint32)
    for i in np.flatnonzero(sizes < 4).tolist():
        out[i] = _plain(records[i])
    which = np.flatnonzero(sizes >= 4)
    if not len(which):
        return out
    sizes = sizes[which]
    lanes = -(-sizes // _LANE)
    ends = np.cumsum(lanes) * _LANE
    block = np.zeros(int(ends[-1]), np.uint8)
    for i, end, n in zip(which.tolist(), ends.tolist(), sizes.tolist(), strict=True):
        block[end - n : end] = np.frombuffer(records[i], np.uint8)
    for k in range(4):
        block[ends - sizes + k] ^= 255
    crc = np.zeros(len(block) // _LANE, np.uint32)
    for column in np.ascontiguousarray(block.reshape(-1, _LANE).T):
        crc = (crc >> np.uint32(8)) ^ TABLE[(crc ^ column) & 255]
    starts = np.cumsum(lanes) - lanes
    after = np.repeat(ends // _LANE, lanes) - 1 - np.arange(len(crc))
    width = 1
    while (far := after >= width).any():
        moved = np.flatnonzero(far & (after & width > 0))
        crc[moved] = _apply(_shift(width * _LANE), crc[moved])
        width *= 2
    out[which] = np.bitwise_xor.reduceat(crc, starts) ^ np.uint32(0xFFFFFFFF)
    return out


def masked_many(records: list[bytes]) -> list[int]:
    """The checksums that record files store: rotated right by 15 bits, plus a constant."""
    crc = crc32c_many(records).astype(np.uint64)
    return (((crc >> np.uint64(15) | crc << np.uint64(17)) + np.uint64(0xA282EAD8)) & np.uint64(0xFFFFFFFF)).tolist()
