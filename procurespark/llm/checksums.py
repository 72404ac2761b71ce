"""CRC-32C of many byte strings at once, and the masked form that record files store."""

from __future__ import annotations

import numpy as np

#: Fixed values of the checksum: its reflected polynomial and the offset of the mask.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

LANE = 128


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


_BYTE = _byte_table()


def _shift_tables() -> np.ndarray:
    """For each byte of a checksum, what LANE zero bytes after it make of it."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(LANE):
        state = _BYTE[state & 0xFF] ^ (state >> 8)
    return state.reshape(4, 256)


_SHIFT = _shift_tables()


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The CRC-32C of each ``data[offsets[i]:offsets[i + 1]]``, at least 4 bytes long.

    The checksum is linear, so each string is cut into lanes of LANE bytes, zeros filling
    up the first; all lanes run in step, and their values are then combined in order.
    """
    lengths = np.diff(offsets)
    if not len(lengths):
        return np.zeros(0, np.uint32)
    if lengths.min() < 4:
        raise ValueError("strings of fewer than 4 bytes")
    lanes = -(-lengths // LANE)
    first = np.cumsum(lanes) - lanes
    # Where each string's bytes go when its lanes are filled up at the front.
    shift = first * LANE + lanes * LANE - lengths - offsets[:-1]
    laid = np.zeros(int(lanes.sum()) * LANE, np.uint8)
    for a, b, s in zip(offsets[:-1], offsets[1:], shift, strict=True):
        laid[a + s : b + s] = data[a:b]
    heads = (offsets[:-1] + shift)[:, None] + np.arange(4)
    laid[heads] ^= 0xFF  # the checksum begins with all bits set
    columns = np.ascontiguousarray(laid.reshape(-1, LANE).T)
    state = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        state = _BYTE[(state ^ column) & 0xFF] ^ (state >> 8)
    order = np.argsort(-lanes, kind="stable")
    many, start = lanes[order], first[order]
    out = np.zeros(len(order), np.uint32)
    for k in range(int(many[0])):
        n = int(np.searchsorted(-many, -k, side="left"))  # strings with more than k lanes
        old = out[:n]
        out[:n] = _SHIFT[0][old & 0xFF] ^ _SHIFT[1][(old >> 8) & 0xFF] ^ _SHIFT[2][(old >> 16) & 0xFF] ^ _SHIFT[3][old >> 24] ^ state[start[:n] + k]
    back = np.empty_like(out)
    back[order] = out
    return back ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The form stored in files, so that a checksum of data with checksums stays useful."""
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)
