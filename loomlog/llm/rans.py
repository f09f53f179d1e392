"""Static range asymmetric numeral systems over integer ids, in numpy.

One frequency table, scaled to a power of two, is shared by all blocks. A block spreads its ids
over lanes: id i goes to lane i % lanes, and all lanes take a step at once. States are 64 bit, words
are 32 bit, so a lane gives or takes at most one word a step. Every `every` steps the encoder notes
all states and the place in the words; a decoder starts at any such checkpoint, and decode() runs
all of them side by side.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK = np.uint64(0xFFFFFFFF)
HEAD = struct.Struct("<4sIQIIIII")
MAGIC = b"RNS1"


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to 2**bits, their running sums, and the id of each slot."""

    bits: int
    freq: np.ndarray
    start: np.ndarray
    slot: np.ndarray


def scaled(counts: np.ndarray, bits: int = 20) -> np.ndarray:
    """Counts scaled to sum 2**bits; every id that occurs keeps at least 1. All zero: all zero."""
    counts = np.asarray(counts, dtype=np.float64)
    total, used = counts.sum(), counts > 0
    if not total:
        return np.zeros(len(counts), dtype=np.uint32)
    if used.sum() > 1 << bits:
        raise ValueError("more ids than slots")
    freq = np.where(used, np.maximum(1, np.floor(counts / total * (1 << bits))), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    rest = (1 << bits) - int(freq.sum())
    if rest > 0:
        freq[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        cut = min(-rest, int(freq[i]) - 1, int(freq[i]) // 2 + 1)
        freq[i] -= cut
        rest += cut
    if rest < 0:
        freq[order[0]] += rest
    if freq.min() < 0 or (freq[used] < 1).any():
        raise ValueError("the table has too few slots")
    return freq.astype(np.uint32)


def table_of(freq: np.ndarray) -> Table:
    freq = np.asarray(freq, dtype=np.uint64)
    total = int(freq.sum())
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
    return Table(max(total, 1).bit_length() - 1, freq, start, slot)


def encode(ids: np.ndarray, table: Table, lanes: int = 2048, every: int = 128) -> bytes:
    """One block: head, checkpoints (word place, states), words; crc32 over all that follows it."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 256))
    bits, steps = np.uint64(table.bits), -(-n // lanes)
    limit = ((LOW >> bits) << WORD) * table.freq
    x = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks, given = [], 0
    for step in range(steps - 1, -1, -1):
        s = ids[step * lanes : (step + 1) * lanes]
        f, y = table.freq[s], x[: len(s)]
        full = y >= limit[s]
        out = (y[full] & MASK).astype("<u4")
        if len(out):
            words.append(out)
            given += len(out)
        y = np.where(full, y >> WORD, y)
        q = y // f
        x[: len(s)] = (q << bits) + (y - q * f) + table.start[s]
        if step % every == 0:
            marks.append((given, x.copy()))
    marks.reverse()
    body = b"".join([
        np.array([given - at for at, _ in marks], dtype="<u8").tobytes(),
        *[state.astype("<u8").tobytes() for _, state in marks],
        *[w.tobytes() for w in reversed(words)],
    ])
    head = HEAD.pack(MAGIC, table.bits, n, lanes, every, len(marks), given, zlib.crc32(body))
    return head + body


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the checkpoints first..last (all by default), which are decoded side by side.

    Raises ValueError for a block that is damaged or made with another table.
    """
    magic, bits, n, lanes, every, marks, given, crc = HEAD.unpack_from(block)
    if magic != MAGIC or bits != table.bits or zlib.crc32(memoryview(block)[HEAD.size :]) != crc:
        raise ValueError("damaged block")
    places = np.frombuffer(block, "<u8", marks, HEAD.size).astype(np.int64)
    states = np.frombuffer(block, "<u8", marks * lanes, HEAD.size + 8 * marks).reshape(marks, lanes)
    words = np.frombuffer(block, "<u4", given, HEAD.size + 8 * marks * (1 + lanes)).astype(np.uint64)
    last = marks if last is None else min(last, marks)
    if first >= last or not n:
        return np.empty(0, dtype=np.uint32)
    x = states[first:last].astype(np.uint64).reshape(-1)
    at = places[first:last].copy()
    rows, shift, mask = last - first, np.uint64(bits), np.uint64((1 << bits) - 1)
    begin, end = first * every * lanes, min(n, last * every * lanes)
    out = np.empty(rows * every * lanes, dtype=np.uint32)
    cells = out.reshape(rows, every, lanes)
    steps_of_last = -(-(end - (last - 1) * every * lanes) // lanes)
    tail = end - ((last - 1) * every + steps_of_last - 1) * lanes
    for step in range(every):
        if step >= steps_of_last:
            rows = last - first - 1
            if not rows:
                break
        width = rows * lanes
        if rows == last - first and step == steps_of_last - 1:
            width -= lanes - tail
        y = x[:width]
        low = y & mask
        s = table.slot[low]
        y = table.freq[s] * (y >> shift) + low - table.start[s]
        empty = y < LOW
        if empty.any():
            # Lanes of a checkpoint take its words in lane order.
            padded = np.zeros(rows * lanes, dtype=bool)
            padded[:width] = empty
            need = padded.reshape(rows, lanes)
            nth = np.cumsum(need, axis=1) - 1 + at[:rows, None]
            y[empty] = (y[empty] << WORD) | words[nth[need]]
            at[:rows] += need.sum(axis=1)
        x[:width] = y
        if width != rows * lanes:
            flat = np.zeros(rows * lanes, dtype=np.uint32)
            flat[:width] = s
            cells[:rows, step] = flat.reshape(rows, lanes)
        else:
            cells[:rows, step] = s.reshape(rows, lanes)
    return out[: end - begin]
