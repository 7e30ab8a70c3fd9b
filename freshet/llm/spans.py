"""CRC-32 of many byte spans at once, and the words of an Arrow column of texts as such spans.

CRC-32 is affine over GF(2): the checksum of a span is the XOR of one contribution for each byte, which depends only
on the byte and on its distance from the span's end, and of a constant, which depends only on the span's length. The
contributions of the last BLOCK places are a table; `bitwise_xor.reduceat` adds up the bytes of each span. A longer
span is cut into blocks, counted from its end; pairs of blocks are folded by tables that move a checksum over
2^j bytes. Work arrays hold CHUNK bytes of spans at a time; a span that is longer is folded chunk by chunk.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

#: Fixed value: the reflected generator polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
ALL_ONES = np.uint32(0xFFFFFFFF)
BLOCK = 64
CHUNK = 1 << 20


@cache
def steps(power: int) -> np.ndarray:
    """(4, 256): what each byte of a checksum register becomes after 2^power zero bytes."""
    if power:
        return advanced(steps(power - 1), power - 1)
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), one >> np.uint32(1))
    table = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k - 8) if k else one for k in range(4)])
    table.setflags(write=False)
    return table


def advanced(registers: np.ndarray, power: int) -> np.ndarray:
    """The registers after 2^power zero bytes."""
    table = steps(power)
    return (table[0][registers & 255] ^ table[1][(registers >> np.uint32(8)) & 255]
            ^ table[2][(registers >> np.uint32(16)) & 255] ^ table[3][registers >> np.uint32(24)])


def moved(registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each register after its own number of zero bytes."""
    out = np.array(registers, np.uint32)
    left, power = np.array(lengths, np.int64), 0
    while left.any():
        odd = (left & 1).astype(bool)
        if odd.any():
            out[odd] = advanced(out[odd], power)
        left >>= 1
        power += 1
    return out


@cache
def positions() -> np.ndarray:
    """(BLOCK * 256): the contribution of a byte at each distance from the end of its block."""
    rows = [steps(0)[0]]
    for _ in range(BLOCK - 1):
        rows.append(advanced(rows[-1], 0))
    return np.concatenate(rows)


@cache
def length_constants() -> np.ndarray:
    """What the start and the end value of the register add to spans of up to BLOCK bytes."""
    lengths = np.arange(BLOCK + 1)
    return moved(np.full(BLOCK + 1, ALL_ONES), lengths) ^ ALL_ONES


def _linear(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The linear part of the checksums of spans of one byte or more."""
    after = np.cumsum(lengths)
    total = int(after[-1])
    at = np.arange(total, dtype=np.int64)
    distance = np.repeat(after, lengths) - 1 - at
    at += np.repeat(starts - (after - lengths), lengths)
    parts = positions()[(distance % BLOCK) * 256 + data[at]]
    blocks = -(-lengths // BLOCK)
    most = int(blocks.max())
    if most == 1:
        return np.bitwise_xor.reduceat(parts, after - lengths)
    first = np.cumsum(blocks) - blocks
    rank = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    to_end = (np.repeat(blocks, blocks) - 1 - rank) * BLOCK
    ends = np.repeat(after, blocks) - to_end
    begins = np.where(rank == 0, np.repeat(after - lengths, blocks), ends - BLOCK)
    values = np.bitwise_xor.reduceat(parts, begins)
    out = values[first + blocks - 1]
    for size in np.unique(blocks[blocks > 1]):
        spans = np.flatnonzero(blocks == size)
        fold = values[first[spans][:, None] + np.arange(size)[::-1]]  # the last block comes first
        power = BLOCK.bit_length() - 1
        while fold.shape[1] > 1:
            if fold.shape[1] % 2:
                fold = np.pad(fold, ((0, 0), (0, 1)))
            fold = fold[:, 0::2] ^ advanced(fold[:, 1::2], power)
            power += 1
        out[spans] = fold[:, 0]
    return out


def span_crc32(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of data[start:start + length] for every span; spans may overlap or be empty."""
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    out = np.zeros(len(starts), np.uint32)
    some = np.flatnonzero(lengths > 0)
    after = np.cumsum(lengths[some])
    begin = 0
    while begin < len(some):
        done = after[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(after, done + CHUNK, "right")))
        here = some[begin:end]
        if lengths[here[0]] > CHUNK:
            register = np.zeros(1, np.uint32)
            start, stop = int(starts[here[0]]), int(starts[here[0]] + lengths[here[0]])
            for at in range(start, stop, CHUNK):
                size = np.array([min(CHUNK, stop - at)])
                register = moved(register, size) ^ _linear(data, np.array([at]), size)
            out[here] = register
        else:
            out[here] = _linear(data, starts[here], lengths[here])
        begin = end
    constants = length_constants()[np.minimum(lengths, BLOCK)]
    long = np.flatnonzero(lengths > BLOCK)
    constants[long] = moved(np.full(len(long), ALL_ONES), lengths[long]) ^ ALL_ONES
    return out ^ constants


@cache
def lowered() -> np.ndarray:
    """Bytes of words with A-Z lower-cased; 0 for every byte that separates words."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    letters = np.zeros(256, bool)
    for low, high in (("0", "9"), ("a", "z"), ("A", "Z")):
        letters[ord(low):ord(high) + 1] = True
    letters[128:] = True
    return np.where(letters, table, 0).astype(np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and length of every word, and the number of words of each text."""
    data, offsets = text_bytes(column)
    data = lowered()[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 0
    starting, ending = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    cut = edges[inside[edges + 1]]  # a text that begins with a word, whatever the text before it ends with
    starting[cut] = True
    ending[edges - 1] |= inside[edges]
    starts = np.flatnonzero(starting)
    lengths = np.flatnonzero(ending) + 1 - starts
    count = np.diff(np.searchsorted(starts, offsets))
    return data, starts, lengths, count
