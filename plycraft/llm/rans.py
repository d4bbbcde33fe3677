"""Static range asymmetric numeral system over token ids, in numpy.

A file holds whole documents in order. One frequency table, scaled to 2**20, is shared by
all blocks of the file; each block of ids is coded by interleaved 64-bit states that
start from the block's own checkpoint (the states), so blocks decode independently and in
any order, and a CRC-32 of each block's ids guards it. All blocks advance together: one
numpy step handles a lane of every block.

Layout: magic, little-endian uint32 header length, JSON header (sizes, zlib-packed table
lengths, block index), then the packed table, the document table and the blocks.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

MAGIC = b"RANSIDS1"
SCALE_BITS, LANES, BLOCK = 20, 64, 1 << 16
SCALE = np.uint64(1 << SCALE_BITS)
LOW = np.uint64(1 << 32)
WORD = np.uint64(32)


def scaled_table(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**20, at least 1 for each id that occurs. What rounding
    leaves over or short goes to the most frequent ids."""
    total = int(counts.sum())
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * float(SCALE) / max(total, 1)), 0).astype(np.int64)
    rest = int(SCALE) - int(freq.sum())
    order = np.argsort(-counts, kind="stable")
    if rest >= 0:
        freq[order[0]] += rest
    else:  # many rare ids were lifted to 1
        for i in order:
            take = min(int(freq[i]) - 1, -rest)
            freq[i] -= max(take, 0)
            rest += max(take, 0)
            if rest == 0:
                break
        if rest:
            raise ValueError("more distinct ids than the table's scale")
    return freq


def encode(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> bytes:
    """A file's bytes. ``lengths`` partitions ``ids`` into documents."""
    n = len(ids)
    blocks = -(-n // block)
    counts = np.bincount(ids, minlength=1) if n else np.zeros(1, np.int64)
    streams, states, sums = [], [], []
    if n:
        freq = scaled_table(counts)
        f, c = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        padded = np.full(blocks * block, int(np.argmax(counts)), np.uint32)
        padded[:n] = ids
        grid = padded.reshape(blocks, block // lanes, lanes)
        x = np.full((blocks, lanes), LOW, np.uint64)
        words = np.empty((block // lanes, blocks, lanes), np.uint32)
        over = np.empty((block // lanes, blocks, lanes), bool)
        shift = np.uint64(64 - SCALE_BITS)
        for t in range(block // lanes - 1, -1, -1):
            s = grid[:, t, :]
            fs = f[s]
            full = x >= (fs << shift)
            # a frequency of the whole scale never renormalises: its shift wraps to 0
            full &= fs < SCALE
            words[t], over[t] = x.astype(np.uint32), full
            x = np.where(full, x >> WORD, x)
            q = x // fs
            x = (q << np.uint64(SCALE_BITS)) + (x - q * fs) + c[s]
        for b in range(blocks):
            streams.append(words[:, b, :][over[:, b, :]].tobytes())
            states.append(x[b].tobytes())
            sums.append(zlib.crc32(padded[b * block : min(n, (b + 1) * block)].astype("<u4").tobytes()))
        table = zlib.compress(freq.astype("<u4").tobytes(), 6)
    else:
        table = b""
    docs = zlib.compress(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<i8").tobytes(), 6)
    head = json.dumps({"ids": n, "docs": len(doc_ids), "block": block, "lanes": lanes, "table": len(table), "doc_table": len(docs), "streams": [len(s) for s in streams], "crc32": sums}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, table, docs, *(a + b for a, b in zip(states, streams, strict=True))])


class Reader:
    """Decodes whole files, single blocks, or a range of ids."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an id file")
        (size,) = struct.unpack_from("<I", data, 8)
        self.h = json.loads(data[12 : 12 + size])
        at = 12 + size
        if self.h["ids"]:
            freq = np.frombuffer(zlib.decompress(data[at : at + self.h["table"]]), "<u4").astype(np.int64)
            self.f, self.c = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
            self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        at += self.h["table"]
        both = np.frombuffer(zlib.decompress(data[at : at + self.h["doc_table"]]), "<i8")
        self.doc_ids, self.lengths = both[: self.h["docs"]], both[self.h["docs"] :]
        at += self.h["doc_table"]
        sizes = np.array(self.h["streams"], np.int64) + 8 * self.h["lanes"]
        self.starts = at + np.r_[0, np.cumsum(sizes)]
        self.data = data

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks ``first`` to ``last - 1``, checked."""
        h, k = self.h, last - first
        if k <= 0:
            return np.zeros(0, np.uint32)
        lanes, steps = h["lanes"], h["block"] // h["lanes"]
        x = np.stack([np.frombuffer(self.data, "<u8", lanes, self.starts[b]) for b in range(first, last)])
        streams = [np.frombuffer(self.data, "<u4", h["streams"][b] // 4, self.starts[b] + 8 * lanes) for b in range(first, last)]
        at = np.r_[0, np.cumsum([len(s) for s in streams])][:-1].astype(np.int64)
        flat = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
        out = np.empty((k, steps, lanes), np.uint32)
        mask = SCALE - np.uint64(1)
        for t in range(steps):
            slot = x & mask
            s = self.symbol[slot]
            out[:, t, :] = s
            x = self.f[s] * (x >> np.uint64(SCALE_BITS)) + slot - self.c[s]
            need = x < LOW
            rank = np.cumsum(need, axis=1)
            where = at[:, None] + rank - 1
            x = np.where(need, (x << WORD) | flat[np.where(need, where, 0)], x)
            at = at + rank[:, -1]
        ids = out.reshape(k, -1)
        for i, b in enumerate(range(first, last)):
            n = min(h["block"], h["ids"] - b * h["block"])
            if zlib.crc32(ids[i, :n].astype("<u4").tobytes()) != h["crc32"][b]:
                raise ValueError(f"block {b} is damaged")
        return ids.reshape(-1)[: min(last * h["block"], h["ids"]) - first * h["block"]]

    def all(self) -> np.ndarray:
        return self.blocks(0, len(self.h["streams"]))

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop - 1``; only the blocks that hold them are decoded."""
        b = self.h["block"]
        got = self.blocks(start // b, -(-stop // b))
        return got[start - start // b * b : stop - start // b * b]
