"""Blocks of token ids coded by a static range asymmetric numeral system.

A block holds consecutive documents. One frequency table serves all blocks. Token i of a block
belongs to lane i % LANES; the lanes' coders write 32-bit words into one interleaved stream. Every CHECKPOINT steps the
lanes' states and the stream's place are kept, so that a decoder can start there; all stretches of all blocks at hand
are decoded side by side as one numpy array. Layout, little-endian:

    header  magic, tokens, documents, words, checkpoints, crc32 of the table, crc32 of the ids
    index   doc_id int64, start of the document int64, its ids uint32, null id uint8, for each document
    marks   words before uint32, states of the lanes uint64, for each checkpoint
    words   uint32
    crc32   of all bytes before
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RAN1"
LANES = 32
CHECKPOINT = 512
TABLE_BITS = 20
HEADER = struct.Struct("<4sIIIIII")
LOW = np.uint64(1 << 32)
_BITS, _WORD = np.uint64(TABLE_BITS), np.uint64(32)
_ROOM = np.uint64(64 - TABLE_BITS)
_SLOT = np.uint64((1 << TABLE_BITS) - 1)


class Table:
    """Frequencies scaled to at most 2**TABLE_BITS slots; every token that occurs has at least one."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, counts = tokens[order].astype(np.int64), counts[order].astype(np.float64)
        free = (1 << TABLE_BITS) - 1 - len(tokens)
        if free < len(tokens):
            raise ValueError(f"{len(tokens)} different tokens do not fit a table of {TABLE_BITS} bits")
        freq = 1 + np.floor(counts / max(counts.sum(), 1) * free).astype(np.int64)
        size = int(self.tokens[-1]) + 1 if len(tokens) else 1
        self.freq, self.cum = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[self.tokens] = freq
        self.cum[self.tokens] = np.cumsum(freq) - freq
        self.slots = np.zeros(1 << TABLE_BITS, np.uint32)
        self.slots[: freq.sum()] = np.repeat(self.tokens, freq)
        self.crc = zlib.crc32(self.freq.tobytes())


def encode(table: Table, blocks: list[tuple[np.ndarray, list[tuple]]]) -> list[bytes]:
    """blocks: ids and [(doc_id or None, start of the document, ids here)] of each; one byte string for each."""
    order = sorted(range(len(blocks)), key=lambda b: -len(blocks[b][0]))
    sizes = np.array([len(blocks[b][0]) for b in order])
    steps = -(-sizes // LANES)
    top = int(steps[0]) if len(steps) else 0
    # [step, block, lane]: what one step touches lies together
    ids = np.zeros((top, len(order), LANES), np.uint32)
    for k, b in enumerate(order):
        flat = np.empty(steps[k] * LANES, np.uint32)
        flat[: sizes[k]] = blocks[b][0]
        flat[sizes[k] :] = blocks[b][0][-1] if sizes[k] else 0  # fills up the last step
        if len(flat) and (int(flat.max()) >= len(table.freq) or not table.freq[flat].all()):
            raise ValueError("a token is not in the frequency table")
        ids[: steps[k], k] = flat.reshape(-1, LANES)
    x = np.full((len(order), LANES), LOW)
    words, out = np.zeros(ids.shape, np.uint32), np.zeros(ids.shape, bool)
    states = np.zeros((-(-top // CHECKPOINT), len(order), LANES), np.uint64)
    active = np.searchsorted(-steps, -np.arange(top), "left")  # blocks with more steps than t
    for t in range(top - 1, -1, -1):
        k = int(active[t])
        s, y = ids[t, :k], x[:k]
        f = table.freq[s]
        full = y >= f << _ROOM
        words[t, :k], out[t, :k] = y, full
        y = np.where(full, y >> _WORD, y)
        q = y // f
        x[:k] = (q << _BITS) + (y - q * f) + table.cum[s]
        if t % CHECKPOINT == 0:
            states[t // CHECKPOINT, :k] = x[:k]
    made: list[bytes] = [b""] * len(blocks)
    for k, b in enumerate(order):
        flat, docs = blocks[b]
        marks = -(-int(steps[k]) // CHECKPOINT)
        sent = out[: steps[k], k]
        before = np.cumsum(sent.sum(1)) if marks else np.zeros(0, int)
        places = np.concatenate([[0], before[CHECKPOINT - 1 :: CHECKPOINT]])[:marks].astype("<u4")
        stream = words[: steps[k], k][sent].astype("<u4")
        head = HEADER.pack(MAGIC, len(flat), len(docs), len(stream), marks, table.crc, zlib.crc32(np.asarray(flat, "<u4").tobytes()))
        index = [np.array([d[0] or 0 for d in docs], "<i8"), np.array([d[1] for d in docs], "<i8"), np.array([d[2] for d in docs], "<u4"), np.array([d[0] is None for d in docs], "u1")]
        body = head + b"".join(a.tobytes() for a in index) + places.tobytes() + states[:marks, k].astype("<u8").tobytes() + stream.tobytes()
        made[b] = body + struct.pack("<I", zlib.crc32(body))
    return made


def decode(table: Table, payloads: list[bytes]) -> list[tuple[np.ndarray, list[tuple]]]:
    """The inverse of encode; checksums are verified."""
    heads, streams, stretches, filled = [], [], [], 0
    for b, raw in enumerate(payloads):
        magic, n, n_docs, n_words, marks, table_crc, ids_crc = HEADER.unpack_from(raw)
        if magic != MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        if table_crc != table.crc:
            raise ValueError("a block was written with another frequency table")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(raw, kind, count, at)
            at += part.nbytes
            return part

        ids, starts, here, none = take("<i8", n_docs), take("<i8", n_docs), take("<u4", n_docs), take("u1", n_docs)
        places, states = take("<u4", marks), take("<u8", marks * LANES).reshape(marks, LANES)
        streams.append(take("<u4", n_words))
        steps = -(-n // LANES)
        stretches += [(min(CHECKPOINT, steps - k * CHECKPOINT), b, k, filled + int(places[k]), states[k]) for k in range(marks)]
        filled += n_words
        heads.append((n, steps, ids_crc, [(None if z else int(i), int(s), int(h)) for i, s, h, z in zip(ids, starts, here, none)]))
    stretches.sort(key=lambda s: -s[0])
    lengths = np.array([s[0] for s in stretches], int)
    top = int(lengths[0]) if len(stretches) else 0
    x = np.array([s[4] for s in stretches], np.uint64).reshape(-1, LANES)
    place = np.array([s[3] for s in stretches], np.int64)
    stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
    got = np.zeros((top, len(stretches), LANES), np.uint32)
    active = np.searchsorted(-lengths, -np.arange(top), "left")
    for t in range(top):
        k = int(active[t])
        y = x[:k]
        slot = y & _SLOT
        s = table.slots[slot]
        got[t, :k] = s
        y = table.freq[s] * (y >> _BITS) + slot - table.cum[s]
        need = y < LOW
        upto = need.cumsum(1)
        word = stream[np.where(need, place[:k, None] + upto - 1, len(stream) - 1)]
        x[:k] = np.where(need, (y << _WORD) | word, y)
        place[:k] += upto[:, -1]
    whole = [np.zeros(steps * LANES, "<u4") for _, steps, _, _ in heads]
    for row, (length, b, k, _, _) in enumerate(stretches):
        whole[b][k * CHECKPOINT * LANES : (k * CHECKPOINT + length) * LANES] = got[:length, row].reshape(-1)
    out = []
    for flat, (n, _, ids_crc, docs) in zip(whole, heads):
        flat = flat[:n]
        if zlib.crc32(flat.tobytes()) != ids_crc:
            raise ValueError("the decoded ids do not match their checksum")
        out.append((flat, docs))
    return out
