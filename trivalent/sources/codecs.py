"""Byte and text forms of graphs: planar_code records and graph6 lines.

Small helpers for one record, used inside Arrow batches by the readers in this package.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

HEADER = b">>planar_code<<"


CHUNK = 1 << 20


def decode_planar(stream: BinaryIO, require_header: bool = False, chunk: int = CHUNK) -> Iterator[list[list[int]]]:
    """Rotation systems of a planar_code stream, vertices from 0; holds a chunk and a record at a time.

    One byte a value. Raises on a missing but required header, an order of 0, a neighbour out of range
    and a cut record.
    """
    held, at, ended = b"", 0, False

    def more() -> bool:
        nonlocal held, at, ended
        got = stream.read(chunk)
        held, at, ended = held[at:] + got, 0, not got
        return not ended

    while len(held) < len(HEADER) and more():
        pass
    if held.startswith(HEADER):
        at = len(HEADER)
    elif require_header:
        raise ValueError("planar_code header is missing")
    while at < len(held) or more():
        order = held[at]
        if not order:
            raise ValueError("planar_code record without vertices")
        rows: list[list[int]] = []
        pos = at + 1
        while len(rows) < order:
            end = held.find(0, pos)
            if end < 0:
                pos -= at  # the record moves to the front of what is held
                if not more():
                    raise ValueError("planar_code record is cut off")
                continue
            if max(held[pos:end], default=0) > order:
                raise ValueError(f"neighbour beyond {order} vertices")
            rows.append([w - 1 for w in held[pos:end]])
            pos = end + 1
        yield rows
        at = pos


def encode_planar(rotation: list[list[int]], header: bool = False) -> bytes:
    """One-byte planar_code of a rotation system of at most 255 vertices."""
    if not 0 < len(rotation) <= 255:
        raise ValueError("planar_code holds 1 to 255 vertices")
    body = bytes([len(rotation)]) + b"".join(bytes(w + 1 for w in row) + b"\0" for row in rotation)
    return (HEADER if header else b"") + body


def decode_graph6(line: str) -> tuple[int, list[tuple[int, int]]]:
    """(order, edges) of one graph6 line; an optional ``>>graph6<<`` is passed over."""
    text = line.strip().removeprefix(">>graph6<<")
    if not text or any(not 63 <= ord(c) <= 126 for c in text):
        raise ValueError("not a graph6 line")
    vals = [ord(c) - 63 for c in text]
    head = 1 if vals[0] < 63 else 4 if vals[1:2] != [63] else 8
    n = vals[0] if head == 1 else sum(v << 6 * k for k, v in enumerate(reversed(vals[{4: 1, 8: 2}[head] : head])))
    need = n * (n - 1) // 2
    body = vals[head:]
    if len(body) != -(-need // 6):
        raise ValueError("graph6 line of the wrong length")
    bits = [(v >> s) & 1 for v in body for s in (5, 4, 3, 2, 1, 0)]
    return n, [(u, v) for k, (u, v) in enumerate((u, v) for v in range(1, n) for u in range(v)) if bits[k]]


def encode_graph6(order: int, edges: list[tuple[int, int]]) -> str:
    """graph6 line of a simple graph of at most 62 vertices (63 to 258047 with the long head)."""
    have = {(min(e), max(e)) for e in edges}
    bits = [int((u, v) in have) for v in range(1, order) for u in range(v)]
    bits += [0] * (-len(bits) % 6)
    head = [order] if order < 63 else [63, *[(order >> s) & 63 for s in (12, 6, 0)]]
    return "".join(chr(63 + v) for v in head + [sum(b << (5 - k) for k, b in enumerate(bits[i : i + 6])) for i in range(0, len(bits), 6)])
