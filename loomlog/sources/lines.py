"""The records of one log with their places in it; plain or zstd, whole lines only."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of a record that are kept.
MOST_BYTES = 16 << 20
CHUNK = 1 << 20


class Undecodable(OSError):
    """The compressed bytes break off or are damaged; what came before was given."""


def opened(path: str):
    return pa.input_stream(path, compression="zstd" if path.endswith(".zst") else None, buffer_size=CHUNK)


def records(path: str, start: int = 0, most_lines: int | None = None, first_line: int = 1) -> Iterator[tuple[int, int, int, bytes, bool]]:
    """(line, byte_start, byte_len, bytes, oversized) of each finished line from byte ``start`` on.

    The line break belongs to the record. A last line without one is held back. Of a record above
    ``MOST_BYTES`` only the beginning is kept. Places are those in the decompressed log.
    """
    with opened(path) as f:
        skipped = 0
        if start and not path.endswith(".zst"):
            f = pa.PythonFile(open(path, "rb"), mode="r")  # noqa: SIM115
            f.seek(start)
            skipped = start
        while skipped < start:  # compressed logs are read from their beginning
            part = _read(f, min(CHUNK, start - skipped))
            if not part:
                return
            skipped += len(part)
        at, line, held, size = start, first_line, bytearray(), 0
        while part := _read(f, CHUNK):
            pos = 0
            while (end := part.find(b"\n", pos)) >= 0:
                piece = part[pos : end + 1]
                held += piece[: max(0, MOST_BYTES - len(held))]
                size += len(piece)
                yield line, at, size, bytes(held), size > MOST_BYTES
                at, line, held, size, pos = at + size, line + 1, bytearray(), 0, end + 1
                if most_lines is not None and line - first_line >= most_lines:
                    return
            piece = part[pos:]
            held += piece[: max(0, MOST_BYTES - len(held))]
            size += len(piece)


def _read(f, n: int) -> bytes:
    try:
        return f.read(n)
    except (OSError, pa.ArrowInvalid) as e:
        raise Undecodable(str(e)) from e


def read_range(path: str, start: int, length: int, most: int = 4 << 20) -> bytes:
    """Original bytes of a log, checked against its bounds."""
    if start < 0 or length < 0 or length > most:
        raise ValueError(f"a range has to begin at 0 or later and hold at most {most} bytes")
    out, at = bytearray(), 0
    with opened(path) as f:
        if not path.endswith(".zst"):
            f = pa.PythonFile(open(path, "rb"), mode="r")  # noqa: SIM115
            f.seek(start)
            at = start
        while at < start and (part := _read(f, min(CHUNK, start - at))):
            at += len(part)
        while len(out) < length and (part := _read(f, length - len(out))):
            out += part
    if len(out) < length:
        raise ValueError("the range ends beyond the log")
    return bytes(out)


def read_ranges(places: Iterable[tuple[str, int, int]]) -> Iterator[bytes | None]:
    """The bytes at (path, start, length) for places in order; a log is opened once, None where it ends before or can't be read."""
    for path, group in itertools.groupby(places, key=lambda x: x[0]):
        group = list(group)
        done = 0
        try:
            with opened(path) if path.endswith(".zst") else open(path, "rb") as f:
                at = 0
                for _, start, length in group:
                    if not path.endswith(".zst"):
                        f.seek(start)
                        at = start
                    while at < start and (part := _read(f, min(CHUNK, start - at))):
                        at += len(part)
                    out = bytearray()
                    while at == start + len(out) and len(out) < length and (part := _read(f, length - len(out))):
                        out += part
                        at += len(part)
                    done += 1
                    yield bytes(out) if len(out) == length else None
        except OSError:
            yield from [None] * (len(group) - done)


def aligned(path: str, byte: int) -> int:
    """The first place from ``byte`` on at which a line of a plain log begins; 0 if none does within ``CHUNK``."""
    if byte <= 0:
        return 0
    with open(path, "rb") as f:
        f.seek(byte - 1)
        end = f.read(CHUNK).find(b"\n")
    return byte + end if end >= 0 else 0
