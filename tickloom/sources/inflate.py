"""Restart points of a deflated zip member, so that many tasks can read one.

A deflate stream can be entered where one of its blocks begins, given the 32 KB of output before it. zlib says where blocks
begin and takes such a start, but Python's module doesn't pass that on, so the C library is called. Without the library
there are no points and members are read from their start.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

WINDOW, CHUNK = 1 << 15, 1 << 20
#: Fixed values of the C library: stop at a block's end, end of stream, nothing to do, raw stream.
_Z_BLOCK, _Z_END, _Z_BUF, _RAW = 5, 1, -5, -15


class _Stream(ctypes.Structure):
    _fields_ = [(n, t) for n, t in (("next_in", ctypes.c_void_p), ("avail_in", ctypes.c_uint), ("total_in", ctypes.c_ulong), ("next_out", ctypes.c_void_p), ("avail_out", ctypes.c_uint), ("total_out", ctypes.c_ulong), ("msg", ctypes.c_char_p), ("state", ctypes.c_void_p), ("zalloc", ctypes.c_void_p), ("zfree", ctypes.c_void_p), ("opaque", ctypes.c_void_p), ("data_type", ctypes.c_int), ("adler", ctypes.c_ulong), ("reserved", ctypes.c_ulong))]


def library() -> ctypes.CDLL | None:
    try:
        z = ctypes.CDLL(ctypes.util.find_library("z") or "libz.so.1")
    except OSError:
        return None
    z.zlibVersion.restype = ctypes.c_char_p
    return z


@dataclass(frozen=True)
class Point:
    """A place in a member: bytes into its data, bits of the byte before that still count, bytes of text before, the
    number of the first line that begins here or later, and the text's last bytes before."""

    offset: int = 0
    bits: int = 0
    out: int = 0
    row: int = 0
    window: bytes = b""


class _Inflate:
    """Inflates from a point; `block` is whether the last piece ended where a block does, `done` that the stream ended."""

    def __init__(self, point: Point, before: int):
        self.z = library()
        if self.z is None:
            raise OSError("zlib's C library isn't there")
        self.s, self.block, self.done, self.out = _Stream(), False, False, ctypes.create_string_buffer(CHUNK)
        self._ok(self.z.inflateInit2_(ctypes.byref(self.s), _RAW, self.z.zlibVersion(), ctypes.sizeof(self.s)))
        if point.bits:
            self._ok(self.z.inflatePrime(ctypes.byref(self.s), point.bits, before >> (8 - point.bits)))
        if point.window:
            self._ok(self.z.inflateSetDictionary(ctypes.byref(self.s), point.window, len(point.window)))

    def _ok(self, code: int) -> int:
        if code not in (0, _Z_END, _Z_BUF):
            raise zipfile.BadZipFile(f"zlib error {code}")
        return code

    def pieces(self, data: bytes, stop: int) -> Iterator[bytes]:
        """The text of the next bytes; stop is _Z_BLOCK to be given a piece at each block's end, or 0. used: bytes taken so far."""
        held = ctypes.create_string_buffer(data, len(data))
        self.s.next_in, self.s.avail_in = ctypes.addressof(held), len(data)
        while not self.done:
            self.s.next_out, self.s.avail_out = ctypes.addressof(self.out), CHUNK
            code = self._ok(self.z.inflate(ctypes.byref(self.s), stop))
            self.done, self.block, self.used = code == _Z_END, bool(self.s.data_type & 128), len(data) - self.s.avail_in
            text = self.out.raw[: CHUNK - self.s.avail_out] if self.s.avail_out < CHUNK else b""
            yield text
            if not self.s.avail_in and self.s.avail_out and not (stop and self.block):
                return
            if code == _Z_BUF:
                return

    def close(self) -> None:
        self.z.inflateEnd(ctypes.byref(self.s))


def data_start(f: BinaryIO, info: zipfile.ZipInfo) -> int:
    """Where a member's data begin in the file: after its own header, whose name and extra field have their own lengths."""
    f.seek(info.header_offset)
    head = f.read(30)
    return info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")


def _raw(f: BinaryIO, at: int, size: int) -> Iterator[bytes]:
    f.seek(at)
    while size > 0 and (data := f.read(min(CHUNK, size))):
        size -= len(data)
        yield data


def text_from(f: BinaryIO, info: zipfile.ZipInfo, point: Point) -> Iterator[bytes]:
    """The member's text from a point to its end."""
    start = data_start(f, info)
    if info.compress_type == zipfile.ZIP_STORED:
        yield from _raw(f, start + point.out, info.file_size - point.out)
        return
    before = 0
    if point.bits:
        f.seek(start + point.offset - 1)
        before = f.read(1)[0]
    z = _Inflate(point, before)
    try:
        for data in _raw(f, start + point.offset, info.compress_size - point.offset):
            yield from (p for p in z.pieces(data, 0) if p)
    finally:
        z.close()


def points(f: BinaryIO, info: zipfile.ZipInfo, span: int) -> tuple[list[Point], int]:
    """Points about every so many bytes of text (the first is the start), and the number of lines. The text passes once."""
    found, lines, out, window = [Point()], 0, 0, b""

    def seen(piece: bytes) -> None:
        nonlocal lines, out, window
        if piece:
            lines, out = lines + int(np.count_nonzero(np.frombuffer(piece, np.uint8) == 10)), out + len(piece)
            window = (window + piece)[-WINDOW:]

    def place(offset: int, bits: int) -> None:
        # a line that began before goes on here; the next one has the next number
        found.append(Point(offset, bits, out, lines + (window[-1:] != b"\n"), window))

    if info.compress_type == zipfile.ZIP_STORED:
        for data in _raw(f, data_start(f, info), info.file_size):
            if out - found[-1].out >= span:
                place(out, 0)
            seen(data)
    else:
        z, at = _Inflate(Point(), 0), 0
        try:
            for data in _raw(f, data_start(f, info), info.compress_size):
                for piece in z.pieces(data, _Z_BLOCK):
                    seen(piece)
                    if z.block and not z.done and not z.s.data_type & 64 and out - found[-1].out >= span:
                        place(at + z.used, z.s.data_type & 7)
                at += len(data)
        finally:
            z.close()
    return found, lines + (out > 0 and window[-1:] != b"\n")
