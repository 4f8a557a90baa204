"""SHA-256 of files that several tasks read: lines become pieces of bytes, and a hash goes on from a stored state."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = b"\xef\xbb\xbf"


class _Context(ctypes.Structure):
    """SHA256_CTX of openssl/sha.h."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint)]


@cache
def _library() -> ctypes.CDLL:
    """The library behind hashlib, whose own objects can't be stored."""
    try:
        import _hashlib

        found = ctypes.CDLL(_hashlib.__file__)
        found.SHA256_Init  # noqa: B018
    except (ImportError, AttributeError, OSError):
        found = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so")
    found.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    return found


class Sha256:
    """A hash whose state is bytes."""

    def __init__(self, state: bytes | None = None):
        self.library, self.context = _library(), _Context()
        if state is None:
            self.library.SHA256_Init(ctypes.byref(self.context))
        else:
            ctypes.memmove(ctypes.byref(self.context), state, ctypes.sizeof(self.context))

    def update(self, data: bytes) -> None:
        self.library.SHA256_Update(ctypes.byref(self.context), data, len(data))

    def state(self) -> bytes:
        return bytes(self.context)

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.library.SHA256_Final(out, ctypes.byref(_Context.from_buffer_copy(self.context)))
        return out.raw.hex()


def joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uri, start, seq, bytes from uri, start (of a split of the file), line, in the order of the split; each line but a
    file's first begins with its line feed."""
    split, seq = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        uri, start, line = batch.column("uri"), batch.column("start").to_numpy(), batch.column("line")
        cuts = np.flatnonzero((start[1:] != start[:-1]) | pc.not_equal(uri[1:], uri[:-1]).to_numpy(zero_copy_only=False)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(start)]):
            own = (uri[low].as_py(), int(start[low]))
            split, seq = own, seq + 1 if own == split else 0
            data = b"\n".join(line[low:high].to_pylist())
            yield _row(uri=own[0], start=own[1], seq=seq, bytes=data if seq == own[1] == 0 else b"\n" + data)


def hashed_further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of files (uri, start -1, seq: bytes that lines leave out, bytes: the state or null) after their pieces,
    which follow in order."""
    uri, left, digest = None, 0, None
    for batch in batches:
        for k in range(batch.num_rows):
            start, data = batch.column("start")[k].as_py(), batch.column("bytes")[k].as_py()
            if start >= 0:
                digest.update(data)
                continue
            if digest:
                yield _row(uri=uri, start=-1, seq=left, bytes=digest.state())
            uri, left, digest = batch.column("uri")[k].as_py(), batch.column("seq")[k].as_py(), Sha256(data)
            # a reader of lines leaves a byte order mark at the beginning out
            if data is None and left >= len(MARK):
                digest.update(MARK)
    if digest:
        yield _row(uri=uri, start=-1, seq=left, bytes=digest.state())


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uri, sha256 of the last states."""
    for batch in batches:
        for row in batch.to_pylist():
            if row["seq"] not in (0, 1, len(MARK), len(MARK) + 1):
                raise ValueError(f"{row['uri']} changed while it was read")
            digest = Sha256(row["bytes"])
            digest.update(b"\n" if row["seq"] in (1, len(MARK) + 1) else b"")
            yield _row(uri=row["uri"], sha256=digest.hexdigest())


def _row(**values) -> pa.RecordBatch:
    kinds = {"uri": pa.string(), "start": pa.int64(), "seq": pa.int64(), "bytes": pa.binary(), "sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[c]) for c, v in values.items()], names=list(values))
