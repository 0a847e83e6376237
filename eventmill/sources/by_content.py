"""Lines of files named `.gz` of which some are plain text: the first bytes of a file decide, not its name."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa

# Leaves `.gz` files as they are, so that the reader hands out their bytes in pieces between line breaks. The client jar
# that comes with Spark has the name of the second option under another package.
RAW_GZIP = {
    "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
    "io.compress.passthrough.extension": ".gz",
    "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".gz",
    "lineSep": "\n",
}
SCHEMA = "value string, file string"
#: Decompressed bytes taken at a time, whatever a piece unpacks to.
AT_ONCE = 1 << 20

_BREAK = re.compile(rb"\r\n|\r|\n")
_GZIP = b"\x1f\x8b"


class FileLines:
    """Pieces of one file in order to its lines; a line is held until its end has come, and nothing else."""

    def __init__(self, name: str):
        self.name, self.begun, self.rest = name, b"", b""
        self.unpack: zlib._Decompress | None = None
        self.plain = not name.endswith(".gz")

    def _lines(self, data: bytes) -> list[bytes]:
        data = self.rest + data
        # a line break may go on in the next piece
        held = data[-1:] if data.endswith(b"\r") else b""
        *lines, last = _BREAK.split(data[: len(data) - len(held)])
        self.rest = last + held
        return lines

    def _unpacked(self, data: bytes) -> Iterator[bytes]:
        while data:
            if self.unpack is None:
                # between the members of a file, and behind the last one, there may be padding
                data = data.lstrip(b"\0\n")
                if not data:
                    return
                self.unpack = zlib.decompressobj(31)
            try:
                yield self.unpack.decompress(data, AT_ONCE)
            except zlib.error as error:
                raise ValueError(f"broken gzip file {self.name}: {error}") from error
            if self.unpack.eof:
                data, self.unpack = self.unpack.unused_data, None
            else:
                data = self.unpack.unconsumed_tail

    def feed(self, data: bytes) -> Iterator[list[bytes]]:
        if not self.plain and self.unpack is None and len(self.begun) < 2:
            self.begun += data
            if len(self.begun) < 2:
                return
            self.plain, data = not self.begun.startswith(_GZIP), self.begun
            self.begun = self.begun[:2]
        if self.plain:
            yield self._lines(data)
        else:
            for part in self._unpacked(data):
                yield self._lines(part)

    def finish(self) -> list[bytes]:
        """The last line, if no break ends it."""
        if len(self.begun) == 1:
            self.rest = self.begun
        if self.unpack is not None and not self.unpack.eof:
            raise ValueError(f"gzip file {self.name} is cut off")
        last, self.rest = self.rest, b""
        return [last.removesuffix(b"\r")] if last else []


def _batch(lines: list[bytes], name: str) -> pa.RecordBatch:
    values = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
    return pa.RecordBatch.from_arrays([values, pa.array([name] * len(lines), pa.string())], names=["value", "file"])


def lines_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For `mapInArrow` over `raw, file, start`: the pieces of a file come one after another, as its task reads them."""
    now: FileLines | None = None
    part = None
    for batch in batches:
        raw, files, starts = (batch.column(n) for n in ("raw", "file", "start"))
        names, begins = files.to_pylist(), starts.to_pylist()
        at = 0
        while at < len(names):
            key, to = (names[at], begins[at]), at + 1
            while to < len(names) and (names[to], begins[to]) == key:
                to += 1
            if key != part:
                if now is not None and (last := now.finish()):
                    yield _batch(last, now.name)
                now, part = FileLines(key[0]), key
            # the reader took the breaks away; one behind the last line of a file changes nothing
            for lines in now.feed(b"\n".join(raw[at:to].to_pylist()) + b"\n"):
                if lines:
                    yield _batch(lines, now.name)
            at = to
    if now is not None and (last := now.finish()):
        yield _batch(last, now.name)
