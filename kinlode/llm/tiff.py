"""Media columns: TIFF.

read_pages() walks the chain of image directories, decodes strips or tiles stored plain, as PackBits, LZW or deflate,
undoes predictors and yields a page for each directory. write_pages() is its inverse. tiff_pages() gives a row for each
page of a binary column, document_media() stores texts as images and reads them back.

Texts are stored in four ways, by their content: deflated, LZW or PackBits strips and deflated tiles, so that every
decoder is on the way back. Samples of 1, 2, 4, 8, 16, 32 and 64 bits are read, interleaved or in separate planes.

Defined results: a null, empty or broken file gives one row with page null and the error. A page that cannot be decoded
gives a row with its number and the error, and the walk goes on to the next directory. A null text is an empty payload of 64 zero bytes. Rows that repeat an id come out one by one. Empty tables
give empty results. Other columns are ignored.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlode.llm import common
from kinlode.llm import kernels as K

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 64, 4096, 1024, (64, 32)
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}


class TiffError(ValueError):
    pass


@dataclass
class Page:
    """samples: (height, width, samples of a pixel)."""

    samples: np.ndarray
    compression: int
    predictor: int
    tiled: bool


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    size = np.diff(np.append(edge, len(a)))
    out, done = bytearray(), 0

    def plain(end: int) -> None:
        for i in range(done, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for at, n in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        plain(at)
        done = at + n
        while n > 1:
            k = min(n, 128)
            out += bytes((257 - k, data[at]))
            n -= k
        done -= n  # one left over goes with what follows
    plain(len(data))
    return bytes(out)


_CLEAR, _END = 256, 257


def decode_lzw(data: bytes, size: int) -> bytes:
    """Most significant bit first; the code grows one code early, as TIFF has it."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, width, old = list(start), bytearray(), 9, b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == _CLEAR:
            table, width, old = list(start), 9, b""
            continue
        if code == _END or len(out) >= size:
            break
        if code < len(table):
            text = table[code]
        elif old and code == len(table):
            text = old + old[:1]
        else:
            raise TiffError("LZW code out of range")
        out += text
        if old:
            table.append(old + text[:1])
        old = text
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out[:size])


def encode_lzw(data: bytes) -> bytes:
    held, bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    fresh = {bytes([i]): i for i in range(256)}
    table, width, now, top = dict(fresh), 9, b"", 258
    put(_CLEAR, 9)
    for i in range(len(data)):
        more = now + data[i : i + 1]
        if more in table:
            now = more
            continue
        put(table[now], width)
        table[more] = top
        top += 1
        if top == 4094:
            put(_CLEAR, 12)
            table, width, top = dict(fresh), 9, 258
        else:
            width = 9 if top < 512 else 10 if top < 1024 else 11 if top < 2048 else 12
        now = data[i : i + 1]
    if now:
        put(table[now], width)
        top += 1
        width = 9 if top < 512 else 10 if top < 1024 else 11 if top < 2048 else 12
    put(_END, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data[:size]
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression == LZW:
        out = decode_lzw(data, size)
    else:
        raise TiffError(f"compression {compression} is not supported")
    if len(out) < size:
        raise TiffError(f"a block holds {len(out)} of {size} bytes")
    return out


def _encode(data: bytes, compression: int, level: int) -> bytes:
    return {NONE: lambda: data, DEFLATE: lambda: zlib.compress(data, level), PACKBITS: lambda: pack_bits(data), LZW: lambda: encode_lzw(data)}[compression]()


def _undo(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: (rows, width, samples) of the stored kind."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    rows, width, samples = block.shape
    size = block.dtype.itemsize
    flat = np.frombuffer(block.tobytes(), np.uint8).reshape(rows, width * samples * size)
    parts = np.cumsum(flat.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
    return np.ascontiguousarray(parts.transpose(0, 2, 1)).view(f">f{size}").reshape(block.shape).astype(f"=f{size}")


def _predict(block: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return block
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


class _Reader:
    def __init__(self, data: bytes):
        if len(data) < 8 or data[:2] not in (b"II", b"MM"):
            raise TiffError("no TIFF header")
        self.data, self.order = data, "<" if data[:2] == b"II" else ">"
        magic = self.get("H", 2)[0]
        if magic not in (42, 43):
            raise TiffError("no TIFF header")
        self.big = magic == 43
        self.first = self.get("Q", 8)[0] if self.big else self.get("I", 4)[0]

    def get(self, kind: str, at: int) -> tuple:
        kind = self.order + kind
        if at < 0 or at + struct.calcsize(kind) > len(self.data):
            raise TiffError("an offset lies outside the file")
        return struct.unpack_from(kind, self.data, at)

    def directories(self) -> Iterator[dict[int, tuple]]:
        at, seen = self.first, set()
        count, step, room, word = ("Q", 20, 8, "Q") if self.big else ("H", 12, 4, "I")
        while at:
            if at in seen:
                raise TiffError("the directories form a ring")
            seen.add(at)
            n = self.get(count, at)[0]
            at += struct.calcsize("=" + count)
            tags = {}
            for i in range(n):
                here = at + i * step
                tag, kind, size = self.get("HH" + word, here)
                code = _TYPES.get(kind)
                if code is None:
                    continue
                full = struct.calcsize("=" + code) * size
                place = here + step - room
                if full > room:
                    place = self.get(word, place)[0]
                if full > len(self.data):
                    raise TiffError("a tag is longer than the file")
                tags[tag] = self.get(f"{size}{code}" if len(code) == 1 else code * size, place)
            yield tags
            at = self.get(word, at + n * step)[0]

    def page(self, tags: dict[int, tuple]) -> Page:
        one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
        width, height = one(256), one(257)
        if not width or not height:
            raise TiffError("a page has no size")
        bits, samples, compression, predictor = one(258, 1), one(277, 1), one(259, 1), one(317, 1)
        sort = {1: "u", 2: "i", 3: "f"}.get(one(339, 1))
        small = bits in (1, 2, 4) and sort == "u" and predictor == 1
        if not small and bits not in (8, 16, 32, 64) or sort is None or len(set(tags.get(258, (bits,)))) > 1 or predictor not in (1, 2, 3):
            raise TiffError(f"{bits} bits of kind {one(339, 1)} with predictor {predictor} are not supported")
        planes = samples if one(284, 1) == 2 else 1
        samples //= planes
        tiled = 322 in tags
        bw, bh = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
        if not bw or not bh:
            raise TiffError("a page has empty blocks")
        offsets, sizes = tags.get(324 if tiled else 273, ()), tags.get(325 if tiled else 279, ())
        across, down = -(-width // bw), -(-height // bh)
        if len(offsets) != planes * across * down or len(sizes) != len(offsets):
            raise TiffError("a page's blocks do not cover it")
        kind = np.dtype(f"{self.order if predictor != 3 else '='}{sort}{max(8, bits) // 8}")
        if width * height * samples * planes * kind.itemsize > 1 << 31:
            raise TiffError("a page is larger than 2 GB")
        out = np.empty((height, width, samples * planes), dtype=kind.newbyteorder("="))
        for i, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
            plane, i = divmod(i, across * down)
            y, x = i // across * bh, i % across * bw
            rows = bh if tiled else min(bh, height - y)
            if at + size > len(self.data):
                raise TiffError("a block lies outside the file")
            line = -(-bw * samples * bits // 8)
            raw = _decode(self.data[at : at + size], compression, rows * line)
            if small:
                block = unpack_samples(raw, rows, line, bits)[:, : bw * samples].reshape(rows, bw, samples)
            else:
                block = np.frombuffer(raw, kind).reshape(rows, bw, samples)
                block = _undo(block.astype(kind.newbyteorder("=")) if predictor == 2 else block, predictor, self.order)
            out[y : y + bh, x : x + bw, plane * samples : (plane + 1) * samples] = block[: height - y, : width - x]
        return Page(out, compression, predictor, tiled)


def unpack_samples(raw: bytes, rows: int, line: int, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, high bits first; each row begins at a byte."""
    each = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(rows, line * 8 // bits, bits)
    return (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def walk_pages(data: bytes) -> Iterator[Page | TiffError]:
    """A page for each directory, or what is wrong with it; raises where the chain of directories itself is broken."""
    reader = _Reader(data)
    for tags in reader.directories():
        try:
            yield reader.page(tags)
        except (TiffError, zlib.error, MemoryError, ValueError, TypeError) as e:
            yield e if isinstance(e, TiffError) else TiffError(str(e))


def read_pages(data: bytes) -> Iterator[Page]:
    for page in walk_pages(data):
        if isinstance(page, TiffError):
            raise page
        yield page


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = STRIP_ROWS, level: int = 1, order: str = "<") -> bytes:
    """A TIFF of integer pages (height, width[, samples]); tile is (rows, columns), each a multiple of 16."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = page.shape
        bh, bw = tile or (min(strip_rows, height), width)
        offsets, sizes = [], []
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                block = page[y : y + bh, x : x + bw]
                if tile and block.shape[:2] != (bh, bw):
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                data = _encode(_predict(block, predictor).astype(page.dtype.newbyteorder(order)).tobytes(), compression, level)
                offsets.append(len(out))
                sizes.append(len(data))
                out += data
                out += b"\0" * (len(out) % 2)
        bits, sort = page.dtype.itemsize * 8, {"u": 1, "i": 2}[page.dtype.kind]
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * samples), (259, 3, [compression]), (262, 3, [1]), (277, 3, [samples]), (317, 3, [predictor]), (339, 3, [sort] * samples)]
        tags += [(322, 4, [bw]), (323, 4, [bh]), (324, 4, offsets), (325, 4, sizes)] if tile else [(273, 4, offsets), (278, 4, [bh]), (279, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            packed = struct.pack(order + ("H" if kind == 3 else "I") * len(values), *values)
            if len(packed) > 4:
                at = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(media: DataFrame, id_col: str = "media_id", content_col: str = "content") -> DataFrame:
    """(media_id, page, width, height, samples, bits, compression, predictor, tiled, content, error): a row for each page;
    content has the samples row by row, little-endian."""
    names = ["page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "content", "error"]
    kinds = [pa.int32()] * 5 + [pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]

    def pages(data: bytes | None) -> Iterator[tuple]:
        try:
            for i, p in enumerate(walk_pages(data or b"")):
                if isinstance(p, TiffError):
                    yield i, *[None] * 8, str(p)
                    continue
                h, w, s = p.samples.shape
                yield i, w, h, s, p.samples.dtype.itemsize * 8, NAMES[p.compression], p.predictor, p.tiled, p.samples.astype(p.samples.dtype.newbyteorder("<")).tobytes(), None
        except (TiffError, struct.error, MemoryError) as e:
            yield *[None] * 9, str(e)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = list(pages(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), type=batch.column(0).type), *(pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["media_id", *names])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col), F.col(content_col)).mapInArrow(scan, f"media_id {kind}, page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, content binary, error string")


def payload_of(raw: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of the width."""
    return raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def way_of(payload: bytes) -> dict:
    """How a payload is stored: one in sixteen as LZW, one in eight as PackBits, one in eight in tiles, the rest as deflated
    strips; pages are so small that LZW, byte by byte in Python, is no burden on any of them."""
    share = zlib.crc32(payload) >> 28
    if share == 0:
        return {"compression": LZW, "predictor": 2}
    if share in (1, 2):
        return {"compression": PACKBITS}
    return {"compression": DEFLATE, "predictor": 2, "tile": TILE if share in (3, 4) else None}


def store(payload: bytes) -> bytes:
    """The payload as 8-bit rows of WIDTH samples, on pages of PAGE_ROWS rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return write_pages([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], **way_of(payload))


def feature(pages: int, samples: np.ndarray) -> str:
    """Pages, rows, mean, entropy in bits, and the histogram over 16 classes as hex digits of its square root scale."""
    n = np.bincount(samples, minlength=256)
    share = n[n > 0] / len(samples)
    coarse = n.reshape(16, 16).sum(axis=1) / len(samples)
    return f"p{pages}:r{len(samples) // WIDTH}:m{samples.mean():.3f}:e{max(0.0, -(share * np.log2(share)).sum()):.4f}:h{''.join(f'{int(x):x}' for x in np.sqrt(coarse) * 15)}"


def document_media(docs: DataFrame, media: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, media]): texts stored
    as TIFF, all but n_bytes and the media columns from the samples read back."""

    def one(raw: bytes) -> tuple:
        stored = store(payload_of(raw))
        pages = list(read_pages(stored))
        back = b"".join(p.samples.tobytes() for p in pages)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(len(pages), np.frombuffer(back, np.uint8)), *[stored] * media

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * media]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raws in K.raw_slices(batch.column(1)):
                rows = zip(*map(one, raws), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *map(pa.array, rows)], names=["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), common.whole(text_col)).mapInArrow(scan, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * media)
