"""TIFF media columns: texts stored as 8-bit grey images, and directories walked back to one row a page.

The reader takes classic little- or big-endian files with strips or tiles of 8-bit samples (one or more a pixel,
interleaved), stored plainly or by PackBits, LZW or deflate, with or without horizontal differencing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_chunks

#: Fixed values of the format: compression codes.
PLAIN, LZW, ADOBE_DEFLATE, PACK_BITS, DEFLATE = 1, 5, 8, 32773, 32946
#: Fixed values of the format: tags.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 322, 323, 324, 325
#: Fixed values of the format: bytes and struct codes of the field types of whole numbers.
KINDS = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
LINE, PAGE_ROWS = 64, 4096
#: Most bytes that one stored byte stands for: a run of 128 in two bytes; the longest string of a full table in 12 bits;
#: 258 bytes in two bits.
MOST_OUT = {PLAIN: 1, PACK_BITS: 64, LZW: 2560, ADOBE_DEFLATE: 1032, DEFLATE: 1032}


class Page(NamedTuple):
    width: int
    height: int
    compression: int
    predictor: int
    samples: bytes


def pack_bits(data: bytes) -> bytes:
    """Runs of three equal bytes or more as runs, all else as literals."""
    raw, out, done = np.frombuffer(data, np.uint8), bytearray(), 0

    def literals(end: int) -> None:
        for i in range(done, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    edges = np.concatenate(([0], np.flatnonzero(raw[1:] != raw[:-1]) + 1, [len(raw)]))
    long = np.flatnonzero(np.diff(edges) > 2)
    for start, end in zip(edges[long].tolist(), edges[long + 1].tolist()):
        literals(start)
        while end - start > 1:
            run = min(128, end - start)
            out += bytes((257 - run, data[start]))
            start += run
        done = start  # a single byte that is left belongs to the literals
    literals(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends."""
    codes, widths = [], []
    table, width, nxt, own = {}, 9, 258, data[0] if data else None
    for byte in data[1:]:
        pair = own << 8 | byte
        if pair in table:
            own = table[pair]
            continue
        codes.append(own)
        widths.append(width)
        table[pair] = nxt
        nxt += 1
        own = byte
        if nxt == (1 << width) and width < 12:
            width += 1
        elif nxt == 4094:
            codes.append(256)
            widths.append(width)
            table, width, nxt = {}, 9, 258
    if own is not None:
        codes.append(own)
        widths.append(width)
        if nxt + 1 == (1 << width) and width < 12:
            width += 1
    places = np.arange(11, -1, -1)
    bits = np.array([*codes, 257])[:, None] >> places & 1
    return np.packbits(bits[places < np.array([*widths, width])[:, None]].astype(np.uint8)).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    start = [bytes((b,)) for b in range(256)] + [b"", b""]
    table, width, acc, held, out, before = list(start), 9, 0, 0, bytearray(), b""
    for byte in data:
        acc = acc << 8 | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, before = list(start), 9, b""
            continue
        if not before:
            before = table[code]
            out += before
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            table.append(before + entry[:1])
            before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out[:size])


def shrink(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
    raw = block.tobytes()
    if compression in (DEFLATE, ADOBE_DEFLATE):
        return zlib.compress(raw, 1)
    return {PLAIN: bytes, PACK_BITS: pack_bits, LZW: lzw}[compression](raw)


def restore(raw: bytes, rows: int, columns: int, samples: int, compression: int, predictor: int) -> np.ndarray:
    size = rows * columns * samples
    if compression in (DEFLATE, ADOBE_DEFLATE):
        raw = zlib.decompressobj().decompress(raw, max(size, 1))
    elif compression == LZW:
        raw = unlzw(raw, size)
    elif compression == PACK_BITS:
        raw = unpack_bits(raw, size)
    elif compression != PLAIN:
        raise ValueError(f"compression {compression}")
    if len(raw) < size:
        raise ValueError("samples are missing")
    block = np.frombuffer(raw, np.uint8)[:size].reshape(rows, columns, samples)
    if predictor == 2:
        block = np.cumsum(block, axis=1, dtype=np.uint8)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor}")
    return block


def encode(pages: list[np.ndarray], compression: int, predictor: int = 1, strip_rows: int = 256, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file with a directory for each of pages (matrices of 8-bit samples)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape
        blocks = []
        if tile:
            for top in range(0, height, tile[0]):
                for left in range(0, width, tile[1]):
                    part = page[top : top + tile[0], left : left + tile[1]]
                    blocks.append(np.pad(part, ((0, tile[0] - part.shape[0]), (0, tile[1] - part.shape[1]))))
        else:
            blocks = [page[top : top + strip_rows] for top in range(0, height, strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            raw = shrink(block, compression, predictor)
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tile[1]], TILE_HEIGHT: [tile[0]], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [strip_rows], STRIP_COUNTS: counts}
        entries = b""
        for tag, values in sorted(fields.items()):
            raw = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                where, raw = len(out), out.extend(raw) or b""
                raw = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, 4, len(values)) + raw
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def pages_of(media: bytes) -> Iterator[Page]:
    """Each directory's page. Raises ValueError on anything but the kinds of file named above, also on a loop of directories."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(media[:2]))
    if order is None or len(media) < 8 or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    at, seen = struct.unpack_from(order + "I", media, 4)[0], set()
    try:
        while at:
            if at in seen:
                raise ValueError("directories form a loop")
            seen.add(at)
            fields = {}
            n = struct.unpack_from(order + "H", media, at)[0]
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * i)
                if kind in KINDS:
                    size, code = KINDS[kind]
                    where = at + 10 + 12 * i
                    if size * count > 4:
                        where = struct.unpack_from(order + "I", media, where)[0]
                    fields[tag] = struct.unpack_from(f"{order}{count}{code}", media, where)
            yield _page(media, fields)
            at = struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]
    except (struct.error, KeyError, IndexError, zlib.error, MemoryError) as e:
        raise ValueError(f"damaged: {e}") from e


def _page(media: bytes, fields: dict[int, tuple[int, ...]]) -> Page:
    width, height = fields[WIDTH][0], fields[HEIGHT][0]
    samples, compression, predictor = (fields.get(t, (1,))[0] for t in (SAMPLES, COMPRESSION, PREDICTOR))
    if set(fields.get(BITS, (1,))) != {8}:
        raise ValueError("samples are not of 8 bits")
    if height * width * samples > MOST_OUT.get(compression, 1) * len(media) or 0 in (*fields.get(TILE_WIDTH, ()), *fields.get(TILE_HEIGHT, ()), *fields.get(ROWS_PER_STRIP, ())):
        raise ValueError("sizes that the file cannot hold")
    out = np.zeros((height, width, samples), np.uint8)
    if TILE_OFFSETS in fields:
        tall, wide = fields[TILE_HEIGHT][0], fields[TILE_WIDTH][0]
        across = -(-width // wide)
        for i, (where, count) in enumerate(zip(fields[TILE_OFFSETS], fields[TILE_COUNTS])):
            top, left = i // across * tall, i % across * wide
            block = restore(media[where : where + count], tall, wide, samples, compression, predictor)
            out[top : top + tall, left : left + wide] = block[: height - top, : width - left]
    else:
        rows = min(fields.get(ROWS_PER_STRIP, (height,))[0], height)
        for i, (where, count) in enumerate(zip(fields[STRIP_OFFSETS], fields[STRIP_COUNTS])):
            top = i * rows
            out[top : top + rows] = restore(media[where : where + count], min(rows, height - top), width, samples, compression, predictor)
    return Page(width, height, compression, predictor, out.tobytes())


#: Ways to store a payload: compression, predictor, tile.
WAYS = [(c, p, t) for c in (LZW, PACK_BITS, ADOBE_DEFLATE) for p in (1, 2) for t in (None, (64, 64))]


def stored(payload: bytes) -> bytes:
    """A file of pages LINE samples wide and PAGE_ROWS high at most. A hash of the payload picks one of WAYS, whatever its size."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    compression, predictor, tile = WAYS[zlib.crc32(payload) % len(WAYS)]
    return encode([lines[i : i + PAGE_ROWS] for i in range(0, len(lines), PAGE_ROWS)], compression, predictor, tile=tile)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text (null: empty), padded with zero bytes to a positive multiple of LINE, as a TIFF file.

    docs: doc_id, text; more columns are ignored; repeated rows and null ids give a row each.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        media = [stored(r + b"\0" * (-len(r) % LINE if r else LINE)) for r in raw]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_chunks(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, media binary")


def tiff_pages(media: DataFrame, keep: list[str]) -> DataFrame:
    """One row a page: the columns keep, page (from 0), last (of the file), width, height, compression, predictor, samples, error.

    media: keep and media (binary); more columns are ignored. A null or damaged file gives one row with page -1, the
    pages before the damage are kept, and error says why. Pages of a file follow each other in its partition.
    """
    kinds = dict(media.dtypes)
    names = [*keep, "page", "last", "width", "height", "compression", "predictor", "samples", "error"]

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                row, out = [], []
                for i, raw in enumerate(batch.column(len(keep)).to_pylist()):
                    own, error = [], None
                    try:
                        if raw is None:
                            raise ValueError("no file")
                        for page in pages_of(raw):
                            own.append(page)
                    except ValueError as e:
                        error = str(e)
                    found = [(k, False, *p, None) for k, p in enumerate(own)]
                    if error:
                        found.append((-1, False, None, None, None, None, None, error))
                    if found:
                        found[-1] = (found[-1][0], True, *found[-1][2:])
                    row += [i] * len(found)
                    out += found
                columns = list(zip(*out)) or [()] * 8
                kinds_out = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row, pa.int64())) for k in range(len(keep))), *(pa.array(c, t) for c, t in zip(columns, kinds_out))], [*(f"k{i}" for i in range(len(keep))), *names[len(keep) :]])

    from pyspark.sql import functions as F

    # kept columns go by their places, so that they may have any name
    held = [F.col("`" + c.replace("`", "``") + "`").alias(f"k{i}") for i, c in enumerate(keep)]
    schema = "".join(f"k{i} {kinds[c]}, " for i, c in enumerate(keep))
    return media.select(*held, "media").mapInArrow(run, f"{schema}page int, last boolean, width long, height long, compression int, predictor int, samples binary, error string").toDF(*names)


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each text's stored form.

    Pages are read back from the stored bytes and folded in their order, a page at a time.
    """
    from pyspark.sql import functions as F

    media = store_texts(docs).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = tiff_pages(media, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def fold(batches):
        digest, size, total, count, tail = hashlib.sha256(), 0, 0, 0, b""
        for batch in batches:
            row, out = [], []
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            samples, lasts, errors = columns["samples"], columns["last"].to_pylist(), columns["error"].to_pylist()
            widths, codes, predictors = (columns[c].to_pylist() for c in ("width", "compression", "predictor"))
            for i in range(batch.num_rows):
                if errors[i]:
                    raise ValueError(errors[i])
                own = samples[i].as_py()
                digest.update(own)
                size, count, total = size + len(own), count + 1, total + int(np.frombuffer(own, np.uint8).sum())
                tail = own[-LINE:]
                if lasts[i]:
                    out.append((size, digest.hexdigest(), zlib.crc32(tail), f"pages={count} width={widths[i]} compression={codes[i]} predictor={predictors[i]} mean={total / size:.4f}"))
                    row.append(i)
                    digest, size, total, count = hashlib.sha256(), 0, 0, 0
            at, found = pa.array(row, pa.int64()), list(zip(*out)) or [()] * 4
            take = {c: columns[c].take(at) for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256")}
            yield pa.RecordBatch.from_arrays([take["doc_id"], take["n_bytes"], pa.array(found[0], pa.int64()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64()), take["media_bytes"], take["media_sha256"], pa.array(found[3], pa.string())], names)

    return pages.mapInArrow(fold, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
