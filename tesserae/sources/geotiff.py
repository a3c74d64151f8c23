"""Raster files as tables: header rows, an index of chips, and chip rows.

Two ways in. The data source FORMAT lists files and reads byte ranges of them, wherever they lie (any file system that
pyarrow.fs opens by URI): a header scan reads a file's first pages, the chip index adds its tables of offsets, and
read_chips() reads just the ranges of the index's rows, in tasks of about TASK_BYTES, so that a file of any size is decoded
in many tasks. For contents that are in a table already (binaryFile), headers() and chips() decode whole files.

Whatever is wrong with a file, a row with a message tells; no file ends a job. Supported: classic and big TIFF in either byte
order, tiles or strips, no compression or Deflate, horizontal predictor, integer and float samples of 8 to 64 bits,
pixel-interleaved bands.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserae.functions import crs, spatial

HEADER_BYTES = 262_144
KEYS = "projected int, geographic int, method int, lat1 double, lat2 double, nat_lat double, nat_lon double, false_lat double, false_lon double, centre_lat double, centre_lon double, easting double, northing double, scale double, semi_major double, inv_flattening double"
#: Projection key numbers (GeoTIFF 1.0, section 6.2) by name.
KEY_NUMBERS = {
    3072: "projected", 2048: "geographic", 3075: "method", 3078: "lat1", 3079: "lat2", 3081: "nat_lat", 3080: "nat_lon", 3085: "false_lat", 3084: "false_lon", 3089: "centre_lat", 3088: "centre_lon",
    3082: "easting", 3083: "northing", 3086: "easting", 3087: "northing", 3092: "scale", 2057: "semi_major", 2059: "inv_flattening",
}
HEADER = f"uri string, width long, height long, band_count int, dtype string, tile_w int, tile_h int, gt struct<ox:double,pw:double,rr:double,oy:double,cr:double,ph:double>, keys struct<{KEYS.replace(' ', ':')}>, error string".replace(",:", ",")
CHIPS = "asset_id string, band int, chip_x int, chip_y int, w int, h int, pixels array<float>, error string"
LAYOUT = "order string, dtype string, codec int, predictor int, bands int, chip_w int, chip_h int, width long, height long"
INDEX = f"uri string, chip_x int, chip_y int, at long, n_bytes long, {LAYOUT}, error string"
FORMAT = "tesserae_raster"
#: Bytes of a page of a file's head, of what a decoding task reads, and of what one read takes at most.
PAGE, TASK_BYTES, READ_BYTES = 1 << 16, 64 << 20, 8 << 20
#: Files of one task of a header scan.
FILES = 64
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_KINDS = ("u8", "i8", "u16", "i16", "u32", "i32", "f32", "f64")


class Content:
    """A file's bytes at hand."""

    def __init__(self, data: bytes):
        self.data, self.size, self.taken = data, len(data), 0

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


class Ranges:
    """A file of which only the ranges that are asked for are read; small reads share pages."""

    def __init__(self, uri: str):
        system, path = pa.fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size, self.taken, self.pages = self.file.size(), 0, {}

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if n > PAGE:
            self.taken += n
            return self.file.read_at(n, at)
        out = b""
        for k in range(at // PAGE, (at + n - 1) // PAGE + 1 if n else 0):
            if k not in self.pages:
                self.pages[k] = self.file.read_at(min(PAGE, self.size - k * PAGE), k * PAGE)
                self.taken += len(self.pages[k])
            out += self.pages[k]
        return out[at % PAGE : at % PAGE + n]


class Header:
    """Tags of the first directory; values that do not fit an entry are read when they are asked for.

    limit: the directory and all values have to lie in so many first bytes.
    """

    def __init__(self, source, limit: int | None = None):
        source = Content(source) if isinstance(source, bytes | bytearray) else source
        self.source, self.limit = source, min(limit or source.size, source.size)
        start = source.read(0, 16)
        if start[:4] not in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
            raise ValueError("not a TIFF file")
        self.order = "<" if start[:2] == b"II" else ">"
        self.big = b"+" in start[:4]
        (at,) = struct.unpack_from(self.order + ("Q" if self.big else "I"), start, 8 if self.big else 4)
        head, entry, inline = (8, 20, 8) if self.big else (2, 12, 4)
        if at + head > self.limit:
            raise ValueError("the directory lies outside the header")
        (n,) = struct.unpack(self.order + ("Q" if self.big else "H"), source.read(at, head))
        if at + head + entry * n > self.limit:
            raise ValueError("the directory lies outside the header")
        listed = source.read(at + head, entry * n)
        self.entries: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(self.order + ("HHQ" if self.big else "HHI"), listed, entry * i)
            if kind in _SIZES:
                size = struct.calcsize("=" + _SIZES[kind]) * count
                value = listed[entry * (i + 1) - inline : entry * (i + 1)]
                where = None if size <= inline else struct.unpack(self.order + ("Q" if self.big else "I"), value)[0]
                self.entries[tag] = (kind, count, size, where, value)
        self.width, self.height = (self.tag(t) or (None,) for t in (256, 257))
        self.width, self.height = self.width[0], self.height[0]
        if not self.width or not self.height:
            raise ValueError("no image size")
        self.bands = self.tag(277, (1,))[0]
        bits, kind = self.tag(258, (8,))[0], self.tag(339, (1,))[0]
        self.dtype = {1: "u", 2: "i", 3: "f"}.get(kind, "?") + str(bits)
        if 322 in self.entries:
            self.chip, self.tables = (self.tag(322)[0], (self.tag(323) or (0,))[0]), (324, 325)
        else:
            self.chip, self.tables = (self.width, min(self.tag(278, (self.height,))[0], self.height)), (273, 279)

    def tag(self, number: int, default: tuple | None = None) -> tuple | None:
        if number not in self.entries:
            return default
        kind, count, size, where, value = self.entries[number]
        if where is not None and where + size > self.limit:
            return default
        data = value if where is None else self.source.read(where, size)
        if kind == 2:
            return (data[:size],)
        return struct.unpack_from(self.order + _SIZES[kind] * count if kind == 5 else f"{self.order}{count}{_SIZES[kind]}", data)

    def transform(self) -> tuple | None:
        m, tie, scale = self.tag(34264), self.tag(33922), self.tag(33550)
        if m:
            return m[3], m[0], m[1], m[7], m[4], m[5]
        if tie and scale:
            i, j, _, x, y = tie[:5]
            sx, sy = scale[:2]
            return x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy
        return None

    def keys(self) -> dict | None:
        k, doubles, out = self.tag(34735), self.tag(34736, ()), {}
        if not k:
            return None
        for i in range(4, len(k) - 3, 4):
            name, where, at = KEY_NUMBERS.get(k[i]), k[i + 1], k[i + 3]
            if name and name not in out:
                if where == 0:
                    out[name] = at
                elif where == 34736 and at < len(doubles):
                    out[name] = doubles[at]
        return out

    def layout(self) -> tuple:
        """What decoding a chip needs (see LAYOUT); raises for what is not supported."""
        if self.dtype not in _KINDS:
            raise ValueError(f"samples of kind {self.dtype} are not supported")
        if self.bands < 1 or min(self.chip) < 1:
            raise ValueError("no bands or empty chips")
        if self.tag(284, (1,))[0] == 2 and self.bands > 1:
            raise ValueError("bands in planes of their own are not supported")
        codec = self.tag(259, (1,))[0]
        if codec not in (1, 8, 32946):
            raise ValueError(f"compression {codec} is not supported")
        return self.order, self.dtype, codec, self.tag(317, (1,))[0], self.bands, *self.chip, self.width, self.height

    def index(self) -> list[tuple]:
        """(chip_x, chip_y, offset, bytes) of every chip."""
        across, down = math.ceil(self.width / self.chip[0]), math.ceil(self.height / self.chip[1])
        offsets, sizes = (self.tag(t) for t in self.tables)
        if offsets is None or sizes is None or min(len(offsets), len(sizes)) < across * down:
            raise ValueError("no offsets or sizes of the chips")
        return [(i % across, i // across, offsets[i], sizes[i]) for i in range(across * down)]


def decoded(raw: bytes, chip_x: int, chip_y: int, layout: tuple, nodata: float | None = None) -> np.ndarray:
    """Samples of one chip as (rows, columns, bands) of 32-bit floats, cut to the image."""
    order, dtype, codec, predictor, bands, w, h, width, height = layout
    if codec != 1:
        raw = zlib.decompress(raw)
    kind = np.dtype(f"{order}{dtype[0]}{int(dtype[1:]) // 8}")
    rows = min(h, len(raw) // (w * bands * kind.itemsize))
    if rows < min(h, height - chip_y * h):
        raise ValueError("the chip is shorter than its rows")
    out = np.frombuffer(raw, kind, rows * w * bands).reshape(rows, w, bands)
    if predictor == 2:
        out = np.add.accumulate(out.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    out = out.astype(np.float32)[: max(0, height - chip_y * h), : width - chip_x * w]
    return out if nodata is None else np.where(out == nodata, np.float32("nan"), out)


def _chip_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (uri, chip_x, chip_y, samples or None, error), one for each band, as an Arrow batch of CHIPS."""
    flat, listed = [], []
    for uri, x, y, got, error in rows:
        if got is None:
            listed.append((uri, None, x, y, None, None, None, error))
        else:
            for b in range(got.shape[2]):
                flat.append(np.ascontiguousarray(got[:, :, b]).ravel())
                listed.append((uri, b + 1, x, y, got.shape[1], got.shape[0], len(flat[-1]), None))
    sizes = [r[6] for r in listed]
    ends = np.cumsum([0, *(n or 0 for n in sizes)]).astype(np.int32)
    pixels = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(flat) if flat else np.zeros(0, np.float32)), mask=pa.array([n is None for n in sizes]))
    names = [c.strip().split(" ")[0] for c in CHIPS.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), None, pa.string())
    return pa.RecordBatch.from_arrays([pixels if k is None else pa.array([r[i] for r in listed], k) for i, k in enumerate(kinds)], names=names)


class _Files(InputPartition):
    def __init__(self, uris: list[str]):
        self.uris = uris


class RasterReader(DataSourceReader):
    """Files under a path, some per task; kind headers gives HEADER and the bytes read, kind index gives INDEX."""

    def __init__(self, options: dict):
        self.path, self.pattern, self.kind = options["path"], options.get("pathglobfilter", "*"), options.get("kind", "headers")

    def partitions(self):
        from fnmatch import fnmatch

        system, path = pa.fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(path)
        infos = [found] if found.is_file else system.get_file_info(pa.fs.FileSelector(path, recursive=True))
        head = self.path.split("://")[0] + "://" if "://" in self.path else ""
        uris = sorted(head + i.path if head else "file://" + i.path for i in infos if i.is_file and fnmatch(i.base_name, self.pattern))
        return [_Files(uris[k : k + FILES]) for k in range(0, len(uris), FILES)] or [_Files([])]

    def read(self, partition: _Files):
        for uri in partition.uris:
            yield from header_row(uri) if self.kind == "headers" else index_rows(uri)


class RasterSource(DataSource):
    """spark.read.format(FORMAT).option("kind", "headers" or "index").load(path)"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return HEADER + ", bytes_read long" if self.options.get("kind", "headers") == "headers" else INDEX

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))


def header_row(uri: str):
    source = None
    try:
        source = Ranges(uri)
        yield (*_header(uri, Header(source, HEADER_BYTES)), source.taken)
    except Exception as e:  # whatever is wrong with a file is told in its row
        yield (uri, *[None] * 8, str(e) or type(e).__name__, source.taken if source else 0)


def index_rows(uri: str):
    try:
        h = Header(Ranges(uri))
        layout = h.layout()
        yield from [(uri, *chip, *layout, None) for chip in h.index()]
    except Exception as e:
        yield (uri, *[None] * 13, str(e) or type(e).__name__)


def scan(spark: SparkSession, path: str, kind: str = "headers", pattern: str = "*") -> DataFrame:
    """Header rows, or the chip index, of the files under a path (an absolute path or a URI), by ranges of them."""
    spark.dataSource.register(RasterSource)
    return spark.read.format(FORMAT).option("kind", kind).option("pathGlobFilter", pattern).load(path)


def read_chips(index: DataFrame, nodata: float | None = None) -> DataFrame:
    """Chip rows (see CHIPS) of the rows of a chip index; ranges that lie next to each other are read at once."""
    total = index.agg(F.sum("n_bytes").alias("n")).first().n or 0
    tasks = max(1, -(-total // TASK_BYTES))

    def run(batches):
        source, held, size = None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["uri"] != held[-1]["uri"] or r["error"] or r["at"] != held[-1]["at"] + held[-1]["n_bytes"] or size + r["n_bytes"] > READ_BYTES):
                    source, rows = _read(source, held, nodata)
                    yield _chip_batch(rows)
                    held, size = [], 0
                if r["error"]:
                    yield _chip_batch([(r["uri"], r["chip_x"], r["chip_y"], None, r["error"])])
                else:
                    held.append(r)
                    size += r["n_bytes"]
        if held:
            yield _chip_batch(_read(source, held, nodata)[1])

    return index.repartitionByRange(tasks, "uri", "at").sortWithinPartitions("uri", "at").mapInArrow(run, CHIPS)


def _read(source, held: list[dict], nodata: float | None):
    """The open file (kept while its rows last) and the decoded chips of one range."""
    names = [f.strip().split(" ")[0] for f in LAYOUT.split(",")]
    uri, at = held[0]["uri"], held[0]["at"]
    try:
        source = source if source is not None and source[0] == uri else (uri, Ranges(uri))
        data = source[1].read(at, sum(r["n_bytes"] for r in held))
    except Exception as e:
        return None, [(uri, r["chip_x"], r["chip_y"], None, str(e)) for r in held]
    rows = []
    for r in held:
        try:
            got = decoded(data[r["at"] - at : r["at"] - at + r["n_bytes"]], r["chip_x"], r["chip_y"], tuple(r[n] for n in names), nodata)
            rows.append((uri, r["chip_x"], r["chip_y"], got, None))
        except Exception as e:
            rows.append((uri, r["chip_x"], r["chip_y"], None, str(e)))
    return source, rows


def encoded(samples: np.ndarray, tile: int = 256, gt: tuple | None = None, geographic: int | None = None) -> bytes:
    """A TIFF of (rows, columns, bands) samples: little-endian, in Deflate tiles; gt: x, y of the upper left corner and the
    sizes of a pixel; geographic: a system's code."""
    h, w, bands = samples.shape
    kind = {"u": 1, "i": 2, "f": 3}[samples.dtype.kind]
    body, offsets, sizes = bytearray(8), [], []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            part = np.zeros((tile, tile, bands), samples.dtype.newbyteorder("<"))
            cut = samples[y : y + tile, x : x + tile]
            part[: cut.shape[0], : cut.shape[1]] = cut
            data = zlib.compress(part.tobytes())
            offsets.append(len(body))
            sizes.append(len(data))
            body += data
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [samples.dtype.itemsize * 8] * bands), 259: ("H", [8]), 277: ("H", [bands]), 322: ("I", [tile]), 323: ("I", [tile]), 324: ("I", offsets), 325: ("I", sizes), 339: ("H", [kind] * bands)}
    if gt:
        tags |= {33550: ("d", [gt[2], gt[3], 0.0]), 33922: ("d", [0.0, 0.0, 0.0, gt[0], gt[1], 0.0])}
    if geographic:
        tags[34735] = ("H", [1, 1, 0, 1, 2048, 0, 1, geographic])
    entries = b""
    for number, (code, values) in sorted(tags.items()):
        data = struct.pack(f"<{len(values)}{code}", *values)
        entries += struct.pack("<HHI", number, {"H": 3, "I": 4, "d": 12}[code], len(values)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", len(body)))
        body += data if len(data) > 4 else b""
    body[:8] = b"II*\0" + struct.pack("<I", len(body))
    return bytes(body + struct.pack("<H", len(tags)) + entries + bytes(4))


def write_rasters(rasters: DataFrame, base: str) -> DataFrame:
    """Writes name.tif under base (an absolute path or a URI) for rows of name, width, height, band-interleaved samples
    (array<float>), gt (ox, oy, pw, ph) and geographic, and gives uri and n_bytes of each. A task that runs again writes the
    same file again."""

    def run(batches):
        system, path = pa.fs.FileSystem.from_uri(base)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                data = encoded(np.asarray(r.samples, np.float32).reshape(int(r.height), int(r.width), -1), 64, tuple(r.gt) if r.gt is not None else None, None if pd.isna(r.geographic) else int(r.geographic))
                system.create_dir(path, recursive=True)
                with system.open_output_stream(f"{path}/{r.name}.tif") as f:
                    f.write(data)
                rows.append((f"{base}/{r.name}.tif", len(data)))
            yield pd.DataFrame(rows, columns=["uri", "n_bytes"])

    return rasters.select("name", "width", "height", "samples", "gt", "geographic").mapInPandas(run, "uri string, n_bytes long")


def files(spark: SparkSession, path: str, header_only: bool = False, pattern: str = "*") -> DataFrame:
    """uri and content of the files; header_only keeps the first 256 KiB."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("uri"), "content")
    return df.withColumn("content", F.substring("content", 1, HEADER_BYTES)) if header_only else df


def _header(uri: str, h: Header) -> tuple:
    names = [f.strip().split(" ")[0] for f in KEYS.split(",")]
    gt, keys = h.transform(), h.keys()
    affine = dict(zip(("ox", "pw", "rr", "oy", "cr", "ph"), map(float, gt), strict=True)) if gt else None
    return uri, h.width, h.height, h.bands, h.dtype, *h.chip, affine, {n: keys.get(n) for n in names} if keys else None, None


def headers(files: DataFrame) -> DataFrame:
    """One header row per file (see HEADER); where it cannot be read, error says why."""

    def run(batches):
        for pdf in batches:
            rows = []
            for uri, data in zip(pdf["uri"], pdf["content"], strict=True):
                try:
                    rows.append(_header(uri, Header(data)))
                except Exception as e:  # whatever is wrong with a file is told in its row
                    rows.append((uri, *[None] * 8, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["uri", "width", "height", "band_count", "dtype", "tile_w", "tile_h", "gt", "keys", "error"])

    return files.mapInPandas(run, HEADER)


def inspected(headers: DataFrame) -> DataFrame:
    """Header rows with the resolved system and the footprint ring in degrees."""
    named = headers.withColumn("crs", crs.crs_text("keys"))
    corner = lambda c, r: spatial.pixel_to_world("gt", c, r)
    corners = F.array(corner(F.lit(0), F.lit(0)), corner(F.col("width"), F.lit(0)), corner(F.col("width"), F.col("height")), corner(F.lit(0), F.col("height")))
    long = named.withColumn("_c", corners).select("uri", "crs", F.posexplode("_c").alias("i", "p")).withColumn("d", crs.reproject("crs", "EPSG:4326", F.col("p.x"), F.col("p.y")))
    rings = long.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("c")).select("uri", crs.footprint_ring(F.transform("c", lambda p: p["d"])).alias("ring"))
    return named.join(rings, "uri", "left")


def chips(files: DataFrame, nodata: float | None = None) -> DataFrame:
    """Chip rows (see CHIPS) of all bands of files whose contents are at hand; pixels equal to nodata are NaN.

    A file or chip that cannot be read gives one row without band and pixels, with the reason as its error.
    """

    def run(batches):
        for batch in batches:
            for uri, data in zip(batch.column("uri").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    h = Header(data)
                    layout, index = h.layout(), h.index()
                except Exception as e:
                    yield _chip_batch([(uri, None, None, None, str(e) or type(e).__name__)])
                    continue
                for x, y, at, n in index:
                    try:
                        yield _chip_batch([(uri, x, y, decoded(data[at : at + n], x, y, layout, nodata), None)])
                    except Exception as e:
                        yield _chip_batch([(uri, x, y, None, str(e) or type(e).__name__)])

    return files.select("uri", "content").mapInArrow(run, CHIPS)


def pixels(chips: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Long form of chips: asset_id, band, row, col, v."""
    long = chips.select("asset_id", "band", "chip_x", "chip_y", "w", F.posexplode("pixels").alias("i", "v"))
    return long.select("asset_id", "band", (F.col("chip_y") * tile_h + F.floor(F.col("i") / F.col("w"))).cast("int").alias("row"), (F.col("chip_x") * tile_w + F.col("i") % F.col("w")).cast("int").alias("col"), F.nanvl("v", F.lit(None).cast("float")).alias("v"))
