"""Shapefiles as a Spark data source, read in splits of records, and what is wrong with the files of a folder.

`register(spark)` adds the format `shapefile`. A dataset is `name.shp` with its index `name.shx` and table `name.dbf`; the
index says where each record lies, so a split reads its own stretch of the shapes and of the table and nothing else.
Rows have fid (from 0), the table's columns, x and y (points) and parts (lines and rings; each as a vertex array); columns of
the table with such a name are left out, and so are rows that it marks as deleted.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quadrille.functions import clip

c = F.col
# fixed values: codes of the format
POINTS, MULTIPOINTS, LINES, RINGS = (1, 11, 21), (8, 18, 28), (3, 13, 23), (5, 15, 25)
TYPES = {0: "NULL", **dict.fromkeys(POINTS, "POINT"), **dict.fromkeys(MULTIPOINTS, "MULTIPOINT"), **dict.fromkeys(LINES, "LINESTRING"), **dict.fromkeys(RINGS, "POLYGON")}
HEAD = 100
_VERTEX = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])


def store_of(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def size_of(uri: str) -> int | None:
    there, place = store_of(uri)
    found = there.get_file_info(place)
    return found.size if found.is_file else None


def stretch(uri: str, start: int, size: int) -> bytes:
    there, place = store_of(uri)
    with there.open_input_file(place) as f:
        f.seek(start)
        return f.read(size)


def header(raw: bytes) -> tuple[int, int] | None:
    """The length in bytes and the type that the head of a .shp or .shx states; None where it is none."""
    if len(raw) < HEAD or struct.unpack_from(">i", raw, 0)[0] != 9994 or struct.unpack_from("<i", raw, 28)[0] != 1000:
        return None
    return 2 * struct.unpack_from(">i", raw, 24)[0], struct.unpack_from("<i", raw, 32)[0]


@dataclass
class Table:
    """The head of a .dbf: rows, where they begin, how long one is, and the fields (name, kind, length, decimals)."""

    rows: int
    start: int
    width: int
    fields: list[tuple[str, str, int, int]]

    @classmethod
    def of(cls, uri: str) -> Table:
        rows, start, width = struct.unpack_from("<IHH", stretch(uri, 4, 8))
        raw, fields, at = stretch(uri, 32, max(0, start - 32)), [], 0
        while at + 32 <= len(raw) and raw[at] != 0x0D:
            fields.append((raw[at : at + 11].split(b"\0")[0].decode("ascii", "replace").strip(), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
            at += 32
        return cls(rows, start, width, fields)

    def columns(self) -> list[StructField]:
        kinds = {"N": lambda d, n: DoubleType() if d or n > 18 else LongType(), "F": lambda d, n: DoubleType(), "L": lambda d, n: BooleanType(), "I": lambda d, n: IntegerType()}
        return [StructField(name, kinds.get(kind, lambda d, n: StringType())(decimals, length)) for name, kind, length, decimals in self.fields]


def _value(raw: bytes, kind: str, decimals: int, length: int, encoding: str):
    if kind == "I":
        return struct.unpack("<i", raw)[0]
    text = raw.decode(encoding, "replace").strip(" \0")
    if kind in "NF":
        try:
            return float(text) if decimals or kind == "F" or length > 18 else int(text)
        except ValueError:
            return None
    if kind == "L":
        return {"t": True, "y": True, "f": False, "n": False}.get(text[:1].lower())
    return text or None


def shape_of(raw: bytes) -> tuple[float | None, float | None, list | None]:
    """x, y and parts of a record's content."""
    kind = struct.unpack_from("<i", raw, 0)[0]
    if kind in POINTS:
        return (*struct.unpack_from("<2d", raw, 4), None)
    if kind in MULTIPOINTS:
        n, at, firsts = struct.unpack_from("<i", raw, 36)[0], 40, [0]
    elif kind in LINES or kind in RINGS:
        parts, n = struct.unpack_from("<2i", raw, 36)
        firsts, at = np.frombuffer(raw, "<i4", parts, 44).tolist(), 44 + 4 * parts
    else:
        return None, None, None
    xy = np.frombuffer(raw, "<f8", 2 * n, at).reshape(-1, 2)
    return None, None, [xy[a:b] for a, b in zip(firsts, [*firsts[1:], n])]


@dataclass
class Split(InputPartition):
    first: int
    records: int
    start: int
    size: int


class Reader(DataSourceReader):
    def __init__(self, base: str, schema: StructType, split_bytes: int):
        self.base, self.wanted, self.split_bytes = base, schema, split_bytes

    def partitions(self) -> list[Split]:
        """Stretches of the .shp of about split_bytes, by its index; only the index's own bytes are looked at."""
        size = size_of(f"{self.base}.shx")
        if size is None:
            raise FileNotFoundError(f"{self.base}.shx")
        n = (size - HEAD) // 8
        index = np.frombuffer(stretch(f"{self.base}.shx", HEAD, 8 * n), ">i4").reshape(-1, 2).astype(np.int64) * 2
        if not n:
            return [Split(0, 0, HEAD, 0)]
        ends = index[:, 0] + 8 + index[:, 1]
        cuts = np.unique(np.searchsorted(index[:, 0], np.arange(HEAD, int(ends[-1]), self.split_bytes)))
        cuts = np.append(cuts[cuts < n], n)
        return [Split(int(a), int(b - a), int(index[a, 0]), int(ends[b - 1] - index[a, 0])) for a, b in zip(cuts[:-1], cuts[1:])]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        table = Table.of(f"{self.base}.dbf") if size_of(f"{self.base}.dbf") is not None else None
        cpg = size_of(f"{self.base}.cpg")
        encoding = stretch(f"{self.base}.cpg", 0, cpg).decode("ascii", "replace").strip() if cpg else "utf-8"
        encoding = {"euc-kr": "cp949", "ansi 949": "cp949"}.get(encoding.lower(), encoding)
        shapes = stretch(f"{self.base}.shp", split.start, split.size)
        told = stretch(f"{self.base}.dbf", table.start + split.first * table.width, split.records * table.width) if table else b""
        kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in self.wanted])
        for at in range(0, split.records, 4096):
            rows, n = {f.name: [] for f in self.wanted}, min(4096, split.records - at)
            if at == 0:
                place = 0
            for k in range(at, at + n):
                size = 2 * struct.unpack_from(">i", shapes, place + 4)[0]
                x, y, parts = shape_of(shapes[place + 8 : place + 8 + size])
                place += 8 + size
                own = {"deleted": False, "fid": split.first + k, "x": x, "y": y, "parts": None if parts is None else [[{"x": a, "y": b} for a, b in p.tolist()] for p in parts]}
                if table:
                    raw, begin = told[k * table.width : (k + 1) * table.width], 1
                    own["deleted"] = raw[:1] == b"*"
                    for name, kind, length, decimals in table.fields:
                        own.setdefault(name, _value(raw[begin : begin + length], kind, decimals, length, encoding))
                        begin += length
                if not own.pop("deleted", False):
                    for name in rows:
                        rows[name].append(own.get(name))
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in kinds], schema=kinds)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class ShapefileSource(DataSource):
    """format("shapefile").load("…/name.shp"); option splitBytes: how much of the .shp a task reads (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _base(self) -> str:
        path = self.options["path"]
        return path[:-4] if path.lower().endswith(".shp") else path

    def schema(self) -> StructType:
        own = Table.of(f"{self._base()}.dbf").columns() if size_of(f"{self._base()}.dbf") is not None else []
        taken = {"fid", "x", "y", "parts"}
        return StructType([StructField("fid", LongType()), *(f for f in own if f.name not in taken), StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("parts", ArrayType(ArrayType(_VERTEX)))])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self._base(), schema, int(self.options.get("splitBytes", 64 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from quadrille.operators.clipping import as_rings, ring_lists

    for batch in batches:
        rows = []
        for k, rings in enumerate(ring_lists(batch.column("parts"))):
            rings = [r for r in rings if len(r) > 3]
            # shells run with the clock; rings that all run the other way are shells too
            shells = [r for r in rings if clip.signed_area(r) < 0] or rings
            holes = [r for r in rings if not any(r is s for s in shells)]
            home: dict[int, list] = {n: [] for n in range(len(shells))}
            for hole in holes:
                inside = [n for n, s in enumerate(shells) if clip._within(hole, s)]
                if inside:
                    home[min(inside, key=lambda n: abs(clip.signed_area(shells[n])))].append(hole)
            rows += [(k, n, [s, *home[n]]) for n, s in enumerate(shells)]
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("fid").take(at), pa.array([r[1] for r in rows], pa.int32()), as_rings([r[2] for r in rows])], names=["fid", "part", "rings"])


def polygon_parts(layer: DataFrame) -> DataFrame:
    """fid, part, rings: each polygon of a layer's shapes (fid, parts) by itself, the shell first, then its holes; a hole in
    no shell is left out. Shapes of several polygons give several rows, null shapes none."""
    from quadrille.operators.clipping import RINGS as KIND

    return layer.filter("parts IS NOT NULL").select("fid", c("parts").cast(KIND).alias("parts")).mapInArrow(_grouped, f"fid long, part int, rings {KIND}")


# --- integrity -------------------------------------------------------------------------------------------------

#: What may be wrong with a dataset, in the order in which it is told.
PROBLEMS = ("NO_SHAPES", "NO_INDEX", "NO_TABLE", "BROKEN_SHAPES", "BROKEN_INDEX", "SHORT_SHAPES", "RECORDS_DIFFER", "UNKNOWN_TYPE")


def _looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for uri, ext in zip(batch.column("uri").to_pylist(), batch.column("ext").to_pylist()):
            size, stated, kind, records = size_of(uri) or 0, None, None, None
            if ext in ("shp", "shx"):
                stated, kind = header(stretch(uri, 0, HEAD)) or (None, None)
                records = (size - HEAD) // 8 if ext == "shx" and stated is not None else None
            elif size >= 32:
                records = Table.of(uri).rows
            out.append((size, stated, kind, records))
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("dataset"), batch.column("ext"), *columns], names=["dataset", "ext", "size", "stated", "kind", "records"])


def integrity(spark: SparkSession, folder: str) -> DataFrame:
    """dataset, geometry_type, records, problems: of each dataset that has a .shp, .shx or .dbf in a folder (and below it).

    Spark lists the files and reads none; a task looks at the heads of its files. Problems are of PROBLEMS: a part is
    missing, a head is not that of the format, the shapes are shorter than their head says, index and table have
    different numbers of records, the type is none that can be read. An empty file counts as missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    named = files.select(F.regexp_replace("path", "^file:/+", "/").alias("uri")).select("uri", F.regexp_extract("uri", r"(?i)^(.*)\.(shp|shx|dbf)$", 1).alias("dataset"), F.lower(F.regexp_extract("uri", r"(?i)\.(shp|shx|dbf)$", 1)).alias("ext")).filter("ext <> ''")
    told = named.repartition("dataset").mapInArrow(_looked_at, "dataset string, ext string, size long, stated long, kind int, records long")
    of = lambda ext, column: F.max(F.when(c("ext") == ext, c(column))).alias(f"{ext}_{column}")
    each = told.groupBy("dataset").agg(*[of(e, k) for e in ("shp", "shx", "dbf") for k in ("size", "stated", "kind", "records")])
    known = F.coalesce(c("shp_kind").isin(*TYPES), F.lit(False))
    wrong = {
        "NO_SHAPES": c("shp_size").isNull(), "NO_INDEX": c("shx_size").isNull(), "NO_TABLE": c("dbf_size").isNull(),
        "BROKEN_SHAPES": c("shp_size").isNotNull() & c("shp_stated").isNull(), "BROKEN_INDEX": c("shx_size").isNotNull() & c("shx_stated").isNull(),
        "SHORT_SHAPES": c("shp_stated") > c("shp_size"), "RECORDS_DIFFER": c("shx_records") != c("dbf_records"), "UNKNOWN_TYPE": c("shp_kind").isNotNull() & ~known,
    }
    types = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    problems = F.filter(F.array(*[F.when(wrong[p], F.lit(p)) for p in PROBLEMS]), lambda x: x.isNotNull())
    return each.select("dataset", F.when(known, types[c("shp_kind")]).alias("geometry_type"), F.coalesce("shx_records", "dbf_records").alias("records"), problems.alias("problems"))


def _magic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [stretch(u, 0, 16) == b"SQLite format 3\0" for u in batch.column("uri").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("uri"), pa.array(found)], names=["uri", "sqlite"])


def spatial_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, format: the spatial data of a folder: Shapefile (a .shp), FileGDB (a folder .gdb with tables in it), GeoPackage (a
    .gpkg that is a SQLite file) and GeoJSON, by their names and first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("uri"))
    gdb = files.filter(c("uri").rlike(r"(?i)\.gdb/[^/]+\.gdbtable$")).select(F.regexp_extract("uri", r"(?i)^(.*\.gdb)/", 1).alias("path")).distinct().withColumn("format", F.lit("FileGDB"))
    plain = files.filter(~c("uri").rlike(r"(?i)\.gdb/"))
    simple = plain.select(c("uri").alias("path"), F.when(c("uri").rlike(r"(?i)\.shp$"), "Shapefile").when(c("uri").rlike(r"(?i)\.geojson$"), "GeoJSON").alias("format")).filter("format IS NOT NULL")
    packages = plain.filter(c("uri").rlike(r"(?i)\.gpkg$")).mapInArrow(_magic, "uri string, sqlite boolean").filter("sqlite").select(c("uri").alias("path"), F.lit("GeoPackage").alias("format"))
    return gdb.unionByName(simple).unionByName(packages)
