"""Shapefiles that the test writes, read back in splits; broken ones told apart."""

import struct

import pytest

from quadrille.functions import clip
from quadrille.sources import shapefile

FIELDS = [("NAME", "C", 12, 0), ("N", "N", 9, 0), ("V", "N", 12, 3), ("OK", "L", 1, 0), ("fid", "N", 4, 0)]


def content(kind, shape):
    if shape is None:
        return struct.pack("<i", 0)
    if kind == 1:
        return struct.pack("<i2d", 1, *shape)
    xy = [v for part in shape for v in part]
    firsts = [sum(len(p) for p in shape[:k]) for k in range(len(shape))]
    box = [f(v[k] for v in xy) for f in (min, max) for k in (0, 1)]
    return struct.pack("<i4d2i", kind, *box, len(shape), len(xy)) + struct.pack(f"<{len(firsts)}i", *firsts) + b"".join(struct.pack("<2d", *v) for v in xy)


def write(base, kind, rows, encoding="cp949"):
    """rows: shape, then a value for each of FIELDS."""
    records = [content(kind, r[0]) for r in rows]
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    body, index, at = b"", b"", 100
    for n, r in enumerate(records, 1):
        body += struct.pack(">2i", n, len(r) // 2) + r
        index += struct.pack(">2i", at // 2, len(r) // 2)
        at += 8 + len(r)
    (base.parent / f"{base.name}.shp").write_bytes(head(at) + body)
    (base.parent / f"{base.name}.shx").write_bytes(head(100 + len(index)) + index)
    fields = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([length, d]) + b"\0" * 14 for n, k, length, d in FIELDS)
    told = b""
    for r in rows:
        told += b" "
        for (_, k, length, d), v in zip(FIELDS, r[1:]):
            text = "" if v is None else ("T" if v else "F") if k == "L" else f"{v:.{d}f}" if k == "N" else v
            told += text.encode(encoding).ljust(length) if k == "C" else text.encode().rjust(length)
    (base.parent / f"{base.name}.dbf").write_bytes(b"\x03\0\0\0" + struct.pack("<IHH", len(rows), 32 + len(fields) + 1, 1 + sum(f[2] for f in FIELDS)) + b"\0" * 20 + fields + b"\r" + told)
    (base.parent / f"{base.name}.cpg").write_text("EUC-KR")


def box(x, y, n, hole=False):
    ring = [(x, y), (x, y + n), (x + n, y + n), (x + n, y), (x, y)]
    return [tuple(map(float, v)) for v in (ring[::-1] if hole else ring)]


@pytest.fixture(scope="module")
def shp(spark):
    shapefile.register(spark)
    return spark.read.format("shapefile")


def test_polygons_in_splits(spark, shp, tmp_path):
    shapes = [[box(0, 0, 9), box(2, 2, 3, True), box(20, 0, 4), box(21, 1, 1, True)], None, [box(5, 5, 2)]] * 40
    rows = [(s, f"이름{k}", k, k / 8, k % 2 == 0 if k % 3 else None, 7) for k, s in enumerate(shapes)]
    write(tmp_path / "a", 5, rows)
    df = shp.option("splitBytes", 2000).load(str(tmp_path / "a.shp"))
    assert df.rdd.getNumPartitions() > 5 and df.columns == ["fid", "NAME", "N", "V", "OK", "x", "y", "parts"]
    got = {r["fid"]: r for r in df.collect()}
    assert len(got) == 120
    for k, row in enumerate(rows):
        r = got[k]
        assert (r["NAME"], r["N"], r["V"], r["OK"]) == row[1:5]
        assert (None if r["parts"] is None else [[tuple(v) for v in p] for p in r["parts"]]) == row[0]
    parts = shapefile.polygon_parts(df).collect()
    assert len(parts) == 40 * 2 + 40 and {r["part"] for r in parts} == {0, 1}
    first = [r for r in parts if r["fid"] == 0]
    assert sorted(abs(sum(clip.signed_area(clip.np.array([(v["x"], v["y"]) for v in ring])) for ring in r["rings"])) for r in first) == [15.0, 72.0]


def test_points_lines_and_none(spark, shp, tmp_path):
    write(tmp_path / "p", 1, [((1.5, 2.5), "a", 1, None, None, 1), (None, None, None, 2.0, True, 2)])
    assert [(r["x"], r["y"], r["parts"], r["NAME"], r["N"], r["V"]) for r in shp.load(str(tmp_path / "p.shp")).orderBy("fid").collect()] == [(1.5, 2.5, None, "a", 1, None), (None, None, None, None, None, 2.0)]
    write(tmp_path / "l", 3, [([[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 2.0), (4.0, 2.0)]], "b", 1, 1.0, True, 1)])
    assert [len(p) for p in shp.load(str(tmp_path / "l")).first()["parts"]] == [2, 3]
    write(tmp_path / "none", 5, [])
    assert shp.load(str(tmp_path / "none.shp")).count() == 0
    assert shp.load(str(tmp_path / "p.shp")).select("N").collect()[0][0] == 1


def test_integrity(spark, tmp_path):
    for name in ("good", "noindex", "notable", "broken", "short", "fewer", "odd"):
        write(tmp_path / name, 5, [([box(k, 0, 1)], "a", k, 1.0, True, 1) for k in range(5)])
    (tmp_path / "noindex.shx").unlink()
    (tmp_path / "notable.dbf").unlink()
    (tmp_path / "broken.shp").write_bytes(b"no shapes" * 50)
    (tmp_path / "short.shp").write_bytes((tmp_path / "short.shp").read_bytes()[:300])
    (tmp_path / "fewer.shx").write_bytes((tmp_path / "fewer.shx").read_bytes()[:-16])
    raw = bytearray((tmp_path / "odd.shp").read_bytes())
    raw[32] = 31
    (tmp_path / "odd.shp").write_bytes(bytes(raw))
    (tmp_path / "only.dbf").write_bytes(b"\x03")
    got = {r["dataset"].rpartition("/")[2]: (r["geometry_type"], r["records"], r["problems"]) for r in shapefile.integrity(spark, str(tmp_path)).collect()}
    assert got == {
        "good": ("POLYGON", 5, []), "noindex": ("POLYGON", 5, ["NO_INDEX"]), "notable": ("POLYGON", 5, ["NO_TABLE"]), "broken": (None, 5, ["BROKEN_SHAPES"]),
        "short": ("POLYGON", 5, ["SHORT_SHAPES"]), "fewer": ("POLYGON", 3, ["RECORDS_DIFFER"]), "odd": (None, 5, ["UNKNOWN_TYPE"]), "only": (None, None, ["NO_SHAPES", "NO_INDEX"]),
    }


def test_spatial_files(spark, tmp_path):
    (tmp_path / "x.gdb").mkdir()
    (tmp_path / "x.gdb/a00000001.gdbtable").write_bytes(b"1")
    (tmp_path / "y.gpkg").write_bytes(b"SQLite format 3\0rest")
    (tmp_path / "z.gpkg").write_bytes(b"something else")
    (tmp_path / "b.SHP").write_bytes(b"1")
    (tmp_path / "c.geojson").write_text("{}")
    (tmp_path / "d.txt").write_text("{}")
    assert {(r["path"].rpartition("/")[2], r["format"]) for r in shapefile.spatial_files(spark, str(tmp_path)).collect()} == {("x.gdb", "FileGDB"), ("y.gpkg", "GeoPackage"), ("b.SHP", "Shapefile"), ("c.geojson", "GeoJSON")}
