"""File sources and sinks: CSV contracts, matrices, GeoJSON, shapefiles, GeoPackages, run packages.

Tabular files go through Spark's readers and writers. The geometry formats are binary files of one city's layers;
they are read from bytes that Spark loads (binaryFile), so any store that Spark reads will do.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import sqlite3
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanloom.errors import GeoPackageWriteError, GridInputError, MatrixInputError, UnsupportedCrs
from urbanloom.functions import columns as C

LOCATIONS = T.StructType([T.StructField("location_id", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("population", "employment_raw", "employment_model", "rent_floor_space", "land_area")])
SHOCKS = T.StructType([T.StructField("location_id", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("productivity_hat", "amenity_hat", "structural_density_hat")])
LAYER = "feature long, part long, kind string, coords array<array<struct<x:double,y:double>>>, properties map<string,string>, source_file string, crs string"


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """locations.csv with canonical ids and loc_idx in file order; ids unique, rent positive, totals balanced."""
    frame = spark.read.schema(LOCATIONS).option("header", True).csv(path).coalesce(1)
    ids = frame.withColumn("location_id", C.canonical_id(F.col("location_id"))).withColumn("loc_idx", F.monotonically_increasing_id())
    row = ids.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("location_id").alias("d"), F.min("rent_floor_space").alias("rent"), F.sum("population").alias("p"), F.sum("employment_model").alias("e")).first()
    if row.n != row.d:
        raise GridInputError("location ids are not unique")
    if row.rent is None or row.rent <= 0:
        raise GridInputError("rents must be positive")
    if abs(row.p - row.e) > 1e-6 + 1e-6 * abs(row.e):
        raise GridInputError("population and model employment do not balance")
    return ids


def read_matrix(spark: SparkSession, path: str, locations: DataFrame) -> DataFrame:
    """A labelled wide CSV as long minutes in canonical order; missing, extra and repeated ids raise."""
    from urbanloom.operators import matrices

    wide = spark.read.option("header", True).csv(path)
    wide = wide.withColumnRenamed(wide.columns[0], "location_id")
    known = locations.select("location_id")
    rows = wide.select(C.canonical_id(F.col("location_id")).alias("location_id"))
    labels = spark.createDataFrame([(c,) for c in wide.columns[1:]], "location_id string").select(C.canonical_id(F.col("location_id")).alias("location_id"))
    for axis, found in (("row", rows), ("column", labels)):
        bad = matrices.id_differences(found, known).limit(5).collect()
        if bad:
            raise MatrixInputError(f"{axis} ids differ: " + ", ".join(f"{r.location_id} {r.problem}" for r in bad))
    return matrices.assert_content(matrices.wide_to_long(wide, locations), locations.count())


def read_shocks(spark: SparkSession, path: str, locations: DataFrame) -> DataFrame:
    """loc_idx and hats in model order; missing rows and values are 1."""
    given = spark.read.schema(SHOCKS).option("header", True).csv(path).withColumn("location_id", C.canonical_id(F.col("location_id")))
    hats = [F.coalesce(F.col(c), F.lit(1.0)).alias(c) for c in SHOCKS.names[1:]]
    return locations.select("loc_idx", "location_id").join(given, "location_id", "left").select("loc_idx", "location_id", *hats)


def write_csv(frame: DataFrame, path: str) -> None:
    """One CSV file in the frame's order, published by a rename. The driver holds one partition's rows at a time; null and NaN are empty."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    scratch = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    with open(scratch, "w", newline="", encoding="utf-8") as stream:
        writer = csv.writer(stream, lineterminator="\n")
        writer.writerow(frame.columns)
        for row in frame.toLocalIterator(prefetchPartitions=True):
            writer.writerow(["" if v is None or v != v else v for v in row])
    os.replace(scratch, target)


def write_matrix(od: DataFrame, locations: DataFrame, path: str) -> None:
    """A labelled wide CSV, published by a rename. Lines are made in tasks; the driver holds some of them at a time.

    Origins and destinations that are no locations are left out; an origin without each destination once is an error.
    """
    from urbanloom.operators import matrices

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    ordered = [r.location_id for r in locations.orderBy("loc_idx").select("location_id").collect()]
    scratch = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    written = 0
    try:
        with scratch.open("w", encoding="utf-8", newline="") as out:
            lines = csv.writer(out, lineterminator="\n")
            lines.writerow(["location_id", *[f"location_id_{i}" for i in ordered]])
            for row in matrices.text_lines(od, locations).toLocalIterator():
                if not row.pairs == row.destinations == len(ordered):
                    raise MatrixInputError(f"origin {row.location_id} has {row.pairs} pairs and {row.destinations} destinations of {len(ordered)}")
                lines.writerow([row.location_id, *row.line.split(",")])
                written += 1
        if written != len(ordered):
            raise MatrixInputError(f"{written} of {len(ordered)} origins have pairs")
        os.replace(scratch, target)
    finally:
        scratch.unlink(missing_ok=True)


def write_json(document: Mapping, path: str) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    scratch = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    scratch.write_text(json.dumps(document, indent=2, default=str), encoding="utf-8")
    os.replace(scratch, target)


def city_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """metro_id, metro_name and what its name says: city, country or states. Quotes may hold commas."""
    frame = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    tail = F.trim(F.element_at(F.split("metro_name", ","), -1))
    return frame.withColumns({"city": F.trim(F.element_at(F.split("metro_name", ","), 1)), "place": tail, "states": F.split(tail, "-")})


def cities_in(catalogue: DataFrame, place: str | None = None) -> DataFrame:
    chosen = catalogue if place is None else catalogue.where(F.array_contains("states", place) | (F.col("place") == place))
    return chosen.orderBy(F.lower("metro_name"))


# Shapefiles


def _shape_parts(record: bytes) -> tuple[str, list[list[tuple[float, float]]]]:
    (kind,) = struct.unpack_from("<i", record)
    if kind % 10 == 1 and kind:
        return "point", [[struct.unpack_from("<2d", record, 4)]]
    if kind % 10 == 8:
        (count,) = struct.unpack_from("<i", record, 36)
        return "point", [[struct.unpack_from("<2d", record, 40 + 16 * k)] for k in range(count)]
    if kind % 10 in (3, 5):
        n_parts, n_points = struct.unpack_from("<2i", record, 36)
        starts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n_points]
        base = 44 + 4 * n_parts
        points = [struct.unpack_from("<2d", record, base + 16 * k) for k in range(n_points)]
        return "line" if kind % 10 == 3 else "polygon", [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    return "null", []


def parse_shapefile(shp: bytes, dbf: bytes | None) -> Iterator[tuple[int, str, list, dict[str, str]]]:
    """(feature, kind, parts, properties) of each record."""
    rows = list(_dbf_rows(dbf)) if dbf else []
    at, k = 100, 0
    while at + 8 <= len(shp):
        (words,) = struct.unpack_from(">i", shp, at + 4)
        kind, parts = _shape_parts(shp[at + 8 : at + 8 + 2 * words])
        yield k, kind, parts, rows[k] if k < len(rows) else {}
        at, k = at + 8 + 2 * words, k + 1


def _dbf_rows(data: bytes) -> Iterator[dict[str, str]]:
    count, header, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    for k in range(count):
        row, place = data[header + k * size : header + (k + 1) * size], 1
        out = {}
        for name, width in fields:
            out[name] = row[place : place + width].decode("utf-8", "replace").strip()
            place += width
        yield out


def crs_of_prj(text: str | None) -> str:
    """EPSG codes of the systems that can be projected; others raise."""
    if text is None:
        raise GridInputError("layer without a coordinate system")
    if re.match(r"\s*GEOGCS", text) and re.search(r"WGS[ _]?(19)?84", text):
        return "EPSG:4326"
    if zone := re.search(r"UTM[ _]zone[ _](\d+)([NS])", text, re.I):
        return f"EPSG:{326 if zone[2].upper() == 'N' else 327}{int(zone[1]):02d}"
    if re.search(r"Pseudo[- _]?Mercator|Web[ _]Mercator", text, re.I):
        return "EPSG:3857"
    raise UnsupportedCrs(text[:120])


def prj_of(epsg: int) -> str:
    """The well-known text that crs_of_prj() reads back: WGS84, its UTM zones and web Mercator."""
    world = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
    if epsg == 4326:
        return world
    if epsg == 3857:
        return f'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",{world},PROJECTION["Mercator_Auxiliary_Sphere"],UNIT["Meter",1.0]]'
    side, zone = divmod(epsg, 100)
    if side not in (326, 327) or not 1 <= zone <= 60:
        raise UnsupportedCrs(f"EPSG:{epsg}")
    north = side == 326
    numbers = {"False_Easting": 500000.0, "False_Northing": 0.0 if north else 10000000.0, "Central_Meridian": 6.0 * zone - 183, "Scale_Factor": 0.9996, "Latitude_Of_Origin": 0.0}
    given = ",".join(f'PARAMETER["{k}",{v}]' for k, v in numbers.items())
    return f'PROJCS["WGS_1984_UTM_Zone_{zone}{"N" if north else "S"}",{world},PROJECTION["Transverse_Mercator"],{given},UNIT["Meter",1.0]]'


def write_shapefile(features: Sequence[tuple[str, Sequence, Mapping]], path: str, epsg: int) -> None:
    """.shp, .shx, .dbf and .prj of polygons or of points, each published by a rename. Names are cut at 10 characters.

    Names that are equal once cut get _1 to _9 instead of their last two characters. Outer rings run clockwise and holes
    against it. Texts over 254 bytes do not fit the format and are an error.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    kinds = {k for k, _, _ in features}
    if len(kinds) > 1 or kinds - {"point", "polygon"}:
        raise GridInputError(f"a shapefile holds either points or polygons, not {sorted(kinds)}")
    kind = 1 if kinds == {"point"} else 5
    around = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
    box = lambda points: (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))
    shapes, index, at, everything = [], [], 50, []
    for k, (_, parts, _) in enumerate(features):
        if kind == 1:
            points = [parts[0][0]]
            record = struct.pack("<i2d", 1, *points[0])
        else:
            rings = [list(ring) if ring[0] == ring[-1] else [*ring, ring[0]] for ring in parts]
            rings = [ring if (around(ring) < 0) == (i == 0) else ring[::-1] for i, ring in enumerate(rings)]
            points = [p for ring in rings for p in ring]
            starts = np.cumsum([0, *[len(ring) for ring in rings[:-1]]]).tolist()
            record = struct.pack("<i4d2i", 5, *box(points), len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        everything.append(box(points))
        shapes.append(struct.pack(">2i", k + 1, len(record) // 2) + record)
        index.append(struct.pack(">2i", at, len(record) // 2))
        at += 4 + len(record) // 2
    corners = list(zip(*everything, strict=True)) or [(0.0,)] * 4
    bounds = (min(corners[0]), min(corners[1]), max(corners[2]), max(corners[3]))
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, kind, *bounds, 0, 0, 0, 0)
    names = list(dict.fromkeys(name for _, _, given in features for name in given))
    short: list[str] = []
    for name in names:
        tries = [name[:10], *[f"{name[:8]}_{k}" for k in range(1, 10)]]
        if not (free := [t for t in tries if t not in short]):
            raise GridInputError(f"names are not distinct in 10 characters: {names}")
        short.append(free[0])
    cells = [[("" if given.get(n) is None else str(given[n])).encode() for n in names] for _, _, given in features]
    widths = [max([1, *[len(row[j]) for row in cells]]) for j in range(len(names))]
    if max(widths, default=0) > 254:
        raise GridInputError("a text is longer than the 254 bytes of a shapefile's field")
    fields = b"".join(n.encode("latin-1", "replace").ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, w in zip(short, widths, strict=True))
    table = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(cells), 33 + 32 * len(names), 1 + sum(widths)) + fields + b"\r"
    table += b"".join(b" " + b"".join(c.ljust(w) for c, w in zip(row, widths, strict=True)) for row in cells) + b"\x1a"
    body = {".shp": head(at) + b"".join(shapes), ".shx": head(50 + 4 * len(index)) + b"".join(index), ".dbf": table, ".prj": prj_of(epsg).encode()}
    for suffix, data in body.items():
        scratch = target.with_name(f".{target.stem}.{uuid.uuid4().hex}{suffix}")
        scratch.write_bytes(data)
        os.replace(scratch, target.with_suffix(suffix))


def _layer_rows(name: str, crs: str, features) -> Iterator[tuple]:
    for feature, kind, parts, properties in features:
        for part, coords in enumerate([parts] if kind == "polygon" else [[p] for p in parts]):
            yield feature, part, kind, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in coords], {k: "" if v is None else str(v) for k, v in properties.items()}, name, crs


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """A layer's parts (LAYER) from .shp, .dbf and .prj files, or from a zip of them."""
    def loaded(p: str) -> bytes | None:
        rows = spark.read.format("binaryFile").load(p).select("content").collect() if _exists(spark, p) else []
        return bytes(rows[0].content) if rows else None

    if path.endswith(".zip"):
        rows = []
        with zipfile.ZipFile(io.BytesIO(loaded(path))) as archive:
            for name in sorted(n for n in archive.namelist() if n.lower().endswith(".shp")):
                stem = name[:-4]
                get = lambda suffix: archive.read(stem + suffix) if stem + suffix in archive.namelist() else None  # noqa: E731,B023
                prj = get(".prj")
                rows += _layer_rows(name, crs_of_prj(prj.decode() if prj else None), parse_shapefile(get(".shp"), get(".dbf")))
    else:
        stem = path[:-4]
        prj = loaded(stem + ".prj")
        rows = list(_layer_rows(path, crs_of_prj(prj.decode() if prj else None), parse_shapefile(loaded(path), loaded(stem + ".dbf"))))
    if not rows:
        raise GridInputError(f"{path} holds no geometry")
    return spark.createDataFrame(rows, LAYER)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


# GeoPackages


def wkb_parts(data: bytes) -> tuple[str, list[list[tuple[float, float]]]]:
    """(kind, parts) of well-known binary; polygons' rings are the parts, multi-geometries' parts are joined."""
    order = "<" if data[0] else ">"
    at = 5
    (kind,) = struct.unpack_from(order + "I", data, 1)
    extra = 2 + (kind // 1000 in (1, 2, 3)) + (kind // 1000 == 3)
    code = kind % 1000

    def points(count: int) -> list[tuple[float, float]]:
        nonlocal at
        out = [struct.unpack_from(order + "2d", data, at + 8 * extra * k) for k in range(count)]
        at += 8 * extra * count
        return out

    def number() -> int:
        nonlocal at
        (value,) = struct.unpack_from(order + "I", data, at)
        at += 4
        return value

    if code == 1:
        return "point", [points(1)]
    if code == 2:
        return "line", [points(number())]
    if code == 3:
        return "polygon", [points(number()) for _ in range(number())]
    parts, name = [], {4: "point", 5: "line", 6: "polygon"}[code]
    for _ in range(number()):
        inner = data[at:]
        parts += wkb_parts(inner)[1]
        at += _wkb_size(inner)
    return name, parts


def _wkb_size(data: bytes) -> int:
    order = "<" if data[0] else ">"
    (kind,) = struct.unpack_from(order + "I", data, 1)
    size = 8 * (2 + (kind // 1000 in (1, 2, 3)) + (kind // 1000 == 3))
    code = kind % 1000
    if code == 1:
        return 5 + size
    (count,) = struct.unpack_from(order + "I", data, 5)
    at = 9
    if code == 2:
        return at + size * count
    for _ in range(count):
        if code == 3:
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4 + size * n
        else:
            at += _wkb_size(data[at:])
    return at


def to_wkb(kind: str, parts: Sequence[Sequence[tuple[float, float]]]) -> bytes:
    if kind == "point":
        return struct.pack("<BI2d", 1, 1, *parts[0][0])
    pack = lambda ring: struct.pack("<I", len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
    if kind == "line":
        return struct.pack("<BI", 1, 2) + pack(parts[0])
    return struct.pack("<BII", 1, 3, len(parts)) + b"".join(pack(ring) for ring in parts)


def _geopackage_geometry(blob: bytes) -> bytes:
    envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
    return blob[8 + envelope :]


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """A layer's parts (LAYER); the first feature table unless one is named."""
    content = spark.read.format("binaryFile").load(path).select("content").first().content
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as scratch:  # on the driver, which alone reads it
        scratch.write(bytes(content))
        scratch.flush()
        with sqlite3.connect(scratch.name) as db:
            db.row_factory = sqlite3.Row
            tables = [r[0] for r in db.execute("select table_name from gpkg_contents where data_type = 'features' order by rowid")]
            if layer is not None and layer not in tables:
                raise GridInputError(f"{path} has no layer {layer!r}")
            name = layer or tables[0]
            column, srs = db.execute("select column_name, srs_id from gpkg_geometry_columns where table_name = ?", (name,)).fetchone()
            features = []
            for k, row in enumerate(db.execute(f'select * from "{name}"')):
                kind, parts = wkb_parts(_geopackage_geometry(row[column])) if row[column] is not None else ("null", [])
                features.append((k, kind, parts, {c: row[c] for c in row.keys() if c != column}))
    return spark.createDataFrame(list(_layer_rows(path, f"EPSG:{srs}", features)), LAYER)


def write_geopackage(features: Sequence[tuple[str, Sequence, Mapping]], path: str, layer: str, epsg: int = 4326) -> None:
    """Write (kind, parts, properties) rows, check the file and publish it by a rename; no scratch files stay."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    scratch = target.with_name(f".{target.stem}.copying.{uuid.uuid4().hex}.gpkg")
    try:
        db = sqlite3.connect(scratch)
        fields = list(dict.fromkeys(k for _, _, p in features for k in p))
        db.execute("pragma application_id = 1196444487")
        db.execute("create table gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text, description text)")
        db.execute("insert into gpkg_spatial_ref_sys values ('EPSG', ?, 'EPSG', ?, 'undefined', null)", (epsg, epsg))
        db.execute("create table gpkg_contents (table_name text primary key, data_type text, identifier text, description text, last_change text default (datetime('now')), min_x real, min_y real, max_x real, max_y real, srs_id integer)")
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z tinyint, m tinyint)")
        db.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, ?)", (layer, layer, epsg))
        db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, epsg))
        db.execute(f'create table "{layer}" (fid integer primary key, geom blob' + "".join(f', "{f}"' for f in fields) + ")")
        for kind, parts, properties in features:
            blob = b"GP\0\1" + struct.pack("<i", epsg) + to_wkb(kind, parts)
            db.execute(f'insert into "{layer}" values (null, ?' + ", ?" * len(fields) + ")", (blob, *[properties.get(f) for f in fields]))
        db.commit()
        (count,) = db.execute(f'select count(*) from "{layer}"').fetchone()
        db.close()
        if count != len(features):
            raise GeoPackageWriteError(f"{count} of {len(features)} features were written")
        os.replace(scratch, target)
    except (sqlite3.Error, OSError) as error:
        raise GeoPackageWriteError(str(error)) from error
    finally:
        scratch.unlink(missing_ok=True)


# GeoJSON


def geojson_features(document: str) -> list[tuple[str, list, dict]]:
    """(kind, parts, properties) of a feature collection; multi-geometries are taken apart."""
    names = {"Point": "point", "LineString": "line", "Polygon": "polygon"}
    out = []
    for feature in json.loads(document)["features"]:
        geometry, properties = feature["geometry"], feature.get("properties") or {}
        kind, coordinates = geometry["type"], geometry["coordinates"]
        for one in coordinates if kind.startswith("Multi") else [coordinates]:
            base = names[kind.removeprefix("Multi")]
            parts = [[one]] if base == "point" else [one] if base == "line" else one
            out.append((base, [[(p[0], p[1]) for p in ring] for ring in parts], properties))
    return out


def to_geojson(features: Sequence[tuple[str, Sequence, Mapping]]) -> str:
    shape = {"point": ("Point", lambda p: list(p[0][0])), "line": ("LineString", lambda p: [list(x) for x in p[0]]), "polygon": ("Polygon", lambda p: [[list(x) for x in ring] for ring in p])}
    rows = [{"type": "Feature", "geometry": {"type": shape[k][0], "coordinates": shape[k][1](parts)}, "properties": dict(properties)} for k, parts, properties in features]
    return json.dumps({"type": "FeatureCollection", "features": rows})


def drawn_features(spark: SparkSession, document: str) -> DataFrame:
    """Features drawn by hand as rows: kind (transport, station or shock) and the layer's columns."""
    rows = [(k, 0, kind, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in parts], {a: str(b) for a, b in properties.items()}, "drawn", "EPSG:4326") for k, (kind, parts, properties) in enumerate(geojson_features(document))]
    return spark.createDataFrame(rows, LAYER).withColumn("role", F.col("properties")["kind"])


# Run packages


def write_package(path: str, documents: Mapping[str, Mapping | str | pd.DataFrame]) -> None:
    """A stored (uncompressed) zip of JSON, CSV and text files."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    scratch = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    with zipfile.ZipFile(scratch, "w", zipfile.ZIP_STORED) as archive:
        for name, body in documents.items():
            text = body if isinstance(body, str) else body.to_csv(index=False) if isinstance(body, pd.DataFrame) else json.dumps(body, indent=2, default=str)
            archive.writestr(name, text)
    os.replace(scratch, target)
