"""Point clouds and grids out of files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions.geometry import grid_point, numbers

SCHEMA = "file string, x double, y double, z double, r int, g int, b int, intensity double, classification int"


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of text files with lines ``x y z [r g b] [intensity] [class]``, separated by blanks, commas or semicolons.

    Seven numbers mean colours and intensity, eight a class, too; four are x, y, z and intensity. Blank lines, comments
    (#, //) and lines with fewer than three numbers aren't points.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("line")).filter((F.col("line") != "") & ~F.col("line").rlike("^(#|//)"))
    parts = F.transform(F.split(F.col("line"), r"[\s,;]+"), lambda p: F.when(p.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"), p).cast("double"))
    n = lines.select("file", parts.alias("n")).filter((F.size("n") >= 3) & F.col("n")[0].isNotNull() & F.col("n")[1].isNotNull() & F.col("n")[2].isNotNull())
    at = lambda k: F.get("n", F.lit(k))
    colour = F.size("n") >= 6
    whole = lambda k: F.when(colour, at(k)).cast("int")
    return n.select("file", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), whole(3).alias("r"), whole(4).alias("g"), whole(5).alias("b"), F.when(colour, at(6)).otherwise(at(3)).alias("intensity"), F.when(colour, at(7)).cast("int").alias("classification"))


def grid_points(grids: DataFrame, key: str, columns: Column, origin: Column, along: Column, across: Column, values: str) -> DataFrame:
    """(key, row, col, point): vertices of rectified grids from their value text, by row; a value that is missing takes the height of the origin."""
    each = grids.select(F.col(key).alias("__key"), columns.alias("__cols"), origin.alias("__o"), along.alias("__a"), across.alias("__c"), F.posexplode(numbers(F.col(values))).alias("__k", "__v"))
    row, col = F.floor(F.col("__k") / F.col("__cols")).cast("int"), (F.col("__k") % F.col("__cols")).cast("int")
    return each.select(F.col("__key").alias(key), row.alias("row"), col.alias("col"), grid_point(F.col("__o"), F.col("__a"), F.col("__c"), row, col, F.col("__v")).alias("point"))


#: What stands where in the point records of LAS files, by format: whether there is colour, and where.
_LAS_COLOUR = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
_CHUNK = 200_000


def _las(data: bytes) -> Iterator[dict[str, np.ndarray]]:
    offset, kind, size, count = struct.unpack_from("<I", data, 96)[0], data[104] & 0x3F, struct.unpack_from("<H", data, 105)[0], struct.unpack_from("<I", data, 107)[0]
    if data[104] & 0x80:
        raise ValueError("compressed")
    if data[24:26] == b"\x01\x04" and len(data) >= 255 and not count:
        count = struct.unpack_from("<Q", data, 247)[0]
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    count = min(count, (len(data) - offset) // size)
    names, formats, offsets = ["x", "y", "z", "intensity", "class"], ["<i4", "<i4", "<i4", "<u2", "u1"], [0, 4, 8, 12, 16 if kind >= 6 else 15]
    if kind in _LAS_COLOUR:
        names, formats, offsets = names + ["r", "g", "b"], formats + ["<u2"] * 3, offsets + [_LAS_COLOUR[kind] + 2 * k for k in range(3)]
    rows = np.frombuffer(data, np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": size}), count, offset)
    for part in (rows[k : k + _CHUNK] for k in range(0, count, _CHUNK)):
        out = {k: part[k] * s + o for k, s, o in zip("xyz", scale, shift, strict=True)}
        out |= {k: part[k] // 256 for k in "rgb" if k in names}
        yield out | {"intensity": part["intensity"].astype(float), "classification": part["class"] & (0xFF if kind >= 6 else 0x1F)}


#: Number types of PLY files.
_PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def _ply(data: bytes) -> Iterator[dict[str, np.ndarray]]:
    end = data.index(b"end_header")
    start = data.index(b"\n", end) + 1
    kind, element, count, fields = "", "", 0, []
    for words in (line.split() for line in data[:end].decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            element = words[1]
            if element == "vertex":
                count = int(words[2])
            elif not fields:
                raise ValueError("the vertices don't come first")
        elif words[:1] == ["property"] and element == "vertex":
            fields.append((words[2], _PLY_TYPES[words[1]]))
    if kind == "ascii":
        text = np.array([[float(v) for v in line.split()[: len(fields)]] for line in data[start:].decode("ascii", "replace").splitlines()[:count]]).reshape(-1, len(fields))
        rows = {name: text[:, k] for k, (name, _) in enumerate(fields)}
    else:
        order = "<" if kind == "binary_little_endian" else ">"
        table = np.frombuffer(data, np.dtype([(n, order + t) for n, t in fields]), count, start)
        rows = {n: table[n] for n, _ in fields}
    for k in range(0, count, _CHUNK):
        part = {n: v[k : k + _CHUNK] for n, v in rows.items()}
        out = {n: part[n].astype(float) for n in "xyz"} | {a: part[b] for a, b in (("r", "red"), ("g", "green"), ("b", "blue")) if b in part}
        yield out | {n: part[n] for n in ("intensity", "classification") if n in part}


def read_point_files(spark: SparkSession, path: str) -> DataFrame:
    """Points (SCHEMA, and error) of LAS and PLY files, by their first bytes; a file that can't be read gives one row with its error.

    Colours of LAS files are brought to 0 to 255. Compressed files can't be read. A file is one row of the source (2 GB at
    most), and points leave it in parts.
    """
    columns = {"x": pa.float64(), "y": pa.float64(), "z": pa.float64(), "r": pa.int32(), "g": pa.int32(), "b": pa.int32(), "intensity": pa.float64(), "classification": pa.int32()}
    schema = pa.schema([("file", pa.string()), *columns.items(), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for part in (_las if data[:4] == b"LASF" else _ply)(data):
                        n = len(part["x"])
                        values = [pa.array(np.asarray(part[c]).astype("f8" if t == pa.float64() else "i4")) if c in part else pa.nulls(n, t) for c, t in columns.items()]
                        yield pa.RecordBatch.from_arrays([pa.array([file] * n), *values, pa.nulls(n, pa.string())], schema=schema)
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([file]), *[pa.nulls(1, t) for t in columns.values()], pa.array([str(e)])], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA + ", error string")
