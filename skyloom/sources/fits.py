"""FITS files: headers, binary tables and HEALPix maps, read from bytes by the executors.

Cards are 80 characters in blocks of 2880 bytes. Where the store can be opened at an offset
(local, HDFS, S3, GCS by their scheme), a table is read by ranges of rows, one task each, and
of an image only the header; a file of any size needs no more memory than a range. On other
stores files come whole through Spark's binaryFile reader. Bytes become Arrow batches column
by column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = 2880
# Column codes of binary tables.
_TYPES = {"L": "i1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
_SQL = {"L": "boolean", "B": "int", "I": "int", "J": "int", "K": "long", "E": "float", "D": "double", "A": "string"}
_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string()}


def header(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The cards of the header at an offset, and where its data begin."""
    cards: dict = {}
    while at < len(data):
        for k in range(at, at + _BLOCK, 80):
            card = data[k : k + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at + _BLOCK
            if card[8:10] == "= ":
                found = re.match(r"\s*('(?:[^']|'')*'|[^/]*)", card[10:])
                text = found[1].strip()
                if text.startswith("'"):
                    cards[key] = text[1:-1].replace("''", "'").rstrip()
                elif text in ("T", "F"):
                    cards[key] = text == "T"
                elif text:
                    number = text.replace("D", "E").replace("d", "e")
                    cards[key] = int(number) if re.fullmatch(r"[+-]?\d+", number) else float(number)
        at += _BLOCK
    raise ValueError("header without END")


def units(data: bytes) -> Iterator[tuple[dict, int]]:
    """(header, offset of the data) of each unit of a file."""
    at = 0
    while at < len(data):
        cards, start = header(data, at)
        size = abs(int(cards.get("BITPIX", 8))) // 8
        for k in range(int(cards.get("NAXIS", 0))):
            size *= int(cards.get(f"NAXIS{k + 1}", 0))
        size = 0 if not cards.get("NAXIS") else (size + int(cards.get("PCOUNT", 0))) * int(cards.get("GCOUNT", 1))
        yield cards, start
        at = start + -(-size // _BLOCK) * _BLOCK


def columns(cards: dict) -> list[tuple[str, str, int, int]]:
    """(name, code, repeat, offset in the row) of a binary table."""
    out, at = [], 0
    for k in range(1, int(cards["TFIELDS"]) + 1):
        repeat, kind = re.match(r"(\d*)([A-Z])", cards[f"TFORM{k}"]).groups()
        repeat = int(repeat or 1)
        width = {"A": 1, "X": 0, "P": 8, "Q": 16, "C": 8, "M": 16}.get(kind) if kind not in _TYPES else np.dtype(_TYPES[kind]).itemsize
        out.append((str(cards.get(f"TTYPE{k}", f"col{k}")), kind, repeat, at))
        at += (repeat + 7) // 8 if kind == "X" else width * repeat
    return out


def table_unit(data: bytes) -> tuple[dict, int]:
    for cards, start in units(data):
        if cards.get("XTENSION") == "BINTABLE":
            return cards, start
    raise ValueError("no binary table")


def table_schema(data: bytes, names: Sequence[str] | None = None) -> dict[str, str]:
    return _kinds(table_unit(data)[0], names)


def table_batches(data: bytes, names: Sequence[str], batch: int = 65536) -> Iterator[pa.RecordBatch]:
    cards, start = table_unit(data)
    yield from row_batches(cards, data, start, int(cards["NAXIS2"]), names, batch)


def row_batches(cards: dict, data: bytes, start: int, rows: int, names: Sequence[str], batch: int = 65536) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` table rows that begin at an offset of ``data``."""
    width = int(cards["NAXIS1"])
    index = {c[0]: (k, *c) for k, c in enumerate(columns(cards), 1)}
    for a in range(0, rows, batch):
        n = min(batch, rows - a)
        block = np.frombuffer(data, np.uint8, n * width, start + a * width).reshape(n, width)
        out = []
        for name in names:
            k, _, kind, repeat, at = index[name]
            if kind == "A":
                raw = np.ascontiguousarray(block[:, at : at + repeat])
                out.append(pa.array([bytes(r).split(b"\0")[0].decode("utf-8", "replace").strip() for r in raw], pa.string()))
                continue
            v = np.ascontiguousarray(block[:, at : at + np.dtype(_TYPES[kind]).itemsize]).view(_TYPES[kind])[:, 0]
            if kind == "L":
                out.append(pa.array([{84: True, 70: False}.get(int(x)) for x in v], pa.bool_()))
                continue
            zero, scale, null = cards.get(f"TZERO{k}", 0), cards.get(f"TSCAL{k}", 1), cards.get(f"TNULL{k}")
            mask = v == null if null is not None else np.zeros(n, bool)
            v = v.astype(v.dtype.newbyteorder("="))
            if zero or scale != 1:
                v = v * scale + zero
            target = _ARROW[_SQL[kind]]
            mask = mask | (np.isnan(v) if v.dtype.kind == "f" else False)
            out.append(pa.array(v.astype(target.to_pandas_dtype()), target, mask=mask))
        yield pa.RecordBatch.from_arrays(out, names=list(names))


#: Schemes that are opened at an offset, bytes of a header that are read at once, bytes of a task's range of rows.
SEEKABLE, HEAD, RANGE = ("file", "hdfs", "s3", "s3a", "gs"), 1 << 16, 64 << 20


def _open(path: str):
    """A file that can be read at an offset."""
    from pyarrow import fs

    uri = re.sub(r"^s3a:", "s3:", path if "://" in path else re.sub(r"^file:", "", path))
    uri = re.sub(r"^file:/+(?!/)", "/", uri)
    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)


def seekable(path: str) -> bool:
    found = re.match(r"(\w+):", path)
    return not re.search(r"[*?{\[]", path) and (found[1].lower() if found else "file") in SEEKABLE


def _unit_at(file) -> tuple[dict, int]:
    """The header of a file's first binary table and the offset of its rows, without reading data."""
    at, size = 0, file.size()
    while at < size:
        length = HEAD
        while True:
            try:
                cards, start = header(file.read_at(min(length, size - at), at))
                break
            except ValueError:
                if length >= size - at:
                    raise
                length *= 4
        if cards.get("XTENSION") == "BINTABLE":
            return cards, at + start
        data = abs(int(cards.get("BITPIX", 8))) // 8 if cards.get("NAXIS") else 0
        for k in range(int(cards.get("NAXIS", 0))):
            data *= int(cards.get(f"NAXIS{k + 1}", 0))
        at += start + -(-(data + int(cards.get("PCOUNT", 0))) // _BLOCK) * _BLOCK
    raise ValueError("no binary table")


def _wanted(kinds: dict[str, str], names: Sequence[str] | None) -> list[str]:
    wanted = [n for n in (names or kinds) if n in kinds]
    if names and len(wanted) < len(names):
        raise ValueError(f"missing columns: {[n for n in names if n not in kinds]}")
    return wanted


def _kinds(cards: dict, names: Sequence[str] | None) -> dict[str, str]:
    return {n: _SQL[k] for n, k, repeat, _ in columns(cards) if k in _SQL and (repeat == 1 or k == "A") and (names is None or n in names)}


def read_table(spark: SparkSession, path: str, names: Sequence[str] | None = None, range_bytes: int = RANGE) -> DataFrame:
    """A binary table as a DataFrame; missing numbers are null."""
    if seekable(path) and not _is_folder(spark, path):
        with _open(path) as file:
            cards, start = _unit_at(file)
        kinds = _kinds(cards, names)
        wanted, width, rows = _wanted(kinds, names), int(cards["NAXIS1"]), int(cards["NAXIS2"])
        each = max(1, range_bytes // max(1, width))
        tasks = max(1, -(-rows // each))

        def ranges(batches):
            with _open(path) as file:
                for b in batches:
                    for k in b.column(0).to_pylist():
                        n = min(each, rows - k * each)
                        if n > 0:
                            yield from row_batches(cards, file.read_at(n * width, start + k * each * width), 0, n, wanted)

        return spark.range(0, tasks, 1, tasks).mapInArrow(ranges, ", ".join(f"`{n}` {kinds[n]}" for n in wanted))
    files = spark.read.format("binaryFile").load(path)
    head = files.select(F.substring("content", 1, 1 << 20).alias("c")).limit(1).collect()
    if not head:
        raise FileNotFoundError(path)
    kinds = table_schema(bytes(head[0]["c"]), names)
    wanted = _wanted(kinds, names)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                yield from table_batches(content.as_py(), wanted)

    return files.select("content").mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in wanted))


def _is_folder(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(file):
        raise FileNotFoundError(path)
    return store.getFileStatus(file).isDirectory()


def _beams(paths: pa.Array, contents: pa.Array) -> pa.Array:
    rows = []
    for c in contents:
        try:
            cards = header(c.as_py())[0]
            rows.append({k: float(cards[k]) if k in cards else None for k in ("BMAJ", "BMIN", "BPA", "RESTFRQ")})
        except (ValueError, TypeError):
            rows.append(dict.fromkeys(("BMAJ", "BMIN", "BPA", "RESTFRQ")))
    return pa.array(rows, pa.struct([(k, pa.float64()) for k in ("BMAJ", "BMIN", "BPA", "RESTFRQ")]))


def _heads(paths: pa.Array) -> pa.Array:
    out = []
    for p in paths:
        try:
            with _open(p.as_py()) as file:
                out.append(bytes(file.read_at(min(HEAD, file.size()), 0)))
        except OSError:
            out.append(b"")
    return pa.array(out, pa.binary())


def read_beams(spark: SparkSession, path: str) -> DataFrame:
    """(path, BMAJ, BMIN, BPA, RESTFRQ) of image headers; what cannot be read is null."""
    files = spark.read.format("binaryFile").load(path)
    beams = F.arrow_udf(_beams, "struct<BMAJ:double,BMIN:double,BPA:double,RESTFRQ:double>")
    if seekable(re.sub(r"[*?{\[].*", "", path)):  # of each file the header alone
        files = files.select("path", F.arrow_udf(_heads, "binary")("path").alias("c"))
    else:
        files = files.select("path", F.substring("content", 1, HEAD).alias("c"))
    return files.select("path", beams("path", "c").alias("b")).select("path", "b.*")


def median_beam(beams: DataFrame) -> DataFrame:
    return beams.agg(*[F.percentile(c, 0.5).alias(c) for c in ("BMAJ", "BMIN", "BPA")])


def read_healpix(spark: SparkSession, path: str, to_nested: bool = True) -> DataFrame:
    """(ipix, value) of the first column of a HEALPix table, one row per pixel."""
    from skyloom.operators.healpix import ring_to_nest

    files = spark.read.format("binaryFile").load(path).select("content")
    cards, _ = table_unit(bytes(files.select(F.substring("content", 1, 1 << 20).alias("c")).first()["c"]))
    nside, ordering = int(cards["NSIDE"]), str(cards.get("ORDERING", "RING")).upper()

    def run(batches):
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                own, start = table_unit(data)
                _, kind, repeat, at = columns(own)[0]
                dtype = np.dtype(_TYPES[kind])
                for row in range(int(own["NAXIS2"])):
                    v = np.frombuffer(data, dtype, repeat, start + row * int(own["NAXIS1"]) + at).astype(float)
                    ipix = np.arange(row * repeat, (row + 1) * repeat, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ipix), pa.array(v, mask=~np.isfinite(v) | (v < -1.6e30))], names=["ipix", "value"])

    out = files.mapInArrow(run, "ipix long, value double")
    if to_nested and ordering.startswith("RING"):
        out = out.withColumn("ipix", ring_to_nest(F.col("ipix"), nside))
    return out


def write_bytes(path: str, content: bytes, spark: SparkSession | None = None) -> None:
    """A small file, on any store that Spark reaches or, without a session, a local one."""
    if spark is None:
        with open(path, "wb") as f:
            f.write(content)
        return
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True)
    stream.write(bytearray(content))
    stream.close()


def card_block(items) -> bytes:
    """A header of (key, value) cards, filled up to whole blocks."""
    text = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in items) + "END".ljust(80)
    return text.ljust(-(-len(text) // _BLOCK) * _BLOCK).encode()


def write_table(path: str, cols: dict[str, Sequence], spark: SparkSession | None = None, extra: Sequence[tuple] = ()) -> None:
    """A small binary table (numbers and text) as a file: fixtures and sidecars."""
    arrays, fields, cards = [], [], []
    for k, (name, values) in enumerate(cols.items(), 1):
        v = np.asarray(values)
        if v.dtype.kind in "USO":
            v = np.char.encode(v.astype(str), "utf-8")
            form = f"{v.dtype.itemsize}A"
        else:
            kind = "D" if v.dtype.kind == "f" else "K" if v.dtype.kind in "iu" else "L"
            v = np.where(v, 84, 70).astype("i1") if kind == "L" else v.astype(_TYPES[kind])
            form = f"1{kind}"
        arrays.append(v)
        fields.append((name, v.dtype))
        cards += [(f"TTYPE{k}", f"'{name}'"), (f"TFORM{k}", f"'{form:<8}'")]
    rows = np.empty(len(arrays[0]), fields)
    for (name, _), v in zip(fields, arrays):
        rows[name] = v
    body = rows.tobytes()
    table = [("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(cols)), *cards, *extra]
    write_bytes(path, card_block([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)]) + card_block(table) + body + b"\0" * (-len(body) % _BLOCK), spark)
