"""PLY point clouds as a Spark data source: ``spark.read.format("ply")`` and ``df.write.format("ply")``.

The header gives the schema. Records of a binary vertex element have a fixed size, so a
file is split in byte ranges and each task reads only its own; ASCII files and files with
list properties are read whole by one task a file. The writer makes one file a partition.
Paths go through pyarrow's file systems, so any store it reaches will do.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# PLY scalar names, their numpy kinds and Spark types (fixed values of the format).
KINDS = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
SPARK = {"i1": "short", "u1": "short", "i2": "int", "u2": "int", "i4": "int", "u4": "long", "f4": "double", "f8": "double"}
RENAME = {"red": "r", "green": "g", "blue": "b", "view": "view_id"}
BLOCK = 4 << 20


def files_of(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def paths_below(uri: str, suffix: str) -> list[str]:
    """Files of a path: itself, or those of a folder with the suffix."""
    from pyarrow import fs

    files, path = files_of(uri)
    info = files.get_file_info(path)
    if info.type == fs.FileType.File:
        return [uri]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    head = uri.rstrip("/")
    found = files.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(f"{head}/{f.path[len(path.rstrip('/')) + 1 :]}" for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))


@dataclass
class Element:
    name: str
    count: int
    fields: list[tuple[str, str]]  # (property, numpy kind)
    lists: bool = False

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, k) for n, k in self.fields])


@dataclass
class Header:
    kind: str  # ascii, binary_little_endian or binary_big_endian
    elements: list[Element]
    size: int  # bytes up to the first record

    def element(self, name: str) -> Element | None:
        return next((e for e in self.elements if e.name == name), None)


def read_header(stream) -> Header:
    raw, kind, elements = b"", "", []
    while not raw.endswith(b"end_header\n"):
        ch = stream.read(1)
        if not ch or len(raw) > 1 << 16:
            raise ValueError("the PLY header does not end")
        raw += ch
        if ch != b"\n":
            continue
        words = raw[:-1].rsplit(b"\n", 1)[-1].decode("ascii", "replace").split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            elements.append(Element(words[1], int(words[2]), []))
        elif words[:2] == ["property", "list"]:
            elements[-1].lists = True
            elements[-1].fields.append((words[4], "list"))
        elif words[:1] == ["property"]:
            order = ">" if kind == "binary_big_endian" else "<"
            elements[-1].fields.append((words[2], order + KINDS[words[1]]))
    if not raw.startswith(b"ply"):
        raise ValueError("not a PLY file")
    return Header(kind, elements, len(raw))


@dataclass
class Piece(InputPartition):
    path: str
    first: int
    count: int

    def __init__(self, path: str, first: int, count: int):
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


class PlySource(DataSource):
    """Options: path, element (vertex or camera)."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _element(self) -> str:
        return self.options.get("element", "vertex")

    def schema(self) -> str:
        first = paths_below(self.options["path"], ".ply")[0]
        files, path = files_of(first)
        with files.open_input_stream(path, compression=None) as s:
            e = read_header(s).element(self._element())
        if e is None:
            raise ValueError(f"no element {self._element()} in {first}")
        columns = [f"{RENAME.get(n, n)} {SPARK[k[1:]]}" for n, k in e.fields if k != "list"]
        id_ = "view_id int" if self._element() == "camera" else "point_id long"
        return ", ".join(["scene_id string", id_, *columns])

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options, self._element(), [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], [f.name for f in schema.fields])


class PlyReader(DataSourceReader):
    def __init__(self, options, element: str, columns: list[str]):
        self.path, self.element, self.columns = options["path"], element, columns

    def partitions(self):
        out = []
        for p in paths_below(self.path, ".ply"):
            files, path = files_of(p)
            with files.open_input_stream(path, compression=None) as s:
                h = read_header(s)
            e = h.element(self.element)
            if e is None:
                continue
            step = e.count if h.kind == "ascii" or any(x.lists for x in h.elements) else max(1, BLOCK // max(1, e.dtype.itemsize))
            out += [Piece(p, at, min(step, e.count - at)) for at in range(0, e.count, max(1, step))]
        return out

    def read(self, piece):
        import pyarrow as pa

        files, path = files_of(piece.path)
        with files.open_input_stream(path, compression=None) as s:
            h = read_header(s)
        e = h.element(self.element)
        if h.kind == "ascii" or any(x.lists for x in h.elements):
            rec = self._whole(files, path, h, e)
        else:
            at = h.size
            for x in h.elements:
                if x is e:
                    break
                at += x.count * x.dtype.itemsize
            with files.open_input_file(path) as f:
                rec = np.frombuffer(f.read_at(piece.count * e.dtype.itemsize, at + piece.first * e.dtype.itemsize), e.dtype)
        scene = path.rsplit("/", 1)[-1].removesuffix(".ply")
        ids = np.arange(piece.first, piece.first + len(rec))
        kinds = dict(e.fields)
        back = {RENAME.get(n, n): n for n in kinds}
        arrays = []
        for c in self.columns:
            if c == "scene_id":
                arrays.append(pa.array([scene] * len(rec), pa.string()))
            elif c in ("point_id", "view_id") and c not in back:
                arrays.append(pa.array(ids, pa.int32() if c == "view_id" else pa.int64()))
            elif c in back:
                wide = {"short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[SPARK[kinds[back[c]][1:]]]
                arrays.append(pa.array(rec[back[c]].astype(rec[back[c]].dtype.newbyteorder("=")), wide, safe=False) if wide != pa.float64() else pa.array(rec[back[c]].astype(np.float64)))
            else:
                arrays.append(pa.nulls(len(rec), pa.float64()))
        yield pa.RecordBatch.from_arrays(arrays, names=self.columns)

    def _whole(self, files, path, h: Header, e: Element):
        """Records of an ASCII file or of one with list properties, element after element."""
        with files.open_input_file(path) as f:
            raw = f.read()[h.size :]
        words = raw.split() if h.kind == "ascii" else None
        at = 0
        order = ">" if h.kind == "binary_big_endian" else "<"
        for x in h.elements:
            plain = [(n, k) for n, k in x.fields if k != "list"]
            rec = np.zeros(x.count, np.dtype([(n, k) for n, k in plain]))
            for i in range(x.count):
                for n, k in x.fields:
                    if k == "list":
                        if words is not None:
                            at += 1 + int(words[at])
                        else:  # the usual face list: uchar count, int items
                            at += 1 + 4 * raw[at]
                    elif words is not None:
                        rec[n][i] = float(words[at])
                        at += 1
                    else:
                        rec[n][i] = np.frombuffer(raw, np.dtype(k).newbyteorder(order), 1, at)[0]
                        at += np.dtype(k).itemsize
            if x is e:
                return rec
        raise ValueError("element is missing")


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class PlyWriter(DataSourceWriter):
    """Binary little-endian vertices: x, y, z and, where the table has them, normals, colours, view."""

    LAYOUT = [("x", "x", "f4"), ("y", "y", "f4"), ("z", "z", "f4"), ("nx", "nx", "f4"), ("ny", "ny", "f4"), ("nz", "nz", "f4"), ("r", "red", "u1"), ("g", "green", "u1"), ("b", "blue", "u1"), ("view_id", "view", "i4")]
    WORDS = {"f4": "float", "u1": "uchar", "i4": "int"}

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def write(self, rows):
        layout = [(c, n, k) for c, n, k in self.LAYOUT if c in self.columns]
        values: list[tuple] = [tuple((0 if r[c] is None else r[c]) for c, _, _ in layout) for r in rows]
        rec = np.array(values, np.dtype([(n, "<" + k) for _, n, k in layout]))
        head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(rec)}", *[f"property {self.WORDS[k]} {n}" for _, n, k in layout], "end_header\n"]
        uri = self.path if self.path.endswith(".ply") else f"{self.path.rstrip('/')}/part-{uuid.uuid4().hex}.ply"
        files, path = files_of(uri)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(path, compression=None) as out:
            out.write("\n".join(head).encode("ascii") + rec.tobytes())
        return Written(uri, len(rec))

    def commit(self, messages):
        pass

    def abort(self, messages):
        for m in messages:
            if m is not None:
                files, path = files_of(m.path)
                files.delete_file(path)


def register(spark) -> None:
    spark.dataSource.register(PlySource)
