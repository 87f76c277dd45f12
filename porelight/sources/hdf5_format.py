"""Reading and writing of HDF5 files in pure Python, after the public format specification.

Read: superblocks 0 to 3, object headers 1 and 2 with continuations, groups as
symbol tables and as link messages, scalar and one-dimensional datasets
(compact, contiguous, chunked by a version 1 B-tree, with deflate, shuffle and
checksum filters), attributes, and the types integer, float, fixed and variable
string and compound, nested too. Written: superblock 0, version 1 headers,
symbol tables, contiguous datasets. Other features raise ``Hdf5Error`` with the
object's path.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from dataclasses import dataclass, field
from typing import Any

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = 0xFFFFFFFFFFFFFFFF


class Hdf5Error(ValueError):
    pass


@dataclass
class Kind:
    """A type on file: class ``int``, ``uint``, ``float``, ``string``, ``vlen`` or ``struct``."""

    name: str
    size: int
    members: list[tuple[str, int, "Kind"]] = field(default_factory=list)
    order: str = "<"

    @property
    def numpy(self) -> np.dtype:
        if self.name in ("int", "uint", "float"):
            return np.dtype(f"{self.order}{ {'int': 'i', 'uint': 'u', 'float': 'f'}[self.name]}{self.size}")
        if self.name == "string":
            return np.dtype(f"S{self.size}")
        if self.name == "vlen":
            return np.dtype([("n", "<u4"), ("at", "<u8"), ("k", "<u4")])
        return np.dtype({"names": [m[0] for m in self.members], "formats": [m[2].numpy for m in self.members], "offsets": [m[1] for m in self.members], "itemsize": self.size})


def is_valid(data: bytes) -> bool:
    """Is this a whole HDF5 file? Catches truncation by the end-of-file address."""
    try:
        return len(data) > 0 and Reader(data).end_of_file <= len(data)
    except (Hdf5Error, struct.error, IndexError):
        return False


class Reader:
    """One file in memory. Paths start with ``/``; children are listed in order of name."""

    def __init__(self, data: bytes):
        self.data = data
        self.base = next((at for at in [0, *(512 << k for k in range(20))] if data[at : at + 8] == SIGNATURE), None)
        if self.base is None:
            raise Hdf5Error("no HDF5 signature")
        at = self.base + 8
        version = data[at]
        if version < 2:
            if data[at + 5] != 8 or data[at + 6] != 8:
                raise Hdf5Error("only 8-byte offsets and lengths")
            at += 16 + (4 if version == 1 else 0)
            self.end_of_file = self._u64(at + 16)
            self.root = self._u64(at + 32 + 8)
        else:
            if data[at + 1] != 8 or data[at + 2] != 8:
                raise Hdf5Error("only 8-byte offsets and lengths")
            self.end_of_file = self._u64(at + 4 + 16)
            self.root = self._u64(at + 4 + 24)
        self._messages: dict[int, list[tuple[int, bytes]]] = {}
        self._heaps: dict[int, dict[int, bytes]] = {}
        self._children: dict[int, dict[str, int]] = {}
        self._kinds: dict[bytes, tuple[Kind, int]] = {}

    def _u64(self, at: int) -> int:
        return struct.unpack_from("<Q", self.data, at)[0]

    # object headers -----------------------------------------------------------
    def messages(self, at: int) -> list[tuple[int, bytes]]:
        if at not in self._messages:
            self._messages[at] = self._header2(at) if self.data[self.base + at : self.base + at + 4] == b"OHDR" else self._header1(at)
        return self._messages[at]

    def _header1(self, at: int) -> list[tuple[int, bytes]]:
        p = self.base + at
        version, _, n, _, size = struct.unpack_from("<BBHII", self.data, p)
        if version != 1:
            raise Hdf5Error(f"object header version {version}")
        blocks, out = [(p + 16, size)], []
        while blocks and len(out) < n:
            p, left = blocks.pop(0)
            while left >= 8 and len(out) < n:
                kind, length, _ = struct.unpack_from("<HHB", self.data, p)
                body = self.data[p + 8 : p + 8 + length]
                out.append((kind, body))
                if kind == 0x10:
                    to, more = struct.unpack("<QQ", body[:16])
                    blocks.append((self.base + to, more))
                p, left = p + 8 + length, left - 8 - length
        return out

    def _header2(self, at: int) -> list[tuple[int, bytes]]:
        p = self.base + at
        flags = self.data[p + 5]
        p += 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
        width = 1 << (flags & 3)
        size = int.from_bytes(self.data[p : p + width], "little")
        blocks, out, extra = [(p + width, size)], [], 2 if flags & 4 else 0
        while blocks:
            p, left = blocks.pop(0)
            while left >= 4 + extra:
                kind, length, _ = struct.unpack_from("<BHB", self.data, p)
                body = self.data[p + 4 + extra : p + 4 + extra + length]
                out.append((kind, body))
                if kind == 0x10:
                    to, more = struct.unpack("<QQ", body[:16])
                    blocks.append((self.base + to + 4, more - 8))
                p, left = p + 4 + extra + length, left - 4 - extra - length
        return out

    # groups -------------------------------------------------------------------
    def children(self, at: int) -> dict[str, int]:
        """Name to header address, in order of name. Kept, for each path is found from the root."""
        if at not in self._children:
            self._children[at] = self._listed(at)
        return self._children[at]

    def _listed(self, at: int) -> dict[str, int]:
        out: dict[str, int] = {}
        for kind, body in self.messages(at):
            if kind == 0x11:
                tree, heap = struct.unpack("<QQ", body[:16])
                names = self._u64(self.base + heap + 24)
                self._symbols(tree, self.base + names, out)
            elif kind == 0x06:
                flags, p = body[1], 2
                link = body[p] if flags & 8 else 0
                p += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                width = 1 << (flags & 3)
                n = int.from_bytes(body[p : p + width], "little")
                name = body[p + width : p + width + n].decode()
                if link == 0:
                    out[name] = struct.unpack_from("<Q", body, p + width + n)[0]
            elif kind == 0x02 and struct.unpack_from("<Q", body, 2 + (8 if body[1] & 1 else 0))[0] != UNDEFINED:
                raise Hdf5Error("groups in a fractal heap are not read")
        return dict(sorted(out.items()))

    def _symbols(self, node: int, names: int, out: dict[str, int]) -> None:
        p = self.base + node
        if self.data[p : p + 4] == b"TREE":
            n = struct.unpack_from("<H", self.data, p + 6)[0]
            for k in range(n):
                self._symbols(self._u64(p + 24 + 16 * k + 8), names, out)
        elif self.data[p : p + 4] == b"SNOD":
            for k in range(struct.unpack_from("<H", self.data, p + 6)[0]):
                name, header, cache = struct.unpack_from("<QQI", self.data, p + 8 + 40 * k)
                if cache != 2:  # a symbolic link
                    start = names + name
                    out[self.data[start : self.data.index(b"\0", start)].decode()] = header
        else:
            raise Hdf5Error("damaged group")

    def find(self, path: str) -> int | None:
        at = self.root
        for name in path.strip("/").split("/") if path.strip("/") else []:
            found = self.children(at).get(name) if self.is_group(at) else None
            if found is None:
                return None
            at = found
        return at

    def is_group(self, at: int) -> bool:
        return any(kind in (0x11, 0x02, 0x06) for kind, _ in self.messages(at)) or not self.is_dataset(at)

    def is_dataset(self, at: int) -> bool:
        return any(kind == 0x08 for kind, _ in self.messages(at))

    def walk(self, path: str = "/"):
        """(path, header address) of every object at and below a path, parents first."""
        top = self.find(path)
        todo = deque([] if top is None else [(path, top)])
        while todo:
            path, at = todo.popleft()
            yield path, at
            if not self.is_dataset(at):
                todo += [(f"{path.rstrip('/')}/{name}", to) for name, to in self.children(at).items()]

    # types and data -------------------------------------------------------------
    def kind(self, body: bytes) -> tuple[Kind, int]:
        """The type and the length of its message. Kept, for a file has few types and many objects."""
        if body not in self._kinds:
            self._kinds[body] = self._kind(body)
        return self._kinds[body]

    def _kind(self, body: bytes) -> tuple[Kind, int]:
        version, cls = body[0] >> 4, body[0] & 15
        size = struct.unpack_from("<I", body, 4)[0]
        order = ">" if body[1] & 1 else "<"
        if cls == 0:
            return Kind("int" if body[1] & 8 else "uint", size, order=order), 12
        if cls == 1:
            return Kind("float", size, order=order), 20
        if cls == 3:
            return Kind("string", size), 8
        if cls == 9:
            if body[1] & 15 != 1:
                raise Hdf5Error("variable-length sequences are not read")
            return Kind("vlen", size), 8 + self.kind(body[8:])[1]
        if cls == 8:  # an enumeration is read as its integers
            inner, used = self.kind(body[8:])
            n, p = struct.unpack_from("<H", body, 1)[0], 8 + used
            for _ in range(n):
                end = body.index(b"\0", p)
                p = end + 1 if version >= 3 else p + (end - p) // 8 * 8 + 8
            return inner, p + n * inner.size
        if cls == 6:
            p, members = 8, []
            for _ in range(struct.unpack_from("<H", body, 1)[0]):
                end = body.index(b"\0", p)
                name = body[p:end].decode()
                if version >= 3:
                    width = max(1, (size.bit_length() + 7) // 8)
                    p = end + 1
                    offset = int.from_bytes(body[p : p + width], "little")
                    p += width
                else:
                    p += (end - p) // 8 * 8 + 8
                    offset = struct.unpack_from("<I", body, p)[0]
                    p += 4 + (28 if version == 1 else 0)
                inner, used = self.kind(body[p:])
                members.append((name, offset, inner))
                p += used
            return Kind("struct", size, members), p
        raise Hdf5Error(f"type class {cls} is not read")

    @staticmethod
    def extent(body: bytes) -> int | None:
        """Number of elements; None for a scalar."""
        version, rank = body[0], body[1]
        if version == 2 and body[3] == 2 or rank > 1:
            raise Hdf5Error("only scalars and one dimension")
        return None if rank == 0 else struct.unpack_from("<Q", body, 8 if version == 1 else 4)[0]

    def _heap(self, at: int, index: int) -> bytes:
        if at not in self._heaps:
            p = self.base + at
            if self.data[p : p + 4] != b"GCOL":
                raise Hdf5Error("damaged string heap")
            end, objects = p + self._u64(p + 8), {}
            p += 16
            while p + 16 <= end:
                k, _, _, size = struct.unpack_from("<HHIQ", self.data, p)
                if k == 0:
                    break
                objects[k] = self.data[p + 16 : p + 16 + size]
                p += 16 + (size + 7) // 8 * 8
            self._heaps[at] = objects
        return self._heaps[at].get(index, b"")

    def decode(self, raw: bytes, kind: Kind, n: int | None) -> Any:
        """Python values: numbers, strings, dicts, or a list of them."""
        values = np.frombuffer(raw, kind.numpy, count=1 if n is None else n)
        out = self._values(values, kind)
        return out[0] if n is None else out

    def _values(self, values: np.ndarray, kind: Kind) -> list:
        if kind.name == "string":
            return [v.split(b"\0", 1)[0].decode("utf-8", "replace") for v in values.tolist()]
        if kind.name == "vlen":
            return [self._heap(at, k)[:size].split(b"\0", 1)[0].decode("utf-8", "replace") if size else "" for size, at, k in values.tolist()]
        if kind.name == "struct":
            columns = [self._values(values[name], inner) for name, _, inner in kind.members]
            return [dict(zip([m[0] for m in kind.members], row)) for row in zip(*columns)] if len(values) else []
        return values.tolist()

    def dataset(self, at: int) -> tuple[Kind, int | None, bytes]:
        """(type, number of elements, the elements' bytes)."""
        parts = dict(self.messages(at))
        kind, n = self.kind(parts[0x03])[0], self.extent(parts[0x01])
        size = kind.size * (1 if n is None else n)
        body = parts[0x08]
        if body[0] == 3:
            layout, p = body[1], 2
        elif body[0] in (1, 2):
            return kind, n, self._old_layout(body, size, parts, kind)
        else:
            raise Hdf5Error(f"data layout version {body[0]} is not read")
        if layout == 0:
            return kind, n, body[p + 2 : p + 2 + size]
        if layout == 1:
            address = struct.unpack_from("<Q", body, p)[0]
            return kind, n, bytes(size) if address == UNDEFINED else self.data[self.base + address : self.base + address + size]
        rank, tree = body[p], struct.unpack_from("<Q", body, p + 1)[0]
        chunk = struct.unpack_from("<I", body, p + 9)[0]
        return kind, n, self._chunks(tree, chunk, rank - 1, kind, size, self._filters(parts.get(0x0B)))

    def _old_layout(self, body: bytes, size: int, parts: dict, kind: Kind) -> bytes:
        rank, layout, p = body[1], body[2], 8
        address = UNDEFINED
        if layout != 0:
            address, p = struct.unpack_from("<Q", body, p)[0], p + 8
        dims = struct.unpack_from(f"<{rank}I", body, p)
        if layout == 0:
            return body[p + 4 * rank + 4 : p + 4 * rank + 4 + size]
        if layout == 1:
            return bytes(size) if address == UNDEFINED else self.data[self.base + address : self.base + address + size]
        return self._chunks(address, dims[0], rank - 1, kind, size, self._filters(parts.get(0x0B)))

    @staticmethod
    def _filters(body: bytes | None) -> list[tuple[int, list[int]]]:
        out, p = [], 0
        if body:
            version, n = body[0], body[1]
            p = 8 if version == 1 else 2
            for _ in range(n):
                kind = struct.unpack_from("<H", body, p)[0]
                named = version == 1 or kind >= 256
                name = struct.unpack_from("<H", body, p + 2)[0] if named else 0
                p += 4 if named else 2
                _, values = struct.unpack_from("<HH", body, p)
                p += 4 + ((name + 7) // 8 * 8 if version == 1 else name)
                out.append((kind, list(struct.unpack_from(f"<{values}I", body, p))))
                p += 4 * values + (4 if version == 1 and values % 2 else 0)
        return out

    def _chunks(self, tree: int, chunk: int, rank: int, kind: Kind, size: int, filters) -> bytes:
        out = bytearray(size)

        def node(at: int) -> None:
            p = self.base + at
            if self.data[p : p + 4] != b"TREE":
                raise Hdf5Error("damaged chunk index")
            level, n = self.data[p + 5], struct.unpack_from("<H", self.data, p + 6)[0]
            key = 8 + 8 * (rank + 1)
            p += 24
            for _ in range(n):
                length, mask = struct.unpack_from("<II", self.data, p)
                first = self._u64(p + 8) if rank else 0
                child = self._u64(p + key)
                if level:
                    node(child)
                else:
                    raw = self.data[self.base + child : self.base + child + length]
                    for k in range(len(filters) - 1, -1, -1):
                        if not mask >> k & 1:
                            raw = _unfilter(raw, *filters[k])
                    lo = first * kind.size
                    hi = min(size, lo + chunk * kind.size)
                    out[lo:hi] = raw[: hi - lo]
                p += key + 8

        if tree != UNDEFINED:
            node(tree)
        return bytes(out)

    def array(self, at: int) -> tuple[Kind, np.ndarray]:
        """The type and the elements of a dataset of one dimension, as they lie on file."""
        kind, n, raw = self.dataset(at)
        return kind, np.frombuffer(raw, kind.numpy, count=1 if n is None else n)

    def read(self, at: int) -> Any:
        kind, n, raw = self.dataset(at)
        return self.decode(raw, kind, n)

    def attributes(self, at: int) -> dict[str, tuple[Kind, int | None, Any]]:
        """Name to (type, number of elements, value), in order of name."""
        out = {}
        for code, body in self.messages(at):
            if code == 0x15 and struct.unpack_from("<Q", body, 2 + (2 if body[1] & 1 else 0))[0] != UNDEFINED:
                raise Hdf5Error("attributes in a fractal heap are not read")
            if code != 0x0C:
                continue
            version = body[0]
            name_size, type_size, space_size = struct.unpack_from("<HHH", body, 2)
            p = 9 if version == 3 else 8
            pad = (lambda x: (x + 7) // 8 * 8) if version == 1 else (lambda x: x)
            name = body[p : p + name_size].split(b"\0", 1)[0].decode()
            p += pad(name_size)
            kind = self.kind(body[p : p + type_size])[0]
            p += pad(type_size)
            n = self.extent(body[p : p + space_size])
            p += pad(space_size)
            out[name] = (kind, n, self.decode(body[p : p + kind.size * (1 if n is None else n)], kind, n))
        return dict(sorted(out.items()))


def _unfilter(raw: bytes, kind: int, values: list[int]) -> bytes:
    if kind == 1:
        return zlib.decompress(raw)
    if kind == 2:
        size = values[0]
        n = len(raw) // size
        return np.frombuffer(raw[: n * size], np.uint8).reshape(size, n).T.tobytes() + raw[n * size :]
    if kind == 3:
        return raw[:-4]
    raise Hdf5Error(f"filter {kind} is not read")


def as_text(value: Any) -> str:
    """A value as attribute maps show it: integers exactly, floats with six digits, a sequence of characters joined."""
    if isinstance(value, float):
        return f"{value:g}"
    if isinstance(value, list):
        return "".join(value) if all(isinstance(v, str) and len(v) <= 1 for v in value) else ",".join(map(as_text, value))
    return str(value)


# writing -----------------------------------------------------------------------------
@dataclass
class Fixed:
    """A string of a fixed length on file, cut to ``size`` - 1 and a NUL if it is longer."""

    value: str
    size: int


class Writer:
    """Collects groups, datasets and attributes; ``bytes()`` makes the file.

    Values are ints (8 bytes), floats, strings (of variable length), ``Fixed``,
    numpy scalars, numpy arrays (structured ones too) and lists of strings. An
    object that is there already, and an empty sequence, are errors.
    """

    def __init__(self):
        self.objects: dict[str, Any] = {"/": None}
        self.attrs: dict[str, dict[str, Any]] = {}
        self.below: dict[str, list[str]] = {}
        self.kinds: dict[np.dtype, bytes] = {}

    def _new(self, path: str, value: Any) -> None:
        self.objects[path] = value
        above, name = path.rsplit("/", 1)
        self.below.setdefault(above or "/", []).append(name)

    def group(self, path: str) -> None:
        path = "/" + path.strip("/")
        while path not in self.objects:
            self._new(path, None)
            path = path.rsplit("/", 1)[0] or "/"
        if self.objects[path] is not None:
            raise Hdf5Error(f"{path} is a dataset")

    def dataset(self, path: str, value: Any) -> None:
        if path in self.objects:
            raise Hdf5Error(f"{path} exists")
        self._check(path, value)
        self.group(path.rsplit("/", 1)[0])
        self._new(path, (value,))

    def attribute(self, path: str, name: str, value: Any) -> None:
        if name in self.attrs.get(path, {}):
            raise Hdf5Error(f"{path}@{name} exists")
        self._check(f"{path}@{name}", value)
        if path not in self.objects:
            self.group(path)
        self.attrs.setdefault(path, {})[name] = value

    @staticmethod
    def _check(path: str, value: Any) -> None:
        if isinstance(value, (list, np.ndarray)) and not len(value):
            raise Hdf5Error(f"{path}: an empty sequence can't be written")

    def bytes(self) -> bytes:
        self.out = bytearray(96)
        self.heap, self.heap_end, self.heap_used, self.heap_objects = 0, 0, 0, 0
        root = self._object("/")
        end = len(self.out)
        cache = struct.pack("<QQIIQQ", 0, root, 0, 0, 0, 0)
        self.out[:96] = SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, UNDEFINED, end, UNDEFINED) + cache
        return bytes(self.out)

    def _add(self, data: bytes) -> int:
        self.out += bytes(-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    def _object(self, path: str) -> int:
        own = self.objects[path]
        if own is None:
            prefix = path.rstrip("/") + "/"
            messages = [(0x11, self._symbol_table({n: self._object(prefix + n) for n in sorted(self.below.get(path, ()))}))]
        else:
            kind, space, raw = self._encode(own[0])
            messages = [(0x01, space), (0x03, kind), (0x05, bytes([2, 2, 0, 0])), (0x08, bytes([3, 1]) + struct.pack("<QQ", self._add(raw), len(raw)))]
        for name, value in sorted(self.attrs.get(path, {}).items()):
            kind, space, raw = self._encode(value)
            label = name.encode() + b"\0"
            pad = lambda b: b + bytes(-len(b) % 8)
            messages.append((0x0C, struct.pack("<BBHHH", 1, 0, len(label), len(kind), len(space)) + pad(label) + pad(kind) + pad(space) + raw))
        body = b"".join(struct.pack("<HHBBBB", k, len(m) + -len(m) % 8, 0, 0, 0, 0) + m + bytes(-len(m) % 8) for k, m in messages)
        return self._add(struct.pack("<BBHII", 1, 0, len(messages), 1, len(body)) + bytes(4) + body)

    def _symbol_table(self, children: dict[str, int]) -> bytes:
        names, offsets = bytearray(8), {}
        for n in children:
            offsets[n] = len(names)
            names += n.encode() + b"\0"
            names += bytes(-len(names) % 8)
        free = len(names)
        names += struct.pack("<QQ", 1, 16)
        segment = self._add(bytes(names))
        heap = self._add(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(names), free, segment))
        entries = list(children.items())
        nodes = []
        for lo in range(0, max(len(entries), 1), 8):
            part = entries[lo : lo + 8]
            node = b"SNOD" + bytes([1, 0]) + struct.pack("<H", len(part)) + b"".join(struct.pack("<QQIIQQ", offsets[n], at, 0, 0, 0, 0) for n, at in part)
            nodes.append((self._add(node.ljust(8 + 8 * 40, b"\0")), offsets[part[-1][0]] if part else 0))
        level = 0
        first = 0
        while True:
            tops = []
            for lo in range(0, len(nodes), 32):
                part = nodes[lo : lo + 32]
                tree = b"TREE" + bytes([0, level]) + struct.pack("<HQQQ", len(part) if entries else 0, UNDEFINED, UNDEFINED, first) + b"".join(struct.pack("<QQ", at, key) for at, key in part)
                tops.append((self._add(tree.ljust(24 + 8 + 32 * 16, b"\0")), part[-1][1]))
                first = part[-1][1]
            nodes, level, first = tops, level + 1, 0
            if len(nodes) == 1:
                return struct.pack("<QQ", nodes[0][0], heap)

    def _encode(self, value: Any) -> tuple[bytes, bytes, bytes]:
        """(type message, dataspace message, data)."""
        many = isinstance(value, (list, np.ndarray))
        n = len(value) if many else 1
        space = struct.pack("<BBBB4xQ", 1, 1, 0, 0, n) if many else struct.pack("<BBBB4x", 1, 0, 0, 0)
        if isinstance(value, str) or many and isinstance(value, list):
            return self._vlen_kind(), space, b"".join(self._vlen(v) for v in (value if many else [value]))
        if isinstance(value, Fixed):
            raw = value.value.encode()
            raw = raw if len(raw) <= value.size and "\0" not in value.value and len(raw) < value.size else raw[: value.size - 1]
            return struct.pack("<BBBBI", 0x13, 0, 0, 0, value.size), space, raw.ljust(value.size, b"\0")
        array = value if many else np.array([value], np.float64 if isinstance(value, float) else np.int64 if isinstance(value, int) else None)
        array = array.astype(array.dtype.newbyteorder("<"), copy=False)
        if array.dtype not in self.kinds:
            self.kinds[array.dtype] = self._kind(array.dtype)
        return self.kinds[array.dtype], space, array.tobytes()

    def _kind(self, t: np.dtype) -> bytes:
        if t.names:
            out = struct.pack("<BHBI", 0x16, len(t.names), 0, t.itemsize)
            for name in t.names:
                inner, offset = t.fields[name][:2]
                label = name.encode() + b"\0"
                out += label + bytes(-len(label) % 8) + struct.pack("<IB3xI4x4I", offset, 0, 0, 0, 0, 0, 0) + self._kind(inner)
            return out
        if t.kind in "iu":
            return struct.pack("<BBBBIHH", 0x10, 8 if t.kind == "i" else 0, 0, 0, t.itemsize, 0, 8 * t.itemsize)
        if t.kind == "f":
            exponent, mantissa, bias = {4: (8, 23, 127), 8: (11, 52, 1023)}[t.itemsize]
            return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 8 * t.itemsize - 1, 0, t.itemsize, 0, 8 * t.itemsize, mantissa, exponent, 0, mantissa, bias)
        if t.kind == "S":
            return struct.pack("<BBBBI", 0x13, 0, 0, 0, t.itemsize)
        raise Hdf5Error(f"type {t} can't be written")

    @staticmethod
    def _vlen_kind() -> bytes:
        return struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + struct.pack("<BBBBI", 0x13, 0, 0, 0, 1)

    def _vlen(self, text: str) -> bytes:
        """A reference to the text in a heap collection, which takes texts until it is full."""
        raw = text.encode() + b"\0"
        size = 16 + len(raw) + -len(raw) % 8
        if self.heap_used + size + 16 > self.heap_end or self.heap_objects == 0xFFFF:
            whole = max(4096, 16 + size + 16)
            self.heap = self._add(b"GCOL" + bytes([1, 0, 0, 0]) + struct.pack("<Q", whole) + bytes(whole - 16))
            self.heap_used, self.heap_end, self.heap_objects = self.heap + 16, self.heap + whole, 0
        self.heap_objects += 1
        at, self.heap_used = self.heap_used, self.heap_used + size
        self.out[at : at + 16 + len(raw)] = struct.pack("<HHIQ", self.heap_objects, 0, 0, len(raw)) + raw
        self.out[self.heap_used : self.heap_used + 16] = struct.pack("<HHIQ", 0, 0, 0, self.heap_end - self.heap_used)
        return struct.pack("<IQI", len(raw), self.heap, self.heap_objects)
