"""BAM files: a splittable source that gives SAM lines, and parts of a BAM file from SAM lines.

A BAM file is a row of gzip members of at most 64 KB. A split begins at the first member after its start whose successor is a
member too, and from there at the first place from which a chain of whole records holds: fixed fields, name, operations that add up to the bases,
qualities, and tags to the last byte. The search ends only with the split, so records of any length may lie across its start, or hold all of it.
A split ends with the last record that begins before its end. So splits need nothing from each other, and every record is in one of them.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format: bases, operations, and the empty member that ends a file.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
LAST_MEMBER = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Types of tags and how they are packed.
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
SPLIT, LEAST, MEMBER, CHAIN, SEARCH = 32 << 20, 1 << 19, 0xFF00, 4, 1 << 20
#: Folder of files that are not parts yet.
ATTEMPTS = "_attempts"
#: Operations that a record's own field can count.
OPS = 0xFFFF
#: Bases by the digits of packed bytes in hexadecimal, the digit of each letter (unknown ones as N), and qualities as letters and back.
LETTERS = str.maketrans("0123456789abcdef", BASES)
CODE = bytes(ord("0123456789abcdef"[BASES.find(c) if (c := chr(k).upper()) in BASES else 15]) for k in range(256))
UP, DOWN = (bytes((k + d) % 256 for k in range(256)) for d in (33, -33))


def opened(path: str):
    store, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, own


def member_size(head: bytes) -> int:
    """Bytes of the member that begins here, 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra, at = 12 + struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(extra, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def members(f, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of every member from ``start`` on."""
    at = start
    while at < size:
        f.seek(at)
        raw = f.read(1 << 16)
        n = member_size(raw)
        if not n:
            raise ValueError(f"no BGZF member at byte {at}")
        yield at, zlib.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0] : n - 8], wbits=-15)
        at += n


def first_member(f, start: int, size: int) -> int:
    """The first member at or after ``start``; ``size`` if there is none."""
    f.seek(start)
    data = f.read(1 << 18)
    for m in re.finditer(b"\x1f\x8b\x08\x04", data):
        n = member_size(data[m.start() : m.start() + 64])
        after = start + m.start() + n
        if n and (after == size or (after < size and member_size(_at(f, after, 64)))):
            return start + m.start()
    return size


def _at(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


class Unpacked:
    """The content of a file's members from one of them on, read as far as it is asked for."""

    def __init__(self, f, start: int, size: int) -> None:
        self.members, self.data = members(f, start, size), bytearray()
        #: (place in data, member) of every member that data still has bytes of
        self.begins: list[tuple[int, int]] = []
        self.ended = False

    def has(self, n: int) -> bool:
        """Whether there are ``n`` bytes."""
        while len(self.data) < n and not self.ended:
            found = next(self.members, None)
            if found is None:
                self.ended = True
            else:
                self.begins.append((len(self.data), found[0]))
                self.data += found[1]
        return len(self.data) >= n

    def member_of(self, at: int) -> tuple[int, int]:
        """(place, member) of the byte ``at``; of members that begin at one place the last, as empty ones hold nothing."""
        k = bisect_right(self.begins, (at, 1 << 62)) - 1
        return self.begins[k]

    def drop(self, n: int) -> None:
        """Forgets the first ``n`` bytes."""
        del self.data[:n]
        k = max(0, bisect_right(self.begins, (n, 1 << 62)) - 1)
        self.begins = [(at - n, m) for at, m in self.begins[k:]]


def candidates(data: np.ndarray, n_refs: int) -> np.ndarray:
    """Places whose fixed fields may be a record's; the last 36 bytes are looked at by the next block."""
    n = len(data) - 35
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    byte = lambda at: data[at : at + n]
    number = lambda at: sum(byte(at + k).astype(np.int64) << 8 * k for k in range(4)).astype(np.uint32).view(np.int32)
    keep = np.flatnonzero((number(0) >= 32) & (number(0) < 1 << 28) & (byte(12) > 0))
    of = lambda at: (data[keep[:, None] + at + np.arange(4)].astype(np.int64) << (8 * np.arange(4))).sum(axis=1).astype(np.uint32).view(np.int32)
    for at, low, high in ((4, -1, n_refs - 1), (24, -1, n_refs - 1), (8, -1, 1 << 31), (28, -1, 1 << 31), (20, 0, 1 << 28)):
        x = of(at)
        keep = keep[(x >= low) & (x <= high)]
    return keep


def record_size(held: Unpacked, at: int, n_refs: int) -> int:
    """The size of the record that begins here, with its own four bytes; 0 if none does: all its parts must fit."""
    if not held.has(at + 36):
        return 0
    size, ref, pos, name, _, _, ops, _, bases, ref2, pos2 = struct.unpack_from("<iiiBBHHHiii", held.data, at)
    ok = 32 <= size < 1 << 28 and -1 <= ref < n_refs and pos >= -1 and -1 <= ref2 < n_refs and pos2 >= -1 and name > 0 and 0 <= bases < 1 << 28
    packed = (bases + 1) // 2
    if not ok or 32 + name + 4 * ops + packed + bases > size or not held.has(at + 36 + name + 4 * ops):
        return 0
    text = held.data[at + 36 : at + 36 + name]
    if text[-1] or not all(33 <= c <= 126 for c in text[:-1]):
        return 0
    cigar = np.frombuffer(bytes(held.data[at + 36 + name : at + 36 + name + 4 * ops]), dtype="<u4")
    if (cigar & 15 > 8).any() or (bases and ops and int((cigar >> 4)[np.isin(cigar & 15, (0, 1, 4, 7, 8))].sum()) != bases):
        return 0
    if not held.has(at + 4 + size):
        return 0
    begin = at + 36 + name + 4 * ops + packed
    qual = np.frombuffer(bytes(held.data[begin : begin + bases]), dtype=np.uint8)
    if bases and not (qual <= 93).all() and not (qual == 255).all():
        return 0
    return size + 4 if tags_fit(bytes(held.data[begin + bases : at + 4 + size])) else 0


def tags_fit(raw: bytes) -> bool:
    """Whether the bytes are a row of tags, to the last one."""
    at = 0
    while at < len(raw):
        if at + 4 > len(raw) or not chr(raw[at]).isalpha() or not chr(raw[at + 1]).isalnum():
            return False
        kind, at = chr(raw[at + 2]), at + 3
        if kind in "ZH":
            at = raw.find(0, at) + 1
            if not at:
                return False
        elif kind == "B":
            if at + 5 > len(raw) or chr(raw[at]) not in NUMBERS:
                return False
            at += 5 + struct.unpack_from("<I", raw, at + 1)[0] * struct.calcsize(NUMBERS[chr(raw[at])])
        elif kind == "A" or kind in NUMBERS:
            at += 1 if kind == "A" else struct.calcsize(NUMBERS[kind])
        else:
            return False
    return at == len(raw)


def first_record(held: Unpacked, end: int, n_refs: int) -> int:
    """The first place from which a chain of records holds, among places in members before ``end``; -1 if there is none.

    The search goes on to the end of the split, over records of any size; what follows a place is read as far as its chain needs.
    """
    at = 0
    while held.has(at + 36) and held.member_of(at)[1] < end:
        held.has(at + SEARCH + 36)
        for place in candidates(np.frombuffer(bytes(held.data[at : at + SEARCH + 35]), dtype=np.uint8), n_refs):
            to, n = at + int(place), 0
            if held.member_of(to)[1] >= end:
                return -1
            while n < CHAIN and (size := record_size(held, to, n_refs)):
                to, n = to + size, n + 1
            if n == CHAIN or (n and to == len(held.data) and not held.has(to + 1)):
                return at + int(place)
        at += min(SEARCH, len(held.data) - 35 - at)
    return -1


def tags(raw: bytes) -> list[str]:
    out, at = [], 0
    while at < len(raw):
        name, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind == "A":
            out.append(f"{name}:A:{chr(raw[at])}")
            at += 1
        elif kind in "ZH":
            end = raw.index(0, at)
            out.append(f"{name}:{kind}:{raw[at:end].decode()}")
            at = end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[sub]}", raw, at + 5)
            out.append(f"{name}:B:{sub}" + "".join(f",{v:g}" if sub == "f" else f",{v}" for v in values))
            at += 5 + n * struct.calcsize(NUMBERS[sub])
        else:
            v = struct.unpack_from("<" + NUMBERS[kind], raw, at)[0]
            out.append(f"{name}:f:{v:g}" if kind == "f" else f"{name}:i:{v}")
            at += struct.calcsize(NUMBERS[kind])
    return out


def line_of(record: bytes, refs: list[str]) -> str:
    """The SAM line of a record without its size."""
    ref, pos, name, mapq, _, ops, flag, bases, ref2, pos2, length = struct.unpack_from("<iiBBHHHiiii", record, 0)
    at = 32 + name
    found = struct.unpack_from(f"<{ops}I", record, at)
    at += 4 * ops
    packed = record[at : at + (bases + 1) // 2]
    more = tags(record[at + len(packed) + bases :])
    # operations that do not fit their 16-bit count stand in a tag, and a clip of the whole read in their place
    if ops == 2 and found[0] == bases << 4 | 4 and found[1] & 15 == 3 and (own := next((x for x in more if x.startswith("CG:B:I,")), "")):
        found = tuple(map(int, own[7:].split(",")))
        more.remove(own)
    cigar = "".join([f"{v >> 4}{OPERATIONS[v & 15]}" for v in found]) or "*"
    seq = packed.hex().translate(LETTERS)[:bases] or "*"
    at += len(packed)
    qual = record[at : at + bases]
    text = "*" if not bases or qual[0] == 0xFF else qual.translate(UP).decode()
    chrom = lambda r: refs[r] if r >= 0 else "*"
    mate = "=" if ref2 >= 0 and ref2 == ref else chrom(ref2)
    fields = [record[32 : 31 + name].decode(), flag, chrom(ref), pos + 1, mapq, cigar, mate, pos2 + 1, length, seq, text, *more]
    return "\t".join(map(str, fields))


def _bin(start: int, end: int) -> int:
    """The smallest bin of the indexing scheme that holds the range."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def _tag(field: str) -> bytes:
    name, kind, value = field[:2].encode(), field[3], field[5:]
    if kind == "i":
        return name + b"i" + struct.pack("<i", int(value)) if -(2**31) <= int(value) < 2**31 else name + b"I" + struct.pack("<I", int(value))
    if kind == "f":
        return name + b"f" + struct.pack("<f", float(value))
    if kind == "A":
        return name + b"A" + value.encode()[:1]
    if kind == "B":
        sub, *values = value.split(",")
        return name + b"B" + sub.encode() + struct.pack(f"<i{len(values)}{NUMBERS[sub]}", len(values), *(float(v) if sub == "f" else int(v) for v in values))
    return name + kind.encode() + value.encode() + b"\0"


def record_of(line: str, refs: dict[str, int]) -> bytes:
    """The record of a SAM line, with its size."""
    qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, *more = line.split("\t")
    ops = [(int(n), OPERATIONS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    seq = "" if seq == "*" else seq
    packed = bytes.fromhex((seq.encode("latin-1", "replace").translate(CODE) + b"0" * (len(seq) % 2)).decode())
    quals = b"\xff" * len(seq) if qual == "*" else qual.encode().translate(DOWN)
    start = int(pos) - 1
    ref = refs[rname] if rname != "*" else -1
    ref2 = ref if rnext == "=" else refs[rnext] if rnext != "*" else -1
    end = start + max(1, sum(n for n, o in ops if OPERATIONS[o] in "MDN=X"))
    name = qname.encode() + b"\0"
    own = b"".join(map(_tag, more))
    if len(ops) > OPS:  # the count has 16 bits: a clip of the whole read stands for them, and a tag holds them
        own += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *(n << 4 | o for n, o in ops))
        ops = [(len(seq), OPERATIONS.index("S")), (end - start, OPERATIONS.index("N"))]
    head = struct.pack("<iiBBHHHiiii", ref, start, len(name), int(mapq), _bin(max(start, 0), max(end, 1)) if start >= 0 else 4680, len(ops), int(flag), len(seq), ref2, int(pnext) - 1, int(tlen))
    body = head + name + struct.pack(f"<{len(ops)}I", *(n << 4 | o for n, o in ops)) + packed + quals + own
    return struct.pack("<i", len(body)) + body


def member_of(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


@lru_cache(maxsize=8)
def header(path: str) -> tuple[str, list[str], int, int]:
    """(text, reference names, place of the member with the first record, place of the record in it)."""
    store, own = opened(path)
    size = store.get_file_info(own).size
    with store.open_input_file(own) as f:
        data, places = b"", []
        for at, content in members(f, 0, size):
            places.append((len(data), at))
            data += content
            try:
                return _parsed(data, places)
            except (struct.error, IndexError):
                continue
    raise ValueError(f"no BAM header: {path}")


def _parsed(data: bytes, places: list[tuple[int, int]]) -> tuple[str, list[str], int, int]:
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    at = 12 + n
    refs = []
    for _ in range(struct.unpack_from("<i", data, 8 + n)[0]):
        size = struct.unpack_from("<i", data, at)[0]
        if at + 8 + size > len(data):
            raise IndexError
        refs.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    begin, member = [p for p in places if p[0] <= at][-1]
    return data[8 : 8 + n].rstrip(b"\0").decode(), refs, member, at - begin


class BamSource(DataSource):
    """``spark.read.format("bam")``: (line_no, value), the virtual offset of every record and its SAM line; also writes parts of a file."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "line_no long, value string"

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options)


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        store, own = opened(self.path)
        size = store.get_file_info(own).size
        return [InputPartition((at, min(at + self.split, size))) for at in range(0, max(size, 1), self.split)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        start, end = partition.value
        store, own = opened(self.path)
        size = store.get_file_info(own).size
        _, refs, head, skip = header(self.path)
        with store.open_input_file(own) as f:
            at = head if start <= head < end else first_member(f, start, size) if start > head else size
            out: list[tuple[int, str]] = []
            if at < end:
                for place, line in _records(f, at, end, size, refs, skip if at == head else None):
                    out.append((place, line))
                    if len(out) == 1000:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)


def _batch(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["line_no", "value"])


def _records(f, start: int, end: int, size: int, refs: list[str], skip: int | None) -> Iterator[tuple[int, str]]:
    """Records that begin in members of start..end, the first one at ``skip`` or where a chain of records begins."""
    held = Unpacked(f, start, size)
    at = first_record(held, end, len(refs)) if skip is None else skip
    if at < 0:
        return
    while held.has(at + 4):
        n = 4 + struct.unpack_from("<i", held.data, at)[0]
        begin, of = held.member_of(at)
        if of >= end:
            return
        if not held.has(at + n):
            raise ValueError(f"a record is cut off in the member at byte {of}")
        yield of << 16 | at - begin, line_of(bytes(held.data[at + 4 : at + n]), refs)
        at += n
        if at >= SEARCH:
            held.drop(at)
            at = 0


@dataclass
class Written(WriterCommitMessage):
    """The file of one attempt, and the part that it is to be."""

    attempt: str
    part: str


class BamWriter(DataSourceWriter):
    """Each task writes its lines, in their order, as a part of members; parts follow one another by the number of their task.

    In two phases: an attempt writes a file of its own, and only the files of attempts that Spark has accepted become parts. What
    failed or repeated attempts leave behind goes with their folder.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.refs = options["path"], {r: i for i, r in enumerate(options["refs"].split("\t"))} if options.get("refs") else {}

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = f"part-{context.partitionId():08d}"
        store, own = opened(self.path)
        attempt = f"{own}/{ATTEMPTS}/{part}-{context.taskAttemptId()}"
        store.create_dir(f"{own}/{ATTEMPTS}", recursive=True)
        with store.open_output_stream(attempt) as f:
            held = bytearray()
            for row in rows:
                held += record_of(row.value, self.refs)
                at = 0
                while len(held) - at >= MEMBER:
                    f.write(member_of(bytes(held[at : at + MEMBER])))
                    at += MEMBER
                del held[:at]
            if held:
                f.write(member_of(bytes(held)))
        return Written(attempt, part)

    def commit(self, messages: list[Written | None]) -> None:
        store, own = opened(self.path)
        for m in messages:
            if m is not None:
                store.move(m.attempt, f"{own}/{m.part}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, own = opened(self.path)
        if store.get_file_info(f"{own}/{ATTEMPTS}").type != fs.FileType.NotFound:
            store.delete_dir(f"{own}/{ATTEMPTS}")


def split_of(size: int, cores: int) -> int:
    """Packed bytes of a split: a few splits for each core, as a packed MB may hold 30,000 records, but none below LEAST or above SPLIT."""
    return max(LEAST, min(SPLIT, size // (4 * cores) + 1))


def lines(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """(line_no, value): a SAM line for each record, numbered in file order."""
    spark.dataSource.register(BamSource)
    if split is None:
        store, own = opened(path)
        split = split_of(store.get_file_info(own).size, spark.sparkContext.defaultParallelism)
    return spark.read.format("bam").option("split", split).load(path)


def header_lines(path: str) -> list[str]:
    """The header as SAM lines; reference sequences that its text lacks are added."""
    text, refs, *_ = header(path)
    own = [x for x in text.split("\n") if x]
    return own if any(x.startswith("@SQ") for x in own) or not refs else [*own, *(f"@SQ\tSN:{r}\tLN:1" for r in refs)]


def write(rows: DataFrame, path: str, head: list[str]) -> None:
    """SAM lines (line_no, value) as a BAM file: sorted, packed by all tasks as parts, and put together on storage."""
    from tesserae.operators.metadata import join_parts

    spark = rows.sparkSession
    spark.dataSource.register(BamSource)
    found = [dict(x.split(":", 1) for x in h.split("\t")[1:]) for h in head if h.startswith("@SQ")]
    folder = f"{path}.parts"
    rows.orderBy("line_no").select("value").write.format("bam").option("refs", "\t".join(r["SN"] for r in found)).mode("append").save(folder)
    text = "".join(h + "\n" for h in head).encode()
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(found))
    for r in found:
        data += struct.pack("<i", len(r["SN"]) + 1) + r["SN"].encode() + b"\0" + struct.pack("<i", int(r["LN"]))
    store, own = opened(folder)
    store.create_dir(own, recursive=True)
    for name, content in (("part-header", b"".join(member_of(data[i : i + MEMBER]) for i in range(0, len(data), MEMBER))), ("part-last", LAST_MEMBER)):
        with store.open_output_stream(f"{own}/{name}") as f:
            f.write(content)
    join_parts(folder, path)


def is_bam(path: str) -> bool:
    """Whether a file begins as a gzip member with a size of its own."""
    try:
        store, own = opened(path)
        with store.open_input_file(own) as f:
            return member_size(f.read(64)) > 0
    except (OSError, pa.ArrowInvalid):  # a folder, a pattern or a store of Spark's alone: text
        return False
