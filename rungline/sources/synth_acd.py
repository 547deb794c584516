"""Binary projects over the part table: containers' files with the records that each part calls for, 200 parts a project.

They are what the queries over binary projects read; their SQL computes the same from the part table."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import acd
from .synth import by_project, table

PER_PROJECT = 200


def record(payload: bytes) -> bytes:
    return struct.pack("<HI", 0xFAFA, 6 + len(payload)) + payload


def dat(*records: bytes) -> bytes:
    return b"\0" * 20 + struct.pack("<I", len(records)) + b"".join(records)


def comp(id_: int, parent: int, name: str, kind: int, region: bytes = b"", type_code: int = 0, keys=(0, 0), attrs: dict | None = None, numbers: dict | None = None) -> bytes:
    """An object: its keys stand at 10 and 14 of the body, `numbers` are 4-byte values at other places, attributes from 78 on."""
    body = bytearray(max(130, 0x4E + len(region)))
    struct.pack_into("<H", body, 8, kind)
    struct.pack_into("<II", body, 10, *keys)
    struct.pack_into("<H", body, 62, type_code)
    for at, value in (numbers or {}).items():
        struct.pack_into("<I", body, at, value)
    if region:
        struct.pack_into("<I", body, 0x4A, 4 + len(region))
        body[0x4E : 0x4E + len(region)] = region
    if attrs:
        block = b"".join(struct.pack("<II", k, len(v)) + v for k, v in attrs.items())
        body = body[:78] + struct.pack("<I", len(attrs)) + block
    return record(b"\0" * 16 + struct.pack("<II", id_, parent) + name.encode("utf-16-le").ljust(124, b"\0") + bytes(body))


def flags(size: int, **at: int) -> bytes:
    """`size` bytes with one- to four-byte values, e.g. flags(9, h2=7): h at 2."""
    out = bytearray(size)
    for where, value in at.items():
        struct.pack_into({"b": "<B", "h": "<H", "i": "<I"}[where[0]], out, int(where[1:]), value)
    return bytes(out)


def rung_text(region: int, text: str) -> bytes:
    raw = text.encode("utf-16-le")
    return record(b"\0" * 6 + struct.pack("<I", region) + b"Rung NT\0" + b"\0" * 33 + struct.pack("<I", len(raw)) + raw)


def comment(parent: int, member: int, key: int, text: str) -> bytes:
    return record(b"\0" * 6 + struct.pack("<HHIII", 1, 0, parent, member, key) + b"\0" * 22 + text.encode() + b"\0")


def link(region: int, key: int) -> bytes:
    return b"\0\0\x02\x01\0\x01" + struct.pack("<I", key) + b"\0" * 4 + struct.pack("<I", region) + b"\0" * 6


def counted(text: str) -> bytes:
    raw, n = text.encode("utf-16-le"), len(text.encode("utf-16-le")) // 2
    return b"\xff\xfe\xff" + (bytes([n]) if n < 0xFF else b"\xff" + struct.pack("<H", n)) + raw


def unnamed(kind: int, id_: int, key: int, rest: bytes) -> bytes:
    """A record of the unnamed table; `rest` stands from 30 on."""
    return record(b"\0" * 8 + struct.pack("<III", id_, key, 0x10000 | kind) + b"\0" * 4 + rest)


def ids(*numbers: int) -> bytes:
    return struct.pack("<H", len(numbers)) + b"".join(struct.pack("<I", n) for n in numbers)


def container(files: dict[str, bytes], head: bytes = b"head") -> bytes:
    out, entries = head, b""
    for name, data in files.items():
        entries += name.encode("utf-16-le").ljust(520, b"\0") + struct.pack("<II", len(data), len(out))
        out += data
    return out + entries + struct.pack("<II", len(files), 0x0E7C)


#: What SQL needs of a part: the project, the program's and the module's names and the address of its module.
PROJECT = "concat('K', CAST(floor(p_partkey / 200) AS BIGINT))"
ADDRESS = "CASE WHEN p_size % 2 = 0 THEN concat('10.', CAST(floor(a / 40000) AS BIGINT), '.', CAST(floor(a / 200) AS BIGINT) % 200, '.', a % 200) END"


def address(i: int, size: int) -> str | None:
    a = i - 1 if i % 16 == 1 else i
    return f"10.{a // 40000}.{a // 200 % 200}.{a % 200}" if size % 2 == 0 else None


def files_of(k: int, parts: list[tuple[int, int]]) -> dict[str, bytes]:
    """The files of project k from (part key, size). Part i has program P<i> with a ladder and a text routine, tag In<i> of type U<i>,
    instruction A<i>, module M<i>, and every tenth a task T<i>."""
    comps = [comp(1, 0, f"C{k}", 0)] + [comp(n, 1, name, 0) for n, name in ((2, "RxProgramCollection"), (3, "RxTaskCollection"), (4, "RxUDIDefinitionCollection"), (5, "RxMapDeviceCollection"), (6, "RxTagCollection"))]
    regions, texts, links, notes, lines, xml, programs = [], [], b"", [], [], [], []
    for i, z in parts:
        b, key = 100 * i + 1000, (i % 65536) << 16
        row = 1000 * (i % PER_PROJECT)  # ids have 32 bits; those of lines count within the project
        up = i // 3 if i // 3 // PER_PROJECT == k else i + 300  # places have 16 bits; one outside the project must meet none inside
        tag = f"@{b + 6:08x}@"
        comps += [
            comp(b + 1, 2, f"P{i}", 0x13, keys=(key, 0), attrs={1: flags(200, i36=int(i % 9 == 0), b139=6 * (i % 10 == 0)), 0x12D: struct.pack("<I", b + 3)}), comp(b + 2, b + 1, "RxRoutineCollection", 0),
            comp(b + 3, b + 2, "Old", 0x32, type_code=1), comp(b + 3, b + 2, "Main", 0x32, type_code=1, keys=(i, 5)), comp(b + 4, b + 2, "Seq", 0x32, type_code=4),
            comp(b + 6, 6, f"In{i}", 0x3E, attrs={1: flags(600, b589=int(i % 3 == 0), b543=int(i % 4 == 0), b542=i % 4)} | ({0x6B: b"x"} if i % 6 == 0 else {})), comp(b + 7, 0, f"U{i}", 0x50),
            comp(b + 10, 4, f"A{i}", 0x13, attrs={1: flags(140, h26=1, h28=z, b134=6 * (i % 7 == 0))}), comp(b + 11, b + 10, "RxTagCollection", 0),
        ]
        n = z % 4 + 2
        for j in range(n + 1):  # the last is a local tag
            comps.append(comp(b + 20 + j, b + 11, f"p{j}", 0x3E, keys=(0, (10 - j) << 16), numbers={26: 0 if j else 4, 42: b + 7}, attrs={1: flags(530, b526=0x10 if j == n else (0x24, 0x48, 0x2C)[j % 3])}))
        if i % 2 == 0:
            lines += [unnamed(0x09C5, 7, 7, ids(*range(b + 20, b + 21 + n))), unnamed(0x09C5, 7, 7, ids(*range(b + 21, b + 20 + n), b + 20))]
        if i % 10 == 0:
            long = i % 20 == 0
            at = (4114, 4252, 4254, 4272) if long else (514, 652, 654, 802)
            cfg = flags(4372 if long else 900, **{f"i{at[0]}": z * 1000, f"h{at[1]}": (1, 2, 4)[z % 3], f"h{at[2]}": z % 16, f"i{at[3]}": 500_000} | ({"b4316": 6 * (i % 40 == 0)} if long else {}))
            comps.append(comp(b + 40, 3, f"T{i}", 0x12, attrs={1: ids(i % 65536, (i + 1) % 65536 | 0x70000, (i + 300) % 65536) + cfg[14:]}))
        ip = address(i, z)
        seen = flags(320, h2=1 if i % 3 else 40, h4=(7, 10, 14, 35)[i % 4], h6=z % 3, b8=z | 0x80, b9=3, b20=4 * (i % 5 == 0), h22=up % 65536, h28=z, b305=int(i % 8 == 1))
        comps.append(comp(b + 50, 5, f"M{i}", 0xA4, keys=(key, 0), attrs={1: seen[:40] + (ip or "").encode().ljust(20, b"\0") + seen[60:]}))
        if ip and i % 4 < 2:
            comps.append(comp(b + 51, 0, f"${b + 51:08x}$", 0x60, attrs={9: f'<in><Port Id="1" Type="EN" Ups="False" Addr="1.1.1.1"/><Port Type="EN" Addr="{ip}"/></in><public><CatNum>CAT{z % 4}</CatNum></public>'.encode()}))
        regions += [(b + 3, 2, 10 * i + 1), (b + 3, 1, 10 * i + 2)]
        texts += [rung_text(10 * i + 2, "old"), rung_text(10 * i + 2, f"XIC({tag}.B0)OTE({tag}.B{z % 12});"), rung_text(10 * i + 1, "XIC(@00000bad@)NOP();" if z % 7 == 0 else "NOP();")]
        links += link(10 * i + 2, 0x70000 | i % 1000)
        notes += [comment(i, 5, 0, "a routine")] + ([comment(i, 5, (i % 1000) << 16, f"note {z}")] if z % 2 else [])
        first, second = (200 * i + 2, 200 * i + 1) if i % 2 == 0 else (200 * i + 1, 200 * i + 2)
        lines += [unnamed(0x07D5, b + 4, 0, b"\0" * 8 + ids(first, second)), unnamed(0x07D2, 200 * i + 1, 0, ids(row + 90, row + 91)), unnamed(0x07D2, 200 * i + 2, 0, ids(*range(row, row + z % 6)))]
        lines += [unnamed(0x07D3, 0, d, b"\0" * 8 + struct.pack("<I", state)) for d, state in ((200 * i + 1, 2), (200 * i + 2, 1)) if i % 3]
        lines += [unnamed(0x07D1, 0, row, counted("superseded")), unnamed(0x07D1, 0, row + 90, counted("other"))]
        lines += [unnamed(0x07D1, 0, row + j, counted(f"  x{j} := {tag}.B0;" + " " * (300 if z % 10 == 0 else 0))) for j in range(z % 6) if j != 4]
        lines += [unnamed(0x089B, 0, 0, counted(tag) + counted(f"@{b + 7:08x}@"))] if i % 5 == 0 else []
        bits = "".join(f'<Member Name="B{j}" DataType="BOOL" Offset="0" Bit="{j}"/>' for j in range(z % 12 + 1))
        xml.append(f'<DataType Name="U{i}"><Members><Member Name="Z0" DataType="SINT" Offset="0" Hidden="true"/><Member Name="Z1" DataType="SINT" Offset="1" Hidden="true"/>{bits}<Member Name="Far" DataType="BOOL" Offset="0" Bit="40"/></Members></DataType>')
        dims = f'<Dimensions><Dim Size="{z}"/><Dim Size="0"/></Dimensions>' if z % 5 == 0 else ""
        programs.append((f'<Tag Name="in{i}" DataType="U{i}"{" Produced=" + chr(34) + "true" + chr(34) if i % 12 == 0 else ""}>{dims}</Tag>', f'<Program Name="P{i}"><Tags><Tag Name="Loc" DataType="DINT"><Description> of {i} </Description></Tag></Tags></Program>'))
    comps += [comp(8, 0, "Region Map", 1, b"".join(struct.pack("<IIII", o, n, 0, r) for o, n, r in regions))]
    info = f"<LogixTagInfo><DataTypes>{''.join(xml)}</DataTypes><Tags>{''.join(t for t, _ in programs)}</Tags><Programs>{''.join(p for _, p in programs)}</Programs></LogixTagInfo>"
    quick = f'<LogixQuickInfo Name="C{k}"><SWVersion String="RSLogix 5000 v{k % 30 + 10}.01"/><DeviceIdentity MajorRevision="{k}" ProductCode="7"/></LogixQuickInfo>'
    text = lambda x: b"\xff\xfe" + x.encode("utf-16-le")
    return {"Comps.Dat": dat(*comps), "SbRegion.Dat": dat(*texts), "RegnLink.Dat": links, "Comments.Dat": dat(*notes), "Nameless.Dat": dat(*lines), "TagInfo.XML": text(info), "QuickInfo.XML": text(quick)}


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a container for each 200 parts."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf.k.iloc[0])
        parts = sorted(zip(pdf.p_partkey.astype(int), pdf.p_size.astype(int), strict=True))
        return pd.DataFrame({"path": [f"K{k}"], "content": [container(files_of(k, parts))]})

    parts = table(spark, sf_dir, "part").select((F.floor(F.col("p_partkey") / PER_PROJECT)).alias("k"), "p_partkey", "p_size")
    return by_project(parts).groupBy("k").applyInPandas(build, "path string, content binary")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files in these containers, as acd.read_members gives them."""
    return acd.members_in(containers(spark, sf_dir))
