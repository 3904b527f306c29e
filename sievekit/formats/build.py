"""Small containers made from texts, for tests and queries: fat files, executables with symbols or signatures, archives."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sievekit.formats.macho import DIRECTORY_MAGIC, LC_CODE_SIGNATURE, LC_SYMTAB, SIGNATURE_MAGIC

X86_64, ARM64 = 0x01000007, 0x0100000C
DIRECTORY_BYTES = 44


def fat_file(parts: list[tuple[int, int, bytes]]) -> bytes:
    """CPU type, subtype and bytes of each slice."""
    head, body, at = struct.pack(">II", 0xCAFEBABE, len(parts)), b"", 8 + 20 * len(parts)
    for cputype, subtype, data in parts:
        head += struct.pack(">iiIII", cputype, subtype, at, len(data), 0)
        body += data
        at += len(data)
    return head + body


def thin_file(commands: list[tuple[int, bytes]], rest: bytes = b"", order: str = "<", bits: int = 64, cpu: tuple[int, int] = (ARM64, 0)) -> bytes:
    """A thin file: its load commands (number, bytes after the command's size) and what follows them."""
    body = b"".join(struct.pack(order + "II", cmd, 8 + len(data)) + data for cmd, data in commands)
    magic = 0xFEEDFACF if bits == 64 else 0xFEEDFACE
    head = struct.pack(order + "IiiIIII", magic, *cpu, 2, len(commands), len(body), 0)
    return head + (b"\0" * 4 if bits == 64 else b"") + body + rest


def with_symbols(entries: list[tuple[int, str]], **how) -> bytes:
    """A thin file with a symbol table of these type bytes and names."""
    rows, names, at, start = [], [b"\0"], 1, 32 + 24
    for kind, name in entries:
        rows.append(struct.pack("<IBBHQ", at, kind, 0, 0, 0))
        names.append(name.encode() + b"\0")
        at += len(names[-1])
    return thin_file([(LC_SYMTAB, struct.pack("<IIII", start, len(entries), start + 16 * len(entries), at))], b"".join(rows + names), **how)


def directory(data: bytes, hash_type: int) -> bytes:
    """A code directory that holds ``data``."""
    head = struct.pack(">II", DIRECTORY_MAGIC, DIRECTORY_BYTES + len(data)) + b"\0" * 29 + bytes([hash_type])
    return head.ljust(DIRECTORY_BYTES, b"\0") + data


def signature_blob(directories: list[tuple[int, bytes]]) -> bytes:
    """A signature with these slots and directories."""
    at, index, body = 12 + 8 * len(directories), b"", b""
    for slot, blob in directories:
        index += struct.pack(">II", slot, at + len(body))
        body += blob
    return struct.pack(">III", SIGNATURE_MAGIC, at + len(body), len(directories)) + index + body


def signed_file(sig: bytes, **how) -> bytes:
    return thin_file([(LC_CODE_SIGNATURE, struct.pack("<II", 32 + 16, len(sig)))], sig, **how)


def xar_file(toc: bytes, raw_length: int | None = None, header_size: int = 28) -> bytes:
    return b"xar!" + struct.pack(">HHQQI", header_size, 1, len(toc), len(toc) if raw_length is None else raw_length, 1) + toc


def _bytes_udf(f):
    @F.pandas_udf(BinaryType())
    def udf(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in values], dtype=object)

    return udf


_fat = _bytes_udf(lambda v: fat_file([(X86_64, 3, bytes(v)), (ARM64, 2, bytes(v)[::-1])]))
_symbols = _bytes_udf(lambda v: with_symbols([(0x01, w) for w in v] + [(0x0F, "_defined"), (0x21, "_stab")]))
_signed = _bytes_udf(lambda v: fat_file([(X86_64, 3, signed_file(signature_blob([(0, directory(bytes(v), 1)), (0x1000, directory(bytes(v), 2))]))), (ARM64, 0, signed_file(signature_blob([(0, directory(bytes(v), 4))])))]))
_kinds = _bytes_udf(lambda v: fat_file([(cpu, 0, signed_file(signature_blob([(0, directory(bytes(v), kind))]))) for kind, cpu in ((1, X86_64), (2, ARM64), (3, 7))]))
_fat_symbols = _bytes_udf(lambda v: fat_file([(X86_64, 3, with_symbols([(0x01, w) for w in v])), (ARM64, 2, with_symbols([(0x01, w) for w in v[:1]])), (ARM64, 0, thin_file([]))]))
_xar = _bytes_udf(lambda v: xar_file(zlib.compress(bytes(v)), len(v)))


def fat_of(content: Column) -> Column:
    """A fat file with an x86_64 slice of the bytes and an arm64e slice of the bytes backwards."""
    return _fat(content)


def symbols_of(names: Column) -> Column:
    """An executable that imports the names of an array, and defines two others."""
    return _symbols(names)


def signed_of(content: Column) -> Column:
    """A fat file whose slices are signed: x86_64 with SHA-1 and SHA-256, arm64 with SHA-384 directories."""
    return _signed(content)


def signed_kinds_of(content: Column) -> Column:
    """A fat file whose slices are signed with SHA-1 (x86_64), with SHA-256 (arm64), and with a hash type that has no digest (i386)."""
    return _kinds(content)


def fat_symbols_of(names: Column) -> Column:
    """A fat file that imports the names of an array (x86_64), the first of them (arm64e), and has no symbol table (arm64)."""
    return _fat_symbols(names)


def xar_of(content: Column) -> Column:
    """An archive whose table of contents is the compressed bytes."""
    return _xar(content)


def xar_stored_of(content: Column) -> Column:
    """An archive whose table of contents is the bytes as they are, natively."""
    size = F.unhex(F.lpad(F.hex(F.octet_length(content).cast("long")), 16, "0"))
    return F.concat(F.lit(bytearray(b"xar!\x00\x1c\x00\x01")), size, size, F.lit(bytearray(b"\0\0\0\x01")), content)
