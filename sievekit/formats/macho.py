"""Mach-O files: architectures, load commands, symbols and code directories.

Only the layout is read, never trusted: whatever reaches past the end ends the list or drops the entry.
"""

from __future__ import annotations

import hashlib
import struct
from typing import NamedTuple

# From the public headers of the format.
FAT_MAGICS = (b"\xca\xfe\xba\xbe", b"\xbe\xba\xfe\xca")
THIN_MAGICS = {  # magic as stored: (byte order, header size)
    b"\xce\xfa\xed\xfe": ("<", 28),
    b"\xcf\xfa\xed\xfe": ("<", 32),
    b"\xfe\xed\xfa\xce": (">", 28),
    b"\xfe\xed\xfa\xcf": (">", 32),
}
LC_SYMTAB, LC_CODE_SIGNATURE = 0x02, 0x1D
CPU_NAMES = {7: "i386", 12: "arm", 18: "ppc", 0x01000007: "x86_64", 0x0100000C: "arm64", 0x01000012: "ppc64"}
ARM64, ARM64E_SUBTYPE, SUBTYPE_MASK = 0x0100000C, 2, 0x00FFFFFF
MAX_ARCHS = 24  # more is a Java class, which begins alike
SIGNATURE_MAGIC, DIRECTORY_MAGIC = 0xFADE0CC0, 0xFADE0C02
DIRECTORY_SLOTS = {0, *range(0x1000, 0x1005)}
HASHES = {1: "sha1", 2: "sha256", 4: "sha384"}
SYMBOL_BITS, EXTERNAL = 0xEF, 0x01


class Arch(NamedTuple):
    cputype: int
    cpusubtype: int
    offset: int
    size: int
    align: int

    @property
    def name(self) -> str:
        return arch_name(self.cputype, self.cpusubtype)


class Command(NamedTuple):
    cmd: int
    data: bytes


def arch_name(cputype: int | None, cpusubtype: int | None) -> str:
    if cputype == ARM64 and (cpusubtype or 0) & SUBTYPE_MASK == ARM64E_SUBTYPE:
        return "arm64e"
    return CPU_NAMES.get(cputype, "unknown")


def kind(data: bytes) -> str:
    """``fat``, ``thin`` or ``none``."""
    if fat_archs(data):
        return "fat"
    order = THIN_MAGICS.get(bytes(data[:4]))
    return "thin" if order and len(data) >= order[1] else "none"


def thin_cpu(data: bytes) -> tuple[int, int] | None:
    """CPU type and subtype of a thin file."""
    order = THIN_MAGICS.get(bytes(data[:4]))
    return struct.unpack_from(order[0] + "ii", data, 4) if order and len(data) >= order[1] else None


def fat_archs(data: bytes) -> list[Arch]:
    """Entries of a fat header, in order; empty if it isn't one.  Always big-endian, also after the swapped magic."""
    if bytes(data[:4]) not in FAT_MAGICS or len(data) < 8:
        return []
    count = struct.unpack_from(">I", data, 4)[0]
    if not 1 <= count <= MAX_ARCHS:
        return []
    count = min(count, (len(data) - 8) // 20)
    return [Arch(*struct.unpack_from(">iiIII", data, 8 + 20 * i)) for i in range(count)]


def slice_bytes(data: bytes, arch: Arch) -> bytes:
    """The slice; empty if it reaches outside the file."""
    end = arch.offset + arch.size
    return bytes(data[arch.offset : end]) if arch.offset < len(data) and end <= len(data) else b""


def load_commands(data: bytes) -> list[Command]:
    order = THIN_MAGICS.get(bytes(data[:4]))
    if not order or len(data) < order[1]:
        return []
    byte_order, at = order
    count, total = struct.unpack_from(byte_order + "II", data, 16)
    stop, out = at + total, []
    while len(out) < count and at + 8 <= min(len(data), stop):
        cmd, size = struct.unpack_from(byte_order + "II", data, at)
        if size < 8 or at + size > len(data):
            break
        out.append(Command(cmd, bytes(data[at : at + size])))
        at += size
    return out


def symbols(data: bytes, strict_layout: bool = False, imported: bool = False) -> list[tuple[int, str]] | None:
    """Type byte and name of each symbol in table order, with ``imported`` of undefined external ones only; None without a symbol table.

    Numbers are little-endian and entries 16 bytes in every file, as for 64-bit ones; with ``strict_layout`` the file's own
    byte order and entry size are used.  A table that reaches past the end counts as empty; names end at a zero byte
    or the end of the file; symbols whose name begins outside the file are left out.
    """
    first = next((c for c in load_commands(data) if c.cmd == LC_SYMTAB), None)
    if first is None or len(first.data) < 24:
        return None
    byte_order, header = THIN_MAGICS[bytes(data[:4])] if strict_layout else ("<", 32)
    entry = 16 if header == 32 else 12
    symoff, count, stroff = struct.unpack_from(byte_order + "III", first.data, 8)
    if symoff + count * entry > len(data):
        return []
    out = []
    for strx, kind_byte in struct.iter_unpack(f"{byte_order}IB{entry - 5}x", data[symoff : symoff + count * entry]):
        start = stroff + strx
        if start < len(data) and (not imported or kind_byte & SYMBOL_BITS == EXTERNAL):
            end = data.find(b"\0", start)
            out.append((kind_byte, bytes(data[start : end if end >= 0 else len(data)]).decode("utf-8", "replace")))
    return out


def imported_names(data: bytes, strict_layout: bool = False) -> list[str] | None:
    """Names of undefined external symbols (what the symbol hash is made of), duplicates kept."""
    table = symbols(data, strict_layout, imported=True)
    return None if table is None else [name for _, name in table]


def slices_of(data: bytes | None) -> list[tuple[str | None, bytes]]:
    """Architecture and bytes of each slice: of a fat file all, of a thin one itself without a name."""
    if data is None:
        return []
    data = bytes(data)
    archs = fat_archs(data)
    if archs:
        return [(a.name, slice_bytes(data, a)) for a in archs]
    return [(None, data)] if kind(data) == "thin" else []


def signature(data: bytes) -> bytes | None:
    """The first embedded signature whose place lies within the file."""
    for c in load_commands(data):
        if c.cmd == LC_CODE_SIGNATURE and len(c.data) >= 16:
            start, size = struct.unpack_from("<II", c.data, 8)  # not swapped, whatever the file's byte order
            if start > 0 and size > 0 and start + size <= len(data):
                return bytes(data[start : start + size])
    return None


def code_directories(sig: bytes) -> list[tuple[int, bytes]]:
    """Hash type and bytes of each code directory of a signature."""
    if len(sig) < 12:
        return []
    magic, _, count = struct.unpack_from(">III", sig, 0)
    if magic != SIGNATURE_MAGIC:
        return []
    out = []
    for i in range(min(count, (len(sig) - 12) // 8)):
        slot, at = struct.unpack_from(">II", sig, 12 + 8 * i)
        if slot not in DIRECTORY_SLOTS or at + 38 > len(sig):
            continue
        magic, size = struct.unpack_from(">II", sig, at)
        if magic == DIRECTORY_MAGIC and at + size <= len(sig):
            out.append((sig[at + 37], sig[at : at + size]))
    return out


def code_directory_hash(data: bytes) -> str | None:
    """Full hex hash of the code directory with the greatest hash type (the first of equals); None without one
    and for types other than SHA-1, SHA-256 and SHA-384."""
    sig = signature(data)
    found = code_directories(sig) if sig else []
    if not found:
        return None
    hash_type, blob = max(found, key=lambda d: d[0])
    name = HASHES.get(hash_type)
    return hashlib.new(name, blob).hexdigest() if name else None
