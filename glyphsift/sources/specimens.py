"""Minimal executables, made byte by byte, for queries and tests."""

import struct


def elf64(sections, symbols=(), high=0x400000):
    """sections: (name, flags, body, kind); symbols: (name, bind, kind, section, value)."""
    names, strings, table = b"\0", b"\0", struct.pack("<IBBHQQ", 0, 0, 0, 0, 0, 0)
    for name, bind, kind, section, value in symbols:
        table += struct.pack("<IBBHQQ", len(strings), bind << 4 | kind, 0, section, value, 0)
        strings += name.encode() + b"\0"
    every = [*sections, (".dynsym", 2, table, 11), (".dynstr", 2, strings, 3)]
    place, body, rows = 64, b"", [(0,) * 10]
    index = {}
    for i, (name, flags, data, kind) in enumerate(every, 1):
        index[name] = i
    for i, (name, flags, data, kind) in enumerate(every, 1):
        link = index[".dynstr"] if kind in (2, 6, 11) else 0
        rows.append((len(names), kind, flags, high + place, place, len(data), link, 0, 1, 24 if kind == 11 else 0))
        names += name.encode() + b"\0"
        if kind != 8:
            body += data
            place += len(data)
    rows.append((len(names), 3, 0, 0, place, 0, 0, 0, 1, 0))
    names += b".shstrtab\0"
    rows[-1] = (*rows[-1][:5], len(names), *rows[-1][6:])
    body += names
    place += len(names)
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, place, 0, 64, 0, 0, 64, len(rows), len(rows) - 1)
    return head + body + b"".join(struct.pack("<IIQQQQIIQQ", *r) for r in rows)


def pe64(sections, imports=(), exports=()):
    """sections: (name, flags, body); imports: (dll, names); exports: names or None for an ordinal alone."""
    base, rva = 0x400, 0x1000
    idata, at = b"", 0x5000
    if imports:
        size = 20 * (len(imports) + 1)
        tail, rows = b"", []
        for dll, names in imports:
            name_at = at + size + len(tail)
            tail += dll.encode() + b"\0"
            hints = []
            for n in names:
                hints.append(at + size + len(tail))
                tail += b"\0\0" + n.encode() + b"\0"
            lookup = at + size + len(tail)
            tail += b"".join(struct.pack("<Q", h) for h in hints) + bytes(8)
            rows.append(struct.pack("<IIIII", lookup, 0, 0, name_at, lookup))
        idata = b"".join(rows) + bytes(20) + tail
    edata, out = b"", 0x6000
    if exports:
        names = [(i, n) for i, n in enumerate(exports) if n]
        functions, pointers = out + 40, out + 40 + 4 * len(exports)
        ordinals = pointers + 4 * len(names)
        text_at = ordinals + 2 * len(names)
        text, ptr = b"", b""
        for _, n in names:
            ptr += struct.pack("<I", text_at + len(text))
            text += n.encode() + b"\0"
        edata = struct.pack("<IIHHIIIIIII", 0, 0, 0, 0, 0, 1, len(exports), len(names), functions, pointers, ordinals) + b"".join(struct.pack("<I", 0x1000 + 16 * i) for i in range(len(exports))) + ptr + b"".join(struct.pack("<H", i) for i, _ in names) + text
    every = [(n, f, b, rva + 0x1000 * i) for i, (n, f, b) in enumerate(sections)]
    if idata:
        every.append((".idata", 0x40000040, idata, at))
    if edata:
        every.append((".edata", 0x40000040, edata, out))
    directories = [(0x6000, len(edata)) if edata else (0, 0), (0x5000, len(idata)) if idata else (0, 0)] + [(0, 0)] * 14
    optional = struct.pack("<H", 0x20B) + bytes(106) + struct.pack("<I", 16) + b"".join(struct.pack("<II", *d) for d in directories)
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, len(every), 0, 0, 0, len(optional), 0x22) + optional
    body, place = b"", base
    for n, f, b, address in every:
        head += struct.pack("<8sIIIIIIHHI", n.encode(), len(b), address, len(b), place, 0, 0, 0, 0, f)
        body += b
        place += len(b)
    return head.ljust(base, b"\0") + body


def macho64(sections, symbols=(), paths=()):
    """sections: (segment, section, body); symbols: (name, section, value); paths: libraries."""
    commands, count = b"", 0
    size = 32 + sum(72 + 80 for _ in sections) + 24 + sum(24 + len(p) + 1 for p in paths)
    place = size
    body = b""
    for segment, section, data in sections:
        one = struct.pack("<16s16sQQIIIIIIII", section.encode(), segment.encode(), 0x1000 + place, len(data), place, 0, 0, 0, 0, 0, 0, 0)
        commands += struct.pack("<II16sQQQQIIII", 0x19, 72 + 80, segment.encode(), 0x1000, len(data), place, len(data), 7, 7, 1, 0) + one
        body += data
        place += len(data)
        count += 1
    strings, table = b"\0", b""
    for name, section, value in symbols:
        table += struct.pack("<IBBHQ", len(strings), 1, section, 0, value)
        strings += name.encode() + b"\0"
    commands += struct.pack("<IIIIII", 2, 24, place, len(symbols), place + len(table), len(strings))
    count += 1
    for p in paths:
        commands += struct.pack("<IIIIII", 0xC, 24 + len(p) + 1, 24, 0, 0, 0) + p.encode() + b"\0"
        count += 1
    return struct.pack("<IIIIIIII", 0xFEEDFACF, 0x0100000C, 0, 2, count, len(commands), 0, 0) + commands + body + table + strings


def fat(*thin, cpus=()):
    """``cpus``: the CPU type of each, by default that of 64-bit ARM."""
    head = struct.pack(">II", 0xCAFEBABE, len(thin))
    place, table, body = 8 + 20 * len(thin), b"", b""
    for i, data in enumerate(thin):
        table += struct.pack(">IIIII", cpus[i] if cpus else 0x0100000C, 0, place, len(data), 0)
        body += data
        place += len(data)
    return head + table + body
