"""A small reader of PDF structure: objects, pages, fonts, metadata and simple text.

It finds objects by scanning, so damaged cross-reference tables do not matter, reads
plain and Flate-packed streams and object streams, and decodes text by the fonts'
Unicode maps, else as Windows-1252. It needs no library; encrypted files are refused.
"""

from __future__ import annotations

import re
import zlib
from typing import Any

_OBJ = re.compile(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b")
_TOKEN = re.compile(rb"\s*+(?:%[^\r\n]*+\s*+)*+(<<|>>|\[|\]|/[^\s()<>\[\]{}/%]*|<[0-9A-Fa-f\s]*>|[+-]?(?:\d+\.?\d*|\.\d+)|\(|[A-Za-z'\"*][A-Za-z0-9'\"*]*)")
_REF = re.compile(rb"\s+(\d{1,5})\s+R\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """The number of an object."""


class Name(str):
    pass


class Op(str):
    """A bare word: an operator of a page's content, true, false or null."""


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(raw):
        c = raw[at : at + 1]
        at += 1
        if c == b"\\":
            c = raw[at : at + 1]
            at += 1
            if c.isdigit():
                m = re.compile(rb"[0-7]{1,3}").match(raw, at - 1)
                if m:
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
            elif c not in b"\r\n":
                out += _ESCAPES.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if depth == 0:
            break
        out += c
    return bytes(out), at


def parse(raw: bytes, at: int = 0) -> tuple[Any, int]:
    """(value, end) of the value at a place; None at the end of the data or of an array."""
    m = _TOKEN.match(raw, at)
    if not m:
        return None, len(raw)
    t, at = m[1], m.end()
    if t == b"(":
        return _string(raw, at)
    if t == b"<<" or t == b"[":
        items = []
        while True:
            x, at = parse(raw, at)
            if x is None:
                break
            items.append(x)
        return (dict(zip(items[::2], items[1::2])) if t == b"<<" else items), at
    if t in (b">>", b"]"):
        return None, at
    if t[:1] == b"/":
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), t[1:]).decode("latin-1")), at
    if t[:1] == b"<":
        digits = re.sub(rb"\s", b"", t[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if t[:1] in b"0123456789+-.":
        if t.isdigit() and (r := _REF.match(raw, at)):
            return Ref(t), r.end()
        return (float(t) if b"." in t else int(t)), at
    return Op(t.decode("latin-1")), at


class Pdf:
    def __init__(self, raw: bytes):
        if not raw.lstrip()[:5].startswith(b"%PDF-"):
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d", raw):
            raise ValueError("encrypted")
        self.raw, self.objects, self.streams = raw, {}, {}
        for m in _OBJ.finditer(raw):
            value, end = parse(raw, m.end())
            number = int(m[1])
            self.objects[number] = value
            s = re.compile(rb"\s*stream\r?\n").match(raw, end)
            if s and isinstance(value, dict):
                self.streams[number] = s.end()
        for number in [n for n, v in self.objects.items() if isinstance(v, dict) and v.get("Type") == "ObjStm"]:
            self._unpack(number)

    def _unpack(self, number: int) -> None:
        data, of = self.stream(number), self.objects[number]
        heads = [int(x) for x in data[: int(self.get(of.get("First"), 0))].split()]
        for n, off in zip(heads[::2], heads[1::2]):
            self.objects.setdefault(n, parse(data, int(self.get(of["First"])) + off)[0])

    def get(self, value: Any, default: Any = None) -> Any:
        """The value itself, or what a reference leads to."""
        for _ in range(32):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(int(value))
        return default if value is None else value

    def stream(self, number: int) -> bytes:
        start, of = self.streams[number], self.objects[number]
        length = self.get(of.get("Length"))
        end = start + length if isinstance(length, int) and self.raw[start + length : start + length + 20].strip().startswith(b"endstream") else self.raw.find(b"endstream", start)
        data = self.raw[start : end if end >= 0 else len(self.raw)]
        packed = self.get(of.get("Filter"), [])
        for name in [packed] if isinstance(packed, Name) else packed:
            if self.get(name) != "FlateDecode":
                raise ValueError(f"filter {name}")
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with the resources they inherit."""
        out: list[dict] = []

        def walk(node: Any, resources: Any, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 64:
                return
            resources = node.get("Resources", resources)
            if "Kids" in node:
                for kid in self.get(node["Kids"], []):
                    walk(kid, resources, depth + 1)
            else:
                out.append(node | {"Resources": resources})

        roots = [v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        for root in roots[-1:]:
            walk(root.get("Pages"), {}, 0)
        return out or [v for _, v in sorted(self.objects.items()) if isinstance(v, dict) and v.get("Type") == "Page"]

    def info(self) -> dict[str, str]:
        refs = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", self.raw)
        found = self.get(Ref(refs[-1]), {}) if refs else {}
        text = lambda b: b[2:].decode("utf-16-be", "surrogatepass") if b[:2] == b"\xfe\xff" else b.decode("cp1252", "replace")
        return {str(k): text(held) for k, v in found.items() if isinstance(held := self.get(v), bytes)}

    def page_fonts(self, page: dict) -> dict[str, tuple[int, dict]]:
        """Name in the page -> (object number, font dictionary); fonts without an object count as 0."""
        listed = self.get(self.get(page.get("Resources"), {}).get("Font"), {})
        return {str(k): (int(v) if isinstance(v, Ref) else 0, font) for k, v in listed.items() if isinstance(font := self.get(v), dict)}

    def _descriptor(self, font: dict) -> dict:
        below = self.get(font.get("DescendantFonts"), [])
        inner = self.get(below[0], {}) if below else font
        return self.get(inner.get("FontDescriptor"), {})

    def inventory(self) -> list[dict]:
        """One entry per font object: xref, name, type, encoding, embedded, has_tounicode, pages."""
        found: dict[tuple, dict] = {}
        for number, page in enumerate(self.pages(), 1):
            for xref, font in self.page_fonts(page).values():
                name, encoding = str(font.get("BaseFont", "")), self.get(font.get("Encoding"))
                entry = found.setdefault(
                    (xref, name),
                    {
                        "xref": xref, "raw_font_name": name, "font_type": str(font.get("Subtype", "")), "encoding": str(encoding) if isinstance(encoding, Name) else None,
                        "embedded": int(any(k in self._descriptor(font) for k in ("FontFile", "FontFile2", "FontFile3"))), "has_tounicode": int("ToUnicode" in font), "pages": [],
                    },
                )
                entry["pages"].append(number)
        return [e | {"pages": sorted(set(e["pages"]))} for e in found.values()]

    def _unicode(self, font: dict) -> tuple[int, dict[int, str]]:
        """(bytes a code, code -> text) of a font's Unicode map; (1, {}) without one."""
        ref = font.get("ToUnicode")
        if not isinstance(ref, Ref) or int(ref) not in self.streams:
            return 1, {}
        data, table, width = self.stream(int(ref)), {}, 1
        show = lambda b: b.decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                width, table[int(a, 16)] = len(a) // 2, show(bytes.fromhex(b.decode()))
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
            for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                width, first = len(a) // 2, bytes.fromhex(b.decode())
                for k in range(min(int(z, 16) - int(a, 16) + 1, 65536)):
                    last = show(first)
                    table[int(a, 16) + k] = last[:-1] + chr(ord(last[-1]) + k)
        return width, table

    def spans(self, page: dict) -> list[tuple[str, str]]:
        """(raw font name, text) of what the page shows, in the order of its content; lines end in a line break."""
        refs = page.get("Contents", [])
        refs = refs if isinstance(refs, list) else [refs] if not isinstance(self.get(refs), list) else self.get(refs)
        data = b"\n".join(self.stream(int(r)) for r in refs if isinstance(r, Ref) and int(r) in self.streams)
        fonts, font, maps = self.page_fonts(page), ("", {}), {}
        out: list[tuple[str, str]] = []
        stack: list = []
        at = 0

        def put(codes: bytes) -> None:
            name, of = font
            if name not in maps:
                maps[name] = self._unicode(of)
            width, table = maps[name]
            if table:
                text = "".join(table.get(int.from_bytes(codes[i : i + width], "big"), "�") for i in range(0, len(codes), width))
            else:
                text = codes.decode("cp1252", "replace")
            out.append((str(of.get("BaseFont", name)), text))

        while at < len(data):
            x, at = parse(data, at)
            if x is None:
                continue
            if not isinstance(x, Op):
                stack.append(x)
                continue
            if x == "Tf" and len(stack) >= 2:
                font = (str(stack[-2]), fonts.get(str(stack[-2]), (0, {}))[1])
            elif x in ("Td", "TD", "T*", "Tm", "'", '"', "ET") and out and not out[-1][1].endswith("\n"):
                out.append((out[-1][0], "\n"))
            if x in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
                put(stack[-1])
            elif x == "TJ" and stack and isinstance(stack[-1], list):
                for piece in stack[-1]:
                    if isinstance(piece, bytes):
                        put(piece)
                    elif isinstance(piece, (int, float)) and piece < -200 and out:
                        out.append((out[-1][0], " "))
            stack = []
        return out

    def text(self, page: dict) -> str:
        return "".join(t for _, t in self.spans(page)).strip()
