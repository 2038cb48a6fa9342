"""Texts of DOCX, RTF and PDF files, with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

# --- DOCX ---

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs by line; the cells of a table's row are joined by tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    return "\n".join(_docx_block(x) for x in (body if body is not None else ()) if x.tag in (f"{_W}p", f"{_W}tbl"))


def _docx_block(block: ElementTree.Element) -> str:
    if block.tag == f"{_W}tbl":
        return "\n".join("\t".join("\n".join(_docx_block(p) for p in cell if p.tag in (f"{_W}p", f"{_W}tbl")) for cell in row.findall(f"{_W}tc")) for row in block.findall(f"{_W}tr"))
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join((x.text or "") if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in block.iter())


# --- RTF ---

_RTF = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
# Groups that hold no text, and control words that stand for a character.
_RTF_SILENT = set("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr footnote object listtable listoverridetable generator themedata datastore xmlnstbl".split())
_RTF_MARKS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def rtf_text(data: bytes) -> str:
    """The text of an RTF document: groups of settings are left out, characters decoded by its code page."""
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ValueError("no RTF")
    page, out = "cp1252", []
    state, stack = [False, 1], []  # whether the group is silent, how many characters stand in for a \u
    skip = 0
    for m in _RTF.finditer(data):
        word, number, code, sign, brace, plain = m.groups()
        if brace == b"{":
            stack.append(list(state))
        elif brace == b"}":
            state = stack.pop() if stack else state
        elif word:
            name = word.decode()
            if name in _RTF_SILENT:
                state[0] = True
            elif name == "ansicpg" and number:
                page = f"cp{int(number)}"
            elif name == "uc":
                state[1] = int(number or 1)
            elif name == "u" and number and not state[0]:
                out.append(chr(int(number) % 65536))
                skip = state[1]
            elif name in _RTF_MARKS and not state[0]:
                out.append(_RTF_MARKS[name])
        elif sign == b"*":
            state[0] = True
        elif not state[0]:
            piece = bytes([int(code, 16)]).decode(page, "replace") if code else {b"~": "\xa0", b"_": "-"}.get(sign, sign.decode("latin-1") if sign in (b"\\", b"{", b"}") else "") if sign else (plain or b"").decode(page, "replace")
            take = min(skip, len(piece))
            skip -= take
            out.append(piece[take:])
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


# --- PDF ---

_PDF_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_PDF_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_PDF_REF = rb"(\d+)\s+\d+\s+R"
_PDF_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|\[|\]|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_PDF_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
_PDF_CODES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class _Pdf:
    """Objects of a file by number, those of object streams too."""

    def __init__(self, data: bytes):
        if not data.lstrip().startswith(b"%PDF"):
            raise ValueError("no PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("encrypted")
        self.objects = {int(m.group(1)): m.group(2) for m in _PDF_OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                inner, first = self.stream(body), int(re.search(rb"/First\s+(\d+)", body).group(1))
                numbers = [int(x) for x in inner[:first].split()]
                places = [*numbers[1::2], len(inner) - first]
                for k, number in enumerate(numbers[::2]):
                    self.objects.setdefault(number, inner[first + places[k] : first + places[k + 1]])

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = _PDF_STREAM.search(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m.group(1)) if b"FlateDecode" in body[: m.start()] else m.group(1)

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """Numbers of the objects that an entry names, alone or as an array."""
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|" + _PDF_REF + rb")", body)
        return [int(x) for x in re.findall(_PDF_REF, m.group(1))] if m else []

    def pages(self) -> list[bytes]:
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)]
        found, seen, todo = [], set(), [k for b in roots for k in self.refs(b, b"Kids")][::-1]
        while todo:
            number = todo.pop()
            body = self.objects.get(number, b"")
            if number in seen:
                continue
            seen.add(number)
            kids = self.refs(body, b"Kids")
            if kids:
                todo += kids[::-1]
            else:
                found.append(body)
        return found or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]

    def fonts(self, page: bytes) -> dict[bytes, dict[int, str] | None]:
        """Of each font of a page the characters of its codes; None: codes are characters."""
        bodies = [page] + [self.objects.get(k, b"") for k in self.refs(page, b"Resources") + self.refs(page, b"Parent")]
        bodies += [self.objects.get(k, b"") for b in bodies for k in self.refs(b, b"Font")]
        out = {}
        for body in bodies:
            for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+" + _PDF_REF, body):
                font = self.objects.get(int(number), b"")
                if b"/Font" in font and name not in out:
                    maps = self.refs(font, b"ToUnicode")
                    out[name] = _cmap(self.stream(self.objects.get(maps[0], b""))) if maps else None
        return out


def _cmap(data: bytes) -> dict[int, str]:
    out = {}
    char = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = char(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1):
                out[k] = chr(int(c, 16) + k - int(a, 16)) if len(c) <= 4 else char(c)
        for a, _, items in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*\[([^\]]*)\]", block):
            for k, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", items)):
                out[int(a, 16) + k] = char(x)
    return out


def _pdf_string(token: bytes, codes: dict[int, str] | None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _PDF_ESCAPE.sub(lambda m: bytes([int(m.group(1), 8) % 256]) if m.group(1)[:1].isdigit() else _PDF_CODES.get(m.group(1), b"" if m.group(1).strip() == b"" else m.group(1)), token[1:-1])
    if codes is None:
        return raw.decode("utf-16") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    wide = max(codes, default=0) > 255 or token[:1] == b"<" and len(raw) % 2 == 0
    return "".join(codes.get(int.from_bytes(raw[k : k + 1 + wide], "big"), "") for k in range(0, len(raw), 1 + wide))


def _page_text(content: bytes, fonts: dict[bytes, dict[int, str] | None]) -> Iterator[str]:
    stack: list[bytes] = []
    codes: dict[int, str] | None = None
    for token in _PDF_TOKEN.findall(content):
        if token in (b"Tj", b"'", b'"', b"TJ"):
            if token in (b"'", b'"'):
                yield "\n"
            for x in stack:
                if x[:1] in b"(<":
                    yield _pdf_string(x, codes)
                elif token == b"TJ" and x[:1] in b"-+.0123456789" and float(x) < -200:
                    yield " "  # a gap as wide as a blank
        elif token == b"Tf" and len(stack) > 1:
            codes = fonts.get(stack[-2][1:])
        elif token in (b"Td", b"TD") and len(stack) > 1:
            yield "\n" if float(stack[-1] or 0) else " "
        elif token in (b"T*", b"ET", b"Tm"):
            yield "\n"
        elif not token.isalpha():
            stack.append(token)
            continue
        stack.clear()


def pdf_text(data: bytes) -> str:
    """The texts of the pages in order, parted by line breaks. Encrypted files are an error; pictures have no text."""
    pdf, out = _Pdf(data), []
    for page in pdf.pages():
        content = b"\n".join(pdf.stream(pdf.objects.get(k, b"")) for k in pdf.refs(page, b"Contents"))
        text = "".join(_page_text(content, pdf.fonts(page)))
        out.append(re.sub(r"[ \t]*\n\s*", "\n", re.sub(r" {2,}", " ", text)).strip())
    return "\n".join(x for x in out if x)


READERS = {"docx": docx_text, "rtf": rtf_text, "pdf": pdf_text}
