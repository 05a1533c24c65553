"""Readers: file contents to pages of text, and the plug-ins for heavier formats."""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TESSERACT, kind_of
from ..model import MAX_BYTES, PAGE
from . import remote

# Elements that end a line, by local name; entries of office files; RTF destinations without body text.
BREAKS = frozenset("p si br tab div li tr td th h1 h2 h3 h4 h5 h6 text title".split())
OOXML = re.compile(r"word/document\.xml|xl/sharedStrings\.xml|ppt/slides/slide.*|ppt/notesSlides/.*")
EPUB = re.compile(r".*\.(xhtml|html|htm)", re.I)
ODT = re.compile(r"content\.xml")
RTF_HIDDEN = frozenset("fonttbl colortbl stylesheet info pict generator themedata colorschememapping latentstyles datastore header footer headerl headerr headerf footerl footerr footerf xmlnstbl listtable listoverridetable rsidtbl object filetbl revtbl".split())
RTF_BREAKS = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n", "page": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
RTF = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


@dataclass(frozen=True)
class Backend:
    """Callables for what no built-in reads: each takes bytes; pdf gives pages split by form feeds, the others text."""

    pdf: Callable[[bytes], str] | None = None
    ocr: Callable[[bytes], str] | None = None
    speech: Callable[[bytes], str] | None = None
    legacy: Callable[[bytes], str] | None = None
    fetch: Callable[[str], bytes] | None = None
    #: Like ocr, for a reader that takes recognition languages too, and the setting that these come from.
    ocr_in: Callable[[bytes, str], str] | None = None
    languages: str = "en-US"

    def image(self) -> Callable[[bytes], str] | None:
        """The reader of images."""
        if self.ocr_in:
            return lambda content: self.ocr_in(content, recognition_codes(self.languages))
        return self.ocr


#: Seconds for which a tool counts as found or missing.
LOOK_AGAIN = 60.0
_tools: dict[tuple[str, ...], tuple[float, str | None]] = {}


def tool(*names: str) -> str | None:
    """The path of the first of these programs that there is; looked for again after a minute, as it may have been installed."""
    seen = _tools.get(names)
    if seen is None or time.monotonic() - seen[0] > LOOK_AGAIN:
        seen = _tools[names] = (time.monotonic(), next((p for n in names if (p := shutil.which(n))), None))
    return seen[1]


def recognition_codes(setting: str) -> str:
    """The same as functions.text.recognition_languages, for one setting on its own."""
    codes = []
    for name in (setting.replace(" ", "") or "en-US").lower().split(","):
        code = TESSERACT.get(name) or TESSERACT.get(name.split("-")[0])
        if code and code not in codes:
            codes.append(code)
    return "+".join(codes) or "eng"


def _run(command: list[str], content: bytes, suffix: str, timeout: int = 120) -> str:
    with tempfile.NamedTemporaryFile(suffix=suffix) as f:
        f.write(content)
        f.flush()
        return subprocess.run([*command[:1], *(x.replace("{}", f.name) for x in command[1:])], capture_output=True, timeout=timeout, check=True).stdout.decode("utf-8", "replace")


def _legacy(content: bytes) -> str:
    """Old office files by whichever reader there is."""
    if word := tool("antiword"):
        return _run([word, "-w", "0", "{}"], content, ".doc")
    return _run([tool("catdoc"), "-w", "{}"], content, ".doc")


def installed() -> Backend:
    """A backend of the tools found on this machine; what is missing gives files with an error. Remote images are fetched where they can be read."""
    pdf, ocr, doc = tool("pdftotext"), tool("tesseract"), tool("antiword", "catdoc")
    return Backend(
        pdf=(lambda b: _run([pdf, "-q", "{}", "-"], b, ".pdf")) if pdf else None,
        ocr_in=(lambda b, codes: _run([ocr, "{}", "stdout", "-l", codes], b, ".png", 180)) if ocr else None,
        legacy=_legacy if doc else None,
        fetch=remote.fetch if ocr else None,
    )


def missing_tools(kinds: set[str], backend: Backend) -> list[str]:
    need = {"pdf": backend.pdf, "image": backend.image(), "audio": backend.speech, "textutil": backend.legacy}
    return sorted(k for k in kinds if k in need and need[k] is None)


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        name = tag.rpartition(":")[2]
        if name in ("script", "style"):
            self.hidden += 1
        elif name == "br":
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag.rpartition(":")[2] in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        name = tag.rpartition(":")[2]
        if name in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif name in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def markup_text(content: bytes) -> str:
    """Visible text of HTML or XML, with a line break after each block."""
    parser = _Visible()
    parser.feed(content.decode("utf-8", "replace"))
    parser.close()
    return "".join(parser.parts)


def zip_text(content: bytes, wanted: re.Pattern) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return "".join(markup_text(z.open(n).read(MAX_BYTES)) for n in z.namelist() if wanted.fullmatch(n))


def rtf_text(content: bytes) -> str:
    out: list[str] = []
    hidden, fallback, skip, first = False, 1, 0, False
    stack: list[tuple[bool, int]] = []

    def put(text: str) -> None:
        nonlocal skip
        drop = min(skip, len(text))
        skip -= drop
        if not hidden:
            out.append(text[drop:])

    for m in RTF.finditer(content):
        word, number, code, sign, brace, plain = m.groups()
        if brace == b"{":
            stack.append((hidden, fallback))
        elif brace:
            hidden, fallback = stack.pop() if stack else (hidden, fallback)
        elif code:
            put(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif word:
            name = word.decode()
            if name == "u" and number:
                put(chr(int(number) % 65536))
                skip = fallback
            elif name == "uc" and number:
                fallback = int(number)
            elif name in RTF_HIDDEN:
                hidden = True
            elif name in RTF_BREAKS:
                put(RTF_BREAKS[name])
        elif sign == b"*":
            hidden = True
        elif sign == b"~":
            put(" ")
        elif sign in (b"\\", b"{", b"}"):
            put(sign.decode())
        elif plain:
            put(plain.decode("cp1252", "replace"))
    return "".join(out)


def pdf_pages(raw: str) -> list[tuple[int, str]]:
    """Pages by form feeds, the last one removed; blank ones are dropped, but for the first."""
    return [(i, p) for i, p in enumerate(raw.removesuffix("\f").split("\f"), 1) if p.strip() or i == 1]


def pages_of(path: str, kind: str, content: bytes, backend: Backend) -> list[tuple[int, str, str, str]]:
    """(slot, source, title, body) of one file; notes are whole here, sections.py cuts them."""
    need = lambda f, what: f or (lambda _: (_ for _ in ()).throw(RuntimeError(f"no reader for {what}")))
    if kind == "pdf":
        return [(i, "text", "", p) for i, p in pdf_pages(need(backend.pdf, "pdf")(content))]
    if kind == "image":
        return [(0, "ocr", "", need(backend.image(), "images")(content))]
    if kind == "audio":
        return [(0, "speech", "", " ".join(need(backend.speech, "audio")(content).split()))]
    if kind == "html":
        return [(0, "text", "", markup_text(content[:MAX_BYTES]))]
    if kind == "ooxml":
        return [(0, "text", "", zip_text(content, OOXML))]
    if kind == "epub":
        return [(0, "text", "", zip_text(content, EPUB))]
    if kind == "textutil":
        low = path.lower()
        body = rtf_text(content[:MAX_BYTES]) if low.endswith(".rtf") else zip_text(content, ODT) if low.endswith(".odt") else need(backend.legacy, "old office files")(content)
        return [(0, "text", "", body)]
    return [(0, "text", "", content[:MAX_BYTES].decode("utf-8", "replace"))]


def extracted(files: DataFrame, backend: Backend | None = None) -> DataFrame:
    """(path, kind, pages, error) of files (path, content): a file that can't be read has one empty page and an error."""
    backend = backend or installed()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, kind, content in zip(part["path"], part["kind"], part["content"], strict=True):
                try:
                    pages, error = pages_of(path, kind, bytes(content), backend), ""
                except Exception as e:  # a broken file must not fail the others
                    pages, error = [(0, "text", "", "")], f"{type(e).__name__}: {e}"
                out.append((path, kind, [dict(zip(("n", "source", "title", "body"), p, strict=True)) for p in pages], error))
            yield pd.DataFrame(out, columns=["path", "kind", "pages", "error"])

    known = files.select("path", kind_of("path").alias("kind"), "content").where("kind is not null and content is not null")
    return known.mapInPandas(run, f"path string, kind string, pages {PAGE}, error string")


def ignore_list(setting: Column) -> Column:
    """Ignored folders of a settings JSON: lines, trimmed, without outer slashes, blank ones dropped."""
    lines = F.split(F.get_json_object(setting, "$.ignore"), "\n")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*/*|/*\s*$", "")), lambda x: x != "")


def remote_texts(urls: DataFrame, memo: DataFrame, backend: Backend, partitions: int = 32) -> DataFrame:
    """(url, body) fetched and recognised for the distinct URLs without a memo; failures give no row, and so are tried again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for url in part["url"]:
                try:
                    if body := backend.image()(backend.fetch(url)).strip():
                        out.append((url, body))
                except Exception:  # a dead link; the note keeps its other images
                    continue
            yield pd.DataFrame(out, columns=["url", "body"])

    missing = urls.select("url").distinct().join(memo.select("url"), "url", "left_anti")
    return missing.repartition(partitions).mapInPandas(run, "url string, body string")
