"""Text functions as column expressions: tokens, matching, Markdown patterns, languages, edit distance."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import KINDS

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
# Patterns of notes.
HEADING = r"^#{1,6}\s+(.*?)[\s#]*$"
TAG = r"(?:^|\s)#([\p{L}\p{N}_/-]*\p{L}[\p{L}\p{N}_/-]*)"
FRONTMATTER = r"(?s)^---\n(.*?)\n---"
FRONTMATTER_TAGS = r"(?m)^tags?:[ \t]*(.*)$((?:\n[ \t]*-[ \t]*.*)*)"
IMAGE_URL = r"!\[[^\]]*\]\((https?://[^)\s]+)\)|(?i:<img[^>]+src=[\"'](https?://[^\"']+)[\"'])"
# Language codes and their names as recognition data.
TESSERACT = {
    "en": "eng", "hi": "hin", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "ru": "rus", "uk": "ukr", "ja": "jpn", "ko": "kor",
    "zh-hans": "chi_sim", "zh-cn": "chi_sim", "zh-sg": "chi_sim", "zh": "chi_sim", "zh-hant": "chi_tra", "zh-tw": "chi_tra", "zh-hk": "chi_tra", "ar": "ara", "tr": "tur", "pl": "pol",
    "sv": "swe", "da": "dan", "fi": "fin", "no": "nor", "nb": "nor", "cs": "ces", "el": "ell", "he": "heb", "th": "tha", "vi": "vie", "id": "ind", "ms": "msa", "bn": "ben", "ta": "tam",
    "te": "tel", "mr": "mar", "gu": "guj", "kn": "kan", "ml": "mal", "pa": "pan", "ur": "urd", "fa": "fas", "ro": "ron", "hu": "hun", "bg": "bul", "hr": "hrv", "sk": "slk", "sl": "slv",
    "sr": "srp", "ca": "cat", "lt": "lit", "lv": "lav", "et": "est",
}
# Cyrillic look-alikes and the Latin signs they stand for.
HOMOGLYPHS = ("АВСЕНІЈКМОРЅТХУЗавсеіјкмнорѕтух", "ABCEHIJKMOPSTXY3abceijkmhopstyx")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _bases() -> tuple[str, str]:
    """Code points U+00C0..U+1FFF whose decomposition begins with a letter, and those letters; combining marks follow in the first only."""
    marked = [(chr(i), d[0]) for i in range(0xC0, 0x2000) if len(d := unicodedata.normalize("NFD", chr(i))) > 1 and d[0].isalpha()]
    return "".join(c for c, _ in marked) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in marked)


def fold(c: str | Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(col(c)), *_bases())


def tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


@cache
def _table() -> dict[int, str | None]:
    marked, plain = _bases()
    return dict.fromkeys(map(ord, marked)) | dict(zip(map(ord, marked), plain, strict=False))


def fold_text(text: str) -> str:
    """fold() for a query word, on the driver."""
    return text.lower().translate(_table())


def ascii_lower(c: str | Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def holds(c: str | Column, part: str) -> Column:
    return F.contains(ascii_lower(c), F.lit(lower_ascii(part)))


def under(path: str | Column, folder: str | Column) -> Column:
    """The folder itself or a path in it."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return (col(path) == folder) | F.startswith(col(path), F.concat(folder, F.lit("/")))


def ignored(path: str | Column, folders: list[str]) -> Column:
    out = F.lit(False)
    for f in folders:
        out = out | under(path, f)
    return out


def dotted(path: str | Column) -> Column:
    """Some part of the path begins with a dot."""
    return F.rlike(col(path), F.lit(r"(^|/)\."))


def valid_path(path: str | Column) -> Column:
    """A relative path without empty parts, dot names or backslashes at its start."""
    return (F.length(col(path)) > 0) & ~F.startswith(col(path), F.lit("/")) & ~F.exists(F.split(col(path), "/"), lambda p: F.startswith(p, F.lit(".")))


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]*)$", 1))


def kind_of(path: str | Column) -> Column:
    """The kind of a file by its extension, null if it isn't indexed."""
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.try_element_at(table, extension(path))


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def stem(path: str | Column, kind: str | Column | None = None) -> Column:
    """The name without its last extension; empty for images and audio."""
    out = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    return out if kind is None else F.when(col(kind).isin("image", "audio"), "").otherwise(out)


def is_markdown(path: str | Column) -> Column:
    return extension(path).isin(".md", ".markdown")


def heading(line: str | Column) -> Column:
    return F.regexp_extract(col(line), HEADING, 1)


def is_heading(line: str | Column) -> Column:
    return F.rlike(col(line), F.lit(HEADING))


def is_fence(line: str | Column) -> Column:
    t = F.trim(col(line))
    return F.startswith(t, F.lit("```")) | F.startswith(t, F.lit("~~~"))


def tags(body: str | Column) -> Column:
    """Inline tags of a section, in order."""
    return F.regexp_extract_all(col(body), F.lit(TAG), F.lit(1))


def frontmatter(text: str | Column) -> Column:
    return F.when(F.startswith(col(text), F.lit("---\n")), F.regexp_extract(col(text), FRONTMATTER, 1)).otherwise("")


def frontmatter_tags(text: str | Column) -> Column:
    """Tags of the frontmatter, separated by single blanks."""
    head = frontmatter(text)
    found = F.concat_ws(" ", F.regexp_extract(head, FRONTMATTER_TAGS, 1), F.regexp_extract(head, FRONTMATTER_TAGS, 2))
    return F.array_join(F.filter(F.split(F.translate(found, "[],-\n\t#", "      "), " +"), lambda x: x != ""), " ")


def image_urls(text: str | Column) -> Column:
    """Remote image URLs of a note by first occurrence."""
    both = F.regexp_extract_all(col(text), F.lit(IMAGE_URL), F.lit(0))
    return F.array_distinct(F.transform(both, lambda m: F.coalesce(F.nullif(F.regexp_extract(m, IMAGE_URL, 1), F.lit("")), F.regexp_extract(m, IMAGE_URL, 2))))


def url_index(title: str | Column) -> Column:
    """Number of a remote-image chunk by its title, -1 if it is none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(col(title), r"^url:(\d{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(-1))


def languages(setting: str | Column) -> Column:
    """The language setting without blanks, en-US if empty."""
    return F.coalesce(F.nullif(F.replace(col(setting), F.lit(" "), F.lit("")), F.lit("")), F.lit("en-US"))


def recognition_languages(setting: str | Column, installed: list[str] | None = None) -> Column:
    """Recognition data for a language setting, base languages standing in, joined by +; eng if none is known."""
    table = F.create_map(*[F.lit(x) for pair in TESSERACT.items() for x in pair])
    codes = F.transform(F.split(F.lower(languages(setting)), ","), lambda x: F.coalesce(F.try_element_at(table, x), F.try_element_at(table, F.element_at(F.split(x, "-"), 1))))
    codes = F.array_distinct(F.filter(codes, lambda x: x.isNotNull()))
    if installed is not None:
        codes = F.array_intersect(codes, F.array(*[F.lit(x) for x in installed]))
    return F.coalesce(F.nullif(F.array_join(codes, "+"), F.lit("")), F.lit("eng"))


def latin(text: str | Column, setting: str | Column) -> Column:
    """Look-alikes to Latin, unless a Cyrillic language or auto is among the languages."""
    cyrillic = F.exists(F.split(languages(setting), ","), lambda x: F.startswith(x, F.lit("ru")) | F.startswith(x, F.lit("uk")) | (x == "auto"))
    return F.when(cyrillic, col(text)).otherwise(F.translate(col(text), *HOMOGLYPHS))


def osa(a: str | Column, b: str | Column) -> Column:
    """Optimal-string-alignment distance, as nested folds over the rows of the distance table."""
    a, b = col(a), col(b)
    m, n = F.length(a), F.length(b)
    numbers = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    char = lambda s, i: F.substring(s, i, F.lit(1))

    def row(state: Column, i: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            same = char(a, i) == char(b, j)
            swap = (i > 1) & (j > 1) & (char(a, i) == char(b, j - 1)) & (char(a, i - 1) == char(b, j))
            edits = F.least(F.element_at(done, j) + 1, F.element_at(state["last"], j + 1) + 1, F.element_at(state["last"], j) + F.when(same, 0).otherwise(1))
            return F.concat(done, F.array(F.when(swap, F.least(edits, F.try_element_at(state["before"], j - 1) + 1)).otherwise(edits)))

        return F.struct(state["last"].alias("before"), F.aggregate(numbers(n), F.array(i), cell).alias("last"))

    start = F.struct(F.array().cast("array<int>").alias("before"), F.sequence(F.lit(0), n).alias("last"))
    return F.element_at(F.aggregate(numbers(m), start, row)["last"], -1)


def short_hash(text: str | Column) -> Column:
    return F.substring(F.sha2(col(text).cast("binary"), 256), 1, 8)


def vault_key(path: str | Column) -> Column:
    """A name for the tables of a corpus: its folder's name and a hash of the whole path."""
    return F.concat(F.regexp_replace(file_name(path), r"[^A-Za-z0-9._-]", "_"), F.lit("-"), short_hash(path))


def location(page: Column, line: Column, kind: Column, source: Column) -> Column:
    """Where a result is, as shown after its path."""
    return F.when(page > 0, F.concat(F.lit(" p."), page.cast("string"))).when(line > 0, F.concat(F.lit(":"), (line + 1).cast("string"))).when((source == "ocr") & (kind == "text"), F.lit(" (in image)")).otherwise("")


def shown(snippet: Column) -> Column:
    """A snippet for a terminal: marks as brackets, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(snippet, "\x02\x03", "[]"), r"\s+", " "))
