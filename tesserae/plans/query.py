"""Search-box queries: parsing into terms and filters, and the probes that terms ask of the index."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field, replace

from ..functions.text import TOKEN, fold_text

ITEM = re.compile(r'(-)?(?:(path|ext|in):)?(?:"([^"]*)"|"?([^ ]*))', re.I)
WORD = re.compile(TOKEN.replace(r"\p{L}\p{N}\p{Co}", r"\w").replace("[", "(?:(?!_)[").replace("]+", "])+"))


@dataclass(frozen=True)
class Probe:
    """Successive tokens in one column; the last one may be the beginning of a word."""

    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False
    alts: tuple[str, ...] = ()
    parts: tuple[Term, ...] = ()

    def tree(self) -> tuple:
        """Nested ('or' | 'and', children) with probes as leaves."""
        if self.parts:
            return ("and", [p.tree() for p in self.parts])
        if self.alts:
            return ("or", [Probe(split(a)) for a in self.alts])
        return Probe(split(self.text), not self.phrase)

    def shown(self) -> str:
        if self.parts:
            return " ".join(p.shown() for p in self.parts)
        text = self.alts[0] if self.alts else self.text
        return f'"{text}"' if self.phrase else text


@dataclass
class Query:
    pos: list[Term] = field(default_factory=list)
    neg: list[Term] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    not_paths: list[str] = field(default_factory=list)
    exts: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    any: bool = False

    def shown(self) -> str:
        """The query as a user would write it."""
        words = [t.shown() for t in self.pos] + [f"-{t.shown()}" for t in self.neg]
        rest = [("path", self.paths), ("-path", self.not_paths), ("ext", self.exts), ("in", self.kinds)]
        return " ".join(words + [f'{k}:"{v}"' if " " in v else f"{k}:{v}" for k, vs in rest for v in vs])

    def keywords(self, stop: set[str]) -> Query:
        """For questions: any of the words of over three letters that are no stop words."""
        return replace(self, pos=[t for t in self.pos if len(t.text) > 3 and t.text.lower() not in stop], neg=[], any=True)


def split(text: str) -> tuple[str, ...]:
    return tuple(WORD.findall(fold_text(text)))


def has_token(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" for c in text)


def parse(text: str) -> Query:
    """Words (prefixes), "phrases", -exclusions, path: -path: ext: in: filters; never an error."""
    out, rest = Query(), text.strip()
    while rest:
        m = ITEM.match(rest)
        rest = rest[max(m.end(), 1) :].strip()
        minus, key, quoted, bare = m.groups()
        word, key = (bare if quoted is None else quoted).replace('"', ""), (key or "").lower()
        if not word:
            continue
        if key == "path":
            (out.not_paths if minus else out.paths).append(word)
        elif key == "ext":
            out.exts.append(word.lower().removeprefix("."))
        elif key == "in":
            out.kinds.append(word.lower())
        elif has_token(word):
            (out.neg if minus else out.pos).append(Term(word, quoted is not None))
    return out
