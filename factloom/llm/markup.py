"""HTML pages as a sequence of text blocks, each with the path of structural elements around it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements by what they mean to a reader of the page.
NO_TEXT = frozenset("script style noscript template svg math iframe object canvas audio video head title select button textarea".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MAIN = frozenset("article main".split())
#: Words of class and id names that mark what isn't the article.
NAMES = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail footer foot masthead banner topbar ad ads advert adverts advertisement "
                  "advertising promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
                  "subscription signup login signin search searchbox share sharing social related recommended recommendations trending comment comments "
                  "commentlist reply replies respond disqus widget widgets pagination pager toolbar skip hidden copyright".split())
#: Words that may stand beside them in a name and say no more than that it is a part of a page.
PARTS = frozenset("area articles bar block box button buttons container content entry form header group inner item items left right links list main module page "
                  "pages panel post posts primary secondary section site slot title top bottom unit user users wrap wrapper".split())
#: An element that begins ends an open one of these kinds (up to the nearest container).
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
          "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"),
          "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table body article section div main aside nav td th".split())

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<(?:/?[a-zA-Z])[^>]*\Z", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Block:
    """``path``: names of the elements around, with class; ``kind``: 'main', 'furniture' or 'open' (neither)."""

    path: str
    kind: str
    text: str
    linked: int


def _attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(tag, _NAME.match(tag).end())}


def _is_furniture(name: str, attrs: dict[str, str], in_main: bool) -> bool:
    """By its element, its role, or a class or id of which every word names furniture or a part of a page (``social-impact`` does not)."""
    if name in FURNITURE or (name == "header" and not in_main):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    if attrs.get("role", "").lower() in ROLES:
        return True
    if name in ("body", "html"):
        return False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {w.lower() for w in _WORDS.split(name) if w}
        if (words & NAMES and words <= NAMES | PARTS) or (not in_main and "header" in words and words <= PARTS):
            return True
    return False


def blocks(page: str | None) -> list[Block]:
    """The blocks that hold text, in page order, character references decoded and white space made single."""
    source = page or ""
    out: list[Block] = []
    stack: list[tuple[str, str, str]] = []  # name, path, kind
    parts: list[str] = []
    linked = anchors = 0
    place = ("", "open")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(place[0], place[1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if anchors:
            linked += len(text)

    def here() -> tuple[str, str]:
        return (stack[-1][1], stack[-1][2]) if stack else ("", "open")

    def pop_to(depth: int) -> None:
        nonlocal place
        flush()
        del stack[depth:]
        place = here()

    at = 0
    while at < len(source):
        found = _MARK.search(source, at)
        if not found:
            say(source[at:])
            break
        say(source[at:found.start()])
        at = found.end()
        tag = found[0]
        named = _NAME.match(tag)
        if not named or not tag.endswith(">"):
            continue
        name = named[1].lower()
        if tag[1] == "/":
            if name == "a":
                anchors = max(0, anchors - 1)
            elif name not in INLINE:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
                if depth >= 0:
                    pop_to(depth)
                elif name == "p":
                    flush()
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(source, at)
            at = len(source) if not end else (source.find(">", end.end()) + 1 or len(source))
            continue
        if name == "a":
            anchors = 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in INLINE:
            attrs = _attributes(tag)
            if not attrs or not _is_furniture(name, attrs, True):
                continue
        flush()
        anchors = 0
        if any(s[0] == "p" for s in stack[-4:]) and name not in INLINE:
            depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p")
            if not any(s[0] in SCOPES for s in stack[depth:]):
                pop_to(depth)
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in CLOSES.get(name, ()):
                pop_to(depth)
                if name not in ("tr", "thead", "tbody", "tfoot"):
                    break
            elif stack[depth][0] in SCOPES and stack[depth][0] not in CLOSES.get(name, ()):
                break
        if name == "body":  # what an unclosed head left open ends here
            del stack[:]
        _, path, kind = stack[-1] if stack else ("", "", "open")
        attrs = _attributes(tag) if len(tag) > len(name) + 2 else {}
        if kind not in ("furniture", "silent"):
            if name in NO_TEXT:
                kind = "silent"
            elif _is_furniture(name, attrs, kind == "main"):
                kind = "furniture"
            elif name in MAIN or attrs.get("role", "").lower() == "main":
                kind = "main"
        sort = ".".join(sorted(attrs.get("class", "").lower().split())[:3])
        stack.append((name, f"{path}>{name}.{sort}" if sort else f"{path}>{name}", kind))
        place = here()
    flush()
    return [b for b in out if b.kind != "silent"]
