"""Leaf blocks of a web page: runs of text between the borders of block elements, with their ancestors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements of HTML by their role in layout.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav noscript ol optgroup option p "
    "pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes".split())
#: Elements that are left out if they are closed; they can be nested.
DRAWN = frozenset(["svg", "template"])
#: Elements that a trailing slash closes.
FOREIGN = frozenset(["svg", "math"])
PLAIN = frozenset(["title", "textarea"])
#: An open element of the key's kind ends where one of these begins.
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th tr", "th": "td th tr", "option": "option optgroup"}
#: Elements that hold a list or table, beyond which a new item ends nothing.
HOLDERS = frozenset("ul ol menu dl table select body html".split())

#: Attributes as browsers read them: a quote opens a value only right after the equals sign, and only if it is closed.
_NAME = r"(?:=[^\s/>=]*+|[^\s/>=]++)"
_INSIDE = rf"(?:[\s/]++|{_NAME}(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+"
_MARKUP = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)({_INSIDE})>|</[^a-zA-Z][^>]*>?", re.S)
_DRAWN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(script|style)(?=[\s/>]).*?</\1(?=[\s/>])|<(/?)(svg|template)(?=[\s/>])({_INSIDE})>", re.S | re.I
)
#: A slash that ends an attribute's value closes nothing.
_VALUE_SLASH = re.compile(r"=\s*[^\s\"'][^\s\"']*/\Z")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_NAMES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"[\s]+")


@dataclass
class Block:
    """A leaf block: its text, the names of its block ancestors (outermost first), their class and id words."""

    text: str
    tags: tuple[str, ...]
    words: frozenset[str]
    linked: int


@dataclass
class _Open:
    tag: str
    words: frozenset[str] = field(default_factory=frozenset)


def _words(attributes: str) -> frozenset[str]:
    """The words of an element's class, id and role, and ``hidden`` if it is not shown."""
    found: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        kind = name.lower()
        if kind in ("class", "id", "role", "itemprop", "aria-label"):
            found.update(w.lower() for w in _NAMES.findall(html.unescape(value)))
        elif kind == "hidden" or kind == "style" and re.search(r"display\s*:\s*none", value) or kind == "aria-hidden" and value == "true":
            found.add("hidden")
    return frozenset(found)


def _self_closed(tag: str, attributes: str) -> bool:
    return tag in FOREIGN and attributes.endswith("/") and not _VALUE_SLASH.search(attributes)


def _drawn(page: str) -> dict[int, int]:
    """For each DRAWN element that is closed: the end of its opening tag, and that of its closing one."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in DRAWN}
    for match in _DRAWN.finditer(page):
        tag = (match[3] or "").lower()
        if not tag or not match[2] and _self_closed(tag, match[4]):
            continue
        if not match[2]:
            opened[tag].append(match.end())
        elif opened[tag]:
            found[opened[tag].pop()] = match.end()
    return found


def blocks(page: str) -> list[Block]:
    """The leaf blocks that hold text, in page order, character references decoded and white space made single.

    Scripts, styles, drawings and the like hold no text; formulas and objects do. The
    tag of a drawing that is never closed is ignored. Paragraphs, list items and cells end
    where the next begins; a closing tag without an opening one is ignored.
    """
    found: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked = at = links = 0
    drawn: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            tags = tuple(o.tag for o in stack if o.tag in BLOCKS)
            words = frozenset().union(*(o.words for o in stack))
            found.append(Block(text, tags, words, min(linked, len(text))))
        parts.clear()
        linked = 0

    def leave(place: int) -> None:
        nonlocal links
        links -= sum(o.tag == "a" for o in stack[place:])
        del stack[place:]

    def take(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text)

    size = len(page)
    for match in iter(lambda: _MARKUP.search(page, at), None):
        take(page[at : match.start()])
        at = match.end()
        tag = (match[1] or "").lower()
        if not tag:
            continue
        if page[match.start() + 1] == "/":
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if tag in BLOCKS:
                flush()
                if place is not None:
                    leave(place)
            elif place is not None and not any(o.tag in BLOCKS for o in stack[place:]):
                leave(place)
            continue
        if _self_closed(tag, match[2]):
            continue
        if tag in DRAWN:
            drawn = _drawn(page) if drawn is None else drawn
            at = drawn.get(at, at)
            continue
        if tag in RAW or tag in PLAIN:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            stop, after = (end.start(), end.end()) if end else (size, size)
            if tag == "title":
                flush()
                stack.append(_Open(tag))
                take(page[at:stop])
                flush()
                leave(len(stack) - 1)
            at = after
            continue
        if tag in BLOCKS:
            flush()
            last = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in BLOCKS), None)
            if last is not None and stack[last].tag == "p":
                leave(last)
            over = set(ENDS.get(tag, "").split())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in over and tag in ENDS.get(stack[i].tag, "").split():
                    leave(i)
                    break
                if stack[i].tag in HOLDERS:
                    break
            if tag == "body":
                place = next((i for i, o in enumerate(stack) if o.tag == "head"), None)
                if place is not None:
                    leave(place)
        elif tag == "br":
            take(" ")
        if tag not in VOID:
            stack.append(_Open(tag, _words(match[2]) if match[2] else frozenset()))
            links += tag == "a"
    take(page[at:])
    flush()
    return found
