"""HTML to leaf blocks: the texts between block-level tags, with the open elements around each."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Elements whose content is characters up to their end, elements whose blocks are dropped, elements that flow inside a line, and elements without content.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style textarea title".split()}
DROPPED = frozenset("template noscript iframe object svg math select".split())
#: Dropped elements that a block of the page ends, unless it is inside an element of the second kind.
FOREIGN, WITHIN = frozenset("svg math".split()), frozenset("foreignobject desc annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open element of the second.
ENDS = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SCOPES = frozenset("table ul ol dl article section div main body td th".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|data-main)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # element names, and names in class, id and role as ".name"
    linked: int  # characters inside links
    marked: bool  # inside an element that training has marked as main text


def names_of(rest: str) -> tuple[tuple[str, ...], bool]:
    names, marked = [], False
    for key, a, b, c in ATTRIBUTE.findall(rest):
        if key.lower() == "data-main":
            marked = True
        elif key.lower() == "hidden":
            names.append(".hidden")
        else:
            names += ["." + n for n in NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", a or b or c).lower())]
    return tuple(names), marked


def empty(tag: re.Match) -> bool:
    return tag["rest"].rstrip().endswith("/")


def tokens(html: str) -> list[tuple[int, int, str, re.Match]]:
    """Tags and comments in page order: start, end, lower-cased name ("" for comments) and match. Raw text belongs to its opening tag."""
    out, at, foreign = [], 0, False
    while m := TOKEN.search(html, at):
        name, at = (m["tag"] or "").lower(), m.end()
        if name in FOREIGN:
            foreign = not m["end"] and not empty(m)
        elif name in CLOSES_P and not m["end"]:
            foreign = False
        if name in RAW and not m["end"] and not (foreign and empty(m)):
            close = RAW[name].search(html, at)
            at = close.end() if close else len(html)
        out.append((m.start(), at, name, m))
    return out


def dropped(found: list[tuple[int, int, str, re.Match]]) -> dict[int, tuple[int, int]]:
    """For tokens that open a dropped element, the token and the place with which the page goes on.

    An element counts from its opening tag to its own end. One that never ends, or only with an element around it, drops no block.
    """
    out: dict[int, tuple[int, int]] = {}
    stack: list[tuple[str, int]] = []
    for i, (start, end, name, m) in enumerate(found):
        if not name or name in RAW or name in VOID or (not m["end"] and empty(m)):
            continue
        if not m["end"]:
            if name in CLOSES_P:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in FOREIGN or stack[k][0] in WITHIN), None)
                if k is not None and stack[k][0] in FOREIGN:
                    out[stack[k][1]] = i, start
                    del stack[k:]
            if name not in INLINE:
                stack.append((name, i))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                if name in DROPPED:
                    out[stack[k][1]] = i + 1, end
                del stack[k:]
                break
    return out


def blocks(html: str) -> list[Block]:
    """Blocks in page order, white space as single spaces, character references decoded; empty ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    text: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        joined = " ".join(unescape("".join(text)).split())
        text.clear()
        if joined:
            path = tuple(x for tag, names, _ in stack for x in (tag, *names))
            out.append(Block(joined, path, min(linked, len(joined)), any(m for _, _, m in stack)))
        linked = 0

    at = 0
    found = tokens(html)
    ends = dropped(found) if any(name in DROPPED for _, _, name, _ in found) else {}
    resume = 0
    for i, (start, end, tag, m) in enumerate(found):
        if i < resume:
            continue
        if start > at:
            part = html[at:start]
            text.append(part)
            if in_link:
                linked += len(part.strip())
        at = end
        if not tag:
            continue
        if not m["end"] and (tag in RAW or tag in DROPPED):
            text.append(" ")
            if i in ends:
                resume, at = ends[i]
            continue
        if tag == "a":
            in_link = not m["end"]
            continue
        if tag in INLINE:
            continue
        if tag in VOID:
            if tag in ("hr",):
                flush()
            else:
                text.append(" ")
            continue
        flush()
        in_link = False
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        ending = ENDS.get(tag) or ({"p"} if tag in CLOSES_P else ())
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ending:
                    del stack[i:]
                    if tag not in ("tr", "td", "th", "li", "dt", "dd"):
                        break
                elif stack[i][0] in SCOPES:
                    break
        names, marked = names_of(m["rest"])
        if not m["rest"].rstrip().endswith("/"):
            stack.append((tag, names, marked))
    rest = html[at:]
    if "<" in rest:  # a tag that never ends
        rest = rest[: rest.index("<")] if re.match(r"<[a-zA-Z/!?]", rest[rest.index("<") :]) else rest
    text.append(rest)
    flush()
    return out
