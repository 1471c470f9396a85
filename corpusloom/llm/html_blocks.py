"""HTML -> a sequence of leaf text blocks with tag paths and link shares."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

#: Elements that begin and end a block of text, those whose content is no text of
#: the page, those without content, and what an opening tag closes.
BLOCKS = frozenset("address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("iframe noembed noframes object script style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
STOPS = frozenset("ul ol dl table select div section article aside nav main body html".split())
#: Blocks that close an open paragraph.
ENDS_P = BLOCKS - frozenset("label button caption legend summary option optgroup td th tr tbody thead tfoot col colgroup body html head".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.DOTALL)
CLOSING = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
NAME = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Elements of a path that a block keeps: the innermost ones.
DEEPEST = 40
#: Raw elements whose content a browser shows if they aren't closed.
OPEN = frozenset(("svg", "object", "template"))
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def names(attributes: str) -> tuple[str, ...]:
    """Lower-case parts of an element's class, id, role and itemprop."""
    if "=" not in attributes:
        return ()
    return tuple(p.lower() for m in NAME.finditer(attributes) for p in PART.findall(m[1] or m[2] or m[3] or ""))


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple, linked: float) -> None:
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: text with references decoded and white space as one space, path of (tag, names), share of characters in links.

    Broken markup is closed as browsers close it where that decides a block; an unclosed script or
    style takes the rest of the page, an unclosed or self-closed drawing or object takes nothing.
    A path has at most ``DEEPEST`` elements, so memory is linear in the page.
    """
    there: Counter[str] = Counter()  # tags on the stack
    unclosed: set[str] = set()

    def cut(k: int) -> int:
        """Take the stack's elements from ``k`` on away; how many links they were."""
        for tag, _ in stack[k:]:
            there[tag] -= 1
        gone = sum(tag == "a" for tag, _ in stack[k:])
        del stack[k:]
        return gone

    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                inside = " ".join(html.unescape(" ".join(linked)).split()) if linked else ""
                out.append(Block(text, tuple(stack[-DEEPEST:]), min(1.0, len(inside) / len(text))))
            pieces, linked = [], []

    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        till = found.start() if found else size
        if till > at:
            pieces.append(page[at:till])
            if links:
                linked.append(page[at:till])
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing = bool(found[1] or found[4])
        if closing:
            if tag in BLOCKS:
                flush()
            if there[tag]:
                links -= cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        attributes = found[3] or found[6] or ""
        if tag in RAW:
            pieces.append(" ")
            if tag == "svg" and attributes.rstrip().endswith("/") or tag in unclosed:
                continue
            end = CLOSING[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in OPEN:
                unclosed.add(tag)
            else:
                at = size
            continue
        if tag in BLOCKS:
            flush()
            shut = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            for k in range(len(stack) - 1, -1, -1) if any(there[t] for t in shut) else ():
                if stack[k][0] in shut:
                    links -= cut(k)
                    break
                if stack[k][0] in STOPS:
                    break
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                pieces.append("" if tag == "wbr" else " ")
            continue
        if not attributes.endswith("/") or tag in BLOCKS:
            stack.append((tag, names(attributes)))
            there[tag] += 1
            links += tag == "a"
    flush()
    return out


PATHS, WORDS = 2048, 1024


def path_features(path: tuple, known: frozenset[str]) -> list[int]:
    """Hashed tags, names, tags with names, and tags with their parents. Names that aren't known are all one name."""
    out, above = [], "-"
    for tag, own in path:
        out.append(f"t {tag}")
        out.append(f"p {above} {tag}")
        for n in own:
            n = n if n in known else "?"
            out.append(f"n {n}")
            out.append(f"b {tag} {n}")
        above = tag
    out.append(f"last {above}")
    return [zlib.crc32(x.encode()) % PATHS for x in dict.fromkeys(out)]


def word_features(text: str) -> list[int]:
    return [zlib.crc32(w) % WORDS for w in text.lower().encode().split()]
