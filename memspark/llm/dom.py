"""Leaf blocks of an HTML page: runs of text between block boundaries, with the open elements around them."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content a browser does not show: no part of the page's text.
UNSEEN = frozenset("script style title template noembed noframes iframe annotation annotation-xml".split())
#: Of these the content is not markup.
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
#: Raw content that is shown: a block of its own, with character references only in the first.
SHOWN_RAW = ("textarea", "xmp")
CLOSES_P = BLOCK - frozenset("body head html button noscript option optgroup select".split())
#: An element that a start tag closes if open, up to the nearest of the fences.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "body": (("head",), ("html",)),
}
P_RULE = (("p",), ("button", "td", "th", "table", "object"))
#: Rules by number, and the rules that an element matters to.
RULES = [P_RULE, *dict.fromkeys(CLOSED_BY.values())]
RULES_OF = {tag: [i for i, rule in enumerate(RULES) if tag in rule[0] + rule[1]] for rule in RULES for tag in rule[0] + rule[1]}
RULE_OF = {tag: RULES.index(rule) for tag, rule in CLOSED_BY.items()}
LANDMARKS = frozenset("article main nav aside footer header form section".split())
TOKEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
REST_OF_TAG = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*>""")
EMPTY_COMMENT = re.compile(r"-?>")
END_OF_COMMENT = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    """An open element, linked to the one around it, with what the elements around a block tell about it. ``fresh_tag`` and
    ``fresh_marks`` are what no element around it has, so a chain names each tag and mark once. The page's frame (html,
    body) tells nothing."""

    __slots__ = ("tag", "parent", "fresh_tag", "fresh_marks", "own", "nearest", "near", "framed")

    def __init__(self, tag: str, parent: Element | None, names: tuple[str, ...], fresh_tag: bool, fresh_marks: tuple[str, ...]):
        self.tag, self.parent, self.framed = tag, parent, tag not in ("html", "body")
        own, nearest, near = (parent.own, parent.nearest, parent.near) if parent else ("-", "-", ())
        self.fresh_tag, self.fresh_marks = fresh_tag and self.framed, fresh_marks if self.framed else ()
        self.own = tag if self.framed else own
        self.nearest = tag if tag in LANDMARKS else nearest
        self.near = names if names and self.framed else near


@dataclass
class Block:
    text: str
    around: Element | None  # the innermost open element
    words: int
    linked: int  # words inside links


def marks(attributes: str) -> tuple[str, ...]:
    """Parts of the class, id and role names, and ``hidden``."""
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id", "role"):
            out += [x.lower() for x in NAME_PART.findall(value)]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.append("hidden")
    return tuple(dict.fromkeys(out))


class _Open:
    """The open elements, with counts per tag and mark and, per rule, where the elements lie that matter to it; so that every start
    and end tag costs as much as it opens or closes."""

    def __init__(self):
        self.stack: list[tuple[Element, tuple[str, ...]]] = []
        self.tags: Counter[str] = Counter()
        self.marks: Counter[str] = Counter()
        self.rules: list[list[int]] = [[] for _ in RULES]
        self.unseen = 0

    def top(self) -> Element | None:
        return self.stack[-1][0] if self.stack else None

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        e = Element(tag, self.top(), names, not self.tags[tag], tuple(x for x in names if not self.marks[x]))
        for i in RULES_OF.get(tag, ()):
            self.rules[i].append(len(self.stack))
        self.stack.append((e, names))
        self.tags[tag] += 1
        if e.framed:
            self.marks.update(names)
        self.unseen += tag in UNSEEN

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            e, names = self.stack.pop()
            for i in RULES_OF.get(e.tag, ()):
                self.rules[i].pop()
            self.tags[e.tag] -= 1
            if e.framed:
                self.marks.subtract(names)
            self.unseen -= e.tag in UNSEEN

    def close(self, tag: str) -> None:
        """Close up to the innermost ``tag``, if one is open."""
        if self.tags[tag]:
            depth = len(self.stack) - 1
            while self.stack[depth][0].tag != tag:
                depth -= 1
            self.pop_to(depth)

    def close_by(self, rule: int) -> None:
        """Close up to the innermost element that the rule closes, unless a fence lies inside it."""
        if self.rules[rule] and self.stack[self.rules[rule][-1]][0].tag in RULES[rule][0]:
            self.pop_to(self.rules[rule][-1])


def blocks(page: str) -> list[Block]:
    """Blocks with any text, in page order. Character references are decoded; white space becomes one space, ends are trimmed.
    Unclosed tags, comments and elements end with the page; an end tag without its start is left out."""
    is_open = _Open()
    found: list[Block] = []
    held: list[tuple[str, bool]] = []

    def text(piece: str) -> None:
        if piece and not is_open.unseen:
            held.append((piece, is_open.tags["a"] > 0))

    def flush() -> None:
        if held:
            whole = html.unescape("".join(p for p, _ in held)).split()
            if whole:
                linked = sum(len(p.split()) for p, inside in held if inside)
                found.append(Block(" ".join(whole), is_open.top(), len(whole), min(linked, len(whole))))
            held.clear()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        if m[1]:
            short = EMPTY_COMMENT.match(page, m.end())
            end = short or END_OF_COMMENT.search(page, m.end())
            at = end.end() if end else n
            continue
        if not m[3]:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        rest = REST_OF_TAG.match(page, m.end())
        if rest:
            attributes, at = page[m.end():rest.end() - 1], rest.end()
        else:
            end = page.find(">", m.end())
            attributes, at = page[m.end():end if end >= 0 else n], (n if end < 0 else end + 1)
        tag = m[3].lower()
        if tag in BLOCK:
            flush()
        if m[2]:
            is_open.close(tag)
            continue
        if tag == "br":
            text(" ")
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            is_open.close_by(0)
        if tag in RULE_OF:
            is_open.close_by(RULE_OF[tag])
        names = marks(attributes) if attributes and not attributes.isspace() else ()
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            if tag in SHOWN_RAW:
                flush()
                is_open.push(tag, names)
                raw = page[at:end.start() if end else n]
                text(raw if tag == "textarea" else raw.replace("&", "&amp;"))
                flush()
                is_open.pop_to(len(is_open.stack) - 1)
            if end:
                stop = page.find(">", end.end())
                at = n if stop < 0 else stop + 1
            else:
                at = n
            continue
        if attributes.endswith("/") and tag in UNSEEN:
            continue
        is_open.push(tag, names)
    flush()
    return found
