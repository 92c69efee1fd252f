"""Block trees of web pages: elements that stand in blocks, with the inline text between them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

#: Fixed values of HTML: elements without content, with raw text, that end an open paragraph, that hold other blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
CONTAINERS = frozenset("html body div section article main header footer nav aside form table tbody thead tfoot tr ul ol dl menu center fieldset details figure blockquote dialog".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre address caption figcaption summary legend hr option hgroup search".split())
BLOCKS = CONTAINERS | LEAVES
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening element ends: the elements it closes, and those it does not look behind.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
          "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("html table td th caption button object".split())

#: Elements, roles and words of class and id that name what is not the article.
NEVER = frozenset("head script style noscript template iframe object svg canvas audio video button select input textarea nav aside footer dialog menu form search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
MARKS = frozenset("""ad ads adv advert advertisement advertising adverts banner billboard breadcrumb breadcrumbs captcha comment commentlist comments consent cookie cookies copyright
disclaimer disqus footer gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination
paywall popup privacy promo promotion promoted recommended register related replies respond responses search share sharing shares sidebar sidebars signup skyscraper social sponsor sponsored
subscribe subscription tagcloud tags toc toolbar topbar widget widgets""".split())
#: Words of names that tell the article and its parts.
OF_ARTICLE = frozenset("article entry post story articlebody".split())
#: First words of names that tell what a page has or is about.
ABOUT = frozenset("has with no is without category tag type status format single postid author".split())
#: First words of headings that open what readers wrote.
COMMENT_HEADINGS = re.compile(r"(?i)\s*(?:\d+\s+)?(?:reader |leave a |post a |user )?(?:comments?|commentaires?|kommentare?|comentarios?|reply|replies)\b[\s:(\d)]*$")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
TELLING = re.compile(r"(?i)class|id|role|hidden|style")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    """A block, or a run of text (symbol ``#text``)."""

    __slots__ = ("tag", "symbol", "kids", "text", "links", "out")

    def __init__(self, tag: str, symbol: str, out: bool = False, text: str = "", links: int = 0) -> None:
        self.tag, self.symbol, self.out, self.text, self.links, self.kids = tag, symbol, out, text, links, []

    def walk(self) -> Iterator[Node]:
        yield self
        for kid in self.kids:
            yield from kid.walk()


def words_of_mark(value: str) -> list[list[str]]:
    """Words of each name in a class or id attribute; names that only tell that something is there, or what it is about, have none."""
    names = [re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name) for name in value.split()]
    split = [[w for w in re.split(r"[^a-z0-9]+", name.lower()) if w] for name in names]
    return [words for words in split if words and words[0] not in ABOUT]


def judged(tag: str, attributes: str) -> tuple[str, bool]:
    """Symbol of an element for alignment, and whether its element, role or names say that it is not the article."""
    if not attributes or not TELLING.search(attributes):
        return tag, tag in NEVER
    return judged_by_names(tag, attributes)


@lru_cache(maxsize=4096)
def judged_by_names(tag: str, attributes: str) -> tuple[str, bool]:
    found = {m.group(1).lower(): html.unescape(m.group(2) or m.group(3) or m.group(4) or "") for m in ATTRIBUTE.finditer(attributes)}
    names = words_of_mark(found.get("class", "")) + words_of_mark(found.get("id", ""))
    marked = any(w in MARKS for words in names for w in words)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower())
    steady = sorted({"-".join(words) for words in names if not any(c.isdigit() for w in words for c in w)})
    out = tag in NEVER or marked or bool(hidden) or found.get("role", "").lower() in ROLES
    return ".".join([tag, *steady]), bool(out) and tag not in ("body", "html")


def page_tree(source: str) -> Node:
    """The block tree of a page, however broken; elements that are not the article are marked ``out``."""
    root = Node("html", "html")
    stack: list[Node] = [root]
    inline: list[tuple[str, bool]] = []  # open inline elements, and whether they are out
    pieces: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split()) if pieces else ""
        if text:
            stack[-1].kids.append(Node("#text", "#text", text=text, links=min(linked, len(text))))
        pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        plain = html.unescape(text) if "&" in text else text
        for tag, out in inline:
            if out:
                return
            if tag == "a":
                linked += len(plain.strip())
        pieces.append(plain)

    def close(upto: int) -> None:
        if pieces:
            flush()
        del stack[upto:]
        if inline:
            inline.clear()

    while at < len(source):
        lt = source.find("<", at)
        if lt < 0:
            say(source[at:])
            break
        if lt > at:
            say(source[at:lt])
        m = TOKEN.match(source, lt)
        if m is None:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        if m.group(2) is None:
            if m.group(0).startswith("<![CDATA["):
                say(m.group(0)[9:-3])
            continue
        tag, ending = m.group(2).lower(), bool(m.group(1))
        if tag == "br":
            pieces.append(" ")
        elif ending:
            if tag in BLOCKS or tag == "head":
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if depth and tag not in ("body", "html"):
                    close(depth)
                elif tag == "p":
                    flush()
            else:
                open_at = next((i for i in range(len(inline) - 1, -1, -1) if inline[i][0] == tag), -1)
                if open_at >= 0:
                    del inline[open_at:]
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            at = end.end()
        elif tag in ("html", "body") and any(n.tag == tag for n in stack[:2]):
            continue
        elif tag in BLOCKS or tag == "head":
            depth = len(stack)
            for i in range(depth - 1, 0, -1):  # an open paragraph ends
                if stack[i].tag == "p":
                    depth = i
                elif stack[i].tag not in SCOPE:
                    continue
                break
            close(1 if tag == "body" else depth)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                close(len(stack) - 1)
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                depth = len(stack)
                for i in range(depth - 1, 0, -1):
                    if stack[i].tag in stops:
                        break
                    if stack[i].tag in ends:
                        depth = i
                close(depth)
            symbol, out = judged(tag, m.group(3))
            node = Node(tag, symbol, out or tag == "head")
            stack[-1].kids.append(node)
            if tag not in VOID:
                stack.append(node)
        elif tag not in VOID and not m.group(3).endswith("/"):
            if tag == "a" and any(t == "a" for t, _ in inline):
                inline[:] = [x for x in inline if x[0] != "a"]
            inline.append((tag, tag in NEVER or judged(tag, m.group(3))[1]))
    flush()
    settle(root, False)
    return root


def settle(node: Node, inside: bool) -> bool:
    """Settle doubtful marks; True where the subtree holds the element of an article or its main heading."""
    heart = node.tag in ("article", "main", "h1")
    words = set(re.split(r"[.\-]", node.symbol)[1:])
    marks = words & MARKS
    inside = inside or node.tag in ("article", "main") or bool(words & OF_ARTICLE) and not marks - {"header"}
    below = [settle(kid, inside) for kid in node.kids]
    if node.tag == "header" or node.out and marks == {"header"}:
        # an article's own header holds its heading
        node.out = not inside and not any(n.tag in ("article", "main") for n in node.walk())
    elif node.out and node.tag in ("form", "div", "section", "table", "td") and any(n.tag in ("article", "main") and not n.out for kid in node.kids for n in kid.walk()):
        node.out = False  # a name or form around the whole page
    elif node.tag in ("article", "main") and not marks - {"header", "tags", "promoted", "legal", "search", "social"}:
        node.out = False
    elif node.tag in ("div", "section", "article") and not node.out:
        heading = next((n for n in node.kids if n.tag in HEADINGS), None)
        if heading is not None and heading is next((k for k in node.kids), None) and COMMENT_HEADINGS.match(" ".join(k.text for k in heading.kids)):
            node.out = True
    return heart or any(below)
