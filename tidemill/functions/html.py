"""A small HTML tree and what is read from it; plain Python, for use inside Arrow functions.

The tree has what text extraction rests on: implied html, head and body, elements whose end tags are optional, void elements,
implied table bodies. Misnested formatting is not rebuilt.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link style script base noscript template".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag ends open elements of the second set, up to one of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
WALLS = frozenset("table td th caption html body button object template".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
                stack += reversed(x.children)

    def select(self, *tags: str) -> Iterator[Node]:
        return (x for x in self.walk() if x.tag in tags)

    def texts(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack += reversed(x.children)
            elif isinstance(x, str):
                yield x

    def text(self) -> str:
        return "".join(self.texts())

    def nodes(self) -> int:
        """Itself and all nodes below: elements, texts and comments."""
        n, stack = 0, [self]
        while stack:
            x = stack.pop()
            n += 1
            if isinstance(x, Node):
                stack += x.children
        return n

    def size(self) -> int:
        """Bytes of its serialised form."""
        n, stack = 0, [self]
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                n += len(x.tag) + 2 + sum(len(k.encode()) + 4 + len(escape(v.replace("\xa0", "&nbsp;"), quote=False).replace('"', "&quot;").encode()) for k, v in x.attrs.items())
                if x.tag not in VOID:
                    n += len(x.tag) + 3
                raw = x.tag in ("script", "style")
                for c in x.children:
                    if raw and isinstance(c, str):
                        n += len(c.encode())
                    else:
                        stack.append(c)
            elif isinstance(x, Comment):
                n += len(x.text.encode()) + 7
            else:
                n += len(escape(x, quote=False).replace("\xa0", "&nbsp;").encode())
        return n


class Comment:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.html = Node("html", {}, None)
        self.head = Node("head", {}, self.html)
        self.body: Node | None = None
        self.html.children.append(self.head)
        self.at = self.head

    def _in_body(self) -> None:
        if self.body is None:
            self.body = Node("body", {}, self.html)
            self.html.children.append(self.body)
            self.at = self.body

    def _end(self, tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        """Ends the innermost run of open elements up to the outermost of tags that no wall is around."""
        x, last = self.at, None
        while x is not None and x is not self.body and x.tag not in walls:
            if x.tag in tags:
                last = x
            x = x.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            if tag == "body":
                self._in_body()
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in own.items():
                node.attrs.setdefault(k, v)
            return
        if self.body is None and not (tag in HEAD and (self.at is self.head or self.at.tag in ("noscript", "template"))):
            self._in_body()
        if tag in CLOSES_P:
            self._end({"p"}, WALLS)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.at.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.at = self.at.parent
        if tag == "tr" and self.at.tag == "table":
            self._open("tbody", {})
        elif tag in ("td", "th"):
            if self.at.tag == "table":
                self._open("tbody", {})
            if self.at.tag in ("tbody", "thead", "tfoot"):
                self._open("tr", {})
        if tag == "a" and self.at.tag == "a":
            self.at = self.at.parent
        self._open(tag, own)
        if tag in VOID:
            self.at = self.at.parent

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        self.at = node

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body"):
            return
        if tag == "head":
            if self.body is None:
                self._in_body()
            return
        x = self.at
        while x is not None and x not in (self.html, self.head, self.body):
            if x.tag == tag:
                self.at = x.parent
                return
            if x.tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                break
            x = x.parent
        if tag == "p":  # an end tag alone is an empty paragraph
            self._in_body()
            self._open("p", {})
            self.at = self.at.parent

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # outside foreign content the slash means nothing

    def handle_data(self, data: str) -> None:
        if self.body is None and self.at is self.head:
            if not data.strip(" \t\n\r\f"):
                return
            self._in_body()
        kids = self.at.children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)

    def handle_comment(self, data: str) -> None:
        self.at.children.append(Comment(data))


def parse(html: str) -> Node:
    """The html element. Any input gives a tree."""
    b = _Builder()
    try:
        b.feed(html)
        b.close()
    except AssertionError:  # the parser gives up on some broken declarations; what it has read stays
        pass
    b._in_body()
    return b.html


def size_of(text: str) -> int:
    return len(text.encode())


def count_words(text: str) -> int:
    return len(text.split())


# Parts of class and id names that tell a page's content.
CONTENT_CLASS = ["content", "article", "post-body", "entry-content", "post-content"]
CONTENT_ID = ["content", "article", "post"]


def main_area(root: Node, least_words: int) -> Node | None:
    """The first valid area: of articles, then of main elements, then of those named like content."""
    every = list(root.walk())
    for test in (
        lambda x: x.tag == "article",
        lambda x: x.tag == "main" or x.attrs.get("role") == "main",
        lambda x: any(p in x.attrs.get("class", "") for p in CONTENT_CLASS) or any(p in x.attrs.get("id", "") for p in CONTENT_ID),
    ):
        for x in every:
            if test(x) and count_words(x.text()) >= least_words:
                return x
    return None


def content_of(root: Node, least_words: int = 25) -> dict:
    """What the content area holds, before any filter."""
    area = main_area(root, least_words)
    top = area if area is not None else next(root.select("body"))
    every = [top, *top.walk()] if area is not None else list(top.walk())
    of = lambda *tags: [x for x in every if x.tag in tags]
    code = [t for x in of("pre") if (t := x.text())]
    for x in of("code"):
        t = x.text()
        if size_of(t) > 20 and not any(t in c for c in code):
            code.append(t)
    return {
        "found_main_content": area is not None,
        "headings": [{"level": int(x.tag[1]), "text": t} for x in of("h1", "h2", "h3", "h4", "h5", "h6") if (t := x.text().strip())],
        "paragraphs": [x.text().strip() for x in of("p")],
        "items": [x.text().strip() for x in of("li")],
        "quotes": [t for x in of("blockquote") if (t := x.text().strip())],
        "code_blocks": code,
    }


# --- JSON-LD

ARTICLES = ("Article", "NewsArticle", "BlogPosting")


def _str(x) -> str | None:
    return x if isinstance(x, str) else None


def _image(x) -> str | None:
    if isinstance(x, list):
        return _image(x[0]) if x else None
    return _str(x.get("url")) if isinstance(x, dict) else _str(x)


def json_ld(blocks: list[str], strict: bool = False) -> dict | None:
    """Fields of the article blocks, null if there is none. strict: blocks with a field of a wrong type, or with both name and headline, are passed over."""
    out: dict | None = None
    for raw in blocks:
        try:
            d = json.loads(raw)
        except ValueError:
            continue
        if not isinstance(d, dict) or (strict and not _well_typed(d)):
            continue
        kinds = d.get("@type")
        kinds = [kinds] if isinstance(kinds, str) else [k for k in kinds if isinstance(k, str)] if isinstance(kinds, list) else []
        get = lambda *names: next((d[n] for n in names if d.get(n) is not None), None)  # noqa: B023, E731
        published = _str(get("datePublished", "date_published"))
        if not any(a in k for k in kinds for a in ARTICLES) and published is None:
            continue
        o = out = out or {"authors": []}
        for field, value in (("title", _str(get("headline", "name"))), ("description", _str(get("description"))), ("date_published", published), ("date_modified", _str(get("dateModified", "date_modified")))):
            if o.get(field) is None:
                o[field] = value
        author = get("author")
        if isinstance(author, list):
            for a in author:
                if isinstance(a, dict) and (name := _str(a.get("name"))) is not None:
                    o.setdefault("author", name)
                    o["authors"].append(name)
        elif (name := _str(author.get("name")) if isinstance(author, dict) else _str(author)) is not None:
            o["author"] = name
            o["authors"].append(name)
        if isinstance(p := get("publisher"), dict):
            o["publisher"] = _str(p.get("name"))
        if (image := get("image")) is not None:
            o["og_image"] = _image(image)
        n = get("wordCount", "word_count")
        o["word_count"] = n if isinstance(n, int) and not isinstance(n, bool) and n >= 0 else int(n) if not strict and isinstance(n, str) and n.isdecimal() else None
        o["section"], o["language"] = _str(get("articleSection", "article_section")), _str(get("inLanguage", "in_language"))
        if (entity := get("mainEntityOfPage", "main_entity_of_page")) is not None:
            o["canonical_url"] = _str(entity.get("@id")) if isinstance(entity, dict) else _str(entity)
    return out


def _well_typed(d: dict) -> bool:
    texts = ["name", "headline", "description", "datePublished", "dateModified", "articleSection", "inLanguage"]
    n = d.get("wordCount")
    return not ("name" in d and "headline" in d) and all(d.get(k) is None or isinstance(d[k], str) for k in texts) and (n is None or (isinstance(n, int) and not isinstance(n, bool) and n >= 0))


def head_of(root: Node, strict: bool = False) -> dict:
    """Candidates for a page's metadata."""
    first = lambda *tags: next(root.select(*tags), None)
    text = lambda x: (x.text().strip() or None) if x is not None else None
    canonical = next((x for x in root.select("link") if x.attrs.get("rel") == "canonical"), None)
    time = next((x for x in root.select("time") if "datetime" in x.attrs), None)
    article = first("article")
    return {
        "json_ld": json_ld([x.text() for x in root.select("script") if x.attrs.get("type") == "application/ld+json"], strict),
        "metas": [{"name": x.attrs.get("name"), "property": x.attrs.get("property"), "content": x.attrs["content"]} for x in root.select("meta") if x.attrs.get("content")],
        "canonical": canonical.attrs.get("href") if canonical is not None else None,
        "lang": root.attrs.get("lang"),
        "title": text(first("title")),
        "h1": text(first("h1")),
        "time": time.attrs["datetime"] if time is not None else None,
        "article": article.text() if article is not None else None,
        "body_words": count_words(next(root.select("body")).text()),
    }


def tables_of(root: Node, nested_least: int = 1) -> list[dict]:
    """Each table's counts, headers and rows."""
    out = []
    for t in root.select("table"):
        head, body = next(t.select("thead"), None), next(t.select("tbody"), None)
        rows = list(t.select("tr"))
        cells = lambda x, tag: [c.text().strip() for c in x.select(tag)]
        headers = cells(head, "th") if head is not None else []
        headers = headers or (cells(rows[0], "th") if rows else []) or (cells(rows[0], "td") if rows else [])
        data = rows[1:] if (head is None and headers) or body is None else list(body.select("tr"))
        got = [c for r in data if any(c := cells(r, "td"))]
        out.append({
            "has_thead": head is not None, "has_tbody": body is not None, "has_th": next(t.select("th"), None) is not None, "nested": sum(1 for _ in t.select("table")) >= nested_least,
            "role": t.attrs.get("role"), "text_bytes": size_of(t.text().strip()), "nodes": t.nodes(), "headers": headers, "rows": got,
        })
    return out


def density_of(root: Node) -> dict:
    body = next(root.select("body"))
    parts = list(body.texts())
    links = [s for a in root.select("a") if "href" in a.attrs for s in a.texts()]
    return {
        "words": count_words(" ".join(parts)), "html_bytes": root.size(), "text_bytes": sum(size_of(s.strip()) for s in parts), "link_bytes": sum(size_of(s.strip()) for s in links),
        "has_article": next(root.select("article", "main"), None) is not None,
    }
