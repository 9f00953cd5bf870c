"""One pass over HTML: each page is parsed once, and all that the checks need comes out as one row of features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of a key closes an open element of its values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CHROME = frozenset("script style noscript nav header footer aside".split())
_INERT = frozenset("script style template noscript".split())
_CHUNK = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dt dd figcaption tr".split())
# Inline styles that hide an element.
HIDDEN_STYLE = re.compile(
    r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?(?:\s|;|$)|font-size\s*:\s*0(?:px|em|rem|pt)?(?:\s|;|$)|text-indent\s*:\s*-\s*\d|clip\s*:\s*rect\(\s*0|(?:left|top)\s*:\s*-\s*\d{3,}", re.I
)
UGC = re.compile(r"comment|review", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def up(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def within(self, tags: frozenset[str] | set[str]) -> bool:
        return any(a.tag in tags for a in self.up())

    def text(self, skip: frozenset[str] = frozenset(), blocks: bool = False) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is self or x.tag not in skip:
                edge = blocks and (x.tag in _BLOCKS or x.tag in _CHUNK or x.tag == "br")
                stack.extend(reversed([*([" "] if edge else []), *x.children, *([" "] if edge else [])]))
        return _SPACE.sub(" ", "".join(out)).strip()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = {"p"} if tag in _BLOCKS and tag != "p" else CLOSES.get(tag, set())
        node: Node | None = self.at
        while closes and node is not None and node.tag not in ("#document", "ul", "ol", "table", "div", "section", "article", "main", "body"):
            if node.tag in closes:
                self.at = node.parent or self.root
            node = node.parent
        new = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def resolve(href: str | None, base: str | None) -> str | None:
    """Absolute http(s) URL without its fragment, host in lower case, default ports dropped; null if it is none."""
    try:
        u = urlsplit(urljoin(base or "", (href or "").strip()))
        if u.scheme not in ("http", "https") or not u.hostname:
            return None
        port = u.port
    except ValueError:
        return None
    host = u.hostname + (f":{port}" if port and (u.scheme, port) not in (("http", 80), ("https", 443)) else "")
    return f"{u.scheme}://{host}{u.path or '/'}" + (f"?{u.query}" if u.query else "")


def _link_name(a: Node, text: str) -> str:
    if text:
        return text
    for k in ("aria-label", "aria-labelledby", "title"):
        if a.attrs.get(k, "").strip():
            return a.attrs[k].strip()
    return next((n.attrs["alt"].strip() for n in a.walk() if n.tag == "img" and n.attrs.get("alt", "").strip()), "")


def srcset_urls(value: str | None) -> list[str]:
    """URLs of a srcset; commas separate candidates, but not within a URL or parentheses."""
    out, rest = [], (value or "").strip()
    while rest := rest.lstrip(" \t\n\r\f,"):
        url, _, rest = rest.partition(" ") if " " in rest else (rest, "", "")
        if url.endswith(","):
            out.append(url.rstrip(","))
            continue
        out.append(url)
        depth = 0
        for i, c in enumerate(rest):
            depth += (c == "(") - (c == ")")
            if c == "," and depth <= 0:
                rest = rest[i + 1 :]
                break
        else:
            rest = ""
    return [x for x in out if x]


_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
LINK = pa.struct([("pos", _I), ("href", _S), ("url", _S), ("text", _S), ("name", _S), ("rel", _S), ("in_main", _B), ("in_ugc", _B)])
IMAGE = pa.struct([("src", _S), ("url", _S), ("alt", _S), ("sized", _B), ("lazy", _B), ("in_main", _B), ("in_figure", _B), ("captioned", _B)])
FORM = pa.struct([("action", _S), ("submit", _B), ("disabled", _B), ("named", _B), ("fields", _I)])
ALTERNATE = pa.struct([("lang", _S), ("url", _S), ("href", _S)])
HEADING = pa.struct([("level", _I), ("text", _S)])
ASSET = pa.struct([("kind", _S), ("url", _S), ("raw", _S)])
SCRIPT_TARGET = pa.struct([("url", _S), ("raw", _S)])
SCHEMA = pa.schema(
    [("title", _S), ("h1s", pa.list_(_S)), ("headings", pa.list_(HEADING)), ("lang", _S), ("charset", _S), ("metas", pa.map_(_S, _S)), ("refresh", _S), ("canonicals", pa.list_(_S)), ("alternates", pa.list_(ALTERNATE)), ("icons", pa.list_(_S)), ("feeds", pa.list_(_S)), ("hints", pa.list_(_S))]
    + [("links", pa.list_(LINK)), ("images", pa.list_(IMAGE)), ("assets", pa.list_(ASSET)), ("forms", pa.list_(FORM)), ("iframes", _I), ("iframes_untitled", _I), ("controls", _I), ("controls_unnamed", _I), ("regions", _I), ("has_main", _B)]
    + [(x, _I) for x in ("blocking_js", "blocking_css", "inline_bytes", "elements", "depth", "hidden_blocks", "bare_anchors", "dead_anchors", "long_tables", "loose_lists", "faq_pairs", "main_words", "mount_chars")]
    + [("hidden_text", _S), ("main_text", _S), ("body_text", _S), ("footer_text", _S), ("paragraphs", pa.list_(_S)), ("units", pa.list_(_S)), ("blocks", pa.list_(HEADING)), ("jsonld", pa.list_(_S)), ("times", pa.list_(_S)), ("byline", _B), ("breadcrumb", _B), ("has_list", _B), ("has_th", _B), ("video", _B), ("script_targets", pa.list_(SCRIPT_TARGET))]
)
_TARGETS = [re.compile(p) for p in (r"(?:window\.|document\.)?location(?:\.href)?\s*=\s*['\"]([^'\"]+)['\"]", r"location\.(?:assign|replace)\(\s*['\"]([^'\"]+)['\"]", r"window\.open\(\s*['\"]([^'\"]+)['\"]", r"(?:router|history)\.push(?:State)?\(\s*['\"]([^'\"]+)['\"]", r"navigate\(\s*['\"]([^'\"]+)['\"]")]


def features(html: str | None, url: str | None) -> dict:
    """All features of one page. A null page has those of an empty one."""
    root = parse(html)
    nodes = list(root.walk())
    first = lambda *tags: next((n for t in tags for n in nodes if n.tag == t), None)
    body = first("body") or root
    scope = first("main", "article") or body
    inside = {id(n) for n in scope.walk() if not n.within(_CHROME) and n.tag not in _CHROME} if scope is not root else {id(n) for n in nodes}
    main_text = scope.text(_CHROME, True)
    out: dict = {k: [] for k in ("h1s", "headings", "canonicals", "alternates", "icons", "feeds", "hints", "links", "images", "assets", "forms", "paragraphs", "units", "blocks", "jsonld", "times", "script_targets")}
    out |= {k: 0 for k in ("iframes", "iframes_untitled", "controls", "controls_unnamed", "blocking_js", "blocking_css", "inline_bytes", "hidden_blocks", "bare_anchors", "dead_anchors", "long_tables", "loose_lists", "faq_pairs")}
    out |= {"title": None, "lang": None, "charset": None, "refresh": None, "metas": {}, "mount_chars": None, "byline": False, "breadcrumb": False, "has_list": False, "has_th": False, "video": False}
    regions, hidden, flagged = set(), [], set()
    labels = {n.attrs.get("for") for n in nodes if n.tag == "label"}
    depth: dict[int, int] = {id(root): 0}
    for n in nodes[1:]:
        depth[id(n)] = depth[id(n.parent)] + 1
        a, tag, own = n.attrs, n.tag, id(n) in inside
        role, kinds = a.get("role", ""), a.get("class", "")
        if tag == "title" and out["title"] is None and not n.within({"svg"}):
            out["title"] = n.text()
        elif tag == "html":
            out["lang"] = a.get("lang")
        elif tag == "meta":
            key = (a.get("property") or a.get("name") or a.get("http-equiv") or "").strip().lower()
            if a.get("charset"):
                out["charset"] = out["charset"] or a["charset"].strip().lower()
            elif key == "content-type" and "charset=" in a.get("content", "").lower():
                out["charset"] = out["charset"] or a["content"].lower().partition("charset=")[2].strip()
            if key == "refresh":
                out["refresh"] = a.get("content", "")
            if key and key not in out["metas"]:
                out["metas"][key] = a.get("content", "")
        elif tag == "link":
            rel, href = a.get("rel", "").lower().split(), a.get("href", "")
            if rel == ["canonical"] and href:
                u = resolve(href, url)
                if u and u not in out["canonicals"]:
                    out["canonicals"].append(u)
            if "alternate" in rel and a.get("hreflang"):
                out["alternates"].append({"lang": a["hreflang"].strip().lower(), "url": resolve(href, url), "href": href})
            if "alternate" in rel and re.search(r"rss|atom|feed\+json|json", a.get("type", "")):
                out["feeds"].append(resolve(href, url) or href)
            if "icon" in rel or "apple-touch-icon" in rel:
                out["icons"].append("apple" if "apple-touch-icon" in rel else "icon")
            if {"preconnect", "dns-prefetch"} & set(rel):
                out["hints"].append(href)
            if "stylesheet" in rel:
                out["assets"].append({"kind": "css", "url": resolve(href, url), "raw": href})
                if n.within({"head"}) and a.get("media", "").strip().lower() in ("", "all", "screen"):
                    out["blocking_css"] += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            text = n.text()
            out["headings"].append({"level": int(tag[1]), "text": text})
            if tag == "h1":
                out["h1s"].append(text)
        elif tag == "script":
            kind = a.get("type", "").strip().lower()
            if kind == "application/ld+json":
                out["jsonld"].append("".join(c for c in n.children if isinstance(c, str)))
            elif a.get("src"):
                out["assets"].append({"kind": "js", "url": resolve(a["src"], url), "raw": a["src"]})
                if n.within({"head"}) and not {"async", "defer", "nomodule"} & set(a) and kind != "module":
                    out["blocking_js"] += 1
        elif tag == "a":
            href, text = a.get("href"), n.text()
            if href is None or re.match(r"\s*(javascript:|#?$)", href):
                out["dead_anchors"] += 1
            if href is not None:
                name = _link_name(n, text)
                out["bare_anchors"] += not name
                ugc = any(UGC.search(f"{p.attrs.get('class', '')} {p.attrs.get('id', '')} {p.attrs.get('itemtype', '')}") for p in n.up())
                out["links"].append({"pos": len(out["links"]), "href": href, "url": resolve(href, url), "text": text, "name": name, "rel": a.get("rel", "").lower(), "in_main": own, "in_ugc": ugc})
        elif tag == "img":
            figure = next((p for p in n.up() if p.tag == "figure"), None)
            src = a.get("src", "")
            sized = bool(a.get("width") and a.get("height")) or "aspect-ratio" in a.get("style", "")
            out["images"].append({"src": src, "url": resolve(src, url), "alt": a.get("alt"), "sized": sized, "lazy": a.get("loading", "").lower() == "lazy", "in_main": own, "in_figure": figure is not None, "captioned": figure is not None and any(x.tag == "figcaption" for x in figure.walk())})
            out["assets"].extend({"kind": "img", "url": resolve(x, url), "raw": x} for x in (src, *srcset_urls(a.get("srcset"))) if x)
        elif tag == "form":
            fields = [x for x in n.walk() if x.tag in ("select", "textarea") or (x.tag == "input" and x.attrs.get("type", "text").lower() not in ("submit", "button", "image", "hidden", "reset"))]
            submits = [x for x in n.walk() if (x.tag == "button" and x.attrs.get("type", "submit").lower() == "submit") or (x.tag == "input" and x.attrs.get("type", "").lower() in ("submit", "image"))]
            out["forms"].append({"action": a.get("action"), "submit": bool(submits), "disabled": bool(submits) and all("disabled" in x.attrs for x in submits), "named": all(x.attrs.get("name") for x in fields), "fields": len(fields)})
        elif tag == "iframe":
            out["iframes"] += 1
            out["iframes_untitled"] += not (a.get("title", "").strip() or a.get("aria-label", "").strip())
            out["assets"].append({"kind": "iframe", "url": resolve(a.get("src"), url), "raw": a.get("src", "")})
            out["video"] |= bool(re.search(r"youtube|vimeo|dailymotion", a.get("src", "")))
        elif tag in ("video", "audio", "source"):
            out["video"] |= tag == "video"
            out["assets"].append({"kind": "media", "url": resolve(a.get("src"), url), "raw": a.get("src", "")})
        elif tag == "time" and a.get("datetime"):
            out["times"].append(a["datetime"])
        elif tag == "table" and own:
            rows = [x for x in n.walk() if x.tag == "tr"]
            heads = any(x.tag == "th" for x in n.walk())
            out["has_th"] |= heads
            out["long_tables"] += len(rows) > 10 and not heads
        elif tag in ("ul", "ol") and own:
            out["has_list"] = True
            if not n.within({"li"}) and n.parent is not None:
                at = [c for c in n.parent.children if isinstance(c, Node)]
                i = at.index(n)
                items = sum(isinstance(c, Node) and c.tag == "li" for c in n.children)
                out["loose_lists"] += items >= 3 and not (i and at[i - 1].tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "figcaption"))
        elif tag == "details":
            out["faq_pairs"] += any(x.tag == "summary" for x in n.walk())
        if tag in ("input", "select", "textarea") and a.get("type", "text").lower() not in ("hidden", "submit", "button", "reset", "image"):
            out["controls"] += 1
            named = any(a.get(k, "").strip() for k in ("aria-label", "aria-labelledby", "title")) or (a.get("id") in labels and a.get("id") is not None) or n.within({"label"})
            out["controls_unnamed"] += not named
        if n.within({"head"}) and (tag == "style" or (tag == "script" and not a.get("src"))):
            out["inline_bytes"] += len("".join(c for c in n.children if isinstance(c, str)).encode())
        if tag in ("header", "nav", "footer") or role in ("banner", "navigation", "contentinfo"):
            regions.add({"banner": "header", "navigation": "nav", "contentinfo": "footer"}.get(role, tag))
        if tag == "p" and own and (text := n.text()):
            out["paragraphs"].append(text)
        if tag in ("p", "li") and own:
            out["units"].append(n.text())
        if tag in _CHUNK and own and not any(x.tag in _CHUNK for x in n.walk() if x is not n):
            text = " | ".join(t for x in n.walk() if x.tag in ("td", "th") and (t := x.text())) if tag == "tr" else n.text()
            if text:
                out["blocks"].append({"level": int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0, "text": text})
        if tag not in _INERT and ("hidden" in a or HIDDEN_STYLE.search(a.get("style", ""))) and not any(id(p) in flagged for p in n.up()):
            text = n.text()
            if len(text.split()) >= 15:
                flagged.add(id(n))
                hidden.append(text)
        for k, v in a.items():
            if k.startswith("on") or (k == "href" and v.strip().lower().startswith("javascript:")):
                out["script_targets"].extend({"url": resolve(m, url), "raw": m} for p in _TARGETS for m in p.findall(v))
            elif k in ("data-href", "data-url", "data-link") and (tag == "button" or role in ("link", "button") or "onclick" in a or "tabindex" in a):
                out["script_targets"].append({"url": resolve(v, url), "raw": v})
        out["byline"] |= a.get("rel") == "author" or "author" in a.get("itemprop", "") or bool(re.search(r"\b(author|byline)\b", kinds))
        out["breadcrumb"] |= "breadcrumb" in f"{kinds} {a.get('aria-label', '')} {a.get('id', '')}".lower()
        if a.get("id") in ("root", "app", "__next", "__nuxt", "svelte") and "data-server-rendered" not in a:
            out["mount_chars"] = len(n.text())
    footer = first("footer")
    return out | {
        "elements": len(nodes) - 1, "depth": max(depth.values(), default=0), "regions": len(regions), "has_main": any(n.tag in ("main", "article") or n.attrs.get("role") in ("main", "article") for n in nodes), "hidden_blocks": len(hidden),
        "hidden_text": " ".join(hidden), "main_text": main_text, "main_words": len(main_text.split(" ")) if main_text else 0, "body_text": body.text(_INERT, True), "footer_text": footer.text(_INERT, True) if footer else "", "metas": list(out["metas"].items()),
    }


def _batches(html: int, url: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = pa.RecordBatch.from_pylist([features(h, u) for h, u in zip(part.column(html).to_pylist(), part.column(url).to_pylist(), strict=True)], SCHEMA)
                yield pa.record_batch([*(part.column(k) for k in keep), *found.columns], [*(part.schema.names[k] for k in keep), *found.schema.names])

    return run


def page_features(pages: DataFrame, html_col: str = "body", url_col: str = "url") -> DataFrame:
    """Columns of ``pages`` other than the HTML, and the features of each page."""
    from pyspark.sql.pandas.types import from_arrow_schema
    from pyspark.sql.types import StructType

    keep = [i for i, c in enumerate(pages.columns) if c != html_col]
    schema = StructType([*(f for f in pages.schema.fields if f.name != html_col), *from_arrow_schema(SCHEMA).fields])
    return pages.mapInArrow(_batches(pages.columns.index(html_col), pages.columns.index(url_col), keep), schema)
