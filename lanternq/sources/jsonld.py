"""JSON-LD of a page: nodes, references, entity edges, and what the structured-data checks ask of one page.

Documents are dynamic and refer to each other by id, so that they are walked in Python, once per page, over Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

PASS, WARN, FAIL = 0, 1, 2
# Schema.org types.
ARTICLE_TYPES = frozenset("Article NewsArticle BlogPosting TechArticle ScholarlyArticle Report LiveBlogPosting ReportageNewsArticle OpinionNewsArticle AdvertiserContentArticle".split())
NAP_TYPES = frozenset("LocalBusiness OnlineBusiness Store Restaurant Bakery Cafe CafeOrCoffeeShop".split())
ORGANIZATION_TYPES = frozenset(
    "Organization Corporation NGO GovernmentOrganization EducationalOrganization OnlineBusiness LocalBusiness Store Restaurant Bakery Cafe CafeOrCoffeeShop Hotel LodgingBusiness MedicalBusiness ProfessionalService FinancialService HomeAndConstructionBusiness FoodEstablishment".split()
)
PAGE_TYPES = frozenset("WebPage AboutPage ContactPage CollectionPage ItemPage ProfilePage FAQPage".split()) | ARTICLE_TYPES
DURATION = re.compile(r"^P(?=\d|T)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(\d+(\.\d+)?H)?(\d+(\.\d+)?M)?(\d+(\.\d+)?S)?)?$", re.I)
DATE = re.compile(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
CURRENCY = re.compile(r"^[A-Z]{3}$")


@dataclass(frozen=True)
class Rule:
    """A field of a search feature: any of ``paths`` ('[]': in every element), with a shape, not asked of nested nodes if ``nested_exempt``."""

    paths: tuple[str, ...]
    shape: str = ""
    nested_exempt: bool = False


def _r(spec: str) -> Rule:
    """'path|or|or:shape', with a leading '~' where nested nodes are exempt."""
    names, _, shape = spec.lstrip("~").partition(":")
    return Rule(tuple(names.split("|")), shape, spec.startswith("~"))


# Search features with their types, condition, required and recommended fields.
RICH_RESULTS = [
    ("Article", {"Article", "NewsArticle", "BlogPosting"}, None, "", "author author.name author.url datePublished:date dateModified:date headline image"),
    ("Product snippet", {"Product"}, "!offers", "name review|aggregateRating|offers", "aggregateRating review"),
    ("Merchant listing", {"Product"}, "offers", "name image offers offers.price|offers.priceSpecification.price|offers.lowPrice offers.priceCurrency|offers.priceSpecification.priceCurrency:currency", "aggregateRating brand.name description gtin|gtin8|gtin12|gtin13|gtin14|isbn|mpn|sku offers.availability offers.itemCondition offers.priceValidUntil:date offers.url review"),
    ("Recipe", {"Recipe"}, None, "name image", "aggregateRating author cookTime:duration datePublished:date description keywords nutrition.calories prepTime:duration recipeCategory recipeCuisine recipeIngredient recipeInstructions recipeYield totalTime:duration video"),
    ("Event", {"Event"}, None, "name startDate:date location location.address", "description endDate:date eventStatus image location.name offers offers.availability offers.price offers.priceCurrency:currency offers.url organizer organizer.name performer performer.name"),
    ("Breadcrumb", {"BreadcrumbList"}, None, "itemListElement itemListElement[].name|itemListElement[].item.name itemListElement[].position:number", ""),
    ("Video", {"VideoObject"}, None, "name thumbnailUrl uploadDate:date", "contentUrl|embedUrl description duration:duration"),
    ("Review snippet", {"Review"}, None, "author ~itemReviewed ~itemReviewed.name reviewRating reviewRating.ratingValue:number", "datePublished:date reviewRating.bestRating:number reviewRating.worstRating:number"),
    ("Aggregate rating", {"AggregateRating"}, None, "~itemReviewed ~itemReviewed.name ratingValue:number ratingCount|reviewCount:number", "bestRating:number worstRating:number"),
]


def parsed(blocks: list[str]) -> tuple[list[object], int]:
    """Documents that parse, and how many do not."""
    good, bad = [], 0
    for b in blocks or []:
        try:
            good.append(json.loads(b))
        except (ValueError, RecursionError):
            bad += 1
    return good, bad


def flat(docs: list[object]) -> list[dict]:
    """Top-level nodes: arrays and ``@graph`` opened one level."""
    out: list[dict] = []
    for d in docs:
        for n in d if isinstance(d, list) else [d]:
            if isinstance(n, dict):
                graph = n.get("@graph")
                out.extend(x for x in graph if isinstance(x, dict)) if isinstance(graph, list) else out.append(n)
    return out


def types(n: dict) -> list[str]:
    t = n.get("@type")
    return [x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)]


def text(v: object) -> str:
    return v.strip() if isinstance(v, str) else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else ""


def is_ref(v: object) -> bool:
    return isinstance(v, dict) and isinstance(v.get("@id"), str) and all(k in ("@id", "@type") for k in v)


def walk(v: object, depth: int = 0) -> Iterator[tuple[dict, int]]:
    """Every object, with its depth."""
    stack = [(v, depth)]
    while stack:
        x, d = stack.pop()
        if isinstance(x, dict):
            yield x, d
            stack.extend((y, d + 1) for y in reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend((y, d) for y in reversed(x))


def values(node: object, path: str, ids: dict[str, dict]) -> list[object]:
    """Values at a dotted path; references are resolved, arrays are opened. A '[]' step demands a value of every element."""
    now: list[object] = [node]
    steps = path.split(".")
    for i, step in enumerate(steps):
        name, every, out = step.removesuffix("[]"), step.endswith("[]"), []
        for x in now:
            if isinstance(x, dict):
                v = x.get(name)
                for y in v if isinstance(v, list) else [v]:
                    y = ids.get(y["@id"], y) if is_ref(y) else y
                    if y not in (None, "", [], {}):
                        out.append(y)
        if every:
            rest = ".".join(steps[i + 1 :])
            return [y for x in out for y in values(x, rest, ids)] if out and all(values(x, rest, ids) for x in out) else []
        now = out
    return now


def _shaped(v: object, shape: str) -> bool:
    s = text(v)
    return {"": True, "date": bool(DATE.match(s)), "duration": bool(DURATION.match(s)), "currency": bool(CURRENCY.match(s)), "number": bool(re.match(r"^-?\d+([.,]\d+)?$", s))}[shape]


def rule_severity(node: dict, nested: bool, ids: dict[str, dict], required: str, recommended: str) -> int:
    def met(r: Rule) -> bool:
        return (nested and r.nested_exempt) or any((got := values(node, p, ids)) and all(_shaped(v, r.shape) for v in got) for p in r.paths)

    return FAIL if not all(met(_r(x)) for x in required.split()) else WARN if not all(met(_r(x)) for x in recommended.split()) else PASS


def _sames(n: dict) -> list[str]:
    v = n.get("sameAs")
    return [text(x) for x in (v if isinstance(v, list) else [v]) if text(x)]


def _organization(t: str) -> bool:
    return t in ORGANIZATION_TYPES or t.endswith(("Business", "Store"))


def entity_graph(docs: list[object]) -> tuple[list[tuple[str, str, str, bool]], list[tuple[str, str, str]]]:
    """Nodes (id, types, name, synthetic) and edges (from, to, property) of a page; references to nothing become nodes without a type."""
    nodes: dict[str, tuple[str, str, str, bool]] = {}
    edges: list[tuple[str, str, str]] = []
    made = 0
    stack: list[tuple[object, str | None, str]] = [(n, None, "") for n in reversed(flat(docs))]
    while stack:
        v, owner, prop = stack.pop()
        if isinstance(v, list):
            stack.extend((x, owner, prop) for x in reversed(v))
        elif isinstance(v, dict):
            key = v.get("@id") if isinstance(v.get("@id"), str) else None
            if key is None and not types(v):
                stack.extend((x, owner, prop) for k, x in reversed(list(v.items())) if not k.startswith("@"))
                continue
            if key is None:
                made += 1
                key = f"_:{made}"
            if owner is not None:
                edges.append((owner, key, prop))
            if not is_ref(v):
                nodes[key] = (key, ",".join(types(v)), text(v.get("name")), key.startswith("_:"))
                stack.extend((x, key, k) for k, x in reversed(list(v.items())) if not k.startswith("@"))
    for _, to, _ in edges:
        nodes.setdefault(to, (to, "", "", False))
    return list(nodes.values()), edges


def verdicts(blocks: list[str], url: str, visible: str, home: bool, video: bool, crumbs: bool, pairs: int) -> dict[str, int]:
    """Severity of each structured-data check that applies to one page."""
    docs, bad = parsed(blocks)
    nodes = flat(docs)
    every = [(n, d) for doc in nodes for n, d in walk(doc)]
    ids = {n["@id"]: n for n, _ in every if isinstance(n.get("@id"), str) and not is_ref(n)}
    of = lambda *names: next((n for n in nodes if set(types(n)) & set(names)), None)
    org = next((n for n in nodes if any(map(_organization, types(n)))), None)
    out: dict[str, int] = {"schema-coverage": PASS if docs else FAIL}
    https = lambda v: text(v.get("url") if isinstance(v, dict) else v[0] if isinstance(v, list) and v else v).startswith("https://")
    if home:
        out["json-ld"] = PASS if docs else FAIL
        if blocks:
            context = all("schema.org" in json.dumps(d.get("@context") if isinstance(d, dict) else [x.get("@context") for x in d if isinstance(x, dict)]) for d in docs if isinstance(d, (dict, list)))
            out["json-ld-valid"] = PASS if not bad and context and all(types(n) for n in nodes) else FAIL
            main = next((n for n in nodes if any(_organization(t) or t in PAGE_TYPES | {"Product", "Person", "WebSite", "Event", "Recipe", "Service"} for t in types(n))), None)
            local = main is not None and bool(set(types(main)) & NAP_TYPES)
            out["json-ld-entity"] = FAIL if main is None else WARN if local and not all(main.get(k) for k in ("name", "address", "telephone")) else PASS
            out["sd-organization"] = FAIL if org is None else PASS if org.get("name") and org.get("url") and https(org.get("logo")) and _sames(org) else WARN
            same = {s for n in nodes for s in _sames(n)}
            known = any(re.match(r"^https?://(([a-z]{2,3}\.)?wikipedia\.org/|(www\.)?wikidata\.org/(wiki|entity)/Q\d+)", s, re.I) for s in same)
            out["sd-entity-grounding"] = PASS if len(same) >= 2 and known else WARN if same else FAIL
        shop = next((n for n in nodes if set(types(n)) & NAP_TYPES or any(t.endswith("Business") for t in types(n))), None)
        if shop is not None:
            out["sd-localbusiness"] = FAIL if not (shop.get("address") and shop.get("telephone")) else PASS if isinstance(shop.get("address"), dict) and shop.get("geo") and (shop.get("openingHours") or shop.get("openingHoursSpecification")) else WARN
        if site := of("WebSite"):
            action = site.get("potentialAction")
            action = action[0] if isinstance(action, list) and action else action
            target = action.get("target") if isinstance(action, dict) else None
            target = target.get("urlTemplate") if isinstance(target, dict) else target
            out["sd-website-searchaction"] = PASS if isinstance(action, dict) and "SearchAction" in types(action) and "{" in text(target) and action.get("query-input") else WARN
        film = of("VideoObject")
        if video or film:
            ok = film and text(film.get("name")) and text(film.get("description")) and https(film.get("thumbnailUrl")) and DATE.match(text(film.get("uploadDate")))
            out["sd-video"] = FAIL if not ok else PASS if (film.get("contentUrl") or film.get("embedUrl")) and DURATION.match(text(film.get("duration"))) else WARN
        special = {"HowTo": ("name", "step"), "Event": ("name", "startDate", "location"), "Recipe": ("name", "recipeIngredient", "recipeInstructions")}
        if found := [n for n in nodes if set(types(n)) & set(special)]:
            out["sd-special-types"] = PASS if all(n.get(k) for n in found for t in types(n) for k in special.get(t, ())) else FAIL
        refs = {v["@id"] for n, _ in every for x in n.values() for v in (x if isinstance(x, list) else [x]) if is_ref(v)}
        owners = [n["@id"] for n, _ in every if isinstance(n.get("@id"), str) and not is_ref(n)]
        if refs or owners:
            out["sd-graph-integrity"] = FAIL if refs - set(owners) else WARN if len(owners) != len(set(owners)) else PASS
        claims = [text(v) for n in nodes for v in (n.get("name"), n.get("headline"), *values(n, "offers.price", ids), *values(n, "aggregateRating.ratingValue", ids)) if text(v)]
        out["sd-consistency"] = PASS if all(c.lower() in (visible or "").lower() for c in claims) else WARN
        subject = [n for n in nodes if set(types(n)) & PAGE_TYPES]
        if subject:
            anchored = lambda v: isinstance(v, dict) and bool(text(v.get("name")) and (v.get("@id") in ids or _sames(v)))
            tied = lambda n, *keys: [ids.get(v["@id"], v) if is_ref(v) else v for k in keys for v in (n.get(k) if isinstance(n.get(k), list) else [n.get(k)]) if v]
            good = all(any(map(anchored, tied(n, "about", "mainEntity"))) and (not tied(n, "mentions") or any(map(anchored, tied(n, "mentions")))) for n in subject)
            out["sd-page-entity"] = PASS if good else WARN
    if a := of(*ARTICLE_TYPES):
        dates = [text(a.get(k)) for k in ("datePublished", "dateModified")]
        hard = not text(a.get("headline")) or (dates[0] and not DATE.match(dates[0]))
        person = any("Person" in types(v) or "Organization" in types(v) for v in values(a, "author", ids) if isinstance(v, dict))
        soft = len(text(a.get("headline"))) > 110 or not person or not all(dates) or not a.get("image") or not values(a, "publisher.logo", ids)
        out["sd-article"] = FAIL if hard else WARN if soft else PASS
    if p := of("Product"):
        price = values(p, "offers.price", ids) or values(p, "offers.lowPrice", ids)
        rating = [float(text(v).replace(",", ".")) for v in values(p, "aggregateRating.ratingValue", ids) if re.match(r"^\d+([.,]\d+)?$", text(v))]
        hard = not price or not all(CURRENCY.match(text(v)) for v in values(p, "offers.priceCurrency", ids) or [""]) or any(not 0 <= r <= 5 for r in rating)
        soft = not all(p.get(k) for k in ("name", "image", "brand", "aggregateRating")) or not values(p, "offers.availability", ids) or not any(p.get(k) for k in ("gtin", "gtin8", "gtin12", "gtin13", "gtin14", "mpn", "isbn"))
        out["sd-product"] = FAIL if hard else WARN if soft else PASS
    faq = of("FAQPage")
    asked = len([q for q in values(faq, "mainEntity", ids) if isinstance(q, dict) and text(q.get("name")) and values(q, "acceptedAnswer.text", ids)]) if faq else 0
    if max(asked, pairs) >= 2:
        out["sd-faq"] = PASS if asked >= 2 else WARN
    if not home:
        trail = of("BreadcrumbList")
        steps = [x for x in values(trail, "itemListElement", ids) if isinstance(x, dict)] if trail else []
        places = [text(x.get("position")) for x in steps]
        ok = bool(steps) and sorted(places, key=lambda v: (len(v), v)) == [str(i + 1) for i in range(len(steps))] and all("ListItem" in types(x) and (text(x.get("name")) or values(x, "item.name", ids)) for x in steps) and all(x.get("item") for x in steps[:-1])
        out["sd-breadcrumb"] = PASS if ok or crumbs else WARN
    graded = [rule_severity(n, d > 0, ids, req, rec) for n, d in every for _, kinds, when, req, rec in RICH_RESULTS if set(types(n)) & kinds and (when is None or bool(n.get(when.strip("!"))) != when.startswith("!"))]
    if graded:
        out["rich-result-eligibility"] = max(graded)
    return out


SCHEMA = StructType(
    [
        StructField("sd", MapType(StringType(), IntegerType())),
        StructField("node_types", ArrayType(StringType())),
        StructField("same_as", ArrayType(StringType())),
        StructField("published", StringType()),
        StructField("modified", StringType()),
        StructField("author", StringType()),
        StructField("contact", StringType()),
        StructField("nap", MapType(StringType(), StringType())),
        StructField("nodes", ArrayType(StructType([StructField(x, StringType()) for x in ("id", "types", "name", "synthetic")]))),
        StructField("edges", ArrayType(StructType([StructField(x, StringType()) for x in ("src", "dst", "property")]))),
    ]
)


def page_graph(blocks: list[str], url: str, visible: str, home: bool, video: bool, crumbs: bool, pairs: int) -> dict:
    docs, _ = parsed(blocks)
    nodes = flat(docs)
    every = [n for d in nodes for n, _ in walk(d)]
    first = lambda k: next((text(n.get(k)) for n in nodes if text(n.get(k))), None)
    names, edges = entity_graph(docs)
    org = next((n for n in nodes if any(map(_organization, types(n)))), {})
    place = org.get("address")
    address = ", ".join(text(place.get(k)).lower() for k in ("streetAddress", "postalCode", "addressLocality") if text(place.get(k))) if isinstance(place, dict) else text(place).lower()
    phone = re.sub(r"^00", "+", re.sub(r"[^0-9+]", "", text(org.get("telephone"))))
    author = next((text(a.get("name")) if isinstance(a, dict) else text(a) for n in nodes for a in (n.get("author") if isinstance(n.get("author"), list) else [n.get("author")]) if a), None)
    return {
        "sd": list(verdicts(blocks, url, visible, home, video, crumbs, pairs).items()), "node_types": sorted({t for n in every for t in types(n)}), "same_as": sorted({s for n in every for s in _sames(n)}),
        "published": first("datePublished"), "modified": first("dateModified"), "author": author or None, "contact": next((text(n.get(k)) for n in every for k in ("telephone", "email") if text(n.get(k))), None),
        "nap": [(k, v) for k, v in (("name", text(org.get("name"))), ("phone", phone), ("address", address)) if v],
        "nodes": [{"id": i, "types": t, "name": n, "synthetic": str(s).lower()} for i, t, n, s in names], "edges": [{"src": s, "dst": d, "property": p} for s, d, p in edges],
    }


def with_graph(pages: DataFrame) -> DataFrame:
    """``pages`` (with columns jsonld, url, body_text, is_home, video, breadcrumb, faq_pairs) and what their JSON-LD says."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = ("jsonld", "url", "body_text", "is_home", "video", "breadcrumb", "faq_pairs")
    at = [pages.columns.index(n) for n in names]
    arrow = to_arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch], make: Callable = page_graph) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in at), strict=True)
            found = pa.RecordBatch.from_pylist([make(list(j or []), u or "", t or "", bool(h), bool(v), bool(c), int(p or 0)) for j, u, t, h, v, c, p in rows], arrow)
            yield pa.record_batch([*b.columns, *found.columns], [*b.schema.names, *arrow.names])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, *SCHEMA.fields]))
