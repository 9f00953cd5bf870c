"""What each check asks, as severity expressions: 0 pass, 1 warn, 2 fail, null where it does not apply.

PAGE rules are evaluated on every page and rolled up per site, HOME rules on the home page, SITE rules on a site's row of well-known files.
All rules of a level are columns of one pass over the features. Checks that need other rows are in ``joins``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import text as T
from ...functions import urls as U

c = F.col


def sql(x: str) -> Column:
    return F.expr(x)


def when(*pairs: object) -> Column:
    """when(condition, severity, ..., otherwise)."""
    *cases, last = pairs
    out = None
    for cond, sev in zip(cases[::2], cases[1::2], strict=True):
        cond = sql(cond) if isinstance(cond, str) else cond
        out = F.when(cond, sev) if out is None else out.when(cond, sev)
    return out.otherwise(last)


def share(part: str, whole: str, good: float, fair: float | None) -> Column:
    """Pass from ``good`` on, warn from ``fair`` on (null: always); null if there is nothing to count."""
    p, w = sql(part), sql(whole)
    worse = F.lit(1) if fair is None else F.when(p / w >= fair, 1).otherwise(2)
    return F.when(w > 0, F.when(p / w >= good, 0).otherwise(worse))


def header(name: str) -> str:
    return f"coalesce(headers['{name}'], '')"


def meta(name: str) -> str:
    return f"coalesce(metas['{name}'], '')"


def directives() -> Column:
    return F.concat(T.directive_tokens(sql("headers['x-robots-tag']")), T.directive_tokens(sql("metas['robots']")))


def has(token: str) -> Column:
    return F.array_contains(directives(), token)


def article() -> Column:
    return sql(r"arrays_overlap(node_types, array('Article','NewsArticle','BlogPosting','TechArticle','ScholarlyArticle','Report','LiveBlogPosting','ReportageNewsArticle','OpinionNewsArticle','AdvertiserContentArticle')) OR path RLIKE '(?i)/(blog|news|article|articles|posts?|stories)(/|$|\\.)'")


DESCRIPTION = meta("description")


def local() -> Column:
    return U.is_local_host(c("host"))


def heads() -> Column:
    return sql("filter(headings, h -> h.level IN (2, 3))")


def modified() -> Column:
    return F.greatest(*[T.parse_date(sql(x)) for x in ("published", "modified", "metas['article:modified_time']", "metas['article:published_time']", "try_element_at(times, 1)")])


def months(as_of: str) -> Column:
    return (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(modified())) / (365.25 * 86400 / 12)


def vitals(value: str, good: float, poor: float) -> Column:
    v = sql(value)
    return F.when(v.isNotNull(), F.when(v <= good, 0).when(v <= poor, 1).otherwise(2))


_SOCIAL = r"(?i)(^|\\.)(facebook|twitter|x|instagram|linkedin|youtube|youtu\\.be|tiktok|pinterest|reddit|t\\.me|threads\\.net|mastodon\\.[a-z]+|fb\\.com|bsky\\.app|discord\\.(gg|com)|whatsapp\\.com|twitch\\.tv)\\b"
_BAD_ALT = r"(?i)^(image|images|photo|photos|picture|pic|img|graphic|untitled|thumbnail|spacer)$|\\.(jpe?g|png|gif|webp|avif|svg|bmp|tiff?)$|^(img|dsc|image|photo|screenshot|scan)[-_ ]?\\d{2,}$"
_HOST = r"lower(regexp_extract(l.url, '^https?://([^/?#]*)', 1))"
_INTERNAL = f"filter(links, l -> {_HOST} = host)"
_HIT = r"(?i)(^|[^a-z])(hit|stale|revalidated|updating|prerender)([^a-z]|$)"
_EDGE = "array('cf-ray','cf-cache-status','x-amz-cf-id','x-vercel-id','x-vercel-cache','x-nf-request-id','fastly-request-id','x-fastly-request-id','x-akamai-transformed','akamai-grn','x-azure-ref','x-sucuri-id','x-bunny-cache-status','x-litespeed-cache','x-cache','x-cache-status','x-served-by','x-cdn','age','via')"
_STATUS = " || ' ' || ".join(header(h) for h in ("cf-cache-status", "x-vercel-cache", "x-cache", "x-cache-status", "x-bunny-cache-status", "x-litespeed-cache"))


def page_rules(as_of: str) -> dict[str, tuple[str, Column]]:
    """id -> (rollup, severity). Rollups: agg (share of offenders), sev (worst), warn (any offender warns), any (any offender fails)."""
    forms_bad = "exists(forms, f -> NOT f.submit OR f.disabled)"
    forms_weak = r"exists(forms, f -> coalesce(f.action, '') RLIKE '^\\s*(javascript:|#)' OR NOT f.named)"
    lead = F.array_join(F.slice(c("paragraphs"), 1, 2), " ")
    parity = sql("mount_chars < 50 AND length(body_text) < 200")
    depth = F.when(article(), 300).otherwise(150)
    age = months(as_of)
    title_len, h1 = F.length(c("title")), sql("try_element_at(h1s, 1)")
    core = F.array_distinct(F.concat(T.topic_tokens(F.coalesce(c("title"), F.lit(""))), T.topic_tokens(F.coalesce(h1, F.lit("")))))
    core = F.array_except(core, F.coalesce(c("brand"), F.array().cast("array<string>")))
    support = F.array_except(F.array_except(F.array_distinct(T.topic_tokens(sql(DESCRIPTION))), core), F.coalesce(c("brand"), F.array().cast("array<string>")))
    prose_text = F.array_join(sql("transform(filter(blocks, b -> b.level = 0), b -> b.text)"), " ")
    prose = F.array_distinct(T.topic_tokens(prose_text))
    focus = (2 * F.size(F.array_intersect(core, prose)) + F.size(F.array_intersect(support, prose))) / (2 * F.size(core) + F.size(support))
    label = F.coalesce(T.is_error_label(c("title")), F.lit(False)) | F.coalesce(T.is_error_label(h1), F.lit(False))
    return {
        # ai-access
        "meta-robots-noindex": ("sev", when(has("noindex") & has("index"), 1, has("noindex") | has("none"), 2, has("nofollow"), 1, 0)),
        "snippet-preview-directives": ("sev", when(has("nosnippet") | has("max-snippet:0") | has("max-image-preview:none") | has("max-video-preview:0"), 2, F.exists(directives(), lambda x: x.rlike("^max-(snippet|image-preview|video-preview):")), 0, 1)),
        # llm-content
        "agent-usability": ("sev", when("size(forms) = 0", F.lit(None), forms_bad, 2, forms_weak, 1, 0)),
        "hedging-rate": ("warn", when("main_words < 150", F.lit(None), T.hedge_count(lead) >= 2, 1, 0)),
        "answer-units": ("warn", when("main_words < 300", F.lit(None), F.exists("units", T.is_answer_unit), 0, 1)),
        "chunk-boundary": ("warn", when("main_words < 150", F.lit(None), "long_tables + loose_lists > 0", 1, 0)),
        "injection-hygiene": ("sev", when(F.lower(c("hidden_text")).rlike(f"(?iu){T.INSTRUCTIONS}"), 2, "hidden_blocks > 0", 1, rf"exists(links, l -> l.in_ugc AND {_HOST} <> host AND l.rel NOT RLIKE '\\b(ugc|nofollow|sponsored)\\b')", 1, 0)),
        "content-without-js": ("agg", when("length(body_text) < 200", 2, 0)),
        "content-depth": ("agg", when(c("main_words") < depth, 2, 0)),
        "content-lead-answer": ("sev", when(F.lower(F.substring("main_text", 1, 600)).rlike(r"\b(tl;?dr|en bref|in short|key takeaways?|résumé)\b") | sql("exists(slice(paragraphs, 1, 2), p -> length(p) BETWEEN 40 AND 320)"), 0, "exists(paragraphs, p -> length(p) BETWEEN 40 AND 320) OR exists(slice(paragraphs, 1, 2), p -> length(p) > 320)", 1, "main_words >= 150", 2, 0)),
        "answer-headings": ("warn", when("main_words < 300", F.lit(None), F.exists(heads(), lambda h: T.is_question(h["text"]) | h["text"].rlike(r"(?i)^(best|top|vs\.?|meilleurs?|meilleures?)\b")), 0, 1)),
        "extractable-structure": ("sev", when("main_words < 150", F.lit(None), "has_list OR has_th", 0, 1)),
        "content-freshness": ("sev", when(~article(), F.lit(None), modified().isNull() | (age > 24), 2, age > 12, 1, "(published IS NULL) <> (modified IS NULL)", 1, 0)),
        "content-author-eeat": ("sev", when(~article(), F.lit(None), "author IS NOT NULL AND byline", 0, "author IS NOT NULL OR byline", 1, 2)),
        "outbound-citations": ("sev", when("main_words < 150", F.lit(None), rf"exists(links, l -> l.in_main AND l.url IS NOT NULL AND {_HOST} <> host AND NOT {_HOST} RLIKE '{_SOCIAL}')", 0, 1)),
        "csr-content-parity": ("agg", when(parity, 2, 0)),
        # technical-seo
        "canonical": ("agg", when("size(canonicals) = 0", 2, "size(canonicals) > 1", 2, F.coalesce(U.host(sql("try_element_at(canonicals, 1)")) != c("host"), F.lit(True)), 2, (U.scheme(sql("try_element_at(canonicals, 1)")) != "https") & ~local(), 2, U.canonical_identity(sql("try_element_at(canonicals, 1)")) != U.canonical_identity(c("url")), 2, 0)),
        "soft-error-pages": ("sev", when(label & (c("main_words") <= 400), 2, "NOT is_home AND main_words < 15 AND size(filter(images, i -> i.in_main)) < 2", 1, 0)),
        "pagination-canonical": ("any", when(F.coalesce(U.page_number(c("url")), F.lit(1)) <= 1, F.lit(None), "size(canonicals) = 0", 0, F.exists("canonicals", lambda x: U.canonical_identity(x) == U.canonical_identity(c("url"))), 0, 2)),
        "meta-refresh": ("any", when(r"refresh RLIKE '(?i)url\\s*='", 2, 0)),
        "hreflang-x-default": ("sev", when("size(alternates) = 0", F.lit(None), F.exists("alternates", lambda a: (a["lang"] != "x-default") & ~T.is_bcp47(a["lang"])), 2, r"NOT exists(alternates, a -> a.lang = 'x-default') OR exists(alternates, a -> a.href NOT RLIKE '^https?://')", 1, ~F.exists("alternates", lambda a: U.canonical_identity(a["url"]) == U.canonical_identity(c("url"))), 1, 0)),
        # on-page
        "meta-per-page": ("agg", when(title_len.between(10, 70) & F.length(sql(DESCRIPTION)).between(50, 160), 0, 2)),
        "unique-titles": ("agg", when("same_title > 1 OR same_description > 1", 2, 0)),
        "headings-outline": ("agg", when("size(filter(h1s, h -> h <> '')) = 1 AND NOT exists(sequence(2, greatest(size(headings), 2)), i -> try_element_at(headings, i).level > try_element_at(headings, i - 1).level + 1)", 0, 2)),
        "topical-focus": ("warn", when((F.size(core) < 3) | (T.word_count(prose_text) < 100), F.lit(None), focus < 0.35, 1, 0)),
        # performance
        "render-blocking-js": ("sev", when("blocking_js = 0", 0, "blocking_js <= 2", 1, 2)),
        "cdn-edge-cache": ("warn", when(f"NOT exists({_EDGE}, h -> headers[h] IS NOT NULL) AND lower({header('server')} || ' ' || {header('via')}) NOT RLIKE 'cloudflare|cloudfront|akamai|varnish|fastly|ecacc|nginx-cache'", F.lit(None), f"({_STATUS}) RLIKE '{_HIT}' OR try_cast(headers['age'] AS int) > 0", 0, rf"{header('cache-control')} RLIKE '(?i)(max-age=[1-9]|s-maxage=[1-9]|public)'", 1, F.lit(None))),
        # accessibility
        "html-lang": ("lang", when("coalesce(trim(lang), '') = ''", 2, ~T.is_bcp47(c("lang")), 1, 0)),
        "landmarks": ("agg", when("has_main AND regions >= 2", 0, "has_main OR regions > 0", 1, 2)),
        "rgaa-eaa-deadline": ("warn", when("coalesce(trim(lang), '') = '' OR NOT (has_main OR regions > 0) OR exists(images, i -> i.alt IS NULL)", 1, 0)),
        # security
        "mixed-content": ("sev", when("url NOT LIKE 'https:%'", F.lit(None), "exists(assets, a -> a.raw LIKE 'http://%' AND a.kind IN ('js', 'css', 'iframe'))", 2, "exists(assets, a -> a.raw LIKE 'http://%')", 1, 0)),
    }


def total_rules() -> dict[str, Column]:
    """Checks over sums of a site's pages, as severities over aggregates of the names in ``TOTALS``."""
    return {
        "schema-coverage": when("with_jsonld / n_pages >= 0.5", 0, "with_jsonld > 0", 1, 2),
        "images-alt": share("images_alt", "images_all", 0.9, 0.7),
        "alt-descriptive": share("alts_good", "alts", 0.9, 0.7),
        "img-dimensions": share("images_sized", "images_all", 0.9, 0.7),
        "form-labels": when("controls = 0", F.lit(None), "unnamed = 0", 0, "unnamed > 2 OR unnamed / controls > 0.2", 2, 1),
        "link-text": when("links_all = 0", F.lit(None), "nameless = 0", 0, "nameless <= 2", 1, 2),
        "iframe-title": when("iframes = 0", F.lit(None), "untitled = 0", 0, "untitled = 1", 1, 2),
        "anchor-text": when("internal = 0", F.lit(None), "generic / internal < 0.1", 0, "generic / internal < 0.5", 1, 2),
        "crawlable-nav": when("links_all + dead = 0", 1, "dead / (links_all + dead) > 0.5", 2, "dead / (links_all + dead) > 0.2", 1, 0),
        "figure-caption": when("figures = 0", F.lit(None), "captions = figures", 0, 1),
        "internal-link-context": when("n_pages < 5 OR internal = 0", F.lit(None), "internal_main / internal < 0.1", 1, 0),
        "consistent-help": when("helped = 0", F.lit(None), "helped = n_pages", 0, 1),
        "about-contact": when("about AND contact AND reachable", 0, "NOT (about OR contact OR reachable)", 2, 1),
    }


_HELP = r"(?i)\\b(contact|aide|assistance|support|help|faq)\\b"
_PATHS = r"concat(array(path), transform(links, l -> regexp_extract(l.url, '^https?://[^/?#]*([^?#]*)', 1)))"
TOTALS = {
    "n_pages": "count(*)",
    "with_jsonld": "count_if(sd['schema-coverage'] = 0)",
    "images_all": "sum(size(images))",
    "images_alt": "sum(size(filter(images, i -> i.alt IS NOT NULL)))",
    "alts": "sum(size(filter(images, i -> trim(i.alt) <> '')))",
    "alts_good": f"sum(size(filter(images, i -> length(trim(i.alt)) >= 3 AND trim(i.alt) NOT RLIKE '{_BAD_ALT}')))",
    "images_sized": "sum(size(filter(images, i -> i.sized)))",
    "controls": "sum(controls)",
    "unnamed": "sum(controls_unnamed)",
    "links_all": "sum(size(links))",
    "nameless": "sum(bare_anchors)",
    "dead": "sum(dead_anchors)",
    "iframes": "sum(iframes)",
    "untitled": "sum(iframes_untitled)",
    "internal": f"sum(size({_INTERNAL}))",
    "internal_main": f"sum(size(filter({_INTERNAL}, l -> l.in_main)))",
    "generic": rf"sum(size(filter({_INTERNAL}, l -> lower(trim(l.text)) IN ('', 'click here', 'read more', 'here', 'more', 'link') OR lower(trim(l.text)) RLIKE '^(https?://|www\\.)')))",
    "figures": "sum(size(filter(images, i -> i.in_main AND i.in_figure)))",
    "captions": "sum(size(filter(images, i -> i.in_main AND i.captioned)))",
    "helped": f"count_if(exists(links, l -> l.href RLIKE '(?i)^(mailto|tel):' OR l.href RLIKE '{_HELP}' OR l.text RLIKE '{_HELP}'))",
    "about": rf"bool_or(exists({_PATHS}, p -> p RLIKE '(?iu)^/(about(-us)?|a-propos|à-propos|qui-sommes-nous|notre-histoire)(/|\\.[a-z]+)?$'))",
    "contact": rf"bool_or(exists({_PATHS}, p -> p RLIKE '(?i)^/(contact(-us)?|nous-contacter|contactez-nous)(/|\\.[a-z]+)?$'))",
    "reachable": "bool_or(contact IS NOT NULL OR exists(links, l -> l.href RLIKE '(?i)^(mailto|tel):') OR exists(forms, f -> f.submit))",
}


def home_rules(as_of: str) -> dict[str, Column]:
    og, tw = (lambda k: meta(f"og:{k}")), (lambda k: f"coalesce(nullif({meta(f'twitter:{k}')}, ''), {meta(f'og:{k}')})")
    tokens = F.array_except(T.topic_tokens(F.coalesce(c("title"), F.lit(""))), F.coalesce(c("brand"), F.array().cast("array<string>")))
    heads = T.topic_tokens(sql("coalesce(try_element_at(h1s, 1), '')"))
    segments = T.title_segments(F.coalesce(c("title"), F.lit("")))
    scale = r"try_cast(regexp_extract(lower(metas['viewport']), 'maximum-scale\\s*=\\s*([0-9.]+)', 1) AS double)"
    csp, hsts = header("content-security-policy"), r"try_cast(regexp_extract(headers['strict-transport-security'], '(?i)max-age\\s*=\\s*\"?([0-9]+)', 1) AS bigint)"
    scripts = sql(rf"coalesce(try_element_at(filter(split(lower({csp}), ';'), d -> trim(d) RLIKE '^script-src( |$)'), 1), try_element_at(filter(split(lower({csp}), ';'), d -> trim(d) RLIKE '^default-src( |$)'), 1), '')")
    policies = "transform(split(lower(headers['referrer-policy']), ','), x -> trim(x))"
    known = "array('no-referrer','no-referrer-when-downgrade','origin','origin-when-cross-origin','same-origin','strict-origin','strict-origin-when-cross-origin','unsafe-url')"
    cloud = f"headers['cf-ray'] IS NOT NULL OR lower({header('server')}) LIKE '%cloudflare%'"
    charset = sql(rf"coalesce(charset, nullif(regexp_extract(lower({header('content-type')}), 'charset=\"?([a-z0-9_-]+)', 1), ''))")
    return {
        "homepage-ok": when("status = 200", 0, 2),
        "robots-directives": when(has("noindex") | has("noai"), 1, 0),
        "cloudflare-ai-defaults": when(cloud, 1, F.coalesce(c("robots_body").rlike(r"(?im)^\s*content-signal\s*:"), F.lit(False)), 1, 0),
        "pay-per-crawl": when("status = 402", 2, "exists(map_keys(headers), k -> k RLIKE '(?i)crawler-price')", 1, 0),
        "open-graph": when(rf"{og('title')} = '' OR {og('image')} NOT LIKE 'https://%'", 2, " OR ".join(f"{og(k)} = ''" for k in ("description", "type", "url", "site_name", "locale")), 1, 0),
        "twitter-card": when(rf"{meta('twitter:card')} IN ('summary', 'summary_large_image', 'app', 'player') AND {tw('title')} <> '' AND {tw('description')} <> '' AND {tw('image')} LIKE 'https://%'", 0, rf"{meta('twitter:card')} = '' AND {og('title')} <> '' AND {og('description')} <> '' AND {og('image')} LIKE 'https://%'", 0, f"{meta('twitter:card')} <> '' OR {og('title')} <> ''", 1, 2),
        "title-description": when(f"coalesce(title, '') = '' OR {DESCRIPTION} = ''", 2, f"length(title) BETWEEN 10 AND 70 AND length({DESCRIPTION}) BETWEEN 50 AND 160", 0, 1),
        "title-pattern": when("coalesce(title, '') = ''", 2, F.size(segments) < 2, 1, F.length(segments[0]) < F.length(F.element_at(segments, -1)), 1, 0),
        "title-h1-alignment": when("coalesce(title, '') = '' OR coalesce(try_element_at(h1s, 1), '') = ''", 2, F.size(F.array_intersect(tokens, heads)) == 0, 1, 0),
        "charset": when(charset.isNull(), 2, charset.isin("utf-8", "utf8"), 0, 1),
        "favicon": when("array_contains(icons, 'apple') AND (array_contains(icons, 'icon') OR coalesce(has_favicon, false))", 0, "array_contains(icons, 'icon') OR coalesce(has_favicon, false)", 1, 2),
        "content-readability": when("main_words < 20", 0, T.reading_grade(c("main_text")) <= 12, 0, 1),
        "html-weight": when("html_bytes <= 102400", 0, "html_bytes <= 256000", 1, 2),
        "render-blocking-css": when("blocking_css <= 2", 0, "blocking_css <= 4", 1, 2),
        "img-lazy-loading": when("size(images) = 0", F.lit(None), "try_element_at(images, 1).lazy", 1, "size(images) > 3 AND size(filter(slice(images, 4, greatest(size(images) - 3, 1)), i -> NOT i.lazy)) / (size(images) - 3) > 0.5", 1, 0),
        "img-next-gen": when("size(filter(images, i -> i.src RLIKE '(?i)[.](jpe?g|png|gif|webp|avif)([?#]|$)')) = 0", F.lit(None), "size(filter(images, i -> i.src RLIKE '(?i)[.](webp|avif)([?#]|$)')) / size(filter(images, i -> i.src RLIKE '(?i)[.](jpe?g|png|gif|webp|avif)([?#]|$)')) >= 0.5", 0, 1),
        "resource-hints": when("size(array_except(transform(filter(assets, a -> a.kind IN ('js', 'css') AND a.url IS NOT NULL AND lower(regexp_extract(a.url, '^https?://([^/?#]*)', 1)) <> host), a -> lower(regexp_extract(a.url, '^https?://([^/?#]*)', 1))), transform(hints, h -> lower(regexp_extract(h, '^(?:https?:)?//([^/?#]*)', 1))))) > 0", 1, 0),
        "dom-size": when("elements > 1400", 2, "elements > 800 OR depth > 32", 1, 0),
        "text-compression": when(f"{header('content-encoding')} RLIKE '(?i)(br|zstd|gzip)'", 0, 2),
        "inline-head-volume": when("inline_bytes <= 14336", 0, 1),
        "viewport": when(f"{meta('viewport')} <> ''", 0, 2),
        "viewport-zoom": when(f"{meta('viewport')} = ''", F.lit(None), rf"lower({meta('viewport')}) RLIKE 'user-scalable\\s*=\\s*(no|0)' OR {scale} <= 1", 2, f"{scale} < 2", 1, 0),
        "https": when(local(), F.lit(None), "url LIKE 'https://%'", 0, 2),
        "hsts": when(local(), F.lit(None), f"{hsts} >= 15552000", 0, f"{hsts} IS NOT NULL", 1, 2),
        "x-content-type-options": when(f"lower(trim({header('x-content-type-options')})) = 'nosniff'", 0, 2),
        "csp": when(f"{csp} = ''", 2, scripts.rlike(r"'unsafe-inline'|(^|\s)\*(\s|$)"), 1, 0),
        "clickjacking": when(rf"upper(trim({header('x-frame-options')})) IN ('DENY', 'SAMEORIGIN') OR (lower({csp}) RLIKE 'frame-ancestors' AND NOT lower({csp}) RLIKE 'frame-ancestors[^;]*\\*')", 0, 2),
        "referrer-policy": when(f"{header('referrer-policy')} = ''", 2, f"array_contains({policies}, 'unsafe-url') OR size(array_intersect({policies}, {known})) = 0", 1, 0),
        "permissions-policy": when("headers['permissions-policy'] IS NOT NULL", 0, 2),
    }


#: Structured-data checks that the JSON-LD pass has judged page by page, with their rollups.
GRAPH_RULES = {
    "json-ld": "sev", "json-ld-valid": "sev", "json-ld-entity": "sev", "sd-organization": "sev", "sd-entity-grounding": "sev", "sd-localbusiness": "sev", "sd-website-searchaction": "sev", "sd-video": "sev", "sd-special-types": "sev",
    "sd-graph-integrity": "sev", "sd-consistency": "sev", "sd-page-entity": "warn", "sd-article": "sev", "sd-product": "sev", "sd-faq": "warn", "sd-breadcrumb": "warn", "rich-result-eligibility": "sev",
}


def site_rules(as_of: str) -> dict[str, Column]:
    """Over a row of well-known files: structs robots, llms, llms_full, ai_json, security_txt, ... with status, type and body (null: not fetched)."""
    got = lambda r: f"coalesce({r}.status = 200, false)"
    plain = lambda r: f"(coalesce({r}.type, '') = '' OR {r}.type LIKE 'text/plain%')"
    line = r"regexp_replace(x, '#.*$', '')"
    lines = rf"filter(transform(split(robots.body, '\\r?\\n'), x -> trim({line})), x -> x RLIKE '(?i)^[a-z-]+\\s*:')"
    key = r"lower(regexp_extract(x, '^([A-Za-z-]+)', 1))"
    agents = rf"array_position(transform({lines}, x -> {key}), 'user-agent')"
    rules = rf"array_position(transform({lines}, x -> if({key} IN ('allow', 'disallow'), 'rule', 'other')), 'rule')"
    unknown = rf"exists({lines}, x -> {key} NOT IN ('user-agent', 'allow', 'disallow', 'sitemap', 'crawl-delay', 'host'))"
    expires = T.parse_date(F.regexp_extract(c("security_txt.body"), r"(?im)^expires:\s*(\S+)", 1))
    manifest = " OR ".join(rf"({got(x)} AND ltrim({x}.body) RLIKE '^[{{\\[]')" for x in ("agents_json", "agent_json", "ucp_json"))
    return {
        "agent-standards-signals": when(manifest, 0, F.lit(None)),
        "robots-exists": when(f"{got('robots')} AND {plain('robots')}", 0, 1),
        "robots-wellformed": when(f"NOT {got('robots')}", F.lit(None), f"NOT {plain('robots')} OR octet_length(robots.body) > 512000", 2, f"trim(robots.body) <> '' AND size({lines}) = 0", 2, f"{unknown} OR ({rules} > 0 AND ({agents} = 0 OR {rules} < {agents}))", 1, 0),
        "llms-txt": when(f"NOT {got('llms')}", 1, rf"llms.body RLIKE '(?m)^#\\s+\\S' AND exists(split(llms.body, '\\n'), x -> length(trim(x)) >= 10 AND x NOT LIKE '#%') AND llms.body RLIKE '(?m)^##\\s+\\S' AND size(filter(regexp_extract_all(llms.body, '\\[[^\\]]{{3,}}\\]\\(([^)\\s]+)[^)]*\\)', 1), x -> x NOT RLIKE '^[a-zA-Z][a-zA-Z0-9+.-]*:' AND x NOT LIKE '//%' OR lower(regexp_extract(x, '^(?:https?:)?//([^/?#]+)', 1)) = site_id)) >= 5", 0, 1),
        "llms-full-txt": when(rf"{got('llms_full')} AND regexp_count(llms_full.body, '\\S+') >= 2000 AND regexp_count(llms_full.body, '(?m)^#{{1,6}}\\s+\\S') >= 2", 0, 1),
        "well-known-ai-json": when(f"{got('ai_json')} AND coalesce(schema_of_variant(try_parse_json(ai_json.body)) LIKE 'OBJECT%', false)", 0, 1),
        "security-txt": when(f"NOT {got('security_txt')}", 1, r"security_txt.body RLIKE '(?im)^contact:\\s*\\S'", F.when(expires > F.to_timestamp(F.lit(as_of)), 0).otherwise(1), 1),
        "indexnow": when("indexnow_key IS NULL", F.lit(None), f"{got('indexnow')} AND trim(indexnow.body) = indexnow_key", 0, 2),
        "content-feed": when("coalesce(has_feed, false) OR coalesce(feed_found, false)", 0, 1),
        "custom-404": when("missing_page IS NULL", F.lit(None), "missing_page.body RLIKE '(?i)<nav|type=.?search|<a [^>]*href=.?/'", 0, 1),
        "soft-404": when("missing_page IS NULL", F.lit(None), "missing_page.status IN (404, 410)", 0, "missing_page.status = 200 OR missing_page.final_path = '/'", 2, 1),
    }
