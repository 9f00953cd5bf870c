"""The checks: names, families, evidence and points. Fixed values, in the order in which reports list them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Family weights of the overall score.
WEIGHTS = {"ai-access": 0.16, "llm-content": 0.18, "structured-data": 0.15, "technical-seo": 0.15, "on-page": 0.12, "performance": 0.10, "accessibility": 0.07, "security": 0.07}
#: Declared, but no part of the default registry; and those that run on request only.
UNREGISTERED = ("pay-per-crawl",)
OPT_IN = ("agent-standards-signals", "sameas-verified", "outbound-link-health")
# Check, evidence, points, by family.
CHECKS = {
    "ai-access": (
        ("agent-standards-signals", "measured", 0),
        ("robots-exists", "measured", 4),
        ("robots-wellformed", "measured", 4),
        ("search-crawlers-allowed", "measured", 6),
        ("ai-crawlers-allowed", "measured", 12),
        ("homepage-ok", "measured", 6),
        ("robots-directives", "measured", 4),
        ("ai-serving-parity", "measured", 8),
        ("ai-crawler-reachability", "measured", 6),
        ("cloudflare-ai-defaults", "measured", 3),
        ("pay-per-crawl", "measured", 2),
        ("meta-robots-noindex", "measured", 6),
        ("snippet-preview-directives", "measured", 4),
    ),
    "llm-content": (
        ("agent-usability", "heuristic", 4),
        ("freshness-coherence", "measured", 4),
        ("hedging-rate", "heuristic", 3),
        ("answer-units", "heuristic", 4),
        ("chunk-boundary", "heuristic", 3),
        ("chunk-retrieval-sim", "heuristic", 4),
        ("injection-hygiene", "heuristic", 3),
        ("llms-txt", "heuristic", 3),
        ("llms-full-txt", "heuristic", 2),
        ("content-without-js", "measured", 6),
        ("content-depth", "heuristic", 5),
        ("content-lead-answer", "heuristic", 5),
        ("answer-headings", "heuristic", 4),
        ("extractable-structure", "heuristic", 4),
        ("content-freshness", "measured", 5),
        ("content-author-eeat", "measured", 5),
        ("outbound-citations", "heuristic", 3),
        ("content-uniqueness", "heuristic", 3),
        ("csr-content-parity", "measured", 4),
        ("about-contact", "measured", 3),
        ("well-known-ai-json", "measured", 1),
        ("content-feed", "measured", 2),
        ("llms-txt-lint", "heuristic", 2),
    ),
    "structured-data": (
        ("entity-graph-connectivity", "measured", 4),
        ("open-graph", "measured", 5),
        ("schema-coverage", "measured", 5),
        ("sd-page-entity", "heuristic", 3),
        ("rich-result-eligibility", "measured", 4),
        ("sameas-verified", "measured", 3),
        ("sd-article", "measured", 4),
        ("sd-product", "measured", 4),
        ("sd-faq", "measured", 4),
        ("sd-breadcrumb", "measured", 3),
        ("nap-consistency", "measured", 3),
        ("json-ld", "measured", 10),
        ("twitter-card", "measured", 2),
        ("json-ld-entity", "measured", 6),
        ("json-ld-valid", "measured", 4),
        ("sd-organization", "measured", 4),
        ("sd-entity-grounding", "measured", 4),
        ("sd-localbusiness", "measured", 3),
        ("sd-website-searchaction", "measured", 2),
        ("sd-video", "measured", 2),
        ("sd-special-types", "measured", 3),
        ("sd-graph-integrity", "measured", 3),
        ("sd-consistency", "measured", 3),
    ),
    "technical-seo": (
        ("broken-subresources", "measured", 4),
        ("canonical", "measured", 5),
        ("indexing-conflicts", "measured", 4),
        ("internal-link-context", "heuristic", 3),
        ("internal-equity-leaks", "measured", 3),
        ("js-only-destinations", "heuristic", 3),
        ("broken-internal-links", "measured", 8),
        ("hreflang", "measured", 3),
        ("outbound-link-health", "measured", 3),
        ("sitemap", "measured", 10),
        ("indexnow", "measured", 4),
        ("sitemap-lastmod", "measured", 4),
        ("sitemap-urls-valid", "measured", 4),
        ("sitemap-index-limits", "measured", 2),
        ("sitemap-orphans", "measured", 3),
        ("soft-error-pages", "heuristic", 4),
        ("canonical-resolves", "measured", 4),
        ("www-consolidation", "measured", 5),
        ("trailing-slash", "measured", 4),
        ("redirect-chains", "measured", 4),
        ("soft-404", "measured", 6),
        ("custom-404", "measured", 2),
        ("url-structure", "heuristic", 3),
        ("pagination-canonical", "measured", 2),
        ("meta-refresh", "measured", 2),
        ("hreflang-x-default", "measured", 3),
        ("internal-linking", "measured", 4),
        ("crawlable-nav", "measured", 4),
        ("link-equity-map", "measured", 3),
    ),
    "on-page": (
        ("title-description", "heuristic", 8),
        ("anchor-target-profile", "heuristic", 3),
        ("unique-titles", "measured", 5),
        ("meta-per-page", "heuristic", 5),
        ("title-pattern", "heuristic", 3),
        ("title-h1-alignment", "heuristic", 2),
        ("headings-outline", "measured", 5),
        ("anchor-text", "heuristic", 3),
        ("charset", "measured", 3),
        ("favicon", "measured", 2),
        ("content-readability", "heuristic", 2),
        ("figure-caption", "heuristic", 2),
        ("topical-focus", "heuristic", 3),
        ("keyword-cannibalization", "heuristic", 3),
    ),
    "performance": (
        ("lighthouse-perf", "measured", 5),
        ("cwv-lcp", "measured", 6),
        ("cwv-cls", "measured", 4),
        ("cwv-inp", "measured", 4),
        ("cwv-assessment", "measured", 4),
        ("cwv-ttfb", "measured", 3),
        ("lab-tbt", "measured", 3),
        ("lab-fcp", "measured", 3),
        ("html-weight", "heuristic", 3),
        ("render-blocking-js", "measured", 4),
        ("render-blocking-css", "measured", 3),
        ("img-dimensions", "measured", 4),
        ("img-lazy-loading", "heuristic", 2),
        ("img-next-gen", "heuristic", 2),
        ("resource-hints", "heuristic", 2),
        ("dom-size", "measured", 2),
        ("text-compression", "measured", 3),
        ("asset-caching", "measured", 2),
        ("inline-head-volume", "heuristic", 2),
        ("http-protocol", "measured", 3),
        ("cdn-edge-cache", "heuristic", 2),
    ),
    "accessibility": (
        ("html-lang", "measured", 4),
        ("alt-descriptive", "heuristic", 3),
        ("landmarks", "measured", 4),
        ("form-labels", "measured", 3),
        ("link-text", "measured", 3),
        ("viewport-zoom", "measured", 3),
        ("iframe-title", "measured", 2),
        ("consistent-help", "measured", 2),
        ("rgaa-eaa-deadline", "measured", 2),
        ("viewport", "measured", 5),
        ("images-alt", "measured", 4),
    ),
    "security": (
        ("https", "measured", 5),
        ("redirect-hygiene", "measured", 4),
        ("mixed-content", "measured", 4),
        ("hsts", "measured", 4),
        ("x-content-type-options", "measured", 3),
        ("csp", "measured", 3),
        ("clickjacking", "measured", 3),
        ("referrer-policy", "measured", 2),
        ("permissions-policy", "measured", 2),
        ("security-txt", "measured", 2),
        ("tls-version", "measured", 3),
    ),
}


def rows() -> list[tuple[int, str, str, str, int, bool, bool]]:
    every = [(f, *c) for f, checks in CHECKS.items() for c in checks]
    return [(i, c, f, e, p, c not in UNREGISTERED, c in OPT_IN) for i, (f, c, e, p) in enumerate(every)]


def catalog(spark: SparkSession) -> DataFrame:
    """(ord, id, family, evidence, max_points, registered, opt_in)."""
    return spark.createDataFrame(rows(), "ord int, id string, family string, evidence string, max_points int, registered boolean, opt_in boolean")
