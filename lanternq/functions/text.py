"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# English function words.
STOPWORDS_EN = (
    "a an the and or but of in on at to for with by from is are was were be been being it its this that these those "
    "as your you we our us i my me their they them all about into over up out no not so if than then here there when"
).split()
# Words without a topic in link texts, English, then French.
STOPWORDS_ANCHOR = (
    "a an the and or but of in on at to for with by from is are was were be been it its this that these those as "
    "your you we our us my me their they them all about into over up out no not so if than then here there when more "
    "page home homepage back learn read see view go click link new "
    "le la les un une des du de au aux et ou mais donc dans sur pour avec par chez sans sous est sont etre ete "
    "ce cet cette ces celui celle nos notre nous vos votre vous leur leurs plus moins tout tous toute toutes ici accueil "
    "retour voir lire savoir suite propos lien aller cliquez en ne si que qui quoi il ils elle elles on se sa son "
    "ses mon ma mes ton ta tes ete etait cela ceci nouveau"
).split()
# French function words, without accents.
STOPWORDS_FR = (
    "de du des le la les un une et ou en au aux dans sur sous pour par avec sans chez vers entre "
    "ce cet cette ces cela ceci qui que quoi dont est sont etre ete ont ainsi alors donc apres avant "
    "aussi mais quand lors chaque autre autres comme meme tres plus tout tous toute toutes ne pas ni si se "
    "il elle ils elles nous vous nos notre votre vos leur leurs mon ma mes sa ses"
).split()
# Hedging phrases, English then French.
HEDGES = (
    "maybe", "perhaps", "possibly", "arguably", "probably", "presumably", "seemingly", "apparently", "it seems", "it appears", "some say", "might be", "may be", "could be", "in some cases",
    "peut-être", "il semble", "il semblerait", "il paraît", "sans doute", "probablement", "apparemment", "éventuellement", "en principe", "a priori", "selon les cas", "dans certains cas", "cela dépend",
)
# First words that point back at an earlier passage, and phrases that do.
ANAPHORA = (
    "it", "this", "that", "these", "those", "they", "he", "she", "such", "il", "ils", "elle", "elles", "cela", "ceci", "c'est", "ce", "cet", "cette", "ces", "celui", "celle", "ceux", "celles",
    "celui-ci", "celle-ci", "ceux-ci", "celles-ci", "celui-là", "celle-là", "ceux-là", "celles-là", "celui-la", "celle-la", "ceux-la", "celles-la",
    "however", "moreover", "therefore", "also", "cependant", "toutefois", "donc", "ainsi",
)
CONNECTORS = ("de plus", "en outre", "par ailleurs")
# Words that open a question.
QUESTION_OPENERS = r"what|how|why|when|where|who|whose|which|can|could|should|will|would|does|do|did|is|are|was|were|quels?|quelles?|comment|pourquoi|quand|où|qui|combien|est-ce|qu['’]est-ce|peut-on|faut-il|doit-on"
# Anchor texts that say nothing.
GENERIC_ANCHORS = ("click here", "read more", "here", "more", "link")
# Instructions aimed at a model.
INSTRUCTIONS = (
    r"ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions|disregard\s+(?:all\s+)?(?:previous|prior|the\s+above)|as\s+an\s+ai\s+(?:language\s+)?model|system\s+prompt|respond\s+only\s+with"
    r"|you\s+must\s+(?:always\s+)?(?:recommend|say|answer|output)|always\s+recommend|do\s+not\s+mention|ignore[zr]?\s+les\s+instructions\s+(?:pr[ée]c[ée]dentes|ci-dessus)|en\s+tant\s+que\s+mod[èe]le"
    r"|r[ée]ponds?\s+uniquement|recommande\s+toujours|ne\s+mentionne\s+pas"
)
# Error pages by their whole label, by a phrase, by a status code.
ERROR_LABELS = (
    "error", "errors", "error page", "page error", "server error", "not found", "oops", "unavailable", "forbidden", "unauthorized", "bad request", "missing page",
    "erreur", "erreurs", "page derreur", "erreur de page", "introuvable", "non trouve", "non trouvee", "oups", "indisponible", "page manquante",
)
ERROR_PHRASES = (
    "page not found", "file not found", "content not found", "no such page", "page cannot be found", "page can not be found", "page cant be found", "page could not be found", "page couldnt be found", "page was not found",
    "page does not exist", "page doesnt exist", "page no longer exists", "page you are looking for", "page youre looking for", "page you requested", "cannot be found", "could not be found", "couldnt be found", "cant be found",
    "cannot find that page", "cant find that page", "could not find that page", "couldnt find that page", "cannot find the page", "cant find the page", "could not find the page", "couldnt find the page",
    "page unavailable", "page is unavailable", "no longer available", "internal server error", "service unavailable", "temporarily unavailable", "something went wrong", "an error occurred", "an error has occurred", "access denied",
    "introuvable", "non trouve", "nexiste pas", "na pas ete trouve", "page recherchee", "page demandee", "page indisponible", "nest plus disponible", "erreur interne", "erreur serveur", "erreur inattendue",
    "service indisponible", "temporairement indisponible", "une erreur est survenue", "une erreur sest produite", "un probleme est survenu", "quelque chose sest mal passe", "acces refuse", "acces interdit", "impossible de trouver", "nous navons pas trouve",
)
ERROR_CODES = (
    r"^[45][0-9][0-9]$|\b(?:error|erreur)(?: code| number| numero)? [45][0-9][0-9]\b|\b[45][0-9][0-9] (?:error|erreur)\b|\bhttp [45][0-9][0-9]\b"
    r"|\b[45][0-9][0-9] (?:not found|forbidden|unauthorized|bad request|gone|not acceptable|request timeout|too many requests|bad gateway|gateway timeout|non trouve|non trouvee|introuvable|interdit|non autorise)\b"
)
# Letters with marks, and the letters below them.
#: Letters that canonical decomposition splits into an ASCII letter and marks, and these letters.
_SPLIT = {x: unicodedata.normalize("NFD", x)[0] for x in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", x)) > 1 and unicodedata.normalize("NFD", x)[0].isascii()}
_MARKED, _PLAIN = "".join(_SPLIT), "".join(_SPLIT.values())


def collapse(text: Column) -> Column:
    """Blanks (also no-break ones) as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, " ﻿", "  "), r"[\x09-\x0D\x20]+", " "))


def fold_diacritics(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), "[̀-ͯ]", "")


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def tokenize(text: Column, stopwords: list[str] | None = None) -> Column:
    stop = F.array(*[F.lit(w) for w in (STOPWORDS_EN if stopwords is None else stopwords)])
    return F.filter(words_of(text), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def topic_tokens(text: Column) -> Column:
    return tokenize(fold_diacritics(text), [*STOPWORDS_EN, *STOPWORDS_FR])


def anchor_tokens(text: Column) -> Column:
    """Topic words of a link's text: more words count as empty than in a title."""
    return tokenize(fold_diacritics(F.lower(text)), STOPWORDS_ANCHOR)


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k words; all words if there are fewer."""

    def made(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))))

    # A lambda's variable, so that the words are found once and not for each shingle.
    return F.get(F.transform(F.array(words_of(text)), made), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def hedge_count(text: Column) -> Column:
    """Occurrences of hedging phrases between word bounds; neighbours may share a bound only once, as when splitting by the phrase."""
    stream = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.lower(text), "’", "'"), r"[^\p{L}\p{N}'-]+", " ")), F.lit(" "))
    return sum(((F.length(stream) - F.length(F.replace(stream, F.lit(f" {h} "), F.lit("")))) / (len(h) + 2) for h in HEDGES), F.lit(0.0)).cast("int")


def opens_clean(text: Column) -> Column:
    """Whether the first word does not point back."""
    low = F.translate(F.lower(text), "’", "'")
    first = F.regexp_extract(low, r"^[\p{L}\p{N}'-]+", 0)
    return ~first.isin(*ANAPHORA) & ~low.rlike("^(?:" + "|".join(CONNECTORS) + ") ")


def self_sufficient(text: Column) -> Column:
    return text.rlike(r"^[\p{Lu}\p{N}]") & opens_clean(text)


def has_fact_anchor(text: Column) -> Column:
    """A digit, or a capitalised word that does not begin a sentence."""
    return text.rlike("[0-9]") | text.rlike(r"[^.!?:\s]\s+\p{Lu}")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+"))


def is_answer_unit(text: Column) -> Column:
    return word_count(text).between(8, 40) & has_fact_anchor(text) & self_sufficient(text) & (hedge_count(text) == 0)


def is_question(text: Column) -> Column:
    return F.trim(text).endswith("?") | F.trim(text).rlike(rf"(?iu)^(?:{QUESTION_OPENERS})(?:[^\p{{L}}\p{{N}}]|$)")


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def syllables(word: Column) -> Column:
    """Groups of vowels, a silent final e not counted, at least one."""
    low = F.lower(word)
    groups = F.regexp_count(low, F.lit("[aeiouy]+"))
    return F.greatest(groups - F.when(low.rlike("[^aeiouy]e$") & (groups > 1), 1).otherwise(0), F.lit(1))


def reading_grade(text: Column) -> Column:
    """Flesch-Kincaid grade; null without a word."""
    w = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    sentences = F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))
    total = F.aggregate(w, F.lit(0), lambda n, x: n + syllables(x))
    return F.when(F.size(w) > 0, 0.39 * F.size(w) / sentences + 11.8 * total / F.size(w) - 15.59)


def is_generic_anchor(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return (low == "") | low.isin(*GENERIC_ANCHORS) | low.rlike(r"^(https?://|www\.)")


def is_bcp47(code: Column) -> Column:
    return F.lower(F.trim(code)).rlike(r"^[a-z]{2,3}(-[a-z0-9]{2,8})*$")


def title_segments(title: Column) -> Column:
    return F.split(title, r" [|\-–—·] ")


def normalize_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(fold_diacritics(text)), "'‘’ʼ`", ""), "[^a-z0-9]+", " "))


def is_error_label(text: Column) -> Column:
    label = normalize_label(text)
    return (label != "") & (label.isin(*ERROR_LABELS) | label.rlike("|".join(ERROR_PHRASES)) | label.rlike(ERROR_CODES))


def is_iso_duration(text: Column) -> Column:
    return text.rlike(r"(?i)^P(?=\d|T)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(\d+(\.\d+)?H)?(\d+(\.\d+)?M)?(\d+(\.\d+)?S)?)?$")


def normalize_phone(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[^0-9+]", "")
    return F.regexp_replace(digits, "^00", "+")


def markdown_links(text: Column) -> Column:
    """(text, url) pairs."""
    rx = r"\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(rx), F.lit(1)).alias("text"), F.regexp_extract_all(text, F.lit(rx), F.lit(2)).alias("url"))


def directive_tokens(value: Column) -> Column:
    """Tokens of a robots header or meta; blanks around a colon do not split."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s*:\s*", ":")), r"[,\s]+"), lambda x: x != "")


def parse_date(text: Column) -> Column:
    """ISO 8601 or RFC 1123 as a UTC timestamp, else null."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(t))
    return F.coalesce(iso, F.try_to_timestamp(F.regexp_extract(t, r"^(?:[A-Za-z]{3}, )?(\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [A-Z]{3})$", 1), F.lit("dd MMM yyyy HH:mm:ss z")))
