"""Text functions as Column expressions, all inside whole-stage code. Letters in brackets are the inventory's numbers."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as browsers count it.
WS = "[\\t\\n\\x0B\\f\\r    -     　﻿]"
# Words that titles are compared without.
TITLE_STOP = (
    "the", "a", "an", "of", "for", "to", "in", "on", "and", "as", "at", "by", "with", "from", "new", "say", "says", "amid", "its", "their", "his", "her", "our", "they",
    "them", "this", "that", "these", "those", "is", "are", "was", "were", "be", "been", "has", "have", "had", "will", "would", "can", "could", "after", "over", "into",
    "about", "more", "most",
)
# Words of legal forms and branches in facility names.
COMPANY_WORDS = (
    "llc", "lc", "fzllc", "fzco", "fzc", "fze", "fz", "dmcc", "dwc", "dwtc", "jlt", "pjsc", "psc", "jsc", "wll", "ltd", "limited", "inc", "incorporated", "plc", "est",
    "establishment", "co", "company", "corp", "corporation", "holding", "holdings", "group", "enterprises", "enterprise", "trading", "general", "investment",
    "investments", "sole", "proprietorship", "partnership", "br", "brof", "branch", "branches", "llp", "lp", "pvt", "private", "owned", "person", "single", "ope",
)
# Spellings unified in facility names.
FACILITY_SPELLINGS = {"center": "centre", "centers": "centre", "centres": "centre", "cntr": "centre", "clinics": "clinic", "pharmacies": "pharmacy", "laboratories": "laboratory", "labs": "lab", "hospitals": "hospital"}
# British spellings and the American ones they are compared as.
AMERICAN = [("paediatric", "pediatric"), ("anaesthes", "anesthes"), ("haemat", "hemat"), ("haemorrh", "hemorrh"), ("orthopaedic", "orthopedic"), ("gynaecolog", "gynecolog"), ("oesophag", "esophag"), ("foetal", "fetal"), ("leukaemia", "leukemia"), ("paediatr", "pediatr")]


def _decompositions() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters whose compatibility form without marks is one ASCII character, those characters, and the longer cases that occur."""
    one, to, many = [], [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and len(plain) == 1 and plain.isascii():
            one.append(c)
            to.append(plain)
        elif plain != c and plain.replace("⁄", " ").isascii() and 1 < len(plain) <= 4 and c in "ﬀﬁﬂﬃﬄ¼½¾":
            many.append((c, plain.replace("⁄", " ")))
    return "".join(one), "".join(to), many


_FROM, _TO, _MANY = _decompositions()
_MARKS = "[̀-ͯ]"


def _with(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def blank_to_null(c: Column) -> Column:
    """[P3] Trimmed text; NULL if nothing is left."""
    return F.nullif(squeezed(c), F.lit(""))


def unaccented(c: Column) -> Column:
    """Lower case, compatibility forms decomposed, marks removed."""
    c = F.regexp_replace(F.translate(F.lower(c), _FROM, _TO), _MARKS, "")
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), _MANY, c)


def fold(c: Column) -> Column:
    """Form in which the directory is searched: letters and digits without accents, one blank between words."""
    return F.trim(F.regexp_replace(unaccented(c), "[^a-z0-9]+", " "))


def archive_fold(c: Column) -> Column:
    """Form in which the archive is searched: a mark is not removed but parts the word, so an accent leaves a blank behind its letter."""
    marked = F.regexp_replace(F.lower(c), "([" + "".join(x for x in _FROM if unicodedata.decomposition(x) and not unicodedata.decomposition(x).startswith("<")) + "])", "$1 ")
    return F.trim(F.regexp_replace(F.translate(marked, _FROM, _TO), "[^a-z0-9]+", " "))


def facility_key(c: Column) -> Column:
    """Letters and digits of plain ASCII only, one blank between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def facility_words(c: Column) -> Column:
    """Words of a facility name: initials glued, spellings unified, legal forms dropped unless nothing else is there; a blank at either end."""
    glued = F.regexp_replace(fold(c), r"(?<=\b[a-z]) (?=[a-z]\b)", "")
    unify = F.create_map(*[F.lit(x) for kv in FACILITY_SPELLINGS.items() for x in kv])
    words = F.transform(F.split(glued, " "), lambda w: F.coalesce(F.try_element_at(unify, w), w))
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*COMPANY_WORDS))
    return F.concat(F.lit(" "), F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(glued), F.lit(" "))


def normalized_title(c: Column) -> Column:
    """Title as compared: marks part words, filler words go."""
    base = F.regexp_replace(archive_fold(F.coalesce(c, F.lit(""))), r"\b(" + "|".join(TITLE_STOP) + r")\b", " ")
    return F.trim(F.regexp_replace(base, " +", " "))


def entity_norm(c: Column) -> Column:
    """[F8] Text in which phrases are looked for: American spellings, ASCII words, a blank at either end."""
    c = F.lower(F.coalesce(c, F.lit("")))
    for british, american in AMERICAN:
        c = F.regexp_replace(c, r"(?<![A-Za-z0-9_])" + british, american)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(c, "[^a-z0-9]+", " ")), F.lit(" "))


def story_key(title: Column) -> Column:
    """Hash of the five longest distinct words of a title (ties by the alphabet) in alphabetical order; NULL if no word has four letters."""
    words = F.array_distinct(F.filter(F.split(normalized_title(title), " "), lambda w: F.length(w) > 3))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    key = F.array_join(F.array_sort(F.transform(F.slice(ranked, 1, 5), lambda x: x["w"])), " ")
    return F.when(F.size(words) > 0, F.substring(F.sha2(key, 256), 1, 16))


def source_hash(source: Column, guid: Column, url: Column) -> Column:
    """Identity of a feed item within its source."""
    return F.sha2(F.concat(source, F.lit("\u0001"), F.coalesce(guid, url)), 256)


def content_hash(title: Column, excerpt: Column) -> Column:
    """Identity of what an item says."""
    return F.sha2(F.concat(normalized_title(title), F.lit("\u0001"), F.substring(F.coalesce(excerpt, F.lit("")), 1, 400)), 256)


def slug(c: Column, limit: int = 80) -> Column:
    """Address form of a name."""
    dashed = F.regexp_replace(F.regexp_replace(unaccented(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, limit), "-+$", "")


def decoded(c: Column) -> Column:
    """HTML entities as characters, the ampersand last."""
    def step(base: int):
        def replace(text: Column, found: Column) -> Column:
            code = F.conv(F.regexp_extract(found, r"([0-9A-Fa-f]+);", 1), base, 10).cast("int")
            return F.replace(text, found, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

        return replace

    c = F.regexp_replace(F.regexp_replace(c, r"<!\[CDATA\[", ""), r"\]\]>", "")
    for base, pattern in ((10, r"&#[0-9]{1,6};"), (16, r"&#[xX][0-9A-Fa-f]{1,5};")):
        c = F.aggregate(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))), c, step(base))
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(to))
    return c


def stripped(c: Column) -> Column:
    """Plain text of markup."""
    return squeezed(F.regexp_replace(decoded(c), "<[^>]*>", " "))


#: Elements that go with all they hold, and tags that stay.
DANGEROUS = ("script", "style", "iframe", "object", "embed", "form", "input", "noscript", "svg", "link")
ALLOWED_TAGS = ("p", "br", "ul", "ol", "li", "a", "strong", "em", "b", "i", "u", "h2", "h3", "h4", "blockquote", "img", "figure", "figcaption")


def sanitised(c: Column, base: Column | None = None) -> Column:
    """[F16] Markup of which only harmless elements stay: links with their http(s) address, pictures with that and their text, both resolved against the base.

    A link without such an address loses its opening tag, a picture goes. Every tag is looked at once and written anew.
    """
    base = F.lit(None).cast("string") if base is None else base
    for name in DANGEROUS:
        c = F.regexp_replace(F.regexp_replace(c, rf"(?is)<{name}\b.*?</{name}\s*>", ""), rf"(?is)<{name}\b[^>]*>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?i)<(?!/?(?:" + "|".join(ALLOWED_TAGS) + r")\b)[^>]*>", "")
    # A text is its pieces before each "<" and the tags behind them.
    pieces = F.split(c, "<")
    def attribute(tag: Column, name: str) -> Column:
        return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)
    def with_address(tag: Column, name: str, f) -> Column:
        """f of the tag's usable address, nothing without one."""
        quoted = lambda x: F.replace(x, F.lit('"'), F.lit("&quot;"))
        here = lambda x: F.when(x == "", None).otherwise(absolute(x, base))
        return _with(attribute(tag, name), lambda raw: F.coalesce(_with(F.when(raw.contains("&"), decoded(raw)).otherwise(raw), lambda x: f(quoted(here(x)))), F.lit("")))
    def alt(tag: Column) -> Column:
        return _with(attribute(tag, "alt"), lambda x: F.when(x != "", F.concat(F.lit(' alt="'), x, F.lit('"'))).otherwise(""))
    def anew(piece: Column) -> Column:
        tag, rest = F.regexp_extract(piece, r"^([^>]*)>", 1), F.regexp_replace(piece, r"^[^>]*>", "")
        name = F.lower(F.regexp_extract(piece, r"^(/?[A-Za-z][A-Za-z0-9]*)", 1))
        link = with_address(tag, "href", lambda x: F.concat(F.lit('<a href="'), x, F.lit('">')))
        picture = with_address(tag, "src", lambda x: F.concat(F.lit('<img src="'), x, F.lit('"'), alt(tag), F.lit(">")))
        return F.concat(_with(name, lambda n: F.when(n == "a", link).when(n == "img", picture).when(n == "", "").otherwise(F.concat(F.lit("<"), n, F.lit(">")))), rest)
    c = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), anew), ""))
    return squeezed(F.regexp_replace(c, r"(?i)<(p|li|h2|h3|h4|em|strong|b|i|u)>\s*</\1>", ""))


def reading_minutes(text: Column) -> Column:
    """Minutes at 225 words each, at least one; NULL below 40 words."""
    words = F.size(F.filter(F.split(stripped(F.coalesce(text, F.lit(""))), " "), lambda w: w != ""))
    return F.when(words >= 40, F.greatest(F.lit(1), F.floor(words / 225 + 0.5).cast("int")))


def absolute(url: Column, base: Column) -> Column:
    """An http(s) address, resolved against the base, with its dot segments; NULL for any other scheme."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    scheme = F.regexp_extract(base, r"^(https?):", 1)
    plain = F.trim(url)
    whole = (
        F.when(plain.rlike("(?i)^https?://"), plain)
        .when(plain.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (root == "") | base.isNull(), None)
        .when(plain.startswith("//"), F.concat(scheme, F.lit(":"), plain))
        .when(plain.startswith("/"), F.concat(root, plain))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), plain))
    )
    return _with(whole, lambda w: F.when(w.rlike(r"/\.\.?(?:[/?#]|$)"), _without_dots(w)).otherwise(w))


def _without_dots(c: Column) -> Column:
    """An address whose path has its "." and ".." segments carried out."""
    host = F.regexp_extract(c, r"^([A-Za-z]+://[^/?#]*)", 1)
    path = F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(c, r"^[^?#]*(.*)$", 1)
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    ends = F.element_at(segments, -1).isin(".", "..")
    def step(done: Column, x: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x == "..", shorter).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    left = F.aggregate(segments, F.array().cast("array<string>"), step)
    left = F.when(ends, F.concat(left, F.array(F.lit("")))).otherwise(left)
    return F.concat(host, F.lit("/"), F.array_join(left, "/"), tail)


def html_escaped(c: Column) -> Column:
    """Text for use in markup."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def shortened(c: Column, limit: int) -> Column:
    """[F32] Text cut at so many characters, with an ellipsis if any are lost."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit)), F.lit("…"))).otherwise(c)


def parsed_date(c: Column) -> Column:
    """Time of an RFC 822 or ISO date; NULL if it is neither."""
    c = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},\s*", "")
    c = F.regexp_replace(c, r"\s(?:GMT|UTC|Z)$", " +0000")
    formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats], F.try_to_timestamp(c))


def shard(c: Column) -> Column:
    """Last three characters of an id, filled with zeros."""
    return F.lpad(F.when(F.length(c) > 3, F.substring(c, -3, 3)).otherwise(c), 3, "0")


def short_hours(h: Column) -> Column:
    """An hour of the day on a twelve-hour clock."""
    h = h.cast("int")
    return F.when(h.isin(0, 24), "12 AM").when(h == 12, "12 PM").when(h > 12, F.concat((h - 12).cast("string"), F.lit(" PM"))).otherwise(F.concat(h.cast("string"), F.lit(" AM")))


def initials(c: Column) -> Column:
    """First letters of the first and last word."""
    w = F.filter(F.split(squeezed(c), " "), lambda x: x != "")
    first, last = F.upper(F.substring(F.get(w, F.lit(0)), 1, 1)), F.upper(F.substring(F.element_at(w, -1), 1, 1))
    return F.when(F.size(w) == 0, "").when(F.size(w) == 1, first).otherwise(F.concat(first, last))
