"""Text expressions used by the operators: Column in, Column out."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\n\x0B\f\r]+"

#: A short default list; pass your own, or a table, for other corpora.
STOPWORDS = (
    "a an and are as at be been but by can did do for from had has have he her his how i if in into is it its me my "
    "no not of on or our out she so some than that the their them then there they this to up us was we were what when "
    "which who will with would you your"
).split()


def tokenize_ws(text: Column) -> Column:
    """Words between ASCII white space, empty ones dropped."""
    return F.filter(F.split(text, SPACES), lambda x: x != "")


def tokenize_alpha(text: Column) -> Column:
    """Lower-case runs of a-z."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")


def tokenize_name(name: Column) -> Column:
    """Parts of a name at blank, hyphen, underscore and slash."""
    return F.filter(F.split(F.lower(name), r"[\s\-_/]+"), lambda x: x != "")


def lower_if_plain(word: Column, cleaned: Column) -> Column:
    """``cleaned``, which is only worked out for words that aren't letters and digits alone: most words are."""
    return F.when(word.rlike(r"\A[A-Za-z0-9]+\z"), F.lower(word)).otherwise(cleaned)


def clean_token(word: Column) -> Column:
    """Lower case, only a-z, 0-9, ' and -; a final 's and outer ' and - go."""
    kept = F.regexp_replace(F.lower(word), "[^a-z0-9'-]", "")
    bare = F.regexp_replace(kept, "'s$", "")
    return lower_if_plain(word, F.regexp_replace(F.regexp_replace(bare, "^['-]+", ""), "['-]+$", ""))


def is_stopword(word: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    return word.isin(*stopwords) | (F.length(word) <= 1)


# fixed values: British endings and their American forms, first match wins
SPELLING = [
    ("ise", "ize"), ("ised", "ized"), ("ising", "izing"), ("isation", "ization"), ("our", "or"), ("ours", "ors"),
    ("ogue", "og"), ("yse", "yze"), ("ysed", "yzed"), ("ysing", "yzing"), ("ence", "ense"), ("lled", "led"), ("lling", "ling"),
]


def american_spelling(word: Column, rules: list[tuple[str, str]] = SPELLING) -> Column:
    out = word
    for end, new in reversed(rules):
        out = F.when(word.endswith(end), F.concat(F.substr(word, F.lit(1), F.length(word) - len(end)), F.lit(new))).otherwise(out)
    return out


def expand_abbreviation(word: Column, table: dict[str, str]) -> Column:
    """The expansion of a word in ``table`` (lower-case keys), whatever its case; null for others."""
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(names, F.lower(F.trim(word)))


def confidence_label(score: Column, first: Column) -> Column:
    """high from 15, medium from 8, else low; without a score the first of a chain is high, others extrapolated."""
    return F.when(score >= 15, "high").when(score >= 8, "medium").when(score.isNotNull(), "low").when(first, "high").otherwise("extrapolated")


def is_proper(word: Column) -> Column:
    """The first character is a capital letter."""
    first = F.substring(word, 1, 1)
    return F.coalesce((F.upper(first) == first) & (F.lower(first) != first), F.lit(False))


def normalize_title(title: Column) -> Column:
    """Lower case without punctuation, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", ""), r"\s+", " "))


def normalize_concept(name: Column) -> Column:
    """Lower case, parentheses dropped, cut at a slash, trimmed."""
    plain = F.trim(F.regexp_replace(F.lower(name), r"\([^)]*\)", ""))
    return F.trim(F.regexp_replace(F.substring_index(plain, "/", 1), r"\s+", " "))


ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def slugify(text: Column, most: int = 512) -> Column:
    """Accents removed, lower case, other characters as single hyphens, none at the ends."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


@cache
def decomposed_letters() -> tuple[str, str]:
    """(letters, ASCII letters): all characters whose canonical decomposition is an ASCII letter or digit with combining
    marks of U+0300 to U+036F, and what is left of them without the marks; made from the Unicode tables of the runtime."""
    import sys
    import unicodedata

    pairs = []
    for code in range(0x80, sys.maxunicode + 1):
        whole = unicodedata.normalize("NFD", chr(code))
        bare = "".join(c for c in whole if not "\u0300" <= c <= "\u036f")
        if whole != chr(code) and len(bare) == 1 and bare.isascii():
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def slug_to_rkey(text: Column, most: int = 512) -> Column:
    """Record keys: decomposed, marks dropped, lower case, other characters as single hyphens, one hyphen less at
    either end, then cut at ``most``. Letters that decompose to none of a-z become hyphens like all others."""
    letters, bare = decomposed_letters()
    plain = F.lower(F.translate(F.regexp_replace(text, "[\u0300-\u036f]", ""), letters, bare))
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9-]", "-"), "-+", "-"), "^-|-$", ""), 1, most)


#: Words too common in titles to tell talks apart.
TITLE_STOPWORDS = ("with", "from", "that", "this", "your", "what", "when", "where", "have", "will", "about", "into", "over", "talk")


def title_keywords(title: Column, least: int = 4, stopwords: Iterable[str] = TITLE_STOPWORDS) -> Column:
    words = F.split(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stopwords))


def format_time(seconds: Column) -> Column:
    """h:mm:ss from an hour on, else m:ss."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    long = F.concat(h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(":"), F.lpad(r.cast("string"), 2, "0"))
    short = F.concat(m.cast("string"), F.lit(":"), F.lpad(r.cast("string"), 2, "0"))
    return F.when(s >= 3600, long).otherwise(short)


def extract_handles(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"@([A-Za-z0-9_.-]+)"), 1)


def is_emoji_reaction(text: Column) -> Column:
    """At most two UTF-16 units after trimming, and no ASCII letter."""
    t = F.trim(text)
    return (F.octet_length(F.encode(t, "UTF-16BE")) / 2 <= 2) & ~t.rlike("[A-Za-z]")


def at_uri_rkey(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def at_uri_did(uri: Column) -> Column:
    return F.split_part(uri, F.lit("/"), F.lit(3))


def page_title(html: Column) -> Column:
    """``og:title`` in either attribute order, else ``<title>``; null if there is none."""
    ways = [
        r"""<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']+)["']""",
        r"""<meta[^>]*content=["']([^"']+)["'][^>]*property=["']og:title["']""",
        r"<title[^>]*>([^<]+)</title>",
    ]
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(html, f"(?i){w}", 1)), F.lit("")) for w in ways])


def extract_links(facets: Column) -> Column:
    """Addresses in the features of facets (array of (features array of (uri)))."""
    return F.filter(F.flatten(F.transform(facets, lambda f: F.transform(f["features"], lambda x: x["uri"]))), lambda u: u.isNotNull())


def _on_any(url: Column, domains: Iterable[str]) -> Column:
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    out = F.lit(False)
    for d in domains:
        out = out | host.endswith(d)
    return out


#: Words that tell a post about a longer text.
BLOG_WORDS = ("wrote", "recap", "writeup", "blog", "reflection")


def classify_post(text: Column, links: Column, video_domains: Iterable[str], search_domain: Column | None = None) -> Column:
    """video: found under or linking to a video domain; blog: a blog word and a link elsewhere; else post."""
    domains = tuple(video_domains)
    video = F.exists(links, lambda u: _on_any(u, domains))
    if search_domain is not None:
        video = video | F.coalesce(search_domain.isin(*domains), F.lit(False))
    low, blog = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for w in BLOG_WORDS:
        blog = blog | low.contains(w)
    return F.when(video, "video").when(blog & F.exists(links, lambda u: ~_on_any(u, domains)), "blog").otherwise("post")


def primary_url(kind: Column, links: Column, video_domains: Iterable[str], home: str) -> Column:
    """A video's first video link, a blog's first link that is neither video nor ``home``; else the first link."""
    domains = tuple(video_domains)
    first = lambda a: F.try_element_at(a, F.lit(1))
    video, blog = F.filter(links, lambda u: _on_any(u, domains)), F.filter(links, lambda u: ~_on_any(u, [*domains, home]))
    return F.when(kind == "video", F.coalesce(first(video), first(links))).when(kind == "blog", F.coalesce(first(blog), first(links))).otherwise(first(links))


# fixed values: starts that change, and the sound of each letter in its surroundings; "^" marks no sound
PHONETIC_STARTS = [("^(?:kn|gn|pn|wr|ae)", 1, ""), ("^wh", 2, "w"), ("^x", 1, "s")]
PHONETIC_SOUNDS = [
    ("[aeiou]", "^"), ("(?<=m)b$", "^"), ("b", "B"), ("ch", "X"), ("c(?=[eiy]|$)", "S"), ("c", "K"), ("dg(?=[eiy]|$)", "J"), ("d", "T"),
    ("f", "F"), ("g(?=[eiy]|$)", "J"), ("gh(?=[^aeiou])", "^"), ("g", "K"), ("(?<=[aeiou])h", "^"), ("h", "H"), ("j", "J"),
    ("(?<=c)k", "^"), ("(?<=ch)k", "^"), ("k", "K"), ("l", "L"), ("m", "M"), ("n", "N"), ("p(?=h)", "F"), ("p", "P"), ("q", "K"), ("r", "R"),
    ("sh", "X"), ("si(?=[ao]|$)", "X"), ("s", "S"), ("th", "0"), ("ti(?=[ao]|$)", "X"), ("t", "T"), ("v", "F"), ("w(?=[aeiou])", "W"), ("w", "^"),
    ("x", "KS"), ("y(?=[aeiou])", "Y"), ("y", "^"), ("z", "S"),
]


def phonetic_code(words):
    """Sound codes of at most six characters for a pandas Series; use on distinct words.

    One expression with an alternative per rule reads a word after its first
    letter; a sound equal to the last one written is left out.
    """
    import re

    rules = re.compile("|".join(f"({p})" for p, _ in PHONETIC_SOUNDS))

    def code(word):
        letters = re.sub("[^a-z]", "", (word or "").lower())
        for pattern, drop, put in PHONETIC_STARTS:
            if re.match(pattern, letters):
                letters = put + letters[drop:]
        if not letters:
            return ""
        out = letters[0].upper()
        for m in rules.finditer(letters, 1):
            sound = PHONETIC_SOUNDS[m.lastindex - 1][1]
            if sound != "^" and sound != out[-1] and len(out) < 6:
                out += sound
        return out[:6]

    return words.map(code)
