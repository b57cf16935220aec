"""Text expressions: every one is a Column made of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(c: Column) -> Column:
    """Lower case, only ASCII letters, digits and hyphens; `section` if nothing is left."""
    s = F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("section"))


def token_count(c: Column) -> Column:
    """Number of words between Unicode white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")), F.lit(0))


def sentences(c: Column) -> Column:
    """Parts after a full stop, exclamation or question mark with white space behind it."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda x: x != "")


def clean_text(c: Column) -> Column:
    """Without tags and arrow marks, runs of spaces and of blank lines made one; trimmed."""
    s = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s*[›»>]\s*", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


# fixed values: phrases of navigation, and the forms of the addresses of search pages
NAVIGATION = "load more results|click here|read more|skip to|cookie|subscribe"
SEARCH_PAGE = r"/search\b|[?&]q=|[?&]query=|[?&]search=|/results\b"


def is_clean(text: Column, url: Column) -> Column:
    """Whether a chunk reads as prose: no search page, 100 characters or more, at most 10 tags and 5 links, two sentence
    ends or more, and at most a fifth of it navigation."""
    bare = F.length(F.trim(text))
    phrases = F.regexp_extract_all(F.lower(text), F.lit(f"({NAVIGATION})"), F.lit(1))
    share = F.aggregate(phrases, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(bare, F.lit(1))
    count = lambda what: F.regexp_count(text, F.lit(what))
    return ~F.lower(F.coalesce(url, F.lit(""))).rlike(SEARCH_PAGE) & (bare >= 100) & (count("<") <= 10) & (count("http") <= 5) & (count("[.?!]") >= 2) & (share <= 0.2)


def json_part(c: Column) -> Column:
    """The part of a text from its first opening bracket to the last closing one of the same kind; null if there is none."""
    start = F.regexp_extract(c, r"^[^{\[]*([{\[])", 1)
    part = F.when(start == "{", F.regexp_extract(c, r"(?s)(\{.*\})", 1)).when(start == "[", F.regexp_extract(c, r"(?s)(\[.*\])", 1))
    return F.nullif(part, F.lit(""))


def json_objects(c: Column) -> Column:
    """The objects of a text, however broken the whole is: every stretch between braces without further braces that is
    valid JSON by itself, as strings."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"(\{[^{}]*\})"), F.lit(1)), lambda x: F.try_parse_json(x).isNotNull())


def plain_name(c: Column) -> Column:
    return F.trim(F.replace(F.lower(c), F.lit("_"), F.lit(" ")))


def without_thoughts(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def stable_id(key: Column, kind: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of key::type."""
    return F.substring(F.sha2(F.concat(key, F.lit("::"), kind), 256), 1, 16)


def cache_key(rewritten: Column, original: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.coalesce(F.nullif(rewritten, F.lit("")), original))), 256)


# fixed values: names that name nothing, by class
PRONOUNS = "i me my we us our you your he him his she her they them their it its this that these those who whom which what where when how why".split()
ARTICLES = "a an the some any all each every no none".split()
GENERIC_TERMS = [
    "musical works", "musical work", "music", "song", "songs", "track", "tracks", "album", "albums", "record", "records", "recording", "recordings",
    "writer", "writers", "artist", "artists", "performer", "performers", "member", "members", "publisher", "publishers", "speaker", "speakers",
    "tour", "tours", "concert", "concerts", "festival", "festivals", "dance", "performance", "event", "events", "session", "sessions",
    "workshop", "workshops", "panel", "panels", "presentation", "presentations", "literary works", "literary work", "works", "work",
]


def noise_class(name: Column) -> Column:
    """Why a name is no entity: the first reason that holds, else null."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    clock = r"[0-9]{1,2}:[0-9]{2}\s*(?:am|pm)?"
    return (
        F.when(n == "", "empty")
        .when(F.length(n) == 1, "single_char")
        .when(n.isin(PRONOUNS), "pronoun")
        .when(n.isin(ARTICLES), "article")
        .when(n.isin(GENERIC_TERMS), "generic_term")
        .when(n.rlike(rf"^{clock}(?:\s*-\s*{clock})?$"), "time_fragment")
        .when(n.rlike(r"^[0-9]+(?:\.[0-9]+)?%?$"), "pure_number")
        .when(n.rlike(r"^[0-9]+(?:st|nd|rd|th)$"), "ordinal")
    )
