"""Text functions: every one takes and returns Columns and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a title match.
STOP_WORDS = ["the", "a", "an", "of", "for", "and", "or", "in", "on", "to", "is", "it", "at", "by", "be", "as", "my", "me"]
# Units whose number tells members of a series apart.
SERIES_UNITS = "chapter|ch|week|assignment|essay|part|lab|quiz|module|unit|hw|homework"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Every character of white space: a set to trim by takes time in proportion to the text, a pattern for its end does not.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column | str) -> Column:
    """Without white space at either end (``trim`` strips blanks only)."""
    return F.btrim(col(x), F.lit(BLANKS))


def blank(x: Column | str) -> Column:
    """True for null and for text of white space only."""
    return ~F.coalesce(col(x), F.lit("")).rlike(r"(?U)\S")


def filled(x: Column | str) -> Column:
    """The text, or null where it is empty: a missing value in either form."""
    return F.nullif(col(x), F.lit(""))


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), 0)


def contains_any(x: Column | str, needles: list[str]) -> Column:
    return once(col(x), lambda text: F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(text, n)))


def slugify(x: Column | str) -> Column:
    slug = F.regexp_replace(strip(F.lower(col(x))), r"(?U)[^\p{L}\p{N}_\s-]", "")
    slug = F.regexp_replace(F.regexp_replace(slug, r"(?U)[\s_]+", "-"), "-{2,}", "-")
    return F.coalesce(filled(F.regexp_replace(slug, "^-+|-+$", "")), F.lit("untitled"))


def item_id(course: Column | str, title: Column | str, index: Column | str) -> Column:
    return F.concat_ws("__", col(course), slugify(title), col(index).cast("string"))


def course_of_id(x: Column | str) -> Column:
    return F.split(col(x), "__", 3)[0]


def short_label(x: Column | str, limit: int | None = None) -> Column:
    """A course name without its term prefix and code suffix."""
    name = strip(F.regexp_replace(F.regexp_replace(col(x), r"^Spring \d{4}\s+", ""), r"\s*\([^)]*\)\s*$", ""))
    return name if limit is None else F.left(name, F.lit(limit))


def normalize_chapter(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(x), r"\bchapter\s*(\d+)\b", "ch$1"), r"\bch\s+(\d+)\b", "ch$1")


def title_tokens(x: Column | str) -> Column:
    """Set of the lower-case tokens of a title, stop words left out."""
    return F.array_except(F.regexp_extract_all(col(x), F.lit("([a-z0-9]+)"), 1), F.array(*[F.lit(w) for w in STOP_WORDS]))


def titles_match(question: Column | str, title: Column | str) -> Column:
    """Either contains the other, or half of the title's tokens (two at least) are in the question."""
    q, t = normalize_chapter(F.lower(col(question))), normalize_chapter(F.lower(col(title)))
    q_tokens, t_tokens = title_tokens(q), title_tokens(t)
    overlap = F.size(F.array_intersect(q_tokens, t_tokens))
    enough = overlap >= F.greatest(F.lit(2), F.floor(F.size(t_tokens) / 2))
    return F.contains(q, t) | F.contains(t, q) | ((F.size(t_tokens) > 0) & (F.size(q_tokens) > 0) & enough)


def without_numbers(x: Column | str) -> Column:
    """A title for series detection: numbered units, ``#n`` and bare numbers dropped."""
    t = F.regexp_replace(F.lower(col(x)), rf"\b({SERIES_UNITS})\s*#?\s*\d+\b", "")
    t = F.regexp_replace(F.regexp_replace(t, r"#\s*\d+", ""), r"\b\d+\b", "")
    return strip(F.regexp_replace(t, r"\s+", " "))


def snippet(x: Column | str, limit: int = 500) -> Column:
    """The first ``limit`` characters, marked when something is cut."""
    return F.concat(F.left(col(x), F.lit(limit)), F.when(F.length(col(x)) > limit, "…").otherwise(""))


def auto_title(x: Column | str) -> Column:
    one_line = F.replace(F.replace(strip(x), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    return F.when(F.length(one_line) > 50, F.concat(F.left(one_line, F.lit(49)), F.lit("…"))).otherwise(one_line)


def renamed_title(x: Column | str) -> Column:
    return F.left(col(x), F.lit(50))


def absolute_url(href: Column | str, base: str, fallback: Column | str) -> Column:
    h = col(href)
    return F.when(F.startswith(h, F.lit("/")), F.concat(F.lit(base), h)).otherwise(F.coalesce(filled(h), col(fallback)))


def course_id_of_href(href: Column | str) -> Column:
    return filled(F.regexp_extract(col(href), r"/courses/([^/?#]+)", 1))


def mime_base(x: Column | str) -> Column:
    return F.lower(strip(F.split_part(col(x), F.lit(";"), F.lit(1))))


def extension(name: Column | str) -> Column:
    """Lower-case file extension with its dot; '' without one or for a leading dot only."""
    base = F.regexp_extract(col(name), r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1))


def percent(n: Column | str, total: Column | str) -> Column:
    return F.when(col(total) == 0, "0.0%").otherwise(F.concat(F.format_string("%.1f", 100.0 * col(n) / F.nullif(col(total), F.lit(0))), F.lit("%")))


def shown_time(x: Column | str) -> Column:
    return F.replace(F.left(col(x), F.lit(19)), F.lit("T"), F.lit(" "))


def shown_id(x: Column | str) -> Column:
    return F.left(col(x), F.lit(16))


def shown_money(x: Column | str) -> Column:
    return F.format_string("%.4f", col(x).cast("double"))


def shown_count(x: Column | str) -> Column:
    return F.format_number(col(x), 0)


def without_colours(x: Column | str) -> Column:
    return F.regexp_replace(col(x), "\x1b\\[[0-9;]*m", "")


def log_fields(x: Column | str) -> Column:
    """key=value pairs of a log line."""
    return F.str_to_map(col(x), F.lit(" "), F.lit("="))


def routed(reply: Column | str, known: Column | str) -> Column:
    """Course ids named in a model's JSON reply, in its order with repeats; all ids when none is usable."""
    ids = F.filter(F.from_json(strip(reply), "array<string>"), lambda x: F.array_contains(col(known), x))
    return F.when(F.size(ids) > 0, ids).otherwise(col(known))


def uuid_id(prefix: str, *key: Column | str) -> Column:
    """A reproducible id: prefix and 32 hex digits of the natural key."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\u0001", *[F.coalesce(col(k).cast("string"), F.lit("\u0002")) for k in key]), 256), F.lit(32)))
