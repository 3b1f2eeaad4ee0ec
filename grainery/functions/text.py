"""Column expressions over strings, stamps, lists and vectors (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the letters that the keyword index folds, and their base letters
FOLDED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED_TO = "aaaaaaceeeeiiiinooooouuuuyy"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """True for null and for strings of white space of any kind."""
    return ~F.coalesce(F.rlike(_c(c), F.lit(r"(?U)\S")), F.lit(False))


def strip(c: Column | str) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def filled(c: Column | str) -> Column:
    """The stripped string, or null if nothing is left."""
    return F.when(~blank(c), strip(c))


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def words(c: Column | str) -> Column:
    return F.filter(F.split(_c(c), r"(?U)\s+"), lambda w: w != "")


def strip_tags(c: Column | str) -> Column:
    return collapse(F.regexp_replace(_c(c), "<[^>]*>", ""))


def normalize_anchor(c: Column | str) -> Column:
    """Words without punctuation, in lower case, joined by one space."""
    bare = F.transform(words(c), lambda w: F.lower(F.regexp_replace(w, r"(?U)[^\w]+", "")))
    return F.array_join(F.filter(bare, lambda w: w != ""), " ")


def unit_anchor(c: Column | str, n: int = 6) -> Column:
    """The first n words of a unit after its stamp, normalized."""
    body = F.regexp_replace(_c(c), r"^\[\d{1,2}:\d{2}(?::\d{2})?\]\s*", "")
    return normalize_anchor(F.array_join(F.slice(words(body), 1, n), " "))


def anchors_match(a: Column | str, b: Column | str) -> Column:
    """One normalized anchor starts with the other, character by character; empty ones match nothing."""
    a, b = _c(a), _c(b)
    return (a != "") & (b != "") & (F.startswith(a, b) | F.startswith(b, a))


def heading_level(c: Column | str) -> Column:
    n = F.length(F.regexp_extract(strip(c), r"(?d)^(#{1,6}) +(.*)$", 1))
    return F.when(n > 0, n)


def heading_title(c: Column | str) -> Column:
    return F.when(heading_level(c).isNotNull(), F.regexp_extract(strip(c), r"(?d)^(#{1,6}) +(.*)$", 2))


def stamp_seconds(c: Column | str) -> Column:
    """Seconds of `MM:SS` or `H:MM:SS`."""
    return F.aggregate(F.split(_c(c), ":"), F.lit(0), lambda a, x: a * 60 + x.cast("int"))


def _parts(c: Column) -> tuple[Column, Column, Column]:
    whole = F.floor(c).cast("int")
    return F.floor(whole / 3600).cast("int"), F.floor(whole % 3600 / 60).cast("int"), whole % 60


def format_stamp(c: Column | str) -> Column:
    """`MM:SS`, or `HH:MM:SS` from an hour on."""
    h, m, s = _parts(_c(c))
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def format_duration(c: Column | str) -> Column:
    """`M:SS` or `H:MM:SS`; empty for zero and null."""
    h, m, s = _parts(_c(c))
    text = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))
    return F.when(F.coalesce(_c(c), F.lit(0)) != 0, text).otherwise("")


def vtt_seconds(c: Column | str) -> Column:
    """Seconds of `HH:MM:SS.mmm` or `MM:SS.mmm` (a comma counts as a point), else null."""
    parts = F.split(F.replace(_c(c), F.lit(","), F.lit(".")), ":")
    number = lambda i, t: F.get(parts, i).try_cast(t).cast("double")
    three = number(F.lit(0), "int") * 3600 + number(F.lit(1), "int") * 60 + number(F.lit(2), "double")
    two = number(F.lit(0), "int") * 60 + number(F.lit(1), "double")
    return F.when(F.size(parts) == 3, three).when(F.size(parts) == 2, two)


def slug(c: Column | str) -> Column:
    """A file's name without folder and ending, in lower case with hyphens."""
    stem = F.regexp_replace(F.regexp_replace(_c(c), "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def join_tags(c: Column | str) -> Column:
    """A list of tags as comma-joined text; blanks go, null if none is left."""
    return F.nullif(F.array_join(F.filter(F.transform(_c(c), strip), lambda t: t != ""), ","), F.lit(""))


def join_aliases(c: Column | str) -> Column:
    """Comma-joined aliases: stripped, lower case, without repeats; null if none is left."""
    each = F.transform(F.split(F.coalesce(_c(c), F.lit("")), ","), lambda a: F.lower(strip(a)))
    return F.nullif(F.array_join(F.array_distinct(F.filter(each, lambda a: a != "")), ","), F.lit(""))


def add_alias(aliases: Column | str, alias: Column | str) -> Column:
    return join_aliases(F.concat_ws(",", _c(aliases), _c(alias)))


def fold(c: Column | str) -> Column:
    """Lower case without the marks of Latin-1 letters."""
    return F.translate(F.lower(_c(c)), FOLDED, FOLDED_TO)


def tokens(c: Column | str) -> Column:
    """The keyword index's tokens: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def search_terms(query: Column | str, terms: Column | str | None = None) -> Column:
    """Terms (or the query's words if there are none) with only letters, digits and inner `-` `_`, folded to lower case, in order without repeats."""
    given = words(query) if terms is None else F.when(F.size(_c(terms)) > 0, _c(terms)).otherwise(words(query))
    kept = F.transform(given, lambda t: F.lower(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_-]", ""), "^[-_]+|[-_]+$", "")))
    return F.array_distinct(F.filter(kept, lambda t: t != ""))


_WATCH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def video_id(c: Column | str) -> Column:
    """The id in a bare id or in the address of a video; null if there is none."""
    u = strip(c)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, _WATCH, 1)), r"^www\.", ""), r"^m\.", "")
    path, query = F.regexp_extract(u, _WATCH, 2), F.regexp_extract(u, _WATCH, 3)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    asked = F.regexp_extract(query, "(?:^|&)v=([^&]+)", 1)
    found = F.when(host == "youtu.be", F.get(parts, F.lit(0))).when(
        host.isin("youtube.com", "music.youtube.com"), F.when(F.regexp_replace(path, "/+$", "") == "/watch", asked).otherwise(F.try_element_at(parts, F.lit(-1)))
    )
    shape = r"^[A-Za-z0-9_-]{11}$"
    return F.when(F.rlike(u, F.lit(shape)), u).when(F.rlike(F.coalesce(found, F.lit("")), F.lit(shape)), found)


def escape_cell(c: Column | str) -> Column:
    return F.replace(_c(c), F.lit("|"), F.lit("\\|"))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda t, x: t + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def embedding_text(c: Column | str) -> Column:
    return collapse(c)
