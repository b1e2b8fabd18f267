"""Text clean-up of scraped vehicle listings, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fragments that scraping leaves in names, deleted in this order in any case.
JUNK = (
    r"sahibinden\.com'da", r"sahibinden\.com", r"\.com'da", "& Modelleri", "& Modleri", "Modelleri", "Modleri", r"2\.El Arabalar", r"2\.El", "Satılık Sıfır Km",
    "Satılık", "Sıfır Km", "Otomobil", "fiyatları", "fiyatlari", "arama sonucu", "sayfa numarası", "ikinci el", "FarkliVaryant", "Genel Model",
)
# Turkish letters and their plain forms.
TURKISH, PLAIN = "İıÖöÜüŞşÇçĞğ", "IiOoUuSsCcGg"
PLACEHOLDERS = ("Standart", "FarkliVaryant")
# Words that mark a listing as damaged.
DAMAGE_WORDS = ("ağır hasar", "pert")
# The words that a search over listing rows takes as damage, and those of a stricter one.
DAMAGE_RECORD_WORDS = ("pert", "hasar kayit", "hasar kayıt", "agir hasar", "ağır hasar", "hasarli", "hasarlı")
DAMAGE_PAINT_WORDS = ("tavan boyali", "tavan boyalı", "komple boyali", "komple boyalı")
#: Levels of what counts as damage, each with the words of the one before.
DAMAGE_LEVELS = {"heavy": DAMAGE_WORDS, "record": DAMAGE_RECORD_WORDS, "paint": DAMAGE_RECORD_WORDS + DAMAGE_PAINT_WORDS}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, "^[\\s\\u00A0]+|[\\s\\u00A0]+$", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read: a one-element array binds it.

    Spark does not look for common parts within lambdas and the branches of rules.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cleaned(text: Column) -> Column:
    """A name without page suffix and junk, separators as single spaces; '' for null.

    One search for any fragment comes first; only texts that hold one go through
    the deletions.  They stand in a lambda, which Spark does not compile: a chain
    of so many patterns costs more to compile than most tables take to clean.
    """
    return bound(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*-\s*[0-9]+$", ""), _cleaned)


def _cleaned(name: Column) -> Column:
    out = name
    for fragment in JUNK:
        out = F.regexp_replace(out, "(?i)" + fragment, "")
    # Most places of a text hold no first letter of a fragment, and are told apart by one look.
    firsts = "".join(sorted({fragment.lstrip("\\")[0] for fragment in JUNK}))
    out = F.when(name.rlike(f"(?i)(?=[{firsts}])(?:{'|'.join(JUNK)})"), out).otherwise(name)
    return F.trim(F.regexp_replace(F.translate(out, "-_", "  "), r"\s+", " "))


def folded(text: Column) -> Column:
    return F.translate(text, TURKISH, PLAIN)


def folded_upper(text: Column) -> Column:
    return folded(F.upper(text))


def numeric_only(text: Column) -> Column:
    return F.trim(text).rlike("^[0-9]+$")


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def contains_any(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def damaged(text: Column, strict: bool = False) -> Column:
    """Whether a listing's text names damage; ``strict`` asks for whole words after folding."""
    if strict:
        return F.lower(folded(text)).rlike(r"\b(agir hasar\w*|pert)\b")
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), DAMAGE_WORDS)


def damage_level(text: Column) -> Column:
    """The first of the levels that a text's words reach; null for none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(contains_any(low, words), name) for name, words in DAMAGE_LEVELS.items()))


def known_variant(text: Column) -> Column:
    """Null where a variant is blank or a placeholder."""
    return F.when(~blank(text) & ~F.trim(text).isin(*PLACEHOLDERS), text)


def without_prefix(text: Column, prefix: Column) -> Column:
    """A model name without the make's name before it."""
    starts = F.lower(text).startswith(F.concat(F.lower(prefix), F.lit(" ")))
    return F.when(starts, F.trim(F.substr(text, F.length(prefix) + 2))).otherwise(text)


def city(location: Column, default: str = "İstanbul") -> Column:
    """Part before the slash, or the whole text without one."""
    parts = F.split(location, "/")
    return F.when(location.contains("/"), F.coalesce(F.nullif(trimmed(parts[0]), F.lit("")), F.lit(default))).otherwise(location)


def district(location: Column) -> Column:
    return F.when(location.contains("/"), trimmed(F.get(F.split(location, "/"), F.lit(1)))).otherwise("")


def thousands(x: Column) -> Column:
    """Whole number with dots between thousands."""
    return F.translate(F.format_number(x, 0), ",", ".")


def title_case(text: Column) -> Column:
    """First letters upper, the rest lower, with the Turkish dotted and dotless i."""
    upper = lambda s: F.upper(F.translate(s, "iı", "İI"))
    lower = lambda s: F.lower(F.translate(s, "İI", "iı"))
    words = F.transform(F.split(text, " "), lambda w: F.concat(upper(F.substring(w, 1, 1)), lower(F.substr(w, F.lit(2)))))
    return F.array_join(words, " ")


def phone(text: Column) -> Column:
    """Digits with the country code 90 in front."""
    n = F.regexp_replace(text, "[^0-9]", "")
    return F.when(n.startswith("90"), n).when(n.startswith("0"), F.concat(F.lit("9"), n)).when(F.length(n) == 10, F.concat(F.lit("90"), n)).otherwise(n)


def search_url(base: str, *terms: Column) -> Column:
    """Address of a search for all given terms."""
    return F.concat(F.lit(base), F.url_encode(F.concat_ws(" ", *terms)))


def short_id(key: Column, n: int = 8) -> Column:
    """The first characters of an id, as messages show it."""
    return F.substring(key, 1, n)
