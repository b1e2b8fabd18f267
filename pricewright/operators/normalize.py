"""Canonical make, model and variant of scraped listings, with quarantine reasons.

Everything is a column expression over ordered rule tables, so that a table of
any size is normalised in one scan without Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewright.functions.rules import first_match, first_rule
from pricewright.functions.text import bound, cleaned, folded_upper, numeric_only

# Canonical makes, the first whose needle the folded make contains.
MAKES = (
    (("ALFA",), "Alfa Romeo"), (("AUDI",), "Audi"), (("BMW",), "BMW"), (("BYD",), "BYD"), (("CHEVROLET",), "Chevrolet"), (("CITROEN", "CITROËN"), "Citroen"),
    (("CUPRA",), "Cupra"), (("DACIA",), "Dacia"), (("DAIHATSU",), "Daihatsu"), (("DS",), "DS Automobiles"), (("FORD",), "Ford"), (("HYUNDAI",), "Hyundai"),
    (("MERCEDES",), "Mercedes-Benz"), (("OPEL",), "Opel"), (("PEUGEOT",), "Peugeot"), (("RENAULT",), "Renault"), (("SEAT",), "Seat"), (("SKODA", "ŠKODA"), "Skoda"),
    (("TOYOTA",), "Toyota"), (("VOLKSWAGEN", "VW"), "Volkswagen"),
)


def _same(needles: tuple[str, ...], *fields: str) -> dict[str, tuple[str, ...]]:
    return dict.fromkeys(fields, needles)


# Canonical models by make and by the field that is searched: "model",
# "title" and "variant" are folded and in upper case, "raw_model" and "raw_title" as cleaned.
MODELS = {
    "DS Automobiles": [(_same((f"DS {n}", f"DS{n}"), "model", "title"), f"DS {n}") for n in (3, 4, 7, 9)],
    "BYD": [(_same(n, "model", "title"), m) for n, m in ((("ATTO 3", "ATTO3"), "Atto 3"), (("SEAL",), "Seal"), (("HAN",), "Han"), (("DOLPHIN",), "Dolphin"), (("TANG",), "Tang"))],
    "Cupra": [(_same((m.upper(),), "model", "title"), m) for m in ("Formentor", "Leon", "Born", "Ateca")],
    "Daihatsu": [(_same((m.upper(),), "model", "title"), m) for m in ("Sirion", "Terios", "Cuore", "Copen", "Materia")],
    "Audi": [(_same((m,), "model", "title"), m) for m in ("A3", "A4", "A5", "A6", "Q3", "Q5", "Q7")],
    "BMW": [
        ({"model": ("3 SER",), "raw_model": ("320",), "raw_title": ("320",)}, "3 Serisi"),
        ({"model": ("5 SER",), "raw_model": ("520",), "raw_title": ("520",)}, "5 Serisi"),
        ({"model": ("1 SER",), "raw_model": ("116",)}, "1 Serisi"),
        ({"model": ("4 SER",), "raw_model": ("420",)}, "4 Serisi"),
        ({"model": ("X5",)}, "X5"),
        ({"model": ("X3",)}, "X3"),
    ],
    "Citroen": [*((_same((m,), "model", "title"), m) for m in ("C4", "C3", "C5")), ({"model": ("ELYSEE", "C ELYS")}, "C-Elysée")],
    "Dacia": [({"model": (m.upper(),)}, m) for m in ("Duster", "Sandero", "Logan", "Lodgy")],
    "Chevrolet": [({"model": (m.upper(),)}, m) for m in ("Cruze", "Aveo", "Captiva", "Spark")],
    "Alfa Romeo": [({"all": (m.upper(),)}, m) for m in ("Giulietta", "156", "159", "Giulia", "Stelvio", "Tonale", "147", "MiTo")],
    "Arora": [(_same(("S1",), "model", "title", "variant"), "S1")],
    "Peugeot": [({"raw_model": (m,)}, m) for m in ("206", "207", "208", "301", "308", "3008")],
    "Renault": [
        ({"model": ("CLIO",)}, "Clio"), ({"model": ("MEGANE", "MÉGANE")}, "Megane"), ({"model": ("SYMBOL",)}, "Symbol"), ({"model": ("FLUENCE",)}, "Fluence"),
        ({"model": ("CADJAR", "KADJAR")}, "Kadjar"),
    ],
}
#: Makes whose model must be one of the table's.
CLOSED = ("DS Automobiles", "BYD", "Cupra", "Daihatsu")
#: Makes with rules that read more than the model; closed ones are among them.
READING = tuple(make for make, rules in MODELS.items() if any({"title", "raw_title", "variant", "all"} & set(fields) for fields, _ in rules))
# What scraping leaves behind in models and variants, and the reasons of quarantine.
MODEL_DEBRIS = ("SAHIBINDEN", "MODELLERI", "MODLERI", "FARK LIVARYANT", "FARKLIVARYANT")
VARIANT_DEBRIS = ("sahibinden", "modelleri", "modleri", "farklivaryant")
EMPTY_VARIANTS = ("Standart", "FarkliVaryant", "Genel Model")
BAD_MAKE, BAD_MODEL = "GEÇERSİZ_MARKA_TESPİTİ", "GEÇERSİZ_MODEL_TESPİTİ"


def named(make: Column, model: Column) -> Column:
    """(make, model, upper_model, told): the canonical make, the model as cleaned, and (make, model, reason) unless a rule of the make reads more than the model."""
    of_make = bound(cleaned(make), lambda plain: bound(folded_upper(plain), lambda upper: first_match([upper], MAKES, plain)))
    names = bound(cleaned(model), lambda model: F.struct(of_make.alias("make"), model.alias("model"), folded_upper(model).alias("upper_model")))

    def told(n: Column) -> Column:
        known = _known(n, {"model": n["upper_model"], "raw_model": n["model"]}, reading=False)
        return F.struct(*(n[k].alias(k) for k in ("make", "model", "upper_model")), F.when(~n["make"].isin(*READING), _with_reason(n["make"], F.coalesce(known, n["model"]))).alias("told"))

    return bound(names, told)


def canonical(make: Column, model: Column, variant: Column | None = None, title: Column | None = None, name: Column | None = None) -> Column:
    """(make, model, variant, is_valid, reason): raw names stay where they are not valid.

    Nulls are empty names; an empty make or model is quarantined.  ``name`` is what
    ``named`` gives for make and model, where it was told for many rows at once.
    """
    empty = F.lit("")
    variant, title = (empty if x is None else x for x in (variant, title))
    make, model, name = F.coalesce(make, empty), F.coalesce(model, empty), named(make, model) if name is None else name
    judged = lambda n, variant: bound(F.coalesce(n["told"], _beside(n, variant, title)), lambda m: _judged(m, variant, make, model))
    return bound(name, lambda n: bound(cleaned(variant), lambda variant: judged(n, variant)))


def _beside(n: Column, variant: Column, title: Column) -> Column:
    """(make, model, reason) of a make whose rules read the variant or the title, too."""

    def found(o: Column) -> Column:
        fields = {"model": n["upper_model"], "raw_model": n["model"], "title": o["title"], "raw_title": o["raw_title"], "variant": o["variant"], "all": F.concat_ws(" ", n["upper_model"], o["title"], o["variant"])}
        known = _known(n, fields, reading=True)
        return _with_reason(n["make"], F.when(n["make"].isin(*CLOSED), known).otherwise(F.coalesce(known, n["model"])))

    return bound(bound(cleaned(title), lambda t: F.struct(t.alias("raw_title"), folded_upper(t).alias("title"), folded_upper(variant).alias("variant"))), found)


def _known(n: Column, fields: dict[str, Column], reading: bool) -> Column:
    """The model by the rules of the makes that read more than the model, or of the others; null without a hit."""
    known = F.lit(None).cast("string")
    for name, rules in MODELS.items():
        if (name in READING) == reading:
            known = F.when(n["make"] == name, first_rule(rules, fields)).otherwise(known)
    return known


def _with_reason(make: Column, model: Column) -> Column:
    names = bound(model, lambda model: F.struct(make.alias("make"), model.alias("model"), F.upper(make).alias("upper_make"), F.upper(model).alias("upper_model")))
    return bound(names, lambda m: F.struct(m["make"].alias("make"), m["model"].alias("model"), _reason(m).alias("reason")))


def _reason(m: Column) -> Column:
    debris = F.lit(False)
    for word in MODEL_DEBRIS:
        debris = debris | m["upper_model"].contains(word)
    same = (m["upper_model"] == m["upper_make"]) | (m["upper_model"] == F.regexp_replace(m["upper_make"], r"\s+", "")) | (F.regexp_replace(m["upper_model"], r"\s+", "") == m["upper_make"])
    bad_model = m["model"].isNull() | (F.length(m["model"]) < 2) | (m["model"] == "Genel Model") | same | debris
    return F.when(F.length(m["make"]) < 2, BAD_MAKE).when(bad_model, BAD_MODEL)


def _judged(m: Column, variant: Column, raw_make: Column, raw_model: Column) -> Column:
    reason, low = m["reason"], F.lower(variant)
    no_variant = (variant == "") | variant.isin(*EMPTY_VARIANTS) | numeric_only(variant)
    for word in VARIANT_DEBRIS:
        no_variant = no_variant | low.contains(word)
    return F.struct(
        F.when(reason == BAD_MAKE, raw_make).otherwise(m["make"]).alias("make"),
        F.when(reason.isNotNull(), raw_model).otherwise(m["model"]).alias("model"),
        F.when(reason.isNull() & ~no_variant, variant).alias("variant"),
        reason.isNull().alias("is_valid"),
        reason.alias("reason"),
    )
