"""Make, model and trim of a listing told from its folder, file, tag and title.

The make is that of the first rule whose needle occurs in the joint text, or in the
folder alone for the makes that have folders; without a hit it is the folder's name, or
the default where the folder is no make's.  A make with rules of its own gives the
model of the first one that hits; otherwise the tag is the model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.functions.inference import TRIMS
from pricewright.functions.keywords import Rule, first_rules, output

# Folders that are no make, and the makes and models taken without a hit.
OTHER_FOLDERS, DEFAULT_MAKE, DEFAULT_MODEL, DEFAULT_TRIM = ("", "sahibindne ilan", "Desktop"), "Audi", "Model", "Paket"
# Makes in order, with what is searched in the joint text and in the folder.
MAKES = (
    ("Alfa Romeo", ("ALFA ROMEO", "ALFAROMEO"), ("ALFA",)), ("BMW", ("BMW",), ("BMW",)), ("Audi", ("AUDI",), ("AUDI",)), ("Aston Martin", ("ASTON MARTIN",), ("ASTON",)), ("Bentley", ("BENTLEY",), ("BENTLEY",)),
    ("Bajaj", ("BAJAJ",), ("BAJAJ",)), ("Abarth", ("ABARTH",), ("ABARTH",)), ("Anadol", ("ANADOL",), ("ANADOL",)), ("Alpine", ("ALPINE",), ("ALPINE",)), ("Aion", ("AION",), ("AION",)), ("Arora", ("ARORA",), ("ARORA",)),
    ("Mercedes-Benz", ("MERCEDES",), ()), ("Volkswagen", ("VOLKSWAGEN", "VW"), ()), ("Renault", ("RENAULT",), ()), ("Fiat", ("FIAT",), ()), ("Ford", ("FORD",), ()), ("Toyota", ("TOYOTA",), ()), ("Honda", ("HONDA",), ()),
    ("Hyundai", ("HYUNDAI",), ()), ("Kia", ("KIA",), ()), ("Peugeot", ("PEUGEOT",), ()), ("Citroën", ("CITROEN", "CITROËN"), ()), ("Opel", ("OPEL",), ()), ("Volvo", ("VOLVO",), ()), ("Porsche", ("PORSCHE",), ()),
    ("Seat", ("SEAT",), ()), ("Skoda", ("SKODA", "ŠKODA"), ()), ("Nissan", ("NISSAN",), ()),
)
# Models in order by make, with what is searched in the joint text.
MODELS = {
    "Alfa Romeo": (("GIULIETTA", "Giulietta"), ("GIULIA", "Giulia"), ("TONALE", "Tonale"), ("STELVIO", "Stelvio"), ("159", "159"), ("147", "147"), ("156", "156"), ("MITO", "MiTo"), ("GT", "GT"), ("4C", "4C")),
    "BMW": (
        *((f"{k} SERİSİ|{k} SERISI", f"{k} Serisi") for k in range(1, 9)), *((f"X{k}", f"X{k}") for k in range(1, 8)),
        ("Z SERİSİ|Z SERISI|Z4", "Z Serisi"), ("M SERİSİ|M SERISI", "M Serisi"), ("I SERİSİ|I SERISI|IX", "i Serisi"),
    ),
    "Audi": tuple((m, m) for m in ("A1", "A3", "A4", "A5", "A6", "A7", "A8", "Q2", "Q3", "Q5", "Q7", "Q8", "TT", "R8")),
}


def tables() -> dict[str, list[Rule]]:
    """The rules of makes, of each make's models, and of trims."""
    found: dict[str, list[Rule]] = {"make": [{"all": joint, "folder": folder} for _, joint, folder in MAKES]}
    found |= {make: [{"all": needles.split("|")} for needles, _ in rules] for make, rules in MODELS.items()}
    return found | {"trim": [{"trim": needles} for needles, _ in TRIMS]}


def detected(rows: DataFrame, folder: Column, file: Column, tag: Column, title: Column, into: str = "detected") -> DataFrame:
    """The rows with (make, model, trim) in one column; nulls are empty texts."""
    folder, file, tag, title = (F.coalesce(x, F.lit("")) for x in (folder, file, tag, title))
    fields = {"all": F.upper(F.concat_ws(" ", folder, file, tag, title)), "folder": F.upper(folder), "trim": F.upper(F.concat_ws(" ", title, tag))}
    given = F.struct(folder.alias("folder"), tag.alias("tag"))
    found = first_rules(rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), given.alias("given"), *(x.alias(k) for k, x in fields.items())), {k: F.col(k) for k in fields}, tables(), "rule")
    own = F.when(F.col("given.folder").isin(*OTHER_FOLDERS), DEFAULT_MAKE).otherwise(F.col("given.folder"))
    make = F.coalesce(output(F.col("rule.make"), [m for m, _, _ in MAKES], "string"), own)
    model = F.coalesce(F.nullif(F.col("given.tag"), F.lit("")), F.lit(DEFAULT_MODEL))
    found = found.withColumn("make", make)
    for name, rules in MODELS.items():
        model = F.when(F.col("make") == name, F.coalesce(output(F.col("rule").getField(name), [m for _, m in rules], "string"), model)).otherwise(model)
    trim = F.coalesce(output(F.col("rule.trim"), [t for _, t in TRIMS], "string"), F.lit(DEFAULT_TRIM))
    return found.select("row.*", F.struct(F.col("make"), model.alias("model"), trim.alias("trim")).alias(into))
