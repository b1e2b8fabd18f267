"""The catalogue of market tiers and new prices, by make and by what a name contains.

Rows of ``TIERS`` stand in order of precedence.  A make is found by equality (``is``)
or as a part (``has``), by any of its names (``|``).  Of a make's rules the first counts whose words occur in model
and variant (``|`` any of them, ``+`` both); a make without a hit has its own tier and
price.
"""

from __future__ import annotations

#: Tier and new price where nothing is known of a make or its models.
OTHERS = ("standard", 2_100_000)
# Fixed values: (how, make, tier, price or None for that of OTHERS, ((words, price, tier if another), ...)).
TIERS = (
    ("has", "porsche", "exotic", None, (("gt3|turbo", 32_000_000), ("911", 22_000_000), ("taycan", 16_000_000), ("panamera", 18_000_000), ("cayenne", 16_000_000), ("macan", 9_500_000))),
    ("has", "ferrari", "exotic", 45_000_000, ()),
    ("has", "lamborghini", "exotic", 45_000_000, ()),
    ("has", "bentley", "exotic", 35_000_000, ()),
    ("has", "rolls", "exotic", 55_000_000, ()),
    ("has", "maserati", "exotic", 18_000_000, ()),
    ("has", "aston", "exotic", 32_000_000, ()),
    ("has", "mclaren", "exotic", 35_000_000, ()),
    ("is", "audi", "luxury", None, (
        ("r8", 22_000_000, "exotic"), ("rs6|rs7|rsq8", 28_000_000, "exotic"), ("rs", 17_000_000, "exotic"), ("a8|s8", 18_500_000), ("q8", 14_000_000), ("q7", 11_000_000), ("a7", 10_500_000),
        ("a6+45 tfsi|a6+3.0", 9_200_000), ("a6", 7_200_000), ("q5", 6_500_000), ("e-tron", 6_000_000), ("a5", 5_500_000), ("a4", 5_200_000), ("q3", 4_800_000), ("a3", 4_300_000), ("q2", 3_800_000), ("a1", 3_200_000),
    )),
    ("is", "bmw", "luxury", None, (
        ("m5|m 5", 26_500_000, "exotic"), ("m8|m 8", 28_500_000, "exotic"), ("m4|m 4", 18_000_000, "exotic"), ("m3|m 3", 17_500_000, "exotic"), ("m2|m 2", 12_500_000), ("xm", 25_000_000), ("x5 m|x6 m", 24_000_000),
        ("7 ser|730|740|i7", 18_500_000), ("8 ser|840", 14_500_000), ("x6", 14_000_000), ("x5", 12_500_000), ("5 ser|520|530|540|i5", 8_500_000), ("x3", 7_200_000), ("z4", 6_800_000),
        ("4 ser|420|430|i4", 6_000_000), ("3 ser|320|330|318|316", 5_400_000), ("x1", 4_500_000), ("2 ser", 4_000_000), ("1 ser", 3_600_000),
    )),
    ("has", "mercedes", "luxury", None, (
        ("g 63|g 500|g ser|g-class", 27_000_000, "exotic"), ("c 63|c63", 22_000_000, "exotic"), ("c 43|c43", 14_000_000, "exotic"), ("e 63|e63", 25_000_000, "exotic"), ("e 53|e53", 16_000_000, "exotic"),
        ("s 63|s63", 28_000_000, "exotic"), ("amg gt|gt 63|gt 53", 25_000_000, "exotic"), ("s ser|s 400|s 500|s 350|eqs", 19_500_000), ("gle", 14_000_000), ("e ser|e 180|e 200|e 220|e 250|e 300|eqe", 8_500_000),
        ("glc", 7_500_000), ("c ser|c 180|c 200|c 220|c 250|c 300", 5_800_000), ("cla", 4_500_000), ("gla", 4_200_000), ("a ser|a 180|a 200", 3_800_000),
    )),
    ("has", "volkswagen|vw", "standard", None, (("touareg", 11_500_000), ("arteon", 4_800_000), ("passat", 4_200_000), ("tiguan", 4_000_000), ("t-roc", 3_300_000), ("golf", 3_100_000), ("polo", 2_200_000))),
    ("is", "fiat", "economy", None, (("egea+cross", 1_650_000), ("egea", 1_450_000), ("linea", 2_700_000), ("punto", 2_600_000), ("palio|albea", 2_200_000), ("doblo|fiorino", 2_300_000))),
    ("is", "renault", "standard", None, (("austral|kadjar", 3_500_000), ("megane", 2_900_000), ("clio|captur|symbol", 1_900_000))),
    ("is", "peugeot", "standard", None, (("5008|3008", 4_000_000), ("508", 4_200_000), ("308|2008", 3_000_000), ("208|301", 2_700_000))),
    ("is", "toyota", "standard", None, (("land cruiser", 22_000_000), ("rav4|c-hr", 3_800_000), ("corolla", 2_400_000), ("yaris", 2_100_000))),
    ("is", "hyundai", "standard", None, (("santa fe", 5_000_000), ("tucson", 4_000_000), ("elantra", 3_200_000), ("i30|kona", 3_000_000), ("i20|bayon", 2_400_000), ("accent blue", 3_200_000), ("accent", 3_000_000), ("i10", 2_000_000))),
    ("is", "ford", "standard", None, (("mustang", 9_500_000), ("ranger", 4_200_000), ("kuga", 3_800_000), ("puma", 3_000_000), ("focus", 2_650_000), ("fiesta", 2_000_000))),
    ("is", "honda", "standard", None, (("cr-v", 4_500_000), ("hr-v", 3_200_000), ("civic", 2_950_000), ("city|jazz", 2_200_000))),
    ("is", "volvo", "luxury", None, (
        ("xc90", 11_500_000), ("xc60", 8_500_000), ("v90", 8_300_000), ("s90", 8_100_000), ("v60", 5_800_000), ("s60", 5_500_000), ("xc40", 4_500_000), ("s80", 2_200_000), ("v40", 1_900_000), ("s40|c30|s70", 1_100_000),
    )),
    ("has", "land rover|range rover", "luxury", None, (
        ("range rover sport", 18_500_000), ("range rover velar", 11_500_000), ("range rover evoque", 4_800_000), ("range rover", 24_000_000), ("defender", 14_000_000), ("discovery sport", 4_500_000), ("discovery", 10_500_000),
    )),
    ("is", "chery", "standard", None, (("tiggo 8", 2_800_000), ("tiggo 7", 2_400_000), ("omoda 5", 2_200_000))),
    ("is", "togg", "standard", 1_850_000, (("long|v2", 2_300_000),)),
    ("is", "tesla", "standard", None, (("model y+performance", 4_200_000), ("model y", 2_900_000), ("model 3", 2_800_000), ("model s|model x", 14_000_000))),
    ("is", "cupra", "standard", None, (("formentor", 3_200_000), ("leon", 2_500_000), ("ateca", 2_900_000))),
    ("is", "opel", "economy", None, (("grandland", 2_800_000), ("mokka|crossland", 2_300_000), ("astra", 1_900_000), ("corsa", 1_450_000), ("insignia", 1_600_000))),
    ("is", "nissan", "standard", None, (("x-trail", 3_800_000), ("qashqai", 2_500_000), ("juke", 2_000_000), ("micra", 1_100_000))),
    ("has", "skoda|škoda", "standard", None, (("kodiaq", 4_200_000), ("superb", 3_500_000), ("karoq", 2_750_000), ("octavia", 2_550_000), ("kamiq|scala", 2_100_000), ("fabia", 1_500_000))),
    ("has", "citroen|citroën", "economy", None, (("c5 aircross|c5 x", 2_800_000), ("c4", 1_800_000), ("c3", 1_400_000), ("berlingo", 1_600_000), ("c-elysee", 850_000))),
    ("is", "kia", "standard", None, (("ev6|ev9", 5_500_000), ("sorento", 4_500_000), ("sportage", 3_200_000), ("ceed|cerato", 1_800_000), ("stonic|rio", 1_300_000), ("picanto", 1_000_000))),
    ("is", "seat", "standard", None, (("tarraco", 3_300_000), ("ateca", 2_500_000), ("leon", 2_000_000), ("ibiza|arona", 1_400_000))),
    ("is", "dacia", "economy", None, (("duster", 1_850_000), ("jogger", 1_750_000), ("stepway", 1_500_000), ("sandero", 1_300_000), ("logan", 950_000))),
)
