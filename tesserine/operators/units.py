"""Quantities recorded in different units and scales, converted to one common unit per quantity.

Plain column expressions and two joins with small tables: the number and what follows it are extracted, the spelling of a
unit is brought to a catalogue unit through an alias table, the unit in the text goes before the unit field and that
before a default of the source, then factor and offset are applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Spellings of catalogue units beside their own name, its plural and its joined forms. Case counts where it must.
SPELLINGS = {
    "Wh": "watt-hour", "kWh": "kilowatt-hour kw.h", "MWh": "megawatt-hour Mwh", "GWh": "gigawatt-hour", "TWh": "terawatt-hour", "MJ": "mega-joule", "GJ": "giga-joule", "BTU": "btu btus",
    "mL": "ml milliliter", "L": "l ltr ltrs liter lit", "m3": "cubic|meter cu|m cum cbm", "ML": "megaliter", "gal": "gallon us|gal u.s.|gal us|gallon usg", "acre-ft": "acre|ft acre|feet acre-feet af",
    "g": "gr gm gramme", "kg": "kgs kilo kilos kilogramme", "t": "tonne mt metric|tonne te ton|metric", "kt": "kiloton", "lb": "lbs pound", "short ton": "us|ton u.s.|ton ton|us",
    "W": "w", "kW": "kw", "MW": "Mw", "GW": "gw", "hp": "horsepower horse|power", "s": "sec secs", "min": "mins", "h": "hr hrs", "d": "", "wk": "wks",
    "degC": "C celsius deg|C °C ℃ centigrade degree|celsius degrees|celsius", "degF": "F fahrenheit deg|F °F ℉ degree|fahrenheit degrees|fahrenheit", "K": "kelvin deg|K °K",
}
# Scale words of numbers and units.
SCALES = {"k": 1e3, "thousand": 1e3, "thousands": 1e3, "tsd": 1e3, "mn": 1e6, "mio": 1e6, "million": 1e6, "millions": 1e6, "bn": 1e9, "billion": 1e9, "billions": 1e9, "10^3": 1e3, "10^6": 1e6, "10^9": 1e9}
SCALE = r"10\^[369]|[Tt]housands?|THOUSANDS?|[Mm]illions?|MILLIONS?|[Bb]illions?|BILLIONS?|tsd|mio|mn|bn|k"
BLANK = r"[\s    ]"
NUMBER = (
    r"\d{1,3}(?:,\d{3})+(?:\.\d+)?"
    r"|\d{1,3}(?:\.\d{3}){2,}(?:,\d+)?|\d{1,3}(?:\.\d{3})+,\d+"
    r"|\d{1,3}(?:[     '’]\d{3})+(?:[.,]\d+)?"
    r"|\d+,\d+|\d*\.?\d+"
)
ABOUT = r"(?:(?:approx\.?|approximately|about|around|roughly|circa|ca?\.|etwa|environ|unos|aprox\.?)\s*|[~≈∼±]\s*)?"
POWER = r"(?:[eE]([+\-−]?\d{1,3})|\s*[×x*·]\s*10\s*\^?\s*([+\-−]?\d{1,3}))?"
AMOUNT = rf"^{ABOUT}([+\-−]?(?:{NUMBER})){POWER}(?:{BLANK}*({SCALE})(?:{BLANK}+of)?(?:{BLANK}+|$))?{BLANK}*([^\d].*)?$"


def spelling(unit: Column) -> Column:
    """A unit as it is looked up: without blanks, dots, dashes and what the amount is of (CO2), exponents as digits."""
    u = F.translate(unit, "³²₂₃⁻    ", "3223-    ")
    u = F.regexp_replace(u, r"(?i)\b(?:of )?(?:CO2(?:e|eq|-eq)?|carbon dioxide(?: equivalents?)?)\s*$", "")
    u = F.regexp_replace(u, r"(?i)CO2(?:e|eq|-eq)?\s*$", "")
    u = F.regexp_replace(u, r"\^(?=3)", "")
    return F.regexp_replace(u, r"[\s.·⋅\-–/]+", "")


def aliases(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """(alias, unit): every spelling that stands for a catalogue unit; lower-case aliases match any case."""
    extra = [(u, a.replace("|", " ")) for u, forms in SPELLINGS.items() for a in forms.split()]
    more = spark.createDataFrame(extra, "unit string, name string")
    names = (
        catalog.select("unit", F.col("unit").alias("name"))
        .unionByName(catalog.select("unit", F.col("unit_name").alias("name")))
        .unionByName(more.join(catalog.select("unit"), "unit", "left_semi"))
    )
    plural = names.where(F.length("name") > 2).select("unit", F.concat("name", F.lit("s")).alias("name"))
    joined = spelling(F.col("name"))
    both = names.unionByName(plural).select(joined.alias("alias"), "unit")
    lower = both.where(F.length("alias") > 2).select(F.lower("alias").alias("alias"), "unit")
    return both.unionByName(lower).where("alias <> ''").groupBy("alias").agg(F.min("unit").alias("unit"))


def _scale_of(word: Column) -> Column:
    table = F.create_map(*[x for k, v in SCALES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.lower(word)), F.lit(1.0))


def split_unit(unit: Column) -> tuple[Column, Column]:
    """(scale, bare unit) of a unit that may hold a scale: `10^3 kWh`, `millions of L`, `kW (thousands)`."""
    u = F.trim(F.regexp_replace(F.coalesce(unit, F.lit("")), rf"{BLANK}+", " "))
    head = F.regexp_extract(u, rf"^({SCALE})(?: of)? (.+)$", 1)
    tail = F.regexp_extract(u, rf"^(.+?) ?\(({SCALE})\)$", 2)
    bare = F.when(head != "", F.regexp_extract(u, rf"^({SCALE})(?: of)? (.+)$", 2)).when(tail != "", F.regexp_extract(u, rf"^(.+?) ?\(({SCALE})\)$", 1)).otherwise(u)
    return _scale_of(F.when(head != "", head).otherwise(tail)), bare


def plain_number(text: Column) -> Column:
    """The digits of a number as written anywhere, as one that can be cast: grouping removed, decimal point set."""
    t = F.regexp_replace(F.translate(text, "−    '’ ", "-"), r"^\+", "")
    grouped_comma = t.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$")
    grouped_dot = t.rlike(r"^-?\d{1,3}(\.\d{3}){2,}(,\d+)?$") | t.rlike(r"^-?\d{1,3}(\.\d{3})+,\d+$")
    return F.when(grouped_comma, F.translate(t, ",", "")).when(grouped_dot, F.translate(F.translate(t, ".", ""), ",", ".")).otherwise(F.translate(t, ",", "."))


def amounts(rows: DataFrame, catalog: DataFrame, key: str, value: str, unit: str, default_unit: str | None = None) -> DataFrame:
    """(key, bare, scale, unit, quantity, common_unit, amount): the rows that hold one single amount of a known unit.

    A unit in the value goes before the unit field, that before the column default_unit. Ranges, lists, texts and values
    with a unit that the catalogue does not know are no single amounts; null and empty values neither. Equal rows of one
    key come out once, rows with a null key not at all. amount = bare * scale * factor + shift.
    """
    spark = rows.sparkSession
    v = F.trim(F.regexp_replace(F.translate(F.col(value), "⁰¹²³⁴⁵⁶⁷⁸⁹⁻​﻿", "0123456789-"), rf"^{BLANK}+|{BLANK}+$", ""))
    v = F.regexp_replace(F.regexp_replace(v, "₂", "2"), "m3", "m³")  # digits behind the number belong to units
    base = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), v.alias("v"), F.col(unit).alias("field"), (F.col(default_unit) if default_unit else F.lit(None).cast("string")).alias("usual")).distinct()
    part = lambda i: F.regexp_extract("v", AMOUNT, i)
    parsed = base.where(F.col("v").rlike(AMOUNT)).select("key", "field", "usual", part(1).alias("number"), F.concat(part(2), part(3)).alias("power"), part(4).alias("word"), F.coalesce(part(5), F.lit("")).alias("rest"))
    exponent = F.coalesce(F.regexp_replace(F.translate("power", "−", "-"), r"^\+", "").try_cast("int"), F.lit(0))
    bare = plain_number(F.col("number")).try_cast("double")
    parsed = parsed.withColumn("bare", bare * F.pow(F.lit(10.0), exponent))
    text_scale, text_unit = split_unit(F.col("rest"))
    field_scale, field_unit = split_unit(F.col("field"))
    usual_scale, usual_unit = split_unit(F.col("usual"))
    parsed = parsed.select(
        "key", "bare", _scale_of(F.col("word")).alias("word_scale"), (F.col("rest") != "").alias("has_text"),
        text_scale.alias("s1"), spelling(text_unit).alias("u1"), field_scale.alias("s2"), spelling(field_unit).alias("u2"), usual_scale.alias("s3"), spelling(usual_unit).alias("u3"),
    )
    known = F.broadcast(aliases(spark, catalog))  # a few spellings for each unit of the catalogue: under 1,000 short rows
    for i in ("1", "2", "3"):
        exact = known.select(F.col("alias").alias(f"u{i}"), F.col("unit").alias(f"e{i}"))
        loose = known.select(F.col("alias").alias(f"l{i}"), F.col("unit").alias(f"f{i}"))
        parsed = parsed.join(exact, f"u{i}", "left").withColumn(f"l{i}", F.lower(f"u{i}")).join(loose, f"l{i}", "left")
    found = [F.coalesce(F.col(f"e{i}"), F.col(f"f{i}")) for i in "123"]
    chosen = F.when(F.col("has_text"), F.when(found[0].isNotNull(), F.struct(found[0].alias("unit"), F.col("s1").alias("scale"))))
    chosen = chosen.when(found[1].isNotNull(), F.struct(found[1].alias("unit"), F.col("s2").alias("scale"))).when(found[2].isNotNull(), F.struct(found[2].alias("unit"), F.col("s3").alias("scale")))
    single = parsed.select("key", "bare", "word_scale", chosen.alias("c")).where("c is not null and bare is not null")
    single = single.select("key", "bare", (F.col("word_scale") * F.col("c.scale")).alias("scale"), F.col("c.unit").alias("unit"))
    single = single.join(F.broadcast(catalog.select("unit", "quantity", "common_unit", "factor", "shift")), "unit")
    amount = F.col("bare") * F.col("scale") * F.col("factor") + F.col("shift")
    return single.select(F.col("key").alias(key), "bare", "scale", "unit", "quantity", "common_unit", amount.alias("amount"))


def same_amounts(found: DataFrame, key: str, group: str, tolerance: float = 0.005) -> DataFrame:
    """(key_lo, key_hi): pairs of one group with equal amounts (within tolerance of the larger) but different bare numbers.

    A band join: amounts fall into logarithmic bins as wide as the tolerance and meet the amounts of their own and the
    two neighbouring bins only, so a group of any size is never paired with itself as a whole.
    """
    import math

    width = -math.log1p(-tolerance) * 1.001
    a = F.col("amount")
    sign = F.signum(a).cast("int")
    bin_of = F.when(a == 0, F.lit(0).cast("long")).otherwise(F.floor(F.log(F.abs(a)) / width))
    rows = found.select(F.col(key).alias("k"), F.col(group).alias("g"), "quantity", "bare", "amount", sign.alias("sign"), bin_of.alias("bin")).where("g is not null")
    left = rows.withColumn("bin", F.explode(F.when(a == 0, F.array("bin")).otherwise(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))))
    x, y = left.alias("x"), rows.alias("y")
    near = lambda p, q: F.abs(p - q) <= tolerance * F.greatest(F.abs(p), F.abs(q))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("g", "quantity", "sign", "bin")]
    cond = same[0] & same[1] & same[2] & same[3] & (F.col("x.k") < F.col("y.k")) & near(F.col("x.amount"), F.col("y.amount")) & ~near(F.col("x.bare"), F.col("y.bare"))
    return x.join(y, cond).select(F.col("x.k").alias(f"{key}_lo"), F.col("y.k").alias(f"{key}_hi"))
