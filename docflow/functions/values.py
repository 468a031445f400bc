"""Column functions on scalar values: comparison form, literals that say little, key tiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals so common that their equality is weak evidence.
COMMON_VALUES = ("true", "false", "none", "yes", "no", "1", "0", "null")

# Business keys by tier, with the weight of each tier.
KEY_TIERS = {
    "direkt": ("Case_id",),
    "primär": ("Bestellungsnummer", "Auftragsnummer", "Rechnungsnummer"),
    "sekundär": ("Kundennummer", "Produktid", "Artikelnummer"),
    "tertiär": ("Lieferadresse", "Email", "Telefonnummer"),
}
TIER_WEIGHTS = {"direkt": 1.0, "primär": 0.8, "sekundär": 0.5, "tertiär": 0.3}

STRING, NUMBER, NULL = "s", "n", "z"


def number_text(num: Column) -> Column:
    """Text of a double that is equal for 1 and 1.0."""
    whole = (num == F.floor(num)) & (F.abs(num) < F.lit(9.0e15))
    return F.when(whole, num.cast("long").cast("string")).otherwise(num.cast("string"))


def string_norm(text: Column) -> Column:
    return F.concat(F.lit(f"{STRING}:"), text)


def number_norm(num: Column) -> Column:
    return F.concat(F.lit(f"{NUMBER}:"), number_text(num))


def long_norm(num: Column) -> Column:
    return F.concat(F.lit(f"{NUMBER}:"), num.cast("string"))


def norm_text(norm: Column) -> Column:
    """The value of a comparison form without its class mark."""
    return F.when(norm == NULL, F.lit("none")).otherwise(F.substring(norm, 3, 2147483647))


def is_common(value: Column, vtype: Column) -> Column:
    """True for values whose lower-cased text is one of COMMON_VALUES."""
    return (vtype == "NULL") | F.lower(value).isin(*COMMON_VALUES)


def clean_key(key: Column) -> Column:
    """Keys are searched lower-cased and without `_` and `-`."""
    return F.lower(F.regexp_replace(key, "[_-]", ""))


def rule_type(key1: Column, key2: Column, common: Column) -> Column:
    return (
        F.when(key1 == key2, F.lit("SAME_KEY_VALUE_PAIR"))
        .when(common, F.lit("SAME_COMMON_VALUE"))
        .otherwise(F.lit("SAME_VALUE"))
    )


def string_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def number_similarity(a: Column, b: Column) -> Column:
    """1 - |a-b| / larger magnitude; two zeros are equal."""
    larger = F.greatest(F.abs(a), F.abs(b))
    return F.when(larger == 0, F.lit(1.0)).otherwise(1.0 - F.abs(a - b) / larger)
