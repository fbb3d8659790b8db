"""Publication numbers and keys as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORTED = ("EP", "US", "WO")


def normalise_numbers(df: DataFrame, col: str = "input_raw") -> DataFrame:
    """Add outcome (parsed, needs_normalisation, unparseable), country, number, kind and pub_key.

    The country is cut off before separators are dropped, so ``E P 123`` has none. Blank input is unparseable.
    """
    raw = F.trim(col)
    country = F.upper(F.regexp_extract(raw, r"^([A-Za-z]+)", 1))
    rest = F.translate(F.regexp_extract(raw, r"^[A-Za-z]+([\s\S]*)$", 1), " ./,", "")
    number = F.regexp_extract(rest, r"^(\d+)([A-Za-z]\d*)?$", 1)
    kind = F.upper(F.regexp_extract(rest, r"^(\d+)([A-Za-z]\d*)?$", 2))
    good = (country != "") & (number != "")
    outcome = F.when(~good | raw.isNull(), "unparseable").when(~country.isin(*SUPPORTED), "needs_normalisation").otherwise("parsed")
    return df.withColumns(
        {
            "outcome": outcome,
            "country": F.when(good, country),
            "number": F.when(good, number),
            "kind": F.when(good & (kind != ""), kind),
            "pub_key": F.when(good, pub_key(country, number)),
        }
    )


def pub_key(country: Column, number: Column) -> Column:
    return F.concat(country, number)


def docdb_id(country: Column, number: Column, kind: Column) -> Column:
    return F.concat_ws(".", country, number, kind)


def split_pub_key(key: Column) -> tuple[Column, Column]:
    """Country letters and the rest."""
    return F.regexp_extract(key, r"^([A-Za-z]+)", 1), F.regexp_extract(key, r"^[A-Za-z]+(.*)$", 1)


def docdb_country(docdb: Column) -> Column:
    return F.split_part(docdb, F.lit("."), F.lit(1))


def publication_url(key: Column, kinds: Column, base: str = "https://worldwide.espacenet.com/patent/search?q=pn%3D") -> Column:
    """Link from a key and the first kind code; null unless the key is letters and digits."""
    return F.when(key.rlike(r"^[A-Z]+\d+$"), F.concat(F.lit(base), key, F.coalesce(F.try_element_at(kinds, F.lit(1)), F.lit(""))))
