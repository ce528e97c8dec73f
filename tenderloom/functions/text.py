"""Column expressions over names, identifiers and free text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom import fixed


def _foldable() -> tuple[str, str]:
    # Every precomposed Latin letter whose decomposition is one base letter plus marks.
    source, target = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(point)
        base = "".join(
            c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn"
        )
        if base != letter and len(base) == 1:
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _foldable()


def fold_accents(text: Column) -> Column:
    """Letters without diacritics, precomposed or decomposed."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{Mn}", "")


def province_name(raw: Column) -> Column:
    """Upper case, no diacritics, single spaces; blank becomes null."""
    folded = fold_accents(F.upper(F.trim(raw)))
    return F.nullif(F.trim(F.regexp_replace(folded, r"\s+", " ")), F.lit(""))


def known_province(raw: Column) -> Column:
    """``province_name`` with aliases applied; names outside the list become null."""
    name = province_name(raw)
    alias = F.create_map(*[F.lit(x) for pair in fixed.PROVINCE_ALIASES.items() for x in pair])
    resolved = F.coalesce(F.try_element_at(alias, name), name)
    return F.when(resolved.isin(*fixed.PROVINCES), resolved)


def is_catalogue(modality: Column) -> Column:
    return F.coalesce(
        F.lower(fold_accents(F.trim(modality))).startswith("catalogo"), F.lit(False)
    )


def normalise_modality(modality: Column, kept: Column) -> Column:
    """Catalogue under one label, kept names as they are, the rest as other."""
    name = F.coalesce(F.nullif(modality, F.lit("")), F.lit(fixed.OTHER_MODALITY))
    return (
        F.when(is_catalogue(modality), fixed.CATALOGUE)
        .when(F.array_contains(kept, name), name)
        .otherwise(fixed.OTHER_MODALITY)
    )


def collapse_catalogue(modality: Column) -> Column:
    """First round: any mention of the electronic catalogue is one category; blank is null."""
    name = F.trim(modality)
    return F.when(name == "", None).otherwise(
        F.when(
            fold_accents(name).rlike(r"(?i)catalogo\s+electronico"),
            fixed.CATALOGUE_FIRST_ROUND,
        ).otherwise(name)
    )


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w\w+"), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """First round: accents stripped, then the stop list removed."""
    words = tokens(fold_accents(F.lower(text)))
    return F.filter(words, lambda w: ~w.isin(*fixed.STOP_WORDS))


def tax_id(identifier: Column) -> Column:
    return F.nullif(F.regexp_extract(identifier, fixed.TAX_ID, 1), F.lit(""))


def portal_code(ocid: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(ocid, fixed.PORTAL_CODE, 1), F.lit("")), ocid)


def query_digits(raw: Column) -> Column:
    """Digits of a typed id when there are exactly 13, else null."""
    digits = F.regexp_replace(raw, r"\D", "")
    return F.when(F.length(digits) == 13, digits)


def after_marker(text: Column, marker: str) -> Column:
    """Trimmed text after the last marker; null without the marker."""
    return F.when(
        F.contains(text, F.lit(marker)), F.trim(F.substring_index(text, marker, -1))
    )
