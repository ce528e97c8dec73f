"""Row-local expressions over nested releases; nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.functions.text import known_province, province_name


def _items(array: Column) -> Column:
    return F.coalesce(F.filter(array, lambda x: x.isNotNull()), F.array())


def filled(value: Column, kind: str = "string") -> Column:
    """Presence test: blank strings and empty lists count as absent."""
    if kind == "string":
        return F.coalesce(F.trim(value) != "", F.lit(False))
    if kind == "list":
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull()


def any_of(array: Column, test) -> Column:
    return F.coalesce(F.exists(array, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def role_has_region(parties: Column, role: str) -> Column:
    return any_of(
        parties,
        lambda p: F.array_contains(p["roles"], role) & filled(p["address"]["region"]),
    )


def presence() -> list[Column]:
    """One boolean per audited field, aliased with the field's name."""
    tender = F.col("tender")
    amount = F.get_json_object("planning.budget", "$.amount")
    nested = F.get_json_object("planning.budget", "$.amount.amount")
    tests = [
        filled(F.col("parties"), "list"),
        role_has_region(F.col("parties"), "supplier"),
        role_has_region(F.col("parties"), "buyer"),
        any_of(F.col("awards"), lambda a: any_of(a["suppliers"], lambda s: filled(s["id"]))),
        any_of(F.col("awards"), lambda a: a["value"]["amount"].isNotNull()),
        any_of(
            F.col("awards"),
            lambda a: any_of(a["items"], lambda i: filled(i["classification"]["id"])),
        ),
        any_of(F.col("awards"), lambda a: any_of(a["items"], lambda i: filled(i["description"]))),
        filled(F.col("buyer.id")),
        tender.isNotNull() & (F.to_json(tender) != "{}"),
        any_of(tender["items"], lambda i: filled(i["classification"]["id"])),
        any_of(tender["items"], lambda i: filled(i["description"])),
        tender["value"]["amount"].isNotNull(),
        F.when(amount.startswith("{"), filled(nested)).otherwise(filled(amount)),
        filled(tender["procurementMethodDetails"]),
        filled(tender["status"]),
        filled(tender["tenderPeriod"]["endDate"]),
        filled(tender["tenderers"], "list"),
        filled(F.col("bids.details"), "list"),
    ]
    return [t.alias(name) for t, name in zip(tests, fixed.AUDITED_FIELDS)]


def still_open(end_date: Column, today: Column) -> Column:
    return F.coalesce(F.substring(end_date, 1, 10) >= today, F.lit(False))


def amount_sum(array: Column) -> Column:
    """Sum of the stated amounts; null when none is stated."""
    amounts = F.filter(F.transform(array, lambda x: x["value"]["amount"]), lambda v: v.isNotNull())
    return F.when(
        F.size(amounts) > 0, F.aggregate(amounts, F.lit(0.0), lambda acc, v: acc + v)
    )


def budget(value: Column, lots: Column) -> tuple[Column, Column]:
    """Final rule: stated value, else sum of lots; not positive is dropped later."""
    lots = F.when(value.isNull(), lots)
    amount = F.coalesce(value, lots)
    origin = F.when(value.isNotNull(), "tender.value").when(lots.isNotNull(), "tender.lots")
    return F.when(amount > 0, amount), F.when(amount > 0, origin)


def process_amount(value: Column, lots: Column, awards: Column) -> tuple[Column, Column]:
    """First-round rule: first positive among value, lots and awards."""
    amount = F.when(value > 0, value).when(lots > 0, lots).when(awards > 0, awards)
    origin = (
        F.when(value > 0, "tender.value")
        .when(lots > 0, "tender.lots")
        .when(awards > 0, "awards.value")
        .otherwise("sin_monto")
    )
    return amount, origin


def role_region(parties: Column, roles: list[str], valid_only: bool = False) -> Column:
    """Region of the first party holding one of the roles and a usable region."""
    clean = known_province if valid_only else province_name
    regions = F.transform(
        F.filter(parties, lambda p: F.arrays_overlap(p["roles"], F.array(*map(F.lit, roles)))),
        lambda p: clean(p["address"]["region"]),
    )
    return F.get(F.filter(regions, lambda r: r.isNotNull()), F.lit(0))


def party_region(parties: Column, party_id: Column) -> Column:
    """Known province of the first party with this id."""
    first = F.get(F.filter(parties, lambda p: p["id"] == party_id), F.lit(0))
    return known_province(first["address"]["region"])


def supplier_regions(parties: Column) -> Column:
    """Map supplier id -> region; the last usable duplicate wins."""
    usable = F.filter(
        F.transform(
            F.filter(
                parties,
                lambda p: F.array_contains(p["roles"], "supplier") & (p["id"] != ""),
            ),
            lambda p: F.named_struct(
                F.lit("id"), p["id"], F.lit("r"), province_name(p["address"]["region"])
            ),
        ),
        lambda e: e["r"].isNotNull(),
    )
    # Reading from the end makes the last duplicate the first one found.
    return F.reverse(usable)


def region_of(regions: Column, supplier_id: Column) -> Column:
    return F.get(F.filter(regions, lambda e: e["id"] == supplier_id), F.lit(0))["r"]


def process_items() -> tuple[Column, Column]:
    """Tender items, else the awards' items, with their origin."""
    own = _items(F.col("tender.items"))
    awarded = _items(F.flatten(F.transform(_items(F.col("awards")), lambda a: _items(a["items"]))))
    items = F.when(F.size(own) > 0, own).otherwise(awarded)
    origin = (
        F.when(F.size(own) > 0, "tender.items")
        .when(F.size(awarded) > 0, "awards.items")
        .otherwise("sin_items")
    )
    return items, origin


def all_codes(items: Column) -> Column:
    """First round: main and additional codes with repeats, in order."""
    return F.flatten(
        F.transform(
            _items(items),
            lambda i: F.filter(
                F.transform(
                    F.concat(
                        F.array(i["classification"]["id"]),
                        F.coalesce(
                            F.transform(i["additionalClassifications"], lambda c: c["id"]),
                            F.array().cast("array<string>"),
                        ),
                    ),
                    lambda c: F.trim(c),
                ),
                lambda c: c.isNotNull() & (c != ""),
            ),
        )
    )


def main_codes(items: Column) -> Column:
    """Final rule: distinct main codes."""
    return F.array_distinct(
        F.filter(
            F.transform(_items(items), lambda i: i["classification"]["id"]),
            lambda c: c.isNotNull() & (c != ""),
        )
    )


def item_texts(items: Column) -> Column:
    return F.filter(
        F.transform(_items(items), lambda i: i["description"]),
        lambda d: d.isNotNull() & (d != ""),
    )


def process_text(items: Column) -> Column:
    """First round: description, title, then each item's and its class's description."""
    parts = F.concat(
        F.array(F.col("tender.description"), F.col("tender.title")),
        F.flatten(
            F.transform(
                _items(items),
                lambda i: F.array(i["description"], i["classification"]["description"]),
            )
        ),
    )
    usable = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(usable, " ")


def first_failure(reasons: list[tuple[str, Column]]) -> Column:
    """Name of the first failing check, null when all pass."""
    label = F.lit(None).cast("string")
    for name, failed in reversed(reasons):
        label = F.when(failed, name).otherwise(label)
    return label
