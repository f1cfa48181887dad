"""Schemas of landed JSON payloads, and features read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

CATALOG_ITEM = (
    "item_id string, name string, developer string, publisher string, positive string, negative string, owners_low string,"
    " owners_high string, price string, initialprice string, discount string, tags map<string,bigint>"
)
DETAIL = (
    "success:boolean, data:struct<type:string, name:string, is_free:boolean, dlc:array<string>, supported_languages:string,"
    " pc_requirements:struct<minimum:string,recommended:string>, developers:array<string>, publishers:array<string>,"
    " price_overview:struct<currency:string,initial:bigint,final:bigint>, platforms:map<string,boolean>,"
    " categories:array<struct<id:string,description:string>>, genres:array<struct<id:string,description:string>>,"
    " achievements:struct<total:string>, release_date:struct<coming_soon:boolean,date:string>>"
)
REVIEWS = "success:int, query_summary:struct<total_positive:bigint,total_negative:bigint,total_reviews:bigint>"
LABEL_SOURCE = "tags map<string,bigint>"


def inner_object(payload: Column, item_id: Column) -> Column:
    """The object of a payload as a variant, parsed once: of one keyed by its item's id the inner object, any other as it is; null for text that is no JSON.

    Give it a column of its own where several fields are read from it. An object that names a key twice is no JSON here."""
    inner = lambda v: F.coalesce(F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), item_id.cast("string")), v)
    return bound(F.try_parse_json(payload), inner)


def typed(inner: Column, schema: str) -> Column:
    """An object as a struct; fields that are lacking or of another kind are null."""
    return F.try_variant_get(inner, "$", f"struct<{schema}>")


def handheld_category(inner: Column, key_ending: str) -> Column:
    """compat_category of the block of a detail object's data whose key ends in `key_ending`; null without one."""
    data = F.try_variant_get(inner, "$.data", "map<string,variant>")
    blocks = F.map_values(F.map_filter(data, lambda k, _: k.endswith(key_ending)))
    return F.try_variant_get(F.get(blocks, 0), "$.compat_category", "string")


def payload_hash(payload: Column) -> Column:
    """SHA-256 of a landed payload's text, as hex."""
    return F.sha2(payload, 256)


def dollars(cents: Column) -> Column:
    """Cents as text or number; what is no number counts as 0."""
    return F.coalesce(cents.try_cast("double"), F.lit(0.0)) / 100


def names_of(listed: Column) -> Column:
    return F.transform(listed, lambda g: F.coalesce(g["description"], F.lit("")))


def first_or(listed: Column, other: Column) -> Column:
    """The first of a non-empty list, even a blank one; else `other`."""
    return F.when(F.size(listed) > 0, F.get(listed, 0)).otherwise(other)


def review_count(total: Column, ok: Column, positive: Column, negative: Column) -> Column:
    both = F.coalesce(positive, F.lit(0)) + F.coalesce(negative, F.lit(0))
    return F.coalesce(F.when(ok, total), F.when(both != 0, both))


def review_source(total: Column, ok: Column, positive: Column, negative: Column) -> Column:
    both = F.coalesce(positive, F.lit(0)) + F.coalesce(negative, F.lit(0))
    return F.when(ok & total.isNotNull(), "reviews").when(both != 0, "catalog").otherwise("none")


def positive_share(positive: Column, total: Column) -> Column:
    return F.when(total > 0, positive / total)


def whole_count(text: Column) -> Column:
    """A number of at least 0, else null."""
    n = text.try_cast("int")
    return F.when(n >= 0, n)


#: Fixed value: the mark of a language with full audio.
AUDIO_MARK = "<strong>*</strong>"


def language_count(listed: Column) -> Column:
    """How many names a comma-separated list has, audio marks taken out; null for none."""
    n = F.size(F.filter(F.split(F.replace(listed, F.lit(AUDIO_MARK), F.lit("")), ","), lambda x: F.trim(x) != ""))
    return F.when(n > 0, n)


def platform_count(flags: Column) -> Column:
    n = F.size(F.filter(F.map_values(flags), lambda x: x))
    return F.when(n > 0, n)


def early_access(genres: Column) -> Column:
    return F.coalesce(F.exists(genres, lambda g: F.coalesce((g["id"] == "70") | (F.lower(F.trim(g["description"])) == "early access"), F.lit(False))), F.lit(False))


def any_of(listed: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(listed, F.array(*[F.lit(v) for v in values])), F.lit(False)) if values else F.lit(False)


def missing_names(**columns: Column) -> Column:
    """Names of the columns that are null, in the order given."""
    return F.array_compact(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in columns.items()]))


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
