"""Page records from JSON bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe.functions.html import SNIPPET_CHARS, is_object, variant_text
from crawlframe.functions.lang import ordered_distinct

# Keys that hold links, and keys that hold the item list, in order of preference.
DOCUMENT_LINK_KEYS = ["url", "href", "link", "next", "next_page"]
ITEM_LINK_KEYS = ["url", "href", "link"]
ITEM_LIST_KEYS = ["items", "results", "data"]


def _http(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & F.startswith(v, F.lit("http")))


def _truthy(value: Column) -> Column:
    return value.isNotNull() & ~F.to_json(value).isin("null", "false", "0", '""', "[]", "{}")


def _items(doc: Column) -> Column:
    """Elements of the first non-empty item list; a list document is its own item list."""
    chosen = F.coalesce(
        *[
            F.when(_truthy(f), f)
            for f in (F.try_variant_get(doc, f"$.{k}", "variant") for k in ITEM_LIST_KEYS)
        ]
    )
    whole = F.try_variant_get(doc, "$", "array<variant>")
    empty = F.array().cast("array<variant>")
    return F.coalesce(whole, F.try_variant_get(chosen, "$", "array<variant>"), empty)


def document_links(doc: Column) -> Column:
    """http links of the document and of its items, distinct, in first-seen order."""
    top = F.array(*[variant_text(doc, f"$.{k}") for k in DOCUMENT_LINK_KEYS])
    nested = F.flatten(
        F.transform(
            F.filter(_items(doc), is_object),
            lambda item: F.array(*[variant_text(item, f"$.{k}") for k in ITEM_LINK_KEYS]),
        )
    )
    return ordered_distinct(_http(F.concat(top, nested)))


def document_title(doc: Column) -> Column:
    return F.coalesce(variant_text(doc, "$.title"), variant_text(doc, "$.name"))


def document_description(doc: Column) -> Column:
    return variant_text(doc, "$.description")


def document_snippet(body: Column) -> Column:
    """First 500 characters of the JSON text; an empty document has none."""
    text = F.trim(body)
    return F.when(~text.isin("{}", "null", '""'), F.substring(body, 1, SNIPPET_CHARS))
