"""HTML fields as native column expressions over a page corpus.

No DOM is built: tags are tokenised with regular expressions, quoted attribute values included.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe.functions.lang import WS, let, ordered_distinct, strip
from crawlframe.functions.urls import navigable, normalize_urls, resolve_urls, web_only

SNIPPET_CHARS = 500
_MARK = "\u0001"

_SCRIPT = r"<script\b[^>]*>.*?(?:</script\s*>|\z)"
_HIDDEN = rf"(?is)<!--.*?(?:-->|\z)|{_SCRIPT}|<style\b[^>]*>.*?(?:</style\s*>|\z)"
_NOSCRIPT = r"(?is)<noscript\b[^>]*>.*?</noscript\s*>"
# A quote that never closes ends with its tag.
_TAG_TAIL = r"""(?:[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+>|[^>]*>)"""
_ANY_TAG = rf"(?s)<[A-Za-z/!?]{_TAG_TAIL}"
_ATTRIBUTE = r"""(?s)([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""

#: Looked up first, because a map literal is searched from its start; all other names follow.
_COMMON = "amp lt gt quot apos nbsp copy middot ndash mdash lsquo rsquo ldquo rdquo hellip bull raquo laquo reg trade euro".split()
_NAMES = {n: html5[f"{n};"] for n in [*_COMMON, *sorted(k[:-1] for k in html5 if k.endswith(";") and k[:-1] not in _COMMON)]}
#: Names that need no semicolon, the longest first.
_BARE = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
_REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;)"
#: Codes 128 to 159 mean the characters of Windows-1252.
_C1 = {chr(b): bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}


def decode_entities(text: Column, attribute_value: bool = False) -> Column:
    """Decode named and numeric character references once; unknown ones stay.

    Some names need no semicolon; in an attribute value they then must not be followed by a letter, a digit or ``=``.
    """
    names = F.str_to_map(F.lit("\u0003".join(f"{k}\u0002{v}" for k, v in _NAMES.items())), F.lit("\u0003"), F.lit("\u0002"))
    bare = f"^(?:{_BARE})" + ("(?![=A-Za-z0-9])" if attribute_value else "")

    def of_code(code: Column) -> Column:
        bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(bad, F.lit("\ufffd")).otherwise(F.translate(char, "".join(_C1), "".join(_C1.values())))

    def from_digits(digits: Column, base: int) -> Column:
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        return let(F.when(F.length(short) <= 7, F.conv(short, base, 10).cast("long")), of_code)

    def replaced(p: Column, ref: Column) -> Column:
        name = F.rtrim(ref, F.lit(";"))
        char = (
            F.when(name.rlike("^#[xX]"), from_digits(F.substr(name, F.lit(3)), 16))
            .when(F.startswith(name, F.lit("#")), from_digits(F.substr(name, F.lit(2)), 10))
            .otherwise(F.try_element_at(names, name))
        )
        short = let(F.regexp_extract(p, bare, 0), lambda n: F.concat(F.try_element_at(names, n), F.substr(p, F.length(n) + 1)))
        return F.coalesce(F.concat(char, F.substr(p, F.length(ref) + 1)), short, F.concat(F.lit("&"), p))

    def piece(p: Column, i: Column) -> Column:
        return F.when(i == 0, p).otherwise(let(F.regexp_extract(p, _REFERENCE, 0), lambda ref: replaced(p, ref)))

    def decoded(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, "&(?=[A-Za-z#])", -1), piece), "")

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def visible_markup(html: Column) -> Column:
    """Markup without comments, scripts and style sheets."""
    return F.regexp_replace(html, _HIDDEN, _MARK)


def tags(markup: Column, name: str) -> Column:
    """Opening tags of one element, in document order."""
    return F.regexp_extract_all(markup, F.lit(rf"(?i)<{name}(?=[\s/>]){_TAG_TAIL}"), F.lit(0))


def attributes(tag: Column) -> Column:
    """array<struct<name, value>> of an opening tag; names lower-cased, values decoded."""
    body = F.regexp_replace(tag, r"^<[A-Za-z][^\s/>]*", "")

    def unquoted(raw: Column) -> Column:
        quoted = F.startswith(raw, F.lit('"')) | F.startswith(raw, F.lit("'"))
        return F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)

    def read(token: Column) -> Column:
        cut = F.instr(token, "=")
        value = F.when(cut == 0, F.lit("")).otherwise(let(strip(F.substr(token, cut + 1)), unquoted))
        name = F.when(cut == 0, token).otherwise(F.substring_index(token, "=", 1))
        return F.struct(
            F.lower(strip(name)).alias("name"), decode_entities(value, True).alias("value")
        )

    return F.transform(F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(0)), read)


def attribute(attrs: Column, name: str) -> Column:
    """Value of the first attribute of that name, or null."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def _wanted(tag_list: Column, names: list[str]) -> Column:
    """Tags -> array<struct<names...>>."""
    return F.transform(
        F.transform(tag_list, attributes),
        lambda a: F.struct(*[attribute(a, n).alias(n) for n in names]),
    )


def title(markup: Column) -> Column:
    """First title text, stripped; null without a title element, '' for an empty one."""
    raw = F.regexp_extract(markup, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)
    present = markup.rlike(r"(?i)<title[\s>]")
    return F.when(present, strip(decode_entities(raw)))


def language(markup: Column) -> Column:
    """lang attribute of the html element."""
    return let(tags(markup, "html"), lambda t: attribute(attributes(F.get(t, F.lit(0))), "lang"))


def meta_records(markup: Column) -> Column:
    """array<struct<property, name, content>> of the meta elements."""
    return _wanted(tags(markup, "meta"), ["property", "name", "content"])


def description(meta: Column) -> Column:
    """Content of the first description meta tag, else of the first og:description."""
    named = F.get(F.filter(meta, lambda m: F.lower(m["name"]) == "description"), F.lit(0))["content"]
    graph = F.get(F.filter(meta, lambda m: m["property"] == "og:description"), F.lit(0))["content"]
    return strip(F.coalesce(F.nullif(named, F.lit("")), F.nullif(graph, F.lit(""))))


def last_wins(entries: Column) -> Column:
    """map from array<struct<k, v>>; a later entry replaces an earlier one of the same key."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    newest_first = F.reverse(entries)
    values = F.transform(
        keys, lambda k: F.get(F.filter(newest_first, lambda e: e["k"] == k), F.lit(0))["v"]
    )
    return F.map_from_arrays(keys, values)


def _is_graph(m: Column) -> Column:
    return F.startswith(F.coalesce(m["property"], F.lit("")), F.lit("og:"))


def open_graph(meta: Column) -> Column:
    kept = F.filter(meta, lambda m: _is_graph(m) & (F.coalesce(m["content"], F.lit("")) != ""))
    return last_wins(
        F.transform(kept, lambda m: F.struct(m["property"].alias("k"), strip(m["content"]).alias("v")))
    )


def meta_tags(meta: Column) -> Column:
    kept = F.filter(
        meta,
        lambda m: ~_is_graph(m)
        & (F.coalesce(m["name"], F.lit("")) != "")
        & (F.coalesce(m["content"], F.lit("")) != ""),
    )
    return last_wins(
        F.transform(kept, lambda m: F.struct(m["name"].alias("k"), strip(m["content"]).alias("v")))
    )


def flat_metadata(graph: Column, plain: Column) -> Column:
    """Union of both maps; a plain meta tag replaces an open-graph entry of the same key."""
    return F.map_concat(F.map_filter(graph, lambda k, v: ~F.map_contains_key(plain, k)), plain)


def json_ld(html: Column) -> Column:
    """array<variant> of linked-data objects; unreadable blocks and non-objects are skipped."""
    blocks = F.filter(
        F.regexp_extract_all(html, F.lit(rf"(?is)<!--.*?(?:-->|\z)|{_SCRIPT}"), F.lit(0)),
        lambda b: F.regexp_extract(b, r"(?is)^<script\b[^>]*>", 0).rlike(
            r"""(?s)^<[^>]*\s[tT][yY][pP][eE]\s*=\s*["']?application/ld\+json["'\s>]"""
        ),
    )
    bodies = F.transform(blocks, lambda b: F.regexp_extract(b, r"(?is)^<script\b[^>]*>(.*)</script\s*>$", 1))
    values = F.transform(bodies, lambda t: F.try_parse_json(t))
    lists = F.transform(
        values,
        lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
    )
    return F.filter(F.flatten(lists), is_object)


def is_object(value: Column) -> Column:
    return value.isNotNull() & F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def variant_text(value: Column, path: str) -> Column:
    """Field of a variant if it is a string, else null."""
    field = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(value, path, "string"))


def schema_types(items: Column) -> Column:
    """@type of every linked-data object, in first-seen order."""
    return ordered_distinct(
        F.flatten(
            F.transform(
                items,
                lambda v: F.coalesce(
                    F.try_variant_get(v, "$['@type']", "array<string>"),
                    F.filter(F.array(variant_text(v, "$['@type']")), lambda t: t.isNotNull()),
                ),
            )
        )
    )


def anchor_hrefs(markup: Column) -> Column:
    """href values of the anchors, stripped, in document order."""
    hrefs = F.transform(F.transform(tags(markup, "a"), attributes), lambda a: attribute(a, "href"))
    return F.transform(F.filter(hrefs, lambda h: h.isNotNull()), strip)


def page_links(markup: Column, base: Column) -> Column:
    """Canonical http(s) links of a page, distinct, in first-seen order."""
    hrefs = F.filter(anchor_hrefs(markup), navigable)
    return web_only(ordered_distinct(normalize_urls(resolve_urls(base, hrefs))))


def rel_links(markup: Column, base: Column) -> Column:
    """array(next, prev): canonical targets of the first link element of each kind, or null."""
    def first(links: Column, rel: str) -> Column:
        hit = F.get(F.filter(links, lambda x: F.array_contains(F.split(x["rel"], r"\s+"), rel)), F.lit(0))
        return F.nullif(hit["href"], F.lit(""))

    def both(links: Column) -> Column:
        return normalize_urls(resolve_urls(base, F.array(first(links, "next"), first(links, "prev"))))

    return let(_wanted(tags(markup, "link"), ["rel", "href"]), both)


def page_numbers(markup: Column) -> Column:
    """Distinct numbers that are the whole text of an anchor, in ascending order; as digits, so of any size."""
    anchors = F.regexp_extract_all(
        markup, F.lit(rf"(?is)<a(?=\s[^>]*href){_TAG_TAIL}.*?</a\s*>"), F.lit(0)
    )
    text = F.transform(anchors, lambda a: F.regexp_replace(a, rf"{_ANY_TAG}|[{WS}{_MARK}]+", ""))
    digits = F.transform(F.filter(text, lambda t: t.rlike("^[0-9]+$")), lambda t: F.regexp_replace(t, "^0+(?=.)", ""))
    by_size = F.array_sort(F.array_distinct(F.transform(digits, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))))
    return F.transform(by_size, lambda d: d["t"])


def infinite_scroll(markup: Column) -> Column:
    """True if an element carries the data attribute or a class of that name."""
    return markup.rlike(
        r"""(?is)<[a-z][^>]*\s(?:data-infinite-scroll[\s=/>]"""
        r"""|class\s*=\s*(?:"[^"]*infinite[-_]?scroll|'[^']*infinite[-_]?scroll|[^\s"'>]*infinite[-_]?scroll))"""
    )


def text_content(markup: Column) -> Column:
    """Whole visible text: every text node stripped, empty ones dropped, joined by one blank."""
    nodes = F.regexp_replace(F.regexp_replace(markup, _NOSCRIPT, _MARK), _ANY_TAG, _MARK)
    texts = F.transform(F.split(decode_entities(nodes), _MARK, -1), strip)
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


def snippet(markup: Column) -> Column:
    """First 500 characters of the visible text, null if there is none."""
    return F.nullif(F.substring(text_content(markup), 1, SNIPPET_CHARS), F.lit(""))
