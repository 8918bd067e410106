"""URL canonicalisation, resolution and domain tests as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe.functions.lang import let, record, reusable, strip

# RFC 3986 appendix B, with the scheme limited to its legal characters.
_RFC3986 = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_SEP = "\u0001"

# Hrefs that never lead to another document.
NON_NAVIGATIONAL = ["#", "javascript:", "mailto:", "tel:"]


def _parts(url: Column) -> Column:
    """array(scheme, netloc, path, query) from one regex pass."""
    return F.split(
        F.regexp_replace(url, _RFC3986, f"$1{_SEP}$2{_SEP}$3{_SEP}$4"), _SEP, -1
    )


def _tidy(url: Column) -> Column:
    return F.translate(strip(url), "\t\r\n" + _SEP, "")


def _without_params(path: Column) -> Column:
    return F.regexp_replace(path, r";[^/]*$", "")


def _decode(piece: Column) -> Column:
    """Form-decode; a '%' that starts no valid escape stays as it is."""
    safe = F.regexp_replace(piece, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), F.translate(piece, "+", " "))


def _encode(text: Column) -> Column:
    """Form-encode, keeping '~' and escaping '*'."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pair(piece: Column) -> Column:
    """struct(k, v) of one query piece; the value of a bare key is empty."""
    both = F.concat(piece, F.lit("="))
    key = F.substring_index(both, "=", 1)
    value = F.substr(both, F.length(key) + 2, F.length(both) - F.length(key) - 2)
    return record(k=_decode(key), v=_decode(value))


def canonical_query(query: Column) -> Column:
    """Sort query pairs by (key, value) and re-encode them; blank values are kept."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    encoded = F.transform(
        F.array_sort(F.transform(pieces, _pair)),
        lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])),
    )
    return F.array_join(encoded, "&")


def _with_query(query: Column) -> Column:
    """'?query', or nothing for an empty query."""
    return F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))


def _reparse(url: Column, parts: Column) -> Column:
    """Give an input without an authority the default scheme and read it again."""
    bare = (parts[1] == "") & (parts[2] != "")
    return F.when(bare, _parts(F.concat(F.lit("http://"), url))).otherwise(parts)


def _fields(parts: Column) -> Column:
    return record(
        scheme=F.when(parts[0] == "", F.lit("http")).otherwise(F.lower(parts[0])),
        netloc=F.lower(parts[1]),
        path=_without_params(parts[2]),
        query=F.when(parts[3] == "", F.lit("")).otherwise(canonical_query(parts[3])),
    )


def _assemble(x: Column) -> Column:
    """Canonical URL from its fields: no default port, no trailing slash but for the root."""
    netloc = (
        F.when(x["scheme"] == "http", F.regexp_replace(x["netloc"], r":0*80$", ""))
        .when(x["scheme"] == "https", F.regexp_replace(x["netloc"], r":0*443$", ""))
        .otherwise(x["netloc"])
    )
    path = F.when(x["path"] == "/", x["path"]).otherwise(F.rtrim(x["path"], F.lit("/")))
    return F.concat(x["scheme"], F.lit("://"), netloc, path, _with_query(x["query"]))


def _normalize_all(urls: Column) -> Column:
    """Normalise every element; each stage of the work is evaluated once per element."""
    staged = F.transform(F.transform(urls, _tidy), lambda u: record(u=u, p=_parts(u)))
    read = F.transform(staged, lambda s: _reparse(s["u"], s["p"]))
    return F.transform(F.transform(read, _fields), _assemble)


def normalize_urls(urls: Column) -> Column:
    """array<string> -> array<string> of canonical URLs, order kept."""
    return _normalize_all(urls)


@reusable
def _normalize_named(url: str) -> Column:
    return F.element_at(_normalize_all(F.array(F.col(url))), 1)


def normalize_url(url: Column | str) -> Column:
    """Canonical form of one URL column."""
    if isinstance(url, str):
        return _normalize_named(url)
    return F.element_at(_normalize_all(F.array(url)), 1)


def url_key(canonical: Column) -> Column:
    """Hex SHA-256 of a canonical URL."""
    return F.sha2(canonical, 256)


def netloc_of(url: Column) -> Column:
    """Authority (host, port, user-info) of an absolute URL."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def site_of(url: Column) -> Column:
    """scheme://authority of an absolute URL."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def domain_of(canonical: Column) -> Column:
    """Host of a canonical URL: no user-info, no port, sub-domains kept."""
    return F.regexp_extract(canonical, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def domain_allowed(host: Column, allowed: Column) -> Column:
    """True if the host equals an allowed domain or is below one (array form)."""
    return F.exists(allowed, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def host_suffixes(host: Column) -> Column:
    """Every dot suffix of a host, itself included: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def keep_allowed(links: Column, allowed: Column) -> Column:
    """Links whose host passes the allow-list, order kept."""
    return F.filter(links, lambda u: domain_allowed(domain_of(u), allowed))


def navigable(href: Column) -> Column:
    """False for empty hrefs, fragments and script, mail or phone links."""
    ok = href != ""
    for prefix in NON_NAVIGATIONAL:
        ok = ok & ~F.startswith(href, F.lit(prefix))
    return ok


def web_only(links: Column) -> Column:
    """Keep http and https links."""
    return F.filter(links, lambda u: u.rlike(r"^https?://"))


def _fold_dots(segments: Column) -> Column:
    """Fold '.' and '..' out of path segments."""
    return F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(seg))),
    )


def _directory(path: Column) -> Column:
    """Path segments up to the last slash."""
    return F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/", -1)


def _squeeze(segments: Column) -> Column:
    """Drop empty segments between the first and the last one."""
    return F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == F.size(segments) - 1))


def _reference(h: Column, b: Column) -> Column:
    """Fields of a reference: its parts, its path without parameters, and the merged segments."""
    return let(
        _parts(h),
        lambda p: let(
            _without_params(p[2]),
            lambda path: record(
                text=h,
                p=p,
                path=path,
                segments=F.when(F.startswith(path, F.lit("/")), F.split(path, "/", -1))
                .otherwise(let(F.concat(b["dir"], F.split(path, "/", -1)), _squeeze)),
            ),
        ),
    )


def _resolved(r: Column, b: Column) -> Column:
    """Absolute URL of a reference against the fields of its base."""
    p, path = r["p"], r["path"]
    last = F.element_at(r["segments"], -1)
    folded = F.concat(
        _fold_dots(r["segments"]),
        F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
    )
    merged = F.concat(F.lit("/"), F.regexp_replace(F.array_join(folded, "/"), "^/", ""))
    same_page = F.concat(b["root"], b["path"], F.when(p[3] == "", b["query"]).otherwise(_with_query(p[3])))
    return (
        F.when((p[0] != "") & (F.lower(p[0]) != b["scheme"]), r["text"])
        .when(p[1] != "", F.concat(b["scheme"], F.lit("://"), p[1], p[2], _with_query(p[3])))
        .when(p[2] == "", same_page)
        .otherwise(F.concat(b["root"], merged, F.substr(p[2], F.length(path) + 1), _with_query(p[3])))
    )


def resolve_urls(base: Column, hrefs: Column) -> Column:
    """Resolve an array of references against a base URL (RFC 3986); fragments are dropped."""
    def base_fields(p: Column) -> Column:
        return record(
            scheme=F.lower(p[0]),
            root=F.concat(p[0], F.lit("://"), p[1]),
            path=p[2],
            query=_with_query(p[3]),
            dir=_directory(_without_params(p[2])),
        )

    def all_refs(b: Column) -> Column:
        refs = F.transform(F.transform(hrefs, _tidy), lambda h: _reference(h, b))
        return F.transform(refs, lambda r: _resolved(r, b))

    return let(let(_parts(_tidy(base)), base_fields), all_refs)


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve one reference against a base URL."""
    return F.element_at(resolve_urls(base, F.array(href)), 1)


def robots_url(url: Column) -> Column:
    return F.concat(site_of(url), F.lit("/robots.txt"))


def sitemap_url(url: Column) -> Column:
    return F.concat(site_of(url), F.lit("/sitemap.xml"))
