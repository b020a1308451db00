"""URL parts, normal form and the documentation-page filter, as Column expressions.

``parse_url`` is not used: it returns NULL for spaces, ``|`` and ``%zz`` and it keeps
``;params``. The splitting rules here are those of Python's ``urllib.parse.urlparse``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions import let

# A URL with one of these extensions is a file, not a page.
ASSET_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "svg", "webp",
    "css", "js", "ico", "map",
    "pdf", "zip", "tar", "gz", "7z", "rar",
    "mp4", "mp3", "wav", "avi", "mov",
    "woff", "woff2", "ttf", "eot",
]

# A URL that contains one of these is not documentation.
BLOCKED_KEYWORDS = [
    "pricing", "plans", "enterprise", "customers", "case-study",
    "about", "company", "team", "careers", "jobs", "hiring",
    "security", "legal", "privacy", "terms", "gdpr",
    "blog", "newsletter", "community", "event", "events",
    "news", "press", "updates", "release-notes", "releases",
    "changelog", "roadmap",
    "store", "shop", "buy", "subscribe", "credits",
    "contact", "support", "help-center", "faq",
    "github.com", "gitlab.com", "bitbucket.org",
    "login", "logout", "signin", "signup", "register", "auth",
    "utm_", "ref=", "source=",
    "print-pdf", "pdf-version", "download",
]

# Schemes whose last path segment may carry ``;params``.
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu",
    "sip", "sips", "mms", "sftp", "tel",
]

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"#(.*)$"
_PARAMS = r";[^/]*$"
_BRACKET_HOST = r"^(?:[^\[\]]*@)?\[[0-9a-fA-F:.%]+\](?::[0-9]*)?$"


def tidy(url: Column) -> Column:
    """Drop leading controls and blanks, and tabs and line ends anywhere."""
    return F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _NETLOC, 1)


def full_path(url: Column) -> Column:
    """The path with its ``;params``."""
    return F.regexp_extract(url, _PATH, 1)


def path(url: Column) -> Column:
    whole = full_path(url)
    has_params = whole.contains(";") & scheme(url).isin(PARAM_SCHEMES)
    return F.when(has_params, F.regexp_replace(whole, _PARAMS, "")).otherwise(whole)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, _FRAGMENT, 1)


def is_malformed(url: Column) -> Column:
    """True for a host with stray or bad brackets, which a URL parser refuses."""
    host = netloc(url)
    return (host.contains("[") | host.contains("]")) & ~host.rlike(_BRACKET_HOST)


def parts(url: Column) -> Column:
    """All five parts as one struct."""
    return let(
        tidy(url),
        lambda u: F.struct(
            scheme(u).alias("scheme"),
            netloc(u).alias("netloc"),
            path(u).alias("path"),
            query(u).alias("query"),
            fragment(u).alias("fragment"),
        ),
    )


def normalize(url: Column) -> Column:
    """``scheme://netloc/path?query``; fragment, ``;params`` and an empty query go."""

    def build(u):
        q = query(u)
        return F.concat(
            scheme(u), F.lit("://"), netloc(u), path(u),
            F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")),
        )

    return let(tidy(url), build)


def same_domain(normalized: Column, base_netloc: Column) -> Column:
    """Host equals the base host exactly, or the normal form has no host at all."""
    host = netloc(normalized)
    return (host == "") | (host == base_netloc)


def allowed_netloc(base: Column) -> Column:
    """Host of the base URL, or the string itself when it is a bare host name."""
    host = F.lower(netloc(base))
    return F.when(host != "", host).otherwise(F.lower(base))


def allowed_host(url: Column, base: Column) -> Column:
    host = F.lower(netloc(url))
    allowed = allowed_netloc(base)
    return (host == allowed) | (host == F.concat(F.lit("www."), allowed))


def non_root_path(url: Column) -> Column:
    return ~path(url).isin("", "/")


def is_asset(url: Column, extensions: list[str] = ASSET_EXTENSIONS) -> Column:
    return F.lower(path(url)).rlike(r"\.(?:" + "|".join(extensions) + r")\z")


def has_blocked_keyword(url: Column, keywords: list[str] = BLOCKED_KEYWORDS) -> Column:
    """Plain substring test on the whole lower-cased URL."""
    return let(F.lower(url), lambda u: reduce(or_, [u.contains(word) for word in keywords]))


def page_like(url: Column, extensions: list[str] = ASSET_EXTENSIONS,
              keywords: list[str] = BLOCKED_KEYWORDS) -> Column:
    """The part of the filter that does not depend on the site."""
    return (
        ~is_malformed(url)
        & non_root_path(url)
        & ~is_asset(url, extensions)
        & ~has_blocked_keyword(url, keywords)
    )


def relevant_docs_url(url: Column, base: Column, extensions: list[str] = ASSET_EXTENSIONS,
                      keywords: list[str] = BLOCKED_KEYWORDS) -> Column:
    return F.coalesce(
        allowed_host(url, base) & page_like(url, extensions, keywords), F.lit(False)
    )


def lint_suggestion(url: Column) -> Column:
    """Root URL to use instead of one that looks like a single page; NULL when fine."""
    looks_specific = (query(url) != "") | (F.size(F.split(path(url), "/")) > 3)
    return F.when(looks_specific, F.concat(scheme(url), F.lit("://"), netloc(url), F.lit("/docs")))


def collection_name(url: Column) -> Column:
    return F.md5(url.cast("binary"))


def resolve(href: Column, page_url: Column) -> Column:
    """Absolute form of an ``href`` found on ``page_url``, as a browser reports it.

    Hosts are lower-cased and default ports dropped; path characters stay as written.
    """

    def absolute(h, page):
        root = F.concat(scheme(page), F.lit("://"), netloc(page))
        here = full_path(page)
        folder = F.regexp_replace(here, r"[^/]*$", "")
        folder = F.when(folder == "", F.lit("/")).otherwise(folder)
        page_query = query(page)
        search = F.when(page_query != "", F.concat(F.lit("?"), page_query)).otherwise(F.lit(""))
        return (
            F.when(h.rlike(_SCHEME), h)
            .when(h.startswith("//"), F.concat(scheme(page), F.lit(":"), h))
            .when(h.startswith("/"), F.concat(root, h))
            .when(h.startswith("?"), F.concat(root, here, h))
            .when(h.startswith("#"), F.concat(root, here, search, h))
            .otherwise(F.concat(root, folder, h))
        )

    return let(
        tidy(F.rtrim(href)),
        lambda h: let(tidy(page_url), lambda page: let(absolute(h, page), _canonical)),
    )


def _canonical(url: Column) -> Column:
    proto = scheme(url)
    host = netloc(url)
    user = F.regexp_extract(host, r"^(.*@)", 1)
    bare = F.lower(F.regexp_extract(host, r"^(?:.*@)?(.*)$", 1))
    bare = (
        F.when(proto == "http", F.regexp_replace(bare, ":(?:80)?$", ""))
        .otherwise(F.regexp_replace(bare, ":(?:443)?$", ""))
    )
    where = full_path(url)
    where = (
        F.when(where == "", F.lit("/"))
        .when(where.contains("/."), _fold_dots(where))
        .otherwise(where)
    )
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    return F.when(
        proto.isin("http", "https") & (host != ""),
        F.concat(proto, F.lit("://"), user, bare, where, rest),
    ).otherwise(url)


def _fold_dots(whole: Column) -> Column:
    """Remove ``.`` and ``..`` segments; ``..`` at the root stays at the root."""
    segments = F.split(F.substring(whole, 2, 1 << 30), "/")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, segment: F.when(
            segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        )
        .when(segment == ".", kept)
        .otherwise(F.concat(kept, F.array(segment))),
    )
    ends_open = F.element_at(segments, -1).isin(".", "..")
    closed = F.when(ends_open, F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.concat(F.lit("/"), F.array_join(closed, "/"))
