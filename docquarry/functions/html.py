"""Links and visible text of stored HTML, as Column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions import let
from docquarry.functions.text import clean_text

# Elements that start a new line when a page is displayed.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h[1-6]", "header", "hr", "li", "main", "nav",
    "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]

# Named characters; the ampersand comes last.
ENTITIES = [
    ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&nbsp;", " "),
    ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
]

# Elements whose content is no markup or is not displayed.
UNSEEN_TAGS = ["script", "style", "noscript", "template", "title", "textarea", "iframe"]

# Markup is read from left to right, one token at a time, as a browser's tokeniser does: what looks like a tag inside a
# comment, a script or a quoted attribute belongs to that token. Every repetition is possessive, so that a page of
# any length needs neither backtracking nor a deep stack. The parts below begin behind the "<" that they share.
_END_OF_NAME = r"(?=[\s/>])"
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)"
_ATTRIBUTE = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+"
_ATTRIBUTES = rf"(?:[\s/]++|{_ATTRIBUTE})*+"

# A comment or an element without visible text; one cut off by the end of the page runs to the end.
_SKIPPED = "|".join(
    [r"!--(?:-?>|.*?(?:--!?>|\z))"]
    + [rf"{tag}{_END_OF_NAME}{_ATTRIBUTES}>.*?(?:</{tag}{_END_OF_NAME}[^>]*+>|\z)" for tag in UNSEEN_TAGS]
)
_HEAD = rf"head{_END_OF_NAME}{_ATTRIBUTES}>(?:[^<]++|<(?:{_SKIPPED})|(?!</head{_END_OF_NAME})<)*+</head\s*+>"
_DECLARATION = r"[!?][^>]*+>|/(?![a-z])[^>]*+>"
_TAG = rf"/?[a-z][^\s/>]*+{_ATTRIBUTES}>"

# Tokens of a page: what is not displayed, tags, and the text between them.
_TOKEN = rf"(?is)[^<]++|<(?:{_SKIPPED}|{_HEAD}|{_DECLARATION}|{_TAG})|<"
_NO_TEXT = r"(?is)^<(?:!--|(?:" + "|".join(["head", *UNSEEN_TAGS]) + rf"){_END_OF_NAME})"
_BLOCK = r"(?i)^</?(?:" + "|".join(BLOCK_TAGS) + rf"){_END_OF_NAME}"
_MARKUP = r"(?is)^(?:</?[a-z].*|<[!?].*|</.*)>\z"

# The same walk for the first ``href`` of every element of one kind, quotes included: a group holds it, and is empty for all
# else. Tags without attributes have nothing to skip.
_HREF_NAME = r"href(?=[\s=/>])"


def _href_of(tag: str) -> str:
    before = rf"(?:[\s/]++|(?!{_HREF_NAME}){_ATTRIBUTE})*+"
    own = rf"{tag}(?=[\s/]){before}href\s*+=\s*+({_VALUE}){_ATTRIBUTES}>"
    return rf"(?is)<(?:{own}|{_SKIPPED}|[a-z][^\s/>]*+[\s/]{_ATTRIBUTES}>)"


_ANCHOR, _BASE = _href_of("a"), _href_of("base")


# All named characters of HTML 4, with those above as they are.
_NAMED = {
    **{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'",
    **{name[1:-1]: character for name, character in ENTITIES},
}
_ENTITY = r"^&(#[xX]?[0-9a-fA-F]{1,7}|[a-zA-Z][a-zA-Z0-9]{1,30});"


def _entity(body: Column) -> Column:
    """The character of ``#39``, ``#x27`` or ``quot``; NULL if there is none."""
    hexadecimal = F.lower(F.substring(body, 1, 2)) == "#x"
    digits = F.when(hexadecimal, F.conv(F.substring(body, 3, 8), 16, 10)).otherwise(F.substring(body, 2, 8))
    code = digits.try_cast("int")
    real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    table = F.create_map(*[F.lit(part) for pair in _NAMED.items() for part in pair])
    return F.when(
        body.startswith("#"), F.when(real, F.format_string("%c", code))
    ).otherwise(F.try_element_at(table, body))


def decode_entities(text: Column) -> Column:
    """Numeric and named character references, each decoded once; unknown ones stay."""
    def part(piece):
        return let(
            F.regexp_extract(piece, _ENTITY, 1),
            lambda body: F.coalesce(
                F.concat(_entity(body), F.substring(piece, F.length(body) + 3, F.length(piece))), piece
            ),
        )

    decoded = F.array_join(F.transform(F.split(text, "(?=&)"), part), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def _addresses(html: Column, pattern: str) -> Column:
    """Non-empty ``href`` values that ``pattern`` finds, decoded; of an element's repeated attributes the first counts."""
    found = F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda raw: raw != "")
    values = F.transform(found, lambda raw: decode_entities(F.regexp_replace(raw, "^[\"']|[\"']$", "")))
    return F.filter(values, lambda value: F.trim(value) != "")


def hrefs(html: Column) -> Column:
    """Non-empty ``href`` values of all ``a`` elements, in document order."""
    return _addresses(html, _ANCHOR)


def base_href(html: Column) -> Column:
    """``href`` of the first ``base`` element that has one, NULL if none has; few pages are scanned for it."""
    return F.when(html.rlike(r"(?i)<base[\s/]"), F.get(_addresses(html, _BASE), F.lit(0)))


def visible_text(html: Column) -> Column:
    """Text of the page body with runs of whitespace reduced to one space.

    Rendering is approximated: block elements, comments and elements without text separate words, other tags vanish, styles
    are not evaluated. A tag that the end of the page cuts off is text.
    """
    def seen(token):
        return (
            F.when(~token.startswith("<"), decode_entities(token))
            .when(token.rlike(_NO_TEXT) | token.rlike(_BLOCK), F.lit(" "))
            .when(token.rlike(_MARKUP), F.lit(""))
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))
    return clean_text(F.array_join(F.transform(tokens, seen), ""))
