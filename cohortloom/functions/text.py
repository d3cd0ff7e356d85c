"""Note text as column expressions: templates, HTML, de-identification, line reassembly."""

from __future__ import annotations

import json
from collections.abc import Mapping
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def render_template(template: Column, values: Mapping[str, Column], defaults: Mapping[str, str] | None = None) -> Column:
    """Replace {key} in a template by the row's value or else the caller's default; other keys stay as they are."""
    defaults, text = defaults or {}, template
    for key in {**defaults, **values}:
        shown = F.lit(defaults.get(key, "{" + key + "}"))
        text = F.replace(text, F.lit("{" + key + "}"), F.coalesce(values[key].cast("string"), shown) if key in values else shown)
    return text


_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# Numbers 128 to 159 stand for the characters of Windows' Western code page, as browsers read them.
_WESTERN = {n: text for n in range(128, 160) if (text := bytes([n]).decode("cp1252", "ignore"))}


def _entity_names() -> Column:
    """All named entities of HTML 5 as a map of maps: first letter, name, text."""
    names: dict[str, dict[str, str]] = {}
    for name, shown in html5.items():
        if name.endswith(";"):
            names.setdefault(name[0], {})[name[:-1]] = shown
    return F.from_json(F.lit(json.dumps(names)), "map<string,map<string,string>>")


def _decoded(name: Column, names: Column) -> Column:
    """Text of one entity, given without & and ;."""
    digits = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7))
    number = digits.try_cast("int")
    western = F.try_element_at(F.create_map(*[F.lit(v) for pair in _WESTERN.items() for v in pair]), number)
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    letter = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")
    named = F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)
    return F.when(F.startswith(name, F.lit("#")), F.coalesce(western, letter)).otherwise(F.coalesce(named, F.concat(F.lit("&"), name, F.lit(";"))))


def decode_entities(text: Column) -> Column:
    """Text with each named (HTML 5) or numeric entity replaced by its characters, in one pass: what an entity gives isn't decoded again.

    Unknown names stay; numbers that are no character become U+FFFD. An entity must end in a semicolon.
    """
    names = _entity_names()
    found = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1)), lambda name: _decoded(name, names))
    parts = F.zip_with(F.split(text, _ENTITY, -1), found, lambda before, shown: F.concat(before, F.coalesce(shown, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


# Order matters: whole blocks go first, then breaks, then any other tag; entities and spaces follow.
_HTML_STEPS = (
    (r"(?is)<!--.*?-->", " "),
    (r"(?is)<script\b.*?</script\s*>", " "),
    (r"(?is)<style\b.*?</style\s*>", " "),
    (r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n"),
    (r"(?s)<[^>]*>", " "),
)
_SPACE_STEPS = ((r"[ \t\r\x{a0}]+", " "), (r" ?\n[ \n]*", "\n"))


def html_to_text(html: Column) -> Column:
    """Plain text of HTML: comments, scripts, styles and tags out, blocks on lines of their own, entities decoded, white space merged."""
    text = html
    for pattern, replacement in _HTML_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    text = decode_entities(text)
    for pattern, replacement in _SPACE_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))


# Identifiers in free text, in the order they are replaced.
IDENTIFIERS = (
    ("url", r"https?://[^\s<>]+"),
    # A host name has at most 127 labels.
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,126}"),
    ("phone", r"(?:\+\d{1,3} ?)?\(?\b\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b"),
    ("id", r"\b(?:MRN-)?\d{6,}\b"),
)
# A text without this cannot hold the identifier, so the pattern is not run over it.
_NEEDS = {"url": "://", "email": "@", "phone": "[0-9]{3}[ .-][0-9]{4}", "id": "[0-9]{6}"}


def deidentify(text: Column) -> tuple[Column, dict[str, Column]]:
    """The text with identifiers replaced by [KIND], and the number of replacements per kind."""
    counts: dict[str, Column] = {}
    for kind, pattern in IDENTIFIERS:
        needed = F.lit(_NEEDS[kind])
        possible = F.contains(text, needed) if kind in ("url", "email") else F.regexp_like(text, needed)
        counts[kind] = F.when(possible, F.regexp_count(text, F.lit(pattern))).when(text.isNotNull(), 0)
        text = F.when(possible, F.regexp_replace(text, pattern, f"[{kind.upper()}]")).otherwise(text)
    return text, counts


def reassemble_lines(lines: DataFrame, keys: list[str], line: str, text: str, separator: str = "\n") -> DataFrame:
    """Line-wrapped child rows back to one text per key, joined in line order.

    One group is one text that ends up in one row, so its size is that of the text itself.
    """
    return lines.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(line, text))), lambda row: row[text]), separator
        ).alias(text)
    )
