"""Text of one HTML element, as column expressions."""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named character references, as the standard library lists them.
NAMES = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}


# The rest of a tag, and a whole tag; a ``>`` inside a quoted value does not end it. Groups are repeated possessively:
# Java matches those in a loop, while other repeated groups recurse and overflow the stack on long input.
TAG_REST = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
TAG = rf"<(?=[a-zA-Z/!?]){TAG_REST}"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_hidden(html: Column) -> Column:
    """Comments, scripts and styles removed: their content is neither markup nor text."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", "")


def _open_tag(tag: str, attr: str, value: str) -> str:
    v = re.escape(value)
    if attr.lower() == "class":  # one of the space-separated names, or the whole list
        quoted = rf"\"(?:[^\"]*\s)?{v}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{v}(?:\s[^']*)?'"
    else:
        quoted = rf"\"{v}\"|'{v}'"
    name = rf"(?i:{re.escape(attr)})\s*="
    # attributes of other names are skipped as a whole, so a match inside a quoted value does not count
    skipped = rf"(?:[\s/]+(?!{name})[^\s=>\"'/]++(?:\s*=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+)*+"
    return rf"<(?i:{re.escape(tag)}){skipped}[\s/]+{name}\s*(?:{quoted}|{v}(?=[\s>/])){TAG_REST}"


def decode_entities(text: Column) -> Column:
    """Character references decoded, each once: all named ones that end in a semicolon, and numbers of any length. What
    is no character (zero, half a surrogate pair, beyond Unicode) becomes U+FFFD; anything else stays."""
    names = F.from_json(F.lit(json.dumps(NAMES)), "map<string,string>")  # folded into one literal
    reference = r"(?s)^(?:#0*+([0-9]*+)|#[xX]0*+([0-9a-fA-F]*+)|([a-zA-Z][a-zA-Z0-9]*+));.*$"

    def part(piece: Column, group: int) -> Column:
        return F.regexp_extract(piece, reference, group)

    def char(code: Column) -> Column:
        scalar = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        # kept in range, as the other branch may be evaluated too
        fine = F.when(scalar, code).otherwise(F.lit(0xFFFD))
        return F.decode(F.unhex(F.lpad(F.hex(fine.cast("bigint")), 8, "0")), "UTF-32")

    def decoded(piece: Column) -> Column:
        hexed = F.when(F.length(part(piece, 2)) <= 6, F.conv(part(piece, 2), 16, 10).try_cast("bigint"))
        code = F.coalesce(part(piece, 1).try_cast("bigint"), hexed, F.lit(0))
        new = F.when(piece.rlike("^#([0-9]+|[xX][0-9a-fA-F]+);"), char(code)).otherwise(
            F.try_element_at(names, part(piece, 3))
        )
        rest = F.regexp_replace(piece, r"^[^;]*+;", "")
        return F.coalesce(F.concat(new, rest), F.concat(F.lit("&"), piece))

    def joined(parts: Column) -> Column:
        later = F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded)
        return F.concat(F.element_at(parts, 1), F.array_join(later, ""))

    return _let(text, lambda t: F.when(F.contains(t, F.lit("&")), _let(F.split(t, "&"), joined)).otherwise(t))


def element_text(html: Column | str, tag: str, attr: str, value: str) -> Column:
    """Text of the first ``tag`` element whose ``attr`` is ``value``, with the text of everything inside it.

    Null when there is no such element, ``''`` when it is empty.
    """
    html = F.col(html) if isinstance(html, str) else html
    name = re.escape(tag)
    # every piece but a leading text starts with an opening or closing tag of the same name
    boundary = rf"(?i)(?=<{name}[\s/>])|(?=</{name}\s*>)"

    def change(piece: Column) -> Column:
        opens = piece.rlike(rf"(?i)^<{name}[\s>]") & ~piece.rlike(rf"^{TAG[:-1]}(?<=/)>")
        return F.when(opens, 1).when(piece.rlike(rf"(?i)^</{name}\s*>"), -1).otherwise(0)

    def step(acc: Column, by: Column) -> Column:
        depth, seen = acc["depth"] + by, acc["seen"] + 1
        stop = F.when((acc["stop"] == 0) & (depth == 0), seen).otherwise(acc["stop"])
        return F.struct(depth.alias("depth"), seen.alias("seen"), stop.alias("stop"))

    def up_to_close(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("stop"))
        closing = F.aggregate(F.transform(pieces, change), start, step, lambda acc: acc["stop"])
        # no closing tag: all that follows belongs to the element
        length = _let(closing, lambda stop: F.when(stop == 0, F.size(pieces)).otherwise(stop - 1))
        return F.array_join(F.slice(pieces, F.lit(1), length), "")

    def text_of(found: Column) -> Column:
        inner = _let(F.split(found, boundary), up_to_close)
        return F.when(found != "", decode_entities(F.regexp_replace(inner, TAG, "")))

    # from the opening tag to the end of the page
    return _let(F.regexp_extract(without_hidden(html), rf"(?s){_open_tag(tag, attr, value)}.*", 0), text_of)
