"""Several values packed in one field: one row per value, with its position in the cell."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs that separate values unless they are protected.
SEPARATORS = ",;|/>\t\n\r·•、，；"
#: Cells that say "nothing".
STAND_INS = ["", "-", "--", "n/a", "na", "none", "null", "nil", "nan", "[]", "{}", "()"]
#: Entities that stand for signs with a part in packing; they are read first and as plain signs.
ENTITIES = {"&gt;": ">", "&lt;": "<", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#34;": '"', "&nbsp;": " ", "&amp;": "&"}

_ESCAPABLE = SEPARATORS + "\"'\\[]{}<&"
_HIDE = "".join(chr(0xE100 + i) for i in range(len(_ESCAPABLE)))  # private-use stand-ins of protected signs
_QUOTE = "\ue020"  # the one sign every protecting quote is turned into
_SEP_CLASS = "[,;|/>\\t\\n\\r·•、，；]"


def _char(hex_digits: Column) -> Column:
    """The character with a code point given in 1 to 6 hex digits, null where there is none."""
    code = F.conv(hex_digits, 16, 10).cast("long")
    real = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(real, F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32"))


def _rewritten(c: Column, mark: str, opening: str, rewrite) -> Column:
    """``c`` with every piece that follows ``opening`` (a pattern; ``mark`` is its plain start) rewritten."""
    parts = F.split(c, opening, -1)
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), rewrite)
    return F.when(c.contains(mark), F.concat(parts[0], F.array_join(rest, ""))).otherwise(c)


def _decode_unicode_escapes(c: Column) -> Column:
    return _rewritten(c, "\\u", r"\\u(?=[0-9a-fA-F]{4})", lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, 4)), "UTF-16BE"), F.substring(p, 5, 1 << 30)))


def _decode_entities(c: Column) -> Column:
    """Numeric and HTML 4 entities as characters; one that stands for a separator protects it."""
    hide = lambda ch: F.translate(ch, SEPARATORS, "".join(_HIDE[_ESCAPABLE.index(s)] for s in SEPARATORS))
    tail = lambda p: F.regexp_replace(p, r"^[^;]*;", "")
    number = lambda p: F.regexp_extract(p, r"^[xX]?0*([0-9a-fA-F]+);", 1)
    of_number = lambda p: F.coalesce(F.concat(hide(_char(F.when(F.lower(F.substring(p, 1, 1)) == "x", number(p)).otherwise(F.conv(number(p), 10, 16)))), tail(p)), F.concat(F.lit("&#"), p))
    c = _rewritten(c, "&#", r"&#(?=(?:0*[0-9]{1,7}|[xX]0*[0-9a-fA-F]{1,6});)", of_number)
    names = F.create_map(*[F.lit(x) for n, k in name2codepoint.items() for x in (n, chr(k))])
    of_name = lambda p: F.coalesce(F.concat(hide(names[F.substring_index(p, ";", 1)]), tail(p)), F.concat(F.lit("&"), p))
    return _rewritten(c, "&", r"&(?=[A-Za-z][A-Za-z0-9]{1,7};)", of_name)


def packed_values(cell: Column) -> Column:
    """ARRAY<STRING> of the values in a cell, in order, as meant.

    Protection is made uniform first: backslash escapes and doubled quotes become private-use
    signs, and every value wrapped in double, single or typographic quotes gets one common quote sign. The
    cell is then split on that sign: odd pieces are literals whose separators are hidden, even
    pieces are plain text. Folding the pieces together and splitting on the separators gives the
    values; hidden signs come back, blanks are folded, letters lower-cased, empty values dropped.
    An apostrophe inside a word is no quote. Null, blank and stand-in cells give an empty array.
    """
    s = F.trim(F.translate(cell, "\u00a0\u3000\u2007\u202f", "    "))
    nothing = cell.isNull() | F.lower(s).isin(STAND_INS)
    for name, sign in ENTITIES.items():
        s = F.replace(s, F.lit(name), F.lit(sign))
    s = _decode_entities(_decode_unicode_escapes(s))
    for sign, hidden in zip(_ESCAPABLE, _HIDE, strict=True):
        if sign not in "\t\n\r":
            s = F.replace(s, F.lit("\\" + sign), F.lit(hidden))
    s = F.regexp_replace(s, r"(?s)^\s*(?:\[(.*)\]|\{(.*)\})\s*$", "$1$2")
    # "" alone is an empty value, elsewhere a doubled quote is a quote inside a quoted value
    s = F.regexp_replace(s, rf'(^|{_SEP_CLASS})\s*""\s*(?=$|{_SEP_CLASS})', "$1")
    s = F.replace(s, F.lit('""'), F.lit(_HIDE[_ESCAPABLE.index('"')]))
    s = F.regexp_replace(
        s,
        # possessive throughout: nothing is tried twice and a cell of any length needs no stack
        rf"""(^|{_SEP_CLASS})(\s*)(?:"([^"]*+)"|'([^']*+(?:'(?=\w)[^']*+)*+)'|“([^“”]*+)”|„([^„“”]*+)[“”]|«([^«»]*+)»|「([^「」]*+)」)(?=\s*(?:$|{_SEP_CLASS}))""",
        f"$1$2{_QUOTE}$3$4$5$6$7$8{_QUOTE}",
    )
    pieces = F.transform(
        F.split(s, _QUOTE, -1), lambda p, i: F.when(i % 2 == 1, F.translate(p, _ESCAPABLE, _HIDE)).otherwise(p)
    )
    values = F.transform(
        F.split(F.array_join(pieces, ""), _SEP_CLASS, -1),
        lambda v: F.lower(F.trim(F.regexp_replace(F.translate(v, _HIDE, _ESCAPABLE), r"[\s\u00a0\u3000]+", " "))),
    )
    return F.when(nothing, F.array().cast("array<string>")).otherwise(F.filter(values, lambda v: v != ""))


def unpack_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field_name, value_no, item_value)``: one row per value held in a cell of ``fields``.

    ``value_no`` counts from 1 over the non-empty values of a cell; repeated values stay. Rows of
    the same key are unpacked one by one. Nothing is shuffled; very long cells are handled whole.
    Array columns are taken as already split. An empty table yields no row.
    """
    types = dict(df.dtypes)

    def values(f: str) -> Column:
        if types[f].startswith("array"):
            clean = F.transform(F.col(f).cast("array<string>"), lambda v: F.lower(F.trim(F.regexp_replace(v, r"\s+", " "))))
            return F.filter(clean, lambda v: v.isNotNull() & (v != ""))
        return packed_values(F.col(f).cast("string"))

    cells = F.array(*[F.struct(F.lit(f).alias("f"), values(f).alias("v")) for f in fields])
    rows = df.select(F.col(key).alias("_k"), F.explode(cells).alias("_c"))
    return rows.select("_k", F.col("_c.f").alias("field_name"), F.posexplode("_c.v").alias("_p", "item_value")).select(
        F.col("_k").alias(key), "field_name", (F.col("_p") + 1).cast("int").alias("value_no"), "item_value"
    )
