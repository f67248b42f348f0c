"""Character, rounding and number rules shared by the other functions.

Call logs are produced and read by web clients, so rounding, string length,
word boundaries and white space follow the web-script rules, which differ from
the JVM's in the ways noted at each function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str

# ASCII word characters (Java's `\w`; its `\b` would be Unicode-aware), and the
# white space a web-script `\s` matches, as a pattern and as characters.
WORD = r"\w"
SPACE_CHARS = ("\t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000\ufeff")
SPACE = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, so that a lambda using it does not evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns (parsed JSON, say) that later steps use many times.

    A generator is a boundary for the optimizer: neither a pushed-down filter nor
    a merged projection can copy the expression, so it runs once per row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return (df.select("*", F.explode(F.array(row)).alias("_once"))
            .select(*df.columns, *[F.col(f"_once.{name}").alias(name) for name in columns]))


def js_round(x: ColumnLike, digits: int = 0) -> Column:
    """Round half toward plus infinity (Spark's ``round`` goes half away from zero)."""
    scale = float(10 ** digits)
    return F.floor(as_col(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def utf16_length(text: ColumnLike) -> Column:
    """String length in UTF-16 units (Spark's ``length`` counts code points)."""
    return (F.length(F.encode(as_col(text), "UTF-16BE")) / 2).cast("long")


def js_trim(text: ColumnLike) -> Column:
    return F.regexp_replace(as_col(text), f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(text: ColumnLike) -> Column:
    return F.nullif(as_col(text), F.lit(""))


def number_text(x: ColumnLike) -> Column:
    """Plain decimal text of a double: no exponent and no trailing zeros."""
    value = as_col(x).cast("double")
    plain = value.cast("string").try_cast("decimal(38,18)").cast("string")
    short = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), "\\.$", "")
    return F.when(value == F.lit(0.0), F.lit("0")).otherwise(F.coalesce(short, value.cast("string")))


def is_json(text: ColumnLike) -> Column:
    """True for a text that is one JSON value, with nothing behind it; keys may repeat."""
    listed = F.from_json(F.concat(F.lit("["), as_col(text), F.lit("]")), "array<string>")
    return F.coalesce(F.size(listed) == 1, F.lit(False))


def _members(doc: Column, leave_out: Iterable[str] = ()) -> Column:
    """Members of a JSON object as (key, value) entries; of a repeated key the last one stays, as for web clients.

    NULL for what is no object, and for an object inside which a nested key repeats.
    """
    entries = F.map_entries(F.from_json(doc, "map<string,variant>"))
    return let(entries, lambda all_: F.filter(all_, lambda e, i: ~e["key"].isin(*leave_out) & ~F.exists(
        F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1))), lambda later: later["key"] == e["key"])))


def _appended(doc: Column, members: Column) -> Column:
    """``doc`` with the members of a JSON object behind its own; readers take the last of a repeated key."""
    inner = F.regexp_replace(F.trim(members), r"^\{\s*|\s*\}$", "")
    return F.when(inner == "", doc).otherwise(F.concat(F.regexp_replace(F.rtrim(doc), r"\}$", ","), inner, F.lit("}")))


def overlay_numbers(doc: ColumnLike, figures: ColumnLike, names: Iterable[str]) -> Column:
    """``doc`` (a JSON object) with its top-level keys ``names`` replaced by those of the JSON object ``figures``.

    All other keys stay, nested ones too, whatever stands in them; a ``doc`` that is no object gives ``figures``.
    """
    doc, figures = as_col(doc), as_col(figures)
    kept = lambda fresh: F.filter(_members(doc, names), lambda e: ~F.exists(fresh, lambda f: f["key"] == e["key"]))
    merged = F.to_json(F.map_from_entries(let(_members(figures), lambda fresh: F.concat(kept(fresh), fresh))))
    is_object = F.json_object_keys(doc).isNotNull()
    return F.when(is_object, F.coalesce(merged, F.when(is_json(doc), _appended(doc, figures)), figures)).otherwise(figures)


def with_member(doc: ColumnLike, key: str, value: str) -> Column:
    """``doc`` (a JSON object) with its key ``key`` holding the JSON text ``value``; a ``doc`` without the key is only added to."""
    doc = as_col(doc)
    member = f'"{key}":{value}'
    added = F.when(F.size(F.json_object_keys(doc)) > 0, _appended(doc, F.lit("{" + member + "}"))).otherwise(F.lit("{" + member + "}"))
    others = F.to_json(F.map_from_entries(_members(doc, [key])))
    replaced = F.when(others == "{}", F.lit("{" + member + "}")).otherwise(_appended(others, F.lit("{" + member + "}")))
    return F.when(F.array_contains(F.json_object_keys(doc), key), F.coalesce(replaced, added)).otherwise(added)


def json_like(text: ColumnLike, opener: str) -> Column:
    """True when the JSON text starts with ``opener`` (``[`` or ``{``)."""
    return F.ltrim(as_col(text)).startswith(opener)
