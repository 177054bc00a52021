"""JSON text columns: validity, structure facts, paths and readable rendering."""

from __future__ import annotations

import json
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

# Limits of previews, and of listed keys.
MAX_DEPTH = 3
MAX_ITEMS = 20
MAX_STRING = 200
ALL_KEYS_UP_TO = 20
FIRST_KEYS = 10
DEPTH_NOTE = "[Deep nesting truncated]"

_NOTE = object()  # stands in the place of a name


def is_json(text: Column) -> Column:
    """True if the text is exactly one JSON value.

    The parser stops after the first value, so the text is tried as an array
    item and as an object field: only a single value survives both.
    """
    as_item = F.concat(F.lit("["), text, F.lit("\n]"))
    as_field = F.concat(F.lit('{"x":'), text, F.lit("\n}"))
    return F.try_parse_json(as_item).isNotNull() & F.try_parse_json(as_field).isNotNull()


def _skeleton(text: Column) -> Column:
    """JSON without strings and blanks: brackets, commas, colons and scalars."""
    masked = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "s")
    return F.regexp_replace(masked, r"\s+", "")


def nesting_depth(text: Column) -> Column:
    """1 plus the number of non-empty containers around the deepest value."""
    no_empties = F.regexp_replace(_skeleton(text), r"\{\}|\[\]", "s")
    brackets = F.array_remove(F.split(F.regexp_replace(no_empties, r"[^{}\[\]]+", ""), ""), "")
    start = F.struct(F.lit(1).alias("now"), F.lit(1).alias("top"))

    def step(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["top"], now).alias("top"))

    return F.aggregate(brackets, start, step, lambda state: state["top"].cast("bigint"))


def with_structure(df: DataFrame, json_col: str) -> DataFrame:
    """Add structure type and the key, item and depth facts that go with it.

    ``json_col`` must hold JSON or null, see :func:`is_json`. Each scan of the
    text is a column of its own, because several facts read it.
    """
    text, start = F.col(json_col), r"\A\s*([\[{]?)\s*(.?)"
    df = df.withColumns(
        {
            "__shape": F.regexp_extract(text, start, 1),
            "__second": F.regexp_extract(text, start, 2),
            "__depth": nesting_depth(text),
            "__keys": F.array_distinct(F.json_object_keys(text)),
            "__items": F.json_array_length(text).cast("bigint"),
        }
    )
    shape, second, depth, keys, items = (F.col(name) for name in ("__shape", "__second", "__depth", "__keys", "__items"))
    kind = (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when((shape == "[") & second.isin("[", "{"), "array_of_objects")
        .when(shape == "[", "array")
        .when((shape == "{") & (depth > 2), "nested")
        .when(shape == "{", "object")
        .otherwise("primitive")
    )
    df = df.withColumn("structure_type", kind)
    kind = F.col("structure_type")
    few = F.array_join(F.slice(keys, 1, FIRST_KEYS), ",")
    number = F.regexp_extract(text, r"\A\s*\[\s*(-?[0-9][0-9.eE+-]*)", 1)
    first_type = (
        F.when(second == '"', "str")
        .when(second.isin("t", "f"), "bool")
        .when(second == "n", "NoneType")
        .when(number.rlike("[.eE]"), "float")
        .otherwise("int")
    )
    all_keys = F.when(F.size(keys) <= ALL_KEYS_UP_TO, F.array_join(keys, ",")).otherwise(F.concat(few, F.lit(",...")))
    return df.withColumns(
        {
            "item_count": F.when(kind == "array", items),
            "first_item_type": F.when((kind == "array") & (items > 0), first_type),
            "key_count": F.when(kind.isin("object", "nested"), F.size(keys).cast("bigint")),
            "top_keys": F.when(kind == "object", all_keys).when(kind == "nested", few),
            "nesting_depth": F.when(kind == "nested", depth),
        }
    ).drop("__shape", "__second", "__depth", "__keys", "__items")


def format_value(value: Column, longest: int | None = None) -> Column:
    """A scalar JSON text for display; strings lose escapes and are cut at ``longest`` characters, if given.

    Decimal numbers of everyday size print in shortest form, others as written.
    """
    bare = F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]")
    cut = bare
    if longest is not None:
        cut = F.when(F.length(bare) > longest, F.concat(F.substring(bare, 1, longest), F.lit("..."))).otherwise(bare)
    number = value.try_cast("double")
    plain_float = value.rlike("[.eE]") & F.abs(number).between(1e-3, 9999999.0)
    return (
        F.when(F.startswith(F.ltrim(value), F.lit('"')), F.concat(F.lit('"'), cut, F.lit('"')))
        .when(plain_float, number.cast("string"))
        .otherwise(F.trim(value))
    )


def json_path(text: Column, path: str) -> Column:
    """JSON texts found at a path like ``a.b[0].c``, or null if there is none."""
    dotted = path if path.startswith("$") else ("$" if path.startswith("[") else "$.") + path
    if "*" in dotted:
        raise ValueError(f"not a path to one value: {path}")
    match = F.try_variant_get(F.try_parse_json(text), dotted, "variant")
    return F.when(match.isNotNull(), F.array(F.to_json(match)))


def _scalar(value, chars: int | None) -> str:
    if isinstance(value, str):
        return f'"{value}"' if chars is None or len(value) <= chars else f'"{value[:chars]}..."'
    return json.dumps(value) if value is None or isinstance(value, bool) else str(value)


def _outline(root, depth: int | None = None, items: int | None = None, chars: int | None = None) -> str:
    """Readable outline of a parsed value, line by line; containers nest by two blanks.

    Without limits nothing is left out. What waits to be shown lies on a list of its own, so that a deep value needs
    no deep call stack.
    """
    lines: list[str] = []
    waiting: list[tuple] = [(None, root, 0)]  # name (None for the root), value and level; the next one is last
    while waiting:
        name, value, level = waiting.pop()
        margin, inner = "  " * level, level if name is None else level + 1
        if not isinstance(value, (dict, list)):
            shown = value if name is _NOTE else _scalar(value, chars)
            lines.append(margin + (shown if name is None or name is _NOTE else f"{name}: {shown}"))
            continue
        if name is not None:
            lines.append(f"{margin}{name}:")
        if depth is not None and inner >= depth:
            lines += ["  " * inner + DEPTH_NOTE, ""]
        elif not value:
            lines.append("")
        elif isinstance(value, dict):
            waiting += [(key, child, inner) for key, child in reversed(value.items())]
        else:
            shown = value[:items]
            if len(shown) < len(value):
                waiting.append((_NOTE, f"... and {len(value) - len(shown)} more items", inner))
            waiting += [(f"[{at}]", shown[at], inner) for at in range(len(shown) - 1, -1, -1)]
    return "\n".join(lines)


def _parsed(text: str, use):
    """``use`` applied to the parsed text; null where Python cannot read it."""
    try:
        return use(json.loads(text))
    except (ValueError, RecursionError):
        return None


def _indented(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def _mapped(values: pa.Array, use, kind: pa.DataType) -> pa.Array:
    return pa.array([None if value is None else use(value) for value in values.to_pylist()], kind)


# The helpers take whole Arrow arrays, so that Spark runs those of one projection
# in one Python worker.
@F.arrow_udf(StringType())
def json_to_text(texts: pa.Array) -> pa.Array:
    """Readable outline of whole JSON texts. Numbers print as Python prints them."""
    return _mapped(texts, lambda text: _parsed(text, _outline), pa.string())


@F.arrow_udf(StringType())
def json_preview(texts: pa.Array) -> pa.Array:
    """The outline with the limits of previews: three levels, twenty items of a list, 200 characters of a string."""
    return _mapped(texts, lambda text: _parsed(text, lambda value: _outline(value, MAX_DEPTH, MAX_ITEMS, MAX_STRING)), pa.string())


@F.arrow_udf(ArrayType(StringType()))
def pretty_json(arrays: pa.Array) -> pa.Array:
    """Indented form of every JSON text of an array."""
    return _mapped(arrays, lambda texts: [_parsed(text, _indented) for text in texts], pa.list_(pa.string()))


@F.arrow_udf(ArrayType(StringType()))
def pretty_items(texts: pa.Array, limits: pa.Array) -> pa.Array:
    """Indented form of the first ``n`` items of JSON root arrays; empty for other roots."""

    def items(root, limit: int) -> list[str]:
        return [_indented(item) for item in root[:limit]] if isinstance(root, list) else []

    pairs = zip(texts.to_pylist(), limits.to_pylist())
    shown = [None if text is None else _parsed(text, lambda root, limit=limit: items(root, limit)) for text, limit in pairs]
    return pa.array(shown, pa.list_(pa.string()))


# So marked, a later filter is not pushed below them, which would run them twice.
for _helper in (json_to_text, json_preview, pretty_json, pretty_items):
    _helper.asNondeterministic()
