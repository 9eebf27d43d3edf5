"""JSON-Schema strings: validity status and rendering as prose.

Everything is a native expression over ``from_json``. Two parses are combined:
``map<string,string>`` keeps key order and raw nested JSON, ``map<string,variant>``
tells the JSON type of each value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlens.functions.binding import let

SCHEMA_STATUSES = ["valid_object", "missing", "malformed", "non_object"]

# Texts the model input must show.
NULL_SCHEMA = "the JSON object must be str, bytes or bytearray, not NoneType"
UNPARSEABLE = "malformed JSON"

_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
_JSON_SPACE = " \t\n\r"
_TOKEN = r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+'


def _raw_map(c: Column) -> Column:
    return F.from_json(c, "map<string,string>", _STRICT)


def _typed_map(c: Column) -> Column:
    return F.from_json(c, "map<string,variant>", _STRICT)


def _last(mapping: Column, key: Column) -> Column:
    """Value of the last entry with this key (a repeated key overwrites)."""
    hits = F.filter(F.map_entries(mapping), lambda e: e["key"] == key)
    return F.element_at(hits, -1)["value"]


def _entries(c: Column) -> Column:
    """A JSON object as ``array<struct<key, raw, kind>>`` in document order."""

    def entry(maps: Column):
        def one(key: Column) -> Column:
            value = F.struct(
                _last(maps["raw"], key).alias("raw"), _last(maps["typed"], key).alias("typed")
            )
            return let(
                value,
                lambda v: F.struct(
                    key.alias("key"),
                    v["raw"].alias("raw"),
                    F.when(maps["typed"].isNull(), _guessed_kind(v["raw"]))
                    .otherwise(_kind(v["typed"]))
                    .alias("kind"),
                ),
            )

        return F.transform(F.array_distinct(F.map_keys(maps["raw"])), one)

    maps = F.struct(_raw_map(c).alias("raw"), _typed_map(c).alias("typed"))
    return let(maps, entry)


def _find(entries: Column, key: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == key), 0)


def _is_json(c: Column) -> Column:
    """Exactly one JSON value. Each wrapper alone lets some trailing text through;
    a text that passes both is a single value."""
    in_array = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>", _STRICT)
    in_object = F.from_json(
        F.concat(F.lit('{"v":'), c, F.lit("}")), "map<string,string>", _STRICT
    )
    return F.coalesce((F.size(in_array) == 1) & (F.size(in_object) == 1), F.lit(False))


def schema_status(c: Column, blank: Column) -> Column:
    """``missing``, ``malformed``, ``valid_object`` or ``non_object``."""
    body = F.trim(c, F.lit(_JSON_SPACE))
    return (
        F.when(blank, "missing")
        .when(~_is_json(c), "malformed")
        .when(F.startswith(body, F.lit("{")), "valid_object")
        .otherwise("non_object")
    )


def _kind(typed: Column) -> Column:
    """JSON kind of a variant: STRING, NUMBER, BOOLEAN, ARRAY, OBJECT or VOID."""
    return let(
        F.coalesce(F.schema_of_variant(typed), F.lit("VOID")),
        lambda name: F.when(name.isin("STRING", "BOOLEAN", "VOID"), name)
        .when(F.startswith(name, F.lit("ARRAY")), "ARRAY")
        .when(F.startswith(name, F.lit("OBJECT")), "OBJECT")
        .otherwise("NUMBER"),
    )


def _guessed_kind(raw: Column) -> Column:
    """Kind by first character, for values a variant cannot hold (repeated keys inside)."""
    return (
        F.when(raw.isNull(), "VOID")
        .when(F.startswith(raw, F.lit("{")), "OBJECT")
        .when(F.startswith(raw, F.lit("[")), "ARRAY")
        .otherwise("STRING")
    )


# Control, format, unassigned and separator characters, but for the space.
_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def _escape(char: Column) -> Column:
    code = F.ascii(char)
    digits = F.lower(F.hex(code))
    return (
        F.when(~F.rlike(char, F.lit(_UNPRINTABLE)), char)
        .when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )


def _quoted(text: Column) -> Column:
    """A string the way Python lists show it."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(shown))
    body = F.when(
        F.rlike(body, F.lit(_UNPRINTABLE)), F.array_join(F.transform(F.split(body, ""), _escape), "")
    ).otherwise(body)
    single = F.contains(text, F.lit("'"))
    double = F.contains(text, F.lit('"'))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def _shown_token(token: Column) -> Column:
    text = F.get(
        F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>", _STRICT), 0
    )
    return (
        F.when(token == ",", ", ")
        .when(token == ":", ": ")
        .when(token == "true", "True")
        .when(token == "false", "False")
        .when(token == "null", "None")
        .when(F.startswith(token, F.lit('"')), let(text, _quoted))
        .otherwise(token)
    )


def _python_repr(raw_json: Column) -> Column:
    """Raw JSON array or object printed like the equal Python value."""
    tokens = F.regexp_extract_all(raw_json, F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, _shown_token), "")


def _shown(entry: Column) -> Column:
    kind, raw = entry["kind"], entry["raw"]
    return (
        F.when(kind.isin("STRING", "NUMBER"), raw)
        .when(kind == "BOOLEAN", F.initcap(raw))
        .when(kind == "VOID", "None")
        .otherwise(_python_repr(raw))
    )


def _truthy(entry: Column) -> Column:
    kind, raw = entry["kind"], entry["raw"]
    return F.coalesce(
        F.when(kind == "STRING", raw != "")
        .when(kind == "BOOLEAN", raw == "true")
        .when(kind == "NUMBER", raw.try_cast("double") != 0)
        .when(kind.isin("ARRAY", "OBJECT"), ~raw.isin("[]", "{}")),
        F.lit(False),
    )


# How Python names the type of a JSON value.
_PYTHON_TYPE = {
    "STRING": "str",
    "BOOLEAN": "bool",
    "VOID": "NoneType",
    "ARRAY": "list",
    "OBJECT": "dict",
}


def _python_type(kind: Column, raw: Column) -> Column:
    name = F.when(F.rlike(raw, F.lit("[.eE]")) & (kind == "NUMBER"), "float")
    for k, shown in _PYTHON_TYPE.items():
        name = name.when(kind == k, shown)
    return name.otherwise("int")


def _no_attribute(kind: Column, raw: Column, name: str) -> Column:
    return F.concat(
        F.lit("'"), _python_type(kind, raw), F.lit(f"' object has no attribute '{name}'")
    )


def _is_required(required: Column, name: Column) -> Column:
    """Whether ``name`` is a member of the ``required`` value."""
    kind, raw = required["kind"], required["raw"]
    return F.coalesce(
        F.when(kind == "ARRAY", F.array_contains(F.from_json(raw, "array<string>", _STRICT), name))
        .when(kind == "OBJECT", F.map_contains_key(_raw_map(raw), name))
        .when(kind == "STRING", (F.length(name) == 1) & F.contains(raw, name)),
        F.lit(False),
    )


def _required_error(required: Column) -> Column:
    """Why ``required`` cannot become a set of names, or NULL."""
    kind, raw = required["kind"], required["raw"]
    nested = F.filter(
        F.from_json(raw, "array<variant>", _STRICT),
        lambda v: _kind(v).isin("ARRAY", "OBJECT"),
    )
    return F.when(
        kind.isin("VOID", "NUMBER", "BOOLEAN"),
        F.concat(F.lit("'"), _python_type(kind, raw), F.lit("' object is not iterable")),
    ).when(
        (kind == "ARRAY") & (F.size(nested) > 0),
        F.concat(
            F.lit("unhashable type: '"),
            _python_type(_kind(F.get(nested, 0)), F.lit("")),
            F.lit("'"),
        ),
    )


def _property_line(prop: Column, required: Column) -> Column:
    def line(spec: Column) -> Column:
        description, enum, kind = (spec[key] for key in ("description", "enum", "type"))
        return F.concat(
            F.lit("- "),
            prop["key"],
            F.lit(": "),
            F.when(kind.isNull(), "unknown").otherwise(_shown(kind)),
            F.when(_is_required(required, prop["key"]), " (required)").otherwise(" (optional)"),
            F.when(_truthy(description), F.concat(F.lit(" — "), _shown(description))).otherwise(""),
            F.when(
                _truthy(enum), F.concat(F.lit(" — allowed values: "), _shown(enum))
            ).otherwise(""),
        )

    def parts(fields: Column) -> Column:
        found = [_find(fields, key).alias(key) for key in ("description", "enum", "type")]
        return let(F.struct(*found), line)

    return let(_entries(prop["raw"]), parts)


def _object_prose(fields: Column) -> Column:
    """Prose of a parsed schema object, given its entries."""

    def prose(parts: Column) -> Column:
        description, properties, required = (
            parts[key] for key in ("description", "properties", "required")
        )
        bad = F.get(F.filter(parts["specs"], lambda p: p["kind"] != "OBJECT"), 0)
        error = F.coalesce(
            _required_error(required),
            F.when(
                properties["kind"] != "OBJECT",
                _no_attribute(properties["kind"], properties["raw"], "items"),
            ),
            F.when(bad.isNotNull(), _no_attribute(bad["kind"], bad["raw"], "get")),
        )
        lines = F.transform(parts["specs"], lambda p: _property_line(p, required))
        head = F.when(
            _truthy(description),
            F.concat(F.lit("Schema description: "), _shown(description), F.lit("\n")),
        ).otherwise("")
        return (
            F.when(~_truthy(properties), F.concat(head, F.lit("Parameters: none")))
            .when(error.isNotNull(), F.concat(F.lit("Schema unavailable: "), error))
            .otherwise(F.concat(head, F.lit("Parameters:\n"), F.array_join(lines, "\n")))
        )

    properties = _find(fields, "properties")
    return let(
        F.struct(
            _find(fields, "description").alias("description"),
            properties.alias("properties"),
            _find(fields, "required").alias("required"),
            _entries(properties["raw"]).alias("specs"),
        ),
        prose,
    )


def schema_prose(c: Column) -> Column:
    """A JSON-Schema string as prose, or ``Schema unavailable: <reason>``."""

    def render(row: Column) -> Column:
        text, status = row["text"], row["status"]
        whole = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<variant>", _STRICT)
        error = (
            F.when(text.isNull(), NULL_SCHEMA)
            .when(text == "", "Expecting value: line 1 column 1 (char 0)")
            .when(status == "non_object", _no_attribute(_kind(F.get(whole, 0)), text, "get"))
            .otherwise(UNPARSEABLE)
        )
        return F.when(
            status == "valid_object", _object_prose(row["fields"])
        ).otherwise(F.concat(F.lit("Schema unavailable: "), error))

    blank = F.coalesce(F.trim(c, F.lit(_JSON_SPACE)) == "", F.lit(True))
    return let(
        F.struct(
            c.alias("text"),
            schema_status(c, blank).alias("status"),
            _entries(c).alias("fields"),
        ),
        render,
    )
