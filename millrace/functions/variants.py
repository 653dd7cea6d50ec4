"""JSON of any shape as VARIANT, in the JVM: validation by a schema, and search at any depth."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import written

FAULT = "array<struct<path:string,rule:string>>"


def kind(v: Column) -> Column:
    """object, array, string, boolean, null, integer or number; null where there is no value. 2.0 is an integer, as JSON
    Schema has it."""
    s, number = F.schema_of_variant(v), F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull(), None).when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
        .when((s == "BIGINT") | (number == F.floor(number)), "integer").otherwise("number")
    )


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f'$["{name}"]', "variant")


def _fault(broken: Column, path: Column, rule: str) -> Column:
    """A list of one fault or none; a condition that is unknown is no fault."""
    return F.when(broken, F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(F.array().cast(FAULT))


_KNOWN = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "title", "description", "$schema", "strict"}


def violations(v: Column, schema: dict, path: Column | None = None) -> Column:
    """array<struct<path, rule>>: a fault for each rule of a JSON Schema that a variant breaks; null gives none.

    Rules: type (one or several), enum, const, required, properties, additionalProperties (false or a schema), items,
    bounds of length, number and value, pattern. Other keywords are refused rather than passed over. The schema is
    compiled into one expression; a rule that doesn't apply to a value's kind is kept.
    """
    unknown = set(schema) - _KNOWN
    if unknown:
        raise ValueError(f"keywords without a rule here: {', '.join(sorted(unknown))}")
    path = F.lit("$") if path is None else path
    own = kind(v)
    found = []
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        found.append(_fault(~own.isin(kinds + (["integer"] if "number" in kinds else [])), path, "type"))
    text = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    for rule, allowed in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if allowed is not None:
            found.append(_fault(~F.to_json(v).isin([text(x) for x in allowed]), path, rule))
    is_ = {k: own == k for k in ("object", "array", "string")}
    for name in schema.get("required", ()):
        found.append(_fault(is_["object"] & _at(v, name).isNull(), F.concat(path, F.lit(f".{name}")), "required"))
    for name, rules in schema.get("properties", {}).items():
        found.append(F.when(is_["object"] & _at(v, name).isNotNull(), violations(_at(v, name), rules, F.concat(path, F.lit(f".{name}")))).otherwise(F.array().cast(FAULT)))
    others = schema.get("additionalProperties", True)
    if others is not True:
        names = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
        more = F.when(is_["object"], F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~F.array_contains(names, k)))
        if others is False:
            found.append(F.coalesce(F.transform(F.array_sort(F.map_keys(more)), lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("additionalProperties").alias("rule"))), F.array().cast(FAULT)))
        else:
            found.append(F.coalesce(F.flatten(F.transform(F.map_entries(more), lambda e: violations(e["value"], others, F.concat(path, F.lit("."), e["key"])))), F.array().cast(FAULT)))
    items = F.when(is_["array"], F.try_variant_get(v, "$", "array<variant>"))
    if "items" in schema:
        each = F.transform(items, lambda x, i: violations(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.coalesce(F.flatten(each), F.array().cast(FAULT)))
    length, number = F.length(F.when(is_["string"], F.try_variant_get(v, "$", "string"))), F.when(own.isin("integer", "number"), F.try_variant_get(v, "$", "double"))
    bounds = {
        "minItems": lambda b: F.size(items) < b, "maxItems": lambda b: F.size(items) > b, "minLength": lambda b: length < b, "maxLength": lambda b: length > b,
        "minimum": lambda b: number < b, "maximum": lambda b: number > b, "exclusiveMinimum": lambda b: number <= b, "exclusiveMaximum": lambda b: number >= b,
        "pattern": lambda b: ~F.when(is_["string"], F.try_variant_get(v, "$", "string")).rlike(b),
    }
    for rule, broken in bounds.items():
        if rule in schema:
            applies = items.isNotNull() if rule.endswith("Items") else F.lit(True)
            found.append(_fault(applies & broken(schema[rule]), path, rule))
    return F.when(v.isNotNull(), F.concat(*found) if found else F.array().cast(FAULT)).otherwise(F.array().cast(FAULT))


def faults(documents: DataFrame, payload: str, schema: dict) -> DataFrame:
    """A row for each fault of each document: the other columns, path and rule. What is no JSON has one fault, json, at $;
    a null payload has none."""
    v = F.try_parse_json(payload)
    none = F.when(F.col(payload).isNotNull() & v.isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"))))
    parsed = documents.withColumn("__v", v)
    return parsed.select(*[c for c in documents.columns if c != payload], F.inline(F.coalesce(none, violations(F.col("__v"), schema))))


def typed_objects(documents: DataFrame, payload: str, types: list[str], type_key: str = "@type", most_depth: int = 64) -> DataFrame:
    """The other columns, path and object (a variant) of each object of a type at any depth of JSON documents.

    An object has a type if type_key names it or lists it. Depth by depth, objects and lists are opened in the JVM, and
    each level is written, so a document's branches are rows of their own. What is no JSON gives nothing; documents
    that are deeper than most_depth fail.
    """
    keep = [c for c in documents.columns if c != payload]
    level = documents.select(*keep, F.lit("$").alias("path"), F.try_parse_json(payload).alias("object")).where("object is not null")
    found = None
    for _ in range(most_depth):
        level = written(level.where(kind(F.col("object")).isin("object", "array")), "json-level")
        if level.isEmpty():
            break
        own = F.try_variant_get("object", f'$["{type_key}"]', "variant")
        named = F.when(kind(own) == "array", F.try_variant_get(own, "$", "array<string>")).otherwise(F.array(F.try_variant_get(own, "$", "string")))
        here = level.where((kind(F.col("object")) == "object") & F.arrays_overlap(named, F.array(*[F.lit(t) for t in types])))
        found = here if found is None else found.unionByName(here)
        fields = F.transform(F.map_entries(F.try_variant_get("object", "$", "map<string,variant>")), lambda e: F.struct(F.concat(F.col("path"), F.lit("."), e["key"]).alias("path"), e["value"].alias("object")))
        entries = F.transform(F.try_variant_get("object", "$", "array<variant>"), lambda x, i: F.struct(F.concat(F.col("path"), F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("object")))
        level = level.select(*keep, F.inline(F.when(kind(F.col("object")) == "object", fields).otherwise(entries))).where("object is not null")
    else:
        raise ValueError(f"JSON deeper than {most_depth}")
    return found if found is not None else level
