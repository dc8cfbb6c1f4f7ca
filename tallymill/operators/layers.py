"""Layered merging: many partial documents per key become one.

A layer with a higher number overrides a lower one. Rules are given per column:

=============  ==============================================================
rule           result
=============  ==============================================================
``last``       the value of the highest layer, NULL or not
``last_set``   the highest value that is not NULL
``first_set``  the lowest value that is not NULL
``union``      a map with the keys of all layers, the highest value for each;
               NULL only if all layers are NULL
``concat``     the arrays of all layers one after the other, repeats kept
``fragment``   a struct, ``last_set`` for each of its fields, ``union`` for maps
               and ``fragment`` again for structs among them
``fragment_base``  the same with ``first_set`` and the lowest value of a map's key
``named``      an array of structs with a ``name``: elements of the same name
               are merged like a ``fragment``
``env``        an array of name and value: the last value per name, by name
=============  ==============================================================
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from tallymill.operators.apps import not_yet_processed
from tallymill.session import broadcast_if_small, checkpoint

# How annotations ask for a merge and name a layer, and the greatest index.
MERGE_ANNOTATION = "spark-application.template.merge"
LAYER_ANNOTATION = r"^spark-application\.template\.(\d+)\.name$"
MAX_INDEX = 255
#: The layer of the own document, above all layers an annotation can name.
OWN_LAYER = MAX_INDEX + 1

ROW_RULES = ("last", "last_set", "first_set", "concat", "fragment", "fragment_base")
ENTRY_RULES = ("union", "named", "env")
# Used on parts of named lists and fragments only.
_PLACE, _ANY, _UNION_BASE = "place", "any", "union_base"


# --- layers of a document ---------------------------------------------------


def merge_switch(annotations: str | Column) -> Column:
    """Whether an annotation map asks for a merge.

    Without the annotation, or any annotations, nothing is merged. A value other
    than ``true`` and ``false`` is an error.
    """
    switch = F.try_element_at(annotations, F.lit(MERGE_ANNOTATION))
    bad = F.raise_error(F.concat(F.lit(f"{MERGE_ANNOTATION} must be true or false, not "), switch))
    return (
        F.when(switch.isNull(), False).when(switch == "true", True).when(switch == "false", False).otherwise(bad.cast("boolean"))
    )


def order_layers(annotations: str | Column) -> Column:
    """Layer names of an annotation map, in the numeric order of their index.

    There are none unless the map asks for a merge. An index above 255 is an
    error, as it is where the annotations are defined, merged or not.
    """
    annotations = F.col(annotations) if isinstance(annotations, str) else annotations
    entries = F.map_entries(annotations)
    named = F.filter(entries, lambda e: e["key"].rlike(LAYER_ANNOTATION))

    def index(entry: Column) -> Column:
        number = F.regexp_extract(entry["key"], LAYER_ANNOTATION, 1).try_cast("int")
        bad = F.raise_error(F.concat(F.lit("invalid layer index in "), entry["key"]))
        return F.when(number <= MAX_INDEX, number).otherwise(bad.cast("int"))

    indexed = F.transform(
        named, lambda e: F.struct(index(e).alias("i"), e["key"].alias("k"), e["value"].alias("n"))
    )
    switched = F.filter(F.array_sort(indexed), lambda e: merge_switch(annotations))
    return F.transform(switched, lambda e: e["n"])


def layer_refs(specs: DataFrame, key: str, refs: str | Column) -> DataFrame:
    """One row per layer a document names: key, layer number and name."""
    names = F.col(refs) if isinstance(refs, str) else refs
    return specs.select(key, F.posexplode(names).alias("layer", "name"))


def resolve_layers(
    specs: DataFrame, templates: DataFrame, key: str, refs: str | Column, strict: bool = False
) -> DataFrame:
    """The documents of the named layers, with their number and name.

    ``templates`` has one row per ``name``. A name without a template is left
    out; with ``strict`` it is an error. A popular template repeats on the side
    of the references only: a small table of templates is broadcast, and a large
    one meets a skewed name in a join that adaptive execution can split.
    """
    wanted = layer_refs(specs, key, refs)
    known = broadcast_if_small(templates.withColumn("_known", F.lit(True)))
    if not strict:
        return wanted.join(known, "name", "inner").drop("_known")
    missing = F.raise_error(F.concat(F.lit("no such layer: "), F.col("name")))
    checked = F.when(F.col("_known").isNotNull(), F.col("layer")).otherwise(missing.cast("int"))
    return wanted.join(known, "name", "left").withColumn("layer", checked).drop("_known")


def stack_layers(resolved: DataFrame, specs: DataFrame) -> DataFrame:
    """Resolved layers and, above them, the own document of each key."""
    own = specs.withColumn("layer", F.lit(OWN_LAYER))
    return resolved.unionByName(own, allowMissingColumns=True)


# --- merging ----------------------------------------------------------------


def _set(value: Column, layer: Column) -> Column:
    """The layer where there is a value; such an order ignores rows without one."""
    return F.when(value.isNotNull(), layer)


def _row_rule(value: Column, layer: Column, rule: str) -> Column:
    if rule == "last":
        return F.max_by(value, layer)
    if rule == "last_set":
        return F.max_by(value, _set(value, layer))
    if rule == "first_set":
        return F.min_by(value, _set(value, layer))
    if rule == _PLACE:
        return F.min(value)
    if rule == _ANY:
        return F.bool_or(value)
    parts = F.collect_list(F.when(value.isNotNull(), F.struct(layer.alias("l"), value.alias("v"))))
    # A missing array is an empty one.
    return F.flatten(F.transform(F.array_sort(parts), lambda p: p["v"]))


def _leaves(value: Column, kind, name: str, rule: str) -> tuple[dict[str, tuple[Column, str]], Column]:
    """The leaves of a fragment with their rules, and the fragment made of them again."""
    if isinstance(kind, MapType):
        return {name: (value, "union" if rule == "fragment" else _UNION_BASE)}, F.col(name)
    if not isinstance(kind, StructType):
        return {name: (value, "last_set" if rule == "fragment" else "first_set")}, F.col(name)
    found, fields = {f"{name}__set": (value.isNotNull(), _ANY)}, []
    for i, f in enumerate(kind.fields):
        inner, field = _leaves(value.getField(f.name), f.dataType, f"{name}__{i}", rule)
        found.update(inner)
        fields.append(field.alias(f.name))
    return found, F.when(F.col(f"{name}__set"), F.struct(*fields))


def _merge_fragments(docs: DataFrame, keys: list[str], layer: str, rules: Mapping[str, str]) -> DataFrame:
    """Merge all columns, those that are fragments leaf by leaf."""
    leaves, whole = {}, {}
    for c, rule in rules.items():
        if rule in ("fragment", "fragment_base"):
            found, whole[c] = _leaves(F.col(c), docs.schema[c].dataType, f"_leaf_{c}", rule)
        else:
            found, whole[c] = {c: (F.col(c), rule)}, F.col(c)
        leaves.update(found)
    flat = docs.select(*keys, layer, *(value.alias(name) for name, (value, _) in leaves.items()))
    merged = _merge(flat, keys, layer, {name: rule for name, (_, rule) in leaves.items()})
    return merged.select(*keys, *(value.alias(c) for c, value in whole.items()))


def _merge_maps(docs: DataFrame, keys: list[str], layer: str, maps: list[str], best=F.max_by) -> DataFrame:
    """Union of the map columns per key; ``best`` takes the value of the layer that wins.

    The maps are taken apart, so that overridden entries are dropped before the
    shuffle and no key is ever held with all its layers. Only the entries of the
    result come together. Maps with different value types are merged in turn.
    """
    value_type = {docs.schema[m].dataType.valueType.simpleString() for m in maps}
    if len(value_type) > 1:
        parts = [_merge_maps(docs, keys, layer, [m], best) for m in maps]
        merged = parts[0]
        for part in parts[1:]:
            merged = _together(merged, part, keys)
        return merged
    # A map without entries still counts as present: it leaves an entry without a key.
    stacked = F.array(
        *(
            F.struct(
                F.lit(m).alias("map"),
                F.when(F.size(m) > 0, F.map_entries(m))
                .when(F.col(m).isNotNull(), F.map_entries(m))
                .alias("entries"),
            )
            for m in maps
        )
    )
    rows = docs.select(*keys, layer, F.explode(stacked).alias("_m")).select(
        *keys,
        layer,
        F.col("_m.map").alias("_map"),
        F.col("_m.entries").isNotNull().alias("_present"),
        F.explode_outer("_m.entries").alias("_e"),
    )
    winners = rows.groupBy(*keys, "_map", F.col("_e.key").alias("_k")).agg(
        best(F.col("_e.value"), F.when(F.col("_e").isNotNull(), F.col(layer))).alias("_v"),
        F.bool_or("_present").alias("_present"),
    )

    def merged(m: str) -> Column:
        mine = F.col("_map") == m
        entry = F.when(mine & F.col("_k").isNotNull(), F.struct("_k", "_v"))
        present = F.bool_or(mine & F.col("_present"))
        entries = F.array_sort(F.collect_list(entry), lambda a, b: _compare(a["_k"], b["_k"]))
        return F.when(present, F.map_from_entries(entries)).alias(m)

    return winners.groupBy(*keys).agg(*(merged(m) for m in maps))


def _compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def _merge_named(docs: DataFrame, keys: list[str], layer: str, column: str) -> DataFrame:
    """Merge lists of structs by element name, in the order of first appearance."""
    element: StructType = docs.schema[column].dataType.elementType
    fields = [f for f in element.fields if f.name != "name"]
    elements = docs.select(
        *keys,
        layer,
        F.col(column).isNotNull().alias("_present"),
        F.posexplode_outer(column).alias("_pos", "_el"),
    ).select(
        *keys,
        layer,
        "_present",
        F.when(F.col("_pos").isNotNull(), F.struct(layer, "_pos")).alias("_first"),
        F.col("_el.name").alias("name"),
        *(F.col(f"_el.{f.name}").alias(f.name) for f in fields),
    )
    rules = {f.name: "fragment" for f in fields}
    merged = _merge_fragments(
        elements,
        [*keys, "name"],
        layer,
        {**rules, "_first": _PLACE, "_present": _ANY},
    )
    struct = F.struct(*(F.col(f.name) for f in element.fields))
    listed = F.collect_list(
        F.when(F.col("_first").isNotNull(), F.struct("_first", struct.alias("_el")))
    )
    ordered = F.array_sort(listed, lambda a, b: _compare(a["_first"], b["_first"]))
    elements_in_order = F.transform(ordered, lambda e: e["_el"])
    return merged.groupBy(*keys).agg(
        F.when(F.bool_or("_present"), elements_in_order).alias(column)
    )


def _merge_env(docs: DataFrame, keys: list[str], layer: str, column: str) -> DataFrame:
    """Merge lists of name and value: the last value per name, sorted by name."""
    entries = docs.select(
        *keys,
        layer,
        F.col(column).isNotNull().alias("_present"),
        F.posexplode_outer(column).alias("_pos", "_el"),
    )
    last = entries.groupBy(*keys, F.col("_el.name").alias("name")).agg(
        F.max_by(F.col("_el.value"), F.struct(layer, "_pos")).alias("value"),
        F.bool_or("_present").alias("_present"),
    )
    pairs = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))
    return last.groupBy(*keys).agg(
        F.when(F.bool_or("_present"), F.array_sort(pairs)).alias(column)
    )


def _merge(docs: DataFrame, keys: list[str], layer: str, rules: Mapping[str, str]) -> DataFrame:
    """Merge by groups of rules and bring the groups together.

    Each group gives one row per key, partitioned by it, so joining them adds no
    shuffle.
    """
    parts = []
    if rows := {c: rule for c, rule in rules.items() if rule not in (*ENTRY_RULES, _UNION_BASE)}:
        merged = (
            _row_rule(F.col(c), F.col(layer), rule).alias(c)
            for c, rule in rows.items()
        )
        parts.append(docs.groupBy(*keys).agg(*merged))
    if maps := [c for c, rule in rules.items() if rule == "union"]:
        parts.append(_merge_maps(docs, keys, layer, maps))
    if maps := [c for c, rule in rules.items() if rule == _UNION_BASE]:
        parts.append(_merge_maps(docs, keys, layer, maps, F.min_by))
    parts += [_merge_named(docs, keys, layer, c) for c, rule in rules.items() if rule == "named"]
    parts += [_merge_env(docs, keys, layer, c) for c, rule in rules.items() if rule == "env"]
    return reduce(lambda left, right: _together(left, right, keys), parts)


def _together(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the same key side by side; a null key is a key like any other."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(right, same).drop(*(f"_r_{k}" for k in keys))


def layered_merge(
    docs: DataFrame, key: str | list[str], layer: str, rules: Mapping[str, str]
) -> DataFrame:
    """One document per key out of its layers; see the table of rules above.

    ``docs`` has one row per key and layer. Scalars are merged with a map-side
    part, maps and named lists entry by entry. The only thing collected per key
    is what the result of that key holds anyway. A column of a struct may be
    named with a dot and comes out under that name.

    ``docs`` is read once for all scalars and arrays, once for all maps, and once
    per list, each time with the columns needed; checkpoint it first if reading
    it is expensive.
    """
    keys = [key] if isinstance(key, str) else key
    unknown = set(rules.values()) - set(ROW_RULES) - set(ENTRY_RULES)
    if unknown:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    # Dots would be read as struct access later on, so work with plain names.
    names = {column: column.replace(".", "__") for column in rules}
    flat = docs.select(*keys, layer, *(F.col(c).alias(n) for c, n in names.items()))
    merged = _merge_fragments(flat, keys, layer, {names[c]: rule for c, rule in rules.items()})
    return merged.select(*keys, *(F.col(n).alias(c) for c, n in names.items()))


def precedence_stack(sources: list[DataFrame], key: str, conf: str) -> DataFrame:
    """Merge settings from several tables; a later table overrides an earlier one."""
    stacked = sources[0].select(key, conf, F.lit(0).alias("layer"))
    for layer, source in enumerate(sources[1:], start=1):
        stacked = stacked.unionByName(source.select(key, conf, F.lit(layer).alias("layer")))
    return layered_merge(stacked, key, "layer", {conf: "union"})


def merge_once(
    docs: DataFrame,
    ledger: DataFrame,
    key: str,
    layer: str,
    rules: Mapping[str, str],
    name: str = "name",
) -> DataFrame:
    """Merge the keys the ledger does not hold yet and record the layers applied.

    The column ``applied`` lists the names of the layers in order, without the
    own document, which has none. A document that does not ask for a merge, or
    whose layers are all missing, stays as it is. The keys to merge are found and written once,
    since the merge reads its input several times.
    """
    fresh = checkpoint(not_yet_processed(docs, ledger, key))
    recorded = fresh.withColumn(
        "applied", F.when(F.col(name).isNotNull(), F.array(name)).otherwise(F.array())
    )
    return layered_merge(recorded, key, layer, {**rules, "applied": "concat"})
