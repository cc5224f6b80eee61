"""JSON arrays: repeated elements go, tabular ones become CSV with a schema, long ones keep edges and outliers.

`compress_json_array` does a whole text inside its row; the relations below it (elements, fields, outliers,
kept rows, dropped runs, facts) answer the same questions over tables of arrays.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.kernels import text_kernel
from corpusloom.functions.strict_json import identity, minified, parse, parses_as_number, raw_slices
from corpusloom.plans.levels import FactLimits, JsonLimits

# Words that mark an element as an error.
ERROR_KEYWORDS = ["error", "exception", "failed", "failure", "critical", "fatal", "crash", "panic", "abort", "timeout", "denied", "rejected"]
CREDENTIAL = r"(?i)token|secret|password|passwd|api[_-]?key|auth|credential|session[_-]?id"
_credential = re.compile(CREDENTIAL)
RARE_FIELD, COMMON_FIELD, PARETO, TOP_VALUES, MOST_VALUES = 0.2, 0.8, 0.8, 5, 50


def type_tag(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return "int" if isinstance(value, int) else "float" if isinstance(value, float) else "string" if isinstance(value, str) else "json"


def scalar_text(value) -> str:
    """A value as text: strings as they are, everything else as JSON."""
    return value if isinstance(value, str) else minified(value)


def _cell(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return '"' + value.replace('"', '""') + '"' if re.search('[,"\n\r]', value) else value
    return scalar_text(value)


def csv_schema(items: list) -> str | None:
    """`[N]{name:type?,...}` and a CSV row for each item; None unless there are two or more objects of scalars only."""
    if len(items) < 2 or not all(isinstance(x, dict) for x in items) or any(isinstance(v, (dict, list)) for x in items for v in x.values()):
        return None
    counts = Counter(k for x in items for k in x)
    names = sorted(counts, key=lambda k: (-counts[k], k))
    columns = []
    for k in names:
        tags = {type_tag(x[k]) for x in items if x.get(k) is not None}
        tag = "string" if not tags else tags.pop() if len(tags) == 1 else "json"
        columns.append(f"{k}:{tag}" + ("?" if counts[k] < len(items) or any(k in x and x[k] is None for x in items) else ""))
    rows = [",".join(_cell(x.get(k)) for k in names) + "\n" for x in items]
    return f"[{len(items)}]{{{','.join(columns)}}}\n" + "".join(rows)


def error_positions(items: list) -> list[int]:
    return [i for i, x in enumerate(items) if isinstance(x, dict) and any(k in (s := minified(x).lower()) for k in ERROR_KEYWORDS)]


def rare_values(items: list, name: str) -> list[int]:
    """Positions whose value of a field is outside the few values that cover four fifths of it."""
    values = [(i, "__none__" if x[name] is None else scalar_text(x[name])) for i, x in enumerate(items) if isinstance(x, dict) and name in x]
    distinct = {scalar_text(items[i][name]) for i, _ in values if items[i][name] is not None}
    if not 2 <= len(distinct) <= MOST_VALUES:
        return []
    top, covered, enough = set(), 0, math.ceil(len(values) * PARETO)
    for value, n in sorted(Counter(v for _, v in values).items(), key=lambda x: (-x[1], x[0])):
        top.add(value)
        covered += n
        if covered >= enough:
            break
    return [] if len(top) > TOP_VALUES else [i for i, v in values if v not in top]


def structural_outliers(items: list) -> list[int]:
    """Positions with a rare field or a rare value of a common field, in order."""
    if len(items) < 5:
        return []
    n, counts = len(items), Counter(k for x in items if isinstance(x, dict) for k in x)
    rare = {k for k, c in counts.items() if c < n * RARE_FIELD}
    found = {i for i, x in enumerate(items) if isinstance(x, dict) and rare & x.keys()}
    for name in (k for k, c in counts.items() if c >= n * COMMON_FIELD):
        found.update(rare_values(items, name))
    return sorted(found)


def kept_positions(items: list, edge: int) -> list[int]:
    """First and last `edge` items and up to 2 * edge others: errors first, then structural outliers."""
    kept = {*range(edge), *range(len(items) - edge, len(items))}
    room = 2 * edge
    for i in [*error_positions(items), *structural_outliers(items)]:
        if i not in kept and room:
            kept.add(i)
            room -= 1
    return sorted(kept)


def _dense(values: list[str]) -> bool:
    """Whether the values are one prefix with consecutive numbers of one width."""
    parts = [re.fullmatch(r"(.*?)([0-9]+)", v, re.S) for v in values]
    if not all(p and p[1] and int(p[2]) < 1 << 64 for p in parts):
        return False
    numbers = [int(p[2]) for p in parts]
    return len({(p[1], len(p[2])) for p in parts}) == 1 and max(numbers) - min(numbers) + 1 == len(numbers)


def fact_of(name: str, present: list[str], units: int, limits: FactLimits) -> tuple[int, str] | None:
    """(rank, text) of what is true of a field's values in all dropped units, or None if nothing safe is."""
    if _credential.search(name) or not present:
        return None
    distinct = list(dict.fromkeys(present))
    absent = units - len(present)
    if not absent and len(distinct) == 1:
        return 0, f"{name}={distinct[0]}"
    if all(map(parses_as_number, present)):
        numbers = [float(v) for v in present]
        low = high = 0
        for i, x in enumerate(numbers):
            low = i if x < numbers[low] else low
            high = i if x > numbers[high] else high
        return 1, f"range {name}={present[low]}..{present[high]}"
    unsafe = lambda v: len(v.encode()) >= limits.max_value_len or " " in v
    if len(distinct) == len(present) > limits.max_enum_values:
        low, high = min(distinct), max(distinct)
        if not unsafe(low) and not unsafe(high):
            if _dense(distinct):
                return 2, f"{name}: {low}..{high} all {len(distinct)} present"
            return 2, f"{name}: {len(distinct)} distinct, {low}..{high}"
    if len(distinct) <= limits.max_enum_values and not any(map(unsafe, distinct)):
        counts = Counter(present)
        parts = [f"{v}×{counts[v]}" for v in distinct] + ([f"absent×{absent}"] if absent else [])
        return 3, f"{name}: {' '.join(parts)}"
    return None


def describe(units: list[list[tuple[str, str]]], limits: FactLimits = FactLimits()) -> str | None:
    """Facts about units of (name, source text) pairs: constants, ranges, coverage, enumerations, until one does not fit."""
    names = list(dict.fromkeys(k for u in units for k, _ in u))
    fields = [dict(reversed(u)) for u in units]
    facts = [f for k in names if (f := fact_of(k, [u[k] for u in fields if k in u], len(units), limits))]
    out, used = [], 0
    for _, text in sorted(facts, key=lambda f: f[0]):
        cost = len(text.encode()) + bool(out)
        if used + cost > limits.max_marker_bytes:
            break
        used += cost
        out.append(text)
    return " ".join(out) or None


def unique_elements(elements: list) -> list[int]:
    """Positions of the first of each set of equal elements."""
    seen: dict = {}
    for i, x in enumerate(elements):
        seen.setdefault(identity(x), i)
    return list(seen.values())


def compress_json_array(text: str, limits: JsonLimits = JsonLimits()) -> tuple[str, str, int, int] | None:
    """compressed, source (json or json-csv-schema), elements_before, elements_after; None unless the text is a JSON array."""
    ok, elements = parse(text.strip())
    if not ok or not isinstance(elements, list):
        return None
    at = unique_elements(elements)
    items = [elements[i] for i in at]
    if (csv := csv_schema(items)) is not None:
        plain = len(minified(items).encode())
        if 1.0 - len(csv.encode()) / plain >= limits.min_savings:
            return csv, "json-csv-schema", len(elements), len(items)
    out = items
    if len(items) > 2 * limits.keep_edge:
        raw = raw_slices(text.strip())
        kept, out, run = set(kept_positions(items, limits.keep_edge)), [], []

        def close() -> None:
            if run:
                facts = describe([raw[at[i]] for i in run if raw[at[i]] is not None], limits.facts)
                out.append(f"...{len(run)} more elements omitted" + (f" ({facts})..." if facts else "..."))
                run.clear()

        for i, x in enumerate(items):
            if i in kept:
                close()
                out.append(x)
            else:
                run.append(i)
        close()
    return minified(out), "json", len(elements), len(out)


JSON_FIELDS = "compressed string, source string, elements_before long, elements_after long"


def json_kernel(limits: JsonLimits = JsonLimits()):
    return text_kernel(lambda t: compress_json_array(t, limits) or (None,) * 4, JSON_FIELDS)


def compress_json(docs: DataFrame, limits: JsonLimits = JsonLimits(), text: str = "text") -> DataFrame:
    """Adds the fields of JSON_FIELDS; all null where the text is no JSON array."""
    return docs.withColumn("__j", json_kernel(limits)(F.col(text))).select(*docs.columns, "__j.*")


def _elements(text: str):
    ok, value = parse(text.strip())
    if not ok or not isinstance(value, list):
        return []
    raw = raw_slices(text.strip())
    out = []
    for i, x in enumerate(value):
        fields = []
        if isinstance(x, dict):
            source = dict(raw[i])
            fields = [(k, None if x[k] is None else scalar_text(x[k]), type_tag(x[k]) if x[k] is not None else "null", source[k]) for k in sorted(x)]
        out.append((i, minified(x), isinstance(x, dict), str(hash_key(x)), fields))
    return out


def hash_key(value) -> str:
    """Text that is equal iff two values are; -0.0 counts as 0.0."""
    return repr(identity(value))


_ELEMENTS = "array<struct<pos:int,json:string,is_object:boolean,same:string,fields:array<struct<name:string,value:string,tag:string,raw:string>>>>"


def json_elements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row an element of each array: key, pos, json (sorted keys), is_object, same, fields(name, value, tag, raw)."""
    rows = docs.select(key, text_kernel(_elements, _ELEMENTS)(F.col(text)).alias("e"))
    return rows.select(key, F.explode("e").alias("e")).select(key, "e.*")


def distinct_elements(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first of equal elements of an array; adds n_equal, item (its place among those kept) and n (how many are kept)."""
    same = Window.partitionBy(key, "same").orderBy("pos")
    first = elements.withColumn("__r", F.row_number().over(same)).withColumn("n_equal", F.count(F.lit(1)).over(Window.partitionBy(key, "same")))
    first = first.where("__r = 1").drop("__r")
    return first.withColumn("item", (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).cast("int")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))


def json_fields(items: DataFrame, key: str = "doc_id") -> DataFrame:
    return items.select(key, "item", "n", F.explode("fields").alias("f")).select(key, "item", "n", "f.*")


def rare_fields(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name, present, n of the fields that fewer than a fifth of an array's items have (arrays of five or more)."""
    counts = json_fields(items, key).groupBy(key, "name").agg(F.count(F.lit(1)).alias("present"), F.first("n").alias("n"))
    return counts.where((F.col("n") >= 5) & (F.col("present") < F.col("n") * RARE_FIELD))


def rare_status(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name, value, present of the rare values of common fields, by the Pareto rule; a null value is `__none__`."""
    fields = json_fields(items, key).where("n >= 5").withColumn("value", F.coalesce("value", F.lit("__none__")))
    fields = fields.withColumn("is_null", F.col("tag") == "null")
    counts = fields.groupBy(key, "name", "value").agg(F.count(F.lit(1)).alias("present"), F.first("n").alias("n"), F.min("is_null").alias("null_only"), F.max((~F.col("is_null")).cast("int")).alias("real"))
    whole = Window.partitionBy(key, "name")
    ranked = whole.orderBy(F.col("present").desc(), "value").rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("total", F.sum("present").over(whole)).withColumn("kinds", F.sum("real").over(whole)).withColumn("through", F.sum("present").over(ranked)).withColumn("rank", F.row_number().over(whole.orderBy(F.col("present").desc(), "value")))
    c = c.withColumn("top", F.col("through") - F.col("present") < F.ceil(F.col("total") * PARETO))
    c = c.withColumn("n_top", F.sum(F.col("top").cast("int")).over(whole))
    good = (F.col("total") >= F.col("n") * COMMON_FIELD) & F.col("kinds").between(2, MOST_VALUES) & (F.col("n_top") <= TOP_VALUES) & ~F.col("top")
    return c.where(good).select(key, "name", "value", "present")


def outlier_items(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, item, tier of items worth keeping: 0 for errors, 1 for structural outliers."""
    errors = items.where(F.col("is_object") & F.lower("json").rlike("|".join(ERROR_KEYWORDS))).select(key, "item", F.lit(0).alias("tier"))
    fields = json_fields(items, key).withColumn("value", F.coalesce("value", F.lit("__none__")))
    by_field = fields.join(rare_fields(items, key).select(key, "name"), [key, "name"], "left_semi").select(key, "item")
    by_value = fields.join(rare_status(items, key).select(key, "name", "value"), [key, "name", "value"], "left_semi").select(key, "item")
    structural = by_field.union(by_value).distinct().withColumn("tier", F.lit(1))
    return errors.unionByName(structural).groupBy(key, "item").agg(F.min("tier").alias("tier"))


def _tiers(items: DataFrame, key: str) -> DataFrame:
    """`items` (key, pos, item, n, json, is_object, fields) with tier: 0 for errors, 1 for structural outliers, else null.

    The rules of `rare_fields` and `rare_status` as windows over the fields, so arrays are parsed once; one shuffle
    by array and field serves all of them. Rows of one value stand together by falling count, so the rows before a
    value's first are those of the values before it.
    """
    error = F.col("is_object") & F.lower("json").rlike("|".join(ERROR_KEYWORDS))
    rows = items.select(key, "pos", "item", "n", "json", "is_object", error.alias("error"), F.explode_outer("fields").alias("f"))
    rows = rows.withColumn("name", F.col("f.name")).withColumn("value", F.coalesce("f.value", F.lit("__none__"))).withColumn("null", F.col("f.tag") == "null")
    field, value = Window.partitionBy(key, "name"), Window.partitionBy(key, "name", "value")
    rows = rows.repartition(key, "name")
    rows = rows.withColumn("total", F.count("name").over(field)).withColumn("c", F.count(F.lit(1)).over(value))
    by_count = field.orderBy(F.col("c").desc(), "value")
    rows = rows.withColumn("kind", F.dense_rank().over(by_count)).withColumn("top", F.rank().over(by_count) - 1 < F.ceil(F.col("total") * PARETO))
    only_null = F.max(F.col("null").cast("int")).over(field) - F.max((~F.col("null") & (F.col("value") == "__none__") & F.col("null").isNotNull()).cast("int")).over(field)
    kinds = F.max("kind").over(field) - F.greatest(only_null, F.lit(0))
    rows = rows.withColumn("kinds", kinds).withColumn("n_top", F.max(F.when(F.col("top"), F.col("kind"))).over(field))
    rare = F.col("total") < F.col("n") * RARE_FIELD
    odd = (F.col("total") >= F.col("n") * COMMON_FIELD) & F.col("kinds").between(2, MOST_VALUES) & (F.col("n_top") <= TOP_VALUES) & ~F.col("top")
    outlier = F.col("name").isNotNull() & (F.col("n") >= 5) & (rare | odd)
    whole = rows.groupBy(key, "item").agg(
        *[F.first(c).alias(c) for c in ("pos", "n", "json", "is_object")],
        F.array_sort(F.collect_list("f")).alias("fields"),
        F.min(F.when(F.col("error"), 0).when(outlier, 1)).alias("tier"),
    )
    return whole.select(key, "pos", "item", "n", "json", "is_object", "fields", "tier")


def row_selection(items: DataFrame, edge: int = 5, key: str = "doc_id") -> DataFrame:
    """`items` with kept: all of a short array; else the edges and the first 2 * edge others by tier and place."""
    rows = _tiers(items, key)
    at_edge = (F.col("item") < edge) | (F.col("item") >= F.col("n") - edge) | (F.col("n") <= 2 * edge)
    rows = rows.withColumn("edge", at_edge)
    claim = Window.partitionBy(key).orderBy((F.col("edge") | F.col("tier").isNull()).cast("int"), "tier", "item")
    rows = rows.withColumn("__claim", F.row_number().over(claim))
    kept = F.col("edge") | (F.col("tier").isNotNull() & (F.col("__claim") <= 2 * edge))
    return rows.withColumn("kept", kept).drop("edge", "__claim", "tier")


def dropped_runs(selected: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, run (from 1), item for the dropped items: gaps and islands."""
    dropped = selected.where("not kept")
    order = Window.partitionBy(key).orderBy("item")
    island = dropped.withColumn("__g", F.col("item") - F.row_number().over(order))
    return island.withColumn("run", F.dense_rank().over(Window.partitionBy(key).orderBy("__g"))).drop("__g")


def invariant_facts(runs: DataFrame, limits: FactLimits = FactLimits(), key: str = "doc_id") -> DataFrame:
    """key, run, name, kind (constant, range, coverage, enumeration), fact for each dropped run and field.

    Text is compared by code points; credentials and unsafe values are withheld.
    """
    units = runs.where("is_object").withColumn("units", F.count(F.lit(1)).over(Window.partitionBy(key, "run")))
    fields = units.select(key, "run", "item", "units", F.explode("fields").alias("f")).select(key, "run", "item", "units", "f.name", "f.raw")
    fields = fields.where(~F.col("name").rlike(CREDENTIAL))
    number = F.col("raw").rlike(r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\z")
    fields = fields.withColumn("num", F.when(number, F.col("raw").try_cast("double")))
    values = fields.groupBy(key, "run", "name", "raw").agg(F.count(F.lit(1)).alias("c"), F.min("item").alias("first"), F.first("num").alias("num"), F.first("units").alias("units"))
    unsafe = (F.octet_length("raw") >= limits.max_value_len) | F.contains("raw", F.lit(" "))
    prefix, digits = F.regexp_extract("raw", r"(?s)^(.*?)([0-9]+)\z", 1), F.regexp_extract("raw", r"(?s)^(.*?)([0-9]+)\z", 2)
    facts = values.groupBy(key, "run", "name").agg(
        F.first("units").alias("units"),
        F.sum("c").alias("present"),
        F.count(F.lit(1)).alias("distinct"),
        F.min("raw").alias("low"),
        F.max("raw").alias("high"),
        F.max_by("raw", F.struct(-F.col("num"), -F.col("first"))).alias("least"),
        F.max_by("raw", F.struct(F.col("num"), -F.col("first"))).alias("most"),
        F.min(F.col("num").isNotNull()).alias("numeric"),
        F.max(unsafe).alias("unsafe"),
        F.array_sort(F.collect_list(F.struct("first", "raw", "c"))).alias("counts"),
        F.min((prefix != "") & (digits != "")).alias("numbered"),
        F.count_distinct(prefix, F.length(digits)).alias("shapes"),
        (F.max(digits.try_cast("decimal(38,0)")) - F.min(digits.try_cast("decimal(38,0)")) + 1).alias("span"),
    )
    long = lambda c: (F.octet_length(c) >= limits.max_value_len) | F.contains(F.col(c), F.lit(" "))
    absent = F.col("units") - F.col("present")
    constant = (absent == 0) & (F.col("distinct") == 1)
    coverage = (F.col("distinct") == F.col("present")) & (F.col("present") > limits.max_enum_values) & ~long("low") & ~long("high")
    listed = (F.col("distinct") <= limits.max_enum_values) & ~F.col("unsafe")
    kind = F.when(constant, "constant").when(F.col("numeric"), "range").when(coverage, "coverage").when(listed, "enumeration")
    dense = F.col("numbered") & (F.col("shapes") == 1) & (F.col("span") == F.col("distinct"))
    parts = F.concat(F.transform("counts", lambda x: F.concat(x["raw"], F.lit("×"), x["c"].cast("string"))), F.when(absent > 0, F.array(F.concat(F.lit("absent×"), absent.cast("string")))).otherwise(F.array().cast("array<string>")))
    text = (
        F.when(F.col("kind") == "constant", F.concat("name", F.lit("="), "low"))
        .when(F.col("kind") == "range", F.concat(F.lit("range "), "name", F.lit("="), "least", F.lit(".."), "most"))
        .when((F.col("kind") == "coverage") & dense, F.concat("name", F.lit(": "), "low", F.lit(".."), "high", F.lit(" all "), F.col("distinct").cast("string"), F.lit(" present")))
        .when(F.col("kind") == "coverage", F.concat("name", F.lit(": "), F.col("distinct").cast("string"), F.lit(" distinct, "), "low", F.lit(".."), "high"))
        .otherwise(F.concat("name", F.lit(": "), F.array_join(parts, " ")))
    )
    return facts.withColumn("kind", kind).where("kind is not null").withColumn("fact", text).select(key, "run", "name", "kind", "fact")
