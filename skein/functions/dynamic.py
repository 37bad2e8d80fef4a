"""SQL over values whose type shows only in the row (VARIANT).

A value's family is that of its kind in the row: whole, real, string, bool, or other (lists and maps). Families never
mix: a comparison across them is false, arithmetic across them and aggregates over values that don't go together
raise. A column is never read as another family by a cast.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Families by the names that Spark gives a variant's kind.
_NAMES = {
    "whole": "= 'BIGINT'",
    "real": "RLIKE '^(DECIMAL|DOUBLE|FLOAT)'",
    "string": "= 'STRING'",
    "bool": "= 'BOOLEAN'",
}
_TYPES = {"whole": "bigint", "real": "double", "string": "string", "bool": "boolean"}
#: One bit for each family, so that bit_or shows which occur.
_BITS = {"whole": 1, "real": 2, "string": 4, "bool": 8}


def is_dynamic(kind: T.DataType) -> bool:
    return isinstance(kind, T.VariantType)


def _is(v: str, family: str) -> str:
    return f"(schema_of_variant({v}) {_NAMES[family]})"


def part(v: str, family: str) -> str:
    """The value if it is of a family, else NULL."""
    return f"(CASE WHEN {_is(v, family)} THEN try_variant_get({v}, '$', '{_TYPES[family]}') END)"


def number(v: str) -> str:
    """A whole or real number as a double, else NULL."""
    return f"coalesce(CAST({part(v, 'whole')} AS DOUBLE), {part(v, 'real')})"


def refuse(message: str, kind: str) -> str:
    return f"CAST(raise_error('{message}') AS {kind})"


def field(v: str, keys: tuple[str, ...]) -> str:
    """A value within; one that isn't there, and a JSON null, are NULL."""
    way = "".join(f'["{k}"]' for k in keys)
    found = f"try_variant_get({v}, '${way}', 'variant')"
    return f"(CASE WHEN NOT is_variant_null({found}) THEN {found} END)"


def elements(v: str) -> str:
    """An array of variants, or NULL; anything but a list is refused."""
    return f"(CASE WHEN {v} IS NULL THEN NULL WHEN schema_of_variant({v}) LIKE 'ARRAY<%' THEN transform(try_variant_get({v}, '$', 'array<variant>'), x -> CASE WHEN NOT is_variant_null(x) THEN x END) ELSE {refuse('unnest needs a list', 'array<variant>')} END)"


def _families(sides: list[tuple[str, T.DataType, str]], promote: bool) -> list[list[str]]:
    """For each family that all sides may have, the sides as values of it. sides: SQL, type, static family."""
    out = []
    ways = ("number", "string", "bool") if promote else ("whole", "real", "string", "bool")
    for way in ways:
        own = []
        for sql, kind, family in sides:
            if is_dynamic(kind):
                own.append(number(sql) if way == "number" else part(sql, way))
            elif family == way or way == "number" and family in ("whole", "real"):
                own.append(f"CAST({sql} AS DOUBLE)" if way == "number" else sql)
        if len(own) == len(sides):
            out.append(own)
    return out


def compared(op: str, sides: list[tuple[str, T.DataType, str]], promote: bool) -> str:
    """A predicate: true where both sides are of one family and op holds."""
    if op == "=" and all(is_dynamic(kind) for _, kind, _ in sides) and not promote:
        # one equality, so that a join stays an equi-join
        a, b = (f"(CASE WHEN {' OR '.join(_is(v, f) for f in _NAMES)} THEN struct({', '.join(part(v, f) for f in _NAMES)}) END)" for v, _, _ in sides)
        return f"({a} = {b})"
    tests = [f"({a} {op} {b})" for a, b in _families(sides, promote)]
    return f"({' OR '.join(tests)})" if tests else "false"


def arithmetic(op: str, sides: list[tuple[str, T.DataType, str]], promote: bool, combine) -> tuple[str, T.DataType]:
    """SQL and type; combine(op, left, right, type name) gives the operation on numbers of one type."""
    (a, a_kind, a_family), (b, b_kind, b_family) = sides
    static = next((f for _, k, f in sides if not is_dynamic(k)), None)
    message = f"{op} needs numbers of one kind"
    if promote:
        both = [number(s) if is_dynamic(k) else f"CAST({s} AS DOUBLE)" for s, k, _ in sides]
        done = combine(op, *both, "double")
        return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {both[0]} IS NULL OR {both[1]} IS NULL THEN {refuse(message, 'double')} ELSE {done} END)", T.DoubleType()
    if static is not None:
        to = "bigint" if static == "whole" else "double"
        both = [part(s, static) if is_dynamic(k) else f"CAST({s} AS {to})" for s, k, _ in sides]
        done = combine(op, *both, to)
        return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {both[0]} IS NULL OR {both[1]} IS NULL THEN {refuse(message, to)} ELSE {done} END)", T.LongType() if static == "whole" else T.DoubleType()
    whole = combine(op, part(a, "whole"), part(b, "whole"), "bigint")
    real = combine(op, part(a, "real"), part(b, "real"), "double")
    cases = f"WHEN {_is(a, 'whole')} AND {_is(b, 'whole')} THEN CAST({whole} AS VARIANT) WHEN {_is(a, 'real')} AND {_is(b, 'real')} THEN CAST({real} AS VARIANT)"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL {cases} ELSE {refuse(message, 'variant')} END)", T.VariantType()


def negative(v: str) -> str:
    cases = " ".join(f"WHEN {_is(v, f)} THEN CAST(-{part(v, f)} AS VARIANT)" for f in ("whole", "real"))
    return f"(CASE WHEN {v} IS NULL THEN NULL {cases} ELSE {refuse('- needs a number', 'variant')} END)"


def boolean(v: str) -> str:
    """The value of a boolean; NULL stays, others are refused."""
    return f"(CASE WHEN {v} IS NULL THEN NULL WHEN {_is(v, 'bool')} THEN {part(v, 'bool')} ELSE {refuse('NOT needs a boolean', 'boolean')} END)"


def order_keys(v: str, promote: bool) -> list[str]:
    """What to sort by: within a family by value; families, which don't compare, one after another."""
    numbers = [number(v)] if promote else [part(v, "whole"), part(v, "real")]
    return [*numbers, part(v, "string"), part(v, "bool")]


def aggregate(name: str, v: str, distinct: str, promote: bool) -> tuple[str, T.DataType]:
    """SUM, AVG, MIN or MAX over values of one family; others are refused."""
    cases = " ".join(f"WHEN {_is(v, f)} THEN {bit}" for f, bit in _BITS.items())
    seen = f"coalesce(bit_or(CASE WHEN {v} IS NULL THEN 0 {cases} ELSE 16 END), 0)"
    numbers = [0, 1, 2] + [3] * promote
    if name == "avg":
        allowed = ", ".join(map(str, numbers))
        return f"(CASE WHEN {seen} IN ({allowed}) THEN avg({distinct}{number(v)}) ELSE {refuse('avg needs numbers of one kind', 'double')} END)", T.DoubleType()
    if name == "sum":
        done = f"CASE {seen} WHEN 1 THEN CAST(sum({distinct}{part(v, 'whole')}) AS VARIANT) WHEN 2 THEN CAST(sum({distinct}{part(v, 'real')}) AS VARIANT)"
        if promote:
            done += f" WHEN 3 THEN CAST(sum({distinct}{number(v)}) AS VARIANT)"
        return f"({done} WHEN 0 THEN NULL ELSE {refuse('sum needs numbers of one kind', 'variant')} END)", T.VariantType()
    done = " ".join(f"WHEN {bit} THEN CAST({name}({part(v, f)}) AS VARIANT)" for f, bit in _BITS.items())
    if promote:
        done += f" WHEN 3 THEN CAST({name}({number(v)}) AS VARIANT)"
    return f"(CASE {seen} {done} WHEN 0 THEN NULL ELSE {refuse(f'{name} needs values that compare', 'variant')} END)", T.VariantType()


def length(v: str) -> str:
    cases = f"WHEN {_is(v, 'string')} THEN octet_length({part(v, 'string')}) WHEN schema_of_variant({v}) LIKE 'ARRAY<%' THEN cardinality(try_variant_get({v}, '$', 'array<variant>')) WHEN schema_of_variant({v}) LIKE 'OBJECT<%' THEN cardinality(try_variant_get({v}, '$', 'map<string,variant>'))"
    return f"CAST(CASE WHEN {v} IS NULL THEN NULL {cases} ELSE {refuse('len needs a string, a list or a map', 'int')} END AS BIGINT)"


def holds(kind: T.DataType, wanted: type) -> bool:
    """Whether a type is or holds another."""
    if isinstance(kind, wanted):
        return True
    if isinstance(kind, T.ArrayType):
        return holds(kind.elementType, wanted)
    if isinstance(kind, T.MapType):
        return holds(kind.valueType, wanted)
    return isinstance(kind, T.StructType) and any(holds(f.dataType, wanted) for f in kind.fields)


def grouped_by(sql: str, kind: T.DataType) -> str:
    """What stands for a value in GROUP BY and DISTINCT: itself, or what tells unequal variants and maps apart."""
    if is_dynamic(kind):
        return f"concat(schema_of_variant({sql}), ' ', to_json({sql}))"
    if isinstance(kind, T.MapType) and not holds(kind.valueType, T.MapType) and not holds(kind.valueType, T.VariantType):
        return f"array_sort(map_entries({sql}))"
    if holds(kind, T.MapType) or holds(kind, T.VariantType):
        return f"to_json({sql})"
    return sql
