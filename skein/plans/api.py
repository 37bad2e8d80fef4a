"""Registered queries for what is no statement by itself: tables from Python, results, arguments, tokens and errors."""

from __future__ import annotations

import dataclasses
from typing import Any, Optional

from pyspark.sql import DataFrame, SparkSession

from ..args import named, required_args
from ..database import Database
from ..errors import EngineError, ParseError
from ..lexer import tokens
from ..sources.tables import build_map_table, build_table


@dataclasses.dataclass
class Place:
    street: str
    number: int


@dataclasses.dataclass
class Shop:
    id: int
    name: str
    place: Place
    goods: list[str]
    rating: Optional[float]
    note: Any
    till: int = dataclasses.field(default=0, metadata={"name": "cash"})
    key: str = dataclasses.field(default="", metadata={"omit": True})


SHOPS = [
    Shop(1, "Bakery", Place("Mill Lane", 3), ["bread", "pie"], 4.5, {"open": 7}, 120),
    Shop(2, "Forge", Place("Hill", 8), [], None, "by order", 40),
    Shop(3, "Chandler", Place("Quay", 1), None, 3.0, None, 75),
]
MAPS = [{"Name": "oak", "rings": 120, "Size": {"h": 20}}, {"name": "ash", "rings": None, "size": {"h": 15}}, {"NAME": "elm", "size": None, "marks": ["x", "y"]}]


def shops(spark: SparkSession) -> Database:
    db = Database(spark)
    db.register("shops", build_table(spark, Shop, SHOPS))
    db.register("trees", build_map_table(spark, MAPS))
    return db


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql(rows: list[tuple], columns: str) -> str:
    """The same rows as SQL."""

    def shown(v: Any) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({columns})"


def _schema(spark: SparkSession, _: str) -> DataFrame:
    found = [(n, i, f.name, f.dataType.simpleString(), f.nullable, len(t)) for n, t in (("shops", build_table(spark, Shop, SHOPS)), ("trees", build_map_table(spark, MAPS))) for i, f in enumerate(t.schema)]
    return _values(spark, found, "tab string, place long, name string, kind string, nullable boolean, n long")


_SCHEMA = [
    ("shops", 0, "id", "bigint", False, 3), ("shops", 1, "name", "string", False, 3), ("shops", 2, "place", "struct<street:string,number:bigint>", False, 3), ("shops", 3, "goods", "array<string>", False, 3),
    ("shops", 4, "rating", "double", True, 3), ("shops", 5, "note", "variant", True, 3), ("shops", 6, "cash", "bigint", False, 3),
    ("trees", 0, "marks", "array<string>", True, 3), ("trees", 1, "Name", "string", False, 3), ("trees", 2, "rings", "bigint", True, 3), ("trees", 3, "Size", "map<string,bigint>", True, 3),
]


def _maps(spark: SparkSession, _: str) -> DataFrame:
    found = shops(spark).query("select NAME, len(goods), cash, cash + 1, place.street as street, id as cash from shops order by id")
    rows = [(row["NAME"], row["len"], row["cash"], row["expr4"], row["street"], len(row)) for row in found.maps()]
    return _values(spark, rows, "name string, len long, cash long, expr4 long, street string, keys long")


@dataclasses.dataclass
class Till:
    name: str
    cash: float
    note: Optional[str] = None


def _scan(spark: SparkSession, _: str) -> DataFrame:
    db = shops(spark)
    rows = [(t.name, int(t.cash), t.note) for t in db.query("select name, cash as CASH from shops order by cash").scan(Till)]
    for sql in ("select id from shops", "select rating as cash, name from shops", "select cash as name from shops"):
        rows.append((sql, 0, _refusal(lambda sql=sql: db.query(sql).scan(Till))))
    return _values(spark, rows, "name string, cash long, note string")


def _refusal(act) -> str:
    """The kind of error that an act raises."""
    try:
        act()
    except EngineError as e:
        return type(e).__name__
    return "none"


REFUSED = {
    "EngineError": (
        "select n.n_name from nation", "select nation.n_name from nation n", "select n_name from nation, nation r", "select a from world.nation", "select n_name from nowhere", "select *, count(*) as n from nation", "select sum(n_name) from nation", "select max(*) from nation", "select count(n_name, n_regionkey) from nation",
        "select max(count(*)) from nation", "select n_name from nation where count(*) > 1", "select n_name from nation group by n_regionkey", "select count(*) from nation group by count(*)", "select n_name from nation n right join unnest(n.n_name) x on true", "select n_name from nation n join unnest(n.n_name) x on true",
        "select x.value from explode(n_name) x", "select n_name from nation limit 1 + 1", "select n_name from nation limit -1", "select n_name from nation limit n_regionkey", "select nope(n_name) from nation", "select len(n_name, 1) from nation", "select n_name - 1 from nation", "select not n_name from nation", "select (select n_name, n_regionkey from nation) from nation",
    ),
    "UnsupportedError": ("select (select (select r.r_name from region r where r.r_regionkey = n.n_regionkey) from region x limit 1) as y from nation n",),
    "ParseError": (
        "select 1", "select a from t union select a from t", "with t as (select a from u) select a from t", "select a from t where a between 1 and 2", "select a from t where a like 'x'", "select case when a then b from t", "select a from t where exists (select a from t)", "select a from t where a in (select a from t)", "select cast(a as int) from t", "select a from t limit 1 offset 1",
        "select a from t full join u on true", "select a from t cross join u", "select a from t natural join u", "select a from t join u using (a)", "select 1.5 from t", "select a from t where a <> 1", "select a % 2 from t", "select a || b from t", 'select "a" from t', "select a from t -- done", "insert into t select a from u", "select t.* from t", "select * as x from t", "select a from (select a from t)", "select rank() over (order by a) from t",
    ),
}


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    for name in ("nation", "region"):
        db.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return _values(spark, [(sql, _refusal(lambda sql=sql: db.query(sql))) for found in REFUSED.values() for sql in found], "statement string, error string")


ARGUMENTS = (
    ((1,), {"k": 2}, "none"), ((), {"k": 2}, "EngineError"), ((1, 2), {"k": 2}, "EngineError"), ((1,), {}, "EngineError"), ((1,), {"k": 2, "other": 3}, "EngineError"), ((1, named("K", 2)), {}, "none"), ((named("k", 2), 1), {}, "EngineError"), ((1, named("k", 2)), {"K": 3}, "EngineError"),
)


def _arguments(spark: SparkSession, _: str) -> DataFrame:
    sql = "select ? as a, @K as b, @k as c from shops where id = 1"
    n, names = required_args(sql)
    rows = [(-1, f"{n} {','.join(names)}")] + [(i, _refusal(lambda args=args, by_name=by_name: shops(spark).query(sql, *args, **by_name))) for i, (args, by_name, _) in enumerate(ARGUMENTS)]
    return _values(spark, rows, "place long, outcome string")


_TEXT = "select 'é''s', @arg, n1 from t where x >= 10 and y != ?;"
_TOKENS = [
    ("keyword", "select", 0, 6), ("string", "é's", 7, 14), ("symbol", ",", 14, 15), ("arg", "arg", 16, 20), ("symbol", ",", 20, 21), ("name", "n1", 22, 24), ("keyword", "from", 25, 29), ("name", "t", 30, 31), ("keyword", "where", 32, 37), ("name", "x", 38, 39),
    ("symbol", ">=", 40, 42), ("number", "10", 43, 45), ("keyword", "and", 46, 49), ("name", "y", 50, 51), ("symbol", "!=", 52, 54), ("symbol", "?", 55, 56), ("symbol", ";", 56, 57), ("end", "", 57, 57),
]
_ERRORS = "select a, from t where b > group by (c order by limit 3"
_FOUND = [("from", 10, 14), ("group", 27, 32), ("order", 39, 44), ("limit", 48, 53)]


def _parse_errors(spark: SparkSession, _: str) -> DataFrame:
    try:
        required_args(_ERRORS)
    except ParseError as e:
        return _values(spark, [(x.found, *x.span) for x in e.errors], "found string, start long, stop long")
    raise AssertionError(_ERRORS)


#: Name to the query and its SQL.
CASES = {
    "q_build_table": (lambda spark, _: shops(spark).query("select id, name, place.number as number, len(goods) as n, rating, note.open is 7 as seven, note is 'by order' as ordered, cash from shops where cash > 20").df, _sql([(1, "Bakery", 3, 2, True, False, 120), (2, "Forge", 8, 0, False, True, 40), (3, "Chandler", 1, 0, False, False, 75)], "id, name, number, n, seven, ordered, cash").replace("SELECT *", "SELECT *, CASE id WHEN 1 THEN 4.5::DOUBLE WHEN 3 THEN 3.0 END AS rating")),
    "q_map_table": (lambda spark, _: shops(spark).query("select Name, RINGS as rings, size.h as h, contains(marks, 'y') as y from trees").df, _sql([("oak", 120, 20, None), ("ash", None, 15, None), ("elm", None, None, True)], "Name, rings, h, y")),
    "q_table_schema": (_schema, _sql(_SCHEMA, "tab, place, name, kind, nullable, n")),
    "q_result_maps": (_maps, _sql([("Bakery", 2, 1, 121, "Mill Lane", 5), ("Forge", 0, 2, 41, "Hill", 5), ("Chandler", 0, 3, 76, "Quay", 5)], "name, len, cash, expr4, street, keys")),
    "q_result_scan": (_scan, _sql([("Forge", 40, None), ("Chandler", 75, None), ("Bakery", 120, None), ("select id from shops", 0, "EngineError"), ("select rating as cash, name from shops", 0, "EngineError"), ("select cash as name from shops", 0, "EngineError")], "name, cash, note")),
    "q_refused": (_refused, _sql([(sql, error) for error, found in REFUSED.items() for sql in found], "statement, error")),
    "q_arguments": (_arguments, _sql([(-1, "1 K"), *((i, outcome) for i, (_, _, outcome) in enumerate(ARGUMENTS))], "place, outcome")),
    "q_tokens": (lambda spark, _: _values(spark, [(t.kind, t.text, t.start, t.stop) for t in tokens(_TEXT)], "kind string, text string, start long, stop long"), _sql(_TOKENS, "kind, text, start, stop")),
    "q_parse_errors": (_parse_errors, _sql(_FOUND, "found, start, stop")),
}
