"""The dialect on tables of a harbour: each rule of its semantics, joins, dynamic values, errors and the Python API."""

import dataclasses
import datetime as dt
from typing import Any, Optional

import pytest

from skein import Database, EngineError, ParseError, UnsupportedError, build_map_table, build_table, named, required_args


@dataclasses.dataclass
class Boat:
    id: int
    name: str
    tons: int
    moored: bool
    port_id: Optional[int]
    call_sign: str = dataclasses.field(default="-", metadata={"name": "radio"})
    owner: str = dataclasses.field(default="", metadata={"omit": True})


@dataclasses.dataclass
class Port:
    id: int
    name: str
    depth: float


@dataclasses.dataclass
class Cargo:
    boat_id: int
    items: list[str]


@dataclasses.dataclass
class Berth:
    dock: str
    number: int


@dataclasses.dataclass
class Yacht:
    id: int
    berth: Berth
    notes: Any
    flags: list[str]
    spare: Optional[Berth]
    fees: dict[str, int]


@dataclasses.dataclass
class Tide:
    at: dt.datetime
    level: float


BOATS = [Boat(1, "Gannet", 12, True, 10), Boat(2, "Heron", 7, False, 20), Boat(3, "Ibis", 12, True, None), Boat(4, "Jackdaw", 30, False, 10), Boat(5, "Kestrel", 7, True, 20)]
PORTS = [Port(10, "Lerwick", 6.5), Port(20, "Wick", 4.0), Port(30, "Oban", 9.25)]
CARGO = [Cargo(1, ["salt", "rope", "salt"]), Cargo(2, None), Cargo(3, []), Cargo(4, ["tar"])]
YACHTS = [Yacht(1, Berth("N", 4), {"crew": {"cook": "Mo"}, "year": 1999}, ["blue", "peter"], Berth("S", 1), {"water": 3}), Yacht(2, Berth("E", 9), {"year": 2004}, [], None, {})]
MIXED = [
    {"id": 1, "w": 3, "tags": [1, "u"], "box": {"a": 1, "b": [1]}},
    {"id": 2, "w": 2.5, "tags": ["u", "v"], "box": {}},
    {"id": 3, "w": "x", "tags": None, "box": None},
    {"id": 4, "w": True, "tags": [], "box": {"a": "z"}},
    {"id": 5, "w": 3, "tags": [[1], 2.5], "box": {"b": [1], "a": 1}},
    {"id": 6, "w": None, "tags": [None, 7], "box": {"a": None}},
]


@pytest.fixture(scope="module")
def harbours(spark):
    made = {}

    def harbour(mode="reference"):
        if mode not in made:
            db = made[mode] = Database(spark, numeric_mode=mode)
            db.register("boats", build_table(spark, Boat, BOATS))
            db.register("ports", build_table(spark, Port, PORTS))
            db.register("cargo", build_table(spark, Cargo, CARGO))
            db.register("yachts", build_table(spark, Yacht, YACHTS))
            db.register("mixed", build_map_table(spark, MIXED))
            db.register("none", build_table(spark, Boat, []))
            db.register("tides", build_table(spark, Tide, [Tide(dt.datetime(2031, 5, d, 6), d / 4) for d in (9, 2, 23)]))
        return made[mode]

    return harbour


RULES = {
    "comparisons are never null": ("select id, port_id = 10 as a, port_id < 15 as b from boats order by id", (), [(1, True, True), (2, False, False), (3, False, False), (4, True, True), (5, False, False)]),
    "and, or take only true": ("select id from boats where moored and tons or port_id = 20 order by id", (), [(2,), (5,)]),
    "not of a comparison with null": ("select id from boats where not port_id = 10 order by id", (), [(2,), (3,), (5,)]),
    "not binds looser than comparison": ("select id from boats where not tons = 7 and moored order by id", (), [(1,), (3,)]),
    "in": ("select id from boats where port_id in (20, null) order by id", (), [(2,), (5,)]),
    "not in": ("select id from boats where port_id not in (20, null) order by id", (), [(1,), (4,)]),
    "in nothing": ("select id, id in () as a, port_id not in () as b from boats where id > 2 order by id", (), [(3, False, False), (4, False, True), (5, False, True)]),
    "in a subquery's value": ("select id from boats where tons in ((select max(tons) from boats), 7) order by id", (), [(2,), (4,), (5,)]),
    "is": ("select id, port_id is 20 as a, port_id is not 20 as b, port_id is null as c from boats where id < 4 order by id", (), [(1, False, True, False), (2, True, False, False), (3, False, True, True)]),
    "is of other kinds": ("select id from boats where name is not 3 and port_id is null", (), [(3,)]),
    "whole numbers and floats don't compare": ("select id from boats where tons > ?", (6.0,), []),
    "kinds don't compare": ("select id from boats where name = 12 or name != 12 or moored = 1", (), []),
    "structs": ("select a.id from yachts a join yachts b on a.berth = b.berth order by a.id", (), [(1,), (2,)]),
    "structs are never unequal, lists never equal": ("select id from yachts where berth != spare or flags = flags", (), []),
    "whole arithmetic": ("select tons / 5 as a, -tons / 5 as b, tons * 2 - 1 as c from boats where id = 1", (), [(2, -2, 23)]),
    "float division by zero": ("select depth / ? as a, -depth / ? as b from ports where id = 10", (0.0, 0.0), [(float("inf"), float("-inf"))]),
    "arithmetic with null": ("select port_id + 1 as a, -port_id as b, tons - null as c from boats where id = 3", (), [(None, None, None)]),
    "nan is the largest number": ("select count(*) as n from ports where depth < ?", (float("nan"),), [(3,)]),
    "nulls last upwards": ("select id from boats order by port_id, id", (), [(1,), (4,), (2,), (5,), (3,)]),
    "nulls last downwards": ("select id from boats order by port_id desc, id", (), [(2,), (5,), (1,), (4,), (3,)]),
    "an alias goes before a column": ("select -id as id, tons from boats order by id limit 2", (), [(-5, 7), (-4, 30)]),
    "a column goes into an expression": ("select -id as id from boats order by id + 0 limit 1", (), [(-1,)]),
    "numbers in order by are constants": ("select name from boats order by 1, tons desc, name limit 2", (), [("Jackdaw",), ("Gannet",)]),
    "numbers in group by are constants": ("select sum(tons) as t from boats group by 2", (), [(68,)]),
    "distinct keeps the first by an order": ("select distinct moored from boats order by tons desc", (), [(False,), (True,)]),
    "limit after distinct": ("select distinct port_id from boats order by port_id desc limit 2", (), [(20,), (10,)]),
    "nulls are one group": ("select port_id, count(*) as n, count(port_id) as m from boats group by port_id order by port_id", (), [(10, 2, 2), (20, 2, 2), (None, 1, 0)]),
    "an empty table has one total": ("select count(*) as n, sum(tons) as s, min(name) as a from none", (), [(0, None, None)]),
    "an empty table has no groups": ("select tons, count(*) as n from none group by tons", (), []),
    "aggregates of null": ("select count(null) as a, sum(null) as b, count(*) as n from boats", (), [(0, None, 5)]),
    "aggregates of a constant": ("select count(7) as a, sum(2) as b, max('k') as c from boats", (), [(5, 10, "k")]),
    "grouped by an expression": ("select tons + 1 as t, count(*) as n from boats group by tons + 1 order by tons + 1", (), [(8, 2), (13, 2), (31, 1)]),
    "a function of a key": ("select len(name) as l from boats group by name order by len(name) desc, name limit 2", (), [(7,), (7,)]),
    "one key by two names": ("select boats.tons, sum(id) as s from boats group by tons order by boats.tons", (), [(7, 7), (12, 4), (30, 4)]),
    "having alone": ("select max(tons) as t from boats having count(*) > 9", (), []),
    "having": ("select port_id from boats group by port_id having count(*) = 2 and max(tons) > 10", (), [(10,)]),
    "an outer key in a subquery": ("select b.port_id, (select p.name from ports p where p.id = b.port_id) as port, sum(tons) as t from boats b group by b.port_id order by t desc", (), [(10, "Lerwick", 42), (20, "Wick", 14), (None, None, 12)]),
    "an outer column that isn't grouped": ("select moored, (select p.name from ports p where p.id = b.port_id) as p from boats b where b.id < 3 group by moored order by moored", (), [(False, "Wick"), (True, "Lerwick")]),
    "no row is null": ("select (select name from ports where id = 99) as a from ports where id = 10", (), [(None,)]),
    "count of no row is zero": ("select p.id, (select count(*) from boats b where b.port_id = p.id) as n from ports p order by p.id", (), [(10, 2), (20, 2), (30, 0)]),
    "a comma before a join": ("select b.id, p.id, q.id from boats b, ports p join ports q on q.id = p.id + 10 and b.id = 1 order by p.id", (), [(1, 10, 20), (1, 20, 30)]),
    "len counts bytes": ("select len(?) as n, len(name) as m from ports where id = 20", ("håvn",), [(5, 4)]),
    "a list that is none is empty": ("select boat_id, len(items) as n, items is null as a from cargo order by boat_id", (), [(1, 3, False), (2, 0, False), (3, 0, False), (4, 1, False)]),
    "paths": ("select y.berth.dock, BERTH.Number as n, notes.crew.cook as c, spare.dock as s, fees.water as w, fees.Water as x from yachts y order by id", (), [("N", 4, "Mo", "S", 3, None), ("E", 9, None, None, None, None)]),
    "min and max of all kinds": ("select min(b.moored) as a, max(b.moored) as b, min(b.name) as c, max(p.depth) as d from boats b, ports p", (), [(False, True, "Gannet", 9.25)]),
    "sum and avg of floats": ("select sum(depth) as s, avg(depth) as a from ports where id < 30", (), [(10.5, 5.25)]),
    "distinct aggregates": ("select count(distinct tons) as a, sum(distinct tons) as b, avg(distinct tons) as c from boats where id < 4", (), [(2, 19, 9.5)]),
    "expressions over aggregates": ("select sum(tons) / count(*) as a, -max(tons) as b from boats", (), [(13, -30)]),
    "left join": ("select b.name, p.name from boats b left join ports p on p.id = b.port_id and p.depth > ? order by b.id", (5.0,), [("Gannet", "Lerwick"), ("Heron", None), ("Ibis", None), ("Jackdaw", "Lerwick"), ("Kestrel", None)]),
    "right join": ("select b.id, p.id from boats b right join ports p on b.port_id = p.id and b.moored order by p.id", (), [(1, 10), (5, 20), (None, 30)]),
    "theta join": ("select a.id, b.id from boats a join boats b on a.tons > b.tons and a.id < b.id order by a.id, b.id", (), [(1, 2), (1, 5), (3, 5), (4, 5)]),
    "inner join with a subquery in on, then right join": ("select b.id, p.id, q.id from boats b join ports p on p.id = (select min(x.id) from ports x where x.id >= b.port_id) right join ports q on q.id = p.id and b.tons > 10 order by q.id, b.id", (), [(1, 10, 10), (4, 10, 10), (None, None, 20), (None, None, 30)]),
    "left join with a subquery in on": ("select b.id, p.id from boats b left join ports p on p.id = (select min(x.id) from ports x where x.id > b.port_id) order by b.id", (), [(1, 20), (2, 30), (3, None), (4, 20), (5, 30)]),
    "left join with a subquery about the right side": ("select b.id, p.id from boats b left join ports p on p.id = b.port_id and (select count(*) from boats x where x.port_id = p.id and x.moored) = 1 and p.id < (select max(id) from ports) order by b.id", (), [(1, 10), (2, 20), (3, None), (4, 10), (5, 20)]),
    "right join with a subquery in on": ("select b.id, p.id from boats b right join ports p on b.id = (select max(x.id) from boats x where x.port_id = p.id) order by p.id", (), [(4, 10), (5, 20), (None, 30)]),
    "derived table": ("select t.n from (select port_id, count(*) as n from boats group by port_id) t where t.port_id = 20", (), [(2,)]),
    "subquery in order by": ("select b.id from boats b order by (select p.name from ports p where p.id = b.port_id) desc, b.id desc", (), [(5,), (2,), (4,), (1,), (3,)]),
    "unnest": ("select c.boat_id, x.value from cargo c join unnest(c.items) x on x.value != 'rope' order by c.boat_id", (), [(1, "salt"), (1, "salt"), (4, "tar")]),
    "left unnest": ("select c.boat_id, x.value from cargo c left join unnest(c.items) x on x.value = 'tar' order by c.boat_id", (), [(1, None), (2, None), (3, None), (4, "tar")]),
    "unnest, then a join": ("select b.name, x.value from cargo c join unnest(items) x on true join boats b on b.id = c.boat_id and x.value = 'tar'", (), [("Jackdaw", "tar")]),
    "unnest with a condition on both": ("select c.boat_id, x.value from cargo c left join unnest(c.items) x on len(x.value) + c.boat_id = 5 order by c.boat_id", (), [(1, "salt"), (1, "rope"), (1, "salt"), (2, None), (3, None), (4, None)]),
    "unnest with a subquery in on": ("select c.boat_id, x.value from cargo c left join unnest(c.items) x on c.boat_id = (select max(id) from boats where tons = 30) order by c.boat_id", (), [(1, None), (2, None), (3, None), (4, "tar")]),
    "unnest in a correlated subquery": ("select b.id, (select count(*) from cargo c join unnest(c.items) x on true where c.boat_id = b.id) as n from boats b order by b.id", (), [(1, 3), (2, 0), (3, 0), (4, 1), (5, 0)]),
    "unnest of an argument": ("select v.value from unnest(?) v order by v.value desc", ([4, 9, 6],), [(9,), (6,), (4,)]),
    "times": ("select level from tides where at > ? order by at desc", (dt.datetime(2031, 5, 3),), [(5.75,), (2.25,)]),
    "contains": ("select contains(name, 'an') as a, contains(?, id) as b from boats where id < 3 order by id", ([2, 8],), [(True, False), (False, True)]),
    "a limit beyond 32 bits": ("select id from boats order by id desc limit ?", (2**40,), [(5,), (4,), (3,), (2,), (1,)]),
    "a limit beyond 32 bits, with distinct": ("select distinct moored from boats order by moored limit ?", (2**33,), [(False,), (True,)]),
}


@pytest.mark.parametrize("rule", RULES)
def test_rules(harbours, rule):
    sql, args, want = RULES[rule]
    got = harbours().query(sql, *args).rows
    assert sorted(got, key=str) == sorted(want, key=str) if "order by" not in sql else got == want


def test_composite_keys_do_not_run_together(spark):
    db = Database(spark)
    db.register("pairs", build_map_table(spark, [{"a": "k|s:l", "b": "m"}, {"a": "k", "b": "l|s:m"}, {"a": "k", "b": "l|s:m"}]))
    assert sorted(db.query("select a, b, count(*) as n from pairs group by a, b").rows) == [("k", "l|s:m", 2), ("k|s:l", "m", 1)]
    assert db.query("select distinct a, b from pairs").df.count() == 2


DYNAMIC = {
    "whole": ("select id from mixed where w = 3 order by id", (), [(1,), (5,)]),
    "float": ("select id from mixed where w = ? or w < ?", (2.5, 1.0), [(2,)]),
    "text and truth": ("select id from mixed where w = 'x' or w = true or w > 'a' order by id", (), [(3,), (4,)]),
    "unequal within a family only": ("select id from mixed where w != 4 order by id", (), [(1,), (5,)]),
    "with each other": ("select a.id, b.id from mixed a join mixed b on a.w = b.w order by a.id, b.id", (), [(1, 1), (1, 5), (2, 2), (3, 3), (4, 4), (5, 1), (5, 5)]),
    "lists and maps are never equal": ("select a.id from mixed a join mixed b on a.tags = b.tags or a.box = b.box", (), []),
    "in": ("select id from mixed where w in (3, 'x', null) order by id", (), [(1,), (3,), (5,)]),
    "not in": ("select id from mixed where w not in (3, 'x') order by id", (), [(2,), (4,)]),
    "is": ("select id from mixed where w is null or w is 'x' order by id", (), [(3,), (6,)]),
    "a null within is null": ("select id from mixed where box.a is null order by id", (), [(2,), (3,), (6,)]),
    "as a predicate": ("select id from mixed where w", (), [(4,)]),
    "order": ("select id from mixed order by w, id", (), [(1,), (5,), (2,), (3,), (4,), (6,)]),
    "groups": ("select w, count(*) as n, sum(id) as s from mixed group by w order by w", (), [(3, 2, 6), (2.5, 1, 2), ("x", 1, 3), (True, 1, 4), (None, 1, 6)]),
    "groups of maps": ("select box, count(*) as n from mixed where w = 3 group by box", (), [({"a": 1, "b": [1]}, 2)]),
    "distinct": ("select distinct w from mixed where id < 6 order by w", (), [(3,), (2.5,), ("x",), (True,)]),
    "distinct by another order": ("select distinct w from mixed where id < 6 order by id desc", (), [(3,), (True,), ("x",), (2.5,)]),
    "count distinct": ("select count(distinct w) as a, count(w) as b, count(distinct box) as c from mixed", (), [(4, 5, 4)]),
    "len": ("select id, len(tags) as a, len(box) as b from mixed order by id", (), [(1, 2, 2), (2, 2, 0), (3, None, None), (4, 0, 1), (5, 2, 2), (6, 2, 1)]),
    "len of text": ("select len(w) as n from mixed where id = 3", (), [(1,)]),
    "contains": ("select id, contains(tags, 1) as a, contains(tags, 'u') as b, contains(tags, ?) as c from mixed order by id", (2.5,), [(1, True, True, False), (2, False, True, False), (3, None, None, None), (4, False, False, False), (5, False, False, True), (6, False, False, False)]),
    "contains of text": ("select contains(w, 'x') as a from mixed where id = 3", (), [(True,)]),
    "unnest": ("select id, x.value from mixed join unnest(tags) x on true order by id, x.value", (), [(1, 1), (1, "u"), (2, "u"), (2, "v"), (5, 2.5), (5, [1]), (6, 7), (6, None)]),
    "left unnest": ("select id, x.value from mixed left join unnest(tags) x on x.value = 'u' order by id", (), [(1, "u"), (2, "u"), (3, None), (4, None), (5, None), (6, None)]),
    "sum": ("select sum(w) as s, avg(w) as a, min(w) as l, max(w) as h from mixed where w = 3", (), [(6, 3.0, 3, 3)]),
    "sum of floats": ("select sum(w) as s, max(w) as h from mixed where id = 2", (), [(2.5, 2.5)]),
    "max of text": ("select max(w) as h from mixed where id = 3 or id = 6", (), [("x",)]),
    "sum of nothing": ("select sum(w) as s, min(w) as l from mixed where id = 6", (), [(None, None)]),
    "arithmetic": ("select w + 1 as a, w * w as b, -w as c, w / 2 as d from mixed where id = 1", (), [(4, 9, -3, 1)]),
    "arithmetic with floats": ("select w + ? as a, w - w as b, -w as c from mixed where id = 2", (0.5,), [(3.0, 0.0, -2.5)]),
    "not": ("select not w as a from mixed where id = 4", (), [(False,)]),
}


@pytest.mark.parametrize("case", DYNAMIC)
def test_dynamic_values(harbours, case):
    sql, args, want = DYNAMIC[case]
    got = harbours().query(sql, *args).rows
    assert got == want and [[type(v) for v in r] for r in got] == [[type(v) for v in r] for r in want]


@pytest.mark.parametrize("sql", ["select w + 1 as a from mixed where id = 2", "select w + w as a from mixed where id = 3", "select -w as a from mixed where id = 4", "select not w as a from mixed where id = 1", "select sum(w) as a from mixed", "select min(w) as a from mixed", "select avg(w) as a from mixed where id > 2", "select len(w) as a from mixed where id = 1", "select contains(w, 1) as a from mixed where id = 1", "select x.value from mixed join unnest(w) x on true"])
def test_dynamic_values_refused(harbours, sql):
    with pytest.raises(EngineError):
        harbours().query(sql).rows


def test_promoted_numbers(harbours):
    wide = harbours("promote")
    assert wide.query("select id from boats where tons = ? order by id", 12.0).rows == [(1,), (3,)]
    assert wide.query("select tons * ? as x from boats where id = 2", 0.5).rows == [(3.5,)]
    assert wide.query("select id from mixed where w > ? order by w, id", 2.0).rows == [(2,), (1,), (5,)]
    assert wide.query("select sum(w) as s, w + 1 as t from mixed where id = 2 group by w").rows == [(2.5, 3.5)]


BAD = [
    "select id from boats, ports", "select len(*) from boats", "select len(distinct name) from boats", "select max(*) from boats", "select tons from boats having tons = 7", "select *, max(tons) as m from boats group by id",
    "select frob(id) from boats", "select len(name, name) from boats", "select boats.beam from boats", "select b.id from boats x", "select boats.id from boats x", "select id from boats b join unnest(b.tons) t on true", "select id from boats right join unnest(?) t on true",
    "select id from fleet", "select id from boats where max(tons) > 1", "select name - 1 from boats", "select not tons from boats", "select max(count(*)) from boats", "select id from sea.boats", "select name from boats group by tons", "select count(*) from boats group by count(*)",
    "select -name from boats", "select max(berth) from yachts", "select berth.depth from yachts", "select id.x from boats", "select sum(name) from boats", "select len(tons) from boats", "select contains(tons, 1) from boats", "select contains(name, 1) from boats", "select sum(tons) as s from boats having s > 1",
    "select id from boats limit 1 + 1", "select id from boats limit -1", "select id from boats limit name", "select (select id, name from ports) from boats", "select v.value from unnest(1) v", "select v.value from flatten(?) v", "select id from boats b join ports p on count(*) > 1", "select b.x.value from boats b",
    "select tons * ? from boats",
]


@pytest.mark.parametrize("sql", BAD)
def test_refused(harbours, sql):
    args = () if "?" not in sql else (1.5,) if "tons *" in sql else ([1],)
    with pytest.raises(EngineError):
        harbours().query(sql, *args).rows


@pytest.mark.parametrize("sql", ["select (select id from ports) as x from boats", "select tons / 0 as x from boats"])
def test_refused_by_what_the_rows_hold(harbours, sql):
    with pytest.raises(EngineError):
        harbours().query(sql).rows


@pytest.mark.parametrize("value", ["3", True, -1, 2.0, None])
def test_limits_are_whole_numbers(harbours, value):
    with pytest.raises(EngineError):
        harbours().query("select id from boats limit @most", most=value)


UNPARSED = [
    "select 7", "select x from t where x > 0.5", "select x from t where x <> 1", "select x from t union select x from t", "select x from t full join u on true", "select x from t cross join u", "select x from t left outer join u on true", "select x from t natural join u",
    "select x from t where x between 1 and 2", "select x from t where x like 'a'", "select case when x then y from t", "select x from t where exists (select y from u)", "select x from t where x in (select y from u)", "select x from t limit 1 offset 2",
    'select "x" from t', "select x % 2 from t", "select x || y from t", "select * as y from t", "select t.* from t", "select x from (select y from t)", "select x from unnest(y)", "select x from t join u", "select 'x from t", "select x from t extra words", "select 9223372036854775808 from t", "select x from t where", "select x y z from t",
]


@pytest.mark.parametrize("sql", UNPARSED)
def test_not_this_dialect(sql):
    with pytest.raises(ParseError):
        required_args(sql)


def test_all_parse_errors_are_found():
    with pytest.raises(ParseError) as e:
        required_args("select id, from boats where tons > group by (id order by limit 3")
    assert [x.found for x in e.value.errors] == ["from", "group", "order", "limit"]
    assert e.value.errors[0] is e.value and e.value.errors[1].span == (35, 40)


def test_error_spans_count_bytes():
    with pytest.raises(ParseError) as e:
        required_args("select 'ør' as ø from t whore id = 1")
    assert e.value.span == (32, 34) and e.value.found == "id"


def test_arguments(harbours):
    db = harbours()
    sql = "select @word as w, (select @word from ports where id = @Port) as v, id from boats where tons = ? and port_id = @port order by id limit ?"
    assert db.query(sql, 7, 1, named("PORT", 20), word="ahoy").rows == [("ahoy", "ahoy", 2)]
    assert required_args(sql) == (2, ["word", "Port"])
    short = "select id from boats where id = ? and tons = @t"
    for args, by_name in [((1, 2), {"t": 12}), ((), {"t": 12}), ((named("t", 12), 1), {}), ((1, named("t", 12), named("T", 12)), {}), ((1,), {}), ((1,), {"t": 12, "u": 0}), ((1, named(" ", 1)), {"t": 12}), ((2**70,), {"t": 12}), (([1, "x"],), {"t": 12}), ((object(),), {"t": 12})]:
        with pytest.raises(EngineError):
            db.query(short, *args, **by_name)
    assert db.prepare(short) is db.prepare(short)
    assert [db.prepare(short).query(db, i, t=12).rows for i in (1, 2, 3)] == [[(1,)], [], [(3,)]]


def test_names(harbours):
    db = harbours()
    got = db.query("select NAME, count(*), tons + 1, Boats.tons as heavy, boats.Radio from BOATS where MOORED group by name, tons, radio order by name")
    assert [c.name for c in got.columns] == ["NAME", "count", "expr3", "heavy", "Radio"]
    assert got.maps()[0] == {"NAME": "Gannet", "count": 1, "expr3": 13, "heavy": 12, "Radio": "-"}
    assert [c.name for c in db.query("select *, id as again from boats").columns] == ["id", "name", "tons", "moored", "port_id", "radio", "again"]
    assert [c.name for c in db.query("select b.id, p.id from boats b, ports p").columns] == ["id", "id"]
    for name in ("BOATS", " ", ""):
        with pytest.raises(EngineError):
            db.register(name, build_table(db.spark, Port, PORTS))


def test_a_source_goes_before_a_column_in_a_qualified_name(spark):
    db = Database(spark)
    db.register("berth", build_table(spark, Yacht, YACHTS))
    db.register("quays", build_table(spark, Berth, [Berth("N", 1)]))
    # berth is a source with a column berth: berth.berth.number goes through the source, and a lone quays.dock is a column
    assert db.query("select berth.berth.number as n, quays.dock as d from berth, quays order by n").rows == [(4, "N"), (9, "N")]
    with pytest.raises(EngineError):
        db.query("select berth.dock from berth")


@dataclasses.dataclass
class Moored:
    boat: str
    port: Optional[str]
    tons: float = 0.0


def test_scan(harbours):
    db = harbours()
    got = db.query("select b.name as BOAT, p.name as port, b.tons as tons from boats b left join ports p on p.id = b.port_id order by b.id").scan(Moored)
    assert got[0] == Moored("Gannet", "Lerwick", 12.0) and got[2] == Moored("Ibis", None, 12.0)
    for sql in ("select p.name as boat from boats b left join ports p on p.id = b.port_id", "select id from boats", "select id as boat from boats"):
        with pytest.raises(EngineError):
            db.query(sql).scan(Moored)


def test_functions(harbours, spark):
    db = Database(spark)
    db.register("boats", build_table(spark, Boat, BOATS))
    db.register("cargo", build_table(spark, Cargo, CARGO))
    db.register_function("greet", 1, 2, "string", eval=lambda name, mark="!": None if name is None else f"ahoy {name}{mark}")
    db.register_function("half", 1, 1, "bigint", native=lambda x: f"({x} div 2)")
    assert db.query("select greet(name) as a, greet(name, '?') as b, half(tons) as c from boats where id = 2").rows == [("ahoy Heron!", "ahoy Heron?", 3)]
    assert db.query("select x.value from cargo c left join unnest(c.items) x on greet(x.value) = 'ahoy tar!' where c.boat_id = 4").rows == [("tar",)]
    for name in ("SUM", "Greet", "contains", " "):
        with pytest.raises(EngineError):
            db.register_function(name, 1, 1, "string", native=lambda x: x)
    for arguments in ((2, 1, "string", None, str), (-1, 1, "string", None, str), (0, 1, "string", None, None)):
        with pytest.raises(EngineError):
            db.register_function("other", *arguments)
    with pytest.raises(EngineError):
        db.query("select half(1, 2) from boats")


def test_tables(spark):
    boats = build_table(spark, Boat, BOATS)
    assert len(boats) == 5 and [(f.name, f.dataType.simpleString(), f.nullable) for f in boats.schema][3:] == [("moored", "boolean", False), ("port_id", "bigint", True), ("radio", "string", False)]
    for cls, rows in ((dict, []), (Boat, [PORTS[0]]), (Boat, [Boat(1, None, 1, True, 1)])):
        with pytest.raises(EngineError):
            build_table(spark, cls, rows)


def test_map_tables(spark):
    rows = [{"Berth ": 4, "fee": {"water": 2}, "flags": ["a"], "odd": 1}, {"berth": 6, "FEE": {"water": 5}, "flags": []}, {"BERTH": None, "fee": None, "odd": "one"}]
    table = build_map_table(spark, rows)
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in table.schema] == [("Berth", "bigint", True), ("fee", "map<string,bigint>", True), ("flags", "array<string>", True), ("odd", "variant", True)]
    db = Database(spark)
    db.register("quay", table)
    assert db.query("select berth, fee.water, len(flags) as f, odd from quay order by fee.water desc").rows == [(6, 5, 0, None), (4, 2, 1, 1), (None, None, None, "one")]
    assert sorted(db.query("select distinct fee from quay where berth is not null").rows, key=str) == [({"water": 2},), ({"water": 5},)]
    assert db.query("select fee, count(*) as n from quay where berth = 4 group by fee").rows == [({"water": 2}, 1)]
    for bad in ([{"x": 1, "X": 2}], [{"  ": 1}], [{}], []):
        with pytest.raises(EngineError):
            build_map_table(spark, bad)


@pytest.mark.parametrize("sql", ["select (select (select p.name from ports p where p.id = b.port_id) from ports q limit 1) as x from boats b", "select b.id from boats b left join ports p on p.id = (select max(x.id) from ports x where x.id < p.id and x.id > b.id)"])
def test_unsupported(harbours, sql):
    with pytest.raises(UnsupportedError):
        harbours().query(sql)


def plan_of(result):
    return result.df._jdf.queryExecution().executedPlan().toString()


def test_plans_keep_pushdown_and_equi_joins(spark):
    db = Database(spark)
    for name in ("customer", "orders"):
        db.register_parquet(name, f"/root/testdata/sf0.001/{name}.parquet")
    plan = plan_of(db.query("select c_name, o_totalprice from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and not o_orderkey = 3 order by o_totalprice desc, c_name limit 4"))
    assert "TakeOrderedAndProject" in plan and "EqualTo(c_mktsegment,BUILDING)" in plan and "o_orderdate" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("kind, condition", [("", "true"), ("", "x.value > ?"), ("left", "true"), ("left", "x.value > ?")])
def test_unnest_is_one_scan_and_one_generate(spark, kind, condition):
    db = Database(spark)
    db.register_parquet("embeddings", "/root/testdata/sf0.001/embeddings.parquet")
    plan = plan_of(db.query(f"select e.vec_id, x.value from embeddings e {kind} join unnest(e.embedding) x on {condition}", *[0.1] * condition.count("?")))
    assert plan.count("FileScan") == 1 and plan.count("Generate") == 1 and "Join" not in plan and "Exchange" not in plan


def test_a_correlated_aggregate_scans_each_table_once(spark):
    db = Database(spark)
    for name in ("customer", "orders"):
        db.register_parquet(name, f"/root/testdata/sf0.001/{name}.parquet")
    plan = plan_of(db.query("select c_custkey, (select max(o_orderkey) from orders where o_custkey = c_custkey) as last_order from customer"))
    assert plan.count("FileScan") == 2


def test_dynamic_equality_is_an_equi_join(harbours):
    plan = plan_of(harbours().query("select a.id, b.id from mixed a join mixed b on a.w = b.w"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
