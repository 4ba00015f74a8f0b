"""An operator's SQL is written once; the few places where Spark and DuckDB differ are marked [[name|argument|...]]."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

_MARK = re.compile(r"\[\[(\w+)((?:\|[^|\[\]]*)*)\]\]")


def _npv(flows: str, rate: str) -> tuple[str, str]:
    spark = f"aggregate({flows}, 0D, (z, c) -> z + c.a / pow(1 + {rate}, c.t))"
    duck = f"list_sum(list_transform({flows}, lambda c: c.a / pow(1 + {rate}, c.t)))"
    return spark, duck


def _xirr_spark(flows: str, lo: str = "-0.99", hi: str = "5.0") -> str:
    """Newton's method for u = ln(1 + rate) on the log of sales over purchases, nearly a line in u; halvings where its last step is not small."""
    sums = "(z, c) -> named_struct('p', z.p + greatest(c.a, 0D) * exp(-c.t * s.u), 'pt', z.pt + greatest(c.a, 0D) * c.t * exp(-c.t * s.u), 'n', z.n - least(c.a, 0D) * exp(-c.t * s.u), 'nt', z.nt - least(c.a, 0D) * c.t * exp(-c.t * s.u))"
    total = f"aggregate({flows}, named_struct('p', 0D, 'pt', 0D, 'n', 0D, 'nt', 0D), {sums})"
    move = "ln(z.p / nullif(z.n, 0D)) / nullif(z.nt / nullif(z.n, 0D) - z.pt / nullif(z.p, 0D), 0D)"
    newton = f"aggregate(sequence(1, 7), named_struct('u', 0D, 'du', 1D), (s, i) -> case when abs(s.du) < 1e-9 then s else element_at(transform(array({total}), z -> named_struct('u', s.u - {move}, 'du', {move})), 1) end)"
    found = f"transform(array({newton}), s -> case when abs(s.du) < 1e-9 and expm1(s.u) > {lo} and expm1(s.u) < {hi} then expm1(s.u) end)"
    mid = "((s.lo + s.hi) / 2)"
    step = f"case when {_npv(flows, mid)[0]} > 0 then named_struct('lo', {mid}, 'hi', s.hi) else named_struct('lo', s.lo, 'hi', {mid}) end"
    root = f"aggregate(sequence(1, 60), named_struct('lo', double({lo}), 'hi', double({hi})), (s, i) -> {step}, s -> (s.lo + s.hi) / 2)"
    return f"case when {_npv(flows, f'double({lo})')[0]} * {_npv(flows, f'double({hi})')[0]} < 0 then coalesce(element_at({found}, 1), {root}) end"


def _xirr_duck(flows: str, lo: str = "-0.99", hi: str = "5.0") -> str:
    mid = "((s.lo + s.hi) / 2)"
    up, down = f"{{'lo': {mid}, 'hi': s.hi}}", f"{{'lo': s.lo, 'hi': {mid}}}"
    start = f"{{'lo': {lo}::double, 'hi': {hi}::double}}"
    steps = f"list_transform(range(60), lambda i: {start})"
    root = f"list_reduce({steps}, lambda s, i: case when {_npv(flows, mid)[1]} > 0 then {up} else {down} end, {start})"
    return f"case when {_npv(flows, f'{lo}::double')[1]} * {_npv(flows, f'{hi}::double')[1]} < 0 then ({root}.lo + {root}.hi) / 2 end"


def _capped_spark(w: str, cap: str, passes: str) -> str:
    total, room = "aggregate(s, 0D, (a, b) -> a + b)", f"aggregate(s, 0D, (a, b) -> a + greatest({cap} - b, 0D))"
    step = f"case when abs(1 - {total}) < 1e-9 or {room} <= 1e-12 then s else transform(s, x -> least(greatest(x + (1 - {total}) * greatest({cap} - x, 0D) / {room}, 0D), double({cap}))) end"
    return f"aggregate(sequence(1, {passes}), transform({w}, x -> least(greatest(x, 0D), double({cap}))), (s, i) -> {step})"


def _capped_duck(w: str, cap: str, passes: str) -> str:
    start = f"[least(greatest(e, 0), {cap}) for e in {w}]"
    total, room = "list_sum(s)", f"list_sum(list_transform(s, lambda b: greatest({cap} - b, 0)))"
    step = f"case when abs(1 - {total}) < 1e-9 or {room} <= 1e-12 then s else list_transform(s, lambda x: least(greatest(x + (1 - {total}) * greatest({cap} - x, 0) / {room}, 0), {cap})) end"
    return f"list_reduce(list_transform(range({passes} + 1), lambda i: {start}), lambda s, i: {step})"


def _round_spark(x: str, digits: str) -> str:
    """DuckDB rounds the product with a power of ten and keeps the sign of what becomes 0; Spark's round works on the shortest decimal, so ties fall apart."""
    return f"(case when {x} < 0 then -round(-({x}) * 1e{digits}D) else round(({x}) * 1e{digits}D) end / 1e{digits}D)"


def _quantile_spark(x: str, p: str) -> str:
    """A small group's quantile as DuckDB adds its two neighbours up: one product is not rounded before the sum, so sums of short decimals tie alike."""
    at = f"(size(a) - 1) * {p}e0"
    low, high = f"element_at(a, cast(floor({at}) as int) + 1)", f"element_at(a, cast(ceil({at}) as int) + 1)"
    part = f"({at} - floor({at}))"
    return f"element_at(transform(array(sort_array(collect_list({x}))), a -> case when size(a) > 0 then cast(reflect('java.lang.Math', 'fma', {low}, 1e0 - {part}, {high} * {part}) as double) end), 1)"


#: Spark's and DuckDB's form of each mark.
MARKS: dict[str, tuple[Callable[..., str], Callable[..., str]]] = {
    "day": (lambda x: f"datediff({x}, DATE'1970-01-01')", lambda x: f"date_diff('day', DATE '1970-01-01', cast({x} as date))"),
    "date": (lambda x: f"date_add(DATE'1970-01-01', cast({x} as int))", lambda x: f"(DATE '1970-01-01' + cast({x} as int))"),
    "months": (lambda x, n: f"cast(add_months({x}, {n}) as date)", lambda x, n: f"cast({x} + to_months({n}) as date)"),
    "seq": (lambda a, b: f"explode(sequence({a}, {b}))", lambda a, b: f"unnest(range({a}, ({b}) + 1))"),
    "monthseq": (lambda a, b: f"explode(sequence({a}, {b}, interval 1 month))", lambda a, b: f"unnest(generate_series(cast({a} as timestamp), cast({b} as timestamp), interval 1 month))"),
    "last": (lambda x: f"last_value({x}) ignore nulls", lambda x: f"last_value({x} ignore nulls)"),
    "first": (lambda x: f"first_value({x}) ignore nulls", lambda x: f"first_value({x} ignore nulls)"),
    "q": (lambda x, p: f"percentile({x}, {p})", lambda x, p: f"quantile_cont({x}, {p})"),
    "quantile": (_quantile_spark, lambda x, p: f"quantile_cont({x}, {p})"),
    "skew": (lambda x: f"(skewness({x}) * sqrt(count({x}) * (count({x}) - 1D)) / nullif(count({x}) - 2, 0))", lambda x: f"skewness({x})"),
    "flows": (lambda a, t, o: f"transform(array_sort(collect_list(named_struct('o', {o}, 'a', {a}, 't', {t}))), x -> named_struct('a', x.a, 't', x.t))", lambda a, t, o: f"list({{'a': {a}, 't': {t}}} order by {o})"),
    "xirr": (_xirr_spark, _xirr_duck),
    "capped": (_capped_spark, _capped_duck),
    "total": (lambda x: f"aggregate({x}, 0D, (a, b) -> a + b)", lambda x: f"list_sum({x})"),
    "item": (lambda x, i: f"element_at({x}, cast({i} as int) + 1)", lambda x, i: f"{x}[{i} + 1]"),
    "unnest": (lambda x: f"explode({x})", lambda x: f"unnest({x})"),
    "strlist": (lambda x, o: f"transform(array_sort(collect_list(named_struct('o', {o}, 'x', {x}))), s -> s.x)", lambda x, o: f"list({x} order by {o})"),
    "join": (lambda x, s: f"array_join({x}, {s})", lambda x, s: f"array_to_string({x}, {s})"),
    "json": (lambda x, p: f"get_json_object({x}, '$.{p}')", lambda x, p: f"json_extract_string({x}, '$.{p}')"),
    "matches": (lambda x, p: f"({x} rlike '(?i){p}')", lambda x, p: f"regexp_matches({x}, '(?i){p}')"),
    "round": (_round_spark, lambda x, d: f"round({x}, {d})"),
    "fixed": (lambda x, d: f"case when {x} is not null then format_string('%.{d}f', {x}) end", lambda x, d: f"printf('%.{d}f', {x})"),
    "ymd": (lambda x: f"date_format({x}, 'yyyy-MM-dd')", lambda x: f"strftime({x}, '%Y-%m-%d')"),
}


def written(text: str, engine: str) -> str:
    """The text in the dialect of "spark" or "duckdb"; marks may hold marks."""
    side = 0 if engine == "spark" else 1
    while _MARK.search(text):
        text = _MARK.sub(lambda m: MARKS[m[1]][side](*[x.strip() for x in m[2].split("|")[1:]]), text)
    return text


#: Parts of SQL texts that have another text in Spark: the same rows, made with less work.
IN_SPARK: dict[str, str] = {}
_READ = re.compile(r"\b(?:from|join)\s+([a-z_][a-z0-9_]*)")


def _in_spark(text: str) -> str:
    for sql, spark in IN_SPARK.items():
        text = text.replace(sql, spark)
    return text


@dataclass(frozen=True)
class Operator:
    """A query over named tables.

    sql may use the tables of the data model (fund, nav, index_nav, holding, model_score, ...), the shared steps and its own steps
    by name; {name} stands for a parameter. steps are more named steps, which may take the place of shared steps and of tables; a
    table that they replace is still there as <name>_all. spark has texts of steps that Spark makes another way (the same rows with
    less work; None: Spark does without the step). Calling it gives a lazy DataFrame; nothing is collected.
    """

    name: str
    doc: str
    sql: str
    params: Mapping[str, object] = field(default_factory=dict)
    steps: Mapping[str, str] = field(default_factory=dict)
    spark: Mapping[str, str | None] = field(default_factory=dict)

    def resolved(self, engine: str, inputs: Mapping[str, str], ready: Mapping[str, str] | None = None, target: str | None = None, **params) -> tuple[list[tuple[str, str]], str]:
        """(steps in the order in which they need each other, as name and text; the text itself, or that of the target step)."""
        from navloom.plans.steps import SPARK_STEPS, STEPS

        ready = ready or {}
        given = {**inputs, **{f"{k}_all": v for k, v in inputs.items()}}
        mine, own = dict(self.steps), {**STEPS, **self.steps}
        body = f"select * from {target}" if target else self.sql
        if engine == "spark":
            mine = {k: v for k, v in {**self.steps, **self.spark}.items() if v is not None}
            own = {k: _in_spark(v) for k, v in {**STEPS, **SPARK_STEPS, **mine}.items()}
            body = _in_spark(body)
        for key, value in {**self.params, **params}.items():
            body = body.replace("{" + key + "}", str(value))
        order: list[tuple[str, str]] = []
        seen: set[str] = set()

        def need(text: str) -> None:
            for word in dict.fromkeys(_READ.findall(text)):
                if word in seen or not (word in ready or word in given or word in own):
                    continue
                seen.add(word)
                if word in ready:
                    found = ready[word]
                elif word in mine or word not in given:
                    found = own[word]
                    need(found)
                else:
                    found = given[word]
                order.append((word, found))

        need(body)
        return order, body

    def text(self, engine: str, inputs: Mapping[str, str], ready: Mapping[str, str] | None = None, target: str | None = None, **params) -> str:
        order, body = self.resolved(engine, inputs, ready, target, **params)
        withs = [f"{name} as ({found})" for name, found in order]
        own = re.match(r"\s*with\s+", body)
        if own:
            body = body[own.end() :]
            return written(f"with {', '.join([*withs, ''])}{body}" if withs else f"with {body}", engine)
        return written(f"with {', '.join(withs)} {body}" if withs else body, engine)

    def __call__(self, tables: Mapping[str, DataFrame], **params) -> DataFrame:
        return self.over(tables, {}, **params)

    def over(self, tables: Mapping[str, DataFrame], ready: Mapping[str, DataFrame], target: str | None = None, **params) -> DataFrame:
        """The query (or one of its steps) over tables, with the steps in ready taken from there."""
        names = {name: f"select * from {{{name}}}" for name in tables}
        text = self.text("spark", names, {name: f"select * from {{ready_{name}}}" for name in ready}, target, **params)
        frames = {**tables, **{f"ready_{name}": df for name, df in ready.items()}}
        used = {name: df for name, df in frames.items() if "{" + name + "}" in text}
        spark = next(iter(frames.values())).sparkSession if frames else SparkSession.active()
        return spark.sql(text, **used)


#: Steps of a model that are written at a time.
AT_ONCE = 6


class Model(Operator):
    """An operator of many measures that share steps: each step that is read more than once is computed once.

    Spark puts the text of a named step wherever it is read, so a step that ten measures read would run ten times, and so would all
    below it. Calling a model writes these steps as tables to the shared folder, in the order in which they need each other, and
    reads them back; what is left is one plan over a few tables. Jobs run while the query is built. A step in computed is made by
    DataFrame operations from other steps, where SQL would need a window over all rows of a group; its text says what it computes.
    """

    computed: ClassVar[dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]]] = {}

    def shared(self, tables: Mapping[str, DataFrame], **params) -> list[str]:
        """Names of the steps that are read more than once, in the order in which they need each other."""
        order, body = self.resolved("spark", {name: "" for name in tables}, **params)
        reads = Counter(name for text in [body, *(t for _, t in order)] for name in _READ.findall(text))
        known = {name for name, _ in order}
        for name in known & self.computed.keys():
            reads.update(dict.fromkeys((name, *self.computed[name][0]), 2))
        reads.update({name: 2 for name, _ in order if name.startswith(("o_", "measures_"))})  # what ends a measure, or all of them
        return [name for name, text in order if reads[name] > 1 and text and not re.fullmatch(r"select '[^()]*", text)]

    def made(self, tables: Mapping[str, DataFrame], ready: Mapping[str, DataFrame], name: str, **params) -> DataFrame:
        if name in self.computed:
            needs, function = self.computed[name]
            return function(*(ready[n] for n in needs))
        return self.over(tables, ready, name, **params)

    def __call__(self, tables: Mapping[str, DataFrame], **params) -> DataFrame:
        from navloom.sources.shared import stored

        names = {name: "" for name in tables}
        waiting = {name: set() for name in self.shared(tables, **params)}
        for name in waiting:
            below, _ = self.resolved("spark", names, dict.fromkeys(waiting.keys() - {name}, ""), name, **params)
            waiting[name] = {n for n, _ in below} & waiting.keys() - {name}
        ready: dict[str, DataFrame] = {}
        with ThreadPoolExecutor(AT_ONCE) as pool:  # steps that do not need each other are written side by side
            while waiting:
                now = [name for name, needs in waiting.items() if needs <= ready.keys()]
                found = pool.map(lambda name: stored(self.made(tables, ready, name, **params), f"step-{name}"), now)
                ready |= dict(zip(now, list(found), strict=True))
                waiting = {name: needs for name, needs in waiting.items() if name not in ready}
        return self.over(tables, ready, **params)
