"""Models as of past dates: one plan that scores every snapshot, from what was known then.

A snapshot k of a fund is a fund of its own, <fund>@<k>, in a sector <sector>@<k> with an index <sector>@<k>, whose series end at the
snapshot's day. Every operator and every model runs over these tables as they are: percentiles are within a sector, so within a
snapshot, and all is dealt by fund and snapshot. Snapshots that end on Fridays leave no week open. The series of today are there too, under
their own names, and the indices as funds that no sector has (index:<name>): they give the outcomes. Holdings have no past and are missing.
"""

from __future__ import annotations

from navloom.plans.text import Model

_FRIDAY = "day + ((1 - day) % 7 + 7) % 7"


def snapshot_steps(n: int, apart: int, horizon: int, last: str = f"max({_FRIDAY}) - 7") -> dict[str, str]:
    """Steps that replace the tables: n snapshots, so many days apart, the newest so many days before the last full week of the indices (or another last day)."""
    return {
        "replay_days": f"""
            select k, w1 - ({horizon} + {apart} * k) as day
            from (select [[seq|0|{n - 1}]] as k, w1 from (select {last} as w1 from (select [[day|ts]] as day from index_nav_all) x) y) z""",
        **copied("replay_days r on 1 = 1", "replay_days r on 1 = 1", "r"),
        "nav": f"{_NAV} union all select concat('index:', index_id), ts, nav from index_nav_all",
    }


_NAV = "select fund_id, ts, nav from nav_all union all select fund_id, ts, nav from replay_navs"


def copied(of_fund: str, of_index: str, days: str) -> dict[str, str]:
    """Steps that replace nav, index_nav and fund by them and their copies up to each day; joins to the days (k, day) of a fund and of an index."""
    name = lambda column: f"concat({column}, '@', cast({days}.k as varchar(9)))"
    return {
        "replay_navs": f"select {name('n.fund_id')} as fund_id, n.ts, n.nav from nav_all n join {of_fund.format(id='n.fund_id')} and [[day|n.ts]] <= {days}.day",
        "nav": _NAV,
        "index_nav": f"""
            select index_id, ts, nav from index_nav_all
            union all select {name('n.index_id')}, n.ts, n.nav from index_nav_all n join {of_index} and [[day|n.ts]] <= {days}.day""",
        "fund": f"""
            select fund_id, name, sector, subsector, aum from fund_all
            union all select {name('f.fund_id')}, f.name, {name('f.sector')}, f.subsector, f.aum from fund_all f join {of_fund.format(id='f.fund_id')}""",
    }


def replayed(name: str, doc: str, model: Model, sql: str, n: int, apart: int, horizon: int, more: dict[str, str] | None = None) -> Model:
    """A query over a model's steps (measures, pillar_scores, model_scores) with all snapshots in them, and more steps of its own."""
    return Model(name, doc, sql, model.params, {**model.steps, **snapshot_steps(n, apart, horizon), **(more or {})})
