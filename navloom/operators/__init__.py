"""Fund analytics: every operator is a lazy query over the tables of the data model. ALL has them by name."""

from navloom.operators import base, benchmark, cashflow, factors, learned, learning, regimes, returns, risk, scoring

ALL = {op.name: op for module in (base, returns, risk, benchmark, regimes, factors, cashflow, scoring, learning, learned) for op in module.OPERATORS}
