"""n-ary boolean combination of 0/1 decision columns.

Meaning of each operator (documented n-ary semantics):
  OR   1 if any input is 1           AND  1 if all inputs are 1
  XOR  1 if an odd number is 1       NOR  1 if no input is 1
  NAND 1 if not all inputs are 1     NXOR 1 if an even number is 1
Each compiles to one native expression; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of each operator.
LOGIC_ALIASES = {
    "OR": "OR", "|": "OR",
    "AND": "AND", "&": "AND",
    "XOR": "XOR", "^": "XOR",
    "NOR": "NOR",
    "NAND": "NAND",
    "NXOR": "NXOR",
}


def canonical_logic(logic: str) -> str:
    try:
        return LOGIC_ALIASES[logic]
    except KeyError:
        raise ValueError(f"unknown rule logic {logic!r}; known: {', '.join(sorted(LOGIC_ALIASES))}") from None


def _any(cols: Sequence[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def _all(cols: Sequence[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def _odd(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) % F.lit(2)


def combine(logic: str, cols: Sequence[Column]) -> Column:
    """Combine 0/1 int columns with one of the six operators; result is int 0/1."""
    if not cols:
        raise ValueError("No columns specified")
    op = canonical_logic(logic)
    if op == "OR":
        out = _any(cols)
    elif op == "AND":
        out = _all(cols)
    elif op == "XOR":
        out = _odd(cols)
    elif op == "NOR":
        out = F.lit(1) - _any(cols)
    elif op == "NAND":
        out = F.lit(1) - _all(cols)
    else:
        out = F.lit(1) - _odd(cols)
    return out.cast("int")


def sql_combine(logic: str, cols: Sequence[str]) -> str:
    """The same combination as an SQL expression (used for oracles and docs)."""
    op = canonical_logic(logic)
    any_ = cols[0] if len(cols) == 1 else f"greatest({', '.join(cols)})"
    all_ = cols[0] if len(cols) == 1 else f"least({', '.join(cols)})"
    odd = f"(({' + '.join(cols)}) % 2)"
    return {
        "OR": any_, "AND": all_, "XOR": odd,
        "NOR": f"(1 - {any_})", "NAND": f"(1 - {all_})", "NXOR": f"(1 - {odd})",
    }[op]
