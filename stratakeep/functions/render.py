"""Result headers, and results as a box-drawn table or as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable

from ..plans import ast as A


def header(node: A.Expr) -> str:
    """How an expression is named in a result."""
    if isinstance(node, A.Binary):
        first, rest = A.spine(node, A.ARITHMETIC + A.COMPARISONS + A.LOGIC)
        return "".join([*["("] * len(rest), header(first), *(f" {op} {header(kid)})" for op, kid in rest)])
    if isinstance(node, A.Unary):
        return f"{'NOT ' if node.op == 'NOT' else '-'}{header(node.kid)}"
    if isinstance(node, A.Tuple):
        return f"({', '.join(header(k) for k in node.kids)})"
    if isinstance(node, A.Lit):
        return str(node.value)
    return node.name if isinstance(node, A.Name) else "*"


def _plural(n: int, noun: str = "row") -> str:
    return f"{n} {noun}{'' if n == 1 else 's'}"


def render_table(columns: list[tuple[str, str]], rows: Iterable[tuple], rows_affected: int = 0) -> str:
    """Integers stand to the right, everything else to the left; a statement gives its count."""
    if not columns:
        return f"OK, {_plural(rows_affected)} affected\n"
    cells = [[("NULL" if v is None else str(v), isinstance(v, int)) for v in row] for row in rows]
    widths = [max([len(name), *(len(r[i][0]) for r in cells)]) for i, (name, _) in enumerate(columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda parts: "| " + " | ".join(parts) + " |"
    out = [rule, line([name.ljust(w) for (name, _), w in zip(columns, widths, strict=True)]), rule]
    out += [line([t.rjust(w) if right else t.ljust(w) for (t, right), w in zip(r, widths, strict=True)]) for r in cells]
    return "\n".join([*out, rule, f"({_plural(len(cells))})"]) + "\n"


def render_json(columns: list[tuple[str, str]], rows: Iterable[tuple], rows_affected: int = 0) -> str:
    data = {"columns": [{"name": n, "type": t} for n, t in columns], "rows": [list(r) for r in rows], "rows_affected": rows_affected}
    return json.dumps(data, separators=(",", ":"), ensure_ascii=False) + "\n"
