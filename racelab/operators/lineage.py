"""Which source columns feed a feature, read from the analysed plan: names don't matter.

Every output of every node is traced to the columns of the plan's leaves. A dependence that passes only
through windows whose frame ends before the row (or through ``lag``) is ``past``, any other is ``same_row``:
outcomes may feed features from the past, never from the same row. Row filters and join conditions say which
rows there are and aren't traced; a Python function depends on all its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SAME, PAST = "same_row", "past"


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _ends_before(frame) -> bool:
    """A frame's upper end is a constant below zero."""
    if _kind(frame) != "SpecifiedWindowFrame":
        return False
    upper = frame.upper()
    if not hasattr(upper, "foldable") or _kind(upper).endswith("$") or not upper.foldable():
        return False
    value = upper.eval(None)
    return value < 0 if isinstance(value, (int, float)) else "-" in value.toString()  # an interval


def _sources(expression, known: dict, past: bool, found: set) -> None:
    kind = _kind(expression)
    if kind == "AttributeReference":
        for source, how in known.get(expression.exprId().id(), {(expression.name(), SAME)}):
            found.add((source, PAST if past else how))
        return
    if kind == "WindowExpression":
        spec = expression.windowSpec()
        function = expression.windowFunction()
        before = _kind(function) == "Lag" or _ends_before(spec.frameSpecification())
        _sources(function, known, past or before, found)
        for e in _seq(spec.partitionSpec()) + _seq(spec.orderSpec()):
            _sources(e, known, past, found)
        return
    for child in _seq(expression.children()):
        _sources(child, known, past, found)


def _trace(node, known: dict) -> None:
    children = _seq(node.children())
    for child in children:
        _trace(child, known)
    kind = _kind(node)
    if not children:
        for a in _seq(node.output()):
            known[a.exprId().id()] = {(a.name(), SAME)}
        return
    if kind == "Union":
        for position, a in enumerate(_seq(node.output())):
            known[a.exprId().id()] = set().union(*[known.get(_seq(c.output())[position].exprId().id(), set()) for c in children])
        return
    for e in _seq(node.expressions()):
        if _kind(e) == "Alias":
            found: set = set()
            _sources(e.child(), known, False, found)
            known[e.exprId().id()] = found
    inputs = set().union(*[known.get(a.exprId().id(), set()) for c in children for a in _seq(c.output())])
    generated: set = set()
    if kind == "Generate":
        _sources(node.generator(), known, False, generated)
    for a in _seq(node.output()):
        # what no expression names: a generator's output, or a Python function's
        known.setdefault(a.exprId().id(), generated if kind == "Generate" else inputs)


def lineage(df: DataFrame) -> dict[str, set[tuple[str, str]]]:
    """{column: {(source column, same_row or past)}} of a frame's columns."""
    plan = df._jdf.queryExecution().analyzed()
    known: dict = {}
    _trace(plan, known)
    return {a.name(): known.get(a.exprId().id(), set()) for a in _seq(plan.output())}


def audit(df: DataFrame, features: list[str], outcomes: set[str], asof: set[str] = frozenset()) -> list[tuple[str, str, str]]:
    """(feature, source, fault), sorted: features that an outcome of the same row feeds (``leak``), and those
    that a market column of the same row feeds, which needs a quote from before the race (``needs_asof``)."""
    of = lineage(df)
    if missing := [f for f in features if f not in of]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    faults = [(f, s, "leak" if s in outcomes else "needs_asof") for f in features for s, how in of[f] if how == SAME and (s in outcomes or s in asof)]
    return sorted(faults)


def assert_safe(df: DataFrame, features: list[str], outcomes: set[str], asof: set[str] = frozenset()) -> None:
    faults = audit(df, features, outcomes, asof)
    if faults:
        raise ValueError("; ".join(f"{f}: {fault} from {s}" for f, s, fault in faults))
