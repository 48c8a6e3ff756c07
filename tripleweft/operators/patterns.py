"""Patterns of edges with variables, joined a variable at a time."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TESTS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
LEAST = 1e-6


class _Template:
    """One (subject, predicate, object) of a pattern: what its edges fulfil, and the variables that they bind."""

    def __init__(self, place: int, terms: tuple):
        self.place, self.variables, self.tests = place, {}, []
        for column, term in zip(("subject_id", "predicate", "object_id"), terms):
            value = F.col(column).cast("string")
            if str(term).startswith("?"):
                if term in self.variables:
                    self.tests.append(value == self.variables[term])
                self.variables.setdefault(term, value)
            elif term != "*":
                self.tests.append(value == str(term))

    def fulfilled(self) -> Column:
        return reduce(lambda a, b: a & b, self.tests, F.lit(True))

    def rows(self, edges: DataFrame) -> DataFrame:
        sure = F.greatest(F.coalesce("local_confidence", F.lit(0.0)), F.lit(LEAST))
        return edges.where(self.fulfilled()).select(*[c.alias(v) for v, c in self.variables.items()], sure.alias(f"_c{self.place}"), F.coalesce("is_bridge", F.lit(False)).alias(f"_b{self.place}"))


def bindings(pattern: list[tuple], edges: DataFrame, constraints: list[tuple] = ()) -> tuple[DataFrame, list[str]]:
    """(rows with a column for each variable and _c, _b for each template; the variables in order of the pattern) of all ways to bind the pattern in edges(subject_id, predicate, object_id, local_confidence, is_bridge).

    One pass counts each template's edges and, nearly, how many values each of its variables takes. The rarest is where the search starts; then a variable at a time is bound, first the one to which a row is led by the
    fewest edges (a template's edges divided by the values of what is bound): pairs of all that lies under a frequent value come last. Templates whose variables are all bound are joined first, since they only drop rows. A variable
    that several templates lead to (it closes a cycle) is bound, in each row, from the one that offers the fewest edges there, and then tested against the others: so what lies between is never larger than the rarer
    side, row by row. Constraints (a variable, one of = != < <= > >=, a variable or a value; as text) are applied as soon as their variables are bound.

    A template that shares no variable with the others would pair everything with everything: that is an error. Templates without a variable are conditions: the surest edge that fulfils one counts.
    """
    if not pattern:
        raise ValueError("empty pattern")
    templates = [_Template(i, t) for i, t in enumerate(pattern)]
    names = list(dict.fromkeys(v for t in templates for v in t.variables))
    for a, test, b in constraints:
        if test not in TESTS or any(str(x).startswith("?") and x not in names for x in (a, b)):
            raise ValueError(f"constraint {(a, test, b)} is of unknown kind or names a variable that the pattern lacks")
    fixed = [t for t in templates if not t.variables]
    open_ = [t for t in templates if t.variables]
    taken = {(t, v): f"d{t.place}_{i}" for t in open_ for i, v in enumerate(t.variables)}
    values = [F.approx_count_distinct(F.when(t.fulfilled(), t.variables[v])).alias(k) for (t, v), k in taken.items()]
    counted = edges.agg(*[F.count_if(t.fulfilled()).alias(f"n{t.place}") for t in templates], *values).first()
    size = {t: counted[f"n{t.place}"] for t in templates}
    led = lambda t, bound: size[t] / max(1, *[counted[taken[t, v]] for v in t.variables if v in bound])
    parts = {t: t.rows(edges) for t in templates}
    waiting = list(constraints)

    def tested(rows: DataFrame) -> DataFrame:
        for x in list(waiting):
            if all(not str(y).startswith("?") or y in rows.columns for y in (x[0], x[2])):
                a, b = (F.col(f"`{y}`") if str(y).startswith("?") else F.lit(str(y)) for y in (x[0], x[2]))
                rows = rows.where(TESTS[x[1]](a, b))
                waiting.remove(x)
        return rows

    if not open_:
        rows = parts[fixed.pop(0)]
    else:
        start = min(open_, key=lambda t: (size[t], t.place))
        open_.remove(start)
        rows = tested(parts[start])
    while open_:
        bound = set(rows.columns)
        closed = [t for t in open_ if set(t.variables) <= bound]
        if closed:
            t = min(closed, key=lambda t: (size[t], t.place))
            open_.remove(t)
            rows = rows.join(parts[t], list(t.variables))
            continue
        ways: dict = {}
        for t in open_:
            fresh = [v for v in t.variables if v not in bound]
            if len(fresh) < len(t.variables):
                ways.setdefault(tuple(fresh), []).append(t)
        if not ways:
            raise ValueError("the pattern falls apart: no template left shares a variable with those before")
        fresh = min(ways, key=lambda k: (len(k), min(led(t, bound) for t in ways[k]), -len(ways[k]), min(size[t] for t in ways[k]), k))
        several = sorted(ways[fresh], key=lambda t: (size[t], t.place))
        for t in several:
            open_.remove(t)
        rows = tested(_rarest(rows, [(parts[t], [v for v in t.variables if v in bound]) for t in several], list(fresh)))
    for t in fixed:
        best = parts[t].agg(F.max(F.struct(f"_c{t.place}", f"_b{t.place}")).alias("x")).first().x  # one row
        rows = rows.where(F.lit(best is not None)).withColumns({f"_c{t.place}": F.lit(best[0] if best else LEAST), f"_b{t.place}": F.lit(bool(best and best[1]))})
    return rows, names


def _rarest(rows: DataFrame, parts: list[tuple[DataFrame, list[str]]], fresh: list[str]) -> DataFrame:
    """rows with the fresh variables, bound from parts (rows, variables that are bound already), and joined with all of them."""
    if len(parts) == 1:
        return rows.join(parts[0][0], parts[0][1])
    for i, (part, keys) in enumerate(parts):
        rows = rows.join(part.groupBy(*keys).agg(F.count("*").alias(f"_n{i}")), keys)  # rows that a part offers nothing go
    least = F.least(*[F.col(f"_n{i}") for i in range(len(parts))])
    out, taken = None, F.lit(False)
    for i, (part, keys) in enumerate(parts):
        mine = (F.col(f"_n{i}") == least) & ~taken
        taken = taken | (F.col(f"_n{i}") == least)
        own = rows.where(mine).drop(*[f"_n{j}" for j in range(len(parts))]).join(part, keys)
        for j, (other, keys_) in enumerate(parts):
            if j != i:
                own = own.join(other, keys_ + fresh)
        out = own if out is None else out.unionByName(own)
    return out


def unify(pattern: list[tuple], edges: DataFrame, truth_floor: list | None = None, k: int = 8, ceiling: int = 64, constraints: list[tuple] = (), bridges_sacred: bool = True) -> DataFrame:
    """The min(k, ceiling) best bindings of a pattern of (subject, predicate, object), each a literal, a ?variable or *: a column for each variable, score (the product of confidences, none counting 1e-6) and hit_bridge.

    edges: subject_id, predicate, object_id, local_truth, local_confidence, is_bridge. With a truth_floor only edges of these truths count, and, if bridges are sacred, any bridge. Ties go by the variables.
    """
    if truth_floor:
        passes = F.coalesce(F.col("local_truth").isin(truth_floor), F.lit(False))
        edges = edges.where(passes | F.coalesce("is_bridge", F.lit(False)) if bridges_sacred else passes)
    rows, names = bindings(pattern, edges, constraints)
    n = len(pattern)
    rows = rows.withColumn("score", reduce(lambda x, y: x * y, [F.col(f"_c{i}") for i in range(n)])).withColumn("hit_bridge", reduce(lambda x, y: x | y, [F.col(f"_b{i}") for i in range(n)]))
    return rows.select(*[F.col(f"`{v}`").alias(v[1:]) for v in names], "score", "hit_bridge").orderBy(F.desc("score"), *[v[1:] for v in names]).limit(max(1, min(k, ceiling)))
