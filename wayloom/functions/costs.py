"""Cost models: statements of conditions compiled to Column expressions, and edge weights."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP_SPEED, TOP_PRIORITY = 999.0, 1.0
OPERATIONS = ("multiply_by", "limit_to", "add")


@dataclass(frozen=True)
class Statement:
    keyword: str  # if, else_if, else
    condition: str
    operation: str
    value: str

    @classmethod
    def parse(cls, entry: dict) -> Statement:
        keyword = next((k for k in ("if", "else_if", "else") if k in entry), None)
        operation = next((o for o in OPERATIONS if o in entry), None)
        if keyword is None or operation is None:
            raise ValueError(f"a statement needs a keyword and an operation: {entry}")
        return cls(keyword, str(entry[keyword]), operation, str(entry[operation]))


@dataclass
class Model:
    speed: list[Statement] = field(default_factory=list)
    priority: list[Statement] = field(default_factory=list)
    distance_influence: float | None = None
    heading_penalty: float | None = None

    @classmethod
    def parse(cls, entry: dict) -> Model:
        return cls([Statement.parse(s) for s in entry.get("speed", [])], [Statement.parse(s) for s in entry.get("priority", [])], entry.get("distance_influence"), entry.get("heading_penalty"))

    def merged(self, query: Model) -> Model:
        """The query's numbers win, its statements come after."""
        pick = lambda a, b: b if b is not None else a
        return Model(self.speed + query.speed, self.priority + query.priority, pick(self.distance_influence, query.distance_influence), pick(self.heading_penalty, query.heading_penalty))


def standard_model(vehicle: str = "car") -> Model:
    return Model.parse({"priority": [{"if": f"!{vehicle}_access", "multiply_by": "0"}, {"if": f"{vehicle}_subnetwork", "multiply_by": "0"}], "speed": [{"if": "true", "limit_to": f"{vehicle}_average_speed"}]})


def groups(statements: list[Statement]) -> list[list[Statement]]:
    out: list[list[Statement]] = []
    for s in statements:
        if s.keyword == "if":
            out.append([s])
        elif not out or out[-1][-1].keyword == "else":
            raise ValueError(f"{s.keyword} without if")
        else:
            out[-1].append(s)
    return out


class Condition:
    """Recursive descent: or, and, not, brackets, booleans, and comparisons of columns with values.

    columns: name -> Column. kinds: name -> bool, decimal, or the list of an enum's values, first is the default.
    """

    TOKEN = re.compile(r"\s*(\|\||&&|==|!=|<=|>=|[!<>()]|[A-Za-z_][\w:]*|-?\d+(?:\.\d+)?)")

    def __init__(self, text: str, columns: dict, kinds: dict):
        self.columns, self.kinds, self.tokens, at = columns, kinds, [], 0
        text = text.strip()
        while at < len(text):
            found = self.TOKEN.match(text, at)
            if not found:
                raise ValueError(f"can't read {text[at:]!r}")
            self.tokens.append(found[1])
            at = found.end()
        self.at = 0

    def compiled(self) -> Column:
        out = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at]!r}")
        return out

    def next_is(self, *wanted) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return True
        return False

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise ValueError("unexpected end")
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> Column:
        out = self.both()
        while self.next_is("||"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.negated()
        while self.next_is("&&"):
            out = out & self.negated()
        return out

    def negated(self) -> Column:
        return ~self.negated() if self.next_is("!") else self.single()

    def single(self) -> Column:
        if self.next_is("("):
            out = self.either()
            if not self.next_is(")"):
                raise ValueError("missing )")
            return out
        name = self.take()
        if name in ("true", "false"):
            return F.lit(name == "true")
        if name not in self.kinds:
            raise ValueError(f"unknown name {name!r}")
        kind, column = self.kinds[name], self.columns[name]
        if not self.next_is("==", "!=", "<", "<=", ">", ">="):
            if kind != "bool":
                raise ValueError(f"{name} is no condition")
            return column
        sign, value = self.tokens[self.at - 1], self.take()
        if kind == "int" or (kind != "decimal" and sign not in ("==", "!=")):
            raise ValueError(f"{name} can't be compared with {sign}")
        if kind == "bool":
            right = F.lit({"true": True, "false": False}[value])
        elif kind == "decimal":
            right = F.lit(float(value))
        else:
            right = F.lit(value.lower() if value.lower() in kind else kind[0])
        return {"==": column == right, "!=": column != right, "<": column < right, "<=": column <= right, ">": column > right, ">=": column >= right}[sign]


def value_of(text: str, columns: dict) -> Column:
    return F.lit(float(text)) if re.fullmatch(r"-?\d+(\.\d+)?", text) else columns[text]


def applied(statements: list[Statement], start: float, columns: dict, kinds: dict) -> Column:
    """The value after all groups; in each the first branch that holds applies its operation."""
    value = F.lit(start)
    for group in groups(statements):
        out, other = None, value
        for s in group:
            operand = value_of(s.value, columns)
            new = {"multiply_by": value * operand, "limit_to": F.least(value, operand), "add": value + operand}[s.operation]
            if s.keyword == "else":
                other = new
            else:
                condition = Condition(s.condition, columns, kinds).compiled()
                out = F.when(condition, new) if out is None else out.when(condition, new)
        value = out.otherwise(other)
    return value


def weight(distance, speed, priority, distance_influence: float = 0.0) -> Column:
    """Seconds over priority plus the distance's share; infinite where speed or priority is 0."""
    open_ = (speed > 0) & (priority > 0)
    return F.when(open_, distance / F.nullif(speed, F.lit(0.0)) * 3.6 / F.nullif(priority, F.lit(0.0)) + distance * (distance_influence / 1000)).otherwise(F.lit(float("inf")))


def millis(distance, speed) -> Column:
    return F.round(distance / F.nullif(speed, F.lit(0.0)) * 3600).cast("long")


def avoided(weight_, edge_listed, factor: float = 5.0) -> Column:
    return F.when(edge_listed, weight_ * factor).otherwise(weight_)


def turn_weight(from_edge, to_edge, cost, restricted, u_turn: float = -1.0) -> Column:
    """Added weight of a turn; a negative u_turn forbids turning back."""
    back = F.lit(float("inf") if u_turn < 0 else u_turn)
    return F.when(from_edge.isNull() | to_edge.isNull(), 0.0).when(from_edge == to_edge, back).when(F.coalesce(restricted, F.lit(False)), float("inf")).otherwise(F.coalesce(cost, F.lit(0.0)))


def value_range(statements: list[Statement], start: float, largest: dict[str, float]) -> tuple[float, float]:
    """The least and the greatest value that statements can give; largest: each decimal column's greatest value."""
    lo, hi = start, start
    for group in groups(statements):
        results = []
        for s in group:
            v = (float(s.value),) * 2 if re.fullmatch(r"-?\d+(\.\d+)?", s.value) else (0.0, largest[s.value])
            results.append({"multiply_by": (lo * v[0], hi * v[1]), "limit_to": (min(lo, v[0]), min(hi, v[1])), "add": (lo + v[0], hi + v[1])}[s.operation])
            if s.condition.strip() == "true" and s is group[0]:
                break
        sure = group[0].condition.strip() == "true" or group[-1].keyword == "else"
        every = results if sure else [*results, (lo, hi)]
        lo, hi = min(r[0] for r in every), max(r[1] for r in every)
    if hi < 0:
        raise ValueError("the greatest value is negative")
    return lo, hi
