"""The expression language of conditions and derivations, compiled to Columns.

A compiled expression is a pair: its value, and whether evaluating it raises no
error in this row.  Only what the grammar below names can be said: there are no
method calls, constructors, type references, assignments or variables, and text
never reaches the SQL parser.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.model import ConfigError
from sparkloom.paths import Field, column, lookup

_TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)(?P<suffix>[LlFfDd]?)"
    r"|(?P<text>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")"
    r"|(?P<name>[A-Za-z_$][\w$]*|[^\W\d_]\w*)"
    r"|(?P<op>\?\.|\?:|&&|\|\||==|!=|<=|>=|[-+*/%^<>!?:()\[\]{},.#]))"
)
_WORDS = {"and": "&&", "or": "||", "not": "!", "eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "div": "/", "mod": "%"}
_COMPARE = {"==", "!=", "<", "<=", ">", ">=", "between", "matches"}
_BINARY = {"||": 1, "&&": 2, **dict.fromkeys(_COMPARE, 3), "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "^": 6}
_FUNCTIONS = {"abs": 1, "sqrt": 1, "pow": 2, "max": 2, "min": 2}
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Compiled:
    """Value, absence of an error, and kind (int, double, string, bool, null or other)."""

    value: Column
    ok: Column
    kind: str
    type: T.DataType | None = None
    items: tuple[Compiled, ...] = ()


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ConfigError(f"unexpected character at {at} in expression: {source}")
        at = m.end()
        kind = m.lastgroup if m.lastgroup != "suffix" else "number"
        if kind == "name" and m["name"].lower() in _WORDS:
            out.append(("op", _WORDS[m["name"].lower()]))
        elif kind == "name" and m["name"].lower() in ("between", "matches"):
            out.append(("op", m["name"].lower()))
        elif kind == "name" and m["name"] in ("T", "new", "instanceof"):
            raise ConfigError(f"{m['name']} is not allowed in expressions")
        else:
            out.append((kind, m[kind] + (m["suffix"] or "" if kind == "number" else "")))
    return [*out, ("end", "")]


def parse(source: str) -> tuple:
    """Syntax tree of an expression; ``ConfigError`` if it is none or says what is not allowed."""
    if not source or not source.strip():
        raise ConfigError("an expression must not be blank")
    tokens, at = _tokens(source), 0

    def peek() -> tuple[str, str]:
        return tokens[at]

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal at
        token = tokens[at]
        if value is not None and token != ("op", value):
            raise ConfigError(f"expected {value} in expression: {source}")
        at += 1
        return token

    def ternary() -> tuple:
        left = binary(1)
        if peek() == ("op", "?"):
            take()
            yes = ternary()
            take(":")
            return ("if", left, yes, ternary())
        if peek() == ("op", "?:"):
            take()
            return ("elvis", left, ternary())
        return left

    def binary(least: int) -> tuple:
        left = unary()
        while peek()[0] == "op" and _BINARY.get(peek()[1], 0) >= least:
            op = take()[1]
            left = ("binary", op, left, binary(_BINARY[op] + 1))
        return left

    def unary() -> tuple:
        if peek()[0] == "op" and peek()[1] in ("-", "+", "!"):
            op = take()[1]
            if peek() == ("op", op) and op != "!":
                raise ConfigError("++ and -- are not allowed in expressions")
            return ("unary", op, unary())
        return postfix(primary())

    def postfix(node: tuple) -> tuple:
        while peek() in (("op", "."), ("op", "?."), ("op", "[")):
            op = take()[1]
            if op == "[":
                node = ("index", node, ternary())
                take("]")
                continue
            kind, name = take()
            if kind != "name" or peek() == ("op", "("):
                raise ConfigError(f"method calls are not allowed in expressions: {source}")
            node = ("field", node, name)
        if peek() == ("op", "("):
            raise ConfigError(f"calls are not allowed in expressions: {source}")
        return node

    def listed(end: str) -> list[tuple]:
        out = []
        while peek() != ("op", end):
            out.append(ternary())
            if peek() != ("op", end):
                take(",")
        take(end)
        return out

    def primary() -> tuple:
        kind, value = take()
        if kind == "number":
            bare = value.rstrip("LlFfDd")
            return ("literal", int(bare) if re.fullmatch(r"\d+", bare) and value[-1] not in "FfDd" else float(bare))
        if kind == "text":
            return ("literal", value[1:-1].replace(value[0] * 2, value[0]))
        if kind == "name":
            fixed = {"true": True, "false": False, "null": None}
            return ("literal", fixed[value.lower()]) if value.lower() in fixed else ("name", value)
        if value == "(":
            inner = ternary()
            take(")")
            return inner
        if value == "[":
            inner = ternary()
            take("]")
            return ("index", None, inner)
        if value == "{":
            return ("list", *listed("}"))
        if value == "#":
            name = take()[1]
            if name not in _FUNCTIONS or peek() != ("op", "("):
                raise ConfigError(f"variables and other functions than {', '.join(sorted(_FUNCTIONS))} are not allowed")
            take("(")
            arguments = listed(")")
            if len(arguments) != _FUNCTIONS[name]:
                raise ConfigError(f"#{name} takes {_FUNCTIONS[name]} arguments")
            return ("call", name, *arguments)
        raise ConfigError(f"unexpected {value or 'end'} in expression: {source}")

    tree = ternary()
    if peek()[0] != "end":
        raise ConfigError(f"unexpected {peek()[1]} in expression: {source}")
    return tree


def _kind(t: T.DataType | None) -> str:
    if isinstance(t, _INTEGRAL):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(t, T.StringType):
        return "string"
    return "bool" if isinstance(t, T.BooleanType) else "null" if isinstance(t, T.NullType) else "other"


def _literal(value: object) -> Compiled:
    kind = {bool: "bool", int: "int", float: "double", str: "string", type(None): "null"}[type(value)]
    of = {"bool": T.BooleanType(), "int": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "null": T.NullType()}
    return Compiled(F.lit(value).cast("long") if kind == "int" else F.lit(value), F.lit(True), kind, of[kind])


def _error() -> Compiled:
    return Compiled(F.lit(None), F.lit(False), "null", T.NullType())


def _from_field(found: Field | None, ok: Column | None = None) -> Compiled:
    if found is None:
        return _error()
    value = found.column.cast("long") if isinstance(found.type, _INTEGRAL) else found.column
    return Compiled(value, F.lit(True) if ok is None else ok, _kind(found.type), found.type)


class Compiler:
    def __init__(self, schema: T.StructType) -> None:
        self.schema = schema

    def compile(self, node: tuple) -> Compiled:
        return getattr(self, "_" + node[0])(*node[1:])

    def _literal(self, value: object) -> Compiled:
        return _literal(value)

    def _name(self, name: str) -> Compiled:
        return _from_field(Field(column(name), self.schema[name].dataType) if name in self.schema.names else None)

    def _field(self, base: tuple, name: str) -> Compiled:
        path = self._path(base)
        if path is not None:
            whole = lookup(self.schema, f"{path}.{name}")
            if whole is not None:
                return _from_field(whole)
        inner = self.compile(base)
        if isinstance(inner.type, T.StructType) and name in inner.type.names:
            return _from_field(Field(inner.value.getField(name), inner.type[name].dataType), inner.ok)
        return _error()

    def _path(self, node: tuple) -> str | None:
        if node[0] == "name":
            return node[1]
        if node[0] == "field":
            base = self._path(node[1])
            return f"{base}.{node[2]}" if base else None
        return None

    def _index(self, base: tuple | None, at: tuple) -> Compiled:
        if base is None:
            return _from_field(lookup(self.schema, at[1])) if at[0] == "literal" and isinstance(at[1], str) else _error()
        inner = self.compile(base)
        if at[0] == "literal" and isinstance(at[1], str) and isinstance(inner.type, T.StructType):
            return _from_field(Field(inner.value.getField(at[1]), inner.type[at[1]].dataType), inner.ok) if at[1] in inner.type.names else _error()
        key = self.compile(at)
        if isinstance(inner.type, T.MapType):
            return Compiled(F.try_element_at(inner.value, key.value), inner.ok & key.ok, _kind(inner.type.valueType), inner.type.valueType)
        if isinstance(inner.type, T.ArrayType) and key.kind == "int":
            inside = (key.value >= 0) & (key.value < F.size(inner.value))
            return Compiled(F.try_element_at(inner.value, (key.value + 1).cast("int")), inner.ok & key.ok & F.coalesce(inside, F.lit(False)), _kind(inner.type.elementType), inner.type.elementType)
        return _error()

    def _list(self, *nodes: tuple) -> Compiled:
        items = tuple(self.compile(n) for n in nodes)
        ok = reduce(lambda a, b: a & b, [i.ok for i in items], F.lit(True))
        return Compiled(F.array(*[i.value for i in items]), ok, "other", None, items)

    def _call(self, name: str, *nodes: tuple) -> Compiled:
        args = [self.compile(n) for n in nodes]
        if any(a.kind not in ("int", "double") for a in args):
            return _error()
        x = [a.value.cast("double") for a in args]
        value = {"abs": lambda: F.abs(x[0]), "sqrt": lambda: F.sqrt(x[0]), "pow": lambda: F.pow(*x), "max": lambda: F.greatest(*x), "min": lambda: F.least(*x)}[name]()
        ok = reduce(lambda a, b: a & b, [a.ok & a.value.isNotNull() for a in args])
        return Compiled(value, ok, "double", T.DoubleType())

    def _unary(self, op: str, node: tuple) -> Compiled:
        a = self.compile(node)
        if op == "!":
            b = as_condition(a)
            return Compiled(~b.value, b.ok, "bool", T.BooleanType())
        if a.kind not in ("int", "double"):
            return _error()
        return Compiled(-a.value if op == "-" else a.value, a.ok & a.value.isNotNull(), a.kind, a.type)

    def _if(self, test: tuple, yes: tuple, no: tuple) -> Compiled:
        t, a, b = as_condition(self.compile(test)), self.compile(yes), self.compile(no)
        a, b, kind, type_ = _unified(a, b)
        return Compiled(F.when(t.value, a.value).otherwise(b.value), t.ok & F.when(t.value, a.ok).otherwise(b.ok), kind, type_)

    def _elvis(self, left: tuple, right: tuple) -> Compiled:
        a, b = self.compile(left), self.compile(right)
        a, b, kind, type_ = _unified(a, b)
        there = a.value.isNotNull() & ((a.value != "") if kind == "string" else F.lit(True))
        return Compiled(F.when(there, a.value).otherwise(b.value), a.ok & (there | b.ok), kind, type_)

    def _binary(self, op: str, left: tuple, right: tuple) -> Compiled:
        a, b = self.compile(left), self.compile(right)
        if op in ("&&", "||"):
            x, y = as_condition(a), as_condition(b)
            settled = ~x.value if op == "&&" else x.value
            value = x.value & y.value if op == "&&" else x.value | y.value
            return Compiled(value, x.ok & (settled | y.ok), "bool", T.BooleanType())
        if op in _COMPARE:
            return _compare(op, a, b)
        return _arithmetic(op, a, b)


def _unified(a: Compiled, b: Compiled) -> tuple[Compiled, Compiled, str, T.DataType | None]:
    """Two branches of one type: mixed numbers are doubles, other mixtures text."""
    if a.kind == b.kind or "null" in (a.kind, b.kind):
        lead = b if a.kind == "null" else a
        return a, b, lead.kind, lead.type
    kind, sql = ("double", "double") if {a.kind, b.kind} == {"int", "double"} else ("string", "string")
    cast = lambda c: Compiled(c.value.cast(sql), c.ok, kind, None)
    return cast(a), cast(b), kind, T.DoubleType() if kind == "double" else T.StringType()


def _compare(op: str, a: Compiled, b: Compiled) -> Compiled:
    bool_ = lambda value, ok: Compiled(value, ok, "bool", T.BooleanType())
    if op == "between":
        if len(b.items) != 2:
            return _error()
        low, high = _compare(">=", a, b.items[0]), _compare("<=", a, b.items[1])
        return bool_(low.value & high.value, low.ok & high.ok)
    ok = a.ok & b.ok
    if op == "matches":
        if a.kind != "string" or b.kind != "string":
            return _error()
        whole = F.concat(F.lit("\\A(?:"), b.value, F.lit(")\\z"))
        return bool_(F.coalesce(F.regexp_like(a.value, whole), F.lit(False)), ok & a.value.isNotNull() & b.value.isNotNull())
    numeric = {a.kind, b.kind} <= {"int", "double"}
    if op in ("==", "!="):
        same = a.value.eqNullSafe(b.value) if numeric or a.kind == b.kind else a.value.isNull() & b.value.isNull()
        return bool_(same if op == "==" else ~same, ok)
    if not (numeric or a.kind == b.kind or "null" in (a.kind, b.kind)):
        return _error()
    if "null" in (a.kind, b.kind) and a.kind != b.kind:
        sql = (b if a.kind == "null" else a).type
        a, b = Compiled(a.value.cast(sql), a.ok, b.kind), Compiled(b.value.cast(sql), b.ok, a.kind)
    # A null stands before every value.
    order = F.when(a.value.isNull() & b.value.isNull(), 0).when(a.value.isNull(), -1).when(b.value.isNull(), 1).when(a.value < b.value, -1).when(a.value > b.value, 1).otherwise(0)
    return bool_({"<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}[op], ok)


def _arithmetic(op: str, a: Compiled, b: Compiled) -> Compiled:
    if op == "+" and "string" in (a.kind, b.kind):
        word = lambda c: F.coalesce(c.value.cast("string"), F.lit("null"))
        return Compiled(F.concat(word(a), word(b)), a.ok & b.ok, "string", T.StringType())
    if not {a.kind, b.kind} <= {"int", "double"}:
        return _error()
    there = a.ok & b.ok & a.value.isNotNull() & b.value.isNotNull()
    if a.kind == b.kind == "int":
        zero = F.coalesce(b.value == 0, F.lit(True))
        by = F.when(~zero, b.value)
        value = {
            "+": lambda: F.try_add(a.value, b.value),
            "-": lambda: F.try_subtract(a.value, b.value),
            "*": lambda: F.try_multiply(a.value, b.value),
            "/": lambda: ((a.value - F.try_mod(a.value, by)) / by).cast("long"),
            "%": lambda: F.try_mod(a.value, by),
            "^": lambda: F.pow(a.value.cast("double"), b.value.cast("double")).try_cast("long"),
        }[op]()
        return Compiled(value, there & value.isNotNull(), "int", T.LongType())
    x, y = a.value.cast("double"), b.value.cast("double")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    by = F.when(y != 0, y)
    value = {
        "+": lambda: x + y,
        "-": lambda: x - y,
        "*": lambda: x * y,
        "/": lambda: F.coalesce(x / by, F.when((x == 0) | F.isnan(x), nan).when(x > 0, inf).otherwise(-inf)),
        "%": lambda: F.coalesce(x % by, nan),
        "^": lambda: F.pow(x, y),
    }[op]()
    return Compiled(value, there, "double", T.DoubleType())


def as_condition(c: Compiled) -> Compiled:
    """A truth value; what is none, or null, is an error."""
    value = c.value
    if c.kind == "string":
        low = F.lower(F.trim(value))
        value = F.when(low.isin("true", "on", "yes", "1"), True).when(low.isin("false", "off", "no", "0"), False)
    elif c.kind != "bool":
        return Compiled(F.lit(False), F.lit(False), "bool", T.BooleanType())
    return Compiled(F.coalesce(value, F.lit(False)), c.ok & value.isNotNull(), "bool", T.BooleanType())


def compile_expression(source: str, schema: T.StructType) -> Compiled:
    return Compiler(schema).compile(parse(source))


def condition(source: str, schema: T.StructType) -> Column:
    """True where a condition holds; false where it does not, is null or raises an error."""
    c = as_condition(compile_expression(source, schema))
    return F.coalesce(c.ok & c.value, F.lit(False))
