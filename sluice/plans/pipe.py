"""The pipe language, compiled to DataFrame calls.

    FROM t | WHERE e | COMPUTE c = e | [INNER | LEFT] JOIN u ON a = b | AGGREGATE f(e) [AS x], ... [BY c, ...]
      | HAVING e | SELECT e [AS x], ... | SORT c [ASC | DESC], ... | LIMIT n [OFFSET m] | DISTINCT

Stages run in the order in which they are written. Expressions are parsed here, as some of their rules differ
from SQL's: LIKE ignores case, division and remainder by zero give null, + joins text, round goes to the even neighbour, and
[1, 2] is a vector. All other functions are Spark's. What follows an expression without belonging to it is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import scalars, vectors

Resolver = Callable[[str], DataFrame]

_TOKEN = re.compile(
    r"(?P<skip>\s+|(?:#|--)[^\n]*)"
    r"|(?P<number>\d+(?:\.\d*)?[eE][-+]?\d+(?![\w.])|\d+\.\d+(?![\w])|\d+(?![\w.]))"
    r"|(?P<string>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\")"
    r"|(?P<name>`[^`]+`|\w+(?:\.\w+)*)"
    r"|(?P<op><=>|==|!=|<>|<=|>=|\|\||[-+*/%<>=(),\[\]|;])",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
STAGES = {"WHERE", "FILTER", "COMPUTE", "SELECT", "AGGREGATE", "HAVING", "SORT", "ORDER", "LIMIT", "OFFSET", "JOIN", "INNER", "LEFT", "DISTINCT"}


class PipeError(ValueError):
    """A query that is no query of this language."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PipeError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", at)]


def unquote(text: str) -> str:
    """A string literal's value: a doubled quote is one, a backslash escapes."""
    quote, inner = text[0], text[1:-1]
    return re.sub(r"\\(.)|" + quote * 2, lambda m: _ESCAPES.get(m[1], m[1]) if m[1] else quote, inner, flags=re.S)


@dataclass(frozen=True)
class Value:
    """An expression: its column, whether it is a literal, and the numbers of a vector literal."""

    column: Column
    literal: bool = False
    vector: tuple[float, ...] | None = None
    constant: object = None


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.k = text, tokenize(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def take(self) -> Token:
        self.k += 1
        return self.tokens[self.k - 1]

    def op(self, *texts: str) -> str | None:
        return self.take().text if self.now.kind == "op" and self.now.text in texts else None

    def word(self, *words: str) -> str | None:
        return self.take().word if self.now.word in words else None

    def need(self, text: str) -> None:
        if not (self.op(text) or self.word(text)):
            raise PipeError(f"expected {text} at {self.now.at}, not {self.now.text!r}")

    def name(self) -> str:
        if self.now.kind != "name":
            raise PipeError(f"expected a name at {self.now.at}, not {self.now.text!r}")
        return self.take().text.strip("`")

    def whole(self) -> int:
        if self.now.kind != "number" or not self.now.text.isdigit():
            raise PipeError(f"expected a whole number at {self.now.at}, not {self.now.text!r}")
        return int(self.take().text)


class Expressions(Parser):
    """Parses expressions over the columns of one DataFrame."""

    def __init__(self, parser: Parser, df: DataFrame):
        self.text, self.tokens, self.k, self.df, self.parent = parser.text, parser.tokens, parser.k, df, parser

    def parse(self) -> Value:
        out = self.disjunction()
        self.parent.k = self.k
        return out

    def kind(self, v: Value) -> T.DataType:
        return self.df.select(v.column.alias("x")).schema[0].dataType

    def disjunction(self) -> Value:
        left = self.conjunction()
        while self.word("OR"):
            left = Value(self.condition(left) | self.condition(self.conjunction()))
        return left

    def conjunction(self) -> Value:
        left = self.negation()
        while self.word("AND"):
            left = Value(self.condition(left) & self.condition(self.negation()))
        return left

    def condition(self, v: Value) -> Column:
        """A value as a condition: numbers are true unless 0, texts unless empty."""
        kind = self.kind(v)
        if isinstance(kind, T.BooleanType):
            return v.column
        return v.column != "" if isinstance(kind, T.StringType) else v.column.cast("boolean")

    def negation(self) -> Value:
        if self.word("NOT"):
            return Value(~self.condition(self.negation()))
        return self.comparison()

    def comparison(self) -> Value:
        left = self.sum()
        if self.word("IS"):
            negated = self.word("NOT")
            self.need("NULL")
            return Value(left.column.isNotNull() if negated else left.column.isNull())
        negated = bool(self.word("NOT"))
        if self.word("LIKE", "ILIKE"):
            right = self.sum()
            text = left.column.cast("string")
            # the pattern has no escape character
            found = text.ilike(right.constant.replace("\\", "\\\\")) if isinstance(right.constant, str) else F.ilike(text, F.replace(right.column.cast("string"), F.lit("\\"), F.lit("\\\\")))
            return Value(~found if negated else found)
        if self.word("IN"):
            self.need("(")
            options = [self.sum()]
            while self.op(","):
                options.append(self.sum())
            self.need(")")
            found = self.compare("=", left, options[0])
            for o in options[1:]:
                found = found | self.compare("=", left, o)
            return Value(~found if negated else found)
        if self.word("BETWEEN"):
            low = self.sum()
            self.need("AND")
            found = self.compare(">=", left, low) & self.compare("<=", left, self.sum())
            return Value(~found if negated else found)
        if negated:
            raise PipeError(f"expected LIKE, IN or BETWEEN at {self.now.at}")
        if self.op("<=>"):
            return Value(left.column.eqNullSafe(self.sum().column))
        if found := self.op("=", "==", "!=", "<>", "<", "<=", ">", ">="):
            return Value(self.compare({"==": "=", "<>": "!="}.get(found, found), left, self.sum()))
        return left

    def compare(self, op: str, left: Value, right: Value) -> Column:
        return scalars.compare(op, left.column, right.column, self.kind(left), self.kind(right), left.literal, right.literal)

    def sum(self) -> Value:
        left = self.product()
        while op := self.op("+", "-", "||"):
            right = self.product()
            if op == "-":
                left = Value(left.column - right.column)
            else:
                text = [op == "||" or isinstance(self.kind(v), T.StringType) for v in (left, right)]
                left = Value(scalars.add(left.column, right.column, *text))
        return left

    def product(self) -> Value:
        left = self.sign()
        while op := self.op("*", "/", "%"):
            right = self.sign()
            left = Value(left.column * right.column if op == "*" else scalars.safe_divide(left.column, right.column) if op == "/" else scalars.floor_mod(left.column, right.column))
        return left

    def sign(self) -> Value:
        if self.op("-"):
            v = self.sign()
            return Value(-v.column, v.literal, constant=-v.constant if isinstance(v.constant, (int, float)) else None)
        if self.op("+"):
            return self.sign()
        return self.primary()

    def primary(self) -> Value:
        t = self.now
        if t.kind == "number":
            self.take()
            value = int(t.text) if t.text.isdigit() else float(t.text)
            return Value(F.lit(value), True, constant=value)
        if t.kind == "string":
            self.take()
            value = unquote(t.text)
            return Value(F.lit(value), True, constant=value)
        if self.op("["):
            return self.vector()
        if self.op("("):
            v = self.disjunction()
            self.need(")")
            return v
        if t.word in ("TRUE", "FALSE"):
            self.take()
            return Value(F.lit(t.word == "TRUE"), True, constant=t.word == "TRUE")
        if self.word("NULL"):
            return Value(F.lit(None), True)
        if self.word("CASE"):
            return self.case()
        if t.kind == "name":
            name = self.name()
            return self.call(name) if self.op("(") else self.column(name)
        raise PipeError(f"expected an expression at {t.at}, not {t.text!r}")

    def vector(self) -> Value:
        numbers = []
        while not self.op("]"):
            minus = self.op("-")
            self.op("+")
            if self.now.kind != "number":
                raise PipeError(f"expected a number at {self.now.at}, not {self.now.text!r}")
            number = float(self.take().text)
            numbers.append(-number if minus else number)
            if not self.op(","):
                self.need("]")
                break
        return Value(F.array(*[F.lit(x) for x in numbers]).cast("array<double>"), True, tuple(numbers))

    def case(self) -> Value:
        out = None
        while self.word("WHEN"):
            when = self.condition(self.disjunction())
            self.need("THEN")
            then = self.disjunction().column
            out = F.when(when, then) if out is None else out.when(when, then)
        if out is None:
            raise PipeError(f"expected WHEN at {self.now.at}")
        if self.word("ELSE"):
            out = out.otherwise(self.disjunction().column)
        self.need("END")
        return Value(out)

    def column(self, name: str) -> Value:
        """A column by its name; a qualified name that no column has: by the part after the last dot."""
        for found in (name, name.rpartition(".")[2]):
            if match := [c for c in self.df.columns if c == found] or [c for c in self.df.columns if c.lower() == found.lower()]:
                return Value(F.col(f"`{match[0]}`"))
        raise PipeError(f"no column {name!r}; there are {', '.join(self.df.columns)}")

    def call(self, name: str) -> Value:
        low = name.lower()
        if low == "cast":
            v = self.disjunction()
            self.need("AS")
            kind = self.name().lower()
            self.need(")")
            return Value(v.column.try_cast(scalars.TYPES.get(kind, kind)))
        distinct, args = bool(self.word("DISTINCT")), []
        if self.op("*"):
            self.need(")")
            return Value(F.count(F.lit(1)))
        while not self.op(")"):
            args.append(self.disjunction())
            if not self.op(","):
                self.need(")")
                break
        if distinct:
            if low != "count":
                raise PipeError(f"DISTINCT goes with count, not {name}")
            return Value(F.count_distinct(*[a.column for a in args]))
        return Value(self.function(low, args))

    def function(self, low: str, args: list[Value]) -> Column:
        columns = [a.column for a in args]
        if low in vectors.BY_NAME:
            if len(args) != 2:
                raise PipeError(f"{low} takes two vectors")
            if args[0].vector is not None and args[1].vector is None:
                args = args[::-1]  # all of these are symmetric; the constant goes second
            a = vectors.to_vector(args[0].column, self.kind(args[0]))
            b = args[1].vector if args[1].vector is not None else vectors.to_vector(args[1].column, self.kind(args[1]))
            return vectors.BY_NAME[low](a, b)
        if low == "l2_norm":
            return vectors.l2_norm(vectors.to_vector(columns[0], self.kind(args[0])))
        if low == "round":
            digits = args[1].constant if len(args) > 1 else 0
            if not isinstance(digits, int):
                raise PipeError("round takes a constant number of digits")
            return scalars.half_even(columns[0], digits)
        if low == "trim" and len(args) == 1:
            return scalars.trim_all(columns[0])
        if low in ("length", "len"):
            return scalars.text_length(columns[0])
        if low == "count" and not args:
            return F.count(F.lit(1))
        if low == "stddev":
            return F.stddev_samp(columns[0])
        return F.call_function(low, *columns)


def compile_pipe(text: str, resolve: Resolver) -> DataFrame:
    """The DataFrame of a query that starts with FROM."""
    p = Parser(text)
    p.need("FROM")
    source = unquote(p.take().text) if p.now.kind == "string" else p.name()
    return _stages(p, resolve(source), resolve)


def apply_pipe(df: DataFrame, text: str, resolve: Resolver | None = None) -> DataFrame:
    """``df`` through the stages of ``text``, which may start with a bar. Works on streams as far as Spark's operators do."""
    return _stages(Parser(text), df, resolve or _no_tables, True)


def expression(df: DataFrame, text: str) -> Column:
    """One expression over the columns of ``df``."""
    p = Parser(text)
    out = Expressions(p, df).parse()
    if p.now.kind != "end":
        raise PipeError(f"unexpected {p.now.text!r} at {p.now.at}")
    return out.column


def condition(df: DataFrame, text: str) -> Column:
    """One expression as a condition."""
    p = Parser(text)
    e = Expressions(p, df)
    out = e.condition(e.parse())
    if p.now.kind != "end":
        raise PipeError(f"unexpected {p.now.text!r} at {p.now.at}")
    return out


def _no_tables(name: str) -> DataFrame:
    raise PipeError(f"no table {name!r}")


def _stages(p: Parser, df: DataFrame, resolve: Resolver, bare: bool = False) -> DataFrame:
    while p.now.kind != "end":
        if p.op(";"):
            continue
        if not p.op("|") and not bare:
            raise PipeError(f"unexpected {p.now.text!r} at {p.now.at}")
        bare = False
        if p.now.kind != "end":
            df = _stage(p, df, resolve)
    return df


def _stage(p: Parser, df: DataFrame, resolve: Resolver) -> DataFrame:
    at, stage = p.now.at, p.word(*STAGES)
    if stage in ("WHERE", "FILTER", "HAVING"):
        e = Expressions(p, df)
        return df.filter(e.condition(e.parse()))
    if stage == "COMPUTE":
        while True:
            name = p.name()
            if not p.op("="):
                p.need("==")
            df = df.withColumn(name, Expressions(p, df).parse().column)
            if not p.op(","):
                return df
    if stage == "SELECT":
        out = []
        while True:
            if p.op("*"):
                out += [F.col(f"`{c}`") for c in df.columns]
            else:
                plain = p.now.text.strip("`")
                column = Expressions(p, df).parse().column
                out.append(column.alias(p.name()) if p.word("AS") else column.alias(plain) if plain in df.columns else column)
            if not p.op(","):
                return df.select(*out)
    if stage == "AGGREGATE":
        df = _aggregate(p, df)
        if p.word("HAVING"):  # may follow without a bar
            e = Expressions(p, df)
            df = df.filter(e.condition(e.parse()))
        return df
    if stage in ("SORT", "ORDER"):
        if stage == "ORDER":
            p.need("BY")
        keys = []
        while True:
            column = Expressions(p, df).parse().column
            keys.append(column.desc_nulls_first() if p.word("ASC", "DESC") == "DESC" else column.asc_nulls_last())
            if not p.op(","):
                return df.orderBy(*keys)
    if stage == "LIMIT":
        n = p.whole()
        return (df.offset(p.whole()) if p.word("OFFSET") else df).limit(n)
    if stage == "OFFSET":
        return df.offset(p.whole())
    if stage == "DISTINCT":
        return df.distinct()
    if stage in ("JOIN", "INNER", "LEFT"):
        if stage != "JOIN":
            p.word("OUTER")
            p.need("JOIN")
        return _join(p, df, resolve, "left" if stage == "LEFT" else "inner")
    raise PipeError(f"expected a stage at {at}, not {p.now.text!r}")


def _aggregate(p: Parser, df: DataFrame) -> DataFrame:
    calls = []
    while True:
        start = p.k
        column = Expressions(p, df).parse().column
        used = p.tokens[start : p.k]
        if p.word("AS"):
            alias = p.name()
        else:  # f(c) is called f_c, f(*) and f() are called f
            names = [t.text.strip("`") for t in used if t.kind == "name"]
            alias = "_".join(names[:2])
        calls.append(column.alias(alias))
        if not p.op(","):
            break
    keys = []
    if p.word("GROUP"):
        p.need("BY")
        by = True
    else:
        by = bool(p.word("BY"))
    while by:
        plain = p.now.text.strip("`").rpartition(".")[2]
        keys.append(Expressions(p, df).parse().column.alias(plain))
        by = bool(p.op(","))
    return df.groupBy(*keys).agg(*calls)


def _join(p: Parser, left: DataFrame, resolve: Resolver, how: str) -> DataFrame:
    table = unquote(p.take().text) if p.now.kind == "string" else p.name()
    right = resolve(table)
    p.need("ON")
    pairs = []
    while True:
        a = p.name()
        if not p.op("=", "=="):
            p.need("=")
        pairs.append((a, p.name()))
        if not p.word("AND"):
            break
    return join(left, right, pairs, how, table.rpartition("/")[2].rpartition(".")[2])


def join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str, table: str) -> DataFrame:
    """An equi-join. Columns of the right table whose names the left one has are called ``table.name`` after it. Keys of text and number compare as text."""
    named = right.select(*[F.col(f"`{c}`").alias(f"{table}.{c}" if c in left.columns else c) for c in right.columns])

    def find(name: str, df: DataFrame) -> str | None:
        bare = name.rpartition(".")[2]
        return next((c for c in (name, bare) if c in df.columns), None)

    on = None
    for a, b in pairs:
        if b.startswith(f"{table}.") or not a.startswith(f"{table}.") and find(a, left) and find(b, right):
            l, r = find(a, left), find(b, right)  # noqa: E741
        else:
            l, r = find(b, left), find(a, right)  # noqa: E741
        if l is None or r is None:
            raise PipeError(f"no join on {a} = {b}")
        r_named = f"{table}.{r}" if r in left.columns else r
        lc, rc = left[f"`{l}`"], named[f"`{r_named}`"]
        texts = [isinstance(left.schema[l].dataType, T.StringType), isinstance(right.schema[r].dataType, T.StringType)]
        if texts[0] != texts[1]:
            lc, rc = lc.cast("string"), rc.cast("string")
        one = lc == rc
        on = one if on is None else on & one
    return left.join(named, on, how)
