"""Formulas: ``y1 + y2 ~ x1 + C(v) + i(t, d, ref=0) | a + b^c + g[t] | endog ~ z`` as Spark columns.

Categories become indicators with treatment coding: the first level in sort order is dropped. Multiple estimation goes through several
outcomes and ``sw, csw, sw0, csw0`` in the covariates and in the fixed effects.
"""

from __future__ import annotations

import ast
import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALLS = {"I": lambda x: x, "log": F.ln, "log1p": F.log1p, "log10": F.log10, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs}
COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
STEPS = ("sw", "csw", "sw0", "csw0")
MOST_LEVELS = 10_000


class FormulaError(ValueError):
    """A formula that can't be read."""


def split_top(text: str, sep: str) -> list[str]:
    """Parts of text at separators outside brackets; ``::`` is no separator ``:``."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        depth += (c in "([") - (c in ")]")
        if depth == 0 and text.startswith(sep, i) and not (sep == ":" and (text[i : i + 2] == "::" or text[i - 1 : i + 1] == "::")) and not (sep == "*" and (text[i : i + 2] == "**" or text[i - 1 : i + 1] == "**")):
            out.append(text[at:i])
            i += len(sep)
            at = i
            continue
        i += 1
    return [p.strip() for p in [*out, text[at:]]]


def expression(text: str) -> Column:
    """A scalar expression of the formula language as a double column; divisions by zero and logs out of range are null."""
    return _column(ast.parse(text.strip(), mode="eval").body).cast("double")


def _column(node: ast.AST) -> Column:
    if isinstance(node, ast.Name):
        return F.col(f"`{node.id}`").cast("double")
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return F.lit(float(node.value))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        x = _column(node.operand)
        return -x if isinstance(node.op, ast.USub) else x
    if isinstance(node, ast.BinOp):
        a, b = _column(node.left), _column(node.right)
        if isinstance(node.op, ast.Add):
            return a + b
        if isinstance(node.op, ast.Sub):
            return a - b
        if isinstance(node.op, ast.Mult):
            return a * b
        if isinstance(node.op, ast.Pow):
            return F.pow(a, b)
        if isinstance(node.op, (ast.Div, ast.FloorDiv, ast.Mod)):
            whole = F.when(b != 0, a / b)
            return whole if isinstance(node.op, ast.Div) else F.floor(whole).cast("double") if isinstance(node.op, ast.FloorDiv) else a - b * F.floor(whole)
    if isinstance(node, ast.Compare) and len(node.ops) == 1:
        return getattr(_column(node.left), COMPARE[type(node.ops[0])])(_column(node.comparators[0])).cast("double")
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in CALLS and len(node.args) == 1 and not node.keywords:
        return CALLS[node.func.id](_column(node.args[0]))
    raise FormulaError(f"not understood: {ast.unparse(node)}; there are + - * / ** // %, comparisons and {', '.join(CALLS)}, C() and i()")


@dataclass(frozen=True)
class FixedEffect:
    """Levels by one or more columns, and the slopes that vary by level."""

    name: str
    keys: tuple[str, ...]
    slopes: tuple[str, ...] = ()

    @property
    def level(self) -> Column:
        keys = [F.col(f"`{k}`") for k in self.keys]
        return keys[0] if len(keys) == 1 else F.when(all_present(keys), F.to_json(F.struct(*[k.cast("string").alias(f"k{i}") for i, k in enumerate(keys)])))


def all_present(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull()
    return out


@dataclass(frozen=True)
class Model:
    """One model: terms by name as written, and its fixed effects."""

    outcome: str
    covariates: tuple[str, ...]
    fe: tuple[FixedEffect, ...] = ()
    endogenous: tuple[str, ...] = ()
    instruments: tuple[str, ...] = ()
    text: str = ""
    intercept: bool = True


@dataclass
class Design:
    """Names and columns of one model's variables."""

    outcome: str
    x: dict[str, Column] = field(default_factory=dict)
    endog: dict[str, Column] = field(default_factory=dict)
    z: dict[str, Column] = field(default_factory=dict)


def fixed_effect(text: str) -> FixedEffect:
    if "[[" in text:
        raise FormulaError("slopes without the level's own intercept, [[ ]], are not supported")
    m = re.fullmatch(r"(.+?)\[(.+)\]", text.strip())
    base, slopes = (m[1], tuple(s.strip() for s in split_top(m[2], ","))) if m else (text.strip(), ())
    keys = tuple(k.strip() for k in re.split(r"[\^:]", base))
    if not all(re.fullmatch(r"\w+", k) for k in keys):
        raise FormulaError(f"a fixed effect is a column or columns joined by ^, not {text!r}")
    return FixedEffect("^".join(keys), keys, slopes)


def alternatives(text: str) -> list[list[str]]:
    """Lists of terms of a part: more than one if it holds sw(), csw(), sw0() or csw0()."""
    if not text or text in ("0", "1", "-1"):
        return [[] if text != "0" and text != "-1" else ["0"]]
    choices = []
    for term in split_top(text, "+"):
        m = re.fullmatch(r"(c?sw0?)\((.*)\)", term, re.DOTALL)
        if m and m[1] in STEPS:
            own = split_top(m[2], ",")
            steps = [split_top("+".join(own[: i + 1]) if m[1][0] == "c" else own[i], "+") for i in range(len(own))]
            choices.append(([[]] if m[1].endswith("0") else []) + steps)
        elif len(parts := split_top(term, "*")) > 1 and not re.search(r"[\d)]\s*\*|\*\s*\d", term):
            crossed = [":".join(c) for n in range(1, len(parts) + 1) for c in itertools.combinations(parts, n)]
            choices.append([crossed])
        elif term != "1":
            choices.append([[term]])
    return [[t for part in pick for t in part] for pick in itertools.product(*choices)] or [[]]


def parse(fml: str) -> list[Model]:
    """All models of a formula, in order: fixed effects outermost, then covariates, then outcomes."""
    if "~" not in fml:
        raise FormulaError("a formula has the form y ~ x | fixed effects | endogenous ~ instruments")
    left, _, rest = fml.partition("~")
    parts = split_top(rest, "|")
    iv = re.search(r"\[([^\[\]]*)~([^\[\]]*)\]", parts[0])
    if iv:
        parts[0] = re.sub(r"\+?\s*\[[^\[\]]*~[^\[\]]*\]\s*", "", parts[0]).strip(" +") or "1"
        endog, inst = iv[1], iv[2]
    else:
        ivs = [p for p in parts[1:] if "~" in p]
        endog, inst = ivs[0].split("~") if ivs else ("", "")
        parts = [p for p in parts if "~" not in p]
    fes = alternatives(parts[1]) if len(parts) > 1 and parts[1] != "0" else [[]]
    out = []
    for fe in fes:
        effects = tuple(fixed_effect(t) for t in fe)
        if len({e.name for e in effects}) < len(effects):
            raise FormulaError("a fixed effect is listed twice")
        for xs in alternatives(parts[0]):
            xs = list(dict.fromkeys(xs))
            for y in split_top(left, "+"):
                out.append(Model(y, tuple(x for x in xs if x != "0"), effects, tuple(t for t in split_top(endog, "+") if t), tuple(t for t in split_top(inst, "+") if t), fml, "0" not in xs))
    return out


def levels_of(df: DataFrame, name: str) -> list:
    """Sorted distinct values of a categorical: part of the plan, MOST_LEVELS at most (more belong in a fixed effect)."""
    rows = df.select(F.col(f"`{name}`").alias("v")).dropna().distinct().orderBy("v").limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise FormulaError(f"{name} has more than {MOST_LEVELS} levels: make it a fixed effect")
    return [r["v"] for r in rows]


def shown(v) -> str:
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


class Compiler:
    """Terms to named columns over a source; keeps the levels that it has looked up."""

    def __init__(self, df: DataFrame):
        self.df, self.levels, self.text = df, {}, {c for c, t in df.dtypes if t in ("string", "boolean")}

    def of(self, name: str) -> list:
        if name not in self.levels:
            if name not in self.df.columns:
                raise FormulaError(f"no column {name}")
            self.levels[name] = levels_of(self.df, name)
        return self.levels[name]

    def component(self, text: str, full: bool) -> list[tuple[str, Column]]:
        """Named columns of one factor of a term; full: keeps the first level of a category."""
        if m := re.fullmatch(r"C\((\w+)\)", text):
            own = self.of(m[1])[0 if full else 1 :]
            return [(f"{text}[{'' if full else 'T.'}{shown(v)}]", (F.col(f"`{m[1]}`") == F.lit(v)).cast("double")) for v in own]
        if m := re.fullmatch(r"i\((.*)\)", text, re.DOTALL):
            return self.indicator(split_top(m[1], ","))
        if text in self.text:
            own = self.of(text)[0 if full else 1 :]
            return [(f"{text}[{'' if full else 'T.'}{shown(v)}]", (F.col(f"`{text}`") == F.lit(v)).cast("double")) for v in own]
        return [(text, expression(text))]

    def indicator(self, args: list[str]) -> list[tuple[str, Column]]:
        """i(v), i(v, ref=a), i(v, w) and i(v, w, ref=a): w is numeric, or a category of which the first level is left out."""
        ref, names = None, []
        for a in args:
            key, eq, value = a.partition("=")
            if eq and key.strip() in ("ref", "ref2"):
                ref = ast.literal_eval(value.strip())
            elif eq:
                raise FormulaError(f"i() takes ref=, not {key.strip()}=")
            else:
                names.append(a)
        v = names[0]
        own = self.of(v)
        if ref is not None and ref not in own:
            raise FormulaError(f"{ref!r} is no level of {v}")
        own = [x for x in own if x != ref] if ref is not None else own if len(names) > 1 else own[1:]
        base = [(f"{v}::{shown(x)}", (F.col(f"`{v}`") == F.lit(x)).cast("double")) for x in own]
        if len(names) == 1:
            return base
        more = self.component(names[1], False)
        return [(f"{n}:{m}", c * d) for n, c in base for m, d in more]

    def term(self, text: str) -> list[tuple[str, Column]]:
        parts = split_top(text, ":")
        out = self.component(parts[0], len(parts) > 1)
        for p in parts[1:]:
            out = [(f"{n}:{m}", c * d) for n, c in out for m, d in self.component(p, True)]
        return out

    def design(self, m: Model) -> Design:
        d = Design(m.outcome)
        d.x = dict(x for t in m.covariates for x in self.term(t))
        d.endog = dict(x for t in m.endogenous for x in self.term(t))
        d.z = {n: c for t in m.instruments for n, c in self.term(t) if n not in d.x}
        if not m.fe and m.intercept:
            d.x = {"Intercept": F.lit(1.0), **d.x}
        return d
