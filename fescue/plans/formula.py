"""What an estimation is asked for. A short formula is split into Spark SQL expressions; nothing is evaluated here.

``y ~ x1 + log(x2) + i(f, ref='a') | fe1 + fe2^fe3 + fe4[x5] | endo ~ inst``
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from itertools import accumulate

STEPWISE = ("sw", "sw0", "csw", "csw0", "mvsw")
_MACROS: dict[str, str] = {}


def split_top(text: str, sep: str) -> list[str]:
    """text at the separators that stand outside brackets and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == sep and not depth:
            out.append(text[start:k])
            start = k + 1
    return [x.strip() for x in [*out, text[start:]]]


def call(text: str) -> tuple[str, list[str], dict[str, str]] | None:
    """name, arguments, named arguments if text is one call."""
    m = re.fullmatch(r"([A-Za-z_.][\w.]*)\((.*)\)", text, re.S)
    if not m or len(split_top(m[2] + ")", ")")) < 1:
        return None
    depth = 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0 and c == ")" and k < len(text) - 1:
            return None
    args, named = [], {}
    for a in split_top(m[2], ",") if m[2].strip() else []:
        if eq := re.match(r"([A-Za-z_][\w.]*)\s*=(?!=)\s*(.*)", a, re.S):
            named[eq[1]] = eq[2]
        else:
            args.append(a)
    return m[1], args, named


@dataclass(frozen=True)
class Effect:
    """A fixed effect: key columns, slope expressions, and whether the level itself is absorbed too."""

    keys: tuple[str, ...]
    slopes: tuple[str, ...] = ()
    level: bool = True

    @property
    def name(self) -> str:
        base = "^".join(self.keys)
        return base + (f"[{', '.join(self.slopes)}]" if self.level else f"[[{', '.join(self.slopes)}]]") if self.slopes else base


@dataclass(frozen=True)
class Request:
    lhs: str
    rhs: tuple[str, ...] = ()
    effects: tuple[Effect, ...] = ()
    endo: tuple[str, ...] = ()
    inst: tuple[str, ...] = ()
    intercept: bool = True
    tags: dict = field(default_factory=dict, hash=False, compare=False)

    def __str__(self) -> str:
        text = f"{self.lhs} ~ {' + '.join((() if self.intercept else ('-1',)) + self.rhs) or '1'}"
        text += f" | {' + '.join(e.name for e in self.effects)}" if self.effects else ""
        return text + (f" | {' + '.join(self.endo)} ~ {' + '.join(self.inst)}" if self.endo else "")


def set_macro(name: str, text: str) -> None:
    """..name in later formulas stands for text."""
    _MACROS[name.lstrip(".")] = text


def expand(formula: str, columns: list[str] = (), **values) -> str:
    """Macros, ..('regex') over the columns, prefixes as x.., and .[name] for values that are passed by name."""

    def listed(value) -> str:
        return " + ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)

    for _ in range(10):
        before = formula
        formula = re.sub(r"\.\[(\w+)\]", lambda m: listed(values[m[1]]) or "1", formula)
        formula = re.sub(r"(?:\.\.|regex)\((['\"])(.*?)\1\)", lambda m: " + ".join(c for c in columns if re.search(m[2], c)) or "1", formula)
        formula = re.sub(r"\b(\w+)\.\.(?!\w)", lambda m: " + ".join(c for c in columns if c.startswith(m[1])) or "1", formula)
        formula = re.sub(r"\.\.(\w+)", lambda m: _MACROS[m[1]], formula)
        if formula == before:
            break
    return formula


def _terms(text: str) -> tuple[list[str], bool]:
    """Terms, and whether the intercept stays. a*b stands for a + b + a:b."""
    out, intercept = [], True
    text = re.sub(r"-\s*1\b", "+ -1", text) if re.search(r"(^|[+\s])-\s*1\b", text) else text
    for t in split_top(text, "+"):
        if t in ("", "1"):
            continue
        if t in ("-1", "0"):
            intercept = False
        elif len(parts := split_top(t, "*")) > 1:
            out += [*parts, ":".join(parts)]
        else:
            out.append(t)
    return list(dict.fromkeys(out)), intercept


def effect(text: str) -> Effect:
    m = re.fullmatch(r"(.*?)\[\[(.*)\]\]", text) or re.fullmatch(r"(.*?)\[(.*)\]", text)
    keys = tuple(k.strip() for k in (m[1] if m else text).split("^"))
    return Effect(keys, tuple(split_top(m[2], ",")) if m else (), not (m and "[[" in text))


def choices(terms: list[str]) -> list[list[str]]:
    """The lists of terms that one stepwise call stands for; just the terms if there is none."""
    found = [k for k, t in enumerate(terms) if (c := call(t)) and c[0] in STEPWISE]
    if len(found) > 1:
        raise ValueError("only one stepwise function is allowed in a part")
    if not found:
        return [terms]
    kind, args, _ = call(terms[found[0]])
    args = [split_top(a, "+") for a in args]
    if kind in ("sw", "sw0"):
        steps = args
    elif kind == "mvsw":
        steps = [[t for a, on in zip(args, bits) if on for t in a] for bits in ([bool(m >> k & 1) for k in range(len(args))] for m in range(2 ** len(args)))]
    else:
        steps = list(accumulate(args))
    if kind in ("sw0", "csw0"):
        steps = [[], *steps]
    return [terms[: found[0]] + s + terms[found[0] + 1 :] for s in steps]


def parse(formula: str, columns: list[str] = (), **values) -> list[Request]:
    """One request for each combination of left-hand sides, stepwise regressors and stepwise effects."""
    formula = expand(formula, list(columns), **values)
    lhs, _, right = formula.partition("~")
    parts = split_top(right, "|")
    if len(parts) > 3 or not lhs.strip() and "~" not in formula:
        raise ValueError(f"formula has too many parts: {formula}")
    iv = next((p for p in parts[1:] if len(split_top(p, "~")) == 2), None)
    fe = next((p for p in parts[1:] if p is not iv), "0")
    c = call(lhs.strip())
    outcomes = c[1] if c and c[0] in ("c", "mvsw") else [x for x in split_top(lhs, "+")]
    terms, intercept = _terms(parts[0])
    endo, inst = ([x for x in split_top(side, "+")] for side in split_top(iv, "~")) if iv else ([], [])
    if len(inst) < len(endo):
        raise ValueError("there are fewer instruments than endogenous variables")
    out = []
    for y in outcomes:
        for k, fes in enumerate(choices([x for x in split_top(fe, "+") if x not in ("0", "1", "")])):
            for j, xs in enumerate(choices(terms)):
                effects = tuple(effect(f) for f in fes)
                no_level = effects and not any(e.level for e in effects)
                out.append(Request(y, tuple(xs), effects, tuple(endo), tuple(inst), intercept and (not effects or bool(no_level)), {"lhs": y, "rhs": j + 1, "fixef": k + 1}))
    return out


def update(request: Request, formula: str) -> str:
    """A formula in which dots stand for the parts of an earlier request."""
    lhs, _, right = formula.partition("~")
    parts = split_top(right, "|")
    was = [str(request).partition("~")[2].split("|")[0].strip(), " + ".join(e.name for e in request.effects)]
    done = [re.sub(r"(?<![\w.])\.(?![\w.\[(])", was[k] or "0", p) if k < 2 else p for k, p in enumerate(parts)]
    if len(parts) == 1 and request.effects:
        done.append(was[1])
    drop = [m.strip() for p in done[:1] for m in re.findall(r"-\s*([A-Za-z_]\w*)", p)]
    first = re.sub(r"-\s*[A-Za-z_]\w*", "", done[0])
    first = " + ".join(t for t in split_top(first, "+") if t and t not in drop) or "1"
    return f"{lhs.strip() if lhs.strip() not in ('', '.') else request.lhs} ~ " + " | ".join([first, *done[1:]])


def without(request: Request, **changes) -> Request:
    return replace(request, **changes)
