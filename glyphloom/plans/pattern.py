"""The pattern algebra: a small tree that renders to a regex and carries its own cost and specificity.

Everything here is driver-side arithmetic on a handful of nodes; matching always happens in Spark (``matches``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = math.inf

# Regex text, base cost and fixed-length specificity of each character class.
CLASSES = {
    "digit": (r"\d", 1.0, 0.9),
    "upper": ("[A-Z]", 1.5, 0.85),
    "lower": ("[a-z]", 1.5, 0.85),
    "alpha": ("[a-zA-Z]", 2.0, 0.7),
    "alnum": ("[a-zA-Z0-9]", 2.5, 0.6),
    "word": (r"\w", 3.0, 0.5),
    "any": (".", 5.0, 0.5),
}
# For enumerations up to a size, cost as (base, per value) and specificity.
ENUM_TIERS = ((1, 1.0, 0.0, 1.0), (5, 1.0, 0.2, 0.9), (10, 2.0, 0.3, 0.7), (20, 4.0, 0.4, 0.5), (INF, 10.0, 0.5, 0.3))
# What a regex must escape, and how control characters are written.
ESCAPED = set(".^$*+?()[]{}|#-\\ ")
CONTROLS = {"\t": "\\t", "\n": "\\n", "\v": "\\v", "\f": "\\f", "\r": "\\r"}


def escape(text: str) -> str:
    return "".join(CONTROLS.get(c) or ("\\" + c if c in ESCAPED else c) for c in text)


def inspect(text: str) -> str:
    """A quoted string with quotes, backslashes, interpolation marks and control characters escaped."""
    named = {'"': '\\"', "\\": "\\\\", "\a": "\\a", "\b": "\\b", "\x1b": "\\e", "\0": "\\0", "\x7f": "\\d"} | CONTROLS
    out = "".join(named.get(c) or (f"\\x{ord(c):02X}" if ord(c) < 32 else c) for c in text)
    return '"' + out.replace("#{", "\\#{") + '"'


def grapheme_count(text: str) -> int:
    import regex

    return len(regex.findall(r"\X", text))


def _times(low: int, high: float) -> str:
    if (low, high) == (1, 1):
        return ""
    if low in (0, 1) and high == INF:
        return "+" if low else "*"
    if (low, high) == (0, 1):
        return "?"
    return f"{{{low}}}" if low == high else f"{{{low},}}" if high == INF else f"{{{low},{high}}}"


def _span(low: int, high: float) -> str:
    return f"{{{low}}}" if low == high else f"{{{low}+}}" if high == INF else f"{{{low}-{high}}}"


class Pattern:
    """A node. ``elements`` and ``largest_enum`` feed the interpretability score."""

    grouped = False
    elements = 1
    largest_enum = 0

    def regex(self) -> str:
        raise NotImplementedError

    def anchored(self) -> str:
        return f"^{self.regex()}$"

    def optimized(self) -> Pattern:
        return self

    def bytewise(self) -> bool:
        """Whether a ``.`` occurs, which stands for one byte."""
        return False


@dataclass(frozen=True)
class Literal(Pattern):
    text: str

    def regex(self) -> str:
        return escape(self.text)

    def cost(self) -> float:
        return min(1.0 + grapheme_count(self.text) * 0.1, 5.0)

    def specificity(self) -> float:
        return 1.0

    def pretty(self) -> str:
        return inspect(self.text)


@dataclass(frozen=True)
class CharClass(Pattern):
    kind: str
    low: int = 1
    high: float = 1

    def regex(self) -> str:
        return CLASSES[self.kind][0] + _times(self.low, self.high)

    def cost(self) -> float:
        spread = 0.0 if self.low == self.high else 1.0 if self.high == INF else 0.5 + (self.high - self.low) * 0.1
        return CLASSES[self.kind][1] + spread

    def specificity(self) -> float:
        return CLASSES[self.kind][2] if self.low == self.high else 0.5

    def pretty(self) -> str:
        return f"<{self.kind}{_span(self.low, self.high)}>"

    def bytewise(self) -> bool:
        return self.kind == "any"


@dataclass(frozen=True)
class Enum(Pattern):
    values: tuple[str, ...]

    def __init__(self, values):
        object.__setattr__(self, "values", tuple(sorted(set(values), key=lambda v: v.encode("utf-8", "surrogatepass"))))

    @property
    def grouped(self) -> bool:
        return len(self.values) > 1

    @property
    def largest_enum(self) -> int:
        return len(self.values)

    def _tier(self) -> tuple:
        n = len(self.values)
        return next(t for t in ENUM_TIERS if n <= t[0] and (n or t[0] > 1))

    def regex(self) -> str:
        return escape(self.values[0]) if len(self.values) == 1 else "(" + "|".join(map(escape, self.values)) + ")"

    def cost(self) -> float:
        _, base, each, _ = self._tier()
        return base + len(self.values) * each

    def specificity(self) -> float:
        return self._tier()[3]

    def pretty(self) -> str:
        shown = self.values if len(self.values) <= 5 else (*self.values[:3], f"...({len(self.values)} values)")
        return "{" + "|".join(shown) + "}"


@dataclass(frozen=True)
class Seq(Pattern):
    parts: tuple[Pattern, ...]
    grouped = True

    @property
    def elements(self) -> int:
        return len(self.parts)

    @property
    def largest_enum(self) -> int:
        return max((p.largest_enum for p in self.parts), default=0)

    def regex(self) -> str:
        return "".join(p.regex() for p in self.parts)

    def cost(self) -> float:
        total = 0  # a plain left fold: sum() compensates for rounding and gives other last digits
        for p in self.parts:
            total += p.cost()
        return total

    def specificity(self) -> float:
        total = 0
        for p in self.parts:
            total += p.specificity()
        return total / len(self.parts)

    def pretty(self) -> str:
        return " ".join(p.pretty() for p in self.parts)

    def bytewise(self) -> bool:
        return any(p.bytewise() for p in self.parts)

    def optimized(self) -> Pattern:
        """Neighbouring literals joined, neighbouring classes of one kind added up; a single part stands alone."""
        out: list[Pattern] = []
        for p in self.parts:
            last = out[-1] if out else None
            if isinstance(p, Literal) and isinstance(last, Literal):
                out[-1] = Literal(last.text + p.text)
            elif isinstance(p, CharClass) and isinstance(last, CharClass) and p.kind == last.kind:
                out[-1] = CharClass(p.kind, last.low + p.low, last.high + p.high)
            else:
                out.append(p)
        return out[0] if len(out) == 1 else Seq(tuple(out))


@dataclass(frozen=True)
class Optional(Pattern):
    inner: Pattern

    @property
    def elements(self) -> int:
        return 1 + self.inner.elements

    @property
    def largest_enum(self) -> int:
        return self.inner.largest_enum

    def regex(self) -> str:
        return f"({self.inner.regex()})?" if self.inner.grouped else f"{self.inner.regex()}?"

    def cost(self) -> float:
        return self.inner.cost() + 0.5

    def specificity(self) -> float:
        return self.inner.specificity() * 0.8

    def pretty(self) -> str:
        return f"[{self.inner.pretty()}]?"

    def bytewise(self) -> bool:
        return self.inner.bytewise()


@dataclass(frozen=True)
class Any(Pattern):
    low: int = 1
    high: float = INF

    def regex(self) -> str:
        return "." + _times(self.low, self.high)

    def cost(self) -> float:
        return 10.0

    def specificity(self) -> float:
        return 0.1

    def pretty(self) -> str:
        return f"<any{_span(self.low, self.high)}>"

    def bytewise(self) -> bool:
        return True


def literal(text: str) -> Pattern:
    return Literal(text)


def char_class(kind: str, low: int = 1, high: float = 1) -> Pattern:
    return CharClass(kind, low, high)


def enum(values) -> Pattern:
    return Enum(values)


def seq(parts) -> Pattern:
    parts = tuple(parts)
    return parts[0] if len(parts) == 1 else Seq(parts)


def optional(inner: Pattern) -> Pattern:
    return Optional(inner)


def any_(low: int = 1, high: float = INF) -> Pattern:
    return Any(low, high)


def matches(value: Column, pattern: Pattern) -> Column:
    """Whether a whole value matches, as a codegen-friendly expression.

    ``$`` also matches before one final line feed. A pattern with ``.`` is matched on bytes, seen as Latin-1.
    """
    text = f"(?d)^(?:{pattern.regex()})$"
    if pattern.bytewise():
        return F.decode(F.encode(value, "UTF-8"), "ISO-8859-1").rlike(text.encode().decode("latin-1"))
    return value.rlike(text)


def matches_start(value: Column, pattern: Pattern) -> Column:
    """Whether a value begins with something that matches."""
    text = f"(?d)^(?:{pattern.regex()})"
    if pattern.bytewise():
        return F.decode(F.encode(value, "UTF-8"), "ISO-8859-1").rlike(text.encode().decode("latin-1"))
    return value.rlike(text)


def matches_any(value: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | matches(value, p)
    return found


def first_match(value: Column, patterns) -> Column:
    """The place of the first pattern that matches, from 0; null if none does."""
    chain = None
    for i, p in enumerate(patterns):
        chain = F.when(matches(value, p), i) if chain is None else chain.when(matches(value, p), i)
    return F.lit(None).cast("int") if chain is None else chain


def rows(pattern: Pattern) -> list[dict]:
    """A synthesized pattern, one leaf or a flat sequence of leaves, as rows to be stored."""
    out = []
    for p in pattern.parts if isinstance(pattern, Seq) else (pattern,):
        bounds = (p.low, None if p.high == INF else int(p.high)) if isinstance(p, CharClass | Any) else (None, None)
        values = list(p.values) if isinstance(p, Enum) else [p.text] if isinstance(p, Literal) else None
        out.append({"kind": type(p).__name__.lower(), "class": getattr(p, "kind", None), "min": bounds[0], "max": bounds[1], "values": values})
    return out


def from_rows(stored: list[dict]) -> Pattern:
    build = {"literal": lambda r: Literal(r["values"][0]), "enum": lambda r: Enum(r["values"]), "charclass": lambda r: CharClass(r["class"], r["min"], INF if r["max"] is None else r["max"]), "any": lambda r: Any(r["min"], INF if r["max"] is None else r["max"])}
    return seq(build[r["kind"]](r) for r in stored)
