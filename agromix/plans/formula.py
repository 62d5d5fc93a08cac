"""The model language: tokens to a tree of terms. Nothing is ever evaluated as code."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

__all__ = ["Call", "Interaction", "Name", "Number", "Formula", "parse_formula", "parse_terms"]

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|([A-Za-z_.][\w.]*)|(.))")


@dataclass(frozen=True)
class Name:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Number:
    value: float

    def __str__(self) -> str:
        return f"{self.value:g}"


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    named: dict = field(default_factory=dict, hash=False)

    def __str__(self) -> str:
        return f"{self.name}({', '.join([*map(str, self.args), *(f'{k}={v}' for k, v in self.named.items())])})"


@dataclass(frozen=True)
class Interaction:
    parts: tuple

    def __str__(self) -> str:
        return ":".join(map(str, self.parts))


@dataclass(frozen=True)
class Formula:
    responses: tuple[str, ...]
    terms: tuple
    intercept: bool


class _Parser:
    def __init__(self, text: str):
        self.tokens = []
        for number, name, other in TOKEN.findall(text.strip()):
            self.tokens.append(("number", number) if number else ("name", name) if name else ("sign", other))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, sign: str | None = None) -> str:
        kind, value = self.peek()
        if kind == "end" or (sign is not None and value != sign):
            raise ValueError(f"expected {sign or 'more'} but found {value or 'the end'}")
        self.at += 1
        return value

    def terms(self) -> tuple[list, bool]:
        out, intercept, plus = [], True, True
        while True:
            if self.peek() == ("number", "0") or (not plus and self.peek() == ("number", "1")):
                self.take()
                intercept = False
            elif self.peek() == ("number", "1"):
                self.take()
            else:
                out += self.term()
            if self.peek()[1] in ("+", "-") and self.peek()[0] == "sign":
                plus = self.take() == "+"
                continue
            return out, intercept

    def term(self) -> list:
        """A product: a:b is one interaction, a*b the main effects and all interactions of them."""
        found = [[self.factor()]]
        while self.peek()[1] in (":", "*"):
            sign, other = self.take(), self.factor()
            found = [[*x, other] for x in found] if sign == ":" else [*found, [other], *([*x, other] for x in found)]
        unique: list = []
        for parts in sorted(found, key=len):
            term = parts[0] if len(parts) == 1 else Interaction(tuple(parts))
            if term not in unique:
                unique.append(term)
        return unique

    def factor(self):
        kind, value = self.peek()
        if kind == "number":
            return Number(float(self.take()))
        if kind == "sign" and value == "-":
            self.take()
            return Number(-float(self.take()))
        if kind != "name":
            raise ValueError(f"expected a term but found {value or 'the end'}")
        self.take()
        if self.peek()[1] != "(":
            return Name(value)
        self.take("(")
        args, named = [], {}
        while self.peek()[1] != ")":
            if self.peek()[0] == "name" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "=":
                key = self.take()
                self.take("=")
                named[key] = self.factor()
            else:
                one = self.term()
                args.append(one[0] if len(one) == 1 else Interaction(tuple(one)))
            if self.peek()[1] == ",":
                self.take()
        self.take(")")
        return Call(value, tuple(args), named)


def parse_terms(text: str) -> tuple[tuple, bool]:
    """Terms of a right-hand side ("~ a + b:c") and whether it has an intercept."""
    parser = _Parser(text.strip().removeprefix("~"))
    terms, intercept = parser.terms() if parser.tokens else ([], True)
    if parser.peek()[0] != "end":
        raise ValueError(f"cannot read {parser.peek()[1]!r} in {text!r}")
    out: list = []
    for t in terms:
        if t not in out:
            out.append(t)
    return tuple(out), intercept


def parse_formula(text: str) -> Formula:
    """ "y ~ a + b" or "cbind(y1, y2) ~ a"."""
    left, sign, right = text.partition("~")
    if not sign:
        raise ValueError(f"no ~ in {text!r}")
    (response, *rest), _ = parse_terms(left)
    if rest or not isinstance(response, (Name, Call)) or (isinstance(response, Call) and response.name != "cbind"):
        raise ValueError(f"the response of {text!r} is a column or cbind(...)")
    responses = (response.name,) if isinstance(response, Name) else tuple(str(a) for a in response.args)
    terms, intercept = parse_terms(right)
    return Formula(responses, terms, intercept)
