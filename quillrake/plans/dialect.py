"""The SQL dialect: vector operators and literals, hints, graph functions in FROM, and names that Spark spells otherwise.

A statement becomes tokens (strings, quoted names and comments are never looked into), the tokens are rewritten, and
Spark parses the rest.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

#: Operator to function; fixed values.
OPERATORS = {"<->": "dist_l2", "<=>": "dist_cosine", "<#>": "dist_ip", "<+>": "dist_l1", "<~>": "dist_hamming", "<%>": "dist_jaccard"}
HINTS = {"ef_search", "probes", "use_index", "limit_pushdown", "skip_row_groups", "cache_manifests", "fast_path"}
RENAMED = {"make_array": "array", "unnest": "explode", "approx_percentile_cont": "percentile_approx", "array_length": "size"}
TYPES = {"uint64": "BIGINT", "int64": "BIGINT", "uint32": "BIGINT", "int32": "INT", "float64": "DOUBLE", "float32": "FLOAT", "utf8": "STRING"}

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<hint>/\*\+.*?\*/)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^'\\]|\\.|'')*')|(?P<quoted>`(?:[^`]|``)*`|"(?:[^"\\]|\\.)*")"""
    r"""|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?[A-Za-z]*|\.\d+(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d]\w*)|(?P<op><->|<=>|<\#>|<\+>|<~>|<%>|::|<=|>=|<>|!=|==|\|\||->|.)""",
    re.S | re.X,
)


class SqlError(ValueError):
    pass


@dataclass
class Token:
    kind: str
    text: str

    def __eq__(self, other: object) -> bool:
        return isinstance(other, str) and self.kind in ("word", "op") and self.text.upper() == other.upper()

    __hash__ = None  # type: ignore[assignment]


@dataclass
class Statement:
    tokens: list[Token]
    hints: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        return "".join(t.text for t in self.tokens).strip()

    def words(self) -> list[str]:
        return [t.text.upper() for t in self.tokens if t.kind not in ("space", "comment", "hint")]

    def names(self) -> set[str]:
        return {unquoted(t) for t in self.tokens if t.kind in ("word", "quoted")}


def unquoted(t: Token) -> str:
    return t.text[1:-1].replace("``", "`") if t.kind == "quoted" else t.text


def string_value(t: Token) -> str:
    return re.sub(r"\\(.)", r"\1", t.text[1:-1].replace("''", "'"))


def tokenize(sql: str) -> list[Token]:
    if "\0" in sql:
        raise SqlError("a statement holds a NUL character")
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m.lastgroup == "op" and m[0] in "'`\"":
            raise SqlError("a string or quoted name does not end")
        out.append(Token(m.lastgroup, m[0]))
        at = m.end()
    return out


def statement(sql: str) -> Statement:
    """One statement without comments and final semicolon; hints of this engine are taken out, Spark's stay."""
    tokens, hints = [], {}
    for t in tokenize(sql):
        if t.kind == "comment":
            t = Token("space", " ")
        if t.kind == "hint":
            own = {k.lower(): v.strip() for k, v in re.findall(r"(\w+)\s*(?:\(([^)]*)\))?", t.text[3:-2]) if k.lower() in HINTS}
            if own:
                hints |= own
                t = Token("space", " ")
        tokens.append(t)
    while tokens and (tokens[-1].kind == "space" or tokens[-1] == ";"):
        tokens.pop()
    if any(t == ";" for t in tokens):
        raise SqlError("one statement at a time")
    return Statement(tokens, hints)


def solid(tokens: list[Token]) -> list[Token]:
    return [t for t in tokens if t.kind != "space"]


_CLOSERS, _OPENERS = {")": "(", "]": "["}, {"(": ")", "[": "]"}
_KEYWORDS = {"SELECT", "WHERE", "AND", "OR", "NOT", "BY", "ON", "WHEN", "THEN", "ELSE", "CASE", "HAVING", "FROM", "AS", "IN", "BETWEEN", "IS", "LIKE", "LIMIT", "DISTINCT", "ASC", "DESC", "END"}


def _operand_start(t: list[Token], end: int) -> int:
    """The first token of the operand that ends at ``end``."""
    i = end
    while True:
        if t[i].text in _CLOSERS and t[i].kind == "op":
            depth, close, opened = 0, t[i].text, _CLOSERS[t[i].text]
            while True:
                depth += (t[i].text == close) - (t[i].text == opened) if t[i].kind == "op" else 0
                if not depth:
                    break
                i -= 1
            if i and (t[i - 1].kind in ("quoted",) or t[i - 1].kind == "word" and t[i - 1].text.upper() not in _KEYWORDS):
                i -= 1
        if i >= 2 and t[i - 1] == ".":
            i -= 2
            continue
        if i >= 2 and t[i - 1] == "::":
            i -= 2
            continue
        return i


def _operand_end(t: list[Token], start: int) -> int:
    """The token after the operand that begins at ``start``."""
    i = start
    if t[i] == "-":
        i += 1
    while True:
        if t[i].text in _OPENERS and t[i].kind == "op":
            depth, opened, close = 0, t[i].text, _OPENERS[t[i].text]
            while True:
                depth += (t[i].text == opened) - (t[i].text == close) if t[i].kind == "op" else 0
                if not depth:
                    break
                i += 1
        i += 1
        if i < len(t) and (t[i] == "." or t[i] == "::"):
            i += 1
            continue
        if i < len(t) and t[i].kind == "op" and t[i].text in _OPENERS and t[i - 1].kind in ("word", "quoted"):
            continue
        return i


def dense_literal(text: str) -> str:
    """``[1, 2]`` as an array of doubles."""
    body = text.strip()[1:-1].strip()
    return f"cast(array({', '.join(repr(float(x)) + 'D' for x in body.split(','))}) AS ARRAY<DOUBLE>)" if body else "cast(array() AS ARRAY<DOUBLE>)"


def sparse_literal(text: str, dim: int | None = None) -> str:
    """``{1:0.5, 3:2}`` or ``{1:0.5}/8`` as a sparse vector."""
    m = re.fullmatch(r"\s*\{(.*)\}\s*(?:/\s*(\d+))?\s*", text, re.S)
    if not m:
        raise SqlError(f"not a sparse vector: {text!r}")
    pairs = sorted((int(k), float(v)) for k, v in (p.split(":") for p in m[1].split(",") if p.strip()))
    size = int(m[2]) if m[2] else dim if dim is not None else (pairs[-1][0] + 1 if pairs else 0)
    return f"named_struct('indices', array({', '.join(str(k) for k, _ in pairs)}), 'values', array({', '.join(repr(v) + 'D' for _, v in pairs)}), 'dim', {size})"


def bit_literal(text: str) -> str:
    """``B'1010'``: one number for each bit."""
    if not re.fullmatch("[01]*", text):
        raise SqlError(f"not a bit string: {text!r}")
    return f"cast(array({', '.join(f'{b}D' for b in text)}) AS ARRAY<DOUBLE>)"


def _is_vector_text(t: Token) -> bool:
    return t.kind == "string" and bool(re.fullmatch(r"\s*\[[-+\d.eE,\s]*\]\s*", t.text[1:-1]))


def _casts(t: list[Token]) -> tuple[list[Token], set[int]]:
    """Without ``::vector(n)`` casts; the identities of tokens that were cast to vectors."""
    out, marked, i = [], set(), 0
    while i < len(t):
        if t[i] == "::" and i + 1 < len(t) and t[i + 1].text.lower() in ("vector", "halfvec", "bit", "sparsevec"):
            kind = t[i + 1].text.lower()
            i += 2
            if i < len(t) and t[i] == "(":
                while t[i] != ")":
                    i += 1
                i += 1
            if kind == "sparsevec" and out[-1].kind == "string":
                out[-1] = Token("vector", sparse_literal(string_value(out[-1])))
            elif kind == "bit" and out[-1].kind == "string":
                out[-1] = Token("vector", bit_literal(string_value(out[-1])))
            elif out[-1].kind == "string":
                out[-1] = Token("vector", dense_literal(string_value(out[-1])))
            marked.add(id(out[-1]))
            continue
        if t[i].kind == "word" and t[i].text.upper() == "B" and i + 1 < len(t) and t[i + 1].kind == "string" and re.fullmatch("'[01]+'", t[i + 1].text):
            out.append(Token("vector", bit_literal(t[i + 1].text[1:-1])))
            marked.add(id(out[-1]))
            i += 2
            continue
        out.append(t[i])
        i += 1
    return out, marked


def rewrite_vectors(tokens: list[Token], vector_columns: Iterable[str] = ()) -> list[Token]:
    """Vector operators as function calls. ``<=>`` stays null-safe equality unless a side is known to be a vector."""
    known = {c.lower() for c in vector_columns}
    t, marked = _casts(solid(tokens))
    i = 0
    while i < len(t):
        if t[i].kind != "op" or t[i].text not in OPERATORS:
            i += 1
            continue
        if not 0 < i < len(t) - 1:
            raise SqlError(f"{t[i].text} needs two sides")
        a, b = _operand_start(t, i - 1), _operand_end(t, i + 1)
        left, right = t[a:i], t[i + 1 : b]
        vector = any(_is_vector_text(x) or id(x) in marked or x.kind == "vector" or (x.kind in ("word", "quoted") and unquoted(x).lower() in known) for x in left + right)
        if t[i].text == "<=>" and not vector:
            i += 1
            continue
        sides = [[Token("vector", dense_literal(string_value(s[0])))] if len(s) == 1 and _is_vector_text(s[0]) else s for s in (left, right)]
        call = Token("vector", f"{OPERATORS[t[i].text]}({joined(rewrite_vectors(sides[0], known))}, {joined(rewrite_vectors(sides[1], known))})")
        t[a:b] = [call]
        i = a + 1
    return t


def joined(tokens: list[Token]) -> str:
    out = ""
    for t in tokens:
        tight = not out or t.text in (".", ",", ")", "]") or out.endswith((".", "(", "[")) or (t.text in "([" and out[-1].isalnum() and t.text == "[")
        out += t.text if tight or (t.text == "(" and out and re.search(r"[\w`]$", out)) else f" {t.text}"
    return out


def rewrite_names(t: list[Token]) -> list[Token]:
    """Functions that Spark spells otherwise, ARRAY[...], arrow_cast and EXTRACT(EPOCH FROM ...)."""
    out: list[Token] = []
    i = 0
    while i < len(t):
        here = t[i]
        call = here.kind == "word" and i + 1 < len(t) and t[i + 1] == "("
        if here == "ARRAY" and i + 1 < len(t) and t[i + 1] == "[":
            end = _operand_end(t, i + 1)
            out += [Token("word", "array"), Token("op", "("), *rewrite_names(t[i + 2 : end - 1]), Token("op", ")")]
            i = end
        elif call and here.text.lower() == "arrow_cast":
            end = _operand_end(t, i + 1)
            inner = t[i + 2 : end - 1]
            kind = TYPES.get(string_value(inner[-1]).lower(), string_value(inner[-1]))
            out += [Token("word", "cast"), Token("op", "("), *rewrite_names(inner[:-2]), Token("word", "AS"), Token("word", kind), Token("op", ")")]
            i = end
        elif call and here == "EXTRACT" and i + 3 < len(t) and t[i + 2] == "EPOCH":
            end = _operand_end(t, i + 1)
            inner = rewrite_names(t[i + 4 : end - 1])
            flat = inner[1:-1] if inner and inner[0] == "(" else inner
            minus = [k for k, x in enumerate(flat) if x == "-"]
            if minus:
                a, b = flat[: minus[0]], flat[minus[0] + 1 :]
                out += [Token("word", "timestampdiff"), Token("op", "("), Token("word", "SECOND"), Token("op", ","), *b, Token("op", ","), *a, Token("op", ")")]
            else:
                out += [Token("word", "unix_timestamp"), Token("op", "("), *inner, Token("op", ")")]
            i = end
        elif call and here.text.lower() in RENAMED:
            out.append(Token("word", RENAMED[here.text.lower()]))
            i += 1
        elif _is_vector_text(here):
            out.append(here)
            i += 1
        else:
            out.append(here)
            i += 1
    return out


Macros = dict[str, tuple[list[tuple[str, str, str | None]], str]]


def expand(t: list[Token], macros: Macros) -> list[Token]:
    """Calls of SQL functions replaced by their bodies, arguments cast to the declared types."""
    out: list[Token] = []
    i = 0
    while i < len(t):
        name = t[i].text.lower()
        if t[i].kind != "word" or name not in macros or not (i + 1 < len(t) and t[i + 1] == "("):
            out += expand(solid(tokenize(t[i].text)), macros) if t[i].kind == "vector" and t[i].text.split("(")[0] in macros else [t[i]]
            i += 1
            continue
        end = _operand_end(t, i + 1)
        params, body = macros[name]
        given = split(t[i + 2 : end - 1])
        if not len([p for p in params if p[2] is None]) <= len(given) <= len(params):
            raise SqlError(f"{name} takes {len(params)} arguments")
        values = {}
        for k, (param, kind, default) in enumerate(params):
            arg = given[k] if k < len(given) else solid(tokenize(default or "NULL"))
            if len(arg) == 1 and _is_vector_text(arg[0]) and kind == "ARRAY<DOUBLE>":
                arg = solid(tokenize(dense_literal(string_value(arg[0]))))
            values[param] = [Token("word", "cast"), Token("op", "("), Token("op", "("), *expand(arg, macros), Token("op", ")"), Token("word", "AS"), Token("vector", kind), Token("op", ")")]
        out.append(Token("op", "("))
        for x in solid(tokenize(body)):
            out += values[x.text] if x.kind == "word" and x.text in values else [x]
        out.append(Token("op", ")"))
        i = end
    return out


def rewrite_table_functions(t: list[Token], names: Iterable[str], make: Callable[[str, list], str]) -> list[Token]:
    """``FROM f('t', 1, ...)`` and ``JOIN f(...)`` for the given functions: ``make`` returns the name of a view."""
    wanted = {n.lower() for n in names}
    out: list[Token] = []
    i = 0
    while i < len(t):
        if t[i].kind == "word" and t[i].text.lower() in wanted and i + 1 < len(t) and t[i + 1] == "(" and out and (out[-1] == "FROM" or out[-1] == "JOIN" or out[-1] == ","):
            end = _operand_end(t, i + 1)
            out.append(Token("word", make(t[i].text.lower(), arguments(t[i + 2 : end - 1]))))
            i = end
        else:
            out.append(t[i])
            i += 1
    return out


def split(t: list[Token], by: str = ",") -> list[list[Token]]:
    """Parts between commas outside of brackets."""
    out, depth = [[]], 0
    for x in t:
        depth += (x.kind == "op") * ((x.text in _OPENERS) - (x.text in _CLOSERS))
        if x == by and depth == 0:
            out.append([])
        else:
            out[-1].append(x)
    return out if out != [[]] else []


def arguments(t: list[Token]) -> list:
    """Literal arguments as Python values."""
    out = []
    for part in split(t):
        sign, body = (-1, part[1:]) if part and part[0] == "-" else (1, part)
        if len(body) != 1:
            raise SqlError(f"a literal is expected: {joined(part)}")
        x = body[0]
        if x.kind == "string":
            out.append(string_value(x))
        elif x.kind == "number":
            out.append(sign * (float(x.text) if re.search(r"[.eE]", x.text) else int(x.text)))
        else:
            out.append({"TRUE": True, "FALSE": False, "NULL": None}.get(x.text.upper(), unquoted(x)))
    return out


def rewrite(sql: str, vector_columns: Iterable[str] = (), table_functions: Iterable[str] = (), make: Callable[[str, list], str] | None = None) -> tuple[str, dict[str, str]]:
    """(statement for Spark, hints)."""
    s = statement(sql)
    t = rewrite_vectors(s.tokens, vector_columns)
    t = rewrite_names(t)
    if make is not None:
        t = rewrite_table_functions(t, table_functions, make)
    return joined(t), s.hints


