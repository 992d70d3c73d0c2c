"""Graphs in the DOT language as rows: chains of edges, subgraphs, attributes, statements over several lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|^\#[^\n]*)|(?P<text>"(?:\\.|[^"\\])*")|(?P<edge>->|--)|(?P<mark>[{}\[\];,=:+])'
    r"|(?P<id>-?(?:\.\d+|\d+(?:\.\d*)?)(?![\w.])|[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)|(?P<other>.)", re.S | re.M)
#: What may stand behind a name, but for blanks and comments; a quote with something else behind it belongs to the name.
_BLANK = r"(?:\s|//[^\n]*|/\*.*?\*/)"
FOLLOWS = re.compile(rf'{_BLANK}*(?:[\]\[{{}},;=:+]|->|--|\Z)|[^\S\n]*\n|{_BLANK}+(?:[\w.]+|"(?:\\.|[^"\\])*")\s*(?:[=\[;{{}}\n\]]|->|--|\Z)', re.S)


class DotError(ValueError):
    """Text that is no graph: what was met, and on which line, from 1."""


def tokens(text: str, repair: bool) -> Iterator[tuple[str, str, int]]:
    """(kind, value, place). With repair, a quote inside a quoted name that nobody escaped is taken as a part of it: one that
    nothing follows that may follow a name."""
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "other" and m[0] == "<":  # a name in angle brackets, which may nest
            depth, end = 1, at + 1
            while end < len(text) and depth:
                depth += (text[end] == "<") - (text[end] == ">")
                end += 1
            if depth:
                raise DotError(f"'<' on line {text.count(chr(10), 0, at) + 1} is never closed")
            yield "text", text[at + 1 : end - 1], at
        elif kind == "text":
            while repair and not FOLLOWS.match(text, end):
                more = re.compile(r'(?:\\.|[^"\\])*"', re.S).match(text, end)
                if more is None:
                    break
                end = more.end()
            # backslashes escape quotes and line ends, \n stands for a line feed; a repaired name keeps its quotes
            yield "text", re.sub(r"\\(\n|.)", lambda x: {"\n": "", "n": "\n", '"': '"', "\\": "\\"}.get(x[1], x[0]), text[at + 1 : end - 1], flags=re.S), at
        elif kind == "other":
            raise DotError(f"{m[0]!r} on line {text.count(chr(10), 0, at) + 1} is not understood")
        elif kind != "skip":
            yield kind, m[0], at
        at = end


def parse(text: str, repair: bool = True) -> tuple[dict[str, dict[str, str]], list[tuple[str, str, dict[str, str]]]]:
    """(nodes with their attributes, edges with theirs, in the order of the text) of a graph.

    An edge of a chain, or between subgraphs, is one for each pair of ends; it has the attributes that `edge` statements
    of its subgraph gave before, and its own. Ports are left out. Text before the graph's bracket is its name.
    """
    found = list(tokens(text, repair))
    nodes: dict[str, dict[str, str]] = {}
    edges: list[tuple[str, str, dict[str, str]]] = []
    at = 0

    def bad() -> DotError:
        if at < len(found):
            return DotError(f"{found[at][1]!r} on line {text.count(chr(10), 0, found[at][2]) + 1} is not understood")
        return DotError("the text ends within a graph")

    def peek(*values: str) -> bool:
        return at < len(found) and found[at][0] in ("mark", "edge") and found[at][1] in values

    def name() -> str:
        nonlocal at
        if at >= len(found) or found[at][0] not in ("text", "id"):
            raise bad()
        value, at = found[at][1], at + 1
        while peek("+") and at + 1 < len(found) and found[at + 1][0] == "text":
            value, at = value + found[at + 1][1], at + 2
        return value

    def word() -> str:
        """The next token in small letters, if it is a plain word."""
        return found[at][1].lower() if at < len(found) and found[at][0] == "id" else ""

    def attributes() -> dict[str, str]:
        nonlocal at
        out: dict[str, str] = {}
        while peek("["):
            at += 1
            while not peek("]"):
                key = name()
                out[key] = "true"
                if peek("="):
                    at += 1
                    out[key] = name()
                at += peek(",", ";")
            at += 1
        return out

    while at < len(found) and not peek("{"):
        at += 1
    if not found:
        return nodes, edges
    if at == len(found):
        raise bad()
    # open subgraphs: defaults of nodes and edges, names met, and the chain that each waits in
    stack: list[list] = [[{}, {}, {}, None]]
    at += 1

    def finish(chain: list[dict[str, None]], own: dict[str, str]) -> None:
        top = stack[-1]
        if len(chain) == 1 and own is not None:
            for n in chain[0]:
                nodes[n] |= own
        for a, b in zip(chain, chain[1:], strict=False):
            edges.extend((x, y, top[1] | own) for x in a for y in b)

    chain: list[dict[str, None]] = []
    while stack:
        if peek("}"):
            at += 1
            _, _, names, waiting = stack.pop()
            if not stack:
                break
            stack[-1][2].update(names)
            chain = [*waiting, names]
        elif peek("{") or word() == "subgraph":
            if word() == "subgraph":
                at += 1
                if not peek("{"):
                    name()
            if not peek("{"):
                raise bad()
            at += 1
            stack.append([dict(stack[-1][0]), dict(stack[-1][1]), {}, chain])
            chain = []
            continue
        elif peek(";"):
            at += 1
            continue
        elif word() in ("graph", "node", "edge") and at + 1 < len(found) and found[at + 1][1] == "[" and not chain:
            which, at = word(), at + 1
            given = attributes()
            if which != "graph":
                stack[-1][which == "edge"].update(given)
            continue
        else:
            n = name()
            if peek("=") and not chain:
                at += 1
                name()
                continue
            while peek(":"):
                at += 1
                name()
            nodes.setdefault(n, dict(stack[-1][0]))
            stack[-1][2][n] = None
            chain = [*chain, {n: None}]
        if peek("->", "--"):
            at += 1
            if at == len(found) or peek("}", ";"):
                raise bad()
            continue
        finish(chain, attributes())
        chain = []
    return nodes, edges


def dot_rows(rows: DataFrame, *keys: str, text: str = "text", repair: bool = True) -> DataFrame:
    """(keys, kind, pos, src, dst, attributes, problem) of graphs: a row for each edge and node, counted in the text's order.

    kind is "edge", "node" (its name in src) or "error": a text that is no graph gives one row that says why, so that
    others are read. A null text gives no rows. With repair, quotes that nobody escaped are read as parts of names.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("pos", pa.int32()), ("src", pa.string()), ("dst", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("problem", pa.string())]))

    def one(t: str | None) -> list[dict]:
        if t is None:
            return []
        try:
            nodes, edges = parse(t, repair)
        except DotError as e:
            return [{"kind": "error", "pos": 0, "problem": str(e)}]
        return [{"kind": "edge", "pos": i, "src": a, "dst": b, "attributes": list(x.items())} for i, (a, b, x) in enumerate(edges)] + [{"kind": "node", "pos": i, "src": n, "attributes": list(x.items())} for i, (n, x) in enumerate(nodes.items())]

    @F.arrow_udf("array<struct<kind:string,pos:int,src:string,dst:string,attributes:map<string,string>,problem:string>>")
    def parsed(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], kind)

    return rows.select(*keys, F.explode(parsed(F.col(text))).alias("_r")).select(*keys, "_r.*")
