"""A scanner of C text: the nodes of its statements, calls and assignments, with their bytes, by one walk with a stack.

It is no compiler's parser: types are not resolved, directives are lines that are passed over, and both branches of a
conditional directive are read one after the other. Brackets that nothing opens or closes end with the text.
"""

from __future__ import annotations

import re
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = re.compile(
    rb"""(?P<skip>\s+|//(?:\\\r?\n|[^\n])*|/\*.*?(?:\*/|\Z))|(?P<line>(?<![^\n])[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*)"""
    rb"""|(?P<text>L?"(?:\\.|[^"\\\n])*"?|L?'(?:\\.|[^'\\\n])*'?)|(?P<word>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<number>\d(?:[eEpP][+-]|[\w.])*)"""
    rb"""|(?P<set>(?:<<|>>|[-+*/%&|^])=|=(?!=))|(?P<mark>==|!=|<=|>=|->|\+\+|--|&&|\|\||.)""", re.S)
INCLUDE = re.compile(rb"\s*#\s*include\s*(?P<path>\"[^\"\n]*\"|<[^>\n]*>)")
#: Words of the language that name no function or variable, and those of them that begin a declaration.
TYPES = frozenset(b"auto char const double enum extern float inline int long register restrict short signed static struct typedef union unsigned void volatile _Bool".split())
WORDS = TYPES | frozenset(b"break case continue default do else for goto if return sizeof switch while".split())
#: Statements that hold one: the field of the statement, and whether a condition in round brackets comes first.
HOLDERS = {b"if": ("if_statement", "consequence", True), b"else": ("else_clause", None, False), b"while": ("while_statement", "body", True), b"for": ("for_statement", "body", True), b"do": ("do_statement", "body", False), b"switch": ("switch_statement", "body", True)}
JUMPS = {b"return": "return_statement", b"goto": "goto_statement", b"break": "break_statement", b"continue": "continue_statement"}

NODE = "struct<id:int,parent:int,field:string,type:string,start_byte:int,end_byte:int>"


def scan(code: bytes) -> list[list]:
    """[id, parent, field, type, start_byte, end_byte] of each node, parents before their children; ids count from 0."""
    tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in TOKENS.finditer(code) if m.lastgroup != "skip"]
    nodes: list[list] = [[0, None, None, "translation_unit", 0, len(code)]]
    # what is open: [kind, node, state]; kinds are top, block, holder, label, plain and group (brackets in a plain one)
    stack: list[list] = [["top", 0, None]]
    i, n = 0, len(tokens)

    def node(kind: str, start: int, field: str | None = None) -> int:
        nodes.append([len(nodes), stack[-1][1], field, kind, start, None])
        return len(nodes) - 1

    def close(at: int, end: int) -> None:
        nodes[at][5] = end

    def slot() -> str | None:
        """The field that a statement fills in what holds it."""
        kind, _, state = stack[-1]
        return HOLDERS[state[0]][1] if kind == "holder" else None

    def ended(end: int) -> None:
        """A statement has ended: so do those that held it, unless an else or the while of a do follows."""
        while stack[-1][0] in ("holder", "label"):
            kind, at, state = stack[-1]
            after = tokens[i + 1][1] if i + 1 < n else b""
            if kind == "holder" and (state[0] == b"if" and after == b"else" or state[0] == b"do" and not state[1]):
                state[1] = True
                return
            stack.pop()
            close(at, end)

    def bracket(j: int) -> int:
        """The place of the bracket that closes the one at j, or of the last token."""
        depth = 0
        while j < n:
            depth += (tokens[j][1] in (b"(", b"[")) - (tokens[j][1] in (b")", b"]"))
            if not depth or tokens[j][1] in (b"{", b"}"):
                break
            j += 1
        return min(j, n - 1)

    while i < n:
        kind, word, start, end = tokens[i]
        top = stack[-1]
        if kind == "line":
            if m := INCLUDE.match(code, start, end):
                at = node("preproc_include", start + len(word) - len(word.lstrip()))
                close(at, end)
                nodes.append([len(nodes), at, "path", "string_literal" if m["path"][:1] == b'"' else "system_lib_string", m.start("path"), m.end("path")])
        elif top[0] in ("plain", "group"):
            opened = top[0] == "group" and top[2] is not None
            if word in (b"(", b"["):
                before = tokens[i - 1]
                call = word == b"(" and before[0] == "word" and before[1] not in WORDS
                name = nodes.pop() if call else None  # the name becomes a part of the call
                at = node("call_expression", before[2]) if call else top[1]
                stack.append(["group", at, b")" if word == b"(" else b"]"])
                if call:
                    nodes.append([len(nodes), at, "function", "identifier", *name[4:]])
            elif opened and word == top[2]:
                stack.pop()
                if nodes[top[1]][3] == "call_expression" and nodes[top[1]][5] is None:
                    close(top[1], end)
            elif word == b"{":
                head = next(x for x in reversed(stack) if x[0] == "plain")
                first = head[2]
                body = top is head and (first["call"] or first["word"] in (b"namespace", b"extern", b"class")) and not first["set"]
                if body:  # of a function, or of what holds declarations
                    nodes[head[1]][3] = "function_definition" if first["call"] else "declaration"
                    stack.append(["block", node("compound_statement", start, "body"), None])
                else:
                    stack.append(["group", top[1], b"}"])
            elif word == b";" and not opened or word == b"}" and not any(x[0] == "group" and x[2] == b"}" for x in stack):
                while stack[-1][0] != "plain":
                    if nodes[stack[-1][1]][5] is None and nodes[stack[-1][1]][3] == "call_expression":
                        close(stack[-1][1], start)
                    stack.pop()
                _, at, first = stack.pop()
                last = end if word == b";" else start
                close(at, last)
                if first["set"] and nodes[at][3] == "expression_statement":
                    # the assignment is the statement but for its mark, and holds what the statement held
                    inner = [len(nodes), at, None, "assignment_expression", nodes[at][4], start]
                    for x in nodes[at + 1 :]:
                        x[1] = inner[0] if x[1] == at else x[1]
                    nodes.append(inner)
                ended(last)
                if word == b"}":
                    continue
            elif kind == "word" and word not in WORDS:
                close(node("identifier", start), end)
                if i + 1 < n and tokens[i + 1][1] == b"(" and top[0] == "plain":
                    top[2]["call"] = True
            elif kind == "set" and top[0] == "plain":
                top[2]["set"] = True
        elif word == b"}":
            while stack[-1][0] in ("holder", "label"):
                close(stack.pop()[1], start)
            if stack[-1][0] == "block":
                close(stack.pop()[1], end)
                if stack[-1][0] == "plain":
                    close(stack.pop()[1], end)
                ended(end)
        elif word == b"{":
            stack.append(["block", node("compound_statement", start, slot()), None])
        elif word in HOLDERS:
            if word == b"while" and top[0] == "holder" and top[2] == [b"do", True]:
                j = bracket(i + 1)
                close(node("parenthesized_expression", tokens[i + 1][2], "condition"), tokens[j][3]) if j > i else None
                i = j + (j + 1 < n and tokens[j + 1][1] == b";")
                close(stack.pop()[1], tokens[min(i, n - 1)][3])
                ended(tokens[min(i, n - 1)][3])
            else:
                what, _, condition = HOLDERS[word]
                at = node(what, start, "alternative" if word == b"else" else slot())
                stack.append(["holder", at, [word, False]])
                if condition and i + 1 < n and tokens[i + 1][1] == b"(":
                    j = bracket(i + 1)
                    close(node("parenthesized_expression", tokens[i + 1][2], "condition"), tokens[j][3])
                    stack[-1][1] = len(nodes) - 1
                    for k in range(i + 2, j):  # names and calls in the condition
                        if tokens[k][0] == "word" and tokens[k][1] not in WORDS:
                            if tokens[k + 1][1] == b"(":
                                call = node("call_expression", tokens[k][2])
                                close(call, tokens[bracket(k + 1)][3])
                                nodes.append([len(nodes), call, "function", "identifier", tokens[k][2], tokens[k][3]])
                            else:
                                close(node("identifier", tokens[k][2]), tokens[k][3])
                    stack[-1][1] = at
                    i = j
        elif word in (b"case", b"default") or kind == "word" and word not in WORDS and i + 1 < n and tokens[i + 1][1] == b":" and top[0] != "top":
            stack.append(["label", node("labeled_statement", start, slot()), None])
            while i + 1 < n and tokens[i][1] not in (b":", b";", b"{", b"}"):
                i += 1
        elif word == b";":
            close(node("expression_statement", start, slot()), end)
            ended(end)
        else:
            after = tokens[i + 1] if i + 1 < n else ("", b"", 0, 0)
            declares = word in TYPES or kind == "word" and word not in WORDS and after[0] == "word"
            at = node(JUMPS.get(word, "declaration" if declares else "expression_statement"), start, slot())
            stack.append(["plain", at, {"word": word, "call": False, "set": False}])
            if word not in WORDS:
                continue  # the word is read again, as a part of the statement
        i += 1
    for _, at, _ in reversed(stack):
        if nodes[at][5] is None:
            close(at, len(code))
    for x in nodes:
        x[5] = x[4] if x[5] is None else x[5]
    return nodes


def bodies(code: str | None, loops: bool = False) -> list[tuple[int, int]]:
    """Byte spans of what conditions hold without brackets of its own, to be given to add_brackets().

    That is the statement after a condition, unless it is a block, and the one after an else, unless that is a block or
    another condition; with loops, also the bodies of while and for. A span includes the blank after it, if there is one.
    """
    if code is None:
        return []
    raw = code.encode()
    nodes = scan(raw)
    out = []
    for _, parent, field, kind, start, end in nodes:
        held = nodes[parent][3] if parent is not None else ""
        single = kind != "compound_statement"
        if single and (field == "consequence" or held == "else_clause" and kind != "if_statement" or loops and field == "body" and held in ("while_statement", "for_statement")):
            out.append((start, end if raw[end : end + 1].isspace() else end - 1))
    return sorted(set(out))


def syntax_nodes(df: DataFrame, code: str, *keys: str) -> DataFrame:
    """(keys, id, parent, field, type, start_byte, end_byte): a row for each node of each row's code; null code has none."""
    kind = pa.list_(pa.struct([("id", pa.int32()), ("parent", pa.int32()), ("field", pa.string()), ("type", pa.string()), ("start_byte", pa.int32()), ("end_byte", pa.int32())]))
    names = [f.name for f in kind.value_type]

    @F.arrow_udf(f"array<{NODE}>")
    def nodes(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [dict(zip(names, x, strict=True)) for x in scan(t.encode())] for t in texts.to_pylist()], kind)

    return df.select(*keys, F.explode(nodes(F.col(code))).alias("_n")).select(*keys, "_n.*")


def condition_bodies(code) -> F.Column:
    """array<struct<start, end>> of bodies() for a column of code."""
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [{"start": a, "end": b} for a, b in bodies(t)] for t in texts.to_pylist()], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return spans(code)
