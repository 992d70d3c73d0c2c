"""Normalisation of source text. Each function takes and gives a Column; nulls stay null."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import scan

#: A string or character literal, or a comment. The same pattern works in Java and RE2.
LITERAL = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""
COMMENT = r"/\*.*?\*/|//[^\r\n]*"
#: The looser literals of the compatible form: up to the next quote, escapes not minded.
LOOSE = r"""".*?"|'.*?'"""

# Macro tokens and rewritten declarations that must equal those of the study's preprocessing.
MACROS = (
    "R_API", "INLINE", "TRIO_PRIVATE_STRING", "GF_EXPORT", "LOCAL", "IN", "OUT", "_U_", "EFIAPI",
    "UNUSED_PARAM", "__declspec(dllexport) mrb_value", 'extern "C"', "__rte_always_inline", "__init", "__user", "UNUSED", "H5FL_EXTERN(H5F_super_t);",
)
REWRITES = (("METHODDEF(void)", "void"), ("METHODDEF(JDIMENSION)", "int"))


def remove_comments(code: Column, compat: bool = False) -> Column:
    """code without comments; text that looks like one inside a literal stays. compat takes literals up to the next quote."""
    literal = LOOSE if compat else LITERAL
    return F.regexp_replace(code, f"(?ms)({literal})|(?:{COMMENT})", "$1")


def code_tokens(code: Column) -> Column:
    """The parts of code outside comments, in order: literals, and runs up to the next slash or quote."""
    found = F.regexp_extract_all(code, F.lit(f"(?ms)(?:{COMMENT})|({LITERAL}|.[^/'\"]*)"), F.lit(1))
    return F.filter(found, lambda x: x != "")


def code_only(code: Column) -> Column:
    """code put together from its tokens outside comments; a literal that never closes counts as plain text."""
    return F.array_join(code_tokens(code), "")


def comments(code: Column) -> Column:
    """The distinct comments of code, sorted."""
    found = F.regexp_extract_all(code, F.lit(f"(?ms)((?:{LITERAL})|(?:{COMMENT}))"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.startswith("/"))))


def remove_linebreaks(code: Column) -> Column:
    return F.regexp_replace(code, r"\n", "")


def remove_spaces(code: Column) -> Column:
    return F.regexp_replace(code, r"[ \t\n\r\f\x0b]+", "")


def remove_empty_lines(code: Column) -> Column:
    """code without lines that hold only white space; a last line without line feed stays."""
    return F.regexp_replace(code, r"(?m)^[ \t\n\r\f\x0b]*\n", "")


def remove_param_linebreaks(code: Column) -> Column:
    """A comma and the white space after it become a comma and a blank."""
    return F.regexp_replace(code, r",[ \t\n\r\f\x0b]*", ", ")


def normalize(code: Column, del_comments: bool = True) -> Column:
    """code without comments (unless kept), line feeds and white space."""
    return remove_spaces(remove_linebreaks(remove_comments(code) if del_comments else code))


def exact_match(a: Column, b: Column) -> Column:
    """Whether two texts are equal, white space apart. Null if either is null."""
    return (a == b) | (normalize(a, False) == normalize(b, False))


def splice_lines(code: Column) -> Column:
    """Lines that end in a backslash joined to the next by a blank; nothing takes their place, so later lines move up."""
    return F.regexp_replace(code, r"\\\n[ \t]*", " ")


def del_macros(code: Column, compat: bool = False) -> Column:
    """code with spliced lines, no preprocessor lines but includes, and no macro tokens.

    Macro tokens go as whole words; compat takes them anywhere, inside identifiers too.
    """
    out = F.regexp_replace(splice_lines(code), r"(?m)^[ \t]*#(?!include).*$" if compat else r"(?m)^[ \t]*#(?![ \t]*include\b).*$", "")
    for m in sorted(MACROS, key=len, reverse=True):
        if compat:
            out = F.replace(out, F.lit(m), F.lit(""))
        else:
            quoted = "".join("\\" + ch if not (ch.isalnum() or ch in "_ ") else ch for ch in m)
            out = F.regexp_replace(out, rf"(?<!\w){quoted}(?!\w)", "")
    for old, new in REWRITES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def calls(code: Column) -> Column:
    """Names that look like calls in code without comments and literals, in order. A stand-in for a parser's calls."""
    bare = F.regexp_replace(code, f"(?ms)(?:{LITERAL})|(?:{COMMENT})", " ")
    found = F.regexp_extract_all(bare, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))
    return F.filter(found, lambda x: ~x.isin("if", "for", "while", "switch", "return", "sizeof"))


def jumps(code: Column, word: str = "return") -> Column:
    """The statements of one kind of jump (return, goto, break or continue) in code without comments, in order."""
    return F.regexp_extract_all(remove_comments(code), F.lit(rf"\b({word}\b[^;]*);"), F.lit(1))


def includes(code: Column) -> Column:
    """What a file includes, in order."""
    return F.regexp_extract_all(code, F.lit(r"(?m)^[ \t]*#[ \t]*include[ \t]*([<\"][^>\"\n]*[>\"])"), F.lit(1))


def clean_text(text: Column) -> Column:
    """text through UTF-8 and back."""
    return F.decode(F.encode(text, "UTF-8"), "UTF-8")


def line_offset(text: Column, line: Column) -> Column:
    """The offset at which line number `line` (from 1) is cut off: the length of all lines before it, joined."""
    return F.length(F.array_join(F.slice(F.split(text, "\n", -1), F.lit(1), F.greatest(line - 1, F.lit(0))), "\n"))


def offset_line(text: Column, offset: Column) -> Column:
    """The number of the line that holds an offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def repo_host(url: Column) -> Column:
    """The kind of repository host in a commit address."""
    return F.when(url.contains("ghostscript"), "ghostscript").when(url.contains("gitlab"), "gitlab").otherwise("github")


def commit_id(url: Column) -> Column:
    """The commit in an address: after the last = on ghostscript, else after /commit/, up to a fragment."""
    plain = F.regexp_replace(F.regexp_extract(url, r"/commit/(.*)$", 1), r"#diff.*$", "")
    return F.when(repo_host(url) == "ghostscript", F.element_at(F.split(url, "="), -1)).otherwise(plain)


def repo_name(url: Column) -> Column:
    """owner@@name of a commit address."""
    host = repo_host(url)
    path = F.regexp_replace(url, r"^https://(?:github|gitlab)\.com/", "")
    path = F.regexp_replace(path, r"(?:/-)?/commit/.*$", "")
    return F.when(host == "ghostscript", "ghostscript@@ghostscript").otherwise(F.replace(path, F.lit("/"), F.lit("@@")))


def answer_items(answer: Column) -> Column:
    """A comma-separated answer as trimmed items, in order."""
    return F.transform(F.split(answer, ","), lambda x: F.trim(x))


#: How statements go on: (line starts that stand alone, starts of lines that continue the one before).
CONTINUED = {"c": ("#", ("?", "||", "&&")), "java": ("@", ("?", "||", "&&", "."))}


#: A statement by the classes of its lines (see _line_class): a line that goes on takes all up to one that ends, blank ones
#: too; lines that continue follow. A line that stands alone (A) ends what goes on; it and other blank lines (B) are by themselves.
STATEMENT = "[PW][PWB]*[EX]?[WX]*|[EX][WX]*|[AB]"
#: White space as str.strip() takes it off, for Java and RE2.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
#: Literals and comments for long texts: as LITERAL and COMMENT, but Java matches them without recursion.
_TOKEN = r"""(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|/\*.*?\*/|//[^\r\n]*+|.[^/'"]*+)"""
#: Control characters that stand for a comment's ends and line feeds, and how the same characters in code are written meanwhile.
_ENDS, _FEED, _ESCAPES = "\x02", "\x03", (("\x04", "\x04d"), ("\x02", "\x04b"), ("\x03", "\x04c"))


def statement_lines(code: str | None, language: str = "c") -> str | None:
    """What joined_code() gives for one text, in Python."""
    import re

    if code is None:
        return None
    alone, onward = CONTINUED[language]
    for x, y in _ESCAPES:
        code = code.replace(x, y)
    aside = lambda m: m.group(1) or _ENDS + m.group(0).replace("\n", _FEED) + _ENDS
    text = re.sub(f"(?ms)({LITERAL})|(?:{COMMENT})", aside, code)
    lines = (re.sub(r"\\\n[ \t]*", " ", text) if language == "c" else text).split("\n")
    bare = [x.strip() for x in lines]
    kind = ["B" if not x else "A" if x.startswith(alone) else "PEWX"[x.endswith((*";{)}:", _ENDS)) + 2 * x.startswith(onward)] for x in bare]
    out = []
    for m in re.finditer(STATEMENT, "".join(kind)):
        a, b = m.span()
        out += [" ".join([lines[a], *filter(None, bare[a + 1 : b])]), *[""] * (b - a - 1)]
    text = "\n".join(out).replace(_ENDS, "").replace(_FEED, "\n")
    for x, y in reversed(_ESCAPES):
        text = text.replace(y, x)
    return text


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{BLANK}++|(?<!{BLANK}){BLANK}++\z", "")


def _line_class(bare: Column, alone: str, onward: tuple[str, ...]) -> Column:
    """A: stands alone; B: blank; X and W: continues the line before; E and X: ends a statement; P: none of these."""
    ends, goes_on = bare.rlike(rf"[;{{)}}:{_ENDS}]\z"), F.lit(False)
    for x in onward:
        goes_on = goes_on | bare.startswith(x)
    return F.when(bare == "", "B").when(bare.startswith(alone), "A").when(goes_on, F.when(ends, "X").otherwise("W")).otherwise(F.when(ends, "E").otherwise("P"))


def code_lines(code: Column, language: str = "c") -> Column:
    """The lines of code as joined_code() reads them: comments between marks and on one line, in C with spliced lines."""
    for x, y in _ESCAPES:
        code = F.replace(code, F.lit(x), F.lit(y))
    comment = lambda t: t.startswith("//") | (t.startswith("/*") & t.endswith("*/") & (F.length(t) > 3))
    marked = lambda t: F.when(comment(t), F.concat(F.lit(_ENDS), F.replace(t, F.lit("\n"), F.lit(_FEED)), F.lit(_ENDS))).otherwise(t)
    text = F.array_join(F.transform(F.regexp_extract_all(code, F.lit(_TOKEN), F.lit(1)), marked), "")
    return F.split(F.regexp_replace(text, r"\\\n[ \t]*", " ") if language == "c" else text, "\n", -1)


def joined_code(lines: Column, language: str = "c") -> Column:
    """code_lines() put together with continued statements on one line. Null stays null.

    Lines are joined until one ends in ; { ) } : or a comment, and on while the next begins with ? || or &&, in Java with
    a dot too. Blank lines stand alone, and so do preprocessor lines in C and annotations in Java. Joined lines leave
    empty ones. Each line has a class, a letter; the text of these letters is cut into statements by one pattern.
    """
    alone, onward = CONTINUED[language]
    classes = F.array_join(F.transform(lines, lambda x: _line_class(_stripped(x), alone, onward)), "")
    left = lambda s, k: F.when(k == F.length(s), F.length(s) - 1).otherwise(0)  # noqa: E731  line feeds after a statement
    places = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.struct((k == 1).alias("first"), left(s, k).alias("left")))
    steps = F.flatten(F.transform(F.regexp_extract_all(classes, F.lit(STATEMENT), F.lit(0)), places))
    after = lambda x: F.when(x == "", x).otherwise(F.concat(F.lit(" "), x))
    shown = lambda x, s: F.concat(F.when(s["first"], F.concat(F.lit("\n"), x)).otherwise(after(_stripped(x))), F.repeat(F.lit("\n"), s["left"]))
    text = F.substring(F.array_join(F.zip_with(lines, steps, shown), ""), 2, (1 << 31) - 1)
    text = F.replace(F.replace(text, F.lit(_ENDS), F.lit("")), F.lit(_FEED), F.lit("\n"))
    for x, y in reversed(_ESCAPES):
        text = F.replace(text, F.lit(y), F.lit(x))
    return text


def join_statements(df: DataFrame, code: str, *keys: str, name: str = "code", language: str = "c") -> DataFrame:
    """(keys, name): each row's code with continued statements on one line, see joined_code()."""
    rows = df.select(*keys, code_lines(F.col(code), language).alias("_lines"))
    return rows.select(*keys, joined_code(F.col("_lines"), language).alias(name))


def bracketed(df: DataFrame, code: str, spans: str, *keys: str, name: str = "code") -> DataFrame:
    """(keys, name): add_brackets() of each row's code with its spans, an array of (start, end), in Arrow batches."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields), f"`{name}` string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf[list(keys)].copy()
            out[name] = [add_brackets(x, None if y is None else [tuple(z.values()) if isinstance(z, dict) else tuple(z) for z in y]) for x, y in zip(pdf[code], pdf[spans], strict=True)]
            yield out

    return df.select(*keys, code, spans).mapInPandas(run, schema)


def _held(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, code) with brackets around the bodies that the scanner finds, in one pass of Arrow batches; code that names no
    condition is not looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(len(keys))
            at = pc.fill_null(pc.match_substring_regex(code, "if|else"), False)
            new = [add_brackets(x, scan.bodies(x)) for x in code.filter(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pc.replace_with_mask(code, at, pa.array(new, code.type))], [*keys, "code"])

    rows = rows.select(*keys, "code")
    return rows.mapInArrow(run, rows.schema)


def formatted(df: DataFrame, code: str, *keys: str, language: str = "c", del_comments: bool = True, join: bool = True, macros: bool = True, brackets: bool = True) -> DataFrame:
    """(keys, code): code brought into one form: no comments, a statement a line, no empty lines; in C no macros, and
    brackets around what conditions hold, see scan.bodies(). Nothing is indented anew.
    """
    x = remove_comments(F.col(code)) if del_comments else F.col(code)
    x = del_macros(x) if macros and language == "c" else x
    rows = df.select(*keys, x.alias("code"))
    rows = join_statements(rows, "code", *keys, language=language) if join else rows
    if brackets and language == "c":
        rows = _held(rows, *keys)
    return rows.select(*keys, remove_empty_lines(F.col("code")).alias("code"))


def add_brackets(code: str | None, spans: list[tuple[int, int]] | None) -> str | None:
    """code with `{` and `}` lines around byte spans [start, end], nested ones included; spans of a byte or none stay.

    The spans are bodies of conditions and loops, as a parser gives them.
    """
    if code is None:
        return None
    raw = code.encode()
    todo = [(s, e) for s, e in sorted({(int(s), int(e)) for s, e in spans or []}) if e - s > 1]
    marks: dict[int, bytes] = {}
    for s, e in todo:
        marks[s] = marks.get(s, b"") + b"{\n"
    for s, e in sorted(todo, key=lambda x: (x[1], -x[0])):
        marks[e + 1] = b"}\n" + marks.get(e + 1, b"") if marks.get(e + 1, b"").startswith(b"{") else marks.get(e + 1, b"") + b"}\n"
    out, last = [], 0
    for at in sorted(marks):
        out += [raw[last:at], marks[at]]
        last = min(at, len(raw))
    return b"".join([*out, raw[last:]]).decode(errors="replace")
