"""Statements by classes of lines against a loop over lines, and merged lines against merged texts."""

import random

from patchloom.functions import text as T
from patchloom.operators import merge as M


def joined(lines, language):
    """The rule as a state: nothing begun, a statement that goes on, or one that only continuations follow."""
    alone, onward = T.CONTINUED[language]
    out, state = [], "none"
    for line in lines:
        bare = line.strip()
        end, more = bare.endswith((";", "{", ")", "}", ":")), bare.startswith(onward)
        goes = state == "open" and not bare.startswith(alone) or state == "closed" and more
        if not goes and (not bare or bare.startswith(alone)):
            out.append([line])
            state = "none"
        elif goes:
            out[-1] += [bare] if bare else []
            out[-1].append(None)
            state = "closed" if end or state == "closed" else "open"
        else:
            out.append([line])
            state = "closed" if end else "open"
    return "\n".join(x for s in out for x in [" ".join(y for y in s if y is not None), *[""] * s.count(None)])


def test_statements_by_classes(spark):
    rng = random.Random(11)
    lines = ["a", "b =", "c;", "", "  ", "? d", "&& e;", "|| f", "#g", "@h", ".i()", "j {", "}", "k:", "\x1c", "l "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for i in range(400)]
    for language in ("c", "java"):
        got = {r["id"]: r["code"] for r in T.join_statements(spark.createDataFrame(rows, "id int, t string"), "t", "id", language=language).collect()}
        for i, t in rows:
            assert got[i] == T.statement_lines(t, language) == joined(t.split("\n"), language), repr(t)


def test_statements_of_odd_texts(spark):
    odd = {
        "null": (None, None), "empty": ("", ""), "comment ends": ("a // x\n= 1;", "a // x\n= 1;"), "comment of lines": ("a /* 1\n2 */ =\n b;", "a /* 1\n2 */ = b;\n"),
        "open comment": ("a /* =\n b;", "a /* = b;\n"), "marks": ("\x02a\x04b =\n\x03;\x04d", "\x02a\x04b = \x03;\x04d\n"), "spliced": ("a \\\n  b\nc;", "a  b c;\n"),
        "quoted": ('s = "// x";\nt', 's = "// x";\nt'), "escapes": ('x = "' + '\\"' * 20_000 + '"\n;', 'x = "' + '\\"' * 20_000 + '" ;\n'), "long": ("a\n" * 30_000, "a" + " a" * 29_999 + "\n" * 30_000),
    }
    rows = [(k, v[0]) for k, v in odd.items()]
    got = {r["id"]: r["code"] for r in T.join_statements(spark.createDataFrame(rows, "id string, t string"), "t", "id").collect()}
    for k, (t, want) in odd.items():
        assert got[k] == want and (k == "escapes" or T.statement_lines(t) == want), k


def test_merged_lines_are_the_merged_text(spark):
    rng = random.Random(3)
    snippet = lambda: "\n".join(rng.choice(["a", "b", "+a", "-b", "+c"]) for _ in range(rng.randrange(1, 6)))
    rows = [(i % 3, i, snippet()) for i in range(200)] + [(9, 500, None), (9, 501, ""), (9, 502, "+x"), (9, 503, "plain")]
    df = spark.createDataFrame(rows, "k int, s long, text string")
    for keep in (False, True):
        texts = {(r["k"], r["first_snippet"]): r["merged"] for r in M.merge_snippets(df, "k", "s", keep_unmarked=keep).collect()}
        got = {}
        for r in M.merged_lines(df, "k", "s", keep_unmarked=keep).collect():
            got.setdefault((r["k"], r["first_snippet"]), []).append((r["gap"], not r["marked"], r["s"] or 0, r["pos"], r["line"]))
        assert {k: "\n".join(x[-1] for x in sorted(v)) for k, v in got.items()} == texts
