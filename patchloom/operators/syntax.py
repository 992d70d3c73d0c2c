"""Pattern queries on tables of syntax nodes: S-expressions compiled to joins.

A node table has (keys, id, parent, field, type, start_byte, end_byte), one row a named node. A query is a text of patterns:

    (call_expression function: (identifier) @callee) @call   a node, a field, captures
    (block (if_statement) @a (return_statement) @b)          children in this order, others may stand between
    [(if_statement) (while_statement)] @loop                 any of several
    (_) @any                                                 a node of any type

What a query captures is a set of nodes for each name. So patterns are not matched one combination of children after the
other: a node fits a pattern if its children, taken as early as possible, fit the pattern's in order, and a child takes part
if it comes after the earliest places of those before it and before the latest places of those after it. Nodes meet their
parents by one shuffle a level of the patterns, of all patterns at once and of those nodes only whose types they name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.session import checkpointed

TOKEN = re.compile(r"\s+|;[^\n]*|(?P<open>[(\[])|(?P<close>[)\]])|(?P<capture>@[\w.-]+)|(?P<field>[A-Za-z_][\w]*)\s*:|(?P<name>[A-Za-z_][\w]*)|(?P<other>.)", re.S)


@dataclass(eq=False)
class Pattern:
    """A node to look for: of these types (none: any), as this field of its parent, with these children in order.

    One with choices stands for any of them.
    """

    types: tuple[str, ...] = ()
    name: str | None = None
    captures: list[str] = field(default_factory=list)
    children: list[Pattern] = field(default_factory=list)
    choices: list[Pattern] = field(default_factory=list)
    number: int = 0
    height: int = 0
    nested: bool = False


def parse(query: str) -> list[Pattern]:
    """The patterns of a query text. Anchors, repetitions, negated fields and predicates have no form here: an error."""
    top = Pattern()
    stack: list[tuple[Pattern, str]] = [(top, "")]
    wanted, last = None, None
    for m in TOKEN.finditer(query):
        kind, at = m.lastgroup, stack[-1][0]
        if kind is None:
            continue
        if kind == "open":
            new = Pattern(name=wanted)
            (at.choices if stack[-1][1] == "[" else at.children).append(new)
            stack.append((new, m["open"]))
            wanted = last = None
        elif kind == "close":
            if len(stack) < 2 or "([".index(stack[-1][1]) != ")]".index(m["close"]):
                raise ValueError(f"unbalanced {m['close']} at {m.start()} of the query")
            last = stack.pop()[0]
        elif kind == "capture":
            if last is None:
                raise ValueError(f"{m['capture']} follows no pattern")
            last.captures.append(m["capture"][1:])
        elif kind == "field":
            wanted = m["field"]
        elif kind == "name" and stack[-1][1] == "(" and not at.types and not at.children:
            at.types = (m["name"],) if m["name"] != "_" else ()
        elif kind == "name" and m["name"] == "_":
            last = Pattern(name=wanted)
            (at.choices if stack[-1][1] == "[" else at.children).append(last)
            wanted = None
        else:
            raise ValueError(f"{m[0]!r} at {m.start()} of the query is not understood")
    if len(stack) > 1:
        raise ValueError("the query ends within a pattern")
    return top.children


def _numbered(patterns: list[Pattern], nested: bool = False) -> list[Pattern]:
    """All patterns of a query, those within another before it, with their numbers, heights and whether another holds them."""
    out: list[Pattern] = []
    for p in patterns:
        out += _numbered(p.choices, nested) + _numbered(p.children, True)
        p.nested = nested
        p.height = max([0, *(c.height for c in p.choices), *(c.height + 1 for c in p.children)])
        out.append(p)
    for i, p in enumerate(out):
        p.number = i
    return out


#: Marks of a word of 64 bits.
BITS = 62


def _words(numbers: list[int], words: int) -> list[int]:
    """Numbers as bits of so many words."""
    return [sum(1 << i % BITS for i in set(numbers) if i // BITS == w) for w in range(words)]


def _marks(words: int, *conditions: tuple[Column, int]) -> Column:
    """The numbers whose conditions hold, as bits: whole numbers are compared and stored where arrays would be searched."""
    bit = lambda c, i: F.when(c, F.lit(1 << i % BITS).cast("long")).otherwise(F.lit(0).cast("long"))
    of = lambda w: [bit(c, i) for c, i in conditions if i // BITS == w]
    return F.struct(*[reduce(Column.bitwiseOR, of(w), F.lit(0).cast("long")).alias(f"w{w}") for w in range(words)])


def _and(marks: str, numbers: list[int], words: int) -> Column:
    """Those of marks that have one of these numbers."""
    return F.struct(*[F.col(marks)[f"w{w}"].bitwiseAND(F.lit(m).cast("long")).alias(f"w{w}") for w, m in enumerate(_words(numbers, words))])


def _or(a: Column, b: Column, words: int) -> Column:
    return F.struct(*[a[f"w{w}"].bitwiseOR(b[f"w{w}"]).alias(f"w{w}") for w in range(words)])


def _some(marks: str, words: int) -> Column:
    return reduce(lambda x, y: x | y, [F.col(marks)[f"w{w}"] != 0 for w in range(words)])


def _has(marks: str, p: Pattern) -> Column:
    return F.col(marks)[f"w{p.number // BITS}"].bitwiseAND(F.lit(1 << p.number % BITS).cast("long")) != 0


def _named(p: Pattern) -> Column:
    return F.lit(True) if p.name is None else F.col("field") == p.name


def _fits(words: int, every: list[Pattern], known: dict[int, Column]) -> Column:
    """Marks of what a node fits: patterns whose fit is known, and those that are a choice among them."""
    for p in every:
        some = [known[c.number] for c in p.choices if c.number in known]
        if some:
            known[p.number] = reduce(lambda x, y: x | y, some) & _named(p)
    return _marks(words, *((c, i) for i, c in known.items()))


def _chosen(p: Pattern) -> list[Pattern]:
    """A pattern and all that it lets choose from, at any depth: a node that takes part as it does as those it fits."""
    return [p, *(x for c in p.choices for x in _chosen(c))]


def _matched(rows: DataFrame, words: int, patterns: list[Pattern], down: bool, *keys: str) -> DataFrame:
    """Marks of what nodes take part as, of patterns with children and of these children, all by one shuffle.

    rows are (keys, _x, _own, _fits, ...): a node under its own id with the patterns that it may be, or under its parent's
    with those that it fits. Without down only the former are given.
    """
    w = Window.partitionBy(*keys, "_x")
    early, late = (lambda p, i: f"_e{p.number}_{i}"), (lambda p, i: f"_l{p.number}_{i}")
    most = max(len(p.children) for p in patterns)
    for i in range(most):
        # the earliest place of each child's pattern after the places of those before it; the latest too of the last child's
        at = lambda p: _has("_fits", p.children[i]) & (F.col("_pos") > F.col(early(p, i - 1)) if i else F.lit(True))  # noqa: B023, E731
        now = [p for p in patterns if i < len(p.children)]
        new = {early(p, i): F.min(F.when(at(p), F.col("_pos"))).over(w) for p in now}
        if down:
            new |= {late(p, i): F.max(F.when(at(p), F.col("_pos"))).over(w) for p in now if 0 < i == len(p.children) - 1}
            new |= {} if i else {f"_p{p.number}": F.max(_has("_own", p)).over(w) for p in patterns}
        rows = rows.withColumns(new)
    last = {p.number: F.col(early(p, len(p.children) - 1)).isNotNull() for p in patterns}
    own = [(_has("_own", p) & last[p.number], p.number) for p in patterns]
    if not down:
        return rows.withColumn("_fits", _marks(words, *own)).where(_some("_fits", words))

    def takes(p: Pattern, i: int) -> Column:
        out = F.col(f"_p{p.number}") & last[p.number] & _has("_fits", p.children[i])
        out = out & (F.col("_pos") > F.col(early(p, i - 1))) if i else out
        return out & (F.col("_pos") < F.col(late(p, i + 1))) if i < len(p.children) - 1 else out

    for i in reversed(range(1, most - 1)):
        rows = rows.withColumns({late(p, i): F.max(F.when(takes(p, i), F.col("_pos"))).over(w) for p in patterns if i < len(p.children) - 1})
    kids = [(takes(p, i) & _has("_fits", c), c.number) for p in patterns for i, child in enumerate(p.children) for c in _chosen(child)]
    return rows.withColumn("_as", _marks(words, *own, *kids)).where(_some("_as", words))


def inside(nodes: DataFrame, roots: DataFrame, *keys: str) -> DataFrame:
    """The nodes that lie within one of the roots (keys, start_byte, end_byte), roots included.

    A node does if some root that begins no later ends no earlier: a running maximum of ends over each document.
    """
    order = Window.partitionBy(*keys).orderBy("start_byte", "_is_node").rowsBetween(Window.unboundedPreceding, 0)
    cols = nodes.columns
    marked = nodes.select(F.struct(*cols).alias("_row"), *keys, "start_byte", "end_byte", F.lit(1).alias("_is_node"))
    ends = roots.select(F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"), *keys, "start_byte", "end_byte", F.lit(0).alias("_is_node"))
    both = marked.unionByName(ends).withColumn("_reach", F.max(F.when(F.col("_is_node") == 0, F.col("end_byte"))).over(order))
    return both.where((F.col("_is_node") == 1) & (F.col("end_byte") <= F.col("_reach"))).select("_row.*")


def query(nodes: DataFrame, text: str, *keys: str, within: DataFrame | None = None) -> DataFrame:
    """(keys, capture, id, type, start_byte, end_byte): the nodes that a query captures, each once a name.

    within, if given, has (keys, start_byte, end_byte) of nodes whose subtrees alone are looked at. Keys name a document.
    Nodes of one parent stand in order of their bytes, then of their ids; a null parent is that of a root.
    """
    nodes = nodes if within is None else inside(nodes, within, *keys)
    tops = parse(text)
    every = _numbered(tops)
    words = len(every) // BITS + 1
    parts = [p for p in every if p.children]
    leaves = {p.number: (F.col("type").isin(*p.types) if p.types else F.lit(True)) & _named(p) for p in every if not p.children and not p.choices}
    may = [((F.col("type").isin(*p.types) if p.types else F.lit(True)) & _named(p), p.number) for p in parts]
    shown = [*keys, "id", "type", "start_byte", "end_byte"]
    rest = [*shown, "parent", "field", "_pos"]
    rows = nodes.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys], F.lit(True)))
    rows = rows.withColumn("_pos", F.struct("start_byte", "end_byte", "id")).withColumns({"_own": _marks(words, *may), "_fits": _fits(words, every, leaves)})
    used = _some("_own", words) | _some("_fits", words)
    rows = rows.where(used).select(*rest, "_own", "_fits")
    levels = sorted({p.height for p in parts})
    whole = [c for p in tops if not p.children for c in _chosen(p) if not c.children]
    if 2 * len(levels) - 1 + bool(whole) > 1:
        rows = checkpointed(rows)  # each level reads it
    none = _marks(words)

    def copies(df: DataFrame, patterns: list[Pattern]) -> DataFrame:
        """Each node under its own id, with those of patterns that it may be, and under its parent's, with what it fits."""
        kept = lambda c, ps: _and(c, [p.number for p in ps], words)
        kids = [x for p in patterns for c in p.children for x in _chosen(c)]
        both = F.array(F.struct(F.col("id").alias("_x"), kept("_own", patterns).alias("_own"), none.alias("_fits")), F.struct(F.col("parent").alias("_x"), none.alias("_own"), kept("_fits", kids).alias("_fits")))
        return df.select(*rest, F.explode(both).alias("_c")).select(*rest, "_c.*").where(F.col("_x").isNotNull() & used)

    def known(patterns: list[Pattern], below: int) -> DataFrame:
        df = rows
        for h in levels:
            df = df.unionByName(fitting[h].select(*rest, none.alias("_own"), "_fits")) if h < below and h in fitting else df
        return copies(df, patterns)

    fitting: dict[int, DataFrame] = {}
    for h in levels:
        inner = [p for p in parts if p.height == h and p.nested]
        if inner:
            fit = _matched(known(inner, h), words, inner, False, *keys)
            fitting[h] = checkpointed(fit.withColumn("_fits", _fits(words, every, {p.number: _has("_fits", p) for p in inner})).select(*rest, "_fits"))
    free = {p.number for t in tops for p in _chosen(t)}
    groups = [p for p in every if p.choices and p.number in free]
    caught = lambda df, ps: df.select(*shown, F.explode(F.array(*[F.when(_has("_as", p), F.lit(c)) for p in ps for c in p.captures])).alias("capture")).where("capture is not null")
    alone = [p for p in whole if p.captures]
    found = [caught(rows.select(*shown, F.col("_fits").alias("_as")), alone)] if alone else []
    taking: list[DataFrame] = []
    for h in reversed(levels):
        now = [p for p in parts if p.height == h]
        nested = [p for p in now if p.number not in free]
        start = known(now, h)
        if nested:
            drop = [p.number for p in nested]
            start = start.withColumn("_own", _and("_own", [p.number for p in every if p.number not in drop], words)).where(used)
            for t in taking:
                start = start.unionByName(t.select(*rest, F.col("id").alias("_x"), _and("_as", drop, words).alias("_own"), none.alias("_fits")).where(_some("_own", words)))
        # a node that fits a choice at the top is one of its group too
        part = _matched(start, words, now, True, *keys).withColumn("_as", _or(F.col("_as"), _fits(words, groups, {p.number: _has("_as", p) for p in now if p.number in free}), words)).select(*rest, "_as")
        if any(p.height < h and p.number not in free for p in parts):
            part = checkpointed(part)
        taking.append(part)
        wanted = [p for p in every if p.captures and (p in now or p in groups or any(p in _chosen(c) for q in now for c in q.children))]
        if wanted:
            found.append(caught(part, wanted))
    out = [*keys, "capture", "id", "type", "start_byte", "end_byte"]
    if not found:
        return rows.select(*shown, F.lit(None).cast("string").alias("capture")).select(*out).limit(0)
    return reduce(DataFrame.unionByName, found).where("id is not null").select(*out).distinct()


def first_captured(found: DataFrame, *keys: str) -> DataFrame:
    """Of each document's captures the first in the text, as what asks for one node gets."""
    best = F.min_by(F.struct("capture", "id", "type", "start_byte", "end_byte"), F.struct("start_byte", F.col("end_byte"), "capture", "id")).alias("_f")
    return found.groupBy(*keys).agg(best).select(*keys, "_f.*")


# The node classes of code property graphs with the classes they extend, as analysers name them.
LATTICE = """
META_DATA NODE
AST_NODE NODE
CFG_NODE AST_NODE NODE
DECLARATION NODE
FILE AST_NODE NODE
NAMESPACE AST_NODE NODE
NAMESPACE_BLOCK AST_NODE NODE
EXPRESSION CFG_NODE NODE
BLOCK EXPRESSION NODE
CALL_REPR CFG_NODE NODE
CALL CALL_REPR EXPRESSION NODE
CONTROL_STRUCTURE EXPRESSION NODE
FIELD_IDENTIFIER EXPRESSION NODE
IDENTIFIER EXPRESSION NODE
JUMP_LABEL AST_NODE NODE
JUMP_TARGET CFG_NODE NODE
LITERAL EXPRESSION NODE
LOCAL EXPRESSION NODE
METHOD_REF EXPRESSION NODE
MODIFIER AST_NODE NODE
RETURN EXPRESSION NODE
TYPE_REF EXPRESSION NODE
UNKNOWN EXPRESSION NODE
COMMENT AST_NODE NODE
CONFIG_FILE NODE
BINDING NODE
METHOD EXPRESSION NODE
METHOD_PARAMETER_IN CFG_NODE DECLARATION NODE
METHOD_PARAMETER_OUT CFG_NODE DECLARATION NODE
METHOD_RETURN CFG_NODE NODE
MEMBER AST_NODE DECLARATION NODE
TYPE NODE
TYPE_ARGUMENT AST_NODE NODE
TYPE_DECL AST_NODE NODE
TYPE_PARAMETER AST_NODE NODE
ANNOTATION EXPRESSION NODE
ANNOTATION_LITERAL EXPRESSION NODE
ANNOTATION_PARAMETER AST_NODE NODE
ANNOTATION_PARAMETER_ASSIGN AST_NODE NODE
ARRAY_INITIALIZER EXPRESSION NODE
IMPORT NODE
"""


def lattice(spark: SparkSession, text: str = LATTICE) -> DataFrame:
    """(type, extends): a row for each class and each one that it extends."""
    pairs = [(kind, up) for kind, *ups in map(str.split, text.strip().splitlines()) for up in ups]
    return spark.createDataFrame(pairs, "type string, extends string")


def supertypes(extends: DataFrame, limit: int = 64) -> DataFrame:
    """(type, super): every class with all that it is, itself included: the closure of a table (type, extends).

    Each round joins what is known with itself, so chains are followed in twice as long steps; cycles end it too.
    """
    e = extends.where("type is not null and extends is not null").select("type", F.col("extends").alias("super"))
    names = e.select("type").unionByName(e.select(F.col("super").alias("type"))).distinct()
    known = checkpointed(e.unionByName(names.select("type", F.col("type").alias("super"))).distinct())
    n = known.count()
    for _ in range(limit):
        further = known.select("type", F.col("super").alias("_mid")).join(known.select(F.col("type").alias("_mid"), "super"), "_mid").select("type", "super")
        known = checkpointed(further.distinct())
        m = known.count()
        if m == n:
            return known
        n = m
    raise RuntimeError(f"no end after {limit} rounds")


def of_supertype(nodes: DataFrame, closure: DataFrame, *wanted: str) -> DataFrame:
    """Nodes (type, ...) that are of one of the wanted classes, or of one that extends it; each once."""
    return nodes.join(closure.where(F.col("super").isin(*wanted)).select("type").distinct(), "type", "left_semi")
