"""BPE encoding and decoding by words, with long texts encoded in parts side by side and joined exactly."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.llm import common as C
from patchloom.llm.shingles import cells, column_parts, tidy

MODEL = "word_bpe_49k.json"
#: Characters of a unit, which nothing splits, that are encoded at once; longer ones are encoded in halves.
LEAF = 64
#: Characters in a part of a long text, and parts that are joined in one step of the tree.
PART, WIDTH = 65_536, 16
#: Blanks at which texts are cut: white space to every tokenizer, and no part of a composed character.
BLANKS = " \t\n\r"
#: Words whose tokens a worker keeps, words encoded at once, and bytes of text whose words are told apart at once.
KNOWN, SLICE, CHUNK = 250_000, 10_000, 4 << 20


def model_path(name: str = MODEL) -> str:
    """Where a tokenizer file lies. The same path must hold it on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """A tokenizer file with byte-pair merges that drops white space and marks the ends of words, if any.

    whole encodes any text as the file has it. ended and inner encode a unit, or a part of one, given in the characters
    that stand for bytes: ended where the word ends with it, inner where the word goes on.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = steps[0] if steps else {}
        if spec["model"]["type"] != "BPE" or spec["decoder"] or spec["model"]["dropout"] or split.get("behavior") != "Removed" or not split.get("invert"):
            raise ValueError("this needs a BPE tokenizer that drops white space and has no decoder")
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.path, self.suffix, self.token = path, spec["model"]["end_of_word_suffix"] or "", vocabulary(path)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        # words are cut where ASCII letters meet ASCII marks, but not at marks that begin a suffix of words or are in special tokens
        self.mark = _MARK.copy()
        self.mark[list({ord(c) for t in special for c in t if c.isascii() and not c.isalnum()} | {ord("'")})] = False
        self.known: dict[bytes, bytes] = {}

    @cached_property
    def ended(self):
        return self._bare({})

    @cached_property
    def inner(self):
        return self._bare({"end_of_word_suffix": None})

    def _bare(self, change: dict):
        """The merges alone; made only where a long unit is met."""
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        bare = spec | {"added_tokens": [], "truncation": None, "padding": None, "model": spec["model"] | change}
        return Tokenizer.from_str(json.dumps(bare | dict.fromkeys(("normalizer", "pre_tokenizer", "post_processor"))))

    def units(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(special, units) of a text: special tokens by themselves, and between them the words that merges never leave."""
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                yield True, [part]
            elif part:
                if self.whole.normalizer is not None:
                    part = self.whole.normalizer.normalize_str(part)
                yield False, [u for u, _ in self.whole.pre_tokenizer.pre_tokenize_str(part)]

    def joined(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """The tokens of a unit of two parts, of which these are the tokens; ends tells whether the unit ends with right.

        The text of a few tokens on both sides of the join is encoded anew, and of twice as many until the result begins
        and ends with the tokens that were there, or reaches the unit's ends. Neighbours in an encoding never merge, and a
        sequence whose neighbours do not merge is an encoding: so what is joined is what the unit as a whole gives.
        """
        w = 1
        while True:
            i, j = max(0, len(left) - w), min(len(right), w)
            there = ends and j == len(right)
            text = "".join(map(self.token.__getitem__, left[i:] + right[:j]))
            new = (self.ended if there else self.inner).encode(text.removesuffix(self.suffix) if there else text, add_special_tokens=False).ids
            if (i == 0 or new[0] == left[i]) and (j == len(right) or new[-1] == right[j - 1]):
                return left[:i] + new + right[j:]
            w *= 2

    def unit(self, text: str, ends: bool = True, leaf: int = LEAF) -> list[int]:
        """The tokens of one unit: those of its halves, down to `leaf` characters, joined."""
        leaf = max(1, leaf)
        cut = [text[i : i + leaf] for i in range(0, len(text), leaf)]
        found = [e.ids for e in self.inner.encode_batch(cut[:-1], add_special_tokens=False)] if len(cut) > 1 else []
        found.append((self.ended if ends else self.inner).encode(cut[-1], add_special_tokens=False).ids)
        while len(found) > 1:
            n = len(found)
            found = [self.joined(found[i], found[i + 1], ends and i + 2 == n) if i + 1 < n else found[i] for i in range(0, n, 2)]
        return found[0]

    def words(self, words: list[bytes], leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each word's begin, and the end) of words, which hold none of BLANKS."""
        flat, at = array("i"), np.zeros(len(words) + 1, np.int64)
        for a in range(0, len(words), SLICE):
            some = words[a : a + SLICE]
            new = [w for w in some if len(w) <= leaf and w not in self.known]
            if len(self.known) + len(new) > KNOWN:
                self.known.clear()
                new = [w for w in some if len(w) <= leaf]
            self.known.update(zip(new, (array("i", e.ids).tobytes() for e in self.whole.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)), strict=True))
            for i, w in enumerate(some, a + 1):
                if len(w) <= leaf:
                    flat.frombytes(self.known[w])
                else:
                    for special, units in self.units(w.decode("utf-8", "replace")):
                        for u in units:
                            flat.extend([self.whole.token_to_id(u)] if special else self.unit(u, leaf=leaf))
                at[i] = len(flat)
        return np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), at

    def texts(self, texts: list[str | None], leaf: int = LEAF) -> pa.ListArray:
        """The tokens of each text: every distinct word is encoded once."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        data = b" ".join([*raw, b""])
        x = np.frombuffer(data, np.uint8)
        solid, mark, letter = ~_BLANK[x], self.mark[x], _LETTER[x]
        edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
        inside = np.zeros(len(x), bool)
        inside[1:] = (mark[1:] & letter[:-1]) | (letter[1:] & mark[:-1])
        start, end = np.flatnonzero((edge == 1) | inside), np.flatnonzero((edge == -1) | inside)
        number, one = cells(data, start, end)
        flat, at = self.words([data[start[i] : end[i]] for i in one], leaf)
        k = np.diff(at)[number]
        upto = np.concatenate([[0], np.cumsum(k)])
        out = flat[np.arange(upto[-1]) + np.repeat(at[number] - upto[:-1], k)]
        offsets = upto[np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))


_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[33:127] = ~_LETTER[33:127]
_MARK[48:58] = False


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str]:
    """The tokens of a tokenizer file by their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [ids.get(i, "") for i in range(max(ids, default=-1) + 1)]


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def parts(m: Bpe, text: str, size: int) -> Iterator[tuple[str | None, list[str] | None, bool, bool]]:
    """A text in parts of about `size` characters: (text, units, glued, goes_on).

    A part is a text, cut at a blank; or, where a run without blanks is longer, some of its units. A unit that is longer
    than a part is cut anywhere: it goes on in the next part, which is glued to this one.
    """
    at, n = 0, len(text)
    while at < n:
        if n - at <= size:
            yield text[at:], None, False, False
            return
        cut = max(text.rfind(b, at, at + size) for b in BLANKS)
        if cut > at:
            yield text[at:cut], None, False, False
            at = cut
            continue
        if cut == at:
            at += 1
            continue
        end = min((x for x in (text.find(b, at + size) for b in BLANKS) if x >= 0), default=n)
        for special, units in m.units(text[at:end]):
            held, room = [], size
            for u in units:
                if special:
                    yield u, None, False, False
                    continue
                if held and len(u) > room:
                    yield None, held, False, False
                    held, room = [], size
                for i in range(0, len(u) - size, size):
                    yield None, [u[i : i + size]], i > 0, True
                if len(u) > size:
                    yield None, [u[(len(u) - 1) // size * size :]], True, False
                else:
                    held, room = [*held, u], room - len(u)
            if held:
                yield None, held, False, False
        at = end


def joined_parts(m: Bpe, rows: list[dict]) -> dict:
    """Neighbouring parts as one: halves first, then the join of the halves. See encode() for the columns."""
    if len(rows) == 1:
        return rows[0]
    a, b = joined_parts(m, rows[: len(rows) // 2]), joined_parts(m, rows[len(rows) // 2 :])
    if not b["head"]:
        return {"ids": a["ids"] + b["ids"], "head": a["head"], "tail": b["tail"]}
    k, h = a["tail"], b["head"]
    # the unit goes on beyond b if all of b is in it and b has a tail
    on = b["tail"] == len(b["ids"]) == h
    one = m.joined(a["ids"][len(a["ids"]) - k :], b["ids"][:h], not on)
    ids = a["ids"][: len(a["ids"]) - k] + one + b["ids"][h:]
    return {"ids": ids, "head": len(one) if a["head"] == len(a["ids"]) == k else a["head"], "tail": len(one) if on else b["tail"]}


def encode(docs: DataFrame, path: str | None = None, keep: Sequence[str] | None = None, part: int = PART, leaf: int = LEAF, width: int = WIDTH) -> DataFrame:
    """docs (text, ...) with n_tokens and ids, the token ids of the text as the tokenizers library gives them for the file.

    Texts of up to `part` characters are encoded row by row. Longer ones become parts, a row each, which are dealt over
    the cluster and encoded side by side, then joined in a tree, `width` neighbours at a step. Where a part ends within a
    unit that nothing splits, as in text without blanks, the join encodes growing windows around it anew until both sides
    agree, see Bpe.joined(). Units of over `leaf` characters go the same way within a task.

    keep names the columns that come along, by default all but text; they keep their names, but columns named like results
    are replaced. Null and empty texts, and those of white space alone, have no tokens. Rows with equal ids or texts stay
    rows of their own. Special tokens spelled out in a text are those tokens, as the library has it. Empty in, empty out.
    """
    docs, spark = C.prepared(docs), docs.sparkSession
    path = path or model_path()
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("text", "n_tokens", "ids")]
    along = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("struct<_:int>")
    rows = docs.select(along.alias("_row"), F.coalesce("text", F.lit("")).alias("text"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe(path)
        for batch in batches:
            for a, b, texts in column_parts(batch.column("text"), CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(a, b - a), m.texts(texts, leaf)], ["_row", "ids"])
        tidy()

    kind = rows.select("_row").schema.add("ids", T.ArrayType(T.IntegerType()))
    long = C.cut(rows.where(F.length("text") > part).withColumn("_u", F.monotonically_increasing_id()), "bpe")
    out = rows.where(F.length("text") <= part).mapInArrow(small, kind)
    n_long, longest = long.agg(F.count(F.lit(1)), F.max(F.length("text"))).first()
    if n_long:
        out = out.unionByName(_in_tree(long, path, part, leaf, width).select("_row", "ids"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], F.size("ids").cast("long").alias("n_tokens"), "ids")


def _in_tree(long: DataFrame, path: str, part: int, leaf: int, width: int) -> DataFrame:
    """(_row, ids) of rows (_row, text, _u): see encode()."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe(path)
        for batch in batches:
            for i in range(len(batch)):
                u, held, size = batch.column("_u")[i].as_py(), [], 0
                for no, p in enumerate(parts(m, batch.column("text")[i].as_py(), part)):
                    held.append((u, no, *p))
                    size += 1
                    if size == 64:  # parts leave as they are made
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe(path)
        for batch in batches:
            plain = pc.is_null(batch.column("units")).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(plain))
            for a, b, texts in column_parts(some.column("part"), CHUNK):
                none = pa.array(np.zeros(b - a, np.int32))
                yield pa.RecordBatch.from_arrays([some.column("_u").slice(a, b - a), some.column("no").slice(a, b - a), m.texts(texts, leaf), none, none], ["_u", "no", "ids", "head", "tail"])
            got = []
            for r in batch.filter(pa.array(~plain)).to_pylist():
                ids = [m.unit(x, not (r["goes_on"] and j == len(r["units"]) - 1), leaf) for j, x in enumerate(r["units"])]
                got.append((r["_u"], r["no"], [t for x in ids for t in x], len(ids[0]) if r["glued"] else 0, len(ids[-1]) if r["goes_on"] else 0))
            if got:
                yield _rows(got)
        tidy()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe(path)
        for batch in batches:
            for r in batch.to_pylist():
                x = joined_parts(m, r["rows"])
                yield _rows([(r["_u"], r["no"], x["ids"], x["head"], x["tail"])])

    done = "_u long, no long, ids array<int>, head int, tail int"
    every = long.select("_u", "text").mapInArrow(cut, "_u long, no long, part string, units array<string>, glued boolean, goes_on boolean")
    tree = C.cut(every.repartition("_u", "no").mapInArrow(encoded, done), "bpet")
    most = tree.agg(F.max("no")).first()[0] or 0
    while most:
        group = tree.groupBy("_u", F.floor(F.col("no") / width).alias("no")).agg(F.array_sort(F.collect_list(F.struct("no", "ids", "head", "tail"))).alias("rows"))
        # where no unit goes on, parts only follow one another
        loose = ~F.exists("rows", lambda x: (x.head > 0) | (x.tail > 0))
        plain = group.where(loose).select("_u", "no", F.flatten("rows.ids").alias("ids"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
        tree, most = C.cut(plain.unionByName(group.where(~loose).mapInArrow(joined, done)), "bpet"), most // width
    return long.select("_row", "_u").join(tree.select("_u", "ids"), "_u", "left").select("_row", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["_u", "no", "part", "units", "glued", "goes_on"])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["_u", "no", "ids", "head", "tail"])


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows (ids, ...) with decoded: the text that the library gives for the ids, their tokens with blanks between.

    Ids that name no token are left out. Null ids give null, no ids the empty text.
    """
    path = path or model_path()

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        token = pa.array(vocabulary(path))
        done = []
        for i in range(0, len(ids), 256):  # few texts at a time
            x = ids.slice(i, 256)
            n, flat = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)
            fine = (flat >= 0) & (flat < len(token))
            upto = np.concatenate([[0], np.cumsum(fine)])[np.concatenate([[0], np.cumsum(n)])]
            tokens = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), token.take(pa.array(flat[fine])))
            done.append(pc.if_else(x.is_valid(), pc.binary_join(tokens, " "), None))
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return C.prepared(rows).withColumn("decoded", decoded("ids"))


def op13_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode() and decode() of all documents, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode(encode(docs, keep=["doc_id"]))
    return both.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
