"""SentencePiece encoding and decoding, with distinct sampled segmentations by perturbed search over the lattice."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.near_dedup import _unit
from patchloom.llm.shingles import STEP, U, cells, column_parts, mix, part_hash, prefix_hash, tidy
from patchloom.session import prepared

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Sampled segmentations of each text, and the power to which piece probabilities are raised.
SAMPLES, ALPHA = 2, 0.5
#: Characters worked on at once; a longer text goes alone.
CHUNK = 1 << 19
#: Distinct words that the model encodes in one call.
TOGETHER = 32


def model_path(name: str = MODEL) -> str:
    """Where a public tokenizer's file lies; any path may be given instead."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A SentencePiece model as a lattice: its pieces by hash, their weights, and encoding of texts by distinct words.

    The weight of a piece is its log-probability in a unigram model; a BPE model has ranks instead, and takes
    -log(rank + 2). Characters outside the pieces are one edge of their bytes' pieces.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        plain = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)])
        if (score[plain] == np.round(score[plain])).all():
            score = -np.log(np.minimum(-score, 2.0 * n) + 2)
        self.weight = score * alpha
        self.byte_id = np.zeros(256, np.int64)
        byte_weight = -np.log(2.0 * n + 2) * alpha
        self.raw = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                b = int(text[i][1:-1], 16)
                self.byte_id[b], self.weight[i], self.raw[i] = i, byte_weight, bytes([b])
            elif plain[i]:
                self.raw[i] = text[i].replace(SPACE, " ").encode()
        self.byte_weight = byte_weight
        if any(p in text for p in ("\n", f"{SPACE}\n")):
            raise ValueError("line feeds are pieces of this model")
        # whether a line feed is its byte and nothing else, so that what it parts is encoded as if alone
        self.parted = not any("\n" in text[i] for i in np.flatnonzero(plain))
        if sp.decode(sp.encode(" a  ﬁ　b ")) != " a  ﬁ　b ":
            raise ValueError("this model changes texts before it encodes them")
        self.raw_size = np.fromiter(map(len, self.raw), np.int64, n)
        self.raw_bytes = pa.array(self.raw, pa.large_binary())
        ids = np.flatnonzero(plain)
        self.tables, self.spelt = [], []
        codes = [np.frombuffer(text[i].encode("utf-32-le"), np.uint32) for i in ids]
        # a text splits between characters that are neighbours in no piece
        self.joined = np.zeros(1 << 18, bool)
        for c in codes:
            self.joined[self.pair(c[:-1], c[1:])] = True
        self.longest = max(map(len, codes))
        for size in range(1, self.longest + 1):
            mine = [k for k, c in enumerate(codes) if len(c) == size]
            h = np.array([part_hash(prefix_hash(codes[k]), np.array([0]), np.array([size]))[0] for k in mine], U)
            order = np.argsort(h)
            seen = np.zeros(1 << 17, bool)
            seen[(h >> U(47)).astype(np.int64)] = True
            if (np.diff(h[order]) == 0).any():
                raise ValueError("two pieces of this model share a hash")
            self.spelt.append(np.array([codes[mine[o]] for o in order], np.uint32).reshape(-1, size))
            self.tables.append((h[order], ids[np.array(mine, np.int64)][order] if mine else np.zeros(0, np.int64), seen))
        # for each size the places of hashes of that many characters with which a longer piece begins
        self.onward = []
        lengths = np.fromiter(map(len, codes), np.int64, len(codes))
        h, begin = prefix_hash(np.concatenate(codes)), np.cumsum(lengths) - lengths
        for size in range(1, self.longest + 1):
            at = begin[lengths > size]
            onward = np.zeros(1 << 17, bool)
            onward[(part_hash(h, at, at + size) >> U(47)).astype(np.int64)] = True
            self.onward.append(onward)

    @staticmethod
    def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A place in a table for two characters; pairs that share one are only kept together more often."""
        return ((x.astype(np.uint32) * np.uint32(0x9E3779B1) ^ y.astype(np.uint32) * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)) >> np.uint32(14)

    def lookup(self, h: np.ndarray, size: int, code: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, id) of the parts of code, from start on with these hashes, that are pieces of this size."""
        table, ids, seen = self.tables[size - 1]
        if not len(table):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(seen[(h >> U(47)).astype(np.int64)])
        place = np.minimum(np.searchsorted(table, h[at]), len(table) - 1)
        ok = table[place] == h[at]
        at, place = at[ok], place[ok]
        ok = np.ones(len(at), bool)
        for j in range(size):  # a piece is its characters, not a hash
            ok &= code[start[at] + j] == self.spelt[size - 1][place, j]
        return at[ok], ids[place[ok]]


@lru_cache(maxsize=2)
def pieces(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


class Batch:
    """Some texts cut into words, their distinct words compiled to sampling tables."""

    def __init__(self, model: Pieces, texts: list[str | None], lattice: bool = True):
        self.model = model
        # the model puts a blank before a text that has characters
        joined = [(SPACE + t.replace(" ", SPACE)) if t else "" for t in texts]
        raw = [t.encode("utf-32-le", "surrogatepass") for t in joined]
        lengths = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
        code = np.frombuffer(b"".join(raw), np.uint32)
        self.ends = ends = np.cumsum(lengths)
        n = len(code)
        if n == 0:
            self.doc_first = np.zeros(len(texts) + 1, np.int64)
            self.base = self.codes = np.zeros(0, np.int64)
            self.word = np.zeros(0, np.int64)
            return
        first = np.ones(n, bool)
        first[1:] = ~model.joined[model.pair(code[:-1], code[1:])]
        first[ends[:-1][ends[:-1] < n]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], n)
        self.doc_first = np.searchsorted(start, np.concatenate([[0], ends]))
        self.doc_first[-1] = len(start)
        self.word, one = cells(code.tobytes(), 4 * start, 4 * end)
        self.word = self.word.astype(np.int64)
        size = (end - start)[one]
        start = start[one]
        self.size = size
        self.base = np.concatenate([[0], np.cumsum(size)])
        total = int(self.base[-1])
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(total) - self.base[word]
        self.codes = code[np.repeat(start, size) + place]
        if lattice:
            self._compile(word, place)

    def _compile(self, word: np.ndarray, place: np.ndarray) -> None:
        """Flat tables of the distinct words' lattices: for each place the edges that leave it, with probabilities."""
        m, size, code, total = self.model, self.size, self.codes, len(self.codes)
        left = size[word] - place
        h = prefix_hash(code)
        src, width, ids = [], [], []
        known = np.zeros(total, bool)
        at = np.arange(total)
        for k in range(1, min(m.longest, int(size.max())) + 1):
            part = part_hash(h, at, at + k)
            hit, found = m.lookup(part, k, code, at)
            src.append(at[hit].astype(np.int32))
            width.append(np.full(len(hit), k, np.int32))
            ids.append(found.astype(np.int32))
            # longer pieces are looked for only where one begins with these characters
            at = at[m.onward[k - 1][(part >> U(47)).astype(np.int64)] & (left[at] > k)]
        known[src[0]] = True
        src, width, ids = src[::-1], width[::-1], ids[::-1]
        lost = np.flatnonzero(~known)
        # a character of one byte is that byte's piece; ids below 0 stand for the bytes of others
        src.append(lost.astype(np.int32))
        width.append(np.ones(len(lost), np.int32))
        ids.append(np.where(code[lost] < 0x80, m.byte_id[code[lost] & 0x7F], -1 - code[lost].astype(np.int64)).astype(np.int32))
        src, width, ids = map(np.concatenate, (src, width, ids))
        order = np.argsort(src, kind="stable")  # merges a few ordered runs; longer, likelier pieces come first
        src, width, ids = src[order], width[order], ids[order]
        nbytes = 1 + (code >= 0x80).astype(int) + (code >= 0x800) + (code >= 0x10000)
        w = np.where(ids >= 0, m.weight[np.maximum(ids, 0)], m.byte_weight * nbytes[src])
        near = left[src]
        order = np.argsort(near.astype(np.uint16) if near.max() < 1 << 16 else near, kind="stable")
        mass = np.zeros(total + 1)
        prob = np.empty(len(src))
        # from the words' ends backwards: all edges as far from their word's end are done together
        by = near[order]
        cuts = np.append(np.flatnonzero(np.diff(by, prepend=-1)), len(by))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i = order[a:b]
            s, k = src[i], width[i]
            v = w[i] + np.where(k == by[a], 0.0, mass[s + k])
            head = np.flatnonzero(np.diff(s, prepend=-1))
            n = np.diff(np.append(head, b - a))
            top = np.maximum.reduceat(v, head)
            e = np.exp(v - np.repeat(top, n))
            sums = np.add.reduceat(e, head)
            mass[s[head]] = top + np.log(sums)
            prob[i] = e / np.repeat(sums, n)
        self.width, self.ids, self.prob = width, ids, prob
        self.state = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=total))])
        self.cum = np.concatenate([[0.0], np.cumsum(self.prob)])
        self.logp = np.log(self.prob)
        self.mass = mass

    def sample(self, active: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One segmentation of each active word, drawn by its key: edges in order of words, where each word's begin, and
        log-probabilities; none and 0 for other words."""
        n = len(self.word)
        at = self.base[self.word[active]]
        stop = self.base[self.word[active] + 1]
        whos, edges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        logp = np.zeros(n)
        state = key
        while len(active):
            state = state * U(0x5851F42D4C957F2D) + U(0x14057B7EF767814F)
            lo, hi = self.state[at], self.state[at + 1]
            c = self.cum[lo]
            aim = c + _unit(state) * (self.cum[hi] - c)
            e = lo
            on = np.flatnonzero((self.cum[e + 1] <= aim) & (e < hi - 1))
            while len(on):  # likely edges come first
                e[on] += 1
                on = on[(self.cum[e[on] + 1] <= aim[on]) & (e[on] < hi[on] - 1)]
            whos.append(active)
            edges.append(e)
            logp[active] += self.logp[e]
            at = at + self.width[e]
            go = at < stop
            active, at, stop, state = active[go], at[go], stop[go], state[go]
        who, edge = np.concatenate(whos), np.concatenate(edges)
        start = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))])
        # a word's edges were found in order: each goes to its word's begin and its own number there
        place = np.concatenate([np.full(len(w), i) for i, w in enumerate(whos)])
        out = np.empty(len(who), np.int64)
        out[start[who] + place - 1] = edge
        return out, start, logp

    def other(self, w: int, seen: list[tuple[int, ...]], unit: Iterator[float]) -> tuple[int, ...]:
        """A segmentation (edges) of distinct word w other than those seen, drawn from what is left of its distribution.

        There must be one. Where what is left is too little to be told from rounding, edges that lead to it keep a trace
        of their probability, and others, by a count of segmentations, none.
        """
        path: list[int] = []
        # what each known segmentation still has to go through, as a probability
        rest = [np.append(np.cumprod(self.prob[list(s)][::-1])[::-1], 1.0) for s in seen]
        alive = list(range(len(seen)))
        at, stop = int(self.base[w]), int(self.base[w + 1])
        ways = self.ways(w, len(seen) + 1)
        while at < stop:
            lo, hi, i = int(self.state[at]), int(self.state[at + 1]), len(path)
            open_ = []
            for e in range(lo, hi):
                on = [q for q in alive if seen[q][i] == e]
                left = 1.0 - sum(float(rest[q][i + 1]) for q in on) if on else 1.0
                some = len(on) < ways[at + int(self.width[e])]
                open_.append(float(self.prob[e]) * max(1e-15, left) if some else 0.0)
            u, k = next(unit) * sum(open_), 0
            while k < hi - lo - 1 and ((u := u - open_[k]) >= 0 or not open_[k]):
                k += 1
            while not open_[k]:  # the last edges may be closed
                k -= 1
            path.append(lo + k)
            alive = [q for q in alive if seen[q][i] == lo + k]
            at += int(self.width[lo + k])
        return tuple(path)

    def chance(self, edges: tuple[int, ...]) -> float:
        """Probability of a run of edges; 1 of none."""
        out = 1.0
        for e in edges:
            out *= float(self.prob[e])
        return out

    def ways(self, w: int, limit: int) -> dict[int, int]:
        """How many segmentations distinct word w has from each place on, up to a limit."""
        ways = {int(self.base[w + 1]): 1}
        for at in range(int(self.base[w + 1]) - 1, int(self.base[w]) - 1, -1):
            ways[at] = min(limit, sum(ways[at + int(self.width[e])] for e in range(int(self.state[at]), int(self.state[at + 1]))))
        return ways

    def to_ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of edges, those of characters' bytes spelt out."""
        ids = self.ids[edges]
        if ids.min(initial=0) >= 0:
            return ids
        out: list = []
        for part in np.split(ids, np.flatnonzero(ids < 0)):
            if len(part) and part[0] < 0:
                out.append(self.model.byte_id[np.frombuffer(chr(-1 - int(part[0])).encode("utf-8", "surrogatepass"), np.uint8)])
                part = part[1:]
            out.append(part)
        return np.concatenate(out).astype(np.int32)


def encode(model: Pieces, texts: list[str | None], batch: Batch | None = None) -> list[np.ndarray]:
    """What the model's own encode gives for each text: distinct words are encoded once and put together."""
    b = batch or Batch(model, texts, lattice=False)
    if not len(b.word):
        return [np.zeros(0, np.int32) for _ in texts]
    # words with a line feed of their own go one by one, others many at once, a line feed before each
    words = len(b.base) - 1
    fed = np.zeros(words, bool)
    fed[np.searchsorted(b.base, np.flatnonzero(b.codes == 10), side="right") - 1] = True
    some = np.flatnonzero(~fed) if model.parted else np.zeros(0, np.int64)
    each = np.flatnonzero(fed) if model.parted else np.arange(words)
    flat, start, size = np.zeros(0, np.int32), np.zeros(words, np.int64), np.zeros(words, np.int64)
    for at, many in ((some, TOGETHER), (each, 1)):
        if not len(at):
            continue
        ids = model.sp.encode(_lines(b, at, many), num_threads=1)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        got = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        # after a line feed no blank is put before a word; the blank before a line and the line feeds come off again
        off = np.cumsum(n) - n
        begin = off + 2 if many == 1 else np.flatnonzero(got == model.byte_id[10]) + 1
        stop = np.append(begin[1:] - 1, len(got))
        stop[many - 1 :: many] = (off + n)[: len(stop[many - 1 :: many])]
        start[at], size[at] = len(flat) + begin, stop - begin
        flat = np.concatenate([flat, got])
    n = size[b.word]
    ends = np.concatenate([[0], np.cumsum(n)])
    out = flat[np.repeat(start[b.word] - ends[:-1], n) + np.arange(ends[-1])]
    return np.split(out, ends[b.doc_first[1:-1]])


def _lines(b: Batch, at: np.ndarray, many: int) -> list[str]:
    """The distinct words at these places, so many in a text, each with a line feed before it."""
    size = b.size[at] + 1
    first = np.cumsum(size) - size
    code = b.codes[np.maximum(np.repeat(b.base[at] - 1 - first, size) + np.arange(int(size.sum())), 0)]
    code[first] = 10
    every = code.tobytes().decode("utf-32-le", "surrogatepass").replace(SPACE, " ")
    cuts = [*first[::many].tolist(), len(every)]
    return [every[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def decode(model: Pieces, ids: np.ndarray) -> str:
    """The text of piece ids: pieces joined, bytes put together, the blank before the text taken off."""
    out = spell(model, ids).decode("utf-8", "replace")
    return out[1:] if out[:1] == " " else out


def spell(model: Pieces, ids: np.ndarray) -> bytes:
    """The bytes of piece ids, the blank before the text included."""
    return b"".join(map(model.raw.__getitem__, ids.tolist()))


def spells(model: Pieces, flat: np.ndarray, size: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Whether each run of `size` piece ids, one after another in flat, spells the bytes it should."""
    ends = np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([[0], np.cumsum(model.raw_size[flat])])
    ok = total[ends[1:]] - total[ends[:-1]] == np.fromiter(map(len, raw), np.int64, len(raw))
    if not ok.all():
        flat = flat[np.repeat(ok, size)]
    want = np.frombuffer(b"".join(r for r, o in zip(raw, ok.tolist(), strict=True) if o), np.uint8)
    if len(want):
        got = np.frombuffer(model.raw_bytes.take(pa.array(flat)).buffers()[2], np.uint8, len(want))
        off = np.flatnonzero(got != want)
        if len(off):
            at = np.flatnonzero(ok)
            last = np.cumsum([len(raw[i]) for i in at.tolist()])
            ok[at[np.searchsorted(last, off, side="right")]] = False
    return ok


def sample(model: Pieces, texts: list[str | None], keys: np.ndarray, k: int = SAMPLES, batch: Batch | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations: (ids, log-probability, perturbed score, log inclusion score).

    The k segmentations with the largest Gumbel-perturbed log-probabilities, hence a sample without replacement, found
    by best-first search with sets of segmentations as nodes. A node is "equal to a known path up to word j, different
    there"; its mass has a closed form, its largest perturbed score is drawn as a Gumbel of that mass cut off at the
    score of the path it was split from. The best node is taken, the path that attains its maximum is drawn (word j
    from what is left of its distribution, later words afresh), and the node is split along that path. The (k + 1)th
    score is the threshold kappa of the inclusion score 1 - exp(-exp(logp - kappa)), given as a logarithm since whole
    texts have tiny probabilities; it is 0 where every segmentation has been taken.

    Words are the parts between characters that are neighbours in no piece: no piece reaches from one word into the
    next, so they are independent. Every draw
    is a hash of the text's key, so results do not depend on batches. Empty texts have one empty segmentation.
    """
    b = batch or Batch(model, texts)
    n, nd = len(b.word), len(texts)
    first = b.doc_first
    if n == 0:
        return [[(np.zeros(0, np.int32), 0.0, 0.0, 0.0)] for _ in texts]
    doc = np.repeat(np.arange(nd), np.diff(first))
    within = (np.arange(n) - first[doc]).astype(U)
    keys = mix(keys.astype(np.int64).view(U))
    word_keys = keys[doc]
    drawn = lambda r, at: b.sample(at, mix(word_keys[at] + (within[at] + U((r << 40) + 1)) * U(STEP)))
    paths = [drawn(0, np.arange(n))]
    single = np.diff(first) == 0
    # nodes split off the first paths, for all texts at once
    logw = paths[0][2]
    root = -np.log(-np.log(_unit(mix(keys + U(0xABCD)))))
    c = np.concatenate([[0.0], np.cumsum(logw)])
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        rest = np.log1p(-np.minimum(np.exp(logw), 1.0))
        phi = c[:-1] - c[first[doc]] + rest
        g0 = phi - np.log(np.exp(phi - root[doc]) - np.log(_unit(mix(word_keys - (within + U(3)) * U(STEP)))))
    g0[rest < np.log(1e-16)] = -np.inf
    found: list[list] = [[] for _ in texts]
    nodes: list[list] = [[] for _ in texts]
    kappa = np.full(nd, -np.inf)
    for d in np.flatnonzero(~single).tolist():
        a, z = int(first[d]), int(first[d + 1])
        # a path: for each word the base sample it comes from, with single words replaced
        found[d].append((paths[0][0][paths[0][1][a] : paths[0][1][z]], float(logw[a:z].sum()), float(root[d])))
        nodes[d].append(dict(g=g0[a:z], path=0, words=logw[a:z], swaps={}, bases=[(0, z - a, 0)], seen={}))
    for r in range(1, k + 1):
        todo = []
        for d in np.flatnonzero(~single).tolist():
            if len(found[d]) < r:
                continue
            node = max(nodes[d], key=lambda x: x["g"].max())
            j = int(np.argmax(node["g"]))
            kappa[d] = node["g"][j]
            if r < k and kappa[d] > -np.inf:
                todo.append((d, node, j))
        if not todo:
            continue
        # words behind the one that differs are drawn afresh
        at = [np.arange(first[d] + j + 1, first[d + 1]) for d, _, j in todo]
        paths.append(drawn(r, np.concatenate(at)))
        for d, node, j in todo:
            found[d].append(_expand(b, paths, node, nodes[d], j, r, int(first[d]), int(first[d + 1]), float(kappa[d]), keys[d]))
    return [
        [(np.zeros(0, np.int32), 0.0, float(root[d]), 0.0)] if single[d] else [(b.to_ids(e), lp, s, _log_inclusion(lp - kappa[d])) for e, lp, s in found[d]]
        for d in range(nd)
    ]


def _word_edges(paths: list, node: dict, i: int, a: int) -> tuple[int, ...]:
    """Edges of word i of a text on a node's path."""
    if i in node["swaps"]:
        return node["swaps"][i]
    r = next(r for s, e, r in node["bases"] if s <= i < e)
    return tuple(paths[r][0][paths[r][1][a + i] : paths[r][1][a + i + 1]].tolist())


def _expand(b: Batch, paths: list, node: dict, nodes: list, j: int, r: int, a: int, z: int, score: float, key: np.uint64) -> tuple[np.ndarray, float, float]:
    """Draws the path that attains the node's maximum, splits the node, and gives the path."""
    count = iter(range(1 << 30))
    seed = int(mix(np.array([int(key) ^ (r << 50)], U))[0])
    unit = (_draw(seed + next(count)) for _ in iter(int, 1))
    w = int(b.word[a + j])
    mine = _word_edges(paths, node, j, a)
    seen = [*node["seen"].get(j, []), mine]
    new = b.other(w, seen, unit)
    lw = float(np.log(b.prob[list(new)]).sum())
    words = np.concatenate([node["words"][:j], [lw], paths[r][2][a + j + 1 : z]])
    bases = [(s, min(e, j), q) for s, e, q in node["bases"] if s < j] + [(j, z - a, r)]
    swaps = {i: x for i, x in node["swaps"].items() if i < j} | {j: new}
    # what stays of the node at word j excludes the new segmentation too
    excluded = [*seen, new]
    gone = sum(map(b.chance, excluded))
    node["g"] = node["g"].copy()
    node["g"][j] = -np.inf
    child = dict(path=r, words=words, swaps=swaps, bases=bases, seen={j: seen})
    tail = words[j:]
    prefix = np.concatenate([[words[:j].sum()], tail[:-1]]).cumsum()
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        rest = np.log1p(-np.minimum(np.exp(tail), 1.0))
        rest[0] = np.log(max(1.0 - gone, 1e-15)) if b.ways(w, len(excluded) + 1)[int(b.base[w])] > len(excluded) else -np.inf
        u = _unit(mix(np.arange(len(tail)).astype(U) + mix(np.array([int(key) ^ (r << 52)], U)) + U(11)))
        phi = prefix + rest
        left = phi - np.log(np.exp(phi - score) - np.log(u))
    left[~(rest > np.log(1e-16))] = -np.inf
    child["g"] = np.full(len(words), -np.inf)
    child["g"][j:] = left
    nodes.append(child)
    parts = []
    for s, e, q in bases:
        i = s
        for t in sorted(x for x in swaps if s <= x < e):
            parts += [paths[q][0][paths[q][1][a + i] : paths[q][1][a + t]], np.array(swaps[t], np.int64)]
            i = t + 1
        parts.append(paths[q][0][paths[q][1][a + i] : paths[q][1][a + e]])
    return np.concatenate(parts), float(words.sum()), score


def _draw(x: int) -> float:
    """A number in (0, 1) for each whole number: mix() and _unit() on a single one."""
    x &= (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
    return (((x ^ (x >> 31)) >> 11) + 0.5) / (1 << 53)


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))"""
    if x > 3.6:
        return 0.0
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))


SCHEMA = "rank int, n_pieces int, log_prob double, perturbed double, log_inclusion double, ids array<int>"


def encode_documents(docs: DataFrame, model: str = MODEL, samples: int = SAMPLES, alpha: float = ALPHA, digest: bool = False, seed: int = 2) -> DataFrame:
    """For each row of docs its columns but text, and one row a segmentation: rank 0 is the model's own encoding, ranks
    1 to `samples` the sampled ones in order of perturbed score (fewer, if there are fewer segmentations). See sample().

    With digest, ids_sha256 (of the ids as little-endian 32-bit numbers) and round_trip (whether decode() gives the
    text back) take the place of ids. The key is a hash of (doc_id, text): equal rows get equal samples, whatever
    their partition. Null and empty texts have one segmentation without pieces at every rank 0 and 1. A text that holds
    the model's own blank mark (U+2581) comes back with a blank instead. Columns of docs named like the results are
    replaced.
    """
    from pyspark.sql import types as T

    new = T._parse_datatype_string(SCHEMA.replace("ids array<int>", "ids_sha256 string, round_trip boolean") if digest else SCHEMA)
    docs = prepared(docs).drop(*new.names)
    own = [c for c in docs.columns if c != "text"]
    key = F.xxhash64(F.lit(seed), *([F.col("doc_id")] if "doc_id" in docs.columns else []), F.col("text")).alias("_key")
    path = model_path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path, alpha)
        for batch in batches:
            names = batch.schema.names
            keys = batch.column(names.index("_key")).to_numpy()
            for a, b, part in column_parts(batch.column(names.index("text")), CHUNK):
                lattice = Batch(m, part)
                whole, drawn = encode(m, part, lattice), sample(m, part, keys[a:b], samples, lattice)
                rows = [(i, r, *x) for i in range(b - a) for r, x in enumerate([(whole[i], None, None, None), *drawn[i]])]
                of, rank, ids, *score = zip(*rows, strict=True)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype("<i4", copy=False)
                take = pa.array(np.array(of) + a)
                arrays = [batch.column(names.index(c)).take(take) for c in own]
                arrays += [pa.array(rank, pa.int32()), pa.array(size.astype(np.int32)), *(pa.array(c, pa.float64()) for c in score)]
                ends = np.concatenate([[0], np.cumsum(size)])
                if digest:
                    data = memoryview(flat.tobytes())
                    arrays.append(pa.array([hashlib.sha256(data[4 * s : 4 * e]).hexdigest() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]))
                    raw = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in part]
                    arrays.append(pa.array(spells(m, flat, size, [raw[i] for i in of])))
                else:
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(arrays, [*own, *new.names])
                lattice = whole = drawn = rows = ids = flat = arrays = part = None
        tidy()

    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + new.fields)
    return docs.select(*own, "text", key).mapInArrow(run, schema)


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_documents() over all documents, ids as digests."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' own encoding and sampled ones, with their ids."""
    return encode_documents(docs)


def decode_rows(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows with text, decoded from their ids (null ids: null)."""
    from pyspark.sql import types as T

    path, rows = model_path(model), prepared(rows).drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path, ALPHA)
        for batch in batches:
            ids = batch.column(batch.schema.names.index("ids")).to_pylist()
            text = pa.array([None if x is None else decode(m, np.array(x, np.int64)) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "text"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))

