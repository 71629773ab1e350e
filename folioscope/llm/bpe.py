"""BPE encoding and decoding by speculation and verification.

1. *Speculate*: every distinct word is cut by greedy longest match in the vocabulary.
2. *Verify*: a sequence is what the merges give exactly when every adjacent pair of
   tokens is what the merges give for the two alone.  That is tested for all new
   pairs at once: both tokens are taken apart, latest merge first, and at each step
   the pair that meets at the boundary must not have a merge that came earlier.
3. *Repair*: only words with a failing pair go through the merges one by one.

Words are cut by the byte-level pattern; added tokens in a text are their own ids.
Words are looked up by hash and compared by their letters: a word whose hash is that
of another one is encoded by itself.
Null and empty texts have no ids and decode to ''.  Texts are encoded whole, of any
length; repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioscope.llm.scratch import bound_batches, unused
from folioscope.llm.words import mix

#: Fixed value: the byte-level pre-tokeniser's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 2_000_000
_NEVER = np.int64(1 << 40)
#: Words of more bytes are merged with a heap, one by one.
_LONG = 64
_LETTER, _DIGIT, _OTHER, _SPACE = range(4)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Letter by which a byte-level vocabulary writes each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str) -> dict:
    """Vocabulary and merges of a tokenizers file, as plain values that can be sent to executors."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], _byte_letters()
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocab = {bytes(letters[c] for c in s): i for s, i in model["vocab"].items()}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = model["vocab"]
    return {"vocab": vocab, "merges": [(ids[a], ids[b], ids[a + b]) for a, b in pairs], "added": added}


def _in_order(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces as one, by word; within a word as they were found."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, token = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(word, kind="stable")
    return word[order], token[order]


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Class of every code point, as PATTERN sees it."""
    if not _kinds:
        out = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"), (_SPACE, r"\s")):
            out[np.fromiter(map(ord, regex.findall(pattern, every)), np.int64)] = kind
        _kinds.append(out)
    return _kinds[0]


def word_starts(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First code points of the words that PATTERN cuts, for texts laid end to end at ``bounds``.

    Words are the runs of one class, but: the last of some white space before a run
    stands alone, or joins the run if it is a blank; and an apostrophe that no blank
    precedes takes a short ending with it.
    """
    if not len(cp):
        return np.zeros(0, np.int64)
    kind = kinds()[cp]
    edge = np.zeros(len(cp) + 1, bool)
    edge[bounds] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start & (kind != _SPACE))  # a run that has white space before it takes its last blank
    run = run[(run > 0) & ~edge[run]]
    run = run[kind[run - 1] == _SPACE]
    start[run - 1] = True
    start[run[cp[run - 1] == 0x20]] = False
    mark = np.flatnonzero((cp == 0x27) & start)  # at the start of a word, so that no blank joined it
    mark = mark[mark + 1 < len(cp)]
    mark = mark[~edge[mark + 1]]
    one = cp[mark + 1]
    two = np.where((mark + 2 < len(cp)) & ~edge[np.minimum(mark + 2, len(cp))], cp[np.minimum(mark + 2, len(cp) - 1)], 0)
    size = np.select([np.isin(one, [ord(c) for c in "stmd"]), ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")), (one == ord("l")) & (two == ord("l"))], [1, 2, 2], 0)
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    after = mark + 1 + size
    start[after[after < len(cp)]] = True
    return np.flatnonzero(start)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of code points."""
    n = 1 << max(20, int(len(cp) + 1).bit_length())
    if n not in _powers:
        _powers.clear()
        up, down = np.full(n, _P, np.uint64), np.full(n, _PINV, np.uint64)
        up[0] = down[0] = 1
        _powers[n] = np.cumprod(up), np.cumprod(down)
    up, down = _powers[n]
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Encoder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: dict):
        self.vocab = {b.decode("latin-1"): i for b, i in spec["vocab"].items()}
        self.added = spec["added"]
        size = 1 + max([*spec["vocab"].values(), *self.added.values()])
        self.bytes = [b""] * size
        for b, i in [*spec["vocab"].items(), *((s.encode(), i) for s, i in self.added.items())]:
            self.bytes[i] = b
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b, c) in enumerate(spec["merges"]):
            self.ranks.setdefault((a, b), (k, c))
            if self.rank[c] < 0:
                self.rank[c], self.left[c], self.right[c] = k, a, b
        keys = np.array([a * size + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        self.key_ranks = np.array([k for k, _ in self.ranks.values()], np.int64)[order]
        self.key_ids = np.array([c for _, c in self.ranks.values()], np.int64)[order]
        self.byte_ids = np.array([self.vocab.get(chr(b), -1) for b in range(256)], np.int64)
        whole = self.rank < 0
        merged = np.flatnonzero(self.rank >= 0)
        fits = np.zeros(size, bool)
        fits[merged] = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        for t in merged[np.argsort(self.rank[merged])]:
            whole[t] = fits[t] and whole[self.left[t]] and whole[self.right[t]]
        self.speculated = {s: i for s, i in self.vocab.items() if whole[i]}
        nodes: dict[str, int] = {"": 0}
        for s in self.speculated:
            for k in range(1, len(s) + 1):
                nodes.setdefault(s[:k], len(nodes))
        steps = np.array([nodes[s[:-1]] * 256 + ord(s[-1]) for s in nodes if s], np.int64)
        order = np.argsort(steps)
        self.steps, self.step_to = steps[order], np.array([nodes[s] for s in nodes if s], np.int64)[order]
        self.token_at = np.full(len(nodes), -1, np.int64)
        for s, i in self.speculated.items():
            self.token_at[nodes[s]] = i
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known, self.known_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.forget()
        self.words = self.failed = 0

    def forget(self) -> None:
        self.word_keys, self.word_codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.lens, self.flat, self.used, self.flat_used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0, 0
        # the letters of each word, to compare
        self.spelt_from, self.spelt_len, self.spelt, self.spelt_used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges leave tokens a and b side by side, for each pair; limit: only merges before it count."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NEVER) if limit is None else limit.astype(np.int64)
        ok, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossing = (self.keys[at] == key) & (self.key_ranks[at] < limit)
            ok[open_[crossing]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossing & ((ra >= 0) | (rb >= 0))
            open_, a, b, ra, rb = open_[go], a[go], b[go], ra[go], rb[go]
            later = ra > rb  # a was made after b: before that, its right part met b
            limit = np.where(later, ra, rb + 1)  # at equal rank the merge further left goes first
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return ok

    def greedy(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of the longest matches, all words walking the vocabulary's trie a byte a round."""
        text = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
        end = np.cumsum([len(w) for w in words])
        word, at = np.arange(len(words)), end - [len(w) for w in words]
        node, token, upto = np.zeros_like(at), np.full_like(at, -1), at.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            key = node * 256 + np.where(at < end, text[np.minimum(at, len(text) - 1)], 0)
            k = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            go = (self.steps[k] == key) & (at < end)
            node = np.where(go, self.step_to[k], 0)
            at = at + go
            hit = go & (self.token_at[node] >= 0)
            token, upto = np.where(hit, self.token_at[node], token), np.where(hit, at, upto)
            stop = np.flatnonzero(~go)
            if len(stop):
                if (token[stop] < 0).any():
                    raise ValueError("the vocabulary lacks a byte")
                found.append((word[stop], token[stop]))
                at[stop], token[stop] = upto[stop], -1
                keep = go | (at < end)
                if not keep.all():
                    word, at, end, node, token, upto = word[keep], at[keep], end[keep], node[keep], token[keep], upto[keep]
        return _in_order(found)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) by the merges themselves: lowest rank first, leftmost first; one merge of every word a round."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k, w in enumerate(words):
            if len(w) > _LONG:
                ids = np.array(self._merge_long([self.vocab[c] for c in w]), np.int64)
                found.append((np.full(len(ids), k), ids))
        short = [k for k, w in enumerate(words) if len(w) <= _LONG]
        ids = self.byte_ids[np.frombuffer("".join(words[k] for k in short).encode("latin-1"), np.uint8)]
        word = np.repeat(np.array(short, np.int64), [len(words[k]) for k in short])
        rank, new = self._pair_ranks(ids, word, np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lens = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            if (done := least == _NEVER).any():
                keep = np.repeat(~done, lens)
                found.append((word[~keep], ids[~keep]))
                ids, word, rank, new, lens, least = ids[keep], word[keep], rank[keep], new[keep], lens[~done], least[~done]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, lens))
            at = hits[np.append(True, word[hits[1:]] != word[hits[:-1]])]
            ids[at] = new[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one token before each of them is gone already
            ids, word, rank, new = ids[keep], word[keep], rank[keep], new[keep]
            again = np.concatenate([at, at[at > 0] - 1])
            rank[again], new[again] = self._pair_ranks(ids, word, again)
        return _in_order(found)

    def _pair_ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merge of the tokens at ``at`` with their followers in the same word."""
        after = np.minimum(at + 1, len(ids) - 1)
        key = ids[at] * self.size + ids[after]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[k] == key) & (word[at] == word[after]) & (after > at)
        return np.where(found, self.key_ranks[k], _NEVER), np.where(found, self.key_ids[k], 0)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words that are very long."""
        import heapq

        after, before, alive = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)], [True] * len(ids)
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and (j := after[k]) >= 0 and (r := self.ranks.get((ids[k], ids[j]))) is not None:
                heapq.heappush(heap, (r[0], k, r[1], ids[k], ids[j]))

        for k in range(len(ids) - 1):
            offer(k)
        while heap:
            _, k, new, x, y = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j < 0 or ids[k] != x or ids[j] != y:
                continue
            ids[k], alive[j] = new, False
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            offer(before[k])
            offer(k)
        return [t for t, a in zip(ids, alive, strict=True) if a]

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of distinct words, by word: speculated, verified, repaired."""
        plain = [w.encode().decode("latin-1") for w in words]
        word, flat = self.greedy(plain)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs = flat[inner] * self.size + flat[inner + 1]
        distinct, back = np.unique(pairs, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        seen = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        ok = np.zeros(len(distinct), bool)
        if len(self.known):
            ok[seen] = self.known_ok[at[seen]]
        new = distinct[~seen]
        ok[~seen] = fresh = self.compatible(new // self.size, new % self.size)
        if len(self.known) > 4 * REMEMBERED:
            self.known, self.known_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        known, known_ok = np.concatenate([self.known, new]), np.concatenate([self.known_ok, fresh])
        order = np.argsort(known, kind="stable")
        self.known, self.known_ok = known[order], known_ok[order]
        bad = np.unique(word[inner[~ok[back]]])
        self.words, self.failed = self.words + len(words), self.failed + len(bad)
        if len(bad):
            wrong = np.zeros(len(words), bool)
            wrong[bad] = True
            mended, ids = self.merge([plain[k] for k in bad.tolist()])
            keep = ~wrong[word]
            word, flat = _in_order([(word[keep], flat[keep]), (bad[mended], ids)])
        return word, flat

    def learn(self, words: list[str]) -> None:
        """Ids and letters of distinct new words into the memory."""
        word, flat = self.cut(words)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        lens = np.bincount(word, minlength=len(words))
        while self.used + len(words) > len(self.starts):
            self.starts, self.lens, self.spelt_from, self.spelt_len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.spelt_from, self.spelt_len))
        while self.flat_used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.spelt_used + len(letters) > len(self.spelt):
            self.spelt = np.concatenate([self.spelt, np.zeros_like(self.spelt)])
        to = slice(self.used, self.used + len(words))
        self.starts[to], self.lens[to] = self.flat_used + np.cumsum(lens) - lens, lens
        self.flat[self.flat_used : self.flat_used + len(flat)] = flat
        self.spelt_from[to], self.spelt_len[to] = self.spelt_used + np.cumsum(sizes) - sizes, sizes
        self.spelt[self.spelt_used : self.spelt_used + len(letters)] = letters
        self.used, self.flat_used, self.spelt_used = self.used + len(words), self.flat_used + len(flat), self.spelt_used + len(letters)

    def _misread(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Words that are not, letter by letter, the remembered ones of their codes."""
        size = ends - starts
        wrong = size != self.spelt_len[code]
        at = np.repeat(np.where(wrong, 0, self.spelt_from[code]) - starts, size) + np.arange(len(cp))
        differ = np.flatnonzero(self.spelt[np.where(np.repeat(wrong, size), 0, at) if wrong.any() else at] != cp)
        if len(differ):
            wrong[np.searchsorted(starts, differ, "right") - 1] = True
        return np.flatnonzero(wrong)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.split is not None and any(s in t for t in texts for s in self.added):
            parts = [self.split.split(t) for t in texts]
            plain = iter(self._encode([p for x in parts for p in x if p not in self.added]))
            return [np.concatenate([np.array([self.added[p]], np.uint32) if p in self.added else next(plain) for p in x]) for x in parts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        starts = word_starts(cp, bounds)
        ends = np.append(starts[1:], len(cp))
        keys = _hashes(cp, starts, ends)
        if self.used > REMEMBERED:
            self.forget()
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.word_keys, distinct), max(0, len(self.word_keys) - 1))
        seen = self.word_keys[at] == distinct if len(self.word_keys) else np.zeros(len(distinct), bool)
        if not seen.all():
            new = first[~seen]
            chars = "".join(texts)
            self.learn([chars[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            to = np.searchsorted(self.word_keys, distinct[~seen])
            codes = np.arange(self.used - len(new), self.used)
            self.word_keys, self.word_codes = np.insert(self.word_keys, to, distinct[~seen]), np.insert(self.word_codes, to, codes)
            at = np.searchsorted(self.word_keys, distinct)
        code = self.word_codes[at][back] if len(distinct) else np.zeros(0, np.int64)
        begin, lens, flat = self.starts[code], self.lens[code], self.flat
        wrong = self._misread(cp, starts, ends, code)
        if len(wrong):
            chars = "".join(texts)
            word, mended = self.cut([chars[a:b] for a, b in zip(starts[wrong].tolist(), ends[wrong].tolist(), strict=True)])
            lens[wrong] = own = np.bincount(word, minlength=len(wrong))
            begin[wrong] = len(flat) + np.cumsum(own) - own
            flat = np.concatenate([flat, mended.astype(np.uint32)])
        total = np.concatenate([[0], np.cumsum(lens)])
        ids = flat[np.repeat(begin - total[:-1], lens) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


_encoders: dict[int, Encoder] = {}


def _encoder(key: int, spec: dict) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def _groups(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, digests_only: bool = False) -> DataFrame:
    """``docs`` without its text, with the ids and the decoded text, or with their digests.

    Adds ``n_tokens long`` and either ``ids array<int>``, ``decoded string`` or
    ``ids_sha256 string``, ``decoded_sha256 string``; the names get longer where ``docs``
    has such columns in any letter case.  A map over the rows: no shuffle.
    The vocabulary is read on the driver (its size is that of the file) and sent along.
    """
    bound_batches(docs.sparkSession)
    path = path or default_path()
    spec = docs.sparkSession.sparkContext.broadcast(load(path))
    key = hash(path)
    own = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests_only else ["n_tokens", "ids", "decoded"]
    kept = [c for c in docs.columns if c != text_col]
    own = [unused(c, kept) for c in own]
    held = unused("text__", kept)
    rows = docs.select(*[docs[c] for c in kept], docs[text_col].alias(held))
    kinds = ", ".join(f"`{c}` {t}" for c, t in zip(own, ("long", "string" if digests_only else "array<int>", "string"), strict=True))
    from pyspark.sql.types import StructType

    schema = StructType(rows.drop(held).schema.fields + StructType.fromDDL(kinds).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(key, spec.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(held)).fill_null("").to_pylist()
            counts, first, second = [], [], []
            for group in _groups(texts):
                for ids in coder.encode_batch(group):
                    text = coder.decode(ids)
                    counts.append(len(ids))
                    first.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() if digests_only else ids.astype(np.int32))
                    second.append(hashlib.sha256(text.encode()).hexdigest() if digests_only else text)
            rest = [batch.column(k) for k, f in enumerate(batch.schema) if f.name != held]
            new = [pa.array(counts, pa.int64()), pa.array(first, pa.string() if digests_only else pa.list_(pa.int32())), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(rest + new, names=[*kept, *own])

    return rows.mapInArrow(run, schema)
