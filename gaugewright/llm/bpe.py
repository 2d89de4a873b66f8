"""Byte-pair encoding by speculation and verification, and decoding.

A text is cut at white space; each distinct word is encoded once per task. For a word, greedy longest match proposes
tokens. A proposal is the true encoding if and only if each of its tokens encodes to itself and each adjacent pair,
encoded alone, stays that pair: the first merge across a boundary of the whole word would also be the first
across it in the pair. Both tests run on arrays over all words of a batch. Words that fail are merged exactly.
"""

from __future__ import annotations

import gc
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Bytes that a Python worker's memory of words holds, from task to task; it is emptied when it holds more.
CACHE_BYTES = 144 << 20
#: What an entry takes besides its bytes, about; and the longest word, in bytes, that is remembered.
ENTRY_BYTES = 160
LONGEST_KEPT = 256
#: Words of more letters are merged one by one, with a heap.
LONG_WORD = 400
#: Marks that are a piece of their own after a word of letters.
STOPS = b".,;:!?"
#: Words whose ids are gathered at once.
GATHERED = 1_000_000
#: From here on, the class of a letter depends on the Unicode version.
RARE = "\u0250"
#: Characters that a task encodes at once.
BATCH_CHARS = 8_000_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merge tables of a word-end BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"] and not t["normalized"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace("\\s", "\\p{White_Space}"))
        size = max(max(self.ids.values()), *self.special.values(), 0) + 1
        names = [""] * size
        for name, i in (self.ids | self.special).items():
            names[i] = name
        self.names = pa.array(names, pa.string())
        self.letters = dict(enumerate(byte_letters()))
        #: Every beginning of a token: its id, or -1 if it is none itself. A space stands for the end of the word.
        self.begin: dict[str, int] = {}
        for name, i in self.ids.items():
            name = name.removesuffix(self.end) + " " if self.end and name.endswith(self.end) else name
            for j in range(1, len(name)):
                self.begin.setdefault(name[:j], -1)
            self.begin[name] = i
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pairs = np.array([(self.ids[a], self.ids[b]) for a, b in merges], np.int64)
        made = np.array([self.ids[a + b] for a, b in merges], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make the same token: the pair test does not hold for such a vocabulary")
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; -1: a single letter
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), pairs[:, 0], pairs[:, 1]
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order
        self.made = made
        alone = self.compatible(pairs[:, 0], pairs[:, 1], np.arange(len(made)))
        whole = np.ones(size, bool)
        for ok, token, (a, b) in zip(alone.tolist(), made.tolist(), pairs.tolist(), strict=True):
            whole[token] = ok and whole[a] and whole[b]
        self.whole = whole  # whether a token encodes to itself
        self.known = Memory()  # the ids of pieces
        self.rank_of = dict(zip(keys.tolist(), range(len(made)), strict=True))

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair, whether no merge crosses its boundary (with ``before``: none of a lower rank than that).

        Going back in time from the finished pair, ``a`` steps down its right edge and ``b`` its left edge, always
        the one that was made later. A merge of both crosses if it comes before either is taken up by its own
        next merge; at the same rank the leftmost goes first."""
        none = np.iinfo(np.int64).max
        a, b = a.copy(), b.copy()
        until_a = np.full(len(a), none) if before is None else before.copy()
        until_b = np.full(len(a), none) if before is None else before - 1
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at = np.searchsorted(self.keys, key := x << 32 | y)
            at[at == len(self.keys)] = 0
            rank = np.where(self.keys[at] == key, self.key_rank[at], none)
            crossed = (rank < until_a[live]) & (rank <= until_b[live]) & (rank < none)
            ok[live[crossed]] = False
            down_a = self.rank[x] > self.rank[y]
            ended = (self.rank[x] < 0) & (self.rank[y] < 0)
            i, j = live[down_a], live[~down_a & ~ended]
            until_a[i], a[i] = self.rank[a[i]], self.right[a[i]]
            until_b[j], b[j] = self.rank[b[j]], self.left[b[j]]
            live = live[~crossed & ~ended]
        return ok

    def propose(self, word: str) -> list[int]:
        """Greedy longest match, from the left; only the last token holds the end of the word."""
        get, out, i, n = self.begin.get, [], 0, len(word)
        word += " "
        while i < n:
            token = -1
            for j in range(i + 1, n + 2):
                t = get(word[i:j])
                if t is None:
                    break
                if t >= 0 and j != n:
                    token, at = t, j
            if token < 0:
                raise ValueError(f"no token for {word[i:]!r}")
            out.append(token)
            i = at
        return out

    def merge_exactly(self, words: list[str]) -> list[bytes]:
        """Merge in each word the lowest rank first, the leftmost of equals, in all words at once."""
        none = np.iinfo(np.int64).max >> 32
        parts = [[*map(self.ids.__getitem__, w[:-1]), self.ids[w[-1] + self.end]] for w in words]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        tokens = np.fromiter((t for p in parts for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        out = [b""] * len(words)

        def ranks(at: np.ndarray) -> np.ndarray:
            after = np.minimum(at + 1, len(tokens) - 1)
            i = np.searchsorted(self.keys, key := tokens[at] << 32 | tokens[after])
            i[i == len(self.keys)] = 0
            return np.where((self.keys[i] == key) & (owner[at] == owner[after]) & (after > at), self.key_rank[i], none)

        rank = ranks(np.arange(len(tokens)))
        while len(tokens):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(tokens)), starts)
            done = best >> 32 == none
            if done.any():
                ends = np.append(starts[1:], len(tokens))
                raw = tokens.astype("<u4").tobytes()
                for i, begin, end in zip(owner[starts[done]].tolist(), (4 * starts[done]).tolist(), (4 * ends[done]).tolist(), strict=True):
                    out[i] = raw[begin:end]
                stay = np.repeat(~done, ends - starts)
            else:
                stay = np.ones(len(tokens), bool)
            at = best[~done] & 0xFFFFFFFF
            tokens[at] = self.made[rank[at]]
            stay[at + 1] = False
            to = np.cumsum(stay) - 1
            tokens, owner, rank, at = tokens[stay], owner[stay], rank[stay], to[at]
            if len(at):
                near = np.concatenate([at, at[at > 0] - 1])
                rank[near] = ranks(near)
        return out

    def merge_long(self, word: str) -> bytes:
        """The same merges in one long word: neighbours are linked, and a heap holds the pairs by rank, then place."""
        tokens = [*map(self.ids.__getitem__, word[:-1]), self.ids[word[-1] + self.end]]
        n, rank_of, made = len(tokens), self.rank_of.get, self.made.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(tokens[i] << 32 | tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if tokens[i] < 0 or j >= n or rank_of(tokens[i] << 32 | tokens[j]) != rank:
                continue  # one of the two has been merged since
            tokens[i], tokens[j] = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(tokens[i] << 32 | tokens[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(tokens[h] << 32 | tokens[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        return np.array([t for t in tokens if t >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Speculate on all pieces, verify all at once, merge the failing ones. Ids as little-endian unsigned 32-bit numbers."""
        proposed = list(map(self.propose, pieces))
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        ends = np.cumsum(counts)
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(ends[-1]))
        owner = np.repeat(np.arange(len(proposed)), counts)
        bad = np.zeros(len(proposed), bool)
        bad[owner[~self.whole[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        fits = self.compatible(keys >> 32, keys & 0xFFFFFFFF)
        bad[owner[inner[~fits[back]]]] = True
        raw, bounds = flat.astype("<u4").tobytes(), (4 * ends).tolist()
        out = [raw[i:j] for i, j in zip([0, *bounds], bounds, strict=False)]
        failed = np.flatnonzero(bad).tolist()
        short = [i for i in failed if len(pieces[i]) <= LONG_WORD]
        for i, ids in zip(short, self.merge_exactly([pieces[i] for i in short]), strict=True):
            out[i] = ids
        for i in failed:
            if len(pieces[i]) > LONG_WORD:
                out[i] = self.merge_long(pieces[i])
        return out

    def split(self, word: str) -> list[str | int]:
        """What the normaliser and the pre-tokeniser make of a word: byte-letter pieces, and special ids."""
        out: list[str | int] = []
        for part in self.special_re.split(word) if "<|" in word else (word,):
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii() and max(part) >= RARE:
                # letters whose class depends on the Unicode version: the library's own normaliser and pre-tokeniser decide
                out += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
                continue
            part = unicodedata.normalize("NFC", part).lower()
            pieces = (part,) if part.isalpha() else self.pieces.findall(part)
            out += [p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        return out

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of each word as little-endian unsigned 32-bit numbers."""
        whole: dict[bytes, str] = {}  # words that are one piece
        ended: dict[bytes, str] = {}  # words that are one piece and a mark after it
        mixed: dict[bytes, list[str | int]] = {}
        for w in words:
            if w.isalpha():  # ASCII letters only
                whole[w] = w.decode().lower()
                continue
            stopped = w[-1] in STOPS
            core = w[:-1] if stopped else w
            if core.isalpha():
                ended[w] = core.decode().lower()
                continue
            if not core.isascii() and (text := core.decode()).isalpha() and max(text) < RARE:
                text = unicodedata.normalize("NFC", text).lower()
                if text.isalpha():
                    (ended if stopped else whole)[w] = text.encode().decode("latin-1").translate(self.letters)
                    continue
            mixed[w] = self.split(w.decode())
        self.known.room()
        known = self.known
        pieces = {*whole.values(), *ended.values(), *map(chr, STOPS)}
        pieces.update(p for ps in mixed.values() for p in ps if isinstance(p, str))
        new = list(pieces - known.keys())
        found = dict(zip(new, self.encode_pieces(new), strict=True)) if new else {}
        known |= found
        out = dict(zip(whole, map(known.__getitem__, whole.values()), strict=True))
        marks = {m: known[chr(m)] for m in STOPS}
        out |= {w: known[p] + marks[w[-1]] for w, p in ended.items()}
        for w, ps in mixed.items():
            out[w] = b"".join([known[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in ps])
        known.settle(found)
        return out


class Memory(dict):
    """Words and their ids. What a batch adds stays for the batch; then ``settle`` drops its long words and counts the others.
    ``room`` starts anew where CACHE_BYTES are reached."""

    def __init__(self, most: int = CACHE_BYTES):
        super().__init__()
        self.most, self.held = most, 0

    def room(self) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0

    def settle(self, found: dict) -> None:
        long = [w for w in found if len(w) > LONGEST_KEPT] if max(map(len, found), default=0) > LONGEST_KEPT else ()
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)
        for w in long:
            self.held -= len(w) + len(self.pop(w)) + ENTRY_BYTES


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts in batches with a bounded memory of words, which are cut at ASCII white space (other white space stays inside, for
    the pre-tokeniser). ``encode_words`` maps new words to the bytes of their ids."""

    @staticmethod
    @lru_cache(maxsize=1)
    def of(path: str) -> Encoder:
        """The worker's encoder for a vocabulary."""
        return Encoder(vocabulary(path).encode_words)

    def __init__(self, encode_words, cache_bytes: int = CACHE_BYTES):
        self.encode_words, self.known = encode_words, Memory(cache_bytes)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. The batch's different words are numbered in Arrow, looked up once each, and gathered by number."""
        lists = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        numbered = lists.flatten().dictionary_encode()
        words = numbered.dictionary.cast(pa.large_binary()).to_pylist()
        self.known.room()
        known, found = self.known, {}
        new = {w for w in words if w} - known.keys()
        if new:
            gc.disable()  # many small lists, none in a cycle
            try:
                found = self.encode_words(new)
            finally:
                gc.enable()
            known |= found
        encoded = [known[w] if w else b"" for w in words]  # text at the edge of white space is an empty word
        known.settle(found)
        ids = np.frombuffer(b"".join(encoded), "<u4")
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        starts = np.cumsum(counts) - counts
        codes = numbered.indices.to_numpy()
        parts = []
        for at in range(0, len(codes), GATHERED):
            c = codes[at : at + GATHERED]
            n = counts[c]
            parts.append(ids[np.repeat(starts[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes())
        raw = b"".join(parts)
        ends = np.concatenate([[0], np.cumsum(counts[codes])])[np.asarray(lists.offsets) - lists.offsets[0].as_py()] * 4
        ends = ends.tolist()
        return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def chunks(texts: list[str | None], most: int = BATCH_CHARS) -> Iterator[slice]:
    """Ranges of ``texts`` of about ``most`` characters at most, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def text_parts(column: pa.Array, most: int = BATCH_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a column in parts as ``chunks`` cuts them, each with its first row's number; only a part at a time becomes Python's."""
    start = size = 0
    for i, n in enumerate(pc.utf8_length(column).fill_null(0).to_pylist()):
        if size and size + n > most:
            yield start, column[start:i].to_pylist()
            start, size = i, 0
        size += n
    if start < len(column):
        yield start, column[start:].to_pylist()


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(b) // 4 for b in encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)))


def decode_lists(ids: pa.ListArray, names: pa.StringArray) -> pa.Array:
    """The vocabulary's decode: the tokens' strings joined by single spaces."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, names.take(ids.values)), " ")


def bpe_encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of int) and ``decoded`` (string): the encoding of every whole text and the decoding of those ids.

    A null or empty text, or one of white space only, has no ids and decodes to the empty text. Repeated rows and null
    keys pass through row by row; other columns, whatever their names, are not read. An empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = Encoder.of(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in chunks(texts):
                ids = id_lists(encoder(texts[part]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], ids, decode_lists(ids, vocab.names)], ["key", "ids", "decoded"])

    made = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded string")
    return made.withColumnRenamed("key", key)


def bpe_decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded``; null ids decode to the empty text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = vocabulary(path).names
        for batch in batches:
            lists = id_lists([np.array(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), decode_lists(lists, names)], ["key", "decoded"])

    made = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"key {kind}, decoded string")
    return made.withColumnRenamed("key", key)
