"""BPE encoding and decoding as streaming transducers with a bounded look-ahead.

Encoding reads a text from left to right. For every prefix of a piece exactly one token ends it in
the encoding of that prefix, and it is found from the tokens before it: a token may follow another
if the merges leave just this pair standing. The end of the text can only still change what lies
inside the last ``lookahead`` bytes (the longest token of the merge list, less one); a token is
emitted as soon as the encodings of all prefixes that end there share it. So memory does not grow
with the text. Decoding is a machine over bytes: it holds back an unfinished character only.

Null is the empty text; an empty text has no tokens; rows are independent of each other, so ties and
repeated rows get equal results; other columns stay as they are, and an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import text_udf
from .registry import query, table

# fixed values of the format: the split into pieces, and the letters that stand for bytes
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

CACHED_WORDS = 160_000          # pieces kept per worker, twice; the older half goes
CACHED_LETTERS = 64             # longer pieces are never kept
HEAD = 5                        # first bytes of a piece that many pieces share
STEP = 1 << 16                  # characters split into pieces at a time
SAFE_CUT = re.compile(r"[^\s] (?=[^\s])")


def byte_letters() -> dict[str, int]:
    """The letter of each byte: printed bytes stand for themselves, the others follow from U+0100 on."""
    rest = [b for b in range(256) if b not in set(PRINTED)]
    return {**{chr(b): b for b in PRINTED}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Words(dict):
    """Packed ids by piece, of a bounded number of pieces: those of late, and behind them those of before."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.before = transducer, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = b"".join(map(self.transducer.packed.__getitem__, self.transducer.stream(word.encode())))
        if len(word) <= CACHED_LETTERS:
            if len(self) >= CACHED_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Reader:
    """The bytes of every id of a tokenizer file, and the machine that turns them into text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.bytes_of.update({t["id"]: t["content"].encode() for t in spec["added_tokens"]})

    def decode(self, ids: bytes) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        numbers = np.frombuffer(ids, "<u4")
        out = [machine.decode(b"".join(map(self.bytes_of.__getitem__, numbers[k:k + STEP].tolist())))
               for k in range(0, len(numbers), STEP)]
        return "".join([*out, machine.decode(b"", True)])


class Transducer:
    """A byte-level merge list read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in self.vocab.items()}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.size = {i: len(t) for i, t in self.bytes_of.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.order = {self.vocab[bytes([b])]: b for b in range(256)}           # when a token comes into being
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            new = self.vocab[left + right]
            pair = self.vocab[left], self.vocab[right]
            self.merged[pair] = 256 + n
            if new not in self.order:
                self.order[new] = 256 + n
                self.parts[new] = pair
        self.lookahead = max(map(len, self.vocab)) - 1
        self._machine()
        self.follows: dict[int, bool] = {}
        self.pieces = regex.compile(PIECES)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.heads: dict[bytes, tuple[int, tuple]] = {}                        # where the first bytes of a piece lead to
        self.words = Words(self)

    def _machine(self) -> None:
        """A state for each beginning of a token: the longest one that the bytes so far end with. ``endings`` has all tokens that they end with, the longest first."""
        self.edges: dict[int, int] = {}                  # state << 8 | byte: the beginning longer by this byte
        own: list[int | None] = [None]
        for raw, i in self.vocab.items():
            state = 0
            for b in raw:
                key = state << 8 | b
                state = self.edges.get(key)
                if state is None:
                    state = self.edges[key] = len(own)
                    own.append(None)
            own[state] = i
        self.steps: dict[int, int] = {}
        self.shorter, self.endings = [0] * len(own), [()] * len(own)       # shorter: the next longest beginning that a state ends with
        level = [0]
        longer: dict[int, list[int]] = {}
        for key in self.edges:
            longer.setdefault(key >> 8, []).append(key)
        while level:                                     # by length, so that shorter ones are known
            after = []
            for state in level:
                for key in longer.get(state, ()):
                    new, b = self.edges[key], key & 255
                    if state:
                        self.shorter[new] = self._step(self.shorter[state] << 8 | b)
                    rest = self.endings[self.shorter[new]]
                    i = own[new]
                    self.endings[new] = rest if i is None else ((i, self.size[i]), *rest)
                    after.append(new)
            level = after

    def _step(self, key: int) -> int:
        """The state after one more byte."""
        state, b = key >> 8, key & 255
        while True:
            new = self.edges.get(state << 8 | b)
            if new is not None or state == 0:
                break
            state = self.shorter[state]
        if len(self.steps) >= 1 << 18:
            self.steps.clear()
        self.steps[key] = new = new or 0
        return new

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens ``a b`` as they are.

        Undo merges on both sides of the seam, the latest first: some merge across the seam that comes
        before the one undone would have taken place instead.
        """
        known = self.follows.get(a << 20 | b)
        if known is not None:
            return known
        x, y, limit = a, b, 1 << 60
        order, parts = self.order, self.parts
        while True:
            if self.merged.get((x, y), limit) < limit:
                answer = False
                break
            px, py = parts.get(x), parts.get(y)
            if px is None and py is None:
                answer = True
                break
            # the right side's merge of equal age would have waited for the left one
            if py is None or (px is not None and order[x] > order[y]):
                limit, x = order[x], px[1]
            else:
                limit, y = order[y] + 1, py[0]
        if len(self.follows) >= 1 << 18:
            self.follows.clear()
        self.follows[a << 20 | b] = answer
        return answer

    def stream(self, raw: bytes) -> Iterator[int]:
        """The tokens of one piece, each as soon as nothing that follows can change it."""
        longest = self.lookahead + 1
        done, before, at = 0, None, 0
        known = self.heads.get(raw[:HEAD])
        if known is not None:
            at = HEAD
        state, ends = (known[0], [*known[1]]) if known else (0, [None])         # ends[k]: last token of the encoding of the first done + k bytes
        steps, endings, follows, follow = self.steps.get, self.endings, self.follows.get, self.may_follow
        while at < len(raw):
            some = raw[at:HEAD if at < HEAD else max(at + longest, done + 4 * longest)]
            for i, b in enumerate(some, at - done + 1):
                key = state << 8 | b
                state = steps(key)
                if state is None:
                    state = self._step(key)
                for token, n in endings[state]:              # the longest is the likeliest; exactly one can stand
                    if n < i:
                        last = ends[i - n]
                        if last is None:
                            continue
                    elif n > i:                              # reaches into what is settled
                        continue
                    elif done:
                        last = before
                    else:
                        break
                    stands = follows(last << 20 | token)
                    if stands or (stands is None and follow(last, token)):
                        break
                else:
                    token = None                             # no encoding of the whole stops here
                ends.append(token)
            at += len(some)
            if at == HEAD:
                if len(self.heads) >= 1 << 16:
                    self.heads.clear()
                self.heads[some] = state, tuple(ends)
            elif at < len(raw):
                cut = self._settled(ends, at - done, longest)
                if cut:
                    tokens = self._back(ends, cut)
                    yield from tokens
                    done, before, ends = done + cut, tokens[-1], [None, *ends[cut + 1:]]
        yield from self._back(ends, at - done)

    def _back(self, ends: list, at: int) -> list[int]:
        tokens = []
        while at > 0:
            tokens.append(ends[at])
            at -= self.size[ends[at]]
        return tokens[::-1]

    def _settled(self, ends: list, at: int, longest: int) -> int:
        """The last cut that the encodings of all prefixes still in reach have in common."""
        common: set[int] | None = None
        for p in range(max(1, at - longest + 1), at + 1):
            if ends[p] is None:
                continue
            cuts, q = set(), p
            while q > 0:
                cuts.add(q)
                q -= self.size[ends[q]]
            common = cuts if common is None else common & cuts
            if not common:
                return 0
        return max(common or {0})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return b"".join(self._plain(text))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out.extend(self._plain(text[at:m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        out.extend(self._plain(text[at:]))
        return b"".join(out)

    def _plain(self, text: str) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > STEP:                 # a lone space between two words always starts a piece
                m = SAFE_CUT.search(text, at + STEP)
                end = m.end() - 1 if m else end
            yield b"".join(map(self.words.__getitem__, self.pieces.findall(text[at:end] if at or end < len(text) else text)))
            at = end

@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


@lru_cache(maxsize=2)
def reader(path: str) -> Reader:
    return Reader(path)


def encode(text: Column, path: str) -> Column:
    """The ids of a text, packed as little-endian unsigned 32-bit integers; null counts as empty."""
    def make():
        t = transducer(path)
        return lambda texts: [t.encode(x or "") for x in texts]
    return text_udf("binary", pa.binary(), make)(text)


def decode(ids: Column, path: str) -> Column:
    """The text of packed ids; bytes that are no text become U+FFFD."""
    def make():
        r = reader(path)
        return lambda packed: [r.decode(x or b"") for x in packed]
    return text_udf("string", pa.string(), make)(ids)


def round_trip(text: Column, path: str) -> Column:
    """Ids and what they decode to, in one worker."""
    def make():
        t, r = transducer(path), reader(path)
        return lambda texts: [{"ids": i, "decoded": r.decode(i)} for x in texts for i in [t.encode(x or "")]]
    return text_udf("struct<ids:binary,decoded:string>", pa.struct([("ids", pa.binary()), ("decoded", pa.string())]), make)(text)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the packed ids of each text and, if asked for, what they decode to. A column of such a name is replaced."""
    if not decoded:
        return docs.withColumn(ids, encode(F.col(text_col), path))
    both = "bpe_"
    while both in docs.columns:
        both += "_"
    return (docs.withColumn(both, round_trip(F.col(text_col), path))
            .withColumns({ids: F.col(both)["ids"], decoded: F.col(both)["decoded"]}).drop(both))


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op7_bpe_transducer")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, vocabulary(), decoded="decoded").select(
        "doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
