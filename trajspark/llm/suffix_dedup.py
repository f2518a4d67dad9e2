"""Removal of repeated byte strings with suffix arrays.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts elsewhere. Every such string (a window) is known by its anchor: the
leftmost of its ``GRAM``-byte pieces with the least hash. Equal windows have equal anchors at the same place, so windows
are dealt by anchor, and neighbours with one anchor travel together as a context. Contexts whose anchor occurs
only once cannot repeat and stop there. Equal contexts are folded, with their number; different ones of an anchor meet
in a shard, where a suffix array (Larsson and Sadakane's doubling of sorted prefixes), and
common prefixes in text order (Kasai) tell which windows are equal; shards are worked on in pieces of ``PIECE`` bytes, and
windows of other pieces are found by binary search. An anchor with more than ``CROWD`` different contexts
(of words: ``WORD_CROWD``; a passage that very many documents share) is not put into one shard: its contexts are first cut down to single windows, which fold.

Beside that, passages of at least ``WORDS`` words (what stands between white space) that some other row holds too are counted, not removed: most
of them are shorter than ``LENGTH`` bytes. Their windows are runs of words, dealt by anchors of ``WORD_GRAM`` words in the same way; windows of
one anchor are compared by 64-bit hashes.

Null is the empty text. Texts shorter than ``LENGTH`` keep everything. Rows are counted one by one, so all copies of a
long enough text lose all of it. Ids are only passed on (null ids too); other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .hashing import BYTE, PRIME, SPACE, mix, pieces, powers
from .registry import query, table

LENGTH = 400
GRAM = 128
WORDS = 51
WORD_GRAM = 16
CROWD = 1_000
WORD_CROWD = 50_000         # hashes are sorted, so their cost grows no faster than their number
PIECE = 1 << 18
STRETCH = 32                # places walked one after the other when common prefixes are found
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))
HIGH = np.uint64(0xFFFFFFFF00000000)


def inverse_powers(n: int, _kept: list = []) -> np.ndarray:  # noqa: B006
    if not _kept or len(_kept[0]) < n:
        back = np.full(max(n, 1 << 12), INVERSE, np.uint64)
        back[0] = 1
        _kept[:] = [np.multiply.accumulate(back)]
    return _kept[0]


def sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over hashes of bytes or words, and the powers that shift a difference of them to place 0."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[:len(values)], out=total[1:])
    return total, inverse_powers(len(total))[:len(total)]


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours: of twice as many in each step, then of two stretches that overlap."""
    n, least, reach = len(keys) - width + 1, keys, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[:n], least[width - reach:width - reach + n])


def word_hashes(data: np.ndarray, sizes: np.ndarray, total: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text) of texts side by side, from the sums over their bytes."""
    inside, first = ~SPACE[data], np.zeros(len(data) + 1, bool)
    ends = np.cumsum(sizes)
    first[ends - sizes] = first[ends] = True
    begin = np.flatnonzero(inside & (first[:-1] | np.append(True, ~inside[:-1])))
    end = np.flatnonzero(inside & (first[1:] | np.append(~inside[1:], True))) + 1
    hashes = mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64) * BYTE[7])
    return hashes, np.diff(np.searchsorted(begin, ends), prepend=0)


def contexts(total: np.ndarray, back: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, context, start, windows) of all runs of windows that share an anchor, from the sums over texts of ``sizes`` bytes or words side by side."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if len(total) <= length:
        return none
    h = mix((total[gram:] - total[:-gram]) * back[:len(total) - gram])
    least = sliding_least((h & HIGH) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    at = (least & ~HIGH).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)[:len(at)]
    ends = np.cumsum(sizes)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    run_end = np.append(starts[1:], len(at))
    starts = starts[starts + length <= ends[text[starts]]]
    if not len(starts):
        return none
    stop = np.minimum(run_end[np.searchsorted(run_end, starts, "right")], ends[text[starts]] - length + 1)
    whole = mix((total[stop + length - 1] - total[starts]) * back[starts] + BYTE[5] * (stop - starts).astype(np.uint64) + BYTE[6] * (at[starts] - starts).astype(np.uint64))
    return text[starts], h[at[starts]], whole, starts - (ends - sizes)[text[starts]], stop - starts


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes of bytes above 0, and the first eight bytes at every place.

    Ranks of prefixes of h bytes give those of 2h; only groups that are still tied are sorted again.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = (first << np.uint64(8)) | padded[k:k + n]
    order = np.argsort(first, kind="stable")
    fresh = np.append(True, first[order][1:] != first[order][:-1])
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    h = 8
    while True:
        tied = ~(fresh & np.append(fresh[1:], True))
        at = np.flatnonzero(tied)
        if not len(at):
            break
        some = order[at]
        some = some[np.argsort(rank[some] * (n + 1) + rank[np.minimum(some + h, n)] + 1, kind="stable")]
        old, ahead = rank[some], rank[np.minimum(some + h, n)]
        order[at] = some
        fresh[at] = np.append(True, (old[1:] != old[:-1]) | (ahead[1:] != ahead[:-1]))
        rank[some] = np.maximum.accumulate(np.where(fresh[at], at, 0))
        h *= 2
    return order, first


def common_prefixes(data: np.ndarray, order: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """Bytes (at most ``depth``) that each suffix in order shares with the one before it.

    Going from one suffix to the next in the text, the shared prefix shrinks by one byte at most. Many stretches of the text are walked side by side.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    step = max(1, min(STRETCH, int(np.sqrt(n))))
    begins = np.arange(0, n, step)
    shared, h = np.zeros(n, np.int64), np.zeros(len(begins), np.int64)
    padded, words = np.append(data, np.zeros(depth + 16, np.uint8)), np.append(first, np.zeros(depth + 16, np.uint64))
    for t in range(step):
        i = begins + t
        has = before[np.minimum(i, n - 1)] >= 0
        live = np.flatnonzero(has & (i < n))
        h = np.where(has, np.maximum(h - 1, 0), 0)
        a, b, g = i[live], before[i[live]], h[live]
        room = np.minimum(n - np.maximum(a, b), depth)
        open_ = np.arange(len(live))
        while len(open_):
            x, y = a[open_] + g[open_], b[open_] + g[open_]
            same = (words[x] == words[y]) & (g[open_] < room[open_])
            g[open_[same]] += 8
            open_ = open_[same]
        for _ in range(7):
            more = (padded[a + g] == padded[b + g]) & (g < room)
            g += more
        g = np.minimum(g, room)
        h[live] = g
        shared[a] = g
    return shared[order]


class Piece:
    """Contexts side by side: their windows in sorted classes of equal ones."""

    def __init__(self, bodies: list[bytes], weights: list[int], length: int):
        data = np.frombuffer(b"".join(bodies), np.uint8)
        self.data = np.where(data == 0, np.uint8(255), data)        # 255 does not occur in text; 0 is what lies beyond the end
        sizes = np.array([len(b) for b in bodies])
        windows = sizes - length + 1
        self.context = np.repeat(np.arange(len(bodies)), windows)
        offset = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        self.places = np.repeat(np.cumsum(sizes) - sizes, windows) + offset
        order, first = suffix_array(self.data)
        cls = np.cumsum(common_prefixes(self.data, order, first, length) < length)
        of = np.empty(len(self.data), np.int64)
        of[order] = cls
        names, self.of = np.unique(of[self.places], return_inverse=True)
        self.of = self.of.ravel()
        self.count = np.bincount(self.of, np.asarray(weights)[self.context], len(names)).astype(np.int64)
        self.length = length
        self.elsewhere = np.zeros(len(names), np.int64)
        one = np.zeros(len(names), np.int64)
        one[self.of] = self.places
        self.one = one                              # a place of each class, in sorted order

    def strings(self) -> np.ndarray:
        """The windows of all classes, ascending."""
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, self.length)[self.one]).view(f"S{self.length}").ravel()

    def meet(self, other: Piece) -> None:
        """Add to each class how often the other piece has it, found by binary search."""
        mine, theirs = self.strings(), other.strings()
        place = np.searchsorted(mine, theirs)
        hit = np.flatnonzero(place < len(mine))
        hit = hit[mine[place[hit]] == theirs[hit]]
        found = place[hit]
        self.elsewhere[found] += other.count[hit]
        other.elsewhere[hit] += self.count[found]

    def repeated(self) -> list[np.ndarray]:
        flags = (self.count + self.elsewhere > 1)[self.of]
        return np.split(flags, np.flatnonzero(np.diff(self.context)) + 1)


def repeated(bodies: list[bytes], weights: list[int], length: int = LENGTH, piece: int = PIECE) -> list[np.ndarray]:
    """For each context, which of its windows occur more than once among all, counted by weight."""
    done, k = [], 0
    while k < len(bodies):
        size, stop = len(bodies[k]), k + 1
        while stop < len(bodies) and size + len(bodies[stop]) <= piece:
            size += len(bodies[stop])
            stop += 1
        done.append(Piece(bodies[k:stop], weights[k:stop], length))
        k = stop
    for i, one in enumerate(done):
        for other in done[i + 1:]:
            one.meet(other)
    return [flags for one in done for flags in one.repeated()]


def elsewhere(windows: list[np.ndarray], text: np.ndarray, shared: np.ndarray) -> list[np.ndarray]:
    """For each context, which of its windows occur in more than one text; all windows of a ``shared`` context do."""
    if not windows:
        return []
    context = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    order = np.argsort(np.concatenate(windows), kind="stable")
    sorted_ = np.concatenate(windows)[order]
    fresh = np.append(True, sorted_[1:] != sorted_[:-1])
    begins, texts = np.flatnonzero(fresh), text[context[order]]
    several = (np.minimum.reduceat(texts, begins) != np.maximum.reduceat(texts, begins)) | np.logical_or.reduceat(shared[context[order]], begins)
    flags = np.empty(len(order), bool)
    flags[order] = several[np.cumsum(fresh) - 1]
    return np.split(flags, np.flatnonzero(np.diff(context)) + 1)


def ranges_of(flags: np.ndarray) -> bytes:
    """Runs of set flags as pairs (first, end) of 32-bit integers."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.astype("<i4").tobytes()


def text_key(text) -> list:
    """What names a text here: a 64-bit hash and the bytes."""
    return [F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"), F.octet_length(F.coalesce(text, F.lit(""))).alias("size")]


def repeated_windows(rows: DataFrame, length: int, gram: int, crowd: int, words: int, word_crowd: int) -> DataFrame:
    """(digest, size, words, first, end): repeated windows of each text, as ranges of bytes or, if ``words``, of words that other rows hold."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, size = (b.column(k).to_numpy() for k in (0, 1))
            at = 0
            for raw in pieces(b.column(2).to_pylist()):
                data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
                total, back = sums(BYTE[data])
                hashes, counts = word_hashes(data, sizes, total, back)
                for by_words, (text, anchor, whole, start, n) in ((False, contexts(total, back, sizes, length, gram)), (True, contexts(*sums(hashes), counts, words, min(WORD_GRAM, words)))):
                    counted = np.ones(len(text), bool)
                    if by_words:            # an anchor of words counts once for each row
                        order = np.lexsort((anchor, text))
                        counted[order[1:]] = (text[order][1:] != text[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(digest[at + text]), pa.array(size[at + text]), pa.array(np.full(len(text), by_words)), pa.array(anchor.view(np.int64)),
                                                      pa.array(whole.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(counted)],
                                                     ["digest", "size", "words", "anchor", "context", "start", "n", "counted"])
                at += len(raw)

    found = (rows.filter(F.col("size") >= min(length, 2 * words - 1)).select("digest", "size", "text")
             .mapInArrow(find, "digest long, size int, words boolean, anchor long, context long, start int, n int, counted boolean"))
    # written first, so that both sides of the join are exchanges and Spark can split an anchor of very many rows;
    # dealt anew after it, or those rows would stay in the tasks that joined them
    again = pin(found.filter("counted").groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor"))
    found = pin(found.join(again, "anchor").repartition("digest", "context", "start").groupBy("digest", "size", "words", "anchor", "context", "start", "n").agg(F.count(F.lit(1)).alias("times")))
    folded = found.groupBy("words", "anchor", "context", "n").agg(
        F.sum("times").alias("times"), F.max("times").alias("most"), F.min(F.struct("digest", "size", "start")).alias("at"), F.max(F.struct("digest", "size")).alias("last"))
    # written too, or the counts below would fold everything once more
    folded = pin(folded.withColumn("shared", F.expr("most > 1 or last <> struct(at.digest, at.size)")).select("words", "anchor", "context", "n", "times", "shared", "at.*"))
    groups = folded.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"), F.every("shared").alias("settled"))
    folded = pin(folded.join(groups, "anchor").select("words", "anchor", "context", "n", "times", "shared", "digest", "size", "start",
                                                      F.expr("different > 1 and not (words and settled)").alias("looked"), (F.col("different") > F.when(F.col("words"), word_crowd).otherwise(crowd)).alias("crowded")))
    same = folded.filter("if(words, shared, not looked)").select("words", "anchor", "context", F.lit(0).alias("first"), F.col("n").alias("end"))

    # the bytes, or hashes of the windows, of one copy of every context that has to be looked into
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            out = []
            for digest, size, text, cuts in zip(b["digest"], b["size"], b["text"], b["cuts"], strict=True):
                if last == (digest, size):
                    continue
                last, raw, of_words = (digest, size), text.encode(), None
                for c in cuts:
                    body, windows = None, None
                    if c["words"]:
                        if of_words is None:
                            data = np.frombuffer(raw, np.uint8)
                            of_words = sums(word_hashes(data, np.array([len(data)]), *sums(BYTE[data]))[0])
                        (total, back), k = of_words, slice(c["start"], c["start"] + c["n"])
                        windows = mix((total[words:][k] - total[k]) * back[k] + BYTE[9]).view(np.int64)
                    else:
                        body = raw[c["start"]:c["start"] + c["n"] + length - 1]
                        if c["crowded"]:
                            total, back = sums(BYTE[np.frombuffer(body, np.uint8)])
                            body, windows = None, mix((total[length:] - total[:-length]) * back[:c["n"]] + BYTE[8]).view(np.int64)
                    out.append((c["words"], c["anchor"], c["context"], c["times"], c["shared"], digest, body, windows))
            yield pd.DataFrame(out, columns=["words", "anchor", "context", "times", "shared", "text", "body", "windows"])

    def bodies(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("digest", "size").agg(F.collect_list(F.struct("words", "anchor", "context", "start", "n", "times", "shared", "crowded")).alias("cuts"))
        # all columns of the rows go in, so that their exchange is also that of the last join
        return wanted.join(rows, ["digest", "size"]).mapInPandas(cut, "words boolean, anchor long, context long, times long, shared boolean, text long, body binary, windows array<long>")

    # about half a piece for each shard; an anchor stays in one
    shared_out = folded.filter("looked and not crowded")
    total = shared_out.agg(F.sum(F.when(F.col("words"), 8 * F.col("n")).otherwise(F.col("n") + length - 1))).first()[0] or 0
    shards = max(1, 2 * total // PIECE)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            g = pd.concat(held).drop_duplicates(["words", "anchor", "context"])
            some, passages = g[~g["words"]], g[g["words"]]
            flags = repeated(some["body"].tolist(), some["times"].tolist(), length)
            shared = passages["shared"].to_numpy(bool)
            flags += [f for f, s in zip(elsewhere(passages["windows"].tolist(), passages["text"].to_numpy(), shared), shared, strict=True) if not s]
            g = pd.concat([some, passages[~shared]])
            runs = [np.frombuffer(ranges_of(f), "<i4").reshape(-1, 2) for f in flags]
            n = [len(r) for r in runs]
            both = np.concatenate([np.zeros((0, 2), "<i4"), *runs])
            return pd.DataFrame({"words": np.repeat(g["words"].to_numpy(), n), "anchor": np.repeat(g["anchor"].to_numpy(), n),
                                 "context": np.repeat(g["context"].to_numpy(), n), "first": both[:, 0], "end": both[:, 1]})

        for b in batches:
            shard = b["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(b)] if len(b) else []
            for s, e in zip(cuts, cuts[1:], strict=False):
                if held and held[-1]["shard"].iloc[0] != shard[s]:
                    yield done()
                    held = []
                held.append(b.iloc[s:e])
        if held:
            yield done()

    looked = (bodies(shared_out).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
              .repartition("shard").sortWithinPartitions("shard", "anchor")
              .mapInPandas(look, "words boolean, anchor long, context long, first int, end int"))
    single = (bodies(folded.filter("looked and crowded")).dropDuplicates(["words", "anchor", "context"])
              .select("words", "anchor", "context", "times", "shared", "text", F.posexplode("windows").alias("place", "window")))
    common = (single.groupBy("words", "anchor", "window").agg(F.sum("times").alias("sum"), (F.min("text") != F.max("text")).alias("several"), F.some("shared").alias("shared"))
              .filter("if(words, several or shared, sum > 1)").select("words", "anchor", "window"))
    crowded = single.join(common, ["words", "anchor", "window"]).select("words", "anchor", "context", F.col("place").alias("first"), (F.col("place") + 1).alias("end"))
    hits = same.unionByName(looked).unionByName(crowded)
    return (found.join(hits, ["words", "anchor", "context"])
            .select("digest", "size", "words", (F.col("start") + F.col("first")).alias("first"),
                    (F.col("start") + F.col("end") - 1 + F.when(F.col("words"), words).otherwise(length)).alias("end")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, words: int = WORDS,
                   word_crowd: int = WORD_CROWD) -> DataFrame:
    """(id, n_bytes, removed runs as an array of (start, end) bytes, kept bytes, words in passages of at least ``words`` that another row holds too) of every row."""
    rows = docs.select(F.col(id_col), *text_key(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = F.struct("first", "end")
    cuts = (repeated_windows(rows, length, gram, crowd, words, word_crowd).groupBy("digest", "size")
            .agg(F.collect_set(F.when(~F.col("words"), one)).alias("cuts"), F.array_sort(F.collect_set(F.when(F.col("words"), one))).alias("passages")))
    # runs that overlap count once
    n_shared = F.expr("""aggregate(passages, struct(0L as n, 0 as upto),
        (done, p) -> struct(done.n + greatest(0, p.end - greatest(p.first, done.upto)) as n, greatest(done.upto, p.end) as upto), done -> done.n)""")
    n_shared = F.coalesce(n_shared, F.lit(0)).alias("n_shared_words")

    @F.pandas_udf("struct<runs:array<struct<start:int,end:int>>,kept:binary>")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, cuts in batches:
            runs, kept = [], []
            for text, some in zip(texts, cuts, strict=True):
                if text is None:
                    runs.append([])
                    kept.append(None)
                    continue
                raw, merged = text.encode(), []
                for r in sorted((c["first"], c["end"]) for c in some):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                at, out = 0, []
                for s, e in merged:
                    out.append(raw[at:s])
                    at = e
                runs.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join([*out, raw[at:]]))
            yield pd.DataFrame({"runs": runs, "kept": kept})

    # only texts that lose something go to Python
    joined = rows.join(cuts, ["digest", "size"], "left").withColumn("new_", apply(F.when(F.size("cuts") > 0, F.col("text")), "cuts"))
    return joined.select(id_col, F.col("size").cast("long").alias("n_bytes"), "new_.runs", F.coalesce("new_.kept", F.col("text").cast("binary")).alias("kept"), n_shared)


@query("op6_suffix_dedup")
def op6(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("runs").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"),
                      F.coalesce((F.col("n_bytes") - F.octet_length("kept")) / F.nullif("n_bytes", F.lit(0)), F.lit(0.0)).alias("removed_share"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"), "n_shared_words")
