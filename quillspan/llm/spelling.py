"""Grouping of spelling variants by a bidirectional FM-index over shards of the vocabulary.

Two words one edit apart agree wholly on one half: the search matches that half exactly from its delimiter and extends
across the other half allowing one error, as intervals of suffix ranks.  A word is sent with the half it needs to the
shard of that half, and as a target to the shards of its own halves, so a shard holds whole groups of words that agree on
a half and no more.  Where a group is too large the half that may hold the error is halved again, and its words move on
with longer agreeing parts; at last all but one letter must agree, and such groups are bounded by the alphabet.

An edit is counted once: at the place of the first letter in which the two words differ, read from the left.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspan.llm.common import id_and_text, small
from quillspan.session import cut_lineage

#: Fixed values of the contract: letters by Latin-1 code, the rule of deletions, and what makes a word and a form.
LETTERS = bytes(c if c in range(97, 123) or c >= 0xC0 else c + 32 if c in range(65, 91) else 32 for c in range(256))
DELETED_OF = 31
LEAST_LETTERS, LEAST_COUNT, FORM_TIMES = 7, 2, 10
#: Words that a task counts before it hands its counts on; aim of target records in a shard; most targets of one group.
COUNTED_AT_ONCE = 400_000
SHARD_TARGET = 24_000
MOST_IN_GROUP = 6_000


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters, A-Z in lower case, as Latin-1."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def words_of(doc_id, text: str, least: int = LEAST_LETTERS) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of one text: runs of at least ``least`` letters once a hash of document and run has taken one."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, count in Counter(runs(text)).items():
        if len(run) >= least:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
            if h % DELETED_OF == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < least:
                    continue
            yield run, count


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: every word of at least ``LEAST_LETTERS`` letters that occurs ``LEAST_COUNT`` times in all whole texts."""
    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in small(batches, 1024):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in words_of(doc_id, text or ""):
                    counts[word] += n
                if len(counts) >= COUNTED_AT_ONCE:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)

    counted = id_and_text(docs, id_col, text_col).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Index:
    """FM-index of delimited words for extension to one side, over symbols 1.. with 0 as the delimiter.

    A row stands for a suffix of some word, up to its delimiter; equal suffixes are ordered by word.  The interval of all
    delimiters is where a match starts; a step to a symbol keeps the rows that it precedes.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, symbols: int):
        """``codes``: a row of symbols for each word, 0 after its end; matches grow from the end to the start."""
        count, width = codes.shape
        place = np.arange(width + 1)
        inside = place[None, :] <= sizes[:, None]
        word, at = np.nonzero(inside)
        padded = np.concatenate([codes, np.zeros((count, 1), codes.dtype)], axis=1)
        start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        span = max(1, int(62 / np.log2(symbols + 2)))  # so many symbols make a first key at once
        key = np.zeros((count, width + 1), np.int64)
        for k in range(span):
            key *= symbols + 1
            if k <= width:
                key[:, :width + 1 - k] += padded[:, k:]
        rank, row = key[word, at], start[word] + at
        while span <= width:  # ranks by twice as many symbols; a suffix that has ended comes first
            rank = np.unique(rank, return_inverse=True)[1]
            more = at + span <= sizes[word]
            second = np.where(more, rank[np.minimum(row + span, len(rank) - 1)] + 1, 0)
            rank, span = rank * (len(rank) + 1) + second, span * 2
        order = np.lexsort((word, rank))
        self.word = word[order]
        first = at[order] == 0
        before = np.where(first, 0, padded[self.word, np.maximum(at[order] - 1, 0)])
        self.whole = np.flatnonzero(first)  # rows that are words
        self.below = np.zeros((len(order) + 1, symbols + 1), np.int32)
        self.below[np.arange(1, len(order) + 1), before] = 1
        np.cumsum(self.below, axis=0, out=self.below)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(padded[word, at], minlength=symbols + 1))[:-1]])
        self.count = count

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[symbol] + self.below[low, symbol], self.starts[symbol] + self.below[high, symbol]

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, low, high) of every step that keeps some row, the delimiter left out."""
        lows, highs = self.below[low, 1:], self.below[high, 1:]
        which, symbol = np.nonzero(highs > lows)
        return which, symbol + 1, self.starts[symbol + 1] + lows[which, symbol], self.starts[symbol + 1] + highs[which, symbol]

    def words(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, word) where an interval holds a whole word; as words are distinct it is the only one."""
        first, end = np.searchsorted(self.whole, low), np.searchsorted(self.whole, high)
        which = np.flatnonzero(end > first)
        return which, self.word[self.whole[first[which]]]


def one_error(
    index: Index, codes: np.ndarray, sizes: np.ndarray, low_at: np.ndarray, high_at: np.ndarray, leftward: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, word) for words one edit from a query, with the edit in its letters ``low_at`` to ``high_at`` (exclusive).

    ``codes`` are read in the order of the match.  ``leftward`` says that this is from the end of the words to their start;
    then the letter after an edit, which decides whether it is the left-most reading, is the one matched last.
    """
    at_most = int(sizes.max(initial=0))
    query = np.arange(len(sizes))
    low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), index.count, np.int64)
    padded = np.concatenate([codes, np.zeros((len(codes), 2), codes.dtype)], axis=1)
    erring: list[tuple[np.ndarray, ...]] = []  # (query, matched, low, high) after the error, by letters matched
    for at in range(at_most + 1):
        if len(query):
            here, next_ = padded[query, at], padded[query, at + 1]
            last = padded[query, at - 1] if at else np.zeros(len(query), padded.dtype)
            inside = (at >= low_at[query]) & (at < high_at[query])
            # an insert lies before a letter of the part as the word reads, or after the last letter of the word
            if leftward:
                gap = (at > low_at[query]) & (at <= high_at[query]) | (at == 0) & (low_at[query] == 0)
                single = (at == 0) | (last != here)
            else:
                gap = inside | (at == sizes[query]) & (high_at[query] == sizes[query])
                single = (at == sizes[query] - 1) | (next_ != here)
            gone = inside & single
            erring.append((query[gone], np.full(gone.sum(), at + 1), low[gone], high[gone]))
            some = np.flatnonzero(inside | gap)
            which, symbol, new_low, new_high = index.branches(low[some], high[some])
            which = some[which]
            differs = symbol != here[which]
            put = inside[which] & differs
            erring.append((query[which[put]], np.full(put.sum(), at + 1), new_low[put], new_high[put]))
            beside = last[which] if leftward else np.where(at < sizes[query[which]], here[which], 0)
            add = gap[which] & (symbol != beside)
            erring.append((query[which[add]], np.full(add.sum(), at), new_low[add], new_high[add]))
            keep = (at < sizes[query]) & (at + 1 <= high_at[query])  # beyond the part nothing without an error counts
            low, high = index.step(low, high, here)
            keep &= high > low
            query, low, high = query[keep], low[keep], high[keep]
    if not erring:
        return
    owner, matched, low, high = (np.concatenate(c) for c in zip(*erring))
    while len(owner):
        full = matched == sizes[owner]
        if full.any():
            which, word = index.words(low[full], high[full])
            yield owner[full][which], word
        owner, matched, low, high = (c[~full] for c in (owner, matched, low, high))
        low, high = index.step(low, high, padded[owner, matched])
        matched = matched + 1
        alive = high > low
        owner, matched, low, high = (c[alive] for c in (owner, matched, low, high))


def encoded(words: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words, a row each with 0 after the end, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max(initial=0))
    points = np.array(words, dtype=f"<U{max(1, width)}").view(np.uint32).reshape(len(words), max(1, width))
    codes = np.where(points == 0, 0, np.searchsorted(alphabet, points) + 1)
    return codes.astype(np.int32), sizes


def backwards(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    place = sizes[:, None] - 1 - np.arange(codes.shape[1])[None, :]
    return np.where(place >= 0, np.take_along_axis(codes, np.maximum(place, 0), axis=1), 0)


def near_words(targets: list[str], queries: list[str], low_at: np.ndarray, high_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, target) positions of all pairs one edit apart whose edit lies in the query's letters ``low_at`` to ``high_at``."""
    alphabet = np.unique(np.frombuffer("".join(targets + queries).encode("utf-32-le"), dtype="<u4"))
    codes, sizes = encoded(targets, alphabet)
    asked, lengths = encoded(queries, alphabet)
    found = []
    leftward = low_at < lengths - high_at  # from the side on which more letters agree
    for left in (False, True):
        some = np.flatnonzero(leftward == left)
        if not len(some):
            continue
        # a match grows from the end of what is indexed, so words are indexed backwards to be read forwards
        index = Index(codes if left else backwards(codes, sizes), sizes, len(alphabet))
        read = backwards(asked[some], lengths[some]) if left else asked[some]
        first = lengths[some] - high_at[some] if left else low_at[some]
        end = lengths[some] - low_at[some] if left else high_at[some]
        found.extend((some[q], t) for q, t in one_error(index, read, lengths[some], first, end, left))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _zone(size, level: int, zone: int):
    """First and end letter of part ``zone`` of the ``2 ** (level + 1)`` parts of a word of ``size`` letters."""
    cut = lambda k: F.floor(size * k / F.lit(2 ** (level + 1))).cast("int")
    return cut(zone), cut(zone + 1)


def _key(level: int, zone: int, before, after):
    """Hash of the letters that must agree before and after a part."""
    size = F.char_length("word")
    return F.xxhash64(F.lit(level), F.lit(zone), F.substring(F.col("word"), F.lit(1), before), F.substring(F.col("word"), size - after + 1, after))


def _records(words: DataFrame, level: int, zones: list[int]) -> DataFrame:
    """word, n, zone, before, after, key, asks: each word as a query of each of its parts, and as a target of the parts
    that a word with its length or one letter more or fewer would ask for."""
    size = F.char_length("word")
    shapes = []
    for zone in zones:
        for extra in (-1, 0, 1):
            first, end = _zone(size + extra, level, zone)
            shapes.append(F.struct(F.lit(zone).alias("zone"), first.alias("before"), (size + extra - end).alias("after"), F.lit(False).alias("asks")))
        first, end = _zone(size, level, zone)
        shapes.append(F.when(end > first, F.struct(F.lit(zone).alias("zone"), first.alias("before"), (size - end).alias("after"), F.lit(True).alias("asks"))))
    rows = words.select("word", "n", F.explode(F.array_distinct(F.array_compact(F.array(*shapes)))).alias("s")).select("word", "n", "s.*")
    fits = rows.where(F.col("before") + F.col("after") <= size)
    keys = None
    for zone in zones:
        key = _key(level, zone, F.col("before"), F.col("after"))
        keys = F.when(F.col("zone") == zone, key) if keys is None else keys.when(F.col("zone") == zone, key)
    return fits.withColumn("key", keys)


def _levels(words: DataFrame, most: int) -> DataFrame:
    """word, n, before, after, key, asks of all records, those of groups with over ``most`` targets halved further.

    Each turn counts the targets of a key; the words of too large groups go on with the two halves of the part.
    """
    longest = words.agg(F.max(F.char_length("word"))).first()[0] or 0
    level, zones, records, done = 0, [0, 1], _records(words, 0, [0, 1]), None
    while True:
        if 2 ** (level + 1) >= longest:
            kept, crowded = records, None
        else:
            large = records.where("not asks").groupBy("key").agg(F.count("*").alias("targets")).where(F.col("targets") > most).select("key")
            large = cut_lineage(large, "spelling-keys")
            crowded = records.join(large, "key", "left_semi") if large.head(1) else None
            kept = records.join(large, "key", "left_anti") if crowded is not None else records
        done = kept.drop("zone") if done is None else done.unionByName(kept.drop("zone"))
        if crowded is None:
            return done
        crowded = cut_lineage(crowded, "spelling-crowded")
        level, parents = level + 1, [r[0] for r in crowded.select("zone").distinct().collect()]
        zones = sorted(child for z in parents for child in (2 * z, 2 * z + 1))
        next_ = []
        for zone in zones:
            of = crowded.where(F.col("zone") == zone // 2)
            size = F.char_length("word")
            shapes = []
            for extra in (-1, 0, 1):
                up = _zone(size + extra, level - 1, zone // 2)
                first, end = _zone(size + extra, level, zone)
                fits = ~F.col("asks") & (up[0] == F.col("before")) & (size + extra - up[1] == F.col("after"))
                shapes.append(F.when(fits, F.struct(first.alias("before"), (size + extra - end).alias("after"))))
            first, end = _zone(size, level, zone)
            shapes.append(F.when(F.col("asks") & (end > first), F.struct(first.alias("before"), (size - end).alias("after"))))
            rows = of.select("word", "n", "asks", F.explode(F.array_distinct(F.array_compact(F.array(*shapes)))).alias("s"))
            rows = rows.select("word", "n", F.lit(zone).alias("zone"), "s.before", "s.after", "asks").where(F.col("before") + F.col("after") <= size)
            next_.append(rows.withColumn("key", _key(level, zone, F.col("before"), F.col("after"))))
        records = next_[0]
        for more in next_[1:]:
            records = records.unionByName(more)


def _search_shard(group: pd.DataFrame) -> pd.DataFrame:
    """For the queries of a shard: how many near words they have there, and the best of them."""
    out = {"word": [], "n_near": [], "best_n": [], "best": []}
    asks = group["asks"].to_numpy()
    targets = group.loc[~asks, ["word", "n"]].drop_duplicates("word").sort_values("word")
    queries = group.loc[asks]
    if len(targets) and len(queries):
        names, counts, words = targets["word"].tolist(), targets["n"].to_numpy(), queries["word"].tolist()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        query, target = near_words(names, words, queries["before"].to_numpy(np.int64), sizes - queries["after"].to_numpy(np.int64))
        order = np.lexsort((target, -counts[target], query))
        query, target = query[order], target[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, np.int64)
        found = np.diff(np.concatenate([first, [len(query)]]))
        out = {
            "word": [words[q] for q in query[first]], "n_near": found, "best_n": counts[target[first]], "best": [names[t] for t in target[first]]
        }
    return pd.DataFrame(out)


def near_counts(words: DataFrame, shard_target: int = SHARD_TARGET, most: int = MOST_IN_GROUP) -> DataFrame:
    """word, n_near, best, best_n of the words (distinct, with n) that have near words; best is the near word with the
    largest n, of equal ones the least."""
    records = cut_lineage(_levels(words, most), "spelling-records")
    shards = max(1, -(-records.where("not asks").count() // shard_target))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    found = records.select("word", "n", "before", "after", "asks", shard.alias("shard")).groupBy("shard").applyInPandas(
        _search_shard, "word string, n_near bigint, best_n bigint, best string"
    )
    least = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("_best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select(
        "word", "n_near", F.col("_best.best").alias("best"), (-F.col("_best.less")).alias("best_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root for the pairs (word, form): forms followed to the last, by doubling the length of each way."""
    ways = cut_lineage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        joined = ways.join(on, "root", "left")
        ways = cut_lineage(joined.select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "spelling-roots")
        if not ways.where("moved").head(1):
            return ways.select("word", "root")
        ways = ways.drop("moved")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    The form is the best near word if it occurs ``FORM_TIMES`` times as often; as counts grow on the way, forms end at a
    root.  Null texts hold no words and a null id counts as the empty text; repeated rows count each; an empty table gives
    an empty table.  Columns besides the two are not read.
    """
    words = cut_lineage(vocabulary(docs, id_col, text_col), "spelling-words")
    near = near_counts(words)
    joined = words.join(near, "word", "left")
    is_form = F.col("best_n") >= FORM_TIMES * F.col("n")
    rows = cut_lineage(joined.select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    ), "spelling-forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
