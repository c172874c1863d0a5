"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspan.llm.common import id_and_text, small

# First code point of script ranges, each up to the next entry ("" for ranges without letters of one script).
SCRIPTS = (
    (0x0041, "Latin"), (0x0250, "Latin"), (0x02B0, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, ""),
    (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""),
    (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""),
    (0x2C60, "Latin"), (0x2C80, ""), (0x2D00, "Georgian"), (0x2D30, ""), (0x2DE0, "Cyrillic"), (0x2E00, ""),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"),
    (0x3200, ""), (0x3400, "Han"), (0xA000, "Yi"), (0xA4D0, ""), (0xA640, "Cyrillic"), (0xA6A0, ""), (0xA720, "Latin"),
    (0xA800, ""), (0xAC00, "Hangul"), (0xD800, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x323B0, ""),
)
_STARTS = [a for a, _ in SCRIPTS]
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
GRAM = 3
#: Cells of the score table (buckets x languages) and most buckets; together they bound what is sent to the tasks.
TABLE_CELLS, MOST_BUCKETS = 1 << 22, 1 << 15
SMOOTHING = 0.5
#: Cost in nats of a change of language between two words.
SWITCH_PENALTY = 8.0
#: A script belongs to a language from this share of its letters on.
SCRIPT_SHARE = 0.001
#: Word-language cells decoded together, and words remembered; they bound memory, not the result.
GROUP_CELLS, WORDS_KEPT, COUNTS_KEPT = 3_000_000, 200_000, 200_000


def script_of(char: str) -> str:
    k = bisect_right(_STARTS, ord(char)) - 1
    return SCRIPTS[k][1] if k >= 0 else ""


def features(word: str, buckets: int) -> list[int]:
    """Buckets of the word and of its letter triples, edges marked; a power of two of buckets."""
    marked, mask = f"<{word}>", buckets - 1
    raw = [marked, *(marked[k:k + GRAM] for k in range(len(marked) - GRAM + 1))]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in raw]


def _crc_of_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_of_bytes()


def features_of(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of all words one after the other, and where those of each word start.

    The triples of ASCII words are hashed side by side; a word has one feature more than letters.
    """
    letters = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(letters + 1) - letters - 1
    flat = np.empty(int(letters.sum()) + len(words), np.int64)
    short = np.fromiter(map(str.isascii, words), bool, len(words))
    for k in np.flatnonzero(~short):
        flat[starts[k]:starts[k] + letters[k] + 1] = features(words[k], buckets)
    marked = [b"<%s>" % words[k].encode() for k in np.flatnonzero(short)]
    if marked:
        letters, first = letters[short], starts[short]
        flat[first] = np.fromiter(map(zlib.crc32, marked), np.int64, len(marked)) & buckets - 1
        line = np.frombuffer(b"".join(marked) + b"\0" * (GRAM - 1), np.uint8)
        size = len(line) - GRAM + 1
        crc = np.full(size, 0xFFFFFFFF, np.uint32)
        for k in range(GRAM):
            crc = _CRC[(crc ^ line[k:k + size]) & np.uint32(255)] ^ (crc >> np.uint32(8))
        place = np.arange(size) - np.repeat(np.cumsum(letters + 2) - letters - 2, letters + 2)
        inside = place < np.repeat(letters, letters + 2)  # the others reach into the next word
        flat[(place + np.repeat(first + 1, letters + 2))[inside]] = ~crc[inside] & np.uint32(buckets - 1)
    return flat, starts


@dataclass
class Model:
    """Log-probabilities of buckets by language (float32, bucket x language), and the scripts of each language."""

    languages: list[str]
    table: np.ndarray
    scripts: dict[str, np.ndarray]
    penalty: float = SWITCH_PENALTY
    known: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "rows": []}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Score of each word by language, the best of a word being zero; languages without its script are out."""
        flat, starts = features_of(words, len(self.table))
        scores = np.add.reduceat(self.table[flat], starts, axis=0)
        of_script: dict[str, list[int]] = {}
        for k, word in enumerate(words):
            of_script.setdefault("Latin" if word.isascii() else script_of(next(c for c in word if c.isalpha())), []).append(k)
        for script, rows in of_script.items():
            fitting = self.scripts.get(script)
            if fitting is not None and fitting.any():
                scores[np.ix_(rows, ~fitting)] = -1e6
            else:
                scores[rows] = 0
        return scores - scores.max(axis=1, keepdims=True)

    def number(self, texts: list[str]) -> list[np.ndarray]:
        """The words of each text by their rows in the score memory; words without letters are left out."""
        if len(self.known) > WORDS_KEPT:
            self.known, self.rows = {}, []
        base, fresh, out = sum(map(len, self.rows)), [], []
        for text in texts:  # the words of one text at a time; only numbers are kept
            words = WORD.findall(text.lower())
            for word in set(words).difference(self.known):
                lettered = any(c.isalpha() for c in word)
                self.known[word] = base + len(fresh) if lettered else -1
                if lettered:
                    fresh.append(word)
            ids = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
            out.append(ids[ids >= 0] if (ids < 0).any() else ids)
        for a in range(0, len(fresh), 20_000):
            self.rows.append(self.word_scores(fresh[a:a + 20_000]))
        return out

    def decode(self, numbered: list[np.ndarray]) -> list[np.ndarray]:
        """Best language of each word of each text: all texts of a group go through Viterbi in step, longest first."""
        memory = np.concatenate(self.rows) if len(self.rows) > 1 else self.rows[0] if self.rows else np.zeros((0, len(self.languages)), np.float32)
        self.rows = [memory]
        order = np.argsort([-len(ids) for ids in numbered], kind="stable")
        lengths = np.array([len(numbered[k]) for k in order])
        n, steps = int((lengths > 0).sum()), int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than each step
        offsets = np.concatenate([[0], np.cumsum(active)])
        words = np.empty(offsets[-1], np.int32)
        for rank, k in enumerate(order[:n]):
            words[offsets[:lengths[rank]] + rank] = numbered[k]
        stayed = np.ones((offsets[-1], len(self.languages)), bool)
        source = np.zeros(offsets[-1], np.int32 if len(self.languages) > 127 else np.int8)
        value, ends = np.zeros((n, len(self.languages)), np.float32), np.zeros(n, np.int32)
        for t in range(steps):
            a, m = offsets[t], active[t]
            now = value[:m]
            if t:
                best = now.argmax(axis=1)
                moved = (now[np.arange(m), best] - self.penalty)[:, None]
                stayed[a:a + m] = now >= moved
                source[a:a + m] = best
                np.maximum(now, moved, out=now)
                now -= moved + self.penalty  # keeps the numbers small
            now += memory[words[a:a + m]]
            done = active[t + 1] if t + 1 < steps else 0
            if done < m:
                ends[done:m] = now[done:].argmax(axis=1)
        path, state = np.empty(offsets[-1], np.int32), ends
        for t in range(steps - 1, -1, -1):
            a, m = offsets[t], active[t]
            at = state[:m]
            path[a:a + m] = at
            if t:
                state[:m] = np.where(stayed[a + np.arange(m), at], at, source[a:a + m])
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(numbered)
        for rank, k in enumerate(order[:n]):
            out[k] = path[offsets[:lengths[rank]] + rank]
        return out

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of each text; spans: first word, number of words, language."""
        group, cells = [], 0
        for text in texts:
            group.append(text or "")
            cells += (len(group[-1]) // 5 + 1) * len(self.languages)
            if cells >= GROUP_CELLS:
                yield from self._predict(group)
                group, cells = [], 0
        yield from self._predict(group)

    def _predict(self, texts: list[str]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        if not self.languages:
            yield from [(UNDETERMINED, 0.0, [])] * len(texts)
            return
        for path in self.decode(self.number(texts)) if texts else ():
            if not len(path):
                yield UNDETERMINED, 0.0, []
                continue
            counts = np.bincount(path, minlength=len(self.languages))
            best = int(counts.argmax())
            first = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]])
            spans = [(int(a), int(b - a), self.languages[path[a]]) for a, b in zip(first, first[1:])]
            yield self.languages[best], float(counts[best] / len(path)), spans


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", penalty: float = SWITCH_PENALTY) -> Model:
    """Model of all rows with a text and a label; every word of every text is counted.

    Counts are summed in tasks, then by (language, bucket).  The table that reaches the driver has at most
    ``TABLE_CELLS`` cells whatever the data; more languages leave fewer buckets.  No rows give a model of no language.
    """
    labelled = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    buckets = max(2, min(MOST_BUCKETS, 1 << (TABLE_CELLS // max(1, len(languages))).bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                sums, scripts, listed = np.zeros(buckets, np.int64), Counter(), list(words)
                for a in range(0, len(listed), 20_000):
                    some = listed[a:a + 20_000]
                    flat, starts = features_of(some, buckets)
                    times = np.fromiter(map(words.__getitem__, some), np.int64, len(some))
                    np.add.at(sums, flat, np.repeat(times, np.diff(starts, append=len(flat))))
                for word, n in words.items():
                    scripts["Latin" if word.isascii() else script_of(word[0])] += n * len(word)
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * (len(at) + len(scripts)), pa.string()), pa.array([*at.tolist(), *[-1] * len(scripts)], pa.int32()),
                    pa.array([*[""] * len(at), *scripts], pa.string()), pa.array([*sums[at].tolist(), *scripts.values()], pa.int64()),
                ], ["lang", "bucket", "script", "n"])

        for batch in small(batches, 64):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            if sum(map(len, held.values())) > COUNTS_KEPT:
                yield from out()
                held = {}
        yield from out()

    rows = labelled.mapInArrow(count, "lang string, bucket int, script string, n bigint").groupBy("lang", "bucket", "script").agg(
        F.sum("n").alias("n")
    ).toPandas()
    number = {lang: k for k, lang in enumerate(languages)}
    sums = np.zeros((buckets, len(languages)))
    grams = rows[rows.bucket >= 0]
    sums[grams.bucket.to_numpy(), grams.lang.map(number).to_numpy(dtype=int)] = grams.n.to_numpy()
    table = np.log((sums + SMOOTHING) / (sums.sum(axis=0) + SMOOTHING * buckets)).astype(np.float32)
    scripts: dict[str, np.ndarray] = {}
    letters = rows[rows.bucket < 0]
    totals = letters.groupby("lang").n.sum()
    for lang, script, n in zip(letters.lang, letters.script, letters.n):
        if n >= SCRIPT_SHARE * totals[lang]:
            scripts.setdefault(script, np.zeros(len(languages), bool))[number[lang]] = True
    return Model(languages, table, scripts, penalty)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (share of words in that language), spans (first_word, n_words, lang) of every whole text.

    Words are runs of letters.  Null texts and texts without a letter give ``und``, score 0 and no spans.  Ties go to the
    first language in alphabetical order.  Null ids and repeated rows keep rows of their own; an empty table gives an
    empty table; columns besides the two are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1024):
            done = list(sent.value.predict(batch.column("text").to_pylist()))
            spans = [[dict(zip(("first_word", "n_words", "lang"), s)) for s in d[2]] for d in done]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.float64()),
                pa.array(spans, kind),
            ], ["doc_id", "lang_pred", "score", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, spans array<struct<first_word:int,n_words:int,lang:string>>"
    )


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is determined with a score of ``least_score`` or more."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1024):
            texts = batch.column(text_col).to_pylist()
            yield batch.filter(pa.array([p != UNDETERMINED and s >= least_score for p, s, _ in sent.value.predict(texts)], pa.bool_()))

    return docs.mapInArrow(run, schema)
