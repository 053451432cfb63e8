"""Language of texts and of their segments by cross-parsing with labelled text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from questlake.workspace import spread

# ISO 639-1, 639-2/T and 639-2/B codes and English names of the languages.
LABELS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish", "castilian"),
    "pt": ("pt", "por", "portuguese"),
    "pl": ("pl", "pol", "polish"),
    "ru": ("ru", "rus", "russian"),
    "zh": ("zh", "zho", "chi", "chinese", "mandarin"),
}

#: Bits that a change of language costs between two pieces of a text.
SWITCH_BITS = 20.0
#: Two languages nearer than this share of the cost are told apart by a second parse from the end.
CLOSE = 1.25
#: Share of the evidence that a lone name keeps (names belong to no language).
NAME_SHARE = 0.05
#: Alphabets up to this size are parsed by tables, larger ones (Han) by dictionaries.
SMALL_ALPHABET = 200
#: Costs of pieces that a worker remembers.
REMEMBERED = 100_000

LETTERS = re.compile(r"[^\W\d_]+")
#: Pieces end at punctuation, dashes, brackets, line ends and runs of blanks.
BREAK = re.compile(r"[.!?;:,…\n\r\t\"“”«»„()\[\]|/。！？；：，、（）《》]+|\s[–—-]+\s|[  　]{2,}|[–—]+")
_CP1252 = {b.decode("cp1252"): b[0] for b in (bytes([x]) for x in range(0x80, 0xA0)) if b not in (b"\x81", b"\x8d", b"\x8f", b"\x90", b"\x9d")}
_TRAIL = "\u0080-¿" + "".join(map(re.escape, _CP1252))
MISREAD = re.compile(f"(?:[Â-ß][{_TRAIL}]|[à-ï][{_TRAIL}]{{2}}|[ð-ô][{_TRAIL}]{{3}})+")


def repaired(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, read right; other text as it is."""

    def fix(m: re.Match[str]) -> str:
        try:
            return bytes(_CP1252.get(c, ord(c)) for c in m[0]).decode()
        except (UnicodeDecodeError, ValueError):
            return m[0]

    return MISREAD.sub(fix, text) if not text.isascii() else text


def plain(text: str) -> str:
    """Lower case letters with single blanks between runs."""
    return " ".join(LETTERS.findall(text.lower()))


def without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


class Automaton:
    """Suffix automaton of a text; ``phrases`` parses another text with it."""

    def __init__(self, text: str):
        follow: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and follow[p].get(c) == q:
                        follow[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        for d in follow:  # states become the dictionaries themselves
            for c in d:
                d[c] = follow[d[c]]
        self.root, self.alphabet, self.bits = follow[0], frozenset(text) - {" ", "\n"}, math.log2(max(2, len(text)))

    def phrases(self, text: str) -> int:
        """Number of phrases when each is the longest that the labelled text contains."""
        root = state = self.root
        count = 0
        for c in text:
            then = state.get(c)
            if then is None:
                if state is not root:
                    count += 1
                then = root.get(c)
                if then is None:  # a letter that the language hasn't shown
                    count += 1
                    then = root
            state = then
        return count + (state is not root)


class DenseAutomaton:
    """The same automaton as a table of states by letters, parsing many texts in step."""

    def __init__(self, automaton: Automaton, code: dict[str, int], width: int):
        numbers = {id(automaton.root): 0}
        states, at = [automaton.root], 0
        while at < len(states):
            for then in states[at].values():
                if id(then) not in numbers:
                    numbers[id(then)] = len(states)
                    states.append(then)
            at += 1
        self.follow = np.full((len(states), width), -1, np.int32)
        edges = [(i, code[c], numbers[id(then)]) for i, state in enumerate(states) for c, then in state.items()]
        i, c, then = np.array(edges, np.int32).reshape(-1, 3).T
        self.follow[i, c] = then

    def phrases(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each text; texts come longest first."""
        n = len(lengths)
        state, count = np.zeros(n, np.int32), np.zeros(n, np.int64)
        for step in range(int(lengths[0]) if n else 0):
            alive = int(np.searchsorted(-lengths, -step, side="left"))
            c = codes[starts[:alive] + step]
            now = state[:alive]
            then = self.follow[now, c]
            broken = np.flatnonzero(then < 0)
            if len(broken):
                fresh = self.follow[0, c[broken]]
                count[broken] += (now[broken] != 0).astype(np.int64) + (fresh < 0)
                then[broken] = np.maximum(fresh, 0)
            state[:alive] = then
        return count + (state != 0)


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    lang: str
    confidence: float
    letters: int


class Identifier:
    """Languages by the number of phrases, normalised by the labelled text's size.

    A phrase costs log2(N) bits, N being the length of a language's labelled text; the
    language of the fewest bits wins. A text is cut into pieces at punctuation and where
    the script changes, and the cheapest sequence of languages is found, a change
    costing SWITCH_BITS, so that single names don't break a segment.
    """

    def __init__(self, samples: Iterable[tuple[str, str]]):
        texts: dict[str, list[str]] = {}
        for lang, text in sorted(samples):
            if text and (p := plain(text)):
                texts.setdefault(lang, []).append(p)
        if not texts:
            raise ValueError("no labelled text")
        self.langs = sorted(texts)
        forward = {lang: "\n".join(dict.fromkeys(x for t in ts for x in (f" {t} ", f" {without_marks(t)} "))) for lang, ts in texts.items()}
        self.forward = [Automaton(forward[lang]) for lang in self.langs]
        self._texts, self._backward = forward, {}
        self.least = max(a.bits for a in self.forward)
        letters = sorted(set().union(*(a.alphabet for a in self.forward if len(a.alphabet) < SMALL_ALPHABET)) | {" ", "\n"})
        self._code = np.zeros(0x110000, np.int16)  # 0: a letter that no small alphabet has
        code = {c: i + 1 for i, c in enumerate(letters)}
        for c, i in code.items():
            self._code[ord(c)] = i
        self._dense = [DenseAutomaton(a, code, len(letters) + 1) if len(a.alphabet) < SMALL_ALPHABET else None for a in self.forward]
        self._known: dict[str, tuple[float, ...]] = {}

    def backward(self, j: int) -> Automaton:
        """The automaton of the reversed text, made when it is first needed."""
        if j not in self._backward:
            self._backward[j] = Automaton(self._texts[self.langs[j]][::-1])
        return self._backward[j]

    def learn(self, pieces: Iterable[str]) -> None:
        """Work out the costs of the pieces that aren't remembered yet, all in step."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        new = sorted({p for p in pieces if p not in self._known}, key=len, reverse=True)
        if not new:
            return
        # blanks around a piece let whole words match; Han text has none
        texts = [p if _script(p[0]) == 2 else f" {p} " for p in new]
        texts, new = map(list, zip(*sorted(zip(texts, new), key=lambda x: -len(x[0]))))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        codes = self._code[points]
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths) - lengths
        bits = np.empty((len(new), len(self.langs)))
        for j, (a, dense) in enumerate(zip(self.forward, self._dense)):
            foreign = np.array([a.alphabet.isdisjoint(p) for p in new])
            bits[:, j] = np.array([len(p) for p in new])
            own = np.flatnonzero(~foreign)
            if dense is not None:
                bits[own, j] = dense.phrases(codes, starts[own], lengths[own])
            else:
                bits[own, j] = [a.phrases(texts[i]) for i in own]
            bits[:, j] *= a.bits
        close = bits <= bits.min(axis=1, keepdims=True) * CLOSE
        for i in np.flatnonzero(close.sum(axis=1) > 1):
            back = texts[i][::-1]
            for j in np.flatnonzero(close[i]):
                if not self.forward[j].alphabet.isdisjoint(new[i]):
                    bits[i, j] = (bits[i, j] + self.forward[j].bits * self.backward(j).phrases(back)) / 2
        self._known.update(zip(new, map(tuple, bits.tolist())))

    def costs(self, piece: str) -> tuple[float, ...]:
        """Bits of a plain piece in each language."""
        if piece not in self._known:
            self.learn([piece])
        return self._known[piece]

    def _weighed(self, text: str, start: int, end: int, piece: str) -> tuple[float, ...]:
        """Costs; those of a lone word that is capitalised or that no language shows whole, a name, hardly differ."""
        bits = self.costs(piece)
        if " " not in piece and _script(piece[0]) != 2:
            best = min(bits)
            if best > 1.5 * self.least or LETTERS.search(text, start, end)[0][0].isupper():
                return tuple(best + NAME_SHARE * (x - best) for x in bits)
        return bits

    def segments(self, text: str) -> list[Segment]:
        """Segments of one language each; places are those of the repaired text."""
        return self._path(text, split(text))

    def segments_of(self, texts: Sequence[str]) -> Iterator[list[Segment]]:
        """``segments`` of many texts, their pieces parsed together."""
        for at in range(0, len(texts), 2000):
            part = texts[at : at + 2000]
            cut = [split(t) for t in part]
            self.learn(p for pieces in cut for _, _, p in pieces)
            for text, pieces in zip(part, cut):
                yield self._path(text, pieces)

    def _path(self, text: str, pieces: list[tuple[int, int, str]]) -> list[Segment]:
        if not pieces:
            return []
        n = len(self.langs)
        bits = [self._weighed(text, *piece) for piece in pieces]
        total, back = list(bits[0]), []
        for cost in bits[1:]:
            cheapest = min(range(n), key=total.__getitem__)
            change = total[cheapest] + SWITCH_BITS
            back.append([i if total[i] <= change else cheapest for i in range(n)])
            total = [min(total[i], change) + cost[i] for i in range(n)]
        at = min(range(n), key=total.__getitem__)
        path = [at]
        for step in reversed(back):
            at = step[at]
            path.append(at)
        path.reverse()
        out, first = [], 0
        for i in range(1, len(path) + 1):
            if i == len(path) or path[i] != path[first]:
                group = pieces[first:i]
                sums = [sum(b[j] for b in bits[first:i]) for j in range(n)]
                letters = sum(sum(map(len, p.split(" "))) for _, _, p in group)
                end = len(text) if i == len(path) else pieces[i][0]
                out.append(Segment(0 if first == 0 else group[0][0], end, self.langs[path[first]], confidence(sums, path[first]), letters))
                first = i
        return out


@lru_cache(maxsize=2)
def identifier(samples: tuple[tuple[str, str], ...]) -> Identifier:
    """One classifier for all tasks of a worker."""
    return Identifier(samples)


def confidence(bits: Sequence[float], chosen: int) -> float:
    """Between 0 and 1: weight of the chosen language among all, a tenth of the bits counting as evidence (pieces aren't independent)."""
    lowest = min(bits)
    weights = [2 ** (-(b - lowest) / 10) for b in bits]
    return weights[chosen] / sum(weights)


def _script(c: str) -> int:
    """Latin, Cyrillic, Han or any other."""
    o = ord(c)
    return 0 if o < 0x370 or 0x1E00 <= o < 0x2000 else 1 if 0x400 <= o < 0x530 else 2 if 0x2E80 <= o < 0xA000 or 0x20000 <= o < 0x40000 else 3


#: Letters of the same four.
SCRIPTS = [
    re.compile("[A-Za-zªºÀ-ÖØ-öø-ˁḀ-ỿ]"),
    re.compile("[Ѐ-ҁҊ-ԯ]"),
    re.compile("[⺀-⿿々-〇㐀-䶿一-鿿𠀀-𿿿]"),
    re.compile("[Ͱ-ϿԱ-᷿ⰰ-ⷿꀀ-🿿]"),
]


def split(text: str) -> list[tuple[int, int, str]]:
    """Pieces with letters: start, end, plain text."""
    return [(a, b, p) for a, b in _pieces(text) if (p := plain(text[a:b]))]


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in BREAK.finditer(text):
        if m.start() > at:
            yield from _by_script(text, at, m.start())
        at = m.end()
    if at < len(text):
        yield from _by_script(text, at, len(text))


def _by_script(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    part = text[start:end]
    if part.isascii() or sum(x.search(part) is not None for x in SCRIPTS) < 2:
        yield start, end
        return
    at, now = start, None
    for m in LETTERS.finditer(part):
        for i, c in enumerate(m[0]):
            s = _script(c)
            if now is not None and s != now:
                yield at, start + m.start() + i
                at = start + m.start() + i
            now = s
    yield at, end


def label_language(label: Column) -> Column:
    """The language a label names (ISO 639-1), whatever its case, region, script or blanks; null if none of the known."""
    bare = F.lower(F.regexp_replace(label, r"^[\s ]+|[\s ]+$", ""))
    head = F.regexp_extract(bare, r"^([a-z]+)(?:[-_\s(].*)?$", 1)
    out = F.lit(None).cast("string")
    for lang, names in LABELS.items():
        out = F.when(head.isin(*names), lang).otherwise(out)
    return out


SEGMENTS = {"seg_no": pa.int32(), "seg_start": pa.int32(), "seg_end": pa.int32(), "found_lang": pa.string(), "confidence": pa.float64(), "letters": pa.int32()}
LANGUAGES = {"found_lang": pa.string(), "share": pa.float64(), "confidence": pa.float64(), "mixed": pa.bool_()}
SQL = {pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}


def languages_of(found: list[Segment], mixed_share: float = 0.15) -> list[tuple[str, float, float, bool]]:
    """Language, share of the letters, confidence and whether the text is mixed: all languages of a mixed text, the main one of another."""
    letters: dict[str, int] = {}
    sure: dict[str, float] = {}
    for s in found:
        letters[s.lang] = letters.get(s.lang, 0) + s.letters
        sure[s.lang] = sure.get(s.lang, 0.0) + s.confidence * s.letters
    total = sum(letters.values())
    if not total:
        return []
    ranked = sorted(letters, key=lambda x: (-letters[x], x))
    big = [x for x in ranked if letters[x] >= mixed_share * total]
    return [(x, letters[x] / total, sure[x] / letters[x], len(big) > 1) for x in (big if len(big) > 1 else ranked[:1])]


def fitting_sample(samples: DataFrame, max_samples: int) -> list[tuple[str, str]]:
    """At most ``max_samples`` labelled rows by language and text: equally many of each language, in hash order, and all of one that has fewer."""
    labelled = samples.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    turn = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    rows = labelled.withColumn("_n", turn).where(F.col("_n") <= max_samples).orderBy("_n", "lang").limit(max_samples).collect()
    return sorted((r.lang, r.text) for r in rows)


def _identify(docs: DataFrame, samples: DataFrame, id_col: str, text: str, keep: Sequence[str], max_samples: int, out: dict[str, pa.DataType], rows_of) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(fitting_sample(samples, max_samples)))
    kinds = dict(docs.dtypes)
    head = [id_col, *(c for c in keep if c != id_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = identifier(shared.value)
        for batch in batches:
            texts = [repaired(t) for t in batch.column(len(head)).to_pylist()]
            owner, made = [], []
            for i, found in enumerate(identify.segments_of(texts)):
                new = rows_of(found)
                owner += [i] * len(new)
                made += new
            columns = list(zip(*made)) or [[] for _ in out]
            place = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(place) for i in range(len(head))), *(pa.array(c, k) for c, k in zip(columns, out.values()))], names=[*head, *out])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in head] + [f"{c} {SQL[k]}" for c, k in out.items()])
    return spread(docs.where(F.col(text).isNotNull()).select(*head, F.col(text))).mapInArrow(run, schema)


def segments(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text: str = "text", keep: Sequence[str] = (), max_samples: int = 20_000) -> DataFrame:
    """id, kept columns, and a row for each one-language segment of each whole text.

    The classifier is fitted on at most ``max_samples`` labelled rows (equally many of
    each language; a fixed bound, so it is sent to all tasks). Null and empty texts
    and texts without letters give no rows. Ties go to the language first in the
    alphabet. Each row of ``docs`` is a text of its own, repeated ids too. Nothing is
    shuffled.
    """

    def rows_of(found: list[Segment]) -> list[tuple]:
        return [(k, s.start, s.end, s.lang, s.confidence, s.letters) for k, s in enumerate(found)]

    return _identify(docs, samples, id_col, text, keep, max_samples, SEGMENTS, rows_of)


def languages(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text: str = "text", keep: Sequence[str] = (), mixed_share: float = 0.15, max_samples: int = 20_000) -> DataFrame:
    """id, kept columns, found_lang, share of the letters, confidence, mixed: the text's languages.

    A mixed text has a row for each language with at least ``mixed_share`` of its
    letters; any other text with letters one row, its language of most letters. See
    ``segments`` for the rest.
    """
    return _identify(docs, samples, id_col, text, keep, max_samples, LANGUAGES, lambda found: languages_of(found, mixed_share))
