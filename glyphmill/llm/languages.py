"""Languages of documents and of mixed-language passages, by cross-parsing entropy.

A suffix automaton of labelled text per language reads a sentence greedily in longest matches; the language that needs
the fewest phrases, normalised by the sentence's length and the logarithm of the training text's, wins. The sentences
of a document are smoothed by a path with a cost for each change of language.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.labels import label_code
from glyphmill.llm.arrow import flat_map
from glyphmill.llm.sentences import is_card, units

#: Bounds of the labelled sample: documents per language, characters of a window at a hashed place in each of them, and
#: characters of training text per language.
TRAIN_DOCS, TRAIN_WINDOW, TRAIN_CHARS = 160, 4_000, 14_000
#: Phrases that a change of language costs.
CHANGE = 4.0
#: Cells of a language's automaton as a table; with more, for scripts with very many characters, only its transitions are stored.
CELLS = 12_000_000
#: A run of LONG letters or more of a spaced script is read by itself, whole; where even the best language needs more than NOISE
#: phrases a letter it is a key or other data and left out (random letters need about 0.7, text without its spaces 0.2 to 0.4).
LONG, NOISE = 30, 0.5
#: Share of a language's training letters from which their script is one of the language's.
OF_SCRIPT = 0.05
#: Code points that letters are looked for in.
POINTS = 0x32400
#: A lane of the vectorised parse holds at most so many characters; longer sentences take several lanes, each of which goes on
#: in the state where the one before it ends.
LANE = 96
#: Lanes that are parsed at once.
BLOCK = 4096

_RUN = re.compile(rf"(?<![^\W\d_])[^\W\d_฀-๿぀-ヿ㐀-鿿豈-﫿]{{{LONG},}}")
# --- suffix automata ---------------------------------------------------------------------------------------------


class Alphabet:
    """Characters of the training texts as small numbers; 0 is a stretch without letters, 1 any other letter."""

    def __init__(self, letters: Iterable[str]):
        self.table = np.zeros(POINTS, dtype=np.int16)
        for c in _all_letters():
            self.table[c] = 1
        self.size = 3  # 2 parts training sentences
        for c in sorted(set(letters)):
            if ord(c) < len(self.table) and self.table[ord(c)] == 1:
                self.table[ord(c)] = self.size
                self.size += 1

    def codes(self, text: str, lower: bool = True) -> np.ndarray:
        points = np.frombuffer((text.lower() if lower else text).encode("utf-32-le", "replace"), dtype=np.uint32)
        return self.table[np.minimum(points, len(self.table) - 1)]


@lru_cache(1)
def _all_letters() -> tuple[int, ...]:
    return tuple(k for k in range(POINTS) if unicodedata.category(chr(k))[0] in "LM")


@lru_cache(200_000)
def _script(letter: str) -> str:
    """The first word of a letter's name, which is its script; empty for other characters."""
    return unicodedata.name(letter, "").split(" ")[0] if unicodedata.category(letter)[0] in "LM" else ""


def automaton(codes: Sequence[int], alphabet: int) -> np.ndarray:
    """Transitions of the suffix automaton of `codes`: a row per state, -1 where there is none."""
    following = _transitions(codes)
    table = np.full((len(following), alphabet), -1, dtype=np.int32)
    for s, f in enumerate(following):
        for c, t in f.items():
            table[s, c] = t
    table[:, 0] = -1
    return table


def _transitions(codes: Sequence[int]) -> list[dict[int, int]]:
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = now
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return following


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Without repeats of 0."""
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])] if len(codes) else codes


class _Sparse:
    """Transitions in order of state and letter, for tables that would be mostly empty."""

    def __init__(self, keys: np.ndarray, places: np.ndarray, on: np.ndarray):
        self.keys, self.places, self.on = keys, places, on

    def follow(self, states: np.ndarray, columns: np.ndarray) -> np.ndarray:
        wanted = (states + columns).astype(np.int32)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.places[at], ~self.on[columns])


def _sparse(following: list[dict[int, int]], width: int) -> _Sparse:
    if len(following) * width >= 2**31:
        raise ValueError("too much training text for so many letters")
    found = sorted((s * width + c, t * width) for s, f in enumerate(following) for c, t in f.items() if c)
    keys, places = np.array(found, dtype=np.int32).reshape(-1, 2).T
    on = np.zeros(width, dtype=np.int32)
    for c, t in following[0].items():
        on[c] = t * width if c else 0
    return _Sparse(np.ascontiguousarray(keys), np.ascontiguousarray(places), on)


class Model:
    """Automata by language. Each has its own letters as columns; column 0 is anything else and has no transition."""

    def __init__(self, texts: dict[str, list[str]], cells: int = CELLS):
        self.languages = sorted(texts)
        self.alphabet = Alphabet(c for t in texts.values() for s in t for c in s.lower())
        self.flat, self.columns, self.own, self.scripts, bits = [], [], [], [], []
        for lang in self.languages:
            codes: list[int] = []
            for s in texts[lang]:
                codes += _squeezed(self.alphabet.codes(s)).tolist() + [2]
            own = [c for c in np.unique(codes).tolist() if c not in (1, 2)]
            column = np.zeros(self.alphabet.size, dtype=np.intp)
            column[own] = np.arange(1, len(own) + 1)
            self.columns.append(column)
            columns, width = [int(column[c]) for c in codes], len(own) + 1
            # a state is its row's place; where a phrase ends, the complement of the place where the next one goes on
            if len(codes) * 2 * width > cells:
                self.flat.append(_sparse(_transitions(columns), width))
            else:
                table = automaton(columns, width)
                on = np.maximum(table[0], 0) * width
                self.flat.append(np.where(table >= 0, table * width, ~on).astype(np.int32).ravel())
            found = Counter(_script(c) for s in texts[lang] for c in s.lower())
            del found[""]
            self.scripts.append(frozenset(x for x, n in found.items() if n >= OF_SCRIPT * found.total()))
            self.own.append((column > 0) & (np.arange(self.alphabet.size) > 0))
            bits.append(math.log2(max(2, len(codes))))
        #: of each code the languages that have it, a bit each
        self.bits = sum((own.astype(np.uint64) << np.uint64(k) for k, own in enumerate(self.own)), np.zeros(self.alphabet.size, dtype=np.uint64))
        self.weights = np.array(bits) / max(bits) if bits else np.zeros(0)

    def codes_of(self, sentences: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all sentences in one array, without repeats of 0, and the number of each."""
        low = [s.lower() for s in sentences]
        lengths = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
        codes = self.alphabet.codes("".join(low), lower=False)
        owner = np.repeat(np.arange(len(low)), lengths)
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
        return codes[keep], np.bincount(owner[keep], minlength=len(low))

    def read(self, sentences: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cost in phrases by language, letters) of each sentence; languages of another script cost infinitely much."""
        return self._read(sentences, False)[:2]

    def _by_script(self, sentence: str) -> np.ndarray:
        """Which languages have most of a sentence's letters in their scripts; none where no letter is in a script of theirs."""
        found = Counter(map(_script, sentence.lower()))
        del found[""]
        counts = np.array([sum(n for x, n in found.items() if x in scripts) for scripts in self.scripts])
        return (counts == counts.max()) & (counts > 0)

    def _read(self, sentences: Sequence[str], fallback: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `_read_whole`; long runs are read by themselves and added to their sentence, or left out as noise."""
        read = self.codes_of(sentences)
        whole, runs, owner = list(sentences), [], []
        for i in self._with_long_runs(*read):
            if found := _RUN.findall(sentences[i]):
                runs += found
                owner += [i] * len(found)
                whole[i] = _RUN.sub(" ", sentences[i])
        costs, letters, known = self._read_whole([*whole, *runs], fallback, None if runs else read)
        n = len(sentences)
        for k, i in enumerate(owner, n):
            best = costs[k].min() if len(costs[k]) else 0
            if best <= NOISE * letters[k]:
                alone = letters[i] == 0
                costs[i] = costs[k] if alone else costs[i] + np.where(np.isfinite(costs[k]), costs[k], letters[k])
                known[i] = known[k] if alone else known[i]
                letters[i] += letters[k]
        return costs[:n], letters[:n], known[:n]

    @staticmethod
    def _with_long_runs(codes: np.ndarray, lengths: np.ndarray) -> list[int]:
        """Numbers of the sentences with LONG letters or more in a row."""
        ends = np.cumsum(lengths)
        edge = np.zeros(len(codes) + 1, dtype=bool)
        edge[:-1] = codes == 0
        edge[ends - lengths] = edge[ends] = True
        edges = np.flatnonzero(edge)
        long = edges[:-1][np.diff(edges) > LONG - 1]  # of a stretch from one edge to the next, at most one place is no letter
        return np.unique(np.searchsorted(ends, long, side="right")).tolist()

    def _read_whole(self, sentences: Sequence[str], fallback: bool, read: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `read`, and the share of known letters of each sentence that no language takes, 1 of the others.

        With `fallback` such a sentence is read by the languages of its script.
        """
        langs = len(self.languages)
        codes, lengths = read or self.codes_of(sentences)
        costs, letters, known = np.zeros((len(sentences), langs)), np.zeros(len(sentences)), np.ones(len(sentences))
        filled = np.flatnonzero(lengths)
        if not len(filled):
            return costs, letters, known
        begins = (np.cumsum(lengths) - lengths)[filled]
        letters[filled] = np.add.reduceat(codes > 0, begins, dtype=np.int64)
        # long sentences take several lanes
        lanes_of = -(-lengths // LANE)
        owner = np.repeat(np.arange(len(lengths)), lanes_of)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
        start = np.repeat(np.cumsum(lengths) - lengths, lanes_of) + nth * LANE
        size = np.minimum(lengths[owner] - nth * LANE, LANE)
        order = np.argsort(-size, kind="stable")
        start, size, owner, nth = start[order], size[order], owner[order], nth[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        before = np.where(nth > 0, place[np.maximum(order - 1, 0)], -1)  # the lane that a lane goes on from
        seen = np.zeros((len(sentences), langs))
        bits = self.bits[codes]
        for k in range(langs):
            seen[filled, k] = np.add.reduceat((bits >> np.uint64(k)).astype(np.uint8) & 1, begins, dtype=np.int64)
        takes = seen >= 0.6 * np.maximum(letters, 1)[:, None]  # a language takes part where most letters are its own
        costs += letters[:, None] - seen  # a letter that a language's training text doesn't have is a phrase of its own
        if fallback and langs:
            for i in np.flatnonzero(~takes.any(axis=1) & (letters > 0)):
                takes[i] = self._by_script(sentences[i])
                known[i] = seen[i].max() / letters[i]
        costs[~takes] = np.inf
        takes = takes[owner]
        phrases = np.zeros((len(owner), langs), dtype=np.int32)
        state, ends = np.zeros((2, len(owner), langs), dtype=np.int32)
        todo = np.arange(len(owner))
        while len(todo):  # first all lanes; then those whose predecessor ends in another state than they began with
            for b in range(0, len(todo), BLOCK):  # few enough lanes that their states stay in the cache
                lanes = todo[b : b + BLOCK]
                n = size[lanes]
                steps = np.arange(int(n[0]))
                block = codes[np.minimum(start[lanes] + steps[:, None], len(codes) - 1)]  # a row per step
                for k in range(langs):
                    mine = np.flatnonzero(takes[lanes, k])
                    if len(mine):
                        part = block if len(mine) == len(n) else block[:, mine]
                        at = lanes[mine]
                        phrases[at, k], ends[at, k] = self._parse(k, part, n[mine], state[at, k])
            begin = np.where((before >= 0)[:, None], ends[before], 0)
            todo = np.flatnonzero((begin != state).any(axis=1))
            state = begin
        phrases[before < 0] += 1
        for k in range(langs):
            np.add.at(costs[:, k], owner, phrases[:, k] * self.weights[k])
        return costs, letters, known

    def _parse(self, k: int, block: np.ndarray, sizes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each lane (column of `block`, longest first) in language k, and the state at its end.

        An unknown letter is read with the phrase behind it.
        """
        columns, flat = self.columns[k][block], self.flat[k]
        dense = isinstance(flat, np.ndarray)
        active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")  # lanes longer than the step
        state, phrases = begin.copy(), np.zeros(len(sizes), dtype=np.int32)
        for step in range(int(sizes[0])):
            a = int(active[step])
            to = flat.take(state[:a] + columns[step, :a]) if dense else flat.follow(state[:a], columns[step, :a])
            ends = to >> 31  # -1 where a phrase ends
            phrases[:a] -= ends
            np.bitwise_xor(to, ends, out=state[:a])
        return phrases, state


@lru_cache(4)
def _model(key: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    return Model({lang: list(t) for lang, t in key})


# --- training ----------------------------------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, doc_id: str, text: str, source: str, final: str, per_language: int = TRAIN_DOCS, window: int = TRAIN_WINDOW) -> dict[str, list[str]]:
    """Texts by language whose labels agree: `per_language` at most, those whose id has the smallest hashes; of each a window.

    The labels are counted without reading texts, and one pass over the texts picks the sample.
    """
    labelled = docs.select(F.col(text).alias("text"), label_code(F.col(source)).alias("lang"), label_code(F.col(final)).alias("other"), F.xxhash64(doc_id).alias("h"), F.xxhash64(F.col(doc_id), F.lit(6)).alias("h2")).filter("lang = other")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    # about twice as many as wanted pass by hash; of these the smallest hashes are taken
    passes = F.lit(False)
    for lang, n in sizes.items():
        bound = -(2**63) + int(2**64 * min(1.0, 2 * per_language / n + 8 / n)) - 1
        passes |= (F.col("lang") == lang) & (F.col("h") <= F.lit(min(bound, 2**63 - 1)))
    at = F.pmod("h2", F.greatest(F.length("text") - window + 1, F.lit(1))).cast("int") + 1
    rows = labelled.filter(passes & (F.length("text") > 40)).select("lang", "h", F.substring(F.col("text"), at, F.lit(window)).alias("text")).collect()  # a bounded sample
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.h, r.text)):
        if len(out.setdefault(r.lang, [])) < per_language:
            out[r.lang].append(r.text)
    return out


def _limited(sentences: Iterable[str], chars: int) -> list[str]:
    """Sentences up to `chars` characters, without those that mostly repeat runs of eight characters taken before."""
    out, n, seen = [], 0, set()
    for s in sentences:
        runs = {s[k : k + 8] for k in range(0, max(1, len(s) - 7))}
        if len(runs - seen) < 0.3 * len(runs):
            continue
        seen |= runs
        out.append(s)
        n += len(s)
        if n >= chars:
            break
    return out


def train(sample: dict[str, list[str]], chars: int = TRAIN_CHARS) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Training sentences by language. Each half of the sample is cleaned of other languages by the other half."""
    halves: list[dict[str, list[str]]] = [{}, {}]
    for lang, texts in sorted(sample.items()):
        for k, t in enumerate(texts):
            halves[k % 2].setdefault(lang, []).extend(t[a:b] for a, b in units(t))
    for k in (0, 1):
        model = Model({lang: _limited(s, chars) for lang, s in halves[1 - k].items() if s})
        for lang, sentences in halves[k].items():
            if lang not in model.languages:
                continue
            costs, letters = model.read(sentences)
            own = costs[:, model.languages.index(lang)]
            halves[k][lang] = [s for s, c, best, n in zip(sentences, own, costs.min(axis=1), letters, strict=True) if c <= best and n > 5]
    return tuple((lang, tuple(_limited([x for pair in _turns(*(h.get(lang, []) for h in halves)) for x in pair], chars))) for lang in sorted(sample))


def _turns(a: list[str], b: list[str]) -> Iterator[list[str]]:
    for k in range(max(len(a), len(b))):
        yield a[k : k + 1] + b[k : k + 1]


# --- documents ---------------------------------------------------------------------------------------------------


def path(costs: np.ndarray, change: float = CHANGE) -> list[int]:
    """The cheapest language of each sentence, where each change costs `change` phrases."""
    best, back = costs[0].copy(), []
    for row in costs[1:]:
        least = int(np.argmin(best))
        stay = best <= best[least] + change
        back.append(np.where(stay, np.arange(len(best)), least))
        best = np.where(stay, best, best[least] + change) + row
    out = [int(np.argmin(best))]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def segments(texts: Sequence[str], model: Model) -> list[list[tuple[int, int, str, float, int, int]]]:
    """Of each text its passages (start, end, language, confidence, sentences, letters), in order."""
    pieces: list[tuple[int, int, int]] = []
    for i, t in enumerate(texts):
        if t:
            pieces += [(i, a, b) for a, b in ([(0, len(t))] if is_card(t) else units(t))]
    costs, letters, known = model._read([texts[i][a:b] for i, a, b in pieces], True)
    finite = np.isfinite(costs)
    hopeless = ~finite.any(axis=1)
    costs = np.where(finite, costs, np.where(finite, costs, 0).max(axis=1, keepdims=True) + np.maximum(letters, 1)[:, None] * 0.7 + 3)
    costs[hopeless | ((letters < 3) & (known == 1))] = 0
    out: list[list[tuple[int, int, str, float, int, int]]] = [[] for _ in texts]
    k = 0
    while k < len(pieces):
        e = k
        while e < len(pieces) and pieces[e][0] == pieces[k][0]:
            e += 1
        if letters[k:e].any() and not hopeless[k:e].all():
            own = costs[k:e]
            total = own.sum(axis=0)
            lead = int(np.argmin(total))
            chosen = [lead] * (e - k) if (own[:, lead] <= own.min(axis=1) + 1).all() else path(own)
            first = k
            for j in range(k, e):
                if j + 1 == e or chosen[j + 1 - k] != chosen[j - k]:
                    lang = chosen[j - k]
                    part = costs[first : j + 1].sum(axis=0)
                    others = np.delete(part, lang)
                    rest = float(others.min()) if len(others) else part[lang] * 2
                    confidence = max(0.0, min(1.0, 1 - part[lang] / rest)) if rest > 0 else 0.0
                    confidence *= float((known * letters)[first : j + 1].sum() / max(1.0, letters[first : j + 1].sum()))
                    out[pieces[k][0]].append((pieces[first][1], pieces[j][2], model.languages[lang], round(confidence, 4), j + 1 - first, int(letters[first : j + 1].sum())))
                    first = j + 1
        k = e
    return out


def passages(docs: DataFrame, doc_id: str, text: str, training: tuple[tuple[str, tuple[str, ...]], ...], carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, carry..., seg_start, seg_end, language, confidence, sentences, letters): passages of one language each.

    A text without letters, such as one of digits only, is in no language: it has no passage and gives no row, nor does a
    null text, nor one in a script that no labelled text has. Text that no language takes, as most of its letters stand in
    no training text, goes to the nearest language of its script with low confidence. `carry` names string columns that
    come along. A document that stands in several rows gives its passages once per row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(training)
    extra = len(carry)

    def make():
        model = _model(sent.value)

        def rows(*columns):
            texts = columns[-1]
            for i, found in enumerate(segments(texts, model)):
                for s in found:
                    yield (*(c[i] for c in columns[: 1 + extra]), *s)

        return rows

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), *carry, F.col(text).alias("text")).filter("length(text) > 0")
    schema = "doc_id bigint, " + "".join(f"{c} string, " for c in carry) + "seg_start bigint, seg_end bigint, language string, confidence double, sentences int, letters int"
    return flat_map(chosen, schema, make)


def label_findings(found: DataFrame, source: str, final: str, least_sentences: int = 2) -> DataFrame:
    """(doc_id, language, confidence) of documents whose labels are absent or wrong, or whose text is in two languages.

    `found` are `passages` that carry the canonical codes of both labels. The main language has the most letters;
    another counts with `least_sentences` sentences or more. Passages of repeated rows count once. One shuffle: a
    document's passages meet by its id.
    """
    once = found.repartition("doc_id").dropDuplicates(["doc_id", "seg_start", "seg_end", "language"])
    by = once.groupBy("doc_id", "language").agg(F.sum("letters").alias("letters"), F.sum("sentences").alias("sentences"), (F.sum(F.col("confidence") * F.col("letters")) / F.greatest(F.sum("letters"), F.lit(1))).alias("confidence"), F.max(source).alias("s"), F.max(final).alias("f"))
    docs = by.groupBy("doc_id").agg(F.max_by("language", F.struct("letters", "language")).alias("main"), F.collect_list(F.struct("language", "sentences", "confidence")).alias("all"), F.max("s").alias("s"), F.max("f").alias("f"))  # at most one entry per language
    second = F.filter("all", lambda x: (x["language"] != F.col("main")) & (x["sentences"] >= least_sentences))
    wrong = F.coalesce((F.col("s") != F.col("main")) | (F.col("f") != F.col("main")), F.lit(True)) | F.col("s").isNull() | F.col("f").isNull()
    own = F.filter("all", lambda x: x["language"] == F.col("main"))
    rows = docs.select("doc_id", F.when(wrong | (F.size(second) > 0), F.concat(own, second)).alias("x")).filter("x is not null")
    return rows.select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.language", F.round("x.confidence", 4).alias("confidence"))


def languages_of(training: tuple[tuple[str, tuple[str, ...]], ...]) -> Counter:
    """Characters of training text by language."""
    return Counter({lang: sum(map(len, t)) for lang, t in training})
