"""Subject areas of documents from labelling functions and a latent model of their accuracy.

A document is cut into units (sentences, lines, entries). Five labelling functions vote on each
unit, for a subject, for none, or not at all:

lexicon   words that stand out in the labelled examples of a subject
phrase    words that the corpus itself ties to a subject: a word's lift is how much more of the
          *other* units of its documents carry the subject than a unit of that language usually
          sees. Filler and off-topic sentences occur beside every subject and have no lift,
          however often they are repeated, and a word never counts its own unit's vote.
address   the same lift for the shapes of addresses and codes (links, domains, IP numbers ...)
section   what most of the other units of the same section (up to a blank line) have a lexicon
          vote for
source    subjects that the document's source has a lift for

The votes of all units are counted by pattern. A latent model (expectation maximisation over
those counts) learns how often each function is right, silent and wrong, without labels, and
from that the probability of each subject, and of none, under each pattern. A document's
probabilities are those of its units on average; it has the subjects of at least SHARE.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import clean as C
from emberline.plans.durable import dropped, written

#: Least mean probability of a subject over a document's units.
SHARE = 0.2
#: Score above which a word vote is cast, for the examples' and for the corpus's words, with ten
#: subjects; the largest lift there can be, and the cuts with it, go with the log of their number.
LEXICON_CUT, PHRASE_CUT = 2.5, 2.0
#: A word of the corpus vocabulary occurs at least 3 times and makes up at least this share of
#: all words, so the vocabulary has at most 1 / WORD_SHARE entries at any corpus size.
WORD_SHARE = 2e-6
LIFT_PRIOR = 4.0
NAMES = ("lexicon", "phrase", "address", "section", "source")

_DROP = regex.compile(r"[\p{Mn}\p{Cf}\p{Co}\p{So}\p{Cc}--[\n\t]]+", regex.V1)
#: What may stand before the text of a line in any document: marks of quotations and lists, and a
#: stamp in brackets with or without a speaker.
_MARK = re.compile(r"^(?:> ?|[-*\u2022] |\d{1,4}[.;)] ?|\[[^\]]{1,30}\] ?(?:[^\s:]{1,40}: )?)+")
_MARKS = frozenset(">-*\u2022[0123456789")
_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"').findall
# Names of mail headers.
_HEAD = re.compile(r"^(?:from|to|cc|date|subject): ?")
_BLOCK = re.compile(r"</?(?:p|li|ul|ol|div|br|tr|td|th|table|h[1-6]|html|body|pre|blockquote)\b[^<>]*>")
#: Where a unit ends inside a line: after a full stop and the like, and where `starters` say so.
_STOP = "\x1f"
_END = re.compile(rf"(?<=[.!?])\s+|{_STOP}")
_WORD = re.compile(r"[^\W\d_]+").findall
_DIGIT, _LETTER = re.compile(r"[0-9]").search, re.compile(r"[^\W\d_]").search
_LEET = re.compile(r"[a-z][0134]+[a-z]")
_IP = re.compile(r"\d+\.\d+\.\d+\.\d+").match
_DOMAIN = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]+$").match
_FROM_DIGITS = str.maketrans("0134", "oiea")
_EDGE = " \t.,;:!?()[]{}<>\"'`*-–—“”/\\"


class _Tokens(dict):
    """Raw token to its words and shapes, as one string ('' for nothing worth keeping)."""

    def __missing__(self, raw: str) -> str:
        t = raw.strip(_EDGE)
        keep = len(raw) < 40
        if "://" in t:
            return "@url"
        if "=" in t:
            return " ".join(filter(None, (self[p] for p in t.split("=", 1) if p)))
        if "@" in t:
            return "@mail"
        if _DIGIT(t):
            if _IP(t):
                return "@ip"
            if _LETTER(t):
                return "@code"
            out, keep = "@number", len(raw) < 7
        elif "." in t and _DOMAIN(t):
            return "@domain"
        else:
            out = " ".join(_WORD(t))
        if keep:
            if len(self) > 200_000:
                self.clear()
            self[raw] = out
        return out


_TOKENS = _Tokens()


def _plain(text: str) -> str:
    """Without accents and odd characters."""
    return text if text.isascii() else _DROP.sub("", unicodedata.normalize("NFKD", text))


def starters(texts: list[str | None], least: int = 2) -> re.Pattern | None:
    """Where a sentence begins without a full stop before it, as after a record in the middle of
    a line: at a space before a capitalised word that has begun at least `least` sentences of the
    texts and has never been capitalised inside one. None without such words."""
    first, inside = Counter(), set()
    for t in texts:
        for line in _plain(t or "").split("\n"):
            for sentence in _END.split(line.strip()):
                words = sentence.split()
                first.update(w for w in words[:1] if w.isalpha() and w[0].isupper() and w[1:] == w[1:].lower())
                inside.update(w.strip(_EDGE) for w in words[1:])
    good = sorted(w for w, n in first.items() if n >= least and w not in inside)
    return re.compile(rf" (?=[{''.join(sorted({w[0] for w in good}))}])(?<![\s.!?:,;>\"] )(?=(?:{'|'.join(map(re.escape, good))}) )") if good else None


def sections(text: str | None, starts: re.Pattern | None = None) -> list[list[str]]:
    """The units of each section of a text, each unit as its words in lower case without accents,
    with shapes such as @url for addresses and numbers. A blank line ends a section.

    Mail headers and marks of quotations, lists and speakers are not part of a unit. Of a record
    (a line that begins with a brace, or has quoted fields) the units are its free texts, the
    quoted values of three words or more; one without such is a unit as a whole. Lines broken
    inside words with a hyphen are joined; digits in place of vowels are read as vowels. Units
    of a single word are left out. `starts` tells where else a sentence begins, see `starters`."""
    if not text:
        return []
    t = _plain(text)
    t = (starts.sub(_STOP, t) if starts else t).lower()
    if "</" in t or "&" in t:
        t = html.unescape(_BLOCK.sub("\n", t))
    if "-\n" in t and t.count("-\n") * 2 > t.count("\n"):
        t = t.replace("-\n", "")
    if sum(map(t.count, "0134")) * 25 > len(t) and len(_LEET.findall(t)) * 40 > len(t):
        t = t.translate(_FROM_DIGITS)
    out, now, token = [], [], _TOKENS.__getitem__
    for line in t.split("\n"):
        line = line.strip()
        if not line:
            if now:
                out.append(now)
                now = []
            continue
        first = line[0]
        if first in "ftcds" and _HEAD.match(line):
            continue
        if first in _MARKS:
            line = _MARK.sub("", line)
        bodies = (line,)
        if first == "{" or '="' in line:
            bodies = [v for v in _QUOTED(line) if v.count(" ") > 1] or bodies
        for body in bodies:
            for s in _END.split(body):
                u = " ".join(filter(None, map(token, s.split())))
                if " " in u:
                    now.append(u)
    if now:
        out.append(now)
    return out


def units(text: str | None, starts: re.Pattern | None = None) -> list[str]:
    """The units of a text, see `sections`."""
    return [u for part in sections(text, starts) for u in part]


def examples(df: DataFrame, subjects: DataFrame) -> tuple[list[str], list[tuple[int, str]], list[str], re.Pattern | None]:
    """(subject codes, (subject, unit) of the labelled examples, languages, starters). Both tables are
    short fixed lists. A label is a code or title in any spelling; one that resembles none, and
    null or blank ones, leave their example out. Wrong labels are outvoted."""
    listed = subjects.where("subject IS NOT NULL").select("subject", "title").orderBy("subject").collect()
    codes = list(dict.fromkeys(r.subject for r in listed))
    title = {(r.title or "").lower(): r.subject for r in listed}
    got, langs = [], set()
    rows = df.select("text", "subject", "lang").collect()
    starts = starters([r.text for r in rows])
    for r in rows:
        label = (r.subject or "").strip().lower()
        label = title.get(label, label.replace("-", "_").replace(" ", "_"))
        near = [label] if label in codes else difflib.get_close_matches(label, codes, 1, 0.7)
        if near:
            got += [(codes.index(near[0]), u) for u in units(r.text, starts)]
            langs.add((r.lang or "").strip().lower())
    return codes, got, sorted(x for x in langs if x), starts


def words_of(unit: str) -> set[str]:
    return {w for w in unit.split(" ") if w[0] != "@"}


def shapes_of(unit: str) -> set[str]:
    return {w for w in unit.split(" ") if w[0] == "@"}


def lexicon(labelled: list[tuple[int, str]], k: int) -> dict[str, np.ndarray]:
    """Log lift of each word of the examples for each subject."""
    count: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
    for c, u in labelled:
        for w in words_of(u):
            count[w][c] += 1
    base = sum(count.values(), np.full(k, 1e-9))
    base = base / base.sum()
    return {w: np.log((v + base) / ((v.sum() + 1) * base)) for w, v in count.items()}


def cut_for(cut: float, k: int) -> float:
    return cut * np.log(max(k, 2)) / np.log(10)


class Scores:
    """Word scores as one matrix."""

    def __init__(self, table: dict[str, np.ndarray], k: int):
        self.no = {w: i for i, w in enumerate(table)}
        self.rows = np.array(list(table.values())) if table else np.zeros((0, k))


def votes(bags: list, scores: Scores, cut: float, none: int, silent: int) -> np.ndarray:
    """For each bag of words the subject whose words stand out, `none` if known words point
    nowhere, `silent` if few are known."""
    out = np.full(len(bags), silent)
    get = scores.no.get
    at = [[i for w in b if (i := get(w)) is not None] for b in bags]
    known = np.array([len(a) for a in at], np.int64)
    rows = np.flatnonzero(known)
    if not len(rows):
        return out
    s = np.add.reduceat(scores.rows[list(chain.from_iterable(at))], np.append(0, np.cumsum(known[rows])[:-1]))
    size = np.array([len(bags[r]) for r in rows], float)
    bar = cut * np.sqrt(size)
    best = s.argmax(1)
    top = s[np.arange(len(s)), best]
    second = np.partition(s, -2, 1)[:, -2] if s.shape[1] > 1 else np.full(len(s), -np.inf)
    clear = (top > bar) & (top - second > bar / 2)
    out[rows] = np.where(clear, best, np.where(2 * known[rows] >= size, none, silent))
    return out


_CACHES: dict[str, dict] = {}


def _cache(key: str) -> dict:
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = {}
    return _CACHES[key]


def _of_units(seen: dict, us: list[str], work) -> list:
    """What `work` gives for each unit, made once for each different one as long as the cache holds it."""
    if len(seen) > 100_000:
        seen.clear()
    new = list(dict.fromkeys(u for u in us if u not in seen))
    if new:
        seen.update(zip(new, work(new)))
    return list(map(seen.__getitem__, us))


class _Units:
    """The different units seen so far, each read once: its lexicon vote, its words, and sums over
    its occurrences (the other units' share of each subject, and the number by language). Keys
    beside the units, such as sources, have sums of their own."""

    def __init__(self, width: int, vote):
        self.width, self.vote = width, vote
        self.clear()

    def clear(self) -> None:
        self.no: dict[str, int] = {}
        self.words: list[set[str]] = []
        self.lex: list[int] = []
        self.sums = np.zeros((1 << 14, self.width))
        self.keys: dict[str, np.ndarray] = {}

    def read(self, us: list[str]) -> np.ndarray:
        """The number of each unit."""
        no = self.no
        first = len(no)
        at = np.array([no.setdefault(u, len(no)) for u in us], np.int64)
        if len(no) > first:
            new = [set(u.split(" ")) for u in islice(no, first, None)]
            self.words += new
            self.lex += self.vote(new)
            while len(no) > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        return at

    def add(self, at: np.ndarray, values: np.ndarray) -> None:
        """`values`: a row for each occurrence of a unit."""
        here, back = np.unique(at, return_inverse=True)
        for j in range(self.width):
            self.sums[here, j] += np.bincount(back, values[:, j], len(here))

    def add_key(self, key: str, value: np.ndarray) -> None:
        self.keys[key] = self.keys[key] + value if key in self.keys else value

    def by_word(self) -> tuple[list[str], np.ndarray]:
        """Words and keys with their sums; all is forgotten."""
        no: dict[str, int] = {}
        at = np.array([no.setdefault(w, len(no)) for ws in self.words for w in ws], np.int64)
        of = np.repeat(np.arange(len(self.words)), [len(ws) for ws in self.words])
        out = np.column_stack([np.bincount(at, self.sums[of, j], len(no)) for j in range(self.width)]) if no else np.zeros((0, self.width))
        got = [*no, *self.keys], np.vstack([out, *self.keys.values()])
        self.clear()
        return got


_CUT = ["doc_id", "source", "units", "ends", "lex", "word", "sums"]


def _cut(shared, k: int, langs: list[str], starts: re.Pattern | None):
    """Documents to (doc_id, source, units, ends of the sections, lexicon votes) and, in rows of
    their own, to words with their sums (see `_Units`). The empty word with a language number
    has the sums of all units, '@source:x' those of a source."""
    lang_no = {x: i for i, x in enumerate(langs)}
    width = k + len(langs) + 1

    def batch(ids: pa.Array, source: pa.Array, us: list[str], off: np.ndarray, ends: list[list[int]], lex: np.ndarray) -> pa.RecordBatch:
        n, at = len(ids), pa.array(off.astype(np.int32))
        return pa.RecordBatch.from_arrays([ids, source, pa.ListArray.from_arrays(at, pa.array(us, pa.string())), pa.array(ends, pa.list_(pa.int32())), pa.ListArray.from_arrays(at, pa.array(lex.astype(np.int32))), pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.float64()))], names=_CUT)

    def of_words(table: _Units) -> pa.RecordBatch:
        words, sums = table.by_word()
        n = len(words)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int32())), pa.array(words, pa.string()), lists], names=_CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, cut = shared.value, cut_for(LEXICON_CUT, k)

        def vote(new: list[set[str]]) -> list[int]:
            v = votes([{w for w in ws if w[0] != "@"} for ws in new], scores, cut, k, k + 1)
            return np.where(v == k, k + 1, v).tolist()  # the examples show a part of what is said: nothing found means nothing

        table = _Units(width, vote)
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                cuts = [sections(t, starts) for t in part.column(1).to_pylist()]
                us = [u for c in cuts for p in c for u in p]
                ends = [list(accumulate(map(len, c))) for c in cuts]
                at = table.read(us)
                v = np.array(table.lex, np.int64)[at]
                n = np.array([e[-1] if e else 0 for e in ends])
                yield batch(part.column(0), part.column(3), us, np.append(0, np.cumsum(n)), ends, v)
                # each unit's words get what the other units of the document carry
                doc = np.repeat(np.arange(len(n)), n)
                own = np.zeros((len(v), k))
                own[np.flatnonzero(v < k), v[v < k]] = 1
                m = np.column_stack([np.bincount(doc, own[:, j], len(n)) for j in range(k)])
                lang = np.array([lang_no.get((x or "").strip().lower(), len(langs)) for x in part.column(2).to_pylist()])
                values = np.zeros((len(v), width))
                values[:, :k] = (m[doc] - own) / np.maximum(n[doc] - 1, 1)[:, None]
                values[np.arange(len(v)), k + lang[doc]] = 1
                more = n[doc] > 1
                table.add(at[more], values[more])
                whole = np.zeros((len(n), width))  # of a document with n units each vote is seen by the n-1 others
                whole[:, :k] = m
                whole[np.arange(len(n)), k + lang] = n
                for keys in ([f"\x00{x}" for x in lang.tolist()], [x and f"@source:{x}" for x in part.column(3).to_pylist()]):
                    of = defaultdict(list)
                    for i, x in enumerate(keys):
                        if x and n[i] > 1:
                            of[x].append(i)
                    for x, rows in of.items():
                        table.add_key(x, whole[rows].sum(0))
                if len(table.no) > 150_000:
                    yield of_words(table)
        if table.no:
            yield of_words(table)

    return run


def lifts(sums: dict[str, np.ndarray], k: int, n_lang: int) -> dict[str, np.ndarray]:
    """Log lift of each word, shape and source, against what units of the same languages see."""
    usual = np.full((n_lang, k), np.nan)
    for i in range(n_lang):
        if (v := sums.get(f"\x00{i}")) is not None and v[k + i]:
            usual[i] = v[:k] / v[k + i]
    usual = np.where(np.isnan(usual), np.nanmean(usual, 0) if (~np.isnan(usual)).any() else 1 / k, usual)
    usual = np.maximum(usual, 0.01)
    out = {}
    for w, v in sums.items():
        if not w.startswith("\x00"):
            n = v[k:].sum()
            e = v[k:] @ usual / n
            out[w] = np.log((v[:k] + LIFT_PRIOR * e) / ((n + LIFT_PRIOR) * e))
    return out


def _section_votes(lex: list[int], ends: list[int], k: int, silent: int) -> list[int]:
    """For each unit the subject of more than half of the lexicon votes of its section's other units."""
    out, lo = [], 0
    for hi in ends:
        part = lex[lo:hi]
        count = Counter(v for v in part if v < k)
        total = sum(count.values())
        if not total:
            out += [silent] * (hi - lo)
        elif len(count) == 1:
            (v,) = count
            out += [v if x != v or total > 1 else silent for x in part]
        else:
            best = count.most_common(2)
            for x in part:
                others = total - (x < k)
                v, c = max(((v, c - (v == x)) for v, c in best), key=lambda y: y[1])
                out.append(v if 2 * c > others else silent)
        lo = hi
    return out


def _patterns(shared, k: int, tag: str):
    """Documents to one pattern number for each unit: the five votes as digits to the base k + 2."""
    none, silent, radix = k, k + 1, k + 2
    cut = cut_for(PHRASE_CUT, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, _cache(tag)
        by_source: dict = {}

        def vote(new: list[str]) -> list[int]:
            phrase = votes([words_of(u) or ("",) for u in new], table, cut, none, silent)
            return (phrase * radix + votes([shapes_of(u) for u in new], table, cut, none, silent)).tolist()

        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                off = part.column(2).offsets.to_numpy()
                us = part.column(2).values.slice(off[0], off[-1] - off[0]).to_pylist()
                lex = part.column(4).values.to_numpy()[off[0] : off[-1]].astype(np.int64)
                sources = part.column(1).to_pylist()
                new = list({x for x in sources if x not in by_source})
                by_source.update(zip(new, votes([(f"@source:{x}",) for x in new], table, cut, none, silent).tolist()))
                both = np.array(_of_units(seen, us, vote), np.int64)
                own = lex.tolist()
                sec = [v for x, y, e in zip((off[:-1] - off[0]).tolist(), (off[1:] - off[0]).tolist(), part.column(3).to_pylist()) for v in _section_votes(own[x:y], e, k, silent)]
                source = np.repeat(np.array([by_source[x] for x in sources], np.int64), np.diff(off))
                number = ((lex * radix**2 + both) * radix + np.array(sec, np.int64)) * radix + source
                lists = pa.ListArray.from_arrays(pa.array(off - off[0]), pa.array(number.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "patterns"])

    return run


def learn(patterns: np.ndarray, counts: np.ndarray, k: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each pattern over the k subjects and none, accuracies).

    For a unit of a subject a function votes right, for none, for another subject, or is silent;
    for a unit of none it votes none, for a subject, or is silent. These shares, one set per
    function, and the subjects' shares are what is learned."""
    radix, n = k + 2, len(NAMES)
    votes = np.stack([patterns // radix ** (n - 1 - j) % radix for j in range(n)], 1)
    right = np.tile([0.6, 0.1, 0.05, 0.25], (n, 1))  # right, none, wrong, silent
    empty = np.tile([0.7, 0.05, 0.25], (n, 1))  # none, wrong, silent
    prior = np.append(np.full(k, 0.7 / k), 0.3)
    post = np.zeros((len(patterns), k + 1))
    for _ in range(rounds):
        like = np.tile(np.log(prior), (len(patterns), 1))
        for j in range(n):
            v = votes[:, j]
            own = np.where((v == k)[:, None], right[j, 1], np.where((v == k + 1)[:, None], right[j, 3], right[j, 2] / max(k - 1, 1))) * np.ones((1, k))
            rows = np.flatnonzero(v < k)
            own[rows, v[rows]] = right[j, 0]
            off = np.where(v == k, empty[j, 0], np.where(v == k + 1, empty[j, 2], empty[j, 1] / k))
            like += np.log(np.maximum(np.column_stack([own, off]), 1e-12))
        like -= like.max(1, keepdims=True)
        post = np.exp(like)
        post /= post.sum(1, keepdims=True)
        w = post * counts[:, None]
        prior = (w.sum(0) + 1) / (w.sum() + k + 1)
        for j in range(n):
            v = votes[:, j]
            rows = np.flatnonzero(v < k)
            hit = w[rows, v[rows]].sum()
            subject = w[:, :k].sum(1)
            r = np.array([hit, subject[v == k].sum(), subject[rows].sum() - hit, subject[v == k + 1].sum()]) + [3, 0.5, 0.5, 1]
            right[j] = r / r.sum()
            o = np.array([w[v == k, k].sum(), w[rows, k].sum(), w[v == k + 1, k].sum()]) + [3, 0.5, 1]
            empty[j] = o / o.sum()
    return post, np.hstack([right, empty])


def unit_labels(docs: DataFrame, subjects: DataFrame, labelled: DataFrame) -> tuple[DataFrame, list[str], dict]:
    """What the units of every document are about: doc_id, n_units and weights, the units'
    probabilities of each of the returned codes, and of none, added up; and what was learned of
    each labelling function.

    `docs`: doc_id, text, lang, source; a null in any column is fine, a text without units has
    n_units 0, and without subjects no text has any. Two passes read every document, one cuts
    it and adds up its words, one votes; word sums are combined in each task, then by word.
    What the driver sees is the vocabulary (bounded by WORD_SHARE) and the counts of vote
    patterns (bounded by their number of combinations)."""
    spark = docs.sparkSession
    codes, known, langs, starts = examples(labelled, subjects)
    k, n_lang = len(codes), len(langs) + 1
    if not k:
        return docs.select("doc_id", F.lit(0).alias("n_units"), F.array().cast("array<double>").alias("weights")), codes, {}
    sc = spark.sparkContext
    lex = lexicon(known, k) if known else {}
    tag = uuid.uuid4().hex  # workers keep their votes for one run only
    rows = docs.select("doc_id", "text", "lang", C.name("source").alias("source")).mapInArrow(_cut(sc.broadcast(Scores(lex, k)), k, langs, starts), "doc_id bigint, source string, units array<string>, ends array<int>, lex array<int>, word string, sums array<double>")
    rows = written(rows)
    cut = rows.where("word IS NULL").select("doc_id", "source", "units", "ends", "lex")
    cols = [f"x{i}" for i in range(k + n_lang)]
    sums = written(rows.where("word IS NOT NULL").groupBy("word").agg(*[F.sum(F.col("sums")[i]).alias(c) for i, c in enumerate(cols)]))
    times = sum((F.col(c) for c in cols[k:]), F.lit(0.0))
    total = sums.where(~F.substring("word", 1, 1).isin("\x00", "@")).agg(F.sum(times)).first()[0] or 0  # words, not units
    keep = sums.where((times >= F.lit(max(3.0, WORD_SHARE * total))) | F.col("word").startswith("\x00")).toPandas()  # through Arrow
    table = lifts(dict(zip(keep["word"], keep[cols].to_numpy(np.float64))), k, n_lang)
    marked = written(cut.mapInArrow(_patterns(sc.broadcast(Scores(table, k)), k, tag + "p"), "doc_id bigint, patterns array<int>"))
    dropped(rows)
    dropped(sums)
    got = marked.select(F.explode("patterns").alias("p")).groupBy("p").agg(F.count("*").alias("n")).orderBy("p").toPandas()
    numbers, counts = got["p"].to_numpy(np.int64), got["n"].to_numpy(np.float64)
    post, accuracy = learn(numbers, counts, k) if len(got) else (np.zeros((0, k + 1)), np.zeros((len(NAMES), 7)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = b.column(1).offsets.to_numpy()
            n = np.diff(off)
            p = post[np.searchsorted(numbers, b.column(1).values.to_numpy()[off[0] : off[-1]])]
            doc = np.repeat(np.arange(len(n)), n)
            w = np.column_stack([np.bincount(doc, p[:, j], len(n)) for j in range(k + 1)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (k + 1)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), lists], names=["doc_id", "n_units", "weights"])

    learned = {name: dict(zip(("right", "none", "wrong", "silent", "off_none", "off_wrong", "off_silent"), row.tolist())) for name, row in zip(NAMES, accuracy)}
    return marked.mapInArrow(read, "doc_id bigint, n_units int, weights array<double>"), codes, learned


def document_subjects(labels: DataFrame, codes: list[str], share: float = SHARE) -> DataFrame:
    """Subjects of each document: doc_id, subject, n_units (about it, as probabilities added up)
    and share, the mean probability of the subject over the document's units, at least `share`."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("subject"), F.get("weights", F.lit(i)).alias("n_units")) for i, c in enumerate(codes)] or [F.struct(F.lit("").alias("subject"), F.lit(0.0).alias("n_units"))])).alias("x")
    rows = labels.where("n_units > 0").select("doc_id", F.col("n_units").alias("n"), each)
    return rows.select("doc_id", "x.subject", "x.n_units", (F.col("x.n_units") / F.col("n")).alias("share")).where(F.col("share") >= share - 1e-9)
