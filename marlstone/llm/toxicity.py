"""Toxicity by weak supervision.

1. Voters. Lexicons (public insults, and words mined from a bounded sample of labelled rows), stem patterns (mined
   prefixes), density, repetition and direct-address patterns and a voter for clean text each vote toxic, clean or nothing.
2. Label model. All documents' vote patterns are counted. Expectation maximisation fits a generative model of the votes
   given the hidden label: each voter's accuracy and the correlations between voters given the label, by which voters
   that go together are discounted, are estimated together in every round. It yields a posterior for each pattern.
3. Classifier. An L1 logistic regression over words and stems is trained on the posteriors of a bounded sample; it alone
   decides, so it also finds toxic text on which the voters say little.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import encode_words, filtered, lean, plain, sample_ids, slices

FIT_ROWS, FIT_FEATURES, THRESHOLD = 3000, 5000, 0.5
AROUND = ".,;:!?\"'()[]{}<>*_-\u2026\u201c\u201d\u201e\u2018\u2019\u00ab\u00bb\u00a1\u00bf"  # taken off a word before it is looked up
PRECISION = 0.92  # share of toxic texts among those that a mined sign or a feature may have at least
STEMS = (4, 5, 6, 7)
LETTERS = re.compile(r"[^\W\d_]+")
LEXICONS = (
    frozenset("idiot idiots moron morons stupid dumb fool imbecile cretin dimwit halfwit dunce clown idiota idiotin dumm dummkopf trottel bete debile imbecil tonto estupido crétin débile estúpido imbécil".split()),
    frozenset("trash scum worthless pathetic loser losers garbage filth vermin parasite disgusting vile repulsive abschaum wertlos ekelhaft erbärmlich ordure minable dégoûtant racaille basura escoria asqueroso patético inútil".split()),
    frozenset("bastard bitch whore slut shit fuck fucking asshole cunt arschloch hurensohn schlampe wichser connard salope putain enculé merde puta cabrón mierda pendejo gilipollas".split()),
)
ADDRESS = frozenset("you your youre yourself tu vous toi du dich dein ihr usted eres ustedes".split())
VOTERS = ("insult", "contempt", "profanity", "mined_word", "stem4", "stem5", "stem6+", "density", "address", "repeated", "clean", "stem_twice")
TOXIC, CLEAN = 1, 2
SCHEMA = "doc_id bigint, n_hits int, posterior double, score double, toxic boolean"


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in STEMS if len(word) > n]


def bits_of(word: str, mined: frozenset, stems: dict[int, frozenset], twice: frozenset, innocent: frozenset) -> int:
    """Which lists a normalised word is on; bit i belongs to voter i, bit 8 to words of address, bit 9 to stems that
    tell only when two words have them."""
    out = 0 if word in innocent else sum(1 << k for k, lexicon in enumerate(LEXICONS) if word in lexicon)
    out |= 8 * (word in mined)
    for k, n in enumerate(STEMS):
        if len(word) > n:
            out |= (16 << min(k, 2)) * (word[:n] in stems[n]) | 512 * (word[:n] in twice)
    return out | 256 * (word in ADDRESS)


def votes(hits: list[tuple[int, int, str]], twice: frozenset) -> tuple[int, int]:
    """A pattern (two bits a voter: 1 toxic, 2 clean) from (place, bits, word) of the listed words; and their number."""
    seen, words, address, last, n, pairs = 0, set(), False, -10, 0, set()
    for place, bits, word in hits:
        if bits & 127:
            words.add(word)
            n += 1
            address |= place - last <= 3
        if bits & 256:
            last = place
        if bits & 512:
            pairs.add(word)
        seen |= bits
    paired = Counter(s for w in pairs for s in stems_of(w) if s in twice)
    double = any(c > 1 for c in paired.values())
    out = sum(TOXIC << 2 * v for v in range(7) if seen >> v & 1)
    out |= (TOXIC << 14) * (len(words) >= 3) | (TOXIC << 16) * address
    out |= (TOXIC << 18) * (n >= 3) | (0 if words or double else CLEAN << 20) | (TOXIC << 22) * double
    return out, len(words)


@dataclass
class LabelModel:
    """The generative model of the votes given the label; that a voter abstains says nothing.

    ``accuracy`` is P(vote right) of each voter and ``correlation`` how voters go together among documents of one label
    (phi coefficients of voting or not, the larger of the two labels'). A voter whose correlations with the voters that
    also vote add up to r counts as 1 / (1 + r) of an independent one, so ten copies of a voter weigh as one.
    """

    prior: float
    accuracy: np.ndarray
    correlation: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(toxic) for each row of votes."""
        voting = (v > 0) * 1.0
        weight = voting / (1 + voting @ self.correlation)
        side = np.where(v == TOXIC, 1.0, -1.0)
        odds = np.log(self.prior / (1 - self.prior)) + (weight * side) @ np.log(self.accuracy / (1 - self.accuracy))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    @property
    def accuracies(self) -> dict[str, float]:
        return dict(zip(VOTERS, self.accuracy.tolist()))

    @property
    def correlations(self) -> dict[tuple[str, str], float]:
        m = len(VOTERS)
        return {(VOTERS[a], VOTERS[b]): float(self.correlation[a, b]) for a in range(m) for b in range(a) if self.correlation[a, b] > 0}


def unpack(patterns: list[int]) -> np.ndarray:
    return np.array([[p >> 2 * v & 3 for v in range(len(VOTERS))] for p in patterns], np.int64).reshape(-1, len(VOTERS))


def fit_labels(patterns: list[int], counts: list[int], known: dict[int, tuple[int, int]] | None = None, rounds: int = 40) -> LabelModel:
    """Expectation maximisation over the counted patterns, from the belief that voters are right nine times in ten.

    Every round estimates the share of toxic documents, the correlations between voters given the label, and the
    accuracies, in which a vote counts as much as the correlations leave it. The first quarter of the rounds holds voters
    to be independent: while labels are vague, what they share by the label would pass for correlation. Voters are held
    to be better than chance; without that the two labels could be exchanged. ``known`` has (clean, toxic) counts of the
    labelled sample by pattern. It counts as much as all documents together: a voter that never votes beside others
    has nothing else to be measured by.
    """
    v, w = unpack(patterns), np.array(counts, float)
    m = len(VOTERS)
    voting = (v > 0) * 1.0
    sure = np.array([(known or {}).get(p, (0, 0)) for p in patterns], float).reshape(-1, 2)
    sure *= w.sum() / max(1.0, sure.sum())
    start = sure.sum(axis=0)[1] / sure.sum() if sure.sum() else 0.1
    model = LabelModel(float(np.clip(start, 0.01, 0.99)), np.full(m, 0.9), np.zeros((m, m)))
    for k in range(rounds):
        post = model.posterior(v)
        phi = np.zeros((m, m))
        for part in (w * (1 - post), w * post) if 4 * k >= rounds else ():
            n = part.sum() + 1e-9
            mean = part @ voting / n
            cov = (voting * part[:, None]).T @ voting / n - np.outer(mean, mean)
            spread = np.sqrt(np.maximum(np.outer(mean * (1 - mean), mean * (1 - mean)), 1e-8))
            phi = np.maximum(phi, np.where(spread > 1e-3, cov / spread, 0.0))
        np.fill_diagonal(phi, 0.0)
        phi = np.where(phi > 0.1, np.minimum(phi, 1.0), 0.0)
        vote = voting / (1 + voting @ phi)
        toxic = w * post + sure[:, 1]
        clean = w * (1 - post) + sure[:, 0]
        right = np.where(v == TOXIC, toxic[:, None], np.where(v == CLEAN, clean[:, None], 0.0))
        accuracy = ((vote * right).sum(axis=0) + 5.4) / ((toxic + clean) @ vote + 6.0)
        share = (toxic.sum() + 1) / ((toxic + clean).sum() + 10)
        model = LabelModel(float(np.clip(share, 1e-4, 1 - 1e-4)), np.clip(accuracy, 0.55, 0.999), phi)
    return model


def features(words: set[str]) -> set[str]:
    """A text's words, the stems of its words marked ``^``, and the stems that two of its words have marked ``2^``."""
    stems = Counter(s for w in words for s in stems_of(w))
    return words | {"^" + s for s in stems} | {"2^" + s for s, n in stems.items() if n > 1}


def _varied(words: set[str]) -> Callable[[str], bool]:
    """Whether at least three different ones of the words have the stem of a feature; else it is just a word."""
    n = Counter(s for w in words for s in stems_of(w))
    return lambda f: f[0] not in "^2" or n[f.lstrip("2^")] >= 3


def frequent(texts: Iterable[list[str]], least: float) -> tuple[Counter, set[str]]:
    """Features that at least so many of the texts (lists of different words) have, and all their words."""
    n, words = Counter(), set()
    for text in texts:
        own = set(text)
        n.update(features(own))
        words |= own
    return Counter({f: k for f, k in n.items() if k >= least}), words


def mine(bad: Counter, words: set[str], good: Counter, n_bad: int, n_good: int) -> tuple[frozenset, dict[int, frozenset], frozenset, frozenset]:
    """Words and stems that labelled toxic texts have and labelled clean ones hardly ever; and the words of the public
    lexicons that labelled clean texts use as readily as toxic ones, so that they say nothing in this corpus. ``bad``
    and ``good`` count texts by feature, ``words`` are those of the toxic texts."""
    n_bad, n_good, varied = max(1, n_bad), max(1, n_good), _varied(words)
    least = max(3, 0.015 * n_bad)
    telling = [f for f, n in bad.items() if n >= least and n / n_bad > 25 * (good[f] + 0.3) / n_good and n >= PRECISION * (n + good[f]) and varied(f)]
    stems = {n: frozenset(f[1:] for f in telling if f[0] == "^" and len(f) == n + 1) for n in STEMS}
    innocent = frozenset(w for lexicon in LEXICONS for w in lexicon if good[w] and good[w] / n_good > 0.2 * bad[w] / n_bad)
    twice = frozenset(f[2:] for f in telling if f[:2] == "2^")
    return frozenset(f for f in telling if f[0] not in "^2"), stems, twice, innocent


def logistic_l1(rows: list[list[int]], width: int, target: np.ndarray, penalty: float = 4e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """L1 logistic regression on soft targets by accelerated proximal gradient."""
    size = np.array([len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    w, b = np.zeros(width), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    zw, zb, t, n = w.copy(), b, 1.0, len(rows)
    step = 4.0 / max(1.0, np.bincount(col, minlength=width).max(initial=0) / n * max(1, np.percentile(size, 90) if n else 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, zw[col], n) + zb)))
        g = np.bincount(col, (p - target)[row], width) / n
        new = zw - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = zb - step * float((p - target).mean())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, b


@dataclass
class Model:
    mined: frozenset
    stems: dict[int, frozenset]
    twice: frozenset
    innocent: frozenset
    labels: LabelModel | None
    posteriors: dict[int, float]
    weights: dict[str, float]
    bias: float


class Reader:
    """What the words of a text are to a model. Only words that may be on a list are looked at one by one: Arrow finds
    those that are listed themselves or have a listed stem, and those with other signs than letters inside."""

    def __init__(self, lists: tuple, weights: dict[str, float] | None = None):
        mined, stems, twice, _ = lists
        self.lists, self.weights = lists, weights or {}
        weighed = {f.lstrip("2^") for f in self.weights}
        self.listed = pa.array(sorted({*mined, *ADDRESS, *weighed}.union(*LEXICONS)), pa.string())
        starts = {*twice, *weighed}.union(*stems.values())
        self.starts = [(n, pa.array(sorted(t for t in starts if len(t) == n), pa.string())) for n in STEMS]

    def candidates(self, words: pa.Array) -> np.ndarray:
        bare = pc.utf8_trim(pc.utf8_lower(words), AROUND)
        out = pc.or_(pc.invert(pc.utf8_is_alpha(bare)), pc.is_in(bare, self.listed))
        for n, known in self.starts:
            if len(known):
                out = pc.or_(out, pc.is_in(pc.utf8_slice_codeunits(bare, 0, n), known))
        return np.flatnonzero(out.to_numpy(zero_copy_only=False))

    def of(self, raw: str) -> list[tuple[int, str, list[str]]]:
        """(bits, word, weighed features) of the words of letters in a run between white space."""
        lower, out = raw.lower(), []
        for word in (lower,) if lower.isalpha() else LETTERS.findall(lower):
            flag = bits_of(word, *self.lists)
            feats = [f for f in (word, *("^" + t for t in stems_of(word)), *("2^" + t for t in stems_of(word))) if f in self.weights] if self.weights else []
            if flag or feats:
                out.append((flag, word, feats))
        return out

    def hits(self, part: pa.RecordBatch) -> tuple[list[list[tuple[int, int, str]]], list[set[str]]]:
        """For each row: [(place, bits, word)] of its listed words, and the set of its features that weigh something."""
        offsets, codes, words = encode_words(part.column("text"))
        listed: list[list[tuple[int, int, str]]] = [[] for _ in range(part.num_rows)]
        found: list[set[str]] = [set() for _ in range(part.num_rows)]
        words, told = words.cast(pa.string()), {}
        some = self.candidates(words)
        for k, raw in zip(some.tolist(), words.take(pa.array(some)).to_pylist()):
            if x := self.of(raw):
                told[k] = x
        if not told:
            return listed, found
        marked = np.zeros(len(words), bool)
        marked[list(told)] = True
        at = np.flatnonzero(marked[codes])
        row = np.searchsorted(offsets, at, side="right") - 1
        halves: dict[tuple[int, str], str] = {}  # the first word of a row that has a stem
        for place, r, code in zip(at.tolist(), row.tolist(), codes[at].tolist()):
            for flag, word, feats in told[code]:
                if flag:
                    listed[r].append((place, flag, word))
                for f in feats:
                    if f[:2] != "2^" or halves.setdefault((r, f), word) != word:
                        found[r].add(f)
        return listed, found


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most_features: int = FIT_FEATURES) -> Model:
    """The whole model. ``rows`` bounds the labelled sample that the lexicons and the classifier are learnt from (the
    rows lowest by hash of doc_id), ``most_features`` the features of the classifier (those of most toxic texts first);
    vote patterns are counted over all documents. Texts stay in the executors: what comes to the driver of the sample is
    the set of its distinct words."""
    spark = docs.sparkSession
    known = plain(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = plain(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    ids = [r["doc_id"] for r in sample_ids(known, "doc_id", rows).collect()]
    picked = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    truth = {r["doc_id"]: bool(r["toxic"]) for r in known.join(F.broadcast(picked), "doc_id").collect()}

    def spell(batches):
        for batch in batches:
            for part in slices(batch):
                own = [sorted(set(LETTERS.findall(t.lower()))) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(own, pa.list_(pa.string()))], names=["doc_id", "th", "words"])

    spelt = texts.join(F.broadcast(picked), "doc_id").withColumn("th", F.xxhash64("text")).mapInArrow(lean(spell), "doc_id bigint, th bigint, words array<string>")
    table = spelt.toArrow().sort_by([("doc_id", "ascending"), ("th", "ascending")])
    sample, lists_of_words = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "th")))), table.column("words")
    # copies of one text would pass off its words as signs: of texts that share their lowest word hashes one is kept
    once = {tuple(sorted(zlib.crc32(w.encode()) for w in lists_of_words[k].as_py())[:4]): k for k in reversed(range(len(sample)))}
    at = sorted(once.values())
    sample = [sample[k] for k in at]
    worded = lambda which: (lists_of_words[at[k]].as_py() for k in which)  # noqa: E731  texts stay in Arrow; one at a time becomes Python's
    toxic = np.array([truth[i] for i, _ in sample], bool)
    bad, bad_words = frequent(worded(np.flatnonzero(toxic)), 1)
    wanted_words = {f for f, n in bad.items() if n >= 3}.union(*LEXICONS)
    good: Counter = Counter()
    for text in worded(np.flatnonzero(~toxic)):
        good.update(features(set(text)) & wanted_words)
    lists = mine(bad, bad_words, good, int(toxic.sum()), int((~toxic).sum()))
    del bad, bad_words, good
    wanted = spark.sparkContext.broadcast({i for i, _ in sample})

    def count(batches):
        reader = Reader(lists)
        for batch in batches:
            for part in slices(batch):
                told = [votes(h, lists[2])[0] for h in reader.hits(part)[0]]
                patterns = Counter(told)
                own = {p: [] for p in patterns}
                for p, i, th in zip(told, part.column("doc_id").to_pylist(), part.column("th").to_pylist()):
                    if i in wanted.value:
                        own[p].append({"doc_id": i, "th": th})
                item = pa.list_(pa.struct([("doc_id", pa.int64()), ("th", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(list(patterns), pa.int64()), pa.array(list(patterns.values()), pa.int64()), pa.array(list(own.values()), item)], names=["pattern", "n", "own"])

    parts = texts.withColumn("th", F.xxhash64("text")).mapInArrow(lean(count), "pattern bigint, n bigint, own array<struct<doc_id:bigint,th:bigint>>")
    counted = parts.groupBy("pattern").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("own")).alias("own")).orderBy("pattern").collect()
    if not counted:
        return Model(*lists, None, {}, {}, -9.0)
    patterns = [r["pattern"] for r in counted]
    truth_of = {k: bool(y) for k, y in zip(sample, toxic)}
    own = {r["pattern"]: Counter(truth_of[x["doc_id"], x["th"]] for x in r["own"] if (x["doc_id"], x["th"]) in truth_of) for r in counted}
    model = fit_labels(patterns, [r["n"] for r in counted], {p: (c[False], c[True]) for p, c in own.items()})
    posteriors = dict(zip(patterns, model.posterior(unpack(patterns)).tolist()))
    if not sample:  # nothing is labelled: the lexicons' words get fixed weights
        return Model(*lists, model, posteriors, {w: 4.0 for lex in LEXICONS for w in lex}, -2.0)
    voted = {(x["doc_id"], x["th"]): posteriors[r["pattern"]] for r in counted for x in r["own"]}
    own = [voted[k] for k in sample]
    target = np.array(own)
    mass, words = frequent(worded(np.flatnonzero(target > 0.5)), max(3, 0.012 * int((target > 0.5).sum())))
    df: Counter = Counter()
    rows_of = []
    for text in worded(range(len(sample))):
        rows_of.append(features(set(text)) & mass.keys())
        df.update(rows_of[-1])
    varied = _varied(words)
    leaning = (f for f, n in mass.items() if n >= PRECISION * df[f] and varied(f))
    kept = sorted(leaning, key=lambda f: (-mass[f], f))[:most_features]
    column = {f: k for k, f in enumerate(kept)}
    w, b = logistic_l1([sorted(column[f] for f in feats if f in column) for feats in rows_of], len(kept), target)
    weights = {f: float(x) for f, x in zip(kept, w) if abs(x) > 1e-3}
    return Model(*lists, model, posteriors, weights, b)


def _reader(model: Model) -> Reader:
    return Reader((model.mined, model.stems, model.twice, model.innocent), model.weights)


def _judge(part: pa.RecordBatch, model: Model, reader: Reader) -> tuple[list[int], list[float], list[float]]:
    listed, found = reader.hits(part)
    voted = [votes(h, model.twice) for h in listed]
    score = [1 / (1 + np.exp(-min(50.0, max(-50.0, model.bias + sum(model.weights[f] for f in sorted(s)))))) for s in found]
    return [n for _, n in voted], [model.posteriors.get(p, 0.0) for p, _ in voted], [float(s) for s in score]


def judged(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """One row for each row of ``docs``: number of listed words, the label model's ``posterior``, the classifier's
    ``score``, and ``toxic`` (score of at least the threshold).

    A null text has null n_hits, posterior and score and is not toxic; an empty one has no hits, and its score is that
    of no feature. Texts of any length are judged whole. An empty table gives no rows. Without labels the public lexicons
    alone vote and weigh. Labels with null doc_id or null toxic are ignored; of several labels for a document the highest
    counts. A score equal to the threshold is toxic. Null doc_id and repeated rows are carried through one to one; other
    columns are ignored, whatever their names. The model is broadcast; it has at most ``FIT_FEATURES`` weights, whatever
    the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, rows))

    def work(batches):
        reader = _reader(shared.value)
        for batch in batches:
            for part in slices(batch):
                hits, posterior, score = _judge(part, shared.value, reader)
                null = part.column("text").is_null().to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *(pa.array([None if z else x for x, z in zip(c, null)], k) for c, k in ((hits, pa.int32()), (posterior, pa.float64()), (score, pa.float64()))),
                        pa.array([not z and s >= threshold for s, z in zip(score, null)]),
                    ],
                    names=["doc_id", "n_hits", "posterior", "score", "toxic"],
                )

    return plain(docs, "doc_id", "text").mapInArrow(lean(work), SCHEMA)


def clean(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that ``judged`` finds toxic, all columns as they were, whatever their names.

    A null text is not toxic and stays; an empty text, a null doc_id, repeated rows, very long texts and an empty table
    are handled as in ``judged``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def keep():
        reader = _reader(shared.value)

        def judge(part):
            score = _judge(part, shared.value, reader)[2]
            return [z or s < threshold for s, z in zip(score, part.column("text").is_null().to_pylist())]

        return judge

    return filtered(docs, keep)
