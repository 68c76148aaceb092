"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document: bad, good, or no opinion. Expectation
maximisation over all documents' vote patterns estimates how accurate each labeller is, without
any given labels, for three traits: noise, repetition and toxicity. Toxicity is read from listed
words: a short English list, and words of any language that ``learn_marks`` takes from a bounded sample
of given labels (at most ``LABEL_ROWS``); learned words count where a text has two kinds of them.
The posteriors train one hashed linear
scorer (logistic regression on hashed words, signs and votes), which then scores every document.

What is gathered from the corpus: counts of vote patterns (at most 3 ** labellers rows, in fact a
few hundred), a sample of at most ``SAMPLE_ROWS`` documents' hashed features for the scorer, and at
most ``MARKS`` learned words.
Votes, pattern counts and scores cover all rows.

A null or empty text has no words and counts as poor quality. Repeated rows are scored alike, each
on its own. An empty table gives an empty result. Columns other than the key and the text are not
looked at, and ``keep_good`` returns them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm import text as T

# Most documents the linear scorer is fitted on.
SAMPLE_ROWS = 12_000
HASH_BITS = 18
# Most given labels that words are learned from, and most words learned.
LABEL_ROWS = 20_000
MARKS = 4_096
# A learned word stands in so many toxic documents, in such a share of all toxic ones, and toxic ones
# are such a share of the documents that have it.
MARK_DOCUMENTS, MARK_SPREAD, MARK_PURITY = 4, 0.01, 0.8
EPOCHS = 8
VOTE_FEATURES = 4
THRESHOLD = 0.5
# The posterior from which the labellers' own verdict is enough.
SURE = 0.9
BAD, NONE, GOOD = 1, 0, -1

# Frequent function words of the languages expected; ordinary prose is full of them.
FUNCTION_WORDS = (
    "a an and are as at be by for from has have he in is it its not of on or she that the their they this to was were "
    "will with you der die das den dem des ein eine einen und ist in zu von mit auf für nicht sich als auch an wie bei "
    "le la les un une des du de et est en que qui dans pour par sur pas avec plus au il elle "
    "el los las una unos del y es que no se por con para como más al lo su"
).split()
# Insults; a parameter of the toxicity labellers.
INSULTS = (
    "idiot idiots moron morons stupid trash garbage pathetic worthless disgusting clown clowns scum loser losers "
    "imbecile cretin dumbass bastard asshole filth vermin"
).split()

_NOT_LINE_END = np.ones(256, bool)
_NOT_LINE_END[0x0A] = False
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_SIGN = T.NOT_SPACE & ~_LETTER
_SIGN[0x30:0x3A] = False
_COMMON_SIGN = np.zeros(256, bool)
_COMMON_SIGN[list(b".,'\"-;:()?")] = True
_RARE_SIGN = _SIGN & ~_COMMON_SIGN


def word_hashes(words: list[str]) -> np.ndarray:
    return np.sort(T.words_of(pa.array(words), T.ALNUM).hashes())


def contained(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


_FUNCTION, _INSULT = word_hashes(FUNCTION_WORDS), word_hashes(INSULTS)


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring bounds."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _listed(h: np.ndarray, rows: np.ndarray, bounds: np.ndarray, sorted_set: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words of each row are listed, and how many distinct ones."""
    found = contained(h, sorted_set)
    distinct = np.unique(np.stack((rows[found].astype(np.uint64), h[found])), axis=1)[0].astype(np.int64)
    return per_row(found, bounds), np.bincount(distinct, minlength=len(bounds) - 1)


@dataclass
class Piece:
    """What the labellers and the scorer look at, for the rows of a piece."""

    words: T.Words
    hashes: np.ndarray
    measures: dict[str, np.ndarray]


def measure(texts: pa.Array, marks: np.ndarray | None = None) -> Piece:
    """``marks`` holds the sorted hashes of learned words."""
    data, offsets = T.as_bytes(texts)
    words = T.Words(T.lowered(data), offsets, T.ALNUM)
    h = words.hashes()
    n = np.diff(words.bounds)
    some = np.maximum(n, 1)
    rows = words.rows()
    seen = per_row(T.NOT_SPACE[data], offsets)
    letters = np.maximum(per_row(_LETTER[data], offsets), 1)
    lines = T.Words(data, offsets, _NOT_LINE_END)
    line_rows = lines.rows()
    n_lines = np.maximum(np.diff(lines.bounds), 1)
    line_hash = lines.hashes()
    order = np.lexsort((line_hash, line_rows))
    again = np.zeros(len(order), bool)
    again[1:] = (line_hash[order][1:] == line_hash[order][:-1]) & (line_rows[order][1:] == line_rows[order][:-1])
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    by_word = np.lexsort((h, rows))
    new = np.ones(len(h), bool)
    new[1:] = (h[by_word][1:] != h[by_word][:-1]) | (rows[by_word][1:] != rows[by_word][:-1])
    distinct = np.bincount(rows[by_word][new], minlength=len(n))
    hits, kinds = _listed(h, rows, words.bounds, _INSULT)
    if marks is not None and len(marks):
        more, more_kinds = _listed(h, rows, words.bounds, marks)
        # One learned word alone may be chance.
        hits, kinds = hits + np.where(more_kinds > 1, more, 0), kinds + np.where(more_kinds > 1, more_kinds, 0)
    measures = {
        "n_words": n,
        "sign_share": per_row(_RARE_SIGN[data], offsets) / np.maximum(seen, 1),
        "upper_share": per_row(_UPPER[data], offsets) / letters,
        "sign_words": per_row(_RARE_SIGN[data], offsets) / some,
        "strange_share": 1 - per_row(contained(h, _FUNCTION), words.bounds) / some,
        "known_share": 1 - distinct / some,
        "repeat_share": per_row(same, words.bounds) / some,
        "line_repeat_share": np.bincount(line_rows[order][again], minlength=len(n)) / n_lines,
        "word_length": per_row(words.inside, offsets) / some,
        "insults": hits,
        "insult_kinds": kinds,
        "insult_share": hits / some,
    }
    return Piece(words, h, measures)


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE)).astype(np.int8)


# Shares say little about a few words: below this, their labellers have no opinion.
FEW_WORDS = 12


def _share(bad: str, m: dict[str, np.ndarray], over: float, under: float) -> np.ndarray:
    return np.where(m["n_words"] < FEW_WORDS, NONE, _vote(m[bad] > over, m[bad] < under))


def _rare(m: dict[str, np.ndarray]) -> np.ndarray:
    """One or two kinds of listed words, each time among more than a thousand others: chance or quotation."""
    return (m["insult_kinds"] < 3) & (m["insult_share"] < 0.001)


# Labellers by trait: measures in, votes out. Thresholds are parameters of the heuristics.
LABELLERS = {
    "noisy": {
        "signs": lambda m: _share("sign_share", m, 0.1, 0.05),
        "sign_words": lambda m: _share("sign_words", m, 0.5, 0.2),
        "shouting": lambda m: _share("upper_share", m, 0.4, 0.1),
        "function_words": lambda m: _share("strange_share", m, 0.92, 0.85),
        "word_length": lambda m: _vote((m["n_words"] < 1) | (m["word_length"] > 20), (m["word_length"] > 3) & (m["word_length"] < 10)),
    },
    "repetitive": {
        "neighbours": lambda m: _share("repeat_share", m, 0.15, 0.05),
        "poor_words": lambda m: _share("known_share", m, 0.8, 0.65),
        "lines": lambda m: _vote(m["line_repeat_share"] > 0.4, m["line_repeat_share"] < 0.2),
    },
    "toxic": {
        "insult": lambda m: _vote((m["insults"] > 0) & ~_rare(m), m["insults"] == 0),
        "insult_kinds": lambda m: _vote((m["insult_kinds"] > 1) & ~_rare(m), _rare(m)),
        "insult_share": lambda m: _vote(m["insult_share"] > 0.002, _rare(m)),
    },
}
TRAITS = list(LABELLERS)


def votes_of(m: dict[str, np.ndarray]) -> np.ndarray:
    """Rows by labellers, traits one after another."""
    return np.stack([f(m) for trait in TRAITS for f in LABELLERS[trait].values()], axis=1)


def columns_of(trait: str) -> slice:
    start = sum(len(LABELLERS[t]) for t in TRAITS[: TRAITS.index(trait)])
    return slice(start, start + len(LABELLERS[trait]))


@dataclass(frozen=True)
class LabelModel:
    """Share of bad documents and, for each labeller, how often its votes (for good, none, for bad)
    fall so on bad and on good documents. Having no opinion says nothing: its share is 1 for both."""

    prior: float
    on_bad: np.ndarray
    on_good: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability that a document with these votes is bad."""
        each = np.arange(votes.shape[1])
        odds = np.log(self.prior) - np.log1p(-self.prior)
        odds = odds + (np.log(self.on_bad[each, votes + 1]) - np.log(self.on_good[each, votes + 1])).sum(axis=1)
        return 1 / (1 + np.exp(-odds))

    def accuracies(self) -> np.ndarray:
        """How often a labeller that votes is right."""
        right = self.prior * self.on_bad[:, 2] + (1 - self.prior) * self.on_good[:, 0]
        wrong = self.prior * self.on_bad[:, 0] + (1 - self.prior) * self.on_good[:, 2]
        return right / (right + wrong)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, start_accuracy: float = 0.85) -> LabelModel:
    """Expectation maximisation over vote patterns and how many documents have each."""
    k = patterns.shape[1]
    each = np.arange(k)
    guess = np.clip(((patterns == BAD) * start_accuracy + (patterns == GOOD) * (1 - start_accuracy)).sum(axis=1) / np.maximum((patterns != NONE).sum(axis=1), 1), 0.02, 0.98)
    # One confident labeller is a reason for doubt even where the others see nothing.
    bad = np.where((patterns == BAD).any(axis=1), np.maximum(guess, start_accuracy), guess)
    model = None
    for _ in range(rounds):
        weight = np.stack((bad * counts, (1 - bad) * counts))
        tables = np.full((2, k, 3), 0.5)
        for side in range(2):
            for j in each:
                tables[side, j] += np.bincount(patterns[:, j] + 1, weights=weight[side], minlength=3)
        prior = (weight[0].sum() + 0.5) / (counts.sum() + 1)
        tables[:, :, 1] = 0
        tables /= tables.sum(axis=2, keepdims=True)
        tables[:, :, 1] = 1
        model = LabelModel(float(prior), tables[0], tables[1])
        new = model.posterior(patterns)
        if np.abs(new - bad).max() < 1e-7:
            break
        bad = new
    return model


def features(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashed features of each row: its distinct words, its rare signs, its votes."""
    n = len(p.words.offsets) - 1
    votes = votes_of(p.measures)
    sign_at = np.flatnonzero(_RARE_SIGN[p.words.data])
    sign_rows = np.searchsorted(p.words.offsets, sign_at, "right") - 1
    # Votes weigh more than words: each stands under several features.
    vote_rows = np.repeat(np.arange(n), votes.shape[1] * VOTE_FEATURES)
    vote_ids = (np.arange(votes.shape[1]) * 3 + votes + 1).astype(np.uint64)[:, :, None]
    vote_ids = (vote_ids * np.uint64(VOTE_FEATURES) + np.arange(VOTE_FEATURES, dtype=np.uint64)).ravel()
    mask = np.uint64((1 << HASH_BITS) - 1)
    keys = np.concatenate((
        p.hashes & mask,
        T.mix(p.words.data[sign_at].astype(np.uint64) + np.uint64(1 << 20)) & mask,
        T.mix(vote_ids + np.uint64(1 << 30)) & mask,
    ))
    rows = np.concatenate((p.words.rows(), sign_rows, vote_rows))
    both = np.unique(rows.astype(np.uint64) << np.uint64(HASH_BITS) | keys)
    return np.searchsorted(both >> np.uint64(HASH_BITS), np.arange(n + 1)), (both & mask).astype(np.int32)


@dataclass(frozen=True)
class Scorer:
    """Logistic regression on hashed features."""

    weights: np.ndarray
    bias: float

    def score(self, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weights[ids], dtype=np.float64)))
        z = (total[offsets[1:]] - total[offsets[:-1]]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_scorer(
    rows: list[np.ndarray], target: np.ndarray, epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-3, batch: int = 32, least: int = 10
) -> Scorer:
    """Adaptive stochastic gradients on the posterior labels. Features that fewer than ``least`` of
    the rows have keep the weight 0."""
    weights = np.zeros(1 << HASH_BITS)
    squares = np.full(1 << HASH_BITS, 1e-8)
    bias, bias_square = 0.0, 1e-8
    if len(rows):
        frequent = np.bincount(np.concatenate(rows), minlength=1 << HASH_BITS) >= least
        rows = [r[frequent[r]] for r in rows]
    rng = np.random.default_rng(17)
    order = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            picked = order[at : at + batch]
            lengths = np.array([len(rows[i]) for i in picked])
            ids = np.concatenate([rows[i] for i in picked])
            row = np.repeat(np.arange(len(picked)), lengths)
            z = np.bincount(row, weights=weights[ids], minlength=len(picked)) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[picked]) / len(picked)
            slope = np.bincount(ids, weights=error[row], minlength=0)
            used = np.unique(ids)
            g = slope[used] + decay * weights[used]
            squares[used] += g * g
            weights[used] -= rate * g / np.sqrt(squares[used])
            total = float(error.sum())
            bias_square += total * total
            bias -= rate * total / np.sqrt(bias_square)
    return Scorer(weights.astype(np.float32), bias)


def any_trait(posteriors: dict[str, np.ndarray]) -> np.ndarray:
    """The probability that a document has at least one of the traits."""
    return 1 - np.prod([1 - p for p in posteriors.values()], axis=0)


@dataclass(frozen=True)
class Classifier:
    """A label model for each trait, and the scorer that their posteriors trained."""

    labels: dict[str, LabelModel]
    scorer: Scorer
    marks: np.ndarray | None = None

    def judge(self, p: Piece) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Scores, rejections, and the posterior of each trait. Rejected is what the scorer finds bad,
        and also what the labellers are sure of, where the scorer has seen too few cases of a kind. All
        labellers of toxicity look at listed words, so that of one such word they can't be sure."""
        votes = votes_of(p.measures)
        posteriors = {t: m.posterior(votes[:, columns_of(t)]) for t, m in self.labels.items()}
        score = self.scorer.score(*features(p))
        sure = posteriors | {"toxic": np.where(p.measures["insult_kinds"] > 1, posteriors["toxic"], 0.0)}
        return score, (score >= THRESHOLD) | (any_trait(sure) >= SURE), posteriors


def learn_marks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_rows: int = LABEL_ROWS) -> np.ndarray:
    """Sorted hashes of words that stand out in documents labelled toxic, whatever their language, from
    the ``label_rows`` labels of least key hash; (key, quality, toxic). Documents of poor quality that
    are not toxic count for neither side."""
    given = labels.where((F.col("toxic") == 1) | (F.col("quality") == 1)).groupBy(labels[key].alias("labelled")).agg(F.max("toxic").alias("toxic"))
    given = given.where(F.col("labelled").isNotNull()).orderBy(F.xxhash64("labelled"), "labelled").limit(label_rows)
    frame = docs.join(F.broadcast(given), docs[key] == given["labelled"]).select(given["toxic"].cast("long").alias("doc_id"), docs[text].alias("text"))

    def words_in(piece: pa.RecordBatch) -> dict:
        toxic = piece.column(0).to_numpy().astype(bool)
        words = T.words_of(piece.column(1), T.ALNUM)
        h, rows = words.hashes(), words.rows()
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])][: len(h)]
        found, at = np.unique(h[new], return_inverse=True)
        n = np.bincount(at, minlength=len(found))
        bad = np.bincount(at, weights=toxic[rows[new]], minlength=len(found)).astype(np.int64)
        # The word 0 stands for the documents themselves.
        return {"word": np.r_[0, found.view(np.int64)], "bad": np.r_[toxic.sum(), bad], "n": np.r_[len(toxic), n]}

    counted = T.map_texts(frame, "doc_id", "text", "word long, bad long, n long", words_in).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    stood = counted.where((F.col("bad") >= MARK_DOCUMENTS) & ((F.col("word") == 0) | (F.col("bad") >= MARK_PURITY * F.col("n"))))
    top = stood.orderBy(F.col("word") != 0, F.desc("bad"), "word").limit(MARKS + 1).collect()
    least = MARK_SPREAD * sum(r["bad"] for r in top if r["word"] == 0)
    found = np.array([r["word"] for r in top if r["word"] != 0 and r["bad"] >= least], np.int64).view(np.uint64)
    return np.setdiff1d(found, _INSULT)


def fit(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7, marks: np.ndarray | None = None) -> Classifier | None:
    """Labels from the votes on all documents; the scorer from at most ``sample_rows`` of them; ``marks``
    from ``learn_marks``. None for an empty table."""
    frame = docs.select(F.lit(0).alias("doc_id"), docs[text].alias("text"))

    def patterns(piece: pa.RecordBatch) -> dict:
        found, n = np.unique(votes_of(measure(piece.column(1), marks).measures), axis=0, return_counts=True)
        return {"votes": [row.tobytes() for row in found], "n": n}

    counted = T.map_texts(frame, "doc_id", "text", "votes binary, n long", patterns).groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    total = sum(r["n"] for r in counted)
    if not total:
        return None
    width = sum(len(x) for x in LABELLERS.values())
    votes = np.frombuffer(b"".join(bytes(r["votes"]) for r in counted), np.int8).reshape(-1, width)
    counts = np.array([r["n"] for r in counted], np.float64)
    labels = {}
    for trait in TRAITS:
        own, at = np.unique(votes[:, columns_of(trait)], axis=0, return_inverse=True)
        labels[trait] = fit_labels(own, np.bincount(at.ravel(), weights=counts))

    def learn(piece: pa.RecordBatch) -> dict:
        p = measure(piece.column(1), marks)
        offsets, ids = features(p)
        return {
            "votes": [row.tobytes() for row in votes_of(p.measures)],
            "ids": [ids[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)],
        }

    picked = frame.where(F.rand(seed) < min(1.0, sample_rows / total)) if total > sample_rows else frame
    sample = T.map_texts(picked, "doc_id", "text", "votes binary, ids binary", learn).limit(sample_rows).collect()
    rows = [np.frombuffer(bytes(r["ids"]), np.int32) for r in sample]
    seen = np.frombuffer(b"".join(bytes(r["votes"]) for r in sample), np.int8).reshape(-1, width)
    target = any_trait({t: m.posterior(seen[:, columns_of(t)]) for t, m in labels.items()})
    return Classifier(labels, fit_scorer(rows, target), marks)


def score_documents(docs: DataFrame, classifier: Classifier | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, rejected, and the posterior of each trait); the score is the probability of being bad."""
    schema = f"{key} {{key}}, score double, rejected boolean, " + ", ".join(f"p_{t} double" for t in TRAITS)
    if classifier is None:
        return T.map_texts(docs.limit(0), key, text, schema, lambda piece: {})
    held = docs.sparkSession.sparkContext.broadcast(classifier)

    def work(piece: pa.RecordBatch) -> dict:
        score, rejected, posteriors = held.value.judge(measure(piece.column(1), held.value.marks))
        return {key: piece.column(0), "score": score, "rejected": rejected, **{f"p_{t}": x for t, x in posteriors.items()}}

    return T.map_texts(docs, key, text, schema, work)


def keep_good(docs: DataFrame, classifier: Classifier | None, text: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    if classifier is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(classifier)
    return T.filter_texts(docs, text, lambda texts: ~held.value.judge(measure(texts, held.value.marks))[1])
