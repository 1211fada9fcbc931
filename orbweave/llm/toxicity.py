"""Toxicity: restore disguised words with a noisy channel, then score the restored text.

A disguised word (digits or signs for letters, separators between letters, letters repeated) is a lattice: each sign may
stand for some letters, a separator or a repeat may be dropped. Viterbi search finds the reading of highest channel plus
character language model probability. The restored words and their openings are looked up in a table of log odds that
was counted from labelled rows, and a logistic function of a document's evidence is its score.

Fitting without a fold uses whole tables. The character model needs no labels: it counts the words of every text.
Features and the logistic function, which is fitted by sums that Spark makes, use all labelled rows (one for each text
and label, so that copies count once). With a fold (op6's contract) all three use the labelled rows that are not held
out, all of them. Scoring covers all rows.

Defined cases: null and empty texts have no evidence and get the lowest score; labels that are null or of unknown
doc_ids are not used; repeated rows come back once each; a null doc_id is scored (it is never a training row); other
columns are ignored; without any usable label every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textscan import give_back, slices, text_bytes
from .workspace import materialize

#: Entries after which a task hands on its partial counts.
MOST_ENTRIES = 300_000
#: Signs of words whose grams are counted at once, about.
GRAM_SIGNS = 1 << 17
#: Labels that are broadcast at the most.
MOST_SENT = 1 << 20
#: A feature counts from so many different toxic texts, and from this log odds.
LEAST_TEXTS, LEAST_ODDS = 4, 2.5
OPENINGS = (4, 5, 6)
ORDER = 4

#: Letters that a sign may stand for (fixed values).
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l"}
#: Log costs of the channel: a sign for a letter, a dropped separator, a dropped repeat.
SIGN_COST, DROP_COST, REPEAT_COST = -1.5, -0.3, -1.0
_EDGES = ".,;:!?\"'()[]{}*#%&~<>«»…-_/\\"
#: Signs at edges that stand for no letter.
_PLAIN_EDGES = "".join(x for x in _EDGES if x not in STANDS_FOR)
#: Three or more single letters with white space between them, or a sign.
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_REPEAT, _LONG_REPEAT = re.compile(r"(\w)\1"), re.compile(r"(\w)\1\1")


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    grams: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (-20.0, 0.0, 0.0, 0.0)


def longest_grams(words: dict[str, int]) -> Counter:
    """Character grams of ORDER letters; '^' and '$' mark word ends."""
    counts: Counter = Counter()
    some, size = [], 0
    for w in words:
        some.append(w)
        size += len(w) + ORDER
        if size > GRAM_SIGNS:
            _count_grams(counts, some, words)
            some, size = [], 0
    _count_grams(counts, some, words)
    return counts


def _count_grams(counts: Counter, some: list[str], words: dict[str, int]) -> None:
    if not some:
        return
    text = "".join(["^" * (ORDER - 1) + w + "$" for w in some])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(int(codes.max()) + 1, bool)
    used[codes] = True
    codes, letters = (np.cumsum(used) - 1)[codes], int(used.sum())
    # A word has one gram for each of its letters and one for its end.
    n = np.array([len(w) + 1 for w in some])
    at = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * (ORDER - 1), n)
    key, span = codes[at], letters
    for j in range(1, ORDER):
        if span * letters >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            span = len(key)
        key, span = key * letters + codes[at + j], span * letters
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    total = np.add.reduceat(np.repeat([words[w] for w in some], n)[order], first)
    for a, c in zip(at[order[first]].tolist(), total.tolist(), strict=True):
        counts[text[a : a + ORDER]] += c


def all_grams(longest: dict[str, int]) -> Counter:
    """Grams of up to ORDER letters: each is the end of those of ORDER letters that stand at its place."""
    counts: Counter = Counter()
    for g, n in longest.items():
        for k in range(ORDER):
            counts[g[k:]] += n
    return counts


def gram_odds(counts: dict[str, int]) -> dict[str, float]:
    """Log probabilities of the last letter of each gram."""
    total: Counter = Counter()
    for g, n in counts.items():
        total[g[:-1]] += n
    return {g: math.log(n / (total[g[:-1]] + 1)) for g, n in counts.items()}


def gram_model(words: dict[str, int]) -> dict[str, float]:
    return gram_odds(all_grams(longest_grams(words)))


def letter_score(grams: dict[str, float], context: str, letter: str) -> float:
    """Log probability with stupid backoff: each shorter context costs a factor of 0.4."""
    back = 0.0
    for k in range(len(context), -1, -1):
        found = grams.get(context[len(context) - k :] + letter)
        if found is not None:
            return found + back
        back += math.log(0.4)
    return back - 12.0


def decode_word(word: str, grams: dict[str, float], edges: tuple[int, int] = (0, 0)) -> str:
    """The most probable letters behind a disguised word: exact Viterbi search over contexts of ORDER - 1 letters.

    No state is left out: the contexts that the last signs can make are few, whatever the length.

    Of the first edges[0] and last edges[1] signs each may be punctuation, which costs nothing. A space is a separator
    or ends a word. Readings are kept as links to what they go on from, so time is linear in the length.
    """
    start = "^" * (ORDER - 1)
    beam: dict[tuple[str, str], tuple[float, tuple]] = {(start, ""): (0.0, ())}
    for i, c in enumerate(word):
        step: dict[tuple[str, str], tuple[float, tuple]] = {}

        def offer(key, score, text, step=step):
            if key not in step or step[key][0] < score:
                step[key] = (score, text)

        options = [(c, 0.0)] if c.isalpha() else [(x, SIGN_COST) for x in STANDS_FOR.get(c, "")]
        drop = 0.0 if i < edges[0] or i >= len(word) - edges[1] else DROP_COST - (2.0 if c in STANDS_FOR else 0.0)
        for (context, last), (score, text) in beam.items():
            for letter, cost in options:
                offer((context[1:] + letter, letter), score + cost + letter_score(grams, context, letter), (text, letter))
            if not c.isalpha():
                offer((context, last), score + drop, text)
            elif c == last:
                offer((context, last), score + REPEAT_COST, text)
            if c == " " and context != start:
                offer((start, ""), score + DROP_COST + letter_score(grams, context, "$"), (text, " "))
        beam = step
    if not beam:
        return word
    _, text = max(((score + letter_score(grams, context, "$"), text) for (context, _), (score, text) in beam.items()), key=lambda x: x[0])
    letters = []
    while text:
        text, letter = text
        letters.append(letter)
    return "".join(reversed(letters))


def is_known(word: str, grams: dict[str, float]) -> bool:
    """Whether the gram model has all grams of ORDER letters of a word."""
    s = "^" * (ORDER - 1) + word + "$"
    return all(s[i : i + ORDER] in grams for i in range(len(s) - ORDER + 1))


def restore_word(word: str, grams: dict[str, float], kept: dict[str, str]) -> str:
    """The word without signs at its edges, decoded if it looks disguised (kept: what was decoded before)."""
    core, wide = word.strip(_EDGES), word.strip(_PLAIN_EDGES)
    if not any(x.isalpha() for x in core) or (core == wide and core.isalpha() and not _REPEAT.search(core)):
        return core
    found = kept.get(wide)
    if found is None:
        if len(kept) > 100_000:
            kept.clear()
        if core == wide and core.isalpha() and not _LONG_REPEAT.search(core) and is_known(core, grams):
            found = core
        else:
            found = decode_word(wide, grams, (len(wide) - len(wide.lstrip(_EDGES)), len(wide) - len(wide.rstrip(_EDGES))))
        kept[wide] = found
    return found


def restore_run(run: str, grams: dict[str, float]) -> str:
    """The words behind letters that are spaced out."""
    return decode_word(" ".join(run.split()), grams) if any(x.isalpha() for x in run) else run


def restored_words(text: str, grams: dict[str, float], kept: dict[str, str], plain: set[str] | None = None) -> set[str]:
    """Distinct lower-case words of the restored text (kept: readings found before; plain: words found to need none)."""
    text = text.lower()
    plain = set() if plain is None else plain
    if len(kept) > 100_000:
        kept.clear()
    if len(plain) > 100_000:
        plain.clear()
    words = set(text.split())
    out = words & plain
    for x in words - out:
        found = kept.get(x)
        if found is None:
            if x.isalpha() and not _REPEAT.search(x):
                plain.add(x)
                found = x
            else:
                found = kept[x] = restore_word(x, grams, kept)
        out.add(found)
    for run in _SPACED.findall(text):
        out.update(restore_run(run, grams).split())
    return out


def restored_text(text: str, grams: dict[str, float], kept: dict[str, str]) -> str:
    """The lower-case text with every disguised word replaced by its reading."""
    text = _SPACED.sub(lambda m: restore_run(m[0], grams), text.lower())
    return re.sub(r"\S+", lambda m: m[0] if m[0].isalpha() and not _REPEAT.search(m[0]) else restore_word(m[0], grams, kept) or m[0], text)


def features(word: str) -> list[str]:
    return [word] + ["^" + word[:n] for n in OPENINGS if len(word) > n]


def evidence(words: set[str], odds: dict[str, float], known: dict[str, float], blank: set[str]) -> tuple[float, float, float]:
    """Sum and maximum of the words' log odds (each word its best feature), and the share of words that have any.

    What was found before is in known, and in blank where it is nothing.
    """
    if len(blank) > 150_000:
        blank.clear()
    found = []
    for w in words - blank:
        e = known.get(w)
        if e is None:
            e = max([odds.get(f, 0.0) for f in features(w)])
            if not e:
                blank.add(w)
                continue
            if len(known) > 150_000:
                known.clear()
            known[w] = e
        found.append(e)
    return min(math.fsum(found), 60.0), max(found, default=0.0), len(found) / max(1, len(words))


def _gram_rows(grams: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"gram": pa.array(list(grams), pa.string()), "n": pa.array(list(grams.values()), pa.int64())})


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of grams of ORDER letters."""
    raw: Counter = Counter()
    grams: Counter = Counter()

    def settle() -> None:
        words: Counter = Counter()
        for x, n in raw.items():
            if (w := x.strip(_EDGES)).isalpha():
                words[w] += n
        raw.clear()
        grams.update(longest_grams(words))

    for _, column in slices(batches, 0):
        for t in text_bytes(column):
            raw.update(t.decode().lower().split())
        if len(raw) > MOST_ENTRIES:
            settle()
        if len(grams) > MOST_ENTRIES:
            yield _gram_rows(grams)
            grams.clear()
    settle()
    yield _gram_rows(grams)
    give_back()


def _feature_rows(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    found = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_pydict({"feature": pa.array(found, pa.string()), "clean": pa.array([counts[0][f] for f in found], pa.int64()), "toxic": pa.array([counts[1][f] for f in found], pa.int64())})


def _count_features(grams: dict[str, float]) -> Callable:
    """Partial counts of clean and toxic texts that have a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, str] = {}
        plain: set[str] = set()
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch, _ in slices(batches, 0):
            for t, y in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counts[y].update({f for w in restored_words(t.decode(), grams, kept, plain) for f in features(w)})
            if len(counts[0]) + len(counts[1]) > MOST_ENTRIES:
                yield _feature_rows(counts)
                counts = (Counter(), Counter())
        yield _feature_rows(counts)

    return run


def _evidence_rows(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, plain, known, blank = {}, set(), {}, set()
        for batch, _ in slices(batches, 0):
            rows = [evidence(restored_words(t.decode(), model.grams, kept, plain), model.odds, known, blank) for t in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*(pa.array([float(r[i]) for r in rows], pa.float64()) for i in range(3)), batch.column(1)], names=["total", "most", "share", "toxic"])

    return run


def logistic(rows: DataFrame, names: list[str], target: str) -> tuple[float, ...]:
    """Weights (constant first) of a ridge logistic regression by Newton steps.

    Spark sums gradient and Hessian over all rows in whole numbers, so the weights do not depend on how rows are dealt.
    """
    x = [F.lit(1.0), *(F.col(n) for n in names)]
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    w, ridge = np.zeros(len(x)), np.diag([0.01] + [0.1] * len(names))
    whole = lambda c: F.sum(F.round(c * float(1 << 40)).cast("long").cast("decimal(20,0)"))
    for _ in range(25):
        z = sum((F.lit(float(w[i])) * x[i] for i in range(1, len(x))), F.lit(float(w[0])))
        made = rows.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
        p = F.col("p")
        sums = made.agg(*(whole(c * (F.col(target) - p)) for c in x), *(whole(x[i] * x[j] * p * (1 - p)) for i, j in pairs)).first()
        sums = np.array([float(v or 0) for v in sums]) / (1 << 40)
        hessian = np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, sums[len(x) :], strict=True):
            hessian[i, j] = hessian[j, i] = v
        step = np.linalg.solve(hessian + ridge, sums[: len(x)] - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fold: bool = True) -> Model:
    """Fit on all texts and all labelled rows; with fold, on all labelled rows that are not held out.

    Of a doc_id with several labels, the largest counts.
    """
    rule = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    digest = F.sha1(F.coalesce("text", F.lit(""))).alias("digest")
    learnt = ~held_out() if fold else F.lit(True)
    rule = rule.filter(learnt)
    # Up to so many labels go to the texts; beyond that, both meet in a shuffle.
    rule = F.broadcast(rule) if rule.count() <= MOST_SENT else rule
    train = docs.filter(learnt).select("doc_id", "text", digest).join(rule, "doc_id").dropDuplicates(["digest", "toxic"])
    train = materialize(train.select("text", "toxic"), "toxicity-training")
    # Grams of ORDER letters: the driver gets the alphabet's, not the texts'.
    grams = (train if fold else docs).select("text").mapInArrow(_count_words, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    model = Model(grams=gram_odds(all_grams({r[0]: r[1] for r in grams.collect()})))
    size = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return Model(grams=model.grams)
    counts = train.mapInArrow(_count_features(model.grams), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (size[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (size[0] + 1.0))
    strong = counts.filter(F.col("toxic") >= LEAST_TEXTS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    model.odds = {r[0]: r[1] for r in strong.select("feature", "odds").collect()}
    rows = materialize(train.mapInArrow(_evidence_rows(model), "total double, most double, share double, toxic int"), "toxicity-evidence")
    model.weights = logistic(rows, ["total", "most", "share"], "toxic")
    return model


def _scorer(model: Model, restored: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, plain, known, blank = {}, set(), {}, set()
        for batch, column in slices(batches, 1):
            texts = [t.decode() for t in text_bytes(column)]
            x = np.array([evidence(restored_words(t, model.grams, kept, plain), model.odds, known, blank) for t in texts], float).reshape(len(texts), 3)
            score = 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30)))
            out = {"doc_id": batch.column(0), "held_out": batch.column(2), "score": score, "predicted": (score >= 0.7).astype(np.int32)}
            if restored:
                out["restored"] = [restored_text(t, model.grams, kept) for t in texts]
            yield pa.RecordBatch.from_pydict(out)

    return run


def score_documents(docs: DataFrame, model: Model, restored: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score, predicted; with restored, the restored lower-case text."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", held_out())
    return rows.mapInArrow(_scorer(model, restored), "doc_id long, held_out boolean, score double, predicted int" + ", restored string" * restored)


def keep_harmless(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, plain, known, blank = {}, set(), {}, set()
        for batch, column in slices(batches, at):
            texts = [t.decode() for t in text_bytes(column)]
            x = np.array([evidence(restored_words(t, model.grams, kept, plain), model.odds, known, blank) for t in texts], float).reshape(len(texts), 3)
            score = 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30)))
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
