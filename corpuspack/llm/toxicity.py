"""Toxicity by a weighted grammar of clauses.

Transducers for negation, reported speech and targets are composed into one, which reads
the word classes of a clause and writes which insults and threats are meant, and of whom.
The words of insult are learned from labels, as whole words or as stems; how much each
kind of matched clause tells is a logistic model on the same labels.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Hashable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.common import held_out, map_texts, stage

FOLDS = 5
# At most so many labelled documents of each label, of the smallest hashes, are learned from.
SAMPLE = 20_000
# A stem or word counts if so many more toxic than other documents have it, in proportion,
# and if at least so many toxic ones do.
ODDS = 50
LEAST_DOCUMENTS = 3
# Beyond those needed to explain the toxic documents: of at least this share of them.
COMMON_SHARE = 0.02
STEM_LENGTHS = range(4, 13)
NEGATION_REACH = 3

# Word classes a transducer reads and writes
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oitynr"
# Only written: not meant, said by others, of somebody, and of somebody named later
NEGATED, REPORTED, AIMED, LATER = "dqab"
KINDS = (INSULT, AIMED, LATER, THREAT, NEGATED, REPORTED)

# Fixed word lists, in the languages of the corpus.
TARGETS = frozenset(
    "you your yours he she they du dich dir ihr euch sie er tu toi vous il elle ils tú te usted "
    "ustedes él ella ellos".split()
)
NEGATIONS = frozenset("not no never nicht kein keine nie pas jamais non nunca jamás ni n't".split())
REPORTS = frozenset(
    "said says told quoted reported wrote claimed sagte sagt berichtete zitierte dit disait "
    "rapporte dijo dice informó citó".split()
)
THREATS = frozenset(
    "kill murder hurt destroy töten umbringen vernichten tuer détruire matar destruir".split()
)
_ENDS = ".!?;:,|"
_EDGES = "\"'`.,;:!?()[]{}<>|*#$%&"


@dataclass(frozen=True)
class Transducer:
    """Arcs ``(state, class) -> (state, class written, weight)``; others pass unchanged."""

    start: Hashable
    arcs: dict[tuple, tuple]

    def step(self, state: Hashable, symbol: str) -> tuple[Hashable, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, NEGATED, REPORTED, AIMED, LATER)


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """An insult or threat soon after a negation is not meant."""
    arcs: dict[tuple, tuple] = {}
    for left in range(reach + 1):
        for s in SYMBOLS:
            arcs[left, s] = (max(0, left - 1), s, 1.0)
        arcs[left, NEGATION] = (reach, NEGATION, 1.0)
        if left:
            for s in (INSULT, THREAT):
                arcs[left, s] = (left - 1, NEGATED, 0.5)
    return Transducer(0, arcs)


def reported() -> Transducer:
    """What follows a verb of saying is somebody else's."""
    arcs = {(0, REPORT): (1, REPORT, 1.0)}
    for s in (INSULT, THREAT):
        arcs[1, s] = (1, REPORTED, 0.7)
    return Transducer(0, arcs)


def targeted() -> Transducer:
    """An insult after a target, or before one, is aimed at it."""
    return Transducer(
        0,
        {
            (0, TARGET): (1, TARGET, 1.0),
            (1, INSULT): (1, AIMED, 1.5),
            (1, THREAT): (1, AIMED, 1.5),
            (0, INSULT): (2, INSULT, 1.0),
            (0, THREAT): (2, THREAT, 1.0),
            (2, TARGET): (1, LATER, 0.5),
        },
    )


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` makes of what ``first`` writes, as one transducer."""
    start = (first.start, second.start)
    arcs, todo, known = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            a, middle, weight = first.step(state[0], symbol)
            b, out, more = second.step(state[1], middle)
            arcs[state, symbol] = ((a, b), out, weight * more)
            if (a, b) not in known:
                known.add((a, b))
                todo.append((a, b))
    return Transducer(start, arcs)


def grammar() -> Transducer:
    return compose(compose(negation(), reported()), targeted())


def bare(word: str) -> str:
    """A word without the punctuation around it."""
    return word.strip(_EDGES)


def stems(word: str) -> Iterator[str]:
    """The word itself, ended by a mark, and the stems it begins with."""
    yield word + "$"
    for n in STEM_LENGTHS:
        if n > len(word):
            break
        yield word[:n]


class Classes(dict):
    """From a word as it stands, in lower case, to (class, weight, whether a clause ends)."""

    def __init__(self, lexicon: dict[str, float], most: int = 500_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str) -> tuple[str, float, bool] | None:
        if len(self) >= self.most:
            self.clear()
        plain, end = bare(word), word[-1:] in _ENDS
        kind, weight = OTHER, 1.0
        found = max((self.lexicon[s] for s in stems(plain) if s in self.lexicon), default=None)
        if found is not None:
            kind, weight = INSULT, found
        elif plain in THREATS:
            kind = THREAT
        elif plain in TARGETS:
            kind = TARGET
        elif plain in NEGATIONS:
            kind = NEGATION
        elif plain in REPORTS:
            kind = REPORT
        # nothing to say of most words
        self[word] = entry = None if kind == OTHER and not end else (kind, weight, end)
        return entry


def matched(text: str, classes: Classes, machine: Transducer) -> list[float]:
    """The weights of the matched clauses of a text, summed by ``KINDS``."""
    sums = dict.fromkeys(KINDS, 0.0)
    hit = any(
        c is not None and c[0] in (INSULT, THREAT) for c in map(classes.__getitem__, set(text.split()))
    )
    if hit:
        for line in text.split("\n"):
            state, written = machine.start, []
            for word in line.split():
                kind, lexical, end = classes[word] or (OTHER, 1.0, False)
                state, out, weight = machine.step(state, kind)
                if out in sums:
                    written.append((out, weight * lexical))
                if end:
                    state = machine.start
            for out, weight in written:
                sums[out] += weight
    return [sums[k] for k in KINDS]


def decoded(text: bytes | None) -> str:
    return (text or b"").decode("utf-8", "replace").lower()


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: list[float]  # of 1, of any match, and of KINDS


def _features(sums: np.ndarray) -> np.ndarray:
    any_match = (sums.sum(1) > 0).astype(float)[:, None]
    return np.hstack([np.ones((len(sums), 1)), any_match, np.log1p(sums)])


def _fit(sums: np.ndarray, labels: np.ndarray) -> list[float]:
    """Logistic weights, drawn to what the grammar suggests where labels say little."""
    x = _features(np.asarray(sums, float).reshape(-1, len(KINDS)))
    # of KINDS: an insult, one aimed at somebody, one at somebody named later, a threat,
    # what is not meant, what others say
    prior = np.array([-3.0, 2.0, 3.0, 3.0, 0.5, 0.5, 1.0, 1.0])
    strength = np.array([0.05, 0.05] + [0.3] * len(KINDS))
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (labels - p) - strength * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)  # more of a match never makes a text less toxic
    return w.tolist()


def _sample(labels: DataFrame, size: int) -> DataFrame:
    """Of each label at most ``size`` rows to learn from; conflicting labels count as toxic."""
    rows = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .filter(~held_out(F.col("doc_id"), FOLDS))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    some = [
        rows.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        for label in (0, 1)
    ]
    return some[0].unionByName(some[1])


def _counting(wanted):
    """Documents of a task that have each stem; if given, of wanted stems only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        keep = None if wanted is None else wanted.value
        known: dict[str, list[str]] = {}
        for batch in batches:
            for text in batch.column(0):
                found: set[str] = set()
                for word in set(decoded(text.as_py()).split()):
                    own = known.get(word)
                    if own is None:
                        plain = bare(word)
                        own = [s for s in stems(plain) if keep is None or s in keep] if plain else []
                        if keep is not None and len(known) < 300_000:
                            known[word] = own
                    found.update(own)
                for s in found:
                    counts[s] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["stem", "n"],
        )

    return run


def _count(texts: DataFrame, wanted=None) -> DataFrame:
    counted = texts.select(F.col("text").cast("binary")).mapInArrow(
        _counting(wanted), "stem string, n bigint"
    )
    return counted.groupBy("stem").agg(F.sum("n").alias("n"))


def _covering(
    candidates: dict[str, int], documents: list[list[str]], common: float
) -> list[str]:
    """Stems that explain the toxic documents: the one that most still need, again and again.

    Of equal ones the longest. A stem is not taken on if fewer than three still need it,
    unless it is common by itself.
    """
    having: dict[str, set[int]] = defaultdict(set)
    for i, own in enumerate(documents):
        for s in own:
            having[s].add(i)
    left = set(range(len(documents)))
    taken = []
    rest = {s: set(d) for s, d in having.items()}
    while left and rest:
        best = max(rest, key=lambda s: (len(rest[s]), len(s), s))
        gain = rest.pop(best)
        if len(gain) < LEAST_DOCUMENTS:
            break
        taken.append(best)
        left -= gain
        for s in list(rest):
            rest[s] -= gain
            if len(rest[s]) < LEAST_DOCUMENTS:
                del rest[s]
    chosen = set(taken)
    for s in sorted(candidates, key=len):
        if candidates[s] >= common and not any(s != c and s.startswith(c.rstrip("$")) for c in chosen):
            chosen.add(s)
    return sorted(chosen)


def learn(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Learn insults and weights from labelled documents outside the held-out fold.

    Stems are counted in tasks over toxic documents first; only those common enough, a
    bounded number, are counted over the others.
    """
    spark = documents.sparkSession
    sample = _sample(labels, size)
    texts = stage(
        documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"),
        "toxicity-sample",
    )
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    lexicon: dict[str, float] = {}
    if bad:
        least = max(LEAST_DOCUMENTS, 0.002 * bad)
        toxic_texts, other_texts = texts.filter("toxic = 1"), texts.filter("toxic = 0")
        toxic = {
            r["stem"]: r["n"]
            for r in _count(toxic_texts).filter(F.col("n") >= least).toLocalIterator()
        }
        wanted = spark.sparkContext.broadcast(frozenset(toxic))
        other = {r["stem"]: r["n"] for r in _count(other_texts, wanted).toLocalIterator()}

        def odds(s: str) -> float:
            return ((toxic[s] + 0.5) / (bad + 1)) / ((other.get(s, 0) + 0.5) / (good + 1))

        # a stem of few documents can't reach the odds where there are few others either
        telling = {
            s: n for s, n in toxic.items() if odds(s) >= min(ODDS, good * n / (bad + 1)) and odds(s) > 4
        }
        held = spark.sparkContext.broadcast(frozenset(telling))

        def prepare():
            def compute(found):
                words = [{s for w in set(decoded(t).split()) for s in stems(bare(w))} for t in found]
                return [["\t".join(sorted(w & held.value)) for w in words]]

            return compute

        rows = map_texts(toxic_texts, "text", (), "stems string", prepare)
        lists = [r["stems"].split("\t") if r["stems"] else [] for r in rows.toLocalIterator()]
        chosen = _covering(telling, lists, max(2 * LEAST_DOCUMENTS, COMMON_SHARE * bad))
        lexicon = {s: min(3.0, math.log(odds(s)) / math.log(ODDS)) for s in chosen}
    sums = _matched(texts, lexicon, ("toxic",)).toPandas()
    weights = _fit(sums[list(KINDS)].to_numpy(), sums["toxic"].to_numpy(float))
    return Model(lexicon, weights)


def _matched(documents: DataFrame, lexicon: dict[str, float], keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and the weights of matched clauses of each whole text, by kind."""
    held = documents.sparkSession.sparkContext.broadcast(lexicon)

    def prepare():
        classes, machine = Classes(held.value), grammar()

        def compute(texts):
            return list(zip(*[matched(decoded(t), classes, machine) for t in texts]))

        return compute

    return map_texts(documents, "text", keep, ", ".join(f"{k} double" for k in KINDS), prepare)


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the ``score`` from 0 to 1, and ``clauses``, the weight of all matches."""
    rows = _matched(documents, model.lexicon, keep)
    total = sum((F.col(k) for k in KINDS), F.lit(0.0))
    logit = F.lit(model.weights[0]) + F.lit(model.weights[1]) * (total > 0).cast("double")
    for kind, weight in zip(KINDS, model.weights[2:]):
        logit = logit + F.lit(weight) * F.log1p(kind)
    return rows.select(*keep, (1 / (1 + F.exp(-logit))).alias("score"), total.alias("clauses"))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, clauses`` of every document.

    Only the text is an input of a score. Null and empty texts match nothing and get the
    score of a text without matches. Without labels, the grammar's own weights hold. Equal
    rows get equal scores; of a document's several labels, toxic holds.
    """
    model = learn(documents, labels)
    return score(documents, model).select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "clauses",
    )
