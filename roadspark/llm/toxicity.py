"""Toxicity by a weighted finite-state pattern grammar whose lexicon and weights are learned from labels."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Kept, batch, bounded_batches, drop, materialize, texts

#: Labelled rows that the grammar is fitted on at most: those with the smallest hash of their id.
SAMPLE = 20_000
#: Terms that enter the choice of the lexicon at most, the most frequent in toxic texts.
CANDIDATES = 4_000
#: A term enters if so many toxic texts hold it and this share of its texts is toxic.
SUPPORT, PRECISION = 3, 0.9
#: Terms that a task counts before it passes the counts on.
COUNTED = 100_000
#: How often each toxic text should be covered by chosen terms.
DEPTH = 3
#: Lengths of word beginnings that are terms beside whole words, for languages that compound and inflect.
STEMS = (4, 5, 6, 7, 8)

#: Words whose classes a worker keeps.
KEPT = 150_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLOSED_CLASSES = {
    THREAT: "kill hurt destroy beat punch töten schlagen umbringen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours him her them he she they du dich dir ihr euch sie tu toi te vous lui elle eux tú te ti usted ustedes él ella ellos",
    NEGATION: "not no never nobody isn't aren't wasn't don't nicht kein keine nie ne pas jamais aucun ni nunca nadie",
    REPORT: "said says say called wrote quoted according sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según",
}
#: How far, in words, a target or negation reaches an insult or threat.
REACH = 3

_TABLE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 or c == 0x27 else 0x0A if c in b".,;:!?\n()\"" else 0x20
    for c in range(256)
)


def normalised(text: bytes) -> bytes:
    """Lower case; clauses end in line feeds, all else between words is a space."""
    return text.decode("utf-8", "replace").lower().encode().translate(_TABLE)


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: moves[state][symbol] is the next state and the weight on each channel."""

    moves: tuple[tuple[tuple[int, tuple[float, ...]], ...], ...]

    def compose(self, other: "Transducer") -> "Transducer":
        """Both read the same symbols; channels lie side by side."""
        width = len(other.moves)
        return Transducer(
            tuple(
                tuple((p * width + q, v + w) for (p, v), (q, w) in zip(mine, theirs))
                for mine in self.moves
                for theirs in other.moves
            )
        )


def _machine(states: int, step) -> Transducer:
    return Transducer(tuple(tuple((lambda n, w: (n, (w,)))(*step(s, x)) for x in range(6)) for s in range(states)))


def insults() -> Transducer:
    return _machine(1, lambda s, x: (0, float(x == INSULT)))


def threats() -> Transducer:
    """A threat counts once its target follows within reach; the state counts the words since."""
    return _machine(REACH + 1, lambda s, x: (1, 0.0) if x == THREAT else (0, 1.0) if s and x == TARGET else ((s + 1) % (REACH + 1) if s else 0, 0.0))


def near(symbol: int) -> Transducer:
    """Insults within reach after a word of this class."""
    return _machine(REACH + 1, lambda s, x: (1, float(s > 0 and x == INSULT)) if x == symbol else ((s + 1) % (REACH + 1) if s else 0, float(s > 0 and x == INSULT)))


def reported() -> Transducer:
    """Insults anywhere after a verb of reported speech in the clause."""
    return _machine(2, lambda s, x: (int(s or x == REPORT), float(s and x == INSULT)))


def grammar() -> Transducer:
    """The composition; its channels: insults, threats at a target, insults at a target, negated, reported."""
    return insults().compose(threats()).compose(near(TARGET)).compose(near(NEGATION)).compose(reported())


class _Symbols(Kept):
    """The class of each word, and its weight if it is an insult; found when asked for and kept."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon = lexicon
        self.closed = {w.encode(): c for c, names in CLOSED_CLASSES.items() for w in names.split()}

    def __missing__(self, word: bytes) -> tuple[int, float]:
        lexicon = self.lexicon
        weight = max((lexicon[t] for t in terms_of(word) if t in lexicon), default=0.0)
        found = (INSULT, weight) if weight else (self.closed.get(word, OTHER), 0.0)
        self[word] = found
        return found


def terms_of(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings, marked by an asterisk."""
    text = word.decode()
    return [word, *(text[:k].encode() + b"*" for k in STEMS if len(text) >= k)]


N_FEATURES = 5


@dataclass
class Grammar:
    """Lexicon of insults with weights, and the weights of a text's features."""

    lexicon: dict[bytes, float]
    weights: np.ndarray
    _symbols: _Symbols | None = field(default=None, repr=False)
    _machine: Transducer | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights, "_symbols": None, "_machine": None}

    def features(self, text: bytes) -> np.ndarray:
        """1, insulting weight of the clauses (damped if negated or reported, raised at a target), its largest clause,
        insulting clauses for each clause, and threats."""
        if self._symbols is None:
            self._symbols, self._machine = _Symbols(self.lexicon), grammar()
        out = np.zeros(N_FEATURES)
        out[0] = 1
        clean, symbols = normalised(text), self._symbols.ready(KEPT)
        if not {s for s, _ in set(map(symbols.__getitem__, clean.split()))} & {INSULT, THREAT}:
            return out
        total = most = threat = hit = clauses = 0.0
        for clause in clean.split(b"\n"):
            words = clause.split()
            if not words:
                continue
            clauses += 1
            state, insult, moves = 0, 0.0, self._machine.moves
            for w in words:
                symbol, weight = symbols[w]
                state, (rude, menace, aimed, negated, quoted) = moves[state][symbol]
                threat += menace
                if rude:
                    insult += weight * (1.3 if aimed else 1.0) * (0.6 if negated else 1.0) * (0.7 if quoted else 1.0)
            if insult:
                hit, total, most = hit + 1, total + insult, max(most, insult)
        out[1:] = math.log1p(total), math.log1p(most), hit / max(1.0, clauses), math.log1p(threat)
        return out

    def score(self, text: bytes) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.features(text) @ self.weights)))))


def held_out(id_col: str) -> Column:
    """Whether labels of this row are never learned from: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge towards a prior, by Newton steps; classes weigh alike."""
    prior = np.array([-2.0, 1.0, 1.0, 0.0, 1.0])
    w, ridge = prior.copy(), 0.05
    share = y.mean()
    each = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) * (len(y) / 1.0) / len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - y)) + ridge * (w - prior)
        step = np.linalg.solve(x.T @ (x * (each * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _choose(counts: dict[bytes, tuple[int, int]], inside: list[list[bytes]]) -> list[bytes]:
    """Terms that together cover each toxic text up to ``DEPTH`` times, greedily by what they newly cover."""
    texts_of: dict[bytes, list[int]] = {}
    for i, own in enumerate(inside):
        for t in own:
            texts_of.setdefault(t, []).append(i)
    need, chosen = [DEPTH] * len(inside), []
    while texts_of:
        gain = lambda t: sum(need[i] > 0 for i in texts_of[t])
        best = max(texts_of, key=lambda t: (gain(t), -counts[t][1], len(t), not t.endswith(b"*"), t))
        if gain(best) < min(SUPPORT, max(2, len(inside) // 10)):
            break
        chosen.append(best)
        for i in texts_of[best]:
            need[i] -= 1
        stem = best.rstrip(b"*")  # its beginnings and longer forms are the same evidence
        texts_of = {t: own for t, own in texts_of.items() if not (stem.startswith(x := t.rstrip(b"*")) or x.startswith(stem))}
    return chosen


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Grammar:
    """Learn the lexicon and weights from labelled rows that are not held out.

    Terms are words and word beginnings. What is collected is bounded by ``sample`` and ``CANDIDATES``: counts of
    candidate terms, the candidates in toxic texts, and five features of each text. Equal texts count once. Without
    both classes among the labels the grammar knows no insult.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic is not null and doc_id is not null")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").where("text is not null")  # broadcast: at most ``sample`` pairs
    rows = materialize(rows.groupBy(F.sha2("text", 256).alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text"), "labelled")
    schema = pa.schema([("term", pa.binary()), ("bad", pa.int64()), ("good", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}

        def told(least: int) -> Iterator[pa.RecordBatch]:
            for toxic, own in seen.items():
                if len(own) > least:
                    found, zero = list(own), [0] * len(own)
                    yield batch(schema, (found, list(own.values()) if toxic else zero, zero if toxic else list(own.values())))
                    own.clear()

        for b in batches:
            for toxic, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                seen[int(toxic == 1)].update({x for w in set(normalised(t).split()) for x in terms_of(w)})
                yield from told(COUNTED)
        yield from told(0)

    counted = rows.mapInArrow(count, "term binary, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total.get(1) or not total.get(0):
        drop(rows)
        return Grammar({}, np.array([-30.0, 0, 0, 0, 0]))
    support = min(SUPPORT, max(2, total[1] // 10))
    best = counted.where(f"bad >= {support} and bad >= {PRECISION} * (bad + good)").orderBy(F.desc("bad"), "term").limit(CANDIDATES)
    counts = {bytes(r["term"]): (r["bad"], r["good"]) for r in best.collect()}

    inside_schema = pa.schema([("terms", pa.list_(pa.binary()))])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[x for x in {x for w in set(normalised(t).split()) for x in terms_of(w)} if x in counts] for t in texts(b.column(0))]
            yield batch(inside_schema, (found,))

    held = rows.where("toxic = 1").select("text").mapInArrow(inside, "terms array<binary>")
    chosen = _choose(counts, [[bytes(t) for t in r["terms"]] for r in held.toLocalIterator()])
    ratio = total[0] / total[1]
    lexicon = {t: math.log((counts[t][0] + 0.5) / (counts[t][1] + 0.5) * ratio) / 4 for t in chosen}
    made = Grammar(lexicon, np.zeros(N_FEATURES))
    names = [f"f{i}" for i in range(N_FEATURES)]
    features_schema = pa.schema([("toxic", pa.int64()), *((n, pa.float64()) for n in names)])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([made.features(t) for t in texts(b.column(1))]).reshape(-1, N_FEATURES)
            yield batch(features_schema, (b.column(0).cast(pa.int64()), *x.T))

    table = np.array([tuple(r) for r in rows.mapInArrow(describe, "toxic long, " + ", ".join(f"{n} double" for n in names)).toLocalIterator()], float)
    drop(rows)
    table = table[np.lexsort(table.T[::-1])]
    made.weights = _fit_weights(table[:, 1:], (table[:, 0] == 1).astype(float))
    return made


def score_column(grammar_: Grammar, text_col: str) -> Column:
    """The score of each text, from 0 to 1; a null text scores as an empty one."""

    def run(col: pa.Array) -> pa.Array:
        return pa.array([grammar_.score(t) for t in texts(col)], pa.float64())

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType="double")(F.col(text_col).cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    The text alone decides the score. Clauses are read by the composed transducers of insults, threats at a target,
    targets, negation and reported speech; only matched clauses score. Null and empty texts match nothing and get the
    lowest score; repeated rows score alike; a row without doc_id is scored and not held out; an empty table gives an
    empty one.
    """
    made = fit(docs, labels, id_col, text_col, sample)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), score_column(made, text_col).alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
