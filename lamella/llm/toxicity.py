"""Toxicity by a weighted finite-state grammar over the clauses of a text."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
#: Words of the grammar: a shortened not belongs to its verb, and a comma is a word.
TOKEN = re.compile(r"[^\W\d_]+n['’]t\b|[^\W\d_]+|,")
CLAUSE_END = re.compile(r"[.!?;:\n]+(?=\s|$)|\n")
#: Closed-class words of the grammar, for the languages of general text.
TARGETS = frozenset("you your yours u he him she her they them du dich dir sie ihr euch tu te toi vous il elle ils tú usted ustedes él ella ellos".split())
SELVES = frozenset("yourself yourselves".split())
NEGATIONS = frozenset("not no never nor isn aren wasn don doesn didn cannot nicht kein keine keinen keiner keinem nie ne pas aucun aucune jamais nunca ni ningún ninguna".split())
REPORTS = frozenset("said says say called calls quoted quote wrote writes allegedly reported sagte nannte dit disait appelé dijo llamó".split())
SPEAKERS = frozenset("i we ich wir je j nous yo nosotros nosotras".split())
THREATS = frozenset("kill hurt beat destroy shoot stab töten umbringen schlagen tuer frapper matar golpear".split())
INTENTS = frozenset("will ll gonna going shall want wanna should must werde wird will vais va voy vamos".split())
CONTRASTS = frozenset("but yet though however sondern aber doch mais sino pero".split())
LINKS = frozenset("or oder noch ou o u".split())
ONLYS = frozenset("only just merely simply nur bloß seulement solo sólo solamente".split())

# Word classes, the input alphabet of the grammar, and what its transducers write in their place.
OTHER, INSULT, THREAT, TARGET, SELF, NEGATION, REPORT, INTENT, CONTRAST, COMMA, SPEAKER, LINK, ONLY = range(13)
DENIED_INSULT, DENIED_THREAT, REPORTED_INSULT, REPORTED_THREAT, MENACE_SAID, MENACE_DENIED, MENACE_REPORTED = range(13, 20)
WORDS = ((COMMA, frozenset(",")), (THREAT, THREATS), (TARGET, TARGETS), (SELF, SELVES), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS), (CONTRAST, CONTRASTS), (SPEAKER, SPEAKERS), (LINK, LINKS), (ONLY, ONLYS))
#: What an insult or threat is in its clause.
PLAIN, AIMED, MENACE, NEGATED, REPORTED = range(5)
#: What each kind makes of a weight. What is denied or reported isn't said: it speaks against
#: toxicity, however heavy the words, so these two aren't learned.
FACTORS = (1.0, 1.25, 1.25, -0.25, -0.25)
#: How many words a denial, a report, an intent and a threat reach, and a first person before a verb of report.
DENIAL, HEARSAY, AIM, FIRST = 3, 8, 3, 2
#: Lengths of the beginnings of words that may be stems.
LENGTHS = range(3, 9)


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: step[state][class] is the next state, out[state][class] what it writes; and what its states stand for."""

    step: list[list[int]]
    out: list[list[int]]
    states: list


def transducer(start: object, move: Callable[[object, int], tuple[object, int]], alphabet: int = 20) -> Transducer:
    """The transducer of a rule ``move`` (state, symbol) -> (state, symbol), over the states met from ``start``."""
    states, order, step, out = {start: 0}, [start], [], []
    for state in order:
        went = [move(state, symbol) for symbol in range(alphabet)]
        for to, _ in went:
            if to not in states:
                states[to] = len(order)
                order.append(to)
        step.append([states[to] for to, _ in went])
        out.append([symbol for _, symbol in went])
    return Transducer(step, out, order)


def denial(left: int, symbol: int) -> tuple[int, int]:
    """A negation governs the first insult or threat in reach; an or behind that carries on, a contrast or comma ends it.

    States: words that the negation still reaches, 0 for none, -1 just behind what it denied.
    """
    if symbol == NEGATION:
        return DENIAL, symbol
    if symbol in (INSULT, THREAT) and left > 0:
        return -1, DENIED_INSULT if symbol == INSULT else DENIED_THREAT
    if left == -1:
        return DENIAL if symbol == LINK else 0, symbol
    if symbol in (CONTRAST, COMMA) or symbol == ONLY and left == DENIAL:
        return 0, symbol
    return max(left - 1, 0), symbol


def hearsay(state: int, symbol: int) -> tuple[int, int]:
    """A verb of report governs the words behind it, up to a contrast, unless the speaker reports himself.

    States: words that the report still reaches; negative, words since a first person.
    """
    if state > 0:
        if symbol == CONTRAST:
            return 0, symbol
        rest = HEARSAY if symbol == REPORT else state - 1
        return rest, {INSULT: REPORTED_INSULT, THREAT: REPORTED_THREAT}.get(symbol, symbol)
    if symbol == SPEAKER:
        return -FIRST, symbol
    if symbol == REPORT:
        return (0 if state < 0 else HEARSAY), symbol
    return min(state + 1, 0), symbol


def threats(state: tuple[int, int, bool, int], symbol: int) -> tuple[tuple[int, int, bool, int], int]:
    """A threat is a menace where somebody intends it and its target follows, or where the reader is to do it to themselves.

    States: words that an intent still reaches; the threat that waits for a target (0: none), whether it is meant, how long it waits.
    """
    intent, waiting, meant, left = state
    if symbol == COMMA:
        return state, symbol
    if symbol in (THREAT, DENIED_THREAT, REPORTED_THREAT):
        return (max(intent - 1, 0), symbol, intent > 0, AIM), symbol
    if waiting and (symbol == TARGET and meant or symbol == SELF and left == AIM):
        said = {THREAT: MENACE_SAID, DENIED_THREAT: MENACE_DENIED, REPORTED_THREAT: MENACE_REPORTED}[waiting]
        return (max(intent - 1, 0), 0, False, 0), said
    intent = AIM if symbol == INTENT else max(intent - 1, 0)
    return ((intent, waiting, meant, left - 1) if left > 1 else (intent, 0, False, 0)), symbol


def target(state: bool, symbol: int) -> tuple[bool, int]:
    """Whether anybody was spoken to or about: the state at the end of the clause tells."""
    return state or symbol in (TARGET, MENACE_SAID, MENACE_DENIED, MENACE_REPORTED), symbol


def compose(parts: list[Transducer]) -> Transducer:
    """Each transducer reads what the one before writes; a state is the tuple of their states."""

    def move(state: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
        to = []
        for part, at in zip(parts, state, strict=True):
            to.append(part.step[at][symbol])
            symbol = part.out[at][symbol]
        return tuple(to), symbol

    return transducer((0,) * len(parts), move, DENIED_INSULT)


def grammar() -> tuple[Transducer, list[bool]]:
    """Insult, threat, target, negation and reported speech as one transducer; for each state, whether there was a target."""
    spoken = transducer(False, target)
    whole = compose([transducer(0, denial), transducer(0, hearsay), transducer((0, 0, False, 0), threats), spoken])
    return whole, [spoken.states[state[-1]] for state in whole.states]


#: Kind of what the grammar writes for an insult or a threat (an insult is aimed if there is a target).
KINDS = {INSULT: PLAIN, DENIED_INSULT: NEGATED, REPORTED_INSULT: REPORTED, MENACE_SAID: MENACE, MENACE_DENIED: NEGATED, MENACE_REPORTED: REPORTED}


@dataclass(frozen=True)
class Model:
    """What was learned, as log-odds: weights of words; beginnings of words, harmless words that begin so.

    ``more`` holds the log-odds of toxicity of a text that has words with listed beginnings: a
    constant, a part for each different one, and a part for every 100 words of the text, since long texts have some
    by chance. ``base`` is the log-odds of toxicity before anything is read.
    """

    words: dict[str, float]
    starts: frozenset[str]
    harmless: frozenset[str]
    more: tuple[float, float, float]
    base: float

    @property
    def heaviest(self) -> float:
        return max([*self.words.values(), *(self.more[1:2] if self.starts else ())], default=0.0)

    def begun(self, n: int, length: int) -> float:
        """What ``n`` different words with listed beginnings add to ``base`` in a text of ``length`` words."""
        return self.more[0] + self.more[1] * n + self.more[2] * length / 100 - self.base


NOTHING = Model({}, frozenset(), frozenset(), (0.0, 0.0, 0.0), math.log(0.01 / 0.99))


def _chance(k: int, n: int, p: float) -> float:
    """The chance of k or more out of n (for k above the mean the first terms are enough)."""
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term, total = math.exp(log_term), 0.0
    for i in range(k, min(n, k + 400) + 1):
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p)
    return min(1.0, total)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 24_000, purity: float = 0.8, doubt: float = 0.01) -> Model:
    """Learns words, beginnings of words and their weights from at most about ``sample`` labelled rows.

    The rows of least hash are taken when there are more. Texts are counted for every word in
    one aggregation. A word met in two or more clean texts, and no oftener in toxic ones, is
    harmless. Beginnings that several of the others share are listed when toxic texts have the
    share ``purity`` of them and chance would rarely do that: the chance, times the number of
    features tried, is below ``doubt``, so no rank or fixed count cuts the vocabulary. Of those
    that begin alike the one with the best balance is kept. Words
    without a listed beginning are insults by the same rule. Of all these, one by one, those are
    kept that explain toxic texts which the ones before don't, so what copies of a text share is
    no insult. Words with listed beginnings
    weigh by how many different ones a text has for its length; the others weigh by themselves, their
    smoothed log-odds of texts. Null labels teach nothing; texts without a label neither;
    without any toxic or any clean row no text is toxic.
    """
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    share = min(1.0, sample / max(marks.count(), 1))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(marks, "doc_id")
    rows = rows.select("text", "toxic").cache()
    try:
        total, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        return _learn(rows, bad, total - bad, purity, doubt) if 0 < bad < total else NOTHING
    finally:
        rows.unpersist()


def _word_counts(rows: DataFrame) -> DataFrame:
    """word, bad, clean: in how many toxic and clean texts each word is."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.iloc[a : a + 256]
                times: tuple[Counter, Counter] = (Counter(), Counter())
                for text, toxic in zip(some["text"], some["toxic"], strict=True):
                    times[toxic].update(set(WORD.findall(text.lower())))
                yield pd.DataFrame([(w, times[1][w], times[0][w]) for w in times[0].keys() | times[1].keys()], columns=["word", "bad", "clean"])

    return rows.mapInPandas(count, "word string, bad long, clean long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))


def _learn(rows: DataFrame, bad: int, clean: int, purity: float, doubt: float) -> Model:
    base = bad / (bad + clean)

    def weight(k: float, n: float) -> float:
        return math.log((k + 0.5) / (bad + 1)) - math.log((n + 0.5) / (clean + 1))

    def sure(counts: DataFrame, tried: int) -> list:
        """The features that chance wouldn't explain; fewer than the sample has words."""
        near = counts.where(F.col("bad") >= purity * (F.col("bad") + F.col("clean")))
        near = near.where(F.col("bad") * -math.log(base) >= math.log(tried / doubt))
        return [r for r in near.collect() if _chance(r["bad"], r["bad"] + r["clean"], base) * tried < doubt]

    words = _word_counts(rows).cache()
    try:
        harmless = (F.col("clean") >= 2) & (F.col("bad") <= F.col("clean"))
        begun = words.where(~harmless).withColumn("n", F.explode(F.array(*map(F.lit, LENGTHS)))).where(F.length("word") > F.col("n"))
        begun = begun.groupBy(F.expr("substring(word, 1, n)").alias("start")).agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"), F.max("bad").alias("most"))
        begun = begun.where("2 * most <= bad")  # one common word makes no beginning
        found = {r["start"]: (r["bad"], r["clean"]) for r in sure(begun, max(begun.where("bad > 0").count(), 1))}
        worth = {f: n - m * purity / (1 - purity) for f, (n, m) in found.items()}
        starts: set[str] = set()
        for f in sorted(found, key=lambda f: (-worth[f], -len(f), f)):
            if not any(f.startswith(g) or g.startswith(f) for g in starts):
                starts.add(f)
        known = rows.sparkSession.createDataFrame([(f,) for f in sorted(starts)], "start string")
        beginning = F.explode(F.array_distinct(F.array(*[F.substring("word", 1, n) for n in LENGTHS])))
        held = words.where(harmless).withColumn("start", beginning).join(F.broadcast(known), "start").select("word").distinct()
        left_out = frozenset(r["word"] for r in held.collect())  # words of the sample with a listed beginning
        insults = {r["word"]: weight(r["bad"], r["clean"]) for r in sure(words, max(words.where("bad > 0").count(), 1))}
        insults = {w: n for w, n in insults.items() if not any(len(w) > len(f) and w.startswith(f) for f in starts)}
    finally:
        words.unpersist()
    model = Model(insults, frozenset(starts), left_out, (0.0, 0.0, 0.0), math.log(bad / clean))
    finder = rows.sparkSession.sparkContext.broadcast(model)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Scorer(finder.value)
        for batch in batches:
            yield pd.DataFrame({"found": [judge.features(t) for t in batch["text"]], "toxic": batch["toxic"]})

    marked = rows.mapInPandas(held, "found array<string>, toxic int").where(F.size("found") > 0)
    sets = [frozenset(r["found"]) for r in marked.where("toxic = 1").select("found").collect()]  # at most the sample
    in_clean = {r["f"]: r["count"] for r in marked.where("toxic = 0").select(F.explode("found").alias("f")).groupBy("f").count().collect()}
    chosen = _explaining(sets, in_clean, bad, clean, purity, doubt)
    model = replace(model, words={w: n for w, n in insults.items() if "=" + w in chosen}, starts=frozenset(starts & chosen))
    if not model.starts:
        return model
    carried = rows.sparkSession.sparkContext.broadcast(model)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Scorer(carried.value)
        for batch in batches:
            found = [WORD.findall(t.lower()) for t in batch["text"]]
            yield pd.DataFrame({"n": [sum(judge.look_up(w) == (INSULT, None) for w in set(words)) for words in found], "length": [len(words) for words in found], "toxic": batch["toxic"]})

    met = rows.mapInPandas(counts, "n int, length int, toxic int").where("n > 0").toPandas()  # three numbers of a text, of the sample
    more = _logistic(np.column_stack([np.ones(len(met)), met["n"], met["length"] / 100]), met["toxic"].to_numpy(dtype=float))
    return replace(model, more=more) if more[1] > 0 else replace(model, starts=frozenset())


def _logistic(x: np.ndarray, toxic: np.ndarray, miss: float = 2.0, ridge: float = 0.05) -> tuple[float, ...]:
    """Weights of the columns of ``x`` by Newton's method; a toxic row missed costs as much as ``miss`` clean ones caught.

    If chance words and meant ones come at steady rates, the log-odds are linear in their number
    and in the length of the text.
    """
    w, cost = np.zeros(x.shape[1]), np.where(toxic == 1, miss, 1.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (cost * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (cost * (toxic - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def _explaining(sets: list[frozenset[str]], in_clean: dict[str, int], bad: int, clean: int, purity: float, doubt: float) -> set[str]:
    """Features chosen one by one, each for the toxic texts that none before it explains.

    What copies of a toxic text merely share with each other explains nothing once their insult is
    chosen. Words that reach half as many toxic texts as the chosen ones do in the middle, and
    no clean text, are taken though others explain their texts.
    """
    where: dict[str, set[int]] = {}
    for i, found in enumerate(sets):
        for f in found:
            where.setdefault(f, set()).add(i)
    price = purity / (1 - purity)
    left, chosen = set(range(len(sets))), set()
    heap = [(in_clean.get(f, 0) * price - len(w), f[0] != "=", f) for f, w in where.items()]
    heapq.heapify(heap)
    while heap:
        cost, start, f = heapq.heappop(heap)
        gain, spoilt = len(where[f] & left), in_clean.get(f, 0)
        now = spoilt * price - gain
        if now >= 0 or gain < 2:
            continue
        if now > cost:
            heapq.heappush(heap, (now, start, f))
            continue
        share = (len(left) + 1) / (len(left) + clean + 1)
        if _chance(gain, gain + spoilt, share) * len(where) < doubt:
            chosen.add(f)
            left -= where[f]
    reach = sorted(len(where[f]) for f in chosen if f[0] == "=")
    enough = reach[len(reach) // 2] / 2 if reach else math.inf
    return chosen | {f for f, w in where.items() if f[0] == "=" and not in_clean.get(f) and len(w) >= enough}


class Scorer:
    """Runs the grammar over the clauses of a text."""

    def __init__(self, model: Model):
        self.model = model
        self.machine, self.aimed = grammar()
        self.lengths = sorted({len(s) for s in model.starts})
        self.known: dict[str, tuple[int, float | None]] = {}

    def classify(self, word: str) -> tuple[int, float | None]:
        """Class and weight; an insult known by its beginning alone has no weight of its own."""
        if word in self.model.words:
            return INSULT, self.model.words[word]
        if word not in self.model.harmless and any(len(word) > n and word[:n] in self.model.starts for n in self.lengths):
            return INSULT, None
        if word[-3:] in ("n't", "n’t"):
            return NEGATION, 0.0
        return next((kind for kind, words in WORDS if word in words), OTHER), 0.0

    def look_up(self, word: str) -> tuple[int, float | None]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[word] = self.classify(word)
        return found

    def features(self, text: str) -> list[str]:
        """The listed words of a text (written ``=word``), and beginnings where it has two words or more with listed ones."""
        words, begun = set(), []
        for w in set(WORD.findall(text.lower())):
            kind, own = self.look_up(w)
            if kind == INSULT and own is not None:
                words.add("=" + w)
            elif kind == INSULT:
                begun.append(next(w[:n] for n in self.lengths if w[:n] in self.model.starts))
        return sorted(words.union(begun if len(begun) > 1 else ()))

    def clauses(self, text: str) -> list[list[tuple[str, int]]]:
        """(word, kind) of the insults and threats of each clause that the grammar accepts; the word of a threat is empty."""
        low = text.lower()
        if not any(self.look_up(w)[0] in (INSULT, THREAT) for w in set(WORD.findall(low))):
            return []
        found, after, step, out = [], 0, self.machine.step, self.machine.out
        for end in (*CLAUSE_END.finditer(low), None):
            state, said = 0, []
            for word in TOKEN.findall(low, after, end.start() if end else len(low)):
                symbol = self.look_up(word)[0]
                kind = KINDS.get(out[state][symbol])
                if kind is not None:
                    said.append((word if symbol == INSULT else "", kind))
                state = step[state][symbol]
            after = end.end() if end else after
            if said:
                whole = MENACE if ("", MENACE) in said else AIMED if self.aimed[state] else PLAIN
                found.append([(word, whole if kind == PLAIN else kind) for word, kind in said])
        return found

    def weigh(self, text: object) -> tuple[float, int]:
        """Score, and number of accepted clauses, of a whole text (null: clean)."""
        clauses = self.clauses(text) if isinstance(text, str) else []
        best: dict[str, float] = {}  # the plainest use of a word counts, wherever it is
        for clause in clauses:
            for word, kind in clause:
                best[word] = max(best.get(word, -1.0), FACTORS[kind])
        z, begun = self.model.base, []
        for word, factor in best.items():
            own = self.look_up(word)[1] if word else self.model.heaviest
            if own is None and factor > 0:
                begun.append(factor)
            else:
                z += factor * abs(self.model.more[1] if own is None else own)
        if begun:
            more = self.model.begun(len(begun), len(WORD.findall(text)))
            z += more * (max(begun) if more > 0 else 1.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(clauses)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, clauses (those the grammar accepts) of every whole text.

    Null and empty texts have no clause and score as clean. A clause runs to the next sentence
    mark or line end, however long. Each word weighs once, by its plainest use in the text, so the
    order of sentences doesn't matter: insults more if aimed at somebody, threats as the heaviest
    insult; a word that is only denied or reported counts against. Repeated
    rows repeat their result; other columns are ignored; an empty table gives an empty result.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, score double, predicted int, clauses int"
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Scorer(carried.value)
        for batch in batches:
            found = [(s, int(s >= 0.5), n) for s, n in map(judge.weigh, batch["text"])]
            out = pd.DataFrame(found, columns=["score", "predicted", "clauses"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns.

    Null and empty texts stay; rows that repeat share their fate; an empty table stays empty.
    """
    carried = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Scorer(carried.value)
        for batch in batches:
            yield pd.Series([judge.weigh(t)[0] for t in batch], dtype="float64")

    return docs.where(scored(F.col(text_col)) < 0.5)
