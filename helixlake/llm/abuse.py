"""Problem 10: abusive, hateful and sexual language in mail.

Each message is decoded, disguised words are restored by the noisy-channel lattice (``lattice``), and the restored passages (subject
and sentences) are scored by a log-linear model over phrases of one to three words and pairs of word classes.

The model is learned from the review labels.  They judge whole messages, so it is a noisy-or over a message's passages: a message
offends if one of its passages does, and a reviewer names the category with probability ``1 - MISS`` if it does and ``SLIP`` if not.
Weights are the posterior mode under normal priors.  The priors' means are the only knowledge that doesn't come from the labels: terms
of the lexicon, and general words of each language (``CLASSES``, of which none is taken from a corpus), speak for a category, more so
where they meet *you*, a people or a threat.  Labels move every weight either way, so that harmless uses (*the idiot light*) lose it.
Where a message's label is explained by one passage the others, often a thread's, get no credit for it.

After a first fit the words of offending phrases join the lexicon of the lattice, so that their disguises are undone as well, and the
model is fitted again on the restored text.

The fit takes every labelled document: up to ``ON_DRIVER`` of them on the driver (``Local``), more by the cluster (``Cluster``), with
the same model but for the order of sums.  There the driver holds the model alone: words, suspect phrases and weights.  Scoring streams
every document; model and lexicon travel in the task closure.

Null or empty texts score as harmless.  Null or unknown labels count as a review that named nothing.  With no labels the priors alone
decide, with no terms the general words.  Empty tables give empty results.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm import mail
from helixlake.llm.lattice import HOMOGLYPHS, Restorer, join_spaced
from helixlake.runtime import broadcast_if_small, stored

CATEGORIES = ("abusive", "hateful", "sexual")
#: Labelled documents, and characters of theirs, up to which the driver fits the model; more are fitted by the cluster.
ON_DRIVER, ON_DRIVER_CHARACTERS = 12_000, 48_000_000
#: Bound on the terms of the lexicon, which is kept by every task.
MAX_TERMS = 100_000
#: Log odds from which on a document is found, and those of a passage that nothing speaks for.
THRESHOLD, BIAS = 0.0, -6.0
#: Probability that a reviewer doesn't name a category that holds, and that one is named that doesn't.
MISS, SLIP = 0.12, 0.04
#: Labelled documents that a phrase needs to get a weight, and the log likelihood ratio from which on it can make a passage suspect.
SUPPORT, SUSPECT = 2, 7.0
#: Precision of the weights' priors and what each ordinary passage that holds the phrase adds to it, steps of the fit and their length.
SHRINK, ORDINARY, STEPS, RATE = 0.05, 0.02, 120, 0.15

# General words of each class in English, German, Spanish and French.
CLASSES = {
    "a": """idiot idiots fool fools stupid moron morons bastard bastards bitch asshole jerk dumb imbecile cretin scum arschloch blödmann dummkopf
        trottel estúpido estúpida imbécil gilipollas cabrón tonto stupide imbécile connard salaud abruti""",
    "s": """sex sexy nude nudes naked porn porno horny erotic orgasm blowjob boobs tits pussy cock dick fuck nackt nackte ficken geil
        desnuda desnudo desnudas follar nue nues nu baiser""",
    "g": """immigrants migrants refugees foreigners muslims jews christians hindus blacks whites gays lesbians arabs africans asians gypsies
        ausländer flüchtlinge juden moslems inmigrantes extranjeros judíos moros immigrés étrangers juifs arabes""",
    "k": """kill murder shoot stab strangle hang beat rape hurt punch kick burn exterminate exterminated deport deported umbringen töten schlagen
        verbrennen matar golpear quemar tuer frapper brûler""",
    "v": """vermin parasites parasite rats cockroaches animals filth trash plague subhuman subhumans inferior thieves criminals dirty ungeziefer
        untermenschen dreck alimañas basura ladrones escoria vermine racaille voleurs ordures""",
    "y": "you your yourself u ur du dich dir dein deine deinen tú te ti tu tus toi ton ta tes vous",
    "i": "i we ich wir yo je j nous",
}
OBJECTS = frozenset("you u dich te ti toi vous".split())
#: Prior means of phrases and of pairs of classes, by category.
PRIORS: dict[str, dict[tuple[str, ...], float]] = {
    "abusive": {("<a>",): 2.6, ("&", "a", "y"): 3.5, ("&", "k", "y"): 2.5, ("&", "k", "object"): 3.0, ("&", "i", "k"): 1.0},
    "hateful": {("<h>",): 4.0, ("&", "g", "v"): 6.5, ("&", "g", "k"): 5.0, ("&", "h", "v"): 2.0, ("&", "h", "k"): 2.0},
    "sexual": {("<s>",): 2.5, ("&", "s", "y"): 3.0, ("&", "i", "s"): 1.0},
}

#: Look-alikes count as letters of a word, signs that also end sentences only between two of its letters.
TOKEN = re.compile(r"[\w@$*|€]+(?:[!+#(<]+[\w@$*|€]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’)]*\s+|\n[ \t]*\n|\x00")
_QUOTE = re.compile(r"^[ \t>|]+", re.M)
_TIGHT = re.compile(r"\w[ .\-_]\w[ .\-_]\w\b")
_SENDER = re.compile(r"^From:[^\r\n]*?([^\s<>\"]+@[^\s<>\"]+)", re.M | re.I)
_PLACE = {f"<{c}>": c for c in "ahsg"}
Phrase = tuple[str, ...]


def passages(text: str | None) -> list[str]:
    """Subject and sentences of a message, quotation marks of lines removed, homoglyphs mapped, lower case."""
    subject, parts = mail.decode(text)
    whole = "\x00".join([subject, *parts])
    if not whole.isascii():
        whole = whole.translate(HOMOGLYPHS)
    if _TIGHT.search(whole):
        whole = join_spaced(whole)
    return _SENTENCE.split(_QUOTE.sub("", whole).lower())


class Labelled(NamedTuple):
    """A reviewed message: its text, the number of its reviews and how many of them named each category."""

    text: str | None
    reviews: int
    named: tuple[int, int, int]


def _ratios(labelled: list[Labelled]) -> np.ndarray:
    """For each message and category the log likelihood ratio by its reviews."""
    votes = np.array([x.named for x in labelled], float).reshape(-1, len(CATEGORIES))
    reviews = np.maximum(votes.max(axis=1, initial=0), np.array([x.reviews for x in labelled], float))[:, None]
    return votes * np.log((1 - MISS) / SLIP) + (reviews - votes) * np.log(MISS / (1 - SLIP))


def _sender(text: str | None) -> str | None:
    return m.group(1).lower() if (m := _SENDER.search(text or "")) else None


def _bounds(rate: float) -> tuple[float, float]:
    """What a phrase's message with the category, and one without it, adds to the phrase's log likelihood ratio."""
    base = min(0.35, max(0.02, 1.3 * rate))
    return float(np.log((1 - MISS) / base)), float(np.log(MISS / (1 - base)))


class Block(NamedTuple):
    """Passages (``row``) with their phrases (``col``), messages (``doc``) with their passages, and the messages' odds by their reviews."""

    row: np.ndarray
    col: np.ndarray
    doc: np.ndarray
    passage: np.ndarray
    odds: np.ndarray

    @classmethod
    def of(cls, cells: list[tuple[int, int]], seen: list[tuple[int, int]], ratio: np.ndarray | list[float]) -> Block:
        (row, col), (doc, passage) = np.array(cells).T, np.array(seen).T
        return cls(row, col, doc, passage, np.exp(np.clip(ratio, -30, 30)))

    def gradient(self, w: np.ndarray) -> np.ndarray:
        """Of the log likelihood, by weight; that of several blocks is the sum."""
        row, col, doc, passage, odds = self
        n = int(passage.max()) + 1
        q = 1 / (1 + np.exp(-np.clip(BIAS + np.bincount(row, w[col], n), -30, 30)))
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(q, 1 - 1e-12))[passage], len(odds)))
        slope = (odds - 1) / (odds * (1 - none) + none) * none
        up = np.bincount(passage, slope[doc] * q[passage], n)
        return np.bincount(col, up[row], len(w))


def _weights(start: np.ndarray, mean: np.ndarray, shrink: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The posterior mode; every weight has its own step, so that those of several categories may be fitted together."""
    w, m, v = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, STEPS + 1):
        grad = gradient(w) - shrink * (w - mean)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
    return w


class Fitted(NamedTuple):
    """Of each category the suspect phrases and the weights of all phrases of passages that hold one; messages by phrase."""

    suspects: list[set[Phrase]]
    weights: list[dict[Phrase, float]]
    total: Callable[[set[Phrase]], Mapping[Phrase, int]]


class Local:
    """Labelled messages in the driver's memory."""

    def __init__(self, labelled: list[Labelled]) -> None:
        self.labelled = labelled
        self.texts = [passages(x.text) for x in labelled]

    def __len__(self) -> int:
        return len(self.labelled)

    def words(self, known: set[str]) -> Mapping[str, int]:
        """Messages by word: of all words, here of those beside ``known`` and letters as well."""
        counts: Counter[str] = Counter()
        for ps in self.texts:
            counts.update({w for p in ps for w in TOKEN.findall(p)})
        return counts

    def learn(self, model: Model) -> Fitted:
        memo: dict[str, frozenset[Phrase]] = {}
        docs: list[list[frozenset[Phrase]]] = []
        for ps in self.texts:
            for p in ps:
                if p not in memo:
                    memo[p] = model.phrases(model.tokens(p))
            docs.append([memo[p] for p in dict.fromkeys(ps) if memo[p]])
        senders = [_sender(x.text) or f"message {k}" for k, x in enumerate(self.labelled)]
        total: Counter[Phrase] = Counter()
        for d in docs:
            total.update(frozenset().union(*d))
        ratios = _ratios(self.labelled)
        learned = [self._learn(docs, senders, total, ratios[:, c], PRIORS[category]) for c, category in enumerate(CATEGORIES)]
        return Fitted([x for x, _ in learned], [w for _, w in learned], lambda _: total)

    @staticmethod
    def _elsewhere(docs: list[list[frozenset[Phrase]]], senders: list[str], k: Counter[Phrase]) -> set[Phrase]:
        """Phrases that stand in ``SUPPORT`` messages beside those of the sender who uses them most: a signature stands in its owner's mail."""
        by: dict[str, Counter[Phrase]] = {}
        for d, sender in zip(docs, senders, strict=True):
            by.setdefault(sender, Counter()).update(frozenset().union(*d))
        most: dict[Phrase, int] = {}
        for own in by.values():
            for g, n in own.items():
                if n > most.get(g, 0):
                    most[g] = n
        return {g for g, n in most.items() if k[g] - n >= SUPPORT}

    @classmethod
    def _learn(cls, docs: list[list[frozenset[Phrase]]], senders: list[str], total: Counter[Phrase], ratio: np.ndarray, prior: dict[Phrase, float]) -> tuple[set[Phrase], dict[Phrase, float]]:
        positive = ratio > 0
        yes, no = _bounds(positive.mean() if len(docs) else 0.0)
        chosen = [k for k, x in enumerate(positive) if x]
        named: Counter[Phrase] = Counter()
        for k in chosen:
            named.update(frozenset().union(*docs[k]))
        spread = cls._elsewhere([docs[k] for k in chosen], [senders[k] for k in chosen], named)
        suspect = {g for g, k in named.items() if g in spread and k * yes + (total[g] - k) * no >= SUSPECT} | set(prior)
        ordinary: Counter[Phrase] = Counter()
        at: dict[frozenset[Phrase], int] = {}
        column: dict[Phrase, int] = {}
        cells: list[tuple[int, int]] = []
        seen: list[tuple[int, int]] = []
        for k, d in enumerate(docs):
            for p in d:
                if p.isdisjoint(suspect):
                    ordinary.update(p)
                else:
                    if p not in at:
                        at[p] = len(at)
                        cells += [(at[p], column.setdefault(g, len(column))) for g in p if total[g] >= SUPPORT or g in prior]
                    seen.append((k, at[p]))
        if not seen or not cells:
            return suspect, {}
        mean = np.array([prior.get(g, 0.0) for g in column])
        shrink = np.array([SHRINK + ORDINARY * ordinary[g] for g in column])
        # From a flat start no passage stands out.
        start = np.array([0.5 if g in suspect and g not in prior else prior.get(g, 0.0) for g in column])
        w = _weights(start, mean, shrink, Block.of(cells, seen, ratio).gradient)
        return suspect, {g: float(w[j]) for g, j in column.items()}


class Cluster:
    """Labelled messages as a table of the shared folder: words and phrases are counted by shuffles, gradients are summed over blocks of messages."""

    def __init__(self, rows: DataFrame) -> None:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labelled = [Labelled(text, n, tuple(named)) for text, n, *named in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield _batch(
                    sender=pa.array([_sender(x.text) for x in labelled], pa.string()),
                    ratio=pa.array(_ratios(labelled).tolist(), pa.list_(pa.float64())),
                    passages=pa.array([list(dict.fromkeys(passages(x.text))) for x in labelled], pa.list_(pa.string())),
                )

        mails = rows.select("text", "n", *CATEGORIES).mapInArrow(read, "sender string, ratio array<double>, passages array<string>")
        number = F.concat(F.lit("message "), F.monotonically_increasing_id().cast("string"))
        self.mails = stored(mails.withColumn("sender", F.coalesce("sender", number)))
        self.size, *named = self.mails.agg(F.count(F.lit(1)), *[F.sum((F.col("ratio")[c] > 0).cast("long")) for c in range(len(CATEGORIES))]).first()
        self.bounds = [_bounds((k or 0) / max(1, self.size)) for k in named]

    def __len__(self) -> int:
        return self.size

    def words(self, known: set[str]) -> Mapping[str, int]:
        """Messages by word, of ``known`` words and of those of letters that stand in two messages."""

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [w for ps in batch.column(0).to_pylist() for w in {w for p in ps for w in TOKEN.findall(p)} if w.isalpha() or w in known]
                yield _batch(word=pa.array(words, pa.string()), known=pa.array([w in known for w in words], pa.bool_()))

        counts = self.mails.select("passages").mapInArrow(split, "word string, known boolean").groupBy("word", "known").agg(F.count(F.lit(1)).alias("k"))
        return {r["word"]: r["k"] for r in counts.where("known OR k >= 2").toLocalIterator()}

    def learn(self, model: Model) -> Fitted:
        categories = range(len(CATEGORIES))
        priors = [PRIORS[c] for c in CATEGORIES]

        def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens = [[t for p in ps if (t := model.tokens(p))] for ps in batch.column(2).to_pylist()]
                yield _batch(sender=batch.column(0), ratio=batch.column(1), passages=pa.array(tokens, pa.list_(pa.list_(pa.string()))))

        mails = stored(self.mails.mapInArrow(tokenise, "sender string, ratio array<double>, passages array<array<string>>"))
        phrases = model.phrases

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Every phrase of every message."""
            for batch in batches:
                for sender, ratio, ps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if found := [" ".join(g) for g in frozenset().union(*map(phrases, ps))]:
                        yield _batch(phrase=pa.array(found), sender=pa.array([sender] * len(found)), **{f"n{c}": pa.array([int(ratio[c] > 0)] * len(found), pa.int64()) for c in categories})

        own = mails.mapInArrow(held, "phrase string, sender string, " + ", ".join(f"n{c} long" for c in categories)).groupBy("phrase", "sender")
        own = own.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"n{c}").alias(f"n{c}") for c in categories]).groupBy("phrase")
        counts = stored(own.agg(F.sum("n").alias("total"), *[f(f"n{c}").alias(f"{a}{c}") for c in categories for f, a in ((F.sum, "named"), (F.max, "most"))]))
        suspects: list[set[Phrase]] = []
        for c, (yes, no) in enumerate(self.bounds):
            likely = F.col(f"named{c}") * yes + (F.col("total") - F.col(f"named{c}")) * no >= SUSPECT
            rows = counts.where((F.col(f"named{c}") - F.col(f"most{c}") >= SUPPORT) & likely).select("phrase").toLocalIterator()
            suspects.append({tuple(r["phrase"].split(" ")) for r in rows} | set(priors[c]))

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Every phrase of every passage, and the categories of which the passage holds a suspect."""
            for batch in batches:
                for ps in batch.column(0).to_pylist():
                    cells = [(" ".join(g), *hit) for found in map(phrases, ps) for hit in [[int(not x.isdisjoint(found)) for x in suspects]] for g in found]
                    if cells:
                        phrase, *hits = zip(*cells, strict=True)
                        yield _batch(phrase=pa.array(phrase), **{f"n{c}": pa.array(hits[c], pa.int64()) for c in categories})

        columns = mails.select("passages").mapInArrow(marked, "phrase string, " + ", ".join(f"n{c} long" for c in categories)).groupBy("phrase")
        columns = columns.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"n{c}").alias(f"n{c}") for c in categories]).where(" OR ".join(f"n{c} > 0" for c in categories))
        columns = columns.join(counts.select("phrase", "total"), "phrase").where((F.col("total") >= SUPPORT) | F.col("phrase").isin([" ".join(g) for p in priors for g in p]))
        column: list[dict[Phrase, int]] = [{} for _ in categories]
        mean, shrink, start = [], [], []
        for r in columns.toLocalIterator():
            g = tuple(r["phrase"].split(" "))
            for c in categories:
                if r[f"n{c}"] and (r["total"] >= SUPPORT or g in priors[c]):
                    column[c][g] = len(mean)
                    mean.append(priors[c].get(g, 0.0))
                    shrink.append(SHRINK + ORDINARY * (r["n"] - r[f"n{c}"]))
                    start.append(0.5 if g in suspects[c] and g not in priors[c] else mean[-1])

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells: list[tuple[int, int]] = []
                seen: list[tuple[int, int]] = []
                ratios: list[float] = []
                for ratio, ps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = list(map(phrases, ps))
                    for c in categories:
                        if hits := [x for x in found if not x.isdisjoint(suspects[c])]:
                            for x in hits:
                                cells += [(len(seen), j) for g in x if (j := column[c].get(g)) is not None]
                                seen.append((len(ratios), len(seen)))
                            ratios.append(ratio[c])
                if cells:
                    yield _batch(block=pa.array([pickle.dumps(tuple(Block.of(cells, seen, ratios)))], pa.binary()))

        sc = mails.sparkSession.sparkContext
        parts = stored(mails.select("ratio", "passages").mapInArrow(blocks, "block binary")).rdd.map(lambda r: Block(*pickle.loads(r[0]))).persist(StorageLevel.MEMORY_AND_DISK)

        def gradient(w: np.ndarray) -> np.ndarray:
            sent = sc.broadcast(w)
            out = parts.treeAggregate(np.zeros(len(w)), lambda total, block: total + block.gradient(sent.value), np.add)
            sent.destroy()
            return out

        w = _weights(np.array(start), np.array(mean), np.array(shrink), gradient) if start else np.zeros(0)
        parts.unpersist()

        def total(of: set[Phrase]) -> Mapping[Phrase, int]:
            wanted = mails.sparkSession.createDataFrame([(" ".join(g),) for g in of], "phrase string")
            return Counter({tuple(r["phrase"].split(" ")): r["total"] for r in counts.join(wanted, "phrase").select("phrase", "total").toLocalIterator()})

        return Fitted(suspects, [{g: float(w[j]) for g, j in x.items()} for x in column], total)


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


class Model:
    """Weights of phrases by category, and the restorer of the words that they use."""

    def __init__(self, terms: list[tuple[str, str]], labelled: list[Labelled] | Cluster) -> None:
        #: Words that stand for their class, and classes that a word has beside being itself.
        self.classes = {w: f"<{c}>" for c in "asg" for w in CLASSES[c].split()}
        self.beside = {w: c for c in "kvyi" for w in CLASSES[c].split()}
        for term, category in terms:
            if category in (*CATEGORIES, "group"):
                self.classes[term.lower()] = f"<{category[0]}>"
        corpus = Local(labelled) if isinstance(labelled, list) else labelled
        known = set(self.classes) | set(self.beside)
        counts = corpus.words(known)
        #: Ordinary words: frequent ones of the labelled messages that aren't digits; the rest are names or disguises.
        self.common = {w for w, k in counts.items() if k >= 5 and w.isalpha()} | {w for w in known if w.isalpha()}
        ordinary = {w: float(k) for w, k in counts.items() if w.isalpha() and k >= 2} or {"the": 1.0, "and": 1.0}
        lexicon = {w: 1.0 + 0.1 * counts.get(w, 0) ** 0.5 for w in known if len(w) > 2 and w not in CLASSES["i"].split()}
        self.restorer = Restorer(lexicon, ordinary)
        self.seen: dict[str, str] = {}
        self._fit(corpus)
        if len(corpus):
            words = {x for g, w in self.weights.items() if g[0] != "&" and max(w) >= 0.7 for x in g if x[0] != "<" and len(x) > 3 and x.isalpha()}
            self.restorer = Restorer(lexicon | {x: 1.0 + 0.1 * counts.get(x, 0) ** 0.5 for x in words}, ordinary)
            self.seen = {}
            self._fit(corpus)
        self.seen, self.restorer.memo = {}, {}

    def _fit(self, corpus: Local | Cluster) -> None:
        fitted = corpus.learn(self)
        weights: dict[Phrase, list[float]] = {}
        for c, category in enumerate(CATEGORIES):
            for g, w in (PRIORS[category] | fitted.weights[c]).items():
                weights.setdefault(g, [0.0] * len(CATEGORIES))[c] = w
        self.weights = {g: tuple(w) for g, w in weights.items() if max(map(abs, w)) >= 0.02}
        self.suspects = {g for g in set().union(*fitted.suspects, *PRIORS.values()) if g in self.weights}
        #: Tokens, the words of a pair's rarer class among them, and neighbouring tokens: a passage without any holds no suspect phrase.
        words_of: dict[str, list[str]] = {}
        for w, c in [*self.beside.items(), *_PLACE.items()]:
            words_of.setdefault(c, []).append(w)
        total = fitted.total({(w,) for ws in words_of.values() for w in ws} | {h for g in self.suspects if g[0] != "&" for h in (g[:2], g[-2:])})
        size = {c: sum(total[(w,)] for w in ws) for c, ws in words_of.items()}
        self.starts: set[str] = set()
        self.heads: set[Phrase] = set()
        for g in self.suspects:
            if g[0] == "&":
                self.starts.update(words_of[min((c for c in g[1:] if c in words_of), key=lambda c: (size[c], c))])
            elif len(g) == 1:
                self.starts.add(g[0])
            else:
                self.heads.add(min((g[:2], g[-2:]), key=lambda h: (total[h], h)))

    def tokens(self, passage: str) -> list[str]:
        seen = self.seen
        return [t if (t := seen.get(w)) is not None else self._token(w) for w in TOKEN.findall(passage)]

    def _token(self, w: str) -> str:
        """A word as token: its class, itself, the word that it disguises, or that it is a number or a name."""
        if w in self.common:
            t = self.classes.get(w, w)
        elif w.isdigit():
            return "<9>"
        else:
            found = self.restorer.restore(w)
            t = "<n>" if found is None else self.classes.get(found, found)
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[w] = t
        return t

    def phrases(self, t: list[str]) -> frozenset[Phrase]:
        """Phrases of one to three tokens, pairs of classes, and whether *you* are an act's object."""
        out = {g for n in (1, 2, 3) for g in zip(*(t[k:] for k in range(n)), strict=False)}
        beside = self.beside
        has = sorted({c for w in t if (c := _PLACE.get(w) or beside.get(w))})
        out.update(("&", a, b) for i, a in enumerate(has) for b in has[i + 1 :])
        if "k" in has and any(b in OBJECTS and beside.get(a) == "k" for a, b in zip(t, t[1:], strict=False)):
            out.add(("&", "k", "object"))
        return frozenset(out)

    def evidence(self, t: list[str]) -> list[float]:
        """For each category a passage's log odds; ``BIAS`` if it holds no suspect phrase."""
        if self.starts.isdisjoint(t) and self.heads.isdisjoint(zip(t, t[1:], strict=False)):
            return [BIAS] * len(CATEGORIES)
        found = self.phrases(t)
        if self.suspects.isdisjoint(found):
            return [BIAS] * len(CATEGORIES)
        rows = [w for g in found if (w := self.weights.get(g)) is not None]
        return [BIAS + sum(x) for x in zip(*rows, strict=True)]

    def score(self, text: str | None) -> list[float]:
        """For each category the log odds of the strongest passage."""
        best = [BIAS] * len(CATEGORIES)
        for passage in passages(text):
            if t := self.tokens(passage):
                best = list(map(max, best, self.evidence(t)))
        return best


def fit(documents: DataFrame, labels: DataFrame, terms: DataFrame, on_driver: int = ON_DRIVER) -> Model:
    reviewer = F.coalesce(F.col("reviewer"), F.concat(F.lit("label "), F.col("label_id").cast("string")), F.lit(""))
    votes = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count_distinct(reviewer).cast("int").alias("n"), *[F.count_distinct(F.when(F.col("category") == c, reviewer)).cast("int").alias(c) for c in CATEGORIES]
    )
    rows = stored(documents.select("doc_id", "text").join(broadcast_if_small(stored(votes)), "doc_id"))
    lexicon = terms.select("term", "category").where("term IS NOT NULL").limit(MAX_TERMS + 1).collect()
    if len(lexicon) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")).first()
    if size["n"] <= on_driver and size["characters"] <= ON_DRIVER_CHARACTERS:
        labelled = [Labelled(r["text"], r["n"], tuple(r[c] for c in CATEGORIES)) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]
    else:
        labelled = Cluster(rows)
    return Model(sorted((r["term"], r["category"] or "") for r in lexicon), labelled)


def scores(documents: DataFrame, labels: DataFrame, terms: DataFrame, on_driver: int = ON_DRIVER) -> DataFrame:
    """``(doc_id, source, abusive, hateful, sexual)``: log odds of every document, those of its strongest passage."""
    model = fit(documents, labels, terms, on_driver)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([r[k] for r in rows], pa.float64()) for k in range(len(CATEGORIES))]], ["doc_id", "source", *CATEGORIES]
            )

    return documents.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(run, "doc_id long, source string, " + ", ".join(f"{c} double" for c in CATEGORIES))


def _long(scored: DataFrame) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("evidence")) for c in CATEGORIES]))
    return scored.select("doc_id", "source", cells.alias("c")).select("doc_id", "source", "c.category", "c.evidence")


def document_scores(documents: DataFrame, labels: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc_id, source, category, score)``: three rows a document, the score in 0..1, 0.5 at the threshold."""
    return _long(scores(documents, labels, terms)).withColumn("score", 1 / (1 + F.exp(THRESHOLD - F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("evidence")))))).drop("evidence")


def found(documents: DataFrame, labels: DataFrame, terms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, category)`` of the documents at or over the threshold."""
    return _long(scores(documents, labels, terms)).where(F.col("evidence") >= threshold).select("doc_id", "category")


def rates(documents: DataFrame, labels: DataFrame, terms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(source, category, n_documents, n_found, rate)``; a null source is a source of its own."""
    hits = _long(scores(documents, labels, terms)).groupBy("source", "category")
    return hits.agg(F.count(F.lit(1)).alias("n_documents"), F.sum((F.col("evidence") >= threshold).cast("long")).alias("n_found")).withColumn("rate", F.col("n_found") / F.col("n_documents"))
