"""Toxicity by a weighted finite-state pattern grammar.

Transducers are composed over the words of a clause: a lexicon of insults (words and stems, learned from labels) and one of
threats; intent, which makes a threat of a mere verb; negation and reported speech, which take weight away; targets, which
add some on either side. A clause weighs what its path through the composition weighs, a document the sum of its matched
clauses, not of single words. The weights of the arcs start from those of the grammar and are fitted to the labels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, discard, saved, small_batches, text_views
from .transducers import Transducer, lexicon, scope
from .words import mix, prefix_sums, range_hash, shingles, spans

# Fixed word lists of the grammar.
VERBS = {
    "en": "kill hurt destroy beat stab shoot burn strangle punish murder slap choke".split(),
    "de": "töten umbringen schlagen verletzen ermorden erwürgen".split(),
    "fr": "tuer frapper brûler détruire étrangler poignarder".split(),
    "es": "matar golpear quemar destruir lastimar apuñalar".split(),
}
#: Endings that take the place of the infinitive's, by language and infinitive.
ENDINGS = {
    "de": {"en": "en e st est t et te ten test end".split()},
    "fr": {"er": "er e es ons ez ent é ée és ais ait aient erai eras era erons erez eront ant".split(), "re": "re s t sons sez sent rai ras ra rons rez ront".split()},
    "es": {"ar": "ar o as a amos áis an é aste ó aron aba ado ando aré arás ará aremos arán".split(), "ir": "ir yo yes ye yen í yó iré irás irá irán ido yendo".split()},
}
IRREGULAR = "beaten shot burnt schlägt schlägst schlug geschlagen umgebracht umbringe umbringt bringe".split()
INTENTS = "will ll gonna going shall should must want werde wirst wird werden soll sollte muss will vais vas va allons devrait doit veux voy vamos debe quiero".split()
TARGETS = "you your yours yourself u he she him her they them these those people everyone du dich dir dein deine ihr euch sie tu te toi ton ta vous votre ils elles tú ti usted ustedes ellos ellas".split()
NEGATIONS = "not no never none neither nor isn aren wasn weren don doesn didn won cannot without nicht nie kein keine keinen ohne pas jamais aucun aucune sans nunca jamás ningún ninguna sin".split()
REPORTS = "said says say saying told tells wrote writes written quoted quote quotes called calls reported reports claims claimed according sagte sagt schrieb laut nannte dit disait écrit selon dijo dice escribió según".split()
REPORTED = frozenset(REPORTS)
#: What may open a quotation after a word of reporting or a colon, and close it.
QUOTES = "\"“”„«»‟"
#: Arcs that weigh, and the weights that they start from; lexicon: times the weight of the entry that matched.
ARCS = ("insult", "lexicon", "threat", "intended", "negated", "reported", "aimed")
PRIOR = (1.0, 2.0, 0.0, 1.5, -1.0, -1.0, 1.5)
BIAS = -2.0

#: Bytes of texts that are hashed together.
PART = 1 << 19
STEMS = (4, 5, 6, 7)  # characters
SEPARATOR = np.ones(256, bool)
SEPARATOR[128:] = False
SEPARATOR[[*range(ord("a"), ord("z") + 1)]] = False
#: What stands between words besides ASCII, for the hashes of bytes.
MARKS = r"[^\x00-\x7F\p{L}\p{M}]"
WORDS = regex.compile(r"[\p{L}\p{M}]+")
TOKENS = regex.compile(rf"[\p{{L}}\p{{M}}]+|[,:{QUOTES}]")
CLAUSE = regex.compile(r"([.!?;\n…‒–—―]+|--+| - )")


def inflected(language: str, verb: str) -> set[str]:
    """The forms of a regular verb."""
    if language == "en":
        cut = verb.removesuffix("e")
        double = verb + verb[-1] if len(verb) == 4 and verb[-1] in "bp" and verb[-2] in "aeiou" else cut
        return {verb, f"{verb}es" if verb.endswith(("sh", "ss")) else f"{verb}s", f"{double}ing", f"{double}ed"}
    old = next(x for x in ENDINGS[language] if verb.endswith(x))
    stem = verb[: -len(old)]
    return {stem + x for x in ENDINGS[language][old]} | ({f"ge{stem}t", f"ge{stem}et"} if language == "de" else set())


THREATS = frozenset(IRREGULAR).union(*(inflected(k, v) for k, vs in VERBS.items() for v in vs))


def marked(kinds: Sequence[str], word: str) -> dict[str, str]:
    return {k: f"{word} {k}" for k in kinds}


def grammar(entries: dict[str, float], weight: Callable[[str], Any]) -> tuple[Transducer, Transducer]:
    """The composition for a clause's symbols, and the shorter one for the reversed clause, whose targets follow what they
    are the target of. entries: symbols of the insult lexicon and their weights; weight: of an arc by its name."""
    insults = lexicon({x: ("insult", weight("insult") + w * weight("lexicon")) for x, w in entries.items()})
    threats = lexicon({x: ("threat", weight("threat")) for x in THREATS})
    openers = lexicon({x: (tag, 0.0) for tag, words in (("TGT", TARGETS), ("INT", INTENTS), ("NEG", NEGATIONS), ("REP", REPORTS)) for x in words})
    kinds = ["insult", "threat", "intended threat"]
    tagged = insults.then(threats).then(openers)
    aimed = lambda ks: scope("TGT", marked(ks, "aimed"), 4, weight("aimed"), ":")
    backward = tagged.then(aimed(["insult", "threat"]))
    forward = tagged.then(scope("INT", {"threat": "intended threat"}, 4, weight("intended"), ",:"))
    for opener, word, reach, closer in (("NEG", "negated", 3, ",:"), ("REP", "reported", 12, "")):
        forward = forward.then(scope(opener, marked(kinds, word), reach, weight(word), closer))
        kinds += [f"{word} {k}" for k in kinds]
    return forward.then(aimed(kinds)), backward


@dataclass
class Model:
    """A fitted grammar: the lexicon's words and stems with weights in (0, 1], and the weights of the arcs."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: Sequence[float] = PRIOR
    bias: float = BIAS

    def __post_init__(self):
        self.entries = self.words | {f"{k}*": w for k, w in self.stems.items()}
        self.listed = {*self.words, *THREATS, *TARGETS, *INTENTS, *NEGATIONS, *REPORTS, ",", ":"}
        hashes = lambda xs: np.unique(np.concatenate([np.zeros(0, np.uint64), *(hash_of(x) for x in xs)]))
        self.word_hashes = hashes([*self.words, *THREATS])
        self.stem_hashes = {k: hashes([x for x in self.stems if len(x) == k]) for k in STEMS}
        self.weighed(self.weights, self.bias)

    def weighed(self, weights: Sequence[float], bias: float) -> Model:
        self.weights, self.bias = weights, bias
        self.machine = grammar(self.entries, dict(zip(ARCS, weights, strict=True)).__getitem__)
        return self

    def symbol(self, word: str) -> str:
        """The grammar's symbol of a word: itself, the heavier of its entry and its stems', or - for other words."""
        best = max(((self.stems[word[:k]], f"{word[:k]}*") for k in STEMS if len(word) > k and word[:k] in self.stems), default=(0.0, ""))
        if best[0] > self.words.get(word, 0.0):
            return best[1]
        return word if word in self.listed else "-"

    def clauses(self, text: str, machine: tuple[Transducer, Transducer], aimed: Any) -> list[tuple[str, Any, str]]:
        """Kinds, weight and words of each matched clause of a text in lower case. A quotation that follows a word of reporting
        or a colon is reported up to its closing mark, over all its clauses within a paragraph."""
        out, inside = [], False
        quoted = any(q in text for q in QUOTES)
        pieces = CLAUSE.split(text)
        for clause, end in zip(pieces[::2], [*pieces[1::2], ""], strict=True):
            words = TOKENS.findall(clause)
            symbols, opened = ([REPORTS[0]] if inside else []), 0
            for w in words:
                if w not in QUOTES:
                    opened = 2 if w in REPORTED or w == ":" else max(opened - (w != ","), 0)
                    symbols.append(self.symbol(w))
                elif inside:
                    inside = False
                    symbols.append("END")
                elif opened:
                    inside = True
                    symbols.append(REPORTS[0])
            inside = inside and quoted and "\n" not in end
            if not any(x in self.entries or x in THREATS for x in symbols):
                continue
            ahead, back = machine[0].run(symbols), machine[1].run(reversed(symbols))[::-1]
            kinds, total = [], 0.0
            for (kind, weight), (mirrored, _) in zip(ahead, back, strict=True):
                if kind.endswith(("insult", "threat")):
                    if mirrored.startswith("aimed") and not kind.startswith("aimed"):
                        kind, weight = f"aimed {kind}", weight + aimed
                    kinds.append(kind)
                    total = total + weight
            if kinds:
                out.append((", ".join(dict.fromkeys(kinds)), total, clause.strip()))
        return out

    def features(self, text: str) -> np.ndarray:
        """How often a text in lower case takes each arc, before they have weights."""
        axes = dict(zip(ARCS, np.eye(len(ARCS)), strict=True))
        if not hasattr(self, "plain"):
            self.plain = grammar(self.entries, axes.__getitem__)
        return sum((w for _, w, _ in self.clauses(text, self.plain, axes["aimed"])), np.zeros(len(ARCS)))

    def score(self, weight: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + weight))))

    def near(self, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Texts in lower case, and which of them have a word of the lexicon: those are read closely."""
        low = pc.utf8_lower(text.fill_null(""))
        body, at = text_views(pc.replace_substring_regex(low, MARKS, " "))
        return low, np.flatnonzero(self.hits(body, at))

    def batch(self, text: pa.Array) -> tuple[list[list[str]], np.ndarray]:
        """Matched clauses and scores of a batch."""
        low, near = self.near(text)
        found: list[list[str]] = [[] for _ in range(len(text))]
        scores = np.full(len(text), self.score(0.0))
        aimed = dict(zip(ARCS, self.weights, strict=True))["aimed"]
        for i in near:
            matched = self.clauses(low[int(i)].as_py(), self.machine, aimed)
            found[i] = [f"{kinds} ({weight:.2f}): {clause}" for kinds, weight, clause in matched]
            scores[i] = self.score(sum(w for _, w, _ in matched))
        return found, scores

    def hits(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts have a word of the lexicon."""
        begin, end, first = spans(body, at, SEPARATOR)
        sums = prefix_sums(body)
        hit = np.isin(range_hash(sums, begin, end), self.word_hashes)
        chars = np.concatenate([np.flatnonzero((body & 0xC0) != 0x80), [len(body)] * (max(STEMS) + 1)])
        number = np.searchsorted(chars, begin)
        for k in STEMS:
            cut = chars[np.minimum(number + k, len(chars) - 1)]
            here = np.flatnonzero((cut < end) & ~hit)
            if len(self.stem_hashes[k]):
                hit[here] = np.isin(range_hash(sums, begin[here], cut[here]), self.stem_hashes[k])
        total = np.concatenate([[0], np.cumsum(hit)])
        return total[first[1:]] > total[first[:-1]]


def hash_of(word: str) -> np.ndarray:
    body = np.frombuffer(word.encode(), np.uint8)
    return range_hash(prefix_sums(body), np.zeros(1, np.int64), np.asarray([len(body)]))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 20_000, support: int = 4, clean: float = 0.05) -> Model:
    """Learns the lexicon and the weights from labelled rows that are not held out.

    most: at most so many labelled rows are learned from, those with the least hash of their key; nothing else is limited.
    Of texts that share one of three sketches (least hashes of three words, as near copies do) one is counted, the one
    with the least key. A word or stem is an entry if at least `support` toxic texts have it, at most a `clean` part of
    those that have it are not toxic, and less than one of all words tried would do so well by chance. Null keys, texts
    and labels and texts without words are left out; a label over 0 is toxic; a key with several labels has the highest,
    and each of the rows that repeat a key is learned from. Without toxic or clean rows the lexicon is empty and the
    weights stay the grammar's own. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    rows = rows.groupBy(F.col(key).cast("long").alias("id")).agg(F.max((F.col(label).cast("int") > 0).cast("int")).alias("toxic"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(most)  # `most` rows of two numbers
    body = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    known = saved(body.join(F.broadcast(sample), "id").select("id", "toxic", "text"), "known")

    def sketch(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text", PART):
                chars, at = text_views(pc.replace_substring_regex(pc.utf8_lower(batch.column("text")), MARKS, " "))
                begin, end, first = spans(chars, at, SEPARATOR)
                code, first = shingles(range_hash(prefix_sums(chars), begin, end), first, 3)
                has = np.flatnonzero(np.diff(first))
                least = [[int(mix(code[first[i] : first[i + 1]] ^ np.uint64(salt)).min().view(np.int64)) for i in has] for salt in (0xA5A5A5A5, 0x5A5A5A5A, 0x3C3C3C3C)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(has)), batch.column("toxic").take(pa.array(has)), *(pa.array(x, pa.int64()) for x in least)], ["id", "toxic", "s1", "s2", "s3"])

    one = known.mapInArrow(sketch, "id long, toxic int, s1 long, s2 long, s3 long")
    for s in ("s1", "s2", "s3"):
        one = one.groupBy(s, "toxic").agg(F.min_by(F.struct(*(x for x in one.columns if x not in (s, "toxic"))), "id").alias("x")).select("toxic", s, "x.*")

    def count(batches):
        found: Counter = Counter()
        for whole in batches:
            for batch in by_bytes(whole, "text", PART):
                for toxic, body_ in zip(batch.column("toxic").to_pylist(), pc.utf8_lower(batch.column("text")).to_pylist(), strict=True):
                    words = set(WORDS.findall(body_))
                    found.update((w, toxic) for w in words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k} | {""})
                if len(found) > 150_000:
                    yield table(found)
                    found = Counter()
        yield table(found)

    def table(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n if t else 0 for (_, t), n in found.items()], pa.int64()), pa.array([0 if t else n for (_, t), n in found.items()], pa.int64())], ["term", "t", "c"])

    apart = known.join(F.broadcast(one.select("id").distinct()), "id", "left_semi")  # `most` numbers at most
    counts = saved(apart.select("toxic", "text").mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter("t + c > 1"), "terms")
    tried = max(1, counts.count())
    # Every entry stands in several of the `most` texts, which bounds what is collected.
    found = {r.term: (r.t, r.c) for r in counts.filter(f"term = '' or t >= {support} and c <= {clean} * (t + c)").collect()}
    toxic, plain = found.pop("", (0, 0))
    base = toxic / max(1, toxic + plain)
    weight = {w: 1 - (c + 0.5) / (t + c + 1) for w, (t, c) in found.items() if toxic and plain and chance(t, t + c, base) * tried < 1}
    model = Model({w: x for w, x in weight.items() if w[-1] != "*"}, {w[:-1]: x for w, x in weight.items() if w[-1] == "*"})
    if not (toxic and plain):
        discard(known, counts)
        return model

    def features(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text", PART):
                low, near = model.near(batch.column("text"))
                x = np.zeros((batch.num_rows, len(ARCS)))
                for i in near:
                    x[i] = model.features(low[int(i)].as_py())
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    kinds = known.select("toxic", "text").mapInArrow(features, "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count("*").alias("n")).collect()  # kinds of rows, `most` at most
    discard(known, counts)
    x, y, n = np.asarray([r.x for r in kinds]), np.asarray([r.toxic for r in kinds], float), np.asarray([r.n for r in kinds], float)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order of the rows
    return model.weighed(*logistic(x[order], y[order], n[order]))


def chance(t: int, n: int, base: float) -> float:
    """The probability that t or more of n texts are toxic, if each is with the probability base."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(base) + (n - i) * math.log1p(-base)) for i in range(t, n + 1))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, spread: float = 2.0, steps: int = 50) -> tuple[list[float], float]:
    """Newton's method for logistic regression with normal priors round the grammar's own weights."""
    design = np.hstack([x, np.ones((len(x), 1))])
    prior = np.asarray([*PRIOR, BIAS])
    tight = np.asarray([1 / spread**2] * len(PRIOR) + [1 / 100])
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (n * (y - p)) - tight * (w - prior)
        curve = (design * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + np.diag(tight)
        move = np.clip(np.linalg.solve(curve, slope), -2, 2)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return [float(v) for v in w[:-1]], float(w[-1])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, score (0 to 1), predicted (1 if score >= 0.5) and clauses (what matched, with its kind) of each whole text.

    Null and empty texts match nothing and get the score of that; null or repeated keys stay, a row each; an empty table
    gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text", PART):
                clauses, scores = model.batch(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores), pa.array(clauses, pa.list_(pa.string()))], ["key", "score", "clauses"])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, score double, clauses array<string>")
    return out.select(F.col("key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score 0.5 or more."""
    small_batches(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, text, PART):
                _, scores = model.batch(batch.column(text))
                yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)
