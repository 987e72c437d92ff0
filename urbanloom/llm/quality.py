"""Statistics of a text's quality, and from them prose, lists, tables and junk.

Structural rules label the clear cases of a bounded sample of documents by their statistics; gradient-boosted trees are
trained on these and their probabilities calibrated on a hand-checked holdout. The trees then decide all documents, in one
pass that computes the statistics of each whole text and keeps nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.holdout import HOLDOUT
from urbanloom.session import cut

KINDS = ["prose", "list", "table", "junk"]
#: Documents that the rules look at to label some for training, and labelled ones of each kind that the trees are trained on, about, at most.
SAMPLE_DOCS, TRAIN_PER_KIND = 16_000, 1500
#: Common words of the corpus' languages (English, German, French, Polish).
COMMON_WORDS = frozenset(
    "a an and are as at be but by for from has have he her his i in is it its not of on or she that the their there they this to was we were which who with you "
    "aber als am auch auf aus bei bevor das dass dem den der des die ein eine einem einen einer er es für im in ist kein mit nach nicht noch nur oder sich sie sind über um und unter von vor war weder wird wo wurde zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il la le les leur mais ne on ou par pas pour quand que qui se ses son sont sous sur un une voit "
    "ale co do i jest na nie od po przez się tak to w z za że oraz obok".split()
)
NAMES = [
    "log_chars", "log_lines", "words_per_line", "word_length", "letters", "digits", "symbols", "bulleted", "columns", "ends_sentence", "sentences", "common", "wrapped", "distinct_lines", "distinct_words",
    "distinct_grams", "longest", "markup", "broken", "code_like", "line_length", "line_spread", "capitals", "vowels", "clean", "keyed", "dotted", "short_lines", "entropy", "prose_lines", "n_columns", "marks", "odd", "runs", "foreign",
]

_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"<[^<>]{0,200}>")
_BREAK = re.compile(r"\s*<br\s*/?>\s*", re.IGNORECASE)
_BULLET = re.compile(r"\s*(?:[-*+•–—·▪◦‣✓✗]|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\d+(?:\.\d+)+\.?)\s+\S")
_KEYED = re.compile(r"\s*[^\s:=][^:=]{0,40}\s*[:=]\s*\S{0,40}(?:\s+\S+){0,8}\s*$")
_DOTTED = re.compile(r".*?(?:\.{3,}|…|(?:\. ){3,}|_{3,})\s*\d+\s*$")
_RULE = re.compile(r"[\s|+:=-]+$")
_END = re.compile(r"[.!?…。！？؟][\"'”“»«)\]]*\s*$")
_STOP = re.compile(r"[.!?…。！？؟][\"'”“»«)\]]*(?:\s|$)|[。！？]")
_CLEAN = re.compile(r"[(\"'„“”«»¿¡\[]*[^\W\d_]+(?:(?:[-'’]|[。、，！？؟،]+)[^\W\d_]+)*[.,;:!?)\"'“”»«…\]。、，؟،！？]*$")
_CODE = re.compile(r"(?:[0-9a-fA-F]{2,})$|[A-Za-z0-9+/=]{24,}$|0x[0-9a-fA-F]+$")
_PLAIN = frozenset(".,;:!?'\"()-–—…„“”‚‘’«»。、，؟،%/")
_VOWELS = frozenset("aeiouyäöüàâéèêëîïôûùóąęAEIOUYÄÖÜÉÀÈÊ")
_ODD = frozenset("|¦~^¬`\\{}[]<>@#$*_=+&")
_BROKEN = frozenset("�¤¶¬¦§¼½¾¢¿")
_RUN = re.compile(r"[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZß]{4,}")
_EDGE = ".,;:!?\"'()„“”«»…"
_WINDOW, _GRAM = 400, 5


@lru_cache(maxsize=1 << 16)
def _token(t: str) -> tuple[bool, int, bool]:
    """Whether a token is a plain word with its marks, how many of its characters look like code, and whether it is a common word."""
    return bool(_CLEAN.match(t)), len(t) if _CODE.match(t) and not t.isdigit() else 0, t.lower().strip(_EDGE) in COMMON_WORDS


def _distinct_grams(text: str) -> float:
    """Mean share of distinct runs of _GRAM characters in the windows of a text."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    starts = range(0, max(1, len(code) - _WINDOW // 2), _WINDOW)
    if len(code) < _GRAM:
        return 1.0
    runs = np.zeros(len(code) - _GRAM + 1, np.uint64)
    for k in range(_GRAM):
        runs = runs * np.uint64(1_000_003) + code[k : len(code) - _GRAM + 1 + k]
    shares = []
    for a in starts:
        part = np.sort(runs[a : a + _WINDOW - _GRAM + 1])
        shares.append((1 + np.count_nonzero(part[1:] != part[:-1])) / max(1, len(part)) if len(part) else 1.0)
    return float(sum(shares) / len(shares))


def _table_share(lines: list[str]) -> tuple[float, int]:
    """(share of the three or more lines that have the commonest number of columns, three or more, that number) by the best separator."""
    best = (0.0, 0)
    rows = [x for x in lines if not _RULE.match(x)]
    if len(rows) < 3:
        return best
    for sep in ("|", "\t", ";", ",", None):
        counts: Counter = Counter()
        for x in rows:
            cells = re.split(r"\s{2,}|\t", x.strip()) if sep is None else x.strip().strip("|").split(sep) if sep == "|" else x.split(sep)
            if len(cells) >= 3 and sum(len(c.split()) for c in cells) <= 2.6 * len(cells):
                counts[len(cells)] += 1
        if counts:
            n, k = counts.most_common(1)[0]
            near = k + (counts[n - 1] + counts[n + 1] if sep is None else 0)
            if near / len(rows) > best[0]:
                best = (near / len(rows), n)
    return best


def statistics(text: str) -> list[float]:
    """Statistics (see NAMES) of a text that isn't blank; none depends on the text's length but by its logarithm."""
    whole = len(text)
    tags = sum(len(m) for m in _TAG.findall(text))
    flat = _BREAK.sub(" ", text) if tags < 0.3 * whole else text
    lines = [x for x in flat.splitlines() if x.strip()] or [flat]
    split = [x.split() for x in lines]
    tokens = [t for x in split for t in x] or [flat]
    told = [[_token(t) for t in x] for x in split]
    words = _WORD.findall(flat)
    letters = sum(map(len, words))
    solid = max(1, sum(map(len, tokens)))
    chars = Counter(flat)
    shares = [0] * 9  # one pass over the distinct characters
    for c, k in chars.items():
        if c.isalpha():
            latin = "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ž"
            shares[0] += k * latin
            shares[1] += k * (c in _VOWELS)
            shares[2] += k * c.isupper()
        elif c.isdigit():
            shares[3] += k
        elif not c.isspace():
            shares[4] += k * (c not in _PLAIN)
            shares[5] += k
            shares[6] += k * (c in _ODD)
        shares[7] += k * (c in _BROKEN or (c < " " and c not in "\t\n\r\f\x0b") or "\x7f" <= c <= "\x9f")
    latin, vowels, upper, digits, symbols, marks, odd, broken = shares[:8]
    n = len(lines)
    lengths = [len(x) for x in lines]
    mean = sum(lengths) / n
    ends = [bool(_END.search(x)) for x in lines]
    counts = [len(x) for x in split]
    bullets = [bool(_BULLET.match(x)) for x in lines]
    columns, n_columns = _table_share(lines)
    # a wrapped line goes on in the next one
    goes_on = sum(not e and counts[i] >= 4 and not bullets[i + 1] for i, e in enumerate(ends[:-1]))
    said = [sum(t[2] for t in x) for x in told]
    common_line = [k / max(1, c) for k, c in zip(said, counts, strict=True)]
    prose_lines = sum(length for length, c, s, b in zip(lengths, counts, common_line, bullets, strict=True) if c >= 5 and s >= 0.18 and not b)
    kinds = []
    for k in range(0, max(1, len(flat) - _WINDOW // 2), _WINDOW):
        w = flat[k : k + _WINDOW].split()
        kinds.append(len(set(w)) / max(1, len(w)))
    entropy = -sum(v / len(flat) * math.log2(v / len(flat)) for v in chars.values())
    runs = sum(len(m) for m in _RUN.findall(flat))
    return [
        math.log1p(whole), math.log1p(n), len(tokens) / n, letters / max(1, len(words)), letters / solid, digits / solid, symbols / solid, sum(bullets) / n, columns, sum(ends) / n,
        min(5.0, 10 * len(_STOP.findall(flat)) / max(1, len(tokens))), sum(said) / max(1, sum(counts)), goes_on / max(1, n - 1), len({x.strip() for x in lines}) / n, sum(kinds) / len(kinds),
        _distinct_grams(flat), math.log1p(max(map(len, tokens))), tags / whole, broken / solid, sum(t[1] for x in told for t in x) / solid, math.log1p(mean),
        math.sqrt(sum((x - mean) ** 2 for x in lengths) / n) / max(1.0, mean), upper / max(1, letters), vowels / max(1, latin) if latin > 0.5 * letters else 0.4, sum(t[0] for x in told for t in x) / len(tokens),
        sum(not e and (":" in x or "=" in x) and bool(_KEYED.match(x)) for x, e in zip(lines, ends, strict=True)) / n, sum(x.rstrip()[-1:].isdigit() and bool(_DOTTED.match(x)) for x in lines) / n,
        sum(c <= 7 and s < 0.3 for c, s in zip(counts, common_line, strict=True)) / n, entropy, prose_lines / max(1, sum(lengths)), float(n_columns), marks / solid, odd / solid,
        runs / max(1, letters), 1 - latin / max(1, letters) if letters else 0.0,
    ]


_AT = {name: k for k, name in enumerate(NAMES)}


def weak_label(x: np.ndarray) -> np.ndarray:
    """Place in KINDS of each row of statistics that a rule is sure of, else -1."""
    f = {name: x[:, k] for name, k in _AT.items()}
    lines = np.expm1(f["log_lines"])
    rows = (f["columns"] >= 0.6) & (lines >= 3)
    repeated = (f["distinct_grams"] < 0.22) & (f["log_chars"] > math.log(80)) & ~(rows & (f["distinct_lines"] > 0.5)) & ~(f["dotted"] >= 0.5)
    entries = (f["bulleted"] >= 0.7) | (f["dotted"] >= 0.7) | (f["keyed"] >= 0.8)
    noise = (f["clean"] < 0.4) & (f["marks"] > 0.12) & ~rows & ~(f["bulleted"] >= 0.3) & ~(f["dotted"] >= 0.3) & ~((f["keyed"] >= 0.5) & (f["odd"] < 0.1)) & (f["prose_lines"] < 0.3)
    symbols = (f["letters"] + f["digits"] < 0.3) & ~rows & ~(f["dotted"] >= 0.3)
    gibberish = (f["foreign"] < 0.5) & (f["vowels"] < 0.28) & (f["runs"] > 0.15) & (f["common"] < 0.06) & (f["letters"] > 0.7) & ~rows
    junk = (f["markup"] > 0.5) | repeated | (f["code_like"] > 0.6) | ((f["broken"] > 0.12) & (f["columns"] < 0.5)) | noise | symbols | gibberish
    table = ~junk & (f["columns"] >= 0.75) & (lines >= 3) & (f["prose_lines"] < 0.2)
    entries |= (f["short_lines"] >= 0.85) & (f["words_per_line"] <= 5)
    list_ = ~junk & ~table & (f["columns"] < 0.4) & (lines >= 4) & entries & (f["prose_lines"] < 0.25)
    told = (f["prose_lines"] > 0.75) | ((f["foreign"] > 0.5) & (f["sentences"] > 0.2)) | ((f["common"] > 0.2) & (f["words_per_line"] > 6)) | ((f["letters"] > 0.85) & (f["sentences"] > 0.3) & (f["short_lines"] < 0.3))
    prose = ~junk & ~table & ~list_ & told & (f["columns"] < 0.3) & (f["bulleted"] < 0.3) & (f["clean"] > 0.5) & (f["distinct_grams"] > 0.25)
    return np.where(junk, 3, np.where(table, 2, np.where(list_, 1, np.where(prose, 0, -1))))


class Boosted:
    """Gradient-boosted trees for several classes: softmax loss, Newton leaves, splits at quantiles."""

    def __init__(self, classes: int, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8, l2: float = 1.0) -> None:
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = classes, rounds, depth, rate, bins, least, l2
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.base = np.zeros(classes)
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Trains on rows ``x`` with classes ``y``; classes weigh the same however many rows they have."""
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
        share = np.bincount(y, minlength=self.classes)
        weight = (len(y) / np.maximum(share, 1) / max(1, (share > 0).sum()))[y]
        target = np.eye(self.classes)[y]
        self.base = np.where(share > 0, 0.0, -20.0)
        score = np.tile(self.base, (len(y), 1))
        for _ in range(self.rounds):
            p = _softmax(score)
            trees = []
            for c in range(self.classes):
                grad, hess = weight * (target[:, c] - p[:, c]), weight * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                tree = self._tree(binned, edges, grad, hess)
                trees.append(tree)
                score[:, c] += self.rate * _leaf_values(tree, x, self.depth)
            self.trees.append(trees)
        return self

    def _tree(self, binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << self.depth) - 1
        column, limit = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(grad), int)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = (1e-9, 0, np.inf)
            if len(rows) >= 2 * self.least:
                g, h = grad[rows], hess[rows]
                whole = g.sum() ** 2 / (h.sum() + self.l2)
                for k, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, k]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                    gain = gs**2 / (hs + self.l2) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.l2) - whole
                    gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
                    s = int(np.argmax(gain))
                    if gain[s] > best[0]:
                        best = (float(gain[s]), k, float(e[s]))
            column[at], limit[at] = best[1], best[2]
            right = binned[rows, best[1]] > (np.searchsorted(edges[best[1]], best[2], "left") if np.isfinite(best[2]) else 1 << 30)
            node[rows] = 2 * at + 1 + right
        leaf = node - inner
        size = 1 << self.depth
        value = np.bincount(leaf, grad, size) / (np.bincount(leaf, hess, size) + self.l2)
        return column, limit, value

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(x), 1))
        for trees in self.trees:
            for c, tree in enumerate(trees):
                out[:, c] += self.rate * _leaf_values(tree, x, self.depth)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.scores(x) / self.temperature)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Sets the temperature under which the rows ``x`` with classes ``y`` are most likely."""
        raw = self.scores(x)
        loss = lambda t: -np.log(np.maximum(_softmax(raw / t)[np.arange(len(y)), y], 1e-12)).sum()
        self.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        return self


def _leaf_values(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, depth: int) -> np.ndarray:
    column, limit, value = tree
    node = np.zeros(len(x), int)
    rows = np.arange(len(x))
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, column[node]] > limit[node])
    return value[node - len(column)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def text_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, NAMES..., weak) of each document that isn't null, empty or blank; whole texts, one pass, no shuffle.

    weak is the kind that a structural rule is sure of, else null.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, statistics(t)) for i, t in enumerate(batch.column(1).to_pylist()) if t and t.strip()]
            if not got:
                continue
            x = np.array([s for _, s in got])
            weak = [KINDS[w] if w >= 0 else None for w in weak_label(x)]
            keys = batch.column(0).take(pa.array([i for i, _ in got]))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(x[:, k]) for k in range(len(NAMES))], pa.array(weak, pa.string())], names=["key", *NAMES, "weak"])

    schema = f"key {kind}, " + ", ".join(f"{n} double" for n in NAMES) + ", weak string"
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def train(stats: DataFrame, key: str, per_kind: int = TRAIN_PER_KIND) -> Boosted:
    """Trees trained on about ``per_kind`` weakly labelled rows of each kind, by the hash of ``key``, and calibrated on HOLDOUT.

    A kind without weakly labelled rows is never given.
    """
    labelled = stats.filter(F.col("weak").isNotNull())
    counts = {r["weak"]: r["n"] for r in labelled.groupBy("weak").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(F.create_map(*[v for k in KINDS for v in (F.lit(k), F.lit(min(1.0, per_kind / max(1, counts.get(k, 0)))))])[F.col("weak")], F.lit(0.0))
    chosen = labelled.filter(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < share * 1_000_003)
    rows = chosen.select("weak", F.hash(F.col(key)).alias("h"), *NAMES).limit(len(KINDS) * per_kind * 2).collect()
    rows.sort(key=lambda r: (r["h"], *[r[n] for n in NAMES]))
    model = Boosted(len(KINDS))
    if rows:
        model.fit(np.array([[r[n] for n in NAMES] for r in rows]), np.array([KINDS.index(r["weak"]) for r in rows]))
    held = np.array([statistics(t) for _, t in HOLDOUT])
    return model.calibrate(held, np.array([KINDS.index(k) for k, _ in HOLDOUT]))


def model_of(df: DataFrame, key: str, text: str) -> Boosted:
    """Trees trained on a sample of about SAMPLE_DOCS documents, by the hash of their keys and texts; HOLDOUT isn't trained on."""
    share = min(1.0, SAMPLE_DOCS / max(1, df.count()))
    chosen = df.filter(F.pmod(F.xxhash64(key, text), F.lit(1_000_003)) < share * 1_000_003) if share < 1 else df
    held = df.sparkSession.createDataFrame([(t,) for _, t in HOLDOUT], "held string")
    rest = chosen.join(F.broadcast(held), chosen[text] == F.col("held"), "left_anti")
    return train(cut(text_statistics(rest, key, text)), key)


def classify(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, probability) of each document that isn't null, empty or blank, kind being the likeliest of KINDS.

    One pass over whole texts, besides that for the sample; copies get the same kind.
    """
    shared = df.sparkSession.sparkContext.broadcast(model_of(df, key, text))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = [i for i, t in enumerate(texts) if t and t.strip()]
            if not at:
                continue
            p = shared.value.probabilities(np.array([statistics(texts[i]) for i in at]))
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([KINDS[k] for k in best]), pa.array(p[np.arange(len(best)), best])], names=["key", "kind", "probability"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, kind string, probability double").withColumnRenamed("key", key)
