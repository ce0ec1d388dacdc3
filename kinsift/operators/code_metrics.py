"""Token-based code metrics of pairs: CrystalBLEU, RUBY, BLEU and the parts of CodeBLEU that need no parser."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.functions import strings
from kinsift.functions.text import KEYWORDS as GENERAL_WORDS
from kinsift.functions.text import language_key
from kinsift.functions.tokens import ngrams

METRICS = ("none", "codebleu", "codebleu_ngram", "codebleu_weighted_ngram", "codebleu_syntax", "codebleu_dataflow", "crystalbleu", "ruby", "tsed", "codebertscore")
NEED_PARSER = ("codebleu", "codebleu_syntax", "codebleu_dataflow", "tsed")
SEP = "\x1f"
EPSILON = 1e-12


def available(metric: str) -> bool:
    """Whether a metric can run here. Those on syntax trees or models need libraries that may be missing."""
    if metric not in METRICS:
        raise ValueError(f"Unsupported code metric: {metric}")
    wanted = "tree_sitter" if metric in NEED_PARSER else "bert_score" if metric == "codebertscore" else None
    if wanted is None:
        return True
    try:
        __import__(wanted)
    except ImportError:
        return False
    return True


def require(metric: str) -> None:
    if not available(metric):
        library = "tree_sitter and tree_sitter_language_pack" if metric in NEED_PARSER else "bert_score"
        raise ImportError(f"{metric} needs {library}; install them to use it")


def trivial_ngrams(docs: DataFrame, key: str, tokens: str, order: int = 4, top: int = 50) -> DataFrame:
    """(n, ngram, count, rank): for every n the `top` most frequent n-grams of the corpus, ties by where they
    came first (document, then position). The result has at most order * top rows."""

    def named(n: int) -> Column:
        return F.transform(ngrams(F.col(tokens), n, SEP), lambda g, i: F.struct(F.lit(n).alias("n"), g.alias("ngram"), i.alias("pos")))

    grams = F.concat(*[named(n) for n in range(1, order + 1)])
    rows = docs.select(F.col(key).alias("doc"), F.inline(grams))
    counts = rows.groupBy("n", "ngram").agg(F.count("*").alias("count"), F.min(F.struct("doc", "pos")).alias("first"))
    best = Window.partitionBy("n").orderBy(F.desc("count"), "first.doc", "first.pos")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("n", "ngram", "count", "rank")


class _Grams:
    """n-grams of two token lists as numbers: equal n-grams of either text have one number, in the order of the
    first place (the first text's before the second's). Each order comes from the one before, so that all of them
    cost a sort of the tokens an order and no strings."""

    def __init__(self, ref: list[str], hyp: list[str]) -> None:
        self.names: dict[str, int] = {}
        codes = np.array([self.names.setdefault(t, len(self.names)) for t in (*ref, *hyp)], dtype=np.int64)
        self.tokens, self.cut, self.n = codes, len(ref), 1
        self.grams = [codes[: len(ref)], codes[len(ref) :]]
        self.levels: list[np.ndarray] = []

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each number stands in the first and in the second text."""
        size = 1 + max((int(g.max()) for g in self.grams if len(g)), default=-1)
        a, b = (np.bincount(g, minlength=size) for g in self.grams)
        return a, b

    def longer(self) -> None:
        """On to the n-grams with one token more."""
        width = len(self.names) + 1
        sides = (self.tokens[: self.cut], self.tokens[self.cut :])
        keys = [g[: len(t) - self.n] * width + t[self.n :] if len(t) > self.n else np.empty(0, np.int64) for g, t in zip(self.grams, sides)]
        known, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(first)] = np.arange(len(known))
        whole = rank[inverse]
        self.levels.append((known, rank, width))
        self.grams = [whole[: len(keys[0])], whole[len(keys[0]) :]]
        self.n += 1

    def number(self, gram: str) -> int:
        """The number of an n-gram of the present order, -1 if it isn't there."""
        codes = [self.names.get(t, -1) for t in gram.split(SEP)]
        if len(codes) != self.n or min(codes) < 0:
            return -1
        at = codes[0]
        for (known, rank, width), code in zip(self.levels, codes[1:]):
            key = at * width + code
            place = int(np.searchsorted(known, key))
            if place == len(known) or known[place] != key:
                return -1
            at = int(rank[place])
        return at


def _orders(ref: list[str], hyp: list[str], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, _Grams]]:
    grams = _Grams(ref, hyp)
    for n in range(1, order + 1):
        if n > 1:
            grams.longer()
        yield n, *grams.counts(), grams


def _penalty(ref: list[str], hyp: list[str]) -> float:
    return 0.0 if not hyp else 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))


def crystal_of(ref: list[str], hyp: list[str], ignored: dict[int, frozenset[str]] | int, order: int = 4) -> float:
    """Clipped n-gram precision over what isn't trivial, brevity penalty on all tokens. ignored: the trivial n-grams
    by n, or a number: so many of the most frequent n-grams of the two texts themselves, ties by the first place.
    Without a countable n-gram a precision is epsilon; with some but none in common the score is 0. A text without
    tokens scores 0, against another one too."""
    if not hyp:
        return 0.0
    order = max(1, min(int(order), 8))
    total = 0.0
    for n, r, h, grams in _orders(ref, hyp, order):
        if isinstance(ignored, int):
            trivial = np.argsort(-(r + h), kind="stable")[:ignored]
        else:
            trivial = np.array([x for x in map(grams.number, ignored.get(n, ())) if x >= 0], dtype=np.int64)
        r[trivial] = h[trivial] = 0
        whole, common = int(h.sum()), int(np.minimum(r, h).sum())
        if whole and not common:
            return 0.0
        total += math.log(max(EPSILON, common / whole) if whole else EPSILON) / order
    return _penalty(ref, hyp) * math.exp(total)


def ruby_of(ref: list[str], hyp: list[str], order: int = 4) -> float:
    """Mean over n of the F1 of the n-gram multisets; orders that neither text reaches don't count."""
    if not ref or not hyp:
        return float(not ref and not hyp)
    scores = [2 * np.minimum(r, h).sum() / both for _, r, h, _ in _orders(ref, hyp, max(1, min(order, 8))) if (both := r.sum() + h.sum())]
    return float(sum(scores) / len(scores)) if scores else 0.0


def bleu_of(ref: list[str], hyp: list[str], keywords: frozenset[str] | None = None, order: int = 4) -> float:
    """BLEU with one reference: a numerator of 0 counts as 0.1, a denominator at least as 1, no common unigram is
    0. With keywords, unigrams weigh 1 if keywords and 0.2 otherwise."""
    logs = 0.0
    for n, r, h, grams in _orders(ref, hyp, order):
        weigh = np.ones(len(h))
        if keywords is not None and n == 1:
            weigh = np.array([1.0 if t in keywords else 0.2 for t in grams.names])
        above = math.fsum(np.minimum(r, h) * weigh)
        if n == 1 and above == 0:
            return 0.0
        logs += math.log((above or 0.1) / max(1.0, math.fsum(h * weigh))) / order
    return _penalty(ref, hyp) * math.exp(logs)


def _udf(one, both_ways: bool = False):
    @F.pandas_udf("double")
    def run(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(ref, hyp):
            x, y = list(a if a is not None else []), list(b if b is not None else [])
            out.append((one(x, y) + one(y, x)) / 2 if both_ways else one(x, y))
        return pd.Series(out, dtype="float64")

    return run


def crystalbleu(ref: Column | str, hyp: Column | str, trivial: DataFrame | None, order: int = 4, both_ways: bool = False) -> Column:
    """trivial: see trivial_ngrams(); its bounded rows travel with the function. None: nothing is trivial."""
    ignored: dict[int, set[str]] = {}
    for r in trivial.select("n", "ngram").collect() if trivial is not None else ():
        ignored.setdefault(r.n, set()).add(r.ngram)
    frozen = {n: frozenset(g) for n, g in ignored.items()}
    return _udf(lambda a, b: crystal_of(a, b, frozen, order), both_ways)(ref, hyp)


def crystalbleu_pair_context(ref: Column | str, hyp: Column | str, order: int = 4, top: int = 50, both_ways: bool = False) -> Column:
    """The two texts themselves are the corpus whose frequent n-grams are ignored."""
    return _udf(lambda a, b: crystal_of(a, b, max(0, int(top)), order), both_ways)(ref, hyp)


def ruby_ngram(ref: Column | str, hyp: Column | str, order: int = 4, both_ways: bool = False) -> Column:
    return _udf(lambda a, b: ruby_of(a, b, order), both_ways)(ref, hyp)


def bleu(ref: Column | str, hyp: Column | str, both_ways: bool = False) -> Column:
    return _udf(lambda a, b: bleu_of(a, b), both_ways)(ref, hyp)


def weighted_bleu(ref: Column | str, hyp: Column | str, keywords: Iterable[str], both_ways: bool = False) -> Column:
    known = frozenset(keywords)
    return _udf(lambda a, b: bleu_of(a, b, known), both_ways)(ref, hyp)


# The words that weigh most in weighted BLEU, by language.
KEYWORDS = {
    "c": "auto break case char const continue default do double else enum extern float for goto if int long register return short signed sizeof static struct switch typedef union unsigned void volatile while",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda match nonlocal not or pass raise return try while with yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
}


def keywords_of(language: str | None, own: Iterable[str] | None = None) -> frozenset[str]:
    """`own` if given; else the language's words, and for languages without a list here those no preprocessing renames."""
    if own is not None:
        return frozenset(own)
    key = language_key(language)
    return frozenset(KEYWORDS[key].split()) if key in KEYWORDS else frozenset(GENERAL_WORDS)


RUBY_MODES = ("auto", "ngram", "string", "tree", "graph")


def ruby(l: Callable[[str], Column], r: Callable[[str], Column], mode: str = "auto", tokenizer: str = "tranx", denominator: str = "max", order: int = 4, both_ways: bool = False) -> Column:
    """RUBY of two documents with columns tok (code tokens) and tranx. ngram: code tokens; string: edit distance of
    the tokens the tokenizer names. auto prefers graphs and trees, for which a parser is needed, and falls back to
    string; the strict modes tree and graph are errors without one."""
    if mode not in RUBY_MODES or tokenizer not in ("tranx", "regex"):
        raise ValueError(f"RUBY has the modes {', '.join(RUBY_MODES)} and the tokenizers tranx and regex")
    if mode in ("tree", "graph"):
        raise ImportError(f"RUBY's {mode} mode needs tree_sitter and its grammars")
    if mode == "ngram":
        return ruby_ngram(l("tok"), r("tok"), order, both_ways)
    name = "tranx" if tokenizer == "tranx" else "tok"
    return strings.ruby_string(l(name), r(name), denominator)  # the same both ways
