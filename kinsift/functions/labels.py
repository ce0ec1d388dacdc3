"""The three label vocabularies and the relevance vocabulary, as columns and as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinsift.functions.ids import strip, strip_sql

# Label words. Data sets and calibration take STRICT_*, adapters ADAPTER_*, the validator VALIDATOR_*.
STRICT_POSITIVE = ["1", "1.0", "true", "yes", "y", "p", "positive", "cheating", "clone", "plagiarized", "plagiarised", "plagiarism", "match", "same"]
STRICT_NEGATIVE = ["0", "0.0", "false", "no", "n", "np", "negative", "original", "not cheating", "not_cheating", "non-cheating", "non cheating", "non-clone", "nonplagiarized", "nonplagiarised", "non_plagiarized", "non_plagiarised", "not plagiarized", "not plagiarised", "not_plagiarized", "not_plagiarised", "non_plagiarism", "non-plagiarism", "nonmatch", "non-match", "different"]
ADAPTER_POSITIVE = [x for x in STRICT_POSITIVE if x not in ("1.0", "p")]
ADAPTER_NEGATIVE = [x for x in STRICT_NEGATIVE if x != "0.0"]
VALIDATOR_POSITIVE = STRICT_POSITIVE
VALIDATOR_NEGATIVE = [x for x in STRICT_NEGATIVE if x not in ("not cheating", "not_cheating", "non-cheating", "non cheating", "non-clone")]
RELEVANT = ["true", "yes", "y", "relevant", "positive", "plagiarized", "plagiarised", "plagiarism", "match", "same"]
IRRELEVANT = ["false", "no", "n", "irrelevant", "negative", "original", "non_plagiarized", "non_plagiarised", "non_plagiarism", "non-plagiarism", "nonmatch", "non-match", "different", "np"]

#: ASCII decimal notation.
NUMBER = r"\A[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?\z"
NUMBER_RE2 = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"

_WORDS = {"strict": (STRICT_POSITIVE, STRICT_NEGATIVE), "adapter": (ADAPTER_POSITIVE, ADAPTER_NEGATIVE), "validator": (VALIDATOR_POSITIVE, VALIDATOR_NEGATIVE)}


def binary_label(col: Column | str, vocabulary: str = "strict") -> Column:
    """0, 1 or null. strict: a word or a number equal to 0 or 1; adapter: a word, or any finite number, which is
    positive above 0; validator: words only."""
    positive, negative = _WORDS[vocabulary]
    text = strip(col)
    key = F.lower(text)
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    out = F.when(key.isin(positive), 1).when(key.isin(negative), 0)
    if vocabulary == "strict":
        return out.when(number == 1, 1).when(number == 0, 0)
    if vocabulary == "adapter":
        return out.when(F.abs(number) < float("inf"), (number > 0).cast("int"))
    return out


def relevance_value(col: Column | str) -> Column:
    """A word's 1.0 or 0.0, else a finite number of at least 0, else null."""
    text = strip(col)
    key = F.lower(text)
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(key.isin(RELEVANT), 1.0).when(key.isin(IRRELEVANT), 0.0).when((number >= 0) & (number < float("inf")), number)


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def number_sql(text: str) -> str:
    return f"case when regexp_full_match({text}, '{NUMBER_RE2}') then try_cast({text} as double) end"


def binary_label_sql(expr: str, vocabulary: str = "strict") -> str:
    positive, negative = _WORDS[vocabulary]
    text = strip_sql(expr)
    tail = {
        "strict": f"when ({number_sql(text)}) = 1 then 1 when ({number_sql(text)}) = 0 then 0",
        "adapter": f"when isfinite({number_sql(text)}) then cast(({number_sql(text)}) > 0 as int)",
        "validator": "",
    }[vocabulary]
    return f"case when lower({text}) in {_in(positive)} then 1 when lower({text}) in {_in(negative)} then 0 {tail} end"


def relevance_sql(expr: str, words: bool = True) -> str:
    text = strip_sql(expr)
    vocabulary = f"when lower({text}) in {_in(RELEVANT)} then 1.0 when lower({text}) in {_in(IRRELEVANT)} then 0.0" if words else ""
    return f"case {vocabulary} when isfinite({number_sql(text)}) and ({number_sql(text)}) >= 0 then ({number_sql(text)}) end"
