"""Quality rules: a table of thresholds that becomes one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import let, words

#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the be to of and that have with this is it for on are as was in a",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au il elle avec",
    "de": "der die das den dem des ein eine und ist zu in mit von auf für nicht sich im als",
    "es": "el la los las de del un una y es en que por para con no se su lo al",
}


@dataclass(frozen=True)
class Rule:
    """Fails a text whose ``measure`` lies outside ``low`` to ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def fails(self) -> Column:
        value, bad = F.col(self.measure), F.lit(False)
        bad = bad if self.low is None else bad | (value < self.low)
        return bad if self.high is None else bad | (value > self.high)


#: Ratios by word, by character or by line; one row for each rule.
RULES = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "mean_word", 1.5, 20),
    Rule("symbols", "symbol_ratio", None, 0.25),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("repeated_words", "repeat_ratio", None, 0.5),
    Rule("separators", "separator_ratio", None, 0.2),
    Rule("shouting", "upper_ratio", None, 0.6),
)


def measures(text: Column) -> dict[str, Column]:
    """What the rules are about, as columns of a text; a null text counts as empty. Counts are exact
    over the whole text. ``n_repeat_words`` compares windows of three words by their 64-bit hashes."""
    body = F.coalesce(text, F.lit(""))
    own = words(body)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = [w for k in STOP_WORDS for w in STOP_WORDS[k].split()]
    known = F.array(*[F.lit(w) for w in dict.fromkeys(stop)])
    return {
        "n_words": F.size(own).cast("long"),
        "word_chars": F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_repeat_words": let(own, _repeated).cast("long"),
        "n_stop": F.size(F.filter(own, lambda w: F.array_contains(known, F.lower(w)))).cast("long"),
        "n_separators": (F.length(body) - F.length(F.translate(body, "|", ""))).cast("long"),
        "n_letters": F.length(F.regexp_replace(body, r"\P{L}+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(body, r"\P{Lu}+", "")).cast("long"),
    }


def _repeated(own: Column) -> Column:
    """Words in three-word windows that occur twice or more. Sorts the windows by hash and place, keeps
    those with an equal neighbour, and adds up what each covers beyond the one before."""
    n = F.size(own)
    windows = F.transform(F.slice(own, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(own, i + 1), F.get(own, i + 2)).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    return let(F.sort_array(windows), lambda s: let(places(s), covered))


def _ratio(part: str, of: str) -> Column:
    return F.when(F.col(of) > 0, F.col(part) / F.col(of)).otherwise(F.lit(0.0))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures, ``failed`` (the names of the rules that a text breaks), and
    ``base_failed``. A clashing column of ``docs`` is replaced. Empty and null texts fail for length; repeated
    rows are judged alike, each; no rows give none."""
    own = measures(F.col(text))
    out = docs.withColumns(own).withColumns({
        "mean_word": _ratio("word_chars", "n_words"), "symbol_ratio": _ratio("n_symbols", "word_chars"),
        "stop_ratio": _ratio("n_stop", "n_words"), "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"), "separator_ratio": _ratio("n_separators", "n_words"),
        "upper_ratio": _ratio("n_upper", "n_letters"),
    })
    failed = F.array_compact(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in rules]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns({"base_failed": base, "failed": failed})
