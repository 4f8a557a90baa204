"""Quality rules as a short-circuit cascade.

A random sample of texts gives each rule's cost (seconds to evaluate it on those texts) and
selectivity (share rejected). The cascade is one CASE expression that tries the rules by rejection per cost: what a rule
counts is counted inside its branch, so a text that a cheap rule rejects never meets a dear one. The order changes the
running time, never the verdict: a document is kept if no rule rejects it.

Defined cases: a null or empty text has no words, fails `few_words` and is not kept; repeated rows are judged one
by one; an empty table gives an empty result; all columns of the input stay, and a clashing name is replaced.
"""

from __future__ import annotations

import math
import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import released, stored

_WORD = r"r'[^\x20\x09-\x0D]+'"
#: Words of text t.
WORDS = f"regexp_extract_all(t, {_WORD}, 0)"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates value once, under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _chars(some: str) -> str:
    """How many code points of t are among some."""
    return f"length(t) - length(translate(t, '{some}', ''))"


def _repeat_words() -> str:
    """Words of w inside 3-word windows that stand twice or more in w. Windows are compared by 64-bit hashes.

    The hashes are sorted with their positions in the low 20 bits, so equal windows are neighbours; where two different
    hashes agree in the other bits, or positions don't fit, (hash, position) pairs are sorted instead.
    """
    low = (1 << 20) - 1
    at = lambda p: f"get(h, cast({p} & {low} AS int))"
    near = "coalesce({0} = {1}, false) OR coalesce({0} = {2}, false)"
    packed = _let("p", f"sort_array(transform(h, (x, i) -> (x & {~low}L) | i))", "{}")
    mixed = f"exists(sequence(1, size(p) - 1), k -> shiftright(p[k], 20) = shiftright(p[k - 1], 20) AND {at('p[k]')} <> {at('p[k - 1]')})"
    quick = f"transform(filter(p, (q, k) -> {near.format(at('q'), at('get(p, k - 1)'), at('get(p, k + 1)'))}), q -> q & {low})"
    slow = _let(
        "p", "array_sort(transform(h, (x, i) -> struct(x AS x, cast(i AS bigint) AS i)))",
        f"transform(filter(p, (q, k) -> {near.format('q.x', 'get(p, k - 1).x', 'get(p, k + 1).x')}), q -> q.i)",
    )
    starts = f"CASE WHEN size(h) > {low} THEN {slow} ELSE {packed.format(f'CASE WHEN {mixed} THEN {slow} ELSE {quick} END')} END"
    covered = _let("s", f"sort_array({starts})", "aggregate(transform(s, (x, k) -> least(3, coalesce(get(s, k + 1) - x, 3))), 0L, (a, b) -> a + b)")
    windows = "transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2)))"
    return f"CASE WHEN size(w) < 4 THEN 0L ELSE {_let('h', windows, f'CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {covered} END')} END"


_LINES = f"filter(split(t, '\\n'), x -> x RLIKE {_WORD})"
#: Counts over a text t and its words w: whole texts, built-in functions only.
COUNTS = {
    "n_words": "size(w)",
    "word_chars": "length(translate(t, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), ''))",
    "n_symbols": _chars("#*$%&|<>"),
    "n_lines": f"size({_LINES})",
    "n_dup_lines": _let("l", _LINES, "size(l) - size(array_distinct(l))"),
    "n_repeat_words": _repeat_words(),
    "n_upper": _chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "n_bangs": _chars("!"),
    "n_digits": _chars("0123456789"),
}
#: Those that are returned for all documents.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects: SQL over counts, the text t and its words w, true where the rule rejects a document."""

    name: str
    rejects: str
    base: bool = False

    def inline(self, known: tuple[str, ...] = ()) -> str:
        """The condition with its counts written out, but for those that are columns."""
        return re.sub(r"\w+", lambda m: f"({COUNTS[m[0]]})" if m[0] in COUNTS and m[0] not in known else m[0], self.rejects)


RULES = (
    Rule("few_words", "n_words < 50", True),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words", True),
    Rule("symbols", "100 * n_symbols > 40 * n_words"),
    Rule("shouting", "100 * n_upper > 60 * word_chars"),
    Rule("exclamations", "100 * n_bangs > 60 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("digits", "100 * n_digits > 50 * word_chars"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
)


def _bound(body: str, text: str) -> Column:
    """SQL body over the text t and its words w, which are taken once."""
    return F.expr(_let("t", f"coalesce(`{text}`, '')", _let("w", WORDS, body)))


def cascade(order: list[Rule], text: str = "text") -> Column:
    """True where a rule rejects; the rules after it are not evaluated."""
    return _bound("CASE " + " ".join(f"WHEN {r.inline()} THEN true" for r in order) + " ELSE false END", text) if order else F.lit(False)


def measure(docs: DataFrame, text: str = "text", counts: tuple[str, ...] = tuple(COUNTS)) -> DataFrame:
    """Adds counts for all rows, in one narrow stage."""
    bound = docs.withColumn("quire_t", F.coalesce(F.col(text), F.lit(""))).withColumn("quire_w", F.expr(WORDS.replace("(t,", "(quire_t,")))
    full = lambda c: re.sub(r"\b([tw])\b", r"quire_\1", COUNTS[c])
    return bound.withColumns({c: F.expr(full(c)).cast("long") for c in counts})


def plan_cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[dict]:
    """Rules in the order to try them: rejection per second on about sample_rows texts, best first.

    Rows are drawn one by one, whatever they hold, so that null or repeated ids don't swell the sample. Only the order
    comes from it; equal rates and an empty sample keep the given order. A rule costs what it takes longer than reading
    the texts, 1 ms at least.
    """
    n = docs.count()
    texts = docs.select(F.col(text).alias("text")).sample(fraction=min(1.0, sample_rows / max(1, n)), seed=8)
    sample = stored(texts.coalesce(1), "cascade-sample")

    def timed(condition: Column) -> tuple[float, int, int]:
        best, row = math.inf, None
        for _ in range(2):
            began = time.perf_counter()
            row = sample.agg(F.count("text").alias("n"), F.count_if(condition).alias("k")).first()
            best = min(best, time.perf_counter() - began)
        return best, row["n"], row["k"]

    idle = timed(F.length("text") < 0)[0]
    found = []
    for r in rules:
        took, seen, rejected = timed(cascade([r]))
        cost, share = max(took - idle, 1e-3), rejected / max(1, seen)
        found.append({"rule": r, "share": share, "cost": cost, "rate": share / cost, "seen": seen})
    released(sample)
    return sorted(found, key=lambda x: -x["rate"])


def quality_cascade(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, order: list[Rule] | None = None
) -> DataFrame:
    """docs with the RETURNED counts, `base_failed` and `kept`. Counts that are not returned are taken where the cascade
    comes to a rule that needs them. order: a planned order to use again."""
    order = order if order is not None else [x["rule"] for x in plan_cascade(docs, text, rules, sample_rows)]
    lazy = lambda r: re.sub(r"\b([tw])\b", r"quire_\1", r.inline(RETURNED))
    rejected = F.expr("CASE " + " ".join(f"WHEN {lazy(r)} THEN true" for r in order) + " ELSE false END") if order else F.lit(False)
    base = F.expr(" OR ".join(f"({r.rejects})" for r in rules if r.base) or "false")
    return measure(docs, text, RETURNED).withColumns({"base_failed": base, "kept": ~rejected}).drop("quire_t", "quire_w")


def without_rejected(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, order: list[Rule] | None = None
) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns; nothing is counted that the cascade doesn't need."""
    order = order if order is not None else [x["rule"] for x in plan_cascade(docs, text, rules, sample_rows)]
    return docs.where(~cascade(order, text))
