"""Quality rules: decision lists learned by sequential covering.

``statistics`` counts every text. ``learn`` grows one conjunction of thresholds after
another on labelled statistics (FOIL gain on two thirds of the rows), prunes each on the
other third and keeps it while it is precise there; ``expression`` turns the list into
one ordered Spark conditional. A row that no rule rejects is kept.

The list is fitted on at most ``MAX_LABELLED`` labelled rows, those with the smallest
hashes of their id.

Edge cases: a null text counts as empty and has no words; a text of one endless word or
line is counted like any other; without labelled rows, or with labels of one kind only,
the list is empty and keeps every row; rows repeated or with a null id are counted each;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import free_worker
from loadlens.llm.words import among, span_hashes, window_hashes, word_spans
from loadlens.sources.shared import stage

MAX_LABELLED = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_bytes", "n_lines", "n_upper", "n_lower", "n_digits", "n_exclaim", "n_bars", "n_odd_ends", "n_same_next")
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


_SYMBOL = among(SYMBOLS)
_UPPER = among(bytes(range(65, 91)))
_LOWER = among(bytes(range(97, 123)))
_DIGIT = among(b"0123456789")
# a word is expected to end in a letter (any byte of one beyond ASCII), a digit or plain punctuation
_PLAIN_END = _UPPER | _LOWER | _DIGIT | among(b".,;:?)\"'") | (np.arange(256) >= 128)


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes occur more than once."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = np.concatenate(([False], ranked[1:] == ranked[:-1], [False]))
    out = np.empty(len(hashes), bool)
    out[order] = same[1:] | same[:-1]
    return out


def count_text(text: bytes) -> tuple[int, ...]:
    """``COUNTS`` of one text."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return (0,) * len(COUNTS)
    starts, ends = word_spans(data)
    continuation = np.concatenate((np.zeros(1, np.int32), np.cumsum((data & 0xC0) == 0x80, dtype=np.int32)))
    inside = int((ends - starts).sum() - (continuation[ends] - continuation[starts]).sum())
    tally = np.bincount(data, minlength=256)
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    n_repeat = n_same = 0
    if len(starts) > 1:
        hashes = span_hashes(data, starts, ends)
        n_same = int((hashes[1:] == hashes[:-1]).sum())
        if len(starts) > WINDOW:
            twice = _repeated(window_hashes(hashes, WINDOW))
            if twice.any():
                covered = np.zeros(len(starts) + 1, np.int64)
                at = np.flatnonzero(twice)
                covered[at] += 1
                np.subtract.at(covered, at + WINDOW, 1)
                n_repeat = int((np.cumsum(covered)[:-1] > 0).sum())
    return (
        len(starts),
        inside,
        int(tally[_SYMBOL].sum()),
        len(lines) - len(set(lines)),
        n_repeat,
        len(data),
        len(lines),
        int(tally[_UPPER].sum()),
        int(tally[_LOWER].sum()),
        int(tally[_DIGIT].sum()),
        int(tally[33]),
        int(tally[124]),
        int((~_PLAIN_END[data[ends - 1]]).sum()) if len(ends) else 0,
        n_same,
    )


def statistics(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the counts of every text; only texts go to Python, once."""

    def count(texts: pa.Array) -> pa.Array:
        free_worker()
        counts = np.array([count_text(v.as_py() or b"") for v in texts], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in counts.T], list(COUNTS))

    # not to be repeated in a filter on the counts
    counted = F.arrow_udf(count, ", ".join(f"{c} long" for c in COUNTS)).asNondeterministic()
    rows = documents.select(*keep, counted(F.col(text).cast("binary")).alias("__counts"))
    return rows.select(*keep, *[F.col(f"__counts.{c}").alias(c) for c in COUNTS])


#: What rules compare: SQL over the counts. Rates are per word or per byte, so that length alone decides little.
FEATURES: dict[str, str] = {
    "words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "digit_share": "n_digits / greatest(n_bytes, 1)",
    "exclaims_per_word": "n_exclaim / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
    "odd_end_share": "n_odd_ends / greatest(n_words, 1)",
    "same_next_share": "n_same_next / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        value = values[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(values)
    return out


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, candidates: dict[str, np.ndarray]) -> Rule:
    """Add the condition of the highest FOIL gain until no good row is covered or nothing is gained."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while True:
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        if not p or not n or len(rule) == 4:
            return tuple(rule)
        before = np.log2(p / (p + n))
        best, gain = None, 1e-9
        for name, cuts in candidates.items():
            at = np.searchsorted(cuts, values[name][inside], side="left")  # value <= cuts[i] from i = at on
            bads = np.cumsum(np.bincount(at[bad[inside]], minlength=len(cuts) + 1))[: len(cuts)]
            goods = np.cumsum(np.bincount(at[~bad[inside]], minlength=len(cuts) + 1))[: len(cuts)]
            for above, p1, n1 in ((False, bads, goods), (True, p - bads, n - goods)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(p1 > 0, p1 * (np.log2(p1 / (p1 + n1)) - before), 0.0)
                if len(gains) and gains.max() > gain:
                    best, gain = Condition(name, above, float(cuts[gains.argmax()])), gains.max()
        if best is None:
            return tuple(rule)
        rule.append(best)
        inside &= best.holds(values)


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop conditions from the end while that is no worse on rows the rule was not grown on."""

    def worth(r: Rule) -> float:
        inside = _covered(r, values, len(bad))
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        return (p - n) / max(p + n, 1)

    cut = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(cut, key=lambda r: (round(worth(r), 6), -len(r)), default=())


def sequential_covering(
    values: dict[str, np.ndarray], bad: np.ndarray, keys: np.ndarray, precision: float = 0.95, max_rules: int = 20,
    support: int = 3, cuts: int = 64,
) -> list[Rule]:
    """Ordered rules that reject bad rows. ``keys`` (any integers) decide which rows grow and which prune."""
    prune = keys % 3 == 0
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        grow_on, prune_on = left & ~prune, left & prune
        part = {k: v[grow_on] for k, v in values.items()}
        if not bad[grow_on].any() or bad[grow_on].all():
            break
        candidates = {k: _cut_points(v, bad[grow_on], cuts) for k, v in part.items()}
        held = {k: v[prune_on] for k, v in values.items()}
        rule = _prune(_grow(part, bad[grow_on], candidates), held, bad[prune_on])
        if not rule:
            break
        inside = _covered(rule, held, int(prune_on.sum()))
        hit, miss = (bad[prune_on] & inside).sum(), (~bad[prune_on] & inside).sum()
        if hit < support or hit < precision * (hit + miss):
            break
        rules.append(rule)
        left &= ~_covered(rule, values, len(bad))
    return rules


def _cut_points(value: np.ndarray, bad: np.ndarray, cuts: int) -> np.ndarray:
    """Midpoints between neighbouring values, at quantiles of either class."""
    at = np.linspace(0, 1, cuts)
    points = np.unique(np.concatenate([np.quantile(value[c], at) for c in (bad, ~bad)]))
    return (points[1:] + points[:-1]) / 2


def pick_labels(labels: DataFrame, key: str = "doc_id", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``__key`` and ``quality`` (0 for bad) of at most ``max_labelled`` labelled rows, by the hash of the key."""
    known = labels.where("quality IS NOT NULL").select(F.col(key).alias("__key"), "quality")
    # what may be among the first, by counts of the hashes' leading bits, so that no task sorts more than that
    lead = F.shiftright(F.xxhash64("__key"), 48)
    last, taken = None, 0
    for row in sorted(known.groupBy(lead.alias("lead")).count().collect()):
        last, taken = row["lead"], taken + row["count"]
        if taken >= max_labelled:
            break
    return known.where(lead <= last).orderBy(F.xxhash64("__key"), "__key", "quality").limit(max_labelled)


def learn(counts: DataFrame, picked: DataFrame, key: str = "doc_id", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The decision list from ``counts`` (best staged) and ``pick_labels``."""
    sample = (
        counts.join(F.broadcast(picked), F.col(key) == F.col("__key"))
        .select(
            "quality",
            F.xxhash64("__key").alias("__hash"),
            F.pmod(F.xxhash64("__key", F.lit("part")), F.lit(1 << 20)).alias("__part"),
            *[F.expr(sql).alias(name) for name, sql in FEATURES.items()],
        )
        .orderBy("__hash", *FEATURES, "quality", "__part")
        .limit(max_labelled)
        .toArrow()
    )
    if not sample.num_rows:
        return []
    values = {name: sample[name].to_numpy() for name in FEATURES}
    return sequential_covering(values, sample["quality"].to_numpy() == 0, sample["__part"].to_numpy())


def learn_from_texts(documents: DataFrame, labels: DataFrame, key: str, text: str) -> list[Rule]:
    """As ``learn``, counting only the texts of the labelled rows that are picked."""
    picked = stage(pick_labels(labels), "picked-labels")
    rows = documents.select(key, text).join(
        F.broadcast(picked.select("__key").distinct()), F.col(key) == F.col("__key"), "left_semi"
    )
    return learn(statistics(rows, text, (key,)), picked, key)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: false where the first rule that holds rejects."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
