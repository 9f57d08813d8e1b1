r"""Personal data: fixed forms, and identifiers that bootstrapped contexts discover.

Base spans are e-mail addresses, IPv4 addresses, card numbers that pass Luhn's check and
international phone numbers. They seed the second part, together with keys written as 32
or more hexadecimal digits: a mention is a base span or any other token with a digit or an
at-sign, without the punctuation around it. Its lexical patterns are the two whole words
before it, the two after it and the word on either side. Spark scores the graph of
patterns and instances (the texts of mentions) in turns:

* a pattern's score is the mean score of its mentions' instances, less for few mentions;
  it counts from ``MIN_SEEDS`` different seed instances on;
* an instance that is no seed scores 1 - product(1 - score) over its patterns that reach
  ``MIN_PATTERN``.

When a turn adds no pattern, at the latest after ``ROUNDS``, instances that reach
``MIN_INSTANCE`` by their patterns are reported as ``other`` wherever they occur outside base
spans; a key that no pattern supports is not.

Spans are found without Python: matches are set between marks and the marked text is
split, so starts are sums of lengths in code points. Patterns are possessive, and a
word's pattern starts only where a word or the last match ended, which keeps the time
linear in the text and changes no match.

Edge cases: a null text counts as empty; a text holding the mark itself is searched with
another sign in its place; rows equal in id and text count once for learning and get equal
results; without seeds nothing is learned; null ids are an id of their own; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.sources.shared import stage

KINDS = ("email", "ip", "card", "phone", "other")
ROUNDS = 10
MIN_SEEDS = 3
MIN_PATTERN = 0.8
MIN_INSTANCE = 0.9
_MARK, _OTHER = "\ue000", "\ue001"
_LOCAL = r"[A-Za-z0-9._%+-]"
_SPACE = r"\x20\x09-\x0D"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: keys of 32 hexadecimal digits or more, of one case
SECRET = r"^(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"
# windows in which the two words beside a mention are looked for: the first that holds them whole
_WINDOWS = (80, 800, 8000)
_LONG_WORD = 40  # longer words stand in patterns by their hash

SPAN = "struct<start:int,kind:int,end:int>"


def _marked_spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the matches that pass ``keep``, in order."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)

    def spans(p: Column) -> Column:
        ends = F.aggregate(
            p, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x)))
        )

        def of(ends: Column) -> Column:
            numbers = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: i % 2 == 0)
            if keep is not None:
                numbers = F.filter(numbers, lambda i: keep(F.element_at(p, i)))
            return F.transform(
                numbers,
                lambda i: F.struct(
                    F.element_at(ends, i).alias("start"), F.lit(kind).alias("kind"), F.element_at(ends, i + 1).alias("end")
                ),
            )

        return F.flatten(F.transform(F.array(ends), of))

    # bind the pieces once: a lambda's argument is computed one time
    found = F.flatten(F.transform(F.array(pieces), lambda p: F.when(F.size(p) > 1, spans(p)).otherwise(_none())))
    return found


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _luhn(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")

    def check(d: Column) -> Column:
        def value(i: Column) -> Column:
            v = F.substring(d, i, F.lit(1)).cast("int")
            twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
            return F.when((F.length(d) - i) % 2 == 1, twice).otherwise(v)

        total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + value(i))
        return F.length(d).between(12, 19) & (F.when(F.length(d).between(12, 19), total % 10).otherwise(1) == 0)

    return F.element_at(F.transform(F.array(digits), check), 1)


def _n_digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


def base_spans(text: Column) -> Column:
    """All base spans in the order of start, then kind."""
    safe = F.translate(text, _MARK, _OTHER)
    digits = text.rlike("[0-9]")

    def when(test: Column, spans: Column) -> Column:
        return F.when(test, spans).otherwise(_none())

    found = F.concat(
        when(F.contains(text, F.lit("@")), _marked_spans(safe, EMAIL, 0)),
        when(digits & F.contains(text, F.lit(".")), _marked_spans(safe, IP, 1, lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))),
        when(digits, _marked_spans(safe, CARD, 2, _luhn)),
        when(F.contains(text, F.lit("+")), _marked_spans(safe, PHONE, 3, lambda m: _n_digits(m).between(9, 15))),
    )
    return F.array_sort(found)


def other_tokens(text: Column, base: Column) -> Column:
    """Spans of tokens with a digit or an at-sign that no base span touches."""
    tokens = _marked_spans(F.translate(text, _MARK, _OTHER), TOKEN, 4)
    free = F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return F.when(text.rlike("[0-9@]"), free).otherwise(_none())


def _words(part: Column) -> Column:
    return F.regexp_extract_all(F.lower(part), F.lit(rf"[^{_SPACE}]+"), F.lit(0))


def _beside(text: Column, start: Column, end: Column, left: bool) -> Column:
    """At least the two words before or after a span, whole, where there are so many."""

    def within(n: int) -> Column:
        if left:
            return _words(F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n))))
        return _words(F.substring(text, end + 1, F.lit(n)))

    out = _words(F.substring(text, F.lit(1), start) if left else F.substring(text, end + 1, F.length(text)))
    for n in reversed(_WINDOWS):
        # the outermost word of a window may be cut, the two beside the span are not
        whole = (start <= n) if left else (F.length(text) - end <= n)
        out = F.when(whole | (F.size(within(n)) > 2), within(n)).otherwise(out)
    return F.transform(out, lambda w: F.when(F.length(w) > _LONG_WORD, F.concat(F.lit("#"), F.hex(F.xxhash64(w)))).otherwise(w))


def mentions(found: DataFrame) -> DataFrame:
    """One row for each base span and other token: place, instance and patterns."""
    start, end, text = F.col("m.start"), F.col("m.end"), F.col("text")
    # a token without the punctuation around it, so that "x1." and "(x1)" are one instance
    token = F.substring(text, start + 1, end - start)
    ahead = F.when(F.col("m.kind") == 4, F.length(F.regexp_extract(token, r"^[^\p{L}0-9@]*", 0))).otherwise(0)
    value = F.when(F.col("m.kind") == 4, F.regexp_replace(token, r"^[^\p{L}0-9@]+|[^\p{L}0-9@]+$", "")).otherwise(token)
    rows = found.select(
        "doc", "hash", "text", F.explode(F.concat("base", "others")).alias("m")
    ).select(
        "doc", "hash", (start + ahead).alias("start"), end.alias("end"), F.col("m.kind").alias("kind"),
        value.alias("instance"), _beside(text, start, end, True).alias("l"), _beside(text, start, end, False).alias("r"),
    )
    two_before = F.when(F.size("l") > 1, F.concat(F.lit("<"), F.array_join(F.slice("l", -2, 2), " ")))
    two_after = F.when(F.size("r") > 1, F.concat(F.lit(">"), F.array_join(F.slice("r", 1, 2), " ")))
    around = F.when(
        (F.size("l") > 0) & (F.size("r") > 0),
        F.concat(F.lit("|"), F.element_at("l", -1), F.lit(" _ "), F.element_at("r", 1)),
    )
    return rows.select(
        "doc", "hash", "start", "end", "kind", "instance",
        F.filter(F.array(two_before, two_after, around), lambda p: p.isNotNull()).alias("patterns"),
    )


def bootstrap(
    found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_pattern: float = MIN_PATTERN,
    min_instance: float = MIN_INSTANCE,
) -> DataFrame:
    """The instances that are discovered, from staged mentions: ``instance`` and ``score``."""
    seed = (F.col("kind") < 4) | F.col("instance").rlike(SECRET)
    edges = stage(
        found.select("instance", seed.alias("seed"), (F.col("kind") < 4).alias("base"), F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "instance")
        .agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"), F.max("base").alias("base")),
        "pattern-edges",
    )
    # an instance is a seed wherever it is found as one
    scores = stage(
        edges.groupBy("instance").agg(
            F.max(F.col("seed").cast("double")).alias("score"), F.max("seed").alias("is_seed"), F.max("base").alias("is_base"),
            F.lit(0.0).alias("learned"),
        ),
        "instance-scores",
    )
    before = -1
    for _ in range(rounds):
        patterns = (
            edges.join(scores, "instance")
            .groupBy("pattern")
            .agg(
                (F.sum(F.col("score") * F.col("n")) / (F.sum("n") + 1)).alias("p"),
                F.sum(F.col("is_seed").cast("long")).alias("seeds"),
            )
            .where((F.col("seeds") >= min_seeds) & (F.col("p") >= min_pattern))
            .select("pattern", "p")
        )
        patterns = stage(patterns, "pattern-scores")
        learned = edges.join(patterns, "pattern").groupBy("instance").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(1 - 1e-12)))))).alias("learned")
        )
        known = F.coalesce("learned", F.lit(0.0))
        scores = stage(
            scores.drop("learned").join(learned, "instance", "left").select(
                "instance", F.when(F.col("is_seed"), 1.0).otherwise(known).alias("score"), "is_seed", "is_base", known.alias("learned")
            ),
            "instance-scores",
        )
        now = patterns.count()
        if now == before:
            break
        before = now
    return scores.where(~F.col("is_base") & (F.col("learned") >= min_instance)).select("instance", F.col("learned").alias("score"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def find_personal_data(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256`` and ``spans`` with the discovered ones."""
    words = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(key).alias("doc"), words.alias("text")).select("doc", F.xxhash64("text").alias("hash"), "text")
    # only texts with a digit, an at-sign or a plus can hold anything
    found = rows.withColumn("base", base_spans(F.col("text"))).withColumn("others", other_tokens(F.col("text"), F.col("base")))
    some = found.where("size(base) + size(others) > 0")
    marked = stage(mentions(some).dropDuplicates(["doc", "hash", "start", "end", "kind"]), "mentions")
    learned = bootstrap(marked, **options)
    added = (
        marked.where("kind = 4")
        .join(learned, "instance")
        .select("doc", "hash", F.struct("start", F.lit(4).alias("kind"), (F.col("start") + F.length("instance")).alias("end")).alias("s"))
    )
    base = marked.where("kind < 4").select("doc", "hash", F.struct("start", "kind", "end").alias("s"))
    # the spans of one document, however many; documents without any join nothing
    spans = stage(base.unionByName(added).groupBy("doc", "hash").agg(F.array_sort(F.collect_list("s")).alias("spans")), "spans")
    same = F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__hash") == F.col("hash"))
    joined = rows.select(F.col("doc").alias("__doc"), F.col("hash").alias("__hash")).join(spans, same, "left")
    spans_ = F.coalesce("spans", _none())
    base_ = F.filter(spans_, lambda s: s["kind"] < 4)

    def count(kind: int) -> Column:
        return F.size(F.filter(spans_, lambda s: s["kind"] == kind)).cast("long")

    return joined.select(
        F.col("__doc").alias("doc_id"),
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])],
        F.sha2(_written(base_), 256).alias("base_sha256"),
        _written(spans_).alias("spans"),
        count(4).alias("n_other"),
    )
