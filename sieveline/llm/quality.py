"""Quality rules of documents and of the hosts they come from, in DataFrame functions only.

Each document is measured against rules. Failures are then counted by host. A host's failure rate is
shrunk towards that of all hosts with an empirical beta prior (method of moments over the hosts), so a host
of few documents isn't judged by a few accidents. A host is rejected by a rule if its shrunk rate
passes the rule's limit; its documents are rejected with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import words_of
from sieveline.storage import join_small, settle

WINDOW = 3
#: In a window's key its position takes the low bits and a hash the rest: 20 bits for texts of under so many words, else 31, which hold any.
FEW, MANY = 1 << 20, 1 << 31


@dataclass(frozen=True)
class Limits:
    """Limits of the document rules, and of a host's shrunk failure rate by rule."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_word: float = 0.5
    max_dup_lines_share: float = 0.6
    host_rate: float = 0.6


def measure(docs: DataFrame, text_col: str = "text", base_only: bool = False) -> DataFrame:
    """Adds ``__q`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of the whole text.

    With ``base_only`` it has only n_words and n_repeat_words, all that the base rules look at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.withColumn("__words", words_of(F.col(text_col).cast("string")))
    w = F.col("__words")
    last = F.size(w) - WINDOW
    df = df.withColumn("__low", F.when(F.size(w) < FEW, F.lit(FEW - 1).cast("long")).otherwise(F.lit(MANY - 1).cast("long")))
    low = F.col("__low")
    # where windows are equal, so are their hashes, and they are neighbours when the keys are sorted
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(low))
    df = df.withColumn("__hashes", F.when(last > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)))
    h = F.col("__hashes")
    # most texts end here: if all hashes differ, no window is repeated
    keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseOR(i.cast("long"))))
    df = df.withColumn("__keys", F.when(F.size(F.array_distinct(h)) < F.size(h), keys))
    k = F.col("__keys")
    same = lambda a, b: F.coalesce(a.bitwiseOR(low) == b.bitwiseOR(low), F.lit(False))
    df = df.withColumn("__alike", F.filter(k, lambda x, i: same(x, F.get(k, i + 1)) | same(x, F.get(k, i - 1))))
    # these are all the repeated windows, and by chance others of equal hash: their words decide
    said = lambda x: F.struct(F.concat_ws(" ", *[F.get(w, x.bitwiseAND(low).cast("int") + j) for j in range(WINDOW)]).alias("said"), x.bitwiseAND(low).cast("int").alias("at"))
    df = df.withColumn("__said", F.when(F.size("__alike") > 0, F.sort_array(F.transform("__alike", said))))
    p = F.col("__said")
    again = lambda x, i: F.coalesce(x.said == F.get(p, i + 1).said, F.lit(False)) | F.coalesce(x.said == F.get(p, i - 1).said, F.lit(False))
    df = df.withColumn("__spots", F.sort_array(F.transform(F.filter(p, again), lambda x: x.at)))
    # a window covers three words, or as many as there are before the next one begins
    cover = F.aggregate(
        "__spots",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda acc, x: F.struct((acc.n + F.least(F.lit(WINDOW), x - acc.at)).alias("n"), x.alias("at")),
        lambda acc: acc.n,
    )
    n_words, n_repeat_words = F.size(w).cast("long").alias("n_words"), F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words")
    if base_only:
        q = F.struct(n_words, n_repeat_words)
    else:
        df = df.withColumn("__lines", lines)
        q = F.struct(
            n_words,
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            n_repeat_words,
            F.size("__lines").cast("long").alias("n_lines"),
        )
    # a generator, as a filter on what it makes isn't pushed into it: that would write all of the above out once for each use of a column
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(q)).alias("__q"))


def failures(limits: Limits) -> dict[str, Column]:
    """The document rules over ``__q``. The first two make up base_failed; all count against a host."""
    q = F.col("__q")
    return {
        "short": q.n_words < limits.min_words,
        "repeats": 100 * q.n_repeat_words > limits.max_repeat_percent * q.n_words,
        "symbols": q.n_symbols > limits.max_symbols_per_word * q.n_words,
        "dup_lines": q.n_dup_lines > limits.max_dup_lines_share * q.n_lines,
    }


def host_verdicts(measured: DataFrame, host_col: str, limits: Limits) -> DataFrame:
    """``__host, __host_failed`` and a shrunk rate for each rule, ``__rate_..``, of each host, null included.

    For each rule the hosts' rates, weighted by their documents, give a beta prior by the method of moments: with their mean m
    and variance v, ``a + b = m (1 - m) / v - 1``, and 1 at least. The shrunk rate is ``(failures + a) / (documents + a + b)``.
    If rates don't vary, the prior outweighs everything and every host has the rate m. Hosts of any size are judged.
    """
    rules = failures(limits)
    hosts = settle(
        measured.groupBy(F.col(host_col).alias("__host")).agg(F.count("*").alias("__n"), *[F.sum(rule.cast("long")).alias(f"__f_{k}") for k, rule in rules.items()])
    )
    moments = [F.try_divide(F.sum(f"__f_{k}"), F.sum("__n")).alias(f"__m_{k}") for k in rules]
    moments += [F.try_divide(F.sum(F.col(f"__f_{k}") * F.col(f"__f_{k}") / F.col("__n")), F.sum("__n")).alias(f"__s_{k}") for k in rules]
    found = hosts.agg(*moments).first()
    failed, rates = F.lit(False), []
    for k in rules:
        m = found[f"__m_{k}"] or 0.0
        weight = max(1.0, m * (1 - m) / max((found[f"__s_{k}"] or 0.0) - m * m, 1e-9) - 1)
        rate = (F.col(f"__f_{k}") + m * weight) / (F.col("__n") + weight)
        failed = failed | (rate > limits.host_rate)
        rates.append(rate.alias(f"__rate_{k}"))
    return hosts.select("__host", failed.alias("__host_failed"), *rates)


def _judged(measured: DataFrame, verdicts: DataFrame, host_col: str, limits: Limits) -> DataFrame:
    rules = failures(limits)
    name = lambda c: F.coalesce(F.concat(F.lit("h"), F.col(c).cast("string")), F.lit(""))  # noqa: E731  null is a host as well
    verdicts = settle(verdicts.withColumn("__host_key", name("__host")).drop("__host"))
    joined = join_small(measured.withColumn("__host_key", name(host_col)), verdicts, ["__host_key"])
    base = rules["short"] | rules["repeats"]
    return joined.withColumns({"__base_failed": base, "__kept": ~base & ~F.coalesce(F.col("__host_failed"), F.lit(False))})


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``doc_id``, the measures, base_failed, kept, and the host's verdict and shrunk rates for each row of ``docs``, which is measured once.

    kept is false if the document fails a base rule, or if its host's verdict is against it. Defined cases:
    a null or blank text has no words and fails; a text of any length is measured whole; a null host is a host of its own; rows with a null id
    and repeated rows are measured and counted as often as they stand; hosts of equal rates get equal verdicts; other columns aren't
    looked at, whatever their names; an empty table gives an empty result.
    """
    needed = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("__of"), F.col(text_col).alias("__text"))
    measured = settle(measure(needed, "__text").drop("__text"))
    found = _judged(measured, host_verdicts(measured, "__of", limits), "__of", limits)
    return found.select("doc_id", "__q.*", F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__host_failed").alias("host_failed"), *[F.col(f"__rate_{k}").alias(f"host_rate_{k}") for k in failures(limits)])


def keep_good(docs: DataFrame, host_col: str = "source", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns.

    Texts are neither shuffled nor written: they are measured once for the verdicts on hosts, and again, by the base rules, where the rows are
    kept. Defined cases are those of ``judge``; extra columns keep their values, whatever their names.
    """
    # the row travels as one column, so none of its names can meet those used here
    rows = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text"), F.col(host_col).alias("__of"))
    verdicts = host_verdicts(measure(rows.drop("__row"), "__text").drop("__text"), "__of", limits)
    return _judged(measure(rows, "__text", base_only=True).drop("__text"), verdicts, "__of", limits).where("__kept").select("__row.*")
