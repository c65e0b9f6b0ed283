"""Quality rules with risk-controlled thresholds.  Built-in functions only.

Every text gets counts; each rule compares one ratio of them with a cutoff.
The cutoffs are learned per stratum from labelled documents:

* One half of the labelled good documents (the proposal half, by the md5 of the
  id) proposes cutoffs: fixed quantiles of each ratio.
* The other half (the holdout) tests them.  With k of its n good documents
  beyond a cutoff, the cutoff is valid if the exact binomial bound holds:
  P(Binomial(n, risk) <= k) <= alpha / tests, where tests counts every rule,
  quantile and stratum (Bonferroni).
* Of the valid cutoffs that bad holdout documents exceed at ``min_lift`` times
  the rate of good ones at least, the one that rejects most bad ones is taken.

With probability 1 - alpha, no rule falsely rejects more than ``risk`` of the
good documents of any stratum; ``risk`` is ``total_risk`` shared evenly by the
rules, so all rules together stay within ``total_risk``.  A stratum with too
few labels to prove anything gets no cutoff and loses nothing to these rules:
with four strata that is one of fewer than 970 good holdout documents.

``joint`` cutoffs, which ``quality_rules`` and ``quality_filter`` use, need few labels.
They are tested as vectors in a sequence that is fixed beforehand: the quantiles
from the mildest on, and within each the rules in ``SEQUENCE``, so that a step
makes one rule stricter by one quantile.  Each step's vector is tested for all
its rules together at ``total_risk`` and alpha / strata, up to the first that
fails (fixed-sequence testing), so 86 good holdout documents are enough with four
strata.  Each rule then has the best of its useful cutoffs that are no lower than
the last step's, which reject no more than that step does.
The separate tests are there for callers with many labels (``joint=False``).
``strata_report`` tells which strata have cutoffs.

Nulls and edges: a null text has no words (all counts 0, base_failed true); a
null stratum is a stratum of its own; unlabelled strata have no cutoffs; null
labels are ignored; a document labelled twice counts once, as bad if any label
says so; repeated rows each get their own result; an empty table gives an
empty result.  Columns besides those named are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")

#: rule -> (numerator, denominator); a text is rejected when the ratio is over the cutoff
RULES = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "mark_ratio": ("n_marks", "word_chars"),
}
#: the order in which rules get stricter: those first whose ratio is mostly 0 in ordinary texts
SEQUENCE = ("symbol_ratio", "mark_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "word_length")
QUANTILES = (0.9, 0.95, 0.98, 0.99, 0.995, 0.999, 1.0)
#: Cutoffs of up to this many strata are broadcast: a row of a few hundred bytes each.
BROADCAST_STRATA = 4096


def _repeat_words() -> str:
    """SQL: how many of the words ``w`` lie in a three-word window that occurs twice or more, exactly.

    Each window becomes one long: the upper bits of its hash, and in the last ones, as
    many as the text needs, its place.  Equal windows are neighbours after a sort.
    Neighbours of equal bits are compared word by word; should any differ, the
    text's windows are sorted as strings instead.
    """
    bind = "transform(array({}), {} -> {})[0]"
    equal = " and ".join(f"w[(e & m) + {k}] = w[(t[i - 1] & m) + {k}]" for k in range(3))
    covered = "aggregate({}, named_struct('n', 0L, 'at', -3L), (a, p) -> named_struct('n', a.n + least(3L, p - a.at), 'at', p), a -> a.n)"
    windows = "transform(sequence(0, size(w) - 3), i -> {})"
    neighbours = "filter(s, (e, i) -> (i > 0 and {k}) or (i < size(s) - 1 and {l}))"
    packed = windows.format("shiftleft(shiftright(xxhash64(w[i], w[i + 1], w[i + 2]), b), b) | cast(i as bigint)")
    alike = neighbours.format(k="shiftright(s[i - 1], b) = shiftright(e, b)", l="shiftright(s[i + 1], b) = shiftright(e, b)")
    strings = windows.format("named_struct('g', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'p', cast(i as bigint))")
    same = neighbours.format(k="s[i - 1].g = e.g", l="s[i + 1].g = e.g")
    by_string = bind.format(f"sort_array({strings})", "s", covered.format(f"sort_array(transform({same}, e -> e.p))"))
    differ = f"size(filter(t, (e, i) -> i > 0 and shiftright(t[i - 1], b) = shiftright(e, b) and not ({equal}))) > 0"
    chosen = f"case when size(t) = 0 then 0L when {differ} then {by_string} else {covered.format('sort_array(transform(t, e -> e & m))')} end"
    with_mask = bind.format("shiftleft(1L, b) - 1", "m", bind.format(alike, "t", chosen))
    body = bind.format("cast(ceil(log2(size(w))) as int)", "b", bind.format(f"sort_array({packed})", "s", with_mask))
    return f"case when size(w) < 4 then 0L else {body} end"


def text_counts(column: str) -> Column:
    """A struct of COUNTS for the texts of ``column``.

    The one-element arrays bind a value to a lambda variable, so that it is
    computed once and not wherever it is mentioned.
    """
    return F.expr(
        rf"""
        transform(array(coalesce(`{column}`, '')), t ->
          transform(array(array_remove(split(t, r'{SPACE}'), '')), w ->
            transform(array(filter(split(t, r'\n'), x -> x rlike r'[^\x20\x09-\x0D]')), l ->
              named_struct(
                'n_words', cast(size(w) as bigint),
                'word_chars', cast(length(array_join(w, '')) as bigint),
                'n_symbols', cast(regexp_count(t, r'{SYMBOLS}') as bigint),
                'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint),
                'n_repeat_words', {_repeat_words()},
                'n_lines', cast(size(l) as bigint),
                'n_upper', cast(regexp_count(t, r'\p{{Lu}}') as bigint),
                'n_marks', cast(regexp_count(t, r'[!?]') as bigint)))[0])[0])[0]"""
    )


def _ratio(counts: str, rule: str) -> Column:
    top, below = RULES[rule]
    return F.when(F.col(f"{counts}.{below}") > 0, F.col(f"{counts}.{top}") / F.col(f"{counts}.{below}")).otherwise(F.lit(0.0))


def _log_tail(n: str, k: str, p: float) -> str:
    """SQL: ln P(Binomial(n, p) <= k), summed term by term in logarithms."""
    first = f"{n} * ln(1 - {p}D)"
    step = f"a.t + ln(({n} - i + 1) / i) + ln({p}D / (1 - {p}D))"
    add = "greatest(a.s, {t}) + log1p(exp(-abs(a.s - ({t}))))".format(t=step)
    return (
        f"if({k} = 0, {first}, aggregate(sequence(1L, greatest({k}, 1L)), named_struct('t', {first}, 's', {first}), "
        f"(a, i) -> named_struct('t', {step}, 's', {add}), a -> a.s))"
    )


def risk_cutoffs(counts: DataFrame, labels: DataFrame, *, total_risk: float = 0.05, alpha: float = 0.05, min_lift: float = 10.0, joint: bool = False) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_false) of the cutoffs that hold.

    counts: (doc_id, stratum, c struct of COUNTS); labels: (doc_id, quality),
    1 good and 0 bad.  Every labelled document takes part.
    """
    risk = total_risk / len(RULES)
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    rows = (
        counts.join(one, "doc_id")
        .select(
            "doc_id",
            "stratum",
            (F.col("q") > 0).alias("good"),
            (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8").alias("proposes"),
            F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*(_ratio("c", r) for r in RULES)))).alias("rule", "x"),
        )
    )
    rows = materialize(rows, "quality-labelled")
    offered = (
        rows.where("proposes and good")
        .groupBy("stratum", "rule")
        .agg(F.percentile("x", F.array(*map(F.lit, QUANTILES))).alias("cuts"))
        .select("stratum", "rule", F.explode(F.array_distinct("cuts")).alias("cutoff"))
    )
    held = (
        rows.where("not proposes").join(offered.withColumnRenamed("stratum", "st").withColumnRenamed("rule", "ru"), F.col("stratum").eqNullSafe(F.col("st")) & (F.col("rule") == F.col("ru")))
        .groupBy("stratum", "rule", "cutoff")
        .agg(
            F.count_if("good").alias("n_good"),
            F.count_if(F.col("good") & (F.col("x") > F.col("cutoff"))).alias("n_false"),
            F.count_if(~F.col("good")).alias("n_bad"),
            F.count_if(~F.col("good") & (F.col("x") > F.col("cutoff"))).alias("n_hit"),
        )
    )
    held = materialize(held, "quality-held")
    strata = max(1, held.select("stratum").distinct().count())
    if joint:
        floors = _joint_floors(rows, total_risk, alpha / strata).withColumnsRenamed({"stratum": "st", "rule": "ru"})
        valid = held.join(floors, F.col("stratum").eqNullSafe(F.col("st")) & (F.col("rule") == F.col("ru"))).where("cutoff >= floor")
        return _best_cutoffs(valid, min_lift)
    level = alpha / (strata * len(RULES) * len(QUANTILES))
    valid = held.where((F.col("n_good") > 0) & (F.col("n_false") <= F.floor(F.col("n_good") * risk))).where(F.expr(_log_tail("n_good", "n_false", risk)) <= F.log(F.lit(level)))
    return _best_cutoffs(valid, min_lift)


def _best_cutoffs(valid: DataFrame, min_lift: float) -> DataFrame:
    useful = valid.where((F.col("n_hit") > 0) & (F.col("n_hit") * F.col("n_good") >= min_lift * F.col("n_false") * F.col("n_bad")))
    best = F.max_by(F.struct("cutoff", "n_good", "n_false"), F.struct("n_hit", -F.col("n_false"), F.col("cutoff")))
    return useful.groupBy("stratum", "rule").agg(best.alias("b")).select("stratum", "rule", "b.*")


def _joint_floors(rows: DataFrame, risk: float, level: float) -> DataFrame:
    """(stratum, rule, floor): the cutoffs of the last step that holds for all rules together; a rule without one has no row."""
    at = F.percentile("x", F.array(*map(F.lit, QUANTILES))).alias("cuts")
    place = F.array_position(F.array(*map(F.lit, SEQUENCE)), F.col("rule")).cast("int") - 1
    # QUANTILES rise: the mildest comes first
    step = (len(QUANTILES) - 1 - F.col("level")) * len(SEQUENCE) + place
    cuts = rows.where("proposes and good").groupBy("stratum", "rule").agg(at).select("stratum", "rule", F.posexplode("cuts").alias("level", "floor")).withColumn("step", step)
    cuts = materialize(cuts, "quality-levels")
    both = rows.where("good and not proposes").join(cuts.withColumnsRenamed({"stratum": "st", "rule": "ru"}), F.col("stratum").eqNullSafe(F.col("st")) & (F.col("rule") == F.col("ru")))
    # a document that one step rejects is rejected by all later ones
    docs = both.groupBy("stratum", "doc_id").agg(F.min(F.when(F.col("x") > F.col("floor"), F.col("step"))).alias("first"))
    steps = range(len(QUANTILES) * len(SEQUENCE))
    counted = docs.groupBy("stratum").agg(F.count("*").alias("n_good"), F.array(*(F.count_if(F.col("first") <= s) for s in steps)).alias("over"))
    tested = counted.select("stratum", "n_good", F.posexplode("over").alias("step", "n_false"))
    fits = F.coalesce((F.col("n_false") <= F.floor(F.col("n_good") * risk)) & (F.expr(_log_tail("n_good", "n_false", risk)) <= F.log(F.lit(level))), F.lit(False))
    last = tested.groupBy("stratum").agg(F.min(F.when(~fits, F.col("step"))).alias("failed")).withColumnsRenamed({"stratum": "st"})
    return cuts.join(last, F.col("stratum").eqNullSafe(F.col("st"))).where("failed is null or step < failed").groupBy("stratum", "rule").agg(F.min("floor").alias("floor"))


def strata_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk: float) -> DataFrame:
    """(stratum, n_docs, n_good, n_cutoffs): good holdout labels and rules with a cutoff of every stratum; 0: only the base rules hold."""
    counts = materialize(_text_rows(docs, id_col, text_col, stratum_col), "quality-counts")
    found = risk_cutoffs(counts, labels, **risk).groupBy("stratum").agg(F.count("*").alias("n_cutoffs")).withColumnsRenamed({"stratum": "__st"})
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    held = F.col("good") & (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) >= "8")
    strata = counts.join(good, "doc_id", "left").groupBy("stratum").agg(F.count("*").alias("n_docs"), F.count_if(F.coalesce(held, F.lit(False))).alias("n_good"))
    return strata.join(found, F.col("stratum").eqNullSafe(F.col("__st")), "left").select("stratum", "n_docs", "n_good", F.coalesce("n_cutoffs", F.lit(0)).alias("n_cutoffs"))


def _text_rows(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text_counts(text_col).alias("c"))


def _with_verdict(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to rows of (stratum, c, ...)."""
    table = materialize(cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).select(F.col("stratum").alias("__st"), *(F.col(r).alias(f"__{r}") for r in RULES)), "quality-cutoffs")
    small = F.broadcast(table) if table.count() <= BROADCAST_STRATA else table
    over = [F.coalesce(_ratio("c", r) > F.col(f"__{r}"), F.lit(False)) for r in RULES]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    base = (F.col("c.n_words") < 50) | (100 * F.col("c.n_repeat_words") > 50 * F.col("c.n_words"))
    return (
        rows.join(small, F.col("stratum").eqNullSafe(F.col("__st")), "left")
        .withColumns({"base_failed": base, "kept": ~base & ~rejected})
        .drop("__st", *(f"__{r}" for r in RULES))
    )


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk: float) -> DataFrame:
    """(doc_id, COUNTS..., base_failed, kept) for every row of ``docs``, under joint cutoffs."""
    counts = _text_rows(docs, id_col, text_col, stratum_col)
    counts = materialize(counts, "quality-counts")
    rows = _with_verdict(counts, risk_cutoffs(counts, labels, **({"joint": True} | risk)))
    return rows.select("doc_id", "c.*", "base_failed", "kept")


def quality_filter(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk: float) -> DataFrame:
    """The rows of ``docs`` that are kept under joint cutoffs, with their columns as they were.

    The rows are written once with their counts beside them, and filtered as they
    are read again: no text is counted twice or moved.
    """
    own = docs.columns
    packed = docs.select(F.struct(*own).alias("row"), F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text_counts(text_col).alias("c"))
    packed = materialize(packed, "quality-rows")
    cutoffs = risk_cutoffs(packed.select("doc_id", "stratum", "c"), labels, **({"joint": True} | risk))
    return _with_verdict(packed, cutoffs).where("kept").select("row.*")
