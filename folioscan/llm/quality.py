"""Quality rules whose cutoffs limit false rejection, by exact binomial bounds on labelled documents.

Every rule has a ladder of cutoffs from lenient to strict. A policy is a set of rules and a step: each of its rules cuts
at that step of its ladder (at its strictest cutoff, if its ladder is shorter), and a document goes if any of them
rejects it. For each stratum (language) and set of rules the policies are nested, so they are tested in order: the
labelled good documents are a holdout that tells how many of them a policy would reject, and it is certified if the exact
binomial tail P(Bin(n, ALPHA) <= rejected) is at most DELTA over the number of (stratum, set) ladders. A ladder is
climbed until the first policy that isn't certified, which needs no further correction (fixed-sequence testing). So
with probability 1 - DELTA no certified policy anywhere, all its rules together, rejects more than ALPHA of its
stratum's good documents. Each stratum takes one: of the certified policies, which all carry the guarantee, the one that
rejects most bad less good documents; of equals the lenient one, then the one of fewer rules. Everything is DataFrame
expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, columns_of, discard, fresh, materialize

#: Most of a stratum's good documents that may be rejected, and the chance that this is broken anywhere.
ALPHA, DELTA = 0.02, 0.05

#: rule: (numerator, denominator, cutoffs); a document is rejected if 100 * numerator > cutoff * denominator.
RULES = {
    "symbols": ("n_symbols", "word_chars", (50, 30, 20, 15, 10, 7, 5, 3, 2, 1)),
    "repeated_lines": ("n_dup_lines", "n_lines", (90, 70, 50, 40, 30, 20, 10)),
    "repeated_words": ("n_repeat_words", "n_words", (45, 40, 35, 30, 25, 20, 15, 10)),
    "long_words": ("word_chars", "n_words", (3000, 2500, 2000, 1500, 1200, 1000)),
}

STEPS = max(len(cutoffs) for _, _, cutoffs in RULES.values())

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
BLANKS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"


def with_features(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the features as further columns, named with the prefix; in-row array functions only, no shuffle.

    Three-word windows are compared by 64-bit hashes, only for a document that has a repeated one are they sorted.
    """
    t, words, lines, grams = (f"__{prefix}{x}" for x in ("text", "words", "lines", "grams"))
    own = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    own = own.withColumn(words, F.filter(F.split(t, f"{SPACE}+"), lambda x: x != "")).withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    own = own.withColumn(grams, F.expr(f"transform(if(size(`{words}`) < 3, array(), sequence(1, size(`{words}`) - 2)), i -> xxhash64(`{words}`[i - 1], `{words}`[i], `{words}`[i + 1]))"))
    g = f"`{grams}`"
    repeated = f"""if(size(array_distinct({g})) = size({g}), 0, transform(array(sort_array(transform({g}, (h, i) -> named_struct('h', h, 'i', i)))), s ->
        aggregate(sort_array(transform(filter(s, (x, j) -> (j > 0 and s[j - 1].h = x.h) or (j < size(s) - 1 and s[j + 1].h = x.h)), x -> x.i)),
                  named_struct('n', 0, 'last', -3), (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x), a -> a.n))[0])"""
    made = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(F.col(t), BLANKS, "")),
        "n_symbols": F.length(t) - F.length(F.translate(F.col(t), SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.expr(repeated),
        "n_lines": F.size(lines),
    }
    # The row number keeps filters on the features above this projection; pushed below, they would put the array
    # expressions into each other, and each would be evaluated anew for every element.
    fence = F.monotonically_increasing_id().alias(f"__{prefix}fence")
    out = own.select(*(F.col(f"`{c}`") for c in docs.columns), *(made[k].cast("long").alias(prefix + k) for k in FEATURES), fence)
    return out.filter(F.col(f"__{prefix}fence") >= 0).drop(f"__{prefix}fence")


def base_failed(prefix: str = "") -> Column:
    n, again = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (again * 100 > n * 50)


def log_gamma(x: Column) -> Column:
    """Stirling's series for whole x >= 1, eight places up the recurrence: exact to about 1e-14."""
    y = x.cast("double") + 8
    tail = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    product = reduce(lambda a, b: a * b, (x.cast("double") + i for i in range(8)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + tail - F.log(product)


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(Bin(n, share) <= k) where k < n * share, else 1: the term at k times a sum of ratios going down, cut where terms vanish."""
    term = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(share)) + (n - k) * F.log(F.lit(1 - share))
    steps = F.sequence(F.lit(0).cast("long"), F.least(k, (F.sqrt(n) * 40).cast("long") + 100))
    odds = (1 - share) / share
    total = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term")),
        lambda a, j: F.struct((a.total + a.term).alias("total"), (a.term * (k - j) * odds / (n - k + j + 1)).alias("term")),
        lambda a: a.total,
    )
    return F.when((n > 0) & (k < n * share), F.exp(term) * total).otherwise(1.0)


def first_rejecting(cutoffs: tuple, numerator: Column, denominator: Column) -> Column:
    """The first step of a ladder that rejects, STEPS if none does: each cutoff is stricter than the one before."""
    passed = reduce(lambda a, b: a + b, ((numerator * 100 <= denominator * c).cast("int") for c in cutoffs))
    return F.when(passed < len(cutoffs), passed).otherwise(F.lit(STEPS))


def calibrate(features: DataFrame, labels: DataFrame, stratum_col: str, alpha: float, delta: float, id_col: str, prefix: str) -> DataFrame:
    """One row a stratum that has a certified policy: __stratum and, for each rule, the cutoff taken or null."""
    known = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__labelled")).agg(F.min("quality").alias("__quality"))
    held = features.filter(~base_failed(prefix)).join(known, F.col(id_col) == F.col("__labelled"))
    first = [first_rejecting(cutoffs, F.col(prefix + a), F.col(prefix + b)) for a, b, cutoffs in RULES.values()]
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum")
    each = held.select(stratum, (F.col("__quality") >= 1).alias("good"), F.array(*first).alias("first"))
    rules_of = lambda m: F.filter("first", lambda x, j: F.getbit(m, j) == 1)
    flat = each.select("stratum", "good", F.explode(F.transform(F.sequence(F.lit(1), F.lit(2 ** len(RULES) - 1)), lambda m: F.struct(m.alias("mask"), F.array_min(rules_of(m)).alias("step")))).alias("s"))
    # Every stratum, set and step has a row, so that a step at which nothing is rejected anew is tested, too.
    grid = flat.select("stratum", F.col("s.mask").alias("mask"), F.explode(F.array([F.struct(F.lit(k).alias("step"), (F.col("good") & (F.col("s.step") <= k)).cast("long").alias("k"), (~F.col("good") & (F.col("s.step") <= k)).cast("long").alias("bad"), F.col("good").cast("long").alias("n")) for k in range(STEPS)])).alias("g"))
    counts = grid.select("stratum", "mask", "g.*").groupBy("stratum", "mask", "step").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("bad").alias("bad"))
    counts = materialize(counts, "policies")
    ladders = max(1, counts.select("stratum", "mask").distinct().count())
    climb = Window.partitionBy("stratum", "mask").orderBy("step")
    tested = counts.withColumn("p", binomial_tail(F.col("n"), F.col("k"), alpha)).withColumn("worst", F.max("p").over(climb))
    best = tested.filter(F.col("worst") <= delta / ladders).groupBy("stratum").agg(F.max(F.struct(F.col("bad") - F.col("k"), -F.col("step"), -F.bit_count("mask"), -F.col("mask"))).alias("b"))
    mask, step = -F.col("b.col4"), -F.col("b.col2")
    taken = [F.when(F.getbit(mask, F.lit(j)) == 1, F.element_at(F.array([F.lit(c) for c in cutoffs]), F.least(step + 1, F.lit(len(cutoffs))).cast("int"))).alias(f"__{r}") for j, (r, (_, _, cutoffs)) in enumerate(RULES.items())]
    out = materialize(best.select(F.col("stratum").alias("__stratum"), *taken), "thresholds")
    discard(counts)
    return out


def apply_rules(features: DataFrame, cutoffs: DataFrame, stratum_col: str, prefix: str) -> DataFrame:
    """features with base_failed and kept (named with the prefix). The table of cutoffs has a row a stratum; Spark broadcasts it if it is small."""
    names = fresh(features, "stratum", *RULES)
    joined = features.join(cutoffs.toDF(*names), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) == F.col(names[0]), "left")
    out = reduce(lambda a, b: a | b, (F.coalesce(F.col(prefix + a) * 100 > F.col(prefix + b) * F.col(c), F.lit(False)) for c, (a, b, _) in zip(names[1:], RULES.values(), strict=True)))
    return joined.withColumn(prefix + "base_failed", base_failed(prefix)).withColumn(prefix + "kept", ~base_failed(prefix) & ~out).drop(*names)


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, features, base_failed and kept.

    A null or empty text has no words and fails the base rules; a null id is judged but never labelled; a null stratum
    is a stratum of its own; repeated rows are judged each; a document labelled twice counts once, as bad if any label
    says so; null labels don't count; without labels only the base rules hold; extra columns aren't read.
    """
    features = materialize(with_features(docs.select(id_col, stratum_col, text_col), text_col).drop(text_col), "features")
    judged = apply_rules(features, calibrate(features, labels, stratum_col, alpha, delta, id_col, ""), stratum_col, "")
    return judged.select(id_col, *FEATURES[:5], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the rules keep; cases as in judge. Rows are stored once beside their features,
    which are made once; texts aren't shuffled."""
    p = fresh(docs, "quality_")[0]
    stored = materialize(with_features(docs, text_col, p), "features")
    cutoffs = calibrate(stored, labels, stratum_col, alpha, delta, id_col, p)
    return apply_rules(stored, cutoffs, stratum_col, p).filter(F.col(p + "kept")).select(*columns_of(docs))


def oracle_sql() -> str:
    first = ", ".join(f"coalesce(nullif(len(list_filter([{', '.join(map(str, cutoffs))}], lambda c: 100 * {a} <= {b} * c)), {len(cutoffs)}), {STEPS}) AS f{j}" for j, (a, b, cutoffs) in enumerate(RULES.values()))
    least = ", ".join(f"CASE WHEN mask & {2**j} > 0 THEN f{j} ELSE {STEPS} END" for j in range(len(RULES)))
    rejects = " OR ".join(f"(mask & {2**j} > 0 AND f{j} <= least(step, {len(cutoffs) - 1}))" for j, (_, _, cutoffs) in enumerate(RULES.values()))
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents
), f AS (
  SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM f)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id
), x AS (
  SELECT f.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines FROM f LEFT JOIN r USING (doc_id)
), y AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x
), q AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT *, {first} FROM y
), c AS (
  SELECT lang, mask, step, CAST(sum(CAST(quality >= 1 AS BIGINT)) AS BIGINT) AS n, CAST(sum(CAST(quality >= 1 AND least({least}) <= step AS BIGINT)) AS BIGINT) AS k, CAST(sum(CAST(quality < 1 AND least({least}) <= step AS BIGINT)) AS BIGINT) AS bad
  FROM h JOIN q USING (doc_id), (SELECT unnest(range(1, {2 ** len(RULES)})) AS mask), (SELECT unnest(range({STEPS})) AS step) WHERE NOT base_failed GROUP BY ALL
), p AS (
  SELECT *, CASE WHEN n > 0 AND k < n * {ALPHA} THEN list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) ELSE 1 END AS p FROM c
), b AS (
  SELECT *, max(p) OVER (PARTITION BY lang, mask ORDER BY step) AS worst, (SELECT count(*) FROM (SELECT DISTINCT lang, mask FROM c)) AS ladders FROM p
), z AS (
  SELECT lang, mask, step FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY bad - k DESC, step, bit_count(mask), mask) AS i FROM b WHERE worst <= {DELTA} / ladders) WHERE i = 1
), o AS (
  SELECT DISTINCT doc_id FROM h JOIN z USING (lang) WHERE {rejects}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM o) AS kept FROM y
"""
