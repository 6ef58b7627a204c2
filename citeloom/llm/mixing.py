"""Mixing documents to target token totals by domain, with soft memberships.

A classifier fitted on labelled rows gives every document a posterior over the
domains; projected gradient steps then fit a rate per document. All of it is
DataFrame and SQL functions.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.runtime import written

# Documented bounds of the classifier. Everything else covers all rows.
SAMPLE_PER_DOMAIN = 2000  # labelled documents it is fitted on
FEATURES = 4096  # words it may weigh; the table is broadcast
LEAST_SEEN = 3  # families of labelled documents that must hold a word
LEAST_GAIN = 12.0  # likelihood-ratio statistic a word needs
LEAST_ODDS = 1.0  # log odds by which it must prefer one domain to every other: words of a language or topic say little
SMOOTHING = 0.5
HELD = 4  # one labelled document in so many is held out to calibrate with
SIZES = (32, 64, 128, 256, 512, 1024, 2048, 4096)  # numbers of words tried
PRESENT = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0)  # factors tried for what present words say
MISSING = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0)  # and for what absent words say
UNTRIED = (64, 0.5, 0.3)  # without rows held out

PUNCTUATION = "([!-/:-@\\[-`{-~]+)"  # runs of ASCII punctuation
INK = "[^ \\t-\\r]"  # what words are made of
ROWS = ["doc_id", "_text_hash"]
DIGITS = 3  # of a posterior; rows of equal posterior share their rate
STEPS = 100  # gradient steps at most
STEPS_PER_TABLE = 8
STILL = 5e-5  # of all tokens: totals that change less in CALM steps in a row have settled
CALM = 2
PULL = 0.05  # weight of staying near a rate of one

PRIOR, ABSENT = "", " "  # rows of the weights that are no words


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents: toxic, else good or low by quality.

    Rows without label are left out; of several labels of a document the first by
    name counts.
    """
    domain = (F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low"))
    return (labels.select("doc_id", domain.alias("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull())
            .groupBy("doc_id").agg(F.min("domain").alias("domain")))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")


def _features(words: Column) -> Column:
    """The different words without ASCII punctuation, and each run of punctuation as a word of its own."""
    apart = F.regexp_replace(F.array_join(F.array_distinct(words), " "), F.lit(PUNCTUATION), F.lit(" $1 "))
    return F.array_remove(F.array_distinct(F.split(apart, " ")), "")


def _family(words: Column) -> Column:
    """The lowest hash of three words in a row: mostly the same for copies with few edits."""
    threes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(3)]))
    return F.array_min(threes)


def labelled_texts(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], sample: int = SAMPLE_PER_DOMAIN) -> DataFrame:
    """(domain, held, family, features) of at most ``sample`` labelled documents of each domain, chosen by a hash of the id.

    Documents without words are left out; ``held`` marks those kept for calibration.
    """
    chosen = None
    for d in domains:
        some = labelled.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most domains * sample ids: a bounded table. The filter goes below the join, to all texts: it looks for one character.
    texts = docs.select("doc_id", "text").where(F.col("text").rlike(INK)).join(F.broadcast(chosen), "doc_id")
    texts = texts.select("domain", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0).alias("held"), _words(F.col("text")).alias("words"))
    return written(texts.select("domain", "held", _family(F.col("words")).alias("family"), _features(F.col("words")).alias("features")), "labelled-texts")


def weigh_words(texts: DataFrame, domains: tuple[str, ...], features: int = FEATURES, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(word, rank, o_k, a_k): log odds of a word's presence and log chance of its absence in each domain, most telling words first.

    Counted once per family of copies and domain: what one long document or many
    copies of it repeat says little about others. Words are ranked by the
    likelihood-ratio statistic of presence against domain; one counts only if it
    prefers a domain clearly, which keeps out what merely tells languages apart.
    """
    every = range(len(domains))
    count = [F.count(F.when(F.col("domain") == d, 1)) for d in domains]
    words = texts.where(~F.col("held")).select("domain", "family", F.explode("features").alias("word")).distinct()
    counts = words.groupBy("word").agg(*[c.alias(f"c_{k}") for k, c in enumerate(count)])
    read = texts.where(~F.col("held")).select("domain", "family").distinct().agg(*[c.alias(f"t_{k}") for k, c in enumerate(count)])
    both = counts.join(F.broadcast(read))
    seen, whole = sum(F.col(f"c_{k}") for k in every), sum(F.col(f"t_{k}") for k in every)

    def surprise(held: Column, of: Column, all_held: Column) -> Column:
        return F.when(held > 0, held * F.log(held * whole / (all_held * of))).otherwise(0.0)

    gain = 2 * sum(surprise(F.col(f"c_{k}"), F.col(f"t_{k}"), seen) + surprise(F.col(f"t_{k}") - F.col(f"c_{k}"), F.col(f"t_{k}"), whole - seen) for k in every)
    chance = [(F.col(f"c_{k}") + SMOOTHING) / (F.col(f"t_{k}") + 2 * SMOOTHING) for k in every]
    ranked = F.sort_array(F.array(*[F.log(p) for p in chance]), asc=False)
    clear = ranked[0] - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0)) >= LEAST_ODDS
    best = both.where((seen >= LEAST_SEEN) & clear).withColumn("gain", gain).where(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "word").limit(features)
    # at most ``features`` rows are ranked
    rank = F.row_number().over(Window.orderBy(F.desc("gain"), "word"))
    return written(best.select("word", rank.alias("rank"), *[(F.log(p) - F.log(1 - p)).alias(f"o_{k}") for k, p in enumerate(chance)],
                               *[F.log(1 - p).alias(f"a_{k}") for k, p in enumerate(chance)]), "word-weights")


def calibrate(texts: DataFrame, words: DataFrame, priors: list[float], domains: tuple[str, ...]) -> tuple[int, float, float, float | None]:
    """Number of words and factors of present and absent words with the least mean log loss on the rows held out, and that loss.

    Rows held out (at most domains * sample / HELD) meet the grid of what is tried by
    explosion: a bounded table.
    """
    every = range(len(domains))
    base = words.agg(*[F.coalesce(F.sum(F.when(F.col("rank") <= m, F.col(f"a_{k}"))), F.lit(0.0)) for m in SIZES for k in every]).first()
    rows = texts.where("held").select("domain", "features", F.monotonically_increasing_id().alias("row"))
    held = rows.select("domain", "row", F.explode(F.concat(F.array(F.lit(PRIOR)), "features")).alias("word"))
    sums = (held.join(F.broadcast(words), "word", "left").groupBy("row", "domain")
            .agg(*[F.coalesce(F.sum(F.when(F.col("rank") <= m, F.col(f"o_{k}"))), F.lit(0.0)).alias(f"s_{n}_{k}") for n, m in enumerate(SIZES) for k in every]))
    by_size = F.array(*[F.struct(F.lit(m).alias("size"), *[F.col(f"s_{n}_{k}").alias(f"s_{k}") for k in every], *[F.lit(base[n * len(domains) + k]).alias(f"a_{k}") for k in every])
                        for n, m in enumerate(SIZES)])
    factors = F.array(*[F.struct(F.lit(p).alias("present"), F.lit(q).alias("missing")) for p in PRESENT for q in MISSING])
    grid = written(sums, "held-out").select("domain", F.inline(by_size)).select("*", F.inline(factors))
    z = [F.lit(priors[k]) + F.col("present") * F.col(f"s_{k}") + F.col("missing") * F.col(f"a_{k}") for k in every]
    true = sum(F.when(F.col("domain") == d, z[k]).otherwise(0.0) for k, d in enumerate(domains))
    top = F.greatest(*z, F.lit(float("-inf")))
    losses = grid.groupBy("size", "present", "missing").agg(F.avg(top + F.log(sum(F.exp(x - top) for x in z)) - true).alias("loss"))
    best = losses.orderBy(F.round("loss", 9), "size", "present", "missing").first()
    return (*UNTRIED, None) if best is None else (best["size"], best["present"], best["missing"], best["loss"])


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], sample: int = SAMPLE_PER_DOMAIN,
                   features: int = FEATURES, least_gain: float = LEAST_GAIN) -> DataFrame:
    """Naive Bayes weights of presence and absence: one row (word, w_0, w_1, ...) per word, and two that are none.

    Fitted on labelled rows (see ``labelled_texts``, ``weigh_words``); how many words
    count, and by what factors, is calibrated on labelled rows held out. The row ''
    holds the logarithms of the domain shares among all labelled rows, the row ' '
    the evidence of a text with none of the words. Without labels all domains are
    alike.
    """
    every = range(len(domains))
    n = labelled.agg(*[F.count(F.when(F.col("domain") == d, 1)) for d in domains]).first()
    priors = [math.log((x + 1) / (sum(n) + len(domains))) for x in n]
    texts = labelled_texts(docs, labelled, domains, sample)
    words = weigh_words(texts, domains, features, least_gain)
    most, present, missing, _ = calibrate(texts, words, priors, domains)
    kept = words.where(F.col("rank") <= most)
    absent = kept.agg(*[F.coalesce(F.sum(f"a_{k}"), F.lit(0.0)).alias(f"a_{k}") for k in every])
    prior = docs.sparkSession.range(1).select(F.lit(PRIOR).alias("word"), *[F.lit(p).alias(f"w_{k}") for k, p in enumerate(priors)])
    rows = (prior.unionByName(absent.select(F.lit(ABSENT).alias("word"), *[(missing * F.col(f"a_{k}")).alias(f"w_{k}") for k in every]))
            .unionByName(kept.select("word", *[(present * F.col(f"o_{k}")).alias(f"w_{k}") for k in every])))
    return written(rows, "weights")


def memberships(docs: DataFrame, weights: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """Posterior over the domains for every document, and its words: one row per distinct row of (doc_id, text).

    ``copies`` counts repeated rows. A document without words has the shares of the
    labels as posterior; of others, absent words speak as well. Posteriors have
    three digits and add up to one. The weights table is bounded (see FEATURES) and
    broadcast.
    """
    every = range(len(domains))
    split = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), _words(F.col("text")).alias("words"))
    always = F.when(F.size("words") > 0, F.array(F.lit(PRIOR), F.lit(ABSENT))).otherwise(F.array(F.lit(PRIOR)))
    hits = (split.select(*ROWS, F.size("words").alias("tokens"), F.explode(F.concat(always, _features(F.col("words")))).alias("word"))
            .join(F.broadcast(weights), "word"))
    sums = hits.groupBy(*ROWS, "tokens").agg(F.count(F.when(F.col("word") == PRIOR, 1)).alias("copies"), *[F.sum(f"w_{k}").alias(f"e_{k}") for k in every])
    score = [F.col(f"e_{k}") / F.col("copies") for k in every]
    scored = sums.select(*ROWS, "tokens", "copies", *[s.alias(f"z_{k}") for k, s in enumerate(score)])
    top = F.greatest(*[F.col(f"z_{k}") for k in every], F.lit(float("-inf")))
    mass = [F.exp(F.col(f"z_{k}") - top) for k in every]
    soft = scored.select(*ROWS, "tokens", "copies", *[F.round(m / sum(mass), DIGITS).alias(f"p_{k}") for k, m in enumerate(mass)])
    # what rounding leaves goes to the likeliest domain
    likeliest = F.greatest(*[F.col(f"p_{k}") for k in every], F.lit(0.0))
    first = F.array_position(F.array(*[F.col(f"p_{k}") for k in every]), likeliest)
    rest = 1 - sum(F.col(f"p_{k}") for k in every)
    return soft.select(*ROWS, "tokens", "copies", *[F.round(F.when(first == k + 1, F.col(f"p_{k}") + rest).otherwise(F.col(f"p_{k}")), DIGITS).alias(f"p_{k}") for k in every])


def fit_rates(members: DataFrame, domains: tuple[str, ...], targets: dict[str, float | None], steps: int = STEPS,
              tolerance: float = 5e-3, pull: float = PULL) -> DataFrame:
    """Adds ``rate``, nonnegative factors for which the expected tokens of each domain come near their target, and the misses.

    ``targets`` gives shares of all tokens (normalised to one); None keeps what a
    domain has. Minimises the squared misses plus ``pull`` times the squared distance
    of the rates from one, in the metric of document length. Without the pull, targets
    that soft posteriors cannot meet would be approached by dropping all documents
    but the few likeliest. Misses are measured in the metric in which documents can move
    them (the inverse of the domains' overlap, sums of p_j * p_k), so a projected
    gradient step of one never overshoots, and few are needed however alike the
    posteriors are. Documents of equal posterior have equal rates, so the steps run
    over one row per posterior; each is one distributed sum per domain. They end
    when the totals have settled, or after ``steps``. ``miss_k`` is what domain k then
    holds above its target, as a share of all tokens; misses above ``tolerance`` are
    told in a warning too.
    """
    every = range(len(domains))
    posterior = [f"p_{k}" for k in every]
    cells = members.groupBy(*posterior).agg(F.sum(F.col("copies") * F.col("tokens")).cast("double").alias("weight"))
    table = written(cells.withColumn("rate", F.lit(1.0)), "rates")
    weight = F.col("weight")

    def held(rate: Column) -> np.ndarray:
        row = table.select("weight", *posterior, rate.alias("_rate")).agg(*[F.coalesce(F.sum(weight * F.col(p) * F.col("_rate")), F.lit(0.0)) for p in posterior]).first()
        return np.array(row, float)

    pairs = [(j, k) for j in every for k in every if j <= k]
    sums = table.agg(*[F.coalesce(F.sum(weight * F.col(f"p_{j}") * F.col(f"p_{k}")), F.lit(0.0)) for j, k in pairs]).first()
    overlap = np.zeros((len(domains), len(domains)))
    for (j, k), v in zip(pairs, sums, strict=True):
        overlap[j, k] = overlap[k, j] = v
    metric = np.linalg.pinv(overlap, hermitian=True)
    now = start = held(F.lit(1.0))
    total = float(start.sum())
    given = sum(v for v in targets.values() if v is not None)
    kept = sum(s for d, s in zip(domains, start, strict=True) if targets.get(d) is None)
    goal = np.array([s if targets.get(d) is None else (total - kept) * targets[d] / given if given else 0.0 for d, s in zip(domains, start, strict=True)])

    rate, calm = F.col("rate"), 0
    for step in range(1, steps + 1):
        if calm >= CALM or total == 0:
            break
        slope = (metric @ (now - goal)).tolist()
        down = sum(F.col(p) * F.lit(x / (1 + pull)) for p, x in zip(posterior, slope, strict=True))
        # a step of 1 / (1 + pull) along the misses' gradient and the pull's
        rate = F.greatest(F.lit(0.0), rate * F.lit(1 / (1 + pull)) + F.lit(pull / (1 + pull)) - down)
        then = held(rate)
        calm = calm + 1 if np.abs(then - now).max() <= STILL * total else 0
        now = then
        if step % STEPS_PER_TABLE == 0:
            table, rate = written(table.select(*posterior, "weight", rate.alias("rate")), "rates"), F.col("rate")
    if (np.abs(now - goal) > tolerance * total).any():
        warnings.warn("targets not met; shares of all tokens, reached (target): " + ", ".join(
            f"{d} {a / total:.4f} ({g / total:.4f})" for d, a, g in zip(domains, now, goal, strict=True)), stacklevel=2)
    rates = written(table.select(*posterior, F.round(rate, 6).alias("rate")), "rates")
    misses = {f"miss_{k}": F.lit(round(float(a - g) / total, 9) if total else 0.0) for k, (a, g) in enumerate(zip(now, goal, strict=True))}
    return members.join(rates, posterior).withColumns(misses)


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float | None], steps: int = STEPS) -> DataFrame:
    """Memberships and fitted rates of all documents; ``plain_k`` are the shares of the domains among labels.

    Empty tables give empty results.
    """
    domains = tuple(targets)
    weights = fit_classifier(docs, label_domains(labels), domains)
    shares = [math.exp(w) for w in weights.where(F.col("word") == PRIOR).drop("word").first()]
    fitted = fit_rates(written(memberships(docs, weights, domains), "memberships"), domains, targets, steps)
    return fitted.withColumns({f"plain_{k}": F.lit(s) for k, s in enumerate(shares)})


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float | None]) -> DataFrame:
    """One row per document: words, posterior of each domain (p_<domain>), its rate, and the misses (miss_<domain>) of all rates."""
    fitted = mixture(docs, labels, targets)
    return (fitted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", F.col("tokens").cast("long").alias("tokens"), *[F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(targets)], "rate",
                    *[F.col(f"miss_{k}").alias(f"miss_{d}") for k, d in enumerate(targets)]))


def keep_mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float | None], least_rate: float = 0.5) -> DataFrame:
    """The documents without those whose rate is below ``least_rate`` because of their words; columns stay.

    A document goes only if it is more likely in the domains that have a target
    than in all others together, and than documents are on the whole: one without
    evidence, such as a null text, stays.
    """
    aimed = [k for k, d in enumerate(targets) if targets[d] is not None]
    likely = sum((F.col(f"p_{k}") for k in aimed), F.lit(0.0))
    evident = (likely > 0.5) & (likely > sum((F.col(f"plain_{k}") for k in aimed), F.lit(1e-6)))
    gone = mixture(docs, labels, targets).where((F.col("rate") < least_rate) & evident).select(*ROWS)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["_text_hash"]), "left_anti")
