"""Mixing sources to target weights (operator 5), DataFrame and SQL functions and pyspark.ml only: a classifier fitted on the
labelled table gives each document's posterior over the domains, and projected gradient descent finds the nonnegative rate of
each document for which the expected tokens of the domains match the targets in the least-squares sense.

Domains: clean (good quality, not toxic), low (bad quality), toxic. A domain without a labelled row has posterior 0; with
fewer than two domains among the labels, or no labels, all documents belong to the one there is, or to clean. Labels that are
null are left out. A null or empty text has no tokens: it changes no total, and its rate follows from its posterior alone.
Repeated rows each get a rate. An empty table gives an empty result. Extra columns of either table are not looked at.

The classifier sees which of at most FEATURES words (lower case, without PUNCTUATION) a document has, and its variety of words,
share of symbols and share of capitals. A word counts if it depends on the label: its chi-square over the labelled rows is at
least LEAST_APART. A fifth of the labelled rows is held out to choose the weight of the penalty and
the temperature of the posteriors. At most LABELLED_ROWS labelled documents are used, the first by a hash of doc_id; that
number bounds what is broadcast too. Every row is scored, and every row counts in the totals."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oscine.llm import common as C

DOMAINS = ("clean", "low", "toxic")
LABELLED_ROWS = 12_000
FEATURES, LEAST_SEEN, LEAST_APART = 1000, 2, 20.0
PUNCTUATION = ".,;:!?()\"'#*$%&|<>"
PASSES = 2  # partitions of the labelled rows while the classifier is fitted
PENALTIES, TEMPERATURES = (0.002, 0.02), (0.5, 0.7, 1.0, 1.5, 2.0, 3.0)
#: The gap to the goal, as a share of it, that counts as none; the share of it that a step must bring; rounds until it is an error.
TOLERANCE, LEAST_GAIN, ROUNDS = 1e-4, 1e-2, 200
SCALES = (1.0, 1 / 4, 1 / 16)


def _described(docs: DataFrame) -> DataFrame:
    """tokens: the number of words; heads: the distinct words, lower case and without punctuation; and shares of some characters."""
    clean = F.coalesce(F.col("text"), F.lit(""))
    plain = F.split(F.lower(F.translate(clean, PUNCTUATION, "")), r"[\x20\x09-\x0D]+")
    df = docs.withColumn("tokens", F.regexp_count(clean, F.lit(C.WORD_PATTERN)).cast("long")).withColumn("heads", F.array_distinct(plain))
    long = F.greatest(F.length(clean), F.lit(1)).cast("double")

    def share(gone: str) -> F.Column:
        return (long - F.length(F.translate(clean, gone, ""))) / long

    return (
        df.withColumn("variety", F.size("heads") / F.greatest("tokens", F.lit(1)))
        .withColumn("symbols", share("#*$%&|<>!")).withColumn("capitals", share("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).drop("text")
    )


def _telling(train: DataFrame) -> list[str]:
    """The words that tell the labels apart best: at most FEATURES, by how far their counts are from independence."""
    sizes = train.groupBy("label").agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())
    counts = train.select("label", F.explode("heads").alias("head")).groupBy("head", "label").agg(F.count("*").alias("n"))
    seen = counts.groupBy("head").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST_SEEN)
    cells = seen.crossJoin(F.broadcast(sizes.withColumn("share", F.col("rows") / total))).join(counts, ["head", "label"], "left")
    expected = F.col("all") * F.col("share")
    apart = F.sum((F.coalesce("n", F.lit(0)) - expected) ** 2 / expected)
    found = cells.groupBy("head").agg(apart.alias("apart")).where(F.col("apart") >= LEAST_APART)
    return [r["head"] for r in found.orderBy(F.desc("apart"), "head").limit(FEATURES).collect()]


def _features(described: DataFrame, heads: list[str]) -> DataFrame:
    model = CountVectorizerModel.from_vocabulary(heads or [""], inputCol="heads", outputCol="seen", minTF=1.0)
    seen = model.setBinary(True).transform(described)
    joined = VectorAssembler(inputCols=["seen", "variety", "symbols", "capitals"], outputCol="features").transform(seen)
    return joined.drop("heads", "seen", "variety", "symbols", "capitals")


def _labelled(texts: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The described labelled documents: at most so many, one text for each doc_id."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    sample = known.select("doc_id", domain.cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    one = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", "own").alias("text"))
    return C.materialize(_described(one), "labelled")


def _fitted(train: DataFrame, heads: list[str], penalty: float):
    known = _features(train, heads).select("label", "features").repartition(PASSES).cache()
    model = LogisticRegression(maxIter=30, regParam=penalty, family="multinomial", probabilityCol="p").fit(known)
    known.unpersist()
    return model


def _tempered(temperature: float) -> F.Column:
    """The posteriors of all domains from a model's probabilities, flattened by the temperature."""
    p = vector_to_array("p")
    flat = [F.pow(F.coalesce(F.try_element_at(p, F.lit(k + 1)), F.lit(0.0)), F.lit(1 / temperature)) for k in range(len(DOMAINS))]
    return F.transform(F.array(*flat), lambda x: x / sum(flat))


def _chosen(train: DataFrame) -> tuple[float, float, dict[str, float]]:
    """The penalty and temperature under which the labels of a held-out fifth are most likely, and the figures there: log loss,
    accuracy, and the share of the toxic documents that are called toxic."""
    held = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(5)) == 0
    part, rest = train.where(~held), train.where(held)
    if rest.isEmpty() or part.select("label").distinct().count() < 2:
        return PENALTIES[-1], 1.0, {}
    heads, best = _telling(part), None
    for penalty in PENALTIES:
        scored = _fitted(part, heads, penalty).transform(_features(rest, heads))
        right, toxic = F.col("label") + 1, F.col("label") == DOMAINS.index("toxic")
        tempered = scored.select("label", *[_tempered(t).alias(f"p{i}") for i, t in enumerate(TEMPERATURES)])
        losses = [F.avg(-F.log(F.greatest(F.element_at(f"p{i}", right.cast("int")), F.lit(1e-6)))) for i in range(len(TEMPERATURES))]
        called = F.array_position("p0", F.array_max("p0")) == right
        *losses, accuracy, found = tempered.agg(*losses, F.avg(called.cast("double")), F.avg(F.when(toxic, called.cast("double")))).first()
        i = min(range(len(losses)), key=losses.__getitem__)
        if best is None or losses[i] < best[2]["log_loss"]:
            best = (penalty, TEMPERATURES[i], {"log_loss": losses[i], "accuracy": accuracy, "toxic_found": found})
    return best


def held_out(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> dict[str, float]:
    """How well the classifier does on labelled documents that it didn't see."""
    return _chosen(_labelled(docs.select("doc_id", "text", F.xxhash64("text").alias("own")), labels, labelled_rows))[2]


def posteriors(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, row and own (hashes of id and text, and of the text), tokens, and p, the posteriors in the order of DOMAINS."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = texts.withColumns({"row": F.xxhash64("doc_id", "text"), "own": F.xxhash64("text")})
    train = _labelled(texts.select("doc_id", "own", "text"), labels, labelled_rows)
    seen = sorted(int(r[0]) for r in train.select("label").distinct().collect())
    scored = _described(texts)
    if len(seen) < 2:
        only = seen[0] if seen else 0
        p = F.array(*[F.lit(float(k == only)) for k in range(len(DOMAINS))])
        return C.materialize(scored.select("doc_id", "row", "own", "tokens", p.alias("p")), "posteriors")
    penalty, temperature, _ = _chosen(train)
    heads = _telling(train)
    model = _fitted(train, heads, penalty)
    return C.materialize(model.transform(_features(scored, heads)).select("doc_id", "row", "own", "tokens", _tempered(temperature).alias("p")), "posteriors")


def _rate(steps: list[list[float]], most: float | None) -> F.Column:
    """The rate after the given steps: from 1 on, down each step, kept between 0 and most."""
    rate = F.lit(1.0)
    for step in steps:
        rate = rate - sum((F.col(f"p{k}") * float(x) for k, x in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate if most is None else F.least(F.lit(float(most)), rate))
    return rate


def totals(scored: DataFrame) -> dict[str, float]:
    """The expected tokens of each domain."""
    sums = scored.agg(*[F.sum(F.col("tokens") * F.element_at("p", i + 1)) for i in range(len(DOMAINS))]).first()
    return dict(zip(DOMAINS, (x or 0.0 for x in sums), strict=True))


def rates(scored: DataFrame, goal: dict[str, float], most: float | None = None) -> DataFrame:
    """Adds rate, and gap: how far the expected tokens are from the goal, as a share of it. goal: tokens of each domain.

    Each round is one aggregation, to the domains' expected tokens and to the curvature over the documents whose rate is free to
    move, which scales the gradient; a step that doesn't help is tried again shorter, and at last as the gradient's own, by the largest
    curvature of all documents, which never leads away from the goal. A document's rate after a round follows from the steps so far, which are a
    few numbers each, so that no round writes or shuffles documents. The rounds end at the goal, or where a step of either kind
    brings less than LEAST_GAIN of the gap."""
    k = len(DOMAINS)
    split = scored.withColumns({f"p{i}": F.element_at("p", i + 1) for i in range(k)})
    aim = np.array([goal.get(x, 0.0) for x in DOMAINS], float)
    if not aim.sum():
        return scored.withColumns({"rate": F.lit(0.0), "gap": F.lit(0.0)})
    steps: list[list[float]] = []
    best: tuple[float, list[list[float]]] | None = None
    newton = plain = np.zeros(k)
    tried = 0
    for _ in range(ROUNDS):
        free = (F.col("rate") > 0) if most is None else (F.col("rate") > 0) & (F.col("rate") < most)
        at = split.withColumn("rate", _rate(steps, most)).withColumn("free", F.when(free, F.col("tokens")).otherwise(0))
        sums = [F.sum(F.col("tokens") * F.col("rate") * F.col(f"p{i}")) for i in range(k)]
        sums += [F.sum(F.col("free") * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(k)]
        sums += [F.sum(F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(k)]
        got = np.array([x or 0.0 for x in at.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()], float)
        gap, curve, whole = got[:k] - aim, got[k : k + k * k].reshape(k, k), got[k + k * k :].reshape(k, k)
        size = float(np.linalg.norm(gap) / aim.sum())
        gained = best[0] - size if best else 1.0
        if gained > 0:
            best = (size, steps)
            # documents at a bound may have to leave it, so that they keep a part in the curvature
            curve = curve + whole * 0.01 + np.eye(k) * max(whole.trace(), 1.0) * 1e-6
            newton, plain = np.linalg.solve(curve, gap), gap / max(np.linalg.eigvalsh(whole)[-1], 1.0)
        helped = gained >= LEAST_GAIN * size
        if size <= TOLERANCE or tried == len(SCALES) and not helped:
            break
        tried = 0 if helped else tried + 1
        steps = [*best[1], (newton * SCALES[tried] if tried < len(SCALES) else plain).tolist()]
    else:
        raise RuntimeError(f"no rates after {ROUNDS} rounds: {best[0]} of the goal is left")
    return split.withColumns({"rate": _rate(best[1], most), "gap": F.lit(best[0])}).drop(*[f"p{i}" for i in range(k)])


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float | None = None, most: float | None = None, keep: str | None = None, **columns: str) -> DataFrame:
    """doc_id, row, own, tokens, p, rate, gap, copies of each row. copies is the whole number of times that the row is taken; its
    expectation over the hash of the row is the rate.

    targets: weights of the domains. budget: tokens in all, those of the table if None. keep: a domain whose confident documents
    are to stay as they are; the goal is then what they hold, with more of the other domains up to the weights' share."""
    scored = posteriors(docs, labels, **columns)
    have = totals(scored)
    if keep is None:
        whole = sum(have.values()) if budget is None else budget
        goal = {x: targets.get(x, 0.0) / sum(targets.values()) * whole for x in DOMAINS}
    else:
        confident = totals(scored.where(F.element_at("p", DOMAINS.index(keep) + 1) >= 0.5))
        goal = {x: max(confident[x], min(have[x], confident[keep] * targets.get(x, 0.0) / targets[keep])) for x in DOMAINS}
        goal[keep] = confident[keep]
    mixed = rates(scored, goal, most)
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "own"), F.lit(1 << 30)) / float(1 << 30)
    return mixed.withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))
