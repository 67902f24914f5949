"""Toxicity scores by weak supervision.

Voters are lexicons and surface patterns. Lexicons beside a fixed one are mined from a bounded sample of labelled rows:
words and word beginnings that toxic rows have far more often than others, dealt over several lists. A generative label
model then looks at how the voters agree over *all* documents, without labels: given the class, most pairs of voters are
independent, so their covariance is the product of two numbers that say how much each depends on the class; pairs that
agree beyond that are correlated and count less. Its posterior is the label that a linear classifier over the mined
features is trained on; the classifier scores every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import kernels
from ledgerloom.llm.linkage import unused
from ledgerloom.plans.runtime import drop, ship, stage

#: Labelled rows from which lexicons are mined, clean and toxic ones at most, and on which the classifier is trained.
SAMPLE = (16_000, 8_000)
#: Lists that the mined features are dealt over, and the most features.
LISTS, FEATURES = 12, 20_000
#: A feature must stand in so many toxic rows of the sample, and toxic rows must be this share of its rows at even odds
#: of the classes, counting one row more of the other class than there is.
SUPPORT, PURITY = 4, 0.96
#: Purer features than this, whose class rates also differ by the factor, make lists of their own, the first so many.
PURE, FACTOR, PURE_LISTS = 0.97, 100, 8
PREFIXES = (4, 5, 6)
#: One row in so many is held out of everything that is learnt from labels.
FOLDS = 5
#: Share of toxic documents assumed where no label says it.
PRIOR = 0.1
#: Plain insults of everyday English, as a lexicon that needs no labels.
INSULTS = (
    "idiot idiots idiotic stupid moron moronic loser losers scum trash pathetic worthless disgusting clown dumb "
    "dumbass imbecile cretin bastard bitch asshole jerk freak vermin filth filthy retard degenerate lowlife"
).split()

_GAP = np.ones(256, bool)
_GAP[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = False
_KINDS = 1 + len(PREFIXES)
_SALTS = [np.uint64(x) for x in (11, 12, 13, 14)]
PATTERNS = ("shouting", "exclaiming", "masked")


def _tokens(body, starts, ends):
    """(hash, row) of words and word beginnings, each kind with a salt of its own."""
    h, rows, *heads = kernels.words(body, starts, ends, _GAP, PREFIXES)
    keys, at = [kernels.mix(h + _SALTS[0])], [rows]
    for salt, head in zip(_SALTS[1:], heads, strict=True):
        has = head != 0
        keys.append(kernels.mix(head[has] + salt))
        at.append(rows[has])
    return np.concatenate(keys), np.concatenate(at)


def _patterns(body, starts, ends):
    """(pattern, row) of the surface patterns that the rows show."""
    lo = starts[0]
    part = body[lo : ends[-1]]
    upper = np.cumsum(np.append(0, (part >= 65) & (part <= 90)))
    lower = np.cumsum(np.append(0, (part >= 97) & (part <= 122)))
    pairs = lambda c: np.cumsum(np.append(0, np.append((part[:-1] == c) & (part[1:] == c), False)))
    within = lambda total: total[np.maximum(ends - lo - 1, starts - lo)] - total[starts - lo]
    u, low = upper[ends - lo] - upper[starts - lo], lower[ends - lo] - lower[starts - lo]
    shown = [(u >= 20) & (u > low), within(pairs(ord("!"))) >= 2, within(pairs(ord("*"))) >= 1]
    return np.concatenate([np.full(int(x.sum()), k) for k, x in enumerate(shown)]), np.concatenate([np.flatnonzero(x) for x in shown])


def _blocks(column):
    body, starts, ends = kernels.string_buffers(column)
    for i, j in kernels.row_blocks(starts, ends):
        yield i, j, body, starts[i:j], ends[i:j]


def _group(batches):
    """Rows (toxic, text) with the least hash of five words of the text in a row, which near copies mostly have in common."""
    for batch in batches:
        out = []
        for _, _, body, starts, ends in _blocks(batch.column(1)):
            h, row = kernels.shingles(*kernels.words(body, starts, ends, _GAP), 5, len(starts))
            least = np.full(len(starts), 2**64 - 1, np.uint64)
            np.minimum.at(least, row, h)
            out.append(kernels.signed(least))
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(np.concatenate(out))], names=["toxic", "text", "doc_id", "group"])


def _mine(batches):
    """Rows (toxic, text) to (token, rows that have it, toxic ones of them), added up over a batch."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        keys, flags = [], []
        for i, _, body, starts, ends in _blocks(batch.column(1)):
            key, row = _tokens(body, starts, ends)
            order = np.argsort(row, kind="stable")
            values, at = kernels.distinct_sorted(key[order], row[order], len(starts))
            keys.append(values)
            flags.append(np.repeat(toxic[i : i + len(starts)], np.diff(at)))
        if keys and sum(map(len, keys)):
            token, where = np.unique(np.concatenate(keys), return_inverse=True)
            flag = np.concatenate(flags).astype(np.int64)
            yield pa.record_batch(
                [pa.array(kernels.signed(token)), pa.array(np.bincount(where)), pa.array(np.bincount(where, weights=flag).astype(np.int64))],
                names=["token", "n", "toxic"],
            )


def _features(vocabulary: np.ndarray):
    """Rows (id, text) to (id, numbers of the features present); patterns are numbered after the vocabulary."""
    size = len(vocabulary)
    order = np.argsort(vocabulary)
    ranked = vocabulary[order]

    def run(batches):
        for batch in batches:
            for i, j, body, starts, ends in _blocks(batch.column(1)):
                if ends[-1] > starts[0]:
                    key, row = _tokens(body, starts, ends)
                    at = np.minimum(np.searchsorted(ranked, key), max(size - 1, 0))
                    hit = ranked[at] == key if size else np.zeros(len(key), bool)
                    shown, where = _patterns(body, starts, ends)
                    number = np.concatenate([order[at[hit]], shown + size]) if size else shown
                    row = np.concatenate([row[hit], where]) if size else where
                    both = np.unique(row * (size + len(PATTERNS)) + number)
                    row, number = both // (size + len(PATTERNS)), both % (size + len(PATTERNS))
                else:
                    row = number = np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32)
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(number.astype(np.int32)))],
                    names=["doc_id", "features"],
                )

    return run


@dataclass
class LabelModel:
    """Prior of the class, and of each voter how often it votes given class 1 and class 0, and the weight of its vote."""

    prior: float
    hit: np.ndarray
    false: np.ndarray
    weight: np.ndarray
    correlated: list[tuple[int, int]]

    def posterior(self, votes: np.ndarray, silent: bool = True) -> np.ndarray:
        """Chance of class 1 for each row of votes. A voter that is silent says something too, unless ``silent`` is false
        and another one votes: then it abstains."""
        yes, no = np.log(self.hit / self.false), np.log((1 - self.hit) / (1 - self.false))
        said = np.where(votes, yes, 0 if not silent else no) * self.weight
        if not silent:
            said = np.where(votes.any(1)[:, None], said, no * self.weight)
        logit = np.log(self.prior / (1 - self.prior)) + said.sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit_label_model(patterns: np.ndarray, n: np.ndarray, prior: float, core: int, rounds: int = 3, excess: float = 0.15, steps: int = 60) -> LabelModel:
    """From how often each combination of votes occurs: ``patterns`` (combinations, voters) and their counts ``n``.

    Covariances give a first estimate and the correlated pairs; expectation-maximisation over the combinations, in which
    correlated voters weigh less, refines it. No label enters but the prior, and that only as a start. The first ``core``
    voters are known to speak for class 1 and alone decide what the classes are; what the others say is then measured.
    """
    votes, n = patterns.astype(float), n.astype(float)
    total, voters = max(n.sum(), 1.0), votes.shape[1]
    mean = n @ votes / total
    covariance = (votes * n[:, None]).T @ votes / total - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    live = mean * total >= 3
    use = ~np.eye(voters, dtype=bool) & live & live[:, None]
    correlated: list[tuple[int, int]] = []
    v = np.zeros(voters)
    for _ in range(rounds):
        v = spread * 0.5 * live
        for _ in range(300):
            denominator = (use * v**2).sum(1)
            then = np.where(denominator > 0, (use * covariance * v).sum(1) / np.maximum(denominator, 1e-15), 0)
            v = 0.5 * v + 0.5 * np.clip(then, 0, spread)
        rest = (covariance - np.outer(v, v)) / np.outer(spread, spread)
        far = use & (np.abs(rest) > excess)
        if not far.any() or (use & ~far).sum(1)[live].min(initial=3) < 2:
            break
        use &= ~far
        correlated += [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(far)), strict=True)]
    weight = np.ones(voters)
    for i, j in correlated:
        weight[i] += 1
        weight[j] += 1
    d = v / np.sqrt(prior * (1 - prior))
    clip = lambda x: np.clip(x, 1e-5, 1 - 1e-5)
    heard = np.where(live, 1 / weight, 0.0)
    leads = np.arange(voters) < core
    model = LabelModel(prior, clip(mean + (1 - prior) * d), clip(mean - prior * d), heard * leads, correlated)
    if live[:core].sum() < 3:  # fewer say nothing about each other: their votes are taken to be right nine times of ten
        trusted = np.where(leads, 0.9 * mean / prior, mean), np.where(leads, 0.1 * mean / (1 - prior), mean)
        return LabelModel(prior, np.clip(trusted[0], 1e-5, 0.9), clip(trusted[1]), heard, correlated)
    for _ in range(steps):
        hit, false = np.maximum(model.hit, 2e-5), np.where(leads, np.minimum(model.false, 0.5 * model.hit), model.false)
        toxic = LabelModel(model.prior, hit, clip(false), model.weight, correlated).posterior(patterns)
        one, none = n * toxic, n * (1 - toxic)
        share = float(np.clip(one.sum() / total, 0.5 * prior, min(2 * prior, 0.5)))
        model = LabelModel(share, clip((one @ votes + 0.01) / (one.sum() + 0.02)), clip((none @ votes + 0.01) / (none.sum() + 0.02)), model.weight, correlated)
    return LabelModel(model.prior, model.hit, clip(np.where(leads, np.minimum(model.false, 0.5 * model.hit), model.false)), heard, correlated)


def fit_linear(rows: list[np.ndarray], target: np.ndarray, importance: np.ndarray, size: int, steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features by gradient steps with momentum; targets may lie between 0 and 1."""
    count = np.array([len(x) for x in rows])
    which = np.repeat(np.arange(len(rows)), count)
    feature = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    w, b = np.zeros(size), 0.0
    vw, vb = np.zeros(size), 0.0
    importance = importance / importance.sum()
    seen = np.bincount(feature, weights=importance[which], minlength=size) + 1e-4
    for _ in range(steps):
        z = np.bincount(which, weights=w[feature], minlength=len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * importance
        gw = np.bincount(feature, weights=error[which], minlength=size) + ridge * w * seen
        vw, vb = 0.9 * vw - 0.25 * gw / (seen + 0.02), 0.9 * vb - 0.5 * error.sum()
        w, b = w + vw, b + vb
    return w, b


def _voter_table(size: int, listed: np.ndarray) -> np.ndarray:
    """Voter of each feature: the fixed lexicon is 0, mined lists follow, patterns come last."""
    return np.concatenate([listed, np.arange(len(PATTERNS)) + LISTS + 1]).astype(np.int64)


def _votes(rows: list[np.ndarray], voter: np.ndarray, voters: int) -> np.ndarray:
    votes = np.zeros((len(rows), voters), bool)
    for k, x in enumerate(rows):
        votes[k, voter[np.asarray(x, np.int64)]] = True
    return votes


def _combinations(voter: np.ndarray):
    """Rows (features) to (combination of votes as bits, rows that have it), added up over a batch."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            offsets = np.asarray(lists.offsets)
            flat = voter[np.asarray(lists.values)[offsets[0] : offsets[-1]].astype(np.int64)]
            bits = np.zeros(len(lists), np.int64)
            np.bitwise_or.at(bits, np.repeat(np.arange(len(lists)), np.diff(offsets)), np.int64(1) << flat)
            bits, n = np.unique(bits, return_counts=True)
            yield pa.record_batch([pa.array(bits), pa.array(n)], names=["votes", "n"])

    return run


def _score(w: np.ndarray, b: float):
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets)
            flat = np.asarray(lists.values)[offsets[0] : offsets[-1]].astype(np.int64)
            z = np.bincount(np.repeat(np.arange(len(lists)), np.diff(offsets)), weights=w[flat], minlength=len(lists)) + b
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=["doc_id", "score"])

    return run


def _fold(column):
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % FOLDS


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(doc_id, held_out boolean, score double, predicted int)``.

    Null and empty texts get the score of a text without any evidence. A null id is held out. Only rows of ``labels``
    that are not held out are learnt from, one label (the highest) per id, null labels not at all. Without labels of
    both classes only the fixed lexicon and the patterns vote. Repeated rows score alike; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(_fold(F.col("doc_id")) != 0)
    known = stage(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "known")
    share = known.agg(F.avg("toxic")).first()[0]
    prior = min(max(PRIOR if share is None else share, 1e-3), 0.5)
    chosen = None
    for kind, most in enumerate(SAMPLE):
        some = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    sample = stage(chosen, "sample")
    # near copies of one text say the same thing: one of them is asked
    texts = slim.join(F.broadcast(sample), "doc_id").select("toxic", "text", "doc_id").mapInArrow(_group, "toxic int, text string, doc_id long, group long")
    texts = stage(texts.dropDuplicates(["toxic", "group"]), "texts")
    counts = dict(texts.groupBy("toxic").count().collect())

    vocabulary, listed = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if counts.get(0) and counts.get(1):
        mined = texts.select("toxic", "text").mapInArrow(_mine, "token long, n long, toxic long")
        mined = mined.groupBy("token").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"))
        even = F.col("t") / counts[1] / (F.col("t") / counts[1] + (F.col("n") - F.col("t") + 1) / counts[0])
        good = mined.where(F.col("t") >= SUPPORT).where(even >= PURITY).orderBy(F.desc("t"), "token").limit(FEATURES)
        pure = (even >= PURE) & (F.col("t") * counts[0] >= FACTOR * (F.col("n") - F.col("t")) * counts[1])
        rows = good.select("token", pure.alias("pure")).collect()
        vocabulary = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        place = kernels.mix(vocabulary)
        first = place % np.uint64(PURE_LISTS)
        rest = np.uint64(PURE_LISTS) + place % np.uint64(LISTS - PURE_LISTS)
        listed = 1 + np.where(np.array([r[1] for r in rows], bool), first, rest).astype(np.int64)
    body = np.frombuffer("".join(INSULTS).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in INSULTS])
    fixed = kernels.mix(kernels.words(body, np.concatenate([[0], ends[:-1]]), ends, _GAP)[0] + _SALTS[0])
    fresh = ~np.isin(fixed, vocabulary)
    listed = np.concatenate([listed, np.zeros(int(fresh.sum()), np.int64)])
    vocabulary = np.concatenate([vocabulary, fixed[fresh]])
    voter, voters = _voter_table(len(vocabulary), listed), LISTS + 1 + len(PATTERNS)

    found = stage(slim.mapInArrow(_features(vocabulary), "doc_id long, features array<int>"), "features")
    sums = found.select("features").mapInArrow(_combinations(voter), "votes long, n long").groupBy("votes").agg(F.sum("n"))
    seen = np.array(sums.collect(), np.int64).reshape(-1, 2)  # at most 2 to the number of voters
    model = fit_label_model((seen[:, :1] >> np.arange(voters)) & 1 == 1, seen[:, 1], prior, LISTS + 1)

    train = found.join(F.broadcast(texts.select("doc_id").distinct()), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("features").collect()  # bounded by SAMPLE
    if not train:
        rest = found.where(_fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id")).limit(sum(SAMPLE))
        train = rest.select("features").collect()
    w, b = np.zeros(len(voter)), float(np.log(prior / (1 - prior)))
    if train:
        rows = [np.array(r[0], np.int64) for r in train]
        target = model.posterior(_votes(rows, voter, voters), silent=False)
        likely = target >= 0.5
        importance = np.where(likely, prior / max(likely.mean(), 1e-3), (1 - prior) / max(1 - likely.mean(), 1e-3))
        # each feature by itself too, or features that mostly occur together would share the credit of one
        single = [np.array([k]) for k in range(len(vocabulary))]
        alone = model.posterior(_votes(single, voter, voters), silent=False)
        seen_in = np.bincount(np.concatenate(rows), minlength=len(voter))[: len(vocabulary)] + 1
        weight = 0.2 * importance.sum() * seen_in / max(seen_in.sum(), 1)
        w, b = fit_linear(rows + single, np.append(target, alone), np.append(importance, weight), len(voter))
    scored = found.mapInArrow(_score(w, b), "doc_id long, score double")
    drop(known, texts)
    return scored.select("doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score as toxic. Rows of one id go together only if all of them are rejected."""
    scored = score(docs, labels, id_col, text_col)
    (key,) = unused(docs, "_id")
    toxic = stage(scored.groupBy("doc_id").agg(F.min("predicted").alias("p")).where("p = 1").select(F.col("doc_id").alias(key)), "toxic")
    return docs.join(toxic, docs[id_col].cast("long").eqNullSafe(F.col(key)), "left_anti")
