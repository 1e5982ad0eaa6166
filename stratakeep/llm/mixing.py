"""Mixing documents to target weights by soft domain membership, in DataFrame operations only.

1. A table of labelled documents (at most ``max_examples``, the first by a hash of their ids) gives
   a classifier: per-domain log-likelihoods of every word of these documents, the mean over a
   document's known words, sharpened by a factor fitted on a held-out quarter.
2. Every document gets posteriors over the domains, in double precision.  Scoring joins its words
   with the word table, which is sent to every executor up to ``BROADCAST_WORDS`` words (beyond, the
   planner joins by word), and sums within the row's own partition, so only one narrow row a
   document crosses an exchange.
3. Rates r minimise sum_d (sum_i t_i p_id r_i - T_d)^2 / s_d subject to r_i >= ``least``, where t are
   tokens, s the present domain totals and T the targets.  Projected gradient from r = 1, with
   momentum that begins anew when the error grows, in the metric of the tokens, where its
   Lipschitz constant is 1.  An iteration is one pass over narrow rows (posteriors, tokens and the
   state of the rate) that ends in one total a domain; every ``STATE`` iterations the state is
   written, so that plans and recomputation stay short.

Edge cases: a null or wordless text has no tokens, the prior as posteriors and a rate like any
other; texts without known words get the prior; rows that repeat an id are rows of their own; null
ids pass through; without labelled rows there is one domain, named null, and all rates are 1; a
target whose domain no document can have is out of reach and left out of the fit; a domain
without a target has target 0; an empty table gives an empty result.  Columns other than
id and text are ignored.  There may be any number of domains, but each is a column of the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise

MAX_EXAMPLES = 8000
ITERATIONS = 100
#: Iterations end when no domain's share of the tokens moves by more.
TOLERANCE = 1e-5
#: With a least rate, wanted totals leave so much room for documents that count for several domains.
HEADROOM = 1.02
#: Iterations after which the state of every rate is written.
STATE = 10
#: Words up to which the classifier is sent to every executor.
BROADCAST_WORDS = 1_000_000
_SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
#: No word has white space, so this one can stand for the row itself.
_ROW = " "


def labelled_table(docs: DataFrame, labels: DataFrame, domain: str, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, domain, text) of a bounded sample of the documents that ``labels`` covers."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{domain}`").cast("string").alias("domain"), "text")
    return materialise(named.where("domain IS NOT NULL").join(F.broadcast(ids), "doc_id"), "labelled")


def _words(text: str) -> tuple[Column, Column]:
    """Words of a text with empty strings where white space is outside, and how many are words."""
    parts = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]+")
    count = F.size(parts) - (parts[0] == "").cast("int") - F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)
    return parts, count.cast("long")


class Classifier:
    """Word table (word, w0, w1, ...), log priors and sharpness."""

    def __init__(self, domains: list, words: DataFrame | None, priors: list[float], sharpness: float):
        self.domains, self.words, self.priors, self.sharpness = domains, words, priors, sharpness
        if words is not None and words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
            self.words = F.broadcast(words)

    def sums(self, docs: DataFrame, text: str, keep: dict[str, Column]) -> DataFrame:
        """One row a row of ``docs``: keep, n_tokens, known (matched words), s0, s1, ..."""
        parts, count = _words(text)
        rows = docs.select(*[c.alias(f"k_{name}") for name, c in keep.items()], F.monotonically_increasing_id().alias("row"), count.alias("n_tokens"), F.array_append(parts, F.lit(_ROW)).alias("words"))
        kept = [f"k_{name}" for name in keep]
        each = rows.select(*kept, "row", "n_tokens", F.explode("words").alias("word"))
        totals = [F.sum(f"w{i}").alias(f"s{i}") for i in range(len(self.domains))]
        out = each.join(self.words, "word").groupBy("row", "n_tokens", *kept).agg((F.count("*") - 1).alias("known"), *totals)
        return out.select(*[F.col(k).alias(name) for k, name in zip(kept, keep, strict=True)], "n_tokens", "known", *[f"s{i}" for i in range(len(self.domains))])

    def logits(self, means: Column, sharpness: float) -> Column:
        """An array of one value a domain from the array of mean log-likelihoods."""
        return F.zip_with(means, F.array(*[F.lit(p) for p in self.priors]), lambda m, p: p + F.lit(sharpness) * m)

    def means(self) -> Column:
        return F.array(*[F.col(f"s{i}") / F.greatest(F.col("known"), F.lit(1)) for i in range(len(self.domains))])


def fit_classifier(labelled: DataFrame) -> Classifier:
    """From (doc_id, domain, text): word likelihoods on three quarters, sharpness on the fourth."""
    counts = labelled.groupBy("domain").count().orderBy("domain").collect()
    domains = [r.domain for r in counts]
    if not domains:
        return Classifier([None], None, [0.0], 1.0)
    total = sum(r["count"] for r in counts)
    priors = [math.log((r["count"] + 1) / (total + len(counts))) for r in counts]
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(4)) == 0
    n = range(len(domains))
    parts, _ = _words("text")
    each = labelled.where(~held).select("domain", F.explode(parts).alias("word")).where("word <> ''")
    table = each.groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, True)).alias(f"c{i}") for i, d in enumerate(domains)])
    table = materialise(table, "word-counts")
    whole = table.agg(F.count("*").alias("v"), *[F.sum(f"c{i}").alias(f"c{i}") for i in n]).first()
    size = [(whole[f"c{i}"] or 0) + 1.0 for i in n]
    weights = table.select("word", *[F.log((F.col(f"c{i}") + 0.5) / (size[i] + 0.5 * whole.v)).alias(f"w{i}") for i in n])
    spark = labelled.sparkSession
    bias = spark.range(1).select(F.lit(_ROW).alias("word"), *[F.lit(0.0).alias(f"w{i}") for i in n])
    model = Classifier(domains, materialise(weights.unionByName(bias), "word-table"), priors, 1.0)
    scored = materialise(model.sums(labelled.where(held), "text", {"domain": F.col("domain")}), "held-out")
    at = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")).cast("int") - 1
    tried = scored.select(at.alias("at"), model.means().alias("m"))
    tried = tried.select("at", *[model.logits(F.col("m"), sharp).alias(f"x{k}") for k, sharp in enumerate(_SHARPNESS)])
    losses = []
    for k in range(len(_SHARPNESS)):
        x = F.col(f"x{k}")
        mass = F.aggregate(x, F.lit(0.0), lambda total, v: total + F.exp(v - F.array_max(x)))  # noqa: B023
        losses.append(F.avg(F.array_max(x) + F.log(mass) - F.get(x, F.col("at"))).alias(f"l{k}"))
    loss = tried.agg(*losses).first()
    if loss.l0 is not None:
        model.sharpness = min(zip(loss, _SHARPNESS, strict=True))[1]
    return model


def posteriors(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, p0, p1, ...: a posterior for each domain."""
    keep = {"doc_id": F.col(f"`{doc_id}`").cast("long")}
    if model.words is None:
        return docs.select(keep["doc_id"].alias("doc_id"), _words(text)[1].alias("n_tokens"), F.lit(1.0).alias("p0"))
    rows = model.sums(docs, text, keep).select("doc_id", "n_tokens", model.means().alias("m"))
    rows = rows.select("doc_id", "n_tokens", model.logits(F.col("m"), model.sharpness).alias("x"))
    rows = rows.select("doc_id", "n_tokens", "x", F.array_max("x").alias("top"))
    rows = rows.select("doc_id", "n_tokens", F.transform("x", lambda v: F.exp(v - F.col("top"))).alias("e"))
    rows = rows.select("doc_id", "n_tokens", "e", F.aggregate("e", F.lit(0.0), lambda total, v: total + v).alias("mass"))
    return rows.select("doc_id", "n_tokens", *[(F.get("e", F.lit(i)) / F.col("mass")).alias(f"p{i}") for i in range(len(model.domains))])


def _moved(state: DataFrame, pull: list[float], momentum: float, least: float) -> DataFrame:
    """One projected step of every rate, and the point that the next one starts from."""
    slope = sum([F.col(f"p{i}") * F.lit(x) for i, x in enumerate(pull) if i], F.col("p0") * F.lit(pull[0]))
    others = [c for c in state.columns if c not in ("rate", "ahead")]
    stepped = state.select(*others, "rate", F.greatest(F.lit(float(least)), F.col("ahead") - slope).alias("next"))
    return stepped.select(*others, F.col("next").alias("rate"), (F.col("next") + F.lit(momentum) * (F.col("next") - F.col("rate"))).alias("ahead"))


def fit_rates(scored: DataFrame, domains: list, targets: dict, least: float = 0.0, iterations: int | None = None) -> tuple[DataFrame, dict]:
    """``scored`` with a column ``rate``; and what was fitted: totals before, wanted, reached.

    ``scored`` has n_tokens, p0, p1, ... and other columns.  Totals are shares of the present
    tokens.  With ``least`` above 0 the wanted totals are scaled up until no domain has to shrink
    below it, and by ``HEADROOM``; posteriors that are spread wide can still keep a total above what
    is wanted, and the fit then comes as near as least squares can.
    """
    d = len(domains)
    state = scored.select("*", F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    out = lambda frame: frame.drop("ahead")
    nothing = {"before": {}, "wanted": {}, "reached": {}, "steps": 0}
    total = float(scored.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return out(state), nothing

    def totals(frame: DataFrame, rate: str) -> list[float]:
        row = frame.agg(*[F.sum(F.col("n_tokens") * F.col(rate) * F.col(f"p{i}")).alias(f"t{i}") for i in range(d)]).first()
        return [x / total for x in row]

    before = totals(state, "rate")
    known = [x > 0 for x in before]
    weight = [max(0.0, float(targets.get(name, 0.0))) if k else 0.0 for name, k in zip(domains, known, strict=True)]
    if not sum(weight):
        return out(state), nothing | {"before": dict(zip(domains, before, strict=True))}
    wanted = [w / sum(weight) for w in weight]
    scale = max([1.0, *(HEADROOM * least * b / w for b, w in zip(before, wanted, strict=True) if w > 0)])
    wanted = [scale * w for w in wanted]
    point, error, speed, done, written = before, math.inf, 1.0, 0, None
    while done < (ITERATIONS if iterations is None else iterations):
        pull = [(x - w) / b if b > 0 else 0.0 for x, w, b in zip(point, wanted, before, strict=True)]
        now = sum(e * e * b for e, b in zip(pull, before, strict=True))
        faster = 1.0 if now > error else (1 + math.sqrt(1 + 4 * speed * speed)) / 2  # else begin the momentum anew
        state = _moved(state, pull, (speed - 1) / faster if faster > 1 else 0.0, least)
        error, speed, done = now, faster, done + 1
        if done % STATE == 0:
            state = materialise(state, "rates")
            if written is not None:
                discard(written)
            written = state
        ahead = totals(state, "ahead")
        moved = max(abs(x - y) for x, y in zip(ahead, point, strict=True))
        point = ahead
        if moved < TOLERANCE:
            break
    said = {k: dict(zip(domains, v, strict=True)) for k, v in (("before", before), ("wanted", wanted), ("reached", totals(state, "rate")))}
    return out(state), said | {"steps": done}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict, least: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict]:
    """doc_id, n_tokens, domain (most probable), posteriors (array, domains in order), rate for
    every row of ``docs``; and what ``fit_rates`` reports, with the domains in order."""
    model = fit_classifier(labelled)
    p = [F.col(f"p{i}") for i in range(len(model.domains))]
    scored = materialise(posteriors(docs, model, doc_id, text), "posteriors")
    rated, said = fit_rates(scored, model.domains, targets, least)
    top = F.greatest(*p) if len(p) > 1 else p[0]
    domain = F.coalesce(*[F.when(x == top, F.lit(name).cast("string")) for x, name in zip(p, model.domains, strict=True)])
    return rated.select("doc_id", "n_tokens", domain.alias("domain"), F.array(*p).alias("posteriors"), "rate"), said | {"domains": model.domains}


def resample(docs: DataFrame, labelled: DataFrame, targets: dict, least: float = 0.0, seed: int = 0) -> DataFrame:
    """``docs`` with every row repeated as its rate says: the whole part, and once more with the
    probability of the rest, drawn from a hash of the id.  Rows that share an id share their
    largest draw; rows with a null id stay once."""
    mixed, _ = mix(docs, labelled, targets, least)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    copies = mixed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).alias("copies"))
    copies = materialise(copies.where("copies <> 1").withColumnRenamed("doc_id", "mixed_id"), "copies")
    columns = docs.columns
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(_quoted(columns))]
    joined = docs.select(*own, F.col("doc_id").cast("long").alias("own_id")).join(copies, F.col("own_id") == F.col("mixed_id"), "left")
    once = joined.where(F.coalesce("copies", F.lit(1)) > 0).withColumn("again", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))))
    return once.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def _quoted(columns: list[str]) -> list[str]:
    return [f"`{c}`" for c in columns]
