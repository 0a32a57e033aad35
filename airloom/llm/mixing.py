"""Mixing to target weights: soft domain membership and nonnegative document rates by projected gradient."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airloom.llm.common import fresh, stored, texts, words_of

PULL = 1e-3  # weight of staying near the plain rate of 1
MOST_STEPS = 2_000  # an error beyond: the steps shrink by a constant factor, tens are usual
CLOSE = 1e-6
TEMPER = 0.5  # bytes of a text are not independent: n of them count as n ** TEMPER observations


def _counts(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode().lower(), np.uint8), minlength=256)


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of bytes per domain and log shares of the domains, from the rows of ``labelled`` (doc_id, domain).

    Byte counts are summed per partition, then per domain: ``domains`` times 256 numbers leave the executors.
    Rows of other or null domains do not count; a domain without rows has even byte shares.
    """
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").where(F.col("domain").isin(domains))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, rows = {d: np.zeros(256) for d in domains}, dict.fromkeys(domains, 0)
        for batch in batches:
            for text, domain in zip(batch["text"], batch["domain"]):
                totals[domain] += _counts(text)
                rows[domain] += 1
        yield pd.DataFrame({"domain": domains, "rows": [rows[d] for d in domains], "bytes": [totals[d] for d in domains]})

    summed = texts(docs).where("doc_id is not null").join(known, "doc_id").mapInPandas(
        run, "domain string, rows long, bytes array<double>")
    per = summed.groupBy("domain").agg(F.sum("rows").alias("rows"), *[F.sum(F.col("bytes")[i]).alias(f"b{i}") for i in range(256)])
    found = per.toPandas().set_index("domain").reindex(domains).fillna(0.0)  # a row for each domain
    shares = found[[f"b{i}" for i in range(256)]].to_numpy(float) + 0.5
    prior = found["rows"].to_numpy(float) + 1.0
    return np.log(shares / shares.sum(1, keepdims=True)), np.log(prior / prior.sum())


def domain_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """``doc_id, n_tokens, posterior`` (one share per domain, summing to 1) for every row of ``docs``."""
    log_bytes, log_prior = fit_domains(docs, labelled, domains)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shares = []
            for text in batch["text"]:
                counts = _counts(text)
                n = counts.sum()
                odds = log_prior + (log_bytes @ counts * n ** (TEMPER - 1) if n else 0)
                odds = np.exp(odds - odds.max())
                shares.append(odds / odds.sum())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(words_of(t)) for t in batch["text"]],
                                "posterior": shares})

    return texts(docs).mapInPandas(run, "doc_id long, n_tokens long, posterior array<double>")


def _rates(posterior: np.ndarray, pulls: list[np.ndarray], step: float, least: float, ahead: bool = False) -> np.ndarray:
    """A document's rate after the steps whose domain residuals are ``pulls``; needs nothing but its own row.

    A step starts from the rate carried on in the direction of the last one, which ``ahead`` returns: rates that bounds
    hold back settle in tens of steps instead of thousands.
    """
    rate = start = np.ones(len(posterior))
    most = (1 - np.sqrt(PULL * step)) / (1 + np.sqrt(PULL * step))
    pace = 1.0
    for pull in pulls:
        moved = np.maximum(least, start - step * (posterior @ pull + PULL * (start - 1)))
        pace, before = (1 + np.sqrt(1 + 4 * pace * pace)) / 2, pace
        start, rate = moved + min((before - 1) / pace, most) * (moved - rate), moved
    return start if ahead else rate


def _posteriors(batch: pd.DataFrame, size: int) -> np.ndarray:
    return np.array(batch["posterior"].tolist(), float).reshape(-1, size)


def fit_rates(members: DataFrame, shares: np.ndarray, budget: float | None = None,
              least: float = 0.0) -> tuple[list[np.ndarray], float]:
    """Projected gradient on document rates so that expected domain token totals meet ``shares`` of ``budget``.

    Minimises the squared errors of the totals plus ``PULL`` times the token-weighted squared distance of the rates from
    1, over rates of ``least`` or more. Each domain's error is scaled by its own curvature, so a domain that holds a
    thousandth of the tokens moves as fast as the others. Steps are taken until they change nothing any more. The
    budget is by default what all documents hold, or, with a ``least``, the smallest that reaches the shares from
    there. A step needs the domain totals of all documents, which are summed per partition, and yields one number per
    domain; the rates themselves are recomputed from these and are never collected.
    """
    size = len(shares)

    def totals(pulls: list[np.ndarray], step: float) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((size, size + 1))
            for batch in batches:
                p, n = _posteriors(batch, size), batch["n_tokens"].to_numpy(float)
                total[:, 0] += p.T @ (n * _rates(p, pulls, step, least, ahead=True))
                if not pulls:
                    total[:, 1:] += (p * n[:, None]).T @ p
            yield pd.DataFrame({"i": np.repeat(np.arange(size), size + 1), "j": np.tile(np.arange(size + 1), size),
                                "x": total.ravel()})

        summed = members.mapInPandas(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
        made = np.zeros((size, size + 1))
        for row in summed.collect():  # size * (size + 1) rows
            made[row["i"], row["j"]] = row["x"]
        return made

    plain = totals([], 0.0)
    reached = plain[:, 0]
    goal = shares * (budget or max(least * (reached / shares).max(), (least == 0) * reached.sum(), 1e-12))
    scale = np.maximum(plain[:, 1:].diagonal(), 1e-12)
    curve = plain[:, 1:] / np.sqrt(np.outer(scale, scale))  # ones on the diagonal; its largest value bounds the step
    step = 1 / (np.linalg.eigvalsh(curve).max() + PULL)
    pulls: list[np.ndarray] = []
    while True:
        pull = (reached - goal) / scale
        if pulls and np.abs(pull - pulls[-1]).max() <= CLOSE * max(1.0, np.abs(pulls[0]).max()):
            return pulls, step
        if len(pulls) == MOST_STEPS:
            raise RuntimeError(f"the rates have not settled after {MOST_STEPS} steps")
        pulls.append(pull)
        reached = totals(pulls, step)[:, 0]


def reached_shares(mixed: DataFrame, domains: list[str]) -> DataFrame:
    """``domain, tokens, share`` that the rates of :func:`mix` lead to in expectation: one row per domain."""
    parts = mixed.select((F.col("n_tokens") * F.col("rate")).alias("wanted"), F.posexplode("posterior").alias("i", "p"))
    each = parts.groupBy("i").agg(F.sum(F.col("wanted") * F.col("p")).alias("tokens"))
    names = F.array(*[F.lit(d) for d in domains])
    # One row per domain: the window is as small.
    return each.select(names[F.col("i")].alias("domain"), "tokens", (F.col("tokens") / F.sum("tokens").over(W.partitionBy())).alias("share"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None,
        least: float = 0.0) -> DataFrame:
    """``doc_id, n_tokens, posterior, rate, copies`` for every row of ``docs`` (``doc_id``, ``text``; others ignored).

    ``labelled`` (doc_id, domain) teaches the domains of ``targets``, whose positive weights are scaled to sum to 1.
    ``posterior`` holds a share per domain in the order of ``targets``, ``rate`` how often the row is wanted, and
    ``copies`` rounds it up or down by a hash of the id, so that the mean is the rate. Tokens are words. A
    null text is empty; empty texts have the labels' domain shares as posterior and no tokens. Rows without id have
    no label and round like each other. Repeated rows give repeated rows; no rows give none.
    """
    if not targets or min(targets.values()) <= 0:
        raise ValueError("every domain needs a positive target")
    domains = list(targets)
    shares = np.array([targets[d] for d in domains], float)
    members = stored(domain_posteriors(docs, labelled, domains), "mix-members")
    pulls, step = fit_rates(members, shares / shares.sum(), budget, least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(rate=_rates(_posteriors(batch, len(domains)), pulls, step, least))

    rated = members.mapInPandas(run, "doc_id long, n_tokens long, posterior array<double>, rate double")
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    return rated.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")))


def repeat_to_targets(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, at least once: no document is lost.

    Rows without id stay once. Rows that repeat a doc_id are one document and take the largest of their copies.
    """
    rated = mix(docs.where("doc_id is not null"), labelled, targets, least=1.0)
    more = rated.where("copies > 1").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    joined = docs.join(more, docs["doc_id"].cast("long") == more["doc_id"], "left")
    times = F.explode(F.sequence(F.lit(1), F.coalesce(more["copies"], F.lit(1)).cast("int")))
    return joined.select(*[docs[c] for c in docs.columns], times.alias(fresh(docs, "copy"))).select(docs.columns)
