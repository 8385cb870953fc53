"""Sources mixed to target weights, small ones repeated up to a cap.

Every document has a soft membership in the domains of the plan: the posterior
of a token classifier, learned from a bounded sample of labelled documents, in
which the declared source is one more piece of evidence. How much the text may
say beside the label is itself learned, from labelled documents held out of the
fit. Nonnegative rates of documents are fitted by projected-gradient least
squares, so that the expected tokens of each domain meet its target; a rate never
exceeds the number of repeats allowed. Documents of equal membership share a
rate, so the fit runs over groups: each round is one aggregation of them, in
which a group finds its rate from the gradients of the rounds before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingloom.llm.tokens import TokenizerConfig, tokenizer
from lingloom.session import materialize


@dataclass(frozen=True)
class MixingConfig:
    """fit_rows: labelled documents of a source, at most, that the classifier learns from (a bounded sample);
    declared_trust: chance that a declared source is right; shrink: documents that the tokens of all sources count as
    for each; steps: of posteriors, which are rounded to 1/steps so that groups stay few; rounds and tolerance: of the
    gradient; seed: of the draw."""

    fit_rows: int = 300
    declared_trust: float = 0.98
    shrink: float = 2.0
    steps: int = 16
    rounds: int = 200
    tolerance: float = 1e-7
    seed: int = 5
    tokenizer: TokenizerConfig = TokenizerConfig()


# Strengths of the text that are tried on held-out documents; at 0 it says nothing.
STRENGTHS = [0.0, *[2.0**-k for k in range(9, -1, -1)]]


@dataclass(frozen=True)
class Classifier:
    names: list[str]  # the domains; one more column stands for all other sources
    prior: np.ndarray  # log shares
    logged: np.ndarray  # tokens by domains: log-likelihood of a token's presence
    strength: float = 0.0

    def said(self, ids: np.ndarray) -> np.ndarray:
        return self.logged[ids].sum(axis=0, dtype=np.float64) if len(ids) else np.zeros(len(self.prior))

    def posterior(self, ids: np.ndarray, declared: int, trust: float) -> np.ndarray:
        """``declared`` is the column of the declared source, -1 for none."""
        z = self.prior + self.strength * self.said(ids)
        if declared >= 0:
            # a wrong label is any other domain in proportion to its size, so that totals stay what they are
            other = np.exp(self.prior)
            other[declared] = 0.0
            away = np.log(np.maximum((1 - trust) * other / max(other.sum(), 1e-12), 1e-12))
            away[declared] = np.log(trust)
            z = self.strength * self.said(ids) + away
        p = np.exp(z - z.max())
        return p / p.sum()


def _domain(source: str, names: list[str]):
    """Column number of a declared source, the last for one that no plan names, -1 for none."""
    named = F.nullif(F.trim(F.col(source).cast("string")), F.lit(""))
    table = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)]) if names else None
    known = F.try_element_at(table, named) if table is not None else F.lit(None).cast("int")
    return F.when(named.isNull(), F.lit(-1)).otherwise(F.coalesce(known, F.lit(len(names)))).cast("int")


def _encoded(rows: DataFrame, config: MixingConfig, out, schema: str) -> DataFrame:
    """``out(batch without text, ids of each text)`` over batches whose last column is the text."""

    def run(batches):
        encode = tokenizer(config.tokenizer).encode_ordinary
        for b in batches:
            ids = [np.array(encode(t), dtype=np.int64) if t else np.zeros(0, dtype=np.int64) for t in b.column(b.num_columns - 1).to_pylist()]
            yield out(b, ids)

    return rows.mapInArrow(run, schema)


def fit_classifier(rows: DataFrame, names: list[str], config: MixingConfig) -> Classifier:
    """Token presence by domain from half of a bounded sample; its strength from the other half. ``rows`` is (key, domain, text)."""
    columns = len(names) + 1
    w = Window.partitionBy("domain").orderBy(F.xxhash64("key"), "key")
    labelled = rows.where("domain >= 0")
    chosen = labelled.select("key", "domain").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= config.fit_rows).select("key").distinct()
    half = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(2)).cast("int")
    # at most fit_rows documents a domain of the plan
    sample = materialize(labelled.join(F.broadcast(chosen), "key").select(half.alias("half"), "domain", "text"))

    def presence(b, ids):
        flat = [(d, int(x)) for d, i in zip(b.column(0).to_pylist(), ids) for x in [-1, *np.unique(i).tolist()]]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in flat], type=pa.int32()), pa.array([x for _, x in flat], type=pa.int64())], names=["domain", "token"])

    counted = _encoded(sample.where("half = 0").select("domain", "text"), config, presence, "domain int, token long").groupBy("domain", "token").count().collect()  # domains times vocabulary
    docs = np.zeros(columns)
    seen = np.zeros((max((r["token"] for r in counted), default=0) + 1, columns))
    for r in counted:
        if r["token"] < 0:
            docs[r["domain"]] = r["count"]
        else:
            seen[r["token"], r["domain"]] = r["count"]
    vocabulary = tokenizer(config.tokenizer).n_vocab
    table = np.zeros((vocabulary, columns))
    table[: len(seen)] = seen[:vocabulary]
    overall = (table.sum(axis=1) + 0.5) / (docs.sum() + 1)
    logged = np.log((table + config.shrink * overall[:, None]) / (docs + config.shrink)).astype(np.float32)
    sizes = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    prior = np.array([sizes.get(k, 0) + 0.5 for k in range(columns)])
    plain = Classifier(names, np.log(prior / prior.sum()), logged)
    shipped = rows.sparkSession.sparkContext.broadcast(plain)

    def said(b, ids):
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([shipped.value.said(np.unique(i)).tolist() for i in ids], type=pa.list_(pa.float64()))], names=["domain", "said"])

    held = _encoded(sample.where("half = 1").select("domain", "text"), config, said, "domain int, said array<double>").collect()
    if not held:
        return plain
    truth, z = np.array([r["domain"] for r in held]), np.array([r["said"] for r in held])

    share = np.exp(plain.prior)
    # a label is right by the trust in it, else that of any other domain in proportion to its size
    gives = (1 - config.declared_trust) * share[None, :] / np.maximum(1 - share[:, None], 1e-12)
    np.fill_diagonal(gives, config.declared_trust)

    def loss(strength: float) -> float:
        s = plain.prior + strength * z
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return float(-np.log((p / p.sum(axis=1, keepdims=True) * gives[:, truth].T).sum(axis=1)).mean())

    return Classifier(names, plain.prior, logged, min(STRENGTHS, key=loss))


def members_of(p: np.ndarray, steps: int) -> list[tuple[int, int]]:
    """Posterior in whole steps: (column, steps) of those with any, adding up to all of them."""
    whole = np.floor(p * steps).astype(int)
    for k in np.argsort(whole - p * steps, kind="stable")[: steps - int(whole.sum())]:
        whole[k] += 1
    return [(int(k), int(whole[k])) for k in np.flatnonzero(whole)]


def sized_members(docs: DataFrame, names: list[str], key: str, text: str, source: str, config: MixingConfig) -> DataFrame:
    """(key, n, sig) of each document, once a key; sig lists its domains and steps, and is empty if nothing is known of it."""
    rows = docs.select(F.col(key).alias("key"), _domain(source, names).alias("domain"), F.col(text).alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(fit_classifier(rows, names, config))
    trust, steps = config.declared_trust, config.steps

    def out(b, ids):
        c = shipped.value
        sig = []
        for d, i in zip(b.column(1).to_pylist(), ids):
            if d < 0 and not len(i):
                sig.append("")
            else:
                sig.append(",".join(f"{k}:{n}" for k, n in members_of(c.posterior(np.unique(i), d, trust), steps)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], type=pa.int64()), pa.array(sig, type=pa.string())], names=["key", "n", "sig"])

    kind = rows.schema["key"].dataType.simpleString()
    sized = _encoded(rows, config, out, f"key {kind}, n long, sig string")
    return materialize(sized.groupBy("key").agg(F.max(F.struct("n", "sig")).alias("x")).select("key", "x.n", "x.sig"))


def memberships(docs: DataFrame, key: str, text: str, source: str, config: MixingConfig = MixingConfig(), names: list[str] | None = None) -> DataFrame:
    """(key, n, members) with members an array of (domain, share); ``names`` are the domains, by default all sources of ``docs``."""
    if names is None:
        names = sorted(r[0] for r in docs.select(F.trim(F.col(source).cast("string"))).distinct().collect() if r[0])
    label = F.array(*[F.lit(n) for n in names], F.lit(None).cast("string"))
    part = lambda x: F.split(x, ":")
    members = F.transform(F.filter(F.split("sig", ","), lambda x: x != ""), lambda x: F.struct(F.get(label, part(x)[0].cast("int")).alias("domain"), (part(x)[1].cast("double") / config.steps).alias("share")))
    return sized_members(docs, names, key, text, source, config).select("key", "n", members.alias("members"))


@dataclass(frozen=True)
class Mixed:
    report: DataFrame  # mix_id, source, wanted, available, reached, reached_share, exhausted
    rates: DataFrame  # key, n, sig, mix_id, rate, cap
    names: list[str]
    steps: int


@dataclass(frozen=True)
class Plan:
    """The targets as arrays: mixes by domains."""

    mixes: list[str]
    names: list[str]
    wanted: np.ndarray  # nan where a mix does not name the domain
    repeats: np.ndarray


def shares_of(sigs: list[str], columns: int, steps: int) -> np.ndarray:
    out = np.zeros((len(sigs), columns))
    for row, sig in enumerate(sigs):
        for x in sig.split(",") if sig else []:
            k, n = x.split(":")
            out[row, int(k)] = int(n) / steps
    return out


def caps_of(shares: np.ndarray, plan: Plan) -> np.ndarray:
    """Repeats allowed to each group in each mix: those of its domains, weighed and cut to a whole number; 0 outside the mix."""
    return np.floor(shares[:, : len(plan.names)] @ np.nan_to_num(plan.repeats).T + 1e-9)


def rates_of(shares: np.ndarray, plan: Plan, history: list[np.ndarray]) -> np.ndarray:
    """Groups by mixes: the rate of each group after the gradient steps in ``history``, projected onto 0..cap at each."""
    caps = caps_of(shares, plan)
    rate = np.zeros_like(caps)
    part = shares[:, : len(plan.names)]
    for step in history:
        rate = np.clip(rate + part @ step.T, 0.0, caps)
    return rate


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", config: MixingConfig = MixingConfig()) -> Mixed:
    """Fit the rates of every mix in ``targets`` (mix_id, source, target_share, max_repeats, budget_share).

    A document belongs to the domains that its source and its tokens speak for;
    one without source by its tokens alone. Null texts have size 0. A source that
    does not occur is exhausted if anything is wanted of it. Exhausted: after the
    fit its expected tokens stay under target_share * budget_share * size of all
    documents, as every rate that serves it is at its cap. The plan, which does
    not grow with the documents, is held on the driver.
    """
    spark = docs.sparkSession
    rows = targets.select("mix_id", "source", F.col("target_share").cast("double").alias("s"), F.col("max_repeats").cast("double").alias("r"), F.col("budget_share").cast("double").alias("b")).distinct().collect()
    names = sorted({(r["source"] or "").strip() for r in rows} - {""})
    mixes = sorted({r["mix_id"] for r in rows})
    sized = sized_members(docs, names, key, text, source, config)
    groups = materialize(sized.groupBy("sig").agg(F.sum("n").alias("n")))
    total = float(groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    wanted, repeats = np.full((len(mixes), len(names)), np.nan), np.full((len(mixes), len(names)), np.nan)
    for r in rows:
        if (r["source"] or "").strip():
            at = mixes.index(r["mix_id"]), names.index(r["source"].strip())
            wanted[at], repeats[at] = (r["s"] or 0.0) * (r["b"] or 0.0) * total, r["r"] or 0.0
    plan = Plan(mixes, names, wanted, repeats)
    columns, steps = len(names) + 1, config.steps

    def sums(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Over all groups: reached and, for the step size, the free room by mix and domain, and the size of each domain."""

        def run(batches):
            reached, free = np.zeros_like(plan.wanted), np.zeros_like(plan.wanted)
            size = np.zeros(len(names))
            for b in batches:
                shares = shares_of(b.column(0).to_pylist(), columns, steps)
                part, n = shares[:, : len(names)], b.column(1).to_numpy().astype(float)
                rate = rates_of(shares, plan, history)
                reached += (rate * n[:, None]).T @ part
                free += ((rate < caps_of(shares, plan)) * n[:, None]).T @ (part * part.sum(axis=1, keepdims=True))
                size += n @ part
            yield pa.RecordBatch.from_arrays([pa.array([reached.ravel().tolist()], type=pa.list_(pa.float64())), pa.array([free.ravel().tolist()], type=pa.list_(pa.float64())), pa.array([size.tolist()], type=pa.list_(pa.float64()))], names=["reached", "free", "size"])

        parts = groups.mapInArrow(run, "reached array<double>, free array<double>, size array<double>").collect()  # one row a task
        add = lambda c, shape: np.sum([np.array(r[c]) for r in parts], axis=0).reshape(shape) if parts else np.zeros(shape)
        return add("reached", plan.wanted.shape), add("free", plan.wanted.shape), add("size", (len(names),))

    history: list[np.ndarray] = []
    reached, free, size = sums(history)
    for _ in range(config.rounds if len(names) else 0):
        gap = np.nan_to_num(plan.wanted - reached)
        # a full step for a domain alone; domains that share documents take part in each other's steps
        step = gap / np.maximum(np.maximum(free, size), 1e-9)
        history.append(np.where(np.isnan(plan.wanted), 0.0, step))
        before = reached
        reached, free, _ = sums(history)
        if np.abs(reached - before).max(initial=0.0) <= config.tolerance * max(total, 1.0):
            break
    out = []
    for i, m in enumerate(mixes):
        everything = float(np.nansum(np.where(np.isnan(plan.wanted[i]), 0.0, reached[i])))
        for j, n in enumerate(names):
            if not np.isnan(plan.wanted[i, j]):
                w, got = float(plan.wanted[i, j]), float(reached[i, j])
                out.append((m, n, w, float(size[j]), got, got / everything if everything else 0.0, bool(w - got > 1e-6 * w and w > 0)))
    report = spark.createDataFrame(out, "mix_id string, source string, wanted double, available double, reached double, reached_share double, exhausted boolean")
    shipped = spark.sparkContext.broadcast((plan, history))

    def rated(batches):
        p, h = shipped.value
        for b in batches:
            sigs = b.column(2).to_pylist()
            shares = shares_of(sigs, columns, steps)
            rate, cap = rates_of(shares, p, h), caps_of(shares, p)
            for i, m in enumerate(p.mixes):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m] * len(sigs), type=pa.string()), pa.array(rate[:, i]), pa.array(cap[:, i])], names=["key", "n", "sig", "mix_id", "rate", "cap"])

    kind = sized.schema["key"].dataType.simpleString()
    return Mixed(report, sized.mapInArrow(rated, f"key {kind}, n long, sig string, mix_id string, rate double, cap double"), names, steps)


def draw_copies(mixed: Mixed, config: MixingConfig = MixingConfig()) -> DataFrame:
    """(mix_id, key, n, sig, copies): the rate's whole part, and one more by a seeded coin of its fraction; never over the cap."""
    coin = F.pmod(F.xxhash64(F.lit(config.seed), "mix_id", "key"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.least((F.floor("rate") + (coin < F.col("rate") - F.floor("rate")).cast("int")), F.col("cap")).cast("int")
    return mixed.rates.withColumn("copies", copies).where("copies > 0").select("mix_id", "key", "n", "sig", "copies")


def drawn_report(mixed: Mixed, config: MixingConfig = MixingConfig()) -> DataFrame:
    """The report of the fit with what the draw gave: drawn tokens of each source, and their share of the mix."""
    part = F.split("m", ":")
    tokens = draw_copies(mixed, config).groupBy("mix_id", "sig").agg(F.sum(F.col("n") * F.col("copies")).alias("n"))
    by = tokens.select("mix_id", "n", F.explode(F.split("sig", ",")).alias("m")).where("m <> ''").select("mix_id", F.get(F.array(*[F.lit(n) for n in mixed.names], F.lit(None).cast("string")), part[0].cast("int")).alias("source"), (F.col("n") * part[1].cast("double") / mixed.steps).alias("n"))
    drawn = by.where("source is not null").groupBy("mix_id", "source").agg(F.sum("n").alias("drawn"))
    r = mixed.report.join(drawn, ["mix_id", "source"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0.0)))
    everything = F.sum("drawn").over(Window.partitionBy("mix_id"))
    return r.withColumn("drawn_share", F.when(everything > 0, F.col("drawn") / everything).otherwise(0.0))
