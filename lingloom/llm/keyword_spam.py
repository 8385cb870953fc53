"""Pages of repeated keywords, link lists and product tags.

A page's words are counted and ranked by SQL windows and a line is fitted to log
frequency over log rank: its slope and residual. The divergence of its word
pairs from prose is measured window by window, as surprise above what prose of
the same language and script has at comparable lengths; the median window stands
for most of the text. A two-class mixture, fitted by expectation maximization on
a histogram of the three, weighs them into a posterior, and pages more likely
than not to be no prose are found. No page is decided by anything else.

Prose is learned from the data: word pairs of all pages whose share of function
words is usual, then again of all pages that did not diverge from these. Pairs
are counted in tables of fixed size that tasks fill and add up, each distinct
text once, so that copies have no more weight than one page. Texts are read once
and never shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingloom.llm import language
from lingloom.llm.tally import tally
from lingloom.session import forget, materialize


@dataclass(frozen=True)
class SpamConfig:
    """pair_bits, word_bits, copy_bits: sizes of the counting tables, as powers of two; they do not grow with the data.
    window: words of a window. chunk_tokens: tokens worked on at once, which bounds memory. dearest: most that one word pair may cost, in nats. known: weight of pairs seen before
    against words alone. least: windows or pages of prose from which a language, script and length has a baseline of
    its own; below that it shares one with its script, or none. core: distance from prose, in deviations, up to which
    a page is used to learn prose. tail: degrees of freedom of the spread of prose. prior_pages: pages that the prior
    of the mixture counts as. cutoff: posterior from which a page is found."""

    pair_bits: int = 22
    word_bits: int = 18
    copy_bits: int = 20
    window: int = 32
    chunk_tokens: int = 150_000
    dearest: float = 7.0
    known: float = 0.9
    least: int = 20
    core: float = 3.0
    tail: float = 10.0
    prior_pages: float = 4.0
    iterations: int = 60
    cutoff: float = 0.5


# A token is an address, a letter of a dense script, a word, a number, a run of line ends, or a mark.
TOKEN = re.compile(r"https?://\S+|www\.\S+|[぀-ヿ㐀-鿿ก-๛]|[^\W\d_぀-ヿ㐀-鿿ก-๛]+|\d[\w.,-]*|\n+|[^\w\s]|_+")
# Letters and words of grammar in scripts without spaces.
DENSE_GRAMMAR = "はがをにでのとたもへらっ的了在是和把地得着过而也就不这那"
GRAMMAR = {w for listed in language.FUNCTION_WORDS.values() for w in listed.split()} | set(DENSE_GRAMMAR)
SCRIPT_OF = {name: k + 2 for k, (name, *_) in enumerate(language.SCRIPTS)}
LATIN = 1
# Japanese is written in three scripts at once
SCRIPT_OF["han"] = SCRIPT_OF["kana"]
SCRIPTS = len(language.SCRIPTS) + 2

_ID, _WEIGHT, _SCRIPT, _GRAMMAR = 32, 8, 8, 1


def _describe(token: str) -> int:
    """A token as a number: 32 bits of identity, 8 of weight (tenths of the root of its length), 8 of script, 1 for grammar."""
    first = token[0]
    name = "\n" if first == "\n" else "address" if token.startswith(("http", "www.")) else "0" if first.isdigit() else token
    script = 0
    if name == token and (first.isalpha() or "ก" <= first <= "๛"):
        script = next((SCRIPT_OF[s] for s, low, high, _ in language.SCRIPTS if low <= ord(first) <= high), LATIN)
    weight = round(10 * min(len(token), 25) ** 0.5)
    return xxhash.xxh32_intdigest(name) | weight << 32 | script << 40 | (token in GRAMMAR) << 48


class _Memo(dict):
    def __missing__(self, token: str) -> int:
        found = _describe(token)
        if len(token) <= 24:  # addresses do not come again
            self[token] = found
        return found


LINE = _describe("\n") & 0xFFFFFFFF


def cuts(n: int, window: int) -> np.ndarray:
    """Borders of the windows of a text of n tokens, all of about the same size."""
    k = max(1, round(n / window))
    return np.arange(k + 1) * n // k


def language_hash(lang: Column) -> Column:
    """A language code in any usual spelling as a number; what names no language is one language."""
    return F.hash(F.coalesce(language.normal_code(lang), F.lit("und")))


def tokenized(docs: DataFrame, config: SpamConfig = SpamConfig()) -> DataFrame:
    """(page, lang, n, content, grammar, script, ids, weights, scripts) for each page with a token, written once.

    ``docs`` is (page, lang, text). ids and weights hold a number a token, scripts the main script of each window.
    """
    kind = docs.schema["page"].dataType

    def run(batches):
        memo = _Memo()
        for b in batches:
            pages, langs, texts = (b.column(k).to_pylist() for k in range(3))
            at = 0
            while at < len(texts):
                found, kept, size = [], [], 0
                while at < len(texts) and size < config.chunk_tokens:
                    tokens = TOKEN.findall(texts[at].lower())
                    if tokens:
                        found.append(tokens)
                        kept.append(at)
                        size += len(tokens)
                    at += 1
                if kept:
                    if len(memo) > 400_000:
                        memo = _Memo()
                    yield described(found, [pages[k] for k in kept], [langs[k] for k in kept], b.schema.field(0).type, memo)

    def described(found, pages, langs, page_type, memo):
        n = np.array([len(t) for t in found], dtype=np.int64)
        x = np.fromiter(map(memo.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(n.sum()))
        ids, weights, scripts = (x & 0xFFFFFFFF).astype(np.uint32), (x >> 32 & 0xFF).astype(np.uint8), x >> 40 & 0xFF
        start = np.cumsum(n) - n
        borders = [cuts(k, config.window) for k in n.tolist()]
        windows = np.array([len(k) - 1 for k in borders])
        window_at = np.concatenate([k[:-1] + s for k, s in zip(borders, start.tolist())])
        of_window = np.repeat(np.arange(len(window_at)), np.diff(np.append(window_at, len(x))))
        letters = np.bincount(of_window * SCRIPTS + scripts, minlength=len(window_at) * SCRIPTS).reshape(-1, SCRIPTS)
        letters[:, 0] = 0
        first = np.cumsum(windows) - windows
        whole = np.add.reduceat(letters, first, axis=0)
        grammar = np.add.reduceat(x >> 48 & 1, start) / np.maximum(whole.sum(axis=1), 1)
        main = letters.argmax(axis=1).astype(np.uint8).tobytes()
        raw, weighed = ids.tobytes(), weights.tobytes()
        ends = (start + n).tolist()
        own = [raw[4 * s : 4 * e] for s, e in zip(start.tolist(), ends)]
        return pa.RecordBatch.from_arrays([
            pa.array(pages, type=page_type), pa.array(langs, type=pa.int32()), pa.array(n.astype(np.int32)), pa.array([xxhash.xxh64_intdigest(k) - (1 << 63) for k in own], type=pa.int64()),
            pa.array(grammar), pa.array(whole.argmax(axis=1).astype(np.int32)), pa.array(own, type=pa.binary()), pa.array([weighed[s:e] for s, e in zip(start.tolist(), ends)], type=pa.binary()),
            pa.array([main[s : s + k] for s, k in zip(first.tolist(), windows.tolist())], type=pa.binary()),
        ], names=TOKENIZED)

    named = docs.select("page", language_hash(F.col("lang")).alias("lang"), "text").where("text is not null")
    schema = f"page {kind.simpleString()}, lang int, n int, content long, grammar double, script int, ids binary, weights binary, scripts binary"
    return materialize(named.mapInArrow(run, schema))


TOKENIZED = ["page", "lang", "n", "content", "grammar", "script", "ids", "weights", "scripts"]


_ONE = 64  # the weight of a text that occurs once; copies share it


def _hashed(x: np.ndarray, bits: int) -> np.ndarray:
    return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Profile:
    """Word pairs and words of prose, in counts of texts; ``copies`` tells how often a text occurs."""

    pairs: np.ndarray
    words: np.ndarray
    copies: np.ndarray
    total: float


class Baselines(dict):
    """Median cost of windows of prose by level and key; nan where there is too little prose."""

    def of(self, lang: int, script: int, size: int) -> float:
        for key in ((0, lang, script, size), (1, script, size), (2, lang, script), (3, script)):
            if key in self:
                return self[key]
        return float("nan")


class Chunk:
    """Some rows of ``tokenized`` as flat arrays, so that they are worked on at once."""

    def __init__(self, batch: pa.RecordBatch, config: SpamConfig):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        flat = lambda name, kind: np.frombuffer(b"".join(column(name).to_pylist()), dtype=kind)
        self.n, self.lang, self.script = (column(c).to_numpy() for c in ("n", "lang", "script"))
        self.grammar, self.content = column("grammar").to_numpy(), column("content").to_numpy().view(np.uint64)
        self.ids = flat("ids", np.uint32)
        if "weights" in batch.schema.names:
            self.weights, self.scripts = flat("weights", np.uint8).astype(np.float64), flat("scripts", np.uint8)
        self.start = np.cumsum(self.n, dtype=np.int64) - self.n
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        if "weights" in batch.schema.names:
            self.cut(config)

    def cut(self, config: SpamConfig) -> None:
        borders = [cuts(n, config.window) for n in self.n.tolist()]
        self.windows = np.array([len(x) - 1 for x in borders], dtype=np.int64)
        self.window_at = np.concatenate([x[:-1] + s for x, s in zip(borders, self.start.tolist())]).astype(np.int64)
        self.window_owner = np.repeat(np.arange(len(self.n)), self.windows)
        long = np.diff(np.append(self.window_at, len(self.ids)))
        # half octaves of the tokens of a window; all windows of long pages are in the last
        self.size = np.minimum(np.floor(2 * np.log2(long)), np.floor(2 * np.log2(config.window * 0.75))).astype(np.int64)

    def slots(self, config: SpamConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of each pair, of its first word and of its second; a text begins after a line end."""
        after = self.ids.astype(np.uint64)
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[self.start] = LINE
        with np.errstate(over="ignore"):
            pair = (before * np.uint64(0x9E3779B97F4A7C15) + after) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - config.pair_bits)
            return pair.astype(np.int64), _hashed(before, config.word_bits), _hashed(after, config.word_bits)

    def shares(self, copies: np.ndarray, config: SpamConfig) -> np.ndarray:
        """What each text adds to a slot: the less, the more copies it has."""
        return np.maximum(1, _ONE // np.maximum(1, copies[(self.content >> np.uint64(64 - config.copy_bits)).astype(np.int64)])).astype(np.int64)

    def window_costs(self, profile: Profile, config: SpamConfig) -> np.ndarray:
        """Mean cost of the tokens of each window after the ones before them, under the pairs of prose.

        What a text adds itself is left out. Tokens weigh by the root of their
        length.
        """
        pair, before, after = self.slots(config)
        own = self.shares(profile.copies, config)[self.owner]
        n = np.maximum(profile.pairs[pair] - own, 0) / _ONE
        first, second = np.maximum(profile.words[before] - own, 0) / _ONE, np.maximum(profile.words[after] - own, 0) / _ONE
        cost = np.minimum(-np.log(config.known * n / (first + 2) + (1 - config.known) * (second + 0.1) / profile.total), config.dearest)
        return np.add.reduceat(cost * self.weights, self.window_at) / np.add.reduceat(self.weights, self.window_at)

    def divergence(self, cost: np.ndarray, baselines: Baselines) -> np.ndarray:
        return divergences(self.lang[self.window_owner], self.scripts, self.size, cost, self.windows, baselines)


def chunks(batches, config: SpamConfig):
    """(rows, chunk) of at most ``chunk_tokens`` tokens or one row."""
    for b in batches:
        n = b.column(b.schema.get_field_index("n")).to_numpy()
        at = 0
        while at < len(n):
            stop = at + max(1, int(np.searchsorted(np.cumsum(n[at:], dtype=np.int64), config.chunk_tokens, side="right")))
            rows = b.slice(at, stop - at)
            yield rows, Chunk(rows, config)
            at = stop


def divergences(lang, script, size, cost, windows, baselines: Baselines) -> np.ndarray:
    """Median excess over prose of the windows of each page; nan if for most of them there is no prose to compare with."""
    kinds, which = np.unique(np.stack([lang.astype(np.int64), script.astype(np.int64), size.astype(np.int64)], axis=1), axis=0, return_inverse=True)
    base = np.array([baselines.of(*k) for k in kinds.tolist()])
    excess = cost - base[which.reshape(-1)]
    owner = np.repeat(np.arange(len(windows)), windows)
    order = np.lexsort((excess, owner))  # nan comes last
    excess = excess[order]
    known = np.bincount(owner, weights=~np.isnan(cost - base[which.reshape(-1)]), minlength=len(windows)).astype(np.int64)
    start = np.cumsum(windows) - windows
    low, high = start + np.maximum(known - 1, 0) // 2, start + known // 2
    high = np.minimum(high, start + np.maximum(known - 1, 0))
    return np.where(2 * known >= windows, (excess[low] + excess[high]) / 2, np.nan)


def learn(tokens: DataFrame, copies: np.ndarray, config: SpamConfig, is_core, columns: list[str] | None = None) -> Profile:
    """The pairs of all pages for which ``is_core(chunk)`` holds, each distinct text once."""
    size, words = 1 << config.pair_bits, 1 << config.word_bits
    shipped = tokens.sparkSession.sparkContext.broadcast(copies)

    def add(table, batch):
        for _, chunk in chunks([batch], config):
            core = is_core(chunk)
            pair, before, _ = chunk.slots(config)
            mine = core[chunk.owner]
            # a pair counts once in a text: text, pair and first word in one sorted number
            packed = np.sort((chunk.owner[mine] << config.pair_bits | pair[mine]) << config.word_bits | before[mine])
            packed = packed[np.flatnonzero(np.diff(packed, prepend=-1))]
            one = chunk.shares(shipped.value, config)[packed >> config.pair_bits + config.word_bits]
            np.add.at(table, packed >> config.word_bits & size - 1, one)
            np.add.at(table, size + (packed & words - 1), one)

    table = tally(tokens.select(*(columns or TOKENIZED[1:])), size + words, add)
    pairs, single = table[:size], table[size:]
    # once the table is full, what any slot holds by chance counts for nothing
    return Profile(np.maximum(pairs - int(np.median(pairs)), 0).astype(np.int32 if pairs.max(initial=0) < 1 << 31 else np.int64), single, copies, max(float(single.sum()) / _ONE, 1.0))


def size_class(n):
    """Octaves of a number of tokens."""
    return F.floor(F.log2(n.cast("double"))).cast("int")


WINDOWS = "array<struct<script:int,size:int,cost:double>>"
COUNTS = "array<struct<c:bigint,m:bigint>>"


def _lists(count: np.ndarray, **columns) -> pa.Array:
    """An array of lists of structs from flat columns and the length of each list."""
    flat = pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), flat)


def measured(tokens: DataFrame, profile: Profile, config: SpamConfig, is_core, curves: bool = True) -> DataFrame:
    """(page, lang, n, content, script, core, windows, counts): the cost of each window, and, for ``curves``, how many words occur how often."""
    shipped = tokens.sparkSession.sparkContext.broadcast(profile)
    kind = tokens.schema["page"].dataType.simpleString()

    def run(batches):
        for rows, c in chunks(batches, config):
            core = is_core(c)
            cost = c.window_costs(shipped.value, config)
            words, often = np.unique(c.owner << 32 | c.ids, return_counts=True) if curves else (np.zeros(0, dtype=np.int64),) * 2
            kinds, many = np.unique((words >> 32) << 32 | often, return_counts=True)
            kept = [rows.column(rows.schema.get_field_index(x)) for x in ("page", "lang", "n", "content", "script")]
            windows = _lists(c.windows, script=c.scripts.astype(np.int32), size=c.size.astype(np.int32), cost=cost)
            counts = _lists(np.bincount(kinds >> 32, minlength=len(c.n)), c=kinds & 0xFFFFFFFF, m=many)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(core), windows, counts], names=["page", "lang", "n", "content", "script", "core", "windows", "counts"])

    return materialize(tokens.mapInArrow(run, f"page {kind}, lang int, n int, content long, script int, core boolean, windows {WINDOWS}, counts {COUNTS}"))


LEVELS = [["lang", "script", "size"], ["script", "size"], ["lang", "script"], ["script"]]


def quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """Of a histogram with ascending values."""
    upto = np.cumsum(counts)
    return float(values[min(int(np.searchsorted(upto, q * upto[-1])), len(values) - 1)])


def histograms(rows: DataFrame, keys: list[str], value: str, step: float, levels: list[list[str]]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """(values, counts) by level and key, from one aggregation in steps of ``step``; at most one row a key and step reaches the driver."""
    binned = rows.groupBy(*keys, F.round(F.col(value) / step).cast("int").alias("_bin")).count().collect()
    out: dict[tuple, dict[int, int]] = {}
    for r in binned:
        for level, names in enumerate(levels):
            bins = out.setdefault((level, *[r[k] for k in names]), {})
            bins[r["_bin"]] = bins.get(r["_bin"], 0) + r["count"]
    return {k: (np.array(sorted(v)) * step, np.array([v[x] for x in sorted(v)])) for k, v in out.items()}


def window_baselines(found: DataFrame, config: SpamConfig) -> Baselines:
    """Median cost of a window of prose by language, script and size, where there is enough prose, and by less.

    There are at most as many as two-letter codes times scripts times sizes.
    """
    rows = found.where("core").select("lang", F.explode("windows").alias("w")).select("lang", "w.*")
    return Baselines({k: quantile(*h, 0.5) for k, h in histograms(rows, LEVELS[0], "cost", 0.01, LEVELS).items() if h[1].sum() >= config.least})


def with_divergence(found: DataFrame, baselines: Baselines) -> DataFrame:
    """(page, lang, n, content, script, core, counts, divergence); the divergence is null where there is no prose to compare with."""
    shipped = found.sparkSession.sparkContext.broadcast(baselines)
    kind = found.schema["page"].dataType.simpleString()

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index("windows")
            w, n = b.column(k).flatten(), b.column(k).value_lengths().to_numpy().astype(np.int64)
            lang = np.repeat(b.column(b.schema.get_field_index("lang")).to_numpy(), n)
            value = divergences(lang, w.field(0).to_numpy(), w.field(1).to_numpy(), w.field(2).to_numpy(), n, shipped.value) if len(n) else np.zeros(0)
            yield b.set_column(k, "divergence", pa.array(value, type=pa.float64(), from_pandas=True))

    return found.select("page", "lang", "n", "content", "script", "core", "counts", "windows").mapInArrow(
        run, f"page {kind}, lang int, n int, content long, script int, core boolean, counts {COUNTS}, divergence double"
    )


def divergence_spread(scored: DataFrame) -> dict[int, float]:
    """Deviation of the divergence of prose by octave of length, from its lower half, which other pages hardly move."""
    rows = scored.where("core AND divergence is not null").select(size_class(F.col("n")).alias("size"), "divergence")
    found = histograms(rows, ["size"], "divergence", 0.005, [["size"]])
    own = {k[1]: quantile(*h, 0.5) - quantile(*h, 0.16) for k, h in found.items()}
    everywhere = float(np.median(list(own.values()))) if own else 0.3
    return {k[1]: max(own[k[1]] if h[1].sum() >= 8 else everywhere, 0.1) for k, h in found.items()}


def rank_frequency(scored: DataFrame) -> DataFrame:
    """(page, lang, n, script, core, divergence, slope, residual): the line of log frequency over log rank of each page.

    Words that occur equally often have neighbouring ranks, so a running sum over
    the counts of a page, a SQL window, gives the ranks without a row a word.
    """
    facts = F.struct("n", "content", "lang", "script", "core", "divergence", "counts")
    once = scored.groupBy("page").agg(F.max_by(facts, F.struct("n", "content")).alias("x")).select("page", "x.*")
    rows = once.select("page", "lang", "n", "script", "core", "divergence", F.explode_outer("counts").alias("w")).select("page", "lang", "n", "script", "core", "divergence", "w.c", "w.m")
    last = F.sum("m").over(Window.partitionBy("page").orderBy(F.desc("c")))
    ranked = rows.withColumn("_to", last)
    log = lambda r: F.log(r.cast("double"))
    sums = F.aggregate(
        F.sequence(F.col("_to") - F.col("m") + 1, F.col("_to")), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("xx")),
        lambda a, r: F.struct((a["x"] + log(r)).alias("x"), (a["xx"] + log(r) * log(r)).alias("xx")),
    )
    y = F.log(F.col("c").cast("double"))
    fit = ranked.withColumn("_s", sums).groupBy("page", "lang", "n", "script", "core", "divergence").agg(
        F.sum("m").cast("double").alias("k"), F.sum("_s.x").alias("sx"), F.sum("_s.xx").alias("sxx"), F.sum(F.col("m") * y).alias("sy"), F.sum(F.col("m") * y * y).alias("syy"), F.sum(y * F.col("_s.x")).alias("sxy")
    )
    xx = F.greatest(F.col("sxx") - F.col("sx") ** 2 / F.col("k"), F.lit(0.0))
    xy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("k")
    yy = F.greatest(F.col("syy") - F.col("sy") ** 2 / F.col("k"), F.lit(0.0))
    slope = F.when(xx > 1e-12, xy / xx).otherwise(0.0)
    return fit.select("page", "lang", "n", "script", "core", "divergence", slope.alias("slope"), F.sqrt(F.greatest(yy - slope * xy, F.lit(0.0)) / F.col("k")).alias("residual"))


def extremes(fitted: DataFrame, spread: dict[int, float], config: SpamConfig) -> DataFrame:
    """(page, divergence, spread, slope_z, residual_z): distances from prose of the same language and script and of comparable length.

    Baselines are bounded broadcasts: one row a two-letter code, script and octave.
    """
    f = fitted.withColumn("size", size_class(F.col("n")))
    levels = [["lang", "script", "size"], ["script", "size"], ["size"]]
    for c in ("slope", "residual"):
        found = {k: h for k, h in histograms(f.where("core"), levels[0], c, 0.01, levels).items() if h[1].sum() >= config.least}
        for level, keys in enumerate(levels):
            rows = [(*k[1:], quantile(*h, 0.5), max((quantile(*h, 0.84) - quantile(*h, 0.16)) / 2, 0.1)) for k, h in found.items() if k[0] == level]
            known = fitted.sparkSession.createDataFrame(rows, ", ".join(f"{k} int" for k in keys) + f", {c}_m{level} double, {c}_s{level} double")
            f = f.join(F.broadcast(known), keys, "left")

    def z(c: str) -> Column:
        middle, scale = (F.coalesce(*[F.col(f"{c}_{x}{level}") for level in range(len(levels))]) for x in "ms")
        return F.coalesce((F.col(c) - middle) / scale, F.lit(0.0))

    sigma = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in (spread or {0: 0.3}).items() for x in pair]), F.col("size")), F.lit(0.3))
    return f.select("page", "divergence", sigma.alias("spread"), z("slope").alias("slope_z"), z("residual").alias("residual_z"))


@dataclass(frozen=True)
class Mixture:
    """Share of pages that are no prose, and mean and deviation of divergence, slope and residual among them."""

    share: float
    normals: tuple[tuple[float, float], ...]

    def log_odds(self, divergence, spread, slope, residual, tail: float):
        """The same for numpy arrays and, by ``_log_odds_column``, for columns. A null divergence is nan and says nothing."""
        out = np.full(len(slope), np.log(self.share) - np.log(1 - self.share))
        for k, (x, s) in enumerate(((divergence, spread), (slope, np.full(len(slope), 1.2)), (residual, np.full(len(slope), 1.2)))):
            m, d = self.normals[k]
            at = np.minimum(x, m) if k == 0 else x  # beyond its mean a divergence speaks no less against prose
            ratio = -0.5 * ((at - m) / d) ** 2 - np.log(d) + (tail + 1) / 2 * np.log1p((at / s) ** 2 / tail) + np.log(s)
            out += np.where(np.isnan(x), 0.0, np.where((k == 0) & (x < 0), np.minimum(ratio, 0.0), ratio))
        return out


def log_odds_column(mixture: Mixture, tail: float) -> Column:
    out = F.lit(float(np.log(mixture.share) - np.log(1 - mixture.share)))
    for k, (name, s) in enumerate((("divergence", F.col("spread")), ("slope_z", F.lit(1.2)), ("residual_z", F.lit(1.2)))):
        m, d = mixture.normals[k]
        x = F.col(name)
        at = F.least(x, F.lit(m)) if k == 0 else x
        ratio = F.lit(-0.5) * F.pow((at - m) / d, F.lit(2.0)) - float(np.log(d)) + F.log1p(F.pow(at / s, F.lit(2.0)) / tail) * ((tail + 1) / 2) + F.log(s)
        known = F.when(x < 0, F.least(ratio, F.lit(0.0))).otherwise(ratio) if k == 0 else ratio
        out = out + F.when(x.isNull(), F.lit(0.0)).otherwise(known)
    return out


def fit_mixture(scored: DataFrame, config: SpamConfig) -> Mixture:
    """Expectation maximization on a histogram of the three measures. Its bins are bounded, however many pages there are."""
    bins = scored.select(
        F.when(F.col("divergence").isNotNull(), F.round(F.greatest(F.lit(-3.0), F.least(F.lit(7.0), "divergence")), 1)).alias("d"), "spread",
        *[F.round(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), c))).alias(c) for c in ("slope_z", "residual_z")],
    ).groupBy("d", "spread", "slope_z", "residual_z").count().collect()
    a = config.prior_pages
    prior = ((2.0, 1.0), (-4.0, 4.0), (3.0, 4.0))
    mixture = Mixture(0.05, prior)
    if not bins:
        return mixture
    x = [np.array([np.nan if r[c] is None else float(r[c]) for r in bins]) for c in ("d", "spread", "slope_z", "residual_z")]
    count = np.array([r["count"] for r in bins], dtype=float)
    p = np.where(x[0] > 4 * x[1], 0.9, 0.02)
    for _ in range(config.iterations):
        w = p * count
        normals = []
        for v, (m0, s0) in zip((x[0], x[2], x[3]), prior):
            known = np.where(np.isnan(v), 0.0, w)
            value = np.nan_to_num(v)
            m = float(((known * value).sum() + a * m0) / (known.sum() + a))
            s = float(np.sqrt(((known * (value - m) ** 2).sum() + a * s0**2) / (known.sum() + a)))
            normals.append((m, max(s, 0.5)))
        share = float(np.clip((w.sum() + 0.05 * a) / (count.sum() + a), 1e-4, 0.95))
        mixture = Mixture(share, tuple(normals))
        p = 1 / (1 + np.exp(-np.clip(mixture.log_odds(*x, config.tail), -50, 50)))
    return mixture


def keyword_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", config: SpamConfig = SpamConfig()) -> DataFrame:
    """(page, posterior, divergence, slope_z, residual_z) of the pages that are mostly no sentences.

    A null text, or one without a word or mark, is no such page. Each key is
    judged once; of repeated rows of a key the longest text counts. A null
    language, or one that is none, is a language of its own. Where the script of
    a page has too little prose in the data, its divergence is null and only its
    curve speaks. A page of a few tokens that prose never has side by side counts
    as no prose.
    """
    pages = docs.select(F.col(key).alias("page"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    tokens = tokenized(pages, config)
    spark = docs.sparkSession
    bits = config.copy_bits

    def add_copies(table, batch):
        content = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        np.add.at(table, content.astype(np.int64), 1)

    copies = np.minimum(tally(tokens.select("content"), 1 << bits, add_copies), np.iinfo(np.int32).max).astype(np.int32)
    # pages to begin with: by script, those with at least half the grammar of the pages that have much of it
    usual = {r["script"]: r["q"] / 2 for r in tokens.groupBy("script").agg(F.percentile_approx("grammar", 0.95, 2000).alias("q")).collect()}

    def usual_grammar(c: Chunk) -> np.ndarray:
        return c.grammar >= np.array([usual[x] for x in c.script.tolist()])

    first = learn(tokens, copies, config, usual_grammar, ["lang", "n", "content", "grammar", "script", "ids"])
    found = measured(tokens, first, config, usual_grammar, curves=False)
    baselines = window_baselines(found, config)
    spread = divergence_spread(with_divergence(found, baselines))
    shipped = spark.sparkContext.broadcast((first, baselines, spread))

    def near_prose(c: Chunk) -> np.ndarray:
        profile, known, sigma = shipped.value
        d = c.divergence(c.window_costs(profile, config), known)
        most = config.core * np.array([sigma.get(int(x), 0.3) for x in np.floor(np.log2(c.n))])
        return np.isnan(d) | (d <= most)

    forget(found)
    found = measured(tokens, learn(tokens, copies, config, near_prose), config, usual_grammar)
    scored = with_divergence(found, window_baselines(found, config))
    fitted = materialize(rank_frequency(scored))
    far = materialize(extremes(fitted, divergence_spread(fitted), config))
    odds = log_odds_column(fit_mixture(far, config), config.tail)
    forget(tokens, found, fitted)
    posterior = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), odds))))
    return far.withColumn("posterior", posterior).where(F.col("posterior") >= config.cutoff).select("page", "posterior", "divergence", "slope_z", "residual_z")
