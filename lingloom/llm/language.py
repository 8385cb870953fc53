"""Language of documents and of each stretch of one language in them.

Bayesian evidence fusion. Each sentence gets a log-likelihood for every language
from its words and scripts. To that are added the log-odds of what is declared
for the record (markup language or label), of the address suffix, and of a host
prior: counts of declared labels by host, smoothed towards the counts of the
address suffix and those towards all records, computed by grouped aggregation.
A switch between two languages inside a record has a price, so that a sentence
of names and numbers goes with its neighbours.

Only the text stage runs in Python (Arrow batches, one dictionary look-up a
word); what leaves it is one small integer for each language and sentence.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingloom.functions.text import let
from lingloom.session import materialize

# Languages, each with its commonest function words (none where the script decides).
FUNCTION_WORDS = {
    "en": "the of and to in is was that for with on as at by from it this be are not which but or an were their has have he she they we you because when",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei nach wie oder war über einen unter wurde weil",
    "fr": "le la les de des et en un une du dans est pour que qui sur par au avec ne pas plus il elle ce cette sont aux ou mais d l qu n s c était parce",
    "es": "el la los las de y en que un una del por con para se es al como más su lo no fue pero sobre este esta entre o son ha porque desde hasta",
    "pt": "o a os as de e em que um uma do da dos das no na nos nas por com para se é ao à como mais seu não foi mas sobre entre são pelo pela já porque",
    "it": "il lo la i gli le di e in che un una del della dei delle per con non è si al alla da nel nella sono come più ma anche questo",
    "nl": "de het een en van in op te dat die voor met zijn is niet aan er om ook als bij door uit maar naar heeft worden werd",
    "sv": "och i att det som en på är av för med den till inte har de ett om var vid från eller men",
    "pl": "i w na z do się nie że jest to o jak po ale od przez za dla przy był która który",
    "tr": "ve bir bu da de için ile olarak çok daha gibi olan kadar sonra ne ama değil var",
    "id": "yang dan di dengan untuk pada dari ini itu dalam tidak adalah akan oleh ke sebagai juga",
    "ru": "и в на не что с по как это из у за от для к его но был так же она он они при до после или чтобы которые",
    "uk": "і в на не що з та як це із у за від для до його але був так вона він вони при або щоб які є",
    "bg": "и в на не че с по как това от за до се са е да който като но или при след със си",
    "ko": "", "ja": "", "zh": "", "th": "", "lo": "", "ar": "", "he": "", "el": "", "hi": "", "ka": "",
}
# Three-letter ISO 639 codes of these languages.
ISO3 = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl", "swe": "sv", "pol": "pl", "tur": "tr", "ind": "id",
    "rus": "ru", "ukr": "uk", "bul": "bg", "kor": "ko", "jpn": "ja", "zho": "zh", "chi": "zh", "cmn": "zh", "tha": "th", "lao": "lo", "ara": "ar", "heb": "he", "ell": "el", "gre": "el", "hin": "hi", "kat": "ka", "geo": "ka",
}
# Country suffixes of addresses and the language they speak for.
SUFFIX_LANGUAGE = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "pt": "pt", "br": "pt", "it": "it", "nl": "nl", "se": "sv", "pl": "pl", "tr": "tr", "id": "id",
    "ru": "ru", "ua": "uk", "bg": "bg", "kr": "ko", "jp": "ja", "cn": "zh", "tw": "zh", "th": "th", "la": "lo", "sa": "ar", "il": "he", "gr": "el", "in": "hi", "ge": "ka", "uk": "en", "us": "en", "au": "en",
}
# Scripts that speak for languages, the likeliest first, as ranges of code points.
SCRIPTS = [
    ("kana", 0x3041, 0x30FF, ["ja"]), ("hangul", 0xAC00, 0xD7A3, ["ko"]), ("jamo", 0x1100, 0x11FF, ["ko"]), ("thai", 0x0E01, 0x0E5B, ["th"]), ("lao", 0x0E81, 0x0EDF, ["lo"]),
    ("han", 0x3400, 0x9FFF, ["zh", "ja"]), ("cyrillic", 0x0400, 0x04FF, ["ru", "uk", "bg"]), ("arabic", 0x0600, 0x06FF, ["ar"]), ("hebrew", 0x0590, 0x05FF, ["he"]),
    ("greek", 0x0370, 0x03FF, ["el"]), ("devanagari", 0x0900, 0x097F, ["hi"]), ("georgian", 0x10A0, 0x10FF, ["ka"]),
]
# Words that stand for a missing text and belong to no language.
PLACEHOLDERS = ["n/a", "na", "none", "null", "nil", "nan", "tbd", "todo", "undefined", "empty", "missing", "unknown", "placeholder", "translation", "text", "target", "lorem ipsum", "xxx"]

LANGUAGES = list(FUNCTION_WORDS)
INDEX = {code: i for i, code in enumerate(LANGUAGES)}
LATIN = [c for c in LANGUAGES if FUNCTION_WORDS[c] and c not in ("ru", "uk", "bg")]
END = "\ue011"


@dataclass(frozen=True)
class LanguageConfig:
    """fit_rows: labelled records a language, at most, from which word counts are learned (a bounded sample); None: all.
    fit_words: words kept of each language. switch: price of a change of language, in nats.
    declared_trust: chance that a declared label is right. host_weight: records that the parent's prior counts as.
    heavy_rows: records from which a host is split; few: heavy hosts up to which their list is broadcast."""

    fit_rows: int | None = 500
    fit_words: int = 20_000
    least_rows: int = 4
    switch: float = 4.0
    declared_trust: float = 0.9
    host_weight: float = 20.0
    prior_weight: float = 0.5
    heavy_rows: int = 20_000
    few: int = 100_000


def normal_code(code: Column) -> Column:
    """Two-letter base of a language code in any usual spelling; null if it names no language."""
    base = F.substring_index(F.lower(F.trim(F.translate(code, "_", "-"))), "-", 1)
    names = F.create_map(*[F.lit(x) for pair in ISO3.items() for x in pair])
    return let(base, lambda b: F.when(F.length(b) == 3, F.element_at(names, b)).when((F.length(b) == 2) & b.rlike("^[a-z]{2}$") & ~b.isin("xx", "na", "zz"), b))


def address_suffix(url: Column) -> Column:
    """Last label of the host name of an address, lower case; null without one."""
    host = F.regexp_extract(F.lower(url), "^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_extract(host, "\\.([a-z]{2,})$", 1), F.lit(""))


class WordScorer:
    """Log-likelihoods of sentences. Words are looked up, never searched for."""

    # Addresses, quoted terms (quotations without a mark before a blank or the closing quote: not speech) and
    # codes are passed over; what is captured is a word, or an end of a unit. Units need not be whole sentences: to cut at an abbreviation makes two units of one language.
    WORD = re.compile(
        r"(?:https?://|www\.)[!-~]*"
        r"|[“„«「『‹\"](?:(?![.,!?;:…]+[\s”“»」』›\"])[^“”„«»「」『』‹›\"\n。！？，、" + END + r"])+[”“»」』›\"]"
        r"|[^\W\d_]*[0-9][0-9A-Za-z-]*"
        r"|([^\W\d_]+"
        r"|[\n\r\u0085\u2028\u2029" + END + r"]|[。！？｡।؟۔]+"
        r"|(?<=\w\w)[.!?…]+(?=[\s”»“\"')\]）]|[^\W\d_a-z])|(?<=[”»“\")）\]])[.!?…]+"
        r"|(?<=[\u0e01-\u0e5b])[ ](?=[^\s\u0e01-\u0e5b])|(?<=[^\s\u0e01-\u0e5b])[ ](?=[\u0e01-\u0e5b]))"
    )

    def __init__(self, words: dict[str, list[float]]):
        zero = [0.0] * len(LANGUAGES)
        rows = [zero, zero, zero]  # no evidence, end of a sentence, end of a text
        self.ids = {END: 2, "": 0}
        self.script_ids = []
        for name, low, high, codes in SCRIPTS:
            v = [-8.0] * len(LANGUAGES)
            for k, code in enumerate(codes):
                v[INDEX[code]] = -1.5 * k
            if name == "han":
                v[INDEX["ko"]] = -6.0
            self.script_ids.append((low, high, len(rows)))
            rows.append(v)
        # Japanese seldom goes on in Chinese characters alone: the longer such a run, the less likely
        self.han = next(k for (low, _, k), s in zip(self.script_ids, SCRIPTS) if s[0] == "han")
        self.long_han = []
        for penalty in (-4.0, -8.0):
            v = list(rows[self.han])
            v[INDEX["ja"]] = penalty
            self.long_han.append(len(rows))
            rows.append(v)
        plain = list(zero)  # a Latin word that no language knows: no East Asian prose, else nothing
        for code in LANGUAGES:
            if code not in LATIN:
                plain[INDEX[code]] = -0.3
        self.plain = len(rows)
        rows.append(plain)
        self.small = len(rows)  # the same in small letters: no name, so all the less East Asian prose
        rows.append([5 * x for x in plain])
        for word, v in words.items():
            if len(word) > 1 or word >= "\u0370":
                self.ids[word] = len(rows)
                rows.append(v)
        self.fixed = dict(self.ids)
        self.rows = np.array(rows, dtype=np.float32)
        self.strong = np.ones(len(rows), dtype=bool)
        self.strong[[0, 1, 2, self.plain, self.small]] = False
        self.look = self._memo(self.fixed)

    def _memo(self, start: dict[str, int]) -> dict[str, int]:
        scorer = self

        class Memo(dict):
            def __missing__(self, word: str) -> int:
                self[word] = found = scorer.classify(word)
                return found

        return Memo(start)

    def classify(self, word: str) -> int:
        if not word[0].isalpha():
            return 1
        if len(word) == 1 and word < "\u0370":
            return 0  # single Latin letters are initials and abbreviations as often as words
        found = self.fixed.get(word.lower())
        if found is not None:
            return found
        best = None
        for ch in word:
            c = ord(ch)
            if c >= 0x370:
                for low, high, k in self.script_ids:
                    if low <= c <= high:
                        if best is None or k < best:
                            best = k
                        break
        if best == self.han and len(word) >= 4:
            return self.long_han[len(word) >= 8]
        if best is None:
            return self.small if len(word) > 2 and word.islower() else self.plain
        return best

    def score(self, texts: list[str]) -> list[bytes]:
        """For each text its sentences' scores, one signed byte a language (quarters of a nat under the
        best), and one byte: whether any word spoke for a language."""
        if len(self.look) > 400_000:
            self.look = self._memo(self.fixed)
        blank = [not t or (len(t) < 40 and t.strip("[](){}<>\"' .\t\n").lower() in PLACEHOLDERS) for t in texts]
        tokens = self.WORD.findall("".join(("" if b else t.replace(END, " ")) + "\n" + END for t, b in zip(texts, blank)))
        ids = np.fromiter(map(self.look.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        ends = np.flatnonzero(ids == 1)
        if not len(ends):
            return [b""] * len(texts)
        starts = np.concatenate(([0], ends[:-1] + 1))
        total = np.add.reduceat(self.rows[ids], starts, axis=0)
        known = np.add.reduceat(self.strong[ids].astype(np.int32), starts) > 0
        total -= total.max(axis=1, keepdims=True)
        packed = np.empty((len(total), len(LANGUAGES) + 1), dtype=np.int8)
        packed[:, :-1] = np.maximum(np.round(total * 4), -127)
        packed[:, -1] = known
        of_text = np.searchsorted(np.flatnonzero(ids == 2), ends)  # each text ends in a line end and END
        cuts = np.searchsorted(of_text, np.arange(len(texts) + 1))
        return [packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def seed_words() -> dict[str, list[float]]:
    """The scorer before it has seen data: function words only."""
    words: dict[str, list[float]] = {}
    for code, listed in FUNCTION_WORDS.items():
        for word in listed.split():
            words.setdefault(word, [-4.0] * len(LANGUAGES))[INDEX[code]] = 0.0
    return words


def score_sentences(df: DataFrame, words, text_column: str, out: str = "packed") -> DataFrame:
    """Replace the column of texts by their packed scores, unit by unit; ``words`` is a broadcast word table."""
    fields = [T.StructField(out, T.BinaryType()) if f.name == text_column else f for f in df.schema.fields]

    token = uuid.uuid4().hex

    def run(batches):
        scorer = _scorer(token, words)
        for b in batches:
            k = b.schema.get_field_index(text_column)
            packed = pa.array(scorer.score(b.column(k).to_pylist()), type=pa.binary())
            yield b.set_column(k, out, packed)

    return df.mapInArrow(run, T.StructType(fields))


_SCORERS: dict[str, WordScorer] = {}


def _scorer(token: str, words) -> WordScorer:
    """The present scorer of this Python worker, made once from the broadcast word table."""
    if token not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[token] = WordScorer(words.value)
    return _SCORERS[token]


def best_language(packed: pd.Series) -> pd.Series:
    """Language of whole texts by the sum of their sentences; null without evidence."""
    out = []
    for p in packed:
        a = np.frombuffer(p, dtype=np.int8).reshape(-1, len(LANGUAGES) + 1)
        if not len(a) or not a[:, -1].any():
            out.append(None)
            continue
        total = a[a[:, -1] > 0, :-1].astype(np.int32).sum(axis=0)
        top = np.sort(total)[-2:]
        out.append(LANGUAGES[int(total.argmax())] if top[1] - top[0] >= 8 else None)
    return pd.Series(out, dtype=object)


def fit_words(records: DataFrame, config: LanguageConfig = LanguageConfig()) -> dict[str, list[float]]:
    """Word log-likelihoods learned from labelled records: all, or a bounded sample.

    Of each declared language the ``fit_rows`` records with the lowest hash are
    taken, or every record (then records must be distinct); those whose function words speak for another language are dropped as
    mislabelled. Words found in at least ``least_rows`` of a language's records
    are counted, the commonest ``fit_words`` are kept. Names fall out that way.
    """
    spark = records.sparkSession
    code = normal_code(F.col("declared"))
    fitted = LATIN + ["ru", "uk", "bg"]
    if config.fit_rows is None:
        sample = records.select("origin", "rec_key", "text", code.alias("code")).where(F.col("code").isin(fitted))
    else:
        narrow = records.select("origin", "rec_key", code.alias("code")).where(F.col("code").isin(fitted))
        w = Window.partitionBy("code").orderBy(F.xxhash64("origin", "rec_key"), "origin", "rec_key")
        chosen = narrow.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= config.fit_rows).select("origin", "rec_key", "code").distinct()
        sample = records.join(F.broadcast(chosen), ["origin", "rec_key"]).select("origin", "rec_key", "text", "code").dropDuplicates(["origin", "rec_key"])
    seeds = spark.sparkContext.broadcast(seed_words())
    scored = score_sentences(sample.withColumn("_m", F.coalesce("text", F.lit(""))), seeds, "_m")
    said = scored.select("code", "text", F.pandas_udf(best_language, T.StringType())("packed").alias("said"))
    clean = materialize(said.where(F.col("said").isNull() | (F.col("said") == F.col("code"))))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(\\p{L}+)"), F.lit(1)))
    counted = clean.select("code", F.explode(tokens).alias("word")).groupBy("code", "word").count().where(F.col("count") >= config.least_rows)
    top = Window.partitionBy("code").orderBy(F.desc("count"), "word")
    kept = counted.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= config.fit_words)
    rows = kept.select("code", "word", "count").collect()  # at most fit_words a language
    sizes = {r["code"]: r["n"] for r in clean.groupBy("code").agg(F.count("*").alias("n")).collect()}
    words = seed_words()
    rate: dict[str, dict[str, float]] = {}
    for r in rows:
        rate.setdefault(r["word"], {})[r["code"]] = r["count"] / sizes[r["code"]]
    floor = {c: 0.5 / (sizes.get(c, 0) + 100) for c in LANGUAGES}
    for word, by in rate.items():
        seeded = words.get(word)
        p = np.array([max(by.get(c, 0.0), floor[c], 0.02 if seeded and seeded[i] == 0.0 else 0.0) for i, c in enumerate(LANGUAGES)])
        v = np.log(p) - np.log(p.max())
        words[word] = [float(x) for x in np.maximum(v, -5.0)]
    return words


def host_priors(records: DataFrame, config: LanguageConfig = LanguageConfig()) -> tuple[DataFrame, dict[str, float]]:
    """(host, suffix, rows, prior) with prior an array of smoothed counts by language and their sum, and the log shares of all records.

    Counts of declared labels by host are smoothed towards those by address
    suffix, and these towards all: n_host + w * parent, whose sum is total + w;
    so a record can take its own label out again. Two grouped aggregations over
    narrow columns; texts are not read.
    """
    code = normal_code(F.col("declared"))
    known = F.when(code.isin(LANGUAGES), code)
    by = records.select("host", F.coalesce("suffix", F.lit("")).alias("suffix"), known.alias("code")).groupBy("host", "suffix", "code").count()
    overall = by.where("code is not null").groupBy("suffix", "code").agg(F.sum("count").alias("n"))
    w = config.host_weight
    total = np.full(len(LANGUAGES), 0.5)
    for r in overall.groupBy("code").agg(F.sum("n").alias("n")).collect():
        total[INDEX[r["code"]]] += r["n"]
    base = total / total.sum()
    count = lambda counts, c: F.coalesce(F.element_at(counts, F.lit(c)), F.lit(0))
    of_suffix = overall.groupBy("suffix").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("m"), F.sum("n").alias("k"))
    # a country suffix speaks for its language before any page has been seen
    spoken = F.try_element_at(F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair]), F.col("suffix"))
    bonus = lambda c: F.when(spoken == c, w).otherwise(0.0)
    parents = of_suffix.select("suffix", F.array(*[(count("m", c) + w * float(base[i]) + bonus(c)) / (F.col("k") + w + F.when(spoken.isNotNull(), w).otherwise(0.0)) for i, c in enumerate(LANGUAGES)]).alias("parent"))
    own = by.groupBy("host", "suffix").agg(
        F.map_from_entries(F.filter(F.collect_list(F.struct("code", "count")), lambda x: x["code"].isNotNull())).alias("m"), F.sum(F.when(F.col("code").isNotNull(), F.col("count")).otherwise(0)).alias("k"), F.sum("count").alias("rows")
    )
    few = parents.limit(config.few + 1).count() <= config.few
    joined = own.join(F.broadcast(parents) if few else parents, "suffix", "left")
    parent = lambda i: F.coalesce(F.get("parent", F.lit(i)), F.lit(float(base[i])))
    smoothed = F.array(*[(count("m", c) + w * parent(i)).cast("float") for i, c in enumerate(LANGUAGES)], (F.col("k") + w).cast("float"))
    return joined.select("host", "suffix", "rows", smoothed.alias("prior")), {c: float(np.log(base[i])) for i, c in enumerate(LANGUAGES)}


def _viterbi(x: np.ndarray, switch: float) -> np.ndarray:
    """Best path through sentence scores with a price for each change of language."""
    at = x[0].copy()
    back = np.zeros(x.shape, dtype=np.int16)
    stay = np.arange(x.shape[1])
    for k in range(1, len(x)):
        best = int(at.argmax())
        jump = at[best] - switch
        moved = jump > at
        back[k] = np.where(moved, best, stay)
        at = np.where(moved, jump, at) + x[k]
    path = np.empty(len(x), dtype=np.int16)
    path[-1] = at.argmax()
    for k in range(len(x) - 1, 0, -1):
        path[k - 1] = back[k][path[k]]
    return path


RUNS = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("first", pa.int32()), ("last", pa.int32())])


def decode_batch(packed: list[bytes], priors: list, declared: list, base: np.ndarray, config: LanguageConfig) -> pa.Array:
    """Runs of one language in each record: evidence of its sentences fused with what is known of the record.

    Records whose sentences all agree, the great majority, are decided for the
    whole batch at once; only mixed ones walk the trellis.
    """
    width = len(LANGUAGES)
    miss = np.log((1 - config.declared_trust) / (width - 1))
    hit = np.log(config.declared_trust)
    alone = np.append(np.exp(base) * config.host_weight, config.host_weight)
    smoothed = np.array([alone if q is None else q for q in priors], dtype=np.float64).reshape(-1, width + 1)
    code = np.array([INDEX.get(d, -1) for d in declared], dtype=np.int32)
    named = np.flatnonzero(code >= 0)
    counted = named[np.array([priors[k] is not None for k in named.tolist()], dtype=bool)]
    # a record's own label speaks for itself below, not in the prior of its host as well
    smoothed[counted, code[counted]] = np.maximum(smoothed[counted, code[counted]] - 1, 1e-3)
    smoothed[counted, -1] -= 1
    about = (np.log(smoothed[:, :-1]) - np.log(np.maximum(smoothed[:, -1:], 1e-3))).astype(np.float32) * config.prior_weight
    about[named] += miss
    about[named, code[named]] += hit - miss
    about -= about.max(axis=1, keepdims=True)
    a = np.frombuffer(b"".join(packed), dtype=np.int8).reshape(-1, width + 1)
    size = np.fromiter((len(p) for p in packed), dtype=np.int64, count=len(packed)) // (width + 1)
    start = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(packed)), size)
    known = a[:, -1] != 0
    spoken = np.bincount(owner[known], minlength=len(packed))
    evidence = a[:, :-1].astype(np.float32) / 4
    evidence[~known] = 0.0
    # what is known of the record speaks once, not for every sentence, and not for names and numbers
    x = evidence + (about / np.maximum(spoken, 1)[:, None])[owner] * known[:, None]
    tops = x.argmax(axis=1).astype(np.int16)
    first_known = np.full(len(packed), -1, dtype=np.int64)
    rows = np.flatnonzero(known)[::-1]
    first_known[owner[rows]] = rows
    lead = np.where(first_known >= 0, tops[np.maximum(first_known, 0)] if len(tops) else 0, -1)
    mixed = np.zeros(len(packed), dtype=bool)
    mixed[owner[known & (tops != lead[owner])]] = True
    path = lead[owner].astype(np.int16)
    for r in np.flatnonzero(mixed):
        path[start[r] : start[r + 1]] = _viterbi(x[start[r] : start[r + 1]], config.switch)
    z = np.exp(evidence + about[owner] - (evidence + about[owner]).max(axis=1, keepdims=True))
    sure = z[np.arange(len(z)), np.maximum(path, 0)] / z.sum(axis=1)
    begins = np.ones(len(path), dtype=bool)
    begins[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
    begins &= spoken[owner] > 0
    at = np.flatnonzero(begins)
    if not len(at):
        return pa.array([[] for _ in packed], type=pa.list_(RUNS))
    counted = np.where(known, 1.0, 0.0)
    ends = np.minimum(np.concatenate((at[1:], [len(path)])), start[owner[at] + 1])
    sums = np.concatenate(([0.0], np.cumsum(sure * counted)))
    ns = np.concatenate(([0.0], np.cumsum(counted)))
    confidence = (sums[ends] - sums[at]) / np.maximum(ns[ends] - ns[at], 1)
    names = pa.array(LANGUAGES).take(pa.array(path[at].astype(np.int32)))
    flat = pa.StructArray.from_arrays(
        [names, pa.array(np.round(confidence, 4)), pa.array((at - start[owner[at]]).astype(np.int32)), pa.array((ends - 1 - start[owner[at]]).astype(np.int32))], fields=list(RUNS)
    )
    runs_of = np.bincount(owner[at], minlength=len(packed))
    offsets = np.concatenate(([0], np.cumsum(runs_of))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def _decode(config: LanguageConfig, base: list[float]):
    known = np.array(base, dtype=np.float32)

    def run(batches):
        for b in batches:
            runs = decode_batch(b.column("packed").to_pylist(), b.column("prior").to_pylist(), b.column("declared").to_pylist(), known, config)
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("rec_key"), b.column("declared"), runs], names=["origin", "rec_key", "declared", "runs"])

    return run


def identify(records: DataFrame, config: LanguageConfig = LanguageConfig(), words: dict[str, list[float]] | None = None) -> DataFrame:
    """Languages of records.

    ``records`` has origin, rec_key, text, declared, host, suffix (strings; any
    may be null). Returns origin, rec_key, declared (normal code or null) and
    runs: array of (lang, confidence, first, last) over the record's pieces. One
    row for each (origin, rec_key); repeated rows count once. A null or blank
    text, and one without any word of a language, has no runs.
    """
    spark = records.sparkSession
    words = fit_words(records, config) if words is None else words
    shipped = spark.sparkContext.broadcast(words)
    priors, base = host_priors(records, config)
    prepared = records.select("origin", "rec_key", "host", F.coalesce("suffix", F.lit("")).alias("suffix"), normal_code(F.col("declared")).alias("declared"), F.col("text").alias("_m"))
    scored = score_sentences(prepared, shipped, "_m")
    # a host may hold a third of all rows: the records of such a host, by exact count, go to several partitions, its prior to each of them
    parts = F.ceil(F.col("rows") / config.heavy_rows).cast("long")
    heavy = priors.where(F.col("rows") > config.heavy_rows).groupBy("host").agg(F.max(parts).alias("_parts"))
    listed = heavy.limit(config.few + 1).collect()
    if len(listed) > config.few:
        raise ValueError("more heavy hosts than a broadcast holds: raise heavy_rows")
    split = spark.createDataFrame([(r["host"], r["_parts"]) for r in listed], "host string, _parts long")
    on_host = lambda df: df.join(F.broadcast(split), "host", "left") if listed else df.withColumn("_parts", F.lit(None).cast("long"))
    salted = on_host(scored).withColumn("_salt", F.pmod(F.xxhash64("origin", "rec_key"), F.coalesce("_parts", F.lit(1).cast("long"))))
    spread = on_host(priors).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1)) if listed else F.lit(0).cast("long"))
    on = [salted["host"] == spread["host"], salted["suffix"] == spread["suffix"], salted["_salt"] == spread["_salt"]]
    fused = salted.join(spread, on, "left").select(salted["host"], salted["_salt"], "origin", "rec_key", "declared", "packed", "prior")
    once = fused.groupBy("origin", "rec_key").agg(F.max_by(F.struct("declared", "packed", "prior"), F.coalesce("declared", F.lit(""))).alias("x")).select("origin", "rec_key", "x.*")
    schema = "origin string, rec_key string, declared string, runs array<struct<lang string, confidence double, first int, last int>>"
    return once.mapInArrow(_decode(config, [base[c] for c in LANGUAGES]), schema)


def mislabelled(identified: DataFrame) -> DataFrame:
    """One row for each run of a record whose label is missing or wrong, or that mixes languages."""
    n = F.size("runs")
    case = (n > 1) | ((n == 1) & (F.col("declared").isNull() | (F.col("declared") != F.col("runs")[0]["lang"])))
    return identified.where(case).select("origin", "rec_key", F.posexplode("runs").alias("run_no", "run")).select(
        "origin", "rec_key", F.col("run_no").cast("int").alias("run_no"), F.col("run.lang").alias("lang"), F.col("run.confidence").alias("confidence")
    )


def page_records(docs: DataFrame) -> DataFrame:
    """Web pages as records: the markup language is what is declared, the site is the host, and the address has a suffix."""
    none = F.lit(None).cast("string")
    return docs.select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("rec_key"), "text", F.col("lang").cast("string").alias("declared"), F.coalesce(F.col("source").cast("string"), none).alias("host"), address_suffix(F.col("url")).alias("suffix"))


def corpus_records(spark, sf: str) -> DataFrame:
    """The two tables with labels, as records; the document is the host of a segment, the pair that of an answer."""
    s = spark.read.parquet(f"{sf}/sampled_sources.parquet")
    f = spark.read.parquet(f"{sf}/final_dataset.parquet")
    none = F.lit(None).cast("string")
    a = s.select(F.lit("sampled_sources").alias("origin"), F.col("source_id").alias("rec_key"), F.col("source_text").alias("text"), F.col("source_lang_code").alias("declared"), F.col("madlad.doc_id").alias("host"), none.alias("suffix"))
    b = f.select(F.lit("final_dataset").alias("origin"), F.col("row_id").cast("string").alias("rec_key"), F.col("target_text").alias("text"), F.col("target_lang_code").alias("declared"), F.col("pair_id").alias("host"), none.alias("suffix"))
    return a.unionByName(b)
