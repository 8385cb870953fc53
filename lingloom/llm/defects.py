"""Defective answers: empty, truncated, refused, copied, or in another language.

For every defect several noisy labelling functions vote on each pair (1 for, 0
against, -1 abstains), each from evidence of its own: marks, lengths, words,
scripts, phrases, the source. A label model, fitted by expectation maximization
on the counts of vote patterns, turns votes into posteriors without labelled
data: the accuracy of each function and the share of the defect are latent. All
labels whose posterior exceeds the defect's cutoff are kept; cutoffs are
validated on labelled pairs, made by planting known defects in every pair. Words,
models and cutoffs come from all pairs.

Texts are shuffled once, to count replays once, then read twice: for how often
words end sentences, and for the votes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingloom.llm import language as L
from lingloom.llm import sentences as S
from lingloom.llm.tally import tally
from lingloom.session import materialize

DEFECTS = ["empty", "copy", "refusal", "wrong_language", "truncated"]
FUNCTIONS = {"empty": 4, "copy": 3, "refusal": 4, "wrong_language": 4, "truncated": 5}


@dataclass(frozen=True)
class DefectConfig:
    """strength: pairs that the prior belief in the functions counts as. iterations: of the EM. least_cutoff: lowest
    posterior that may label. shingle: code points of the substrings that measure copying. word_bits: size of the
    table that counts words and how often they end sentences, as a power of two; it does not grow with the data.
    at_once: texts whose languages are told together (bounds memory)."""

    strength: float = 200.0
    iterations: int = 200
    least_cutoff: float = 0.5
    shingle: int = 5
    word_bits: int = 20
    at_once: int = 4096


# How answers decline, by language. A quotation of such words is no refusal.
REFUSALS = [
    r"\bi['’]?m (?:very |so |really )?sorry\b|\bi am (?:very |so )?sorry\b|\bmy apologies\b|\bapologi[sz]e\b|\bapologies for\b|\bas an ai\b|\blanguage model\b|\bai assistant\b",
    r"\bi (?:can['’]?t|cannot|can not|won['’]?t|must decline|decline|refuse|have to (?:pass|decline|refuse)|am not (?:able|allowed|permitted|in a position)|am unable|['’]?m (?:unable|not able))",
    r"\bi['’]m (?:unable|not able|not allowed)|\bi don['’]?t feel comfortable|\b(?:content|usage) polic|\bmy guidelines\b|\bcannot be (?:completed|translated|processed|provided|answered|fulfilled)|\bno translation (?:can|will)",
    r"\bnot possible for me\b|\bfalls outside what i\b|\bi understand the request\b|\bprovide a different\b|\bsend something else\b|\bunable to (?:assist|help|translate|answer|comply)|\bcannot (?:assist|help|comply)",
    r"tut mir (?:sehr )?leid|\bleider\b.{0,60}\b(?:nicht|kein)|\bkann ich (?:\w+ ){0,4}(?:nicht|keine)|\bich kann (?:\w+ ){0,6}nicht|als (?:ki|künstliche)\b|\bsprachmodell|\bmeine(?:n|r)? richtlinien|\bkeine übersetzung|\bnicht (?:übersetzen|beantworten|bearbeiten|helfen)\b|\büberschreitet, was ich|\bdiese anfrage\b",
    r"\bdésolée?\b|\bje (?:ne peux|ne suis pas|regrette|dois refuser|refuse)|\bmalheureusement\b|\ben tant qu['’](?:ia|assistant|intelligence)|\baucune traduction|\bcette demande\b|\bil (?:ne )?m['’]est (?:pas possible|impossible)|\bmes (?:consignes|directives)\b|\bje vous prie de m['’]excuser",
    r"\blo siento\b|\blo lamento\b|\b(?:no puedo|no me es posible|no estoy autorizad|no podré|debo rechazar)|\blamentablemente\b|\bcomo (?:ia|asistente|modelo)\b|\bninguna traducción|\besta (?:solicitud|petición)\b|\bmis (?:directrices|normas)\b|\bdisculp(?:e|a|as)\b",
    r"\bdesculp[ea]\b|\blamento\b|\blamentavelmente\b|\binfelizmente\b|\b(?:não posso|não consigo|não me é possível|não estou autorizad|devo recusar)|\bcomo (?:ia|assistente|modelo)\b|\bnenhuma tradução|\beste pedido\b|\bminhas diretrizes\b",
    r"извинит|к сожалению|\bя не (?:могу|смогу|в состоянии)|не могу (?:помочь|перевести|выполнить)|как (?:ии|искусственный)|невозможно выполнить|этот запрос|мои(?:м|х)? правил",
    r"죄송|인공지능 (?:도우미|모델)|언어 모델|정책상|번역(?:을|은)? ?(?:해 ?드릴|제공해|할) 수 없|번역을 제공|(?:답변|답|도움|처리|제공)(?:을|를)? ?(?:해 ?)?(?:드릴|할|하기) (?:수 없|어렵)|답할 수 없|처리할 수 (?:있는 범위를 벗어|없)|이 요청|다른 글을 보내|문의해 주셔서|안타깝게도",
    r"申し訳|すみませんが|お手伝いできません|お答えできません|翻訳(?:は)?できません|訳文を提供できません|処理することは|許可されていません|aiアシスタント|人工知能|言語モデル|お問い合わせありがとう|ご依頼|ご要望|対応できません|いたしかねます|できかねます|残念ながら|ガイドライン|別の文章",
    r"抱歉|对不起|對不起|我(?:无法|不能|不便)|无法(?:翻译|提供|处理|回答|协助|完成)|作为.{0,4}(?:人工智能|ai|助手)|人工智能|语言模型|此请求|该请求|准则|很遗憾",
    r"ขออภัย|ขอโทษ|เสียใจด้วย|ไม่สามารถ(?:แปล|ช่วย|ตอบ|ให้|ดำเนิน)|ปัญญาประดิษฐ์|คำขอนี้|แบบจำลองภาษา|นโยบาย",
]
# For each pattern above, strings one of which every match holds; most texts hold none.
TRIGGERS = [
    ["sorry", "apolog", "as an ai", "language model", "ai assistant"],
    ["can't", "can’t", "cannot", "can not", "won't", "won’t", "decline", "refuse", "have to", "not able", "not allowed", "not permitted", "not in a position", "unable"],
    ["i'm", "i’m", "don't feel", "don’t feel", "polic", "guidelines", "cannot be", "no translation"],
    ["for me", "outside what", "the request", "provide a different", "something else", "unable", "cannot"],
    ["leid", "leider", "kann", "als k", "sprachmodell", "richtlinien", "übersetz", "nicht", "überschreitet", "anfrage"],
    ["désol", "je ", "malheureusement", "en tant", "aucune", "demande", "m'est", "m’est", "consignes", "directives", "m'excuser", "m’excuser"],
    ["siento", "lamento", "no p", "no me", "no est", "debo", "lamentablemente", "como ", "ninguna", "esta s", "esta p", "directrices", "normas", "disculp"],
    ["desculp", "lament", "infelizmente", "não ", "devo", "como ", "nenhuma", "este pedido", "diretrizes"],
    ["извин", "сожал", "не ", "как ", "невозможно", "запрос", "мои"],
    ["죄송", "인공지능", "언어 모델", "정책", "번역", "답", "도움", "처리", "제공", "요청", "다른 글", "문의", "안타깝"],
    ["申し訳", "すみません", "できません", "提供", "処理", "許可", "ai", "人工知能", "言語モデル", "問い合わせ", "依頼", "要望", "いたしかね", "できかね", "残念", "ガイドライン", "別の"],
    ["抱歉", "对不起", "對不起", "我", "无法", "作为", "人工智能", "语言模型", "请求", "准则", "遗憾"],
    ["ขออภัย", "ขอโทษ", "เสียใจ", "ไม่สามารถ", "ปัญญา", "คำขอ", "แบบจำลอง", "นโยบาย"],
]
# The scripts of which a text has to hold one for a pattern above to match; none for Latin ones.
CUE_SCRIPTS = [*[()] * 8, ("cyrillic",), ("hangul",), ("kana", "han"), ("han",), ("thai",)]
CUES = [(t, re.compile(p), s) for t, p, s in zip(TRIGGERS, REFUSALS, CUE_SCRIPTS, strict=True)]
RUNS = re.compile("|".join(f"(?P<{name}>[{chr(low)}-{chr(high)}]+)" for name, low, high, _ in L.SCRIPTS) + "|(?P<latin>[A-Za-z\u00c0-\u024f]+)")


def scripts_of(text: str) -> dict[str, int]:
    """Letters of a text by script."""
    if text.isascii():
        return {"latin": 1} if any(map(str.isalpha, text)) else {}
    counts: dict[str, int] = {}
    for m in RUNS.finditer(text):
        counts[m.lastgroup] = counts.get(m.lastgroup, 0) + m.end() - m.start()
    return counts


def declines(text: str, scripts: dict[str, int] | None = None) -> bool:
    """Whether a text, quotations aside, says that it will not do what was asked. ``scripts`` are those it may hold."""
    low = text.lower()
    there = scripts_of(text) if scripts is None else scripts
    latin = "latin" in there
    return any((any(x in there for x in own) if own else latin) and any(t in low for t in triggers) and pattern.search(low) for triggers, pattern, own in CUES)


# Words about the task itself.
META = ["translat", "übersetz", "traduc", "traduz", "traduç", "번역", "翻訳", "訳文", "翻译", "перевод", "перевед", "แปล", "request", "anfrage", "demande", "solicitud", "pedido", "요청", "답변", "依頼", "请求", "запрос", "คำขอ"]
QUOTED = re.compile("[“„«「『‹\"][^”“»」』›\"\\n]*[”“»」』›\"]")
ANCHOR = re.compile(r"(?:https?://|www\.)[!-~]+|[A-Z0-9]{2,}(?:-[A-Z0-9]+)+|v\d+(?:\.\d+)+|\d+(?:[.,]\d+)?")
SOLID = re.compile(r"[^\W_]+")
LAST = re.compile(r"((?:[^\W_]|[\u0300-\u036f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e])+)[\W_]*$")
# Marks that come in pairs; one left open at the end is a sign that the rest is missing.
PAIRED = [("“", "”"), ("«", "»"), ("「", "」"), ("(", ")"), ("（", "）")]
END_MARK = re.compile(r"[.!?。！？…]+[\s\"'”’»“」』)）\]]*$")
DOTS = re.compile(r"(?:…+|\.\.+)[\s\"'”’»“」』)）\]]*$")


WORD = re.compile(r"([^\W_]+)([\"'”’»“」)）]*[.!?。！？])?")
DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\u0e01-\u0e5b]")
THAI = re.compile(r"[\u0e01-\u0e5b]")
UNIT = re.compile(r"[.!?。！？…]+(?=[\s\"'”’»“」』)）]|$)|[。！？]|\n+")
EDGES = re.compile(r"^[\s\W_]+|[\s\W_]+$")
# Scripts that a language is written in, where they tell it from others.
SCRIPT_OF = {"ko": {"hangul"}, "ja": {"kana", "han"}, "zh": {"han"}, "th": {"thai"}, "ru": {"cyrillic"}, "uk": {"cyrillic"}, "bg": {"cyrillic"}, "ar": {"arabic"}, "he": {"hebrew"}, "el": {"greek"}, "hi": {"devanagari"}, "ka": {"georgian"}, "lo": {"lao"}}
GRAMMAR: dict[str, list[str]] = {}  # languages by function word
for _code, _listed in L.FUNCTION_WORDS.items():
    for _word in _listed.split():
        GRAMMAR.setdefault(_word, []).append(_code)


def _slot(word: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(word) >> (64 - bits)


def end_key(last_word: str) -> str:
    """What stands for the end of a text in the table of words: its last word, or its last two letters where there are no words."""
    return "~" + last_word[-2:] if DENSE.match(last_word[-1:]) else last_word


def word_ends(texts: DataFrame, config: DefectConfig) -> np.ndarray:
    """Two rows of counters over all texts: how often a word occurs, and how often it is the last before a mark that ends a sentence.

    Dense scripts have no words: there two letters stand for the word, and all
    pairs of letters are counted.
    """
    size = 1 << config.word_bits
    within = {w.lower() for w in S.ABBREVIATIONS_WITHIN}

    def add(table, batch):
        memo: dict[str, int] = {}

        def slot(word: str) -> int:
            found = memo.get(word)
            if found is None:
                if len(memo) > 200_000:
                    memo.clear()
                found = memo[word] = _slot(word, config.word_bits)
            return found

        for text in chain.from_iterable(c.to_pylist() for c in batch.columns):
            if not text:
                continue
            low = text.lower()
            seen, ended = [], []
            for word, mark in WORD.findall(low):
                if DENSE.search(word):
                    seen += [slot("~" + word[i : i + 2]) for i in range(len(word) - 1)]
                    if mark:
                        ended.append(slot("~" + word[-2:]))
                else:
                    k = slot(word)
                    seen.append(k)
                    # a mark after an abbreviation ends nothing
                    if mark and len(word) > 1 and word not in within:
                        ended.append(k)
            np.add.at(table, seen, 1)
            np.add.at(table, np.array(ended, dtype=np.int64) + size, 1)

    return tally(texts, 2 * size, add).reshape(2, size)


def inside_share(source: str, target: str, k: int) -> float:
    """Share of the target's substrings of k letters that the source has."""
    if not target or not source:
        return 0.0
    n = max(1, len(target) - k + 1)
    probe = range(0, n, max(1, n // 16))
    # most answers share next to nothing: a few substrings show that
    if sum(target[i : i + k] in source for i in probe) < 0.3 * len(probe):
        return 0.0
    grams = {target[i : i + k] for i in range(n)}
    return len(grams & {source[i : i + k] for i in range(max(1, len(source) - k + 1))}) / len(grams)


@dataclass(frozen=True)
class Known:
    """What the votes need besides the pair: word ends, and the usual ratio of lengths by pair of languages."""

    ends: np.ndarray
    ratios: dict[str, float]


class SourceFacts(NamedTuple):
    """What the votes on a pair need of its source; the same for each answer."""

    solid: str
    length: int
    anchors: frozenset[str]
    meta: bool
    dots: bool
    units: int


@lru_cache(maxsize=64)
def source_facts(source: str) -> SourceFacts:
    return SourceFacts("".join(SOLID.findall(source.lower())), len(source.strip()), frozenset(ANCHOR.findall(source)), any(m in source.lower() for m in META), bool(DOTS.search(source.rstrip())), len(UNIT.findall(source.strip())))


@lru_cache(maxsize=64)
def asks(source: str) -> bool:
    return declines(QUOTED.sub(" ", source))


class TargetFacts(NamedTuple):
    """What the votes on a pair need of its answer; the same for each source."""

    solid: str
    placeholder: bool
    length: int
    cue: bool
    anchors: frozenset[str]
    meta: bool
    script: str
    spoken: dict[str, int]  # function words by language
    dots: bool
    ended: bool
    closed: bool
    cut: bool
    word: str
    thai: bool
    units: int


@lru_cache(maxsize=64)
def target_facts(target: str) -> TargetFacts:
    solid = "".join(SOLID.findall(target.lower()))
    bare = QUOTED.sub(" ", target)
    scripts = scripts_of(target)
    low = bare.lower()
    script = max(scripts, key=lambda x: scripts[x]) if scripts else ""
    spoken_by: dict[str, int] = {}
    if script in ("latin", "cyrillic"):
        for w in SOLID.findall(low):
            for code in GRAMMAR.get(w, ()):
                spoken_by[code] = spoken_by.get(code, 0) + 1
    tail = target.rstrip()
    dots = bool(DOTS.search(tail))
    last = LAST.search(tail)
    word = last.group(1) if last else ""
    return TargetFacts(
        solid=solid,
        placeholder=EDGES.sub("", target.lower()) in L.PLACEHOLDERS,
        length=len(target.strip()),
        cue=bool(solid) and declines(bare, scripts),
        anchors=frozenset(ANCHOR.findall(target)),
        meta=any(m in low for m in META),
        script=script,
        spoken=spoken_by,
        dots=dots,
        ended=bool(END_MARK.search(tail)) and not dots,
        closed=tail[-1:] in ("”", "»", "“", "」", "』", ")", "）", '"') and bool(tail),
        cut=bool(tail) and (tail[-1:] in "-,–—‐" or any(target.count(a) > target.count(b) for a, b in PAIRED if a != "“" or "„" not in target)),
        word=word,
        thai=bool(word) and bool(THAI.match(word[-1:])),  # Thai writes no marks
        units=len(UNIT.findall(target.strip())),
    )


def pair_votes(source: str | None, target: str | None, pair: str | None, want: str | None, langs: list[str], known: Known, config: DefectConfig) -> dict[str, list[int]]:
    """All votes on one pair. ``langs`` are the languages found in the answer, ``want`` the one asked for."""
    source, target = source or "", target or ""
    x, y = source_facts(source), target_facts(target)
    s, t = x.solid, y.solid
    ratio = known.ratios.get(pair or "", 1.0)
    rel = y.length / (x.length * ratio) if x.length and ratio else None
    blank = not t or y.placeholder
    empty = [int(not t), int(y.placeholder), -1 if rel is None else int(rel < 0.1), int(not langs)]

    whole = bool(t) and (t == s or (s.startswith(t) and len(t) >= 8))
    inside = 1.0 if whole else inside_share(s, t, config.shingle)
    absent = bool(langs) and want is not None and want not in langs
    copied = 1 if inside >= 0.9 else (0 if inside < 0.6 else -1)
    copy = [int(whole), copied, -1 if not langs or want is None else int(absent or len(langs) > 1)]

    cue, meta = y.cue, y.meta
    asked = cue and asks(source)
    kept = bool(x.anchors & y.anchors)
    odd = rel is not None and (rel < 0.75 or rel > 1.35)
    refusal = [
        (-1 if asked else 1) if cue else 0,
        -1 if not x.anchors or blank else int(not kept),
        -1 if blank or (meta and x.meta) else int(meta),
        -1 if rel is None or blank else int(odd or absent),
    ]

    script = y.script
    if not script or want is None:
        by_script = -1
    elif want in SCRIPT_OF:
        # Chinese characters alone are Japanese as well as Chinese
        by_script = 1 if script not in SCRIPT_OF[want] else (-1 if script == "han" and want == "ja" else 0)
    else:
        by_script = 1 if script != "latin" else -1
    by_grammar = -1
    if want in L.FUNCTION_WORDS and L.FUNCTION_WORDS[want] and script in ("latin", "cyrillic"):
        own = y.spoken.get(want, 0)
        most = max((n for code, n in y.spoken.items() if code != want), default=0)
        by_grammar = 1 if most >= 2 and own * 3 <= most else (0 if own and own >= most else -1)
    elsewise = int(not (whole or copied == 1 or cue))  # a copy or a refusal is its own defect
    wrong = [int(absent) if langs and want is not None else -1, by_script, by_grammar, elsewise]

    word, thai = y.word, y.thai
    # votes about the last sentence are cast only where no mark closes it, so that they are weighed among such answers
    if y.ended or blank:
        truncated = [0, -1, -1, -1, -1]
    else:
        by_word = -1
        if not thai and not y.closed:
            k = _slot(end_key(word.lower()), config.word_bits) if word else 0
            total, ends = (int(known.ends[0, k]), int(known.ends[1, k])) if word else (0, 0)
            if total <= 2:
                by_word = -1 if word[:1].isupper() else 1
            elif ends < 0.03 * total:
                by_word = 1
            elif ends > 0.08 * total:
                by_word = 0
        short = -1 if rel is None else (1 if rel < 0.8 else (0 if rel >= 0.93 else -1))
        fewer = y.units + 1 < x.units
        truncated = [-1 if thai or (y.dots and x.dots) else 1, by_word, short, int(y.cut), 1 if fewer else -1]
    return {"empty": empty, "copy": copy, "refusal": refusal, "wrong_language": wrong, "truncated": truncated}


@dataclass
class LabelModel:
    share: float
    says: np.ndarray  # P(vote = 1 | defect), by function
    slips: np.ndarray  # P(vote = 1 | none)
    cutoff: float = 0.5

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        cast = votes >= 0
        yes = np.where(votes == 1, np.log(self.says), np.log(1 - self.says))
        no = np.where(votes == 1, np.log(self.slips), np.log(1 - self.slips))
        z = np.log(self.share) - np.log(1 - self.share) + np.where(cast, yes - no, 0.0).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, config: DefectConfig = DefectConfig()) -> LabelModel:
    """Expectation maximization on vote patterns and their counts, with a prior belief that functions are mostly right."""
    m = votes.shape[1]
    model = LabelModel(0.03, np.full(m, 0.85), np.full(m, 0.05))
    a = config.strength
    for _ in range(config.iterations):
        p = model.posterior(votes) * counts
        q = counts - p
        cast, one = votes >= 0, votes == 1
        model.share = float(np.clip((p.sum() + 0.03 * a) / (counts.sum() + a), 1e-4, 0.5))
        model.says = np.clip(((p[:, None] * one).sum(axis=0) + 0.85 * a) / ((p[:, None] * cast).sum(axis=0) + a), 0.02, 0.995)
        model.slips = np.clip(((q[:, None] * one).sum(axis=0) + 0.05 * a) / ((q[:, None] * cast).sum(axis=0) + a), 0.0005, 0.9)
    return model


def choose_cutoff(model: LabelModel, votes: np.ndarray, counts: np.ndarray, least: float) -> float:
    """The cutoff of highest expected F1 on held-out patterns."""
    p = model.posterior(votes)
    expected = (p * counts).sum()
    best, chosen = -1.0, least
    for c in sorted({least, *[x for x in p.round(6) if x >= least]}):
        kept = p >= c
        hits, n = (p * counts)[kept].sum(), counts[kept].sum()
        f1 = 2 * hits / (expected + n) if expected + n else 0.0
        if f1 > best + 1e-9:
            best, chosen = f1, float(c)
    return chosen


LANGUAGE_BASE = np.full(len(L.LANGUAGES), -math.log(len(L.LANGUAGES)))


def spoken(scorer: L.WordScorer, texts: list[str | None]) -> list[list[str]]:
    """Languages of the runs of each text, by its words alone."""
    none = [None] * len(texts)
    runs = L.decode_batch(scorer.score([t or "" for t in texts]), none, none, LANGUAGE_BASE, L.LanguageConfig()).to_pylist()
    return [[r["lang"] for r in found] for found in runs]


@dataclass(frozen=True)
class Votes:
    wide: DataFrame  # row_id, a column of votes for each defect
    cases: DataFrame  # defect, votes, positive, n: how often planted pairs get these votes, and whether this defect was planted

    @property
    def rows(self) -> DataFrame:  # row_id, defect, votes
        return self.wide.select("row_id", F.explode(_stacked()).alias("v")).select("row_id", "v.defect", "v.votes")


def _stacked():
    return F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in DEFECTS])


def votes_of_pairs(final: DataFrame, words: dict[str, list[float]] | None = None, config: DefectConfig = DefectConfig()) -> Votes:
    """Votes on every pair and defect. ``final`` has row_id, pair_id, source_text, target_text; ``words`` are those of ``language.fit_words``.

    Replayed rows count once; a null answer is empty, a null source an empty
    text; a pair that names no target language gets no vote on it. An empty table
    gives no votes.
    """
    spark = final.sparkSession
    once = final.groupBy("row_id").agg(F.max(F.struct("pair_id", "source_text", "target_text")).alias("x")).select("row_id", F.col("x.pair_id").alias("pair"), F.col("x.source_text").alias("source"), F.col("x.target_text").alias("target"))
    pairs = materialize(once.withColumn("want", want_of("pair")))
    if words is None:
        words = L.fit_words(language_records(pairs), L.LanguageConfig(fit_rows=None))
    # at most one number a pair of language codes
    lengths = pairs.where(F.length(F.trim("source")) > 0).where(F.length(F.trim("target")) > 0).groupBy("pair").agg(F.percentile_approx(F.length(F.trim("target")) / F.length(F.trim("source")), 0.5, 1000).alias("ratio")).collect()
    known = Known(word_ends(pairs.select("source", "target"), config), {r["pair"] or "": float(r["ratio"]) for r in lengths})
    shipped = spark.sparkContext.broadcast((words, known))

    def run(batches):
        table, facts = shipped.value
        scorer = L.WordScorer(table)
        for whole in batches:
            for at in range(0, whole.num_rows, config.at_once):
                b = whole.slice(at, config.at_once)
                row_id, pair, want, source, target = (b.column(k).to_pylist() for k in range(5))
                made = planted_in(list(zip(pair, want, source, target)))
                langs = {t or "": found for t, found in zip(target, spoken(scorer, target))}
                new = list({c[5]: None for c in made if c[5] not in langs})
                for k in range(0, len(new), config.at_once):
                    langs.update(zip(new[k : k + config.at_once], spoken(scorer, new[k : k + config.at_once])))
                found, counts, k = [], Counter(), 0
                for r in range(b.num_rows):
                    found.append(pair_votes(source[r], target[r], pair[r], want[r], langs[target[r] or ""], facts, config))
                    while k < len(made) and made[k][0] == r:
                        _, defect, p, w, x, y = made[k]
                        k += 1
                        for d, v in pair_votes(x, y, p, w, langs[y], facts, config).items():
                            counts[d, tuple(v), d == defect] += 1
                cases = [[{"defect": d, "votes": list(v), "positive": own, "n": n} for (d, v, own), n in counts.items()], *[None] * (b.num_rows - 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([f[d] for f in found], type=pa.list_(pa.int32())) for d in DEFECTS], pa.array(cases, type=case)], names=["row_id", *DEFECTS, "cases"])

    case = pa.list_(pa.struct([("defect", pa.string()), ("votes", pa.list_(pa.int32())), ("positive", pa.bool_()), ("n", pa.int64())]))
    shape = "row_id long, " + ", ".join(f"{d} array<int>" for d in DEFECTS) + ", cases array<struct<defect: string, votes: array<int>, positive: boolean, n: long>>"
    voted = materialize(pairs.select("row_id", "pair", "want", "source", "target").mapInArrow(run, shape))
    # at most 2 * 3^m patterns a defect, however many pairs there are
    cases = voted.select(F.explode("cases").alias("c")).groupBy("c.defect", "c.votes", "c.positive").agg(F.sum("c.n").alias("n"))
    return Votes(voted.select("row_id", *DEFECTS), cases)


def language_records(pairs: DataFrame) -> DataFrame:
    """Both sides of pairs as records with the language that the pair names, to learn words from."""
    part = lambda k: F.get(F.split(F.coalesce("pair", F.lit("")), "->"), F.lit(k))
    side = lambda origin, text, k: pairs.select(F.lit(origin).alias("origin"), F.col("row_id").cast("string").alias("rec_key"), F.col(text).alias("text"), part(k).alias("declared"))
    return side("target", "target", 1).unionByName(side("source", "source", 0))


def planted(sample: list[tuple]) -> list[tuple]:
    """(defect, pair, want, source, target): defects put into pairs by what they are.

    An empty answer, the source again, an answer cut inside its last sentence, an
    answer of a pair that asks for another language, one of the pairs before it
    (for the first ones, of the last). Refusals are not made up.
    """
    return [case[1:] for case in planted_in(sample)]


def planted_in(sample: list[tuple]) -> list[tuple]:
    """The same with the place of the pair in ``sample`` in front."""
    out = []
    others: dict[str, str] = {}
    remember = lambda want, target: {want: target, **{c: x for c, x in list(others.items())[:3] if c != want}}
    for _, want, source, target in sample[-100:]:
        if source and target and want is not None:
            others = remember(want, target)
    for at, (pair, want, source, target) in enumerate(sample):
        if not source or not target or want is None:
            continue
        out.append((at, "copy", pair, want, source, source))
        out.append((at, "empty", pair, want, source, ["", "...", "N/A", " - "][len(out) % 4]))
        ends = [m.end() for m in UNIT.finditer(target.strip())]
        last = ends[-2] if len(ends) > 1 else 0
        room = len(target.strip()) - last
        if room >= 24:
            out.append((at, "truncated", pair, want, source, target.strip()[: last + room // 2].rstrip(" .!?。！？")))
        for code, text in others.items():
            if code != want:
                out.append((at, "wrong_language", pair, want, source, text))
                break
        others = remember(want, target)
    return out


def want_of(pair: str):
    """The language asked for: the last part of ``source->target``."""
    return L.normal_code(F.element_at(F.split(F.coalesce(F.col(pair), F.lit("")), "->"), -1))


def validated_cutoffs(models: dict[str, LabelModel], votes: Votes, config: DefectConfig) -> dict[str, float]:
    """For each defect the cutoff of best F1 on labelled pairs: those with the defect planted against clean ones and other defects.

    Defects are planted in every pair. Clean are pairs for which no model says
    more than one half. A defect that cannot be planted (refusal) keeps the
    cutoff of its model.
    """
    cases = votes.cases.collect()
    if not cases:
        return {}
    written = lambda pattern: F.concat_ws(",", F.transform(pattern, lambda v: v.cast("string")))
    wide = votes.wide
    for d, m in models.items():
        patterns = [r["votes"] for r in wide.select(F.col(d).alias("votes")).distinct().collect()]
        guilty = [",".join(map(str, v)) for v, p in zip(patterns, m.posterior(np.array(patterns))) if p >= 0.5]
        if guilty:
            wide = wide.where(~written(F.col(d)).isin(guilty))
    clean = wide.select(F.explode(_stacked()).alias("v")).groupBy("v.defect", "v.votes").agg(F.count("*").alias("n")).collect()
    out = {}
    for d, m in models.items():
        own = [(r["votes"], r["n"], r["positive"]) for r in cases if r["defect"] == d] + [(r["votes"], r["n"], False) for r in clean if r["defect"] == d]
        p = m.posterior(np.array([v for v, _, _ in own]))
        n = np.array([k for _, k, _ in own])
        positive = np.array([x for _, _, x in own])
        if not positive.any():
            continue
        best = -1.0
        for c in sorted({config.least_cutoff, *[x for x in p.round(6) if x >= config.least_cutoff]}):
            kept = p >= c
            f1 = 2 * n[kept & positive].sum() / max(1, n[positive].sum() + n[kept].sum())
            if f1 > best + 1e-9:
                best, out[d] = f1, float(c)
    return out


def label(votes: Votes, config: DefectConfig = DefectConfig()) -> DataFrame:
    """(row_id, defect, posterior) of all labels over their cutoffs."""
    rows = votes.rows
    half = F.pmod(F.xxhash64("row_id"), F.lit(2)).cast("int")
    # at most 3^m patterns a defect, however many pairs there are
    patterns = rows.groupBy("defect", "votes", half.alias("half")).count().collect()
    models: dict[str, LabelModel] = {}
    seen: dict[str, np.ndarray] = {}
    for d in DEFECTS:
        own = [r for r in patterns if r["defect"] == d]
        if not own:
            continue
        v = np.array([r["votes"] for r in own])
        n = np.array([r["count"] for r in own], dtype=float)
        held = np.array([r["half"] for r in own]) == 1
        models[d], seen[d] = fit_label_model(v, n, config), v
        if held.any() and (~held).any():
            models[d].cutoff = choose_cutoff(fit_label_model(v[~held], n[~held], config), v[held], n[held], config.least_cutoff)
        else:
            models[d].cutoff = config.least_cutoff
    cutoffs = validated_cutoffs(models, votes, config)
    table = [
        (d, list(pattern), p) for d, m in models.items()
        for pattern, p in {tuple(x): float(y) for x, y in zip(seen[d].tolist(), m.posterior(seen[d]))}.items() if p >= cutoffs.get(d, m.cutoff)
    ]
    known = rows.sparkSession.createDataFrame(table, "defect string, votes array<int>, posterior double")
    return rows.join(F.broadcast(known), ["defect", "votes"]).select("row_id", "defect", "posterior")


def one_defect(labels: DataFrame) -> DataFrame:
    """(row_id, defect): the label of highest posterior; of equal ones the first in the order of DEFECTS.

    By its definition ``wrong_language`` is no copy and no refusal, so where one
    of these labels is kept it gives way.
    """
    order = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    rank = F.struct((F.col("defect") == "wrong_language").cast("int"), -F.round("posterior", 6), order, "defect")
    plain = F.struct(F.lit(0), -F.round("posterior", 6), order, "defect")
    by = labels.groupBy("row_id").agg(F.min(rank).alias("first"), F.min(plain).alias("best"), F.max(F.col("defect").isin("copy", "refusal")).alias("other"))
    return by.select("row_id", F.when(F.col("other"), F.col("first.defect")).otherwise(F.col("best.defect")).alias("defect"))
