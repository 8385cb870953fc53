"""Text functions as Catalyst expressions. Character classes are spelled out, as engines differ on \\w, \\s and \\b."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks, word characters, counted punctuation, line ends.
WS = "[\\t-\\r\\u001c-\\u001f \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
WORD = "[\\p{L}\\p{N}_]+"
PUNCT = "[.,!?;:。！？、，；：()\\[\\]{}\"'`-]"
LINE_END = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c-\\u001e\\u0085\\u2028\\u2029]"
SENTENCE_GAP = f"(?<=[.!?。！？]){WS}+"
# What a noisy line looks like.
URL_ONLY = "(?i)^(https?://[^\\s]+|www\\.[^\\s]+)$"
HTML_TAG = "<[^>]+>"
CODE_HINT = "[{};]{2,}|</?[\\p{L}\\p{N}_]+>|(?<![\\p{L}\\p{N}_])(class|def|function|import|return)(?![\\p{L}\\p{N}_])"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable, not a copied expression."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def normalize_text(text: Column) -> Column:
    """Each run of blanks one space, none at the edges."""
    return F.btrim(F.regexp_replace(text, f"{WS}+", " "), F.lit(" "))


def approx_token_length(text: Column) -> Column:
    """Words plus half the punctuation marks, the latter at least 1."""
    marks = F.regexp_count(text, F.lit(PUNCT))
    return F.regexp_count(text, F.lit(WORD)) + F.greatest(F.lit(1), F.floor(marks / 2).cast("int"))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)))


def jaccard_overlap(a: Column, b: Column) -> Column:
    """Shared words over all words of two texts; 0 if either has none."""
    def of(x: Column) -> Column:
        shared = F.size(F.array_intersect(x["a"], x["b"]))
        union = F.size(x["a"]) + F.size(x["b"]) - shared
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), F.lit(0.0)).otherwise(shared / F.greatest(union, F.lit(1)))

    return let(F.struct(word_set(a).alias("a"), word_set(b).alias("b")), of)


def json_string(text: Column) -> Column:
    """A JSON string literal that keeps all characters beyond ASCII."""
    escaped = text
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))

    def rare(t: Column) -> Column:
        out = t
        for c in range(32):
            if chr(c) not in "\n\r\t\b\f":
                out = F.replace(out, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
        return out

    # the other control characters are looked for before they are replaced: most keys have none
    whole = let(escaped, lambda t: F.when(t.rlike("[\\x00-\\x1f]"), rare(t)).otherwise(t))
    return F.concat(F.lit('"'), whole, F.lit('"'))


def stable_hash(key: Column) -> Column:
    """SHA-256 of the canonical JSON object {"key": ...}."""
    return F.sha2(F.concat(F.lit('{"key": '), json_string(key), F.lit("}")), 256)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key: the first 12 hexadecimal digits of its hash, modulo the number of shards."""
    return F.conv(F.substring(stable_hash(key), 1, 12), 16, 10).cast("long") % F.lit(shards)


def is_noise(text: Column) -> Column:
    """Blank, a bare address, a short piece of markup, or a short piece of code."""
    def of(s: Column) -> Column:
        n = F.length(s)
        short = (n < 300) & (((n < 200) & (F.regexp_count(s, F.lit(HTML_TAG)) >= 3)) | s.rlike(CODE_HINT))
        return (n == 0) | s.rlike(URL_ONLY) | short

    return let(strip(text), of)


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_END, -1)


def restore_newlines(text: Column) -> Column:
    """Literal backslash sequences for line ends become line ends."""
    return F.regexp_replace(text, "\\\\r\\\\n|\\\\n|\\\\r", "\n")


def escaped_newlines(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\\\r\\\\n|\\\\n|\\\\r"))


def truncate_for_log(text: Column, most: int) -> Column:
    cut = F.concat(F.substring(text, 1, most), F.lit(" ... [truncated "), (F.length(text) - most).cast("string"), F.lit(" chars]"))
    return F.when(F.length(text) > most, cut).otherwise(text)


def pick_text(value: Column, default: Column) -> Column:
    """The stripped value, or the default where that is null or blank."""
    return F.coalesce(F.nullif(strip(value.cast("string")), F.lit("")), default)


def safe_string(value: Column, kind: str = "string") -> Column:
    """Missing becomes empty, structures become JSON, the rest is cast."""
    nested = kind.startswith(("struct", "array", "map"))
    return F.coalesce(F.to_json(value) if nested else value.cast("string"), F.lit(""))


def first_text(*values: Column) -> Column:
    """The first value that is not blank (the text of a response in any of its layouts)."""
    return F.coalesce(*[F.when(strip(v) != "", v) for v in values])


# Where a response keeps its text, and the keys of a part that hold text.
RESPONSE_PATHS = ["$.choices[0].message.content", "$.choices[0].message.output_text", "$.choices[0].message.text", "$.choices[0].text", "$.choices[0].output_text"]
PART_KEYS = ["text", "output_text", "content", "reasoning_content", "value"]


def content_text(part: Column, depth: int = 2) -> Column:
    """Text of a part (a variant): a string or number itself, the parts of a list joined, the first known key of an object."""

    def of(v: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        plain = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
        nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
        if depth == 0:
            return F.when(nested | (kind == "VOID"), F.lit("")).otherwise(plain)
        listed = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(content_text(x, depth - 1), F.lit(""))), "")
        # one branch for whatever key there is, so that the expression does not grow with their number
        keyed = content_text(F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in PART_KEYS]), depth - 1)
        return F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), F.coalesce(keyed, F.lit(""))).when(kind == "VOID", F.lit("")).otherwise(plain)

    return let(part, of)


def response_text(raw: Column, depth: int = 2) -> Column:
    """Text of a generator's JSON response in any of its layouts, nested up to ``depth``; empty if it has none or is no JSON."""
    found = F.try_parse_json(raw)
    texts = [strip(content_text(F.try_variant_get(found, path, "variant"), depth)) for path in RESPONSE_PATHS]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def scorer_input(source: Column, candidate: Column, reference: Column | None = None) -> Column:
    head = F.concat(F.lit("source: "), source, F.lit(" candidate: "), candidate)
    return head if reference is None else F.concat(head, F.when(reference.isNull(), "").otherwise(F.concat(F.lit(" reference: "), reference)))


def heuristic_score(source: Column, candidate: Column) -> Column:
    """Reference-free score from 0 (best) to 25: deviation of length plus copying; a blank candidate gets 25."""
    ratio = F.length(candidate) / F.greatest(F.lit(1), F.length(source))
    raw = F.lit(5.0) + F.abs(F.lit(1.0) - ratio) * 5.0 + jaccard_overlap(source, candidate) * 10.0
    return F.when(F.coalesce(strip(candidate), F.lit("")) == "", F.lit(25.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(25.0), raw)))
