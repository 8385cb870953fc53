"""SQL of the core queries for an independent engine, built from shared fragments."""

from __future__ import annotations

from lingloom.functions.lang import ALIASES, NAMES
from lingloom.operators.filters import BLOCKED
from lingloom.operators.sample import BOUNDARIES
from lingloom.operators.sft import EOS, JUDGE_SYSTEM, JUDGE_USER, TOKEN, TRANSLATE_SYSTEM, TRANSLATE_USER

WS = "[\\t-\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
WORD = "[\\p{L}\\p{N}_]+"
PUNCT = "[.,!?;:。！？、，；：()\\[\\]{}\"''`-]"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'), ' ')"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def approx(t: str) -> str:
    return f"({count(t, WORD)} + greatest(1, {count(t, PUNCT)} // 2))"


def words(t: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({t}), '{WORD}'))"


def jaccard(a: str, b: str) -> str:
    return (
        f"(CASE WHEN len({words(a)}) = 0 OR len({words(b)}) = 0 THEN 0.0 ELSE len(list_intersect({words(a)}, {words(b)}))::DOUBLE"
        f" / len(list_distinct(list_concat({words(a)}, {words(b)}))) END)"
    )


def score(s: str, h: str) -> str:
    return (
        f"(CASE WHEN {strip(h)} = '' THEN 25.0 ELSE greatest(0.0, least(25.0, 5.0 + abs(1.0 - length({h})::DOUBLE / greatest(1, length({s}))) * 5.0 + {jaccard(s, h)} * 10.0)) END)"
    )


def noise(t: str) -> str:
    s = strip(t)
    return (
        f"({s} = '' OR regexp_matches({s}, '(?i)^(https?://[^\\s]+|www\\.[^\\s]+)$') OR ({count(s, '<[^>]+>')} >= 3 AND length({s}) < 200)"
        f" OR (regexp_matches({s}, '[{{}};]{{2,}}|</?[\\p{{L}}\\p{{N}}_]+>|(^|[^\\p{{L}}\\p{{N}}_])(class|def|function|import|return)($|[^\\p{{L}}\\p{{N}}_])') AND length({s}) < 300))"
    )


def bucket(n: str, bounds: list[int] = BOUNDARIES) -> str:
    cases = " ".join(f"WHEN {n} >= {a} AND {n} < {b} THEN {k}" for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    return f"(CASE {cases} ELSE {len(bounds) - 2} END)"


def lines(min_chars: int = 20, max_chars: int = 5000) -> str:
    """CTEs raw_lines(doc, pos, line) and merged(doc, pos, line)."""
    one = f"list_filter(list_transform(string_split_regex(text, '{LINE_END}'), lambda x: {norm('x')}), lambda x: x <> '')"
    cut = f"list_filter(list_transform(string_split(regexp_replace(x, '([.!?。！？]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda y: {norm('y')}), lambda y: y <> '')"
    return f"""
raw_lists AS (SELECT doc_id AS doc, flatten(list_transform({one}, lambda x: CASE WHEN length(x) > {max_chars} THEN {cut} ELSE [x] END)) AS ls FROM documents WHERE text IS NOT NULL),
raw_lines AS (SELECT doc, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM raw_lists),
long_at AS (SELECT *, CASE WHEN length(line) >= {min_chars} THEN pos END AS lp FROM raw_lines),
grouped AS (SELECT doc, pos, line, coalesce(min(lp) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(lp) OVER (PARTITION BY doc), -1) AS g FROM long_at),
merged AS (SELECT doc, g AS pos, string_agg(line, ' ' ORDER BY pos) AS line FROM grouped GROUP BY doc, g)"""


def segments(min_chars: int = 20, max_chars: int = 5000) -> str:
    return (
        lines(min_chars, max_chars)
        + f""",
numbered AS (SELECT doc, line, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS k FROM merged),
segs AS (SELECT doc || ':s:' || k AS source_id, line AS source_text, {approx('line')} AS length_approx, doc, k, length(line) AS char_len FROM numbered
  WHERE length(line) BETWEEN {min_chars} AND {max_chars} AND NOT {noise('line')})"""
    )


def blobs(most: int = 512) -> str:
    return f""",
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY k) AS rn FROM segs),
packed AS (
  SELECT doc, rn, 0 AS blob, length_approx::BIGINT AS total FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.doc, o.rn, CASE WHEN p.total + o.length_approx > {most} THEN p.blob + 1 ELSE p.blob END, CASE WHEN p.total + o.length_approx > {most} THEN o.length_approx ELSE p.total + o.length_approx END
  FROM packed p JOIN ordered o ON o.doc = p.doc AND o.rn = p.rn + 1),
blob_rows AS (SELECT o.doc, p.blob, string_agg(o.source_text, chr(10) ORDER BY o.rn) AS source_text, min(o.k) AS span_from, max(o.k) AS span_to, count(*) AS num_segments FROM packed p JOIN ordered o ON o.doc = p.doc AND o.rn = p.rn GROUP BY o.doc, p.blob),
blobs AS (SELECT doc || ':b:' || blob AS source_id, source_text, {approx('source_text')} AS length_approx, span_from, span_to, num_segments FROM blob_rows)"""


def balanced(table: str, size: int, seed: int, name: str, buckets: int = 9, oversample: float = 2.0) -> str:
    """CTE ``name`` with the columns of ``table`` (source_id, length_approx)."""
    from lingloom.operators.sample import capacities, quotas

    wanted = quotas(size, buckets)
    room = capacities(wanted, oversample)
    lst = lambda v: "[" + ", ".join(map(str, v)) + "]"
    return f"""
{name}_b AS (SELECT *, {bucket('length_approx')} AS b FROM {table}),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY sha256('{seed}:keep:' || source_id), source_id) AS r FROM {name}_b),
{name} AS (SELECT * EXCLUDE (b, r) FROM {name}_r WHERE r <= {lst(room)}[b + 1] ORDER BY r > {lst(wanted)}[b + 1], sha256('{seed}:fill:' || source_id), source_id LIMIT {size})"""


def stub(text: str, ident: str, index: str) -> str:
    """A candidate: the words turned round from a hashed position."""
    w = f"string_split({text}, ' ')"
    k = f"(('0x' || substr(sha256({ident} || ':' || {index}), 1, 6))::BIGINT % len({w}))"
    return f"array_to_string(list_concat({w}[({k} + 1):], {w}[1:{k}]), ' ')"


def rule_reason(s: str, t: str) -> str:
    c = strip(f"coalesce({t}, '')")
    src = f"coalesce({s}, '')"
    ratio = f"(length({c})::DOUBLE / greatest(1, length({strip(src)})))"
    hit = " OR ".join(f"contains(lower({c}), lower({q(b)}))" for b in BLOCKED)
    return (
        f"CASE WHEN {c} = '' THEN 'empty' WHEN length({c}) < 1 THEN 'too_short' WHEN length({c}) > 20000 THEN 'too_long' WHEN {hit} THEN 'blocked_substring'"
        f" WHEN {ratio} < 0.2 THEN 'ratio_too_small' WHEN {ratio} > 4.0 THEN 'ratio_too_large' WHEN {jaccard(src, c)} > 0.8 THEN 'copy_overlap' ELSE 'pass' END"
    )


def code(c: str) -> str:
    plain = f"lower(replace(trim({c}), '_', '-'))"
    table = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in ALIASES.items())
    return f"(CASE {plain} {table} ELSE {plain} END)"


def name(c: str) -> str:
    plain = f"lower(replace(trim({c}), '_', '-'))"
    table = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in NAMES.items())
    return f"coalesce(CASE {plain} {table} END, CASE split_part({plain}, '-', 1) {table} END, {plain})"


def fill(pattern: str, **sql: str) -> str:
    """A format string as a concatenation of SQL pieces."""
    from string import Formatter

    parts = []
    for literal, field, _, _ in Formatter().parse(pattern):
        if literal:
            parts.append(q(literal).replace("\n", "' || chr(10) || '"))
        if field is not None:
            parts.append(sql[field])
    return "(" + " || ".join(parts) + ")"


def translate_user(text: str, src: str, tgt: str) -> str:
    return fill(TRANSLATE_USER, source_lang=name(src), target_lang=name(tgt), src_lang_code=src, tgt_lang_code=tgt, text=text)


def judge_user(s: str, c: str, src: str, tgt: str) -> str:
    return fill(JUDGE_USER, source_lang=name(src), target_lang=name(tgt), source_text=s, candidate=c)


SYSTEM, JUDGE = q(TRANSLATE_SYSTEM), q(JUDGE_SYSTEM)


def pieces(t: str) -> str:
    return f"regexp_extract_all({t}, '{TOKEN}')"


END = q(EOS)
