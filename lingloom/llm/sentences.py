"""Sentence boundaries across languages and scripts, as SQL expressions only.

Marks that do not end a sentence (decimals, addresses, initials, abbreviations,
anything inside quotation marks) are masked by private-use characters, one for
one, so that positions never move. A break character is then inserted after
every terminator that is left, the text is split there, and the pieces are
unmasked. No Python worker takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingloom.functions.text import let

# Marks, their placeholders, and the break character.
MARKS = ".!?…。！？｡"
MASKED = "\ue000\ue001\ue002\ue003\ue004\ue005\ue006\ue007"
SPACE_MASK = "\ue00a"
BREAK = "\ue010"
PRIVATE_USE = "".join(chr(c) for c in range(0xE000, 0xE012))
DOT = "\ue000"

# Abbreviations that never end a sentence (titles, references, "that is").
ABBREVIATIONS_WITHIN = [
    "Dr", "Dra", "Prof", "Mr", "Mrs", "Ms", "Messrs", "St", "Sr", "Sra", "Srta", "Mme", "Mlle", "MM", "Hr", "Fr", "Hrn",
    "Gen", "Col", "Capt", "Lt", "Sgt", "Rev", "Hon", "Ing", "Dipl", "vol", "vols", "Vol", "no", "No", "nos", "Nr", "nº", "núm",
    "p", "pp", "pág", "págs", "pag", "Bd", "Abs", "Art", "art", "fig", "Fig", "figs", "ch", "chap", "cap", "sec", "Sec", "ed", "eds",
    "vgl", "Vgl", "cf", "Cf", "ca", "Ca", "approx", "aprox", "env", "vs", "bzw", "sog", "usf", "inkl", "zzgl", "evtl", "ggf", "tel", "Tel",
    "т", "с", "стр", "см", "ср", "гл", "рис", "им", "тов", "проф", "акад", "д-р", "г-н", "г-жа", "ул", "ок", "прибл", "напр",
    "ej", "Ej", "ex", "Ex", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec",
    "บจก", "หจก", "ดร", "นพ", "พญ", "ผศ", "รศ", "ศ", "พล",
]
# Abbreviations that end a sentence unless it visibly goes on.
ABBREVIATIONS_EITHER = [
    "Bros", "Jr", "etc", "usw", "др", "пр", "руб", "коп", "г", "гг", "в", "вв", "тыс", "млн", "ч", "мин",
]
# The same for companies and co-authors, after which an article begins a sentence of its own.
ABBREVIATIONS_OF_NAMES = ["Co", "Corp", "Inc", "Ltd", "Cía", "Cia", "al"]
ARTICLES = ["the", "a", "an", "our", "el", "la", "los", "las", "un", "una", "nuestro", "nuestra", "o", "os", "um", "uma", "le", "les", "une", "notre"]
# Thai words with which a clause goes on after a blank ...
THAI_CONTINUES = [
    "เพราะ", "เนื่องจาก", "เพื่อ(?!น)", "แม้", "ขณะที่", "ในขณะที่", "ก่อนที่", "หลังจาก", "ซึ่ง", "จนกระทั่ง", "ตามที่(?!คาด)", "ในชื่อ", "รายการ", "หน้า(?!ร้อน)", "กำลัง",
    "เหรียญ", "บาท", "กม", "กก", "ซม", "น\\.", "น[" + DOT + "]", "บจก", "เมตร", "คน(?=[ )]|$)", "ปี(?=[ )]|$)", "ครั้ง", "เปอร์เซ็นต์", "ในรายการ",
]
# Fixed values: ... and words after which it must go on.
THAI_OPEN = ["โดย", "ร่วมกับ", "กับ", "เพื่อ", "เช่น", "ประมาณ", "เล่ม", "หน้า", "ข้อ", "เวลา", "ราคา", "ผ่าน", "ป้าย", "ชื่อ", "รายการ", "ว่า", "บจก.", "ดร.", "นาย", "นาง", "คุณ"]
# Pairs of quotation marks, opener and closer.
QUOTES = [("“", "”"), ("«", "»"), ("„", "“"), ("「", "」"), ("『", "』"), ("‹", "›")]

_CLOSERS = "[\"'”’»“›\\)\\]」』）】〉》]*"
_CJK = "\\u2e80-\\u9fff\\uf900-\\ufaff\\uac00-\\ud7a3\\u0e00-\\u0e7f\\uff00-\\uffef"


def _mask_quoted(text: Column, opener: str, closer: str) -> Column:
    """Mask marks and blanks between ``opener`` and ``closer``.

    A quotation that holds a line break is taken for an unbalanced mark and left
    alone.
    """
    def masked(piece: Column, inner: Column) -> Column:
        closed = F.contains(piece, F.lit(closer)) & ~F.contains(inner, F.lit("\n"))
        return F.when(closed, F.concat(F.translate(inner, MARKS + " ", MASKED + SPACE_MASK), _rest(piece, inner))).otherwise(piece)

    def one(piece: Column, i: Column) -> Column:
        return F.when(i > 0, let(F.substring_index(piece, closer, 1), lambda inner: masked(piece, inner))).otherwise(piece)

    joined = F.array_join(F.transform(F.split(text, f"\\Q{opener}\\E", -1), one), opener)
    return F.when(F.contains(text, F.lit(opener)), joined).otherwise(text)


def _quoted_by(opener: str, closer: str):
    return lambda text: _mask_quoted(text, opener, closer)


def _rest(piece: Column, head: Column) -> Column:
    return F.substring(piece, F.length(head) + 1, F.length(piece))


def _mask_straight(text: Column) -> Column:
    """The same for straight quotes, which open and close by turns within a line."""
    def by_turns(pieces: Column) -> Column:
        even = F.size(pieces) % 2 == 0  # an odd number of quotes: not paired
        masked = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.translate(p, MARKS + " ", MASKED + SPACE_MASK)).otherwise(p))
        return F.array_join(F.when(even, pieces).otherwise(masked), '"')

    lines = F.transform(F.split(text, "\n", -1), lambda one: let(F.split(one, '"', -1), by_turns))
    return F.when(F.contains(text, F.lit('"')), F.array_join(lines, "\n")).otherwise(text)


def _mask_quotations(t: Column) -> Column:
    for opener, closer in QUOTES:
        t = let(t, _quoted_by(opener, closer))
    return let(t, _mask_straight)


def mask(text: Column) -> Column:
    """``text`` with every mark that ends no sentence replaced, position for position."""
    # rare characters are looked for before anything is replaced: most texts have none
    t = let(text, lambda x: F.when(x.rlike(f"[{PRIVATE_USE}]"), F.translate(x, PRIVATE_USE, "�" * len(PRIVATE_USE))).otherwise(x))
    t = let(t, lambda x: F.when(x.rlike("[“«„「『‹\"]"), _mask_quotations(x)).otherwise(x))
    # inside numbers, versions, addresses, "i.e": a dot right before a small letter or digit.
    # The patterns start with the mark itself: a position without one costs one comparison.
    t = F.regexp_replace(t, "\\.(?=[\\p{Ll}\\p{N}])(?<=[\\p{L}\\p{N}_/\\-]\\.)", DOT)
    t = F.regexp_replace(t, "\\?(?=[\\p{L}\\p{N}_]+=)(?<=[\\p{L}\\p{N}/]\\?)", MASKED[2])
    within = "|".join(ABBREVIATIONS_WITHIN)
    either = "|".join(ABBREVIATIONS_EITHER)
    no_word = "(?<![\\p{L}\\p{N}])"
    t = F.regexp_replace(
        t,
        "\\.(?:"
        "(?=[,;:]|[ \\u00a0\\u202f]+[!?])"  # before a comma and the like, or a mark set off by a blank
        "|(?=\\s)(?<=(?:^|[\\n\\r])[ \\t]{0,4}\\p{N}{1,3}\\.)"  # after a list number
        f"|(?=[\\s)\\p{{Lu}}\\p{{N}}º])(?<={no_word}(?:{within})\\.)"  # after a title or the like
        "|(?=\\s?\\p{Lu}[\\p{Ll}" + DOT + ".])(?<=(?<![\\p{L}\\p{N}\\-])\\p{Lu}\\.)"  # after an initial
        f"|(?=\\s?[BhaäÄUom]\\.)(?<={no_word}[zdusoai]\\.)"
        f"|(?=\\s?(?:m|ex|е|д|п)\\.)(?<={no_word}[apтие]\\.)"
        f"|(?<=z[. {DOT}]{{1,2}}B\\.)|(?<=d[. {DOT}]{{1,2}}h\\.)|(?<=т[. {DOT}]{{1,2}}е\\.)|(?<=(?<!\\p{{L}})[ie][.{DOT}][eg]\\.)"
        f"|(?=\\s?\\p{{N}})(?<={no_word}[SpcPс]\\.)"
        "|(?=\\s(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)(?!\\p{L}))(?<=\\p{N}{1,2}\\.)"
        ")",
        DOT,
    )
    names, articles = "|".join(ABBREVIATIONS_OF_NAMES), "|".join(ARTICLES)
    in_brackets = "\\)(?!\\s+[\\p{Lu}“„«\"¿¡(])"
    goes_on = "[\\p{Ll}\\p{N}]|\\((?!\\p{Lu})"
    t = F.regexp_replace(
        t,
        f"\\.(?:(?={in_brackets}|[ ]+(?:{goes_on}))(?<={no_word}(?:{either}|\\p{{Ll}})\\.)"
        f"|(?={in_brackets}|[ ]+(?!(?:{articles})[ ])(?:{goes_on}))(?<={no_word}(?:{names})\\.))",
        DOT,
    )
    return let(t, lambda x: F.when(x.rlike("[\\u0e01-\\u0e5b]"), _mask_thai(x)).otherwise(x))


def _mask_bracketed(text: Column) -> Column:
    """Mask the blanks between a bracket and the next one that closes it on the same line."""

    def one(piece: Column, i: Column) -> Column:
        masked = lambda inner: F.when(F.contains(piece, F.lit(")")) & ~F.contains(inner, F.lit("\n")), F.concat(F.translate(inner, " ", SPACE_MASK), _rest(piece, inner))).otherwise(piece)
        return F.when(i > 0, let(F.substring_index(piece, ")", 1), masked)).otherwise(piece)

    return F.array_join(F.transform(F.split(text, "\\Q(\\E", -1), one), "(")


def _mask_thai(t: Column) -> Column:
    """Thai writes no marks: a blank before Thai ends a sentence unless the clause goes on."""
    t = F.regexp_replace(t, "\\.(?<=[\\u0e01-\\u0e5b]\\.)", DOT)
    t = let(t, lambda x: F.when(F.contains(x, F.lit("(")), _mask_bracketed(x)).otherwise(x))
    goes_on = "|".join(THAI_CONTINUES)
    opened = "|".join(w.replace(".", DOT) for w in THAI_OPEN)
    return F.regexp_replace(
        t,
        # before Thai, after anything; before another script only after Thai or after a code
        f"(?= )(?:(?<=[\\u0e01-\\u0e45\\u0e47-\\u0e4e\\p{{N}}\\p{{Lu}}\\p{{Ll}}”»\"){DOT}])(?= +(?:[\\u0e01-\\u0e4e“]|\\([\\u0e01-\\u0e4e][^()\\n]{{24}}))"
        f"|(?<=[\\u0e01-\\u0e45\\u0e47-\\u0e4e”»)]|[0-9]-[\\p{{Lu}}\\p{{N}}]{{3}}|[\\u0e01-\\u0e4e]{DOT})"
        f"(?= +(?:[\\p{{IsCyrillic}}\\p{{IsHangul}}\\p{{IsHan}}\\p{{IsHiragana}}\\p{{IsKatakana}}]|[\\p{{Lu}}„“«][\\p{{L}}'’]*,?(?: [\\p{{L}}'’]+,?){{3}})))"
        f"(?<!(?:{opened}))(?<!(?:^|[\\n\\r])[ \\t]{{0,4}}\\p{{N}}{{1,3}}{DOT})( +)(?!(?:{goes_on}))",
        f"$1{BREAK}",
    )


def mark_breaks(masked: Column) -> Column:
    """Insert the break character after every terminator that is left and after line ends."""
    t = F.regexp_replace(
        masked,
        # the first look-ahead costs one comparison where no mark stands
        "(?=[\\n\\r\\u000b\\u000c\\u0085\\u2028\\u2029.!?…。！？｡။።।॥؟۔\"”»“])(?:"
        "([\\n\\r\\u000b\\u000c\\u0085\\u2028\\u2029]+)"
        f"|([.!?…。！？｡។။።।॥؟۔]+{_CLOSERS})(?=[\\s{BREAK}])"
        f"|([。！？｡]+{_CLOSERS})(?=[^\\s。！？｡…!?.」』”’）)])"
        f"|(…+{_CLOSERS})(?=[\\p{{L}}（(“「«])"
        f"|([!?]+{_CLOSERS})(?=[\\p{{L}}（(“「«])"
        f"|((?<=[\\p{{L}}\\p{{N}})”»“」\"])\\.+{_CLOSERS})(?=[\\p{{Lu}}{_CJK}“«(])"
        f"|([\"”»“]+)(?=\\s+[\\p{{Lu}}¿¡])(?<=[{MASKED}]{{1,3}}[\"”»“]{{1,2}}))",
        f"$1$2$3$4$5$6$7{BREAK}",
    )
    # a quotation announced by a colon holds its own end: X：“...。”
    after_quote = f"(：“[^“”\\n]*[{MASKED}]”)(?=[^\\s，、。！？…）{BREAK}])"
    return let(t, lambda x: F.when(F.contains(x, F.lit("：“")), F.regexp_replace(x, after_quote, f"$1{BREAK}")).otherwise(x))


def pieces(text: Column) -> Column:
    """Array of masked pieces; together they are the whole text."""
    return F.split(mark_breaks(mask(text)), BREAK, -1)


def unmask(piece: Column) -> Column:
    return F.translate(piece, MASKED + SPACE_MASK, MARKS + " ")


# Blanks at the edges of a sentence.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200C)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def sentences(text: Column) -> Column:
    """Array of the sentences of ``text`` in order; null for null, empty for a blank text.

    A text that holds placeholders of its own gets its sentences by position
    from the text itself, as they cannot be told from those that were put in.
    """

    def cut(whole: Column) -> Column:
        at = lambda ps, k: F.aggregate(F.slice(ps, F.lit(1), k), F.lit(1), lambda a, p: a + F.length(p))
        return let(pieces(whole), lambda ps: F.transform(ps, lambda p, k: F.substring(whole, at(ps, k), F.length(p))))

    restored = let(text, lambda t: F.when(t.rlike(f"[{PRIVATE_USE}]"), cut(t)).otherwise(F.transform(pieces(t), unmask)))
    return F.filter(F.transform(restored, lambda p: F.btrim(p, F.lit(BLANKS))), lambda p: F.length(p) > 0)


def sentence_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, start_pos, end_pos) for each sentence of each distinct key.

    Positions are code points from 0, end excluded. Replayed keys count once, with
    one of their texts if these differ;
    a null or blank text gives no row; a null key is a key like any other. Only
    lengths are shuffled, never texts, and rows of one key are merged before the
    shuffle.
    """
    # outer: else a filter on the array's size is inferred, and the pieces computed twice
    found = df.select(F.col(key), F.xxhash64(F.col(text)).alias("_h"), F.posexplode_outer(pieces(F.col(text))).alias("_i", "_p")).where("_p is not null").select(
        key,
        "_h",
        "_i",
        F.length("_p").alias("_n"),
        (F.length("_p") - F.length(F.ltrim("_p", F.lit(BLANKS)))).alias("_lead"),
        F.length(F.rtrim("_p", F.lit(BLANKS))).alias("_stop"),
    )
    # by key and number first: replays are merged before the shuffle, and a much replayed key is spread
    once = found.groupBy(key, "_h", "_i").agg(F.first("_n").alias("_n"), F.first("_lead").alias("_lead"), F.first("_stop").alias("_stop"))
    before = Window.partitionBy(key).orderBy("_h", "_i").rowsBetween(Window.unboundedPreceding, -1)
    chosen = F.first("_h").over(Window.partitionBy(key).orderBy("_h", "_i"))
    return (
        once.withColumn("_first", chosen).withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where((F.col("_stop") > F.col("_lead")) & (F.col("_h") == F.col("_first")))
        .select(key, (F.col("_at") + F.col("_lead")).cast("int").alias("start_pos"), (F.col("_at") + F.col("_stop")).cast("int").alias("end_pos"))
    )
