"""Cleaning of mail bodies (shared by indexing and incoming mail) and word features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .html import html_text
from .porter import stemmed

# Sign-offs, banners and disclaimers.
SIGN_OFFS = (
    r"--|best regards[, ]*|regards[, ]*|sincerely[, ]*|thanks[, ]*|thank you[, ]*|many thanks[, ]*|cheers[, ]*"
    r"|sent from my (?:iphone|ipad|android|mobile device)|get outlook for (?:ios|android)"
)
DISCLAIMERS = [
    "this email and any files transmitted with it are confidential",
    "this message contains confidential information",
    "please consider the environment before printing",
]
#: White space as Python's str.strip() has it, for a class of a pattern; and the same but for the line end.
BLANKS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GAP = rf"[{BLANKS}&&[^\n]]"
_AROUND = rf"\A[{BLANKS}]+|[{BLANKS}]+\z"
#: A marker line cuts only if it starts at this offset or later.
LEAST_BEFORE_CUT = 40
BANNERS = rf"-{{2,}}{_GAP}*original message{_GAP}*-{{2,}}|-{{2,}}{_GAP}*forwarded message{_GAP}*-{{2,}}|_{{5,}}|on{_GAP}[^\n]{{1,120}}{_GAP}wrote:"
_HEAD = rf"(?is)\A(.{{{LEAST_BEFORE_CUT - 1},}}?)\n{_GAP}*"
QUOTE_PATTERN = _HEAD + rf"(?:>.*|(?:{BANNERS}){_GAP}*(?:\n.*)?)\z"
SIGN_OFF_PATTERN = _HEAD + rf"(?:{SIGN_OFFS}){_GAP}*(?:\n.*)?\z"
#: English words that carry no topic (a short public stop word list).
STOP_WORDS = (
    "a an and are as at be been but by can could did do does for from had has have he her his how i if in into is it its me my no not of on or our "
    "she so than that the their them then there these they this to too us was we were what when which who will with would you your"
).split()


def strip_html(c) -> Column:
    """T1. HTML to text; text without both < and > stays as it is."""
    return bind(_col(c), html_text)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def cut_quotes(c) -> Column:
    """T2. Without what follows the first quoted line or banner."""
    return F.regexp_replace(_col(c), QUOTE_PATTERN, "$1")


def cut_pasted_headers(c) -> Column:
    """T3. Without what follows a `From:` line that has Sent or Date, To and Subject among the next four lines."""

    def kept(lines: Column) -> Column:
        def starts(i: Column) -> Column:
            window = F.transform(F.slice(lines, i + 2, 4), lambda x: F.regexp_replace(x, rf"^[{BLANKS}]+", ""))
            has = lambda p: F.exists(window, lambda x: x.rlike(p))
            offset = F.length(F.array_join(F.slice(lines, 1, i), "\n")) + 1
            return F.get(lines, i).rlike(rf"(?i)^[{BLANKS}]*from:[{BLANKS}]*[^{BLANKS}]") & (i > 0) & (offset >= LEAST_BEFORE_CUT) & has(r"(?i)^(sent|date):") & has("(?i)^to:") & has("(?i)^subject:")

        at = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), starts)), F.size(lines))
        return F.array_join(F.slice(lines, 1, at), "\n")

    return bind(_col(c), lambda t: F.when(~t.rlike(rf"(?im)^[{BLANKS}]*from:"), t).otherwise(bind(F.split(t, "\n"), kept)))


def strip_quoted_history(c) -> Column:
    """T2 and T3: whichever cuts earlier."""
    both = bind(_col(c), lambda t: F.array(cut_quotes(t), cut_pasted_headers(t)))
    return bind(both, lambda x: F.when(F.length(x[0]) <= F.length(x[1]), x[0]).otherwise(x[1]))


def remove_signature(c) -> Column:
    """T4. Without what follows the first sign-off line."""
    return F.regexp_replace(_col(c), SIGN_OFF_PATTERN, "$1")


def _before(marker: str):
    return lambda t: F.when(F.contains(F.lower(t), F.lit(marker)), F.left(t, F.instr(F.lower(t), marker) - 1)).otherwise(t)


def remove_disclaimers(c) -> Column:
    """T5. Cut at each marker in turn, whatever its case."""
    out = _col(c)
    for m in DISCLAIMERS:
        out = bind(out, _before(m))
    return out


def normalize_whitespace(c) -> Column:
    """T6. Runs of blanks and tabs to one blank, at most one empty line, no white space around."""
    out = F.regexp_replace(F.regexp_replace(_col(c), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, _AROUND, "")


def clean_plain(c) -> Column:
    """T2 to T6, for text that holds no HTML."""
    return normalize_whitespace(remove_disclaimers(remove_signature(strip_quoted_history(c))))


def clean_text(c) -> Column:
    """T7. T1 to T6."""
    return clean_plain(strip_html(c))


def embedding_text(subject, body) -> Column:
    """T8. Subject, an empty line and the clean body; the body alone if the subject is blank."""
    s = F.regexp_replace(_col(subject), _AROUND, "")
    return F.concat_ws("\n\n", F.nullif(s, F.lit("")), _col(body))


def normalize_email(c) -> Column:
    """T9. Without white space around, in lower case."""
    return F.lower(F.regexp_replace(_col(c), _AROUND, ""))


def preview(c, chars: int = 200) -> Column:
    """T10."""
    return F.substring(_col(c), 1, chars)


def words(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lexemes(c) -> Column:
    """T11. Distinct words in lower case without stop words, not stemmed."""
    return F.array_distinct(F.filter(words(c), lambda w: ~w.isin(STOP_WORDS)))


#: A table of stems of at most so many words is broadcast; a larger one is joined by shuffle.
BROADCAST_STEMS = 500_000


def with_lexemes(df: DataFrame, key: str, c: str, to: str = "lexemes") -> DataFrame:
    """T11. df with the distinct stemmed lexemes of column c, in the order of their first occurrence.

    Each distinct word of the table is stemmed once, and the stems are joined back to the rows. key names a column that
    tells the rows apart. Rows with a null key or without words get an empty array. The words are counted to choose the
    join. Words, stems and the lexemes of each key are written once: what is read from the result splits no text again.
    """
    scratch = Scratch(df.sparkSession)
    split = scratch.write(df.select(F.col(key).alias("lx__k"), lexemes(c).alias("words")).filter("lx__k IS NOT NULL"))
    each = split.select("lx__k", F.posexplode("words").alias("pos", "word"))
    stems = scratch.write(stemmed(each.select("word").distinct()))
    stems = F.broadcast(stems) if stems.count() <= BROADCAST_STEMS else stems
    back = each.join(stems, "word").groupBy("lx__k").agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("x"))
    back = scratch.last(back.select("lx__k", F.array_distinct(F.transform("x", lambda x: x["stem"])).alias("lx__w")))
    made = df.drop(to).join(back, F.col(key) == F.col("lx__k"), "left")
    return made.withColumn(to, F.coalesce("lx__w", F.array().cast("array<string>"))).drop("lx__k", "lx__w")


IDENTIFIER = r"\b[A-Za-z]{2,6}-[A-Za-z0-9-]+\b"
TEMP_ID = r"\b(cust|tkt|q)_\d+(_\d+)?\b"


def identifiers(c) -> Column:
    """T12. Identifiers such as AA-123, in order."""
    return F.regexp_extract_all(_col(c), F.lit(IDENTIFIER), F.lit(0))


def without_identifiers(c) -> Column:
    return F.regexp_replace(_col(c), IDENTIFIER, " ")


def has_temp_id(c) -> Column:
    return _col(c).rlike(TEMP_ID)
