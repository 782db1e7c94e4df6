"""Porter's stemmer (1980) as column expressions, meant for the distinct words of a table.

A word's shape is a string of c and v, one for each letter: y after a consonant is a vowel. The measure of a stem is the
number of runs v..c.. in its shape. Each step takes the longest suffix that fits, and only then looks at its condition.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes and what replaces them, step by step, as published.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(word: Column) -> Column:
    """c or v for each letter of a lower-case word."""
    letters = F.split(word, "")
    next_ = lambda done, x: F.when(x.isin("a", "e", "i", "o", "u") | ((x == "y") & done.endswith("c")), "v").otherwise("c")
    return F.aggregate(letters, F.lit(""), lambda done, x: F.when(x == "", done).otherwise(F.concat(done, next_(done, x))))


def _measure(stem_shape: Column) -> Column:
    return F.regexp_count(stem_shape, F.lit("v+c+"))


def _ends_double(word: Column, stem_shape: Column) -> Column:
    return word.rlike(r"([a-z])\1$") & stem_shape.endswith("c")


def _ends_cvc(word: Column, stem_shape: Column) -> Column:
    return stem_shape.endswith("cvc") & ~word.rlike("[wxy]$")


def _without(word: Column, n: Column | int) -> Column:
    return F.left(word, F.length(word) - n)


def _step(word: Column, form: Column, table: dict[str, str], least: int) -> Column:
    """word with its longest suffix of the table replaced, if the stem before it has a measure above least."""
    longest_first = "|".join(sorted(table, key=len, reverse=True))
    suffix = F.regexp_extract(word, f"({longest_first})$", 1)
    stem = _without(word, F.length(suffix))
    put = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), suffix)
    return F.when((suffix != "") & (_measure(F.left(form, F.length(stem))) > least), F.concat(stem, put)).otherwise(word)


def stemmed(words: DataFrame, word: str = "word", to: str = "stem") -> DataFrame:
    """words with the stem of each word in column `to`. Words of one or two letters, or with other letters than a to z, stay."""
    w, s = "po__w", "po__s"
    df = words.withColumn(w, F.col(word))
    shaped = lambda d: d.withColumn(s, shape(F.col(w)))
    x, form = F.col(w), F.col(s)
    # 1a: plurals
    plural = F.when(x.rlike("(sses|ies)$"), _without(x, 2)).when(x.rlike("ss$"), x).when(x.endswith("s"), _without(x, 1)).otherwise(x)
    df = shaped(df.withColumn(w, plural))
    # 1b: -eed, -ed, -ing
    before = lambda n: F.left(form, F.length(x) - n)
    cut = F.when(x.endswith("eed"), F.lit(0)).when(x.endswith("ed") & F.contains(before(2), F.lit("v")), F.lit(2)).when(x.endswith("ing") & F.contains(before(3), F.lit("v")), F.lit(3)).otherwise(F.lit(0))
    df = df.withColumn("po__n", cut).withColumn(w, F.when(x.endswith("eed") & (_measure(before(3)) > 0), _without(x, 1)).otherwise(_without(x, F.col("po__n"))))
    df = shaped(df)
    mended = (
        F.when(x.rlike("(at|bl|iz)$"), F.concat(x, F.lit("e"))).when(_ends_double(x, form) & ~x.rlike("[lsz]$"), _without(x, 1))
        .when((_measure(form) == 1) & _ends_cvc(x, form), F.concat(x, F.lit("e"))).otherwise(x)
    )
    df = shaped(df.withColumn(w, F.when(F.col("po__n") > 0, mended).otherwise(x)))
    # 1c: -y
    df = shaped(df.withColumn(w, F.when(x.endswith("y") & F.contains(before(1), F.lit("v")), F.concat(_without(x, 1), F.lit("i"))).otherwise(x)))
    # 2, 3: double and single suffixes
    for table in (STEP_2, STEP_3):
        df = shaped(df.withColumn(w, _step(x, form, table, 0)))
    # 4: bare suffixes; -ion only after s or t
    suffix = F.regexp_extract(x, f"({'|'.join(sorted(STEP_4, key=len, reverse=True))})$", 1)
    stem = _without(x, F.length(suffix))
    fits = (suffix != "") & (_measure(F.left(form, F.length(stem))) > 1) & ((suffix != "ion") | stem.rlike("[st]$"))
    df = shaped(df.withColumn(w, F.when(fits, stem).otherwise(x)))
    # 5: -e, -ll
    m, bare = _measure(before(1)), _without(x, 1)
    df = shaped(df.withColumn(w, F.when(x.endswith("e") & ((m > 1) | ((m == 1) & ~_ends_cvc(bare, before(1)))), bare).otherwise(x)))
    df = df.withColumn(w, F.when(x.endswith("ll") & (_measure(form) > 1), _without(x, 1)).otherwise(x))
    plain = F.col(word).rlike("^[a-z]{3,}$")
    return df.withColumn(to, F.when(plain, x).otherwise(F.col(word))).drop(w, s, "po__n")


