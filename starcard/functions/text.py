"""Column expressions over names and free text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from starcard.rules import ID_UNSAFE, NOISE_TOKENS, SCHEMA_NAME, STOP_WORDS, TOKEN

# white space of every kind, line ends and tabs included
SPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def clean_text(c: Column) -> Column:
    """Trimmed text without sheet artefacts; null for null, blank and "nan"."""
    first = strip(c.cast("string"))
    swapped = F.replace(first, F.lit("_x000D_"), F.lit("\n"))
    return F.when(F.lower(first) != "nan", F.nullif(strip(swapped), F.lit("")))


def normalize_name(c: Column) -> Column:
    """``PATIENT_SEX_ID`` -> ``patient sex``: one trailing noise token goes if others remain."""
    tokens = F.split(F.lower(c), "_")
    n = F.size(tokens)
    noisy = (n > 1) & F.element_at(tokens, -1).isin(NOISE_TOKENS)
    return F.array_join(F.when(noisy, F.slice(tokens, F.lit(1), n - 1)).otherwise(tokens), " ")


def safe_id(c: Column) -> Column:
    return F.translate(c, ID_UNSAFE, "_" * len(ID_UNSAFE))


def fk_parts(fk: Column) -> Column:
    """struct(schema, table, column) of a three-part reference, else null."""
    parts = F.split(fk, r"\.")
    return F.when(
        F.size(parts) == 3,
        F.struct(
            F.get(parts, F.lit(0)).alias("schema"),
            F.get(parts, F.lit(1)).alias("table"),
            F.get(parts, F.lit(2)).alias("column"),
        ),
    )


def fk_table(fk: Column) -> Column:
    """``SCHEMA.TABLE`` of a three-part reference, else null."""
    parts = fk_parts(fk)
    return F.when(parts.isNotNull(), F.concat(parts["schema"], F.lit("."), parts["table"]))


def valid_schema(c: Column) -> Column:
    return c.rlike(SCHEMA_NAME)


def all_tokens(c: Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def tokens(c: Column) -> Column:
    """Lower-case word tokens without stop words."""
    return F.filter(all_tokens(c), lambda w: ~w.isin(STOP_WORDS))


def _ends(w: Column, *ends: str) -> Column:
    return reduce(or_, [w.endswith(e) for e in ends])


def stem(w: Column) -> Column:
    """A lower-case English word without its plural ending, by the three rules of Harman's S stemmer."""
    return (
        F.when(_ends(w, "ies") & ~_ends(w, "eies", "aies"), F.concat(F.left(w, F.length(w) - 3), F.lit("y")))
        .when(_ends(w, "es") & ~_ends(w, "aes", "ees", "oes"), F.left(w, F.length(w) - 1))
        .when(_ends(w, "s") & ~_ends(w, "us", "ss"), F.left(w, F.length(w) - 1))
        .otherwise(w)
    )


def stem_word(w: str) -> str:
    """``stem`` of a single word, for tasks that count words."""
    if w.endswith("ies") and not w.endswith(("eies", "aies")):
        return w[:-3] + "y"
    if (w.endswith("es") and not w.endswith(("aes", "ees", "oes"))) or (w.endswith("s") and not w.endswith(("us", "ss"))):
        return w[:-1]
    return w


def stemmed(words: Column) -> Column:
    """Stems of tokens; what a stem leaves empty goes."""
    return F.filter(F.transform(words, stem), lambda w: w != "")


def iso_time(c: Column) -> Column:
    """ISO 8601 with microseconds only when there are any."""
    return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def bytes_text(c: Column) -> Column:
    """UTF-8 text of a binary column; malformed bytes become the replacement character."""
    return F.make_valid_utf8(c.cast("string"))
