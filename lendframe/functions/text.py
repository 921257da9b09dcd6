"""Text functions (Column -> Column), all built-in expressions.

Regex dialect notes (the original ran Python ``re``; Spark runs
``java.util.regex``):

* Python ``.`` excludes only ``\\n``; Java's also excludes ``\\r``, U+0085,
  U+2028 and U+2029, so the HTML tag pattern uses ``[^\\n]``.
* Python's ``\\s`` on text is Unicode whitespace *including* U+001C..U+001F;
  Java needs ``(?U)`` for Unicode and the four separators added by hand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendframe.functions.fixed import AMOUNT_NUMBER_FORMS, ESCAPE_REPLACEMENTS

# Python-equivalent whitespace class for Java regex.
WS = r"(?U)[\s\x{1c}-\x{1f}]"
HTML_TAG = "<[^\n]*?>"
# Stands for the currency code while amounts are searched, and what replaces it in texts that hold it.
CODE_MARK = "\x01"
NO_MARK = "\x02"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill_description(translated="DESCRIPTION_TRANSLATED", original="DESCRIPTION") -> Column:
    """Translated description, or the original where it is missing."""
    return F.coalesce(_c(translated), _c(original))


def normalize_text(c, lower: bool = True) -> Column:
    """Replace escaped control sequences, drop HTML tags, collapse
    whitespace, trim and (optionally) lower-case.  Null stays null."""
    out = _c(c)
    for old, new in ESCAPE_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, HTML_TAG, "")
    out = F.regexp_replace(out, WS + "+", " ")
    out = F.trim(out)
    return F.lower(out) if lower else out


def py_strip(c) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def sentences_v1(c) -> Column:
    """Split on every full stop (array, empty pieces kept)."""
    return F.split(_c(c), "[.]", -1)


def sentences_v2(c) -> Column:
    """``<br />`` becomes a space, split on ". ", one space appended to every
    sentence (so an amount at the end of a sentence still has its trailing
    space)."""
    parts = F.split(F.replace(_c(c), F.lit("<br />"), F.lit(" ")), "[.] ", -1)
    return F.transform(parts, lambda s: F.concat(s, F.lit(" ")))


def amount_pattern(currency) -> Column:
    """Regex for an amount next to ``currency``: for every number form, the
    code then the number then a space; then for every form a space, the number
    and the code.  Leftmost alternative wins."""
    cur = _c(currency)
    parts = []
    for form in AMOUNT_NUMBER_FORMS:
        parts += [cur, F.lit(f" ?({form}) |")]
    for i, form in enumerate(AMOUNT_NUMBER_FORMS):
        parts += [F.lit(f" ({form}) ?"), cur]
        if i < len(AMOUNT_NUMBER_FORMS) - 1:
            parts.append(F.lit("|"))
    return F.concat(*parts)


def amounts_v1(sentence: Column, currency: Column) -> Column:
    """All integers of a sentence naming the currency, commas removed
    (array<double>; empty when the sentence does not name it)."""
    nums = F.regexp_extract_all(F.replace(sentence, F.lit(","), F.lit("")), F.lit("([0-9]+)"), 1)
    return F.when(F.contains(sentence, currency),
                  F.transform(nums, lambda m: m.cast("double"))).otherwise(F.array().cast("array<double>"))


def amounts_v2(sentence: Column, currency: Column) -> Column:
    """Amounts written next to the currency code (array<double>).

    The code is first replaced by one character that the text does not hold, so
    that one constant pattern serves all rows: a pattern with the row's code in it is
    compiled anew whenever the code changes.  That needs codes whose occurrences cannot overlap
    (three capitals, the first unlike the last); any other code is searched by its own pattern."""
    marked = F.replace(F.translate(sentence, CODE_MARK, NO_MARK), currency, F.lit(CODE_MARK))
    plain = currency.rlike("^[A-Z]{3}$") & (F.substring(currency, 1, 1) != F.substring(currency, 3, 1))
    matches = F.when(plain, F.regexp_extract_all(marked, amount_pattern(F.lit(CODE_MARK)), 0)).otherwise(
        F.regexp_extract_all(sentence, amount_pattern(currency), 0))
    return F.when(F.contains(sentence, currency),
                  F.transform(matches, lambda m: F.regexp_replace(m, "[^0-9.]", "").cast("double"))
                  ).otherwise(F.array().cast("array<double>"))


def max_stated_amount(sentences: Column, currency: Column, version: int = 2) -> Column:
    """Largest amount over all sentences of one text; null if none.

    Row-local: no explode and no group-by, so the per-loan maximum costs no
    shuffle.
    """
    fn = amounts_v2 if version == 2 else amounts_v1
    per_sentence = F.transform(sentences, lambda s: fn(s, currency))
    return F.array_max(F.flatten(per_sentence))


def words(c) -> Column:
    """Whitespace tokens of an already normalised text ([] for null)."""
    return F.filter(F.split(F.coalesce(_c(c), F.lit("")), " ", -1), lambda w: w != F.lit(""))


def token_window(tokens: Column, max_len: int) -> Column:
    """First ``max_len`` tokens padded with "" to exactly ``max_len``."""
    head = F.slice(tokens, 1, max_len)
    pad = F.greatest(F.lit(0), F.lit(max_len) - F.size(head))
    return F.concat(head, F.array_repeat(F.lit(""), pad))


def attention_mask(tokens: Column, max_len: int) -> Column:
    n = F.least(F.size(tokens), F.lit(max_len))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))


def image_file_name(image_id) -> Column:
    return F.format_string("%d.jpg", _c(image_id))


def epoch_suffix(epoch) -> Column:
    return F.format_string("epoch%02d", _c(epoch))
