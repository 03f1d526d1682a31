"""Text normalisation, tokens and conservative inflection as Column expressions, all inside the JVM.

Spark has no function for Unicode compatibility composition (NFKC) or full case folding, but it ships ICU and can
call its static methods with ``java_method``. Only non-ASCII values take that way.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
NON_ASCII = r"[^\x00-\x7F]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once. Keeps deep expressions linear in size instead of exponential."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _icu(owner: str, method: str, c: Column) -> Column:
    return F.java_method(F.lit(f"com.ibm.icu.{owner}"), F.lit(method), F.coalesce(c, F.lit("")), F.lit(True))


def nfkc(c: Column) -> Column:
    return F.when(c.rlike(NON_ASCII), _icu("text.Normalizer", "compose", c)).otherwise(c)


def fold(c: Column) -> Column:
    """Full Unicode case folding."""
    return F.when(c.rlike(NON_ASCII), _icu("lang.UCharacter", "foldCase", c)).otherwise(F.lower(c))


def words(c: Column) -> Column:
    """Folded word/number tokens in order (no composition): the search view of a text."""
    return _split_words(F.array_join(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), " "), fold)


def _split_words(joined: Column, finish: Callable[[Column], Column]) -> Column:
    return let(joined, lambda j: F.when(j == "", F.array().cast("array<string>")).otherwise(F.split(finish(j), " ")))


def search_words(c: Column) -> Column:
    """Tokens of at least two characters, or digits."""
    return F.filter(words(c), lambda t: (F.char_length(t) >= 2) | t.rlike(r"^\p{Nd}+$"))


def norm_key(c: Column) -> Column:
    """Composed, folded word tokens joined by one space; underscore and punctuation separate tokens."""
    return fold(F.array_join(F.regexp_extract_all(nfkc(c), F.lit(WORD), F.lit(0)), " "))


def plain_key(c: Column) -> Column:
    """``norm_key`` where most values are short and plain: letters and digits are only lower-cased, and ASCII takes one replacement."""
    return (F.when(c.rlike("^[0-9A-Za-z]*$"), F.lower(c))
            .when(~c.rlike(NON_ASCII), F.lower(F.btrim(F.regexp_replace(c, "[^0-9A-Za-z]+", " ")))).otherwise(norm_key(c)))


def key_words(c: Column) -> Column:
    return _split_words(norm_key(c), lambda k: k)


def field_id(c: Column) -> Column:
    """Header to ``[a-z0-9_]`` id; ``unnamed`` when nothing is left."""
    slug = F.btrim(F.regexp_replace(fold(nfkc(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unnamed"))


def squash(c: Column) -> Column:
    """Whitespace runs to one blank, NUL removed, trimmed."""
    messy = c.rlike(r"[\x00-\x1F]|  |[^\x00-\x7F]")
    return F.trim(F.when(messy, F.regexp_replace(F.regexp_replace(c, "\\x00", ""), r"(?U)\s+", " ")).otherwise(c))


def _cut(t: Column, n: int) -> Column:
    return F.left(t, F.char_length(t) - F.lit(n))


def token_forms(t: Column) -> Column:
    """A folded token and the singular or base forms that can be had from it mechanically."""
    n = F.char_length(t)
    own, without_one = F.array(t), F.array(t, _cut(t, 1))
    hissing = t.endswith("ses") | t.endswith("xes") | t.endswith("zes") | t.endswith("ches") | t.endswith("shes")
    plural = (
        F.when(n < 3, own)
        .when(n == 3, F.when(F.substring(t, 2, 1).isin("a", "e", "i", "o", "u"), own).otherwise(without_one))
        .when((n > 4) & t.endswith("ies"), F.array(t, F.concat(_cut(t, 3), F.lit("y"))))
        .when((n > 4) & t.endswith("es"), F.when(hissing, F.array(t, _cut(t, 1), _cut(t, 2))).otherwise(without_one))
        .when(t.endswith("ss") | t.endswith("is") | t.endswith("us") | t.endswith("ws"), own)
        .otherwise(without_one)
    )
    past = F.when(n > 4, F.array(t, _cut(t, 2), _cut(t, 1))).otherwise(own)
    # most tokens have no ending to take off and cost two tests of their last letters
    alpha = t.rlike(r"^\p{L}+$")
    return (F.when(t.endswith("s"), F.when(alpha, plural).otherwise(own)).when(t.endswith("ed"), F.when(alpha, past).otherwise(own))
            .when(t.isNull(), F.array().cast("array<string>")).otherwise(own))


def stem(forms: Column) -> Column:
    """What every word begins with that shares one of a token's forms: the shortest form, and without its last letter if that may stand for ``ies``."""
    return F.array_min(F.transform(forms, lambda f: let(F.regexp_replace(f, "y$", ""), lambda s: F.struct(F.char_length(s).alias("n"), s.alias("s")))))["s"]


def tokens_equivalent(a: Column, b: Column) -> Column:
    return F.arrays_overlap(token_forms(a), token_forms(b))


def search_forms(t: Column) -> Column:
    """Token, its singular forms and the regular plurals of those, kept only if still equivalent."""
    def from_bases(forms: Column) -> Column:
        singles = F.filter(forms, lambda f: F.char_length(f) < F.char_length(t))
        bases = (
            F.when(F.size(singles) > 0, singles)
            .when(t.endswith("ws"), F.array().cast("array<string>"))
            .otherwise(F.array(t))
        )
        bases = F.filter(bases, lambda b: b.rlike(r"^\p{L}{2,}$") & ~b.isin("as", "is", "us"))
        plurals = F.transform(
            bases,
            lambda b: F.when(b.rlike(r"^.+[^aeiou]y$"), F.concat(_cut(b, 1), F.lit("ies")))
            .when(b.rlike(r"(s|x|z|ch|sh)$"), F.concat(b, F.lit("es")))
            .otherwise(F.concat(b, F.lit("s"))),
        )
        return F.filter(
            F.array_distinct(F.concat(forms, plurals)), lambda f: F.arrays_overlap(token_forms(f), forms))

    return let(token_forms(t), from_bases)


def covered(query_tokens: Column, text_tokens: Column) -> Column:
    """How many of the query tokens have an equivalent among the text tokens (both arrays of one row)."""
    return let(
        F.array_distinct(F.flatten(F.transform(text_tokens, token_forms))),
        lambda forms: F.size(F.filter(query_tokens, lambda q: F.arrays_overlap(token_forms(q), forms))))


def key_words_of(phrase: str) -> list[str]:
    """``key_words`` of a phrase known when the plan is made."""
    return [w.casefold() for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", phrase))]


def stop(tokens: Column, stop_words: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def query_tokens(c: Column, limit: int | None = None) -> Column:
    """Content tokens of one question, most frequent first, first-seen order on ties; the first ``limit`` of them if one is given."""
    from factloom.functions.vocab import QUERY_STOP_WORDS

    def ranked(tokens: Column) -> Column:
        return F.transform(
            F.array_distinct(tokens),
            lambda t: F.struct(
                (-F.size(F.filter(tokens, lambda x: x == t))).alias("n"),
                F.array_position(tokens, t).alias("p"),
                t.alias("t"),
            ),
        )

    best = F.array_sort(let(stop(search_words(c), QUERY_STOP_WORDS), ranked))
    best = best if limit is None else F.slice(best, 1, limit)
    return F.transform(best, lambda s: s["t"])
