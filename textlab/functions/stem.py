"""Stemming of tokens with the Porter (1980) suffix-stripping algorithm, as Column expressions.

The steps are higher-order functions over a text's array of words, one pass of the array for each, so a text is stemmed
inside its row: no Python worker, no shuffle of words, and no table of distinct words whose hot words meet in one task.
A step sees its word through a lambda variable, which keeps the expression's size linear in the steps. The measure
``[C](VC)^m[V]`` of a stem is tested by patterns; ``y`` is a vowel after a consonant, and a consonant otherwise.
:func:`porter_stem` is the same algorithm for one word in plain Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.text import split_words

# The suffix rules of the published algorithm, steps 2, 3 and 4, in its order.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
         ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
         "ate", "iti", "ous", "ive", "ize"]
VOWELS = "aeiou"


def _is_cons(w: str, i: int) -> bool:
    c = w[i]
    if c in VOWELS:
        return False
    if c == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences ``[C](VC)^m[V]``."""
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        cons = _is_cons(stem, i)
        if cons and prev_vowel:
            m += 1
        prev_vowel = not cons
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return (len(w) >= 3 and _is_cons(w, len(w) - 3) and not _is_cons(w, len(w) - 2)
            and _is_cons(w, len(w) - 1) and w[-1] not in "wxy")


def porter_stem(word: str) -> str:
    """Stem one lower-case word; words of one or two letters are returned unchanged."""
    w = word
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # step 2 and 3: the first matching suffix decides
    for rules in (STEP2, STEP3):
        for suf, rep in rules:
            if w.endswith(suf):
                if _measure(w[:-len(suf)]) > 0:
                    w = w[:-len(suf)] + rep
                break
    # step 4
    for suf in STEP4:
        if w.endswith(suf):
            stem = w[:-len(suf)]
            if _measure(stem) > 1 and (suf != "ion" or (stem and stem[-1] in "st")):
                w = stem
            break
    # step 5
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


# patterns over a stem; the letters of its first vowel run, the later runs, and a ``y`` that counts as a consonant
_VOWEL = r"^(?:[aeiou]|[^aeiou][^aeiouy]*[aeiouy])"
_M1 = _VOWEL + r"[aeiou]*[^aeiou]"                                    # measure of at least 1
_M2 = _M1 + r"[^aeiouy]*[aeiouy][aeiou]*[^aeiou]"                     # at least 2
_ONLY1 = _M1 + r"[^aeiouy]*(?:[aeiouy][aeiou]*)?\z"                   # exactly 1
_Y_CONS = r"(?:(?:^|[aeiou])(?:yy)*y|[^aeiouy](?:yy)+)"
_CVC = rf"(?:[^aeiouy]|{_Y_CONS})[aeiouy][^aeiouwxy]\z"


def _without(w: Column, n) -> Column:
    return F.left(w, F.length(w) - n)


def _ending(suffixes: list[str]) -> str:
    return rf"({'|'.join(suffixes)})\z"


def _doubled(w: Column) -> Column:
    """The word ends in two equal consonants, other than l, s and z."""
    last = F.right(w, F.lit(1))
    return ((F.length(w) >= 2) & (last == F.left(F.right(w, F.lit(2)), F.lit(1))) & ~last.isin(*VOWELS, "l", "s", "z")
            & ((last != "y") | w.rlike(_Y_CONS + r"\z")))


def _cut_1b(w: Column) -> Column:
    cut = (F.when(w.endswith("eed"), F.when(_without(w, 3).rlike(_M1), 1).otherwise(0))
           .when(w.endswith("ed") & _without(w, 2).rlike(_VOWEL), 2)
           .when(w.endswith("ing") & _without(w, 3).rlike(_VOWEL), 3).otherwise(0))
    return F.struct(w.alias("w"), cut.alias("cut"))


def _mend_1b(s: Column) -> Column:
    w = s["w"]
    return (F.when(s["cut"] < 2, w).when(w.rlike(r"(?:at|bl|iz)\z"), F.concat(w, F.lit("e"))).when(_doubled(w), _without(w, 1))
            .when(w.rlike(_ONLY1) & w.rlike(_CVC), F.concat(w, F.lit("e"))).otherwise(w))


def _split_at(suffixes: list[str]):
    """Step that splits a word into (stem, suffix); the leftmost match is the longest suffix, which the rules list first."""
    pattern = _ending(suffixes)

    def step(w: Column) -> Column:
        return F.struct(w.alias("w"), F.regexp_extract(w, pattern, 1).alias("end"))
    return step


def _replace(rules: list[tuple[str, str]]):
    def step(s: Column) -> Column:
        new = F.create_map(*[F.lit(x) for rule in rules for x in rule])       # needs a session: not at import
        stem = _without(s["w"], F.length(s["end"]))
        return F.when((s["end"] != "") & stem.rlike(_M1), F.concat(stem, new[s["end"]])).otherwise(s["w"])
    return step


def _drop_4(s: Column) -> Column:
    stem = _without(s["w"], F.length(s["end"]))
    return F.when((s["end"] != "") & stem.rlike(_M2) & ((s["end"] != "ion") | stem.rlike(r"[st]\z")), stem).otherwise(s["w"])


def _drop_e(w: Column) -> Column:
    stem = _without(w, 1)
    return F.when(w.endswith("e") & (stem.rlike(_M2) | stem.rlike(_ONLY1) & ~stem.rlike(_CVC)), stem).otherwise(w)


_STEPS = (
    lambda w: F.regexp_replace(w, r"(ss|i)es\z|(ss)\z|s\z", "$1$2"),
    _cut_1b, lambda s: F.struct(_without(s["w"], s["cut"]).alias("w"), s["cut"].alias("cut")), _mend_1b,
    lambda w: F.regexp_replace(w, rf"(?s)({_VOWEL}.*)y\z", "$1i"),
    _split_at([a for a, _ in STEP2]), _replace(STEP2),
    _split_at([a for a, _ in STEP3]), _replace(STEP3),
    _split_at(STEP4), _drop_4, _drop_e,
    lambda w: F.when(w.endswith("ll") & w.rlike(_M2), _without(w, 1)).otherwise(w),
)


def stem_array(words: Column) -> Column:
    """The stems of an array of lower-case words, in order; words of one or two letters and nulls are left as they are."""
    out = words
    for step in _STEPS:
        out = F.transform(out, step)
    return F.zip_with(words, out, lambda a, b: F.when(F.length(a) <= 2, a).otherwise(b))


def stem_words(words: DataFrame, word_col: str = "word", out_col: str = "stem") -> DataFrame:
    """Stem a column of single words."""
    return words.withColumn(out_col, stem_array(F.array(F.col(word_col)))[0])


def stem_text(df: DataFrame, id_col: str, text_col: str, out_col: str = "stemmed") -> DataFrame:
    """Replace every word of a cleaned text by its stem, keeping word order; null text gives ``''``. ``id_col`` is only
    carried: each row is stemmed by itself."""
    return df.withColumn(out_col, F.coalesce(F.array_join(stem_array(split_words(text_col)), " "), F.lit("")))
