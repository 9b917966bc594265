"""Stems of words by the published Snowball algorithms for English (Porter 2) and German."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the English algorithm.
_EN_EXCEPT = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_STOP_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EN_STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent",
    "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize",
    "ator": "ate", "alli": "al", "bli": "ble",
}
_EN_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_EN_STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first non-vowel that follows a vowel, once and twice."""
    pattern = re.compile(f"[{vowels}][^{vowels}]")
    one = pattern.search(word)
    r1 = one.end() if one else len(word)
    two = pattern.search(word, r1)
    return r1, two.end() if two else len(word)


def _ends_short(w: str) -> bool:
    return re.search(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", w) is not None


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in _EN_EXCEPT:
        return _EN_EXCEPT[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w, "aeiouy")
    lead = re.match("gener|commun|arsen", w)
    if lead:
        r1 = lead.end()
        again = re.compile("[aeiouy][^aeiouy]").search(w, r1)
        r2 = again.end() if again else len(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _EN_STOP_1A:
        return w
    m = re.search("(?:eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    else:
        m = re.search("(?:ingly|edly|ing|ed)$", w)
        if m and re.search("[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif r1 >= len(w) and _ends_short(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for end in sorted([*_EN_STEP_2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1:
                if end == "ogi":
                    w = w[:-1] if w[:at].endswith("l") else w
                elif end == "li":
                    w = w[:at] if at and w[at - 1] in "cdeghkmnrt" else w
                else:
                    w = w[:at] + _EN_STEP_2[end]
            break
    for end in sorted([*_EN_STEP_3, "ative"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if end == "ative":
                w = w[:at] if at >= r2 else w
            elif at >= r1:
                w = w[:at] + _EN_STEP_3[end]
            break
    for end in sorted([*_EN_STEP_4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[:at].endswith(("s", "t"))):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def german(word: str) -> str:
    w = re.sub(r"(?<=[aeiouyäöü])([uy])(?=[aeiouyäöü])", lambda m: m[1].upper(), word.replace("ß", "ss"))
    r1, r2 = _regions(w, "aeiouyäöü")
    r1 = max(r1, 3)
    m = re.search(r"(?:(ern|em|er)|(en|es|e)|(?<=[bdfghklmnrt])s)$", w)
    if m and m.start() >= r1:
        w = w[: m.start()]
        if m[2] and w.endswith("niss"):
            w = w[:-1]
    m = re.search(r"(?:est|en|er|(?<=.{3}[bdfghklmnt])st)$", w)
    if m and m.start() >= r1:
        w = w[: m.start()]
    m = re.search(r"(?:isch|lich|heit|keit|end|ung|ig|ik)$", w)
    if m and m.start() >= r2:
        end, left = m[0], w[: m.start()]
        if end in ("end", "ung"):
            w = left
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif end in ("ig", "ik", "isch"):
            w = w if left.endswith("e") else left
        elif end in ("lich", "heit"):
            w = left
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = left
            for more in ("lich", "ig"):
                if w.endswith(more) and len(w) - len(more) >= r2:
                    w = w[: -len(more)]
                    break
    return w.translate(str.maketrans("UYäöü", "uyaou"))


STEMMERS = {"en": english, "de": german}
#: Three-letter codes and names of languages that have a stemmer.
CODES = {"eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de"}


def stem(lang: str | None, word: str) -> str:
    """The stem of a lower-case word; languages without a stemmer leave it as it is."""
    key = (lang or "").lower()
    f = STEMMERS.get(CODES.get(key, key[:2]))
    return f(word) if f else word


def first_letters(root: str) -> str:
    """What words of that stem may begin with: stems change what follows the first letter, or drop its umlaut."""
    return root[:1] + {"a": "ä", "o": "ö", "u": "ü", "s": "ß"}.get(root[:1], "") + "'"


@F.pandas_udf(T.StringType())
def stem_udf(lang: pd.Series, word: pd.Series) -> pd.Series:
    return pd.Series([stem(x, w) for x, w in zip(lang, word, strict=True)], dtype=object)


stem_udf = stem_udf.asNondeterministic()  # else a filter on stems goes below the distinct words and stems each occurrence


def stemmed(posts: DataFrame) -> DataFrame:
    """Postings with terms replaced by stems. Each distinct (archive, term) is stemmed once and joined back."""
    distinct = posts.select("archive", "term").distinct().withColumn("stem", stem_udf("archive", "term"))
    return posts.join(distinct, ["archive", "term"]).groupBy("archive", F.col("stem").alias("term"), "doc_id").agg(F.sum("wdf").alias("wdf"))
