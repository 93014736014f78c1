"""English stems by the published rules of the Snowball English stemmer, as one expression over a word.

The rules are data; `stem_sql` puts them together as text that Spark and other engines read, each intermediate form bound
once by a lambda, so nothing is computed twice and no Python runs. Words with other characters than a to z and ' are their
own stems, so are words of one or two letters.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose stems are given; fixed values.
GIVEN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that stay once a plural s is gone; fixed values.
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Endings and what takes their place, within the first region; fixed values. A dot is a letter that must stand before.
SECOND = (
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
THIRD = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
#: What must stand before some endings; fixed values.
BEFORE = {"ogi": "l", "li": "[cdeghkmnrt]", "ion": "[st]"}
#: English words that searches pass over; fixed values.
STOP_WORDS = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being
    have has had having do does did doing a an the and but if or because as until while of at by for with about against
    between into through during before after above below to from up down in out on off over under again further then once
    here there when where why how all any both each few more most other some such no nor not only own same so than too very
    s t can will just don should now
    """.split()
)

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_SHORT = "[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$"


class Dialect(NamedTuple):
    let: Callable[[str, str, str], str]
    found: Callable[[str, str], str]
    swapped: Callable[[str, str, str], str]


SPARK = Dialect(
    lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)",
    lambda w, p: f"{w} RLIKE '{p}'",
    lambda w, p, r: f"regexp_replace({w}, '{p}', '{r}')",
)
DUCK = Dialect(
    lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]",
    lambda w, p: f"regexp_matches({w}, '{p}')",
    lambda w, p, r: f"regexp_replace({w}, '{p}', '{r.replace('$', chr(92))}', 'g')",
)


def stem_sql(word: str, d: Dialect = SPARK) -> str:
    """The stem of a lower-case word."""

    def cut(w: str, n: int, more: str = "") -> str:
        return f"left({w}, length({w}) - {n})" + (f" || '{more}'" if more else "")

    def endings(w: str, table: tuple[tuple[str, str], ...], region: str, deeper: tuple[str, ...] = ()) -> str:
        """The longest ending that a word has decides, even if it must stay."""
        ways = []
        for end, more in table:
            must = f"length({w}) - {len(end)} >= {'r2' if end in deeper else region}"
            if end in BEFORE:
                must += f" AND {d.found(w, BEFORE[end] + end + '$')}"
            ways.append(f"WHEN endswith({w}, '{end}') THEN CASE WHEN {must} THEN {cut(w, len(end), more)} ELSE {w} END")
        return f"CASE {' '.join(ways)} ELSE {w} END"

    def region(w: str, special: str = "") -> str:
        """Where the part behind the first vowel and consonant begins."""
        return f"CASE WHEN {d.found(w, f'{special}{_VOWEL}{_OTHER}')} THEN length({w}) - length({d.swapped(w, f'^({special}.*?{_VOWEL}{_OTHER})', '')}) ELSE length({w}) END"

    fifth = f"""CASE WHEN endswith(w7, 'e') AND (length(w7) - 1 >= r2 OR length(w7) - 1 >= r1 AND NOT ({d.found(cut('w7', 1), _SHORT)})) THEN {cut('w7', 1)}
        WHEN endswith(w7, 'll') AND length(w7) - 1 >= r2 THEN {cut('w7', 1)} ELSE w7 END"""
    fourth = d.let("w7", endings("w6", tuple((e, "") for e in FOURTH), "r2"), fifth)
    third = d.let("w6", endings("w5", THIRD, "r1", ("ative",)), fourth)
    second = d.let("w5", endings("w4", SECOND, "r1"), third)
    y_to_i = d.let("w4", f"CASE WHEN {d.found('w3', f'.{_OTHER}[yY]$')} THEN {cut('w3', 1, 'i')} ELSE w3 END", second)
    open_ = f"""CASE WHEN {d.found('b', '(at|bl|iz)$')} THEN b || 'e' WHEN {d.found('b', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {cut('b', 1)}
        WHEN length(b) <= r1 AND ({d.found('b', _SHORT)}) THEN b || 'e' ELSE b END"""
    past = d.let("b", d.swapped("w2", "(ingly|edly|ing|ed)$", ""), f"CASE WHEN b <> w2 AND {d.found('b', _VOWEL)} THEN {open_} ELSE w2 END")
    first = f"""CASE WHEN endswith(w2, 'eedly') THEN CASE WHEN length(w2) - 5 >= r1 THEN {cut('w2', 3)} ELSE w2 END
        WHEN endswith(w2, 'eed') THEN CASE WHEN length(w2) - 3 >= r1 THEN {cut('w2', 1)} ELSE w2 END ELSE {past} END"""
    rest = f"CASE WHEN w2 IN ({', '.join(repr(x) for x in KEPT)}) THEN w2 ELSE {d.let('w3', first, y_to_i)} END"
    plural = f"""CASE WHEN endswith(w1, 'sses') THEN {cut('w1', 2)} WHEN {d.found('w1', '(ied|ies)$')} THEN CASE WHEN length(w1) > 4 THEN {cut('w1', 2)} ELSE {cut('w1', 1)} END
        WHEN {d.found('w1', '(us|ss)$')} THEN w1 WHEN {d.found('w1', f'{_VOWEL}.+s$')} THEN {cut('w1', 1)} ELSE w1 END"""
    in_regions = d.let("r2", f"r1 + {region('substring(w1, r1 + 1)')}", d.let("w2", plural, rest))
    special = "CASE " + f"WHEN {d.found('w1', '^(gener|commun|arsen)')} THEN CASE WHEN startswith(w1, 'commun') THEN 6 ELSE 5 END ELSE {region('w1')} END"
    marked = d.let("w1", d.swapped(d.swapped(d.swapped("w0", f"^{chr(39) * 2}|({chr(39) * 2}s{chr(39) * 2}|{chr(39) * 2}s|{chr(39) * 2})$", ""), "^y", "Y"), "([aeiouy])y", "$1Y"), d.let("r1", special, in_regions))
    given = "CASE w0 " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GIVEN.items())
    whole = d.let("w0", word, f"{given} ELSE CASE WHEN length(w0) <= 2 OR NOT ({d.found('w0', f'^[a-z{chr(39) * 2}]+$')}) THEN w0 ELSE lower({marked}) END END")
    return whole if d is SPARK else whole.replace("endswith(", "ends_with(").replace("startswith(", "starts_with(")


def stem(word: str) -> Column:
    """The stem of a lower-case word, given as SQL text (a column's name, or a lambda's variable)."""
    return F.expr(stem_sql(word))
