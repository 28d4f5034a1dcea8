"""Names of persons and organisations as typed, reduced to comparable forms.

A form has a kind, a class (the line of business, which tells sister firms apart)
and a core (what is proper to the name).  Forms that keep too little of the name
to be compared on their own are weak.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import permutations

#: Short forms of given names.
NICKNAMES = {
    "katherine": "kathy kate katie kat", "elizabeth": "betty liz lizzie beth eliza", "charles": "chuck charlie", "susan": "sue susie",
    "robert": "bob rob bobby robbie", "edward": "eddie ned ed", "gabriele": "gabi", "jennifer": "jenny jen", "benjamin": "ben benny",
    "frederick": "fred freddie", "richard": "dick rick rich ricky", "margaret": "maggie peggy meg", "deborah": "debbie deb",
    "victoria": "vicky vic", "nikolai": "kolya", "alexander": "sasha alex", "samuel": "sam sammy", "anthony": "tony",
    "michael": "mike mick", "william": "will bill billy", "thomas": "tom tommy", "patricia": "patsy trish pat", "james": "jim jimmy",
    "johannes": "hans", "theodore": "ted teddy", "francisco": "paco pancho", "joseph": "joe", "daniel": "dan danny", "matthew": "matt",
    "andrew": "andy drew", "christopher": "chris", "nicholas": "nick", "david": "dave", "stephen": "steve", "gregory": "greg",
    "timothy": "tim", "lawrence": "larry", "rebecca": "becky", "barbara": "barb", "catherine": "cathy",
}
HONORIFICS = set("dr prof mr mrs ms miss sir dame herr frau".split())

#: Words that name a line of business or a sort of institution, with their short forms.
CLASSES = {
    "oil-gas": "oilgas oil gas og", "electronics": "electronics elec electr electronic", "food": "foods beverages bev food beverage fb foodbev",
    "resources": "resources res resource", "chemicals": "chemicals chem chemical", "engineering": "engineering eng engrg engr",
    "pharma": "pharmaceuticals pharma pharm pharmaceutical", "manufacturing": "manufacturing mfg manuf", "insurance": "insurance ins insur",
    "technology": "technologies tech technol technology", "international": "international intl", "brothers": "brothers bros",
    "mining": "mining mng", "airlines": "airlines air airline lines", "shipping": "shipping shpg", "laboratories": "laboratories labs lab laboratory",
    "exchange": "stock stocks exchange exch", "central-bank": "central bank bk cb", "securities": "securities sec commission comm",
    "university": "university univ", "institute": "institute inst market mkt research",
}
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "plc": "plc", "ag": "ag", "corp": "corp", "corporation": "corp", "inc": "inc", "incorporated": "inc",
    "llc": "llc", "gmbh": "gmbh", "sa": "sa", "nv": "nv", "co": "co", "company": "co", "holding": "", "holdings": "", "group": "",
    "aktiengesellschaft": "ag", "oyj": "oyj", "asa": "asa", "spa": "spa", "srl": "srl", "sarl": "sarl", "bv": "bv", "pte": "", "pty": "", "llp": "llp",
    "sas": "sas", "ooo": "ooo", "oao": "oao", "pao": "pao", "jsc": "jsc", "kk": "kk", "kg": "kg", "bhd": "bhd", "sdn": "",
}
FILLERS = set("the of for and f de".split())
#: Chinese lines of business, legal endings, and traditional signs with their simple ones.
ZH_CLASSES = "精密制造 食品 化工 能源 科技 医药 矿业 电子 保险 航运 银行 证券 物流 重工 航材 制造 地产 汽车 传媒".split()
ZH_LEGAL = re.compile(r"(集团)?(股份|有限责任|有限)*(公司)?$")
SIMPLE = str.maketrans("團業電醫藥運險製責責學國際銀證車產東礦貿機",
                       "团业电医药运险制责责学国际银证车产东矿贸机")

_CLASS_OF = {w: c for c, words in CLASSES.items() for w in words.split()}
_GIVEN = {n: g for g, names in NICKNAMES.items() for n in [g, *names.split()]}
_HAN = re.compile(r"[㐀-鿿]")
_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")


@dataclass(frozen=True)
class Form:
    kind: str  # "o" organisation, "p" person, "P" all words of a person, to be met in another order
    cls: str
    core: str
    legal: str = ""
    weak: bool = False
    #: the core with its words in other orders
    orders: tuple[str, ...] = field(default=(), compare=False)


def orders(words: list[str]) -> tuple[str, ...]:
    """The words joined in other orders: every order of up to four words, of more the rotations, the sorted order and those with one word moved."""
    n = len(words)
    if n < 2:
        return ()
    if n <= 4:
        ways = permutations(words)
    else:
        moved = [words[:i] + words[i + 1 :] for i in range(n)]
        ways = [words[i:] + words[:i] for i in range(n)] + [sorted(words), words[::-1]] + [m[:j] + [words[i]] + m[j:] for i, m in enumerate(moved) for j in range(n)]
    own = "".join(words)
    return tuple(sorted({"".join(w) for w in ways} - {own}))


def simple_signs(spark) -> dict[int, str]:
    """Traditional signs with their simple ones, by the rules of the ICU library that Spark carries; without it a short fixed list."""
    try:
        rules = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
        signs = [chr(c) for c in range(0x3400, 0xA000)]
        plain = rules.transliterate("\n".join(signs)).split("\n")
        return SIMPLE | {ord(a): b for a, b in zip(signs, plain, strict=True) if a != b and len(b) == 1}
    except Exception:  # another Spark without that library
        return dict(SIMPLE)


def osa(a: str, b: str, most: int) -> int:
    """Edits from ``a`` to ``b``, neighbours swapped counting as one; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return row[-1]


@lru_cache(maxsize=100_000)
def _near_word(token: str, table: str) -> str | None:
    """The only word of a fixed table within one edit of a token that is not in it."""
    words = _GIVEN if table == "given" else _CLASS_OF
    least = 4 if table == "given" else 6
    if len(token) < least:
        return None
    found = {words[w] for w in words if len(w) >= least and osa(token, w, 1) <= 1}
    return found.pop() if len(found) == 1 else None


def fold(name: str) -> str:
    """Compatible, caseless, without accents and invisible signs, single blanks."""
    plain = unicodedata.normalize("NFKD", _INVISIBLE.sub("", name)).casefold()
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).split())


def person_form(name: str) -> Form | None:
    s = fold(name)
    quoted = '"' in s or "“" in s
    s = re.sub(r"[\"“”'’\-]", "", s)
    head, comma, tail = s.partition(",")
    split = lambda x: [t for t in re.split(r"[\s.]+", x) if t and t not in HONORIFICS]
    first, last = (split(tail), split(head)) if comma else (split(head), [])
    if not comma and first:
        raw = first
        if len(raw) > 1 and len(raw[-1]) <= 2 and len(raw[0]) > 2 and not any(len(t) > 2 for t in raw[1:]):
            first, last = list("".join(raw[1:])), [raw[0]]  # surname and initials
        else:
            first, last = raw[:-1], raw[-1:]
    surname = "".join(last)
    words, initials = [t for t in first if len(t) > 1], [t for t in first if len(t) == 1]
    if not surname or not first:
        return None
    if not comma and words and surname in _GIVEN and words[0] not in _GIVEN and not quoted:
        surname, words = words[0], [surname, *words[1:]]
    if not words:
        return Form("p", "", f"{initials[0]} {surname}", "".join(initials[1:2]), True)
    given = _GIVEN.get(words[0]) or _near_word(words[0], "given") or words[0]
    return Form("p", "", f"{given} {surname}", "".join(initials[:1]), quoted or len(surname) < 2)


def person_words(name: str) -> Form | None:
    """All words of a person's name, given names in their long form; None for names with a quotation or one word only.

    Names all of whose words are given names keep their order, as it tells which is the surname.
    """
    s = fold(name)
    if re.search(r"[\"“”]", s):
        return None
    head, comma, tail = re.sub(r"['’\-]", "", s).partition(",")
    words = [t for t in re.split(r"[\s.]+", f"{tail} {head}" if comma else head) if len(t) > 1 and t not in HONORIFICS]
    if len(words) < 2:
        return None
    whole = [_GIVEN.get(w, w) for w in words]
    return Form("P", "", "".join(whole), orders=() if all(w in _GIVEN for w in words) else orders(whole))


def chinese_form(s: str, simple: Mapping[int, str] = SIMPLE) -> Form | None:
    s = re.sub(r"\s+", "", s).translate(simple)
    share = "(股份)" in s
    s = re.sub(r"\([^)]*\)", "", s)
    end = ZH_LEGAL.search(s)
    ending, s = end.group(), s[: end.start()]
    legal = "股份" if share or "股份" in ending else "集团" if "集团" in ending else "有限" if "有限" in ending else ""
    for word in ZH_CLASSES:
        if s.endswith(word) and len(s) > len(word):
            return Form("o", word, s[: -len(word)], legal)
        if s.startswith(word) and len(s) > len(word):
            return Form("o", word, s[len(word) :], legal)
    return Form("o", "", s, legal, True) if s else None


def organisation_form(name: str, simple: Mapping[int, str] = SIMPLE) -> Form | None:
    s = fold(name)
    if _HAN.search(s):
        return chinese_form(s, simple)
    s = re.sub(r"['’\"]", "", s)
    s = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m.group().replace(".", "") + " ", s)
    s = re.sub(r"\boil\s*(?:and|&)\s*gas\b|\bo\s*&\s*g\b", " oilgas ", s)
    s = re.sub(r"\bf\s*&\s*b\b", " foodbev ", s.replace("-", ""))
    classes, legal, rest, brief = set(), set(), [], False
    for t in re.split(r"[^\w]+", s):
        if not t or t in FILLERS:
            continue
        if t in LEGAL:
            legal.add(LEGAL[t])
        elif t in _CLASS_OF or (known := _near_word(t, "class")):
            classes.add(_CLASS_OF.get(t) or known)
        elif len(t) == 1:
            brief = True
        else:
            rest.append(t)
    core = "".join(rest)
    if not core:
        return None
    if legal == {"co"}:
        legal = set()
    return Form("o", "+".join(sorted(classes)), core, "+".join(sorted(legal - {""})), brief or not classes, orders(rest))


def forms(name: str | None, aliases: list[str | None] | None, node_type: str | None, simple: Mapping[int, str] = SIMPLE) -> list[Form]:
    """Distinct forms of a record; weak ones only if it has no other."""
    found: dict[Form, None] = {}
    words: dict[Form, None] = {}
    for text in [name, *(aliases or [])]:
        if text and text.strip():
            person = node_type == "person" and not _HAN.search(text)
            form = person_form(text) if person else organisation_form(text, simple)
            if form:
                found[form] = None
            if person and form and not form.weak and (whole := person_words(text)):
                words[whole] = None
    strong = [f for f in found if not f.weak]
    return [*(strong or found), *words]


def clean_ticker(ticker: str | None) -> str | None:
    """A ticker without blanks, case and exchange suffix; placeholders are none."""
    plain = (ticker or "").strip().upper().split(".")[0]
    return plain if len(plain) >= 4 and plain.isalnum() and any(c.isdigit() or c.isalpha() for c in plain) else None
