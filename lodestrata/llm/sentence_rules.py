"""Segmentation rules: ordered (marks, before, after, break?) per language.

``before`` has to match up to the position, ``after`` from it on.  The first rule
that matches decides.  A text is cut by the table of its own language, then the
tables of the other languages (texts are mixed, languages missing or wrong), then
the common table.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex

BREAK, JOIN = True, False

#: Marks that may end a sentence, marks that close one.
FULL_STOP = "."
WIDE_MARKS = "。！？｡．।॥؟۔"
MARKS = ".!?…" + WIDE_MARKS
CLOSING = "”’\"'»)\\]}）】」』〉》›"
OPENING = "“‘„\"'«(\\[{（【「『〈《‹¿¡"


@dataclass(frozen=True)
class Quotation:
    """Opening and closing marks; ``whole``: no closing mark lies between them."""

    opening: str
    closing: str
    whole: bool


@dataclass(frozen=True)
class Rule:
    marks: str  # last mark of the run, any of these
    before: str
    after: str
    verdict: bool
    opened: Quotation | None = None  # the sentence opens with a quotation that ends here


def _words(words: str) -> str:
    """A full stop after one of these words, not inside a longer one."""
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(regex.escape(w) for w in words.split())})\."


#: white space with at most a symbol in it, as emoji are strewn into texts
_GAP = r"\s+(?:\p{So}\s+)?"
_ANY, _SPACE, _LOWER = r"", r"\s", _GAP + r"\p{Ll}"

#: Abbreviations, month and unit names of each language.
LANGUAGES: dict[str, list[Rule]] = {
    "en": [
        Rule(FULL_STOP, _words("Mr Mrs Ms Messrs Dr Prof Rev Hon Gen Col Capt Sgt Gov Sen Rep St approx vs viz cf e.g i.e incl est resp al"), _SPACE, JOIN),
        Rule(FULL_STOP, _words("No Nos Fig Figs Vol Sec Ch Eq Tab Art App pp"), _GAP + r"[\d(]", JOIN),
        Rule(FULL_STOP, _words("Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"), _GAP + r"\d", JOIN),
        Rule(FULL_STOP, _words("Inc Ltd Corp Co Cos Bros plc etc a.m p.m S.A") + r"[)\]]?", _GAP + r"[\p{Ll}(&]|[^\s\p{Lu}“\"«„]", JOIN),
        Rule(FULL_STOP, _words("U.S U.K U.N E.U"), r"\s", JOIN),
    ],
    "de": [
        Rule(FULL_STOP, _words("Fa Mio Mrd Tsd Abb vgl Vgl bzw ca Nr Str Dr Prof Hr Fr Lt Tab Kap Bd evtl ggf inkl exkl zzgl bspw sog einschl Aufl"), _SPACE, JOIN),
        Rule(FULL_STOP, _words("usw etc"), _LOWER, JOIN),
        Rule(
            FULL_STOP,
            r"(?<![\d.,])\d{1,2}\.",
            _GAP + r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartal|Halbjahr|Jahrhundert|Geschäftsjahr)",
            JOIN,
        ),
    ],
    "fr": [
        Rule(FULL_STOP, _words("MM Mme Mmes Mlle art env cf av apr pp chap fig vol éd boul tél"), _SPACE, JOIN),
        Rule(FULL_STOP, _words("etc"), _LOWER, JOIN),
    ],
    "es": [
        Rule(FULL_STOP, _words("Sra Sr Sres Sras Srta Dra Dr Dña pág págs núm núms aprox art cap fig vol Ud Uds Vd EE UU Av Avda tel ej"), _SPACE, JOIN),
    ],
    "ru": [
        Rule(FULL_STOP, _words("долл"), _GAP + "США", JOIN),
        Rule(FULL_STOP, _words("рис см табл стр им ул проф акад кв гл"), _SPACE, JOIN),
        Rule(FULL_STOP, _words("руб коп долл тыс млн млрд трлн обл др пр"), _GAP + r"[\p{Ll}\d]", JOIN),
    ],
    "hi": [Rule(FULL_STOP, _words("डॉ श्री प्रो रु मि पं"), _SPACE, JOIN)],
    "ar": [],
    "zh": [
        # a quotation from the sentence's start, after which the speaker is named
        Rule("。！？．!?…", _ANY, r"\s?[^。！？．\n“”「『]{0,24}[说道问称答][，,。：:]", JOIN, Quotation("“「『\"", "”」』\"", True)),
    ],
    "ja": [Rule("。！？．!?", r"[」』”]", r"\s?(?:と|って|との)", JOIN)],
    "th": [],
}

COMMON: list[Rule] = [
    Rule(".．", r"\d[.．]", r"\d", JOIN),
    # initials and one-letter abbreviations, also in a row
    Rule(FULL_STOP, r"(?<![\p{L}\p{M}\p{N}’'])(?:[\p{Latin}\p{Cyrillic}\p{Arabic}]\.)*[\p{Latin}\p{Cyrillic}\p{Arabic}]\.", r"\s", JOIN),
    # an omission in the middle of a sentence
    Rule(".…", r"(?:\.\.\.|…)", _LOWER + r"|\p{Ll}|[^\s\p{Lu}“\"«¿¡]", JOIN),
    # a quoted question whose sentence goes on; a quoted statement does so only if it opens the sentence
    Rule("?!？！", rf"[{CLOSING}]", r"\s*\p{Ll}", JOIN),
    Rule(FULL_STOP, _ANY, r"\s*\p{Ll}", JOIN, Quotation("“\"«„", "”\"»“", False)),
    Rule(".!?", r"[)\]]", r"\s*\p{Ll}", JOIN),
    Rule(WIDE_MARKS, _ANY, _ANY, BREAK),
    Rule(".!?…", _ANY, r"\s|\Z", BREAK),
    # the blank is missing
    Rule("!?", _ANY, r"[\p{L}\p{N}“\"«„¿¡]", BREAK),
    Rule(FULL_STOP, r"[\p{Ll}\p{N}%)€”»\p{Lo}\p{M}٪]\.[”»\"]?", r"\p{Lu}(?![\p{Lu}\p{N}])|[“«„¿¡]", BREAK),
    Rule(FULL_STOP, r"(?:\p{Ll}{2}|[%)])\.[”»\"]?", r"[\p{Han}\p{Hiragana}\p{Katakana}]", BREAK),
    Rule(MARKS, _ANY, _ANY, JOIN),
]


@dataclass(frozen=True)
class Compiled:
    before: regex.Pattern | None
    opened: Quotation | None
    after: regex.Pattern | None
    verdict: bool


def _compile(rule: Rule) -> Compiled:
    # (?r): matched backwards from the position, so that nothing before it has to be searched
    before = regex.compile("(?r)" + rule.before, regex.S) if rule.before else None
    return Compiled(before, rule.opened, regex.compile(rule.after) if rule.after else None, rule.verdict)


@dataclass(frozen=True)
class Group:
    """Neighbouring rules; ``gate`` matches before a position if any of theirs does (None: try them anyway)."""

    gate: regex.Pattern | None
    rules: list[Compiled]


def cascade(language: str | None) -> dict[str, list[Group]]:
    """Mark -> rules in order, for a language code in any notation."""
    own = (language or "").strip().lower()[:2]
    order = [own] * (own in LANGUAGES) + [x for x in LANGUAGES if x != own]
    table = [r for x in order for r in LANGUAGES[x]] + COMMON
    compiled = {id(r): _compile(r) for r in table}
    out: dict[str, list[Group]] = {}
    for mark in MARKS:
        groups: list[tuple[bool, list[Rule]]] = []
        for rule in table:
            if mark in rule.marks:
                gated = bool(rule.before)
                if not groups or groups[-1][0] != gated:
                    groups.append((gated, []))
                groups[-1][1].append(rule)
        out[mark] = [
            Group(regex.compile("(?r)(?:" + "|".join(f"(?:{r.before})" for r in rules) + ")", regex.S) if gated and len(rules) > 1 else None, [compiled[id(r)] for r in rules])
            for gated, rules in groups
        ]
    return out
