"""Reading names that people typed, and telling whether two words of names are spellings of one word.

A name is read as a set of words, initials and a legal form. No word has a part of its own: what sets a name apart is
what few names hold, so words are weighed by how many names of the data hold them, and any vocabulary is read alike.
The tables of abbreviations and nicknames below only help: a listed spelling is read as its main word, an unlisted
one is still recognised by :func:`shortens` (a word cut off or without its vowels) and :func:`alike` (a slip).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Abbreviations of company words that no rule derives, each after its main word.
SHORT = """first 1st|holdings hldg hld|foods food|engineering engr|services svc|chemical chems|materials matl|energy enrgy"""
#: Legal forms by the spellings of their words.
LEGAL = """inc incorporated incorp|corp corporation corpn|co company cos|ltd limited|plc|llc|lp|llp|ag|sa|nv|bv|gmbh|kk|oy|ab|as|spa|sarl|pte|se|kgaa|kg|pty"""
#: Words that carry no meaning beside a name.
NOISE = frozenset("the and of new com cl a b de us usa subsidiaries subsidiary affiliates etc shs ord adr sponsored del".split())
HONORIFICS = frozenset("mr mrs ms miss dr prof professor sir dame jr sr ii iii iv phd md mba cpa esq cfa jd dds rn hon rev ba bsc msc pe".split())
#: Nicknames that no rule derives from the given name, each after its given name.
NICKNAMES = """alexander sasha xander|andrew andy drew|anthony tony|charles charlie chuck chas|christopher kit topher|cynthia cindy cyndi|daniel danny|deborah debbie debby|edward eddie ted ned|
elizabeth liz beth betty lizzie betsy|james jim jimmy jamie|jennifer jenny|joseph joe joey|katherine kate katie kathy|margaret maggie meg peggy marge|mateo matt|michael mike mick mickey|nicholas nick nicky|
patricia patty trish tricia|richard rick dick ricky|robert bob bobby robbie bert|samuel sammy|sofia sophie sophia|stephen steve steven|susan sue susie suzie suzy|theodore teddy|thomas tom tommy|
victoria vicky tori vicki|william bill billy willy liam|john jack johnny|david dave davey|benjamin benny|kenneth kenny|ronald ronnie|lawrence larry|peter pete|judith judy|rebecca becky|sandra sandy|
gerald gerry|henry harry hank|leonard len|martin marty|nathaniel nate|randolph randy|abigail abby|amanda mandy|caroline carrie|catherine cathy|dorothy dot|gabriel gabe|anna ann anne|francisco paco pancho|
jose pepe|guadalupe lupe"""


def _table(text: str) -> dict[str, str]:
    """Spelling to main word of each group; the first group that lists a spelling has it."""
    out: dict[str, str] = {}
    for group in text.replace("\n", "").split("|"):
        words = group.split()
        for w in words:
            out.setdefault(w, words[0])
    return out


_SHORT, _LEGAL, _NICK = _table(SHORT), _table(LEGAL), _table(NICKNAMES)


def osa(a: str, b: str, most: int = 3) -> int:
    """Edits with adjacent transpositions (optimal string alignment) between two words; ``most`` + 1 when more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return row[-1]


def deletes(word: str, most: int) -> set[str]:
    """``word`` and every word got by deleting up to ``most`` of its letters."""
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level if len(w) > 2 for i in range(len(w))}
        out = out | level
    return out


def plain(text: str) -> str:
    """Lower case without diacritics; ligatures and full-width forms opened."""
    text = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "o").replace("ł", "l").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def _letters(token: str) -> str:
    """Digits that stand for letters inside a word are read as letters."""
    return token.translate(str.maketrans("0135", "oles")) if re.search("[a-z]", token) and re.search(r"\d", token) and not re.fullmatch(r"\d+(?:st|nd|rd|th)", token) else token


#: Words, initials and legal form that a name says; what is not said is empty.
Said = tuple[tuple[str, ...], tuple[str, ...], str]


@lru_cache(maxsize=200_000)
def read_company(name: str) -> Said:
    """(words, (), legal form) of a company name. Words come sorted and once."""
    text = plain(name)
    text = re.sub(r"/[a-z]{2,3}/?\s*$", " ", text)
    text = re.sub(r"(?:\band|&)\s+(?:subsidiaries|affiliates|co\b\.?)", " ", text)
    text = text.replace("s.a r.l.", " sarl ").replace("s.a.r.l.", " sarl ").replace("kabushiki kaisha", " kk ").replace("&", " and ")
    text = re.sub(r"['’`.]", "", text)
    # letters typed apart ("s a", "n v", "p l c") are one form
    joined: list[str] = []
    for t in re.findall(r"[^\W_]+", text):
        if len(t) == 1 and joined and re.fullmatch(r"[a-z]|s|n|p|l|pl|ll|a|sa", joined[-1]) and joined[-1] + t in ("sa", "nv", "ag", "pl", "plc", "ll", "llc", "bv", "lp"):
            joined[-1] += t
        else:
            joined.append(t)
    words, legal = set(), ""
    for i, t in enumerate(map(_letters, joined)):
        last = i == len(joined) - 1
        if t in _LEGAL and (i or len(joined) == 1):
            legal = legal or _LEGAL[t]
        elif t in _SHORT:
            words.add(_SHORT[t])
        elif t in NOISE or len(t) == 1 and t.isalpha():
            continue
        elif last and words and len(t) >= 3 and (forms := {f for s, f in _LEGAL.items() if s.startswith(t)}):
            legal = legal or min(forms)  # a legal form that was cut off
        else:
            words.add(t)
    return tuple(sorted(words)), (), legal


@lru_cache(maxsize=200_000)
def read_person(name: str) -> Said:
    """(words, initials, '') of a person's name, in whatever order; of three words or more the middle one is an initial."""
    text = re.sub(r'"[^"]*"|“[^”]*”|\([^)]*\)', " ", plain(name))
    text = re.sub(r"\b(?:m\.d|ph\.d)\b\.?", " ", text)
    text = re.sub(r"\b([a-z])\.\s*(?=[a-z]\.)", r"\1 ", text)
    head, _, tail = text.partition(",")
    split = lambda s: [t for t in (_letters(t) for t in re.findall(r"[^\W_]+", re.sub(r"['’`]|(?<=\w)\.(?=\w\.)", "", s))) if t not in HONORIFICS]
    first, last = split(head), split(tail)
    tokens = last + first if any(len(t) > 1 for t in last) or last and len(first) == 1 else first + last
    words, initials = [t for t in tokens if len(t) > 1], [t for t in tokens if len(t) == 1]
    if len(words) > 2:
        initials += [t[0] for t in words[1:-1]]
        words = [words[0], words[-1]]
    return tuple(sorted({_NICK.get(t, t) for t in words})), tuple(sorted(initials)), ""


_CLASS = {**dict.fromkeys("bpfv", "1"), **dict.fromkeys("cgjkqsxz", "2"), **dict.fromkeys("dt", "3"), "l": "4", **dict.fromkeys("mn", "5"), "r": "6"}


@lru_cache(maxsize=200_000)
def phonetic(word: str) -> str:
    """Consonant classes of a word in order, adjacent ones of a class once; vowels, h, w and y are dropped."""
    out, last = "", ""
    for c in word:
        k = _CLASS.get(c, "")
        if k and k != last:
            out += k
        last = k
    return out


@lru_cache(maxsize=500_000)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro–Winkler similarity of two words, prefix scale 0.1 over at most four letters."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    other = [y for y, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(maxsize=500_000)
def alike(a: str, b: str, least: float = 0.88) -> bool:
    """Whether one word may be a slip of the other: one edit (two in words over seven letters) and high Jaro–Winkler.

    Jaro–Winkler must be 0.8 for a single edit in a word of five letters or more, ``least`` otherwise; two neighbouring
    letters turned round are a slip in words of any length.
    """
    short = min(len(a), len(b))
    edits = osa(a, b, 2)
    if edits == 1 and len(a) == len(b) and sorted(a) == sorted(b):
        return short > 2
    return edits <= (2 if short > 7 else 1) and jaro_winkler(a, b) >= (0.8 if edits == 1 and short > 4 else least)


#: Words of more letters meet by segments too; words of more than four letters above it by segments only.
LONG = 16


def segments(word: str, probe: bool) -> set[str]:
    """Five segments of ``word``, or with ``probe`` the places where a word within two edits may have one of its own.

    Two edits, each touching at most two segments, leave one of five segments as it is, moved by at most two letters.
    """
    keys = set()
    for size in range(len(word) - 2, len(word) + 3) if probe else [len(word)]:
        for i in range(5):
            a, b = size * i // 5, size * (i + 1) // 5
            for move in range(-2, 3) if probe else [0]:
                if 0 <= a + move and b + move <= len(word):
                    keys.add(f"{size}:{i}:{word[a + move : b + move]}")
    return keys


def block_keys(word: str) -> set[str]:
    """The blocks that a word meets others in.

    Its phonetic code and the codes with one class left out, where enough classes are left to tell words apart; and, as a
    slip may do anything to the code, the word with up to as many letters left out as :func:`alike` allows edits (long
    words: their segments). So no pair that :func:`alike` accepts is without a common block.
    """
    code = phonetic(word)
    keys = {"=" + x for x in deletes(word, 2 if len(word) > 7 else 1)} if len(word) <= LONG + 4 else set()
    if len(word) > LONG:
        keys |= segments(word, True)
    return keys | {code, *(code[:i] + code[i + 1 :] for i in range(len(code)))} if len(code) > 3 else keys


@lru_cache(maxsize=500_000)
def shortens(a: str, b: str, person: bool = False) -> bool:
    """Whether ``a`` is ``b`` cut off or, in company names, without inner letters: same first and last sound."""
    if len(a) < 2 or len(b) - len(a) < 2 or a[0] != b[0]:
        return False
    if b.startswith(a):
        return True
    if person or a[-1] != b.rstrip("aeiou")[-1:]:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


@lru_cache(maxsize=500_000)
def shortens_nearly(a: str, b: str) -> bool:
    """Whether ``a`` is the beginning of ``b``, cut off, with one slip; five letters or more."""
    return len(a) > 4 and len(b) - len(a) > 1 and any(osa(a, b[:n], 1) <= 1 for n in (len(a) - 1, len(a), len(a) + 1))


def fit(small: Said, large: Said, person: bool, most: int) -> tuple[int, list[str], list[str]] | None:
    """(slips, words and initials of ``small`` that are open, what ``large`` says beside) if ``large`` says all that ``small`` says.

    Every word of ``small`` takes a word of ``large`` for itself: an equal one, else a slip of it (at most ``most`` of
    them), else one that it shortens; an initial takes an initial or a word that it begins. None if one finds nothing.
    """
    if small[2] and small[2] != large[2]:
        return None
    left = list(large[0])
    rest, slips, open_ = [], 0, []
    for w in small[0]:
        if w in left:
            left.remove(w)
        else:
            rest.append(w)
    for w in rest:
        hit = next((x for x in left if alike(w, x)), None) or next((x for x in left if shortens_nearly(w, x)), None) if slips < most else None
        if hit:
            slips += 1
        elif hit := next((x for x in left if shortens(w, x, person)), None):
            open_.append(w)
        else:
            return None
        left.remove(hit)
    letters = list(large[1])
    for c in small[1]:
        if c in letters:
            letters.remove(c)
        elif hit := next((x for x in left if x[0] == c), None):
            left.remove(hit)
            open_.append("m:" + c)
        else:
            return None
    return slips, open_, left + ["m:" + c for c in letters] + (["l:" + large[2]] if large[2] and not small[2] else [])


SAID = "struct<words:array<string>,initials:array<string>,legal:string>"


def parsed(names: DataFrame, name: str, kind: Column) -> DataFrame:
    """``names`` with words, initials and legal form of ``name``; ``kind`` is ``P`` for persons, else a company is read."""

    @F.pandas_udf(SAID)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, kinds in batches:
            rows = [(read_person if k == "P" else read_company)(t or "") for t, k in zip(texts, kinds, strict=True)]
            yield pd.DataFrame({"words": [list(r[0]) for r in rows], "initials": [list(r[1]) for r in rows], "legal": [r[2] for r in rows]})

    return names.withColumn("_p", read(F.col(name), kind)).select("*", "_p.words", "_p.initials", "_p.legal").drop("_p")
