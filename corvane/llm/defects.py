"""Defective answers: noisy labelling functions for each defect, combined by an expectation-maximisation label model."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .langid import LANGUAGES, Model, Tagger
from .lookalike import INVISIBLE, mapper, table_form
from .overlap import WORD, like, written_words

DEFECTS = ("empty", "refusal", "copy", "other_language", "truncated")
# Refusals of the usual kinds; they are planted to measure the labelling functions and to choose cutoffs.
REFUSALS = (
    "متأسفانه نمی‌توانم به این پرسش پاسخ بدهم.", "ببخشید، در این باره اطلاعات کافی ندارم.", "من اجازه ندارم در این مورد چیزی بنویسم.", "از ارائۀ پاسخ به این درخواست معذورم.",
    "پاسخ به این سؤال از توان من بیرون است.", "این کار از من ساخته نیست، لطفاً از معلم خود بپرسید.", "به عنوان یک دستیار نمی‌توانم در این کار کمک کنم.", "I'm sorry, but I can't help with this question.",
    "I cannot answer this request.", "As an AI, I am unable to answer that question.",
)
# Answers that hold nothing.
BLANKS = (None, "", "   ", "\u200b", "...", "-", "null", "N/A", "(بدون پاسخ)", "\u200c ـ")

# Fixed values, in the folded spelling of ``fold``: words and phrases the labelling functions look for.
PLACEHOLDERS = {"null", "none", "nil", "nan", "na", "n a", "empty", "todo", "tbd", "undefined", "no answer", "no response", "بدون پاسخ", "بی پاسخ", "پاسخی ندارد", "خالی", "ندارد", "هیچ", "بدون جواب", "پاسخ", "جواب", "answer", "response"}
OPENINGS = ("متاسفانه", "متاسفم", "ببخشید", "با عرض پوزش", "پوزش می", "شرمنده", "راستش", "با احترام", "به عنوان یک", "خیلی دوست داشتم", "پرسش جالبی", "سوال جالبی", "همانطور که میدانید", "معذرت", "عذر می", "sorry", "i m sorry", "i am sorry", "unfortunately", "i apologi", "as an ai", "as a language model", "désolé", "je suis désolé", "üzgünüm", "معاف کیجیے", "معذرت", "عذرا", "اسف")
REDIRECTS = ("در خدمتم", "از اموزگار خود", "از معلم خود", "به کتاب درسی مراجعه", "پرسش دیگری مطرح", "سوال دیگری", "به شخص دیگری", "موضوع دیگری", "ask your teacher", "another question", "something else")
NEGATIVE_SELF = re.compile(r"\b(?:نمی\s?[آ-ی]+م|ندارم|نیستم|نشوم|نتوانم|نباشم|نکنم|نخواهم|معذورم|متاسفم|شرمندهام)\b|\bi (?:can ?not|can ?t|won ?t|will not|am unable|m unable|am not able|do not|don ?t|must decline|decline)\b|\bje ne (?:peux|puis|suis)\b|\byapamam\b|\bلا (?:استطیع|یمکننی)\b|نهیں دے سکتا")
META = re.compile(r"پرسش|سوال|درخواست|پاسخ|جواب|تکلیف|بحث|سیاست|دسترسی|اطلاعات کافی|کمک|این کار|این مورد|این باره|\brequest\b|\bquestion\b|\banswer\b|\bhelp\b|\bpolicy\b|\bassist")
DENIAL = re.compile(r"\bنمی\s?[آ-ی]{2,}|\bندار|\bنیست|\bنشو|\bمعذور|\bبیرون است|\bخارج از|\bسکوت|\bبسپار|\bcan ?not\b|\bcan t\b|\bunable\b|\bwon ?t\b")
SELF = re.compile(r"\bمن\b|\bدستم\b|\bن?می\s?[آ-ی]{2,}م\b|\bاین (?:پرسش|سوال|درخواست|پاسخ|جواب|کار|بحث|مورد|باره)\b|\bi\b|\bmy\b|\bthis (?:question|request)\b")
CONNECTIVES = frozenset(
    "و که از به در با را بر برای تا چون اگر زیرا این آن یا هر نه اما ولی بلکه چنان مانند همان یک بین میان سپس وقتی کنار هم نیز پیش "
    "and or the a an of to in on at for with by from that which who when because if is are was were as but than every between "
    "ve ile için bir bu da de ki ama eğer her gibi kadar çünkü "
    "et ou le la les un une des du de à en dans que qui pour sur avec si mais parce comme est chaque "
    "في من على إلى عن أن التي الذي هذا هذه أو ثم كل إن قد لأن "
    "اور کے کی کا میں سے کو نے پر جو کہ اگر جب تو ہر ایک یہ وہ".split()
)
NEGATORS = frozenset(("نه",))
QUOTED = re.compile(r"«[^»]*»|“[^”]*”|\"[^\"]*\"|\([^)]*\)")
ENDED = re.compile(r"[.!?؟۔…»”\"]$|[^(\d۰-۹٠-٩\s]\)$")
LIST_MARK = re.compile(r"(?:^|[\s.])(?:\(?[\d۰-۹٠-٩]+[).\-–]?|[-*•])$")
TAIL_BLANKS = INVISIBLE + " \t\r\n          　‌‍"


_hamza = mapper(str.maketrans({"أ": "ا", "إ": "ا", "ؤ": "و", "آ": "آ", "ئ": "ی"}))


class _Folded(dict):
    """The folded words of a token between blanks, remembered for at most ``room`` tokens."""

    room = 200_000

    def __missing__(self, token: str) -> str:
        words = " ".join(WORD.findall(_hamza(like(table_form(token))).lower().replace("_", " ")))
        if self.room > 0 and len(token) < 100:
            self.room -= 1
            self[token] = words
        return words


_FOLDED = _Folded()


def fold(text: str) -> str:
    """Lower case, look-alikes in one form, half-spaces and marks dropped, punctuation as single spaces."""
    return " ".join(filter(None, map(_FOLDED.__getitem__, text.split())))


#: Labelling functions of each defect in their order in a vote pattern, with a first guess of what they say of a defective
#: answer: the share of votes for the defect and the share of votes against it. Rates on planted defects replace it.
FUNCTIONS: dict[str, list[tuple[str, float, float]]] = {
    "empty": [("no_letters", 0.75, 0.25), ("placeholder", 0.24, 0.01), ("few_letters", 0.8, 0.02)],
    "refusal": [("opening", 0.7, 0.0), ("negative_self", 0.6, 0.2), ("meta_denial", 0.85, 0.15), ("redirect", 0.5, 0.0), ("reported", 0.0, 0.02)],
    "copy": [("same_words", 0.85, 0.15), ("contained", 0.85, 0.15), ("nothing_new", 0.85, 0.15), ("in_order", 0.85, 0.05)],
    "other_language": [("model", 0.93, 0.07), ("script", 0.5, 0.0), ("frequent_words", 0.8, 0.05), ("no_shared_words", 0.7, 0.05)],
    "truncated": [("ending", 0.25, 0.02), ("open_mark", 0.3, 0.0), ("dangling", 0.4, 0.0), ("unknown_word", 0.3, 0.45), ("never_last", 0.4, 0.15), ("never_before_last", 0.35, 0.15)],
}
GATES = {"ending"}
LANGUAGE_MODEL = Model({})


def _frequent() -> dict[str, set[str]]:
    from .langid import SEEDS

    return {lang: {fold(w) for w in SEEDS[lang].split()} for lang in LANGUAGES}


FREQUENT = _frequent()
_IN_ORDER = {lang: sorted(words) for lang, words in FREQUENT.items()}


_LATIN = re.compile("[a-zçğışöüéèêàâîôûœ]+")
_BASIC = re.compile("[a-z]+")
_MARKS = re.compile("[«»“”\"()\\[\\]]")
_NUMBERED = re.compile(r"(?:^|[\s.])[\d۰-۹٠-٩a-zA-Zآ-ی]{1,2}\)")
NEGATED, ASKED, DENIED, MINE = 1, 2, 4, 8


class _Hints(dict):
    """Which of the refusal patterns a folded word may begin, remembered for at most ``room`` words; a text whose words
    hint at none of a pattern's beginnings can't match it."""

    room = 200_000
    _rules = (
        (NEGATED, re.compile(r"نمی(?:[آ-ی]+م)?|ندارم|نیستم|نشوم|نتوانم|نباشم|نکنم|نخواهم|معذورم|متاسفم|شرمندهام|i|je|yapamam|لا|نہیں|نهیں")),
        (ASKED, re.compile(r".*(?:پرسش|سوال|درخواست|پاسخ|جواب|تکلیف|بحث|سیاست|دسترسی|اطلاعات|کمک|این).*|request|question|answer|help|policy|assist.*")),
        (DENIED, re.compile(r"(?:نمی|ندار|نیست|نشو|معذور|سکوت|بسپار).*|.*(?:بیرون|خارج).*|can|cannot|unable|won")),
        (MINE, re.compile(r"من|دستم|ن?می(?:[آ-ی]{2,}م)?|این|i|my|this")),
    )

    def __missing__(self, word: str) -> int:
        bits = sum(bit for bit, rule in self._rules if rule.fullmatch(word))
        if self.room > 0:
            self.room -= 1
            self[word] = bits
        return bits


_HINTS = _Hints()


def _languages_of() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, words in FREQUENT.items():
        for w in words:
            out.setdefault(w, []).append(lang)
    return out


_FREQUENT_IN = _languages_of()


class _Tokens(dict):
    """What is read of a token between blanks, remembered for at most ``room`` tokens: its folded words, its plain words,
    its letters in lower case ('' without any), whether it ends a sentence, and how it looks."""

    room = 200_000

    def __missing__(self, token: str) -> tuple[str, tuple[str, ...], str, bool, str]:
        word = "".join(c for c in token if c == "\u200c" or unicodedata.category(c)[0] in "LM").lower()
        ends = token.rstrip(INVISIBLE + "\u200c\u200d")[-1:] in tuple(".!?؟۔…")
        found = (fold(token), tuple(written_words(token)), word if any(map(str.isalpha, word)) else "", ends, table_form(token))
        if self.room > 0 and len(token) < 100:
            self.room -= 1
            self[token] = found
        return found


_READ = _Tokens()


def read_tokens(text: str) -> list[tuple[str, tuple[str, ...], str, bool, str]]:
    return list(map(_READ.__getitem__, text.split()))


def _folded(tokens: list[tuple]) -> str:
    return " ".join([t[0] for t in tokens if t[0]])


def _sign(*v: int) -> str:
    return "".join("0+-"[x] for x in v)


def _is_nothing(f: str) -> bool:
    return not f or f in PLACEHOLDERS


def _empty_votes(f: str) -> str:
    letters, nothing = len(f) - f.count(" "), _is_nothing(f)
    return _sign(1 if letters == 0 else -1, 1 if nothing and letters else (0 if letters == 0 else -1), 1 if letters < 3 else (0 if nothing else -1))


def _refusal_votes(a: str, f: str) -> str:
    if _is_nothing(f):
        return "-----"
    told = fold(QUOTED.sub(" ", a)) if _MARKS.search(a) else f
    hints = 0
    for w in told.split():
        hints |= _HINTS[w]
    neg = bool(hints & NEGATED) and bool(NEGATIVE_SELF.search(told))
    meta = hints & (ASKED | DENIED) == ASKED | DENIED and bool(META.search(told)) and bool(DENIAL.search(told)) and (neg or (bool(hints & MINE) and bool(SELF.search(told))))
    reported = not neg and ("معذور بود" in f or "پوزش میخواهد" in f or (told is not f and NEGATIVE_SELF.search(f) is not None))
    return _sign(int(told.startswith(OPENINGS)), 1 if neg else -1, 1 if meta else -1, int(any(p in told for p in REDIRECTS)), -int(reported))


def _copy_votes(asked: list[tuple], f: str, qw: set[str], aw: set[str]) -> str:
    if _is_nothing(f):
        return "----"
    common, new = len(qw & aw), len(aw - qw)
    cover = common / len(qw) if qw else 0.0
    same = 1 if qw and common >= 0.7 * len(qw | aw) else -1
    inside = 1 if qw and new <= max(2, 0.1 * len(aw)) and common >= 0.5 * len(qw) else -1
    order = -1
    if new < 5:
        q_list, words = _folded(asked).split(), f.split()
        grams = set(zip(words, words[1:]))
        share = len(set(zip(q_list, q_list[1:])) & grams) / max(1, len(grams))
        order = -1 if share < 0.4 else int(share >= 0.7)
    return _sign(same, 1 if cover >= 0.8 and new < 5 else -1, inside, order)


def _language_votes(asked: list[tuple], f: str, qw: set[str], aw: set[str], ql: int | None, al: int | None, langs: set) -> str:
    """``ql`` and ``al`` are the main languages of query and answer, ``langs`` all languages of the answer."""
    if _is_nothing(f):
        return "----"
    words, letters = f.split(), len(f) - f.count(" ")
    if ql is None or al is None or letters < 8:
        return "-000"
    common = len(qw & aw)
    latin = (letters - sum(map(len, _LATIN.sub("", f).split()))) / letters
    fq = _folded(asked)
    q_letters = len(fq) - fq.count(" ") or 1
    q_latin = (q_letters - sum(map(len, _BASIC.sub("", fq).split()))) / q_letters
    hits = dict.fromkeys(FREQUENT, 0)
    for w in words:
        for g in _FREQUENT_IN.get(w, ()):
            hits[g] += 1
    best, mine = max(hits.values()), hits[LANGUAGES[ql]]
    return _sign(
        1 if al != ql and ql not in langs else -1,
        int((latin > 0.95 and q_latin < 0.3) or (latin < 0.05 and q_latin > 0.7)),
        1 if best >= 2 and mine * 2 <= best and mine <= 0.12 * len(words) else (-1 if mine >= max(1, best - 1) else 0),
        -1 if common >= 3 and common >= 0.2 * len(aw) else int(common == 0 and len(aw) >= 5),
    )


def _ending_votes(a: str, f: str, read: list[tuple]) -> tuple[str, str]:
    """The first three votes of ``truncated``, and ``ends``."""
    if _is_nothing(f):
        return "---", "empty"
    words = f.split()
    end = " ".join([t[4] for t in read]).strip(TAIL_BLANKS)
    mark = LIST_MARK.search(end[-20:]) is not None and len(words) > 2
    ended = ENDED.search(end[-2:]) is not None and not mark
    stop = -1 if ended else int(end[-1:] in "،,;؛:-–—(«[{/")
    opened = _MARKS.search(a) is not None and (end.count("«") > end.count("»") or _NUMBERED.sub(" ", end).count("(") > end.count(")") or end.count("[") > end.count("]") or end.count("“") > end.count("”"))
    dangling = mark or stop > 0 or (not ended and words[-1] in CONNECTIVES) or (ended and opened)
    contrast = stop == 0 and len(words) > 2 and words[-2] in NEGATORS and words[-3] not in CONNECTIVES
    return _sign(stop, int(opened), int(dangling)), "closed" if ended or mark else "contrast" if contrast else "open"


def _word_set(tokens: list[tuple]) -> set[str]:
    return {w for t in tokens for w in t[1]}


def _tagged(answer: list, tagger: Tagger) -> tuple[list, list[set]]:
    """The main language of each answer, and all its languages."""
    runs, main = tagger.segments(answer)
    langs: list[set] = [set() for _ in answer]
    for d, lang in zip(runs[0].tolist(), runs[3].tolist()):
        langs[d].add(lang)
    return main, langs


def votes(query: list, answer: list, tagger: Tagger, read: list[list[tuple]], q_main: list) -> dict[str, list[str]]:
    """For each defect a pattern of votes per row, a character a labelling function: + for the defect, - against it, 0 no
    opinion. ``read`` holds the tokens of the answers, ``q_main`` the main languages of the queries. The last three functions of ``truncated`` ask word statistics and are left to ``last_words``; ``ends`` is
    open if these apply, and contrast if the last word stands in a contrast, where any noun may end a sentence."""
    out: dict[str, list[str]] = {d: [] for d in (*DEFECTS, "ends")}
    a_main, langs = _tagged(answer, tagger)
    for i, (q, a) in enumerate(zip(query, answer)):
        a, q = a or "", q or ""
        f = _folded(read[i])
        asked = read_tokens(q)
        qw, aw = _word_set(asked), _word_set(read[i])
        three, ends = _ending_votes(a, f, read[i])
        said = (_empty_votes(f), _refusal_votes(a, f), _copy_votes(asked, f, qw, aw), _language_votes(asked, f, qw, aw, q_main[i], a_main[i], langs[i]), three, ends)
        for d, v in zip((*DEFECTS, "ends"), said):
            out[d].append(v)
    return out


def last_two(tokens: list[tuple]) -> tuple[str, str]:
    """The last word and the one before it, '' where there is none."""
    return (*islice((t[2] for t in reversed(tokens) if t[2]), 2), "", "")[:2]


@cache
def _fixed_votes(d: str, text: str | None) -> str:
    """The votes about being empty or a refusal on one of BLANKS or REFUSALS, which know no query."""
    f = fold(text or "")
    return _empty_votes(f) if d == "empty" else _refusal_votes(text, f)


def planted_votes(query: list, answer: list, seeds: list[int], tagger: Tagger, q_main: list) -> tuple[Counter, list[tuple]]:
    """Votes on the defects that are planted into each row, each about its own defect only: how often each (plant, pattern)
    occurs, and (plant, last, prev, three, ends) of every cut answer, whose pattern needs word statistics. A ``plant`` is the
    defect and the half, 0 or 1, in which the row stands by its seed."""
    counted: Counter = Counter()
    cut: list[tuple] = []
    foreign: list[tuple[int, str, str]] = []
    words_of: list[tuple[list[tuple], set[str]]] = []
    for i, (q, a, seed) in enumerate(zip(query, answer, seeds)):
        asked = read_tokens(q or "")
        words_of.append((asked, _word_set(asked)))
        for d, _, text in plant([(q, a)], random.Random(seed)):
            if not d:
                continue
            name = f"{d}/{seed & 1}"
            if d == "other_language":
                foreign.append((i, name, text))
            elif d == "truncated":
                tokens = read_tokens(text)
                cut.append((name, *last_two(tokens), *_ending_votes(text, _folded(tokens), tokens)))
            elif d == "copy":
                tokens = read_tokens(text)
                counted[name, _copy_votes(asked, _folded(tokens), words_of[i][1], _word_set(tokens))] += 1
            else:
                counted[name, _fixed_votes(d, text)] += 1
    a_main, langs = _tagged([text for _, _, text in foreign], tagger) if foreign else ([], [])
    for j, (i, name, text) in enumerate(foreign):
        tokens = read_tokens(text)
        counted[name, _language_votes(words_of[i][0], _folded(tokens), words_of[i][1], _word_set(tokens), q_main[i], a_main[j], langs[j])] += 1
    return counted, cut


def last_words(three: Column, ends: Column, n: Column, n_end: Column, p: Column, p_end: Column) -> Column:
    """The whole pattern of ``truncated``: the votes of ``unknown_word``, ``never_last`` and ``never_before_last`` follow, from
    how often the last word occurs (n), ends a sentence (n_end), and the word before it occurs (p) and precedes a
    sentence's last word (p_end). What stands before a word that may be a fragment says nothing."""
    rare = lambda k, of, low: F.when((k <= low * of) & (of >= 20), "+").when((k >= 0.02 * of) & (k >= 2), "-").otherwise("0")
    unknown = F.when(n == 0, "+").when(n >= 5, "-").otherwise("0")
    last = F.when(n == 0, "0").otherwise(rare(n_end, n, 0.004))
    before = F.when((n == 0) | (p == 0), "0").otherwise(rare(p_end, p, 0.002))
    spared = (ends == "contrast") & (n > 0)
    asked = F.concat(F.substring(three, 1, 2), F.when(spared, "0").otherwise(F.substring(three, 3, 1)), unknown, F.when(spared, "0").otherwise(last), before)
    return F.when(ends == "empty", "------").when(ends == "closed", F.concat(three, F.lit("000"))).otherwise(asked)


def count_words(tokens: list[tuple], seen: dict[str, list[int]]) -> None:
    """Count for each word of an answer how often it occurs, ends a sentence, and stands before a word that does. The last
    token of an answer without a full stop is no witness for itself."""
    if tokens and not tokens[-1][3]:
        tokens = tokens[:-1]
    before = None
    for _, _, w, ends, _ in tokens:
        if ends and before is not None:
            before[2] += 1
        before = None
        if w:
            before = seen.get(w)
            if before is None:
                before = seen[w] = [0, 0, 0]
            before[0] += 1
            before[1] += ends


def plant(rows: list[tuple], rng: random.Random) -> list[tuple[str, str | None, str | None]]:
    """(defect, query, answer) for (query, answer) rows: each defect planted into each of them, and the row as it
    is ('')."""
    out: list[tuple[str, str | None, str | None]] = []
    for q, a in rows:
        out.append(("", q, a))
        if fold(q or ""):
            out.append(("copy", q, rng.choice(("{}", "{}؟", "{}.", "پرسش: {}", "{0}\n{0}")).format(q)))
        out.append(("refusal", q, rng.choice(REFUSALS)))
        out.append(("empty", q, rng.choice(BLANKS)))
        foreign = rng.choice(("en", "tr", "fr", "ar", "ur"))
        out.append(("other_language", q, " ".join(rng.sample(_IN_ORDER[foreign], 14)) + "."))
        words = (a or "").split()
        if len(words) >= 8:
            cut = words[: rng.randint(len(words) // 2, len(words) - 2)]
            out.append(("truncated", q, " ".join(cut) if rng.random() < 0.5 else " ".join(cut)[: -max(1, len(cut[-1]) // 2)]))
    return out


def measured(patterns: list[str] | dict[str, int], first: list[tuple[str, float, float]], weight: float = 4.0) -> list[tuple[str, float, float]]:
    """Shares of votes for and against on planted defects, given as patterns or with how often each occurs; ``first`` counts
    as ``weight`` rows."""
    counts = Counter(patterns)
    n = counts.total()
    share = lambda j, c, guess: (sum(k for p, k in counts.items() if p[j] == c) + weight * guess) / (n + weight)
    return [(name, share(j, "+", yes), share(j, "-", no)) for j, (name, yes, no) in enumerate(first)]


def best_cutoff(planted: list[float] | dict[float, int], plain: list[float] | dict[float, int]) -> float:
    """The posterior that parts planted defects from plain rows best (hits less false alarms), both given as posteriors or
    with how often each occurs; of equally good ones the nearest to one half. One half without rows."""
    if not planted or not plain:
        return 0.5
    grid = [i / 100 for i in range(5, 100, 5)]
    hits, alarms = Counter(planted), Counter(plain)
    reach = lambda rows, c: sum(n for p, n in rows.items() if p >= c) / rows.total()
    part = lambda c: reach(hits, c) - reach(alarms, c)
    return max(grid, key=lambda c: (round(part(c), 6), -abs(c - 0.5)))


def fit(patterns: list[tuple[int, ...]], counts: list[int], expected: list[tuple[str, float, float]], share: float = 0.02, rounds: int = 80, hold: float = 0.001) -> np.ndarray:
    """Posterior of the defect for each pattern of votes.

    Maximum a-posteriori expectation maximisation with votes independent given the truth. Rates on sound answers and the
    share of defective ones are learned. Rates on defective answers are learned too, but held near what is expected of the
    functions by pseudo-counts of ``hold`` of the rows, a small part of the defective ones. The result depends on the
    proportions of patterns, not on the number of rows. A pattern without any vote for the defect has posterior 0; if
    the first function is a gate, patterns it votes against with no vote for the defect are not learned from either: most
    answers end in a full stop, and what they share says nothing about those that don't."""
    votes = np.array(patterns).reshape(len(patterns), len(expected))
    some = (votes > 0).any(1)
    learned = some | (votes[:, 0] >= 0) if expected[0][0] in GATES else np.ones(len(votes), bool)
    out = np.zeros(len(votes))
    if not (learned & some).any() or not sum(counts):
        return out
    v = votes[learned] + 1  # 0 against, 1 no opinion, 2 for
    n = np.array(counts, float)[learned]
    total, m = n.sum(), v.shape[1]
    start = np.array([[no + 0.005, 1 - yes - no + 0.005, yes + 0.005] for _, yes, no in expected])
    start /= start.sum(1, keepdims=True)
    seen = np.array([[(n * (v[:, j] == k)).sum() + 1e-4 * total for k in range(3)] for j in range(m)])
    rates = np.stack([seen / seen.sum(1, keepdims=True), start])
    first = share
    for _ in range(rounds):
        logs = np.log(rates)
        like = np.stack([logs[y][np.arange(m)[None, :], v].sum(1) for y in (0, 1)])
        post = 1 / (1 + np.exp(-np.clip(like[1] - like[0] + np.log(share / (1 - share)), -50, 50)))
        share = ((n * post).sum() + first * hold * total) / ((1 + hold) * total)
        for y, w, kept, at in ((0, n * (1 - post), 1e-3, seen / total), (1, n * post, hold, start)):
            for k in range(3):
                rates[y, :, k] = (w[:, None] * (v == k)).sum(0) + kept * total * at[:, k]
            rates[y] /= rates[y].sum(1, keepdims=True)
    out[learned] = post * some[learned]
    return out


def sides(df: DataFrame, key: str = "pair_id", query: str = "query", answers: tuple[str, ...] = ("chosen", "rejected")) -> DataFrame:
    """One row per key and answer: k, side, query, answer. A repeated key counts once (of different rows the greatest)."""
    one = df.select(F.col(f"`{key}`").alias("k"), F.struct(F.col(f"`{query}`").alias("q"), *(F.col(f"`{a}`").alias(f"a{i}") for i, a in enumerate(answers))).alias("x"))
    one = one.filter("k is not null").groupBy("k").agg(F.max("x").alias("x"))
    return one.select("k", F.col("x.q").alias("query"), F.explode(F.array(*(F.struct(F.lit(a).alias("side"), F.col(f"x.a{i}").alias("answer")) for i, a in enumerate(answers)))).alias("s")).select("k", "s.side", "query", "s.answer")


def label_defects(df: DataFrame, key: str = "pair_id", query: str = "query", answers: tuple[str, ...] = ("chosen", "rejected"), cutoffs: dict[str, float] | None = None) -> DataFrame:
    """``key``, ``side``, one posterior column per defect, ``defects`` (all whose posterior reaches its cutoff, most likely
    first) and ``defect`` (the first of them, or null).

    Every defect is planted into every answer. The planted ones of half of the rows, by a hash, give the rates from which
    the label model of each defect starts on the patterns of all rows; those of the other half, which the model doesn't
    see, and all rows as they are give the cutoffs unless they are given.

    Word statistics and vote patterns are counted over all rows; the driver sees vote patterns only, of which there are at
    most three to the number of functions. A null or empty answer is ``empty`` whatever the query; a
    null query can make an answer neither a copy nor of another language. An empty table gives no rows; repeated rows count
    once; of equally likely defects the one that DEFECTS names first wins. Columns besides those named are not read."""
    rows = materialize(sides(df, key, query, answers))
    kind = rows.schema["k"].dataType.simpleString()
    columns = ("k", "side", "plant", "last", "prev", *DEFECTS, "ends", "n", "n_end", "n_before", "times")

    def framed(size: int, **of: list) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(of[c], dtype=object) if c in of else pd.Series([None] * size, dtype=object) for c in columns})

    def cast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Votes of all rows, and as rows of other kinds votes on planted defects and counts of the words of all rows."""
        tagger = Tagger(LANGUAGE_MODEL)
        seen: dict[str, list[int]] = {}
        planted: Counter = Counter()
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.iloc[at : at + 500]
                text = lambda c: b[c].astype(object).where(b[c].notna(), None).tolist()  # noqa: E731, B023
                query, answer = text("query"), text("answer")
                read = [read_tokens(a) if a else [] for a in answer]
                for tokens in read:
                    count_words(tokens, seen)
                q_main = tagger.segments(query)[1]
                found = [last_two(tokens) for tokens in read]
                yield framed(len(b), k=b["k"].tolist(), side=text("side"), last=[x for x, _ in found], prev=[x for _, x in found], **votes(query, answer, tagger, read, q_main))
                more, cut = planted_votes(query, answer, b["seed"].tolist(), tagger, q_main)
                planted.update(more)
                if cut:
                    yield framed(len(cut), **dict(zip(("plant", "last", "prev", "truncated", "ends"), map(list, zip(*cut)))), times=[1] * len(cut))
                if len(seen) > 100_000:
                    yield counts(seen)
                    seen = {}
        if seen:
            yield counts(seen)
        for d in DEFECTS:
            if some := [(name, pattern, n) for (name, pattern), n in planted.items() if name.startswith(d + "/")]:
                yield framed(len(some), **dict(zip(("plant", d, "times"), map(list, zip(*some)))))

    def counts(seen: dict[str, list[int]]) -> pd.DataFrame:
        n, n_end, n_before = map(list, zip(*seen.values()))
        return framed(len(seen), last=list(seen), n=n, n_end=n_end, n_before=n_before)

    both = materialize(rows.withColumn("seed", F.xxhash64("k", "side")).mapInPandas(cast, f"k {kind}, side string, plant string, last string, prev string, " + ", ".join(f"{d} string" for d in (*DEFECTS, "ends")) + ", n long, n_end long, n_before long, times long"))
    stats = materialize(both.filter("n is not null").groupBy(F.col("last").alias("w")).agg(*(F.sum(c).alias(c) for c in ("n", "n_end", "n_before"))))
    # texts stay behind: only votes and two words a row are written and joined
    voted = both.filter("n is null").select("k", "side", "plant", "last", "prev", *DEFECTS, "ends", "times")
    voted = voted.join(stats.select(F.col("w").alias("last"), "n", "n_end"), "last", "left").join(stats.select(F.col("w").alias("prev"), F.col("n").alias("p"), F.col("n_before").alias("p_end")), "prev", "left")
    numbers = [F.coalesce(c, F.lit(0)) for c in ("n", "n_end", "p", "p_end")]
    voted = materialize(voted.withColumn("truncated", last_words(F.col("truncated"), F.col("ends"), *numbers)).select("k", "side", "plant", *DEFECTS, "times"))
    tall = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).alias("v")) for d in DEFECTS))).alias("x")
    known: dict[str, dict[str, int]] = {d: {} for d in DEFECTS}
    for r in voted.filter("plant is null").select(tall).groupBy("x.d", "x.v").count().collect():  # vote patterns, bounded by the number of functions
        known[r.d][r.v] = r["count"]
    told: dict[str, dict[str, int]] = {f"{d}/{half}": {} for d in DEFECTS for half in (0, 1)}
    for r in voted.filter("plant is not null").groupBy("plant", F.coalesce(*DEFECTS).alias("v")).agg(F.sum("times").alias("n")).collect():  # a planted row has votes about its defect only
        told[r.plant][r.v] = r.n
    posterior: dict[str, dict[str, float]] = {}
    chosen = dict(cutoffs or {})
    for d in DEFECTS:
        first, second = told[f"{d}/0"], told[f"{d}/1"]
        patterns = sorted(known[d].keys() | first.keys() | second.keys())
        post = fit([tuple("-0+".index(c) - 1 for c in p) for p in patterns], [known[d].get(p, 0) for p in patterns], measured(first, FUNCTIONS[d]))
        posterior[d] = dict(zip(patterns, post.tolist()))
        reached = lambda rows: sum((Counter({posterior[d][p]: n}) for p, n in rows.items()), Counter())  # noqa: E731, B023
        chosen.setdefault(d, best_cutoff(reached(second), reached(known[d])))
    out = voted.filter("plant is null").drop("plant", "times")
    for d in DEFECTS:
        pairs = [F.lit(x) for kv in sorted(posterior[d].items()) for x in kv] or [F.lit(""), F.lit(0.0)]
        out = out.withColumn(d, F.element_at(F.create_map(*pairs), F.col(d)))
    ranked = F.array(*(F.struct((-F.col(d)).alias("p"), F.lit(i).alias("i"), F.lit(d).alias("d"), F.lit(chosen[d]).alias("c")) for i, d in enumerate(DEFECTS)))
    # equal to two digits counts as equally likely
    ranked = F.transform(ranked, lambda x: F.struct(F.round(x.p, 2).alias("p"), x.i.alias("i"), x.d.alias("d"), (-x.p >= x.c).alias("ok")))
    out = out.withColumn("defects", F.transform(F.filter(F.array_sort(ranked), lambda x: x.ok), lambda x: x.d))
    return out.withColumn("defect", F.get("defects", F.lit(0))).withColumnRenamed("k", key)
