"""Languages of documents and of their segments by error-correcting output codes.

Each language has a codeword; a binary classifier on character n-grams predicts each bit. A segment gets the language
whose codeword is nearest by loss-weighted decoding, and is ambiguous if a second one is nearly as near. Scores of words
are remembered, and segments are scored for many documents at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .split_text import slices

LANGUAGES = ("fa", "ar", "ur", "en", "tr", "fr")
# Names of the languages besides their codes. Region and script suffixes are cut off before.
NAMES = {
    "fa": ("fa", "fas", "per", "pes", "farsi", "persian", "فارسی", "پارسی"),
    "ar": ("ar", "ara", "arb", "arabic", "العربية", "عربي", "عربی"),
    "ur": ("ur", "urd", "urdu", "اردو"),
    "en": ("en", "eng", "english", "انگلیسی"),
    "tr": ("tr", "tur", "turkish", "türkçe", "turkce", "ترکی"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "فرانسه", "فرانسوی"),
}
# Frequent words of each language; they make the classifiers work where no row is labelled.
SEEDS = {
    "fa": "و در به از که این را با است برای آن یک خود تا کرد بر هم نیز گفت می‌شود شد اما ما شما او آنها هر اگر چه وقتی بود نیست می‌کند می‌گوید دارد باید پس چون مانند پیش نزد کنار بلکه هرگز چیست چگونه کدام بنویسید کنید های می‌خواهد گاهی همان تنها دیگر بسیار روی زیر پاسخ پرسش درس بیت واژه معنی مفهوم",
    "ar": "في من على إلى أن عن التي الذي هذا هذه كان قد لا ما مع كل ثم أو بعد بين قال إن ليس هو هي كانت لم عند إذا حتى غير ذلك تلك أي كما فإنه إلا يكون الله عليه منه فيه بها له لها وقد ولا وفي كيف لماذا لأن الدرس البيت القصيدة الكتاب تدل معنى",
    "ur": "اور کے کی کا میں ہے سے کو نے پر یہ وہ ہیں تھا تھی تھے کہ اس ان ایک بھی نہیں ہم تم آپ کیا کیسے جب تو اگر لیکن ساتھ بعد لیے کر ہوا ہو جو اب پھر گیا رہا ہوں بہت اپنے مطلب یہاں بلکہ درمیان کہتا لگتا پڑھا سبق شاعر گھر",
    "en": "the of and to in a is that it was for on as with his they be at one have this from or had by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know",
    "tr": "ve bir bu da de için ile çok daha ne o gibi kadar olan en var ben sen biz siz onlar ama çünkü değil her şey sonra önce olarak diye yok mi mı ki ya hiç bile kendi olduğu neden demektir burada sözcüğünü vardı eğer olmasaydı arasında birlikte nasıl hangi şair öğretmen yıllar sonunda üzerine göre sadece yeni büyük",
    "fr": "le la les de des du un une et à en est que qui dans pour pas sur au aux avec ce cette il elle nous vous ils sont par plus ne se son sa ses mais ou où comme si tout fait être avoir était jamais quand parce chaque entre leur très sans même aussi après avant toujours dit ici pourquoi quel quelle lorsque poète leçon vers",
}
LETTERS = re.compile(r"[^\W\d_]+(?:[‌'’ʼـً-ٕ]*[^\W\d_]+)*")
#: Places where the language may change, one character each: line breaks, bars, sentence ends, dashes, brackets, quotes.
BREAKS = re.compile(r"[\n|.!?؟۔…؛;:—–«»()\[\]{}\"“”]")
# One letter for the ways in which keyboards of the region write it.
FOLD = str.maketrans({"ي": "ی", "ى": "ی", "ے": "ی", "ك": "ک", "ہ": "ه", "ھ": "ه", "ة": "ه", "ۀ": "ه", "أ": "ا", "إ": "ا", "ؤ": "و", "‌": None, "ـ": None} | {chr(c): None for c in range(0x64B, 0x656)})


def code_book(languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Exhaustive codewords, one row a language, entries -1 and 1: every way to part the languages in two, once."""
    n = len(languages)
    return np.array([[1 if (b >> i) & 1 else -1 for b in range(1, 2 ** (n - 1))] for i in range(n)], np.float32)


def _grams(word: str, features: int) -> list[int]:
    """Hashed n-grams of one to four characters and the word itself; both raw and with keyboard variants folded."""
    out = []
    folded = word.translate(FOLD)
    for mark, w in (("r", word),) if folded == word else (("r", word), ("f", folded)):
        s = f"<{w}>"
        out += [mark + s[i : i + n] for n in (1, 2, 3, 4) for i in range(len(s) - n + 1)]
        out.append(mark + "=" + w)
    return [_stable(g) % features for g in out]


def _stable(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode())


class Model:
    """Binary n-gram classifiers for the bits of the code: naive Bayes with additive smoothing."""

    def __init__(self, labelled: dict[str, list[str]], features: int = 1 << 16, smooth: float = 0.5, seed_weight: float = 3.0):
        self.features, self.book = features, code_book()
        counts = np.zeros((len(LANGUAGES), features))
        for i, lang in enumerate(LANGUAGES):
            for weight, words in ((seed_weight, SEEDS[lang].split()), (1.0, (w.lower() for t in labelled.get(lang, ()) for w in LETTERS.findall(t)))):
                seen: dict[str, int] = {}
                for w in words:
                    seen[w] = seen.get(w, 0) + 1
                for w, n in seen.items():
                    np.add.at(counts[i], _grams(w, features), weight * n)
        rates = counts / counts.sum(1, keepdims=True)  # languages weigh alike whatever their number of rows
        one, other = (self.book.T > 0) @ rates, (self.book.T < 0) @ rates
        n_one, n_other = (self.book > 0).sum(0)[:, None], (self.book < 0).sum(0)[:, None]
        floor = smooth / counts.sum(1).mean()
        self.weights = np.log((one / n_one + floor) / (other / n_other + floor)).T.astype(np.float32)  # features x bits

    def words(self, words: list[str]) -> np.ndarray:
        """Log odds of every bit for each word: the mean over the word's n-grams."""
        out = np.zeros((len(words), self.book.shape[1]), np.float32)
        for k, w in enumerate(words):
            g = _grams(w, self.features)
            out[k] = self.weights[g].mean(0)
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """What each word takes off every language's decoding loss. With logistic loss a codeword's loss is a sum that all
        codewords share, less the log odds of the bits that it sets, so losses of texts are sums over their words."""
        return self.words(words) @ (self.book > 0).T.astype(np.float32) / self.book.shape[1]

    @staticmethod
    def decode(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of least loss for each row, and its confidence: the softmax of the negative losses. A
        confidence under about one half means that a second codeword is as near."""
        p = np.exp((gains - gains.max(1, keepdims=True)) * 4)
        return gains.argmax(1), p.max(1) / p.sum(1)


class Tagger:
    """Runs of one language in many texts, remembering the scores of words."""

    def __init__(self, model: Model, keep: int = 300_000):
        self.model, self.keep = model, keep
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGUAGES) + 1), np.float32)

    def _known(self, tokens: list[str]) -> np.ndarray:
        """Rows of the table for tokens as written; a row holds a token's summed scores and its number of letters."""
        ids = self.ids
        rows = np.fromiter(map(ids.get, tokens, repeat(-1)), np.int64, len(tokens))
        missing = np.flatnonzero(rows < 0)
        if not len(missing):
            return rows
        new = list(dict.fromkeys(tokens[i] for i in missing.tolist()))
        if len(ids) + len(new) > self.keep:
            ids.clear()
            new = list(dict.fromkeys(tokens))
            missing = np.arange(len(tokens))
        first = len(ids)
        while first + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for k, token in enumerate(new, first):
            words = LETTERS.findall(token.lower())
            self.table[k, :-1] = self.model.scores(words).sum(0)
            self.table[k, -1] = sum(map(len, words))
        ids.update(zip(new, range(first, first + len(new))))
        rows[missing] = [ids[tokens[i]] for i in missing.tolist()]
        return rows

    def units(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Parts of the texts between breaks that hold words: text number, start, end, letters, scores."""
        places: list[tuple[int, int, int, int]] = []
        tokens: list[str] = []
        split, add = BREAKS.split, places.append
        for d, t in enumerate(texts):
            if not t:
                continue
            at = 0
            for part in split(t):
                behind = at + len(part)
                if behind > at and (found := part.split()):
                    add((d, at, behind, len(tokens)))
                    tokens += found
                at = behind + 1
        if not places:
            z = np.zeros(0, np.int64)
            return z, z, z, z, np.zeros((0, len(LANGUAGES)), np.float32)
        doc, start, end, first = np.array(places, np.int64).T
        known = self._known(tokens)
        sums = np.add.reduceat(self.table[known], first, axis=0)
        worded = sums[:, -1] > 0
        return doc[worded], start[worded], end[worded], sums[worded, -1].astype(np.int64), sums[worded, :-1]

    def segments(self, texts: list[str | None], short: int = 25, least: int = 100) -> tuple[list[np.ndarray], list]:
        """Segments (text number, start, end, language, confidence, characters) of at least ``least`` characters of one
        language running, and for each text its main language. Parts of fewer than ``short`` letters, and runs of under
        ``least`` characters between two runs of one language, join their neighbours: quotations and terms don't count."""
        doc, start, end, letters, gains = self.units(texts)
        if not len(doc):
            return [np.zeros(0, np.int64)] * 6, [None] * len(texts)
        lang, _ = self.model.decode(gains)
        # main language by characters of all parts
        spread = np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(spread, (doc, lang), letters)
        main = [int(r.argmax()) if r.sum() else None for r in spread]
        # short parts take the language of the long part before or behind: the one they speak, else the one before
        row = np.arange(len(doc))
        prev = np.maximum.accumulate(np.where(letters >= short, row, -1))
        nxt = np.minimum.accumulate(np.where(letters >= short, row, len(doc))[::-1])[::-1]
        p, n = np.maximum(prev, 0), np.minimum(nxt, len(doc) - 1)
        ok_prev, ok_next = (prev >= 0) & (doc[p] == doc), (nxt < len(doc)) & (doc[n] == doc)
        around = np.where(ok_prev & ~(ok_next & (lang[n] == lang)), lang[p], np.where(ok_next, lang[n], lang))
        lang = np.where(letters >= short, lang, around)
        for _ in range(2):  # runs; then short runs inside another language join it
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])])
            run = np.cumsum(new) - 1
            head = np.flatnonzero(new)
            tail = np.concatenate([head[1:], [len(doc)]]) - 1
            size = end[tail] - start[head]
            r_doc, r_lang = doc[head], lang[head]
            inside = np.zeros(len(head), bool)
            if len(head) > 2:
                inside[1:-1] = (size[1:-1] < least) & (r_doc[:-2] == r_doc[1:-1]) & (r_doc[2:] == r_doc[1:-1]) & (r_lang[:-2] == r_lang[2:])
                inside[1:] &= ~inside[:-1]
            joined = r_lang.copy()
            joined[inside] = r_lang[np.flatnonzero(inside) - 1]
            lang = joined[run]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(doc)]]) - 1
        weight = np.add.reduceat(gains, head, axis=0) / np.maximum(np.add.reduceat(letters, head), 1)[:, None] * 5.0
        loss_lang, conf = self.model.decode(weight)
        conf = np.where(loss_lang == lang[head], conf, 1.0 / len(LANGUAGES))
        size = end[tail] - start[head]
        return [doc[head], start[head], end[tail], lang[head], conf, size], main


def label_language(label: Column) -> Column:
    """The language code that a label names, or null: codes, names and either with a region in any case."""
    plain = F.lower(F.regexp_replace(label, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    plain = F.regexp_extract(plain, r"^([^-_\s(]+)", 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(plain.isin(*names), F.lit(lang)).otherwise(out)
    return out


def passages(text: Column, most_chars: int, number: int = 8) -> Column:
    """A text of at most ``most_chars`` characters as it is; of a longer one, ``number`` passages of equal length that stand
    at even distances over the whole text, ``most_chars`` together, one a line."""
    size = most_chars // number
    step = (F.length(text) - size) / (number - 1)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) > most_chars, F.array_join(drawn, "\n")).otherwise(text)


def train(df: DataFrame, text: str, label: str, rows_per_language: int = 300, most_chars: int = 4_000) -> Model:
    """Classifiers from a bounded sample of labelled rows: per language the ``rows_per_language`` rows with the least hash
    of their text, of each up to ``most_chars`` characters in passages from the whole text. Rows whose label the first fit
    contradicts are left out of the second, as labels may be wrong. Seeds stand in for languages without rows."""
    from pyspark.sql import Window

    rows = df.select(F.col(f"`{text}`").alias("t"), label_language(F.col(f"`{label}`")).alias("l")).filter("t is not null and l is not null")
    w = Window.partitionBy("l").orderBy("h")
    picked = rows.select("l", F.xxhash64("t").alias("h"), passages(F.col("t"), most_chars).alias("t")).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= rows_per_language)
    held: dict[str, list[str]] = {}
    for r in picked.select("l", "h", "t").orderBy("l", "h").collect():
        held.setdefault(r.l, []).append(r.t)
    tagger = Tagger(Model(held))
    agreed: dict[str, list[str]] = {}
    for lang, texts in held.items():
        runs, main = tagger.segments(texts)
        pure = np.bincount(runs[0], runs[5] * (runs[3] == LANGUAGES.index(lang)), len(texts)) if len(runs[0]) else np.zeros(len(texts))
        agreed[lang] = [t for t, m, p in zip(texts, main, pure) if m == LANGUAGES.index(lang) and p >= 0.95 * len(t)]
    return Model(agreed)


def languages(df: DataFrame, key: str, text: str, model: Model, least: int = 100, label: str | None = None) -> DataFrame:
    """Languages of documents and segments: ``key``, ``segment`` (null for the document's own row, else from 0 on),
    ``start``, ``end``, ``language``, ``confidence``, ``ambiguous`` and, with ``label``, ``label_language``.

    Every document with words has its own row with its main language; one with passages of at least ``least`` characters
    in two or more languages has a row for each such passage besides. Null, empty, blank and number-only texts give no
    row. Rows are kept as they are, repeated keys too. Of languages with equally many letters the first of LANGUAGES is
    the main one. Columns besides those named are not read. Only keys and texts reach Python."""
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), (label_language(F.col(f"`{label}`")) if label else F.lit(None).cast("string")).alias("l"))
    kind = rows.schema["k"].dataType.simpleString()

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for b in slices(batches, 400_000):
            keys, labels = b.k.to_numpy(dtype=object), b.l.to_numpy(dtype=object)
            (doc, start, end, lang, conf, size), main = tagger.segments(b.t.tolist(), least=least)
            own = np.array([i for i, m in enumerate(main) if m is not None], np.int64)
            m = np.array([main[i] for i in own], np.int64)
            # a document's confidence: that of its segments in the main language, weighted by size
            full = np.array([-1 if x is None else x for x in main], np.int64)
            hit = lang == full[doc] if len(doc) else np.zeros(0, bool)
            top = np.bincount(doc[hit], (conf * size)[hit], len(main))
            weight = np.bincount(doc[hit], size[hit], len(main))
            sure = (top / np.maximum(weight, 1))[own]
            big = size >= least
            pairs = np.zeros((len(main), len(LANGUAGES)), bool)
            pairs[doc[big], lang[big]] = True
            pick = np.flatnonzero(big & (pairs.sum(1) > 1)[doc]) if len(doc) else np.zeros(0, np.int64)
            number = np.arange(len(pick)) - np.searchsorted(doc[pick], doc[pick])
            names = np.array(LANGUAGES, dtype=object)
            yield pd.DataFrame(
                {
                    "k": np.concatenate([keys[own], keys[doc[pick]]]),
                    "segment": pd.array([None] * len(own) + number.tolist(), dtype="Int32"),
                    "start": np.concatenate([np.zeros(len(own), np.int64), start[pick]]),
                    "end": np.concatenate([np.array([len(b.t.iloc[i]) for i in own], np.int64), end[pick]]),
                    "language": np.concatenate([names[m], names[lang[pick]]]),
                    "confidence": np.concatenate([sure, conf[pick]]),
                    "l": np.concatenate([labels[own], labels[doc[pick]]]),
                }
            )

    out = rows.mapInPandas(tag, f"k {kind}, segment int, start int, end int, language string, confidence double, l string")
    cols = [F.col("k").alias(key), "segment", "start", "end", "language", "confidence", (F.col("confidence") < 0.5).alias("ambiguous")]
    return out.select(*cols, *([F.col("l").alias("label_language")] if label else []))


def mislabelled(df: DataFrame, key: str, text: str, label: str, model: Model, least: int = 100) -> DataFrame:
    """(``key``, ``found_lang``): the main language where the label names no language or another one, and each language
    with a passage of at least ``least`` characters where there are two or more."""
    tagged = languages(df, key, text, model, least, label)
    wrong = F.col("segment").isNull() & ~F.coalesce(F.col("language") == F.col("label_language"), F.lit(False))
    return tagged.filter(wrong | F.col("segment").isNotNull()).select(key, F.col("language").alias("found_lang")).distinct()
