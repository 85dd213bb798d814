"""Missing or wrong language labels, by hyperdimensional language profiles.

Each letter has a random vector of plus and minus ones. An n-gram's vector binds (multiplies) its letters' vectors,
each permuted by its place; a text's vector bundles (adds) those of its n-grams; a language's prototype bundles its
sample texts. A text goes to the prototype with the largest cosine. Bundling is linear, so the products of an n-gram
vector with all prototypes are worked out once and a text adds up rows of that table.

The languages are those that the data's own labels name and whose samples hold up: what one half of them teaches must
recognise the other half. Texts that are much less like their nearest language than its own texts are of another.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Length of an n-gram, of a vector, and the labelled documents per language that prototypes are fitted on.
GRAM, DIM, SAMPLE = 3, 4096, 400
#: Share of a text's letters from which a language counts.
SHARE = 0.15
#: A sentence listens to its neighbours by 1 - letters / SHORT, not at all from so many letters on.
SHORT = 60
#: Share of a language's held-out sample that must be recognised; n-grams from which a text can be told to be of none of
#: the languages, and the share of its language's usual likeness below which it is.
HOLDS, LEAST, ALIKE = 0.5, 100, 0.6
#: The language of texts that are in none of the known ones.
OTHER = "und"

#: Codes of two and three letters, English and own names of languages.
NAMES = {
    "ar": ["ar", "ara", "arabic", "العربية"],
    "bg": ["bg", "bul", "bulgarian", "български"],
    "ca": ["ca", "cat", "catalan", "català"],
    "cs": ["cs", "ces", "cze", "czech", "čeština"],
    "da": ["da", "dan", "danish", "dansk"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "el": ["el", "ell", "gre", "greek", "ελληνικά"],
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "et": ["et", "est", "estonian", "eesti"],
    "fa": ["fa", "fas", "per", "persian", "فارسی"],
    "fi": ["fi", "fin", "finnish", "suomi"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "he": ["he", "heb", "hebrew", "עברית"],
    "hi": ["hi", "hin", "hindi", "हिन्दी"],
    "hr": ["hr", "hrv", "croatian", "hrvatski"],
    "hu": ["hu", "hun", "hungarian", "magyar"],
    "id": ["id", "ind", "indonesian", "bahasa indonesia"],
    "it": ["it", "ita", "italian", "italiano"],
    "ja": ["ja", "jpn", "japanese", "日本語"],
    "ko": ["ko", "kor", "korean", "한국어"],
    "lt": ["lt", "lit", "lithuanian", "lietuvių"],
    "lv": ["lv", "lav", "latvian", "latviešu"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "no": ["no", "nb", "nn", "nor", "norwegian", "norsk"],
    "pl": ["pl", "pol", "polish", "polski"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "ro": ["ro", "ron", "rum", "romanian", "română"],
    "ru": ["ru", "rus", "russian", "русский"],
    "sk": ["sk", "slk", "slo", "slovak", "slovenčina"],
    "sl": ["sl", "slv", "slovenian", "slovenščina"],
    "sv": ["sv", "swe", "swedish", "svenska"],
    "tr": ["tr", "tur", "turkish", "türkçe"],
    "uk": ["uk", "ukr", "ukrainian", "українська"],
    "vi": ["vi", "vie", "vietnamese", "tiếng việt"],
    "zh": ["zh", "zho", "chi", "chinese", "中文"],
}

#: Codes of letters: 0 the gap, 1-26 Latin letters without their marks, the rest letters of other scripts by code point.
_A = 94
# A quote of several sentences is text; any other is a title. Code and title lines are hidden too.
_INNER = r"(?:[^{}\n.!?]|[.!?](?=\S))*"
_HIDE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\[\[[^\]\n]*\]\]|“" + _INNER.format("“”") + "”|„" + _INNER.format("„“”") + "[“”]|«" + _INNER.format("«»") + '»|"' + _INNER.format('"') + r'"|^[ \t>]*#[ \t][^\n]*', re.S | re.M)
_MARK = re.compile(r"[`“„«\"#]|\[\[")


def label_code(c: Column) -> Column:
    """The two-letter code a label names, null for any other label."""
    pairs = [F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)]
    low = F.lower(F.trim(c))
    known = F.create_map(*pairs)
    return F.coalesce(known[low], known[F.regexp_extract(low, r"^([a-z]{2,3})[-_][a-z0-9_-]+$", 1)])


def _letters() -> np.ndarray:
    """Code of each code point below 0x10000; other code points count as their last one, which is no letter."""
    own = {"ß": "s", "æ": "a", "ø": "o", "œ": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "t", "ı": "i"}
    lut = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        if not ch.isalpha():
            continue
        base = ch.lower()
        if cp < 0x250 or 0x1E00 <= cp < 0x1F00:
            base = own.get(base, unicodedata.normalize("NFKD", ch).lower())[:1]
        lut[cp] = ord(base) - 96 if "a" <= base <= "z" else 27 + ord(base[0]) % (_A - 27)
    return lut


_LETTER = _letters()
_BAD = np.zeros(0x10000, bool)
_BAD[[ord(x) for x in "0123456789-_/\\@<>|=:*+~{}%$"]] = True
_STOP = np.zeros(0x10000, bool)
_STOP[[ord(x) for x in ".!?;。！？"]] = True


def _class(u: np.ndarray, lut: np.ndarray) -> np.ndarray:
    return lut[np.minimum(u, len(lut) - 1)]


def hide(text: str) -> str:
    """``text`` with code, quoted titles and title lines blanked, at equal length."""
    return _HIDE.sub(lambda m: " " * len(m[0]), text) if _MARK.search(text) else text


class Sentences:
    """The sentences of some texts, as arrays: doc, start, stop (code points), letters, and their n-grams."""

    def __init__(self, texts: list[str], gram: int = GRAM):
        size = np.array([len(t) + 1 for t in texts], np.int64)
        base = np.concatenate([[0], np.cumsum(size)])
        u = np.frombuffer("\n".join([*map(hide, texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(u)
        if not n:
            u, n = np.array([10], np.uint32), 1
        line = (u == 10) | (u == 13)
        space = line | (u == 32) | (u == 9) | (u == 0xA0)
        code = _class(u, _LETTER)
        # A token with a digit, a hyphen or the like is a name, a figure or an identifier.
        starts = np.flatnonzero(np.concatenate([[True], space[1:] != space[:-1]]))
        odd = np.maximum.reduceat(_class(u, _BAD).astype(np.uint8), starts)
        code = code * (1 - np.repeat(odd, np.diff(np.append(starts, n))))
        # A sentence ends at a line's end, or at a stop before white space.
        end = line.copy()
        end[:-1] |= _class(u[:-1], _STOP) & (space[1:] | (u[:-1] > 0x3000))
        seg = np.concatenate([[0], np.cumsum(end)[:-1]])
        count = np.bincount(seg, code > 0, minlength=seg[-1] + 1).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(end)[: seg[-1]] + 1])
        last = np.append(first[1:], n)
        keep = code > 0
        keep[1:] |= code[:-1] > 0
        c, s = code[keep].astype(np.int64), seg[keep]
        g, m = np.zeros(max(0, len(c) - gram + 1), np.int64), max(0, len(c) - gram + 1)
        for j in range(gram):
            g = g * _A + c[j : j + m]
        one = s[:m] == s[gram - 1 :] if m else np.zeros(0, bool)
        self.grams, seg_of = g[one], s[:m][one]
        live = np.flatnonzero(count)
        at = np.full(len(count), -1)
        at[live] = np.arange(len(live))
        self.of = at[seg_of]
        self.doc = np.searchsorted(base, first[live], "right") - 1
        self.start, self.stop = first[live] - base[self.doc], np.minimum(last[live] - base[self.doc], size[self.doc] - 1)
        self.letters = count[live]

    def score(self, known: Profiles) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams' rows of the table added up by sentence, and their number."""
        k, rows = len(self.letters), known.index[self.grams]
        out = np.stack([np.bincount(self.of, known.table[rows, i], minlength=k) for i in range(len(known.langs))], 1) if k and known.langs else np.zeros((k, len(known.langs)))
        return out, np.bincount(self.of, minlength=k)

    def languages(self, known: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of each sentence's language, a confidence between 1/len and 1, its n-grams and their summed likeness."""
        s, n = self.score(known)
        if not s.size:
            return np.zeros(len(s), np.int64), np.zeros(len(s)), n, np.zeros(len(s))
        own, s = s, s / np.sqrt(np.maximum(1, n))[:, None]
        near, w = s.copy(), np.maximum(0, 1 - self.letters / SHORT)[:, None]
        same = (self.doc[1:] == self.doc[:-1])[:, None]
        near[1:] += w[1:] * same * s[:-1]
        near[:-1] += w[:-1] * same * s[1:]
        e = np.exp(30 * (near - near.max(1, keepdims=True)))
        lang = near.argmax(1)
        return lang, e.max(1) / e.sum(1), n, own[np.arange(len(own)), lang]


@dataclass
class Profiles:
    """Known languages: ``index`` gives each n-gram's row of ``table`` (0 for those never seen), a column per language.

    ``usual`` is the mean likeness of an n-gram of a language's own texts to its prototype.
    """

    langs: list[str]
    index: np.ndarray
    table: np.ndarray
    usual: np.ndarray

    def other(self, doc: np.ndarray, usual: np.ndarray, grams: np.ndarray, likeness: np.ndarray) -> np.ndarray:
        """Which parts of texts, their n-grams' usual likeness and likeness summed, are in none of the languages.

        A text's parts that are unlike their languages must have LEAST n-grams together.
        """
        weak = likeness < ALIKE * usual
        return weak & (np.bincount(doc, weak * grams)[doc] >= LEAST) if len(doc) else weak


def letter_vectors(dim: int = DIM, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (_A, dim))


def gram_vectors(grams: np.ndarray, letters: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The vectors of some n-grams: their letters' random vectors, each rotated by its place, multiplied."""
    out = np.ones((len(grams), letters.shape[1]), np.int8)
    for j in range(gram):
        out *= np.roll(letters, j, axis=1)[grams // _A**j % _A]
    return out


def prototypes(langs: list[str], counts: pd.DataFrame, dim: int = DIM, chunk: int = 1024) -> Profiles:
    """counts(i, g, n): profiles of the languages that have n-grams, from the centred prototypes.

    Counts are damped by their logarithm, so that a language's commonest phrases do not drown the rest of it.
    """
    have = np.unique(counts["i"]).astype(int)
    seen = np.unique(counts["g"]).astype(np.int64)
    c = np.zeros((len(have), len(seen)), np.float32)
    c[np.searchsorted(have, counts["i"]), np.searchsorted(seen, counts["g"])] = np.log1p(counts["n"].to_numpy(float))
    index = np.zeros(_A**GRAM, np.int32)
    index[seen] = np.arange(1, len(seen) + 1)
    table = np.zeros((len(seen) + 1, len(have)), np.float32)
    if len(have):
        letters = letter_vectors(dim)
        steps = [slice(i, i + chunk) for i in range(0, len(seen), chunk)]
        p = sum(c[:, i] @ gram_vectors(seen[i], letters).astype(np.float32) for i in steps)
        p /= np.maximum(1e-9, np.linalg.norm(p, axis=1, keepdims=True))
        if len(have) > 1:
            p -= p.mean(0)
            p /= np.maximum(1e-9, np.linalg.norm(p, axis=1, keepdims=True))
        for i in steps:
            table[1:][i] = gram_vectors(seen[i], letters).astype(np.float32) @ p.T / np.float32(np.sqrt(dim))
    return Profiles([langs[i] for i in have], index, table, np.zeros(len(have)))


def _count(sample: DataFrame, langs: list[str], known=None) -> pd.DataFrame:
    """sample(text, i, half): n-grams (i, g, n) by label, of half 0; with profiles, of the sentences that they give the label's language.

    Then also, of half 1: g -1 and -2 the n-grams of the sentences recognised and their likeness in millionths, g
    -3 - m the sentences given language m. At most one row per language and n-gram of the alphabet, whatever the sample.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = Sentences(list(pdf["text"]))
            label, half = pdf["i"].to_numpy()[s.doc], pdf["half"].to_numpy()[s.doc]
            if known is None:
                pick, more = half[s.of] == 0, []
            else:
                own = np.array([known.value.langs.index(x) if x in known.value.langs else -1 for x in langs])
                lang, _, n, like = s.languages(known.value)
                ok = own[label] == lang if known.value.langs else np.zeros(len(label), bool)
                pick, held = ok[s.of], half == 1
                per = lambda m, w: np.bincount(label[m], w[m], len(langs))
                given = [(-3 - langs.index(x), per(held & (lang == m), np.ones(len(lang)))) for m, x in enumerate(known.value.langs)]
                more = [(np.arange(len(langs)), g, w) for g, w in ((-1, per(held & ok, n)), (-2, per(held & ok, like * 1e6)), *given)]
            key, n = np.unique(label[s.of][pick] * _A**GRAM + s.grams[pick], return_counts=True)
            yield pd.DataFrame({"i": key // _A**GRAM, "g": key % _A**GRAM, "n": n})
            for i, g, n in more:
                yield pd.DataFrame({"i": i, "g": g, "n": n.astype(np.int64)})

    return sample.mapInPandas(run, "i long, g long, n long").groupBy("i", "g").agg(F.sum("n").alias("n")).toPandas()


def fit(docs: DataFrame, bound: int = SAMPLE) -> Profiles:
    """Profiles fitted on ``bound`` labelled documents of each language at most, chosen by hash of doc_id.

    Labels may be wrong. One half of each sample is fitted first. A language that then takes more of the other half's
    sentences from other labels than from its own is only a wrong label: it is left out and the fit begins again. One
    of whose own other half less than HOLDS is recognised has no profile either. The second fit takes both halves,
    without the sentences that the first did not find in their label's language.
    """
    named = docs.select("doc_id", label_code(F.col("lang")).alias("code")).where("code IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = named.withColumn("rank", rank).where(F.col("rank") <= bound).toPandas()  # ``bound`` rows for each of NAMES at most
    langs, spark = sorted(chosen["code"].unique()), docs.sparkSession
    if not langs:
        return prototypes([], pd.DataFrame({"i": [], "g": [], "n": []}))
    chosen = pd.DataFrame({"doc_id": chosen["doc_id"], "i": np.searchsorted(langs, chosen["code"]), "half": chosen["rank"] % 2})
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, i long, half long")), "doc_id").select("text", "i", "half")
    while True:
        first = prototypes(langs, _count(sample, langs))
        got = _count(sample, langs, spark.sparkContext.broadcast(first))
        stat = lambda g: np.bincount(got["i"][got["g"] == g], got["n"][got["g"] == g], len(langs))
        given = np.stack([stat(-3 - m) for m in range(len(langs))], 1)  # [label, language]
        false = np.flatnonzero(given.diagonal() < HOLDS * given.sum(0))
        if not len(false):
            break
        keep = np.delete(np.arange(len(langs)), false)
        langs = [langs[i] for i in keep]
        if not langs:
            return prototypes([], pd.DataFrame({"i": [], "g": [], "n": []}))
        new = F.create_map(*[F.lit(int(x)) for i, k in enumerate(keep) for x in (k, i)])
        sample = sample.withColumn("i", new[F.col("i").cast("int")].cast("long")).where("i IS NOT NULL")
    holds = given.diagonal() >= HOLDS * np.maximum(1, given.sum(1))
    out = prototypes(langs, got[(got["g"] >= 0) & holds[got["i"]]])
    out.usual = (stat(-2) / 1e6 / np.maximum(1, stat(-1)))[[langs.index(x) for x in out.langs]]
    return out


def segments(docs: DataFrame, known: Profiles) -> DataFrame:
    """(doc_id, segment, start, stop, lang, letters, confidence): runs of sentences of one language, in order.

    Positions are code points of the text; null texts and texts without letters that count have none. A run that is
    in none of the known languages has the language OTHER.
    """
    docs = docs if known.langs else docs.limit(0)  # no labelled sample, no languages
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in batches:
            s = Sentences(list(pdf["text"]))
            lang, sure, grams, like = s.languages(p)
            if not len(lang):
                continue
            head = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (s.doc[1:] != s.doc[:-1])]))
            tail = np.append(head[1:], len(lang)) - 1
            doc, letters = s.doc[head], np.add.reduceat(s.letters, head)
            no = np.arange(len(head)) - np.searchsorted(doc, doc, "left") + 1
            none = p.other(doc, *(np.add.reduceat(x, head) for x in (p.usual[lang] * grams, grams, like)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[doc], "segment": no, "start": s.start[head], "stop": s.stop[tail], "lang": np.where(none, OTHER, np.array(p.langs)[lang[head]]), "letters": letters, "confidence": np.add.reduceat(sure * s.letters, head) / letters})

    return docs.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL").mapInPandas(run, "doc_id long, segment long, start long, stop long, lang string, letters long, confidence double")


def languages(docs: DataFrame, known: Profiles, share: float = SHARE) -> DataFrame:
    """(doc_id, label, lang, share, confidence, several): each document's languages with ``share`` of its letters.

    ``label`` is the code the document's label names, or null. What is in none of the known languages counts as OTHER,
    or as the label if that names a language without profile. A document's segments come from one task, so they are
    summed there and nothing is shuffled.
    """
    docs = docs if known.langs else docs.limit(0)  # no labelled sample, no languages
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in batches:
            s = Sentences(list(pdf["text"]))
            lang, sure, grams, like = s.languages(p)
            if not len(lang):
                continue
            k, n = len(p.langs) + 1, len(pdf)
            per = lambda at, w: np.bincount(at, w, n * k).reshape(n, k)
            cell = s.doc * k + lang
            none = p.other(np.repeat(np.arange(n), k), *(per(cell, x).ravel() for x in (p.usual[lang] * grams, grams, like)))
            cell = np.where(none[cell], s.doc * k + k - 1, cell)
            got, conf = per(cell, s.letters), per(cell, s.letters * sure)
            all_ = got.sum(1, keepdims=True)
            d, i = np.nonzero((got > 0) & (got >= share * all_))
            many = np.bincount(d, minlength=n) > 1
            label = pdf["label"].to_numpy()[d]
            name = np.array([*p.langs, OTHER], object)[i]
            trusted = (i == k - 1) & pd.notna(label) & ~np.isin(label.astype(str), p.langs)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[d], "label": label, "lang": np.where(trusted, label, name), "share": got[d, i] / all_[d, 0], "confidence": conf[d, i] / got[d, i], "several": many[d]})

    return docs.select("doc_id", "text", label_code(F.col("lang")).alias("label")).where("text IS NOT NULL AND doc_id IS NOT NULL").mapInPandas(run, "doc_id long, label string, lang string, share double, confidence double, several boolean")


def mislabelled(found: DataFrame) -> DataFrame:
    """(doc_id, lang) of the documents whose label is missing, wrong, or names one of several languages."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return found.where(F.col("several") | wrong).select("doc_id", "lang")
