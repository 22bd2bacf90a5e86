"""Keyword-stuffed, link-list and tag pages, by perplexity under an n-gram model of prose.

Texts become sequences of function-word classes (determiner, preposition, conjunction, pronoun, auxiliary, adverb; in six languages) and word classes
(lower-case, capitalised, file name, link, punctuation and so on). A content word far from any function word has a class of its own. A 4-gram
model is counted over the prose of the whole corpus: the sentences with a usual share of function words. Windows of a page whose
perplexity is abnormally high (words, links and tags that no sentence holds together) or abnormally low (the same few words over and over) are
stuffed, measured against the perplexity of the prose itself; without any function word a window is so from a lower bound on, as product lines have it; a page is spam if they hold more than half of its text. Lines of code, assembly, logs, symbol tables and lists of described functions are
known by their identifiers, registers and time stamps and are left out of the sequence, but count as text of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.batches import chunks

#: Function words of English, German, French, Spanish, Portuguese and Russian; a word of several classes keeps the first.
FUNCTION_WORDS = {
    "DET": "the a an this that these those its their his her our your my every each some any no all both another which what der die das dem den des ein eine einen einem einer eines dieser diese dieses diesem diesen jede jeder jedes alle le la les un une ce cet cette ces son sa ses leur leurs tout tous toute el los las una unos unas este esta estos estas ese esa su sus todo todos o os um uma uns umas esse essa seu sua seus suas этот эта это эти тот та то те все весь всех каждый его её их",
    "PREP": "of in on at by for with from to into as than after before over under between through during without about per against within since until past down up auf aus bei mit nach von vor zu zum zur über unter durch für gegen ohne um bis seit zwischen im am vom ins de du au aux dans sur par pour avec sans sous entre vers chez depuis del al en con por para sin sobre desde hasta do da dos das na nos nas ao à às pelo pela com sem sob até em в во на с со по к ко из от за об у для при без через под над между перед",
    "CONJ": "and or but if when while because so although whether not nor yet then also und oder aber wenn weil dass ob nicht wie sondern denn auch et ou mais si quand parce que qui dont où ne pas y aussi donc u pero cuando porque ni también e se não nem também и или но если когда чтобы не ни также как а",
    "PRON": "it he she they we you i them us him who whom there here er sie es wir ihr ich man sich uns ihm ihn il elle on nous vous ils elles je lui él ella ellos nosotros lo ele ela eles nós você он она оно они мы вы я себя нас ему кто",
    "AUX": "is are was were be been being has have had did does can could may might will would should must ist sind war waren wird werden wurde wurden hat haben hatte kann können konnte muss soll sollte est sont était ont avait peut doit être été faut son era está están fue ha han había puede debe ser é são foi tem têm pode deve há есть был была было были будет может должен нужно",
    "ADV": "only first last second now already still just very more most such once never nur ersten erste zweiten letzte schon noch sehr mehr wieder insgesamt seulement premiers premier dernière deuxième seconde déjà encore très plus solo primeros primero segunda segundo último ya aún muy más apenas primeiros primeiro já ainda muito mais только первые первый вторым второй уже ещё очень более неясно зачем потому всего что",
}
#: Mnemonics, registers and C keywords that mark a technical line.
TECHNICAL = frozenset(
    "rax rbx rcx rdx rsi rdi rbp rsp eax ebx ecx edx esi edi mov movzx movsx lea push pop call jmp jz jnz ja jb jl jg jle jge cmp test xor shl shr sar rol ror add sub adc sbb inc dec neg imul idiv bt xchg retn ret nop ptr qword dword byte int void char unsigned size_t struct static const return goto case switch break memset sizeof".split()
) - {"add", "call", "push", "test", "break", "case", "return", "static", "byte", "int", "char", "switch"}
LOG_LEVELS = frozenset("TRACE DEBUG INFO WARN WARNING ERROR FATAL".split())
SUFFIXES = re.compile(r"\.(?:dll|so|dylib|exe|sys|lib)(?:\.|$)", re.IGNORECASE)
PUNCTUATION = {".": "DOT", "?": "DOT", ",": "COMMA", ":": "COLON", "!": "EXCL", "|": "BAR", "·": "BAR", "►": "BAR", "/": "BAR", "•": "BUL", "-": "BUL", "*": "BUL", "–": "BUL", "—": "BUL", "(": "BRK", ")": "BRK", "[": "BRK", "]": "BRK", '"': "BRK", "<": "BRK", ">": "BRK", "\n": "NL", "\x00": "END"}
NAMES = ["DET", "PREP", "CONJ", "PRON", "AUX", "ADV", "LW", "CW", "UW", "NUM", "HEX", "ID", "FILE", "SLUG", "TAG", "DOT", "COMMA", "COLON", "EXCL", "BAR", "BUL", "BRK", "OP", "NL", "TECH", "MIX", "LWF", "CWF", "FILEF", "SLUGF", "END"]
CLASS = {n: i for i, n in enumerate(NAMES)}
K = len(NAMES)
_FUNCTION = {w: CLASS[k] for k in reversed(FUNCTION_WORDS) for w in FUNCTION_WORDS[k].split()}
IS_FUNCTION = np.arange(K) < 6
IS_WORD = ~np.isin(np.arange(K), [CLASS[x] for x in ("DOT", "COMMA", "COLON", "EXCL", "BAR", "BUL", "BRK", "OP", "NL", "END")])
IS_TECHNICAL = np.isin(np.arange(K), [CLASS[x] for x in ("HEX", "ID", "TECH")])
FAR_CLASS = np.arange(K)
for _a, _b in (("LW", "LWF"), ("CW", "CWF"), ("UW", "CWF"), ("FILE", "FILEF"), ("SLUG", "SLUGF")):
    FAR_CLASS[CLASS[_a]] = CLASS[_b]

#: Tokens on each side of a scored one; tokens without a function word after which content counts as far.
RADIUS, FAR = 10, 8
#: Occurrences that the lower order of the model counts for: so many, or this share of all tokens of prose.
LEAST_WEIGHT, PRIOR_SHARE = 5, 1e-4
#: Times the prose's own mean bits above which a window is stuffed, above which one without any function word is, and below which any is.
HIGH_PART, BARE_PART, LOW_PART = 2.6, 1.75, 0.25
#: A line is technical if one in so many of its tokens is and either one in so many of its words or function words are as frequent as in prose (one in
#: so many words), so that a name or two don't hide a line of keywords; a sentence is prose for training from this share and number of function words.
TECHNICAL_ONE_IN, TECHNICAL_WORDS, FUNCTION_ONE_IN, PROSE_SHARE, PROSE_WORDS = 16, 4, 8, 0.15, 2

_TOKEN = re.compile(r"https?://[^\s\x00)\]>\"']+|\d+(?::\d+)+|#\w+|\w+(?:[.'’-]\w+)*|\n|[^\w\s]")
_IDENTIFIER = re.compile(r".*_|.*[a-z][A-Z]|.*[A-Z]{2}[a-z]")
_REGISTER = re.compile(r"[rwxvae]\d+[dwb]?|xmm\d+")
_HEX = re.compile("[0-9a-f]{6,}")


def word_class(t: str) -> int:
    name = PUNCTUATION.get(t)
    if name:
        return CLASS[name]
    if t[0] == "#" and len(t) > 1:
        return CLASS["TAG"]
    if t.startswith(("http://", "https://")):
        return CLASS["SLUG"]
    if not (t[0].isalnum() or t[0] == "_"):
        return CLASS["OP"]
    low = t.lower()
    if t in LOG_LEVELS or t[0].isdigit() and ":" in t:
        return CLASS["TECH"]
    if low in _FUNCTION:
        return _FUNCTION[low]
    if t[0].isdigit():
        return CLASS["HEX" if low.startswith("0x") or _HEX.fullmatch(low) else "NUM"]
    if _IDENTIFIER.match(t):
        return CLASS["ID"]
    if low in TECHNICAL or _REGISTER.fullmatch(low):
        return CLASS["TECH"]
    if SUFFIXES.search(t):
        return CLASS["FILE"]
    if "." in t:
        return CLASS["MIX"]
    if len(t) > 1 and t.isupper():
        return CLASS["UW"]
    return CLASS["CW" if t[0].isupper() else "LW"]


class _Classes(dict):
    """Token -> class, remembered up to a bound."""

    def __missing__(self, t: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[t] = c = word_class(t)
        return c


_classes = _Classes()


class Sequence:
    """Classes of the scored tokens of several texts, with the text each belongs to."""

    def __init__(self, texts: list[str]):
        tokens = _TOKEN.findall("\x00".join(t.replace("\x00", " ") for t in texts) + "\x00")
        c = np.fromiter(map(_classes.__getitem__, tokens), np.int64, len(tokens))
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        end, line_end = c == CLASS["END"], (c == CLASS["NL"]) | (c == CLASS["END"])
        size[line_end] = 0
        doc, line = np.cumsum(end) - end, np.cumsum(line_end) - line_end
        n = np.bincount(line)
        marks = np.bincount(line, weights=IS_TECHNICAL[c], minlength=len(n))
        words, function = (np.bincount(line, weights=x[c], minlength=len(n)) for x in (IS_WORD, IS_FUNCTION))
        told = (marks * TECHNICAL_WORDS >= words) | (function > 0) & (function * FUNCTION_ONE_IN >= words)
        keep = ~((marks > 0) & (marks * TECHNICAL_ONE_IN >= n) & told)[line] & ~end
        self.total = np.bincount(doc, weights=size, minlength=len(texts))
        self.doc, self.size, c = doc[keep], size[keep], c[keep]
        at = np.arange(len(c))
        self.first = np.searchsorted(self.doc, np.arange(len(texts)), "left")[self.doc]
        self.last = np.searchsorted(self.doc, np.arange(len(texts)), "right")[self.doc]
        seen = np.maximum.accumulate(np.where(IS_FUNCTION[c], at, -FAR)) if len(c) else at
        self.c = np.where(at - np.where(seen >= self.first, seen, self.first - FAR // 2) >= FAR, FAR_CLASS[c], c)

    def mean(self, x: np.ndarray, radius: int) -> np.ndarray:
        s = np.r_[0.0, np.cumsum(x)]
        at = np.arange(len(x))
        a, b = np.maximum(at - radius, self.first), np.minimum(at + radius + 1, self.last)
        return (s[b] - s[a]) / (b - a)

    def prose(self) -> np.ndarray:
        """Tokens of sentences (between full stops, exclamation marks and line ends) in which function words are as frequent as in prose."""
        stop = np.isin(self.c, [CLASS["DOT"], CLASS["EXCL"], CLASS["NL"]])
        stop |= np.r_[self.doc[1:] != self.doc[:-1], True] if len(self.doc) else stop
        sentence = np.cumsum(stop) - stop
        n, fw = np.bincount(sentence), np.bincount(sentence, weights=IS_FUNCTION[self.c])
        return ((fw >= PROSE_WORDS) & (fw >= PROSE_SHARE * n))[sentence] if len(sentence) else stop

    def grams(self) -> np.ndarray:
        """4-gram ending at each token; -1 where it would reach over the start of the text."""
        c, g = self.c, np.full(len(self.c), -1)
        if len(c) > 3:
            g[3:] = ((c[:-3] * K + c[1:-2]) * K + c[2:-1]) * K + c[3:]
            g[np.arange(len(c)) - self.first < 3] = -1
        return g


def bits_table(counts: np.ndarray) -> np.ndarray:
    """Bits of each 4-gram's last class, each order smoothed with the one below.

    The weight of the lower order is a share of the corpus: contexts that stand in a few pages only (a spam line that runs on into prose) say little,
    however many such pages a larger corpus holds.
    """
    g4 = counts.reshape(K, K, K, K)
    g3 = g4.sum(0)
    g2 = g3.sum(0)
    g1 = g2.sum(0)
    p = (g1 + 1) / (g1.sum() + K)
    weight = max(LEAST_WEIGHT, PRIOR_SHARE * counts.sum())
    for g in (g2, g3, g4):
        p = (g + weight * p) / (g.sum(-1, keepdims=True) + weight)
    return np.minimum(-np.log2(p), 12).astype(np.float32).ravel()


def prose_model(docs: DataFrame) -> np.ndarray:
    """Counts over the whole corpus; each batch sends its distinct 4-grams only, and at most K**4 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(K**4, np.int64)
        for _, texts in chunks(batches):
            s = Sequence([t or "" for t in texts])
            g = s.grams()
            sums += np.bincount(g[(g >= 0) & s.prose()], minlength=K**4)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], names=["gram", "n"])

    out = np.zeros(K**4)
    for r in docs.select("text").where("text is not null").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.gram] = r.n
    return out


def train(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Bits of each 4-gram, and the mean bits of the prose itself."""
    counts = prose_model(docs)
    bits = bits_table(counts)
    return bits, float((counts * bits).sum() / max(counts.sum(), 1))


def spam_scores(docs: DataFrame, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """doc_id, stuffed (share of the text in stuffed windows), perplexity (mean bits of the scored tokens) of every non-empty text.

    Null and empty texts give no row; texts without four scored tokens (code only, a word or two) have stuffed 0 and null perplexity; repeated rows are
    scored each; other columns are ignored; an empty table gives none. Whole texts are scored. The model is counted anew unless one is given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model if model is not None else train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, usual = shared.value
        for rows, texts in chunks(batches):
            s = Sequence(texts)
            g = s.grams()
            has = g >= 0
            b = np.where(has, table[np.maximum(g, 0)], 0.0)
            n = len(texts)
            count = np.bincount(s.doc[has], minlength=n)
            mean = np.bincount(s.doc, weights=b, minlength=n) / np.maximum(count, 1)
            b = np.where(has, b, mean[s.doc])  # the first three tokens of a text have no 4-gram
            m = s.mean(b, RADIUS)
            bare = s.mean(IS_FUNCTION[s.c].astype(float), RADIUS) == 0
            bad = ((m > HIGH_PART * usual) | bare & (m > BARE_PART * usual) | (m < LOW_PART * usual)) & (count[s.doc] > 0)
            share = np.bincount(s.doc, weights=s.size * bad, minlength=n) / np.maximum(s.total, 1)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(share), pa.array(mean, mask=count == 0)], names=["doc_id", "stuffed", "perplexity"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and text <> ''").mapInArrow(run, "doc_id bigint, stuffed double, perplexity double")
